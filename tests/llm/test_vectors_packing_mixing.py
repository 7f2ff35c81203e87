"""Vectors, packing, mixing, the pipeline and the entry."""

import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftstone.llm import catalog, mixing, packing, topk, vector_dedup

WORDS = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id bigint, embedding array<float>, label int, block string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "b", "n") for i, v, lab in rows], VECTORS)


def cloud(seed=3, n=300, dim=12):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = r.normal(size=dim) if i % 3 == 0 or not rows else np.array(rows[r.integers(len(rows))][1]) + r.normal(size=dim) * r.choice([0, 0.05, 0.2])
        rows.append((i + 10, v.astype(np.float32).tolist(), int(r.integers(0, 2))))
    return rows


BAD = [(1, None, 0), (2, [], 0), (3, [0.0] * 12, 0), (4, [1.0] * 11 + [None], 0), (5, [1.0] * 11 + [float("nan")], 0), (6, [float("inf")] * 12, 0), (7, [1.0] * 12, None), (None, [1.0] * 12, 0), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0)]


def links_by_force(rows, least):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    root, n = {i: i for i, _, _ in rows if i is not None}, Counter()
    for k, (i, v, lab) in enumerate(ok):
        for j, w, other in ok[:k]:
            if i != j and lab == other and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= least:
                n.update((i, j))
                low, high = sorted((root[i], root[j]))
                root = {a: low if b == high else b for a, b in root.items()}
    return {i: (n[i], root[i]) for i in root}


def test_similar_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 20)
    rows = cloud() + BAD
    got = vector_dedup.similar_vectors(vectors(spark, rows), 0.98).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == links_by_force(rows, 0.98)
    assert len(got) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert vector_dedup.similar_vectors(vectors(spark, []), 0.98).count() == 0


def test_repeated_rows_are_one_vector(spark):
    got = vector_dedup.similar_vectors(vectors(spark, [(1, [1, 0], 0), (1, [1, 0], 0), (2, [1, 0], 0)])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def top_by_force(rows, queries, k):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = set()
    for i, v in ok:
        if i in queries:
            near = sorted((-int(v @ w), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("spread", [False, True])
def test_top_inner_products(spark, monkeypatch, spread):
    for name, n in (("SEEDS", 30), ("QUERIES", 10), ("VECTORS", 40), ("STEP", 16)):
        monkeypatch.setattr(topk, name, n)
    r = random.Random(1)
    rows = [(i, [x * (r.choice([0.1, 1, 5]) if spread else 1) for x in v], lab) for i, v, lab in cloud(4, 240)] + BAD + [(500, [1.0] * 12, 0), (501, [1.0] * 12, 0)]
    t = vectors(spark, rows)
    got = topk.top_inner_products(t, t.where("vec_id % 5 = 0"), 7).collect()
    assert {tuple(x) for x in got} == top_by_force(rows, {i for i, _, _ in rows if i is not None and i % 5 == 0}, 7)
    assert topk.top_inner_products(vectors(spark, []), vectors(spark, [])).count() == 0


def test_pruned_search_is_exact():
    r = np.random.default_rng(2)
    q, c = np.floor(r.normal(size=(9, 40)) * 30), np.floor(r.normal(size=(700, 40)) * r.exponential(20, (700, 1)))
    turn = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    i, vec, score = topk.search(q, np.arange(9) - 100, np.full(9, -(1 << 60)), c, np.arange(700), turn, 11)
    exact = (q @ c.T).astype(int)
    for k in range(9):
        want = sorted((-exact[k, j], j) for j in range(700))[:11]
        assert sorted((-s, v) for a, v, s in zip(i, vec, score) if a == k) == want


PACKED = {1: "hello world", 2: None, 3: "", 4: " \n ", 5: "a\x01b it's <|endoftext|> 日本 É", 6: "word " * 9000, 7: "x" * 3000, None: "no id"}


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    texts = list(PACKED.items()) + [(100 + i, "some words to pack " * (i % 23)) for i in range(200)] + [(1, "hello world")]
    got = packing.pack(docs(texts).repartition(3), WORDS, 256).collect()
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids) + (2,)) for i, x in texts)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[(r["doc_id"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (i, ids), n in want.items():
        own = sorted(pieces[(i, len(ids))], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == n * len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 256 and end & (end - 1) == 0
    assert packing.pack(docs({}), WORDS).count() == 0


def test_a_full_memory_starts_anew(docs, monkeypatch):
    texts = {i: f"alpha beta{i} gamma{i * 7}" for i in range(50)}
    first = {tuple(r) for r in packing.pack(docs(texts).coalesce(1), WORDS, 64).collect()}
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    import pyarrow as pa

    from siftstone.llm.common import text_array, text_bytes

    tokens, at = packing.WordIds(WORDS).encode(*text_bytes(text_array(pa.array(list(texts.values())))), 2)
    assert {(r[0], r[4]) for r in first} == {(i, int(at[i + 1] - at[i])) for i in range(50)}


@pytest.fixture
def sources(docs):
    parts = [docs([(1000 * k + i, "t") for i in range(n)], source=name) for k, (name, n) in enumerate([("big", 900), ("mid", 300), ("low", 90), (None, 40)])]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@pytest.mark.parametrize("weights", [None, {"big": 0.5, "mid": 0.3, "low": 0.2}, {"big": 3, "mid": 7, "low": 1, "(none)": 1}])
def test_mixing(sources, weights):
    got = mixing.mix_sources(sources, weights, period=97, block_docs=4, buckets=7).collect()
    assert len(got) == 1330 and len({r["mix_order"] for r in got if r["slot"] < 1 << 39}) == sum(r["slot"] < 1 << 39 for r in got)
    assert ("(none)" in (weights or {"(none)": 1})) == any(r["slot"] < 1 << 39 for r in got if r["source"] == "(none)")
    slots = sorted({(r["slot"], r["source"], r["block"], r["release"], r["deadline"]) for r in got if r["slot"] < 1 << 39})
    assert all(release <= slot < deadline for slot, _, _, release, deadline in slots)
    share = {r["source"]: Fraction(1) for r in got}
    last = {s: max(x[0] for x in slots if x[1] == s) for s in {x[1] for x in slots}}
    horizon = min(last.values())
    period = {s: [x for x in slots if x[1] == s] for s in last}
    total = {s: next((x[4] for x in p if x[2] == 0), 1) for s, p in period.items()}
    assert total and share
    had = Counter()
    for slot, s, block, release, _ in slots:
        if slot > horizon:
            break
        assert block == had[s]  # a source's blocks come in turn
        had[s] += 1


def test_deviation_is_below_one_block(spark, sources):
    weights = {"big": 0.5, "mid": 0.3, "low": 0.2}
    got = mixing.mix_sources(sources, weights, period=100, block_docs=4).where("slot < 1099511627776").select("slot", "source").distinct().orderBy("slot").collect()
    had = Counter()
    for slot, s in ((r["slot"], r["source"]) for r in got):
        if slot >= 90 // 4 / 0.2:
            break
        had[s] += 1
        assert all(abs(had[x] - w * (slot + 1)) < 1 for x, w in weights.items())


@pytest.mark.parametrize("sizes,weights", [((4000, 8000), (1 / 3, 2 / 3)), ((6400, 1700, 300, 4900), None), ((3000, *[200] * 60), (0.3, *[0.7 / 60] * 60))])
def test_deviation_from_true_weights_does_not_grow(spark, docs, sizes, weights):
    names = [f"s{k}" for k in range(len(sizes))]
    made = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k int, n int").selectExpr("explode(sequence(0, n - 1)) AS i", "k").selectExpr("CAST(k * 100000 + i AS BIGINT) AS doc_id", "concat('s', k) AS source")
    w = np.array(weights or np.sqrt(sizes))
    got = mixing.mix_sources(made, dict(zip(names, weights)) if weights else None, period=32, block_docs=1).collect()
    assert len(got) == sum(sizes) == len({r["mix_order"] for r in got})
    order = sorted((r["slot"], int(r["source"][1:])) for r in got)
    end = min(max(s for s, k in order if k == j) for j in range(len(sizes)))
    assert end > 1000
    had, w = np.zeros(len(w)), w / w.sum()
    for slot, k in order:
        if slot > end:
            break
        had[k] += 1
        assert np.all(np.abs(had - w * (slot + 1)) < 2 + w * len(w)) and had.sum() == slot + 1


@pytest.mark.parametrize("sizes,weights", [((9000, 18000, 33000), (1, 2, 4)), ((4000, 8000), (1 / 3, 2 / 3)), ((6400, 1700, 300, 4900, 77), None), ((3000, *[200] * 60), (0.3, *[0.7 / 60] * 60))])
def test_below_one_block_whatever_the_weights(spark, sizes, weights):
    made = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k int, n int").selectExpr("explode(sequence(0, n - 1)) AS i", "k").selectExpr("CAST(k * 100000 + i AS BIGINT) AS doc_id", "concat('s', lpad(k, 3, '0')) AS source")
    given = {f"s{k:03}": x for k, x in enumerate(weights)} if weights else None
    blocks = lambda period: sorted((r["slot"], r["source"], r["block"], r["release"], r["deadline"]) for r in mixing.mix_sources(made, given, period=period, block_docs=4).where("block_offset = 0").collect())
    got = blocks(64)
    assert got == blocks(1000) and all(release <= slot < due for slot, _, _, release, due in got)  # the cut into periods doesn't show
    w = np.array(weights or np.sqrt(sizes)) / sum(weights or np.sqrt(sizes))
    end = min(max(x[0] for x in got if x[1] == f"s{k:03}") for k in range(len(sizes)))
    had = np.zeros(len(w))
    for slot, name, *_ in got:
        if slot > end:
            break
        had[int(name[1:])] += 1
        assert np.abs(had - w * (slot + 1)).max() < 1 + 1e-5 and had.sum() == slot + 1


def test_many_sources(spark):
    """More sources than a row may hold: small ones share the pool, each keeps its share, no place is given twice."""
    made = spark.range(60_000).selectExpr("id AS doc_id", "IF(id < 20000, 'hot', concat('h', id % 20000)) AS source")
    got = mixing.mix_sources(made, block_docs=1).toPandas()
    assert len(got) == 60_000 == got["mix_order"].nunique() and got["slot"].max() < mixing.AFTER
    w = np.sqrt(20_000) / (np.sqrt(20_000) + 20_000 * np.sqrt(2))
    hot = got[got["source"] == "hot"]["slot"].sort_values().to_numpy()[:300]
    assert np.abs(np.arange(1, 301) - w * (hot + 1)).max() < 1.01


def test_mixing_edges(spark, docs):
    assert mixing.mix_sources(docs({})).count() == 0 and mixing.mix_sources(docs([(None, None), (1, "a"), (1, "a")], source=None)).count() == 3
    left = mixing.mixed(docs([(None, None), (1, "a"), (1, "a"), (2, "b")]))
    assert left.count() == 4 and left.columns == docs({}).columns
    named = docs({1: "a", 2: "b"}).selectExpr("*", "1 AS mix_id", "2 AS mix_order", "3 AS __id", "4 AS __order")
    assert mixing.mixed(named).columns == named.columns and mixing.mixed(named).count() == 2


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got = catalog.queries()[name](spark, sf)
    result = c.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    # Rows themselves, not pandas': that shows whole numbers beside nulls as it likes.
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(result.fetchall(), key=str)


def test_every_query_covers_its_table(spark, sf):
    counts = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "embeddings")}
    for name, query in catalog.queries().items():
        n = query(spark, sf).count()
        whole = counts["embeddings" if name[:3] in ("op2", "op3") else "documents"]
        assert n >= whole if name[:3] != "op3" else n == 20 * -(-whole // 20)


def test_pipeline(spark, sf):
    before = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = before, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == before.columns
        seen.append(docs.count())
    assert before.count() >= seen[0] >= 0.97 * before.count() and seen[0] > seen[1] == seen[2] == seen[3]
    assert docs.agg(F.sum(F.length("text"))).first()[0] < before.agg(F.sum(F.length("text"))).first()[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == seen[3]
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_packing_follows_the_mixed_stream(spark, docs, tmp_path):
    # Part files grow along the stream, and a reader takes the largest first.
    made = docs([(i, "many words to pack here " * (2 + i)) for i in range(400)])
    made.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "mixed"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = corpus_pipeline.pack_tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["doc_id"] for r in packed} == set(range(400))
    tasks = defaultdict(set)
    for r in packed:
        tasks[r["sequence_id"] >> 40].add(r["doc_id"])
    stretches = [tasks[k] for k in sorted(tasks)]
    assert len(stretches) > 1 and all(max(a) < min(b) for a, b in zip(stretches, stretches[1:]))
    back = corpus_pipeline.stream_order(spark.read.parquet(str(tmp_path / "mixed")))
    assert [r["doc_id"] for r in back.collect()] == list(range(400)) and back.columns == ["doc_id", "text"]


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil

    root = Path(__file__).parent.parent.parent
    shutil.copytree(root / "siftstone", tmp_path / "siftstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_bins_take_a_fixed_count_of_their_class():
    r = np.random.default_rng(2)
    for capacity, most in ((32, 32), (256, 40), (256, 256), (64, 33)):
        for _ in range(20):
            sizes = r.integers(1, most + 1, int(r.integers(1, 400)))
            bins, offset, many = packing.classes(sizes, capacity)
            assert set(bins[bins >= 0].tolist()) == set(range(many))
            for b in range(many):
                own = np.flatnonzero(bins == b)
                k = capacity // sizes[own[0]]
                assert set((capacity // sizes[own]).tolist()) == {k} and len(own) == k
                spans = sorted(zip(offset[own].tolist(), sizes[own].tolist()))
                assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= capacity
            # All room can be filled, and no bin was given up without need.
            assert many * capacity <= sizes.sum()
            full = sum(n // k for k, n in Counter((capacity // sizes).tolist()).items())
            assert many == min(full, sizes.sum() // capacity)


def test_pour_cuts_at_rooms_only():
    r = np.random.default_rng(3)
    for _ in range(50):
        sizes, rooms = r.integers(1, 30, 40), r.integers(1, 20, 15)
        stretch, start, size, room, offset = packing.pour(sizes, rooms)
        flat = [(i, j) for i, n in enumerate(sizes) for j in range(n)]
        want = iter(flat)
        assert [(i, s + j, q, o + j) for i, s, n, q, o in zip(stretch, start, size, room, offset) for j in range(n)] == [(*next(want), q, o) for q, n in enumerate(rooms) for o in range(n)]
        assert len(size) <= len(rooms) + len(set(stretch.tolist()))
    assert all(not len(x) for x in packing.pour(np.array([3]), np.zeros(0, np.int64)))


def test_few_documents_are_cut(spark, docs):
    r = np.random.default_rng(4)
    lengths = np.concatenate((r.integers(0, 600, 1500), r.integers(600, 5000, 150), [4095, 4095, 2047, 30000]))
    made = docs([(i, "word " * int(n)) for i, n in enumerate(lengths)]).repartition(2)
    got = packing.pack(made, WORDS).toPandas()
    short = got[got.doc_tokens <= 4096].groupby("doc_id").size()
    assert len(got) < 1.5 * len(lengths) and (short > 1).mean() < 0.4
    assert got.length.sum() == sum(got.drop_duplicates("doc_id").doc_tokens)
    ends = got.assign(end=got.offset + got.length).groupby("sequence_id").end.max()
    assert (ends < 4096).groupby(ends.index.to_numpy() >> 40).sum().max() <= 12 and all(n & (n - 1) == 0 for n in ends)
    # Every document of one length that leaves much room: bins are given up to fill the others.
    same = packing.pack(docs([(i, "word " * 2100) for i in range(60)]).coalesce(1), WORDS).toPandas()
    assert same.length.sum() == 60 * same.doc_tokens.iloc[0] and len(same) < 120
    assert len(same.groupby("sequence_id").length.sum().loc[lambda n: n != 4096]) <= 12
