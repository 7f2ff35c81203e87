"""Vector codes, SentencePiece and the prefix trie, each beside a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from siftstone.llm import catalog, codes, pieces, trie

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id bigint, embedding array<float>, label int, v string, code string, was string, rows string"
TURNS = "conv_id bigint, turn bigint, role string, text string, c string, depth string, owner string"


# Vector codes


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "v", "c", "w", "r") for i, v, label in rows], VECTORS)


def codes_by_force(rows, parts, entries, rounds, scale=256):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and None not in v and np.isfinite(v).all()]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : p * width + width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda c, p: min(range(len(books[p])), key=lambda e: (apart(c[p], books[p][e]), e))
    for _ in range(rounds):
        of = [[best(c, p) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                if mine := [c[p] for c, o in zip(cut, of) if o[p] == e]:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut):
        of = [best(c, p) for p in range(parts)]
        error = sum(apart(c[p], books[p][of[p]]) for p in range(parts))
        sums[label] += error
        out.append((i, bytes(of).hex(), error, label))
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=str)


@pytest.mark.parametrize("seed, n, entries, rounds", [(1, 90, 8, 2), (2, 5, 64, 3), (3, 60, 256, 1), (4, 40, 4, 0)])
def test_codes_by_force(spark, seed, n, entries, rounds):
    r = np.random.default_rng(seed)
    rows = [(int(r.integers(0, 70)), r.choice([-1.5, -0.3, 0.0, 0.01, 0.9, 40.0], 8).tolist(), None if k % 5 == 0 else k % 3) for k in range(n)]
    rows += [(None, [0.5] * 8, 1), (3, None, 1), (4, [1.0] * 7 + [None], 1), (5, [float("nan")] * 8, 1), (6, [float("-inf")] * 8, 1), (7, [], 2), (8, [0.2] * 5, None)]
    got = codes.code_table(vectors(spark, rows).repartition(3), parts=4, entries=entries, rounds=rounds).collect()
    assert sorted((tuple(x) for x in got), key=str) == codes_by_force(rows, 4, entries, rounds)


def test_codes_of_nothing_and_of_huge_components(spark):
    assert codes.code_table(vectors(spark, [])).collect() == []
    assert codes.code_table(vectors(spark, [(1, None, 1)])).collect() == []
    assert [tuple(r)[:4] for r in codes.code_table(vectors(spark, [(1, [], 1)])).collect()] == [(1, "00" * 16, 0, 0)]
    got = codes.code_table(vectors(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [300000.0] * 16, 1)]), entries=2).collect()
    assert {r["vec_id"]: r["code"][:2] for r in got} == {1: "00", 2: "01", 3: "00"} and all(r["error"] >= 0 for r in got)


def test_only_moved_parts_count(spark):
    x = [[4 * k + j for j in range(4)] for k in range(6)]
    rows = [(k, "l", x[k], bytes([0, 1]), bytes([0, 1])) for k in range(4)] + [(4, "l", x[4], bytes([0, 1]), bytes([1, 1])), (5, "l", x[5], None, bytes([2, 0]))]
    table = spark.createDataFrame(rows, "vec_id bigint, label string, v array<int>, was binary, code binary")
    got = codes.changes(table, 2, 3, 2)
    want = np.zeros((2, 3, 3), int)
    want[0, 0] -= [16, 17, 1]
    want[0, 1] += [16, 17, 1]
    want[0, 2] += [20, 21, 1]
    want[1, 0] += [22, 23, 1]
    assert (got == want).all()


# SentencePiece


def merged_by_force(cost, text):
    """The best pair, the leftmost first among equals, until there is none."""
    symbols = list(text)
    while found := min(((cost[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in cost), default=None):
        k = found[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
    return symbols


ODD = [None, "", " ", "   ", "a", " a  b ", "\n\t x", "\x00", "<s></s><unk><0x41>", "▁▁ a▁", "naïve café", "中文 😀‍👩 é ﬁ", "the " * 3000, "x" * 20000, " " * 5000, "Über straße\r\n"]


def test_merging_by_force():
    model, r = pieces.Pieces.of(MODEL), random.Random(5)
    for _ in range(300):
        text = "▁" + "".join(r.choice("▁▁▁ thenaiousr") for _ in range(r.randint(0, 25))).replace(" ", "▁")
        symbols = merged_by_force(model.cost, text)
        assert model.merged(text) == [model.id[s] for s in symbols]


def test_encoding_and_decoding(spark, docs):
    library, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(6)
    texts = ODD + ["".join(r.choice("abe▁ \n\x00éñ中😀<s>thing") for _ in range(r.randint(0, 40))) for _ in range(300)]
    pairs = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (0, "again")]
    got = pieces.encode(docs(pairs).repartition(3), MODEL).collect()
    want = [(i, library.encode(t or "", add_bos=True, add_eos=True)) for i, t in pairs]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x["doc_id"], x["ids"], x["decoded"]) for x in got), key=key) == sorted(((i, ids, library.decode(ids)) for i, ids in want), key=key)
    digest = {x["doc_id"]: x for x in pieces.digests(docs(pairs), MODEL).where("doc_id > 0").collect()}
    for i, ids in want:
        if i:
            assert digest[i][1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert pieces.digests(docs([]), MODEL).collect() == []
    assert pieces.encode(docs({1: "a b"}), MODEL, begin=False, end=False).first()["ids"] == library.encode("a b")


def test_decoding_any_ids():
    model, r = pieces._registered(pieces.Pieces.of(MODEL)), random.Random(7)
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, 3, 70, 131, 200, 230, 243, 258, 259, 264, 500, 28705]) for _ in range(r.randint(0, 8))]
        assert model.decode(ids) == model.library.decode(ids)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    model = pieces.Pieces(MODEL)
    text = "one two three four five one two three four five"
    assert np.frombuffer(model.encode(text), "<u4").tolist() == model.library.encode(text) and len(model.words) <= 3


def test_a_wrong_word_differs_from_the_library():
    model = pieces.Pieces(MODEL)
    model.words["▁wrong"] = model.words["▁right"]
    assert np.frombuffer(model.encode("wrong"), "<u4").tolist() != model.library.encode("wrong")


# The trie


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "c", "d", "o") for r in rows], TURNS)


def trie_by_force(rows, group=100, most=6):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ends, last = defaultdict(list), defaultdict(list), {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % most
        donor = c - int(np.fmod(c, group))
        seq = tuple(turns.get(donor, [])[:h] + turns[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    totals = {}
    for s in sorted(members, key=len, reverse=True):
        kids = children[s]
        totals[s] = (sum(totals[k][0] for k in kids) or (0 if kids else 1), sum(totals[k][1] for k in kids) + ((len(members[s]) - 1) * len(s[-1][1]) if s else 0))
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), len(children[s]), *totals[s], hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest()) for s, m in members.items())


def got_trie(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


@pytest.mark.parametrize("block", [2, 4096])
def test_trie_by_force(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    r = random.Random(8)
    rows = []
    for c in [-205, -200, -7, 0, *r.sample(range(1, 420), 50), 100, 200, 1 << 40]:
        for t in range(r.choice([1, 2, 3, 9])):
            rows.append((c, r.choice([None, t, t, t, 3]), r.choice([None, "", "user", "bot"]), r.choice([None, "", "hi", "ho", "é😀"])))
    rows += rows[:5] + [(None, 1, "user", "lost")]
    assert got_trie(trie.prefix_trie(conversations(spark, rows).repartition(3))) == trie_by_force(rows)


def test_trie_of_copies_and_of_nested_branches(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 8)
    copies = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(7)]
    long = [(1000 + c, t, "user", "x" if t < c else f"y{c}") for c in range(25) for t in range(c + 1)]  # one more branch at each depth
    rows = copies + long + [(5000, t, "bot", "z" * (t % 5)) for t in range(200)]
    assert got_trie(trie.prefix_trie(conversations(spark, rows))) == trie_by_force(rows)


def test_trie_of_little(spark):
    assert trie.prefix_trie(conversations(spark, [])).collect() == []
    assert trie.prefix_trie(conversations(spark, [(None, 1, "user", "x")])).collect() == []
    turnless = [(12301, 0, "user", "gone")]  # takes over turns of a conversation that isn't there
    assert zlib.crc32(b"12301") % 6 > 0
    assert got_trie(trie.prefix_trie(conversations(spark, turnless))) == trie_by_force(turnless)


# Their SQL


@pytest.mark.parametrize("name", ["op11_delta_lloyd_codes", "op13_leaf_peeling_trie"])
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got = catalog.queries()[name](spark, sf)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
