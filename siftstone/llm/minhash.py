"""MinHash near-duplicates with tensored banding, every candidate verified.

Two collections of `side` short keys (each of HASHES minhashes) give side * side table keys, a pair of a key from either:
2 * HASHES * side minhashes instead of 2 * HASHES * side^2. Two documents of similarity s share a table with probability
(1 - (1 - s^HASHES)^side)^2; `side` is the least with which that is 0.9999 at the threshold. Keys that no two texts share
are dropped before they are paired.

Documents with one and the same shingle set are one text for all that follows. In a table, texts are compared with the
least text there (a star, not all pairs). Where a table then still holds several components, texts of different
components are compared there, in tiles, and nowhere else: texts that share no table never meet, whatever chain of tables
lies between them. A pair that shares several tables is looked at in the first of them alone. Before full sets move, pairs
go whose sizes can't have the similarity, or whose minhashes agree too seldom. A link is made only by the sizes of
full sets' intersection and union.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import batches, bundled, counted_join, forget, free_name, give_back, mix, row_count, scratch, small_or_shuffled, stream, text_array, text_bytes, written
from siftstone.llm.components import components, forest
from siftstone.llm.words import shingle_sets

#: Minhashes of a key.
HASHES = 3
#: Texts, and shingles, of one side of a tile: about so many at most.
PART, PART_SHINGLES = 1024, 1 << 20


def side_for(threshold: float, miss: float = 1e-4) -> int:
    """Keys a collection, so that a pair at the threshold shares no table with probability `miss` at most."""
    side = 1
    while 1 - (1 - (1 - threshold**HASHES) ** side) ** 2 > miss:
        side += 1
    return side


def least_agreement(threshold: float, n: int, miss: float = 1e-6) -> int:
    """Of n minhashes so many agree, but for a probability of `miss`, for a pair at the threshold."""
    below = 0.0
    for k in range(n + 1):
        below += np.exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(threshold) + (n - k) * log(1 - threshold))
        if below > miss:
            return k
    return n


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two columns."""
    return np.array([(mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) for s in sets], np.uint64).reshape(-1, 2).astype(np.int64)


def minhashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """`count` minhashes of each set, a row a set (zeros for empty ones)."""
    out = np.zeros((len(sets), count), np.uint64)
    real = [i for i, s in enumerate(sets) if len(s)]
    if not real:
        return out
    flat = np.concatenate([sets[i] for i in real])
    begin = np.cumsum([0, *(len(sets[i]) for i in real[:-1])])
    for k, (times, plus) in enumerate(zip(stream(31, count) | np.uint64(1), stream(37, count))):
        x = flat * times
        x += plus
        x ^= x >> np.uint64(32)
        out[real, k] = np.minimum.reduceat(x, begin)
    return out


SIGNATURES = "uid bigint, doc_id bigint, same bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>, low binary"


def signatures(docs: DataFrame, words: int, side: int) -> DataFrame:
    """A row a row of `docs`: uid, doc_id, same (hash of the text), n (distinct shingles), d1 and d2 (digest of the set), keys (of both collections, one after another; null if n = 0) and low (16 bits of every minhash)."""

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, uid = stream(43, 2 * side), TaskContext.get().partitionId() << 40
        for batch in incoming:
            texts = text_array(batch.column("text"))
            for i, j in batches(texts):
                sets = shingle_sets(*text_bytes(texts.slice(i, j - i)), words)
                least, digest = minhashes(sets, 2 * HASHES * side), digests(sets)
                keys = np.zeros((len(sets), 2 * side), np.uint64)
                for h in range(HASHES):
                    keys = mix(keys + least[:, h::HASHES] + salt)
                low = mix(least).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + j - i)),
                        batch.column("doc_id")[i:j].cast(pa.int64()),
                        batch.column("same")[i:j],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.array([k if len(s) else None for k, s in zip(keys.astype(np.int64).tolist(), sets)], pa.list_(pa.int64())),
                        pa.array([x.tobytes() if len(s) else None for x, s in zip(low, sets)], pa.binary()),
                    ],
                    names=[c.split()[0] for c in SIGNATURES.split(", ")],
                )
                uid += j - i
            give_back()

    return docs.select("doc_id", F.xxhash64("text").alias("same"), "text").mapInArrow(work, SIGNATURES)


def tables_of(texts: DataFrame, side: int) -> DataFrame:
    """(node, table, key) of every table that a text may share: pairs of those of its keys that another text has too."""
    keys = written(texts.select("node", F.posexplode("keys").alias("at", "key")), "keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    own = counted_join(keys, shared, ["key"], row_count(keys)).groupBy("node").agg(F.collect_list(F.struct("at", "key")).alias("k"))  # 2 * side at most
    first, second = F.filter("k", lambda x: x["at"] < side), F.filter("k", lambda x: x["at"] >= side)
    pairs = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.struct((a["at"] * side + b["at"] - side).alias("table"), F.xxhash64(a["key"], b["key"]).alias("key")))))
    return own.select("node", F.inline(pairs))


def sets_of(docs: DataFrame, texts: DataFrame, total: int, words: int) -> DataFrame:
    """(node, to, shingles) of the texts in `texts` (node, doc, d1, d2, to: `total` entries in all): one of the rows with that doc_id and that digest."""
    wanted = small_or_shuffled(texts.select("node", F.col("doc").alias("doc_id"), "d1", "d2", "to"), total)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id")

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            column, want = text_array(batch.column("text")), np.stack([batch.column(c).to_numpy() for c in ("d1", "d2")], axis=1)
            for i, j in batches(column):
                sets = shingle_sets(*text_bytes(column.slice(i, j - i)), words)
                hit = np.flatnonzero((digests(sets) == want[i:j]).all(1))
                sets = [sets[k] for k in hit.tolist()]
                size = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j].take(pa.array(hit)) for c in ("node", "to")), pa.LargeListArray.from_arrays(pa.array(size, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))], names=["node", "to", "shingles"])
            give_back()

    sets = written(own.mapInArrow(work, f"node bigint, to {texts.schema['to'].dataType.simpleString()}, shingles array<bigint>"), "sets")
    # More rows than texts only where rows repeat an id and its text.
    return sets if row_count(sets) <= row_count(texts) else written(sets.dropDuplicates(["node"]), "sets")


def with_sets(rows: DataFrame, total: int, docs: DataFrame, near: DataFrame, words: int) -> DataFrame:
    """`rows` (node, ...; `total` at most) with the shingles of their texts. A text is told first where its set goes, so sets move to their groups only."""
    to = rows.groupBy("node").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "node"])).alias("to"))
    texts = written(near.select("node", "doc", "d1", "d2").join(small_or_shuffled(to, total), "node"), "ends")
    return sets_of(docs, texts, total, words).select("node", F.inline("to"), "shingles")


def likely(pairs: DataFrame, hubs: DataFrame, near: DataFrame, percent: int, least: int) -> DataFrame:
    """(u, v, n, hub_n) of those stars (u, v) whose sizes and minhashes allow the similarity; n: shingles of v."""
    with_hub = counted_join(pairs, hubs, ["u"], row_count(pairs))
    both = with_hub.join(small_or_shuffled(near.select(F.col("node").alias("v"), "n", "low"), row_count(near)), "v")
    both = both.where(F.lit(100) * F.least("n", "hub_n") >= F.lit(percent) * F.greatest("n", "hub_n"))

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("low", "hub_low"))
                yield batch.filter(pa.array((a == b).sum(1) >= least)).select(["u", "v", "n"])

    return both.select("u", "v", "n", "low", "hub_low").mapInArrow(work, "u bigint, v bigint, n bigint")


def verified(pairs: DataFrame, docs: DataFrame, near: DataFrame, words: int, percent: int) -> DataFrame:
    """Those (u, v) of `pairs` (u, v, n) with 100 * intersection >= percent * union of full sets.

    A hub and a part of its neighbours are a group: a set of v moves once a pair, a hub's once a part.
    """
    total = pairs.agg(F.sum("n").alias("n")).first()["n"] or 0
    part = F.ceil(F.sum("n") / PART_SHINGLES)
    hubs = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("rows"), part.alias("parts"))
    dealt = counted_join(pairs, hubs, ["u"], row_count(pairs)).select("u", "v", F.pmod(F.xxhash64("v"), "parts").alias("part"))
    others = dealt.select(F.col("v").alias("node"), "u", "part", "v")
    own = hubs.select(F.col("u").alias("node"), "u", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("v"))
    # A hub has no more parts than neighbours.
    rows = with_sets(others.unionByName(own), 2 * row_count(pairs), docs, near, words).select("u", "part", "v", "shingles")

    def work(group: pa.Table) -> pa.Table:
        v, hub = group["v"].to_pylist(), group["u"][0].as_py()
        sets = [x.values.to_numpy() for x in group["shingles"]]
        if None not in v:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        own = sets[v.index(None)]
        linked = [x for x, s in zip(v, sets) if x is not None and 100 * (c := len(np.intersect1d(s, own, assume_unique=True))) >= percent * (len(s) + len(own) - c)]
        return pa.table({"u": pa.array([hub] * len(linked), pa.int64()), "v": pa.array(linked, pa.int64())})

    return bundled(rows, ["u", "part"], total // PART_SHINGLES, work, "u bigint, v bigint")


def common_counts(a: list[np.ndarray], b: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, as products of 0/1 matrices over the hashes in both."""
    ka, kb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    known = np.intersect1d(ka, kb)
    out = np.zeros((len(a), len(b)), np.float32)
    hit_a, hit_b = np.isin(ka, known), np.isin(kb, known)
    ca, cb, ra, rb = np.searchsorted(known, ka[hit_a]), np.searchsorted(known, kb[hit_b]), ra[hit_a], rb[hit_b]
    for s in range(0, len(known), block):
        x, y = np.zeros((len(a), block), np.float32), np.zeros((len(b), block), np.float32)
        i, j = (ca >= s) & (ca < s + block), (cb >= s) & (cb < s + block)
        x[ra[i], ca[i] - s] = 1
        y[rb[j], cb[j] - s] = 1
        out += x @ y.T
    return out.astype(np.int64)


TILE = ["key", "across", "p", "q"]


def tiles(members: DataFrame) -> DataFrame:
    """`members` (table, key, node, n, component) of tables with several components, once for each tile that they are in.

    A table's largest component is cut into parts, its other texts into others. Parts of the others meet each other and
    (across) all parts of the largest component, which need not meet among themselves: work grows with the others.
    """
    by = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    by = by.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("k", "component", "n")).alias("m"), F.sum("k").alias("rows"), F.sum("n").alias("n"))
    parts = lambda k, n: F.greatest(F.ceil(k / PART), F.ceil(n / PART_SHINGLES)).cast("bigint")
    # Two texts are a star, which has been compared.
    by = by.where("c > 1 AND rows > 2").select("key", "rows", F.col("m.component").alias("main"), parts(F.col("m.k"), F.col("m.n")).alias("main_parts"), parts(F.col("rows") - F.col("m.k"), F.col("n") - F.col("m.n")).alias("other_parts"))
    rows = counted_join(members, by, ["key"], row_count(members))
    is_main = F.col("component") == F.col("main")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.when(is_main, F.col("main_parts")).otherwise(F.col("other_parts"))))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    place = lambda across, p, q: F.struct(F.lit(across).alias("across"), p.alias("p"), q.alias("q"))
    own = F.transform(upto(F.col("other_parts")), lambda q: place(False, F.least("part", q), F.greatest("part", q)))
    over = F.transform(upto(F.col("main_parts")), lambda q: place(True, F.col("part"), q))
    main = F.transform(upto(F.col("other_parts")), lambda p: place(True, p, F.col("part")))
    return rows.select("table", "key", "node", "component", is_main.alias("main"), "part", F.inline(F.when(is_main, main).otherwise(F.concat(own, over))))


def sides(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a tile that meet: one side, the other, and whether both are the same part."""
    across, p, q = (tile[c][0].as_py() for c in ("across", "p", "q"))
    main, part = tile["main"].to_numpy(), tile["part"].to_numpy()
    if across:
        return np.flatnonzero(~main), np.flatnonzero(main), False
    return np.flatnonzero(part == p), np.flatnonzero(part == q), p == q


def near_in_tiles(dealt: DataFrame, near: DataFrame, side: int, percent: int, least: int) -> DataFrame:
    """Rows of `dealt` with a partner in their tile, of another component, that sizes and minhashes allow and whose first common table this is."""
    dealt = written(dealt, "dealt")
    rows = dealt.join(small_or_shuffled(near.select("node", "n", "keys", "low"), row_count(near)), "node")

    def work(tile: pa.Table) -> pa.Table:
        n, component = tile["n"].to_numpy(), tile["component"].to_numpy()
        low = np.frombuffer(b"".join(tile["low"].to_pylist()), np.uint16).reshape(len(n), -1)
        keys = tile["keys"].combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        a, b, same = sides(tile)
        first, second = divmod(tile["table"][0].as_py(), side)
        hit = np.zeros(len(n), bool)
        for s in range(0, len(a), 128):
            x = a[s : s + 128]
            ok = (component[x][:, None] != component[b][None, :]) & (100 * np.minimum(n[x][:, None], n[b][None, :]) >= percent * np.maximum(n[x][:, None], n[b][None, :]))
            if same:
                ok &= x[:, None] < b[None, :]
            i, j = np.nonzero(ok)
            i, j = x[i], b[j]
            for t in range(0, len(i), 1 << 16):
                u, v = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
                good = (low[u] == low[v]).sum(1) >= least
                u, v = u[good], v[good]
                equal = keys[u] == keys[v]
                good = (equal[:, :side].argmax(1) == first) & (equal[:, side:].argmax(1) == second)
                hit[u[good]] = hit[v[good]] = True
        return tile.filter(pa.array(hit)).select([*TILE, "node", "component", "main", "part", "n"])

    schema = "key bigint, across boolean, p bigint, q bigint, node bigint, component bigint, main boolean, part bigint, n bigint"
    return bundled(rows, TILE, row_count(dealt) // PART, work, schema)


def links_in_tiles(chosen: DataFrame, docs: DataFrame, near: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) between components: full sets are compared, tile by tile. A tile returns a spanning forest, at most a row a text."""
    rows, total = with_sets(chosen, row_count(chosen), docs, near, words), chosen.agg(F.sum("n").alias("n")).first()["n"]

    def work(tile: pa.Table) -> pa.Table:
        node, component = tile["node"].to_numpy(), tile["component"].to_numpy()
        sets = [x.values.to_numpy() for x in tile["shingles"]]
        size = np.array([len(x) for x in sets])
        a, b, _ = sides(tile)
        if not len(a) or not len(b):
            return pa.table({"u": node[:0], "v": node[:0]})
        common = common_counts([sets[i] for i in a], [sets[i] for i in b])
        i, j = np.nonzero((100 * common >= percent * (size[a][:, None] + size[b][None, :] - common)) & (component[a][:, None] != component[b][None, :]))
        root = forest(a[i], b[j], len(node))
        moved = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"u": node[moved], "v": node[root[moved]]})

    return bundled(rows, TILE, total // PART_SHINGLES, work, "u bigint, v bigint")


def written_alone(make, name: str) -> DataFrame:
    """`make()`, written; what was written on the way is deleted at once."""
    with scratch() as made:
        out = written(make(), name)
        made[:] = [t for t in made if t is not out]
    return out


def classified(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, same, n_shingles, component_id) a row of `docs`; what `near_duplicates` states."""
    side = side_for(percent / 100)
    least = least_agreement(percent / 100, 2 * HASHES * side)
    with scratch() as made:
        sigs = written(signatures(docs, words, side), "signatures")
        same = ["n", "d1", "d2"]
        real = sigs.where("n > 0 AND doc_id IS NOT NULL")
        texts = written(real.groupBy(*same).agg(F.min("uid").alias("node"), F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"), F.first("keys").alias("keys"), F.first("low").alias("low")), "texts")
        wide = sigs, texts
        sigs = written(sigs.select("doc_id", "same", *same), "rows")
        forget(wide[0])
        tables = written_alone(lambda: tables_of(texts, side), "tables")
        full = tables.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        members = written_alone(lambda: counted_join(tables, full, ["key"], row_count(tables)), "members")
        forget(tables)
        stars = written(members.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct(), "stars")
        ids = stars.select(F.col("u").alias("node")).union(stars.select("v")).distinct()
        near = written(texts.drop("rows").join(small_or_shuffled(ids, 2 * row_count(stars)), "node", "left_semi"), "near")
        texts = written(texts.drop("keys", "low"), "texts")
        forget(wide[1])
        hubs = stars.groupBy("u").agg(F.count(F.lit(1)).alias("rows")).join(near.select(F.col("node").alias("u"), F.col("n").alias("hub_n"), F.col("low").alias("hub_low")), "u")
        pairs = written(likely(stars, hubs, near, percent, least), "pairs")
        # Full sets are made of texts in likely pairs, and later of texts in likely pairs of tiles.
        links = written_alone(lambda: verified(pairs, docs, near, words, percent), "links")
        classes = written(components(links), "classes")
        placed = members.select("table", "key", "node").join(small_or_shuffled(near.select("node", "n"), row_count(near)), "node").join(small_or_shuffled(classes, row_count(classes)), "node", "left")
        placed = written(placed.withColumn("component", F.coalesce("component", "node")), "placed")
        chosen = written_alone(lambda: near_in_tiles(tiles(placed), near, side, percent, least), "chosen")
        if not chosen.isEmpty():
            more = written_alone(lambda: links_in_tiles(chosen, docs, near, words, percent), "links")
            classes = written(components(links.union(more)), "classes")
        # The least id of each component, to its texts, and of each text, to its rows; most rows have none but their own.
        least_doc = classes.join(near.select("node", "doc"), "node").groupBy("component").agg(F.min("doc").alias("least_doc"), F.count(F.lit(1)).alias("rows"))
        named = counted_join(classes, least_doc, ["component"], row_count(classes)).select("node", "least_doc")
        of_text = texts.where("rows > 1").select("node").union(named.select("node")).distinct().join(texts.select("node", "doc", *same, "rows"), "node").join(named, "node", "left")
        moved = of_text.select(*same, "rows", F.coalesce("least_doc", "doc").alias("component_id"))
        real = counted_join(sigs.where("n > 0 AND doc_id IS NOT NULL"), moved, same, row_count(sigs), "left")
        rest = sigs.where("n = 0 OR doc_id IS NULL").withColumn("component_id", F.lit(None).cast("bigint"))
        columns = ["doc_id", "same", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
        out = written(real.select(*columns).unionByName(rest.select(*columns)), "near_duplicates")
        made[:] = [t for t in made if t is not out]
    return out


def kept(rows: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents linked by word-shingle similarity (Jaccard) of percent / 100 or more.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; shingles are by 64-bit hash. With fewer
    words than a shingle has, the whole sequence is the one shingle. Returns a row a document: doc_id, n_shingles,
    component_id (least doc_id reachable by links, itself included), kept (doc_id = component_id).

    Texts that are null or without words have no shingles and link with nothing; null ids link with nothing and have a
    null component and kept true. Each row is a document: rows that repeat a doc_id with the same text get equal rows,
    with another text they are judged by their own text. A similarity of just the threshold links; there are no ties, as a
    component's id is a minimum. A very long text is hashed in stretches, but its shingles (8 bytes each) are in one
    task's memory. Other columns aren't read, whatever their names; an empty table gives no rows.
    """
    rows = classified(docs, words, percent)
    return rows.select("doc_id", "n_shingles", "component_id", kept(rows).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, without those that `near_duplicates` doesn't keep. Of rows that repeat a doc_id and its text one stays; rows that repeat an id with another text are judged by their own. Columns may have any names."""
    with scratch() as made:
        rows = classified(docs, words, percent)
        gone = written(rows.where(~kept(rows)).select("doc_id", "same").distinct(), "gone")
        again = written(rows.where("doc_id IS NOT NULL").groupBy("doc_id", "same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "same"), "again")
        made[:] = [t for t in made if t is not gone and t is not again]
    hashed = free_name(docs.columns, "text_hash")
    marked = docs.withColumn(hashed, F.xxhash64("text"))
    on = lambda t: [F.col(f"d.`doc_id`") == t["doc_id"], F.col(f"d.`{hashed}`") == t["same"]]
    left = marked.alias("d").join(small_or_shuffled(gone), on(gone), "left_anti")
    if again.isEmpty():
        return left.drop(hashed)
    some = small_or_shuffled(again)
    repeated = left.alias("d").join(some, on(again), "left_semi")
    return left.alias("d").join(some, on(again), "left_anti").unionByName(repeated.dropDuplicates(["doc_id", hashed])).drop(hashed)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM g),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.u),
c AS (SELECT u, min(c) AS component_id FROM r GROUP BY u)
SELECT g.doc_id, len(g.g) AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g JOIN c ON c.u = g.doc_id
"""
