"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are turned to principal directions. Blocks of a label's vectors lie along the first of these; two blocks are
compared, as a tile, unless their ranges there are too far apart for any link. In a tile, leading dimensions are
multiplied first; what the rest can add is bounded by the product of suffix norms, and a pair is dropped as soon as
that cannot reach the threshold. Survivors are decided by the cosine of the vectors as given, in double precision.
Copies are compared once and counted; a tile returns counts and a spanning forest, never all its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import forget, written
from siftstone.llm.components import components, forest
from siftstone.llm.vectors import finite, in_blocks, matrix, rotations

#: Vectors of a block; a tile holds two.
BLOCK = 1536
STEPS = (8, 16, 32)
SLACK = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_pairs(x: np.ndarray, y: np.ndarray, turn: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of pairs with cosine >= least; same: y is x, and only i < j count."""
    ux, uy = units(x), units(y)
    rx, ry = ux @ turn, uy @ turn
    cuts = [k for k in STEPS if k < x.shape[1]]
    rest = lambda r, k: np.sqrt(np.maximum((r[:, k:] ** 2).sum(1), 0))
    if cuts:
        k = cuts[0]
        part = rx[:, :k] @ ry[:, :k].T
        keep = part + rest(rx, k)[:, None] * rest(ry, k)[None, :] >= least - SLACK
    else:
        part, keep, k = None, np.ones((len(x), len(y)), bool), 0
    if same:
        keep = np.triu(keep, 1)
    i, j = np.nonzero(keep)
    if len(i) > 0.05 * keep.size:  # nearly all alike: whole products are cheaper than gathering pairs
        full = np.where(keep, ux @ uy.T, -2)
        i, j = np.nonzero(full >= least - SLACK)
    else:
        total = part[i, j] if part is not None else np.zeros(len(i))
        for a, b in zip(cuts, [*cuts[1:], x.shape[1]]):
            total = total + np.einsum("ij,ij->i", rx[i, a:b], ry[j, a:b])
            ok = total + rest(rx, b)[i] * rest(ry, b)[j] >= least - SLACK
            i, j, total = i[ok], j[ok], total[ok]
    ok = np.concatenate([np.einsum("ij,ij->i", ux[i[s : s + 65536]], uy[j[s : s + 65536]]) >= least for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
    return i[ok], j[ok]


def similar_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Classes of vectors of one (not null) label linked by cosine of `least` or more.

    vectors: vec_id, embedding (array of numbers), label. Returns a row a row: vec_id, n_links (other vectors linked
    directly), component_id (least vec_id reachable, itself included), kept (vec_id = component_id). Vectors that are
    null, empty, zero, or hold nulls or non-finite numbers, and those with a null label or vec_id, link with nothing;
    nor do vectors of unlike length link. Rows that repeat a vec_id with the same vector are one vector. Other columns
    aren't read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0)
    marked = rows.withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("v", F.when(F.col("ok"), F.col("v"))).withColumn("dim", F.size("v")).withColumn("d1", F.xxhash64("v")).withColumn("d2", F.xxhash64(F.lit(7), "v"))
    marked = marked.select("vec_id", "label", "ok", "dim", "d1", "d2", "v")
    same = ["label", "dim", "d1", "d2"]
    once = marked.where("ok").groupBy("vec_id", *same).agg(F.first("v").alias("v"))
    texts = written(once.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "vectors")
    turns = rotations(texts, units)
    shared = spark.sparkContext.broadcast(turns)

    def first_coordinate(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            dims, out = batch.column("dim").to_numpy(), np.zeros(batch.num_rows)
            for d in np.unique(dims).tolist():
                out[dims == d] = units(matrix(batch.column("v").filter(pa.array(dims == d)))) @ shared.value[d][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "c"])

    kinds = dict(texts.dtypes)
    names = ["rep", "label", "dim", "copies", "v"]
    placed = texts.select(*names).mapInArrow(first_coordinate, ", ".join(f"{n} {kinds[n]}" for n in names) + ", c double")
    blocks = written(in_blocks(placed, ["label", "dim"], "c", 0.01, BLOCK, "rep"), "blocks")
    range_of = blocks.groupBy("label", "dim", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    left = range_of.select("label", "dim", F.col("block").alias("b1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    right = range_of.select("label", "dim", F.col("block").alias("b2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    reach = float(np.sqrt(max(2 - 2 * least, 0))) + 1e-6
    # Blocks, not vectors: unit vectors further apart than `reach` in any one direction have a lesser cosine.
    tiles = left.join(right, ["label", "dim"]).where((F.col("b1") <= F.col("b2")) & (F.col("lo2") - F.col("hi1") <= reach) & (F.col("lo1") - F.col("hi2") <= reach)).select("label", "dim", "b1", "b2")
    sides = tiles.select("label", "dim", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    dealt = blocks.join(sides, ["label", "dim", "block"]).select("label", "dim", "b1", "b2", "block", "rep", "copies", "v")

    def compare(key, tile):
        dim, b1, b2 = (k.as_py() for k in key[1:])
        block, rep, copies = (tile[c].to_numpy() for c in ("block", "rep", "copies"))
        x = matrix(tile["v"])
        a, b = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
        i, j = linked_pairs(x[a], x[b], shared.value[dim], least, b1 == b2)
        i, j = a[i], b[j]
        n = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        order = np.argsort(rep)
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))
        root = order[forest(rank[i], rank[j], len(rep))[rank]]
        hit = np.flatnonzero(n)
        return pa.table({"rep": rep[hit], "n": n[hit].astype(np.int64), "root": rep[root[hit]]})

    found = written(dealt.groupBy("label", "dim", "b1", "b2").applyInArrow(compare, f"rep {kinds['rep']}, n bigint, root {kinds['rep']}"), "links")
    forget(blocks)
    named = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n")).select(F.col("rep").alias("c_rep"), "n")
    classes = texts.select("rep", "copies", *[F.col(c).alias(f"t_{c}") for c in same]).join(counts, F.col("rep") == F.col("c_rep"), "left").join(named, F.col("rep") == F.col("node"), "left")
    classes = classes.select(*[f"t_{c}" for c in same], (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("least_id"))
    out = marked.drop("v").join(classes, [F.col(c) == F.col(f"t_{c}") for c in same] + [F.col("ok")], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least_id", "vec_id").cast("bigint").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding FROM embeddings),
g AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM e
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
r AS (SELECT vec_id AS u, vec_id AS c FROM e UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.u),
c AS (SELECT u, min(c) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
