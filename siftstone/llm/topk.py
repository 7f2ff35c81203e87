"""Exact top-k inner products over integer vectors, longest first.

The longest vectors give every query a first threshold. The others lie in blocks by falling length; a block of
queries meets a block of vectors, as a tile, unless the lengths' product cannot reach any threshold there. In a tile,
vectors are taken by falling length; sums over the leading directions of an SVD come first, the rest is bounded by
Cauchy-Schwarz, and only pairs that can still enter a query's list are multiplied out, exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import written
from siftstone.llm.vectors import finite, in_blocks, matrix, rotations

#: Vectors that give first thresholds (broadcast); rows of a block of queries, of vectors, and of one step in a tile.
SEEDS, QUERIES, VECTORS, STEP = 2048, 2048, 8192, 1024
LEADING = 16


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each query's k first by (falling score, vec)."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def search(q: np.ndarray, q_ids: np.ndarray, at_least: np.ndarray, c: np.ndarray, c_ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, vec_id, score) of the vectors that can be in a query's list: k a query at most, none below its threshold."""
    order = np.argsort(-np.linalg.norm(c, axis=1), kind="stable")
    c, c_ids = c[order], c_ids[order]
    lead = min(LEADING, turn.shape[1])
    rq, rc = q @ turn, c @ turn
    tq, tc = np.linalg.norm(rq[:, lead:], axis=1), np.linalg.norm(rc[:, lead:], axis=1)
    nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    at_least = at_least.astype(np.float64)
    qi, ci, qc = q.astype(np.int64), c.astype(np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # Sums of products below 2^53 are exact in doubles.
    exact = float(nq.max(initial=0)) * float(nc.max(initial=0)) < 2**52
    for s in range(0, len(c), STEP):
        e = min(s + STEP, len(c))
        slack = 1e-6 * (1 + nq * nc[s])
        alive = np.flatnonzero(nq * nc[s] >= at_least - slack)
        if not len(alive):
            break
        bound = rq[alive, :lead] @ rc[s:e, :lead].T + tq[alive, None] * tc[None, s:e]
        i, j = np.nonzero(bound >= (at_least - slack)[alive, None])
        if exact and len(i) > 0.1 * bound.size:
            score = (q[alive] @ c[s:e].T)[i, j].astype(np.int64)
        else:
            score = np.concatenate([np.einsum("ij,ij->i", qi[alive[i[a : a + 65536]]], ci[s + j[a : a + 65536]]) for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0, np.int64)
        i, j = alive[i], s + j
        ok = (score >= at_least[i]) & (q_ids[i] != c_ids[j])
        new = [np.concatenate(x) for x in zip(qc, (i[ok], c_ids[j[ok]], score[ok]))]
        keep = best(*new, k)
        qc = tuple(x[keep] for x in new)
        n = np.bincount(qc[0], minlength=len(q))
        last = np.full(len(q), -np.inf)
        full = n >= k
        if full.any():
            kth = np.flatnonzero(np.append(qc[0][1:] != qc[0][:-1], True))  # a query's last row is its least
            last[qc[0][kth]] = qc[2][kth]
            at_least = np.where(full, np.maximum(at_least, last), at_least)
    return qc


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """The k rows of `vectors` with the greatest inner product with each query, in integers floor(scale * x).

    Both: vec_id, embedding. A query's own vec_id is not a candidate; ties go to the smaller vec_id. Returns query_id,
    rank (from 1), vec_id, score; fewer rows where there are fewer candidates. Vectors that are null, empty, or hold nulls
    or non-finite numbers take no part, nor do null ids; a query meets only vectors of its own length. Rows of `vectors`
    that repeat an id are candidates each; queries that repeat one are one query (the least vector in order). Inner
    products must fit 64 bits. Other columns aren't read; empty tables give no rows.
    """
    spark = vectors.sparkSession
    valid = lambda t: t.select("vec_id", F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & finite("v")).withColumn("dim", F.size("v"))
    rows = valid(vectors).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(scale) * x.cast("double")).cast("double"), F.lit(2)))))
    turns = rotations(rows, lambda x: whole(x, scale))
    seeds = rows.orderBy(F.desc("length"), "vec_id").limit(SEEDS).toArrow()
    by_dim = {}
    for d in set(seeds["dim"].to_pylist()):
        part = seeds.filter(pa.compute.equal(seeds["dim"], d))
        by_dim[d] = (whole(matrix(part["v"]), scale), part["vec_id"].to_numpy())
    shared = spark.sparkContext.broadcast((turns, by_dim))
    asked = valid(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

    def threshold(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, by_dim = shared.value
        for batch in incoming:
            dims, ids = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy()
            least, length = np.full(len(ids), -(1 << 62)), np.zeros(len(ids))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for part in np.array_split(at, -(-len(at) // STEP)):
                    q = whole(matrix(batch.column("v").take(pa.array(part))), scale)
                    length[part] = np.linalg.norm(q, axis=1)
                    if d in by_dim:
                        c, c_ids = by_dim[d]
                        i, _, score = search(q, ids[part], np.full(len(part), -(1 << 62)), c, c_ids, turns[d], k)
                        n = np.bincount(i, minlength=len(part))
                        low = np.full(len(part), 1 << 62)
                        np.minimum.at(low, i, score)
                        least[part] = np.where(n >= k, low, least[part])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), pa.array(length)], names=[*batch.schema.names, "least", "q_length"])

    kinds = dict(rows.dtypes)
    asked = written(asked.select("vec_id", "dim", "v").mapInArrow(threshold, f"vec_id {kinds['vec_id']}, dim int, v {dict(asked.dtypes)['v']}, least bigint, q_length double"), "queries")
    q_blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)))
    blocks = written(in_blocks(rows.withColumn("fall", -F.log2(F.greatest("length", F.lit(1e-3)))), ["dim"], "fall", 0.01, VECTORS, "vec_id").select("dim", "block", "vec_id", "v", "length"), "lengths")
    longest = blocks.groupBy("dim", "block").agg(F.max("length").alias("c_length"))
    needs = asked.groupBy("dim", "qb").agg(F.max(F.col("q_length")).alias("q_length"), F.min("least").alias("least"))
    tiles = needs.join(longest, "dim").where(F.col("q_length") * F.col("c_length") * (1 + 1e-6) + 1e-3 >= F.col("least")).select("dim", "qb", "block")
    side = lambda t, cols, query: t.join(tiles, cols).select("dim", "qb", "block", F.lit(query).alias("is_query"), "vec_id", F.col("v").cast("array<double>").alias("v"), (F.col("least") if query else F.lit(0).cast("bigint")).alias("least"))
    dealt = side(asked, ["dim", "qb"], True).union(side(blocks, ["dim", "block"], False))

    def compare(key, tile):
        is_query = tile["is_query"].to_numpy()
        x, ids, least = whole(matrix(tile["v"]), scale), tile["vec_id"].to_numpy(), tile["least"].to_numpy()
        i, vec, score = search(x[is_query], ids[is_query], least[is_query], x[~is_query], ids[~is_query], shared.value[0][key[0].as_py()], k)
        return pa.table({"query_id": ids[is_query][i].astype(np.int64), "vec_id": vec.astype(np.int64), "score": score.astype(np.int64)})

    found = dealt.groupBy("dim", "qb", "block").applyInArrow(compare, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
