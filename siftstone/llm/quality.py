"""Quality by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents gives a latent-semantic space (SVD of tf-idf over hashed byte trigrams and
a few binned shape statistics) and the neighbours. Their vectors are broadcast; every document's cosines with all of
them are exact, in blocks, and its nearest neighbours vote with weights that rise with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import batches, give_back, held_out, text_array, text_bytes
from siftstone.llm.words import bounds, hashes

TRIGRAMS = 2048
#: Statistics of a text, each as one of 16 bins: distinct words, repeats of the word before, capitals, marks, digits, spaces, word length.
STATS, BINS = 7, 16
WIDTH = TRIGRAMS + STATS * BINS
#: Documents whose features (WIDTH numbers each) are held at once.
ROWS = 1024
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams and binned statistics, one float32 row a document."""
    n, size = len(off) - 1, np.diff(off)
    out = np.zeros((n, WIDTH), np.float32)
    if len(raw) >= 3:
        wide = raw.astype(np.uint32)
        slot = ((wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA6B) ^ wide[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(13)) % np.uint32(TRIGRAMS)
        doc = np.repeat(np.arange(n, dtype=np.int64), size)
        inside = doc[:-2] == doc[2:]
        out[:, :TRIGRAMS] = np.bincount((doc[:-2] * TRIGRAMS + slot)[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    starts, ends, first = bounds(raw, off)
    h, words = hashes(raw, starts, ends), np.maximum(np.diff(first), 1)
    doc = np.repeat(np.arange(n), np.diff(first))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    part = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit)))[off]) / np.maximum(size, 1)
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())])
    mark = ((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))
    shares = [distinct / words, np.bincount(doc, again, n) / words, part((raw >= 65) & (raw <= 90)), part(mark), part((raw >= 48) & (raw <= 57)), part(raw == 32), np.minimum(np.bincount(doc, ends - starts, n) / words / 32, 1)]
    for k, x in enumerate(shares):
        out[np.arange(n), TRIGRAMS + k * BINS + np.minimum(np.sqrt(x) * BINS, BINS - 1).astype(np.int64)] = 40
    out[size == 0] = 0
    return out


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float64) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, keep) -> DataFrame:
    """(doc_id, y, text) of at most `most` documents a class (0, 1): those of least sha2(doc_id), of all labelled ones.

    Rows of `labels` that `keep` (a column) excludes, and null labels, are not used; of several labels the greatest counts, and of
    several texts of an id the least, so no more rows than ids come.
    """
    known = labels.where(keep & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).alias("y"))
    pick = [known.where(F.col("y") == y).orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(most) for y in (0, 1)]
    chosen = pick[0].union(pick[1]).select(F.col("doc_id").alias("__id"), F.col("y").cast("int").alias("y"))
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit(sample: DataFrame, shares: dict[int, int], rank: int) -> dict[str, np.ndarray]:
    """Projection, neighbours, their labels and class weights, from the bounded sample."""

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            texts = text_array(batch.column("text"))
            for a, b in batches(texts):
                x = features(*text_bytes(texts.slice(a, b - a))).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), batch.column("y")[a:b], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    got = sample.mapInArrow(work, "doc_id bigint, y int, x binary").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(np.float64)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.uint16).reshape(-1, WIDTH).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1
    x = weighed(x, idf)
    values, vectors = np.linalg.eigh(x.T @ x)
    basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank])
    near = x @ basis
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-12)
    each = np.array([shares.get(c, 0) / max((y == c).sum(), 1) for c in (0, 1)])
    return {"idf": idf, "basis": basis, "near": near, "y": y, "weight": each[y.astype(int)] if len(y) else y, "prior": np.array(shares.get(1, 0) / max(sum(shares.values()), 1) if shares else 0.5)}


def vote(model: dict[str, np.ndarray], raw: np.ndarray, off: np.ndarray, k: int, power: float, smooth: float = 1e-3) -> np.ndarray:
    """Share of the nearest neighbours' similarity that stands for label 1."""
    z = weighed(features(raw, off), model["idf"]) @ model["basis"]
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    k = min(k, len(model["y"]))
    if not k:
        return np.full(len(z), float(model["prior"]))
    cosine = z @ model["near"].T
    # Rounded, so that the shape of a batch doesn't decide between neighbours alike; among these the smaller doc_id counts.
    at = np.argsort(-np.round(cosine, 9), axis=1, kind="stable")[:, :k]
    w = np.maximum(np.take_along_axis(cosine, at, 1), 0).astype(np.float64) ** power * model["weight"][at]
    return ((w * model["y"][at]).sum(1) + smooth * model["prior"]) / (w.sum(1) + smooth)


def score_quality(docs: DataFrame, labels: DataFrame, sample_a_class: int = 2000, rank: int = 64, k: int = 25, power: float = 20.0) -> DataFrame:
    """Quality of every whole text, learnt from labels.quality of documents whose crc32(doc_id as text) mod 3 is not 1.

    sample_a_class bounds the labelled documents a class that are learnt from and broadcast (rank floats each); votes
    are weighted back to the classes' shares among all labels. Returns doc_id, held_out, score (0 to 1), predicted.
    Null or empty texts, and all texts where there are no labels, get the share of label 1 (0.5 without labels). Null ids
    are not held out. Each row has its own result, whatever stands beside it; neighbours at equal cosine count by smaller doc_id. A very
    long text is read in one piece by one task; other columns aren't read; empty tables give no rows.
    """
    spark = docs.sparkSession
    keep = ~held_out("doc_id", 3, 1)
    shares = {int(r["quality"]): r["n"] for r in labels.where(keep & F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, "quality", sample_a_class, keep), shares, rank))

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            texts = text_array(batch.column("text"))
            for a, b in batches(texts, rows=ROWS):
                score = np.clip(vote(model.value, *text_bytes(texts.slice(a, b - a)), k, power), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), batch.column("held_out")[a:b], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
            give_back()

    return docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text").mapInArrow(work, SCHEMA)
