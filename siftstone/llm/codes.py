"""Vector code compression: product codebooks by delta-maintained Lloyd rounds, in whole numbers.

Vectors are cut into parts, and each part's position has a codebook. A round assigns every part to its nearest entry and
writes the assignments beside the vectors. The entries' sums and counts run on from round to round: only parts whose
assignment changed since the round before send anything, minus to the old entry and plus to the new one, added up within
each partition, so what is shuffled is bounded by partitions times cells and falls as assignments settle. All sums are of
integers, so the order in which they are added doesn't matter, and a task that runs twice gives the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import counted_join, forget, give_back, row_count, written

#: Components beyond +-LIMIT count as LIMIT: squared distances of up to 512 components then stay below 2^63.
LIMIT = 1 << 26
#: Vectors whose distances are taken at once.
ROWS = 4096


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label (as text), v: floor(scale * x) of every component, of vectors without null and non-finite ones."""
    x = F.col("embedding")
    good = F.coalesce(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return vectors.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), whole.alias("v"))


def in_parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width) of lists; shorter ones end in zeros."""
    off = column.offsets.to_numpy()
    flat, size = column.values.to_numpy()[off[0] : off[-1]].astype(np.int64), np.diff(off)
    out = np.zeros((len(size), parts * width), np.int64)
    if len(size) and (size == parts * width).all():
        out[:] = flat.reshape(out.shape)
    else:
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out.reshape(len(size), parts, width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) index of the nearest entry, the lower one among equals, and each row's squared distances summed over parts. Exact."""
    code, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(x.shape[2], 1) < 1 << 53 else np.int64  # doubles hold such whole numbers exactly
    for p in range(x.shape[1]):
        part, book = x[:, p].astype(kind), books[p].astype(kind)
        d = (book * book).sum(1) - 2 * (part @ book.T)
        code[:, p] = best = d.argmin(1)
        error += ((part * part).sum(1) + d[np.arange(len(x)), best]).astype(np.int64)
    return code, error


def assigned(rows: DataFrame, books: np.ndarray, last: bool) -> DataFrame:
    """`rows` with their new `code`, the old one as `was`; last: code and error instead of vectors. Partitions stay as they are."""
    parts, _, width = books.shape

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                code, error = nearest(in_parts(some.column("v"), parts, width), books)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                head = [some.column("vec_id"), some.column("label")]
                if last:
                    yield pa.RecordBatch.from_arrays([*head, codes, pa.array(error)], names=["vec_id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([*head, some.column("v"), some.column("code"), codes], names=["vec_id", "label", "v", "was", "code"])
        give_back()

    return rows.mapInArrow(work, "vec_id bigint, label string, code binary, error bigint" if last else "vec_id bigint, label string, v array<int>, was binary, code binary")


def changes(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """(parts, entries, width + 1) of what the last round changes: each entry's sums and, last, its count.

    Only parts whose assignment changed count. A partition sends its cells that aren't 0; Spark sums them by cell, and no
    more than all cells reach the driver.
    """

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in incoming:
            x = in_parts(batch.column("v"), parts, width)
            new = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            was = batch.column("was")
            old = np.frombuffer(b"".join(was.fill_null(bytes(parts)).to_pylist()), np.uint8).reshape(-1, parts)
            first = ~was.is_valid().to_numpy(zero_copy_only=False)
            for p in range(parts):
                moved = (new[:, p] != old[:, p]) | first
                for sign, code, at in ((1, new, moved), (-1, old, moved & ~first)):
                    c = code[at, p]
                    total[p, :, width] += sign * np.bincount(c, minlength=entries)
                    for j in range(width):
                        np.add.at(total[p, :, j], c, sign * x[at, p, j])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "s"])

    moved = rows.where("was IS NULL OR was <> code").select("v", "was", "code")
    sums = moved.mapInArrow(work, "cell bigint, s bigint").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(parts * entries * (width + 1), np.int64)
    out[sums["cell"].to_numpy()] = sums["s"].to_numpy()
    return out.reshape(parts, entries, width + 1)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (parts, entries, width) that they are of.

    vectors: vec_id, embedding (array of numbers), label; other columns aren't read. Rows: vec_id, label (as text), code (a
    byte a part), error (squared distances summed over parts). Vectors that are null or hold null or non-finite components
    are left out. A component is floor(scale * x), at most LIMIT either way. A vector shorter than the longest (rounded up
    to a multiple of `parts`) counts as if zeros followed, an empty one as zeros. Codebooks start as the parts of the
    vectors first by vec_id (null ids last; repeated ids by components, each a row of its own); of fewer than `entries`
    vectors all. Ties go to the lower entry; entries without parts stay. An empty table gives no rows and empty codebooks.
    Codebooks and running sums (parts * entries * width numbers) are all that the driver holds.
    """
    assert 1 <= entries <= 256
    rows = written(whole_vectors(vectors, scale), "vectors")
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow().combine_chunks()["v"]
    start = pa.concat_arrays(start.chunks) if start.num_chunks else pa.array([], pa.list_(pa.int32()))
    books = in_parts(start, parts, width).transpose(1, 0, 2).copy()
    rows_now = rows.withColumn("code", F.lit(None).cast("binary"))
    if len(start):
        total = np.zeros((parts, len(start), width + 1), np.int64)
        for k in range(rounds):
            new = written(assigned(rows_now, books, last=False), f"round{k}")
            forget(rows)
            total += changes(new, parts, len(start), width)
            used = total[:, :, width] > 0
            books[used] = total[:, :, :width][used] // total[:, :, width:][used]
            rows = rows_now = new
    coded = written(assigned(rows_now, books, last=True), "codes") if len(start) else rows_now.select("vec_id", "label", "code", F.lit(0).cast("bigint").alias("error"))
    return coded, books


def label_errors(coded: DataFrame) -> DataFrame:
    """`coded` with label_error: errors summed over rows of the same label, null labels together."""
    keyed = coded.select("vec_id", "label", "code", "error", F.coalesce("label", F.lit("")).alias("l"), F.col("label").isNull().alias("none"))
    side = keyed.groupBy("l", "none").agg(F.count(F.lit(1)).alias("rows"), F.sum("error").alias("label_error"))
    return counted_join(keyed, side, ["l", "none"], row_count(coded)).drop("l", "none")


def code_table(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of `compress`."""
    coded, books = compress(vectors, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return label_errors(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assign_sql(rows: str, book: str) -> str:
    d = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT vec_id, label, p, x, m % 256 AS e, m // 256 AS d FROM (SELECT vec_id, any_value(label) AS label, r.p, any_value(x) AS x, min(CAST({d} AS BIGINT) * 256 + e) AS m FROM {rows} r JOIN {book} b ON b.p = r.p GROUP BY vec_id, r.p)"


def _book_sql(rows: str, book: str) -> str:
    sums = f"SELECT p, e, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, 5)) AS j FROM {rows}) GROUP BY p, e, j"
    floors = f"SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM ({sums}) GROUP BY p, e"
    return f"SELECT b.p, b.e, coalesce(f.c, b.c) AS c FROM {book} b LEFT JOIN ({floors}) f ON f.p = b.p AND f.e = b.e"


#: Of vectors of 64 components and distinct vec_ids, as the tables have.
ORACLE = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS MATERIALIZED (SELECT vec_id, label, p, v[p * 4 + 1:p * 4 + 4] AS x FROM (SELECT vec_id, label, v, unnest(range(0, 16)) AS p FROM k)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM r QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 64),
a1 AS MATERIALIZED ({_assign_sql("r", "b0")}),
b1 AS MATERIALIZED ({_book_sql("a1", "b0")}),
a2 AS MATERIALIZED ({_assign_sql("r", "b1")}),
b2 AS MATERIALIZED ({_book_sql("a2", "b1")}),
a3 AS MATERIALIZED ({_assign_sql("r", "b2")}),
o AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o, s
"""
