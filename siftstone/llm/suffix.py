"""Exact removal of passages that an earlier document holds, by bucket-pointer refinement of suffix buckets.

1. Every 50-byte string has an anchor, the least hash of its 20-byte grams, so equal strings have equal anchors. Anchors
   (one for about 16 bytes) go, in blobs, to hash ranges, where those of several documents are told apart from the rest.
2. Documents meet their shared anchors again. What stands around a shared anchor (all 50-byte strings with it) is a
   span. Spans that are equal byte for byte within a group are combined before they move: the first goes on, and later
   documents' are marked, as the first document holds them.
3. In each hash range, all places of all spans go into suffix buckets, first by 8-byte grams; unresolved buckets are
   refined by the bucket pointers of later offsets, new pointers serving at once, until 50 bytes are settled. Strings
   that start in a document with a smaller doc_id are marked.
4. Documents meet their marks and are cut.

Hashes only decide what is compared; equality is decided on bytes. Groups are hash ranges of texts or of spans, of about
GROUP_BYTES of text, or as many as spark.sql.shuffle.partitions if that is more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import batches, conf_int, forget, give_back, mix, small_or_shuffled, stream, text_array, text_bytes, written
from siftstone.llm.words import SPAN, powers

GRAM = 20
#: Strings of a span at most; a longer run with one anchor is several spans.
LONGEST = 256
_RANDOM = stream(41, 256)
#: Text whose anchors are found at once (arrays of eight bytes a byte), and text whose anchors leave together.
AT_ONCE, TOGETHER = 1 << 19, 4 << 20
#: Places whose buckets are refined at once; text of a group and of a task, about, where there is more than shuffle partitions make of it.
BUCKETS, GROUP_BYTES, TASK_BYTES = 1 << 16, 16 << 20, 256 << 20
#: Rows between steps: packed blobs of document ids and of what belongs to each, by group.
PARTS = "key bigint, docs binary, hashes binary, starts binary, sizes binary, data binary"
EMPTY = np.zeros(0, np.int64)
#: In place of a document's id: several documents of a batch, or a null id.
NO_ID = np.iinfo(np.int64).min


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of `length` bytes with one anchor: (anchor, document, first byte within it, number of strings)."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), EMPTY, EMPTY, EMPTY
    power, inverse = powers()
    least = np.zeros(len(raw) - GRAM + 1, np.uint64)
    for a in range(0, len(least), SPAN - GRAM + 1):
        part = raw[a : a + SPAN]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_RANDOM[part] * power[: len(part)], out=sums[1:])
        least[a : a + len(part) - GRAM + 1] = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(part) - GRAM + 1])
    width = 1
    while 2 * width <= length - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := length - GRAM + 1 - width:
        least = np.minimum(least[:-rest], least[rest:])
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    valid = np.zeros(n + 1, np.int8)
    whole = np.diff(off) >= length
    begin, end = off[:-1][whole], off[1:][whole] - length + 1
    np.add.at(valid, begin, 1)
    np.add.at(valid, end, -1)
    inside = np.cumsum(valid[:-1]) > 0
    new[begin] = True
    first = np.flatnonzero(new & inside)
    bound = np.append(first, n)[1:]
    doc = np.searchsorted(off, first, "right") - 1
    strings = np.minimum(bound, off[doc + 1] - length + 1) - first
    # One word again and again has one anchor throughout; in short pieces, most of it is the same piece.
    pieces = -(-strings // LONGEST)
    skip = LONGEST * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    doc, start = np.repeat(doc, pieces), np.repeat(first - off[doc], pieces) + skip
    return np.repeat(least[first], pieces), doc, start, np.minimum(np.repeat(strings, pieces) - skip, LONGEST)


def ranges(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Hash range (0 to groups - 1) of each anchor: of its own hash, as anchors, being minima, crowd at the low end."""
    return (((mix(hashes.astype(np.uint64)) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def home(doc: np.ndarray, homes: int) -> np.ndarray:
    """Group of a document; the same as `home_column`."""
    return (doc + (doc >> 16)) % homes


def squeeze(x: np.ndarray) -> bytes:
    """Integers as packed bytes: the first bytes of all, then the second, and so on, compressed."""
    width = x.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unsqueeze(data: bytes, kind=np.int64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T.tobytes(), kind)


def blobs(key: np.ndarray, docs: np.ndarray, hashes=None, starts=None, sizes=None, pieces: list[bytes] | None = None) -> list[tuple]:
    """One row a key from parallel arrays (pieces: byte strings)."""
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order], prepend=-(1 << 62))).tolist()
    columns = [x[order] if x is not None else None for x in (docs, hashes, starts, sizes)]
    out, place = [], order.tolist() if pieces is not None else []
    for a, b in zip(cut, [*cut[1:], len(key)]):
        data = zstandard.compress(b"".join([pieces[i] for i in place[a:b]]), 3) if pieces is not None else None
        out.append((int(key[order[a]]), *(None if x is None else squeeze(x[a:b]) for x in columns), data))
    return out


def table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), *[pa.binary()] * 5)
    names = ("key", "docs", "hashes", "starts", "sizes", "data")
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def joined(column: pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unsqueeze(x, kind) for x in column.to_pylist() if x is not None)])


def marks_to_home(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, homes: int, negative: bool) -> list[tuple]:
    key = home(docs, homes)
    return blobs(-1 - key if negative else key, docs, None, starts, ends)


def all_anchors(texts: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """`anchors` of all texts, a stretch at a time; with 48 bits of each anchor."""
    parts = []
    for a, b in batches(texts, AT_ONCE):
        h, doc, start, strings = anchors(*text_bytes(texts.slice(a, b - a)), length)
        parts.append((h >> np.uint64(16), doc + a, start, strings))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), EMPTY, EMPTY, EMPTY)


def send_anchors(groups: int, homes: int, length: int):
    """Step 1, per batch: distinct anchors by hash range. Those of several documents of the batch are known to be shared (NO_ID)."""

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            texts, ids = text_array(batch.column("text")), batch.column("row").to_numpy()
            for a, b in batches(texts, TOGETHER):
                h, doc, _, _ = all_anchors(texts.slice(a, b - a), length)
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[new], ids[a:b][doc[new]]
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                times = np.diff(np.append(np.flatnonzero(first), len(h)))
                several = np.repeat(times > 1, times)
                asked, least = np.where(several, NO_ID, doc)[first], h[first]
                key = ranges(least, groups)
                order = np.argsort(key, kind="stable")
                key, asked, least = key[order], asked[order], least[order]
                # Sorted within a range, so the steps from one to the next are short.
                step, start = np.diff(least, prepend=np.uint64(0)), np.flatnonzero(np.diff(key, prepend=-1))
                step[start] = least[start]
                yield from table([*blobs(key, asked, step), *blobs(-1 - home(doc[several], homes), doc[several], h[several])]).to_batches()
            give_back()

    return work


def find_shared(homes: int):
    """Step 1, per hash range: anchors of several documents, to those documents."""

    def work(key, part):
        if key[0].as_py() < 0:
            return table([(-1 - key[0].as_py(), squeeze(joined(part["docs"])), squeeze(joined(part["hashes"])), None, None, None)])
        doc = joined(part["docs"])
        h = np.concatenate([np.cumsum(unsqueeze(x, np.uint64)) for x in part["hashes"].to_pylist()])
        order = np.argsort(h, kind="stable")
        doc, h = doc[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        times = np.diff(np.append(np.flatnonzero(first), len(h)))
        # A document alone in the batch that asks; others in other batches, or several in one, settled already.
        tell = np.repeat(times > 1, times) & (doc != NO_ID)
        return table(blobs(home(doc[tell], homes), doc[tell], h[tell]))

    return work


def send_spans(groups: int, homes: int, length: int, shift: int):
    """Step 2, per group of documents: spans about shared anchors, each distinct one once, with its least document."""

    def work(key, docs, hits):
        if not hits.num_rows or not docs.num_rows:
            return table([])
        docs = docs.filter(docs["row"].is_valid()).sort_by("row")
        texts, ids = text_array(docs["text"]), docs["row"].to_numpy()
        asked = np.sort(mix(joined(hits["hashes"], np.uint64)) + joined(hits["docs"]).astype(np.uint64))
        seen: dict[bytes, int] = {}
        sent, pieces, settled = [(EMPTY, np.zeros(0, np.uint64), EMPTY, EMPTY)], [], [(EMPTY, EMPTY, EMPTY)]
        for a, b in batches(texts, AT_ONCE):
            raw, off = text_bytes(texts.slice(a, b - a))
            h, doc, start, strings = anchors(raw, off, length)
            h = h >> np.uint64(16)
            own = ids[a:b][doc]
            wanted = mix(h) + own.astype(np.uint64)
            hit = asked[np.minimum(np.searchsorted(asked, wanted), len(asked) - 1)] == wanted
            h, own, start, size, begin = h[hit], own[hit], start[hit], strings[hit] + length - 1, (off[doc] + start)[hit]
            data, fresh = raw.tobytes(), np.ones(len(h), bool)
            for i, (x, y, d) in enumerate(zip(begin.tolist(), (begin + size).tolist(), own.tolist())):
                if seen.setdefault(span := data[x:y], d) >> shift == d >> shift:
                    pieces.append(span)
                else:
                    fresh[i] = False
            sent.append((own[fresh], h[fresh], start[fresh], size[fresh]))
            settled.append((own[~fresh], start[~fresh], (start + size)[~fresh]))
        own, h, start, size = (np.concatenate(x) for x in zip(*sent))
        rows = blobs(ranges(h, groups), own, h.astype(np.uint32), start, size, pieces)
        del seen, pieces, docs, texts
        give_back()
        return table(rows + marks_to_home(*(np.concatenate(x) for x in zip(*settled)), homes, negative=True))

    return work


def string_buckets(data: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Class (from 1) of the `length` bytes from each place of the spans that lie in `data` one after another; 0 where less is left.

    Bucket-pointer refinement. Places are sorted into buckets by their first eight bytes; a place's pointer is its
    bucket's first rank. A bucket that isn't resolved (several places, known to agree in `depth` bytes, fewer than `length`) is
    sorted by the pointers `depth` bytes on, and falls into buckets that agree in so many bytes more as the bucket
    pointed to does. New pointers stand at once: they serve the buckets' own next refinement, which follows directly,
    and all later ones. Resolved buckets aren't sorted again. Spans are 8 bytes long or more.
    """
    n = len(data) + len(size)
    # A place of its own for each span's end, after its bytes: what is looked up there differs from all else.
    stop = np.cumsum(size + 1) - 1
    body = np.ones(n, bool)
    body[stop] = False
    wide = np.zeros(n + 8, np.uint8)
    wide[:n][body] = data
    gram = np.ndarray(n, ">u8", wide, strides=(1,)).astype(np.uint64)
    short = np.full(n, 8, np.int8)
    # A shorter rest has its length in the last byte, which is free there; only where texts have such bytes is it a key of its own.
    for k in range(8):
        short[stop - k] = k
        gram[stop - k] = gram[stop - k] >> np.uint64(8 * (8 - k)) << np.uint64(8 * (8 - k)) | np.uint64(k) if k else 0
    apart = bool((data < 8).any())
    order = (np.lexsort((short, gram)) if apart else np.argsort(gram)).astype(np.int32)
    ordered = gram[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if apart:
        new[1:] |= short[order[1:]] != short[order[:-1]]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    pointer, depth = np.empty(n, np.int32), np.full(n, length, np.int32)
    pointer[order] = np.repeat(starts.astype(np.int32), sizes)
    depth[starts[short[order[starts]] == 8]] = 8  # a shorter rest ends there
    todo = (sizes > 1) & (depth[starts] < length)
    starts, sizes = starts[todo], sizes[todo]
    stretch = np.cumsum(sizes) // BUCKETS
    for at in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(stretch)) + 1) if len(starts) else ():
        begin, many = starts[at], sizes[at]
        while len(begin):
            first = np.cumsum(many) - many
            place = np.repeat(begin - first, many) + np.arange(int(many.sum()))
            known = depth[begin]
            here = order[place]
            ahead = pointer[here + np.repeat(known, many)]
            # A bucket that points to one bucket only stays as it is, and agrees in more.
            lead = ahead[first]
            mixed = np.logical_or.reduceat(ahead != np.repeat(lead, many), first)
            reach = np.minimum(known + depth[lead], length)
            if mixed.any():
                of = np.repeat(mixed, many)
                place, here, ahead = place[of], here[of], ahead[of]
                bucket, known = (np.repeat(x, many[mixed]) for x in (np.arange(np.count_nonzero(mixed)), known[mixed]))
                by = np.argsort(bucket << 32 | ahead)
                here, ahead = here[by], ahead[by]
                order[place] = here
                new = np.ones(len(place), bool)
                new[1:] = (bucket[1:] != bucket[:-1]) | (ahead[1:] != ahead[:-1])
                cut = np.flatnonzero(new)
                parts = np.diff(np.append(cut, len(place)))
                further = np.minimum(known[cut] + depth[ahead[cut]], length)
                begin, many = np.append(begin[~mixed], place[cut]), np.append(many[~mixed], parts)
                reach = np.append(reach[~mixed], further)
                pointer[here] = np.repeat(place[cut], parts)
            depth[begin] = reach
            more = (many > 1) & (reach < length)
            begin, many = begin[more], many[more]
    # Ranks are by all that was compared, which may be more than `length` bytes: neighbours that agree in these are one class.
    whole = order[(np.repeat(stop, size + 1) - np.arange(n) >= length)[order]]
    same = pointer[whole[1:]] == pointer[whole[:-1]]
    maybe = np.flatnonzero(~same)
    for k in [*range(0, length - 8, 8), length - 8]:
        maybe = maybe[gram[whole[maybe + 1] + k] == gram[whole[maybe] + k]]
    same[maybe] = True
    out = np.zeros(n, np.int32)
    out[whole] = np.cumsum(np.concatenate((np.ones(min(len(whole), 1), bool), ~same)))
    return out[body]


def stretches(anchor: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Uses in order of their anchors, in stretches of AT_ONCE bytes or one anchor; equal strings have equal anchors. An anchor of one use holds nothing twice."""
    order = np.argsort(anchor, kind="stable")
    _, times = np.unique(anchor, return_counts=True)
    order = order[np.repeat(times > 1, times)]
    if not len(order):
        return
    ends = np.cumsum(size[order])
    last = np.flatnonzero(np.append(anchor[order][1:] != anchor[order][:-1], True)) + 1
    a = done = 0
    for b in last.tolist():
        if ends[b - 1] - done >= AT_ONCE or b == len(order):
            yield order[a:b]
            a, done = b, ends[b - 1]


def held_strings(data: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of runs of strings that a document with a smaller id holds, for spans (row, start, size) whose bytes lie in `data`."""
    bucket = string_buckets(data, size, length)
    own = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(bucket)
    bucket, own, step = bucket[at], own[at], step[at]
    ids = doc >> shift
    first = np.full(int(bucket.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, bucket, ids[own])
    held = first[bucket] < ids[own]
    own, step = own[held], step[held]
    if not len(own):
        return EMPTY, EMPTY, EMPTY
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (step[1:] != step[:-1] + 1)
    a = np.flatnonzero(new)
    z = np.append(a, len(own))[1:] - 1
    return doc[own[a]], start[own[a]] + step[a], start[own[a]] + step[z] + length


def mark_repeats(homes: int, length: int, shift: int):
    """Step 3, per hash range: bytes of strings that a document with a smaller id holds."""

    def work(key, part):
        if key[0].as_py() < 0:
            return table([(-1 - key[0].as_py(), squeeze(joined(part["docs"])), None, squeeze(joined(part["starts"])), squeeze(joined(part["sizes"])), None)])
        doc, h, start, size = joined(part["docs"]), joined(part["hashes"], np.uint32), joined(part["starts"]), joined(part["sizes"])
        data = np.frombuffer(b"".join(zstandard.decompress(x) for x in part["data"].to_pylist()), np.uint8)
        begin, marks = np.cumsum(size) - size, [(EMPTY, EMPTY, EMPTY)]
        for some in stretches(h, size):
            n = size[some]
            bytes_of = data[np.repeat(begin[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            marks.append(held_strings(bytes_of, doc[some], start[some], n, length, shift))
        give_back()
        return table(marks_to_home(*(np.concatenate(x) for x in zip(*marks)), homes, negative=False))

    return work


def union(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of sorted intervals; those that touch are one."""
    out: list[list[int]] = []
    for a, b in zip(start.tolist(), end.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without those characters that lie wholly within a span."""
    kept, at = [], 0
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = max(at, b)
    return b"".join([*kept, data[at:]]).decode()


def cut_documents(columns: Sequence[str], with_text: bool):
    """Step 4, per group of documents."""

    def work(key, docs, marks):
        doc, start, end = joined(marks["docs"]), joined(marks["starts"]), joined(marks["sizes"])
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        ids = docs["row"].to_pylist()
        known = np.array([NO_ID if i is None else i for i in ids], np.int64)
        low, high = np.searchsorted(doc, known).tolist(), np.searchsorted(doc, known, "right").tolist()
        size, removed, count, digest, kept = [], [], [], [], []
        for i, text, a, b in zip(ids, docs["text"].to_pylist(), low, high):
            data = (text or "").encode()
            spans = union(start[a:b], end[a:b]) if i is not None else []
            at, left = 0, []
            for x, y in spans:
                left.append(data[at:x])
                at = y
            left.append(data[at:])
            size.append(len(data))
            removed.append(sum(y - x for x, y in spans))
            count.append(len(spans))
            digest.append(hashlib.sha256(b"".join(left)).hexdigest())
            if with_text:
                kept.append(text if text is None else whole_characters(data, spans))
        out = {"doc_id": docs["doc_id"], "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            out["kept_text"] = pa.array(kept, pa.string())
        return pa.table(out | {c: docs[c] for c in columns})

    return work


def with_rows(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """`docs` (doc_id, text, ...) with a number a row, the bits of it below the id, and the bytes of all texts.

    The number is the doc_id, and there are no bits below, unless rows repeat an id with another text. Then it is the id's
    place among all ids and, in as many bits below as the id of most texts needs, the text's place among the id's texts.
    Places come from buckets and the counts of buckets before, so a much repeated id meets in no task. An error where ids
    times texts of an id pass 2^62, for which some 2^32 rows have to repeat ids with other texts.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    one = hashed.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("n").alias("n"))
    one = one.agg(F.sum("n").alias("n"), F.max(F.col("doc_id").isNotNull() & (F.col("a") != F.col("b"))).alias("unlike")).first()
    if not one["unlike"]:
        return docs.withColumn("row", F.col("doc_id")), 0, one["n"] or 0
    texts = written(hashed.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h")).distinct().withColumn("bucket", F.shiftrightunsigned("r_h", 52)), "texts")
    counts = texts.groupBy("r_id", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = counts.select("r_id", "bucket", (F.sum("m").over(Window.partitionBy("r_id").orderBy("bucket")) - F.col("m")).alias("before"))
    near = F.row_number().over(Window.partitionBy("r_id", "bucket").orderBy("r_h")) - 1
    placed = texts.withColumn("near", near).join(before, ["r_id", "bucket"]).select("r_id", "r_h", (F.col("before") + F.col("near")).alias("other"))
    ids = written(counts.groupBy(F.col("r_id").alias("i")).agg(F.sum("m").alias("m")).orderBy("i").select("i", "m", F.monotonically_increasing_id().alias("at")), "ids")
    # A partition's ids have numbers in a row; one row a partition says where they begin.
    parts = ids.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("k"))
    parts = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("begin"))
    ids = ids.join(F.broadcast(parts), F.shiftright("at", 33) == F.col("part"))
    most = ids.agg(F.max("m").alias("texts"), F.max(F.col("begin") + F.col("at") - F.shiftleft(F.col("part"), 33)).alias("place")).first()
    shift = max(16, int(most["texts"] - 1).bit_length())
    if int(most["place"]).bit_length() + shift > 62:
        raise ValueError(f"{most['place'] + 1} ids and {most['texts']} texts of one of them are more than a row's number holds")
    base = F.shiftleft(F.col("begin") + F.col("at") - F.shiftleft(F.col("part"), 33), shift)
    rows = written(placed.join(ids.select("i", base.alias("base")), F.col("r_id") == F.col("i")).select("r_id", "r_h", (F.col("base") + F.col("other")).alias("row")), "rows")
    forget(texts)
    return docs.join(small_or_shuffled(rows), (F.col("doc_id") == F.col("r_id")) & (F.xxhash64("text") == F.col("r_h")), "left").drop("r_id", "r_h"), shift, one["n"] or 0


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes (null: empty); strings are judged on the input and never cross documents. Returns a row a
    document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes).
    with_text adds kept_text: the text without the characters wholly within removed runs, so that it stays valid; a
    null text stays null. carry names columns of `docs` to pass on, as carry_0, carry_1, ...; their own names don't matter.

    Rows with a null id take no part and keep all. Rows that repeat a doc_id don't count as earlier for each other; each is
    cut by its own text. A very long text is read in one piece by one task (some 60 bytes a byte of it). An empty table
    gives no rows. length is 20 or more.
    """
    columns = [f"carry_{k}" for k in range(len(carry))]
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, columns)])
    named, shift, size = with_rows(named)
    parts = conf_int(docs.sparkSession, "spark.sql.shuffle.partitions", 200)
    groups, tasks = max(parts, size // GROUP_BYTES), max(parts, size // TASK_BYTES)
    homes = (groups + 1) | 1  # odd, so that numbers with bits below their ids spread as well
    dealt = lambda df: (df.repartition(int(tasks), "key") if tasks > parts else df).groupBy("key")
    at, any_home = F.col("row"), F.monotonically_increasing_id()
    # Rows without an id have no spans and no marks, so they may be anywhere, but not all in one place.
    key = F.coalesce(F.pmod(at + F.shiftright(at, 16), F.lit(homes)), F.pmod(any_home + F.shiftright(any_home, 33), F.lit(homes)))
    texts = named.select(key.cast("bigint").alias("key"), "row", "doc_id", "text", *columns)
    sent = named.select("row", "text").where("row IS NOT NULL").mapInArrow(send_anchors(groups, homes, length), PARTS)
    hits = dealt(sent).applyInArrow(find_shared(homes), PARTS)
    spans = dealt(texts).cogroup(dealt(hits)).applyInArrow(send_spans(groups, homes, length, shift), PARTS)
    marks = dealt(spans).applyInArrow(mark_repeats(homes, length, shift), PARTS)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text
    kinds = dict(texts.dtypes)
    return dealt(texts).cogroup(dealt(marks)).applyInArrow(cut_documents(columns, with_text), schema + "".join(f", {n} {kinds[n]}" for n in columns))


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents, all columns, with their texts cut by `remove_repeats` (whole characters) and n_chars to match.

    A document of which nothing is left stays, with an empty text.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs, length, with_text=True, carry=rest)
    named = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")} | {c: F.col(f"carry_{k}") for k, c in enumerate(rest)}
    if "n_chars" in named:
        named["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[named[c].alias(c) for c in docs.columns])


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
p AS (SELECT doc_id, i, hash(substring(x, 2 * i + 1, 100)) AS s FROM (SELECT *, unnest(range(0, greatest(n - 49, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s HAVING count(*) > 1),
m AS (SELECT doc_id, i FROM p JOIN f USING (s) WHERE f.least < p.doc_id),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM m),
r AS (SELECT doc_id, i, sum(CASE WHEN step IS NULL OR step > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
c AS (SELECT k.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(x), 2 * max(b) + 1) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""
