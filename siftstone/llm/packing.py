"""Packing token sequences by harmonic classes, each worker on its own.

A stretch of ids that is longer than 1/(k+1) of a sequence and at most 1/k of it is of class k, for every k. Documents of
up to a sequence are such stretches whole; longer ones give full sequences (class 1) and one stretch of what is over.
A bin of class k takes exactly k stretches, so it has room left, less than 1/(k+1) of a sequence. Only that room is filled with
cut stretches: those that found no bin yet (fewer than k of a class), longest first, poured from one bin's room to the next.
Bins are kept, those with the least room first, as long as all ids at hand can fill them; the others give up their
stretches to be poured. So each bin is full, and each cuts one stretch at most. What a worker has left at its end is joined,
longest first, into full sequences, and the last of them into sequences whose lengths are powers of two. No sequence is
padded at all. There is no shuffle; a worker holds one batch of documents at a time, and fewer ids of stretches that
wait than there are classes of whole lengths (2 * sqrt(capacity)) times the capacity.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siftstone.llm.common import batches, give_back, text_array, text_bytes
from siftstone.llm.words import bounds, hashes

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Words a worker keeps with their ids (some 40 bytes each); when full, the memory starts anew. Results don't depend on it.
CACHE_WORDS = 1_000_000
#: Stands between words that are tokenised together; words that hold it are tokenised alone.
MARK = "\x01"
_kept: dict[str, WordIds] = {}


class WordIds:
    """Ids of whole texts, each distinct run of non-space bytes tokenised once while it is remembered.

    Only for tokenizers that split at white space and drop it, as `word_bpe_49k.json` does: what stands between two
    ASCII spaces then has the same ids by itself as within its text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> WordIds:
        """The worker process's own, so that a later task finds the words of earlier ones."""
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        if self.mark is None or any(MARK in w for w in words):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter((i for x in got for i in x), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        flat, sizes = [], []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part) + f" {MARK}"], add_special_tokens=False)[0].ids, np.uint32)
            end = np.flatnonzero(ids == self.mark)
            sizes.append(np.diff(np.concatenate(([-1], end))) - 1)
            flat.append(ids[ids != self.mark])
        return np.concatenate(flat), np.concatenate(sizes)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Remember the words' ids; keys are sorted and new."""
        flat, sizes = self.word_ids(words)
        all_keys = np.concatenate((self.keys, keys))
        order = np.argsort(all_keys, kind="stable")
        size = np.concatenate((np.diff(self.first), sizes))[order]
        start = np.concatenate((self.first[:-1], self.first[-1] + np.cumsum(sizes) - sizes))[order]
        self.ids = gather(np.concatenate((self.ids, flat)), start, size)
        self.keys, self.first = all_keys[order], np.concatenate(([0], np.cumsum(size)))

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, each with end_id last, and each one's first place (n + 1 entries)."""
        starts, ends, doc = bounds(raw, off)
        keys, where, back = np.unique(hashes(raw, starts, ends, fold=False), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.keys, self.first, self.ids = keys[:0], np.zeros(1, np.int64), self.ids[:0]
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            data = raw.tobytes()
            self.learn(keys[new], [data[a:b].decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
        place = np.searchsorted(self.keys, keys)
        size, first = np.diff(self.first)[place][back], self.first[:-1][place][back]
        total = np.concatenate(([0], np.cumsum(size)))[doc] + np.arange(len(doc))
        out = np.full(int(total[-1]), end_id, np.uint32)
        hole = np.ones(len(out), bool)
        hole[total[1:] - 1] = False
        out[hole] = gather(self.ids, first, size)
        return out, total


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after another."""
    begin = np.cumsum(size) - size
    return flat[np.repeat(start - begin, size) + np.arange(int(size.sum()))] if len(size) else flat[:0]


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of every stretch, in the order of documents: full capacities, then what is over."""
    many = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), many)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * capacity
    return doc, start, np.minimum(lengths[doc] - start, capacity)


def classes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin of each stretch (-1: none) and its place there; and how many bins there are.

    Class k = capacity // size fills bins of exactly k. Bins whose room the other stretches can't fill are given up,
    the roomiest first.
    """
    fit = capacity // sizes
    order = np.argsort(fit, kind="stable")
    k, begin, many = np.unique(fit[order], return_index=True, return_counts=True)
    rank = np.arange(len(order)) - np.repeat(begin, many)
    full = many // k
    number = np.repeat(np.cumsum(full) - full, many) + rank // fit[order]
    number[rank >= np.repeat(full * k, many)] = -1
    bins = np.full(len(sizes), -1, np.int64)
    bins[order] = number
    total = int(full.sum())
    room = capacity - np.bincount(bins[bins >= 0], sizes[bins >= 0], total).astype(np.int64)
    keep = np.sort(np.argsort(room, kind="stable")[: int(sizes.sum()) // capacity])
    renumber = np.full(total + 1, -1, np.int64)  # the last entry is that of no bin
    renumber[keep] = np.arange(len(keep))
    bins = renumber[bins]
    placed = order[bins[order] >= 0]
    before = np.cumsum(sizes[placed]) - sizes[placed]
    opens = np.flatnonzero(np.diff(bins[placed], prepend=-1))  # where a bin's stretches begin; they stand together
    offset = np.zeros(len(sizes), np.int64)
    offset[placed] = before - before[opens][bins[placed]]
    return bins, offset, len(keep)


def pour(sizes: np.ndarray, rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches, one after another, into rooms, one after another: (stretch, start in it, length, room, offset in it) of each piece.

    Rooms and sizes are above 0, and there is at least as much of the stretches as of room.
    """
    at, door = np.cumsum(sizes) - sizes, np.cumsum(rooms) - rooms
    total = int(rooms.sum())
    begin = np.unique(np.concatenate((at[at < total], door)))
    stretch, room = np.searchsorted(at, begin, "right") - 1, np.searchsorted(door, begin, "right") - 1
    return stretch, begin - at[stretch], np.diff(np.concatenate((begin, [total]))), room, begin - door[room]


@dataclass
class Stretches:
    """Stretches of ids in a worker's hands; `first` is where each one's ids begin in `ids`."""

    doc: np.ndarray
    known: np.ndarray
    total: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls) -> Stretches:
        return cls(*[np.zeros(0, np.int64)] * 6, np.zeros(0, np.uint32))

    def join(self, other: Stretches) -> Stretches:
        columns = ((getattr(self, c), getattr(other, c)) for c in ("doc", "known", "total", "start", "size"))
        return Stretches(*map(np.concatenate, columns), np.concatenate((self.first, other.first + len(self.ids))), np.concatenate((self.ids, other.ids)))

    def part(self, at: np.ndarray, skip: np.ndarray) -> Stretches:
        """Stretches `at` without their first `skip` ids, and the ids of these alone."""
        size, first = self.size[at] - skip, self.first[at] + skip
        return Stretches(self.doc[at], self.known[at], self.total[at], self.start[at] + skip, size, np.cumsum(size) - size, gather(self.ids, first, size))

    def rows(self, at: np.ndarray, skip: np.ndarray, size: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
        """Pieces: `size` ids of stretch `at` after its first `skip`, with where they are put."""
        data = self.ids.astype("<u4").tobytes()
        begin = (self.first[at] + skip) * 4
        crc = np.fromiter((zlib.crc32(data[x:y]) for x, y in zip(begin.tolist(), (begin + size * 4).tolist())), np.int64, len(at))
        columns = [pa.array(self.doc[at], mask=self.known[at] == 0), self.start[at] + skip, size, crc, self.total[at], sequence, offset]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def filled(held: Stretches, capacity: int, serial: int) -> tuple[pa.RecordBatch, Stretches, int]:
    """The pieces of full bins from the stretches at hand, the stretches that wait, and the next free sequence."""
    bins, offset, many = classes(held.size, capacity)
    inside = np.flatnonzero(bins >= 0)
    others = np.flatnonzero(bins < 0)
    others = others[np.argsort(-held.size[others], kind="stable")]
    used = np.bincount(bins[inside], held.size[inside], many).astype(np.int64)
    open_bins = np.flatnonzero(used < capacity)
    stretch, skip, size, room, inner = pour(held.size[others], capacity - used[open_bins])
    gone = np.bincount(stretch, size, len(others)).astype(np.int64)
    put = open_bins[room]
    at = np.concatenate((inside, others[stretch]))
    sent = held.rows(at, np.concatenate((np.zeros_like(inside), skip)), np.concatenate((held.size[inside], size)), serial + np.concatenate((bins[inside], put)), np.concatenate((offset[inside], used[put] + inner)))
    left = gone < held.size[others]
    return sent, held.part(others[left], gone[left]), serial + many


def joined(held: Stretches, capacity: int, serial: int) -> pa.RecordBatch:
    """All stretches at hand, longest first, in full sequences and at the end in sequences of falling powers of two."""
    order = np.argsort(-held.size, kind="stable")
    whole, rest = divmod(int(held.size.sum()), capacity)
    rooms = np.array([capacity] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)
    stretch, skip, size, room, offset = pour(held.size[order], rooms)
    return held.rows(order[stretch], skip, size, serial + room, offset)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Sequences of at most `capacity` (a power of two) ids from whole texts; each id lies in exactly one piece.

    tokenizer: path of the tokenizer's file on every worker. A document's ids are the tokenizer's without special tokens,
    then end_id; null or empty text is the end_id alone. Rows that repeat a doc_id, and null ids, are documents of
    their own. A text of any length is tokenised whole by one task and fills sequences of its own up to what is over.
    Documents of equal length keep their order. Returns a row a piece: doc_id, start (ids of the document before it),
    length, ids_crc32 (unsigned, over little-endian unsigned 32-bit ids), doc_tokens, sequence_id (unique; a worker's own
    range), offset (from 0, gapless). Sequences are full or a power of two long. Other columns aren't read; an empty
    table gives no rows.
    """
    assert capacity & (capacity - 1) == 0, "capacity must be a power of two"

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer)
        serial = TaskContext.get().partitionId() << 40
        held = Stretches.none()
        for batch in incoming:
            texts = text_array(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            doc_ids, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in batches(texts, 2 << 20):
                tokens, first = words.encode(*text_bytes(texts.slice(a, b - a)), end_id)
                lengths = np.diff(first)
                doc, start, size = cut(lengths, capacity)
                new = Stretches(doc_ids[a:b][doc], known[a:b][doc], lengths[doc], start, size, first[doc] + start, tokens)
                sent, held, serial = filled(held.join(new), capacity, serial)
                yield sent
            give_back()
        yield joined(held, capacity, serial)

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)
