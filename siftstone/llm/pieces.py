"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

A text is normalised, its spaces become U+2581, and every character is a symbol. Adjacent symbols whose concatenation is a
piece stand on an agenda ordered by score, the leftmost first among equals. The best pair is merged, and the pairs that it
makes with its neighbours are put on the agenda; a pair one of whose symbols has changed since is passed over. Symbols that
are no piece are written as their bytes.

Where no piece holds U+2581 after another character, no merge crosses such a place, nor a character that no piece has, so a
text falls apart into words whose ids are remembered. The new words of a batch are merged side by side: in each step every word's best pair comes off its
agenda, the ranks of its adjacent pairs in an array. Long words, and those with characters that are no piece, have a heap each.
Every batch is compared with the sentencepiece library, ids and decoded texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import compress, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.llm.common import batches, give_back, text_array

SPACE = "▁"
#: Words that a worker remembers (some 200 bytes each), and the characters of the longest; when full, it starts anew.
CACHE_WORDS, CACHE_CHARS = 500_000, 64
_kept: dict[str, Pieces] = {}


#: Rank of a pair that is no piece.
NONE = 1 << 30


class Words(dict):
    """Ids of words as little-endian 32-bit numbers; what isn't remembered is made when asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.make(word), "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Pairs:
    """Rank and result of every pair of symbols (pieces and their characters, by number) that is a piece, in a hash table."""

    def __init__(self, cost: dict[str, float]):
        number = {p: k for k, p in enumerate(cost)}
        self.character = np.full(0x110000, -1, np.int64)
        for c in {c for p in cost for c in p}:
            if c in number:
                self.character[ord(c)] = number[c]
        self.times = np.int64(len(number))
        rank = {c: k for k, c in enumerate(sorted(set(cost.values())))}
        # A character that is no piece itself stays out: words that hold it aren't merged here.
        pairs = [(number[p[:k]] * len(number) + number[p[k:]], rank[c], number[p]) for p, c in cost.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        key, of, into = (np.array([x[j] for x in pairs], np.int64) for j in range(3))
        self.bits = max(4, int(4 * len(key)).bit_length())
        self.key, self.value = (np.full(1 << self.bits, v, np.int64) for v in (-1, NONE << 32))
        at, left = self.slot(key), np.arange(len(key))
        while len(left):
            free = left[self.key[at[left]] < 0]
            self.key[at[free]] = key[free]
            done = self.key[at[left]] == key[left]
            self.value[at[left[done]]] = (of[left[done]] << 32) | into[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without one) and result of each pair."""
        key = left * self.times + right
        at = self.slot(key)
        found = self.key[at]
        value = np.where(found == key, self.value[at], NONE << 32)
        look = np.flatnonzero((found != key) & (found >= 0))
        while len(look):
            at[look] = (at[look] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[look]]
            hit = look[found == key[look]]
            value[hit] = self.value[at[hit]]
            look = look[(found != key[look]) & (found >= 0)]
        return value >> 32, value & 0xFFFFFFFF


class Pieces:
    """A model's pieces, and encoding and decoding by them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(lib.vocab_size())
        self.bytes = [0] * 256
        for i in (of_byte := [i for i in every if lib.is_byte(i)]):
            self.bytes[int(lib.id_to_piece(i)[3:5], 16)] = i
        if len(of_byte) != 256 or any(lib.is_unused(i) for i in every):
            raise ValueError("only vocabularies with a piece for every byte and without unused pieces")
        special = {i for i in every if lib.is_control(i) or lib.is_unknown(i)}
        normal = [i for i in every if i not in special and not lib.is_byte(i)]
        self.id = {lib.id_to_piece(i): i for i in normal}
        self.cost = {lib.id_to_piece(i): -lib.get_score(i) for i in normal}
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        alone = "".join(f"\\x{k:02x}" for k in range(128) if not any(chr(k) in p for p in self.id)) or SPACE
        # Runs of characters with the spaces before them, spaces alone, and runs of ASCII characters that no piece has.
        self.word = re.compile(".+" if whole else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]+", re.S)
        self.words = Words(self.merged)
        self.pairs = Pairs(self.cost)
        self.of_symbol = np.array(list(self.id.values()), "<u4")
        self.surface = [lib.id_to_piece(i).replace(SPACE, " ").encode() for i in every]
        for value, i in enumerate(self.bytes):
            self.surface[i] = bytes([value])
        for i in special:
            self.surface[i] = b" \xe2\x81\x87 " if lib.is_unknown(i) else b""
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.first = np.cumsum([0, *map(len, self.surface)])
        self.prefixed = lib.normalize("a") == f"{SPACE}a"
        self.spaced = {i for p, i in self.id.items() if p.startswith(SPACE)}
        self.silent = {i for i in special if lib.is_control(i)}

    @classmethod
    def of(cls, path: str) -> Pieces:
        """The worker process's own, so that a later task finds the words of earlier ones."""
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def merged(self, text: str) -> list[int]:
        """Ids of a normalised text, by the agenda."""
        cost, symbols = self.cost, list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, k, k + 1, 2) for k in range(n - 1) if (c := cost.get(symbols[k] + symbols[k + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, a, b, size = heappop(agenda)
            left, right = symbols[a], symbols[b]
            if not left or not right or len(left) + len(right) != size:
                continue
            symbols[a], symbols[b] = (both := left + right), ""
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                if (at := cost.get(both + symbols[c])) is not None:
                    heappush(agenda, (at, a, c, size + len(symbols[c])))
            if (p := before[a]) >= 0 and (at := cost.get(symbols[p] + both)) is not None:
                heappush(agenda, (at, p, a, size + len(symbols[p])))
        out: list[int] = []
        for s in symbols:
            if s:
                if (i := self.id.get(s)) is not None:
                    out.append(i)
                else:
                    out += [self.bytes[x] for x in s.encode()]
        return out

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words of pieces' characters, merged side by side."""
        words = sorted(words, key=len)
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.pairs.character[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        good = np.ones(len(words), bool)
        good[np.repeat(np.arange(len(words)), size)[flat < 0]] = False
        flat, words, size = flat[np.repeat(good, size)], list(compress(words, good)), size[good]
        ends = np.cumsum(size)
        for a in range(0, len(words), 4096):  # words of about the same length
            some, begin = size[a : a + 4096], int(ends[a] - size[a])
            ids, many = self._merged_together(flat[begin : begin + int(some.sum())], some)
            cut = np.cumsum([0, *(4 * many).tolist()]).tolist()
            data = ids.tobytes()
            self.words.update(zip(words[a : a + 4096], map(data.__getitem__, map(slice, cut, cut[1:]))))

    def _merged_together(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of symbols `flat`, and how many each has. A word is a row; its agenda is the row of its pairs' ranks."""
        n, width = len(size), int(size.max())
        inside = np.arange(width) < size[:, None]
        symbol = np.full((n, width), -1, np.int64)
        symbol[inside] = flat
        rank, into = np.full((n, width), NONE, np.int32), np.zeros((n, width), np.int32)
        r, k = np.nonzero(inside[:, 1:])
        rank[r, k], into[r, k] = self.pairs(symbol[r, k], symbol[r, k + 1])
        after, before = (np.broadcast_to(np.arange(width) + d, (n, width)).copy() for d in (1, -1))
        after[after >= size[:, None]] = width
        row = np.arange(n)
        while len(row):
            at = rank[row].argmin(1)  # the leftmost among equals
            more = rank[row, at] < NONE
            row, at = row[more], at[more]
            gone = after[row, at]
            symbol[row, at], symbol[row, gone], rank[row, gone] = into[row, at], -1, NONE
            after[row, at] = then = after[row, gone]
            next_there, first = then < width, before[row, at]
            before[row[next_there], then[next_there]] = at[next_there]
            rank[row[~next_there], at[~next_there]] = NONE
            there = first >= 0
            r, x, y = (np.concatenate(z) for z in ((row[next_there], row[there]), (at[next_there], first[there]), (then[next_there], at[there])))
            rank[r, x], into[r, x] = self.pairs(symbol[r, x], symbol[r, y])
        left = symbol >= 0
        return self.of_symbol[symbol[left]], left.sum(1)

    def encode_all(self, texts: list[str], begin: bool, end: bool) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        split = [self.word.findall(self.library.normalize(t)) for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(filterfalse(self.words.__contains__, words))
        if short := [w for w in new if len(w) <= CACHE_CHARS]:
            self.learn(short)
        one = lambda i: int(i).to_bytes(4, "little")
        first, last = one(self.library.bos_id()) * begin, one(self.library.eos_id()) * end
        return [b"".join((first, *map(self.words.__getitem__, words), last)) for words in split]

    def decode_all(self, lists: list[bytes]) -> list[str]:
        """Texts of ids as `encode_all` gives them, begin and end ids at the ends only."""
        ids = np.frombuffer(b"".join(lists), "<u4").astype(np.int64)
        size = self.first[ids + 1] - self.first[ids]
        at = np.cumsum(size) - size
        data = self.flat[np.repeat(self.first[ids] - at, size) + np.arange(int(size.sum()))].tobytes()
        cut = np.concatenate((at, [len(data)]))[np.cumsum([0, *[len(x) // 4 for x in lists]])].tolist()
        out = []
        for x, a, b in zip(lists, cut, cut[1:]):
            try:
                text = data[a:b].decode()
                out.append(text[1:] if text[:1] == " " and self.prefixed else text)
            except UnicodeDecodeError:
                out.append(self.decode(np.frombuffer(x, "<u4").tolist()))
        return out

    def encode(self, text: str, begin: bool = False, end: bool = False) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        ids = b"".join(map(self.words.__getitem__, self.word.findall(self.library.normalize(text))))
        one = lambda i: int(i).to_bytes(4, "little")
        return one(self.library.bos_id()) * begin + ids + one(self.library.eos_id()) * end

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become a replacement mark each."""
        at = [-1, *[k for k, i in enumerate(ids) if i in self.silent], len(ids)]  # bytes on both sides of a control id don't join
        text = "".join(self._text(ids[a + 1 : b]) for a, b in zip(at, at[1:]) if b > a + 1)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if self.prefixed and first in self.spaced else text

    def _text(self, ids: list[int]) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="siftstone-mark")


def _mark(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def encode(docs: DataFrame, model: str, begin: bool = True, end: bool = True) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) of every whole text.

    model: path of the model's file on every worker. A null text is an empty one, whose ids are the begin and end ids alone
    and which decodes to an empty text. Null and repeated doc_ids are rows of their own; other columns aren't read; an empty
    table gives an empty result. A text of any length is taken whole. Each batch is encoded and decoded by the library too;
    a difference is an error that names the document.
    """

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _registered(Pieces.of(model))
        for batch in incoming:
            texts = text_array(batch.column("text"))
            for a, b in batches(texts, 1 << 20):
                part = texts.slice(a, b - a).to_pylist()
                made = codes.encode_all(part, begin, end)
                decoded = codes.decode_all(made)
                lists = codes.library.encode(part, add_bos=begin, add_eos=end, num_threads=1)
                for k, (mine, theirs, text) in enumerate(zip(made, lists, codes.library.decode(lists, num_threads=1))):
                    if mine != np.array(theirs, "<u4").tobytes() or decoded[k] != text:
                        raise ValueError(f"document {batch.column('doc_id')[a + k]}: not the library's ids or text")
                off = np.cumsum([0, *[len(x) // 4 for x in made]])
                ids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
            give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids array<int>, decoded string")


def _registered(codes: Pieces) -> Pieces:
    import codecs

    codecs.register_error("siftstone-mark", _mark)
    return codes


@F.pandas_udf(T.StringType())
def ids_sha256(ids: pd.Series) -> pd.Series:
    """SHA-256 of ids as little-endian unsigned 32-bit integers."""
    return ids.map(lambda x: hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `encode`."""
    return encode(docs, model).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
