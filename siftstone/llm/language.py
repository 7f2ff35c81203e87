"""Language identification by interpolated Kneser-Ney character models, one a language.

Counts of character 4-grams of a bounded sample a language are summed across partitions; discounts and lower orders come
from them. A model is sorted arrays of gram hashes with, for each order, a discounted probability and a back-off weight.
The language of least cross-entropy a character wins; a text is rejected if it has no letter, or if that cross-entropy
is beyond a limit that a stated share of documents kept out of the counts stay below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import batches, give_back, held_out, small_or_shuffled, text_array

ORDER, BITS = 4, 10
CLASSES = 1 << BITS
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
UNKNOWN = "und"
#: Grams kept with their scores between batches; when full, the memory starts anew (results don't depend on it).
CACHE_GRAMS = 500_000
#: Below so many documents a language's are all counted. Deviation of one character's surprise, and least spread of documents' means, in nats.
FEWEST = 5
SURPRISE, LEAST_SPREAD = 2.0, 0.02
#: Share of documents in learnt languages that may be rejected.
FALSE_REJECTION = 0.001
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point: 0 for what is no letter, else 1 to 1023 (one each up to U+024F, hashed beyond)."""
    if not _classes:
        code = np.arange(0x110000)
        of = np.where(code <= 0x24F, code, 0x250 + code % (CLASSES - 0x250))
        _classes.append((of * np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)).astype(np.uint16))
    return _classes[0]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams of lower-cased texts (runs of other than letters count as one mark), the document of each, and whether each document has a letter."""
    n = len(texts)
    # Three marks stand before each text, so that no gram reaches into the text before.
    joined = "\n\n\n" + "\n\n\n\n".join(pc.utf8_lower(texts).to_pylist()) if n else ""
    sizes = pc.utf8_length(pc.utf8_lower(texts)).to_numpy()
    code = char_classes()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    start = np.cumsum(sizes + 4) - sizes - 4 + 3
    own = np.repeat(np.arange(n), sizes)
    at = np.arange(int(sizes.sum())) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
    here = code[at]
    keep = (here != 0) | (code[at - 1] != 0)
    has = np.zeros(n, bool)
    has[own[here != 0]] = True
    own, here = own[keep], here[keep].astype(np.uint64)
    place = np.arange(len(here)) - np.searchsorted(own, np.arange(n))[own]
    packed = here.copy()
    for back in range(1, ORDER):
        before = np.zeros(len(here), np.uint64)
        before[back:] = here[:-back]
        before[place < back] = 0
        packed |= before << np.uint64(BITS * back)
    return packed, own, has


class Model:
    """One language: sorted hashes with values, by order, from its counts of 4-grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        self.levels = []
        for n in range(ORDER, 0, -1):
            once, twice = max((counts == 1).sum(), 1), max((counts == 2).sum(), 1)
            discount = once / (once + 2 * twice)
            context, at = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(at, counts, len(context))
            part = np.maximum(counts - discount, 0) / total[at]
            back = discount * np.bincount(at, minlength=len(context)) / total
            self.levels.append((keys, part, context, back))
            # Lower orders count the different characters that stand before a gram.
            keys, counts = np.unique(keys & np.uint64((1 << BITS * (n - 1)) - 1), return_counts=True)
            counts = counts.astype(np.float64)

    def log_probability(self, packed: np.ndarray) -> np.ndarray:
        p = np.full(len(packed), 1 / CLASSES)
        for n, (keys, part, context, back) in zip(range(1, ORDER + 1), reversed(self.levels)):
            gram = packed & np.uint64((1 << BITS * n) - 1)
            at = np.minimum(np.searchsorted(context, gram >> np.uint64(BITS)), len(context) - 1)
            known = context[at] == gram >> np.uint64(BITS)
            g = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            p = np.where(known, np.where(keys[g] == gram, part[g], 0) + back[at] * p, p)
        return np.log(p)


class Scorer:
    """Cross-entropies of texts under all languages; scores of grams are remembered between batches."""

    def __init__(self, models: list[Model]):
        self.models = models
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(models)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats a character by language, characters, has a letter) of each text."""
        packed, own, has = grams(texts)
        n = len(texts)
        pair = np.sort(packed << np.uint64(24) | own.astype(np.uint64))
        first = np.flatnonzero(np.concatenate((np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1])))
        times = np.diff(np.concatenate((first, [len(pair)])))
        pair = pair[first]
        gram, doc = pair >> np.uint64(24), (pair & np.uint64((1 << 24) - 1)).astype(np.int64)
        new_gram = np.concatenate((np.ones(min(len(gram), 1), bool), gram[1:] != gram[:-1]))
        unique, at = gram[new_gram], np.cumsum(new_gram) - 1
        values = self.look_up(unique)[at] if len(unique) else np.zeros((0, len(self.models)))
        length = np.bincount(own, minlength=n)
        total = np.stack([np.bincount(doc, -values[:, k] * times, n) for k in range(len(self.models))], axis=1) if self.models else np.zeros((n, 0))
        return total / np.maximum(length, 1)[:, None], length, has

    def look_up(self, unique: np.ndarray) -> np.ndarray:
        if len(self.keys) + len(unique) > CACHE_GRAMS:
            self.keys, self.values = self.keys[:0], self.values[:0]
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = unique[self.keys[at] != unique] if len(self.keys) else unique
        if len(new):
            keys = np.concatenate((self.keys, new))
            values = np.concatenate((self.values, np.stack([m.log_probability(new) for m in self.models], axis=1)))
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], values[order]
        return self.values[np.searchsorted(self.keys, unique)]


def limits_of(k: np.ndarray, nats: np.ndarray, length: np.ndarray, languages: int, false_rejection: float) -> np.ndarray:
    """Limit of cross-entropy by language (a base, and nats over the root of the length), from documents kept out of the counts.

    A document's deviation is its distance from its language's median over (spread + SURPRISE / root of its length). The limit,
    one for the documents of all languages, is the deviation whose rank among n of them is ceil((n + 1) * (1 - false_rejection)):
    a new document like them is beyond it with at most that probability. With fewer than 1 / false_rejection - 1 of them no rank
    is so high, and twice the largest deviation (at least 5) stands in. A language without any must do better than equal chances
    of all characters.
    """
    out = np.tile([np.log(CLASSES), 0.0], (languages, 1))
    deviation, place = np.zeros(len(k)), {}
    for i in np.unique(k).tolist():
        mine = k == i
        long = nats[mine & (length >= 200)] if (mine & (length >= 200)).any() else nats[mine]
        mid = np.median(long)
        spread = max(1.4826 * np.median(np.abs(long - mid)), LEAST_SPREAD)
        place[i] = mid, spread
        deviation[mine] = (nats[mine] - mid) / (spread + SURPRISE / np.sqrt(length[mine]))
    n = len(deviation)
    rank = int(np.ceil((n + 1) * (1 - false_rejection)))
    most = 0.0 if not n else np.sort(deviation)[rank - 1] if rank <= n else 2 * max(deviation.max(), 2.5)
    for i, (mid, spread) in place.items():
        out[i] = mid + most * spread, most * SURPRISE
    return out


def train(docs: DataFrame, keep: Column, docs_a_language: int, false_rejection: float) -> tuple[list[str], list[Model], np.ndarray]:
    """Languages in order, their models, and the limits of cross-entropy (see limits_of).

    A fifth of a language's documents, by hash of the id, is kept out of its counts; all are counted where fewer than
    FEWEST have a letter, or where all of them would be kept out.
    """
    spark = docs.sparkSession
    known = docs.where(keep & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    fold = F.crc32(F.concat(F.lit("fold:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) % 5 == 0
    seen = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(~fold).alias("counted")).collect()
    sizes = {r["lang"]: r["n"] for r in seen}
    whole = {r["lang"] for r in seen if r["n"] < FEWEST or not r["counted"]}
    names = sorted(sizes)
    if not names:
        return [], [], np.zeros((0, 2))
    # A hash below a language's own rate: about docs_a_language documents, whichever way the rows are dealt.
    u = F.crc32(F.concat(F.lit("sample:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) / F.lit(4294967296.0)
    told = [(name, k, docs_a_language / sizes[name], name not in whole) for k, name in enumerate(names)]
    table = small_or_shuffled(spark.createDataFrame(told, "lang string, k int, rate double, folds boolean"), len(names))
    sample = known.select("lang", "text", u.alias("u"), fold.alias("fold")).join(table, "lang").where("u < rate").select("k", (F.col("fold") & F.col("folds")).alias("kept_out"), "text")

    def count(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            texts, of = text_array(batch.column("text")), batch.column("k").to_numpy()
            for a, b in batches(texts):
                packed, own, _ = grams(texts.slice(a, b - a))
                key, n = np.unique(packed | of[a:b][own].astype(np.uint64) << np.uint64(BITS * ORDER), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], names=["g", "n"])

    got = sample.where("NOT kept_out").select("k", "text").mapInArrow(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    key, n = got["g"].to_numpy().astype(np.uint64), got["n"].to_numpy()
    of = (key >> np.uint64(BITS * ORDER)).astype(np.int64)
    learnt = [k for k in range(len(names)) if (of == k).any()]
    models = [Model(key[of == k] & np.uint64((1 << BITS * ORDER) - 1), n[of == k]) for k in learnt]
    shared = spark.sparkContext.broadcast(models)
    row = {k: i for i, k in enumerate(learnt)}

    def measure(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in incoming:
            texts, of = text_array(batch.column("text")), batch.column("k").to_numpy()
            for a, b in batches(texts):
                nats, length, has = scorer(texts.slice(a, b - a))
                k = np.array([row.get(x, -1) for x in of[a:b].tolist()], np.int64)
                use = has & (k >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(k[use]), pa.array(nats[np.arange(b - a), k][use]), pa.array(length[use])], names=["k", "nats", "n"])

    got = sample.where("kept_out").select("k", "text").mapInArrow(measure, "k bigint, nats double, n bigint").toArrow()
    limits = limits_of(*(got[c].to_numpy() for c in ("k", "nats", "n")), len(learnt), false_rejection)
    shared.unpersist()
    return [names[k] for k in learnt], models, limits


def identify(docs: DataFrame, docs_a_language: int = 1500, false_rejection: float = FALSE_REJECTION, learn_from: Column | None = None) -> DataFrame:
    """Language of every whole text, learnt from text and lang of documents whose crc32(doc_id as text) mod 4 is not 2.

    docs_a_language: about so many documents (whole texts, chosen by hash of the id) a language are learnt from.
    false_rejection: the share of documents in learnt languages that may be rejected (see limits_of). learn_from: another
    condition on documents to learn from.

    Returns doc_id, held_out, lang_pred (a learnt lang; "und" if the text is null or has no letter, or if nothing
    could be learnt), score (the winner's share of likelihood over 100 characters at most), cross_entropy (nats a
    character; null for "und"), rejected. Ties go to the lang first in order. Each row has its own result; other columns
    aren't read; an empty table gives no rows.
    """
    judge = judged(docs, docs_a_language, false_rejection, ~held_out("doc_id", 4, 2) if learn_from is None else learn_from)

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (lang, score, least, has, rejected) in judge(incoming):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(least, mask=~has), pa.array(rejected)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text").mapInArrow(work, SCHEMA)


def judged(docs: DataFrame, docs_a_language: int, false_rejection: float, learn_from: Column):
    """A function for tasks: record batches with a column text to (batch, (language, score, nats, has a letter, rejected))."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, learn_from, docs_a_language, false_rejection))

    def judge(incoming: Iterator[pa.RecordBatch]):
        names, models, limits = model.value
        scorer = Scorer(models)
        for batch in incoming:
            texts = text_array(batch.column("text"))
            for a, b in batches(texts, 1 << 20):
                if names:
                    nats, length, has = scorer(texts.slice(a, b - a))
                else:
                    nats, length, has = np.zeros((b - a, 1)), np.zeros(b - a), np.zeros(b - a, bool)
                best = nats.argmin(1)
                least = nats[np.arange(b - a), best]
                score = 1 / np.exp(-(nats - least[:, None]) * np.minimum(length, 100)[:, None]).sum(1)
                beyond = least > limits[best, 0] + limits[best, 1] / np.sqrt(np.maximum(length, 1)) if names else ~has
                yield batch.slice(a, b - a), ([names[i] if y else UNKNOWN for i, y in zip(best.tolist(), has.tolist())], np.where(has, score, 0.0), least, has, beyond | ~has)
            give_back()

    return judge


def recognised(docs: DataFrame, docs_a_language: int = 1500, false_rejection: float = FALSE_REJECTION) -> DataFrame:
    """The documents, all columns, that `identify` does not reject; they are judged and dropped where they lie.

    docs needs doc_id, text and lang. Null texts and texts without a letter go. A document without a lang gets the one found.
    Texts of any length are scored whole. Rows are judged one by one, so rows that repeat stay or go together.
    """
    judge = judged(docs, docs_a_language, false_rejection, ~held_out("doc_id", 4, 2))

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (lang, *_, rejected) in judge(incoming):
            at = batch.schema.get_field_index("lang")
            batch = batch.set_column(at, "lang", pc.coalesce(batch.column(at), pa.array(lang, batch.column(at).type)))
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(work, docs.schema)
