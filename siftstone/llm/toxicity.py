"""Toxicity by cumulative-link ordinal regression over sparse word features.

P(grade <= j) = sigmoid(t_j - w.x) with ordered thresholds t and one weight vector w for all of them. x counts a
document's words (hashed; logarithm of the count) among those that a test on the sample finds related to the label.
The labels are toxic or not; among the toxic, grades come from words weighed on other documents (see severity_grades).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import batches, held_out, text_array, text_bytes
from siftstone.llm.quality import labelled_sample
from siftstone.llm.words import bounds, hashes

#: Parts of the sample; the severity of each part's documents is weighed by words of the others.
FOLDS = 5
#: Deviations of the weights that are tried, and steps of a trial fit; which one is taken the folds decide.
PRIORS, TRIAL_STEPS = (0.25, 0.5, 1.0, 2.0, 4.0), 400
SCHEMA = "doc_id bigint, held_out boolean, score double, severity double, grade int, predicted int"
#: ASCII marks part words too, so that "word," and "word" are one feature.
_MARK = np.frombuffer(bytes(32 if 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 else b for b in range(256)), np.uint8)


def word_bags(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, count) of each distinct word of each document."""
    plain = _MARK[raw]
    starts, ends, first = bounds(plain, off)
    h = hashes(plain, starts, ends)
    docs, keys, counts = [], [], []
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        u, c = np.unique(h[a:b], return_counts=True)
        docs.append(np.full(len(u), d))
        keys.append(u)
        counts.append(c)
    return (np.concatenate(docs), np.concatenate(keys), np.concatenate(counts)) if docs else (np.zeros(0, np.int64), h, np.zeros(0, np.int64))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def design(doc: np.ndarray, key: np.ndarray, count: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows over the known (sorted) words: document, feature, value."""
    if not len(known):
        return doc[:0], doc[:0], np.zeros(0)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    hit = known[at] == key
    return doc[hit], at[hit], np.log1p(count[hit])


def related_words(doc: np.ndarray, key: np.ndarray, toxic: np.ndarray, least: int, z: float, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words in at least `least` documents `among` whose shares in the classes differ by z deviations; and those deviations."""
    words, at = np.unique(key, return_inverse=True)
    n1, n0 = max((toxic & among).sum(), 1), max((~toxic & among).sum(), 1)
    c1, c0 = np.bincount(at, toxic[doc], len(words)), np.bincount(at, ~toxic[doc], len(words))
    p = (c1 + c0) / (n1 + n0)
    score = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    pick = np.flatnonzero((np.abs(score) >= z) & (c1 + c0 >= least))
    return words[pick], score[pick]


def severity_grades(doc: np.ndarray, key: np.ndarray, count: np.ndarray, toxic: np.ndarray, fold: np.ndarray, least: int, z: float, grades: int) -> np.ndarray:
    """Grade of each sample document: 0 if not toxic, else 1 to grades - 1 by its share of evidence, cross-fitted.

    A toxic document's evidence is its log counts times the deviations of words that speak for toxicity in the documents of
    all other folds, so neither its own label nor its own words take part in weighing it. Its grade is the quantile of that
    evidence among the toxic of its fold; what equals a quantile is below it.
    """
    out = np.zeros(len(toxic), np.int64)
    for f in np.unique(fold).tolist():
        mine = fold == f
        other = ~mine[doc]
        words, score = related_words(doc[other], key[other], toxic, least, z, ~mine)
        d, feature, value = design(doc[~other], key[~other], count[~other], words)
        load = np.bincount(d, value * np.maximum(score[feature], 0), len(toxic))
        of = np.flatnonzero(mine & toxic)
        if len(of):
            out[of] = 1 + np.searchsorted(np.quantile(load[of], np.arange(1, grades - 1) / (grades - 1)), load[of], "left")
    return out


def fit_ordinal(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, width: int, grades: int, steps: int = 1000, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean log-likelihood; thresholds are a first one and positive steps.

    prior: the deviation around 0 that weights are expected to have, so that few documents shrink them and many don't.
    """
    ridge = 1 / (prior**2 * max(len(grade), 1))
    share = np.array([weight[grade <= j].sum() for j in range(grades - 1)]) / max(weight.sum(), 1e-9)
    start = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    x = np.concatenate((np.zeros(width), start[:1], gaps))
    m, v = np.zeros_like(x), np.zeros_like(x)
    n = max(weight.sum(), 1e-9)
    for step in range(1, steps + 1):
        w, t = x[:width], np.cumsum(np.concatenate((x[width : width + 1], np.exp(x[width + 1 :]))))
        line = np.bincount(doc, value * w[feature], len(grade))
        edge = np.concatenate(([-np.inf], t, [np.inf]))
        up, low = edge[grade + 1] - line, edge[grade] - line
        su, sl = np.where(np.isinf(up), 1.0, sigmoid(up)), np.where(np.isinf(low), 0.0, sigmoid(low))
        p = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su) / p * weight / n, sl * (1 - sl) / p * weight / n
        dt = np.array([du[grade == j].sum() - dl[grade == j + 1].sum() for j in range(grades - 1)])
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate((np.bincount(feature, value * (dl - du)[doc], width) - ridge * w, tail[:1], tail[1:] * np.exp(x[width + 1 :])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:width], np.cumsum(np.concatenate((x[width : width + 1], np.exp(x[width + 1 :]))))


def predict(line: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(grade >= 1), expected grade and likeliest grade."""
    above = 1 - sigmoid(thresholds[None, :] - line[:, None])
    p = -np.diff(np.concatenate((np.ones((len(line), 1)), above, np.zeros((len(line), 1))), axis=1), axis=1)
    return above[:, 0], above.sum(1), p.argmax(1)


def folds(ids: list[int]) -> np.ndarray:
    """Fold of each document, by hash of its id, so that rows that repeat an id share one."""
    return np.array([crc32(f"grade:{i}".encode()) % FOLDS for i in ids], np.int64)


def prepared(doc: np.ndarray, key: np.ndarray, count: np.ndarray, toxic: np.ndarray, fold: np.ndarray, least: int, z: float, grades: int) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Known words (sorted hashes), sparse rows over them, and the grades to fit."""
    known, _ = related_words(doc, key, toxic, least, z, np.ones(len(toxic), bool))
    return known, design(doc, key, count, known), severity_grades(doc, key, count, toxic, fold, least, z, grades)


def best_prior(doc: np.ndarray, key: np.ndarray, count: np.ndarray, toxic: np.ndarray, fold: np.ndarray, weight: np.ndarray, least: int, z: float, grades: int, priors: tuple[float, ...] = PRIORS) -> float:
    """The prior whose fits to all folds but one give that one's labels the greatest likelihood, summed over folds; ties to the smaller.

    Words, grades and weights are made anew without the fold. Folds that leave one class only are passed over.
    """
    total = np.zeros(len(priors))
    for f in np.unique(fold).tolist():
        mine = fold == f
        if not (toxic & ~mine).any() or not (~toxic & ~mine).any():
            continue
        other, number = ~mine[doc], np.cumsum(~mine) - 1
        known, rows, grade = prepared(number[doc[other]], key[other], count[other], toxic[~mine], fold[~mine], least, z, grades)
        d, feature, value = design(doc[~other], key[~other], count[~other], known)
        for k, prior in enumerate(priors):
            w, t = fit_ordinal(*rows, grade, weight[~mine], len(known), grades, steps=TRIAL_STEPS, prior=prior)
            score = predict(np.bincount(d, value * w[feature], len(toxic))[mine], t)[0]
            total[k] += (weight[mine] * np.log(np.maximum(np.where(toxic[mine], score, 1 - score), 1e-9))).sum()
    return priors[int(total.argmax())]


def learn(doc: np.ndarray, key: np.ndarray, count: np.ndarray, toxic: np.ndarray, fold: np.ndarray, weight: np.ndarray, least: int, z: float, grades: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Known words (sorted hashes), their weights, the thresholds, and the grades that these were fitted to."""
    known, rows, grade = prepared(doc, key, count, toxic, fold, least, z, grades)
    prior = best_prior(doc, key, count, toxic, fold, weight, least, z, grades)
    return known, *fit_ordinal(*rows, grade, weight, len(known), grades, prior=prior), grade


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_a_class: int = 4000, grades: int = 4, least: int = 5, z: float = 5.0) -> DataFrame:
    """Severity of every whole text, learnt from labels.toxic of documents whose crc32(doc_id as text) mod 3 is not 1.

    sample_a_class bounds the documents a class that are learnt from, and with them the words that are broadcast: all of those
    documents' that pass the test; the penalty's width is chosen by cross-validation among them. Returns
    doc_id, held_out, score (probability of any toxicity), severity (expected grade, 0 to grades - 1), grade (the
    likeliest), predicted (1 if score >= 0.5). Texts of any length are scored whole. Null and empty texts have the score of a text without known words;
    without labels of both classes every score is 0. Each row has its own result, repeated rows the same; an empty table gives
    none. Rows with a null id are scored and never learnt from or held out. Equal likelihoods choose the lower grade. Other columns
    aren't read.
    """
    spark = docs.sparkSession
    keep = ~held_out("doc_id", 3, 1)
    shares = {int(r["toxic"]): r["n"] for r in labels.where(keep & F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def bags(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            texts = text_array(batch.column("text"))
            for a, b in batches(texts):
                doc, key, count = word_bags(*text_bytes(texts.slice(a, b - a)))
                cut = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b].cast(pa.int64()), batch.column("y")[a:b], pa.array([key[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([count[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary())],
                    names=["doc_id", "y", "keys", "counts"],
                )

    known, w, t = np.zeros(0, np.uint64), np.zeros(0), None
    if len(shares) == 2:
        got = labelled_sample(docs, labels, "toxic", sample_a_class, keep).mapInArrow(bags, "doc_id bigint, y int, keys binary, counts binary").toArrow().sort_by("doc_id")
        toxic = got["y"].to_numpy() == 1
        if toxic.any() and not toxic.all():
            keys = [np.frombuffer(x, np.uint64) for x in got["keys"].to_pylist()]
            doc = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
            key = np.concatenate(keys)
            count = np.concatenate([np.frombuffer(x, np.int32) for x in got["counts"].to_pylist()])
            known, w, t, _ = learn(doc, key, count, toxic, folds(got["doc_id"].to_pylist()), np.where(toxic, shares[1] / toxic.sum(), shares[0] / (~toxic).sum()), least, z, grades)
    model = spark.sparkContext.broadcast((known, w, t))

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w, t = model.value
        for batch in incoming:
            texts = text_array(batch.column("text"))
            for a, b in batches(texts):
                raw, off = text_bytes(texts.slice(a, b - a))
                score = severity = np.zeros(b - a)
                grade = np.zeros(b - a, np.int64)
                if t is not None:
                    plain = _MARK[raw]
                    starts, ends, first = bounds(plain, off)
                    key = hashes(plain, starts, ends)
                    doc, feature, _ = design(np.repeat(np.arange(b - a), np.diff(first)), key, np.ones(len(key)), known)
                    pair, count = np.unique(doc * max(len(known), 1) + feature, return_counts=True)
                    line = np.bincount(pair // max(len(known), 1), np.log1p(count) * w[pair % max(len(known), 1)], b - a)
                    score, severity, grade = predict(line, t)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), batch.column("held_out")[a:b], pa.array(score), pa.array(severity), pa.array(grade.astype(np.int32)), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "severity", "grade", "predicted"])

    return docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text").mapInArrow(work, SCHEMA)
