"""Hidden Markov language model over whole corpora.

A state emits a symbol: the end of a document, one of the most frequent words, or a class of other words (by the
last two bytes); a word of a class then has its smoothed share of the class's training tokens. Word counts cover all
training documents and stay a distributed table; only a bounded head of it is broadcast, the rest is joined.
Expected counts of Baum-Welch, of whole sequences, are summed over partitions in every sweep: some sweeps over a sample first, to place the
states, then sweeps over all training documents. Scores are exact log-likelihoods by the scaled forward recursion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import batches, forget, give_back, held_out, stream, text_array, text_bytes, written
from siftstone.llm.words import bounds, hashes

CLASSES = 64
#: Key of the end of a document among the word keys.
END = np.int64(-(1 << 62) - CLASSES)
#: Words whose counts are broadcast (16 bytes each), and those of them that are symbols of their own.
HEAD_WORDS, SYMBOL_WORDS = 262_144, 4096
#: Tokens of a sequence that is stepped through as it is; a longer one is taken in segments of SEGMENT, all at once. Cells of one group.
WHOLE, SEGMENT, CELLS = 1024, 256, 1 << 19
HALF = np.log10(0.5)


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word with its class (0 to 63, from its last two bytes, A-Z folded) in the lowest bits."""
    fold = lambda b: b + np.where((b >= 65) & (b <= 90), 32, 0)
    last = fold(raw[ends - 1].astype(np.int64))
    before = np.where(ends - starts > 1, fold(raw[np.maximum(ends - 2, 0)].astype(np.int64)), 0)
    of = ((before * 257 + last) * 40503 >> 4) % CLASSES
    return (hashes(raw, starts, ends).astype(np.int64) >> 7 << 6) | of


def count_words(docs: DataFrame) -> DataFrame:
    """(key, n): tokens of all documents in `docs`, the ends included."""

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            texts = text_array(batch.column("text"))
            for a, b in batches(texts, 4 << 20):
                raw, off = text_bytes(texts.slice(a, b - a))
                starts, ends, _ = bounds(raw, off)
                key, n = np.unique(word_keys(raw, starts, ends), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(key, END)), pa.array(np.append(n, b - a))], names=["key", "n"])

    return docs.select("text").mapInArrow(work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Head counts, symbols and class sizes; small and bounded."""

    def __init__(self, key: np.ndarray, n: np.ndarray, classes: dict[int, tuple[int, int]], ends: int):
        symbol = np.full(len(key), -1)
        top = np.lexsort((key, -n))[:SYMBOL_WORDS]
        symbol[top] = np.arange(1, len(top) + 1)
        order = np.argsort(key)
        self.key, self.n, self.symbol = key[order], n[order], symbol[order]
        self.words, self.symbols, self.ends = len(top), 1 + len(top) + CLASSES, ends
        tokens, kinds = (np.array([classes.get(c, (0, 0))[i] for c in range(CLASSES)], np.float64) for i in (0, 1))
        np.subtract.at(tokens, key[top] & (CLASSES - 1), n[top])
        np.subtract.at(kinds, key[top] & (CLASSES - 1), 1)
        self.class_log = np.log10(tokens + 0.5 * (kinds + 1))
        self.weight = np.concatenate(([ends], n[top], tokens)) + 0.5

    def tokens(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol and count of each word, and whether its count is known here."""
        if not len(self.key):
            return 1 + (key & (CLASSES - 1)), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = self.key[at] == key
        symbol = np.where(known, self.symbol[at], -1)
        return np.where(symbol < 0, 1 + self.words + (key & (CLASSES - 1)), symbol), np.where(known, self.n[at], 0), known


TOKENS = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, symbols binary, known bigint, total double, within double, tail array<bigint>, times array<bigint>"


def tokenised(docs: DataFrame, vocabulary) -> DataFrame:
    """A row a document: its symbols, what the head says of its words, and its other words with their counts there."""

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        uid = TaskContext.get().partitionId() << 40
        for batch in incoming:
            texts = text_array(batch.column("text"))
            for a, b in batches(texts):
                raw, off = text_bytes(texts.slice(a, b - a))
                starts, ends, first = bounds(raw, off)
                key = word_keys(raw, starts, ends)
                symbol, n, known = v.tokens(key)
                of_class = symbol > v.words
                log = np.where(known, np.log10(n + 0.5), 0.0)
                inside = np.where(of_class, log - v.class_log[key & (CLASSES - 1)], 0.0)
                doc = np.repeat(np.arange(b - a), np.diff(first))
                total = np.bincount(doc, log, b - a) + np.log10(v.ends + 0.5)
                within = np.bincount(doc, inside, b - a)
                count = np.bincount(doc, known, b - a).astype(np.int64) + (v.ends > 0)
                symbol = symbol.astype(np.uint16)
                cut, rest = first.tolist(), ~known
                tail, times = [], []
                for x, y in zip(cut, cut[1:]):
                    t, m = np.unique(key[x:y][rest[x:y]], return_counts=True)
                    tail.append(t)
                    times.append(m)
                place = pa.array(np.cumsum([0, *map(len, tail)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + b - a)),
                        batch.column("doc_id")[a:b].cast(pa.int64()),
                        batch.column("held_out")[a:b],
                        pa.array(np.diff(first) + 1),
                        pa.array([symbol[x:y].tobytes() + b"\0\0" for x, y in zip(cut, cut[1:])], pa.binary()),
                        pa.array(count),
                        pa.array(total),
                        pa.array(within),
                        pa.ListArray.from_arrays(place, pa.array(np.concatenate(tail), pa.int64())),
                        pa.ListArray.from_arrays(place, pa.array(np.concatenate(times), pa.int64())),
                    ],
                    names=[c.split()[0] for c in TOKENS.split(", ")],
                )
                uid += b - a
            give_back()

    return docs.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "text").mapInArrow(work, TOKENS)


class Hmm:
    """Start, transition and emission probabilities (emission: a row a symbol)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, weight: np.ndarray, states: int) -> Hmm:
        """Each state the unigram shares, stirred; states tend to stay."""
        stir = (stream(53, len(weight) * states) >> np.uint64(11)).astype(np.float64).reshape(-1, states) / (1 << 53)
        emit = weight[:, None] * (0.2 + 1.6 * stir)
        move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * 0.9
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def next(self, counts: dict[int, np.ndarray], weight: np.ndarray) -> Hmm:
        """Maximisation, with pseudo-counts that keep every probability above 0."""
        states = len(self.start)
        zero = np.zeros(states)
        emit = np.stack([counts.get(s, zero) for s in range(len(weight))]) + weight[:, None] / weight.sum() * 20
        move = np.stack([counts.get(-1 - k, zero) for k in range(states)]) + 0.1
        start = counts.get(-1 - states, zero) + 0.1
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def expected(model: Hmm, symbols: np.ndarray, mask: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, moves, emissions by symbol) of sequences, a row each, the first symbol of it always real.

    before, after: for segments of a longer sequence, the states' probabilities at the symbol before (a row that isn't above
    0 anywhere: there is none), and the likelihood of all that follows by the last state.
    """
    n, length = symbols.shape
    states = len(model.start)
    seen = model.emit[symbols.T]
    inner = np.zeros(n, bool) if before is None else before.any(1)
    alpha, scale = np.empty((length, n, states)), np.ones((length, n, 1))
    now = (model.start if before is None else np.where(inner[:, None], before @ model.move, model.start)) * seen[0]
    full = mask.all(0).tolist()
    for t in range(length):
        if t:
            now = (alpha[t - 1] @ model.move) * seen[t]
            if not full[t]:
                now = np.where(mask[:, t, None], now, alpha[t - 1])
        scale[t] = now.sum(1, keepdims=True)
        np.divide(now, scale[t], out=alpha[t])
    beta = np.ones((n, states)) if after is None else after / (alpha[-1] * after).sum(1, keepdims=True)
    moves = np.zeros((states, states))
    emit = np.zeros((len(model.emit), states))
    posterior = np.empty_like(alpha)
    posterior[-1] = alpha[-1] * beta
    for t in range(length - 1, 0, -1):
        ahead = seen[t] * beta / scale[t]
        if full[t]:
            moves += alpha[t - 1].T @ ahead
            beta = ahead @ model.move.T
        else:
            real = mask[:, t, None]
            moves += (alpha[t - 1] * real).T @ ahead
            beta = np.where(real, ahead @ model.move.T, beta)
        np.multiply(alpha[t - 1], beta, out=posterior[t - 1])
    if before is not None:
        moves += before[inner].T @ (seen[0] * beta / scale[0])[inner]
    flat = mask.T.ravel()
    of = symbols.T.ravel()[flat]
    p = posterior.reshape(-1, states)[flat]
    for k in range(states):
        emit[:, k] = np.bincount(of, p[:, k], len(emit))
    return posterior[0][~inner].sum(0), moves * model.move, emit


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as rows of one matrix, and where they are real."""
    size = np.array([len(t) for t in texts])
    mask = np.arange(size.max()) < size[:, None]
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.concatenate(texts)
    return out, mask


class Segments:
    """Long sequences in segments: what each does to the states' probabilities is a matrix, found for all segments of all sequences at once; only the chains of matrices are walked one by one."""

    def __init__(self, model: Hmm, texts: list[np.ndarray]):
        states = len(model.start)
        self.symbols, self.mask = padded([t[a : a + SEGMENT] for t in texts for a in range(0, len(t), SEGMENT)])
        first = np.cumsum([0, *(segments(t) for t in texts)])
        n = len(self.symbols)
        # Segments that are over stand at the end, so that a step takes those before them as they lie.
        size = self.mask.sum(1)
        order = np.argsort(-size, kind="stable")
        still = np.searchsorted(-size[order], -np.arange(self.symbols.shape[1]), "left")
        start = np.zeros(n, bool)
        start[first[:-1]] = True
        now = np.where(start[order, None, None], model.start, model.move)
        logs = np.zeros(n)
        for t, m in enumerate(still.tolist()):
            if t:
                np.matmul(now[:m].reshape(-1, states), model.move, out=step[: m * states])
                now[:m] = step[: m * states].reshape(m, states, states)
            else:
                step = np.empty((n * states, states))
            now[:m] *= model.emit[self.symbols[order[:m], t]][:, None, :]
            if t % 8 == 7 or t == len(still) - 1:
                scale = now.max((1, 2))
                now /= scale[:, None, None]
                logs += np.log10(scale)
        back = np.empty_like(order)
        back[order] = np.arange(n)
        now, logs = now[back], logs[back]
        self.before, self.after = np.zeros((n, states)), np.ones((n, states))
        self.log = np.zeros(len(texts))
        for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            at, log = now[a, 0], logs[a:z].sum()
            for k in range(a, z):
                if k > a:
                    self.before[k] = at
                    at = at @ now[k]
                total = at.sum()
                at, log = at / total, log + np.log10(total)
            self.log[i] = log
            for k in range(z - 1, a, -1):
                back = now[k] @ self.after[k]
                self.after[k - 1] = back / back.max()


def segments(text: np.ndarray) -> int:
    return -(-len(text) // SEGMENT)


def long_groups(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Indexes of sequences of over WHOLE tokens, in groups of about CELLS cells (a longer one alone)."""
    some, cells = [], 0
    for i, text in enumerate(texts):
        if len(text) > WHOLE:
            more = segments(text) * SEGMENT
            if some and cells + more > CELLS:
                yield some
                some, cells = [], 0
            some.append(i)
            cells += more
    if some:
        yield some


def groups(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Indexes of sequences of up to WHOLE tokens, by length, in groups of about CELLS cells."""
    order = [i for i in np.argsort([len(t) for t in texts], kind="stable").tolist() if len(texts[i]) <= WHOLE]
    a = 0
    for b in range(1, len(order) + 1):
        if b == len(order) or (b - a + 1) * len(texts[order[b]]) > CELLS:
            yield order[a:b]
            a = b


def all_expected(model: Hmm, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Expected counts of whole sequences, however long."""
    for some in groups(texts):
        yield expected(model, *padded([texts[i] for i in some]))
    most = max(1, CELLS // SEGMENT)
    for some in long_groups(texts):
        whole = Segments(model, [texts[i] for i in some])
        for a in range(0, len(whole.symbols), most):
            part = slice(a, a + most)
            yield expected(model, whole.symbols[part], whole.mask[part], whole.before[part], whole.after[part])


def sweep(tokens: DataFrame, model: Hmm, weight: np.ndarray) -> Hmm:
    """One step of Baum-Welch over all rows of `tokens`: partitions sum their expected counts, Spark sums the partitions'."""
    states = len(model.start)
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    names = [f"g{k}" for k in range(states)]

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = shared.value
        start, moves, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
        for batch in incoming:
            texts = [np.frombuffer(x, np.uint16) for x in batch.column("symbols").to_pylist()]
            for s, m, e in all_expected(model, texts):
                start, moves, emit = start + s, moves + m, emit + e
            give_back()
        used = np.flatnonzero(emit.any(1))
        rows = np.concatenate((emit[used], moves, start[None]))
        slot = np.concatenate((used, -1 - np.arange(states + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(slot), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(states))], names=["slot", *names])

    got = tokens.select("symbols").mapInArrow(work, "slot bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    counts = dict(zip(got["slot"].to_pylist(), np.stack([got[n].to_numpy() for n in names], axis=1) if got.num_rows else []))
    shared.unpersist()
    return model.next(counts, weight)


def log_likelihoods(model: Hmm, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability; sequences of up to WHOLE tokens a step at a time, longer ones by segments."""
    out = np.zeros(len(texts))
    for some in groups(texts):
        symbols, mask = padded([texts[i] for i in some])
        now, total = None, np.zeros(len(some))
        for t in range(symbols.shape[1]):
            real = mask[:, t]
            step = (model.start if t == 0 else now[real] @ model.move) * model.emit[symbols[real, t]]
            scale = step.sum(1)
            if now is None:
                now = np.zeros((len(some), len(model.start)))
            now[real] = step / scale[:, None]
            total[real] += np.log10(scale)
        out[some] = total
    for some in long_groups(texts):
        out[some] = Segments(model, [texts[i] for i in some]).log
    return out


def score_texts(docs: DataFrame, states: int = 8, warm_sweeps: int = 6, warm_share: float = 0.05, sweeps: int = 2) -> DataFrame:
    """log10 probabilities of all whole texts, learnt from documents whose crc32(doc_id as text) mod 5 is not 1.

    Tokens are words (runs of bytes other than space and 0x09-0x0D, A-Z lower-cased, known by 57 bits of their hash and a
    class of 6 bits), then one end. warm_sweeps over a share of the training documents, by hash of the id, place the
    states; sweeps over all of them follow.

    Returns doc_id, held_out, n_tokens, n_known (tokens whose training count is above 0), train_tokens, base_score (add-half
    unigram), score (the model's). Sequences are whole in training and scoring, however long: a long one is taken in segments
    with what comes before and after them. Null text is empty: one end. Each row has its own result and null ids train;
    without training documents base_score is 0. Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    train = docs.where(~held_out("doc_id", 5, 1))
    counts = written(count_words(train), "words")
    ends = sum(r["n"] for r in counts.where(F.col("key") == int(END)).collect())
    words = counts.where(F.col("key") != int(END))
    classes = {r["c"]: (r["n"], r["v"]) for r in words.groupBy(F.col("key").bitwiseAND(CLASSES - 1).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tokens, kinds = sum(n for n, _ in classes.values()) + ends, sum(v for _, v in classes.values()) + (ends > 0)
    head = words.orderBy(F.desc("n"), "key").limit(HEAD_WORDS).toArrow()
    vocabulary = Vocabulary(head["key"].to_numpy(), head["n"].to_numpy(), classes, ends)
    rows = written(tokenised(docs, spark.sparkContext.broadcast(vocabulary)), "tokens")
    fit_on = rows.where("NOT held_out")
    model = Hmm.first(vocabulary.weight, states)
    if ends:
        warm = written(fit_on.where(F.crc32(F.concat(F.lit("warm:"), F.coalesce(F.col("doc_id"), F.col("uid")).cast("string"))) < int(warm_share * (1 << 32))).select("symbols"), "warm")
        for _ in range(warm_sweeps):
            model = sweep(warm, model, vocabulary.weight)
        forget(warm)
        for _ in range(sweeps):
            model = sweep(fit_on, model, vocabulary.weight)
    shared = spark.sparkContext.broadcast(model)

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            if batch.num_rows:
                texts = [np.frombuffer(x, np.uint16) for x in batch.column("symbols").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(log_likelihoods(shared.value, texts))], names=[*batch.schema.names[:-1], "states"])

    columns = ["uid", "doc_id", "held_out", "n_tokens", "known", "total", "within"]
    kinds_of = dict(rows.dtypes)
    lengths = F.aggregate("times", F.lit(0).cast("bigint"), lambda s, x: s + x)
    scored = rows.select(*columns, lengths.alias("n_tail"), "symbols").mapInArrow(work, ", ".join(f"{c} {kinds_of[c]}" for c in columns) + ", n_tail bigint, states double")
    pairs = rows.select(F.col("uid").alias("t_uid"), F.explode(F.arrays_zip("tail", "times")).alias("p")).select("t_uid", F.col("p.tail").alias("t_key"), F.col("p.times").alias("t_times"))
    found = pairs.join(words, F.col("t_key") == F.col("key")).groupBy("t_uid").agg(F.sum(F.col("t_times") * (F.log10(F.col("n") + 0.5) - HALF)).alias("gain"), F.sum("t_times").alias("met"))
    out = scored.join(found, F.col("uid") == F.col("t_uid"), "left")
    tail = F.col("n_tail") * HALF + F.coalesce("gain", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("total") + tail - F.col("n_tokens") * float(np.log10(tokens + 0.5 * (kinds + 1)))).alias("base_score"),
        (F.col("states") + F.col("within") + tail).alias("score"),
    )
