"""Classifiers and the language model, on held-out accuracy, exact figures and edge rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftstone.llm import hmm, language, quality, toxicity

EDGES = [(None, "some words here"), (900001, None), (900002, ""), (900003, "123 !!"), (900004, "x " * 40_000), (900005, "same"), (900005, "same")]


def word_list(text):
    folded = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(folded))


def held(i, m, k):
    return zlib.crc32(str(i).encode()) % m == k


def test_quality(spark, docs):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["river", "stone", "walked", "under", "a", "the", "green"]) for _ in range(60)) + "."
    bad = lambda: "!! ".join(r.choice(["BUY", "NOW", "FREE", "CLICK"]) for _ in range(60))
    texts = [(i, good() if i % 3 else bad()) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(240)] + [(None, 1, 1), (5, None, None), (777777, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score_quality(docs(texts + EDGES), labels).collect()
    assert len(got) == len(texts) + len(EDGES)
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) and r["held_out"] == held(r["doc_id"], 3, 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 1000)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    nothing = quality.score_quality(docs(EDGES), labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5} and quality.score_quality(docs([]), labels).count() == 0


def test_toxicity(spark, docs):
    r = random.Random(2)
    plain = lambda: [r.choice([f"w{k}" for k in range(50)]) for _ in range(40)]
    texts = []
    for i in range(300):
        w = plain()
        for _ in range([0, 1, 3, 8][i % 4]):
            w[r.randrange(40)] = r.choice(["vile!", "Nasty", "foul,"])
        texts.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, 1, int(i % 4 > 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(texts + EDGES[1:5]), labels).collect()}
    assert np.mean([got[i]["predicted"] == int(i % 4 > 0) for i in range(300) if held(i, 3, 1)]) > 0.95
    by_kind = [np.mean([got[i]["severity"] for i in range(k, 300, 4)]) for k in range(4)]
    assert by_kind == sorted(by_kind) and by_kind[3] > by_kind[1] + 0.5
    assert all(got[i]["predicted"] == 0 for i in (900001, 900002, 900003, 900004))
    assert {r["score"] for r in toxicity.score_toxicity(docs(EDGES), labels.where("toxic = 1")).collect()} == {0.0}
    assert toxicity.score_toxicity(docs([]), labels).count() == 0


def plain_words(text):
    """Words of toxicity features from their definition: ASCII marks part words, A-Z are folded."""
    return [w for w in re.split(r"[ \t-\r!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def plain_related(bags, toxic, least, z):
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    c1, c0 = Counter(w for b, y in zip(bags, toxic) if y for w in b), Counter(w for b, y in zip(bags, toxic) if not y for w in b)
    out = {}
    for w in set(c1) | set(c0):
        p = (c1[w] + c0[w]) / (n1 + n0)
        s = (c1[w] / n1 - c0[w] / n0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        if abs(s) >= z and c1[w] + c0[w] >= least:
            out[w] = s
    return out


def test_toxicity_against_a_plain_version(spark, docs):
    r = random.Random(5)
    texts = []
    for i in range(400):
        w = [r.choice([f"w{k}" for k in range(30)]) for _ in range(30)]
        for _ in range(r.randrange(1, 9) if i % 2 else 0):
            w[r.randrange(30)] = r.choice(["vile!", "Nasty", "foul,bad", "rot"])
        texts.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(texts), labels).collect()}

    mine = [(i, Counter(plain_words(t))) for i, t in texts if not held(i, 3, 1)]
    bags, toxic = [b for _, b in mine], [i % 2 for i, _ in mine]
    fold = [zlib.crc32(f"grade:{i}".encode()) % toxicity.FOLDS for i, _ in mine]
    assert {"vile", "nasty", "foul", "bad", "rot"} == set(plain_related(bags, toxic, 5, 5.0))

    def fitted(use, prior, steps):
        """Words, weights and thresholds from the documents at these places."""
        known = sorted(plain_related([bags[j] for j in use], [toxic[j] for j in use], 5, 5.0))
        grade = dict.fromkeys(use, 0)
        for f in {fold[j] for j in use}:
            others = [j for j in use if fold[j] != f]
            signs = plain_related([bags[j] for j in others], [toxic[j] for j in others], 5, 5.0)
            load = {j: math.fsum(math.log1p(n) * max(signs.get(w, 0), 0) for w, n in bags[j].items()) for j in use if fold[j] == f and toxic[j]}
            cuts = np.quantile(list(load.values()), [1 / 3, 2 / 3])
            grade |= {j: 1 + sum(x > c + 1e-9 for c in cuts) for j, x in load.items()}
        cells = [(k, known.index(x), math.log1p(n)) for k, j in enumerate(use) for x, n in bags[j].items() if x in known]
        return known, *toxicity.fit_ordinal(*map(np.array, zip(*cells)), np.array([grade[j] for j in use]), np.ones(len(use)), len(known), 4, steps=steps, prior=prior)

    def likelihood(prior):
        total = 0.0
        for f in range(toxicity.FOLDS):
            names, w, t = fitted([j for j in range(len(mine)) if fold[j] != f], prior, toxicity.TRIAL_STEPS)
            for j in (j for j in range(len(mine)) if fold[j] == f):
                above = 1 / (1 + math.exp(t[0] - sum(math.log1p(n) * w[names.index(x)] for x, n in bags[j].items() if x in names)))
                total += math.log(max(above if toxic[j] else 1 - above, 1e-9))
        return total

    names, w, t = fitted(list(range(len(mine))), max(toxicity.PRIORS, key=likelihood), 1000)
    known = set(names)
    for i, text in texts:
        line = sum(math.log1p(n) * w[names.index(x)] for x, n in Counter(plain_words(text)).items() if x in known)
        above = [1 / (1 + math.exp(c - line)) for c in t]
        assert abs(got[i]["score"] - above[0]) < 1e-4 and abs(got[i]["severity"] - sum(above)) < 1e-3


def test_ordinal_thresholds_are_ordered_and_shared():
    r = np.random.default_rng(1)
    x = r.normal(size=2000)
    grade = np.digitize(2 * x + r.logistic(size=2000), [-1, 0.5, 2])
    w, t = toxicity.fit_ordinal(np.arange(2000), np.zeros(2000, int), x, grade, np.ones(2000), 1, 4)
    assert abs(w[0] - 2) < 0.3 and (np.diff(t) > 0).all() and np.abs(t - [-1, 0.5, 2]).max() < 0.4
    above, expected, _ = toxicity.predict(np.array([-5.0, 0.0, 5.0]), t)
    assert (np.diff(above) > 0).all() and (np.diff(expected) > 0).all() and 0 <= expected.min() and expected.max() <= 3


def tongue(seed, letters):
    r = random.Random(seed)
    stems = ["".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(40)]
    return lambda n: " ".join(r.choice(stems) for _ in range(n))


def test_language(spark, docs):
    a, b = tongue(1, "abcdefgh"), tongue(2, "ghijklmné")
    both = docs([(i, a(30)) for i in range(0, 400, 2)], "aa").union(docs([(i, b(30)) for i in range(1, 400, 2)], "bb")).union(docs([(i, "ignored") for i in range(500, 510)], None))
    got = language.identify(both.union(docs(EDGES, None)).union(docs([(600, "ω" * 300), (601, "7!")], None))).collect()
    one = {r["doc_id"]: r for r in got}
    assert len(got) == 400 + 10 + len(EDGES) + 2
    assert all(one[i]["lang_pred"] == ("bb" if i % 2 else "aa") and one[i]["held_out"] == held(i, 4, 2) and not one[i]["rejected"] for i in range(400))
    assert [one[i]["lang_pred"] for i in (900001, 900002, 900003, 601)] == ["und"] * 4 and one[600]["rejected"] and one[601]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = language.identify(docs(EDGES, None)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and language.identify(docs([])).count() == 0
    left = language.recognised(both)
    assert left.columns == both.columns and left.where("doc_id < 400").count() == 400


def test_rejection_keeps_to_its_rate():
    r = np.random.default_rng(7)
    k, length = r.integers(0, 3, 3000), r.integers(20, 4000, 3000)
    draw = lambda k, length: 1.5 + 0.1 * k + r.standard_t(4, len(k)) * (0.03 + 1.0 / np.sqrt(length))
    nats = draw(k, length)
    for rate in (0.001, 0.01, 0.1):
        limits = language.limits_of(k, nats, length, 3, rate)
        beyond = nats > limits[k, 0] + limits[k, 1] / np.sqrt(length)
        assert beyond.sum() == 3000 - math.ceil(3001 * (1 - rate))
        new_k, new_length = r.integers(0, 3, 50_000), r.integers(20, 4000, 50_000)
        new = draw(new_k, new_length)
        assert (new > limits[new_k, 0] + limits[new_k, 1] / np.sqrt(new_length)).mean() < 2 * rate + 0.001
    few = language.limits_of(k[:50], nats[:50], length[:50], 5, 0.001)
    assert (few[3:] == [math.log(language.CLASSES), 0]).all() and not (nats[:50] > few[k[:50], 0] + few[k[:50], 1] / np.sqrt(length[:50])).any()
    assert language.limits_of(k[:0], nats[:0], length[:0], 2, 0.001).shape == (2, 2)


def test_language_of_one_document_is_learnt(spark, docs):
    a, b = tongue(3, "abcdefgh"), tongue(4, "ijklmnop")
    fold = next(i for i in range(1000, 2000) if zlib.crc32(f"fold:{i}".encode()) % 5 == 0 and not held(i, 4, 2))
    both = docs([(i, a(30)) for i in range(100)], "aa").union(docs([(fold, b(300))], "bb")).union(docs([(2001, "12 34")], "cc"))
    got = {r["doc_id"]: r for r in language.identify(both.union(docs([(3000, b(40)), (3001, a(40))], None))).collect()}
    assert got[3000]["lang_pred"] == "bb" and got[3001]["lang_pred"] == "aa" and got[2001]["lang_pred"] == "und"
    assert not got[3000]["rejected"] and not got[fold]["rejected"] and {r["lang_pred"] for r in got.values()} == {"aa", "bb", "und"}


def kneser_ney(counts, order):
    """Interpolated Kneser-Ney from its definition, by dictionaries of tuples; counts of the highest order."""
    tables, discounts = [dict(counts)], []
    for _ in range(order - 1):
        lower = Counter(g[1:] for g in tables[-1])
        tables.append(dict(lower))
    for t in tables:
        once, twice = max(sum(v == 1 for v in t.values()), 1), max(sum(v == 2 for v in t.values()), 1)
        discounts.append(once / (once + 2 * twice))

    def p(gram):
        if not gram:
            return 1 / language.CLASSES
        level = order - len(gram)
        t, d = tables[level], discounts[level]
        near = {g: v for g, v in t.items() if g[:-1] == gram[:-1]}
        low = p(gram[1:])
        return (max(near.get(gram, 0) - d, 0) + d * len(near) * low) / sum(near.values()) if near else low

    return p


def test_kneser_ney_by_definition():
    import pyarrow as pa

    packed, _, _ = language.grams(pa.array(["abc abd abcab", "cab bad dab"], pa.large_string()))
    keys, n = np.unique(packed, return_counts=True)
    tup = lambda g: tuple(int(g >> (10 * k)) & 1023 for k in (3, 2, 1, 0))
    p = kneser_ney({tup(int(g)): int(c) for g, c in zip(keys, n)}, 4)
    asked, _, _ = language.grams(pa.array(["abc dab zz"], pa.large_string()))
    got = language.Model(keys, n).log_probability(asked)
    assert np.allclose(got, [math.log(p(tup(int(g)))) for g in asked])


def plain_limits(told, names):
    """Limits of languages from kept-out documents (language, nats, length): sorted deviations in units of their spread."""
    spread, out = {}, {}
    for name in {x[0] for x in told}:
        long = [n for k, n, size in told if k == name and size >= 200] or [n for k, n, _ in told if k == name]
        mid = float(np.median(long))
        spread[name] = mid, max(1.4826 * float(np.median([abs(n - mid) for n in long])), language.LEAST_SPREAD)
    far = sorted((n - spread[k][0]) / (spread[k][1] + language.SURPRISE / math.sqrt(size)) for k, n, size in told)
    most = 2 * max(far[-1], 2.5)  # fewer than a thousand: no rank is so high
    for name in names:
        out[name] = (spread[name][0] + most * spread[name][1], most * language.SURPRISE) if name in spread else (math.log(language.CLASSES), 0.0)
    return out


def test_language_of_the_query_by_force(docs):
    import functools

    import pyarrow as pa

    speak = {"aa": tongue(3, "abcdefgh"), "bb": tongue(4, "ijklmnop"), "cc": tongue(5, "efghijkl")}
    texts = [(i, speak[lang](3 + i % 40), lang) for i in range(150) for lang in [sorted(speak)[i % 3]]]
    twice = speak["aa"](20) + " qrst"
    near = next(i for i in range(2000, 3000) if not held(i, 4, 2))
    more = next(i for i in range(near + 1, 3000) if not held(i, 4, 2))
    texts += [(near, twice, "ya"), (more, twice, "xa")]  # two languages with one and the same text
    asked = [(4000, twice, None), (4001, speak["bb"](1)[:3], None), (4002, "wxyz " * 60, None), (4003, "12 34 !", None), (4004, None, None), (4005, "Abc Éfg ßß", None), (4006, speak["cc"](700), None)]
    rows = texts + asked
    made = docs([]).sparkSession.createDataFrame([(i, t, lang, "s", None, "k", "c") for i, t, lang in rows], docs([]).schema)
    got = {r["doc_id"]: r for r in language.identify(made).collect()}

    tuples = lambda text: [tuple(int(g >> (10 * k)) & 1023 for k in (3, 2, 1, 0)) for g in language.grams(pa.array([text], pa.large_string()))[0].tolist()]
    letter = lambda text: text is not None and any(c.isalpha() for c in text)
    learnt = [(i, t, lang) for i, t, lang in texts if not held(i, 4, 2)]
    names = sorted({lang for _, _, lang in learnt})
    few = {n for n in names if sum(lang == n for _, _, lang in learnt) < language.FEWEST}
    out = lambda i, lang: lang not in few and zlib.crc32(f"fold:{i}".encode()) % 5 == 0
    models = {n: functools.cache(kneser_ney(Counter(g for i, t, lang in learnt if lang == n and not out(i, lang) for g in tuples(t)), 4)) for n in names}
    nats = lambda text, n: -math.fsum(math.log(models[n](g)) for g in tuples(text)) / len(tuples(text))
    limits = plain_limits([(lang, nats(t, lang), len(tuples(t))) for i, t, lang in learnt if out(i, lang)], names)
    for i, text, _ in rows:
        r = got[i]
        assert r["held_out"] == held(i, 4, 2)
        if not letter(text):
            assert (r["lang_pred"], r["score"], r["rejected"], r["cross_entropy"]) == ("und", 0.0, True, None)
            continue
        each = {n: nats(text, n) for n in names}
        best = min(names, key=lambda n: (round(each[n], 9), n))
        size = len(tuples(text))
        assert r["lang_pred"] == best and abs(r["cross_entropy"] - each[best]) < 1e-6
        assert abs(r["score"] - 1 / math.fsum(math.exp(-(each[n] - each[best]) * min(size, 100)) for n in names)) < 1e-6
        base, more = limits[best]
        assert r["rejected"] == (each[best] > base + more / math.sqrt(size))
    assert got[4000]["lang_pred"] == "xa" and got[4002]["rejected"] and not got[4006]["rejected"]


def test_samples_have_one_row_an_id(spark, docs):
    from pyspark.sql import functions as F

    many = docs([(1, f"text {k:05}") for k in range(3000)] + [(2, None), (2, "b"), (3, None), (4, "d"), (None, "n")])
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 4)] + [(4, 1), (None, 1)], "doc_id bigint, quality int")
    got = sorted(tuple(r) for r in quality.labelled_sample(many, labels, "quality", 10, F.lit(True)).collect())
    assert got == [(1, 1, "text 00000"), (2, 0, "b"), (3, 1, None), (4, 1, "d")]


def test_score_and_base(docs):
    r = random.Random(3)
    texts = [(i, " ".join(r.choice([["le", "la", "Une", "des"], ["the", "of", "and", "To"]][i % 2] + ["x" + str(r.randrange(400))]) for _ in range(r.randrange(0, 90)))) for i in range(300)] + EDGES
    got = hmm.score_texts(docs(texts), states=4).collect()
    train = Counter()
    for i, t in texts:
        if i is None or not held(i, 5, 1):
            train.update([*word_list(t), None])
    total, low = sum(train.values()), sum(train.values()) + 0.5 * (len(train) + 1)
    want = Counter()
    for i, t in texts:
        w = [*word_list(t), None]
        want[(i, i is not None and held(i, 5, 1), len(w), sum(train[x] > 0 for x in w), total, round(sum(math.log10((train[x] + 0.5) / low) for x in w), 5))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    out = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert hmm.score_texts(docs([])).count() == 0


def test_forward_by_enumeration():
    r = np.random.default_rng(4)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Hmm(norm(r.random(3), 0), norm(r.random((3, 3)), 1), norm(r.random((5, 3)), 0))
    texts = [np.array(t, np.uint16) for t in ([0], [1, 2], [4, 3, 0, 1], [2, 2, 2])]

    def force(t):
        total = 0.0
        for path in np.ndindex(*[3] * len(t)):
            p = model.start[path[0]] * model.emit[t[0], path[0]]
            for k in range(1, len(t)):
                p *= model.move[path[k - 1], path[k]] * model.emit[t[k], path[k]]
            total += p
        return math.log10(total)

    assert np.allclose(hmm.log_likelihoods(model, texts), [force(t) for t in texts])


def test_baum_welch_never_falls():
    r = np.random.default_rng(5)
    symbols = np.where(np.arange(64)[None] < 32, r.integers(0, 3, (40, 64)), r.integers(3, 6, (40, 64)))
    mask = np.arange(64)[None] < r.integers(1, 65, (40, 1))
    weight = np.bincount(symbols[mask], minlength=6) + 0.5
    model, last = hmm.Hmm.first(weight, 2), -np.inf
    for _ in range(8):
        now = hmm.log_likelihoods(model, [s[m].astype(np.uint16) for s, m in zip(symbols, mask)]).sum()
        assert now >= last - 1.0  # pseudo-counts allow a little
        last = now
        start, moves, emit = hmm.expected(model, symbols, mask)
        assert np.isclose(emit.sum(), mask.sum()) and np.isclose(moves.sum(), mask.sum() - 40) and np.isclose(start.sum(), 40)
        model = model.next(dict(enumerate(emit)) | {-1 - k: m for k, m in enumerate(moves)} | {-3: start}, weight)


def test_long_sequences_are_whole(monkeypatch):
    """Segments give what one pass over the whole sequence gives: likelihoods, starts, moves over the cuts, emissions."""
    r = np.random.default_rng(6)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Hmm(norm(r.random(3), 0), norm(r.random((3, 3)) ** 4, 1), norm(r.random((5, 3)), 0))
    texts = [r.integers(0, 5, n).astype(np.uint16) for n in (1, 6, 7, 8, 50, 91)]
    total = lambda: [sum(x) for x in zip(*hmm.all_expected(model, texts))]
    want, scores = total(), hmm.log_likelihoods(model, texts)
    monkeypatch.setattr(hmm, "WHOLE", 5)
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    monkeypatch.setattr(hmm, "CELLS", 28)
    assert all(np.allclose(a, b) for a, b in zip(total(), want)) and np.allclose(hmm.log_likelihoods(model, texts), scores)
    assert np.isclose(want[1].sum(), sum(len(t) - 1 for t in texts)) and np.isclose(want[0].sum(), len(texts))


def test_score_of_the_query_by_force(docs, monkeypatch):
    """score: the likelihood of the symbols, and for each word of a class its smoothed share of the class."""
    models, known = [], []
    monkeypatch.setattr(hmm, "HEAD_WORDS", 30)
    monkeypatch.setattr(hmm, "SYMBOL_WORDS", 10)
    monkeypatch.setattr(hmm, "sweep", lambda *a, f=hmm.sweep: (models.append(f(*a)), models[-1])[1])
    monkeypatch.setattr(hmm.Vocabulary, "__init__", lambda self, *a, f=hmm.Vocabulary.__init__: (f(self, *a), known.append(self))[0])
    r = random.Random(8)
    texts = {i: " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(r.randrange(0, 60))) for i in range(120)}
    got = {x["doc_id"]: x["score"] for x in hmm.score_texts(docs(texts), states=3).collect()}
    model, v = models[-1], known[-1]
    key = lambda w: int(hmm.word_keys(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    train = Counter(key(w) for i, t in texts.items() if not held(i, 5, 1) for w in word_list(t))
    symbols = {int(k): int(s) for k, s in zip(v.key, v.symbol) if s >= 0}
    for i, t in texts.items():
        keys, total = [key(w) for w in word_list(t)], 0.0
        of_class = lambda k: [n for x, n in train.items() if x % 64 == k % 64 and x not in symbols]
        for k in keys:
            if k not in symbols:
                total += math.log10((train[k] + 0.5) / (sum(of_class(k)) + 0.5 * (len(of_class(k)) + 1)))
        now = model.start
        for n, s in enumerate([symbols.get(k, 1 + v.words + k % 64) for k in keys] + [0]):
            now = (now if n == 0 else now @ model.move) * model.emit[s]
        assert abs(got[i] - total - math.log10(now.sum())) < 1e-6


@pytest.mark.parametrize("text, n", [("", 0), ("a!b", 3), ("Éa", 2)])
def test_grams(text, n):
    import pyarrow as pa

    assert len(language.grams(pa.array(["zz", text], pa.large_string()))[0]) == 2 + n


def test_votes_by_force():
    """Cosines in double precision, the k nearest by (cosine, order), votes by similarity; batches don't matter."""
    import pyarrow as pa

    from siftstone.llm import quality
    from siftstone.llm.common import text_array, text_bytes

    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "beta", "GAMMA", "4711", "!?"]) for _ in range(r.randrange(0, 30))) for _ in range(40)]
    of = lambda t: quality.features(*text_bytes(text_array(pa.array(t)))).astype(float)
    rng = np.random.default_rng(1)
    near = rng.normal(size=(30, 6))
    near[7] = near[3]
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    model = {"idf": rng.random(quality.WIDTH), "basis": rng.normal(size=(quality.WIDTH, 6)), "near": near, "y": (np.arange(30) % 3 == 0).astype(float), "weight": rng.random(30), "prior": np.array(0.4)}
    got = quality.vote(model, *text_bytes(text_array(pa.array(texts))), 5, 4.0)
    for i, t in enumerate(texts):
        x = np.log1p(of([t])[0]) * model["idf"]
        z = (x / max(np.linalg.norm(x), 1e-12)) @ model["basis"]
        z = z / max(np.linalg.norm(z), 1e-12)
        cosine = [float(z @ v) for v in near]
        best = sorted(range(30), key=lambda k: (-round(cosine[k], 9), k))[:5]
        w = [max(cosine[k], 0) ** 4 * model["weight"][k] for k in best]
        assert abs(got[i] - (sum(a * model["y"][k] for a, k in zip(w, best)) + 1e-3 * 0.4) / (sum(w) + 1e-3)) < 1e-9
    one = np.concatenate([quality.vote(model, *text_bytes(text_array(pa.array([t]))), 5, 4.0) for t in texts])
    assert np.abs(one - got).max() < 1e-12
