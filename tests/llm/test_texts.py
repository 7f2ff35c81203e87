"""Near duplicates, repeated passages, words."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.llm import minhash, suffix, words
from siftstone.llm.common import text_array, text_bytes
from siftstone.llm.components import components, forest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_list(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def shingle_set(text, k):
    w = word_list(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes_by_force(texts, k, percent):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            inter = len(sets[a] & sets[b])
            if a < b and inter and 100 * inter >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in texts}


def near_copies(seed=1, base=60, copies=25):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for group in range(8):
        start = [r.choice(vocabulary) for _ in range(base)]
        for c in range(copies if group == 0 else 4):
            w = list(start)
            for _ in range(r.randrange(0, 7)):
                w[r.randrange(base)] = r.choice(vocabulary)
            texts[(n := n + 1)] = " ".join(w)
    return texts


EDGES = {101: None, 102: "", 103: " \n\t ", 104: "one", 105: "ONE", 106: "one two", 107: "a b c d e f g", 108: "A B c d e f g", 109: "x " * 30_000}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    texts = near_copies() | EDGES
    got = minhash.near_duplicates(docs(texts), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes_by_force(texts, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(texts)


def test_near_duplicates_null_ids_repeats_and_empty(docs):
    got = minhash.near_duplicates(docs([(None, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "a b c d")]), 3, 85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (2, 2, True), (2, 2, True), (3, 2, False)]
    assert minhash.near_duplicates(docs({}), 3, 85).count() == 0
    left = minhash.one_of_each(docs([(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "a b c d e"), (4, "z")]))
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 2, 4] and left.columns == docs({}).columns


def test_clusters_in_tiles(docs, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 4)
    texts = near_copies(3, 40, 60)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(texts), 3, 85).collect()}
    assert got == classes_by_force(texts, 3, 85)


def test_sets_move_once_and_tables_go_when_read(docs, monkeypatch):
    """Full sets go straight to their groups (no join moves them before), and tables of earlier steps are gone by the time components are placed."""
    plans, made, left = [], [], []

    def bundled(rows, by, *rest, f=minhash.bundled):
        if "shingles" in rows.columns:
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return f(rows, by, *rest)

    def written(df, name, f=minhash.written):
        if name == "placed":
            left.extend(n for n, path in made if os.path.isdir(path.removeprefix("file:")))
        out = f(df, name)
        made.append((name, out._siftstone_path.replace("file://", "file:")))
        return out

    monkeypatch.setattr(minhash, "bundled", bundled)
    monkeypatch.setattr(minhash, "written", written)
    texts = near_copies(3, 40, 60)
    again = [*texts.items(), (5, texts[5]), (5, texts[5])]
    got = minhash.near_duplicates(docs(again), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes_by_force(texts, 3, 85) and len(got) == len(again)
    assert plans and not any("Join" in p for p in plans)
    assert "members" in left and not {"signatures", "keys", "tables", "sets", "ends"} & set(left)


def test_background_overlap_stays_cheap(spark, monkeypatch):
    """Texts of similarity 0.05 to 0.2: few pairs are verified, though chains of tables may lie between them."""
    r = random.Random(4)
    pieces = [[f"p{p}w{k}" for k in range(12)] for p in range(30)]
    texts = {i: " ".join(w for p in r.sample(range(30), 5) for w in pieces[p]) + f" own{i} a{i} b{i}" for i in range(300)}
    seen = []
    monkeypatch.setattr(minhash, "verified", lambda pairs, *rest, f=minhash.verified: (seen.append(pairs.count()), f(pairs, *rest))[1])
    monkeypatch.setattr(minhash, "links_in_tiles", lambda chosen, *rest, f=minhash.links_in_tiles: (seen.append(chosen.count()), f(chosen, *rest))[1])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == classes_by_force(texts, 3, 85) and sum(seen) < 100


def test_rows_that_repeat_an_id_with_another_text(spark):
    same, other = "one two three four five six seven", "quite another text with nothing in common here"
    df = spark.createDataFrame([(1, same), (2, same), (2, other), (2, other), (3, other)], "doc_id bigint, text string")
    got = sorted((x["doc_id"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(df, 3, 85).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 2, False)]
    named = df.selectExpr("doc_id", "text", "1 AS text_hash", "2 AS same", "3 AS node", "4 AS __gone", "5 AS uid")
    left = minhash.one_of_each(named)
    assert left.columns == named.columns and sorted((x["doc_id"], x["text"]) for x in left.collect()) == [(1, same), (2, other)]


def test_long_words_and_texts(monkeypatch):
    """Hashes don't depend on the stretches in which bytes are read."""
    text = "ab " * 50 + "x" * 700 + " cd" * 300 + " " + "y" * 257
    raw, off = text_bytes(text_array(pa.array([text, "ab cd", None])))
    starts, ends, _ = words.bounds(raw, off)
    whole = words.hashes(raw, starts, ends)
    monkeypatch.setattr(words, "SPAN", 64)
    monkeypatch.setattr(words, "_powers", [])
    assert (words.hashes(raw, starts, ends) == whole).all()


def test_side_keeps_pairs_at_the_threshold():
    for s in (0.8, 0.85):
        side = minhash.side_for(s)
        q = s**minhash.HASHES
        assert 1 - (1 - (1 - q) ** side) ** 2 <= 1e-4 < 1 - (1 - (1 - q) ** (side - 1)) ** 2
        n = 2 * minhash.HASHES * side
        least = minhash.least_agreement(s, n)
        below = sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(least))
        assert below <= 1e-6 and 0.4 * n < least < s * n


@given(st.lists(st.text(alphabet="aB \n\té\x1c", max_size=12), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    raw, off = text_bytes(text_array(pa.array(texts, pa.string())))
    starts, ends, doc = words.bounds(raw, off)
    got = [[bytes(raw[starts[i] : ends[i]]).translate(LOWER) for i in range(doc[d], doc[d + 1])] for d in range(len(texts))]
    assert got == [word_list(t) for t in texts]
    h = words.hashes(raw, starts, ends)
    flat = [w for t in texts for w in word_list(t)]
    assert len(set(zip(h.tolist(), flat))) == len(set(flat)) == len(set(h.tolist()))


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_forest(pairs):
    i, j = np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
    root = list(range(13))
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    assert forest(i, j, 13).tolist() == root


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7)] + [(200, x) for x in range(201, 260)] + [(None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 90 for i in (90, 95, 100)} | {i: 200 for i in range(200, 260)}


def repeats_by_force(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        own = [data[p : p + length] for p in range(len(data) - length + 1)]
        gone = [False] * len(data)
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + length] = [True] * length
        seen.update(own)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def passages(seed=5):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice("abcdefgh éß") for _ in range(n))
    shared = [line(n) for n in (49, 50, 51, 80, 200)]
    texts = {i: line(r.randrange(0, 150)) + r.choice(shared) + line(r.randrange(0, 60)) + r.choice(shared) for i in range(60)}
    texts |= {70: None, 71: "", 72: "x" * 49, 73: "x" * 50, 74: "x" * 3000, 75: "x" * 900, 76: "word " * 400, 77: "word " * 300 + "end", 78: shared[4][:60], 79: texts[3]}
    return texts


def test_repeats(docs):
    texts = passages()
    got = suffix.remove_repeats(docs(texts).repartition(5), 50, with_text=True).collect()
    want = repeats_by_force(texts, 50)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert all(r["kept_text"] == texts[r["doc_id"]] for r in got if not r["n_removed"])


def test_repeats_null_ids_repeats_and_empty(docs):
    text = "z" * 80
    got = suffix.remove_repeats(docs([(None, text), (1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 80)]
    assert suffix.remove_repeats(docs({})).count() == 0


def test_repeated_ids_with_other_texts_keep_their_bytes(spark):
    rows = [(3, "0123456789" * 7), (3, "another text " + "x" * 60), (3, "another text " + "x" * 60), (5, "x" * 55), (9, "0123456789" * 6), (None, "x" * 80)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got) == [(0, 80, 0), (3, 70, 0), (3, 73, 0), (3, 73, 0), (5, 55, 55), (9, 60, 60)]
    named = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS `row`", "2 AS key", "3 AS carry_0", "4 AS r_id")
    assert suffix.without_repeats(named).columns == named.columns and suffix.without_repeats(named).count() == 6


def test_long_texts_in_stretches(docs, monkeypatch):
    monkeypatch.setattr(suffix, "SPAN", 64)
    monkeypatch.setattr(suffix, "BUCKETS", 16)
    raw, off = text_bytes(text_array(pa.array(["".join(random.Random(2).choice("abc") for _ in range(500)), "ab" * 90])))
    parts = suffix.anchors(raw, off, 50)
    monkeypatch.undo()
    assert all((a == b).all() for a, b in zip(parts, suffix.anchors(raw, off, 50)))


def test_negative_ids_are_earlier(docs):
    texts = {-7: "q" * 70, -1: "q" * 60, 3: "q" * 50 + "r"}
    got = suffix.remove_repeats(docs(texts)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == repeats_by_force(texts, 50)


def test_cut_texts_keep_columns_and_characters(docs):
    body = "é" * 40
    left = suffix.without_repeats(docs({1: "a" + body, 2: "bb" + body, 3: None}), 50)
    assert left.columns == docs({}).columns
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["keys"]) for r in left.collect()} == {1: ("a" + body, 41, "k"), 2: ("bb", 2, "k"), 3: (None, None, "k")}


@pytest.mark.parametrize("letters", ["ab", "a\x00\x03\x07"])
def test_bucket_refinement_is_equality(letters):
    r = random.Random(2)
    spans = ["".join(r.choice(letters) for _ in range(r.randrange(50, 120))).encode() for _ in range(30)]
    bucket = suffix.string_buckets(np.frombuffer(b"".join(spans), np.uint8), np.array([len(s) for s in spans]), 50)
    of, at = defaultdict(set), 0
    for s in spans:
        for p in range(len(s) - 49):
            of[int(bucket[at + p])].add(s[p : p + 50])
        at += len(s)
    assert all(len(x) == 1 for x in of.values()) and len({next(iter(x)) for x in of.values()}) == len(of)


def test_buckets_that_point_to_one_bucket_are_not_sorted_again(monkeypatch):
    r, sorted_places = random.Random(6), []
    copies = ["".join(r.choice("abcdefgh ") for _ in range(90)).encode()] * 40
    monkeypatch.setattr(suffix.np, "argsort", lambda x, *a, f=np.argsort, **b: (sorted_places.append(len(x)), f(x, *a, **b))[1])
    bucket = suffix.string_buckets(np.frombuffer(b"".join(copies), np.uint8), np.array([len(s) for s in copies]), 50)
    monkeypatch.undo()
    assert len(np.unique(bucket)) == 42 and (bucket.reshape(40, 90) == bucket[:90]).all()
    assert sum(sorted_places) <= 40 * 91


@pytest.mark.parametrize("length", [20, 50])
def test_bucket_refinement_of_mixed_buckets_in_stretches(monkeypatch, length):
    """Buckets that split beside buckets that don't, in stretches of every size; bytes as low as the marks of shorter rests."""
    r = random.Random(3)
    for letters in ("ab", "\x00", "\x00\x01\x07", "abcdefgh"):
        pool = ["".join(r.choice(letters) for _ in range(r.randrange(length, 150))).encode() for _ in range(6)]
        spans = [(p := r.choice(pool))[r.randrange(0, len(p) - length + 1) :] for _ in range(30)]
        for stretch in (4, 64, 1 << 16):
            monkeypatch.setattr(suffix, "BUCKETS", stretch)
            bucket = suffix.string_buckets(np.frombuffer(b"".join(spans), np.uint8), np.array([len(s) for s in spans]), length)
            of, at = defaultdict(set), 0
            for s in spans:
                assert (bucket[at + len(s) - length + 1 : at + len(s)] == 0).all()
                for p in range(len(s) - length + 1):
                    of[int(bucket[at + p])].add(s[p : p + length])
                at += len(s)
            assert all(len(x) == 1 for x in of.values()) and len({next(iter(x)) for x in of.values()}) == len(of)


@given(st.lists(st.integers(0, 1 << 62), max_size=30))
def test_squeeze(values):
    x = np.array(values, np.int64)
    assert (suffix.unsqueeze(suffix.squeeze(x)) == x).all()


def test_counts_by_matrix():
    r = random.Random(1)
    sets = [np.unique(np.array([r.randrange(50) for _ in range(r.randrange(0, 20))], np.int64)) for _ in range(12)]
    got = minhash.common_counts(sets[:5], sets[5:], block=7)
    assert got.tolist() == [[len(set(a) & set(b)) for b in map(np.ndarray.tolist, sets[5:])] for a in map(np.ndarray.tolist, sets[:5])]
    assert Counter(got.ravel().tolist())
