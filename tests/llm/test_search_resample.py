"""Ranked search and importance resampling against brute force, with ties, repeats, nulls and empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from kinema.llm import resample, search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_search(docs, items, k):
    known = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, n_terms = len(known), sum(len(w) for _, w in known)
    out = []
    for item in {i for i, _ in items}:
        terms = {w for i, t in items if i == item for w in words(t)}
        scores = []
        for doc_id, w in known:
            m = 10 + 90 * len(w) * n_docs // n_terms
            score = 0
            for term in terms:
                df = sum(term in x for _, x in known)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                tf = w.count(term)
                score += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "held", "first_of", "step"), [(3, 40, 4, 1), (10, 10**6, 16, 16), (5, 1, 1, 2)])
def test_search_equals_brute_force(spark, monkeypatch, k, held, first_of, step):
    monkeypatch.setattr(search, "POSTINGS_AT_ONCE", held)
    monkeypatch.setattr(search, "STEP", step)
    rng = random.Random(k)
    vocabulary = [*"abcdefgh", "É", "ñu", "x1", "Zz"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(120)]
    docs += [(200 + i, docs[7][1]) for i in range(15)]  # ties by the dozen
    docs += [(5, docs[5][1]), (5, "a b c"), (None, "a b c d"), (300, None), (301, ""), (302, " .,! "), (303, "a " * 5000), (-4, "zZ É")]
    items = [(i, text(rng.randint(1, 8))) for i in range(12)] + [(3, "É extra"), (50, None), (51, ""), (52, "unknown words"), (53, "a"), (None, "ñu b")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item string")
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    made = search.ranked_search(d, q, k, first_of=first_of)
    assert made.columns == ["item_id", "rank", "doc_id", "score", "accesses"]
    want = brute_search(docs, items, k)
    assert sorted(map(tuple, made.drop("accesses").collect()), key=str) == want
    blocks = search.ranked_search(d, q, k, terms_at_once=9, first_of=first_of).drop("accesses")
    assert sorted(map(tuple, blocks.collect()), key=str) == want


def test_search_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    q = spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert search.ranked_search(d.limit(0), q).count() == 0
    assert search.ranked_search(d.where("doc_id = 2"), q).count() == 0
    assert search.ranked_search(d, q.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in search.ranked_search(d, q).collect()] == [] or search.term_weight(1, 1) > 0


def lists_of(impacts):
    """impacts: {term: {row: impact}}"""
    flat = [(r, t, v) for t, x in impacts.items() for r, v in x.items()]
    row, term, impact = (np.array(x, np.int64) for x in zip(*flat, strict=True))
    n = int(row.max()) + 1
    return search.ImpactLists(np.arange(n, dtype=np.int64), row, term, impact, max(impacts) + 1)


def test_best_positions_stop_early_and_exactly():
    rng = random.Random(4)
    for turn in range(60):
        n, terms = rng.randint(1, 400), rng.randint(1, 5)
        impacts = {t: {r: rng.choice([1, 2, 2, 3, rng.randint(1, 50), rng.randint(1, 50)]) for r in range(n) if rng.random() < 0.7} or {0: 1} for t in range(terms)}
        lists, k = lists_of(impacts), rng.randint(1, 12)
        ids, scores, _ = lists.best(np.arange(terms), k, 0)
        total = {r: sum(x.get(r, 0) for x in impacts.values()) for r in range(n)}
        want = sorted(((-s, r) for r, s in total.items() if s > 0))[:k]
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want, turn
    # two lists in the same order: direct access sees the head of both, and the search stops long before their ends
    many = {t: {r: 10_000 - r for r in range(10_000)} for t in range(2)}
    _, _, accesses = lists_of(many).best(np.arange(2), 10, 0)
    assert accesses < 500
    # equal scores to the end: stopping at or below the k-th score would lose ids, so all are read
    flat = {0: {r: 7 for r in range(3_000)}}
    ids, _, accesses = lists_of(flat).best(np.array([0]), 5, 0)
    assert ids.tolist() == [0, 1, 2, 3, 4] and accesses == 3_000


def test_length_units_beyond_64_bits():
    n = np.array([1, 10**9, 3 * 10**9], np.int64)
    assert search.length_units(n, 10**9, 10**12).tolist() == [10 + 90 * x * 10**9 // 10**12 for x in n.tolist()]


def brute_resample(docs, target, run, buckets, least, percent, seed):
    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    s, t = [b for _, x in docs for b in features(x)], [b for x in target for b in features(x)]
    gain = [math.floor(1000 * math.log((t.count(b) + 1) * (len(s) + buckets) / ((s.count(b) + 1) * (len(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features(x))
        rows.append([i, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    ranks = {id(r): k for k, r in enumerate(drawn, 1)}
    return sorted([(*r[:4], ranks.get(id(r))) for r in rows], key=str)


@pytest.mark.parametrize(("run", "dictionary", "percent"), [(1, 10**5, 10), (3, 10**5, 50), (2, 4, 100), (2, 0, 30)])
def test_resample_equals_brute_force(spark, monkeypatch, run, dictionary, percent):
    monkeypatch.setattr(resample, "RANKED_A_TASK", 9)
    rng = random.Random(run)
    vocabulary = ["a", "B", "cc", "é", "日本", "x1y", "long" * 20, "d", "e"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(70)] + [(100, None), (101, ""), (102, " . "), (3, docs_text := text(25)), (3, docs_text), (None, text(22)), (103, "a " * 9000)]
    target = [text(rng.randint(1, 20)) for _ in range(9)] + [None, "", "only in the target"]
    d = spark.createDataFrame([(i, t, 5, "w") for i, t in docs], "doc_id long, text string, rank int, weight string")
    q = spark.createDataFrame([(t,) for t in target], "text string")
    made = resample.importance_resample(d, q, run=run, buckets=97, least_words=5, percent=percent, dictionary=dictionary)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, made.collect()), key=str) == brute_resample(docs, target, run, 97, 5, percent, 2024)


def test_resample_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b " * 20), (2, "c")], "doc_id long, text string")
    assert resample.importance_resample(d.limit(0), d).count() == 0
    rows = {r.doc_id: r for r in resample.importance_resample(d, d.select("text").limit(0), percent=100).collect()}
    assert rows[1]["rank"] == 1 and rows[2]["rank"] is None and rows[1].n_features == 40


def test_composed_checksums():
    rng = random.Random(8)
    w = [rng.randbytes(rng.choice([1, 2, 3, 7, 64, 1000, 70_000])) for _ in range(30)]
    crc, length = np.array([zlib.crc32(x) for x in w], np.uint64), np.array([len(x) for x in w], np.int64)
    want = [zlib.crc32(b" ".join(w[i : i + n])) for n in range(1, 5) for i in range(len(w) - n + 1)]
    assert resample.compose(crc, length, 4).tolist() == want
    assert resample.compose(crc[:2], length[:2], 4).tolist() == [*crc[:2].tolist(), zlib.crc32(w[0] + b" " + w[1])]
