"""Near-dedup of the pipeline against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from kinema.llm import near, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return {d for i, (d, _) in enumerate(docs) if d is not None and least[root(i)] == d}, sum(d is None and root(i) not in least for i, (d, _) in enumerate(docs))


def edited(rng, words, k):
    words = list(words)
    for at in rng.sample(range(len(words)), k):
        words[at] = f"e{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("pivots", [near.PIVOTS, (1, 64)])
def test_near_dedup(spark, monkeypatch, pivots):
    monkeypatch.setattr(near, "PIVOTS", pivots)
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(30)]
    texts = [None, "", " \n", "a b", "A  b", "one two three four five", "one two three four five six"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 150))] + (passage if rng.random() < 0.5 else [])
        texts += [edited(rng, base, rng.randint(0, 4)) for _ in range(rng.randint(1, 5))]
    hot = [word() for _ in range(200)]
    texts += [edited(rng, hot, rng.randint(1, 6)) for _ in range(25)]
    ids = rng.sample(range(1000), len(texts))
    docs = list(zip(ids, texts, strict=True)) + [(None, texts[-1]), (None, "only here without an id"), (None, "Only here without an id")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, key int")
    out = corpus_pipeline.near_dedup(spark, df, "").collect()
    ids, blank = brute(docs)
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(ids)
    assert sum(r.doc_id is None for r in out) == blank == 2
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_near_copy_of_other_fingerprint(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 3000)}" for _ in range(120)]
    a, b = " ".join(words), edited(rng, words, 2)
    assert 9 * len(shingles(a) & shingles(b)) >= 4 * (len(shingles(a)) + len(shingles(b)))
    assert (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 2
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), "").collect()
    assert [r.doc_id for r in out] == [1]


def test_near_dedup_of_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids, _ = brute([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "").select("doc_id").collect()) == sorted(ids)


def pairs_at_the_limit(rng, n, pairs):
    """Pairs of shingle sets of exactly 0.8 similarity: one within the other, and both of one size."""
    for _ in range(pairs):
        values = np.unique(rng.integers(0, 1 << 63, 3 * n + 9, dtype=np.uint64))
        rng.shuffle(values)
        if n % 4 == 0:
            yield np.sort(values[:n]), np.sort(values[: n + n // 4])
        if n % 9 == 0:
            both = values[: n * 8 // 9]
            yield np.sort(np.concatenate([both, values[n : n + n // 9]])), np.sort(np.concatenate([both, values[2 * n : 2 * n + n // 9]]))


def are_candidates(a, b):
    differ = sum(int(x ^ y).bit_count() for x, y in zip(near.fingerprint(a).view(np.uint64), near.fingerprint(b).view(np.uint64), strict=True))
    return len(np.intersect1d(near.block_words(a), near.block_words(b))) > 0 and differ <= (near.MEDIUM_DISTANCE if min(len(a), len(b)) <= near.MEDIUM else near.DISTANCE)


@pytest.mark.parametrize("n", [4, 8, 9, 12, 16, 18, 20, 24, 28, 36, 100, 108, 1000, 4000])
def test_recall_at_the_limit(n):
    """Over 99 of 100 pairs of just 0.8, one within the other or even, are candidates, at any size; small ones by construction."""
    found = [are_candidates(a, b) for a, b in pairs_at_the_limit(np.random.default_rng(n), n, 400 if n < 1000 else 150)]
    assert np.mean(found) >= 0.99, np.mean(found)


def test_short_texts_by_brute_force(spark):
    """Texts of 5 to 16 words with a word appended, or one changed at the end."""
    rng, texts = random.Random(8), []
    for n in range(5, 17):
        for _ in range(6):
            words = [f"w{rng.random()}" for _ in range(n)]
            texts += [" ".join(words), " ".join([*words, "more"]), " ".join([*words[:-1], "other"])]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, __rank int, __key string")
    ids, _ = brute(docs)
    assert sorted(r.doc_id for r in near.near_dedup(df).collect()) == sorted(ids)


def test_contained_long_pairs(spark):
    """Texts of 1,000 shingles and the same with 250 more: just 0.8."""
    rng, docs = random.Random(9), []
    for k in range(60):
        words = [f"w{rng.random()}" for _ in range(1254)]
        docs += [(2 * k, " ".join(words[:1004])), (2 * k + 1, " ".join(words))]
    out = near.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).count()
    assert out <= 61  # of 60 pairs one may be lost


@pytest.mark.parametrize("compared", [2, 1024])
def test_large_blocks_lose_no_link(spark, monkeypatch, compared):
    """Pairs that pivots miss, as their block holds many other sets, are found whatever the size at which blocks are split."""
    monkeypatch.setattr(near, "COMPARED", compared)
    monkeypatch.setattr(near, "PIVOTS", (1,))
    rng = random.Random(10)
    shared = [f"s{k}" for k in range(60)]
    docs = []
    for k in range(40):
        own = [f"w{rng.random()}" for _ in range(20)]
        docs += [(2 * k, " ".join(shared + own)), (2 * k + 1, " ".join(shared + edited(rng, own, 1).split()))]
    ids, _ = brute(docs)
    assert sorted(r.doc_id for r in near.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == sorted(ids)


@pytest.mark.parametrize("n", [3, 40, 500, 2000, 9000])
def test_sketches_never_fall_far_below_the_similarity(n):
    rng = np.random.default_rng(n)
    for share in (0.5, 0.8, 0.85, 1.0):
        values = np.unique(rng.integers(0, 1 << 63, 3 * n + 9, dtype=np.uint64))
        rng.shuffle(values)
        c = max(1, round(2 * n * share / (1 + share)))
        a, b = np.sort(values[:n]), np.sort(np.concatenate([values[:c], values[n : 2 * n - c]]))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = near.sketched_similarity(near.sketch(a), near.sketch(b))
        assert found == pytest.approx(exact) if n < near.SKETCH / 2 else found >= exact - near.MARGIN


@pytest.mark.parametrize("n", [1, 3, 4, 20, 300])
def test_blocks_are_bits_of_the_fingerprint(n):
    """Every block is one of the whole fingerprint's, but for bits on which the shingles vote closest."""
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    bits = np.unpackbits(near.fingerprint(values).view(np.uint8))[: near.BLOCKS * near.BITS].reshape(near.BLOCKS, near.BITS)
    whole = [sum(int(x) << i for i, x in enumerate(row)) for row in bits]
    turned = {1: 0, 3: 0, 4: 5, 20: 4, 300: 2}[n]
    blocks = near.block_words(values).tolist()
    assert len(set(blocks)) == len(blocks) == (near.BLOCKS << turned if n >= 4 else 0)
    for i, own in enumerate(whole if blocks else []):
        listed = [x & (1 << near.BITS) - 1 for x in blocks if x >> near.BITS == i]
        assert own in listed and len(listed) == 1 << turned
        assert max((x ^ own).bit_count() for x in listed) == turned
        votes = np.abs(near._votes(values)[i * near.BITS : (i + 1) * near.BITS])
        free = [k for k in range(near.BITS) if any((x ^ own) >> k & 1 for x in listed)]
        assert votes[free].max() <= np.delete(votes, free).min()


def test_rows_with_a_near_one_by_brute_force():
    rng = np.random.default_rng(4)
    block, n = np.sort(rng.integers(0, 30, 600)), rng.integers(4, 60, 600)
    order = np.lexsort((n, block))
    n, words = n[order], rng.integers(0, 1 << 63, (600, near.CARRIED), dtype=np.uint64)
    for i in rng.choice(599, 150, replace=False):  # near ones, and ones that are near by bits alone
        words[i + 1] = words[i] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 24, dtype=np.uint64))
    expected = np.zeros(600, bool)
    for i in range(600):
        for j in range(i):
            most = near.CARRIED_MEDIUM if min(n[i], n[j]) <= near.MEDIUM else near.CARRIED_DISTANCE
            if block[i] == block[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and sum(int(x).bit_count() for x in words[i] ^ words[j]) <= most:
                expected[i] = expected[j] = True
    found = near._have_near(block, n, words)
    assert 20 < expected.sum() < 580 and found.tolist() == expected.tolist()


@pytest.mark.parametrize("n", [4, 12, 24, 36, 108, 144])
def test_odd_sketches_keep_similar_sets_and_part_others(n):
    """Sets differ in no more bits of the odd sketch than in shingles, so that the bound loses none; sets that share half of their shingles pass it rarely."""
    odd = lambda x: np.frombuffer(near.odd_sketch(x), np.uint64)
    differ = lambda a, b: int(np.bitwise_count(odd(a) ^ odd(b)).sum())
    rng = np.random.default_rng(n)
    for a, b in pairs_at_the_limit(rng, n, 100):
        assert differ(a, b) <= len(np.setxor1d(a, b)) == (len(a) + len(b)) // 9
    values = rng.integers(0, 1 << 63, (100, n + n // 2), dtype=np.uint64)
    assert np.mean([differ(np.unique(x[:n]), np.unique(x[n // 2 :])) <= 2 * n // 9 for x in values]) < 0.1


def test_short_sets_of_one_block_meet_by_no_chance():
    """Of 400 unrelated sets of 20 shingles in one block, few are of one part with others; by Hamming distance of the words carried nearly all would be."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, 20, dtype=np.uint64)) for _ in range(400)]
    sets += [np.sort(np.append(x[1:], np.uint64(k))) for k, x in enumerate(sets[:50])]
    block, n = np.zeros(450, np.int32), np.full(450, 20)
    words = np.stack([near.fingerprint(x)[: near.CARRIED].view(np.uint64) for x in sets])
    odd = np.stack([np.frombuffer(near.odd_sketch(x), np.uint64) for x in sets])
    part = near._near_parts(block, n, words, odd)
    kept = near._near_parts(block, n, words)
    assert all(part[k] == part[400 + k] for k in range(50) if kept[k] == kept[400 + k])
    assert near._have_near(block, n, words, odd).sum() <= 110 < 400 < near._have_near(block, n, words).sum()


def test_equal_parts_of_blocks_have_one_name():
    block = np.array([1, 1, 1, 1, 1, 2, 2, 2, 3, 3])
    key = np.array([10, 20, 30, 40, 50, 20, 10, 60, 30, 60])
    part = np.array([0, 0, 2, 2, 4, 5, 5, 7, 8, 8])
    names, keys = near._named_parts(block, key, part)
    found = {}
    for name, k in zip(names.tolist(), keys.tolist(), strict=True):
        found.setdefault(name, []).append(k)
    assert sorted(sorted(x) for x in found.values()) == [[10, 10, 20, 20], [30, 40], [30, 60]]


@pytest.mark.parametrize("n", [100, 3000])
def test_copies_of_a_block_give_few_pairs(n):
    """A block of 60 near copies, also of sets larger than a sketch, gives the pairs that connect them, not all."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: n - n // 50], rng.integers(0, 1 << 63, n // 50, dtype=np.uint64)])) for _ in range(60)]
    fps = np.stack([near.fingerprint(x).view(np.uint64) for x in sets])
    pairs = list(near._near_in_block(np.arange(60), np.array([len(x) for x in sets]), fps, list(range(60)), [near.sketch(x) for x in sets], True))
    assert len(pairs) == 59 and len({x for p in pairs for x in p}) == 60


@pytest.mark.parametrize("n", [4, 20, 300])
def test_a_set_is_listed_once_in_a_group_of_blocks(n):
    """Fewer rows than blocks go to the tasks, which find all blocks of a set again."""
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(20)]
    fps = np.stack([near.fingerprint(x) for x in sets])
    turns = np.stack([np.frombuffer(near._turns(near._votes(x), n), np.uint8).reshape(near.BLOCKS, -1) for x in sets])
    of, listed = near._in_groups(fps, turns)
    assert len(listed) < 0.7 * sum(len(near.block_words(x)) for x in sets)
    rows, blocks = near._ungrouped(listed)
    for k, x in enumerate(sets):
        groups = near._group(listed[of == k]).tolist()
        assert len(set(groups)) == len(groups)
        assert sorted(blocks[of[rows] == k].tolist()) == sorted(near.block_words(x).tolist())
    assert (near._group(listed)[rows] == near._group(blocks)).all()


def test_sets_with_odd_sketches_are_told_by_these_alone():
    """Sets up to SMALL shingles carry no fingerprint unless similar sets may be larger."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    sets = [np.sort(base[:120]), np.sort(base[:118]), np.sort(base[:150])]
    n, odd = np.array([118, 120, 150]), np.stack([np.frombuffer(near.odd_sketch(x), np.uint64) for x in (sets[1], sets[0], sets[2])])
    words = np.stack([np.zeros(near.CARRIED, np.uint64), ~np.zeros(near.CARRIED, np.uint64), np.zeros(near.CARRIED, np.uint64)])
    part = near._near_parts(np.zeros(3, np.int32), n, words, odd)
    assert part[0] == part[1] == part[2]


def test_texts_without_candidates_are_not_shuffled(spark, monkeypatch):
    """However many candidates there are, the other texts stay where they are."""
    plans, staged = {}, near.staged

    def seen(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name, *more)

    monkeypatch.setattr(near, "staged", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(k, f"{k} a b c d e f {k}") for k in range(40)] + [(None, "without an id"), (7, "another text of 7")], "doc_id long, text string")
        keyed = [(near.set_key(near.shingle_set(t.encode())), r) for t, r in (("3 a b c d e f 3", 3), ("7 a b c d e f 7", 7), ("without an id", None))]
        found = near._packed_texts(spark.createDataFrame(keyed, "key long, rep long"), docs).collect()
        assert sorted(r.key for r in found) == sorted(k for k, _ in keyed)
        assert "hashpartitioning(doc_id" not in plans["near-texts"] and "hashpartitioning(coalesce(doc_id" not in plans["near-texts"]
        one, _ = near.keep_least(docs, spark.createDataFrame([(k, k) for k in range(40)] + [(7, 50)], "doc_id long, key long"), spark.createDataFrame([(k, k // 2) for k in range(40)] + [(50, 7)], "key long, least long"), "doc_id", "text")
        assert sorted((r.doc_id, r.text) for r in one.collect()) == [(0, "0 a b c d e f 0"), (7, "7 a b c d e f 7")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_blocks_of_one_part_are_done_with(spark):
    rows = spark.createDataFrame([(1, 10, 9, [0], 10), (1, 11, 9, [0], 11), (2, 10, 9, [0], 10), (2, 12, 9, [0], 12)], "block long, key long, n int, fp array<long>, part long")
    left = near._unsettled(rows, spark.createDataFrame([(10, 10), (11, 10)], "node long, component long"))
    assert sorted((r.block, r.key, r.part) for r in left.collect()) == [(2, 10, 10), (2, 12, 12)]


def test_marks_lose_no_row(spark, monkeypatch):
    from kinema.llm import common

    for size in (1 << 18, 1):
        monkeypatch.setattr(common, "MARKS", size)
        rows = spark.createDataFrame([(k if k else None, k) for k in range(300)], "id long, n long")
        of = spark.createDataFrame([(None,), *((k,) for k in range(5, 200, 7))], "x long")
        some, others = common.marked(rows, "id", of, "x")
        some, others = ({r.n for r in x.collect()} for x in (some, others))
        assert some | others == set(range(300)) and not some & others and {0, *range(5, 200, 7)} <= some
        assert len(some) == 29 if size > 1 else len(some) > 29
        assert common.marked(rows, "id", of.limit(0), "x")[1].count() == 300
