"""Operators on literal clips with values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinema.functions import arrays, clean, landmarks
from kinema.operators import agg, evaluate, grouped, joins, rows, seq, sets


def clip(spark, **columns):
    n = len(next(iter(columns.values())))
    names = list(columns)
    data = [(1, i, *(columns[c][i] for c in names)) for i in range(n)]
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    kind = lambda c: kinds[type(next((v for v in columns[c] if v is not None), 0.0))]
    return spark.createDataFrame(data, "sample_id long, frame_idx int, " + ", ".join(f"{c} {kind(c)}" for c in names))


def column(df, c):
    return [r[c] for r in df.orderBy("frame_idx").collect()]


def test_tags_from_segment(spark):
    f = clip(spark, x=[0.0] * 8)
    s = spark.createDataFrame([(1, 2, 5)], "sample_id long, start int, end int")
    assert column(seq.tag_segments(f, s), "bio") == [0, 0, 1, 2, 2, 2, 0, 0]


def test_strict_parse(spark):
    f = clip(spark, y=[2, 2, 0, 1, 2, 0])
    assert [tuple(r) for r in seq.bio_segments(f, "y").select("start", "end", "length").collect()] == [(3, 4, 2)]
    v = seq.bio_violations(f, "y").first()
    assert v.violations == 2 and v.rate == pytest.approx(2 / 6)


def test_startup_prefix(spark):
    f = seq.startup_prefix(clip(spark, v=[False, False, True, True, True]), "v", 1)
    assert column(f, "first_visible") == [2] * 5 and column(f, "startup") == [True, True, False, False, False]
    assert column(seq.startup_prefix(clip(spark, v=[False, True]), "v", 2), "first_visible") == [None, None]


def test_fill_gaps(spark):
    f = clip(spark, x=[0.1, None, 0.3], ok=[True, False, True])
    got = seq.fill_gaps(f, "x", F.col("ok"), 2)
    assert column(got, "filled") == pytest.approx([0.1, 0.2, 0.3]) and column(got, "source") == ["observed", "interp", "observed"]
    assert column(seq.fill_gaps(f, "x", F.col("ok"), 1), "source") == ["observed", "interp", "observed"]  # one frame is missing
    assert column(seq.fill_gaps(f, "x", F.col("ok"), 0), "source") == ["observed", "missing", "observed"]
    for missing in range(1, 5):  # a gap of exactly max_gap missing frames is filled, one of one more is not
        g = clip(spark, x=[0.0, *[None] * missing, 1.0], ok=[True, *[False] * missing, True])
        assert column(seq.fill_gaps(g, "x", F.col("ok"), 3), "source")[1] == ("interp" if missing <= 3 else "missing")


@pytest.mark.parametrize("win", range(1, 8))
def test_smooth_box_aligns_with_numpy(spark, win):
    x = [3.0, 1.0, 4.0, 1.0, 5.0]
    want = x if win <= 1 or win > len(x) else list(np.convolve(x, np.ones(win) / win, mode="same"))
    assert column(seq.smooth_box(clip(spark, x=x), "x", win), "smooth") == pytest.approx(want)


def test_nearest_rank_rounds_half_to_even(spark):
    f = clip(spark, x=[10.0, 20.0, 30.0, 40.0, 50.0, 60.0])
    assert agg.nearest_rank(f, "x", 0.5, ["sample_id"]).first().x == 30.0  # place 2.5


def test_calibration(spark):
    f = spark.createDataFrame([(0.1, 0)] * 4, "c double, y int")
    r = evaluate.calibration(f, "c", F.col("y") == 1).first()
    assert r.ece == pytest.approx(0.1) and r.brier == pytest.approx(0.01)


def test_threshold_sweep_ranks_three(spark):
    p = [[0.9, 0.05, 0.05], [0.1, 0.85, 0.05], [0.1, 0.2, 0.7], [0.1, 0.15, 0.75], [0.8, 0.1, 0.1], [0.85, 0.08, 0.07]]
    f = clip(spark, y=[0, 1, 2, 2, 0, 0], po=[q[0] for q in p], pb=[q[1] for q in p], pi=[q[2] for q in p])
    got = evaluate.threshold_sweep(f, "y", [0.3, 0.5, 0.7]).orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 2, 3] and got[0].f1_b == 1.0 and got[0].thr == 0.3


def test_leakage_and_overlap(spark):
    a = spark.createDataFrame([("video_a.mp4", "train", "u1"), ("video_a.mp4", "val", "u1"), ("b.mp4", "val", "u2")], "id string, split string, user string")
    o = sets.split_overlap(a.where("split = 'train'"), a.where("split = 'val'"), "id").first()
    assert (o.overlap_count, o.examples, o.ok) == (1, ["video_a.mp4"], False)
    assert [tuple(r) for r in sets.multi_split_keys(a, "user").collect()] == [("u1", ["train", "val"])]


def dealt_by_hand(rows):
    """The signer split in the words of its rule, over rows (signer, split, label)."""
    n, splits = len(rows), sorted({r[1] for r in rows})
    share = {x: sum(r[1] == x for r in rows) / n for x in splits}
    total = {k: sum(r[2] == k for r in rows) for k in {r[2] for r in rows}}
    of = {s: [r for r in rows if r[0] == s] for s in {r[0] for r in rows}}
    prefers = {s: min(splits, key=lambda x: (-sum(r[1] == x for r in own), x)) for s, own in of.items()}
    goal = {x: sum(p == x for p in prefers.values()) for x in splits}
    got = {s: own[0][1] for s, own in of.items() if len({r[1] for r in own}) == 1}
    main = lambda own: max(sum(r[2] == k for r in own) for k in {r[2] for r in own})
    for s in sorted((s for s in of if s not in got), key=lambda s: (-len(of[s]), -main(of[s]), s is None, s or "")):
        own, rank = of[s], {}
        for x in splits:
            there = [r for y, to in got.items() if to == x for r in of[y]]
            signers = sum(to == x for to in got.values())
            off = sum(abs(sum(r[2] == k for r in there) + sum(r[2] == k for r in own) - total[k] * share[x]) / max(1, total[k] * share[x]) for k in {r[2] for r in own})
            open_rows = max(0, share[x] * n - len(there))
            rank[x] = (max(0, signers + 1 - goal[x]), abs(max(0, goal[x] - signers) - 1), max(0, len(there) + len(own) - share[x] * n), abs(open_rows - len(own)) + 0.05 * off, prefers[s] != x, len(there), x)
        got[s] = min(splits, key=rank.get)
    return got


def test_class_families_find_planted_groups(spark):
    rng = np.random.default_rng(7)
    centers = np.eye(3).repeat(4, axis=1) * 5
    data = [(10 * g + k, (centers[g] + rng.normal(0, 0.1, 12)).tolist()) for g in range(3) for k in range(5)]
    got = {r.label: r.family for r in evaluate.class_families(spark.createDataFrame(data, "label int, prototype array<double>"), 3).collect()}
    assert len(got) == 15 and [len({got[10 * g + k] for k in range(5)}) for g in range(3)] == [1, 1, 1] and len(set(got.values())) == 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_disjoint_split(spark, seed):
    rng = np.random.default_rng(seed)
    data = [("t", "train", "a")] * 5 + [("v", "val", "b")] * 2 + [(None, "train", "a"), (None, "val", "a")]
    for k in range(12):
        data += [(f"s{k}", str(rng.choice(["train", "train", "val", "test"])), str(rng.choice(["a", "b", "c"]))) for _ in range(rng.integers(1, 15))]
    out = sets.disjoint_split(spark.createDataFrame(data, "signer string, split string, label string")).collect()
    assert len(out) == len(data) and sorted(r.label for r in out) == sorted(r[2] for r in data)
    assert {r.signer: r.new_split for r in out} == dealt_by_hand(data)
    assert sets.disjoint_split(spark.createDataFrame([], "signer string, split string, label string")).count() == 0


def test_validation_order(spark):
    data = [(1, "a.mp4", "x", "0", "5", "train"), (2, "dir/a.avi", "x", "1", "4", "train"), (3, "b", "", "0", "5", "val"), (4, "c", "x", "7", "7", "val"), (5, "d", "x", "bad", "7", "val"), (6, None, "x", "0", "1", "val"), (7, "e", "x", "-1.5", "3", "val"), (8, "f", "x", "0", "1", " ")]
    df = spark.createDataFrame(data, "row_num int, attachment_id string, label string, begin string, end string, split string")
    got = {r.row_num: r.reason for r in rows.validate_annotations(df).collect()}
    assert got == {1: None, 2: "duplicate_sample_id", 3: "missing_label", 4: "invalid_clip_range", 5: "invalid_begin", 6: "missing_attachment_id", 7: "negative_clip_bounds", 8: "missing_split_value"}
    with pytest.raises(ValueError, match="missing columns: begin, one of split, train"):
        rows.check_columns(df.select("end"), ["end", "begin"], ["split", "train"])


def test_scalars(spark):
    r = spark.range(1).select(
        clean.path_stem(F.lit("a/b.c/d.tar.gz")).alias("stem"), clean.slugify(F.lit("..Ä b/c__")).alias("slug"), clean.normalize_split(F.lit(" Test ")).alias("split"), clean.parse_int(F.lit(" -3.9")).alias("n"), clean.parse_int(F.lit("1e300")).alias("big"),
        arrays.bones(F.array(F.lit(1.0), F.lit(3.0), F.lit(6.0)), F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("bones"), arrays.resample_index(F.lit(3), 5).alias("i"), arrays.bio_string(F.array(F.lit(0), F.lit(1), F.lit(2)), 2).alias("tags"),
        arrays.hand_scale(F.array(*map(F.lit, [0.0, 3.0, 0.0, 0.0])), F.array(*map(F.lit, [0.0, 0.0, 4.0, 1.0]))).alias("scale"), arrays.pose_reorder(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, [5, 6, 7])), F.array(*map(F.lit, [7, 9]))).alias("pose"),
        arrays.combine_hands(F.array(F.lit(1.0), F.lit(float("nan"))), F.lit(None).cast("array<double>"), 2)[1].alias("mask"), arrays.wrist_fallback(F.lit(None).cast("double"), F.lit(2.0), F.lit(True), False).alias("wrist"),
        arrays.shift_to_reference(F.array(F.lit(0.5), F.lit(0.9)), F.lit(0.4), F.lit(0.2)).alias("shift"), arrays.mask_by_score(F.lit(True), F.lit(None).cast("double"), 0.0, 2).alias("all"), arrays.cosine01(F.array(F.lit(1.0)), F.array(F.lit(-1.0))).alias("cos"),
        arrays.mean_l2(F.array(F.lit(0.0)), F.array(F.lit(0.0)), F.array(F.lit(3.0)), F.array(F.lit(4.0))).alias("l2"),
    ).first()
    assert (r.stem, r.slug, r.split, r.n, r.big) == ("d.tar", "b_c", "val", -3, None)
    assert (r.bones, r.i, r.tags, r.scale, r.pose, r.mask) == ([0.0, 2.0, 3.0], [0, 0, 1, 2, 2], "OB...(3)", 3.0, ["c", None], [True, False, False, False])
    assert (r.wrist, r["all"], r.cos, r.l2) == (2.0, [True, True], 0.0, 5.0) and r["shift"] == pytest.approx([0.7, 1.0])


def test_landmark_documents(spark):
    docs = ['{"hand 1": [{"x": 1, "y": 2}, {"X": 3, "Y": 4, "Z": 5}], "hand 2": null}', '{"left_hand": [[1, 2, 3]], "right_hand": [[4, 5]]}', '{"hands": [{"handedness": "Right", "landmarks": [{"x": "bad"}]}]}', '{"hands": {"left": [[7, 8]]}}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").withColumn("v", F.parse_json("d"))
    left, right = landmarks.hands_from_variant(F.col("v"))
    got = {r.i: r for r in df.select("i", landmarks.points_to_struct(left, 2).alias("l"), landmarks.points_to_struct(right, 2).alias("r")).collect()}
    assert [tuple(p) for p in got[0].l] == [(1, 2, 0), (3, 4, 5)] and got[0].r is None
    assert tuple(got[1].r[0]) == (4, 5, 0) and got[1].l[1] is None and got[2].r == [None, None] and got[2].l is None and tuple(got[3].l[0]) == (7, 8, 0)


def test_decoder_trace():
    p = [[0.9, 0.05, 0.05], [0.1, 0.85, 0.05], [0.1, 0.2, 0.7], [0.1, 0.15, 0.75], [0.8, 0.1, 0.1], [0.85, 0.08, 0.07]]
    d = grouped.Decoder(start=0.8, min_length=2, min_gap=2)
    found = [x for x in grouped.steps([(i, q[1], q[2]) for i, q in enumerate(p)], d) if x]
    assert [(x["start"], x["end_excl"], x["end_reason"]) for x in found] == [(1, 4, "gap_closed")]
    d = grouped.Decoder(start=0.8)
    assert grouped.steps([(0, 0.9, 0.0), (1, 0.1, 0.9)], d) == [None, None] and d.end()["end_reason"] == "eos_closed"


def test_decoder_gates():
    trace = lambda d, rows: [(x["start"], x["end_excl"]) for x in [*(d.step(i, *r) for i, r in enumerate(rows)), d.end()] if x]
    # the closing frame opens again by its onset, and not while a cooldown lasts
    rows = [(0.9, 0.0), (0.9, 0.0), (0.0, 0.0), (0.1, 0.0, True, None, 0.9), (0.9, 0.0), (0.9, 0.0)]
    assert trace(grouped.Decoder(start=0.8, onset_start=0.7), rows) == [(0, 2), (3, 6)]
    assert trace(grouped.Decoder(start=0.8, onset_start=0.7, cooldown=1), rows) == [(0, 2), (4, 6)]
    assert trace(grouped.Decoder(start=0.8, onset_start=0.7, cooldown=2), rows) == [(0, 2)]
    # a cooldown of c blocks the c - 1 frames after the closing one
    rows = [(0.9, 0.0), (0.9, 0.0), (0.0, 0.0), (0.0, 0.0), *[(0.9, 0.0)] * 4]
    assert [trace(grouped.Decoder(start=0.8, cooldown=c), rows)[-1] for c in (0, 1, 2, 3)] == [(4, 8), (4, 8), (5, 8), (6, 8)]
    # activity: too low to open, high enough to go on
    rows = [(0.9, 0.0, True, 0.1), (0.9, 0.0, True, 0.9), (0.0, 0.0, True, 0.9), (0.0, 0.0, True, 0.1), (0.0, 0.0, True, 0.1)]
    assert trace(grouped.Decoder(start=0.8, active_start=0.5, active_go_on=0.5), rows) == [(1, 3)]
    d = grouped.Decoder(start=0.8, guard=2)
    assert trace(d, [(0.9, 0.0, True), (0.9, 0.0, False), (0.9, 0.0, True), (0.9, 0.2, True), (0.6, 0.7, True)]) == [(3, 5)]
    d = grouped.Decoder(start=0.8)
    assert [d.step(i, *r) for i, r in enumerate([(0.9, 0.2), (0.5, 0.7), (0.0, 0.1)])] == [None] * 3 and d.step(3, 0.95, 0.0)  is None
    assert d.end()["mean_inside"] == pytest.approx((0.9 + 0.7 + 0.1 + 0.95) / 4)


def test_smoothers():
    x = np.array([1.0, 1.0, np.nan, 5.0])
    out = grouped.ema_both_ways(x, 0.5)
    assert out[0] == out[1] == 1.0 and np.isnan(out[2]) and out[3] == 5.0
    flat = grouped.kalman_smooth(np.full(20, 2.0), np.ones(20), np.ones(20))
    assert flat == pytest.approx(np.full(20, 2.0))
    rng = np.random.default_rng(1)
    line = np.arange(200) * 0.5
    smooth = grouped.kalman_smooth(line + rng.normal(0, 1, 200), np.ones(200), np.ones(200), drift=1e-4)
    assert np.abs(smooth - line)[20:-20].mean() < 0.4
    e = grouped.OneEuro()
    assert e.step(0, 1.0) == 1.0 and e.step(0, 9.0) == 1.0 and 1.0 < e.step(33, 2.0) < 2.0


def test_words():
    w = grouped.Words(min_conf=0.5, pause_ms=1200)
    got = grouped.steps([("hi", 0.9, 0, 100), ("hi", 0.9, 1000, 1100), ("", 1.0, 1200, 1300), ("yo", 0.4, 1300, 1400), ("hi", 0.9, 1500, 1600)], w)
    assert got == [True, False, False, False, True] and w.sentence == ["hi", "hi"]


@pytest.mark.parametrize("seed", range(4))
def test_greedy_match_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    y, p = rng.integers(0, 2 + seed % 2, 80), rng.integers(0, 3, 80)
    for tol in (0, 1, 2, 5):
        free, tp = np.flatnonzero(y == 1).tolist(), 0
        for at in np.flatnonzero(p == 1):
            near = [(abs(t - at), t) for t in free if abs(t - at) <= tol]
            if near:
                free.remove(min(near)[1])
                tp += 1
        r = joins.match_boundaries(clip(spark, y=y.tolist(), p=p.tolist()), "y", "p", tol).first()
        assert (r.tp, r.fp, r.fn) == (tp, (p == 1).sum() - tp, (y == 1).sum() - tp)


def test_greedy_match(spark):
    f = clip(spark, y=[1, 0, 0, 1, 0, 0], p=[0, 1, 1, 0, 0, 1])
    r = joins.match_boundaries(f, "y", "p", 2).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 0)


def test_keyed_tables(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, rows.upsert_by_key(a, b, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="duplicate id"):
        rows.merge_shards([a, b], "id").collect()
    with pytest.raises(ValueError, match="unknown columns: v"):
        rows.conform_schema(a, spark.createDataFrame([], "id int").schema)
    with pytest.raises(ValueError, match="schema"):
        rows.merge_shards([a, b.drop("v")], "id")
