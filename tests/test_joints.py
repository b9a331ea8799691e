"""Operators on joints and hands against plain numpy: running normalisation, smoothing, post-processing, seams, occlusion, association."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinema.functions import joints
from kinema.operators import evaluate, grouped, seq

POINTS = joints.POINTS


def named(a):
    return None if a is None else [dict(zip("xyz", map(float, p), strict=True)) for p in a]


def plain(points):
    return None if points is None else np.array([[p.x, p.y, p.z] for p in points])


def brute_normalize(pts, mask, hand, least, alpha_c=0.2, alpha_s=0.1):
    center = scale = None
    out = []
    for p, m in zip(pts, mask, strict=True):
        p, m = np.nan_to_num(p, posinf=0, neginf=0), np.nan_to_num(m, posinf=0, neginf=0)
        seen = m > 0.5
        wrists = [p[i] for i in (0, hand) if seen[i]]
        c = np.mean(wrists, axis=0) if wrists else p[seen].mean(axis=0) if seen.any() else None
        if c is not None:
            center = c if center is None else (1 - alpha_c) * center + alpha_c * c
        sizes = []
        for i in (0, hand):
            part = seen[i : i + hand]
            d = np.linalg.norm(p[i : i + hand][part] - p[i], axis=1)
            d = d[d > 1e-6]
            if seen[i] and part.sum() >= max(2, least) and len(d):
                sizes.append(d.mean())
        if sizes:
            s = max(np.mean(sizes), 1e-3)
            scale = s if scale is None else (1 - alpha_s) * scale + alpha_s * s
        out.append((p - (0 if center is None else center)) / max(1.0 if scale is None else scale, 1e-3) * m[:, None])
    return np.array(out)


@pytest.mark.parametrize(("hand", "n"), [(3, 700), (21, 60), (4, 1), (2, 30)])
def test_causal_normalize_equals_steps(spark, hand, n):
    """Over several blocks of the windowed means, with frames and joints that are missing or not finite."""
    rng = np.random.default_rng(hand)
    pts, mask = rng.normal(0, 1, (n, 2 * hand, 3)), (rng.random((n, 2 * hand)) < 0.6).astype(float)
    mask[rng.random(n) < 0.3] = 0
    pts[0, 0, 0], mask[n // 2, 1] = np.nan, np.nan
    pts[n // 3, 1, 2] = np.inf
    rows = [("a", i, named(pts[i]), mask[i].tolist()) for i in range(n)] + [("b", 0, named(np.zeros((2 * hand, 3))), [0.0] * 2 * hand)]
    df = spark.createDataFrame(rows, f"sample_id string, frame_idx int, points {POINTS}, mask array<double>")
    got = grouped.causal_normalize(df, hand=hand, least=2).orderBy("sample_id", "frame_idx").collect()
    assert np.array([plain(r.points) for r in got[:n]]) == pytest.approx(brute_normalize(pts, mask, hand, 2), rel=1e-9, abs=1e-9)
    assert (got[n].center_x, got[n].scale) == (0.0, 1.0)
    assert grouped.causal_normalize(df.limit(0), hand=hand).count() == 0


def matrix_smooth(x, step, noise, drift):
    """The filter and its backward pass with whole matrices, one column at a time."""
    out = np.full(x.shape, np.nan)
    for k in range(x.shape[1]):
        there = ~np.isnan(x[:, k])
        if not there.any():
            continue
        first = int(np.argmax(there))
        m, p, mp, pp = {}, {}, {}, {}
        for i in range(first, len(x)):
            if i == first:
                m[i] = mp[i] = np.array([x[i, k], 0.0])
                p[i] = pp[i] = np.eye(2)
                continue
            t = step[i]
            f = np.array([[1, t], [0, 1]])
            mp[i], pp[i] = f @ m[i - 1], f @ p[i - 1] @ f.T + drift * np.array([[t**4 / 4, t**3 / 2], [t**3 / 2, t**2]])
            m[i], p[i] = mp[i], pp[i]
            if there[i]:
                gain = pp[i][:, 0] / (pp[i][0, 0] + noise[i])
                m[i], p[i] = mp[i] + gain * (x[i, k] - mp[i][0]), pp[i] - np.outer(gain, pp[i][0])
        s = {len(x) - 1: m[len(x) - 1]}
        for i in range(len(x) - 2, first - 1, -1):
            c = p[i] @ np.array([[1, step[i + 1]], [0, 1]]).T @ np.linalg.inv(pp[i + 1])
            s[i] = m[i] + c @ (s[i + 1] - mp[i + 1])
        for i in range(first, len(x)):
            if there[i]:
                out[i, k] = s[i][0]
    return out


def test_kalman_smooth_equals_matrices():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 6)).cumsum(axis=0)
    x[[0, 1, 20, 21, 22, 59]] = np.nan
    step, noise = rng.uniform(0.2, 3, 60), rng.uniform(1e-4, 4e-3, 60)
    assert grouped.kalman_smooth(x, step, noise) == pytest.approx(matrix_smooth(x, step, noise, grouped.DRIFT), nan_ok=True)
    assert np.isnan(grouped.kalman_smooth(np.full((4, 2), np.nan), np.ones(4), np.ones(4))).all()
    assert grouped.scaled_steps(np.array([0.0, 10, 30, 30, 40])).tolist() == [1.0, 1.0, 2.0, 1e-6, 1.0]
    assert grouped.scaled_steps(np.array([5.0, 5.0])).tolist() == [1.0, 1.0] and grouped.scaled_steps(np.array([0.0, np.nan])).tolist() == [1.0, 1.0]


def hands(spark, rows):
    return spark.createDataFrame(rows, f"sample_id string, hand int, frame_idx int, ts_ms double, anchor boolean, source string, state string, pts {POINTS}")


def test_postprocess_policies(spark):
    a, b, own = np.array([[0.1, 0.2, 0.0], [0.2, 0.2, 0.0], [0.1, 0.4, 0.0]]), np.array([[0.3, 0.4, 0.0], [0.5, 0.4, 0.0], [0.3, 0.8, 0.0]]), np.full((3, 3), 0.9)
    rows = [
        ("v", 1, 0, 0.0, True, "pass1", "observed", named(a)),
        ("v", 1, 1, 40.0, False, "pass2", "observed", named(own)),
        ("v", 1, 2, 80.0, False, "tracked", "observed", named(own)),
        ("v", 1, 3, 120.0, False, None, None, None),
        ("v", 1, 4, 160.0, True, "pass1", "observed", named(b)),
        ("v", 1, 5, 200.0, False, "pass1", "observed", named(own)),
    ]
    done = {only: {r.frame_idx: r for r in grouped.postprocess_hands(hands(spark, rows), "pts", "anchor", 3, only_anchors=only).collect()} for only in (True, False)}
    assert [done[True][i].applied for i in range(6)] == [False, True, True, True, False, False] and [done[True][i].overrode for i in range(6)] == [False, True, False, False, False, False]
    assert [done[False][i].applied for i in range(6)] == [False, False, True, True, False, False]
    assert plain(done[True][2].value)[0] == pytest.approx([0.2, 0.3, 0.0]) and (plain(done[False][1].value) == own).all() and (plain(done[True][5].value) == own).all()
    assert (done[True][3].source, done[True][3].state, done[True][5].source) == ("interp", "predicted", "pass1")
    assert not any(r.applied for r in grouped.postprocess_hands(hands(spark, rows), "pts", "anchor", 2).collect())
    for smoother in ("ema", "rts"):
        got = grouped.postprocess_hands(hands(spark, rows), "pts", "anchor", 3, smoother)
        by = {r.frame_idx: r for r in got.collect()}
        assert (plain(by[0].value) == a).all() and (plain(by[4].value) == b).all() and by[0]["shift"] is None and by[2]["shift"] > 0
        stats = grouped.postprocess_stats(got).first()
        assert (stats.filled, stats.gaps_filled) == (3, 1) and stats.smoothing_delta == pytest.approx(np.mean([by[i]["shift"] for i in (1, 2, 3, 5)]))
    assert grouped.postprocess_hands(hands(spark, []), "pts", "anchor", 3, "rts").count() == 0


def test_ema_of_points_begins_anew_after_gaps(spark):
    pts = [np.full((2, 3), v) if v is not None else None for v in (0.0, 1.0, None, 5.0, 5.0)]
    rows = [("v", 1, i, 40.0 * i, False, "pass1", "observed", named(p)) for i, p in enumerate(pts)]
    got = {r.frame_idx: plain(r.value) for r in grouped.postprocess_hands(hands(spark, rows), "pts", "anchor", 0, "ema").collect()}
    assert got[0][0][0] == pytest.approx(0.25) and got[1][0][0] == pytest.approx(0.75) and got[2] is None and got[3][0][0] == 5.0


def seam_frames(spark, xs):
    rows = [("v", i, named(np.array([[x, 0, 0]] * 6)), [1.0] * 6) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, f"sample_id string, frame_idx int, points {POINTS}, mask array<double>")


def test_typed_seams(spark):
    kind = "sample_id string, part int, length int, type string, source string, role string"
    parts = spark.createDataFrame([("v", 0, 2, "sign", "a", None), ("v", 1, 2, "transition", "a", None), ("v", 2, 2, "no_event", "b", None)], kind)
    steps = grouped.typed_seams(parts, seam_frames(spark, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), hand=3)
    counts = {(r.scope, r.pair): (r.seams, r.same_source) for r in grouped.seam_counts(steps).collect()}
    assert counts == {("expanded", "sign->transition"): (1, 1), ("expanded", "transition->no_event"): (1, 0), ("semantic", "sign->no_event"): (1, 0)}
    deltas = {(r.scope, r.seam): r for r in grouped.seam_deltas(steps).collect()}
    assert deltas["expanded", True].steps == 2 and deltas["semantic", True].center_delta_mean == pytest.approx(0.6) and deltas["semantic", False].center_delta_mean == pytest.approx(0.2)
    padded = spark.createDataFrame([("v", 0, 4, "sign", "a", None), ("v", 1, 2, "no_event", "", "pad_post")], kind)
    steps = grouped.typed_seams(padded, seam_frames(spark, [0.0, 0.1, 0.2, 0.3, 0.0, 0.0]), hand=3).where("seam")
    assert [(r.scope, r.seams) for r in grouped.seam_counts(steps).collect()] == [("expanded", 1)]


def test_motion_runs(spark):
    shown = [0, 0, 1, 1, 1, 0, 1]
    rows = [("v", i, named(np.array([[0.001 * i if i < 4 else i, 0, 0]] * 6)), [float(s)] * 6) for i, s in enumerate(shown)] + [("w", 0, named(np.zeros((6, 3))), [1.0] * 6)]
    df = spark.createDataFrame(rows, f"sample_id string, frame_idx int, points {POINTS}, mask array<double>")
    got = sorted((r.sample_id, r.kind, r.start, r.length) for r in seq.motion_runs(df, quiet=0.01, hand=3, least=2).collect())
    assert got == sorted([
        ("v", "no_hand", 0, 2), ("v", "startup", 0, 2), ("v", "hand", 2, 3), ("v", "no_hand", 5, 1), ("v", "hand", 6, 1), ("v", "still", 0, 1), ("v", "still", 3, 1), ("v", "sequence", 0, 7),
        ("w", "hand", 0, 1), ("w", "sequence", 0, 1),
    ])
    r = seq.motion_deltas(df, hand=3, least=2).first()
    assert r.center_delta_mean == pytest.approx((0.001 + 3.997) / 2) and r.scale_delta_mean == 0.0


def test_occlusion_counts_down(spark):
    overlap = [0, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    deep = [0.0, 0.02, 0.008, 0.02, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([("v", i, float(o), d, i == 8, i != 8) for i, (o, d) in enumerate(zip(overlap, deep, strict=True))], "sample_id string, frame_idx int, o double, d double, amb boolean, there boolean")
    box = [F.lit(0.0), F.lit(0.0), F.col("o"), F.col("o")]
    got = seq.occlusion_states(df, box, [F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)], F.col("d"), F.lit(0.0), F.col("amb"), F.col("there"), F.lit(True)).orderBy("frame_idx").collect()
    assert [r.left_ttl for r in got] == [0, 4, 4, 3, 2, 1, 0, 0, 4, 3]  # held over the exit threshold, counted down, and held again while missing and ambiguous
    assert not any(r.right_occluded for r in got) and [r.left_occluded for r in got][:7] == [False, True, True, True, True, True, False]


def test_association_goes_by_what_it_accepted():
    m = grouped.Association()
    left, right = (0.2, 0.3), (0.8, 0.3)
    assert m.step(left, right, left, right, False) == {"swapped": False, "left_accepted": True, "right_accepted": True}
    # the pose doesn't tell: crossed hands are swapped back by the wrists accepted before
    assert m.step(right, left, None, None, True) == {"swapped": True, "left_accepted": True, "right_accepted": True} and (m.left_x, m.right_x) == (0.2, 0.8)
    # too near the middle: neither is accepted, and the last good ones stay
    assert m.step((0.5, 0.3), (0.5, 0.3), None, None, True) == {"swapped": False, "left_accepted": False, "right_accepted": False} and m.left_x == 0.2
    assert m.step(None, (0.75, 0.3), None, None, False) == {"swapped": False, "left_accepted": False, "right_accepted": True} and m.right_x == 0.75
    fresh = grouped.Association()
    assert not fresh.step(left, right, None, None, False)["left_accepted"]  # nothing to go by


def test_sweep_of_thresholds_against_brute_force(spark):
    """The counts of the one-pass sweep against a clip-by-clip count."""
    rng = np.random.default_rng(6)
    data, clips = [], {}
    for c in range(6):
        n = int(rng.integers(1, 50))
        p = rng.dirichlet([1, 1, 1], n)
        y = rng.integers(0, 3, n) if c else np.zeros(n, int)
        vis = rng.random(n) < 0.5
        clips[c] = p, y, vis
        data += [(c, i, int(y[i]), *map(float, p[i]), bool(vis[i]), f"s{c % 2}") for i in range(n)]
    df = spark.createDataFrame(data, "sample_id long, frame_idx int, y int, po double, pb double, pi double, vis boolean, signer string")
    got = {r.threshold: r for r in evaluate.sweep_metrics(df, "y", [0.2, 0.5, 0.99], "vis", "signer", stable=2).collect()}

    def inside(t):
        open_, out = False, []
        for v in t:
            open_ = True if v == 1 else open_ if v == 2 else False
            out.append(open_ and v != 0)
        return np.array(out)

    for thr, r in got.items():
        tp = bp = bt = ip = it = vp = vt = n = early = blind = busy = 0
        errors, rates, hits, covers, silent, starts, by = [], [], [], [], [], [], {}
        for c, (p, y, vis) in clips.items():
            t = np.where(p[:, 1] >= thr, 1, np.where(p[:, 0] >= p[:, 2], 0, 2))
            first = next((i for i in range(len(vis) - 1) if vis[i] and vis[i + 1]), len(vis))
            g, q = np.flatnonzero(y == 1), np.flatnonzero(t == 1)
            free = g.tolist()
            for at in q:
                near = [(abs(x - at), x) for x in free if abs(x - at) <= 2]
                if near:
                    free.remove(min(near)[1])
                    tp += 1
            bp, bt, ip, it, n = bp + len(q), bt + len(g), ip + inside(t).sum(), it + inside(y).sum(), n + len(t)
            vp, vt = vp + ((t == 2) & ~inside(t)).sum(), vt + ((y == 2) & ~inside(y)).sum()
            errors += [np.abs(q - x).min() for x in g] if len(q) else []
            rates.append(((t[1:] != t[:-1]).sum() - (y[1:] != y[:-1]).sum()) / max(1, len(t) - 1))
            early, blind, busy = early + (q < first).sum(), blind + first, busy + (t[:first] != 0).sum()
            starts.append((q < first).any())
            if len(g):
                hits.append((inside(t) & inside(y)).any())
                covers.append(any(abs(a - b) <= 2 for a in g for b in q))
                silent.append(len(q) == 0)
                by.setdefault(c % 2, []).append(hits[-1])
        f1 = 2 * tp / max(bp + bt, 1e-9)
        assert r.b_f1 == pytest.approx(f1, abs=1e-6) and r.pred_b_ratio == pytest.approx(bp / bt) and r.true_length == pytest.approx(it / bt)
        assert r.b_err == pytest.approx(np.mean(errors) if errors else 0.0) and r.transition_err == pytest.approx(abs(np.mean(rates))) and r.violation_err == pytest.approx(abs(vp - vt) / n)
        assert (r.startup_false_start, r.startup_active, r.startup_segment) == (pytest.approx(early / max(bp, 1)), pytest.approx(busy / max(blind, 1)), pytest.approx(np.mean(starts)))
        assert (r.hit_rate, r.start_cover, r.silent_rate) == (pytest.approx(np.mean(hits)), pytest.approx(np.mean(covers)), pytest.approx(np.mean(silent)))
        assert r.signer_macro == pytest.approx(np.mean([np.mean(v) for v in by.values()]))
