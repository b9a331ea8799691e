"""Operators whose every step depends on the one before: a clip's rows, and no more, go to Python together.

The step functions are plain generators over rows in order; the streaming operators run the same ones on kept state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from ..functions import joints


def ema_both_ways(values: np.ndarray, alpha: float) -> np.ndarray:
    """Mean of the forward and backward exponential means of the rows, begun anew after each row with a NaN, which stays."""
    rows = values.reshape(len(values), -1)
    gone = np.isnan(rows).any(axis=1)

    def one_way(indices: Iterable[int]) -> np.ndarray:
        out, last = np.full(rows.shape, np.nan), None
        for i in indices:
            last = None if gone[i] else rows[i] if last is None else (1 - alpha) * last + alpha * rows[i]
            if last is not None:
                out[i] = last
        return out

    n = len(rows)
    return ((one_way(range(n)) + one_way(range(n - 1, -1, -1))) / 2).reshape(values.shape)


#: Spread of accelerations, and deviation of a hand's points by how they were found (fixed values).
DRIFT = 1e-4
SIGMA = {"anchor": 0.01, "observed": 0.02, "interp": 0.03, "predicted": 0.06}


def kalman_smooth(x: np.ndarray, step: np.ndarray, noise: np.ndarray, drift: float = DRIFT) -> np.ndarray:
    """Constant-velocity filter and backward pass over all columns of x at once; rows with a NaN are missing and stay so.

    step: time since the row before; noise: variance of each row's measurement. All columns of a row share step and noise,
    and so gains and covariances: two states a column, and three numbers of covariance a row. It starts at the first row
    that is there, at rest, with variances of 1.
    """
    rows = np.asarray(x, float).reshape(len(x), -1)
    gone = np.isnan(rows).any(axis=1)
    there = np.flatnonzero(~gone)
    out = np.full(rows.shape, np.nan)
    if not len(there):
        return out.reshape(np.shape(x))
    first, n = int(there[0]), len(rows)
    m, ahead = np.zeros((n, 2, rows.shape[1])), np.zeros((n, 2, rows.shape[1]))
    p, before = np.zeros((n, 3)), np.zeros((n, 3))  # variance of place, covariance, variance of speed
    m[first, 0] = ahead[first, 0] = rows[first]
    p[first] = before[first] = 1.0, 0.0, 1.0
    for i in range(first + 1, n):
        t = step[i]
        a, c, v = p[i - 1]
        ahead[i, 0], ahead[i, 1] = m[i - 1, 0] + t * m[i - 1, 1], m[i - 1, 1]
        before[i] = a + t * (2 * c + t * v) + drift * t**4 / 4, c + t * v + drift * t**3 / 2, v + drift * t**2
        if gone[i]:
            m[i], p[i] = ahead[i], before[i]
            continue
        a, c, v = before[i]
        total = a + noise[i] if a + noise[i] > 0 else 1e-6
        off = rows[i] - ahead[i, 0]
        m[i, 0], m[i, 1] = ahead[i, 0] + a / total * off, ahead[i, 1] + c / total * off
        p[i] = a - a / total * a, c - c / total * a, v - c / total * c
    smooth = m.copy()
    for i in range(n - 2, first - 1, -1):
        t, (a, c, v), (e, f, g) = step[i + 1], p[i], before[i + 1]
        det = e * g - f * f
        if abs(det) < 1e-12:
            continue
        to_place = ((a + t * c) * g - c * f) / det, (c * e - (a + t * c) * f) / det
        to_speed = ((c + t * v) * g - v * f) / det, (v * e - (c + t * v) * f) / det
        d = smooth[i + 1] - ahead[i + 1]
        smooth[i, 0] += to_place[0] * d[0] + to_place[1] * d[1]
        smooth[i, 1] += to_speed[0] * d[0] + to_speed[1] * d[1]
    out[there] = smooth[there, 0]
    return out.reshape(np.shape(x))


def scaled_steps(ts: np.ndarray) -> np.ndarray:
    """Time since the row before over the median of the positive ones, 1e-6 at least; 1 for the first, and throughout if none is positive or one is missing."""
    if not len(ts) or np.isnan(ts).any():
        return np.ones(len(ts))
    d = np.diff(ts)
    mid = np.median(d[d > 0]) if (d > 0).any() else np.inf
    return np.concatenate([[1.0], np.maximum(d / mid, 1e-6)]) if np.isfinite(mid) else np.ones(len(ts))


@dataclass
class OneEuro:
    """Low-pass whose cut-off grows with speed; a step of no time returns the value before."""

    min_cutoff: float = 1.0
    beta: float = 0.01
    d_cutoff: float = 1.0
    t: float | None = None
    x: float = 0.0
    dx: float = 0.0

    def step(self, t: float, x: float) -> float:
        if self.t is None:
            self.t, self.x, self.dx = t, x, 0.0
            return x
        dt = (t - self.t) / 1000
        if dt <= 0:
            return self.x
        share = lambda cutoff: 1 / (1 + 1 / (2 * np.pi * cutoff) / dt)
        self.dx += share(self.d_cutoff) * ((x - self.x) / dt - self.dx)
        self.x += share(self.min_cutoff + self.beta * abs(self.dx)) * (x - self.x)
        self.t = t
        return float(self.x)


#: Weights of a new centre and scale in their running means.
CENTER_ALPHA, SCALE_ALPHA = 0.2, 0.1


@dataclass
class CausalNormalizer:
    """Running means of centre and scale, each begun by its first value and kept while nothing is seen."""

    center_x: float | None = None
    center_y: float | None = None
    center_z: float | None = None
    scale: float | None = None

    def step(self, center: list, scale: float | None) -> None:
        for name, seen, alpha in (*zip(("center_x", "center_y", "center_z"), center, [CENTER_ALPHA] * 3, strict=True), ("scale", scale, SCALE_ALPHA)):
            if seen is not None:
                held = getattr(self, name)
                setattr(self, name, seen if held is None else (1 - alpha) * held + alpha * seen)


@dataclass
class Decoder:
    """Hysteresis decoder of begin and inside probabilities into segments [start, end).

    It opens on a frame whose pb, or onset probability if there is an onset threshold, is high enough, once `guard`
    visible frames came in a row and if the activity probability, where given, allows it. A frame keeps it open if
    max(pb, pi) is at least go_on (0.6 x start within [0.25, 0.65] by default) or its activity is high enough. After
    min(min_gap, max_idle) other frames in a row it closes, waits for cooldown frames, of which the last may open
    again, and without a cooldown may open on the closing frame itself. Segments under min_length are dropped.
    """

    start: float = 0.6
    go_on: float | None = None
    min_length: int = 2
    min_gap: int = 2
    max_idle: int = 8
    cooldown: int = 0
    guard: int = 1
    onset_start: float | None = None
    active_start: float | None = None
    active_go_on: float | None = None
    opened: int | None = None
    last: int = 0
    idle: int = 0
    wait: int = 0
    visible: int = 0
    best: float = 0.0
    inside: float = 0.0
    frames: int = 0

    def _may_open(self, pb: float, active: float | None, onset: float | None) -> bool:
        strong = pb >= self.start or (self.onset_start is not None and onset is not None and onset >= self.onset_start)
        allowed = self.active_start is None or active is None or active >= self.active_start
        return strong and allowed and self.wait == 0 and self.visible >= self.guard

    def _open(self, idx: int, pb: float, pi: float) -> None:
        self.opened, self.last, self.idle, self.best, self.inside, self.frames = idx, idx, 0, pb, max(pb, pi), 1

    def step(self, idx: int, pb: float, pi: float, visible: bool = True, active: float | None = None, onset: float | None = None) -> dict | None:
        self.visible = self.visible + 1 if visible else 0
        self.wait = max(0, self.wait - 1)
        found = None
        if self.opened is not None:
            self.best, self.inside, self.frames = max(self.best, pb), self.inside + max(pb, pi), self.frames + 1
            go_on = min(0.65, max(0.25, 0.6 * self.start)) if self.go_on is None else self.go_on
            lively = self.active_go_on is not None and active is not None and active >= self.active_go_on
            if max(pb, pi) >= go_on or lively:
                self.last, self.idle = idx, 0
                return None
            self.idle += 1
            if self.idle < min(self.min_gap, self.max_idle):
                return None
            found = self.close("gap_closed")
        if self._may_open(pb, active, onset):
            self._open(idx, pb, pi)
        return found

    def close(self, reason: str) -> dict | None:
        found = {"start": self.opened, "end_excl": self.last + 1, "score": self.best, "mean_inside": self.inside / self.frames, "end_reason": reason}
        self.opened, self.idle, self.wait = None, 0, self.cooldown
        return found if found["end_excl"] - found["start"] >= self.min_length else None

    def end(self) -> dict | None:
        return None if self.opened is None else self.close("eos_closed")


def hand_guard(left: Column, right: Column, least: int = 1, both: bool = False) -> Column:
    """Whether a frame's hands, by their numbers of valid joints, are visible enough to open a segment."""
    return (left >= least) & (right >= least) if both else left + right >= least


@dataclass
class Words:
    """Accepts words that are neither blank, nor unsure, nor a repeat of the last accepted one within the pause."""

    min_conf: float = 0.5
    pause_ms: float = 1200
    word: str | None = None
    ended: float = 0.0
    sentence: list = field(default_factory=list)

    def step(self, label: str | None, conf: float, start_ms: float, end_ms: float) -> bool:
        if not label or not label.strip() or conf < self.min_conf or (label == self.word and start_ms - self.ended <= self.pause_ms):
            return False
        self.word, self.ended = label, end_ms
        self.sentence.append(label)
        return True


#: How much nearer the other side must be: for a swap by the last good wrists, and a hand's own side to count as its own.
SWAP_RATIO, SIDE_RATIO = 0.85, 0.85


def _apart(a: tuple | None, b: tuple | None) -> float | None:
    return None if a is None or b is None else float(np.hypot(a[0] - b[0], a[1] - b[1]))


@dataclass
class Association:
    """Sides of two hands against the last good wrists, which are those that it has accepted itself.

    Takes hands that are sided by the pose and not rejected. While the pose doesn't tell sides, two hands are swapped if
    the summed distance to the last good wrists falls under swap_ratio of what it is. A hand is accepted, and then is its side's last
    good one, if its own side's wrist is at most side_ratio times as far as the other's: the last good wrists, or the
    pose's where one of them isn't known.
    """

    swap_ratio: float = SWAP_RATIO
    side_ratio: float = SIDE_RATIO
    left_x: float | None = None
    left_y: float | None = None
    right_x: float | None = None
    right_y: float | None = None

    def step(self, left: tuple | None, right: tuple | None, pose_left: tuple | None, pose_right: tuple | None, ambiguous: bool) -> dict:
        good = [None if self.left_x is None else (self.left_x, self.left_y), None if self.right_x is None else (self.right_x, self.right_y)]
        swapped = False
        if ambiguous and None not in (left, right, *good):
            kept, other = _apart(left, good[0]) + _apart(right, good[1]), _apart(left, good[1]) + _apart(right, good[0])
            swapped = other < kept * self.swap_ratio
        if swapped:
            left, right = right, left
        ok = [self._own(hand, side, good, (pose_left, pose_right)) for side, hand in enumerate((left, right))]
        if ok[0]:
            self.left_x, self.left_y = left
        if ok[1]:
            self.right_x, self.right_y = right
        return {"swapped": swapped, "left_accepted": ok[0], "right_accepted": ok[1]}

    def _own(self, hand: tuple | None, side: int, good: list, pose: tuple) -> bool:
        near, far = _apart(hand, good[side]), _apart(hand, good[1 - side])
        if near is None or far is None:
            near, far = _apart(hand, pose[side]), _apart(hand, pose[1 - side])
        return near is not None and far is not None and near <= far * self.side_ratio


HANDS = ("left", "right")


def sided_hands(frames: DataFrame, least_scale: float = 0.04) -> DataFrame:
    """AR12: frames with hands put on sides by the pose and rejected if far from it: side says keep, swap or move.

    Frames: left_x, left_y, left_scale, right_x, right_y, right_scale (null if a hand is missing), pose_left_x, pose_left_y,
    pose_right_x, pose_right_y (null if unknown), left_inside, right_inside (whether the pose wrist is in the picture) and
    ambiguous (the pose wrists are too near each other to tell sides).
    """
    from pyspark.sql import functions as F

    from ..functions import arrays

    def far(hand: str, pose: str):
        return F.hypot(F.col(f"{hand}_x") - F.col(f"pose_{pose}_x"), F.col(f"{hand}_y") - F.col(f"pose_{pose}_y"))

    told = ~F.col("ambiguous") & F.col("pose_left_x").isNotNull() & F.col("pose_right_x").isNotNull()
    side = F.coalesce(F.when(told, arrays.assign_sides(far("left", "left"), far("left", "right"), far("right", "left"), far("right", "right"))), F.lit("keep"))
    crossed = F.col("side") != "keep"
    out = frames.withColumn("side", side)
    swapped = {f"{a}_{c}": F.when(crossed, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")) for a, b in (HANDS, HANDS[::-1]) for c in ("x", "y", "scale")}
    out = out.withColumns(swapped)
    gone = {h: arrays.far_from_pose(far(h, h), F.col(f"{h}_scale"), least_scale, F.col(f"{h}_inside")) for h in HANDS}
    return out.withColumns({f"{h}_{c}": F.when(~gone[h], F.col(f"{h}_{c}")) for h in HANDS for c in ("x", "y", "scale")})


def association_row(m: Association, r: dict) -> dict:
    """One step of the machine on a row of sided_hands(): the hands where they are then, whether they are accepted, and whether they were swapped."""
    at = lambda p: None if pd.isna(r[f"{p}_x"]) or pd.isna(r[f"{p}_y"]) else (float(r[f"{p}_x"]), float(r[f"{p}_y"]))
    hands = [at(h) for h in HANDS]
    made = m.step(*hands, at("pose_left"), at("pose_right"), bool(r["ambiguous"]))
    hands = hands[::-1] if made["swapped"] else hands
    return made | {f"{h}_{c}": None if x is None else x[i] for h, x in zip(HANDS, hands, strict=True) for i, c in enumerate("xy")}


ASSOCIATED = "side string, swapped boolean, left_accepted boolean, right_accepted boolean, left_x double, left_y double, right_x double, right_y double"


def associate_hands(frames: DataFrame, key: str = "sample_id", order: str = "frame_idx", **config) -> DataFrame:
    """AR12: (key, order, side, swapped, left_accepted, right_accepted, left_x, left_y, right_x, right_y) of each frame, by sided_hands() and then Association."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(c: pd.DataFrame) -> pd.DataFrame:
        m = Association(**config)
        rows = [{key: r[key], order: r[order], "side": r["side"]} | association_row(m, r) for r in c.to_dict("records")]
        return pd.DataFrame(rows)

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {ASSOCIATED}"
    names = [x.split()[0] for x in schema.split(", ")]
    need = [key, order, "side", "ambiguous", *[f"{h}_{c}" for h in HANDS for c in "xy"], *[f"pose_{h}_{c}" for h in HANDS for c in "xy"]]
    return _by_clip(sided_hands(frames).select(need), key, order, schema, lambda c: run(c)[names])


def _by_clip(df: DataFrame, key: str, order: str, schema: str, run) -> DataFrame:
    return df.groupBy(key).applyInPandas(lambda clip: run(clip.sort_values(order)), schema)


def ema_bidirectional(frames: DataFrame, x: str, alpha: float, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS21."""

    def run(c: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: c[key], order: c[order], "smooth": ema_both_ways(c[x].to_numpy(float), alpha)})

    return _by_clip(frames.select(key, order, x), key, order, f"{key} long, {order} int, smooth double", run)


def _matrix(points: pa.Array) -> np.ndarray:
    """(rows, joints, 3) of lists of points; a row that is null, empty or of another length than the first has NaN."""
    points = points.combine_chunks() if isinstance(points, pa.ChunkedArray) else points
    counts = np.array([0 if x is None else x for x in pc.list_value_length(points).to_pylist()], int)
    joints = int(counts[counts > 0][0]) if (counts > 0).any() else 1
    whole = counts == joints
    flat = points.filter(pa.array(whole)).flatten()
    out = np.full((len(points), joints, 3), np.nan)
    if whole.any():
        out[whole] = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], axis=-1).reshape(-1, joints, 3)
    return out


def _points(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The lists of points of a matrix; rows with NaN are null."""
    there = ~np.isnan(values).any(axis=(1, 2))
    flat = values[there].reshape(-1, 3)
    items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=list("xyz"))
    edges = np.concatenate([[0], np.cumsum(np.where(there, values.shape[1], 0))])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), items, mask=pa.array(~there)).cast(kind)


def _smoothed(frames: DataFrame, points: str, key: Sequence[str], order: str, smooth: Callable[[pa.Table, np.ndarray], np.ndarray], out: str) -> DataFrame:
    """Add points that smooth() makes of the clip's rows in order and their points as a matrix; a clip goes to one task as Arrow arrays."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    made = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"]))
    kind = to_arrow_type(made)
    schema = T.StructType([*frames.schema.fields, T.StructField(out, made)])

    def run(clip: pa.Table) -> pa.Table:
        clip = clip.sort_by(order)
        return clip.append_column(out, _points(smooth(clip, _matrix(clip[points])), kind))

    return frames.groupBy(*key).applyInArrow(run, schema)


def rts_smooth(frames: DataFrame, points: str, ts: str, noise: str, key: Sequence[str] = ("sample_id", "hand"), order: str = "frame_idx", out: str = "smooth") -> DataFrame:
    """WS22: points (arrays of x, y, z) smoothed over each clip, all joints and coordinates at once; noise: a row's variance.

    Steps are scaled by the clip's median positive step. Rows without points stay without.
    """
    column = lambda clip, c: clip[c].to_pandas().to_numpy(float)
    return _smoothed(frames, points, key, order, lambda clip, x: kalman_smooth(x, scaled_steps(column(clip, ts)), column(clip, noise)), out)


def measurement_variance(anchor: Column, source: Column, state: Column) -> Column:
    """WS22: the variance of a hand's points: of anchors, of observed ones of a detection pass, of interpolated ones, of the rest."""
    from pyspark.sql import functions as F

    square = lambda n: F.lit(SIGMA[n] * SIGMA[n])
    observed = source.isin("pass1", "pass2") & (state == "observed")
    return F.when(anchor, square("anchor")).when(observed, square("observed")).when(source == "interp", square("interp")).otherwise(square("predicted"))


def one_euro(frames: DataFrame, x: str, ts: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS23."""

    def run(c: pd.DataFrame) -> pd.DataFrame:
        f = OneEuro()
        return pd.DataFrame({key: c[key], order: c[order], "smooth": [f.step(t, v) for t, v in zip(c[ts], c[x], strict=True)]})

    return _by_clip(frames.select(key, order, x, ts), key, order, f"{key} long, {order} int, smooth double", run)


#: Weight of a new value in the means of the ema smoother.
EMA_ALPHA = 0.5


def postprocess_hands(
    frames: DataFrame,
    points: str,
    anchor: str,
    max_gap: int,
    smoother: str = "none",
    only_anchors: bool = True,
    source: str = "source",
    state: str = "state",
    ts: str = "ts_ms",
    key: Sequence[str] = ("sample_id", "hand"),
    order: str = "frame_idx",
) -> DataFrame:
    """WS24: frames of each hand with their points filled between anchors, then smoothed (none, ema or rts), anchors put back.

    Between two anchors all frames' points are replaced, or, without only_anchors, those that are missing, held, tracked,
    occluded or not observed. Adds value (the points), applied and overrode (a detected hand gave way), source and state as
    they are then, and shift: how far smoothing moved the wrist, null for anchors and where a wrist is missing.
    """
    from pyspark.sql import functions as F

    from ..functions.clean import should_replace
    from .seq import fill_hand_gaps

    own = frames.withColumnsRenamed({source: "__source", state: "__state"})
    swap = F.lit(True) if only_anchors else F.coalesce(should_replace(F.col(points).isNotNull(), F.col("__source"), F.col("__state")), F.lit(True))
    filled = fill_hand_gaps(own, points, F.col(anchor), max_gap, list(key), order, swap)
    made = F.col("source") == "interp"
    filled = filled.withColumns({
        "applied": made, "overrode": made & F.lit(only_anchors) & F.col(points).isNotNull() & F.coalesce(F.col("__source").isin("pass1", "pass2"), F.lit(False)),
        "source": F.when(made, "interp").otherwise(F.col("__source")), "state": F.when(made, "predicted").otherwise(F.col("__state")),
    }).drop("__source", "__state")
    if smoother == "ema":
        smooth = _smoothed(filled, "filled", key, order, lambda clip, x: ema_both_ways(x, EMA_ALPHA), "value")
    elif smoother == "rts":
        noisy = filled.withColumn("__noise", measurement_variance(F.col(anchor), F.col("source"), F.col("state")))
        smooth = rts_smooth(noisy, "filled", ts, "__noise", key, order, "value").drop("__noise")
    else:
        smooth = filled.withColumn("value", F.col("filled"))
    smooth = smooth.withColumn("value", F.when(F.col(anchor), F.col("filled")).otherwise(F.col("value")))
    d = [F.get("value", F.lit(0))[c] - F.get("filled", F.lit(0))[c] for c in "xyz"]
    moved = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return smooth.withColumn("shift", F.when(~F.col(anchor), moved)).drop("filled")


def postprocess_stats(done: DataFrame, key: Sequence[str] = ("sample_id", "hand"), order: str = "frame_idx") -> DataFrame:
    """WS24: per clip and hand the frames and gaps that were filled, and the mean shift of the wrist by smoothing."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    starts = F.col("applied") & ~F.coalesce(F.lag("applied").over(W.partitionBy(*key).orderBy(order)), F.lit(False))
    marked = done.withColumn("__start", starts)
    return marked.groupBy(*key).agg(F.count_if("applied").alias("filled"), F.count_if("__start").alias("gaps_filled"), F.coalesce(F.avg("shift"), F.lit(0.0)).alias("smoothing_delta"))


def causal_normalize(frames: DataFrame, points: str = "points", mask: str = "mask", hand: int = joints.HAND, least: int = joints.LEAST_JOINTS, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS25: frames with points (x, y, z of each joint, left hand first) less a running centre, over a running scale, times mask.

    What a frame says about centre and scale are expressions on its arrays; the running means are windows, so that all of
    it stays in the JVM. Adds center_x, center_y, center_z and scale.
    """
    from pyspark.sql import functions as F

    from .seq import running_means

    seen = joints.with_candidates(frames, points, mask, hand, least)
    centered = running_means(seen, {f"seen_{c}": f"center_{c}" for c in "xyz"}, CENTER_ALPHA, key, order)
    scaled = running_means(centered, {"seen_scale": "scale"}, SCALE_ALPHA, key, order)
    return joints.normalized(scaled.drop(*[f"seen_{c}" for c in "xyz"], "seen_scale"), points, mask)


def decode_segments(frames: DataFrame, pb: str = "pb", pi: str = "pi", visible: str = "h1", key: str = "sample_id", order: str = "frame_idx", active: str | None = None, onset: str | None = None, **config) -> DataFrame:
    """WS29: the decoder over whole clips, an open segment closed at the end; active, onset: columns of the gates' probabilities."""
    gates = {n: c for n, c in (("active", active), ("onset", onset)) if c}
    names = ("start", "end_excl", "score", "mean_inside", "end_reason")

    def run(c: pd.DataFrame) -> pd.DataFrame:
        d = Decoder(**config)
        more = [dict(zip(gates, (None if np.isnan(x) else x for x in r), strict=True)) for r in c[list(gates.values())].astype(float).itertuples(index=False)] if gates else [{}] * len(c)
        made = [d.step(int(i), b, p, bool(v), **g) for i, b, p, v, g in zip(c[order], c[pb], c[pi], c[visible], more, strict=True)] + [d.end()]
        rows = [x for x in made if x]
        return pd.DataFrame({key: [c[key].iloc[0]] * len(rows)} | {n: [r[n] for r in rows] for n in names})

    return _by_clip(frames.select(key, order, *dict.fromkeys([pb, pi, visible, *gates.values()])), key, order, f"{key} long, start int, end_excl int, score double, mean_inside double, end_reason string", run)


def sentence_words(preds: DataFrame, session: str = "session_id", **config) -> DataFrame:
    """WS28: predictions with accepted and the sentence so far, in order of start."""

    def run(c: pd.DataFrame) -> pd.DataFrame:
        w, ok, said = Words(**config), [], []
        for r in c.itertuples():
            ok.append(w.step(r.label, r.conf, r.start_ms, r.end_ms))
            said.append(" ".join(w.sentence))
        return pd.DataFrame({session: c[session], "start_ms": c["start_ms"], "label": c["label"], "accepted": ok, "sentence": said})

    return _by_clip(preds, session, "start_ms", f"{session} long, start_ms long, label string, accepted boolean, sentence string", run)


def seam_steps(parts: DataFrame, frames: DataFrame, x: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS31: mean step of x at part boundaries and inside parts; parts: (key, part, length) laid end to end."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    w = W.partitionBy(key).orderBy("part")
    at = F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    seams = parts.withColumn("at", at).where("at > 0").select(key, F.col("at").cast("int").alias(order), F.lit(True).alias("seam"))
    step = frames.withColumn("step", F.abs(F.col(x) - F.lag(x).over(W.partitionBy(key).orderBy(order)))).where("step is not null")
    both = step.join(seams.distinct(), [key, order], "left")
    return both.groupBy(key).agg(F.avg(F.when(F.col("seam"), F.col("step"))).alias("at_seams"), F.avg(F.when(F.col("seam").isNull(), F.col("step"))).alias("inside"), F.count("seam").alias("seams"))


#: Parts that only join others, and the beginning of the role of parts that only fill up.
BETWEEN, PAD = "transition", "pad"


def typed_seams(parts: DataFrame, frames: DataFrame, points: str = "points", mask: str = "mask", hand: int = joints.HAND, least: int = joints.LEAST_JOINTS, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS31: a row for every step between neighbouring frames of a clip and scope, with the parts on both sides.

    parts: (key, part, length, type, source, role), laid end to end; frames from 0. Scope expanded has all parts. Scope
    semantic leaves transitions out, so that what they join are neighbours, and steps at the edge of a pad. Rows: scope,
    seam (whether the parts differ), pair (their types as a->b), same_source, center_delta, scale_delta (null where a frame
    doesn't tell).
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    ends = F.sum("length").over(W.partitionBy(key).orderBy("part"))
    laid = parts.select(key, "part", "type", "source", F.coalesce("role", F.lit("")).startswith(PAD).alias("pad"), (ends - F.col("length")).alias("first"), ends.alias("end"))
    seen = joints.with_candidates(frames.select(key, order, points, mask), points, mask, hand, least).drop(points, mask)
    placed = seen.join(laid, key).where((F.col(order) >= F.col("first")) & (F.col(order) < F.col("end"))).drop("first", "end")
    scopes = F.array(F.lit("expanded"), F.when(F.col("type") != BETWEEN, F.lit("semantic")))
    rows = placed.withColumn("scope", F.explode(F.array_compact(scopes)))
    w = W.partitionBy(key, "scope").orderBy(order)
    was = lambda c: F.lag(c).over(w)
    steps = rows.select(
        key, "scope", order, (F.col("part") != was("part")).alias("seam"), F.concat(was("type"), F.lit("->"), F.col("type")).alias("pair"),
        F.col("source").eqNullSafe(was("source")).alias("same_source"), (F.col("pad") | was("pad")).alias("edge"), was("part").alias("before"),
        F.sqrt(sum(((F.col(f"seen_{c}") - was(f"seen_{c}")) * (F.col(f"seen_{c}") - was(f"seen_{c}")) for c in "xyz"), F.lit(0.0))).alias("center_delta"),
        F.abs(F.col("seen_scale") - was("seen_scale")).alias("scale_delta"),
    )
    padded = (F.col("scope") == "semantic") & F.col("edge")
    return steps.where(F.col("before").isNotNull() & ~padded).drop("edge", "before")


def seam_deltas(steps: DataFrame) -> DataFrame:
    """WS31: by scope and seam or not: steps, mean and 95th percentile of the changes of centre and scale."""
    from pyspark.sql import functions as F

    of = lambda c: [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.percentile(c, F.lit(0.95)), F.lit(0.0)).alias(f"{c}_p95")]
    return steps.groupBy("scope", "seam").agg(F.count("*").alias("steps"), *of("center_delta"), *of("scale_delta"))


def seam_counts(steps: DataFrame) -> DataFrame:
    """WS31: boundaries by scope and pair of types, with those between parts of one source."""
    from pyspark.sql import functions as F

    return steps.where("seam").groupBy("scope", "pair").agg(F.count("*").alias("seams"), F.count_if("same_source").alias("same_source"))


def steps(rows: Iterable[tuple], machine) -> list:
    """Run a machine over rows; for tests and for small tables."""
    return [machine.step(*r) for r in rows]
