"""Landmarks of a frame as arrays of points and masks: what a frame says about centre and scale, normalising, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double,z:double>>"
#: Joints of a hand, the first of which is its wrist, the left hand first; visible ones that a scale needs; smallest scale.
HAND, LEAST_JOINTS, SMALLEST_SCALE = 21, 4, 1e-3
#: Square of the shortest length that a feature has.
SHORTEST = 1e-6


def _finite(v: Column) -> Column:
    big = F.lit(float("inf"))
    return F.when(v.isNotNull() & ~F.isnan(v) & (v < big) & (v > -big), v.cast("double")).otherwise(0.0)


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def clean_points(points: str | Column) -> Column:
    """Points with 0 for what is missing or not finite."""
    return F.transform(points, lambda p: _point(*[_finite(p[c]) for c in "xyz"]))


def clean_mask(mask: str | Column) -> Column:
    return F.transform(mask, _finite)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _visible(points: Column, mask: Column) -> Column:
    """The visible ones of clean points."""
    both = F.arrays_zip(points.alias("p"), mask.alias("m"))
    return F.transform(F.filter(both, lambda b: b["m"] > 0.5), lambda b: b["p"])


def _mean_point(points: Column) -> Column:
    """The mean of points, null if there are none."""
    total = F.aggregate(points, _point(*[F.lit(0.0)] * 3), lambda s, p: _point(*[s[c] + p[c] for c in "xyz"]))
    return _bind(F.struct(total.alias("t"), F.size(points).alias("n")), lambda s: F.when(s["n"] > 0, _point(*[s["t"][c] / s["n"] for c in "xyz"])))


def _hand(a: Column, side: int, hand: int) -> Column:
    return F.slice(a, side * hand + 1, hand)


def _length(p: Column, q: Column | None = None) -> Column:
    d = [p[c] - q[c] if q is not None else p[c] for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _bind(value: Column, of) -> Column:
    """of(value), the value being computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _wrists(points: Column, mask: Column, hand: int) -> Column:
    return _visible(F.array(F.get(points, F.lit(0)), F.get(points, F.lit(hand))), F.array(F.get(mask, F.lit(0)), F.get(mask, F.lit(hand))))


def wrist_center(points: str, mask: str, hand: int = HAND) -> Column:
    """The mean of the visible wrists, null if there is none."""
    return _mean_point(_wrists(clean_points(points), clean_mask(mask), hand))


def with_candidates(frames: DataFrame, points: str, mask: str, hand: int = HAND, least: int = LEAST_JOINTS) -> DataFrame:
    """WS25: what a frame says of centre and scale, null where it says nothing; points and mask are cleaned.

    seen_x, seen_y, seen_z: the mean of the visible wrists, else of all visible joints; seen_scale: the mean over hands of the mean
    distance of visible joints from their visible wrist, if `least` (2 at least) are visible.
    """
    clean = frames.withColumns({points: clean_points(points), mask: clean_mask(mask)})
    p, m = F.col(points), F.col(mask)

    def scale(side: int) -> Column:
        wrist = F.get(p, F.lit(side * hand))
        joints = _visible(_hand(p, side, hand), _hand(m, side, hand))
        far = F.filter(F.transform(joints, lambda q: _length(q, wrist)), lambda d: d > 1e-6)
        mean = _bind(far, lambda d: F.when(F.size(d) > 0, _total(d) / F.size(d)))
        return F.when((F.get(m, F.lit(side * hand)) > 0.5) & (F.size(joints) >= max(2, least)), mean)

    made = clean.withColumn("__seen", F.coalesce(_mean_point(_wrists(p, m, hand)), _mean_point(_visible(p, m)))).withColumn("__scales", F.array_compact(F.array(scale(0), scale(1))))
    size = F.when(F.size("__scales") > 0, F.greatest(_total(F.col("__scales")) / F.size("__scales"), F.lit(SMALLEST_SCALE)))
    return made.withColumns({f"seen_{c}": F.col(f"__seen.{c}") for c in "xyz"} | {"seen_scale": size}).drop("__seen", "__scales")


def visible_sum(mask: str | Column) -> Column:
    return _total(clean_mask(mask))


def normalized(frames: DataFrame, points: str = "points", mask: str = "mask") -> DataFrame:
    """WS25: the frames with points less centre, over scale, times mask; a centre or scale that isn't known yet is 0 or 1."""
    center = [F.coalesce(f"center_{c}", F.lit(0.0)) for c in "xyz"]
    scale = F.greatest(F.coalesce("scale", F.lit(1.0)), F.lit(SMALLEST_SCALE))
    both = F.arrays_zip(clean_points(points).alias("p"), clean_mask(mask).alias("m"))
    norm = F.transform(both, lambda b: _point(*[(b["p"][c] - o) / scale * b["m"] for c, o in zip("xyz", center, strict=True)]))
    return frames.withColumn(points, norm).drop(mask).withColumns({f"center_{c}": o for c, o in zip("xyz", center, strict=True)} | {"scale": scale})


def frame_features(frames: DataFrame, hand: int = HAND) -> Column:
    """ST9: velocity, acceleration and ten sums of a frame's points and mask against those of the two frames before (points_1,
    mask_1, points_2, mask_2, null before the first): share of visible joints, mean speed and acceleration, distance of the
    wrists, spread and speed of each hand, and the means of both spreads and speeds. A motion counts where the joint is
    visible in all its frames; lengths are 0.001 at least where they count."""
    empty = lambda c, other: F.coalesce(c, F.transform(other, lambda v: v * 0.0))
    m0 = clean_mask("mask")
    m1, m2 = empty(clean_mask("mask_1"), m0), empty(clean_mask("mask_2"), m0)

    def shown(points: str, m: Column) -> Column:
        p = F.coalesce(clean_points(points), F.transform(m0, lambda v: _point(v * 0.0, v * 0.0, v * 0.0)))
        return F.zip_with(p, m, lambda q, v: _point(q["x"] * v, q["y"] * v, q["z"] * v))

    def minus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda p, q: _point(p["x"] - q["x"], p["y"] - q["y"], p["z"] - q["z"]))

    def times(a: Column, m: Column) -> Column:
        return F.zip_with(a, m, lambda p, v: _point(p["x"] * v, p["y"] * v, p["z"] * v))

    product = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)

    def made(c0: Column, c1: Column, c2: Column) -> Column:
        v0, v1 = times(minus(c0, c1), product(m0, m1)), times(minus(c1, c2), product(m1, m2))
        return _bind(F.struct(c0.alias("c"), v0.alias("v"), times(minus(v0, v1), product(product(m0, m1), m2)).alias("a")), sums)

    def length(p: Column) -> Column:
        return F.sqrt(F.greatest(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"], F.lit(SHORTEST)))

    def mean_length(a: Column, m: Column) -> Column:
        return _total(F.zip_with(a, m, lambda p, v: length(p) * v)) / F.greatest(_total(m), F.lit(1.0))

    def sums(s: Column) -> Column:
        wrists = [F.get(s["c"], F.lit(side * hand)) for side in (0, 1)]
        apart = length(_point(*[wrists[0][c] - wrists[1][c] for c in "xyz"])) * F.least(F.get(m0, F.lit(0)) * F.get(m0, F.lit(hand)), F.lit(1.0))
        from_wrist = lambda a, w: F.transform(a, lambda p: _point(p["x"] - w["x"], p["y"] - w["y"], p["z"] - w["z"]))
        spread = [mean_length(from_wrist(_hand(s["c"], side, hand), wrists[side]), _hand(m0, side, hand)) for side in (0, 1)]
        speed = [mean_length(_hand(s["v"], side, hand), _hand(m0, side, hand)) for side in (0, 1)]
        named = {
            "velocity": s["v"], "acceleration": s["a"], "visible_share": _total(m0) / F.size(m0), "mean_speed": mean_length(s["v"], m0), "mean_acceleration": mean_length(s["a"], m0), "wrist_distance": apart,
            "left_spread": spread[0], "right_spread": spread[1], "left_speed": speed[0], "right_speed": speed[1], "hand_speed": (speed[0] + speed[1]) * 0.5, "hand_spread": (spread[0] + spread[1]) * 0.5,
        }
        return F.struct(*[c.alias(n) for n, c in named.items()])

    return made(shown("points", m0), shown("points_1", m1), shown("points_2", m2))
