"""Ordered-sequence operators: every function works on clips (`key`) in frame order (`order`) and shuffles on the key once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays, joints


def over(key: str, order: str) -> W:
    return W.partitionBy(key).orderBy(order)


def frame_motion(frames: DataFrame, x: str, valid: str, ts: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS1: |x - previous x| where both are valid, else 0; divided by the step in time only if every step of the clip is positive."""
    w = over(key, order)
    step = frames.withColumn("dt", F.col(ts) - F.lag(ts).over(w)).withColumn("least_dt", F.min("dt").over(W.partitionBy(key)))
    both = F.col(valid) & F.coalesce(F.lag(valid).over(w), F.lit(False))
    move = F.when(both, F.abs(F.col(x) - F.lag(x).over(w))).otherwise(0.0)
    return step.withColumn("motion", F.when(F.col("least_dt") > 0, move / F.col("dt")).otherwise(move)).withColumn("motion", F.coalesce("motion", F.lit(0.0))).drop("dt", "least_dt")


def velocity(frames: DataFrame, x: str, ts: str, fps: float = 30.0, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS2: change of x per second, steps under 1 ms counting as 1 ms; 1/fps throughout if no timestamp of the clip differs."""
    w = over(key, order)
    flat = F.max(ts).over(W.partitionBy(key)) == F.min(ts).over(W.partitionBy(key))
    dt = F.when(flat, F.lit(1 / fps)).otherwise(F.greatest(F.col(ts) - F.lag(ts).over(w), F.lit(1)) / 1000)
    return frames.withColumn("velocity", F.coalesce((F.col(x) - F.lag(x).over(w)) / dt, F.lit(0.0)))


def smooth_box(frames: DataFrame, x: str, win: int, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS4: moving sum over win frames divided by win, frames beyond the ends counting zero; a copy if win <= 1 or longer than the clip."""
    near = over(key, order).rowsBetween(-(win // 2), win - 1 - win // 2)
    n = F.count("*").over(W.partitionBy(key))
    return frames.withColumn("smooth", F.col(x) if win <= 1 else F.when(n < win, F.col(x)).otherwise(F.sum(x).over(near) / win))


def smooth_tracks(frames: DataFrame, x: str, radius: int = 2, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS5: mean of the non-null values within radius frames; null stays null."""
    return frames.withColumn("smooth", F.when(F.col(x).isNotNull(), F.avg(x).over(over(key, order).rowsBetween(-radius, radius))))


def deflicker(frames: DataFrame, flag: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS6: majority of three neighbouring frames, frames beyond the ends counting false."""
    return frames.withColumn("steady", F.sum(F.col(flag).cast("int")).over(over(key, order).rowsBetween(-1, 1)) >= 2)


def forward_fill(frames: DataFrame, x: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS7: the last non-null value so far, and whether it was carried."""
    filled = F.last(x, ignorenulls=True).over(over(key, order).rowsBetween(W.unboundedPreceding, 0))
    return frames.withColumn("filled", filled).withColumn("interpolated", F.col(x).isNull() & F.col("filled").isNotNull())


def ema(frames: DataFrame, x: str, alpha: float, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS7: last value of the exponential mean of a clip, seeded by its first value, as a fold over the clip's sorted values."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, x))), lambda r: r[x])
    rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    return frames.groupBy(key).agg(values.alias("v")).select(key, F.aggregate(rest, F.get("v", F.lit(0)), lambda s, y: s * (1 - alpha) + y * alpha).alias("ema"))


def running_means(frames: DataFrame, columns: dict[str, str], alpha: float, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS25: exponential means so far of columns that are null together, each begun by its first value; a null leaves the mean as it is.

    As sums over windows instead of step by step: weights are powers of 1 - alpha, in blocks of so many values that the
    block before the last no longer counts in a double. columns: the names of the means by column.
    """
    fade = 1 - alpha
    size = max(1, math.ceil(math.log(1e-17) / math.log(fade)))
    w = over(key, order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    seen = F.col(next(iter(columns)))
    out = frames.withColumn("__n", F.count(seen).over(so_far))
    place = F.greatest("__n", F.lit(1)) - 1
    out = out.withColumns({"__block": F.floor(place / size), "__place": (place % size).cast("double")})
    weight = F.when(F.col("__n") == 1, 1.0).otherwise(alpha) * F.pow(F.lit(fade), -F.col("__place"))
    within = W.partitionBy(*([key] if isinstance(key, str) else key), "__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumns({f"__{name}": F.sum(F.when(seen.isNotNull(), F.col(x) * weight)).over(within) * F.pow(F.lit(fade), F.col("__place")) for x, name in columns.items()})
    ended = seen.isNotNull() & (F.col("__place") == size - 1)
    last = lambda c, rows: F.last(c, ignorenulls=True).over(rows)
    closed = {name: last(F.when(ended, F.col(f"__{name}")), w.rowsBetween(W.unboundedPreceding, -1)) for name in columns.values()}
    out = out.withColumns({f"__closed_{name}": c for name, c in closed.items()})
    before = lambda name: F.when(F.col("__block") > 0, F.col(f"__closed_{name}") * F.pow(F.lit(fade), F.col("__place") + 1)).otherwise(0.0)
    out = out.withColumns({name: last(F.when(seen.isNotNull(), F.col(f"__{name}") + before(name)), so_far) for name in columns.values()})
    return out.drop("__n", "__block", "__place", *[f"__{p}{name}" for p in ("", "closed_") for name in columns.values()])


def runs(frames: DataFrame, flag: Column, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS8, UD5: maximal runs of frames on which the flag holds: start, end (inclusive), length."""
    w = over(key, order)
    marked = frames.withColumn("on", F.coalesce(flag, F.lit(False))).withColumn("rank", F.row_number().over(w))
    island = F.col("rank") - F.row_number().over(W.partitionBy(key, "on").orderBy(order))
    grouped = marked.withColumn("island", island).where("on").groupBy(key, "island")
    return grouped.agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")).drop("island")


def gap_stats(frames: DataFrame, present: Column, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS8: median, p90, largest and mean length of each clip's gaps, 0 when there are none."""
    gaps = runs(frames, ~present, key, order).groupBy(key)
    made = gaps.agg(F.percentile("length", F.lit(0.5)).alias("gap_p50"), F.percentile("length", F.lit(0.9)).alias("gap_p90"), F.max("length").alias("gap_max"), F.avg("length").alias("gap_mean"))
    return frames.select(key).distinct().join(made, key, "left").na.fill(0)


def longest_run(frames: DataFrame, flag: Column, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS9: length of each clip's longest run, 0 when there is none."""
    made = runs(frames, flag, key, order).groupBy(key).agg(F.max("length").alias("longest"))
    return frames.select(key).distinct().join(made, key, "left").na.fill(0)


def outlier_jumps(frames: DataFrame, x: str, scale: str, present: str, shift: float = 2.5, ratio: float = 1.6, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS10: per clip, consecutive present frames whose shift exceeds shift x the previous scale or whose scales differ by over ratio."""
    w = over(key, order)
    was, before = F.lag(scale).over(w), F.coalesce(F.lag(present).over(w), F.lit(False))
    moved = F.abs(F.col(x) - F.lag(x).over(w)) > shift * was
    grown = (F.greatest(F.col(scale), was) > ratio * F.least(F.col(scale), was)) & (F.least(F.col(scale), was) > 0)
    jump = F.col(present) & before & (moved | grown)
    return frames.withColumn("jump", jump).groupBy(key).agg(F.count_if("jump").alias("jumps"))


def toggles(frames: DataFrame, x: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS11: number of changes between consecutive frames, and their share of all steps (0 for a clip of one frame)."""
    changed = frames.withColumn("changed", F.coalesce(F.lag(x).over(over(key, order)) != F.col(x), F.lit(False)))
    return changed.groupBy(key).agg(F.count_if("changed").alias("changes"), (F.count_if("changed") / F.greatest(F.count("*") - 1, F.lit(1))).alias("rate"))


def active_segment(frames: DataFrame, motion: str, valid: str, p: float = 0.75, least: float = 0.0, hysteresis: float = 0.5, pad: int = 2, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS12: per clip the first and last frame of the active segment.

    The on-threshold is a percentile of the valid frames' motion, at least `least`. From the earliest peak the segment
    grows over frames of at least hysteresis x threshold on both sides, then by pad frames inside the clip.
    """
    part = W.partitionBy(key)
    top = F.greatest(F.percentile(F.when(F.col(valid), F.col(motion)), F.lit(p)).over(part), F.lit(least))
    found = frames.withColumn("thr", top).withColumn("peak", F.max_by(order, F.struct(motion, -F.col(order))).over(part))
    low = F.col(motion) < hysteresis * F.col("thr")
    ends = found.groupBy(key).agg(
        F.first("peak").alias("peak"), F.min(order).alias("lo"), F.max(order).alias("hi"),
        F.max(F.when(low & (F.col(order) < F.col("peak")), F.col(order))).alias("before"), F.min(F.when(low & (F.col(order) > F.col("peak")), F.col(order))).alias("after"),
    )
    start = F.greatest(F.coalesce(F.col("before") + 1, F.col("lo")) - pad, F.col("lo"))
    return ends.select(key, "peak", start.alias("start"), F.least(F.coalesce(F.col("after") - 1, F.col("hi")) + pad, F.col("hi")).alias("end"))


def tag_segments(frames: DataFrame, segments: DataFrame, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS13: tags 1 at a clip's segment start, 2 up to its end (inclusive), 0 outside or without a segment."""
    at = F.col(order)
    tag = F.when(at == F.col("start"), 1).when(at.between(F.col("start"), F.col("end")), 2).otherwise(0)
    return frames.join(segments.select(key, "start", "end"), key, "left").withColumn("bio", tag).drop("start", "end")


def bio_segments(frames: DataFrame, tag: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS14: segments that begin (1) opens and inside (2) continues, as start, end and length; an inside that follows outside is no segment."""
    w = over(key, order)
    opened = frames.withColumn("island", F.sum(F.when(F.col(tag) != 2, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = opened.groupBy(key, "island").agg(F.min(F.when(F.col(tag) == 1, F.col(order))).alias("start"), F.max(F.when(F.col(tag) != 0, F.col(order))).alias("end"))
    return inside.where("start is not null").select(key, "start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def bio_violations(frames: DataFrame, tag: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS14: number and share of inside tags that no begin leads to, per clip."""
    w = over(key, order)
    island = F.sum(F.when(F.col(tag) != 2, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = frames.withColumn("island", island)
    opened = F.max(F.when(F.col(tag) == 1, 1).otherwise(0)).over(W.partitionBy(key, "island"))
    orphan = marked.withColumn("orphan", (F.col(tag) == 2) & (opened == 0))
    return orphan.groupBy(key).agg(F.count_if("orphan").alias("violations"), (F.count_if("orphan") / F.count("*")).alias("rate"))


def onset_band(frames: DataFrame, tag: str, width: int, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS15: true on a begin and the width - 1 frames after it."""
    return frames.withColumn("onset", F.max((F.col(tag) == 1).cast("int")).over(over(key, order).rowsBetween(-(width - 1), 0)) == 1)


def startup_prefix(frames: DataFrame, visible: str, n: int, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS16: first_visible is where the first run of n visible frames begins (null if none does); startup is all before it."""
    w = over(key, order)
    back = w.rowsBetween(-(n - 1), 0)
    stable = (F.min(F.col(visible).cast("int")).over(back) == 1) & (F.count("*").over(back) == n)
    found = frames.withColumn("first_visible", F.when(stable, F.lag(order, n - 1).over(w)))
    found = found.withColumn("first_visible", F.min("first_visible").over(W.partitionBy(key)))
    return found.withColumn("startup", F.col("first_visible").isNull() | (F.col(order) < F.col("first_visible")))


def best_window(frames: DataFrame, score: Column, size: int, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS17, WS18: the earliest window of `size` frames with the largest sum of score (fewer frames: those there are)."""
    w = over(key, order).rowsBetween(0, size - 1)
    summed = frames.withColumn("total", F.round(F.sum(score).over(w), 9)).withColumn("held", F.count("*").over(w))
    summed = summed.withColumn("most", F.max("held").over(W.partitionBy(key))).where("held = most")
    return summed.groupBy(key).agg(F.max_by(order, F.struct(F.col("total"), -F.col(order))).alias("start"), F.max("total").alias("total"))


def coverage_ladder(frames: DataFrame, score: str, thresholds: Sequence[float], size: int, ratio: float, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS17: of the thresholds, in order, the first whose best window is covered by at least ratio, else the best seen."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("thr")) for i, t in enumerate(thresholds)])
    spread = frames.withColumn("t", F.explode(steps)).select(key, order, score, "t.step", "t.thr")
    w = W.partitionBy(key, "step").orderBy(order).rowsBetween(0, size - 1)
    spread = spread.withColumn("valid", F.sum((F.col(score) >= F.col("thr")).cast("int")).over(w)).withColumn("held", F.count("*").over(w))
    spread = spread.withColumn("most", F.max("held").over(W.partitionBy(key, "step"))).where("held = most")
    best = spread.groupBy(key, "step", "thr").agg(F.max_by(F.struct(order, "valid"), F.struct(F.col("valid"), -F.col(order))).alias("b"), F.max("held").alias("held"))
    good = F.col("b.valid") >= ratio * F.col("held")
    rank = F.struct(good.cast("int"), F.when(good, -F.col("step")).otherwise(F.col("b.valid")), -F.col("step"))
    pick = best.groupBy(key).agg(F.max_by(F.struct("step", "thr", "b"), rank).alias("x"))
    return pick.select(key, "x.step", "x.thr", F.col(f"x.b.{order}").alias("start"), F.col("x.b.valid").alias("valid"))


def tune_threshold(frames: DataFrame, score: str, thresholds: Sequence[float], key: str = "sample_id") -> DataFrame:
    """WS19: per clip the threshold, of those that keep most frames, that is highest, and its coverage."""
    spread = frames.select(key, score, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("thr"))
    cover = spread.groupBy(key, "thr").agg(F.avg((F.coalesce(F.col(score), F.lit(0.0)) >= F.col("thr")).cast("double")).alias("coverage"))
    return cover.groupBy(key).agg(F.max_by("thr", F.struct("coverage", "thr")).alias("thr"), F.max("coverage").alias("coverage"))


def anchors(frames: DataFrame, anchor: Column, x: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """JN8: the previous and next anchor row of each frame, itself included, as order and value."""
    w = over(key, order)
    here = F.when(anchor, F.struct(F.col(order).alias("at"), F.col(x).alias("x")))
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    return frames.withColumn("prev", F.last(here, ignorenulls=True).over(back)).withColumn("next", F.first(here, ignorenulls=True).over(ahead))


def fill_gaps(frames: DataFrame, x: str, anchor: Column, max_gap: int, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS20: values between two anchors with at most max_gap frames between them are interpolated; source says observed, interp or missing."""
    near = anchors(frames, anchor, x, key, order)
    span = F.col("next.at") - F.col("prev.at")
    inside = ~anchor & span.isNotNull() & (span - 1 <= max_gap)
    value = F.col("prev.x") + (F.col("next.x") - F.col("prev.x")) * (F.col(order) - F.col("prev.at")) / span
    out = near.withColumn("filled", F.when(anchor, F.col(x)).when(inside, value))
    return out.withColumn("source", F.when(anchor, "observed").when(inside, "interp").otherwise("missing")).drop("prev", "next")


def fill_hand_gaps(frames: DataFrame, points: str, anchor: Column, max_gap: int, key: str | list[str] = "sample_id", order: str = "frame_idx", replace: Column | None = None) -> DataFrame:
    """WS20 on landmarks: between two anchors with at most max_gap frames between them wrist, scale and scaled offsets of the points (x, y, z) are interpolated.

    x and y are clamped to [0, 1]. replace: which frames between anchors give their own points up (all by default); other
    frames keep theirs. Adds filled and source (observed for anchors, interp, own, or missing).
    """

    def form(p: Column) -> Column:
        wrist, scale = F.get(p, F.lit(0)), F.greatest(arrays.points_scale(p), F.lit(1e-6))
        return F.struct(wrist.alias("wrist"), scale.alias("scale"), F.transform(p, lambda q: F.struct(*[((q[c] - wrist[c]) / scale).alias(c) for c in "xyz"])).alias("offsets"))

    near = anchors(frames.withColumn("__form", F.when(anchor, form(F.col(points)))), anchor, "__form", key, order)
    span = F.col("next.at") - F.col("prev.at")
    inside = ~anchor & span.isNotNull() & (span - 1 <= max_gap) & (F.lit(True) if replace is None else replace)
    t = (F.col(order) - F.col("prev.at")) / span
    mix = lambda a, b: a * (1 - t) + b * t
    clamp = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    a, b = F.col("prev.x"), F.col("next.x")

    def point(p: Column, q: Column) -> Column:
        at = {c: mix(a["wrist"][c], b["wrist"][c]) + mix(a["scale"], b["scale"]) * mix(p[c], q[c]) for c in "xyz"}
        return F.struct(clamp(at["x"]).alias("x"), clamp(at["y"]).alias("y"), at["z"].alias("z"))

    n = F.least(F.size(a["offsets"]), F.size(b["offsets"]))
    made = F.zip_with(F.slice(a["offsets"], F.lit(1), n), F.slice(b["offsets"], F.lit(1), n), point)
    inside = inside & (n > 0)
    out = near.withColumn("filled", F.when(inside, made).otherwise(F.col(points)))
    source = F.when(anchor, "observed").when(inside, "interp").when(F.col(points).isNotNull(), "own").otherwise("missing")
    return out.withColumn("source", source).drop("prev", "next", "__form")


def gap_fill_counts(filled: DataFrame, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS20: per clip the frames and the gaps that were filled."""
    starts = (F.col("source") == "interp") & ~F.coalesce(F.lag("source").over(over(key, order)) == "interp", F.lit(False))
    return filled.withColumn("__start", starts).groupBy(key).agg(F.count_if(F.col("source") == "interp").alias("frames_filled"), F.count_if("__start").alias("gaps_filled"))


def clip_runs(frames: DataFrame, present: str, x: str, low: float, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS26: per clip the longest hand, no-hand and low-motion runs, startup gap, mean change of position."""
    w = over(key, order)
    moved = frames.withColumn("step", F.abs(F.col(x) - F.lag(x).over(w)))
    base = moved.groupBy(key).agg(F.avg("step").alias("mean_step"), F.coalesce(F.min(F.when(F.col(present), F.col(order))), F.count("*")).cast("int").alias("startup_gap"))
    on = longest_run(frames, F.col(present), key, order).withColumnRenamed("longest", "hand_run")
    off = longest_run(frames, ~F.col(present), key, order).withColumnRenamed("longest", "no_hand_run")
    still = longest_run(moved, F.col("step") < low, key, order).withColumnRenamed("longest", "still_run")
    return base.join(on, key).join(off, key).join(still, key)


def motion_runs(frames: DataFrame, points: str = "points", mask: str = "mask", quiet: float = 1e-3, hand: int = joints.HAND, least: int = joints.LEAST_JOINTS, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS26: all runs of hand, no_hand and still frames of each clip, its length as kind sequence, and a leading no-hand run again as startup: (key, kind, start, length).

    A frame is still if the mean of its visible wrists moved by `quiet` at most; so is the first of a clip of several.
    All flags' runs come from one sort of the clip.
    """
    w = over(key, order)
    seen = frames.select(key, order, joints.wrist_center(points, mask, hand).alias("__wrist"), (joints.visible_sum(mask) > 0.5).alias("hand"))
    d = [F.col(f"__wrist.{c}") - F.lag(f"__wrist.{c}").over(w) for c in "xyz"]
    moved = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    first = F.row_number().over(w) == 1
    many = F.lead(order).over(w).isNotNull()
    flags = seen.select(key, order, "hand", (~F.col("hand")).alias("no_hand"), F.when(first, many).otherwise(F.coalesce(moved <= quiet, F.lit(False))).alias("still"), first.alias("__first"))
    kinds = ("hand", "no_hand", "still")
    begins = flags.withColumns({f"__{k}": F.sum((F.col(k) & ~F.coalesce(F.lag(k).over(w), F.lit(False))).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)) for k in kinds})
    each = F.array(*[F.when(F.col(k), F.struct(F.lit(k).alias("kind"), F.col(f"__{k}").alias("run"))) for k in kinds], F.struct(F.lit("sequence").alias("kind"), F.lit(0).cast("long").alias("run")))
    listed = begins.select(key, order, "__first", F.explode(F.array_compact(each)).alias("__r")).select(key, order, "__first", "__r.*")
    found = listed.groupBy(key, "kind", "run").agg(F.min(order).alias("start"), F.count("*").alias("length"), F.max("__first").alias("leads"))
    startup = found.where("kind = 'no_hand' and leads").withColumn("kind", F.lit("startup"))
    return found.unionByName(startup).select(key, "kind", "start", "length")


def motion_deltas(frames: DataFrame, points: str = "points", mask: str = "mask", hand: int = joints.HAND, least: int = joints.LEAST_JOINTS, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS26: one row: mean change of centre and of scale between neighbouring frames that both tell them, 0 if there are none."""
    w = over(key, order)
    seen = joints.with_candidates(frames.select(key, order, points, mask), points, mask, hand, least)
    d = [F.col(f"seen_{c}") - F.lag(f"seen_{c}").over(w) for c in "xyz"]
    steps = seen.select(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("center"), F.abs(F.col("seen_scale") - F.lag("seen_scale").over(w)).alias("scale"))
    return steps.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_delta_mean") for c in ("center", "scale")])


def chunk_intervals(segments: DataFrame, size: int, stride: int, tail: bool = True, least: int = 1, key: str = "seg_uid", start: str = "start", end: str = "end") -> DataFrame:
    """WS27: windows of `size` frames inside [start, end) at every stride, one more that ends with the interval if a rest is left,
    the whole interval if it is shorter but has `least` frames; chunks of equal uid occur once."""
    length = F.col(end) - F.col(start)
    last = F.col(end) - size
    steps = F.when(length >= size, F.sequence(F.col(start), last, F.lit(stride)))
    more = F.when((length >= size) & F.lit(tail) & ((length - size) % stride != 0), F.array(last))
    whole = F.when((length < size) & (length >= least), F.array(F.col(start)))
    at = F.explode(F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<int>")) for a in (steps, more, whole)])))
    made = segments.withColumn("chunk_start", at).withColumn("chunk_end", F.least(F.col("chunk_start") + size, F.col(end)))
    uid = F.concat_ws("_", F.col(key), F.col("chunk_start"), F.col("chunk_end"))
    return made.withColumn("chunk_uid", uid).dropDuplicates(["chunk_uid"])


def extract_tails(index: DataFrame, least: int, key: str = "vid") -> DataFrame:
    """WS30: frames before a clip's start and after its (inclusive) end as pieces of at least `least` frames."""
    pre = index.select(key, F.lit("pre").alias("role"), F.lit(0).alias("start"), F.col("start_idx").alias("end"))
    post = index.select(key, F.lit("post").alias("role"), (F.col("end_idx") + 1).alias("start"), F.col("t_total").alias("end"))
    return pre.unionByName(post).withColumn("length", F.col("end") - F.col("start")).where(F.col("length") >= least)


def occlusion_hold(frames: DataFrame, flag: Column, hold: int, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS32: occluded where the flag held within the last `hold` frames, this one included."""
    return frames.withColumn("held", F.max(flag.cast("int")).over(over(key, order).rowsBetween(-(hold - 1), 0)) == 1)


#: Overlap and depth gap that an occluded hand has at least, in world and in image coordinates; the share of them at which it stays so.
WORLD_OCCLUSION, IMAGE_OCCLUSION, EXIT_SHARE = (0.02, 0.015), (0.05, 0.012), 0.6
#: Frames that a hand stays occluded, and that a missing one does while the sides can't be told.
HOLD, CROSS_HOLD = 4, 6


def occlusion_states(frames: DataFrame, left_box: Sequence[Column], right_box: Sequence[Column], left_depth: Column, right_depth: Column, ambiguous: Column | None = None, left: Column | None = None, right: Column | None = None, world: bool = False, hold: int = HOLD, cross: int = CROSS_HOLD, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS32: left_occluded and right_occluded of each frame, with left_ttl and right_ttl, the frames that they still last.

    The hand behind enters where the boxes overlap and the depths differ by more than the thresholds, and stays while both
    are over EXIT_SHARE of them; then it is held for `hold` frames, this one included, counting down. left, right: whether
    the hands are there; one that was and is missing while the sides are ambiguous is held for min(hold, cross) frames, 2 at least.
    """
    least_overlap, least_gap = WORLD_OCCLUSION if world else IMAGE_OCCLUSION
    w = over(key, order)
    overlap = F.coalesce(arrays.iou(left_box, right_box), F.lit(0.0))
    gap = left_depth - right_depth
    short = max(2, min(hold, cross))
    n = F.row_number().over(w)
    out = frames.withColumn("__n", n)
    for side, behind, there in (("left", gap, left), ("right", -gap, right)):
        def over_share(share: float, behind: Column = behind) -> Column:
            return F.coalesce((overlap > least_overlap * share) & (behind > least_gap * share), F.lit(False))

        enters, stays = over_share(1.0), over_share(EXIT_SHARE)
        until = F.when(enters | stays, F.col("__n") + hold)
        if ambiguous is not None and there is not None:
            before = F.coalesce(F.max(there).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
            until = F.greatest(until, F.when(ambiguous & ~there & before, F.col("__n") + short))
        out = out.withColumn(f"__{side}", until)
    for side in ("left", "right"):
        ttl = F.greatest(F.coalesce(F.max(f"__{side}").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) - F.col("__n"), F.lit(0))
        out = out.withColumn(f"{side}_ttl", ttl.cast("int")).withColumn(f"{side}_occluded", F.col(f"{side}_ttl") > 0)
    return out.drop("__n", "__left", "__right")
