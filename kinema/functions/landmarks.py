"""Landmark documents and clip-level landmark features: hands from any layout, canonical frames, normalising, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double,z:double>"


def points_to_struct(points: Column, n: int = 21) -> Column:
    """AR2: a variant list of {x, y, z}, {X, Y, Z} or [x, y(, z)] as n points; z is 0 if absent, bad points and the rest are null."""
    items = F.try_variant_get(points, "$", "array<variant>")

    def axis(p: Column, name: str, i: int) -> Column:
        return F.coalesce(*[F.try_variant_get(p, path, "double") for path in (f"$.{name}", f"$.{name.upper()}", f"$[{i}]")])

    def point(p: Column) -> Column:
        x, y = axis(p, "x", 0), axis(p, "y", 1)
        return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"), F.coalesce(axis(p, "z", 2), F.lit(0.0)).alias("z")))

    made = F.transform(items, point)
    return F.slice(F.concat(made, F.array_repeat(F.lit(None).cast(POINT), n)), 1, n)


def hands_from_variant(frame: Column) -> tuple[Column, Column]:
    """AR1: variant point lists of the left and right hand from the layouts 'hand 1'/'hand 2', left_hand/right_hand, hands.left/right,
    and hands as a list with handedness; null where a hand is absent."""
    listed = F.try_variant_get(frame, "$.hands", "array<variant>")

    def side(name: str, key: str) -> Column:
        of = F.filter(listed, lambda h: F.lower(F.coalesce(F.try_variant_get(h, "$.handedness", "string"), F.try_variant_get(h, "$.label", "string"))) == name)
        hand = F.get(of, F.lit(0))
        paths = (f"$['{key}']", f"$.{name}_hand", f"$.hands.{name}")
        found = [F.try_variant_get(frame, p, "variant") for p in paths]
        inner = [F.try_variant_get(hand, p, "variant") for p in ("$.landmarks", "$.hand_landmarks", "$.points")]
        full = F.coalesce(*found, *inner)
        return F.when(F.try_variant_get(full, "$", "array<variant>").isNotNull(), full)

    return side("left", "hand 1"), side("right", "hand 2")


def canonical_frames(frames: DataFrame, fps: float | None = None, key: str = "sample_id", order: str = "frame_idx", ts: str = "ts") -> DataFrame:
    """AR5: ts_ms, index x step where absent (step 1000 / fps or 33.3333), and frame_dt_ms, the clip's median positive step."""
    step = 1000 / fps if fps else 33.3333
    out = frames.withColumn("ts_ms", F.coalesce(F.col(ts).cast("double"), F.col(order) * step))
    dt = F.col("ts_ms") - F.lag("ts_ms").over(W.partitionBy(key).orderBy(order))
    out = out.withColumn("dt", dt)
    return out.withColumn("frame_dt_ms", F.coalesce(F.median(F.when(F.col("dt") > 0, F.col("dt"))).over(W.partitionBy(key)), F.lit(step))).drop("dt")


def center_normalize(frames: DataFrame, x: str, valid: str, method: str = "p95", key: str = "sample_id") -> DataFrame:
    """AR17: x minus the clip's mean of valid values, divided by its span: the floor(0.95 n)-th smallest distance, 1.4826 x the
    median distance (mad), or the largest (max); 1 if that is 0."""
    part = W.partitionBy(key)
    out = frames.withColumn("c", F.when(F.col(valid), F.col(x) - F.avg(F.when(F.col(valid), F.col(x))).over(part)))
    far = F.abs("c")
    if method == "mad":
        span = F.median(far).over(part) * 1.4826
    elif method == "max":
        span = F.max(far).over(part)
    else:
        n = F.count("c").over(part)
        out = out.withColumn("r", F.when(F.col("c").isNotNull(), F.row_number().over(part.orderBy(far.asc_nulls_last())))).withColumn("n", n)
        span = F.min(F.when(F.col("r") == F.greatest(F.floor(F.col("n") * 0.95), F.lit(1)), F.abs("c"))).over(part)
    return out.withColumn("norm", F.col("c") / F.when(F.coalesce(span, F.lit(0.0)) > 0, span).otherwise(1.0)).drop("c", "r", "n")


def mirror_if_one_sided(frames: DataFrame, left: str, right: str, low: float = 0.10, high: float = 0.60, key: str = "sample_id") -> DataFrame:
    """AR18: swap the two columns throughout a clip whose left one is there in under `low` of the frames and the right one in at least `high`."""
    part = W.partitionBy(key)
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double")).over(part)
    out = frames.withColumn("mirrored", (share(left) < low) & (share(right) >= high))
    a, b = F.when(F.col("mirrored"), F.col(right)).otherwise(F.col(left)), F.when(F.col("mirrored"), F.col(left)).otherwise(F.col(right))
    return out.withColumns({left: a, right: b})


def motion_features(frames: DataFrame, x: str, valid: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """WS3: velocity and acceleration, 0 unless the last 2 (3) frames are valid, and the share of valid frames so far."""
    w = W.partitionBy(key).orderBy(order)
    ok = lambda k: F.coalesce(F.lag(valid, k).over(w), F.lit(False))
    v = F.when(F.col(valid) & ok(1), F.col(x) - F.lag(x).over(w)).otherwise(0.0)
    a = F.when(F.col(valid) & ok(1) & ok(2), F.col(x) - 2 * F.lag(x).over(w) + F.lag(x, 2).over(w)).otherwise(0.0)
    return frames.withColumns({"velocity": v, "acceleration": a, "valid_share": F.avg(F.col(valid).cast("double")).over(w.rowsBetween(W.unboundedPreceding, 0))})


def kinematic_signature(frames: DataFrame, x: str, valid: str, bins: int = 8, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """AG42: mean, deviation and peak of speed, coverage, and mean speed in `bins` parts of a clip, the first ones longer by one."""
    m = motion_features(frames, x, valid, key, order)
    n = F.count("*").over(W.partitionBy(key))
    size, more = F.floor(n / bins), n % bins
    at = F.col(order)
    bin_ = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    m = m.withColumn("speed", F.abs("velocity")).withColumn("bin", bin_)
    return m.groupBy(key).agg(
        F.avg("speed").alias("speed_mean"), F.stddev_pop("speed").alias("speed_std"), F.max("speed").alias("speed_peak"), F.avg(F.col(valid).cast("double")).alias("coverage"),
        F.array(*[F.coalesce(F.avg(F.when(F.col("bin") == i, F.col("speed"))), F.lit(0.0)) for i in range(bins)]).alias("energy"),
    )


def generated_stats(samples: DataFrame) -> DataFrame:
    """AG36: of generated samples (sample_id, parts: array<struct<role, source, length>>): parts, frames and mean length of each role and source."""
    return samples.select("sample_id", F.explode("parts").alias("p")).groupBy("p.role", "p.source").agg(F.count("*").alias("parts"), F.sum("p.length").alias("frames"), F.avg("p.length").alias("length_mean"))
