"""Aggregations over clips, runs and annotations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import seq


def _share(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def run_aggregate(videos: DataFrame, hands: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """AG1: frame-weighted quality, swaps by frame, missing and outliers by hands x frames, weighted mean delta."""
    n = F.sum("frames")
    return videos.groupBy(*by).agg(
        F.count("*").alias("samples"), n.alias("frames"), _share(F.sum(F.col("quality") * F.col("frames")), F.sum(F.when(F.col("quality").isNotNull(), F.col("frames")))).alias("quality"),
        _share(F.sum("swaps"), n).alias("swap_rate"), _share(F.sum("missing"), hands * n).alias("missing_rate"), _share(F.sum("outliers"), hands * n).alias("outlier_rate"),
        _share(F.sum(F.col("delta") * F.col("frames")), F.sum(F.when(F.col("delta").isNotNull(), F.col("frames")))).alias("delta"),
    )


def extended_aggregate(videos: DataFrame) -> DataFrame:
    """AG2: AG1 with rates of each hand, both as shares of all frames."""
    n = F.sum("frames")
    more = videos.agg(_share(F.sum("hand1"), n).alias("hand1_rate"), _share(F.sum("hand2"), n).alias("hand2_rate"), F.max("delta").alias("delta_max"))
    return run_aggregate(videos).crossJoin(more)  # one row each


def mean_numeric(df: DataFrame) -> DataFrame:
    """AG3: mean of every numeric column over its finite values; booleans and texts are left out."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    cols = [c for c, t in df.dtypes if t.startswith(kinds)]
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
    return df.agg(*[F.avg(finite(c)).alias(c) for c in cols])


def composite_score(df: DataFrame, weights: Mapping[str, float], fallbacks: Mapping[str, Column] | None = None) -> DataFrame:
    """AG4: weighted sum with the breakdown and the missing metrics; a missing one is its fallback, else 1 for a negative weight and 0 for others."""
    value = {m: F.coalesce(F.col(m) if m in df.columns else F.lit(None).cast("double"), (fallbacks or {}).get(m, F.lit(None).cast("double")), F.lit(1.0 if w < 0 else 0.0)) for m, w in weights.items()}
    gone = F.array(*[F.when(F.col(m).isNull() if m in df.columns else F.lit(True), m) for m in weights])
    total = sum((value[m] * w for m, w in weights.items()), F.lit(0.0))
    return df.withColumn("score", total).withColumn("breakdown", F.struct(*[(value[m] * w).alias(m) for m, w in weights.items()])).withColumn("missing_metrics", F.filter(gone, lambda x: x.isNotNull()))


def sample_summary(frames: DataFrame, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """AG5: coverages, score mean and median, median positive time step, frame rate, quality of each clip."""
    dt = F.col("ts_ms") - F.lag("ts_ms").over(seq.over(key, order))
    share = lambda c: F.avg(c.cast("double"))
    made = frames.withColumn("dt", dt).groupBy(key).agg(
        F.count("*").alias("frames"), share(F.col("h1")).alias("left_cov"), share(F.col("h2")).alias("right_cov"), share(F.col("h1") & F.col("h2")).alias("both_cov"),
        F.avg("score").alias("score_mean"), F.median("score").alias("score_median"), F.median(F.when(F.col("dt") > 0, F.col("dt"))).alias("dt_median"),
    )
    quality = 0.4 * F.col("both_cov") + 0.3 * (F.col("left_cov") + F.col("right_cov")) / 2 + 0.3 * F.col("score_median")
    return made.withColumn("fps_est", 1000 / F.col("dt_median")).withColumn("quality", quality)


def diagnostic_counts(frames: DataFrame, key: str = "sample_id") -> DataFrame:
    """AG6: counts of conditions and their safe rates."""
    n = F.greatest(F.count("*"), F.lit(1))
    return frames.groupBy(key).agg(
        F.count_if("occ").alias("occluded"), F.count_if(~F.col("h1") & ~F.col("h2")).alias("lost"), F.count_if(F.col("h1") & ~F.col("h2")).alias("one_sided"),
        (F.count_if("occ") / n).alias("occluded_rate"), (F.count_if(F.col("occ") & F.col("h1")) / F.greatest(F.count_if("occ"), F.lit(1))).alias("occlusion_saved"),
    )


def conditional_percentiles(frames: DataFrame, x: str, flag: str, key: str = "sample_id") -> DataFrame:
    """AG7: median and p90 of x over all frames, those with the flag, and those without."""
    parts = {"all": F.lit(True), "on": F.col(flag), "off": ~F.col(flag)}
    return frames.groupBy(key).agg(*[F.percentile(F.when(c, F.col(x)), F.lit(p)).alias(f"{name}_p{round(100 * p)}") for name, c in parts.items() for p in (0.5, 0.9)])


def describe_metrics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG8: a row per metric: count, mean, population deviation, percentiles 10 to 90, linear."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])).alias("m")).select("m.*").where("v is not null and not isnan(v)")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), *[F.percentile("v", F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)])


def recommend_settings(videos: DataFrame) -> DataFrame:
    """AG9: thresholds from medians of the clips' metrics."""
    m = videos.agg(F.median("quality").alias("q"), F.median(F.col("missing") / F.col("frames")).alias("miss"), F.median("frames").alias("n"))
    return m.select(
        F.when(F.col("q") >= 0.5, 0.5).when(F.col("q") >= 0.3, 0.3).otherwise(0.2).alias("score_threshold"), F.when(F.col("miss") > 0.3, 8).otherwise(4).alias("max_gap"),
        F.least(F.greatest(F.floor(F.col("n") / 4), F.lit(8)), F.lit(64)).alias("window"),
    )


def length_stats(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """AG10: count, least, quartiles, largest, mean."""
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.min(c).alias("min"), *[F.percentile(c, F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)], F.max(c).alias("max"), F.avg(c).alias("mean"))


def nearest_rank(df: DataFrame, c: str, p: float, by: Sequence[str]) -> DataFrame:
    """AG10, UD4: the value at place round((n - 1) p), halves to even, of each group's sorted values."""
    w = W.partitionBy(*by)
    ranked = df.where(F.col(c).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(c)) - 1).withColumn("at", F.bround((F.count("*").over(w) - 1) * p))
    return ranked.where("i = at").select(*by, c)


def histogram(df: DataFrame, c: str, edges: Sequence[float]) -> DataFrame:
    """AG11: counts in the bins [edge, next edge), the last one open, empty bins 0."""
    spark = df.sparkSession
    bins = spark.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    place = sum((F.when(F.col(c) >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    counts = df.where(F.col(c) >= edges[0]).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").na.fill(0, ["n"])


def class_distribution(ann: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """AG12: rows of each class in train, val and in all, and its share of the largest class."""
    made = ann.groupBy(label).agg(F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "val").alias("val"), F.count("*").alias("total"))
    shots = F.when(F.col("total") >= 100, "many").when(F.col("total") >= 20, "medium").otherwise("few")
    return made.withColumn("shots", shots).withColumn("imbalance", F.max("total").over(W.partitionBy()) / F.col("total"))


def length_coverage(frames: DataFrame, score: str, least: float = 0.45, key: str = "sample_id") -> DataFrame:
    """AG13: distribution over clips of the number of frames and the share of frames with a confident hand."""
    per = frames.groupBy(key).agg(F.count("*").alias("n"), F.avg((F.col(score) >= least).cast("double")).alias("cov"))
    return per.agg(F.count("*").alias("samples"), F.avg("n").alias("frames_mean"), F.median("cov").alias("cov_median"), F.percentile("cov", F.lit(0.1)).alias("cov_p10"))


def seglen_report(ann: DataFrame) -> DataFrame:
    """AG14: length quantiles of all splits together (split null) and of each, and a suggested cap."""
    made = ann.rollup("split").agg(F.count("*").alias("n"), *[F.percentile("length", F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.95)])
    return made.withColumn("cap", F.when(F.col("p95") <= 32, 32).when(F.col("p95") <= 48, 48).otherwise(64))


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """AG15: distinct pairs and how often they occur."""
    return df.groupBy(a, b).agg(F.count("*").alias("n")).orderBy(F.desc("n"), a, b)


def split_summary(ann: DataFrame) -> DataFrame:
    """AG16: rows, signers and labels of each split and of all (split null)."""
    return ann.groupBy("split", "signer", "label").agg(F.count("*").alias("c")).rollup("split").agg(F.sum("c").alias("n_rows"), F.count_distinct("signer").alias("signers"), F.count_distinct("label").alias("labels"))


def signer_overlap(ann: DataFrame) -> DataFrame:
    """AG16: number of signers that occur in more than one split, as measured."""
    return ann.groupBy("signer").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("overlap"))


def reject_audit(judged: DataFrame, reason: str = "reason") -> DataFrame:
    """AG17: rows of each reason; accepted rows have reason accepted."""
    return judged.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def label_summary(index: DataFrame, flag: str, length: str) -> DataFrame:
    """AG18: clips, background clips and their share, length statistics of the others."""
    other = F.when(~F.col(flag), F.col(length))
    return index.agg(F.count("*").alias("clips"), F.count_if(flag).alias("background"), F.avg(F.col(flag).cast("double")).alias("background_rate"), F.median(other).alias("length_median"), F.max(other).alias("length_max"))


def ecdf(df: DataFrame, c: str) -> DataFrame:
    """AG19: distinct values with the share of rows at most that large, and of larger ones.

    Values are counted first, so what is put in order is one row per value; ranges of it are summed apart and joined by
    their totals, and no window runs over all rows.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).repartitionByRange(c).withColumn("part", F.spark_partition_id())
    totals = counts.groupBy("part").agg(F.sum("n").alias("in_part"))
    before = totals.withColumn("before", F.coalesce(F.sum("in_part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("in_part").over(W.partitionBy()))
    run = counts.withColumn("run", F.sum("n").over(W.partitionBy("part").orderBy(c))).join(F.broadcast(before), "part")  # a row per range
    share = (F.col("before") + F.col("run")) / F.col("all")
    return run.select(c, share.alias("ecdf"), (1 - share).alias("ccdf"))


def pool_summary(index: DataFrame, by: Sequence[str]) -> DataFrame:
    """AG43: rows of each combination, with subtotals."""
    return index.rollup(*by).agg(F.count("*").alias("n"))


def segment_quality(frames: DataFrame, motion: str, key: str = "sample_id", order: str = "frame_idx", points: Column | None = None, least_points: int = 5) -> DataFrame:
    """AG39: presence rate, longest miss, mean and deviation of motion, and a score against the p90 of all clips' motion; bucket EMPTY, WEAK or OK.

    A hand is present with at least least_points points, by default where h1 says so; with points, mean_points as well.
    """
    present = F.col("h1") if points is None else F.coalesce(points >= least_points, F.lit(False))
    more = [] if points is None else [F.avg(points).alias("mean_points")]
    base = frames.groupBy(key).agg(F.avg(present.cast("double")).alias("presence"), F.avg(motion).alias("motion_mean"), F.stddev_pop(motion).alias("motion_std"), *more)
    miss = seq.longest_run(frames, ~present, key, order)
    top = base.agg(F.percentile("motion_mean", F.lit(0.9)).alias("p90"))
    out = base.join(miss, key).crossJoin(F.broadcast(top))  # one row
    score = 0.7 * F.col("presence") + 0.3 * F.least(F.col("motion_mean") / F.nullif("p90", F.lit(0)), F.lit(1.0))
    return out.withColumn("score", score).withColumn("bucket", F.when(F.col("presence") == 0, "EMPTY").when(F.col("score") < 0.8, "WEAK").otherwise("OK")).drop("p90")


def bucket_counts(quality: DataFrame, splits: DataFrame, key: str = "sample_id") -> DataFrame:
    """AG39: clips of every split by bucket; splits: (key, split), null where a clip has none."""
    return quality.join(splits, key, "left").groupBy("split", "bucket").agg(F.count("*").alias("n"))


def review_warnings(frames: DataFrame, segments: DataFrame, predictions: DataFrame, left: Column, right: Column, pose: Column | None = None, key: str = "sample_id") -> DataFrame:
    """AG40: each clip's warnings (id, value): a hand on under a quarter of its frames, low mean pose reliability, no segments, all predictions rejected.

    predictions: (key, accepted). The value is the share, the mean, or the number of rejected predictions.
    """
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    low_pose = F.lit(None).cast("double") if pose is None else F.avg(pose)
    base = frames.groupBy(key).agg(share(left).alias("left"), share(right).alias("right"), low_pose.alias("pose"))
    n = segments.groupBy(key).agg(F.count("*").alias("n"))
    told = predictions.groupBy(key).agg(F.count("*").alias("told"), F.count_if("accepted").alias("accepted"))
    some = F.coalesce("n", F.lit(0)) > 0
    kinds = [
        (F.col("pose") < 0.35, "pose_reliability_low", F.col("pose")), (F.col("left") < 0.25, "left_hand_sparse", F.col("left")), (F.col("right") < 0.25, "right_hand_sparse", F.col("right")),
        (~some, "no_segments", F.lit(None)), (some & (F.col("told") > 0) & (F.col("accepted") == 0), "all_predictions_rejected", F.col("told")),
    ]
    w = F.array(*[F.when(is_so, F.struct(F.lit(name).alias("id"), value.cast("double").alias("value"))) for is_so, name, value in kinds])
    return base.join(n, key, "left").join(told, key, "left").select(key, F.filter(w, lambda x: x.isNotNull()).alias("warnings"))


def timeline_tracks(frames: DataFrame, c: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """AG41: each clip's values in frame order."""
    return frames.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda r: r[c]).alias("track"))


def artifact_validation(videos: DataFrame, frames: DataFrame, arrays: DataFrame | None = None, schema: tuple[str, str] | None = None, key: str = "sample_id") -> DataFrame:
    """AG38: findings (key, finding): duplicate ids, frame counts that differ, ids that one side lacks.

    With arrays (rows with the key), ids missing there or there alone; with schema, a (name, version) that the videos'
    schema_name and schema_version columns must have.
    """
    wrong = F.lit(False) if schema is None else ~(F.col("schema_name").eqNullSafe(F.lit(schema[0])) & F.col("schema_version").eqNullSafe(F.lit(schema[1])))
    v = videos.groupBy(key).agg(F.count("*").alias("copies"), F.max("frames").alias("said"), F.bool_or(wrong).alias("wrong_schema"))
    f = frames.groupBy(key).agg(F.count("*").alias("found"))
    both = v.join(f, key, "full_outer")
    kinds = [
        F.when(F.col("copies") > 1, "duplicate_id"), F.when(F.col("wrong_schema"), "schema"), F.when(F.col("said").isNull(), "no_video"), F.when(F.col("found").isNull(), "no_frames"),
        F.when(F.col("said") != F.col("found"), "frame_count"),
    ]
    if arrays is not None:
        both = both.join(arrays.select(key).distinct().withColumn("in_arrays", F.lit(True)), key, "full_outer")
        kinds += [F.when(F.col("in_arrays").isNull() & F.col("copies").isNotNull(), "not_in_arrays"), F.when(F.col("copies").isNull() & F.col("in_arrays"), "only_in_arrays")]
    return both.select(key, F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("finding"))


def sample_weights(index: DataFrame, label: str, quality: Column, coverage: Column, power: float = 1.0, floor: float = 0.1) -> DataFrame:
    """AG35: 1 / class size x max(quality, floor) ^ power x (0.5 + 0.5 max(coverage, floor)). The class sizes come by a join, not a window."""
    sizes = index.groupBy(label).agg(F.count("*").alias("size"))
    w = F.pow(F.greatest(quality, F.lit(floor)), F.lit(power)) * (0.5 + 0.5 * F.greatest(coverage, F.lit(floor))) / F.col("size")
    return index.join(sizes, label).withColumn("weight", w).drop("size")


def quality_gate(stats: DataFrame, targets: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """AG37: of one row of metrics, the failures (metric below or above its target) and whether it passed."""
    fails = [F.when(F.col(m) < lo, f"{m} below {lo}") for m, (lo, _) in targets.items() if lo is not None]
    fails += [F.when(F.col(m) > hi, f"{m} above {hi}") for m, (_, hi) in targets.items() if hi is not None]
    return stats.select(F.filter(F.array(*fails), lambda x: x.isNotNull()).alias("failures")).withColumn("passed", F.size("failures") == 0)
