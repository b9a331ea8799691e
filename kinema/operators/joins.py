"""Joins of clips, segments, predictions and runs. Range joins always carry the clip's key, so they stay inside a clip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import seq


def join_labels(videos: DataFrame, ann: DataFrame, key: str = "sample_id") -> DataFrame:
    """JN1: clips with their annotations."""
    return videos.join(ann.withColumnRenamed("attachment_id", key), key)


def skip_ids(tasks: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN2: tasks whose id isn't listed."""
    return tasks.join(ids.select(key), key, "left_anti")


def only_ids(tasks: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN2: tasks whose id is listed."""
    return tasks.join(ids.select(key), key, "left_semi")


def skip_committed(tasks: DataFrame, videos: DataFrame, frames: DataFrame, arrays: DataFrame, key: str = "sample_id") -> DataFrame:
    """JN3: tasks without those whose clip has a row, arrays, and as many frames as it says."""
    n = frames.groupBy(key).agg(F.count("*").alias("found"))
    done = videos.join(n, key).where("found = frames").join(arrays.select(key), key, "left_semi")
    return tasks.join(done.select(key), key, "left_anti")


def resolve_by_name_then_stem(refs: DataFrame, files: DataFrame) -> DataFrame:
    """JN4: each ref's first path by lower-cased file name, else by stem; how says name, stem or missing, ambiguous that there were several."""
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    by = lambda c, to: files.groupBy(c.alias("k")).agg(F.min("path").alias(to), F.count("*").alias(f"{to}_n"))
    want = F.lower("ref")
    out = refs.withColumn("k", want).join(by(name, "by_name"), "k", "left").drop("k")
    out = out.withColumn("k", F.regexp_replace(want, r"\.[^.]*$", "")).join(by(stem, "by_stem"), "k", "left").drop("k")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_stem").isNotNull(), "stem").otherwise("missing")
    return out.select("ref", F.coalesce("by_name", "by_stem").alias("path"), how.alias("how"), (F.coalesce("by_name_n", "by_stem_n", F.lit(0)) > 1).alias("ambiguous"))


def segments_with_predictions(segments: DataFrame, preds: DataFrame, key: str = "segment_id") -> DataFrame:
    """JN5: all segments with their prediction, defaults where there is none."""
    return segments.join(preds, key, "left").na.fill({"label": "", "conf": 0.0}).withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def frames_in_segments(frames: DataFrame, segments: DataFrame, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """JN6: every frame with the last segment (by seg) whose [start, end) holds it, null if none does."""
    s = segments.select(F.col(key).alias("__k"), "seg", "start", "end")
    hit = frames.join(s, (F.col(key) == F.col("__k")) & (F.col(order) >= F.col("start")) & (F.col(order) < F.col("end")), "left")
    return hit.groupBy(key, order).agg(F.max("seg").alias("seg"))


def clip_with_context(frames: DataFrame, segments: DataFrame, c: str, pre: int, post: int, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """JN7: the values of each segment's frames with pre frames before and post after it, in order, and the bounds found."""
    s = segments.select(F.col(key).alias("__k"), "seg", "start", "end")
    hit = frames.join(s, (F.col(key) == F.col("__k")) & (F.col(order) >= F.col("start") - pre) & (F.col(order) < F.col("end") + post))
    clip = F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda r: r[c])
    return hit.groupBy(key, "seg").agg(F.min(order).alias("clip_start"), F.max(order).alias("clip_end"), clip.alias("clip"))


def nearest_key(df: DataFrame, c: str, target: float) -> DataFrame:
    """JN9: the row whose key is nearest to the target, ties to the smaller."""
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(F.abs(F.col(c) - target), F.col(c))).alias("r")).select("r.*")


def nearest_boundary_error(frames: DataFrame, true: str, pred: str, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """JN10: for each true begin the distance to the nearest predicted one of its clip, null when there is none; by window, without a join."""
    w = seq.over(key, order)
    p = F.when(F.col(pred) == 1, F.col(order))
    back = F.col(order) - F.last(p, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(p, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)) - F.col(order)
    return frames.withColumn("error", F.least(back, ahead)).where(F.col(true) == 1).select(key, order, "error")


def begins_near(true: Column, order: str, w: W, tol: int) -> Column:
    """The places of true begins within tol of a row, at most 2 tol + 1; w: the window of the clip in order."""
    return F.collect_list(F.when(true, F.col(order))).over(w.rangeBetween(-tol, tol))


def greedy_matches(begins: Column, tol: int) -> Column:
    """How many of (at, near) structs, in order of at, find a place in near that none before them has taken: the nearest, the earlier of two.

    A fold that remembers only the taken places that a later one can still reach.
    """
    kind = "struct<n:bigint,taken:array<bigint>>"

    def step(s: Column, e: Column) -> Column:
        free = F.filter(e["near"], lambda t: ~F.array_contains(s["taken"], t))
        pick = F.array_min(F.transform(free, lambda t: F.struct(F.abs(t - e["at"]).alias("far"), t.alias("t"))))["t"]
        taken = F.filter(F.concat(s["taken"], F.array_compact(F.array(pick))), lambda t: t >= e["at"] - tol)
        return F.struct((s["n"] + F.when(pick.isNotNull(), 1).otherwise(0)).alias("n"), taken.alias("taken")).cast(kind)

    none = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("taken"))
    return F.aggregate(F.array_sort(begins), none, step, lambda s: s["n"])


def match_boundaries(frames: DataFrame, true: str, pred: str, tol: int, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """JN11: per clip tp, fp, fn of predicted begins that in order each take the nearest unused true one within tol (ties: the earlier)."""
    w = seq.over(key, order)
    begins = frames.where((F.col(true) == 1) | (F.col(pred) == 1)).withColumn(order, F.col(order).cast("long"))
    near = begins.withColumn("near", begins_near(F.col(true) == 1, order, w, tol))
    hits = F.collect_list(F.when(F.col(pred) == 1, F.struct(F.col(order).alias("at"), "near")))
    out = near.groupBy(key).agg(greedy_matches(hits, tol).alias("tp"), F.count_if(F.col(pred) == 1).alias("p"), F.count_if(F.col(true) == 1).alias("t"))
    return out.select(key, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))


def segment_overlap(true: DataFrame, pred: DataFrame, tol: int, key: str = "sample_id") -> DataFrame:
    """JN12: per clip whether any true and predicted segments (ends inclusive) overlap, and whether any starts lie within tol."""
    p = pred.select(F.col(key), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    both = true.select(key, "start", "end").join(p, key, "left")
    hit = (F.greatest("start", "p_start") <= F.least("end", "p_end")) & F.col("p_start").isNotNull()
    near = F.abs(F.col("start") - F.col("p_start")) <= tol
    return both.groupBy(key).agg(F.coalesce(F.max(hit), F.lit(False)).alias("hit"), F.coalesce(F.max(near), F.lit(False)).alias("start_covered"))


def pairwise_similarity(protos: DataFrame, confusion: DataFrame, weight: float = 0.7) -> DataFrame:
    """JN13: weighted prototype cosine and symmetric confusion rate of all ordered class pairs, the diagonal 1.

    protos: (label, feature unit vectors), one row a class; confusion: (a, b, rate). Classes are a dimension, so all
    pairs are its square: the one cross product here.
    """
    a, b = protos.select(F.col("label").alias("a"), F.col("feature").alias("fa")), protos.select(F.col("label").alias("b"), F.col("feature").alias("fb"))
    cos = F.aggregate(F.zip_with("fa", "fb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    back = confusion.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("rate").alias("back"))
    pairs = a.crossJoin(b).join(confusion, ["a", "b"], "left").join(back, ["a", "b"], "left")
    sym = (F.coalesce("rate", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))) / 2
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(weight * (F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)) + 1) / 2 + (1 - weight) * sym).alias("sim"))


def compare_runs(a: DataFrame, b: DataFrame, metrics: Sequence[str], key: str = "sample_id") -> DataFrame:
    """JN14: per metric over ids of both runs: pairs, means, mean difference, relative improvement."""
    side = lambda df, n: df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(n)) for m in metrics])).alias("x")).select(key, "x.*")
    both = side(a, "va").join(side(b, "vb"), [key, "metric"]).where("va is not null and vb is not null")
    out = both.groupBy("metric").agg(F.count("*").alias("n"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.avg(F.col("vb") - F.col("va")).alias("delta"))
    return out.withColumn("relative", F.col("delta") / F.nullif(F.abs("mean_a"), F.lit(0.0)))


def parity_check(a: DataFrame, b: DataFrame, exact: Sequence[str], close: Sequence[str], tol: float, key: str = "sample_id") -> DataFrame:
    """JN15: (key, finding): ids that one side lacks, and fields that differ exactly or by over tol, relative or absolute."""
    x, y = a.select(key, F.lit(True).alias("in_a"), *[F.col(c).alias(f"a_{c}") for c in (*exact, *close)]), b.select(key, F.lit(True).alias("in_b"), *[F.col(c).alias(f"b_{c}") for c in (*exact, *close)])
    far = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > tol * F.greatest(F.lit(1.0), F.abs(f"a_{c}"), F.abs(f"b_{c}"))
    here = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    found = F.array(
        F.when(F.col("in_a").isNull(), "missing in a"), F.when(F.col("in_b").isNull(), "missing in b"),
        *[F.when(here & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in exact], *[F.when(here & far(c), c) for c in close],
    )
    return x.join(y, key, "full_outer").select(key, F.explode(F.filter(found, lambda f: f.isNotNull())).alias("finding"))


def variant_diff(raw: DataFrame, pp: DataFrame, x: str, valid: str, tol: float, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """JN16: frames whose value changed by over tol or whose validity flipped; filled ones became valid."""
    y = pp.select(key, order, F.col(x).alias("px"), F.col(valid).alias("pv"))
    both = raw.join(y, [key, order])
    changed = (F.col(valid) != F.col("pv")) | (F.col("pv") & (F.abs(F.col(x) - F.col("px")) > tol))
    return both.where(changed).select(key, order, (~F.col(valid) & F.col("pv")).alias("filled"))


def family_lookup(df: DataFrame, families: DataFrame, label: str = "label") -> DataFrame:
    """JN17: rows with their class's family; a class that has none or several is an error."""
    one = families.groupBy(label).agg(F.count("*").alias("n"), F.first("family").alias("family"))
    family = F.when(F.col("n") == 1, F.col("family")).otherwise(F.raise_error(F.concat(F.lit("class without one family: "), F.col(label).cast("string"))).cast("int"))
    return df.join(one, label, "left").withColumn("family", family).drop("n")


def late_drops(history: DataFrame, current: int, limit: int, label: str = "label", epoch: str = "epoch", f1: str = "f1") -> DataFrame:
    """JN18: the classes whose F1 at the current epoch fell most below their best."""
    peak = history.groupBy(label).agg(F.max(f1).alias("peak"))
    now = history.where(F.col(epoch) == current).select(label, f1)
    return now.join(peak, label).withColumn("drop", F.col(f1) - F.col("peak")).orderBy("drop", label).limit(limit)


def low_score_samples(report: DataFrame, ann: DataFrame, most: float, label: str = "label") -> DataFrame:
    """JN19: sorted distinct sample ids by split of the classes with F1 of at most `most`."""
    return ann.join(report.where(F.col("f1") <= most).select(label), label, "left_semi").groupBy("split").agg(F.sort_array(F.collect_set("sample_id")).alias("ids"))


def clean_manifest(quality: DataFrame, manifest: DataFrame, buckets: Sequence[str], least: float, k: int, per: str) -> DataFrame:
    """JN20: the k best rows of each group that are in the manifest, in the buckets, and of at least that score; ties by id."""
    good = quality.join(manifest, "sample_id").where(F.col("bucket").isin(*buckets) & (F.col("score") >= least))
    rank = F.row_number().over(W.partitionBy(per).orderBy(F.desc("score"), "sample_id"))
    return good.withColumn("rank", rank).where(F.col("rank") <= k)
