"""Evaluation of predictions: confusion, reports, calibration, sweeps, buckets, prototypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays
from . import joins, seq


def confusion(preds: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """AG20: counts of (true, pred) with their share within the true class."""
    counts = preds.groupBy(true, pred).agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy(true)))


def top_confusion(preds: DataFrame, k: int, true: str = "true", pred: str = "pred") -> DataFrame:
    """AG20: the confusion of the k best supported true classes (ties by class); all others read other."""
    keep = preds.groupBy(true).agg(F.count("*").alias("n")).orderBy(F.desc("n"), true).limit(k).select(F.col(true).cast("string").alias("c"))
    fold = lambda df, c: df.withColumn("c", F.col(c).cast("string")).join(keep.withColumn("ok", F.lit(True)), "c", "left").withColumn(c, F.when(F.col("ok"), F.col("c")).otherwise("other")).drop("c", "ok")
    return confusion(fold(fold(preds.select(true, pred), true), pred), true, pred)


def confusion_pairs(preds: DataFrame, k: int) -> DataFrame:
    """AG21: the k off-diagonal pairs of largest count, with rate and support; ties by class."""
    counts = confusion(preds)
    support = preds.groupBy("true").agg(F.count("*").alias("support"))
    return counts.where("`true` <> pred").join(support, "true").orderBy(F.desc("n"), F.desc("rate"), "true", "pred").limit(k)


def classification_report(preds: DataFrame) -> DataFrame:
    """AG22: per class precision, recall, F1 (0 for no row), support, predictions, mean confidence, and of wrong ones."""
    wrong = F.when(F.col("true") != F.col("pred"), F.col("conf"))
    by_true = preds.groupBy(F.col("true").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("true") == F.col("pred")).alias("tp"), F.avg("conf").alias("conf_mean"), F.avg(wrong).alias("wrong_conf_mean"))
    by_pred = preds.groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("predicted"))
    out = by_true.join(by_pred, "label", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    p, r = F.col("tp") / F.nullif("predicted", F.lit(0)), F.col("tp") / F.nullif("support", F.lit(0))
    out = out.withColumn("precision", F.coalesce(p, F.lit(0.0))).withColumn("recall", F.coalesce(r, F.lit(0.0)))
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def report_totals(report: DataFrame) -> DataFrame:
    """AG22: macro F1 over supported classes, and accuracy."""
    return report.agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"))


def calibration(preds: DataFrame, conf: str, correct: Column, bins: int = 15) -> DataFrame:
    """AG23: expected calibration error over equal bins, the last closed, and binary Brier score and log loss (clipped at 1e-9)."""
    hit = correct.cast("double")
    binned = preds.select(F.col(conf).alias("c"), hit.alias("y"), F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).alias("bin"))
    p = F.least(F.greatest(F.col("c"), F.lit(1e-9)), F.lit(1 - 1e-9))
    part = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("y").alias("y"), F.sum(F.pow(F.col("c") - F.col("y"), F.lit(2))).alias("b"), F.sum(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("l"))
    n = F.sum("n")
    return part.agg((F.sum(F.abs(F.col("c") - F.col("y"))) / n).alias("ece"), (F.sum("b") / n).alias("brier"), (F.sum("l") / n).alias("nll"))


def frame_metrics(frames: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """AG24: accuracy, and precision, recall and F1 of outside, begin and inside, 1e-9 in denominators."""
    e = 1e-9
    cols = [(F.count_if(F.col(y) == F.col(p)) / F.count("*")).alias("accuracy")]
    for i, name in enumerate("obi"):
        tp, np_, ny = F.count_if((F.col(y) == i) & (F.col(p) == i)), F.count_if(F.col(p) == i), F.count_if(F.col(y) == i)
        pr, re = tp / (np_ + e), tp / (ny + e)
        cols += [pr.alias(f"precision_{name}"), re.alias(f"recall_{name}"), (2 * pr * re / (pr + re + e)).alias(f"f1_{name}")]
    return frames.groupBy(*by).agg(*cols)


def structure_stats(frames: DataFrame, y: str, p: str) -> DataFrame:
    """AG25: mean segment length of true and predicted tags and their ratio, transition and violation rates of the predicted."""
    length = lambda t, n: seq.bio_segments(frames, t).agg(F.avg("length").alias(n))
    moves = seq.toggles(frames, p).agg(F.avg("rate").alias("transition_rate"))
    bad = seq.bio_violations(frames, p).agg(F.avg("rate").alias("violation_rate"))
    out = length(y, "true_length").crossJoin(length(p, "pred_length")).crossJoin(moves).crossJoin(bad)  # one row each
    return out.withColumn("length_ratio", F.col("pred_length") / F.nullif("true_length", F.lit(0.0)))


def clip_recall(clips: DataFrame, signer: str) -> DataFrame:
    """AG26: by signer and, as signer null, their mean: shares of clips with a hit, with a covered start, and without any prediction; clips: (signer, hit, start_covered, silent)."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    by = clips.groupBy(signer).agg(share("hit").alias("hit_rate"), share("start_covered").alias("start_cover"), share("silent").alias("silent_rate"))
    means = by.agg(*[F.avg(c).alias(c) for c in ("hit_rate", "start_cover", "silent_rate")])
    return by.unionByName(means.select(F.lit(None).cast(by.schema[signer].dataType).alias(signer), *means.columns))


def startup_failures(frames: DataFrame, visible: str, p: str, n: int, key: str = "sample_id") -> DataFrame:
    """AG27: per clip predicted begins and active frames before the first stable visible hand."""
    s = seq.startup_prefix(frames, visible, n)
    return s.groupBy(key).agg(F.count_if(F.col("startup") & (F.col(p) == 1)).alias("begins"), F.count_if(F.col("startup") & (F.col(p) != 0)).alias("active"))


#: What the scores of AG28 take off or add for each metric.
BALANCED = {"length_penalty": 0.10, "transition_err": 0.75, "relative_b_err": 0.05, "violation_err": 1.0, "startup_false_start": 1.5, "startup_active": 0.75}
RECALL_SAFE = {"start_cover": 0.50, "signer_macro": 0.25, "silent_rate": -0.90, "startup_segment": -0.60}


def rank_thresholds(metrics: DataFrame, threshold: str = "threshold") -> DataFrame:
    """AG28: adds balanced_score, recall_safe_score, guarded, and the ranks by three rules, 1 being the best, of a row of metrics per threshold.

    Columns: b_f1, pred_b_ratio, seg_ratio, true_length, b_err, transition_err, violation_err, startup_false_start,
    startup_active, hit_rate, start_cover, signer_macro, silent_rate, startup_segment. balanced_rank: score, b_f1, smaller
    b_err; recall_safe_rank: score, hit_rate, smaller silent_rate, smaller startup_segment; boundary_rank: b_f1, smaller
    b_err, pred_b_ratio nearest 1, smaller transition_err and violation_err. Ties go to the smaller threshold. guarded:
    pred_b_ratio in 0.85 to 1.15, seg_ratio in 0.80 to 1.25, startup_segment at most 0.05. Rows are few: one a threshold.
    """
    c = F.col
    terms = {
        "length_penalty": F.when(c("seg_ratio") > 0, F.abs(F.ln("seg_ratio"))).otherwise(1.5), "relative_b_err": c("b_err") / F.greatest(F.lit(1.0), c("true_length")),
    } | {n: c(n) for n in ("transition_err", "violation_err", "startup_false_start", "startup_active")}
    balanced = c("b_f1")
    for name, weight in BALANCED.items():
        balanced = balanced - weight * terms[name]
    safe = c("hit_rate")
    for name, weight in RECALL_SAFE.items():
        safe = safe + weight * c(name)
    guarded = c("pred_b_ratio").between(0.85, 1.15) & c("seg_ratio").between(0.80, 1.25) & (c("startup_segment") <= 0.05)
    out = metrics.withColumns({"balanced_score": balanced, "recall_safe_score": safe, "guarded": guarded})
    rules = {
        "balanced_rank": [F.desc("balanced_score"), F.desc("b_f1"), F.asc("b_err")],
        "recall_safe_rank": [F.desc("recall_safe_score"), F.desc("hit_rate"), F.asc("silent_rate"), F.asc("startup_segment")],
        "boundary_rank": [F.desc("b_f1"), F.asc("b_err"), F.abs(c("pred_b_ratio") - 1).asc(), F.asc("transition_err"), F.asc("violation_err")],
    }
    return out.withColumns({name: F.row_number().over(W.orderBy(*order, threshold)) for name, order in rules.items()})


def sweep_metrics(frames: DataFrame, y: str, thresholds: Sequence[float], visible: str, signer: str, stable: int = 1, tol: int = 2, active: str | None = None, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """AG28: the row of metrics for each threshold that rank_thresholds() ranks, from frames with pb, pi and po in one sort of each clip and threshold.

    A tag is begin where pb reaches the threshold, else outside if po is at least pi, else inside. Counted by clip and
    threshold: begins, frames inside segments and violations, transitions, the nearest distances of begins, greedy matches
    within tol, clips with a hit or a covered start, what is predicted before the first stable visible hand (`stable` frames);
    then summed. active: a probability that stands for activity there, from 0.5.
    """
    prefix = seq.startup_prefix(frames, visible, stable, key, order)
    spread = prefix.withColumn("thr", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).withColumn(order, F.col(order).cast("long"))
    clip = [key, "thr"]
    w = W.partitionBy(*clip).orderBy(order)
    so_far, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    rows = spread.withColumn("t", F.when(F.col("pb") >= F.col("thr"), 1).when(F.col("po") >= F.col("pi"), 0).otherwise(2))
    begun = lambda c: F.last(F.when(F.col(c) != 2, F.col(c)), ignorenulls=True).over(so_far)
    at = F.when(F.col("t") == 1, F.col(order))
    back, ahead = F.col(order) - F.last(at, ignorenulls=True).over(so_far), F.first(at, ignorenulls=True).over(after) - F.col(order)
    rows = rows.withColumns({
        "open_y": F.coalesce(begun(y), F.lit(0)) == 1, "open_t": F.coalesce(begun("t"), F.lit(0)) == 1, "moved_y": F.lag(y).over(w) != F.col(y), "moved_t": F.lag("t").over(w) != F.col("t"),
        "error": F.when(F.col(y) == 1, F.least(back, ahead)), "near": joins.begins_near(F.col(y) == 1, order, w, tol),
    })
    inside = lambda c, o: (F.col(c) == 1) | ((F.col(c) == 2) & F.col(o))
    bad = lambda c, o: F.count_if((F.col(c) == 2) & ~F.col(o))
    busy = F.col(active) >= 0.5 if active else F.col("t") != 0
    early = F.col("startup") & (F.col("t") == 1)
    begins = F.collect_list(F.when(F.col("t") == 1, F.struct(F.col(order).alias("at"), "near")))
    clips = rows.groupBy(*clip, signer).agg(
        F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("b_true"), F.count_if(F.col("t") == 1).alias("b_pred"), F.count_if(inside(y, "open_y")).alias("in_true"), F.count_if(inside("t", "open_t")).alias("in_pred"),
        bad(y, "open_y").alias("bad_true"), bad("t", "open_t").alias("bad_pred"), F.count_if("moved_y").alias("moves_true"), F.count_if("moved_t").alias("moves_pred"),
        joins.greedy_matches(begins, tol).alias("tp"), F.sum("error").alias("err"), F.count("error").alias("matched"), F.coalesce(F.min("error") <= tol, F.lit(False)).alias("covered"),
        F.coalesce(F.max(inside(y, "open_y") & inside("t", "open_t")), F.lit(False)).alias("hit"), F.count_if(early).alias("early"), F.count_if("startup").alias("blind"), F.count_if(F.col("startup") & busy).alias("blind_active"),
    )
    signed = F.col("b_true") > 0
    share = lambda c: F.count_if(signed & c) / F.greatest(F.count_if(signed), F.lit(1))
    rate = lambda c: F.avg(F.col(c) / F.greatest(F.col("n") - 1, F.lit(1)))
    by_signer = clips.where(signed).groupBy("thr", F.coalesce(F.col(signer).cast("string"), F.col(key).cast("string")).alias("who")).agg(F.avg(F.col("hit").cast("double")).alias("h"))
    macro = by_signer.groupBy("thr").agg(F.avg("h").alias("signer_macro"))
    total = clips.groupBy("thr").agg(
        *[F.sum(c).alias(c) for c in ("n", "b_true", "b_pred", "in_true", "in_pred", "bad_true", "bad_pred", "tp", "err", "matched", "early", "blind", "blind_active")],
        rate("moves_true").alias("rate_true"), rate("moves_pred").alias("rate_pred"), share(F.col("hit")).alias("hit_rate"), share(F.col("covered")).alias("start_cover"), share(F.col("b_pred") == 0).alias("silent_rate"),
        F.avg((F.col("early") > 0).cast("double")).alias("startup_segment"),
    )
    e = 1e-9
    prec, rec = F.col("tp") / (F.col("b_pred") + e), F.col("tp") / (F.col("b_true") + e)
    mean = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    true_length, length = mean("in_true", "b_true"), mean("in_pred", "b_pred")
    ratio = F.when(true_length > 0, length / F.nullif(true_length, F.lit(0.0))).when(length <= 0, 1.0).otherwise(float("inf"))
    return total.join(macro, "thr", "left").select(
        F.col("thr").alias("threshold"), (2 * prec * rec / (prec + rec + e)).alias("b_f1"), (F.col("b_pred") / (F.col("b_true") + e)).alias("pred_b_ratio"), ratio.alias("seg_ratio"), true_length.alias("true_length"),
        F.coalesce(mean("err", "matched"), F.lit(0.0)).alias("b_err"), F.abs(F.col("rate_pred") - F.col("rate_true")).alias("transition_err"), F.abs((F.col("bad_pred") - F.col("bad_true")) / F.col("n")).alias("violation_err"),
        mean("early", "b_pred").alias("startup_false_start"), mean("blind_active", "blind").alias("startup_active"), "hit_rate", "start_cover", F.coalesce("signer_macro", F.lit(0.0)).alias("signer_macro"), "silent_rate", "startup_segment",
    )


def threshold_sweep(frames: DataFrame, y: str, thresholds: Sequence[float], key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """AG28: a row per threshold: tags are begin where pb reaches it, else the likelier of outside and inside; F1 of begin, the
    ratio of begins, transition and violation rates, and rank 1 for the best row (F1, ratio nearest 1, fewer transitions, fewer
    violations, smaller threshold). The frames are expanded once by the short list of thresholds."""
    spread = frames.withColumn("thr", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    tag = F.when(F.col("pb") >= F.col("thr"), 1).when(F.col("pi") > F.col("po"), 2).otherwise(0)
    spread = spread.withColumn("t", tag).withColumn("clip", F.struct(key, "thr"))
    w = W.partitionBy("clip").orderBy(order)
    spread = spread.withColumn("was", F.lag("t").over(w)).withColumn("island", F.sum(F.when(F.col("t") != 2, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    spread = spread.withColumn("opened", F.max(F.when(F.col("t") == 1, 1).otherwise(0)).over(W.partitionBy("clip", "island")))
    out = spread.groupBy("thr").agg(
        F.count_if((F.col("t") == 1) & (F.col(y) == 1)).alias("tp"), F.count_if(F.col("t") == 1).alias("n_pred"), F.count_if(F.col(y) == 1).alias("n_true"),
        (F.count_if(F.col("was") != F.col("t")) / F.count("was")).alias("transition_rate"), (F.count_if((F.col("t") == 2) & (F.col("opened") == 0)) / F.count("*")).alias("violation_rate"),
    )
    out = out.withColumn("f1_b", F.round(2 * F.col("tp") / F.greatest(F.col("n_pred") + F.col("n_true"), F.lit(1)), 9)).withColumn("b_ratio", F.round(F.col("n_pred") / F.greatest("n_true", F.lit(1)), 9))
    rank = F.row_number().over(W.orderBy(F.desc("f1_b"), F.abs(F.col("b_ratio") - 1), F.round("transition_rate", 9), F.round("violation_rate", 9), "thr"))  # a row per threshold
    return out.withColumn("rank", rank).drop("tp", "n_pred", "n_true")


def support_buckets(classes: DataFrame, order: Column, names: Sequence[str] = ("head", "mid", "tail"), label: str = "label") -> DataFrame:
    """AG29: classes ranked: the first ceil(20 %) are the first bucket, up to ceil(50 %) the second, the rest the third."""
    w = W.orderBy(order, label)  # classes are a dimension
    n = F.count("*").over(W.partitionBy())
    rank = F.row_number().over(w)
    bucket = F.when(rank <= F.ceil(n * 0.2), names[0]).when(rank <= F.ceil(n * 0.5), names[1]).otherwise(names[2])
    return classes.withColumn("bucket", bucket)


def difficulty_ema(history: DataFrame, alpha: float, label: str = "label") -> DataFrame:
    """AG30: exponential mean of each class's F1 over epochs with support, as a fold over the sorted epochs."""
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col("support") > 0, F.struct("epoch", "f1")))), lambda r: r["f1"])
    rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    return history.groupBy(label).agg(rows.alias("v")).select(label, F.aggregate(rest, F.get("v", F.lit(0)), lambda s, y: s * alpha + y * (1 - alpha)).alias("difficulty"))


def bucket_aggregates(report: DataFrame) -> DataFrame:
    """AG31: means of each bucket's classes, classes with F1 0, and quantiles of F1."""
    return report.groupBy("bucket").agg(F.count("*").alias("classes"), F.avg("f1").alias("f1"), F.avg("recall").alias("recall"), F.count_if(F.col("f1") == 0).alias("zero_f1"), F.percentile("f1", F.lit(0.1)).alias("f1_p10"), F.median("f1").alias("f1_median"))


def class_prototypes(features: DataFrame, label: str = "label", feature: str = "embedding") -> DataFrame:
    """AG32: element-wise mean vector and support of each class; sums are taken in parts, no vectors are gathered."""
    cells = features.select(label, F.posexplode(F.col(feature)).alias("at", "v")).groupBy(label, "at").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count("*").alias("n"))
    return cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("prototype"), F.max("n").alias("support"))


def class_families(protos: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """UD6: classes grouped into at most n families by bisecting k-means on cosine."""
    rows = protos.withColumn("features", array_to_vector("prototype"))
    model = BisectingKMeans(k=n, seed=seed, distanceMeasure="cosine", predictionCol="family").fit(rows)
    return model.transform(rows).select("label", "family")


def partition_metrics(sim: DataFrame, families: DataFrame, weight: float = 1.0) -> DataFrame:
    """AG33: mean similarity within and between families, share of families of one class, and their score."""
    fa, fb = families.select(F.col("label").alias("a"), F.col("family").alias("fam_a")), families.select(F.col("label").alias("b"), F.col("family").alias("fam_b"))
    pairs = sim.where("a < b").join(fa, "a").join(fb, "b")
    means = pairs.agg(F.avg(F.when(F.col("fam_a") == F.col("fam_b"), F.col("sim"))).alias("intra"), F.avg(F.when(F.col("fam_a") != F.col("fam_b"), F.col("sim"))).alias("inter"))
    sizes = families.groupBy("family").agg(F.count("*").alias("n")).agg(F.count("*").alias("families"), (F.count_if(F.col("n") == 1) / F.count("*")).alias("singleton_ratio"))
    return means.crossJoin(sizes).withColumn("score", F.coalesce("intra", F.lit(0.0)) - F.coalesce("inter", F.lit(0.0)) - weight * F.col("singleton_ratio"))  # one row each


def pick_num_families(candidates: DataFrame) -> DataFrame:
    """AG34: the smallest count whose score is within 2 % (1e-4 at least) of the best."""
    best = candidates.agg(F.max("score").alias("best"))
    near = candidates.crossJoin(best).where(F.col("score") >= F.col("best") - F.greatest(F.abs("best") * 0.02, F.lit(1e-4)))  # one row
    return near.agg(F.min("families").alias("families"))


def best_epoch(history: DataFrame, metric: str) -> DataFrame:
    """AG44: the row of the largest metric, ties to the earlier epoch."""
    return history.agg(F.max_by(F.struct(*history.columns), F.struct(F.col(metric), -F.col("epoch"))).alias("r")).select("r.*")


def clip_diagnostics(frames: DataFrame, y: str, p: str, k: int = 50, key: str = "sample_id", order: str = "frame_idx") -> DataFrame:
    """AG45: the k clips of least macro F1, with mean boundary error (infinite when nothing is predicted), violations, tag strings."""
    m = frame_metrics(frames, y, p, [key])
    f1 = (F.col("f1_o") + F.col("f1_b") + F.col("f1_i")) / 3
    err = joins_error(frames, y, p, key, order)
    bad = seq.bio_violations(frames, p, key, order)
    tags = frames.groupBy(key).agg(arrays.bio_string(F.transform(F.array_sort(F.collect_list(F.struct(order, p))), lambda r: r[p])).alias("tags"))
    out = m.select(key, F.round(f1, 9).alias("macro_f1")).join(err, key, "left").join(bad, key).join(tags, key)
    return out.orderBy("macro_f1", F.desc("boundary_error"), key).limit(k)


def joins_error(frames: DataFrame, y: str, p: str, key: str, order: str) -> DataFrame:
    from .joins import nearest_boundary_error

    e = nearest_boundary_error(frames, y, p, key, order)
    return e.groupBy(key).agg(F.avg(F.coalesce(F.col("error").cast("double"), F.lit(float("inf")))).alias("boundary_error"))
