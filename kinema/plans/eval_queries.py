"""Evaluation of predictions and tags, prototypes, and array functions over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import evaluate, joins, seq, sets
from .agg_queries import NUDGE, rounded, sql_round
from .registry import query
from .views import table, v_bio, v_frames, v_pred

CONFUSION = """with c as (select "true", pred, count(*) as n from v_pred group by all), r as (select *, n / sum(n) over (partition by "true") as rate, cast(sum(n) over (partition by "true") as bigint) as support from c) """


@query("ag20_confusion", CONFUSION + 'select "true", pred, n, round(rate, 9) as rate from r')
def ag20(spark, sf):
    return rounded(evaluate.confusion(v_pred(spark, sf)), "rate", n=9)


@query("ag20_top_confusion", """
    with k as (select "true" as c from v_pred group by 1 order by count(*) desc, 1 limit 4), f as (select case when "true" in (select c from k) then cast("true" as varchar) else 'other' end as t, case when pred in (select c from k) then cast(pred as varchar) else 'other' end as p from v_pred),
    c as (select t, p, count(*) as n from f group by all) select t as "true", p as pred, n, round(n / sum(n) over (partition by t), 9) as rate from c""")  # fmt: skip
def ag20_top(spark, sf):
    return rounded(evaluate.top_confusion(v_pred(spark, sf), 4), "rate", n=9)


@query("ag21_confusion_pairs", CONFUSION + 'select "true", pred, n, round(rate, 9) as rate, support from r where "true" <> pred order by n desc, rate desc, "true", pred limit 15')
def ag21(spark, sf):
    return rounded(evaluate.confusion_pairs(v_pred(spark, sf), 15), "rate", n=9)


REPORT = """
    with t as (select "true" as label, count(*) as support, count(*) filter (where "true" = pred) as tp, avg(conf) as conf_mean, avg(case when "true" <> pred then conf end) as wrong_conf_mean from v_pred group by 1), q as (select pred as label, count(*) as predicted from v_pred group by 1),
    j as (select coalesce(t.label, q.label) as label, coalesce(support, 0) as support, coalesce(tp, 0) as tp, conf_mean, wrong_conf_mean, coalesce(predicted, 0) as predicted from t full join q on t.label = q.label),
    m as (select *, coalesce(tp / nullif(predicted, 0), 0) as "precision", coalesce(tp / nullif(support, 0), 0) as recall from j), rep as (select *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) as f1 from m)
"""


@query("ag22_classification_report", REPORT + 'select label, support, tp, round(conf_mean, 9) as conf_mean, round(wrong_conf_mean, 9) as wrong_conf_mean, predicted, round("precision", 9) as "precision", round(recall, 9) as recall, round(f1, 9) as f1 from rep')
def ag22(spark, sf):
    return rounded(evaluate.classification_report(v_pred(spark, sf)), "conf_mean", "wrong_conf_mean", "precision", "recall", "f1", n=9)


@query("ag22_report_totals", REPORT + "select round(avg(f1), 9) as macro_f1, round(sum(tp) / sum(support), 9) as accuracy from rep")
def ag22_totals(spark, sf):
    return rounded(evaluate.report_totals(evaluate.classification_report(v_pred(spark, sf))), "macro_f1", "accuracy", n=9)


@query("ag23_calibration", """
    with r as (select conf as c, case when "true" = pred then 1.0 else 0.0 end as y, least(floor(conf * 15), 14) as bin, least(greatest(conf, 1e-9), 1 - 1e-9) as p from v_pred),
    b as (select bin, count(*) as n, sum(c) as c, sum(y) as y, sum((c - y) * (c - y)) as b, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) as l from r group by bin) select round(sum(abs(c - y)) / sum(n), 6) as ece, round(sum(b) / sum(n), 6) as brier, round(sum(l) / sum(n), 6) as nll from b""")  # fmt: skip
def ag23(spark, sf):
    return rounded(evaluate.calibration(v_pred(spark, sf), "conf", F.col("true") == F.col("pred")), "ece", "brier", "nll")


def frame_sql(by=""):
    cols = ["round(count(*) filter (where y = p) / count(*), 9) as accuracy"]
    for i, n in enumerate("obi"):
        pr, re = f"count(*) filter (where y = {i} and p = {i}) / (count(*) filter (where p = {i}) + 1e-9)", f"count(*) filter (where y = {i} and p = {i}) / (count(*) filter (where y = {i}) + 1e-9)"
        cols += [f"round({pr}, 9) as precision_{n}", f"round({re}, 9) as recall_{n}", f"round(2 * ({pr}) * ({re}) / (({pr}) + ({re}) + 1e-9), 9) as f1_{n}"]
    return f"select {by}{', '.join(cols)} from v_bio"


@query("ag24_frame_metrics", frame_sql("sample_id, ") + " group by sample_id")
def ag24(spark, sf):
    d = evaluate.frame_metrics(v_bio(spark, sf), "y", "p", ["sample_id"])
    return rounded(d, *d.columns[1:], n=9)


STRUCTURE = """
    with o as (select *, sum(case when y <> 2 then 1 else 0 end) over w as iy, sum(case when p <> 2 then 1 else 0 end) over w as ip, lag(p) over (partition by sample_id order by frame_idx) as was from v_bio window w as (partition by sample_id order by frame_idx rows unbounded preceding)),
    t as (select max(case when y <> 0 then frame_idx end) - min(case when y = 1 then frame_idx end) + 1 as n from o group by sample_id, iy having count(*) filter (where y = 1) > 0), q as (select sample_id, count(*) filter (where p = 1) as b, count(*) filter (where p = 2) as inside, max(case when p <> 0 then frame_idx end) - min(case when p = 1 then frame_idx end) + 1 as n from o group by sample_id, ip),
    m as (select sample_id, count(*) filter (where was <> p) / greatest(count(*) - 1, 1) as tr, count(*) as n from o group by sample_id), v as (select sample_id, sum(case when b = 0 then inside else 0 end) as bad from q group by sample_id)
"""


@query("ag25_structure_stats", STRUCTURE + "select round((select avg(n) from t), 6) as true_length, round((select avg(n) from q where b > 0), 6) as pred_length, round((select avg(tr) from m), 6) as transition_rate, round((select avg(bad / n) from m join v using (sample_id)), 6) as violation_rate, round((select avg(n) from q where b > 0) / (select avg(n) from t), 6) as length_ratio")
def ag25(spark, sf):
    d = evaluate.structure_stats(v_bio(spark, sf), "y", "p")
    return rounded(d, *d.columns)


@query("ag26_clip_recall", """
    with o as (select *, sum(case when y <> 2 then 1 else 0 end) over w as iy, sum(case when p <> 2 then 1 else 0 end) over w as ip from v_bio window w as (partition by sample_id order by frame_idx rows unbounded preceding)),
    t as (select sample_id, min(case when y = 1 then frame_idx end) as s, max(case when y <> 0 then frame_idx end) as e from o group by sample_id, iy having s is not null), q as (select sample_id, min(case when p = 1 then frame_idx end) as s, max(case when p <> 0 then frame_idx end) as e from o group by sample_id, ip having s is not null),
    c as (select t.sample_id, coalesce(bool_or(greatest(t.s, q.s) <= least(t.e, q.e)), false) as hit, coalesce(bool_or(abs(t.s - q.s) <= 1), false) as cov from t left join q using (sample_id) group by t.sample_id),
    z as (select sample_id, max(p) = 0 as silent from v_bio group by sample_id), r as (select sample_id % 10 as signer, avg(case when hit then 1.0 else 0 end) as hit_rate, avg(case when cov then 1.0 else 0 end) as start_cover, avg(case when silent then 1.0 else 0 end) as silent_rate from c join z using (sample_id) group by 1)
    select signer, round(hit_rate, 9) as hit_rate, round(start_cover, 9) as start_cover, round(silent_rate, 9) as silent_rate from r union all select null, round(avg(hit_rate), 9), round(avg(start_cover), 9), round(avg(silent_rate), 9) from r""")  # fmt: skip
def ag26(spark, sf):
    from .join_queries import preds_of, segs

    silent = v_bio(spark, sf).groupBy("sample_id").agg((F.max("p") == 0).alias("silent"))
    c = joins.segment_overlap(segs(spark, sf), preds_of(spark, sf), 1).join(silent, "sample_id").withColumn("signer", F.col("sample_id") % 10)
    return rounded(evaluate.clip_recall(c, "signer"), "hit_rate", "start_cover", "silent_rate", n=9)


@query("ag27_startup_failures", """
    with b as (select *, min(case when h2 then 1 else 0 end) over w as least, count(*) over w as n from v_bio window w as (partition by sample_id order by frame_idx rows between 2 preceding and current row)), s as (select *, min(case when least = 1 and n = 3 then frame_idx - 2 end) over (partition by sample_id) as f from b)
    select sample_id, count(*) filter (where (f is null or frame_idx < f) and p = 1) as begins, count(*) filter (where (f is null or frame_idx < f) and p <> 0) as active from s group by sample_id""")  # fmt: skip
def ag27(spark, sf):
    return evaluate.startup_failures(v_bio(spark, sf), "h2", "p", 3)


@query("ag28_threshold_sweep", """
    with x as (select b.*, thr, case when pb >= thr then 1 when pi > po then 2 else 0 end as t from v_bio b, (select unnest([0.3, 0.5, 0.7]) as thr) h), o as (select *, lag(t) over (partition by sample_id, thr order by frame_idx) as was, sum(case when t <> 2 then 1 else 0 end) over (partition by sample_id, thr order by frame_idx rows unbounded preceding) as island from x),
    p as (select *, max(case when t = 1 then 1 else 0 end) over (partition by sample_id, thr, island) as opened from o),
    a as (select cast(thr as double) as thr, count(*) filter (where t = 1 and y = 1) as tp, count(*) filter (where t = 1) as n, count(*) filter (where y = 1) as m, count(*) filter (where was <> t) / count(was) as tr, count(*) filter (where t = 2 and opened = 0) / count(*) as vr from p group by 1)
    select thr, round(tr, 6) as transition_rate, round(vr, 6) as violation_rate, round(2 * tp / greatest(n + m, 1), 9) as f1_b, round(n / greatest(m, 1), 9) as b_ratio, cast(row_number() over (order by round(2 * tp / greatest(n + m, 1), 9) desc, abs(round(n / greatest(m, 1), 9) - 1), round(tr, 9), round(vr, 9), thr) as integer) as rank from a""")  # fmt: skip
def ag28(spark, sf):
    return rounded(evaluate.threshold_sweep(v_bio(spark, sf), "y", [0.3, 0.5, 0.7]), "transition_rate", "violation_rate")


METRICS = {
    "b_f1": "avg(score)", "pred_b_ratio": "5e-1 + avg(x) / 100", "seg_ratio": "avg(x) / 60", "true_length": "avg(x) / 20", "b_err": "stddev_pop(x) / 40", "transition_err": "avg(score * score) / 9", "violation_err": "avg(case when h2 then 0 else 1e-1 end)",
    "startup_false_start": "avg(case when h1 then 0 else 1e-1 end)", "startup_active": "avg(case when occ then 1e-1 else 0 end)", "hit_rate": "avg(case when h1 then 1e0 else 0 end)", "start_cover": "avg(case when h2 then 1e0 else 0 end)",
    "signer_macro": "avg(case when occ then 1e0 else 0 end)", "silent_rate": "avg(case when x < 5 then 1e0 else 0 end)", "startup_segment": "avg(case when x < 3 then 1e0 else 0 end)",
}


@query("ag28_rank_thresholds", f"""
    with m as (select (event_id % 9 + 1) / 10 as threshold, {", ".join(f"{v} as {k}" for k, v in METRICS.items())} from v_frames group by 1),
    s as (select *, b_f1 - 0.10 * case when seg_ratio > 0 then abs(ln(seg_ratio)) else 1.5 end - 0.75 * transition_err - 0.05 * b_err / greatest(1, true_length) - violation_err - 1.5 * startup_false_start - 0.75 * startup_active as balanced_score,
                 hit_rate + 0.5 * start_cover + 0.25 * signer_macro - 0.9 * silent_rate - 0.6 * startup_segment as recall_safe_score, pred_b_ratio between 0.85 and 1.15 and seg_ratio between 0.80 and 1.25 and startup_segment <= 0.05 as guarded from m)
    select threshold, round(balanced_score, 6) as balanced_score, round(recall_safe_score, 6) as recall_safe_score, guarded, cast(row_number() over (order by balanced_score desc, b_f1 desc, b_err, threshold) as integer) as balanced_rank,
           cast(row_number() over (order by recall_safe_score desc, hit_rate desc, silent_rate, startup_segment, threshold) as integer) as recall_safe_rank, cast(row_number() over (order by b_f1 desc, b_err, abs(pred_b_ratio - 1), transition_err, violation_err, threshold) as integer) as boundary_rank from s""")  # fmt: skip
def ag28_rank(spark, sf):
    m = v_frames(spark, sf).groupBy(((F.col("event_id") % 9 + 1) / 10).alias("threshold")).agg(*[F.expr(v).cast("double").alias(k) for k, v in METRICS.items()])
    out = evaluate.rank_thresholds(m).select("threshold", "balanced_score", "recall_safe_score", "guarded", "balanced_rank", "recall_safe_rank", "boundary_rank")
    return rounded(out, "balanced_score", "recall_safe_score")


@query("ag29_support_buckets", """
    with c as (select l_suppkey as label, count(*) as n from lineitem group by 1), r as (select *, row_number() over (order by n desc, label) as rank, count(*) over () as k from c)
    select label, n, case when rank <= ceil(k * 0.2) then 'head' when rank <= ceil(k * 0.5) then 'mid' else 'tail' end as bucket from r""")  # fmt: skip
def ag29(spark, sf):
    return evaluate.support_buckets(table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("label")).agg(F.count("*").alias("n")), F.desc("n"))


@query("ag30_difficulty_ema", """
    with recursive h as (select "true" as label, epoch, count(*) as n, avg(conf) as f1 from v_pred where epoch <> 3 or "true" % 2 = 0 group by all), r as (select *, row_number() over (partition by label order by epoch) as i from h),
    e as (select label, i, f1 as d from r where i = 1 union all select r.label, r.i, e.d * 0.9 + r.f1 * 0.1 from e join r on r.label = e.label and r.i = e.i + 1) select label, round(max_by(d, i), 9) as difficulty from e group by label""")  # fmt: skip
def ag30(spark, sf):
    h = v_pred(spark, sf).where("epoch <> 3 or `true` % 2 = 0").groupBy(F.col("true").alias("label"), "epoch").agg(F.count("*").alias("support"), F.avg("conf").alias("f1"))
    return rounded(evaluate.difficulty_ema(h, 0.9), "difficulty", n=9)


@query("ag31_bucket_aggregates", REPORT + """ , k as (select *, row_number() over (order by support desc, label) as rank, count(*) over () as c from rep), b as (select *, case when rank <= ceil(c * 0.2) then 'head' when rank <= ceil(c * 0.5) then 'mid' else 'tail' end as bucket from k)
    select bucket, count(*) as classes, round(avg(f1), 9) as f1, round(avg(recall), 9) as recall, count(*) filter (where f1 = 0) as zero_f1, round(quantile_cont(f1, 0.1), 9) as f1_p10, round(median(f1), 9) as f1_median from b group by bucket""")  # fmt: skip
def ag31(spark, sf):
    r = evaluate.support_buckets(evaluate.classification_report(v_pred(spark, sf)), F.desc("support"))
    return rounded(evaluate.bucket_aggregates(r), "f1", "recall", "f1_p10", "f1_median", n=9)


PROTO = """with c as (select label, i as pos, avg(cast(embedding[i] as double)) as v from embeddings, (select unnest(generate_series(1, 64)) as i) group by all), pr as (select label, list(v order by pos) as proto from c group by label) """


def protos(spark, sf):
    return evaluate.class_prototypes(table(spark, sf, "embeddings"))


@query("ag32_class_prototypes", PROTO + ", n as (select label, count(*) as support from embeddings group by 1) select label, [round(x, 6) for x in proto] as prototype, support from pr join n using (label)")
def ag32(spark, sf):
    p = protos(spark, sf)
    return p.select("label", F.transform("prototype", lambda x: F.round(x, 6)).alias("prototype"), "support")


SIM = PROTO + """, cc as (select "true" as a, pred as b, count(*) as n from v_pred group by all), conf as (select a, b, n / sum(n) over (partition by a) as rate from cc),
    sim as (select p.label as a, q.label as b, case when p.label = q.label then 1.0 else 0.7 * (list_cosine_similarity(p.proto, q.proto) + 1) / 2 + 0.3 * (coalesce(c.rate, 0) + coalesce(d.rate, 0)) / 2 end as sim from pr p, pr q left join conf c on c.a = p.label and c.b = q.label left join conf d on d.a = q.label and d.b = p.label) """


def sims(spark, sf):
    unit = protos(spark, sf).select("label", arrays.l2_normalize(F.col("prototype")).alias("feature"))
    c = evaluate.confusion(v_pred(spark, sf)).select(F.col("true").alias("a"), F.col("pred").alias("b"), "rate")
    return joins.pairwise_similarity(unit, c)


@query("jn13_pairwise_similarity", SIM + "select a, b, round(sim, 6) as sim from sim")
def jn13(spark, sf):
    return rounded(sims(spark, sf), "sim")


@query("tk2_nearest_neighbours", SIM + ", r as (select *, row_number() over (partition by a order by round(sim, 9) desc, b) as rank from sim where a <> b) select a, b, round(sim, 6) as sim, cast(rank as integer) as rank from r where rank <= 3")
def tk2(spark, sf):
    return rounded(sets.nearest_neighbours(sims(spark, sf).withColumn("sim", F.round("sim", 9)), 3), "sim")


@query("ag33_partition_metrics", SIM + """, m as (select avg(case when a // 4 = b // 4 then sim end) as intra, avg(case when a // 4 <> b // 4 then sim end) as inter from sim where a < b), f as (select label // 4 as family, count(*) as n from pr group by 1), s as (select count(*) as families, count(*) filter (where n = 1) / count(*) as singleton_ratio from f)
    select round(intra, 6) as intra, round(inter, 6) as inter, families, singleton_ratio, round(intra - inter - singleton_ratio, 6) as score from m, s""")  # fmt: skip
def ag33(spark, sf):
    fam = protos(spark, sf).select("label", F.expr("label div 4").alias("family"))
    return rounded(evaluate.partition_metrics(sims(spark, sf), fam), "intra", "inter", "score")


@query("ag34_pick_num_families", "with c as (select l_linenumber as families, avg(l_quantity) as score from lineitem group by 1) select min(families) as families from c where score >= (select max(score) - greatest(abs(max(score)) * 0.02, 1e-4) from c)")
def ag34(spark, sf):
    return evaluate.pick_num_families(table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("families")).agg(F.avg("l_quantity").alias("score")))


@query("ud6_class_families")
def ud6(spark, sf):
    return evaluate.class_families(protos(spark, sf), 3)


@query("ag44_best_epoch", "with h as (select l_linenumber as epoch, round(avg(l_discount), 6) as f1 from lineitem group by 1) select epoch, f1 from h order by f1 desc, epoch limit 1")
def ag44(spark, sf):
    return evaluate.best_epoch(table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.round(F.avg("l_discount"), 6).alias("f1")), "f1")


@query("ag45_clip_diagnostics", "with m as (" + frame_sql("sample_id, ") + """ group by sample_id), e as (select t.sample_id, t.frame_idx, coalesce(min(abs(t.frame_idx - q.frame_idx))::double, 'inf'::double) as error from v_bio t left join v_bio q on q.sample_id = t.sample_id and q.p = 1 where t.y = 1 group by all), g as (select sample_id, avg(error) as be from e group by 1),
    o as (select *, sum(case when p <> 2 then 1 else 0 end) over (partition by sample_id order by frame_idx rows unbounded preceding) as ip from v_bio), q as (select sample_id, count(*) filter (where p = 1) as b, count(*) filter (where p = 2) as inside, count(*) as n from o group by sample_id, ip), v as (select sample_id, cast(sum(case when b = 0 then inside else 0 end) as bigint) as violations, sum(n) as n from q group by 1),
    s as (select sample_id, string_agg(substr('OBI', p + 1, 1), '' order by frame_idx) as tags from v_bio group by 1)
    select sample_id, round((f1_o + f1_b + f1_i) / 3, 6) as macro_f1, round(be, 6) as boundary_error, violations, round(violations / v.n, 6) as rate, tags from m left join g using (sample_id) join v using (sample_id) join s using (sample_id) order by round((f1_o + f1_b + f1_i) / 3, 9), be desc, sample_id limit 50""")  # fmt: skip
def ag45(spark, sf):
    return rounded(evaluate.clip_diagnostics(v_bio(spark, sf), "y", "p"), "macro_f1", "boundary_error", "rate")


@query("ar_boxes", """
    with b as (select event_id, x / 500 as a0, score / 2 as a1, x / 500 + 0.3 as a2, score / 2 + 0.4 as a3, score / 3 as b0, x / 600 as b1, score / 3 + 0.5 as b2, x / 600 + 0.2 as b3 from v_frames), i as (select *, greatest(least(a2, b2) - greatest(a0, b0), 0) * greatest(least(a3, b3) - greatest(a1, b1), 0) as inter from b)
    select event_id, round(inter / ((a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - inter), 6) as iou from i""")  # fmt: skip
def ar_boxes(spark, sf):
    x, s = F.col("x"), F.col("score")
    return v_frames(spark, sf).select("event_id", F.round(arrays.iou((x / 500, s / 2, x / 500 + 0.3, s / 2 + 0.4), (s / 3, x / 600, s / 3 + 0.5, x / 600 + 0.2)), 6).alias("iou"))


@query("ar_probabilities", """
    select event_id, sample_id, round(-(pb * ln(greatest(pb, 1e-9)) + pi * ln(greatest(pi, 1e-9)) + po * ln(greatest(po, 1e-9))), 6) as entropy, round(greatest(pb, pi, po), 6) as top1 from v_bio""")  # fmt: skip
def ar_probabilities(spark, sf):
    p = F.array("pb", "pi", "po")
    return v_bio(spark, sf).select("event_id", "sample_id", F.round(arrays.entropy(p), 6).alias("entropy"), F.round(arrays.top_k(p, 1)[0]["p"], 6).alias("top1"))


@query("ar22_margins", "select event_id, round(list_sort([pb, pi, po], 'DESC')[1] - list_sort([pb, pi, po], 'DESC')[2], 6) as margin, round([pb, pi, po][y + 1], 6) as true_p, round(pb * pb + pi * pi + po * po, 6) as squares from v_bio")
def ar22(spark, sf):
    p = F.array("pb", "pi", "po")
    return rounded(v_bio(spark, sf).select("event_id", arrays.margin(p).alias("margin"), arrays.true_probability(p, F.col("y")).alias("true_p"), arrays.sum_of_squares(p).alias("squares")), "margin", "true_p", "squares")


#: A hand of four joints for each frame: its wrist, scale and shape follow x and score.
HAND = "[{'x': x / 600, 'y': score, 'z': 0.0}, {'x': x / 600 + 0.05, 'y': score, 'z': 0.1}, {'x': x / 600, 'y': score + score / 9, 'z': 0.2}, {'x': x / 600 + score / 7, 'y': score + 0.1, 'z': x / 1000}]"


def hand():
    x, s = F.col("x"), F.col("score")
    points = [(x / 600, s, F.lit(0.0)), (x / 600 + 0.05, s, F.lit(0.1)), (x / 600, s + s / 9, F.lit(0.2)), (x / 600 + s / 7, s + 0.1, x / 1000)]
    return F.array(*[F.struct(a.alias("x"), b.alias("y"), c.alias("z")) for a, b, c in points])


def scale_sql(h: str) -> str:
    d = [f"sqrt(({h}[{i}].x - {h}[1].x) ** 2 + ({h}[{i}].y - {h}[1].y) ** 2)" for i in (2, 3, 4)]
    return f"list_sort([{', '.join(d)}])[2]"


def bone_sql(h: str, i: int, j: int, scale: str) -> str:
    return f"(sqrt(({h}[{i}].x - {h}[{j}].x) ** 2 + ({h}[{i}].y - {h}[{j}].y) ** 2) / {scale})"


@query("ar12_far_hands", """
    select event_id, abs(x - 60) > 1.5 * greatest(score * 30, 12.0) or x > 150 as rejected, coalesce(x <= (case when h2 then score * 100 end) * 0.8, true) as like_last, coalesce(case when h1 then x end, score) as world_depth, coalesce(score, case when h2 then 1.0 end, case when h1 then x end) as image_depth from v_frames""")  # fmt: skip
def ar12(spark, sf):
    x, s = F.col("x"), F.col("score")
    h1, h2 = F.when(F.col("h1"), x), F.when(F.col("h2"), F.lit(1.0))
    return v_frames(spark, sf).select(
        "event_id", arrays.far_from_pose(F.abs(x - 60), s * 30, 12.0, x <= 150).alias("rejected"), arrays.like_last_good(x, F.when(F.col("h2"), s * 100), 0.8).alias("like_last"),
        arrays.wrist_depth(h1, s, h2, True).alias("world_depth"), arrays.wrist_depth(h1, s, h2, False).alias("image_depth"),
    )


@query("ar15_sanity_check", f"""
    with f as (select event_id, sample_id, frame_idx, {HAND} as h from v_frames), b as (select event_id, h, lag(h) over w as before, first_value(h) over w as anchor from f window w as (partition by sample_id order by frame_idx)),
    s as (select *, {scale_sql("h")} as sc, {scale_sql("anchor")} as an from b),
    m as (select *, sc / an as ratio, sqrt((h[1].x - before[1].x) ** 2 + (h[1].y - before[1].y) ** 2) as jump, greatest({", ".join(f"abs({bone_sql('h', i, j, 'sc')} - {bone_sql('anchor', i, j, 'an')}) / greatest({bone_sql('anchor', i, j, 'an')}, 1e-6)" for i, j in ((1, 2), (1, 3), (3, 4)))}) as bone from s)
    select event_id, list_filter([case when ratio < 0.70 or ratio > 1.35 then 'scale' end, case when jump > 2 * an then 'jump' end, case when bone > 0.30 then 'bone' end], lambda r: r is not null) as reasons, round(ratio, 6) as scale_ratio, round(jump, 6) as wrist_jump, round(bone, 6) as bone_error from m""")  # fmt: skip
def ar15_check(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("sample_id").orderBy("frame_idx")
    f = v_frames(spark, sf).withColumn("h", hand())
    b = f.select("event_id", "h", F.lag("h").over(w).alias("before"), F.first("h").over(w).alias("anchor"))
    return rounded(b.select("event_id", arrays.sanity_check(F.col("h"), F.col("anchor"), F.col("before"), [(0, 1), (0, 2), (2, 3)]).alias("c")).select("event_id", "c.*"), "scale_ratio", "wrist_jump", "bone_error")


@query("ws20_fill_hand_gaps", f"""
    with f as (select sample_id, frame_idx, h2, {HAND} as h from v_frames),
    a as (select *, last_value(case when h2 then frame_idx end ignore nulls) over b as p, last_value(case when h2 then h end ignore nulls) over b as ph, first_value(case when h2 then frame_idx end ignore nulls) over n as q, first_value(case when h2 then h end ignore nulls) over n as qh
          from f window b as (partition by sample_id order by frame_idx rows between unbounded preceding and current row), n as (partition by sample_id order by frame_idx rows between current row and unbounded following)),
    t as (select *, (frame_idx - p) / (q - p) as t, greatest({scale_sql("ph")}, 1e-6) as ps, greatest({scale_sql("qh")}, 1e-6) as qs from a),
    m as (select *, ps * (1 - t) + qs * t as s from t)
    select sample_id, frame_idx, k - 1 as joint, case when h2 then 'observed' when q - p - 1 <= 3 then 'interp' else 'missing' end as source,
           {", ".join(f"round(case when h2 then h[k].{c} when q - p - 1 <= 3 then {lo}ph[1].{c} * (1 - t) + qh[1].{c} * t + s * ((ph[k].{c} - ph[1].{c}) / ps * (1 - t) + (qh[k].{c} - qh[1].{c}) / qs * t){hi} end + {NUDGE}, 6) as {c}" for c, lo, hi in (("x", "greatest(least(", ", 1.0), 0.0)"), ("y", "greatest(least(", ", 1.0), 0.0)"), ("z", "", "")))}
    from m, (select cast(unnest([1, 2, 3, 4]) as integer) as k)""")  # fmt: skip
def ws20_hands(spark, sf):
    f = seq.fill_hand_gaps(v_frames(spark, sf).withColumn("h", F.when(F.col("h2"), hand())), "h", F.col("h2"), 3)
    joints = f.withColumn("joint", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("p", F.get("filled", F.col("joint")))
    return rounded(joints.select("sample_id", "frame_idx", "joint", "source", *[(F.col(f"p.{c}") + NUDGE).alias(c) for c in "xyz"]), "x", "y", "z")


@query("ws20_fill_counts", """
    with a as (select *, last_value(case when h2 then frame_idx end ignore nulls) over b as p, first_value(case when h2 then frame_idx end ignore nulls) over n as q
               from v_frames window b as (partition by sample_id order by frame_idx rows between unbounded preceding and current row), n as (partition by sample_id order by frame_idx rows between current row and unbounded following)),
    s as (select sample_id, frame_idx, not h2 and coalesce(q - p - 1 <= 3, false) as filled from a), l as (select *, coalesce(lag(filled) over (partition by sample_id order by frame_idx), false) as was from s)
    select sample_id, count(*) filter (where filled) as frames_filled, count(*) filter (where filled and not was) as gaps_filled from l group by sample_id""")  # fmt: skip
def ws20_counts(spark, sf):
    return seq.gap_fill_counts(seq.fill_gaps(v_frames(spark, sf), "x", F.col("h2"), 3))


@query("ar_sides_and_states", """
    with d as (select event_id, case when h1 then x end as ll, case when h1 then 60 - x * 0.4 end as lr, case when h2 then score * 60 end as rl, case when h2 then x * 0.5 end as rr, x, score from v_frames)
    select event_id, case when ll is not null and rr is not null then case when lr + rl < ll + rr then 'swap' else 'keep' end when ll is not null then case when lr < 0.8 * ll then 'move' else 'keep' end when rr is not null then case when rl < 0.8 * rr then 'move' else 'keep' end end as side,
           case when x < 0.25 * 40 or score < 0.35 * 0.5 or score > 0.8 then case when score < 0.3 then 'left' else 'right' end end as dropped, score >= 0.3 and x > 20 + 5.0 as occluded, round(case when x < 200 and score >= 0.25 then 1 / (1 + x / 40.0) end, 6) as quality, x < 1.1 * 40 as close_wrists from d""")  # fmt: skip
def ar_sides(spark, sf):
    f, x, s = v_frames(spark, sf), F.col("x"), F.col("score")
    side = arrays.assign_sides(F.when(F.col("h1"), x), F.when(F.col("h1"), 60 - x * 0.4), F.when(F.col("h2"), s * 60), F.when(F.col("h2"), x * 0.5))
    return f.select(
        "event_id", side.alias("side"), arrays.dedup_hands(x / 40, s / 0.5, s, F.lit(1.0), s, F.lit(0.3)).alias("dropped"), arrays.occlusion(s, x, F.lit(20.0), 0.3, 5.0).alias("occluded"),
        F.round(arrays.pose_quality(x, F.lit(40.0), s, x < 200), 6).alias("quality"), arrays.wrists_close(x, F.lit(40.0)).alias("close_wrists"),
    )


@query("ar15_sanity_reasons", """
    with d as (select event_id, score * 100 / 40 as ratio, x as jump, score as bone from v_frames) select event_id, list_filter([case when ratio < 0.70 or ratio > 1.35 then 'scale' end, case when jump > 2.5 * 40 then 'jump' end, case when bone > 0.30 then 'bone' end], lambda x: x is not null) as reasons from d""")  # fmt: skip
def ar15(spark, sf):
    return v_frames(spark, sf).select("event_id", arrays.sanity_reasons(F.col("score") * 100, F.lit(40.0), F.col("x"), F.col("score")).alias("reasons"))


@query("ar20_resample", "with l as (select sample_id, count(*) as n from v_frames group by 1), i as (select sample_id, k, cast(round_even(k * (n - 1) / 15, 0) as integer) as frame_idx from l, (select unnest(generate_series(0, 15)) as k)) select sample_id, cast(k as integer) as k, i.frame_idx, x from i join v_frames using (sample_id, frame_idx)")
def ar20(spark, sf):
    f = v_frames(spark, sf)
    i = f.groupBy("sample_id").agg(F.count("*").alias("n")).select("sample_id", F.posexplode(arrays.resample_index(F.col("n"), 16)).alias("k", "frame_idx"))
    return i.join(f, ["sample_id", "frame_idx"]).select("sample_id", "k", "frame_idx", "x")


@query("ar21_slice_with_pad", "with t as (select sample_id, list(x order by frame_idx) as v from v_frames group by 1) select sample_id, [v[least(60 + k, len(v) - 1) + 1] for k in generate_series(0, 31)] as clip from t")
def ar21(spark, sf):
    t = v_frames(spark, sf).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))), lambda r: r["x"]).alias("v"))
    return t.select("sample_id", arrays.slice_with_pad(F.col("v"), F.lit(60), 32).alias("clip"))


@query("ar23_l2_normalize", "select vec_id, [round(x / sqrt(list_sum([cast(y as double) * y::double for y in embedding])), 6) for x in embedding] as unit from embeddings")
def ar23(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(arrays.l2_normalize(F.col("embedding")), lambda x: sql_round(x)).alias("unit"))


@query("ar24_bio_string", "with s as (select sample_id, string_agg(substr('OBI', p + 1, 1), '' order by frame_idx) as t from v_bio group by 1) select sample_id, case when length(t) > 60 then left(t, 60) || '...(' || length(t) || ')' else t end as tags from s")
def ar24(spark, sf):
    t = v_bio(spark, sf).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "p"))), lambda r: r["p"]).alias("v"))
    return t.select("sample_id", arrays.bio_string(F.col("v"), 60).alias("tags"))
