"""Aggregations over the frame, clip and annotation views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agg, rows, seq
from .registry import query
from .seq_queries import ACTIVE, active
from .views import table, v_ann, v_frames, v_videos


#: Added before rounding to means of halves and quarters, whose sixth digit would else depend on the order of sums.
NUDGE = 3e-8


def rounded(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def sql_round(c, n=6):
    """The column rounded as SQL's round() does: it is scaled first, so that a product that is a half goes up, and a zero keeps its sign."""
    return F.when(F.abs(c) < 1e300, F.signum(c) * F.round(F.abs(c) * 10.0**n) / 10.0**n).otherwise(c)


@query("flagship", """
    with s as (select sample_id, frame_idx, h1, score, ts_ms - lag(ts_ms) over w as dt, lag(h1) over w as ph, abs(x - lag(x) over w) as dx from v_frames window w as (partition by sample_id order by frame_idx)),
    m as (select *, min(dt) over (partition by sample_id) as least from s), k as (select *, coalesce(case when h1 and ph then dx else 0 end / case when least > 0 then dt else 1 end, 0) as motion from m),
    r as (select *, row_number() over (partition by sample_id order by frame_idx) - row_number() over (partition by sample_id, h1 order by frame_idx) as island from k),
    g as (select sample_id, max(n) as gap_max from (select sample_id, count(*) as n from r where not h1 group by sample_id, island) group by sample_id),
    c as (select sample_id, count(*) as frames, avg(case when h1 then 1.0 else 0 end) as cov, median(score) as score, avg(motion) as motion from k group by sample_id)
    select frames // 10 as tens, count(*) as samples, cast(sum(frames) as bigint) as frames, round(sum(frames * (0.7 * cov + 0.3 * score)) / sum(frames), 6) as quality, round(avg(motion), 6) as motion, max(coalesce(gap_max, 0)) as gap_max
    from c left join g using (sample_id) group by 1""")  # fmt: skip
def flagship(spark, sf):
    """Motion and missing runs of every clip, their summary, and the run aggregate by clip length."""
    f = v_frames(spark, sf)
    k = seq.frame_motion(f, "x", "h1", "ts_ms").groupBy("sample_id").agg(F.count("*").alias("frames"), F.avg(F.col("h1").cast("double")).alias("cov"), F.median("score").alias("score"), F.avg("motion").alias("motion"))
    c = k.join(seq.longest_run(f, ~F.col("h1")), "sample_id")
    n = F.sum("frames")
    out = c.groupBy(F.expr("frames div 10").alias("tens")).agg(
        F.count("*").alias("samples"), n.alias("frames"), (F.sum(F.col("frames") * (0.7 * F.col("cov") + 0.3 * F.col("score"))) / n).alias("quality"), F.avg("motion").alias("motion"), F.max("longest").alias("gap_max")
    )
    return rounded(out, "quality", "motion")


AG1 = """count(*) as samples, cast(sum(frames) as bigint) as frames, round(sum(quality * frames) / sum(frames), 6) as quality, round(sum(swaps) / sum(frames), 6) as swap_rate,
         round(sum(missing) / (2 * sum(frames)), 6) as missing_rate, round(sum(outliers) / (2 * sum(frames)), 6) as outlier_rate, round(sum(delta * frames) / sum(frames), 6) as delta"""
RATES = ("quality", "swap_rate", "missing_rate", "outlier_rate", "delta")


@query("ag1_run_aggregate", f"select sample_id % 10 as run, {AG1} from v_videos group by 1")
def ag1(spark, sf):
    return rounded(agg.run_aggregate(v_videos(spark, sf).withColumn("run", F.col("sample_id") % 10), by=["run"]), *RATES)


@query("ag2_extended_aggregate", f"select {AG1}, round(sum(hand1) / sum(frames), 6) as hand1_rate, round(sum(hand2) / sum(frames), 6) as hand2_rate, max(delta) as delta_max from v_videos")
def ag2(spark, sf):
    return rounded(agg.extended_aggregate(v_videos(spark, sf)), *RATES, "hand1_rate", "hand2_rate")


@query("ag3_mean_numeric", "select round(avg(l_quantity), 6) as l_quantity, round(avg(l_extendedprice), 4) as l_extendedprice, round(avg(l_linenumber), 6) as l_linenumber from lineitem")
def ag3(spark, sf):
    df = agg.mean_numeric(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_linenumber", "l_returnflag"))
    return rounded(rounded(df, "l_quantity", "l_linenumber"), "l_extendedprice", n=4)


@query("ag4_composite_score", """
    select sample_id, round(2 * case when swaps > 14 then 0 else quality end - 0.5 * missing / frames - 1.0, 6) as score, list_filter([case when swaps > 14 then 'q' end, 'gone'], lambda x: x is not null) as missing_metrics from v_videos""")  # fmt: skip
def ag4(spark, sf):
    v = v_videos(spark, sf).withColumn("q", F.when(F.col("swaps") <= 14, F.col("quality"))).withColumn("miss", F.col("missing") / F.col("frames"))
    return rounded(agg.composite_score(v, {"q": 2.0, "miss": -0.5, "gone": -1.0}).select("sample_id", "score", "missing_metrics"), "score")


@query("ag5_sample_summary", """
    with d as (select *, ts_ms - lag(ts_ms) over (partition by sample_id order by frame_idx) as dt from v_frames),
    s as (select sample_id, count(*) as frames, avg(case when h1 then 1.0 else 0 end) as left_cov, avg(case when h2 then 1.0 else 0 end) as right_cov, avg(case when h1 and h2 then 1.0 else 0 end) as both_cov,
                 avg(score) as score_mean, median(score) as score_median, median(case when dt > 0 then dt end) as dt_median from d group by sample_id)
    select sample_id, frames, round(left_cov, 6) as left_cov, round(right_cov, 6) as right_cov, round(both_cov, 6) as both_cov, round(score_mean, 6) as score_mean, round(score_median, 6) as score_median, round(dt_median, 6) as dt_median,
           round(1000 / dt_median, 6) as fps_est, round(0.4 * both_cov + 0.3 * (left_cov + right_cov) / 2 + 0.3 * score_median, 6) as quality from s""")  # fmt: skip
def ag5(spark, sf):
    return rounded(agg.sample_summary(v_frames(spark, sf)), "left_cov", "right_cov", "both_cov", "score_mean", "score_median", "dt_median", "fps_est", "quality")


@query("ag6_diagnostic_counts", """
    select sample_id, count(*) filter (where occ) as occluded, count(*) filter (where not h1 and not h2) as lost, count(*) filter (where h1 and not h2) as one_sided,
           round(count(*) filter (where occ) / count(*), 6) as occluded_rate, round(count(*) filter (where occ and h1) / greatest(count(*) filter (where occ), 1), 6) as occlusion_saved from v_frames group by sample_id""")  # fmt: skip
def ag6(spark, sf):
    return rounded(agg.diagnostic_counts(v_frames(spark, sf)), "occluded_rate", "occlusion_saved")


@query("ag7_conditional_percentiles", "select sample_id, " + ", ".join(f"round(quantile_cont(case when {c} then x end, {p}), 6) as {n}_p{round(100 * p)}" for n, c in (("all", "true"), ("on", "occ"), ("off", "not occ")) for p in (0.5, 0.9)) + " from v_frames group by sample_id")
def ag7(spark, sf):
    d = agg.conditional_percentiles(v_frames(spark, sf), "x", "occ")
    return rounded(d, *d.columns[1:])


@query("ag8_describe_metrics", """
    with l as (select unnest(['frames', 'quality', 'delta']) as metric, unnest([frames::double, quality, delta]) as v from v_videos)
    select metric, count(*) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, """ + ", ".join(f"round(quantile_cont(v, {p}), 6) as p{round(100 * p)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " from l group by metric")  # fmt: skip
def ag8(spark, sf):
    return rounded(agg.describe_metrics(v_videos(spark, sf), ["frames", "quality", "delta"]), "mean", "std", "p10", "p25", "p50", "p75", "p90")


@query("ag9_recommend_settings", """
    with m as (select median(quality) as q, median(missing / frames) as miss, median(frames) as n from v_videos)
    select cast(case when q >= 0.5 then 0.5 when q >= 0.3 then 0.3 else 0.2 end as double) as score_threshold, case when miss > 0.3 then 8 else 4 end as max_gap, cast(least(greatest(floor(n / 4), 8), 64) as bigint) as "window" from m""")  # fmt: skip
def ag9(spark, sf):
    return agg.recommend_settings(v_videos(spark, sf)).withColumn("window", F.col("window").cast("long"))


@query("ag10_length_stats", """select label, count(*) as n, min("end" - "begin") as min, round(quantile_cont("end" - "begin", 0.25), 6) as p25, round(quantile_cont("end" - "begin", 0.5), 6) as p50, round(quantile_cont("end" - "begin", 0.75), 6) as p75, max("end" - "begin") as max, round(avg("end" - "begin"), 6) as mean from v_ann group by label""")
def ag10(spark, sf):
    return rounded(agg.length_stats(v_ann(spark, sf).withColumn("length", F.col("end") - F.col("begin")), "length", ["label"]), "p25", "p50", "p75", "mean")


@query("ag10_nearest_rank", "with r as (select sample_id, x, row_number() over (partition by sample_id order by x) - 1 as i, round_even((count(*) over (partition by sample_id) - 1) * 0.9, 0) as k from v_frames) select sample_id, x from r where i = k")
def ag10_rank(spark, sf):
    return agg.nearest_rank(v_frames(spark, sf), "x", 0.9, ["sample_id"])


@query("ag11_histogram", """with b as (select * from (values (0, 1, 8), (1, 8, 16), (2, 16, 32), (3, 32, 64), (4, 64, 128), (5, 128, 100000)) t(bin, lo, hi)) select bin, count(row_num) as n from b left join v_ann on "end" - "begin" >= lo and "end" - "begin" < hi group by bin""")
def ag11(spark, sf):
    return agg.histogram(v_ann(spark, sf).withColumn("length", F.col("end") - F.col("begin")), "length", [1, 8, 16, 32, 64, 128])


@query("ag12_class_distribution", """with c as (select signer, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val, count(*) as total from v_ann group by signer)
    select *, case when total >= 100 then 'many' when total >= 20 then 'medium' else 'few' end as shots, round(max(total) over () / total, 6) as imbalance from c""")  # fmt: skip
def ag12(spark, sf):
    return rounded(agg.class_distribution(v_ann(spark, sf), "signer"), "imbalance")


@query("ag13_length_coverage", "with p as (select sample_id, count(*) as n, avg(case when score >= 0.45 then 1.0 else 0 end) as cov from v_frames group by sample_id) select count(*) as samples, round(avg(n), 6) as frames_mean, round(median(cov), 6) as cov_median, round(quantile_cont(cov, 0.1), 6) as cov_p10 from p")
def ag13(spark, sf):
    return rounded(agg.length_coverage(v_frames(spark, sf), "score"), "frames_mean", "cov_median", "cov_p10")


@query("ag14_seglen_report", """with l as (select split, "end" - "begin" as length from v_ann where "end" > "begin"), r as (select split, count(*) as n, quantile_cont(length, 0.5) as p50, quantile_cont(length, 0.9) as p90, quantile_cont(length, 0.95) as p95 from l group by rollup (split))
    select *, case when p95 <= 32 then 32 when p95 <= 48 then 48 else 64 end as cap from r""")  # fmt: skip
def ag14(spark, sf):
    return agg.seglen_report(rows.segment_lengths(v_ann(spark, sf), "begin", "end"))


@query("ag15_pair_counts", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def ag15(spark, sf):
    return agg.pair_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("ag16_split_summary", "select split, count(*) as n_rows, count(distinct signer) as signers, count(distinct label) as labels from v_ann group by rollup (split)")
def ag16(spark, sf):
    return agg.split_summary(v_ann(spark, sf))


@query("ag16_signer_overlap", "select count(*) as overlap from (select signer from v_ann group by signer having count(distinct split) > 1)")
def ag16_overlap(spark, sf):
    return agg.signer_overlap(v_ann(spark, sf))


@query("ag17_reject_audit", """
    with j as (select *, case when split = '' then 'missing_split_value' when "end" <= "begin" then 'invalid_clip_range' end as r from v_ann), d as (select *, row_number() over (partition by attachment_id, r is null order by row_num) as n from j)
    select coalesce(case when r is null and n > 1 then 'duplicate_sample_id' else r end, 'accepted') as reason, count(*) as n from d group by 1""")  # fmt: skip
def ag17(spark, sf):
    return agg.reject_audit(rows.validate_annotations(v_ann(spark, sf)))


@query("ag18_label_summary", """select count(*) as clips, count(*) filter (where label = 'NO') as background, round(avg(case when label = 'NO' then 1.0 else 0 end), 6) as background_rate, median(case when label <> 'NO' then "end" - "begin" end) as length_median, max(case when label <> 'NO' then "end" - "begin" end) as length_max from v_ann""")
def ag18(spark, sf):
    i = v_ann(spark, sf).select((F.col("label") == "NO").alias("bg"), (F.col("end") - F.col("begin")).alias("length"))
    return rounded(agg.label_summary(i, "bg", "length"), "background_rate")


@query("ag19_ecdf", "select distinct l_quantity, round(cume_dist() over (order by l_quantity), 9) as ecdf, round(1 - cume_dist() over (order by l_quantity), 9) as ccdf from lineitem")
def ag19(spark, sf):
    return rounded(agg.ecdf(table(spark, sf, "lineitem"), "l_quantity"), "ecdf", "ccdf", n=9)


@query("ag43_pool_summary", "select label, split, count(*) as n from v_ann group by rollup (label, split)")
def ag43(spark, sf):
    return agg.pool_summary(v_ann(spark, sf), ["label", "split"])


@query("ag39_segment_quality", """
    with b as (select sample_id, avg(case when h1 then 1.0 else 0 end) as presence, avg(x) as motion_mean, stddev_pop(x) as motion_std from v_frames group by sample_id),
    r as (select sample_id, h1, row_number() over (partition by sample_id order by frame_idx) - row_number() over (partition by sample_id, h1 order by frame_idx) as i from v_frames),
    g as (select sample_id, max(n) as longest from (select sample_id, count(*) as n from r where not h1 group by sample_id, i) group by sample_id), p as (select quantile_cont(motion_mean, 0.9) as p90 from b),
    s as (select sample_id, presence, motion_mean, motion_std, coalesce(longest, 0) as longest, 0.7 * presence + 0.3 * least(motion_mean / p90, 1.0) as score from b left join g using (sample_id), p)
    select sample_id, round(presence, 6) as presence, round(motion_mean, 6) as motion_mean, round(motion_std, 6) as motion_std, longest, round(score, 6) as score, case when presence = 0 then 'EMPTY' when score < 0.8 then 'WEAK' else 'OK' end as bucket from s""")  # fmt: skip
def ag39(spark, sf):
    return rounded(agg.segment_quality(v_frames(spark, sf), "x"), "presence", "motion_mean", "motion_std", "score")


@query("ag40_review_warnings", ACTIVE + """
    , b as (select sample_id, avg(case when event_type in ('click', 'view') then 1.0 else 0 end) as lt, avg(case when event_type = 'purchase' then 1.0 else 0 end) as rt, avg(score) as pose from v_frames group by sample_id),
    n as (select sample_id, count(*) as n from seg where "end" - "start" > 5 group by sample_id), spoken as (select sample_id, count(*) as told, count(*) filter (where x > 200) as accepted from v_frames where occ group by sample_id),
    w as (select sample_id, unnest([1, 2, 3, 4, 5]) as k, unnest([pose < 0.35, lt < 0.25, rt < 0.25, coalesce(n, 0) = 0, coalesce(n, 0) > 0 and told > 0 and accepted = 0]) as is_so,
                 unnest(['pose_reliability_low', 'left_hand_sparse', 'right_hand_sparse', 'no_segments', 'all_predictions_rejected']) as id, unnest([pose, lt, rt, null, told]) as value from b left join n using (sample_id) left join spoken using (sample_id))
    select sample_id, id, round(value, 6) as value from w where is_so""")  # fmt: skip
def ag40(spark, sf):
    f, kind = v_frames(spark, sf), F.col("event_type")
    told = f.where("occ").select("sample_id", (F.col("x") > 200).alias("accepted"))
    w = agg.review_warnings(f, active(spark, sf).where(F.col("end") - F.col("start") > 5), told, kind.isin("click", "view"), kind == "purchase", F.col("score"))
    return rounded(w.select("sample_id", F.explode("warnings").alias("w")).select("sample_id", "w.*"), "value")


@query("ag41_timeline_tracks", "select sample_id, list(x order by frame_idx) as track from v_frames group by sample_id")
def ag41(spark, sf):
    return agg.timeline_tracks(v_frames(spark, sf), "x")


@query("ag38_artifact_validation", """
    with v as (select sample_id, frames + case when sample_id % 9 = 0 then 1 else 0 end as said, sample_id % 13 = 0 as wrong from v_videos where sample_id % 10 <> 3), f as (select sample_id, count(*) as found from v_frames where sample_id % 11 <> 5 group by sample_id),
    a as (select distinct sample_id, true as there from v_frames where sample_id % 7 <> 2), all_ as (select * from v full join f using (sample_id) full join a using (sample_id))
    select sample_id, unnest(list_filter([case when wrong then 'schema' end, case when said is null then 'no_video' end, case when found is null then 'no_frames' end, case when said <> found then 'frame_count' end, case when there is null and said is not null then 'not_in_arrays' end, case when said is null and there then 'only_in_arrays' end], lambda x: x is not null)) as finding from all_""")  # fmt: skip
def ag38(spark, sf):
    v = v_videos(spark, sf).where("sample_id % 10 <> 3").select("sample_id", (F.col("frames") + F.when(F.col("sample_id") % 9 == 0, 1).otherwise(0)).alias("frames"), F.lit("landmarks").alias("schema_name"), F.when(F.col("sample_id") % 13 == 0, "0").otherwise("1").alias("schema_version"))
    f = v_frames(spark, sf)
    return agg.artifact_validation(v, f.where("sample_id % 11 <> 5"), f.where("sample_id % 7 <> 2"), ("landmarks", "1"))


@query("ag39_bucket_counts", """
    with b as (select sample_id, avg(case when x >= 20 then 1.0 else 0 end) as presence, avg(x) as m from v_frames group by sample_id), p as (select quantile_cont(m, 0.9) as p90 from b),
    q as (select sample_id, case when presence = 0 then 'EMPTY' when 0.7 * presence + 0.3 * least(m / p90, 1.0) < 0.8 then 'WEAK' else 'OK' end as bucket from b, p)
    select case when sample_id % 5 < 4 then 'train' end as split, bucket, count(*) as n from q group by 1, 2""")  # fmt: skip
def ag39_counts(spark, sf):
    f = v_frames(spark, sf)
    splits = f.where("sample_id % 5 < 4").select("sample_id", F.lit("train").alias("split")).distinct()
    return agg.bucket_counts(agg.segment_quality(f, "x", points=F.col("x") / 4), splits)


@query("ag35_sample_weights", "with n as (select label, count(*) as n from embeddings group by label) select vec_id, round((0.5 + 0.5 * greatest(vec_id % 10 / 10, 0.1)) * pow(greatest(vec_id % 7 / 7, 0.1), 2) / n, 9) as weight from embeddings join n using (label)")
def ag35(spark, sf):
    e = agg.sample_weights(table(spark, sf, "embeddings").select("vec_id", "label"), "label", F.col("vec_id") % 7 / 7, F.col("vec_id") % 10 / 10, 2.0)
    return rounded(e.select("vec_id", "weight"), "weight", n=9)


@query("ag37_quality_gate", """
    with s as (select sum(quality * frames) / sum(frames) as quality, sum(missing) / (2 * sum(frames)) as missing_rate, sum(swaps) / sum(frames) as swap_rate from v_videos),
    f as (select list_filter([case when quality < 0.9 then 'quality below 0.9' end, case when missing_rate > 0.05 then 'missing_rate above 0.05' end, case when swap_rate > 0.9 then 'swap_rate above 0.9' end], lambda x: x is not null) as failures from s) select failures, len(failures) = 0 as passed from f""")  # fmt: skip
def ag37(spark, sf):
    return agg.quality_gate(agg.run_aggregate(v_videos(spark, sf)), {"quality": (0.9, None), "missing_rate": (None, 0.05), "swap_rate": (None, 0.9)})
