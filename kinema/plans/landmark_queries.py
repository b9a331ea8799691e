"""Landmark features over the frame view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, landmarks
from ..functions.tables import chunk_table
from ..operators import sets
from .agg_queries import rounded
from .registry import query
from .views import v_ann, v_frames


@query("ar5_canonical_frames", """
    with t as (select sample_id, frame_idx, case when sample_id % 3 = 0 then cast(frame_idx * 40 as double) else cast(ts_ms as double) end as ts_ms from v_frames), d as (select *, ts_ms - lag(ts_ms) over (partition by sample_id order by frame_idx) as dt from t)
    select sample_id, frame_idx, round(ts_ms, 6) as ts_ms, round(median(case when dt > 0 then dt end) over (partition by sample_id), 6) as frame_dt_ms from d""")  # fmt: skip
def ar5(spark, sf):
    f = v_frames(spark, sf).select("sample_id", "frame_idx", F.when(F.col("sample_id") % 3 != 0, F.col("ts_ms")).alias("ts"))
    return rounded(landmarks.canonical_frames(f, 25.0).select("sample_id", "frame_idx", "ts_ms", "frame_dt_ms"), "ts_ms", "frame_dt_ms")


@query("ar17_center_normalize", """
    with c as (select sample_id, frame_idx, case when h1 then x - avg(case when h1 then x end) over (partition by sample_id) end as c from v_frames), r as (select *, row_number() over (partition by sample_id order by abs(c) nulls last) as r, count(c) over (partition by sample_id) as n from c),
    s as (select *, min(case when c is not null and r = greatest(floor(n * 0.95), 1) then abs(c) end) over (partition by sample_id) as span from r) select sample_id, frame_idx, round(c / span, 6) as norm from s""")  # fmt: skip
def ar17(spark, sf):
    return rounded(landmarks.center_normalize(v_frames(spark, sf), "x", "h1").select("sample_id", "frame_idx", "norm"), "norm")


@query("ar18_mirror", "select sample_id, frame_idx, case when sample_id % 4 = 0 then score else -score end as l, case when sample_id % 4 = 0 then null else score end as r, sample_id % 4 = 0 as mirrored from v_frames")
def ar18(spark, sf):
    f = v_frames(spark, sf).select("sample_id", "frame_idx", F.when(F.col("sample_id") % 4 != 0, F.lit(None).cast("double")).alias("l"), F.col("score").alias("r"))
    return landmarks.mirror_if_one_sided(f.withColumn("l", F.when(F.col("sample_id") % 4 != 0, -F.col("r"))), "l", "r")


@query("ws3_motion_features", """
    with l as (select *, lag(h1) over w as p1, lag(h1, 2) over w as p2, lag(x) over w as x1, lag(x, 2) over w as x2, avg(case when h1 then 1.0 else 0 end) over (partition by sample_id order by frame_idx rows unbounded preceding) as share from v_frames window w as (partition by sample_id order by frame_idx))
    select sample_id, frame_idx, round(case when h1 and coalesce(p1, false) then x - x1 else 0 end, 6) as velocity, round(case when h1 and coalesce(p1, false) and coalesce(p2, false) then x - 2 * x1 + x2 else 0 end, 6) as acceleration, round(share, 6) as valid_share from l""")  # fmt: skip
def ws3(spark, sf):
    d = landmarks.motion_features(v_frames(spark, sf), "x", "h1").select("sample_id", "frame_idx", "velocity", "acceleration", "valid_share")
    return rounded(d, "velocity", "acceleration", "valid_share")


@query("ag42_kinematic_signature", """
    with l as (select *, lag(h1) over w as p1, lag(x) over w as x1, count(*) over (partition by sample_id) as n from v_frames window w as (partition by sample_id order by frame_idx)),
    s as (select *, case when h1 and coalesce(p1, false) then abs(x - x1) else 0 end as speed, n // 4 as size, n % 4 as more from l), b as (select *, case when frame_idx < more * (size + 1) then frame_idx // (size + 1) else more + (frame_idx - more * (size + 1)) // greatest(size, 1) end as bin from s)
    select sample_id, round(avg(speed), 6) as speed_mean, round(stddev_pop(speed), 6) as speed_std, round(max(speed), 6) as speed_peak, round(avg(case when h1 then 1.0 else 0 end), 6) as coverage,
           round(avg(case when bin = 0 then speed end), 6) as e0, round(avg(case when bin = 3 then speed end), 6) as e3 from b group by sample_id""")  # fmt: skip
def ag42(spark, sf):
    d = landmarks.kinematic_signature(v_frames(spark, sf), "x", "h1", 4).withColumn("e0", F.col("energy")[0]).withColumn("e3", F.col("energy")[3]).drop("energy")
    return rounded(d, "speed_mean", "speed_std", "speed_peak", "coverage", "e0", "e3")


@query("ag36_generated_stats", """
    with p as (select label as role, signer as source, greatest("end" - "begin", 1) as length from v_ann) select role, source, count(*) as parts, cast(sum(length) as bigint) as frames, round(avg(length), 6) as length_mean from p group by all""")  # fmt: skip
def ag36(spark, sf):
    p = v_ann(spark, sf).select(F.col("row_num").alias("sample_id"), F.array(F.struct(F.col("label").alias("role"), F.col("signer").alias("source"), F.greatest(F.col("end") - F.col("begin"), F.lit(1)).alias("length"))).alias("parts"))
    return rounded(landmarks.generated_stats(p), "length_mean")


@query("tk8_expand_grid", """
    select l_returnflag as flag, l_linestatus as status, k, left(sha1(l_returnflag || '|' || l_linestatus || '|' || k), 10) as config_id
    from (select distinct l_returnflag from lineitem), (select distinct l_linestatus from lineitem), (select unnest([1, 2, 3]) as k)""")  # fmt: skip
def tk8(spark, sf):
    from .views import table

    li = table(spark, sf, "lineitem")
    grid = li.select(F.col("l_returnflag").alias("flag")).distinct(), li.select(F.col("l_linestatus").alias("status")).distinct(), spark.createDataFrame([(1,), (2,), (3,)], "k int")
    return sets.expand_grid(spark, grid)


@query("ar3_pose_reorder", "select event_id, [case when h1 then x end, score, null] as pose from v_frames")
def ar3(spark, sf):
    pose = F.array(F.col("score"), F.when(F.col("h1"), F.col("x")))
    ids = lambda *v: F.array(*map(F.lit, v))
    return v_frames(spark, sf).select("event_id", arrays.pose_reorder(pose, ids(11, 12), ids(12, 11, 13)).alias("pose"))


@query("ar4_ar6_masks", """
    select event_id, [case when h1 then x else 0 end, case when h1 then score else 0 end, case when h2 then x * 2 else 0 end, case when h2 then score * 2 else 0 end] as joints, [h1, h1, h2, h2] as mask, [h1 and score >= 0.3, h1 and score >= 0.3] as by_score from v_frames""")  # fmt: skip
def ar4(spark, sf):
    left, right = F.when(F.col("h1"), F.array("x", "score")), F.when(F.col("h2"), F.array(F.col("x") * 2, F.col("score") * 2))
    joints, mask = arrays.combine_hands(left, right, 2)
    return v_frames(spark, sf).select("event_id", joints.alias("joints"), mask.alias("mask"), arrays.mask_by_score(F.col("h1"), F.col("score"), 0.3, 2).alias("by_score"))


@query("ar7_ar19_joints", "select event_id, case when h1 then x when occ then score end as wrist, [0.0::double, round(score - x, 6), round(x * 3 - score, 6)] as bones, [least(greatest(score + least(greatest(x / 100, -0.2), 0.2), 0), 1)::double] as shifted from v_frames")
def ar7(spark, sf):
    joints = F.array(F.col("x"), F.col("score"), F.col("x") * 3)
    bones = arrays.bones(joints, F.array(F.lit(-1), F.lit(0), F.lit(1)))
    return v_frames(spark, sf).select(
        "event_id", arrays.wrist_fallback(F.when(F.col("h1"), F.col("x")), F.col("score"), F.col("occ"), False).alias("wrist"),
        F.transform(bones, lambda b: F.round(b, 6)).alias("bones"), arrays.shift_to_reference(F.array("score"), F.col("x") / 100, F.lit(0.2)).alias("shifted"),
    )


@query("ar8_ar9_distances", """
    with d as (select event_id, sqrt(pow(x, 2) + pow(score, 2)) as a, sqrt(pow(score * 9, 2) + 1) as b, x * 0.5 as c, sqrt(pow(x - score, 2) + pow(x * 2 - 3, 2)) as e, sqrt(pow(score - x, 2) + pow(1 - x, 2)) as f from v_frames)
    select event_id, round(a + b + c - least(a, b, c) - greatest(a, b, c), 6) as scale, round((e + f) / 2, 6) as mean_l2 from d""")  # fmt: skip
def ar8(spark, sf):
    x, s, n = F.col("x"), F.col("score"), lambda v: F.lit(float(v))
    scale = arrays.hand_scale(F.array(n(0), x, s * 9, x * 0.5), F.array(n(0), s, n(1), n(0)))
    l2 = arrays.mean_l2(F.array(x, s), F.array(x * 2, n(1)), F.array(s, x), F.array(n(3), x))
    return v_frames(spark, sf).select("event_id", F.round(scale, 6).alias("scale"), F.round(l2, 6).alias("mean_l2"))


@query("ud3_chunk_table", """
    with s as (select sample_id, count(*) as n from v_frames group by 1) select sample_id, cast(c as integer) as chunk_start, cast(c + 16 as integer) as chunk_end from (select sample_id, n, unnest(generate_series(0, n - 16, 8)) as c from s)""")  # fmt: skip
def ud3(spark, sf):
    s = v_frames(spark, sf).groupBy("sample_id").agg(F.count("*").cast("int").alias("n"))
    return s.lateralJoin(chunk_table(F.lit(0), F.col("n").outer(), F.lit(16), F.lit(8))).select("sample_id", "chunk_start", "chunk_end")
