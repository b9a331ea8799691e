"""Sequence operators over the frame and tag views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import seq
from .registry import query
from .views import v_ann, v_bio, v_frames

W = "over (partition by sample_id order by frame_idx)"


@query("ws1_frame_motion", f"""
    with d as (select *, ts_ms - lag(ts_ms) {W} as dt, lag(x) {W} as px, lag(h1) {W} as ph from v_frames),
    m as (select *, min(dt) over (partition by sample_id) as least from d)
    select sample_id, frame_idx, round(coalesce(case when least > 0 then (case when h1 and ph then abs(x - px) else 0 end) / dt
           else (case when h1 and ph then abs(x - px) else 0 end) end, 0), 9) as motion from m""")  # fmt: skip
def ws1(spark, sf):
    return seq.frame_motion(v_frames(spark, sf), "x", "h1", "ts_ms").select("sample_id", "frame_idx", F.round("motion", 9).alias("motion"))


@query("ws2_velocity", f"""
    with d as (select *, greatest(ts_ms - lag(ts_ms) {W}, 1) / 1000.0 as dt, lag(x) {W} as px, max(ts_ms) over (partition by sample_id) = min(ts_ms) over (partition by sample_id) as flat from v_frames)
    select sample_id, frame_idx, round(coalesce((x - px) / case when flat then 1 / 30.0 else dt end, 0), 6) as velocity from d""")  # fmt: skip
def ws2(spark, sf):
    return seq.velocity(v_frames(spark, sf), "x", "ts_ms").select("sample_id", "frame_idx", F.round("velocity", 6).alias("velocity"))


@query("ws4_smooth_box", """
    select sample_id, frame_idx, round(case when count(*) over (partition by sample_id) < 6 then x else
           sum(x) over (partition by sample_id order by frame_idx rows between 3 preceding and 2 following) / 6 end, 6) as smooth from v_frames""")  # fmt: skip
def ws4(spark, sf):
    return seq.smooth_box(v_frames(spark, sf), "x", 6).select("sample_id", "frame_idx", F.round("smooth", 6).alias("smooth"))


@query("ws5_smooth_tracks", """
    select sample_id, frame_idx, round(case when h1 then avg(case when h1 then x end) over (partition by sample_id order by frame_idx rows between 2 preceding and 2 following) end, 6) as smooth from v_frames""")  # fmt: skip
def ws5(spark, sf):
    f = v_frames(spark, sf).withColumn("v", F.when(F.col("h1"), F.col("x")))
    return seq.smooth_tracks(f, "v").select("sample_id", "frame_idx", F.round("smooth", 6).alias("smooth"))


@query("ws6_deflicker", """
    select sample_id, frame_idx, sum(case when h2 then 1 else 0 end) over (partition by sample_id order by frame_idx rows between 1 preceding and 1 following) >= 2 as steady from v_frames""")  # fmt: skip
def ws6(spark, sf):
    return seq.deflicker(v_frames(spark, sf), "h2").select("sample_id", "frame_idx", "steady")


@query("ws7_forward_fill", """
    with f as (select *, last_value(case when h2 then x end ignore nulls) over (partition by sample_id order by frame_idx rows between unbounded preceding and current row) as filled from v_frames)
    select sample_id, frame_idx, filled, not h2 and filled is not null as interpolated from f""")  # fmt: skip
def ws7(spark, sf):
    f = v_frames(spark, sf).withColumn("v", F.when(F.col("h2"), F.col("x")))
    return seq.forward_fill(f, "v").select("sample_id", "frame_idx", "filled", "interpolated")


@query("ws7_ema", """
    with recursive s as (select sample_id, 0 as i, x as e from v_frames where frame_idx = 0
      union all select s.sample_id, s.i + 1, s.e * (1 - 0.25) + f.x * 0.25 from s join v_frames f on f.sample_id = s.sample_id and f.frame_idx = s.i + 1)
    select sample_id, round(max_by(e, i), 6) as ema from s group by sample_id""")  # fmt: skip
def ws7_ema(spark, sf):
    return seq.ema(v_frames(spark, sf), "x", 0.25).select("sample_id", F.round("ema", 6).alias("ema"))


RUNS = """
    with r as (select *, row_number() over (partition by sample_id order by frame_idx) - row_number() over (partition by sample_id, {flag} order by frame_idx) as island from v_frames),
    g as (select sample_id, min(frame_idx) as "start", max(frame_idx) as "end", count(*) as length from r where {flag} group by sample_id, island)
"""


@query("ws8_runs", RUNS.format(flag="not h2") + """ select sample_id, "start", "end", length from g""")
def ws8_runs(spark, sf):
    return seq.runs(v_frames(spark, sf), ~F.col("h2"))


@query("ws8_gap_stats", RUNS.format(flag="not h2") + """
    select f.sample_id, round(coalesce(quantile_cont(length, 0.5), 0), 6) as gap_p50, round(coalesce(quantile_cont(length, 0.9), 0), 6) as gap_p90,
           coalesce(max(length), 0) as gap_max, round(coalesce(avg(length), 0), 6) as gap_mean
    from (select distinct sample_id from v_frames) f left join g using (sample_id) group by f.sample_id""")  # fmt: skip
def ws8_gaps(spark, sf):
    g = seq.gap_stats(v_frames(spark, sf), F.col("h2"))
    return g.select("sample_id", *[F.round(c, 6).alias(c) for c in ("gap_p50", "gap_p90")], "gap_max", F.round("gap_mean", 6).alias("gap_mean"))


@query("ws9_longest_run", RUNS.format(flag="not h1") + """
    select f.sample_id, coalesce(max(length), 0) as longest from (select distinct sample_id from v_frames) f left join g using (sample_id) group by f.sample_id""")  # fmt: skip
def ws9(spark, sf):
    return seq.longest_run(v_frames(spark, sf), ~F.col("h1"))


@query("ws10_outlier_jumps", f"""
    with s as (select *, 10 + event_id % 13 as scale from v_frames), d as (select *, lag(x) {W} as px, lag(scale) {W} as ps, lag(h1) {W} as ph from s)
    select sample_id, count(*) filter (where h1 and ph and (abs(x - px) > 2.5 * ps or greatest(scale, ps) > 1.6 * least(scale, ps))) as jumps from d group by sample_id""")  # fmt: skip
def ws10(spark, sf):
    f = v_frames(spark, sf).withColumn("scale", 10 + F.col("event_id") % 13)
    return seq.outlier_jumps(f, "x", "scale", "h1")


@query("ws11_toggles", f"""
    with d as (select *, coalesce(lag(event_type) {W} <> event_type, false) as c from v_frames)
    select sample_id, count(*) filter (where c) as changes, round(count(*) filter (where c) / greatest(count(*) - 1, 1), 9) as rate from d group by sample_id""")  # fmt: skip
def ws11(spark, sf):
    return seq.toggles(v_frames(spark, sf), "event_type").withColumn("rate", F.round("rate", 9))


ACTIVE = """
    with t as (select sample_id, greatest(quantile_cont(case when h1 then x end, 0.75), 20) as thr, arg_max(frame_idx, (x, -frame_idx)) as peak, min(frame_idx) as lo, max(frame_idx) as hi from v_frames group by sample_id),
    e as (select t.sample_id, any_value(peak) as peak, any_value(lo) as lo, any_value(hi) as hi, max(case when x < 0.5 * thr and frame_idx < peak then frame_idx end) as b,
          min(case when x < 0.5 * thr and frame_idx > peak then frame_idx end) as a from v_frames f join t using (sample_id) group by t.sample_id),
    seg as (select sample_id, peak, greatest(coalesce(b + 1, lo) - 2, lo) as "start", least(coalesce(a - 1, hi) + 2, hi) as "end" from e)
"""


def active(spark, sf):
    return seq.active_segment(v_frames(spark, sf), "x", "h1", 0.75, 20.0)


@query("ws12_active_segment", ACTIVE + """ select sample_id, peak, "start", "end" from seg""")
def ws12(spark, sf):
    return active(spark, sf)


@query("ws13_tag_segments", ACTIVE + """
    select f.sample_id, frame_idx, case when frame_idx = "start" then 1 when frame_idx between "start" and "end" then 2 else 0 end as bio from v_frames f left join seg using (sample_id)""")  # fmt: skip
def ws13(spark, sf):
    return seq.tag_segments(v_frames(spark, sf), active(spark, sf)).select("sample_id", "frame_idx", "bio")


TAGS = """
    with o as (select *, sum(case when y <> 2 then 1 else 0 end) over (partition by sample_id order by frame_idx rows unbounded preceding) as island from v_bio),
    g as (select sample_id, island, min(case when y = 1 then frame_idx end) as "start", max(case when y <> 0 then frame_idx end) as "end", count(*) filter (where y = 2) as inside from o group by sample_id, island)
"""


@query("ws14_bio_segments", TAGS + """ select sample_id, "start", "end", "end" - "start" + 1 as length from g where "start" is not null""")
def ws14(spark, sf):
    return seq.bio_segments(v_bio(spark, sf), "y")


@query("ws14_bio_violations", TAGS + """
    , v as (select sample_id, sum(case when "start" is null then inside else 0 end) as n from g group by sample_id), c as (select sample_id, count(*) as n from v_bio group by sample_id)
    select sample_id, cast(v.n as bigint) as violations, round(v.n / c.n, 9) as rate from v join c using (sample_id)""")  # fmt: skip
def ws14_violations(spark, sf):
    return seq.bio_violations(v_bio(spark, sf), "y").withColumn("rate", F.round("rate", 9))


@query("ws15_onset_band", """
    select sample_id, frame_idx, max(case when y = 1 then 1 else 0 end) over (partition by sample_id order by frame_idx rows between 2 preceding and current row) = 1 as onset from v_bio""")  # fmt: skip
def ws15(spark, sf):
    return seq.onset_band(v_bio(spark, sf), "y", 3).select("sample_id", "frame_idx", "onset")


STARTUP = """
    with b as (select *, min(case when h2 then 1 else 0 end) over w as least, count(*) over w as n from v_frames window w as (partition by sample_id order by frame_idx rows between 2 preceding and current row)),
    s as (select *, min(case when least = 1 and n = 3 then frame_idx - 2 end) over (partition by sample_id) as first_visible from b)
"""


@query("ws16_startup_prefix", STARTUP + """ select sample_id, frame_idx, first_visible, first_visible is null or frame_idx < first_visible as startup from s""")
def ws16(spark, sf):
    return seq.startup_prefix(v_frames(spark, sf), "h2", 3).select("sample_id", "frame_idx", "first_visible", "startup")


@query("ws18_best_motion_window", """
    with s as (select *, round(sum(x) over w, 9) as total, count(*) over w as held from v_frames window w as (partition by sample_id order by frame_idx rows between current row and 7 following)),
    m as (select *, max(held) over (partition by sample_id) as most from s)
    select sample_id, arg_max(frame_idx, (total, -frame_idx)) as "start", max(total) as total from m where held = most group by sample_id""")  # fmt: skip
def ws18(spark, sf):
    return seq.best_window(v_frames(spark, sf), F.col("x"), 8)


@query("ws17_coverage_ladder", """
    with t as (select * from (values (0, 0.6), (1, 0.4), (2, 0.2)) t(step, thr)),
    s as (select sample_id, frame_idx, step, thr, sum(case when score >= thr then 1 else 0 end) over w as valid, count(*) over w as held from v_frames, t window w as (partition by sample_id, step order by frame_idx rows between current row and 7 following)),
    m as (select *, max(held) over (partition by sample_id, step) as most from s),
    b as (select sample_id, step, thr, arg_max(frame_idx, (valid, -frame_idx)) as "start", max(valid) as valid, max(held) as held from m where held = most group by all),
    r as (select *, row_number() over (partition by sample_id order by valid >= 0.75 * held desc, case when valid >= 0.75 * held then -step else valid end desc, step) as rn from b)
    select sample_id, step, cast(thr as double) as thr, "start", cast(valid as bigint) as valid from r where rn = 1""")  # fmt: skip
def ws17(spark, sf):
    return seq.coverage_ladder(v_frames(spark, sf), "score", (0.6, 0.4, 0.2), 8, 0.75)


@query("ws19_tune_threshold", """
    with t as (select unnest([0.1, 0.3, 0.5, 0.7]) as thr), c as (select sample_id, thr, avg(case when score >= thr then 1.0 else 0.0 end) as coverage from v_frames, t group by all)
    select sample_id, cast(arg_max(thr, (coverage, thr)) as double) as thr, round(max(coverage), 9) as coverage from c group by sample_id""")  # fmt: skip
def ws19(spark, sf):
    return seq.tune_threshold(v_frames(spark, sf), "score", (0.1, 0.3, 0.5, 0.7)).withColumn("coverage", F.round("coverage", 9))


@query("ws20_fill_gaps", """
    with a as (select *, last_value(case when h2 then frame_idx end ignore nulls) over b as p, last_value(case when h2 then x end ignore nulls) over b as px,
                      first_value(case when h2 then frame_idx end ignore nulls) over n as q, first_value(case when h2 then x end ignore nulls) over n as qx
               from v_frames window b as (partition by sample_id order by frame_idx rows between unbounded preceding and current row), n as (partition by sample_id order by frame_idx rows between current row and unbounded following))
    select sample_id, frame_idx, round(case when h2 then x when q - p - 1 <= 3 then px + (qx - px) * (frame_idx - p) / (q - p) end, 6) as filled,
           case when h2 then 'observed' when q - p - 1 <= 3 then 'interp' else 'missing' end as source from a""")  # fmt: skip
def ws20(spark, sf):
    f = seq.fill_gaps(v_frames(spark, sf), "x", F.col("h2"), 3)
    return f.select("sample_id", "frame_idx", F.round("filled", 6).alias("filled"), "source")


@query("ws26_continuous_stats", """
    with m as (select *, abs(x - lag(x) over (partition by sample_id order by frame_idx)) as step from v_frames),
    f as (select *, h2 as on_, coalesce(step < 10, false) as still from m),
    r as (select *, row_number() over (partition by sample_id order by frame_idx) as rn, row_number() over (partition by sample_id, on_ order by frame_idx) as a, row_number() over (partition by sample_id, still order by frame_idx) as b from f),
    h as (select sample_id, on_, rn - a as i, count(*) as n from r group by all), s as (select sample_id, rn - b as i, count(*) as n from r where still group by all),
    g as (select sample_id, avg(step) as mean_step, coalesce(min(case when h2 then frame_idx end), count(*)) as gap from m group by sample_id)
    select g.sample_id, round(mean_step, 6) as mean_step, cast(gap as integer) as startup_gap, coalesce((select max(n) from h where h.sample_id = g.sample_id and on_), 0) as hand_run,
           coalesce((select max(n) from h where h.sample_id = g.sample_id and not on_), 0) as no_hand_run, coalesce((select max(n) from s where s.sample_id = g.sample_id), 0) as still_run from g""")  # fmt: skip
def ws26(spark, sf):
    return seq.clip_runs(v_frames(spark, sf), "h2", "x", 10.0).withColumn("mean_step", F.round("mean_step", 6))


@query("ws27_chunk_intervals", """
    with s as (select distinct attachment_id || '_' || row_num as seg_uid, "begin" as b, "end" as e from v_ann where "end" > "begin"),
    c as (select seg_uid, e, unnest(generate_series(b, e - 16, 8)) as pos from s where e - b >= 16
          union select seg_uid, e, e - 16 from s where e - b >= 16 and (e - b - 16) % 8 <> 0 union select seg_uid, e, b from s where e - b < 16 and e - b >= 4)
    select distinct seg_uid || '_' || pos || '_' || least(pos + 16, e) as chunk_uid, cast(pos as integer) as chunk_start, cast(least(pos + 16, e) as integer) as chunk_end from c""")  # fmt: skip
def ws27(spark, sf):
    s = v_ann(spark, sf).where("end > begin").select(F.concat_ws("_", "attachment_id", "row_num").alias("seg_uid"), F.col("begin").alias("start"), "end").distinct()
    return seq.chunk_intervals(s, 16, 8, least=4).select("chunk_uid", "chunk_start", "chunk_end")


@query("ws30_extract_tails", ACTIVE + """
    , i as (select sample_id as vid, "start", "end", count(*) as t from seg join v_frames using (sample_id) group by all)
    select vid, role, s as "start", e as "end", e - s as length from (select vid, 'pre' as role, 0 as s, cast("start" as bigint) as e from i union all select vid, 'post', "end" + 1, t from i) where e - s >= 3""")  # fmt: skip
def ws30(spark, sf):
    n = v_frames(spark, sf).groupBy("sample_id").agg(F.count("*").alias("t_total"))
    i = active(spark, sf).join(n, "sample_id").select(F.col("sample_id").alias("vid"), F.col("start").alias("start_idx"), F.col("end").alias("end_idx"), "t_total")
    return seq.extract_tails(i, 3)


@query("ws32_occlusion_hold", """
    select sample_id, frame_idx, max(case when occ then 1 else 0 end) over (partition by sample_id order by frame_idx rows between 3 preceding and current row) = 1 as held from v_frames""")  # fmt: skip
def ws32(spark, sf):
    return seq.occlusion_hold(v_frames(spark, sf), F.col("occ"), 4).select("sample_id", "frame_idx", "held")


@query("jn8_anchor_asof", """
    select sample_id, frame_idx, last_value(case when h1 and h2 then frame_idx end ignore nulls) over (partition by sample_id order by frame_idx rows between unbounded preceding and current row) as prev_at,
           first_value(case when h1 and h2 then frame_idx end ignore nulls) over (partition by sample_id order by frame_idx rows between current row and unbounded following) as next_at from v_frames""")  # fmt: skip
def jn8(spark, sf):
    a = seq.anchors(v_frames(spark, sf), F.col("h1") & F.col("h2"), "x")
    return a.select("sample_id", "frame_idx", F.col("prev.at").alias("prev_at"), F.col("next.at").alias("next_at"))
