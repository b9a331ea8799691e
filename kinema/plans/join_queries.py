"""Joins, set operations, top rows and splits over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, seq, sets
from .agg_queries import rounded
from .registry import query
from .seq_queries import TAGS
from .views import table, v_ann, v_bio, v_frames, v_videos


def segs(spark, sf):
    return seq.bio_segments(v_bio(spark, sf), "y").withColumn("seg", F.col("start"))


def preds_of(spark, sf):
    return seq.bio_segments(v_bio(spark, sf), "p")


SEGS = TAGS + """, s as (select sample_id, "start", "end", "start" as seg from g where "start" is not null) """
BOTH = """
    with o as (select *, sum(case when y <> 2 then 1 else 0 end) over w as iy, sum(case when p <> 2 then 1 else 0 end) over w as ip from v_bio window w as (partition by sample_id order by frame_idx rows unbounded preceding)),
    t as (select sample_id, min(case when y = 1 then frame_idx end) as s, max(case when y <> 0 then frame_idx end) as e from o group by sample_id, iy having s is not null),
    q as (select sample_id, min(case when p = 1 then frame_idx end) as s, max(case when p <> 0 then frame_idx end) as e from o group by sample_id, ip having s is not null)
"""


@query("jn1_join_labels", "select o_orderkey as sample_id, o_totalprice, label, row_num from orders join v_ann on attachment_id = cast(o_orderkey as varchar)")
def jn1(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), "o_totalprice")
    return joins.join_labels(o, v_ann(spark, sf)).select(F.col("sample_id").cast("long").alias("sample_id"), "o_totalprice", "label", "row_num")


@query("jn2_skip_ids", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def jn2(spark, sf):
    skip = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.skip_ids(table(spark, sf, "orders"), skip, "o_custkey").select("o_orderkey")


@query("jn2_only_ids", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def jn2_only(spark, sf):
    keep = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.only_ids(table(spark, sf, "orders"), keep, "o_custkey").select("o_orderkey")


@query("jn3_skip_committed", "select sample_id from v_videos v where not (sample_id % 3 <> 0 and frames = (select count(*) from v_frames f where f.sample_id = v.sample_id and (f.sample_id % 5 <> 1 or frame_idx > 0)))")
def jn3(spark, sf):
    v = v_videos(spark, sf)
    return joins.skip_committed(v.select("sample_id"), v, v_frames(spark, sf).where("sample_id % 5 <> 1 or frame_idx > 0"), v.where("sample_id % 3 <> 0"))


@query("jn4_resolve_name_stem", """
    with f as (select 'd' || (c_nationkey % 3) || '/Clip' || (c_custkey % 700) || case when c_custkey % 2 = 0 then '.mp4' else '.avi' end as path from customer),
    n as (select lower(split_part(path, '/', 2)) as k, min(path) as path, count(*) as n from f group by 1), s as (select split_part(lower(split_part(path, '/', 2)), '.', 1) as k, min(path) as path, count(*) as n from f group by 1),
    r as (select distinct 'clip' || (o_orderkey % 800) || '.MP4' as ref from orders)
    select ref, coalesce(n.path, s.path) as path, case when n.path is not null then 'name' when s.path is not null then 'stem' else 'missing' end as how, coalesce(n.n, s.n, 0) > 1 as ambiguous
    from r left join n on n.k = lower(ref) left join s on s.k = split_part(lower(ref), '.', 1)""")  # fmt: skip
def jn4(spark, sf):
    f = table(spark, sf, "customer").select(F.expr("concat('d', c_nationkey % 3, '/Clip', c_custkey % 700, case when c_custkey % 2 = 0 then '.mp4' else '.avi' end)").alias("path"))
    r = table(spark, sf, "orders").select(F.expr("concat('clip', o_orderkey % 800, '.MP4')").alias("ref")).distinct()
    return joins.resolve_by_name_then_stem(r, f)


@query("jn5_segments_predictions", "select o_orderkey as segment_id, coalesce(l_returnflag, '') as label, coalesce(l_quantity, 0.0) as conf, coalesce(l_quantity > 25, false) as accepted from orders left join (select * from lineitem where l_linenumber = 1) on l_orderkey = o_orderkey")
def jn5(spark, sf):
    p = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("segment_id"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("conf"), (F.col("l_quantity") > 25).alias("accepted"))
    return joins.segments_with_predictions(table(spark, sf, "orders").select(F.col("o_orderkey").alias("segment_id")), p)


@query("jn6_frames_in_segments", SEGS + """ select f.sample_id, frame_idx, max(seg) as seg from v_frames f left join s on s.sample_id = f.sample_id and frame_idx >= "start" and frame_idx < "end" group by all""")
def jn6(spark, sf):
    return joins.frames_in_segments(v_frames(spark, sf), segs(spark, sf))


@query("jn7_clip_with_context", SEGS + """ select f.sample_id, seg, min(frame_idx) as clip_start, max(frame_idx) as clip_end, list(x order by frame_idx) as clip from v_frames f join s on s.sample_id = f.sample_id and frame_idx >= "start" - 2 and frame_idx < "end" + 3 group by all""")
def jn7(spark, sf):
    return joins.clip_with_context(v_frames(spark, sf), segs(spark, sf), "x", 2, 3)


@query("jn9_nearest_key", "select sample_id, frames from v_videos where sample_id = (select arg_min(sample_id, (abs(sample_id - 66.5), sample_id)) from v_videos)")
def jn9(spark, sf):
    return joins.nearest_key(v_videos(spark, sf).select("sample_id", "frames"), "sample_id", 66.5)


@query("jn10_boundary_error", "select t.sample_id, t.frame_idx, min(abs(t.frame_idx - q.frame_idx)) as error from v_bio t left join v_bio q on q.sample_id = t.sample_id and q.p = 1 where t.y = 1 group by all")
def jn10(spark, sf):
    return joins.nearest_boundary_error(v_bio(spark, sf), "y", "p")


@query("jn12_segment_overlap", BOTH + " select t.sample_id, coalesce(bool_or(greatest(t.s, q.s) <= least(t.e, q.e)), false) as hit, coalesce(bool_or(abs(t.s - q.s) <= 1), false) as start_covered from t left join q using (sample_id) group by t.sample_id")
def jn12(spark, sf):
    return joins.segment_overlap(segs(spark, sf), preds_of(spark, sf), 1)


@query("jn14_compare_runs", """
    with a as (select sample_id, quality, delta from v_videos where sample_id % 5 <> 0), b as (select sample_id, quality * 1.1 as quality, delta - sample_id as delta from v_videos where sample_id % 7 <> 0),
    l as (select unnest(['quality', 'delta']) as metric, unnest([a.quality, a.delta]) as va, unnest([b.quality, b.delta]) as vb from a join b using (sample_id))
    select metric, count(*) as n, round(avg(va), 6) as mean_a, round(avg(vb), 6) as mean_b, round(avg(vb - va), 6) as delta, round(avg(vb - va) / abs(avg(va)), 6) as relative from l group by metric""")  # fmt: skip
def jn14(spark, sf):
    v = v_videos(spark, sf)
    b = v.where("sample_id % 7 <> 0").select("sample_id", (F.col("quality") * 1.1).alias("quality"), (F.col("delta") - F.col("sample_id")).alias("delta"))
    return rounded(joins.compare_runs(v.where("sample_id % 5 <> 0"), b, ["quality", "delta"]), "mean_a", "mean_b", "delta", "relative")


@query("jn15_parity_check", """
    with a as (select * from v_videos where sample_id % 11 <> 0), b as (select sample_id, frames + case when sample_id % 8 = 0 then 1 else 0 end as frames, delta * case when sample_id % 6 = 0 then 1.01 else 1 end as delta from v_videos where sample_id % 13 <> 0)
    select coalesce(a.sample_id, b.sample_id) as sample_id, unnest(list_filter([case when a.sample_id is null then 'missing in a' end, case when b.sample_id is null then 'missing in b' end, case when a.frames <> b.frames then 'frames' end, case when abs(a.delta - b.delta) > 0.001 * greatest(1, a.delta, b.delta) then 'delta' end], lambda x: x is not null)) as finding from a full join b using (sample_id)""")  # fmt: skip
def jn15(spark, sf):
    v = v_videos(spark, sf)
    b = v.where("sample_id % 13 <> 0").select("sample_id", F.expr("frames + case when sample_id % 8 = 0 then 1 else 0 end").alias("frames"), F.expr("delta * case when sample_id % 6 = 0 then 1.01D else 1D end").alias("delta"))
    return joins.parity_check(v.where("sample_id % 11 <> 0"), b, ["frames"], ["delta"], 0.001)


@query("jn16_variant_diff", "select sample_id, frame_idx, not h1 and (h1 or event_type = 'error' and frame_idx % 2 = 0) as filled from v_frames where (event_type = 'error' and frame_idx % 2 = 0) or (h1 and frame_idx % 5 = 0 and x * 0.01 > 0.5)")
def jn16(spark, sf):
    f = v_frames(spark, sf)
    pp = f.select("sample_id", "frame_idx", F.expr("x * case when frame_idx % 5 = 0 then 1.01D else 1D end").alias("x"), F.expr("h1 or (event_type = 'error' and frame_idx % 2 = 0)").alias("h1"))
    return joins.variant_diff(f, pp, "x", "h1", 0.5)


@query("jn17_family_lookup", "select vec_id, cast(label // 3 as integer) as family from embeddings")
def jn17(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return joins.family_lookup(e, e.select("label", F.expr("cast(label div 3 as int)").alias("family")).distinct()).select("vec_id", "family")


@query("jn18_late_drops", """
    with h as (select l_suppkey as label, l_linenumber as epoch, avg(l_quantity) / 50 as f1 from lineitem group by all), p as (select label, max(f1) as peak from h group by label)
    select label, round(f1, 6) as f1, round(peak, 6) as peak, round(f1 - peak, 6) as "drop" from h join p using (label) where epoch = 4 order by f1 - peak, label limit 10""")  # fmt: skip
def jn18(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("label"), F.col("l_linenumber").alias("epoch")).agg((F.avg("l_quantity") / 50).alias("f1"))
    return rounded(joins.late_drops(h, 4, 10), "f1", "peak", "drop")


@query("jn19_low_score_samples", "with r as (select label from v_ann group by label having avg(\"end\" - \"begin\") <= 20.4) select split, list(distinct cast(row_num % 1000 as bigint) order by cast(row_num % 1000 as bigint)) as ids from v_ann where label in (select label from r) group by split")
def jn19(spark, sf):
    a = v_ann(spark, sf).withColumn("sample_id", (F.col("row_num") % 1000).cast("long"))
    return joins.low_score_samples(a.groupBy("label").agg(F.avg(F.col("end") - F.col("begin")).alias("f1")), a, 20.4)


@query("jn20_clean_manifest", """
    with q as (select sample_id, quality as score, case when swaps > 14 then 'WEAK' else 'OK' end as bucket from v_videos where sample_id % 4 <> 0), r as (select sample_id, score, bucket, case when sample_id % 3 = 0 then 'val' else 'train' end as split from q where bucket = 'OK' and score >= 0.4),
    k as (select *, row_number() over (partition by split order by score desc, sample_id) as rank from r) select sample_id, score, split, cast(rank as integer) as rank from k where rank <= 20""")  # fmt: skip
def jn20(spark, sf):
    v = v_videos(spark, sf)
    q = v.select("sample_id", F.col("quality").alias("score"), F.when(F.col("swaps") > 14, "WEAK").otherwise("OK").alias("bucket"))
    m = v.where("sample_id % 4 <> 0").select("sample_id", F.expr("case when sample_id % 3 = 0 then 'val' else 'train' end").alias("split"))
    return joins.clean_manifest(q, m, ["OK"], 0.4, 20, "split").select("sample_id", "score", "split", "rank")


@query("so1_union_sources", "select source, count(*) as n, count(label) as labels from (select 'ann' as source, row_num, label from v_ann union all select 'orders', o_orderkey, null from orders) group by source")
def so1(spark, sf):
    u = sets.union_sources({"ann": v_ann(spark, sf).select("row_num", "label"), "orders": table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_num"))}, "row_num")
    return u.groupBy("source").agg(F.count("*").alias("n"), F.count("label").alias("labels"))


@query("so2_split_overlap", "with b as (select signer from v_ann where split = 'train' intersect select signer from v_ann where split = 'val') select count(*) as overlap_count, (list(signer order by signer))[1:10] as examples, count(*) = 0 as ok from b")
def so2(spark, sf):
    a = v_ann(spark, sf)
    return sets.split_overlap(a.where("split = 'train'"), a.where("split = 'val'"), "signer")


@query("so3_multi_split_keys", "select attachment_id, list(distinct split order by split) as splits from v_ann group by attachment_id having count(distinct split) > 1")
def so3(spark, sf):
    return sets.multi_split_keys(v_ann(spark, sf), "attachment_id")


@query("so4_id_difference", "with a as (select distinct o_custkey from orders), b as (select c_custkey from customer where c_custkey % 2 = 0) select o_custkey, 'a' as side from a where o_custkey not in (select * from b) union all select c_custkey, 'b' from b where c_custkey not in (select * from a)")
def so4(spark, sf):
    b = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return sets.id_difference(table(spark, sf, "orders"), b, "o_custkey")


@query("so5_distinct_keep", "select attachment_id, min(row_num) as row_num from v_ann group by attachment_id")
def so5(spark, sf):
    return sets.distinct_keep(v_ann(spark, sf), "attachment_id", "row_num").select("attachment_id", "row_num")


@query("so6_label_index", "with i as (select label, row_number() over (order by label) - 1 as k from (select distinct label from v_ann)) select label, cast(k as integer) as \"index\", count(*) as n from v_ann join i using (label) group by all")
def so6(spark, sf):
    a = v_ann(spark, sf)
    return sets.apply_label_index(a, sets.label_index(a, "label"), "label").groupBy("label", "index").agg(F.count("*").alias("n"))


@query("tk1_top_k", "select sample_id, frame_idx, x, cast(rank as integer) as rank from (select *, row_number() over (partition by sample_id order by x desc, frame_idx) as rank from v_frames) where rank <= 3")
def tk1(spark, sf):
    return sets.top_k(v_frames(spark, sf), [F.desc("x"), F.asc("frame_idx")], 3, ["sample_id"]).select("sample_id", "frame_idx", "x", "rank")


@query("tk3_hard_examples", """select row_num as id, label as "true", 'RF' as pred, "end" / 100 as conf, "end" - "begin" as margin from v_ann where label <> 'RF' order by "end" desc, "end" - "begin" desc, row_num limit 50""")
def tk3(spark, sf):
    p = v_ann(spark, sf).select(F.col("row_num").alias("id"), F.col("label").alias("true"), F.lit("RF").alias("pred"), (F.col("end") / 100).alias("conf"), (F.col("end") - F.col("begin")).alias("margin"))
    return sets.hard_examples(p, 50)


@query("tk4_ordered_output", "select attachment_id, row_num from v_ann where split = 'val'")
def tk4(spark, sf):
    return sets.ordered_output(v_ann(spark, sf).where("split = 'val'").select("attachment_id", "row_num"), ["attachment_id", "row_num"])


@query("tk5_sample_n", "select o_orderkey from orders order by md5(o_orderkey || '|7'), o_orderkey limit 100")
def tk5(spark, sf):
    return sets.sample_n(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


@query("tk6_stratified_folds", "select vec_id, cast((row_number() over (partition by label order by vec_id) - 1) % 5 as integer) as fold from embeddings")
def tk6(spark, sf):
    return sets.stratified_folds(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 5).select("vec_id", "fold")


@query("tk7_disjoint_split")
def tk7(spark, sf):
    return sets.disjoint_split(v_ann(spark, sf)).groupBy("signer", "new_split").agg(F.count("*").alias("n"))


@query("tk9_balanced_pick", "select signer, count(*) as n from (select signer, row_num, row_number() over (partition by signer order by md5(row_num || '|3'), row_num) as turn from v_ann order by turn, md5(signer || '|3'), row_num limit 1000) group by signer")
def tk9(spark, sf):
    return sets.balanced_pick(v_ann(spark, sf).select("signer", "row_num"), 1000, "signer", "row_num", 3).groupBy("signer").agg(F.count("*").alias("n"))
