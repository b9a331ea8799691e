"""Row validation and column clean-up over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean
from ..operators import rows
from ..sources import files
from .registry import query
from .views import shared_path, table, v_ann, v_frames, v_videos


@query("pf1_ids", r"""
    select page_id, regexp_replace(regexp_extract(url, '([^/\\]*)[/\\]*$', 1), '(.)\.[^.]*$', '\1') as stem, nullif(regexp_replace(trim(url), '[/\\]', '__', 'g'), '') as id,
           coalesce(nullif(left(regexp_replace(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 80), ''), 'sample') as slug from pages""")  # fmt: skip
def pf1(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", clean.path_stem(u).alias("stem"), clean.normalize_id(u).alias("id"), clean.slugify(u).alias("slug"))


@query("pf2_stable_id", "select event_id, left(sha1(event_type || '|' || user_id), 12) as id from events")
def pf2(spark, sf):
    return table(spark, sf, "events").select("event_id", clean.stable_id([F.col("event_type"), F.col("user_id").cast("string")]).alias("id"))


@query("pf3_normalize_split", "select c_custkey, case lower(trim(c_mktsegment)) when 'machinery' then 'machinery' else lower(trim(c_mktsegment)) end as split from customer")
def pf3(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clean.normalize_split(F.col("c_mktsegment")).alias("split"))


@query("pf4_parse_bool", """
    select doc_id, case when w in ('1','true','t','yes','y','train') then true when w in ('0','false','f','no','n','val','test') then false end as flag
    from (select doc_id, lower(trim(split_part(lang, '-', 1))) as l, case doc_id % 5 when 0 then 'Yes ' when 1 then ' no' when 2 then 'TRAIN' when 3 then '0' else lang end as r from documents) q, lateral (select lower(trim(r)) as w) x""")  # fmt: skip
def pf4(spark, sf):
    raw = F.expr("case doc_id % 5 when 0 then 'Yes ' when 1 then ' no' when 2 then 'TRAIN' when 3 then '0' else lang end")
    return table(spark, sf, "documents").select("doc_id", clean.parse_bool(raw).alias("flag"))


@query("pf5_resolve_split", """
    select row_num, case when split <> '' then split when row_num % 3 = 0 then 'train' when row_num % 3 = 1 then 'val' else 'holdout' end as split from v_ann""")  # fmt: skip
def pf5(spark, sf):
    train = F.expr("case row_num % 3 when 0 then 'True' when 1 then '0' else 'Holdout' end")
    return v_ann(spark, sf).select("row_num", clean.resolve_split(F.col("split"), train).alias("split"))


@query("pf6_parse_int", """
    select event_id, case when event_id % 4 = 3 then null when event_id % 4 = 2 then null else cast(trunc(value * case event_id % 4 when 1 then -1 else 1 end) as integer) end as n from events""")  # fmt: skip
def pf6(spark, sf):
    raw = F.expr("case event_id % 4 when 3 then 'bad' when 2 then ' ' when 1 then concat(' -', cast(value as string)) else cast(value as string) end")
    return table(spark, sf, "events").select("event_id", clean.parse_int(raw).alias("n"))


@query("pf7_identity", """
    select row_num, case when row_num % 3 = 0 then signer when row_num % 3 = 1 then 'u' || label else attachment_id end as signer from v_ann""")  # fmt: skip
def pf7(spark, sf):
    a = F.expr("case when row_num % 3 = 0 then signer else ' ' end")
    b = F.expr("case when row_num % 3 = 1 then concat('u', label) end")
    return v_ann(spark, sf).select("row_num", clean.resolve_identity([a, b], F.concat(F.lit("clips/"), "attachment_id", F.lit(".mp4"))).alias("signer"))


ANN = """
    with j as (select *, case when split = '' then 'missing_split_value' when "begin" < 0 or "end" < 0 then 'negative_clip_bounds' when "end" <= "begin" then 'invalid_clip_range' end as r from v_ann),
    d as (select *, row_number() over (partition by attachment_id, r is null order by row_num) as n from j), judged as (select *, case when r is null and n > 1 then 'duplicate_sample_id' else r end as reason from d)
"""


@query("pf9_validate_annotations", ANN + " select row_num, attachment_id, reason from judged")
def pf9(spark, sf):
    return rows.validate_annotations(v_ann(spark, sf)).select("row_num", "attachment_id", "reason")


@query("pf10_validate_segments", """select attachment_id || '_' || row_num as seg_uid, case when "begin" < 0 then 'negative start' when "end" <= "begin" then 'empty range' end as error from v_ann""")
def pf10(spark, sf):
    s = v_ann(spark, sf).select(F.col("attachment_id").alias("Video_ID"), F.concat_ws("_", "attachment_id", "row_num").alias("SEG_UID"), F.col("begin").alias("Start"), F.col("end").alias("End"))
    return rows.validate_segments(s).select("seg_uid", "error")


@query("pf11_half_open", """select row_num, case when "begin" >= 1 and "end" > "begin" - 1 then "begin" - 1 end as s, case when "begin" >= 1 and "end" > "begin" - 1 then "end" end as e from v_ann""")
def pf11(spark, sf):
    s, e = clean.interval_to_half_open(F.col("begin"), F.col("end"), "one_based_inclusive")
    return v_ann(spark, sf).select("row_num", s.alias("s"), e.alias("e"))


@query("pf12_clamp_clip", """
    with t as (select row_num, "begin" as b, "end" as e, cast(row_num % 60 + 5 as integer) as n from v_ann), l as (select *, least(greatest(e - b, 0), n) as len from t)
    select row_num, greatest(least(b, n - len), 0) as s, greatest(least(b, n - len), 0) + len as e from l""")  # fmt: skip
def pf12(spark, sf):
    s, e = clean.clamp_clip(F.col("begin"), F.col("end"), (F.col("row_num") % 60 + 5).cast("int"))
    return v_ann(spark, sf).select("row_num", s.alias("s"), e.alias("e"))


@query("pf13_label_filter", "select row_num, label from v_ann where label in ('RF', 'AF')")
def pf13(spark, sf):
    return rows.label_filter(v_ann(spark, sf), "label", ("RF", "AF")).select("row_num", "label")


@query("pf14_segment_length", """select row_num, "end" - "begin" + 1 as length from v_ann where "end" - "begin" + 1 > 0""")
def pf14(spark, sf):
    return rows.segment_lengths(v_ann(spark, sf), "begin", "end", False).select("row_num", "length")


@query("pf16_flatten_frame", "select event_id, case when h1 then x end as hand_1_x, case when h1 then score end as hand_1_score, case when h2 then x end as hand_2_x, h1 as hand1_present, h2 as hand2_present, h1 and h2 as both_hands from v_frames")
def pf16(spark, sf):
    f = v_frames(spark, sf).select("event_id", F.when(F.col("h1"), F.struct("x", "score")).alias("hand_1"), F.when(F.col("h2"), F.struct("x")).alias("hand_2"))
    return rows.flatten_frame(f)


@query("pf17_score_gate", "select event_id, case when h1 then case when event_type = 'view' then 1.0 else score end end as score from v_frames")
def pf17(spark, sf):
    src = F.when(F.col("event_type") == "view", "presence").otherwise("score")
    return v_frames(spark, sf).select("event_id", clean.score_gate(F.col("score"), F.col("h1"), src).alias("score"))


SOURCE = "case event_type when 'click' then 'occluded' when 'view' then 'tracked' when 'signup' then 'pass1' else 'pass2' end"


@query("pf18_pf19_states", f"""
    with s as (select event_id, h1, score, {SOURCE} as source from v_frames), t as (select *, case when not h1 then 'missing' when source = 'occluded' then 'occluded' when source = 'tracked' then 'predicted' else 'observed' end as state from s)
    select event_id, state, h1 and source in ('pass1', 'pass2') and score >= 0.4 as anchor, not h1 or source in ('tracked', 'occluded', 'hold') or state <> 'observed' as replace from t""")  # fmt: skip
def pf18(spark, sf):
    src, h1 = F.expr(SOURCE), F.col("h1")
    state = clean.hand_state(h1, src)
    return v_frames(spark, sf).select("event_id", state.alias("state"), clean.is_anchor(h1, F.col("score"), src, F.lit(False), 0.4).alias("anchor"), clean.should_replace(h1, src, state).alias("replace"))


@query("pf20_append_reason", "select event_id, nullif(concat_ws('; ', case when h1 then null else 'no_hand' end, case when occ then 'occluded' end), '') as reason from v_frames")
def pf20(spark, sf):
    return v_frames(spark, sf).select("event_id", clean.append_reason(F.when(F.col("h1"), "").otherwise("no_hand"), F.when(F.col("occ"), "occluded")).alias("reason"))


@query("pf21_frame_warnings", "select sample_id, list_filter([case when hand2 / frames <= 0.55 then 'few_hands' end, case when quality <= 0.4 then 'low_pose' end, case when swaps > 13 then 'guarded' end], lambda x: x is not null) as warnings from v_videos")
def pf21(spark, sf):
    return v_videos(spark, sf).select("sample_id", clean.frame_warnings(F.col("hand2") / F.col("frames"), F.col("quality"), F.col("swaps") > 13, 0.55, 0.4).alias("warnings"))


@query("pf22_manifest_annotations", """select distinct attachment_id, 'no_event' as text, 0 as "begin", 0 as "end", split from v_ann where split = 'val' and attachment_id in (select cast(o_orderkey as varchar) from orders where o_orderkey % 2 = 0)""")
def pf22(spark, sf):
    files = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("sample_id"))
    return rows.manifest_to_annotations(v_ann(spark, sf).select(F.col("attachment_id").alias("sample_id"), "split").distinct(), files, "val")


@query("pf23_round_metrics", "select sample_id, round_even(quality, 3) as quality, delta from v_videos")
def pf23(spark, sf):
    return clean.round_metrics(v_videos(spark, sf).select("sample_id", "quality", "delta"), {"quality": 3})


PATHS = "select 'raw/' || o_custkey || case when o_orderkey % 2 = 0 then '_pp' else '' end || '.json' as path from orders"
BEST = f"""with f as ({PATHS}), t as (select distinct path, replace(replace(split_part(path, '/', 2), '.json', ''), '_pp', '') as id, case when path like '%\\_pp.json' escape '\\' then 'pp' else 'raw' end as variant from f),
    r as (select *, row_number() over (partition by id order by variant <> 'pp', path) as n from t), best as (select id, path, variant from r where n = 1)"""


def files_of(spark, sf):
    path = F.expr("concat('raw/', o_custkey, case when o_orderkey % 2 = 0 then '_pp' else '' end, '.json')")
    return table(spark, sf, "orders").select(path.alias("path"))


@query("io6_resolve_variant", BEST + " select id, path, variant from best")
def io6(spark, sf):
    return rows.resolve_variant(files_of(spark, sf))


@query("pf24_background_clips", BEST + """ , m as (select cast(c_custkey as varchar) as sample_id from customer where c_custkey % 3 = 1)
    select sample_id, 'no_event' as label_str, path, true as is_no_event, path is null as missing from m left join best on id = sample_id""")  # fmt: skip
def pf24(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.expr("case c_custkey % 3 when 1 then ' Test' else 'train' end").alias("split"))
    return rows.background_clips(m, files_of(spark, sf), "val")


def artifact(spark, sf):
    root = shared_path(spark, "artifact")
    f = v_frames(spark, sf).select("sample_id", "frame_idx", "ts_ms", "x")
    files.write_artifact(v_videos(spark, sf), f, f.select("sample_id", F.lit("raw").alias("variant"), "frame_idx"), root)
    return root


@query("io7_read_sample", "select frame_idx, ts_ms, x, v.frames from v_frames join v_videos v using (sample_id) where sample_id = 7")
def io7(spark, sf):
    video, frames = files.read_sample(spark, artifact(spark, sf), 7)
    return frames.join(video.select("sample_id", "frames"), "sample_id").select("frame_idx", "ts_ms", "x", "frames")


@query("io8_sample_catalog", "select sample_id, frames, quality from v_videos")
def io8(spark, sf):
    return files.sample_catalog(spark, artifact(spark, sf))


@query("io9_conform_schema", "select sample_id, cast(frames as integer) as frames, cast(null as varchar) as signer from v_videos")
def io9(spark, sf):
    schema = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("frames", T.IntegerType()), T.StructField("signer", T.StringType())])
    return rows.conform_schema(v_videos(spark, sf).select("sample_id", "frames"), schema)


@query("io11_upsert", "select sample_id, case when sample_id % 4 = 0 then frames + 1 else frames end as frames from v_videos")
def io11(spark, sf):
    v = v_videos(spark, sf).select("sample_id", "frames")
    return rows.upsert_by_key(v, v.where("sample_id % 4 = 0").withColumn("frames", F.col("frames") + 1), "sample_id")


@query("io12_append_run", "select 'r0' as run_id, cast(1 as bigint) as processed, cast(0 as bigint) as failed, cast(1 as bigint) as scheduled union all select 'r1', count(*), 3, count(*) + 3 from v_videos")
def io12(spark, sf):
    ledger = v_videos(spark, sf).agg(F.lit("r0").alias("run_id"), F.lit(1).cast("long").alias("processed"), F.lit(0).cast("long").alias("failed"), F.lit(1).cast("long").alias("scheduled"))
    return rows.append_run(ledger, v_videos(spark, sf), 3, "r1")


@query("io14_sharded_vectors", "with r as (select vec_id, (row_number() over (order by vec_id) - 1) // 64 as shard from embeddings) select shard, min(vec_id) as \"start\", max(vec_id) as \"end\", count(*) as rows from r group by shard")
def io14(spark, sf):
    return rows.shard_manifest(rows.shard_ranges(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 64), "vec_id")


@query("io15_hash_shard", "select c_custkey, cast(('0x' || left(sha1(cast(c_custkey as varchar)), 16))::ubigint % 7 as integer) as shard from customer")
def io15(spark, sf):
    return rows.hash_shard(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 7)


@query("io16_merge_shards", "select sample_id, frames, cast(sample_id % 3 as integer) as _shard from v_videos")
def io16(spark, sf):
    v = v_videos(spark, sf).select("sample_id", "frames")
    return rows.merge_shards([v.where(f"sample_id % 3 = {i}") for i in range(3)], "sample_id")


@query("io17_gloss_annotations", "select 'dev__' || c_custkey as attachment_id, c_mktsegment as text, case when c_custkey % 2 = 0 then 'val' else 'train' end as split, c_custkey % 2 <> 0 as train, case when c_custkey % 2 <> 0 then 'split_mismatch' end as reason from customer")
def io17(spark, sf):
    r = table(spark, sf, "customer").select(F.expr("concat('dev/', c_custkey)").alias("name"), F.expr("case when c_custkey % 2 = 0 then 'Dev' else 'train' end").alias("split"), F.col("c_mktsegment").alias("gloss"))
    return rows.gloss_annotations(r)


@query("io20_timeline", "select event_id as segment_id, frame_idx as \"start\", frame_idx + 3 as \"end\", event_type as label, score as conf, score > 0.5 as accepted, case when score <= 0.5 then 'low_confidence' end as reason from v_frames")
def io20(spark, sf):
    d = F.struct(F.col("event_type").alias("label"), F.col("score").alias("conf"), (F.col("score") > 0.5).alias("accepted"), F.when(F.col("score") <= 0.5, "low_confidence").alias("reason"))
    return rows.timeline(v_frames(spark, sf).select(F.col("event_id").alias("segment_id"), F.col("frame_idx").alias("start"), (F.col("frame_idx") + 3).alias("end"), d.alias("decision")))
