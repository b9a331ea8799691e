"""Readers, writers and stream operators over files that Spark writes from the given tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import landmarks
from ..operators import rows
from ..sources import files
from ..streaming import stateful
from .agg_queries import rounded
from .grouped_queries import STREAM, as_long, decoder_sql, steps_sql
from .registry import query
from .views import shared_path, table, table_stream, v_ann, v_frames


@query("io1_scan_delimited", 'select attachment_id, label, signer, "begin", "end" from v_ann')
def io1(spark, sf):
    path = shared_path(spark, "delimited")
    ann = v_ann(spark, sf).select("attachment_id", "label", "signer", "begin", "end")
    ann.write.csv(path, sep=";", header=True)
    return files.scan_delimited(spark, path, ann.schema)


@query("io2_scan_interval_list", 'select attachment_id as video, label, cast(row_num % 1000 as integer) as id, "begin" as t_start, "end" as t_end, case when row_num % 2 = 0 then "end" - "begin" end as frames from v_ann')
def io2(spark, sf):
    path = shared_path(spark, "intervals")
    a = v_ann(spark, sf)
    a.select(F.concat_ws(" , ", "attachment_id", "label", F.col("row_num") % 1000, "begin", "end", F.when(F.col("row_num") % 2 == 0, F.col("end") - F.col("begin")))).write.text(path)
    return files.scan_interval_list(spark, path)


@query("io3_scan_manifest", "select distinct attachment_id as id, split from v_ann where split <> ''")
def io3(spark, sf):
    path = shared_path(spark, "manifest")
    v_ann(spark, sf).where("split <> ''").select(F.col("attachment_id").alias("sample_id"), "split").distinct().write.json(path)
    return files.scan_manifest(spark, path).select("id", "split")


@query("io4_scan_frame_json", "select cast(sample_id as varchar) as id, frame_idx, round(x, 6) as x, '{\"fps\":25}' as meta from v_frames")
def io4(spark, sf):
    path = shared_path(spark, "frame-json")
    clips = v_frames(spark, sf).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))), lambda r: F.struct(r["x"].alias("x"))).alias("frames"))
    doc = F.struct(F.struct(F.lit(25).alias("fps")).alias("meta"), "frames")
    several = clips.groupBy(F.expr("sample_id div 4").alias("shard")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("sample_id").cast("string"), doc))).alias("videos"))
    several.select(F.to_json(F.struct("videos"))).write.option("maxRecordsPerFile", 1).text(path)
    return rounded(files.scan_frame_json(spark, path).select("id", "frame_idx", "meta", F.variant_get("frame", "$.x", "double").alias("x")), "x")


@query("io5_scan_frame_jsonl", "select event_id, event_type, round(x, 6) as x from v_frames")
def io5(spark, sf):
    path = shared_path(spark, "frame-lines")
    v_frames(spark, sf).select("event_id", "event_type", "x").write.json(path)
    frame = files.scan_frame_jsonl(spark, path)
    return rounded(frame.select(*[F.variant_get("frame", f"$.{c}", t).alias(c) for c, t in (("event_id", "long"), ("event_type", "string"), ("x", "double"))]), "x")


@query("io10_write_artifact", """
    select f.sample_id, f.frame_idx, v.frames, l.variant, f.sample_id || '/' || l.variant as "group" from v_frames f join v_videos v using (sample_id), (select unnest(['raw', 'pp']) as variant) l""")  # fmt: skip
def io10(spark, sf):
    from .views import v_videos

    root = shared_path(spark, "artifact")
    f = v_frames(spark, sf).select("sample_id", "frame_idx")
    marks = f.withColumn("variant", F.explode(F.array(F.lit("raw"), F.lit("pp"))))
    files.write_artifact(v_videos(spark, sf), f, marks, root)
    videos, frames, read = (spark.read.parquet(f"{root}/{t}") for t in ("videos", "frames", "landmarks"))
    # sorted ids and numbers take a few bits a row in the files, so that their size would have Spark broadcast any number of rows
    return frames.join(videos.select("sample_id", "frames").hint("merge"), "sample_id").join(read.hint("merge"), ["sample_id", "frame_idx"]).select("sample_id", "frame_idx", "frames", "variant", "group")


@query("io13_predictions", 'select id, "true", pred, round(conf, 6) as conf, [cast(pred as bigint), cast("true" as bigint)] as ranked from v_pred')
def io13(spark, sf):
    from .views import v_pred

    folder = shared_path(spark, "predictions")
    files.write_predictions(v_pred(spark, sf).select("id", "true", "pred", "conf", F.array(F.col("pred").cast("long"), F.col("true").cast("long")).alias("ranked")), folder)
    return rounded(files.read_predictions(spark, folder), "conf")


@query("io18_manifest_by_split", "select split, attachment_id, label from v_ann where split <> ''")
def io18(spark, sf):
    root = shared_path(spark, "by-split")
    files.write_manifest_by_split(v_ann(spark, sf).where("split <> ''").select("split", "attachment_id", "label", "row_num"), root, "row_num")
    return spark.read.csv(f"{root}/by_split", sep="\t", header=True, schema="attachment_id string, label string, row_num long, split string").select("split", "attachment_id", "label")


@query("pf8_check_columns", "select label, count(*) as n, 'user_id; one of train, is_train' as missing, '' as missing_here from v_ann group by label")
def pf8(spark, sf):
    """What the annotations lack of two sets of columns, beside their counts: the first set isn't whole, the second is."""
    a = v_ann(spark, sf)
    lacks = [rows.missing_columns(a, ["attachment_id", "user_id", "Begin"], ["train", "is_train"]), rows.missing_columns(a, ["attachment_id", "LABEL", "begin", "end"], ["split", "is_train"])]
    return a.groupBy("label").agg(F.count("*").alias("n")).withColumns({"missing": F.lit("; ".join(lacks[0])), "missing_here": F.lit("; ".join(lacks[1]))})


@query("pf15_compact_keys", """select event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' as doc from events""")
def pf15(spark, sf):
    e = table(spark, sf, "events")
    docs = e.select("event_id", F.to_json(F.struct("event_id", "value", "event_type", F.lit("x").alias("junk"))).alias("doc"))
    return files.compact_keys(docs, "doc", ["event_id", "event_type", "not there"])


@query("ar1_ar2_hands", """
    select event_id, case when event_id % 4 <> 3 then round(value, 6) end as left_x, case when event_id % 4 <> 3 then 2.0 end as left_y, case when event_id % 4 = 1 then 3.0 when event_id % 4 <> 3 then 0.0 end as left_z,
           case when event_id % 4 <> 2 then round(value + 1, 6) end as right_x, case when event_id % 4 <> 3 then 2 end as n from events""")  # fmt: skip
def ar1_ar2(spark, sf):
    e, i, v = table(spark, sf, "events"), F.col("event_id") % 4, F.format_string("%.9f", "value")
    w = F.format_string("%.9f", F.col("value") + 1)
    doc = (
        F.when(i == 0, F.concat(F.lit('{"hand 1": [{"x": '), v, F.lit(', "y": 2}], "hand 2": [['), w, F.lit(", 1]]}")))
        .when(i == 1, F.concat(F.lit('{"left_hand": [['), v, F.lit(', 2, 3]], "right_hand": [{"X": '), w, F.lit(', "Y": 0}]}')))
        .when(i == 2, F.concat(F.lit('{"hands": {"left": [['), v, F.lit(", 2]]}}")))
        .otherwise(F.concat(F.lit('{"hands": [{"handedness": "Right", "landmarks": [['), w, F.lit(", 5]]}]}")))
    )
    left, right = landmarks.hands_from_variant(F.col("d"))
    made = e.select("event_id", F.parse_json(doc).alias("d")).select("event_id", landmarks.points_to_struct(left, 2).alias("l"), landmarks.points_to_struct(right, 2).alias("r"))
    point = lambda c, axis: F.col(c)[0][axis]
    out = made.select("event_id", point("l", "x").alias("left_x"), point("l", "y").alias("left_y"), point("l", "z").alias("left_z"), point("r", "x").alias("right_x"), F.size("l").alias("n"))
    return rounded(out.withColumn("n", F.when(F.col("n") >= 0, F.col("n"))), "left_x", "right_x")


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of frames by session, numbered by event."""
    return table_stream(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_idx"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")


def taken(out: DataFrame) -> DataFrame:
    """Run a stream over all that is there, and read what it has written."""
    spark, base = out.sparkSession, shared_path(out.sparkSession, "stream")
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


ORDERED = "select user_id as sample_id, row_number() over (partition by user_id order by event_id) - 1 as frame_idx, event_id, value as x, epoch_us(ts) // 1000 as ts_ms, event_type from events"


@query("io19_event_log_source", "select event_id, user_id, event_type from events")
def io19(spark, sf):
    path = shared_path(spark, "log")
    table(spark, sf, "events").select("event_id", "user_id", "event_type").write.json(path)
    return taken(files.event_log_source(spark, path, "event_id long, user_id long, event_type string"))


@query("st2_drop_open_segments", decoder_sql(STREAM, "session_id", end=False))
def st2(spark, sf):
    """The stream of segments where the end of the input drops an open one."""
    b = F.col("value") / (F.col("value") + 60)
    s = events_stream(spark, sf).select("session_id", "frame_idx", "ts", b.alias("pb"), ((1 - b) * 0.3).alias("pi"), (F.col("event_type") != "error").alias("visible"))
    return as_long(taken(stateful.stream_segments(s, end_of_stream="drop", start=0.5)))


@query("st5_stream_words", f"""
    with recursive f as (select sample_id, frame_idx, event_type as label, event_id % 10 > 1 as sure, event_id * 100 as a, event_id * 100 + 50 as b from ({ORDERED})),
    s as (
      select sample_id, cast(-1 as bigint) as frame_idx, cast(null as varchar) as label, cast(0 as bigint) as a, cast(null as varchar) as word, cast(0 as bigint) as ended, false as ok from (select distinct sample_id from f)
      union all
      select sample_id, frame_idx, label, a, case when ok then label else word end, case when ok then b else ended end, ok
      from (select f.*, s.word, s.ended, f.sure and not (f.label is not distinct from s.word and f.a - s.ended <= 1200) as ok from s join f on f.sample_id = s.sample_id and f.frame_idx = s.frame_idx + 1) f)
    select sample_id as session_id, a as start_ms, label from s where ok""")  # fmt: skip
def st5(spark, sf):
    i = F.col("frame_idx")
    s = events_stream(spark, sf).select("session_id", "frame_idx", "ts", F.col("event_type").alias("label"), F.when(i % 10 > 1, 0.9).otherwise(0.1).alias("conf"), (i * 100).alias("start_ms"), (i * 100 + 50).alias("end_ms"))
    return taken(stateful.stream_words(s))


@query("st6_stream_clips", f"""
    with f as ({ORDERED}), g as (select sample_id, event_id - 3 as s, event_id - 1 as e from f where event_id % 10 = 8)
    select g.sample_id as session_id, s as "start", e as end_excl, min(event_id) as clip_start, list(round(x, 6) order by event_id) as clip from g join f on f.sample_id = g.sample_id and event_id >= s - 2 and event_id < e + 2 group by 1, 2, 3""")  # fmt: skip
def st6(spark, sf):
    i = F.col("frame_idx")
    s = events_stream(spark, sf).select("session_id", "frame_idx", "ts", F.col("value").alias("x"), F.when(i % 10 == 8, (i - 3).cast("double")).alias("seg_start"), F.when(i % 10 == 8, (i - 1).cast("double")).alias("seg_end"))
    return taken(stateful.stream_clips(s)).withColumn("clip", F.transform("clip", lambda x: F.round(x, 6)))


@query("st10_stream_upsert", "select user_id as session_id, frame_idx, round(value, 6) as value from (select user_id, event_id as frame_idx, value, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def st10(spark, sf):
    base = shared_path(spark, "upsert")
    s = events_stream(spark, sf).select("session_id", "frame_idx", F.struct("ts", "frame_idx").alias("ts"), "value")
    stateful.upsert_stream(s, f"{base}/rows", "session_id", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return rounded(stateful.compact(spark, f"{base}/rows", "session_id").select("session_id", "frame_idx", "value"), "value")

