"""The given tables seen as landmark data: frames, tags, clips, annotations and predictions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream; by a pattern, which may stand for a file or for a folder of parts."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of spark.checkpoint.dir, which must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = tempfile.mkdtemp(prefix="kinema-") if spark.sparkContext.master.startswith("local[") else None
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame of a clip (an event of a user): hands, score, position, time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("sample_id"),
        (F.row_number().over(order) - 1).cast("int").alias("frame_idx"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000").alias("ts_ms"),
        F.col("value").alias("x"),
        (F.col("event_type") != "error").alias("h1"),
        (~F.col("event_type").isin("error", "view")).alias("h2"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"),
        (F.col("event_type") == "click").alias("occ"),
        "event_id",
        "event_type",
    )


def v_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with true tags y, predicted tags p (0 outside, 1 begin, 2 inside) and probabilities."""
    f = v_frames(spark, sf_dir)
    y = F.when(F.col("event_type").isin("error", "signup"), 0).when(F.col("event_type") == "click", 1).otherwise(2)
    b = F.col("x") / (F.col("x") + 60)
    return f.select(
        "event_id", "sample_id", "frame_idx", "ts_ms", "h1", "h2", y.alias("y"), (F.col("event_id") % 3).cast("int").alias("p"), b.alias("pb"),
        ((1 - b) * (F.col("event_id") % 7) / 7).alias("pi"), ((1 - b) * (7 - F.col("event_id") % 7) / 7).alias("po"),
    )


def v_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of metrics per clip."""
    return (
        v_frames(spark, sf_dir)
        .groupBy("sample_id")
        .agg(
            F.count("*").alias("frames"),
            F.count_if("h1").alias("hand1"),
            F.count_if("h2").alias("hand2"),
            F.count_if(F.col("occ")).alias("swaps"),
            F.count_if(F.col("x") > 100).alias("outliers"),
            F.count_if(~F.col("h1")).alias("missing"),
            F.round(F.avg("score"), 9).alias("quality"),
            F.round(F.max("x") - F.min("x"), 9).alias("delta"),
        )
    )


def v_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of clips, some of them invalid."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("attachment_id"),
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.col("l_suppkey").cast("string").alias("signer"),
        (F.col("l_linenumber") * 10).cast("int").alias("begin"),
        (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") - 5).cast("int").alias("end"),
        F.when(F.col("l_partkey") % 10 < 7, "train").when(F.col("l_partkey") % 10 < 9, "val").otherwise("").alias("split"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("row_num"),
    )


def v_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the labelled vectors, a third of them off, with confidence and margin."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("true"), F.expr("cast((label + case when vec_id % 3 = 0 then vec_id % 10 else 0 end) % 10 as int)").alias("pred"),
        (F.col("vec_id") % 97 / 97).alias("conf"), (F.col("vec_id") % 89 / 89).alias("margin"), (F.col("vec_id") % 5).alias("epoch"),
    )


#: Joints of a hand in the views.
HAND_JOINTS = 3


def joint_arrays(x: Column, event_id: Column, event_type: Column) -> tuple[Column, Column]:
    """Points and mask of two hands made of a frame's value, number and kind."""
    score = F.least(x / 100, F.lit(1.0))
    places = F.sequence(F.lit(0), F.lit(2 * HAND_JOINTS - 1))
    point = lambda j: F.struct((x / 500 + j * 0.01 * (1 + event_id % 3)).alias("x"), (score / 2 + j * 0.02).alias("y"), ((event_id % 7) * 0.01 - j * 0.005).alias("z"))
    left, right = event_type != "error", ~event_type.isin("error", "view")
    seen = lambda j: F.when(F.when(j < HAND_JOINTS, left & ((event_id + j) % 4 != 0)).otherwise(right & ((event_id + j) % 5 != 0)), 1.0).otherwise(0.0)
    return F.transform(places, point), F.transform(places, seen)


def v_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the joints of both hands: points and mask, the left hand first."""
    points, mask = joint_arrays(F.col("x"), F.col("event_id"), F.col("event_type"))
    return v_frames(spark, sf_dir).select("sample_id", "frame_idx", "event_id", "ts_ms", points.alias("points"), mask.alias("mask"))


_JOINTS = """
        select sample_id, frame_idx, event_id, ts_ms, j, x / 500 + j * 0.01 * (1 + event_id % 3) as px, score / 2 + j * 0.02 as py, (event_id % 7) * 0.01 - j * 0.005 as pz,
               case when case when j < 3 then h1 and (event_id + j) % 4 <> 0 else h2 and (event_id + j) % 5 <> 0 end then 1e0 else 0e0 end as m
        from {f}, (select unnest([0, 1, 2, 3, 4, 5]) as j)"""
_SEEN = """
        with w as (select sample_id, frame_idx, j // 3 as side, px, py, pz from {j} where j % 3 = 0 and m = 1),
        d as (select p.sample_id, p.frame_idx, side, sqrt((p.px - w.px) ** 2 + (p.py - w.py) ** 2 + (p.pz - w.pz) ** 2) as far from {j} p join w on w.sample_id = p.sample_id and w.frame_idx = p.frame_idx and w.side = p.j // 3 where p.m = 1),
        h as (select sample_id, frame_idx, side, avg(far) filter (far > 1e-6) as far from d group by sample_id, frame_idx, side having count(*) >= 2),
        s as (select sample_id, frame_idx, greatest(avg(far), 0.001) as seen_scale from h where far is not null group by sample_id, frame_idx),
        c as (select sample_id, frame_idx, coalesce(avg(px) filter (m = 1 and j % 3 = 0), avg(px) filter (m = 1)) as seen_x, coalesce(avg(py) filter (m = 1 and j % 3 = 0), avg(py) filter (m = 1)) as seen_y, coalesce(avg(pz) filter (m = 1 and j % 3 = 0), avg(pz) filter (m = 1)) as seen_z from {j} group by sample_id, frame_idx)
        select c.*, seen_scale from c left join s using (sample_id, frame_idx)"""

#: The same views in SQL, in an order in which each needs earlier ones alone.
VIEW_SQL = {
    "v_frames": """
        select user_id as sample_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as frame_idx,
               epoch_us(ts) // 1000 as ts_ms, value as x, event_type <> 'error' as h1, event_type not in ('error', 'view') as h2,
               least(value / 100, 1.0) as score, event_type = 'click' as occ, event_id, event_type
        from events""",
    "v_bio": """
        select event_id, sample_id, frame_idx, ts_ms, h1, h2,
               case when event_type in ('error', 'signup') then 0 when event_type = 'click' then 1 else 2 end as y,
               cast(event_id % 3 as integer) as p, x / (x + 60) as pb,
               (1 - x / (x + 60)) * (event_id % 7) / 7 as pi, (1 - x / (x + 60)) * (7 - event_id % 7) / 7 as po
        from v_frames""",
    "v_videos": """
        select sample_id, count(*) as frames, count(*) filter (where h1) as hand1, count(*) filter (where h2) as hand2,
               count(*) filter (where occ) as swaps, count(*) filter (where x > 100) as outliers, count(*) filter (where not h1) as missing,
               round(avg(score), 9) as quality, round(max(x) - min(x), 9) as delta
        from v_frames group by sample_id""",
    "v_ann": """
        select cast(l_orderkey as varchar) as attachment_id, l_returnflag || l_linestatus as label, cast(l_suppkey as varchar) as signer,
               cast(l_linenumber * 10 as integer) as "begin", cast(l_linenumber * 10 + cast(trunc(l_quantity) as integer) - 5 as integer) as "end",
               case when l_partkey % 10 < 7 then 'train' when l_partkey % 10 < 9 then 'val' else '' end as split,
               l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 as row_num
        from lineitem""",
    "v_pred": """
        select vec_id as id, label as "true", cast((label + case when vec_id % 3 = 0 then vec_id % 10 else 0 end) % 10 as integer) as pred, vec_id % 97 / 97 as conf, vec_id % 89 / 89 as margin, vec_id % 5 as epoch
        from embeddings""",
    "v_ordered": """
        select user_id as sample_id, cast(row_number() over (partition by user_id order by event_id) - 1 as integer) as frame_idx, event_id, value as x, epoch_us(ts) // 1000 as ts_ms, event_type,
               event_type <> 'error' as h1, event_type not in ('error', 'view') as h2, least(value / 100, 1.0) as score
        from events""",
    "v_joints": _JOINTS.format(f="v_frames"),
    "v_seen": _SEEN.format(j="v_joints"),
    "v_ojoints": _JOINTS.format(f="v_ordered"),
    "v_oseen": _SEEN.format(j="v_ojoints"),
}


def with_views(sql: str) -> str:
    """Put the views that the SQL names, and those that these need, in front of it."""
    need: list[str] = []
    text = sql
    for name in reversed(VIEW_SQL):
        if re.search(rf"\b{name}\b", text):
            need.insert(0, name)
            text += VIEW_SQL[name]
    if not need:
        return sql
    views = ", ".join(f"{n} as ({VIEW_SQL[n]})" for n in need)
    rest = sql.strip()
    if rest.lower().startswith("with recursive "):
        return f"with recursive {views}, {rest[15:]}"
    return f"with {views}, {rest[5:]}" if rest.lower().startswith("with ") else f"with {views} {rest}"
