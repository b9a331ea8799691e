"""Grouped-map and streaming operators over the frame views; in SQL, steps that depend on each other are recursive."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouped
from ..streaming import stateful
from .agg_queries import rounded
from .registry import query
from .views import shared_path, table, table_stream, v_bio, v_frames


def decoder_sql(frames: str, key: str, start: float = 0.5, cooldown: int = 0, guard: int = 1, onset: float = 2, active: float = -1, active_go_on: float = 2, end: bool = True) -> str:
    """Segments of frames (key, i from 0, spot, pb, pi, seen, ons, act); gates are off by default."""
    go_on = min(0.65, max(0.25, 0.6 * start))
    return f"""
        with recursive f as ({frames}),
        s as (
          select {key}, -1 as i, cast(null as bigint) as opened, cast(0 as bigint) as last, 0 as idle, 0 as wait, 0 as vis, cast(0 as double) as best, cast(0 as double) as total, 0 as n, cast(null as bigint) as d_start, cast(0 as bigint) as d_end, cast(0 as double) as d_score, cast(0 as double) as d_mean
          from (select distinct {key} from f)
          union all
          select {key}, i, case when opens then spot when closes then null else opened end, case when opens or lively then spot else last end, case when opens or lively then 0 else idle + 1 end, held, vis,
                 case when opens then pb else greatest(best, pb) end, case when opens then ins else total + ins end, case when opens then 1 else n + 1 end,
                 case when closes and last + 1 - opened >= 2 then opened end, last + 1, greatest(best, pb), (total + ins) / (n + 1)
          from (
            select *, (opened is null or closes) and held = 0 and vis >= {guard} and (pb >= {start} or coalesce(ons, 0) >= {onset}) and coalesce(act, 1) >= {active} as opens
            from (
              select *, case when closes then {cooldown} else ticked end as held
              from (
                select f.{key}, f.i, f.spot, f.pb, greatest(f.pb, f.pi) as ins, f.ons, f.act, s.opened, s.last, s.idle, s.best, s.total, s.n, greatest(s.wait - 1, 0) as ticked, case when f.seen then s.vis + 1 else 0 end as vis,
                       greatest(f.pb, f.pi) >= {go_on} or coalesce(f.act, 0) >= {active_go_on} as lively, s.opened is not null and not (greatest(f.pb, f.pi) >= {go_on} or coalesce(f.act, 0) >= {active_go_on}) and s.idle + 1 >= 2 as closes
                from s join f on f.{key} = s.{key} and f.i = s.i + 1)))),
        z as (select {key}, max(i) as i from f group by {key}),
        found as (
          select {key}, d_start as "start", d_end as end_excl, d_score as score, d_mean as mean_inside, 'gap_closed' as end_reason from s where d_start is not null
          {f"union all select s.{key}, opened, last + 1, best, total / n, 'eos_closed' from s join z on z.{key} = s.{key} and z.i = s.i where opened is not null and last + 1 - opened >= 2" if end else ""})
        select {key}, "start", end_excl, round(score, 6) as score, round(mean_inside, 6) as mean_inside, end_reason from found"""


def steps_sql(frames: str, state: dict[str, tuple[str, str]], out: str) -> str:
    """Rows of a recursion over frames f (sample_id, frame_idx from 0, ...); state: name -> (first value, next value from s.* and f.*)."""
    return f"""
        with recursive f as ({frames}),
        s as (
          select sample_id, -1 as frame_idx, {", ".join(f"cast({first} as double) as {n}" for n, (first, _) in state.items())} from (select distinct sample_id from f)
          union all
          select f.sample_id, f.frame_idx, {", ".join(nxt for _, nxt in state.values())} from s join f on f.sample_id = s.sample_id and f.frame_idx = s.frame_idx + 1)
        {out}"""


EMA = steps_sql(
    "select a.sample_id, a.frame_idx, case when a.h1 then a.x end as a, case when b.h1 then b.x end as z from v_frames a join (select sample_id, max(frame_idx) as m from v_frames group by sample_id) e using (sample_id) join v_frames b on b.sample_id = a.sample_id and b.frame_idx = e.m - a.frame_idx",
    {"last": ("null", "case when s.last is null or f.a is null then f.a else 0.6 * s.last + 0.4 * f.a end"), "back": ("null", "case when s.back is null or f.z is null then f.z else 0.6 * s.back + 0.4 * f.z end")},
    "select a.sample_id, a.frame_idx, round((a.last + b.back) / 2, 6) as smooth from s a join (select sample_id, max(frame_idx) as m from s group by sample_id) e using (sample_id) join s b on b.sample_id = a.sample_id and b.frame_idx = e.m - a.frame_idx where a.frame_idx >= 0",
)


@query("ws21_ema_bidirectional", EMA)
def ws21(spark, sf):
    return rounded(grouped.ema_bidirectional(v_frames(spark, sf).withColumn("x", F.when(F.col("h1"), F.col("x"))), "x", 0.4), "smooth")


DT = "(f.t - s.t) / 1000"
SHARE = "(1 / (1 + 1 / (2 * pi() * ({c})) / (" + DT + ")))"
SPEED = f"(s.dx + {SHARE.format(c='1.0')} * ((f.x - s.x) / ({DT}) - s.dx))"
EURO_STATE = {
    "t": ("null", "case when s.t is null or f.t > s.t then f.t else s.t end"),
    "x": ("null", f"case when s.t is null then f.x when f.t > s.t then s.x + {SHARE.format(c=f'1.0 + 0.01 * abs({SPEED})')} * (f.x - s.x) else s.x end"),
    "dx": ("0", f"case when s.t is null then 0 when f.t > s.t then {SPEED} else s.dx end"),
}
EURO = steps_sql("select sample_id, frame_idx, cast(ts_ms as double) as t, x from v_frames", EURO_STATE, "select sample_id, frame_idx, round(x, 6) as smooth from s where frame_idx >= 0")


@query("ws23_one_euro", EURO)
def ws23(spark, sf):
    return rounded(grouped.one_euro(v_frames(spark, sf), "x", "ts_ms"), "smooth")


@query("ws28_sentence_words", """
    with recursive f as (select sample_id, frame_idx, event_type as label, score >= 0.2 as sure, frame_idx * 700 as a, frame_idx * 700 + 500 as b from v_frames),
    s as (
      select sample_id, -1 as frame_idx, cast(null as varchar) as label, cast(null as varchar) as word, 0 as ended, false as accepted, '' as sentence from (select distinct sample_id from f)
      union all
      select f.sample_id, f.frame_idx, f.label, case when ok then f.label else word end, case when ok then f.b else ended end, ok, case when ok and sentence = '' then f.label when ok then sentence || ' ' || f.label else sentence end
      from (select f.*, s.word, s.ended, s.sentence, trim(coalesce(f.label, '')) <> '' and f.sure and not (f.label is not distinct from s.word and f.a - s.ended <= 1200) as ok from s join f on f.sample_id = s.sample_id and f.frame_idx = s.frame_idx + 1) f)
    select sample_id as session_id, cast(frame_idx * 700 as bigint) as start_ms, label, accepted, sentence from s where frame_idx >= 0""")  # fmt: skip
def ws28(spark, sf):
    p = v_frames(spark, sf).select(F.col("sample_id").alias("session_id"), (F.col("frame_idx") * 700).cast("long").alias("start_ms"), (F.col("frame_idx") * 700 + 500).cast("long").alias("end_ms"), F.col("event_type").alias("label"), F.col("score").alias("conf"))
    return grouped.sentence_words(p, min_conf=0.2)


BIO = "select sample_id, frame_idx as i, cast(frame_idx as bigint) as spot, pb, pi, h1 as seen, pi as ons, 1 - po as act from v_bio"
GATES = {"guard": 2, "cooldown": 1}


def as_long(df):
    return rounded(df.withColumn("start", F.col("start").cast("long")).withColumn("end_excl", F.col("end_excl").cast("long")), "score", "mean_inside")


@query("ws29_decode_segments", decoder_sql(BIO, "sample_id", **GATES))
def ws29(spark, sf):
    return as_long(grouped.decode_segments(v_bio(spark, sf), start=0.5, **GATES))


@query("ws29_decode_gates", decoder_sql(BIO, "sample_id", onset=0.45, active=0.3, active_go_on=0.8))
def ws29_gates(spark, sf):
    b = v_bio(spark, sf).withColumn("act", 1 - F.col("po"))
    return as_long(grouped.decode_segments(b, start=0.5, active="act", onset="pi", onset_start=0.45, active_start=0.3, active_go_on=0.8))


@query("ws31_seam_deltas", """
    with p as (select sample_id, frame_idx // 10 as part, 10 as length from v_frames where frame_idx % 10 = 0), s as (select sample_id, frame_idx, abs(x - lag(x) over (partition by sample_id order by frame_idx)) as step from v_frames)
    select sample_id, round(avg(case when frame_idx % 10 = 0 then step end), 6) as at_seams, round(avg(case when frame_idx % 10 <> 0 then step end), 6) as inside, count(*) filter (where frame_idx % 10 = 0) as seams from s where step is not null group by sample_id""")  # fmt: skip
def ws31(spark, sf):
    f = v_frames(spark, sf)
    parts = f.where("frame_idx % 10 = 0").select("sample_id", F.expr("frame_idx div 10").alias("part"), F.lit(10).alias("length"))
    return rounded(grouped.seam_steps(parts, f, "x"), "at_seams", "inside")


@query("st7_session_windows", """
    with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as "start", max(ts) + interval 6 hours as "end", count(*) as n from s group by user_id, k""")  # fmt: skip
def st7(spark, sf):
    return stateful.session_windows(table(spark, sf, "events"), "6 hours", "user_id")


STATUS = "select user_id % 20 as shard, ts, 500 as selected, cast(event_id % 300 as integer) as processed, cast(event_id % 7 as integer) as failed, event_type as error from events"


@query("st8_progress_rollup", f"with e as ({STATUS}), l as (select *, row_number() over (partition by shard order by ts desc, processed desc) as r from e) select count(*) as shards, cast(sum(selected) as bigint) as selected, cast(sum(processed) as bigint) as processed, cast(sum(failed) as bigint) as failed, cast(sum(selected - processed - failed) as bigint) as remaining from l where r = 1")
def st8(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("kinema_events")
    return stateful.progress_rollup(stateful.latest_status(spark.sql(STATUS.replace("integer", "int").replace("from events", "from kinema_events"))))


@query("st8_error_summary", "select event_type, count(*) as n from events where event_type in ('error', 'view') group by 1")
def st8_errors(spark, sf):
    e = table(spark, sf, "events").withColumn("event_type", F.when(F.col("event_type").isin("error", "view"), F.col("event_type")))
    return stateful.error_summary(e, "event_type")


STREAM = "select user_id as session_id, row_number() over (partition by user_id order by event_id) - 1 as i, event_id as spot, value / (value + 60) as pb, (1 - value / (value + 60)) * 0.3 as pi, event_type <> 'error' as seen, null as ons, null as act from events"


@query("st1_stream_segments", decoder_sql(STREAM, "session_id"))
def st1(spark, sf):
    """The decoder over the events as a stream, all that is there taken in one go, with the segments that its end leaves open."""
    s = table_stream(spark, sf, "events")
    b = F.col("value") / (F.col("value") + 60)
    frames = s.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_idx"), F.col("ts").cast("timestamp").alias("ts"), b.alias("pb"), ((1 - b) * 0.3).alias("pi"), (F.col("event_type") != "error").alias("visible"))
    base = shared_path(spark, "stream")
    out = stateful.stream_segments(frames, start=0.5)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return as_long(spark.read.schema(out.schema).parquet(f"{base}/out").unionByName(stateful.open_segments(spark, f"{base}/state")))
