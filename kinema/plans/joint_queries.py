"""Operators on joints, hands and whole sweeps over the views, batch and stream; in SQL, steps that depend on each other are recursive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agg, evaluate, grouped, joins, seq
from ..streaming import stateful
from .agg_queries import NUDGE, rounded, sql_round
from .grouped_queries import EURO_STATE, steps_sql
from .registry import query
from .source_queries import events_stream, taken
from .views import HAND_JOINTS, joint_arrays, table, v_bio, v_frames, v_joints

SIZE = {"hand": HAND_JOINTS, "least": 2}


def joint_rows(df: DataFrame, points: str, *keep: str, nudge: float = 0.0) -> DataFrame:
    """A row for each joint, numbered, of rows with points."""
    rows = df.select(*keep, F.posexplode(points).alias("joint", "p"))
    return rounded(rows.select(*keep, "joint", *[(F.col(f"p.{c}") + nudge).alias(c) for c in "xyz"]), "x", "y", "z")


# WS25, ST3

_SEEN = {n: (s, a) for n, s, a in (("cx", "seen_x", 0.2), ("cy", "seen_y", 0.2), ("cz", "seen_z", 0.2), ("sc", "seen_scale", 0.1))}
NORM_STATE = {n: ("null", f"case when f.{s} is null then s.{n} when s.{n} is null then f.{s} else {1 - a} * s.{n} + {a} * f.{s} end") for n, (s, a) in _SEEN.items()}
_NORM = ", ".join(f"round((j.p{c} - coalesce(s.c{c}, 0)) / greatest(coalesce(s.sc, 1), 0.001) * m, 6) as {c}" for c in "xyz")


@query("ws25_causal_normalize", steps_sql("select * from v_seen", NORM_STATE, f"select s.sample_id, s.frame_idx, cast(j as integer) as joint, {_NORM} from s join v_joints j using (sample_id, frame_idx)"))
def ws25(spark, sf):
    return joint_rows(grouped.causal_normalize(v_joints(spark, sf), **SIZE), "points", "sample_id", "frame_idx")


def joints_stream(spark, sf) -> DataFrame:
    """The events as a stream of frames with joints by session, numbered by event."""
    s = events_stream(spark, sf)
    points, mask = joint_arrays(F.col("value"), F.col("frame_idx"), F.col("event_type"))
    return s.select("session_id", "frame_idx", "ts", points.alias("points"), mask.alias("mask"))


@query("st3_stream_normalize", steps_sql("select * from v_oseen", NORM_STATE, f"select s.sample_id as session_id, j.event_id as frame_idx, cast(j as integer) as joint, {_NORM} from s join v_ojoints j using (sample_id, frame_idx)"))
def st3(spark, sf):
    return joint_rows(taken(stateful.stream_normalize(joints_stream(spark, sf), **SIZE)), "points", "session_id", "frame_idx")


# ST4: a filter for each of three coordinates

@query("st4_stream_one_euro", steps_sql("select sample_id * 3 + c as sample_id, frame_idx, event_id, cast(ts_ms as double) as t, x * (c + 1) - c as x from v_ordered, (select unnest([0, 1, 2]) as c)", EURO_STATE, "select s.sample_id // 3 as session_id, f.event_id as frame_idx, list(round(s.x, 6) order by s.sample_id % 3) as smooth from s join f using (sample_id, frame_idx) group by 1, 2"))
def st4(spark, sf):
    xs = F.array(*[F.col("value") * (c + 1) - c for c in range(3)])
    frames = events_stream(spark, sf).select("session_id", "frame_idx", "ts", F.expr("unix_millis(ts)").alias("ts_ms"), xs.alias("xs"))
    return taken(stateful.stream_one_euro(frames)).withColumn("smooth", F.transform("smooth", lambda x: sql_round(x)))


# ST9

def _norm(x: str) -> str:
    return f"sqrt(greatest({x}x ** 2 + {x}y ** 2 + {x}z ** 2, 1e-6))"


FEATURES = f"""
    with c as (select sample_id, frame_idx, event_id, j, j // 3 as side, m, {", ".join(f"p{a} * m as c{a}" for a in "xyz")}, coalesce(lag(m) over w, 0) as m1, coalesce(lag(m, 2) over w, 0) as m2 from v_ojoints window w as (partition by sample_id, j order by frame_idx)),
    v as (select *, {", ".join(f"coalesce(c{a} - lag(c{a}) over w, 0) * m * m1 as v{a}" for a in "xyz")} from c window w as (partition by sample_id, j order by frame_idx)),
    a as (select *, {", ".join(f"coalesce(v{a} - lag(v{a}) over w, 0) * m * m1 * m2 as a{a}" for a in "xyz")}, {", ".join(f"first_value(c{a}) over h as w{a}" for a in "xyz")}, first_value(m) over h as wm from v window w as (partition by sample_id, j order by frame_idx), h as (partition by sample_id, frame_idx, side order by j)),
    l as (select *, {_norm("v")} * m as speed, {_norm("a")} * m as push, sqrt(greatest((cx - wx) ** 2 + (cy - wy) ** 2 + (cz - wz) ** 2, 1e-6)) * m as far from a),
    h as (select sample_id, event_id, side, sum(m) as n, sum(speed) as speed, sum(push) as push, sum(far) / greatest(sum(m), 1) as spread, any_value(wx) as wx, any_value(wy) as wy, any_value(wz) as wz, any_value(wm) as wm from l group by all),
    f as (select l.sample_id, l.event_id, l.n + r.n as n, l.speed + r.speed as speed, l.push + r.push as push, l.speed / greatest(l.n, 1) as ls, r.speed / greatest(r.n, 1) as rs, l.spread as lf, r.spread as rf,
                 sqrt(greatest((l.wx - r.wx) ** 2 + (l.wy - r.wy) ** 2 + (l.wz - r.wz) ** 2, 1e-6)) * l.wm * r.wm as apart
          from h l join h r on l.sample_id = r.sample_id and l.event_id = r.event_id and l.side = 0 and r.side = 1)
    select sample_id as session_id, event_id as frame_idx, round(n / 6, 6) as visible_share, round(speed / greatest(n, 1), 6) as mean_speed, round(push / greatest(n, 1), 6) as mean_acceleration, round(apart, 6) as wrist_distance,
           round(lf, 6) as left_spread, round(rf, 6) as right_spread, round(ls, 6) as left_speed, round(rs, 6) as right_speed, round((ls + rs) / 2, 6) as hand_speed, round((lf + rf) / 2, 6) as hand_spread from f"""


@query("st9_stream_features", FEATURES)
def st9(spark, sf):
    f = taken(stateful.stream_features(joints_stream(spark, sf), hand=HAND_JOINTS)).drop("velocity", "acceleration")
    return rounded(f, *[c for c in f.columns if c not in ("session_id", "frame_idx")])


# WS22, WS24: frames by hand

HANDS = """
    select sample_id, j // 3 as hand, frame_idx, ts_ms, event_id, bool_or(m0) as there, bool_or(m0) and event_id % 3 = 0 as anchor, case event_id % 3 when 0 then 'pass1' when 1 then 'tracked' else 'pass2' end as source, case when event_id % 5 <> 1 then 'observed' else 'predicted' end as state,
           case when bool_or(m0) then list([px, py, pz] order by j) end as pts
    from (select v.*, case when j < 3 then h1 else h2 end as m0 from v_joints v join (select sample_id, frame_idx, h1, h2 from v_frames) using (sample_id, frame_idx)) group by sample_id, j // 3, frame_idx, ts_ms, event_id"""
_DT = "coalesce(greatest((ts_ms - lag(ts_ms) over (partition by sample_id, hand order by frame_idx)) / mid, 1e-6), 1)"
DT = f"""d as (select sample_id, hand, ts_ms - lag(ts_ms) over (partition by sample_id, hand order by frame_idx) as d from hh), md as (select sample_id, hand, median(d) filter (d > 0) as mid from d group by all),
    st as (select hh.*, {_DT} as dt from hh join md using (sample_id, hand))"""


def _each(expr: str, *lists: str) -> str:
    return f"list_transform(list_zip({', '.join(lists)}), lambda z: {expr})"


#: From st (sample_id, hand, frame_idx, dt, r, obs: list or null) to sm (sample_id, hand, frame_idx, smooth).
RTS = f"""first as (select sample_id, hand, min(frame_idx) as lo from st where obs is not null group by all),
    r as (select st.*, frame_idx - lo as i from st join first using (sample_id, hand) where frame_idx >= lo),
    fw as (
      select sample_id, hand, i, frame_idx, obs, dt, obs as ax, list_transform(obs, lambda o: cast(0 as double)) as av, cast(1 as double) as pa, cast(0 as double) as pc, cast(1 as double) as pw,
             obs as x, list_transform(obs, lambda o: cast(0 as double)) as v, cast(1 as double) as a, cast(0 as double) as c, cast(1 as double) as w from r where i = 0
      union all
      select sample_id, hand, i, frame_idx, obs, dt, ax, av, pa, pc, pw, case when obs is null then ax else {_each(f"z[1] + pa / (pa + r) * (z[2] - z[1])", "ax", "obs")} end, case when obs is null then av else {_each("z[1] + pc / (pa + r) * (z[3] - z[2])", "av", "ax", "obs")} end,
             case when obs is null then pa else pa - pa / (pa + r) * pa end, case when obs is null then pc else pc - pc / (pa + r) * pa end, case when obs is null then pw else pw - pc / (pa + r) * pc end
      from (select r.sample_id, r.hand, r.i, r.frame_idx, r.obs, r.dt, r.r, {_each("z[1] + r.dt * z[2]", "f.x", "f.v")} as ax, f.v as av, f.a + r.dt * (2 * f.c + r.dt * f.w) + {grouped.DRIFT} * r.dt ** 4 / 4 as pa, f.c + r.dt * f.w + {grouped.DRIFT} * r.dt ** 3 / 2 as pc, f.w + {grouped.DRIFT} * r.dt ** 2 as pw
            from fw f join r on r.sample_id = f.sample_id and r.hand = f.hand and r.i = f.i + 1)),
    ls as (select sample_id, hand, max(i) as hi from fw group by all),
    bw as (
      select f.sample_id, f.hand, f.i, f.x as sx, f.v as sv from fw f join ls on ls.sample_id = f.sample_id and ls.hand = f.hand and f.i = hi
      union all
      select sample_id, hand, i, case when abs(det) < 1e-12 then x else {_each("z[1] + ((a + t * c) * g - c * fc) / det * (z[2] - z[3]) + (c * e - (a + t * c) * fc) / det * (z[4] - z[5])", "x", "sx", "nx", "sv", "nv")} end,
             case when abs(det) < 1e-12 then v else {_each("z[1] + ((c + t * w) * g - w * fc) / det * (z[2] - z[3]) + (w * e - (c + t * w) * fc) / det * (z[4] - z[5])", "v", "sx", "nx", "sv", "nv")} end
      from (select f.sample_id, f.hand, f.i, f.x, f.v, f.a, f.c, f.w, b.sx, b.sv, n.ax as nx, n.av as nv, n.dt as t, n.pa as e, n.pc as fc, n.pw as g, n.pa * n.pw - n.pc * n.pc as det
            from bw b join fw f on f.sample_id = b.sample_id and f.hand = b.hand and f.i = b.i - 1 join fw n on n.sample_id = b.sample_id and n.hand = b.hand and n.i = b.i)),
    sm as (select fw.sample_id, fw.hand, fw.frame_idx, sx as smooth from fw join bw using (sample_id, hand, i) where obs is not null)"""


def hand_frames(spark, sf) -> DataFrame:
    f = v_joints(spark, sf).join(v_frames(spark, sf).select("sample_id", "frame_idx", "h1", "h2"), ["sample_id", "frame_idx"])
    rows = f.withColumn("hand", F.explode(F.array(F.lit(0), F.lit(1))))
    there = F.when(F.col("hand") == 0, F.col("h1")).otherwise(F.col("h2"))
    i = F.col("event_id")
    return rows.select(
        "sample_id", "hand", "frame_idx", "ts_ms", "event_id", (there & (i % 3 == 0)).alias("anchor"), F.when(i % 3 == 0, "pass1").when(i % 3 == 1, "tracked").otherwise("pass2").alias("source"),
        F.when(i % 5 != 1, "observed").otherwise("predicted").alias("state"), F.when(there, F.slice("points", F.col("hand") * HAND_JOINTS + 1, HAND_JOINTS)).alias("pts"),
    )


_JOINT = "cast(k - 1 as integer) as joint, round({v}[3 * k - 2] + {n}, 6) as x, round({v}[3 * k - 1] + {n}, 6) as y, round({v}[3 * k] + {n}, 6) as z"


@query("ws22_rts_smooth", f"""
    with recursive hh as ({HANDS}), {DT.replace("hh.*", "hh.*, case when event_id % 3 = 0 then 1e-4 when event_id % 3 = 1 then 4e-4 else 36e-4 end as r, flatten(pts) as obs")}, {RTS}
    select sample_id, cast(hand as integer) as hand, frame_idx, {_JOINT.format(v="smooth", n=0)} from sm, (select unnest([1, 2, 3]) as k)""")  # fmt: skip
def ws22(spark, sf):
    i = F.col("event_id") % 3
    h = hand_frames(spark, sf).withColumn("noise", F.when(i == 0, 1e-4).when(i == 1, 4e-4).otherwise(36e-4))
    return joint_rows(grouped.rts_smooth(h.withColumn("ts", F.col("ts_ms").cast("double")), "pts", "ts", "noise"), "smooth", "sample_id", "hand", "frame_idx")


def post_sql(smoother: str, only_anchors: bool, out: str) -> str:
    """WS24 over HANDS with gaps of at most 3: pp (sample_id, hand, frame_idx, anchor, applied, overrode, filled, value as lists)."""
    replaced = "true" if only_anchors else "(not there or source in ('tracked', 'occluded', 'hold') or state <> 'observed')"
    scale = lambda h: f"greatest(sqrt(({h}[2][1] - {h}[1][1]) ** 2 + ({h}[2][2] - {h}[1][2]) ** 2), sqrt(({h}[3][1] - {h}[1][1]) ** 2 + ({h}[3][2] - {h}[1][2]) ** 2), 1e-6)"
    mix = "a[1][d] * (1 - t) + b[1][d] * t + (sa * (1 - t) + sb * t) * ((a[j][d] - a[1][d]) / sa * (1 - t) + (b[j][d] - b[1][d]) / sb * t)"
    made = f"list_transform([1, 2, 3], lambda j: list_transform([1, 2, 3], lambda d: case when d < 3 then greatest(least({mix}, 1), 0) else {mix} end))"
    step = {"x": "case when f.obs is null then null when s.x is null then f.obs else " + _each("z[1] * 0.5 + z[2] * 0.5", "s.x", "f.obs") + " end"}
    one_way = lambda name, table: f"""{name} as (select sample_id, hand, -1 as i, cast(null as double[]) as x from (select distinct sample_id, hand from {table}) union all
        select f.sample_id, f.hand, f.i, {step["x"]} from {name} s join {table} f on f.sample_id = s.sample_id and f.hand = s.hand and f.i = s.i + 1)"""  # noqa: E731
    ema = f"""fo as (select *, frame_idx as i from st), ba as (select st.*, mx - frame_idx as i, mx from st join (select sample_id, hand, max(frame_idx) as mx from st group by all) using (sample_id, hand)), {one_way("ef", "fo")}, {one_way("eb", "ba")},
        sm as (select ba.sample_id, ba.hand, ba.frame_idx, {_each("(z[1] + z[2]) / 2", "ef.x", "eb.x")} as smooth from ba join ef on ef.sample_id = ba.sample_id and ef.hand = ba.hand and ef.i = ba.frame_idx join eb on eb.sample_id = ba.sample_id and eb.hand = ba.hand and eb.i = ba.i where obs is not null)"""
    sigma = grouped.SIGMA
    noise = f"case when anchor then {sigma['anchor'] ** 2} when src in ('pass1', 'pass2') and sta = 'observed' then {sigma['observed'] ** 2} when src = 'interp' then {sigma['interp'] ** 2} else {sigma['predicted'] ** 2} end"
    return f"""
        with recursive h0 as ({HANDS}),
        an as (select *, last_value(case when anchor then frame_idx end ignore nulls) over b as p, last_value(case when anchor then pts end ignore nulls) over b as a, first_value(case when anchor then frame_idx end ignore nulls) over n as q, first_value(case when anchor then pts end ignore nulls) over n as b
               from h0 window b as (partition by sample_id, hand order by frame_idx rows between unbounded preceding and current row), n as (partition by sample_id, hand order by frame_idx rows between current row and unbounded following)),
        tt as (select *, (frame_idx - p) / (q - p) as t, {scale("a")} as sa, {scale("b")} as sb, not anchor and coalesce(q - p - 1 <= 3, false) and {replaced} as applied from an),
        hh as (select sample_id, hand, frame_idx, ts_ms, anchor, applied, applied and {str(only_anchors).lower()} and there and source in ('pass1', 'pass2') as overrode, case when applied then 'interp' else source end as src, case when applied then 'predicted' else state end as sta,
                      flatten(case when applied then {made} else pts end) as obs from tt),
        {DT.replace("hh.*", f"hh.*, {noise} as r")}, {RTS if smoother == "rts" else ema},
        pp as (select st.sample_id, st.hand, st.frame_idx, anchor, applied, overrode, src as source, obs, case when anchor then obs else smooth end as value from st left join sm on sm.sample_id = st.sample_id and sm.hand = st.hand and sm.frame_idx = st.frame_idx)
        {out}"""


STATS = """, g as (select *, applied and not coalesce(lag(applied) over (partition by sample_id, hand order by frame_idx), false) as starts, case when not anchor then sqrt((value[1] - obs[1]) ** 2 + (value[2] - obs[2]) ** 2 + (value[3] - obs[3]) ** 2) end as shift from pp)
    select sample_id, cast(hand as integer) as hand, count(*) filter (where applied) as filled, count(*) filter (where starts) as gaps_filled, round(coalesce(avg(shift), 0), 6) as smoothing_delta from g group by sample_id, hand"""


@query("ws24_postprocess", post_sql("ema", True, f"select sample_id, cast(hand as integer) as hand, frame_idx, applied, overrode, source, {_JOINT.format(v='value', n=NUDGE)} from pp, (select unnest([1, 2, 3]) as k) where obs is not null"))
def ws24(spark, sf):
    done = grouped.postprocess_hands(hand_frames(spark, sf), "pts", "anchor", 3, "ema")
    return joint_rows(done, "value", "sample_id", "hand", "frame_idx", "applied", "overrode", "source", nudge=NUDGE)


@query("ws24_postprocess_rts", post_sql("rts", False, f"select sample_id, cast(hand as integer) as hand, frame_idx, applied, overrode, source, {_JOINT.format(v='value', n=0)} from pp, (select unnest([1, 2, 3]) as k) where obs is not null"))
def ws24_rts(spark, sf):
    done = grouped.postprocess_hands(hand_frames(spark, sf).withColumn("ts_ms", F.col("ts_ms").cast("double")), "pts", "anchor", 3, "rts", only_anchors=False)
    return joint_rows(done, "value", "sample_id", "hand", "frame_idx", "applied", "overrode", "source")


@query("ws24_postprocess_stats", post_sql("rts", True, STATS))
def ws24_stats(spark, sf):
    done = grouped.postprocess_hands(hand_frames(spark, sf).withColumn("ts_ms", F.col("ts_ms").cast("double")), "pts", "anchor", 3, "rts")
    return rounded(grouped.postprocess_stats(done), "smoothing_delta")


# WS26

MOTION = """
    with m as (select sample_id, frame_idx, sum(m) > 0.5 as hand, avg(px) filter (m = 1 and j in (0, 3)) as wx, avg(py) filter (m = 1 and j in (0, 3)) as wy, avg(pz) filter (m = 1 and j in (0, 3)) as wz from v_joints group by all),
    d as (select *, sqrt((wx - lag(wx) over w) ** 2 + (wy - lag(wy) over w) ** 2 + (wz - lag(wz) over w) ** 2) as far, count(*) over (partition by sample_id) as n from m window w as (partition by sample_id order by frame_idx)),
    f as (select sample_id, frame_idx, hand, not hand as no_hand, case when frame_idx = 0 then n > 1 else coalesce(far <= 0.05, false) end as still from d),
    u as (select sample_id, frame_idx, 'hand' as kind, hand as flag from f union all select sample_id, frame_idx, 'no_hand', no_hand from f union all select sample_id, frame_idx, 'still', still from f),
    g as (select *, frame_idx - row_number() over (partition by sample_id, kind, flag order by frame_idx) as island from u),
    r as (select sample_id, kind, cast(min(frame_idx) as integer) as "start", count(*) as length from g where flag group by sample_id, kind, island),
    x as (select * from r union all select sample_id, 'startup', "start", length from r where kind = 'no_hand' and "start" = 0 union all select sample_id, 'sequence', 0, count(*) from f group by sample_id)"""


def motion(spark, sf) -> DataFrame:
    return seq.motion_runs(v_joints(spark, sf), quiet=0.05, **SIZE)


@query("ws26_motion_runs", MOTION + ' select sample_id, kind, "start", length from x')
def ws26_runs(spark, sf):
    return motion(spark, sf)


@query("ws26_run_lengths", MOTION + " select kind, count(length) as n, min(length) as min, quantile_cont(length, 0.25) as p25, quantile_cont(length, 0.5) as p50, quantile_cont(length, 0.75) as p75, max(length) as max, round(avg(length), 6) as mean from x group by kind")
def ws26_lengths(spark, sf):
    return rounded(agg.length_stats(motion(spark, sf), "length", ["kind"]), "mean")


@query("ws26_motion_deltas", """
    with d as (select sqrt((seen_x - lag(seen_x) over w) ** 2 + (seen_y - lag(seen_y) over w) ** 2 + (seen_z - lag(seen_z) over w) ** 2) as c, abs(seen_scale - lag(seen_scale) over w) as s from v_seen window w as (partition by sample_id order by frame_idx))
    select round(coalesce(avg(c), 0), 6) as center_delta_mean, round(coalesce(avg(s), 0), 6) as scale_delta_mean from d""")  # fmt: skip
def ws26_deltas(spark, sf):
    return rounded(seq.motion_deltas(v_joints(spark, sf), **SIZE), "center_delta_mean", "scale_delta_mean")


# WS31: parts of five frames

SEAMS = """
    with p as (select sample_id, frame_idx, frame_idx // 5 as part, case (frame_idx // 5) % 4 when 0 then 'sign' when 1 then 'transition' when 2 then 'no_event' else 'sign' end as type, (frame_idx // 5) // 3 % 2 as source, (frame_idx // 5) % 7 = 6 as pad, seen_x, seen_y, seen_z, seen_scale from v_seen),
    sc as (select 'expanded' as scope, * from p union all select 'semantic', * from p where type <> 'transition'),
    l as (select *, lag(part) over w as pp, lag(type) over w as pt, lag(source) over w as ps, lag(pad) over w as pd, sqrt((seen_x - lag(seen_x) over w) ** 2 + (seen_y - lag(seen_y) over w) ** 2 + (seen_z - lag(seen_z) over w) ** 2) as c, abs(seen_scale - lag(seen_scale) over w) as s from sc window w as (partition by scope, sample_id order by frame_idx)),
    x as (select scope, part <> pp as seam, pt || '->' || type as pair, source = ps as same_source, c, s from l where pp is not null and not (scope = 'semantic' and (pad or pd)))"""


def seams(spark, sf) -> DataFrame:
    f = v_joints(spark, sf)
    part = F.expr("frame_idx div 5")
    parts = f.where("frame_idx % 5 = 0").select(
        "sample_id", part.alias("part"), F.lit(5).alias("length"), F.element_at(F.array(*map(F.lit, ("sign", "transition", "no_event", "sign"))), (part % 4 + 1).cast("int")).alias("type"),
        (F.floor(part / 3) % 2).alias("source"), F.when(part % 7 == 6, "pad_post").alias("role"),
    )
    return grouped.typed_seams(parts, f, **SIZE)


@query("ws31_typed_seams", SEAMS + """ select scope, seam, count(*) as steps, round(coalesce(avg(c), 0), 6) as center_delta_mean, round(coalesce(quantile_cont(c, 0.95), 0), 6) as center_delta_p95, round(coalesce(avg(s), 0), 6) as scale_delta_mean, round(coalesce(quantile_cont(s, 0.95), 0), 6) as scale_delta_p95 from x group by scope, seam""")
def ws31_typed(spark, sf):
    return rounded(grouped.seam_deltas(seams(spark, sf)), "center_delta_mean", "center_delta_p95", "scale_delta_mean", "scale_delta_p95")


@query("ws31_seam_counts", SEAMS + " select scope, pair, count(*) as seams, count(*) filter (where same_source) as same_source from x where seam group by scope, pair")
def ws31_counts(spark, sf):
    return grouped.seam_counts(seams(spark, sf))


# WS32

_BOXES = ("[x / 500, score / 2, x / 500 + 0.3, score / 2 + 0.2]", "[0.2, 0.1, 0.5, 0.4]")
STATES = """
    with b as (select sample_id, frame_idx, h1, h2, event_id % 5 = 0 as amb, x / 500 as x0, score / 2 as y0, case when h1 then score / 20 end - case when h2 then (event_id % 9) * 0.01 end as gap from v_frames),
    o as (select *, greatest(least(x0 + 0.3, 0.5) - greatest(x0, 0.2), 0) * greatest(least(y0 + 0.2, 0.4) - greatest(y0, 0.1), 0) as inter from b),
    i as (select *, inter / (0.3 * 0.2 + 0.3 * 0.3 - inter) as iou from o),
    t as (select *, coalesce(iou > 0.03 and gap > 0.0072, false) as l, coalesce(iou > 0.03 and -gap > 0.0072, false) as r, coalesce(bool_or(h1) over p, false) as lb, coalesce(bool_or(h2) over p, false) as rb from i window p as (partition by sample_id order by frame_idx rows between unbounded preceding and 1 preceding)),
    u as (select *, greatest(case when l then frame_idx + 4 end, case when amb and not h1 and lb then frame_idx + 4 end) as lu, greatest(case when r then frame_idx + 4 end, case when amb and not h2 and rb then frame_idx + 4 end) as ru from t),
    m as (select *, cast(greatest(coalesce(max(lu) over w, 0) - frame_idx, 0) as integer) as left_ttl, cast(greatest(coalesce(max(ru) over w, 0) - frame_idx, 0) as integer) as right_ttl from u window w as (partition by sample_id order by frame_idx rows between unbounded preceding and current row))
    select sample_id, frame_idx, left_ttl, right_ttl, left_ttl > 0 as left_occluded, right_ttl > 0 as right_occluded from m"""


@query("ws32_occlusion_states", STATES)
def ws32_states(spark, sf):
    x, s = F.col("x") / 500, F.col("score")
    boxes = ([x, s / 2, x + 0.3, s / 2 + 0.2], [F.lit(v) for v in (0.2, 0.1, 0.5, 0.4)])
    depths = (F.when(F.col("h1"), s / 20), F.when(F.col("h2"), (F.col("event_id") % 9) * 0.01))
    out = seq.occlusion_states(v_frames(spark, sf), *boxes, *depths, F.col("event_id") % 5 == 0, F.col("h1"), F.col("h2"))
    return out.select("sample_id", "frame_idx", "left_ttl", "right_ttl", "left_occluded", "right_occluded")


# AR12: hands that are sided by the pose, then against the last good wrists

_COLUMNS = {
    "left_x": "case when h1 then x / 100 end", "left_y": "case when h1 then score / 2 end", "left_scale": "case when h1 then 3e-1 end",
    "right_x": "case when h2 then (event_id % 50) / 5e1 end", "right_y": "case when h2 then score end", "right_scale": "case when h2 then 4e-1 end",
    "pose_left_x": "case when event_id % 4 <> 0 then 2e-1 end", "pose_left_y": "case when event_id % 4 <> 0 then 3e-1 end", "pose_right_x": "8e-1", "pose_right_y": "3e-1",
    "left_inside": "event_id % 13 <> 0", "right_inside": "event_id % 17 <> 0", "ambiguous": "event_id % 3 = 0",
}


def _far(a: str, b: str) -> str:
    return f"sqrt(({a}x - {b}x) ** 2 + ({a}y - {b}y) ** 2)"


def hands_sql(frames: str) -> str:
    """AR12 over frames (sample_id, frame_idx from 0, spot, and _COLUMNS)."""
    own = lambda h, o: f"coalesce(coalesce(case when {_far(f'g{h}', h)} is not null and {_far(f'g{o}', h)} is not null then {_far(f'g{h}', h)} <= 0.85 * {_far(f'g{o}', h)} end, {_far(f'q{h}', h)} <= 0.85 * {_far(f'q{o}', h)}), false)"
    far = lambda h: f"coalesce({_far(h, f'q{h}')} > 1.5 * greatest({h}s, 0.04), false) or not {h}i"
    return f"""
        with recursive a as ({frames}),
        b as (select sample_id, frame_idx, spot, ambiguous as amb, left_x as lx, left_y as ly, left_scale as ls, right_x as rx, right_y as ry, right_scale as rs, pose_left_x as qlx, pose_left_y as qly, pose_right_x as qrx, pose_right_y as qry, left_inside as li, right_inside as ri from a),
        c as (select *, {_far("l", "ql")} as ll, {_far("l", "qr")} as lr, {_far("r", "ql")} as rl, {_far("r", "qr")} as rr from b),
        d as (select *, coalesce(case when not amb and qlx is not null then case when lx is not null and rx is not null then case when lr + rl < ll + rr then 'swap' else 'keep' end when lx is not null then case when lr < 0.8 * ll then 'move' else 'keep' end when rx is not null then case when rl < 0.8 * rr then 'move' else 'keep' end end end, 'keep') as side from c),
        e as (select * replace ({", ".join(f"case when side = 'keep' then {a}{k} else {b}{k} end as {a}{k}" for a, b in ("lr", "rl") for k in "xys")}) from d),
        f as (select sample_id, frame_idx, spot, amb, side, qlx, qly, qrx, qry, {", ".join(f"case when not ({far(h)}) then {h}{k} end as {h}{k}" for h in "lr" for k in "xy")} from e),
        s as (
          select sample_id, -1 as frame_idx, cast(null as bigint) as spot, '' as side, false as swapped, false as lok, false as rok, {", ".join(f"cast(null as double) as {p}" for p in ("lx", "ly", "rx", "ry", "glx", "gly", "grx", "gry"))} from (select distinct sample_id from f)
          union all
          select sample_id, frame_idx, spot, side, swapped, lok, rok, lx, ly, rx, ry, case when lok then lx else glx end, case when lok then ly else gly end, case when rok then rx else grx end, case when rok then ry else gry end
          from (select *, {own("l", "r")} as lok, {own("r", "l")} as rok
                from (select sample_id, frame_idx, spot, side, swapped, glx, gly, grx, gry, qlx, qly, qrx, qry, {", ".join(f"case when swapped then {b}{k} else {a}{k} end as {a}{k}" for a, b in ("lr", "rl") for k in "xy")}
                      from (select f.*, s.glx, s.gly, s.grx, s.gry, f.amb and coalesce({_far("s.gl", "f.r")} + {_far("s.gr", "f.l")} < 0.85 * ({_far("s.gl", "f.l")} + {_far("s.gr", "f.r")}), false) as swapped
                            from s join f on f.sample_id = s.sample_id and f.frame_idx = s.frame_idx + 1))))"""


_ASSOCIATED = "side, swapped, lok as left_accepted, rok as right_accepted, round(lx, 6) as left_x, round(ly, 6) as left_y, round(rx, 6) as right_x, round(ry, 6) as right_y from s where frame_idx >= 0"
_SELECT = ", ".join(f"{v} as {k}" for k, v in _COLUMNS.items())


@query("ar12_associate_hands", hands_sql(f"select sample_id, frame_idx, event_id as spot, {_SELECT} from v_frames") + f" select sample_id, frame_idx, {_ASSOCIATED}")
def ar12_machine(spark, sf):
    f = v_frames(spark, sf).select("sample_id", "frame_idx", *[F.expr(v).alias(k) for k, v in _COLUMNS.items()])
    return rounded(grouped.associate_hands(f), "left_x", "left_y", "right_x", "right_y")


@query("ar12_stream_hands", hands_sql(f"select sample_id, frame_idx, event_id as spot, {_SELECT} from v_ordered") + f" select sample_id as session_id, spot as frame_idx, {_ASSOCIATED}")
def ar12_stream(spark, sf):
    e = events_stream(spark, sf).withColumns({"x": F.col("value"), "event_id": F.col("frame_idx"), "h1": F.col("event_type") != "error", "h2": ~F.col("event_type").isin("error", "view"), "score": F.least(F.col("value") / 100, F.lit(1.0))})
    frames = e.select("session_id", "frame_idx", "ts", *[F.expr(v).alias(k) for k, v in _COLUMNS.items()])
    return rounded(taken(stateful.stream_hands(frames)), "left_x", "left_y", "right_x", "right_y")


# JN11, AG28

def greedy_sql(begins: str) -> str:
    """gm (k, tp) of begins (k, spot, near: list): in order of place each takes the nearest place in near that is free, the earlier of two."""
    pick = "list_sort(list_transform(list_filter(b.near, lambda v: not list_contains(g.used, v)), lambda v: {'far': abs(v - b.spot), 'v': v}))[1].v"
    return f"""bb as (select *, row_number() over (partition by k order by spot) as i from ({begins})),
        gs as (select k, cast(0 as bigint) as i, cast([] as bigint[]) as used, cast(null as bigint) as pick from (select distinct k from bb) union all
               select k, i, case when pick is null then used else list_append(used, pick) end, pick from (select b.k, b.i, g.used, cast({pick} as bigint) as pick from gs g join bb b on b.k = g.k and b.i = g.i + 1)),
        gm as (select k, count(pick) as tp from gs group by k)"""


@query("jn11_match_boundaries", f"""
    with recursive f as (select sample_id, cast(frame_idx as bigint) as spot, y, p, list(case when y = 1 then cast(frame_idx as bigint) end) over (partition by sample_id order by frame_idx range between 2 preceding and 2 following) as near from v_bio where y = 1 or p = 1),
    {greedy_sql("select sample_id as k, spot, list_filter(near, lambda v: v is not null) as near from f where p = 1")}
    select sample_id, coalesce(tp, 0) as tp, count(*) filter (where p = 1) - coalesce(tp, 0) as fp, count(*) filter (where y = 1) - coalesce(tp, 0) as fn from f left join gm on gm.k = f.sample_id group by sample_id, tp""")  # fmt: skip
def jn11(spark, sf):
    return joins.match_boundaries(v_bio(spark, sf), "y", "p", 2)


THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
SWEEP = f"""
    with recursive v as (select *, min(case when vis2 then frame_idx - 1 end) over (partition by sample_id) as fv from (select b.*, h1 and coalesce(lag(h1) over (partition by sample_id order by frame_idx), false) as vis2 from v_bio b)),
    x as (select v.*, sample_id % 9 as signer, cast(frame_idx as bigint) as spot, coalesce(frame_idx < fv, true) as startup, thr, case when pb >= thr then 1 when po >= pi then 0 else 2 end as t from v, (select cast(unnest([{", ".join(map(str, THRESHOLDS))}]) as double) as thr)),
    w as (select *, coalesce(last_value(case when y <> 2 then y end ignore nulls) over b, 0) = 1 as oy, coalesce(last_value(case when t <> 2 then t end ignore nulls) over b, 0) = 1 as ot, lag(y) over b <> y as my, lag(t) over b <> t as mt,
                 case when y = 1 then least(spot - last_value(case when t = 1 then spot end ignore nulls) over b, first_value(case when t = 1 then spot end ignore nulls) over a - spot) end as err,
                 list_filter(list(case when y = 1 then spot end) over (partition by sample_id, thr order by spot range between 2 preceding and 2 following), lambda q: q is not null) as near
          from x window b as (partition by sample_id, thr order by spot rows between unbounded preceding and current row), a as (partition by sample_id, thr order by spot rows between current row and unbounded following)),
    {greedy_sql("select {'s': sample_id, 't': thr} as k, spot, near from w where t = 1")},
    c0 as (select sample_id, thr, signer, count(*) as n, count(*) filter (where y = 1) as bt, count(*) filter (where t = 1) as bp, count(*) filter (where y = 1 or (y = 2 and oy)) as it, count(*) filter (where t = 1 or (t = 2 and ot)) as ip, count(*) filter (where y = 2 and not oy) as vt, count(*) filter (where t = 2 and not ot) as vp,
                 count(*) filter (where my) as mvt, count(*) filter (where mt) as mvp, sum(err) as es, count(err) as em, coalesce(min(err) <= 2, false) as cov, bool_or((y = 1 or (y = 2 and oy)) and (t = 1 or (t = 2 and ot))) as hit, count(*) filter (where startup and t = 1) as early, count(*) filter (where startup) as blind, count(*) filter (where startup and t <> 0) as ba
          from w group by sample_id, thr, signer),
    c as (select c0.*, coalesce(tp, 0) as tp from c0 left join gm on gm.k.s = sample_id and gm.k.t = thr),
    mac as (select thr, avg(h) as mac from (select thr, signer, avg(case when hit then 1.0 else 0.0 end) as h from c where bt > 0 group by all) group by thr),
    tot as (select thr, sum(n) as n, sum(bt) as bt, sum(bp) as bp, sum(it) as it, sum(ip) as ip, sum(vt) as vt, sum(vp) as vp, sum(tp) as tp, sum(es) as es, sum(em) as em, sum(early) as early, sum(blind) as blind, sum(ba) as ba, avg(mvt / greatest(n - 1, 1)) as rt, avg(mvp / greatest(n - 1, 1)) as rp,
                   count(*) filter (where bt > 0 and hit) / greatest(count(*) filter (where bt > 0), 1) as hr, count(*) filter (where bt > 0 and cov) / greatest(count(*) filter (where bt > 0), 1) as sc, count(*) filter (where bt > 0 and bp = 0) / greatest(count(*) filter (where bt > 0), 1) as sr, avg(case when early > 0 then 1.0 else 0.0 end) as ss from c group by thr),
    m as (select thr as threshold, 2 * (tp / (bp + 1e-9)) * (tp / (bt + 1e-9)) / (tp / (bp + 1e-9) + tp / (bt + 1e-9) + 1e-9) as b_f1, bp / (bt + 1e-9) as pred_b_ratio, case when it > 0 then (ip / greatest(bp, 1)) / (it / greatest(bt, 1)) when ip <= 0 then 1 else 'inf'::double end as seg_ratio, it / greatest(bt, 1) as true_length,
                 coalesce(es / greatest(em, 1), 0) as b_err, abs(rp - rt) as transition_err, abs((vp - vt) / n) as violation_err, early / greatest(bp, 1) as startup_false_start, ba / greatest(blind, 1) as startup_active, hr as hit_rate, sc as start_cover, coalesce(mac, 0) as signer_macro, sr as silent_rate, ss as startup_segment from tot left join mac using (thr)),
    s as (select *, b_f1 - 0.10 * case when seg_ratio > 0 then abs(ln(seg_ratio)) else 1.5 end - 0.75 * transition_err - 0.05 * b_err / greatest(1, true_length) - violation_err - 1.5 * startup_false_start - 0.75 * startup_active as balanced_score,
                 hit_rate + 0.5 * start_cover + 0.25 * signer_macro - 0.9 * silent_rate - 0.6 * startup_segment as recall_safe_score, pred_b_ratio between 0.85 and 1.15 and seg_ratio between 0.80 and 1.25 and startup_segment <= 0.05 as guarded from m)"""
MEASURED = ("b_f1", "pred_b_ratio", "seg_ratio", "true_length", "b_err", "transition_err", "violation_err", "startup_false_start", "startup_active", "hit_rate", "start_cover", "signer_macro", "silent_rate", "startup_segment", "balanced_score", "recall_safe_score")


@query("ag28_sweep_ranks", SWEEP + f"""
    select threshold, {", ".join(f"round(cast({c} as double), 6) as {c}" for c in MEASURED)}, guarded, cast(row_number() over (order by balanced_score desc, b_f1 desc, b_err, threshold) as integer) as balanced_rank,
           cast(row_number() over (order by recall_safe_score desc, hit_rate desc, silent_rate, startup_segment, threshold) as integer) as recall_safe_rank, cast(row_number() over (order by b_f1 desc, b_err, abs(pred_b_ratio - 1), transition_err, violation_err, threshold) as integer) as boundary_rank from s""")  # fmt: skip
def ag28_sweep(spark, sf):
    frames = v_bio(spark, sf).withColumn("signer", F.col("sample_id") % 9)
    return rounded(evaluate.rank_thresholds(evaluate.sweep_metrics(frames, "y", THRESHOLDS, "h1", "signer", stable=2)), *MEASURED)


# ST8

def done_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select((F.col("user_id") % 20).alias("shard"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))


@query("st8_finish_rates", """
    select user_id % 20 as shard, time_bucket(interval 15 seconds, ts, timestamp '1970-01-01') as "start", count(*) as done, count(*) filter (where event_type = 'error') as failed, round(count(*) / 15, 4) as rate from events group by 1, 2""")  # fmt: skip
def st8_rates(spark, sf):
    return stateful.finish_rates(done_rows(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st8_finish_eta", """
    with t as (select user_id % 20 as shard, count(*) * 2 + 7 as selected, min(ts) - interval 30 seconds as started from events group by 1),
    d as (select user_id % 20 as shard, count(*) as done, count(*) filter (where event_type = 'error') as failed, max(ts) as last from events group by 1),
    e as (select *, epoch_us(last) / 1e6 - epoch_us(started) / 1e6 as el, greatest(0, selected - done) as rem from d join t using (shard))
    select shard, done, done - failed as ok, failed, rem as remaining, round(el, 3) as elapsed_sec, round(el / done, 3) as sec_per_sample, round(done / el, 4) as rate, round(rem / (done / el), 3) as eta_sec from e""")  # fmt: skip
def st8_eta(spark, sf):
    d = done_rows(spark, sf)
    shards = d.groupBy("shard").agg((F.count("*") * 2 + 7).alias("selected"), (F.min("ts") - F.expr("interval 30 seconds")).alias("started_at"))
    return stateful.finish_eta(d, shards)

