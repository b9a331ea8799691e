"""Stateful operators on live frame streams, keyed by session; each runs the step machine of its batch twin on kept state.

Within a micro-batch a session's rows are sorted by their index; rows at or before the last one handled are dropped and
counted. A machine's fields are typed state: numbers and texts in a value state, sequences in list states, tables in map
states. A session ends, and all its state goes, by an event-time timer once the watermark has passed its last row by the
idle time. Streams need the RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import joints
from ..operators import grouped

Rows = list[dict]


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the session's streaming state in RocksDB, which typed state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Kept:
    """The state of a machine: DDL of its scalar fields, of its lists' elements, and of its tables' keys and values."""

    scalars: str = ""
    lists: dict[str, str] = field(default_factory=dict)
    maps: dict[str, tuple[str, str]] = field(default_factory=dict)


class Session(StatefulProcessor):
    """Runs a machine of each session: make builds it from its saved fields ({} at first), step takes a row, end flushes it."""

    def __init__(self, make: Callable[[dict], object], step: Callable[[object, dict], Rows], end: Callable[[object], Rows] | None, kept: Kept, columns: list[str], key: str, order: str, ts: str, idle_ms: int) -> None:
        self.make, self.step, self.end, self.kept, self.columns, self.key, self.order, self.ts, self.idle_ms = make, step, end, kept, columns, key, order, ts, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "last long, late long, timer long")
        self.names = [x.split()[0] for x in self.kept.scalars.split(", ")] if self.kept.scalars else []
        self.scalars = handle.getValueState("machine", self.kept.scalars) if self.names else None
        self.lists = {name: handle.getListState(name, ddl) for name, ddl in self.kept.lists.items()}
        self.maps = {name: handle.getMapState(name, *ddl) for name, ddl in self.kept.maps.items()}

    def _saved(self) -> dict:
        saved = dict(zip(self.names, self.scalars.get(), strict=True)) if self.names and self.scalars.exists() else {}
        saved |= {name: [tuple(x) for x in state.get()] for name, state in self.lists.items() if state.exists()}
        return saved | {name: {k[0]: tuple(v) for k, v in state.iterator()} for name, state in self.maps.items() if state.exists()}

    def _save(self, machine: object) -> None:
        if self.names:
            self.scalars.update(tuple(getattr(machine, name) for name in self.names))
        for name, state in self.lists.items():
            if held := [tuple(x) for x in getattr(machine, name)]:
                state.put(held)
            else:
                state.clear()
        for name, state in self.maps.items():
            held = getattr(machine, name)
            for k in [k for k in state.keys() if k[0] not in held] if state.exists() else []:
                state.removeKey(k)
            for k, v in held.items():
                state.updateValue((k,), tuple(v))

    def _rows(self, key: tuple, rows: Rows, late: int) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([{self.key: key[0]} | r | {"late_rows": late} for r in rows], columns=self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, late, timer = self.progress.get() if self.progress.exists() else (None, 0, None)
        machine, out, newest = self.make(self._saved()), [], None
        got = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        newest = int(got[self.ts].max().value // 1_000_000)
        for r in got.to_dict("records"):
            if last is not None and r[self.order] <= last:
                late += 1
                continue
            last = int(r[self.order])
            out += self.step(machine, r)
        self._save(machine)
        ends = max(newest + self.idle_ms, timer or 0)
        if ends != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
        self.progress.update((last, late, ends))
        yield from self._rows(key, out, late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, late, timer = self.progress.get() if self.progress.exists() else (None, 0, None)
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        out = self.end(self.make(self._saved())) if self.end else []
        for state in (self.progress, *([self.scalars] if self.names else []), *self.lists.values(), *self.maps.values()):
            state.clear()
        yield from self._rows(key, out, late)

    def close(self) -> None:
        pass


def run_machine(
    stream: DataFrame,
    make: Callable[[dict], object],
    step: Callable[[object, dict], Rows],
    schema: str,
    kept: Kept,
    key: str = "session_id",
    order: str = "frame_idx",
    ts: str = "ts",
    end: Callable[[object], Rows] | None = None,
    idle_ms: int = 60_000,
    delay: str = "10 seconds",
    late: bool = False,
) -> DataFrame:
    """Rows that a machine of each session gives; with late, each row has late_rows, the rows dropped from its session so far."""
    use_rocksdb(stream.sparkSession)
    kind = T.StructType.fromDDL(schema)
    out = T.StructType([T.StructField(key, stream.schema[key].dataType), *kind, T.StructField("late_rows", T.LongType())])
    rows = stream.withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(Session(make, step, end, kept, out.names, key, order, ts, idle_ms), out, "append", "EventTime")
    return rows if late else rows.drop("late_rows")


def late_counts(spark: SparkSession, checkpoint: str, key: str = "session_id") -> DataFrame:
    """(key, last, late): of each session that is still open, the last row handled and the number of late rows, from a stream's written state."""
    state = spark.read.format("statestore").option("stateVarName", "progress").load(checkpoint)
    return state.select(F.col(f"key.{key}").alias(key), "value.last", "value.late")


SEGMENT = "start long, end_excl long, score double, mean_inside double, end_reason string"


DECODER = Kept("opened long, last long, idle int, wait int, visible int, best double, inside double, frames long")


def stream_segments(frames: DataFrame, end_of_stream: str = "close", late: bool = False, **config) -> DataFrame:
    """ST1, ST2: segments of frames (session_id, frame_idx, ts, pb, pi, visible, and active and onset if there); an open one is closed or dropped when its session ends."""
    gates = [c for c in ("active", "onset") if c in frames.columns]

    def step(m, r: dict) -> Rows:
        found = m.step(int(r["frame_idx"]), float(r["pb"]), float(r["pi"]), bool(r["visible"]), **{c: None if pd.isna(r[c]) else float(r[c]) for c in gates})
        return [found] if found else []

    def end(m) -> Rows:
        found = m.end() if end_of_stream == "close" else None
        return [found] if found else []

    return run_machine(frames, lambda saved: grouped.Decoder(**(config | saved)), step, SEGMENT, DECODER, end=end, late=late)


def open_segments(spark: SparkSession, checkpoint: str, key: str = "session_id", min_length: int = grouped.Decoder.min_length) -> DataFrame:
    """ST2: the segments that a finished run of stream_segments() has left open, closed, from the state that it has written.

    A bounded input ends before its last watermark lets sessions end; these rows and the run's are all segments.
    """
    state = spark.read.format("statestore").option("stateVarName", "machine").load(checkpoint)
    m = state.select(F.col(f"key.{key}").alias(key), "value.*").where(F.col("opened").isNotNull() & (F.col("last") + 1 - F.col("opened") >= min_length))
    return m.select(key, F.col("opened").alias("start"), (F.col("last") + 1).alias("end_excl"), F.col("best").alias("score"), (F.col("inside") / F.col("frames")).alias("mean_inside"), F.lit("eos_closed").alias("end_reason"))


CENTER = "center_x double, center_y double, center_z double, scale double"


def stream_normalize(frames: DataFrame, hand: int = joints.HAND, least: int = joints.LEAST_JOINTS, late: bool = False) -> DataFrame:
    """ST3: frames (session_id, frame_idx, ts, points, mask) normalised by running centre and scale, as causal_normalize() does.

    What a frame says about them is an expression before the state, and the normalising one after it: four doubles are kept.
    """
    seen = joints.with_candidates(frames.select("session_id", "frame_idx", "ts", "points", "mask"), "points", "mask", hand, least)

    def step(m, r: dict) -> Rows:
        value = lambda c: None if pd.isna(r[c]) else float(r[c])
        m.step([value(c) for c in ("seen_x", "seen_y", "seen_z")], value("seen_scale"))
        return [{"frame_idx": int(r["frame_idx"]), "points": r["points"], "mask": r["mask"]} | {c: getattr(m, c) for c in ("center_x", "center_y", "center_z", "scale")}]

    made = run_machine(seen, lambda saved: grouped.CausalNormalizer(**saved), step, f"frame_idx long, points {joints.POINTS}, mask array<double>, {CENTER}", Kept(CENTER), late=late)
    return joints.normalized(made)


@dataclass
class Euros:
    """One filter for each joint; a joint that is missing keeps its state."""

    config: dict = field(default_factory=dict)
    joints: dict = field(default_factory=dict)

    def step(self, t: float, xs: list) -> list:
        out = []
        for j, x in enumerate(xs):
            if x is None or pd.isna(x):
                out.append(None)
                continue
            f = grouped.OneEuro(**self.config, **dict(zip(("t", "x", "dx"), self.joints.get(j, ()), strict=False)))
            out.append(float(f.step(t, float(x))))
            self.joints[j] = (float(f.t), float(f.x), float(f.dx))
        return out


def stream_one_euro(frames: DataFrame, late: bool = False, **config) -> DataFrame:
    """ST4: smoothed coordinates of frames (session_id, frame_idx, ts, ts_ms, xs array<double>), one filter for each place in xs."""

    def step(m, r: dict) -> Rows:
        return [{"frame_idx": int(r["frame_idx"]), "smooth": m.step(float(r["ts_ms"]), list(r["xs"]))}]

    kept = Kept(maps={"joints": ("joint int", "t double, x double, dx double")})
    return run_machine(frames, lambda saved: Euros(config, **saved), step, "frame_idx long, smooth array<double>", kept, late=late)


def stream_words(preds: DataFrame, late: bool = False, **config) -> DataFrame:
    """ST5: accepted words of predictions (session_id, frame_idx, ts, label, conf, start_ms, end_ms). The sentence isn't kept in state."""

    def step(m, r: dict) -> Rows:
        ok = m.step(r["label"], float(r["conf"]), float(r["start_ms"]), float(r["end_ms"]))
        m.sentence.clear()
        return [{"start_ms": int(r["start_ms"]), "label": r["label"]}] if ok else []

    return run_machine(preds, lambda saved: grouped.Words(**(config | saved)), step, "start_ms long, label string", Kept("word string, ended double"), late=late)


@dataclass
class ClipBuffer:
    """Recent frames and segments, by start, that wait for theirs; a clip is given once frame end + post - 1 has come."""

    pre: int = 2
    post: int = 2
    most: int = 64
    frames: list = field(default_factory=list)
    pending: dict = field(default_factory=dict)

    def step(self, idx: int, x: float, segment: list | None) -> Rows:
        self.frames.append((idx, x))
        if segment is not None:
            self.pending[segment[0]] = (segment[1],)
        ready = [s for s, (e,) in self.pending.items() if e + self.post - 1 <= idx]
        out = [self._clip(s, self.pending.pop(s)[0]) for s in sorted(ready)]
        first = min([idx - self.most + 1, *(s - self.pre for s in self.pending)])
        self.frames = [f for f in self.frames if f[0] >= first]
        return out

    def _clip(self, start: int, end: int) -> dict:
        held = [f for f in self.frames if start - self.pre <= f[0] < end + self.post]
        return {"start": start, "end_excl": end, "clip_start": held[0][0] if held else None, "clip": [f[1] for f in held]}

    def end(self) -> Rows:
        return [self._clip(s, e) for s, (e,) in sorted(self.pending.items())]


def stream_clips(frames: DataFrame, pre: int = 2, post: int = 2, most: int = 64, late: bool = False) -> DataFrame:
    """ST6: clips with context of frames (session_id, frame_idx, ts, x, seg_start, seg_end): a segment, if any, comes with the frame that closed it."""

    def step(m, r: dict) -> Rows:
        seg = None if pd.isna(r["seg_start"]) else [int(r["seg_start"]), int(r["seg_end"])]
        return m.step(int(r["frame_idx"]), float(r["x"]), seg)

    kept = Kept(lists={"frames": "idx long, x double"}, maps={"pending": ("start long", "end long")})
    return run_machine(frames, lambda saved: ClipBuffer(pre, post, most, **saved), step, "start long, end_excl long, clip_start long, clip array<double>", kept, end=lambda m: m.end(), late=late)


@dataclass
class LookBack:
    """The last frames, the newest last."""

    most: int = 2
    held: list = field(default_factory=list)

    def step(self, points: list, mask: list) -> list:
        before, self.held = self.held, [*self.held, (points, mask)][-self.most :]
        return before


def stream_features(frames: DataFrame, hand: int = joints.HAND, late: bool = False) -> DataFrame:
    """ST9: the features of frames (session_id, frame_idx, ts, points, mask) on a look-back of three, as frame_features() has them.

    The state is the last two frames; the features are an expression on a frame and those.
    """

    def plain(points) -> list:
        return [tuple(p[c] for c in "xyz") for p in points]

    def step(m, r: dict) -> Rows:
        points, mask = plain(r["points"]), [float(x) for x in r["mask"]]
        before = [None, None, *m.step(points, mask)][-2:]
        named = lambda x: None if x is None else [dict(zip("xyz", p, strict=True)) for p in x[0]]
        row = {"frame_idx": int(r["frame_idx"]), "points": named((points,)), "mask": mask}
        return [row | {"points_1": named(before[1]), "mask_1": before[1] and list(before[1][1]), "points_2": named(before[0]), "mask_2": before[0] and list(before[0][1])}]

    one = f"points{{0}} {joints.POINTS}, mask{{0}} array<double>"
    schema = "frame_idx long, " + ", ".join(one.format(x) for x in ("", "_1", "_2"))
    clean = frames.select("session_id", "frame_idx", "ts", joints.clean_points("points").alias("points"), joints.clean_mask("mask").alias("mask"))
    made = run_machine(clean, lambda saved: LookBack(**saved), step, schema, Kept(lists={"held": f"points {joints.POINTS}, mask array<double>"}), late=late)
    stay = ["session_id", "frame_idx", *(["late_rows"] if late else [])]
    return made.select(*stay, joints.frame_features(made, hand).alias("f")).select(*stay, "f.*")


def stream_hands(frames: DataFrame, late: bool = False, **config) -> DataFrame:
    """AR12 on a stream: the sides of frames (session_id, frame_idx, ts and the columns of sided_hands()) as associate_hands() gives them."""
    need = ["session_id", "frame_idx", "ts", "side", "ambiguous", *[f"{p}{h}_{c}" for p in ("", "pose_") for h in grouped.HANDS for c in "xy"]]

    def step(m, r: dict) -> Rows:
        return [{"frame_idx": int(r["frame_idx"]), "side": r["side"]} | grouped.association_row(m, r)]

    kept = Kept("left_x double, left_y double, right_x double, right_y double")
    return run_machine(grouped.sided_hands(frames).select(need), lambda saved: grouped.Association(**(config | saved)), step, f"frame_idx long, {grouped.ASSOCIATED}", kept, late=late)


def session_windows(events: DataFrame, gap: str, key: str = "session_id", ts: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """ST7: activity periods that end after a gap, with their number of events; batch or stream."""
    df = events.withWatermark(ts, delay) if events.isStreaming else events
    w = F.session_window(ts, gap)
    return df.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_status(events: DataFrame) -> DataFrame:
    """ST8: the latest status of each shard; in a stream in update mode."""
    return events.groupBy("shard").agg(F.max_by(F.struct("selected", "processed", "failed"), F.struct("ts", "processed")).alias("s")).select("shard", "s.*")


def progress_rollup(latest: DataFrame) -> DataFrame:
    """ST8: totals over the shards' latest statuses."""
    return latest.agg(F.count("*").alias("shards"), F.sum("selected").alias("selected"), F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.sum(F.col("selected") - F.col("processed") - F.col("failed")).alias("remaining"))


def finish_rates(done: DataFrame, seconds: int = 15, delay: str = "1 minute", ts: str = "ts", failed: str = "failed") -> DataFrame:
    """ST8: samples finished and failed by shard in tumbling windows of event time, and their number a second; batch, or stream in update mode.

    done: a row (shard, ts, failed boolean) for each finished sample.
    """
    df = done.withWatermark(ts, delay) if done.isStreaming else done
    counts = df.groupBy("shard", F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("done"), F.count_if(failed).alias("failed"))
    return counts.select("shard", F.col("w.start").alias("start"), "done", "failed", F.round(F.col("done") / seconds, 4).alias("rate"))


def finish_eta(done: DataFrame, shards: DataFrame, ts: str = "ts", failed: str = "failed") -> DataFrame:
    """ST8: by shard how many samples are done, ok, failed and remain, the elapsed seconds, samples a second, seconds a sample, and seconds to the end.

    shards: (shard, selected, started_at), a small static table; batch, or stream in update mode. A rate is null while no time has passed.
    """
    counts = done.groupBy("shard").agg(F.count("*").alias("done"), F.count_if(failed).alias("failed"), F.max(ts).alias("last"))
    known = counts.join(shards.select("shard", "selected", "started_at"), "shard")
    elapsed = F.greatest(F.lit(0.0), (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6)
    rate, remaining = F.col("done") / F.nullif(elapsed, F.lit(0.0)), F.greatest(F.lit(0), F.col("selected") - F.col("done"))
    return known.select(
        "shard", "done", (F.col("done") - F.col("failed")).alias("ok"), "failed", remaining.alias("remaining"), F.round(elapsed, 3).alias("elapsed_sec"),
        F.round(elapsed / F.col("done"), 3).alias("sec_per_sample"), F.round(rate, 4).alias("rate"), F.round(remaining / rate, 3).alias("eta_sec"),
    )


def error_summary(events: DataFrame, error: str) -> DataFrame:
    """ST8: errors by count, then name."""
    return events.where(F.col(error).isNotNull()).groupBy(error).agg(F.count("*").alias("n")).orderBy(F.desc("n"), error)


LEDGER = "batch long, rows long, existing long, fresh long, level int, first long"


def _ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row for each batch (level 0) and each merge of batches first to batch; what it doesn't list isn't there yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger/*") if found else spark.createDataFrame([], LEDGER)


def _record(spark: SparkSession, root: str, row: tuple) -> None:
    """Write a row of the ledger; its folder has its name, so that the same row written again replaces itself."""
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/{row[4]}-{row[0]}")


def _live(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(level, batch) of the folders that hold the present, oldest first: the largest merges, and the batches after them."""
    out, covered = [], -1
    merges = _ledger(spark, root).where("level > 0").select("level", "first", "batch").collect()
    for level, first, batch in sorted(merges, key=lambda r: (r[1], -r[2])):
        if first > covered:
            out.append((level, batch))
            covered = batch
    return out + sorted((0, r.batch) for r in _ledger(spark, root).where((F.col("level") == 0) & (F.col("batch") > covered)).select("batch").collect())


def _folder(root: str, level: int, batch: int) -> str:
    return f"{root}/level={level}/batch={batch}"


def upsert_stream(stream: DataFrame, root: str, key: str, checkpoint: str, order: str = "ts"):
    """ST10: each micro-batch replaces the rows of its keys, of several rows of a key the last by `order`.

    A batch is a folder of its own, and then a row of the run ledger: how many rows it wrote, and how many of its keys were
    there before. A batch that the ledger lists isn't written again, so that a replayed one changes nothing, and one that
    was cut off is written anew and unseen until then. Returns the query; read_current() reads what it has written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import Window as W

        spark = batch.sparkSession
        if not _ledger(spark, root).where((F.col("level") == 0) & (F.col("batch") == batch_id)).isEmpty():
            return
        rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
        batch.withColumn("__rank", rank).where("__rank = 1").drop("__rank").write.mode("overwrite").parquet(_folder(root, 0, batch_id))
        rows = spark.read.schema(batch.schema).parquet(_folder(root, 0, batch_id))
        before = read_current(spark, root, key)
        n, existing = rows.count(), 0 if before is None else rows.join(before.select(key), key, "left_semi").count()
        _record(spark, root, (batch_id, n, existing, n - existing, 0, batch_id))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def run_ledger(spark: SparkSession, root: str) -> DataFrame:
    """ST10: (batch, rows, existing, fresh) of each batch that was written."""
    return _ledger(spark, root).where("level = 0").select("batch", "rows", "existing", "fresh")


def _newest(spark: SparkSession, root: str, key: str, folders: list[tuple[int, int]]) -> DataFrame:
    parts = [spark.read.parquet(_folder(root, *f)).withColumn("__at", F.lit(f[1])) for f in folders]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "__at")]), "__at").alias("r")).select(key, "r.*")


def read_current(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """ST10: of each key the row of the last batch that has one, from the largest merges and the batches after them; None before the first batch."""
    folders = _live(spark, root)
    return _newest(spark, root, key, folders) if folders else None


def compact(spark: SparkSession, root: str, key: str, fanout: int = 4) -> DataFrame | None:
    """ST10: merge every `fanout` neighbouring folders of a level into one of the next, as long as there are so many; what read_current() gives stays.

    The stream may go on meanwhile: batches and merges are new folders, seen once the ledger lists them. One compaction at
    a time. A reader then opens some fanout x log(batches) folders.
    """
    while True:
        live = _live(spark, root)
        same = next((live[i : i + fanout] for i in range(len(live) - fanout + 1) if len({level for level, _ in live[i : i + fanout]}) == 1), None)
        if same is None:
            return read_current(spark, root, key)
        level, last = same[0][0] + 1, same[-1][1]
        _newest(spark, root, key, same).write.mode("overwrite").parquet(_folder(root, level, last))
        at = live.index(same[0])
        _record(spark, root, (last, 0, 0, 0, level, live[at - 1][1] + 1 if at else 0))
