"""File layouts, round trips, and streams that must give what their batch twins give."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinema.functions import joints
from kinema.operators import grouped
from kinema.sources import files
from kinema.streaming import stateful


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("d", files.DELIMITERS)
def test_scan_delimited(spark, tmp_path, d):
    p = write(tmp_path / "a.csv", "﻿" + d.join(["attachment_id", "text", "begin"]) + "\n" + d.join(["v1", "hello", "3"]) + "\n")
    assert [tuple(r) for r in files.scan_delimited(spark, p).collect()] == [("v1", "hello", "3")]


def test_lists_and_manifests(spark, tmp_path):
    p = write(tmp_path / "l.txt", "video,label,id,t_start,t_end,frames\nv1,G01,2,1,50,50\nshort,row\nv2,G02,3,51,60,10\n")
    assert [tuple(r) for r in files.scan_interval_list(spark, p).collect()] == [("v1", "G01", 2, 1, 50, 50), ("v2", "G02", 3, 51, 60, 10)]
    layouts = ['{"id": "a", "split": "train"}\nnot json\n{"id": "b", "split": "val"}\n', '[{"id": "a", "split": "train"}, {"sample_id": "b", "split": "val"}]', '{"items": [{"id": "a", "split": "train"}, {"id": "b", "split": "val"}]}', '{"a": "train", "b": "val"}', '{"a": {"split": "train"}, "b": {"split": "val"}}']
    for i, text in enumerate(layouts):
        got = files.scan_manifest(spark, write(tmp_path / f"m{i}.json", text)).select("id", "split").orderBy("id").collect()
        assert [tuple(r) for r in got] == [("a", "train"), ("b", "val")], text
    with pytest.raises(Exception, match="bad manifest line"):
        files.scan_manifest(spark, str(tmp_path / "m0.json"), strict=True).collect()


def test_frame_documents(spark, tmp_path):
    frames = [{"ts": 0.0, "hand 1": [[1, 2]]}, {"ts": 40.0}]
    docs = tmp_path / "docs"
    docs.mkdir()
    write(docs / "s1.json", json.dumps({"meta": {"fps": 25}, "frames": frames}))
    write(docs / "s2.json", json.dumps(frames))
    write(docs / "all.json", json.dumps({"videos": {"s3": {"meta": {}, "frames": frames[:1]}}}))
    got = files.scan_frame_json(spark, str(docs)).select("id", "frame_idx", F.variant_get("frame", "$.ts", "double").alias("ts")).orderBy("id", "frame_idx").collect()
    assert [tuple(r) for r in got] == [("s1", 0, 0.0), ("s1", 1, 40.0), ("s2", 0, 0.0), ("s2", 1, 40.0), ("s3", 0, 0.0)]
    p = write(tmp_path / "f.jsonl", json.dumps(frames[0]) + "\n[1]\n")
    with pytest.raises(Exception, match="not a frame object"):
        files.scan_frame_jsonl(spark, p).collect()
    doc = spark.createDataFrame([('{"meta": 1, "hand 1": [2], "junk": 3}',)], "d string")
    assert json.loads(files.compact_keys(doc, "d", ["meta", "hand 1", "gone"]).first().d) == {"meta": 1, "hand 1": [2]}


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", [0.5, 0.5]), (2, "val", [1.0])], "id int, split string, probs array<double>")
    files.write_predictions(df, str(tmp_path / "p"))
    assert sorted(map(tuple, files.read_predictions(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, df.collect()))
    files.write_manifest_by_split(df.drop("probs"), str(tmp_path / "m"), "id")
    assert spark.read.csv(str(tmp_path / "m/by_split"), sep="\t", header=True).count() == 2
    marks = spark.createDataFrame([(1, "raw", 0), (1, "pp", 0)], "sample_id int, variant string, frame_idx int")
    files.write_artifact(df, marks.drop("variant"), marks, str(tmp_path / "a"))
    assert {r.group for r in spark.read.parquet(str(tmp_path / "a/landmarks")).collect()} == {"1/raw", "1/pp"}


def points_of(i, s):
    """Six joints, three a hand, of frame i of session s, and their mask."""
    return [{"x": ((i * 29 + s + 7 * j) % 50) / 10, "y": ((i * 13 + j) % 11) / 5, "z": j / 10} for j in range(6)], [float((i + j) % 4 > 0) for j in range(6)]


ROWS = [
    {"session_id": s, "frame_idx": i, "ts": datetime(2024, 1, 1) + timedelta(milliseconds=40 * i), "ts_ms": 40 * i, "pb": (i * 37 + s * 11) % 100 / 100, "pi": (i * 53) % 100 / 100, "visible": i % 9 != 0,
     "x": (i * 29 + s) % 50 / 10, "xs": [(i * 29 + s) % 50 / 10, None if i % 5 == 0 else i / 7], "label": ["a", "b", "b", ""][i % 4], "conf": 0.9, "start_ms": 700 * i, "end_ms": 700 * i + 300,
     "seg_start": i - 3.0 if i % 10 == 8 else None, "seg_end": i - 1.0 if i % 10 == 8 else None, "points": points_of(i, s)[0], "mask": points_of(i, s)[1]}
    for s in (1, 2) for i in range(30)
]
SCHEMA = f"session_id long, frame_idx long, ts timestamp, ts_ms long, pb double, pi double, visible boolean, x double, xs array<double>, label string, conf double, start_ms long, end_ms long, seg_start double, seg_end double, points {joints.POINTS}, mask array<double>"


def put(spark, root, rows, name="in"):
    """Add a file of rows to what a stream reads."""
    names = [x.name for x in spark.createDataFrame([], SCHEMA).schema]
    spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{name}")


def stream_of(spark, root, name="in"):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}")


@pytest.fixture()
def frames(spark, tmp_path):
    """A stream of two sessions in three files, and its rows."""
    for k in range(3):
        put(spark, tmp_path, [r for r in ROWS if 10 * k <= r["frame_idx"] < 10 * k + 10])
    return stream_of(spark, tmp_path), ROWS, str(tmp_path)


def run(spark, out, root, name):
    q = out.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/{name}").collect()


def of(rows, s):
    return [r for r in rows if r["session_id"] == s]


STREAMS = {
    "segs": lambda s: stateful.stream_segments(s, start=0.5, go_on=0.8),
    "norm": lambda s: stateful.stream_normalize(s, hand=3, least=2),
    "euro": stateful.stream_one_euro,
    "words": stateful.stream_words,
    "clips": stateful.stream_clips,
    "features": lambda s: stateful.stream_features(s, hand=3),
}


def test_streams_equal_batch(spark, frames):
    stream, rows, root = frames
    got = run(spark, STREAMS["norm"](stream), root, "norm")
    df = spark.createDataFrame([(r["session_id"], r["frame_idx"], r["points"], r["mask"]) for r in rows], f"sample_id long, frame_idx long, points {joints.POINTS}, mask array<double>")
    want = {(r.sample_id, r.frame_idx): r for r in grouped.causal_normalize(df, hand=3, least=2).collect()}
    assert len(got) == len(rows)
    for r in got:
        w = want[r.session_id, r.frame_idx]
        assert [r.center_x, r.center_y, r.center_z, r.scale] == pytest.approx([w.center_x, w.center_y, w.center_z, w.scale])
        assert [c for p in r.points for c in p] == pytest.approx([c for p in w.points for c in p])
    got = run(spark, STREAMS["euro"](stream), root, "euro")
    for j in (0, 1):
        m, ordered = grouped.OneEuro(), sorted(of(got, 1), key=lambda r: r.frame_idx)
        assert [r.smooth[j] for r in ordered] == [None if r["xs"][j] is None else pytest.approx(m.step(r["ts_ms"], r["xs"][j])) for r in of(rows, 1)]
    got = run(spark, STREAMS["segs"](stream), root, "segs")
    for s in (1, 2):
        m = grouped.Decoder(start=0.5, go_on=0.8)
        want = [x for x in (m.step(r["frame_idx"], r["pb"], r["pi"], r["visible"]) for r in of(rows, s)) if x]
        assert sorted((r.start, r.end_excl) for r in of(got, s) if r.end_reason != "eos_closed") == [(x["start"], x["end_excl"]) for x in want]
        last = m.end()
        left = [r for r in [*got, *stateful.open_segments(spark, f"{root}/segs-state").collect()] if r.session_id == s and r.end_reason == "eos_closed"]
        assert [(r.start, r.end_excl, r.mean_inside) for r in left] == ([(last["start"], last["end_excl"], pytest.approx(last["mean_inside"]))] if last else [])
    got = run(spark, STREAMS["words"](stream), root, "words")
    m = grouped.Words()
    assert sorted(r.start_ms for r in of(got, 1)) == [r["start_ms"] for r in of(rows, 1) if m.step(r["label"], r["conf"], r["start_ms"], r["end_ms"])]
    got = run(spark, STREAMS["clips"](stream), root, "clips")
    xs = [r["x"] for r in of(rows, 1)]
    clips = {r.start: r.clip for r in of(got, 1)}
    assert clips[5] == xs[3:9] and set(clips) == {5, 15, 25}


def test_stream_features(spark, frames):
    """Against numpy, joint by joint."""
    stream, rows, root = frames
    got = {(r.session_id, r.frame_idx): r for r in run(spark, STREAMS["features"](stream), root, "features")}
    length = lambda v: np.sqrt(np.maximum((v * v).sum(-1), 1e-6))
    for s in (1, 2):
        m = np.array([r["mask"] for r in of(rows, s)])
        c = np.array([[[p[a] for a in "xyz"] for p in r["points"]] for r in of(rows, s)]) * m[..., None]
        v, a = np.zeros_like(c), np.zeros_like(c)
        v[1:] = (c[1:] - c[:-1]) * (m[1:] * m[:-1])[..., None]
        a[2:] = (v[2:] - v[1:-1]) * (m[2:] * m[1:-1] * m[:-2])[..., None]
        mean = lambda x, w: (length(x) * w).sum(-1) / np.maximum(w.sum(-1), 1)
        left, right = slice(0, 3), slice(3, 6)
        want = {
            "visible_share": m.mean(-1), "mean_speed": mean(v, m), "mean_acceleration": mean(a, m), "wrist_distance": length(c[:, 0] - c[:, 3]) * m[:, 0] * m[:, 3],
            "left_spread": mean(c[:, left] - c[:, :1], m[:, left]), "right_spread": mean(c[:, right] - c[:, 3:4], m[:, right]), "left_speed": mean(v[:, left], m[:, left]), "right_speed": mean(v[:, right], m[:, right]),
        }
        for i in range(30):
            r = got[s, i]
            for name, value in want.items():
                assert getattr(r, name) == pytest.approx(value[i]), (s, i, name)
            assert r.hand_speed == pytest.approx((r.left_speed + r.right_speed) / 2) and [x for p in r.velocity for x in p] == pytest.approx(v[i].ravel())


@pytest.mark.parametrize("name", ["segs", "euro", "clips", "features"])  # value, map and list states
def test_restart_in_mid_stream_loses_nothing(spark, tmp_path, name):
    """Two runs over one checkpoint, the second with the later files, give what one run over all gives."""
    for k in range(3):
        put(spark, tmp_path, [r for r in ROWS if 10 * k <= r["frame_idx"] < 10 * k + 10], "whole")
    whole = run(spark, STREAMS[name](stream_of(spark, tmp_path, "whole")), tmp_path, "one")
    put(spark, tmp_path, [r for r in ROWS if r["frame_idx"] < 10], "parts")
    run(spark, STREAMS[name](stream_of(spark, tmp_path, "parts")), tmp_path, "two")
    for k in (1, 2):
        put(spark, tmp_path, [r for r in ROWS if 10 * k <= r["frame_idx"] < 10 * k + 10], "parts")
    parts = run(spark, STREAMS[name](stream_of(spark, tmp_path, "parts")), tmp_path, "two")
    assert sorted(map(str, parts)) == sorted(map(str, whole)) and whole


def test_late_rows_are_counted(spark, tmp_path):
    put(spark, tmp_path, [r for r in ROWS if r["session_id"] == 1 and r["frame_idx"] % 2 == 0])
    put(spark, tmp_path, [r for r in ROWS if r["session_id"] == 1 and (r["frame_idx"] in (3, 5, 28) or r["frame_idx"] == 29)])
    got = run(spark, stateful.stream_one_euro(stream_of(spark, tmp_path), late=True), tmp_path, "late")
    assert {r.frame_idx: r.late_rows for r in got} == {i: 0 for i in range(0, 30, 2)} | {29: 3}
    assert [tuple(r) for r in stateful.late_counts(spark, f"{tmp_path}/late-state").collect()] == [(1, 29, 3)]


def test_idle_sessions_end_by_timer(spark, tmp_path):
    """A session's open segment is closed, and its state goes, once the watermark has passed its last row by the idle time."""
    rows = [r | {"pb": 0.9, "pi": 0.9, "visible": True} for r in ROWS]
    put(spark, tmp_path, of(rows, 1))
    later = [r | {"ts": r["ts"] + timedelta(minutes=5)} for r in of(rows, 2)]
    put(spark, tmp_path, later[:15])
    put(spark, tmp_path, later[15:])
    got = run(spark, STREAMS["segs"](stream_of(spark, tmp_path)), tmp_path, "idle")
    assert [(r.session_id, r.start, r.end_excl, r.end_reason) for r in got] == [(1, 0, 30, "eos_closed")]
    assert [r.session_id for r in stateful.late_counts(spark, f"{tmp_path}/idle-state").collect()] == [2]
    dropped = run(spark, stateful.stream_segments(stream_of(spark, tmp_path), end_of_stream="drop", start=0.5), tmp_path, "drop")
    assert dropped == []


def test_hands_on_a_stream_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    kinds = {c: "double" for h in grouped.HANDS for c in (f"{h}_x", f"{h}_y", f"{h}_scale", f"pose_{h}_x", f"pose_{h}_y")} | {"left_inside": "boolean", "right_inside": "boolean", "ambiguous": "boolean"}
    data = []
    for s in (1, 2):
        for i in range(40):
            values = {c: float(rng.random()) if k == "double" else bool(rng.random() < 0.7) for c, k in kinds.items()}
            for h in grouped.HANDS:
                if rng.random() < 0.2:
                    values |= {f"{h}_{c}": None for c in ("x", "y", "scale")}
            data.append((s, i, datetime(2024, 1, 1) + timedelta(milliseconds=40 * i), *values.values()))
    schema = "session_id long, frame_idx long, ts timestamp, " + ", ".join(f"{c} {k}" for c, k in kinds.items())
    df = spark.createDataFrame(data, schema)
    for k in range(2):
        df.where(f"frame_idx div 20 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/hands")
    got = run(spark, stateful.stream_hands(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/hands")), tmp_path, "sides")
    want = grouped.associate_hands(df.withColumnRenamed("session_id", "sample_id")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and any(r.swapped for r in want) and any(r.left_accepted for r in want)


def test_upsert_stream(spark, frames):
    stream, rows, root = frames
    start = lambda: stateful.upsert_stream(stream.select("session_id", "ts", "x"), f"{root}/up", "session_id", f"{root}/up-state").trigger(availableNow=True).start().awaitTermination()
    start()
    now = lambda: {r.session_id: r.x for r in stateful.read_current(spark, f"{root}/up", "session_id").collect()}
    assert now() == {s: of(rows, s)[-1]["x"] for s in (1, 2)}
    assert sorted(map(tuple, stateful.run_ledger(spark, f"{root}/up").collect())) == [(0, 2, 0, 2), (1, 2, 2, 0), (2, 2, 2, 0)]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """A stream that begins anew over the same root gives its batches the same ids: those that the ledger has are left alone."""
    for k in range(2):
        put(spark, tmp_path, [r for r in ROWS if r["frame_idx"] // 15 == k])
    root, before = f"{tmp_path}/up", None
    for state in ("a", "b"):
        stateful.upsert_stream(stream_of(spark, tmp_path).select("session_id", "ts", "x"), root, "session_id", f"{tmp_path}/{state}").trigger(availableNow=True).start().awaitTermination()
        after = sorted(p.name for p in (tmp_path / "up").rglob("*.parquet")), sorted(map(tuple, stateful.read_current(spark, root, "session_id").collect()))
        assert before in (None, after)
        before = after
    # a batch that was written but isn't in the ledger is not seen
    spark.createDataFrame([(9, None, 1.0)], "session_id long, ts timestamp, x double").write.parquet(f"{root}/level=0/batch=7")
    assert sorted(map(tuple, stateful.read_current(spark, root, "session_id").collect())) == before[1]


def test_compaction_while_the_stream_goes_on(spark, tmp_path):
    root, seen = f"{tmp_path}/up", []
    for k in range(6):
        put(spark, tmp_path, [r for r in ROWS if r["frame_idx"] // 5 == k])
        stateful.upsert_stream(stream_of(spark, tmp_path).select("session_id", "ts", "x"), root, "session_id", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
        want = {s: of(ROWS, s)[5 * k + 4]["x"] for s in (1, 2)}
        if k % 2:
            assert {r.session_id: r.x for r in stateful.compact(spark, root, "session_id", fanout=2).collect()} == want
        assert {r.session_id: r.x for r in stateful.read_current(spark, root, "session_id").collect()} == want
        seen.append(len(stateful._live(spark, root)))
    assert max(seen) <= 3 and stateful.run_ledger(spark, root).count() == 6


def test_rates_and_eta_of_a_stream_equal_batch(spark, tmp_path):
    began = datetime(2024, 1, 1)
    done = spark.createDataFrame([(k % 2, began + timedelta(seconds=3 * k), k % 5 == 0) for k in range(60)], "shard int, ts timestamp, failed boolean")
    shards = spark.createDataFrame([(0, 100, began), (1, 20, began), (2, 5, began)], "shard int, selected int, started_at timestamp")
    for k in range(3):
        done.where(f"second(ts) div 20 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/done")
    stream = spark.readStream.schema(done.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/done")
    for name, of_rows, key in (("rates", lambda d: stateful.finish_rates(d, delay="1 hour"), ("shard", "start")), ("eta", lambda d: stateful.finish_eta(d, shards), ("shard",))):
        latest = {}
        q = of_rows(stream).writeStream.outputMode("update").foreachBatch(lambda df, _, latest=latest, key=key: latest.update({tuple(r[k] for k in key): r for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(str, latest.values())) == sorted(map(str, of_rows(done).collect())) and latest
    eta = {r.shard: r for r in stateful.finish_eta(done, shards).collect()}
    assert (eta[0].done, eta[0].ok, eta[0].remaining, eta[0].elapsed_sec, eta[1].remaining) == (30, 24, 70, 174.0, 0)
    assert eta[0].eta_sec == pytest.approx(70 * 174 / 30) and set(eta) == {0, 1}
