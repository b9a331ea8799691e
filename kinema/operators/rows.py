"""Row validation: annotations, segments, labels, schemas and keyed replacement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean


def missing_columns(df: DataFrame, required: Sequence[str], any_of: Sequence[str] = ()) -> list[str]:
    """PF8: required columns, and alternatives, that are missing (case does not matter)."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in required if c.lower() not in have]
    if any_of and not have & {c.lower() for c in any_of}:
        missing.append("one of " + ", ".join(any_of))
    return missing


def check_columns(df: DataFrame, required: Sequence[str], any_of: Sequence[str] = ()) -> None:
    """PF8: raise an error that names the missing columns."""
    if missing := missing_columns(df, required, any_of):
        raise ValueError("missing columns: " + ", ".join(missing))


def validate_annotations(rows: DataFrame) -> DataFrame:
    """PF9: rows with `reason`, the first rule that fails, null for accepted ones; of one id the first row (row_num) is accepted."""
    begin, end = clean.parse_int(F.col("begin")), clean.parse_int(F.col("end"))
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    reason = F.coalesce(
        F.when(blank("split"), "missing_split_value"), F.when(blank("attachment_id"), "missing_attachment_id"), F.when(blank("label"), "missing_label"),
        F.when(blank("begin"), "missing_begin"), F.when(begin.isNull(), "invalid_begin"), F.when(blank("end"), "missing_end"), F.when(end.isNull(), "invalid_end"),
        F.when((begin < 0) | (end < 0), "negative_clip_bounds"), F.when(end <= begin, "invalid_clip_range"),
    )
    judged = rows.withColumn("reason", reason).withColumn("sample_id", clean.path_stem(F.col("attachment_id")))
    first = F.row_number().over(W.partitionBy("sample_id", F.col("reason").isNull()).orderBy("row_num"))
    return judged.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), "duplicate_sample_id").otherwise(F.col("reason")))


def validate_segments(rows: DataFrame) -> DataFrame:
    """PF10: rows with `error`, null for good ones; headers are matched in any case."""
    df = rows.toDF(*[c.strip().lower() for c in rows.columns])
    check_columns(df, ["video_id", "seg_uid", "start", "end"])
    start, end = clean.parse_int(F.col("start")), clean.parse_int(F.col("end"))
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return df.withColumn("error", F.coalesce(
        F.when(blank("video_id"), "missing video_id"), F.when(blank("seg_uid"), "missing seg_uid"), F.when(start.isNull() | end.isNull(), "bad bounds"),
        F.when(start < 0, "negative start"), F.when(end <= start, "empty range"),
    ))


def label_filter(df: DataFrame, label: str, keep: Sequence[str] | None = None, drop: Sequence[str] = ("no_event", "")) -> DataFrame:
    """PF13: rows of the listed labels, without the dropped ones and nulls."""
    out = df.where(F.col(label).isNotNull() & ~F.col(label).isin(*drop))
    return out if keep is None else out.where(F.col(label).isin(*keep))


def segment_lengths(df: DataFrame, begin: str, end: str, end_exclusive: bool = True) -> DataFrame:
    """PF14: rows with a positive `length`."""
    b, e = clean.parse_int(F.col(begin)), clean.parse_int(F.col(end))
    return df.withColumn("length", e - b + (0 if end_exclusive else 1)).where("length > 0")


def flatten_frame(records: DataFrame) -> DataFrame:
    """PF16: nested records (hand_1, hand_2 structs, diagnostics map) as flat rows with presence flags."""
    flags = {"hand1_present": F.col("hand_1").isNotNull(), "hand2_present": F.col("hand_2").isNotNull()}
    nested = [c for c, t in records.dtypes if t.startswith("struct")]
    flat = [F.col(f"{c}.{f}").alias(f"{c}_{f}".replace(" ", "_")) for c in nested for f in records.schema[c].dataType.names]
    return records.select(*[c for c in records.columns if c not in nested], *flat, *[v.alias(k) for k, v in flags.items()], (flags["hand1_present"] & flags["hand2_present"]).alias("both_hands"))


def manifest_to_annotations(rows: DataFrame, files: DataFrame, split: str | None = None) -> DataFrame:
    """PF22: background annotations (text no_event, begin and end 0) of the manifest rows that have a file."""
    out = rows if split is None else rows.where(clean.normalize_split(F.col("split")) == split)
    return out.join(files, "sample_id", "left_semi").select(F.col("sample_id").alias("attachment_id"), F.lit("no_event").alias("text"), F.lit(0).alias("begin"), F.lit(0).alias("end"), "split")


def background_clips(manifest: DataFrame, files: DataFrame, split: str) -> DataFrame:
    """PF24: clips that are outside throughout: one row per manifest clip of the split, with the preferred file or missing."""
    wanted = manifest.where(clean.normalize_split(F.col("split")) == split)
    best = resolve_variant(files)
    out = wanted.join(best.withColumnRenamed("id", "sample_id"), "sample_id", "left")
    return out.select("sample_id", F.lit("no_event").alias("label_str"), "path", F.lit(True).alias("is_no_event"), F.col("path").isNull().alias("missing"))


def resolve_variant(files: DataFrame, prefer: str = "pp") -> DataFrame:
    """IO6: of the paths of one id, with or without the _pp suffix, the preferred one, ties by path."""
    stem = clean.path_stem(F.col("path"))
    tagged = files.select("path", F.regexp_replace(stem, "_pp$", "").alias("id"), F.when(stem.endswith("_pp"), "pp").otherwise("raw").alias("variant"))
    rank = F.row_number().over(W.partitionBy("id").orderBy((F.col("variant") != prefer).cast("int"), "path"))
    return tagged.withColumn("rank", rank).where("rank = 1").drop("rank")


def conform_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """IO9: the schema's columns in its order and types, absent ones null; unknown columns are an error."""
    unknown = sorted(set(df.columns) - set(schema.names))
    if unknown:
        raise ValueError("unknown columns: " + ", ".join(unknown))
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def upsert_by_key(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """IO11: the new rows, and the existing ones whose key isn't among them."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append_run(ledger: DataFrame, videos: DataFrame, failed: int, run_id: str) -> DataFrame:
    """IO12: the ledger with one more row, counted from the merged table; scheduled is processed and failed."""
    row = videos.agg(F.lit(run_id).alias("run_id"), F.count("*").alias("processed"), F.lit(failed).cast("long").alias("failed"), (F.count("*") + failed).alias("scheduled"))
    return ledger.unionByName(row, allowMissingColumns=True)


def shard_ranges(df: DataFrame, order: str, rows_per_shard: int) -> DataFrame:
    """IO14: rows with `shard`, ranges of rows_per_shard rows in order, from a range-partitioned sort and counted offsets."""
    part = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    counts = part.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = part.join(F.broadcast(offsets.select("__p", "first", "offset")), "__p")  # a row per partition of the sort
    return out.withColumn("shard", F.expr(f"(offset + __i - first) div {rows_per_shard}")).drop("__p", "__i", "first", "offset")


def shard_manifest(sharded: DataFrame, order: str) -> DataFrame:
    """IO14: first and last key and number of rows of each shard."""
    return sharded.groupBy("shard").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("rows"))


def hash_shard(df: DataFrame, id_: str, n: int) -> DataFrame:
    """IO15: shard = first 16 hex digits of the id's SHA-1 modulo n."""
    head = F.conv(F.substring(F.sha1(F.col(id_).cast("string")), 1, 16), 16, 10).cast("decimal(20,0)")
    return df.withColumn("shard", (head % n).cast("int"))


def merge_shards(shards: Sequence[DataFrame], id_: str) -> DataFrame:
    """IO16: all shards' rows; unequal schemas and ids that occur in several rows are errors."""
    if len({tuple(sorted(s.dtypes)) for s in shards}) > 1:
        raise ValueError("shards differ in schema")
    union = reduce(DataFrame.unionByName, [s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)])
    n = F.count("*").over(W.partitionBy(id_))
    failed = F.raise_error(F.concat(F.lit("duplicate id "), F.col(id_).cast("string")))
    return union.withColumn("_once", F.when(n > 1, failed).otherwise(n)).where("_once = 1").drop("_once")


def gloss_annotations(rows: DataFrame, label: str = "gloss") -> DataFrame:
    """IO17: (attachment_id, text, split, train) from names like split/stem; rows whose name doesn't have its split get a reason."""
    head = F.split_part(F.col("name"), F.lit("/"), F.lit(1))
    bad = F.when(~F.col("name").contains("/"), "bad_name").when(clean.normalize_split(head) != clean.normalize_split(F.col("split")), "split_mismatch")
    split = clean.normalize_split(F.col("split"))
    return rows.select(F.regexp_replace("name", "/", "__").alias("attachment_id"), F.col(label).alias("text"), split.alias("split"), (split == "train").alias("train"), bad.alias("reason"))


def timeline(preds: DataFrame) -> DataFrame:
    """IO20: predictions with a nested decision as a flat timeline."""
    return preds.select("segment_id", "start", "end", F.col("decision.label").alias("label"), F.col("decision.conf").alias("conf"), F.col("decision.accepted").alias("accepted"), F.col("decision.reason").alias("reason"))
