"""Readers and writers of annotation tables, manifests, frame documents, predictions and event logs.

Everything goes through Spark's readers, so paths may be of any store that Spark reads. Layouts are sniffed on a few
lines at the driver; after that the schema is fixed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Delimiters of annotation tables.
DELIMITERS = (",", "\t", ";", "|")
BOM = "﻿"


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that occurs equally often, and most often, in all lines; else tab if there is no comma, else comma."""
    counts = {d: {x.count(d) for x in lines} for d in DELIMITERS}
    even = [d for d in DELIMITERS if len(counts[d]) == 1 and min(counts[d]) > 0]
    if even:
        return max(even, key=lambda d: min(counts[d]))
    return "\t" if any("\t" in x for x in lines) and not any("," in x for x in lines) else ","


def scan_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sniffed: int = 20) -> DataFrame:
    """IO1: a CSV or TSV with a header row; the delimiter is found in the first lines, a byte order mark is taken off."""
    head = [r.value.lstrip(BOM) for r in spark.read.text(path).limit(sniffed).collect() if r.value.strip()]
    df = spark.read.csv(path, sep=sniff_delimiter(head), header=True, multiLine=False)
    df = df.toDF(*[c.lstrip(BOM).strip() for c in df.columns])
    return df if schema is None else df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def scan_interval_list(spark: SparkSession, path: str) -> DataFrame:
    """IO2: lines video,label,id,t_start,t_end[,frames] with or without a header; lines of fewer fields are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s*,\s*").alias("p")).where((F.size("p") >= 5) & ~F.lower(F.col("p")[0]).isin("video", "video_id"))
    names = ["video", "label", "id", "t_start", "t_end", "frames"]
    return parts.select(*[F.get("p", F.lit(i)).alias(n) if i < 2 else F.get("p", F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(names)])


def scan_manifest(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """IO3: (id, split, row) of JSON lines, a JSON list, {items: []}, {rows: []}, {id: split} or {id: {...}}.

    Whether it is made of lines is told by the first two: each line is then parsed on its own, and else every file as
    one document; bad lines are left out, or an error if strict.
    """
    head = [r.value for r in spark.read.text(path).where("trim(value) <> ''").limit(2).collect()]
    if _is_row(head):
        parsed = F.try_parse_json("value")
        parse_error = F.raise_error(F.lit("bad manifest line")).cast("variant")
        lines = spark.read.text(path).where("trim(value) <> ''").select((F.coalesce(parsed, parse_error) if strict else parsed).alias("r")).where("r is not null")
        return _manifest_rows(lines.select(F.lit(None).cast("string").alias("id"), "r", F.lit(None).cast("string").alias("split")))
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("d")).where("d is not null")
    items = F.coalesce(F.try_variant_get("d", "$.items", "variant"), F.try_variant_get("d", "$.rows", "variant"), F.col("d"))
    docs = docs.select(items.alias("d"))
    pairs = spark.sql("select key, value from {docs}, lateral variant_explode(d)", docs=docs)
    is_row = F.schema_of_variant("value").startswith("OBJECT")
    return _manifest_rows(pairs.select(F.col("key").alias("id"), F.when(is_row, F.col("value")).alias("r"), F.when(~is_row, F.try_variant_get("value", "$", "string")).alias("split")))


def _is_row(head: list[str]) -> bool:
    """Whether the first of these lines is a JSON object of its own: it names an id, or others follow."""
    try:
        first = json.loads(head[0])
    except (IndexError, ValueError):
        return False
    return isinstance(first, dict) and (len(head) > 1 or not {"id", "sample_id", "video_id"}.isdisjoint(first))


def _manifest_rows(found: DataFrame) -> DataFrame:
    name = F.coalesce(*[F.try_variant_get("r", f"$.{k}", "string") for k in ("id", "sample_id", "video_id", "video")])
    return found.select(F.coalesce(name, F.col("id")).alias("id"), F.coalesce(F.try_variant_get("r", "$.split", "string"), F.col("split")).alias("split"), F.to_json("r").alias("row"))


def scan_frame_json(spark: SparkSession, path: str) -> DataFrame:
    """IO4: (id, frame_idx, meta, frame) of documents {meta, frames: []}, bare frame lists, or {videos: {id: {meta, frames}}}."""
    docs = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"), F.try_parse_json("value").alias("d")).where("d is not null")
    return spark.sql(
        """
        with clips as (
          select name as id, d from {docs} where try_variant_get(d, '$.videos', 'variant') is null
          union all select key, value from {docs}, lateral variant_explode(variant_get(d, '$.videos', 'variant')) where try_variant_get(d, '$.videos', 'variant') is not null)
        select id, pos as frame_idx, to_json(try_variant_get(d, '$.meta', 'variant')) as meta, value as frame
        from clips, lateral variant_explode(coalesce(try_variant_get(d, '$.frames', 'variant'), d))""",
        docs=docs,
    )


def scan_frame_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """IO5: a frame object per line; a line that is none is an error."""
    v = F.try_parse_json("value")
    bad = F.raise_error(F.concat(F.lit("not a frame object: "), F.substring("value", 1, 80))).cast("variant")
    return spark.read.text(path).where("trim(value) <> ''").select(F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(bad).alias("frame"))


def compact_keys(docs: DataFrame, c: str, keys: list[str]) -> DataFrame:
    """PF15: JSON documents with the listed keys alone; absent ones are left out."""
    kept = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.try_variant_get(F.try_parse_json(c), f"$['{k}']", "variant").alias("v")) for k in keys]), lambda e: e["v"].isNotNull()))
    return docs.withColumn(c, F.to_json(kept))


def write_artifact(videos: DataFrame, frames: DataFrame, landmarks: DataFrame, root: str) -> None:
    """IO10: the three tables under root; frames lie clustered by clip, landmarks by variant."""
    videos.write.mode("overwrite").parquet(f"{root}/videos")
    frames.repartition("sample_id").sortWithinPartitions("sample_id", "frame_idx").write.mode("overwrite").parquet(f"{root}/frames")
    landmarks.withColumn("group", F.concat_ws("/", "sample_id", "variant")).write.mode("overwrite").partitionBy("variant").parquet(f"{root}/landmarks")


def read_sample(spark: SparkSession, root: str, sample_id) -> tuple[DataFrame, DataFrame]:
    """IO7: a clip's row of videos, and its frames in order; the filter reaches the files."""
    of = F.col("sample_id") == F.lit(sample_id)
    return spark.read.parquet(f"{root}/videos").where(of), spark.read.parquet(f"{root}/frames").where(of).orderBy("frame_idx")


def sample_catalog(spark: SparkSession, root: str, columns: Sequence[str] = ("sample_id", "frames", "quality", "signer_id")) -> DataFrame:
    """IO8: those of the columns that the videos have, sorted by id."""
    videos = spark.read.parquet(f"{root}/videos")
    return videos.select(*[c for c in columns if c in videos.columns]).orderBy("sample_id")


def write_predictions(df: DataFrame, folder: str) -> None:
    """IO13: a Parquet and a CSV copy; nested columns are JSON in the CSV."""
    df.write.mode("overwrite").parquet(f"{folder}/predictions.parquet")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(f"{folder}/predictions.csv", header=True)


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """IO13: the Parquet copy if it is there, else the CSV one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/predictions.parquet")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(str(path.toString())) if there else spark.read.csv(f"{folder}/predictions.csv", header=True, inferSchema=True)


def write_manifest_by_split(df: DataFrame, root: str, order: str) -> None:
    """IO18: sorted TSV and JSON lines of all rows, and of each split in a folder of its own."""
    rows = df.orderBy(order).persist()  # sorted once for both
    rows.write.mode("overwrite").csv(f"{root}/all.tsv", sep="\t", header=True)
    rows.write.mode("overwrite").json(f"{root}/all.jsonl")
    rows.unpersist()
    df.repartition("split").sortWithinPartitions("split", order).write.mode("overwrite").partitionBy("split").csv(f"{root}/by_split", sep="\t", header=True)


def event_log_source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO19: a stream of an append-only folder of JSON lines."""
    return spark.readStream.schema(schema).json(path)
