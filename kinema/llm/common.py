"""Helpers shared by the training-data operators: shared scratch tables and Arrow row mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's spark.checkpoint.dir.

    Only where that is unset and the session is of one machine (tests) a temporary folder is made and set as checkpoint
    folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="kinema-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there and later passes reuse it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names made of the given ones that are no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Words of 64 bits in the marks of marked(): 2 MB, whatever the number of rows.
MARKS = 1 << 18


def marked(rows: DataFrame, column: str, of: DataFrame, other: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose `column` may be a value of `other` in `of` (nulls too), and those where it is none.

    A bit for the hash of each value of `of` is set in a table of bounded size, which is broadcast; so wide rows can be told
    apart before a join without a shuffle. All rows with such a value are among the first, and some by chance, more the more there are.
    """
    def placed(c: str):
        h = F.xxhash64(c)
        return F.pmod(h, F.lit(MARKS)), F.shiftrightunsigned(h, 58).cast("int")

    slot, bits = unused(rows, "slot", "bits")
    at, bit = placed(other)
    marks = of.groupBy(at.alias(slot)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(bits))
    at, bit = placed(column)
    held = rows.withColumn(slot, at).join(F.broadcast(marks), slot, "left")
    found = F.coalesce(F.getbit(bits, bit) == 1, F.lit(False))
    return held.where(found).select(rows.columns), held.where(~found).select(rows.columns)


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    fn: Callable[[pa.RecordBatch], list],
    keep: list[str] | None = None,
    name: str | None = None,
) -> DataFrame:
    """Add columns computed per Arrow batch; fn gets the batch and returns one array or list per field.

    keep: the input columns that stay (all by default). A computed column replaces an input column of its name.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    new = {f.name for f in fields}
    stay = [c for c in (df.columns if keep is None else keep) if c not in new]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(fn(part), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index(c)) for c in stay] + made, names=stay + names)
        pa.default_memory_pool().release_unused()  # the worker lives on and would keep it

    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in stay] + fields)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Lower the session's rows in an Arrow batch to `rows`, as rows are whole texts and a batch is held in memory whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of about `most` bytes, of one row at least, so that work space follows the part, not the batch."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, int(n * most / max(1, batch.nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blank_null(c: str):
    return F.coalesce(F.col(c), F.lit(""))
