"""Registered queries on inputs that the given tables don't have: what large tables and odd values bring."""

import math

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinema.plans import agg_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_artifact_is_joined_without_broadcasts(spark):
    assert "Broadcast" not in plan(QUERIES["io10_write_artifact"](spark, SF))


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """The events in a folder of parts, as tables are that don't fit a file."""
    root, events = tmp_path_factory.mktemp("parts"), pq.read_table(f"{SF}/events.parquet")
    (root / "events.parquet").mkdir()
    half = len(events) // 2
    for k, part in enumerate((events.slice(half), events.slice(0, half))):
        pq.write_table(part, root / f"events.parquet/part-{k:04d}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["st4_stream_one_euro", "st1_stream_segments"])
def test_streams_read_folders_of_parts(spark, parts, name):
    got, want = (sorted(map(tuple, QUERIES[name](spark, d).collect())) for d in (parts, SF))
    assert len(want) > 0
    assert got == want


def test_rounding_is_that_of_sql(spark):
    odd = [1623.8369734999999, -1623.8369734999999, -2e-7, -0.0, 0.0, 2.5e-6, -5e-7, 1e300, 2e302, math.inf, -math.inf, math.nan, None]
    want = [v for (v,) in duckdb.execute("select round(unnest(?::double[]), 6)", [odd]).fetchall()]
    got = [r.x for r in spark.createDataFrame([(v,) for v in odd], "x double").select(agg_queries.sql_round(F.col("x")).alias("x")).collect()]
    assert list(map(repr, got)) == list(map(repr, want))


def test_unit_vectors_keep_signs_of_zeros_and_nulls(spark, tmp_path):
    vectors = [[1.0, -1e-7, 0.0], [-1e-8, 3.0, 4.0], [1.0, None, -2.0], [], None, [None]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.vec_id, r.unit) for r in QUERIES["ar23_l2_normalize"](spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        assert repr(got) == repr(sorted(c.sql(SQL["ar23_l2_normalize"]).fetchall()))


def test_sanity_check_works_a_scale_out_once(spark):
    assert plan(QUERIES["ar15_sanity_check"](spark, SF)).count("array_sort(") == 2  # the hand's and the anchor's
