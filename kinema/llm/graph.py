"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Links that one task of a round takes.
LINKS_A_TASK = 200_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected link table of long node keys: (node, component), component the smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node of its
    neighbourhood; the number of links never grows and rounds are logarithmic in the longest chain. Neighbourhoods
    are reduced by min(), never gathered. Each round is a written table, so a lost executor costs one round at most.
    Null ends and self links are ignored; an empty table gives an empty result.
    """
    edges = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "cc",
    )
    before = None
    while True:
        tasks = max(1, edges.count() // LINKS_A_TASK)  # links grow no more: few of them take few tasks, whatever the session's number
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        large = large.distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(least.select("u", F.col("m").alias("v")))
            .coalesce(tasks)
            .distinct()
        )
        edges = staged(small.coalesce(tasks), "cc")
        state = edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
        if state == before:
            break
        before = state
    parents = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = parents.select(F.col("component").alias("node"), "component").distinct()
    return parents.unionByName(roots)
