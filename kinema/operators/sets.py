"""Unions, overlaps, distinct rows, dense labels, top rows, folds and disjoint splits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_sources(sources: Mapping[str, DataFrame], row_num: str) -> DataFrame:
    """SO1: several tables as one, tagged with their name; columns that one lacks are null there."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).withColumnRenamed(row_num, "row_num")


def split_overlap(a: DataFrame, b: DataFrame, id_: str, examples: int = 10) -> DataFrame:
    """SO2: number of ids of both, the first examples, and ok if there is none. Examples are the smallest, found without gathering all."""
    both = a.select(id_).intersect(b.select(id_))
    few = both.orderBy(id_).limit(examples).agg(F.array_sort(F.collect_list(id_)).alias("examples"))
    return both.agg(F.count("*").alias("overlap_count")).crossJoin(few).withColumn("ok", F.col("overlap_count") == 0)  # one row each


def multi_split_keys(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """SO3: keys of more than one split with their splits."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def id_difference(a: DataFrame, b: DataFrame, id_: str) -> DataFrame:
    """SO4: ids that only one side has."""
    only = lambda x, y, s: x.select(id_).subtract(y.select(id_)).withColumn("side", F.lit(s))
    return only(a, b, "a").unionByName(only(b, a, "b"))


def distinct_keep(df: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """SO5: one row of each key, the first or the last in order."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order) if last else F.asc(order)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """SO6: sorted distinct labels with dense numbers from 0; classes are few, so one ordered window numbers them."""
    return df.select(label).distinct().withColumn("index", F.row_number().over(W.orderBy(label)) - 1)


def apply_label_index(df: DataFrame, index: DataFrame, label: str) -> DataFrame:
    """SO6: rows whose label is in the index, with its number."""
    return df.join(index, label)


def top_k(df: DataFrame, order: Sequence, k: int, per: Sequence[str] = ()) -> DataFrame:
    """TK1: the first k rows in order, overall or of each group."""
    if not per:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*per).orderBy(*order))).where(F.col("rank") <= k)


def nearest_neighbours(sim: DataFrame, k: int) -> DataFrame:
    """TK2: the k most similar other classes of each class, ties by class."""
    return top_k(sim.where("a <> b"), [F.desc("sim"), F.asc("b")], k, ["a"])


def hard_examples(preds: DataFrame, k: int) -> DataFrame:
    """TK3: the k wrong predictions of most confidence, then margin, then id."""
    return preds.where(F.col("true") != F.col("pred")).orderBy(F.desc("conf"), F.desc("margin"), "id").limit(k)


def ordered_output(df: DataFrame, columns: Sequence) -> DataFrame:
    """TK4: rows in a total order for writers."""
    return df.orderBy(*columns)


def sample_n(df: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    """TK5: n rows, the same ones for a seed: those of the smallest hashes."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(id_), F.lit(seed))), id_).limit(n)


def stratified_folds(df: DataFrame, label: str, id_: str, k: int) -> DataFrame:
    """TK6: folds over which every class is spread evenly, in order of id."""
    return df.withColumn("fold", (F.row_number().over(W.partitionBy(label).orderBy(id_)) - 1) % k)


def disjoint_split(ann: DataFrame, signer: str = "signer", split: str = "split", label: str = "label") -> DataFrame:
    """TK7: adds new_split, one for each signer: signers of one split keep it; mixed ones, the largest first, go where they fit best.

    A split's targets are its share of the rows, of every label's rows, and the number of signers that prefer it (the
    split of most of their rows; ties by name). A signer goes to the split with the least, in this order: signers over
    its target; distance of its open places from one; rows over its target; distance of its open rows from the signer's,
    with a twentieth of the relative distance of every label of the signer from its target; not being the preferred
    one; rows dealt so far; name. Largest first is by rows, then by rows of the signer's main label, then by name. A null signer is a signer.

    Each choice depends on those before it: the signers' counts by split and label are dealt in one ordered pass that
    keeps the splits' running sums. It goes through one task batch by batch, a row for each mixed signer, not their rows.
    """
    cells = ann.groupBy(signer, split, label).agg(F.count("*").alias("n"))
    by_split = cells.groupBy(signer, split).agg(F.sum("n").alias("n")).groupBy(signer).agg(F.collect_list(F.struct(split, "n")).alias("splits"))
    by_label = cells.groupBy(signer, label).agg(F.sum("n").alias("n")).groupBy(signer).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.collect_list(F.struct(label, "n")).alias("labels"))
    both = by_split.withColumnRenamed(signer, "s").join(by_label, F.col("s").eqNullSafe(F.col(signer))).drop("s")
    best = F.array_sort(F.transform("splits", lambda x: F.struct(-x["n"], x[split])))[0][split]
    counts = both.withColumn("prefers", best).withColumn("mixed", F.size("splits") > 1)
    # sums over splits and labels: as many rows as these have values
    rows = {r[0]: r[1] for r in cells.groupBy(split).agg(F.sum("n")).collect()}
    names = {r[0]: r[1] for r in cells.groupBy(label).agg(F.sum("n")).collect()}
    pure = counts.where("not mixed")
    signers = {r[0]: (r[1], r[2]) for r in counts.groupBy("prefers").agg(F.count("*"), F.count_if(~F.col("mixed"))).collect()}
    held = {(r[0], r[1]): r[2] for r in pure.select("prefers", F.explode("labels").alias("x")).groupBy("prefers", f"x.{label}").agg(F.sum("x.n")).collect()}
    everything = max(1, sum(rows.values()))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = dict(held)
        dealt = {x: sum(n for (y, _), n in held.items() if y == x) for x in rows}
        places = {x: signers.get(x, (0, 0))[0] - signers.get(x, (0, 0))[1] for x in rows}  # still open
        for groups in batches:
            out = []
            for g in groups.itertuples(index=False):
                labels = {x[label]: int(x["n"]) for x in g.labels}

                def unfit(x: str, g=g, labels=labels) -> tuple:
                    share = rows[x] / everything
                    room = share * everything - dealt[x]
                    off = sum(abs(have.get((x, k), 0) + n - names[k] * share) / max(1.0, names[k] * share) for k, n in labels.items())
                    return max(0, 1 - places[x]), abs(max(0, places[x]) - 1), max(0.0, g.total - room), abs(max(0.0, room) - g.total) + 0.05 * off, x != g.prefers, dealt[x], x

                pick = min(rows, key=unfit)
                places[pick] -= 1
                dealt[pick] += int(g.total)
                for k, n in labels.items():
                    have[pick, k] = have.get((pick, k), 0) + n
                out.append(pick)
            yield pd.DataFrame({signer: groups[signer].tolist(), "new_split": out})

    kind = counts.schema[signer].dataType.simpleString()
    order = [F.desc("total"), F.desc("most"), F.asc_nulls_last(signer)]
    ordered = counts.where("mixed").select(signer, "total", "most", "labels", "prefers").repartition(1).sortWithinPartitions(*order)
    dealt = ordered.mapInPandas(deal, f"{signer} {kind}, new_split string")
    of = pure.select(F.col(signer).alias("__signer"), F.col("prefers").alias("new_split")).unionByName(dealt.withColumnRenamed(signer, "__signer"))
    return ann.join(of, F.col(signer).eqNullSafe(F.col("__signer"))).drop("__signer")


def expand_grid(spark, grid: Mapping[str, Sequence] | Sequence[DataFrame]) -> DataFrame:
    """TK8: all combinations of the parameter lists, or of one-column tables, with an id; equal combinations occur once."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in grid.items()] if isinstance(grid, Mapping) else list(grid)
    out = reduce(lambda a, b: a.crossJoin(b), frames).distinct()  # the product is what is asked for
    return out.withColumn("config_id", F.left(F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in out.columns])), F.lit(10)))


def balanced_pick(pool: DataFrame, n: int, by: str, id_: str, seed: int) -> DataFrame:
    """TK9: n rows spread evenly over the groups: round after round one row of each, in order of hash."""
    hashed = lambda c: F.md5(F.concat_ws("|", F.col(c), F.lit(seed)))
    turn = F.row_number().over(W.partitionBy(by).orderBy(hashed(id_), id_))
    return pool.withColumn("turn", turn).orderBy("turn", hashed(by), id_).limit(n)
