"""Ranked lexical search: the Best Position Algorithm over impact lists, each task on the lists of its own documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import append_columns, staged, utf8
from .decontaminate import normalised

#: Results of an item, and the weight of a document's length in per cent.
TOP, LENGTH_PERCENT = 10, 90
#: Item terms, and bytes of their text, that are searched at once, as every executor holds them. More go in several blocks.
TERMS_AT_ONCE, BYTES_AT_ONCE = 1_000_000, 32 << 20
#: Postings whose impact lists a task orders at once.
POSTINGS_AT_ONCE = 1_000_000
#: One document in this many is searched first: the scores that it reaches let the search of the others stop sooner.
FIRST_OF = 16
#: Positions of every list that are read in the first step of sorted access, and in one step at most; steps double.
STEP, LONGEST_STEP = 16, 2_048

_LONG = (1 << 63) - 1


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms): the distinct terms of each item id; rows of one id, null among them, are one item."""

    def run(batch: pa.RecordBatch) -> list:
        return [[sorted({w.decode() for w in normalised(x)}) for x in utf8(batch.column(batch.schema.names.index("text")))]]

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    made = append_columns(rows, [T.StructField("terms", T.ArrayType(T.StringType()))], run, ["item_id"])
    return made.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def postings(docs: DataFrame, doc_id: str, text: str, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its number of terms, and the known ones with their occurrences.

    vocabulary: a broadcast list of terms; they are named by their place in it.
    """
    known: dict[bytes, int] = {}

    def run(batch: pa.RecordBatch) -> list:
        if not known:
            known.update((x.encode(), i) for i, x in enumerate(vocabulary.value))
        n, terms, tfs = [], [], []
        for raw in utf8(batch.column(batch.schema.names.index("text"))):
            words = normalised(raw)
            found = Counter(map(known.get, words))
            found.pop(None, None)
            n.append(len(words))
            terms.append(list(found))
            tfs.append(list(found.values()))
        return [n, terms, tfs]

    ints = T.ArrayType(T.IntegerType())
    fields = [T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("tfs", ints)]
    return append_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), fields, run, ["doc_id"]).where("n > 0")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_units(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's length against the mean, in hundredths, of which LENGTH_PERCENT count."""
    rest = 100 - LENGTH_PERCENT
    if len(n) == 0 or int(n.max()) * LENGTH_PERCENT * n_docs <= _LONG:
        return rest + (LENGTH_PERCENT * n * n_docs) // max(1, n_terms)
    return np.array([rest + LENGTH_PERCENT * x * n_docs // n_terms for x in n.tolist()], np.int64)


class ImpactLists:
    """For each term of some documents, the documents by falling impact, and every document's place in that list."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        self.ids = ids
        by_impact = np.lexsort((row, -impact, term))
        self.start = np.searchsorted(term[by_impact], np.arange(n_terms + 1))
        self.rows, self.impacts = row[by_impact], impact[by_impact]
        by_row = np.lexsort((self.rows, term[by_impact]))  # direct access: within a term by row
        self.found, self.place = self.rows[by_row], by_row - self.start[term[by_impact][by_row]]

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best documents for the terms, as far as they score `least` or more and above 0; accesses.

        Best Position Algorithm. A step of sorted access reads the next positions of all lists. Every document that it
        meets is looked up in all lists by direct access, which gives its whole score and marks its position in each of
        them as seen. The best position of a list is the last before which all are seen, whether by sorted or by direct
        access. No unseen document scores over the sum of the impacts at the best positions; the search stops when this
        sum is strictly below the k-th score, so that documents of equal score are all met.
        """
        spans = [(a, b) for a, b in zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), strict=True) if b > a]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not spans:
            return ids, scores, 0
        visited = np.zeros(len(self.ids), bool)
        seen = [np.zeros(b - a + 1, bool) for a, b in spans]  # one more, never seen, ends each
        best = [0] * len(spans)
        depth, step, kth, accesses = 0, STEP, max(1, least), 0
        while True:
            met = np.unique(np.concatenate([self.rows[a + depth : min(b, a + depth + step)] for a, b in spans]))
            met = met[~visited[met]]
            visited[met] = True
            depth, step = depth + step, min(2 * step, LONGEST_STEP)
            score = np.zeros(len(met), np.int64)
            accesses += len(met) * len(spans)
            bound = 0
            for i, (a, b) in enumerate(spans):
                at = a + np.searchsorted(self.found[a:b], met)
                at[at == b] = a
                hit = self.found[at] == met
                place = self.place[at[hit]]
                score[hit] += self.impacts[a + place]
                seen[i][place] = True
                best[i] += int(seen[i][best[i] :].argmin())
                bound += 0 if best[i] == b - a else int(self.impacts[a + best[i] - 1])
            good = score >= kth
            ids, scores = np.concatenate([ids, self.ids[met[good]]]), np.concatenate([scores, score[good]])
            order = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]
            if len(scores) == k:
                kth = max(kth, int(scores[-1]))
            if bound < kth:
                return ids, scores, accesses


def search_lists(shared, k: int, n_docs: int, n_terms: int):
    """A mapInArrow function from postings to (item, doc_id, score, accesses): the task's best documents for each item.

    shared: a broadcast of (the items' terms as arrays, the terms' weights, the least score that counts by item).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, floors = shared.value
        floors = list(floors)
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        accesses = np.zeros(len(items), np.int64)
        waiting: list[tuple[np.ndarray, ...]] = []

        def search() -> None:
            ids, n, counts, term, tf = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            row = np.repeat(np.arange(len(ids)), counts)
            m = length_units(n, n_docs, n_terms)[row]
            lists = ImpactLists(ids, row, term, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)), len(weights))
            for i, terms in enumerate(items):
                found, scores, work = lists.best(terms, k, floors[i])
                accesses[i] += work
                found, scores = np.concatenate([held[i][0], found]), np.concatenate([held[i][1], scores])
                order = np.lexsort((found, -scores))[:k]
                held[i] = found[order], scores[order]
                if len(order) == k:
                    floors[i] = max(floors[i], int(held[i][1][-1]))

        size = 0
        for batch in batches:
            listed, tfs = (batch.column(batch.schema.names.index(x)) for x in ("terms", "tfs"))
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (listed, tfs)]
            counts = np.diff(listed.offsets.to_numpy())
            waiting.append((*(batch.column(batch.schema.names.index(x)).to_numpy(zero_copy_only=False) for x in ("doc_id", "n")), counts, *flat))
            size += len(flat[0])
            if size >= POSTINGS_AT_ONCE:
                search()
                size = 0
        if waiting:
            search()
        counts = [len(x) for x, _ in held]
        if sum(counts):
            columns = [np.repeat(np.arange(len(items), dtype=np.int32), counts), *(np.concatenate(x) for x in zip(*held, strict=True)), np.repeat(accesses, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["item", "doc_id", "score", "accesses"])

    return run


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    terms_at_once: int = TERMS_AT_ONCE,
    first_of: int = FIRST_OF,
) -> DataFrame:
    """(item_id, rank, doc_id, score, accesses): the k best documents of every item by the sum of its terms' impacts.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), its impact on a document that weight times
    (1e9 tf) div (1000 tf + 8 m), m the document's length in hundredths of the mean, nine tenths of it. Statistics
    are of all documents with a term. Each task makes impact lists of its own documents, a bounded number of postings
    at a time, and searches them by the Best Position Algorithm (`ImpactLists.best`), so that no list of a frequent
    term lies in one task; a task's best k of each item are ranked together at the end. One document in `first_of` is
    searched first: its k-th scores are floors for the others, which leaves the result as it is. `accesses` counts the
    direct accesses of the task that found the row.

    Equal scores rank by ascending doc_id. A document's terms count once for each item, whatever their repeats there.
    Null and empty texts have no term: such documents count in no statistic and such items have no rows. Rows of one
    item id, null among them, are one item. Repeated document rows are documents of their own; one without an id counts in
    the statistics, but is not ranked. Ids are integers. Extra columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = items.schema[item_id].dataType
    asked = staged(item_terms(items, item_id, item_text), "search-items")
    n, size = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "terms"))), F.lit(0))).first()
    blocks = max(1, -(-n // terms_at_once), -(-size // BYTES_AT_ONCE))
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks)) == block).collect()
        words = sorted({x for r in part for x in r.terms})
        at = {x: i for i, x in enumerate(words)}
        vocabulary = sc.broadcast(words)
        listed = staged(postings(docs, doc_id, doc_text, vocabulary), "search-postings")
        n_docs, n_terms = listed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect())
        weights = np.array([term_weight(n_docs, df.get(i, 0)) for i in range(len(words))], np.int64)
        terms = [np.array([at[x] for x in r.terms], np.int64) for r in part]
        listed = listed.where((F.size("terms") > 0) & F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
        first = F.pmod(F.xxhash64("doc_id"), F.lit(first_of)) == 0
        schema = "item int, doc_id long, score long, accesses long"

        def found(rows: DataFrame, floors: list[int], terms=terms, weights=weights, n_docs=n_docs, n_terms=n_terms) -> DataFrame:
            return rows.mapInArrow(search_lists(sc.broadcast((terms, weights, floors)), k, n_docs, n_terms), schema)

        order = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        begun = staged(found(listed.where(first), [0] * len(part)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "search-first")
        floors = dict(begun.where(F.col("rank") == k).select("item", "score").collect())
        rest = found(listed.where(~first), [floors.get(i, 0) for i in range(len(part))])
        both = begun.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        made = both.join(named, "item").select("item_id", "rank", F.col("doc_id").alias(doc_id), "score", "accesses")
        if blocks > 1:
            made = staged(made, "search-block")
        out = made if out is None else out.unionByName(made)
    return out
