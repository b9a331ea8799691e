"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import append_columns, staged, utf8
from .graph import connected_components

#: Fingerprints are cut into this many blocks of equal width; those at most 2 bits apart share all but 2 blocks.
BLOCKS = 4
#: Distinct fingerprints of one block key that are compared at once; larger keys are split by further blocks.
PAIRWISE = 64


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text's word shingles: a bit is 1 if set in over half of their XXH64 values."""
    words = text.lower().split()  # bytes: only A-Z change, and only \\x20 \\x09-\\x0D separate
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        hashes = [digest(joined[i:j], seed) for i, j in pairs]
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        count += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint as a signed long; null and empty texts have fingerprint 0."""

    def run(batch: pa.RecordBatch) -> list:
        column = batch.column(batch.schema.names.index(text))
        return [np.array([fingerprint(x, width) for x in utf8(column)], np.uint64).view(np.int64).tolist()]

    return append_columns(docs, [T.StructField(out, T.LongType())], run, keep)


def _masks(free: int, drop: int) -> list[int]:
    """Masks of all choices of BLOCKS - drop of the BLOCKS equal blocks that the free bits (a count, a power of two) make."""
    width = free // BLOCKS
    return [sum(((1 << width) - 1) << (width * b) for b in kept) for kept in itertools.combinations(range(BLOCKS), BLOCKS - drop)]


def _spread(mask: int, bits: int) -> int:
    """The bits of a mask put, from the lowest on, at the places that are set in `bits`."""
    places = [i for i in range(64) if bits >> i & 1]
    return sum(1 << places[i] for i in range(len(places)) if mask >> i & 1)


def _levels(distance: int) -> list[list[int]]:
    """Masks of compared bits, level by level: those of level i + 1 add blocks of the bits that one of level i leaves.

    Two fingerprints within `distance` bits that agree on a mask differ in that many of the bits it leaves at most, so
    they agree on one of the masks below it as well.
    """
    every = (1 << 64) - 1
    levels = [[0]]
    while (free := 64 - levels[-1][0].bit_count()) >= BLOCKS:
        levels.append([m | _spread(x, every & ~m) for m in levels[-1] for x in _masks(free, distance)])
        if len(levels) > 3 or distance == 0:
            break
    return levels[1:]


def near_links(fps: DataFrame, fp: str = "fp", distance: int = 2) -> DataFrame:
    """Links (a, b), a < b, of all distinct fingerprints at most `distance` (0 to 2) bits apart.

    Every fingerprint is listed under all choices of BLOCKS - distance of its BLOCKS blocks. Fingerprints of one key are
    compared by Hamming distance. A key of over PAIRWISE of them is split by blocks of the bits that it leaves, and
    again; after three levels a key leaves 8 bits at distance 2, and has 256 fingerprints at most. Which keys are split
    doesn't change the links.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = fps.select(F.col(fp).alias("fp")).distinct().withColumn("k", F.lit(0))
    levels, links = _levels(distance), None
    for i, masks in enumerate(levels):
        each = len(masks) // (len(levels[i - 1]) if i else 1)
        table = F.array(*[F.lit(signed(m)).cast("long") for m in masks])
        below = rows.select("fp", F.explode(F.sequence(F.col("k") * each, F.col("k") * each + each - 1)).alias("k"))
        listed = staged(below.select("fp", "k", F.col("fp").bitwiseAND(F.get(table, F.col("k"))).alias("bits")), "blocks")
        sizes = listed.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1")
        met = staged(listed.join(sizes, ["k", "bits"]), "block-rows")
        last = i + 1 == len(levels)
        small = met if last else met.where(F.col("n") <= PAIRWISE)
        pairs = (
            small.select("k", "bits", F.col("fp").alias("a"))
            .join(small.select("k", "bits", F.col("fp").alias("b")), ["k", "bits"])
            .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
            .select("a", "b")
        )
        links = pairs if links is None else links.unionByName(pairs)
        rows = met.where(F.col("n") > PAIRWISE).select("fp", "k")
        if last or rows.isEmpty():
            break
    return links.distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, width: int = 3) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links of at most `distance` bits, the document's own included.
    Null and empty texts have fingerprint 0 and link like any other; equal texts share one fingerprint, repeated rows
    stay. A null id is returned; it counts in no minimum, and a component of null ids alone has a null component_id.
    Other columns are not read. An empty table gives an empty result.
    """
    fps = staged(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width=width, keep=["doc_id"]), "fingerprints")
    groups = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    parts = connected_components(near_links(groups, distance=distance)).select(F.col("node").alias("fp"), "component")
    named = groups.join(parts, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id")
    return fps.join(of, "fp").select(
        F.col("doc_id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2) -> DataFrame:
    """The documents with one of each near-duplicate group kept, that with the smallest id, all columns as they were.

    Of repeated rows of that id one stays. Rows without an id stay only if their whole group has none: they cannot
    be told apart by id, so all of them stay.
    """
    parts = staged(simhash_components(docs, doc_id, text, distance), "components")
    stay = parts.where(F.col(doc_id) == F.col("component_id")).select(doc_id).distinct()
    order = W.partitionBy(doc_id).orderBy(F.length(text), text)
    one = docs.join(stay, doc_id, "left_semi").withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
    blank = with_fingerprint(docs.where(F.col(doc_id).isNull()), text, "__fp")
    lone = parts.where(F.col("component_id").isNull()).select("fingerprint").distinct()
    blank = blank.join(lone, F.lpad(F.lower(F.hex("__fp")), 16, "0") == F.col("fingerprint"), "left_semi").drop("__fp")
    return one.select(docs.columns).unionByName(blank.select(docs.columns))
