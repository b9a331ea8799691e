"""Target-distribution importance resampling: an Aho-Corasick dictionary of words whose payloads compose feature buckets."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, slices, staged, unused, utf8
from .decontaminate import normalised

#: Consecutive words of a feature, at most; buckets; words that a document needs to be drawn; per cent drawn; seed.
RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Words of the dictionary, the most frequent first, and bytes of them. Other words are hashed where they stand.
DICTIONARY, DICTIONARY_BYTES = 100_000, 2 << 20
#: Documents of a range that one task ranks.
RANKED_A_TASK = 250_000


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n): occurrences of every word, counted within parts of a batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts: Counter = Counter()
                for raw in utf8(part.column(0)):
                    counts.update(normalised(raw))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return df.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text: str, most: int) -> list[str]:
    """About the `most` most frequent words, DICTIONARY_BYTES at most: whole powers of two of occurrences, of the last one a part by hash.

    How many words each power has is what is gathered, and then the words themselves, never more than about `most`.
    """
    counts = word_counts(df, text).where(F.octet_length("word") <= DICTIONARY_BYTES // 1000)
    counts = staged(counts.select("word", F.floor(F.log2("n")).cast("int").alias("power")), "resample-words")
    part, left = F.lit(False), most
    for power, n in sorted(counts.groupBy("power").agg(F.count("*")).collect(), reverse=True):
        share = min(1.0, left / n)
        part = part | ((F.col("power") == power) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))))
        left -= n
        if left <= 0:
            break
    words, size = [], 0
    for _, word in sorted((-r.power, r.word) for r in counts.where(part).collect()):
        size += len(word.encode())
        if size > DICTIONARY_BYTES:
            break
        words.append(word)
    return words


def _zeros_operators(upto: int) -> list[list[int]]:
    """For each bit of a length, the 32 columns of the linear map that appends 2 ** bit zero bytes to a CRC-32."""
    column = [0xEDB88320 if i == 0 else 1 << (i - 1) for i in range(32)]  # one zero bit

    def times(m: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    for _ in range(3):
        column = [times(column, x) for x in column]
    out = [column]
    while len(out) < upto:
        column = [times(column, x) for x in column]
        out.append(column)
    return out


def append_zeros(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 values, as 32-bit numbers in uint64, with `length` zero bytes appended, without the final complement's share."""
    crc, length = crc.copy(), length.astype(np.int64)
    for bit, columns in enumerate(_zeros_operators(max(1, int(length.max(initial=0)).bit_length()))):
        of = np.flatnonzero(length >> bit & 1)
        if len(of):
            v, made = crc[of], np.zeros(len(of), np.uint64)
            for i, column in enumerate(columns):
                made ^= np.where(v >> np.uint64(i) & np.uint64(1), np.uint64(column), np.uint64(0))
            crc[of] = made
    return crc


def compose(crc: np.ndarray, length: np.ndarray, words: int) -> np.ndarray:
    """CRC-32 of all runs of 1 to `words` adjacent words joined by one space, shorter runs first, from the words' payloads."""
    space = np.uint64(zlib.crc32(b" "))
    out, run = [crc], crc
    for n in range(2, words + 1):
        if len(crc) < n:
            break
        tail, size = crc[n - 1 :], length[n - 1 :]
        spaced = append_zeros(np.full(len(tail), space), size) ^ tail  # of a space and the last word
        run = append_zeros(run[: len(tail)], size + 1) ^ spaced
        out.append(run)
    return np.concatenate(out)


_machine: list = []  # the dictionary and automaton that this Python worker holds


def automaton(shared) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of words, each between delimiters with (CRC-32 and length) as one payload."""
    words = shared.value
    if not _machine or _machine[0] is not words:
        _machine.clear()
        made = ahocorasick.Automaton()
        for word in words:
            raw = word.encode()
            made.add_word(f" {word} ", zlib.crc32(raw) << 32 | len(raw))
        if len(made):
            made.make_automaton()
        _machine[:] = words, made
    return _machine[1]


def payloads(raw: bytes, shared) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and byte length of every word of a text, in order: the automaton's, and computed ones for words that it lacks."""
    words = normalised(raw)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    machine = automaton(shared)
    line = f" {b' '.join(words).decode()} "
    emitted = list(machine.iter(line)) if len(machine) else []
    packed = np.fromiter((x for _, x in emitted), np.uint64, len(emitted))
    if len(emitted) < len(words):
        ends = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 0x20)[1:]
        known = np.searchsorted(ends, np.fromiter((x for x, _ in emitted), np.int64, len(emitted)))
        every = np.zeros(len(words), np.uint64)
        every[known] = packed
        lacks = np.ones(len(words), bool)
        lacks[known] = False
        for i in np.flatnonzero(lacks).tolist():
            every[i] = zlib.crc32(words[i]) << 32 | len(words[i])
        packed = every
    return packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def bucket_rows(df: DataFrame, text: str, shared, run: int, buckets: int, keep: list[str]) -> DataFrame:
    """(keep, n_words, buckets): the bucket of each feature of every text, scanned once."""

    def made(batch: pa.RecordBatch) -> list:
        n, out = [], []
        for raw in utf8(batch.column(batch.schema.names.index(text))):
            crc, length = payloads(raw, shared)
            n.append(len(crc))
            out.append((compose(crc, length, run) % np.uint64(buckets)).astype(np.int32))
        return [n, pa.array(out, pa.list_(pa.int32()))]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))]
    return append_columns(df, fields, made, keep)


def bucket_counts(rows: DataFrame, buckets: int) -> dict[int, int]:
    """Features in each bucket; at most one row for each bucket and task is shuffled, and one for each bucket collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return dict(counted.collect())


def bucket_gains(s: dict[int, int], t: dict[int, int], buckets: int) -> np.ndarray:
    """Of each bucket, floor(1000 ln of the smoothed share in the target over that in the documents)."""
    of_s, of_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    ratio = lambda b: float((t.get(b, 0) + 1) * of_s) / float((s.get(b, 0) + 1) * of_t)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def noise(seed: int, name: str) -> int:
    """floor(1000 times a Gumbel variate) of an id, from its SHA-256."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, by: list, out: str, tasks: int) -> DataFrame:
    """Add the place, from 1, of every row in the order `by`, through ranges that are counted; no task sees all rows."""
    part, place = unused(rows, "part", "place")
    schema = T.StructType([*rows.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(place, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, own, np.int32)), pa.array(np.arange(at + 1, at + n + 1))], names=[*batch.schema.names, part, place])
            at += n

    placed = staged(rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).mapInArrow(number, schema), "ranked")
    before, offsets = 0, []
    for own, n in sorted(placed.groupBy(part).agg(F.max(place)).collect()):  # one row for each task
        offsets.append((own, before))
        before += n
    base = rows.sparkSession.createDataFrame(offsets, f"{part} int, {out} long")
    return placed.join(F.broadcast(base), part).withColumn(out, F.col(out) + F.col(place)).drop(part, place)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    target_text: str = "text",
    run: int = RUN,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    dictionary: int = DICTIONARY,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): importance weights of all documents to the target, and those drawn.

    Features are all runs of 1 to `run` consecutive words, repeats included, in `buckets` buckets by CRC-32. The most
    frequent distinct words of documents and target make one Aho-Corasick dictionary; a scan of a text emits each word's
    CRC-32 and length, from which those of longer runs are composed without touching the text again. Words beyond the
    dictionary's bound are hashed where they stand, so that the bound changes no result. A document's weight is the sum of its
    features' gains, its score adds Gumbel noise of its id, and of the N documents with at least `least_words` words the
    floor(percent N / 100) best scores are drawn and ranked, ties to the smaller id.

    Null and empty texts have no features and weight 0 and aren't drawn (unless least_words is 0). Repeated rows count,
    are scored and are drawn as rows of their own. A null id has the noise of the empty name and ranks last among equals.
    Extra columns are not read. Without a target all gains come from smoothing; no documents give an empty result.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    aims = target.select(F.col(target_text).alias("text"))
    shared = sc.broadcast(frequent_words(texts.select("text").unionByName(aims), "text", dictionary))

    scanned = staged(bucket_rows(texts, "text", shared, run, buckets, ["doc_id"]), "resample-buckets", "zstd")
    aimed = bucket_rows(aims, "text", shared, run, buckets, [])
    gains = sc.broadcast(bucket_gains(bucket_counts(scanned, buckets), bucket_counts(aimed, buckets), buckets))

    def score(batch: pa.RecordBatch) -> list:
        get = lambda c: batch.column(batch.schema.names.index(c))
        listed = get("buckets")
        gain = np.concatenate([[0], np.cumsum(gains.value[listed.flatten().to_numpy(zero_copy_only=False)])])
        edges = listed.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        weight = gain[edges[1:]] - gain[edges[:-1]]
        more = np.array([noise(seed, "" if x is None else str(x)) for x in get("doc_id").to_pylist()], np.int64)
        return [pa.array(np.diff(edges)), pa.array(weight), pa.array(weight + more)]

    fields = [T.StructField(c, T.LongType()) for c in ("n_features", "weight", "score")]
    scored = staged(append_columns(scanned, fields, score, ["doc_id", "n_words"]).withColumn("row", F.monotonically_increasing_id()), "resample-scored")
    n = scored.where(F.col("n_words") >= least_words).count()
    drawn, able = n * percent // 100, scored.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    places = ranked(able, order, "rank", max(1, -(-n // RANKED_A_TASK))).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(rest).select(F.col("doc_id").alias(doc_id), "n_features", "weight", "score", "rank")
