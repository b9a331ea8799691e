"""Removal of repeated byte strings by column-wise construction of suffix order, BWT and common prefixes of many documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, slices, small_batches, staged, utf8

#: Length in bytes of the strings that are removed where they occur again. A multiple of SYMBOL.
SPAN = 100
#: Bytes of an anchor: every string of SPAN bytes has one, the smallest by hash of its substrings of this length.
ANCHOR = 32
#: Bytes that are one symbol of the construction.
SYMBOL = 4
#: Segments, about, that are ordered together; those of one anchor always are.
BATCH = 2_000
#: Windows of one anchor that are compared together.
RUN = 16
#: Window starts that are hashed at once, so that work arrays stay in the processor's cache.
CHUNK = 1 << 17
#: Bytes of segments that one task orders; an anchor with more segments than SPLIT is dealt out window by window.
TASK_BYTES, SPLIT = 3 << 20, 10_000

ANCHORS = T.StructType([
    T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("at", T.IntegerType()),
    T.StructField("n", T.ShortType()), T.StructField("d", T.ShortType()), T.StructField("dup", T.BooleanType()),
])
SEGMENTS = T.StructType([
    T.StructField("h", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.ShortType()),
    T.StructField("d", T.ShortType()), T.StructField("raw", T.BinaryType()), T.StructField("hot", T.BooleanType()),
])
SPANS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])


def _hashes(window: np.ndarray) -> np.ndarray:
    """64-bit hashes of all substrings of ANCHOR bytes."""
    m = len(window) - ANCHOR + 1
    eights = np.ndarray((len(window) - 7,), "<u8", buffer=window.data, strides=(1,))
    made = np.zeros(m, np.uint64)
    for j in range(0, ANCHOR, 8):
        made += eights[j : j + m]
        made *= np.uint64(0x9E3779B97F4A7C15)
        made ^= made >> np.uint64(29)
    return made


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of window starts with the same anchor: (text number, first start, starts, anchor - first start, anchor hash).

    A window is SPAN bytes inside one text; its anchor is the leftmost of its smallest substrings by hash. Equal windows
    have equal anchors at equal places.
    """
    flat = np.frombuffer(b"".join(texts), np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(length) - length
    edge = np.zeros(len(flat) + 1, np.int8)
    long = length >= SPAN
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, (begin + length)[long] - SPAN + 1, -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    found = []
    for s in range(0, len(flat) - SPAN + 1, CHUNK):
        window = np.ascontiguousarray(flat[s : s + CHUNK + SPAN - 1])
        h = _hashes(window)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        size, want = 1, SPAN - ANCHOR + 1
        while 2 * size <= want:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < want:
            least = np.minimum(least[: len(least) - (want - size)], least[want - size :])
        at = np.flatnonzero(inside[s : s + len(least)])
        if not len(at):
            continue
        anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
        last = at[np.concatenate((new[1:] - 1, [len(at) - 1]))]
        first, anchor = at[new], anchor[new]
        found.append((first + s, last - first + 1, anchor - first, h[anchor] >> np.uint64(16)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    first, n, d, h = (np.concatenate(x) for x in zip(*found, strict=True))
    # a window belongs to the text it starts in; adjacent windows of two texts never share a run, as SPAN - 1 starts lie between
    text = np.searchsorted(begin, first, side="right") - 1
    return text, first - begin[text], n, d, h.astype(np.int64)


def _anchor_rows(ids: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    text, at, n, d, h = segments(texts)
    digest = xxhash.xxh3_64_intdigest
    raw = [digest(texts[t][i:j]) for t, i, j in zip(text.tolist(), at.tolist(), (at + n + SPAN - 1).tolist(), strict=True)]
    g = np.array(raw, np.uint64) ^ (d.astype(np.uint64) << np.uint64(56))
    doc = ids[text] if len(text) else np.zeros(0, np.int64)
    order = np.lexsort((at, doc, g, h))
    same = np.zeros(len(order), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    dup = np.zeros(len(order), bool)
    dup[order] = same
    columns = [h, g.view(np.int64), doc, at.astype(np.int32), n.astype(np.int16), d.astype(np.int16), dup]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=ANCHORS.names)


class _Ranges:
    """Minima of ranges of a byte array, by minima of all ranges of a power of two."""

    def __init__(self, values: np.ndarray, longest: int):
        self.level = [values]
        while 2 ** len(self.level) <= longest:
            half, last = 2 ** (len(self.level) - 1), self.level[-1]
            self.level.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima over first..last, both inside."""
        out = np.empty(len(first), np.uint8)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(self.level[k][first[i]], self.level[k][last[i] - 2 ** int(k) + 1])
        return out


def suffix_order(symbols: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order all suffixes of many documents, column by column: (document, length, preceding symbol, common prefix).

    symbols: the documents' 32-bit symbols one after the other; ends: where each ends. Round j inserts the suffixes of
    length j of all documents that are so long: each document gives one symbol, which is written into the collection's
    BWT where its suffix of length j - 1 lies; the new suffix comes after all with a smaller first symbol and, among
    those of the same, in the order of what follows it. Common prefixes, counted to `most`, are updated beside new
    suffixes alone: one more than the least common prefix between the two suffixes without their first symbols.
    A document's own end sorts first, ends of different documents in their order.
    """
    m = len(ends)
    size = np.diff(ends, prepend=0)
    place = np.arange(m)  # of each document's longest suffix so far; empty suffixes come first, one per document
    doc, length, bwt, lcp = np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    key = np.zeros(0, np.uint64)  # first symbol, then the place of the rest
    low = np.uint64(0xFFFFFFFF)
    for j in range(1, int(size.max(initial=0)) + 1):
        active = np.flatnonzero(size >= j)
        symbol = symbols[ends[active] - j]
        if j > 1:
            bwt[place[active] - m] = symbol
        fresh = (symbol.astype(np.uint64) << np.uint64(32)) | place[active].astype(np.uint64)
        order = np.argsort(fresh, kind="stable")
        active, fresh = active[order], fresh[order]
        before = np.searchsorted(key, fresh)
        index = before + np.arange(len(fresh))
        total = len(key) + len(fresh)
        old = np.ones(total, bool)
        old[index] = False

        def merged(a: np.ndarray, b, old=old, index=index, total=total) -> np.ndarray:
            out = np.empty(total, a.dtype)
            out[old] = a
            out[index] = b
            return out

        joined = merged(key, fresh)
        prefix = merged(lcp, 0)
        mark = np.zeros(total + 1, bool)
        mark[index] = mark[index + 1] = True
        mark[0] = False
        beside = np.flatnonzero(mark[:total])
        left, right = joined[beside - 1], joined[beside]
        alike = (left >> np.uint64(32)) == (right >> np.uint64(32))
        value = np.zeros(len(beside), np.uint8)
        a, b = (left[alike] & low).astype(np.int64), (right[alike] & low).astype(np.int64)
        least = np.zeros(len(a), np.uint8)
        real = a >= m
        if real.any():
            first, last = a[real] - m + 1, b[real] - m
            least[real] = _Ranges(lcp, int((last - first).max()) + 1).least(first, last)
        value[alike] = np.minimum(least, most - 1) + 1
        prefix[beside] = value
        shift = np.concatenate((np.zeros(m, np.int64), np.cumsum(np.bincount(before, minlength=len(key) + 1))[: len(key)]))
        joined += shift[(joined & low).astype(np.int64)].astype(np.uint64)
        doc, length, bwt = merged(doc, active), merged(length, j), merged(bwt, 0)
        key, lcp = joined, prefix
        place[active] = m + index
    return doc, length, bwt, lcp


def narrowed(raw: list[bytes], at: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut segments into runs of windows that all hold a longer substring, and drop runs whose substring is the only one.

    Windows that start RUN to 2 * RUN - 1 bytes before their anchor, say, all hold the bytes from RUN before it to
    SPAN - 2 * RUN + 1 after it; only windows of equal such bytes can be equal. Returns (raw, segment number, at, n, d).
    """
    digest, step = xxhash.xxh3_64_intdigest, RUN
    of, low, keys = [], [], []
    for i, (x, k, far) in enumerate(zip(raw, n.tolist(), d.tolist(), strict=True)):
        for r in range((far - k + 1) // step, far // step + 1):  # windows r * step to (r + 1) * step - 1 bytes before the anchor
            of.append(i)
            low.append(r)
            keys.append(digest(x[far - r * step : far - (r + 1) * step + 1 + SPAN], r))
    of, low, keys = np.array(of, np.int64), np.array(low, np.int64), np.array(keys, np.uint64)
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    stay = count[inverse] > 1
    of, low = of[stay], low[stay]
    most, least = np.minimum(d[of], (low + 1) * step - 1), np.maximum(d[of] - n[of] + 1, low * step)
    skip, count = d[of] - most, most - least + 1
    return [raw[i][j : j + k - 1 + SPAN] for i, j, k in zip(of.tolist(), skip.tolist(), count.tolist(), strict=True)], of, at[of] + skip, count, most


def repeated_windows(raw: list[bytes], owner: np.ndarray, at: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, start, stop) of merged windows of SPAN bytes that also start earlier, by owner and then start.

    raw: segments of n window starts from `at` on in document `owner`, their anchor d bytes after `at`. Each segment is
    up to SYMBOL documents of the construction, one for each distance of window and anchor modulo SYMBOL.
    """
    raw, segment, at, n, d = narrowed(raw, at, n, d)
    owner = owner[segment]
    parts, of, start = [], [], []
    for r in range(SYMBOL):
        skip = (d - r) % SYMBOL
        k = (n - 1 - skip) // SYMBOL  # windows after the first
        for i in np.flatnonzero(n > skip).tolist():
            parts.append(raw[i][skip[i] : skip[i] + SYMBOL * int(k[i]) + SPAN])
            of.append(i)
            start.append(int(skip[i]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    of, start = np.array(of), np.array(start)
    ends = np.cumsum([len(x) // SYMBOL for x in parts])
    doc, length, _, lcp = suffix_order(np.frombuffer(b"".join(parts), ">u4").astype(np.uint32), ends, SPAN // SYMBOL)
    group = np.cumsum(lcp < SPAN // SYMBOL)
    shared = np.bincount(group)[group] > 1
    doc, length, group = doc[shared], length[shared].astype(np.int64), group[shared]
    who = owner[of[doc]]
    begin = at[of[doc]] + start[doc] + SYMBOL * (np.diff(ends, prepend=0)[doc] - length)
    order = np.lexsort((begin, who, group))
    group, who, begin = group[order], who[order], begin[order]
    again = np.concatenate(([False], group[1:] == group[:-1])) if len(group) else np.zeros(0, bool)
    who, begin = who[again], begin[again]
    order = np.lexsort((begin, who))
    who, begin = who[order], begin[order]
    new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (begin[1:] > begin[:-1] + SPAN)))) if len(who) else np.zeros(0, np.int64)
    last = np.concatenate((new[1:] - 1, [len(who) - 1])) if len(new) else new
    return who[new], begin[new], begin[last] + SPAN


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """(key, id, z): long keys in document order and compressed texts; whether keys differ from ids."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    odd = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")
    if odd.isEmpty():
        return rows.withColumn("key", F.col("id")), False
    ordered = rows.orderBy(F.col("id").asc_nulls_last(), "text")
    return staged(ordered.withColumn("key", F.monotonically_increasing_id()), "suffix-keys"), True


def _compressed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Texts as zstd frames, so that shuffles carry less."""

    def run(batch: pa.RecordBatch) -> list:
        pack = zstandard.ZstdCompressor(level=1).compress
        return [[pack(x) for x in utf8(batch.column(batch.schema.names.index("text")))]]

    return append_columns(rows.select(*keep, "text"), [T.StructField("z", T.BinaryType())], run, keep)


def _unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc, start, stop): byte ranges, possibly overlapping, of (key, text) rows whose strings of SPAN bytes also start earlier."""

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 << 20):
                yield _anchor_rows(part.column(0).to_numpy(zero_copy_only=False), utf8(part.column(1)))

    small_batches(rows.sparkSession)
    found = rows.select("key", "text").mapInArrow(anchor, ANCHORS)
    # a row that repeats another of its slice is settled; it is dealt out by its place, which no other row shares
    dealt = found.withColumn("k", F.when(F.col("dup"), F.xxhash64("doc", "at")).otherwise(F.col("h")))
    counted = dealt.withColumn("n_rows", F.expr("count(*) over (partition by k)"))
    known = staged(counted.where("dup or n_rows > 1").drop("k", "n_rows"), "suffix-anchors")

    place = F.struct("doc", "at", "n", "d")
    kinds = staged(known.where("not dup").groupBy("h", "g").agg(F.min(place).alias("first")), "suffix-kinds")
    # segments equal to an earlier one are repeated as a whole
    later = known.where("not dup").join(kinds, ["h", "g"]).where((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    whole = known.where("dup").select("doc", "at", "n").unionByName(later.select("doc", "at", "n")).select("doc", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + SPAN).cast("int").alias("stop"))

    # the first of each kind is compared with the other kinds of its anchor
    many = staged(kinds.groupBy("h").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1"), "suffix-many")
    ours = kinds.join(many, "h").select("h", "first.*", (F.col("n_kinds") > SPLIT).alias("hot"))
    wanted = ours.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "n", "d", "hot")).alias("wanted")).withColumnRenamed("doc", "key")
    with_text = _compressed(rows, ["key"]).join(wanted, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary(), pa.bool_()]

        def packed(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=SEGMENTS.names)

        for batch in batches:
            out, size = [], 0
            for key, z, want in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = _unpacked(z)
                for w in want:
                    at, n, d = w["at"], w["n"], w["d"]
                    if not w["hot"]:
                        out.append((w["h"], key, at, n, d, text[at : at + n - 1 + SPAN], False))
                        size += n + SPAN
                        continue
                    for i in range(n):
                        one = text[at + i : at + i + SPAN]
                        out.append((xxhash.xxh64_intdigest(one, 7) >> 1, key, at + i, 1, d - i, one, True))
                        size += SPAN
                if size > 4 << 20:
                    yield packed(out)
                    out, size = [], 0
            if out:
                yield packed(out)

    pieces = staged(with_text.select("key", "z", "wanted").mapInArrow(cut, SEGMENTS), "suffix-segments")
    hot = pieces.where("hot").groupBy("h", "raw").agg(F.min(F.struct("doc", "at", "n", "d")).alias("first"), F.count("*").alias("n_rows")).where("n_rows > 1")
    hot = staged(hot, "suffix-hot")
    hot_rest = pieces.where("hot").join(hot, ["h", "raw"]).where((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    hot_spans = hot_rest.select("doc", F.col("at").alias("start"), (F.col("at") + SPAN).alias("stop"))

    cold = pieces.where("not hot").select("h", "doc", "at", "n", "d", "raw")
    total = cold.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("h")
        h, doc, at, n, d = (t.column(c).to_numpy().astype(np.int64) for c in ("h", "doc", "at", "n", "d"))
        raw = t.column("raw").to_pylist()
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))  # anchors are ordered some at a time, in the cache
        cuts = [0, *new[np.flatnonzero(np.diff(new // BATCH)) + 1].tolist(), len(h)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            who, start, stop = repeated_windows(raw[i:j], doc[i:j], at[i:j], n[i:j], d[i:j])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=SPANS.names)

    compared = cold.repartition(int(tasks), "h").mapInArrow(compare, SPANS)
    return whole.unionByName(hot_spans).unionByName(compared)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts_out: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans and kept, the bytes left, if texts_out).

    Every byte inside a string of SPAN bytes that also starts earlier (in a document of a smaller id, or earlier in the
    same) is removed; strings are those of the input and never cross documents. A null text is empty; texts under SPAN
    bytes stay whole. Ids that are null come last; rows of one id are ordered by text, and each is a document of its
    own. Extra columns are not read; an empty table gives an empty result.

    Strings that repeat meet by anchor: a content-defined substring that each of them has. Anchors that occur once are
    done with; equal segments around an anchor are settled by their first occurrence; what is left goes, anchor by
    anchor, to tasks of about TASK_BYTES that order all suffixes column by column (suffix_order). Anchors with over
    SPLIT different segments are dealt out by window instead, so that no task holds a hot anchor.
    """
    rows, _ = _keyed(docs, doc_id, text)
    spans = repeated_spans(rows).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnRenamed("doc", "key")
    joined = _compressed(rows, ["key", "id"]).join(spans, "key", "left").select("id", "z", "spans")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    if texts_out:
        fields += [T.StructField("removed", span), T.StructField("kept", T.BinaryType())]

    def run(batch: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in fields]
        for z, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, merged = _unpacked(z), []
            for s in sorted((x["start"], x["stop"]) for x in found or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            edges = [0, *(x for m in merged for x in m), len(raw)]
            kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
            row = [len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"start": i, "stop": j} for i, j in merged], kept]
            for values, x in zip(out, row, strict=False):
                values.append(x)
        return out

    return append_columns(joined, fields, run, ["id"]).withColumnRenamed("id", doc_id)
