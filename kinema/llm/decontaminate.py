"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows scans each text once."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, staged, unused, utf8

#: A-Z are lower-cased, these ASCII characters separate words, all else is part of a word.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_TABLE = bytes(0x20 if c in SEPARATORS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

#: Windows of items, and bytes of their text and ids, in one automaton, which every executor holds. More are scanned in several blocks.
WINDOWS_AT_ONCE, BYTES_AT_ONCE = 500_000, 32 << 20

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(window, item_id): every window of `size` item words with the id, as a string, of each item that holds it."""

    def run(batch: pa.RecordBatch) -> list:
        out = []
        for x in utf8(batch.column(batch.schema.names.index("text"))):
            words = normalised(x)
            out.append(list(dict.fromkeys(b" ".join(words[i : i + size]).decode() for i in range(max(1, len(words) - size + 1)))) if words else [])
        return [out]

    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = append_columns(rows, [T.StructField("windows", T.ArrayType(T.StringType()))], run, ["item_id"])
    return made.select("item_id", F.explode("windows").alias("window")).select("window", "item_id").distinct()


_machine: list = []  # the windows and automaton that this Python worker holds


def automaton(shared) -> tuple[list, ahocorasick.Automaton]:
    """A broadcast list of windows and its automaton, which is made once in each Python worker and in place of any other."""
    windows = shared.value
    if not _machine or _machine[0] is not windows:
        _machine.clear()
        made = ahocorasick.Automaton()
        for i, (window, _) in enumerate(windows):
            made.add_word(f" {window} ", (i, len(window) + 2, window.count(" ") + 1))
        if len(made):
            made.make_automaton()
        _machine[:] = windows, made
    return _machine[0], _machine[1]


def found_in(words: list[bytes], shared) -> tuple[list[tuple[int, int]], set[str]]:
    """(first word, words) of every occurrence of a window, and the ids of the items that these windows are of."""
    windows, machine = automaton(shared)
    if not words or not len(machine):
        return [], set()
    line = f" {b' '.join(words).decode()} "
    found = [(end - length + 1, n, i) for end, (i, length, n) in machine.iter(line)]
    if not found:
        return [], set()
    starts = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 0x20)
    first = np.searchsorted(starts, [at for at, _, _ in found]).tolist()
    return list(zip(first, (n for _, n, _ in found), strict=True)), {x for i in {i for _, _, i in found} for x in windows[i][1]}


def verdict(raw: bytes, words: list[bytes], found: list[tuple[int, int]], ids: set[str]) -> tuple:
    """The computed columns of a text."""
    hit = None
    if found:
        first, n = np.array(found).T
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + n, -1)
        hit = np.cumsum(edge)[:-1] > 0
    n_hit = 0 if hit is None else int(hit.sum())
    where = [] if hit is None else [{"start": i, "end": j} for i, j in spans(raw.decode(), hit)]
    return len(words), n_hit, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), n_hit > 0, where


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text that the hit words cover, neighbours merged."""
    at = [m.span() for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(at[i][0], at[j - 1][1]) for i, j in zip(edges[::2], edges[1::2], strict=True)]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    windows_at_once: int = WINDOWS_AT_ONCE,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256, contaminated and spans to every document.

    A window is `size` consecutive words of an item (all its words if fewer); a document word inside any occurrence
    of a window is hit. spans are the hit ranges as character offsets of the original text. One automaton of all
    windows scans every text once, as long as they are at most windows_at_once and BYTES_AT_ONCE, ids and all; more are dealt into
    blocks by hash of window and id, so that one window of many items is cut as well, and the texts are scanned for one block after the other, so that the driver and the workers hold
    one block at a time. Null and empty texts have no words and no hits; an item without words has no windows; an item
    without an id marks words but is not listed; ids that occur twice count once. Repeated document rows stay. Extra
    columns of docs stay (keep names those that do); clashing ones give way to the computed.
    """
    windows = staged(windows_of(items, item_id, item_text, size), "windows")
    n, size_of = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item_id"), F.lit(0))), F.lit(0))).first()
    blocks = max(1, -(-n // windows_at_once), -(-size_of // BYTES_AT_ONCE))
    sc = docs.sparkSession.sparkContext
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("spans", T.ArrayType(SPAN)),
    ]

    def shared(block: int):
        part = windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == block) if blocks > 1 else windows
        ids: dict[str, list[str]] = {}
        for r in part.collect():
            ids.setdefault(r.window, []).extend([] if r.item_id is None else [r.item_id])
        return sc.broadcast(list(ids.items()))

    if blocks == 1:
        one = shared(0)

        def run(batch: pa.RecordBatch) -> list:
            made = []
            for raw in utf8(batch.column(batch.schema.names.index(doc_text))):
                words = normalised(raw)
                made.append(verdict(raw, words, *found_in(words, one)))
            return [list(x) for x in zip(*made, strict=True)]

        return append_columns(docs, fields, run, keep)

    row, ranges, items_in = unused(docs, "row", "ranges", "items")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "scanned")
    hits = [T.StructField(ranges, T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField(items_in, T.ArrayType(T.StringType()))]
    found = None
    for block in range(blocks):
        one = shared(block)

        def scan(batch: pa.RecordBatch, one=one) -> list:
            made = [found_in(normalised(raw), one) for raw in utf8(batch.column(batch.schema.names.index(doc_text)))]
            return [[x for x, _ in made], [sorted(x) for _, x in made]]

        more = staged(append_columns(rows.select(row, doc_text), hits, scan, [row]).where(F.size(ranges) > 0), "block-hits")
        one.unpersist()
        found = more if found is None else found.unionByName(more)
    found = found.groupBy(row).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in (ranges, items_in)])

    def unite(batch: pa.RecordBatch) -> list:
        get = lambda c: batch.column(batch.schema.names.index(c)).to_pylist()
        made = [verdict(raw, normalised(raw), x or [], set(y or ())) for raw, x, y in zip(utf8(batch.column(batch.schema.names.index(doc_text))), get(ranges), get(items_in), strict=True)]
        return [list(x) for x in zip(*made, strict=True)]

    return append_columns(rows.join(found, row, "left"), fields, unite, docs.columns if keep is None else keep)
