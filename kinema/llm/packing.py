"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import json
import random
import re
import struct
import unicodedata
import zlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import append_columns, staged, utf8

#: Chunks of text whose ids a Python worker remembers; beyond it the memory starts anew.
MEMORY = 300_000
#: How the tokenizer that goes by merge ranks splits words, and a byte that no UTF-8 text has.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = regex.compile(WORD_PATTERN)
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
END = b"\xff"
#: Characters below this one are lower-cased and classed alike by all Unicode versions.
LATIN_END = "\u0250"
#: Items packed together; each such block wastes less than one sequence against the whole.
BLOCK = 8192
ISLANDS, POPULATION, GENERATIONS, ROUNDS = 3, 6, 10, 3

PIECE = T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


class Chunks(dict):
    """Token ids, as little-endian 32-bit bytes, of white-space-free chunks of UTF-8 text; made when first asked for.

    The tokenizer's pre-tokeniser must not join text across white space: a text's ids are then those of its chunks.
    Chunks of Latin letters go by merge ranks where the tokenizer is a BPE whose merges are numbered in order and whose
    words end in a suffix; all others, and chunks that hold one of its added tokens, go by the tokenizer itself.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = self._ranks(spec)
        added = [re.escape(x["content"]) for x in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(added) or r"(?!)", re.I)  # those that aren't special are found in lower-cased text

    @staticmethod
    def _ranks(spec: dict):
        """A byte-pair encoder with END for the end of a word, or None if the file isn't of the kind described."""
        model, pre = spec["model"], json.dumps(spec.get("pre_tokenizer"))
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or json.dumps(WORD_PATTERN) not in pre or steps != ["NFC", "Replace", "Lowercase"]:
            return None
        vocab = model["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        order = [vocab[a + b] for a, b in pairs]
        if order != sorted(order) or min(order) < 512:
            return None
        import tiktoken

        # byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
        coded = lambda x: bytes(byte[c] for c in x.removesuffix("</w>")) + (END if x.endswith("</w>") else b"")
        ranks = {coded(x): i for x, i in vocab.items() if all(c in byte for c in x.removesuffix("</w>"))}
        ranks[END] = max(vocab.values()) + 1
        return tiktoken.Encoding("chunks", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.ranks is not None and (text.isascii() or max(text) < LATIN_END) and not self.added.search(text):
            words = ASCII_WORDS.findall(text.lower()) if text.isascii() else WORDS.findall(unicodedata.normalize("NFC", text).lower())
            ids = [i for w in words for i in self.ranks(w.encode() + END)]
        else:
            ids = self.encode(text)
        if len(self) >= MEMORY:
            self.clear()
        made = self[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        return made

    def encode(self, text: str) -> list[int]:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_tokenizers: dict[str, Chunks] = {}


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece of at most `size` ids: doc_id, piece, start, length, ids_crc32, uid.

    A document's ids are the tokenizer's for its whole text, then `end`; null and empty texts are one id long. Only
    documents of more than `size` ids are cut. uid numbers the rows, so repeated documents and null ids stay apart.
    """

    def run(batch: pa.RecordBatch) -> list:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = Chunks(tokenizer)
        chunks, last, out = _tokenizers[tokenizer], struct.pack("<I", end), []
        for text in utf8(batch.column(batch.schema.names.index("text"))):
            raw = chunks.ids(text) + last
            n = len(raw) // 4
            out.append([
                {"piece": i, "start": at, "length": min(size, n - at), "ids_crc32": zlib.crc32(raw[4 * at : 4 * (at + size)])}
                for i, at in enumerate(range(0, n, size))
            ])
        return [out]

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut = append_columns(rows, [T.StructField("pieces", T.ArrayType(PIECE))], run, ["doc_id"])
    flat = cut.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")
    return staged(flat.withColumn("uid", F.monotonically_increasing_id()), "pieces")


class Packing:
    """Bins of item numbers and their fills: an individual of the grouping genetic algorithm."""

    __slots__ = ("bins", "fills")

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    @classmethod
    def of(cls, places: list[int], lengths: list[int]) -> Packing:
        """From the bin number of every item."""
        made = cls([[] for _ in range(max(places, default=-1) + 1)], [0] * (max(places, default=-1) + 1))
        for i, k in enumerate(places):
            made.bins[k].append(i)
            made.fills[k] += lengths[i]
        return made

    def places(self, n: int) -> list[int]:
        out = [0] * n
        for k, b in enumerate(self.bins):
            for i in b:
                out[i] = k
        return out

    def cost(self, size: int) -> tuple[int, float]:
        """Fewer bins are better; of equally many, fuller full bins (the mean squared fill)."""
        return len(self.bins), -sum(x * x for x in self.fills) / max(1, size * size * len(self.fills))

    def without(self, drop: set[int]) -> tuple[Packing, list[int]]:
        """The packing without some bins, and the documents that this displaces."""
        stay = [k for k in range(len(self.bins)) if k not in drop]
        return Packing([list(self.bins[k]) for k in stay], [self.fills[k] for k in stay]), [i for k in drop for i in self.bins[k]]


def best_fit(items: list[int], lengths: list[int], size: int, start: Packing | None = None) -> Packing:
    """Put items, in the order given, each into the fullest bin that has room for it, or else into a new one; changes start."""
    made = start or Packing([], [])
    free = sorted((size - x, k) for k, x in enumerate(made.fills))
    for i in items:
        need = lengths[i]
        at = bisect.bisect_left(free, (need, -1))
        if at < len(free):
            room, k = free.pop(at)
            made.bins[k].append(i)
            made.fills[k] += need
        else:
            room, k = size, len(made.bins)
            made.bins.append([i])
            made.fills.append(need)
        bisect.insort(free, (room - need, k))
    return made


def crossover(a: Packing, b: Packing, lengths: list[int], size: int, rng: random.Random) -> Packing:
    """a with well-filled bins of b put in whole; a's bins that hold one of their items go, the displaced are best-fitted."""
    order = sorted(range(len(b.bins)), key=lambda k: -b.fills[k])
    good = [k for k in order if b.fills[k] >= 0.98 * size] or order[: -(-len(order) // 10)]
    taken = rng.sample(good, rng.randint(1, -(-len(good) // 2)))
    inside = {i for k in taken for i in b.bins[k]}
    rest, loose = a.without({k for k, x in enumerate(a.bins) if not inside.isdisjoint(x)})
    loose = sorted((i for i in loose if i not in inside), key=lambda i: -lengths[i])
    return best_fit(loose, lengths, size, Packing([*rest.bins, *(list(b.bins[k]) for k in taken)], [*rest.fills, *(b.fills[k] for k in taken)]))


def mutate(a: Packing, lengths: list[int], size: int, rng: random.Random) -> Packing:
    """Empty the least filled bins and some others, and best-fit their items anew."""
    order = sorted(range(len(a.bins)), key=lambda k: a.fills[k])
    some = rng.sample(order, min(len(order), rng.randint(2, max(2, len(order) // 4))))
    rest, loose = a.without({*order[: max(1, len(order) // 50)], *some})
    return best_fit(sorted(loose, key=lambda i: -lengths[i]), lengths, size, rest)


def least_bins(lengths: list[int], size: int) -> int:
    return max(-(-sum(lengths) // size), sum(2 * n > size for n in lengths))


def evolve(lengths: list[int], size: int, population: list[list[int]], seed: int) -> tuple[list[list[int]], int]:
    """GENERATIONS at most of an island: its individuals, as bin numbers by item, the best first; the generations used.

    The individuals of an empty population are best-fit in random order. In every generation the best is crossed with
    another and mutated, and the best POPULATION of all stay. An island whose best has as few bins as the total length
    allows is done.
    """
    rng, n, least = random.Random(seed), len(lengths), least_bins(lengths, size)
    pool = [Packing.of(x, lengths) for x in population] or [best_fit(rng.sample(range(n), n), lengths, size) for _ in range(POPULATION)]
    scored = sorted(((p.cost(size), k, p) for k, p in enumerate(pool)), key=lambda x: x[:2])
    used = 0
    while used < GENERATIONS and n and scored[0][0][0] > least:
        used += 1
        best, other = scored[0][2], rng.choice(scored[1:] or scored)[2]
        children = [crossover(best, other, lengths, size, rng), crossover(other, best, lengths, size, rng), mutate(best, lengths, size, rng)]
        known = {x[0] for x in scored}
        fresh = [(c.cost(size), len(scored) + k, c) for k, c in enumerate(children)]
        scored = sorted(scored + [x for x in fresh if x[0] not in known], key=lambda x: x[:2])[:POPULATION]
    return [x[2].places(n) for x in scored], used


STATE = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("island", T.IntegerType()), T.StructField("lengths", T.ArrayType(T.IntegerType())),
    T.StructField("population", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("bins", T.IntegerType()), T.StructField("least", T.IntegerType()),
])


def evolved(state: DataFrame, size: int, seed: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> list:
        rows = batch.to_pylist()
        pools = [evolve(r["lengths"], size, r["population"], hash((seed, r["block"], r["island"])))[0] for r in rows]
        return [pools, [max(p[0], default=-1) + 1 for p in pools], [least_bins(r["lengths"], size) for r in rows]]

    return append_columns(state, STATE.fields[3:], run, STATE.names[:3])


def pack(items: DataFrame, uid: str = "uid", length: str = "length", size: int = 4096, block: int = BLOCK) -> DataFrame:
    """Places for all items: (uid, sequence_id, offset); no sequence is longer than `size`, offsets are gapless from 0.

    Items, of distinct non-null uids, are dealt by a hash of uid into blocks of about `block`, so that no task holds
    more and no length or source makes a hot block. Each block's islands evolve populations of packings; between
    rounds each island's best migrates to the next. A block on which an island meets the least number of sequences
    rests. A length over `size` raises an error; an empty table gives an empty result.
    """
    rows = items.select(F.col(uid).alias("uid"), F.col(length).cast("int").alias("length"))
    blocks = max(1, -(-rows.count() // block))
    wide = F.when(F.col("length") > size, F.raise_error(F.lit(f"an item is longer than {size}"))).otherwise(F.col("length"))
    dealt = rows.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), "uid", wide.alias("length"))
    held = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("items"))
    held = staged(held.select("block", F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths")), "pack-items")
    state = held.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths",
        F.array().cast("array<array<int>>").alias("population"), F.lit(0).alias("bins"), F.lit(0).alias("least"),
    )
    done = []
    for turn in range(ROUNDS):
        state = staged(evolved(state.repartition(max(1, min(blocks * ISLANDS, 4096)), "block", "island"), size, turn), "pack-state")
        best = F.min("bins").over(W.partitionBy("block"))
        if turn + 1 < ROUNDS:
            ranked = state.withColumn("best", best)
            open_ = ranked.where("best > least")
            done.append(ranked.where("best <= least").select(state.columns))
            if open_.isEmpty():
                state = None
                break
            elite = open_.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("population", 1, 1).alias("elite"))
            state = open_.join(elite, ["block", "island"]).withColumn("population", F.concat("elite", "population")).select(STATE.names)
    if state is not None:
        done.append(state.select(STATE.names))
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)
    best = ends.groupBy("block").agg(F.min_by(F.get("population", F.lit(0)), F.struct("bins", "island")).alias("place"))
    placed = held.join(best, "block").select("block", F.explode(F.arrays_zip("uids", "lengths", "place")).alias("x"))
    flat = placed.select((F.col("block") * (1 << 20) + F.col("x.place")).alias("sequence_id"), F.col("x.uids").alias("uid"), F.col("x.lengths").cast("long").alias("length"))
    before = W.partitionBy("sequence_id").orderBy("uid").rowsBetween(W.unboundedPreceding, -1)
    return flat.select("uid", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end: int = 1) -> DataFrame:
    """Tokenise, cut and pack all documents: one row per piece, see pieces() and pack()."""
    cut = pieces(docs, tokenizer, doc_id, text, size, end)
    return cut.join(pack(cut, size=size), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
