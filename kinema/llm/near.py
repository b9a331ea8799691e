"""SimHash near-dedup at a similarity: blocks of the fingerprint's bits, Hamming check, exact similarity, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import append_columns, marked, slices, staged, unused, utf8
from .graph import connected_components

#: Words of a shingle, and the similarity of a pair, as a fraction: 4 of 5.
WIDTH, ABOVE, BELOW = 5, 4, 5
#: Words of 64 bits in a fingerprint, and bits in which those of a pair may differ; at the similarity they differ in 39 of
#: 256 on average, with a deviation of 6. Votes of small sets are closer: up to MEDIUM shingles more bits may differ.
WORDS, DISTANCE, MEDIUM, MEDIUM_DISTANCE = 4, 63, 24, 104
#: Blocks that a fingerprint is cut into, bits of their numbers, and bits of a block.
BLOCKS, BLOCK_BITS, BITS = 16, 4, 16
#: Bits of a block whose votes were the closest, that are also taken as turned, by the shingles that a set has at least; the
#: votes of few shingles are often even. Sets of fewer than the first of them have no blocks: only equal sets are similar to them.
TURNS = ((4, 5), (12, 4), (MEDIUM + 1, 2))
#: Words of a fingerprint that its rows carry while blocks are met, and bits in which those of a pair may differ.
CARRIED, CARRIED_DISTANCE, CARRIED_MEDIUM = 2, 38, 52
#: Words of an odd sketch, and shingles up to which sets have one: of sets that are similar, at most so many shingles are in one
#: alone that those of chance and of a common passage differ in far more bits.
ODD, SMALL = 2, 160
#: Low bits of a block in which blocks of one group differ. A group goes to one task, and a set is listed once in it.
LOW = 6
#: Rows of groups that are compared at once.
ROWS = 1 << 16
#: Documents of a block of over COMPARED sets that its others are compared with first, by round; other ones each round.
PIVOTS = (1, 4, 16)
#: Sets of a block that are all compared with each other; larger blocks are split by the other blocks of their sets.
COMPARED = 1_024
#: Values of a set's sketch, the smallest of its shingles' 32-bit hashes. Of sets that have no more shingles the similarity by
#: sketches is exact but for equal hashes, which only raise it; of larger ones the estimate may be MARGIN too low.
SKETCH, MARGIN = 512, 0.1
#: Bytes of shingle sets that a Python worker remembers while it compares.
REMEMBERED = 64 << 20


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct XXH64 values, unsigned, of a text's shingles; of all its words if they are fewer."""
    words = text.lower().split()
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + width])) for i in range(n)], np.uint64))


def set_key(values: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(values.tobytes())], np.uint64).view(np.int64)[0])


def _votes(values: np.ndarray) -> np.ndarray:
    """For each bit of the SimHash, the shingles in whose hash it is set less those in whose it isn't."""
    mixed = values * np.array([[0x9E3779B97F4A7C15], [0xBF58476D1CE4E5B9], [0x94D049BB133111EB], [0xD6E8FEB86659FD93]], np.uint64)[:WORDS]
    mixed ^= mixed >> np.uint64(32)
    bits = np.unpackbits(mixed.view(np.uint8).reshape(WORDS, -1, 8), axis=-1)
    return 2 * bits.sum(1, dtype=np.int32).ravel() - len(values)


def _of_votes(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0).view(np.int64)


def fingerprint(values: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set, WORDS signed words long: a bit is 1 if set in over half of the hashes."""
    return _of_votes(_votes(values))


def _turns(votes: np.ndarray, n: int) -> bytes:
    """Which bits of each block are also taken as turned, block by block: those of the closest votes."""
    turned = next((t for least, t in reversed(TURNS) if n >= least), 0)
    if not turned:
        return b""
    return np.argsort(np.abs(votes[: BLOCKS * BITS]).reshape(BLOCKS, BITS), axis=1, kind="stable")[:, :turned].astype(np.uint8).tobytes()


def _blocks(fps: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The blocks of fingerprints (a row each), with any of a block's turns (fingerprint, block, bit) taken, as numbers."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1)[:, : BLOCKS * BITS].reshape(len(fps), BLOCKS, BITS)
    out = (bits @ (1 << np.arange(BITS, dtype=np.int32)) | np.arange(BLOCKS, dtype=np.int32) << BITS)[..., None]
    for i in range(turns.shape[2]):
        out = np.concatenate([out, out ^ np.int32(1) << turns[..., i : i + 1].astype(np.int32)], axis=2)
    return out.reshape(len(fps), -1)


def block_words(values: np.ndarray) -> np.ndarray:
    """The blocks of a shingle set: those of its SimHash, and the same with bits of the closest votes turned.

    Two sets are candidates if they have a block in common: a block's bits are equal but for such that either votes on closely.
    """
    votes = _votes(values)
    turns = np.frombuffer(_turns(votes, len(values)), np.uint8)
    return _blocks(_of_votes(votes)[None], turns.reshape(1, BLOCKS, -1))[0] if len(turns) else np.zeros(0, np.int32)


def odd_sketch(values: np.ndarray) -> bytes:
    """ODD words of bits, each 1 if an odd number of the set's shingles has its place. Sets differ in no more bits than shingles."""
    mixed = values * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    places = mixed * np.uint64(0x94D049BB133111EB) >> np.uint64(32)
    return np.packbits(np.bincount((places % np.uint64(64 * ODD)).astype(np.int64), minlength=64 * ODD) & 1).tobytes()


def sketch(values: np.ndarray) -> np.ndarray:
    """The smallest SKETCH distinct 32-bit hashes of a shingle set, sorted."""
    mixed = values * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    low = np.unique((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32))
    return low[:SKETCH]


def sketched_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets by their sketches."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    twice = both[1:] == both[:-1]
    if len(a) < SKETCH and len(b) < SKETCH:
        return twice.sum() / max(1, len(both) - twice.sum())
    low = np.unique(both)[:SKETCH]  # of the union: what lies in both sketches is in both sets
    return np.isin(low, both[1:][twice], assume_unique=True).sum() / len(low)


def _near_in_block(keys: np.ndarray, sizes: np.ndarray, fps: np.ndarray, parts: list[int], sketches: list[np.ndarray], first: bool) -> Iterator[tuple[int, int]]:
    """Pairs (places) of a block's sets that differ in part and may be similar, by size, Hamming distance and sketch.

    Where sketches are whole sets, a pair that is similar by them joins the parts of its sets: more pairs of these wouldn't change
    what is connected. Of larger sets, at first only pairs that are similar by estimate are given, and join parts as well, so
    that a group of copies has few pairs; later, when parts are of links that are sure, all pairs that may be similar.
    """
    root = {p: p for p in parts}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for i in range(len(keys) - 1):
        differ = np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(axis=1)
        n, other = sizes[i], sizes[i + 1 :]
        low, high = np.minimum(n, other), np.maximum(n, other)
        for j in (np.flatnonzero((low * BELOW >= high * ABOVE) & (differ <= np.where(low <= MEDIUM, MEDIUM_DISTANCE, DISTANCE))) + i + 1).tolist():
            if parts[i] == parts[j]:
                continue
            a, b = sketches[i], sketches[j]
            joins = first or len(a) < SKETCH and len(b) < SKETCH
            if joins and find(parts[i]) == find(parts[j]):
                continue
            if sketched_similarity(a, b) >= ABOVE / BELOW - (1e-9 if joins else MARGIN):
                yield i, j
                if joins:
                    root[find(parts[i])] = find(parts[j])


KEYED = [T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.ArrayType(T.LongType())), T.StructField("turns", T.BinaryType()), T.StructField("odd", T.BinaryType())]


def with_fingerprints(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, key, n, fp, turns, odd): the shingle set's key, size, fingerprint, turns of its blocks and odd sketch of every text."""

    def run(batch: pa.RecordBatch) -> list:
        sets = [shingle_set(x) for x in utf8(batch.column(batch.schema.names.index(text)))]
        votes = [_votes(x) for x in sets]
        fps = pa.array([_of_votes(x) for x in votes], pa.list_(pa.int64()))
        turns = [_turns(x, len(y)) for x, y in zip(votes, sets, strict=True)]
        return [[set_key(x) for x in sets], [len(x) for x in sets], fps, turns, [odd_sketch(x) if len(x) <= SMALL else b"" for x in sets]]

    return append_columns(docs, KEYED, run, keep)


def _in_groups(fps: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sets, blocks): a row for each group that holds blocks of a fingerprint, _blocks but for turned low bits; which of these are turned stands above the block."""
    own = _blocks(fps, turns[..., :0])[..., None]
    bits = np.int32(1) << turns.astype(np.int32)
    low = bits < 1 << LOW
    marks = np.where(low, bits, 0).sum(axis=2, dtype=np.int32)[..., None] << np.int32(BITS + BLOCK_BITS)
    blocks, listed = own, np.ones(own.shape, bool)
    for i in range(turns.shape[2]):
        blocks = np.concatenate([blocks, blocks ^ bits[..., i : i + 1]], axis=2)
        listed = np.concatenate([listed, listed & ~low[..., i : i + 1]], axis=2)
    return np.nonzero(listed)[0], (blocks | marks)[listed]


def _group(block):
    """The group of a listed row's block, of numbers and arrays."""
    return block >> LOW & (1 << BITS + BLOCK_BITS - LOW) - 1


def _ungrouped(listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, blocks): the blocks of listed rows, with the low bits turned as well that are marked."""
    marks, rows, blocks = listed >> BITS + BLOCK_BITS, np.arange(len(listed)), listed & (1 << BITS + BLOCK_BITS) - 1
    for i in range(LOW):
        at = np.flatnonzero(marks[rows] >> i & 1)
        rows, blocks = np.concatenate([rows, rows[at]]), np.concatenate([blocks, blocks[at] ^ 1 << i])
    return rows, blocks


def _listed(groups: DataFrame) -> DataFrame:
    """(block, key, n, f0, ..., o0, ...): every set under each group of its blocks, with CARRIED words of its fingerprint and its odd sketch.

    Pairs of sets that have odd sketches are told by these alone: the fingerprint is 0 where all similar sets have one, the sketch
    where there is none.
    """
    names = [f"f{i}" for i in range(CARRIED)] + [f"o{i}" for i in range(ODD)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, fp, turns, odd = (batch.column(batch.schema.names.index(c)) for c in ("key", "n", "fp", "turns", "odd"))
            key, n, fp, turns = key.to_numpy(), n.to_numpy(), fp.flatten().to_numpy().reshape(-1, WORDS), turns.to_pylist()
            odd = np.frombuffer(b"".join(x or bytes(8 * ODD) for x in odd.to_pylist()), np.int64).reshape(-1, ODD)
            words = [*(np.where(n * BELOW <= SMALL * ABOVE, 0, fp[:, i]) for i in range(CARRIED)), *(odd[:, i] for i in range(ODD))]
            sizes = np.array([len(x) for x in turns])
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                sets, blocks = _in_groups(fp[at], np.frombuffer(b"".join(turns[i] for i in at), np.uint8).reshape(len(at), BLOCKS, -1))
                each = at[sets]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (blocks, key[each], n[each], *(w[each] for w in words))], names=["block", "key", "n", *names])

    return groups.select("key", "n", "fp", "turns", "odd").mapInArrow(run, "block int, key long, n int, " + ", ".join(f"{w} long" for w in names))


def _near_parts(block: np.ndarray, n: np.ndarray, words: np.ndarray, odd: np.ndarray | None = None) -> np.ndarray:
    """The part of each row: rows of a block that may be near, by size and by Hamming distance, are of one part.

    The distance is that of odd sketches where these are given and both sets have one, else of the words carried.
    Rows are in order of (block, n). Each is compared with those after it, one place further on at a time, as far as
    block and size allow; pairs of rows that are of one part already are passed over.
    """
    part = np.arange(len(block))
    most = np.where(n <= MEDIUM, CARRIED_MEDIUM, CARRIED_DISTANCE)
    at, d = np.arange(len(block)), 1
    while len(at):
        at = at[at + d < len(block)]
        at = at[(block[at] == block[at + d]) & (n[at] * BELOW >= n[at + d] * ABOVE)]
        i = at[part[at] != part[at + d]]
        by_words = np.bitwise_count(words[i] ^ words[i + d]).sum(axis=1, dtype=np.int32) <= most[i]
        if odd is None:
            i = i[by_words]
        else:
            alone = (n[i] + n[i + d]) * (BELOW - ABOVE) // (ABOVE + BELOW)  # shingles that one of a pair just similar has alone
            i = i[np.where(n[i + d] > SMALL, by_words, np.bitwise_count(odd[i] ^ odd[i + d]).sum(axis=1, dtype=np.int32) <= alone)]
        if len(i):
            root: dict[int, int] = {}

            def find(p: int, root: dict[int, int] = root) -> int:
                while root.setdefault(p, p) != p:
                    root[p] = root[root[p]]
                    p = root[p]
                return p

            for a, b in zip(part[i].tolist(), part[i + d].tolist(), strict=True):
                root[find(a)] = find(b)
            of = np.arange(len(block))
            of[list(root)] = [find(p) for p in list(root)]
            part = of[part]
        d += 1
    return part


def _have_near(block: np.ndarray, n: np.ndarray, words: np.ndarray, odd: np.ndarray | None = None) -> np.ndarray:
    """Which rows, in order of (block, n), have another one of their block that may be near."""
    part = _near_parts(block, n, words, odd)
    return np.bincount(part)[part] > 1


def _named_parts(block: np.ndarray, key: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, keys) of the rows whose part has several: a part is named by a hash of its keys, so that equal parts of other blocks have one name.

    Parts of over COMPARED sets are named by their block, too, as these are told apart by their sets' other parts. Parts that
    have one name by chance are compared as one, which loses nothing.
    """
    at = np.flatnonzero(np.bincount(part, minlength=1)[part] > 1)
    at = at[np.argsort(part[at], kind="stable")]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, begins = key[at], np.flatnonzero(np.diff(part[at], prepend=-1))
    sizes = np.diff(begins, append=len(at))
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    names = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), begins)
    names ^= np.where(sizes > COMPARED, block[at[begins]] + 1, 0).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return np.repeat(names, sizes).view(np.int64), keys


def _met(listed: DataFrame) -> DataFrame:
    """(block, key): the parts of blocks, by name, of sets that may be near, and their sets; a group of blocks goes to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compared(last: bool) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            group = _group(rows["block"].to_numpy())
            ends = len(group) if last else int(np.searchsorted(group == group[-1], True))  # the last group may go on
            if ends < len(group):
                held.extend(rows.slice(ends).combine_chunks().to_batches())
            rows = rows.slice(0, ends)
            at, block = _ungrouped(rows["block"].to_numpy())
            n = rows["n"].to_numpy()[at].astype(np.int64)
            order = np.lexsort((n, block))
            at, block, n = at[order], block[order], n[order]
            words, odd = (np.stack([rows[f"{c}{i}"].to_numpy().view(np.uint64)[at] for i in range(k)], axis=1) for c, k in (("f", CARRIED), ("o", ODD)))
            part = _near_parts(block, n, words, odd)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _named_parts(block, rows["key"].to_numpy()[at], part)], names=["block", "key"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS and _group(held[0].column(0)[0].as_py()) != _group(batch.column(0)[-1].as_py()):
                yield compared(False)
                size = sum(x.num_rows for x in held)
        if held:
            yield compared(True)

    group = F.shiftright("block", LOW).bitwiseAND((1 << BITS + BLOCK_BITS - LOW) - 1)
    return listed.repartition(group).sortWithinPartitions(group).mapInArrow(run, "block long, key long").distinct()


def _may_be_near(a: Column, b: Column) -> Column:
    """Whether rows with (n, fp) can be similar enough, by sizes and by Hamming distance."""
    differ = sum((F.bit_count(a["fp"][i].bitwiseXOR(b["fp"][i])) for i in range(WORDS)), F.lit(0))
    most = F.when(F.least(a["n"], b["n"]) <= MEDIUM, MEDIUM_DISTANCE).otherwise(DISTANCE)
    return (F.least(a["n"], b["n"]) * BELOW >= F.greatest(a["n"], b["n"]) * ABOVE) & (differ <= most)


def _verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar enough; packed: (key, z) with compressed texts."""
    sides = pairs.distinct()
    for side in ("a", "b"):
        sides = sides.join(packed.select(F.col("key").alias(side), F.col("z").alias(f"z{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sets: dict[int, np.ndarray] = {}
        size = 0

        def remembered(key: int, z: bytes) -> np.ndarray:
            nonlocal size
            if key not in sets:
                if size > REMEMBERED:
                    sets.clear()
                    size = 0
                sets[key] = shingle_set(unpack(z))
                size += sets[key].nbytes + 200
            return sets[key]

        for batch in batches:
            for part in slices(batch):
                a, b, za, zb = (part.column(i).to_pylist() for i in range(4))
                stay = []
                for k in range(len(a)):
                    x, y = remembered(a[k], za[k]), remembered(b[k], zb[k])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if (ABOVE + BELOW) * both >= ABOVE * (len(x) + len(y)):
                        stay.append(k)
                at = pa.array(stay, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["a", "b"])

    return sides.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _packed_texts(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, z, sketch): one compressed text, and the sketch of its set, for each of the (key, rep) rows; docs: (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> list:
        pack = zstandard.ZstdCompressor(level=1).compress
        raw = utf8(batch.column(batch.schema.names.index("text")))
        sets = [shingle_set(x) for x in raw]
        return [[set_key(x) for x in sets], [pack(x) for x in raw], pa.array([sketch(x).view(np.int32) for x in sets], pa.list_(pa.int32()))]

    texts, _ = marked(docs, "doc_id", keys, "rep")  # so that the other texts aren't shuffled; what is marked by chance goes by its key
    made = append_columns(texts, [T.StructField("key", T.LongType()), T.StructField("z", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.IntegerType()))], run, [])
    return staged(made.join(keys.select("key"), "key", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in ("z", "sketch")]), "near-texts")


def _pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): the rows of blocks that aren't all one part, with the first of their block in each of PIVOTS[turn] orders, if of another part."""
    orders = [F.col("key") if turn == 0 else F.xxhash64("key", F.lit(turn), F.lit(i)) for i in range(PIVOTS[turn])]
    first = [F.min_by(F.struct("key", "n", "fp", "part"), x) for x in orders]
    mixed = rows.groupBy("block").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.array_distinct(F.array(*first)).alias("first")).where("p <> q")
    first = staged(mixed.select("block", F.explode("first").alias("first")), "near-first")  # its size decides the join, which can then split a hot block
    pairs = rows.join(first, "block").where((F.col("part") != F.col("first.part")) & _may_be_near(F.struct("n", "fp"), F.col("first")))
    return pairs.select(F.least("key", "first.key").alias("a"), F.greatest("key", "first.key").alias("b"))


def _all_pairs(rows: DataFrame, packed: DataFrame, first: bool) -> DataFrame:
    """(a, b): pairs of sets of a block that differ in part and may be similar; a block goes to one task, with its sets' sketches."""
    whole = rows.select("block", "key", "n", "fp", "part").join(packed.select("key", "sketch"), "key")
    size = rows.count()
    dealt = whole.repartition(max(1, size // 20_000), "block").sortWithinPartitions("block", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def compared() -> pa.RecordBatch:
            keys, sizes, fps, parts, sketches = zip(*held, strict=True)
            pairs = list(_near_in_block(np.array(keys), np.array(sizes, np.int64), np.array(fps, np.int64).view(np.uint64), list(parts), list(sketches), first))
            at = [(min(keys[i], keys[j]), max(keys[i], keys[j])) for i, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in at], pa.int64()) for k in (0, 1)], names=["a", "b"])

        block = None
        for batch in batches:
            get = lambda c, batch=batch: batch.column(batch.schema.names.index(c))
            ends = np.cumsum(get("sketch").value_lengths().to_numpy())
            sketches = np.split(get("sketch").flatten().to_numpy().view(np.uint32), ends[:-1])
            for b, key, n, fp, part, values in zip(get("block").to_pylist(), get("key").to_pylist(), get("n").to_pylist(), get("fp").to_pylist(), get("part").to_pylist(), sketches, strict=True):
                if b != block and held:
                    yield compared()
                    held.clear()
                block = b
                held.append((key, n, fp, part, values))
        if held:
            yield compared()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _rest_pairs(rows: DataFrame, words: DataFrame, packed: DataFrame, first: bool, deep: int = 2) -> DataFrame:
    """(a, b): pairs of the sets of blocks that hold several parts; words: (key, other), the blocks of each set.

    A block of over COMPARED sets is split: similar sets of a block share others as well, so that its sets are compared
    within the blocks of pairs of blocks, then of three, and then by a join. What shares no other block is left to _left_pairs.
    """
    mixed = rows.groupBy("block").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("m")).where("p <> q").select("block", "m")
    here = staged(rows.join(mixed, "block"), "near-mixed")
    large = here.where(F.col("m") > COMPARED)
    small = _all_pairs(here.where(F.col("m") <= COMPARED), packed, first)
    if large.isEmpty():
        return small
    if deep == 0:
        a, b = (large.select("block", F.struct("key", "n", "fp", "part").alias(x)) for x in "ab")
        near = (F.col("a.key") < F.col("b.key")) & (F.col("a.part") != F.col("b.part")) & _may_be_near(F.col("a"), F.col("b"))
        return small.unionByName(a.join(b, "block").where(near).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")))
    split = large.drop("m").join(words, "key").where("block <> other").withColumn("block", F.xxhash64("block", "other")).drop("other")
    return small.unionByName(_rest_pairs(split, words, packed, first, deep - 1))


def _left_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): all pairs of blocks of over COMPARED sets that are of different parts after all, if near by Hamming distance."""
    large = rows.groupBy("block").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("m")).where("p <> q").where(F.col("m") > COMPARED)
    here = staged(rows.join(large.select("block"), "block"), "near-left")
    a, b = (here.select("block", F.struct("key", "n", "fp", "part").alias(x)) for x in "ab")
    near = (F.col("a.key") < F.col("b.key")) & (F.col("a.part") != F.col("b.part")) & _may_be_near(F.col("a"), F.col("b"))
    return a.join(b, "block").where(near).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


def near_groups(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """Components (node, component) of links between sets of at least 0.8 similarity; groups: (key, rep, n, fp, turns, odd) of distinct sets.

    Sets that share a block of their fingerprints, and are near by Hamming distance, are candidates; what follows goes by the parts of
    blocks that candidates connect. The sets of a part of over COMPARED are in some rounds compared with a few of them, other ones
    each round, if links don't join them already: that makes one part of a group of copies without all its pairs. Then
    the sets of a part are compared in one task by their sketches, which gives the least pairs that connect them; where larger
    sets are among them, all pairs that are not linked after that follow. Large parts are split, and end with a
    join. Pairs are checked by size and Hamming distance of fingerprints, and then by their texts.
    """
    rows = staged(_met(_listed(groups)).join(groups.select("key", "rep", "n", "fp"), "key"), "near-blocks")
    packed = _packed_texts(rows.select("key", "rep").distinct(), docs)
    sizes = staged(rows.groupBy("block").agg(F.count("*").alias("m"), F.max("n").alias("most")), "near-sizes")
    large, estimated = sizes.where(F.col("m") > COMPARED).select("block"), sizes.where(F.col("most") >= SKETCH).select("block")
    words = rows.select("key", F.col("block").alias("other"))
    turns = [lambda of: _rest_pairs(of, words, packed, True), lambda of: _rest_pairs(of.join(estimated, "block", "left_semi"), words, packed, False)]
    if not large.isEmpty():
        turns = [*[lambda of, t=t: _pairs(of.join(large, "block", "left_semi"), t) for t in range(len(PIVOTS))], *turns, lambda of: _left_pairs(of.join(large, "block", "left_semi"))]
    unsettled, links, parts, joined = rows.select("block", "key", "n", "fp", F.col("key").alias("part")), None, None, False
    for pairs_of in turns:
        if joined:
            unsettled = _unsettled(unsettled, parts)
            if unsettled.isEmpty():
                break
        found = staged(_verified(pairs_of(unsettled), packed), "near-links")
        joined = not found.isEmpty()
        if links is not None and not joined:
            continue
        links = found if links is None else links.unionByName(found)
        parts = staged(connected_components(links), "near-parts")
    return parts


def _unsettled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows, with their new parts, of the blocks that still hold several: parts only grow, so that blocks of one part are done with."""
    named = rows.drop("part").join(parts, F.col("key") == F.col("node"), "left").select("block", "key", "n", "fp", F.coalesce("component", "key").alias("part"))
    named = staged(named, "near-parted")
    mixed = named.groupBy("block").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("block")
    return staged(named.join(mixed, "block", "left_semi"), "near-unsettled")


def keep_least(docs: DataFrame, keyed: DataFrame, named: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows of docs whose id is the least of its group, and the rows without an id; keyed: (doc_id, key), named: (key, least).

    The ids that go are few beside those that stay, so that they are what is joined. Of repeated rows of an id the
    shortest stays, of equally short ones the first by text.
    """
    of = keyed.where("doc_id is not null").join(named, "key")
    ids = staged(of.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("least")).alias("stays"), F.count("*").alias("n")).where("not coalesce(stays, false) or n > 1"), "near-ids")
    some, others = marked(docs.where(F.col(doc_id).isNotNull()), doc_id, ids, "doc_id")  # the texts of the others aren't shuffled
    repeated = some.join(ids.where("stays").select(F.col("doc_id").alias(doc_id)), doc_id, "left_semi")
    (rank,) = unused(docs, "rank")
    ranked = repeated.withColumn(rank, F.row_number().over(W.partitionBy(doc_id).orderBy(F.length(text), text))).where(F.col(rank) == 1).drop(rank)
    one = some.join(ids.select(F.col("doc_id").alias(doc_id)), doc_id, "left_anti")
    return others.unionByName(one.select(docs.columns)).unionByName(ranked.select(docs.columns)), docs.where(F.col(doc_id).isNull())


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each near-duplicate group kept, that with the smallest id, all columns as they were.

    Groups are the components of links between texts whose sets of five-word shingles (A-Z in lower case, white space
    as one space) have a Jaccard similarity of 0.8 or more and SimHash blocks in common, which pairs just at 0.8 have in over 99 of
    100 cases whatever their length, and closer ones nearly always. Equal sets always are one group, null and empty texts among them. Of repeated rows of an
    id one stays. Rows without an id stay only if their whole group has none. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = staged(with_fingerprints(rows, "text", ["doc_id"]), "near-sets")
    groups = staged(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "fp", "turns", "odd")]), "near-groups")
    parts = near_groups(groups, rows).select(F.col("node").alias("key"), "component")
    named = groups.select("key", "rep").join(parts, "key", "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = staged(named.join(least, "component").select("key", "least"), "near-named")
    one, blank = keep_least(docs, keyed.select("doc_id", "key"), named, doc_id, text)
    return one.unionByName(_without_id(blank, text, named.where("least is null").select("key")))


def _without_id(blank: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """The rows whose set is one of keys."""

    def run(batch: pa.RecordBatch) -> list:
        return [[set_key(shingle_set(x)) for x in utf8(batch.column(batch.schema.names.index(text)))]]

    (key,) = unused(blank, "key")
    keyed = append_columns(blank, [T.StructField(key, T.LongType())], run, blank.columns)
    return keyed.join(keys.select(F.col("key").alias(key)), key, "left_semi").select(blank.columns)
