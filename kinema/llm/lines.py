"""Line dedup: lines are parsed into a template tree of fixed depth; templates that recur across documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused

#: Leading tokens that, with the token count, make a leaf of the tree.
DEPTH = 3
#: A leaf is split once more by the tokens that over this share of its distinct lines have at their position.
SPLIT = 0.2
#: A position is constant if over this share of the distinct lines of a split leaf agree there.
CONSTANT = 0.6
#: A split leaf has a template if over this share of its positions after the leading tokens are constant.
ALIKE = 0.6
#: A template is boilerplate from this many documents on.
LEAST_DOCS = 3
#: Copies of a document count little: a template's documents, by their kinds, must be as many as this many equal kinds make.
LEAST_KINDS = 2.0


def parsed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, text_hash, line, constant, lead, g, n, h1, h2, s): a line's number from 0, first tokens, leaf, tokens, hash of 128 bits, masked text.

    Tokens that hold a digit are variable fields and read <*>. Lines without any other token aren't constant and have
    no template.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "raw"))
    masked = F.when(F.col("raw").rlike(r"\d"), F.regexp_replace("raw", r"(?<!\S)[^\s\d]*+\d\S*+", "<*>")).otherwise(F.col("raw"))
    rows = rows.withColumn("t", F.array_remove(F.split(masked, r"\s+"), ""))
    rows = rows.select("doc", "text_hash", "line", "t", F.array_join("t", " ").alias("s"), F.size("t").alias("n"))
    lead = [F.get("t", F.lit(i)) for i in range(DEPTH)]
    constant = F.size(F.array_remove("t", "<*>")) > 0
    # lines are written with this mark and filtered as they are read: a filter here would be pushed down and split every line twice
    return rows.select("doc", "text_hash", "line", constant.alias("constant"), F.unhex(F.md5(F.concat_ws(" ", *lead))).alias("lead"), F.xxhash64("n", *lead).alias("g"), "n", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), "s")


def _common_tokens(lines: DataFrame, leaf: str, share: float, least: int) -> DataFrame:
    """(leaf, n, common): the (position, token) pairs after the leading tokens that over a share of a leaf's lines, `least` or more, have."""
    cells = lines.select(leaf, "n_lines", "n", F.posexplode(F.split("s", " ")).alias("at", "token")).where(F.col("at") >= DEPTH)
    votes = cells.groupBy(leaf, "at", "token").agg(F.count("*").alias("votes"), F.first("n_lines").alias("n_lines"), F.first("n").alias("n"))
    common = votes.where((F.col("votes") > F.col("n_lines") * share) & (F.col("votes") >= least))
    return common.groupBy(leaf).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "token"))).alias("common"))


def _held(tokens: Column) -> Column:
    return F.filter("common", lambda c: F.get(tokens, c["at"]) == c["token"])


def leaf_templates(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, template) of the lines that agree with a template of their leaf.

    A leaf's distinct lines are first split by the tokens that a good share of them have at their positions, so that
    templates of one count and the same leading tokens part. In each part, a position is constant if most lines agree
    there; a part with enough constant positions has a template, and its lines that hold all of them belong to it.
    Lines of DEPTH tokens or fewer have no variable position and recur as they are.
    """
    wide = lines.where(F.col("n") > DEPTH)
    sizes = wide.select("g", "h1", "h2").distinct().groupBy("g").agg(F.count("*").alias("n_lines")).where(F.col("n_lines") >= least_docs)
    sizes = staged(sizes, "leaf-sizes")  # staged sizes and shares decide how they are joined, and a hot leaf can be split over tasks
    distinct = staged(wide.join(sizes, "g").select("g", "n_lines", "n", "s").distinct(), "leaf-lines")
    common = staged(_common_tokens(distinct, "g", SPLIT, least_docs).drop("n"), "leaf-tokens")
    parted = distinct.drop("n_lines").join(common, "g").withColumn("part", F.xxhash64("g", _held(F.split("s", " ")))).drop("common")
    parted = staged(parted, "leaf-parts")
    sizes = staged(parted.groupBy("part").agg(F.count("*").alias("n_lines")).where(F.col("n_lines") >= least_docs), "part-sizes")
    leaves = _common_tokens(parted.join(sizes, "part"), "part", CONSTANT, least_docs)
    leaves = staged(leaves.where(F.size("common") > (F.col("n") - DEPTH) * ALIKE).drop("n"), "part-templates")
    agrees = parted.join(leaves, "part").where(F.size(_held(F.split("s", " "))) == F.size("common"))
    return agrees.select(F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), F.col("part").alias("template"))


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, least_kinds: float = LEAST_KINDS, keep_first: bool = True) -> DataFrame:
    """(doc, text_hash, drop): for every text that has recurring lines, the numbers of these lines.

    A template recurs if it occurs in at least least_docs documents (rows of one id count as one) of enough kinds. The
    kind of a document is the least hash of its lines' first tokens, which most near copies of a document share and
    others don't: n documents, n_k of each kind, count as n * n / sum(n_k * n_k) kinds (the sum is a mean over four such
    hashes). So lines that recur only because their whole document has copies stay for near-dedup. With keep_first a template's first occurrence (smallest id,
    nulls last, then line) is left, so that no passage is lost altogether.
    """
    lines = staged(parsed_lines(docs, doc_id, text), "lines", "zstd").where("constant")
    of = staged(leaf_templates(lines, least_docs), "line-leaves")
    template = F.struct(F.col("template").isNotNull().alias("leaf"), F.coalesce("template", "h1").alias("a"), F.when(F.col("template").isNull(), F.col("h2")).otherwise(0).alias("b"))
    named = lines.select("doc", "text_hash", "line", "h1", "h2").join(of, ["h1", "h2"], "left").select("doc", "text_hash", "line", template.alias("template"))
    named = staged(named, "line-templates")
    ends = [f(F.substring("lead", at, 8)) for f in (F.min, F.max) for at in (1, 9)]  # two hashes, least and greatest
    kinds = lines.groupBy("doc").agg(F.array(*ends).alias("kinds"))
    once = named.groupBy("template", "doc").agg(F.min(F.struct("text_hash", "line")).alias("at"))
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "at")
    often = once.groupBy("template").agg(F.count("*").alias("n_docs"), F.min(place).alias("first")).where(F.col("n_docs") >= least_docs)
    often = staged(often.select("template", "first"), "line-often")
    of_doc = kinds.select(F.col("doc").alias("of"), "kinds")
    counted = once.join(often.select("template"), "template").join(of_doc, F.col("doc").eqNullSafe(F.col("of"))).select("template", F.posexplode("kinds").alias("end", "kind"))
    counted = counted.groupBy("template", "end", "kind").agg(F.count("*").cast("double").alias("n"))
    many = counted.groupBy("template").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n")) / len(ends)).alias("kinds")).where(F.col("kinds") >= least_kinds)
    many = staged(often.join(many, "template").select("template", "first"), "line-recurring")  # joined anew: a hot template's lines can then be split over tasks
    first = F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.at") == F.struct("text_hash", "line"))
    met = named.join(many, "template")
    return (met.where(~first) if keep_first else met).groupBy("doc", "text_hash").agg(F.collect_set("line").alias("drop"))


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, least_kinds: float = LEAST_KINDS, keep_first: bool = True) -> DataFrame:
    """The documents with their recurring lines taken out of `text`, and n_lines and n_dropped.

    The lines that stay keep their order and are joined by newlines; a document may end up empty, it is not removed.
    Lines of every length are parsed whole. A null text stays null, with no lines; empty lines and lines of variable
    fields alone stay. Rows of one id lose each the lines of their own text. Other columns stay as they are, but for
    n_lines and n_dropped; an empty table gives an empty result.
    """
    doc, hashed, drop = unused(docs, "doc", "text_hash", "drop")
    drops = recurring_lines(docs, doc_id, text, least_docs, least_kinds, keep_first).select(F.col("doc").alias(doc), F.col("text_hash").alias(hashed), F.col("drop").alias(drop))
    joined = docs.join(drops, docs[doc_id].eqNullSafe(F.col(doc)) & (F.xxhash64(docs[text]) == F.col(hashed)), "left")
    lines = F.split(F.col(text), "\n")
    at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    stay = F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")
    columns = [F.when(F.col(drop).isNull(), F.col(text)).otherwise(stay).alias(text) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    counts = [F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped")]
    return joined.select(*columns, *counts)
