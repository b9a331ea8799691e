"""Licence scans: sparse TF-IDF cosine of files, headers and lines to templates, and inheritance from directories."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, unused
from .licence_texts import OPENINGS, TEMPLATES

#: Least cosine of a text to its template.
LEAST_COSINE = 0.7
#: What lies between words: dots and hyphens stay inside a word and go at its end.
BETWEEN = r"[.\-]*[^\p{L}\p{Nd}.\-]+|[.\-]+\z"
#: A file's header ends at its first blank line.
BLANK = r"\n[\x20\x09-\x0D]*\n"
#: What is compared, in the order of what it says about its file.
FILE, OPENING, HEADER, LINE = range(4)
#: Words of a file's opening, and of a file that has one. Tokens of openings bear a mark, and so meet those of openings alone.
OPENING_WORDS, LEAST_FILE_WORDS, OPENS = 60, 200, "^"
#: Words that any English text has; they count among a template's rare tokens only where it has too few others.
COMMON = frozenset(
    "a an and any are as at be been but by can do for from had has have he her his i if in is it its may more no not of on one or our she so some than "
    "that the their them then there these they this to was we were what when which who will with would you your".split()
)
EVERYWHERE = [*sorted(COMMON), *(OPENS + w for w in sorted(COMMON))]
#: A weak notice, which says less than any other.
WEAK = "Proprietary"


def tokens(text: Column) -> Column:
    """Lower-case words."""
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def words_of(text: str) -> list[str]:
    """tokens() of a template, which is ASCII."""
    return [w for x in re.findall(r"[a-z0-9.\-]+", text.lower()) if (w := x.rstrip(".-"))]


def template_weights(templates: list[tuple[str, str]], openings: list[tuple[str, str]] = []) -> list[tuple[int, str, str, float, float, bool]]:  # noqa: B006
    """(template, licence, token, weight, idf, rare): unit TF-IDF vectors, and the rare tokens that a near text can't do without.

    Weights are (1 + ln tf) * idf, idf taken over the templates. The tokens that aren't rare hold a share of the unit
    vector whose length is under LEAST_COSINE, so a text without any rare token of a template is farther from it.
    """
    counts = [Counter(words_of(text)) for _, text in templates] + [Counter(OPENS + w for w in words_of(text)[:OPENING_WORDS]) for _, text in openings]
    templates = [*templates, *openings]
    held = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in held.items()}
    out = []
    for i, ((licence, _), c) in enumerate(zip(templates, counts, strict=True)):
        weight = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        rest, rare = 1.0, set()
        for t in sorted(weight, key=lambda t: (t.removeprefix(OPENS) in COMMON, -idf[t], t)):
            if rest < LEAST_COSINE**2 * 0.999:
                break
            rare.add(t)
            rest -= (weight[t] / norm) ** 2
        out += [(i, licence, t, w / norm, idf[t], t in rare) for t, w in sorted(weight.items())]
    return out


def _vectors(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return staged(spark.createDataFrame(rows, "template int, licence string, token string, weight double, idf double, rare boolean"), "licence-vectors")


def near_licences(units: DataFrame, vectors: DataFrame, n_templates: int) -> DataFrame:
    """(u, licence, cosine): the best template of each distinct unit (u, tokens, n_tokens, n_unknown), if near enough; ties by identifier.

    Units are first held against the templates' tokens that aren't common words: the cosine is at most the length of
    what a unit shares of the template's vector, all common words counted as shared, times the share of the unit's own
    vector that this can be at most beside its words that no template has. Words that no template has weigh as much as a word of
    one template does, so that prose is far from all.
    """
    telling = vectors.where(~F.col("token").isin(*EVERYWHERE))
    squares = lambda c: F.sum(F.when(F.col("token").isin(*EVERYWHERE), F.col(c) * F.col(c)).otherwise(0.0))
    rest = vectors.groupBy("template").agg(squares("weight").alias("rest"), squares("idf").alias("rest_idf"))
    unknown = math.log((1 + n_templates) / 2) + 1
    some = units.select("u", "n_tokens", "n_unknown", F.explode(F.array_distinct("tokens")).alias("token")).join(telling.select("token", "template", "weight", "idf"), "token")
    sums = [F.sum(F.col(c) * F.col(c)).alias(n) for c, n in (("weight", "shared"), ("idf", "own"))]
    bound = some.groupBy("u", "template", "n_tokens", "n_unknown").agg(*sums).join(F.broadcast(rest), "template")
    most = (F.col("own") + F.col("rest_idf")) * (1 + F.log("n_tokens")) * (1 + F.log("n_tokens"))
    may = bound.where((F.col("shared") + F.col("rest")) * most >= (LEAST_COSINE**2 - 1e-9) * (most + F.col("n_unknown") * unknown**2))
    may = staged(may.select("u", "template"), "licence-candidates")
    chosen = units.join(may.select("u").distinct(), "u", "left_semi")
    counted = chosen.select("u", F.explode("tokens").alias("token")).groupBy("u", "token").agg(F.count("*").alias("tf"))
    idf = vectors.groupBy("token").agg(F.first("idf").alias("idf"))
    weighted = staged(counted.join(idf, "token", "left").select("u", "token", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(unknown))).alias("w")), "licence-units")
    norms = weighted.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(vectors.select("token", "template", "licence", "weight"), "token").groupBy("u", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    near = dots.join(norms, "u").select("u", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= LEAST_COSINE)
    best = near.groupBy("u").agg(F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), "licence")).alias("x"))
    return best.select("u", "x.*")


#: (1 + ln n) squared is at most this many times n.
MOST_WEIGHT = 4 / math.e


def may_be_near(tokens: Column, n_unknown: Column, weights: list[tuple], n_templates: int) -> Column:
    """Whether a unit's own words leave room for a cosine of LEAST_COSINE, by how many no template has; it may be true where it needn't.

    The square of the cosine is at most the share of words that templates have in the unit's squared length. Words of
    a small idf are counted with the largest of these, others as if one template had them.
    """
    idf = {t: w for _, _, t, _, w, _ in weights}
    unknown = math.log((1 + n_templates) / 2) + 1
    small = sorted(t for t, w in idf.items() if w < unknown / 2)
    count = lambda names: F.size(F.filter(tokens, lambda t: t.isin(*names)))
    low = count(small) if small else F.lit(0)
    known = MOST_WEIGHT * (low * max((idf[t] ** 2 for t in small), default=0.0) + (count(sorted(idf)) - low) * unknown**2)
    return known >= (LEAST_COSINE - 1e-5) ** 2 * (known + n_unknown * unknown**2)


def directory(path: Column) -> Column:
    """All but the last segment, '' at the top."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"\A(.*)/[^/]*\z", 1)


def ancestors(path: Column) -> Column:
    """The path's directories, the nearest first, the top ('') last."""
    parts = F.split(directory(path), "/")
    return F.when(directory(path) == "", F.array(F.lit(""))).otherwise(
        F.concat(F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.array(F.lit("")))
    )


def scan_licences(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per file: the columns in `keep`, path, licence, cosine, n_notices, is_licence_file, inherited_from.

    The whole file, its header (up to the first blank line) and every line are compared with the templates, and the first
    OPENING_WORDS words of a file of LEAST_FILE_WORDS or more with the openings of the long licences. A file whose whole
    text or opening is near one is a licence file. A file's licence is that of its whole text, else of its opening, else of its header, else of
    the nearest of its lines, of which n_notices are near a template; "all rights reserved" counts after any licence;
    ties go to the larger cosine, then to the smaller identifier. A licence file speaks for its directory and those
    below: a file without a licence takes that of its nearest ancestor directory with a licence file (several there: by
    the same order), named in inherited_from; its cosine is that of the licence file. Without either, licence is null.
    A null text has no notices; a null path is a file at the top; repeated rows stay; texts of any length are read
    whole; an empty table gives an empty result.
    """
    openings = OPENINGS if templates is None else []
    templates = TEMPLATES if templates is None else templates
    spark = files.sparkSession
    weights = template_weights(templates, openings)
    vectors = _vectors(spark, weights)
    marked = {t for _, _, t, _, _, is_rare in weights if is_rare}
    rare, anywhere = F.lit(sorted(marked)), F.lit(sorted({t.removeprefix(OPENS) for t in marked}))
    words = F.lit(sorted({t for _, _, t, _, _, _ in weights}))
    at, body, row = unused(files, "path", "text", "row")
    rows = files.select(*keep, F.col(path).alias(at), F.coalesce(F.col(text), F.lit("")).alias(body))
    # only texts that hold a rare token are read further
    rows = rows.withColumn(body, F.when(F.arrays_overlap(tokens(F.col(body)), anywhere), F.col(body)))
    rows = staged(rows.withColumn(row, F.monotonically_increasing_id()), "licence-files", "zstd")
    some = rows.where(F.col(body).isNotNull()).select(row, F.col(body).alias("text"))
    whole = some.select(row, F.lit(FILE).alias("kind"), "text").unionByName(some.where(F.col("text").rlike(BLANK)).select(row, F.lit(HEADER).alias("kind"), F.split("text", BLANK, 2)[0].alias("text")))
    parts = whole.unionByName(some.select(row, F.lit(LINE).alias("kind"), F.explode(F.split("text", "\n")).alias("text"))).withColumn("tokens", tokens(F.col("text")))
    first = some.select(row, F.lit(OPENING).alias("kind"), "text", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= LEAST_FILE_WORDS)
    parts = parts.unionByName(first.withColumn("tokens", F.transform(F.slice("tokens", 1, OPENING_WORDS), lambda w: F.concat(F.lit(OPENS), w))))
    parts = parts.withColumn("n_unknown", F.size(F.array_except("tokens", words)))
    some = F.arrays_overlap("tokens", rare) & may_be_near(F.col("tokens"), F.col("n_unknown"), weights, len(templates) + len(openings))
    # marked here and filtered as they are read: a filter here would be pushed down and split every text twice
    parts = parts.select(row, "kind", F.when(some, F.md5(F.array_join("tokens", " "))).alias("u"), F.when(some, F.col("tokens")).alias("tokens"), "n_unknown")
    parts = staged(parts, "licence-parts", "zstd").where("u is not null")
    units = staged(parts.groupBy("u").agg(F.first("tokens").alias("tokens"), F.first("n_unknown").alias("n_unknown")).withColumn("n_tokens", F.size("tokens")), "licence-texts", "zstd")
    found = staged(near_licences(units, vectors, len(templates) + len(openings)), "licence-found")
    met = parts.select(row, "kind", "u").join(found, "u").withColumn("weak", F.col("licence") == WEAK)
    order = F.struct("weak", "kind", -F.col("cosine"), "licence")
    own = met.groupBy(row).agg(
        F.min_by(F.struct("licence", "cosine"), order).alias("own"), F.min(order).alias("order"),
        F.sum((F.col("kind") == LINE).cast("long")).alias("n_notices"), F.max(F.col("kind") <= OPENING).alias("is_licence_file"),
    )
    rows = staged(rows.drop(body).join(own, row, "left"), "licence-own")
    speaks = rows.where("is_licence_file").groupBy(directory(F.col(at)).alias("dir")).agg(F.min_by("own", "order").alias("theirs"))
    speaks = staged(speaks, "licence-directories")
    # inheritance is found once for each directory, not for each of its files
    dirs = rows.where("own is null").select(directory(F.col(at)).alias("of")).distinct()
    up = dirs.select("of", F.posexplode(ancestors(F.concat("of", F.when(F.col("of") == "", "x").otherwise("/x")))).alias("up", "dir"))
    heir = up.join(speaks, "dir").groupBy("of").agg(F.min_by(F.struct("dir", "theirs"), "up").alias("heir"))
    heir = staged(heir, "licence-heirs")  # its size decides the join, which can then split a hot directory
    out = rows.join(heir, F.when(F.col("own").isNull(), directory(F.col(at))) == F.col("of"), "left")
    return out.select(
        *keep, F.col(at).alias("path"), F.coalesce("own.licence", "heir.theirs.licence").alias("licence"), F.coalesce("own.cosine", "heir.theirs.cosine").alias("cosine"),
        F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("is_licence_file", F.lit(False)).alias("is_licence_file"), F.when(F.col("own").isNull(), F.col("heir.dir")).alias("inherited_from"),
    )
