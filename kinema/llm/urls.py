"""URL filters: given host and path rules, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Mined rules: the least share of labelled URLs that hold a combination, the least share of these that are blocked,
#: and how much likelier that is than for any URL.
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.8, 1.2
#: Labelled URLs that hold a combination at least, whatever their share.
LEAST_ROWS = 8
#: Labelled URLs that FP-growth is fitted on at most, drawn by a hash of the URL.
FIT_ROWS = 200_000
#: One labelled URL in this many, by hash, is held out to test the rules, which must match this many of them at least.
HELD_OUT, LEAST_HELD = 5, 2
#: Item that stands for a blocked URL among the tokens.
BLOCKED = "=block"


@dataclass(frozen=True)
class Rule:
    """verdict for a host (and all its subdomains) and the paths that begin with path."""

    verdict: str
    text: str  # host and path, such as net/de/

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


#: The rules of the query.
RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to /, ? or #, with A-Z in lower case, and then up to ? or #; else both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (text, verdict) of the longest rule that fits, null if none does; the first of equally long ones."""
    order = sorted(rules, key=lambda r: -len(r.text))
    found = None
    for r in order:
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<text:string,verdict:string>") if found is None else found


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the host's top label, the words of its other labels, the path's segments with digits masked."""
    top = F.concat(F.lit("t:"), F.substring_index(host, ".", -1))
    words = F.transform(F.filter(F.split(F.regexp_replace(host, r"[^.]*\z", ""), r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    parts = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i, F.lit(":"), F.regexp_replace(x, r"\d+", "0")))
    return F.array_distinct(F.filter(F.concat(F.array(top), words, parts), lambda x: x != "t:"))


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(rule, tokens, n, confidence): token combinations, (url, tokens array, blocked boolean) rows being the labelled URLs.

    FP-growth finds the combinations that occur together with a block; a combination stays if it is confident and
    likelier blocked than any URL by `lift`, if it keeps that lift on a fifth of the labelled URLs that was held out, and if
    no combination of fewer of its tokens is as confident. It is fitted on about fit_rows labelled URLs at most: all if there are fewer, else a share drawn by hash; of each on all tokens.
    Combinations double with every token over the support that URLs share.
    """
    held = F.pmod(F.xxhash64("url", F.lit("held")), F.lit(HELD_OUT)) == 0
    tested, labelled = labelled.where(held), labelled.where(~held)
    n = labelled.count()
    if n > fit_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("tokens", "url"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
    items = F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, LEAST_ROWS / max(1, n))), minConfidence=confidence).fit(labelled.where(F.size("tokens") > 0).select(items.alias("items")))
    found = model.associationRules.where((F.col("consequent") == F.array(F.lit(BLOCKED))) & (F.col("lift") >= lift))
    found = staged(found.select(F.array_sort("antecedent").alias("tokens"), "confidence").withColumn("n", F.size("tokens")), "url-rules")
    found = staged(found.join(holding(found, tested, lift), "tokens", "left_semi"), "url-rules-held")
    parts = found.select(F.explode("tokens").alias("token"), "tokens", "n", "confidence")
    wider = found.select(F.col("tokens").alias("few"), F.col("n").alias("k"), F.col("confidence").alias("as_good")).withColumn("token", F.explode("few"))
    covered = (
        parts.join(wider, "token")
        .where((F.col("k") < F.col("n")) & (F.col("as_good") >= F.col("confidence")))
        .groupBy("tokens", "few").agg(F.count("*").alias("shared"), F.max("k").alias("k"))
        .where("shared = k").select("tokens").distinct()
    )
    return found.join(covered, "tokens", "left_anti").withColumn("rule", F.array_join("tokens", " & ")).select("rule", "tokens", "n", "confidence")


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, rule): the rules (rule, tokens, n) all of whose tokens are in one of the token sets, by an inverted index of the rules."""
    index = rules.select("rule", "n", F.explode("tokens").alias("token"))
    some = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    return some.groupBy("tokens", "rule").agg(F.count("*").alias("shared"), F.first("n").alias("n")).where("shared = n").select("tokens", "rule")


def holding(rules: DataFrame, tested: DataFrame, lift: float) -> DataFrame:
    """(tokens): the rules (tokens, n) that block held-out URLs (tokens, blocked) likelier than any by `lift`, LEAST_HELD matches at least."""
    named = rules.withColumn("rule", F.to_json("tokens"))
    counts = tested.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count("*").alias("urls"), F.count_if("blocked").alias("bad"))
    any_url = counts.agg((F.sum("bad") / F.sum("urls")).alias("any_url"))
    met = matches(counts, named).join(counts, "tokens").groupBy("rule").agg(F.sum("urls").alias("urls"), F.sum("bad").alias("bad"))
    kept = met.crossJoin(any_url).where((F.col("urls") >= LEAST_HELD) & (F.col("bad") / F.col("urls") >= lift * F.col("any_url")) & (F.col("bad") > 0))  # one row
    return named.join(kept, "rule", "left_semi").select("tokens")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id") -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict, mined (the mined rule that blocks, else null).

    A url's verdict is its longest rule's. Other urls are blocked if all tokens of a mined rule occur in them, found by
    an inverted index of the rules' tokens, and allowed otherwise. Labelled urls are those with a rule, by its verdict,
    and those of pages whose id `labels` lists, blocked if of quality 0 or toxic; several labels of an id block if one
    does. Null urls and urls without :// have an empty host and path and match no rule, given or mined. Null ids and
    repeated rows stay as they are. Without labelled urls nothing is mined; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    bad = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("page_id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    known = rows.join(bad, "page_id", "left").select("url", "tokens", F.when(F.col("hit").isNotNull(), F.col("hit.verdict") == "block").otherwise(F.col("bad")).alias("blocked"))
    mined = mined_rules(staged(known.where("blocked is not null"), "url-labels"))
    mined = staged(mined, "url-mined")
    # each distinct set of tokens is looked up once, whatever the number of its urls
    found = matches(rows.where("hit is null and size(tokens) > 0"), mined).join(mined.select("rule", "confidence"), "rule")
    matched = found.groupBy("tokens").agg(F.max_by("rule", F.struct("confidence", "rule")).alias("mined"))
    matched = staged(matched, "url-matched")  # its size decides the join, so that a hot set of tokens isn't dealt to one task
    out = rows.withColumn("set", F.when(F.col("hit").isNull(), F.col("tokens"))).join(matched.withColumnRenamed("tokens", "set"), "set", "left")
    verdict = F.coalesce("hit.verdict", F.when(F.col("mined").isNotNull(), "block"), F.lit("allow"))
    return out.select("page_id", "url", "host", "path", F.col("hit.text").alias("rule"), verdict.alias("verdict"), "mined")
