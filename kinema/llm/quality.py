"""Quality rules: word and line rules, and divergence of character-class and common-word histograms from the language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused

#: White space that separates words.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages looked at; all other words are one class of their own.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "is", "it", "that", "for", "with",
    "de", "la", "le", "et", "les", "des", "que", "un", "en", "du",
    "el", "los", "y", "se", "por", "las", "una", "con", "no", "del",
    "der", "die", "und", "den", "das", "von", "zu", "mit", "im", "ein",
]

#: A document is measured against its language only from this many characters and words on.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: A document is dropped if its character classes are farther from its language's than the first Jensen-Shannon
#: distance (0 to 1), or farther than the second while its common words are farther than the third. Common words alone
#: don't decide, as texts in two languages are far from either.
FAR_CLASSES, ODD_CLASSES, ODD_WORDS = 0.30, 0.155, 0.26
#: More language labels than this are joined by a shuffle, fewer are broadcast (about 1 kB each).
BROADCAST_LANGS = 2_000


def _with(value: Column, body) -> Column:
    """body(value), with value computed once and not once for every use inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _only(text: Column, keep: str) -> Column:
    """Number of code points of text in the character class `keep`."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def n_repeat_words(words: Column) -> Column:
    """Words inside a window of five that occurs twice or more in the array, first occurrences included.

    Windows are compared by hash first; only texts in which a hash repeats compare the windows themselves.
    """

    def covered(at: Column) -> Column:  # at: sorted starts of repeated windows
        gaps = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda p, q: F.least(F.lit(5), q - p))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(5), lambda s, x: s + x))

    def repeated(order: Column) -> Column:  # order: (window, start), sorted
        n = F.size(order)
        pairs = F.zip_with(
            F.slice(order, F.lit(1), n - 1), F.slice(order, F.lit(2), n - 1),
            lambda p, q: F.when(p["g"] == q["g"], F.array(p["i"], q["i"])).otherwise(F.array().cast("array<int>")),
        )
        return F.array_sort(F.array_distinct(F.flatten(pairs)))

    starts = F.sequence(F.lit(1), F.size(words) - 4)
    exact = F.array_sort(F.transform(starts, lambda i: F.struct(F.slice(words, i, F.lit(5)).alias("g"), i.alias("i"))))
    slow = _with(_with(exact, repeated), covered)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(5))))
    some = _with(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 6, F.lit(0)).when(some, slow).otherwise(F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return _with(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def class_counts(text: Column) -> Column:
    """Counts of space, upper case, digits, symbols, other ASCII punctuation, the rest."""
    t = F.coalesce(text, F.lit(""))

    def rest(some: Column) -> Column:
        return F.concat(some, F.array(F.length(t) - F.aggregate(some, F.lit(0), lambda s, x: s + x)))

    some = F.array(_only(t, SPACE), _only(t, r"\p{Lu}"), _only(t, r"\p{Nd}"), _only(t, SYMBOLS), _only(t, r"!\"'()+,\-./:;=?@\[\\\]^_`{}~"))
    return _with(some, rest).cast("array<long>")


def word_counts(words: Column, common: list[str]) -> Column:
    """Counts of each common word, then of all other words."""
    kept = F.filter(words, lambda w: w.isin(common))

    def each(line: Column) -> Column:
        return F.array(*[F.floor((F.length(line) - F.length(F.replace(line, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)) for w in common])

    found = _with(F.concat(F.lit(" "), F.array_join(kept, "  "), F.lit(" ")), each)
    return F.concat(found, F.array((F.size(words) - F.size(kept)).cast("long"))).cast("array<long>")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null if either is all zero."""

    def entropy(share: Column) -> Column:
        return F.aggregate(share, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))

    def shares(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return _with(total, lambda t: F.when(t > 0, F.transform(counts, lambda x: x / t)))

    def distance(both: Column) -> Column:
        a, b = both["a"], both["b"]
        mean = F.zip_with(a, b, lambda x, y: (x + y) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), entropy(mean) - (entropy(a) + entropy(b)) / 2))

    both = F.struct(shares(p).alias("a"), shares(q).alias("b"))
    return _with(both, lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), distance(x)))


MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text: str, common: list[str], keep: list[str]) -> DataFrame:
    """The columns in keep with __m, the counts of the base rules, and the histograms __classes and __words."""
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            n_dup_lines(t).alias("n_dup_lines"),
            n_repeat_words(w).alias("n_repeat_words"),
            F.length(t).cast("long").alias("n_chars"),
            class_counts(t).alias("classes"),
            word_counts(w, common).alias("words"),
        )

    return docs.select(*keep, _with(words_of(t), counts).alias("__m"))


def language_histograms(rows: DataFrame, lang: str, n_common: int) -> DataFrame:
    """(__lang, __classes, __words): sums over all measured documents of each language label, null being one of its own."""
    sums = {"classes": 6, "words": n_common + 1}
    cells = [F.sum(F.col(f"__m.{c}")[i]).alias(f"{c}{i}") for c, n in sums.items() for i in range(n)]
    made = rows.groupBy(F.col(lang).alias("__lang")).agg(*cells)
    return made.select("__lang", *[F.array(*[f"{c}{i}" for i in range(n)]).alias(f"__{c}") for c, n in sums.items()])


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, common: list[str] = COMMON_WORDS) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    base_failed: under 10 words, or over a fifth of the words inside repeated five-word windows. Otherwise a document is
    dropped if its character classes, or these and its common words, lie too far from those of all documents of its
    language; texts under LEAST_CHARS characters or LEAST_WORDS words are not measured that way and stay. Distances are
    null where not measured. Null texts have no words and fail; a null language is a language of its own; repeated rows
    stay; the computed columns replace columns of the same name; an empty table gives an empty result.

    keep names the input columns that stay (all by default). Texts are measured once: the counts are written with the
    columns that stay, and both the languages' histograms and the verdicts come from that table without a shuffle of it;
    the histograms are one row for each language and broadcast while few.
    """
    drop = [*MADE, "base_failed", "class_distance", "word_distance", "kept"]
    stay = [c for c in (docs.columns if keep is None else keep) if c not in drop]
    apart = dict(zip(stay, unused(docs, *(f"kept_{i}" for i in range(len(stay)))), strict=True))  # no column clashes with those made here
    docs = docs.select(F.col(text).alias("__text_of"), F.col(lang).alias("__lang_of"), *[F.col(c).alias(n) for c, n in apart.items()])
    rows = staged(measured(docs, "__text_of", common, [*apart.values(), "__lang_of"]), "quality-counts")
    refs = staged(language_histograms(rows, "__lang_of", len(common)), "quality-languages")
    if refs.count() <= BROADCAST_LANGS:
        refs = F.broadcast(refs)
    m = F.col("__m")
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    long = ~failed & (m["n_chars"] >= LEAST_CHARS) & (m["n_words"] >= LEAST_WORDS)
    joined = rows.join(refs, F.col("__lang_of").eqNullSafe(F.col("__lang")), "left")
    distance = {c: F.when(long, F.round(js_distance(m[c], F.col(f"__{c}")), 6)) for c in ("classes", "words")}
    both = F.struct(distance["classes"].alias("c"), distance["words"].alias("w"))

    def verdict(d: Column) -> Column:
        c, w = F.coalesce(d["c"], F.lit(0.0)), F.coalesce(d["w"], F.lit(0.0))
        far = (c > FAR_CLASSES) | ((c > ODD_CLASSES) & (w > ODD_WORDS))
        return F.struct(d["c"].alias("class_distance"), d["w"].alias("word_distance"), (~failed & ~far).alias("kept"))

    judged = joined.withColumn("__v", _with(both, verdict))
    counts = {c: m[c] for c in MADE if c != "n_symbols"} | {"n_symbols": m["classes"][3]}
    return judged.select(*[F.col(n).alias(c) for c, n in apart.items()], *[counts[c].alias(c) for c in MADE], failed.alias("base_failed"), "__v.*")
