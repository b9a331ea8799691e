"""Column expressions for ids, splits, numbers, spans and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that are true or false in annotation tables.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "train")
FALSE_WORDS = ("0", "false", "f", "no", "n", "val", "test")


def path_stem(c: Column) -> Column:
    """PF1: the last path segment without its last suffix; a name that only starts with a dot keeps it."""
    name = F.regexp_extract(c, r"([^/\\]*)[/\\]*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def normalize_id(c: Column) -> Column:
    """PF1: path separators read __; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(c), r"[/\\]", "__"), F.lit(""))


def slugify(c: Column, most: int = 80, default: str = "sample") -> Column:
    """PF1: runs of other characters than letters, digits, ._- become _, outer ._- go, at most `most` characters."""
    made = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(F.substring(made, 1, most), F.lit("")), F.lit(default))


def stable_id(columns: Sequence[Column], length: int = 12) -> Column:
    """PF2: the first hex digits of the SHA-1 of the fields joined by |."""
    return F.left(F.sha1(F.concat_ws("|", *columns)), F.lit(length))


def normalize_split(c: Column, unknown: str = "") -> Column:
    """PF3: trimmed lower case, test and dev reading val; blank reads `unknown`."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("test", "dev"), "val").when(low == "", unknown).otherwise(low)


def parse_bool(c: Column, true_words: Sequence[str] = TRUE_WORDS, false_words: Sequence[str] = FALSE_WORDS) -> Column:
    """PF4: true, false or null."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*true_words), True).when(low.isin(*false_words), False)


def resolve_split(split: Column, train: Column) -> Column:
    """PF5: the split if not blank, else train or val by a boolean, else that text as a split; null if both are blank."""
    flag = parse_bool(train)
    return F.coalesce(F.nullif(normalize_split(split), F.lit("")), F.when(flag, "train").when(~flag, "val"), F.nullif(normalize_split(train), F.lit("")))


def parse_int(c: Column) -> Column:
    """PF6: an integer by way of a float, cut towards zero; null if blank or bad."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number).try_cast("int")


def resolve_identity(candidates: Sequence[Column], fallback: Column) -> Column:
    """PF7: the first candidate that isn't blank, else the stem of the fallback."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates], path_stem(fallback))


def interval_to_half_open(start: Column, end: Column, mode: str) -> tuple[Column, Column]:
    """PF11: (start, end) half-open from 0 for mode one_based_inclusive, inclusive or half_open; null if empty or negative."""
    s = start - 1 if mode == "one_based_inclusive" else start
    e = end + 1 if mode == "inclusive" else end
    good = (s >= 0) & (e > s)
    return F.when(good, s), F.when(good, e)


def clamp_clip(begin: Column, end: Column, total: Column) -> tuple[Column, Column]:
    """PF12: a span moved into [0, total), its length kept where it fits; a null end is the total."""
    e = F.coalesce(end, total)
    length = F.least(F.greatest(e - begin, F.lit(0)), total)
    start = F.greatest(F.least(begin, total - length), F.lit(0))
    return start, start + length


def score_gate(score: Column, present: Column, source: Column) -> Column:
    """PF17: null where absent, 1 where the source is presence alone, else the score."""
    return F.when(present, F.when(source == "presence", F.lit(1.0)).otherwise(score))


def hand_state(present: Column, source: Column) -> Column:
    """PF18: missing, occluded, predicted or observed."""
    return F.when(~present, "missing").when(source == "occluded", "occluded").when(source == "tracked", "predicted").otherwise("observed")


def is_anchor(present: Column, score: Column, source: Column, rejected: Column, least: float) -> Column:
    """PF19: a confident frame of a detection pass that wasn't rejected."""
    return present & source.isin("pass1", "pass2") & (F.coalesce(score, F.lit(0.0)) >= least) & ~rejected


def should_replace(present: Column, source: Column, state: Column) -> Column:
    """PF19: missing, tracked, occluded or held frames, and all that aren't observed."""
    return ~present | source.isin("tracked", "occluded", "hold") | (state != "observed")


def append_reason(current: Column, new: Column) -> Column:
    """PF20: reasons joined by '; ', blanks left out; null if there is none."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.nullif(F.concat_ws("; ", blank(current), blank(new)), F.lit(""))


def frame_warnings(hand_share: Column, pose_share: Column, guarded: Column, least_hand: float = 0.05, least_pose: float = 0.25) -> Column:
    """PF21: names of the warnings that apply."""
    all_ = F.array(F.when(hand_share <= least_hand, "few_hands"), F.when(pose_share <= least_pose, "low_pose"), F.when(guarded, "guarded"))
    return F.filter(all_, lambda x: x.isNotNull())


def round_metrics(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """PF23: metrics rounded half to even."""
    return df.select(*[F.bround(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])
