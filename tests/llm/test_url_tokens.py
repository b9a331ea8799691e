"""URL rules: tokens anywhere in a long URL are mined."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kinema.llm import urls


def test_late_tokens(spark):
    pages = [(i, f"https://a{i}.b{i}.c{i}.d{i}.e{i}.f{i}.g{i}.h{i}.i{i}.j{i}.site.info/x/y/{'bad' if i % 3 == 0 else 'good'}") for i in range(150)]
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    rows = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()
    assert all(r.verdict == ("block" if r.page_id % 3 == 0 else "allow") for r in rows)
    assert {r.mined for r in rows} == {None, "p2:bad"}


def brute_rules(rows, support, confidence, lift):
    """All combinations of tokens of the fitted rows by support, confidence and lift, those that hold on the rest, without covered ones."""
    fit, held = [r for r in rows if not r.held], [r for r in rows if r.held]
    least = max(support, urls.LEAST_ROWS / len(fit))
    share = lambda some: sum(r.blocked for r in some) / max(1, len(some))
    found = {}
    for combo in {c for r in fit for k in range(1, len(r.tokens) + 1) for c in itertools.combinations(sorted(r.tokens), k)}:
        has = [r for r in fit if set(combo) <= set(r.tokens)]
        bad = sum(r.blocked for r in has)
        if bad >= math.ceil(least * len(fit) - 1e-9) and bad / len(has) >= confidence and share(has) / share(fit) >= lift:
            there = [r for r in held if set(combo) <= set(r.tokens)]
            if len(there) >= urls.LEAST_HELD and share(there) > 0 and share(there) >= lift * share(held):
                found[combo] = bad / len(has)
    return {c for c in found if not any(set(d) < set(c) and found[d] >= found[c] for d in found)}


@pytest.mark.parametrize("seed", range(3))
def test_mined_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(500):
        tokens = sorted({rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))})
        bad = rng.random() < (0.95 if {"a", "b"} <= set(tokens) or "h" in tokens else 0.1 + 0.1 * seed)
        data.append((f"u{i}", tokens, bad))
    df = spark.createDataFrame(data, "url string, tokens array<string>, blocked boolean").withColumn("held", F.pmod(F.xxhash64("url", F.lit("held")), F.lit(urls.HELD_OUT)) == 0)
    want = brute_rules(df.collect(), 0.02, 0.7, 1.2)
    got = {tuple(r.tokens) for r in urls.mined_rules(df.drop("held"), 0.02, 0.7, 1.2).collect()}
    assert got == want and ("h",) in got and any(set(c) >= {"a", "b"} for c in got)


def test_rules_that_do_not_hold_are_dropped(spark):
    """A token that is blocked on the fitted URLs alone makes no rule; urls without labels are decided by those that hold."""
    df = spark.createDataFrame([(f"u{i}", ["x" if i % 3 else "y", f"z{i % 7}"]) for i in range(600)], "url string, tokens array<string>")
    held = F.pmod(F.xxhash64("url", F.lit("held")), F.lit(urls.HELD_OUT)) == 0
    x, y = F.array_contains("tokens", "x"), F.array_contains("tokens", "y")
    got = urls.mined_rules(df.withColumn("blocked", (y & (F.xxhash64("url") % 10 != 0)) | (x & ~held & F.array_contains("tokens", "z3")))).collect()
    assert {tuple(r.tokens) for r in got if "x" in r.tokens} == set() and any("y" in r.tokens for r in got)
    assert urls.mined_rules(df.withColumn("blocked", F.lit(True)).limit(0)).count() == 0
