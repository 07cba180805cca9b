"""Scans and selections that must stay exact while they take one pass or a few."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dragline.operators import filing_prose, ranking, resolve

WORDS = ["bonus", "incentive", "not", "linked", "tied", "based", "performance", "investment return", "return", "compensation", "profitability",
         "soft", "dollar", "section 28(e)", "research services", "commission", "commission sharing", "x", "and", "size of", "distribution"]


@pytest.mark.parametrize("table", [filing_prose.PAY_FLAGS, filing_prose.SOFT_FLAGS])
def test_terms_in_order_match_like_the_patterns(spark, table):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 9))) for _ in range(600)]
    patterns = {f"{name}{i}": p for name, ps in table.items() for i, p in enumerate(ps)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", *[filing_prose._in_order(F.col("t"), p).alias(n) for n, p in patterns.items()]).collect()
    for r in rows:
        for n, p in patterns.items():
            assert r[n] == bool(re.search(p, r.t)), (p, r.t)


def test_a_long_section_takes_one_pass(spark):
    text = "compensation bonus " * 60_000  # 1.1 MB; no term that follows
    started = time.time()
    row = spark.createDataFrame([(text,)], "t string").select(*[
        filing_prose._in_order(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(p for ps in filing_prose.PAY_FLAGS.values() for p in ps)]).first()
    assert sum(row) == 1 and time.time() - started < 20


@pytest.mark.parametrize("buckets", [2, 5, 256])
def test_quantiles_are_exact(spark, buckets):
    rnd = random.Random(3)
    rows = []
    for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 400)):
        for _ in range(n):
            x = rnd.choice([0.0, 5.0, rnd.gauss(0, 1e3), float(rnd.randint(0, 9)), 1e12])
            rows.append((g, x, None if rnd.random() < 0.3 else rnd.random()))
    rows.append(("e", None, None))
    got = {r.g: r for r in ranking.quantiles(spark.createDataFrame(rows, "g string, x double, y double"), "g", {
        "m": ("x", 0.5), "p": ("x", 0.9), "q": ("y", 0.25)}, buckets).collect()}
    assert "e" not in got
    for g in "abcd":
        x = [r[1] for r in rows if r[0] == g]
        y = [r[2] for r in rows if r[0] == g and r[2] is not None]
        assert got[g].m == pytest.approx(np.quantile(x, 0.5), rel=1e-12) and got[g].p == pytest.approx(np.quantile(x, 0.9), rel=1e-12)
        assert (got[g].q is None) if not y else got[g].q == pytest.approx(np.quantile(y, 0.25), rel=1e-12)


def test_alias_search_equals_contains(spark):
    rnd = random.Random(4)
    aliases = [(i, "".join(rnd.choice("ABC ") for _ in range(rnd.randint(0, 12))), f"T{i % 30}", f"N{'x' * rnd.randint(1, 5)}{i}") for i in range(200)]
    asked = sorted({"".join(rnd.choice("ABC") for _ in range(rnd.randint(1, 5))) for _ in range(60)}) + ["ZZ", "A C"]
    got = resolve.alias_search(spark.createDataFrame([(q.lower(),) for q in asked], "query string"),
                               spark.createDataFrame(aliases, "position int, alias string, ticker string, name string"), 4).collect()
    want = set()
    for q in {x.strip() for x in asked}:
        best = {}
        for position, alias, ticker, name in aliases:
            if len(q) >= 2 and q in alias and ticker not in best:
                best[ticker] = (alias.index(q), len(name), position, ticker, name)
        want |= {(q, i + 1, b[3], b[4]) for i, b in enumerate(sorted(best.values())[:4])}
    assert {tuple(r) for r in got} == want
    index = resolve.alias_index(spark.createDataFrame([(1, "A" * 400, "T", "N")], "position int, alias string, ticker string, name string"))
    assert index.count() == 399 + 398
