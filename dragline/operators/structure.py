"""Funds that hold funds: classification, edges, bounded unwinding, bottom-up cost roll-up.

A fund's rolled-up cost depends only on the fund and on how many levels are
left below it, never on the path that led there.  So each level is one join
of the edge list with the per-fund totals of the level below, and a child held
by many wrappers is costed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dragline import assumptions as A
from dragline.functions.expr import dbl, ratio, rnd
from dragline.operators.holdings import KEYS, classified

W = "decimal(28,12)"


def fund_position_sums(kinds: DataFrame, header: DataFrame) -> DataFrame:
    """Underlying-fund positions added up per parent, child and sign; ``child`` is null for unresolved positions.

    ``kinds`` comes from ``holdings.position_kinds`` with the key ``child``.
    """
    sums = classified(kinds, header).filter("is_fund").groupBy(*KEYS, "child", "long").agg(
        F.sum("value").alias("value"), F.sum("positions").alias("positions"))
    return sums.join(header.select(*KEYS), list(KEYS), "left_semi")  # without a filing nothing is known to be unresolved


def _fund_share(value, net_assets):
    return F.coalesce(rnd(ratio(100.0 * dbl(value), net_assets), 4), F.lit(0.0))


def structure_class(header: DataFrame, sums: DataFrame) -> DataFrame:
    """fund_of_funds above 25 % in funds, cash_sweep above 0.5 %, else plain."""
    held = sums.groupBy(*KEYS).agg(F.sum("positions").alias("fund_positions"), F.sum("value").alias("_v"))
    out = header.select(*KEYS, "net_assets").join(held, list(KEYS), "left").select(
        *KEYS, F.coalesce("fund_positions", F.lit(0)).alias("fund_positions"),
        _fund_share(F.col("_v"), F.col("net_assets")).alias("fund_pct"),
    )
    return out.withColumn(
        "structure",
        F.when(F.col("fund_pct") > A.FUND_OF_FUNDS_PCT, "fund_of_funds")
        .when(F.col("fund_pct") > A.CASH_SWEEP_PCT, "cash_sweep").otherwise("plain"),
    )


def edges(sums: DataFrame, header: DataFrame) -> DataFrame:
    """Edge list below the funds-of-funds.

    A weight is the position's share of *all* fund positions, resolved or not,
    so the weights of a parent add up to its resolved coverage rather than to 1.
    """
    totals = sums.groupBy(*KEYS).agg(F.sum("value").alias("_all")).join(header.select(*KEYS, "net_assets"), list(KEYS))
    parents = totals.filter(
        (F.col("_all") > 0) & (_fund_share(F.col("_all"), F.col("net_assets")) > A.FUND_OF_FUNDS_PCT)
    )
    return (
        sums.filter(F.col("long") & F.col("child").isNotNull())
        .join(parents, list(KEYS))
        .select(
            F.col("series_id").alias("parent"), "period", "child", "positions",
            (dbl("value") / dbl("_all")).cast(W).alias("weight"),
        )
    )


def _named_sums(kinds: DataFrame, header: DataFrame) -> DataFrame:
    """Positive underlying-fund positions per name, cusip and child; ``kinds`` has those keys."""
    held = classified(kinds, header).filter("is_fund AND long").groupBy(*KEYS, "name", "cusip", "child").agg(
        F.sum("positions").alias("positions"), F.sum("value").alias("value"))
    return held.join(header.select(*KEYS, "net_assets"), list(KEYS))


def unresolved_notes(kinds: DataFrame, header: DataFrame) -> DataFrame:
    """One note row per unresolved underlying fund, with the weight it leaves uncovered."""
    return _named_sums(kinds, header).filter(F.col("child").isNull()).select(
        *KEYS, "name", "cusip", "positions", dbl("value").alias("value_usd"),
        F.concat(F.lit("Unresolved underlying fund: "), "name", F.lit(" ("), "cusip", F.lit(")")).alias("note"))


def _level(direct: DataFrame, edge: DataFrame, below: DataFrame) -> DataFrame:
    """Totals with one more level unwound; ``below`` holds the children's totals."""
    child = below.select(F.col("series_id").alias("child"), "period", F.col("total_bps").alias("child_bps"))
    contribution = dbl("weight") * F.col("child_bps")
    looked = (
        edge.join(child, ["child", "period"], "left")
        .groupBy(F.col("parent").alias("series_id"), "period")
        .agg(
            dbl(F.sum(contribution.cast("decimal(28,12)"))).alias("underlying_bps"),
            dbl(F.sum(F.when(F.col("child_bps").isNotNull(), F.col("weight")))).alias("covered_weight"),
            F.sum(F.when(F.col("child_bps").isNotNull(), F.col("positions"))).alias("contributors"),
            F.sum(F.when(F.col("child_bps").isNull(), F.col("positions"))).alias("missing"),
        )
    )
    own = F.col("direct_bps")
    under = F.col("underlying_bps")
    return direct.join(looked, list(KEYS), "left").withColumn(
        "total_bps",
        F.when(own.isNull() & under.isNull(), None).otherwise(
            F.coalesce(own, F.lit(0.0)) + F.coalesce(under, F.lit(0.0))
        ),
    )


def roll_up(direct: DataFrame, edge: DataFrame, max_depth: int = A.MAX_DEPTH) -> DataFrame:
    """Bottom-up roll-up of weighted child costs, ``max_depth`` levels in all.

    ``direct`` has (series_id, period, direct_bps); ``edge`` only edges whose
    parent is a fund-of-funds.  Cycles end at the depth bound.
    """
    below = direct.select(*KEYS, F.col("direct_bps").alias("total_bps"))
    out = None
    for _ in range(max_depth - 1):
        out = _level(direct, edge, below)
        below = out.select(*KEYS, "total_bps")
    return out


def members(roots: DataFrame, edge: DataFrame, max_depth: int = A.MAX_DEPTH) -> DataFrame:
    """Who sits below each root at which depth, with the product of weights along all paths."""
    level = roots.select(
        F.col("series_id").alias("root"), "period", F.col("series_id").alias("member"),
        F.lit(1).cast(W).alias("weight"), F.lit(1).cast("bigint").alias("paths"),
    )
    out = level.withColumn("depth", F.lit(0))
    step = edge.select(F.col("parent").alias("member"), "period", "child", F.col("weight").alias("_w"),
                       F.col("positions").alias("_n"))
    for depth in range(1, max_depth):
        level = (
            level.join(step, ["member", "period"])
            .groupBy("root", "period", F.col("child").alias("member"))
            .agg(F.sum((dbl("weight") * dbl("_w")).cast(W)).cast(W).alias("weight"),
                 F.sum(F.col("paths") * F.col("_n")).alias("paths"))
        )
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out


def leaves(member: DataFrame, edge: DataFrame, max_depth: int = A.MAX_DEPTH) -> DataFrame:
    """Members that are not unwound further: no edges of their own, or at the last depth."""
    parents = edge.select(F.col("parent").alias("member"), "period").distinct()
    at_bound = member.filter(F.col("depth") == max_depth - 1)
    above = member.filter(F.col("depth") < max_depth - 1)
    return above.join(parents, ["member", "period"], "left_anti").select(member.columns).unionByName(at_bound)


def top_contributors(edge: DataFrame, child_totals: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` children that add most to each parent, as one row per parent."""
    child = child_totals.select(F.col("series_id").alias("child"), "period", "total_bps")
    priced = edge.join(child, ["child", "period"]).filter(F.col("total_bps").isNotNull())
    add = rnd(dbl("weight") * F.col("total_bps"), 6)
    w = Window.partitionBy("parent", "period").orderBy(F.col("adds_bps").desc(), F.col("child"))
    top = (
        priced.withColumn("adds_bps", add).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    )
    return top.select("parent", "period", "rank", "child", rnd(dbl("weight"), 6).alias("weight"),
                      rnd("total_bps", 4).alias("child_bps"), rnd("adds_bps", 4).alias("adds_bps"))


def wrapper_decomposition(stated: DataFrame, edge: DataFrame, high_confidence: bool = True) -> DataFrame:
    """What the wrapper itself charges: stated ratio minus the weighted ratio of what it holds.

    ``stated`` has (series_id, er_bps), one row per fund.  ``high_confidence``
    is false when the identifier map behind the edges was not available.
    """
    child = stated.select(F.col("series_id").alias("child"), F.col("er_bps").alias("child_er"))
    known = F.col("child_er").isNotNull()
    sums = (
        edge.join(child, "child", "left").groupBy(F.col("parent").alias("series_id"), "period")
        .agg(
            F.sum("positions").alias("underlying_positions"),
            dbl(F.sum(F.when(known, F.col("weight")))).alias("_covered"),
            dbl(F.sum((dbl("weight") * F.col("child_er")).cast(W))).alias("_weighted"),
        )
    )
    covered = F.coalesce("_covered", F.lit(0.0))
    weighted = rnd(ratio(F.col("_weighted"), F.col("_covered")))
    out = sums.join(stated, "series_id", "left").select(
        *KEYS, "underlying_positions", F.col("er_bps").alias("stated_er_bps"),
        weighted.alias("weighted_underlying_bps"), rnd(covered, 6).alias("covered_weight"),
        (rnd(covered, 6) >= A.WRAPPER_COVERAGE).alias("coverage_ok"),
        F.lit("high" if high_confidence else "low").alias("confidence"),
    )
    return out.withColumn("wrapper_bps", rnd(F.col("stated_er_bps") - F.col("weighted_underlying_bps"))).withColumn(
        "publishable", F.col("coverage_ok") & (F.col("confidence") == "high") & F.col("wrapper_bps").isNotNull()
    )


def underlying_list(kinds: DataFrame, header: DataFrame, fund: DataFrame) -> DataFrame:
    """Display list of underlying funds with whatever they resolved to."""
    names = fund.select(F.col("series_id").alias("child"), F.col("ticker").alias("resolved_ticker"))
    return _named_sums(kinds, header).join(names, "child", "left").select(
        *KEYS, "name", "cusip", "resolved_ticker", rnd(ratio(100.0 * dbl("value"), F.col("net_assets")), 4).alias("pct_of_net_assets")
    )
