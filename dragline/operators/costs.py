"""The cost model: column algebra over one joined row per fund and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragline import assumptions as A
from dragline.functions.expr import (
    CALCULATED, ESTIMATED, NOT_DISCLOSED, UNAVAILABLE, hidden_grade, rnd, sum_present,
)
from dragline.operators.holdings import KEYS, contains_any

BPS = 10_000
INVESTMENT, YEARS, RETURN_PCT = A.DOLLAR_IMPACT


def net_assets(nport: Column, ncen: Column) -> Column:
    return F.coalesce(F.nullif(nport, F.lit(0.0)), ncen)


def turnover_fraction(prospectus: Column, ncen: Column) -> Column:
    return F.coalesce(prospectus, ncen, F.lit(A.DEFAULT_TURNOVER_PCT)) / 100.0


def _bps_of(amount: Column, nav: Column) -> Column:
    return F.when(nav > 0, rnd(amount / nav * BPS))


def spread_cost(covered: Column, low: Column, high: Column, turnover: Column) -> tuple[Column, Column]:
    """Round-trip spread; null when under half of the portfolio is covered, rebased when not near 1."""
    base = F.when(F.abs(covered - 1.0) > 0.01, covered).otherwise(F.lit(1.0))
    side = lambda s: F.when(covered >= 0.50, rnd(turnover * 2 * (s / base) * BPS))
    return side(low), side(high)


def impact_blend(turnover: Column, small_pct: Column, bond_pct: Column) -> tuple[Column, Column]:
    bond = F.least(bond_pct, F.lit(100.0)) / 100.0
    small = F.least(small_pct, F.lit(100.0)) / 100.0
    busy, bond_busy = turnover > A.EQUITY_TURNOVER_CUT, turnover > A.BOND_TURNOVER_CUT

    def side(i: int) -> Column:
        pick = lambda a, b, c: F.when(c, F.lit(A.IMPACT[a][i])).otherwise(F.lit(A.IMPACT[b][i]))
        equity = small * pick("small_high", "small_low", busy) + (1.0 - small) * pick("large_high", "large_low", busy)
        blended = (1.0 - bond) * equity + bond * pick("bond_high", "bond_low", bond_busy)
        return rnd(turnover * blended * BPS)

    return side(0), side(1)


def impact_by_category(turnover: Column, is_small: Column, is_bond: Column) -> tuple[Column, Column, Column]:
    """One category per fund instead of a blend; returns (category, low, high)."""
    busy = F.when(is_bond, turnover > A.BOND_TURNOVER_CUT).otherwise(turnover > A.EQUITY_TURNOVER_CUT)
    size = F.when(is_bond, "bond").when(is_small, "small").otherwise("large")
    key = F.concat(size, F.when(busy, "_high").otherwise("_low"))

    def side(i: int) -> Column:
        factor = None
        for name, pair in A.IMPACT.items():
            factor = (F if factor is None else factor).when(key == name, F.lit(pair[i]))
        return rnd(turnover * factor * BPS)

    return key, side(0), side(1)


def cash_drag(cash_usd: Column, nav: Column) -> dict[str, Column]:
    pct = F.when((nav > 0) & (cash_usd > 0), cash_usd / nav * 100.0).otherwise(F.lit(0.0))
    excess = F.greatest(pct - A.CASH_BASELINE_PCT, F.lit(0.0))
    low, high = A.CASH_DRAG_BPS_PER_PCT
    return {
        "cash_pct": pct,
        "excess": excess,
        "low": rnd(excess * low),
        "high": rnd(excess * high),
        "tag": F.when(excess > 0, ESTIMATED).otherwise(CALCULATED),
        "flagged": (excess > 0) & (pct > A.CASH_FLAG_PCT),
    }


def tax_drag(
    turnover: Column, is_equity: Column, dividend_yield_pct: Column | None = None,
    tax_managed: Column | None = None, include_niit: bool = True,
) -> dict[str, Column]:
    """Yearly tax cost in a taxable account; ``turnover`` is a fraction."""
    if tax_managed is not None:
        turnover = F.when(tax_managed, turnover * A.TAX_MANAGED_FACTOR).otherwise(turnover)
    niit = A.NIIT_RATE if include_niit else 0.0
    short_rate = A.ORDINARY_RATE + A.STATE_RATE + niit
    long_rate = A.LTCG_RATE + A.STATE_RATE + niit
    share = (
        F.when(turnover > 1.0, 0.50).when(turnover > 0.5, 0.35).when(turnover > 0.2, 0.20).otherwise(0.10)
    )
    realised = turnover * F.when(is_equity, A.EQUITY_GAIN).otherwise(A.BOND_GAIN)
    short = rnd(realised * share * short_rate * BPS, 1)
    long = rnd(realised * (1 - share) * long_rate * BPS, 1)
    y = dividend_yield_pct if dividend_yield_pct is not None else F.lit(0.0)
    dividend_rate = A.QUALIFIED_SHARE * (A.QUALIFIED_RATE + A.STATE_RATE + niit) + (1 - A.QUALIFIED_SHARE) * short_rate
    income = F.when(is_equity, rnd(F.greatest(y, F.lit(0.0)) / 100.0 * dividend_rate * BPS, 1)).otherwise(
        F.lit(round(A.BOND_YIELD * short_rate * BPS, 1))
    )
    total = short + long + income
    return {
        "share": share, "short": short, "long": long, "income": income,
        "low": rnd(total * A.TAX_RANGE[0], 1), "high": rnd(total * A.TAX_RANGE[1], 1),
    }


def is_etf(ticker: Column, name: Column) -> Column:
    return (F.length(F.coalesce(ticker, F.lit(""))) <= 4) | F.upper(F.coalesce(name, F.lit(""))).contains("ETF")


def is_bond_name(name: Column) -> Column:
    return contains_any(F.upper(F.coalesce(name, F.lit(""))), A.BOND_NAME_WORDS)


def tax_vs_expense(low: Column, high: Column, er_bps: Column) -> Column:
    mid = (low + high) / 2
    return (
        F.when(er_bps.isNull(), "no_expense_ratio").when(mid > er_bps, "exceeds_er")
        .when(mid > er_bps * 0.5, "adds_to_er").otherwise("minor")
    )


CENSUS = ("has_census", "commissions", "has_soft_dollar", "soft_dollar_usd", "ncen_turnover", "average_net_assets")


def fund_cost(fund: DataFrame, facts: DataFrame, ncen: DataFrame | None = None, fees: DataFrame | None = None,
              turnover_policy: str = "prospectus", carry: tuple[str, ...] = ()) -> DataFrame:
    """Full cost row for each fund and period in ``facts`` or ``ncen``, with a tag for what is unavailable.

    Without ``ncen`` the facts hold the census columns (``CENSUS``) themselves; columns to ``carry`` stay as they are.

    ``facts`` comes from ``holdings.fund_facts``; ``fees`` (optional) carries
    ``er_bps`` per series.  ``turnover_policy='default'`` prices every fund at
    the default turnover.
    """
    held = facts if "has_holdings" in facts.columns else facts.withColumn("has_holdings", F.lit(True))
    if ncen is not None:
        census = ncen.select(*KEYS, F.lit(True).alias("has_census"), *CENSUS[1:])
        held = held.join(census, list(KEYS), "full_outer")
    base = held.join(
        fund.select("series_id", "ticker", "fund_name", "family", "category", "prospectus_turnover"), "series_id"
    )
    if fees is not None:
        base = base.join(fees.select("series_id", "er_bps"), "series_id", "left")
    else:
        base = base.withColumn("er_bps", F.lit(None).cast("double"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    turnover = (
        turnover_fraction(F.col("prospectus_turnover"), F.col("ncen_turnover"))
        if turnover_policy == "prospectus" else F.lit(A.DEFAULT_TURNOVER_PCT / 100.0)
    )
    base = (
        base.withColumn("has_holdings", yes("has_holdings")).withColumn("has_census", yes("has_census"))
        .withColumn("net_assets", net_assets(F.col("nport_net_assets"), F.col("average_net_assets")))
        .withColumn("turnover", turnover)
    )
    nav, comm, t = F.col("net_assets"), F.col("commissions"), F.col("turnover")
    held_c = F.col("has_holdings")
    brokerage = F.when(F.col("has_census"), _bps_of(comm, nav))
    flagged_soft = yes("has_soft_dollar")
    soft_known = F.col("soft_dollar_usd").isNotNull()
    estimable = comm.isNotNull() & (nav > 0)
    soft = (
        F.when(soft_known, _bps_of(F.col("soft_dollar_usd"), nav))
        .when(flagged_soft & estimable, rnd(comm * A.SOFT_DOLLAR_HIGH_SHARE / nav * BPS))
    )
    soft_low = F.when(~soft_known & flagged_soft & estimable, rnd(comm * A.SOFT_DOLLAR_LOW_SHARE / nav * BPS))
    soft_tag = (
        F.when(soft_known, F.when(nav > 0, CALCULATED))
        .when(flagged_soft, F.when(F.coalesce(estimable, F.lit(False)), ESTIMATED).otherwise(NOT_DISCLOSED))
    )
    s_low, s_high = spread_cost(F.col("covered_weight"), F.col("spread_low"), F.col("spread_high"), t)
    i_low, i_high = impact_blend(t, F.col("small_cap_pct"), F.col("bond_pct"))
    has_nav = F.coalesce(nav != 0, F.lit(False))
    cash = cash_drag(F.col("cash_usd"), F.col("nport_net_assets"))
    etf = is_etf(F.col("ticker"), F.col("fund_name"))
    equity = F.when(held_c, F.col("bond_pct") < 50.0).otherwise(~is_bond_name(F.col("fund_name")))
    tax = tax_drag(t, equity)
    zero = F.lit(0.0)
    none = F.lit(None).cast("double")
    modelled = lambda c, ok=F.lit(True): F.when(~held_c, zero).otherwise(F.when(ok, c).otherwise(none))
    taxed = tax["high"] > 0
    return base.select(
        *KEYS, "ticker", "fund_name", "family", "category", "net_assets", "n_holdings", "turnover",
        "has_holdings", "has_census", "er_bps", "bond_pct", "small_cap_pct",
        brokerage.alias("brokerage_bps"),
        F.when(F.col("has_census"), F.when(comm.isNotNull() & (nav > 0), CALCULATED).otherwise(UNAVAILABLE))
        .alias("brokerage_tag"),
        soft.alias("soft_dollar_bps"), soft_low.alias("soft_dollar_low_bps"), soft_tag.alias("soft_dollar_tag"),
        modelled(s_low).alias("spread_low_bps"), modelled(s_high).alias("spread_high_bps"),
        F.when(~held_c, UNAVAILABLE).when(s_low.isNotNull(), ESTIMATED).alias("spread_tag"),
        modelled(i_low, has_nav).alias("impact_low_bps"), modelled(i_high, has_nav).alias("impact_high_bps"),
        F.when(~held_c, UNAVAILABLE).when(has_nav, ESTIMATED).alias("impact_tag"),
        F.when(held_c, cash["low"]).alias("cash_low_bps"), F.when(held_c, cash["high"]).alias("cash_high_bps"),
        F.when(held_c, cash["tag"]).alias("cash_tag"),
        F.when(etf, zero).when(taxed, tax["low"]).alias("tax_low_bps"),
        F.when(etf, zero).when(taxed, tax["high"]).alias("tax_high_bps"),
        F.when(etf, CALCULATED).when(taxed, ESTIMATED).alias("tax_tag"), *carry,
    )


COST_COLUMNS = (
    "ticker", "turnover", "net_assets", "er_bps", "brokerage_bps", "brokerage_tag", "soft_dollar_bps",
    "soft_dollar_low_bps", "soft_dollar_tag", "spread_low_bps", "spread_high_bps", "spread_tag", "impact_low_bps",
    "impact_high_bps", "impact_tag", "cash_low_bps", "cash_high_bps", "cash_tag", "tax_low_bps", "tax_high_bps",
    "tax_tag",
)


# -- totals ------------------------------------------------------------------


def _c(name: str) -> Column:
    return F.col(name)


def total_reported(underlying: Column | None = None) -> Column:
    parts = [_c("er_bps"), _c("brokerage_bps")] + ([underlying] if underlying is not None else [])
    return sum_present(*parts)


def with_totals(cost: DataFrame, underlying: str | None = None) -> DataFrame:
    """Reported total, the estimated range around it and the gap to the stated expense ratio."""
    rep = total_reported(_c(underlying) if underlying else None)
    or0 = lambda c: F.coalesce(_c(c), F.lit(0.0))
    return (
        cost.withColumn("total_reported_bps", rep)
        .withColumn("total_low_bps", _c("total_reported_bps") + or0("spread_low_bps") + or0("impact_low_bps"))
        .withColumn("total_high_bps", _c("total_reported_bps") + or0("spread_high_bps") + or0("impact_high_bps"))
        .withColumn("gap_low_bps", _c("total_low_bps") - _c("er_bps"))
        .withColumn("gap_high_bps", _c("total_high_bps") - _c("er_bps"))
    )


def hidden_total(side: str) -> Column:
    """Brokerage + spread + impact, leaving out what is unavailable; null when nothing is left."""
    usable = lambda v, tag: F.when(F.coalesce(_c(tag) != UNAVAILABLE, F.lit(True)), _c(v))
    return sum_present(
        _c("brokerage_bps"), usable(f"spread_{side}_bps", "spread_tag"), usable(f"impact_{side}_bps", "impact_tag")
    )


def reported_hidden(reported_only: bool = True) -> Column:
    """Brokerage plus disclosed soft dollars; estimated soft dollars only when asked for."""
    soft = F.when(_c("soft_dollar_tag") == CALCULATED, _c("soft_dollar_bps")) if reported_only else _c("soft_dollar_bps")
    return sum_present(_c("brokerage_bps"), soft)


def cost_components(cost: DataFrame) -> DataFrame:
    """One row per shown component, with the accounts it applies to."""
    soft_tag = _c("soft_dollar_tag")
    null = F.lit(None).cast("double")

    def item(label: str, low: Column, high: Column, tag: Column, applies: str, show: Column) -> Column:
        return F.when(
            F.coalesce(show, F.lit(False)),
            F.struct(
                F.lit(label).alias("component"), low.alias("low_bps"), high.alias("high_bps"),
                tag.alias("tag"), F.lit(applies).alias("applies_to"),
            ),
        )

    modelled = lambda tag, high: _c(tag).isNotNull() & (_c(tag) != UNAVAILABLE) & (_c(high) > 0)
    est = F.lit("estimated")
    items = F.array(
        item("Brokerage Commissions", _c("brokerage_bps"), _c("brokerage_bps"),
             F.when(_c("brokerage_bps").isNotNull(), "reported").otherwise("unavailable"), "all", F.lit(True)),
        item("Soft Dollar Cost",
             F.when(soft_tag == ESTIMATED, F.coalesce(_c("soft_dollar_low_bps"), F.lit(0.0)))
             .when(soft_tag == CALCULATED, _c("soft_dollar_bps")),
             F.when(soft_tag == NOT_DISCLOSED, null).otherwise(_c("soft_dollar_bps")),
             F.when(soft_tag == ESTIMATED, "estimated").when(soft_tag == CALCULATED, "reported").otherwise("warning"),
             "all", soft_tag.isNotNull()),
        item("Bid-Ask Spread Cost", _c("spread_low_bps"), _c("spread_high_bps"), est, "all",
             _c("spread_tag").isNotNull() & (_c("spread_tag") != UNAVAILABLE)),
        item("Market Impact Cost", _c("impact_low_bps"), _c("impact_high_bps"), est, "all",
             _c("impact_tag").isNotNull() & (_c("impact_tag") != UNAVAILABLE)),
        item("Cash Drag", _c("cash_low_bps"), _c("cash_high_bps"), est, "all", modelled("cash_tag", "cash_high_bps")),
        item("Tax Drag", _c("tax_low_bps"), _c("tax_high_bps"), est, "taxable_only",
             modelled("tax_tag", "tax_high_bps")),
    )
    return cost.select(*KEYS, "ticker", "er_bps", F.inline(F.array_compact(items)))


def account_totals(components: DataFrame) -> DataFrame:
    """Hidden and tax totals per fund, and the true cost with and without tax."""
    exact = lambda c: F.coalesce(_c(c), F.lit(0.0)).cast("decimal(18,4)")
    counted = _c("tag") != "warning"

    def total(side: str, who: str) -> Column:
        s = F.sum(F.when(counted & (_c("applies_to") == who), exact(side)))
        return F.greatest(F.coalesce(s.cast("double"), F.lit(0.0)), F.lit(0.0))

    sums = components.groupBy(*KEYS, "ticker", "er_bps").agg(
        total("low_bps", "all").alias("hidden_low"), total("high_bps", "all").alias("hidden_high"),
        total("low_bps", "taxable_only").alias("tax_low"), total("high_bps", "taxable_only").alias("tax_high"),
    )
    er = _c("er_bps")
    return sums.select(
        "*",
        rnd(er + _c("hidden_low")).alias("true_low_bps"), rnd(er + _c("hidden_high")).alias("true_high_bps"),
        rnd(er + _c("hidden_low") + _c("tax_low")).alias("taxable_low_bps"),
        rnd(er + _c("hidden_high") + _c("tax_high")).alias("taxable_high_bps"),
    )


def fee_breakdown(fees: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Stated fee parts as rows, in percent and basis points."""
    parts = (
        ("Management Fee", "management_fee"), ("12b-1 Fee", "twelve_b1_fee"),
        ("Other Expenses", "other_expenses"), ("Acquired Fund Fees", "acquired_fund_fees"),
    )
    rows = F.array_compact(F.array(*[
        F.when(_c(c).isNotNull(), F.struct(F.lit(label).alias("component"), _c(c).alias("pct"),
                                           rnd(_c(c) * 100).alias("bps")))
        for label, c in parts
    ]))
    return fees.select(*keys, F.inline(rows))


def dollar_impact(er_pct: Column, hidden_low_bps: Column, hidden_high_bps: Column) -> dict[str, Column]:
    """Whole dollars lost over the horizon to the expense ratio alone and to the true cost."""
    gross = RETURN_PCT / 100
    grown = lambda drag: F.lit(INVESTMENT) * F.pow(1 + gross - drag, F.lit(float(YEARS)))
    free = INVESTMENT * (1 + gross) ** YEARS
    er = er_pct / 100
    er_final = grown(er)
    best, worst = grown(er + hidden_low_bps / BPS), grown(er + hidden_high_bps / BPS)
    whole = lambda c: F.nullif(F.round(c.cast("decimal(28,6)"), 0).cast("bigint"), F.lit(0))
    return {
        "er_only_cost": whole(free - er_final),
        "true_cost_low": whole(free - best),
        "true_cost_high": whole(free - worst),
        "hidden_cost_low": whole(er_final - best),
        "hidden_cost_high": whole(er_final - worst),
        "final_er_only": whole(er_final),
        "final_true_low": whole(best),
        "final_true_high": whole(worst),
    }


def report_extract(cost: DataFrame) -> DataFrame:
    """Flat report row: components and their hidden total."""
    or0 = lambda c: F.coalesce(_c(c), F.lit(0.0))
    total = lambda s: rnd(or0("brokerage_bps") + or0(f"spread_{s}_bps") + or0(f"impact_{s}_bps"))
    return cost.select(
        *KEYS, "ticker", "fund_name", "family", "net_assets",
        F.coalesce("n_holdings", F.lit(0)).alias("holdings_count"),
        "brokerage_bps", (F.coalesce(_c("soft_dollar_tag") == NOT_DISCLOSED, F.lit(False))).alias("soft_dollar_active"),
        "spread_low_bps", "spread_high_bps", "impact_low_bps", "impact_high_bps",
        total("low").alias("total_low_bps"), total("high").alias("total_high_bps"),
        hidden_grade((total("low") + total("high")) / 2).alias("grade"),
    )
