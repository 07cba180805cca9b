"""Holding-level predicates and exposures (one row per position in, one row per fund and period out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dragline import assumptions as A
from dragline.functions.expr import CALCULATED, UNAVAILABLE, any_of, dbl, lookup, ratio, rnd
from dragline.scale import settle

KEYS = ("series_id", "period")
SHARE = "decimal(28,8)"


def is_derivative(category: Column) -> Column:
    up = F.upper(F.coalesce(category, F.lit("")))
    return up.startswith("D") & (up != "DBT")


def derivative_label(category: Column) -> Column:
    return F.when(is_derivative(category), F.coalesce(lookup(F.upper(category), A.DERIVATIVE_LABELS), category))


def contains_any(text: Column, words) -> Column:
    return any_of(*[text.contains(w) for w in words])


def is_cash_like(category: Column, name: Column) -> Column:
    named = contains_any(F.upper(F.coalesce(name, F.lit(""))), A.CASH_NAME_WORDS)
    return F.coalesce(category == "STIV", F.lit(False)) | named


def is_named_fund(issuer: Column, name: Column, category: Column) -> Column:
    """Registered-fund issuer, or a fund-like name that is no securitisation."""
    cat = F.upper(F.coalesce(category, F.lit("")))
    by_issuer = F.upper(F.coalesce(issuer, F.lit(""))).isin(*A.FUND_ISSUER_CATEGORIES)
    by_name = name.rlike(A.FUND_NAME_PATTERN) & ~(name.rlike(A.SECURITISATION_PATTERN) | cat.startswith("ABS"))
    return by_issuer | F.coalesce(by_name, F.lit(False))


def is_underlying_fund(issuer: Column, name: Column, category: Column, pct: Column) -> Column:
    """The same for a position whose percent of net assets is reported: a large cash vehicle counts, too."""
    large_cash = (category == "STIV") & (pct > A.STIV_FUND_PCT)
    return is_named_fund(issuer, name, category) | F.coalesce(large_cash, F.lit(False))


def position_kinds(holdings: DataFrame, detail: dict[str, Column] | None = None) -> DataFrame:
    """One pass over the positions: value and count per fund, period and kind of position.

    Issuer, name and category say of nearly every position whether it is an underlying fund.  Only a cash vehicle
    (``open_value``) must wait for the fund's net assets, so it keeps its value as a key; all others are added up where
    they lie.  ``detail`` names further keys of positions that may be funds.  Net assets come from the same table.
    """
    named = is_named_fund(F.col("issuer_category"), F.col("name"), F.col("asset_category"))
    cash = ~named & F.coalesce(F.col("asset_category") == "STIV", F.lit(False))
    maybe = named | cash
    extra = [F.when(maybe, c).alias(k) for k, c in (detail or {}).items()]
    return settle(
        holdings.groupBy(*KEYS, named.alias("is_fund"), F.when(cash, F.col("value_usd")).alias("open_value"), *extra,
                         F.when(maybe, F.col("value_usd") > 0).alias("long"))
        .agg(F.count("*").alias("positions"), F.sum("value_usd").alias("value"))
    )


def header_of_kinds(kinds: DataFrame, fund: DataFrame) -> DataFrame:
    """Filing header (net assets, positions) of funds with a holdings filing, from ``position_kinds``."""
    sums = kinds.groupBy(*KEYS).agg(dbl(F.sum("value")).alias("net_assets"), F.sum("positions").alias("n_holdings"))
    filed = fund.filter("has_nport").select("series_id", "nav_factor")
    return sums.join(filed, "series_id").select(*KEYS, (F.col("net_assets") * F.col("nav_factor")).alias("net_assets"), "n_holdings")


def classified(kinds: DataFrame, header: DataFrame) -> DataFrame:
    """``position_kinds`` with ``is_fund`` decided: a cash vehicle counts above ``STIV_FUND_PCT`` of net assets."""
    share = ratio(100.0 * dbl("open_value"), F.col("net_assets"))
    waiting = kinds.filter(F.col("open_value").isNotNull()).join(header.select(*KEYS, "net_assets"), list(KEYS))
    decided = waiting.withColumn("is_fund", F.coalesce(share > A.STIV_FUND_PCT, F.lit(False))).drop("net_assets")
    return kinds.filter(F.col("open_value").isNull()).unionByName(decided)


def filed(sums: DataFrame, fund: DataFrame, value: str, detail: str | None = None) -> DataFrame:
    """Sums with net assets from the same pass and a tag; ``sums`` has few rows for each fund and period.

    A fund-period without a holdings filing keeps one row, with null ``detail``, null net assets and UNAVAILABLE.
    """
    of = Window.partitionBy(*KEYS)
    rows = sums.withColumn("_all", F.sum(value).over(of)).join(fund.select("series_id", "nav_factor", "has_nport"), "series_id")
    if detail is not None:
        rows = rows.withColumn("_row", F.row_number().over(of.orderBy(F.col(detail)))).filter(F.col("has_nport") | (F.col("_row") == 1))
        rows = rows.withColumn(detail, F.when(F.col("has_nport"), F.col(detail))).drop("_row")
    return rows.withColumn("net_assets", F.when(F.col("has_nport"), dbl("_all") * F.col("nav_factor"))).withColumn(
        "tag", F.when(F.col("has_nport"), CALCULATED).otherwise(UNAVAILABLE)).drop("_all", "nav_factor", "has_nport")


def header_of(holdings: DataFrame, fund: DataFrame | None = None) -> DataFrame:
    """Filing header: net assets per fund and period, optionally scaled by a fund attribute."""
    h = holdings.groupBy(*KEYS).agg(dbl(F.sum("value_usd")).alias("net_assets"), F.count("*").alias("n_holdings"))
    if fund is not None:
        h = (
            h.join(fund.filter("has_nport").select("series_id", "nav_factor"), "series_id")
            .withColumn("net_assets", F.col("net_assets") * F.col("nav_factor"))
            .drop("nav_factor")
        )
    return h


def category_key() -> Column:
    return F.coalesce(F.nullif("asset_category", F.lit("")), F.lit("UNKNOWN")).alias("asset_category")


def asset_class_weights(holdings: DataFrame, fund: DataFrame | None = None) -> DataFrame:
    """Weight per asset category: reported percents added up, or with ``fund`` dollars divided once per group."""
    if fund is None:
        total = F.coalesce(F.sum(F.col("pct_of_net_assets").cast(SHARE)), F.lit(0))
        return holdings.groupBy(*KEYS, category_key()).agg(dbl(total).alias("weight_pct"))
    sums = holdings.groupBy(*KEYS, category_key()).agg(F.coalesce(F.sum("value_usd"), F.lit(0)).alias("_m"))
    return _weights(filed(sums, fund, "_m", "asset_category"))


def category_weights(by_category: DataFrame, fund: DataFrame) -> DataFrame:
    """``asset_class_weights`` from the sums of ``category_sums``."""
    sums = by_category.groupBy(*KEYS, category_key()).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("_m"))
    return _weights(filed(sums, fund, "_m", "asset_category"))


def _weights(sums: DataFrame) -> DataFrame:
    return sums.select(*KEYS, "asset_category", ratio(100.0 * dbl("_m"), F.col("net_assets")).alias("weight_pct"), "tag")


def category_sums(holdings: DataFrame, basis: str = "value", small_position: float = A.SMALL_POSITION_USD,
                  also: tuple[str, ...] = ()) -> DataFrame:
    """The one pass over the positions: a few plain sums per fund, period and category.

    Narrow rows are dealt by fund and period first: a scan meets a bit of nearly every fund, so that combining there keeps
    a group for almost every row.  Dealt rows are combined before the shuffle of the sums, and a hash that is no grouping
    key lets adaptive execution split the share of a fund with a third of all rows.  Columns named in ``also`` are added
    up, too.
    """
    cat, value = F.col("asset_category"), F.col("value_usd")
    m = F.col("pct_of_net_assets").cast("decimal(18,8)") if basis == "reported" else value
    cash = is_cash_like(cat, F.col("name"))
    valued = F.coalesce(value != 0, F.lit(False))
    has_pct = "pct_of_net_assets" in holdings.columns
    unvalued_pct = F.col("pct_of_net_assets").cast("decimal(18,8)") if has_pct else F.lit(None).cast("decimal(18,8)")
    rows = holdings.select(
        *KEYS, "asset_category", value.alias("_value"), m.alias("m"), (cash & valued).alias("_cash"),
        F.when(cash & ~valued, unvalued_pct).alias("cash_pct"), *also, F.hash(*KEYS).alias("_deal"))
    value, positive = F.col("_value"), F.col("_value") > 0
    return rows.hint("rebalance", "_deal").groupBy(*KEYS, "asset_category").agg(
        F.count("*").alias("n"),
        F.sum("m").alias("m"),
        F.sum(F.when(positive, value)).alias("long"),
        F.sum(F.when(positive & (value < small_position), value)).alias("small"),
        F.sum(F.when(F.col("_cash"), F.abs(value))).alias("cash"),
        F.sum("cash_pct").alias("cash_pct"),
        *[F.sum(c).alias(c) for c in also],
    )


def holding_facts(by_category: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Every additive holdings measure of the cost model; spreads depend on the category and are applied to its sums."""
    cat = F.col("asset_category")
    weight = F.coalesce(F.col("m"), F.lit(0)).cast("decimal(28,8)")
    side = lambda i: F.coalesce(lookup(cat, A.spread_of_category(i)), F.lit(A.SPREAD_DEFAULT[i])).cast("decimal(6,4)")
    equity = cat.isin(*A.EQUITY_CATEGORIES)
    return by_category.groupBy(*KEYS).agg(
        F.sum("n").alias("n_holdings"),
        F.sum(weight).alias("m_total"),
        F.sum(weight * side(0)).alias("m_spread_low"),
        F.sum(weight * side(1)).alias("m_spread_high"),
        F.sum(F.when(cat.isin(*A.BOND_CATEGORIES), weight)).alias("m_bond"),
        F.sum(F.when(equity, F.col("long"))).alias("equity_value"),
        F.sum(F.when(equity, F.col("small"))).alias("small_value"),
        F.sum("cash").alias("cash_value"),
        F.sum("cash_pct").alias("cash_pct_unvalued"),
        *[F.sum(c).alias(c) for c in also],
    )


def unfiled(facts: DataFrame, filed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep fund-periods without a holdings filing, with nulls for what the filing would say (all but ``keep``)."""
    return facts.select(
        *KEYS, *keep, F.col(filed).alias("has_holdings"),
        *[F.when(F.col(filed), F.col(c)).alias(c) for c in facts.columns if c not in (*KEYS, *keep, filed)])


def fund_facts(facts: DataFrame, header: DataFrame | None = None, basis: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """Ratios from ``holding_facts`` once net assets are known; one row per fund and period.

    Net assets come from the filing header, or stand in ``facts`` already; columns to ``carry`` stay as they are.
    """
    known = facts if header is None else facts.drop("n_holdings").join(header, list(KEYS))
    nav = F.col("net_assets")
    per = (lambda c: dbl(c) / 100.0) if basis == "reported" else (lambda c: ratio(dbl(c), nav))
    zero = F.lit(0.0)
    return known.select(
        *KEYS, *carry,
        nav.alias("nport_net_assets"),
        "n_holdings",
        per("m_total").alias("covered_weight"),
        per("m_spread_low").alias("spread_low"),
        per("m_spread_high").alias("spread_high"),
        F.coalesce(per("m_bond") * 100.0, zero).alias("bond_pct"),
        F.when(F.col("equity_value") > 0, 100.0 * dbl(F.coalesce("small_value", F.lit(0))) / dbl("equity_value"))
        .otherwise(zero).alias("small_cap_pct"),
        (F.coalesce(dbl("cash_value"), zero) + F.coalesce(dbl("cash_pct_unvalued") / 100.0 * nav, zero)).alias("cash_usd"),
    )


# -- exposures ----------------------------------------------------------------


def country_key(country: Column) -> Column:
    c = F.upper(F.trim(F.coalesce(country, F.lit("UNKNOWN"))))
    return F.when(c == "", "UNKNOWN").otherwise(c)


def country_exposure(holdings: DataFrame, fund: DataFrame) -> DataFrame:
    """Country weights in three modes: net, positive positions only, and absolute."""
    v = F.coalesce(F.col("value_usd"), F.lit(0)).cast("decimal(18,2)")
    sums = holdings.groupBy(*KEYS, country_key(F.col("country")).alias("country")).agg(
        F.sum(v).alias("_net"),
        F.sum(F.when(v >= 0, v)).alias("_long"),
        F.sum(F.abs(v)).alias("_abs"),
    )
    pct = lambda c: ratio(100.0 * dbl(c), F.col("net_assets"))
    return filed(sums, fund, "_net", "country").select(
        *KEYS, "country",
        pct("_net").alias("net_pct"), pct("_long").alias("gross_long_pct"), pct("_abs").alias("gross_absolute_pct"), "tag",
    )


def top_countries(exposure: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest net exposures of each fund (pruned before the shuffle)."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("net_pct").desc(), F.col("country"))
    return exposure.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def country_concentration(exposure: DataFrame, n: int = 1) -> DataFrame:
    return (
        top_countries(exposure, n)
        .groupBy(*KEYS)
        .agg(rnd(dbl(F.sum(F.col("net_pct").cast("decimal(28,10)"))), 4).alias("concentration_pct"))
    )


def geography_summary(exposure: DataFrame) -> DataFrame:
    """Distinct countries, top-1, top-5, non-US share and the top-20 list in one row per fund, from one pass."""
    exact = F.col("net_pct").cast("decimal(28,10)")
    w = Window.partitionBy(*KEYS).orderBy(F.col("net_pct").desc(), F.col("country"))
    held = F.col("tag") != UNAVAILABLE
    rows = exposure.withColumn("rank", F.row_number().over(w)).groupBy(*KEYS).agg(
        F.count(F.when(F.col("country") != "UNKNOWN", 1)).alias("_n"),
        F.sum(F.when(F.col("country").isin("US", "UNKNOWN"), exact)).alias("_home"),
        F.max(F.when(F.col("rank") == 1, F.col("net_pct"))).alias("_one"),
        F.sum(F.when(F.col("rank") <= 5, exact)).alias("_five"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= 20, F.struct("rank", "country")))).alias("_list"),
        F.max("tag").alias("tag"),
    )
    listed = F.concat_ws(",", F.transform("_list", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["country"])))
    return rows.select(
        *KEYS, F.when(held, F.col("_n")).alias("distinct_countries"),
        rnd("_one", 4).alias("top_country_pct"),
        rnd(dbl("_five"), 4).alias("top_5_countries_pct"),
        F.when(held, rnd(100.0 - F.coalesce(dbl("_home"), F.lit(0.0)), 4)).alias("non_us_excluding_unknown_pct"),
        F.when(held, listed).alias("top_countries"), "tag",
    )


def derivative_summary(holdings: DataFrame, fund: DataFrame) -> DataFrame:
    """Positions, categories, instruments, notional and unrealised result per fund, from one pass over all positions.

    The collected sets hold category and instrument names, at most a handful each.
    """
    here = is_derivative(F.col("asset_category"))
    label = F.when(here, derivative_label(F.col("asset_category")))
    count = lambda c: F.count(F.when(c, 1))
    sums = holdings.groupBy(*KEYS).agg(
        F.sum("value_usd").alias("_value"),
        count(here).alias("positions"),
        F.concat_ws("|", F.array_sort(F.collect_set(label))).alias("categories"),
        F.concat_ws("|", F.array_sort(F.collect_set(F.when(here, F.col("instrument_type"))))).alias("instrument_types"),
        F.sum(F.when(here, F.col("notional_usd"))).alias("_notional"),
        F.sum(F.when(here, F.col("unrealized_usd"))).alias("_unrealized"),
        *[count(label == name).alias(f"n_{code.lower()}") for code, name in A.DERIVATIVE_LABELS.items()],
    )
    held = F.col("tag") != UNAVAILABLE
    zero = F.lit(0.0)
    notional = F.coalesce(dbl("_notional"), zero)
    said = {
        "positions": F.col("positions"), "categories": F.col("categories"), "instrument_types": F.col("instrument_types"),
        "notional_usd": rnd(notional),
        "notional_pct_of_nav": F.when(F.col("net_assets") > 0, rnd(notional / F.col("net_assets") * 100, 4)),
        "unrealized_usd": rnd(F.coalesce(dbl("_unrealized"), zero)),
        **{f"n_{c.lower()}": F.col(f"n_{c.lower()}") for c in A.DERIVATIVE_LABELS},
    }
    return filed(sums, fund, "_value").select(*KEYS, *[F.when(held, c).alias(k) for k, c in said.items()], "tag")


def top_counterparties(holdings: DataFrame, n: int = 10) -> DataFrame:
    d = holdings.filter(
        is_derivative(F.col("asset_category")) & F.col("counterparty_name").isNotNull()
        & F.coalesce(F.col("notional_usd") != 0, F.lit(False))
    )
    sums = d.groupBy(*KEYS, "counterparty_name").agg(F.sum("notional_usd").alias("_n"))
    w = Window.partitionBy(*KEYS).orderBy(F.col("_n").desc(), F.col("counterparty_name"))
    return (
        sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
        .select(*KEYS, "rank", "counterparty_name", dbl("_n").alias("notional_usd"))
    )


def fund_and_direct(kinds: DataFrame, fund: DataFrame) -> DataFrame:
    """Underlying funds and direct securities; totals per fund, period and kind."""
    header = header_of_kinds(kinds, fund)
    sums = classified(kinds, header).groupBy(*KEYS, "is_fund").agg(
        F.sum("positions").alias("positions"), dbl(F.sum("value")).alias("value_usd"))
    return sums.join(header.select(*KEYS), list(KEYS), "left_semi")
