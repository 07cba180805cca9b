"""Queries over holdings, census, fees and fund structure, with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dragline import assumptions as A
from dragline.functions.expr import UNAVAILABLE, dbl, dollars, hidden_grade, money, rnd
from dragline.operators import conflicts, costs, history, holdings, portfolio, ranking, structure
from dragline.operators.holdings import KEYS
from dragline.plans.oracle_views import (
    R, V_BROKER, V_FEE, V_FUND, V_HOLDING, V_LOOKUP, V_NCEN, V_POSITION, with_views,
)
from dragline.scale import ranked, settle
from dragline.sources.fund_views import CENSUS_SUMS, FundViews

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, path: fn(FundViews(spark, path))
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


SMALL = 50_000.0  # position size cut on the scale of the test tables


# -- shared stages -------------------------------------------------------------


def _header(v: FundViews, h: DataFrame) -> DataFrame:
    return holdings.header_of(h, v.fund())


def _category_sums(v: FundViews, small: float = SMALL) -> DataFrame:
    return holdings.category_sums(v.holding(), small_position=small, also=CENSUS_SUMS)


def _facts(v: FundViews, by_category: DataFrame | None = None) -> DataFrame:
    """Facts of both filings from one pass: net assets are the sum of values, census sums ride along."""
    by_category = _category_sums(v) if by_category is None else by_category
    facts = holdings.holding_facts(by_category, also=CENSUS_SUMS)
    filed = v.fund().select("series_id", "nav_factor", "has_nport")
    known = facts.join(filed, "series_id").withColumn("net_assets", dbl("m_total") * F.col("nav_factor"))
    return holdings.unfiled(holdings.fund_facts(known, carry=("has_nport", *CENSUS_SUMS)), "has_nport", CENSUS_SUMS)


def _stated(v: FundViews) -> DataFrame:
    """Stated expense ratio per fund from its newest usable fee table."""
    ok = history.completed(v.fee_snapshot()).filter(F.col("filing_date").isNotNull())
    er = history.effective_expense_ratio(F.col("net_expenses"), F.col("total_annual_expenses"))
    return ok.groupBy("series_id").agg(
        rnd(F.max_by(er, F.unix_date("filing_date").cast("long") * (1 << 40) + F.col("accession_no")) * 100).alias("er_bps")
    )


def _cost(v: FundViews, by_category: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    facts = v.census_of(_facts(v, by_category)).drop("ticker", "category", "family")
    return costs.fund_cost(v.fund(), facts, fees=_stated(v), carry=carry)


H = "v_header AS (SELECT series_id, period, CAST(sum(value_usd) AS DOUBLE) * max(nav_factor) AS net_assets, count(*) AS n_holdings FROM v_holding JOIN v_fund USING (series_id) WHERE has_nport GROUP BY 1, 2)"


def _case(mapping: dict, col: str, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


_LOW = _case(A.spread_of_category(0), "asset_category", "0.0010")
_HIGH = _case(A.spread_of_category(1), "asset_category", "0.0025")
_CASHY = "(asset_category = 'STIV' OR " + " OR ".join(f"contains(upper(name), '{w}')" for w in A.CASH_NAME_WORDS) + ")"
_BONDS = "(" + ", ".join(f"'{c}'" for c in A.BOND_CATEGORIES) + ")"
_D = lambda x: f"CAST({x} AS DOUBLE)"

V_FACTS = f"""
v_facts AS (
  SELECT series_id, period, net_assets AS nport_net_assets, n_holdings, tot / net_assets AS covered_weight,
    slow / net_assets AS spread_low, shigh / net_assets AS spread_high,
    coalesce(bond / net_assets * 100, 0) AS bond_pct,
    CASE WHEN eq > 0 THEN 100.0::DOUBLE * coalesce(sm, 0) / eq ELSE 0 END AS small_cap_pct, coalesce(cash, 0) AS cash_usd
  FROM (SELECT series_id, period, {_D('sum(value_usd)')} AS tot,
      {_D(f'sum(value_usd * CAST({_LOW} AS DECIMAL(6,4)))')} AS slow,
      {_D(f'sum(value_usd * CAST({_HIGH} AS DECIMAL(6,4)))')} AS shigh,
      {_D(f'sum(CASE WHEN asset_category IN {_BONDS} THEN value_usd END)')} AS bond,
      {_D("sum(CASE WHEN asset_category IN ('EC','EP') AND value_usd > 0 THEN value_usd END)")} AS eq,
      {_D("sum(CASE WHEN asset_category IN ('EC','EP') AND value_usd > 0 AND value_usd < 50000 THEN value_usd END)")} AS sm,
      {_D(f'sum(CASE WHEN {_CASHY} THEN abs(value_usd) END)')} AS cash
    FROM v_holding GROUP BY 1, 2) a JOIN v_header USING (series_id, period))"""

V_STATED = f"""
v_snap AS (SELECT * FROM (SELECT * REPLACE (coalesce(total_annual_expenses,
      {R("management_fee + coalesce(twelve_b1_fee, 0) + other_expenses + coalesce(acquired_fund_fees, 0)", 4)}) AS total_annual_expenses)
    FROM v_fee) z
  WHERE (management_fee IS NOT NULL OR total_annual_expenses IS NOT NULL)
    AND NOT coalesce(total_annual_expenses = 0 AND coalesce(management_fee, 0) = 0 AND coalesce(net_expenses, 0) = 0, false)),
v_stated AS (SELECT series_id, {R("er * 100")} AS er_bps FROM (SELECT series_id, coalesce(net_expenses, total_annual_expenses) AS er,
    row_number() OVER (PARTITION BY series_id ORDER BY filing_date DESC, accession_no DESC) AS rn FROM v_snap) q WHERE rn = 1)"""

_ETF = "(length(ticker) <= 4 OR contains(upper(fund_name), 'ETF'))"
_BONDNAME = "(" + " OR ".join(f"contains(upper(fund_name), '{w}')" for w in A.BOND_NAME_WORDS) + ")"


def _tax_sql(t: str, eq: str) -> dict[str, str]:
    share = f"(CASE WHEN {t} > 1.0 THEN 0.5 WHEN {t} > 0.5 THEN 0.35 WHEN {t} > 0.2 THEN 0.2 ELSE 0.1 END)::DOUBLE"
    gain = f"(CASE WHEN {eq} THEN 0.07 ELSE 0.02 END)::DOUBLE"
    short = R(f"{t} * {gain} * {share} * 0.458::DOUBLE * 10000", 1)
    long = R(f"{t} * {gain} * (1 - {share}) * 0.288::DOUBLE * 10000", 1)
    inc = f"(CASE WHEN {eq} THEN 0 ELSE 183.2 END)::DOUBLE"
    tot = f"({short} + {long} + {inc})"
    return {"short": short, "long": long, "inc": inc, "low": R(f"{tot} * 0.7::DOUBLE", 1), "high": R(f"{tot} * 1.3::DOUBLE", 1)}


def _impact_sql(t: str, i: int) -> str:
    v = {k: A.IMPACT[k][i] for k in A.IMPACT}
    sm, bd = "(least(small_cap_pct, 100) / 100)", "(least(bond_pct, 100) / 100)"
    eq = (f"({sm} * (CASE WHEN {t} > 0.5 THEN {v['small_high']} ELSE {v['small_low']} END)::DOUBLE"
          f" + (1 - {sm}) * (CASE WHEN {t} > 0.5 THEN {v['large_high']} ELSE {v['large_low']} END)::DOUBLE)")
    return R(f"{t} * ((1 - {bd}) * {eq} + {bd} * (CASE WHEN {t} > 1 THEN {v['bond_high']} ELSE {v['bond_low']} END)::DOUBLE) * 10000")


def _spread_sql(t: str, side: str) -> str:
    base = "CASE WHEN abs(covered_weight - 1) > 0.01 THEN covered_weight ELSE 1 END"
    return f"CASE WHEN covered_weight >= 0.5 THEN {R(f'{t} * 2 * (spread_{side} / ({base})) * 10000')} END"


_CASHPCT = "(CASE WHEN nport_net_assets > 0 AND cash_usd > 0 THEN cash_usd / nport_net_assets * 100 ELSE 0 END)"
_EXC = f"greatest({_CASHPCT} - 2, 0)"
_TAX = _tax_sql("turnover", "(CASE WHEN has_holdings THEN bond_pct < 50 ELSE NOT " + _BONDNAME + " END)")

V_COST = f"""
v_cost AS (
  SELECT series_id, period, ticker, fund_name, family, category, net_assets, n_holdings, turnover, has_holdings, has_census,
    er_bps, bond_pct, small_cap_pct,
    CASE WHEN has_census AND net_assets > 0 THEN {R('commissions / net_assets * 10000')} END AS brokerage_bps,
    CASE WHEN has_census THEN CASE WHEN commissions IS NOT NULL AND net_assets > 0 THEN 'CALCULATED' ELSE 'UNAVAILABLE' END END AS brokerage_tag,
    CASE WHEN soft_dollar_usd IS NOT NULL THEN CASE WHEN net_assets > 0 THEN {R('soft_dollar_usd / net_assets * 10000')} END
      WHEN has_soft_dollar AND net_assets > 0 THEN {R('commissions * 0.45::DOUBLE / net_assets * 10000')} END AS soft_dollar_bps,
    CASE WHEN soft_dollar_usd IS NULL AND has_soft_dollar AND net_assets > 0 THEN {R('commissions * 0.30::DOUBLE / net_assets * 10000')} END AS soft_dollar_low_bps,
    CASE WHEN soft_dollar_usd IS NOT NULL THEN CASE WHEN net_assets > 0 THEN 'CALCULATED' END
      WHEN has_soft_dollar THEN CASE WHEN commissions IS NOT NULL AND net_assets > 0 THEN 'ESTIMATED' ELSE 'NOT_DISCLOSED' END END AS soft_dollar_tag,
    CASE WHEN has_holdings THEN {_spread_sql('turnover', 'low')} ELSE 0 END AS spread_low_bps,
    CASE WHEN has_holdings THEN {_spread_sql('turnover', 'high')} ELSE 0 END AS spread_high_bps,
    CASE WHEN NOT has_holdings THEN 'UNAVAILABLE' WHEN covered_weight >= 0.5 THEN 'ESTIMATED' END AS spread_tag,
    CASE WHEN has_holdings THEN CASE WHEN net_assets <> 0 THEN {_impact_sql('turnover', 0)} END ELSE 0 END AS impact_low_bps,
    CASE WHEN has_holdings THEN CASE WHEN net_assets <> 0 THEN {_impact_sql('turnover', 1)} END ELSE 0 END AS impact_high_bps,
    CASE WHEN NOT has_holdings THEN 'UNAVAILABLE' WHEN net_assets <> 0 THEN 'ESTIMATED' END AS impact_tag,
    CASE WHEN has_holdings THEN {R(_EXC + ' * 2')} END AS cash_low_bps, CASE WHEN has_holdings THEN {R(_EXC + ' * 6')} END AS cash_high_bps,
    CASE WHEN has_holdings THEN CASE WHEN {_EXC} > 0 THEN 'ESTIMATED' ELSE 'CALCULATED' END END AS cash_tag,
    CASE WHEN {_ETF} THEN 0 WHEN {_TAX['high']} > 0 THEN {_TAX['low']} END AS tax_low_bps,
    CASE WHEN {_ETF} THEN 0 WHEN {_TAX['high']} > 0 THEN {_TAX['high']} END AS tax_high_bps,
    CASE WHEN {_ETF} THEN 'CALCULATED' WHEN {_TAX['high']} > 0 THEN 'ESTIMATED' END AS tax_tag
  FROM (SELECT f.*, c.*, d.* EXCLUDE (series_id), coalesce(d.has_h, false) AS has_holdings, k.has_c AS has_census,
      coalesce(nullif(nport_net_assets, 0), average_net_assets) AS net_assets,
      coalesce(prospectus_turnover, ncen_turnover, 30) / 100.0::DOUBLE AS turnover, er_bps
    FROM (SELECT DISTINCT series_id, period FROM v_holding) c
    JOIN (SELECT series_id AS sid, ticker, fund_name, family, category, prospectus_turnover FROM v_fund) f ON sid = c.series_id
    LEFT JOIN (SELECT *, true AS has_h FROM v_facts) d ON d.series_id = c.series_id AND d.period = c.period
    LEFT JOIN (SELECT series_id AS s2, period AS p2, commissions, has_soft_dollar, soft_dollar_usd, ncen_turnover, average_net_assets FROM v_ncen WHERE has_census) n ON s2 = c.series_id AND p2 = c.period
    LEFT JOIN (SELECT series_id AS s3, er_bps FROM v_stated) e ON s3 = c.series_id
    LEFT JOIN LATERAL (SELECT s2 IS NOT NULL AS has_c) k ON true) x)"""

COST_VIEWS = (V_NCEN, V_HOLDING, H, V_FACTS, V_FEE, V_STATED, V_COST)
# the join above repeats key names; keep a clean copy
V_COST_CLEAN = V_COST.replace("SELECT f.*, c.*, d.* EXCLUDE (series_id),", "SELECT f.* EXCLUDE (sid), c.*, d.* EXCLUDE (series_id, period, has_h), n.* EXCLUDE (s2, p2),")
COST_VIEWS = (V_NCEN, V_HOLDING, H, V_FACTS, V_FEE, V_STATED, V_COST_CLEAN)
HOLD = (V_FUND, V_HOLDING, H)


# -- exposures -------------------------------------------------------------------


@query(with_views(*HOLD, body=f"""
SELECT series_id, period, asset_category, {R("100.0::DOUBLE * CAST(sum(value_usd) AS DOUBLE) / max(net_assets)", 4)} AS weight_pct, 'CALCULATED' AS tag
FROM v_holding JOIN v_header USING (series_id, period) GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT series_id, period, NULL, NULL, 'UNAVAILABLE' FROM v_holding JOIN v_fund USING (series_id) WHERE NOT has_nport"""))
def asset_class_weights(v):
    w = holdings.asset_class_weights(v.holding(), v.fund())
    return w.withColumn("weight_pct", rnd("weight_pct", 4))


@query(with_views(*HOLD, body=f"""
SELECT series_id, period, asset_category, {R("CAST(sum(CAST(100.0::DOUBLE * CAST(value_usd AS DOUBLE) / net_assets AS DECIMAL(28,8))) AS DOUBLE)", 3)} AS weight_pct
FROM v_holding JOIN v_header USING (series_id, period) GROUP BY 1, 2, 3"""))
def asset_class_weights_reported(v):
    """The same from percents reported per position; equal values of a category are one row before the header joins."""
    rows = settle(v.holding().groupBy(*KEYS, "asset_category", "value_usd").agg(F.count("*").alias("n")))
    nav = rows.groupBy(*KEYS).agg(dbl(F.sum(F.col("value_usd") * F.col("n"))).alias("_sum")).join(
        v.fund().filter("has_nport").select("series_id", "nav_factor"), "series_id").select(
        *KEYS, (F.col("_sum") * F.col("nav_factor")).alias("net_assets"))
    share = (100.0 * dbl("value_usd") / F.col("net_assets")).cast("decimal(18,8)") * F.col("n").cast("decimal(12,0)")
    return holdings.asset_class_weights(rows.join(nav, list(KEYS)).withColumn("pct_of_net_assets", share)).withColumn(
        "weight_pct", rnd("weight_pct", 3))


@query(with_views(*HOLD, V_FACTS, body=f"""
SELECT series_id, period, n_holdings, {R('bond_pct', 4)} AS bond_pct, {R('small_cap_pct', 4)} AS small_cap_pct, {R('covered_weight', 6)} AS covered_weight FROM (SELECT DISTINCT series_id, period FROM v_holding) k LEFT JOIN v_facts USING (series_id, period)"""))
def bond_and_small_cap_share(v):
    return _facts(v).select(*KEYS, "n_holdings", rnd("bond_pct", 4).alias("bond_pct"),
                            rnd("small_cap_pct", 4).alias("small_cap_pct"), rnd("covered_weight", 6).alias("covered_weight"))


@query(with_views(*HOLD, V_FACTS, body=f"""
SELECT series_id, period, CASE WHEN nport_net_assets IS NOT NULL THEN {R(_CASHPCT, 4)} END AS cash_pct, CASE WHEN nport_net_assets IS NOT NULL THEN {R(_EXC, 4)} END AS excess_cash_pct, CASE WHEN nport_net_assets IS NOT NULL THEN {R(_EXC + ' * 2')} END AS drag_low_bps, CASE WHEN nport_net_assets IS NOT NULL THEN {R(_EXC + ' * 6')} END AS drag_high_bps,
  CASE WHEN nport_net_assets IS NOT NULL THEN {_EXC} > 0 AND {_CASHPCT} > 5 END AS is_flagged, CASE WHEN nport_net_assets IS NULL THEN 'UNAVAILABLE' WHEN {_EXC} > 0 THEN 'ESTIMATED' ELSE 'CALCULATED' END AS tag FROM (SELECT DISTINCT series_id, period FROM v_holding) k LEFT JOIN v_facts USING (series_id, period)"""))
def cash_drag(v):
    d = costs.cash_drag(F.col("cash_usd"), F.col("nport_net_assets"))
    held = F.col("has_holdings")
    return _facts(v).select(*KEYS, *[F.when(held, c).alias(n) for n, c in (
        ("cash_pct", rnd(d["cash_pct"], 4)), ("excess_cash_pct", rnd(d["excess"], 4)), ("drag_low_bps", d["low"]),
        ("drag_high_bps", d["high"]), ("is_flagged", d["flagged"]))],
        F.when(held, d["tag"]).otherwise(UNAVAILABLE).alias("tag"))


_COUNTRY = "CASE WHEN upper(trim(coalesce(country, 'UNKNOWN'))) = '' THEN 'UNKNOWN' ELSE upper(trim(coalesce(country, 'UNKNOWN'))) END"
V_EXPO = f"""
v_expo AS (SELECT series_id, period, {_COUNTRY} AS country,
    100.0::DOUBLE * CAST(sum(value_usd) AS DOUBLE) / max(net_assets) AS net_pct,
    100.0::DOUBLE * CAST(sum(CASE WHEN value_usd >= 0 THEN value_usd END) AS DOUBLE) / max(net_assets) AS gross_long_pct,
    100.0::DOUBLE * CAST(sum(abs(value_usd)) AS DOUBLE) / max(net_assets) AS gross_absolute_pct, 'CALCULATED' AS tag
  FROM v_holding JOIN v_header USING (series_id, period) GROUP BY 1, 2, 3
  UNION ALL SELECT DISTINCT series_id, period, NULL, NULL, NULL, NULL, 'UNAVAILABLE' FROM v_holding JOIN v_fund USING (series_id) WHERE NOT has_nport)"""


def _exposure(v):
    return holdings.country_exposure(v.holding(country=True), v.fund())


@query(with_views(*HOLD, V_EXPO, body=f"SELECT series_id, period, country, {R('net_pct', 4)} AS net_pct, {R('gross_long_pct', 4)} AS gross_long_pct, {R('gross_absolute_pct', 4)} AS gross_absolute_pct, tag FROM v_expo"))
def country_exposure(v):
    return _exposure(v).select(*KEYS, "country", *[rnd(c, 4).alias(c) for c in ("net_pct", "gross_long_pct", "gross_absolute_pct")], "tag")


@query(with_views(*HOLD, V_EXPO, body=f"""
SELECT series_id, period, {R('CAST(sum(CAST(net_pct AS DECIMAL(28,10))) AS DOUBLE)', 4)} AS concentration_pct FROM (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY net_pct DESC, country) AS rk FROM v_expo) q
WHERE rk <= 3 GROUP BY 1, 2"""))
def country_concentration(v):
    return holdings.country_concentration(_exposure(v), 3)


@query(with_views(*HOLD, V_EXPO, body=f"""
SELECT series_id, period, CASE WHEN max(tag) = 'CALCULATED' THEN count(*) FILTER (country <> 'UNKNOWN') END AS distinct_countries, {R('max(net_pct) FILTER (rk = 1)', 4)} AS top_country_pct,
  {R('CAST(sum(CAST(net_pct AS DECIMAL(28,10))) FILTER (rk <= 5) AS DOUBLE)', 4)} AS top_5_countries_pct,
  CASE WHEN max(tag) = 'CALCULATED' THEN {R("100.0::DOUBLE - coalesce(CAST(sum(CAST(net_pct AS DECIMAL(28,10))) FILTER (country IN ('US', 'UNKNOWN')) AS DOUBLE), 0)", 4)} END AS non_us_excluding_unknown_pct,
  string_agg(rk || ':' || country, ',' ORDER BY rk) FILTER (rk <= 20) AS top_countries, max(tag) AS tag
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY net_pct DESC, country) AS rk FROM v_expo) q GROUP BY 1, 2"""))
def geography_summary(v):
    return holdings.geography_summary(_exposure(v))


_LABEL = _case({k: f"'{x}'" for k, x in A.DERIVATIVE_LABELS.items()}, "asset_category", "asset_category")


@query(with_views(*HOLD, body=f"""
SELECT h.series_id, h.period, count(asset_category) AS positions, coalesce(string_agg(DISTINCT {_LABEL}, '|' ORDER BY {_LABEL}), '') AS categories,
  coalesce(string_agg(DISTINCT instrument_type, '|' ORDER BY instrument_type), '') AS instrument_types,
  {R('coalesce(CAST(sum(notional_usd) AS DOUBLE), 0)')} AS notional_usd,
  CASE WHEN max(net_assets) > 0 THEN {R('coalesce(CAST(sum(notional_usd) AS DOUBLE), 0) / max(net_assets) * 100', 4)} END AS notional_pct_of_nav,
  {R('coalesce(CAST(sum(unrealized_usd) AS DOUBLE), 0)')} AS unrealized_usd,
  {', '.join(f"count(*) FILTER (asset_category = '{c}') AS n_{c.lower()}" for c in A.DERIVATIVE_LABELS)}, 'CALCULATED' AS tag
FROM v_header h LEFT JOIN (SELECT * FROM v_holding WHERE asset_category LIKE 'D%' AND asset_category <> 'DBT') d
  ON d.series_id = h.series_id AND d.period = h.period GROUP BY 1, 2
UNION ALL SELECT DISTINCT series_id, period, NULL, NULL, NULL, NULL, NULL, NULL, {', '.join('NULL' for c in A.DERIVATIVE_LABELS)}, 'UNAVAILABLE' FROM v_holding JOIN v_fund USING (series_id) WHERE NOT has_nport"""))
def derivative_summary(v):
    return holdings.derivative_summary(v.holding(), v.fund())


@query(with_views(V_HOLDING, body="""
SELECT * FROM (SELECT series_id, period, row_number() OVER (PARTITION BY series_id, period ORDER BY n DESC, counterparty_name) AS rank,
  counterparty_name, CAST(n AS DOUBLE) AS notional_usd
  FROM (SELECT series_id, period, counterparty_name, sum(notional_usd) AS n FROM v_holding
    WHERE asset_category LIKE 'D%' AND asset_category <> 'DBT' AND counterparty_name IS NOT NULL AND notional_usd <> 0 GROUP BY 1, 2, 3) a) b WHERE rank <= 10"""))
def top_counterparties(v):
    return holdings.top_counterparties(v.holding())


_FUNDISH = """(issuer_category IN ('RF', 'RIC')
  OR (regexp_matches(name, '(?i)\\b(trust|fund|portfolio|etf|index\\s+fund|money\\s+market)\\b')
      AND NOT (regexp_matches(name, '(?i)(asset[\\s-]?backed|mortgage|remic|securitiz|receivable|pass[\\s-]?thr(ough|u)?|collateralized|\\bcdo\\b|\\bclo\\b|home\\s+equity|student\\s+loan|auto\\s+(loan|lease|owner)|\\bmtge?\\b|\\bcmbs\\b|\\brmbs\\b|\\babs\\b)') OR asset_category LIKE 'ABS%'))
  OR coalesce(asset_category = 'STIV' AND 100.0::DOUBLE * CAST(value_usd AS DOUBLE) / net_assets > 5, false))"""


@query(with_views(*HOLD, body=f"""
SELECT series_id, period, {_FUNDISH} AS is_fund, count(*) AS positions, CAST(sum(value_usd) AS DOUBLE) AS value_usd
FROM v_holding JOIN v_header USING (series_id, period) GROUP BY 1, 2, 3"""))
def fund_and_direct_holdings(v):
    return holdings.fund_and_direct(holdings.position_kinds(v.holding()), v.fund())


# -- structure --------------------------------------------------------------------

V_FUNDPOS = f"""
v_fundpos AS (SELECT v_holding.*, net_assets, CASE WHEN issuer_category = 'RF' AND NOT contains(name, 'plate') THEN partkey % (SELECT count(*) FROM supplier) END AS child
  FROM v_holding JOIN v_header USING (series_id, period) WHERE {_FUNDISH}),
v_class AS (SELECT h.series_id, h.period, coalesce(fp, 0) AS fund_positions, {R('coalesce(100.0::DOUBLE * fv / h.net_assets, 0)', 4)} AS fund_pct
  FROM v_header h LEFT JOIN (SELECT series_id, period, count(*) AS fp, CAST(sum(value_usd) AS DOUBLE) AS fv FROM v_fundpos GROUP BY 1, 2) p USING (series_id, period)),
v_edge AS (SELECT s.series_id AS parent, s.period, child, positions, CAST(CAST(val AS DOUBLE) / CAST(tot AS DOUBLE) AS DECIMAL(28,12)) AS weight
  FROM (SELECT series_id, period, child, count(*) AS positions, sum(value_usd) AS val FROM v_fundpos WHERE child IS NOT NULL AND value_usd > 0 GROUP BY 1, 2, 3) s
  JOIN (SELECT series_id, period, sum(value_usd) AS tot FROM v_fundpos GROUP BY 1, 2) t USING (series_id, period)
  JOIN v_class c USING (series_id, period) WHERE tot > 0 AND fund_pct > 25)"""


def _kinds(v, *names: str):
    """Kinds of positions and the header, with the child that a position resolves to."""
    resolved = (F.col("issuer_category") == "RF") & ~F.col("name").contains("plate")
    child = F.when(resolved, F.col("partkey") % F.lit(v.n_funds))
    kinds = holdings.position_kinds(v.holding(), {"child": child} | {n: F.col(n) for n in names})
    return kinds, holdings.header_of_kinds(kinds, v.fund())


def _fund_sums(v):
    kinds, header = _kinds(v)
    return structure.fund_position_sums(kinds, header), header


def _edges(v):
    """Edges below funds that are funds-of-funds; kept, because every level joins them again."""
    return settle(structure.edges(*_fund_sums(v)))


def _settled_cost(v):
    return settle(_cost(v))


def _direct(cost):
    return costs.with_totals(cost).select(*KEYS, F.col("total_reported_bps").alias("direct_bps"))


STRUCT = (*HOLD, V_FUNDPOS)


@query(with_views(*STRUCT, body="""
SELECT *, CASE WHEN fund_pct > 25 THEN 'fund_of_funds' WHEN fund_pct > 0.5 THEN 'cash_sweep' ELSE 'plain' END AS structure FROM v_class"""))
def structure_class(v):
    sums, header = _fund_sums(v)
    return structure.structure_class(header, sums)


@query(with_views(*STRUCT, body=f"SELECT parent, period, child, positions, CAST(round(weight, 8) AS DOUBLE) AS weight FROM v_edge"))
def fund_of_funds_edges(v):
    return _edges(v).withColumn("weight", dbl(F.round("weight", 8)))


V_MEMBER = """
v_member AS (
  SELECT series_id AS root, period, series_id AS member, CAST(1 AS DECIMAL(28,12)) AS weight, 1 AS paths, 0 AS depth FROM (SELECT DISTINCT parent AS series_id, period FROM v_edge) r
  UNION ALL SELECT parent, period, child, weight, positions, 1 FROM v_edge
  UNION ALL SELECT a.parent, a.period, b.child, sum(CAST(CAST(a.weight AS DOUBLE) * CAST(b.weight AS DOUBLE) AS DECIMAL(28,12))), sum(a.positions * b.positions), 2
    FROM v_edge a JOIN v_edge b ON b.parent = a.child AND b.period = a.period GROUP BY 1, 2, 3)"""


def _members(v):
    e = _edges(v)
    roots = e.select(F.col("parent").alias("series_id"), "period").distinct()
    return structure.members(roots, e), e


@query(with_views(*STRUCT, V_MEMBER, body=f"SELECT root, period, member, depth, paths, CAST(round(weight, 7) AS DOUBLE) AS weight FROM v_member"))
def fund_tree_members(v):
    m, _ = _members(v)
    return m.select("root", "period", "member", "depth", "paths", dbl(F.round("weight", 7)).alias("weight"))


@query(with_views(*STRUCT, V_MEMBER, body="""
SELECT root, period, count(*) AS leaves, sum(paths) AS leaf_paths FROM v_member
WHERE depth = 2 OR NOT EXISTS (SELECT 1 FROM v_edge e WHERE e.parent = member AND e.period = v_member.period) GROUP BY 1, 2"""))
def leaf_funds(v):
    m, e = _members(v)
    return structure.leaves(m, e).groupBy("root", "period").agg(F.count("*").alias("leaves"), F.sum("paths").alias("leaf_paths"))


V_DIRECT = """
v_direct AS (SELECT series_id, period, CASE WHEN er_bps IS NULL AND brokerage_bps IS NULL THEN NULL ELSE coalesce(er_bps, 0) + coalesce(brokerage_bps, 0) END AS direct_bps FROM v_cost)"""


def _level_sql(name: str, below: str, col: str) -> str:
    return f"""
{name} AS (SELECT d.series_id, d.period, direct_bps, underlying_bps, covered_weight, contributors, missing,
    CASE WHEN direct_bps IS NULL AND underlying_bps IS NULL THEN NULL ELSE coalesce(direct_bps, 0) + coalesce(underlying_bps, 0) END AS total_bps
  FROM v_direct d LEFT JOIN (SELECT parent AS series_id, e.period, CAST(sum(CAST(CAST(weight AS DOUBLE) * b.{col} AS DECIMAL(28,12))) AS DOUBLE) AS underlying_bps,
      CAST(sum(CASE WHEN b.{col} IS NOT NULL THEN weight END) AS DOUBLE) AS covered_weight,
      sum(CASE WHEN b.{col} IS NOT NULL THEN positions END) AS contributors, sum(CASE WHEN b.{col} IS NULL THEN positions END) AS missing
    FROM v_edge e LEFT JOIN {below} b ON b.series_id = e.child AND b.period = e.period GROUP BY 1, 2) u USING (series_id, period))"""


V_ROLL = (V_DIRECT, _level_sql("v_one", "v_direct", "direct_bps"), _level_sql("v_roll", "v_one", "total_bps"))
ROLL = (*COST_VIEWS, V_FUNDPOS, *V_ROLL)


@query(with_views(*ROLL, body=f"""
SELECT series_id, period, {R('direct_bps', 4)} AS direct_bps, {R('underlying_bps', 4)} AS underlying_bps, {R('covered_weight', 6)} AS covered_weight,
  contributors, missing, {R('total_bps', 4)} AS total_bps FROM v_roll"""))
def fund_of_funds_rollup(v):
    out = structure.roll_up(_direct(_settled_cost(v)), _edges(v))
    return out.select(*KEYS, rnd("direct_bps", 4).alias("direct_bps"), rnd("underlying_bps", 4).alias("underlying_bps"),
                      rnd("covered_weight", 6).alias("covered_weight"), "contributors", "missing", rnd("total_bps", 4).alias("total_bps"))


_ADDS = R("CAST(weight AS DOUBLE) * direct_bps", 6)


@query(with_views(*COST_VIEWS, V_FUNDPOS, V_DIRECT, body=f"""
SELECT parent, period, rank, child, weight, child_bps, {R('adds', 4)} AS adds_bps FROM (
  SELECT parent, e.period, child, {R('CAST(weight AS DOUBLE)', 6)} AS weight, {R('direct_bps', 4)} AS child_bps, {_ADDS} AS adds,
    row_number() OVER (PARTITION BY parent, e.period ORDER BY {_ADDS} DESC, child) AS rank
  FROM v_edge e JOIN v_direct d ON d.series_id = e.child AND d.period = e.period WHERE direct_bps IS NOT NULL) q WHERE rank <= 5"""))
def top_contributors(v):
    return structure.top_contributors(_edges(v), _direct(_cost(v)).withColumnRenamed("direct_bps", "total_bps"))


@query(with_views(*HOLD, V_FUNDPOS, V_FEE, V_STATED, body=f"""
SELECT series_id, period, underlying_positions, er_bps AS stated_er_bps, {R('wsum / cov')} AS weighted_underlying_bps, {R('coalesce(cov, 0)', 6)} AS covered_weight,
  {R('coalesce(cov, 0)', 6)} >= 0.9 AS coverage_ok, 'high' AS confidence, {R(f"er_bps - {R('wsum / cov')}")} AS wrapper_bps,
  {R('coalesce(cov, 0)', 6)} >= 0.9 AND er_bps IS NOT NULL AND cov IS NOT NULL AS publishable
FROM (SELECT parent AS series_id, period, sum(positions) AS underlying_positions, CAST(sum(CASE WHEN s.er_bps IS NOT NULL THEN weight END) AS DOUBLE) AS cov,
    CAST(sum(CAST(CAST(weight AS DOUBLE) * s.er_bps AS DECIMAL(28,12))) AS DOUBLE) AS wsum
  FROM v_edge LEFT JOIN v_stated s ON s.series_id = child GROUP BY 1, 2) a LEFT JOIN v_stated USING (series_id)"""))
def wrapper_decomposition(v):
    return structure.wrapper_decomposition(_stated(v), _edges(v))


@query(with_views(*STRUCT, body=f"""
SELECT series_id, period, name, cusip, 'FND' || child AS resolved_ticker, {R('100.0::DOUBLE * CAST(sum(value_usd) AS DOUBLE) / max(net_assets)', 4)} AS pct_of_net_assets
FROM v_fundpos WHERE value_usd > 0 GROUP BY 1, 2, 3, 4, child"""))
def underlying_funds(v):
    return structure.underlying_list(*_kinds(v, "name", "cusip"), v.fund())


@query(with_views(*STRUCT, body="""
SELECT series_id, period, name, cusip, count(*) AS positions, CAST(sum(value_usd) AS DOUBLE) AS value_usd, 'Unresolved underlying fund: ' || name || ' (' || cusip || ')' AS note
FROM v_fundpos WHERE child IS NULL AND value_usd > 0 GROUP BY 1, 2, 3, 4"""))
def unresolved_underlying_notes(v):
    return structure.unresolved_notes(*_kinds(v, "name", "cusip"))


# -- cost model ---------------------------------------------------------------------

_COSTCOLS = "series_id, period, ticker, turnover, net_assets, er_bps, brokerage_bps, brokerage_tag, soft_dollar_bps, soft_dollar_low_bps, soft_dollar_tag, spread_low_bps, spread_high_bps, spread_tag, impact_low_bps, impact_high_bps, impact_tag, cash_low_bps, cash_high_bps, cash_tag, tax_low_bps, tax_high_bps, tax_tag"


@query(with_views(*COST_VIEWS, body=f"SELECT {_COSTCOLS.replace('net_assets,', R('net_assets') + ' AS net_assets,')} FROM v_cost"))
def fund_cost(v):
    return _cost(v).select(*KEYS, *[rnd("net_assets").alias("net_assets") if c == "net_assets" else F.col(c) for c in costs.COST_COLUMNS])


_TOT = """CASE WHEN er_bps IS NULL AND brokerage_bps IS NULL THEN NULL ELSE coalesce(er_bps, 0) + coalesce(brokerage_bps, 0) END"""


@query(with_views(*COST_VIEWS, body=f"""
SELECT series_id, period, {R('r', 4)} AS total_reported_bps, {R('r + lo', 4)} AS total_low_bps, {R('r + hi', 4)} AS total_high_bps,
  {R('r + lo - er_bps', 4)} AS gap_low_bps, {R('r + hi - er_bps', 4)} AS gap_high_bps
FROM (SELECT *, {_TOT} AS r, coalesce(spread_low_bps, 0) + coalesce(impact_low_bps, 0) AS lo, coalesce(spread_high_bps, 0) + coalesce(impact_high_bps, 0) AS hi FROM v_cost) q"""))
def cost_totals(v):
    t = costs.with_totals(_cost(v))
    return t.select(*KEYS, *[rnd(c, 4).alias(c) for c in ("total_reported_bps", "total_low_bps", "total_high_bps", "gap_low_bps", "gap_high_bps")])


_HID = lambda s: f"CASE WHEN brokerage_bps IS NULL AND (spread_tag = 'UNAVAILABLE' OR spread_{s}_bps IS NULL) AND (impact_tag = 'UNAVAILABLE' OR impact_{s}_bps IS NULL) THEN NULL ELSE coalesce(brokerage_bps, 0) + CASE WHEN spread_tag = 'UNAVAILABLE' THEN 0 ELSE coalesce(spread_{s}_bps, 0) END + CASE WHEN impact_tag = 'UNAVAILABLE' THEN 0 ELSE coalesce(impact_{s}_bps, 0) END END"
_RH = "CASE WHEN brokerage_bps IS NULL AND NOT coalesce(soft_dollar_tag = 'CALCULATED', false) THEN NULL ELSE coalesce(brokerage_bps, 0) + CASE WHEN soft_dollar_tag = 'CALCULATED' THEN coalesce(soft_dollar_bps, 0) ELSE 0 END END"


@query(with_views(*COST_VIEWS, body=f"""
SELECT series_id, period, {R(_HID('low'), 4)} AS hidden_low_bps, {R(_HID('high'), 4)} AS hidden_high_bps, {R(_RH, 4)} AS reported_hidden_bps FROM v_cost"""))
def hidden_totals(v):
    return _cost(v).select(
        *KEYS, rnd(costs.hidden_total("low"), 4).alias("hidden_low_bps"), rnd(costs.hidden_total("high"), 4).alias("hidden_high_bps"),
        rnd(costs.reported_hidden(), 4).alias("reported_hidden_bps"),
    )


V_COMP = """
v_comp AS (
  SELECT series_id, period, ticker, er_bps, 'Brokerage Commissions' AS component, brokerage_bps AS low_bps, brokerage_bps AS high_bps, CASE WHEN brokerage_bps IS NULL THEN 'unavailable' ELSE 'reported' END AS tag, 'all' AS applies_to FROM v_cost
  UNION ALL SELECT series_id, period, ticker, er_bps, 'Soft Dollar Cost', CASE soft_dollar_tag WHEN 'ESTIMATED' THEN coalesce(soft_dollar_low_bps, 0) WHEN 'CALCULATED' THEN soft_dollar_bps END,
    CASE WHEN soft_dollar_tag <> 'NOT_DISCLOSED' THEN soft_dollar_bps END, CASE soft_dollar_tag WHEN 'ESTIMATED' THEN 'estimated' WHEN 'CALCULATED' THEN 'reported' ELSE 'warning' END, 'all' FROM v_cost WHERE soft_dollar_tag IS NOT NULL
  UNION ALL SELECT series_id, period, ticker, er_bps, 'Bid-Ask Spread Cost', spread_low_bps, spread_high_bps, 'estimated', 'all' FROM v_cost WHERE spread_tag <> 'UNAVAILABLE'
  UNION ALL SELECT series_id, period, ticker, er_bps, 'Market Impact Cost', impact_low_bps, impact_high_bps, 'estimated', 'all' FROM v_cost WHERE impact_tag <> 'UNAVAILABLE'
  UNION ALL SELECT series_id, period, ticker, er_bps, 'Cash Drag', cash_low_bps, cash_high_bps, 'estimated', 'all' FROM v_cost WHERE cash_high_bps > 0
  UNION ALL SELECT series_id, period, ticker, er_bps, 'Tax Drag', tax_low_bps, tax_high_bps, 'estimated', 'taxable_only' FROM v_cost WHERE tax_high_bps > 0)"""


@query(with_views(*COST_VIEWS, V_COMP, body="SELECT * FROM v_comp"))
def cost_components(v):
    return costs.cost_components(_cost(v))


_SUMC = lambda s, w: f"coalesce(CAST(sum(CASE WHEN tag <> 'warning' AND applies_to = '{w}' THEN CAST(coalesce({s}, 0) AS DECIMAL(18,4)) END) AS DOUBLE), 0)"


@query(with_views(*COST_VIEWS, V_COMP, body=f"""
SELECT *, {R('er_bps + hidden_low')} AS true_low_bps, {R('er_bps + hidden_high')} AS true_high_bps,
  {R('er_bps + hidden_low + tax_low')} AS taxable_low_bps, {R('er_bps + hidden_high + tax_high')} AS taxable_high_bps
FROM (SELECT series_id, period, ticker, er_bps, {_SUMC('low_bps', 'all')} AS hidden_low, {_SUMC('high_bps', 'all')} AS hidden_high,
  {_SUMC('low_bps', 'taxable_only')} AS tax_low, {_SUMC('high_bps', 'taxable_only')} AS tax_high FROM v_comp GROUP BY 1, 2, 3, 4) q"""))
def account_totals(v):
    return costs.account_totals(costs.cost_components(_cost(v)))


_CATKEY = "CASE WHEN bond_pct >= 50 THEN 'bond' WHEN small_cap_pct >= 50 THEN 'small' ELSE 'large' END || CASE WHEN turnover > CASE WHEN bond_pct >= 50 THEN 1.0 ELSE 0.5 END THEN '_high' ELSE '_low' END"


@query(with_views(*COST_VIEWS, body=f"""
SELECT series_id, period, k AS category, {R(f"turnover * ({_case({k: x[0] for k, x in A.IMPACT.items()}, 'k', 'NULL')})::DOUBLE * 10000")} AS low_bps,
  {R(f"turnover * ({_case({k: x[1] for k, x in A.IMPACT.items()}, 'k', 'NULL')})::DOUBLE * 10000")} AS high_bps
FROM (SELECT *, {_CATKEY} AS k FROM v_cost WHERE has_holdings) q"""))
def impact_by_category(v):
    k, low, high = costs.impact_by_category(F.col("turnover"), F.col("small_cap_pct") >= 50, F.col("bond_pct") >= 50)
    return _cost(v).filter("has_holdings").select(*KEYS, k.alias("category"), low.alias("low_bps"), high.alias("high_bps"))


_T2 = _tax_sql("t", "eq")


@query(with_views(V_FUND, V_FEE, body=f"""
SELECT class_id, accession_no, {_T2['short']} AS short_bps, {_T2['long']} AS long_bps, inc AS income_bps,
  {R(f"({_T2['short']} + {_T2['long']} + inc) * 0.7::DOUBLE", 1)} AS low_bps, {R(f"({_T2['short']} + {_T2['long']} + inc) * 1.3::DOUBLE", 1)} AS high_bps
FROM (SELECT class_id, accession_no, CASE WHEN form_type = '485APOS' THEN portfolio_turnover / 100 * 0.3::DOUBLE ELSE portfolio_turnover / 100 END AS t, category <> 'ASIA' AS eq,
    CASE WHEN category <> 'ASIA' THEN {R('max_sales_load / 100 * (0.7::DOUBLE * 0.288::DOUBLE + (1 - 0.7::DOUBLE) * 0.458::DOUBLE) * 10000', 1)} ELSE 183.2::DOUBLE END AS inc
  FROM v_fee JOIN v_fund USING (series_id) WHERE portfolio_turnover IS NOT NULL) q"""))
def tax_drag_options(v):
    """Tax drag with its options: tax-managed funds and a dividend yield."""
    rows = v.fee_snapshot().filter(F.col("portfolio_turnover").isNotNull()).join(v.fund().select("series_id", "category"), "series_id")
    d = costs.tax_drag(F.col("portfolio_turnover") / 100, F.col("category") != "ASIA", F.col("max_sales_load"),
                       F.col("form_type") == "485APOS")
    return rows.select("class_id", "accession_no", d["short"].alias("short_bps"), d["long"].alias("long_bps"),
                       d["income"].alias("income_bps"), d["low"].alias("low_bps"), d["high"].alias("high_bps"))


@query(with_views(*COST_VIEWS, body="""
SELECT series_id, period, CASE WHEN er_bps IS NULL THEN 'no_expense_ratio' WHEN (tax_low_bps + tax_high_bps) / 2 > er_bps THEN 'exceeds_er'
  WHEN (tax_low_bps + tax_high_bps) / 2 > er_bps * 0.5::DOUBLE THEN 'adds_to_er' ELSE 'minor' END AS tax_class FROM v_cost"""))
def tax_vs_expense_ratio(v):
    return _cost(v).select(*KEYS, costs.tax_vs_expense(F.col("tax_low_bps"), F.col("tax_high_bps"), F.col("er_bps")).alias("tax_class"))


@query(with_views(V_FEE, body=f"""
SELECT class_id, accession_no, component, pct, {R('pct * 100')} AS bps FROM (
  SELECT class_id, accession_no, 'Management Fee' AS component, management_fee AS pct FROM v_fee UNION ALL SELECT class_id, accession_no, '12b-1 Fee', twelve_b1_fee FROM v_fee
  UNION ALL SELECT class_id, accession_no, 'Other Expenses', other_expenses FROM v_fee UNION ALL SELECT class_id, accession_no, 'Acquired Fund Fees', acquired_fund_fees FROM v_fee) q WHERE pct IS NOT NULL"""))
def fee_breakdown(v):
    return costs.fee_breakdown(v.fee_snapshot(), ("class_id", "accession_no"))


_POW = lambda drag: f"(100000::DOUBLE * pow(1.07::DOUBLE - ({drag}), 20))"
_FREE = "100000::DOUBLE * pow(1.07::DOUBLE, 20)"
_WHOLE = lambda x: f"nullif(CAST(round(CAST({x} AS DECIMAL(28,6)), 0) AS BIGINT), 0)"
_DER, _DLO, _DHI = "er_bps / 100 / 100", "er_bps / 100 / 100 + lo / 10000", "er_bps / 100 / 100 + hi / 10000"


@query(with_views(*COST_VIEWS, body=f"""
SELECT series_id, period, {_WHOLE(f'{_FREE} - {_POW(_DER)}')} AS er_only_cost, {_WHOLE(f'{_FREE} - {_POW(_DLO)}')} AS true_cost_low,
  {_WHOLE(f'{_FREE} - {_POW(_DHI)}')} AS true_cost_high, {_WHOLE(f'{_POW(_DER)} - {_POW(_DLO)}')} AS hidden_cost_low,
  {_WHOLE(f'{_POW(_DER)} - {_POW(_DHI)}')} AS hidden_cost_high, {_WHOLE(_POW(_DER))} AS final_er_only, {_WHOLE(_POW(_DLO))} AS final_true_low, {_WHOLE(_POW(_DHI))} AS final_true_high
FROM (SELECT *, {_HID('low')} AS lo, {_HID('high')} AS hi FROM v_cost) q"""))
def dollar_impact(v):
    d = costs.dollar_impact(F.col("er_bps") / 100, costs.hidden_total("low"), costs.hidden_total("high"))
    return _cost(v).select(*KEYS, *[c.alias(n) for n, c in d.items()])


_RT = lambda s: R(f"coalesce(brokerage_bps, 0) + coalesce(spread_{s}_bps, 0) + coalesce(impact_{s}_bps, 0)")
_GRADE = lambda m: f"CASE WHEN {m} < 10 THEN 'A' WHEN {m} < 25 THEN 'B' WHEN {m} < 50 THEN 'C' WHEN {m} < 100 THEN 'D' WHEN {m} IS NOT NULL THEN 'F' END"


@query(with_views(*COST_VIEWS, body=f"""
SELECT series_id, period, ticker, fund_name, family, {R('net_assets')} AS net_assets, coalesce(n_holdings, 0) AS holdings_count, brokerage_bps,
  coalesce(soft_dollar_tag = 'NOT_DISCLOSED', false) AS soft_dollar_active, spread_low_bps, spread_high_bps, impact_low_bps, impact_high_bps,
  {_RT('low')} AS total_low_bps, {_RT('high')} AS total_high_bps, {_GRADE(f"(({_RT('low')} + {_RT('high')}) / 2)")} AS grade FROM v_cost"""))
def report_extract(v):
    return costs.report_extract(_cost(v)).withColumn("net_assets", rnd("net_assets"))


@query(with_views(*HOLD, body="""
SELECT series_id, period, CASE WHEN net_assets >= 1e12 THEN format('${:.1f}T', net_assets / 1e12) WHEN net_assets >= 1e9 THEN format('${:.1f}B', net_assets / 1e9)
  WHEN net_assets >= 1e6 THEN format('${:.1f}M', net_assets / 1e6) ELSE '$' || format('{:,}', CAST(round(net_assets) AS BIGINT)) END AS net_assets_display FROM v_header"""))
def net_assets_display(v):
    h = v.holding()
    return _header(v, h).select(*KEYS, dollars(F.col("net_assets")).alias("net_assets_display"))


# -- ranking ---------------------------------------------------------------------

V_LEDGER = f"""
v_ledger AS (SELECT series_id, period, ticker, er_bps AS stated_bps, {R(_RH, 4)} AS reported_hidden_bps, {R(f"({_TOT}) + coalesce(spread_low_bps, 0) + coalesce(impact_low_bps, 0) - er_bps", 4)} AS gap_bps FROM v_cost)"""


@query(with_views(*COST_VIEWS, V_LEDGER, body="""
SELECT *, row_number() OVER (ORDER BY reported_hidden_bps IS NULL, coalesce(reported_hidden_bps, 0) DESC, coalesce(gap_bps, 0) DESC, ticker, period) AS no FROM v_ledger"""))
def ledger_ranking(v):
    t = costs.with_totals(_cost(v)).select(
        *KEYS, "ticker", F.col("er_bps").alias("stated_bps"), rnd(costs.reported_hidden(), 4).alias("reported_hidden_bps"),
        rnd("gap_low_bps", 4).alias("gap_bps"),
    )
    return ranking.ledger(t)


_HM = "(hidden_low_bps + hidden_high_bps) / 2"
_ST = lambda x, n: f"CASE WHEN {x} <> 0 THEN {R(x, n)} END"
V_BOARD = f"""
v_board AS (SELECT ticker, lookup_count, {R(_HM)} AS hidden_cost_mid_bps, {R('hidden_low_bps')} AS hidden_cost_low_bps, {R('hidden_high_bps')} AS hidden_cost_high_bps,
    {_ST('expense_ratio_bps', 2)} AS expense_ratio_bps, {_ST(f'(expense_ratio_bps + {_HM})', 2)} AS true_cost_mid_bps, {_ST('turnover_pct', 1)} AS turnover_pct,
    {_GRADE('(' + _HM + ')')} AS grade, CAST(ts AS DATE) AS last_updated, {_ST('((dollar_low + dollar_high) / 2)', 2)} AS dollar_impact
  FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS lookup_count, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) AS rn
    FROM v_lookup WHERE hidden_low_bps IS NOT NULL AND hidden_high_bps IS NOT NULL) q WHERE rn = 1)"""


@query(with_views(V_LOOKUP, V_BOARD, body="SELECT * FROM v_board"))
def worst_cost_board(v):
    return ranking.board(v.lookup())


@query(with_views(V_LOOKUP, V_BOARD, body="SELECT * FROM v_board ORDER BY true_cost_mid_bps DESC NULLS LAST, ticker LIMIT 25"))
def board_query_true_cost(v):
    return ranking.board_query(ranking.board(v.lookup()), "true_cost_mid_bps", 25)


@query(with_views(V_LOOKUP, V_BOARD, body="SELECT * FROM v_board ORDER BY grade DESC, ticker LIMIT 25"))
def board_query_grade(v):
    return ranking.board_query(ranking.board(v.lookup()), "grade", 25)


@query(with_views(V_LOOKUP, V_BOARD, body="SELECT * FROM v_board ORDER BY lookup_count DESC, ticker LIMIT 25"))
def board_query_unknown_sort(v):
    """A field that is no sort field is taken as the number of lookups."""
    return ranking.board_query(ranking.board(v.lookup()), "ticker; DROP", 25)


@query(with_views(V_LOOKUP, V_BOARD, body="SELECT * FROM v_board"))
def board_capped(v):
    """The whole board: it has no cap, only its queries take the top."""
    return ranking.board(v.lookup())


@query(with_views(V_LOOKUP, V_BOARD, body=f"""
SELECT count(*) AS total_funds, CAST(sum(lookup_count) AS BIGINT) AS total_lookups, (SELECT ticker FROM v_board ORDER BY hidden_cost_mid_bps DESC, ticker DESC LIMIT 1) AS worst_ticker,
  max(hidden_cost_mid_bps) AS worst_hidden_bps, {R('CAST(sum(CAST(nullif(hidden_cost_mid_bps, 0) AS DECIMAL(28,4))) AS DOUBLE) / count(nullif(hidden_cost_mid_bps, 0))', 1)} AS avg_hidden_bps FROM v_board"""))
def board_stats(v):
    return ranking.board_stats(ranking.board(v.lookup()))


# -- conflicts -------------------------------------------------------------------


@query(with_views(V_NCEN, body=f"""
SELECT series_id, period, CASE WHEN commissions > 0 THEN {R('soft_dollar_usd / commissions * 100', 4)} END AS soft_dollar_share_pct,
  CASE WHEN NOT has_census THEN 'UNAVAILABLE' WHEN commissions > 0 AND soft_dollar_usd IS NOT NULL THEN 'CALCULATED' ELSE 'NOT_DISCLOSED' END AS tag FROM v_ncen"""))
def soft_dollar_share(v):
    return conflicts.soft_dollar_share(v.ncen())


_AFFC = "CAST(gross_commission AS DECIMAL(28,6))"


@query(with_views(V_BROKER, body=f"""
SELECT series_id, period, n AS affiliated_brokers, {R('a')} AS affiliated_usd, {R('CASE WHEN n = 0 THEN 0 WHEN t > 0 THEN a / t * 100 END', 4)} AS affiliated_pct
FROM (SELECT series_id, period, count(*) FILTER (is_affiliated) AS n, coalesce(CAST(sum({_AFFC}) FILTER (is_affiliated) AS DOUBLE), 0) AS a, CAST(sum({_AFFC}) AS DOUBLE) AS t FROM v_broker GROUP BY 1, 2) q"""))
def affiliated_concentration(v):
    return conflicts.affiliated_concentration(v.broker())


@query(with_views(V_BROKER, body=f"""
SELECT series_id, period, broker_name, is_affiliated, {R('gross_commission')} AS gross_commission FROM (SELECT *, row_number() OVER (PARTITION BY series_id, period, is_affiliated ORDER BY position, broker_name) AS rk FROM v_broker) q
WHERE is_affiliated OR rk <= 10"""))
def top_brokers(v):
    return conflicts.top_brokers(v.broker())


V_LINES = """
v_lines AS (SELECT l_suppkey AS filer, p_brand AS line, CAST(year(l_shipdate) AS INTEGER) AS year, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


@query(with_views(V_FUND, V_HOLDING, H, V_LINES, body=f"""
SELECT filer, {R('usd')} AS subsidy_usd, CASE WHEN net_assets > 0 THEN {R('usd / net_assets * 10000', 4)} END AS subsidy_bps, latest_year, years_used
FROM (SELECT filer, CAST(sum(CAST(m AS DECIMAL(28,8))) AS DOUBLE) AS usd, max(latest) AS latest_year, max(n) AS years_used
  FROM (SELECT filer, line, CAST(sum(amount) AS DOUBLE) / count(*) AS m, count(*) AS n, max(year) AS latest
    FROM (SELECT *, row_number() OVER (PARTITION BY filer, line ORDER BY year DESC) AS rk FROM v_lines) a WHERE rk <= 3 GROUP BY 1, 2) b GROUP BY 1) c
LEFT JOIN (SELECT series_id AS filer, net_assets FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS rk FROM v_header) z WHERE rk = 1) n USING (filer)"""))
def soft_dollar_subsidy(v):
    li, p = v.table("lineitem"), v.table("part")
    lines = (
        li.join(p, li.l_partkey == p.p_partkey)
        .groupBy(F.col("l_suppkey").alias("filer"), F.col("p_brand").alias("line"), F.year("l_shipdate").alias("year"))
        .agg(F.sum(money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("amount"))
    )
    nav = _header(v, v.holding()).groupBy(F.col("series_id").alias("filer")).agg(F.max_by("net_assets", "period").alias("net_assets"))
    return conflicts.soft_dollar_subsidy(lines, nav)


@query(with_views(V_FUND, body=f"""
SELECT *, CASE WHEN facility_size > 0 THEN {R('max_outstanding / facility_size', 6)} END AS utilisation FROM (
SELECT s_suppkey AS series_id, CASE WHEN s_acctbal > 0 THEN s_acctbal * 1000 ELSE 0 END AS facility_size, CAST(max(c_acctbal) AS DOUBLE) * 900 AS max_outstanding, count(c_custkey) AS co_borrowers
FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey GROUP BY 1, 2) q"""))
def credit_utilisation(v):
    return conflicts.credit_utilisation(_credit(v))


def _credit(v):
    s = v.table("supplier")
    c = (
        v.table("customer").groupBy(F.col("c_nationkey").alias("s_nationkey"))
        .agg((F.max("c_acctbal") * 900).alias("max_outstanding"), F.count("*").alias("co_borrowers"))
    )
    return s.join(c, "s_nationkey", "left").select(
        F.col("s_suppkey").alias("series_id"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 1000).otherwise(0.0).alias("facility_size"), "max_outstanding",
        F.coalesce("co_borrowers", F.lit(0)).alias("co_borrowers"),
    )


_FLAGS = "CASE WHEN has_soft_dollar THEN 'soft_dollar|' ELSE '' END || CASE WHEN affiliated_commissions > 0 THEN 'affiliated_broker|' ELSE '' END || CASE WHEN family < 'NATION_15' THEN 'affiliated_administrator|' ELSE '' END || CASE WHEN category = 'EUROPE' THEN 'affiliated_transfer_agent|' ELSE '' END || CASE WHEN gross > 400000 AND category = 'ASIA' THEN 'affiliated_lending_agent|' ELSE '' END || CASE WHEN gross > 400000 AND net > 0 THEN 'securities_lending_income|' ELSE '' END"


@query(with_views(V_NCEN, body=f"""
SELECT series_id, period, CASE WHEN has_census THEN rtrim(f, '|') END AS conflict_flags, CASE WHEN has_census THEN CAST(length(f) - length(replace(f, '|', '')) AS INTEGER) END AS conflict_count,
  CASE WHEN has_census THEN 'CALCULATED' ELSE 'UNAVAILABLE' END AS tag FROM (
SELECT series_id, period, has_census, {_FLAGS} AS f FROM (SELECT *, coalesce(average_net_assets, 0) AS gross, commissions - affiliated_commissions AS net FROM v_ncen) q) z"""))
def conflict_flags(v):
    lending = F.coalesce("average_net_assets", F.lit(0.0)) > 400000
    return conflicts.census_flags(v.ncen().select(
        *KEYS, "has_census", "has_soft_dollar", (F.col("affiliated_commissions") > 0).cast("int").alias("affiliated_brokers"),
        (F.col("family") < "NATION_15").alias("is_admin_affiliated"), (F.col("category") == "EUROPE").alias("is_transfer_agent_affiliated"),
        lending.alias("is_lending"), (F.col("category") == "ASIA").alias("is_lending_agent_affiliated"),
        (F.col("commissions") - F.col("affiliated_commissions")).alias("lending_net_income"),
    ))


@query(with_views(V_FUND, body=f"""
, v_serv AS (SELECT 'administrator' AS kind, family AS provider FROM v_fund UNION ALL SELECT 'custodian', category FROM v_fund)
SELECT kind, provider, n AS funds, {R('100.0::DOUBLE * n / t', 4)} AS share_pct, {R('CAST(sq AS DOUBLE) / t / t * 10000')} AS hhi
FROM (SELECT kind, provider, count(*) AS n FROM v_serv GROUP BY 1, 2) a JOIN (SELECT kind, CAST(sum(n) AS DOUBLE) AS t, sum(n * n) AS sq FROM (SELECT kind, provider, count(*) AS n FROM v_serv GROUP BY 1, 2) b GROUP BY 1) c USING (kind)"""))
def provider_concentration(v):
    f = v.fund()
    rows = f.select("series_id", F.inline(F.array(
        F.struct(F.lit("administrator").alias("kind"), F.col("family").alias("provider")),
        F.struct(F.lit("custodian").alias("kind"), F.col("category").alias("provider")),
    )))
    return conflicts.provider_concentration(rows)


_LATEST = lambda c, n, name: f"{R(f'arg_max_null({c}, period)', n)} AS {name}"
V_PEER = f"""
v_peer AS (SELECT series_id, category, {_LATEST('soft_dollar_bps', 2, 'soft_dollar_bps')}, {_LATEST('aff', 4, 'affiliated_pct')},
    {_LATEST('principal_pct', 4, 'principal_pct')}, {_LATEST('lending_agent_pct', 4, 'lending_agent_pct')}
  FROM (SELECT c.series_id, c.period, c.category, c.soft_dollar_bps, CASE WHEN commissions > 0 THEN affiliated_commissions / commissions * 100 END AS aff, principal_pct, lending_agent_pct
    FROM v_cost c LEFT JOIN v_ncen n ON n.series_id = c.series_id AND n.period = c.period) q GROUP BY 1, 2)"""


def _peer(v, cost=None):
    share = F.when(F.col("commissions") > 0, F.col("affiliated_commissions") / F.col("commissions") * 100)
    cost = _cost(v, carry=PEER_CENSUS) if cost is None else cost
    latest = lambda c, n, name: rnd(F.max_by(c, "period"), n).alias(name)
    return cost.groupBy("series_id", "category").agg(
        latest("soft_dollar_bps", 2, "soft_dollar_bps"), latest(share, 4, "affiliated_pct"),
        latest("principal_pct", 4, "principal_pct"), latest("lending_agent_pct", 4, "lending_agent_pct"))


PEER_CENSUS = ("commissions", "affiliated_commissions", "principal_pct", "lending_agent_pct")


@query(with_views(*COST_VIEWS, V_PEER, body=f"""
SELECT series_id, category, {R('m', 4)} AS median_soft, {R('s', 4)} AS sd_soft, {R('p', 4)} AS p90_affiliated, coalesce(soft_dollar_bps > m + s, false) AS soft_outlier, coalesce(affiliated_pct > p, false) AS affiliated_outlier
FROM v_peer LEFT JOIN (SELECT category, quantile_cont(soft_dollar_bps, 0.5) AS m, stddev_samp(soft_dollar_bps) AS s, quantile_cont(affiliated_pct, 0.9) AS p FROM v_peer GROUP BY 1) q USING (category)"""))
def peer_outliers(v):
    return ranking.peer_outliers(_peer(v))


#: Where each dimension's measure stands; governance and proxy voting have no data.
SCORE_SOURCE = {
    "soft_dollar_intensity": "soft_dollar_bps", "affiliated_routing": "affiliated_pct", "principal_transactions": "principal_pct",
    "lending_split": "lending_agent_pct", "credit_utilisation": "utilisation", "derivatives_complexity": "kinds",
    "provider_concentration": "provider_pct", "turnover_tax": "prospectus_turnover", "expense_ratio": "er_bps",
}
SCORE_DIMS = {k: A.SCORECARD_WEIGHTS[k] for k in SCORE_SOURCE}
_PCT = lambda c: (
    f"CASE WHEN {c} IS NOT NULL THEN coalesce(100.0::DOUBLE * (rank() OVER (PARTITION BY category, {c} IS NULL ORDER BY {c}) - 1)"
    f" / nullif(count({c}) OVER (PARTITION BY category) - 1, 0), 0) END")
_NUM = " + ".join(f"coalesce({d} * {w}::DOUBLE, 0)" for d, w in SCORE_DIMS.items())
_DEN = " + ".join(f"CASE WHEN {d} IS NULL THEN 0 ELSE {w} END" for d, w in SCORE_DIMS.items())
V_MEASURES = """
v_kinds AS (SELECT series_id, count(DISTINCT asset_category) FILTER (asset_category LIKE 'D%' AND asset_category <> 'DBT') AS kinds FROM v_holding GROUP BY 1),
v_credit AS (SELECT s_suppkey AS series_id, CASE WHEN s_acctbal > 0 THEN CAST(max(c_acctbal) AS DOUBLE) * 900 / (s_acctbal * 1000) END AS utilisation
  FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey GROUP BY s_suppkey, s_acctbal),
v_provider AS (SELECT family, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM v_fund) AS provider_pct FROM v_fund GROUP BY 1),
v_measures AS (SELECT * FROM v_peer JOIN (SELECT series_id, prospectus_turnover, family FROM v_fund) f USING (series_id) LEFT JOIN v_stated USING (series_id)
  LEFT JOIN v_kinds USING (series_id) LEFT JOIN v_credit USING (series_id) LEFT JOIN v_provider USING (family))"""


@query(with_views(*COST_VIEWS, V_PEER, V_MEASURES, body=f"""
SELECT category, series_id, score, row_number() OVER w AS rank, count(*) OVER (PARTITION BY category) AS n,
  CASE WHEN row_number() OVER w / (count(*) OVER (PARTITION BY category))::DOUBLE <= 0.10 THEN 'A' WHEN row_number() OVER w / (count(*) OVER (PARTITION BY category))::DOUBLE <= 0.35 THEN 'B'
    WHEN row_number() OVER w / (count(*) OVER (PARTITION BY category))::DOUBLE <= 0.70 THEN 'C' WHEN row_number() OVER w / (count(*) OVER (PARTITION BY category))::DOUBLE <= 0.90 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT category, series_id, {R(f'({_NUM}) / nullif(CAST({_DEN} AS DOUBLE), 0)', 4)} AS score FROM (
  SELECT series_id, category, {', '.join(f'{_PCT(c)} AS {d}' for d, c in SCORE_SOURCE.items())} FROM v_measures) a) b
WHERE score IS NOT NULL WINDOW w AS (PARTITION BY category ORDER BY score, series_id)"""))
def peer_scorecard(v):
    by_category = settle(_category_sums(v))
    kinds = by_category.filter(holdings.is_derivative(F.col("asset_category"))).groupBy("series_id").agg(
        F.countDistinct("asset_category").alias("kinds"))
    fund = v.fund().select("series_id", "prospectus_turnover", "family")
    n = v.n_funds
    provider = fund.groupBy("family").agg((100.0 * F.count("*") / F.lit(n)).alias("provider_pct"))
    measures = (
        _peer(v, _cost(v, by_category, PEER_CENSUS)).join(fund, "series_id").join(_stated(v), "series_id", "left")
        .join(kinds, "series_id", "left").fillna(0, ["kinds"])
        .join(_credit(v).select("series_id", F.when(F.col("facility_size") > 0, F.col("max_outstanding") / F.col("facility_size")).alias("utilisation")), "series_id", "left")
        .join(provider, "family", "left")
    )
    return ranking.scorecard(
        measures.select("series_id", "category", *[F.col(c).alias(d) for d, c in SCORE_SOURCE.items()]), SCORE_DIMS)


# -- fee history -------------------------------------------------------------------

V_LAG = "v_lag AS (SELECT *, " + ", ".join(
    f"lag({c}) OVER w AS p_{c}" for c in ("filing_date", *A.TRACKED_FEES)
) + " FROM v_fee WINDOW w AS (PARTITION BY class_id ORDER BY filing_date, accession_no))"
V_CHANGE = "v_change AS (" + " UNION ALL ".join(
    f"SELECT class_id, accession_no, p_filing_date AS old_filing_date, filing_date AS new_filing_date, '{f}' AS field_name, '{label}' AS field_label,"
    f" p_{f} AS old_value, {f} AS new_value, {R(f'({f} - p_{f}) * 100', 1)} AS change_bps, CASE WHEN {f} > p_{f} THEN 'increase' ELSE 'decrease' END AS direction"
    f" FROM v_lag WHERE abs({f} - p_{f}) > 0.001" for f, label in A.TRACKED_FEES.items()
) + ")"


@query(with_views(V_FEE, V_LAG, V_CHANGE, body="SELECT * FROM v_change"))
def fee_changes(v):
    return history.fee_changes(v.fee_snapshot())


@query(with_views(V_FEE, V_LAG, V_CHANGE, body="""
SELECT class_id, count(*) AS changes, CAST(sum(CAST(change_bps AS DECIMAL(18,1))) AS DOUBLE) AS net_change_bps, count(*) > 0 AS has_changes FROM v_change GROUP BY 1"""))
def fee_net_change(v):
    return history.net_change(history.fee_changes(v.fee_snapshot()))


@query(with_views(V_FEE, V_STATED, body=f"""
SELECT class_id, accession_no, filing_date, rank, total_annual_expenses, net_expenses, {R('coalesce(net_expenses, total_annual_expenses) * 100')} AS effective_er_bps
FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY filing_date DESC, accession_no DESC) AS rank FROM v_snap) q WHERE rank <= 5"""))
def fee_snapshot_selection(v):
    er = history.effective_expense_ratio(F.col("net_expenses"), F.col("total_annual_expenses"))
    return history.latest_snapshots(history.completed(v.fee_snapshot()), 5).select(
        "class_id", "accession_no", "filing_date", "rank", "total_annual_expenses", "net_expenses", rnd(er * 100).alias("effective_er_bps")
    )


@query(with_views(V_FEE, body=f"""
SELECT class_id, accession_no, {R('management_fee + twelve_b1_fee + other_expenses')} AS total_from_table,
  {R('management_fee + coalesce(twelve_b1_fee, 0) + other_expenses + coalesce(acquired_fund_fees, 0)', 4)} AS total_from_facts,
  coalesce(total_annual_expenses = 0 AND coalesce(management_fee, 0) = 0 AND coalesce(net_expenses, 0) = 0, false) AS rejected FROM v_fee"""))
def synthetic_totals(v):
    p = [F.col(c) for c in ("management_fee", "twelve_b1_fee", "other_expenses", "acquired_fund_fees")]
    return v.fee_snapshot().select(
        "class_id", "accession_no", history.synthetic_total(*p, facts=False).alias("total_from_table"),
        history.synthetic_total(*p, facts=True).alias("total_from_facts"),
        history.is_zero_fee(F.col("management_fee"), F.col("total_annual_expenses"), F.col("net_expenses")).alias("rejected"),
    )


# -- portfolios ---------------------------------------------------------------------

V_PORT = f"""
v_coll AS (SELECT portfolio, upper(trim(ticker)) AS ticker, sum(weight) AS weight, min(name) AS name FROM v_position WHERE trim(ticker) <> '' GROUP BY 1, 2),
v_verdict AS (SELECT portfolio, sum(weight) AS total_weight, count(*) AS positions, CASE WHEN min(weight) <= 0 THEN 'rejected_non_positive' WHEN abs(CAST(sum(weight) AS DOUBLE) - 100) > 2 THEN 'rejected_total'
    WHEN abs(CAST(sum(weight) AS DOUBLE) - 100) > 0.01 THEN 'normalised' ELSE 'accepted' END AS status FROM v_coll GROUP BY 1)"""
V_TICKCOST = """
v_tick AS (SELECT ticker, er_bps, brokerage_bps, u AS underlying_bps, t AS total_bps FROM (
  SELECT c.ticker, c.er_bps, c.brokerage_bps, r.underlying_bps AS u, r.total_bps AS t, row_number() OVER (PARTITION BY c.ticker ORDER BY c.period DESC) AS rn
  FROM v_cost c JOIN v_roll r ON r.series_id = c.series_id AND r.period = c.period) q WHERE rn = 1)"""
V_LINE = f"""
v_line AS (SELECT portfolio, ticker, name, er_bps, brokerage_bps, underlying_bps, total_bps, CAST(weight AS DOUBLE) * 100.0::DOUBLE / CAST(total_weight AS DOUBLE) AS weight_pct,
    CASE WHEN total_bps IS NULL THEN 'UNAVAILABLE' WHEN er_bps IS NOT NULL THEN 'REPORTED' WHEN underlying_bps IS NOT NULL OR brokerage_bps IS NOT NULL THEN 'PARTIAL' ELSE 'CALCULATED' END AS quality
  FROM v_coll JOIN (SELECT portfolio, total_weight FROM v_verdict WHERE status IN ('accepted', 'normalised')) k USING (portfolio) LEFT JOIN v_tick USING (ticker))"""
_X = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(28,12))) AS DOUBLE)"
V_SUM = f"""
v_sum AS (SELECT portfolio, positions, coalesce(a / nullif(pr, 0), 0) AS true_tco_bps, coalesce(b / nullif(pr, 0), 0) AS stated_er_bps, coalesce(a / nullif(pr, 0), 0) - coalesce(b / nullif(pr, 0), 0) AS hidden_gap_bps,
    pr AS priced_fraction, greatest(1 - pr, 0) AS unpriced_fraction
  FROM (SELECT portfolio, count(*) AS positions, {_X('weight_pct / 100 * total_bps')} AS a, {_X('CASE WHEN total_bps IS NOT NULL THEN weight_pct / 100 * coalesce(er_bps, 0) END')} AS b,
    coalesce({_X('CASE WHEN total_bps IS NOT NULL THEN weight_pct / 100 END')}, 0) AS pr FROM v_line GROUP BY 1) q)"""
PORT = (*ROLL, V_POSITION, V_PORT, V_TICKCOST, V_LINE, V_SUM)


def _ticker_cost(v):
    """Latest rolled-up cost per ticker."""
    cost = _settled_cost(v)
    rolled = structure.roll_up(_direct(cost), _edges(v)).select(*KEYS, "underlying_bps", "total_bps")
    c = cost.join(rolled, list(KEYS))
    body = F.struct("er_bps", "brokerage_bps", "underlying_bps", "total_bps")
    return c.groupBy("ticker").agg(F.max_by(body, "period").alias("b")).select("ticker", "b.*")


def _lines(v):
    c = settle(portfolio.collapse(v.position()))
    return portfolio.priced(c, portfolio.validation(c), _ticker_cost(v))


@query(with_views(V_POSITION, V_PORT, body=f"SELECT portfolio, {R('CAST(total_weight AS DOUBLE)', 6)} AS total_weight, positions, status FROM v_verdict"))
def portfolio_validation(v):
    return portfolio.validation(portfolio.collapse(v.position())).withColumn("total_weight", rnd(dbl("total_weight"), 6))


@query(with_views(*PORT, body=f"""
SELECT portfolio, ticker, name, er_bps, {R('weight_pct', 6)} AS weight_pct, {R('total_bps', 4)} AS total_bps, quality, {R('weight_pct / 100 * total_bps', 4)} AS contribution_bps FROM v_line"""))
def portfolio_lines(v):
    return _lines(v).select("portfolio", "ticker", "name", "er_bps", rnd("weight_pct", 6).alias("weight_pct"),
                            rnd("total_bps", 4).alias("total_bps"), "quality", rnd("contribution_bps", 4).alias("contribution_bps"))


_SUMCOLS = ("true_tco_bps", "stated_er_bps", "hidden_gap_bps", "priced_fraction", "unpriced_fraction")


@query(with_views(*PORT, body="SELECT portfolio, positions, " + ", ".join(f"{R(c, 4)} AS {c}" for c in _SUMCOLS) + " FROM v_sum"))
def portfolio_summary(v):
    return portfolio.summary(_lines(v)).select("portfolio", "positions", *[rnd(c, 4).alias(c) for c in _SUMCOLS])


_PW = lambda c: f"100000::DOUBLE * pow(1.07::DOUBLE - {c} / 10000, h)"


@query(with_views(*PORT, body=f"""
SELECT portfolio, h AS horizon_years, {R(_PW('true_tco_bps'))} AS wealth_true, {R(_PW('stated_er_bps'))} AS wealth_stated,
  {R(f"{_PW('stated_er_bps')} - {_PW('true_tco_bps')}")} AS drag_dollars, {R(f"({_PW('stated_er_bps')} - {_PW('true_tco_bps')}) / ({_PW('stated_er_bps')})", 6)} AS drag_fraction
FROM v_sum CROSS JOIN (VALUES (10), (20), (30)) t(h)"""))
def compound_projection(v):
    return portfolio.projection(portfolio.summary(_lines(v)))


_CH = lambda s: R(f"coalesce(brokerage_bps, 0) + coalesce(spread_{s}_bps, 0) + coalesce(impact_{s}_bps, 0)", 4)


@query(with_views(*COST_VIEWS, body=f"""
, v_group AS (SELECT DISTINCT family AS "group", ticker FROM v_fund),
v_l AS (SELECT "group", ticker, er_bps, {_CH('low')} AS hidden_low_bps, {_CH('high')} AS hidden_high_bps FROM v_group JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS rn FROM v_cost) z WHERE rn = 1) c USING (ticker)),
v_m AS (SELECT *, er_bps + hidden_low_bps AS true_low_bps, er_bps + hidden_high_bps AS true_high_bps, {_GRADE('((hidden_low_bps + hidden_high_bps) / 2)')} AS grade,
  {R(f'{_FREE} - ' + _POW('(er_bps + hidden_high_bps) / 10000'))} AS dollar_cost FROM v_l)
SELECT "group", ticker, er_bps, hidden_low_bps, hidden_high_bps, {R('true_low_bps', 4)} AS true_low_bps, {R('true_high_bps', 4)} AS true_high_bps, grade, dollar_cost, best_ticker, worst_ticker, saving
FROM v_m JOIN (SELECT "group", arg_min(ticker, (true_high_bps, ticker)) FILTER (true_high_bps IS NOT NULL) AS best_ticker, arg_min(ticker, (-true_high_bps, ticker)) FILTER (true_high_bps IS NOT NULL) AS worst_ticker,
  {R('max(dollar_cost) - min(dollar_cost)')} AS saving FROM v_m GROUP BY 1) e USING ("group")"""))
def fund_comparison(v):
    """Side by side within each family, at the latest period of each fund."""
    c = _cost(v)
    cols = [x for x in c.columns if x != "ticker"]
    latest = c.groupBy("ticker").agg(F.max_by(F.struct(*cols), "period").alias("b")).select("ticker", "b.*")
    groups = v.fund().select(F.col("family").alias("group"), "ticker")
    out = portfolio.compare(groups, latest)
    return out.withColumn("true_low_bps", rnd("true_low_bps", 4)).withColumn("true_high_bps", rnd("true_high_bps", 4))


@query(with_views(*COST_VIEWS, body=f"""
SELECT ticker, period, fund_name, {_RT('low')} AS hidden_low_bps, {_RT('high')} AS hidden_high_bps, {_GRADE(f"(({_RT('low')} + {_RT('high')}) / 2)")} AS grade,
  row_number() OVER (ORDER BY {_RT('high')} DESC, ticker, period) AS rank FROM v_cost"""))
def hidden_cost_ranking(v):
    """Flagship: all funds and periods ranked by estimated hidden cost."""
    return flagship(v)


def flagship(v: FundViews) -> DataFrame:
    r = costs.report_extract(_cost(v)).select(
        "ticker", "period", "fund_name", F.col("total_low_bps").alias("hidden_low_bps"), F.col("total_high_bps").alias("hidden_high_bps"), "grade"
    )
    return ranked(r, [F.col("hidden_high_bps").desc(), F.col("ticker").asc(), F.col("period").asc()])


@query(with_views(*COST_VIEWS, body=f"SELECT series_id, period, {_GRADE('mid')} AS grade FROM (SELECT *, ({_RT('low')} + {_RT('high')}) / 2 AS mid FROM v_cost) q"))
def hidden_cost_grades(v):
    r = costs.report_extract(_cost(v))
    return r.select(*KEYS, hidden_grade((F.col("total_low_bps") + F.col("total_high_bps")) / 2).alias("grade"))
