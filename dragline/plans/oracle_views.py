"""DuckDB text of the fund-shaped views, for the side-by-side checks."""

from __future__ import annotations


def R(x: str, n: int = 2) -> str:
    """Half-up rounding on an 8-digit decimal (same rule as ``expr.rnd``)."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,8)), {n}) AS DOUBLE)"


V_FUND = """
v_fund AS (
  SELECT s_suppkey AS series_id, 'FND' || s_suppkey AS ticker,
    s_name || CASE WHEN s_acctbal > 9500 THEN ' ETF' WHEN r_name = 'ASIA' THEN ' Bond Fund' ELSE ' Fund' END AS fund_name,
    n_name AS family, r_name AS category,
    CASE WHEN n_nationkey < 20 THEN n_nationkey * CAST(8.0 AS DOUBLE) END AS prospectus_turnover,
    s_acctbal < 3500 AS soft_dollar_flag, s_acctbal < 1000 AS soft_dollar_reported,
    s_acctbal < 9000 AS has_ncen, s_acctbal < 8000 AS has_average_nav, s_acctbal >= 0 AS has_nport,
    CAST(CASE WHEN s_acctbal >= 5000 AND s_acctbal < 6000 THEN 2.5
         WHEN s_acctbal >= 6000 AND s_acctbal < 7000 THEN 1.25 ELSE 1.0 END AS DOUBLE) AS nav_factor
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

V_HOLDING = """
v_holding AS (
  SELECT l_suppkey AS series_id, CAST(year(l_shipdate) AS INTEGER) AS period, l_orderkey AS orderkey,
    l_linenumber AS linenumber, p_partkey AS partkey,
    p_name || ' ' || CASE WHEN p_size BETWEEN 15 AND 18 THEN 'Growth Fund' WHEN p_size BETWEEN 19 AND 20 THEN 'Mortgage Trust'
      WHEN p_size BETWEEN 21 AND 22 THEN 'Money Market' WHEN p_size = 23 THEN 'Treasury Bill'
      WHEN p_size = 24 THEN 'Overnight Repo' ELSE 'Corp' END AS name,
    lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS cusip,
    CASE WHEN p_brand = 'Brand#5' THEN 'GB' ELSE 'US' END || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '0' AS isin,
    CASE WHEN p_type = 'PROMO' AND l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2))
      ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS value_usd,
    CASE p_type WHEN 'STANDARD' THEN 'EC' WHEN 'SMALL' THEN 'EP' WHEN 'MEDIUM' THEN 'DBT' WHEN 'LARGE' THEN 'ABS-MBS'
      WHEN 'ECONOMY' THEN 'STIV' WHEN 'PROMO' THEN CASE l_linenumber WHEN 1 THEN 'DE' WHEN 2 THEN 'DFE' WHEN 3 THEN 'DIR'
      WHEN 4 THEN 'DCR' WHEN 5 THEN 'DCO' ELSE 'DO' END END AS asset_category,
    CASE WHEN p_size <= 14 THEN 'RF' ELSE 'CORP' END AS issuer_category,
    CASE WHEN p_type = 'PROMO' THEN CASE WHEN l_linestatus = 'F' THEN 'swapDeriv' ELSE 'fwdDeriv' END END AS instrument_type,
    CASE WHEN p_type = 'PROMO' THEN CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) END AS notional_usd,
    CASE WHEN p_type = 'PROMO' THEN p_brand END AS counterparty_name,
    CASE WHEN p_type = 'PROMO' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(l_discount AS DECIMAL(4,2)) - CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,4)) END AS unrealized_usd,
    CASE WHEN n_nationkey = 24 THEN 'us ' WHEN n_nationkey = 0 THEN ' ' WHEN n_nationkey <> 1 THEN lower(n_name) END AS country
  FROM lineitem JOIN part ON l_partkey = p_partkey
  LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey)"""

V_NCEN = V_FUND + """,
v_ncen AS (
  SELECT series_id, period, ticker, category, family, has_ncen AS has_census, CASE WHEN has_ncen THEN commissions END AS commissions,
    CASE WHEN has_ncen THEN coalesce(affiliated_commissions, 0) END AS affiliated_commissions,
    CASE WHEN has_ncen THEN soft_dollar_flag END AS has_soft_dollar,
    CASE WHEN has_ncen AND soft_dollar_reported THEN commissions * CAST(0.2 AS DOUBLE) END AS soft_dollar_usd,
    CASE WHEN has_ncen THEN CAST(100.0 AS DOUBLE) * principal / gross_value END AS principal_pct,
    CASE WHEN has_ncen THEN CAST(100.0 AS DOUBLE) * agent / nullif(lending, 0) END AS lending_agent_pct,
    CAST(NULL AS DOUBLE) AS ncen_turnover, CASE WHEN has_ncen AND has_average_nav THEN gross_value END AS average_net_assets
  FROM (SELECT l_suppkey AS series_id, CAST(year(l_shipdate) AS INTEGER) AS period,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) / 100 AS commissions,
      CAST(sum(CASE WHEN p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4')
        THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) END) AS DOUBLE) / 100 AS affiliated_commissions,
      coalesce(CAST(sum(CASE WHEN p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4') AND l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS principal,
      coalesce(CAST(sum(CASE WHEN p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4') THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) END) AS DOUBLE), 0) AS agent,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS lending,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross_value
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) x JOIN v_fund USING (series_id))"""

V_BROKER = """
v_broker AS (
  SELECT l_suppkey AS series_id, CAST(year(l_shipdate) AS INTEGER) AS period, p_brand AS broker_name,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) / 100 AS gross_commission,
    min(l_orderkey * 100 + l_linenumber) AS position,
    p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4') AS is_affiliated
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""

V_FEE = """
v_fee AS (
  SELECT class_id, series_id, filing_date, accession_no, form_type, management_fee, twelve_b1_fee, other_expenses,
    acquired_fund_fees, max_sales_load, portfolio_turnover,
    CASE WHEN pr <> '5-LOW' THEN total END AS total_annual_expenses,
    CASE WHEN pr = '1-URGENT' THEN round(greatest(total - (k % 11) / 100.0, 0), 2) END AS net_expenses
  FROM (SELECT *, round(management_fee + coalesce(twelve_b1_fee, 0) + other_expenses, 2) AS total
    FROM (SELECT o_custkey AS class_id, o_custkey % (SELECT count(*) FROM supplier) AS series_id,
        CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS accession_no,
        CASE o_orderstatus WHEN 'F' THEN '485BPOS' WHEN 'O' THEN '485APOS' ELSE '485BXT' END AS form_type,
        o_orderpriority AS pr, k,
        CASE WHEN o_orderstatus <> 'P' THEN (k % 150) / 100.0 END AS management_fee,
        CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '4-NOT SPECIFIED' THEN (k % 26) / 100.0 END AS twelve_b1_fee,
        CASE WHEN o_orderstatus <> 'P' THEN (k % 41) / 100.0 END AS other_expenses,
        CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '2-HIGH' THEN (k % 7) / 100.0 END AS acquired_fund_fees,
        CASE WHEN o_orderstatus <> 'P' THEN (k % 576) / 100.0 END AS max_sales_load,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(k % 150 AS DOUBLE) END AS portfolio_turnover
      FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS k FROM orders)) a) b)"""

V_POSITION = """
v_position AS (
  SELECT portfolio, CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN ' '
      WHEN l_returnflag = 'R' THEN ' ' || lower('FND' || l_suppkey) ELSE 'FND' || l_suppkey END AS ticker,
    CAST(CAST(100.0 AS DOUBLE) * l_quantity / CAST(total AS DOUBLE) * (1 + ((l_orderkey % 7) - 3) * CAST(0.9 AS DOUBLE) / 100) AS DECIMAL(18,8)) AS weight,
    CASE WHEN l_returnflag = 'N' THEN 'Fund ' || l_suppkey END AS name
  FROM lineitem JOIN (SELECT l_orderkey AS portfolio, sum(CAST(l_quantity AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY 1)
    ON l_orderkey = portfolio)"""

V_LOOKUP = """
v_lookup AS (
  SELECT event_id, ts, 'FND' || user_id AS ticker,
    CASE WHEN event_type <> 'click' THEN value * CAST(0.8 AS DOUBLE) END AS hidden_low_bps,
    CASE WHEN event_type <> 'click' THEN value * CAST(1.2 AS DOUBLE) END AS hidden_high_bps,
    CASE WHEN event_type <> 'view' THEN value / 2 END AS expense_ratio_bps,
    CASE WHEN event_type = 'purchase' THEN 0 ELSE value / 4 END AS turnover_pct,
    CASE WHEN event_type <> 'error' THEN value * 10 END AS dollar_low,
    CASE WHEN event_type <> 'error' THEN value * 14 END AS dollar_high
  FROM events)"""

V_EVENT = """
v_event AS (
  SELECT CASE event_type WHEN 'error' THEN 'N-8F' WHEN 'signup' THEN 'N-14' ELSE '485BPOS' END AS form,
    'TRUST ' || user_id AS company, user_id AS cik, CAST(ts AS DATE) AS date_filed,
    'edgar/data/' || user_id || '/' || event_id AS filing_path
  FROM events)"""


def with_views(*parts: str, body: str) -> str:
    body = body.strip()
    more = "" if not body.startswith(",") else body  # a body may begin with further views
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + (more or body)
