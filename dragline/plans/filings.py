"""Queries over filing documents.

The given tables hold no filings, so each query first lets Spark write one
small document per table row (XML, HTML, header or plain text) and then runs the
parser over all of them.  The DuckDB text computes the expected facts straight
from the table, without any document in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dragline.functions import names as N
from dragline.functions import text as X
from dragline.functions.expr import dbl, rnd
from dragline.operators import conflicts, fees, filing_prose, history, resolve
from dragline.operators.readability import score
from dragline.plans.oracle_views import R, V_EVENT, V_FEE, V_FUND, V_HOLDING, with_views
from dragline.sources import filings_xml as XML
from dragline.sources import indexes
from dragline.sources.fund_views import FundViews

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, path: fn(FundViews(spark, path))
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


# -- holdings XML ------------------------------------------------------------------


def _holding_docs(v: FundViews) -> DataFrame:
    """A holdings form per position: the position, a nameless one, sometimes a foreign series or a broken end."""
    return v.holding().selectExpr(
        "series_id", "period", "orderkey", "linenumber",
        """concat('<edgarSubmission xmlns="http://www.sec.gov/edgar/nport"><formData><genInfo><seriesId>',
            if(linenumber = 7, 'S-other', cast(series_id as string)), '</seriesId><repPdDate>', period, '-12-31</repPdDate></genInfo>',
            '<fundInfo><netAssets>', cast(abs(value_usd) * 10 as decimal(18,2)), '</netAssets></fundInfo><invstOrSecs><invstOrSec><name> ', name, ' </name><cusip>', cusip,
            '</cusip><identifiers><isin value="', isin, '"/></identifiers><balance>', if(issuer_category = 'RF', 'n/a', '100'), '</balance><valUSD>', value_usd,
            '</valUSD><assetCat>', asset_category, '</assetCat><issuerCat>', issuer_category, '</issuerCat>',
            if(instrument_type is null, '', concat('<derivativeInfo><', instrument_type, '><counterpartyInfo><counterpartyName>', counterparty_name,
               '</counterpartyName></counterpartyInfo>', if(instrument_type = 'fwdDeriv',
                 concat('<amtCurSold>-', notional_usd, '</amtCurSold><curSold>', if(asset_category = 'DO', 'EUR', 'USD'), '</curSold>'),
                 concat('<notionalAmt>', notional_usd, '</notionalAmt>', if(asset_category = 'DO', '<curCd>EUR</curCd>', if(asset_category = 'DE', '<curCd>USD</curCd>', '')))),
               '<unrealizedAppr>', unrealized_usd, '</unrealizedAppr></', instrument_type, '></derivativeInfo>')),
            '</invstOrSec><invstOrSec><name></name><valUSD>1</valUSD></invstOrSec></invstOrSecs></formData>',
            if(linenumber = 6, '', '</edgarSubmission>')) as xml""",
    )


@query(with_views(V_HOLDING, body="""
SELECT series_id, period, count(*) AS positions, CAST(sum(value_usd) AS DOUBLE) AS value_usd, count(*) FILTER (issuer_category <> 'RF') AS with_balance,
  min(cusip) AS first_cusip, max(isin) AS last_isin FROM v_holding WHERE linenumber NOT IN (6, 7) GROUP BY 1, 2"""))
def holdings_xml(v):
    h = XML.holdings_of(XML.parse_holdings_form(_holding_docs(v), columns=("value_usd", "balance", "cusip", "isin")))
    return h.groupBy("series_id", "period").agg(
        F.count("*").alias("positions"), dbl(F.sum(F.col("value_usd").cast("decimal(18,2)"))).alias("value_usd"),
        F.count("balance").alias("with_balance"), F.min("cusip").alias("first_cusip"), F.max("isin").alias("last_isin"),
    )


@query(with_views(V_HOLDING, body=f"""
SELECT series_id, period, instrument_type, counterparty_name, count(*) AS positions, {R("coalesce(CAST(sum(CASE WHEN asset_category <> 'DO' THEN notional_usd END) AS DOUBLE), 0)")} AS notional_usd,
  count(*) FILTER (asset_category <> 'DO') AS in_dollars, {R('CAST(sum(unrealized_usd) AS DOUBLE)')} AS unrealized_usd
FROM v_holding WHERE linenumber NOT IN (6, 7) AND instrument_type IS NOT NULL GROUP BY 1, 2, 3, 4"""))
def derivatives_xml(v):
    columns = ("instrument_type", "counterparty_name", "notional_usd", "unrealized_usd")
    h = XML.holdings_of(XML.parse_holdings_form(_holding_docs(v), columns=columns)).filter(F.col("instrument_type").isNotNull())
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,4)"))
    return h.groupBy("series_id", "period", "instrument_type", "counterparty_name").agg(
        F.count("*").alias("positions"), rnd(F.coalesce(dbl(exact("notional_usd")), F.lit(0.0))).alias("notional_usd"),
        F.count("notional_usd").alias("in_dollars"), rnd(dbl(exact("unrealized_usd"))).alias("unrealized_usd"),
    )


@query(with_views(V_HOLDING, body="""
SELECT series_id, period, count(*) AS forms, CAST(sum(CAST(abs(value_usd) * 10 AS DECIMAL(18,2))) AS DOUBLE) AS net_assets, CAST(max(period || '-12-31') AS DATE) AS period_end
FROM v_holding WHERE linenumber NOT IN (6, 7) GROUP BY 1, 2"""))
def holdings_form_headers(v):
    f = XML.parse_holdings_form(_holding_docs(v), columns=())
    return f.groupBy("series_id", "period").agg(
        F.count("*").alias("forms"), dbl(F.sum(F.col("net_assets").cast("decimal(18,2)"))).alias("net_assets"), F.max("period_end").alias("period_end")
    )


# -- census XML ------------------------------------------------------------------------


def _census_docs(v: FundViews) -> DataFrame:
    columns = ("c_custkey", "c_nationkey", "c_name", "c_mktsegment", "c_acctbal")
    return v.dealt(v.table("customer").select(*columns)).selectExpr(
        "c_custkey as series_id", "c_nationkey as filer",
        """concat('<edgarSubmission xmlns="http://www.sec.gov/edgar/ncen"><headerData><reportCalendarOrQuarter>2024-06-30</reportCalendarOrQuarter></headerData><formData>',
            '<managementInvestmentQuestionSeriesInfo><managementInvestmentQuestion><mgmtInvFundName>', c_name, '</mgmtInvFundName>',
            if(c_mktsegment = 'MACHINERY' , '', concat('<mgmtInvSeriesId>', c_custkey, '</mgmtInvSeriesId>')),
            '<aggregateCommission>', if(c_acctbal < 0, 'N/A', cast(cast(c_acctbal as decimal(18,2)) as string)), '</aggregateCommission>',
            '<isBrokerageResearchPayment>', if(c_nationkey < 10, 'Y', 'N'), '</isBrokerageResearchPayment><mnthlyAvgNetAssets>', cast(abs(c_acctbal) * 1000 as decimal(18,2)), '</mnthlyAvgNetAssets>',
            '<brokerDealers><brokerDealer><brokerDealerName>', c_mktsegment, ' Dealer</brokerDealerName>', if(c_nationkey < 5, '', '<brokerDealerCommission>12.5</brokerDealerCommission>'), '</brokerDealer></brokerDealers>',
            '<brokers><broker><brokerName>First</brokerName><grossCommission>', c_nationkey, '</grossCommission></broker><broker><brokerName> </brokerName></broker><broker><brokerName>Third</brokerName></broker></brokers>',
            '<principalTransactions><principalTransaction><principalName>', c_mktsegment, '</principalName><principalTotalPurchaseSale>', c_nationkey * 100, '</principalTotalPurchaseSale></principalTransaction></principalTransactions>',
            '<isFundSecuritiesLending>', if(c_nationkey > 12, 'Y', 'N'), '</isFundSecuritiesLending><securityLendings><securityLending><securitiesAgentName>Agent</securitiesAgentName><isSecuritiesAgentAffiliated>',
            if(c_mktsegment = 'BUILDING', 'Y', 'N'), '</isSecuritiesAgentAffiliated></securityLending></securityLendings><netIncomeSecuritiesLending>', c_nationkey, '</netIncomeSecuritiesLending>',
            if(c_acctbal < 1000, '', concat('<lineOfCredit hasLineOfCredit="Y"><lineOfCreditDetails><lineOfCreditDetail><isCreditLineCommitted>Committed</isCreditLineCommitted><isCreditLineUsed>N</isCreditLineUsed>',
              '<maxBorrowedDuringPeriod>0</maxBorrowedDuringPeriod><maxOutstandingBalance>', c_nationkey * 10, '</maxOutstandingBalance><lineOfCreditInstitutions><lineOfCreditInstitution creditInstitutionName="Bank A"/></lineOfCreditInstitutions></lineOfCreditDetail>',
              '<lineOfCreditDetail><isCreditLineUsed>', if(c_nationkey < 8, 'Y', 'N'), '</isCreditLineUsed><lineOfCreditSize>', 1000, '</lineOfCreditSize><lineOfCreditInstitutions><lineOfCreditInstitution creditInstitutionName="Bank B"/><lineOfCreditInstitution creditInstitutionName=""/></lineOfCreditInstitutions>',
              '<sharedCreditType creditType="Shared"><creditUser fundName="', c_name, '"/><creditUser fundName="Sibling"/></sharedCreditType></lineOfCreditDetail></lineOfCreditDetails></lineOfCredit>')),
            '<derivativeInstruments><derivativeInstrument><derivativeType>swap</derivativeType><derivativeNotional>-', c_nationkey, '</derivativeNotional></derivativeInstrument>',
            '<derivativeInstrument><derivativeType>swap</derivativeType><notional>5</notional></derivativeInstrument></derivativeInstruments>',
            '<isSwap>Y</isSwap><isOption>', if(c_nationkey < 3, 'Y', 'N'), '</isOption><optionNotional>-7</optionNotional><isWarrant>', if(c_nationkey = 4, 'y', 'N'), '</isWarrant>',
            '<investmentAdvisers><investmentAdviser><investmentAdviserName>Adviser ', c_nationkey, '</investmentAdviserName></investmentAdviser></investmentAdvisers><admins><admin><adminName>Admin</adminName><isAdminAffiliated>', if(c_nationkey = 7, 'Y', 'N'), '</isAdminAffiliated></admin></admins>',
            '</managementInvestmentQuestion>', if(c_mktsegment in ('MACHINERY', 'BUILDING'), '', '<managementInvestmentQuestion><mgmtInvSeriesId>S-other</mgmtInvSeriesId></managementInvestmentQuestion>'),
            '</managementInvestmentQuestionSeriesInfo></formData>', if(c_mktsegment = 'HOUSEHOLD' and c_acctbal > 9000, '', '</edgarSubmission>')) as xml""",
    )


def _sections(v):
    return XML.parse_census_form(_census_docs(v))


V_CUST = "v_cust AS (SELECT * FROM customer WHERE NOT (c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 9000))"


@query(with_views(V_CUST, body="""
SELECT CAST(c_custkey AS VARCHAR) AS series_id, DATE '2024-06-30' AS period_end, c_name AS fund_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS commissions, c_nationkey < 10 AS has_soft_dollar,
  CAST(CAST(abs(c_acctbal) * 1000 AS DECIMAL(18,2)) AS DOUBLE) AS average_net_assets, c_nationkey > 12 AS is_lending, c_nationkey > 12 AND c_mktsegment = 'BUILDING' AS is_lending_agent_affiliated,
  CAST(CASE WHEN c_nationkey > 12 THEN c_nationkey END AS DOUBLE) AS lending_net_income, 'Adviser ' || c_nationkey AS adviser, 'Admin' AS administrator, c_nationkey = 7 AS is_admin_affiliated FROM v_cust"""))
def census_xml(v):
    return XML.census_fund(_sections(v)).select(
        "series_id", "period_end", "fund_name", "commissions", "has_soft_dollar", "average_net_assets", "is_lending",
        "is_lending_agent_affiliated", "lending_net_income", "adviser", "administrator", "is_admin_affiliated",
    )


@query(with_views(V_CUST, body="""
SELECT CAST(c_custkey AS VARCHAR) AS series_id, c_acctbal >= 1000 AS has_credit_line, CASE WHEN c_acctbal >= 1000 THEN 'Committed' END AS credit_line_type, c_acctbal >= 1000 AND c_nationkey < 8 AS is_credit_line_used,
  CAST(CASE WHEN c_acctbal >= 1000 THEN 1000 END AS DOUBLE) AS facility_size, CAST(CASE WHEN c_acctbal >= 1000 THEN c_nationkey * 10 END AS DOUBLE) AS max_outstanding, c_acctbal >= 1000 AS is_facility_shared,
  CASE WHEN c_acctbal >= 1000 THEN 'Bank A|Bank B' ELSE '' END AS lenders, CASE WHEN c_acctbal >= 1000 THEN 2 ELSE 0 END AS co_borrower_count,
  CASE WHEN c_acctbal >= 1000 THEN """ + R("c_nationkey * 10 / 1000", 6) + """ END AS utilisation FROM v_cust"""))
def census_credit_xml(v):
    c = XML.census_fund(_sections(v)).select(
        "series_id", "has_credit_line", "credit_line_type", "is_credit_line_used", "facility_size", "max_outstanding", "is_facility_shared",
        F.concat_ws("|", "lenders").alias("lenders"), F.size("co_borrowers").alias("co_borrower_count"),
    )
    return conflicts.credit_utilisation(c)


@query(with_views(V_CUST, body="""
SELECT CAST(c_custkey AS VARCHAR) AS series_id, broker_name, gross_commission, is_affiliated, position FROM (
  SELECT c_custkey, c_mktsegment || ' Dealer' AS broker_name, CASE WHEN c_nationkey < 5 THEN 0 ELSE 12.5::DOUBLE END AS gross_commission, true AS is_affiliated, 0 AS position FROM v_cust
  UNION ALL SELECT c_custkey, 'First', CAST(c_nationkey AS DOUBLE), false, 0 FROM v_cust UNION ALL SELECT c_custkey, 'Third', 0, false, 2 FROM v_cust) q"""))
def census_brokers_xml(v):
    return XML.census_brokers(_sections(v)).select("series_id", "broker_name", "gross_commission", "is_affiliated", "position")


@query(with_views(V_CUST, body="SELECT c_mktsegment AS name, count(*) AS records, CAST(sum(c_nationkey * 100) AS DOUBLE) AS total_purchase_sale FROM v_cust GROUP BY 1"))
def census_principals_xml(v):
    return XML.census_principals(_sections(v)).groupBy("name").agg(
        F.count("*").alias("records"), dbl(F.sum(F.col("total_purchase_sale").cast("decimal(18,2)"))).alias("total_purchase_sale"))


@query(with_views(V_CUST, body="""
SELECT CAST(c_custkey AS VARCHAR) AS series_id, 1 + (c_nationkey < 3)::INT + (c_nationkey = 4)::INT AS distinct_types, CAST(c_nationkey + 5 + CASE WHEN c_nationkey < 3 THEN 7 ELSE 0 END AS DOUBLE) AS notional FROM v_cust"""))
def census_derivative_totals(v):
    s = _sections(v)
    exact = F.col("notional").cast("decimal(28,4)")
    use = conflicts.derivative_use(
        XML.census_derivative_records(s).withColumn("notional", exact), XML.census_derivative_flags(s).withColumn("notional", exact)
    )
    return conflicts.derivative_totals(use)


# -- masters, indexes, headers ------------------------------------------------------------


@query("SELECT c_nationkey::BIGINT AS cik, 'S' || c_custkey AS series_id, 'C' || c_custkey AS class_id, upper(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END) AS ticker FROM customer")
def ticker_master_json(v):
    raw = v.table("customer").selectExpr(
        "to_json(struct(array('cik','seriesId','classId','symbol') as fields, array(array(cast(c_nationkey as string), concat('S', c_custkey), concat('C', c_custkey),"
        " if(c_acctbal < 0, null, lower(c_mktsegment)))) as data)) as value"
    )
    return indexes.ticker_master(raw.select(F.from_json("value", indexes.MASTER_SCHEMA).alias("r")).select("r.*"))


@query("""SELECT ticker, cik, series_id, class_id FROM (SELECT upper(c_mktsegment) || c_nationkey AS ticker, c_custkey AS cik, 'S' || c_custkey AS series_id, 'C' || c_custkey AS class_id,
  row_number() OVER (PARTITION BY upper(c_mktsegment) || c_nationkey ORDER BY c_custkey DESC) AS rn FROM customer WHERE c_custkey > 0 AND c_acctbal > 0) q WHERE rn = 1""")
def series_census(v):
    raw = v.table("customer").selectExpr(
        "lpad(cast(c_custkey as string), 12, '0') as `﻿CIK Number`", "concat(' S', c_custkey) as `Series ID`",
        "if(c_acctbal > 0, concat('C', c_custkey), ' ') as `Class ID`", "concat(' ', lower(c_mktsegment), c_nationkey) as `Class Ticker`", "c_custkey",
    )
    return indexes.census(raw, F.col("c_custkey"))


def _index(v):
    raw = v.table("orders").selectExpr(
        "to_json(struct(cast(o_custkey as string) as cik, 'T' as name, struct(struct(array(if(o_orderstatus = 'F', '485BPOS', if(o_orderstatus = 'O', 'N-CEN/A', '497K')), 'X') as form,"
        " array(date_format(o_orderdate, 'yyyy-MM-dd')) as filingDate, array(cast(o_orderkey as string), 'y') as accessionNumber, array('doc') as primaryDocument) as recent) as filings)) as value"
    )
    rows = indexes.filing_index(raw.select(F.from_json("value", indexes.INDEX_SCHEMA).alias("r")).select("r.*"))
    newest_first = F.struct((-F.unix_date(F.to_date("filing_date"))).alias("d"), F.col("accession_no").cast("bigint").alias("a"))
    return rows.withColumn("position", newest_first)


_IDX = "v_idx AS (SELECT CAST(o_custkey AS VARCHAR) AS cik, CASE o_orderstatus WHEN 'F' THEN '485BPOS' WHEN 'O' THEN 'N-CEN/A' ELSE '497K' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, o_orderkey FROM orders)"


@query(with_views(_IDX, body="""SELECT cik, form, filing_date, CAST(o_orderkey AS VARCHAR) AS accession_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, o_orderkey) AS rank FROM v_idx WHERE contains(form, 'N-CEN')) q WHERE rank <= 3"""))
def filings_of_form(v):
    return indexes.of_form(_index(v), "N-CEN", 3).select("cik", "form", "filing_date", "accession_no", "rank")


@query(with_views(_IDX, body="""SELECT cik, form, CAST(o_orderkey AS VARCHAR) AS accession_no, filing_date FROM v_idx WHERE form IN ('485BPOS', '497K')"""))
def class_filings(v):
    return indexes.class_filings(_index(v)).select("cik", "form", "accession_no", "filing_date")


@query("""SELECT series_id, accession_no, filing_date FROM (
  SELECT l_suppkey AS series_id, l_orderkey AS accession_no, min(position) AS position, CAST(min(l_shipdate) AS DATE) AS filing_date FROM (SELECT *, -(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) * 100000000000 + l_orderkey AS position,
    row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_shipdate DESC) AS rn FROM lineitem) a WHERE rn = 1 GROUP BY 1, 2) b""")
def series_filing_list(v):
    rows = v.table("lineitem").select(
        F.col("l_suppkey").alias("series_id"), F.col("l_orderkey").alias("accession_no"), F.lit("NPORT-P").alias("form"),
        F.to_date("l_shipdate").alias("filing_date"),
        F.struct((-F.unix_date(F.to_date("l_shipdate"))).alias("d"), F.col("l_orderkey")).alias("position"),
    )
    return indexes.series_filings(rows).select("series_id", "accession_no", "filing_date")


def _index_lines(v):
    return v.fund_event().selectExpr(
        "case when form = '485BPOS' and cik < 30 then '---------------' else concat(rpad(form, if(cik < 50, 12, 17), ' '), rpad(company, 62, ' '), rpad(cast(cik as string), 12, ' '),"
        " date_format(date_filed, 'yyyy-MM-dd'), '  ', filing_path) end as value"
    )


@query(with_views(V_EVENT, body="SELECT *, CASE WHEN form = 'N-8F' THEN 'deregistration' ELSE 'merger/reorg' END AS event FROM v_event WHERE form <> '485BPOS'"))
def form_index(v):
    return indexes.form_index(_index_lines(v))


@query(with_views(V_EVENT, body="SELECT form, cik, filing_path, date_filed FROM v_event"))
def mended_event_dates(v):
    broken = v.fund_event().selectExpr(
        "form", "cik", "if(form = '485BPOS', date_format(date_filed, 'yyyy-MM-dd'), date_format(date_filed, 'yyyy-MM')) as date_filed",
        "if(form = '485BPOS', filing_path, concat(date_format(date_filed, '-dd'), '  ', filing_path)) as filing_path",
    )
    return indexes.mend_event_dates(broken)


V_SUMMARY = "v_ev AS (SELECT *, CASE WHEN form = 'N-8F' THEN 'deregistration' ELSE 'merger/reorg' END AS event, strftime(date_trunc('week', date_filed), '%Y-%m-%d') AS b FROM v_event WHERE form <> '485BPOS')"
_SUMSQL = "count(*) FILTER (event = 'deregistration') AS deregistrations, count(*) FILTER (event = 'merger/reorg') AS mergers, count(*) AS events"


@query(with_views(V_EVENT, V_SUMMARY, body=f"""
SELECT b AS bucket, {_SUMSQL}, count(DISTINCT cik) FILTER (event = 'deregistration') AS filer_buckets_deregistered FROM v_ev GROUP BY 1
UNION ALL SELECT 'ALL', {_SUMSQL}, count(DISTINCT (cik, b)) FILTER (event = 'deregistration') FROM v_ev"""))
def fund_death_summary(v):
    week = F.date_format(F.date_trunc("week", "date_filed"), "yyyy-MM-dd")
    return history.event_summary(history.fund_events(v.fund_event()), week)


@query("""SELECT CAST(q AS DATE) AS quarter_start, year(q) || '-Q' || quarter(q) AS quarter, count(o_orderkey) AS filings FROM (SELECT unnest(generate_series(TIMESTAMP '1994-01-01', (SELECT date_trunc('quarter', max(o_orderdate)) FROM orders)::TIMESTAMP, INTERVAL 3 MONTH)) AS q) c
  LEFT JOIN orders ON date_trunc('quarter', o_orderdate) = q GROUP BY q""")
def event_calendar(v):
    """All quarters since a start year with their number of filings, zero for missing quarters."""
    o = v.table("orders")
    cal = history.calendar(1994, F.col("until"), o.agg(F.to_date(F.max("o_orderdate")).alias("until")))
    n = o.groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter_start")).agg(F.count("*").alias("filings"))
    return cal.join(n, "quarter_start", "left").select("quarter_start", "quarter", F.coalesce("filings", F.lit(0)).alias("filings"))


@query(with_views(V_EVENT, body="SELECT cik, form, date_filed, filing_path FROM v_event WHERE form = 'N-14'"))
def merger_list(v):
    return history.merger_list(v.fund_event()).select("cik", "form", "date_filed", "filing_path")


def _headers(v):
    """A header per customer: a series with two classes, then a second series with one class without ticker."""
    return v.table("customer").selectExpr(
        "c_custkey as accession_no", "date_add(date'2024-01-01', c_nationkey) as filing_date",
        """concat('COMPANY CONFORMED NAME:\\t\\t\\t', c_mktsegment, ' TRUST\\nCENTRAL INDEX KEY:\\t\\t', lpad(c_nationkey, 10, '0'), '\\n<SERIES>\\n<SERIES-ID>S', lpad(c_custkey, 9, '0'),
          '\\n<SERIES-NAME>x\\n<CLASS-CONTRACT>\\n<CLASS-CONTRACT-ID>C', lpad(c_custkey * 2, 9, '0'), '\\n<CLASS-CONTRACT-NAME>Class A\\n<CLASS-CONTRACT-TICKER-SYMBOL>t', c_nationkey, 'x\\n</CLASS-CONTRACT>\\n<CLASS-CONTRACT>\\n<CLASS-CONTRACT-ID>C',
          lpad(c_custkey * 2 + 1, 9, '0'), '\\n<CLASS-CONTRACT-NAME>Class R-6\\n<CLASS-CONTRACT-TICKER-SYMBOL>', c_mktsegment, '\\n</CLASS-CONTRACT>\\n</SERIES>\\n<SERIES>\\n<SERIES-ID>S', lpad(c_custkey + 500000000, 9, '0'),
          '\\n<CLASS-CONTRACT>\\n<CLASS-CONTRACT-ID>C', lpad(c_custkey + 500000000, 9, '0'), '\\n<CLASS-CONTRACT-NAME>Only\\n</CLASS-CONTRACT>\\n</SERIES>\\nCENTRAL INDEX KEY: 99') as header_text""",
    )


V_HEAD = """
v_head AS (SELECT c_custkey AS accession_no, CAST(DATE '2024-01-01' + c_nationkey AS DATE) AS filing_date, CAST(c_nationkey AS BIGINT) AS cik, c_mktsegment || ' TRUST' AS registrant, x.* FROM customer, LATERAL (VALUES
  ('S' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 'C' || lpad(CAST(c_custkey * 2 AS VARCHAR), 9, '0'), 0, 'Class A', 'T' || c_nationkey || 'X'),
  ('S' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 'C' || lpad(CAST(c_custkey * 2 + 1 AS VARCHAR), 9, '0'), 1, 'Class R-6', c_mktsegment),
  ('S' || lpad(CAST(c_custkey + 500000000 AS VARCHAR), 9, '0'), 'C' || lpad(CAST(c_custkey + 500000000 AS VARCHAR), 9, '0'), 0, 'Only', NULL)) x(series_id, class_id, position, class_name, ticker))"""


@query(with_views(V_HEAD, body="SELECT * FROM v_head"))
def filing_header_classes(v):
    return indexes.header_classes(_headers(v))


@query(with_views(V_HEAD, body="SELECT ticker, cik, series_id, class_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN cik IN (3, 7) THEN 0 ELSE 1 END, filing_date DESC, accession_no, class_id) AS rn FROM v_head WHERE ticker IS NOT NULL) q WHERE rn = 1"))
def header_walk(v):
    h = indexes.header_classes(_headers(v))
    return resolve.header_walk(h, F.when(F.col("cik").isin(3, 7), 0).otherwise(1)).select("ticker", "id.*")


_PLT = "upper(substr(p_type, 1, 5))"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN 'F9' ELSE {_PLT} END AS ticker, CASE WHEN l_linenumber = 4 THEN NULL WHEN l_returnflag = 'R' AND l_linenumber = 5 THEN NULL ELSE l_quantity END AS weight,
  CASE WHEN l_linenumber = 4 THEN 'expected ticker and weight' WHEN l_returnflag = 'R' AND l_linenumber = 5 THEN 'weight is not a number' WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN 'not a fund ticker' END AS error
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber NOT IN (6, 7)""")
def portfolio_text(v):
    li, p = v.table("lineitem"), v.table("part")
    lines = li.join(p, li.l_partkey == p.p_partkey).selectExpr(
        "l_orderkey", "l_linenumber",
        "case l_linenumber when 6 then '   ' when 7 then '# comment' when 4 then lower(substr(p_type, 1, 5)) when 5 then concat(substr(p_type, 1, 5), ':', if(l_returnflag = 'R', 'abc', cast(l_quantity as string)), '%')"
        " when 3 then concat(if(l_returnflag = 'N', 'F9', substr(p_type, 1, 5)), ', ', l_quantity) when 2 then concat(' ', lower(substr(p_type, 1, 5)), '\\t', l_quantity, ' %') else concat(substr(p_type, 1, 5), ' ', l_quantity) end as value",
    )
    return indexes.portfolio_lines(lines).drop("line_text")


@query("SELECT upper(c_mktsegment) AS ticker, count(*) AS lines FROM customer WHERE c_nationkey NOT IN (3, 4) GROUP BY 1")
def ticker_list(v):
    lines = v.table("customer").selectExpr("case c_nationkey when 3 then ' ' when 4 then '# x' else concat(' ', lower(c_mktsegment), ' ') end as value")
    return indexes.ticker_lines(lines).groupBy("ticker").agg(F.count("*").alias("lines"))


# -- resolution -------------------------------------------------------------------------

V_MASTER = """
v_master AS (SELECT CAST(s_nationkey AS BIGINT) AS cik, s_suppkey AS series_id, CAST(p_partkey AS BIGINT) AS class_id, 'F' || p_partkey || CASE WHEN p_size <= 25 THEN 'X' ELSE 'A' END AS ticker
  FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier))"""


def _master(v):
    p, s = v.table("part"), v.table("supplier")
    return p.join(s, s.s_suppkey == p.p_partkey % F.lit(v.n_funds)).select(
        F.col("s_nationkey").cast("bigint").alias("cik"), F.col("s_suppkey").alias("series_id"), F.col("p_partkey").alias("class_id"),
        F.concat(F.lit("F"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") <= 25, "X").otherwise("A")).alias("ticker"),
    )


@query(with_views(V_MASTER, body="SELECT cik, series_id, class_id, ticker FROM (SELECT *, row_number() OVER (PARTITION BY cik, series_id ORDER BY CASE WHEN ticker LIKE '%X' THEN 0 ELSE 1 END, ticker, class_id) AS rn FROM v_master) q WHERE rn = 1"))
def representative_class(v):
    return resolve.representative_class(_master(v))


def _wanted(v):
    return v.table("lineitem").selectExpr("concat(' f', l_partkey, if(l_returnflag = 'R', 'z', if(l_linenumber < 4, 'x', 'a'))) as ticker")


V_WANT = "v_want AS (SELECT DISTINCT 'F' || l_partkey || CASE WHEN l_returnflag = 'R' THEN 'Z' WHEN l_linenumber < 4 THEN 'X' ELSE 'A' END AS ticker FROM lineitem)"


@query(with_views(V_MASTER, V_WANT, body="""
SELECT w.ticker, coalesce(m.cik, c.cik) AS cik, coalesce(CAST(m.series_id AS VARCHAR), c.series_id) AS series_id, coalesce(CAST(m.class_id AS VARCHAR), c.class_id) AS class_id,
  CASE WHEN m.cik IS NOT NULL THEN 'master' WHEN c.cik IS NOT NULL THEN 'census' END AS source, CASE WHEN m.cik IS NOT NULL OR c.cik IS NOT NULL THEN 'HIT' ELSE 'ABSENT' END AS verdict
FROM v_want w LEFT JOIN v_master m ON m.ticker = w.ticker LEFT JOIN (SELECT 'F' || c_custkey || 'Z' AS ticker, CAST(c_nationkey AS BIGINT) AS cik, 'S' || c_custkey AS series_id, 'C' || c_custkey AS class_id FROM customer) c ON c.ticker = w.ticker"""))
def ticker_resolution(v):
    master = _master(v).withColumn("series_id", F.col("series_id").cast("string")).withColumn("class_id", F.col("class_id").cast("string"))
    census = v.table("customer").selectExpr("concat('F', c_custkey, 'Z') as ticker", "cast(c_nationkey as bigint) as cik", "concat('S', c_custkey) as series_id", "concat('C', c_custkey) as class_id")
    return resolve.resolve_tickers(_wanted(v), master, census, None)


@query(with_views(V_HEAD, V_MASTER, V_WANT, body="""
, v_all AS (SELECT ticker FROM v_want UNION SELECT ticker FROM v_head WHERE ticker IS NOT NULL),
v_h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, accession_no, class_id) AS rn FROM v_head WHERE ticker IS NOT NULL) q WHERE rn = 1)
SELECT w.ticker, coalesce(m.cik, h.cik) AS cik, coalesce(CAST(m.series_id AS VARCHAR), h.series_id) AS series_id, coalesce(CAST(m.class_id AS VARCHAR), h.class_id) AS class_id,
  CASE WHEN m.cik IS NOT NULL THEN 'master' WHEN h.cik IS NOT NULL THEN 'header' END AS source, CASE WHEN m.cik IS NOT NULL OR h.cik IS NOT NULL THEN 'HIT' ELSE 'UNAVAILABLE' END AS verdict
FROM v_all w LEFT JOIN v_master m ON m.ticker = w.ticker LEFT JOIN v_h h ON h.ticker = w.ticker"""))
def ticker_resolution_without_census(v):
    master = _master(v).withColumn("series_id", F.col("series_id").cast("string")).withColumn("class_id", F.col("class_id").cast("string"))
    h = indexes.header_classes(_headers(v))
    return resolve.resolve_tickers(_wanted(v).unionByName(h.select("ticker").filter(F.col("ticker").isNotNull())), master, None, h)


def _cusips(v):
    rows = v.table("part").selectExpr(
        "if(p_size = 50, concat(lpad(p_partkey, 9, '0'), 'x'), lpad(p_partkey, 9, '0')) as cusip", "concat('F', p_partkey, if(p_size <= 25, 'X', if(p_size < 40, 'A', 'Q'))) as ticker")
    return resolve.cusip_classes(rows, _master(v))


@query(with_views(V_MASTER, body="SELECT lpad(CAST(class_id AS VARCHAR), 9, '0') AS cusip, ticker, series_id FROM v_master JOIN part ON p_partkey = class_id WHERE p_size < 40"))
def cusip_classes(v):
    return _cusips(v).select("cusip", "ticker", "id.series_id")


_TICKER_NAME = ("CASE l_linenumber WHEN 1 THEN p_name || ' (' || upper(substr(replace(p_name, ' ', ''), 1, 4)) || 'X)' WHEN 2 THEN p_name || ' (' || upper(substr(replace(p_name, ' ', ''), 1, 2)) || 'X)'"
                " WHEN 3 THEN '(FUNDX) ' || p_name || ' (LATERX)' WHEN 4 THEN p_name || ' (' || upper(substr(replace(p_name, ' ', ''), 1, 6)) || 'X)' WHEN 5 THEN p_name || ' (abcdx)' WHEN 6 THEN p_name || ' [ABCDX]' ELSE p_name || ' (ABCDY)' END")


@query(f"""
SELECT name, nullif(regexp_extract(name, '\\(([A-Z]{{3,5}}X)\\)', 1), '') AS ticker, count(*) AS positions
FROM (SELECT {_TICKER_NAME} AS name FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY ALL""")
def embedded_tickers(v):
    """Tickers that stand in brackets in a position's name; too short, too long, small letters and other brackets do not count."""
    rows = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.expr(_TICKER_NAME).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("positions")).select("name", N.embedded_ticker(F.col("name")).alias("ticker"), "positions")


def _messy_name():
    """A reported position name around the fund's own name."""
    return ("case l_linenumber when 1 then concat('Fund ', s_name, ' - Investor Shares') when 2 then concat('Some Trust: ', s_name) when 3 then concat(s_name, '; SL Agency Shares')"
            " when 4 then concat('The ', upper(s_name), ', Class R6') when 5 then concat(s_name, ' Intl Mkt') else s_name end")


def _name_rows(v):
    li, s = v.table("lineitem"), v.table("supplier")
    return li.join(s, li.l_suppkey == s.s_suppkey).selectExpr(
        f"{_messy_name()} as name", "s_suppkey", "l_linenumber")


_SN = "replace(s_name, '#', ' ')"
_NAMES = f"""v_name AS (SELECT DISTINCT CASE l_linenumber WHEN 1 THEN 'Fund ' || s_name || ' - Investor Shares' WHEN 2 THEN 'Some Trust: ' || s_name WHEN 3 THEN s_name || '; SL Agency Shares'
  WHEN 4 THEN 'The ' || upper(s_name) || ', Class R6' WHEN 5 THEN s_name || ' Intl Mkt' ELSE s_name END AS name, s_suppkey, l_linenumber, s_acctbal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query(with_views(V_MASTER, _NAMES, body="""
, v_rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, series_id ORDER BY CASE WHEN ticker LIKE '%X' THEN 0 ELSE 1 END, ticker, class_id) AS rn FROM v_master) q WHERE rn = 1)
SELECT DISTINCT name, r.ticker, r.series_id FROM v_name n LEFT JOIN v_rep r ON r.series_id = n.s_suppkey AND CASE l_linenumber WHEN 1 THEN false WHEN 5 THEN s_acctbal < 5000 ELSE NOT (s_acctbal > 9000) END"""))
def name_resolution(v):
    """Names resolve through peeling, cutting and expansion; names shared by two series do not."""
    s = v.table("supplier")
    ids = [F.col("s_nationkey").cast("bigint").alias("cik"), F.col("s_suppkey").alias("series_id")]
    universe = resolve.union_all([
        s.select(F.col("s_name").alias("series_name"), *ids),
        s.filter(F.col("s_acctbal") < 5000).select(F.concat("s_name", F.lit(" International Markets")).alias("series_name"), *ids),
        s.filter(F.col("s_acctbal") > 9000).select(F.col("s_name").alias("series_name"), F.lit(-1).cast("bigint").alias("cik"), (-F.col("s_suppkey") - 1).alias("series_id")),
    ])
    return resolve.resolve_names(_name_rows(v).select("name").distinct(), universe, _master(v)).select("name", "ticker", "series_id")


@query(with_views(V_HOLDING, V_MASTER, body="""
SELECT resolved_by, count(*) AS positions, CAST(sum(value_usd) AS DOUBLE) AS value_usd, count(DISTINCT series) AS series FROM (
  SELECT h.value_usd, CASE WHEN p_size < 40 AND linenumber <= 4 THEN 'cusip' WHEN contains(h.name, 'bolt') THEN 'name' WHEN p_size < 40 AND p_brand <> 'Brand#5' THEN 'isin' END AS resolved_by,
    CASE WHEN p_size < 40 AND linenumber <= 4 THEN partkey % (SELECT count(*) FROM supplier) WHEN contains(h.name, 'bolt') THEN -7 WHEN p_size < 40 AND p_brand <> 'Brand#5' THEN partkey % (SELECT count(*) FROM supplier) END AS series
  FROM v_holding h JOIN part ON p_partkey = partkey) q GROUP BY 1"""))
def holding_resolution(v):
    """By identifier, then by name, then by the identifier inside the ISIN; later lines of an order carry no identifier."""
    h = v.holding().withColumn("cusip", F.when(F.col("linenumber") <= 4, F.col("cusip")).otherwise(""))
    keys = h.select("name", "cusip", "isin").distinct()
    names = keys.select("name").distinct().select(
        "name", F.lit("BOLTX").alias("ticker"), F.lit(1).cast("bigint").alias("cik"),
        F.when(F.col("name").contains("bolt"), F.lit(-7)).cast("bigint").alias("series_id"), F.lit(1).cast("bigint").alias("class_id"))
    r = resolve.resolve_holdings(keys, _cusips(v), names)
    return h.select("name", "cusip", "isin", "value_usd").join(r.select("name", "cusip", "isin", "resolved_by", F.col("series_id").alias("_s")), ["name", "cusip", "isin"]).groupBy("resolved_by").agg(
        F.count("*").alias("positions"), dbl(F.sum("value_usd")).alias("value_usd"), F.countDistinct("_s").alias("series"))


@query(with_views(V_FEE, body="SELECT series_id, filing_date, accession_no, form_type FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY filing_date DESC, accession_no DESC) AS rn FROM v_fee) q WHERE rn = 1"))
def latest_filing(v):
    return resolve.latest_filing(v.fee_snapshot().select("series_id", "filing_date", "accession_no", "form_type"))


V_NC2 = "v_nc AS (SELECT l_suppkey AS series_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS commissions FROM lineitem GROUP BY 1)"


@query(with_views(V_FUND, V_NC2, body="""
SELECT f.series_id, ticker, CASE WHEN has_ncen THEN upper(fund_name) ELSE fund_name END AS fund_name, CASE WHEN has_ncen THEN coalesce('Adviser ' || category, family) ELSE family END AS family, CASE WHEN has_ncen THEN commissions END AS commissions,
  CASE WHEN has_nport THEN commissions * 2 END AS net_assets, CASE WHEN soft_dollar_flag THEN prospectus_turnover END AS er_bps, has_ncen AS ncen_available, has_nport AS nport_available FROM v_fund f JOIN v_nc USING (series_id)"""))
def fund_profile(v):
    f = v.fund()
    nc = v.table("lineitem").groupBy(F.col("l_suppkey").alias("series_id")).agg(dbl(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).alias("commissions"))
    ncen = f.filter("has_ncen").join(nc, "series_id").select("series_id", F.upper("fund_name").alias("fund_name"), F.concat(F.lit("Adviser "), "category").alias("adviser"), "commissions")
    nport = f.filter("has_nport").join(nc, "series_id").select("series_id", (F.col("commissions") * 2).alias("net_assets"))
    er = f.filter("soft_dollar_flag").select("series_id", F.col("prospectus_turnover").alias("er_bps"))
    return resolve.fund_profile(f, ncen, nport, er)


V_ALIAS = "v_alias AS (SELECT n_nationkey AS position, n_name AS alias, 'T' || n_regionkey AS ticker, n_name || ' Fund' AS name FROM nation)"


def _aliases(v):
    return v.table("nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("alias"),
                                    F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("ticker"), F.concat("n_name", F.lit(" Fund")).alias("name"))


def _asked(v):
    c, n = v.table("customer"), v.table("nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.lower(F.substring("n_name", 4, 20)).alias("query"))


@query(with_views(V_ALIAS, body="""
, v_q AS (SELECT DISTINCT upper(substr(n_name, 4, 20)) AS query FROM customer JOIN nation ON c_nationkey = n_nationkey),
v_hit AS (SELECT query, ticker, strpos(alias, query) AS spot, length(name) AS n, position, name, row_number() OVER (PARTITION BY query, ticker ORDER BY position) AS rn FROM v_q JOIN v_alias ON contains(alias, query))
SELECT query, rank, ticker, name FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY spot, n, position) AS rank FROM v_hit WHERE rn = 1) z WHERE rank <= 3"""))
def alias_search(v):
    return resolve.alias_search(_asked(v), _aliases(v), 3)


@query("""SELECT input, regexp_matches(upper(trim(input)), '^[A-Za-z]{1,6}$') AS looks_like_ticker, CASE WHEN input = 'spy' THEN 'ERR_ETF_NOT_SUPPORTED' WHEN input = ' aapl' THEN 'ERR_STOCK_NOT_FUND' WHEN input LIKE 'BUILD%' THEN NULL WHEN input LIKE 'HOUSE%' THEN 'ERR_FUND_NAME_NOT_TICKER' ELSE 'ERR_FUND_NOT_FOUND' END AS reject_reason,
  CASE WHEN input LIKE 'HOUSE%' THEN 'HOUSX' END AS suggestion, n AS inputs FROM (SELECT CASE WHEN c_nationkey = 1 THEN 'spy' WHEN c_nationkey = 2 THEN ' aapl' ELSE c_mktsegment END AS input, count(*) AS n FROM customer GROUP BY 1) q""")
def input_triage(v):
    asked = v.table("customer").selectExpr("case c_nationkey when 1 then 'spy' when 2 then ' aapl' else c_mktsegment end as input")
    c = v.table("customer").select("c_mktsegment").distinct()
    universe = c.filter("c_mktsegment like 'BUILD%'").select(F.col("c_mktsegment").alias("ticker"))
    hints = c.filter("c_mktsegment like 'HOUSE%'").select(F.col("c_mktsegment").alias("query"), F.lit("HOUSX").alias("ticker"))
    return resolve.triage(asked, universe, hints).groupBy("input", "looks_like_ticker", "reject_reason", "suggestion").agg(F.count("*").alias("inputs"))


@query(with_views(V_HOLDING, body="SELECT isin, count(*) AS positions, CASE WHEN isin LIKE 'US%' AND length(isin) = 12 THEN substr(isin, 3, 9) END AS cusip FROM v_holding GROUP BY 1"))
def isin_to_cusip(v):
    return v.holding().groupBy("isin").agg(F.count("*").alias("positions")).withColumn("cusip", N.isin_cusip(F.col("isin")))


# -- fee documents ----------------------------------------------------------------------------


def _fee_docs(v: FundViews) -> DataFrame:
    """Fee-table pages: two class columns, an untagged layout for some, noise and a late net row."""
    row = lambda label, c: f"if({c} is null, '', concat('<tr><td>{label}</td>', if(col = 0, concat('<td>', {c}, '%</td><td>9.99%</td>'), concat('<td>9.99%</td><td>', {c}, ' %</td>')), '</tr>'))"
    flat = lambda label, c: f"if({c} is null, '', concat('<tr><td><div>{label}</div></td><td><div>', {c}, '%</div></td></tr>'))"
    rows = lambda f: "concat(" + ", ".join(f(a, b) for a, b in (
        ("Management Fees", "management_fee"), ("Distribution and/or Service (12b-1) Fees", "twelve_b1_fee"), ("Other&nbsp;Expenses", "other_expenses"),
        ("Acquired Fund Fees and Expenses", "acquired_fund_fees"), ("Total Annual Fund Operating Expenses", "total_annual_expenses"),
        ("<b>Total Annual Fund Operating Expenses After</b> Fee Waiver", "net_expenses"))) + ")"
    src = v.dealt(v.fee_snapshot()).withColumn("col", F.when(F.col("form_type") == "485APOS", 1).otherwise(0))
    for c in ("management_fee", "twelve_b1_fee", "other_expenses", "acquired_fund_fees", "total_annual_expenses", "net_expenses"):
        src = src.withColumn(c, F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))))
    return src.selectExpr(
        "accession_no", "concat('T', class_id) as ticker",
        f"""concat('<?xml version="1.0" encoding="UTF-8"?><html><body>', repeat('<p>filler text.</p>', 60), if(class_id < 100, concat('<table>', {rows(flat)}, '</table>'),
          concat('<h2>Annual Fund Operating Expenses</h2><table><tr><td></td><td>', if(col = 0, concat('Class T', class_id), 'Other'), '</td><td>', if(col = 1, concat('Class T', class_id), 'Other'), '</td></tr>', {rows(row)}, '<tr><td>* Management fee footnote</td><td></td></tr></table>')),
          '<p>The maximum sales charge is ', format_string('%.2f', max_sales_load), '% and the portfolio turnover rate was ', cast(portfolio_turnover as int), ' % of value.</p></body></html>') as html""",
    )


_FEECOLS = "management_fee, twelve_b1_fee, other_expenses, acquired_fund_fees, total_annual_expenses, net_expenses"


@query(with_views(V_FEE, body=f"""SELECT accession_no, CASE WHEN management_fee IS NULL THEN NULL WHEN class_id < 100 AND total_annual_expenses IS NULL AND net_expenses IS NULL THEN 'cells' ELSE 'table' END AS layout, {_FEECOLS.replace("net_expenses", "CASE WHEN management_fee IS NOT NULL THEN net_expenses END AS net_expenses")}, CAST(NULL AS DOUBLE) AS fee_waiver,
  portfolio_turnover, CASE WHEN management_fee IS NOT NULL THEN max_sales_load END AS max_sales_load FROM v_fee"""))
def fee_tables(v):
    return fees.table_fees(_fee_docs(v), "accession_no", "html", "ticker")


def _class_docs(v):
    f2 = lambda c: f"format_string('%.2f', coalesce({c}, 0))"
    return v.dealt(v.fee_snapshot()).selectExpr(
        "accession_no", "'Class R-6' as class_name",
        f"""if(management_fee is null, '<p>Share class: A R-6 </p><p>no fees are given</p>', concat('<p>Share class: A R-6 </p><p>Maximum sales charge 5.75 none</p>', repeat('<i>padding words here</i> ', 20), '<table><tr><td>Share class:&nbsp;</td><td>A</td><td>C</td><td>R-6</td></tr><tr><td>Management&nbsp;fees</td><td>0.11 0.12</td><td>', {f2('management_fee')},
          '</td></tr><tr><td>Distribution and/or service (12b-1) fees</td><td>0.24</td><td>1.00 ', if(twelve_b1_fee is null, 'none', {f2('twelve_b1_fee')}), '</td></tr><tr><td>Other expenses </td><td>0.10 0.10 ', {f2('other_expenses')}, '</td></tr><tr><td>Total annual fund operating expenses </td><td>0.61 1.31 ',
          {f2('management_fee + coalesce(twelve_b1_fee, 0) + other_expenses')}, '</td></tr>', if(net_expenses is null, '', concat('<tr><td>Fee waiver 1 </td><td>0.01 0.01 0.01</td></tr><tr><td>Total annual fund operating expenses after fee waiver </td><td>0.60 1.30 ', {f2('net_expenses')}, '</td></tr>')), '</table>')) as html""",
    )


@query(with_views(V_FEE, body=f"""SELECT accession_no, 'R-6' AS class_label, 3 AS n_classes, management_fee, coalesce(twelve_b1_fee, 0) AS twelve_b1_fee, other_expenses, {R('management_fee + coalesce(twelve_b1_fee, 0) + other_expenses')} AS total_annual_expenses, net_expenses,
  CASE WHEN net_expenses IS NOT NULL THEN 0.01::DOUBLE END AS fee_waiver FROM v_fee WHERE management_fee IS NOT NULL"""))
def class_table_fees(v):
    return fees.class_table_fees(_class_docs(v), "accession_no", "html", "class_name")


def _prose_docs(v):
    f2 = lambda c: f"format_string('%.2f', {c})"
    return v.dealt(v.fee_snapshot()).selectExpr(
        "accession_no", "concat('Fidelity Series Growth ', class_id) as series_name",
        f"""concat('<p>Fund Summary Fund: Fidelity&#174; Series Other</p><p>Management fee 9.99 %</p><p>Total annual operating expenses 9.99 %</p><h1>Fund&nbsp;Summary</h1> <b>Fund:</b> Fidelity&#174; Series Growth ', class_id, '<p>', if(management_fee is null, 'no fees given', concat('Management fee ', {f2('management_fee')},
          ' % Distribution and/or Service (12b-1) fees ', if(twelve_b1_fee is null, 'None', {f2('twelve_b1_fee')}), ' Other expenses ', {f2('other_expenses')}, ' % Total annual operating expenses ', {f2('management_fee + coalesce(twelve_b1_fee, 0) + other_expenses')}, ' % ')),
          '</p>the fund&#39;s', if(portfolio_turnover is null, '', concat(' and the fund&rsquo;s portfolio turnover rate was ', cast(portfolio_turnover as int), ' % ')), '<p>Fund Summary Fund: Fidelity Series Next Management fee 8.88</p>') as html""",
    )


@query(with_views(V_FEE, body=f"""SELECT accession_no, management_fee, coalesce(twelve_b1_fee, 0) AS twelve_b1_fee, other_expenses, {R('management_fee + coalesce(twelve_b1_fee, 0) + other_expenses')} AS total_annual_expenses, CAST(NULL AS DOUBLE) AS net_expenses, CAST(NULL AS DOUBLE) AS fee_waiver, portfolio_turnover
  FROM v_fee WHERE management_fee IS NOT NULL"""))
def prose_fees(v):
    return fees.prose_fees(_prose_docs(v), "accession_no", "html", "series_name")


def _tagged_facts(v):
    f = v.fee_snapshot()
    tags = {c: f"{n}" for n, c in fees.CONCEPTS.items()}
    ns = F.when(F.col("form_type") == "485APOS", "rr:").otherwise("oef:")
    fact = lambda concept, value, text, at: F.struct(concept.alias("concept"), value.alias("numeric_value"), text.alias("value"), F.lit(at).alias("position"))
    null, nostr = F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = [
        F.when(F.col(c).isNotNull(), fact(F.concat(ns, F.lit(tags[c])), F.col(c) / 100 if c != "other_expenses" else null,
                                          nostr if c != "other_expenses" else (F.col(c) / 100).cast("string"), i))
        for i, c in enumerate(("management_fee", "twelve_b1_fee", "other_expenses", "acquired_fund_fees", "total_annual_expenses", "net_expenses"))
    ]
    rows.append(F.when(F.col("management_fee").isNotNull(), fact(F.lit("rr:ManagementFeesOverAssets"), F.lit(0.99), nostr, 99)))
    rows.append(fact(F.lit("us-gaap:Assets"), F.lit(1.0), nostr, 100))
    sid, cid = F.format_string("S%09d", "series_id"), F.format_string("C%09d", "class_id")
    context = F.when(F.col("form_type") == "485APOS", F.concat(sid, F.lit("Member_"), cid, F.lit("Member"))).otherwise(
        F.concat(F.lit("Context_20250831_20250831_"), cid, F.lit("Member_"), sid, F.lit("Member_")))
    return f.select("accession_no", context.alias("context_ref"), F.inline(F.array_compact(F.array(*rows))))


V_TAG = """
v_tag AS (SELECT accession_no, 'S' || lpad(CAST(series_id AS VARCHAR), 9, '0') AS series_id, 'C' || lpad(CAST(class_id AS VARCHAR), 9, '0') AS class_id, management_fee, twelve_b1_fee, other_expenses, acquired_fund_fees, total_annual_expenses,
  CAST(NULL AS DOUBLE) AS fee_waiver, net_expenses, filing_date FROM v_fee WHERE management_fee IS NOT NULL)"""


@query(with_views(V_FEE, V_TAG, body="SELECT * EXCLUDE (filing_date), false AS implausible FROM v_tag"))
def tagged_fees(v):
    return fees.tagged_fees(_tagged_facts(v))


@query(with_views(V_FEE, V_TAG, body="""
SELECT series_id, class_id, accession_no, filing_date, management_fee, total_annual_expenses FROM (SELECT t.*, row_number() OVER (PARTITION BY t.series_id, t.class_id ORDER BY filing_date DESC, accession_no DESC) AS rn FROM v_tag t) q WHERE rn = 1"""))
def first_filing_with_facts(v):
    filings = v.fee_snapshot().select(F.format_string("S%09d", "series_id").alias("series_id"), "accession_no", "filing_date")
    out = fees.first_with_facts(filings, fees.tagged_fees(_tagged_facts(v)))
    return out.select("series_id", "class_id", "accession_no", "filing_date", "management_fee", "total_annual_expenses")


V_CAND = """
v_cand AS (SELECT * EXCLUDE (rn) FROM (SELECT f.class_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'class_table' WHEN '2-HIGH' THEN 'prose' WHEN '3-MEDIUM' THEN 'summary_parsed' WHEN '4-NOT SPECIFIED' THEN 'summary_table' ELSE 'tagged' END AS source,
    management_fee, twelve_b1_fee, other_expenses, acquired_fund_fees, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND management_fee < 0.75 THEN NULL ELSE total_annual_expenses END AS total_annual_expenses, net_expenses, portfolio_turnover, max_sales_load,
    max_sales_load < 4 AS ticker_matched, row_number() OVER (PARTITION BY f.class_id, o_orderpriority ORDER BY filing_date DESC, accession_no DESC) AS rn FROM v_fee f JOIN orders ON o_orderkey = accession_no) q WHERE rn = 1),
v_u AS (SELECT * REPLACE (CASE WHEN source = 'tagged' THEN coalesce(total_annual_expenses, round(management_fee + coalesce(twelve_b1_fee, 0) + other_expenses + coalesce(acquired_fund_fees, 0), 4)) ELSE coalesce(total_annual_expenses, CASE WHEN source = 'summary_table' THEN round(management_fee + twelve_b1_fee + other_expenses, 2) END) END AS total_annual_expenses)
  FROM v_cand WHERE (source IN ('class_table', 'prose') AND total_annual_expenses IS NOT NULL) OR (source = 'summary_parsed' AND coalesce(management_fee, total_annual_expenses, net_expenses) IS NOT NULL)
    OR (source = 'summary_table' AND ticker_matched AND coalesce(management_fee, total_annual_expenses) IS NOT NULL) OR (source = 'tagged' AND coalesce(management_fee, total_annual_expenses) IS NOT NULL))"""


@query(with_views(V_FEE, V_CAND, body=f"""
, v_best AS (SELECT u.*, min(CASE WHEN source = 'class_table' THEN 1 WHEN source = 'prose' THEN 2 WHEN source = 'summary_parsed' THEN 3 END) OVER (PARTITION BY class_id) AS top,
    max(CASE WHEN source = 'summary_table' THEN coalesce(net_expenses, total_annual_expenses) END) OVER (PARTITION BY class_id) AS tr, max(CASE WHEN source = 'tagged' THEN coalesce(net_expenses, total_annual_expenses) END) OVER (PARTITION BY class_id) AS gr,
    max(CASE WHEN source = 'summary_table' THEN 1 ELSE 0 END) OVER (PARTITION BY class_id) AS has_t, max(CASE WHEN source = 'tagged' THEN 1 ELSE 0 END) OVER (PARTITION BY class_id) AS has_g FROM v_u u)
SELECT class_id, source, management_fee, twelve_b1_fee, other_expenses, acquired_fund_fees, total_annual_expenses, CAST(NULL AS DOUBLE) AS fee_waiver, net_expenses, portfolio_turnover, max_sales_load FROM v_best
WHERE source = CASE WHEN top = 1 THEN 'class_table' WHEN top = 2 THEN 'prose' WHEN top = 3 THEN 'summary_parsed' WHEN tr IS NULL AND gr IS NOT NULL THEN 'tagged' WHEN has_t = 1 THEN 'summary_table' ELSE 'tagged' END"""))
def fee_source_cascade(v):
    o = v.table("orders").select(F.col("o_orderkey").alias("accession_no"), "o_orderpriority")
    c = v.fee_snapshot().join(o, "accession_no")
    pr = F.col("o_orderpriority")
    c = c.select(
        "class_id", F.when(pr == "1-URGENT", "class_table").when(pr == "2-HIGH", "prose").when(pr == "3-MEDIUM", "summary_parsed").when(pr == "4-NOT SPECIFIED", "summary_table").otherwise("tagged").alias("source"),
        "management_fee", "twelve_b1_fee", "other_expenses", "acquired_fund_fees", F.lit(None).cast("double").alias("fee_waiver"),
        F.when(~((pr == "4-NOT SPECIFIED") & (F.col("management_fee") < 0.75)), F.col("total_annual_expenses")).alias("total_annual_expenses"),
        "net_expenses", "portfolio_turnover", "max_sales_load", (F.col("max_sales_load") < 4).alias("ticker_matched"), "filing_date", "accession_no",
    )
    body = F.struct(*[x for x in c.columns if x not in ("class_id", "source")])
    c = c.groupBy("class_id", "source").agg(F.max_by(body, F.struct("filing_date", "accession_no")).alias("b")).select("class_id", "source", "b.*")
    return fees.fee_cascade(c)


@query(with_views(V_HEAD, body="""
, v_w AS (SELECT DISTINCT c_mktsegment AS ticker, CAST(NULL AS VARCHAR) AS class_id, CAST(NULL AS VARCHAR) AS series_id, false AS single FROM customer UNION ALL
  SELECT 'ZZ' || c_custkey, CASE WHEN c_acctbal > 0 THEN 'C' || lpad(CAST(c_custkey * 2 AS VARCHAR), 9, '0') END, 'S' || lpad(CAST(c_custkey + 500000000 AS VARCHAR), 9, '0'), c_nationkey < 12 FROM customer),
v_m AS (SELECT w.ticker, accession_no, filing_date, 1 AS how, 0 AS late FROM v_w w JOIN v_head h ON h.ticker = w.ticker UNION ALL SELECT w.ticker, accession_no, filing_date, 2, 0 FROM v_w w JOIN v_head h ON h.class_id = w.class_id
  UNION ALL SELECT w.ticker, accession_no, filing_date, 3, 0 FROM v_w w JOIN v_head h ON h.series_id = w.series_id AND single UNION ALL SELECT 'ZZ' || c_custkey, c_custkey, DATE '2023-01-01' + c_nationkey, 4, 1 FROM customer)
SELECT ticker, accession_no, CAST(filing_date AS DATE) AS filing_date, CASE how WHEN 1 THEN 'header_ticker' WHEN 2 THEN 'class_id' WHEN 3 THEN 'series_id' ELSE 'body' END AS matched_by
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY late, filing_date DESC, how, accession_no) AS rn FROM v_m) q WHERE rn = 1"""))
def filing_ticker_match(v):
    c = v.table("customer")
    null = F.lit(None).cast("string")
    wanted = c.select(F.col("c_mktsegment").alias("ticker"), null.alias("class_id"), null.alias("series_id"), F.lit(False).alias("single_class")).distinct().unionByName(c.selectExpr(
        "concat('ZZ', c_custkey) as ticker", "if(c_acctbal > 0, concat('C', lpad(c_custkey * 2, 9, '0')), null) as class_id", "concat('S', lpad(c_custkey + 500000000, 9, '0')) as series_id", "c_nationkey < 12 as single_class"))
    bodies = c.selectExpr("c_custkey as accession_no", "date_add(date'2023-01-01', c_nationkey) as filing_date", "concat('<p>fees of ', 'ZZ', c_custkey, ' and more</p>') as html")
    return fees.match_filings(wanted, indexes.header_classes(_headers(v)), bodies)


# -- prose ------------------------------------------------------------------------------------

_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]"


@query(f"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '{_WS}+', ' ', 'g')) AS t FROM
  (SELECT page_id, html FROM pages) p) q""")
def page_text(v):
    return v.table("pages").select("page_id", X.plain_text(F.col("html"), "report").alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query(r"""SELECT doc_id, len(x) AS amounts, round(list_sum(list_transform(x, lambda a: CAST(replace(a, ',', '') AS DOUBLE))), 2) AS total, ' or $ ' || doc_id || ' due; ' || source AS last_context FROM (
  SELECT doc_id, source, list_filter(regexp_extract_all(text || ' fee of $' || format('{:,.2f}', n_chars * 1000 + 0.25) || ' or $ ' || doc_id || ' due; ' || source, '\$\s*([\d,]+(?:\.\d+)?)', 1), lambda a: replace(a, ',', '') <> '') AS x FROM documents) q""")
def dollar_amounts(v):
    text = F.expr("concat(text, ' fee of $', format_number(n_chars * 1000 + 0.25, 2), ' or $ ', doc_id, ' due; ', source)")
    d = v.table("documents").select("doc_id", X.dollar_amounts(text).alias("x"))
    return d.select("doc_id", F.size("x").alias("amounts"), F.round(F.aggregate("x", F.lit(0.0), lambda a, r: a + r["amount"]), 2).alias("total"),
                    F.element_at("x", -1)["context"].alias("last_context"))


_WORDS = r"list_filter(string_split_regex(text, '[^\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{2,}'))"
_SYL = "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, g - CASE WHEN w LIKE '%e' AND g > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(w, '[^aeiouy]le$') THEN 1 ELSE 0 END) END"
_B, _E2 = r"(^|[^\p{L}\p{M}\p{N}_])", r"($|[^\p{L}\p{M}\p{N}_])"
_W = r"[\p{L}\p{M}\p{N}_]"
_PART = f"({_W}+ed|bought|sold|made|put|set|held|taken|given|sent|shown)"
_PASS = f"(?i)({_B}(is|are|was|were|been|be){_WS}+{_PART}{_E2}|{_B}(is|are|was|were|been|being|be){_WS}+being{_WS}+{_W}+|{_B}(is|are|was|were){_WS}+not{_WS}+{_PART}{_E2})"
_FT = "expense|fee|commission|cost|charge"
V_READ = f"""
v_src AS (SELECT doc_id AS id, text, length(text) AS n FROM documents),
v_w AS (SELECT id, count(*) AS words, CAST(sum(s) AS INTEGER) AS syl, count(*) FILTER (s >= 3) AS complex FROM (SELECT id, {_SYL} AS s FROM (SELECT id, w, len(regexp_extract_all(w, '[aeiouy]+')) AS g FROM (SELECT id, lower(unnest({_WORDS})) AS w FROM v_src WHERE n >= 20) a) b) c GROUP BY 1),
v_s AS (SELECT id, count(*) AS sents, count(*) FILTER (regexp_matches(s, '{_PASS}')) AS passive FROM (SELECT id, regexp_replace(unnest(string_split_regex(text, '[.!?]+')), '^{_WS}+|{_WS}+$', '', 'g') AS s FROM v_src WHERE n >= 20) a WHERE length(s) > 10 GROUP BY 1),
v_f AS (SELECT id, len(regexp_extract_all(text, '(?i){_FT}')) AS terms, length(regexp_extract(text, '(?is)^(.*)(?:{_FT})', 1)) - length(regexp_extract(text, '(?is)^(.*?)(?:{_FT})', 1)) AS spread FROM v_src),
v_m AS (SELECT v_src.id, n, coalesce(words, 0) AS words, coalesce(sents, 0) AS sents, coalesce(syl, 0) AS syl, coalesce(complex, 0) AS complex, coalesce(passive, 0) AS passive, terms, spread, coalesce(words, 0) > 0 AND coalesce(sents, 0) > 0 AS ok FROM v_src JOIN v_f USING (id) LEFT JOIN v_w USING (id) LEFT JOIN v_s USING (id)),
v_g AS (SELECT *, CASE WHEN ok THEN {R('0.39::DOUBLE * (words::DOUBLE / sents) + 11.8::DOUBLE * (syl / words::DOUBLE) - 15.59::DOUBLE', 1)} ELSE 0 END AS fk, CASE WHEN ok THEN {R('0.4::DOUBLE * (words::DOUBLE / sents + 100 * (complex / words::DOUBLE))', 1)} ELSE 0 END AS fog,
  CASE WHEN ok THEN {R('passive / sents::DOUBLE * 100', 1)} ELSE 0 END AS pv FROM v_m),
v_p AS (SELECT *, CASE WHEN ok THEN {R('greatest(least(((fk + fog) / 2 - 10) * 8.33::DOUBLE, 100), 0)', 1)} ELSE 0 END AS rs, CASE WHEN ok AND words >= 3000 THEN {R('greatest(least((words - 3000) / 270.0::DOUBLE, 100), 0)', 1)} ELSE 0 END AS ls,
  CASE WHEN ok AND terms > 2 THEN {R('least(spread / n::DOUBLE * 120, 100)', 1)} ELSE 0 END AS fs, CASE WHEN ok THEN {R('greatest(least((pv - 10) * 4, 100), 0)', 1)} ELSE 0 END AS ps FROM v_g)"""


# markup around every document: footnotes by its length, references by its source and language, tables in tables
_NOTES, _REFS = "CAST(floor(n_chars / 500.0) AS INTEGER)", "(length(source) - 3 + CASE WHEN lang = 'de' THEN 4 ELSE 0 END)"
_DEEP = "(CASE WHEN n_chars > 3000 THEN 3 WHEN n_chars > 1000 THEN 2 ELSE 0 END)"


@query(with_views(V_READ, body=f"""
SELECT *, CASE WHEN word_count = 0 THEN '' WHEN overall_score < 20 THEN 'A' WHEN overall_score < 35 THEN 'B' WHEN overall_score < 50 THEN 'C' WHEN overall_score < 70 THEN 'D' ELSE 'F' END AS grade FROM (
SELECT id AS doc_id, CASE WHEN ok THEN words ELSE 0 END AS word_count, CASE WHEN ok THEN sents ELSE 0 END AS sentence_count, CASE WHEN ok THEN {_NOTES} ELSE 0 END AS footnote_count, CASE WHEN ok THEN {_REFS} ELSE 0 END AS cross_reference_count, CASE WHEN ok THEN {_DEEP} ELSE 0 END AS nesting_depth, CASE WHEN ok THEN {R('words::DOUBLE / sents', 4)} ELSE 0 END AS avg_sentence_length,
  CASE WHEN ok THEN {R('syl / words::DOUBLE', 4)} ELSE 0 END AS avg_word_syllables, fk AS flesch_kincaid_grade, fog AS gunning_fog_index, pv AS passive_voice_pct, rs AS readability_score, ls AS length_score, cs AS complexity_score, fs AS fragmentation_score, ps AS passive_score,
  CASE WHEN ok THEN {R('rs * 0.30::DOUBLE + ls * 0.15::DOUBLE + cs * 0.20::DOUBLE + fs * 0.15::DOUBLE + ps * 0.20::DOUBLE', 1)} ELSE 0 END AS overall_score FROM (SELECT *, CASE WHEN ok THEN {R(f'least({_NOTES} * 3.3::DOUBLE, 33) + least({_REFS} * 5.5::DOUBLE, 33) + least({_DEEP} * 11.0::DOUBLE, 34)', 1)} ELSE 0 END AS cs FROM v_p JOIN (SELECT doc_id AS k, lang, source, n_chars FROM documents) d ON k = id) y) z"""))
def readability(v):
    html = f"concat(repeat('<table>', {_DEEP}), repeat('(1) see below ', {_NOTES}), repeat('see \"x\" ', {_REFS}), repeat('</table>', {_DEEP}))"
    return score(v.table("documents").withColumn("html", F.expr(html)), "doc_id", html="html")


@query(r"""WITH m AS (SELECT page_id, html, regexp_extract_all(html, '(?i)</?div[^>]*>') AS marks FROM pages),
d AS (SELECT page_id, max(depth) AS deepest FROM (SELECT page_id, sum(CASE WHEN t LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM (SELECT page_id, unnest(marks) AS t, generate_subscripts(marks, 1) AS i FROM m) a) b GROUP BY 1)
SELECT page_id, CAST(greatest(coalesce(deepest, 0), 0) AS INTEGER) AS nesting_depth, len(regexp_extract_all(html, '(?i)(?:\(\d+\)|\*{1,3}|†|‡)\s*(?:see|refer|as\s+described)')) AS footnotes, len(regexp_extract_all(html, '(?i)(?:see\s+"|refer\s+to\s+"|as\s+(?:described|discussed)\s+(?:in|under))')) AS cross_references FROM m LEFT JOIN d USING (page_id)""")
def page_structure(v):
    return v.table("pages").select(
        "page_id", X.nesting_depth(F.col("html"), "div").alias("nesting_depth"), F.regexp_count("html", F.lit(X.FOOTNOTE)).alias("footnotes"),
        F.regexp_count("html", F.lit(X.CROSS_REFERENCE)).alias("cross_references"),
    )


_SRest = r"CASE WHEN regexp_matches(text, '(?i)license') THEN regexp_extract(text, '(?is)license.*') WHEN regexp_matches(text, '(?i)the\s') THEN regexp_extract(text, '(?is)the\s.*') END"


@query(rf"""SELECT doc_id, length(s) AS n_chars, md5(s) AS digest FROM (SELECT doc_id, left(r, k) || CASE WHEN regexp_matches(t, '(?i)copyright') THEN regexp_extract(t, '(?is)^(.*?)(?:copyright)', 1) WHEN regexp_matches(t, '(?i)for\s+the') THEN regexp_extract(t, '(?is)^(.*?)(?:for\s+the)', 1) ELSE t END AS s
  FROM (SELECT doc_id, r, k, substr(r, k + 1) AS t FROM (SELECT doc_id, r, length(CASE WHEN r ILIKE 'license%' THEN 'license' ELSE regexp_extract(r, '(?i)^the\s') END) AS k FROM (SELECT doc_id, {_SRest} AS r FROM documents) a0) a WHERE r IS NOT NULL) b) c""")
def sections(v):
    s = X.section(F.col("text"), ("license", r"the\s"), ("copyright", r"for\s+the"))
    return v.table("documents").select("doc_id", s.alias("s")).filter(F.col("s").isNotNull()).select("doc_id", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))


def _statement_docs(v):
    """Statements built around every document: prospectus part, header, pay and soft-dollar sections."""
    pad = "repeat(' filler', 160)"
    return v.table("documents").selectExpr(
        "doc_id", "lang", "source", "n_chars",
        f"""concat('<p>', text, '</p>', if(lang = 'de', concat('<p>Compensation generally consists of a fixed base salary and bonus', {pad}, '</p>'), ''), if(lang = 'fr', 'This Statement of Additional Information', '<b>Statement of Additional  Information</b>'),
          if(lang in ('en', 'es'), concat('<p>Compensation generally consists of a fixed base amount. The base salary and a ', if(source < 'src3', 'bonus paid for assets under care', 'bonus paid on relative performance'), if(n_chars > 1000, ' plus restricted stock', ''),
            if(n_chars % 7 = 0, ' and deferred compensation', ''), if(n_chars % 3 = 0, ' tied to company profit', ''), if(n_chars % 5 = 0, ' but not based on returns', ''), {pad}, '</p><p>Proxy voting</p> deferred compensation'), ''),
          if(source > 'src15', concat('<p>Under Section 28(e) the adviser may pay', if(n_chars > 800, ' under a commission sharing plan', ''), {pad}, '</p>'), '')) as html""",
    )


@query("""SELECT doc_id, lang IN ('de', 'en', 'es') AS has_pay, CASE WHEN lang IN ('de', 'en', 'es') THEN true END AS has_base_salary, CASE WHEN lang IN ('en', 'es') THEN n_chars > 1000 WHEN lang = 'de' THEN false END AS has_equity,
  CASE WHEN lang IN ('en', 'es') THEN source < 'src3' WHEN lang = 'de' THEN false END AS linked_to_assets, CASE WHEN source > 'src15' THEN n_chars > 800 END AS uses_commission_sharing, CASE WHEN source > 'src15' THEN true END AS has_soft_dollar, source > 'src15' AS has_soft,
  CASE WHEN lang IN ('de', 'en', 'es') THEN true END AS has_bonus, CASE WHEN lang IN ('en', 'es') THEN n_chars % 7 = 0 WHEN lang = 'de' THEN false END AS has_deferred,
  CASE WHEN lang IN ('en', 'es') THEN source >= 'src3' OR n_chars % 5 = 0 WHEN lang = 'de' THEN false END AS linked_to_performance,
  CASE WHEN lang IN ('en', 'es') THEN n_chars % 3 = 0 WHEN lang = 'de' THEN false END AS linked_to_firm_profit,
  CASE WHEN lang IN ('en', 'es') THEN n_chars % 5 = 0 WHEN lang = 'de' THEN false END AS not_linked_to_performance FROM documents""")
def statement_flags(v):
    f = filing_prose.statement_facts(_statement_docs(v), "doc_id", "html")
    return f.select("doc_id", F.col("pay").isNotNull().alias("has_pay"), "pay.*", "soft.*", F.col("soft").isNotNull().alias("has_soft"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN lang IN ('en', 'es') AND n_chars % 5 = 0 THEN 'pay_not_linked_to_performance' END, CASE WHEN lang IN ('en', 'es') AND source < 'src3' AND n_chars % 5 <> 0 THEN 'pay_linked_to_assets' END, CASE WHEN (lang IN ('en', 'es') AND n_chars <= 1000) OR lang = 'de' THEN 'no_equity_ownership' END,
  CASE WHEN source > 'src15' THEN 'soft_dollar' END, CASE WHEN source > 'src15' AND n_chars > 800 THEN 'commission_sharing' END, CASE WHEN n_chars > 5000 THEN 'soft_dollar_subsidy' END], lambda x: x IS NOT NULL), '|') AS flags FROM documents""")
def statement_conflicts(v):
    d = _statement_docs(v)
    f = filing_prose.statement_facts(d, "doc_id", "html").join(d.select("doc_id", (F.col("n_chars") / 5000).alias("subsidy_bps")), "doc_id")
    return f.select("doc_id", F.concat_ws("|", conflicts.statement_flags(F.col("pay"), F.col("soft"), F.col("subsidy_bps"))).alias("flags"))


@query("""SELECT doc_id, (lang IN ('en', 'es') OR source > 'src15') AS long_part, CASE WHEN lang = 'fr' THEN 'phrase' ELSE 'header' END AS starts_with FROM documents""")
def statement_boundary(v):
    part = filing_prose.after_boundary(F.col("html"))
    return _statement_docs(v).select("doc_id", "lang", part.alias("p")).select(
        "doc_id", (F.length("p") > 700).alias("long_part"), F.when(F.col("p").startswith("This"), "phrase").when(F.col("p").startswith(">"), "header").alias("starts_with"))


def _commission_docs(v):
    """A statement per (fund, order, line): a year-column table, or one row per broker."""
    # parsing is heavy for the bytes it reads: keep all shuffle partitions busy
    n, keys = int(v.spark.conf.get("spark.sql.shuffle.partitions")), ("l_suppkey", "l_orderkey", "l_linenumber")
    # dealt by the key of a document, so that its sums need no further shuffle
    doc = F.struct(*[F.col(k).alias(a) for k, a in zip(keys, ("series_id", "orderkey", "linenumber"), strict=True)]).alias("doc")
    li = v.table("lineitem").select(doc).repartition(n, "doc").groupBy("doc").agg(F.count("*").alias("copies")).select("doc", "copies", "doc.*")
    return li.selectExpr(
        "doc", "copies",
        """concat('<p>intro</p>>Statement of Additional Information< The aggregate brokerage commissions paid are as follows ', if(linenumber <= 4,
          concat('<table><tr><td>Fund(s)</td><td>FY 2022</td><td>FY 2023</td></tr><tr><td>Series <b>P', series_id, '</b></td><td>$</td><td>', format_number(orderkey + 5000, 0), '</td><td>$ ', linenumber * 1000, '.50</td></tr><tr><td>Total</td><td>9</td><td>9999</td></tr></table>'),
          concat('<table><tr><td>Fund</td><td>Year</td><td>Name</td><td></td><td>Paid</td></tr><tr><td>Series P', series_id, '</td><td>2023</td><td>B1</td><td>$</td><td>', format_number(orderkey + 200, 0), '</td></tr><tr><td></td><td></td><td>B2</td><td>$</td><td>300</td></tr><tr><td></td><td>2022</td><td>B1</td><td>$</td><td>50</td></tr><tr><td></td><td></td><td>B3</td><td>$</td><td>700</td></tr></table>')),
          repeat('<p>filler words</p>', 70), 'Changes to brokerage <table><tr><td>2021</td></tr><tr><td>Late</td><td>123456</td></tr></table>') as html""",
    )


@query(with_views(V_HOLDING, body="""
SELECT fund_name, year, count(*) AS rows, CAST(sum(CAST(amount AS DECIMAL(28,2))) AS DOUBLE) AS amount FROM (
  SELECT 'SeriesP' || series_id AS fund_name, 2023 AS year, orderkey + 5000.0 AS amount FROM v_holding WHERE linenumber <= 4 UNION ALL SELECT 'SeriesP' || series_id, 2022, linenumber * 1000 + 0.5 FROM v_holding WHERE linenumber <= 4
  UNION ALL SELECT 'Series P' || series_id, 2023, orderkey + 500 FROM v_holding WHERE linenumber > 4 UNION ALL SELECT 'Series P' || series_id, 2022, 700 FROM v_holding WHERE linenumber > 4) q GROUP BY 1, 2"""))
def statement_commissions(v):
    c = filing_prose.commissions(_commission_docs(v), "doc", "html", also=("copies",))
    return c.groupBy("fund_name", "year").agg(F.sum("copies").alias("rows"), dbl(F.sum(F.col("amount").cast("decimal(28,2)") * F.col("copies"))).alias("amount"))


@query("""SELECT o_orderkey AS doc, fund_name, year, turnover_pct FROM (SELECT o_orderkey, 'Growth ' || o_orderstatus AS fund_name, 2023 AS year, CAST(o_custkey % 300 AS DOUBLE) AS turnover_pct FROM orders UNION ALL SELECT o_orderkey, 'Growth ' || o_orderstatus, 2022, 45 FROM orders
  UNION ALL SELECT o_orderkey, '', 2021, CAST(o_orderkey % 200 AS DOUBLE) FROM orders WHERE o_orderstatus = 'F') q""")
def turnover_history(v):
    docs = v.table("orders").selectExpr(
        "o_orderkey as doc",
        """concat('cover 2019 <h1>Financial Highlights</h1> Fund: Growth ', o_orderstatus, '<table><tr><td>Year</td><td>2023</td><td>2022</td></tr><tr><td>Portfolio turnover rate</td><td>', o_custkey % 300, '%</td><td>45 %</td><td>46 %</td></tr><tr><td>Assets 2018</td></tr></table>',
          if(o_orderstatus = 'F', concat('FINANCIAL HIGHLIGHTS 2021 <tr><td>portfolio turnover rate (f)</td><td>', o_orderkey % 200, '%</td></tr>'), 'financial highlights continued 2021')) as html""",
    )
    return filing_prose.turnover_history(docs, "doc", "html").select("doc", "fund_name", "year", "turnover_pct")


@query("""SELECT c_custkey AS doc, CASE WHEN c_acctbal < 0 THEN 'unknown' WHEN c_acctbal < 2500 THEN 'same-complex' WHEN c_acctbal < 5000 THEN 'cross-complex' WHEN c_acctbal < 7000 THEN 'partial' WHEN c_acctbal < 9000 THEN 'reorganization' ELSE 'filing-available' END AS reorganization_type,
  CASE WHEN c_acctbal >= 0 AND c_acctbal < 7000 THEN c_mktsegment || ' Alpha ' || c_custkey || ' Fund' ELSE '' END AS targets, CASE WHEN c_acctbal >= 0 AND c_acctbal < 2500 THEN c_mktsegment || ' Beta Fund' WHEN c_acctbal >= 0 AND c_acctbal < 5000 THEN 'Global Beta Fund' ELSE '' END AS acquirers,
  CASE WHEN c_acctbal >= 7000 AND c_acctbal < 9000 THEN 'proposed reorganization is described in the enclosed papers for holders.' ELSE '' END AS summary FROM customer""")
def merger_classification(v):
    docs = v.dealt(v.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal")).selectExpr(
        "c_custkey as doc", "concat(' ', lower(c_mktsegment), ' Trust') as company",
        """case when c_acctbal < 0 then null else concat(repeat('<p>cover page;&nbsp;words</p>', 20), case
          when c_acctbal < 5000 then concat('<b>Notice:</b> ;the ', c_mktsegment, ' Alpha ', c_custkey, ' Fund will be reorganized into the ', if(c_acctbal < 2500, concat(c_mktsegment, ' Beta'), 'Global Beta'), ' Fund, a series of it; shares of the ', if(c_acctbal < 2500, concat(c_mktsegment, ' Beta'), 'Global Beta'), ' Fund will be issued')
          when c_acctbal < 7000 then concat('; reorganization of the ', c_mktsegment, ' Alpha ', c_custkey, ' Fund; ')
          when c_acctbal < 9000 then 'The proposed reorganization is described in the <i>enclosed</i> papers for holders. More.' else 'nothing to see' end) end as html""",
    )
    m = filing_prose.merger_facts(docs, "doc", "html", "company")
    return m.select("doc", "reorganization_type", F.concat_ws("|", "targets").alias("targets"), F.concat_ws("|", "acquirers").alias("acquirers"), "summary")


@query("""SELECT doc_id, lang = 'en' AS has_text, CASE WHEN lang = 'en' THEN length('Basis for the Board''s approval of fees ' || source || ' & costs' || repeat(' filler', 160)) END AS n_chars FROM documents""")
def board_approval(v):
    d = v.table("documents").selectExpr("doc_id", """concat('<p>', text, '</p>', if(lang = 'en', concat('<h2>Basis for the Board\\'s approval</h2> of fees ', source, ' &amp; costs', repeat(' filler', 160), '<p>Proxy voting</p>'), '')) as html""")
    return d.select("doc_id", filing_prose.board_approval(F.col("html")).alias("t")).select("doc_id", F.col("t").isNotNull().alias("has_text"), F.length("t").alias("n_chars"))


@query("""SELECT c_custkey AS doc, CASE WHEN c_nationkey < 5 THEN 'class_table' WHEN c_acctbal < 0 THEN 'class_table' WHEN c_nationkey < 12 AND c_acctbal < 5000 THEN 'prose' ELSE 'summary_table' END AS parser FROM customer""")
def fee_parser_routing(v):
    """Registrants by name, by the pairing of R-6 with 529 classes, by series name, and all others."""
    c = v.table("customer").selectExpr(
        "c_custkey as doc", "case when c_nationkey < 5 then 'The Growth Fund of America' when c_nationkey < 12 then 'Fidelity Select Portfolios' else concat(c_mktsegment, ' Trust') end as registrant",
        "array('Class A ', 'class R-6', if(c_acctbal < 0, ' Class 529-A', 'Class C')) as classes", "if(c_acctbal < 5000, 'Fidelity  Series Growth', 'Growth Portfolio') as series")
    return c.select("doc", fees.parser_route(F.col("registrant"), F.col("classes"), F.col("series")).alias("parser"))


def _report_docs(v):
    """A shareholder report for every customer: commissions, financial highlights, board approval; some lack a part."""
    return v.dealt(v.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")).selectExpr(
        "c_custkey as doc",
        """concat('<p>letter</p>', if(c_acctbal < 0, '', concat('<p>Brokerage commissions paid by the funds</p><table><tr><td>Fund</td><td>2022</td><td>2021</td></tr><tr><td>Alpha ', c_custkey, '</td><td>$ ', format_number(c_custkey + 5000, 0), '</td><td>', c_nationkey + 1,
          '</td></tr><tr><td>Total</td><td>9</td><td>9</td></tr></table> Directed brokerage <table><tr><td>x</td><td>2019</td></tr><tr><td>Late</td><td>77</td></tr></table>')),
          if(c_nationkey < 20, concat('<h1>Financial Highlights</h1> Fund: Growth ', c_mktsegment, '<table><tr><td>Year</td><td>2023</td></tr><tr><td>Portfolio turnover rate</td><td>', c_nationkey, ' %</td></tr></table>'), ''),
          if(c_acctbal > 5000, concat('<h2>Basis for the Board\\'s approval</h2> of ', c_mktsegment, ' fees <h2>Proxy voting</h2>'), '')) as html""",
    )


@query("""SELECT c_custkey AS doc, CASE WHEN c_acctbal >= 0 THEN 'Alpha ' || c_custkey || ':2021:' || (c_nationkey + 1) || '.0|Alpha ' || c_custkey || ':2022:' || (c_custkey + 5000) || '.0' ELSE '' END AS commissions,
  CASE WHEN c_nationkey < 20 THEN 'Growth ' || c_mktsegment || ':2023:' || c_nationkey || '.0' ELSE '' END AS turnover, CASE WHEN c_acctbal > 5000 THEN 'Basis for the Board''s approval of ' || c_mktsegment || ' fees' END AS board_approval FROM customer""")
def shareholder_reports(v):
    r = filing_prose.report_facts(_report_docs(v), "doc", "html")
    joined = lambda c, f: F.concat_ws("|", F.transform(c, lambda x: F.concat_ws(":", x["fund_name"], x["year"], x[f])))
    return r.select("doc", joined("commissions", "amount").alias("commissions"), joined("turnover", "turnover_pct").alias("turnover"), "board_approval")
