"""Queries over run quality, exports and the incremental jobs, with their DuckDB text."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dragline.functions.expr import quarter_label
from dragline.operators import costs, holdings, quality
from dragline.operators.holdings import KEYS
from dragline.operators.resolve import union_all
from dragline.plans import funds as P
from dragline.plans.oracle_views import R, V_EVENT, V_FEE, V_FUND, V_LOOKUP, with_views
from dragline.scale import settle
from dragline.sources import sinks
from dragline.sources.fund_views import FundViews
from dragline.streaming import jobs

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, path: fn(FundViews(spark, path))
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def workspace(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder (a local one only for a local session)."""
    from dragline.scale import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    uid = spark._jvm.java.util.UUID.randomUUID().toString()  # noqa: SLF001
    return f"{base}/job-{uid}" if base else tempfile.mkdtemp(prefix="spark-", dir="/tmp")


# -- run quality ------------------------------------------------------------------


def _note_inputs(v: FundViews) -> DataFrame:
    cost = P._cost(v)
    sums, header = P._fund_sums(v)
    open_ends = sums.groupBy(*KEYS).agg(F.sum(F.when(F.col("child").isNull(), F.col("positions")).otherwise(0)).alias("unresolved"))
    kind = P.structure.structure_class(header, sums)
    return (
        cost.select(*KEYS, "ticker", "has_census", "has_holdings").join(kind.select(*KEYS, "structure"), list(KEYS), "left")
        .join(open_ends, list(KEYS), "left").withColumn("missing_children", F.lit(0))
    )


_NOTES = """
v_notes AS (SELECT ticker, period, note FROM (SELECT c.ticker, c.period, c.has_census, c.has_holdings, fund_pct, coalesce(un, 0) AS un FROM v_cost c LEFT JOIN v_class k ON k.series_id = c.series_id AND k.period = c.period
  LEFT JOIN (SELECT series_id, period, count(*) FILTER (child IS NULL) AS un FROM v_fundpos GROUP BY 1, 2) u ON u.series_id = c.series_id AND u.period = c.period) q, LATERAL (VALUES
  (CASE WHEN NOT has_census THEN 'census filing not found' END), (CASE WHEN NOT has_holdings THEN 'holdings filing not found' END), (CASE WHEN fund_pct > 25 THEN 'fund of funds' END),
  (CASE WHEN fund_pct > 0.5 AND fund_pct <= 25 THEN 'cash sweep vehicles' END), (CASE WHEN un > 0 THEN 'underlying funds not resolved' END)) t(note) WHERE note IS NOT NULL)"""


@query(with_views(*P.COST_VIEWS, P.V_FUNDPOS, _NOTES, body="SELECT ticker, period, note FROM v_notes"))
def data_notes(v):
    return quality.notes(_note_inputs(v))


@query(with_views(*P.COST_VIEWS, P.V_FUNDPOS, _NOTES, P.V_MEMBER, body="""
SELECT 'FND' || root AS ticker, m.period, CAST(sum(n * paths) AS BIGINT) AS caveats FROM v_member m JOIN (SELECT ticker, period, count(*) AS n FROM v_notes GROUP BY 1, 2) c ON c.ticker = 'FND' || member AND c.period = m.period GROUP BY 1, 2"""))
def tree_caveats(v):
    name = lambda c: F.concat(F.lit("FND"), F.col(c).cast("string")).alias(c)
    per_fund = settle(quality.caveat_counts(quality.notes(_note_inputs(v))))
    return quality.tree_caveat_counts(per_fund, P._edges(v).select(name("parent"), "period", name("child"), "positions"))


def _runs(v: FundViews) -> DataFrame:
    """One pipeline run per fund event: which stages gave a result follows from the event."""
    e = v.table("events")
    t, u = F.col("event_type"), F.col("user_id")
    return e.select(
        F.col("event_id").alias("ticker"), (t != "error").alias("resolved"), (F.col("value") > 5).alias("structured"),
        F.when(u != 7, F.col("value") > 2).alias("priced"), (t != "signup").alias("rolled"), (t != "click").alias("fees_found"),
        F.when(t == "view", 3).otherwise(0).alias("children"), F.when(F.col("value") > 100, 1).otherwise(0).alias("child_fee_misses"),
        F.when(F.col("value") > 50, 2).otherwise(0).alias("caveats"),
    )


V_RUNS = """
v_runs AS (SELECT event_id AS ticker, event_type <> 'error' AS a, value > 5 AS b, coalesce(user_id <> 7 AND value > 2, false) AS c, event_type <> 'signup' AS d, event_type, value, CASE WHEN value > 50 THEN 2 ELSE 0 END AS caveats FROM events),
v_done AS (SELECT *, a AND b AND c AND d AS done, CASE WHEN NOT a THEN 'resolve' WHEN NOT b THEN 'structure' WHEN NOT c THEN 'costs' WHEN NOT d THEN 'rollup' END AS failed FROM v_runs),
v_stage AS (SELECT ticker, caveats, failed, done, position, stage, CASE WHEN stage = 'fees' THEN CASE WHEN done THEN CASE WHEN event_type = 'click' OR (event_type = 'view' AND value > 100) THEN 'degraded' ELSE 'ok' END END
    WHEN failed = stage THEN 'failed' WHEN failed IS NOT NULL AND position > CASE failed WHEN 'resolve' THEN 0 WHEN 'structure' THEN 1 WHEN 'costs' THEN 2 ELSE 3 END THEN 'skipped' WHEN stage = 'costs' AND done AND caveats > 0 THEN 'degraded' ELSE 'ok' END AS status
  FROM v_done, (VALUES (0, 'resolve'), (1, 'structure'), (2, 'costs'), (3, 'rollup'), (4, 'fees')) s(position, stage))"""


@query(with_views(V_RUNS, body="SELECT ticker, caveats, position, stage, status FROM v_stage WHERE status IS NOT NULL"))
def stage_ledger(v):
    return quality.stage_ledger(_runs(v))


@query(with_views(V_RUNS, body="SELECT ticker, CASE WHEN failed IS NOT NULL THEN 'excluded' WHEN caveats > 0 THEN 'complete_with_caveats' ELSE 'complete' END AS verdict, failed AS failed_stage FROM v_done"))
def run_verdicts(v):
    return quality.verdicts(quality.stage_ledger(_runs(v)))


@query(with_views(V_RUNS, body="SELECT CASE WHEN failed IS NOT NULL THEN 'excluded' WHEN caveats > 0 THEN 'complete_with_caveats' ELSE 'complete' END AS verdict, count(*) AS tickers FROM v_done GROUP BY 1"))
def run_manifest(v):
    return quality.manifest(quality.verdicts(quality.stage_ledger(_runs(v))))


@query("SELECT source, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(errors) AS BIGINT) AS errors, CASE WHEN sum(retries) > 0 OR sum(errors) > 0 THEN 'degraded' ELSE 'ok' END AS status FROM (SELECT user_id AS source, CASE WHEN event_type = 'signup' AND value > 200 THEN 1 ELSE 0 END AS retries, CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END AS errors FROM events) q GROUP BY 1")
def source_health(v):
    e = v.table("events").select(
        F.col("user_id").alias("source"), F.when((F.col("event_type") == "signup") & (F.col("value") > 200), 1).otherwise(0).alias("retries"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 100), 1).otherwise(0).alias("errors"))
    return quality.source_health(e)


# -- exports ------------------------------------------------------------------------------

_MID = lambda a, b: R(f"({a} + {b}) / 2", 4)
_PCTV = lambda a, b: R(f"({a} + {b}) / 2 / 100", 6)


def _exp(label: str, cat: str, a: str, b: str, tag: str, where: str) -> str:
    return f"SELECT series_id, period, ticker, '{label}' AS component, '{cat}' AS category, {a} AS low_bps, {b} AS high_bps, {_MID(a, b)} AS mid_bps, {_PCTV(a, b)} AS value_pct, lower({tag}) AS source_tag FROM v_cost WHERE {where}"


_TL, _TH = (R(f"coalesce(brokerage_bps, 0) + coalesce(spread_{s}_bps, 0) + coalesce(impact_{s}_bps, 0)", 4) for s in ("low", "high"))
_EXPORT = " UNION ALL ".join((
    _exp("Expense Ratio", "stated", "er_bps", "er_bps", "'reported'", "er_bps IS NOT NULL"),
    _exp("Brokerage Commissions", "hidden", "brokerage_bps", "brokerage_bps", "brokerage_tag", "brokerage_bps IS NOT NULL"),
    _exp("Soft Dollar Arrangements", "hidden", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "soft_dollar_tag", "soft_dollar_tag = 'NOT_DISCLOSED'"),
    _exp("Soft Dollar Commissions", "hidden", "soft_dollar_bps", "soft_dollar_bps", "soft_dollar_tag", "soft_dollar_tag IN ('CALCULATED', 'ESTIMATED') AND soft_dollar_bps IS NOT NULL"),
    _exp("Bid-Ask Spread Cost", "hidden", "spread_low_bps", "spread_high_bps", "spread_tag", "spread_tag <> 'UNAVAILABLE'"),
    _exp("Market Impact Cost", "hidden", "impact_low_bps", "impact_high_bps", "impact_tag", "impact_tag <> 'UNAVAILABLE'"),
    _exp("TOTAL HIDDEN COSTS", "composite", _TL, _TH, "'composite'", "true"),
    f"SELECT series_id, period, ticker, 'Asset: ' || asset_category, 'allocation', NULL, NULL, NULL, {R('w / 100', 6)}, 'nport' FROM v_cost JOIN (SELECT series_id, period, asset_category, 100.0::DOUBLE * CAST(sum(value_usd) AS DOUBLE) / max(net_assets) AS w FROM v_holding JOIN v_header USING (series_id, period) GROUP BY 1, 2, 3) a USING (series_id, period)",
))


@query(with_views(*P.COST_VIEWS, body=_EXPORT))
def component_export(v):
    by_category = settle(P._category_sums(v))
    weights = holdings.category_weights(by_category, v.fund()).filter(F.col("asset_category").isNotNull())
    return sinks.component_rows(P._cost(v, by_category), weights.drop("tag"))


_DOCUMENT = (
    "snapshot_version int, generated string, quarter string, ticker string, excluded_reason string,"
    " provenance struct<ticker: string, verdict: string, completed: boolean, stages: array<struct<stage: string, status: string>>, quality_notes: array<string>>,"
    " analysis struct<ticker: string, name: string, fund_family: string, series_id: long, net_assets: double, holdings_count: long,"
    " costs: struct<expense_ratio_bps: struct<value: double, tag: string>, brokerage_commissions_bps: struct<value: double, tag: string>,"
    " soft_dollar_arrangements: struct<active: boolean, value_bps: double, tag: string>,"
    " bid_ask_spread_cost: struct<low_bps: double, high_bps: double, mid_bps: double, tag: string>,"
    " market_impact_cost: struct<low_bps: double, high_bps: double, mid_bps: double, tag: string>,"
    " total_reported_bps: double, total_estimated_low_bps: double, total_estimated_high_bps: double>,"
    " children: array<struct<ticker: string, weight: double>>>")


def _quarter() -> Column:
    return F.concat(F.col("period").cast("string"), F.lit("-Q4")).alias("quarter")


def _documents(v: FundViews) -> DataFrame:
    """Documents of all fund-periods: priced needs a census or holdings, the roll-up a known total."""
    cost = settle(costs.with_totals(P._cost(v)))
    sums, header = P._fund_sums(v)
    kind = P.structure.structure_class(header, sums)
    open_ends = sums.groupBy(*KEYS).agg(F.sum(F.when(F.col("child").isNull(), F.col("positions")).otherwise(0)).alias("unresolved"))
    inputs = cost.select(*KEYS, "ticker", "has_census", "has_holdings").join(kind.select(*KEYS, "structure"), list(KEYS), "left").join(
        open_ends, list(KEYS), "left").withColumn("missing_children", F.lit(0))
    noted = settle(quality.notes(inputs).select("ticker", _quarter(), "note"))
    caveats = noted.groupBy("ticker", "quarter").agg(F.count("*").cast("int").alias("caveats"))
    yes = F.lit(True)
    runs = cost.select(
        "ticker", _quarter(), yes.alias("resolved"), (F.col("has_census") | F.col("has_holdings")).alias("structured"),
        F.col("net_assets").isNotNull().alias("priced"), F.col("total_reported_bps").isNotNull().alias("rolled"),
        F.col("er_bps").isNotNull().alias("fees_found"), F.lit(0).alias("children"), F.lit(0).alias("child_fee_misses"),
    ).join(caveats, ["ticker", "quarter"], "left").fillna(0, ["caveats"])
    ledger = quality.stage_ledger(runs, ("ticker", "quarter"))
    child = cost.select(F.col("series_id").alias("child"), "period", F.col("ticker").alias("child_ticker"))
    parent = cost.select(F.col("series_id").alias("parent"), "period", "ticker")
    below = settle(P.structure.edges(sums, header)).join(child, ["child", "period"]).join(parent, ["parent", "period"]).select(
        "ticker", _quarter(), "child_ticker", F.round("weight", 8).cast("double").alias("weight"))
    analyses = sinks.document(cost).select("ticker", _quarter(), "analysis")
    return sinks.snapshot_documents(cost.select("ticker", _quarter()), ledger, noted, below, analyses, F.lit("2026-10-01"))


def _tagged_sql(low: str, high: str, tag: str, name: str) -> str:
    on = f"{tag} <> 'UNAVAILABLE' AND {low} IS NOT NULL AND done"
    return (f"CASE WHEN {on} THEN {low} END AS {name}_low, CASE WHEN {on} THEN {high} END AS {name}_high,"
            f" CASE WHEN {on} THEN {R(f'({low} + {high}) / 2', 4)} END AS {name}_mid, CASE WHEN {on} THEN lower({tag}) END AS {name}_tag")


_V_SNAP = f"""
v_snap0 AS (SELECT c.*, {P._TOT} AS total FROM v_cost c),
v_stages AS (SELECT *, CASE WHEN NOT (has_census OR has_holdings) THEN 1 WHEN net_assets IS NULL THEN 2 WHEN total IS NULL THEN 3 END AS failed FROM v_snap0),
v_noted AS (SELECT ticker, period, string_agg(note, '; ' ORDER BY note) AS notes FROM v_notes GROUP BY 1, 2),
v_refs AS (SELECT parent, e.period, string_agg('FND' || child, ',' ORDER BY 'FND' || child) AS refs FROM v_edge e JOIN v_cost c ON c.series_id = child AND c.period = e.period GROUP BY 1, 2),
v_snap1 AS (SELECT s.*, coalesce(n.notes, '') AS notes, coalesce(r.refs, '') AS refs, failed IS NULL AS done,
    CASE failed WHEN 1 THEN 'Holdings: no result' WHEN 2 THEN 'Cost model: no result' WHEN 3 THEN 'Roll-up: no result' END AS reason
  FROM v_stages s LEFT JOIN v_noted n ON n.ticker = s.ticker AND n.period = s.period LEFT JOIN v_refs r ON r.parent = s.series_id AND r.period = s.period)"""


@query(with_views(*P.COST_VIEWS, P.V_FUNDPOS, _NOTES, _V_SNAP, body=f"""
SELECT 1 AS snapshot_version, '2026-10-01' AS generated, period || '-Q4' AS quarter, ticker, reason AS excluded_reason, done AS completed,
  CASE WHEN NOT done THEN 'EXCLUDED: ' || reason WHEN notes <> '' THEN 'COMPLETE WITH CAVEATS' ELSE 'COMPLETE' END AS verdict, notes AS quality_notes,
  'resolve:ok|structure:' || CASE WHEN failed = 1 THEN 'failed' ELSE 'ok' END || '|costs:' || CASE WHEN failed < 2 THEN 'skipped' WHEN failed = 2 THEN 'failed' WHEN done AND notes <> '' THEN 'degraded' ELSE 'ok' END
    || '|rollup:' || CASE WHEN failed < 3 THEN 'skipped' WHEN failed = 3 THEN 'failed' ELSE 'ok' END || CASE WHEN done THEN '|fees:' || CASE WHEN er_bps IS NULL THEN 'degraded' ELSE 'ok' END ELSE '' END AS stages,
  CASE WHEN done THEN fund_name END AS name, CASE WHEN done THEN family END AS fund_family, CASE WHEN done THEN series_id END AS series_id,
  CASE WHEN done THEN {R('net_assets')} END AS net_assets, CASE WHEN done THEN coalesce(n_holdings, 0) END AS holdings_count,
  CASE WHEN done THEN er_bps END AS er_bps, CASE WHEN done AND er_bps IS NOT NULL THEN 'reported' END AS er_tag,
  CASE WHEN done THEN brokerage_bps END AS brokerage_bps, CASE WHEN done AND brokerage_bps IS NOT NULL THEN lower(brokerage_tag) END AS brokerage_tag,
  CASE WHEN done AND soft_dollar_tag IS NOT NULL THEN soft_dollar_tag = 'NOT_DISCLOSED' OR coalesce(soft_dollar_bps > 0, false) END AS soft_active,
  CASE WHEN done AND soft_dollar_tag IS NOT NULL THEN soft_dollar_bps END AS soft_bps, CASE WHEN done THEN lower(soft_dollar_tag) END AS soft_tag,
  {_tagged_sql('spread_low_bps', 'spread_high_bps', 'spread_tag', 'spread')}, {_tagged_sql('impact_low_bps', 'impact_high_bps', 'impact_tag', 'impact')},
  CASE WHEN done THEN {R('total', 4)} END AS total_reported, CASE WHEN done THEN {R('total + coalesce(spread_low_bps, 0) + coalesce(impact_low_bps, 0)', 4)} END AS total_low,
  CASE WHEN done THEN {R('total + coalesce(spread_high_bps, 0) + coalesce(impact_high_bps, 0)', 4)} END AS total_high, CASE WHEN done THEN refs END AS children
FROM v_snap1"""))
def snapshot_documents(v):
    """Documents of all funds and periods, written with their manifest, read back, every field taken out again."""
    root = workspace(v.spark)
    sinks.write_documents(_documents(v), root)
    docs, _ = sinks.read_snapshots(v.spark, root, _DOCUMENT)
    p, a, c = F.col("provenance"), F.col("analysis"), F.col("analysis.costs")
    of = lambda component, name: [c[component][f"{k}_bps"].alias(f"{name}_{k}") for k in ("low", "high", "mid")] + [c[component]["tag"].alias(f"{name}_tag")]
    return docs.select(
        "snapshot_version", "generated", "quarter", "ticker", "excluded_reason", p["completed"].alias("completed"), p["verdict"].alias("verdict"),
        F.array_join(p["quality_notes"], "; ").alias("quality_notes"),
        F.array_join(F.transform(p["stages"], lambda x: F.concat(x["stage"], F.lit(":"), x["status"])), "|").alias("stages"),
        *[a[x].alias(x) for x in ("name", "fund_family", "series_id", "net_assets", "holdings_count")],
        c["expense_ratio_bps"]["value"].alias("er_bps"), c["expense_ratio_bps"]["tag"].alias("er_tag"),
        c["brokerage_commissions_bps"]["value"].alias("brokerage_bps"), c["brokerage_commissions_bps"]["tag"].alias("brokerage_tag"),
        c["soft_dollar_arrangements"]["active"].alias("soft_active"), c["soft_dollar_arrangements"]["value_bps"].alias("soft_bps"),
        c["soft_dollar_arrangements"]["tag"].alias("soft_tag"), *of("bid_ask_spread_cost", "spread"), *of("market_impact_cost", "impact"),
        c["total_reported_bps"].alias("total_reported"), c["total_estimated_low_bps"].alias("total_low"), c["total_estimated_high_bps"].alias("total_high"),
        F.array_join(F.transform(a["children"], lambda x: x["ticker"]), ",").alias("children"))


@query("""
SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderpriority <> '3-MEDIUM') AS documents,
  count(*) FILTER (o_orderpriority IN ('5-LOW', '3-MEDIUM')) AS bad, CAST(sum(CASE WHEN o_orderpriority NOT IN ('5-LOW', '3-MEDIUM') THEN o_orderkey END) AS BIGINT) AS keys
FROM orders WHERE o_orderdate < DATE '1996-01-01' GROUP BY 1""")
def snapshot_read(v):
    """Stored documents read back: torn lines and manifests among them are set aside, unfinished quarters are not read."""
    root = workspace(v.spark)
    o = v.table("orders").select(
        "o_orderkey", "o_orderpriority", "o_orderdate", quarter_label(F.col("o_orderdate")).alias("quarter"))
    whole = F.to_json(F.struct(F.lit(1).alias("snapshot_version"), "quarter", F.col("o_orderkey").cast("string").alias("ticker")))
    manifest = F.to_json(F.struct("quarter", F.lit(3).alias("documents")))
    line = F.when(F.col("o_orderpriority") == "5-LOW", F.substring(whole, 1, 25)).when(F.col("o_orderpriority") == "3-MEDIUM", manifest).otherwise(whole)
    o.select("quarter", line.alias("value")).write.partitionBy("quarter").text(f"{root}/documents")
    finished = o.filter(F.to_date("o_orderdate") < F.lit("1996-01-01").cast("date"))
    sinks.write_manifest(finished.select("quarter", line.alias("value")), root)
    good, bad = sinks.read_snapshots(v.spark, root, "snapshot_version int, quarter string, ticker string")
    kinds = good.select("quarter", F.col("ticker").cast("long").alias("key"), F.lit(1).alias("good")).unionByName(
        bad.select("quarter", F.lit(None).cast("long").alias("key"), F.lit(0).alias("good")))
    return kinds.groupBy("quarter").agg(F.count(F.when(F.col("good") == 1, 1)).alias("documents"), F.count(F.when(F.col("good") == 0, 1)).alias("bad"), F.sum("key").alias("keys"))


@query(with_views(*P.HOLD, P.V_FUNDPOS, body=f"SELECT parent AS series_id, v_edge.period, 'FND' || child AS child_ticker, CAST(round(weight, 8) AS DOUBLE) AS weight FROM v_edge JOIN v_header h ON h.series_id = child AND h.period = v_edge.period"))
def snapshot_children(v):
    h = P._header(v, v.holding()).select(*KEYS, F.concat(F.lit("FND"), F.col("series_id").cast("string")).alias("ticker"))
    return sinks.with_children(h, P._edges(v))


@query(with_views(*P.COST_VIEWS, P.V_FUNDPOS, _NOTES, _V_SNAP, body="""
SELECT run, outcome, count(*) AS documents FROM (
  SELECT 1 AS run, CASE WHEN NOT done THEN 'excluded' WHEN notes <> '' THEN 'complete_with_caveats' ELSE 'complete' END AS outcome FROM v_snap1 WHERE has_holdings
  UNION ALL SELECT 2, CASE WHEN has_holdings THEN 'skipped' WHEN NOT done THEN 'excluded' WHEN notes <> '' THEN 'complete_with_caveats' ELSE 'complete' END FROM v_snap1
  UNION ALL SELECT 3, 'skipped' FROM v_snap1 UNION ALL SELECT 4, CASE WHEN NOT done THEN 'excluded' WHEN notes <> '' THEN 'complete_with_caveats' ELSE 'complete' END FROM v_snap1) GROUP BY 1, 2"""))
def snapshot_resume(v):
    """Four runs into one folder: funds with holdings, all of them, all again, all by force."""
    root = workspace(v.spark)
    docs = settle(_documents(v))
    held = docs.filter(~F.array_contains("document.provenance.quality_notes", "holdings filing not found"))
    runs = [sinks.write_documents(part, root, force).withColumn("run", F.lit(i))
            for i, (part, force) in enumerate(((held, False), (docs, False), (docs, False), (docs, True)), 1)]
    return union_all(runs).groupBy("run", "outcome").agg(F.count("*").alias("documents"))


@query(with_views(V_FUND, body="SELECT * FROM (SELECT ticker, family, row_number() OVER (PARTITION BY ticker ORDER BY s_suppkey DESC) AS rn, s_acctbal AS hidden_cost_mid_bps FROM v_fund JOIN supplier ON s_suppkey = series_id) q WHERE rn = 1").replace("SELECT * FROM (SELECT ticker, family,", "SELECT ticker, hidden_cost_mid_bps FROM (SELECT family AS ticker,").replace("PARTITION BY ticker ORDER", "PARTITION BY family ORDER").replace("ON s_suppkey = series_id)", "ON s_suppkey = series_id WHERE s_acctbal > 100)"))
def board_load(v):
    s, n = v.table("supplier"), v.table("nation")
    raw = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("ticker"), F.when(F.col("s_acctbal") > 100, F.col("s_acctbal")).alias("hidden_cost_mid_bps"), F.col("s_suppkey").alias("position"))
    return sinks.load_board(raw)


@query(with_views(V_EVENT, body="SELECT form, cik, date_filed, CASE WHEN form = 'N-8F' THEN 'deregistration' ELSE 'merger/reorg' END AS event, count(*) AS n FROM v_event WHERE form <> '485BPOS' GROUP BY 1, 2, 3, 4"))
def event_register(v):
    """Register written as CSV and read back."""
    path = workspace(v.spark) + "/register"
    sinks.write_events(v.fund_event(), path)
    return v.spark.read.schema("form string, company string, cik long, date_filed date, filing_path string, event string").csv(path, header=True).groupBy(
        "form", "cik", "date_filed", "event").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter FROM orders")
def quarter_labels(v):
    return v.table("orders").select("o_orderkey", quarter_label(F.col("o_orderdate")).alias("quarter"))


# -- incremental -------------------------------------------------------------------------------


class _Streamed(FundViews):
    """Fund views whose chosen table is read as a stream of several files, one for each batch, in no order of time."""

    def __init__(self, base: FundViews, streamed: str, path: str):
        super().__init__(base.spark, base.path)
        self.streamed, self.slices = streamed, path
        base.table(streamed).withColumn("slice", F.pmod(F.hash(*base.table(streamed).columns), F.lit(3))).repartition(
            3, "slice").write.partitionBy("slice").parquet(path)

    def table(self, name: str) -> DataFrame:
        batch = super().table(name)
        if name != self.streamed:
            return batch
        return self.spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option(
            "recursiveFileLookup", "true").parquet(self.slices)


def _deliver(rows: DataFrame, slices: DataFrame, order: tuple[int, ...], root: str, start) -> None:
    """Bring ``rows`` in slices (a column ``slice`` names each row's), one run of a stream for each entry of ``order``."""
    for i in order:
        slices.filter(F.col("slice") == i).drop("slice").write.mode("append").parquet(f"{root}/in/part={i}")
        stream = rows.sparkSession.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        start(stream).awaitTermination()


@query(with_views(V_LOOKUP, P.V_BOARD, body="SELECT * FROM v_board"))
def streamed_board(v):
    """Board kept up to date by lookups that come newest first, one slice twice; equals the batch board."""
    root = workspace(v.spark)
    rows = settle(v.lookup())
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    third = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp"))) * 3 / (
        F.unix_micros(F.lit(high).cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp")) + 1)
    slices = rows.withColumn("slice", F.floor(third).cast("int"))
    _deliver(rows, slices, (2, 1, 0, 1), root, lambda stream: jobs.start_board(stream, f"{root}/state", f"{root}/ck"))
    return jobs.stored_board(v.spark, f"{root}/state")


@query(with_views(V_EVENT, body="SELECT *, CASE WHEN form = 'N-8F' THEN 'deregistration' ELSE 'merger/reorg' END AS event FROM v_event WHERE form <> '485BPOS'"))
def streamed_harvest(v):
    """Event harvest; the second run finds nothing new and adds nothing."""
    root = workspace(v.spark)
    events = _Streamed(v, "events", f"{root}/in").fund_event()
    for _ in range(2):
        jobs.start_harvest(events, f"{root}/events", f"{root}/ck").awaitTermination()
    return v.spark.read.parquet(f"{root}/events")


@query("""
SELECT ticker, quarter, epoch_us(filed) AS filed_us, value FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, quarter ORDER BY filed, value) AS rk FROM (
    SELECT user_id AS ticker, ts + to_months(CAST(3 * (event_id % 4) AS INTEGER)) AS filed, year(filed) || '-Q' || quarter(filed) AS quarter, min(value) AS value
    FROM events GROUP BY 1, 2)) WHERE rk = 1""")
def streamed_snapshots(v):
    """First document of each fund and quarter; documents of four quarters come latest quarter first, one slice twice."""
    root = workspace(v.spark)
    filed = F.col("ts").cast("timestamp") + F.make_interval(months=(3 * (F.col("event_id") % 4)).cast("int"))
    docs = v.table("events").select(F.col("user_id").alias("ticker"), filed.alias("filed"), "value")
    docs = settle(docs.groupBy("ticker", "filed").agg(F.min("value").alias("value")).withColumn("quarter", quarter_label(F.col("filed"))))
    slices = docs.withColumn("slice", F.pmod(F.floor(F.months_between("filed", F.lit("2020-01-01")) / 3), F.lit(4)).cast("int"))
    _deliver(docs, slices, (3, 1, 2, 0, 2), root, lambda stream: jobs.start_snapshots(stream, f"{root}/docs", f"{root}/ck"))
    return jobs.snapshot_table(v.spark, f"{root}/docs").read().select("ticker", "quarter", F.unix_micros("filed").alias("filed_us"), "value")


@query(with_views(V_FEE, P.V_LAG, P.V_CHANGE, body="SELECT * FROM v_change"))
def streamed_fee_changes(v):
    """Fee filings arriving in slices out of order, one slice twice; the changes equal those of one batch."""
    root = workspace(v.spark)
    snaps = settle(v.fee_snapshot())
    slices = snaps.withColumn("slice", F.pmod(F.xxhash64("accession_no"), F.lit(3)).cast("int"))
    _deliver(snaps, slices, (2, 0, 1, 0), root, lambda stream: jobs.start_fee_changes(stream, f"{root}/fees", f"{root}/ck"))
    return jobs.stored_changes(v.spark, f"{root}/fees")
