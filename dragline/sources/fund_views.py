"""Fund-shaped views over the TPC-H-like tables.

Each view maps one kind of filing onto the given tables, so that every operator
can be run, checked and measured on data of any size.  Nothing is sampled: a
view keeps all rows of the tables it reads.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dragline.functions.expr import money, ratio

#: Set only where the given tables are single row groups, which one task reads (bench); unset, scans are left as they are.
INPUT_PARTITIONS = "spark.dragline.inputPartitions"
ROWS_PER_TASK = 1 << 18
LARGE_TABLES = ("lineitem", "documents", "pages")

DERIVATIVE_BY_LINE = {1: "DE", 2: "DFE", 3: "DIR", 4: "DCR", 5: "DCO"}
CATEGORY_BY_TYPE = {
    "STANDARD": "EC", "SMALL": "EP", "MEDIUM": "DBT", "LARGE": "ABS-MBS", "ECONOMY": "STIV",
}
CENSUS_SUMS = ("gross_usd", "commission_cents", "affiliated_cents", "principal_usd", "lending_cents", "lending_agent_cents")
AFFILIATED_BRANDS = ("Brand#1", "Brand#2", "Brand#3", "Brand#4")


class FundViews:
    """Lazy views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A table, with its footer read once per set of views."""
        if name not in self._tables:
            t = self.spark.read.parquet(f"{self.path}/{name}.parquet")
            n = self.spark.conf.get(INPUT_PARTITIONS, None)
            self._tables[name] = t.repartition(int(n)) if n and name in LARGE_TABLES else t
        return self._tables[name]

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt out evenly over all tasks, for queries that make and parse a document for each of a few narrow
        columns: splits follow the bytes read, which say nothing about that work."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(max(n, self.spark.sparkContext.defaultParallelism))

    def by_key(self, name: str, key: str) -> DataFrame:
        """A table dealt by ``key`` into partitions of about ``ROWS_PER_TASK`` rows at any size, which adaptive execution
        leaves as they are; the number of rows is answered from parquet footers."""
        rows = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return rows.repartition(max(-(-rows.count() // ROWS_PER_TASK), self.spark.sparkContext.defaultParallelism), key)

    @cached_property
    def n_funds(self) -> int:
        """Number of funds: one scalar, answered from parquet footers."""
        return self.table("supplier").count()

    # -- dimensions ----------------------------------------------------------

    def fund(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        bal = F.col("s_acctbal")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.col("s_suppkey").alias("series_id"),
                F.concat(F.lit("FND"), F.col("s_suppkey").cast("string")).alias("ticker"),
                F.concat(
                    "s_name",
                    F.when(bal > 9500, " ETF").when(F.col("r_name") == "ASIA", " Bond Fund").otherwise(" Fund"),
                ).alias("fund_name"),
                F.col("n_name").alias("family"),
                F.col("r_name").alias("category"),
                F.when(F.col("n_nationkey") < 20, F.col("n_nationkey") * 8.0).alias("prospectus_turnover"),
                (bal < 3500).alias("soft_dollar_flag"),
                (bal < 1000).alias("soft_dollar_reported"),
                (bal < 9000).alias("has_ncen"),
                (bal < 8000).alias("has_average_nav"),
                (bal >= 0).alias("has_nport"),
                F.when((bal >= 5000) & (bal < 6000), 2.5).when((bal >= 6000) & (bal < 7000), 1.25)
                .otherwise(1.0).alias("nav_factor"),
            )
        )

    # -- holdings ------------------------------------------------------------

    def holding(self, country: bool = False) -> DataFrame:
        li, p = self.table("lineitem"), self.table("part")
        kind = F.col("p_type")
        category = F.when(kind == "PROMO", F.lit("DO"))
        for line, cat in DERIVATIVE_BY_LINE.items():
            category = F.when((kind == "PROMO") & (F.col("l_linenumber") == line), cat).otherwise(category)
        for t, cat in CATEGORY_BY_TYPE.items():
            category = F.when(kind == t, cat).otherwise(category)
        size = F.col("p_size")
        suffix = (
            F.when((size >= 15) & (size <= 18), "Growth Fund")
            .when((size >= 19) & (size <= 20), "Mortgage Trust")
            .when((size >= 21) & (size <= 22), "Money Market")
            .when(size == 23, "Treasury Bill")
            .when(size == 24, "Overnight Repo")
            .otherwise("Corp")
        )
        short = (kind == "PROMO") & (F.col("l_returnflag") == "R")
        derivative = kind == "PROMO"
        cusip = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
        cols = [
            F.col("l_suppkey").alias("series_id"),
            F.year("l_shipdate").alias("period"),
            F.col("l_orderkey").alias("orderkey"),
            F.col("l_linenumber").alias("linenumber"),
            F.col("p_partkey").alias("partkey"),
            F.concat(F.col("p_name"), F.lit(" "), suffix).alias("name"),
            cusip.alias("cusip"),
            F.concat(F.when(F.col("p_brand") == "Brand#5", "GB").otherwise("US"), cusip, F.lit("0")).alias("isin"),
            F.when(short, -money("l_extendedprice")).otherwise(money("l_extendedprice")).alias("value_usd"),
            category.alias("asset_category"),
            F.when(size <= 14, "RF").otherwise("CORP").alias("issuer_category"),
            F.when(derivative, F.when(F.col("l_linestatus") == "F", "swapDeriv").otherwise("fwdDeriv"))
            .alias("instrument_type"),
            F.when(derivative, money("l_quantity") * money("p_retailprice")).cast("decimal(18,4)").alias("notional_usd"),
            F.when(derivative, F.col("p_brand")).alias("counterparty_name"),
            # what the same line says in the census
            money("l_extendedprice").alias("gross_usd"),
            (money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)")).alias("commission_cents"),
            F.when(F.col("p_brand").isin(*AFFILIATED_BRANDS), money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)"))
            .alias("affiliated_cents"),
            # bought from an affiliate as principal, and what lending earned, in part for an affiliated agent
            F.when(F.col("p_brand").isin(*AFFILIATED_BRANDS) & (F.col("l_returnflag") == "A"), money("l_extendedprice")).alias("principal_usd"),
            (money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("lending_cents"),
            F.when(F.col("p_brand").isin(*AFFILIATED_BRANDS), money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)"))
            .alias("lending_agent_cents"),
            F.when(
                derivative,
                money("l_extendedprice") * (F.col("l_discount").cast("decimal(4,2)") - F.col("l_tax").cast("decimal(4,2)")),
            ).cast("decimal(18,4)").alias("unrealized_usd"),
        ]
        out = li.join(p, li.l_partkey == p.p_partkey)
        if country:
            o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
            buyer = c.join(n, c.c_nationkey == n.n_nationkey).select(
                "c_custkey",
                F.when(F.col("n_nationkey") == 24, "us ")
                .when(F.col("n_nationkey") == 0, " ")
                .when(F.col("n_nationkey") != 1, F.lower("n_name"))
                .alias("country"),
            )
            out = out.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(
                buyer, F.col("o_custkey") == F.col("c_custkey")
            )
            cols.append(F.col("country"))
        return out.select(*cols)

    def census_of(self, sums: DataFrame) -> DataFrame:
        """``sums`` of CENSUS_SUMS, with fund attributes, as census rows; all null where the fund has filed no census."""
        filed = F.col("has_ncen")
        f = self.fund().select("series_id", "ticker", "category", "family", "soft_dollar_flag", "soft_dollar_reported", "has_ncen", "has_average_nav")
        commissions = F.col("commission_cents").cast("double") / 100
        said = {
            "commissions": commissions,
            "affiliated_commissions": F.coalesce(F.col("affiliated_cents").cast("double") / 100, F.lit(0.0)),
            "has_soft_dollar": F.col("soft_dollar_flag"),
            "soft_dollar_usd": F.when(F.col("soft_dollar_reported"), commissions * 0.2),
            "ncen_turnover": F.lit(None).cast("double"),
            "principal_pct": ratio(100.0 * F.coalesce(F.col("principal_usd").cast("double"), F.lit(0.0)), F.col("gross_usd").cast("double")),
            "lending_agent_pct": ratio(100.0 * F.coalesce(F.col("lending_agent_cents").cast("double"), F.lit(0.0)), F.col("lending_cents").cast("double")),
            "average_net_assets": F.when(F.col("has_average_nav"), F.col("gross_usd").cast("double")),
        }
        dropped = {*CENSUS_SUMS, "soft_dollar_flag", "soft_dollar_reported", "has_ncen", "has_average_nav"}
        rows = sums.join(f, "series_id")
        return rows.select(*[c for c in rows.columns if c not in dropped], filed.alias("has_census"),
                           *[F.when(filed, c).alias(k) for k, c in said.items()])

    def ncen(self) -> DataFrame:
        """One row per (fund, year): commissions, flags, average net assets; null where there is no census."""
        sums = self.holding().groupBy("series_id", "period").agg(*[F.sum(c).alias(c) for c in CENSUS_SUMS])
        return self.census_of(sums)

    def broker(self) -> DataFrame:
        """Broker lines of the census: one per (fund, year, broker)."""
        li, p = self.table("lineitem"), self.table("part")
        commission = money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)")
        return (
            li.join(p, li.l_partkey == p.p_partkey)
            .groupBy(
                F.col("l_suppkey").alias("series_id"), F.year("l_shipdate").alias("period"),
                F.col("p_brand").alias("broker_name"),
            )
            .agg(
                (F.sum(commission).cast("double") / 100).alias("gross_commission"),
                # filing order of the broker within its form
                F.min(F.struct("l_orderkey", "l_linenumber")).alias("position"),
            )
            .withColumn("is_affiliated", F.col("broker_name").isin(*AFFILIATED_BRANDS))
        )

    # -- fees ----------------------------------------------------------------

    def fee_snapshot(self) -> DataFrame:
        o = self.table("orders")
        k = F.round(F.col("o_totalprice") * 100).cast("bigint")
        st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
        base = o.select(
            F.col("o_custkey").alias("class_id"),
            (F.col("o_custkey") % F.lit(self.n_funds)).alias("series_id"),
            F.to_date("o_orderdate").alias("filing_date"),
            F.col("o_orderkey").alias("accession_no"),
            F.when(st == "F", "485BPOS").when(st == "O", "485APOS").otherwise("485BXT").alias("form_type"),
            (st == "P").alias("_blank"),
            pr.alias("_pr"),
            k.alias("_k"),
        )
        pct = lambda n: (F.col("_k") % n) / 100.0
        present = ~F.col("_blank")
        parts = base.select(
            "*",
            F.when(present, pct(150)).alias("management_fee"),
            F.when(present & (F.col("_pr") != "4-NOT SPECIFIED"), pct(26)).alias("twelve_b1_fee"),
            F.when(present, pct(41)).alias("other_expenses"),
            F.when(present & (F.col("_pr") != "2-HIGH"), pct(7)).alias("acquired_fund_fees"),
            F.when(present, pct(576)).alias("max_sales_load"),
            F.when(present, (F.col("_k") % 150).cast("double")).alias("portfolio_turnover"),
        )
        total = F.round(
            F.col("management_fee") + F.coalesce("twelve_b1_fee", F.lit(0.0)) + F.col("other_expenses"), 2
        )
        return (
            parts.withColumn("_total", total)
            .withColumn("total_annual_expenses", F.when(F.col("_pr") != "5-LOW", F.col("_total")))
            .withColumn(
                "net_expenses",
                F.when(
                    F.col("_pr") == "1-URGENT",
                    F.round(F.greatest(F.col("_total") - pct(11), F.lit(0.0)), 2),
                ),
            )
            .drop("_blank", "_pr", "_k", "_total")
        )

    # -- portfolios, lookups, events ------------------------------------------

    def position(self) -> DataFrame:
        li = self.by_key("lineitem", "l_orderkey")
        # an order is a portfolio of a few lines; all that is grouped by portfolio later stays in these partitions
        total = F.sum(money("l_quantity")).over(Window.partitionBy("l_orderkey"))
        blank = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7)
        ticker = F.concat(F.lit("FND"), F.col("l_suppkey").cast("string"))
        scale = 1 + ((F.col("l_orderkey") % 7) - 3) * 0.9 / 100
        return (
            li.withColumn("_total", total)
            .select(
                F.col("l_orderkey").alias("portfolio"),
                F.when(blank, " ").when(F.col("l_returnflag") == "R", F.concat(F.lit(" "), F.lower(ticker)))
                .otherwise(ticker).alias("ticker"),
                (100.0 * F.col("l_quantity") / F.col("_total").cast("double") * scale)
                .cast("decimal(18,8)").alias("weight"),
                F.when(
                    F.col("l_returnflag") == "N", F.concat(F.lit("Fund "), F.col("l_suppkey").cast("string"))
                ).alias("name"),
            )
        )

    def lookup(self) -> DataFrame:
        e = self.table("events")
        v = F.col("value")
        return e.select(
            "event_id", "ts",
            F.concat(F.lit("FND"), F.col("user_id").cast("string")).alias("ticker"),
            F.when(F.col("event_type") != "click", v * 0.8).alias("hidden_low_bps"),
            F.when(F.col("event_type") != "click", v * 1.2).alias("hidden_high_bps"),
            F.when(F.col("event_type") != "view", v / 2).alias("expense_ratio_bps"),
            F.when(F.col("event_type") == "purchase", F.lit(0.0)).otherwise(v / 4).alias("turnover_pct"),
            F.when(F.col("event_type") != "error", v * 10).alias("dollar_low"),
            F.when(F.col("event_type") != "error", v * 14).alias("dollar_high"),
        )

    def fund_event(self) -> DataFrame:
        """Deregistration and merger notices."""
        e = self.table("events")
        form = (
            F.when(F.col("event_type") == "error", "N-8F")
            .when(F.col("event_type") == "signup", "N-14")
            .otherwise("485BPOS")
        )
        return e.select(
            form.alias("form"),
            F.concat(F.lit("TRUST "), F.col("user_id").cast("string")).alias("company"),
            F.col("user_id").alias("cik"),
            F.to_date("ts").alias("date_filed"),
            F.concat(F.lit("edgar/data/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"))
            .alias("filing_path"),
        )
