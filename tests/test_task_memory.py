"""What one task holds does not grow with the input."""

from dragline.operators import holdings, portfolio
from dragline.sources import fund_views


def test_positions_are_dealt_by_row_count_and_stay_there(spark, monkeypatch):
    monkeypatch.setattr(fund_views, "ROWS_PER_TASK", 100)
    v = fund_views.FundViews(spark, "/root/testdata/sf0.001")
    rows = v.table("lineitem").count()
    out = portfolio.validation(portfolio.collapse(v.position()))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert v.position().rdd.getNumPartitions() == -(-rows // 100)


def test_positions_are_dealt_by_fund_before_they_are_added_up(spark):
    """A task keeps groups of its own funds only; a fund with most of the rows may still be split and combined before the shuffle."""
    rows = spark.range(20000).selectExpr(
        "if(id % 3 = 0, id % 200, 7) as series_id", "cast(2020 + id % 2 as int) as period", "if(id % 5 = 0, null, concat('C', id % 4)) as asset_category",
        "if(id % 11 = 0, 'Money Market', 'Corp') as name", "cast(if(id % 13 = 0, null, id - 9000) as decimal(18,2)) as value_usd", "cast(id as decimal(18,2)) as gross_usd")
    out = holdings.category_sums(rows, small_position=500.0, also=("gross_usd",))
    got = {tuple(r) for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and plan.count("Exchange hashpartitioning") == 2 and plan.count("HashAggregate") == 2
    rows.createOrReplaceTempView("dealt_rows")
    want = {tuple(r) for r in spark.sql("""
        SELECT series_id, period, asset_category, count(*), sum(value_usd), sum(if(value_usd > 0, value_usd, null)), sum(if(value_usd > 0 and value_usd < 500, value_usd, null)),
          sum(if(name = 'Money Market' and value_usd <> 0, abs(value_usd), null)), cast(null as decimal(28,8)), sum(gross_usd) FROM dealt_rows GROUP BY 1, 2, 3""").collect()}
    assert got == want and len(got) > 200
