import pytest
from pyspark.sql import functions as F

from dragline.functions.expr import dollars, hidden_grade, is_available, quarter_label, sum_present, tagged
from dragline.operators import costs, holdings, portfolio, structure

L = F.lit


def facts(spark, rows, nav, basis="reported"):
    h = spark.createDataFrame(
        [(1, 2024, *r) for r in rows],
        "series_id long, period int, name string, asset_category string, value_usd decimal(18,2), pct_of_net_assets double",
    )
    header = spark.createDataFrame([(1, 2024, nav, len(rows))], "series_id long, period int, net_assets double, n_holdings long")
    return holdings.fund_facts(holdings.holding_facts(holdings.category_sums(h, basis)), header, basis)


def spread(f, turnover):
    low, high = costs.spread_cost(F.col("covered_weight"), F.col("spread_low"), F.col("spread_high"), L(turnover))
    return tuple(f.select(low, high).first())


def test_one_stock_fund_spread(spark):
    f = facts(spark, [("APPLE INC", "EC", None, 100.0)], 1e6)
    assert spread(f, 0.30) == (3.0, 6.0)
    assert spread(f, 0.0) == (0.0, 0.0)


def test_spread_needs_half_coverage_and_rebases(spark):
    assert spread(facts(spark, [("A", "EC", None, 40.0)], 1e6), 0.3) == (None, None)
    assert spread(facts(spark, [("A", "EC", None, 80.0)], 1e6), 0.3) == (3.0, 6.0)


def test_unknown_category_uses_default_spread(spark):
    assert spread(facts(spark, [("A", "XYZ", None, 100.0)], 1e6), 0.5) == (10.0, 25.0)


def test_cash_by_value_and_by_percent(spark):
    from decimal import Decimal

    f = facts(spark, [("T-BILL 2025", "DBT", Decimal(-40000), 4.0), ("X", "STIV", None, 3.0), ("Y", "EC", Decimal(1000), 93.0)], 1e6)
    assert f.first()["cash_usd"] == pytest.approx(70000)
    d = costs.cash_drag(F.col("cash_usd"), F.col("nport_net_assets"))
    assert tuple(f.select(d["low"], d["high"], d["flagged"], d["tag"]).first()) == (10.0, 30.0, True, "ESTIMATED")


def test_impact_blend(one):
    low, high = costs.impact_blend(L(0.4), L(0.0), L(0.0))
    assert (one(low), one(high)) == (4.0, 8.0)
    assert one(costs.impact_blend(L(0.8), L(100.0), L(0.0))[1]) == 120.0
    assert one(costs.impact_blend(L(1.5), L(50.0), L(250.0))[0]) == 15.0  # all bond


def test_tax_drag(one):
    d = costs.tax_drag(L(0.5), L(True))
    assert [one(d[k]) for k in ("share", "short", "long", "income")] == [0.20, 32.1, 80.6, 0.0]
    bond = costs.tax_drag(L(0.0), L(False))
    assert (one(bond["income"]), one(bond["low"]), one(bond["high"])) == (183.2, 128.2, 238.2)


def test_etf_and_bond_names(one):
    assert one(costs.is_etf(L(""), L("Any Fund"))) and one(costs.is_etf(L("VFIAX"), L("x etf")))
    assert not one(costs.is_etf(L("VFIAX"), L("Index Fund")))
    assert one(costs.is_bond_name(L("Total Bond Market"))) and not one(costs.is_bond_name(L("Growth")))


def test_derivative_predicates(one):
    assert one(holdings.is_derivative(L("dfe"))) and not one(holdings.is_derivative(L("DBT")))
    assert not one(holdings.is_derivative(L(None).cast("string")))
    assert one(holdings.derivative_label(L("DIR"))) == "Interest Rate" and one(holdings.derivative_label(L("DX"))) == "DX"


def test_underlying_fund_predicate(one):
    p = lambda issuer, name, cat, pct: one(holdings.is_underlying_fund(L(issuer), L(name), L(cat), L(pct)))
    assert p("RF", "X", "EC", 1.0) and p("CORP", "Total Return Fund", "EC", 1.0)
    assert not p("CORP", "Asset Backed Securities Trust", "DBT", 1.0) and not p("CORP", "Home Trust", "ABS-O", 1.0)
    assert p("CORP", "Sweep", "STIV", 6.0) and not p("CORP", "Sweep", "STIV", 4.0) and not p("CORP", "Entrusted", "EC", 9.0)


def test_small_helpers(one):
    assert [one(hidden_grade(L(x))) for x in (7.0, 17.5, 35.0, 70.0, 125.0)] == list("ABCDF")
    assert [one(dollars(L(x))) for x in (1.5e12, 2.5e9, 3.5e6, 1234.0)] == ["$1.5T", "$2.5B", "$3.5M", "$1,234"]
    assert one(quarter_label(F.to_date(L("2026-07-05")))) == "2026-Q3"
    none = L(None).cast("double")
    assert one(sum_present(none, L(2.0))) == 2.0 and one(sum_present(none, none)) is None
    t = tagged(L(1.0), "NOT_DISCLOSED")
    assert one(t)["tag"] == "NOT_DISCLOSED" and not one(is_available(L(1.0), L("NOT_DISCLOSED")))


def _direct(spark, rows):
    return spark.createDataFrame([(s, 2024, d) for s, d in rows], "series_id long, period int, direct_bps double")


def _edge(spark, rows):
    return spark.createDataFrame([(p, 2024, c, 1, w) for p, c, w in rows],
                                 "parent long, period int, child long, positions long, weight double").withColumn("weight", F.col("weight").cast("decimal(28,12)"))


def test_roll_up(spark):
    out = structure.roll_up(_direct(spark, [(1, 25.0), (2, 40.0), (3, 60.0), (4, None)]), _edge(spark, [(1, 2, 0.6), (1, 3, 0.4), (4, 2, 0.5)]))
    got = {r["series_id"]: (r["underlying_bps"], r["total_bps"]) for r in out.collect()}
    assert got == {1: (48.0, 73.0), 2: (None, 40.0), 3: (None, 60.0), 4: (20.0, 20.0)}


def test_roll_up_stops_cycles_at_the_depth_bound(spark):
    out = structure.roll_up(_direct(spark, [(1, 10.0)]), _edge(spark, [(1, 1, 1.0)]))
    assert out.first()["total_bps"] == 30.0  # three levels
    m = structure.members(_direct(spark, [(1, 10.0)]), _edge(spark, [(1, 1, 1.0)]))
    assert sorted(r["depth"] for r in m.collect()) == [0, 1, 2]


def test_missing_children_are_counted_not_rebased(spark):
    r = structure.roll_up(_direct(spark, [(1, None), (2, 50.0), (3, None)]), _edge(spark, [(1, 2, 0.5), (1, 3, 0.5)])).filter("series_id = 1").first()
    assert (r["underlying_bps"], r["missing"], r["covered_weight"]) == (25.0, 1, 0.5)


def test_wrapper_refuses_thin_coverage(spark):
    stated = spark.createDataFrame([(1, 75.0), (2, 40.0), (3, None)], "series_id long, er_bps double")
    r = structure.wrapper_decomposition(stated, _edge(spark, [(1, 2, 0.8), (1, 3, 0.2)])).first()
    assert (r["weighted_underlying_bps"], r["wrapper_bps"], r["coverage_ok"], r["publishable"]) == (40.0, 35.0, False, False)


def test_portfolio_means(spark):
    pos = spark.createDataFrame([(1, " aaaax", 30.0, None), (1, "AAAAX", 30.0, "A"), (1, "BBBBX", 30.0, None), (1, "CCCCX", 10.0, None), (1, " ", 5.0, None)],
                                "portfolio long, ticker string, weight double, name string").withColumn("weight", F.col("weight").cast("decimal(18,8)"))
    cost = spark.createDataFrame([("AAAAX", 4.0), ("BBBBX", 11.0), ("CCCCX", 5.0)], "ticker string, er_bps double").select(
        "ticker", "er_bps", L(None).cast("double").alias("brokerage_bps"), L(None).cast("double").alias("underlying_bps"), F.col("er_bps").alias("total_bps"))
    c = portfolio.collapse(pos)
    v = portfolio.validation(c)
    assert v.first()["status"] == "accepted"
    s = portfolio.summary(portfolio.priced(c, v, cost)).first()
    assert s["true_tco_bps"] == pytest.approx(6.2) and s["hidden_gap_bps"] == pytest.approx(0.0)
    part = portfolio.summary(portfolio.priced(c, v, cost.filter("ticker <> 'BBBBX'"))).first()
    assert part["priced_fraction"] == pytest.approx(0.7) and part["unpriced_fraction"] == pytest.approx(0.3)


def test_portfolio_rejections(spark):
    pos = spark.createDataFrame([(1, "A", 50.0), (2, "A", 101.0), (3, "A", 110.0), (3, "B", -10.0)], "portfolio long, ticker string, weight double").select(
        "portfolio", "ticker", F.col("weight").cast("decimal(18,8)").alias("weight"), L(None).cast("string").alias("name"))
    got = {r["portfolio"]: r["status"] for r in portfolio.validation(portfolio.collapse(pos)).collect()}
    assert got == {1: "rejected_total", 2: "normalised", 3: "rejected_non_positive"}
