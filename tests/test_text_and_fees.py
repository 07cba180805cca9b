from pyspark.sql import functions as F

from dragline.functions import names as N
from dragline.functions import text as X
from dragline.operators import fees, filing_prose, history, readability
from dragline.operators.resolve import alias_search

L = F.lit


def test_syllables(one):
    assert [one(X.syllables(L(w))) for w in ("", "cat", "apple", "wonderful", "make", "table")] == [0, 1, 2, 3, 1, 2]


def test_passive(one):
    assert one(X.is_passive(L("The fee Was not disclosed"))) and one(X.is_passive(L("costs are being paid")))
    assert not one(X.is_passive(L("The fund pays fees")))


def test_nesting_depth(one):
    assert one(X.nesting_depth(L("<table><TABLE border=1></table></table><table></table>"))) == 2


def test_short_text_scores_nothing(spark):
    r = readability.score(spark.createDataFrame([(1, "too short"), (2, "")], "id int, text string"), "id").collect()
    assert all(x["overall_score"] == 0.0 and x["grade"] == "" for x in r)


def test_structure_raises_complexity(spark):
    t = "The quick management of the fund is described in plain words for holders. " * 3
    d = spark.createDataFrame([(1, t, '<table><table></table></table> (1) see note. refer to "x"')], "id int, text string, html string")
    r = readability.score(d, "id", html="html").first()
    assert (r["footnote_count"], r["cross_reference_count"], r["nesting_depth"], r["complexity_score"]) == (1, 1, 2, 30.8)


def test_dollar_context(one):
    got = one(X.dollar_amounts(L("paid $1,234.50 and $ 7 more"), 5))
    assert [(r["amount"], r["context"]) for r in got] == [(1234.5, "paid $1,234.50 and "), (7.0, " and $ 7 more")]


def test_section_tries_patterns_in_order(one):
    t = L("alpha beta START one two END three STOP four")
    assert one(X.section(t, ("missing", "start"), ("stop", "end"))) == "START one two END three "
    assert one(X.section(t, ("missing",), ("stop",))) is None


def test_names(one):
    assert one(N.peeled(L("Vanguard Cmt Funds-Vanguard Market Liquidity Fund"))) == "Vanguard Market Liquidity Fund"
    assert one(N.peeled(L("iShares Trust - iShares Core S&P 500 ETF"))) == "iShares Core S&P 500 ETF"
    assert one(N.embedded_ticker(L("500 Index Fund (VFIAX)"))) == "VFIAX" and one(N.embedded_ticker(L("EQUITY INDEX 500"))) is None
    assert one(N.isin_cusip(L("US0378331005"))) == "037833100" and one(N.isin_cusip(L("GB0378331005"))) is None
    assert one(N.normalised(L("The Growth Fund - Investor Shares (A)"))) == "growth fund"
    assert one(N.expanded(L("Intl Mkt Corp"))) == "International Markets Corporate"


def test_alias_search(spark):
    a = spark.createDataFrame([(0, "GROWTH FUND", "AAAAX", "A Growth"), (1, "BIG GROWTH", "BBBBX", "B"), (2, "GROWTH", "AAAAX", "A Growth"), (3, "NEW GROWTH", "CCCCX", "Longer name")],
                              "position int, alias string, ticker string, name string")
    q = spark.createDataFrame([("growth",), ("g",), ("zzz",)], "query string")
    got = [(r["rank"], r["ticker"]) for r in alias_search(q, a, 2).orderBy("rank").collect()]
    assert got == [(1, "AAAAX"), (2, "BBBBX")]


HTML = """<h2>Annual Fund Operating Expenses</h2><table>
<tr><td></td><td>Class A</td><td>Class I ABCDX</td></tr>
<tr><td>Management Fee</td><td>0.50%</td><td>0.25 %</td></tr>
<tr><td>Distribution (12b-1) Fees</td><td>0.25%</td><td>None</td></tr>
<tr><td>Total Annual Fund Operating Expenses</td><td>0.75%</td><td>0.30%</td></tr>
<tr><td>Fee Waiver</td><td>0.05%</td><td>0.02%</td></tr>
<tr><td>Total Annual Fund Operating Expenses After Fee Waiver</td><td>0.70%</td><td>0.28%</td></tr></table>
<p>portfolio turnover rate was 45% of the average value. Maximum sales charge (load): 5.75%</p>"""


def test_fee_table_picks_the_class_column_and_keeps_gross_and_net(spark):
    d = spark.createDataFrame([(1, HTML, "ABCDX"), (2, HTML, "ZZZZX")], "id int, html string, ticker string")
    r = {x["id"]: x for x in fees.table_fees(d, "id", "html", "ticker").collect()}
    pick = lambda x: (x["management_fee"], x["total_annual_expenses"], x["net_expenses"], x["portfolio_turnover"], x["max_sales_load"])
    assert pick(r[1]) == (0.25, 0.30, 0.28, 45.0, 5.75)
    assert pick(r[2]) == (0.50, 0.75, 0.70, 45.0, 5.75)


def test_percent_in(one):
    assert [one(fees.percent_in(L(x))) for x in ("0.50%", " None ", "—", "2024", "1.25", "n/a")] == [0.5, None, None, None, 1.25, None]


def test_scaled_percent(one):
    assert one(fees.scaled_percent(L(0.0092))[0]) == 0.92
    assert one(fees.scaled_percent(L(-0.25))[0]) is None and one(fees.scaled_percent(L(0.25))[1]) is True


def test_tagged_facts_prefer_the_first_taxonomy(spark):
    ctx = "Context_2025_C000002259Member_S000000769Member_"
    f = spark.createDataFrame([
        ("a", ctx, "rr:ManagementFeesOverAssets", 0.009, None, 1), ("a", ctx, "oef:ManagementFeesOverAssets", None, "0.0044", 2),
        ("a", ctx, "oef:OtherExpensesOverAssets", 0.001, None, 3), ("a", "S000000769", "oef:ExpensesOverAssets", 0.5, None, 4),
    ], "accession_no string, context_ref string, concept string, numeric_value double, value string, position int")
    r = fees.tagged_fees(f).first()
    assert (r["series_id"], r["class_id"], r["management_fee"], r["other_expenses"], r["total_annual_expenses"]) == ("S000000769", "C000002259", 0.44, 0.1, None)


def test_zero_fee_guard(one):
    z, n = L(0.0), L(None).cast("double")
    assert one(history.is_zero_fee(n, z, n)) and not one(history.is_zero_fee(L(0.1), z, n)) and not one(history.is_zero_fee(n, n, n))


def test_fee_change_uses_the_previous_snapshot_only(spark):
    rows = [(1, "2020-01-01", 1, 0.50), (1, "2021-01-01", 2, None), (1, "2022-01-01", 3, 0.60), (1, "2023-01-01", 4, 0.70), (2, "2023-01-01", 5, 0.9)]
    d = spark.createDataFrame(rows, "class_id int, filing_date string, accession_no int, management_fee double")
    for c in ("twelve_b1_fee", "other_expenses", "total_annual_expenses", "net_expenses", "max_sales_load"):
        d = d.withColumn(c, L(None).cast("double"))
    got = [(r["accession_no"], r["change_bps"], r["direction"]) for r in history.fee_changes(d).collect()]
    assert got == [(4, 10.0, "increase")]


def test_merger_kinds(spark):
    rows = [(1, "Acme Trust", "<p>Notice; the Acme Growth Fund will be reorganized into the Acme Value Fund, a series of the trust</p>"),
            (2, "Acme Trust", "; merger of the Other Income Fund with and into Acme Value"), (3, "Acme", "nothing"), (4, "Acme", None)]
    m = filing_prose.merger_facts(spark.createDataFrame(rows, "id int, company string, html string"), "id", "html", "company")
    got = {r["id"]: (r["reorganization_type"], r["targets"], r["acquirers"]) for r in m.collect()}
    assert got[1] == ("same-complex", ["Acme Growth Fund"], ["Acme Value Fund"])
    assert got[2][0] == "partial" and got[3][0] == "filing-available" and got[4][0] == "unknown"


def test_long_fee_table_is_read_to_its_end(spark):
    style = "<i style='" + "x" * 2000 + "'></i>"
    rows = "".join(f"<tr><td>{style}note {k}</td><td>{style}text</td></tr>" for k in range(25))
    html = (f"<h1>Annual Fund Operating Expenses</h1><table><tr><td>Management fees</td><td>0.40%</td></tr>{rows}"
            f"<tr><td>Total annual fund operating expenses</td><td>0.75%</td></tr></table><table><tr><td>Management fees</td><td>9.99%</td></tr></table>")
    assert len(html) > 50_000
    r = fees.table_fees(spark.createDataFrame([(1, html, "AAAAX")], "id int, html string, ticker string"), "id", "html", "ticker").first()
    assert (r["management_fee"], r["total_annual_expenses"], r["layout"]) == (0.4, 0.75, "table")


def test_merger_names_all_funds(spark):
    html = "".join(f"; the {k} Income Fund will be reorganized into the Big Growth Fund, a series. " for k in ("Alpha", "Beta", "Gamma", "Delta", "Omega"))
    r = filing_prose.merger_facts(spark.createDataFrame([(1, html, "Alpha Trust")], "id int, html string, company string"), "id", "html", "company").first()
    assert len(r["targets"]) == 5


def test_a_section_ends_behind_its_start(one):
    """An end that lies within the match of the start is none; of several ends the first pattern that occurs wins."""
    t = F.lit("x Start end of heading: one\nEND two stop three")
    assert one(X.section(t, (r"start.*?heading",), ("stop", "end"))) == "Start end of heading: one\nEND two "
    assert one(X.section(t, (r"start.*?heading",), ("end", "stop"))) == "Start end of heading: one\n"
    for end in ("s?top", "(?:halt|(?:st|x)op)", "[s]top", "s*top"):
        assert one(X.section(t, ("start",), (end,))) == "Start end of heading: one\nEND two " + ("s" if end == "x" else "")


def test_a_statement_has_its_amounts_without_a_join_or_a_second_shuffle(spark):
    from dragline.plans import registry

    df = registry.QUERIES["statement_commissions"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_each_row_of_a_class_block_is_read_once(spark):
    page = "<p>Share class: A C R-6 </p><p>Management fees 0.10 0.20 {} Total annual fund operating expenses 1.10 1.20 {}</p>"
    docs = spark.createDataFrame([(1, "Share class: R-6 9.99 Management fees 1.11 " + page.format("none", "0.45"), "Class R-6"), (2, page.format("0.30", ""), "R-6"),
                                  (3, page.format("0.30", "7.5"), "class F")], "k int, html string, cls string")
    out = fees.class_table_fees(docs, "k", "html", "cls")
    assert [(r.k, r.class_label, r.n_classes, r.management_fee, r.total_annual_expenses, r.net_expenses) for r in out.collect()] == [(1, "R-6", 3, 0.0, 0.45, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|none)") == len(fees.CLASS_ROWS) and plan.count("Share class:\\s+(") == 1


def test_a_fee_page_is_read_once(spark):
    """Cells, labels and figures are evaluated once for each of the two readings, and so are texts that may be empty."""
    row = "<tr><td>{}</td><td>{}</td><td>9 %</td></tr>"
    page = "<table><tr><td>x</td></tr></table><TABLE class=a><td>Annual Fund Operating Expenses</td>" + row.format("Management&nbsp;Fees", "0.5 %") + "</table>" + row.format("Other expenses", "7%")
    docs = spark.createDataFrame([(1, page + "portfolio <b></b><i>turnover</i> was 12 %", "TA"), (2, row.format("Total annual operating", "1.5%") + "maximum sales charge 3.5%", None),
                                  (3, "fee table <p>nothing</p>", ""), (4, None, "T")], "k int, html string, ticker string")
    out = fees.table_fees(docs, "k", "html", "ticker")
    assert sorted((r.k, r.layout, r.management_fee, r.other_expenses, r.total_annual_expenses, r.portfolio_turnover, r.max_sales_load) for r in out.collect()) == [
        (1, "table", 0.5, None, None, 12.0, None), (2, "cells", None, None, 1.5, None, 3.5), (3, None, None, None, None, None, None), (4, None, None, None, None, None, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(fees.NET_LABEL) == 3 and plan.count("maximum\\s+") == 2
    # the cells of the whole page are made inside the second reading, not beside the first as a column of their own
    assert plan.count("Generate") == 1 and plan.count("Project") <= 1
