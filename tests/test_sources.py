from pyspark.sql import functions as F

from dragline.sources import filings_xml as XML
from dragline.sources import indexes, sinks

NS = 'xmlns="http://www.sec.gov/edgar/nport"'


def form(series, positions):
    return (f"<edgarSubmission {NS}><formData><genInfo><seriesId>{series}</seriesId><repPdDate>2024-06-30</repPdDate></genInfo>"
            f"<fundInfo><netAssets>1000</netAssets></fundInfo><invstOrSecs>{positions}</invstOrSecs></formData></edgarSubmission>")


FORWARD = """<invstOrSec><name>N/A</name><valUSD>18930</valUSD><pctVal>0.0004</pctVal><assetCat>DFE</assetCat><derivativeInfo><fwdDeriv>
<counterpartyInfo><counterpartyName>BANK PLC</counterpartyName><counterpartyLei>L1</counterpartyLei></counterpartyInfo>
<amtCurSold>-2048807.49</amtCurSold><curSold>USD</curSold><unrealizedAppr>18930.44</unrealizedAppr></fwdDeriv></derivativeInfo></invstOrSec>"""
SWAP = """<invstOrSec><name>IRS</name><valUSD>-4165623.66</valUSD><assetCat>DIR</assetCat><derivativeInfo><swapDeriv>
<notionalAmt>471429000</notionalAmt><curCd>EUR</curCd></swapDeriv></derivativeInfo></invstOrSec>"""
STOCK = "<invstOrSec><name> APPLE </name><cusip>037833100</cusip><valUSD>bad</valUSD><assetCat>EC</assetCat></invstOrSec><invstOrSec><name></name></invstOrSec>"


def test_holdings_form(spark):
    docs = spark.createDataFrame([("S1", form("S1", FORWARD + SWAP + STOCK)), ("S2", form("S9", STOCK)), ("S3", form("", STOCK)), ("S4", "<edgarSubmission><formData>")],
                                 "series_id string, xml string")
    f = XML.parse_holdings_form(docs)
    assert {r["series_id"]: str(r["period_end"]) for r in f.collect()} == {"S1": "2024-06-30", "S3": "2024-06-30"}
    h = {(r["series_id"], r["name"]): r for r in XML.holdings_of(f).collect()}
    assert set(h) == {("S1", "N/A"), ("S1", "IRS"), ("S1", "APPLE"), ("S3", "APPLE")}
    fwd, swap, stock = h["S1", "N/A"], h["S1", "IRS"], h["S1", "APPLE"]
    assert (fwd["instrument_type"], fwd["notional_usd"], fwd["counterparty_name"], fwd["unrealized_usd"]) == ("fwdDeriv", 2048807.49, "BANK PLC", 18930.44)
    assert (swap["instrument_type"], swap["notional_usd"]) == ("swapDeriv", None)  # not in dollars
    assert stock["value_usd"] is None and stock["instrument_type"] is None and stock["cusip"] == "037833100"


def test_census_section_matching(spark):
    sec = lambda sid: f"<managementInvestmentQuestion><mgmtInvSeriesId>{sid}</mgmtInvSeriesId><aggregateCommission>5</aggregateCommission></managementInvestmentQuestion>"
    doc = lambda *s: "<edgarSubmission><formData><managementInvestmentQuestionSeriesInfo>" + "".join(s) + "</managementInvestmentQuestionSeriesInfo></formData></edgarSubmission>"
    docs = spark.createDataFrame([("S1", doc(sec("S9"), sec("S1"))), ("S2", doc(sec(""))), ("S3", doc(sec("S9"))), ("S4", doc(sec(""), sec("")))], "series_id string, xml string")
    assert sorted(r["series_id"] for r in XML.parse_census_form(docs).collect()) == ["S1", "S2"]


def test_form_index_in_both_layouts(spark):
    lines = ["Form Type   Company", "-----------", "N-8F        OLD TRUST                                                     123       2024-03-05  edgar/data/123/a.txt",
             "N-14 8C          NEW FUND INC                 77          2024-03-06  edgar/data/77/b.txt", "10-K        X   1  2024-01-01  y"]
    r = indexes.form_index(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("cik").collect()
    assert [(x["form"], x["company"], x["cik"], str(x["date_filed"]), x["event"]) for x in r] == [
        ("N-14 8C", "NEW FUND INC", 77, "2024-03-06", "merger/reorg"), ("N-8F", "OLD TRUST", 123, "2024-03-05", "deregistration")]


def test_census_last_row_wins(spark):
    rows = [("0000012", "S1", "C1", " abcdx ", 0), ("13", "S2", "C2", "ABCDX", 1), ("14", "S3", "C3", "", 2), ("15", "", "C4", "ZZZZX", 3)]
    d = spark.createDataFrame(rows, "`﻿CIK Number` string, `Series ID` string, `Class ID` string, `Class Ticker` string, n int")
    assert [tuple(r) for r in indexes.census(d, F.col("n")).collect()] == [("ABCDX", 13, "S2", "C2")]


def test_portfolio_text(spark):
    lines = ["VTSAX 60", "VTIAX, 30", "vbtlx: 10%", "# c", "", "ONLY", "AB1 5", "VTSAX x"]
    d = spark.createDataFrame([(x, i) for i, x in enumerate(lines, 1)], "value string, line int")
    r = {x["line"]: (x["ticker"], x["weight"], x["error"]) for x in indexes.portfolio_lines(d).collect()}
    assert r[1] == ("VTSAX", 60.0, None) and r[2][1] == 30.0 and r[3][:2] == ("VBTLX", 10.0) and set(r) == {1, 2, 3, 6, 7, 8}
    assert r[6][2] == "expected ticker and weight" and r[7][2] == "not a fund ticker" and r[8][2] == "weight is not a number"


def test_header_without_ticker_and_series_reset(spark):
    h = "CENTRAL INDEX KEY: 0000099\n<SERIES-ID>S000000001\n<CLASS-CONTRACT-ID>C000000001\n<CLASS-CONTRACT-TICKER-SYMBOL>aaax\n<SERIES-ID>S000000002\n<CLASS-CONTRACT-ID>C000000002\n"
    r = indexes.header_classes(spark.createDataFrame([(1, h)], "accession_no int, header_text string")).orderBy("class_id").collect()
    assert [(x["cik"], x["series_id"], x["class_id"], x["ticker"]) for x in r] == [(99, "S000000001", "C000000001", "AAAX"), (99, "S000000002", "C000000002", None)]


def test_documents_skip_manifest_and_broken_files(spark, tmp_path):
    (tmp_path / "A.json").write_text('{"ticker": "A"}')
    (tmp_path / "B.json").write_text('{"ticker": "B"')
    (tmp_path / "manifest.json").write_text('{"ticker": "M"}')
    assert [r["ticker"] for r in sinks.read_documents(spark, str(tmp_path), "ticker string").collect()] == ["A"]


def test_snapshots_resume_and_force(spark, tmp_path):
    root = str(tmp_path / "snap")
    d = lambda *t: spark.createDataFrame([(x, 1) for x in t], "ticker string, v int")
    outcome = lambda df: {r["ticker"]: r["outcome"] for r in df.collect()}
    assert outcome(sinks.write_snapshots(d("A"), root, "2026-Q3")) == {"A": "written"}
    assert outcome(sinks.write_snapshots(d("A", "B"), root, "2026-Q3")) == {"A": "skipped", "B": "written"}
    assert outcome(sinks.write_snapshots(d("A"), root, "2026-Q3", force=True)) == {"A": "written"}
    assert outcome(sinks.write_snapshots(d("A"), root, "2026-Q4")) == {"A": "written"}


def test_holdings_form_reads_only_what_is_asked_for(spark):
    """Equal values with and without the other elements, for whole, bare, foreign, torn and odd documents."""
    bare = f"<edgarSubmission {NS}><formData><invstOrSecs>{STOCK}</invstOrSecs></formData></edgarSubmission>"
    odd = form("S1", "<invstOrSec><name lang='en'>A</name><identifiers>x<isin value='I1'/></identifiers><assetCat a='1'>DE</assetCat><derivativeInfo b='2'>y<optionSwaptionWarrantDeriv/></derivativeInfo></invstOrSec>")
    texts = [form("S1", FORWARD + SWAP + STOCK), form("S9", STOCK), form("", STOCK), bare, odd, form("S1", FORWARD)[:-30], form("S1", "<invstOrSec><name>A</invstOrSec>"),
             "<edgarSubmission><formData/></edgarSubmission>", "<edgarSubmission/>", "", "x"]
    docs = spark.createDataFrame([("S1", i, x) for i, x in enumerate(texts)], "series_id string, n int, xml string")
    whole = XML.parse_holdings_form(docs)
    rows = lambda d: sorted(map(str, d.collect()))
    header = XML.parse_holdings_form(docs, columns=())
    assert header.columns == ["series_id", "n", "period_end", "net_assets"] and rows(header) == rows(whole.select(header.columns))
    assert len(rows(header)) >= 4
    full = XML.holdings_of(whole)
    for some in (("value_usd", "balance", "cusip", "isin"), ("instrument_type", "counterparty_name", "notional_usd", "unrealized_usd"), ("country",)):
        part = XML.holdings_of(XML.parse_holdings_form(docs, columns=some))
        assert set(some) <= set(part.columns) < set(full.columns) and rows(part) == rows(full.select(part.columns)), some
