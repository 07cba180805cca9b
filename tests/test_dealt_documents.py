"""Documents made from a few narrow columns are parsed by all tasks, and parsing takes few steps a character."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from dragline.functions import text as X
from dragline.operators import filing_prose
from dragline.plans import filings
from dragline.sources.fund_views import FundViews

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("docs", ["_fee_docs", "_class_docs", "_prose_docs", "_report_docs", "_census_docs"])
def test_documents_of_one_split_reach_all_tasks(spark, docs):
    made = getattr(filings, docs)(FundViews(spark, SMALL))
    sizes = [len(p) for p in made.select(F.lit(1)).rdd.glom().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * sum(sizes) / len(sizes) + 8


def test_tables_rows_and_cells_equal_the_plain_patterns(spark):
    rnd = random.Random(5)
    parts = ["<table>", "</table>", "<TABLE x=1>", "<tr>", "</tr>", "<tr class=a>", "<track>", "<td>", "</td>", "<th>", "</TH>", "<td a>", "x", " 1 % ", "<b>", "</b>", "<", ">"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(500)]
    plain = lambda p, t, g=0: [m.group(g) for m in re.finditer(p, t)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tables(F.col("t")).alias("a"), X.table_rows(F.col("t")).alias("b")).collect()
    for r in rows:
        assert r.a == plain(r"(?is)<table\b.*?(?:</table>|\Z)", r.t)
        assert r.b == plain(r"(?is)<tr\b.*?(?=<tr\b|</tr>|</table>|\Z)", r.t)


def test_cells_that_are_no_numbers_are_not_cast(one):
    values = ["", "12", " 1,5", "$ 7", "NaN", "Infinity", "-inf", "1e3", ".5", "Series P1", "FY 2022", "n/a", "7d", "0x10", None]
    for v in values:
        c = F.lit(v).cast("string")
        assert str(one(filing_prose._number(c))) == str(one(c.try_cast("double"))), v


def test_names_are_looked_for_only_where_a_cue_is(spark):
    html = "The shares and papers of the holders are described here. " * 6000  # names of letters everywhere, no cue
    started = time.time()
    d = spark.createDataFrame([(i, html, "Alpha Trust") for i in range(4)], "id int, html string, company string").repartition(1)
    kinds = {r.reorganization_type for r in filing_prose.merger_facts(d, "id", "html", "company").collect()}
    assert kinds == {"filing-available"} and time.time() - started < 5
