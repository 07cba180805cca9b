"""Every registered query of the subpackage on the small tables; SQL beside Spark where there is SQL."""

import pathlib

import pytest

SF = "/root/testdata/sf0.001"
if not pathlib.Path(SF).exists():
    pytest.skip("test tables are not present", allow_module_level=True)

import __spark_entry__ as entry
from compare import check, duck

from dragline.llm import queries


def test_names():
    assert sorted(queries.QUERIES) == sorted(
        ["op1_lm_score", "op2_warc", "op3_token_count", "op4_mixing", "op5_toxicity", "op6_simhash", "op7_decontaminate",
         "op8_exact_dedup", "op9_sharding", "op10_line_dedup", "op11_hard_negatives", "op12_bpe_codec",
         "op13_collocations"])
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    ok, message, _, _ = check(spark, duck(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


@pytest.mark.parametrize("name", ["op1_lm_score", "op3_token_count", "op4_mixing", "op5_toxicity", "op6_simhash", "op9_sharding",
                                  "op12_bpe_codec"])
def test_one_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert entry.queries()[name](spark, SF).select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    assert entry.queries()[name](spark, SF).count() == docs.count()
