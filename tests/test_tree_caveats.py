from pyspark.sql import functions as F

from dragline.operators import quality, structure


def test_tree_caveats_equal_those_of_laid_out_members(spark):
    """Cycles, several paths, funds without notes, and a tree without any."""
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 3), ("c", "a", 1), ("c", "d", 5), ("d", "e", 2), ("x", "y", 1)]
    edge = spark.createDataFrame([(p, 1, c, n) for p, c, n in edges], "parent string, period int, child string, positions long")
    notes = spark.createDataFrame([(t, 1, n) for t in "abe" for n in "uv"[: 1 + (t == "b")]] + [("c", 2, "u")], "ticker string, period int, note string")
    members = structure.members(
        edge.select(F.col("parent").alias("series_id"), "period").distinct(), edge.withColumn("weight", F.lit(1).cast("decimal(28,12)")))
    want = {tuple(r) for r in quality.caveat_counts(notes, members.select("root", "member", "period", "paths")).collect()}
    got = {tuple(r) for r in quality.tree_caveat_counts(quality.caveat_counts(notes), edge).collect()}
    assert got == want and ("x", 1) not in {g[:2] for g in got} and len(got) >= 4
