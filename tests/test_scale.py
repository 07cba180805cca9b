import random

from pyspark.sql import functions as F

from dragline.scale import previous_row, ranked

random.seed(7)
# one key holds most rows; values tie
ROWS = [("hot" if random.random() < 0.6 else f"k{random.randrange(9)}", random.randrange(40), i) for i in range(3000)]


def frame(spark):
    return spark.createDataFrame(ROWS, "k string, v int, id long").repartition(7)


def test_global_rank(spark):
    got = {r["id"]: r["rank"] for r in ranked(frame(spark), [F.col("v").desc(), F.col("id").asc()]).collect()}
    want = {r[2]: i for i, r in enumerate(sorted(ROWS, key=lambda r: (-r[1], r[2])), 1)}
    assert got == want


def test_rank_within_groups(spark):
    out = ranked(frame(spark), [F.col("v").asc(), F.col("id").asc()], group=["k"], size="n").collect()
    want = {}
    for k in {r[0] for r in ROWS}:
        mine = sorted((r for r in ROWS if r[0] == k), key=lambda r: (r[1], r[2]))
        want.update({r[2]: (i, len(mine)) for i, r in enumerate(mine, 1)})
    assert {r["id"]: (r["rank"], r["n"]) for r in out} == want


def test_previous_row_crosses_partitions(spark):
    out = previous_row(frame(spark), ["k"], [F.col("v").asc(), F.col("id").asc()], ["v", "id"]).collect()
    before, want = {}, {}
    for k, v, i in sorted(ROWS, key=lambda r: (r[0], r[1], r[2])):
        want[i], before[k] = before.get(k), i
    assert {r["id"]: (r["prev"]["id"] if r["prev"] else None) for r in out} == want
