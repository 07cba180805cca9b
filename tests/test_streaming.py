"""Streams whose rows come late, in any order and more than once."""

import datetime as dt
import random

import pytest

from dragline.operators import ranking
from dragline.streaming import jobs

LOOKUPS = ("event_id long, ts timestamp, ticker string, hidden_low_bps double, hidden_high_bps double, expense_ratio_bps double,"
           " turnover_pct double, dollar_low double, dollar_high double")


def deliver(spark, slices, schema, root, start):
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/part={i}")
        start(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")).awaitTermination()


def lookups(n):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        when = dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 700), seconds=rnd.randint(0, 3))
        low = None if i % 11 == 0 else float(rnd.randint(1, 90))
        rows.append((i, when, f"F{rnd.randint(0, 6)}", low, low and low * 2, 5.0, float(i % 7), 1.0, float(i)))
    return sorted(rows, key=lambda r: r[1])


def test_board_of_lookups_that_come_years_late_and_twice(spark, tmp_path):
    rows = lookups(120)
    slices = [rows[80:], rows[40:80], rows[:40], rows[40:80] + rows[100:], rows[:5]]
    deliver(spark, slices, LOOKUPS, tmp_path, lambda s: jobs.start_board(s, f"{tmp_path}/state", f"{tmp_path}/ck"))
    got = jobs.stored_board(spark, f"{tmp_path}/state")
    want = ranking.board(spark.createDataFrame(rows, LOOKUPS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert sum(r.lookup_count for r in got.collect()) == sum(r[3] is not None for r in rows)


def test_a_batch_that_is_replayed_changes_nothing(spark, tmp_path):
    rows = lookups(60)
    start = lambda s: jobs.start_board(s, f"{tmp_path}/state", f"{tmp_path}/ck")
    deliver(spark, [rows[:30], rows[30:]], LOOKUPS, tmp_path, start)
    before = sorted(map(tuple, jobs.stored_board(spark, f"{tmp_path}/state").collect()))
    (tmp_path / "ck/commits/1").unlink()  # as if the driver died before it noted that the batch was done
    (tmp_path / "ck/commits/.1.crc").unlink(missing_ok=True)
    start(spark.readStream.schema(LOOKUPS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")).awaitTermination()
    assert sorted(map(tuple, jobs.stored_board(spark, f"{tmp_path}/state").collect())) == before


@pytest.mark.parametrize("seed", [1, 2])
def test_first_snapshot_of_each_quarter_in_any_order(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(150):
        month = rnd.randint(1, 12)
        rows.append((f"F{rnd.randint(0, 4)}", f"2024-Q{(month + 2) // 3}", dt.datetime(2024, month, rnd.randint(1, 28)), float(i)))
    rnd.shuffle(rows)
    schema = "ticker string, quarter string, filed timestamp, value double"
    slices = [rows[100:], rows[50:100], rows[:50], rows[60:110]]
    deliver(spark, slices, schema, tmp_path, lambda s: jobs.start_snapshots(s, f"{tmp_path}/docs", f"{tmp_path}/ck"))
    got = {(r.ticker, r.quarter): r for r in jobs.snapshot_table(spark, f"{tmp_path}/docs").read().collect()}
    assert set(got) == {r[:2] for r in rows} and len({q for _, q in got}) == 4
    for key, r in got.items():
        first = min(x[2] for x in rows if x[:2] == key)
        assert r.filed == first and r.value in {x[3] for x in rows if x[:2] == key and x[2] == first}
