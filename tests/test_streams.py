"""Streams: the rolling test over micro-batches, rollups with late rows, watermarked counts; and folds in time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from priceguard.operators import evaluate, reports, stats
from priceguard.operators.rules import validate
from priceguard.streaming import alerts, rolling, rollups

from .helpers import events, hourly

OUTLIERS = {k: dict(final_price=60.0) for k in (37, 60, 120, 121, 180)}


def files(spark, folder, parts):
    """One file a part, in the order in which a stream reads them."""
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(folder)


def test_rolling_over_micro_batches_equals_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stats, "UNIT", 128)
    changes = hourly(240, categories=("x", "x", "y"), outliers=OUTLIERS)
    changes += [dict(category="few", timestamp=dt.datetime(2024, 6, 4, k), final_price=5.0 + 90 * (k == 8)) for k in range(9)]
    e = events(spark, *changes)
    want = {r["event_id"]: r["stat_rolling"] for r in stats.rolling_flags(e).collect()}
    cuts = [dt.datetime(2024, 6, 1) + dt.timedelta(hours=h) for h in (0, 7, 90, 91, 400)]
    folder = f"file://{tmp_path}/in"
    # rows of a part come in any order; some of the next two hours come a part early
    parts = [e.filter((F.col("timestamp") >= a) & (F.col("timestamp") < b)).orderBy(F.xxhash64("event_id")) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    early = F.col("event_id") == 91
    parts = [parts[0], parts[1].union(parts[3].filter(early)), parts[2], parts[3].filter(~early)]
    files(spark, folder, parts)
    run = rolling.RollingStream(spark, f"file://{tmp_path}/rolling", delay="3 hours")
    run.start(alerts.read_stream(spark, folder, 1)).awaitTermination()
    before = run.flags().count()
    run.finish()
    got = run.flags().collect()
    assert before < len(got) == len(want)
    assert {r["event_id"]: r["stat_rolling"] for r in got} == want and any(want.values())


def test_late_rows_and_rows_without_a_time_get_no_flag(spark, tmp_path):
    changes = hourly(60)
    e = events(spark, *changes, dict(timestamp=None), dict(timestamp=dt.datetime(2024, 6, 1, 1, 30)))
    folder = f"file://{tmp_path}/in"
    files(spark, folder, [e.filter("event_id < 60"), e.filter("event_id >= 60")])
    run = rolling.RollingStream(spark, f"file://{tmp_path}/rolling")
    run.start(alerts.read_stream(spark, folder, 1)).awaitTermination()
    run.finish()
    got = {r["event_id"]: r["stat_rolling"] for r in run.flags().collect()}
    assert len(got) == 62 and got[60] is None and got[61] is None and all(got[i] is not None for i in range(60))


def test_replayed_micro_batch_writes_its_rows_once(spark, tmp_path):
    e = events(spark, *hourly(60)).select(*rolling.SLIM)
    run = rolling.RollingStream(spark, f"file://{tmp_path}/rolling", delay="1 hour")
    run.schema = e.schema
    run.step(e.filter("event_id < 30"), 0)
    for _ in range(2):
        run.step(e.filter("event_id >= 30"), 1)
    run.finish()
    assert sorted(r["event_id"] for r in run.flags().collect()) == list(range(60))


def test_rollups_equal_a_recount(spark, tmp_path):
    e = events(spark, *hourly(96, categories=("x", "y"), outliers={k: dict(label_is_anomaly=True) for k in (3, 50)}))
    kept = rollups.Rollups(spark, f"file://{tmp_path}/rollups")
    late = F.col("event_id").isin(5, 40)
    for k in range(3):
        kept.append(e.filter((F.col("event_id") % 3 == k) & ~late), k)
    kept.append(e.filter("event_id % 3 = 2").filter(~late), 2)  # a replay
    kept.compact()
    kept.append(e.filter(late), 3)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(rollups.hourly_stats(kept.read())) == rows(reports.hourly_stats(e))
    one = kept.read("2024-06-02", "2024-06-02")
    assert rows(rollups.hourly_stats(one)) == rows(reports.hourly_stats(e.filter("date(timestamp) = '2024-06-02'")))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters", 1)[1][:200]


def test_watermarked_counts_drop_what_is_late(spark, tmp_path):
    changes = [dict(timestamp=dt.datetime(2024, 6, 1, h, 30)) for h in (0, 1, 2, 5)] + [dict(timestamp=dt.datetime(2024, 6, 1, 0, 10)), dict(timestamp=dt.datetime(2024, 6, 1, 9))]
    e = events(spark, *changes)
    folder = f"file://{tmp_path}/in"
    files(spark, folder, [e.filter("event_id < 4"), e.filter("event_id = 5"), e.filter("event_id = 4")])
    counts = alerts.hourly_counts(validate(alerts.read_stream(spark, folder, 1)))
    run = counts.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["hour"].hour: r["events"] for r in spark.read.schema(counts.schema).parquet(f"file://{tmp_path}/out").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 5: 1}


@pytest.mark.parametrize("folds", [2, 4])
def test_folds_follow_each_other(spark, folds):
    e = events(spark, *hourly(101), dict(timestamp=None), dict(timestamp=dt.datetime(2024, 6, 1, 5)))
    rows = evaluate.time_folds(e, folds).select("event_id", "timestamp", "fold").collect()
    assert {r["fold"] for r in rows} == set(range(folds)) and next(r for r in rows if r["timestamp"] is None)["fold"] == 0
    timed = sorted((r["timestamp"], r["fold"]) for r in rows if r["timestamp"] is not None)
    assert [f for _, f in timed] == sorted(f for _, f in timed)
    sizes = [sum(r["fold"] == k for r in rows) for k in range(folds)]
    assert max(sizes) - min(sizes) <= 3


def test_settings_are_reported_on_rows_that_chose_nothing(spark):
    rows = [(0, 2.0, 0.2, 0.5, 0.5, 0.5), (1, 2.0, 0.2, 0.7, 0.7, 0.7), (2, 2.0, 0.2, 0.1, 0.2, 0.3), (0, 3.0, 0.2, 0.9, 0.9, 0.4), (1, 3.0, 0.2, 0.9, 0.9, 0.4), (2, 3.0, 0.2, 0.9, 0.9, 0.9)]
    grid = spark.createDataFrame(rows, "fold int, zscore_threshold double, ensemble_threshold double, precision double, recall double, f1 double")
    got = evaluate.tuned_and_reported(grid, 2).first()
    assert tuple(got) == (2.0, 0.2, 0.6, 0.1, 0.2, 0.3)
