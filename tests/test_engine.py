"""Alerts, evaluation, sources, store, tracker, pipeline, stream, and all queries against DuckDB."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from priceguard.config import BASE_PRICES, DEFAULT, TUNED
from priceguard.operators import alerts, eda, evaluate
from priceguard.plans.pipeline import AnomalyPipeline
from priceguard.plans.registry import ORACLE, QUERIES
from priceguard.sources import experiments, trips
from priceguard.sources.fixtures import pricing_events
from priceguard.sources.generator import generate
from priceguard.sources.settings import from_mapping, load_settings
from priceguard.sources.store import PricingStore

from .helpers import events

SF = "/root/testdata/sf0.001"
SLOW = {"lof", "dbscan", "detector_comparison", "full_ensemble", "tuned_evaluation", "trip_comparison"}


def scored(spark, *rows):
    """Events with detector columns given per row."""
    base = dict(is_anomaly=True, anomaly_score=0.95, n_methods_flagged=3, rule_anomaly=True, rule_score=1.0, rule_violations="negative_price,zero_surge")
    e = events(spark, *[{k: v for k, v in r.items() if k not in base} for r in rows])
    extra = spark.createDataFrame([(i, *[{**base, **r}[k] for k in base]) for i, r in enumerate(rows)], "event_id long, is_anomaly boolean, anomaly_score double, n_methods_flagged int, rule_anomaly boolean, rule_score double, rule_violations string")
    return e.join(extra, "event_id")


def test_alert_texts(spark):
    quiet = dict(rule_anomaly=False, rule_score=0.0, rule_violations="none", n_methods_flagged=1, anomaly_score=0.4)
    rows = [dict(final_price=-5.0), dict(final_price=0.5, **quiet), dict(surge_multiplier=12.0, final_price=90.0, **quiet), dict(surge_multiplier=6.0, **quiet), quiet]
    got = {r["event_id"]: r for r in alerts.classify(scored(spark, *rows)).collect()}
    assert got[0]["description"] == "NEGATIVE PRICE ($-5.00) for ride_standard in downtown | Rule violations: negative_price,zero_surge | [HIGH CONFIDENCE: 3/3 methods agree]"
    assert got[1]["description"] == "Near-zero price ($0.50) for ride_standard"
    assert got[2]["description"] == "Extreme surge (12.0x) pushing ride_standard to $90.00"
    assert got[3]["description"] == "High surge (6.0x) on ride_standard, price=$20.00"
    assert got[4]["description"] == "Anomalous pricing for ride_standard: $20.00 (surge=1.50x) in downtown"
    assert got[0]["severity"] == "high" and got[4]["severity"] == "low"
    assert got[0]["detection_summary"] == "ML ensemble (score=0.95) + Business rules (negative_price,zero_surge)" and got[4]["detection_summary"] == "Ensemble threshold"
    assert got[0]["estimated_impact_usd"] == 23.0 and got[2]["estimated_impact_usd"] == 144.0
    assert got[0]["recommended_action"].startswith("URGENT")


def test_unified_score_tops_out_without_forecast(spark):
    full = scored(spark, dict(anomaly_score=1.0))
    assert abs(alerts.classify(full).first()["unified_score"] - 0.75) < 1e-9
    assert alerts.classify(full, renormalise=True).first()["severity"] == "critical"


def test_mask_uses_the_prediction(spark):
    silent = dict(is_anomaly=False, rule_anomaly=False, rule_violations="none", rule_score=0.0)
    df = scored(spark, dict(label_is_anomaly=True, **silent), dict(is_anomaly=True, rule_anomaly=False, rule_violations="none", rule_score=0.0))
    assert [r["event_id"] for r in alerts.classify(df).collect()] == [1]
    assert [r["event_id"] for r in alerts.classify(df, compat_label_mask=True).collect()] == [0]
    assert alerts.classify(df.limit(0)).count() == 0


def test_prf_and_sweep(spark):
    rows = [(0.9, 2, True), (0.6, 1, True), (0.6, 0, False), (0.1, 2, False), (0.1, 0, True)]
    df = spark.createDataFrame(rows, "anomaly_score double, n_methods_flagged int, label_is_anomaly boolean")
    sweep = {(r["mode"], r["threshold"]): r for r in evaluate.threshold_sweep(df).collect()}
    assert len(sweep) == 93
    assert (sweep["score_only", 0.49]["precision"], sweep["score_only", 0.49]["recall"]) == (0.6667, 0.6667)
    assert sweep["score_or_2methods", 0.49]["precision"] == 0.5 and sweep["min_2_methods", 0.0]["recall"] == 0.3333
    assert sweep["score_only", 0.93]["f1"] == 0.0
    none = evaluate.prf_by_method(df.withColumn("is_anomaly", F.lit(False)).withColumn("rule_anomaly", F.lit(False)))
    assert all(r["f1"] == 0 and r["fn"] == 3 for r in none.collect())


def test_runs(spark):
    flags = [0, 1, 0, 1, 1, 0, 1, 1, 1, 1, 1]
    kinds = {1: "a", 3: "b", 4: "c", 6: "d", 7: "d", 9: None, 10: None}
    e = events(spark, *[dict(label_is_anomaly=bool(f), label_type=kinds.get(i)) for i, f in enumerate(flags)])
    got = sorted((r["start_id"], r["length"], r["run_type"]) for r in eda.anomaly_runs(e).collect())
    assert got == [(1, 1, "a"), (3, 2, "c"), (6, 5, "d")]
    s = eda.run_summary(eda.anomaly_runs(e)).first()
    assert (s["longest"], s["single"], s["two_or_more"], s["five_or_more"]) == (5, 1, 2, 1)


def test_normal_quantile(spark):
    from statistics import NormalDist

    for p in (0.001, 0.1, 0.5, 0.8, 0.999):
        got = spark.range(1).select(eda.normal_quantile(F.lit(p))).first()[0]
        assert abs(got - NormalDist().inv_cdf(p)) < 5e-4


@pytest.fixture(scope="module")
def generated(spark):
    a, t = generate(spark, dt.datetime(2024, 6, 15, 12), dt.datetime(2024, 6, 8, 12))
    return a.cache(), t.cache()


def test_generator(spark, generated):
    e, truth = generated
    n = e.count()
    assert 7 * 24 * 45 < n < 7 * 24 * 55
    assert {r[0] for r in e.select("category").distinct().collect()} == set(BASE_PRICES)
    ids = e.agg(F.min("event_id"), F.max("event_id"), F.count_distinct("event_id")).first()
    assert tuple(ids) == (0, n - 1, n)
    assert e.filter("timestamp < '2024-06-08 12:00:00' or timestamp >= '2024-06-15 12:00:00'").count() == 0
    share = e.filter("label_is_anomaly").count() / n
    assert 0.06 < share < 0.18 and truth.count() == e.filter("label_is_anomaly").count()
    assert eda.anomaly_runs(e).agg(F.max("length")).first()[0] >= 3
    ok = e.filter("not label_is_anomaly")
    assert ok.filter("final_price <= 0 or surge_multiplier < 1 or demand_level < 0.05 or demand_level > 1 or distance_miles < 0.5 or duration_minutes < 3").count() == 0
    again, _ = generate(spark, dt.datetime(2024, 6, 15, 12), dt.datetime(2024, 6, 8, 12))
    assert again.exceptAll(e).count() == 0
    other, _ = generate(spark, dt.datetime(2024, 6, 15, 12), dt.datetime(2024, 6, 8, 12), seed=99)
    assert other.exceptAll(e).count() > 0.5 * n


def test_trips(spark, tmp_path):
    t0 = dt.datetime(2024, 5, 1, 8)
    raw = [(1, t0, t0 + dt.timedelta(minutes=10), 2.0, 15.0, 132), (2, t0, t0 + dt.timedelta(minutes=10), 2.01, 15.0, 10), (3, t0, t0, 5.0, 15.0, 200), (4, t0, t0 + dt.timedelta(minutes=60), 60.0, 250.0, 20), (5, t0, t0 + dt.timedelta(minutes=5), 0.4, 60.0, 13), (6, None, t0, 1.0, 9.0, 4)]
    df = spark.createDataFrame(raw, "event_id long, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, trip_distance double, total_amount double, PULocationID int")
    got = {r["event_id"]: r for r in trips.label_natural(trips.transform(df, None)).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert [got[i]["category"] for i in (1, 2, 4)] == ["ride_short", "ride_standard", "ride_premium"]
    assert [got[i]["region"] for i in (1, 2, 4, 5)] == ["airport", "downtown", "suburbs", "suburbs"]
    assert got[4]["label_type"] == "extreme_distance" and got[5]["label_type"] == "extreme_surge" and got[1]["label_type"] is None
    df.drop("event_id").write.parquet(f"{tmp_path}/trips.parquet")
    e, truth = trips.load_and_transform(spark, f"{tmp_path}/trips.parquet", anomaly_rate=0.5)
    assert e.count() == 4 and truth.count() == 1


def test_alerts_are_worked_out_once(spark, tmp_path):
    store, seen = PricingStore(spark, f"file://{tmp_path}/db"), spark.sparkContext.accumulator(0)

    def look(i):
        seen.add(1)
        return i % 2 == 0

    e = events(spark, *[{}] * 20)
    assert store.save_detected_anomalies(e.filter(F.udf(look, "boolean")("event_id"))) == 10 and seen.value == 20
    assert store.table("detected_anomalies").count() == 10


def test_store_and_runs(spark, tmp_path):
    store = PricingStore(spark, f"file://{tmp_path}/db")
    e = events(spark, {}, {}, dict(label_is_anomaly=True, label_type="flash_crash", final_price=0.01))
    assert store.load_pricing_data(e) == 3 and store.load_pricing_data(e) == 3
    assert store.get_pricing_events(category="ride_standard", limit=2).count() == 2
    first, last = store.table("pricing_events").agg(F.min("timestamp"), F.max("timestamp")).first()
    some = store.get_pricing_events(start=str(last.date()), end=str(last))
    assert some.count() == store.table("pricing_events").filter(F.col("timestamp") >= F.lit(str(last.date())).cast("timestamp_ntz")).count() > 0
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().toString()
    kept = store.dashboard_table("pricing_events")
    assert store.dashboard_table("pricing_events") is kept and store.dashboard_table("pricing_events", 0.0) is not kept
    assert store.save_detected_anomalies(e.limit(0)) == 0
    a, b = store.start_detection_run(["x", "y"]), store.start_detection_run(["z"])
    store.complete_detection_run(a, 3, 1)
    store.complete_detection_run(b, status="failed", error="no")
    runs = {r["run_id"]: r for r in store.detection_runs().collect()}
    assert (a, b) == (1, 2) and runs[1]["status"] == "completed" and runs[1]["methods_used"] == "x,y" and runs[2]["error_message"] == "no"
    store.save_model_performance(a, "ensemble", 1, 0.5, 0.6667)
    assert store.get_performance_history().first()["f1_score"] == 0.6667


def test_tracker(spark, tmp_path):
    t = experiments.ExperimentTracker(spark, f"file://{tmp_path}/log")
    assert t.load_history().count() == 0 and t.get_best_by_metric() is None
    for k, f1 in enumerate((0.3, 0.9, 0.6)):
        assert t.log_experiment("m" if k < 2 else "m_optimized", {"z": 1} if k < 2 else {}, {"f1": f1}) == k + 1
    (tmp_path / "log" / "bad.txt").write_text("\n{oops\n" + json.dumps({"experiment_id": 9, "method": "n", "timestamp": "2024-01-01T00:00:00", "metrics": {"other": 1.0}}) + "\n")
    assert t.load_history().count() == 4 and "param_z" in t.load_history().columns
    assert t.get_best_by_metric()["experiment_id"] == 2 and t.get_best_by_metric("f1", "m_optimized")["experiment_id"] == 3
    assert {r["experiment_id"] for r in t.compare_experiments().collect()} == {2, 3, 9}
    assert t.clean() == (4, 3) and {r["experiment_id"] for r in t.records().collect()} == {2, 3, 9}
    t.clear()
    assert t.records().count() == 0


def test_settings(tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("anomaly_detection: {zscore_threshold: 2.8, isolation_forest: {contamination: 0.05}}\nbusiness_rules: {price_caps: {ride_pool: 90}}\n")
    s = load_settings(str(f))
    assert (s.zscore_threshold, s.contamination, s.rules.price_caps, s.trees) == (2.8, 0.05, {"ride_pool": 90.0}, 200)
    assert load_settings(str(tmp_path / "none.yaml")) == DEFAULT and from_mapping({}, TUNED) == TUNED


def test_pipeline(spark, generated, tmp_path):
    p = AnomalyPipeline(spark, f"file://{tmp_path}/p")
    out = p.run(generated[0].filter("event_id < 3000"), use_forest=False)
    assert out["total_events"] == 3000 and set(out["evaluation"]) == {"ensemble", "business_rules", "combined"}
    assert out["total_anomalies_detected"] == p.store.table("detected_anomalies").count() == sum(out["severity_distribution"].values())
    assert p.tracker.records().count() == 3
    with pytest.raises(ValueError):
        p.run()
    assert {r["status"] for r in p.store.detection_runs().collect()} == {"completed", "failed"}


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SLOW:
        pytest.skip("covered by the detector tests")
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    rows = [tuple(_value(r[c]) for c in order) for r in df.collect()]
    if name not in ORACLE:
        assert rows
        return
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == order
    want = [tuple(_value(r[columns.index(c)]) for c in order) for r in found.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_whole_experiment_log(spark):
    from priceguard.plans.registry import QUERIES

    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert n > 40
    for name in ("whole_experiment_history", "whole_performance_history", "whole_runtime_ranking"):
        assert QUERIES[name](spark, SF).count() == n


@pytest.mark.parametrize("name", ["detector_comparison", "trip_comparison"])
def test_comparisons_evaluate_every_detector(spark, name):
    from priceguard.plans.registry import QUERIES

    methods = {r["method"] for r in QUERIES[name](spark, SF).collect()}
    assert methods == {"ensemble", "business_rules", "combined", "lof", "dbscan", "one_class_svm"}


def test_grid_with_forest_against_brute_force(spark):
    from priceguard.config import TUNED
    from priceguard.operators.evaluate import GRID
    from priceguard.plans import tuning
    from priceguard.plans.registry import QUERIES
    from priceguard.sources.fixtures import pricing_events

    rows = [r.asDict() for r in tuning.grid_input(pricing_events(spark, SF), use_forest=True).filter("split = 'test'").collect()]
    want = {}
    for c in GRID["contamination"]:
        for z in GRID["zscore_threshold"]:
            for t in GRID["ensemble_threshold"]:
                tp = fp = fn = 0
                for r in rows:
                    roll = (r["roll_dev"] or 0.0) > z
                    stat = min(max(r["parts"] + 0.10 * roll, 0), 1)
                    score = TUNED.stat_weight * stat + TUNED.context_weight * r["ctx_score"] + TUNED.forest_weight * r["if_score"]
                    over = (r["z_dev"] or 0) > z or (r["mad_dev"] or 0) > z or (r["iqr_dev"] or 0) > 0 or roll
                    flag = round(min(max(score, 0), 1), 9) > t or bool(over) + bool(r["ctx_anomaly"]) + bool(r[f"if_{c}"]) >= 2
                    y = bool(r["label_is_anomaly"])
                    tp, fp, fn = tp + (flag and y), fp + (flag and not y), fn + (y and not flag)
                want[c, z, t] = round(2 * tp / (2 * tp + fp + fn), 4) if tp else 0.0
    got = {(r["contamination"], r["zscore_threshold"], r["ensemble_threshold"]): r["f1"] for r in QUERIES["grid_search_forest"](spark, SF).collect()}
    assert len(want) == 96 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1.1e-4 for k in want)


def test_synthetic_queries_take_the_whole_history(spark):
    from priceguard.plans.registry import QUERIES

    first, last = QUERIES["synthetic_events"](spark, SF).selectExpr("min(timestamp)", "max(timestamp)").first()
    assert first.date() == dt.date(2024, 3, 17) and last.date() == dt.date(2024, 6, 15)


def test_split_by_time_on_sampled_and_repeated_ids(spark):
    from priceguard.sources.trips import sample_rows

    events = pricing_events(spark, SF)
    for rows in (sample_rows(events, 500, 42), events.withColumn("event_id", F.col("event_id") % 7), events.limit(0), events.limit(1)):
        got = [(r["timestamp"], r["event_id"], r["split"]) for r in evaluate.train_test(rows).collect()]
        got.sort(key=lambda r: r[:2])
        cut = len(got) * 8 // 10
        first = got[cut][:2] if cut < len(got) else None
        assert [r[2] for r in got] == ["train" if first is None or r[:2] < first else "test" for r in got]
    assert abs(sum(r[2] == "train" for r in got) - cut) <= 1


def test_contamination_pivot(spark):
    grid = [(c, z, t, round(c * z * t, 4)) for c in evaluate.GRID["contamination"] for z in evaluate.GRID["zscore_threshold"] for t in evaluate.GRID["ensemble_threshold"]]
    rows = evaluate.contamination_pivot(spark.createDataFrame(grid, "contamination double, zscore_threshold double, ensemble_threshold double, f1 double")).collect()
    assert len(rows) == 24 and all(r["z_2_8"] == round(r["contamination"] * 2.8 * r["ensemble_threshold"], 4) for r in rows)


def test_synthetic_kinds_are_the_published_labels(spark):
    from priceguard.sources.generator import KINDS

    assert {"price_inversion", "regional_bleedthrough"} < set(KINDS) and len(KINDS) == 11
