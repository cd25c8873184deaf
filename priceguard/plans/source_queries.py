"""Sources, sinks and the steps around the models, each written and read back over the whole table."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions.clean import true
from ..functions.features import FEATURES
from ..operators import evaluate, neighbors
from ..operators.forecast import Forecaster, hourly_prices, trimmed
from ..operators.rules import validate
from ..sources import experiments, trips
from ..sources.fixtures import pricing_events as load
from ..sources.fixtures import trip_records
from ..sources.generator import write_csv
from ..sources.scratch import dropped, new_folder, written
from ..sources.store import PricingStore
from .benchmark import union_all
from .core_queries import _FEATURE_SQL as FEATURE_SQL
from .core_queries import EVENT_COLUMNS
from .pipeline import read_events
from .registry import query
from .sql import PE, RULED, TRIPS, prf, with_

NOON = dt.datetime(2024, 6, 15, 12)


def _store(spark) -> PricingStore:
    return PricingStore(spark, new_folder(spark, "store"))


@query(with_(PE, f"SELECT {EVENT_COLUMNS} FROM pe"))
def csv_round_trip(spark, d):
    """Events written as CSV and read with the fixed schema."""
    path = new_folder(spark, "events") + ".csv"
    write_csv(load(spark, d), path)
    return read_events(spark, path)


@query(with_(TRIPS, "SELECT event_id, category, region, round(base_price, 6) AS base_price, round(demand_level, 6) AS demand_level, anomaly_type FROM tl"))
def trip_file_round_trip(spark, d):
    """Trips written as Parquet, read back whole and adapted."""
    path = new_folder(spark, "trips")
    trip_records(spark, d).write.parquet(path)
    rows = trips.label_natural(trips.transform(trips.read_trips(spark, path, None), None))
    return rows.select("event_id", "category", "region", F.round("base_price", 6).alias("base_price"), F.round("demand_level", 6).alias("demand_level"), F.col("label_type").alias("anomaly_type"))


@query(with_(PE, f"SELECT {EVENT_COLUMNS} FROM pe"))
def store_events(spark, d):
    """The store's events after a second full load replaced the first."""
    store = _store(spark)
    store.load_pricing_data(load(spark, d).filter("label_is_anomaly"))
    store.load_pricing_data(load(spark, d))
    return store.table("pricing_events")


@query(with_(PE, "SELECT event_id, category, anomaly_type FROM (SELECT event_id, category, label_type AS anomaly_type, \"timestamp\" AS t FROM pe) x WHERE t >= TIMESTAMP '2024-01-05 06:00:00' AND t <= TIMESTAMP '2024-01-09 18:30:00'"))
def store_events_between(spark, d):
    """A time range of the stored events, which reads the days it touches."""
    store = _store(spark)
    store.load_pricing_data(load(spark, d))
    rows = store.get_pricing_events("2024-01-05 06:00:00", "2024-01-09 18:30:00", limit=None)
    return rows.select("event_id", "category", F.col("label_type").alias("anomaly_type"))


@query(with_(PE, "SELECT \"timestamp\", category, label_type AS anomaly_type, base_price AS expected_price, final_price AS actual_price FROM pe WHERE label_is_anomaly"))
def store_ground_truth(spark, d):
    """The labelled events as the store's truth table."""
    store = _store(spark)
    truth = load(spark, d).filter("label_is_anomaly").select("timestamp", "category", F.col("label_type").alias("anomaly_type"), F.col("base_price").alias("expected_price"), F.col("final_price").alias("actual_price"))
    store.load_ground_truth(truth)
    return store.table("anomaly_ground_truth").select(*truth.columns)


@query(with_(f"{PE},\n{RULED}", "SELECT event_id, category, rule_violations AS anomaly_type, rule_severity AS severity, final_price FROM ruled WHERE rule_severity IN ('critical', 'high')"))
def store_alerts(spark, d):
    """Alerts saved and cleared, then saved in two appends."""
    store = _store(spark)
    found = validate(load(spark, d)).filter("rule_anomaly").select("event_id", "timestamp", "category", F.col("rule_violations").alias("anomaly_type"), F.col("rule_severity").alias("severity"), "final_price")
    found = written(found, "found")  # saved three times, worked out once
    store.save_detected_anomalies(found)
    store.clear_detected_anomalies()
    for severity in ("critical", "high"):
        store.save_detected_anomalies(found.filter(F.col("severity") == severity))
    dropped(found)
    return store.table("detected_anomalies").select("event_id", "category", "anomaly_type", "severity", "final_price")


@query(with_(f"{PE},\n{RULED}", "SELECT 1 AS run_id, 'completed' AS status, count(*) AS events_processed, count_if(rule_anomaly) AS anomalies_detected, 'business_rules' AS methods_used, NULL AS error_message FROM ruled UNION ALL SELECT 2, 'failed', 0, 0, 'business_rules,contextual', 'stopped' UNION ALL SELECT 3, 'running', NULL, NULL, 'contextual', NULL"))
def store_runs(spark, d):
    """Three runs: one completed, one failed, one still running."""
    store = _store(spark)
    n, found = validate(load(spark, d)).agg(F.count(F.lit(1)), F.count_if("rule_anomaly")).first()
    store.complete_detection_run(store.start_detection_run(["business_rules"], NOON), n, found, now=NOON)
    store.complete_detection_run(store.start_detection_run(["business_rules", "contextual"], NOON), status="failed", error="stopped", now=NOON)
    store.start_detection_run(["contextual"], NOON)
    return store.detection_runs().select(F.col("run_id").cast("int").alias("run_id"), "status", "events_processed", "anomalies_detected", "methods_used", "error_message")


_RULE_PRF = "SELECT count_if({c} AND label_is_anomaly) AS tp, count_if({c} AND NOT label_is_anomaly) AS fp, count_if(NOT {c} AND label_is_anomaly) AS fn FROM ruled"
_METHODS = ("rule_anomaly", "negative_price", "surge_cap_exceeded")


def _metrics(spark, d):
    rows = validate(load(spark, d))
    return evaluate.prf_by_method(rows, {m: true(F.col(m)) for m in _METHODS})


@query(with_(f"{PE},\n{RULED}", " UNION ALL ".join(f"SELECT '{m}' AS method, 'completed' AS status, precision AS precision_score, recall AS recall_score, f1 AS f1_score FROM (SELECT {prf()} FROM ({_RULE_PRF.format(c=m)}) c) p" for m in _METHODS)))
def store_metrics(spark, d):
    """Metrics of a run saved a row at a time, with the run's state."""
    store = _store(spark)
    run = store.start_detection_run(["business_rules"], NOON)
    for r in _metrics(spark, d).collect():  # a row per method
        store.save_model_performance(run, r["method"], r["precision"], r["recall"], r["f1"], NOON)
    store.complete_detection_run(run, now=NOON)
    return store.get_performance_history().select("method", "status", "precision_score", "recall_score", "f1_score")


@query(with_(f"{PE},\n{RULED}", " UNION ALL ".join(f"SELECT {i + 1} AS experiment_id, '{m}' AS method, {i}::DOUBLE AS params_place, f1 AS metrics_f1 FROM (SELECT {prf()} FROM ({_RULE_PRF.format(c=m)}) c) p" for i, m in enumerate(sorted(_METHODS)))))
def experiment_log(spark, d):
    """Evaluations appended to a log of JSON lines and read back flat."""
    tracker = experiments.ExperimentTracker(spark, new_folder(spark, "experiments"))
    for i, r in enumerate(_metrics(spark, d).orderBy("method").collect()):  # a row per method
        tracker.log_experiment(r["method"], {"place": i}, {"f1": r["f1"]}, now=NOON)
    flat = tracker.load_history()
    number = lambda c: F.col(c).cast("double").alias(c.replace("param_", "params_").replace("metric_", "metrics_"))
    return flat.select(F.col("experiment_id").cast("int").alias("experiment_id"), "method", *[number(c) for c in flat.columns if c.endswith(("_place", "_f1"))])


_HP = "hp AS (SELECT category, date_trunc('hour', \"timestamp\") AS hour, avg(final_price) AS mean, stddev_samp(final_price) AS std, count(*) AS n FROM pe GROUP BY ALL)"
_TR = """he AS (SELECT category, avg(mean) AS m, stddev_samp(mean) AS s, count(*) AS hours FROM hp GROUP BY 1),
ht AS (SELECT hp.* FROM hp JOIN he USING (category) WHERE hours >= 48 AND mean > m - 3 * s AND mean < m + 3 * s)"""
_SHOWN = "category, strftime(hour, '%Y-%m-%d %H:00:00') AS hour, round(mean, 6) AS mean, round(std, 6) AS std, n"


def _shown(rows):
    return rows.select("category", F.date_format("hour", "yyyy-MM-dd HH:00:00").alias("hour"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(with_(f"{PE},\n{_HP}", f"SELECT {_SHOWN} FROM hp"))
def hourly_price_series(spark, d):
    return _shown(hourly_prices(load(spark, d)))


@query(with_(f"{PE},\n{_HP},\n{_TR}", f"SELECT {_SHOWN} FROM ht"))
def hourly_price_series_trimmed(spark, d):
    """Hours within three standard deviations, as the forecaster is fitted on them."""
    return _shown(trimmed(hourly_prices(load(spark, d))))


@query(with_(f"{PE},\n{_HP},\n{_TR}", "SELECT category, strftime(last + to_hours(i::INT), '%Y-%m-%d %H:00:00') AS hour FROM (SELECT category, max(hour) AS last, unnest(range(1, 49)) AS i FROM ht WHERE category = 'ride_premium' GROUP BY 1) x"))
def forecast_hours(spark, d):
    """The hours of a forecast of two days."""
    rows = Forecaster().fit(load(spark, d)).forecast("ride_premium", 48)
    return rows.select("category", F.date_format("hour", "yyyy-MM-dd HH:00:00").alias("hour"))


@query(with_(f"{PE},\n{_HP},\n{_TR}", "SELECT event_id, category IN (SELECT category FROM ht) AS has_band, true AS consistent FROM pe"))
def forecast_join(spark, d):
    """Which events meet a band, and whether flag, score and band agree."""
    rows = Forecaster().fit(load(spark, d)).predict(load(spark, d))
    p, low, high, score = (F.col(c) for c in ("final_price", "ts_lower", "ts_upper", "ts_score"))
    out = true((p < low) | (p > high))
    agree = (F.col("ts_anomaly") == out) & score.between(0, 1) & (out | (score == 0)) & (low.isNull() | (low <= high))
    return rows.select("event_id", low.isNotNull().alias("has_band"), agree.alias("consistent"))


@query(with_(f"{PE},\n{RULED}", " UNION ALL ".join(f"SELECT '{m}' AS method, {prf()}, {note} AS note FROM ({_RULE_PRF.format(c=m)}) c" for m, note in (("rule_anomaly", "NULL"), ("negative_price", "'one rule'"), ("surge_cap_exceeded", "'one rule'")))))
def union_evaluations(spark, d):
    """Evaluations of two runs as one table; a column that one lacks is null there."""
    rows = validate(load(spark, d))
    first = evaluate.prf_by_method(rows, {"rule_anomaly": true(F.col("rule_anomaly"))})
    second = evaluate.prf_by_method(rows, {m: true(F.col(m)) for m in _METHODS[1:]}).withColumn("note", F.lit("one rule"))
    return union_all([first, second]).select("method", "precision", "recall", "f1", "note")


@query(with_(PE, "SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS ids, least(count(*), 1000) AS unchanged, least(count(*), 1000) AS again FROM pe"))
def seeded_sample(spark, d):
    """A sample of 1000 rows: its size, distinct ids, rows equal to the table's, rows equal to a second draw's."""
    rows = load(spark, d)
    one, two = (trips.sample_rows(rows, 1000, 42) for _ in range(2))
    count = F.count(F.lit(1))
    own = one.agg(count.alias("n"), F.countDistinct("event_id").alias("ids"))
    found, again = one.intersect(rows).agg(count.alias("unchanged")), one.intersect(two).agg(count.alias("again"))
    return own.join(F.broadcast(found)).join(F.broadcast(again))  # one row each


@query(with_(TRIPS, "SELECT count(*) AS events, count(*) AS ids, CAST(floor(count_if(anomaly_type IS NULL) * 0.03::DOUBLE) AS BIGINT) AS injected, count(anomaly_type) + CAST(floor(count_if(anomaly_type IS NULL) * 0.03::DOUBLE) AS BIGINT) AS labelled, 0 AS wrong FROM tl"))
def trip_injection_counts(spark, d):
    """How many rows are injected and labelled, and how many of the injected break their kind's definition."""
    events, truth = trips.inject(trips.label_natural(trips.transform(trip_records(spark, d), None)))
    kind, price, old, surge = (F.col(c) for c in ("anomaly_type", "actual_price", "expected_price", "surge_multiplier"))
    right = (
        F.when(kind == "flash_crash", (price == 0.01) & (surge == 0.001)).when(kind == "runaway_surge", (price / old).between(9.999, 25.001) & (F.abs(price / old - surge) < 1e-6))
        .when(kind == "negative_price", (price < 0) & (surge == -0.5)).when(kind == "surge_stuck_high", (F.abs(price - F.col("base_price") * 4.5) < 1e-6) & (surge == 4.5))
        .when(kind == "gradual_drift", (price / old).between(1.499, 2.501)).otherwise(False)
    )
    all_ = events.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"), F.count("label_type").alias("labelled"))
    both = truth.select("event_id", "anomaly_type", "actual_price", "expected_price").join(events.select("event_id", "surge_multiplier", "base_price"), "event_id")
    some = both.agg(F.count(F.lit(1)).alias("injected"), F.count_if(~right).cast("int").alias("wrong"))
    return all_.join(F.broadcast(some)).select("events", "ids", "injected", "labelled", "wrong")  # one row each


_Z = ", ".join(f"(x{i} - avg(x{i}) OVER ()) / coalesce(nullif(stddev_pop(x{i}) OVER (), 0), 1) AS z{i}" for i in range(len(FEATURES)))
_DISTANCE = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(len(FEATURES)))
_POINTS = f"""fx AS (SELECT event_id, {", ".join(f"({FEATURE_SQL[n]})::DOUBLE AS x{i}" for i, n in enumerate(FEATURES))} FROM pe),
zs AS (SELECT event_id, {_Z} FROM fx),
ds AS (SELECT a.event_id, sqrt({_DISTANCE}) AS d FROM zs a JOIN zs b ON a.event_id <> b.event_id)"""


@query(with_(f"{PE},\n{_POINTS}", "SELECT event_id, round(list_max(min(d, 20)), 9) AS k_distance, count_if(d <= 1.5) AS within FROM ds GROUP BY event_id"))
def neighbour_distances(spark, d):
    """Distance of the twentieth nearest point and how many others lie within 1.5 (standardised features)."""
    points, features = neighbors.standardised(load(spark, d))
    out = neighbors.distances_and_counts(points, 20, 1.5).withColumnRenamed("n", "within")
    dropped(features)
    return out


_NEAR = _POINTS.rsplit("ds AS", 1)[0] + f"""ds AS (SELECT a.event_id, b.event_id AS other, round(sqrt({_DISTANCE}), 9) AS d FROM zs a JOIN zs b ON a.event_id <> b.event_id)"""
_LOF = f"""{PE},\n{_NEAR},
nb AS MATERIALIZED (SELECT event_id, x.o AS other, x.d AS d FROM (SELECT event_id, unnest(min({{'d': d, 'o': other}}, 20)) AS x FROM ds GROUP BY event_id) t),
kd AS (SELECT event_id, max(d) AS k FROM nb GROUP BY 1),
ld AS MATERIALIZED (SELECT nb.event_id, 1 / (avg(greatest(nb.d, k)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.event_id = nb.other GROUP BY 1),
fa AS (SELECT nb.event_id, -avg(o.lrd) / any_value(l.lrd) AS f FROM nb JOIN ld o ON o.event_id = nb.other JOIN ld l ON l.event_id = nb.event_id GROUP BY 1)"""


@query(with_(_LOF, "SELECT event_id, f < (SELECT quantile_cont(f, 0.1) FROM fa) AS lof_anomaly, round(1 - (f - (SELECT min(f) FROM fa)) / ((SELECT max(f) - min(f) FROM fa) + 1e-10), 6) AS lof_score FROM fa"))
def lof(spark, d):
    return neighbors.local_outlier_factor(load(spark, d)).select("event_id", "lof_anomaly", F.round("lof_score", 6).alias("lof_score"))


_EPS = 1.5
_DBSCAN = f"""{PE},\n{_NEAR},
cl AS MATERIALIZED (SELECT event_id, other FROM ds WHERE d <= {_EPS}),
co AS MATERIALIZED (SELECT event_id FROM cl GROUP BY 1 HAVING count(*) + 1 >= 10),
e AS MATERIALIZED (SELECT cl.event_id AS a, cl.other AS b FROM cl SEMI JOIN co ON co.event_id = cl.event_id SEMI JOIN co c2 ON c2.event_id = cl.other),
r(n, root) USING KEY (n) AS (SELECT event_id, event_id FROM co UNION SELECT e.a, min(r.root) FROM e JOIN r ON r.n = e.b JOIN recurring.r o ON o.n = e.a WHERE r.root < o.root GROUP BY e.a),
nc AS (SELECT ds.event_id, min({{'d': ds.d, 'o': ds.other}}) AS x FROM ds SEMI JOIN co ON co.event_id = ds.other ANTI JOIN co c2 ON c2.event_id = ds.event_id GROUP BY 1),
lb AS (SELECT n AS event_id, root FROM r UNION ALL SELECT nc.event_id, r.root FROM nc JOIN r ON r.n = nc.x.o WHERE nc.x.d <= {_EPS}),
nm AS MATERIALIZED (SELECT event_id, dense_rank() OVER (ORDER BY root) - 1 AS c FROM lb),
gp AS (SELECT ds.event_id, min(ds.d) AS gap FROM ds ANTI JOIN nm ON nm.event_id = ds.event_id SEMI JOIN nm n2 ON n2.event_id = ds.other GROUP BY 1)"""


@query(with_(_DBSCAN, "SELECT pe.event_id, c IS NULL AS dbscan_anomaly, round(coalesce(gap / (SELECT coalesce(nullif(max(gap), 0), 1) FROM gp), 0), 6) AS dbscan_score, coalesce(c, -1)::INT AS dbscan_cluster FROM pe LEFT JOIN nm USING (event_id) LEFT JOIN gp USING (event_id)").replace("WITH ", "WITH RECURSIVE ", 1))
def dbscan_fixed_radius(spark, d):
    """Clusters for a stated radius (``dbscan`` tunes its own)."""
    found = neighbors.density_clusters(load(spark, d), eps=_EPS)
    return found.select("event_id", "dbscan_anomaly", F.round("dbscan_score", 6).alias("dbscan_score"), "dbscan_cluster")
