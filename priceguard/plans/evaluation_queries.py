"""Ensemble, alerts, evaluation and experiment queries."""

from pyspark.sql import functions as F

from ..config import TUNED
from ..operators import alerts, evaluate
from ..operators.evaluate import GRID, sweep_points
from ..sources import experiments
from ..sources.fixtures import pricing_events as load
from ..sources.store import performance_history as history_of
from . import tuning
from .registry import ORACLE, QUERIES, query
from .report_queries import AL, found, scored
from .sql import CTX, DEV, PE, SCORED, TRAIN, context_cte, prf, rolling_sql, stats_cte, with_

ENSEMBLE = ["is_anomaly", "n_methods_flagged", "ensemble_severity", "detection_methods"]


@query(with_(SCORED, f"SELECT event_id, {', '.join(ENSEMBLE)}, round(anomaly_score, 6) AS anomaly_score FROM sc"))
def ensemble_two_method(spark, d):
    return scored(spark, d).select("event_id", *ENSEMBLE, F.round("anomaly_score", 6).alias("anomaly_score"))


@query(with_(AL, "SELECT event_id, round(anomaly_score, 6) AS unified_score, severity FROM al"))
def unified_score(spark, d):
    return alerts.classify(scored(spark, d)).select("event_id", F.round("unified_score", 6).alias("unified_score"), "severity")


_TEXT = ["event_id", "category", "detection_method", "anomaly_type", "severity", "final_price", "description"]
_ACTION = "CASE severity WHEN 'critical' THEN 'IMMEDIATE' WHEN 'high' THEN 'URGENT' WHEN 'medium' THEN 'REVIEW' ELSE 'MONITOR' END AS action"


@query(with_(AL, f"SELECT {', '.join(_TEXT)}, round(anomaly_score, 6) AS anomaly_score, estimated_impact_usd, NULL::DOUBLE AS expected_price_low, NULL::DOUBLE AS expected_price_high, {_ACTION} FROM al"))
def alert_records(spark, d):
    rows = found(spark, d)
    return rows.select(*_TEXT, F.round("anomaly_score", 6).alias("anomaly_score"), "estimated_impact_usd", "expected_price_low", "expected_price_high", F.substring_index("recommended_action", ":", 1).alias("action"))


@query(with_(SCORED, "SELECT event_id FROM sc WHERE label_is_anomaly OR rule_anomaly"))
def alert_mask_by_label(spark, d):
    return alerts.classify(scored(spark, d), compat_label_mask=True).select("event_id")


@query(with_(AL, "SELECT severity, count(*) AS n, round(sum(estimated_impact_usd), 2) AS impact, round(avg(estimated_impact_usd), 4) AS mean_impact FROM al GROUP BY 1"))
def impact_by_severity(spark, d):
    return found(spark, d).groupBy("severity").agg(F.count("*").alias("n"), F.round(F.sum("estimated_impact_usd"), 2).alias("impact"), F.round(F.avg("estimated_impact_usd"), 4).alias("mean_impact"))


_E, _R = "is_anomaly", "rule_anomaly"
_METHODS = {"ensemble": _E, "business_rules": _R, "combined": f"({_E} OR {_R})"}


def _counts(flag: str, source: str) -> str:
    return f"(SELECT count_if({flag} AND label_is_anomaly) AS tp, count_if({flag} AND NOT label_is_anomaly) AS fp, count_if(NOT {flag} AND label_is_anomaly) AS fn FROM {source})"


_PRF = " UNION ALL ".join(f"SELECT '{m}' AS method, tp, fp, fn, {prf()} FROM {_counts(f, 'te')} t" for m, f in _METHODS.items())
_TEST = f"{SCORED},\nte AS (SELECT * FROM sc WHERE split = 'test')"


@query(with_(_TEST, _PRF))
def prf_by_method(spark, d):
    return evaluate.prf_by_method(scored(spark, d).filter("split = 'test'"))


@query(with_(f"{_TEST},\np AS ({_PRF})", " UNION ALL ".join(f"SELECT method, '{m}' AS metric, {m} AS value FROM p" for m in ("precision", "recall", "f1"))))
def metrics_unpivot(spark, d):
    rows = evaluate.prf_by_method(scored(spark, d).filter("split = 'test'"))
    return rows.unpivot(["method"], ["precision", "recall", "f1"], "metric", "value")


_POINTS = ", ".join(f"('{m}', {t}, {k})" for m, t, k in sweep_points())
_SWEEP = f"""{_TEST},
pt(mode, threshold, k) AS (VALUES {_POINTS}),
fl AS (SELECT mode, threshold::DOUBLE AS threshold, label_is_anomaly AS y, CASE WHEN mode = 'score_only' THEN round(anomaly_score, 9) > threshold WHEN mode = 'score_or_2methods' THEN round(anomaly_score, 9) > threshold OR n_methods_flagged >= 2 ELSE n_methods_flagged >= k END AS f FROM te, pt),
cf AS (SELECT mode, threshold, count_if(f AND y) AS tp, count_if(f AND NOT y) AS fp, count_if(NOT f AND y) AS fn FROM fl GROUP BY ALL),
sw AS (SELECT mode, threshold, {prf()} FROM cf)"""


@query(with_(_SWEEP, "SELECT * FROM sw"))
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(scored(spark, d).filter("split = 'test'"))


@query(with_(_SWEEP, "SELECT round(abs(sum(dx * y)), 4) AS pr_auc FROM (SELECT recall - lag(recall) OVER w AS dx, (precision + lag(precision) OVER w) / 2 AS y FROM sw WHERE mode = 'score_only' WINDOW w AS (ORDER BY recall, precision, threshold)) t"))
def pr_auc(spark, d):
    return evaluate.pr_auc(evaluate.threshold_sweep(scored(spark, d).filter("split = 'test'")))


@query(with_(_SWEEP, "SELECT mode, threshold, precision, recall, f1 FROM sw ORDER BY f1 DESC, mode, threshold, precision, recall LIMIT 1"))
def best_threshold(spark, d):
    return evaluate.best_row(evaluate.threshold_sweep(scored(spark, d).filter("split = 'test'")))


_ZS, _TS = GRID["zscore_threshold"], GRID["ensemble_threshold"]
_GRID = f"""{PE},
{TRAIN},
{stats_cte("tr")},
{context_cte("tr")},
{DEV.format(src="pe")},
{CTX.format(src="dv")},
gr AS (SELECT *, 0.35 * z_dev / (SELECT coalesce(nullif(max(z_dev), 0), 1) FROM dv) + 0.35 * mad_dev / (SELECT coalesce(nullif(max(mad_dev), 0), 1) FROM dv) + 0.20 * iqr_dev / (SELECT coalesce(nullif(max(iqr_dev), 0), 1) FROM dv) AS parts,
  {", ".join(rolling_sql(z, "roll_" + str(int(z * 10))) for z in _ZS)} FROM cs),
gz AS ({" UNION ALL ".join(f"SELECT event_id, label_is_anomaly AS y, {z}::DOUBLE AS z, least(greatest({TUNED.stat_weight} * least(greatest(parts + 0.10 * roll_{int(z * 10)}::INT, 0), 1) + {TUNED.context_weight} * ctx_score, 0), 1) AS s, (z_dev > {z} OR mad_dev > {z} OR iqr_dev > 0 OR roll_{int(z * 10)})::INT + ctx_anomaly::INT AS n FROM gr WHERE event_id >= (SELECT floor(0.8 * count(*)) FROM pe)" for z in _ZS)}),
gc AS (SELECT z AS zscore_threshold, t AS ensemble_threshold, count_if((round(s, 9) > t OR n >= 2) AND y) AS tp, count_if((round(s, 9) > t OR n >= 2) AND NOT y) AS fp, count_if(NOT (round(s, 9) > t OR n >= 2) AND y) AS fn FROM gz, (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in _TS)}]) AS t) ts GROUP BY ALL),
gg AS (SELECT zscore_threshold, ensemble_threshold, {prf()} FROM gc)"""


_FOLDS = 4
_FOLD_GRID = _GRID.split("gc AS")[0].replace("SELECT event_id, label_is_anomaly AS y", 'SELECT event_id, epoch_us("timestamp")::DOUBLE AS moment, label_is_anomaly AS y') + f"""gq AS (SELECT quantile_cont(moment, [{", ".join(str(k / _FOLDS) for k in range(1, _FOLDS))}]) AS q FROM gz WHERE z = {_ZS[0]}),
gf AS (SELECT gz.*, len(list_filter(q, lambda c: moment >= c)) AS fold FROM gz, gq),
gc AS (SELECT fold, z AS zscore_threshold, t AS ensemble_threshold, count_if((round(s, 9) > t OR n >= 2) AND y) AS tp, count_if((round(s, 9) > t OR n >= 2) AND NOT y) AS fp, count_if(NOT (round(s, 9) > t OR n >= 2) AND y) AS fn FROM gf, (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in _TS)}]) AS t) ts GROUP BY ALL),
gg AS (SELECT fold, zscore_threshold, ensemble_threshold, {prf()} FROM gc)"""


def _folds(spark, d, use_forest=False):
    events = load(spark, d)
    table = tuning.grid_input(events, use_forest=use_forest).filter("split = 'test'")
    return evaluate.grid_search(evaluate.time_folds(table, _FOLDS, evaluate.train_test(events).filter("split = 'test'")), by=("fold",))


@query(with_(_FOLD_GRID, "SELECT fold::INT AS fold, zscore_threshold, ensemble_threshold, precision, recall, f1 FROM gg"))
def grid_folds(spark, d):
    """The 24 forest-free settings on each of four parts of the held-out rows, in time order."""
    return _folds(spark, d)


@query(with_(_FOLD_GRID, f"""SELECT b.zscore_threshold, b.ensemble_threshold, tune_f1, precision AS report_precision, recall AS report_recall, f1 AS report_f1
  FROM (SELECT zscore_threshold, ensemble_threshold, round(avg(f1), 6) AS tune_f1 FROM gg WHERE fold < {_FOLDS - 1} GROUP BY ALL ORDER BY tune_f1 DESC, zscore_threshold, ensemble_threshold LIMIT 1) b
  JOIN gg ON gg.fold = {_FOLDS - 1} AND gg.zscore_threshold = b.zscore_threshold AND gg.ensemble_threshold = b.ensemble_threshold"""))
def tuned_and_reported(spark, d):
    """Settings chosen on the earlier parts, and their figures on the last one."""
    return evaluate.tuned_and_reported(_folds(spark, d), _FOLDS - 1)


@query()
def tuned_and_reported_forest(spark, d):
    """The same over all 96 settings."""
    return evaluate.tuned_and_reported(_folds(spark, d, True), _FOLDS - 1)


def _grid(spark, d, use_forest=False):
    """24 settings without the forest, as the SQL has them, or all 96 with it."""
    return evaluate.grid_search(tuning.grid_input(load(spark, d), use_forest=use_forest).filter("split = 'test'"))


@query()
def grid_search_forest(spark, d):
    return _grid(spark, d, True)


@query()
def grid_pivot_forest(spark, d):
    return evaluate.grid_pivot(_grid(spark, d, True))


@query()
def grid_contamination_pivot(spark, d):
    return evaluate.contamination_pivot(_grid(spark, d, True))


@query()
def grid_top10_forest(spark, d):
    return _grid(spark, d, True).orderBy(F.col("f1").desc(), "contamination", "zscore_threshold", "ensemble_threshold").limit(10)


@query()
def f1_histogram_forest(spark, d):
    from ..operators.reports import histogram

    return histogram(_grid(spark, d, True), "f1", 0.0, 1.0, 30, [])


@query(with_(_GRID, "SELECT * FROM gg"))
def grid_search(spark, d):
    return _grid(spark, d)


@query(with_(_GRID, "SELECT zscore_threshold, " + ", ".join(f"round(avg(CASE WHEN ensemble_threshold = {t} THEN f1 END), 6) AS t_{f'{t:.2f}'.replace('.', '_')}" for t in _TS) + " FROM gg GROUP BY 1"))
def grid_pivot(spark, d):
    return evaluate.grid_pivot(_grid(spark, d))


@query(with_(_GRID, "SELECT * FROM gg ORDER BY f1 DESC, zscore_threshold, ensemble_threshold LIMIT 10"))
def grid_top10(spark, d):
    return _grid(spark, d).orderBy(F.col("f1").desc(), "zscore_threshold", "ensemble_threshold").limit(10)


@query(with_(_GRID, "SELECT least(greatest(CAST(floor(f1 / (1.0 / 30)) AS INTEGER) + 1, 1), 30) AS bin, count(*) AS count FROM gg GROUP BY 1"))
def f1_histogram(spark, d):
    from ..operators.reports import histogram

    return histogram(_grid(spark, d), "f1", 0.0, 1.0, 30, [])


@query(with_(_TEST, "SELECT label_type AS anomaly_type, count(*) AS total, round(avg(is_anomaly::INT), 4) AS ensemble_recall, round(avg(rule_anomaly::INT), 4) AS rules_recall, round(avg((is_anomaly OR rule_anomaly)::INT), 4) AS combined_recall FROM te WHERE label_type IS NOT NULL GROUP BY 1"))
def type_recall(spark, d):
    return evaluate.type_recall(scored(spark, d).filter("split = 'test'"))


_BOARD = {"stat_zscore": "stat_zscore", "stat_mad": "stat_mad", "stat_iqr": "stat_iqr", "ctx_all": "ctx_anomaly", "rules_all": "rule_anomaly"}


@query(with_(_TEST, "SELECT method, family, precision, recall, f1 FROM (SELECT *, split_part(method, '_', 1) AS family, row_number() OVER (PARTITION BY split_part(method, '_', 1) ORDER BY f1 DESC, method) AS place FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS method, {prf()} FROM {_counts(f, 'te')} t" for m, f in _BOARD.items()) + ") u) v WHERE place = 1"))
def leaderboard(spark, d):
    rows = evaluate.prf_by_method(scored(spark, d).filter("split = 'test'"), {m: F.col(c) for m, c in _BOARD.items()})
    return evaluate.leaderboard(rows).select("method", "family", "precision", "recall", "f1")


@query("SELECT f, round(recall, 6) AS recall, round(f * recall / (2 * recall - f), 6) AS precision FROM (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS f) a, (SELECT i / 99.0 * 0.99 + 0.01 AS recall FROM range(100) t(i)) b WHERE 2 * recall - f <> 0 AND f * recall / (2 * recall - f) > 0 AND f * recall / (2 * recall - f) <= 1")
def iso_f1(spark, d):
    return evaluate.iso_f1(spark)


# A log made from all events: a run each, of four methods with repeated settings, as JSON lines.
_METHOD = "CASE event_id % 4 WHEN 0 THEN 'ensemble' WHEN 1 THEN 'ensemble_optimized' WHEN 2 THEN 'business_rules' ELSE 'business_rules_optimized' END"
_RUN = f"""rn AS (SELECT event_id + 1 AS experiment_id, ts AS "timestamp", {_METHOD} AS method, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 3 AS VARCHAR) END AS z, round(value, 4) / 1000 AS f1, event_id % 7 AS runtime FROM events)"""


def _log(spark, d):
    """Parsed from JSON text, with a blank and a malformed line among the records."""
    e = spark.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    method = F.element_at(F.array(*[F.lit(m) for m in ("ensemble", "ensemble_optimized", "business_rules", "business_rules_optimized")]), (i % 4 + 1).cast("int"))
    params = F.when(i % 5 == 0, F.lit(None)).otherwise(F.create_map(F.lit("z"), (i % 3).cast("string")))
    record = F.struct(
        (i + 1).alias("experiment_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), method.alias("method"), params.alias("params"),
        F.create_map(F.lit("f1"), F.round("value", 4) / 1000, F.lit("runtime"), (i % 7).cast("double")).alias("metrics"),
    )
    lines = e.select(F.explode(F.array(F.to_json(record), F.lit("  "), F.lit('{"experiment_id": 1, "method"'))).alias("value"))
    return experiments.parse(lines)


def _f1():
    return F.round(experiments.metric("f1"), 7).alias("f1")


@query(with_(_RUN, 'SELECT experiment_id, "timestamp", method, z AS param_z, round(f1, 7) AS f1 FROM rn'))
def experiment_history(spark, d):
    rows = experiments.flattened(_log(spark, d), ["z"], ["f1"])
    return rows.select("experiment_id", "timestamp", "method", "param_z", F.round("metric_f1", 7).alias("f1"))


@query(with_(_RUN, "SELECT experiment_id, method, round(f1, 7) AS f1 FROM rn WHERE method = 'ensemble' ORDER BY rn.f1 DESC, experiment_id LIMIT 1"))
def best_experiment(spark, d):
    return experiments.best_by_metric(_log(spark, d), "f1", "ensemble").select("experiment_id", "method", _f1())


@query(with_(_RUN, 'SELECT method, arg_max(experiment_id, ("timestamp", experiment_id)) AS experiment_id FROM rn GROUP BY 1'))
def latest_per_method(spark, d):
    return experiments.latest_per_method(_log(spark, d)).select("method", "experiment_id")


@query(with_(_RUN, "SELECT experiment_id, method, round(f1, 7) AS f1 FROM rn WHERE experiment_id IN (3, 7, 11, 5003)"))
def compare_experiments(spark, d):
    return experiments.compare(_log(spark, d), [3, 7, 11, 5003]).select("experiment_id", "method", _f1())


@query(with_(_RUN, "SELECT experiment_id, method, round(f1, 7) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY method, z ORDER BY f1 DESC, experiment_id) AS place FROM rn) t WHERE place = 1"))
def experiment_dedup(spark, d):
    return experiments.best_per_setting(_log(spark, d)).select("experiment_id", "method", _f1())


@query(with_(_RUN, "SELECT regexp_replace(method, '_optimized', '') AS base_method, round(max(CASE WHEN NOT contains(method, 'optimized') THEN f1 END), 7) AS default_f1, round(max(CASE WHEN contains(method, 'optimized') THEN f1 END), 7) AS optimized_f1 FROM rn GROUP BY 1"))
def default_against_optimized(spark, d):
    rows = experiments.default_against_optimized(_log(spark, d))
    return rows.select("base_method", F.round("default_f1", 7).alias("default_f1"), F.round("optimized_f1", 7).alias("optimized_f1"))


@query(with_(_RUN, "SELECT experiment_id, method, runtime::DOUBLE AS runtime FROM rn"))
def runtime_ranking(spark, d):
    rows = _log(spark, d).select("experiment_id", "method", experiments.metric("runtime").alias("runtime"))
    return rows.orderBy("runtime", "experiment_id")


@query(with_(_RUN, """SELECT experiment_id AS run_id, "timestamp" AS started_at, 'completed' AS status, method, round(f1, 7) AS f1_score FROM rn"""))
def performance_history(spark, d):
    log = _log(spark, d)
    runs = log.select(F.col("experiment_id").alias("run_id"), F.col("timestamp").alias("started_at"), F.lit("completed").alias("status"))
    rows = log.select(F.col("experiment_id").alias("run_id"), "method", F.round(experiments.metric("f1"), 7).alias("f1_score"))
    return history_of(rows, runs)


for _name in ("experiment_history", "best_experiment", "latest_per_method", "compare_experiments", "experiment_dedup", "default_against_optimized", "runtime_ranking", "performance_history"):
    QUERIES[f"whole_{_name}"], ORACLE[f"whole_{_name}"] = QUERIES[_name], ORACLE[_name]  # the names that read all events before the others did
