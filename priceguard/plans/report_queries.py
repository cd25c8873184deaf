"""Dashboard summaries and exploratory statistics."""

from pyspark.sql import functions as F

from ..config import TUNED
from ..operators import alerts, eda, reports
from ..operators.ensemble import EnsembleDetector
from ..operators.evaluate import train_test
from ..operators.quantiles import percentiles
from ..operators.rules import validate
from ..sources.fixtures import pricing_events as load
from .registry import query
from .sql import ALERTS, PE, SCORED, with_

TS = '"timestamp"'
HOUR = f"strftime(date_trunc('hour', {TS}), '%Y-%m-%d %H:00:00')"


def scored(spark, d):
    """Statistical and contextual detectors fitted on the first four fifths, and the rules, over all events."""
    split = train_test(load(spark, d))
    train = split.filter("split = 'train'").drop("split")
    return validate(EnsembleDetector(TUNED, use_forest=False).fit(train).predict(split), TUNED.rules)


def found(spark, d):
    return alerts.alert_records(alerts.classify(scored(spark, d)))


AL = f"{SCORED},\n{ALERTS}"


@query(with_(PE, f"SELECT {HOUR} AS hour, category, count(*) AS event_count, round(avg(final_price), 6) AS avg_price, min(final_price) AS min_price, max(final_price) AS max_price, round(avg(surge_multiplier), 6) AS avg_surge, round(avg(demand_level), 6) AS avg_demand, round(avg(supply_level), 6) AS avg_supply, count_if(label_is_anomaly) AS anomaly_count FROM pe GROUP BY ALL"))
def hourly_stats(spark, d):
    return reports.hourly_stats(load(spark, d))


@query(with_(PE, f"SELECT {HOUR} AS hour, round(avg(final_price), 6) AS mean, round(stddev_samp(final_price), 6) AS std, count(*) AS n, count_if(label_is_anomaly) > 0 AS flagged FROM pe WHERE category = 'ride_standard' GROUP BY 1"))
def category_series(spark, d):
    rows = load(spark, d).filter(F.col("category") == "ride_standard").groupBy(reports.hour_text(F.col("timestamp")).alias("hour"))
    return rows.agg(F.round(F.avg("final_price"), 6).alias("mean"), F.round(F.stddev_samp("final_price"), 6).alias("std"), F.count("*").alias("n"), (F.count_if("label_is_anomaly") > 0).alias("flagged"))


@query(with_(AL, f"SELECT category, severity, detection_method, count(*) AS count, round(avg(anomaly_score), 6) AS avg_score, min({TS}) AS first_seen, max({TS}) AS last_seen FROM al GROUP BY ALL"))
def anomaly_summary(spark, d):
    return reports.anomaly_summary(found(spark, d))


@query(with_(PE, f"SELECT event_id, {TS}, category, final_price FROM pe WHERE {TS} >= '2024-01-05' AND {TS} <= '2024-01-20' AND category = 'ride_pool' ORDER BY {TS} DESC, event_id DESC LIMIT 500"))
def events_filtered_topn(spark, d):
    return reports.events_between(load(spark, d), "2024-01-05", "2024-01-20", "ride_pool", 500).select("event_id", "timestamp", "category", "final_price")


@query(with_(AL, f"SELECT event_id, {TS}, category, severity, round(anomaly_score, 6) AS anomaly_score FROM al WHERE severity IN ('critical', 'high', 'medium') AND {TS} >= '2024-01-03' ORDER BY round(anomaly_score, 9) DESC, event_id LIMIT 500"))
def alerts_topn(spark, d):
    top = reports.top_alerts(found(spark, d), ["critical", "high", "medium"], "2024-01-03")
    return top.select("event_id", "timestamp", "category", "severity", F.round("anomaly_score", 6).alias("anomaly_score"))


@query(with_(AL, "SELECT event_id, severity, round(anomaly_score, 6) AS anomaly_score FROM al WHERE severity IN ('critical', 'high', 'medium') ORDER BY round(anomaly_score, 9) DESC, event_id LIMIT 20"))
def top_critical_alerts(spark, d):
    return reports.top_alerts(found(spark, d), ["critical", "high", "medium"], limit=20).select("event_id", "severity", F.round("anomaly_score", 6).alias("anomaly_score"))


@query(with_(AL, "SELECT event_id, severity, anomaly_type, round(anomaly_score, 6) AS anomaly_score FROM al WHERE severity IN ('high', 'medium') AND anomaly_type IN ('negative_price', 'runaway_surge') AND anomaly_score >= 0.3 ORDER BY round(anomaly_score, 9) DESC, event_id LIMIT 100"))
def alert_drilldown(spark, d):
    rows = reports.drill_down(found(spark, d), ["high", "medium"], ["negative_price", "runaway_surge"], 0.3)
    return rows.select("event_id", "severity", "anomaly_type", F.round("anomaly_score", 6).alias("anomaly_score"))


@query(with_(PE, f"SELECT event_id, category, final_price FROM pe WHERE category IN ('ride_standard', 'delivery_food') AND {TS} >= '2024-01-10' AND {TS} < '2024-01-16'"))
def sidebar_filter(spark, d):
    return reports.sidebar(load(spark, d), ["ride_standard", "delivery_food"], "2024-01-10", "2024-01-15").select("event_id", "category", "final_price")


@query(with_(PE, "SELECT event_id, category, label_type FROM pe WHERE label_is_anomaly ORDER BY event_id LIMIT 500"))
def anomalous_only(spark, d):
    return load(spark, d).filter("label_is_anomaly").select("event_id", "category", "label_type").orderBy("event_id").limit(500)


@query(with_(PE, "SELECT label_is_anomaly, count(*) AS n, round(avg(final_price), 6) AS avg_price, round(avg(surge_multiplier), 6) AS avg_surge FROM pe GROUP BY 1"))
def label_split(spark, d):
    return load(spark, d).groupBy("label_is_anomaly").agg(F.count("*").alias("n"), F.round(F.avg("final_price"), 6).alias("avg_price"), F.round(F.avg("surge_multiplier"), 6).alias("avg_surge"))


@query(with_(AL, "SELECT (SELECT count(*) FROM pe) AS events, count(*) AS anomalies, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, round(sum(abs(final_price)), 2) AS abs_price_sum, round(sum(estimated_impact_usd), 2) AS impact_usd_sum, round(100.0 * count(*) / (SELECT count(*) FROM pe), 4) AS rate_pct FROM al"))
def kpi_row(spark, d):
    return reports.kpis(load(spark, d), found(spark, d))


@query(with_(AL, "SELECT severity, count(*) AS count, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS place FROM al GROUP BY 1"))
def severity_counts(spark, d):
    return reports.severity_counts(found(spark, d))


@query(with_(AL, f"SELECT {HOUR} AS hour, severity, count(*) AS count FROM al GROUP BY ALL"))
def severity_timeline(spark, d):
    return reports.severity_timeline(found(spark, d))


@query(with_(AL, "SELECT category, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low FROM al GROUP BY 1"))
def category_severity_pivot(spark, d):
    return reports.severity_pivot(found(spark, d))


@query(with_(PE, f"SELECT hour({TS}) AS hour, round(avg(final_price), 6) AS avg_price, round(avg(surge_multiplier), 6) AS avg_surge, round(avg(demand_level), 6) AS avg_demand FROM pe GROUP BY 1"))
def hour_pattern(spark, d):
    return reports.hour_pattern(load(spark, d))


_RATE = "round(100.0 * count_if(label_is_anomaly) / count(*), 2) AS anomaly_rate_pct"


@query(with_(PE, f"SELECT category, count(*) AS events, round(avg(final_price), 2) AS avg_price, round(quantile_cont(final_price, 0.5), 2) AS median_price, round(stddev_samp(final_price), 2) AS std_price, round(min(final_price), 2) AS min_price, round(max(final_price), 2) AS max_price, round(avg(surge_multiplier), 2) AS avg_surge, round(max(surge_multiplier), 2) AS max_surge, count_if(label_is_anomaly) AS anomalies, {_RATE} FROM pe GROUP BY 1"))
def category_summary(spark, d):
    return reports.category_summary(load(spark, d))


@query(with_(PE, f"SELECT region, count(*) AS total, count_if(label_is_anomaly) AS anomalies, round(avg(final_price), 2) AS avg_price, round(avg(surge_multiplier), 2) AS avg_surge, {_RATE} FROM pe GROUP BY 1"))
def region_summary(spark, d):
    return reports.region_summary(load(spark, d))


@query(with_(AL, "SELECT anomaly_type, count(*) AS count FROM al WHERE anomaly_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"))
def type_counts_top15(spark, d):
    return reports.type_counts(found(spark, d))


@query(with_(AL, "SELECT regexp_replace(trim(m), ' \\(.*\\)', '') AS method, count(*) AS count FROM (SELECT unnest(string_split(detection_method, ' + ')) AS m FROM al) t GROUP BY 1"))
def method_counts(spark, d):
    return reports.method_counts(found(spark, d))


@query(with_(AL, "SELECT trim(m) AS method, count(*) AS count FROM (SELECT unnest(string_split(detection_method, ' + ')) AS m FROM al) t GROUP BY 1"))
def method_counts_raw(spark, d):
    return reports.method_counts(found(spark, d), raw=True)


def _hist_sql(column: str, low: float, high: float, bins: int, by: str, source: str = "pe", where: str = "true") -> str:
    return f"SELECT {by}least(greatest(CAST(floor(({column} - {low}) / (({high} - {low}) / {bins})) AS INTEGER) + 1, 1), {bins}) AS bin, count(*) AS count FROM {source} WHERE {column} IS NOT NULL AND {where} GROUP BY ALL"


@query(with_(PE, _hist_sql("final_price", -20.0, 300.0, 80, "label_is_anomaly, ")))
def price_histogram(spark, d):
    return reports.histogram(load(spark, d), "final_price", -20.0, 300.0, 80, ["label_is_anomaly"])


@query(with_(PE, _hist_sql("surge_multiplier", -1.0, 21.0, 50, "label_is_anomaly, ")))
def surge_histogram(spark, d):
    return reports.histogram(load(spark, d), "surge_multiplier", -1.0, 21.0, 50, ["label_is_anomaly"])


@query(with_(AL, "SELECT (SELECT count(*) FROM pe) AS total_events, (SELECT count_if(label_is_anomaly) FROM pe) AS truth, count(*) AS detected, round((SELECT count_if(label_is_anomaly) / count(*) FROM pe), 6) AS truth_share, round(count(*) / (SELECT count(*) FROM pe), 6) AS detected_share, round(count(*) / (SELECT count_if(label_is_anomaly) FROM pe), 6) AS detected_to_truth FROM al"))
def coverage(spark, d):
    return reports.coverage(load(spark, d), F.col("label_is_anomaly"), found(spark, d))


_TYPE_SEV = "CASE label_type WHEN 'negative_price' THEN 'critical' WHEN 'flash_crash' THEN 'critical' WHEN 'runaway_surge' THEN 'critical' ELSE 'high' END"


def _truth(spark, d):
    high = F.when(F.col("label_type") == "demand_supply_mismatch", "high").otherwise("critical")
    return load(spark, d).filter("label_is_anomaly").withColumn("severity", high)


@query(with_(PE, f"SELECT label_type AS anomaly_type, {_TYPE_SEV} AS severity, count(*) AS n FROM pe WHERE label_is_anomaly GROUP BY ALL"))
def truth_counts(spark, d):
    return _truth(spark, d).groupBy(F.col("label_type").alias("anomaly_type"), "severity").agg(F.count("*").alias("n"))


@query(with_(PE, f"SELECT label_type AS anomaly_type, count_if({_TYPE_SEV} = 'critical') AS critical, count_if({_TYPE_SEV} = 'high') AS high FROM pe WHERE label_is_anomaly GROUP BY 1"))
def type_severity_crosstab(spark, d):
    return _truth(spark, d).groupBy(F.col("label_type").alias("anomaly_type")).pivot("severity", ["critical", "high"]).agg(F.count(F.lit(1))).na.fill(0, ["critical", "high"])


def _box(by: str) -> str:
    q = "quantile_cont(final_price, {})"
    q1, q2, q3 = (q.format(x) for x in (0.25, 0.5, 0.75))
    return f"SELECT {by}, round({q1}, 6) AS q1, round({q2}, 6) AS median, round({q3}, 6) AS q3, round({q1} - 1.5 * ({q3} - {q1}), 6) AS low, round({q3} + 1.5 * ({q3} - {q1}), 6) AS high FROM pe GROUP BY ALL"


@query(with_(PE, _box("category, label_is_anomaly")))
def box_quartiles(spark, d):
    return reports.quartiles(load(spark, d), ["category", "label_is_anomaly"])


@query(with_(PE, "SELECT category, count(final_price) AS count, round(avg(final_price), 6) AS mean, round(stddev_samp(final_price), 6) AS std, round(min(final_price), 6) AS min, round(quantile_cont(final_price, 0.25), 6) AS p25, round(quantile_cont(final_price, 0.5), 6) AS p50, round(quantile_cont(final_price, 0.75), 6) AS p75, round(max(final_price), 6) AS max FROM pe GROUP BY 1"))
def describe_by_category(spark, d):
    return eda.describe_by(load(spark, d), "category")


@query(with_(PE, f"SELECT hour({TS}) AS hour, category, round(avg(final_price), 6) AS avg_price, round(avg(surge_multiplier), 6) AS avg_surge, round(stddev_samp(surge_multiplier), 6) AS std_surge FROM pe WHERE NOT label_is_anomaly GROUP BY ALL"))
def hour_category_means(spark, d):
    rows = load(spark, d).filter("not label_is_anomaly").groupBy(F.hour("timestamp").alias("hour"), "category")
    return rows.agg(F.round(F.avg("final_price"), 6).alias("avg_price"), F.round(F.avg("surge_multiplier"), 6).alias("avg_surge"), F.round(F.stddev_samp("surge_multiplier"), 6).alias("std_surge"))


@query(with_(PE, f"SELECT dayname({TS}) AS day, isodow({TS}) AS place, round(avg(surge_multiplier), 6) AS avg_surge, round(avg(final_price), 6) AS avg_price FROM pe GROUP BY ALL"))
def day_of_week_means(spark, d):
    ts = F.col("timestamp")
    rows = load(spark, d).groupBy(F.date_format(ts, "EEEE").alias("day"), (F.weekday(ts) + 1).cast("long").alias("place"))
    return rows.agg(F.round(F.avg("surge_multiplier"), 6).alias("avg_surge"), F.round(F.avg("final_price"), 6).alias("avg_price"))


@query(with_(PE, f"SELECT hour({TS}) AS hour, round(avg(demand_level), 6) AS avg_demand, round(avg(supply_level), 6) AS avg_supply FROM pe GROUP BY 1"))
def hour_demand_supply(spark, d):
    return load(spark, d).groupBy(F.hour("timestamp").alias("hour")).agg(F.round(F.avg("demand_level"), 6).alias("avg_demand"), F.round(F.avg("supply_level"), 6).alias("avg_supply"))


@query(with_(PE, "SELECT region, round(avg(final_price), 6) AS mean, round(quantile_cont(final_price, 0.5), 6) AS median, round(stddev_samp(final_price), 6) AS std, round(avg(CASE WHEN label_is_anomaly THEN 1.0 ELSE 0.0 END), 6) AS anomaly_rate, round(avg(distance_miles), 6) AS avg_miles FROM pe GROUP BY 1"))
def region_price_stats(spark, d):
    events, p = load(spark, d), F.col("final_price")
    medians = percentiles(events, {"final_price": [0.5]}, ["region"]).select(F.col("region").alias("r"), F.round(F.col("final_price")[0], 6).alias("median"))
    return events.groupBy("region").agg(
        F.round(F.avg(p), 6).alias("mean"), F.round(F.stddev_samp(p), 6).alias("std"),
        F.round(F.avg(F.col("label_is_anomaly").cast("double")), 6).alias("anomaly_rate"), F.round(F.avg("distance_miles"), 6).alias("avg_miles"),
    ).join(medians, F.col("region").eqNullSafe(F.col("r"))).drop("r")


_RATIOS = """ra AS (SELECT *, final_price / greatest(base_price, 0.01) AS price_to_base_ratio, final_price / greatest(distance_miles, 0.1) AS price_per_mile,
  demand_level - supply_level AS demand_supply_gap, surge_multiplier / greatest(demand_level, 0.01) AS surge_demand_ratio FROM pe)"""


@query(with_(f"{PE},\n{_RATIOS}", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM ra WHERE NOT label_is_anomaly" for a in eda.CORRELATED for b in eda.CORRELATED)))
def corr_matrix(spark, d):
    return eda.correlation(eda.with_ratios(load(spark, d).filter("not label_is_anomaly")))


def _welch(c: str) -> str:
    n, y = f"CASE WHEN NOT label_is_anomaly THEN {c} END", f"CASE WHEN label_is_anomaly THEN {c} END"
    return f"SELECT '{c}' AS feature, round(abs((avg({n}) - avg({y})) / sqrt(var_samp({n}) / count({n}) + var_samp({y}) / count({y}))), 6) AS t_statistic FROM ra"


@query(with_(f"{PE},\n{_RATIOS}", " UNION ALL ".join(_welch(c) for c in eda.CORRELATED)))
def welch_t(spark, d):
    return eda.welch(eda.with_ratios(load(spark, d)))


@query(with_(f"{PE},\nm AS (SELECT category, final_price - avg(final_price) OVER (PARTITION BY category) AS x FROM pe WHERE NOT label_is_anomaly)", "SELECT category, round(avg(x * x * x * x) / pow(avg(x * x), 2) - 3, 5) AS kurtosis, round(avg(x * x * x) / pow(avg(x * x), 1.5), 5) AS skewness FROM m GROUP BY 1"))
def shape_stats(spark, d):
    return eda.shape(load(spark, d).filter("not label_is_anomaly"))


_RUNS = f"""{PE},
hit AS (SELECT event_id, label_type, event_id - row_number() OVER (ORDER BY event_id) AS island FROM pe WHERE label_is_anomaly),
runs AS (SELECT min(event_id) AS start_id, count(*) AS length, arg_max(label_type, event_id) AS run_type FROM hit GROUP BY island)"""


@query(with_(_RUNS, "SELECT * FROM runs"))
def anomaly_runs(spark, d):
    return eda.anomaly_runs(load(spark, d))


_SPARSE_RUNS = f"""{PE},
al AS (SELECT (event_id * 7919) % 1000003 AS id, label_type, label_is_anomaly AS hit, row_number() OVER (ORDER BY {TS}, (event_id * 7919) % 1000003) AS place FROM pe),
h AS (SELECT *, place - row_number() OVER (ORDER BY place) AS island FROM al WHERE hit)"""


@query(with_(_SPARSE_RUNS, "SELECT arg_min(id, place) AS start_id, count(*) AS length, arg_max(label_type, place) AS run_type FROM h GROUP BY island"))
def sparse_runs(spark, d):
    """Runs in time order where ids are neither dense nor in that order."""
    return eda.anomaly_runs(load(spark, d).withColumn("event_id", F.col("event_id") * 7919 % 1000003))


@query(with_(_RUNS, "SELECT max(length) AS longest, round(avg(length), 6) AS mean_length, count_if(length = 1) AS single, count_if(length >= 2) AS two_or_more, count_if(length >= 5) AS five_or_more FROM runs"))
def run_summary(spark, d):
    return eda.run_summary(eda.anomaly_runs(load(spark, d)))


@query(with_(_RUNS, "SELECT run_type, count(*) AS runs, round(avg(length), 6) AS mean_length FROM runs WHERE length >= 2 GROUP BY 1"))
def run_types(spark, d):
    return eda.run_types(eda.anomaly_runs(load(spark, d)), least=2)


_QQ = """rk AS (SELECT category, final_price AS sample, row_number() OVER (PARTITION BY category ORDER BY final_price, event_id) AS place, count(*) OVER (PARTITION BY category) AS n FROM pe WHERE NOT label_is_anomaly),
pp AS (SELECT *, CASE WHEN place = n THEN pow(0.5, 1.0 / n) WHEN place = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (place - 0.3175) / (n + 0.365) END AS p FROM rk),
xx AS (SELECT *, sqrt(-2.0 * ln(least(p, 1 - p))) AS x FROM pp),
ss AS (SELECT *, x - ((0.010328 * x + 0.802853) * x + 2.515517) / (((0.001308 * x + 0.189269) * x + 1.432788) * x + 1.0) AS s FROM xx)"""


@query(with_(f"{PE},\n{_QQ}", "SELECT category, place, round(CASE WHEN p < 0.5 THEN -s ELSE s END, 6) + 0 AS theoretical, sample FROM ss"))
def qq_points(spark, d):
    return eda.qq_points(load(spark, d).filter("not label_is_anomaly")).withColumn("theoretical", F.col("theoretical") + 0)


@query(with_(f"{PE},\ndv AS (SELECT label_type, least(greatest(final_price - base_price * surge_multiplier, -100), 200) AS gap FROM pe WHERE label_is_anomaly)", _hist_sql("gap", -100.0, 200.0, 60, "", "dv")))
def deviation_histogram(spark, d):
    gap = F.least(F.greatest(F.col("final_price") - F.col("base_price") * F.col("surge_multiplier"), F.lit(-100.0)), F.lit(200.0))
    return reports.histogram(load(spark, d).filter("label_is_anomaly").withColumn("gap", gap), "gap", -100.0, 200.0, 60, [])


@query(with_(PE, _hist_sql("final_price", 0.0, 500.0, 80, "category, ", where="NOT label_is_anomaly")))
def category_price_density(spark, d):
    return reports.histogram(load(spark, d).filter("not label_is_anomaly"), "final_price", 0.0, 500.0, 80, ["category"])
