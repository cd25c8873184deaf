"""Scan, features, rules, statistical and contextual detectors."""

from pyspark.sql import functions as F

from ..config import RULES, TUNED
from ..functions.features import FEATURES, engineer_features
from ..operators import context, eda, evaluate, rules, stats
from ..sources.fixtures import pricing_events as load
from .registry import query
from .sql import CTX, PE, RULED, TRAIN, Z, context_cte, rolling_sql, stat_cte, stats_cte, with_

EVENT_COLUMNS = (
    'event_id, "timestamp", category, base_price, surge_multiplier, final_price, demand_level, supply_level, distance_miles, duration_minutes, region, label_is_anomaly, label_type'
)
RULE_COLUMNS = [*RULES, "rule_anomaly", "rule_violations", "rule_severity"]


@query(with_(PE, f"SELECT {EVENT_COLUMNS} FROM pe"))
def pricing_events(spark, d):
    return load(spark, d)


@query(with_(f"{PE},\n{RULED}", f"SELECT event_id, {', '.join(RULE_COLUMNS)}, round(rule_score, 6) AS rule_score FROM ruled"))
def rule_flags(spark, d):
    return rules.validate(load(spark, d)).select("event_id", *RULE_COLUMNS, F.round("rule_score", 6).alias("rule_score"))


@query(with_(f"{PE},\n{RULED}", " UNION ALL ".join(f"SELECT '{r}' AS rule, count_if({r}) AS hits FROM ruled" for r in RULES)))
def rule_summary(spark, d):
    cells = [F.struct(F.lit(r).alias("rule"), F.count_if(r).alias("hits")) for r in RULES]
    return rules.validate(load(spark, d)).agg(F.array(*cells).alias("x")).select(F.inline("x"))


@query(with_(f"{PE},\n{RULED}", "SELECT category, rule_severity, count(*) AS n FROM ruled GROUP BY ALL"))
def rule_severity_counts(spark, d):
    return rules.validate(load(spark, d)).groupBy("category", "rule_severity").agg(F.count(F.lit(1)).alias("n"))


_FEATURE_SQL = {
    "surge_multiplier": "surge_multiplier", "price_to_base_ratio": "final_price / greatest(base_price, 0.01)", "price_per_mile": "final_price / greatest(distance_miles, 0.1)",
    "price_per_minute": "final_price / greatest(duration_minutes, 1)", "demand_supply_gap": "demand_level - supply_level", "demand_supply_ratio": "demand_level / greatest(supply_level, 0.01)",
    "surge_demand_ratio": "surge_multiplier / greatest(demand_level, 0.01)", "hour_sin": "sin(2 * pi() * hour(\"timestamp\") / 24)", "hour_cos": "cos(2 * pi() * hour(\"timestamp\") / 24)",
    "is_rush_hour": "CASE WHEN hour(\"timestamp\") BETWEEN 7 AND 9 OR hour(\"timestamp\") BETWEEN 17 AND 19 THEN 1.0 ELSE 0.0 END", "is_late_night": "CASE WHEN hour(\"timestamp\") <= 5 THEN 1.0 ELSE 0.0 END",
    "is_weekend": "CASE WHEN isodow(\"timestamp\") >= 6 THEN 1.0 ELSE 0.0 END", "final_price": "final_price", "log_price": "ln(1 + greatest(final_price, 0))", "speed_implied": "distance_miles / (greatest(duration_minutes, 1) / 60)",
}


@query(with_(PE, "SELECT event_id, " + ", ".join(f"round(({_FEATURE_SQL[n]})::DOUBLE, 8) + 0 AS {n}" for n in FEATURES) + " FROM pe"))
def features_15(spark, d):
    return engineer_features(load(spark, d)).select("event_id", *[(F.round(n, 8) + 0).alias(n) for n in FEATURES])


@query(with_(PE, "SELECT split, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, CASE WHEN event_id < (SELECT floor(0.8 * count(*)) FROM pe) THEN 'train' ELSE 'test' END AS split FROM pe) t GROUP BY split"))
def train_test_split(spark, d):
    return evaluate.train_test(load(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


_COLUMNS = [c.strip().strip('"') for c in EVENT_COLUMNS.split(",")]


@query(with_(PE, " UNION ALL ".join([f"SELECT '{c}' AS \"column\", count(*) - count(\"{c}\") AS nulls FROM pe" for c in _COLUMNS] + ["SELECT 'duplicate_event_ids', count(event_id) - count(DISTINCT event_id) FROM pe"])))
def data_quality(spark, d):
    return eda.data_quality(load(spark, d))


@query(with_(PE, 'SELECT min("timestamp") AS first_seen, max("timestamp") AS last_seen, count(DISTINCT category) AS categories, min(final_price) AS min_price, max(final_price) AS max_price, count(*) AS events FROM pe'))
def profile(spark, d):
    return eda.profile(load(spark, d))


_STATS = ["price_mean", "price_std", "price_median", "price_mad", "price_q1", "price_q3", "price_iqr", "surge_mean", "surge_std", "surge_p95", "surge_p99"]


@query(with_(f"{PE},\n{stats_cte('pe')}", f"SELECT category, {', '.join(f'round({c}, 6) AS {c}' for c in _STATS)}, n FROM st"))
def category_stats(spark, d):
    return stats.category_stats(load(spark, d)).select("category", *[F.round(c, 6).alias(c) for c in _STATS], "n")


_STAT_SQL = f"{PE},\n{TRAIN},\n{stats_cte('tr')},\n{stat_cte('pe')}"


def _stat_scored(spark, d):
    events = load(spark, d)
    train = evaluate.train_test(events).filter("split = 'train'").drop("split")
    return stats.score(events, stats.category_stats(train, surge_tails=False))


@query(with_(PE, """SELECT id AS event_id, CASE WHEN row_number() OVER (ORDER BY "timestamp", id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM (SELECT (event_id * 7919) % 1000003 AS id, "timestamp" FROM pe) t"""))
def sparse_split(spark, d):
    """The split by time where ids are neither dense nor in time order."""
    events = load(spark, d).withColumn("event_id", F.col("event_id") * 7919 % 1000003)
    return evaluate.train_test(events).select("event_id", "split")


@query(with_(_STAT_SQL, "SELECT event_id, stat_zscore, stat_mad, stat_iqr, stat_rolling, stat_anomaly, round(stat_score, 6) AS stat_score FROM ss"))
def stat_score(spark, d):
    return _stat_scored(spark, d).select("event_id", "stat_zscore", "stat_mad", "stat_iqr", "stat_rolling", "stat_anomaly", F.round("stat_score", 6).alias("stat_score"))


@query(with_(_STAT_SQL, " UNION ALL ".join(f"SELECT '{t}' AS test, category, count_if(stat_{t}) AS hits FROM ss GROUP BY category" for t in ("zscore", "mad", "iqr", "rolling"))))
def stat_test_counts(spark, d):
    cells = F.array(*[F.struct(F.lit(t).alias("test"), F.col(f"stat_{t}").alias("hit")) for t in ("zscore", "mad", "iqr", "rolling")])
    rows = _stat_scored(spark, d).select("category", F.explode(cells).alias("t"))
    return rows.groupBy("t.test", "category").agg(F.count_if("t.hit").alias("hits"))


@query(with_(PE, f"SELECT event_id, {rolling_sql(Z, 'stat_rolling')} FROM pe"))
def rolling_flags(spark, d):
    return stats.rolling_flags(load(spark, d)).select("event_id", "stat_rolling")


@query(with_(PE, f"SELECT event_id, {rolling_sql(Z, 'stat_rolling')} FROM pe"))
def rolling_flags_by_day(spark, d):
    return stats.rolling_flags(load(spark, d)).select("event_id", "stat_rolling")


_ONE_DAY = """od AS (SELECT event_id, category, final_price, TIMESTAMP '2024-06-03' + ("timestamp" - date_trunc('day', "timestamp")) AS "timestamp" FROM pe)"""


@query(with_(f"{PE},\n{_ONE_DAY}", f"SELECT event_id, {rolling_sql(Z, 'stat_rolling')} FROM od"))
def rolling_flags_one_day(spark, d):
    """The rolling test where all events fall on one day: no task grows with a day's rows."""
    ts = F.col("timestamp")
    moved = load(spark, d).withColumn("timestamp", F.timestamp_micros(F.unix_micros(F.lit("2024-06-03 00:00:00").cast("timestamp")) + F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.date_trunc("day", ts).cast("timestamp"))))
    return stats.rolling_flags(moved).select("event_id", "stat_rolling")


_CTX = ["mean", "std", "median", "surge_mean", "surge_std"]


@query(with_(f"{PE},\n{context_cte('pe')}", f"SELECT category, hour_block, is_weekend, {', '.join(f'round({c}, 6) AS {c}' for c in _CTX)}, n FROM cb"))
def context_baselines(spark, d):
    return context.baselines_with_medians(load(spark, d)).select(*context.KEYS, *[F.round(c, 6).alias(c) for c in _CTX], "n")


@query(with_(f"{PE},\n{TRAIN},\n{context_cte('tr')},\n{CTX.format(src='pe')}", "SELECT event_id, ctx_anomaly, round(ctx_score, 6) AS ctx_score FROM cs"))
def context_scores(spark, d):
    events = load(spark, d)
    train = evaluate.train_test(events).filter("split = 'train'").drop("split")
    return context.score(events, context.baselines(train), TUNED).select("event_id", "ctx_anomaly", F.round("ctx_score", 6).alias("ctx_score"))
