"""Summaries an operator's dashboard shows; every one is a function of its input tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SEVERITIES
from .quantiles import percentiles


def hour_text(ts) -> Column:
    return F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH:00:00")


def _anomalies(name: str = "anomaly_count") -> Column:
    return F.sum(F.col("label_is_anomaly").cast("long")).alias(name)


def _mean(c: str, name: str, digits: int = 6) -> Column:
    return F.round(F.avg(c), digits).alias(name)


def hourly_stats(events: DataFrame) -> DataFrame:
    return events.groupBy(hour_text(F.col("timestamp")).alias("hour"), "category").agg(
        F.count(F.lit(1)).alias("event_count"), _mean("final_price", "avg_price"), F.min("final_price").alias("min_price"), F.max("final_price").alias("max_price"),
        _mean("surge_multiplier", "avg_surge"), _mean("demand_level", "avg_demand"), _mean("supply_level", "avg_supply"), _anomalies(),
    )


def anomaly_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("category", "severity", "detection_method").agg(
        F.count(F.lit(1)).alias("count"), _mean("anomaly_score", "avg_score"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def events_between(events: DataFrame, start: str | None = None, end: str | None = None, category: str | None = None, limit: int | None = 10_000) -> DataFrame:
    """Latest events of a closed time range (without ``limit`` all, in no order); filters reach the scan."""
    out = events
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    if category is not None:
        out = out.filter(F.col("category") == category)
    return out if limit is None else out.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(limit)


def top_alerts(alerts: DataFrame, severities=None, start: str | None = None, limit: int = 500) -> DataFrame:
    out = alerts
    if severities:
        out = out.filter(F.col("severity").isin(list(severities)))
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    return out.orderBy(F.round("anomaly_score", 9).desc(), "event_id").limit(limit)


def drill_down(alerts: DataFrame, severities, types, min_score: float, limit: int = 100) -> DataFrame:
    """Alerts by severity, type (null types drop out) and least score."""
    kept = alerts.filter(F.col("severity").isin(list(severities)) & F.col("anomaly_type").isin(list(types)) & (F.col("anomaly_score") >= min_score))
    return kept.orderBy(F.round("anomaly_score", 9).desc(), "event_id").limit(limit)


def sidebar(events: DataFrame, categories, start: str, end: str) -> DataFrame:
    """Events of some categories from ``start`` to the end of the day ``end``."""
    ts = F.col("timestamp")
    after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return events.filter(F.col("category").isin(list(categories)) & (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < after))


def kpis(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: events, anomalies, rate, critical, high, sums of absolute price and of impact."""
    a = alerts.agg(
        F.count(F.lit(1)).alias("anomalies"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"),
        F.round(F.coalesce(F.sum(F.abs("final_price")), F.lit(0.0)), 2).alias("abs_price_sum"), F.round(F.coalesce(F.sum("estimated_impact_usd"), F.lit(0.0)), 2).alias("impact_usd_sum"),
    )
    n = events.agg(F.count(F.lit(1)).alias("events"))
    return n.crossJoin(a).withColumn("rate_pct", F.round(F.when(F.col("events") > 0, 100.0 * F.col("anomalies") / F.col("events")).otherwise(0.0), 4))


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Counts in the fixed severity order; absent severities are not listed."""
    order = F.array(*[F.lit(s) for s in SEVERITIES])
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("place", F.array_position(order, F.col("severity")).cast("int"))


def severity_timeline(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(hour_text(F.col("timestamp")).alias("hour"), "severity").agg(F.count(F.lit(1)).alias("count"))


def severity_pivot(alerts: DataFrame) -> DataFrame:
    """category by severity, zero-filled, in fixed column order."""
    return alerts.groupBy("category").pivot("severity", SEVERITIES).agg(F.count(F.lit(1))).na.fill(0, SEVERITIES)


def hour_pattern(events: DataFrame) -> DataFrame:
    return events.groupBy(F.hour("timestamp").alias("hour")).agg(_mean("final_price", "avg_price"), _mean("surge_multiplier", "avg_surge"), _mean("demand_level", "avg_demand"))


def _rate() -> Column:
    return F.round(100.0 * F.sum(F.col("label_is_anomaly").cast("long")) / F.count(F.lit(1)), 2).alias("anomaly_rate_pct")


def category_summary(events: DataFrame) -> DataFrame:
    p = F.col("final_price")
    medians = percentiles(events, {"final_price": [0.5]}, ["category"]).select(F.col("category").alias("c"), F.round(F.col("final_price")[0], 2).alias("median_price"))
    rows = events.groupBy("category").agg(
        F.count(F.lit(1)).alias("events"), _mean("final_price", "avg_price", 2), F.round(F.stddev_samp(p), 2).alias("std_price"), F.round(F.min(p), 2).alias("min_price"), F.round(F.max(p), 2).alias("max_price"),
        _mean("surge_multiplier", "avg_surge", 2), F.round(F.max("surge_multiplier"), 2).alias("max_surge"), _anomalies("anomalies"), _rate(),
    )
    return rows.join(medians, F.col("category").eqNullSafe(F.col("c"))).drop("c")


def region_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("region").agg(
        F.count(F.lit(1)).alias("total"), _anomalies("anomalies"), _mean("final_price", "avg_price", 2), _mean("surge_multiplier", "avg_surge", 2), _rate()
    )


def type_counts(alerts: DataFrame, limit: int = 15) -> DataFrame:
    counts = alerts.filter(F.col("anomaly_type").isNotNull()).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), "anomaly_type").limit(limit)


def method_counts(alerts: DataFrame, raw: bool = False) -> DataFrame:
    """Alerts per detection method; scores in brackets are dropped unless ``raw``."""
    rows = alerts.select(F.explode(F.split("detection_method", r" \+ ")).alias("method")).select(F.trim("method").alias("method"))
    if not raw:
        rows = rows.select(F.regexp_replace("method", r" \(.*\)", "").alias("method"))
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("count"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int, by: list) -> DataFrame:
    """Counts per equal-width bin 1..bins; values outside fall into the first or last bin."""
    v = F.col(column)
    place = F.floor((v - low) / ((high - low) / bins)).cast("int") + 1
    return rows.filter(v.isNotNull()).groupBy(*by, F.least(F.greatest(place, F.lit(1)), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def coverage(events: DataFrame, truth_count: Column, alerts: DataFrame) -> DataFrame:
    """One row: totals of events, labelled rows and alerts, and their ratios."""
    e = events.agg(F.count(F.lit(1)).alias("total_events"), F.sum(truth_count.cast("long")).alias("truth"))
    a = alerts.agg(F.count(F.lit(1)).alias("detected"))
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return e.crossJoin(a).select(
        "total_events", "truth", "detected", F.round(F.col("truth") / one("total_events"), 6).alias("truth_share"),
        F.round(F.col("detected") / one("total_events"), 6).alias("detected_share"), F.round(F.col("detected") / one("truth"), 6).alias("detected_to_truth"),
    )


def quartiles(events: DataFrame, by: list) -> DataFrame:
    """Box-plot numbers: quartiles and the 1.5 IQR whisker ends."""
    q = percentiles(events, {"final_price": [0.25, 0.5, 0.75]}, by)
    rows = q.select(*by, *[F.col("final_price")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    width = 1.5 * (F.col("q3") - F.col("q1"))
    return rows.select(*by, *[F.round(c, 6).alias(n) for n, c in (("q1", F.col("q1")), ("median", F.col("median")), ("q3", F.col("q3")), ("low", F.col("q1") - width), ("high", F.col("q3") + width))])
