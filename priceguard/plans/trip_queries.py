"""Trip adapter queries."""

from pyspark.sql import functions as F

from ..sources import trips
from ..sources.fixtures import trip_records
from .registry import query
from .sql import TRIPS, with_

_NUM = ["base_price", "surge_multiplier", "final_price", "demand_level", "supply_level", "distance_miles", "duration_minutes"]


def _events(spark, d):
    return trips.label_natural(trips.transform(trip_records(spark, d), None))


@query(with_(TRIPS, f"SELECT event_id, category, region, {', '.join(f'round({c}, 6) AS {c}' for c in _NUM)} FROM tx"))
def trip_transform(spark, d):
    return _events(spark, d).select("event_id", "category", "region", *[F.round(c, 6).alias(c) for c in _NUM])


@query(with_(TRIPS, "SELECT event_id, category, region, round(base_price, 6) AS base_price, round(surge_multiplier, 6) AS surge_multiplier, anomaly_type IS NOT NULL AS is_anomaly, anomaly_type FROM tl"))
def trip_natural_labels(spark, d):
    rows = _events(spark, d)
    return rows.select("event_id", "category", "region", F.round("base_price", 6).alias("base_price"), F.round("surge_multiplier", 6).alias("surge_multiplier"), F.col("label_is_anomaly").alias("is_anomaly"), F.col("label_type").alias("anomaly_type"))


@query(with_(TRIPS, "SELECT region, category, count(*) AS n, round(avg(final_price), 6) AS avg_price, count(anomaly_type) AS anomalies FROM tl GROUP BY ALL"))
def trip_region_category(spark, d):
    return _events(spark, d).groupBy("region", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("final_price"), 6).alias("avg_price"), F.count("label_type").alias("anomalies"))


@query()
def trip_injection(spark, d):
    return trips.inject(_events(spark, d))[0]


@query()
def trip_injection_truth(spark, d):
    return trips.inject(_events(spark, d))[1]
