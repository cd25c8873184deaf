"""Deterministic pricing events and trips derived from the ``events`` test table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BASE_PRICES, REGIONS

# The category each event type stands for.
CATEGORY_OF = {
    "click": "ride_standard", "purchase": "ride_premium", "view": "ride_pool",
    "signup": "delivery_food", "error": "delivery_grocery",
}


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def lookup(table: dict, key, default=None):
    """A static dictionary as an expression."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def pricing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table (``EVENTS`` schema) of a test scale."""
    e = _raw(spark, sf_dir)
    i, v = F.col("event_id"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("int")

    def first_of(*cases, default=None):
        out = None
        for n, value in cases:
            out = F.when(i % n == 0, value) if out is None else out.when(i % n == 0, value)
        return out.otherwise(default)

    category = lookup(CATEGORY_OF, F.col("event_type"))
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        category.alias("category"),
        lookup(BASE_PRICES, category).alias("base_price"),
        first_of((97, F.lit(-0.5)), (89, F.lit(0.1)), (83, F.lit(20.0)), (101, F.lit(1.0)), default=1.0 + k / 50.0).alias("surge_multiplier"),
        first_of((97, -(v + 1.0)), (89, F.lit(0.01)), default=v).alias("final_price"),
        first_of((101, F.lit(0.95)), default=k / 100.0).alias("demand_level"),
        first_of((101, F.lit(0.1)), default=(99 - k) / 100.0).alias("supply_level"),
        (0.5 + (i * 7 % 200) / 10.0).alias("distance_miles"),
        (3.0 + (i * 13 % 60)).cast("double").alias("duration_minutes"),
        F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.col("user_id") % 5 + 1).cast("int")).alias("region"),
        ((i % 97 == 0) | (i % 89 == 0) | (i % 83 == 0) | (i % 101 == 0)).alias("label_is_anomaly"),
        first_of(
            (97, F.lit("negative_price")), (89, F.lit("flash_crash")), (83, F.lit("runaway_surge")), (101, F.lit("demand_supply_mismatch"))
        ).alias("label_type"),
    )


def trip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips (``TRIPS`` schema) with their event id."""
    i = F.col("event_id")
    return _raw(spark, sf_dir).select(
        "event_id",
        F.col("ts").alias("tpep_pickup_datetime"),
        (F.col("ts") + F.make_dt_interval(mins=(i * 13 % 320).cast("int"))).alias("tpep_dropoff_datetime"),
        F.round(F.pow((i * 7 % 1050) / 100.0, F.lit(3)) / 11, 2).alias("trip_distance"),
        F.round(F.col("value") * 1.2 - 5, 2).alias("total_amount"),
        (1 + i % 263).cast("int").alias("PULocationID"),
    )
