"""The fifteen engineered features as column expressions."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import at_least

FEATURES = [
    "surge_multiplier", "price_to_base_ratio", "price_per_mile", "price_per_minute", "demand_supply_gap",
    "demand_supply_ratio", "surge_demand_ratio", "hour_sin", "hour_cos", "is_rush_hour", "is_late_night",
    "is_weekend", "final_price", "log_price", "speed_implied",
]
TIMED = {"hour_sin", "hour_cos", "is_rush_hour", "is_late_night", "is_weekend"}


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def feature_columns(timestamp: bool = True) -> dict[str, Column]:
    """Name to expression; the time features need a ``timestamp`` column."""
    c, hour = F.col, F.hour("timestamp")
    angle = hour * (2 * math.pi / 24)
    found = {
        "surge_multiplier": c("surge_multiplier"),
        "price_to_base_ratio": c("final_price") / at_least(c("base_price"), 0.01),
        "price_per_mile": c("final_price") / at_least(c("distance_miles"), 0.1),
        "price_per_minute": c("final_price") / at_least(c("duration_minutes"), 1.0),
        "demand_supply_gap": c("demand_level") - c("supply_level"),
        "demand_supply_ratio": c("demand_level") / at_least(c("supply_level"), 0.01),
        "surge_demand_ratio": c("surge_multiplier") / at_least(c("demand_level"), 0.01),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "is_rush_hour": (hour.between(7, 9) | hour.between(17, 19)).cast("int"),
        "is_late_night": (hour <= 5).cast("int"),
        "is_weekend": is_weekend(c("timestamp")),
        "final_price": c("final_price"),
        "log_price": F.log1p(at_least(c("final_price"), 0.0)),
        "speed_implied": c("distance_miles") / (at_least(c("duration_minutes"), 1.0) / 60),
    }
    return {n: e for n, e in found.items() if timestamp or n not in TIMED}


def engineer_features(events: DataFrame, keep=("event_id",)) -> DataFrame:
    """``keep`` and the features as doubles; null, NaN and infinite values become 0."""
    columns = []
    for name, e in feature_columns("timestamp" in events.columns).items():
        e = e.cast("double")
        bad = e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
        columns.append(F.when(bad, F.lit(0.0)).otherwise(e).alias(name))
    return events.select(*keep, *columns)
