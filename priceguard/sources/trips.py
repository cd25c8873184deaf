"""Taxi trip records as pricing events."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TRIPS

# Pickup zones, as half-open ranges.
AIRPORT_ZONES = [(1, 2), (132, 133), (138, 139)]
DOWNTOWN_ZONES = [
    (4, 13), (42, 44), (48, 50), (68, 75), (79, 88), (90, 100), (107, 114), (125, 131),
    (137, 138), (140, 170), (186, 195), (202, 210), (224, 234), (236, 244), (246, 250), (261, 264),
]
INJECTED = ["flash_crash", "runaway_surge", "negative_price", "surge_stuck_high", "gradual_drift"]


def read_trips(spark: SparkSession, path: str, max_rows: int | None = 200_000, seed: int = 42) -> DataFrame:
    """Trips from Parquet, or from CSV with the fixed schema; a hash-chosen sample of ``max_rows``."""
    raw = spark.read.csv(path, schema=TRIPS, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    return raw if max_rows is None else sample_rows(raw, max_rows, seed)


def sample_rows(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones for the same rows and seed."""
    return rows.orderBy(F.xxhash64(*rows.columns, F.lit(seed))).limit(n)


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the row's key and the seed."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def normal(key: Column, seed: int) -> Column:
    """Standard normal from two hashed uniforms."""
    u = F.greatest(uniform(key, seed), F.lit(1e-12))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * uniform(key, seed + 1))


def _within(zone: Column, ranges) -> Column:
    hit = F.lit(False)
    for low, high in ranges:
        hit = hit | ((zone >= low) & (zone < high))
    return hit


def transform(trips: DataFrame, noise_seed: int | None = 42) -> DataFrame:
    """Pricing events of the valid trips.

    Demand is the pickup hour's share of the busiest hour, over all trips before the validity
    filter; without ``noise_seed`` supply has no noise.  Needs an ``event_id``, which is kept.
    """
    ts, miles, price = F.col("timestamp"), F.col("distance_miles"), F.col("final_price")
    base = trips.select(
        "event_id", F.col("tpep_pickup_datetime").alias("timestamp"),
        (F.timestamp_diff("SECOND", F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime")) / 60.0).alias("duration_minutes"),
        F.col("trip_distance").cast("double").alias("distance_miles"), F.col("total_amount").cast("double").alias("final_price"),
        (F.col("PULocationID") if "PULocationID" in trips.columns else F.lit(None).cast("int")).alias("zone"),
    )
    hours = base.filter(ts.isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))  # 24 rows
    busiest = hours.agg(F.max("n").alias("top"))
    rate = hours.crossJoin(busiest).select("hour", F.greatest(F.col("n") / F.col("top"), F.lit(0.05)).alias("demand_level"))
    fare = 3.50 + miles * 2.50
    category = F.when(miles <= 2, "ride_short").when(miles <= 5, "ride_standard").when(miles <= 15, "ride_long").otherwise("ride_premium")
    region = F.when(F.col("zone").isNull(), "other").when(_within(F.col("zone"), DOWNTOWN_ZONES), "downtown").when(_within(F.col("zone"), AIRPORT_ZONES), "airport").otherwise("suburbs")
    valid = (F.col("duration_minutes") > 0.5) & (F.col("duration_minutes") < 300) & (miles > 0) & (miles < 100) & (price > 0) & (price < 500) & ts.isNotNull()
    noise = F.lit(0.0) if noise_seed is None else 0.1 * normal(F.col("event_id"), noise_seed)
    supply = F.least(F.greatest(1.0 - F.col("demand_level") * 0.6 + noise, F.lit(0.05)), F.lit(1.0))
    joined = base.filter(valid).withColumn("hour", F.hour(ts)).join(F.broadcast(rate), "hour")
    return joined.select(
        "event_id", "timestamp", category.alias("category"), fare.alias("base_price"), F.when(fare > 0.5, price / fare).otherwise(1.0).alias("surge_multiplier"),
        "final_price", "demand_level", supply.alias("supply_level"), "distance_miles", "duration_minutes", region.alias("region"),
        F.lit(False).alias("label_is_anomaly"), F.lit(None).cast("string").alias("label_type"),
    )


def label_natural(events: DataFrame) -> DataFrame:
    """Labels of records that are odd by themselves; later rules win, so the chain is in reverse.

    ``short_distance_high_price`` never survives: such a trip also has an extreme surge.
    """
    kind = (
        F.when(F.col("surge_multiplier") > 5, "extreme_surge")
        .when(F.col("distance_miles") > 50, "extreme_distance")
        .when((F.col("distance_miles") < 0.5) & (F.col("final_price") > 50), "short_distance_high_price")
        .when(F.col("final_price") > 200, "extreme_price")
    )
    return events.withColumn("label_type", kind).withColumn("label_is_anomaly", F.col("label_type").isNotNull())


def inject(events: DataFrame, rate: float = 0.03, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Five kinds of faults in floor(rate * normal rows) hash-chosen normal rows; the events and a truth table."""
    normal_rows = events.filter(~F.col("label_is_anomaly"))
    n = int(normal_rows.count() * rate)
    chosen = normal_rows.orderBy(F.xxhash64("event_id", F.lit(seed)), "event_id").limit(n).select("event_id", F.lit(True).alias("chosen"))
    i, price, base = F.col("event_id"), F.col("final_price"), F.col("base_price")
    kinds = F.array(*[F.lit(k) for k in INJECTED])
    kind = F.when(F.col("chosen"), F.element_at(kinds, (F.floor(uniform(i, seed + 10) * 5) + 1).cast("int")))
    is_ = lambda k: F.col("kind") == k
    factor = 10 + 15 * uniform(i, seed + 11)
    new_price = (
        F.when(is_("flash_crash"), 0.01).when(is_("runaway_surge"), price * factor).when(is_("negative_price"), -F.abs(5 + 2 * normal(i, seed + 12)))
        .when(is_("surge_stuck_high"), base * 4.5).when(is_("gradual_drift"), price * (1.5 + uniform(i, seed + 14))).otherwise(price)
    )
    surge = F.col("surge_multiplier")
    new_surge = F.when(is_("flash_crash"), 0.001).when(is_("runaway_surge"), factor).when(is_("negative_price"), -0.5).when(is_("surge_stuck_high"), 4.5).otherwise(surge)
    marked = events.join(chosen, "event_id", "left").withColumn("kind", kind).withColumn("expected_price", price)
    changed = marked.withColumns({
        "surge_multiplier": new_surge, "final_price": new_price,
        "label_is_anomaly": F.col("label_is_anomaly") | F.col("kind").isNotNull(), "label_type": F.coalesce("kind", "label_type"),
    })
    text = F.concat(F.lit("Injected "), F.col("kind"), F.lit(" (original=$"), F.format_string("%.2f", "expected_price"), F.lit(")"))
    severity = F.when(F.col("kind").isin("flash_crash", "negative_price", "runaway_surge"), "critical").otherwise("high")
    truth = changed.filter(F.col("kind").isNotNull()).select(
        "event_id", "timestamp", "category", F.col("kind").alias("anomaly_type"), severity.alias("severity"), "expected_price", F.col("final_price").alias("actual_price"), text.alias("description")
    )
    return changed.select(*events.columns), truth


def load_and_transform(spark: SparkSession, path: str, max_rows: int | None = 200_000, inject_anomalies: bool = True, anomaly_rate: float = 0.03, seed: int = 42):
    """(events, truth) of a trip file; truth is null without injection."""
    raw = read_trips(spark, path, max_rows, seed)
    if "event_id" not in raw.columns:
        raw = raw.withColumn("event_id", F.xxhash64(*raw.columns))
    events = label_natural(transform(raw, seed))
    return inject(events, anomaly_rate, seed) if inject_anomalies else (events, None)
