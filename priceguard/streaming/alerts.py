"""Structured Streaming: stateless rules and frozen baselines per event, and hourly counts.

Baselines and maxima are frozen tables of an earlier batch, so an event's score does not depend
on the micro-batch it came in.  The rolling test, which needs earlier rows of a category, is in
``rolling``; sums that late rows may still change are in ``rollups``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TUNED, Settings
from ..functions.clean import clip, ingest, true
from ..operators import context, rules, stats
from ..sources.schemas import EVENTS


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS)
    reader = reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)
    return ingest(reader.parquet(folder))


def score_stream(events: DataFrame, category_stats: DataFrame, baselines: DataFrame, maxima: DataFrame, settings: Settings = TUNED) -> DataFrame:
    """Rules, three statistical tests and the context test for each event of a stream."""
    ruled = rules.validate(events, settings.rules)
    raw = stats.with_stats(ruled, category_stats).crossJoin(F.broadcast(maxima))
    z = settings.zscore_threshold
    parts = [F.coalesce(w * F.col(c) / F.col(f"{c}_max"), F.lit(0.0)) for w, c in ((0.35, "z_dev"), (0.35, "mad_dev"), (0.20, "iqr_dev"))]
    flagged = raw.select(
        *[F.col(c) for c in ruled.columns],
        (true(F.col("z_dev") > z) | true(F.col("mad_dev") > z) | true(F.col("iqr_dev") > 0)).alias("stat_anomaly"),
        clip(parts[0] + parts[1] + parts[2], 0.0, 1.0).alias("stat_score"),
    )
    return context.score(flagged, baselines, settings)


def hourly_counts(scored: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events and rule violations per hour and category; in append mode an hour comes once the watermark has passed it, and later rows are dropped."""
    timed = scored.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return (
        timed.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 hour").alias("w"), "category")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if("rule_anomaly").alias("violations"))
        .select(F.col("w.start").alias("hour"), "category", "events", "violations")
    )
