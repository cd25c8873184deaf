"""Incremental rollups: partial aggregates by day, hour and category, kept as files and merged when read.

Every micro-batch writes the partial sums of its own rows below the days they belong to, so a
late row adds to its day without any recount, and a replayed micro-batch overwrites its own
files.  A reader takes the days of its range alone; ``compact`` merges the partial rows of days
that have gathered many.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import hour_text
from ..sources.scratch import deleted

KEYS = ["day", "hour", "category"]
SUMS = {"price": "final_price", "surge": "surge_multiplier", "demand": "demand_level", "supply": "supply_level"}
SCHEMA = "hour timestamp_ntz, category string, events long, anomalies long, violations long, low double, high double" + "".join(f", {n}_sum double, {n}_count long" for n in SUMS)


def partial_sums(events: DataFrame) -> DataFrame:
    """Partial aggregates of some events; ``rule_anomaly`` is counted where there is such a column."""
    violated = F.count_if("rule_anomaly") if "rule_anomaly" in events.columns else F.lit(0).cast("long")
    sums = [a for n, c in SUMS.items() for a in (F.sum(c).alias(f"{n}_sum"), F.count(c).alias(f"{n}_count"))]
    hour = F.date_trunc("hour", F.col("timestamp").cast("timestamp_ntz")).cast("timestamp_ntz")
    return events.groupBy(F.to_date("timestamp").alias("day"), hour.alias("hour"), "category").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("label_is_anomaly").alias("anomalies"), violated.alias("violations"), F.min("final_price").alias("low"), F.max("final_price").alias("high"), *sums,
    )


def merged(partial: DataFrame) -> DataFrame:
    sums = [F.sum(f"{n}_{k}").alias(f"{n}_{k}") for n in SUMS for k in ("sum", "count")]
    return partial.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("events", "anomalies", "violations")], F.min("low").alias("low"), F.max("high").alias("high"), *sums)


class Rollups:
    """The rollups below a folder: ``batch=N/day=D`` files of partial rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, events: DataFrame, batch: int) -> None:
        """Add the events of a batch; the same number again replaces what it has added."""
        partial_sums(events).write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/batch={batch}")

    def start(self, events: DataFrame):
        """A query over what there is of a stream, started."""
        return events.writeStream.foreachBatch(self.append).option("checkpointLocation", f"{self.folder}-checkpoint").trigger(availableNow=True).start()

    def read(self, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """The merged rows of a closed range of days, whose files alone are read."""
        out = self.spark.read.schema(f"{SCHEMA}, batch long, day date").option("basePath", self.folder).parquet(self.folder)
        if first_day is not None:
            out = out.filter(F.col("day") >= F.lit(first_day).cast("date"))
        if last_day is not None:
            out = out.filter(F.col("day") <= F.lit(last_day).cast("date"))
        return merged(out)

    def compact(self) -> None:
        """All partial rows as one batch, numbered below the others'; batches that came meanwhile stay."""
        seen = [r["batch"] for r in self.spark.read.schema(f"{SCHEMA}, batch long, day date").option("basePath", self.folder).parquet(self.folder).select("batch").distinct().collect()]
        part = self.spark.read.schema(f"{SCHEMA}, batch long, day date").option("basePath", self.folder).parquet(*[f"{self.folder}/batch={b}" for b in seen])
        merged(part).write.partitionBy("day").parquet(f"{self.folder}/batch={min([0, *seen]) - 1}")
        for b in seen:
            deleted(self.spark, f"{self.folder}/batch={b}")


def hourly_stats(rows: DataFrame) -> DataFrame:
    """The dashboard's hourly statistics from merged rows."""
    mean = lambda n: F.round(F.col(f"{n}_sum") / F.col(f"{n}_count"), 6).alias(f"avg_{n}")
    return rows.select(
        hour_text("hour").alias("hour"), "category", F.col("events").alias("event_count"), mean("price"), F.col("low").alias("min_price"), F.col("high").alias("max_price"),
        mean("surge"), mean("demand"), mean("supply"), F.col("anomalies").alias("anomaly_count"),
    )
