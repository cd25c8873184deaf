"""The store: five Parquet tables below one folder.

Loads replace a table, alerts and metrics append; a run is two appended rows whose later state
wins, so no row is ever updated in place.  Events are partitioned by day, and time ranges read
the days they touch.
"""

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from . import schemas
from .scratch import dropped, written

TABLES = {
    "pricing_events": schemas.EVENTS, "anomaly_ground_truth": schemas.TRUTH, "detected_anomalies": schemas.ALERTS,
    "detection_runs": schemas.RUNS, "model_performance": schemas.PERFORMANCE,
}


class PricingStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._kept: dict[str, tuple[float, DataFrame]] = {}
        for name, schema in TABLES.items():
            if not self._exists(name):
                spark.createDataFrame([], schema).write.parquet(self._path(name))

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        return self._read(name).select(*TABLES[name].names)

    def _read(self, name: str) -> DataFrame:
        schema = StructType([*TABLES[name], *([StructField("day", DateType())] if name == "pricing_events" else [])])
        return self.spark.read.schema(schema).parquet(self._path(name))

    def dashboard_table(self, name: str, seconds: float = 60.0) -> DataFrame:
        """A table that is kept in executor memory (and disk) and read anew once it is ``seconds`` old or this store has written it."""
        at, kept = self._kept.get(name, (0.0, None))
        if kept is None or time.monotonic() - at >= seconds:
            self._forget(name)
            kept = self.table(name).persist()
            self._kept[name] = (time.monotonic(), kept)
        return kept

    def _forget(self, name: str) -> None:
        _, kept = self._kept.pop(name, (0.0, None))
        if kept is not None:
            kept.unpersist()

    def _shaped(self, df: DataFrame, name: str) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]])

    def load_pricing_data(self, events: DataFrame) -> int:
        """Replace the events; returns their number."""
        shaped = self._shaped(events, "pricing_events").withColumn("day", F.to_date("timestamp"))
        self._forget("pricing_events")
        # a few files a day; days too large for a task are split
        shaped.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(self._path("pricing_events"))
        return self.table("pricing_events").count()

    def load_ground_truth(self, truth: DataFrame) -> int:
        self._forget("anomaly_ground_truth")
        self._shaped(truth, "anomaly_ground_truth").write.mode("overwrite").parquet(self._path("anomaly_ground_truth"))
        return self.table("anomaly_ground_truth").count()

    def save_detected_anomalies(self, alerts: DataFrame) -> int:
        """Append alerts, which are worked out once; none is no write."""
        found = written(self._shaped(alerts, "detected_anomalies"), "alerts")
        n = found.count()
        self._forget("detected_anomalies")
        if n:
            found.write.mode("append").parquet(self._path("detected_anomalies"))
        dropped(found)
        return n

    def clear_detected_anomalies(self) -> None:
        self._forget("detected_anomalies")
        self.spark.createDataFrame([], schemas.ALERTS).write.mode("overwrite").parquet(self._path("detected_anomalies"))

    def start_detection_run(self, methods: list[str], now: dt.datetime | None = None) -> int:
        """Append a running run; ids count up from 1 (one writer)."""
        last = self.table("detection_runs").agg(F.max("run_id")).first()[0] or 0
        self._append("detection_runs", [(last + 1, now or dt.datetime.now(), None, None, None, ",".join(methods), "running", None)])
        return last + 1

    def complete_detection_run(self, run_id: int, events: int = 0, anomalies: int = 0, status: str = "completed", error: str | None = None, now: dt.datetime | None = None) -> None:
        state = self.detection_runs().filter(F.col("run_id") == run_id).first()
        if state is None:
            raise KeyError(run_id)
        self._append("detection_runs", [(run_id, state["started_at"], now or dt.datetime.now(), events, anomalies, state["methods_used"], status, error)])

    def _append(self, name: str, rows: list[tuple]) -> None:
        self._forget(name)
        self.spark.createDataFrame(rows, TABLES[name]).coalesce(1).write.mode("append").parquet(self._path(name))

    def detection_runs(self) -> DataFrame:
        """The latest state of each run."""
        runs = self.table("detection_runs")
        latest = F.max_by(F.struct(*runs.columns), F.coalesce("completed_at", F.lit(dt.datetime(1, 1, 1)).cast("timestamp_ntz")))
        return runs.groupBy(F.col("run_id").alias("id")).agg(latest.alias("r")).select("r.*")

    def save_model_performance(self, run_id: int, method: str, precision: float, recall: float, f1: float, now: dt.datetime | None = None) -> None:
        self._append("model_performance", [(run_id, method, float(precision), float(recall), float(f1), now or dt.datetime.now())])

    def get_performance_history(self) -> DataFrame:
        return performance_history(self.table("model_performance"), self.detection_runs())

    def get_pricing_events(self, start: str | None = None, end: str | None = None, **filters) -> DataFrame:
        from ..operators.reports import events_between

        rows = self._read("pricing_events")
        if start is not None:
            rows = rows.filter(F.col("day") >= F.lit(start).cast("timestamp_ntz").cast("date"))
        if end is not None:
            rows = rows.filter(F.col("day") <= F.lit(end).cast("timestamp_ntz").cast("date"))
        return events_between(rows.select(*schemas.EVENTS.names), start, end, **filters)

    def get_detected_anomalies(self, **filters) -> DataFrame:
        from ..operators.reports import top_alerts

        return top_alerts(self.table("detected_anomalies"), **filters)

    def get_anomaly_summary(self) -> DataFrame:
        from ..operators.reports import anomaly_summary

        return anomaly_summary(self.table("detected_anomalies")).orderBy(F.col("count").desc())

    def get_hourly_stats(self) -> DataFrame:
        from ..operators.reports import hourly_stats

        return hourly_stats(self.table("pricing_events")).orderBy("hour")


def performance_history(performance: DataFrame, runs: DataFrame) -> DataFrame:
    """Metrics with their run, latest runs first."""
    return performance.join(runs.select("run_id", "started_at", "status"), "run_id").orderBy(F.col("started_at").desc(), "method")
