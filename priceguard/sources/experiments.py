"""Experiment log: one JSON object per line; blank and malformed lines are skipped."""

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECORD = (
    "experiment_id long, timestamp string, method string, params map<string,string>, metrics map<string,double>, "
    "data_info map<string,string>, notes string, duration_seconds double"
)


def parse(lines: DataFrame) -> DataFrame:
    """Records from a table of text lines (column ``value``); a line without an id or method is malformed."""
    record = F.from_json(F.trim("value"), RECORD, {"mode": "PERMISSIVE"})
    return lines.select(record.alias("r")).filter("r.experiment_id is not null and r.method is not null").select("r.*").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def flattened(records: DataFrame, params=(), metrics=(), info=()) -> DataFrame:
    """History, latest first, with the named map keys as param_, metric_ and data_ columns."""
    keys = [("params", "param", params), ("metrics", "metric", metrics), ("data_info", "data", info)]
    cells = [F.col(m)[k].alias(f"{p}_{k}") for m, p, ks in keys for k in ks]
    return records.select("experiment_id", "timestamp", "method", F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"), *cells).orderBy(F.col("timestamp").desc(), F.col("experiment_id").desc())


def metric(name: str) -> Column:
    return F.col("metrics")[name]


def best_by_metric(records: DataFrame, name: str = "f1", method: str | None = None) -> DataFrame:
    """At most one record: the largest metric, the latest among equals."""
    rows = records.filter(metric(name).isNotNull())
    rows = rows if method is None else rows.filter(F.col("method") == method)
    return rows.orderBy(metric(name).desc(), F.col("timestamp").desc(), "experiment_id").limit(1)


def latest_per_method(records: DataFrame) -> DataFrame:
    order = W.partitionBy("method").orderBy(F.col("timestamp").desc(), F.col("experiment_id").desc())
    return records.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def compare(records: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """The records with these ids, or the latest of each method."""
    return records.filter(F.col("experiment_id").isin(ids)) if ids else latest_per_method(records)


def best_per_setting(records: DataFrame, name: str = "f1") -> DataFrame:
    """The best record of each (method, parameters); absent parameters are equal to absent ones."""
    setting = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>"))))))
    order = W.partitionBy("method", setting).orderBy(metric(name).desc_nulls_last(), "experiment_id")
    return records.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def default_against_optimized(records: DataFrame) -> DataFrame:
    """base method, best F1 of plain and of ``optimized`` runs (0 where there is none)."""
    f1, tuned = metric("f1"), F.col("method").contains("optimized")
    base = F.trim(F.regexp_replace("method", r"_?\(?optimized\)?", ""))
    best = lambda c, n: F.coalesce(F.max(F.when(c, f1)), F.lit(0.0)).alias(n)
    return records.groupBy(base.alias("base_method")).agg(best(~tuned, "default_f1"), best(tuned, "optimized_f1"))


class ExperimentTracker:
    """A log folder of JSON files; one writer at a time, since ids count up from the largest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def records(self) -> DataFrame:
        path, fs = self._path()
        if not fs.exists(path):
            return self.spark.createDataFrame([], RECORD).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
        return parse(self.spark.read.text(self.folder))

    def log_experiment(self, method: str, params: dict, metrics: dict, data_info: dict | None = None, notes: str = "", duration_seconds: float = 0.0, now: dt.datetime | None = None) -> int:
        number = (self.records().agg(F.max("experiment_id")).first()[0] or 0) + 1
        record = {"experiment_id": number, "timestamp": (now or dt.datetime.now()).isoformat(), "method": method, "params": params, "metrics": metrics, "data_info": data_info or {}, "notes": notes, "duration_seconds": round(duration_seconds, 2)}
        self.spark.createDataFrame([(json.dumps(record, default=str),)], "value string").coalesce(1).write.mode("append").text(self.folder)
        return number

    def log_pipeline_run(self, evaluation: dict, params: dict, data_info: dict, duration_seconds: float) -> list[int]:
        """One record for each evaluated method."""
        methods = [m for m in ("ensemble", "business_rules", "combined") if m in evaluation]
        return [self.log_experiment(m, params, evaluation[m], data_info, "", duration_seconds) for m in methods]

    def load_history(self) -> DataFrame:
        """Flattened history; the columns are the keys that occur (a small distinct list)."""
        records = self.records()
        names = lambda c: sorted(r[0] for r in records.select(F.explode(F.map_keys(c))).distinct().collect())
        return flattened(records, names("params"), names("metrics"), names("data_info"))

    def get_best_by_metric(self, name: str = "f1", method: str | None = None) -> dict | None:
        row = best_by_metric(self.records(), name, method).first()
        return None if row is None else row.asDict(recursive=True)

    def compare_experiments(self, ids: list[int] | None = None) -> DataFrame:
        return compare(self.records(), ids)

    def clear(self) -> None:
        path, fs = self._path()
        fs.delete(path, True)

    def clean(self) -> tuple[int, int]:
        """Keep the best run of each setting, with the old log beside it as a backup; rows before and after."""
        records = self.records()
        before, kept = records.count(), best_per_setting(records)
        lines = [r[0] for r in kept.select(F.to_json(F.struct(*kept.columns))).collect()]  # a log of runs, on one writer
        if len(lines) < before:
            path, fs = self._path()
            backup = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder + ".backup")
            fs.delete(backup, True)
            fs.rename(path, backup)
            self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(self.folder)
        return before, len(lines)
