"""The batch pipeline: ingest, fit, detect, alert, store, evaluate."""

import datetime as dt
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TUNED, Settings
from ..functions.clean import ingest
from ..operators import alerts, evaluate, reports, rules
from ..operators.ensemble import EnsembleDetector
from ..operators.forecast import Forecaster, without_forecast
from ..sources.experiments import ExperimentTracker
from ..sources.generator import generate
from ..sources.schemas import EVENTS
from ..sources.scratch import written
from ..sources.store import PricingStore
from ..sources.trips import sample_rows


def detect(events: DataFrame, settings: Settings = TUNED, use_forest: bool = True, use_forecast: bool = False) -> DataFrame:
    """All detectors fitted on the first four fifths and applied to all rows: one wide table."""
    split = evaluate.train_test(events)
    train = split.filter("split = 'train'").drop("split")
    scored = EnsembleDetector(settings, use_forest).fit(train).predict(split)
    scored = rules.validate(scored, settings.rules)
    return Forecaster(settings.interval_width).fit(train).predict(scored) if use_forecast else without_forecast(scored)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from CSV (fixed schema) or Parquet."""
    return ingest(spark.read.csv(path, schema=EVENTS, header=True) if path.endswith(".csv") else spark.read.parquet(path))


class AnomalyPipeline:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings = TUNED):
        self.spark, self.settings = spark, settings
        self.store = PricingStore(spark, f"{folder}/store")
        self.tracker = ExperimentTracker(spark, f"{folder}/experiments")

    def run(self, events: DataFrame | None = None, end_date: dt.datetime | None = None, use_forecast: bool = False, use_forest: bool = True, sample_size: int | None = None) -> dict:
        """Run on given events, or generate up to ``end_date``; returns counts, severities and metrics."""
        began = time.time()
        methods = ["isolation_forest", "statistical", "contextual", "business_rules"] + ["time_series"] * use_forecast
        run_id = self.store.start_detection_run(methods)
        try:
            if events is None:
                if end_date is None:
                    raise ValueError("give events or an end_date")
                events, truth = generate(self.spark, end_date, settings=self.settings)
                self.store.load_ground_truth(truth)
            self.store.load_pricing_data(ingest(events))
            stored = self.store.table("pricing_events")
            if sample_size is not None:
                stored = sample_rows(stored, sample_size, self.settings.seed)
            scored = written(detect(stored, self.settings, use_forest, use_forecast), "scored")
            found = alerts.classify(scored)
            self.store.clear_detected_anomalies()
            total = self.store.save_detected_anomalies(alerts.alert_records(found))
            severities = {r["severity"]: r["count"] for r in reports.severity_counts(found).collect()}
            counts = scored.agg(
                F.count(F.lit(1)).alias("events"), F.count_if("is_anomaly").alias("ensemble"), F.count_if("rule_anomaly").alias("rules"),
                F.count_if("ts_anomaly").alias("forecast"), F.count_if(F.col("label_is_anomaly") & (F.col("split") == "test")).alias("labels"),
            ).first()
            metrics = {}
            if counts["labels"]:
                for r in evaluate.prf_by_method(scored.filter("split = 'test'")).collect():
                    metrics[r["method"]] = {k: float(r[k]) for k in ("precision", "recall", "f1")}
                    self.store.save_model_performance(run_id, r["method"], r["precision"], r["recall"], r["f1"])
            self.store.complete_detection_run(run_id, counts["events"], total)
        except Exception as e:
            self.store.complete_detection_run(run_id, status="failed", error=str(e)[:500])
            raise
        took = time.time() - began
        params = {k: v for k, v in asdict(self.settings).items() if isinstance(v, (int, float))}
        self.tracker.log_pipeline_run(metrics, params, {"total_events": counts["events"]}, took)
        return {
            "run_id": run_id, "total_events": counts["events"], "total_anomalies_detected": total, "ensemble_anomalies": counts["ensemble"], "rule_violations": counts["rules"],
            "ts_anomalies": counts["forecast"], "severity_distribution": severities, "evaluation": metrics, "pipeline_duration_seconds": round(took, 2),
        }


def main(args: list[str] | None = None) -> dict:
    """Command line: --folder F [--events PATH] [--end-date D] [--forecast] [--sample N] [--config PATH]."""
    import argparse

    from ..sources.settings import load_settings

    p = argparse.ArgumentParser()
    p.add_argument("--folder", required=True)
    p.add_argument("--events")
    p.add_argument("--end-date", type=dt.datetime.fromisoformat)
    p.add_argument("--forecast", action="store_true")
    p.add_argument("--sample", type=int)
    p.add_argument("--config")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    events = read_events(spark, a.events) if a.events else None
    return AnomalyPipeline(spark, a.folder, load_settings(a.config, TUNED)).run(events, a.end_date, a.forecast, sample_size=a.sample)


if __name__ == "__main__":
    print(main())
