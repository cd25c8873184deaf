"""Ensemble of forest, statistical and contextual detectors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TUNED, Settings
from ..functions.clean import clip
from . import context, forest, stats


def severity(score: Column) -> Column:
    """Ensemble scale."""
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.5, "medium").when(score >= 0.3, "low").otherwise("none")


def fuse(scored: DataFrame, settings: Settings = TUNED) -> DataFrame:
    """Adds anomaly_score, n_methods_flagged, is_anomaly, ensemble_severity and detection_methods.

    Detectors whose columns are absent (the forest, in a pure SQL run) count as silent.
    """
    have = set(scored.columns)
    names = [("isolation_forest", "if", settings.forest_weight), ("statistical", "stat", settings.stat_weight), ("contextual", "ctx", settings.context_weight)]
    on = [(n, F.col(f"{p}_anomaly"), F.col(f"{p}_score"), w) for n, p, w in names if f"{p}_score" in have]
    total, count = F.lit(0.0), F.lit(0)
    for _, flag, sc, w in on:
        total, count = total + w * sc, count + flag.cast("int")
    methods = F.concat_ws(",", *[F.when(flag, F.lit(n)) for n, flag, _, _ in on])
    out = scored.withColumn("anomaly_score", clip(total, 0.0, 1.0)).withColumn("n_methods_flagged", count)
    return out.select(
        "*",
        ((F.col("anomaly_score") > settings.ensemble_threshold) | (F.col("n_methods_flagged") >= 2)).alias("is_anomaly"),
        severity(F.col("anomaly_score")).alias("ensemble_severity"),
        F.when(methods == "", "none").otherwise(methods).alias("detection_methods"),
    )


class EnsembleDetector:
    """Fit on training events, predict on any batch; the forest is optional."""

    def __init__(self, settings: Settings = TUNED, use_forest: bool = True):
        self.settings, self.use_forest = settings, use_forest
        self.stats = self.base = self.forest = None

    def fit(self, events: DataFrame) -> "EnsembleDetector":
        self.stats, self.base = stats.category_stats(events, surge_tails=False), context.baselines(events)
        if self.use_forest:
            s = self.settings
            self.forest = forest.IsolationForest(s.contamination, s.trees, s.seed).fit(events)
        return self

    def predict(self, events: DataFrame) -> DataFrame:
        if self.stats is None:
            raise RuntimeError("the detector is not fitted")
        out = context.score(stats.score(events, self.stats, self.settings), self.base, self.settings)
        if self.forest is not None:
            out = out.join(self.forest.predict(events).select("event_id", "if_anomaly", "if_score"), "event_id")
        return fuse(out, self.settings)
