"""Forecast bands: hourly means per category, a trend with bends and two seasons, fitted by ridge."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clip, true
from ..sources.scratch import written
from .quantiles import percentiles

MIN_HOURS = 48
KNOTS = 25
BANDS = "category, hour, ts_expected, ts_lower, ts_upper, trend, daily, weekly"


def hourly_prices(events: DataFrame) -> DataFrame:
    """category, hour, mean, std, n of the hours that have events."""
    p = F.col("final_price")
    return events.groupBy("category", F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz").alias("hour")).agg(
        F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), F.count(F.lit(1)).alias("n")
    )


def trimmed(hourly: DataFrame) -> DataFrame:
    """Hours whose mean lies strictly within three standard deviations of the category's."""
    ends = hourly.groupBy("category").agg(F.avg("mean").alias("m"), F.stddev_samp("mean").alias("s"), F.count(F.lit(1)).alias("hours"))
    return (
        hourly.join(ends, "category")
        .filter((F.col("hours") >= MIN_HOURS) & (F.col("mean") > F.col("m") - 3 * F.col("s")) & (F.col("mean") < F.col("m") + 3 * F.col("s")))
        .drop("m", "s", "hours")
    )


def design(hours: np.ndarray, start: float, end: float):
    """Trend, daily and weekly columns for hours since the epoch."""
    t = (hours - start) / max(end - start, 1.0)
    knots = np.linspace(0, 0.8, KNOTS + 1)[1:]
    trend = np.column_stack([np.ones_like(t), t, *(np.maximum(t - k, 0) for k in knots)])
    waves = lambda period, order: np.column_stack([f(2 * np.pi * j * hours / period) for j in range(1, order + 1) for f in (np.sin, np.cos)])
    return trend, waves(24.0, 4), waves(168.0, 3)


PENALTY = np.concatenate([[1e-6, 1e-6], np.full(KNOTS, 20.0), np.full(14, 0.1)])  # of intercept and slope, bends, waves
SIZE = len(PENALTY)


def _hours(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[s]").astype(np.int64) / 3600.0


def _outer_products(frames):
    """X'X and X'y of the rows of a task, by category, as one array each."""
    for f in frames:
        for (category, start, end), g in f.groupby(["s_category", "start", "end"], dropna=False):
            x = np.column_stack(design(_hours(g["hour"]), start, end))
            both = np.concatenate([(x.T @ x).ravel(), x.T @ g["mean"].to_numpy(float)])
            yield pd.DataFrame({"s_category": [category], "start": [start], "end": [end], "sums": [both]})


def _solved(frames):
    for f in frames:
        for category, start, end, sums in f.itertuples(index=False):
            sums = np.asarray(sums, float)
            beta = np.linalg.solve(sums[: SIZE * SIZE].reshape(SIZE, SIZE) + np.diag(PENALTY), sums[SIZE * SIZE :])
            yield pd.DataFrame({"s_category": [category], "start": [start], "end": [end], "beta": [beta]})


def _evaluated(frames):
    """Rows with a model's columns beside them: the trend and the seasons at their hours."""
    for f in frames:
        out = []
        for _, g in f.groupby("s_category", dropna=False):
            parts = design(_hours(g["hour"]), g["start"].iloc[0], g["end"].iloc[0])
            cut = np.cumsum([p.shape[1] for p in parts])
            pieces = [p @ b for p, b in zip(parts, np.split(np.asarray(g["beta"].iloc[0], float), cut[:-1]), strict=True)]
            out.append(g.drop(columns=["start", "end", "beta"]).assign(**dict(zip(("trend", "daily", "weekly"), pieces, strict=True))))
        if out:
            yield pd.concat(out)


class Forecaster:
    """A ridge per category from sums of outer products, and a band that holds a share of its residuals.

    The hours of all categories are read as they lie; a task sends one array of sums for each
    category it meets, the sums are added up place by place, and each category's system is solved
    from its row.  The band comes from exact percentiles of the residuals.  No task needs all hours
    of a category.
    """

    def __init__(self, interval_width: float = 0.95):
        self.width = interval_width
        self.series: DataFrame | None = None
        self.models: DataFrame | None = None

    def fit(self, events: DataFrame) -> "Forecaster":
        self.series = written(trimmed(hourly_prices(events)), "series")
        seconds = F.unix_seconds(F.col("hour").cast("timestamp")) / 3600.0
        ends = self.series.groupBy(F.col("category").alias("s_category")).agg(F.min(seconds).alias("start"), F.max(seconds).alias("end"))
        rows = self.series.join(ends, F.col("category") == F.col("s_category")).select("s_category", "start", "end", "hour", "mean")
        partial = rows.mapInPandas(_outer_products, "s_category string, start double, end double, sums array<double>")
        summed = partial.select("s_category", "start", "end", F.posexplode("sums").alias("place", "v")).groupBy("s_category", "start", "end", "place").agg(F.sum("v").alias("v"))
        lists = summed.groupBy("s_category", "start", "end").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("s"))  # a place for each sum
        systems = lists.select("s_category", "start", "end", F.transform("s", lambda x: x["v"]).alias("sums"))
        models = written(systems.mapInPandas(_solved, "s_category string, start double, end double, beta array<double>"), "models")
        fitted = self._at(self.series.select("category", "hour", "mean"), models)
        residuals = fitted.select("category", (F.col("mean") - F.col("trend") - F.col("daily") - F.col("weekly")).alias("r"))
        share = (1 - self.width) / 2
        ranges = percentiles(residuals, {"r": [share, 1 - share]}, ["category"])
        self.models = models.join(ranges.select(F.col("category").alias("r_category"), F.col("r")[0].alias("low"), F.col("r")[1].alias("high")), F.col("s_category") == F.col("r_category")).drop("r_category")
        return self

    @staticmethod
    def _at(rows: DataFrame, models: DataFrame) -> DataFrame:
        """``rows`` (category, hour, others) of modelled categories with trend, daily and weekly."""
        joined = rows.join(models, F.col("category") == F.col("s_category"))
        left = [c for c in joined.columns if c not in ("start", "end", "beta")]
        schema = joined.select(*left, *[F.lit(0.0).alias(c) for c in ("trend", "daily", "weekly")]).schema
        return joined.select(*left, "start", "end", "beta").mapInPandas(_evaluated, schema).drop("s_category")

    def bands(self, wanted: DataFrame) -> DataFrame:
        """``BANDS`` for the wanted (category, hour); categories without a model give no rows."""
        if self.models is None:
            raise RuntimeError("the forecaster is not fitted")
        found = self._at(wanted.select("category", "hour").distinct(), self.models)
        expected = F.col("trend") + F.col("daily") + F.col("weekly")
        return found.select("category", "hour", expected.alias("ts_expected"), (expected + F.col("low")).alias("ts_lower"), (expected + F.col("high")).alias("ts_upper"), "trend", "daily", "weekly")

    def predict(self, events: DataFrame) -> DataFrame:
        """``events`` with ts_anomaly, ts_score, ts_expected, ts_lower, ts_upper (defaults for unmodelled categories)."""
        hour = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz")
        keyed = events.withColumn("hour", hour)
        bands = self.bands(keyed).select("category", "hour", "ts_expected", "ts_lower", "ts_upper")
        joined = keyed.join(bands, ["category", "hour"], "left")
        p, low, high = F.col("final_price"), F.col("ts_lower"), F.col("ts_upper")
        excess = F.greatest(low - p, p - high, F.lit(0.0))
        score = clip(excess / F.when(high - low > 0, high - low).otherwise(1.0), 0.0, 1.0)
        out = true((p < low) | (p > high))
        return joined.select(
            *[F.col(c) for c in events.columns], out.alias("ts_anomaly"), F.when(out, score).otherwise(0.0).alias("ts_score"), "ts_expected", "ts_lower", "ts_upper"
        )

    def forecast(self, category: str, periods: int = 24) -> DataFrame:
        """Bands of the ``periods`` hours after the category's last one, with components."""
        if self.series is None:
            raise RuntimeError("the forecaster is not fitted")
        last = self.series.filter(F.col("category") == category).groupBy("category").agg(F.max("hour").alias("last"))
        step = F.make_dt_interval(hours=F.lit(1))
        future = last.select("category", F.explode(F.sequence(F.col("last") + step, F.col("last") + F.make_dt_interval(hours=F.lit(periods)), step)).alias("hour"))
        return self.bands(future)

    def components(self, category: str) -> DataFrame:
        """Trend and seasons over the fitted hours of a category."""
        return self.bands(self.series.filter(F.col("category") == category))


def without_forecast(events: DataFrame) -> DataFrame:
    """The columns of ``predict`` where no forecast is wanted."""
    null = F.lit(None).cast("double")
    return events.select("*", F.lit(False).alias("ts_anomaly"), F.lit(0.0).alias("ts_score"), null.alias("ts_expected"), null.alias("ts_lower"), null.alias("ts_upper"))
