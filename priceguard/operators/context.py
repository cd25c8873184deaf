"""Contextual detector: baselines by category, four-hour block and weekend."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TUNED, Settings
from ..functions.clean import clip, true
from ..functions.features import is_weekend
from .quantiles import percentiles
from .small import held, hinted

KEYS = ["category", "hour_block", "is_weekend"]


def with_context(events: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    return events.withColumn("hour_block", F.floor(F.hour(ts) / 4).cast("int")).withColumn("is_weekend", is_weekend(ts))


def baselines(events: DataFrame) -> DataFrame:
    """One row per context."""
    p, s = F.col("final_price"), F.col("surge_multiplier")
    return held(with_context(events).groupBy(*KEYS).agg(
        F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), F.avg(s).alias("surge_mean"), F.stddev_samp(s).alias("surge_std"), F.count(F.lit(1)).alias("n"),
    ))


def baselines_with_medians(events: DataFrame) -> DataFrame:
    """The same with each context's median price."""
    medians = percentiles(with_context(events), {"final_price": [0.5]}, KEYS).select(*[F.col(k).alias(f"m_{k}") for k in KEYS], F.col("final_price")[0].alias("median"))
    same = F.lit(True)
    for k in KEYS:
        same &= F.col(k).eqNullSafe(F.col(f"m_{k}"))
    return baselines(events).join(medians, same).drop(*[f"m_{k}" for k in KEYS])


def score(events: DataFrame, base: DataFrame, settings: Settings = TUNED) -> DataFrame:
    """``events`` with ctx_anomaly and ctx_score; contexts of fewer than five rows have no baseline.

    At most 12 contexts exist per category; the baselines are broadcast if they are known to be few.
    """
    n_std = settings.context_deviation
    used = base.filter(F.col("n") >= settings.context_min_count).select(
        *KEYS, F.col("mean").alias("b_mean"), F.greatest("std", F.lit(0.01)).alias("b_std"),
        F.col("surge_mean").alias("b_smean"), F.greatest("surge_std", F.lit(0.01)).alias("b_sstd"),
    )
    joined = with_context(events).join(hinted(base, used), KEYS, "left")
    price = F.abs(F.col("final_price") - F.col("b_mean")) / F.col("b_std")
    surge = F.abs(F.col("surge_multiplier") - F.col("b_smean")) / F.col("b_sstd")
    total = F.coalesce(0.6 * price / (2 * n_std), F.lit(0.0)) + F.coalesce(0.4 * surge / (2 * n_std), F.lit(0.0))
    return joined.select(
        *[F.col(c) for c in events.columns],
        (true(price > n_std) | true(surge > n_std + 1)).alias("ctx_anomaly"),
        F.when(F.col("b_mean").isNotNull(), clip(total, 0.0, 1.0)).otherwise(0.0).alias("ctx_score"),
    )
