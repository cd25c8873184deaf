"""Statistical detector: per-category baselines, four tests and a batch-normalised score."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TUNED, Settings
from ..functions.clean import clip, true
from .quantiles import percentiles
from .ranks import ranked
from .small import held, hinted

UNIT = 4096


def category_stats(events: DataFrame, surge_tails: bool = True) -> DataFrame:
    """One row per category; the MAD is a percentile of the distances from the medians.  ``surge_tails``: with surge_p95 and surge_p99."""
    p, s = F.col("final_price"), F.col("surge_multiplier")
    moments = {
        "price_mean": F.avg(p), "price_std": F.stddev_samp(p), "surge_mean": F.avg(s), "surge_std": F.stddev_samp(s), "n": F.count(F.lit(1)),
    }
    wanted = {"final_price": [0.25, 0.5, 0.75]} | ({"surge_multiplier": [0.95, 0.99]} if surge_tails else {})
    cuts = held(percentiles(events.select("category", "final_price", "surge_multiplier").filter("category is not null"), wanted, ["category"], moments))
    rows = cuts.agg(F.sum("n")).first()[0] or 0
    medians = cuts.select(F.col("category").alias("c"), F.col("final_price")[1].alias("m"))
    gaps = events.join(hinted(cuts, medians), F.col("category") == F.col("c")).select("c", F.abs(p - F.col("m")).alias("price_mad"))
    mad = percentiles(gaps, {"price_mad": [0.5]}, ["c"], n=rows).select(F.col("c").alias("mc"), F.col("price_mad")[0].alias("price_mad"))
    q, t = F.col("final_price"), F.col("surge_multiplier")
    tails = [t[0].alias("surge_p95"), t[1].alias("surge_p99")] if surge_tails else []
    found = cuts.join(mad, F.col("category") == F.col("mc")).select(
        "category", "price_mean", "price_std", q[1].alias("price_median"), "price_mad",
        q[0].alias("price_q1"), q[2].alias("price_q3"), (q[2] - q[0]).alias("price_iqr"), "surge_mean", "surge_std", *tails, "n",
    )
    return held(found)


def _spread(c: Column) -> Column:
    """A spread floored at 0.01; 1 where it is unknown."""
    return F.when(c.isNull(), 1.0).otherwise(F.greatest(c, F.lit(0.01)))


def with_stats(events: DataFrame, stats: DataFrame) -> DataFrame:
    """``events`` with raw deviations z, mad and iqr; an unseen category has mean 0 and spread 1.

    ``stats`` has one row per category; it is broadcast if it is known to be small.
    """
    names = ["price_mean", "price_std", "price_median", "price_mad", "price_q1", "price_q3", "price_iqr"]
    joined = events.join(hinted(stats, stats.select("category", *names)), "category", "left")
    p = F.col("final_price")
    zero = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in ("price_mean", "price_median", "price_q1", "price_q3")}
    iqr = F.coalesce(F.col("price_iqr"), F.lit(1.0))
    low, high = zero["price_q1"] - 2.0 * iqr, zero["price_q3"] + 2.0 * iqr
    width = F.greatest(iqr, F.lit(0.01))
    return joined.select(
        *[F.col(c) for c in events.columns],
        F.abs((p - zero["price_mean"]) / _spread(F.col("price_std"))).alias("z_dev"),
        F.abs(0.6745 * (p - zero["price_median"]) / _spread(F.col("price_mad"))).alias("mad_dev"),
        F.when(p < low, (low - p) / width).when(p > high, (p - high) / width).when(p.isNotNull(), 0.0).alias("iqr_dev"),
    )


def _deviation(by: list[str], order: list[str], settings: Settings) -> Column:
    """Largest deviation of a price from its running means, in running spreads; the frames share one exchange and sort."""
    p, found = F.col("final_price"), []
    for rows in settings.rolling_rows:
        frame = W.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)
        mean, std, n = F.avg(p).over(frame), F.stddev_samp(p).over(frame), F.count(p).over(frame)
        found.append(F.when(n >= 3, F.abs(p - mean) / F.when(std.isNotNull(), F.greatest(std, F.lit(0.01)))))
    return F.greatest(*found)


def rolling_deviations(events: DataFrame, settings: Settings = TUNED) -> DataFrame:
    """``events`` with roll_dev: the largest deviation from the category's last 10, 30 and 120 rows (null for under 10 rows).

    The unit of work is ``UNIT`` rows in a row of a category, by their places in (timestamp,
    event_id) order; a unit also gets the 119 rows before it.  So a task has so many rows however
    the rows are spread over days, minutes or categories.  Units are dealt to a stated number of
    partitions: by bytes they look small enough to be put together, but a row costs 160 updates.
    """
    halo = max(settings.rolling_rows) - 1
    placed = ranked(events, ["timestamp", "event_id"], ["category"], "__place", total="__total", write=False)
    unit = F.floor(F.col("__place") / UNIT)
    serves = F.when(F.col("__place") % UNIT >= UNIT - halo, F.array(unit, unit + 1)).otherwise(F.array(unit))
    spread = placed.withColumn("__unit", F.explode(serves))
    spread = spread.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "category", "__unit")
    found = spread.withColumn("roll_dev", F.when(F.col("__total") >= 10, _deviation(["category", "__unit"], ["__place"], settings)))
    return found.filter(F.col("__unit") == unit).select(*[F.col(f"`{c}`") for c in events.columns], "roll_dev")


def rolling_flags(events: DataFrame, settings: Settings = TUNED) -> DataFrame:
    """``events`` with stat_rolling: a price far from its category's running mean over the last 10, 30 or 120 rows."""
    return rolling_deviations(events, settings).withColumn("stat_rolling", true(F.col("roll_dev") > settings.zscore_threshold)).drop("roll_dev")


def rolling_flags_by_category(events: DataFrame, settings: Settings = TUNED) -> DataFrame:
    """The same flags with a category as the unit of work: for a few rows only."""
    enough = F.count(F.lit(1)).over(W.partitionBy("category")) >= 10
    return events.withColumn("stat_rolling", true(_deviation(["category"], ["timestamp", "event_id"], settings) > settings.zscore_threshold) & enough)


def batch_maxima(scored: DataFrame) -> DataFrame:
    """The one row of maxima that scores are divided by; a maximum of 0 or nothing counts as 1."""
    return scored.agg(*[F.coalesce(F.expr(f"nullif(max({c}), 0D)"), F.lit(1.0)).alias(f"{c}_max") for c in ("z_dev", "mad_dev", "iqr_dev")])


def score(events: DataFrame, stats: DataFrame, settings: Settings = TUNED, maxima: DataFrame | None = None) -> DataFrame:
    """``events`` with stat_zscore, stat_mad, stat_iqr, stat_rolling, stat_anomaly and stat_score.

    Scores are relative to the batch unless frozen ``maxima`` of an earlier batch are given.
    """
    raw = with_stats(rolling_flags(events, settings), stats)
    top = maxima if maxima is not None else batch_maxima(with_stats(events, stats))
    both = raw.crossJoin(F.broadcast(top))  # one row
    z = settings.zscore_threshold
    parts = [F.coalesce(w * F.col(c) / F.col(f"{c}_max"), F.lit(0.0)) for w, c in ((0.35, "z_dev"), (0.35, "mad_dev"), (0.20, "iqr_dev"))]
    total = parts[0] + parts[1] + parts[2] + 0.10 * F.col("stat_rolling").cast("double")
    flagged = both.select(
        *[F.col(c) for c in events.columns],
        true(F.col("z_dev") > z).alias("stat_zscore"),
        true(F.col("mad_dev") > z).alias("stat_mad"),
        true(F.col("iqr_dev") > 0).alias("stat_iqr"),
        "stat_rolling",
        clip(total, 0.0, 1.0).alias("stat_score"),
    )
    return flagged.withColumn("stat_anomaly", F.col("stat_zscore") | F.col("stat_mad") | F.col("stat_iqr") | F.col("stat_rolling"))
