"""Exploratory statistics."""


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import at_least
from .quantiles import percentiles
from .ranks import ranked

CORRELATED = [
    "final_price", "surge_multiplier", "demand_level", "supply_level", "price_to_base_ratio",
    "price_per_mile", "demand_supply_gap", "surge_demand_ratio", "distance_miles", "duration_minutes",
]


def with_ratios(events: DataFrame) -> DataFrame:
    c = F.col
    return events.select(
        "*", (c("final_price") / at_least(c("base_price"), 0.01)).alias("price_to_base_ratio"), (c("final_price") / at_least(c("distance_miles"), 0.1)).alias("price_per_mile"),
        (c("demand_level") - c("supply_level")).alias("demand_supply_gap"), (c("surge_multiplier") / at_least(c("demand_level"), 0.01)).alias("surge_demand_ratio"),
    )


def describe_by(events: DataFrame, by: str, column: str = "final_price") -> DataFrame:
    v = F.col(column)
    q = percentiles(events, {column: [0.25, 0.5, 0.75]}, [by]).select(F.col(by).alias("g"), F.col(column).alias("q"))
    rows = events.groupBy(by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    rows = rows.join(q, F.col(by).eqNullSafe(F.col("g")))
    quarters = [F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    return rows.select(by, "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min")], *quarters, F.round("max", 6).alias("max"))


def data_quality(events: DataFrame) -> DataFrame:
    """column, nulls; and the number of repeated ids under the name duplicate_event_ids."""
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in events.columns]
    twice = F.struct(F.lit("duplicate_event_ids").alias("column"), (F.count("event_id") - F.count_distinct("event_id")).alias("nulls"))
    return events.agg(F.array(*cells, twice).alias("rows")).select(F.inline("rows"))


def profile(events: DataFrame) -> DataFrame:
    return events.agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count_distinct("category").alias("categories"),
        F.min("final_price").alias("min_price"), F.max("final_price").alias("max_price"), F.count(F.lit(1)).alias("events"),
    )


def correlation(rows: DataFrame, columns=CORRELATED) -> DataFrame:
    """a, b, corr of every ordered pair: unordered ones are computed, as one group each, and mirrored."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]
    found = rows.select(F.inline(F.array(*cells))).groupBy("a", "b").agg(F.round(F.corr("x", "y"), 6).alias("corr"))
    mirrored = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return found.select(F.explode(mirrored).alias("p"), "corr").select("p.a", "p.b", "corr")


def welch(rows: DataFrame, columns=CORRELATED, label: str = "label_is_anomaly") -> DataFrame:
    """feature, t_statistic (absolute) of labelled against other rows; features need over ten values a side."""
    y = F.col(label)

    def side(c: str, flag: Column) -> list[Column]:
        v = F.when(flag, F.col(c))
        return [F.count(v), F.avg(v), F.var_samp(v)]

    cells = []
    for c in columns:
        (n1, m1, v1), (n2, m2, v2) = side(c, ~y), side(c, y)
        t = F.when((n1 > 10) & (n2 > 10), F.abs((m1 - m2) / F.sqrt(v1 / n1 + v2 / n2)))
        cells.append(F.struct(F.lit(c).alias("feature"), F.round(t, 6).alias("t_statistic")))
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).filter("t_statistic is not null")


def shape(rows: DataFrame, by: str = "category", column: str = "final_price") -> DataFrame:
    """Excess kurtosis and skewness (population)."""
    return rows.groupBy(by).agg(F.round(F.kurtosis(column), 5).alias("kurtosis"), F.round(F.skewness(column), 5).alias("skewness"))


def anomaly_runs(events: DataFrame, order: tuple = ("timestamp", "event_id")) -> DataFrame:
    """start_id, length, run_type: islands of consecutive labelled rows in the order (the last type seen names a run).

    Ids need not be dense or ordered.  A row's place among all rows less its place among the
    labelled ones is the same within an island and differs between islands; both places come
    from range-partitioned sorts, so no task ranks all rows, and an island is summed up before it
    is shuffled.
    """
    slim = events.select(*dict.fromkeys([*order, "event_id"]), "label_is_anomaly", "label_type")
    hits = ranked(slim, list(order), name="place", write=False).filter("label_is_anomaly").select("event_id", "label_type", "place")
    numbered = ranked(hits, ["place"], name="among")
    return numbered.groupBy((F.col("place") - F.col("among")).alias("island")).agg(
        F.min_by("event_id", "place").alias("start_id"), F.count(F.lit(1)).alias("length"), F.max_by("label_type", F.when(F.col("label_type").isNotNull(), F.col("place"))).alias("run_type")
    ).drop("island")


def run_summary(runs: DataFrame) -> DataFrame:
    n = F.col("length")
    return runs.agg(F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean_length"), F.count_if(n == 1).alias("single"), F.count_if(n >= 2).alias("two_or_more"), F.count_if(n >= 5).alias("five_or_more"))


def run_types(runs: DataFrame, least: int = 3) -> DataFrame:
    return runs.filter(F.col("length") >= least).groupBy("run_type").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("length"), 6).alias("mean_length"))


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution by a rational approximation; native."""
    x = F.sqrt(-2.0 * F.ln(F.least(p, 1 - p)))
    start = x - ((0.010328 * x + 0.802853) * x + 2.515517) / (((0.001308 * x + 0.189269) * x + 1.432788) * x + 1.0)
    return F.when(p < 0.5, -start).otherwise(start)


def qq_points(rows: DataFrame, by: str = "category", column: str = "final_price") -> DataFrame:
    """category, place, theoretical, sample: Filliben plotting positions against sorted values.

    Theoretical quantiles are a rational approximation (error below 4.5e-4).  Values are ranked
    within whole numbers, after running sums of their counts.
    """
    whole = F.when(F.isnan(column), F.lit(2**62)).otherwise(F.floor(column))
    values = rows.filter(F.col(column).isNotNull()).select(by, column, "event_id", whole.alias("whole"))
    sizes = values.groupBy(by, "whole").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(W.partitionBy(by).orderBy("whole").rowsBetween(W.unboundedPreceding, 0))
    starts = sizes.select(F.col(by).alias("by"), F.col("whole").alias("w"), (upto - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy(by)).alias("n"))
    local = F.row_number().over(W.partitionBy(by, "whole").orderBy(column, "event_id"))
    joined = values.join(starts, F.col(by).eqNullSafe(F.col("by")) & (F.col("whole") == F.col("w")))
    ranked = joined.select(by, column, (F.col("before") + local).alias("place"), "n")
    end = F.pow(F.lit(0.5), 1.0 / F.col("n"))
    p = F.when(F.col("place") == F.col("n"), end).when(F.col("place") == 1, 1 - end).otherwise((F.col("place") - 0.3175) / (F.col("n") + 0.365))
    return ranked.select(by, "place", F.round(normal_quantile(p), 6).alias("theoretical"), F.col(column).alias("sample"))


