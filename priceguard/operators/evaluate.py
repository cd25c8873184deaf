"""Evaluation: confusion counts, sweeps, grids and leaderboards, all as aggregates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TUNED, Settings
from ..functions.clean import clip, true
from .quantiles import percentiles


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_prf(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 (rounded to 4, 0 when undefined) from tp, fp, fn."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(_ratio(2 * p * r, p + r), 4).alias("f1"))


def confusion(flag: Column, label: Column) -> list[Column]:
    f, y = true(flag), true(label)
    one = lambda c, n: F.sum(c.cast("long")).alias(n)
    return [one(f & y, "tp"), one(f & ~y, "fp"), one(~f & y, "fn"), one(~f & ~y, "tn")]


def train_test(events: DataFrame, share: float = 0.8) -> DataFrame:
    """``events`` with split 'train' or 'test' by place in (timestamp, event_id) order, whatever the ids are.

    The first event of the test part is found without a sort, when this is called: counts per
    minute give its minute, and only the rows of that minute are ranked; the driver gets that one
    row, so filters on the split stay simple comparisons.  Nulls come first; rows that share
    timestamp and id stay together.
    """
    keys = events.select("timestamp", "event_id", F.date_trunc("minute", "timestamp").alias("minute"))
    sizes = keys.groupBy("minute").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy("minute").rowsBetween(W.unboundedPreceding, 0))  # a row per minute, not per event
    placed = sizes.select("minute", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.floor(F.sum("n").over(W.partitionBy()) * share).alias("cut"))
    at = placed.filter("before <= cut and cut < upto").select(F.col("minute").alias("m"), (F.col("cut") - F.col("before") + 1).alias("place"))  # one row
    near = keys.join(F.broadcast(at), F.col("minute").eqNullSafe(F.col("m")))
    ranked = near.withColumn("own", F.row_number().over(W.orderBy("timestamp", "event_id"))).filter("own = place")
    first = ranked.select(F.col("timestamp").cast("string").alias("at"), "event_id").first()  # none without a test part
    early = F.lit(True)
    if first is not None:
        ts, at = F.col("timestamp"), F.lit(first["at"]).cast(events.schema["timestamp"].dataType)
        before = F.col("event_id").isNull() | (F.col("event_id") < first["event_id"]) if first["event_id"] is not None else F.lit(False)
        early = (ts.isNull() & before) if first["at"] is None else ts.isNull() | (ts < at) | ((ts == at) & before)
    return events.withColumn("split", F.when(early, "train").otherwise("test"))


def flags_of(scored: DataFrame) -> dict[str, Column]:
    """The three evaluated methods."""
    e, r = true(F.col("is_anomaly")), true(F.col("rule_anomaly"))
    return {"ensemble": e, "business_rules": r, "combined": e | r}


def prf_by_method(scored: DataFrame, flags: dict[str, Column] | None = None, label: str = "label_is_anomaly") -> DataFrame:
    """method, tp, fp, fn, precision, recall, f1: one pass for all methods."""
    flags = flags or flags_of(scored)
    rows = scored.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("method"), true(f).alias("flag")) for n, f in flags.items()])).alias("m"))
    counts = rows.groupBy("m.method").agg(*confusion(F.col("m.flag"), F.col("y")))
    return with_prf(counts).select("method", "tp", "fp", "fn", "precision", "recall", "f1")


def sweep_points() -> list[tuple[str, float, int]]:
    """The 93 rows of a threshold sweep: (mode, threshold, methods needed)."""
    steps = [round(0.05 + 0.02 * k, 2) for k in range(45)]
    return [(m, t, 0) for t in steps for m in ("score_only", "score_or_2methods")] + [(f"min_{k}_methods", 0.0, k) for k in (1, 2, 3)]


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """mode, threshold, precision, recall, f1 over a table of distinct (score, methods, label).

    The batch is reduced to its score histogram first, so the sweep multiplies that and not the rows.
    """
    score = F.round("anomaly_score", 9)
    hist = scored.groupBy(score.alias("s"), F.col("n_methods_flagged").alias("n"), true(F.col("label_is_anomaly")).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    points = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(t).alias("threshold"), F.lit(k).alias("k")) for m, t, k in sweep_points()])
    rows = hist.withColumn("p", F.explode(points))
    over = F.col("s") > F.col("p.threshold")
    flag = (
        F.when(F.col("p.mode") == "score_only", over)
        .when(F.col("p.mode") == "score_or_2methods", over | (F.col("n") >= 2))
        .otherwise(F.col("n") >= F.col("p.k"))
    )
    sums = [F.sum(F.when(c, F.col("c")).otherwise(0)).alias(n) for c, n in ((flag & F.col("y"), "tp"), (flag & ~F.col("y"), "fp"), (~flag & F.col("y"), "fn"))]
    return with_prf(rows.groupBy("p.mode", "p.threshold").agg(*sums)).select("mode", "threshold", "precision", "recall", "f1")


def pr_auc(sweep: DataFrame) -> DataFrame:
    """Absolute trapezoid area under the score_only curve, ordered by recall (45 rows)."""
    order = W.orderBy("recall", "precision", "threshold")
    curve = sweep.filter("mode = 'score_only'").select(
        (F.col("recall") - F.lag("recall").over(order)).alias("dx"), ((F.col("precision") + F.lag("precision").over(order)) / 2).alias("y")
    )
    return curve.agg(F.round(F.abs(F.sum(F.col("dx") * F.col("y"))), 4).alias("pr_auc"))


# The tuning grid.
GRID = {"contamination": [0.05, 0.10, 0.15, 0.20], "zscore_threshold": [2.0, 2.5, 2.8, 3.0], "ensemble_threshold": [0.15, 0.20, 0.25, 0.30, 0.35, 0.40]}


def time_folds(rows: DataFrame, folds: int, like: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``fold``, from 0: parts of about equal size that follow each other in time (rows of one instant stay together, those without a time come first).

    ``like``: a table with the same times that is cheaper to read twice.
    """
    at = F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(-(2**62))).cast("double")
    cuts = percentiles((rows if like is None else like).select(at.alias("at")), {"at": [k / folds for k in range(1, folds)]}).first()["at"] or []
    return rows.withColumn("fold", sum([(at >= c).cast("int") for c in cuts], F.lit(0)))


def grid_search(scored: DataFrame, thresholds=None, z_values=None, settings: Settings = TUNED, by: tuple = ()) -> DataFrame:
    """``by``, zscore_threshold, ensemble_threshold, precision, recall, f1 without refitting anything, from one histogram of all rows.

    ``scored`` carries raw deviations divided by their maxima (z_part, mad_part, iqr_part), the raw
    z_dev, mad_dev, iqr_dev, the largest rolling deviation roll_dev, ctx and label columns, and
    optionally forest columns per contamination (``if_<c>`` flags with one if_score).
    """
    z_values = z_values or GRID["zscore_threshold"]
    thresholds = thresholds or GRID["ensemble_threshold"]
    have = set(scored.columns)
    levels = [c for c in GRID["contamination"] if f"if_{c}" in have] or [None]
    configs = []
    for level in levels:
        for z in z_values:
            roll = true(F.col("roll_dev") > z)
            stat = clip(F.col("parts") + 0.10 * roll.cast("double"), 0.0, 1.0)
            flag = true(F.col("z_dev") > z) | true(F.col("mad_dev") > z) | true(F.col("iqr_dev") > 0) | roll
            total = settings.stat_weight * stat + settings.context_weight * F.col("ctx_score")
            n = flag.cast("int") + F.col("ctx_anomaly").cast("int")
            if level is not None:
                total, n = total + settings.forest_weight * F.col("if_score"), n + F.col(f"`if_{level}`").cast("int")
            configs.append(F.struct(F.lit(level).cast("double").alias("c"), F.lit(float(z)).alias("z"), F.round(clip(total, 0.0, 1.0), 9).alias("s"), n.alias("n")))
    hist = scored.select(*by, true(F.col("label_is_anomaly")).alias("y"), F.explode(F.array(*configs)).alias("g")).groupBy(*by, "y", "g").agg(F.count(F.lit(1)).alias("m"))
    rows = hist.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    flag = (F.col("g.s") > F.col("t")) | (F.col("g.n") >= 2)
    sums = [F.sum(F.when(c, F.col("m")).otherwise(0)).alias(k) for c, k in ((flag & F.col("y"), "tp"), (flag & ~F.col("y"), "fp"), (~flag & F.col("y"), "fn"))]
    grid = with_prf(rows.groupBy(*by, F.col("g.c").alias("contamination"), F.col("g.z").alias("zscore_threshold"), F.col("t").alias("ensemble_threshold")).agg(*sums))
    out = grid.select(*by, "contamination", "zscore_threshold", "ensemble_threshold", "precision", "recall", "f1")
    return out if levels != [None] else out.drop("contamination")


def tuned_and_reported(folds: DataFrame, report: int) -> DataFrame:
    """One row: the settings with the best mean F1 over the folds before ``report``, that mean, and their figures on that fold, which chose nothing."""
    keys = [c for c in ("contamination", "zscore_threshold", "ensemble_threshold") if c in folds.columns]
    means = folds.filter(F.col("fold") < report).groupBy(*keys).agg(F.round(F.avg("f1"), 6).alias("tune_f1"))
    best = means.orderBy(F.desc("tune_f1"), *keys).limit(1)
    figures = [F.col(c).alias(f"report_{c}") for c in ("precision", "recall", "f1")]
    return folds.filter(F.col("fold") == report).select(*keys, *figures).join(F.broadcast(best), keys).select(*keys, "tune_f1", *[f"report_{c}" for c in ("precision", "recall", "f1")])


def type_recall(scored: DataFrame) -> DataFrame:
    """anomaly_type, total and the recall of each method."""
    rows = scored.filter(F.col("label_type").isNotNull()).groupBy(F.col("label_type").alias("anomaly_type"))
    means = [F.round(F.avg(f.cast("double")), 4).alias(n) for n, f in zip(("ensemble_recall", "rules_recall", "combined_recall"), flags_of(scored).values(), strict=True)]
    return rows.agg(F.count(F.lit(1)).alias("total"), *means)


def best_row(table: DataFrame, metric: str = "f1") -> DataFrame:
    """The row with the largest metric; among equals the first by the other columns."""
    rest = [c for c in table.columns if c != metric]
    return table.orderBy(F.col(metric).desc_nulls_last(), *rest).limit(1)


def leaderboard(evaluations: DataFrame) -> DataFrame:
    """Best evaluation of each family (the method's name up to its first underscore), by F1."""
    family = F.substring_index("method", "_", 1)
    order = W.partitionBy("family").orderBy(F.col("f1").desc(), "method")
    ranked = evaluations.withColumn("family", family).withColumn("place", F.row_number().over(order))
    return ranked.filter("place = 1").drop("place")


def grid_pivot(grid: DataFrame) -> DataFrame:
    """Mean F1 by z threshold (rows) and ensemble threshold (columns)."""
    names = {f"{t:.2f}": t for t in GRID["ensemble_threshold"]}
    cells = [F.round(F.avg(F.when(F.col("ensemble_threshold") == t, F.col("f1"))), 6).alias("t_" + n.replace(".", "_")) for n, t in names.items()]
    return grid.groupBy("zscore_threshold").agg(*cells)


def contamination_pivot(grid: DataFrame) -> DataFrame:
    """F1 by ensemble threshold and contamination (rows) and z threshold (columns)."""
    cells = [F.max(F.when(F.col("zscore_threshold") == z, F.col("f1"))).alias(f"z_{z}".replace(".", "_")) for z in GRID["zscore_threshold"]]
    return grid.groupBy("ensemble_threshold", "contamination").agg(*cells)


def iso_f1(spark, levels=(0.2, 0.4, 0.6, 0.8), points: int = 100) -> DataFrame:
    """f, recall, precision of curves of equal F1, where 0 < precision <= 1."""
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in levels])).alias("f"))
    rows = rows.select("f", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    rows = rows.select("f", (F.col("i") / (points - 1.0) * 0.99 + 0.01).alias("recall"))
    low = 2 * F.col("recall") - F.col("f")
    curve = rows.withColumn("precision", F.when(low != 0, F.col("f") * F.col("recall") / low))
    return curve.filter("precision > 0 and precision <= 1").select("f", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))
