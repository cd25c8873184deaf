"""Alerts: one score and explanation from ensemble, rules and (optionally) forecast."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ACTIONS, AVERAGE_REVENUE, DEFAULT_REVENUE
from ..functions.clean import clip, true
from ..sources.fixtures import lookup


def alert_severity(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.45, "medium").otherwise("low")


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", c))


def unified_score(have: set, renormalise: bool = False) -> Column:
    """Weighted sum of what is there; without a forecast at most 0.75 unless renormalised."""
    parts = [(w, c) for w, c in ((0.40, "rule_score"), (0.35, "anomaly_score"), (0.25, "ts_score")) if c in have]
    total = F.lit(0.0)
    for w, c in parts:
        total = total + w * F.coalesce(F.col(c), F.lit(0.0))
    return clip(total / sum(w for w, _ in parts) if renormalise else total, 0.0, 1.0)


def describe(have: set) -> Column:
    price, surge, category, region = (F.col(c) for c in ("final_price", "surge_multiplier", "category", "region"))
    times = F.concat(F.format_string("%.1f", surge), F.lit("x"))
    first = (
        F.when(price < 0, F.concat(F.lit("NEGATIVE PRICE ("), money(price), F.lit(") for "), category, F.lit(" in "), region))
        .when(price < 1.0, F.concat(F.lit("Near-zero price ("), money(price), F.lit(") for "), category))
        .when(surge > 10, F.concat(F.lit("Extreme surge ("), times, F.lit(") pushing "), category, F.lit(" to "), money(price)))
        .when(surge > 5, F.concat(F.lit("High surge ("), times, F.lit(") on "), category, F.lit(", price="), money(price)))
    )
    broken = F.when(F.col("rule_violations") != "none", F.concat(F.lit("Rule violations: "), F.col("rule_violations")))
    parts = [first, broken]
    if "ts_anomaly" in have:
        parts.append(F.when(true(F.col("ts_anomaly")) & F.col("ts_expected").isNotNull(), F.concat(F.lit("Outside forecast range (expected ~"), money(F.col("ts_expected")), F.lit(", got "), money(price), F.lit(")"))))
    n = F.col("n_methods_flagged")
    parts.append(F.when(n >= 3, F.concat(F.lit("[HIGH CONFIDENCE: "), n.cast("string"), F.lit("/3 methods agree]"))))
    text = F.concat_ws(" | ", *parts)
    plain = F.concat(F.lit("Anomalous pricing for "), category, F.lit(": "), money(price), F.lit(" (surge="), F.format_string("%.2f", surge), F.lit("x) in "), region)
    return F.when(text == "", plain).otherwise(text)


def impact() -> Column:
    """Lost revenue below the category's average, twice the excess above it."""
    expected = lookup(AVERAGE_REVENUE, F.col("category"), DEFAULT_REVENUE)
    gap = F.abs(F.col("final_price") - expected)
    return F.round(F.when(F.col("final_price") < expected, gap).otherwise(gap * 2.0), 2)


def detection_summary(have: set) -> Column:
    parts = [
        F.when(F.col("anomaly_score") > 0.5, F.concat(F.lit("ML ensemble (score="), F.format_string("%.2f", F.col("anomaly_score")), F.lit(")"))),
        F.when(F.col("rule_anomaly"), F.concat(F.lit("Business rules ("), F.col("rule_violations"), F.lit(")"))),
    ]
    if "ts_anomaly" in have:
        parts.append(F.when(true(F.col("ts_anomaly")), F.concat(F.lit("Time series (score="), F.format_string("%.2f", F.coalesce("ts_score", F.lit(0.0))), F.lit(")"))))
    text = F.concat_ws(" + ", *parts)
    return F.when(text == "", "Ensemble threshold").otherwise(text)


def classify(scored: DataFrame, compat_label_mask: bool = False, renormalise: bool = False) -> DataFrame:
    """The alerting rows of a scored batch, enriched.

    A row alerts if the ensemble, a rule or the forecast fired; ``compat_label_mask`` puts the
    ground-truth label in the ensemble's place.
    """
    have = set(scored.columns)
    first = "label_is_anomaly" if compat_label_mask and "label_is_anomaly" in have else "is_anomaly"
    mask = true(F.col(first)) | true(F.col("rule_anomaly"))
    if "ts_anomaly" in have:
        mask = mask | true(F.col("ts_anomaly"))
    out = scored.filter(mask).withColumn("unified_score", unified_score(have, renormalise))
    out = out.withColumn("severity", alert_severity(F.col("unified_score")))
    return out.select(
        "*",
        describe(have).alias("description"),
        impact().alias("estimated_impact_usd"),
        lookup(ACTIONS, F.col("severity")).alias("recommended_action"),
        detection_summary(have).alias("detection_summary"),
    )


def alert_records(alerts: DataFrame) -> DataFrame:
    """Projection to the stored alert table."""
    have = set(alerts.columns)
    bound = {c: (F.col(c) if c in have else F.lit(None)).cast("double") for c in ("ts_lower", "ts_upper")}
    label = F.col("label_type") if "label_type" in have else F.lit("detected")
    return alerts.select(
        "event_id", "timestamp", "category", F.col("detection_summary").alias("detection_method"), label.alias("anomaly_type"),
        F.col("unified_score").alias("anomaly_score"), "severity", "final_price",
        bound["ts_lower"].alias("expected_price_low"), bound["ts_upper"].alias("expected_price_high"),
        "description", "estimated_impact_usd", "recommended_action",
    )
