"""Eight deterministic business rules folded into one verdict (all native expressions)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RULES, TUNED, RuleSettings
from ..functions.clean import at_least, clip, true

RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def _ramp(base: float, slope: float, excess: Column, top: float = 1.0) -> Column:
    return clip(base + slope * excess, base, top)


def rule_columns(s: RuleSettings) -> dict[str, tuple[Column, Column, Column]]:
    """Rule name to (flag, score if flagged, severity rank if flagged)."""
    price, surge, miles = F.col("final_price"), F.col("surge_multiplier"), F.col("distance_miles")
    rank = {k: F.lit(v) for k, v in RANK.items()}
    distance = at_least(miles, 0.1)
    per_mile = price / distance
    limit = F.when(distance < 2.0, s.max_price_per_mile * 1.5).otherwise(F.lit(s.max_price_per_mile))
    pairs = [F.lit(x) for kv in s.price_caps.items() for x in kv]
    base_cap = F.create_map(*pairs)[F.col("category")] if pairs else F.lit(None).cast("double")
    cap = base_cap + at_least(miles - 10, 0.0) * 5.0 + at_least(surge - 2.0, 0.0) * base_cap * 0.15
    speed = miles / (at_least(F.col("duration_minutes"), 1.0) / 60)
    starved = (F.col("demand_level") > s.min_demand) & (F.col("supply_level") < s.max_supply)
    found = [
        (price < 0, F.lit(1.0), rank["critical"]),
        ((price >= 0) & (price < s.price_floor), F.lit(0.85), rank["high"]),
        (surge > s.max_surge, _ramp(0.7, 0.3, (surge - s.max_surge) / s.max_surge), F.when(surge > s.max_surge * 3, rank["critical"]).otherwise(rank["high"])),
        (per_mile > limit, _ramp(0.5, 0.5, (per_mile - limit) / limit), rank["medium"]),
        (price > cap, _ramp(0.55, 0.45, (price - cap) / at_least(cap, 1.0)), rank["medium"]),
        (starved & (surge <= s.mismatch_surge), F.lit(0.75), rank["high"]),
        (surge <= 0, F.lit(1.0), rank["critical"]),
        (speed > s.max_speed, F.lit(0.4), rank["low"]),
    ]
    return {n: (true(f), sc, r) for n, (f, sc, r) in zip(RULES, found, strict=True)}


def validate(events: DataFrame, settings: RuleSettings = TUNED.rules) -> DataFrame:
    """``events`` with the eight flags, rule_anomaly, rule_score, rule_violations and rule_severity."""
    rules = rule_columns(settings)
    flagged = events.select("*", *[f.alias(n) for n, (f, _, _) in rules.items()])
    score = F.greatest(*[F.when(F.col(n), s).otherwise(0.0) for n, (_, s, _) in rules.items()])
    worst = F.greatest(*[F.when(F.col(n), r).otherwise(0) for n, (_, _, r) in rules.items()])
    names = F.concat_ws(",", *[F.when(F.col(n), F.lit(n)) for n in rules])
    any_flag = F.lit(False)
    for n in rules:
        any_flag = any_flag | F.col(n)
    severity = F.element_at(F.array(*[F.lit(k) for k in RANK]), worst + 1)
    return flagged.select(
        "*",
        any_flag.alias("rule_anomaly"),
        score.cast("double").alias("rule_score"),
        F.when(names == "", "none").otherwise(names).alias("rule_violations"),
        severity.alias("rule_severity"),
    )
