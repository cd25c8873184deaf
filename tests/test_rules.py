import pytest

from priceguard.config import DEFAULT, TUNED
from priceguard.operators.rules import validate

from .helpers import events

# rule, changes that fire it, changes just short of it, severity, score
CASES = [
    ("negative_price", dict(final_price=-0.01), dict(final_price=0.0), "critical", 1.0),
    ("below_floor", dict(final_price=0.99), dict(final_price=1.0), "high", 0.85),
    ("below_floor", dict(final_price=0.0), dict(final_price=1.0), "high", 0.85),
    ("surge_cap_exceeded", dict(surge_multiplier=5.01), dict(surge_multiplier=5.0), "high", 0.7006),
    ("surge_cap_exceeded", dict(surge_multiplier=15.01), dict(surge_multiplier=5.0), "critical", 1.0),
    ("surge_cap_exceeded", dict(surge_multiplier=15.0), dict(surge_multiplier=5.0), "high", 1.0),
    ("extreme_price_per_mile", dict(final_price=70.1, distance_miles=2.0), dict(final_price=70.0, distance_miles=2.0), "medium", 0.500714),
    ("extreme_price_per_mile", dict(final_price=53.0, distance_miles=1.0), dict(final_price=52.5, distance_miles=1.0), "medium", 0.504762),
    ("price_hierarchy_violation", dict(final_price=176.0, distance_miles=10.0), dict(final_price=175.0, distance_miles=10.0), "medium", 0.552571),
    ("demand_surge_mismatch", dict(demand_level=0.86, supply_level=0.19, surge_multiplier=1.02), dict(demand_level=0.85, supply_level=0.19, surge_multiplier=1.02), "high", 0.75),
    ("demand_surge_mismatch", dict(demand_level=0.86, supply_level=0.19, surge_multiplier=1.0), dict(demand_level=0.86, supply_level=0.20, surge_multiplier=1.0), "high", 0.75),
    ("zero_surge", dict(surge_multiplier=0.0), dict(surge_multiplier=0.01), "critical", 1.0),
    ("impossible_speed", dict(distance_miles=20.1, duration_minutes=10.0), dict(distance_miles=20.0, duration_minutes=10.0), "low", 0.4),
]


@pytest.mark.parametrize(("rule", "hit", "miss", "severity", "score"), CASES)
def test_boundaries(spark, rule, hit, miss, severity, score):
    a, b = sorted(validate(events(spark, hit, miss)).collect(), key=lambda r: r["event_id"])
    assert a[rule] and not b[rule]
    assert rule in a["rule_violations"].split(",") and a["rule_anomaly"]
    if a["rule_violations"] == rule:
        assert a["rule_severity"] == severity and abs(a["rule_score"] - score) < 1e-5


def test_clean_null_and_empty(spark):
    clean, null = sorted(validate(events(spark, {}, dict(final_price=None, surge_multiplier=None, distance_miles=None, demand_level=None))).collect(), key=lambda r: r["event_id"])
    for r in (clean, null):
        assert not r["rule_anomaly"] and r["rule_score"] == 0 and r["rule_violations"] == "none" and r["rule_severity"] == "none"
    assert validate(events(spark)).count() == 0


def test_order_of_names_and_worst_severity(spark):
    r = validate(events(spark, dict(final_price=-5.0, surge_multiplier=0.0, distance_miles=100.0, duration_minutes=10.0))).first()
    assert r["rule_violations"] == "negative_price,zero_surge,impossible_speed" and r["rule_severity"] == "critical"


def test_presets_differ(spark):
    e = events(spark, dict(final_price=64.0, distance_miles=2.0))
    assert validate(e, DEFAULT.rules).first()["extreme_price_per_mile"] and not validate(e, TUNED.rules).first()["extreme_price_per_mile"]
