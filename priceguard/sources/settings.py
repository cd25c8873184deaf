"""Settings from a YAML file; what the file does not name keeps its default."""

from dataclasses import replace
from pathlib import Path

from ..config import DEFAULT, RuleSettings, Settings


def load_settings(path: str | None = None, base: Settings = DEFAULT) -> Settings:
    """Read ``path``, or below the working and the package's parent folder; ``base`` if there is none."""
    if path is None:
        return base
    places = [Path(path), Path(__file__).resolve().parents[2] / path]
    found = next((p for p in places if p.is_file()), None)
    if found is None:
        return base
    import yaml

    return from_mapping(yaml.safe_load(found.read_text()) or {}, base)


def from_mapping(raw: dict, base: Settings = DEFAULT) -> Settings:
    data, detect, rules = (raw.get(k) or {} for k in ("data_generation", "anomaly_detection", "business_rules"))
    forest, mismatch = detect.get("isolation_forest") or {}, rules.get("demand_surge_mismatch") or {}
    r = base.rules
    return replace(
        base,
        contamination=forest.get("contamination", base.contamination),
        trees=forest.get("n_estimators", base.trees),
        seed=forest.get("random_state", base.seed),
        zscore_threshold=detect.get("zscore_threshold", base.zscore_threshold),
        rolling_windows=tuple(detect.get("rolling_windows", base.rolling_windows)),
        ensemble_threshold=detect.get("ensemble_threshold", base.ensemble_threshold),
        interval_width=(raw.get("prophet") or {}).get("interval_width", base.interval_width),
        events_per_hour=data.get("events_per_hour", base.events_per_hour),
        history_days=data.get("history_days", base.history_days),
        anomaly_rate=data.get("anomaly_rate", base.anomaly_rate),
        rules=RuleSettings(
            max_surge=rules.get("max_surge_multiplier", r.max_surge),
            price_floor=rules.get("min_price_floor", r.price_floor),
            max_price_per_mile=rules.get("max_price_per_mile", r.max_price_per_mile),
            price_caps={k: float(v) for k, v in rules.get("price_caps", r.price_caps).items()},
            min_demand=mismatch.get("min_demand", r.min_demand),
            max_supply=mismatch.get("max_supply", r.max_supply),
            mismatch_surge=mismatch.get("max_surge", r.mismatch_surge),
            max_speed=r.max_speed,
        ),
    )
