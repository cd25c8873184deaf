"""Settings of the engine: frozen dataclasses on the driver, with two named presets."""

from dataclasses import dataclass, field, replace

# Categories with base price, average revenue, surge sensitivity, distance mean and spread.
BASE_PRICES = {"ride_standard": 12.5, "ride_premium": 25.0, "ride_pool": 8.0, "delivery_food": 5.99, "delivery_grocery": 7.99}
AVERAGE_REVENUE = {"ride_standard": 18.0, "ride_premium": 35.0, "ride_pool": 12.0, "delivery_food": 8.0, "delivery_grocery": 10.0}
DEFAULT_REVENUE = 15.0
SURGE_SENSITIVITY = {"ride_standard": 1.0, "ride_premium": 0.7, "ride_pool": 1.3, "delivery_food": 0.8, "delivery_grocery": 0.6}
DISTANCES = {"ride_standard": (5.0, 3.0), "ride_premium": (8.0, 4.0), "ride_pool": (4.0, 2.0), "delivery_food": (3.0, 1.5), "delivery_grocery": (4.0, 2.0)}
REGIONS = ["downtown", "suburbs", "airport", "university", "industrial"]
REGION_DEMAND = {"downtown": 1.3, "suburbs": 0.9, "airport": 1.4, "university": 1.1, "industrial": 0.7}
REGION_DISTANCE = {"downtown": 0.7, "suburbs": 1.4, "airport": 2.0, "university": 0.8, "industrial": 1.2}
HOURLY_DEMAND = [0.7, 0.5, 0.4, 0.3, 0.3, 0.5, 0.8, 1.2, 1.5, 1.3, 1.0, 1.1, 1.3, 1.2, 1.0, 1.0, 1.2, 1.6, 1.8, 1.5, 1.2, 1.1, 1.0, 0.8]
WEEKDAY_DEMAND = [1.0, 1.0, 1.0, 1.05, 1.15, 1.3, 1.2]
# Severities, rule names and recommended actions.
SEVERITIES = ["critical", "high", "medium", "low"]
RULES = [
    "negative_price", "below_floor", "surge_cap_exceeded", "extreme_price_per_mile",
    "price_hierarchy_violation", "demand_surge_mismatch", "zero_surge", "impossible_speed",
]
ACTIONS = {
    "critical": "IMMEDIATE: Pause pricing algorithm for this category. Page on-call engineer.",
    "high": "URGENT: Investigate within 1 hour. Check recent algorithm deployments.",
    "medium": "REVIEW: Investigate within 4 hours. Check for regional configuration issues.",
    "low": "MONITOR: Add to next review cycle. May be normal market fluctuation.",
}


@dataclass(frozen=True)
class RuleSettings:
    max_surge: float = 5.0
    price_floor: float = 1.0
    max_price_per_mile: float = 30.0
    price_caps: dict = field(default_factory=lambda: {"ride_pool": 80.0, "ride_standard": 150.0, "ride_premium": 300.0})
    min_demand: float = 0.85
    max_supply: float = 0.20
    mismatch_surge: float = 1.02
    max_speed: float = 120.0


@dataclass(frozen=True)
class Settings:
    """``default`` holds the code defaults, ``tuned`` the values found by grid search."""

    contamination: float = 0.10
    trees: int = 200
    seed: int = 42
    zscore_threshold: float = 2.5
    rolling_windows: tuple = (1, 6, 24)
    context_deviation: float = 2.5
    context_min_count: int = 5
    ensemble_threshold: float = 0.4
    forest_weight: float = 0.40
    stat_weight: float = 0.35
    context_weight: float = 0.25
    interval_width: float = 0.95
    events_per_hour: int = 50
    history_days: int = 90
    anomaly_rate: float = 0.03
    rules: RuleSettings = field(default_factory=RuleSettings)

    @property
    def rolling_rows(self) -> tuple:
        return tuple(max(5 * w, 10) for w in self.rolling_windows)


DEFAULT = Settings()
TUNED = replace(
    DEFAULT,
    contamination=0.05,
    zscore_threshold=2.8,
    ensemble_threshold=0.20,
    rules=RuleSettings(max_price_per_mile=35.0, price_caps={"ride_pool": 90.0, "ride_standard": 175.0, "ride_premium": 350.0}),
)
PRESETS = {"default": DEFAULT, "tuned": TUNED}
