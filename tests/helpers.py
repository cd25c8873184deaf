import datetime as dt

from priceguard.sources.schemas import EVENTS

BASE = dict(
    event_id=0, timestamp=dt.datetime(2024, 6, 3, 10), category="ride_standard", base_price=12.5, surge_multiplier=1.5, final_price=20.0, demand_level=0.5,
    supply_level=0.5, distance_miles=5.0, duration_minutes=15.0, region="downtown", label_is_anomaly=False, label_type=None,
)


def events(spark, *changes):
    """One event per dict of changes to a clean event."""
    rows = [{**BASE, "event_id": i, **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[f.name] for f in EVENTS) for r in rows], EVENTS)


def hourly(n=200, seed=42, categories=("ride_standard",), outliers=None):
    """Changes for n hourly events with seeded noise."""
    import numpy as np

    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        out.append(dict(
            timestamp=dt.datetime(2024, 6, 1) + dt.timedelta(hours=i), category=categories[i % len(categories)], surge_multiplier=float(rng.uniform(1, 2)), final_price=float(rng.normal(20, 3)),
            demand_level=float(rng.uniform(0.2, 0.8)), supply_level=float(rng.uniform(0.3, 0.7)), distance_miles=float(rng.uniform(2, 10)), duration_minutes=float(rng.uniform(5, 30)),
        ))
    for k, change in (outliers or {}).items():
        out[k] |= change
    return out
