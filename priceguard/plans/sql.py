"""Building blocks of the DuckDB oracle: named common table expressions over the test tables."""

from ..config import TUNED
from ..sources.trips import AIRPORT_ZONES, DOWNTOWN_ZONES

R = TUNED.rules
Z = TUNED.zscore_threshold
C = TUNED.context_deviation

PE = """pe AS (
  SELECT event_id, ts AS "timestamp", category, base_price,
    CASE WHEN event_id % 97 = 0 THEN -0.5 WHEN event_id % 89 = 0 THEN 0.1 WHEN event_id % 83 = 0 THEN 20.0 WHEN event_id % 101 = 0 THEN 1.0 ELSE 1.0 + k / 50.0 END::DOUBLE AS surge_multiplier,
    CASE WHEN event_id % 97 = 0 THEN -(value + 1.0) WHEN event_id % 89 = 0 THEN 0.01 ELSE value END::DOUBLE AS final_price,
    CASE WHEN event_id % 101 = 0 THEN 0.95 ELSE k / 100.0 END::DOUBLE AS demand_level,
    CASE WHEN event_id % 101 = 0 THEN 0.1 ELSE (99 - k) / 100.0 END::DOUBLE AS supply_level,
    (0.5 + (event_id * 7 % 200) / 10.0)::DOUBLE AS distance_miles, (3.0 + (event_id * 13 % 60))::DOUBLE AS duration_minutes,
    CASE user_id % 5 WHEN 0 THEN 'downtown' WHEN 1 THEN 'suburbs' WHEN 2 THEN 'airport' WHEN 3 THEN 'university' ELSE 'industrial' END AS region,
    event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 OR event_id % 101 = 0 AS label_is_anomaly,
    CASE WHEN event_id % 97 = 0 THEN 'negative_price' WHEN event_id % 89 = 0 THEN 'flash_crash' WHEN event_id % 83 = 0 THEN 'runaway_surge' WHEN event_id % 101 = 0 THEN 'demand_supply_mismatch' END AS label_type
  FROM (SELECT event_id, ts, user_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
    CASE event_type WHEN 'click' THEN 'ride_standard' WHEN 'purchase' THEN 'ride_premium' WHEN 'view' THEN 'ride_pool' WHEN 'signup' THEN 'delivery_food' ELSE 'delivery_grocery' END AS category,
    CASE event_type WHEN 'click' THEN 12.5 WHEN 'purchase' THEN 25.0 WHEN 'view' THEN 8.0 WHEN 'signup' THEN 5.99 ELSE 7.99 END::DOUBLE AS base_price
    FROM events) e)"""

_CAP = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.price_caps.items()) + " END"
RULED = f"""r0 AS (
  SELECT *, final_price / greatest(distance_miles, 0.1) AS ppm, CASE WHEN greatest(distance_miles, 0.1) < 2.0 THEN {R.max_price_per_mile * 1.5} ELSE {R.max_price_per_mile} END AS lim,
    {_CAP} + greatest(distance_miles - 10, 0) * 5.0 + greatest(surge_multiplier - 2.0, 0) * {_CAP} * 0.15 AS cap FROM pe),
r1 AS (
  SELECT *, final_price < 0 AS negative_price, final_price >= 0 AND final_price < {R.price_floor} AS below_floor, surge_multiplier > {R.max_surge} AS surge_cap_exceeded, ppm > lim AS extreme_price_per_mile,
    coalesce(final_price > cap, false) AS price_hierarchy_violation, demand_level > {R.min_demand} AND supply_level < {R.max_supply} AND surge_multiplier <= {R.mismatch_surge} AS demand_surge_mismatch,
    surge_multiplier <= 0 AS zero_surge, distance_miles / (greatest(duration_minutes, 1) / 60) > {R.max_speed} AS impossible_speed FROM r0),
ruled AS (
  SELECT * EXCLUDE (ppm, lim, cap), negative_price OR below_floor OR surge_cap_exceeded OR extreme_price_per_mile OR price_hierarchy_violation OR demand_surge_mismatch OR zero_surge OR impossible_speed AS rule_anomaly,
    greatest(CASE WHEN negative_price OR zero_surge THEN 1.0 ELSE 0.0 END, CASE WHEN below_floor THEN 0.85 ELSE 0.0 END,
      CASE WHEN surge_cap_exceeded THEN least(greatest(0.7 + 0.3 * (surge_multiplier - {R.max_surge}) / {R.max_surge}, 0.7), 1.0) ELSE 0.0 END,
      CASE WHEN extreme_price_per_mile THEN least(greatest(0.5 + 0.5 * (ppm - lim) / lim, 0.5), 1.0) ELSE 0.0 END,
      CASE WHEN price_hierarchy_violation THEN least(greatest(0.55 + 0.45 * (final_price - cap) / greatest(cap, 1), 0.55), 1.0) ELSE 0.0 END,
      CASE WHEN demand_surge_mismatch THEN 0.75 ELSE 0.0 END, CASE WHEN impossible_speed THEN 0.4 ELSE 0.0 END)::DOUBLE AS rule_score,
    coalesce(nullif(concat_ws(',', CASE WHEN negative_price THEN 'negative_price' END, CASE WHEN below_floor THEN 'below_floor' END, CASE WHEN surge_cap_exceeded THEN 'surge_cap_exceeded' END,
      CASE WHEN extreme_price_per_mile THEN 'extreme_price_per_mile' END, CASE WHEN price_hierarchy_violation THEN 'price_hierarchy_violation' END, CASE WHEN demand_surge_mismatch THEN 'demand_surge_mismatch' END,
      CASE WHEN zero_surge THEN 'zero_surge' END, CASE WHEN impossible_speed THEN 'impossible_speed' END), ''), 'none') AS rule_violations,
    CASE WHEN negative_price OR zero_surge OR (surge_cap_exceeded AND surge_multiplier > {R.max_surge * 3}) THEN 'critical' WHEN below_floor OR surge_cap_exceeded OR demand_surge_mismatch THEN 'high'
      WHEN extreme_price_per_mile OR price_hierarchy_violation THEN 'medium' WHEN impossible_speed THEN 'low' ELSE 'none' END AS rule_severity
  FROM r1)"""


def stats_cte(source: str, name: str = "st") -> str:
    return f"""{name}_a AS (SELECT category, avg(final_price) AS price_mean, stddev_samp(final_price) AS price_std, quantile_cont(final_price, 0.5) AS price_median,
    quantile_cont(final_price, 0.25) AS price_q1, quantile_cont(final_price, 0.75) AS price_q3, avg(surge_multiplier) AS surge_mean, stddev_samp(surge_multiplier) AS surge_std,
    quantile_cont(surge_multiplier, 0.95) AS surge_p95, quantile_cont(surge_multiplier, 0.99) AS surge_p99, count(*) AS n FROM {source} GROUP BY category),
{name} AS (SELECT a.*, price_q3 - price_q1 AS price_iqr, m.price_mad FROM {name}_a a JOIN (SELECT s.category, quantile_cont(abs(final_price - price_median), 0.5) AS price_mad FROM {source} s JOIN {name}_a USING (category) GROUP BY s.category) m USING (category))"""


def rolling_sql(z: float, name: str) -> str:
    parts = []
    for rows in TUNED.rolling_rows:
        w = f"OVER (PARTITION BY category ORDER BY \"timestamp\", event_id ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"coalesce(count(final_price) {w} >= 3 AND abs(final_price - avg(final_price) {w}) / greatest(stddev_samp(final_price) {w}, 0.01) > {z}, false)")
    return f"(({' OR '.join(parts)}) AND count(*) OVER (PARTITION BY category) >= 10) AS {name}"


TRAIN = "tr AS (SELECT * FROM pe WHERE event_id < (SELECT floor(0.8 * count(*)) FROM pe))"


def context_cte(source: str) -> str:
    return f"""cb AS (SELECT category, CAST(floor(hour("timestamp") / 4) AS INTEGER) AS hour_block, CASE WHEN isodow("timestamp") >= 6 THEN 1 ELSE 0 END AS is_weekend, avg(final_price) AS mean, stddev_samp(final_price) AS std,
    quantile_cont(final_price, 0.5) AS median, avg(surge_multiplier) AS surge_mean, stddev_samp(surge_multiplier) AS surge_std, count(*) AS n FROM {source} GROUP BY ALL)"""


DEV = """dv AS (SELECT p.*, abs(final_price - price_mean) / greatest(coalesce(price_std, 1), 0.01) AS z_dev, abs(0.6745 * (final_price - price_median) / greatest(price_mad, 0.01)) AS mad_dev,
    CASE WHEN final_price < price_q1 - 2.0 * price_iqr THEN (price_q1 - 2.0 * price_iqr - final_price) / greatest(price_iqr, 0.01)
      WHEN final_price > price_q3 + 2.0 * price_iqr THEN (final_price - (price_q3 + 2.0 * price_iqr)) / greatest(price_iqr, 0.01) ELSE 0.0 END AS iqr_dev FROM {src} p JOIN st USING (category))"""


def stat_cte(source: str) -> str:
    return (
        DEV.format(src=source)
        + f""",
dr AS (SELECT *, {rolling_sql(Z, "stat_rolling")} FROM dv),
ss AS (SELECT *, z_dev > {Z} AS stat_zscore, mad_dev > {Z} AS stat_mad, iqr_dev > 0 AS stat_iqr, z_dev > {Z} OR mad_dev > {Z} OR iqr_dev > 0 OR stat_rolling AS stat_anomaly,
    least(greatest(0.35 * z_dev / (SELECT coalesce(nullif(max(z_dev), 0), 1) FROM dv) + 0.35 * mad_dev / (SELECT coalesce(nullif(max(mad_dev), 0), 1) FROM dv)
      + 0.20 * iqr_dev / (SELECT coalesce(nullif(max(iqr_dev), 0), 1) FROM dv) + 0.10 * CASE WHEN stat_rolling THEN 1 ELSE 0 END, 0), 1) AS stat_score FROM dr)"""
    )


CTX = f"""cs AS (SELECT p.*, coalesce(abs(final_price - mean) / greatest(std, 0.01) > {C}, false) OR coalesce(abs(surge_multiplier - surge_mean) / greatest(surge_std, 0.01) > {C + 1}, false) AS ctx_anomaly,
    CASE WHEN mean IS NOT NULL THEN least(greatest(0.6 * abs(final_price - mean) / greatest(std, 0.01) / {2 * C} + 0.4 * abs(surge_multiplier - surge_mean) / greatest(surge_std, 0.01) / {2 * C}, 0), 1) ELSE 0.0 END AS ctx_score
  FROM {{src}} p LEFT JOIN (SELECT category, hour_block, is_weekend, mean, std, surge_mean, surge_std FROM cb WHERE n >= 5) b
  ON p.category = b.category AND CAST(floor(hour(p."timestamp") / 4) AS INTEGER) = b.hour_block AND CASE WHEN isodow(p."timestamp") >= 6 THEN 1 ELSE 0 END = b.is_weekend)"""

SCORED = ",\n".join(
    [
        PE, TRAIN, stats_cte("tr"), RULED, context_cte("tr"), stat_cte("ruled"), CTX.format(src="ss"),
        f"""sc0 AS (SELECT *, least(greatest({TUNED.stat_weight} * stat_score + {TUNED.context_weight} * ctx_score, 0), 1) AS anomaly_score, stat_anomaly::INT + ctx_anomaly::INT AS n_methods_flagged FROM cs),
sc AS (SELECT *, anomaly_score > {TUNED.ensemble_threshold} OR n_methods_flagged >= 2 AS is_anomaly,
    CASE WHEN anomaly_score >= 0.9 THEN 'critical' WHEN anomaly_score >= 0.7 THEN 'high' WHEN anomaly_score >= 0.5 THEN 'medium' WHEN anomaly_score >= 0.3 THEN 'low' ELSE 'none' END AS ensemble_severity,
    coalesce(nullif(concat_ws(',', CASE WHEN stat_anomaly THEN 'statistical' END, CASE WHEN ctx_anomaly THEN 'contextual' END), ''), 'none') AS detection_methods,
    CASE WHEN event_id < (SELECT floor(0.8 * count(*)) FROM pe) THEN 'train' ELSE 'test' END AS split FROM sc0)""",
    ]
)

_AVG = "CASE category WHEN 'ride_standard' THEN 18.0 WHEN 'ride_premium' THEN 35.0 WHEN 'ride_pool' THEN 12.0 WHEN 'delivery_food' THEN 8.0 WHEN 'delivery_grocery' THEN 10.0 ELSE 15.0 END"
ALERTS = f"""al0 AS (SELECT *, least(greatest(0.40 * rule_score + 0.35 * anomaly_score, 0), 1) AS unified_score FROM sc WHERE is_anomaly OR rule_anomaly),
al AS (SELECT event_id, "timestamp", category,
    coalesce(nullif(concat_ws(' + ', CASE WHEN anomaly_score > 0.5 THEN format('ML ensemble (score={{:.2f}})', anomaly_score) END, CASE WHEN rule_anomaly THEN 'Business rules (' || rule_violations || ')' END), ''), 'Ensemble threshold') AS detection_method,
    label_type AS anomaly_type, unified_score AS anomaly_score, CASE WHEN unified_score >= 0.85 THEN 'critical' WHEN unified_score >= 0.65 THEN 'high' WHEN unified_score >= 0.45 THEN 'medium' ELSE 'low' END AS severity, final_price,
    coalesce(nullif(concat_ws(' | ', CASE WHEN final_price < 0 THEN format('NEGATIVE PRICE (${{:.2f}}) for ', final_price) || category || ' in ' || region WHEN final_price < 1.0 THEN format('Near-zero price (${{:.2f}}) for ', final_price) || category
      WHEN surge_multiplier > 10 THEN format('Extreme surge ({{:.1f}}x) pushing ', surge_multiplier) || category || format(' to ${{:.2f}}', final_price) WHEN surge_multiplier > 5 THEN format('High surge ({{:.1f}}x) on ', surge_multiplier) || category || format(', price=${{:.2f}}', final_price) END,
      CASE WHEN rule_violations <> 'none' THEN 'Rule violations: ' || rule_violations END), ''),
      'Anomalous pricing for ' || category || format(': ${{:.2f}} (surge={{:.2f}}x) in ', final_price, surge_multiplier) || region) AS description,
    round(CASE WHEN final_price < {_AVG} THEN abs(final_price - {_AVG}) ELSE abs(final_price - {_AVG}) * 2.0 END, 2) AS estimated_impact_usd FROM al0)"""


def zone_sql(ranges) -> str:
    return " OR ".join(f"(PULocationID >= {a} AND PULocationID < {b})" for a, b in ranges)


TRIPS = f"""tr0 AS (SELECT event_id, ts AS "timestamp", (event_id * 13 % 320)::DOUBLE AS duration_minutes, round(pow((event_id * 7 % 1050) / 100.0, 3) / 11, 2)::DOUBLE AS distance_miles,
    round(value * 1.2 - 5, 2)::DOUBLE AS final_price, 1 + event_id % 263 AS PULocationID FROM events),
hc AS (SELECT hour("timestamp") AS h, count(*) AS n FROM tr0 GROUP BY 1),
tx AS (SELECT event_id, "timestamp", CASE WHEN distance_miles <= 2 THEN 'ride_short' WHEN distance_miles <= 5 THEN 'ride_standard' WHEN distance_miles <= 15 THEN 'ride_long' ELSE 'ride_premium' END AS category,
    3.50 + distance_miles * 2.50 AS base_price, final_price / (3.50 + distance_miles * 2.50) AS surge_multiplier, final_price, greatest(n / (SELECT max(n) FROM hc), 0.05) AS demand_level,
    least(greatest(1.0 - greatest(n / (SELECT max(n) FROM hc), 0.05) * 0.6, 0.05), 1.0) AS supply_level, distance_miles, duration_minutes,
    CASE WHEN {zone_sql(DOWNTOWN_ZONES)} THEN 'downtown' WHEN {zone_sql(AIRPORT_ZONES)} THEN 'airport' ELSE 'suburbs' END AS region
  FROM tr0 JOIN hc ON h = hour("timestamp") WHERE duration_minutes > 0.5 AND duration_minutes < 300 AND distance_miles > 0 AND distance_miles < 100 AND final_price > 0 AND final_price < 500),
tl AS (SELECT *, CASE WHEN surge_multiplier > 5 THEN 'extreme_surge' WHEN distance_miles > 50 THEN 'extreme_distance' WHEN distance_miles < 0.5 AND final_price > 50 THEN 'short_distance_high_price' WHEN final_price > 200 THEN 'extreme_price' END AS anomaly_type FROM tx)"""


def prf(tp="tp", fp="fp", fn="fn") -> str:
    p, r = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END)", f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END)"
    return f"round({p}, 4) AS precision, round({r}, 4) AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END, 4) AS f1"


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
