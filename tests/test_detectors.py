import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceguard.config import TUNED
from priceguard.functions.clean import ingest
from priceguard.functions.features import FEATURES, engineer_features
from priceguard.operators import context, forest, neighbors, quantiles, ranks, stats, svm
from priceguard.operators.ensemble import EnsembleDetector, fuse
from priceguard.operators.forecast import PENALTY, Forecaster, design, without_forecast

from .helpers import events, hourly

RUSH = {0: 0, 3: 0, 6: 0, 7: 1, 8: 1, 9: 1, 10: 0, 12: 0, 15: 0, 16: 0, 17: 1, 18: 1, 19: 1, 20: 0, 23: 0}


def test_features(spark):
    rows = engineer_features(events(spark, *[dict(timestamp=dt.datetime(2024, 6, 3, h)) for h in RUSH])).collect()
    assert rows[0].__fields__ == ["event_id", *FEATURES] and len(FEATURES) == 15
    assert {h: int(r["is_rush_hour"]) for h, r in zip(RUSH, sorted(rows, key=lambda r: r["event_id"]), strict=True)} == RUSH
    odd = events(spark, dict(final_price=float("nan"), surge_multiplier=float("inf"), distance_miles=None), dict(distance_miles=0.0, duration_minutes=0.0, base_price=0.0, supply_level=0.0, demand_level=0.0))
    for r in engineer_features(ingest(odd)).collect():
        assert all(math.isfinite(r[n]) for n in FEATURES)
    assert [r["is_weekend"] for r in engineer_features(events(spark, *[dict(timestamp=dt.datetime(2024, 6, d)) for d in (7, 8, 9, 10)])).orderBy("event_id").collect()] == [0, 1, 1, 0]
    assert engineer_features(events(spark, {}).drop("timestamp")).columns == ["event_id", *[n for n in FEATURES if not n.startswith(("hour", "is_"))]]


def test_planted_outlier(spark):
    e = events(spark, *hourly(1000, outliers={500: dict(final_price=500.0, surge_multiplier=25.0)}))
    got = EnsembleDetector(TUNED).fit(e).predict(e)
    r = got.filter("event_id = 500").first()
    assert r["anomaly_score"] > 0.5 and r["is_anomaly"] and r["n_methods_flagged"] == 3
    assert got.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()[0] >= 0 and got.count() == 1000
    assert got.orderBy(F.col("anomaly_score").desc()).first()["event_id"] == 500


@pytest.mark.parametrize("changes", [
    [dict(final_price=20.0) for _ in range(30)], hourly(15), hourly(60, categories=("a", "b", "c", "d", "e")), hourly(50, outliers={10: dict(final_price=1e6), 20: dict(final_price=float("inf"), distance_miles=0.0), 30: dict(final_price=float("nan"))}),
    [dict(timestamp=dt.datetime(2024, 6, 1)) for _ in range(20)],
])
def test_odd_batches(spark, changes):
    e = ingest(events(spark, *changes))
    got = EnsembleDetector(TUNED, use_forest=False).fit(e).predict(e)
    assert got.count() == len(changes)
    assert got.filter("stat_score is null or ctx_score is null or anomaly_score is null or is_anomaly is null or anomaly_score < 0 or anomaly_score > 1").count() == 0


def test_unseen_category_and_single_row(spark):
    train = events(spark, *hourly(50), dict(category="lonely", final_price=30.0))
    st = stats.category_stats(train)
    lonely = st.filter("category = 'lonely'").first()
    assert lonely["price_std"] is None and lonely["price_mad"] == 0
    raw = {r["event_id"]: r for r in stats.with_stats(events(spark, dict(category="new", final_price=7.0), dict(category="lonely", final_price=31.0)), st).collect()}
    assert raw[0]["z_dev"] == 7.0 and abs(raw[0]["mad_dev"] - 0.6745 * 7) < 1e-9 and raw[0]["iqr_dev"] == 5.0
    assert raw[1]["z_dev"] == 1.0  # the spread of a single row is unknown and counts as 1


def test_rolling_by_hand_and_by_day(spark):
    changes = hourly(400, categories=("x", "y"), outliers={k: dict(final_price=60.0) for k in (37, 120, 121, 300)})
    e = events(spark, *changes)
    got = {r["event_id"]: r["stat_rolling"] for r in stats.rolling_flags(e).collect()}
    want = {}
    for c in ("x", "y"):
        ids = [i for i, x in enumerate(changes) if x["category"] == c]
        p = np.array([changes[i]["final_price"] for i in ids])
        for k, i in enumerate(ids):
            hit = False
            for rows in (10, 30, 120):
                w = p[max(0, k - rows + 1) : k + 1]
                hit |= len(w) >= 3 and abs(p[k] - w.mean()) / max(w.std(ddof=1), 0.01) > 2.8
            want[i] = bool(hit)
    assert got == want
    assert {r["event_id"]: r["stat_rolling"] for r in stats.rolling_flags_by_category(e).collect()} == want
    assert not any(r["stat_rolling"] for r in stats.rolling_flags(events(spark, *hourly(9, outliers={8: dict(final_price=999.0)}))).collect())


def test_context_needs_five_rows(spark):
    four = [dict(timestamp=dt.datetime(2024, 6, 3, 1), final_price=20.0 + i) for i in range(4)]
    five = [dict(timestamp=dt.datetime(2024, 6, 3, 5), final_price=20.0 + i) for i in range(5)]
    e = events(spark, *four, *five, dict(timestamp=dt.datetime(2024, 6, 3, 2), final_price=900.0))
    base = context.baselines(e.filter("event_id < 9"))
    got = {r["event_id"]: r for r in context.score(e.union(events(spark, *[{}] * 10, dict(timestamp=dt.datetime(2024, 6, 3, 6), final_price=900.0)).filter("event_id = 10")), base).collect()}
    assert not got[9]["ctx_anomaly"] and got[9]["ctx_score"] == 0
    assert got[10]["ctx_anomaly"] and 0 < got[10]["ctx_score"] <= 1


def test_ensemble_rules(spark):
    df = spark.createDataFrame([(1, 0.21, False, False), (2, 0.0, True, True), (3, 0.0, True, False)], "event_id long, s double, a boolean, b boolean")
    df = df.select("event_id", F.col("a").alias("stat_anomaly"), (F.col("s") / 0.35).alias("stat_score"), F.col("b").alias("ctx_anomaly"), F.lit(0.0).alias("ctx_score"))
    got = {r["event_id"]: r for r in fuse(df, TUNED).collect()}
    assert [got[i]["is_anomaly"] for i in (1, 2, 3)] == [True, True, False]
    assert [got[i]["detection_methods"] for i in (1, 2, 3)] == ["none", "statistical,contextual", "statistical"]


def test_forest(spark):
    e = events(spark, *hourly(300, outliers={7: dict(final_price=400.0, surge_multiplier=20.0)}))
    a = forest.IsolationForest(0.05, 60).fit(e).predict(e)
    b = forest.IsolationForest(0.05, 60).fit(e.repartition(7)).predict(e)
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.orderBy(F.col("if_score").desc()).first()["event_id"] == 7
    assert abs(a.filter("if_anomaly").count() - 15) <= 3
    with pytest.raises(RuntimeError):
        forest.IsolationForest().predict(e)


def test_neighbours_and_svm(spark):
    e = events(spark, *hourly(150, outliers={9: dict(final_price=300.0, surge_multiplier=15.0, distance_miles=80.0)}))
    lof = neighbors.local_outlier_factor(e)
    assert lof.count() == 150 and lof.filter("lof_score < 0 or lof_score > 1").count() == 0
    assert lof.orderBy(F.col("lof_score").desc()).first()["event_id"] == 9 and 10 <= lof.filter("lof_anomaly").count() <= 16
    db = neighbors.density_clusters(e, eps=4.0)
    r = db.filter("event_id = 9").first()
    assert r["dbscan_anomaly"] and r["dbscan_score"] == 1.0 and r["dbscan_cluster"] == -1
    assert db.filter("dbscan_cluster >= 0").count() > 100
    one = svm.OneClassSVM().fit(e)
    got = one.predict(e)
    assert 8 <= got.filter("svm_anomaly").count() <= 22 and got.filter("svm_score < 0 or svm_score > 1").count() == 0
    assert got.filter("event_id = 9").first()["svm_anomaly"]


@pytest.mark.parametrize("nu, parts", [(0.1, 1), (0.1, 7), (0.3, 4)])
def test_svm_against_a_solver_in_numpy(spark, nu, parts):
    e = events(spark, *hourly(700, outliers={9: dict(final_price=300.0, surge_multiplier=15.0), 50: dict(final_price=None)}))
    one = svm.OneClassSVM(nu=nu, components=64).fit(e.repartition(parts))
    mean, spread, freq, phase, w, rho = one.model
    x = engineer_features(e).orderBy("event_id").toPandas()[FEATURES].to_numpy(float)
    assert np.allclose(mean, x.mean(0)) and np.allclose(spread, np.where(x.std(0) > 0, x.std(0), 1))
    m = svm.fourier(x, mean, spread, freq, phase)
    assert ((m**2).sum(1) <= 2 + 1e-9).all()
    best, n, share_left = m.mean(0), nu * len(m), 2e-3
    for _ in range(50_000):  # steps with an exact line search towards the mean of the lowest rows
        order = np.argsort(m @ best)
        share = np.clip(n - np.arange(len(m)), 0, 1)
        way = best - (share @ m[order]) / n
        if best @ way <= share_left * (best @ best):
            break
        best = best - min(1.0, best @ way / (way @ way)) * way
    assert best @ way <= share_left * (best @ best)
    assert len(one.gaps) <= svm.STEPS and one.gaps[-1] <= one.tolerance
    order = np.argsort(m @ w)
    assert w @ (w - (share @ m[order]) / n) <= 1.5 * one.tolerance * (w @ w)  # with the exact lowest rows, not a bin's
    assert np.abs(m @ (w - best)).max() <= np.sqrt(2) * (np.sqrt(1.5 * one.tolerance) + np.sqrt(share_left)) * np.linalg.norm(best)
    assert rho == pytest.approx(np.quantile(m @ w, nu), abs=1e-9)
    got = one.predict(e).orderBy("event_id").toPandas()
    assert abs(got["svm_anomaly"].mean() - nu) < 2 / 700
    assert (got["svm_anomaly"].to_numpy() == (m @ w - rho < -1e-12)).mean() > 0.997


def test_svm_on_odd_tables(spark):
    none = svm.OneClassSVM(components=8).fit(events(spark, {}).limit(0))
    assert none.predict(events(spark, {}, {})).filter("svm_anomaly").count() == 0
    same = svm.OneClassSVM(components=8).fit(events(spark, *[{}] * 30))
    assert same.predict(events(spark, *[{}] * 5)).filter("svm_anomaly").count() in (0, 5) and same.gaps[-1] <= same.tolerance
    assert same.predict(events(spark, {}).limit(0)).count() == 0


def plain_points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "event_id long, x array<double>")


def plain_distances(x):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    return d


def uneven(n, seed=0):
    """Points of several densities, a tenth of them twice."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * (1 + 3 * (rng.random((n, 1)) < 0.1)) + 8 * rng.integers(0, 3, (n, 1))
    x[n // 2 : n // 2 + n // 10] = x[: n // 10]
    return x


@pytest.mark.parametrize("block", [16, 100, 4096])
def test_neighbours_against_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    x = uneven(300)
    points, d = plain_points(spark, x), plain_distances(x)
    got = {r["event_id"]: [n["other"] for n in r["near"]] for r in neighbors.nearest(points, 5).collect()}
    assert got == {i: np.lexsort((np.arange(300), d[i]))[:5].tolist() for i in range(300)}
    some = points.filter("event_id % 7 = 0")
    among = {r["event_id"]: [n["other"] for n in r["near"]] for r in neighbors.nearest(some, 3, points.filter("event_id % 2 = 1")).collect()}
    for i in range(0, 300, 7):
        odd = [j for j in np.lexsort((np.arange(300), d[i])) if j % 2 and j != i]
        assert among[i] == odd[:3]
    for radius in (0.4, 1.5, 40.0):
        assert {r["event_id"]: r["n"] for r in neighbors.radius_counts(points, radius).collect()} == {i: int((d[i] <= radius).sum()) for i in range(300)}
    assert neighbors.nearest(points.limit(0), 3).count() == 0 and neighbors.nearest(points.limit(2), 3).selectExpr("size(near) n").first()["n"] == 1


@pytest.mark.parametrize("radius", [0.3, 0.8, 3.0])
def test_links_join_what_lies_within_the_radius(spark, monkeypatch, radius):
    monkeypatch.setattr(neighbors, "BLOCK", 24)
    x = uneven(250, 1)
    points, d = plain_points(spark, x), plain_distances(x)
    links = neighbors.radius_links(points, radius)
    roots = {r["event_id"]: r["root"] for r in neighbors._labels(links, points).collect()}
    want = list(range(250))
    while True:
        new = [min([want[i], *(want[j] for j in np.flatnonzero(d[i] <= radius))]) for i in range(250)]
        if new == want:
            break
        want = new
    assert [roots[i] for i in range(250)] == want


def plain_dbscan(x, eps, least):
    d = plain_distances(x)
    near = d <= eps
    core = near.sum(1) + 1 >= least
    label, number = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            front = [i]
            while front:
                k = front.pop()
                if label[k] < 0:
                    label[k] = number
                    front += np.flatnonzero(near[k] & core & (label < 0)).tolist()
            number += 1
    for i in np.flatnonzero(~core):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if core[j]]
        if order and d[i, order[0]] <= eps:
            label[i] = label[order[0]]
    return label


def test_clusters_equal_plain_numpy_on_ten_thousand_rows(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.3, 4000), ((5, 5), 0.4, 3000), ((0, 6), 0.2, 2000), ((9, 0), 3.0, 1000))])
    x = rng.permutation(x)
    e = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "event_id long, a double, b double")
    scaled = (x - x.mean(0)) / x.std(0)
    monkey = neighbors.engineer_features
    neighbors.engineer_features = lambda events: events
    try:
        got = {r["event_id"]: r["dbscan_cluster"] for r in neighbors.density_clusters(e, eps=0.08, names=["a", "b"]).collect()}
    finally:
        neighbors.engineer_features = monkey
    want = plain_dbscan(scaled, 0.08, 10)
    assert [got[i] for i in range(len(x))] == want.tolist() and want.max() >= 2 and (want < 0).sum() > 50


@pytest.mark.parametrize("case", ["small", "plain", "sorted_brackets", "many_groups", "missed"])
def test_percentiles_are_exact(spark, monkeypatch, case):
    monkeypatch.setattr(quantiles, "BUFFER", 10**6 if case == "small" else 0)
    if case == "sorted_brackets":
        monkeypatch.setattr(quantiles, "INSIDE", 5)
        monkeypatch.setattr(quantiles, "SMALL", 100)
    if case == "many_groups":
        monkeypatch.setattr(quantiles, "GROUPS", 1)
    if case == "missed":
        monkeypatch.setattr(quantiles, "SMALL", 0)  # brackets so narrow for so few rows that some miss
    rng = np.random.default_rng(2)
    rows = [(k % 3 if k % 10 else None, float(v), float(round(v))) for k, v in enumerate(np.concatenate([rng.normal(0, 1, 900), rng.lognormal(0, 8, 300), np.zeros(300)]))]
    rows += [(7, None, 1.0), (7, float("nan"), 2.0), (8, 5.0, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(4)
    fractions = {"a": [0.0, 0.1, 0.5, 0.95, 1.0], "b": [0.25, 0.5]}
    got = {r["g"]: (r["a"], r["b"]) for r in quantiles.percentiles(df, fractions, ["g"]).collect()}
    clean = df.withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    cells = [F.percentile(c, F.array(*[F.lit(x) for x in f])).alias(c) for c, f in fractions.items()]
    want = {r["g"]: (r["a"], r["b"]) for r in clean.groupBy("g").agg(*cells).collect()}
    assert set(got) == set(want)
    for g in want:
        for x, y in zip(got[g], want[g], strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-12, abs=1e-12)), (g, x, y)
    assert quantiles.percentiles(df, {"a": [0.5]}).first()["a"] == pytest.approx(clean.agg(F.percentile("a", F.array(F.lit(0.5))).alias("p")).first()["p"])
    assert quantiles.percentiles(df.limit(0), {"a": [0.5]}, ["g"]).count() == 0
    beside = {r["g"]: (r["a"][0], r["n"]) for r in quantiles.percentiles(df.filter("g < 3"), {"a": [0.5]}, ["g"], {"n": F.count(F.lit(1))}).collect()}
    assert beside == {g: (want[g][0][2], df.filter(F.col("g") == g).count()) for g in (0, 1, 2)}


def test_places_in_an_order(spark):
    rows = [(k % 2 if k % 5 else None, (k * 37) % 101, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, v int, k int").repartition(5)
    for r in ranks.ranked(df, ["v", "k"], ["g"], total="n").collect():
        same = sorted((v, k) for g, v, k in rows if g == r["g"])
        assert r["place"] == same.index((r["v"], r["k"])) and r["n"] == len(same)
    assert sorted(r["place"] for r in ranks.ranked(df, [F.desc("v")], write=False).collect()) == list(range(200))


def test_rolling_units_and_halos(spark, monkeypatch):
    """Small units, all rows on one instant or one day, null times: the same flags as one window per category."""
    monkeypatch.setattr(stats, "UNIT", 128)
    changes = hourly(700, categories=("x", "x", "y"), outliers={k: dict(final_price=60.0) for k in (37, 120, 121, 300, 500)})
    for change in ({}, {"timestamp": dt.datetime(2024, 6, 3)}, {"timestamp": None}):
        e = events(spark, *[{**c, **change} for c in changes])
        one = {r["event_id"]: r["stat_rolling"] for r in stats.rolling_flags_by_category(e).collect()}
        assert {r["event_id"]: r["stat_rolling"] for r in stats.rolling_flags(e).collect()} == one and any(one.values())


def test_forecast(spark):
    changes = []
    for h in range(24 * 10):
        price = 20 + 5 * math.sin(2 * math.pi * h / 24)
        changes += [dict(timestamp=dt.datetime(2024, 6, 1) + dt.timedelta(hours=h, minutes=m), final_price=price + 0.2 * (m % 3)) for m in (0, 20, 40)]
    changes[400] |= dict(final_price=80.0)
    e = events(spark, *changes, dict(category="rare", timestamp=dt.datetime(2024, 6, 2)))
    f = Forecaster().fit(e)
    got = f.predict(e)
    r = {x["event_id"]: x for x in got.collect()}
    assert len(r) == len(changes) + 1 and r[400]["ts_anomaly"] and r[400]["ts_score"] > 0.5
    assert not r[len(changes)]["ts_anomaly"] and r[len(changes)]["ts_expected"] is None and r[len(changes)]["ts_score"] == 0
    future = f.forecast("ride_standard", 24).orderBy("hour").collect()
    assert len(future) == 24 and all(abs(x["ts_expected"] - (20.2 + 5 * math.sin(2 * math.pi * k / 24))) < 1 for k, x in enumerate(future))
    assert f.components("ride_standard").columns[-3:] == ["trend", "daily", "weekly"]
    assert without_forecast(e).columns[-5:] == ["ts_anomaly", "ts_score", "ts_expected", "ts_lower", "ts_upper"]
    with pytest.raises(RuntimeError):
        Forecaster().predict(e)


def plain_bands(hours, y, at, width=0.95):
    """The whole series at once: ridge by NumPy and a residual quantile."""
    x = np.column_stack(design(hours, hours.min(), hours.max()))
    beta = np.linalg.solve(x.T @ x + np.diag(PENALTY), x.T @ y)
    low, high = np.quantile(y - x @ beta, [(1 - width) / 2, (1 + width) / 2])
    expected = np.column_stack(design(at, hours.min(), hours.max())) @ beta
    return expected, expected + low, expected + high


def test_bands_equal_numpy_and_hold_their_share(spark):
    rng, changes = np.random.default_rng(1), []
    for c, level in (("ride_pool", 8.0), ("ride_standard", 20.0)):
        for h in range(500 if c == "ride_pool" else 90):
            changes.append(dict(category=c, timestamp=dt.datetime(2024, 6, 1) + dt.timedelta(hours=h), final_price=level + math.sin(2 * math.pi * h / 24) + float(rng.normal(0, 0.3))))
    e = events(spark, *changes).repartition(3)
    f = Forecaster().fit(e)
    series = {c: sorted((r["hour"], r["mean"]) for r in f.series.collect() if r["category"] == c) for c in ("ride_pool", "ride_standard")}
    got = {(r["category"], r["hour"]): r for r in f.bands(f.series).collect()}
    ahead = {(r["category"], r["hour"]): r for c in series for r in f.forecast(c, 12).collect()}
    for c, rows in series.items():
        hours = np.array([(t - dt.datetime(1970, 1, 1)).total_seconds() / 3600 for t, _ in rows])
        y = np.array([m for _, m in rows])
        at = np.concatenate([hours, hours.max() + np.arange(1, 13)])
        want = plain_bands(hours, y, at)
        times = [t for t, _ in rows] + [rows[-1][0] + dt.timedelta(hours=k) for k in range(1, 13)]
        for k, t in enumerate(times):
            r = got[c, t] if k < len(rows) else ahead[c, t]
            assert (r["ts_expected"], r["ts_lower"], r["ts_upper"]) == pytest.approx(tuple(w[k] for w in want), abs=1e-6)
        inside = np.mean([got[c, t]["ts_lower"] <= m <= got[c, t]["ts_upper"] for t, m in rows])
        assert abs(inside - 0.95) < 0.03


def test_spanning_links_connect_what_is_close():
    rng = np.random.default_rng(3)
    for density in (0.0, 0.02, 0.1, 0.9):
        close = rng.random((40, 30)) < density
        rows, columns = neighbors.spanning_links(close)
        name = {**{("r", i): ("r", i) for i in range(40)}, **{("c", j): ("c", j) for j in range(30)}}
        for i, j in zip(*np.nonzero(close), strict=True):
            a, b = name["r", i], name["c", j]
            name = {k: a if v == b else v for k, v in name.items()}
        for i in range(40):
            assert rows[i] <= i and name["r", i] == name["r", rows[i]]
            assert [rows[k] == rows[i] for k in range(40)] == [name["r", k] == name["r", i] for k in range(40)]
        assert all((columns[j] < 0) == (not close[:, j].any()) and (columns[j] < 0 or name["c", j] == name["r", columns[j]]) for j in range(30))


def test_copies_are_searched_once(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    x = uneven(120, 5)
    x[20:110] = x[3]
    points, d = plain_points(spark, x), plain_distances(x)
    held = neighbors.Cells(points, 6)
    assert held.classes.count() == len(np.unique(x, axis=0)) and held.members.count() == 120
    near = {r["event_id"]: [n["other"] for n in r["near"]] for r in neighbors.nearest(points, 5, limit=2.0).collect()}
    want = {i: [j for j in np.lexsort((np.arange(120), d[i]))[:5].tolist() if d[i, j] <= 2.0] for i in range(120)}
    assert near == {i: js for i, js in want.items() if js}
    roots = {r["event_id"]: r["root"] for r in neighbors._roots(points, 0.5).collect()}
    assert len(roots) == 120 and all(roots[i] == roots[j] for i, j in zip(*np.nonzero(d <= 0.5), strict=True))


@pytest.fixture
def tables(monkeypatch):
    """Rows of each table that the neighbour operators write, by name."""
    rows, write = {}, neighbors.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(neighbors, "written", counted)
    return rows


def test_points_whose_hashes_meet_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "_hash", lambda x: F.lit(7).cast("long"))
    x = uneven(60, 2)
    classes, members = neighbors._distinct(plain_points(spark, x), 3)
    want = {int(np.flatnonzero((x == r).all(1))[0]): np.flatnonzero((x == r).all(1)).tolist() for r in x}
    assert {r["pid"]: (r["n"], r["ids"]) for r in classes.collect()} == {p: (len(ids), ids[:3]) for p, ids in want.items()}
    assert {r["event_id"]: r["pid"] for r in members.collect()} == {i: p for p, ids in want.items() for i in ids}


def test_outlier_factors_of_copies_take_a_row_a_point(spark, monkeypatch, tables):
    monkeypatch.setattr(neighbors, "engineer_features", lambda events: events)
    x = uneven(120, 5)[:, :2]
    x[20:110], x[112:115] = x[3], x[111]
    e = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "event_id long, a double, b double")
    got = {r["event_id"]: r["lof_score"] for r in neighbors.local_outlier_factor(e, 5, names=["a", "b"]).collect()}
    scaled = (x - x.mean(0)) / x.std(0)
    d = plain_distances(scaled)
    near = [np.lexsort((np.arange(120), d[i]))[:5] for i in range(120)]
    far = np.array([d[i, js[-1]] for i, js in enumerate(near)])
    density = np.array([1 / (np.maximum(d[i, js], far[js]).mean() + 1e-10) for i, js in enumerate(near)])
    factor = np.array([-density[js].mean() / density[i] for i, js in enumerate(near)])
    assert np.allclose([got[i] for i in range(120)], 1 - (factor - factor.min()) / (np.ptp(factor) + 1e-10), atol=1e-6)
    assert tables["near"] == len(np.unique(x, axis=0)) and neighbors.local_outlier_factor(e.limit(0), names=["a", "b"]).count() == 0
    assert [tuple(r) for r in neighbors.local_outlier_factor(e.limit(1), names=["a", "b"]).collect()] == [(0, False, 0.0)]


def test_distances_and_counts_take_a_row_a_point(spark, tables):
    x = uneven(120, 5)
    x[20:110] = x[3]
    points, d = plain_points(spark, x), plain_distances(x)
    got = {r["event_id"]: (r["k_distance"], r["n"]) for r in neighbors.distances_and_counts(points, 5, 1.5).collect()}
    assert got == {i: (np.sort(d[i])[4], int((d[i] <= 1.5).sum())) for i in range(120)}
    assert tables["near"] == tables["counts"] == len(np.unique(x, axis=0)) and neighbors.distances_and_counts(points.limit(1), 5, 1.5).count() == 0


def test_clusters_of_copies_take_a_row_a_point(spark, monkeypatch, tables):
    monkeypatch.setattr(neighbors, "engineer_features", lambda events: events)
    x = uneven(120, 5)[:, :2]
    x[20:110], x[112:115] = x[3], x[111]
    e = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "event_id long, a double, b double")
    got = {r["event_id"]: r["dbscan_cluster"] for r in neighbors.density_clusters(e, 4, eps=0.4, names=["a", "b"]).collect()}
    want = plain_dbscan((x - x.mean(0)) / x.std(0), 0.4, 4)
    assert [got[i] for i in range(120)] == want.tolist() and want.max() >= 0 and (want < 0).any()
    assert tables["clusters"] == len(np.unique(x, axis=0)) and neighbors.density_clusters(e.limit(0), eps=0.4, names=["a", "b"]).count() == 0


def plain_eps(x, least):
    d = np.sort(np.sort(plain_distances(x), axis=1)[:, min(least, len(x) - 1) - 1])
    return float(np.clip(d[int(np.diff(d, n=2).argmax()) + 1], 0.5, 5.0)) if len(x) > 9 else 1.5


def test_tuned_radius_comes_from_all_points(spark, monkeypatch):
    """The last points of the curve, of which a sample lacks some, make its knee."""
    monkeypatch.setattr(neighbors, "engineer_features", lambda events: events)
    monkeypatch.setattr(neighbors, "EPS_SAMPLE", 60, raising=False)
    x = np.random.default_rng(11).normal(size=(400, 2))
    x[:6] = [(9 + 2 * k, 9 - 3 * k) for k in range(6)]
    x[50:70], x[71] = x[49], x[70]
    e = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "event_id long, a double, b double")
    eps = []
    monkeypatch.setattr(neighbors, "_roots", lambda core, radius, roots=neighbors._roots: eps.append(radius) or roots(core, radius))
    got = {r["event_id"]: r["dbscan_cluster"] for r in neighbors.density_clusters(e, 4, names=["a", "b"]).collect()}
    scaled = (x - x.mean(0)) / x.std(0)
    assert eps == [plain_eps(scaled, 4)] and 0.5 < eps[0] < 5
    want = plain_dbscan(scaled, eps[0], 4)
    assert [got[i] for i in range(400)] == want.tolist() and want.max() >= 0 and (want < 0).any()
    alone = [tuple(r) for r in neighbors.density_clusters(e.limit(1), 4, names=["a", "b"]).collect()]
    assert alone == [(0, True, 0.0, -1)]


@pytest.mark.parametrize("curve", [
    [1.0] * 12, [0.6] * 5 + [0.7] * 5, [0.6, *[0.7] * 9], [*[0.6] * 9, 0.9], [0.1 * k for k in range(12)], [0.5 + 0.1 * k * k for k in range(12)], [*[0.8] * 3, 0.9, 1.5, 1.6, *[2.9] * 4, 3.0], [1.0] * 9,
    [0.75, 1.0, 1.25, 1.5, 1.75, 2.5, 2.75, 3.0, 3.75, 4.0, 4.25], [0.1] * 9 + [7.0, 9.0],
])
def test_knee_of_counted_distances(spark, curve):
    bend = np.diff(np.sort(curve), n=2)
    want = float(np.clip(np.sort(curve)[int(bend.argmax()) + 1], 0.5, 5.0)) if len(curve) > 9 else 1.5
    assert neighbors.knee(spark.createDataFrame([(v, 1) for v in curve], "d double, n long")) == want


def test_forest_without_a_threshold_scores_no_row_for_it(spark, monkeypatch):
    e = events(spark, *hourly(60))
    whole, bare = forest.IsolationForest(0.1, 5).fit(e), forest.IsolationForest(0.1, 5)
    monkeypatch.setattr(forest.IsolationForest, "_scored", lambda *_: pytest.fail("scored"))
    bare.fit(e, threshold=False)
    monkeypatch.undo()
    a, b = (m.predict(e).orderBy("event_id").toPandas() for m in (whole, bare))
    assert bare.offset == -0.5 and np.allclose(a["if_score"], b["if_score"]) and np.allclose(a["if_raw_score"] + whole.offset, b["if_raw_score"] - 0.5)
