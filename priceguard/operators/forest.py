"""Isolation forest: trees grown in tasks from small samples, scoring in Arrow batches."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import FEATURES, engineer_features
from ..sources.scratch import written

POOL = 20_000
SAMPLE = 256


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator, height: int):
    """Flat arrays (feature, cut, left child, path length); feature -1 marks a leaf, the right child follows the left."""
    feature, cut, left, path = [], [], [], []

    def node(rows: np.ndarray, depth: int) -> None:
        """Reserve a node and queue its rows."""
        feature.append(-1)
        cut.append(0.0)
        left.append(0)
        path.append(depth + float(average_path(len(rows))))
        queue.append((len(feature) - 1, rows, depth))

    queue: list = []
    node(np.arange(len(x)), 0)
    while queue:
        at, rows, depth = queue.pop(0)
        if depth >= height or len(rows) <= 1:
            continue
        held = x[rows]
        low, high = held.min(0), held.max(0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            continue
        f = int(usable[int(rng.random() * len(usable))])
        c = rng.uniform(low[f], high[f])
        feature[at], cut[at], left[at] = f, c, len(feature)
        side = held[:, f] < c
        node(rows[side], depth + 1)
        node(rows[~side], depth + 1)
    return np.array(feature, np.int32), np.array(cut), np.array(left, np.int32), np.array(path)


def path_lengths(x: np.ndarray, trees: list, height: int) -> np.ndarray:
    """Mean path length of each row over the trees; leaves lead to themselves, so every row takes ``height`` steps."""
    out = []
    ready = [(np.maximum(f, 0), np.where(f >= 0, cut, np.inf), np.where(f >= 0, left, np.arange(len(f))).astype(np.int64), path) for f, cut, left, path in trees]
    for lo in range(0, len(x), 4096):
        part = np.ascontiguousarray(np.nan_to_num(x[lo : lo + 4096], nan=np.finfo(float).min))
        flat, base = part.ravel(), np.arange(len(part), dtype=np.int64) * part.shape[1]
        total = np.zeros(len(part))
        for feature, cut, left, path in ready:
            at = np.zeros(len(part), np.int64)
            for _ in range(height):
                at = left.take(at) + (flat.take(base + feature.take(at)) >= cut.take(at))
            total += path.take(at)
        out.append(total / len(trees))
    return np.concatenate(out) if out else np.zeros(0)


class IsolationForest:
    """Contamination only moves the threshold; splits are scale-free, so features need no scaling.

    Every tree draws its 256 rows from a pool of at most ``POOL`` rows, those with the smallest
    seeded hash of their id, so a fit is the same for the same rows however they are partitioned.
    """

    def __init__(self, contamination: float = 0.05, trees: int = 200, seed: int = 42, features: list | None = None):
        self.contamination, self.n_trees, self.seed = contamination, trees, seed
        self.names = features or FEATURES
        self.trees: list | None = None
        self.offset = -0.5

    def fit(self, events: DataFrame, threshold: bool = True) -> "IsolationForest":
        """Trees, and the threshold that ``contamination`` gives; without ``threshold`` no row is scored for it, and the offset stays -0.5."""
        features = engineer_features(events)
        pool = features.orderBy(F.xxhash64("event_id", F.lit(self.seed)), "event_id").limit(POOL).toPandas()
        x = pool[self.names].to_numpy(float)
        self.size = min(SAMPLE, max(len(x), 1))
        self.height = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = self._grown(events.sparkSession, x)
        if not threshold:
            return self
        cut = self._scored(features).agg(F.percentile_approx("sample_score", self.contamination, 100_000)).first()[0]
        self.offset = -0.5 if cut is None else float(cut)
        return self

    def _grown(self, spark, x: np.ndarray) -> list:
        """The trees, each from its own seed; the pool is at most ``POOL`` rows, so every task may have it."""
        held, seed, size, height = spark.sparkContext.broadcast(x), self.seed, self.size, self.height

        def grow(frames):
            for f in frames:
                for k in f["id"]:
                    rng, x = np.random.default_rng([seed, int(k)]), held.value
                    drawn = x[rng.choice(len(x), size, replace=False)] if len(x) else x
                    feature, cut, left, path = grow_tree(drawn, rng, height)
                    yield pd.DataFrame({"k": [k], "feature": [feature], "cut": [cut], "left": [left], "path": [path]})

        tasks = max(1, min(self.n_trees, spark.sparkContext.defaultParallelism))
        grown = spark.range(0, self.n_trees, 1, tasks).mapInPandas(grow, "k long, feature array<int>, cut array<double>, left array<int>, path array<double>").toPandas().sort_values("k")
        return [(np.asarray(r.feature, np.int32), np.asarray(r.cut), np.asarray(r.left, np.int32), np.asarray(r.path)) for r in grown.itertuples()]

    def _scored(self, features: DataFrame) -> DataFrame:
        held = features.sparkSession.sparkContext.broadcast((self.trees, self.height, self.names, self.size))

        def run(frames):
            trees, height, names, size = held.value
            for f in frames:
                depth = path_lengths(f[names].to_numpy(float), trees, height)
                yield pd.DataFrame({"event_id": f["event_id"], "sample_score": -np.power(2.0, -depth / max(float(average_path(size)), 1e-9))})

        return features.mapInPandas(run, "event_id long, sample_score double")

    def predict(self, events: DataFrame) -> DataFrame:
        """event_id, if_anomaly, if_score (relative to the batch) and if_raw_score; raw scores are written once."""
        if self.trees is None:
            raise RuntimeError("the detector is not fitted")
        raw = self._scored(engineer_features(events)).select("event_id", (F.col("sample_score") - self.offset).alias("if_raw_score"))
        raw = written(raw, "forest")
        ends = raw.agg(F.min("if_raw_score").alias("lo"), F.max("if_raw_score").alias("hi"))  # one row
        score = 1.0 - (F.col("if_raw_score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-10)
        return raw.crossJoin(F.broadcast(ends)).select("event_id", (F.col("if_raw_score") < 0).alias("if_anomaly"), score.alias("if_score"), "if_raw_score")
