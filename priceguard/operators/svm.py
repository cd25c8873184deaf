"""One-class support vector machine: random Fourier features and a solver over all rows.

In the space of ``components`` random features m the machine is the shortest vector w of the
reduced convex hull: weighted means of the rows whose weights are at most 1 / (nu n) each.
A step needs one aggregate: under the current w the corner of the hull that lies lowest is the
mean of the nu n rows with the least margins, found from sums per bin of margins.  Those
corners, one a step, are held on the driver (``components`` numbers each), and the next w is
the shortest mean of them.  The share w (w - corner) by which w can still be shortened is the
stated tolerance.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import FEATURES, engineer_features
from ..sources.scratch import dropped, written
from .quantiles import percentiles

BINS = 32  # of margins in a step, inside the range where the nu quantile must lie
STEPS = 25
ROUNDING = 1e-12  # margins of equal rows differ by as much, by where they stand in a batch


def fourier(x: np.ndarray, mean, spread, freq, phase) -> np.ndarray:
    """Random features of rows; their squared length is at most 2."""
    return np.sqrt(2 / len(phase)) * np.cos(((x - mean) / spread) @ freq + phase)


def shortest_mean(corners: np.ndarray) -> np.ndarray:
    """The shortest convex combination of a few vectors: weight goes pair by pair from the highest to the lowest."""
    gram = corners @ corners.T
    share = np.full(len(corners), 1 / len(corners))
    for _ in range(5000):
        slope = gram @ share
        low, high = slope.argmin(), np.where(share > 0, slope, -np.inf).argmax()
        bend = gram[low, low] + gram[high, high] - 2 * gram[low, high]
        if slope[high] - slope[low] <= 1e-12 or bend <= 0:
            break
        moved = min(share[high], (slope[high] - slope[low]) / bend)
        share[low] += moved
        share[high] -= moved
    return share @ corners


class OneClassSVM:
    """Radial kernel approximated by ``components`` random features; trained on all rows.

    The offset is the exact nu quantile of training margins, so about nu of the training rows are
    flagged.  Steps end at ``STEPS`` or when w is within ``tolerance`` of the shortest (as a share
    of its squared length), so every margin is within sqrt(2 * tolerance) |w| of the best machine's.  Null, NaN and infinite features count as 0; on an empty table all
    margins are 0 and nothing is flagged.
    """

    def __init__(self, nu: float = 0.10, components: int = 256, seed: int = 42, tolerance: float = 1e-3, names=FEATURES):
        self.nu, self.components, self.seed, self.tolerance, self.names = nu, components, seed, tolerance, names
        self.model: tuple | None = None
        self.gaps: list[float] = []

    def fit(self, events: DataFrame) -> "OneClassSVM":
        rows = written(engineer_features(events).select(*self.names), "svm")
        moments = rows.agg(F.count(F.lit(1)), *[f(c) for f in (F.avg, F.stddev_pop) for c in self.names]).first()
        n, k = moments[0], len(self.names)
        mean, spread = (np.array([v or 0.0 for v in part]) for part in (moments[1 : k + 1], moments[k + 1 :]))
        gamma = 1.0 / max(1, np.count_nonzero(spread > 0))  # of standardised features: one over the number that vary
        spread = np.where(spread > 0, spread, 1.0)
        rng = np.random.default_rng(self.seed)
        freq = rng.normal(0, np.sqrt(2 * gamma), (k, self.components))
        phase = rng.uniform(0, 2 * np.pi, self.components)
        shape = (mean, spread, freq, phase)
        w, corners, level, reach = np.zeros(self.components), [], 0.0, 1e-9
        self.gaps = []
        for _ in range(STEPS if n else 0):
            corner, level = self._lowest(rows, shape, w, n, level, reach)
            gap = float(w @ (w - corner)) / max(float(w @ w), 1e-12) if corners else 1.0
            self.gaps.append(gap)
            if gap <= self.tolerance:
                break
            corners.append(corner)
            step = shortest_mean(np.array(corners)) - w
            w = w + step
            reach = np.sqrt(2) * float(np.linalg.norm(step)) + reach / BINS + 1e-9  # no margin moves further than the first, nor does their quantile
        rho = percentiles(self._margins(rows, (*shape, w, 0.0), []), {"margin": [self.nu]}).first()["margin"]
        self.model = (*shape, w, rho[0] if rho else 0.0)
        dropped(rows)
        return self

    def _lowest(self, rows: DataFrame, shape: tuple, w: np.ndarray, n: int, level: float, reach: float) -> tuple[np.ndarray, float]:
        """Mean of the nu n rows with the least margins, and the margin up to which they go, from one aggregate.

        A task sends a sum of features and a count per bin; of the bin in which the quantile lies
        every row gets the same share.  ``level`` and ``reach`` bound where that is.
        """
        edges = np.linspace(level - reach, level + reach, BINS + 1)
        held, names, size = rows.sparkSession.sparkContext.broadcast((*shape, w, edges)), self.names, self.components

        def sums(frames):
            *shape, w, edges = held.value
            total = np.zeros((BINS + 2, size + 1))
            for f in frames:
                m = fourier(f[names].to_numpy(float), *shape)
                at = np.searchsorted(edges, m @ w, side="right")
                for b in np.unique(at):
                    total[b, :size] += m[at == b].sum(0)
                    total[b, size] += np.count_nonzero(at == b)
            b, d = np.nonzero(total)
            yield pd.DataFrame({"bin": b.astype("int32"), "d": d.astype("int32"), "v": total[b, d]})

        added = rows.mapInPandas(sums, "bin int, d int, v double").groupBy("bin", "d").agg(F.sum("v").alias("v")).toPandas()  # (BINS + 2) * (components + 1) rows at most
        held.unpersist()
        total = np.zeros((BINS + 2, size + 1))
        total[added["bin"], added["d"]] = added["v"]
        counts = total[:, size]
        before = np.cumsum(counts) - counts
        share = np.clip((self.nu * n - before) / np.maximum(counts, 1), 0, 1)
        last = int(np.flatnonzero(share > 0)[-1])
        return share @ total[:, :size] / (self.nu * n), level - reach + (2 * last - 1) * reach / BINS  # the middle of the bin

    def _margins(self, features: DataFrame, model: tuple, keep: list[str]) -> DataFrame:
        held, names = features.sparkSession.sparkContext.broadcast(model), self.names

        def run(frames):
            *shape, w, rho = held.value
            for f in frames:
                yield pd.DataFrame({**{c: f[c] for c in keep}, "margin": fourier(f[names].to_numpy(float), *shape) @ w - rho})

        return features.mapInPandas(run, ", ".join([*[f"{c} long" for c in keep], "margin double"]))

    def predict(self, events: DataFrame) -> DataFrame:
        """event_id, svm_anomaly, svm_score (relative to the batch)."""
        if self.model is None:
            raise RuntimeError("the detector is not fitted")
        raw = self._margins(engineer_features(events), self.model, ["event_id"])
        ends = raw.agg(F.min("margin").alias("lo"), F.max("margin").alias("hi"))
        score = 1.0 - (F.col("margin") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-10)
        return raw.crossJoin(F.broadcast(ends)).select("event_id", (F.col("margin") < -ROUNDING).alias("svm_anomaly"), score.alias("svm_score"))
