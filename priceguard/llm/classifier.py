"""Quality classifier as a sparse rule ensemble.

Boosted shallow trees over text statistics are grown on a bounded sample of labelled rows;
the path to every tree node becomes a conjunctive rule; lasso logistic regression keeps a few
rules with weights; these compile into one Spark column expression that scores all documents
inside the JVM.  Statistics come from the text alone: labels, language, source and id are
never inputs.

Defined cases: null text counts as empty and is scored; without labelled rows, or with one
class only, the score is the constant share of label 1 (0.5 without rows); rows repeated or
with null ids are scored alike; an empty table gives an empty table.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import clean_lines
from .text import let, whole, words

SAMPLE_ROWS = 20_000


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``stats`` of doubles."""
    t = whole(docs["text"])
    marks = F.array(F.regexp_count(t, F.lit(r"[.!?]+(\s|$)")), F.regexp_count(t, F.lit("!")), F.size(F.split(t, "\n")))
    spread = let(
        words(docs["text"]),
        lambda w: F.struct(
            F.size(F.array_distinct(w)).alias("distinct"),
            F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x)).alias("echo"),
        ),
    )
    both = clean_lines(docs).withColumn("__spread", spread).withColumn("__marks", marks)
    q, s, m = both["quality"], both["__spread"], both["__marks"]
    n = F.greatest(q["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    stats = {
        "words": q["n_words"],
        "word_length": q["word_chars"] / n,
        "symbols": q["n_symbols"] / chars,
        "repeated_lines": q["n_dup_lines"] / m[2],
        "repeated_words": q["n_repeat_words"] / n,
        "passing_lines": q["kept_share"],
        "distinct": s["distinct"] / n,
        "echo": s["echo"] / n,
        "sentences": m[0] / n,
        "shouts": m[1] / n,
    }
    packed = F.struct(*[v.cast("double").alias(k) for k, v in stats.items()])
    return both.withColumn("stats", packed).drop("quality", "__spread", "__marks")


@dataclass(frozen=True)
class RuleModel:
    """intercept, and rules: (weight, ((statistic, above, threshold), ...))."""

    intercept: float
    rules: tuple = ()

    def score(self, stats: Column) -> Column:
        """The compiled expression: logistic of the summed weights of the rules that hold."""
        total = F.lit(float(self.intercept))
        for weight, tests in self.rules:
            holds = F.lit(True)
            for name, above, at in tests:
                holds = holds & ((stats[name] > at) if above else (stats[name] <= at))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, tests in self.rules:
            total += weight * holds_all(x, [(names.index(n), a, t) for n, a, t in tests])
        return 1 / (1 + np.exp(-total))


def holds_all(x: np.ndarray, tests) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for f, above, at in tests:
        mask &= (x[:, f] > at) if above else (x[:, f] <= at)
    return mask


def grow(x: np.ndarray, residual: np.ndarray, curvature: np.ndarray, cuts: list[np.ndarray], depth: int, least: int):
    """One tree on gradients: its node paths, and the value it adds to each row."""
    paths, value = [], np.zeros(len(x))

    def split(rows: np.ndarray, path: tuple, left: int) -> None:
        g, h = residual[rows], curvature[rows]
        best = None
        if left and len(rows) >= 2 * least:
            whole_gain = g.sum() ** 2 / (h.sum() + 1)
            for f, at in enumerate(cuts):
                slot = np.searchsorted(at, x[rows, f], side="left")
                gs = np.cumsum(np.bincount(slot, g, len(at) + 1))[:-1]
                hs = np.cumsum(np.bincount(slot, h, len(at) + 1))[:-1]
                ns = np.cumsum(np.bincount(slot, minlength=len(at) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole_gain
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
                    best = (gain.max(), f, float(at[int(gain.argmax())]))
        if path:
            paths.append(path)
        if best is None:
            value[rows] = g.sum() / (h.sum() + 1)
            return
        _, f, at = best
        low = x[rows, f] <= at
        split(rows[low], (*path, (f, False, at)), left - 1)
        split(rows[~low], (*path, (f, True, at)), left - 1)

    split(np.arange(len(x)), (), depth)
    return paths, value


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, shrink: float = 0.3, lasso: float = 2e-4, rounds: int = 400) -> RuleModel:
    """Rules from boosted trees, weighted by lasso logistic regression (accelerated proximal gradient)."""
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return RuleModel(base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    margin, found = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, value = grow(x, y - p, np.maximum(p * (1 - p), 1e-6), cuts, depth, max(10, len(y) // 500))
        margin += shrink * value
        for path in paths:
            found.setdefault(tuple(sorted(path)), None)
    rules = list(found)
    z = np.array([holds_all(x, r) for r in rules], dtype=float).T
    weight, fast, b, fast_b, t = np.zeros(len(rules)), np.zeros(len(rules)), base, base, 1.0
    step = 4 * len(y) / (np.linalg.norm(z, 2) ** 2 + len(y))
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(z @ fast + fast_b))) - y) / len(y)
        new = fast - step * (z.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        new_b, new_t = fast_b - step * error.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        fast, fast_b = new + (t - 1) / new_t * (new - weight), new_b + (t - 1) / new_t * (new_b - b)
        weight, b, t = new, new_b, new_t
    kept = [(float(w), tuple((names[f], a, v) for f, a, v in r)) for w, r in zip(weight, rules, strict=True) if abs(w) > 1e-3]
    return RuleModel(float(b), tuple(kept))


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fifth, those with the smallest id hash."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("__label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows
    rows = statistics(picked).select("stats.*", "__label").collect()
    names = statistics(docs.select("doc_id", "text")).schema["stats"].dataType.names
    x = np.array([[r[n] for n in names] for r in rows], dtype=float).reshape(len(rows), len(names))
    order = np.lexsort(x.T) if len(rows) else []
    return fit_rules(x[order], np.array([float(r["__label"]) for r in rows])[order] if len(rows) else np.zeros(0), names)


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = statistics(docs.select("doc_id", "text")).withColumn("score", model.score(F.col("stats")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
