"""Detector comparison on one labelled batch."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators import evaluate, neighbors, rules, svm
from ..operators.ensemble import EnsembleDetector
from ..sources.scratch import written


def compare_detectors(events: DataFrame, settings: Settings = DEFAULT, slow: bool = True) -> tuple[DataFrame, DataFrame]:
    """(leaderboard by F1, recall per type) on the last fifth; ``slow`` adds LOF, DBSCAN and the SVM."""
    split = written(evaluate.train_test(events), "split")
    train, test = (split.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    scored = rules.validate(EnsembleDetector(settings).fit(train).predict(test), settings.rules)
    flags = evaluate.flags_of(scored)
    if slow:
        scored = scored.join(neighbors.local_outlier_factor(split.drop("split")), "event_id").join(neighbors.density_clusters(split.drop("split")), "event_id")
        scored = scored.join(svm.OneClassSVM().fit(train).predict(test), "event_id")
        flags |= {"lof": F.col("lof_anomaly"), "dbscan": F.col("dbscan_anomaly"), "one_class_svm": F.col("svm_anomaly")}
    scored = written(scored, "compared")
    return evaluate.prf_by_method(scored, flags).orderBy(F.col("f1").desc(), "method"), evaluate.type_recall(scored)


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Evaluations of several runs as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def main(args: list[str] | None = None) -> None:
    """Command line: --file TRIPS [--max-rows N] [--anomaly-rate R] [--no-inject] [--fast]: leaderboard and recall per type."""
    import argparse

    from pyspark.sql import SparkSession

    from ..sources.trips import load_and_transform

    p = argparse.ArgumentParser()
    p.add_argument("--file", required=True)
    p.add_argument("--max-rows", type=int, default=100_000)
    p.add_argument("--anomaly-rate", type=float, default=0.03)
    p.add_argument("--no-inject", action="store_true")
    p.add_argument("--fast", action="store_true")
    a = p.parse_args(args)
    events, _ = load_and_transform(SparkSession.builder.getOrCreate(), a.file, a.max_rows, not a.no_inject, a.anomaly_rate)
    for table in compare_detectors(ranked(events), slow=not a.fast):
        table.show(100, False)


def ranked(events: DataFrame) -> DataFrame:
    """``events`` with dense ids in time order, as the split by position needs them.

    Days are ordered by a sum per day, so only the rows of a day are ranked in one task.
    """
    from pyspark.sql import Window as W

    day = F.to_date("timestamp")
    sizes = events.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("day", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("day").orderBy("timestamp", "event_id"))
    placed = events.withColumn("day", day).join(before, "day").withColumn("place", F.col("before") + place - 1)
    return placed.select(*[(F.col("place") if c == "event_id" else F.col(c)).alias(c) for c in events.columns])


if __name__ == "__main__":
    main()
