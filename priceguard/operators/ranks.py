"""Places in an order without a task that holds all rows: a range-partitioned sort, a number per row, and sums of the partitions' counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written


def ranked(rows: DataFrame, order: list, by: list[str] = (), name: str = "place", total: str | None = None, write: bool = True) -> DataFrame:
    """``rows``, as a written table, with ``name``, the place (from 0) in the order among the rows with equal ``by`` (nulls are equal).

    ``order`` are column names or columns; rows that are equal in all of them get places in any order.
    ``total`` names a column for the number of rows with equal ``by``.  Without ``write`` only the sorted rows are a table, and the join of the sums stays a plan.
    """
    keys = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in (*by, *order)]
    numbered = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__number", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__number", 33)
    held = [F.col(f"`{c}`").alias(f"__by{k}") for k, c in enumerate(by)]
    stretches = numbered.groupBy(*held, part.alias("__part")).agg(F.min("__number").alias("__first"), F.count(F.lit(1)).alias("__m"))
    over = W.partitionBy(*[f"__by{k}" for k in range(len(by))])
    upto = F.sum("__m").over(over.orderBy("__part").rowsBetween(W.unboundedPreceding, 0))
    stretches = stretches.withColumn("__shift", upto - F.col("__m") - F.col("__first")).withColumn("__n", F.sum("__m").over(over))  # a row per partition and key
    same = part == F.col("__part")
    for k, c in enumerate(by):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"__by{k}"))
    more = [F.col("__n").alias(total)] if total else []
    placed = numbered.join(stretches, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__number") + F.col("__shift")).alias(name), *more)
    if not write:
        return placed
    out = written(placed, "placed")
    dropped(numbered)
    return out
