"""Null-safe numeric helpers.

NaN and infinities become null at ingest; comparisons with null count as false and
``greatest``/``least`` never turn a null into a bound.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_double(c: Column) -> Column:
    """NaN and infinities to null."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d)


def at_least(c: Column, low: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def ingest(events: DataFrame) -> DataFrame:
    """Cleaned events: every double column without NaN and infinities."""
    doubles = {n for n, k in events.dtypes if k in ("double", "float")}
    return events.select(*[clean_double(F.col(c)).alias(c) if c in doubles else F.col(c) for c in events.columns])
