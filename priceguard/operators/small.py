"""Tables of a few rows: computed once, and broadcast only where their size is known."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

ROWS = 10_000


def held(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` as rows that the plan holds, if there are at most ``rows``; a written table beyond."""
    found = df.limit(rows + 1).toArrow()
    if found.num_rows > rows:
        return written(df, "held")
    out = df.sparkSession.createDataFrame(found, df.schema)
    out.held_rows = found.num_rows
    return out


def hinted(df: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """``columns`` (of ``df``, or ``df`` itself), to be broadcast if ``df`` is known to be small; else the optimiser chooses."""
    out = df if columns is None else columns
    return F.broadcast(out) if "held_rows" in vars(df) else out
