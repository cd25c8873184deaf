"""Exact percentiles without a buffer of all values.

A sketch of bounded size brackets every wanted rank of every group between two values; a second
pass counts what lies below a bracket and the values inside it, a few thousandths of the
rows, which settles the ranks exactly.  A bracket is checked by its counts (one that misses its
rank is widened to all values), and brackets that hold too many rows for the driver are sorted
over the cluster.  So neither many distinct values nor one group need memory in one task.
Tables of at most ``BUFFER`` values go to the exact aggregate, whose buffers that bounds; the
results are the same.
"""

from math import ceil, floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

ACCURACY = 10_000  # of the sketch
MARGIN = 0.001  # of the rows, on either side of a rank
SMALL = 3000  # a group of fewer rows is looked at whole
GROUPS = 2000  # tables of more groups are sorted as a whole
BUFFER = 1_000_000  # values that the exact aggregate may hold
INSIDE = 200_000  # rows (values with counts) that the driver takes


def _value(column: str) -> Column:
    v = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(v), v)


def _places(n: int, fraction: float) -> tuple[float, int, int]:
    at = (n - 1) * fraction
    return at, floor(at), ceil(at)


def _between(at: float, lo: int, hi: int, low: float, high: float) -> float:
    return low if lo == hi else (hi - at) * low + (at - lo) * high


def percentiles(rows: DataFrame, fractions: dict[str, list[float]], by: list[str] = (), more: dict[str, Column] | None = None, n: int | None = None) -> DataFrame:
    """``by`` and for each column an array of its percentiles under its own name, interpolated between neighbouring ranks.

    Null and NaN values are left out; a group without values has nulls.  Without ``by`` there is one row.
    ``more`` are other aggregates, by name, that the first pass takes along; ``n``, if known, is the number of rows.
    """
    by, more = list(by), more or {}
    if n is None or n > BUFFER or more:
        counts = [a for a in (F.count(_value(c)) for c in fractions)]
        groups = rows.groupBy(*by).agg(*counts, *[c.alias(k) for k, c in more.items()]).limit(GROUPS + 1).toArrow()
        if groups.num_rows > GROUPS:
            found = _by_sorting(rows, fractions, by)
            return _beside(found, rows.groupBy(*by).agg(*[c.alias(k) for k, c in more.items()]), by) if more else found
        n = sum(sum(groups.column(len(by) + k).to_pylist()) for k in range(len(fractions)))
    if n <= BUFFER:  # so the exact aggregate's buffers hold no more values than that
        cells = [F.percentile(_value(c), F.array(*[F.lit(float(f)) for f in fractions[c]])).alias(c) for c in fractions]
        found = rows.groupBy(*by).agg(*cells)
    else:
        found = _bracketed(rows, fractions, by)
    if not more:
        return found
    kinds = rows.groupBy(*by).agg(*[c.alias(k) for k, c in more.items()]).schema
    held = rows.sparkSession.createDataFrame(groups.select([*range(len(by)), *range(len(by) + len(fractions), groups.num_columns)]), kinds)
    return _beside(found, held, by)


def _beside(found: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    renamed = other.withColumnsRenamed({c: f"__by{k}" for k, c in enumerate(by)})
    same = F.lit(True)
    for k, c in enumerate(by):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"__by{k}"))
    return found.join(renamed, same).drop(*[f"__by{k}" for k in range(len(by))])


def _bracketed(rows: DataFrame, fractions: dict[str, list[float]], by: list[str]) -> DataFrame:
    spark = rows.sparkSession
    wanted = [(c, f) for c in fractions for f in fractions[c]]
    ends = {c: [g for f in fractions[c] for g in (max(0.0, f - MARGIN), min(1.0, f + MARGIN))] for c in fractions}
    sketches = [a for c in fractions for a in (F.count(_value(c)), F.percentile_approx(_value(c), F.array(*map(F.lit, ends[c])), ACCURACY))]
    groups = rows.groupBy(*by).agg(*sketches).collect()
    sizes, brackets = {}, {}
    for g, row in enumerate(groups):
        for k, c in enumerate(fractions):
            n, guess = row[len(by) + 2 * k : len(by) + 2 * k + 2]
            for i, f in enumerate(fractions[c]):
                sizes[g, c, f] = n
                if n:
                    lo, hi = guess[2 * i : 2 * i + 2]
                    few = n < SMALL
                    brackets[g, c, f] = (lo if f > MARGIN and not few else float("-inf"), hi if f < 1 - MARGIN and not few else float("inf"))
    found = _settled(rows, by, groups, wanted, sizes, brackets) if brackets else {}
    out = [(*row[: len(by)], *[[found[g, c, f] for f in fractions[c]] if sizes[g, c, fractions[c][0]] else None for c in fractions]) for g, row in enumerate(groups)]
    kinds = rows.select(*by, *[F.lit(None).cast("array<double>").alias(c) for c in fractions]).schema
    return spark.createDataFrame(_table(out, kinds.names), kinds)


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array(list(c)) for c in zip(*rows, strict=True)] if rows else [pa.array([]) for _ in names], names=names)


def _settled(rows: DataFrame, by: list[str], groups: list, wanted: list, sizes: dict, brackets: dict) -> dict:
    """The percentiles of all groups from one count of what lies below and in the brackets."""
    spark = rows.sparkSession
    numbers, names = {x: k for k, x in enumerate(brackets)}, list(brackets)
    kinds = spark.createDataFrame([], rows.select(*[F.col(f"`{c}`").alias(f"__by{k}") for k, c in enumerate(by)], F.lit(0).alias("__c"), F.lit(0).alias("__t"), F.lit(0.0).alias("__lo"), F.lit(0.0).alias("__hi")).schema).schema
    columns = list(dict.fromkeys(c for c, _ in wanted))
    known = [(*groups[g][: len(by)], columns.index(c), t, *brackets[g, c, f]) for (g, c, f), t in numbers.items()]
    known = F.broadcast(spark.createDataFrame(_table(known, kinds.names), kinds))  # a row per group and percentile, GROUPS groups at most
    same = F.col("__x.c") == F.col("__c")
    for k, c in enumerate(by):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"__by{k}"))
    cells = F.array(*[F.struct(F.lit(k).alias("c"), _value(c).alias("v")) for k, c in enumerate(columns)])
    hits = rows.select(*by, F.explode(cells).alias("__x")).join(known, same & (F.col("__x.v") <= F.col("__hi")))
    inside = F.when(F.col("__x.v") >= F.col("__lo"), F.col("__x.v"))  # null: below the bracket
    counts = hits.groupBy(F.col("__t").alias("t"), inside.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.limit(INSIDE + 1).collect()
    wanted_at = {(g, c, f): _places(sizes[g, c, f], f) for g, c, f in numbers}
    if len(held) > INSIDE:
        ranks = _sorted_ranks(hits, inside, {t: wanted_at[x][1:] for x, t in numbers.items()})
    else:
        ranks, upto = {}, {}
        for r in sorted(held, key=lambda r: (r["v"] is not None, r["v"])):
            before = upto.get(r["t"], 0)
            upto[r["t"]] = before + r["n"]
            if r["v"] is not None:
                ranks |= {(r["t"], k): r["v"] for k in wanted_at[names[r["t"]]][1:] if before <= k < before + r["n"]}
    out, missed = {}, {}
    for x, t in numbers.items():
        at, lo, hi = wanted_at[x]
        if (t, lo) in ranks and (t, hi) in ranks:
            out[x] = _between(at, lo, hi, ranks[t, lo], ranks[t, hi])
        else:
            missed[x] = (float("-inf"), float("inf"))
    return out | (_settled(rows, by, groups, wanted, sizes, missed) if missed else {})


def _sorted_ranks(hits: DataFrame, inside: Column, wanted: dict) -> dict:
    """The values at the wanted places of brackets that hold many rows, from a sort of those over the cluster."""
    below = {r["t"]: r["n"] for r in hits.filter(inside.isNull()).groupBy(F.col("__t").alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = ranked(hits.filter(inside.isNotNull()).select(F.col("__t").alias("t"), F.col("__x.v").alias("v")), ["v"], ["t"])
    spots = [(t, r - below.get(t, 0)) for t, places in wanted.items() for r in set(places)]
    spots = hits.sparkSession.createDataFrame(_table(spots, ["t", "place"]), "t int, place long")
    return {(r["t"], r["place"] + below.get(r["t"], 0)): r["v"] for r in placed.join(F.broadcast(spots), ["t", "place"]).collect()}  # a row per rank


def _by_sorting(rows: DataFrame, fractions: dict[str, list[float]], by: list[str]) -> DataFrame:
    """The same from places in a range-partitioned sort, for any number of groups."""
    out = rows.select(*by).distinct()
    for name, wanted in fractions.items():
        placed = ranked(rows.select(*by, _value(name).alias("__v")).filter("__v is not null"), ["__v"], by, "__at", total="__n")
        spots = F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("__n") - 1) * F.lit(float(f))).alias("at")) for k, f in enumerate(wanted)])
        share = F.col("s.at") - F.floor("s.at")
        near = placed.withColumn("s", F.explode(spots)).withColumn("w", F.when(F.col("__at") == F.floor("s.at"), 1 - share).when(F.col("__at") == F.floor("s.at") + 1, share))
        one = near.filter("w > 0").groupBy(*by, "s.k").agg(F.sum(F.col("w") * F.col("__v")).alias("p"))
        lists = one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias(name))
        held = lists.select(*[F.col(f"`{c}`").alias(f"__by{k}") for k, c in enumerate(by)], name)
        same = F.lit(True)
        for k, c in enumerate(by):
            same &= F.col(f"`{c}`").eqNullSafe(F.col(f"__by{k}"))
        out = out.join(held, same, "left").drop(*[f"__by{k}" for k in range(len(by))])
    return out
