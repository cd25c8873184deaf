"""Mixing sources to target weights by Pareto order sampling (native).

Sources in code point order (null last) weigh 5, 2, 1, repeating.  A source's target stops at
``max_repeats`` times its size and the excess is reshared by weight; this is a water level,
so it is solved in closed form over one row per source.  Each document gets the whole copies
its source's target is certain to hold.  The remaining words are an order sample: document i
has inclusion odds p/(1-p) with p proportional to its size, draws random odds u/(1-u) from a
hash of its id, and documents are taken in the order of random odds over inclusion odds until
the words are used up; the last one is taken in part, so the total is exact.

Only (doc_id, source, size) leaves the scan.  A hot source is never gathered: the cut is
found on 4096 sums per source and only the slice holding the cut is ordered.

Defined cases: null text has size 0; an empty document is never taken; a null source is a
source of its own, last; a null doc_id draws as the text 'null'; rows equal in id and size
draw alike, and where the cut falls on such rows each gets the cut's part; an empty table
gives an empty table; other columns pass through, and one named ``mix`` is replaced.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize
from .text import word_count, words

WEIGHTS = (5, 2, 1)
SLICES = 4096
BROADCAST_SOURCES = 10_000


def random_unit(doc_id, seed: int):
    """A number in (0, 1) fixed by the id and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def order_key(size, unit, rest, squares):
    """Random odds over inclusion odds, squeezed into (0, 1); 1 for documents that cannot be drawn."""
    p = F.least(rest.cast("double") * size.cast("double") / squares, F.lit(0.999999))
    ratio = (unit / (1 - unit)) * ((1 - p) / p)
    return F.when((size > 0) & (rest > 0), ratio / (1 + ratio)).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """source, source_size, squares, target, copies, rest: one row per source."""
    by_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum((F.col("size") * F.col("size")).cast("decimal(28,0)")).cast("double").alias("squares"),
    )
    named = W.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(int(w)) for w in weights])
    level = W.orderBy(F.col("cap") / F.col("weight"), "place")
    ranked = (
        by_source.withColumn("place", F.row_number().over(named))
        .withColumn("weight", F.element_at(table, (F.col("place") - 1) % len(weights) + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats)
    )
    leveled = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(level.rowsBetween(0, W.unboundedFollowing)).alias("open"),
        F.sum("source_size").over(W.partitionBy()).alias("total"),
    ).withColumn("height", (F.col("total") - F.col("full")).cast("double") / F.col("open"))
    water = F.max(F.when(F.col("height") <= F.col("cap") / F.col("weight"), F.col("height"))).over(W.partitionBy())
    poured = leveled.select("*", water.alias("water")).withColumn(
        "target",
        F.least(F.coalesce(F.col("weight") * F.col("water"), F.col("cap").cast("double")), F.col("cap").cast("double")),
    )
    size = F.greatest(F.col("source_size"), F.lit(1))
    copies = F.floor(F.col("target") / size).cast("long")
    return poured.select(
        "source", "source_size", "squares", "target", copies.alias("copies"),
        F.greatest(F.round("target").cast("long") - copies * F.col("source_size"), F.lit(0)).cast("long").alias("rest"),
    )


def mixing_table(docs: DataFrame, seed: int = 7, weights=WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """One row per source: its target and where its order sample is cut."""
    sizes = materialize(
        docs.select("doc_id", "source", word_count(docs["text"]).alias("size")), "mix-sizes"
    )
    targets = materialize(source_targets(sizes, weights, max_repeats).coalesce(1), "mix-targets")
    keyed = _with_table(sizes, targets).withColumn(
        "key", order_key(F.col("size"), random_unit(F.col("doc_id"), seed), F.col("rest"), F.col("squares"))
    ).filter((F.col("key") < 1) & (F.col("rest") > 0))
    keyed = keyed.withColumn("slice", F.floor(F.col("key") * SLICES).cast("int"))
    running = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    cut = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        .select(F.col("source").alias("s"), F.col("slice").alias("c"), "before")
    )
    inside = keyed.join(cut, keyed["source"].eqNullSafe(cut["s"]) & (keyed["slice"] == cut["c"]))
    ordered = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        inside.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
        .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
        .groupBy(F.col("source").alias("s"))
        .agg(F.min(F.struct("key", "doc_id", (F.col("rest") - F.col("before")).alias("part"))).alias("cut"))
    )
    return targets.join(edge, targets["source"].eqNullSafe(edge["s"]), "left").drop("s")


def _with_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join rows to the per-source table; it is broadcast only after its rows were counted."""
    few = table.count() <= BROADCAST_SOURCES
    side = table.withColumnRenamed("source", "__source")
    joined = rows.join(
        F.broadcast(side) if few else side, rows["source"].eqNullSafe(side["__source"]), "left"
    )
    return joined.drop("__source")


def plan_mixture(docs: DataFrame, seed: int = 7, weights=WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """``docs`` with a struct ``mix``: size, source_size, target, copies (whole), part (words of one more copy), taken."""
    table = materialize(mixing_table(docs, seed, weights, max_repeats).coalesce(1), "mix-table")
    packed = table.select("source", F.struct("source_size", "squares", "target", "copies", "rest", "cut").alias("__m"))
    sized = docs.select("*", word_count(docs["text"]).alias("__size"))
    m, size = F.col("__m"), F.col("__size")
    key = order_key(size, random_unit(F.col("doc_id"), seed), m["rest"], m["squares"])
    cut = m["cut"]
    at = F.struct(F.col("__key").alias("key"), F.col("doc_id").alias("doc_id"))
    end = F.struct(cut["key"].alias("key"), cut["doc_id"].alias("doc_id"))
    part = (
        F.when(cut.isNull() | (size == 0) | (m["rest"] <= 0), F.lit(0))
        .when(at < end, size)
        .when((cut["key"] == F.col("__key")) & cut["doc_id"].eqNullSafe(F.col("doc_id")), F.least(cut["part"], size))
        .otherwise(F.lit(0))
        .cast("long")
    )
    return (
        _with_table(sized, packed)
        .withColumn("__key", key)
        .withColumn("__part", part)
        .select(
            *[F.col(f"`{c}`") for c in docs.columns if c != "mix"],
            F.struct(
                size.alias("size"),
                m["source_size"].alias("source_size"),
                m["target"].alias("target"),
                m["copies"].alias("copies"),
                F.col("__part").alias("part"),
                (m["copies"] * size + F.col("__part")).alias("taken"),
            ).alias("mix"),
        )
    )


def mixed_documents(docs: DataFrame, seed: int = 7, weights=WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """The mix itself: every whole copy as a row, and the part of a copy as its first words."""
    planned = plan_mixture(docs, seed, weights, max_repeats)
    mix = planned["mix"]
    cut_text = F.when(mix["part"] == mix["size"], F.col("text")).otherwise(
        F.array_join(F.slice(words(F.col("text")), F.lit(1), mix["part"].cast("int")), " ")
    )
    whole_copy = F.struct(F.col("text").alias("t"))
    part_copy = F.struct(cut_text.alias("t"))
    copies = F.concat(
        F.array_repeat(whole_copy, mix["copies"].cast("int")),
        F.when(mix["part"] > 0, F.array(part_copy)).otherwise(F.array().cast("array<struct<t:string>>")),
    )
    out = planned.withColumn("__copy", F.explode(copies))
    return out.withColumn("text", F.col("__copy")["t"]).select(*[F.col(f"`{c}`") for c in docs.columns])
