"""Merkle manifest of a dataset: a persistent tree with path copying.

Every row is a leaf: the SHA-256 of its fields.  Per group, leaves in order form a binary tree
whose root is the subroot; the subroots, in order of their groups, form the upper tree.  A
changed leaf makes a version of the tree: copies of the leaf's ancestors alone, which point to
the untouched nodes of the first version for everything else.

Leaves get their places from a range-partitioned sort and sums of the partitions' counts.  A
task builds the subtree of an aligned block of ``2 ** LEVELS`` leaves, and copies there the
ancestors of the changed ones; the blocks' tops are the leaves of the next round, so n leaves
take log(n) / ``LEVELS`` rounds of shrinking tables.  What a version's path meets in upper
rounds is the same for its whole block and is joined once a block, where the version goes on.

Defined cases: a null field is ``-``; rows with one id are leaves of their own, in order of
their digests (null ids first); an empty table gives an empty table; a group of one row has the
leaf itself as its subroot, and a single subroot is the root; other columns pass through.
"""

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import discard, materialize, renamed

LEVELS = 10
STEP = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` as a written table with __place (from 0) and __n (rows) within the group, null groups being one.

    A range-partitioned sort and a number per row, less the first number of the group's stretch in
    that partition, plus the stretches before it: nothing is ranked in one task.
    """
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)  # equal rows are interchangeable
    numbered = materialize(ordered.withColumn("__number", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__number", 33)
    stretches = numbered.groupBy(F.col(group).alias("__sg"), part.alias("__part")).agg(F.min("__number").alias("__first"), F.count(F.lit(1)).alias("__m"))
    by = W.partitionBy("__sg")
    upto = F.sum("__m").over(by.orderBy("__part").rowsBetween(W.unboundedPreceding, 0))
    stretches = stretches.select("__sg", "__part", (upto - F.col("__m") - F.col("__first")).alias("__shift"), F.sum("__m").over(by).alias("__n"))
    same = F.col(group).eqNullSafe(F.col("__sg")) & (part == F.col("__part"))
    out = numbered.join(stretches, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__number") + F.col("__shift")).alias("__place"), "__n")
    out = materialize(out, "leaves")
    discard(numbered)
    return out


def parents(level: list[str]) -> list[str]:
    """Every two nodes in a row, and a last one that is left over, become their digest."""
    return [sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]


def block_paths(digests: list[str], height: int, changed: list[str | None]) -> tuple[list[list[dict]], list[list[str]], str]:
    """Of one aligned block: the siblings beside each leaf's path, the ancestors that each changed leaf copies, and the top."""
    levels = [digests]
    for _ in range(height):
        levels.append(parents(levels[-1]))
    steps = [[{"left": row[i - 1] if i % 2 else "", "right": row[i + 1] if i % 2 == 0 and i + 1 < len(row) else ""} for i in range(len(row))] for row in levels[:-1]]
    paths = [[steps[h][i >> h] for h in range(height)] for i in range(len(digests))]
    copies = []
    for path, new in zip(paths, changed, strict=True):
        version = [] if new is None else [new]
        for step in path if version else ():
            version.append(sha256((step["left"] + version[-1] + step["right"]).encode()).hexdigest())
        copies.append(version)
    return paths, copies, levels[-1][0]


def _height(n: int, levels: int) -> int:
    return min(levels, max(n - 1, 0).bit_length())


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (__g, __place, __n, __digest, __changed and others) with __path, __version (copied nodes) and __top of their blocks."""
    added = {"__path": STEP, "__version": "array<string>", "__top": "string"}
    schema = nodes.select("*", *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("__place")
        height = _height(table.column("__n")[0].as_py(), levels)
        paths, copies, top = block_paths(table.column("__digest").to_pylist(), height, table.column("__changed").to_pylist())
        step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        table = table.append_column("__path", pa.array(paths, step)).append_column("__version", pa.array(copies, pa.list_(pa.string())))
        return table.append_column("__top", pa.array([top] * len(table), pa.string()))

    return nodes.groupBy("__g", F.shiftright("__place", levels).alias("__block")).applyInArrow(build, schema)


def continued(version: Column, path: Column) -> Column:
    """A version's copied nodes, followed by those that it copies along a further path."""
    up = lambda v, s: F.concat(v, F.array(F.sha2(F.concat(s["left"], F.element_at(v, -1), s["right"]), 256)))
    return F.when(F.size(version) > 0, F.aggregate(path, version, up)).otherwise(version)


def tree(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (__g, __place, __n, __digest, __changed, others) with __path to the group's root, __version along it and __root; a written table."""
    inside = materialize(_blocks(nodes, levels), "blocks")
    if not inside.filter(F.col("__n") > (1 << levels)).limit(1).count():
        return renamed(inside, __top="__root")
    first = F.pmod("__place", F.lit(1 << levels)) == 0
    tops = inside.filter(first).select(
        "__g", F.shiftright("__place", levels).alias("__place"), F.shiftright(F.col("__n") + ((1 << levels) - 1), levels).alias("__n"),
        F.col("__top").alias("__digest"), F.lit(None).cast("string").alias("__changed"),
    )
    upper = tree(tops, levels)
    above = upper.select(F.col("__g").alias("__ug"), F.col("__place").alias("__up"), F.col("__path").alias("__upper"), F.col("__root").alias("__root"))
    same = F.col("__g").eqNullSafe(F.col("__ug")) & (F.shiftright("__place", levels) == F.col("__up"))
    kept = [c for c in inside.columns if c not in ("__path", "__version", "__top")]
    out = inside.join(above, same).select(*kept, F.concat("__path", "__upper").alias("__path"), continued(F.col("__version"), F.col("__upper")).alias("__version"), "__root")
    out = materialize(out, "paths")
    discard(inside)
    discard(upper)
    return out


def manifest(rows: DataFrame, fields: list[Column], changed: list[Column], tampered: Column, group: Column, doc_id: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """``doc_id``, leaf, subroot, root, path (siblings from leaf to root), version (nodes that a changed leaf copies, itself first).

    ``changed`` are the fields of the leaf where ``tampered`` holds; ``version`` is empty elsewhere.
    """
    digest, other = leaf_digest(fields), leaf_digest(changed)
    leaves = rows.select(
        F.col(doc_id).alias("__id"), group.alias("__g"), digest.alias("__digest"), F.when(tampered, other).alias("__changed")
    )
    leaves = placed(leaves, "__g", ["__id", "__digest"])
    lower = tree(leaves, levels)
    discard(leaves)
    subroots = lower.filter("__place = 0").select(F.lit(0).alias("__all"), F.col("__g").alias("__name"), F.col("__root").alias("__digest"), F.lit(None).cast("string").alias("__changed"))
    subroots = placed(subroots, "__all", ["__name"])
    upper = tree(subroots.withColumnRenamed("__all", "__g"), levels)
    discard(subroots)
    ends = upper.select("__name", F.col("__path").alias("__upper"), F.col("__root").alias("root"))
    return lower.join(ends, F.col("__g").eqNullSafe(F.col("__name"))).select(
        F.col("__id").alias(doc_id), F.col("__digest").alias("leaf"), F.col("__root").alias("subroot"), "root",
        F.concat("__path", "__upper").alias("path"), continued(F.col("__version"), F.col("__upper")).alias("version"),
    )


def documents_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``documents`` by language; a document whose id has a CRC-32 that 7 divides is tampered with: n_chars grows by 1."""
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    other = [F.col("n_chars") + 1 if k == 3 else c for k, c in enumerate(plain)]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return manifest(docs, plain, other, tampered, F.col("lang"), levels=levels)


def verified(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    proof = F.sha2(F.aggregate("path", F.lit(""), lambda a, s: F.concat(a, s["left"], s["right"])), 256)
    folded = F.element_at(continued(F.array("leaf"), F.col("path")), -1)
    folded = F.when(F.size("version") > 0, F.element_at("version", -1)).otherwise(folded)
    out = found.select(doc_id, "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
