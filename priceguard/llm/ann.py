"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are lifted so that the largest inner product is the least distance, and projected on
Gaussian (2-stable) directions; a hash is the number of the slot of fixed width that a
projection falls in, a bucket is one slot for each of several directions, and a table is one
choice of directions.  A query visits perturbed buckets of every table in the order of their
estimated chance of holding a neighbour (the chance that a neighbour at the usual distance has
each of those slots) until the chances add up to ``SUCCESS``.  The candidates of all tables are
merged and ranked by exact inner products of the original vectors.

Vectors that are equal are indexed once, with their least ids.  Buckets are dealt to cells of a
bounded number of bytes, and buckets larger than a cell are spread over several; a cell that
many queries visit is given to several tasks.  So neither copies, nor a bucket, nor queries at
one place meet in one task.  Only slot width, neighbour distance and number of directions are
fitted, on at most ``SAMPLE`` vectors; every vector is indexed.

Defined cases: ids are integers.  Vectors that are null, zero, of another length than most
(the longer at a tie), or with null or non-finite components, and rows without an id, take no
part.  Rows that repeat an id with an equal vector count once; with another vector each row is
a query of its own, and rows with the query's id are never its candidates.  Fewer candidates
than k: what is found.  An empty table gives an empty table; other columns are ignored.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import mixed
from .storage import discard, materialize

TABLES = 4
SUCCESS = 0.55  # estimated chance, per table, at which probing ends
PROBES = 256  # the number of directions is chosen so that so many buckets reach it
SAMPLE = 2048
CELL_BYTES = 16 << 20
ASKED = 8192  # queries of a cell that one task takes
_GRID = np.linspace(-8, 8, 8001)
_NORMAL = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in _GRID])


def usable(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(F.col(vec_id).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("v") == (lengths["d"] if lengths else 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """rep, ids, v: one row per distinct vector with its k + 1 least ids (the group limit acts before the shuffle)."""
    place = F.dense_rank().over(W.partitionBy("h", "v").orderBy("vec_id"))
    few = rows.withColumn("h", F.xxhash64("v")).withColumn("place", place).filter(F.col("place") <= k + 1)
    held = few.groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return held.select(F.col("ids")[0].alias("rep"), "ids", "v")


@dataclass(frozen=True)
class Hashing:
    """Fitted parameters: directions (table, function, component), offsets, slot width, neighbour distance, largest norm."""

    directions: np.ndarray
    offsets: np.ndarray
    multipliers: np.ndarray
    width: float
    near: float
    norm: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Points on a sphere, so that the order of inner products is that of distances."""
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(1 - (x**2).sum(1, keepdims=True), 0))])

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])

    def places(self, points: np.ndarray, table: int) -> np.ndarray:
        return points @ self.directions[table].T / self.width + self.offsets[table]

    def keys(self, slots: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((slots.astype(np.uint64) * self.multipliers[table]).sum(-1, dtype=np.uint64)).view(np.int64)

    def probes(self, points: np.ndarray, table: int, most: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of perturbed buckets, most likely first; which of them to visit; the chance of all so far."""
        at = self.places(points, table)
        home = np.floor(at)
        steps, rest, scale = np.arange(-1, 2), at - home, self.width / self.near
        chance = np.interp((steps + 1 - rest[:, :, None]) * scale, _GRID, _NORMAL) - np.interp((steps - rest[:, :, None]) * scale, _GRID, _NORMAL)
        # the likeliest buckets have likely beginnings, so keeping the `most` likeliest beginnings loses none
        total, moved = np.ones((len(at), 1)), np.zeros((len(at), 1, 0), np.int8)
        for f in range(at.shape[1]):
            total = (total[:, :, None] * chance[:, f, None, :]).reshape(len(at), -1)
            grown = np.repeat(moved, 3, axis=1)
            last = np.broadcast_to(np.tile(steps, moved.shape[1])[None, :, None], (*grown.shape[:2], 1)).astype(np.int8)
            moved = np.concatenate([grown, last], axis=2)
            if total.shape[1] > most:
                keep = np.argpartition(-total, most - 1, axis=1)[:, :most]
                total, moved = np.take_along_axis(total, keep, 1), np.take_along_axis(moved, keep[:, :, None], 1)
        order = np.argsort(-total, axis=1, kind="stable")
        total, moved = np.take_along_axis(total, order, 1), np.take_along_axis(moved, order[:, :, None], 1)
        upto = np.cumsum(total, axis=1)
        return home[:, None, :].astype(np.int64) + moved, (upto - total) < SUCCESS, upto


def fit(known: DataFrame, k: int, n: int, tables: int = TABLES, sample: int = SAMPLE, seed: int = 7) -> Hashing | None:
    """Slot width, usual neighbour distance and number of directions from at most ``sample`` vectors (those with the least hash)."""
    picked = known.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()
    norm = known.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    if not len(picked):
        return None
    x, rng = np.stack(picked["v"].to_numpy()), np.random.default_rng(seed)
    base = Hashing(np.zeros((0, 0, 0)), np.zeros((0, 0)), np.zeros((0, 0), np.uint64), 1.0, 1.0, norm)
    points, asked = base.lifted(x), base.asked(x[:256])
    gaps = np.sqrt(np.maximum(2 - 2 * asked @ points.T, 0))
    gaps[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    usual = float(np.sqrt(np.mean(gaps[np.isfinite(gaps)] ** 2))) if len(x) > 1 else 1.0
    rank = min(max(len(x) - 2, 0), math.ceil(k * len(x) / max(n, 1)) - 1)
    near = float(np.quantile(np.sort(gaps, axis=1)[:, rank], 0.7)) if len(x) > 1 else 1.0
    usual, near = max(usual, 1e-6), max(near if np.isfinite(near) else usual, 1e-6)
    directions = rng.standard_normal((tables, 64, x.shape[1] + 1))
    offsets, multipliers = rng.random((tables, 64)), rng.integers(1, 1 << 62, (tables, 64)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    found = None
    for m in range(4, max(5, min(64, int(math.log2(max(n, 2) / 8)) + 1))):
        tried = Hashing(directions[:, :m], offsets[:, :m], multipliers[:, :m], 2 * usual, near, norm)
        reached = tried.probes(asked[:64], 0)[2][:, -1]
        if found is not None and np.quantile(reached, 0.2) < SUCCESS:
            break
        found = tried
    return found


def _members(batches, hashing: Hashing):
    for batch in batches:
        if batch.num_rows:
            points = hashing.lifted(_matrix(batch.column("v")))
            for t in range(len(hashing.directions)):
                key = hashing.keys(np.floor(hashing.places(points, t)).astype(np.int64), t)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c) for c in ("rep", "ids", "v"))], names=["key", "rep", "ids", "v"])


def _visits(batches, hashing: Hashing):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            points, reps = hashing.asked(_matrix(part.column("v"))), part.column("rep").to_numpy()
            for t in range(len(hashing.directions)):
                slots, visit, _ = hashing.probes(points, t)
                key = hashing.keys(slots, t)
                yield pa.RecordBatch.from_pydict({"q": np.repeat(reps, visit.sum(1)), "key": key[visit]})


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rank(members: pa.Table, asked: pa.Table, k: int, tables: int) -> pa.Table:
    """For each query the k + 1 best members among the buckets it visits: exact products, summed in one order."""
    members = members.take(np.argsort(members.column("key").to_numpy(), kind="stable"))
    x, key, rep = _matrix(members.column("v")), members.column("key").to_numpy(), members.column("rep").to_numpy()
    bucket, first = np.unique(key, return_index=True)
    ends = np.append(first[1:], len(key))
    q, reps, lists = _matrix(asked.column("v")), asked.column("q").to_numpy(), asked.column("keys").to_pylist()
    out_q, out_m, out_s = [], [], []
    for at in range(0, len(q), 128):
        block, open_ = q[at : at + 128], np.zeros((min(128, len(q) - at), len(bucket)), bool)
        for i, wanted in enumerate(lists[at : at + 128]):
            place = np.searchsorted(bucket, wanted)
            place[place == len(bucket)] = 0
            open_[i, place[bucket[place] == wanted]] = True
        dense = 8 * (open_ @ (ends - first)).sum() > open_.shape[0] * len(key)
        near = block @ x.T if dense else None
        for i in range(len(block)):
            if dense:
                rows = np.flatnonzero(np.repeat(open_[i], ends - first))
                rough = near[i, rows]
            else:
                spans = np.flatnonzero(open_[i])
                rows = np.concatenate([np.arange(first[b], ends[b]) for b in spans]) if len(spans) else np.zeros(0, np.int64)
                rough = x[rows] @ block[i]
            enough = (k + 1) * tables  # a vector is here once for each table at most
            if len(rows) > enough:  # rough products differ in their last digits only: keep all that could be among the best
                cut = np.partition(rough, len(rough) - enough)[len(rough) - enough]
                rows = rows[rough >= cut - 1e-9 * max(1.0, np.abs(rough).max())]
            rows = rows[np.unique(rep[rows], return_index=True)[1]]
            exact = (x[rows] * block[i]).sum(1)
            best = np.lexsort((rep[rows], -exact))[: k + 1]
            out_q.append(np.full(len(best), reps[at + i]))
            out_m.append(rows[best])
            out_s.append(exact[best])
    m = np.concatenate(out_m) if out_m else np.zeros(0, np.int64)
    found = {"q": pa.array(np.concatenate(out_q), pa.int64()), "rep": members.column("rep").take(m), "ids": members.column("ids").take(m), "score": pa.array(np.concatenate(out_s), pa.float64())}
    return pa.table(found)


def search(vectors: DataFrame, asked: Column, k: int = 20, vec_id: str = "vec_id", column: str = "embedding", cell_bytes: int = CELL_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each row where ``asked`` holds (a condition on ``vec_id``)."""
    rows = usable(vectors.withColumn("vec_id", F.col(vec_id).cast("long")), "vec_id", column)
    known = materialize(classes(rows, k), "vectors")
    queries = rows.filter(asked).select("vec_id", "v").distinct().join(known.select("rep", F.col("v").alias("w")), F.col("v") == F.col("w"))
    queries = materialize(queries.select(F.col("vec_id").alias("query_id"), "rep"), "asked")
    n = known.count()
    hashing = fit(known, k, n)
    if hashing is None:
        return known.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cell_rows = max(256, cell_bytes // (8 * (hashing.directions.shape[2] - 1)))
    cells = max(1, math.ceil(n * len(hashing.directions) / cell_rows))

    members = materialize(known.mapInArrow(lambda b: _members(b, hashing), "key long, rep long, ids array<long>, v array<double>"), "members")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
    large = materialize(sizes.select(F.col("key").alias("large"), F.ceil(F.col("n") / cell_rows).cast("int").alias("parts")), "large-buckets")
    own = F.when(F.col("large").isNull(), F.pmod(F.xxhash64("key"), F.lit(cells)))
    placed = members.join(large, F.col("key") == F.col("large"), "left").select(
        "key", "rep", "ids", "v", own.otherwise(F.pmod(F.xxhash64("key", F.pmod(F.hash("rep"), "parts")), F.lit(cells))).alias("cell")
    )
    points = known.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    visits = points.mapInArrow(lambda b: _visits(b, hashing), "q long, key long").join(large, F.col("key") == F.col("large"), "left")
    every = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda p: F.when(F.col("large").isNull(), F.pmod(F.xxhash64("key"), F.lit(cells))).otherwise(F.pmod(F.xxhash64("key", p), F.lit(cells))))
    visits = visits.select("q", "key", F.explode(F.array_distinct(every)).alias("cell")).groupBy("cell", "q").agg(F.collect_set("key").alias("keys"))
    visits = materialize(visits, "visits")
    shares = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("shares"))
    shares = materialize(shares, "shares")
    right = visits.join(shares, "cell").withColumn("share", F.pmod(F.hash("q"), "shares")).join(points.withColumnRenamed("rep", "q"), "q").select("cell", "share", "q", "keys", "v")
    left = placed.join(shares, "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("cell", "share", "key", "rep", "ids", "v")
    found = left.groupBy("cell", "share").cogroup(right.groupBy("cell", "share")).applyInArrow(lambda m, a: _rank(m, a, k, len(hashing.directions)), "q long, rep long, ids array<long>, score double")
    found = materialize(found, "found")
    for table in (members, large, visits, shares, known):
        discard(table)

    best = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "rep"))
    top = found.repartition("q").dropDuplicates(["q", "rep"]).withColumn("place", best).filter(F.col("place") <= k + 1)
    one = top.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score")).alias("near"))
    own = queries.join(one, F.col("rep") == F.col("q")).select("query_id", F.filter(F.array_sort("near"), lambda e: e["vec_id"] != F.col("query_id")).alias("near"))
    ranked = own.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("rank", "e"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")
