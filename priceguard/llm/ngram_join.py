"""N-gram Jaccard self-join with count-vector R-trees.

A document is the set of its word shingles.  Shingles are hashed into groups, and the counts
per group are a point; two documents cannot share more shingles than the sum of the smaller
coordinates of their points, and no two documents below two tree nodes more than the sum of the
smaller upper corners.  A pair of points that passes is bounded once more over finer groups, one
per 8 shingles, which tells long documents apart.  Points are bulk-loaded into R-trees, trees are joined with themselves
under that bound, and surviving pairs are verified on the sets.

One tree over a corpus would not distribute, so trees are grown in cells.  Documents that link
share a shingle among the first n - ceil(t n) + 1 of each (shingles in one global order), so
cells by those shingles miss no link.  Four steps keep groups of copies from multiplying:

1. documents with equal sets become one vertex, named by a 64-bit hash of the set;
2. cells by four minimum hashes join near copies early: members are linked in their cell until
   they are connected, never pair by pair.  Larger cells are dealt into parts of ``CELL`` members;
   this step may miss links, the next ones may not.  Members without another of like size in
   their cell do not fetch their sets;
3. cells by prefix shingles are looked at only where they hold more than one component, and only
   for members of different components, in blocks where a cell is large.  Linked documents meet
   in the cell of the first shingle that they share, where sizes and places bound their overlap,
   so members are first told apart by those: unrelated texts share ever more shingles as a
   corpus grows, and counts are fetched by the members that are left.  A cell reports its
   members that pass the bound with another component, and which components they connect: no
   more rows than members;
4. the reported members of connected components meet once, with their sets, in one group (in
   blocks where it is large), where links between components are verified.

Components are the result, so pairs inside a component need no further look.  Shingles that are
frequent in a bounded sample come last in the global order, which keeps shared passages out of
the cells; any order is exact.

Defined cases: doc_ids are integers; null and empty texts have empty sets and link with nothing;
in ``near_copies``, rows that share a doc_id are one document, linked with whatever one of its
texts is linked with, and in ``keep_one`` each of their texts is judged by itself; rows without a
doc_id link with nothing and have no component; repeated rows repeat in the result; an empty
table gives an empty table; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import batches_of_bytes, mixed, shingle_hashes, word_hashes
from .storage import discard, materialize, sliced
from .text import stripped, whole

GROUPS = 64
CELL = 2048
LEAF = 32
KEYS = 4
SAMPLE_DOCS = 400
HOT_SHINGLES = 20_000


def needed(x, y, percent: int):
    """Least overlap of linked sets of sizes x and y, as a real number."""
    return percent * (x + y) / (100 + percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct arrays reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class CountTree:
    """A bulk-loaded R-tree over count vectors; nodes keep upper corners and least sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF, fan: int = 16):
        self.order = np.lexsort((points.argmax(1), points[:, 0], sizes))
        self.points, self.sizes, self.leaf = points[self.order], sizes[self.order], leaf
        cuts = np.arange(0, len(sizes), leaf)
        self.levels = [(np.maximum.reduceat(self.points, cuts), np.minimum.reduceat(self.sizes, cuts))]
        while len(self.levels[-1][1]) > fan:
            upper, least = self.levels[-1]
            cuts = np.arange(0, len(least), fan)
            self.levels.append((np.maximum.reduceat(upper, cuts), np.minimum.reduceat(least, cuts)))
        self.fan = fan

    def leaf_pairs(self, percent: int):
        """Pairs of leaves (a <= b) whose bound reaches the overlap they need; each leaf descends from the root."""
        corners, least = self.levels[0]
        for a in range(len(least)):
            nodes = np.arange(len(self.levels[-1][1]))
            for level in range(len(self.levels) - 1, -1, -1):
                upper, low = self.levels[level]
                nodes = nodes[nodes < len(low)]
                if level == 0:
                    nodes = nodes[nodes >= a]
                bound = np.minimum(corners[a], upper[nodes]).sum(1)
                nodes = nodes[bound >= needed(least[a], low[nodes], percent)]
                if level:
                    nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
            for b in nodes:
                yield a, int(b)

    def members(self, leaf: int) -> slice:
        return slice(leaf * self.leaf, (leaf + 1) * self.leaf)

    def pairs(self, a: int, b: int, percent: int):
        """Places of the pairs of points of two leaves that pass the bound."""
        i, j = self.members(a), self.members(b)
        bound = np.minimum(self.points[i][:, None, :], self.points[j][None, :, :]).sum(2)
        ok = bound >= needed(self.sizes[i][:, None], self.sizes[j][None, :], percent)
        if a == b:
            ok &= np.tri(*ok.shape, k=-1, dtype=bool).T
        x, y = np.nonzero(ok)
        return x + i.start, y + j.start


def count_points(sets: list[np.ndarray], groups: int) -> np.ndarray:
    shift = np.uint64(64 - (groups.bit_length() - 1))
    return np.array([np.bincount((s >> shift).astype(np.int64), minlength=groups) for s in sets], np.int32)


def fine_counts(s: np.ndarray) -> np.ndarray:
    """Counts over about one group per 8 shingles, ``GROUPS`` at least: groups nest, so counts fold to fewer groups."""
    bits = min(20, max(GROUPS.bit_length() - 1, int(np.ceil(np.log2(max(1, len(s) / 8))))))
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)


def packed_counts(counts: np.ndarray) -> bytes:
    return bytes([counts.itemsize]) + counts.tobytes()


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(groups, -1).sum(1, dtype=np.int32)


class LeafBounds:
    """The bound between the points of two leaves, of each pair over the finest groups that both have."""

    def __init__(self, tree: CountTree, fine: list[np.ndarray]):
        self.tree, self.held = tree, {}
        self.fine = [fine[k] for k in tree.order]
        self.groups = np.array([len(f) for f in self.fine])

    def _leaf(self, leaf: int, groups: int) -> np.ndarray:
        """Of the members that have so many groups."""
        if (leaf, groups) not in self.held:
            if len(self.held) > 4096:
                self.held.clear()
            self.held[leaf, groups] = np.array([folded(f, groups) for f in self.fine[self.tree.members(leaf)] if len(f) >= groups], np.int32)
        return self.held[leaf, groups]

    def passing(self, a: int, b: int, percent: int) -> np.ndarray:
        x, y = self.groups[self.tree.members(a)], self.groups[self.tree.members(b)]
        sizes = self.tree.sizes
        need = needed(sizes[self.tree.members(a)][:, None], sizes[self.tree.members(b)][None, :], percent)
        finest = np.minimum(x[:, None], y[None, :])
        out = np.zeros(finest.shape, bool)
        for groups in np.unique(finest):
            at = np.ix_(x >= groups, y >= groups)
            bound = np.minimum(self._leaf(a, groups)[:, None, :], self._leaf(b, groups)[None, :, :]).sum(2)
            out[at] |= (finest[at] == groups) & (bound >= need[at])
        return out


def connect_cell(ids: np.ndarray, sets: list[np.ndarray], percent: int, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between members of different parts (all different at first, if not given): fewer than there are members."""
    middle = int(np.median([len(s) for s in sets]))
    groups = 1 << int(np.clip(np.ceil(np.log2(max(middle, 1) / 2)), 8, 12))
    tree = CountTree(count_points(sets, groups), np.array([len(s) for s in sets]))
    sets, ids = [sets[k] for k in tree.order], ids[tree.order]
    part = np.arange(len(ids)) if parts is None else np.unique(parts, return_inverse=True)[1][tree.order]
    found = []
    for a, b in tree.leaf_pairs(percent):
        pa_, pb = part[tree.members(a)], part[tree.members(b)]
        if (pa_ == pa_[0]).all() and (pb == pa_[0]).all():
            continue
        for i, j in zip(*tree.pairs(a, b, percent), strict=True):
            if part[i] != part[j] and linked(sets[i], sets[j], percent):
                part[part == part[j]] = part[i]
                found.append((int(ids[i]), int(ids[j])))
    return found


def cell_suspects(parts: np.ndarray, points: np.ndarray, sizes: np.ndarray, fine: list[np.ndarray], percent: int):
    """Which members pass the bound with a member of another part, and pairs of parts that connect all such parts."""
    tree = CountTree(points, sizes)
    leaves = LeafBounds(tree, fine)
    parts = parts[tree.order]
    names, group = np.unique(parts, return_inverse=True)
    own = group.copy()
    flags, edges = np.zeros(len(parts), bool), []
    for a, b in tree.leaf_pairs(percent):
        i, j = tree.members(a), tree.members(b)
        if flags[i].all() and flags[j].all() and (group[i] == group[i][0]).all() and (group[j] == group[i][0]).all():
            continue
        apart = own[i][:, None] != own[j][None, :]
        if not apart.any():
            continue
        ok = leaves.passing(a, b, percent) & apart
        flags[i] |= ok.any(1)
        flags[j] |= ok.any(0)
        x, y = np.nonzero(ok & (group[i][:, None] != group[j][None, :]))
        for k, m in zip(x + i.start, y + j.start, strict=True):
            if group[k] != group[m]:
                edges.append((int(parts[k]), int(parts[m])))
                group[group == group[m]] = group[k]
    out = np.zeros(len(parts), bool)
    out[tree.order] = flags
    return out, edges


def _sets(texts: list, shingle: int):
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode() for t in texts]
    for lo, hi in batches_of_bytes(raw):
        words, at = word_hashes(raw[lo:hi])
        for k in range(hi - lo):
            yield np.unique(shingle_hashes(words[at[k] : at[k + 1]], shingle))


def _name(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _runs(batches, names: list[str]):
    """Lists of columns of whole groups of equal ``key`` from batches sorted by key."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch]).select(names)
        held = t if held is None else pa.concat_tables([held, t])
        keys = held.column("key").to_numpy()
        if keys[0] == keys[-1]:
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        yield held.slice(0, last)
        held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])


def frequent_shingles(docs: DataFrame, shingle: int, rows: int = SAMPLE_DOCS, most: int = HOT_SHINGLES) -> np.ndarray:
    """Up to ``most`` shingles found at least three times in ``rows`` documents, rarest first: an ordering hint only."""
    sample = docs.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0)).filter(F.octet_length("text") < 100_000).select("text").limit(rows)
    texts = [r["text"] for r in sample.collect()]
    if not texts:
        return np.zeros(0, np.uint64)
    values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *_sets(texts, shingle)]), return_counts=True)
    hot = np.argsort(counts, kind="stable")[np.sort(counts) >= 3][-most:]
    return values[hot]


def text_digest(docs: DataFrame) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(whole(docs["text"]).cast("binary")))


def signatures(docs: DataFrame, percent: int, shingle: int, hot: np.ndarray) -> DataFrame:
    """doc_id, digest (of the text), n, rep (the set's name), counts (point), keys (minimum hashes), prefix (first shingles in the global order)."""
    salts = mixed(np.arange(1, KEYS + 1, dtype=np.uint64)) | np.uint64(1)
    names = np.sort(hot)
    place = np.argsort(hot)

    def sign(batches):
        for batch in sliced(batches):
            out = {c: [] for c in ("n", "rep", "counts", "keys", "prefix")}
            for s in _sets(batch.column("text").to_pylist(), shingle):
                n = len(s)
                out["n"].append(n)
                out["rep"].append(_name(s) if n else None)
                if not n:
                    for c in ("counts", "keys", "prefix"):
                        out[c].append(None)
                    continue
                out["counts"].append(packed_counts(fine_counts(s)))
                out["keys"].append([int(((s * a) ^ a).min().view(np.int64)) for a in salts])
                first = n - -(-percent * n // 100) + 1
                if len(names):
                    at = np.searchsorted(names, s)
                    at[at == len(names)] = 0
                    common = names[at] == s
                    late = s[common][np.argsort(place[at[common]], kind="stable")]
                    s = np.concatenate([s[~common], late])
                out["prefix"].append(s[:first].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("digest"), pa.array(out["n"], pa.int64()), pa.array(out["rep"], pa.int64()), pa.array(out["counts"], pa.binary()),
                    pa.array(out["keys"], pa.list_(pa.int64())), pa.array(out["prefix"], pa.list_(pa.int64())),
                ],
                names=["doc_id", "digest", *out],
            )

    schema = "doc_id long, digest binary, n long, rep long, counts binary, keys array<long>, prefix array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(docs).alias("digest"), "text").mapInArrow(sign, schema)


def _with_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """rep, set (sorted hashes, binary) for the wanted (rep, doc_id)."""

    def make(batches):
        for batch in sliced(batches):
            names, sets = [], []
            for rep, s in zip(batch.column("rep").to_pylist(), _sets(batch.column("text").to_pylist(), shingle), strict=True):
                if _name(s) == rep:
                    names.append(rep)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(wanted, "doc_id").select("rep", "text").mapInArrow(make, "rep long, set binary").groupBy("rep").agg(F.first("set").alias("set"))


def _connect(batches, percent: int):
    """Links that connect the members of each cell."""
    for t in _runs(batches, ["key", "rep", "part", "set"]):
        keys, reps, parts, sets = t.column("key").to_numpy(), t.column("rep").to_numpy(), t.column("part").to_numpy(), t.column("set").to_pylist()
        found, at = [], _bounds(keys)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo > 1:
                found += connect_cell(reps[lo:hi], [np.frombuffer(s, np.uint64) for s in sets[lo:hi]], percent, parts[lo:hi])
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _of_like_size(cells: DataFrame, percent: int) -> DataFrame:
    """key, rep: the members with another in their cell (of about ``CELL`` members at most) that they can link with by size."""
    by_size = W.partitionBy("key").orderBy("n", "rep")
    near = (percent * F.col("n") <= 100 * F.lag("n").over(by_size)) | (percent * F.lead("n").over(by_size) <= 100 * F.col("n"))
    return cells.withColumn("near", near).filter("near").select("key", "rep")


def _meeting(batches, percent: int):
    """The members that can link with one of another part if the cell's shingle is the first that both share.

    Then they share at most the smaller ``rest``, the number of shingles from that one on.
    A cell gets a key that names these members, so cells of the same members become one.
    """
    for t in _runs(batches, ["key", "rep", "part", "n", "rest"]):
        keys, reps, parts, n, rest = (t.column(c).to_numpy() for c in ("key", "rep", "part", "n", "rest"))

        def can(a, b):
            return (parts[a] != parts[b]) & ((100 + percent) * np.minimum(rest[a], rest[b]) >= percent * (n[a] + n[b]))  # noqa: B023  called in this round

        at = _bounds(keys)
        size = np.diff(at)
        flags = np.zeros(len(keys), bool)
        for s in np.unique(size[(size > 1) & (size <= 16)]):
            rows = at[:-1][size == s][:, None] + np.arange(s)
            for k in range(0, len(rows), 4096):
                some = rows[k : k + 4096]
                flags[some] = can(some[:, :, None], some[:, None, :]).any(2)
        for lo, hi in zip(at[:-1][size > 16], at[1:][size > 16], strict=True):
            left, k = np.arange(lo, hi), lo
            while len(left) and k < hi:  # most find one among the first they are held against
                step = max(16, (1 << 18) // len(left))
                hit = can(left[:, None], np.arange(k, min(hi, k + step))[None, :]).any(1)
                flags[left[hit]] = True
                left, k = left[~hit], k + step
        if flags.any():
            names = np.repeat(np.add.reduceat(np.where(flags, mixed(reps.view(np.uint64)), np.uint64(0)), at[:-1]), size).view(np.int64)
            yield pa.RecordBatch.from_pydict({"key": pa.array(names[flags]), "rep": pa.array(reps[flags]), "part": pa.array(parts[flags])})


def _suspects(batches, percent: int):
    """Rows (suspect, rep, part) and (edge, part, part): no more than members in each cell."""
    for t in _runs(batches, ["key", "rep", "part", "n", "counts"]):
        keys, reps, parts, n = (t.column(c).to_numpy() for c in ("key", "rep", "part", "n"))
        fine = [unpacked_counts(c) for c in t.column("counts").to_pylist()]
        points = np.array([folded(f, GROUPS) for f in fine], np.int32)
        at = _bounds(keys)
        size = np.diff(at)
        flags, edges, tried = np.zeros(len(keys), bool), set(), {}
        for s in np.unique(size[(size > 1) & (size <= 16)]):  # one leaf each: all such cells at once
            rows = at[:-1][size == s][:, None] + np.arange(s)
            i, j = np.triu_indices(s, 1)
            x, y = rows[:, i].ravel(), rows[:, j].ravel()
            x, y = x[parts[x] != parts[y]], y[parts[x] != parts[y]]
            for k in range(0, len(x), 1 << 16):
                a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                ok = np.minimum(points[a], points[b]).sum(1) >= needed(n[a], n[b], percent)
                for p, q in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                    pair = (int(reps[p]), int(reps[q]))
                    if pair not in tried:
                        groups = min(len(fine[p]), len(fine[q]))
                        both = int(np.minimum(folded(fine[p], groups), folded(fine[q], groups)).sum())
                        tried[pair] = both >= needed(int(n[p]), int(n[q]), percent)
                    if tried[pair]:
                        flags[p] = flags[q] = True
                        edges.add((int(parts[p]), int(parts[q])))
        for lo, hi in zip(at[:-1][size > 16], at[1:][size > 16], strict=True):
            flags[lo:hi], more = cell_suspects(parts[lo:hi], points[lo:hi], n[lo:hi], fine[lo:hi], percent)
            edges.update(more)
        if flags.any():
            who = np.unique(np.stack([reps[flags], parts[flags]], 1), axis=0)
            pairs = np.array(sorted(edges), np.int64).reshape(-1, 2)
            both = np.concatenate([who, pairs])
            kind = np.repeat([False, True], [len(who), len(pairs)])
            yield pa.RecordBatch.from_pydict({"edge": pa.array(kind), "u": pa.array(both[:, 0]), "v": pa.array(both[:, 1])})


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("key").sortWithinPartitions("key")


def _met(rows: DataFrame, size: int, *more: str) -> DataFrame:
    """key, rep, part (and ``more``) where keys of more than ``size`` rows (column m) are split into blocks, and any two blocks meet."""
    blocks = F.ceil(F.col("m") / size).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda b: (b != own) | (blocks == 1))
    meets = F.transform(others, lambda b: F.struct(F.least(b, own).alias("x"), F.greatest(b, own).alias("y")))
    return rows.withColumn("meet", F.explode(meets)).select(F.xxhash64("key", "meet").alias("key"), "rep", "part", *more)


def _same_document(rows: DataFrame) -> DataFrame:
    """Edges (u, v) between the sets of one doc_id."""
    named = rows.filter("rep is not null and doc_id is not null").select("doc_id", "rep")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("hi")).filter("v <> hi").select("doc_id", "v")
    return named.join(several, "doc_id").select(F.col("rep").alias("u"), "v").distinct()


def _connected(docs: DataFrame, percent: int, shingle: int, one_document: bool) -> tuple[DataFrame, DataFrame]:
    """Written tables: rows (doc_id, digest, n_shingles, rep), and the sets' names with their least doc_id and the root of their component.

    ``one_document``: the sets of one doc_id are linked with each other.
    """
    signed = materialize(signatures(docs, percent, shingle, frequent_shingles(docs, shingle)), "signatures")
    usable = signed.filter("n > 0 and doc_id is not null")
    fields = F.struct("doc_id", "n", "counts", "keys", "prefix")
    vertices = usable.groupBy("rep").agg(F.min_by(fields, "doc_id").alias("r")).select("rep", "r.*")
    vertices = materialize(vertices, "vertices")
    rows = materialize(signed.select("doc_id", "digest", F.col("n").alias("n_shingles"), "rep"), "rows")
    discard(signed)

    # near copies, by minimum hashes
    cells = vertices.select("rep", "n", F.posexplode("keys").alias("k", "key")).select("rep", "n", F.xxhash64("k", "key").alias("key"))
    shape = cells.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).filter("m > 1")
    once = shape.groupBy("m", "who").agg(F.min("key").alias("key"))  # cells of the same members: one is enough
    split = F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("m") / CELL))
    cells = cells.join(once.select("key", "m"), "key").select(F.xxhash64("key", split).alias("key"), "rep", "n")
    cells = materialize(_of_like_size(cells, percent), "cells")
    wanted = cells.select("rep").distinct().join(vertices.select("rep", "doc_id"), "rep")
    held = materialize(_with_sets(docs, wanted, shingle), "sets")  # a table: so the shuffles of the texts and of the cells are not on disk together
    first = _dealt(cells.withColumn("part", F.col("rep")).join(held, "rep")).mapInArrow(lambda b: _connect(b, percent), "u long, v long")
    parts = connected_components(first.unionByName(_same_document(rows)) if one_document else first)
    discard(cells)
    discard(held)

    # the rest, by prefix shingles
    placed = vertices.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("root", "rep"))
    posted = placed.select("rep", "part", "n", F.posexplode("prefix").alias("at", "key")).select("rep", "part", "n", (F.col("n") - F.col("at")).alias("rest"), "key")
    shape = [F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("m"), F.min("rest").alias("rest"), F.sum("n").alias("both")]
    can = (F.col("m") > 2) | ((100 + percent) * F.col("rest") >= percent * F.col("both"))  # two members: what ``_meeting`` asks
    mixed_cells = posted.groupBy("key").agg(*shape).filter("lo < hi").filter(can)
    mixed_cells = materialize(mixed_cells.select("key", "m"), "mixed-cells")  # a job of its own: its shuffle is gone before the next
    posted = materialize(posted.join(mixed_cells, "key"), "postings")
    discard(mixed_cells)
    met = _met(posted, 4 * CELL, "n", "rest")
    meeting = materialize(_dealt(met).mapInArrow(lambda b: _meeting(b, percent), "key long, rep long, part long").distinct(), "meeting")
    discard(posted)
    points = meeting.join(vertices.select("rep", "n", "counts"), "rep")
    found = _dealt(points).mapInArrow(lambda b: _suspects(b, percent), "edge boolean, u long, v long").distinct()
    found = materialize(found, "suspects")
    discard(meeting)
    names = materialize(vertices.select("rep", "doc_id"), "names")
    discard(vertices)
    if not found.isEmpty():
        groups = connected_components(found.filter("edge").select("u", "v")).select(F.col("node").alias("part"), F.col("root").alias("group"))
        suspects = found.filter("not edge").select(F.col("u").alias("rep"), F.col("v").alias("part"))
        placed = suspects.join(groups, "part", "left").withColumn("key", F.coalesce("group", "part"))
        sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        met = _met(placed.join(sizes, "key"), CELL)
        held = materialize(_with_sets(docs, suspects.select("rep").distinct().join(names, "rep"), shingle), "sets")
        late = _dealt(met.join(held, "rep")).mapInArrow(lambda b: _connect(b, percent), "u long, v long")
        early = parts.select(F.col("node").alias("u"), F.col("root").alias("v"))
        before, parts = parts, connected_components(early.unionByName(late))
        discard(before)
        discard(held)
    discard(found)

    labelled = names.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "doc_id", F.coalesce("root", "rep").alias("root"))
    labelled = materialize(labelled, "labelled")
    for table in (names, parts):
        discard(table)
    return rows, labelled


def near_copies(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links of at least ``percent`` per cent)."""
    rows, labelled = _connected(docs, percent, shingle, one_document=True)
    least = materialize(labelled.groupBy("root").agg(F.min("doc_id").alias("component")), "least")  # tables: so hot keys can be split in the joins
    roots = materialize(labelled.join(least, "root").select("rep", "component"), "roots")
    for table in (least, labelled):
        discard(table)
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(roots, "rep", "left").select("doc_id", "n_shingles", part.alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """One row of each component of texts: of its least doc_id, and of that document's texts in it the one with most shingles.

    Texts of one doc_id that do not link are in components of their own, so each is represented.
    Rows without an id or without words link with nothing and stay.
    """
    rows, labelled = _connected(docs, percent, shingle, one_document=False)
    usable = rows.filter("n_shingles > 0 and doc_id is not null").join(labelled.select("rep", "root"), "rep")
    first = usable.groupBy("root").agg(F.min(F.struct("doc_id", (-F.col("n_shingles")).alias("less"), "digest")).alias("r"))
    stays = materialize(first.select(F.col("r.doc_id").alias("__id"), F.col("r.digest").alias("__text")), "stays")
    for table in (rows, labelled):
        discard(table)
    linkable = F.col("doc_id").isNotNull() & (stripped(docs["text"]) != "")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.filter(linkable).select(row.alias("row"), F.col("doc_id").cast("long").alias("__doc"), text_digest(docs).alias("__digest"))
    kept = keyed.join(stays, (F.col("__doc") == F.col("__id")) & (F.col("__digest") == F.col("__text")), "left_semi")
    one = kept.groupBy("__doc", "__digest").agg(F.min("row").alias("row")).select("row.*")  # repeated rows are one
    return one.unionByName(docs.filter(~linkable))
