"""Nearest neighbours, Merkle versions and periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priceguard.llm import ann, merkle, runs

VECTORS = "vec_id long, embedding array<double>, label int, key string, v string, rep int, ids int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "k", "v", 1, 2) for i, v in rows], VECTORS)


def brute_nearest(rows, k, step=20):
    rows = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    lengths = [len(v) for _, v in rows]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if rows else 0
    rows = sorted({r for r in rows if len(r[1]) == d})
    out = []
    for i, v in rows:
        if i % step == 0:
            score = {}
            for j, w in rows:
                if j != i:
                    score[(-float((np.array(w) * np.array(v)).sum()), j, w)] = None
            out += [(i, n + 1, j, -s) for n, (s, j, _) in enumerate(sorted(score)[:k])]
    return sorted(out)


def found_nearest(docs, k, **more):
    return sorted(tuple(r) for r in ann.search(docs, F.col("vec_id") % 20 == 0, k, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("shape", ["gaussian", "clustered", "norms"])
def test_recall(spark, shape, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 24))
    if shape == "clustered":
        x = rng.standard_normal((30, 24))[rng.integers(0, 30, 900)] + 0.2 * x
    if shape == "norms":
        x *= rng.gamma(2.0, size=(900, 1))
    rows = list(enumerate(x.tolist()))
    want = brute_nearest(rows, 20)
    monkeypatch.setattr(ann, "ASKED", 16)
    got = found_nearest(vectors_of(spark, rows), 20, cell_bytes=1 << 16)  # several cells, and cells of several tasks
    assert len(got) == len(want)
    near = lambda found: {(q, j) for q, _, j, _ in found}
    assert len(near(got) & near(want)) >= 0.9 * len(want)
    exact = dict(rows)
    for q, _, j, s in got:
        assert s == pytest.approx(float(np.dot(exact[q], exact[j])), rel=1e-12, abs=1e-12)
    for a, b in zip(got, got[1:], strict=False):
        assert a[0] != b[0] or (a[1] + 1 == b[1] and (-a[3], a[2]) < (-b[3], b[2]))


def test_hot_vector_odd_rows_and_few_candidates(spark, empty):
    """A third of the rows are one vector; ties go to smaller ids; rows that take no part."""
    rng = np.random.default_rng(4)
    hot = [1.0, 2.0, 0.5]
    rows = [(i, hot if i % 3 == 0 else rng.standard_normal(3).tolist()) for i in range(240)]
    rows += [(400, None), (420, [0.0, 0.0, 0.0]), (440, [1.0, None, 2.0]), (460, [1.0, float("nan"), 2.0]), (480, [float("inf"), 0.0, 1.0]), (500, [1.0, 2.0]), (None, hot), (520, []), (60, hot), (60, hot)]
    got = found_nearest(vectors_of(spark, rows), 20)
    want = brute_nearest(rows, 20)
    assert [r[:3] for r in got] == [r[:3] for r in want]  # in three dimensions every bucket nearby is visited
    few = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])]
    assert found_nearest(vectors_of(spark, few), 20) == brute_nearest(few, 20)
    assert found_nearest(vectors_of(spark, few[:1]), 20) == []
    assert found_nearest(vectors_of(spark, []), 20) == []


def test_probes_come_in_order_and_are_the_likeliest():
    rng = np.random.default_rng(5)
    hashing = ann.Hashing(rng.standard_normal((1, 6, 9)), rng.random((1, 6)), np.ones((1, 6), np.uint64), 1.5, 0.8, 1.0)
    point = rng.standard_normal((3, 9))
    slots, _, upto = hashing.probes(point, 0, most=40)
    every, _, whole = hashing.probes(point, 0, most=3**6)
    assert np.allclose(upto, whole[:, :40]) and (np.diff(upto, axis=1)[:, 1:] <= np.diff(upto, axis=1)[:, :-1] + 1e-12).all()
    assert len({tuple(s) for s in every[0].tolist()}) == 3**6
    assert (slots[:, 0] == np.floor(hashing.places(point, 0))).mean() > 0.5


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """By the definition: doc_id, leaf, subroot, root, proof, folded root."""

    def climb(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            out.append((level[i - 1] if i % 2 else "", level[i + 1] if i % 2 == 0 and i + 1 < len(level) else ""))
            i //= 2
        return out

    groups = {}
    for r in rows:
        leaf = h(*[encoded(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf, r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf for _, leaf, _ in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in names}
    top, out = climb([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for i, (doc_id, leaf, r) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            steps = path(trees[g], i) + path(top, k)
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r["n_chars"] is not None:
                node = h(*[encoded(v) for v in (doc_id, r["source"], r["lang"], r["n_chars"] + 1, r["text"])])
            for left, right in steps:
                node = h(left, node, right)
            out.append((str(doc_id), leaf, trees[g][-1][0], top[-1][0], h(*[a + b for a, b in steps]), node, node == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest(spark, messy, corpus, empty, levels):
    many = messy.withColumn("lang", F.when(F.col("doc_id") > 4, F.concat(F.lit("l"), F.col("doc_id"))))
    tables = [messy, many] if levels > 2 else [corpus.withColumn("n_chars", F.length("text").cast("long")), many]
    for docs in tables:
        docs = docs.withColumn("n_chars", F.coalesce("n_chars", F.when(F.col("doc_id") < 8, F.col("doc_id"))))
        got = sorted((str(r[0]), *tuple(r)[1:]) for r in merkle.verified(merkle.documents_manifest(docs, levels)).collect())
        assert got == brute_manifest([r.asDict() for r in docs.collect()])
    assert merkle.verified(merkle.documents_manifest(empty, levels)).count() == 0


def test_versions_share_all_but_the_ancestors(spark, corpus):
    docs = corpus.withColumn("n_chars", F.length("text").cast("long"))
    found = merkle.documents_manifest(docs, levels=3).collect()
    first = {r["leaf"] for r in found}
    for r in found:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        assert len(r["version"]) == (len(r["path"]) + 1 if changed else 0)
        assert not first & set(r["version"])
    assert sum(bool(r["version"]) for r in found) > 10


def brute_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda x: (x[0], x[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 9), st.integers(0, 60)), max_size=4), st.sampled_from([2, 6, 12]))
def test_runs_of_words(parts, least):
    texts = [w + [w[-(k % p) - 1] for k in range(n)] if w and p <= len(w) else w for w, p, n in parts]
    assert runs.word_runs(texts, least) == [brute_runs(w, least) for w in texts]


def test_lyndon_array_by_definition():
    rng = random.Random(6)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 24))]
        want = [max(n for n in range(1, len(w) - i + 1) if all(w[i : i + n] < w[i + k : i + n] for k in range(1, n))) for i in range(len(w))]
        assert runs.lyndon_array(w) == want


def test_find_runs(spark, messy, corpus, empty):
    odd = [(10, "a b c " * 30), (20, "x " * 50 + "y"), (30, " ".join(f"w{k % 7} v" for k in range(60)) + " and then " + "p q " * 20), (57, None)]
    tables = [messy, corpus, spark.createDataFrame(odd, "doc_id long, text string")]
    for docs in tables:
        for tails in (False, True):
            rows = runs.find_runs(docs, tails=tails).collect()
            digests = runs.find_runs(docs, tails=tails, digests=True).select("doc_id", "runs.runs_sha256", "runs.collapsed_sha256").collect()
            assert len(rows) == docs.count()
            hashed = sorted(tuple(map(str, r)) for r in digests)
            seen = []
            for r in rows:
                words = runs.repeating_tail((r["text"] or "").encode().split(), r["doc_id"] if tails else None)
                want = brute_runs(words) if len(words) < 3000 else None
                found = [tuple(x) for x in r["runs"]["runs"]]
                assert want is None or found == want
                gone = {i for s, n, q in found for i in range(s + q, s + n)}
                kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
                assert r["runs"]["collapsed"].encode() == kept and r["runs"]["n_runs"] == len(found)
                best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
                assert tuple(r["runs"][1:4]) == best and r["runs"]["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                seen.append((str(r["doc_id"]), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            assert sorted(seen) == hashed
    assert runs.find_runs(empty).count() == 0
