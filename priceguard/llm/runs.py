"""Periodic runs of words, by Lyndon arrays from the first phase of a suffix sorter.

A run is a maximal stretch with smallest period q and at least two periods.  Phase one of
Baier's suffix sorter groups suffixes by their longest Lyndon prefixes: it visits groups from
the largest to the smallest and moves the nearest smaller suffix before each member into a new
group whose prefix has grown by the member's.  What a suffix's group has as its prefix when it
is visited is the longest Lyndon word that begins there, so phase one alone, under the order of
the words and under its reverse, gives both Lyndon arrays.  By the runs theorem every run has a
Lyndon root under one of the orders; roots are extended to the left and to the right by longest
common extensions (names of strings of doubling length, compared exactly), and those that fill
two periods are the runs.

A run of at least ``MIN_LENGTH`` words consists of strings of ``GRAM`` words that occur twice
in the text, so phase one reads only stretches covered by such strings (found by hashes; a
false one costs time, not a result).  No run reaches over the end of such a stretch.

Defined cases: null text counts as empty and has no run; ids may be null or repeated, each row
is judged on its own; very long texts are one row each, in linear memory; an empty table gives
an empty table; other columns pass through, and one named ``runs`` is replaced.
"""

from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import batches_of_bytes, mixed
from .storage import sliced

MIN_LENGTH = 12
GRAM = MIN_LENGTH // 2  # words that match one period on, at least, in a run of that length
SEGMENT = 2 << 20


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place."""
    n = len(ranks)
    order = sorted(range(n), key=ranks.__getitem__)
    at, group, end = [0] * n, [0] * n, [0] * (n + 1)  # place in the order; first place of one's group; its end, by first place
    first = 0
    for k, i in enumerate(order):
        if ranks[i] != ranks[order[first]]:
            first = k
        at[i], group[i], end[first] = k, first, k + 1
    length, before, top = [1] * n, [i - 1 for i in range(n)], n
    while top:
        low = group[order[top - 1]]
        members, hits = sorted(order[low:top]), {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            k = i - 1
            while k > j:  # later searches pass this way once
                before[k], k = j, before[k]
            before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            grown, by_count = length[members[0]], defaultdict(list)
            for j, times in hits.items():
                by_count[times].append(j)
            for times in sorted(by_count, reverse=True):
                touched = {}
                for j in by_count[times]:
                    old = group[j]
                    touched.setdefault(old, end[old])
                    end[old] -= 1
                    other, place = order[end[old]], at[j]
                    order[place], at[other] = other, place
                    order[end[old]], at[j] = j, end[old]
                    length[j] += times * grown
                for j in by_count[times]:
                    old = group[j]
                    fresh = end[old]
                    group[j] = fresh
                for old, was in touched.items():
                    if end[old] > old:
                        end[end[old]] = was
                    else:
                        end[old] = was
        top = low
    return length


class Extensions:
    """Longest common extensions over integers: names of strings of doubling length."""

    def __init__(self, values: np.ndarray):
        self.names = [np.unique(values, return_inverse=True)[1].astype(np.int64)]
        size = 1
        while 2 * size <= len(values):
            last = self.names[-1]
            pairs = last[: len(last) - size] * (last.max() + 1) + last[size:]
            new = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            if new.max() + 1 == len(new):  # all differ, and so do longer ones
                break
            self.names.append(new)
            size *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common string that begins at a and at b (a < b)."""
        a, out = a.copy(), np.zeros(len(a), np.int64)
        gap = b - a
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            again = np.arange(len(a))
            while len(again):  # the longest names may fit more than once
                inside = a[again] + gap[again] < len(names)
                again = again[inside]
                again = again[names[a[again]] == names[a[again] + gap[again]]]
                a[again] += 1 << k
                out[again] += 1 << k
                if k < len(self.names) - 1:
                    break
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common string that ends before a and before b (a < b)."""
        a, out = a.copy(), np.zeros(len(a), np.int64)
        gap = b - a
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            again = np.arange(len(a))
            while len(again):
                again = again[a[again] >= size]
                again = again[names[a[again] - size] == names[a[again] - size + gap[again]]]
                a[again] -= size
                out[again] += size
                if k < len(self.names) - 1:
                    break
        return out


def runs_of(pieces: list[np.ndarray], least: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each piece's runs, ordered; the pieces are arrays of word numbers."""
    if not pieces:
        return []
    bounds = np.cumsum([0, *(len(p) + 1 for p in pieces)])
    text = np.full(bounds[-1], -1, np.int64)
    for p, at in zip(pieces, bounds, strict=False):
        text[at : at + len(p)] = p
    text[bounds[1:] - 1] = -1 - np.arange(len(pieces))  # ends that match nothing
    extend, found = Extensions(text), []
    for sign in (1, -1):
        starts, periods = [], []
        for p, at in zip(pieces, bounds, strict=False):
            root = np.array(lyndon_array((sign * np.asarray(p, np.int64)).tolist()), np.int64)
            i = np.flatnonzero(np.arange(len(p)) + root < len(p))
            starts.append(i + at)
            periods.append(root[i])
        i, q = np.concatenate(starts), np.concatenate(periods)
        left, right = extend.backward(i, i + q), extend.forward(i, i + q)
        long = left + right + q >= np.maximum(least, 2 * q)
        found.append(np.stack([i - left, left + right + q, q])[:, long])
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    piece = np.searchsorted(bounds, both[0], side="right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in pieces]
    for k, start, length, period in zip(piece.tolist(), (both[0] - bounds[piece]).tolist(), both[1].tolist(), both[2].tolist(), strict=True):
        out[k].append((start, length, period))
    return out


def stretches(words: np.ndarray, bounds: np.ndarray, gram: int = GRAM) -> list[tuple[int, int]]:
    """[from, to) of the maximal stretches covered by strings of ``gram`` words that occur twice within their text."""
    if len(words) < gram:
        return []
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    prints = mixed(text[: len(words) - gram + 1].astype(np.uint64))
    for k in range(gram):
        prints = mixed(prints + words[k : k + len(prints)].astype(np.uint64))
    inside = np.flatnonzero(text[: len(prints)] == text[gram - 1 :])
    order = inside[np.argsort(prints[inside], kind="stable")]
    same = prints[order][1:] == prints[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, order[twice], 1)
    np.add.at(cover, order[twice] + gram, -1)
    covered = np.cumsum(cover[:-1]) > 0
    fresh = covered.copy()
    fresh[1:] &= ~covered[:-1] | (text[1:] != text[:-1])
    starts = np.flatnonzero(fresh)
    stop = np.append(~covered[1:] | (text[1:] != text[:-1]), True) & covered
    return list(zip(starts.tolist(), (np.flatnonzero(stop) + 1).tolist(), strict=True))


def word_runs(texts: list[list], least: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words."""
    numbers: dict = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
    bounds = np.cumsum([0, *(len(t) for t in texts)])
    spans = stretches(words, bounds, least // 2)
    text = np.searchsorted(bounds, [a for a, _ in spans], side="right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (a, _), found in zip(text.tolist() if len(spans) else [], spans, runs_of([words[a:b] for a, b in spans], least), strict=True):
        out[k] += [(s + a - int(bounds[k]), length, q) for s, length, q in found]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Without the words that lie in a run after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g] if runs else words


def repeating_tail(words: list, doc_id) -> list:
    """A tenth of the documents get a periodic tail: its place, period and whether come from the id's CRC-32 (a null id: none)."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def find_runs(docs: DataFrame, least: int = MIN_LENGTH, tails: bool = False, digests: bool = False) -> DataFrame:
    """``docs`` with a struct ``runs``: n_runs, the longest run (ties: first start, then least period), all runs, and the collapsed words.

    ``tails`` repeats words of a tenth of the documents first (see ``repeating_tail``); ``digests``
    gives, in place of the list and the words, SHA-256 of their lines and of the words joined by a blank.
    """
    columns = [c for c in docs.columns if c != "runs"]
    one = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    one += [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())] if digests else [("runs", pa.list_(run)), ("collapsed", pa.string())]
    kind = pa.struct(one)

    def judged(words: list, runs: list) -> dict:
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        out = {"n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if runs else None}
        kept = b" ".join(collapsed(words, runs))
        if digests:
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            return out | {"runs_sha256": sha256(lines.encode()).hexdigest(), "collapsed_sha256": sha256(kept).hexdigest()}
        return out | {"runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": kept.decode()}

    def search(batches):
        for batch in sliced(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist() if tails else [None] * len(texts)
            out = []
            for lo, hi in batches_of_bytes(texts, SEGMENT):
                words = [t.split() for t in texts[lo:hi]]  # bytes split at blank, tab and the four line ends
                words = [repeating_tail(w, i) for w, i in zip(words, ids[lo:hi], strict=True)]
                out += [judged(w, r) for w, r in zip(words, word_runs(words, least), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, kind)], names=[*columns, "runs"])

    fields = "n_runs:bigint,start:bigint,length:bigint,period:bigint,exponent_milli:bigint,"
    fields += "runs_sha256:string,collapsed_sha256:string" if digests else "runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string"
    plain = docs.select(*[F.col(f"`{c}`") for c in columns])
    return plain.mapInArrow(search, plain.select("*", F.lit(None).cast(f"struct<{fields}>").alias("runs")).schema)
