"""Language-model scoring with a Katz backoff bigram model.

Tokens are lower-cased words and one end mark per document, which is also the context of the
first word.  Counts are discounted by Good and Turing up to ``K``; what the seen words of a
context leave goes to the others in proportion to their unigram probabilities, with a weight
that makes every context sum to one.  Unigrams leave their Good-Turing mass to one class of
unknown words.  A token is scored recursively: its bigram if seen, else the context's weight
times its unigram, else times the unknown class.

``train`` writes the model as tables partitioned by kind, whose rows are buckets: ``table``
(words and counts), ``bigrams`` (contexts, words and counts) and ``weights`` (what a context's
discounted counts are multiplied by, and its backoff weight).  ``score`` scores any texts from
these tables; ``score_documents`` does both for one table of documents.

No table of the corpus is broadcast.  Documents are taken in chunks of about ``CHUNK`` tokens
whose distinct words or bigrams travel as packed arrays to hash buckets and meet the counts of
all other chunks there; what comes back is one number per word, or one sum per document:

1. words to word buckets: the unigram table, which numbers the words, N, V and counts of counts;
2. counts and numbers back to their chunks, which now know each word's unigram probability;
3. training bigrams to the buckets of their contexts: the bigram table and its counts of counts;
4. that table, read where it lies: the weights of every context;
5. all bigrams to the same buckets, where bigrams and weights are looked up: the scores.

Bigram buckets follow the number of chunks, so that one bucket is about two chunks of bigrams.
A context of more than ``HOT`` training tokens (and more than N / ``MOST_HOT``, so there are
at most ``MOST_HOT``) is dealt by its next word over as many buckets as its count asks for;
its parts' sums, a few numbers each, are added on the driver.

Tables are written in the shared folder; each goes when nothing needs it any more.

Defined cases: doc_ids are integers; null and empty texts have the end mark only; a null doc_id counts as held out;
repeated rows are scored and counted each; without training tokens every token is unknown; an
empty table gives an empty table; other columns are ignored.
"""

import pickle
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BASE, batches_of_bytes, mixed, word_hashes
from .storage import discard, materialize, sliced

CHUNK = 2_000_000
HOT = 500_000
MOST_HOT = 100_000
K = 5
END = np.uint64(0x5DEECE66D1234567)


def pack(*arrays) -> bytes:
    """Arrays as one compressed byte string; bytes are sorted by significance first."""
    import zstandard

    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind) for kind, n, raw in planes]


def small(a: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the counts."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def discounts(counts_of_counts: dict[int, int], k: int = K) -> list[float]:
    """Good-Turing discount of counts 0..k (place 0 unused), with Katz's correction.

    Where the counts of counts are too thin for it, a count r keeps (r - 1/2) / r.
    """
    n = [counts_of_counts.get(r, 0) for r in range(k + 2)]
    out = [1.0]
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def discounted(counts: np.ndarray, table: list[float]) -> np.ndarray:
    factor = np.ones(len(counts))
    low = counts < len(table)
    factor[low] = np.array(table)[counts[low].astype(np.int64)]
    return counts * factor


@dataclass(frozen=True)
class Unigrams:
    """Totals of the training tokens: N, V and the discounts."""

    total: int
    kinds: int
    table: tuple
    known_mass: float

    @property
    def unknown(self) -> float:
        return 1.0 - self.known_mass

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.full(len(counts), 1.0)
        seen = discounted(counts.astype(np.float64), list(self.table)) / self.total
        return np.where(counts > 0, seen, self.unknown)


def unigram_totals(counts_of_counts: dict[int, int], total: int, kinds: int) -> Unigrams:
    table = discounts(counts_of_counts)
    lost = sum(counts_of_counts.get(r, 0) * r * (1 - table[r]) for r in range(1, K + 1))
    if total and lost < 0.5:  # something must be left for unknown words
        table = [1.0] + [(r - 0.5) / r for r in range(1, K + 1)]
        lost = sum(counts_of_counts.get(r, 0) * 0.5 for r in range(1, K + 1))
        if lost == 0:
            return Unigrams(total + 1, kinds, tuple([1.0] * (K + 1)), total / (total + 1))
    return Unigrams(total, kinds, tuple(table), 1 - lost / total if total else 0.0)


def held_out(doc_id, parts: int = 10):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def bucket_cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets met by sorted keys, and where each begins (one place more)."""
    top = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    first = np.flatnonzero(np.diff(top.astype(np.int64), prepend=-1))
    return top[first].astype(np.int64), np.concatenate([first, [len(keys)]])


# ---------------------------------------------------------------- chunks

_ROW = "bucket long, chunk long, kind string, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    b, c, k, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(b, pa.int64()), "chunk": pa.array(c, pa.int64()), "kind": list(k), "data": pa.array(d, pa.binary())})


def _chunks(batches, buckets: int):
    """Per chunk: a row ``chunk`` with its words, and rows ``words`` for the word buckets."""
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 24, 0
    ids, held, texts, size = [], [], [], 0

    def close():
        raw = [(t or "").encode() for t in texts]
        parts = [word_hashes(raw[lo:hi]) for lo, hi in batches_of_bytes(raw)]
        hashes = np.concatenate([h for h, _ in parts])
        lengths = np.concatenate([np.diff(at) for _, at in parts]) + 1
        ends = np.cumsum(lengths) - 1
        tokens = np.empty(int(lengths.sum()), np.uint64)
        body = np.ones(len(tokens), bool)
        body[ends] = False
        tokens[body], tokens[ends] = hashes, END
        words, code = np.unique(tokens, return_inverse=True)
        train = np.repeat(~np.array(held), lengths)
        count = np.bincount(code[train], minlength=len(words))
        rows = [(base + made, base + made, "chunk", pack(words, small(code), small(lengths), np.array([i is not None for i in ids]), np.array([i or 0 for i in ids], np.int64), np.array(held)))]
        met, cut = bucket_cuts(words, buckets)
        rows += [(int(b), base + made, "words", pack(words[lo:hi], small(count[lo:hi]))) for b, lo, hi in zip(met, cut[:-1], cut[1:], strict=True)]
        return _rows(rows)

    for batch in sliced(batches):
        for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
            ids.append(i)
            held.append(h)
            texts.append(t)
            size += len(t or "") // 6 + 1
            if size >= CHUNK:
                yield close()
                made, ids, held, texts, size = made + 1, [], [], [], 0
    if texts:
        yield close()


def _each(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "data")), strict=True)


def _by_bucket(batches):
    """(bucket, rows) of whole buckets from batches sorted by bucket."""
    for bucket, rows in groupby(_each(batches), key=lambda r: r[0]):
        yield bucket, [r[1:] for r in rows]


def _count_words(batches):
    """Counts of each bucket's words: to their chunks, as counts of counts, and as the unigram table."""
    for bucket, rows in _by_bucket(batches):
        parts = [unpack(d) for _, _, d in rows]
        words, code = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(code, np.concatenate([p[1] for p in parts]).astype(np.float64), len(words)).astype(np.int64)
        order = np.argsort(-count, kind="stable")[: (count > 0).sum()]
        place = np.zeros(len(words), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        cut = np.cumsum([0] + [len(p[0]) for p in parts])
        out = [(bucket, chunk, "counts", pack(small(count[code[lo:hi]]), small(place[code[lo:hi]]))) for (chunk, _, _), lo, hi in zip(rows, cut[:-1], cut[1:], strict=True)]
        out.append((bucket, -1, "totals", pack(np.array([count.sum(), (count > 0).sum(), *np.bincount(count[count <= K + 1], minlength=K + 2)[1:]]))))
        yield _rows(out)
        for lo in range(0, len(order), 100_000):
            keep = order[lo : lo + 100_000]
            yield _rows([(bucket, -1, "table", pack(words[keep], small(count[keep]), np.array([lo])))])


def word_numbers(place: np.ndarray, bucket, buckets: int) -> np.ndarray:
    """Number of the word at a place (from 1) of its bucket's table, small for frequent words; 0 if it is in no table."""
    return np.where(place > 0, (place.astype(np.uint64) - np.uint64(1)) * np.uint64(buckets) + np.uint64(bucket) + np.uint64(1), np.uint64(0))


def _look_up_words(batches):
    """Counts and places of the unigram table for the words that chunks of other texts ask for."""
    for bucket, rows in _by_bucket(batches):
        table = [unpack(d) for _, kind, d in rows if kind == "table"]
        words = np.concatenate([t[0] for t in table] or [np.zeros(0, np.uint64)])
        count = np.concatenate([t[1].astype(np.int64) for t in table] + [np.zeros(1, np.int64)])
        place = np.concatenate([t[2][0] + np.arange(1, len(t[0]) + 1) for t in table] + [np.zeros(1, np.int64)])
        order = np.argsort(words)
        for chunk, kind, data in rows:
            if kind == "words":
                at = _found(words, order, unpack(data)[0])
                yield _rows([(bucket, chunk, "counts", pack(small(count[at]), small(place[at])))])


def _found(keys: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` stand among ``keys``, which ``order`` sorts; -1 for those not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted, sorter=order)
    at = order[np.minimum(at, len(keys) - 1)]
    return np.where(keys[at] == wanted, at, -1)


def _hot_words(batches, limit: int, buckets: int):
    for bucket, chunk, kind, data in _each(batches):
        _, count, (start,) = unpack(data)
        hot = np.flatnonzero(count > limit)
        if len(hot):
            yield _rows([(bucket, chunk, kind, pack(word_numbers(start + hot + 1, bucket, buckets), count[hot]))])


def _learn_counts(batches, buckets: int):
    """One row per chunk: its words as numbers with the counts that came back for them; the unknown ones become one."""
    for chunk, rows in _by_bucket(batches):
        words, code, *parts = next(unpack(d) for _, kind, d in rows if kind == "chunk")
        came = sorted((b, unpack(d)) for b, kind, d in rows if kind == "counts")
        count = np.concatenate([c.astype(np.int64) for _, (c, _) in came])
        number, first, own = np.unique(np.concatenate([word_numbers(p, b, buckets) for b, (_, p) in came]), return_index=True, return_inverse=True)
        end = own[np.searchsorted(words, END)]
        yield _rows([(chunk, chunk, "known", pack(small(steps(number)), small(count[first]), np.array([end]), small(own[code]), *parts))])


# ---------------------------------------------------------------- bigrams


@dataclass(frozen=True)
class Deal:
    """How bigrams are dealt to buckets: by context, those of the hot contexts by next word too."""

    buckets: int
    hot: np.ndarray
    parts: np.ndarray

    def __call__(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        key, at = mixed(v * BASE), _found(self.hot, np.arange(len(self.hot)), v)
        if (at >= 0).any():
            part = (mixed(w * BASE) >> np.uint64(32)) * self.parts[at] >> np.uint64(32)
            key = np.where(at >= 0, mixed(key + part * BASE), key)
        return ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def bigram_parts(context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> list[np.ndarray]:
    """Bigrams in order of context as arrays that pack well: steps between contexts, their runs, words and the words' counts."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(context)), bool), context[1:] != context[:-1]]))
    return [small(steps(context[first])), small(np.diff(np.append(first, len(context)))), small(word), small(lower)]


def opened(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, the word's own count) of bigrams packed by ``bigram_parts``."""
    contexts, runs, word, lower = parts[:4]
    return np.repeat(np.cumsum(contexts.astype(np.uint64)), runs.astype(np.int64)), word.astype(np.uint64), lower.astype(np.int64)


def bigram_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(context * BASE + mixed(word + np.uint64(1)))


def _pairs(batches, model: "Trained", deal: Deal, scoring: bool):
    """Per chunk: its bigrams for their buckets and, when scoring, a row ``docs`` that passes through.

    Unknown contexts weigh one, so what follows them is scored here.
    """
    for _, chunk, _, data in _each(batches):
        number, count, (end,), code, lengths, known, ids, held = unpack(data)
        number = np.cumsum(number.astype(np.uint64))
        count, code, lengths = count.astype(np.int64), code.astype(np.int64), lengths.astype(np.int64)
        ends = np.cumsum(lengths) - 1
        before = np.empty(len(code), np.int64)
        before[1:] = code[:-1]
        before[ends - lengths + 1] = end
        doc = np.repeat(np.arange(len(lengths)), lengths)
        after_unknown = number[before] == 0
        if scoring:
            logs = np.log10((count + 0.1) / (model.total_tokens + 0.1 * (model.kinds + 1)))
            base = np.bincount(doc, logs[code], len(lengths))
            seen = np.bincount(doc, count[code] > 0, len(lengths)).astype(np.int64)
            own = np.bincount(doc[after_unknown], np.log10(model.probability(count[code[after_unknown]])), len(lengths))
            yield _rows([(chunk, chunk, "docs", pack(known, ids, held, lengths, seen, base, own))])
        taken = np.flatnonzero(~after_unknown if scoring else np.repeat(~held, lengths))
        pair = before[taken] * len(number) + code[taken]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        times = np.diff(np.append(first, len(pair)))
        v, w = np.divmod(pair[first], len(number))
        bucket = deal(number[v], number[w])
        moved = np.argsort(bucket, kind="stable")
        if scoring:
            doc = doc[taken[order]][np.argsort(np.repeat(bucket, times), kind="stable")]
        v, w, times, bucket = v[moved], w[moved], times[moved], bucket[moved]
        started = np.concatenate([[0], np.cumsum(times)])
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        out = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            parts = [*bigram_parts(number[v[lo:hi]], number[w[lo:hi]], count[w[lo:hi]]), small(times[lo:hi])]
            if scoring:
                parts.append(small(doc[started[lo] : started[hi]]))
            out.append((int(bucket[lo]), chunk, "pairs", pack(*parts)))
            if len(out) == 16 or hi == len(bucket):
                yield _rows(out)
                out = []


def _count_pairs(batches, model: "Trained", hot: np.ndarray):
    """The bigram table of each bucket, its counts of counts, and the sums of its parts of hot contexts."""
    for bucket, rows in _by_bucket(batches):
        parts = [unpack(d) for _, _, d in rows]
        context, word, lower = (np.concatenate(x) for x in zip(*(opened(p) for p in parts), strict=True))
        _, first, code = np.unique(bigram_keys(context, word), return_index=True, return_inverse=True)
        count = np.bincount(code, np.concatenate([p[4] for p in parts]).astype(np.float64), len(first)).astype(np.int64)
        del code, parts
        order = np.lexsort((word[first], context[first]))
        first, count = first[order], count[order]
        context, word, lower = context[first], word[first], lower[first]
        out = [(bucket, -1, "bigrams", pack(*bigram_parts(context, word, lower), small(count)))]
        out.append((bucket, -1, "totals", pack(np.bincount(count[count <= K + 1], minlength=K + 2)[1:])))
        mine = _found(hot, np.arange(len(hot)), context)
        if (mine >= 0).any():
            at, mine, count = mine[mine >= 0], np.flatnonzero(mine >= 0), count[mine >= 0]
            names, at = np.unique(at, return_inverse=True)
            sums = [np.bincount(at, count == r, len(names)) for r in range(1, K + 1)]
            sums += [np.bincount(at, count * (count > K), len(names)), np.bincount(at, model.probability(lower[mine]), len(names))]
            out.append((bucket, -1, "parts", pack(hot[names], *sums)))
        yield _rows(out)


def context_weights(total: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor of the discounted counts, and backoff weight, of contexts.

    ``total`` sums a context's counts, ``kept`` its discounted counts, ``lower`` the unigram
    probabilities of its seen words.  A context of high counts alone leaves one count's share.
    """
    left = np.maximum(1 - kept / total, 1 / (total + 1))
    return (1 - left) / kept, left / np.maximum(1 - lower, 1e-12)


def _weigh(batches, model: "Trained", table: list[float], hot: tuple):
    """Per row of the bigram table: the weights of its contexts; hot contexts bring their sums over all buckets."""
    for bucket, chunk, _, data in _each(batches):
        parts = unpack(data)
        (context, _, lower), count = opened(parts), parts[4].astype(np.int64)
        contexts, at = np.unique(context, return_inverse=True)
        sums = [np.bincount(at, x, len(contexts)) for x in (count, discounted(count.astype(np.float64), table), model.probability(lower))]
        place = _found(hot[0], np.arange(len(hot[0])), contexts)
        sums = [np.where(place >= 0, whole[place], own) if len(whole) else own for own, whole in zip(sums, hot[1:], strict=True)]
        yield _rows([(bucket, chunk, "weights", pack(contexts, *context_weights(*sums)))])


def _score_pairs(batches, model: "Trained", table: list[float], hot: np.ndarray, hot_weight: np.ndarray):
    """Sums of log10 probabilities per document of each message, from the bigrams and weights of its bucket.

    A bucket may hold no bigram of a hot context, part of which it is; that context's weight comes along.

    Recursive per token: the bigram if it is in the table, else the context's weight times the unigram.
    """
    for _bucket, rows in groupby(_each(batches), key=lambda r: r[0]):
        keys, chance, contexts, weight = np.zeros(0, np.uint64), np.zeros(1), np.zeros(0, np.uint64), np.ones(1)
        stored = {}
        for _, chunk, kind, data in rows:
            if kind == "docs":
                yield _rows([(chunk, chunk, kind, data)])
            elif kind != "pairs":  # the model's rows come before all chunks
                stored[kind] = unpack(data)
                if len(stored) == 2:
                    context, word, _ = opened(stored["bigrams"])
                    contexts, factor, weight = stored["weights"]
                    chance = discounted(stored["bigrams"][4].astype(np.float64), table) * factor[np.searchsorted(contexts, context)]
                    keys = bigram_keys(context, word)
                    order = np.argsort(keys)
                    keys, chance = keys[order], np.append(chance[order], 0.0)
                    weight, stored = np.append(weight, 1.0), {}
            else:
                parts = unpack(data)
                context, word, lower = opened(parts)
                p = chance[_found(keys, np.arange(len(keys)), bigram_keys(context, word))]
                alpha = weight[_found(contexts, np.arange(len(contexts)), context)]
                at = _found(hot, np.arange(len(hot)), context)
                alpha[at >= 0] = hot_weight[at[at >= 0]]
                logs = np.log10(np.where(p > 0, p, alpha * model.probability(lower)))
                doc, at = np.unique(parts[5].astype(np.int64), return_inverse=True)
                total = np.bincount(at, np.repeat(logs, parts[4].astype(np.int64)), len(doc))
                yield _rows([(chunk, chunk, "sums", pack(small(doc), total))])


def _finish(batches, total: int):
    for _chunk, rows in _by_bucket(batches):
        known, ids, held, lengths, seen, base, score = next(unpack(d) for _, kind, d in rows if kind == "docs")
        score = score.astype(np.float64)
        for _, kind, data in sorted(rows, key=lambda r: r[2]):
            if kind == "sums":
                doc, sums = unpack(data)
                score[doc.astype(np.int64)] += sums
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids, mask=~known), "held_out": held, "n_tokens": lengths, "n_known": seen,
                "train_tokens": np.full(len(ids), total, np.int64), "base_score": base, "score": score,
            }
        )


# ---------------------------------------------------------------- driver


@dataclass(frozen=True)
class Trained(Unigrams):
    """Unigram totals with the number of training tokens itself (``total`` may hold one more)."""

    total_tokens: int = 0


@dataclass(frozen=True)
class Katz:
    """A trained model: totals and discounts, and the written tables of words, bigrams and weights."""

    totals: Trained
    discounts: tuple
    word_buckets: int
    deal: Deal
    hot_weights: np.ndarray
    words: DataFrame
    bigrams: DataFrame
    weights: DataFrame

    def discard(self) -> None:
        """Delete the tables."""
        for table in (self.words, self.bigrams, self.weights):
            discard(table)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "chunk")


def _kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(F.col("kind") == kind)


def _small_rows(rows: DataFrame):
    """Rows whose number and size have a bound of their own, for the driver."""
    return (unpack(r["data"]) for r in rows.select("data").toLocalIterator())


def _totals(rows: DataFrame) -> list[int]:
    """Sum of the small ``totals`` rows, one of a few numbers for each bucket."""
    found = [0] * (K + 3)
    for (n,) in _small_rows(_kind(rows, "totals")):
        found = [a + int(b) for a, b in zip(found, n, strict=False)]
    return found


def _cut(docs: DataFrame, buckets: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), "text")
    return materialize(rows.mapInArrow(lambda b: _chunks(b, buckets), _ROW), "chunks", by="kind")


def _with_counts(chunks: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    own = F.struct(F.col("chunk").alias("bucket"), F.col("bucket").alias("chunk"), "kind", "data")
    parts = _kind(chunks, "chunk").union(_kind(counts, "counts")).select(own.alias("r")).select("r.*")
    return materialize(_dealt(parts).mapInArrow(lambda b: _learn_counts(b, buckets), _ROW), "known")


def _deal(words: DataFrame, total: int, word_buckets: int, buckets: int) -> Deal:
    """Hot contexts and their parts; a word is followed as often as it occurs."""
    limit = max(HOT, total // MOST_HOT)
    found = list(_small_rows(_kind(words, "table").mapInArrow(lambda b: _hot_words(b, limit, word_buckets), _ROW)))
    hot = np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)])
    count = np.concatenate([f[1].astype(np.int64) for f in found] or [np.zeros(0, np.int64)])
    order = np.argsort(hot)
    return Deal(buckets, hot[order], (-(-count[order] // limit)).astype(np.uint64))


def _hot_sums(bigrams: DataFrame, hot: np.ndarray, table: list[float]) -> tuple:
    """(contexts, sums of counts, of discounted counts, of unigram probabilities) of the hot contexts."""
    sums = np.zeros((K + 2, len(hot)))
    for names, *parts in _small_rows(_kind(bigrams, "parts")):
        sums[:, np.searchsorted(hot, names)] += parts
    r = np.arange(1, K + 1)
    return hot, r @ sums[:K] + sums[K], (r * table[1:]) @ sums[:K] + sums[K], sums[K + 1]


def _learn(docs: DataFrame, buckets: int | None) -> tuple[Katz, DataFrame]:
    """The model of the documents not held out, and all documents as chunks that know their words' counts."""
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = _cut(docs, buckets)
    words = materialize(_dealt(_kind(chunks, "words")).mapInArrow(_count_words, _ROW), "unigrams", by="kind")
    discard(chunks, "kind=words")
    total, kinds, *n = _totals(words)
    uni = unigram_totals(dict(enumerate(n, 1)), total, kinds)
    model = Trained(uni.total, uni.kinds, uni.table, uni.known_mass, total)
    deal = _deal(words, total, buckets, max(buckets, _kind(chunks, "chunk").count() // 2))
    known = _with_counts(chunks, words, buckets)
    discard(chunks)
    discard(words, "kind=counts")
    pairs = known.mapInArrow(lambda b: _pairs(b, model, deal, False), _ROW)
    bigrams = materialize(_dealt(pairs).mapInArrow(lambda b: _count_pairs(b, model, deal.hot), _ROW), "bigrams", by="kind")
    table = discounts(dict(enumerate(_totals(bigrams), 1)))
    hot = _hot_sums(bigrams, deal.hot, table)
    weights = materialize(_kind(bigrams, "bigrams").mapInArrow(lambda b: _weigh(b, model, table, hot), _ROW), "weights", by="kind")
    return Katz(model, tuple(table), buckets, deal, context_weights(*hot[1:])[1], words, bigrams, weights), known


def _score(known: DataFrame, model: Katz) -> DataFrame:
    totals, table, deal, hot_weights = model.totals, list(model.discounts), model.deal, model.hot_weights
    pairs = known.mapInArrow(lambda b: _pairs(b, totals, deal, True), _ROW)
    met = pairs.union(_kind(model.bigrams, "bigrams")).union(model.weights)
    sums = materialize(_dealt(met).mapInArrow(lambda b: _score_pairs(b, totals, table, deal.hot, hot_weights), _ROW), "sums")
    discard(known)
    return _dealt(sums).mapInArrow(
        lambda b: _finish(b, totals.total_tokens),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def train(docs: DataFrame, buckets: int | None = None) -> Katz:
    """A model of the documents that are not held out; ``discard()`` deletes its tables."""
    model, known = _learn(docs, buckets)
    discard(known)
    return model


def score(docs: DataFrame, model: Katz) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of any documents, from a model's tables."""
    chunks = _cut(docs, model.word_buckets)
    met = _kind(chunks, "words").union(_kind(model.words, "table"))
    counts = materialize(_dealt(met).mapInArrow(_look_up_words, _ROW), "counts")
    known = _with_counts(chunks, counts, model.word_buckets)
    discard(chunks)
    discard(counts)
    return _score(known, model)


def score_documents(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, learned from the documents not held out."""
    model, known = _learn(docs, buckets)
    out = _score(known, model)
    model.discard()
    return out
