"""Removal of long repeated substrings with a logarithmic family of suffix indexes.

A byte goes if some string of ``min_bytes`` bytes that covers it also starts somewhere else.
So the suffixes of interest are told apart by their first ``min_bytes`` bytes, and an index
orders suffixes by a 64-bit fingerprint of those.  A batch of suffixes gets its own sorted
array, is merge-scanned against the arrays of the existing levels, and is added as a level;
levels of like size merge, so n batches cost log n merges each.

To keep indexes small and apart, suffixes are grouped by content-chosen anchors: the anchor of
the window at p is the least hashed 8-byte string that begins in its first ``half`` places.
Equal windows have equal anchors at equal distances, so

1. rows with equal text become one text with a number of copies, combined before the shuffle;
2. every run of windows with one anchor is one row keyed by the bytes that follow the anchor
   inside all of them; keys that occur once are dropped (a sum per key, combined likewise);
3. only the remaining runs fetch their bytes and are dealt by key; each task keeps an index
   family over its keys and reports the repeated windows as spans.  Runs of a key with more
   than ``HOT_RUNS`` are not dealt by key: their windows are, by fingerprint, in blocks of
   bounded size, after equal windows of a task have become one;
4. spans are collected per text, and the text is cut.

Texts are known by a 64-bit hash of their content.  A text with copies loses everything if it
has ``min_bytes`` bytes, and it is indexed once.

With ``min_words``, words that lie in a run of so many words that also starts somewhere else
are found too, whatever their bytes and the blanks between them: the same steps take 64-bit
hashes of words in place of bytes, as rows of the same tables.  They are counted, and go
unless ``cut_words`` is false.

Defined cases: null text counts as empty; texts shorter than ``min_bytes`` lose nothing; null
or repeated ids do no harm (rows with equal text are copies of each other); an empty table
gives an empty table; other columns pass through, and one named ``repeats`` is replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import BLANK, batches_of_bytes, mixed, powers, word_hashes
from .storage import discard, materialize, sliced
from .text import whole

MIN_BYTES = 400
PASSAGE_WORDS = 51  # passages of over 50 words
SEGMENT = 1 << 20
GRAM = 8  # bytes that are hashed together; words are hashed each by itself (a gram of 1)
WORDS = np.uint64(0xA0761D6478BD642F)  # told apart from bytes by their keys
HOT_RUNS = 4096  # a key with more runs has its windows dealt by fingerprint
BLOCK = 1 << 18  # windows of such keys that one block holds, about
FLUSH = 1 << 20  # and that a task combines before it sends them


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Scrambled value of the 8 bytes that begin at each place (shorter by 7)."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    return mixed(x)


def prefix_sums(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(grams * powers(len(grams)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, size: int, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` bytes (or words) from each start."""
    return mixed((sums[start + (size - gram + 1)] - sums[start]) * powers(len(sums), inverse=True)[start])


def _joined(pieces: list, gram: int) -> np.ndarray:
    """Gram hashes of byte strings, or of arrays of word hashes, put together."""
    return np.concatenate(pieces) if gram == 1 else gram_hashes(np.frombuffer(b"".join(pieces), np.uint8))


def _units(texts: list[bytes], gram: int) -> list:
    """The texts themselves, or an array of word hashes of each."""
    if gram > 1:
        return texts
    out = []
    for lo, hi in batches_of_bytes(texts, SEGMENT):
        hashes, bounds = word_hashes(texts[lo:hi], lower=False)
        out += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def anchor_runs(texts: list, size: int, gram: int = GRAM):
    """Per batch of segments: text number, first and last window, anchor, and key, as arrays.

    Texts are byte strings, or arrays of word hashes for a gram of 1.  Places are within the
    text; long texts are taken in segments that overlap by size - 1.
    """
    half = size // 2 + 1
    pieces = [(k, s, t[s : s + SEGMENT - 1]) for k, t in enumerate(texts) if len(t) >= size for s in range(0, len(t) - size + 1, SEGMENT - size)]
    raw = [p[2] for p in pieces]
    for lo, hi in batches_of_bytes(raw, SEGMENT):
        grams = _joined(raw[lo:hi], gram)
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 21) - 1)
        least = (sliding_least((grams & ~low) | place, half) & low).astype(np.int64)
        lengths = np.array([len(x) for x in raw[lo:hi]], np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        windows = np.zeros(ends[-1] + 1, np.int64)  # 1 where a window lies in one piece
        np.add.at(windows, begins, 1)
        np.add.at(windows, ends - size + 1, -1)
        inside = np.cumsum(windows[:-1])[: len(least)] > 0
        # texts meet without a gap, so runs are also cut where a piece begins
        fresh = np.ones(len(least), bool)
        fresh[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        starts = np.zeros(ends[-1] + 1, bool)
        starts[begins] = True
        fresh |= starts[: len(least)]
        first = np.flatnonzero(fresh & inside)
        last = np.concatenate([np.flatnonzero(fresh | ~inside), [len(least)]])
        last = last[np.searchsorted(last, first, side="right")] - 1
        anchor = least[first]
        key = range_hash(prefix_sums(grams), anchor, size - half + 1, gram)
        piece = np.searchsorted(ends, first, side="right")
        number = np.array([p[0] for p in pieces[lo:hi]], np.int64)[piece]
        shift = np.array([p[1] for p in pieces[lo:hi]], np.int64)[piece] - begins[piece]
        yield number, first + shift, last + shift, anchor + shift, key


class IndexFamily:
    """Sorted fingerprint arrays of geometrically growing size, over suffixes numbered in the order they came."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.flags = np.zeros(1024, bool)
        self.starts = [0]

    @property
    def repeated(self) -> list[np.ndarray]:
        """For each batch, which of its suffixes have an equal elsewhere."""
        return [self.flags[a:b] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]

    def add(self, prints: np.ndarray) -> None:
        """Index a batch; marks every suffix, new or old, that has an equal elsewhere."""
        count = self.starts[-1]
        self.starts.append(count + len(prints))
        if not len(prints):
            return
        if self.starts[-1] > len(self.flags):
            self.flags = np.concatenate([self.flags, np.zeros(self.starts[-1], bool)])
        order = np.argsort(prints, kind="stable")
        sorted_, number = prints[order], order + count
        twin = sorted_[1:] == sorted_[:-1]
        self.flags[number[1:][twin]] = True
        self.flags[number[:-1][twin]] = True
        for old, names in self.levels:
            at = np.searchsorted(old, sorted_)
            at[at == len(old)] = 0
            hit = old[at] == sorted_ if len(old) else np.zeros(len(sorted_), bool)
            self.flags[number[hit]] = True
            self.flags[names[at[hit]]] = True  # equals further on in the level were marked when they came
        self.levels.append((sorted_, number))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, na), (b, nb) = self.levels[-2:]
            both = np.concatenate([a, b])
            order = np.argsort(both, kind="stable")
            self.levels[-2:] = [(both[order], np.concatenate([na, nb])[order])]


def _anchors(batches, min_bytes: int, min_words: int | None):
    for batch in sliced(batches):
        ids = batch.column("text_id").to_numpy()
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        for size, gram in _kinds(min_bytes, min_words):
            for number, first, last, anchor, key in anchor_runs(_units(texts, gram), size, gram):
                columns = {"text_id": ids[number], "words": np.full(len(first), gram == 1), "first": first, "last": last, "anchor": anchor}
                key = key ^ WORDS if gram == 1 else key
                yield pa.RecordBatch.from_pydict(columns | {"key": key.view(np.int64)})


def _kinds(min_bytes: int, min_words: int | None) -> list[tuple[int, int]]:
    """Window size and gram for bytes and, if asked for, for words."""
    return [(min_bytes, GRAM)] + ([(min_words, 1)] if min_words else [])


def window_prints(pieces: list, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, key: np.ndarray, size: int, gram: int):
    """Fingerprints of all windows of the runs, the run of each, and its number within the run."""
    sums = prefix_sums(_joined(pieces, gram))
    count = last - first + 1
    begin = np.concatenate([[0], np.cumsum(count + size - 1)[:-1]])
    run = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    distance = (anchor - first)[run] - step
    prints = range_hash(sums, begin[run] + step, size, gram)
    return mixed(prints ^ mixed(key.view(np.uint64))[run]) + distance.astype(np.uint64), run, step


def _as_spans(text_id: np.ndarray, words: np.ndarray, place: np.ndarray, sizes: dict[bool, int]) -> dict:
    """Windows that begin at the places, as spans [from, to): neighbours become one."""
    order = np.lexsort((place, text_id, words))
    text_id, words, place = text_id[order], words[order], place[order]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (np.diff(text_id) != 0) | (words[1:] != words[:-1]) | (np.diff(place) > 1)
    start = np.flatnonzero(fresh)
    stop = np.concatenate([start[1:], [len(place)]]) - 1 if len(start) else start
    size = np.where(words[start], sizes.get(True, 0), sizes[False])
    return {"text_id": text_id[start], "words": words[start], "from": place[start], "to": place[stop] + size}


_CONTEXT = pa.schema(
    [("deal", pa.int64()), ("kind", pa.int8()), ("text_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("anchor", pa.int64()), ("key", pa.int64()), ("data", pa.binary())]
)
_CONTEXT_SQL = "deal long, kind byte, text_id long, first long, last long, anchor long, key long, data binary"
_BYTES, _WORD_RUN, _WINDOWS, _DONE = range(4)  # kinds of rows: runs of bytes, runs of words, windows by fingerprint, spans already known
_WINDOW = np.dtype([("print", "<u8"), ("text_id", "<i8"), ("place", "<i8"), ("words", "?"), ("known", "?")])


class _Windows:
    """Windows of hot keys in one task: equal ones become one before they are sent by fingerprint."""

    def __init__(self, blocks: int, sizes: dict[bool, int]):
        self.blocks, self.sizes, self.held, self.count = blocks, sizes, [], 0

    def add(self, prints, text_id, place, words):
        one = np.empty(len(prints), _WINDOW)
        one["print"], one["text_id"], one["place"], one["words"], one["known"] = prints, text_id, place, words, False
        self.held.append(one)
        self.count += len(one)
        if self.count >= FLUSH:
            yield from self.flush()

    def flush(self):
        if not self.count:
            return
        all_ = np.concatenate(self.held)
        self.held, self.count = [], 0
        all_ = all_[np.argsort(all_["print"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], np.diff(all_["print"]) != 0]))
        times = np.diff(np.concatenate([first, [len(all_)]]))
        again = np.repeat(times > 1, times)
        spans = _as_spans(all_["text_id"][again], all_["words"][again], all_["place"][again], self.sizes)
        rows = [(t, _DONE, t, lo, hi, int(w), 0, b"") for t, w, lo, hi in zip(*(x.tolist() for x in spans.values()), strict=True)]
        one = all_[first]
        one["known"] = times > 1
        block = ((one["print"] >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        for lo, hi in zip(cut, np.concatenate([cut[1:], [len(one)]]), strict=True):
            rows.append((int(mixed(block[lo : lo + 1].astype(np.uint64)).view(np.int64)[0]), _WINDOWS, 0, 0, 0, 0, 0, one[lo:hi].tobytes()))
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096], strict=True), _CONTEXT.types, strict=True)], schema=_CONTEXT)


def _contexts(batches, min_bytes: int, min_words: int | None, blocks: int):
    """The bytes (or word hashes) of the runs, dealt by key; windows of hot keys, dealt by fingerprint."""
    windows = _Windows(blocks, {gram == 1: size for size, gram in _kinds(min_bytes, min_words)})
    for batch in sliced(batches):
        ids, listed = batch.column("text_id").to_numpy(), batch.column("runs")
        cut = np.asarray(listed.offsets) - listed.offsets[0].as_py()
        runs = {c: listed.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("words", "hot", "key", "first", "last", "anchor")}
        for k, text in enumerate(batch.column("text").to_pylist()):
            raw = (text or "").encode()
            for size, gram in _kinds(min_bytes, min_words):
                at = np.arange(cut[k], cut[k + 1])
                at = at[runs["words"][at] == (gram == 1)]
                if not len(at):
                    continue
                data = _units([raw], gram)[0]
                for part in np.array_split(at, -(-len(at) // 4096)):
                    first, last, anchor, key, hot = (runs[c][part] for c in ("first", "last", "anchor", "key", "hot"))
                    pieces = [data[a : b + size] for a, b in zip(first, last, strict=True)]
                    if hot.any():
                        chosen = [p for p, h in zip(pieces, hot, strict=True) if h]
                        prints, run, step = window_prints(chosen, first[hot], last[hot], anchor[hot], key[hot], size, gram)
                        yield from windows.add(prints, ids[k], first[hot][run] + step, gram == 1)
                    rest = ~hot
                    if rest.any():
                        held = [bytes(p) for p, h in zip(pieces, hot, strict=True) if not h]
                        n = len(held)
                        columns = [key[rest], np.full(n, _WORD_RUN if gram == 1 else _BYTES, np.int8), np.full(n, ids[k]), first[rest], last[rest], anchor[rest], key[rest]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _CONTEXT.types, strict=False)), pa.array(held, pa.binary())], schema=_CONTEXT)
    yield from windows.flush()


def _spans(batches, min_bytes: int, min_words: int | None):
    """Index family over the windows of one task: spans [from, to) of repeated ones."""
    family, rows, waiting = IndexFamily(), [], []
    sizes = {gram == 1: size for size, gram in _kinds(min_bytes, min_words)}

    def hold(prints, *row):
        waiting.append(prints)
        rows.append(row)
        if sum(map(len, waiting)) >= FLUSH:
            index()

    def index():
        if waiting:
            family.add(np.concatenate(waiting))
            waiting.clear()

    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for kind, size, gram in ((_BYTES, min_bytes, GRAM), (_WORD_RUN, min_words, 1)):
            if not (kinds == kind).any():
                continue
            part = batch.filter(pa.array(kinds == kind))
            text_id, first, last, anchor, key = (part.column(c).to_numpy() for c in ("text_id", "first", "last", "anchor", "key"))
            pieces = part.column("data").to_pylist()
            prints, _, _ = window_prints([np.frombuffer(x, np.uint64) for x in pieces] if gram == 1 else pieces, first, last, anchor, key, size, gram)
            hold(prints, text_id, first, last - first + 1, np.full(len(text_id), gram == 1), None)
        if (kinds == _WINDOWS).any():
            w = np.concatenate([np.frombuffer(x, _WINDOW) for x in batch.filter(pa.array(kinds == _WINDOWS)).column("data").to_pylist()])
            hold(w["print"], w["text_id"], w["place"], np.ones(len(w), np.int64), w["words"], w["known"])
        if (kinds == _DONE).any():
            part = batch.filter(pa.array(kinds == _DONE))
            lo, hi, words = (part.column(c).to_numpy() for c in ("first", "last", "anchor"))
            yield pa.RecordBatch.from_pydict({"text_id": part.column("text_id"), "words": words == 1, "from": lo, "to": hi})
    index()
    at = 0
    for text_id, first, count, words, known in rows:
        flags = family.flags[at : at + count.sum()]
        at += len(flags)
        flags = flags if known is None else flags & ~known  # known ones have been reported
        if flags.any():
            run = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            run, step = run[flags], step[flags]
            yield pa.RecordBatch.from_pydict(_as_spans(text_id[run], words[run], first[run] + step, sizes))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted union of half-open spans; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def word_spans_as_bytes(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, from the first byte of a word to the last of another."""
    edge = np.flatnonzero(np.diff(BLANK[np.frombuffer(data, np.uint8)], prepend=True, append=True))
    return [(int(edge[2 * lo]), int(edge[2 * hi - 1])) for lo, hi in spans]


def word_count(data: bytes) -> int:
    return len(np.flatnonzero(np.diff(BLANK[np.frombuffer(data, np.uint8)], prepend=True, append=True))) // 2


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, min_words: int | None = None, hot_runs: int = HOT_RUNS) -> DataFrame:
    """text_id, copies, spans and word_spans (arrays of from, to) of every text with a repeat or with copies.

    ``word_spans`` counts words and is empty without ``min_words``.
    """
    least = min(min_bytes, 2 * min_words - 1) if min_words else min_bytes  # words and the blanks between them
    rows = docs.select(F.xxhash64(whole(docs["text"])).alias("text_id"), "text").filter(F.octet_length("text") >= least)
    texts = materialize(rows.groupBy("text_id").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts")
    copied = materialize(texts.filter("copies > 1").select("text_id", "copies"), "copies")
    runs = texts.select("text_id", "text").mapInArrow(
        lambda b: _anchors(b, min_bytes, min_words), "text_id long, words boolean, first long, last long, anchor long, key long"
    )
    runs = materialize(runs, "runs")
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = materialize(keys.withColumn("hot", F.col("n") > hot_runs), "keys")  # a table: so a hot key's rows can be split in the join
    windows = (keys.filter("hot").agg(F.sum("n")).first()[0] or 0) * min_bytes // 2
    again = materialize(runs.join(keys.select("key", "hot"), "key"), "repeated-runs")
    discard(runs)
    discard(keys)
    wanted = again.groupBy("text_id").agg(F.collect_list(F.struct("words", "hot", "key", "first", "last", "anchor")).alias("runs"))
    # a table: so the shuffles of the texts and of the windows are not on disk together
    held = materialize(texts.select("text_id", "text").join(wanted, "text_id").select("text_id", "text", "runs"), "texts-with-runs")
    for table in (texts, again):
        discard(table)
    blocks = windows // BLOCK + 1
    contexts = held.mapInArrow(lambda b: _contexts(b, min_bytes, min_words, blocks), _CONTEXT_SQL)
    spans = contexts.repartition("deal").mapInArrow(lambda b: _spans(b, min_bytes, min_words), "text_id long, words boolean, `from` long, `to` long")
    spans = materialize(spans, "spans")
    discard(held)
    whole_texts = copied.select("text_id", "copies", F.lit(False).alias("words"), F.lit(None).cast("struct<from:long,to:long>").alias("span"))
    both = whole_texts.unionByName(spans.select("text_id", F.lit(1).cast("long").alias("copies"), "words", F.struct("from", "to").alias("span")))
    found = both.groupBy("text_id").agg(
        F.max("copies").alias("copies"), F.collect_list(F.when(~F.col("words"), F.col("span"))).alias("spans"), F.collect_list(F.when(F.col("words"), F.col("span"))).alias("word_spans")
    )
    found = materialize(found, "repeats")
    discard(copied)
    discard(spans)
    return found


def remove_repeats(
    docs: DataFrame, min_bytes: int = MIN_BYTES, as_text: bool = False, min_words: int | None = None, cut_words: bool = True, hot_runs: int = HOT_RUNS
) -> DataFrame:
    """``docs`` with a struct ``repeats``: n_bytes, n_removed, n_spans (long) and kept (the bytes that stay).

    With ``min_words`` also n_passage_words (long): the words in repeated runs of so many words.
    ``as_text`` gives kept as a string, without what is left of characters that were cut through.
    """
    columns = [c for c in docs.columns if c != "repeats"]
    found = repeated_spans(docs, min_bytes, min_words, hot_runs).select(
        F.col("text_id").alias("__found"), F.col("copies").alias("__n"), F.col("spans").alias("__spans"), F.col("word_spans").alias("__words")
    )
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64(whole(docs["text"])).alias("__id"))
    joined = keyed.join(found, F.col("__id") == F.col("__found"), "left").withColumn("__copies", F.coalesce("__n", F.lit(1)))
    joined = joined.select(*[F.col(f"`{c}`") for c in columns], "__copies", "__spans", "__words")
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string() if as_text else pa.binary())]
    fields += [("n_passage_words", pa.int64())] if min_words else []
    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}
    result = T.StructType([T.StructField(n, kinds[t]) for n, t in fields])
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("repeats", result)])

    def cut(batches):
        kind = pa.struct(fields)
        for batch in sliced(batches):
            out = []
            for text, copies, spans, words in zip(*(batch.column(c).to_pylist() for c in ("text", "__copies", "__spans", "__words")), strict=True):
                data = (text or "").encode()
                copied_words = copies > 1 and min_words and word_count(data) >= min_words
                in_words = [(0, word_count(data))] if copied_words else merge_spans([(s["from"], s["to"]) for s in words or ()])
                if copies > 1 and (len(data) >= min_bytes or copied_words and cut_words):
                    merged = [(0, len(data))]
                else:
                    by_words = word_spans_as_bytes(data, in_words) if in_words and cut_words else []
                    merged = merge_spans([(s["from"], s["to"]) for s in spans or ()] + by_words)
                stays, at = [], 0
                for lo, hi in merged:
                    stays.append(data[at:lo])
                    at = hi
                kept = b"".join([*stays, data[at:]])
                kept_as = kept.decode(errors="ignore") if as_text else kept
                one = {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(merged), "kept": kept_as}
                out.append(one | {"n_passage_words": sum(hi - lo for lo, hi in in_words)} if min_words else one)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, kind)], names=[*columns, "repeats"])

    return joined.mapInArrow(cut, schema)


def deduplicated(docs: DataFrame, min_bytes: int = MIN_BYTES, min_words: int | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out of the text."""
    out = remove_repeats(docs, min_bytes, as_text=True, min_words=min_words)
    return out.withColumn("text", F.col("repeats")["kept"]).drop("repeats")
