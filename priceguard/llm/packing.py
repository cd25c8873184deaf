"""Packing token sequences by best-fit decreasing.

Documents are tokenised, closed with an end id, and cut: first into full windows, then one
remainder.  Pieces are dealt into shards of about ``docs_per_shard`` documents; inside a shard
they are placed longest first, each into the tightest open window that still holds it.  The
tightest window is found with a segment tree over remaining capacities, so a placement costs
log2(capacity) steps whatever the number of open windows.

Only (document, start, length, checksum) is shuffled; token ids travel only when asked for.
Word ids are looked up in a bounded per-worker table: the pre-tokeniser never crosses white
space, so a text's ids are its words' ids in a row.

Defined cases: null text counts as empty and becomes the end id alone; a null doc_id is kept;
repeated rows are packed each on its own; a document longer than a window spans several
pieces; an empty table gives an empty table; columns beside doc_id and text are ignored.
"""

import re
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import sliced

CAPACITY = 4096
END_ID = 2
DOCS_PER_SHARD = 4096
WORD_TABLE = 800_000
CLOSING = re.compile(rb"[.,!?;:*%$&#|](?<=[a-z0-9][.,!?;:*%$&#|])[.,!?;:*%$&#|]*(?=[\x20\x09-\x0D]|\Z)")
_tables: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Word (UTF-8) to its ids as little-endian unsigned 32-bit bytes; at most ``WORD_TABLE`` entries between batches.

    Words are encoded many at a time with a control character between them, a token of its own
    that blanks keep apart from its neighbours.  Texts are lower-cased and closing punctuation is
    set apart before they are split, as the tokeniser does both itself, so the table holds fewer
    words; this is switched off for tokenisers that do not, and for texts with special tokens.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        one, ab, trial = (self._encode([t])[0].tolist() for t in ("\x01", "ab", "ab \x01 ab"))
        self.apart = one[0] if len(one) == 1 and trial == [*ab, *one, *ab] else None
        parts = [x for t in ("ab", ".,", "cd", "!") for x in self._encode([t])[0].tolist()]
        self.apart_closing = self.apart is not None and self._encode(["AB., cD!"])[0].tolist() == parts
        self.marks = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.encode(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> None:
        alone = [w for w in words if self.apart is None or b"\x01" in w]
        self.update((w, ids.tobytes()) for w, ids in zip(alone, self._encode([w.decode() for w in alone]), strict=True))
        if self.apart is None:
            return
        rest = [w for w in words if b"\x01" not in w]
        for at in range(0, len(rest), 20_000):
            groups = [rest[k : k + 200] for k in range(at, min(at + 20_000, len(rest)), 200)]
            for group, ids in zip(groups, self._encode([b" \x01 ".join(g).decode() for g in groups]), strict=True):
                raw, ends = ids.tobytes(), [*(4 * np.flatnonzero(ids == self.apart)).tolist(), 4 * len(ids)]
                start = 0
                for w, end in zip(group, ends, strict=True):
                    self[w] = raw[start:end]
                    start = end + 4

    def learn(self, words: set) -> None:
        """Put the ids of all ``words`` into the table."""
        new = list(words.difference(self))
        if len(self) + len(new) > WORD_TABLE:
            self.clear()
            new = list(words)
        self._encode_words(new)

    def _plain(self, text: bytes) -> bytes:
        low = text.lower()  # A-Z only
        if not self.apart_closing or any(m in low for m in self.marks):
            return text
        return CLOSING.sub(rb" \g<0>", low)

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [self._plain((t or "").encode()).split() for t in texts]  # on [\x20\x09-\x0D]
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, words)) for words in split]


def word_ids(path: str) -> WordIds:
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which have an open window."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` with an open window."""
        node, count = need + self.size, self.count
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(lengths, capacity: int = CAPACITY):
    """Window number and offset of each piece (given order is kept among equal lengths)."""
    tree, open_at = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    window, offset, used = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[i]
        room = tree.tightest(size)
        if room is None:
            at, room, used = used, capacity, used + 1
        else:
            at = open_at[room].pop()
            tree.change(room, -1)
        window[i], offset[i] = at, capacity - room
        if room > size:
            open_at[room - size].append(at)
            tree.change(room - size, 1)
    return window, offset


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, deal (unique in the run) and, if asked, ids (binary)."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "deal")]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )

    def cut(batches):
        from pyspark import TaskContext

        table, deal = word_ids(tokenizer_path), TaskContext.get().partitionId() << 40
        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in sliced(batches):
            rows = {n: [] for n in ("at", "start", "length", "ids_crc32", "doc_tokens", "deal", "ids")}
            for k, ids in enumerate(table.ids(batch.column("text").to_pylist())):
                ids += end
                for start in range(0, len(ids), step):
                    piece = ids[start : start + step]
                    for name, value in zip(rows, (k, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, deal, piece if with_ids else None), strict=True):
                        rows[name].append(value)
                    deal += 1
            columns = [batch.column("doc_id").take(pa.array(rows["at"], pa.int64()))]
            columns += [pa.array(rows[n], pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "deal")]
            columns += [pa.array(rows["ids"], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """The pieces with sequence_id and offset (and their ids if asked).  A sequence lies in one shard."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, with_ids)
    shards = max(1, ceil(docs.count() / docs_per_shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)).cast("long"))
    kept = [c for c in pieces.columns if c != "deal"]
    schema = T.StructType(
        [pieces.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("deal")  # the same order in every attempt
        window, offset = best_fit_decreasing(group.column("length").to_pylist(), capacity)
        base = group.column("shard")[0].as_py() << 32 if group.num_rows else 0
        out = group.select(kept)
        out = out.append_column("sequence_id", pa.array(np.array(window, dtype=np.int64) + base))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("shard").applyInArrow(place, schema)
