"""Packing, archives, classifier, join, language model and substring removal against brute force."""

import collections
import hashlib
import io
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priceguard.llm import classifier, katz, ngram_join, packing, suffix_dedup, warc
from priceguard.llm.components import connected_components
from priceguard.llm.queries import tokenizer_path

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(lengths):
    window, offset = packing.best_fit_decreasing(lengths, 64)
    used, want = [], []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [k for k, u in enumerate(used) if u + lengths[i] <= 64]
        k = max(fits, key=lambda k: used[k]) if fits else len(used)
        used += [0] * (k == len(used))
        used[k] += lengths[i]
        want.append((64 - used[k], lengths[i]))
    got, fill = [], collections.Counter()
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        assert fill[window[i]] == offset[i]
        fill[window[i]] += lengths[i]
        got.append((64 - fill[window[i]], lengths[i]))
    assert got == want and all(v <= 64 for v in fill.values())


def test_packing(corpus, messy, empty, tokenizer):
    for docs in (corpus, messy):
        ids = collections.Counter()
        for r in docs.collect():
            full = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            ids[r["doc_id"], tuple(full)] += 1
        rows = packing.pack_documents(docs, tokenizer_path(), with_ids=True, docs_per_shard=40).collect()
        sequences = collections.defaultdict(list)
        for r in rows:
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 4096
        tokens = sum(n * len(full) for (_, full), n in ids.items())
        assert sum(r["length"] for r in rows) == tokens
        wanted = collections.Counter()
        for (i, full), n in ids.items():
            for start in range(0, len(full), 4096):
                piece = np.array(full[start : start + 4096], "<u4").tobytes()
                wanted[i, start, len(piece) // 4, zlib.crc32(piece), len(full)] += n
        assert wanted == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_word_ids_equal_whole_texts(tokenizer):
    table = packing.word_ids(tokenizer_path())
    rng, letters = np.random.default_rng(3), "aAbB'́é.É,!?\x01 \n Σς0ﬁ<|> 😀"
    texts = ["".join(rng.choice(list(letters), rng.integers(0, 40))) for _ in range(1500)]
    texts += ["A. <|ENDOFTEXT|> B! <|EndOfText|>", "12. a... b?! 'c'. »d. e».", "It's he'll I'M <|endoftext|>x<|startoftext|> a\x01b \x01. ΣΑΣ. İstanbul! don't. ...!! 12.5", ""]
    for t, got in zip(texts, table.ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_archives(spark):
    long = "<p>" + "same page " * 50
    rows = [(5, "http://a/", long), (2, "http://b/", long), (9, None, long), (1, "u\r\nx%", None), (3, "u", "tiny"), (4, "u", "tiny"), (None, "u", long), (6, "u", "<b>ü</b>" * 40)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(pages)
    got = {(r["page_id"], r["url"]): r for r in warc.read_archives(spark, manifest).collect()}
    assert len(got) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    for i, url, html in rows:
        r, payload = got[i, url], (html or "").encode()
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
        revisit = html == long and i != 2
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if revisit else ("response", None))
        assert r["payload"] is None if revisit else r["payload"] == payload
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(none)).count() == 0


def test_archive_layout():
    records = [warc.record_bytes(i, "u", f"<p>page {i} of the same kind of site</p>".encode() * 5, "0", None) for i in range(300)]
    data = warc.archive_bytes(records)
    assert data[:4] == warc.FRAME_MAGIC and int.from_bytes(data[4:8], "little") > 0
    import zstandard

    size = int.from_bytes(data[4:8], "little")
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    body, out = data[8 + size :], []
    one = zstandard.ZstdDecompressor(dict_data=words)
    while body:  # every record is a frame by itself
        d = one.decompressobj()
        out.append(d.decompress(body))
        body = d.unused_data
    assert out == records
    broken = io.BytesIO(b"".join([warc.FRAME_MAGIC, (0).to_bytes(4, "little"), zstandard.ZstdCompressor().compress(records[0])]))
    with pytest.raises(ValueError):
        list(warc.read_records(broken))


def test_classifier(spark, messy, empty):
    from .conftest import prose

    rows, labels = [], []
    for i in range(400):
        junk = i % 3 == 0
        t = " ".join(w + "###" for w in prose(i, 60).split()) if junk else prose(i, 60 + i % 50)
        rows.append((i, t))
        labels.append((i, 0 if junk else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = classifier.fit_quality(docs, marks)
    assert 0 < len(model.rules) < 200
    got = classifier.score_quality(docs, model).join(marks, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == r["quality"] for r in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert classifier.score_quality(messy, model).filter("score is null").count() == 0
    assert classifier.score_quality(messy, model).count() == messy.count() and classifier.score_quality(empty, model).count() == 0
    assert classifier.fit_quality(docs, marks.limit(0)).rules == ()


def test_scores_are_the_rules_applied_one_by_one(spark, corpus, messy):
    """The compiled column against the fitted rules, over statistics counted in plain Python."""
    docs = corpus.select("doc_id", "text")
    marks = docs.select("doc_id", (F.length("text") > 700).cast("int").alias("quality"))
    model = classifier.fit_quality(docs, marks)
    assert model.rules
    both = docs.unionByName(messy.select("doc_id", "text"))
    scores = collections.defaultdict(list)
    for r in classifier.score_quality(both, model).collect():
        scores[r["doc_id"]].append(r["score"])
    want = collections.defaultdict(list)
    for r in classifier.statistics(both).collect():
        t, x = r["text"] or "", r["stats"].asDict()
        w = WORD.findall(t)
        n, chars = max(1, len(w)), max(1, len(t))
        plain = {
            "words": len(w), "word_length": sum(map(len, w)) / n, "symbols": sum(c in "#*$%&|<>" for c in t) / chars, "distinct": len(set(w)) / n,
            "echo": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "sentences": len(re.findall(r"[.!?]+(?:\s|$)", t)) / n, "shouts": t.count("!") / n,
        }
        assert all(abs(x[name] - v) < 1e-9 for name, v in plain.items()), (r["doc_id"], plain, x)
        total = model.intercept
        for weight, tests in model.rules:
            if all((x[name] > at) == above for name, above, at in tests):
                total += weight
        want[r["doc_id"]].append(1 / (1 + math.exp(-total)))
    assert scores.keys() == want.keys()
    assert all(np.allclose(sorted(scores[i]), sorted(want[i]), atol=1e-12) for i in want)
    names = classifier.statistics(docs).schema["stats"].dataType.names
    x = np.array([list(r["stats"]) for r in classifier.statistics(both).collect()])
    assert np.allclose(np.sort(model.predict(x, names)), np.sort([v for vs in want.values() for v in vs]), atol=1e-12)


def test_held_out_labels_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 30)) for i in range(200)], "doc_id long, text string")
    a = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    b = a.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert classifier.fit_quality(docs, a) == classifier.fit_quality(docs, b)


def brute_components(rows, percent, size):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        if i is not None:
            sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(i, s) for i, v in sets.items() for s in v if s]
    for a, (i, s) in enumerate(items):
        for j, r in items[:a]:
            both = len(s & r)
            if 100 * both >= percent * (len(s) + len(r) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("percent", "size"), [(85, 4), (80, 5)])
def test_near_copies(corpus, messy, empty, percent, size):
    for docs in (corpus, messy):
        want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], percent, size)
        got = ngram_join.near_copies(docs, percent, size).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
    assert ngram_join.near_copies(empty).count() == 0


def test_texts_of_one_document_keep_all_their_links(spark):
    a, b = prose(61, 100).split(), prose(62, 100).split()
    near = [" ".join([*w[:-1], "other"]) for w in (a, b)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, near[0]), (3, near[1]), (4, prose(63, 90)), (4, prose(63, 90)), (4, None), (None, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.near_copies(docs, 85, 4).collect())
    assert got == [(0, None), (2, 2), (3, 2), (4, 4), (4, 4), (4, 4), (5, 2), (5, 2)]
    kept = ngram_join.keep_one(docs, 85, 4).collect()
    text = {"a": " ".join(a), "b": " ".join(b)}
    want = [(0, text["a"]), (2, near[0]), (3, near[1]), (4, ""), (4, prose(63, 90))]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted(want)
    assert connected_components(docs.selectExpr("doc_id u", "doc_id v").filter("u < 0")).count() == 0


def brute_keep_one(rows, percent, size):
    """Components of texts, by all pairs; of each the row with the least id, then the most shingles."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    usable = sorted({(i, t) for i, t in rows if i is not None and shingles(t)})
    rest, out = usable, [(i, t) for i, t in rows if i is None or not shingles(t)]
    while rest:
        front, group = [rest[0]], {rest[0]}
        while front:
            s = shingles(front.pop()[1])
            more = {r for r in rest if r not in group and 100 * len(s & shingles(r[1])) >= percent * len(s | shingles(r[1]))}
            group |= more
            front += more
        out.append(group)
        rest = [r for r in rest if r not in group]
    return [g if isinstance(g, tuple) else {r for r in g if (r[0], -len(shingles(r[1]))) == min((x[0], -len(shingles(x[1]))) for x in g)} for g in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_one_on_repeated_ids_and_nulls(spark, messy, corpus, seed):
    """Every text stays or has a copy that stays, whatever ids repeat, against all pairs."""
    rng = np.random.default_rng(seed)
    a, b = prose(81, 90), prose(82, 90)
    cut = " ".join(b.split()[:-2])
    planted = [(1, a), (1, None), (2, a), (2, b), (3, b), (4, cut)]
    texts = [None, "", " \n", "one", "One", *(prose(300 + k % 6, 60 + k % 3) for k in range(12))]
    drawn = [(int(rng.integers(0, 12)), texts[rng.integers(0, len(texts))]) for _ in range(50)] + [(None, a), (None, None)]
    tables = [planted, drawn, [(r["doc_id"], r["text"]) for r in messy.collect()], [(r["doc_id"], r["text"]) for r in corpus.limit(220).collect()]]
    for rows in tables:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [tuple(r) for r in ngram_join.keep_one(docs, 80, 5).collect()]
        want = brute_keep_one(rows, 80, 5)
        assert len(got) == len(want)
        for one in want:
            match = [g for g in got if (g in one if isinstance(one, set) else g == one)]
            assert match, one
            got.remove(match[0])
    kept = [tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(planted, "doc_id long, text string"), 80, 5).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, None), (2, b)], key=str)


def test_large_cells_and_keep_one(spark, monkeypatch):
    """Cells over the part size: every member is still linked; one document of the group stays."""
    monkeypatch.setattr(ngram_join, "CELL", 8)
    from .conftest import prose

    base = prose(5, 200).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[(i * 3) % 200] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(50 + i, 80)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.near_copies(docs).filter("doc_id < 100").collect()} == {0}
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == [0, *range(100, 110)]


def test_families_without_their_root(spark, monkeypatch):
    """Copies near the threshold, whose common original is not there, in cells of several components."""
    monkeypatch.setattr(ngram_join, "CELL", 8)
    from .conftest import prose

    rng, rows = np.random.default_rng(2), []
    for family in range(3):
        base = prose(600 + family, 160).split()
        for i in range(40):
            w = list(base)
            for at in rng.choice(160, 1 + i % 3, replace=False):
                w[at] = f"edit{family}x{i}x{at}"
            rows.append((1000 * family + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(docs, 80, 5).collect()}
    assert got == brute_components(rows, 80, 5)
    assert 3 < len(set(got.values())) < 120


def test_unrelated_texts_of_all_sizes_in_one_cell_are_no_suspects():
    """Each pair is held against the bound by the finest groups of the two, whatever else is in their leaf."""
    rng = np.random.default_rng(4)
    sizes = [40] * 12 + [5000] * 6
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in sizes]
    sets.append(np.unique(np.concatenate([sets[-1][:-100], sets[0]])))  # near the last one
    fine = [ngram_join.fine_counts(s) for s in sets]
    points = np.array([ngram_join.folded(f, ngram_join.GROUPS) for f in fine])
    n = np.array([len(s) for s in sets])
    flags, edges = ngram_join.cell_suspects(np.arange(len(sets)), points, n, fine, 80)
    assert np.flatnonzero(flags).tolist() == [17, 18] and [set(e) for e in edges] == [{17, 18}]


def test_shared_passages_of_unrelated_texts_fetch_no_counts(spark, monkeypatch):
    """Members of a cell whose sizes and places rule out a link go before counts and sets are joined; links stay exact."""
    from .conftest import prose

    rows = [(100 * k + j, f"{prose(3000 + 2 * k + j, 70 if j else 500)} {prose(2900 + k, 40)}") for k in range(12) for j in range(2)]
    rows += [(5000 + k, f"{prose(3900, 40)} {prose(3901 + k, 60 * 2**k)}") for k in range(6)]
    for i in range(8):
        w = prose(77, 200).split()
        w[5 + 20 * i] = f"edit{i}"
        rows.append((9000 + i, " ".join(w)))
    held, real = {}, ngram_join.materialize

    def noted(df, name, by=None):
        out = real(df, name, by)
        held[name] = max(held.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", noted)
    monkeypatch.setattr(ngram_join, "KEYS", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(docs, 80, 5).collect()}
    assert got == brute_components(rows, 80, 5) and len(set(got.values())) == 31
    assert held["meeting"] < held["postings"] < 60 and held["meeting"] <= 16 and held.get("sets", 0) <= 8, held


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1), min_size=2, max_size=90))
def test_tree_bound_loses_no_link(sets):
    arrays = [np.sort(ngram_join.mixed(np.array(sorted(s), np.uint64))) for s in sets]
    tree = ngram_join.CountTree(ngram_join.count_points(arrays, 64), np.array([len(a) for a in arrays]), leaf=4, fan=2)
    found = set()
    for a, b in tree.leaf_pairs(80):
        for i, j in zip(*tree.pairs(a, b, 80), strict=True):
            found.add(frozenset((int(tree.order[i]), int(tree.order[j]))))
    for i in range(len(sets)):
        for j in range(i):
            if ngram_join.linked(arrays[i], arrays[j], 80):
                assert frozenset((i, j)) in found
                a, b = (ngram_join.unpacked_counts(ngram_join.packed_counts(ngram_join.fine_counts(arrays[k]))) for k in (i, j))
                assert np.minimum(a, b).sum() >= ngram_join.needed(len(arrays[i]), len(arrays[j]), 80)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def brute_repeats(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


def test_repeats(corpus, messy, empty):
    for docs in (corpus, messy):
        rows = suffix_dedup.remove_repeats(docs).collect()
        want = brute_repeats([r["text"] for r in rows], 400)
        assert [tuple(r["repeats"]) for r in rows] == want and len(rows) == docs.count()
    assert suffix_dedup.remove_repeats(empty).count() == 0


def brute_passage_words(texts, size):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = collections.Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    return [len({j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}) for w in words]


def test_repeats_of_hot_keys_and_passages_that_are_only_counted(spark, corpus, messy):
    shared = prose(77, 120)
    hot = spark.createDataFrame([(i, prose(500 + i, 40 + i % 9) + " " + shared + " " + prose(900 + i, 35)) for i in range(60)], "doc_id long, text string")
    for docs in (hot, corpus.select("doc_id", "text"), messy):
        for hot_runs in (0, 1000):
            rows = suffix_dedup.remove_repeats(docs, 400, min_words=51, cut_words=False, hot_runs=hot_runs).collect()
            texts = [r["text"] for r in rows]
            assert [tuple(r["repeats"])[:4] for r in rows] == brute_repeats(texts, 400)
            assert [r["repeats"]["n_passage_words"] for r in rows] == brute_passage_words(texts, 51)


def test_repeats_of_periodic_and_short_strings(spark):
    texts = ["ab" * 300, "x" * 399, "x" * 400, "x" * 401, "é" * 250 + "tail", "q" * 10 + "é" * 250, "abc" * 400 + "z" + "abc" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert [tuple(r["repeats"]) for r in rows] == brute_repeats([r["text"] for r in rows], 400)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=40), max_size=12))
def test_index_family(batches):
    family, flat = suffix_dedup.IndexFamily(), [x for b in batches for x in b]
    for b in batches:
        family.add(np.array(b, np.uint64))
    count = collections.Counter(flat)
    assert [bool(f) for part in family.repeated for f in part] == [count[x] > 1 for x in flat]
    assert len(family.levels) <= 1 + math.log2(len(flat) + 2)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab", max_size=90), max_size=5))
def test_anchor_runs_hold_every_window_once(texts):
    raw, got = [t.encode() for t in texts], collections.Counter()
    for number, first, last, anchor, _ in suffix_dedup.anchor_runs(raw, 16):
        for n, a, b, q in zip(number, first, last, anchor, strict=True):
            assert a <= q and b <= q <= a + 8
            got.update((int(n), p) for p in range(a, b + 1))
    assert got == collections.Counter((n, p) for n, t in enumerate(raw) for p in range(len(t) - 15))


def good_turing(counts):
    """Discounted value of counts 1..5 by Katz's formula, in plain Python; thin counts of counts keep r - 1/2."""
    n = collections.Counter(counts)
    out = {}
    for r in range(1, 6):
        out[r] = r - 0.5
        if n[1] and n[r]:
            common = 6 * n[6] / n[1]
            if common < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
                if 0 < d < 1:
                    out[r] = r * d
    return out


def katz_by_hand(rows, others=None):
    """Scores of ``others`` (or of the rows themselves) under a model of the rows, with dictionaries only."""
    end = ("end",)

    def cut(rows):
        held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
        return [(i, h, WORD.findall((t or "").translate(LOWER)) + [end]) for (i, t), h in zip(rows, held, strict=True)]

    uni, bi = collections.Counter(), collections.Counter()
    for _, h, w in cut(rows):
        if not h:
            uni.update(w)
            bi.update(zip([end, *w], w, strict=False))
    total, less = sum(uni.values()), good_turing(uni.values())
    if sum(c - less.get(c, c) for c in uni.values()) < 0.5:
        less = {r: r - 0.5 for r in range(1, 6)}
    mass = {w: less.get(c, c) / total for w, c in uni.items()}
    unknown = 1 - sum(mass.values())
    lower = lambda w: mass.get(w, unknown)
    less, follow = good_turing(bi.values()), collections.defaultdict(dict)
    for (v, w), c in bi.items():
        follow[v][w] = c
    p, alpha = {}, {}
    for v, m in follow.items():
        n = sum(m.values())
        q = {w: less.get(c, c) / n for w, c in m.items()}
        used = sum(q.values())
        left = max(1 - used, 1 / (n + 1))
        p[v] = {w: x * (1 - left) / used for w, x in q.items()}
        alpha[v] = left / (1 - sum(lower(w) for w in m))
        free = 1 - sum(lower(w) for w in m)
        assert abs(sum(p[v].values()) + alpha[v] * free - 1) < 1e-9  # exactly normalised
    out = []
    for i, h, w in cut(others or rows):
        base = sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (len(uni) + 1))) for x in w)
        score, v = 0.0, end
        for x in w:
            score += math.log10(p.get(v, {}).get(x) or alpha.get(v, 1.0) * lower(x))
            v = x
        out.append((i, h, len(w), sum(uni[x] > 0 for x in w), total, base, score))
    return out


def same_scores(got, want):
    key = lambda r: tuple((x is None, round(x, 6) if x is not None else 0) for x in r)
    for g, w in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-9)


@pytest.mark.parametrize("hot", [10**9, 12])
def test_katz(corpus, messy, empty, monkeypatch, hot):
    monkeypatch.setattr(katz, "CHUNK", 3000)
    monkeypatch.setattr(katz, "HOT", hot)
    for docs in (corpus.repartition(3), messy):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        same_scores(katz.score_documents(docs).collect(), katz_by_hand(rows))
    assert katz.score_documents(empty).count() == 0


def test_katz_tables_score_other_texts(spark, corpus, messy, empty, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 3000)
    monkeypatch.setattr(katz, "HOT", 40)
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    model = katz.train(corpus)
    assert len(model.deal.hot) and model.deal.parts.max() > 1
    other = [(1, "one two " + rows[3][1]), (2, rows[8][1] + " " + rows[9][1].upper()), (3, None)]
    for docs in (spark.createDataFrame(other, "doc_id long, text string"), messy):
        same_scores(katz.score(docs, model).collect(), katz_by_hand(rows, [(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert katz.score(empty, model).count() == 0
    words, pairs = collections.Counter(), 0
    for r in model.words.filter("kind = 'table'").collect():
        words.update(katz.unpack(r["data"])[1].tolist())
    for r in model.bigrams.filter("kind = 'bigrams'").collect():
        pairs += int(katz.unpack(r["data"])[4].sum())
    assert sum(c * n for c, n in words.items()) == pairs == model.totals.total_tokens
    model.discard()


def test_katz_without_training(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = katz.score_documents(spark.createDataFrame([(held, "a b a")], "doc_id long, text string")).first()
    assert r["n_tokens"] == 4 and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0.0
