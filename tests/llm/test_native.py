"""Quality rules, mixing, fingerprints and licences against plain Python."""

import collections
import functools
import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from priceguard.llm import fingerprints, licenses, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_quality(text):
    t = text or ""
    w = WORD.findall(t)
    runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {p for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base


def test_quality_counts(corpus, messy, empty):
    for docs in (messy, corpus.withColumn("text", F.concat("text", F.lit("\nA line.\nA line.\n# | <>")))):
        for r in quality.clean_lines(docs).select("text", "quality").collect():
            q = r["quality"]
            assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == expected_quality(r["text"])
            assert not (q["base_failed"] and q["kept"])
    assert quality.clean_lines(empty).count() == 0


def test_line_verdicts(spark):
    prose = "The cat sat on the mat, and the dog lay by the door of the old house near the river bank. " * 2
    cases = {prose: True, "HOME | NEWS | SPORT | CONTACT US": False, "This site uses cookies.": False, "SHOUTED!! ALL!! OF!! IT!!": False, "word*** and&&& other$$$ things%%% here.": False, "no punctuation at all": False, "": True}
    cases |= {"彼は毎朝、川のそばを歩きます。": True, "今天天气很好！": True, "यह एक वाक्य है।": True, "هل وصل القطار؟": True, "首页 新闻 体育": False}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "line string, want boolean")
    for r in df.select("*", quality.line_passes(F.col("line"), quality.LineRules()).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_quality_keeps_clean_and_rejects_junk(spark):
    from .conftest import prose as text

    sentences = [f"The river, {text(i, 25)} and {text(50 + i, 20)} end." for i in range(6)]
    menu = "\n".join(f"Item {i} | Shop | Cart | Help | About" for i in range(30))
    rows = [(1, "\n".join(sentences)), (2, menu), (3, "\n".join(sentences) + "\nHome | News | Sport | More"), (4, sentences[0] + "\n" + menu)]
    got = {r["doc_id"]: r["quality"] for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == rows[0][1]
    assert got[3]["kept"] and "Sport" not in got[3]["clean_text"]
    assert not got[2]["kept"] and not got[4]["kept"]


def water_fill(sizes, weights, most=3):
    """Targets by repeated resharing."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= full
    return target


def test_mixing(corpus, messy, empty):
    for docs in (corpus, messy):
        rows = mixing.plan_mixture(docs).select("doc_id", "source", "text", "mix.*").collect()
        assert len(rows) == docs.count()
        by = collections.defaultdict(list)
        for r in rows:
            assert r["size"] == len(WORD.findall(r["text"] or ""))
            assert 0 <= r["taken"] <= 3 * r["size"]
            by[r["source"]].append(r)
        names = sorted((n for n in by if n is not None), key=lambda s: s.encode()) + [None] * (None in by)
        want = water_fill([sum(r["size"] for r in by[n]) for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
        for n, t in zip(names, want, strict=True):
            assert abs(by[n][0]["target"] - t) < 1e-6 * max(1, t)
            assert by[n][0]["source_size"] == sum(r["size"] for r in by[n])
            if docs is corpus:
                assert abs(sum(r["taken"] for r in by[n]) - t) <= 1
    again = mixing.plan_mixture(corpus.repartition(5)).select("doc_id", "mix.taken").collect()
    assert sorted(again) == sorted(mixing.plan_mixture(corpus).select("doc_id", "mix.taken").collect())
    assert mixing.plan_mixture(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_hold_the_words_taken(corpus):
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan_mixture(corpus).select("doc_id", "mix.taken").collect()}
    got = collections.Counter()
    for r in mixing.mixed_documents(corpus).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == collections.Counter({k: v for k, v in plan.items() if v})


def test_longer_documents_are_drawn_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, 5).otherwise(50)).alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    rows = mixing.plan_mixture(docs, weights=(9, 1)).filter("source = 'b'").select("mix.*").collect()
    share = lambda n: sum(r["taken"] > 0 for r in rows if r["size"] == n) / 1000
    assert share(50) > 3 * share(5) > 0


def test_fingerprints(corpus, messy, empty):
    for docs in (corpus, messy.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = fingerprints.fingerprint_documents(docs).collect()
        texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
        after = {i: texts[(k + 1) % len(texts)][1] for k, (i, _) in enumerate(texts)}
        own = dict(texts)
        prints = collections.defaultdict(set)
        for r in rows:
            t = own[r["doc_id"]]
            n = len(t) // 3
            assert r["edited_text"] == t[: len(t) - n] + after[r["doc_id"]][:n]
            assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            prints[t].add(r["fingerprint"])
        assert all(len(v) == 1 for v in prints.values())
    assert fingerprints.fingerprint_documents(messy).count() == messy.count()
    assert fingerprints.fingerprint_documents(empty).count() == 0


def plain_fingerprint(text, k=4, keep=64):
    """The fingerprint from its definition; hashes of arrays are seeded with the hash before."""
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in WORD.findall(text)]
    signed = [x - 2**64 if x >= 2**63 else x for x in h]
    name = lambda lo, hi: functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed), h[lo:hi], 42) & (2**40 - 1)
    if len(h) >= k:
        spots = [i for i in range(len(h) - k + 1) if min(signed[i : i + k]) in (signed[i], signed[i + k - 1])]
    else:
        spots, k = ([0] if h else []), len(h)
    first = {}
    for i in spots:
        first.setdefault(name(i, i + k), i)
    return sorted(first.items())[:keep]


def plain_likeness(a, b, keep=64, slack=64):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    union = sorted({h for h, _ in a} | {h for h, _ in b})[:keep]
    place = dict(b)
    moved = sorted(i - place[h] for h, i in a if h in place and h <= union[-1])
    return sum(abs(d - moved[len(moved) // 2]) <= slack for d in moved) / len(union)


def test_fingerprints_against_their_definition(corpus, messy):
    shown = lambda f: " ".join(f"{h:x}@{i:x}" for h, i in f)
    for docs in (corpus, messy.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
        after = {i: texts[(k + 1) % len(texts)][1] for k, (i, _) in enumerate(texts)}
        for r in fingerprints.fingerprint_documents(docs).collect():
            own, edit, following = (plain_fingerprint(t) for t in (r["text"], r["edited_text"], after[r["doc_id"]]))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(own), shown(edit))
            assert abs(r["near_edited"] - plain_likeness(own, edit)) < 1e-12 and abs(r["near_next"] - plain_likeness(own, following)) < 1e-12


def test_likeness_orders_texts(corpus):
    rows = fingerprints.fingerprint_documents(corpus.filter("doc_id < 150")).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.98 * len(rows)
    assert 0.35 < sum(r["near_edited"] for r in rows) / len(rows) < 0.75


def test_closed_syncmers_do_not_depend_on_context(spark):
    w = [f"w{i * 7919 % 1000}" for i in range(300)]
    df = spark.createDataFrame([(" ".join(w),), (" ".join(["new", "head", *w[100:200], "tail"]),)], "text string")
    a, b = ({x["h"] for x in r[0]} for r in df.select(fingerprints.anchors(F.split("text", " "))).collect())
    inner = spark.createDataFrame([(" ".join(w[100:200]),)], "text string").select(fingerprints.anchors(F.split("text", " "))).first()[0]
    assert {x["h"] for x in inner} <= a & b


def test_license_scan(spark, messy, empty):
    mit = licenses.LICENSES[0][1]
    changed = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,").replace("\n", "\n  ")
    rows = [(1, mit), (2, changed), (3, mit + " and more"), (4, "Some text.\nReleased under the MIT Licence.\nMore."), (5, None), (6, "© 2021 X"), (7, "prose")]
    got = {r["doc_id"]: r["scan"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["MIT", "MIT", None, None, None, None, None]
    assert got[4]["notices"] == ["MIT"] and got[3]["notices"] == []
    assert got[5]["digest"] == hashlib.sha256(b"").hexdigest()
    assert licenses.scan_licenses(messy).count() == messy.count() and licenses.scan_licenses(empty).count() == 0


def test_any_line_of_a_catalogue_is_found(spark):
    known = [("Own-1.0", "Free for all, with thanks."), ("Own-2.0", "Ask first")]
    rows = [(1, "a\n  free for ALL with thanks!\nb\nask, first"), (2, "Ask first"), (3, "Ask first, then"), (4, "\n\n")]
    got = {r["doc_id"]: r["scan"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert [got[i]["notices"] for i in range(1, 5)] == [["Own-1.0", "Own-2.0"], ["Own-2.0"], [], []]
    assert got[2]["license"] == "Own-2.0" and got[1]["license"] is None


def test_license_texts_hard_wrapped_and_whole(spark):
    import textwrap

    wrapped = [(n, w, "\n\n".join(textwrap.fill(x, w, break_long_words=False) for x in t.split("\n\n"))) for n, t in licenses.LICENSES[:9] + licenses.WHOLE[-2:] for w in (40, 56, 62, 66, 70, 72, 76, 79)]
    isc = dict(licenses.LICENSES)["ISC"].replace("above copyright notice", "above\ncopyright notice")
    heads = ["Copyright (c) 2020, Some One", "Copyright Some One", "(c) 2021 Some One\nAll rights reserved.", "Copyright: 2019 Some One"]
    cases = [(n, t) for n, _, t in wrapped] + [("ISC", isc)] + [("ISC", f"{h}\n\n{isc}") for h in heads] + [(n, "\n  ".join(t.split("\n"))) for n, t in licenses.WHOLE]
    cases += [(None, "\n\n".join(dict(licenses.WHOLE)["Unlicense"].split("\n\n")[:3]))]
    rows = [(i, t) for i, (_, t) in enumerate(cases)]
    got = {r["doc_id"]: r["scan"]["license"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(n, t[:60]) for i, (n, t) in enumerate(cases) if got[i] != n] == []
    assert {"Apache-2.0", "BSD-3-Clause", "GPL-3.0-or-later", "Unlicense"} <= {n for n, _ in licenses.WHOLE}


def test_license_sql_knows_the_same_texts_and_rule(spark):
    """The registered SQL against the operator on planted licences, whole, wrapped and stated, and on lines that only begin like a statement."""
    import textwrap

    import duckdb

    from priceguard.llm import oracle, queries

    whole = licenses.LICENSES + licenses.WHOLE
    texts = [t for _, t in whole] + ["\n\n".join(textwrap.fill(x, 60, break_long_words=False) for x in t.split("\n\n")) for _, t in whole]
    texts += [f"{head}\n\n{t}" for head in ("Copyright (c) 2020, Some One", "© 2019 X", "(c) 2021 Some One\nAll rights reserved.") for _, t in whole[:6]]
    texts += ["copyright notice and this permission notice appear in all copies.", "Copyright 2020", "(c) you may\ncopy it", "copyright holders, or else", None, "", "Released under the MIT Licence."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = licenses.scan_licenses(docs).select("doc_id", "scan.digest", "scan.license", F.array_join("scan.notices", ",").alias("notices"))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = {tuple(r) for r in out.collect()}
    assert got == set(con.execute(oracle.ORACLE_SQL["op1_license_scan"]).fetchall())
    assert {r[2] for r in got if r[0] < len(whole)} == {n for n, _ in whole} and queries.QUERIES["op1_license_scan"]
