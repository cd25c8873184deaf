"""Every stage of the corpus pipeline, alone and together."""

import re

import corpus_pipeline
import pytest

from .conftest import prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_survives_odd_input(spark, messy, empty, k):
    _, stage = corpus_pipeline.STAGES[k]
    for docs in (messy, empty):
        out = stage(spark, docs.select(*COLUMNS), None)
        out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
    assert stage(spark, empty.select(*COLUMNS), None).count() == 0


def test_run(spark, tmp_path):
    good = lambda i: ". ".join(" ".join(prose(100 * i + k, 14).split()).replace(".", "") for k in range(12)).capitalize() + "."
    shared = "Then " + good(77) * 1
    rows = [(i, good(i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, good(i), "en", "s0") for i in range(5)]  # copies
    rows += [(200 + i, good(40 + i) + "\n" + shared + "\n" + good(60 + i), "en", "s1") for i in range(4)]  # a shared passage
    rows += [(300, "A | B | C | D | E | F\n" * 40, "en", "s2"), (301, None, "en", None), (302, "", None, "s2")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, texts = {}, {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        texts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept[name] = set(texts[name])
    assert kept["quality rules"] == {r[0] for r in rows} - {300, 301, 302}
    assert kept["n-gram Jaccard join"] == kept["quality rules"] - {100, 101, 102, 103, 104}
    assert all(shared not in t for t in texts["suffix-array dedup"].values())
    assert all(texts["suffix-array dedup"][i] == texts["quality rules"][i] for i in range(30))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r["doc_id"] for r in out} <= kept["suffix-array dedup"]
    assert sum(r["length"] for r in out) > 0 and all(re.fullmatch(r"\d+", str(r["sequence_id"])) for r in out)


def test_passages_of_over_50_words_go_whatever_their_bytes(spark):
    short = lambda seed, n: " ".join(w[:4] for w in prose(seed, n).split())
    shared, spared = short(500, 51), short(501, 50)
    assert len(shared) < 400
    own = [short(600 + i, 40) for i in range(6)]
    rows = [
        (1, f"{own[0]} {shared} {own[1]}"), (2, f"{own[2]}\n{shared.replace(' ', '  ', 3)}\n{own[3]}"),
        (3, f"{own[4]} A {spared} B"), (4, f"C {spared} D {own[5]}"),
        (5, "W" * 300 + " " + "V" * 150), (6, "U " + "W" * 300 + " " + "V" * 150),
        (7, "i " * 51), (8, "i " * 51), (9, "o " * 7), (10, "o " * 7),
    ]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, None).collect()}
    assert got[1].split() == (own[0] + " " + own[1]).split() and got[2].split() == (own[2] + " " + own[3]).split()
    assert [got[i] for i in (3, 4, 9, 10)] == [rows[i - 1][1] for i in (3, 4, 9, 10)]
    assert 5 not in got and got[6].strip() == "U" and 7 not in got and 8 not in got


def test_word_passages_against_brute_force(spark):
    pool = [prose(800 + k, 30 + 9 * k).split() for k in range(6)]
    texts = {i: " ".join(prose(i, 20 + i).split() + pool[i % 6] + prose(70 + i, 5).split() + pool[i * 5 % 6] + prose(90 + i, 9).split()) for i in range(24)}
    seen = {}
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 50):
            seen.setdefault(tuple(w[k : k + 51]), []).append((i, k))
    gone = {(i, p) for at in seen.values() if len(at) > 1 for i, k in at for p in range(k, k + 51)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    # so many bytes that only words count
    for r in corpus_pipeline.suffix_dedup.deduplicated(docs, 1 << 20, min_words=corpus_pipeline.PASSAGE_WORDS).collect():
        assert r["text"].split() == [x for p, x in enumerate(texts[r["doc_id"]].split()) if (r["doc_id"], p) not in gone]
    assert gone
