import pytest

LONG = "Ünder the würd " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, mix int, scan string, repeats int, copies int, spans int, n int, key string"


def prose(seed: int, words: int) -> str:
    """Invented sentences; the same seed gives the same text."""
    out, x = [], seed * 2654435761 + 1
    for k in range(words):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("".join("aeioubcdfg"[(x >> (8 + 5 * j)) % 10] for j in range(2 + (x >> 60))) + ("." if k % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with the operators' own names."""
    base = prose(1, 120)
    texts = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (None, base + " tail"), (None, None), (6, LONG), (7, LONG + "x"), (8, prose(2, 60) + " " + prose(9, 200)), (9, prose(3, 40) + " " + prose(9, 200)), (10, "one"), (11, "One two"), (12, prose(12, 300) + "\n" + prose(12, 300))]
    rows = [(i, t, None if k == 3 else "en", None if k % 5 == 0 else f"src{k % 3}", None, "q", 1, "s", 2, 3, 4, 5, "k") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Distinct texts, exact and near copies, shared passages."""
    rows = [(i, prose(i, 30 + 7 * (i % 40)), "en", f"src{i % 7}") for i in range(150)]
    rows += [(200 + i, rows[i][1], "en", "src0") for i in range(10)]
    for i in range(40):
        w = rows[30 + i % 12][1].split()
        w[i % len(w)] = f"changed{i}"
        rows.append((300 + i, " ".join(w), "de", "src1"))
    rows += [(400 + i, prose(900 + i, 50) + " " + prose(777, 120) + " " + prose(950 + i, 50), "fr", "src2") for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
