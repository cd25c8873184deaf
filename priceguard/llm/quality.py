"""Line-first cleaning (native).

Every line is judged on its own by punctuation, navigation and boilerplate rules; failing
lines are removed, and a document that loses too much of its text is rejected.  All of it
is column expressions on one scan: no shuffle, no Python.

Defined cases: a null text counts as empty; an empty text has no words, fails the base rule
and is not kept; repeated rows give repeated results; an empty table gives an empty table;
other columns pass through, and one named ``quality`` is replaced.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANKS, count_of, let, whole, words

SYMBOLS = "#*$%&|<>"
#: Marks of sentences and clauses: Latin, Chinese and Japanese, Devanagari, Arabic, Armenian, Ethiopic, Burmese, Khmer.
MARKS = ".!?…,;:。！？，、；：।॥؟،؛։።၊။៕"
BOILERPLATE = (
    r"(?i)(javascript|cookie|terms of (use|service)|privacy policy|all rights reserved"
    r"|lorem ipsum|click here|sign (in|up)|log ?in|subscribe|share (this|on))"
)


@dataclass(frozen=True)
class LineRules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    symbol_share: float = 0.05
    min_separators: int = 3
    boilerplate_chars: int = 200
    min_kept_share: float = 0.7


def repeated_words(w: Column, window: int) -> Column:
    """Words lying in a ``window``-word run that occurs twice or more in the text, first included.

    Windows become 64-bit hashes; only texts with an equal pair of hashes sort them, so the
    cost is n log n in the text's own words and nothing leaves the row.
    """

    def hashes(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws) - (window - 1))
        return F.when(
            F.size(ws) >= window, F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, window)))
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            last = F.size(s) - 1
            twin = F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])),
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        return F.aggregate(
            let(ranked, flagged),
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")),
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(window), p - a["at"])).alias("n"), p.alias("at")
            ),
            lambda a: a["n"],
        )

    return let(
        let(w, hashes),
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)),
    ).cast("long")


def line_passes(line: Column, rules: LineRules) -> Column:
    """Verdict on one line (a blank line passes: it has nothing to remove)."""
    size = F.length(line)
    marked = line.rlike(r"[#*$%&|<>»•]")  # most lines have none, and are not counted through
    symbols = F.when(marked, F.length(line) - F.length(F.translate(line, SYMBOLS, ""))).otherwise(F.lit(0))
    separators = F.length(line) - F.length(F.translate(line, "|>»•", ""))
    shouted = (line == F.upper(line)) & (line != F.lower(line))
    navigation = marked & (separators >= rules.min_separators) & (separators * 40 >= size)
    boilerplate = (size <= rules.boilerplate_chars) & line.rlike(BOILERPLATE)
    punctuated = line.rlike(f"[{MARKS}]")
    return (size == 0) | (
        punctuated & ~shouted & (symbols <= size * rules.symbol_share) & ~navigation & ~boilerplate
    )


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality`` beside its own columns.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), clean_text (the passing lines), kept_share (double).
    """
    t = whole(docs[text])

    def judge(lines: Column) -> Column:
        return F.filter(lines, lambda x: line_passes(F.btrim(x, F.lit(BLANKS)), rules))

    def shares(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        again = let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        return F.struct(F.array_join(judge(lines), "\n").alias("clean_text"), again.alias("n_dup_lines"))

    counts = let(
        words(docs[text]),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w, rules.window).alias("n_repeat_words"),
        ),
    )
    lined = let(F.split(t, "\n"), shares)

    def verdict(c: Column, li: Column) -> Column:
        base = (c["n_words"] < rules.min_words) | (
            c["n_repeat_words"] * 100 > c["n_words"] * rules.max_repeat_percent
        )
        share = F.length(li["clean_text"]) / F.greatest(F.length(t), F.lit(1))
        return F.struct(
            c["n_words"].alias("n_words"),
            c["word_chars"].alias("word_chars"),
            F.when(t.rlike(r"[#*$%&|<>]"), count_of(t, SYMBOLS)).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
            li["n_dup_lines"].alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            base.alias("base_failed"),
            (~base & (share >= rules.min_kept_share)).alias("kept"),
            li["clean_text"].alias("clean_text"),
            share.alias("kept_share"),
        )

    quality = let(F.struct(counts.alias("c"), lined.alias("l")), lambda x: verdict(x["c"], x["l"]))
    return docs.withColumn("quality", quality)
