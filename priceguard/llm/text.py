"""Column helpers shared by the corpus operators: words, lines and let-bindings.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``.  All helpers
treat a null text as the empty text.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where lambdas use it for every element."""
    return F.transform(F.array(value), body).getItem(0)


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def stripped(text: Column) -> Column:
    return F.btrim(whole(text), F.lit(BLANKS))


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return let(
        stripped(text),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)),
    )


def word_count(text: Column) -> Column:
    """Number of words as a long; no array outlives the expression."""
    return let(
        stripped(text),
        lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, BLANK_RUN))),
    ).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, all else untouched."""
    return F.translate(whole(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_of(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are among ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")
