"""Document fingerprints from closed syncmers (native).

Symbols are words, hashed to 64 bits.  A run of ``k`` words is a closed syncmer if its
smallest word hash stands at its first or last place; that depends on the run alone, so two
texts that share the run select the same anchor whatever surrounds it.  A fingerprint lists
the ``keep`` smallest distinct anchor hashes with the word position of their first
occurrence, as ``hash@position`` in hexadecimal.  Likeness is the bottom-sketch estimate of
the Jaccard similarity of the anchor sets, counting only shared anchors whose displacement
agrees with the median displacement (positional matching).

Defined cases: doc_ids are integers; null text counts as empty; the fingerprint of a text without words is the
empty string, and two such fingerprints are alike with 1.0; texts of fewer than ``k`` words
have one anchor, the whole; an empty table gives an empty table.  In ``with_successor``, rows
with a null id come last, equal ids follow their texts, and a lone row succeeds itself.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import let, whole, words

MASK = (1 << 40) - 1


def anchors(w: Column, k: int = 4) -> Column:
    """Array of structs (h, i): hash and word position of every closed syncmer."""

    def select(hs: Column) -> Column:
        def edge(i: Column) -> Column:
            least = F.array_min(F.slice(hs, i, k))
            return let(least, lambda m: (F.get(hs, i - 1) == m) | (F.get(hs, i + (k - 2)) == m))

        starts = F.filter(F.sequence(F.lit(1), F.size(hs) - (k - 1)), edge)
        picked = F.transform(
            starts,
            lambda i: F.struct(
                F.xxhash64(F.slice(hs, i, k)).bitwiseAND(F.lit(MASK)).alias("h"), (i - 1).alias("i")
            ),
        )
        alone = F.array(F.struct(F.xxhash64(hs).bitwiseAND(F.lit(MASK)).alias("h"), F.lit(0).alias("i")))
        return F.when(F.size(hs) >= k, picked).when(F.size(hs) > 0, alone).otherwise(F.slice(alone, 1, 0))

    return let(F.transform(w, lambda x: F.xxhash64(x)), select)


def fingerprint(text: Column, k: int = 4, keep: int = 64) -> Column:
    """The fingerprint string of a text column."""

    def sketch(s: Column) -> Column:
        first = F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["h"] != x["h"]))
        return F.array_join(
            F.transform(
                F.slice(first, 1, keep), lambda x: F.concat(F.lower(F.hex(x["h"])), F.lit("@"), F.lower(F.hex(x["i"])))
            ),
            " ",
        )

    return let(F.sort_array(anchors(words(text), k)), sketch)


def likeness(a: Column, b: Column, keep: int = 64, slack: int = 64) -> Column:
    """Likeness of two fingerprint strings, 0 to 1."""

    def parse(f: Column) -> Column:
        return F.when(f == "", F.array().cast("array<struct<h:string,i:bigint>>")).otherwise(
            F.transform(
                F.split(f, " "),
                lambda x: F.struct(
                    F.lpad(F.substring_index(x, "@", 1), 10, "0").alias("h"),
                    F.conv(F.substring_index(x, "@", -1), 16, 10).cast("bigint").alias("i"),
                ),
            )
        )

    def compare(p: Column) -> Column:
        ha, hb = p["a"]["h"], p["b"]["h"]
        places = F.map_from_arrays(hb, p["b"]["i"])
        least = F.slice(F.sort_array(F.array_union(ha, hb)), 1, keep)

        def match(z: Column) -> Column:
            shared = F.filter(
                F.transform(p["a"], lambda x: F.struct(x["h"].alias("h"), (x["i"] - F.try_element_at(z["m"], x["h"])).alias("d"))),
                lambda x: x["d"].isNotNull() & (x["h"] <= F.element_at(z["u"], -1)),
            )

            def aligned(s: Column) -> Column:
                middle = F.element_at(F.sort_array(F.transform(s, lambda x: x["d"])), (F.size(s) / 2).cast("int") + 1)
                return let(middle, lambda m: F.size(F.filter(s, lambda x: F.abs(x["d"] - m) <= slack)))

            count = let(shared, lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(aligned(s)))
            return count / F.size(z["u"])

        return let(F.struct(places.alias("m"), least.alias("u")), match)

    return (
        F.when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(let(F.struct(parse(a).alias("a"), parse(b).alias("b")), compare))
        .cast("double")
    )


def with_successor(rows: DataFrame, order: str, payload: Column, slices: int | None = None) -> DataFrame:
    """``rows`` with column ``successor`` (replacing one of that name): ``payload`` of the next row by ``order`` descending, cyclic.

    Rows are dealt into ``slices`` ranges of the id, so no task orders more than a range; each
    range also gets, as a sentinel, the row that follows its last one.  The driver holds one id
    per range and nothing else.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = slices or max(tasks, min(8 * tasks, 2000))  # several a task, as ranges are dealt by hash
    ids = rows.select(F.col(order).alias("id"))
    cuts = ids.agg(
        F.percentile_approx("id", [i / slices for i in range(1, slices)] or [0.5], 20 * slices)
    ).first()[0]
    bounds = sorted(set(cuts or []))
    table = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    slot = F.coalesce(F.size(F.filter(table, lambda b: b <= F.col(order))), F.lit(0))
    tops = (
        ids.withColumn(order, F.col("id")).select(slot.alias("slot"), "id").groupBy("slot").agg(F.max("id").alias("top"))
    )
    tops = [r for r in tops.orderBy("slot").collect() if r["top"] is not None]
    if not tops:
        return rows.withColumn("successor", F.lead(payload, 1).over(W.orderBy(F.col(order).desc_nulls_last())))
    lowest = tops[0]["slot"]  # not 0 where the least id is itself a bound; rows without an id follow there
    slot = F.when(F.col(order).isNull(), F.lit(lowest)).otherwise(slot)
    held = rows.withColumn("__payload", payload).withColumn("__slot", slot)
    after = {tops[i - 1]["top"]: tops[i]["slot"] for i in range(1, len(tops))}
    follow = [(top, slot_) for top, slot_ in after.items()]
    low = [(tops[-1]["top"], lowest)]
    marks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s")) for t, s in follow + low])
    sentinels = (
        held.filter(F.col(order).isin([t for t, _ in follow + low]))
        .withColumn("__mark", F.explode(F.filter(marks, lambda m: m["t"] == F.col(order))))
        .withColumn("__slot", F.col("__mark")["s"])
        .drop("__mark")
        .withColumn("__sentinel", F.lit(True))
    )
    both = held.withColumn("__sentinel", F.lit(False)).unionByName(sentinels)
    line = W.partitionBy("__slot").orderBy("__sentinel", F.col(order).desc_nulls_last(), "__payload")
    led = both.withColumn("successor", F.lead("__payload").over(line)).filter(~F.col("__sentinel"))
    return led.drop("__payload", "__slot", "__sentinel")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as much of the following text's head."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - third), F.substr(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, k: int = 4, keep: int = 64) -> DataFrame:
    """doc_id, n_chars, text, edited_text, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = docs.select("doc_id", whole(docs["text"]).alias("text"), fingerprint(docs["text"], k, keep).alias("fingerprint"))
    led = with_successor(own, "doc_id", F.struct("text", "fingerprint"))
    nxt = led["successor"]
    both = led.select(
        "doc_id", "text", "fingerprint",
        edited(F.col("text"), F.coalesce(nxt["text"], F.lit(""))).alias("edited_text"),
        F.coalesce(nxt["fingerprint"], F.lit("")).alias("next_fingerprint"),
    )
    both = both.withColumn("edited_fingerprint", fingerprint(F.col("edited_text"), k, keep))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "text", "edited_text", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), keep).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), keep).alias("near_next"),
    )
