"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads: all but the last
return the columns of ``documents``.  ``run`` writes every stage's result in the shared folder
and hands the reread table on.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceguard.llm import mixing, ngram_join, packing, quality, suffix_dedup
from priceguard.llm.queries import tokenizer_path
from priceguard.llm.storage import materialize

PASSAGE_WORDS = 51  # passages of over 50 words are repeats, however few bytes they have
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from the texts, and documents that lose too much go altogether."""
    judged = quality.clean_lines(docs)
    # a generator and not a filter: a filter would be pushed below and judge every text again
    kept = judged.withColumn("quality", F.explode(F.filter(F.array("quality"), lambda q: q["kept"])))
    return _as_documents(kept.withColumn("text", F.col("quality")["clean_text"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return _as_documents(ngram_join.keep_one(docs, percent=80, shingle=5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes or more, that occur twice go; documents left without a word go too."""
    return _as_documents(suffix_dedup.deduplicated(docs, min_words=PASSAGE_WORDS)).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents are repeated, kept, shortened or left out."""
    return _as_documents(mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its place in a sequence."""
    out = packing.pack_documents(docs, tokenizer_path())
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None  # suffix arrays, the join and the tokeniser are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
