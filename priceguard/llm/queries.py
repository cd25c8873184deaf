"""The registered queries of the corpus operators and their DuckDB equivalents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, classifier, fingerprints, katz, licenses, merkle, mixing, ngram_join, packing, quality, runs, suffix_dedup, warc
from .oracle import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "scan.digest", "scan.license", F.array_join("scan.notices", ",").alias("notices"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select("doc_id", *[f"quality.{n}" for n in names])


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    out = warc.read_archives(spark, manifest)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    return classifier.score_quality(docs, model)


def op6_count_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"), percent=85, shingle=4)


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan_mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        "doc_id", "mix.size", "mix.source_size", F.round("mix.target", 6).alias("target"), "mix.taken"
    )


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op9_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, min_words=suffix_dedup.PASSAGE_WORDS, cut_words=False)  # passages are counted only
    return out.select(
        "doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"), "repeats.n_passage_words"
    )


def op10_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op11_multiprobe_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_merkle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.documents_manifest(table(spark, sf_dir, "documents")))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), tails=True, digests=True)
    return out.select("doc_id", "runs.*")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_quality": op3_line_quality,
    "op4_warc_dictionary": op4_warc_dictionary,
    "op5_rule_ensemble": op5_rule_ensemble,
    "op6_count_rtree_join": op6_count_rtree_join,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_katz_backoff": op8_katz_backoff,
    "op9_suffix_family": op9_suffix_family,
    "op10_closed_syncmers": op10_closed_syncmers,
    "op11_multiprobe_hashing": op11_multiprobe_hashing,
    "op12_merkle_versions": op12_merkle_versions,
    "op13_lyndon_runs": op13_lyndon_runs,
}
