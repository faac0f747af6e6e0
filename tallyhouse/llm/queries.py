"""The queries of this subpackage, each over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, codes, copies, licenses, mixing, oracles, ppm, preferences, quality, simhash, toxicity, warc, weighted
from ._shared import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(), digest=True)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link_documents(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each license of each document; a document without any has one row with nulls."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode_outer("licenses").alias("l"))
    return found.select("doc_id", F.col("l.license").alias("license"), F.col("l.found").alias("found_shingles"), F.col("l.total").alias("total_shingles"))


def toxicity_fold(doc_id: str = "doc_id") -> F.Column:
    """Which fourth of the documents an id falls in; labels of fourth 2 are held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(toxicity_fold() != 2).select("doc_id", "toxic")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (toxicity_fold() == 2).alias("held_out"), "score", (F.col("score") >= toxicity.CUTOFF).cast("int").alias("predicted"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its last answer taken from the next conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = preferences.format_pairs(preferences.swap_last_answer(turns))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))
    return rows.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans").alias("chosen_spans"), text("rejected_spans").alias("rejected_spans"), "identical")


def op10_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_mix": op2_mix,
        "op3_bpe": op3_bpe,
        "op4_quality": op4_quality,
        "op5_simhash": op5_simhash,
        "op6_ppm": op6_ppm,
        "op7_licenses": op7_licenses,
        "op8_toxicity": op8_toxicity,
        "op9_preferences": op9_preferences,
        "op10_weighted": op10_weighted,
        "op11_codes": op11_codes,
        "op12_copies": op12_copies,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    """The others hash, code or compress in ways that SQL has no functions for; their tests are brute force."""
    return {
        "op1_warc": oracles.warc(),
        "op2_mix": oracles.mixing(),
        "op4_quality": oracles.quality(),
        "op7_licenses": oracles.licenses(),
        "op9_preferences": oracles.preferences(),
        "op11_codes": oracles.codes(),
        "op12_copies": oracles.copies(),
        "op13_centroids": oracles.centroids(),
    }
