"""Queries of the operators over the given tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (decontaminate, fill_middle, fingerprint, html_extract, langid, mixing, near_dedup, pii, sharding,
                         spelling, substring_dedup, toxicity, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_remainder(divisor: int) -> F.Column:
    """crc32 of the decimal doc_id, modulo ``divisor``; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair where the item occurs in the
    document with few edits."""
    return decontaminate.benchmark_leaks(
        spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hilbert-curve shards 0 to 7 of all documents, near equal in bytes."""
    return sharding.shard_documents(spark, _table(spark, sf_dir, "documents"))


def toxic_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicModel | None:
    """The model learned from the labels whose id remainder (mod 3) is not 1."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learn = labels.select("doc_id", "toxic").where(_id_remainder(3) != 1)
    return toxicity.train_model(spark, docs.select("doc_id", "text"), labels=learn)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out ids are unseen."""
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), toxic_model(spark, sf_dir))
    held = F.coalesce(_id_remainder(3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    records = warc.archive_round_trip(spark, _table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_main_text(spark, _table(spark, sf_dir, "pages"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    return near_dedup.near_duplicates(
        spark, _table(spark, sf_dir, "documents"), near_dedup.NearDupConfig(shingle=2))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from ids whose remainder (mod 5)
    is not 0."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train_model(docs.where(_id_remainder(5) != 0))
    held = F.coalesce(_id_remainder(5) == 0, F.lit(False)).alias("held_out")
    return langid.predict_language(spark, docs, model).select("doc_id", held, "lang_pred", "score")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document taken by the mix of all sources."""
    return mixing.mix_sources(spark, _table(spark, sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its successor."""
    return fingerprint.fingerprint_edits(spark, _table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base matches and bootstrapped finds."""
    found = pii.find_personal_data(spark, _table(spark, sf_dir, "documents"))
    base = {k: k for k in pii.KINDS}
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_list(base), 256).alias("base_sha256"),
        pii.span_list(base | {"id": "id"}).alias("spans"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text rebuilt
    from that."""
    made = fill_middle.fill_in_middle(spark, _table(spark, sf_dir, "documents"))
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return spelling.spelling_variants(spark, _table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 words that occur earlier."""
    kept = substring_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_shard": op2_shard,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_main_text": op5_main_text,
    "op6_near_dedup": op6_near_dedup,
    "op7_language": op7_language,
    "op8_mix": op8_mix,
    "op9_fingerprint": op9_fingerprint,
    "op10_personal_data": op10_personal_data,
    "op11_fill_middle": op11_fill_middle,
    "op12_spelling": op12_spelling,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op8_mix": mixing.oracle_sql(),
    "op11_fill_middle": fill_middle.oracle_sql(),
    "op12_spelling": spelling.oracle_sql(),
    "op13_substring_dedup": substring_dedup.oracle_sql(),
}
