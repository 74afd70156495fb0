"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, change_points, collocations, fuzzy_lines, license_scan, main_text, packing, pii, quality_rules, simhash_dedup, suffix_dedup, token_rans, weighted_minhash
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The example key of the registered queries; a real run passes its own secret.
KEY = b"haltlens registered query key 01"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level sequences: a document's length is its UTF-8 bytes and an end position."""
    return packing.best_fit(table(spark, sf_dir, "documents"), F.coalesce(F.octet_length("text"), F.lit(0)) + 1)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, KEY).withColumn("n_replaced", pii.total())


def op3_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rans.round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.without_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), every=True)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_points.change_points(table(spark, sf_dir, "sale_lines"), "vendor_id", "shipped_at", "quantity", where=F.col("flag") == "kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_pii, op3_token_rans, op4_suffix_dedup, op5_quality_rules, op6_license_scan, op7_weighted_minhash, op8_byte_bpe, op9_fuzzy_lines, op10_simhash_dedup, op11_change_points, op12_collocations, op13_main_text)}
SQL: dict[str, str] = {"op11_change_points": change_points.SQL, "op12_collocations": collocations.SQL}
