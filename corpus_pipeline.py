"""Training-corpus pipeline: quality rules, line dedup, SimHash near-dedup, PII, best-fit packing.

Each stage takes all that its predecessor kept, as written and read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haltlens.llm import fuzzy_lines, packing, pii, quality_rules, simhash_dedup
from haltlens.llm.common import dropped, merged, table, written
from haltlens.llm.queries import KEY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: None: robust estimates, edit distances and connected components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _with_size(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _row() -> Column:
    """Tells rows apart, whatever their ids: what all decisions about a row depend on, and its id. A hash passes over nulls, so that it takes their places too."""
    names = ("doc_id", "text", "lang", "source")
    return F.xxhash64(*names, *[F.col(c).isNull() for c in names])


def _check() -> Column:
    """A second hash of a row, so that unlike rows of one number are not taken for repeats."""
    return F.md5(F.to_json(F.struct("doc_id", "text", "lang", "source")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep; rows with one id are judged each by itself. No text and empty text have no words, so that they go; an empty table stays empty."""
    rows = docs.select(*COLUMNS).withColumn("row", _row())
    verdict = quality_rules.quality(rows.select(F.col("row").alias("doc_id"), "text", "lang", "source")).filter("kept").select(F.col("doc_id").alias("row")).distinct()
    return rows.join(merged(verdict), "row", "left_semi").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one or nearly so; a document goes if lines went and the text that is left has no letter or digit. No text stays none; repeated rows keep the same lines; an empty table stays empty."""
    return _with_size(fuzzy_lines.without_lines(docs, every=True).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id (none sorts last), of each group of near copies; of repeated rows one. Texts without a word are one group; an empty table stays empty."""
    rows = docs.select(*COLUMNS).withColumn("row", _row())
    groups = simhash_dedup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stay = rows.select("row", "doc_id").join(merged(groups.distinct()), "row").groupBy("component_id").agg(first.alias("first")).select("first.row")
    return rows.join(merged(stay), "row", "left_semi").withColumn("check", _check()).dropDuplicates(["row", "check"]).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; no text stays none, repeated rows stay alike, an empty table stays empty."""
    return _with_size(pii.pseudonymise(docs, KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence, and the place in it, of every piece of every document; no text is one position, repeated rows are packed each, an empty table makes no sequence."""
    return packing.best_fit(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("pii", pseudonyms),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        last = docs
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
            dropped(last)
    return docs
