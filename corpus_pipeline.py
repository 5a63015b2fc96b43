"""Corpus pipeline: language ID, line dedup, near duplicates, secrets, packing.

Each stage takes what its predecessor kept and, but for the last, returns the columns of
documents.  run() writes each stage's result as Parquet in the shared folder and rereads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, stored
from tidemark.llm.language_id import keep_known
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.ngram_join import ngram_join
from tidemark.llm.packing import pack, tokenizer_path
from tidemark.llm.secret_scan import secret_scan

#: What stands in a text for a secret.
MARK = "[secret]"
#: Dropped ids that are broadcast at most; more are joined by a shuffle.
DROPPED = 400_000


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go: null, empty and letterless texts, and doubtful ones.

    Repeated rows stay or go together; other columns pass through; an empty table stays empty.
    """
    return keep_known(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of lines seen before go, and documents that nothing is left of.

    Texts that were null or empty before stay; of equal passages the one of the least (id, text
    hash, place) stays, and rows repeated with the same id and text are treated alike.  Columns
    named like the operator's counts keep their values.
    """
    removed = fresh(docs.columns, "n_removed")
    return _counted(line_dedup(docs, passages=True).where(f"NOT (`{removed}` > 0 AND length(trim(text)) = 0)"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays (all rows of that id).

    Null and empty texts and null ids stay; other columns pass through, whatever their names.
    """
    mark = fresh(docs.columns, "_gone")
    gone = stored(ngram_join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(mark)).distinct(), "near-copies")
    return docs.join(F.broadcast(gone) if gone.count() <= DROPPED else gone, docs["doc_id"] == gone[mark], "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every stretch that spans of secrets cover is replaced by MARK; null and empty texts stay as they are."""
    return _counted(secret_scan(docs, redact=MARK), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document, repeated rows and empty texts included; no row without documents."""
    return pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Trained and tokenizer-based stages aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
