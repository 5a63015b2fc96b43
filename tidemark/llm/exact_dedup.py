"""Exact dedup by a heavy-hitter split, with DataFrame and SQL functions only.

Every text is digested once (SHA-256) into a narrow stored table.  A frequent-items summary
proposes digests that may be hot, exact counts verify them, and their winners are broadcast so
that rows of hot groups are settled map-side; all other digests take one ordinary shuffle of
(id, digest).  Texts themselves never move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import resolve_groups, stored


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty.  Of equal texts the
    row with the largest id stays; null ids lose to any other.  Rows repeated with the same id and
    text get the same verdict.  An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    digests = stored(docs.select(F.col(f"`{id_col}`").alias("doc"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)).alias("digest")), "digests")
    return resolve_groups(digests, "digest", "doc").select(
        F.col("doc").alias(id_col),
        F.col("winner").alias("keep_id"),
        "group_size",
        F.col("doc").eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
