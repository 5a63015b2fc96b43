"""Signed-delta algebra: every change of a state is a function of the old state and the delta.

Deletes come before inserts, so a step may replace a row of the same key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_delta(state: DataFrame, inserted: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """state without the rows of deleted's keys, and with inserted."""
    return state.join(deleted.select(key).distinct(), key, "left_anti").unionByName(inserted)


def signed(state: DataFrame, inserted: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """The delta with w = -1 for rows that leave, as the state holds them, and +1 for rows that come."""
    gone = state.join(deleted.select(key).distinct(), key, "left_semi").withColumn("w", F.lit(-1))
    return gone.unionByName(inserted.withColumn("w", F.lit(1)))


def fold_max(state: DataFrame, source: DataFrame | Callable[[], DataFrame] | None, delta: DataFrame, key: str, value: str) -> DataFrame:
    """The maxima (key, cnt, cnt_nonnull, max) after a signed delta of the source.

    source is the state of the rows after the delta, or gives it; only keys whose maximum may have
    left are taken from it anew, and it may be None where the delta has no deletes.  A key whose
    values are all null stays, with a null maximum.
    """
    v, w = F.col(value), F.col("w")
    change = delta.select(key, w.cast("bigint").alias("cnt"), F.when(v.isNotNull(), w).otherwise(0).cast("bigint").alias("cnt_nonnull"), F.when(w > 0, v).alias("max"), F.when(w < 0, v).alias("left"))
    both = state.select(key, "cnt", "cnt_nonnull", "max").withColumn("left", F.lit(None).cast(change.schema["left"].dataType)).unionByName(change)
    folded = both.groupBy(key).agg(F.sum("cnt").alias("cnt"), F.sum("cnt_nonnull").alias("cnt_nonnull"), F.max("max").alias("max"), F.max("left").alias("left")).where("cnt > 0")
    if source is None:
        return folded.drop("left")
    source = source if isinstance(source, DataFrame) else source()
    suspect = folded.where("left IS NOT NULL AND (max IS NULL OR left >= max)").select(F.col(key).alias("_key"))
    anew = source.join(suspect, F.col(key).eqNullSafe(F.col("_key")), "left_semi").groupBy(F.col(key).alias("_key")).agg(F.max(value).alias("anew"), F.lit(True).alias("suspect"))
    return folded.join(anew, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "cnt", "cnt_nonnull", F.when(F.col("cnt_nonnull") == 0, F.lit(None)).when(F.col("suspect"), F.col("anew")).otherwise(F.col("max")).alias("max"))


def max_state(source: DataFrame, key: str, value: str) -> DataFrame:
    return source.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"), F.count(value).alias("cnt_nonnull"), F.max(value).alias("max"))


def fold_count(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Derivation counts (keys, cnt) after a signed delta; null keys are equal, counts of zero go."""
    both = state.select(*keys, "cnt").unionByName(delta.select(*keys, F.col("w").cast("bigint").alias("cnt")))
    return both.groupBy(*keys).agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def transitions(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Keys among touched that were born (alive true) or died (false) between two states."""
    keys = touched.select(key).distinct()
    before = old.join(keys, key, "left_semi").select(key).distinct().withColumn("before", F.lit(True))
    after = new.join(keys, key, "left_semi").select(key).distinct().withColumn("after", F.lit(True))
    both = before.join(after, key, "full_outer")
    return both.where("before IS NULL OR after IS NULL").select(key, F.col("after").isNotNull().alias("alive"))


def patch_flag(state: DataFrame, flips: DataFrame, key: str, flag: str) -> DataFrame:
    """state with flag set for keys born and cleared for keys that died."""
    return state.join(flips.select(key, F.col("alive").alias("_alive")), key, "left").withColumn(flag, F.coalesce("_alive", flag)).drop("_alive").select(*state.columns)


def has_key(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with a flag: whether keys holds their key (EXISTS in the select list)."""
    return rows.join(keys.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def rederive(state: DataFrame, ids: DataFrame, key: str, derived: DataFrame) -> DataFrame:
    """state with the rows of ids taken out and derived rows put in."""
    return state.join(ids.select(key).distinct(), key, "left_anti").unionByName(derived.select(*state.columns))


def delta_join(a_old: DataFrame, d_a: DataFrame, b_new: DataFrame, d_b: DataFrame, key: str, a_key: str) -> DataFrame:
    """Rows that inserts add to a join: new a with all b, and old a with new b; no pair twice."""
    return d_a.join(b_new, key).unionByName(a_old.join(d_a.select(a_key), a_key, "left_anti").join(d_b, key))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one has more often than the other, both ways."""
    both = a.withColumn("_w", F.lit(1)).union(b.withColumn("_w", F.lit(-1))).groupBy(*a.columns).agg(F.sum("_w").alias("_w")).where("_w <> 0")
    return both.select(*a.columns, F.explode(F.array_repeat(F.when(F.col("_w") > 0, "left").otherwise("right"), F.abs("_w").cast("int"))).alias("side"))


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """The join condition under which null keys are equal."""
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[k])
    return out
