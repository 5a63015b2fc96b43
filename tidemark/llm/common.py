"""Shared-folder tables, Arrow batch limits and skew-safe group resolution."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in HEAVY_TRACKED of the rows.
HEAVY_TRACKED = 8192
#: Parts of the input with a frequent-items summary each, keys that one reports, and counters it keeps.
PARTS, REPORTED, COUNTERS = 64, 2 * HEAVY_TRACKED, 16 * HEAVY_TRACKED
#: Rows in one Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the memory of Python workers: fewer rows in one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work over Arrow batches that gives back what the worker freed, as Spark keeps idle workers."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def fresh(taken: list[str], name: str) -> str:
    """A column name that none of taken clashes with, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def resolve_groups(rows: DataFrame, key: str, order: str, largest: bool = True) -> DataFrame:
    """Add winner (largest or smallest `order` of the key's rows) and group_size to rows, by SQL functions only.

    Frequent-items summaries (the Misra-Gries family: bounded counters, mergeable) of PARTS parts of
    the rows propose keys: one that holds a share of all rows holds it in some part, and the
    counters suffice for that share.  Exact counts verify them, and only keys holding more than
    one row in HEAVY_TRACKED stay, so at most HEAVY_TRACKED winners are broadcast and joined
    map-side (and PARTS * REPORTED proposals).  All other keys, none of which holds a larger
    share, go through one shuffle.  `rows` should be a stored table, as it is read three times.
    """
    spark = rows.sparkSession
    best = F.max if largest else F.min
    total = rows.count()
    marked = rows.withColumn("_fp", F.xxhash64(key))
    summaries = marked.groupBy(F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("_part")).agg(F.expr(f"approx_top_k(_fp, {REPORTED}, {COUNTERS})").alias("top"), F.count(F.lit(1)).alias("_n"))
    proposed = summaries.select("_n", F.explode("top").alias("t")).where(F.col("t.count") > F.col("_n") / (2 * HEAVY_TRACKED)).where("t.count > 1").select(F.col("t.item").alias("_fp")).distinct()
    heavy = stored(
        marked.join(F.broadcast(proposed), "_fp")
        .groupBy(key)
        .agg(best(order).alias("winner"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > max(1, total // HEAVY_TRACKED)),
        "heavy",
    )
    columns = [*rows.columns, "winner", "group_size"]
    hot = rows.join(F.broadcast(heavy), key).select(*columns)
    same = Window.partitionBy(key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").withColumns({"winner": best(order).over(same), "group_size": F.count(F.lit(1)).over(same)})
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return hot.unionByName(cold.select(*columns))
