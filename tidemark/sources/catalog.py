"""Roles of the pipeline: their keys, which change, and the catalogs that supply them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType


@dataclass(frozen=True)
class Role:
    """A relation of the pipeline: its primary key, and whether steps insert and delete rows."""

    name: str
    key: str
    dynamic: bool = True


ROLES = {r.name: r for r in (
    Role("application", "application_id"), Role("instance", "instance_id"), Role("customer_invoice", "source_id"), Role("issued_invoice", "source_id"),
    Role("payment_unit", "payment_unit_id"), Role("task", "task_id"), Role("route", "route_id"), Role("message", "message_id"), Role("company", "company_id"), Role("contract", "contract_id"), Role("user", "user_id"),
    Role("node", "node_id", False), Role("region_sales", "sales_row_id", False), Role("customer", "customer_id", False), Role("currency", "from_currency_id", False), Role("invoice_type", "invoice_type_id", False), Role("job", "job_id", False),
)}
DYNAMIC = tuple(r.name for r in ROLES.values() if r.dynamic)

#: A catalog gives a role's rows.
Catalog = Callable[[str], DataFrame]


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df, after checking that key is unique and not null.

    Whole numbers are checked 64 to a word of bits, so that those that stand together need few rows.
    """
    if isinstance(df.schema[key].dataType, (IntegerType, LongType)):
        k = F.col(key).cast("long")
        words = df.groupBy(F.shiftright(k, 6).alias("_word")).agg(F.count(F.lit(1)).alias("_n"), F.bit_or(F.expr(f"shiftleft(1L, CAST(CAST(`{key}` AS LONG) & 63 AS INT))")).alias("_bits"))
        bad = words.where("_word IS NULL OR _n <> bit_count(_bits)")
    else:
        bad = df.groupBy(key).count().where(F.col("count").__gt__(1) | F.col(key).isNull())
    if not bad.isEmpty():
        raise ValueError(f"{key} is not a key")
    return df


def read_slices(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    """CSV slices with a header and a declared schema; empty fields are null."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(paths)


def write_csv(df: DataFrame, path: str) -> None:
    """The export form of a query: CSV with a header."""
    df.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").mode("overwrite").csv(path)


def with_rows(base: Catalog, changed: Mapping[str, DataFrame]) -> Catalog:
    """base with some roles replaced."""
    return lambda name: changed[name] if name in changed else base(name)
