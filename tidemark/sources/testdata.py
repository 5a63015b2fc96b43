"""The driver's tables as roles of the pipeline, so that every predicate of it bites."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import none
from .catalog import Catalog

# Event types and order states as pipeline statuses, and the job's last start.
EVENT_STATUS = {"signup": 2, "error": 10, "view": 30, "click": 40, "purchase": 50}
ORDER_STATUS = {"F": 30, "O": 40, "P": 50}
LAST_START = datetime(1997, 6, 1)
FIRST_CREATION = datetime(1996, 1, 1)


def _case(column: str, values: dict[str, int]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


#: Schemas by path, each inferred once by a Spark job: files at a path don't change theirs.
_schemas: dict[str, StructType] = {}


#: Roles of a session, which are plans and hold no rows.
_roles: dict[tuple[str, str, str], DataFrame] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    def table(name: str) -> DataFrame:
        """A fresh scan."""
        path = f"{sf_dir}/{name}.parquet"
        if path not in _schemas:
            _schemas[path] = spark.read.parquet(path).schema
        return spark.read.schema(_schemas[path]).parquet(path)

    def application() -> DataFrame:
        o = table("orders")
        return o.select(
            F.col("o_orderkey").alias("application_id"), F.col("o_custkey").cast("string").alias("application_code"), (F.col("o_custkey") % 25).alias("salesperson_id"),
            F.floor(F.col("o_custkey") / 25).__mod__(25).cast("long").alias("company_id"), F.col("o_custkey").alias("customer_id"), (F.col("o_custkey") % 7).alias("currency_id"),
            F.col("o_totalprice").cast("decimal(22,3)").alias("total_amount"), F.col("o_orderdate").alias("creation_date"), F.col("o_orderdate").alias("applicant_time"),
            (F.col("o_orderkey") % 17 == 0).alias("logical_is_deleted"), F.col("o_orderdate").alias("cdc_last_update_date"), F.col("o_custkey").alias("work_flow_id"),
            F.when(F.col("o_orderpriority").startswith("5"), 2).otherwise(1).alias("application_type"), _case("o_orderstatus", ORDER_STATUS).alias("status"),
        )

    def instance() -> DataFrame:
        # dealt by order alone, so that joins on it find their rows in place
        rows = table("lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("contract_id"), F.max("l_partkey").alias("part"), F.max("l_shipdate").alias("cdc_last_update_date"))
        rows = rows.withColumn("instance_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
        return rows.select("instance_id", F.col("l_orderkey").alias("application_id"), "contract_id", F.when(F.col("l_linenumber") != 1, F.col("part")).alias("payment_unit_id"), "cdc_last_update_date", (F.col("instance_id") % 13 == 0).alias("logical_is_deleted"))

    def invoices(odd: int) -> DataFrame:
        e = table("events").where(F.col("event_id") % 2 == odd)
        seen = [F.when(F.col("value") > v, F.col("ts")) if not odd else none("timestamp_ntz") for v in (50, 20, 10)]
        return e.select(
            F.col("event_id").alias("source_id"), F.col("user_id").cast("string").alias("application_code"), F.when(F.col("value") >= 1, F.col("ts")).alias("approve_date"),
            _case("event_type", EVENT_STATUS).alias("status"), F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 5).cast("string")).alias("invoice_no"),
            F.date_trunc("day", "ts").cast("timestamp_ntz").alias("send_date"), *[c.alias(n) for c, n in zip(seen, ("office_receive_date", "customer_receive_date", "tax_invoice_date"), strict=True)],
        )

    def sales() -> DataFrame:
        n = table("nation")
        shared = [
            F.col("n_nationkey").cast("long").alias("salesperson_id"), (F.col("n_nationkey") % 5).cast("string").alias("unit_code"), F.col("n_name").alias("salesperson_name"),
            F.col("n_regionkey").cast("long").alias("cfs_region_id"),
        ]
        return n.where("n_regionkey IN (0, 1)").select(F.col("n_nationkey").cast("long").alias("sales_row_id"), F.lit("added").alias("source_code"), *shared, F.concat(F.lit("A"), F.col("n_nationkey")).alias("salesperson_code")).unionByName(
            n.where("n_regionkey IN (1, 2)").select((F.col("n_nationkey") + 100).cast("long").alias("sales_row_id"), F.lit("ledger").alias("source_code"), *shared, F.concat(F.lit("L"), F.col("n_nationkey")).alias("salesperson_code"))
        )

    makers = {
        "application": application, "instance": instance, "customer_invoice": lambda: invoices(0), "issued_invoice": lambda: invoices(1), "region_sales": sales,
        "payment_unit": lambda: table("part").select(F.col("p_partkey").alias("payment_unit_id"), F.col("p_name").alias("payment_unit_number")),
        "task": lambda: table("events").where("event_type = 'signup'").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("process_id"), (F.col("event_id") % 30).alias("route_id")),
        "route": lambda: table("nation").select(F.col("n_nationkey").cast("long").alias("route_id"), F.col("n_regionkey").cast("long").alias("node_id")),
        "node": lambda: table("region").select(F.col("r_regionkey").cast("long").alias("node_id"), F.col("r_name").alias("node_name")),
        "message": lambda: table("region").where("r_name = 'ASIA'").select(F.col("r_regionkey").cast("long").alias("message_id"), F.col("r_name").alias("message")),
        "company": lambda: table("nation").select(F.col("n_nationkey").cast("long").alias("company_id"), (F.col("n_nationkey") % 5).cast("string").alias("company_code"), F.col("n_name").alias("company_name")),
        "customer": lambda: table("customer").select(F.col("c_custkey").alias("customer_id"), F.concat(F.lit("C"), F.col("c_custkey")).alias("customer_code"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("customer_group_name")),
        "contract": lambda: table("supplier").select(F.col("s_suppkey").alias("contract_id"), F.col("s_name").alias("contract_number"), F.when(F.col("s_suppkey") % 10 == 0, "OEM").when(F.col("s_suppkey") % 10 != 1, "DIRECT").alias("business_source")),
        "currency": lambda: table("region").select(F.col("r_regionkey").cast("string").alias("from_currency_id"), F.col("r_name").alias("from_currency_code"), ((F.col("r_regionkey") + 1) * 0.25).cast("decimal(38,18)").alias("usd_rate"), ((F.col("r_regionkey") + 1) * 1.75).cast("decimal(38,18)").alias("rmb_rate")),
        "invoice_type": lambda: spark.range(1).select(F.lit(-999).alias("invoice_type_id"), none("string").alias("invoice_category"), F.lit("unknown").alias("invoice_type_name")),
        "user": lambda: table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("last_name")),
        "job": lambda: spark.range(1).select(F.col("id").alias("job_id"), F.lit(LAST_START).cast("timestamp_ntz").alias("last_start")),
    }

    def role(name: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _roles:
            _roles[key] = makers[name]()
        return _roles[key]

    # one row by order and number, so that instance ids can't repeat where numbers have one digit, as the files' statistics tell
    role.sure = {"instance": lambda: table("lineitem").where("l_orderkey IS NULL OR l_linenumber IS NULL OR l_linenumber < 0 OR l_linenumber > 9").isEmpty()}
    return role
