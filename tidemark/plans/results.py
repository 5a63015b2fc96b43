"""The four queries over the fact view and the accumulated results, and their forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bare_head, exact_product, joined_values, none, weighted_values
from ..sources.catalog import Catalog
from .views import FACT, Rules

# Columns that two sales rows may give, those that every row has null, and volatile ones.
SALES = ("salesperson_code", "salesperson_name", "cfs_region_id")
REASONS = {
    "reason_code": "string", "sub_reason_code": "string", "remarks": "string", "responsible_person": "string", "estimated_resolution_time": "timestamp_ntz", "cfs_status": "string", "sla": "bigint",
    "reason_cn_name": "string", "reason_en_name": "string", "sub_reason_cn_name": "string", "sub_reason_en_name": "string", "responsible_person_id": "bigint", "responsible_person_code": "string",
}
VOLATILE = ("rtd_last_update_date", "src_cdc_event_date", "src_cdc_last_update_date", "_hoodie_event_time")
LISTED = ("contract_number", "business_source", "billing_status")
SUMMED = ("usd_total_amount", "rmb_total_amount", "total_amount", "con_mi_qty")
NOT_SUMMARISED = ("id", "head_id", "business_id", "invoice_type_id", "salesperson_id", "company_id", "company_name", "customer_id", "contract_id", "application_code", "currency_id", "current_handler_id", "payment_unit_id", "logical_is_deleted", "payment_unit_number")


def look_back(rows: DataFrame, src: Catalog, rules: Rules) -> DataFrame:
    """Rows changed since the job's last start, less the look-back; of several starts the last one counts, and none rejects all."""
    start = src("job").agg(F.max("last_start").alias("_last")).select((F.col("_last") - F.expr(f"INTERVAL {rules.look_back_minutes} MINUTES")).alias("_start"))  # one row
    return rows.join(F.broadcast(start), F.col("cdc_last_update_date") >= F.col("_start")).drop("_start")


def detail(fact: DataFrame, src: Catalog, rules: Rules) -> DataFrame:
    """q1: live detail rows."""
    sales = src("region_sales").select("salesperson_id", "source_code", "unit_code", "salesperson_code", "salesperson_name", "cfs_region_id")
    one = sales.where("source_code = 'added'").select(F.col("salesperson_id").alias("_s1"), *[F.col(c).alias(f"_1{c}") for c in SALES])
    two = sales.where("source_code = 'ledger'").select(F.col("salesperson_id").alias("_s2"), F.col("unit_code").alias("_unit"), *[F.col(c).alias(f"_2{c}") for c in SALES])
    now = F.current_timestamp()
    rows = (
        look_back(fact.select(*FACT), src, rules)
        .join(src("contract").where("business_source <> 'OEM' OR business_source IS NULL"), "contract_id")
        .join(src("company"), "company_id", "left")
        .join(one, F.col("salesperson_id") == F.col("_s1"), "left")
        .join(two, (F.col("salesperson_id") == F.col("_s2")) & (F.col("company_code") == F.col("_unit")), "left")
        .where("_s1 IS NOT NULL OR _s2 IS NOT NULL")
        .join(src("customer"), "customer_id", "left")
        .join(src("currency"), F.col("currency_id").cast("string") == F.col("from_currency_id"), "left")
        .join(src("invoice_type"), "invoice_type_id", "left")
        .join(src("user").select(F.col("user_id").alias("current_handler_id"), F.col("last_name").alias("current_handler_code")), "current_handler_id", "left")
    )
    return rows.select(
        F.col("id").cast("string").alias("id"),
        *[c for c in FACT if c not in ("id", "salesperson_id", "total_amount", "cdc_last_update_date")],
        F.col("salesperson_id").cast("string").alias("salesperson_id"), "invoice_category", "invoice_type_name", "company_code", "company_name",
        *[F.coalesce(f"_1{c}", f"_2{c}").alias(c if c.startswith("cfs") else f"cfs_{c}") for c in SALES],
        "customer_code", "customer_name", "customer_group_name", "contract_number", "business_source", F.col("from_currency_code").alias("currency_code"),
        exact_product(F.col("usd_rate"), F.col("total_amount")).alias("usd_total_amount"), exact_product(F.col("rmb_rate"), F.col("total_amount")).alias("rmb_total_amount"),
        F.col("total_amount").cast("decimal(38,10)").alias("total_amount"), F.lit(1).cast("bigint").alias("con_mi_qty"), "current_handler_code", F.col("current_handler_code").alias("current_handler_name"),
        now.alias("rtd_last_update_date"), now.alias("src_cdc_event_date"), now.alias("src_cdc_last_update_date"), F.unix_millis(now).cast("string").alias("_hoodie_event_time"),
        *[none(t).alias(c) for c, t in REASONS.items()],
    )


def detail_gone(accumulated: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """q2: accumulated detail whose id is no longer live in its own branch, as tombstones."""
    alive = None
    for node_type, rows in parts.items():
        ids = rows.where("logical_is_deleted_del IS FALSE").select(F.lit(node_type).alias("node_type"), "id")
        alive = ids if alive is None else alive.unionByName(ids)
    return detail_not_in(accumulated, alive, tuple(parts))


def detail_not_in(accumulated: DataFrame, alive: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """q2 from the live ids and their branches."""
    alive = alive.select("node_type", F.col("id").cast("string").alias("id"))
    gone = accumulated.where(F.col("node_type").isin(*branches)).join(alive, ["node_type", "id"], "left_anti")
    fresh = {"logical_is_deleted": F.lit(True), "rtd_last_update_date": F.current_timestamp(), "_hoodie_event_time": F.unix_millis(F.current_timestamp()).cast("string")}
    return gone.select(*accumulated.columns).withColumns(fresh | {c: none(t) for c, t in REASONS.items()}).select(*accumulated.columns)


def summary(accumulated: DataFrame, fact: DataFrame, src: Catalog, rules: Rules) -> DataFrame:
    """q3: details in scope by head and deletion mark; an id weighs as often as the fact has it in scope."""
    scope = look_back(fact, src, rules).groupBy(F.col("id").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("_weight"))
    rows = accumulated.join(scope, "id")
    most = [c for c in accumulated.columns if c not in (*NOT_SUMMARISED, *LISTED, *SUMMED)]
    lists = [weighted_values(c, "_weight").alias(c) for c in LISTED]
    grouped = rows.groupBy("head_id", "logical_is_deleted").agg(
        *[F.max(c).alias(c) for c in most],
        *[F.sum(F.col(c) * F.col("_weight")).cast("decimal(38,10)" if c != "con_mi_qty" else "bigint").alias(c) for c in SUMMED],
        *lists,
        joined_values(F.col("payment_unit_number"), distinct=True).alias("payment_unit_number"),
    )
    return grouped.withColumn("head_id", F.concat("head_id", F.col("logical_is_deleted").cast("string"))).withColumn("over_due_days", none("bigint"))


def summary_gone(summaries: DataFrame, accumulated: DataFrame) -> DataFrame:
    """q4: summaries of heads without a live detail, as tombstones."""
    dead = accumulated.groupBy("head_id").agg(F.sum(F.when(F.expr("logical_is_deleted IS TRUE"), 0).otherwise(1)).alias("_live")).where("_live = 0").select(F.col("head_id").alias("_head"))
    return summaries.join(dead, bare_head(F.col("head_id")) == F.col("_head")).drop("_head").withColumn("logical_is_deleted", F.lit(True)).select(*summaries.columns)


def accumulate(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows that join the target: those whose (key, mark) it didn't hold before; repeats among them all stay."""
    return rows.join(target.select(key, "logical_is_deleted"), [key, "logical_is_deleted"], "left_anti").select(*rows.columns)


def not_held(target: DataFrame, fact: DataFrame) -> DataFrame:
    """Rows of the fact whose details accumulate() would add to the target: ids of details are those of the fact."""
    return fact.join(target.select(F.col("id").cast(fact.schema["id"].dataType).alias("id"), "logical_is_deleted"), ["id", "logical_is_deleted"], "left_anti").select(*fact.columns)


def steady(df: DataFrame) -> DataFrame:
    """df without its volatile columns."""
    return df.drop(*VOLATILE)


def count_form(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def minmax_form(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
