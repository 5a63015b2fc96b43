"""The counts of the four queries from annotations: how many rows a join would make, without making it.

Every instance is annotated with the number of detail rows that it has: the follow-ups of its
application's branch (tasks, special messages or open invoices) times the sales rows that fit.
Keys of the looked-up roles are unique, so that lookups leave numbers as they are; base tables
are checked for that where rows come in (`operators.maintain.Base`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from .results import look_back
from .views import Rules, approvals, branch_key, eligible, unsigned

STATUS, KEY = "status", "_key"


def follow_up_counts(src: Catalog, approved: DataFrame | None = None, open_: DataFrame | None = None) -> DataFrame:
    """Rows that follow an application in its branch, by status and branch key."""
    tasks = src("task").groupBy(F.col("process_id").cast("string").alias(KEY)).agg(F.count(F.lit(1)).alias("_n"))
    special = src("message").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_n"))
    codes = (approvals(src) if approved is None else approved).select(F.col("application_code").alias(KEY))
    triples = (unsigned(src) if open_ is None else open_).groupBy(F.col("application_code").alias(KEY)).agg(F.count(F.lit(1)).alias("_n"))
    parts = [(30, tasks), (40, codes.crossJoin(F.broadcast(special))), (50, triples)]
    out = None
    for status, rows in parts:
        part = rows.select(F.lit(status).alias(STATUS), KEY, F.col("_n").cast("bigint").alias("_n"))
        out = part if out is None else out.unionByName(part)
    return out


def annotated(src: Catalog, rules: Rules, approved: DataFrame | None = None, open_: DataFrame | None = None) -> DataFrame:
    """Instances in scope of q1 that have detail rows: head, mark (deleted), alive (in its branch) and n (detail rows)."""
    sales = src("region_sales")
    one = sales.where("source_code = 'added'").groupBy("salesperson_id").agg(F.count(F.lit(1)).alias("_c1"))
    two = sales.where("source_code = 'ledger'").groupBy("salesperson_id", F.col("unit_code").alias("company_code")).agg(F.count(F.lit(1)).alias("_c2"))
    heads = eligible(src("application"), rules).select("application_id", STATUS, branch_key().alias(KEY), "company_id", "salesperson_id", F.col("logical_is_deleted").alias("mark"), F.col("cdc_last_update_date").alias("_cdc"))
    heads = heads.join(src("company").select("company_id", "company_code"), "company_id", "left").join(one, "salesperson_id", "left").join(two, ["salesperson_id", "company_code"], "left").where("_c1 IS NOT NULL OR _c2 IS NOT NULL")
    heads = heads.join(follow_up_counts(src, approved, open_), [STATUS, KEY], "left")
    follow = F.coalesce("_n", F.when(F.col(STATUS) == 30, 1).otherwise(0))
    heads = heads.select("application_id", "mark", "_cdc", (follow * F.coalesce("_c1", F.lit(1)) * F.coalesce("_c2", F.lit(1))).alias("n")).where("n > 0")
    rows = src("instance").select("application_id", "contract_id", F.col("logical_is_deleted").alias("_deleted"), F.col("cdc_last_update_date").alias("_i_cdc"))
    rows = rows.join(src("contract").where("business_source <> 'OEM' OR business_source IS NULL").select("contract_id"), "contract_id").join(heads, "application_id")
    rows = look_back(rows.withColumn("cdc_last_update_date", F.greatest("_cdc", "_i_cdc")), src, rules)
    return rows.select(F.col("application_id").alias("head"), "mark", F.expr("greatest(mark, _deleted) IS FALSE").alias("alive"), "n")


def counts(rows: DataFrame) -> DataFrame:
    """One row: q1, q2, q3 and q4, each as its count form has it in one step over annotated rows.

    q2 finds the details that aren't alive, and again the tombstones that it added for them, which
    are those whose own mark wasn't set.  q3 has a row per head and mark, q4 one per head whose
    details are all marked.
    """
    marked = F.coalesce("mark", F.lit(False))
    heads = rows.groupBy("head").agg(
        F.sum("n").alias("q1"),
        F.sum(F.when(~F.col("alive"), F.col("n") * F.when(marked, 1).otherwise(2)).otherwise(0)).alias("q2"),
        F.max((~F.col("alive") & ~marked).cast("int")).alias("_tomb"),
        F.max(marked.cast("int")).alias("_dead"),
    )
    total = heads.agg(F.sum("q1").alias("q1"), F.sum("q2").alias("q2"), F.sum(1 + F.col("_tomb")).alias("q3"), F.sum("_dead").alias("q4"))
    return total.select(*[F.coalesce(q, F.lit(0)).cast("bigint").alias(q) for q in ("q1", "q2", "q3", "q4")])
