"""The nine views, each a function of a catalog; every method of maintenance shares them.

All have bag semantics.  Restricting a catalog's rows restricts a view, which is how affected
keys are derived anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import none, period
from ..sources.catalog import Catalog

# Labels of the three branches and of their documents.
APPROVAL, SENDING, SIGNING = "待审批", "待寄送", "待签返"
BILL, NORMAL, FINISHED = "税票", "正项", "结束"
STATUS = {APPROVAL: 30, SENDING: 40, SIGNING: 50}


@dataclass(frozen=True)
class Rules:
    """Constants of the pipeline's predicates."""

    first_creation: datetime = datetime(2022, 1, 1)
    look_back_minutes: int = 30


def invoices(src: Catalog) -> DataFrame:
    """Both kinds of invoices, tagged; issued ones have no dates of receipt or tax."""
    columns = ["application_code", "approve_date", "status", "invoice_no", "send_date"]
    dates = ["office_receive_date", "customer_receive_date", "tax_invoice_date"]
    own = src("customer_invoice").where("status >= 3").select(*columns, *dates, F.lit("1").alias("type"))
    issued = src("issued_invoice").where("status IN (30, 40)").select(*columns, *[none("timestamp_ntz").alias(d) for d in dates], F.lit("2").alias("type"))
    return own.unionByName(issued)


def tax_dates(src: Catalog) -> DataFrame:
    return invoices(src).where("type = '1'").groupBy("application_code").agg(F.max("tax_invoice_date").alias("tax_invoice_date"))


def approvals(src: Catalog) -> DataFrame:
    return invoices(src).where("status = 30").groupBy("application_code").agg(F.max("approve_date").alias("approve_date"))


def unsigned(src: Catalog) -> DataFrame:
    """Distinct invoices sent that the office or the customer hasn't received."""
    return invoices(src).where("status >= 40 AND (office_receive_date IS NULL OR customer_receive_date IS NULL)").select("invoice_no", "application_code", "send_date").distinct()


def eligible(applications: DataFrame, rules: Rules) -> DataFrame:
    return applications.where((F.col("application_type") == 1) & F.col("status").isin(*STATUS.values()) & (F.col("creation_date") > F.lit(rules.first_creation).cast("timestamp_ntz")))


def with_instances(src: Catalog, applications: DataFrame) -> DataFrame:
    """Instances of applications with their payment units; marks and times of both together."""
    i = src("instance").select("instance_id", "application_id", "contract_id", "payment_unit_id", F.col("cdc_last_update_date").alias("i_cdc"), F.col("logical_is_deleted").alias("i_deleted"))
    return (
        applications.join(i, "application_id")
        .join(src("payment_unit"), "payment_unit_id", "left")
        .withColumn("logical_is_deleted_del", F.greatest("logical_is_deleted", "i_deleted"))
        .withColumn("cdc_last_update_date", F.greatest("cdc_last_update_date", "i_cdc"))
        .drop("i_cdc", "i_deleted")
    )


def core(src: Catalog, rules: Rules, tax: DataFrame | None = None) -> DataFrame:
    """Instances of eligible applications with payment unit and tax date."""
    return with_instances(src, eligible(src("application"), rules).join(tax_dates(src) if tax is None else tax, "application_code", "left"))


def branch_key() -> Column:
    """What an application's follow-ups are found by: its work flow when in approval, else its code."""
    return F.when(F.col("status") == STATUS[APPROVAL], F.col("work_flow_id").cast("string")).otherwise(F.col("application_code"))


def follow_ups(src: Catalog, approved: DataFrame | None = None, open_: DataFrame | None = None) -> DataFrame:
    """What the three branches add to an application, by status and branch key."""
    approved, open_ = approvals(src) if approved is None else approved, unsigned(src) if open_ is None else open_
    tasks = src("task").join(src("route"), "route_id", "left").join(src("node"), "node_id", "left")
    columns = ("status", "_key", "_submit", "_role", "_invoice_no")
    parts = [
        tasks.select(F.lit(STATUS[APPROVAL]), F.col("process_id").cast("string"), none("timestamp_ntz"), "node_name", none("string")),
        approved.join(src("message").select("message"), F.lit(True), "left").select(F.lit(STATUS[SENDING]), "application_code", "approve_date", "message", none("string")),
        open_.select(F.lit(STATUS[SIGNING]), "application_code", "send_date", F.lit(FINISHED), "invoice_no"),
    ]
    a, b, c = (x.toDF(*columns) for x in parts)
    return a.unionByName(b).unionByName(c)


def live_ids(src: Catalog, rules: Rules, approved: DataFrame | None = None, open_: DataFrame | None = None) -> DataFrame:
    """Unmarked ids of the fact with their branch (node_type), once each, however many follow-ups multiply their rows."""
    approved, open_ = approvals(src) if approved is None else approved, unsigned(src) if open_ is None else open_
    heads = eligible(src("application"), rules).select("application_id", "application_code", "status", "logical_is_deleted")
    followed = approved.select(F.lit(STATUS[SENDING]).alias("status"), "application_code").unionByName(open_.select(F.lit(STATUS[SIGNING]).alias("status"), "application_code"))
    heads = heads.where(F.col("status") == STATUS[APPROVAL]).unionByName(heads.where(F.col("status") != STATUS[APPROVAL]).join(followed, ["status", "application_code"], "left_semi").select(*heads.columns))
    rows = src("instance").select("instance_id", "application_id", F.col("logical_is_deleted").alias("_deleted")).join(heads, "application_id")
    return rows.where("greatest(logical_is_deleted, _deleted) IS FALSE").select(branch_label().alias("node_type"), F.col("instance_id").alias("id"))


def branch_label() -> Column:
    return F.when(F.col("status") == STATUS[APPROVAL], APPROVAL).when(F.col("status") == STATUS[SENDING], SENDING).otherwise(SIGNING)


def _fact(rows: DataFrame, node_type: str | Column, submit: Column, role: Column, invoice_no: Column) -> DataFrame:
    when = F.col("applicant_time")
    made = {
        "id": F.col("instance_id"), "head_id": F.col("application_id").cast("string"), "application_code": F.col("application_code"), "period_id": period(when, "yyyyMM"),
        "period_id_dd": period(when, "yyyyMMdd"), "period_id_qty": period(when, "yyyyMMdd"), "business_id": F.col("application_id"), "bill_type": F.lit(BILL), "business_type": F.lit(NORMAL),
        "node_type": F.lit(node_type) if isinstance(node_type, str) else node_type, "invoice_type_id": F.lit(-999), "invoice_id": none("bigint"), "invoice_no": invoice_no, "operator_application_id": F.col("application_id"),
        "milestone_name": none("string"), "submit_date": submit, "current_handler_id": none("bigint"), "currentrole": role, "todo_billing_id": none("bigint"), "payment_unit_id": none("bigint"),
        "source_code": none("string"), "details_flag": none("string"), "billing_status": none("string"),
    }
    return rows.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in FACT], "logical_is_deleted_del")


# The columns of the fact view, in order.
FACT = (
    "id head_id application_code period_id period_id_dd period_id_qty business_id bill_type business_type node_type invoice_type_id salesperson_id company_id customer_id contract_id "
    "invoice_id invoice_no operator_application_id milestone_name currency_id total_amount creation_date submit_date applicant_time current_handler_id currentrole todo_billing_id "
    "payment_unit_id source_code details_flag billing_status logical_is_deleted cdc_last_update_date tax_invoice_date payment_unit_number"
).split()


def approval(src: Catalog, rows: DataFrame) -> DataFrame:
    """One row per task of the work flow, or one without."""
    tasks = src("task").join(src("route"), "route_id", "left").join(src("node"), "node_id", "left").select(F.col("process_id").alias("work_flow_id"), "node_name")
    found = rows.where("status = 30").join(tasks, "work_flow_id", "left")
    return _fact(found, APPROVAL, F.col("applicant_time"), F.col("node_name"), none("string"))


def sending(src: Catalog, rows: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """Applications with an approval date; every special message multiplies them, and none leaves them one."""
    approved = approvals(src) if approved is None else approved
    found = rows.where("status = 40").join(approved, "application_code").join(src("message").select("message"), F.lit(True), "left")
    return _fact(found, SENDING, F.col("approve_date"), F.col("message"), none("string"))


def signing(src: Catalog, rows: DataFrame, open_: DataFrame | None = None) -> DataFrame:
    found = rows.where("status = 50").join(unsigned(src) if open_ is None else open_, "application_code")
    return _fact(found, SIGNING, F.col("send_date"), F.lit(FINISHED), F.col("invoice_no"))


def branches(src: Catalog, rules: Rules, rows: DataFrame | None = None, approved: DataFrame | None = None, open_: DataFrame | None = None) -> dict[str, DataFrame]:
    rows = core(src, rules) if rows is None else rows
    return {APPROVAL: approval(src, rows), SENDING: sending(src, rows, approved), SIGNING: signing(src, rows, open_)}


def fact_of(parts: dict[str, DataFrame]) -> DataFrame:
    a, b, c = parts.values()
    return a.unionByName(b).unionByName(c)


def fact(src: Catalog, rules: Rules, tax: DataFrame | None = None, approved: DataFrame | None = None, open_: DataFrame | None = None) -> DataFrame:
    """The union of the three branches, with the mark that q2 reads.

    An application is in one branch, so one join by status and branch key stands for three, before
    instances multiply the rows; only approval keeps applications without a follow-up.
    """
    tax = tax_dates(src) if tax is None else tax
    found = follow_ups(src, approved, open_).withColumn("_found", F.lit(True))
    heads = eligible(src("application"), rules).withColumn("_key", branch_key()).join(tax, "application_code", "left").join(found, ["status", "_key"], "left")
    heads = heads.where((F.col("status") == STATUS[APPROVAL]) | F.col("_found"))
    rows = with_instances(src, heads)
    return _fact(rows, branch_label(), F.when(F.col("status") == STATUS[APPROVAL], F.col("applicant_time")).otherwise(F.col("_submit")), F.col("_role"), F.col("_invoice_no"))
