"""The same rows in SQL over the driver's tables: a chain of common table expressions."""

from __future__ import annotations

import re

from .results import REASONS
from .views import APPROVAL, BILL, FACT, FINISHED, NORMAL, SENDING, SIGNING

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "timestamp_ntz": "TIMESTAMP"}


def live_rows(condition: str | None, key: str) -> str:
    """A filter of a dynamic role's rows by slice and set."""
    if condition is None:
        return "TRUE"
    slice_, extra = f"({key} % 100 + 1)", f"(({key} // 100) % 100 < 50)"
    return "(" + condition.replace("slice", slice_).replace("extra", extra) + ")"


def base(condition: str | None = None) -> str:
    """WITH and the roles, restricted to live rows."""

    def live(key: str) -> str:
        return live_rows(condition, key)

    inv = "event_id, CAST(user_id AS VARCHAR) AS code, CASE WHEN value >= 1 THEN ts END AS approved, CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 10 WHEN 'view' THEN 30 WHEN 'click' THEN 40 WHEN 'purchase' THEN 50 END AS st, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 5 AS VARCHAR) END AS ino, date_trunc('day', ts)::TIMESTAMP AS sent"
    return f"""WITH app AS (
 SELECT o_orderkey AS aid, CAST(o_custkey AS VARCHAR) AS code, o_custkey % 25 AS sid, (o_custkey // 25) % 25 AS cid, o_custkey AS cust, o_custkey % 7 AS cur,
  CAST(o_totalprice AS DECIMAL(22,3)) AS amount, o_orderdate AS created, o_orderkey % 17 = 0 AS gone, o_custkey AS wf,
  CASE WHEN o_orderpriority LIKE '5%' THEN 2 ELSE 1 END AS kind, CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 40 WHEN 'P' THEN 50 END AS st
 FROM orders WHERE {live("o_orderkey")}),
inst AS (SELECT * FROM (
 SELECT l_orderkey * 10 + l_linenumber AS iid, l_orderkey AS aid, max(l_suppkey) AS con, CASE WHEN l_linenumber <> 1 THEN max(l_partkey) END AS pu, max(l_shipdate) AS cdc
 FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE {live("iid")}),
inv AS (
 SELECT {inv}, CASE WHEN value > 50 THEN ts END AS office, CASE WHEN value > 20 THEN ts END AS cust, CASE WHEN value > 10 THEN ts END AS tax, '1' AS tag FROM events WHERE event_id % 2 = 0 AND {live("event_id")}
 UNION ALL SELECT {inv}, NULL, NULL, NULL, '2' FROM events WHERE event_id % 2 = 1 AND {live("event_id")}),
srcs AS (SELECT code AS application_code, approved AS approve_date, st AS status, ino AS invoice_no, sent AS send_date, office AS office_receive_date, cust AS customer_receive_date, tax AS tax_invoice_date, tag AS type
 FROM inv WHERE (tag = '1' AND st >= 3) OR (tag = '2' AND st IN (30, 40))),
unit AS (SELECT p_partkey, p_name FROM part WHERE {live("p_partkey")}),
route AS (SELECT n_nationkey, n_regionkey FROM nation WHERE {live("n_nationkey")}),
message AS (SELECT r_name FROM region WHERE r_name = 'ASIA' AND {live("r_regionkey")}),
comp AS (SELECT n_nationkey, n_name FROM nation WHERE {live("n_nationkey")}),
con AS (SELECT s_suppkey, s_name FROM supplier WHERE {live("s_suppkey")}),
usr AS (SELECT c_custkey FROM customer WHERE {live("c_custkey")}),
task AS (SELECT user_id AS wf, event_id % 30 AS route FROM events WHERE event_type = 'signup' AND {live("event_id")}),
apt AS (SELECT application_code, max(tax_invoice_date) AS tax_invoice_date FROM srcs WHERE type = '1' GROUP BY 1),
tmp AS (SELECT application_code, max(approve_date) AS approve_date FROM srcs WHERE status = 30 GROUP BY 1),
tic AS (SELECT DISTINCT invoice_no, application_code, send_date FROM srcs WHERE status >= 40 AND (office_receive_date IS NULL OR customer_receive_date IS NULL)),
elig AS (SELECT * FROM app WHERE kind = 1 AND st IN (30, 40, 50) AND created > TIMESTAMP '1996-01-01'),
core AS (SELECT a.*, i.iid, i.con, i.pu, greatest(a.created, i.cdc) AS cdc, a.gone OR i.iid % 13 = 0 AS del, p.p_name AS pun, apt.tax_invoice_date AS taxd
 FROM elig a JOIN inst i ON i.aid = a.aid LEFT JOIN unit p ON p.p_partkey = i.pu LEFT JOIN apt ON apt.application_code = a.code),
appr AS ({_branch(APPROVAL, "c.created", "r.r_name", "CAST(NULL AS VARCHAR)", "core c LEFT JOIN task t ON t.wf = c.wf LEFT JOIN route n ON n.n_nationkey = t.route LEFT JOIN region r ON r.r_regionkey = n.n_regionkey WHERE c.st = 30")}),
send AS ({_branch(SENDING, "m.approve_date", "g.r_name", "CAST(NULL AS VARCHAR)", "core c JOIN tmp m ON m.application_code = c.code LEFT JOIN message g ON TRUE WHERE c.st = 40")}),
sign AS ({_branch(SIGNING, "t.send_date", f"'{FINISHED}'", "t.invoice_no", "core c JOIN tic t ON t.application_code = c.code WHERE c.st = 50")}),
fact AS (SELECT * FROM appr UNION ALL SELECT * FROM send UNION ALL SELECT * FROM sign)
"""


def _branch(node_type: str, submit: str, role: str, invoice_no: str, rest: str) -> str:
    made = {
        "id": "c.iid", "head_id": "CAST(c.aid AS VARCHAR)", "application_code": "c.code", "period_id": "CAST(strftime(c.created, '%Y%m') AS INTEGER)", "period_id_dd": "CAST(strftime(c.created, '%Y%m%d') AS INTEGER)",
        "period_id_qty": "CAST(strftime(c.created, '%Y%m%d') AS INTEGER)", "business_id": "c.aid", "bill_type": f"'{BILL}'", "business_type": f"'{NORMAL}'", "node_type": f"'{node_type}'", "invoice_type_id": "-999",
        "salesperson_id": "c.sid", "company_id": "c.cid", "customer_id": "c.cust", "contract_id": "c.con", "invoice_no": invoice_no, "operator_application_id": "c.aid", "currency_id": "c.cur", "total_amount": "c.amount",
        "creation_date": "c.created", "submit_date": submit, "applicant_time": "c.created", "currentrole": role, "logical_is_deleted": "c.gone", "cdc_last_update_date": "c.cdc", "tax_invoice_date": "c.taxd", "payment_unit_number": "c.pun",
    }
    nulls = {"invoice_id": "BIGINT", "milestone_name": "VARCHAR", "current_handler_id": "BIGINT", "todo_billing_id": "BIGINT", "payment_unit_id": "BIGINT", "source_code": "VARCHAR", "details_flag": "VARCHAR", "billing_status": "VARCHAR"}
    return "SELECT " + ", ".join(f"{made[c] if c in made else f'CAST(NULL AS {nulls[c]})'} AS {c}" for c in FACT) + f", c.del AS logical_is_deleted_del FROM {rest}"


def fact_columns() -> str:
    return ", ".join("CAST(total_amount AS DOUBLE) AS total_amount" if c == "total_amount" else c for c in [*FACT, "logical_is_deleted_del"])


PLAIN = [c for c in FACT if c not in ("id", "salesperson_id", "total_amount", "cdc_last_update_date")]


def detail() -> str:
    """Further tables: q1 (live detail) over fact."""
    plain = ", ".join(f"f.{c}" for c in PLAIN)
    reasons = ", ".join(f"CAST(NULL AS {TYPES[t]}) AS {c}" for c, t in REASONS.items())
    return f""", q1 AS (SELECT CAST(f.id AS VARCHAR) AS id, {plain}, CAST(f.salesperson_id AS VARCHAR) AS salesperson_id, CAST(NULL AS VARCHAR) AS invoice_category, 'unknown' AS invoice_type_name,
  CAST(co.n_nationkey % 5 AS VARCHAR) AS company_code, co.n_name AS company_name, coalesce('A' || s1.n_nationkey, 'L' || s2.n_nationkey) AS cfs_salesperson_code, coalesce(s1.n_name, s2.n_name) AS cfs_salesperson_name,
  CAST(coalesce(s1.n_regionkey, s2.n_regionkey) AS BIGINT) AS cfs_region_id, 'C' || cu.c_custkey AS customer_code, cu.c_name AS customer_name, cu.c_mktsegment AS customer_group_name, sp.s_name AS contract_number,
  CASE WHEN sp.s_suppkey % 10 <> 1 THEN 'DIRECT' END AS business_source, r.r_name AS currency_code,
  CAST(CAST((r.r_regionkey + 1) * 0.25 AS DECIMAL(15,6)) * f.total_amount AS DECIMAL(38,10)) AS usd_total_amount, CAST(CAST((r.r_regionkey + 1) * 1.75 AS DECIMAL(15,6)) * f.total_amount AS DECIMAL(38,10)) AS rmb_total_amount,
  CAST(f.total_amount AS DECIMAL(38,10)) AS total_amount, CAST(1 AS BIGINT) AS con_mi_qty, CAST(NULL AS VARCHAR) AS current_handler_code, CAST(NULL AS VARCHAR) AS current_handler_name, {reasons}
 FROM fact f JOIN con sp ON sp.s_suppkey = f.contract_id AND sp.s_suppkey % 10 <> 0 LEFT JOIN comp co ON co.n_nationkey = f.company_id
  LEFT JOIN nation s1 ON s1.n_nationkey = f.salesperson_id AND s1.n_regionkey IN (0, 1)
  LEFT JOIN nation s2 ON s2.n_nationkey = f.salesperson_id AND s2.n_regionkey IN (1, 2) AND s2.n_nationkey % 5 = co.n_nationkey % 5
  LEFT JOIN customer cu ON cu.c_custkey = f.customer_id LEFT JOIN region r ON r.r_regionkey = f.currency_id
 WHERE (s1.n_nationkey IS NOT NULL OR s2.n_nationkey IS NOT NULL) AND f.cdc_last_update_date >= TIMESTAMP '1997-05-31 23:30:00')"""


DETAIL = [
    "id", *PLAIN, "salesperson_id", "invoice_category", "invoice_type_name", "company_code", "company_name", "cfs_salesperson_code", "cfs_salesperson_name", "cfs_region_id", "customer_code", "customer_name", "customer_group_name",
    "contract_number", "business_source", "currency_code", "usd_total_amount", "rmb_total_amount", "total_amount", "con_mi_qty", "current_handler_code", "current_handler_name", *REASONS,
]
MONEY = ("usd_total_amount", "rmb_total_amount", "total_amount")


def money(columns: list[str]) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in MONEY else c for c in columns)


def gone() -> str:
    """q2 over what q1 accumulated, dtl (both), and the scope with its weights."""
    alive = " OR ".join(f"(q.node_type = '{n}' AND NOT EXISTS (SELECT 1 FROM {t} b WHERE NOT b.logical_is_deleted_del AND CAST(b.id AS VARCHAR) = q.id))" for n, t in ((APPROVAL, "appr"), (SENDING, "send"), (SIGNING, "sign")))
    mark = ", ".join("TRUE AS logical_is_deleted" if c == "logical_is_deleted" else c for c in DETAIL)
    return f""", q2all AS (SELECT {mark} FROM q1 q WHERE {alive}),
 q2 AS (SELECT * FROM q2all g WHERE NOT EXISTS (SELECT 1 FROM q1 WHERE q1.id = g.id AND q1.logical_is_deleted)),
 dtl AS (SELECT {", ".join(DETAIL)} FROM q1 UNION ALL SELECT {", ".join(DETAIL)} FROM q2),
 scope AS (SELECT CAST(id AS VARCHAR) AS id FROM fact WHERE cdc_last_update_date >= TIMESTAMP '1997-05-31 23:30:00')"""


SUMMARY = [c for c in DETAIL if c not in ("id", "head_id", "business_id", "invoice_type_id", "salesperson_id", "company_id", "company_name", "customer_id", "contract_id", "application_code", "currency_id", "current_handler_id", "payment_unit_id", "logical_is_deleted", "payment_unit_number", "contract_number", "business_source", "billing_status", *MONEY, "con_mi_qty")]


def summary() -> str:
    most = ", ".join(f"max(d.{c}) AS {c}" for c in SUMMARY)
    lists = ", ".join(f"substr(string_agg(d.{c}, ',' ORDER BY d.{c}), 1, 1000) AS {c}" for c in ("contract_number", "business_source", "billing_status"))
    sums = ", ".join(f"CAST(sum(d.{c}) AS DECIMAL(38,10)) AS {c}" for c in MONEY)
    return f""", q3 AS (SELECT d.head_id || CAST(d.logical_is_deleted AS VARCHAR) AS head_id, d.logical_is_deleted, {most}, {sums}, CAST(sum(d.con_mi_qty) AS BIGINT) AS con_mi_qty, {lists},
  substr(string_agg(DISTINCT d.payment_unit_number, ',' ORDER BY d.payment_unit_number), 1, 1000) AS payment_unit_number, CAST(NULL AS BIGINT) AS over_due_days
 FROM dtl d JOIN scope s ON s.id = d.id GROUP BY d.head_id, d.logical_is_deleted),
 q4 AS (SELECT q3.* REPLACE (TRUE AS logical_is_deleted) FROM q3 JOIN (SELECT head_id AS h FROM dtl GROUP BY 1 HAVING sum(CASE WHEN logical_is_deleted THEN 0 ELSE 1 END) = 0) x ON replace(replace(q3.head_id, 'false', ''), 'true', '') = x.h)"""


SUMMARY_ALL = ["head_id", "logical_is_deleted", *SUMMARY, *MONEY, "con_mi_qty", "contract_number", "business_source", "billing_status", "payment_unit_number", "over_due_days"]


def everything(condition: str | None = None) -> str:
    return base(condition) + detail() + gone() + summary()


#: Tables of one step, which get the step's number when several stand in one statement.
STEP_TABLES = "app inst inv srcs unit route message comp con usr task apt tmp tic elig core appr send sign fact q1 scope q3 acc dtl q2all q2 sum1 q4 sums".split()


def accumulated(conditions: list[str]) -> str:
    """dtl and sums after several steps, whose live rows are given: tables dtl_k and sums_k for each step k from 1 on."""
    columns, totals = ", ".join(DETAIL), ", ".join(SUMMARY_ALL)
    out = []
    for k, condition in enumerate(conditions, 1):
        text = base(condition).removeprefix("WITH ") + detail()
        if k == 1:
            acc, sums = f"SELECT {columns} FROM q1", f"SELECT {totals} FROM q3"
        else:
            fresh = "NOT EXISTS (SELECT 1 FROM {0} o WHERE o.{1} = n.{1} AND o.logical_is_deleted = n.logical_is_deleted)"
            acc = f"SELECT {columns} FROM dtl_{k - 1} UNION ALL SELECT {columns} FROM q1 n WHERE " + fresh.format(f"dtl_{k - 1}", "id")
            sums = f"SELECT {totals} FROM sums_{k - 1} UNION ALL SELECT {totals} FROM q3 n WHERE " + fresh.format(f"sums_{k - 1}", "head_id")
        tombs = gone().replace("FROM q1 q WHERE", "FROM acc q WHERE").replace("SELECT 1 FROM q1 WHERE q1.id = g.id AND q1.logical_is_deleted", "SELECT 1 FROM acc WHERE acc.id = g.id AND acc.logical_is_deleted").replace(" FROM q1 UNION ALL", " FROM acc UNION ALL")
        text += f", acc AS ({acc})" + tombs + summary().split(",\n q4 AS")[0] + f""", sum1 AS ({sums}),
 q4 AS (SELECT s.* REPLACE (TRUE AS logical_is_deleted) FROM sum1 s JOIN (SELECT head_id AS h FROM dtl GROUP BY 1 HAVING sum(CASE WHEN logical_is_deleted THEN 0 ELSE 1 END) = 0) x ON replace(replace(s.head_id, 'false', ''), 'true', '') = x.h),
 sums AS (SELECT {totals} FROM sum1 UNION ALL SELECT {totals} FROM q4 n WHERE NOT EXISTS (SELECT 1 FROM sum1 o WHERE o.head_id = n.head_id AND o.logical_is_deleted))"""
        out.append(re.sub(rf"\b({'|'.join(STEP_TABLES)})\b", rf"\1_{k}", text))
    return "WITH " + ",\n".join(out) + "\n"
