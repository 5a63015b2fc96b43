"""Queries by name with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions import bare_head, joined_values
from ..operators import delta as D
from ..operators.state import shared_root, written
from ..sources import testdata
from ..streaming import scenario as S
from . import counts as C
from . import oracle as O
from . import results as R
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
RULES = V.Rules(first_creation=testdata.FIRST_CREATION)
SLIDE, WINDOW = 25, 50
SHORT = {"ins": "insertion_only", "slide": "sliding_window", "repl": "replacement"}
_runs: dict[tuple, S.Runner] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison with other engines."""
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, DecimalType)})


def runner(spark: SparkSession, sf_dir: str, scenario: str, stream: bool = False) -> S.Runner:
    """A scenario's run, kept for the other queries of the session."""
    key = (spark.sparkContext.applicationId, sf_dir, scenario, stream)
    if key not in _runs:
        source = testdata.catalog(spark, sf_dir)
        if stream:
            _runs[key] = S.run_stream(spark, source, RULES, scenario, f"{shared_root(spark)}/tidemark-stream-{uuid.uuid4().hex}", SLIDE, WINDOW)
        else:
            _runs[key] = S.run(spark, source, RULES, scenario, SLIDE, WINDOW, ("join_free", "full"), lazy=True)
    return _runs[key]


class Accumulated:
    """q1 to q4 of one step over the whole tables, each from what those before it accumulated.

    Only what a query needs is planned.  q1 reads the views; later queries read the fact and the
    accumulated details, which are written once in the shared folder, as several of them use both.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.src = testdata.catalog(spark, sf_dir)

    @cached_property
    def fact(self) -> DataFrame:
        return written(V.fact(self.src, RULES), "fact")

    @cached_property
    def parts(self) -> dict[str, DataFrame]:
        return {label: self.fact.where(F.col("node_type") == label) for label in V.STATUS}

    @property
    def q1(self) -> DataFrame:
        return R.detail(V.fact(self.src, RULES), self.src, RULES)

    @cached_property
    def before_q2(self) -> DataFrame:
        return written(R.detail(self.fact, self.src, RULES), "detail")

    @cached_property
    def q2(self) -> DataFrame:
        return R.accumulate(self.before_q2, R.detail_gone(self.before_q2, self.parts), "id")

    @cached_property
    def dtl(self) -> DataFrame:
        return self.before_q2.unionByName(written(self.q2, "tombstones"))

    @property
    def q2_form(self) -> DataFrame:
        return R.detail_gone(self.dtl, self.parts)

    @cached_property
    def q3(self) -> DataFrame:
        return R.summary(self.dtl, self.fact, self.src, RULES)

    @property
    def q4(self) -> DataFrame:
        return R.summary_gone(self.q3, self.dtl)


def _view(make: Callable) -> Query:
    return lambda spark, d: plain(make(testdata.catalog(spark, d)))


def _result(name: str, form: Callable[[DataFrame], DataFrame] = R.steady) -> Query:
    return lambda spark, d: plain(form(getattr(Accumulated(spark, d), name)))


def _counted(q: str) -> Query:
    """A query's count by annotation, from the base tables."""
    return lambda spark, d: C.counts(C.annotated(testdata.catalog(spark, d), RULES)).select(F.col(q).alias("n"))


def _state(short: str, name: str) -> Query:
    return lambda spark, d: runner(spark, d, SHORT[short]).store.get(name)


def _fact(short: str, method: str, stream: bool = False) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        r = runner(spark, d, SHORT[short], stream)
        return plain(r.methods[method].fact(r.base.catalog()))

    return query


def _events(spark: SparkSession, d: str, odd: int | None = None) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", F.when(F.col("value") >= 1, F.col("ts")).alias("seen"))
    return e if odd is None else e.where(F.col("event_id") % 2 == odd)


def _folded(spark: SparkSession, d: str, deletes: bool) -> DataFrame:
    """Maxima of the even events after the odd ones came or, with deletes, after multiples of three left."""
    even, odd = _events(spark, d, 0), _events(spark, d, 1)
    gone = even.where("event_id % 3 = 0") if deletes else even.limit(0)
    come = odd.limit(0) if deletes else odd
    state = D.max_state(even, "user_id", "seen")
    return D.fold_max(state, D.apply_delta(even, come, gone, "event_id"), D.signed(even, come, gone, "event_id"), "user_id", "seen")


def _refcount(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("kind", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    state = rows.where("event_id % 2 = 0").groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("cnt"))
    delta = rows.where("event_id % 4 = 0").withColumn("w", F.lit(-1)).unionByName(rows.where("event_id % 2 = 1").withColumn("w", F.lit(1)))
    return D.fold_count(state, delta, ["user_id", "kind"])


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    old, new = e.where("event_id % 97 = 0"), e.where("event_id % 97 = 1")
    return D.transitions(old, new, e, "user_id")


def _flags(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return D.has_key(o, _events(spark, d).where("event_type = 'purchase'"), "user_id", "bought")


def _delta_join(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    e = _events(spark, d).select("event_id", "user_id")
    new_o, new_e = o.where("o_orderkey % 5 = 0"), e.where("event_id % 5 = 0")
    return D.delta_join(o, new_o, e, new_e, "user_id", "o_orderkey")


def _apply(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    return D.apply_delta(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 = 1"), o.where("o_orderkey % 6 = 0"), "o_orderkey")


def _diff(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return D.multiset_diff(e.where("event_id % 2 = 0").select("user_id", "event_type"), e.where("event_id % 3 = 0").select("user_id", "event_type"))


def _guard(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_type", (F.col("event_id") % 2 == 0).alias("logical_is_deleted"))
    return R.accumulate(e.where("user_id % 3 = 0 AND event_type = 'click'"), e.where("event_type <> 'click'"), "user_id")


def _merge(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("kind", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    a = e.where("event_id % 2 = 0").groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("a"))
    b = e.where("event_id % 2 = 1").groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, D.null_safe(a, b, ["user_id", "kind"])).select(a.user_id, a.kind, "a", "b")


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).groupBy(F.col("user_id").alias("o_custkey")).agg(F.count(F.lit(1)).alias("w"))
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(22,3)"))
    return o.join(e, "o_custkey").groupBy("o_orderstatus").agg(F.sum(F.col("o_totalprice") * F.col("w")).cast("double").alias("total"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("user_id").agg(joined_values(F.col("event_type"), distinct=True).alias("kinds"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    s = o.select(F.concat(F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 2 == 0).cast("string")).alias("head_id"))
    k = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("h"))
    return s.join(k, bare_head(F.col("head_id")) == F.col("h"))


#: Accumulated results: two steps of half the slices, over all methods.
HALF = 50
METHODS = ("join_free", "full", "recompute")


def accumulating(spark: SparkSession, sf_dir: str, short: str) -> S.Runner:
    key = (spark.sparkContext.applicationId, sf_dir, short, "results")
    if key not in _runs:
        _runs[key] = S.run(spark, testdata.catalog(spark, sf_dir), RULES, SHORT[short], HALF, HALF, METHODS, results=True, lazy=True)
    return _runs[key]


def _accumulated(short: str, table: str, method: str) -> Query:
    return lambda spark, d: plain(R.steady(accumulating(spark, d, short).store.get(f"{table}_{method}")))


def _annotated(short: str) -> Query:
    """The four counts from the join-free method's states."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        r = runner(spark, d, SHORT[short])
        return r.methods["join_free"].counts(r.base.catalog())

    return query


def _methods(short: str) -> Query:
    """The fact as the join-free method has it against the full one's: rows that differ."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        r = runner(spark, d, SHORT[short])
        now = r.base.catalog()
        a, b = (r.methods[m].fact(now) for m in ("join_free", "full"))
        return D.multiset_diff(a, b.select(*a.columns)).agg(F.count(F.lit(1)).alias("n"))

    return query


ACCUMULATED = {"dtl": "detail", "sum": "summary"}
BRANCH = {"approval": ("appr", V.APPROVAL), "send": ("send", V.SENDING), "countersign": ("sign", V.SIGNING)}
FORMS = {"q1": ("id", "application_code", "submit_date", "total_amount"), "q2": ("id", "application_code", "submit_date", "total_amount"), "q3": ("head_id", "total_amount"), "q4": ("head_id", "total_amount")}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "src_union": _view(V.invoices), "apt": _view(V.tax_dates), "temp": _view(V.approvals), "tic": _view(V.unsigned),
        "inst_core": _view(lambda s: V.core(s, RULES).select("instance_id", "application_id", "application_code", "status", "contract_id", "total_amount", "cdc_last_update_date", "logical_is_deleted_del", "payment_unit_number", "tax_invoice_date")),
        "fact": _view(lambda s: V.fact(s, RULES)), "lookback_filter": _view(lambda s: R.look_back(V.fact(s, RULES), s, RULES).select("id", "cdc_last_update_date")),
        "apply_delta": _apply, "fold_max_insert": lambda s, d: _folded(s, d, False), "fold_max_delete_recalc": lambda s, d: _folded(s, d, True), "distinct_refcount": _refcount, "null_safe_merge": _merge,
        "semi_join_flags": _flags, "births_deaths": _transitions, "delta_join": _delta_join, "accumulate_guard": _guard, "multiset_diff": _diff, "weighted_sum": _weighted, "string_agg_distinct_ordered": _listed,
        "expr_key_join": _heads,
        "base_row_counts": _base_counts,
    }
    for name, (_, label) in BRANCH.items():
        out[name] = _view(lambda s, label=label: V.branches(s, RULES)[label])
    for q, columns in FORMS.items():
        out[f"{q}_rows"] = _result(q)
        out[f"{q}_count"] = _counted(q)
        out[f"{q}_count_of_rows"] = _result("q2_form" if q == "q2" else q, R.count_form)
        out[f"{q}_minmax"] = _result("q2_form" if q == "q2" else q, lambda df, c=columns: R.minmax_form(df, c))
    for short in SHORT:
        for state in ("agg_apt", "agg_temp", "vp_tic", "vp_inst", "vs_oa", "fact_ids"):
            get = _state(short, state)
            out[f"joinfree_{short}_{state}"] = (lambda s, d, g=get: plain(g(s, d))) if state != "vs_oa" else (lambda s, d, g=get: g(s, d).select("application_id", "application_code", "status", "flag_inst", "flag_temp", "flag_tic"))
        out[f"joinfree_{short}_fact"] = _fact(short, "join_free")
        out[f"full_{short}_fact"] = _fact(short, "full")
        out[f"full_{short}_tic"] = _state(short, "full_tic")
        out[f"joinfree_{short}_counts"] = _annotated(short)
        out[f"methods_differ_{short}"] = _methods(short)
    out["stream_slide_fact"] = _fact("slide", "join_free", True)
    for short in SHORT:
        for name, table in ACCUMULATED.items():
            for method in METHODS:
                out[f"accumulated_{name}_{short}_{method}"] = _accumulated(short, table, method)
    return out


def _base_counts(spark: SparkSession, d: str) -> DataFrame:
    src = testdata.catalog(spark, d)
    out = None
    for role in S.DYNAMIC:
        rows = src(role).agg(F.count(F.lit(1)).alias("n")).select(F.lit(role).alias("role"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def oracles() -> dict[str, str]:
    b, e = O.base(), O.everything()
    seen = "event_id, user_id, event_type, CASE WHEN value >= 1 THEN ts END AS seen"
    kind = "CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind"
    maxima = "SELECT user_id, count(*) AS cnt, count(seen) AS cnt_nonnull, max(seen) AS max FROM (SELECT {0} FROM events) WHERE {1} GROUP BY 1"
    out = {
        "src_union": b + "SELECT * FROM srcs", "apt": b + "SELECT * FROM apt", "temp": b + "SELECT * FROM tmp", "tic": b + "SELECT * FROM tic",
        "inst_core": b + "SELECT iid AS instance_id, aid AS application_id, code AS application_code, st AS status, con AS contract_id, CAST(amount AS DOUBLE) AS total_amount, cdc AS cdc_last_update_date, del AS logical_is_deleted_del, pun AS payment_unit_number, taxd AS tax_invoice_date FROM core",
        "fact": b + f"SELECT {O.fact_columns()} FROM fact", "lookback_filter": b + "SELECT id, cdc_last_update_date FROM fact WHERE cdc_last_update_date >= TIMESTAMP '1997-05-31 23:30:00'",
        "apply_delta": "SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0) OR o_orderkey % 3 = 1",
        "fold_max_insert": maxima.format(seen, "TRUE"), "fold_max_delete_recalc": maxima.format(seen, "event_id % 2 = 0 AND event_id % 3 <> 0"),
        "distinct_refcount": f"SELECT user_id, kind, count(*) AS cnt FROM (SELECT *, {kind} FROM events) WHERE event_id % 4 <> 0 GROUP BY 1, 2",
        "null_safe_merge": f"WITH x AS (SELECT *, {kind} FROM events), a AS (SELECT user_id, kind, count(*) AS a FROM x WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, kind, count(*) AS b FROM x WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT a.user_id, a.kind, a.a, b.b FROM a JOIN b ON a.user_id = b.user_id AND a.kind IS NOT DISTINCT FROM b.kind",
        "semi_join_flags": "SELECT o_orderkey, o_custkey AS user_id, EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND event_type = 'purchase') AS bought FROM orders",
        "births_deaths": "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_id % 97 = 0), b AS (SELECT DISTINCT user_id FROM events WHERE event_id % 97 = 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, b.user_id IS NOT NULL AS alive FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL",
        "delta_join": "SELECT user_id, o_orderkey, event_id FROM orders JOIN events ON user_id = o_custkey WHERE o_orderkey % 5 = 0 OR event_id % 5 = 0",
        "accumulate_guard": "WITH e AS (SELECT user_id, event_type, event_id % 2 = 0 AS logical_is_deleted FROM events) SELECT * FROM e WHERE event_type <> 'click' AND NOT EXISTS (SELECT 1 FROM e c WHERE c.user_id % 3 = 0 AND c.event_type = 'click' AND c.user_id = e.user_id AND c.logical_is_deleted = e.logical_is_deleted)",
        "multiset_diff": "WITH a AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_type FROM events WHERE event_id % 3 = 0) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
        "weighted_sum": "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(22,3))) AS DOUBLE) AS total FROM orders JOIN events ON user_id = o_custkey GROUP BY 1",
        "string_agg_distinct_ordered": "SELECT user_id, substr(string_agg(DISTINCT event_type, ',' ORDER BY event_type), 1, 1000) AS kinds FROM events GROUP BY 1",
        "expr_key_join": "SELECT o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS head_id, CAST(o_orderkey AS VARCHAR) AS h FROM orders WHERE o_orderstatus = 'P'",
        "base_row_counts": b + "SELECT 'application' AS role, count(*) AS n FROM app UNION ALL SELECT 'instance', count(*) FROM inst UNION ALL SELECT 'customer_invoice', count(*) FROM inv WHERE tag = '1' UNION ALL SELECT 'issued_invoice', count(*) FROM inv WHERE tag = '2' UNION ALL SELECT 'task', count(*) FROM task UNION ALL SELECT 'payment_unit', count(*) FROM unit UNION ALL SELECT 'route', count(*) FROM route UNION ALL SELECT 'message', count(*) FROM message UNION ALL SELECT 'company', count(*) FROM comp UNION ALL SELECT 'contract', count(*) FROM con UNION ALL SELECT 'user', count(*) FROM usr",
    }
    for name, (table, _) in BRANCH.items():
        out[name] = b + f"SELECT {O.fact_columns()} FROM {table}"
    rows = {"q1": (O.DETAIL, "q1"), "q2": (O.DETAIL, "q2"), "q3": (O.SUMMARY_ALL, "q3"), "q4": (O.SUMMARY_ALL, "q4")}
    for q, (columns, table) in rows.items():
        out[f"{q}_rows"] = e + f"SELECT {O.money(columns)} FROM {table}"
        form = "q2all" if q == "q2" else table
        # q2's form runs after its own tombstones joined the detail, which carry no live id either
        source = f"(SELECT * FROM {form} UNION ALL SELECT * FROM q2)" if q == "q2" else form
        out[f"{q}_count"] = out[f"{q}_count_of_rows"] = e + f"SELECT count(*) AS n FROM {source}"
        out[f"{q}_minmax"] = e + "SELECT " + ", ".join(f"CAST({f}({c}) AS DOUBLE) AS {f}_{c}" if c == "total_amount" else f"{f}({c}) AS {f}_{c}" for c in FORMS[q] for f in ("min", "max")) + f" FROM {source}"
    window = {"insertion_only": "slice <= 100", "sliding_window": f"slice > {100 - WINDOW} AND slice <= 100", "replacement": "extra"}
    for short, scenario in SHORT.items():
        x = O.base(window[scenario])
        out |= {
            f"joinfree_{short}_agg_apt": x + "SELECT application_code, count(*) AS cnt, count(tax_invoice_date) AS cnt_nonnull, max(tax_invoice_date) AS max FROM srcs WHERE type = '1' GROUP BY 1",
            f"joinfree_{short}_agg_temp": x + "SELECT application_code, count(*) AS cnt, count(approve_date) AS cnt_nonnull, max(approve_date) AS max FROM srcs WHERE status = 30 GROUP BY 1",
            f"joinfree_{short}_vp_tic": x + "SELECT invoice_no, application_code, send_date, count(*) AS cnt FROM srcs WHERE status >= 40 AND (office_receive_date IS NULL OR customer_receive_date IS NULL) GROUP BY 1, 2, 3",
            f"joinfree_{short}_vp_inst": x + "SELECT aid AS application_id, count(*) AS cnt FROM inst GROUP BY 1",
            f"joinfree_{short}_vs_oa": x + "SELECT aid AS application_id, code AS application_code, st AS status, aid IN (SELECT aid FROM inst) AS flag_inst, code IN (SELECT application_code FROM tmp) AS flag_temp, code IN (SELECT application_code FROM tic) AS flag_tic FROM elig",
            f"joinfree_{short}_fact_ids": x + "SELECT id, max(cdc_last_update_date) AS cdc_last_update_date, count(*) AS cnt FROM fact GROUP BY 1",
            f"joinfree_{short}_fact": x + f"SELECT {O.fact_columns()} FROM fact",
            f"full_{short}_fact": x + f"SELECT {O.fact_columns()} FROM fact",
            f"full_{short}_tic": x + "SELECT invoice_no, application_code, send_date, count(*) AS cnt FROM srcs WHERE status >= 40 AND (office_receive_date IS NULL OR customer_receive_date IS NULL) GROUP BY 1, 2, 3",
            f"joinfree_{short}_counts": O.everything(window[scenario]) + "SELECT (SELECT count(*) FROM q1) AS q1, (SELECT count(*) FROM (SELECT * FROM q2all UNION ALL SELECT * FROM q2)) AS q2, (SELECT count(*) FROM q3) AS q3, (SELECT count(*) FROM q4) AS q4",
            f"methods_differ_{short}": "SELECT CAST(0 AS BIGINT) AS n",
        }
    for short, scenario in SHORT.items():
        both = O.accumulated([f"({S.live(scenario, p, HALF)})" for p in range(HALF, 101, HALF)])
        for method in METHODS:
            out[f"accumulated_dtl_{short}_{method}"] = both + f"SELECT {O.money(O.DETAIL)} FROM dtl_2"
            out[f"accumulated_sum_{short}_{method}"] = both + f"SELECT {O.money(O.SUMMARY_ALL)} FROM sums_2"
    out["stream_slide_fact"] = O.base(window["sliding_window"]) + f"SELECT {O.fact_columns()} FROM fact"
    return out
