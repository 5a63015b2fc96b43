"""Views, queries and maintainers: fixtures of one purpose each, and SQL over the driver's tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import delta as D
from tidemark.operators.state import Store
from tidemark.plans import registry
from tidemark.plans import results as R
from tidemark.sources import testdata
from tidemark.sources.catalog import assert_unique, read_slices, with_rows, write_csv
from tidemark.streaming import scenario as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(df):
    names = sorted(df.columns)
    return names, sorted(tuple(str(None if v != v or v is None else v) for v in r) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["src_union", "fact", "approval", "q1_rows", "q2_rows", "q3_rows", "q4_rows", "q1_minmax", "q2_count", "q3_count", "q4_count", "apply_delta", "fold_max_delete_recalc", "null_safe_merge", "delta_join", "births_deaths", "multiset_diff"])
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(c.execute(entry.oracle_sql()[name]).df())


def test_every_reference_query_has_sql():
    assert set(registry.queries()) == set(registry.oracles())


def maxima(spark, state_rows, gone, come):
    schema = "pk int, code string, v int"
    s, d, i = (spark.createDataFrame(x, schema) for x in (state_rows, gone, come))
    new = D.apply_delta(s, i, d, "pk")
    return rows(D.fold_max(D.max_state(s, "code", "v"), new, D.signed(s, i, d, "pk"), "code", "v"))


def test_fold_max(spark):
    state = [(1, "a", 1), (2, "a", 5), (3, "a", 5), (4, "a", 9)]
    assert maxima(spark, state, [(4, "a", 9)], []) == [("a", 3, 3, 5)]
    assert maxima(spark, state, [(2, "a", 5)], []) == [("a", 3, 3, 9)]
    assert maxima(spark, [(1, "a", None), (2, "a", 3)], [(2, "a", 3)], []) == [("a", 1, 0, None)]  # alive without a maximum
    assert maxima(spark, [(1, "a", 1)], [(1, "a", 1)], []) == []  # dead
    assert maxima(spark, [(1, "a", 1)], [(1, "a", 1)], [(1, "a", 0)]) == [("a", 1, 1, 0)]  # an update: deletes first
    assert maxima(spark, state, [], []) == [("a", 4, 4, 9)]


def test_fold_count_null_keys(spark):
    state = spark.createDataFrame([(None, None, 2)], "a string, b string, cnt long")
    delta = spark.createDataFrame([(None, None, -1), ("x", None, 1)], "a string, b string, w int")
    assert rows(D.fold_count(state, delta, ["a", "b"])) == rows(spark.createDataFrame([(None, None, 1), ("x", None, 1)], "a string, b string, c long"))


def test_transitions_and_flags(spark):
    old, new = (spark.createDataFrame([(k,) for k in x], "k int") for x in ([1, 2, 2], [2, 3]))
    t = D.transitions(old, new, old.union(new), "k")
    assert rows(t) == [(1, False), (3, True)]
    state = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "k int, f boolean")
    assert rows(D.patch_flag(state, t, "k", "f")) == [(1, False), (2, True), (3, True), (4, True)]


def test_accumulate_keeps_repeats_of_one_statement(spark):
    target = spark.createDataFrame([("a", False)], "id string, logical_is_deleted boolean")
    new = spark.createDataFrame([("a", False), ("b", False), ("b", False), ("a", True)], "id string, logical_is_deleted boolean")
    assert rows(R.accumulate(target, new, "id")) == [("a", True), ("b", False), ("b", False)]


def test_plan_steps():
    assert len(S.plan_steps("insertion_only")) == 20
    slide = S.plan_steps("sliding_window")
    assert slide[0].inserted == {"all": [1, 2, 3, 4, 5]} and slide[1].deleted == {} and slide[2].deleted == {"all": [1, 2, 3, 4, 5]}
    with pytest.raises(ValueError):
        S.plan_steps("sliding_window", 7, 14)
    with pytest.raises(ValueError):
        S.plan_steps("nothing")


def test_all_methods_agree_and_states_equal_recomputation(spark):
    source = testdata.catalog(spark, SF)
    r = S.run(spark, source, registry.RULES, "sliding_window", 50, 50, ("join_free", "full", "recompute"), results=True)
    assert r.differences("join_free", "recompute") == 0 and r.differences("full", "recompute") == 0
    now = r.base.catalog()
    fresh = registry.V.fact(now, registry.RULES)
    assert D.multiset_diff(r.methods["join_free"].fact(now), fresh).isEmpty()
    assert r.store.get("agg_temp").where("cnt <= 0 OR cnt_nonnull > cnt").isEmpty()


def test_messages_multiply_and_pad(spark):
    src = testdata.catalog(spark, SF)
    core = registry.V.core(src, registry.RULES)
    one = registry.V.sending(src, core).count()
    two = registry.V.sending(with_rows(src, {"message": src("message").union(src("message"))}), core).count()
    none = registry.V.sending(with_rows(src, {"message": src("message").limit(0)}), core)
    assert (two, none.count()) == (2 * one, one) and none.where("currentrole IS NOT NULL").isEmpty()


def test_store_commits_together(spark):
    s = Store(spark)
    s.set("x", spark.range(1))
    s.write("x", spark.range(5))
    assert s.get("x").count() == 1
    s.commit()
    assert s.get("x").count() == 5


def test_store_goes_on_from_its_commits(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    s = Store(spark, root)
    s.write("x", spark.range(3))
    s.write("y", spark.range(1))
    s.commit(4)
    s.write("x", spark.range(9))  # never committed
    again = Store(spark, root)
    assert (again.done, again.get("x").count(), again.get("y").count()) == (4, 3, 1)
    again.write("x", spark.range(7))
    again.write("x", spark.range(8))
    assert again.now("x").count() == 8 and again.get("x").count() == 3
    again.commit(5)
    assert Store(spark, root).get("x").count() == 8


def test_appended_versions_keep_their_folders(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    s = Store(spark, root)
    s.write("x", spark.range(3))
    s.commit(1)
    for n in (2, 3):
        s.defer("x", lambda n=n: spark.range(n), True)
        s.commit(n)
    again = Store(spark, root)
    assert (again.get("x").count(), again.ref("x", last=True)().count()) == (8, 3)
    with pytest.raises(ValueError):
        again.defer("x", lambda: spark.range(1), True, lambda new: assert_unique(new, "id"))


def test_lazy_run_makes_what_is_read_only(spark):
    source = testdata.catalog(spark, SF)
    both = [S.run(spark, source, registry.RULES, "sliding_window", 50, 50, ("join_free", "full", "recompute"), results=True, lazy=lazy) for lazy in (True, False)]
    read = [R.steady(r.store.get("detail_join_free")) for r in both]
    assert read[0].count() > 0 and D.multiset_diff(*read).isEmpty()
    made = {name for name, _ in both[0].store.folders}
    assert "detail_join_free" in made and not made & {"fact_ids", "summary_join_free", "full_fact", "detail_full", "detail_recompute"}
    assert D.multiset_diff(*(r.store.get("fact_ids") for r in both)).isEmpty()  # an early state, read later


def test_live_ids_equal_the_fact(spark):
    src = testdata.catalog(spark, SF)
    fact = registry.V.fact(src, registry.RULES).where("logical_is_deleted_del IS FALSE").select("node_type", "id").distinct()
    assert not fact.isEmpty() and D.multiset_diff(fact, registry.V.live_ids(src, registry.RULES)).isEmpty()


def test_multiset_diff_counts_both_ways(spark):
    a, b = (spark.createDataFrame(x, "k string, v int") for x in ([("x", None)] * 3 + [("y", 1)], [("x", None), ("z", 2), ("z", 2), ("y", 1)]))
    assert rows(D.multiset_diff(a, b)) == [("x", None, "left")] * 2 + [("z", 2, "right")] * 2


def test_stream_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    source, folder = testdata.catalog(spark, SF), f"file://{tmp_path}/stream"
    apply, seen = S.Runner.apply, []

    def failing(self, plan):
        seen.append(plan.step)
        if seen == [1, 2]:
            self.store.write("fact_ids", spark.range(1))  # half a step is written
            raise OSError("lost")
        apply(self, plan)

    monkeypatch.setattr(S.Runner, "apply", failing)
    with pytest.raises(Exception, match="lost"):
        S.run_stream(spark, source, registry.RULES, "sliding_window", folder, 50, 50)
    r = S.run_stream(spark, source, registry.RULES, "sliding_window", folder, 50, 50)
    assert seen == [1, 2, 2] and r.store.done == 2
    now = r.base.catalog()
    assert D.multiset_diff(r.methods["join_free"].fact(now), registry.V.fact(S.live_catalog(source, "sliding_window", 100, 50), registry.RULES)).isEmpty()


def test_counts_by_annotation_equal_rows(spark):
    """On a part of the tables with null marks, several sales rows and special messages."""
    src = testdata.catalog(spark, SF)
    apps = src("application").withColumn("logical_is_deleted", F.when(F.col("application_id") % 3 > 0, F.col("application_id") % 3 == 1))
    sales = src("region_sales")
    more = with_rows(src, {"application": apps, "region_sales": sales.unionByName(sales.withColumn("sales_row_id", F.col("sales_row_id") + 1000)), "message": src("message").unionByName(src("message").withColumn("message_id", F.lit(99).cast("long")))})
    fact = registry.V.fact(more, registry.RULES)
    parts = {n: fact.where(F.col("node_type") == n) for n in registry.V.STATUS}
    one = R.detail(fact, more, registry.RULES)
    dtl = one.unionByName(R.accumulate(one, R.detail_gone(one, parts), "id"))
    three = R.summary(dtl, fact, more, registry.RULES)
    want = (one.count(), R.detail_gone(dtl, parts).count(), three.count(), R.summary_gone(three, dtl).count())
    assert tuple(registry.C.counts(registry.C.annotated(more, registry.RULES)).first()) == want and min(want) > 0


def test_ingest_refuses_repeated_keys(spark):
    r = S.Runner(spark, testdata.catalog(spark, SF), registry.RULES, ())
    rows = r.source("company").limit(1)
    with pytest.raises(ValueError):
        r.base.step(S.Step({"company": rows.unionByName(rows)}, {}))


def test_csv_slices(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    write_csv(df, str(tmp_path / "a"))
    assert rows(read_slices(spark, df.schema, [str(tmp_path / "a")])) == rows(df)
    assert read_slices(spark, df.schema, []).isEmpty()
    with pytest.raises(ValueError):
        assert_unique(df.union(df), "k")
    assert assert_unique(df, "k") is df


def test_entry(spark):
    assert entry.entry(spark).select(F.count(F.lit(1))).first()[0] >= 0


def test_states_without_rows_take_no_folder(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", lazy=True)
    some = spark.createDataFrame([(1, "a")], "k int, v string")
    s.defer("x", lambda: some.limit(0))
    s.commit()
    assert rows(s.get("x")) == [] and s.get("x").schema == some.schema
    s.defer("x", lambda: some, True)
    s.defer("x", lambda: some.limit(0), True)
    s.commit()
    assert rows(s.get("x")) == [(1, "a")] and rows(s.ref("x", last=True)()) == []
    assert [p.name for p in (tmp_path / "s" / "x").iterdir()] == ["v000002"]


def test_fold_max_without_deletes_needs_no_source(spark):
    old, came = (spark.createDataFrame(x, "code string, v int") for x in ([(None, 1), ("a", 4)], [(None, 3), ("a", 2), ("b", None)]))
    assert rows(D.fold_max(D.max_state(old, "code", "v"), None, came.withColumn("w", F.lit(1)), "code", "v")) == rows(D.max_state(old.union(came), "code", "v"))


def test_details_held_are_left_out_before_lookups(spark):
    src = testdata.catalog(spark, SF)
    fact = registry.V.fact(src, registry.RULES)
    target = R.detail(fact.where("id % 3 = 0"), src, registry.RULES)
    want = R.accumulate(target, R.detail(fact, src, registry.RULES), "id").select("id", "logical_is_deleted", "currentrole")
    got = R.detail(R.not_held(target, fact), src, registry.RULES).select("id", "logical_is_deleted", "currentrole")
    assert rows(got) == rows(want) and got.count() > 0


def test_leaving_rows_are_left_out_when_read(spark, tmp_path):
    """F7-F22: a step's deletes write no folder, and keys are checked among what comes."""
    root = f"file://{tmp_path}/s"
    s = Store(spark, root)
    s.write("x", spark.range(6))
    s.commit(1)
    early = s.ref("x")
    s.restrict("x", "NOT (id % 3 = 0)")
    s.defer("x", lambda: spark.range(6, 9), True, lambda new: assert_unique(new, "id"))
    s.restrict("x", "NOT (id = 4)")
    s.commit(2)
    assert rows(s.get("x")) == rows(Store(spark, root).get("x")) == [(1,), (2,), (5,), (6,), (7,), (8,)] and early().count() == 6
    assert sorted(p.name for p in (tmp_path / "s" / "x").iterdir()) == ["v000001", "v000003"]


def test_unique_keys_by_words_of_bits(spark):
    keys = [-9223372036854775808, -65, -64, -1, 0, 63, 64, 9223372036854775807]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert assert_unique(df, "k") is df
    for bad in (-65, 63, None):
        with pytest.raises(ValueError):
            assert_unique(df.union(spark.createDataFrame([(bad,)], "k long")), "k")


def test_states_of_the_last_step_are_folded_at_once(spark):
    """F7-F22: a lazy run takes all pending deltas in one pass, maxima that left included."""
    r = S.run(spark, testdata.catalog(spark, SF), registry.RULES, "sliding_window", 25, 50, ("join_free",), lazy=True)
    inst, temp, now = r.store.get("vp_inst"), r.store.get("agg_temp"), r.base.catalog()
    assert {v for n, v in r.store.folders if n in ("vp_inst", "agg_temp")} == {1, 5}
    assert D.multiset_diff(inst, now("instance").groupBy("application_id").agg(F.count(F.lit(1)).alias("cnt"))).isEmpty()
    fresh = registry.V.invoices(now).where("status = 30")
    assert not temp.isEmpty() and D.multiset_diff(temp, D.max_state(fresh, "application_code", "approve_date")).isEmpty()


def test_ids_of_pending_steps_are_derived_anew_at_once(spark):
    """F18-F21: a fact that nobody read since its first step takes the ids of all steps that came, in one version."""
    source = testdata.catalog(spark, SF)
    r = S.Runner(spark, source, registry.RULES, ("full",), lazy=True)
    for plan in S.plan_steps("sliding_window", 25, 50):
        r.apply(plan)
        if plan.step == 1:
            assert not r.store.get("full_fact").isEmpty()
    got = r.store.get("full_fact")
    assert {v for n, v in r.store.folders if n == "full_fact"} == {1, 2, 5}
    assert D.multiset_diff(got, registry.V.fact(S.live_catalog(source, "sliding_window", 100, 50), registry.RULES)).isEmpty()


@pytest.mark.parametrize("scenario", ["replacement", "sliding_window"])
def test_lazy_planned_runs_copy_no_base_rows(spark, scenario):
    """F10-F13: base tables are read where they lie, and steps between two versions that are read are one change."""
    source = testdata.catalog(spark, SF)
    r = S.Runner(spark, source, registry.RULES, ("join_free", "full"), lazy=True)
    for plan in S.plan_steps(scenario, 25, 50):
        r.apply(plan)
        if plan.step not in (2, 4):  # read in between, so that the last change has rows that leave
            continue
        now = S.live_catalog(source, scenario, plan.percent, 50)
        sent = registry.V.invoices(now)
        want = {
            "vp_tic": sent.where("status >= 40 AND (office_receive_date IS NULL OR customer_receive_date IS NULL)").groupBy("invoice_no", "application_code", "send_date").agg(F.count(F.lit(1)).alias("cnt")),
            "agg_temp": D.max_state(sent.where("status = 30"), "application_code", "approve_date"),
            "agg_apt": D.max_state(sent.where("type = '1'"), "application_code", "tax_invoice_date"),
            "vp_inst": now("instance").groupBy("application_id").agg(F.count(F.lit(1)).alias("cnt")),
        }
        for name, rows_ in want.items():
            assert not rows_.isEmpty() and D.multiset_diff(r.store.get(name), rows_.select(*r.store.get(name).columns)).isEmpty(), name
        assert D.multiset_diff(r.store.get("full_tic"), want["vp_tic"]).isEmpty()
        for role in ("instance", "customer_invoice", "application", "task"):
            assert D.multiset_diff(r.base.catalog()(role), now(role)).isEmpty()
    made = {n for n, _ in r.store.folders}
    assert "vp_tic" in made and not any(n.startswith(("base_", "gone_")) for n in made)


def test_lazy_planned_runs_check_keys(spark):
    """F10-F13: a key that is repeated or missing is refused when rows of its role are read, also among rows that left."""
    source = testdata.catalog(spark, SF)
    twice = source("issued_invoice").where("source_id % 100 < 25")
    bad = with_rows(source, {"issued_invoice": source("issued_invoice").unionByName(twice.limit(1))})
    r = S.run(spark, bad, registry.RULES, "sliding_window", 25, 50, ("join_free",), lazy=True)
    for _ in range(2):
        with pytest.raises(ValueError):
            r.store.get("vp_tic")
    lines = source("instance").withColumn("instance_id", F.lit(7).cast("long"))
    r = S.run(spark, with_rows(source, {"instance": lines}), registry.RULES, "sliding_window", 25, 50, ("join_free",), lazy=True)
    with pytest.raises(ValueError):
        r.store.get("vp_inst")


def test_slices_as_ranges(spark):
    keys = spark.createDataFrame([(k,) for k in [*range(0, 20000, 7), -1, -99, None]], "k long")
    for sets in ({"all": list(range(26, 76))}, {"all": [3, 1, 9]}, {"base": [5], "extra": list(range(1, 101))}, {"base": []}, {}):
        assert rows(keys.where(S.within("k", sets))) == rows(S.select_sets(S.sliced(keys, "k"), sets))
    assert keys.where(S.within("k", {"extra": list(range(1, 101))})).count() > 0
