"""Two maintainers of the views under steps of deletes and inserts.

JoinFree keeps maxima, counted projections and semi-join flags; no join result is
stored but the ids of the fact with their multiplicity, and joins run when a query asks.  Full
keeps the views themselves and derives the rows of affected ids anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import counts as C
from ..plans import views as V
from ..sources.catalog import DYNAMIC, ROLES, Catalog, assert_unique, with_rows
from . import delta as D
from .state import Store, nothing

SOURCES = ("customer_invoice", "issued_invoice")
TRIPLE = ["invoice_no", "application_code", "send_date"]
#: Slices (1 to 100) by set: base, extra, or all for those of both.
Slices = dict[str, list[int]]


@dataclass
class Step:
    """Full rows that a step inserts and deletes, by role; roles it doesn't touch are absent.

    leaving may say, by a SQL condition on the key, which rows deleted holds; once promises that no
    key comes in two steps.  slices are those that come and leave in a planned step.  until, where
    there is one, gives this step and those after it, up to another, as one.
    """

    inserted: Mapping[str, DataFrame]
    deleted: Mapping[str, DataFrame]
    leaving: Mapping[str, str] = field(default_factory=dict)
    once: bool = False
    slices: tuple[Slices, Slices] | None = None
    until: Callable[[Step], Step] | None = None


class Rows(Mapping):
    """Rows by role, each read when it is asked for."""

    def __init__(self, reads: dict[str, Callable[[], DataFrame]]) -> None:
        self.reads = reads

    def __getitem__(self, role: str) -> DataFrame:
        return self.reads[role]()

    def __contains__(self, role: object) -> bool:
        return role in self.reads

    def __iter__(self) -> Iterator[str]:
        return iter(self.reads)

    def __len__(self) -> int:
        return len(self.reads)


class Base:
    """The dynamic roles themselves, kept by both methods' driver."""

    def __init__(self, store: Store, static: Catalog) -> None:
        self.store, self.static = store, static
        self.checked: set[str] = set()
        if f"base_{DYNAMIC[0]}" in store:
            return
        for role in ROLES:
            if role in DYNAMIC:
                store.write(f"base_{role}", static(role).limit(0))
            elif not store.lazy:
                assert_unique(static(role), ROLES[role].key)

    def step(self, step: Step) -> Step:
        """The step with its rows as stored, so that no method derives them from their sources again.

        Keys are checked in what a step leaves, before any method takes it: the counts by annotation rely on them.
        Of keys that come in one step only, those that come now are enough.
        """
        come, gone = {}, {}
        for role in DYNAMIC:
            name, key = f"base_{role}", ROLES[role].key
            old = self.store.ref(name)
            if role in step.leaving:
                gone[role] = lambda old=old, where=step.leaving[role]: old().where(where)
                self.store.restrict(name, f"NOT ({step.leaving[role]})")
            elif role in step.deleted:
                gone[role] = self.store.defer(f"gone_{role}", lambda role=role, old=old, key=key: old().join(step.deleted[role].select(key).distinct(), key, "left_semi"))
                self.store.defer(name, lambda old=old, gone=gone[role], key=key: old().join(gone().select(key), key, "left_anti"))
            if role in step.inserted:
                self.store.defer(name, lambda role=role: step.inserted[role], True, lambda new, key=key: assert_unique(new, key), once=step.once)
                come[role] = self.store.ref(name, last=True)
        return Step(Rows(come), Rows(gone), step.leaving, step.once)

    def catalog(self) -> Catalog:
        """The roles as they are now, whatever steps come later."""
        return with_rows(self._checked, Rows({r: self.store.ref(f"base_{r}") for r in DYNAMIC}))

    def _checked(self, role: str) -> DataFrame:
        """A role that doesn't change, its keys checked when it is first read."""
        if self.store.lazy and role not in self.checked:
            assert_unique(self.static(role), ROLES[role].key)
            self.checked.add(role)
        return self.static(role)


@dataclass
class Span(Step):
    """What changed from one version of planned base tables to another: the slices live before and after, and the slices that have come."""

    before: Slices = field(default_factory=dict)
    after: Slices = field(default_factory=dict)
    came: Slices = field(default_factory=dict)


class Planned(Base):
    """The dynamic roles of a lazy run of planned steps: a version is a set of slices, and its rows are read where they lie.

    Nothing is copied, and what several steps did is one condition on the key.  Keys are checked
    when a version is first read, among all rows that came until then.
    """

    def __init__(self, store: Store, static: Catalog, within: Callable[[str, Slices], str]) -> None:
        """within gives the SQL condition on a key for rows of slices."""
        self.store, self.static, self.within = store, static, within
        self.checked: set[str] = set()
        self.live: Slices = {}
        self.came: Slices = {}
        #: By role the slices whose keys were checked.
        self.seen: dict[str, Slices] = {r: {} for r in DYNAMIC}

    def step(self, step: Step) -> Step:
        if not step.once or step.slices is None:
            raise ValueError("a planned step says what slices come and leave, and no key comes twice")
        come, leave = step.slices
        before, self.came = self.live, _with(self.came, come)
        self.live = _with(_without(before, leave), come)
        return self._span(before, self.live, self.came, step.slices)

    def _span(self, before: Slices, after: Slices, came: Slices, slices: tuple[Slices, Slices]) -> Span:
        new, old = _without(after, before), _without(before, after)
        come, gone = ({r: lambda r=r, x=x: self._rows(r, x, came) for r in DYNAMIC} if x else {} for x in (new, old))
        out = Span(Rows(come), Rows(gone), once=True, slices=slices, before=before, after=after, came=came)
        out.until = lambda last: self._span(before, last.after, last.came, (new, old))
        return out

    def _rows(self, role: str, slices: Slices, came: Slices) -> DataFrame:
        """Rows of slices, after a check of the keys that came until then."""
        new, key = _without(came, self.seen[role]), ROLES[role].key
        if new:
            sure = getattr(self.static, "sure", {}).get(role)
            if sure is None or not sure():
                # together with those checked before, as a key may stand in both
                assert_unique(self.static(role).where(self.within(key, came)), key)
            self.seen[role] = _with(self.seen[role], came)
        return self.static(role).where(self.within(key, slices))

    def catalog(self) -> Catalog:
        live, came = self.live, self.came
        return with_rows(self._checked, Rows({r: lambda r=r: self._rows(r, live, came) for r in DYNAMIC}))


def _with(a: Slices, b: Slices) -> Slices:
    return {n: sorted({*a.get(n, ()), *b.get(n, ())}) for n in {**a, **b}}


def _without(a: Slices, b: Slices) -> Slices:
    left = {n: sorted({*x} - {*b.get(n, ())}) for n, x in a.items()}
    return {n: x for n, x in left.items() if x}


@dataclass
class Change:
    """A signed delta (w) of a step, made when it is asked for."""

    step: Step
    make: Callable[[Step], DataFrame]

    def __call__(self) -> DataFrame:
        return self.make(self.step)

    @staticmethod
    def together(changes: list[Change]) -> DataFrame:
        """The delta of several steps, the first one first; of planned steps what differs between first and last alone."""
        first, last = changes[0], changes[-1]
        if all(c.step.until for c in changes):
            return last.make(first.step.until(last.step) if len(changes) > 1 else first.step)
        return reduce(DataFrame.unionByName, [c() for c in changes])


def _invoice_rows(role: str, rows: DataFrame) -> DataFrame:
    """What of a source can reach a view."""
    kept = rows.where("status >= 3" if role == "customer_invoice" else "status IN (30, 40)")
    return kept.select("source_id", "application_code", "status", "invoice_no", "approve_date", "send_date", "office_receive_date", "customer_receive_date", "tax_invoice_date")


def _both(base: Catalog) -> DataFrame:
    return _invoice_rows("customer_invoice", base("customer_invoice")).unionByName(_invoice_rows("issued_invoice", base("issued_invoice")))


def _moved(step: Step, base: Catalog, roles: tuple[str, ...]) -> DataFrame:
    """The signed delta (w) of invoices in a step."""
    out = None
    for r in roles:
        for sign, rows in ((1, step.inserted), (-1, step.deleted)):
            if r in rows:
                part = _invoice_rows(r, rows[r]).withColumn("w", F.lit(sign))
                out = part if out is None else out.unionByName(part)
    return _both(base).limit(0).withColumn("w", F.lit(1)) if out is None else out


def _fold_invoices(store: Store, base: Catalog, step: Step, deletes: bool, apt: str, temp: str, tic: str) -> tuple[Callable[[], DataFrame], Callable[[], DataFrame]]:
    """Maxima and open invoices after a step; base holds the roles after it.  Returns what reads the last two."""
    own, both = (lambda: _invoice_rows("customer_invoice", base("customer_invoice"))), (lambda: _both(base).where("status = 30"))

    def maxima(rows: DataFrame, delta: DataFrame, source: Callable[[], DataFrame], value: str) -> DataFrame:
        # without deletes, by the plan alone, no maximum can leave
        return D.fold_max(rows, source if deletes and not nothing(delta.where("w < 0")) else None, delta, "application_code", value)

    def moved(form: Callable[[DataFrame], DataFrame], *roles: str) -> Change:
        return Change(step, lambda s: form(_moved(s, base, roles)))

    store.fold(apt, moved(lambda rows: rows, "customer_invoice"), lambda rows, delta: maxima(rows, delta(), own, "tax_invoice_date"), Change.together)
    approved = store.fold(temp, moved(lambda rows: rows.where("status = 30"), *SOURCES), lambda rows, delta: maxima(rows, delta(), both, "approve_date"), Change.together)
    return approved, store.fold(tic, moved(_open, *SOURCES), lambda rows, delta: D.fold_count(rows, delta(), TRIPLE), Change.together)


def _open(rows: DataFrame) -> DataFrame:
    return rows.where("status >= 40 AND (office_receive_date IS NULL OR customer_receive_date IS NULL)")


class JoinFree:
    def __init__(self, store: Store, base: Catalog, rules: V.Rules) -> None:
        self.store, self.rules = store, rules
        self.deletes = False  # whether a step so far took invoices out
        if "fact_ids" in store:
            return
        store.defer("agg_apt", lambda: D.max_state(_invoice_rows("customer_invoice", base("customer_invoice")), "application_code", "tax_invoice_date"))
        temp = store.defer("agg_temp", lambda: D.max_state(_both(base).where("status = 30"), "application_code", "approve_date"))
        tic = store.defer("vp_tic", lambda: _open(_both(base)).groupBy(*TRIPLE).agg(F.count(F.lit(1)).alias("cnt")))
        inst = store.defer("vp_inst", lambda: base("instance").groupBy("application_id").agg(F.count(F.lit(1)).alias("cnt")))
        store.defer("vs_oa", lambda: self._flagged(V.eligible(base("application"), rules), inst(), temp(), tic()))
        fact = self.views(base)
        store.defer("fact_ids", lambda: self._ids(fact.fact(base)))

    def _flagged(self, rows: DataFrame, inst: DataFrame, temp: DataFrame, tic: DataFrame) -> DataFrame:
        rows = D.has_key(rows, inst, "application_id", "flag_inst")
        return D.has_key(D.has_key(rows, temp, "application_code", "flag_temp"), tic, "application_code", "flag_tic")

    @staticmethod
    def _ids(fact: DataFrame) -> DataFrame:
        return fact.groupBy("id").agg(F.max("cdc_last_update_date").alias("cdc_last_update_date"), F.count(F.lit(1)).alias("cnt"))

    def views(self, base: Catalog) -> JoinFreeViews:
        """The views over the states as they are now, whatever steps come later."""
        return JoinFreeViews({n: self.store.ref(n) for n in ("agg_apt", "agg_temp", "vp_tic", "vs_oa")}, self.rules)

    def fact(self, base: Catalog) -> DataFrame:
        return self.views(base).fact(base)

    def parts(self, base: Catalog) -> dict[str, DataFrame]:
        return self.views(base).parts(base)

    def step(self, step: Step, base: Catalog) -> None:
        """base holds the dynamic roles after the step."""
        s, rules = self.store, self.rules
        old = s.ref("vs_oa")
        self.deletes |= any(r in step.deleted for r in SOURCES)

        temp, tic = _fold_invoices(s, base, step, self.deletes, "agg_apt", "agg_temp", "vp_tic")

        def touched(step: Step) -> DataFrame:
            nothing = base("instance").limit(0)
            ins, gone = step.inserted.get("instance", nothing), step.deleted.get("instance", nothing)
            return ins.select("application_id", F.lit(1).alias("w")).unionByName(gone.select("application_id", F.lit(-1).alias("w")))

        inst = s.fold("vp_inst", Change(step, touched), lambda rows, delta: D.fold_count(rows, delta(), ["application_id"]), Change.together)
        # flags follow from the states alone: one semi-join each costs less than births and deaths of a large step, and no older version is read
        oa = s.defer("vs_oa", lambda: self._flagged(V.eligible(base("application"), rules), inst(), temp(), tic()))

        def affected() -> DataFrame:
            """Ids of the fact whose rows may have changed: those are derived anew."""
            columns = ("application_id", "application_code", "work_flow_id", "status")
            return affected_ids(step, base, _moved(step, base, SOURCES).select("application_code").distinct(), old().select(*columns).unionByName(oa().select(*columns)))

        ids, views = s.defer("touched_ids", affected), self.views(base)
        s.fold("fact_ids", ids, lambda rows, touched: _rederived(rows, touched, "id", base, lambda src: self._ids(views.fact(src))))

    def counts(self, base: Catalog) -> DataFrame:
        """q1 to q4's count forms (one row) by annotation: no join result is made."""
        src, s = self.views(base).catalog(base), self.store
        return C.counts(C.annotated(src, self.rules, s.now("agg_temp").select("application_code"), s.now("vp_tic").select(*TRIPLE)))


def _only(base: Catalog, ids: DataFrame) -> Catalog:
    """base with the instances of some ids."""
    return with_rows(base, {"instance": base("instance").join(ids.select(F.col("id").alias("instance_id")), "instance_id", "left_semi")})


def _rederived(rows: DataFrame, touched: Callable[[], DataFrame], key: str, base: Catalog, derive: Callable[[Catalog], DataFrame]) -> DataFrame:
    """rows with those of touched ids derived anew from base; of an empty table all rows are new, and no ids are asked for."""
    if nothing(rows):
        return derive(base).select(*rows.columns)
    ids = touched()
    return D.rederive(rows, ids.withColumnRenamed("id", key), key, derive(_only(base, ids)))


@dataclass
class JoinFreeViews:
    """The views over one version of the join-free states, joined when they are asked for."""

    states: dict[str, Callable[[], DataFrame]]
    rules: V.Rules

    def live(self) -> DataFrame:
        """Applications that take part in a branch."""
        return self.states["vs_oa"]().where("flag_inst AND (status = 30 OR (status = 40 AND flag_temp) OR (status = 50 AND flag_tic))")

    def catalog(self, base: Catalog) -> Catalog:
        """base with the applications reduced by their flags."""
        return with_rows(base, {"application": self.live().drop("flag_inst", "flag_temp", "flag_tic")})

    def _small(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        tax, approved = (self.states[n]().select("application_code", F.col("max").alias(c)) for n, c in (("agg_apt", "tax_invoice_date"), ("agg_temp", "approve_date")))
        return tax, approved, self.states["vp_tic"]().select(*TRIPLE)

    def parts(self, base: Catalog) -> dict[str, DataFrame]:
        """The three branches, joined now from the states."""
        src, (tax, approved, open_) = self.catalog(base), self._small()
        return V.branches(src, self.rules, V.core(src, self.rules, tax), approved, open_)

    def fact(self, base: Catalog) -> DataFrame:
        return V.fact(self.catalog(base), self.rules, *self._small())

    def live_ids(self, base: Catalog) -> DataFrame:
        return V.live_ids(self.catalog(base), self.rules, *self._small()[1:])


def affected_ids(step: Step, base: Catalog, codes: DataFrame, apps: DataFrame) -> DataFrame:
    """Instance ids whose fact rows a step may change: their own, and by payment unit, application,
    code, work flow (of a task, or of the tasks of a route) or, for messages, by being in sending.

    Companies, contracts and users aren't in the fact; queries join them as they are.
    """
    instances = base("instance").select("instance_id", "application_id", "payment_unit_id")
    flows = apps.select("application_id", "work_flow_id")
    own, by_app = [], [apps.join(codes, "application_code", "left_semi").select("application_id")]
    for rows in (step.inserted, step.deleted):
        if "instance" in rows:
            own.append(rows["instance"].select(F.col("instance_id").alias("id")))
        if "payment_unit" in rows:
            own.append(instances.join(rows["payment_unit"].select("payment_unit_id"), "payment_unit_id", "left_semi").select(F.col("instance_id").alias("id")))
        if "application" in rows:
            by_app.append(rows["application"].select("application_id"))
        tasks = [rows["task"]] if "task" in rows else []
        if "route" in rows:
            tasks.append(base("task").join(rows["route"].select("route_id"), "route_id", "left_semi"))
        for found in tasks:
            by_app.append(flows.join(found.select(F.col("process_id").alias("work_flow_id")), "work_flow_id", "left_semi").select("application_id"))
        if "message" in rows:
            some = rows["message"].agg((F.count(F.lit(1)) > 0).alias("_some")).where("_some")  # one row, or none
            by_app.append(apps.where(F.col("status") == V.STATUS[V.SENDING]).join(F.broadcast(some)).select("application_id"))
    reached = by_app[0]
    for more in by_app[1:]:
        reached = reached.unionByName(more)
    ids = instances.join(reached.distinct(), "application_id", "left_semi").select(F.col("instance_id").alias("id"))
    for more in own:
        ids = ids.unionByName(more)
    return ids.distinct()


class Full:
    """The views as tables: maxima and open invoices by counted state, core and fact by affected id."""

    def __init__(self, store: Store, base: Catalog, rules: V.Rules) -> None:
        self.store, self.rules = store, rules
        self.deletes = False  # whether a step so far took invoices out
        if "full_fact" in store:
            return
        store.defer("full_apt", lambda: D.max_state(_invoice_rows("customer_invoice", base("customer_invoice")), "application_code", "tax_invoice_date"))
        store.defer("full_temp", lambda: D.max_state(_both(base).where("status = 30"), "application_code", "approve_date"))
        store.defer("full_tic", lambda: _open(_both(base)).groupBy(*TRIPLE).agg(F.count(F.lit(1)).alias("cnt")))
        small = self._small()
        store.defer("full_core", lambda: V.core(base, rules, small()[0]))
        store.defer("full_fact", lambda: V.fact(base, rules, *small()))

    def _small(self) -> Callable[[], tuple[DataFrame, DataFrame, DataFrame]]:
        """Maxima and open invoices as they are now, read later."""
        apt, temp, tic = (self.store.ref(n) for n in ("full_apt", "full_temp", "full_tic"))
        return lambda: (apt().select("application_code", F.col("max").alias("tax_invoice_date")), temp().select("application_code", F.col("max").alias("approve_date")), tic().select(*TRIPLE))

    def step(self, step: Step, base: Catalog) -> None:
        """base holds the dynamic roles after the step."""
        s = self.store

        self.deletes |= any(r in step.deleted for r in SOURCES)
        _fold_invoices(s, base, step, self.deletes, "full_apt", "full_temp", "full_tic")

        def affected() -> DataFrame:
            columns = ("application_id", "application_code", "work_flow_id", "status")
            apps = base("application").select(*columns)
            if "application" in step.deleted:
                apps = apps.unionByName(step.deleted["application"].select(*columns))
            return affected_ids(step, base, _moved(step, base, SOURCES).select("application_code").distinct(), apps)

        ids, small = s.defer("full_touched", affected), self._small()
        s.fold("full_core", ids, lambda rows, touched: _rederived(rows, touched, "instance_id", base, lambda src: V.core(src, self.rules, small()[0])))
        s.fold("full_fact", ids, lambda rows, touched: _rederived(rows, touched, "id", base, lambda src: V.fact(src, self.rules, *small())))

    def views(self, base: Catalog) -> FullViews:
        return FullViews(self.store.ref("full_fact"))

    def parts(self, base: Catalog) -> dict[str, DataFrame]:
        fact = self.fact(base)
        return {n: fact.where(F.col("node_type") == n) for n in V.STATUS}

    def fact(self, base: Catalog) -> DataFrame:
        return self.store.now("full_fact")


@dataclass
class FullViews:
    """The fact as one version of the tables has it."""

    state: Callable[[], DataFrame]

    def fact(self, base: Catalog) -> DataFrame:
        return self.state()

    def live_ids(self, base: Catalog) -> DataFrame:
        return self.state().where("logical_is_deleted_del IS FALSE").select("node_type", "id")


@dataclass
class Recomputed:
    """The views from the base tables alone."""

    rules: V.Rules

    def fact(self, base: Catalog) -> DataFrame:
        return V.fact(base, self.rules)

    def live_ids(self, base: Catalog) -> DataFrame:
        return V.live_ids(base, self.rules)
