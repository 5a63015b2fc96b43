"""Step planner, slices of the base tables, and the runner that keeps and compares all methods."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta as D
from ..operators.maintain import Base, Full, JoinFree, Planned, Recomputed, Rows, Step
from ..operators.state import Store
from ..plans import results as R
from ..plans import views as V
from ..sources.catalog import DYNAMIC, ROLES, Catalog

SCENARIOS = ("insertion_only", "sliding_window", "replacement")
#: Per cent of the rows that are the second set of the replacement scenario.
EXTRA = 50


@dataclass(frozen=True)
class Plan:
    """One step: the slices (1 to 100) of each set that it inserts and deletes."""

    scenario: str
    step: int
    percent: int
    inserted: dict[str, list[int]] = field(default_factory=dict)
    deleted: dict[str, list[int]] = field(default_factory=dict)


def plan_steps(scenario: str, slide: int = 5, window: int = 10) -> list[Plan]:
    """The steps of a scenario; slide must divide 100 and window, and window be no less than slide."""
    if scenario not in SCENARIOS:
        raise ValueError(f"no scenario {scenario}")
    if slide <= 0 or 100 % slide or window % slide or window < slide:
        raise ValueError("slide must divide 100 and the window, which must be no less")
    out = []
    for k, p in enumerate(range(slide, 101, slide), 1):
        new = list(range(p - slide + 1, p + 1))
        if scenario == "replacement":
            first = {"base": list(range(1, 101))} if k == 1 else {}
            out.append(Plan(scenario, k, p, {**first, "extra": new}, {"base": new}))
        else:
            old = list(range(p - window - slide + 1, p - window + 1)) if scenario == "sliding_window" and p > window else []
            out.append(Plan(scenario, k, p, {"all": new}, {"all": old} if old else {}))
    return out


def live(scenario: str, percent: int, window: int = 10) -> str:
    """The SQL condition on (slice, extra) for rows that are live after a step."""
    if scenario == "insertion_only":
        return f"slice <= {percent}"
    if scenario == "sliding_window":
        return f"slice <= {percent} AND slice > {percent - window}"
    return f"(NOT extra AND slice > {percent}) OR (extra AND slice <= {percent})"


def sliced(rows: DataFrame, key: str) -> DataFrame:
    """rows with their slice, and whether they are of the second set."""
    return rows.withColumn("slice", (F.col(key) % 100 + 1).cast("int")).withColumn("extra", F.floor(F.col(key) / 100) % 100 < EXTRA)


def select_sets(rows: DataFrame, sets: dict[str, list[int]]) -> DataFrame:
    kept = F.lit(False)
    for name, slices in sets.items():
        inside = F.col("slice").isin(slices)
        kept |= inside if name == "all" else inside & (F.col("extra") == (name == "extra"))
    return rows.where(kept).drop("slice", "extra")


def within(key: str, sets: dict[str, list[int]]) -> str:
    """The SQL condition on a key for rows of the sets: slices and sets are functions of the key alone."""
    parts = []
    for name, slices in sets.items():
        if not slices:
            continue
        # a range is far faster than a long list
        run = sorted(slices) == list(range(min(slices), max(slices) + 1))
        inside = f"CAST({key} % 100 + 1 AS INT) " + (f"BETWEEN {min(slices)} AND {max(slices)}" if run else f"IN ({', '.join(map(str, slices))})")
        parts.append(inside if name == "all" else f"({inside} AND {'' if name == 'extra' else 'NOT '}floor({key} / 100) % 100 < {EXTRA})")
    return " OR ".join(parts) or "FALSE"


def step_of(plan: Plan, source: Catalog) -> Step:
    """Full rows of a planned step.  In one step, rows deleted and inserted of one key would be an update.

    A key comes in one step of a plan at most, and leaves by its slice.
    """

    def rows(role: str, sets: dict[str, list[int]]) -> DataFrame:
        return select_sets(sliced(source(role), ROLES[role].key), sets)

    come, leave = plan.inserted, plan.deleted
    if "base" in come:  # what is preloaded and deleted at once never shows
        come, leave = {n: [x for x in slices if x not in leave.get(n, ())] for n, slices in come.items()}, {}
    gone = {r: lambda r=r: rows(r, leave) for r in DYNAMIC} if leave else {}
    return Step(Rows({r: lambda r=r: rows(r, come) for r in DYNAMIC}), Rows(gone), {r: within(ROLES[r].key, leave) for r in gone}, once=True, slices=(come, leave))


def live_catalog(source: Catalog, scenario: str, percent: int, window: int) -> Catalog:
    """The catalog that recomputation sees after a step."""
    condition = live(scenario, percent, window)
    return lambda name: sliced(source(name), ROLES[name].key).where(condition).drop("slice", "extra") if name in DYNAMIC else source(name)


class Runner:
    """Keeps base tables, both maintainers and accumulated results through the steps of a scenario."""

    def __init__(self, spark: SparkSession, source: Catalog, rules: V.Rules, methods: tuple[str, ...] = ("join_free",), results: bool = False, root: str | None = None, lazy: bool = False) -> None:
        """A root that holds the commits of a run goes on after its last step; a lazy run makes a state when it is read.

        Accumulated results read every step, so they keep copies of the base tables; other lazy runs read those where they lie.
        """
        self.spark, self.source, self.rules, self.results = spark, source, rules, results
        self.store = Store(spark, root, lazy)
        self.base = Planned(self.store, source, within) if lazy and not results else Base(self.store, source)
        makers = {"join_free": JoinFree, "full": Full}
        self.methods = {m: makers[m](self.store, self.base.catalog(), rules) for m in methods if m in makers}
        self.logical = [m for m in methods if m not in makers]
        self.metrics: list[dict] = []
        if not self.store.commits:
            self.store.commit(0)

    def apply(self, plan: Plan) -> None:
        """One step: all states change in one commit, or none does."""
        if plan.step <= self.store.done:
            return
        if plan.step != self.store.done + 1:
            raise ValueError(f"step {plan.step} after step {self.store.done}")
        step = self.base.step(step_of(plan, self.source))
        now = self.base.catalog()
        for name, method in self.methods.items():
            began = time.time()
            method.step(step, now)
            self.metrics.append({"scenario": plan.scenario, "step": plan.step, "phase": "maintain", "method": name, "seconds": time.time() - began})
        if self.results:
            for name in (*self.methods, *self.logical):
                began = time.time()
                self.accumulate(name, now)
                self.metrics.append({"scenario": plan.scenario, "step": plan.step, "phase": "build", "method": name, "seconds": time.time() - began})
        self.store.commit(plan.step)

    def accumulate(self, method: str, now: Catalog) -> None:
        """Run q1 to q4 in turn, each into its target's next version."""
        s, views = self.store, self.methods[method].views(now) if method in self.methods else Recomputed(self.rules)
        dtl, tot = f"detail_{method}", f"summary_{method}"

        def add(name: str, rows: Callable[[], DataFrame], key: str) -> Callable[[], DataFrame]:
            if name not in s:
                return s.defer(name, rows)
            target = s.ref(name)
            return s.defer(name, lambda: R.accumulate(target(), rows(), key), True)

        if dtl in s:  # rows that the target holds are left out before they are looked up
            target = s.ref(dtl)
            one = s.defer(dtl, lambda: R.detail(R.not_held(target(), views.fact(now)), now, self.rules), True)
        else:
            one = s.defer(dtl, lambda: R.detail(views.fact(now), now, self.rules))
        two = add(dtl, lambda: R.detail_not_in(one(), views.live_ids(now), tuple(V.STATUS)), "id")
        three = add(tot, lambda: R.summary(two(), views.fact(now), now, self.rules), "head_id")
        add(tot, lambda: R.summary_gone(three(), two()), "head_id")

    def differences(self, a: str, b: str) -> int:
        """Rows that two methods' accumulated results have differently."""
        out = 0
        for name in ("detail", "summary"):
            x, y = R.steady(self.store.get(f"{name}_{a}")), R.steady(self.store.get(f"{name}_{b}"))
            out += D.multiset_diff(x, y.select(*x.columns)).count()
        return out


def run(spark: SparkSession, source: Catalog, rules: V.Rules, scenario: str, slide: int = 25, window: int = 50, methods: tuple[str, ...] = ("join_free",), results: bool = False, lazy: bool = False) -> Runner:
    runner = Runner(spark, source, rules, methods, results, lazy=lazy)
    for plan in plan_steps(scenario, slide, window):
        runner.apply(plan)
    return runner


def run_stream(spark: SparkSession, source: Catalog, rules: V.Rules, scenario: str, folder: str, slide: int = 25, window: int = 50, methods: tuple[str, ...] = ("join_free",)) -> Runner:
    """The same steps from a stream of manifests, one file a step, each applied by a micro-batch.

    All tables of a step change together, which independent streams of tables couldn't promise.
    Manifests, progress and states live in folder, which all executors reach: called again on it,
    a stream that was stopped goes on after the last committed step.
    """
    runner = Runner(spark, source, rules, methods, root=f"{folder}/states")
    manifest = f"{folder}/manifest"
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        for p in plan_steps(scenario, slide, window):  # one after the other: a stream reads files by their age
            spark.createDataFrame([(p.step, json.dumps(asdict(p)))], "step int, plan string").coalesce(1).write.mode("append").json(manifest)

    def batch(rows: DataFrame, _: int) -> None:
        for r in rows.orderBy("step").collect():  # one row a step
            runner.apply(Plan(**json.loads(r.plan)))

    reader = spark.readStream.schema("step int, plan string").option("maxFilesPerTrigger", 1).json(manifest)
    stream = reader.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    stream.awaitTermination()
    return runner
