"""Versioned Parquet state: each change writes a new version, so lineage ends and a failed step leaves the old one.

A commit is one small file, put in place by a rename, that names the versions of all states; a
store that is opened on a folder with commits goes on from the last one.  A version may add its
folder to those of the one before instead of repeating them, or leave rows of them out by a
condition that is taken when they are read, and one that is empty by its plan has none.  A lazy store makes a version when it is first read, so that a query costs the states that it
needs and no others.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMITS = "_commits"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors reach; a temporary folder where it is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, written once."""
    path = f"{shared_root(df.sparkSession)}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nothing(df: DataFrame) -> bool:
    """Whether df's plan alone says that it has no rows; no job runs."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.getClass().getSimpleName() == "LocalRelation" and plan.data().isEmpty()


class Store:
    """Named states: write() makes a version, commit() makes all new versions current at once.

    get() reads the committed version, now() the one written since, if any.  done is the number
    that the last commit was given (the steps that the states hold).  A lazy store lives for its
    session: its commits order versions, write no file and keep all versions.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, lazy: bool = False) -> None:
        self.spark, self.root, self.lazy = spark, root or f"{shared_root(spark)}/tidemark-state-{uuid.uuid4().hex}", lazy
        self.versions: dict[str, int] = {}
        #: Of each version the folders, each with the condition that rows of it must meet (SQL, empty for all).
        self.folders: dict[tuple[str, int], list[tuple[int, str]]] = {}
        self.makers: dict[tuple[str, int], Callable[[], None]] = {}
        self.deltas: dict[tuple[str, int], tuple[int, Callable[[], DataFrame]]] = {}
        self.schemas: dict[str, StructType] = {}
        self.pending: dict[str, int] = {}
        self.commits = self.done = 0
        self._restore()

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _restore(self) -> None:
        folder, fs = self._path(COMMITS)
        if not fs.exists(folder):
            return
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json"))
        if names:
            found = json.loads(self.spark.read.text(f"{self.root}/{COMMITS}/{names[-1]}", wholetext=True).first()[0])
            self.versions, self.done, self.commits = found["versions"], found["done"], int(names[-1].split(".")[0])
            self.schemas = {n: StructType.fromJson(s) for n, s in found["schemas"].items()}
            self.folders = {(n, v): [(f, "") if isinstance(f, int) else tuple(f) for f in found.get("folders", {}).get(n, [v])] for n, v in self.versions.items()}

    def _read(self, name: str, version: int, last: bool = False) -> DataFrame:
        if (name, version) in self.makers:
            self.makers[name, version]()
            del self.makers[name, version]
        folders = self.folders[name, version]
        return self._rows(name, [f for f in folders if f[0] == version] if last else folders)

    def _rows(self, name: str, folders: list[tuple[int, str]]) -> DataFrame:
        out = None
        for condition in dict.fromkeys(c for _, c in folders):
            rows = self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.root}/{name}/v{v:06d}" for v, c in folders if c == condition])
            rows = rows.where(condition) if condition else rows
            out = rows if out is None else out.unionByName(rows)
        if out is not None:
            return out
        return self.spark.range(1).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schemas[name]])

    def _current(self, name: str) -> int:
        return self.pending.get(name) or self.versions[name]

    def ref(self, name: str, last: bool = False) -> Callable[[], DataFrame]:
        """What reads the version that is current now, later; of the last folder only, what append() added."""
        version = self._current(name)
        return lambda: self._read(name, version, last)

    def get(self, name: str) -> DataFrame:
        return self._read(name, self.versions[name])

    def now(self, name: str) -> DataFrame:
        return self._read(name, self._current(name))

    def __contains__(self, name: str) -> bool:
        return name in self.versions or name in self.pending

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write a version that commit() makes the current one; returns it."""
        version = max(self.versions.get(name, 0), self.pending.get(name, 0)) + 1
        self._put(name, version, df)
        self.pending[name] = version
        return self._read(name, version)

    def _put(self, name: str, version: int, df: DataFrame, onto: int | None = None, check: Callable[[DataFrame], object] | None = None, once: bool = False) -> None:
        before = []
        if onto is not None:
            self._read(name, onto)
            before = self.folders[name, onto]
            df = df.select(*self.schemas[name].names)
        self.schemas[name] = df.schema
        if nothing(df):
            self.folders[name, version] = before
            return
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version:06d}")
        new = [(version, before[-1][1] if once and before else "")]  # one condition for all folders is one scan
        self.folders[name, version] = [*before, *new]
        if check:
            check(self._rows(name, new if once else self.folders[name, version]))

    def defer(self, name: str, make: Callable[[], DataFrame], append: bool = False, check: Callable[[DataFrame], object] | None = None, once: bool = False) -> Callable[[], DataFrame]:
        """Write what make gives, after the current version's rows with append; a lazy store does so when the version is read.

        check sees the whole version and may raise.  once says that a key that was in a version before
        never comes again: check sees what make gives alone, and rows that left stay out by one
        condition.  make must read states by ref(), as the current
        versions may have moved on.
        """
        onto = self._current(name) if append else None
        version = max(self.versions.get(name, 0), self.pending.get(name, 0)) + 1
        if self.lazy:
            self.makers[name, version] = lambda: self._put(name, version, make(), onto, check, once)
        else:
            self._put(name, version, make(), onto, check, once)
        self.pending[name] = version
        return self.ref(name)

    def fold(self, name: str, delta: Callable[[], DataFrame], make: Callable[[DataFrame, Callable[[], DataFrame]], DataFrame], together: Callable[[list], DataFrame] | None = None) -> Callable[[], DataFrame]:
        """Write make(old rows, what gives the delta).  A lazy store takes the deltas since the last version that was made at once:
        their union, or what together makes of them, the first one first.

        make must give the same for deltas one after the other and for their union, with what it
        reads besides as it is after the last of them.
        """
        version = max(self.versions.get(name, 0), self.pending.get(name, 0)) + 1
        self.deltas[name, version] = self._current(name), delta

        def folded() -> DataFrame:
            at, deltas = version, []
            while at == version or ((name, at) in self.makers and (name, at) in self.deltas):
                at, more = self.deltas[name, at]
                deltas.append(more)
            deltas.reverse()
            return make(self._read(name, at), lambda: together(deltas) if together else reduce(DataFrame.unionByName, [d() for d in deltas]))

        return self.defer(name, folded)

    def restrict(self, name: str, condition: str) -> None:
        """A version without the current one's rows that don't meet a condition; no row is written."""
        onto = self._current(name)
        version = max(self.versions.get(name, 0), self.pending.get(name, 0)) + 1

        def make() -> None:
            self._read(name, onto)
            self.folders[name, version] = [(v, f"({c}) AND ({condition})" if c else condition) for v, c in self.folders[name, onto]]

        if self.lazy:
            self.makers[name, version] = make
        else:
            make()
        self.pending[name] = version

    def commit(self, done: int | None = None) -> None:
        """All versions written since the last commit become current; of older ones the last committed stays for readers."""
        before, self.versions = self.versions, self.versions | self.pending
        self.done = self.done if done is None else done
        self.commits += 1
        if self.lazy:
            self.pending = {}
            return
        folders = {n: self.folders[n, v] for n, v in self.versions.items()}
        text = json.dumps({"versions": self.versions, "folders": folders, "done": self.done, "schemas": {n: json.loads(s.json()) for n, s in self.schemas.items()}})
        draft, fs = self._path(f"{COMMITS}/{self.commits:08d}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(draft, self._path(f"{COMMITS}/{self.commits:08d}.json")[0]):
            raise OSError(f"commit {self.commits} exists already")
        for name in self.pending:
            folder, fs = self._path(name)
            if not fs.exists(folder):
                continue
            kept = {f"v{v:06d}" for at in (before.get(name), self.versions[name]) if at for v, _ in self.folders[name, at]}
            for f in fs.listStatus(folder):
                if f.getPath().getName() not in kept:
                    fs.delete(f.getPath(), True)
        self.pending = {}

    def set(self, name: str, df: DataFrame) -> DataFrame:
        out = self.write(name, df)
        self.commit()
        return out
