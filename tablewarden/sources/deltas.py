"""Keyed Parquet tables that take changes.

A commit writes folders of its own, and the log gets its rows last, in one file:
readers see all of a commit or nothing, and a commit that breaks off is never
seen.  Commits are numbered; each number can be read as long as ``vacuum`` has
not removed it.

* ``append`` writes changed rows and tombstones alone, so that a small change
  costs little however large the table is; readers take the newest row per key.
* ``merge`` rewrites the buckets (by hash of the key) that a change falls in and
  reads no other.
* ``compact`` turns all changes so far into rows without history.

One writer at a time: two commits of one number are found and raise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.sources.schemas import conform, empty, schema
from tablewarden.sources.store import _MAX_ROWS_PER_FILE, cut_lineage

_ENTRY = "version long, commit string, name string, folder string, whole array<int>, buckets int, rows long, at timestamp"
# Up to so many changed rows their keys may be broadcast, as Spark sees fit; file sizes alone hide how many rows there are.
_FEW_CHANGES = 100_000


class ConcurrentCommit(RuntimeError):
    """Two writers made commits of one number; neither is read."""


@dataclass(frozen=True)
class Entry:
    """A folder of one commit: rows that replace the buckets *whole*, or changes where it is empty, with their number."""

    version: int
    name: str
    folder: str
    whole: tuple[int, ...]
    buckets: int
    rows: int | None = None


class ChangeLog:
    """The commits of all tables under *path*, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._read: tuple[list[str], list] = ([], [])  # files of the log when it was last read, and its rows

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self, version: int | None = None) -> list[Entry]:
        """Entries up to *version*, oldest first: one row a table and commit."""
        p, fs = self._fs(f"{self.path}/_log")
        if not fs.exists(p):
            return []
        files = sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".parquet"))
        if files != self._read[0]:
            self._read = (files, self.spark.read.schema(_ENTRY).parquet(*[f"{self.path}/_log/{n}" for n in files]).collect())
        rows = self._read[1]
        seen: dict[int, str] = {}
        for r in rows:
            if seen.setdefault(r["version"], r["commit"]) != r["commit"]:
                raise ConcurrentCommit(f"two commits of number {r['version']} under {self.path}")
        if version is not None and version not in {0, *seen}:
            raise ValueError(f"no version {version} under {self.path}")
        found = [Entry(r["version"], r["name"], r["folder"], tuple(r["whole"]), r["buckets"], r["rows"]) for r in rows if version is None or r["version"] <= version]
        return sorted(found, key=lambda e: (e.version, e.name))

    @property
    def version(self) -> int:
        """Number of the newest commit, 0 before the first."""
        return max((e.version for e in self.entries()), default=0)

    def commit(self, staged: Sequence[Entry]) -> int:
        """Make *staged* folders (all of one number) visible at once; returns the number."""
        if not staged:
            return self.version
        commit = uuid.uuid4().hex
        rows = [(e.version, commit, e.name, e.folder, list(e.whole), e.buckets, e.rows) for e in staged]
        fields = ", ".join(_ENTRY.split(", ")[:-1])
        log = self.spark.createDataFrame(rows, fields).withColumn("at", F.current_timestamp())
        log.coalesce(1).write.mode("append").parquet(f"{self.path}/_log")
        self.entries()
        return staged[0].version

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that the newest *keep* versions do not read; returns how many went.  Readers of older versions fail."""
        entries = self.entries()
        kept = sorted({e.version for e in entries})[-max(1, keep) :]
        names = {e.name for e in entries}
        used: set[str] = set()
        for v in kept:
            for n in names:
                base, changes = _layers([e for e in entries if e.version <= v and e.name == n])
                used |= set(base) | set(changes)
        gone = 0
        for folder in sorted({e.folder for e in entries} - used):
            p, fs = self._fs(f"{self.path}/{folder}")
            gone += bool(fs.exists(p) and fs.delete(p, True))
        return gone


def _layers(entries: Sequence[Entry]) -> tuple[dict[str, list[int]], dict[str, tuple[int, list[int]]]]:
    """Folders that make up a table: buckets read of each base, and version and buckets of each later change."""
    base: dict[int, Entry] = {}
    for e in entries:
        base.update(dict.fromkeys(e.whole, e))
    of_base: dict[str, list[int]] = {}
    for b, e in sorted(base.items()):
        of_base.setdefault(e.folder, []).append(b)
    changes = {}
    for e in entries:
        if not e.whole:
            open_ = [b for b in range(e.buckets) if b not in base or base[b].version < e.version]
            if open_:
                changes[e.folder] = (e.version, open_)
    return of_base, changes


@dataclass(frozen=True)
class KeyedTable:
    """The table *name* of a log: columns *ddl*, at most one row per *key*, NULL being a value like any other.

    Of two rows of one key the one of the later commit counts, or the one that is
    greatest in the columns *newest*, NULL least.  A commit holds a key once.
    """

    log: ChangeLog
    name: str
    ddl: str
    key: tuple[str, ...]
    newest: tuple[str, ...] = ()
    buckets: int = 64

    @property
    def columns(self) -> list[str]:
        return schema(self.ddl).names

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.key]), F.lit(self.buckets)).cast("int").alias("__bucket")

    def _entries(self, version: int | None) -> list[Entry]:
        found = [e for e in self.log.entries(version) if e.name == self.name]
        other = {e.buckets for e in found} - {self.buckets}
        if other:
            raise ValueError(f"table {self.name} has {other.pop()} buckets, not {self.buckets}")
        return found

    # -- reading ---------------------------------------------------------------

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table as of *version*, by default the newest; *buckets* limits what is opened."""
        spark = self.log.spark
        entries = self._entries(version)
        base, changes = _layers(entries)

        def part(folder: str, extra: str, of: list[int]) -> DataFrame | None:
            of = of if buckets is None else [b for b in of if b in set(buckets)]
            if not of:
                return None
            rows = spark.read.schema(schema(f"{self.ddl}, {extra}__bucket int")).parquet(f"{self.log.path}/{folder}")
            return (rows if len(of) == self.buckets else rows.where(F.col("__bucket").isin(of))).drop("__bucket")

        bases = [p for f, of in base.items() if (p := part(f, "", of)) is not None]
        later = [p.withColumn("__version", F.lit(v)) for f, (v, of) in changes.items() if (p := part(f, "__gone boolean, ", of)) is not None]
        kept = reduce(DataFrame.unionByName, bases) if bases else empty(spark, self.ddl)
        if not later:
            return kept
        changed = reduce(DataFrame.unionByName, later)
        if self.newest:
            known = kept.withColumn("__gone", F.lit(False)).withColumn("__version", F.lit(0))
            return self._top(known.unionByName(changed), [*self.newest, "__version"])
        # keys of few changes reach the base as one small side, and its rows stay where they are; many changes meet it by merging
        top = self._top(changed, ["__version"], gone=True)
        same = [kept[c].eqNullSafe(F.col(f"k.`{c}`")) for c in self.key]
        known = [e.rows for e in entries if e.folder in changes]
        keys = top.select(*self.key).alias("k")
        keys = keys if None not in known and sum(known) <= _FEW_CHANGES else keys.hint("merge")
        untouched = kept.join(keys, reduce(Column.__and__, same), "left_anti")
        return untouched.unionByName(top.where(~F.col("__gone")).select(*self.columns))

    def _top(self, rows: DataFrame, order: list[str], gone: bool = False) -> DataFrame:
        """Newest row per key, reduced in each partition before the shuffle; tombstones only with *gone*."""
        rest = [c for c in self.columns if c not in self.key]
        body = F.struct(*[F.col(c) for c in rest], "__gone").alias("__body")
        top = rows.select(*self.key, body, F.struct(*[F.col(c) for c in order]).alias("__order"))
        found = top.groupBy(*self.key).agg(F.max_by("__body", "__order").alias("__body"))
        flat = found.select(*self.key, *[F.col(f"__body.`{c}`").alias(c) for c in [*rest, "__gone"]]).select(*self.columns, "__gone")
        return flat if gone else flat.where(~F.col("__gone")).drop("__gone")

    # -- writing ---------------------------------------------------------------

    def stage(self, version: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Entry:
        """Changes written but not yet visible: whole rows that replace, and keys that go."""
        parts = [
            conform(df, self.ddl).withColumn("__gone", F.lit(gone))
            for df, gone in ((upserts, False), (deletes, True))
            if df is not None
        ]
        rows = reduce(DataFrame.unionByName, parts)
        return self._write(rows.withColumn("__bucket", self._bucket()), version, ())

    def _write(self, rows: DataFrame, version: int, whole: Sequence[int]) -> Entry:
        folder = f"{self.name}-{version}-{uuid.uuid4().hex}"
        # sized by what arrives: few files for a small commit, several for a large bucket
        writer = rows.hint("rebalance", "__bucket").write.option("maxRecordsPerFile", _MAX_ROWS_PER_FILE)
        (writer.partitionBy("__bucket") if whole else writer).parquet(f"{self.log.path}/{folder}")
        # counted by the footers of what was written
        n = None if whole else self.log.spark.read.schema("__bucket int").parquet(f"{self.log.path}/{folder}").count()
        return Entry(version, self.name, folder, tuple(whole), self.buckets, n)

    def stage_base(self, version: int, rows: DataFrame, whole: Sequence[int] | None = None) -> Entry:
        """*rows* as all there is in the buckets *whole* (all buckets), not yet visible."""
        rows = conform(rows, self.ddl).withColumn("__bucket", self._bucket())
        return self._write(rows, version, range(self.buckets) if whole is None else whole)

    def append(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        return self.log.commit([self.stage(self.log.version + 1, upserts, deletes)])

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """Rewrite the buckets of *changes* as ``combine(rows there, changes)``, by default the newest row per key."""
        changes = cut_lineage(changes)
        touched = [r[0] for r in changes.select(self._bucket()).distinct().collect()]
        if not touched:
            return self.log.version
        version = self.log.version
        now = self.read(version, touched)
        new = (combine or self._latest)(now, changes)
        return self.log.commit([self.stage_base(version + 1, new, sorted(touched))])

    def _latest(self, now: DataFrame, changes: DataFrame) -> DataFrame:
        old, new = (conform(df, self.ddl).withColumn("__gone", F.lit(False)).withColumn("__version", F.lit(v)) for v, df in enumerate((now, changes)))
        return self._top(old.unionByName(new), [*self.newest, "__version"])

    def compact(self) -> int:
        """All rows of the newest version as a base, without tombstones."""
        version = self.log.version
        return self.log.commit([self.stage_base(version + 1, self.read(version))])


def totals_ddl(key: str, sums: dict[str, str]) -> str:
    """Columns of an aggregate kept by ``add_signed``: *key*, ``n_rows``, and each sum next to how many values it has."""
    return ", ".join([key, "n_rows long", *[f"{c} {t}, {c}_n long" for c, t in sums.items()]])


def add_signed(table: KeyedTable, changes: DataFrame, sums: Sequence[str]) -> int:
    """Refresh a stored aggregate by what was inserted (``sign`` 1) and deleted (-1) in its source.

    *changes* has the table's key, ``sign`` and the columns *sums*.  Buckets
    without a changed key are not read.  A group whose last row goes is gone; a
    sum without values is NULL, as in a full refresh.  Exact for whole numbers
    and decimals.  A deletion of rows that were never there fails the refresh,
    and the stored aggregate stays as it was.
    """
    counts = [f"{c}_n" for c in sums]
    signed = [F.sum("sign").alias("n_rows")]
    for c in sums:
        signed += [F.sum(F.col("sign") * F.col(c)).alias(c), F.sum(F.when(F.col(c).isNotNull(), F.col("sign")).otherwise(0)).alias(f"{c}_n")]
    delta = conform(changes.groupBy(*table.key).agg(*signed), table.ddl)

    def combine(now: DataFrame, new: DataFrame) -> DataFrame:
        both = now.unionByName(new).groupBy(*table.key).agg(*[F.sum(c).alias(c) for c in ["n_rows", *sums, *counts]])
        bad = F.least("n_rows", *counts) < 0 if counts else F.col("n_rows") < 0
        n = F.when(bad, F.raise_error(F.lit("rows were deleted that the aggregate does not hold"))).otherwise(F.col("n_rows"))
        known = [F.when(F.col(f"{c}_n") > 0, F.col(c)).alias(c) for c in sums]
        return both.select(*table.key, n.cast("long").alias("n_rows"), *known, *counts).where(F.col("n_rows") != 0)

    return table.merge(delta, combine)
