"""Governance state as keyed tables that take each run's changes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from tablewarden.functions.names import KEY
from tablewarden.operators.enforce import Registry, SecurityState
from tablewarden.sources import schemas
from tablewarden.sources.deltas import ChangeLog, ConcurrentCommit, KeyedTable

# frame: its columns and its key
FRAMES: dict[str, tuple[str, tuple[str, ...]]] = {
    "tables": (schemas.TABLES, tuple(KEY)),
    "row_filters": (schemas.ROW_FILTERS, tuple(KEY)),
    "masks": (schemas.MASKS, (*KEY, "column")),
    "policies": (f"{schemas.POLICIES}, {schemas.LISTED}", ("on_securable", "policy_name")),
    "column_tags": (schemas.COLUMN_TAGS, (*KEY, "column", "tag_key")),
    "governed_tags": (schemas.GOVERNED_TAGS, ("tag_key",)),
    "functions": (schemas.FUNCTIONS, ("function_fqn",)),
    "grant_rules": (schemas.GRANT_RULES, ("tag_key", "role", "principals")),
    "coverage": (schemas.COVERAGE, (*KEY, "object_type", "slot")),
    "membership": (schemas.MEMBERSHIP, ("group_name", "member_email")),
}


@dataclass(frozen=True)
class Changes:
    """Whole rows that replace those of their keys, and rows whose keys go."""

    upserts: DataFrame | None = None
    deletes: DataFrame | None = None


class StateStore:
    """State under *path*, a folder that all executors share; a run writes its changes there in one commit.

    Bytes written follow the run, not the estate.  Readers name a version or take
    the newest.  ``compact`` folds changes in from time to time, ``vacuum``
    removes what the newest versions do not read.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.log = ChangeLog(spark, path)
        self.frames = {n: KeyedTable(self.log, n, ddl, key, buckets=buckets) for n, (ddl, key) in FRAMES.items()}

    @property
    def version(self) -> int:
        return self.log.version

    def save(self, frames: dict[str, DataFrame]) -> int:
        """*frames* whole, in place of what is there under their names."""
        version = self.version + 1
        return self.log.commit([self.frames[n].stage_base(version, df) for n, df in frames.items()])

    def append(self, changes: dict[str, Changes], after: int | None = None) -> int:
        """One commit of changes to several frames: all are seen, or none.  They build on version *after*, which must be the newest."""
        version = self.version
        if after not in (None, version):
            raise ConcurrentCommit(f"changes build on version {after}, the newest is {version}")
        staged = [self.frames[n].stage(version + 1, c.upserts, c.deletes) for n, c in changes.items()]
        return self.log.commit(staged)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.frames[name].read(version)

    def known(self, version: int | None = None) -> set[str]:
        """Frames that were ever written."""
        return {e.name for e in self.log.entries(version)}

    def security(self, functions: Registry, version: int | None = None, **more) -> SecurityState:
        """What readers go by, as of one version."""
        known = self.known(version)
        rules = {f.name: self.read(f.name, version) for f in fields(SecurityState) if f.name in FRAMES and f.name in known}
        if "membership" not in rules:
            raise ValueError("the store holds no membership")
        return SecurityState(functions=functions, **rules, **more)

    def compact(self) -> int:
        """Every frame without history, in one commit."""
        version = self.version
        return self.log.commit([self.frames[n].stage_base(version + 1, self.read(n, version)) for n in sorted(self.known())])

    def vacuum(self, keep: int = 1) -> int:
        return self.log.vacuum(keep)
