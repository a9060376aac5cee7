"""Keyed tables that take changes, and what is built on them: stored state, latest audit rows, totals, rules by version."""

import datetime as dt
import os
import random
from pathlib import Path

import pytest
from helpers import frame, options, policy, rows, state

from tablewarden.functions import masks as m
from tablewarden.operators import audit
from tablewarden.operators.enforce import MaskFunction
from tablewarden.operators.rowfilters import public_or_group_rule
from tablewarden.plans.run import load_state, run, stored_state
from tablewarden.plans.stored import Changes, StateStore
from tablewarden.sources import schemas
from tablewarden.sources.deltas import ChangeLog, ConcurrentCommit, KeyedTable, add_signed, totals_ddl
from tablewarden.streaming.secured import read_files
from tablewarden.streaming.versioned import write_by_version

DDL = "k string, part long, v string"


def table(spark, path, **kw):
    return KeyedTable(ChangeLog(spark, str(path)), "t", DDL, ("k", "part"), **{"buckets": 4, **kw})


def contents(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def size(folder) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_any_order_of_commits_equals_a_dictionary(spark, tmp_path):
    """Random appends, merges and compactions with NULL keys: every version reads as the dictionary did then."""
    rng, t = random.Random(3), table(spark, tmp_path)
    now: dict[tuple, str] = {}
    history = {0: {}}
    for i in range(14):
        keys = [(rng.choice(["a", "b", None, "c"]), rng.choice([1, 2, None])) for _ in range(rng.randint(0, 5))]
        new = {k: f"{i}" if rng.random() < 0.8 else None for k in keys}
        up = spark.createDataFrame([(*k, v) for k, v in new.items()], DDL)
        kind = rng.choice(["append", "append", "merge", "compact"])
        if kind == "compact":
            t.compact()
        elif kind == "merge":
            t.merge(up)
            now.update(new)
        else:
            gone = [k for k in now if k not in new and rng.random() < 0.3]
            t.append(up, spark.createDataFrame(gone, "k string, part long"))
            now = {k: v for k, v in now.items() if k not in gone} | new
        history[t.log.version] = dict(now)
    assert len(history) > 8
    for version, want in history.items():
        assert contents(t.read(version)) == sorted(((*k, v) for k, v in want.items()), key=str), version
    some = [c for b in range(4) for c in contents(t.read(buckets=[b]))]
    assert sorted(some, key=str) == contents(t.read())


def test_newest_by_columns_wins_whatever_comes_last(spark, tmp_path):
    t = table(spark, tmp_path, newest=("v",))
    make = lambda *r: spark.createDataFrame(list(r), DDL)
    t.append(make(("a", 1, "5"), ("b", 1, None)))
    t.append(make(("a", 1, "4"), ("b", 1, "0")))
    assert contents(t.read()) == [("a", 1, "5"), ("b", 1, "0")]
    t.merge(make(("a", 1, "6"), ("b", 1, None)))
    assert contents(t.read()) == [("a", 1, "6"), ("b", 1, "0")]


def test_many_changes_meet_the_base_without_the_driver(spark, tmp_path):
    """Rows that compress well look small by their files; they are not broadcast for that, few changes may be."""
    t = table(spark, tmp_path)
    rows_ = spark.range(150_000).selectExpr("cast(id % 3 AS string) AS k", "id AS part", "'old' AS v")
    t.merge(rows_)
    t.append(rows_.where("part < 5").withColumn("v", rows_["k"]))
    plan = lambda version: t.read(version)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(2)
    t.append(deletes=rows_.where("part > 4"))
    assert "Broadcast" not in plan(3) and "SortMergeJoin" in plan(3)
    assert contents(t.read()) == sorted((str(i % 3), i, str(i % 3)) for i in range(5))


def test_a_merge_reads_and_writes_only_touched_buckets(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    t.merge(spark.range(500).selectExpr("cast(id AS string) AS k", "id AS part", "'old' AS v"))
    t.merge(spark.createDataFrame([("7", 7, "new")], DDL))
    last = t.log.entries()[-1]
    assert len(last.whole) == 1
    plan = t.read(1, list(last.whole))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan or "PartitionFilters: [__bucket" in plan or "PartitionFilters: [(__bucket" in plan
    assert len(os.listdir(f"{tmp_path}/{last.folder}")) <= 4  # one bucket, the mark of success and its checksum
    assert t.read().where("v = 'new'").count() == 1 and t.read().count() == 500


def test_broken_off_commits_are_never_seen(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(spark.createDataFrame([("a", 1, "x")], DDL))
    t.stage(2, spark.createDataFrame([("a", 1, "lost")], DDL))  # written, never committed
    assert contents(t.read()) == [("a", 1, "x")]
    t.append(spark.createDataFrame([("b", 1, "y")], DDL))
    assert contents(t.read()) == [("a", 1, "x"), ("b", 1, "y")]


def test_two_writers_are_found(spark, tmp_path):
    t = table(spark, tmp_path)
    a, b = (t.stage(1, spark.createDataFrame([("a", 1, v)], DDL)) for v in "xy")
    t.log.commit([a])
    with pytest.raises(ConcurrentCommit):
        t.log.commit([b])
    with pytest.raises(ConcurrentCommit):
        t.read()


def test_vacuum_keeps_what_is_read(spark, tmp_path):
    t = table(spark, tmp_path)
    for i in range(3):
        t.append(spark.createDataFrame([("a", i, f"{i}")], DDL))
    t.compact()
    t.append(spark.createDataFrame([("a", 9, "9")], DDL))
    want = contents(t.read())
    assert t.log.vacuum(keep=2) == 3
    assert contents(t.read()) == want and t.read(4).count() == 3
    assert t.log.vacuum(keep=2) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        t.read(2).count()
    with pytest.raises(ValueError, match="no version 8"):
        t.read(8)
    with pytest.raises(ValueError, match="buckets"):
        table(spark, tmp_path, buckets=5).read()


def test_empty_table_and_empty_changes(spark, tmp_path):
    t = table(spark, tmp_path)
    none = spark.createDataFrame([], DDL)
    assert t.read().count() == 0 and t.merge(none) == 0
    t.append(none, none)
    assert t.read().count() == 0 and t.compact() == 2 and t.read().count() == 0


# -- state -------------------------------------------------------------------------


def estate(spark, n):
    names = [("cat", "sch", f"t{i}") for i in range(n)]
    return state(
        spark,
        tables=[(*t, "MANAGED", None) for t in names],
        filters=[(t, "cat.sch.rf", ["region"]) for t in names],
        masks=[(t, "email", "cat.sch.mk") for t in names],
    )


FIELDS = {
    "row_filters": ("table", "function_fqn"),
    "masks": ("table", "column", "function_fqn"),
    "policies": ("on_securable", "policy_name", "policy_type", "function_fqn", "match_columns"),
    "column_tags": ("table", "column", "tag_key", "tag_value"),
    "governed_tags": ("tag_key", "description"),
    "coverage": ("table", "object_type", "slot", "on_securable", "policy_name", "run_id"),
}


def frames_of(s):
    return {n: rows(getattr(s, n), *c) for n, c in FIELDS.items() if getattr(s, n) is not None}


@pytest.mark.parametrize("scope", ["TABLE", "CATALOG"])
def test_stored_runs_equal_runs_in_memory(spark, tmp_path, scope):
    """Migrate, finalize, undo: after each step both hold the same rows."""
    kept = StateStore(spark, f"{tmp_path}/state", buckets=2)
    plain, stored = estate(spark, 3), stored_state(estate(spark, 3), kept)
    for mode, run_id in (("APPLY_ABAC", "a"), ("FINALIZE", "f"), ("ROLLBACK", "f"), ("ROLLBACK", "a")):
        plain, stored = (
            run(s, options(tmp_path / kind, mode, run_id=run_id, policy_scope=scope)).state for s, kind in ((plain, "p"), (stored, "s"))
        )
        assert frames_of(stored) == frames_of(plain), (mode, run_id)
    assert frames_of(stored)["row_filters"] == frames_of(estate(spark, 3))["row_filters"]
    before = frames_of(stored)
    kept.compact()
    assert kept.vacuum() > 0 and frames_of(load_state(kept)) == before


def test_bytes_follow_the_run(spark, tmp_path):
    """A run over one table of many writes as much as one over one table of few."""
    written = {}
    for n in (4, 400):
        kept = StateStore(spark, f"{tmp_path}/{n}/state", buckets=2)
        s = stored_state(estate(spark, n), kept)
        run(s, options(tmp_path / str(n), run_id="one", scope_type="SPECIFIC_TABLES", tables=("cat.sch.t1",)))
        folders = [e.folder for e in kept.log.entries() if e.version == 2]
        written[n] = sum(size(f"{tmp_path}/{n}/state/{f}") for f in folders)
        assert kept.read("row_filters").count() == n - 1
        assert kept.frames["policies"].read(1).count() == 0  # the state before the run can still be read
    assert written[400] < 1.1 * written[4]


def test_a_stale_state_is_refused(spark, tmp_path):
    kept = StateStore(spark, f"{tmp_path}/state", buckets=2)
    s = stored_state(estate(spark, 1), kept)
    run(s, options(tmp_path, run_id="first"))
    with pytest.raises(ConcurrentCommit):
        run(s, options(tmp_path, run_id="second"))
    assert kept.version == 2


def test_a_dry_run_commits_nothing(spark, tmp_path):
    kept = StateStore(spark, f"{tmp_path}/state", buckets=2)
    run(stored_state(estate(spark, 1), kept), options(tmp_path, dry_run=True))
    assert kept.version == 1


# -- audit, totals, streams --------------------------------------------------------


def test_latest_rows_kept_up_equal_the_window(spark, tmp_path):
    rng = random.Random(5)
    at = [None, *[dt.datetime(2024, 1, d) for d in (1, 2, 3)]]
    log = [
        (f"r{i % 4}", f"{rng.random():.6f}", "c", "s", f"t{rng.randint(0, 5)}", "COLUMN_MASK", rng.choice(["x", None]), rng.choice(at))
        for i in range(120)
    ]
    names = "run_id string, attempt_id string, catalog string, schema string, table string, object_type string, masked_column string, completed_at timestamp"
    whole = schemas.conform(spark.createDataFrame(log, names), schemas.AUDIT)
    for key, name, want in ((audit.OBJECT_KEY, "o", audit.latest_per_object(whole)), (audit.KEY, "t", audit.latest_per_table(whole))):
        latest = audit.kept_latest(ChangeLog(spark, f"{tmp_path}/{name}"), key=tuple(key), buckets=4)
        for r in ("r2", "r0", "r3", "r1", "r0"):
            audit.keep_latest(latest, whole.where(f"run_id = '{r}'"))
        assert contents(latest.read()) == contents(want)


def test_incremental_totals_equal_a_full_refresh(spark, tmp_path):
    rng, there = random.Random(7), []
    t = KeyedTable(ChangeLog(spark, str(tmp_path)), "sums", totals_ddl("k string", {"v": "decimal(38,2)"}), ("k",), buckets=4)
    ddl = "k string, v decimal(10,2), sign int"
    from decimal import Decimal

    for _ in range(6):
        new = [(rng.choice(["a", "b", "c", None]), rng.choice([None, Decimal(rng.randint(-500, 500)) / 100])) for _ in range(8)]
        gone = rng.sample(there, len(there) // 2)
        for g in gone:
            there.remove(g)
        there += new
        add_signed(t, spark.createDataFrame([(*r, 1) for r in new] + [(*r, -1) for r in gone], ddl), ["v"])
        full = spark.createDataFrame(there, "k string, v decimal(10,2)").selectExpr("k", "cast(v AS decimal(38,2)) AS v")
        want = full.groupBy("k").agg({"*": "count", "v": "sum"}).selectExpr("k", "`count(1)`", "cast(`sum(v)` AS decimal(38,2))")
        assert contents(t.read().select("k", "n_rows", "v")) == contents(want)
    version, before = t.log.version, contents(t.read())
    add_signed(t, spark.createDataFrame([(*r, -1) for r in there], ddl), ["v"])
    assert t.read().count() == 0
    with pytest.raises(Exception, match="does not hold"):
        add_signed(t, spark.createDataFrame([("a", None, -1)], ddl), ["v"])
    assert t.log.version == version + 1 and contents(t.read(version)) == before


def test_rules_follow_the_stream(spark, tmp_path):
    """A member leaves, then a policy cannot be understood: each batch goes by the rules of its time, or fails."""
    key, ddl = ("cat", "sch", "tbl"), "id long, region string, email string"
    kept = StateStore(spark, f"{tmp_path}/state", buckets=2)
    kept.save({
        "membership": frame(spark, [("g", "ann"), ("g", "bob")], schemas.MEMBERSHIP),
        "row_filters": frame(spark, [(*key, "rf", ["region"], "")], schemas.ROW_FILTERS),
        "column_tags": frame(spark, [], schemas.COLUMN_TAGS),
    })
    functions = {"rf": public_or_group_rule(["east"], "g"), "mk": MaskFunction(m.constant("***"))}

    def arrive(first):
        new = [(first, "east", "a@x"), (first + 1, "west", "b@x")]
        spark.createDataFrame(new, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = read_files(spark, f"{tmp_path}/in", schemas.schema(ddl))
        write_by_version(stream, key, kept, functions, "ann", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()

    arrive(1)
    kept.append({"membership": Changes(deletes=frame(spark, [("g", "ann")], schemas.MEMBERSHIP)),
                 "masks": Changes(frame(spark, [(*key, "email", "mk", "", 1)], schemas.MASKS))})
    arrive(3)
    out = lambda: contents(spark.read.parquet(f"{tmp_path}/out").select("id", "email", "rules_version"))
    assert out() == [(1, "a@x", 1), (2, "b@x", 1), (3, "***", 2)]
    lost = policy("TABLE `cat`.`sch`.`tbl`", "p", "COLUMN_MASK", "mk")
    kept.append({"policies": Changes(frame(spark, [(*lost, None, "unknown label")], f"{schemas.POLICIES}, {schemas.LISTED}"))})
    with pytest.raises(Exception, match="unknown label"):
        arrive(5)
    assert out() == [(1, "a@x", 1), (2, "b@x", 1), (3, "***", 2)]
    # the refused batch comes again, whole, once the rules are clear
    kept.append({"policies": Changes(deletes=frame(spark, [lost], schemas.POLICIES))})
    spark_in = read_files(spark, f"{tmp_path}/in", schemas.schema(ddl))
    write_by_version(spark_in, key, kept, functions, "ann", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert out() == [(1, "a@x", 1), (2, "b@x", 1), (3, "***", 2), (5, "***", 4)]
