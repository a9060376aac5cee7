"""Parity by buckets, classes of principals, groups within groups, and undo across runs, against plain versions."""

import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

from helpers import T, options, rows, state
from pyspark.sql import functions as F

from tablewarden.functions.labels import VOCABULARY, category
from tablewarden.operators import checks, rollback
from tablewarden.operators.membership import nested_membership
from tablewarden.plans.run import run
from tablewarden.sources import schemas
from tablewarden.sources.store import read_table


def test_buckets_tell_what_a_full_comparison_tells(spark):
    rng = random.Random(5)
    ddl = "a int, b string, c array<string>, d struct<x:double,y:timestamp>"

    def row():
        pick = lambda *v: rng.choice(v)
        return pick(1, 2, None), pick("1", "", None), pick(None, [], [None, "a"], ["a", None], ["null", "a"]), pick(None, (None, None), (0.5, None))

    before = [row() for _ in range(300)]
    for after in (before, [], before[1:] + before[:1], before + before[:40], before[5:] + [row() for _ in range(9)]):
        a, b = spark.createDataFrame(before, ddl), spark.createDataFrame(after, ddl) if after else spark.createDataFrame([], ddl)
        got = Counter()
        for r in checks.parity_by_buckets(a, b, 7).collect():
            got[str(r[:4])] = r.n_extra
        want = Counter({str(tuple(r)): n for r, n in [(r, 0) for r in a.collect()]})
        for frame, sign in ((a, -1), (b, 1)):
            for r in frame.collect():
                want[str(tuple(r))] += sign
        assert got == {k: n for k, n in want.items() if n}


def test_places_of_nulls_are_compared(spark):
    a = spark.createDataFrame([(None, "x")], "a string, b string")
    b = spark.createDataFrame([("x", None)], "a string, b string")
    assert checks.parity_by_buckets(a, b).count() == 2 and checks.parity_by_buckets(a, a).isEmpty()


def test_equal_frames_shuffle_a_row_per_bucket(spark, tmp_path):
    spark.range(20000).select("id", (F.col("id") % 7).alias("v")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    found = checks.parity_by_buckets(df, df, 16)
    assert found.isEmpty()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "partial_sum" in text and "CartesianProduct" not in text


def test_classes_hold_all_that_principals_see(spark):
    rng = random.Random(2)
    members = {(rng.choice(["g1", "g2", "g3", "g4", "idle", "admins"]), f"p{i % 30}") for i in range(70)}
    membership = spark.createDataFrame(sorted(members), "group_name string, member_email string")
    mapping = spark.createDataFrame([("u1", "g1"), ("u2", "g2"), ("u3", "g3"), ("u3", "g4"), ("gone", "g4"), (None, "g1")], "value string, group_name string")
    data = spark.createDataFrame([("u1",)] * 5 + [("u2",)] * 3 + [("u3",)] + [(None,)] * 2 + [("unmapped",)], "unit string")
    counts = checks.visible_counts(data, "unit", mapping, membership)
    classes = checks.principal_classes(data, mapping, membership)
    by_class = checks.class_counts(data, "unit", mapping, membership, classes)
    expanded = classes.join(by_class, "class_id").select("principal", "unit", "n_rows")
    assert rows(expanded, "principal", "unit", "n_rows") == rows(counts, "principal", "unit", "n_rows")
    sights = defaultdict(set)
    for r in counts.collect():
        sights[r.principal].add(r.unit)
    told = {r.principal: r for r in classes.collect()}
    admins = {m for g, m in members if g == "admins"}
    for p, q in ((p, q) for p in sights for q in sights):
        same = (p in admins) == (q in admins) and sights[p] == sights[q]
        assert (told[p].class_id == told[q].class_id) == same
    assert {p for p, r in told.items() if r.sees_all} == admins
    one = {r.principal: (r.n_units, r.n_shared_units, r.isolated) for r in checks.isolation_verdict(counts, membership).collect()}
    grouped = {r.class_id: (r.n_units, r.n_shared_units, r.isolated) for r in checks.class_isolation(by_class, classes).collect()}
    assert {p: grouped[told[p].class_id] for p in one} == one


def test_groups_within_groups(spark):
    rng = random.Random(3)
    inside = [(f"g{rng.randrange(12)}", f"g{rng.randrange(12)}") for _ in range(14)] + [("g1", "g1"), (None, "g1"), ("g2", None)]
    members = [(f"g{i % 12}", f"p{i}") for i in range(15)] + [("g3", None), ("g0", "p0")]
    below = defaultdict(set)
    for g, m in inside:
        below[g].add(m)

    def closure(g):
        seen, todo = {g}, [g]
        while todo:
            for m in below[todo.pop()] - {None} - seen:
                seen.add(m)
                todo.append(m)
        return seen

    want = {(f"g{i}", p) for i in range(12) for g, p in members if p and g in closure(f"g{i}")}
    got = nested_membership(
        spark.createDataFrame(members, "group_name string, member_email string"), spark.createDataFrame(inside, "group_name string, member_group string")
    )
    assert sorted(tuple(r) for r in got.select("group_name", "member_email").collect()) == sorted(want)


def two_runs(spark, tmp_path):
    """The same mask moved twice: undone by hand between the runs, to another function."""
    first = run(state(spark, masks=[(T, "a", "cat.sch.old"), (T, "b", "cat.sch.old")], functions=[("cat.sch.old", True), ("cat.sch.new", True)]), options(tmp_path, run_id="one")).state
    given = spark.createDataFrame([(*T, "a", "cat.sch.new", "", 0)], schemas.schema(schemas.MASKS))
    kept = first.policies.where("policy_name <> 'abac_migrated_mask_a'")
    return run(replace(first, masks=given, policies=kept), options(tmp_path, run_id="two")).state


def test_an_older_run_does_not_overwrite_a_newer_one(spark, tmp_path):
    s = two_runs(spark, tmp_path)
    assert s.masks.isEmpty()
    refused = run(s, options(tmp_path, "ROLLBACK", run_id="one"))
    assert rows(refused.steps, "slot", "status", "error_code") == [("a", "FAILED", rollback.LATER_RUN), ("b", "ROLLED_BACK", None)]
    assert rows(refused.state.masks, "column", "function_fqn") == [("b", "cat.sch.old")]
    assert "abac_migrated_mask_a" in {r[0] for r in refused.state.policies.select("policy_name").collect()}
    # the newer run first, then the rest of the older one
    newer = run(refused.state, options(tmp_path, "ROLLBACK", run_id="two"))
    assert rows(newer.state.masks, "column", "function_fqn") == [("a", "cat.sch.new"), ("b", "cat.sch.old")]
    older = run(newer.state, options(tmp_path, "ROLLBACK", run_id="one"))
    assert rows(older.state.masks, "column", "function_fqn") == [("a", "cat.sch.old"), ("b", "cat.sch.old")]


def test_cascade_undoes_later_runs_first(spark, tmp_path):
    s = two_runs(spark, tmp_path)
    log = read_table(spark, f"{tmp_path}/audit", schemas.AUDIT)
    assert [r.run_id for r in rollback.undo_order(log, "one").orderBy("position").collect()] == ["two", "one"]
    assert [r.run_id for r in rollback.undo_order(log, "two").collect()] == ["two"]
    would = run(s, options(tmp_path, "ROLLBACK", run_id="one", later_runs="CASCADE", dry_run=True))
    assert {r.status for r in would.steps.collect()} == {"WOULD_ROLLBACK"}
    back = run(s, options(tmp_path, "ROLLBACK", run_id="one", later_runs="CASCADE"))
    assert rows(back.steps, "slot", "status") == [("a", "ROLLED_BACK"), ("a", "ROLLED_BACK"), ("b", "ROLLED_BACK")]
    assert rows(back.state.masks, "column", "function_fqn") == [("a", "cat.sch.old"), ("b", "cat.sch.old")]
    assert back.state.policies.isEmpty()


def test_categories_by_votes(spark):
    """Against a plain count of votes, with a word that speaks for two categories."""
    vocabulary = {**VOCABULARY, "other_mail": ("inbox", "parcel")}
    cases = [("c.s.mask_email", ["phone", "mobilePhone"]), ("c.s.f", ["inbox", "parcel_x"]), ("c.s.f", ["inbox"]), ("c.s.mask_ssn", []), (None, None),
             ("c.s.x", [None, "card-pan"]), ("mail", None), ("c.s.salary", ["Region", "bonus"])]

    def parts(name):
        return {p for p in re.split("[^a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", name or "").lower()) if p}

    def plain(fqn, columns):
        votes = {c: 2 * sum(bool(parts(n) & set(w)) for n in columns or []) + bool(parts((fqn or "").split(".")[-1]) & set(w)) for c, w in vocabulary.items()}
        best = max(votes.values())
        return next(c for c, v in votes.items() if v == best) if best else "other"

    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, fn string, cols array<string>")
    got = [r[1] for r in df.select("i", category("fn", "cols", vocabulary)).orderBy("i").collect()]
    assert got == [plain(*c) for c in cases]


def test_names_are_cleaned_as_by_the_pattern(spark):
    from tablewarden.functions.names import sanitize

    texts = ["", "-", "--", "a-b.c", "é😀x", "a`b\\$1", "tab\tnl\n", "ß_Z9", "\x00a", "日本語.x", "[^]-\\", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(sanitize("t").alias("got"), F.regexp_replace("t", "[^a-zA-Z0-9_]", "_").alias("want"))
    assert df.where("NOT (got <=> want)").isEmpty()
    assert "regexp_replace" not in plan_of(df.select("got"))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_reads_matches_once(spark):
    from tablewarden.operators.verify import covered_objects

    policies = schemas.empty(spark, schemas.POLICIES)
    tags = schemas.empty(spark, schemas.COLUMN_TAGS)
    assert covered_objects(policies, tags)._jdf.queryExecution().analyzed().toString().count("Join ") == 3


def test_nested_groups_are_not_broadcast(spark):
    members = spark.createDataFrame([("a", "x"), ("b", "y")], "group_name string, member_email string")
    inside = spark.createDataFrame([("a", "b")], "group_name string, member_group string")
    plan = nested_membership(members, inside)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
