"""Plans of the data-plane operators: what reaches the scan, what is shuffled."""

import pytest
from helpers import T, frame
from pyspark.sql import functions as F

from tablewarden.functions import masks as m
from tablewarden.operators import audit, checks
from tablewarden.operators.enforce import MaskFunction, apply_masks
from tablewarden.operators.membership import resolve_who
from tablewarden.operators.rowfilters import filter_by_group
from tablewarden.sources import generate, schemas


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("people") / "p")
    spark.range(1000).select(
        F.col("id"), F.concat(F.lit("u"), F.col("id") % 4).alias("unit"), F.lit("a@b").alias("email"), F.lit("x").alias("other")
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def membership(spark):
    return generate.membership(spark, [("g1", "p"), ("admins", "z")])


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan_and_columns_are_pruned(people, membership):
    who = resolve_who(membership, "p")
    seen = filter_by_group(people, "unit", {"u1": "g1", "u2": "g2"}, who)
    text = plan(apply_masks(seen, {"email": "f"}, {"f": MaskFunction(m.email_keep_domain())}, who).select("id", "email"))
    assert "PushedFilters: [IsNotNull(unit), EqualTo(unit,u1)]" in text or "PushedFilters: [In(unit, [u1])]" in text
    assert "other" not in text
    assert "Exchange" not in text


def test_a_caller_cannot_search_behind_a_constant_mask(people, membership):
    who = resolve_who(membership, "p")
    shown = apply_masks(people, {"email": "f"}, {"f": MaskFunction(m.constant())}, who)
    assert shown.where("email = 'a@b'").isEmpty()


def test_counts_are_taken_before_members_are_joined(people, spark, membership):
    mapping = spark.createDataFrame([("u1", "g1")], "value string, group_name string")
    text = plan(checks.visible_counts(people, "unit", mapping, membership))
    assert "partial_count" in text
    assert text.rindex("partial_count") > text.index("Join")


def test_latest_rows_are_limited_before_the_shuffle(spark):
    ddl = f"{schemas._KEY}, object_type string, masked_column string, attempt_id string, completed_at timestamp"
    log = frame(spark, [(*T, "ROW_FILTER", None, "1", None)], ddl)
    text = plan(audit.latest_per_object(log))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_sample_limits_units_before_the_shuffle(people, spark, membership):
    mapping = spark.createDataFrame([("u1", "g1")], "value string, group_name string")
    text = plan(checks.sample_per_principal(people, "unit", "id", mapping, membership))
    assert text.count("WindowGroupLimit") >= 4
    assert "TakeOrderedAndProject" in plan(checks.sample(people, "id"))


def test_parity_needs_one_shuffle(people):
    text = plan(checks.parity_difference(people, people.where("id > 5")))
    assert text.count("Exchange hashpartitioning") == 1


def test_a_table_partitioned_by_the_filter_column_is_pruned(spark, people, membership, tmp_path):
    people.write.partitionBy("unit").parquet(f"{tmp_path}/by_unit")
    df = spark.read.parquet(f"{tmp_path}/by_unit")
    text = plan(filter_by_group(df, "unit", {"u1": "g1"}, resolve_who(membership, "p")))
    assert "PartitionFilters: [isnotnull(unit" in text or "PartitionFilters: [(unit" in text or "PartitionFilters: [unit" in text


def test_scope_reaches_the_scans_of_tags_and_policies(spark, tmp_path):
    from helpers import options, state

    from tablewarden.plans.run import planned_objects, resolved_tags, verify

    t1, t2 = ("c1", "s", "t"), ("c2", "s", "t")
    s = state(spark, tables=[(*t, "MANAGED", None) for t in (t1, t2)], filters=[(t, "c.s.f", ["region"]) for t in (t1, t2)],
              policies=[(f"CATALOG `{c}`", "p", "ROW_FILTER", "c.s.f", [], [], None, [], [], "") for c in ("c1", "c2", "c3")],
              tags=[(t, "region", "k", None) for t in (t1, t2)])
    for name in ("policies", "column_tags"):
        getattr(s, name).write.parquet(f"{tmp_path}/{name}")
    from dataclasses import replace

    s = replace(s, policies=spark.read.parquet(f"{tmp_path}/policies"), column_tags=spark.read.parquet(f"{tmp_path}/column_tags"))
    o = options(tmp_path, scope_type="SELECTED_CATALOGS", catalogs=("c1",))
    planned = planned_objects(s.tables, s, o)
    assert [r.catalog for r in planned.collect()] == ["c1"]
    for df in (planned, verify(s.tables, s, o)):
        scans = [x for x in plan(df).splitlines() if "on_securable" in x and "FileScan" in x]
        assert scans and all("StringStartsWith(on_securable" in x for x in scans)
    assert "EqualTo(catalog,c1)" in plan(resolved_tags(planned, s, o))


def test_named_tables_reach_the_scan_of_policies(spark, tmp_path):
    from dataclasses import replace

    from helpers import options, state

    from tablewarden.plans.run import policies_in_scope

    on = ["TABLE `c`.`s`.`t`", "TABLE `c`.`s`.`u`", "SCHEMA `c`.`s`", "SCHEMA `c`.`z`", "CATALOG `c`", "CATALOG `d`"]
    s = state(spark, policies=[(o, "p", "ROW_FILTER", "f", [], [], None, [], [], "") for o in on])
    s.policies.write.parquet(f"{tmp_path}/policies")
    s = replace(s, policies=spark.read.parquet(f"{tmp_path}/policies"))
    few = policies_in_scope(s, options(tmp_path, scope_type="SPECIFIC_TABLES", tables=("c.s.t",)))
    many = policies_in_scope(s, options(tmp_path, scope_type="SPECIFIC_TABLES", tables=("c.s.t", *(f"c.s.n{i}" for i in range(400)))))
    want = ["CATALOG `c`", "SCHEMA `c`.`s`", "TABLE `c`.`s`.`t`"]
    assert sorted(r.on_securable for r in few.collect()) == sorted(r.on_securable for r in many.collect()) == want
    assert "In(on_securable" in plan(few) and few.columns == many.columns == s.policies.columns
