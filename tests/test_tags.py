import pytest
from helpers import T, frame, rows, state
from pyspark.sql import functions as F

from tablewarden.functions import names
from tablewarden.operators import tags
from tablewarden.sources import schemas

REQUEST = f"{schemas._KEY}, column string, role string, function_fqn string, tag_key string"
RF = "cat.sch.rf"
KEY_OF_RF = "abac_rls_cat_sch_rf"


def resolve(spark, requests, tag_rows=(), governed=(), **kw):
    asked = frame(spark, [(*t, c, role, fn, key) for t, c, role, fn, key in requests], REQUEST)
    s = state(spark, tags=tag_rows, governed=governed)
    found = tags.resolve_tags(asked, s.column_tags, s.governed_tags, **kw)
    return {(r.table, r.column, r.role): (r.resolution, r.tag_key, r.tag_value) for r in found.collect()}


def one(column="region", role="row_filter", fn=RF, key=KEY_OF_RF):
    return (T, column, role, fn, key)


ME = ("tbl", "region", "row_filter")


@pytest.mark.parametrize(
    ("fqn", "role", "team", "key"),
    [
        ("jh-demo.some_schema.rf", "row_filter", "", "abac_rls_jh_demo_some_schema_rf"),
        ("`jh-demo`.`s`.`rf`", "row_filter", "mobility", "abac_rls_mobility_jh_demo_s_rf"),
        ("c.s.mask ssn", "mask", "", "abac_colmask_c_s_mask_ssn"),
        ("c.fn", "mask", "", "abac_colmask_c_fn"),
        ("fn", "row_filter", "", "abac_rls_fn"),
        ("c.s.x.y.fn", "row_filter", "", "abac_rls_c_s_fn"),
        ("c..fn", "row_filter", "", "abac_rls_c_fn"),
        (".s.fn", "row_filter", "", "abac_rls_s_fn"),
        ("c.s." + "f" * 300, "mask", "", "abac_colmask_" + ("c_s_" + "f" * 300)[:180]),
    ],
)
def test_tag_key(spark, fqn, role, team, key):
    assert spark.range(1).select(names.tag_key(F.lit(fqn), role, team).alias("k")).first().k == key


def test_mints_a_key_only_tag(spark):
    assert resolve(spark, [one()]) == {ME: ("MINTED", KEY_OF_RF, None)}


def test_reuses_a_governed_tag(spark):
    got = resolve(spark, [one()], [(T, "region", "geo", "high")], [("geo", ["high", "low"], "")])
    assert got == {ME: ("REUSED", "geo", "high")}


@pytest.mark.parametrize(
    ("tag_rows", "governed"),
    [
        ([(T, "region", "geo", "high")], []),
        ([(T, "region", "geo", "odd")], [("geo", ["high"], "")]),
        ([(T, "region", "geo", None)], [("geo", ["high"], "")]),
        ([(T, "region", "geo", "high"), (T, "other", "geo", "high")], [("geo", ["high"], "")]),
        ([(T, "region", "geo", None), (T, "other", "geo", None)], [("geo", [], "")]),
        ([(T, "other", "geo", "high")], [("geo", ["high"], "")]),
    ],
    ids=["not governed", "value not allowed", "value missing", "value on another column", "key on another column", "other column only"],
)
def test_does_not_reuse(spark, tag_rows, governed):
    assert resolve(spark, [one()], tag_rows, governed) == {ME: ("MINTED", KEY_OF_RF, None)}


def test_same_key_with_another_value_elsewhere_is_no_clash(spark):
    rows_ = [(T, "region", "geo", "high"), (T, "other", "geo", "low")]
    assert resolve(spark, [one()], rows_, [("geo", ["high", "low"], "")]) == {ME: ("REUSED", "geo", "high")}


def test_first_reusable_tag_by_key_and_value(spark):
    rows_ = [(T, "region", "zone", None), (T, "region", "area", "b"), (T, "region", "area2", "a")]
    assert resolve(spark, [one()], rows_, [("zone", [], ""), ("area", ["b"], ""), ("area2", [], "")]) == {ME: ("REUSED", "area", "b")}


def test_other_role_tag_is_reused_unless_told_not_to(spark):
    rows_ = [(T, "region", "abac_colmask_x", None)]
    governed = [("abac_colmask_x", [], "")]
    assert resolve(spark, [one()], rows_, governed) == {ME: ("REUSED", "abac_colmask_x", None)}
    assert resolve(spark, [one()], rows_, governed, same_role_only=True) == {ME: ("MINTED", KEY_OF_RF, None)}


def test_reuse_can_be_switched_off(spark):
    got = resolve(spark, [one()], [(T, "region", "geo", None)], [("geo", [], "")], prefer_existing=False)
    assert got == {ME: ("MINTED", KEY_OF_RF, None)}


def test_rerun_without_reuse_is_not_a_collision_with_itself(spark):
    own = [(KEY_OF_RF, [], tags.DESCRIPTION + RF)]
    got = resolve(spark, [one()], [(T, "region", KEY_OF_RF, None)], own, prefer_existing=False)
    assert got == {ME: ("MINTED", KEY_OF_RF, None)}


def test_filter_key_already_on_another_column_is_skipped(spark):
    got = resolve(spark, [one()], [(T, "other", KEY_OF_RF, None)], [(KEY_OF_RF, [], tags.DESCRIPTION + RF)])
    assert got == {ME: ("SKIPPED", KEY_OF_RF, None)}


def test_two_filter_columns_are_skipped_but_two_masks_share(spark):
    got = resolve(spark, [one(), one("unit"), one("a", "mask", "cat.sch.m", "mk"), one("b", "mask", "cat.sch.m", "mk")])
    assert {k[1]: v[0] for k, v in got.items()} == {"region": "SKIPPED", "unit": "SKIPPED", "a": "MINTED", "b": "MINTED"}


def test_foreign_key_is_an_error(spark):
    assert resolve(spark, [one()], governed=[(KEY_OF_RF, [], "mine")]) == {ME: ("KEY_ERROR", KEY_OF_RF, None)}


def test_assign_replaces_the_value_of_the_same_key(spark):
    s = state(spark, tags=[(T, "region", KEY_OF_RF, "old"), (T, "region", "geo", "x")], governed=[])
    asked = frame(spark, [(*T, "region", "row_filter", RF, KEY_OF_RF)], REQUEST)
    found = tags.resolve_tags(asked, s.column_tags, s.governed_tags)
    assert rows(tags.assign_tags(s.column_tags, found), "tag_key", "tag_value") == [(KEY_OF_RF, None), ("geo", "x")]


@pytest.mark.parametrize(
    ("raw", "full"),
    [
        ("11111111-2222-3333-4444-555555555555", "servicePrincipals/11111111-2222-3333-4444-555555555555"),
        ("groups/11111111-2222-3333-4444-555555555555", "groups/11111111-2222-3333-4444-555555555555"),
        ("someone", "someone"),
    ],
)
def test_principal(spark, raw, full):
    assert spark.range(1).select(names.principal(F.lit(raw)).alias("p")).first().p == full
    assert names.principal_text(raw) == full
