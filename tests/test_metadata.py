import random

import pytest
from helpers import T, frame, options, policy, rows, state
from pyspark.sql import functions as F

from tablewarden.functions.conditions import holds, parse_conditions
from tablewarden.functions.labels import category, normalize_label
from tablewarden.operators import audit, catalog, describe
from tablewarden.operators.inventory import build_inventory
from tablewarden.plans.options import RunOptions
from tablewarden.plans.run import existing_of, run
from tablewarden.sources import generate, schemas, store

DUMP = f"{schemas._KEY}, pos int, name string, value string"


def dump(spark, *lines, table=T):
    return frame(spark, [(*table, i, n, v) for i, (n, v) in enumerate(lines)], DUMP)


def test_describe(spark):
    d = dump(
        spark,
        ("id", "bigint"), ("email", "string"), ("", ""), ("# Detailed Table Information", ""), ("Type", "EXTERNAL"),
        ("Row Filter", "`c-1`.`s`.`rf` ON (region, unit)"), ("# Column Masks", ""), ("email", "`c-1`.`s`.`mk`"),
        ("phone", " `c-1`.`s`.`mk` USING COLUMNS (x)"), ("", ""), ("ssn", "`c-1`.`s`.`late`"),
    )
    assert rows(describe.table_types(d), "table_type") == [("EXTERNAL",)]
    assert rows(describe.row_filters(d), "function_fqn", "using_columns", "raw_text") == [
        ("c-1.s.rf", ["region", "unit"], "`c-1`.`s`.`rf` ON (region, unit)")
    ]
    assert rows(describe.column_masks(d), "column", "function_fqn") == [("email", "c-1.s.mk"), ("phone", "c-1.s.mk")]


@pytest.mark.parametrize("stop", [("Total Size (bytes)", "2137"), ("# Another", "`a`.`b`.`c`"), (None, "`a`.`b`.`c`"), ("x", None)])
def test_mask_section_ends(spark, stop):
    d = dump(spark, ("# Column Masks", None), ("email", "`c`.`s`.`mk`"), stop, ("Owner", "`a`.`b`.`c`"))
    assert rows(describe.column_masks(d), "column") == [("email",)]


def test_no_rules_and_plain_function_names(spark):
    d = dump(spark, ("id", "bigint"), ("Row Filter", "`rf`"))
    assert rows(describe.table_types(d), "table_type") == [("MANAGED",)]
    assert rows(describe.row_filters(d), "function_fqn", "using_columns") == [("rf", [])]
    assert describe.column_masks(d).isEmpty()


def test_mask_section_over_many_chunks(spark, monkeypatch):
    """A very long dump is cut into chunks; sections run across their borders."""
    monkeypatch.setattr(describe, "CHUNK", 7)
    lines, want = [], []
    for i in range(200):
        if i % 60 == 5:
            lines.append(("# Column Masks", ""))
        elif i % 60 == 40:
            lines.append(("Total Size (bytes)", "1"))
        else:
            lines.append((f"c{i}", "`c`.`s`.`f`"))
            if 5 < i % 60 < 40:
                want.append((f"c{i}",))
    both = dump(spark, *lines).unionByName(dump(spark, ("c", "`c`.`s`.`f`"), table=("x", "y", "z")))
    assert rows(describe.column_masks(both), "column") == sorted(want, key=str)


def tables(spark, *names):
    return frame(spark, [(*n.split("."), "MANAGED", None) for n in names], schemas.TABLES)


def test_scopes(spark):
    t = tables(spark, "a.s1.t", "a.s2.t", "b.s1.t", "b.information_schema.t")
    scope = lambda *a, **kw: ["".join(r) for r in rows(catalog.resolve_scope(t, *a, **kw), "catalog", "schema", "table")]
    assert len(scope("ALL_CATALOGS")) == len(scope("ALL_SCHEMAS")) == 4
    assert scope("ALL_CATALOGS", exclude_schema_regex="^information|2") == ["as1t", "bs1t"]
    assert scope("ALL_SCHEMAS", ["a"]) == scope("SELECTED_CATALOGS", ["a"]) == ["as1t", "as2t"]
    assert scope("SELECTED_SCHEMAS", schemas={"a": ["s2"], "b": ["s1", "nope"]}) == ["as2t", "bs1t"]
    assert scope("SELECTED_SCHEMAS", schemas={}) == []
    names = spark.createDataFrame([("a.s1.t",), ("not.listed.x",), ("a.s1.t",)], "name string")
    assert scope("SPECIFIC_TABLES", names=names, exclude_schema_regex="s1") == ["as1t", "notlistedx"]
    with pytest.raises(ValueError):
        scope("SOME")


def test_specific_tables_in_a_run(spark, tmp_path):
    before = state(spark, filters=[(T, "cat.sch.rf", ["x"])])
    done = run(before, options(tmp_path, "INVENTORY", scope_type="SPECIFIC_TABLES", tables=("cat.sch.tbl", "cat.sch.unlisted")))
    assert rows(done.inventory, "table", "migration_eligibility") == [("tbl", "ELIGIBLE"), ("unlisted", "NOT_ELIGIBLE")]
    with pytest.raises(ValueError, match="got: cat.tbl"):
        run(before, options(tmp_path, scope_type="SPECIFIC_TABLES", tables=("cat.tbl",)))


def test_a_run_stays_in_its_scope(spark, tmp_path):
    keys = [("a", "s1", "t"), ("a", "s2", "t"), ("b", "s1", "t"), ("a", "tmp_s", "t")]
    before = state(spark, [(*k, "MANAGED", None) for k in keys], [(k, "a.s1.rf", ["x"]) for k in keys])
    done = run(before, options(tmp_path, scope_type="SELECTED_CATALOGS", catalogs=("a",), exclude_schema_regex="^tmp"))
    assert rows(done.results, "catalog", "schema", "status") == [("a", "s1", "SUCCESS"), ("a", "s2", "SUCCESS")]
    assert rows(done.state.row_filters, "catalog", "schema") == [("a", "tmp_s"), ("b", "s1")]
    checked = run(done.state, options(tmp_path, "VERIFY", scope_type="SELECTED_SCHEMAS", schemas={"a": ["s1", "tmp_s"]}))
    assert rows(checked.results, "schema", "status") == [("s1", "SUCCESS"), ("tmp_s", "FAILED")]


@pytest.mark.parametrize(
    ("message", "scope", "action"),
    [
        ("PERMISSION_DENIED", "ALL_CATALOGS", "skip"), ("PERMISSION_DENIED", "ALL_SCHEMAS", "skip"),
        ("PERMISSION_DENIED", "SELECTED_CATALOGS", "raise"), ("x FAILED_JDBC y", "SELECTED_SCHEMAS", "skip"),
        ("DATA_SOURCE_NOT_FOUND", "SELECTED_CATALOGS", "skip"), ("boom", "ALL_CATALOGS", "raise"), (None, "ALL_CATALOGS", None),
    ],
)
def test_listing_errors(spark, message, scope, action):
    row = spark.createDataFrame([(message,)], "m string").select(catalog.listing_action(scope, "m").alias("a"))
    assert row.first().a == action


def test_error_code_counts_as_well_as_message(spark):
    from tablewarden.functions.labels import error_reason

    df = spark.createDataFrame([("FAILED_JDBC", "x"), (None, None), ("BAD_REQUEST", None)], "c string, m string")
    assert [r[0] for r in df.select(error_reason("m", "c")).collect()] == ["FEDERATION_UNREACHABLE", None, "UNKNOWN_GATEWAY_ERROR"]


@pytest.mark.parametrize(
    ("raw", "label"),
    [
        ("ssn", "ssn"), ("  Email. ", "email"), ("'phone'", "phone"), ('"credit_card".', "credit_card"), ("salary, probably", "salary"),
        ("This is a phone number", "phone"), ("no idea", "other"), ("", None), (None, None), ("none", "none"), ("   ", "other"),
    ],
)
def test_normalize_label(spark, raw, label):
    assert spark.createDataFrame([(raw,)], "t string").select(normalize_label("t").alias("x")).first().x == label


@pytest.mark.parametrize(
    ("fqn", "columns", "label"),
    [
        ("c.s.mask_ssn", ["x"], "ssn"), ("c.s.f", ["home_Address"], "address"), ("c.s.card_mask", [], "credit_card"),
        ("c.s.f", ["region", "business_unit"], "business_unit"), ("c.s.f", ["dob"], "date_of_birth"), ("c.s.f", ["x"], "other"),
    ],
)
def test_category(spark, fqn, columns, label):
    df = spark.createDataFrame([(fqn, columns)], "f string, c array<string>")
    assert df.select(category("f", "c").alias("x")).first().x == label


def test_allowed_values(spark):
    texts = ["['a', \"b c\"]", "[]", "", None, "[x,,y]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(catalog.parse_allowed_values("t").alias("v"))
    assert [r.v for r in df.collect()] == [["a", "b c"], [], [], [], ["x", "y"]]


def test_existing_policies_by_name(spark):
    on = "TABLE `c-1`.`s`.`t`"
    s = state(
        spark,
        policies=[
            policy(on, "abac_migrated_row_filter", "ROW_FILTER", "f"), policy(on, "abac_migrated_mask_a_b", "COLUMN_MASK", "g"),
            policy(on, "abac_migrated_mask_x", "ROW_FILTER", "g"), policy(on, "handmade", "COLUMN_MASK", "g"),
            policy(on, "abac_migrated_mask_gone", "COLUMN_MASK", None), policy("CATALOG `c-1`", "abac_migrated_row_filter", "ROW_FILTER", "f"),
        ],
    )
    found = existing_of(s, RunOptions(scope_type="ALL_CATALOGS"))
    assert rows(found, "catalog", "table", "object_type", "masked_column") == [
        ("c-1", "t", "COLUMN_MASK", "a_b"), ("c-1", "t", "ROW_FILTER", None),
    ]


def test_existing_policies_by_tag(spark):
    """Only keys of the table's own catalog, schema and team count, and only if the catalog has the policy."""
    keys = ["abac_rls_cat_sch_b", "abac_rls_cat_sch_a", "abac_rls_cat_sch2_x", "abac_rls_team_cat_sch_z", "abac_rls_cat_sch_nopolicy"]
    s = state(
        spark,
        policies=[policy("CATALOG `cat`", k, "ROW_FILTER", f"f.{k}") for k in keys[:4]] + [policy("CATALOG `cat`", "abac_colmask_cat_sch_m", "COLUMN_MASK", "m")],
        tags=[(T, f"c{i}", k, None) for i, k in enumerate(keys)] + [(T, "ssn", "abac_colmask_cat_sch_m", None), (T, "nid", "abac_colmask_cat_sch_m", None)],
    )
    plain = existing_of(s, RunOptions(scope_type="ALL_CATALOGS", policy_scope="CATALOG"))
    assert rows(plain, "object_type", "masked_column", "policy_name") == [
        ("COLUMN_MASK", "nid", "abac_colmask_cat_sch_m"), ("COLUMN_MASK", "ssn", "abac_colmask_cat_sch_m"),
        ("ROW_FILTER", None, "abac_rls_cat_sch_a"),
    ]
    team = existing_of(s, RunOptions(scope_type="ALL_CATALOGS", policy_scope="CATALOG", tag_team_prefix="team"))
    assert rows(team, "policy_name") == [("abac_rls_team_cat_sch_z",)]


def test_inventory_of_a_finished_table_is_eligible(spark):
    s = state(spark, policies=[policy("TABLE `cat`.`sch`.`tbl`", "abac_migrated_mask_a", "COLUMN_MASK", "g")])
    got = build_inventory(s.tables, s.row_filters, s.masks, existing_of(s, RunOptions(scope_type="ALL_CATALOGS")), "r").first()
    assert (got.migration_eligibility, got.has_existing_abac_policy, got.existing_abac_policy_names) == ("ELIGIBLE", True, ["abac_migrated_mask_a"])
    assert (got.column_masks, got.row_filter_columns, got.row_filter_expression_text) == ([], [], "")
    assert [f.simpleString() for f in store.conform(s.tables, schemas.INVENTORY).schema] == [
        f.simpleString() for f in schemas.schema(schemas.INVENTORY)
    ]


def test_matrix_of_nine(spark, tmp_path):
    names = [f"{k}_{f}_tbl" for k in generate.MATRIX_KINDS for f in generate.MATRIX_FLAVOURS]
    t = frame(spark, [("cat", "sch", n, generate.MATRIX_KINDS[n.split("_")[0]], None) for n in names], schemas.TABLES)
    filters, masks = generate.matrix(t)
    assert (filters.count(), masks.count()) == (6, 6)


def test_ties_and_missing_times_in_the_latest_row(spark):
    ddl = "catalog string, schema string, `table` string, object_type string, masked_column string, attempt_id string, status string, completed_at timestamp, migration_phase string"
    import datetime as dt

    early, late = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    log = frame(
        spark,
        [
            (*T, "ROW_FILTER", None, "1", "FAILED", late, "FAILED"), (*T, "ROW_FILTER", None, "2", "ABAC_APPLIED", late, "ABAC_APPLIED"),
            (*T, "ROW_FILTER", None, "9", "FAILED", None, "FAILED"), (*T, "COLUMN_MASK", "a", "5", "SUCCESS", early, "FINALIZED"),
        ],
        ddl,
    )
    assert rows(audit.latest_per_object(log), "attempt_id") == [("2",), ("5",)]
    assert rows(audit.latest_per_table(log), "attempt_id") == [("2",)]
    assert rows(audit.stuck_tables(log), "table") == [("tbl",)]


def test_conform_adds_casts_and_drops(spark):
    old = spark.createDataFrame([("r", 1, "x")], "RUN_ID string, dry_run int, extra string")
    new = store.conform(old, schemas.AUDIT).first()
    assert (new.run_id, new.dry_run, new.status) == ("r", True, None)
    assert len(new) == 22


@pytest.mark.parametrize(
    "bad",
    [
        {"mode": "NOPE"}, {"scope_type": "SELECTED_CATALOGS"}, {"scope_type": "SELECTED_SCHEMAS"}, {"scope_type": "SPECIFIC_TABLES"},
        {"exclude_schema_regex": "("}, {"tag_grantee_role": "OWN"}, {"policy_scope": "SCHEMA"}, {"mode": "ROLLBACK"},
        {"dry_run": False}, {"dry_run": False, "audit_path": "a", "inventory_path": "b", "tag_grantee_principals": ("x",)},
    ],
)
def test_wrong_options(bad):
    import re

    with pytest.raises((ValueError, re.error)):
        RunOptions(**{"scope_type": "ALL_CATALOGS", **bad})


def test_shared_folder(spark, tmp_path, monkeypatch):
    class Remote:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(Remote)
    monkeypatch.setattr(Remote.sparkContext, "getCheckpointDir", lambda: str(tmp_path))
    assert store.shared_folder(Remote).startswith(str(tmp_path))
    monkeypatch.setattr(Remote.conf, "get", lambda key, default: "hdfs://shared/cp/")
    assert store.shared_folder(Remote).startswith("hdfs://shared/cp/tablewarden-")
    assert store.shared_folder(spark) != store.shared_folder(spark)


def test_list_session_tables(spark):
    spark.range(1).createOrReplaceTempView("not_listed")
    got = catalog.list_session_tables(spark)
    assert got.columns == ["catalog", "schema", "table", "table_type", "describe_error"]
    assert not [r for r in got.collect() if r.table == "not_listed"]


def test_snapshot_is_replaced(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.refresh_snapshot(spark.range(5), path)
    assert store.refresh_snapshot(spark.range(3), path).agg(F.count("*")).first()[0] == 3


def test_listing_errors_stop_a_run_or_are_skipped(spark):
    from tablewarden.plans.discover import ListingFailed, check_listing

    errors = spark.createDataFrame([("cat1", "PERMISSION_DENIED here", None), ("cat2", "FAILED_JDBC.CONNECTION", None)], "securable string, message string, code string")
    check_listing(errors, "ALL_CATALOGS")
    with pytest.raises(ListingFailed, match="cat1: PERMISSION_DENIED here"):
        check_listing(errors, "SELECTED_CATALOGS")


def described(spark, *listings):
    rows = [(k, n, v) for k, lines in enumerate(listings) for n, v in lines.items()]
    found = catalog.described_policies(spark.createDataFrame(rows, "policy_id long, name string, value string")).collect()
    return sorted(found, key=lambda p: p.policy_name)


def listing(name="n", **changes):
    """Lines as a platform lists them; keyword ``On_Column`` replaces ``On Column``."""
    lines = {
        "Name": name, "Policy Type": "COLUMN_MASK", "On Securable Type": "TABLE", "On Securable": "cat.sch.tbl", "To Principals": "account users",
        "Match Columns": "has_tag('k') AS mc_a", "  Function Name": "`c`.`s`.`f`", "  On Column": "mc_a", "Owner": "x",
    }
    return lines | {k.replace("_", " "): v for k, v in changes.items()}


def test_described_policy(spark):
    p, f, s = described(
        spark,
        listing("a", On_Securable_Type="CATALOG", On_Securable="c", Match_Columns="has_tag('k') AS mc_a, has_tag_value('k2', 'high') as mc_b", To_Principals="`a b`, c", Comment="why")
        | {"  On Column": "mc_b", "  Using Columns": "mc_a"},
        listing("b", Policy_Type="ROW_FILTER", On_Securable="`cat`.`s.x`.`t`", Except_Principals="`z`") | {"  On Column": None, "  Using Columns": "mc_a"},
        listing("c", On_Securable_Type="schema", On_Securable="cat.sch", Match_Columns="has_tag('k') AND NOT has_tag('l') AS mc_a"),
    )
    assert (p.on_securable, p.policy_type, p.function_fqn, p.target_alias, p.using_columns, p.to_principals, p.except_principals, p.comment, p.problem) == (
        "CATALOG `c`", "COLUMN_MASK", "c.s.f", "mc_b", ["mc_a"], ["a b", "c"], [], "why", None)
    assert [(m.tag_key, m.tag_value, m.alias) for m in p.match_columns] == [("k", None, "mc_a"), ("k2", "high", "mc_b")] and p.conditions == []
    assert (f.on_securable, f.policy_type, f.target_alias, f.using_columns, f.except_principals, f.problem) == ("TABLE `cat`.`s.x`.`t`", "ROW_FILTER", None, ["mc_a"], ["z"], None)
    assert s.on_securable == "SCHEMA `cat`.`sch`" and s.problem is None and [(m.tag_key, m.alias) for m in s.match_columns] == [(None, "mc_a")]
    assert [(c.alias, [(i.op, i.tag_key) for i in c.condition]) for c in s.conditions] == [("mc_a", [("TAG", "k"), ("TAG", "l"), ("NOT", None), ("AND", None)])]


@pytest.mark.parametrize(
    ("changes", "problem"),
    [
        ({"Name": None}, "no name"),
        ({"On Securable": None}, "unknown securable: TABLE"),
        ({"On Securable": "cat.sch"}, "unknown securable: TABLE cat.sch"),
        ({"On Securable Type": "METASTORE"}, "unknown securable: METASTORE cat.sch.tbl"),
        ({"Policy Type": "ROW_LIMIT"}, "unknown type: ROW_LIMIT"),
        ({"When Condition": "is_account_group_member('x')"}, "unknown label: When Condition"),
        ({"Match Columns": None}, "match columns: the text ends early"),
        ({"Match Columns": "has_tag('k')"}, "match columns: the text ends early"),
        ({"Match Columns": "has_tag('k') AS a, AS b"}, "match columns: unexpected AS"),
        ({"Match Columns": "(has_tag('k') AS a"}, "match columns: unexpected AS"),
        ({"Match Columns": "regexp_like(column_name, '^a$') AS a"}, "match columns: unexpected regexp_like"),
        ({"  Function Name": " "}, "no function"),
        ({"To Principals": ""}, "no principals"),
    ],
)
def test_a_description_that_is_not_understood_stays(spark, changes, problem):
    assert [p.problem for p in described(spark, listing() | changes)] == [problem]


def test_match_conditions_equal_python(spark):
    rng = random.Random(5)

    def tree(depth):
        kind = rng.choice(["tag", "value", "NOT", "AND", "OR"]) if depth else "tag"
        key = rng.choice("abc")
        if kind == "tag":
            return f"has_tag('{key}')", lambda t: key in t
        if kind == "value":
            return f'has_tag_value("{key}", "1")', lambda t: t.get(key) == "1"
        text, f = tree(depth - 1)
        if kind == "NOT":
            return f"not ({text})", lambda t: not f(t)
        text2, g = tree(depth - 1)
        return f"({text}) {kind} ({text2})", (lambda t: f(t) and g(t)) if kind == "AND" else (lambda t: f(t) or g(t))

    trees = [tree(3) for _ in range(40)] + [("has_tag('a') OR has_tag('b') AND NOT has_tag('c')", lambda t: "a" in t or ("b" in t and "c" not in t))]
    sets = [{k: rng.choice([None, "1", "2"]) for k in "abc" if rng.random() < 0.5} for _ in range(12)]
    rows = [(i, text + " AS m", j, list(s.items())) for i, (text, _) in enumerate(trees) for j, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, text string, j int, tags array<struct<tag_key:string,tag_value:string>>")
    parsed = parse_conditions(F.col("text"))
    for r in df.select("i", "j", parsed["error"].alias("error"), holds(parsed["clauses"][0]["condition"], F.col("tags")).alias("holds")).collect():
        assert (r.error, r.holds) == (None, bool(trees[r.i][1](sets[r.j]))), trees[r.i][0]
