"""Outcome of every row of the decision tables: one table per case, few runs."""

import pytest
from helpers import fault, options, policy, rows, state

from tablewarden.operators.results import with_none_steps
from tablewarden.operators.tags import DESCRIPTION
from tablewarden.plans.run import run
from tablewarden.sources import schemas
from tablewarden.sources.store import read_table

KINDS = ["MANAGED", "EXTERNAL", "STREAMING_TABLE", "MATERIALIZED_VIEW", "VIEW", "FOREIGN"]
ERRORS = {
    "err_a": ("[X] PERMISSION_DENIED: no", "PERMISSION_DENIED"),
    "err_b": ("SAMPLE_TABLE_PERMISSIONS", "PERMISSION_DENIED"),
    "err_c": ("Failed: FAILED_JDBC.CONNECTION", "FEDERATION_UNREACHABLE"),
    "err_d": ("DATA_SOURCE_NOT_FOUND", "UNSUPPORTED_DATA_SOURCE"),
    "err_e": ("boom", "UNKNOWN_GATEWAY_ERROR"),
}
# Tables with one row filter on ``region``, and what goes wrong with it.
FAULTS = {
    "create_fails": {"create_failed": True},
    "create_coded": {"create_failed": True, "create_error_code": "X", "create_error_message": "m"},
    "verify_fails": {"verify_failed": True},
    "removal_fails": {"removal_error": "boom"},
    "old_remains": {"legacy_remains": True},
}
FILTERED = ["filter_only", "both", "gone_function", "no_execute", "conflict", "listed", *FAULTS]
THREE = ["masks_only", "both", "partial"]


def key(name):
    return ("cat", "sch", name)


def on(name):
    return f"TABLE `cat`.`sch`.`{name}`"


def rf(name):
    return f"cat.sch.rf_{name}"


def world(spark):
    kinds = [(*key(f"kind_{k.lower()}"), k, None) for k in KINDS]
    errors = [(*key(n), "MANAGED", text) for n, (text, _) in ERRORS.items()]
    plain = [*FILTERED, "masks_only", "partial", "two_columns", "shared_mask", "twin_1", "twin_2", "bare"]
    filters = [(key(n), rf(n), ["region"]) for n in FILTERED]
    filters += [(key("two_columns"), rf("two"), ["region", "business_unit"])]
    filters += [(key("twin_1"), "cat.sch.rf-x", ["region"]), (key("twin_2"), "cat.sch.rf_x", ["region"])]
    filters += [(key(f"kind_{k.lower()}"), rf("kind"), ["region"]) for k in KINDS]
    masks = [(key(n), c, f"cat.sch.mk_{c}") for n in THREE for c in ("c1", "c2", "c3")]
    masks += [(key("shared_mask"), c, "cat.sch.mk_same") for c in ("ssn", "national_id")]
    known = {(f[1], f[1] != rf("no_execute")) for f in filters if f[1] != rf("gone_function")} | {(m[2], True) for m in masks}
    policies = [
        policy(on("conflict"), "abac_migrated_row_filter", "ROW_FILTER", "cat.sch.other"),
        policy(on("listed"), "abac_migrated_row_filter", "ROW_FILTER", None),
    ]
    tables = [(*key(n), "MANAGED", None) for n in plain] + kinds + errors
    return state(spark, tables, filters, masks, policies, functions=known)


def all_faults(spark):
    return fault(
        spark,
        *[(key(n), "ROW_FILTER", "", values) for n, values in FAULTS.items()],
        (key("partial"), "COLUMN_MASK", "c2", {"create_failed": True}),
    )


class Seen:
    """A run's rows, collected once."""

    def __init__(self, result):
        self.result = result
        self.steps = {(r.table, r.slot): r for r in result.steps.collect()}
        self.tables = {r.table: r for r in result.results.collect()}
        self.filters = {r.table for r in result.state.row_filters.collect()}
        self.masks = {(r.table, r.column) for r in result.state.masks.collect()}
        self.policies = {(r.on_securable, r.policy_name): r for r in result.state.policies.collect()}
        self.tags = {(r.table, r.column): (r.tag_key, r.tag_value) for r in result.state.column_tags.collect()}

    def status(self, table, slot=""):
        step = self.steps[(table, slot)]
        return step.status, step.error_code

    def has_policy(self, table, name="abac_migrated_row_filter"):
        return (on(table), name) in self.policies


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("migration")


@pytest.fixture(scope="module")
def full(spark, folder):
    return Seen(run(world(spark), options(folder), all_faults(spark)))


@pytest.fixture(scope="module")
def rerun(spark, folder, full):
    return Seen(run(full.result.state, options(folder, run_id="r2")))


@pytest.fixture(scope="module")
def applied(spark, folder):
    return Seen(run(world(spark), options(folder, "APPLY_ABAC", run_id="apply")))


@pytest.fixture(scope="module")
def finalized(spark, folder, applied):
    bad = fault(spark, (key("both"), "ROW_FILTER", "", {"verify_failed": True}))
    return Seen(run(applied.result.state, options(folder, "FINALIZE", run_id="final"), bad))


def test_filter_only(full):
    assert full.status("filter_only") == ("SUCCESS", None)
    row = full.tables["filter_only"]
    assert (row.status, row.row_filter_status, row.column_mask_status) == ("SUCCESS", "SUCCESS", {})
    assert (row.validation_status, row.migration_phase, row.row_filter_function) == ("PASSED", "FINALIZED", rf("filter_only"))
    assert "filter_only" not in full.filters
    made = full.policies[(on("filter_only"), "abac_migrated_row_filter")]
    assert (made.function_fqn, made.using_columns, made.target_alias) == (rf("filter_only"), ["mc_region"], None)
    assert [tuple(m) for m in made.match_columns] == [("abac_rls_cat_sch_rf_filter_only", None, "mc_region", "region")]
    assert full.tags[("filter_only", "region")] == ("abac_rls_cat_sch_rf_filter_only", None)


def test_definition_text(full):
    assert full.steps[("filter_only", "")].target_definition.split("\n") == [
        "CREATE OR REPLACE POLICY abac_migrated_row_filter",
        "ON TABLE `cat`.`sch`.`filter_only`",
        "COMMENT 'Migrated from a table-level row filter.'",
        "ROW FILTER cat.sch.rf_filter_only",
        "TO `account users`",
        "FOR TABLES",
        "MATCH COLUMNS has_tag('abac_rls_cat_sch_rf_filter_only') AS mc_region",
        "USING COLUMNS (mc_region)",
    ]
    mask = full.steps[("masks_only", "c1")].target_definition.split("\n")
    assert mask[-1] == "ON COLUMN mc_c1" and mask[3] == "COLUMN MASK cat.sch.mk_c1"


def test_minted_tags_describe_themselves(full):
    minted = {r.tag_key: r for r in full.result.state.governed_tags.collect()}
    assert minted["abac_rls_cat_sch_rf_filter_only"].description == DESCRIPTION + rf("filter_only")
    assert minted["abac_rls_cat_sch_rf_filter_only"].allowed_values == []


def test_masks_only_and_both(full):
    row = full.tables["masks_only"]
    assert row.row_filter_status is None
    assert row.column_mask_status == {"c1": "SUCCESS", "c2": "SUCCESS", "c3": "SUCCESS"}
    assert (full.tables["both"].status, full.tables["both"].n_steps) == ("SUCCESS", 4)
    assert not {m for m in full.masks if m[0] in ("masks_only", "both")}


def test_table_without_rules_is_not_attempted(full):
    assert "bare" not in full.tables
    got = {r.table: r for r in full.result.inventory.collect()}
    assert (got["bare"].migration_eligibility, got["bare"].eligibility_reason) == ("NOT_ELIGIBLE", "NO_LEGACY_SECURITY_FOUND")
    assert {n: (got[n].row_filter_expression_text, got[n].eligibility_reason) for n in ERRORS} == ERRORS
    assert {got[n].table_type for n in ERRORS} == {"UNKNOWN"}
    assert {got[f"kind_{k.lower()}"].eligibility_reason for k in KINDS[4:]} == {"UNSUPPORTED_TABLE_TYPE"}
    assert {full.tables[f"kind_{k.lower()}"].status for k in KINDS[:4]} == {"SUCCESS"}


def test_eligible_table_without_objects_gets_a_none_step(spark):
    bare = state(spark)
    none = spark.createDataFrame([], schemas.schema(f"{schemas._KEY}, object_type string, slot string, status string, error_code string"))
    got = rows(with_none_steps(none, bare.tables), "object_type", "status", "error_code")
    assert got == [("NONE", "NOT_ELIGIBLE", "NO_LEGACY_SECURITY_FOUND")]


def test_function_gone_or_forbidden(full):
    assert full.status("gone_function") == ("FAILED", "SOURCE_FUNCTION_NOT_FOUND")
    assert full.status("no_execute") == ("FAILED", "SOURCE_FUNCTION_NOT_ACCESSIBLE")
    assert {"gone_function", "no_execute"} <= full.filters
    assert not full.has_policy("gone_function") and not full.has_policy("no_execute")


def test_conflicting_policy(full):
    assert full.status("conflict") == ("NOT_ELIGIBLE", "EXISTING_ABAC_POLICY_CONFLICT")
    assert full.tables["conflict"].row_filter_policy == "abac_migrated_row_filter"
    assert full.policies[(on("conflict"), "abac_migrated_row_filter")].function_fqn == "cat.sch.other"


def test_listed_but_not_described_policy_is_no_conflict(full):
    assert full.status("listed") == ("SUCCESS", None)


def test_create_fails(full):
    assert full.status("create_fails") == ("FAILED", "POLICY_CREATE_FAILED")
    assert full.status("create_coded") == ("FAILED", "X")
    assert full.steps[("create_coded", "")].error_message == "m"
    for name in ("create_fails", "create_coded"):
        assert full.steps[(name, "")].rollback is None
        assert name in full.filters and not full.has_policy(name)


@pytest.mark.parametrize(
    ("name", "code", "message"),
    [
        ("verify_fails", "POLICY_VERIFY_FAILED", None),
        ("removal_fails", "LEGACY_REMOVAL_FAILED", "boom"),
        ("old_remains", "FINAL_STATE_VERIFY_FAILED", None),
    ],
)
def test_late_failure_leaves_both(full, rerun, name, code, message):
    step = full.steps[(name, "")]
    assert (step.status, step.error_code, step.error_message) == ("FAILED", code, message)
    assert step.rollback is not None
    assert name in full.filters and full.has_policy(name)
    # A run that stopped half-way is taken up again.
    assert rerun.status(name) == ("SUCCESS", None)


def test_one_of_three_masks_fails(full):
    assert {c: full.status("partial", c)[0] for c in ("c1", "c2", "c3")} == {"c1": "SUCCESS", "c2": "FAILED", "c3": "SUCCESS"}
    row = full.tables["partial"]
    assert (row.status, row.error_code, row.validation_status) == ("FAILED", "POLICY_CREATE_FAILED", "FAILED")
    assert {m for m in full.masks if m[0] == "partial"} == {("partial", "c2")}


def test_filter_on_two_columns_cannot_be_tagged(full):
    assert full.status("two_columns") == ("FAILED", "RLS_TAG_COLLISION_UNRESOLVABLE")
    assert "two_columns" in full.filters
    assert not [t for t in full.tags if t[0] == "two_columns"]


def test_one_mask_on_two_columns_shares_a_key(full):
    assert full.tables["shared_mask"].status == "SUCCESS"
    assert full.tags[("shared_mask", "ssn")] == full.tags[("shared_mask", "national_id")] == ("abac_colmask_cat_sch_mk_same", None)


def test_two_functions_with_one_key_fail_alone(full):
    """Names that differ only in a replaced character do not stop the other tables."""
    assert full.status("twin_1")[0] == full.status("twin_2")[0] == "FAILED"
    assert full.tables["filter_only"].status == "SUCCESS"


def test_audit_has_one_row_per_object(spark, folder, full):
    audit = read_table(spark, f"{folder}/audit", schemas.AUDIT).where("run_id = 'r1'")
    assert audit.count() == len(full.steps)
    assert audit.select("attempt_id").distinct().count() == len(full.steps)
    got = {(r.table, r.masked_column): r for r in audit.collect()}
    step = got[("both", "c1")]
    assert (step.validation_status, step.migration_phase, step.target_policy_type) == ("PASSED", "FINALIZED", "COLUMN_MASK")
    # Reading the returned rows again shows what was written.
    returned = {(r.table, r.masked_column): r for r in full.result.audit.collect()}
    assert {k: (r.attempt_id, r.completed_at) for k, r in returned.items()} == {k: (r.attempt_id, r.completed_at) for k, r in got.items()}
    assert step.started_at < step.completed_at
    # Phase and validation are the table's, not the object's.
    assert (got[("partial", "c1")].status, got[("partial", "c1")].migration_phase) == ("SUCCESS", "FAILED")
    assert got[("filter_only", None)].rollback_metadata == (
        '{"original_row_filter":{"function":"cat.sch.rf_filter_only","using_columns":["region"]},'
        '"abac_policies_created_by_this_run":[{"policy_name":"abac_migrated_row_filter",'
        '"on_securable":"TABLE `cat`.`sch`.`filter_only`","policy_type":"ROW_FILTER"}]}'
    )


def test_inventory_shows_the_last_status(spark, folder, full):
    log = read_table(spark, f"{folder}/audit", schemas.AUDIT).where("run_id = 'r1'")
    again = run(full.result.state, options(folder, "INVENTORY", run_id="inv"), audit=log)
    got = {r.table: r.current_migration_status for r in again.inventory.collect()}
    assert (got["filter_only"], got["create_fails"], got["bare"]) == ("SUCCESS", "FAILED", None)


def test_rerun_is_already_migrated(full, rerun):
    for name in ("filter_only", "masks_only", "both", "shared_mask"):
        assert rerun.tables[name].status == "ALREADY_MIGRATED"
    assert rerun.tables["filter_only"].row_filter_function == rf("filter_only")
    assert rerun.tables["filter_only"].migration_phase == "FINALIZED"
    # The masks done earlier are ALREADY_MIGRATED, the one that failed is done now.
    assert rerun.tables["partial"].column_mask_status == {"c1": "ALREADY_MIGRATED", "c2": "SUCCESS", "c3": "ALREADY_MIGRATED"}
    assert rerun.tables["partial"].status == "SUCCESS"


def test_dry_run_changes_nothing(spark, tmp_path):
    before = world(spark)
    done = run(before, options(tmp_path, dry_run=True), all_faults(spark))
    assert done.steps.where("`table` = 'create_fails' and rollback is not null").count() == 1
    got = {r.table: r for r in done.results.collect()}
    assert got["both"].status == "WOULD_MIGRATE" and got["both"].migration_phase == "DRY_RUN"
    assert got["gone_function"].status == "FAILED"
    assert done.state is before
    assert not list(tmp_path.iterdir())


def test_apply_leaves_the_old_rules(applied):
    row = applied.tables["both"]
    assert (row.status, row.validation_status, row.migration_phase) == ("ABAC_APPLIED", "PARTIAL", "ABAC_APPLIED")
    assert "both" in applied.filters and ("both", "c1") in applied.masks
    assert applied.has_policy("both") and applied.has_policy("both", "abac_migrated_mask_c1")


def test_finalize(finalized):
    assert finalized.tables["filter_only"].status == finalized.tables["masks_only"].status == "SUCCESS"
    assert "filter_only" not in finalized.filters
    assert finalized.steps[("filter_only", "")].target_definition is None
    # The policy is checked again before the old rule goes.
    step = finalized.steps[("both", "")]
    assert (step.status, step.error_code, step.rollback) == ("FAILED", "POLICY_VERIFY_FAILED", None)
    assert "both" in finalized.filters
    # What could not be applied is not finalized.
    assert finalized.status("two_columns") == ("NOT_ELIGIBLE", "ABAC_NOT_APPLIED_YET")


def test_finalize_dry_run(spark, folder, applied):
    done = run(applied.result.state, options(folder, "FINALIZE", dry_run=True))
    got = {r.table: r.status for r in done.results.collect()}
    assert got["both"] == "WOULD_FINALIZE"


def test_team_prefix_names_keys_and_policies(spark, tmp_path):
    before = state(spark, filters=[(key("tbl"), "cat.sch.rf", ["region"])], masks=[(key("tbl"), "Odd Col", "cat.sch.mk")])
    done = run(before, options(tmp_path, tag_team_prefix="my-team"))
    assert rows(done.state.policies, "policy_name") == [
        ("abac_my_team_migrated_mask_Odd Col",), ("abac_my_team_migrated_row_filter",),
    ]
    assert rows(done.state.governed_tags, "tag_key") == [("abac_colmask_my_team_cat_sch_mk",), ("abac_rls_my_team_cat_sch_rf",)]
    # Without the prefix the policies are not recognized as ours.
    again = run(done.state, options(tmp_path, "INVENTORY", run_id="r2"))
    assert rows(again.inventory, "eligibility_reason") == [("NO_LEGACY_SECURITY_FOUND",)]


def test_stop_at_first_failure(spark, tmp_path):
    tables = [key(n) for n in ("t1", "t2", "t3", "t4")]
    before = state(spark, tables=[(*t, "MANAGED", None) for t in tables], filters=[(t, "cat.sch.rf", ["x"]) for t in tables])
    bad = fault(spark, *[(t, "ROW_FILTER", "", {"create_failed": True}) for t in tables[1:3]])
    done = run(before, options(tmp_path, continue_on_error=False), bad)
    assert rows(done.results, "table", "status") == [("t1", "SUCCESS"), ("t2", "FAILED")]
    assert done.summary.collect()[0].asDict() == {
        "tables_succeeded": 1, "tables_abac_applied": 0, "tables_would_migrate": 0, "tables_already_migrated": 0, "tables_failed": 1,
    }
    assert rows(read_table(spark, f"{tmp_path}/audit", schemas.AUDIT), "table") == [("t1",), ("t2",)]


def test_grants(spark, tmp_path):
    role = "roles/tagPolicy.assigner"
    rules = [
        ("abac_rls_cat_sch_rf", role, ["groups/g", "groups/h", "groups/i"]),
        # Two rules that only together cover what is wanted are not enough.
        ("abac_colmask_cat_sch_mk", role, ["groups/g"]),
        ("abac_colmask_cat_sch_mk", role, ["groups/h"]),
    ]
    before = state(spark, filters=[(key("tbl"), "cat.sch.rf", ["x"])], masks=[(key("tbl"), "c1", "cat.sch.mk")], rules=rules)
    grantees = ("groups/g", "groups/h")
    done = run(before, options(tmp_path, tag_grantee_principals=grantees))
    assert rows(done.tag_grants, "tag_key", "status") == [("abac_colmask_cat_sch_mk", "GRANTED"), ("abac_rls_cat_sch_rf", "ALREADY_GRANTED")]
    assert done.state.grant_rules.count() == 4
    assert read_table(spark, f"{tmp_path}/tag_grants", schemas.TAG_GRANTS).count() == 2
    dry = run(before, options(tmp_path, dry_run=True, tag_grantee_principals=grantees))
    assert {r.status for r in dry.tag_grants.collect()} == {"WOULD_GRANT"}


def test_catalog_scope_shares_one_policy(spark, tmp_path):
    tables = [key(f"t{i}") for i in range(3)]
    before = state(
        spark, [(*t, "MANAGED", None) for t in tables], [(t, "cat.sch.rf", ["region"]) for t in tables],
        [(t, "ssn", "cat.sch.mk") for t in tables],
    )
    done = run(before, options(tmp_path, policy_scope="CATALOG"))
    assert {r.status for r in done.results.collect()} == {"SUCCESS"}
    assert rows(done.state.policies, "on_securable", "policy_name") == [
        ("CATALOG `cat`", "abac_colmask_cat_sch_mk"), ("CATALOG `cat`", "abac_rls_cat_sch_rf"),
    ]
    again = run(done.state, options(tmp_path, policy_scope="CATALOG", run_id="r2"))
    assert [r.status for r in again.steps.collect()] == ["ALREADY_MIGRATED"] * 6
