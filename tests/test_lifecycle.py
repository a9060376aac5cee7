"""Data seen through every phase of a migration, and the four-domain rules."""

import pytest
from helpers import frame, options, rows

from tablewarden.functions import masks as m
from tablewarden.operators import checks
from tablewarden.operators.enforce import MaskFunction, SecurityState, secure
from tablewarden.operators.rowfilters import public_or_group_rule
from tablewarden.plans.run import GovernanceState, run
from tablewarden.sources import generate, schemas
from tablewarden.sources.store import read_table, refresh_snapshot

KINDS, FLAVOURS = generate.MATRIX_KINDS, generate.MATRIX_FLAVOURS
MASKED = {"managed": "***MANAGED-MASKED***", "streaming": "***STREAMING-MASKED***", "mv": "***MV-MASKED***"}


@pytest.fixture(scope="module")
def matrix(spark):
    tables = frame(
        spark, [("cat", k, f"{k}_{f}_tbl", KINDS[k], None) for k in KINDS for f in FLAVOURS], schemas.TABLES
    )
    filters, masks = generate.matrix(tables)
    known = filters.select("function_fqn").unionAll(masks.select("function_fqn")).distinct().selectExpr("function_fqn", "true AS executable")
    none = [schemas.empty(spark, ddl) for ddl in (schemas.POLICIES, schemas.COLUMN_TAGS, schemas.GOVERNED_TAGS)]
    return GovernanceState(tables, filters, masks, *none, known)


@pytest.fixture(scope="module")
def members(spark):
    return generate.membership(spark, [("data_admins", "boss@x"), ("others", "joe@x")])


def seen_by(spark, state, members, principal, flavours=(("managed", "rls"), ("streaming", "mask"), ("mv", "both"))):
    """Tables of the matrix, one of each kind and flavour, as *principal* sees them."""
    data = spark.createDataFrame([(1, "east", "a@x", 10.0), (2, "west", "b@x", 20.0), (3, "Global", "c@x", 30.0)],
                                 "id long, region string, customer_email string, amount double")
    functions = {f"cat.{k}.rf_region": public_or_group_rule(["east"], "data_admins") for k in KINDS}
    functions |= {f"cat.{k}.mask_email": MaskFunction(m.constant(text)) for k, text in MASKED.items()}
    security = SecurityState(members, functions, state.row_filters, state.masks, state.policies, state.column_tags)
    return {
        f"{k}_{f}_tbl": sorted(tuple(r) for r in secure(data, ("cat", k, f"{k}_{f}_tbl"), security, principal).collect())
        for k, f in flavours
    }


def test_nine_tables_through_all_phases(spark, tmp_path, matrix, members):
    opts = lambda mode, run_id: options(tmp_path, mode, run_id=run_id)
    inventory = run(matrix, opts("INVENTORY", "inv")).inventory
    assert {r.migration_eligibility for r in inventory.collect()} == {"ELIGIBLE"}
    before = {p: seen_by(spark, matrix, members, p) for p in ("boss@x", "joe@x")}
    assert [r[0] for r in before["boss@x"]["managed_rls_tbl"]] == [1, 2, 3]
    assert [r[0] for r in before["joe@x"]["mv_both_tbl"]] == [1]
    assert {r[2] for r in before["boss@x"]["mv_both_tbl"]} == {r[2] for r in before["joe@x"]["mv_both_tbl"]} == {MASKED["mv"]}
    assert {r[2] for r in before["joe@x"]["streaming_mask_tbl"]} == {MASKED["streaming"]}
    assert {r[2] for r in before["boss@x"]["managed_rls_tbl"]} == {"a@x", "b@x", "c@x"}

    applied = run(matrix, opts("APPLY_ABAC", "apply"))
    assert {r.status for r in applied.results.collect()} == {"ABAC_APPLIED"}
    final = run(applied.state, opts("FINALIZE", "final"))
    assert {r.status for r in final.results.collect()} == {"SUCCESS"}
    assert final.state.row_filters.isEmpty() and final.state.masks.isEmpty()
    log = read_table(spark, f"{tmp_path}/audit", schemas.AUDIT)
    assert (log.count(), log.where("error_code is not null").count()) == (24, 0)

    undo_final = run(final.state, opts("ROLLBACK", "final"))
    assert [r.status for r in undo_final.steps.collect()] == ["ROLLED_BACK"] * 12
    phases = {"applied": applied.state, "final": final.state, "undone": undo_final.state}
    for name, state in phases.items():
        for principal, want in before.items():
            assert seen_by(spark, state, members, principal) == want, (name, principal)


DOMAINS = {
    # domain: (filter column, public values, admin group, {masked column: mask})
    "hr": ("department", ["Public Relations", "Customer Support"], "hr_admins",
           {"ssn": m.constant("***-**-****"), "salary": m.null_out(), "personal_email": m.email_fixed_domain()}),
    "finance": ("business_unit", ["Public Reporting"], "finance_admins",
                {"account_number": m.keep_last("XXXX-XXXX-"), "routing_number": m.constant(), "balance": m.null_out()}),
    "sales": ("region", ["Global"], "sales_managers",
              {"email": m.email_fixed_domain(), "phone": m.keep_last("***-***-"), "credit_card_last4": m.with_prefix()}),
    "healthcare": ("facility", ["Public Health Clinic"], "healthcare_providers",
                   {"ssn": m.constant("***-**-****"), "medical_record_number": m.constant(), "diagnosis": m.constant("REDACTED-PHI")}),
}
ROWS = {
    "hr": ("ssn string, salary double, personal_email string", ("111-22-3333", 95000.0, "pri@x.example"), ("***-**-****", None, "p***@masked.com")),
    "finance": ("account_number string, routing_number string, balance double", ("12345678", "021000", 5.5), ("XXXX-XXXX-5678", "REDACTED", None)),
    "sales": ("email string, phone string, credit_card_last4 string", ("z@x.example", "555-123-4567", "4242"),
              ("z***@masked.com", "***-***-4567", "****-****-****-4242")),
    "healthcare": ("ssn string, medical_record_number string, diagnosis string", ("1", "MRN-1", "flu"), ("***-**-****", "REDACTED", "REDACTED-PHI")),
}


@pytest.mark.parametrize("domain", list(DOMAINS))
def test_four_domains(spark, domain):
    column, public, group, masks = DOMAINS[domain]
    ddl, raw, shown = ROWS[domain]
    data = spark.createDataFrame([(i, v, *raw) for i, v in enumerate([*public, "Secret", None])], f"id long, {column} string, {ddl}")
    table = ("cat", domain, "both_tbl")
    state = SecurityState(
        membership=generate.membership(spark, [(group, "in@x"), ("elsewhere", "out@x")]),
        functions={"rf": public_or_group_rule(public, group), **{c: MaskFunction(mask) for c, mask in masks.items()}},
        row_filters=frame(spark, [(*table, "rf", [column], "")], schemas.ROW_FILTERS),
        masks=frame(spark, [(*table, c, c, "", i) for i, c in enumerate(masks)], schemas.MASKS),
    )
    inside, outside = (secure(data, table, state, p) for p in ("in@x", "out@x"))
    assert rows(outside, "id") == [(i,) for i in range(len(public))]
    assert inside.count() == len(public) + 2
    assert {tuple(r)[2:] for r in inside.collect()} == {shown}
    assert inside.dtypes == data.dtypes


def test_secured_materialized_view(spark, tmp_path):
    """The snapshot keeps raw rows; the rules act when it is read."""
    events = spark.createDataFrame([(1, "east", "a@x", 1.0), (2, "west", "b@x", 2.0), (3, "west", "c@x", 3.0)],
                                   "id long, region string, customer_email string, amount double")
    view = refresh_snapshot(events, f"{tmp_path}/mv")
    table = ("cat", "sch", "mv")
    state = SecurityState(
        membership=generate.membership(spark, [("g", "p")]),
        functions={"rf": public_or_group_rule(["east"], "nobody"), "mk": MaskFunction(m.constant("***MV-MASKED***"))},
        row_filters=frame(spark, [(*table, "rf", ["region"], "")], schemas.ROW_FILTERS),
        masks=frame(spark, [(*table, "customer_email", "mk", "", 1)], schemas.MASKS),
    )
    seen = secure(view, table, state, "p")
    assert rows(seen, "id", "customer_email") == [(1, "***MV-MASKED***")]
    verdict = checks.mask_check(seen, {"customer_email": "***MV-MASKED***"}).first()
    assert (verdict.n_rows, verdict.customer_email) == (1, True)
