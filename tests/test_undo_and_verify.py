import json
from dataclasses import replace

import pytest
from helpers import T, frame, options, policy, rows, state, steps_of

from tablewarden.operators import rollback
from tablewarden.plans.run import run
from tablewarden.sources import schemas
from tablewarden.sources.store import read_table

ON = "TABLE `cat`.`sch`.`tbl`"
OTHER = ("cat", "sch", "other")


def rules(s):
    return (
        rows(s.row_filters, "catalog", "schema", "table", "function_fqn", "using_columns"),
        rows(s.masks, "catalog", "schema", "table", "column", "function_fqn"),
    )


@pytest.mark.parametrize("scope", ["TABLE", "CATALOG"])
def test_rollback_restores_exactly(spark, tmp_path, scope):
    unrelated = policy(ON, "handmade", "COLUMN_MASK", "cat.sch.mine")
    before = state(
        spark, [(*t, "MANAGED", None) for t in (T, OTHER)], [(T, "cat.sch.rf", ["region"])],
        [(t, c, "cat.sch.mk") for t in (T, OTHER) for c in ("a", "b")], [unrelated],
    )
    moved = run(before, options(tmp_path, policy_scope=scope)).state
    assert rules(moved) == ([], [])
    would = run(moved, options(tmp_path, "ROLLBACK", policy_scope=scope, dry_run=True))
    assert {r.status for r in would.steps.collect()} == {"WOULD_ROLLBACK"} and would.state is moved
    back = run(moved, options(tmp_path, "ROLLBACK", policy_scope=scope))
    assert {r.status for r in back.results.collect()} == {"ROLLED_BACK"}
    assert rules(back.state) == rules(before)
    assert rows(back.state.policies, "policy_name") == [("handmade",)]
    log = read_table(spark, f"{tmp_path}/audit", schemas.AUDIT)
    assert rows(log.groupBy("status", "migration_phase").count(), "status", "migration_phase", "count") == [
        ("ROLLED_BACK", "ROLLED_BACK", 5), ("SUCCESS", "FINALIZED", 5),
    ]


def test_shared_policy_stays_while_another_table_relies_on_it(spark, tmp_path):
    before = state(spark, [(*t, "MANAGED", None) for t in (T, OTHER)], masks=[(t, "a", "cat.sch.mk") for t in (T, OTHER)])
    one = run(before, options(tmp_path, policy_scope="CATALOG", scope_type="SPECIFIC_TABLES", tables=("cat.sch.tbl",), run_id="one")).state
    both = run(one, options(tmp_path, policy_scope="CATALOG", run_id="two")).state
    back = run(both, options(tmp_path, "ROLLBACK", policy_scope="CATALOG", run_id="one"))
    assert rows(back.state.masks, "table") == [("tbl",)]
    assert back.state.policies.count() == 1
    rest = run(back.state, options(tmp_path, "ROLLBACK", policy_scope="CATALOG", run_id="two"))
    assert rest.state.policies.isEmpty() and rest.state.masks.count() == 2


def undo_text(fn="cat.sch.rf", **kw):
    return json.dumps(
        {
            "original_row_filter": {"function": fn, "using_columns": ["region"]},
            "abac_policies_created_by_this_run": [{"policy_name": "abac_migrated_row_filter", "on_securable": ON, "policy_type": "ROW_FILTER"}],
            **kw,
        }
    )


def log(spark, *texts):
    ddl = f"run_id string, attempt_id string, {schemas._KEY}, rollback_metadata string"
    return frame(spark, [("r1", str(i), *T, t) for i, t in enumerate(texts)], ddl)


def test_bad_rows_fail_alone(spark, tmp_path):
    texts = ["{not json", undo_text(), "[1]", "{}", None, "", undo_text("cat.sch.gone"), '{"original_row_filter": {"using_columns": ["x"]}}', "null"]
    s = state(spark, policies=[policy(ON, "abac_migrated_row_filter", "ROW_FILTER", "cat.sch.rf")], functions=[("cat.sch.rf", True)])
    done = run(s, options(tmp_path, "ROLLBACK"), audit=log(spark, *texts))
    got = {int(r.attempt_id): (r.status, r.n_steps) for r in done.results.collect()}
    assert got == {
        0: ("FAILED", 0), 1: ("ROLLED_BACK", 1), 2: ("FAILED", 0), 3: ("SKIPPED", 0), 6: ("FAILED", 1), 7: ("FAILED", 1), 8: ("SKIPPED", 0),
    }
    written = read_table(spark, f"{tmp_path}/audit", schemas.AUDIT)
    assert rows(written.groupBy("object_type", "status", "migration_phase", "error_code").count(), "object_type", "status", "migration_phase", "error_code", "count") == [
        ("NONE", "FAILED", "ROLLBACK_FAILED", None, 2), ("NONE", "SKIPPED", "NOT_APPLICABLE", None, 2),
        ("ROW_FILTER", "FAILED", "ROLLBACK_FAILED", "ROLLBACK_FAILED", 1),
        ("ROW_FILTER", "FAILED", "ROLLBACK_FAILED", "SOURCE_FUNCTION_NOT_FOUND", 1), ("ROW_FILTER", "ROLLED_BACK", "ROLLED_BACK", None, 1),
    ]


def test_failed_restore_keeps_the_policy(spark, tmp_path):
    s = state(spark, policies=[policy(ON, "abac_migrated_row_filter", "ROW_FILTER", "cat.sch.rf")], functions=[])
    done = run(s, options(tmp_path, "ROLLBACK"), audit=log(spark, undo_text()))
    assert done.state.policies.count() == 1 and done.state.row_filters.isEmpty()


def test_only_the_masks_own_policy_is_dropped(spark):
    masks = [{"column": "a", "function": "cat.sch.mk"}]
    made = [{"policy_name": n, "on_securable": ON, "policy_type": "COLUMN_MASK"} for n in ("abac_migrated_mask_a", "abac_migrated_mask_b")]
    parsed = rollback.parse_metadata(log(spark, json.dumps({"original_column_masks": masks, "abac_policies_created_by_this_run": made})), "r1")
    s = state(spark, functions=[("cat.sch.mk", True)])
    steps = rollback.rollback_steps(rollback.rollback_objects(parsed), s.functions)
    restored = rollback.restore_masks(s.masks, steps)
    dropped = rollback.droppable_policies(steps, s.row_filters, restored, s.column_tags)
    assert rows(dropped, "policy_name") == [("abac_migrated_mask_a",)]


def verify(s, tmp_path, **kw):
    return {r.table: (r.status, r.error_code) for r in run(s, options(tmp_path, "VERIFY", **kw)).results.collect()}


def test_verify_and_drift(spark, tmp_path):
    names = ["done", "half", "filter_left", "mask_left", "nothing"]
    t = {n: ("cat", "sch", n) for n in names}
    made = lambda n: policy(f"TABLE `cat`.`sch`.`{n}`", "abac_migrated_row_filter", "ROW_FILTER", "cat.sch.rf")
    s = state(
        spark, [(*k, "MANAGED", None) for k in t.values()], [(t[n], "cat.sch.rf", ["x"]) for n in ("half", "filter_left")],
        [(t["mask_left"], "a", "cat.sch.mk")], [made("done"), made("half")], [(t[n], "region", "k", None) for n in ("done", "half")],
    )
    assert verify(s, tmp_path) == {
        "done": ("SUCCESS", None), "half": ("ABAC_APPLIED", None), "filter_left": ("FAILED", "POLICY_VERIFY_FAILED"),
        # An old mask that was never migrated is not reported.
        "mask_left": ("NOT_ELIGIBLE", None), "nothing": ("NOT_ELIGIBLE", None),
    }
    import datetime as dt

    ddl = f"{schemas._KEY}, attempt_id string, status string, completed_at timestamp"
    now = dt.datetime(2025, 1, 1)
    audit = frame(
        spark,
        [(*t["done"], "1", "SUCCESS", now), (*t["half"], "1", "SUCCESS", now), (*t["filter_left"], "1", "ALREADY_MIGRATED", now),
         (*t["mask_left"], "1", "SUCCESS", now), (*t["mask_left"], "2", "FAILED", now)],
        ddl,
    )
    got = run(s, options(tmp_path, "RECONCILE"), audit=audit).results.collect()
    assert {r.table: (r.drift_detected, r.reason) for r in got} == {
        "done": (False, "LIVE_STATE_MATCHES_AUDIT"), "half": (True, "LIVE_STATE_DOES_NOT_MATCH_AUDIT"),
        "filter_left": (True, "POLICY_VERIFY_FAILED"), "mask_left": (False, "LAST_RUN_WAS_NOT_SUCCESSFUL"),
        "nothing": (False, "NEVER_MIGRATED_BY_THIS_UTILITY"),
    }


@pytest.mark.parametrize("scope", ["TABLE", "CATALOG"])
def test_a_lost_tag_is_seen_in_every_phase(spark, tmp_path, scope):
    """Applied, then the tags are taken off: FINALIZE keeps the old rules, and after a finalized run VERIFY and RECONCILE tell."""
    s = state(spark, filters=[(T, "cat.sch.rf", ["region"])], masks=[(T, "mail", "cat.sch.mk")])
    opts = lambda mode, run_id, **kw: options(tmp_path, mode, run_id=run_id, policy_scope=scope, **kw)
    applied = run(s, opts("APPLY_ABAC", "a")).state
    assert applied.coverage.count() == 2
    untagged = replace(applied, column_tags=applied.column_tags.limit(0))
    kept = run(untagged, opts("FINALIZE", "f"))
    assert steps_of(kept) == {x: ("FAILED", "POLICY_VERIFY_FAILED") for x in ("", "mail")}
    assert kept.state.row_filters.count() == 1 and kept.state.masks.count() == 1

    done = run(applied, opts("FINALIZE", "g"))
    assert {v[0] for v in steps_of(done).values()} == {"SUCCESS"} and done.state.masks.isEmpty()
    check = lambda st, mode: run(st, opts(mode, "v")).results.collect()[0]
    assert check(done.state, "VERIFY").status == "SUCCESS"
    bare = replace(done.state, column_tags=done.state.column_tags.where("column <> 'mail'"))
    assert (check(bare, "VERIFY").status, check(bare, "VERIFY").error_code) == ("FAILED", "POLICY_VERIFY_FAILED")
    assert (check(bare, "RECONCILE").drift_detected, check(bare, "RECONCILE").reason) == (True, "POLICY_VERIFY_FAILED")


def test_rollback_takes_coverage_back(spark, tmp_path):
    s = state(spark, filters=[(T, "cat.sch.rf", ["region"])])
    done = run(s, options(tmp_path, run_id="m")).state
    assert done.coverage.count() == 1
    back = run(done, options(tmp_path, "ROLLBACK", run_id="m")).state
    assert back.coverage.isEmpty() and back.row_filters.count() == 1
    assert {r.status for r in run(back, options(tmp_path, "VERIFY")).results.collect()} == {"FAILED"}
