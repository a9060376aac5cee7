"""Results, audit log, verification, rollback, whole runs and generated data."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import KEY
from tablewarden.operators import audit, results, rollback, verify
from tablewarden.plans.options import RunOptions
from tablewarden.plans.run import GovernanceState, existing_of, run, stored_state
from tablewarden.plans.run import verify as verify_run
from tablewarden.plans.stored import StateStore
from tablewarden.sources import generate, schemas, store
from tablewarden.sources.deltas import ChangeLog
from workload.ctes import KEY_OUT
from workload.frames import Frames
from workload.lifecycle import CATALOG, PLANNED, SHARED, STEPS, TABLE, steps
from workload.registry import query

_STATUS = """CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_and(status = 'NOT_ELIGIBLE') THEN 'NOT_ELIGIBLE' WHEN bool_or(status = 'WOULD_MIGRATE') THEN 'WOULD_MIGRATE'
  WHEN bool_or(status = 'WOULD_APPLY_ABAC') THEN 'WOULD_APPLY_ABAC' WHEN bool_or(status = 'WOULD_FINALIZE') THEN 'WOULD_FINALIZE' WHEN bool_and(status IN ('ALREADY_MIGRATED', 'NOT_ELIGIBLE')) THEN 'ALREADY_MIGRATED'
  WHEN bool_or(status = 'ABAC_APPLIED') THEN 'ABAC_APPLIED' WHEN bool_or(status = 'SUCCESS') THEN 'SUCCESS' ELSE min(status) END"""
_PHASE = """CASE WHEN status IN ('SUCCESS', 'ALREADY_MIGRATED') THEN 'FINALIZED' WHEN status = 'ABAC_APPLIED' THEN 'ABAC_APPLIED' WHEN status LIKE 'WOULD%' THEN 'DRY_RUN' WHEN status = 'FAILED' THEN 'FAILED' ELSE 'NOT_APPLICABLE' END"""
_VALIDATION = "CASE status WHEN 'SUCCESS' THEN 'PASSED' WHEN 'FAILED' THEN 'FAILED' WHEN 'ABAC_APPLIED' THEN 'PARTIAL' ELSE 'NOT_RUN' END"

ELIGIBLE = {
    "eligible": "SELECT cn, sn, tn FROM gov_tables t WHERE describe_error IS NULL AND table_type <> 'VIEW' AND EXISTS (SELECT 1 FROM gov_objects o WHERE o.tid = t.tid)",
}
RESULTS = {
    **ELIGIBLE,
    **STEPS,
    "table_status": f"SELECT cn, sn, tn, {_STATUS} AS status, count(*) AS n_steps FROM full_steps GROUP BY 1, 2, 3",
}


def _full(f: Frames) -> DataFrame:
    return store.cut_lineage(steps(f))


@query("A-01_table_status", f"SELECT {KEY_OUT}, status FROM table_status", RESULTS)
def table_status(f: Frames) -> DataFrame:
    return steps(f).groupBy(*KEY).agg(results.weakest_link().alias("status"))


@query("A-01_audit_status", f"SELECT {KEY_OUT}, {_STATUS} AS status FROM audit GROUP BY cn, sn, tn")
def audit_status(f: Frames) -> DataFrame:
    return f.audit.groupBy(*KEY).agg(results.weakest_link().alias("status"))


@query("A-02_phases", f"SELECT {KEY_OUT}, {_PHASE} AS migration_phase FROM table_status", RESULTS)
def phases(f: Frames) -> DataFrame:
    return results.table_results(steps(f)).select(*KEY, "migration_phase")


@query("A-03_validation", f"SELECT {KEY_OUT}, {_VALIDATION} AS validation_status FROM table_status", RESULTS)
def validation(f: Frames) -> DataFrame:
    return results.table_results(steps(f)).select(*KEY, "validation_status")


_ORIGINAL = """CASE object_type WHEN 'ROW_FILTER' THEN '' ELSE '{"column":"' || slot || '","function":"' || fn || '"}' END"""
_CREATED = """'{"policy_name":"' || policy_name || '","on_securable":"' || on_securable || '","policy_type":"' || object_type || '"}'"""


@query("A-04_table_results", f"""
SELECT {KEY_OUT}, {_STATUS} AS status, max(CASE object_type WHEN 'ROW_FILTER' THEN status END) AS row_filter_status,
  coalesce(string_agg(CASE object_type WHEN 'COLUMN_MASK' THEN slot || '=' || status END, ',' ORDER BY slot), '') AS column_mask_status,
  coalesce(string_agg(CASE object_type WHEN 'COLUMN_MASK' THEN slot || '=' || source_function END, ',' ORDER BY slot), '') AS column_mask_functions,
  coalesce(string_agg(CASE WHEN object_type = 'COLUMN_MASK' THEN slot || '=' || target END, ',' ORDER BY slot), '') AS column_mask_policies,
  max(CASE object_type WHEN 'ROW_FILTER' THEN source_function END) AS row_filter_function, max(CASE object_type WHEN 'ROW_FILTER' THEN target END) AS row_filter_policy,
  arg_min(CASE WHEN status = 'FAILED' THEN error_code END, i) FILTER (status = 'FAILED') AS error_code,
  '{{' || rtrim(coalesce('"original_row_filter":{{"function":"' || max(CASE WHEN kept AND object_type = 'ROW_FILTER' THEN fn || '","using_columns":["' || replace(using_columns, ',', '","') || '"]}},' END), '') ||
    coalesce('"original_column_masks":[' || string_agg(CASE WHEN kept AND object_type = 'COLUMN_MASK' THEN {_ORIGINAL} END, ',' ORDER BY i) || '],', '') ||
    '"abac_policies_created_by_this_run":[' || string_agg(CASE WHEN kept THEN {_CREATED} END, ',' ORDER BY i) || ']', ',') || '}}' AS rollback_metadata
FROM (SELECT *, CASE WHEN go AND error_code IN ('RLS_TAG_COLLISION_UNRESOLVABLE', 'TAG_RESOLUTION_MISSING') THEN NULL WHEN go OR decision = 'ALREADY_MIGRATED' OR reason_code = 'EXISTING_ABAC_POLICY_CONFLICT' THEN policy_name END AS target FROM full_steps)
GROUP BY cn, sn, tn""", RESULTS)
def table_results(f: Frames) -> DataFrame:
    def pairs(c: str):
        entries = F.map_entries(c)
        return F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias(c)

    rows = results.table_results(steps(f))
    return rows.select(
        *KEY, "status", "row_filter_status", pairs("column_mask_status"), pairs("column_mask_functions"), pairs("column_mask_policies"),
        "row_filter_function", "row_filter_policy", "error_code", "rollback_metadata",
    )


@query("A-06_audit_rows", f"""
SELECT {KEY_OUT}, s.object_type, CASE s.object_type WHEN 'COLUMN_MASK' THEN s.slot END AS masked_column, s.status, s.error_code, {_VALIDATION.replace('status', 't.status', 1)} AS validation_status,
  {_PHASE.replace('status', 't.status')} AS migration_phase, kept AS can_undo, false AS dry_run
FROM full_steps s JOIN (SELECT tn AS ttn, status FROM table_status) t ON t.ttn = s.tn""", RESULTS)
def audit_rows(f: Frames) -> DataFrame:
    """Written, read back; a dry run in between writes nothing."""
    done = _full(f)
    now = F.current_timestamp()
    rows = audit.audit_rows(done, results.table_results(done), "r1", "a1", now, now, False)
    path = store.shared_folder(f.spark)
    store.append_audit(rows, path)
    store.append_audit(rows, path, dry_run=True)
    back = store.rows_for_run(store.read_table(f.spark, path, schemas.AUDIT), "r1")
    return back.select(
        *KEY, "object_type", "masked_column", "status", "error_code", "validation_status", "migration_phase",
        F.col("rollback_metadata").isNotNull().alias("can_undo"), "dry_run",
    )


_LATEST = "SELECT *, row_number() OVER (PARTITION BY tn, object_type, masked_column ORDER BY completed_at DESC, attempt_id DESC) AS n FROM audit"


@query("A-07_latest_per_object", f"SELECT {KEY_OUT}, object_type, masked_column, attempt_id, status FROM ({_LATEST}) WHERE n = 1")
def latest_per_object(f: Frames) -> DataFrame:
    return audit.latest_per_object(f.audit).select(*KEY, "object_type", "masked_column", "attempt_id", "status")


@query("A-08_latest_per_table", f"SELECT {KEY_OUT}, attempt_id, status, object_type FROM (SELECT *, row_number() OVER (PARTITION BY tn ORDER BY completed_at DESC, attempt_id DESC) AS n FROM audit) WHERE n = 1")
def latest_per_table(f: Frames) -> DataFrame:
    return audit.latest_per_table(f.audit).select(*KEY, "attempt_id", "status", "object_type")


def _kept_up(f: Frames, key: list[str]) -> DataFrame:
    """The log taken up a run at a time, the newest run first, and all of it once more."""
    latest = audit.kept_latest(ChangeLog(f.spark, store.shared_folder(f.spark)), key=tuple(key), buckets=8)
    for i in range(6, -1, -1):
        audit.keep_latest(latest, store.rows_for_run(f.audit, f"run-{i}"))
    audit.keep_latest(latest, f.audit)
    return latest.read()


@query("A-07_latest_kept_up", f"SELECT {KEY_OUT}, object_type, masked_column, attempt_id, status FROM ({_LATEST}) WHERE n = 1")
def latest_kept_up(f: Frames) -> DataFrame:
    return _kept_up(f, audit.OBJECT_KEY).select(*KEY, "object_type", "masked_column", "attempt_id", "status")


@query("A-08_latest_table_kept_up", f"SELECT {KEY_OUT}, attempt_id, status, object_type FROM (SELECT *, row_number() OVER (PARTITION BY tn ORDER BY completed_at DESC, attempt_id DESC) AS n FROM audit) WHERE n = 1")
def latest_table_kept_up(f: Frames) -> DataFrame:
    return _kept_up(f, KEY).select(*KEY, "attempt_id", "status", "object_type")


@query("A-09_rows_of_run", f"SELECT {KEY_OUT}, attempt_id, status FROM audit WHERE run_id = 'run-3'")
def rows_of_run(f: Frames) -> DataFrame:
    return store.rows_for_run(f.audit, "run-3").select(*KEY, "attempt_id", "status")


@query("A-10_failures", f"SELECT {KEY_OUT}, object_type, masked_column, attempt_id, error_code FROM audit WHERE status = 'FAILED'")
def failures(f: Frames) -> DataFrame:
    return audit.failures(f.audit).select(*KEY, "object_type", "masked_column", "attempt_id", "error_code")


@query("A-10_history", f"SELECT {KEY_OUT}, object_type, masked_column, attempt_id, status, migration_phase, error_code FROM audit")
def history(f: Frames) -> DataFrame:
    return audit.history(f.audit).drop("run_id", "completed_at")


@query("A-10_stuck_tables", f"SELECT DISTINCT {KEY_OUT} FROM ({_LATEST}) WHERE n = 1 AND migration_phase = 'ABAC_APPLIED'")
def stuck(f: Frames) -> DataFrame:
    return audit.stuck_tables(f.audit)


@query("A-10_latest_inventory", f"""
SELECT {KEY_OUT}, run_id FROM (SELECT user_id, cn, sn, tn, run_id FROM (SELECT tid AS user_id, cn, sn, tn, run_id FROM audit)) WHERE run_id = (SELECT run_id FROM audit ORDER BY completed_at DESC LIMIT 1)""")
def latest_inventory(f: Frames) -> DataFrame:
    return audit.latest_inventory(f.audit.withColumnRenamed("completed_at", "inventoried_at")).select(*KEY, "run_id")


_GRANTS = {
    "grant_log": "SELECT run_id, 'key_' || tn AS tag_key, CASE status WHEN 'FAILED' THEN 'FAILED' WHEN 'SUCCESS' THEN 'GRANTED' ELSE 'ALREADY_GRANTED' END AS status, attempt_id FROM audit"
}


def _grant_log(f: Frames) -> DataFrame:
    s = F.col("status")
    status = F.when(s == "FAILED", s).when(s == "SUCCESS", "GRANTED").otherwise("ALREADY_GRANTED")
    return f.audit.select(
        "run_id", F.concat(F.lit("key_"), "table").alias("tag_key"), status.alias("status"), "attempt_id",
        F.col("completed_at").alias("granted_at"),
    )


@query("A-10_grants_of_run", "SELECT run_id, tag_key, status, attempt_id FROM grant_log WHERE run_id = 'run-2'", _GRANTS)
def grants_of_run(f: Frames) -> DataFrame:
    return audit.grants_of_run(_grant_log(f), "run-2").drop("granted_at")


@query("A-10_failed_grants", "SELECT run_id, tag_key, status, attempt_id FROM grant_log WHERE status = 'FAILED'", _GRANTS)
def failed_grants(f: Frames) -> DataFrame:
    return audit.failed_grants(_grant_log(f)).drop("granted_at")


@query("A-11_older_audit", """
SELECT status, count(*) AS n_rows, 0 AS n_validated, count(*) FILTER (old = 0) AS n_phased, 22 AS n_columns FROM (SELECT *, event_id % 2 AS old FROM audit) GROUP BY 1""")
def older_audit(f: Frames) -> DataFrame:
    """Files written before a column was added, next to newer ones."""
    path = store.shared_folder(f.spark)
    even = F.col("attempt_id").cast("long") % 2 == 0
    f.audit.where(~even).drop("migration_phase").write.partitionBy("run_id").parquet(path)
    store.append_audit(f.audit.where(even), path)
    rows = store.read_table(f.spark, path, schemas.AUDIT)
    return rows.groupBy("status").agg(
        F.count("*").alias("n_rows"),
        F.count("validation_status").alias("n_validated"),
        F.count("migration_phase").alias("n_phased"),
        F.lit(len(rows.columns)).alias("n_columns"),
    )


_SUMMARY = """count(*) FILTER (status = 'SUCCESS') AS tables_succeeded, count(*) FILTER (status = 'ABAC_APPLIED') AS tables_abac_applied, count(*) FILTER (status LIKE 'WOULD%') AS tables_would_migrate,
  count(*) FILTER (status = 'ALREADY_MIGRATED') AS tables_already_migrated, count(*) FILTER (status = 'FAILED') AS tables_failed"""


@query("A-12_run_summary", f"SELECT {_SUMMARY} FROM table_status", RESULTS)
def run_summary(f: Frames) -> DataFrame:
    return results.run_summary(results.table_results(steps(f)))


@query("A-13_until_first_failure", f"""
SELECT {KEY_OUT}, status FROM table_status WHERE (cn, sn, tn) <= (SELECT (cn, sn, tn) FROM table_status WHERE status = 'FAILED' ORDER BY cn, sn, tn LIMIT 1)""", RESULTS)
def until_first_failure(f: Frames) -> DataFrame:
    rows = store.cut_lineage(results.table_results(steps(f)))
    return results.until_first_failure(rows).select(*KEY, "status")


# -- rollback --------------------------------------------------------------------

UNDO = {
    "undo_rows": """
SELECT *, event_id % 50 = 0 AS bad, object_type = 'ROW_FILTER' AS is_filter, event_id % 50 <> 0 AND event_id % 3 <> 1 AS full_data,
  cn || '.' || sn || '.' || CASE object_type WHEN 'ROW_FILTER' THEN 'rf_region-' || CAST(length(tn) % 11 AS VARCHAR) ELSE 'mask_email' END AS fn
FROM audit WHERE run_id = 'run-1' AND (event_id % 50 = 0 OR event_id % 3 <> 1 OR event_id % 9 = 1)""",
    "undo_steps": "SELECT u.*, CASE WHEN g.fn IS NULL THEN 'FAILED' ELSE 'ROLLED_BACK' END AS step_status FROM undo_rows u LEFT JOIN gov_functions g ON g.fn = u.fn WHERE full_data",
}


def _undo(f: Frames) -> tuple[DataFrame, DataFrame]:
    parsed = rollback.parse_metadata(f.audit_with_undo, "run-1")
    return parsed, rollback.rollback_steps(rollback.rollback_objects(parsed), f.functions)


@query("A-14_rollback_rows", f"SELECT {KEY_OUT}, attempt_id, bad FROM undo_rows", UNDO)
def rollback_rows(f: Frames) -> DataFrame:
    return rollback.parse_metadata(f.audit_with_undo, "run-1").select(*KEY, "attempt_id", "bad")


@query("A-15_rollback_steps", f"""
SELECT {KEY_OUT}, attempt_id, object_type, CASE WHEN NOT is_filter THEN masked_column END AS masked_column, fn AS function_fqn, step_status AS status,
  CASE step_status WHEN 'FAILED' THEN 'SOURCE_FUNCTION_NOT_FOUND' END AS error_code, 1 AS n_created FROM undo_steps""", UNDO)
def rollback_steps(f: Frames) -> DataFrame:
    return _undo(f)[1].select(
        *KEY, "attempt_id", "object_type", "masked_column", "function_fqn", "status", "error_code", F.size("created").alias("n_created")
    )


@query("A-15_restored_rules", f"""
SELECT {KEY_OUT}, '' AS slot, min(fn) AS function_fqn FROM undo_steps WHERE is_filter AND step_status = 'ROLLED_BACK' GROUP BY cn, sn, tn
UNION ALL SELECT cn, sn, tn, masked_column, min(fn) FROM undo_steps WHERE NOT is_filter AND step_status = 'ROLLED_BACK' GROUP BY cn, sn, tn, masked_column
UNION ALL SELECT cn, sn, tn, slot, fn FROM live_objects l WHERE NOT EXISTS (SELECT 1 FROM undo_steps u WHERE u.step_status = 'ROLLED_BACK' AND u.tn = l.tn AND coalesce(u.masked_column, '') = l.slot)""", UNDO)
def restored_rules(f: Frames) -> DataFrame:
    done = store.cut_lineage(_undo(f)[1])
    filters = rollback.restore_row_filters(f.live_row_filters, done).select(*KEY, F.lit("").alias("slot"), "function_fqn")
    return filters.unionAll(rollback.restore_masks(f.live_masks, done).select(*KEY, F.col("column").alias("slot"), "function_fqn"))


@query("A-15_dropped_policies", """
SELECT DISTINCT 'TABLE `' || cn || '`.`' || sn || '`.`' || tn || '`' AS on_securable, CASE WHEN is_filter THEN 'abac_migrated_row_filter' ELSE 'abac_migrated_mask_' || masked_column END AS policy_name
FROM undo_steps WHERE step_status = 'ROLLED_BACK'""", UNDO)
def dropped_policies(f: Frames) -> DataFrame:
    done = store.cut_lineage(_undo(f)[1])
    filters = rollback.restore_row_filters(f.live_row_filters, done)
    masks = rollback.restore_masks(f.live_masks, done)
    return rollback.droppable_policies(done, filters, masks, f.column_tags)


# per run and object: when it was last changed, and whether no rollback of that run came after
HISTORY = {
    "told": """
SELECT run_id, cn, sn, tn, object_type, coalesce(masked_column, '') AS slot, completed_at, status = 'ROLLED_BACK' AS undoing, event_id % 50 <> 0 AND event_id % 3 <> 1 AS changing FROM audit""",
    "history": """
SELECT run_id, cn, sn, tn, object_type, slot, max(completed_at) FILTER (changing) AS changed_at, coalesce(max(completed_at) FILTER (undoing) < max(completed_at) FILTER (changing), true) AS stands
FROM told GROUP BY ALL HAVING bool_or(changing)""",
}


@query("A-15_superseded", f"""
SELECT {KEY_OUT}, object_type, slot, count(*) AS n_later_runs, max_by(h.run_id, (h.changed_at, h.run_id)) AS latest_run
FROM history h JOIN (SELECT cn, sn, tn, object_type, slot, changed_at AS own_at FROM history WHERE run_id = 'run-1') USING (cn, sn, tn, object_type, slot)
WHERE h.run_id <> 'run-1' AND h.stands AND h.changed_at >= own_at GROUP BY cn, sn, tn, object_type, slot""", HISTORY)
def superseded(f: Frames) -> DataFrame:
    """Objects that undoing a run would take back beyond what later runs made of them."""
    return rollback.superseded(f.audit_with_undo, "run-1")


@query("A-15_undo_order", """
SELECT run_id, row_number() OVER (ORDER BY run_id = 'run-1', changed_at DESC, run_id DESC)::INT AS position FROM (
  WITH RECURSIVE builds(run_id) AS (
    SELECT 'run-1' UNION SELECT e.later FROM builds b JOIN (
      SELECT DISTINCT a.run_id, l.run_id AS later FROM history a JOIN history l USING (cn, sn, tn, object_type, slot) WHERE a.stands AND l.stands AND a.run_id <> l.run_id AND l.changed_at >= a.changed_at) e USING (run_id))
  SELECT run_id, (SELECT max(changed_at) FROM history h WHERE h.stands AND h.run_id = builds.run_id) AS changed_at FROM builds)""", HISTORY)
def undo_order(f: Frames) -> DataFrame:
    """Which runs to undo, and in which order, to take one back whole."""
    return rollback.undo_order(f.audit_with_undo, "run-1")


_UNDO_RESULT = "CASE WHEN bad THEN 'FAILED' WHEN NOT full_data THEN 'SKIPPED' ELSE (SELECT s.step_status FROM undo_steps s WHERE s.attempt_id = u.attempt_id) END"


@query("A-16_rollback_results", f"""
SELECT {KEY_OUT}, attempt_id, status, CASE status WHEN 'ROLLED_BACK' THEN 'ROLLED_BACK' WHEN 'FAILED' THEN 'ROLLBACK_FAILED' ELSE 'NOT_APPLICABLE' END AS migration_phase
FROM (SELECT u.*, {_UNDO_RESULT} AS status FROM (SELECT cn, sn, tn, attempt_id, bad, full_data FROM undo_rows) u)""", UNDO)
def rollback_results(f: Frames) -> DataFrame:
    parsed, done = _undo(f)
    return rollback.rollback_results(parsed, store.cut_lineage(done)).select(*KEY, "attempt_id", "status", "migration_phase")


@query("A-17_rollback_audit", f"""
SELECT {KEY_OUT}, CASE WHEN full_data THEN object_type ELSE 'NONE' END AS object_type, CASE WHEN full_data AND NOT is_filter THEN masked_column END AS masked_column, status, 'run-1' AS run_id
FROM (SELECT u.*, {_UNDO_RESULT} AS status FROM (SELECT cn, sn, tn, attempt_id, bad, full_data, is_filter, object_type, masked_column FROM undo_rows) u)""", UNDO)
def rollback_audit(f: Frames) -> DataFrame:
    parsed, done = _undo(f)
    done = store.cut_lineage(done)
    now = F.current_timestamp()
    rows = rollback.rollback_audit_rows(rollback.rollback_results(parsed, done), done, "run-1", "a1", now, now, False)
    return rows.select(*KEY, "object_type", "masked_column", "status", "run_id")


# -- verification ------------------------------------------------------------------

VERIFY = {
    "verified": """
SELECT tid, cn, sn, tn, object_type, slot, CASE WHEN fn IS NOT NULL AND pfn IS NULL THEN 'FAILED' WHEN fn IS NOT NULL THEN 'ABAC_APPLIED' ELSE 'SUCCESS' END AS status,
  CASE WHEN fn IS NOT NULL AND pfn IS NULL THEN 'POLICY_VERIFY_FAILED' END AS error_code, pfn AS source_function, policy_name FROM (
  SELECT coalesce(l.tid, p.tid) AS tid, coalesce(l.cn, p.cn) AS cn, coalesce(l.sn, p.sn) AS sn, coalesce(l.tn, p.tn) AS tn, coalesce(l.object_type, p.object_type) AS object_type, coalesce(l.slot, p.slot) AS slot,
    l.fn, p.pfn, coalesce(p.policy_name, 'abac_migrated_row_filter') AS policy_name
  FROM live_objects l FULL JOIN table_policies p ON l.tn = p.tn AND l.object_type = p.object_type AND l.slot = p.slot) WHERE object_type = 'ROW_FILTER' OR pfn IS NOT NULL""",
    "verified_tables": """
SELECT t.tid, t.cn, t.sn, t.tn, CASE WHEN count(v.status) = 0 THEN 'NOT_ELIGIBLE' WHEN bool_or(v.status = 'FAILED') THEN 'FAILED' WHEN bool_or(v.status = 'ABAC_APPLIED') THEN 'ABAC_APPLIED' ELSE 'SUCCESS' END AS status, max(v.error_code) AS error_code
FROM gov_tables t LEFT JOIN verified v ON v.tid = t.tid GROUP BY 1, 2, 3, 4""",
    "last_audit": "SELECT tn, status FROM (SELECT *, row_number() OVER (PARTITION BY tn ORDER BY completed_at DESC, attempt_id DESC) AS n FROM audit) WHERE n = 1",
}
_VERIFY_OUT = f"SELECT {KEY_OUT}, slot, status, error_code, source_function, policy_name AS target_policy_name FROM verified"


def _verify_rows(df: DataFrame) -> DataFrame:
    return df.select(*KEY, F.coalesce("masked_column", F.lit("")).alias("slot"), "status", "error_code", "source_function", "target_policy_name")


@query("V-01_verify_row_filters", f"{_VERIFY_OUT} WHERE object_type = 'ROW_FILTER'", VERIFY)
def verify_row_filters(f: Frames) -> DataFrame:
    s = f.state()
    return _verify_rows(verify.verify_row_filters(s.row_filters, existing_of(s, TABLE), s.policies))


@query("V-02_verify_masks", f"{_VERIFY_OUT} WHERE object_type = 'COLUMN_MASK'", VERIFY)
def verify_masks(f: Frames) -> DataFrame:
    s = f.state()
    return _verify_rows(verify.verify_masks(s.masks, existing_of(s, TABLE)))


@query("V-03_verify_tables", f"SELECT {KEY_OUT}, status, error_code FROM verified_tables", VERIFY)
def verify_tables(f: Frames) -> DataFrame:
    s = f.state()
    return verify_run(s.tables, s, TABLE)


@query("V-03_verify_tables_catalog", f"SELECT {KEY_OUT}, status, error_code FROM verified_tables", {
    **VERIFY,
    "verified": """
SELECT coalesce(l.tid, m.tid) AS tid, CASE WHEN l.fn IS NOT NULL AND c.pfn IS NULL THEN 'FAILED' WHEN l.fn IS NOT NULL THEN 'ABAC_APPLIED' ELSE 'SUCCESS' END AS status,
  CASE WHEN l.fn IS NOT NULL AND c.pfn IS NULL THEN 'POLICY_VERIFY_FAILED' END AS error_code
FROM live_objects l FULL JOIN migrated m ON l.tn = m.tn AND l.object_type = m.object_type AND l.slot = m.slot LEFT JOIN catalog_policies c ON c.cn = coalesce(l.cn, m.cn) AND c.tkey = coalesce(l.tkey, m.tkey)
WHERE coalesce(l.object_type, m.object_type) = 'ROW_FILTER' OR m.fn IS NOT NULL"""})  # fmt: skip
def verify_tables_catalog(f: Frames) -> DataFrame:
    s = f.state("CATALOG")
    return verify_run(s.tables, s, CATALOG)


# Tags taken off two tables in five after the policies were made.
_LOST = "tid % 5 IN (1, 2)"
_UNCOVERED = {
    **VERIFY,
    "verified": VERIFY["verified"].replace("CASE WHEN fn IS NOT NULL AND pfn IS NULL THEN", f"CASE WHEN {_LOST} OR (fn IS NOT NULL AND pfn IS NULL) THEN"),
}


def _losing_tags(f: Frames) -> GovernanceState:
    s = f.state()
    return replace(s, column_tags=s.column_tags.where(~(F.substr("table", F.lit(3)).cast("int") % 5).isin(1, 2)))


@query("V-03_uncovered", f"SELECT {KEY_OUT}, status, error_code FROM verified_tables", _UNCOVERED)
def verify_uncovered(f: Frames) -> DataFrame:
    """Tables whose policies are there by name, but whose tags are gone in part: such a policy does not count."""
    s = _losing_tags(f)
    return verify_run(s.tables, s, TABLE)


@query("V-04_drift_uncovered", f"""
SELECT {KEY_OUT}, v.error_code AS reason FROM verified_tables v JOIN last_audit USING (tn) WHERE last_audit.status IN ('SUCCESS', 'ALREADY_MIGRATED') AND v.status = 'FAILED'""", _UNCOVERED)
def drift_uncovered(f: Frames) -> DataFrame:
    s = _losing_tags(f)
    found = verify.detect_drift(s.tables, f.audit, verify_run(s.tables, s, TABLE))
    return found.where("drift_detected AND reason = 'POLICY_VERIFY_FAILED'").select(*KEY, "reason")


@query("V-04_drift", f"""
SELECT {KEY_OUT}, coalesce(a.status IN ('SUCCESS', 'ALREADY_MIGRATED') AND v.status <> 'SUCCESS', false) AS drift_detected,
  CASE WHEN a.status IS NULL THEN 'NEVER_MIGRATED_BY_THIS_UTILITY' WHEN a.status NOT IN ('SUCCESS', 'ALREADY_MIGRATED') THEN 'LAST_RUN_WAS_NOT_SUCCESSFUL' WHEN v.status = 'SUCCESS' THEN 'LIVE_STATE_MATCHES_AUDIT'
       ELSE coalesce(v.error_code, 'LIVE_STATE_DOES_NOT_MATCH_AUDIT') END AS reason
FROM (SELECT tid, cn, sn, tn, status, error_code, tn AS vtn FROM verified_tables) v LEFT JOIN (SELECT tn AS atn, status FROM last_audit) a ON a.atn = v.vtn""", VERIFY)
def drift(f: Frames) -> DataFrame:
    s = f.state()
    return verify.detect_drift(s.tables, f.audit, verify_run(s.tables, s, TABLE))


# -- whole runs ----------------------------------------------------------------------


def _options(f: Frames, mode: str, run_id: str, folder: str, **kw) -> RunOptions:
    return RunOptions(
        mode=mode, scope_type="ALL_CATALOGS", dry_run=False, run_id=run_id, audit_path=f"{folder}/audit",
        inventory_path=f"{folder}/inventory", tag_grants_path=f"{folder}/tag_grants", **kw,
    )


_CLEAN = {
    **RESULTS,
    "clean_steps": f"""
SELECT *, CASE WHEN NOT go THEN decision WHEN untagged THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM objects o WHERE EXISTS (SELECT 1 FROM eligible e WHERE e.tn = o.tn)""",
    "planned": STEPS["planned"] + " WHERE coalesce(l.tn, p.tn) IN (SELECT tn FROM eligible)",
}


@query("RUN_migrate", f"SELECT status, count(*) AS n_tables FROM (SELECT tn, {_STATUS} AS status FROM clean_steps GROUP BY tn) GROUP BY 1", _CLEAN)
def run_migrate(f: Frames) -> DataFrame:
    """Inventory, tags, policies, steps, audit and new state of every table, in one run."""
    done = run(f.state(), _options(f, "MIGRATE", "m1", store.shared_folder(f.spark)))
    return done.results.groupBy("status").agg(F.count("*").alias("n_tables"))


@query("P-14_stored_run", f"""
SELECT 'policy' AS what, on_securable, policy_name AS name, object_type AS kind, fn AS function_fqn FROM clean_steps WHERE status = 'SUCCESS' AND go
UNION ALL SELECT 'policy', on_securable, policy_name, object_type, pfn FROM table_policies p WHERE NOT EXISTS (SELECT 1 FROM clean_steps s WHERE s.go AND s.status = 'SUCCESS' AND s.on_securable = p.on_securable AND s.policy_name = p.policy_name)
UNION ALL SELECT 'old rule', cn || '.' || sn || '.' || tn, slot, object_type, fn FROM live_objects l WHERE NOT EXISTS (SELECT 1 FROM clean_steps s WHERE s.go AND s.status = 'SUCCESS' AND s.tn = l.tn AND s.slot = l.slot)""", _CLEAN)
def stored_run(f: Frames) -> DataFrame:
    """Policies and old rules after a run that commits its changes to a store, folded in and cleared of older versions."""
    folder = store.shared_folder(f.spark)
    kept = StateStore(f.spark, f"{folder}/state", buckets=8)
    run(stored_state(f.state(), kept), _options(f, "MIGRATE", "m1", folder))
    kept.compact()
    kept.vacuum()
    fqn = F.concat_ws(".", *KEY).alias("on_securable")
    filters = kept.read("row_filters").select(F.lit("old rule").alias("what"), fqn, F.lit("").alias("name"), F.lit("ROW_FILTER").alias("kind"), "function_fqn")
    masks = kept.read("masks").select(F.lit("old rule"), fqn, "column", F.lit("COLUMN_MASK"), "function_fqn")
    return kept.read("policies").select(F.lit("policy"), "on_securable", "policy_name", "policy_type", "function_fqn").unionAll(filters).unionAll(masks).toDF(*filters.columns)


_CATALOG_RUN = {
    **ELIGIBLE,
    **SHARED,
    "cat_planned": SHARED["cat_planned"] + " WHERE coalesce(l.tn, m.tn) IN (SELECT tn FROM eligible)",
}


@query("RUN_migrate_catalog", f"SELECT {KEY_OUT}, object_type, slot, policy_name FROM cat_steps", _CATALOG_RUN)
def run_migrate_catalog(f: Frames) -> DataFrame:
    """Every object that a run at catalog scope migrated, with the policy that acts on it in the state after the run."""
    done = run(f.state("CATALOG"), _options(f, "MIGRATE", "m1", store.shared_folder(f.spark), policy_scope="CATALOG"))
    acting = verify.covered_objects(done.state.policies, done.state.column_tags)
    migrated = done.steps.where("status = 'SUCCESS' AND decision = 'PROCEED'").select(*KEY, "object_type", "slot", "policy_name")
    return migrated.join(acting.select(*KEY, "policy_name", "slot").distinct(), [*KEY, "policy_name", "slot"])


@query("RUN_finalize_without_tag", f"""
SELECT object_type, CASE WHEN {_LOST} THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN {_LOST} THEN 'POLICY_VERIFY_FAILED' END AS error_code, count(*) AS n_objects,
  count(*) FILTER ({_LOST}) AS n_old_rules_left
FROM planned WHERE decision = 'PROCEED' AND applied AND tn IN (SELECT tn FROM eligible) GROUP BY 1, 2, 3""", {**RESULTS, **PLANNED})
def run_finalize_without_tag(f: Frames) -> DataFrame:
    """FINALIZE where some tags are gone: an old rule goes only where its policy acts on the object."""
    done = run(_losing_tags(f), _options(f, "FINALIZE", "m1", store.shared_folder(f.spark)))
    left = done.state.row_filters.select(*KEY, F.lit("").alias("slot")).unionAll(done.state.masks.select(*KEY, F.col("column").alias("slot")))
    left = left.withColumn("left", F.lit(1))
    relied = done.steps.where("decision = 'PROCEED' AND abac_already_applied").join(left, [*KEY, "slot"], "left")
    return relied.groupBy("object_type", "status", "error_code").agg(F.count("*").alias("n_objects"), F.count("left").alias("n_old_rules_left"))


@query("RUN_stop_at_failure", """
SELECT 'changed without audit row' AS what, 0 AS n UNION ALL SELECT 'recorded tables', count(*) FROM (SELECT tn FROM clean_status WHERE (cn, sn, tn) <= (SELECT min((cn, sn, tn)) FROM clean_status WHERE status = 'FAILED'))""",
    {**_CLEAN, "clean_status": f"SELECT cn, sn, tn, {_STATUS} AS status FROM clean_steps GROUP BY cn, sn, tn"})
def run_stop_at_failure(f: Frames) -> DataFrame:
    """A run that stops at the first failed table changes nothing that its audit log does not hold."""
    state = f.state()
    done = run(state, _options(f, "MIGRATE", "m1", store.shared_folder(f.spark), continue_on_error=False))
    key = [*KEY, "slot"]

    def rules(s: GovernanceState) -> DataFrame:
        return s.row_filters.select(*KEY, F.lit("").alias("slot")).unionAll(s.masks.select(*KEY, F.col("column").alias("slot")))

    gone = rules(state).join(rules(done.state), key, "left_anti")
    logged = done.audit.select(*KEY, F.coalesce("masked_column", F.lit("")).alias("slot"))
    return gone.join(logged, key, "left_anti").agg(F.lit("changed without audit row").alias("what"), F.count("*").alias("n")).unionAll(
        done.audit.select(*KEY).distinct().agg(F.lit("recorded tables").alias("what"), F.count("*").alias("n"))
    )


@query("RUN_migrate_then_rollback", """
SELECT 'different' AS what, 0 AS n UNION ALL SELECT 'restored', count(*) FROM clean_steps WHERE status = 'SUCCESS'""", _CLEAN)
def run_rollback(f: Frames) -> DataFrame:
    """Rolling a run back restores exactly the old rules it removed."""
    folder, state = store.shared_folder(f.spark), f.state()
    moved = run(state, _options(f, "MIGRATE", "m1", folder)).state
    back = run(moved, _options(f, "ROLLBACK", "m1", folder))

    def rules(s: GovernanceState, sign: int) -> DataFrame:
        filters = s.row_filters.select(*KEY, F.lit("").alias("slot"), "function_fqn", F.array_join("using_columns", ",").alias("cols"))
        masks = s.masks.select(*KEY, F.col("column").alias("slot"), "function_fqn", F.lit("").alias("cols"))
        return filters.unionAll(masks).withColumn("sign", F.lit(sign))

    signed = rules(state, 1).unionAll(rules(back.state, -1))
    differ = signed.groupBy(*KEY, "slot", "function_fqn", "cols").agg(F.sum("sign").alias("d")).where("d <> 0")
    return differ.agg(F.lit("different").alias("what"), F.count("*").alias("n")).unionAll(
        back.steps.where("status = 'ROLLED_BACK'").agg(F.lit("restored").alias("what"), F.count("*").alias("n"))
    )


# -- generated data --------------------------------------------------------------------


@query("G-01_generated_orders", """
SELECT CASE WHEN (o_orderkey + 1) % 2 = 0 THEN 'Retail' ELSE 'O2C' END AS business_unit, count(*) AS n_orders, count(*) AS n_payments, 0 AS n_unit_mismatch, 0 AS n_amount_mismatch, true AS quantities_in_range FROM orders GROUP BY 1""")
def generated_orders(f: Frames) -> DataFrame:
    """As many generated rows as the test tables have, orders checked against their customers, reps and products."""

    def ids(table: str, key: str) -> DataFrame:
        return f.read(table).select((F.col(key) + 1).alias("id"))

    people, reps, goods = ids("customer", "c_custkey"), ids("supplier", "s_suppkey"), ids("part", "p_partkey")
    data = generate.DemoData("cat-0", n_customers=people.count(), n_reps=reps.count(), n_products=goods.count())
    orders = data.orders(ids("orders", "o_orderkey"))
    payments = data.payments(orders).groupBy("business_unit").agg(F.count("*").alias("n_payments"))

    def units(df: DataFrame, key: str, alias: str, *more: str) -> DataFrame:
        return df.select(key, F.col("business_unit").alias(alias), *more)

    joined = (
        orders.join(units(data.customers(people), "customer_id", "cu"), "customer_id", "left")
        .join(units(data.sales_reps(reps), "rep_id", "ru"), "rep_id", "left")
        .join(units(data.products(goods), "product_id", "pu", "unit_price"), "product_id", "left")
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("business_unit")) for c in ("cu", "ru", "pu")])
    amount = (F.col("quantity") * F.col("unit_price")).cast("decimal(14,2)")
    return (
        joined.groupBy("business_unit")
        .agg(
            F.count("*").alias("n_orders"),
            F.count_if(~same).alias("n_unit_mismatch"),
            F.count_if(~F.col("order_amount").eqNullSafe(amount)).alias("n_amount_mismatch"),
            F.bool_and(F.col("quantity").between(1, 20)).alias("quantities_in_range"),
        )
        .join(payments, "business_unit")
    )


@query("G-01_generated_customers", """
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Retail' ELSE 'O2C' END AS business_unit, count(*) AS n_customers, count(*) AS n_well_formed FROM customer GROUP BY 1""")
def generated_customers(f: Frames) -> DataFrame:
    rows = generate.DemoData("cat-0").customers(f.read("customer").select(F.col("c_custkey").alias("id")))
    fine = (
        F.col("email").rlike("^[a-z]+\\.[a-z]+[0-9]{1,3}@(shop|partner)\\.example$")
        & F.col("phone_number").rlike("^\\+91[6-9][0-9]{9}$")
        & F.col("pan_number").rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")
        & F.col("aadhaar_number").rlike("^[0-9]{12}$")
        & F.col("signup_date").between("2024-01-01", "2024-12-28")
    )
    return rows.groupBy("business_unit").agg(F.count("*").alias("n_customers"), F.count_if(fine).alias("n_well_formed"))


@query("G-02_membership", "SELECT group_name, member_email FROM membership")
def membership(f: Frames) -> DataFrame:
    """Seeded by overwriting: writing twice leaves one copy."""
    path = store.shared_folder(f.spark)
    rows = f.membership
    store.refresh_snapshot(rows, path)
    return store.refresh_snapshot(rows, path)


_MATRIX_TABLES = """
SELECT tid, cn, CASE tid % 3 WHEN 0 THEN 'managed' WHEN 1 THEN 'streaming' ELSE 'mv' END AS kind, CASE tid // 3 % 3 WHEN 0 THEN 'rls' WHEN 1 THEN 'mask' ELSE 'both' END AS flavour FROM gov_tables"""


@query("G-03_matrix_run", f"""
SELECT kind, flavour, 'SUCCESS' AS status, count(*) AS n_tables, CAST(sum(CASE flavour WHEN 'both' THEN 2 ELSE 1 END) AS BIGINT) AS n_steps FROM ({_MATRIX_TABLES}) GROUP BY 1, 2""")
def matrix_run(f: Frames) -> DataFrame:
    """Every table kind with a filter, a mask or both: all reach SUCCESS."""
    tid = F.col("tid")
    kinds, flavours = list(generate.MATRIX_KINDS), list(generate.MATRIX_FLAVOURS)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (tid % 3 + 1).cast("int"))
    flavour = F.element_at(F.array(*[F.lit(k) for k in flavours]), (F.floor(tid / 3) % 3 + 1).cast("int"))
    types = F.element_at(F.create_map(*[F.lit(x) for kv in generate.MATRIX_KINDS.items() for x in kv]), kind)
    tables = f.tables.select(
        "catalog", "schema", F.concat_ws("_", kind, flavour, tid.cast("string")).alias("table"),
        types.alias("table_type"), F.lit(None).cast("string").alias("describe_error"),
    )
    # a small file of part keys gives long rows: dealt to all cores once, not worked out by a task or two in every step
    tables = f.stored("matrix_tables", lambda: tables.repartition(f.spark.sparkContext.defaultParallelism))
    filters, masks = generate.matrix(tables)
    known = filters.select("function_fqn").unionAll(masks.select("function_fqn")).distinct()
    spark = f.spark
    state = GovernanceState(
        tables, filters, masks, schemas.empty(spark, schemas.POLICIES), schemas.empty(spark, schemas.COLUMN_TAGS),
        schemas.empty(spark, schemas.GOVERNED_TAGS), known.withColumn("executable", F.lit(True)),
    )
    done = run(state, _options(f, "MIGRATE", "m1", store.shared_folder(spark)))
    parts = F.split("table", "_")
    return done.results.groupBy(parts[0].alias("kind"), parts[1].alias("flavour"), "status").agg(
        F.count("*").alias("n_tables"), F.sum("n_steps").alias("n_steps")
    )
