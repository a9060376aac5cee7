"""The same derived state as SQL for the check engine, written from the rules."""

from __future__ import annotations

import re

# name -> body; a body may use any name above it.
CTES: dict[str, str] = {
    "sec_customers": """
SELECT c_custkey, c_name,
  CASE WHEN c_custkey % 97 = 0 THEN 'no-at-sign' WHEN c_custkey % 89 = 0 THEN NULL
       ELSE lower(replace(c_name, '#', '.')) || '@' || CASE WHEN c_nationkey % 2 = 0 THEN 'a.example' ELSE 'b.example' END END AS email,
  '+91' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS phone, c_acctbal, c_mktsegment AS business_unit FROM customer""",
    "membership": """
SELECT DISTINCT group_name, member_email FROM (
  SELECT 'bu_' || c_mktsegment AS group_name, c_name AS member_email FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT 'bu_BUILDING', c_name FROM customer WHERE c_custkey % 20 = 0
  UNION ALL SELECT 'admins', c_name FROM customer WHERE c_custkey % 500 = 7
  UNION ALL SELECT CASE c_custkey % 3 WHEN 0 THEN 'rf_A' WHEN 1 THEN 'rf_N' ELSE 'rf_R' END, c_name FROM customer WHERE c_custkey % 10 = 3)""",
    "gov_tables": """
SELECT p_partkey AS tid, 'cat-' || CAST(p_partkey % 5 AS VARCHAR) AS cn, 's_' || CAST(p_partkey % 20 AS VARCHAR) AS sn,
  't_' || CAST(p_partkey AS VARCHAR) AS tn,
  CASE p_partkey % 7 WHEN 3 THEN 'EXTERNAL' WHEN 4 THEN 'STREAMING_TABLE' WHEN 5 THEN 'MATERIALIZED_VIEW' WHEN 6 THEN 'VIEW' ELSE 'MANAGED' END AS table_type,
  CASE WHEN p_partkey % 97 = 0 THEN 'BAD_REQUEST PERMISSION_DENIED on table' WHEN p_partkey % 101 = 0 THEN 'BAD_REQUEST FAILED_JDBC.CONNECTION'
       WHEN p_partkey % 103 = 0 THEN '[DATA_SOURCE_NOT_FOUND] unsupported' WHEN p_partkey % 107 = 0 THEN 'boom' END AS describe_error
FROM part""",
    "gov_filters": """
SELECT tid, cn, sn, tn, cn || '.' || sn || '.rf_region-' || CAST(tid % 11 AS VARCHAR) AS fn, 'rf_region_' || CAST(tid % 11 AS VARCHAR) AS fn_clean,
  tid % 13 = 0 AS two_columns, CASE WHEN tid % 13 = 0 THEN 'region,business_unit' ELSE 'region' END AS using_columns
FROM gov_tables WHERE tid % 3 = 0 AND describe_error IS NULL""",
    "gov_masks": """
SELECT t.tid, t.cn, t.sn, t.tn, c.i, c.col, t.cn || '.' || t.sn || '.' || c.fname AS fn, c.fname AS fn_clean
FROM gov_tables t JOIN (VALUES (0, 'email', 'mask_email'), (1, 'phone', 'mask_phone'), (2, 'ssn', 'mask_redact'), (3, 'card', 'mask_redact')) c(i, col, fname)
  ON (t.tid + c.i) % 4 IN (0, 1) WHERE t.tid % 5 <> 4 AND t.describe_error IS NULL""",
    "gov_objects": """
SELECT tid, cn, sn, tn, 'ROW_FILTER' AS object_type, '' AS slot, fn, using_columns, -1 AS i,
  'abac_rls_' || replace(cn, '-', '_') || '_' || sn || '_' || fn_clean AS tkey FROM gov_filters
UNION ALL SELECT tid, cn, sn, tn, 'COLUMN_MASK', col, fn, '', i, 'abac_colmask_' || replace(cn, '-', '_') || '_' || sn || '_' || fn_clean FROM gov_masks""",
    "fn_first": "SELECT fn, min(tid) AS first_tid FROM gov_objects GROUP BY fn",
    "gov_functions": "SELECT fn, first_tid % 23 <> 0 AS executable FROM fn_first WHERE first_tid % 19 <> 0",
    "live_objects": "SELECT * FROM gov_objects WHERE tid % 4 <> 0",
    "migrated": "SELECT *, CASE WHEN tid % 17 = 0 THEN fn || '_old' ELSE fn END AS pfn FROM gov_objects WHERE tid % 4 < 2",
    "table_policies": """
SELECT 'TABLE `' || cn || '`.`' || sn || '`.`' || tn || '`' AS on_securable,
  CASE object_type WHEN 'ROW_FILTER' THEN 'abac_migrated_row_filter' ELSE 'abac_migrated_mask_' || slot END AS policy_name, * FROM migrated""",
    "catalog_policies": """
SELECT 'CATALOG `' || cn || '`' AS on_securable, tkey AS policy_name, cn, object_type, tkey, arg_min(pfn, tid * 10 + i + 1) AS pfn,
  arg_min(slot, (tid, slot)) AS slot
FROM migrated GROUP BY cn, object_type, tkey""",
    "raw_tags": """
SELECT cn, sn, tn, CASE object_type WHEN 'ROW_FILTER' THEN 'region' ELSE slot END AS col, tkey, '' AS tval FROM migrated
UNION ALL SELECT cn, sn, tn, 'business_unit', tkey, '' FROM migrated WHERE object_type = 'ROW_FILTER' AND tid % 13 = 0
UNION ALL SELECT cn, sn, tn, col, 'pii_' || col, CASE WHEN tid % 2 = 1 THEN '' WHEN tid % 8 = 2 THEN 'odd' ELSE 'high' END FROM gov_masks WHERE tid % 4 >= 2
UNION ALL SELECT cn, sn, tn, 'backup_' || col, 'pii_' || col, CASE WHEN tid % 2 = 1 THEN '' WHEN tid % 8 = 2 THEN 'odd' ELSE 'high' END FROM gov_masks WHERE tid % 4 >= 2 AND tid % 10 = 2""",
    "tags": "SELECT cn, sn, tn, col, tkey, nullif(tval, '') AS tval FROM raw_tags",
    "governed": """
SELECT DISTINCT 'pii_' || col AS tkey, CASE col WHEN 'ssn' THEN '' ELSE 'high,low' END AS allowed, 'by hand' AS descr FROM gov_masks WHERE col <> 'card'
UNION ALL SELECT tkey, '', CASE WHEN length(tkey) % 7 = 0 THEN 'by hand' ELSE 'Governs columns formerly protected by function ' || min(fn) END FROM migrated GROUP BY tkey""",
    "audit": """
SELECT 'run-' || CAST(event_id % 7 AS VARCHAR) AS run_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS attempt_id, event_id, user_id AS tid,
  'cat-' || CAST(user_id % 5 AS VARCHAR) AS cn, 's_' || CAST(user_id % 20 AS VARCHAR) AS sn, 't_' || CAST(user_id AS VARCHAR) AS tn,
  CASE WHEN event_type IN ('view', 'click') THEN 'ROW_FILTER' ELSE 'COLUMN_MASK' END AS object_type,
  CASE event_type WHEN 'error' THEN 'email' WHEN 'purchase' THEN 'phone' WHEN 'signup' THEN 'ssn' END AS masked_column,
  CASE event_id % 6 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'ABAC_APPLIED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'ALREADY_MIGRATED' WHEN 4 THEN 'NOT_ELIGIBLE' ELSE 'ROLLED_BACK' END AS status,
  CASE WHEN event_id % 6 = 2 THEN 'POLICY_VERIFY_FAILED' END AS error_code,
  CASE event_id % 6 WHEN 0 THEN 'FINALIZED' WHEN 1 THEN 'ABAC_APPLIED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'FINALIZED' ELSE 'NOT_APPLICABLE' END AS migration_phase,
  ts AS completed_at FROM events""",
}

# How the check engine reads the three-part key of a table.
KEY_OUT = 'cn AS "catalog", sn AS "schema", tn AS "table"'


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """*sql* preceded by the CTEs that it uses, directly or through others."""
    bodies = {**CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in bodies.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    used = [f"{n} AS ({b.strip()})" for n, b in bodies.items() if n in needed]
    return ("WITH " + ",\n".join(used) + "\n" if used else "") + sql.strip()
