"""Tags, policies and decisions over the half-migrated catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import names
from tablewarden.functions.names import KEY
from tablewarden.operators import decide, policies, tags
from tablewarden.plans.options import RunOptions
from tablewarden.plans.run import (
    existing_of,
    migration_steps,
    next_state,
    planned_objects,
    resolved_tags,
)
from tablewarden.sources.store import cut_lineage
from workload.ctes import KEY_OUT
from workload.frames import Frames
from workload.registry import query

TABLE = RunOptions(mode="MIGRATE", scope_type="ALL_CATALOGS", dry_run=True, run_id="r1")
CATALOG = RunOptions(mode="MIGRATE", scope_type="ALL_CATALOGS", dry_run=True, policy_scope="CATALOG", run_id="r1")

DESCRIPTION = "'Governs columns formerly protected by function '"

_DECISION = """CASE WHEN l.fn IS NULL THEN 'ALREADY_MIGRATED' WHEN g.fn IS NULL OR NOT g.executable THEN 'FAILED' WHEN {d} <> l.fn THEN 'NOT_ELIGIBLE' ELSE 'PROCEED' END AS decision,
  CASE WHEN l.fn IS NULL THEN NULL WHEN g.fn IS NULL THEN 'SOURCE_FUNCTION_NOT_FOUND' WHEN NOT g.executable THEN 'SOURCE_FUNCTION_NOT_ACCESSIBLE' WHEN {d} <> l.fn THEN 'EXISTING_ABAC_POLICY_CONFLICT' END AS reason_code"""

PLANNED = {
    "planned": f"""
SELECT coalesce(l.tid, p.tid) AS tid, coalesce(l.cn, p.cn) AS cn, coalesce(l.sn, p.sn) AS sn, coalesce(l.tn, p.tn) AS tn, coalesce(l.object_type, p.object_type) AS object_type,
  coalesce(l.slot, p.slot) AS slot, l.fn, p.pfn, coalesce(l.fn, p.pfn) AS source_function, coalesce(l.using_columns, '') AS using_columns, coalesce(l.i, 99) AS i, l.tkey,
  l.fn IS NOT NULL AND p.pfn IS NOT NULL AS applied, {_DECISION.format(d='p.pfn')},
  CASE coalesce(l.object_type, p.object_type) WHEN 'ROW_FILTER' THEN 'abac_migrated_row_filter' ELSE 'abac_migrated_mask_' || coalesce(l.slot, p.slot) END AS policy_name,
  'TABLE `' || coalesce(l.cn, p.cn) || '`.`' || coalesce(l.sn, p.sn) || '`.`' || coalesce(l.tn, p.tn) || '`' AS on_securable
FROM live_objects l FULL JOIN table_policies p ON l.tn = p.tn AND l.object_type = p.object_type AND l.slot = p.slot LEFT JOIN gov_functions g ON g.fn = l.fn""",
    "cat_planned": f"""
SELECT coalesce(l.cn, m.cn) AS cn, coalesce(l.sn, m.sn) AS sn, coalesce(l.tn, m.tn) AS tn, coalesce(l.object_type, m.object_type) AS object_type, coalesce(l.slot, m.slot) AS slot,
  coalesce(l.fn, e.pfn) AS source_function, coalesce(l.tkey, m.tkey) AS policy_name, l.fn IS NOT NULL AND c.pfn IS NOT NULL AS applied, {_DECISION.format(d='c.pfn')}
FROM live_objects l FULL JOIN migrated m ON l.tn = m.tn AND l.object_type = m.object_type AND l.slot = m.slot
LEFT JOIN catalog_policies e ON e.cn = m.cn AND e.tkey = m.tkey LEFT JOIN catalog_policies c ON c.cn = l.cn AND c.tkey = l.tkey LEFT JOIN gov_functions g ON g.fn = l.fn""",
    "requests": """
SELECT cn, sn, tn, unnest(string_split(using_columns, ',')) AS col, 'row_filter' AS req_role, fn, tkey FROM planned WHERE decision = 'PROCEED' AND object_type = 'ROW_FILTER'
UNION ALL SELECT cn, sn, tn, slot, 'mask', fn, tkey FROM planned WHERE decision = 'PROCEED' AND object_type = 'COLUMN_MASK'""",
    "reusable": """
SELECT tn, col, tkey AS rk, tval AS rv FROM (
  SELECT s.*, row_number() OVER (PARTITION BY tn, col ORDER BY s.tkey, tval NULLS FIRST) AS n
  FROM (SELECT tn, tkey, tval, min(col) AS col FROM tags GROUP BY tn, tkey, tval HAVING min(col) = max(col)) s JOIN governed g ON g.tkey = s.tkey
  WHERE g.allowed = '' OR coalesce(list_contains(string_split(g.allowed, ','), s.tval), false)) WHERE n = 1""",
    "asked": "SELECT r.*, u.rk, u.rv FROM requests r LEFT JOIN reusable u ON r.tn = u.tn AND r.col = u.col",
    "to_mint": "SELECT * FROM asked WHERE rk IS NULL",
    "crowded": "SELECT tn, tkey FROM (SELECT tn, tkey, col FROM to_mint UNION ALL SELECT tn, tkey, col FROM tags) GROUP BY tn, tkey HAVING count(DISTINCT col) > 1",
    "key_err": f"""
SELECT m.tkey, CASE WHEN count(DISTINCT m.fn) > 1 THEN 'TAG_KEY_SHARED_BY_FUNCTIONS' ELSE 'TAG_KEY_TAKEN' END AS error_code FROM to_mint m LEFT JOIN governed g ON g.tkey = m.tkey
GROUP BY m.tkey HAVING count(DISTINCT m.fn) > 1 OR bool_or(g.descr <> {DESCRIPTION} || m.fn)""",
    "resolved": """
SELECT cn, sn, tn, col, req_role, fn, rk AS tkey, rv AS tval, 'REUSED' AS resolution FROM asked WHERE rk IS NOT NULL
UNION ALL SELECT m.cn, m.sn, m.tn, m.col, m.req_role, m.fn, m.tkey, NULL, CASE WHEN e.tkey IS NOT NULL THEN 'KEY_ERROR' WHEN c.tn IS NOT NULL AND req_role = 'row_filter' THEN 'SKIPPED' ELSE 'MINTED' END
FROM to_mint m LEFT JOIN key_err e ON e.tkey = m.tkey LEFT JOIN crowded c ON c.tn = m.tn AND c.tkey = m.tkey""",
    "usable_tags": "SELECT * FROM resolved WHERE resolution IN ('REUSED', 'MINTED')",
    "objects": """
SELECT p.*, decision = 'PROCEED' AS go,
  CASE p.object_type WHEN 'ROW_FILTER' THEN len(string_split(p.using_columns, ',')) ELSE 1 END >
    (SELECT count(*) FROM usable_tags u WHERE u.tn = p.tn AND ((p.object_type = 'ROW_FILTER' AND u.req_role = 'row_filter') OR (p.object_type = 'COLUMN_MASK' AND u.req_role = 'mask' AND u.col = p.slot))) AS untagged,
  tid % 37 = 0 AS f_create, tid % 41 = 0 AS f_verify, tid % 43 = 0 AS f_remove, tid % 47 = 0 AS f_remains
FROM planned p""",
}

_UNTAGGED = "CASE object_type WHEN 'ROW_FILTER' THEN 'RLS_TAG_COLLISION_UNRESOLVABLE' ELSE 'TAG_RESOLUTION_MISSING' END"
_CREATE_CODE = "CASE WHEN tid % 2 = 0 THEN 'INVALID_STATE' ELSE 'POLICY_CREATE_FAILED' END"

STEP_SQL = {
    "full_steps": f"""
SELECT *, CASE WHEN NOT go THEN decision WHEN untagged OR f_create OR f_verify OR f_remove OR f_remains THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN NOT go THEN reason_code WHEN untagged THEN {_UNTAGGED} WHEN f_create THEN {_CREATE_CODE} WHEN f_verify THEN 'POLICY_VERIFY_FAILED' WHEN f_remove THEN 'LEGACY_REMOVAL_FAILED' WHEN f_remains THEN 'FINAL_STATE_VERIFY_FAILED' END AS error_code,
  go AND NOT untagged AND NOT f_create AS kept FROM objects""",
    "apply_steps": f"""
SELECT *, CASE WHEN NOT go THEN decision WHEN untagged OR f_create OR f_verify THEN 'FAILED' ELSE 'ABAC_APPLIED' END AS status,
  CASE WHEN NOT go THEN reason_code WHEN untagged THEN {_UNTAGGED} WHEN f_create THEN {_CREATE_CODE} WHEN f_verify THEN 'POLICY_VERIFY_FAILED' END AS error_code,
  go AND NOT untagged AND NOT f_create AS kept FROM objects""",
    "finalize_steps": """
SELECT *, CASE WHEN NOT go THEN decision WHEN NOT applied THEN 'NOT_ELIGIBLE' WHEN f_verify OR f_remove OR f_remains THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN NOT go THEN reason_code WHEN NOT applied THEN 'ABAC_NOT_APPLIED_YET' WHEN f_verify THEN 'POLICY_VERIFY_FAILED' WHEN f_remove THEN 'LEGACY_REMOVAL_FAILED' WHEN f_remains THEN 'FINAL_STATE_VERIFY_FAILED' END AS error_code,
  go AND applied AND NOT f_verify AS kept FROM planned JOIN (SELECT tn AS otn, object_type AS oot, slot AS osl, go, f_verify, f_remove, f_remains FROM objects) ON tn = otn AND object_type = oot AND slot = osl""",
}
STEPS = {**PLANNED, **STEP_SQL}


def planned(f: Frames, options: RunOptions = TABLE) -> DataFrame:
    return cut_lineage(planned_objects(f.tables, f.state(options.policy_scope), options))


def resolved(f: Frames, options: RunOptions = TABLE, objects: DataFrame | None = None) -> DataFrame:
    """Resolved requests, written out for queries that read them more than once."""
    return cut_lineage(resolved_once(f, options, objects))


def resolved_once(f: Frames, options: RunOptions = TABLE, objects: DataFrame | None = None) -> DataFrame:
    objects = planned(f, options) if objects is None else objects
    return resolved_tags(objects, f.state(options.policy_scope), options)


def faults(f: Frames) -> DataFrame:
    """Failures by table number, for every object of the table."""
    key = f.row_filters.select("tid", *KEY, F.lit("ROW_FILTER").alias("object_type"), F.lit("").alias("slot")).unionAll(
        f.masks.select("tid", *KEY, F.lit("COLUMN_MASK").alias("object_type"), F.col("column").alias("slot"))
    )
    t = F.col("tid")
    return key.select(
        *decide.OBJECT,
        (t % 37 == 0).alias("create_failed"),
        F.when(t % 2 == 0, "INVALID_STATE").alias("create_error_code"),
        F.lit("create failed").alias("create_error_message"),
        (t % 41 == 0).alias("verify_failed"),
        F.when(t % 43 == 0, "cannot remove").alias("removal_error"),
        (t % 47 == 0).alias("legacy_remains"),
    )


def steps(f: Frames, mode: str = "MIGRATE", dry_run: bool = False, with_faults: bool = True) -> DataFrame:
    options = RunOptions(
        mode=mode, scope_type="ALL_CATALOGS", dry_run=dry_run, run_id="r1", audit_path="unused", inventory_path="unused"
    )
    objects = planned(f, options)
    found = None if mode == "FINALIZE" else resolved(f, options, objects)
    return migration_steps(objects, found, options, faults(f) if with_faults else None)


# -- tags ---------------------------------------------------------------------


@query("T-01_sanitize", "SELECT p_partkey, regexp_replace(p_name || '-' || p_brand || '.x', '[^A-Za-z0-9_]', '_', 'g') AS name FROM part")
def sanitize(f: Frames) -> DataFrame:
    raw = F.concat("p_name", F.lit("-"), "p_brand", F.lit(".x"))
    return f.read("part").select("p_partkey", names.sanitize(raw).alias("name"))


@query("T-02_tag_keys", """
SELECT tid, 'abac_rls_' || left('team_x_' || c || '_' || s || '_' || fn_clean, 180) AS three_parts, 'abac_colmask_' || fn_clean AS one_part,
  'abac_rls_' || c || '_' || fn_clean AS two_parts, 'abac_colmask_' || c || '_' || s || '_' || fn_clean AS four_parts, 'abac_rls_' || left(c || '_' || s || '_' || repeat('ab-', 90), 180) AS dirty
FROM (SELECT *, replace(cn, '-', '_') AS c, sn AS s FROM gov_filters)""".replace("repeat('ab-', 90)", "repeat('ab_', 90)"))
def tag_keys(f: Frames) -> DataFrame:
    short = F.element_at(F.split("function_fqn", r"\."), -1)
    quoted = F.concat(F.lit("`"), F.replace(F.col("function_fqn"), F.lit("."), F.lit("`.`")), F.lit("`"))
    return f.row_filters.select(
        "tid",
        names.tag_key(quoted, "row_filter", "team-x").alias("three_parts"),
        names.tag_key(short, "mask").alias("one_part"),
        names.tag_key(F.concat_ws(".", "catalog", short), "row_filter").alias("two_parts"),
        names.tag_key(F.concat_ws(".", "catalog", "schema", F.lit("extra"), short), "mask").alias("four_parts"),
        names.tag_key(F.concat_ws(".", "catalog", "schema", F.repeat(F.lit("ab-"), F.lit(90))), "row_filter").alias("dirty"),
    )


@query("T-03_tag_requests", f"SELECT {KEY_OUT}, col AS \"column\", req_role AS role, fn AS function_fqn, tkey AS tag_key FROM requests", PLANNED)
def requests(f: Frames) -> DataFrame:
    return tags.tag_requests(planned(f))


@query("T-04_reused_tags", f"SELECT {KEY_OUT}, col AS \"column\", req_role AS role, rk AS tag_key, rv AS tag_value FROM asked WHERE rk IS NOT NULL", PLANNED)
def reused(f: Frames) -> DataFrame:
    asked = tags.reuse(tags.tag_requests(planned(f)), tags.reusable_tags(f.column_tags, f.governed_tags))
    return asked.where("reused is not null").select(*KEY, "column", "role", "reused.tag_key", "reused.tag_value")


_TWINS = {
    **PLANNED,
    "all_requests": "SELECT * FROM requests UNION ALL SELECT cn, sn, tn, col, req_role, replace(fn, 'rf_region-', 'rf_region_'), tkey FROM requests WHERE req_role = 'row_filter' AND CAST(substr(tn, 3) AS BIGINT) % 29 = 0",
}


@query("T-05_key_errors", f"""
SELECT r.tkey AS tag_key, min(fn) AS function_fqn, max(fn) AS other_function, CASE WHEN min(fn) <> max(fn) THEN 'TAG_KEY_SHARED_BY_FUNCTIONS' ELSE 'TAG_KEY_TAKEN' END AS error_code
FROM all_requests r LEFT JOIN governed g ON g.tkey = r.tkey GROUP BY r.tkey HAVING min(fn) <> max(fn) OR any_value(g.descr) <> {DESCRIPTION} || min(fn)""", _TWINS)
def key_errors(f: Frames) -> DataFrame:
    asked = tags.tag_requests(planned(f))
    twins = asked.where((F.col("role") == "row_filter") & (F.substr("table", F.lit(3)).cast("long") % 29 == 0)).withColumn(
        "function_fqn", F.replace("function_fqn", F.lit("rf_region-"), F.lit("rf_region_"))
    )
    return tags.key_errors(asked.unionByName(twins), f.governed_tags)


@query("T-05_new_tags", f"SELECT tkey AS tag_key, {DESCRIPTION} || min(fn) AS description FROM resolved WHERE resolution = 'MINTED' AND tkey NOT IN (SELECT tkey FROM governed) GROUP BY tkey", PLANNED)
def new_tags(f: Frames) -> DataFrame:
    return tags.minted_tags(resolved_once(f), f.governed_tags).select("tag_key", "description")


@query("T-06_collisions", f"""
SELECT {KEY_OUT.replace('cn', 'm.cn').replace('sn', 'm.sn').replace('tn', 'm.tn')}, m.col AS "column", m.req_role AS role, m.tkey AS tag_key, c.tn IS NOT NULL AND m.req_role = 'row_filter' AS skipped
FROM requests m LEFT JOIN (SELECT tn, tkey FROM (SELECT tn, tkey, col FROM requests UNION ALL SELECT tn, tkey, col FROM tags) GROUP BY tn, tkey HAVING count(DISTINCT col) > 1) c ON c.tn = m.tn AND c.tkey = m.tkey""", PLANNED)
def collisions(f: Frames) -> DataFrame:
    return tags.split_by_collision(tags.tag_requests(planned(f)), f.column_tags).drop("function_fqn")


_RESOLVED_OUT = f"""SELECT {KEY_OUT}, col AS "column", req_role AS role, tkey AS tag_key, tval AS tag_value, resolution, 'mc_' || col AS alias FROM resolved"""


@query("T-06_resolved_tags", _RESOLVED_OUT, PLANNED)
def resolved_all(f: Frames) -> DataFrame:
    return resolved_once(f).drop("function_fqn", "error_code")


@query("T-06_without_reuse", _RESOLVED_OUT, {**PLANNED, "reusable": "SELECT '' AS tn, '' AS col, '' AS rk, '' AS rv WHERE false"})
def resolved_without_reuse(f: Frames) -> DataFrame:
    options = RunOptions(scope_type="ALL_CATALOGS", prefer_existing_tags=False, run_id="r1")
    return resolved_once(f, options).drop("function_fqn", "error_code")


@query("T-07_assigned_tags", f"""
SELECT {KEY_OUT}, col AS "column", tkey AS tag_key, tval AS tag_value FROM (
  SELECT cn, sn, tn, col, tkey, tval FROM tags t WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.resolution = 'MINTED' AND r.tn = t.tn AND r.col = t.col AND r.tkey = t.tkey)
  UNION ALL SELECT DISTINCT cn, sn, tn, col, tkey, NULL FROM resolved WHERE resolution = 'MINTED')""", PLANNED)
def assigned(f: Frames) -> DataFrame:
    return tags.assign_tags(f.column_tags, resolved(f))


@query("T-07_created_tags", f"""
SELECT tkey AS tag_key, descr AS description FROM governed
UNION ALL SELECT tkey, {DESCRIPTION} || min(fn) FROM resolved WHERE resolution = 'MINTED' AND tkey NOT IN (SELECT tkey FROM governed) GROUP BY tkey""", PLANNED)
def created_tags(f: Frames) -> DataFrame:
    return tags.create_tags(f.governed_tags, tags.minted_tags(resolved_once(f), f.governed_tags)).select("tag_key", "description")


@query("T-08_aliases", 'SELECT DISTINCT col AS "column", \'mc_\' || col AS alias FROM tags')
def aliases(f: Frames) -> DataFrame:
    return f.column_tags.select("column", names.match_alias("column").alias("alias")).distinct()


_UUID = "substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12)"


@query("T-09_principals", f"""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'servicePrincipals/' || {_UUID} WHEN 1 THEN 'groups/' || {_UUID} WHEN 2 THEN c_name ELSE {_UUID} || '0' END AS principal FROM (SELECT *, md5(c_name) AS h FROM customer)""")
def principals(f: Frames) -> DataFrame:
    h = F.md5("c_name")
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    uuid = F.concat_ws("-", *[F.substring(h, at, n) for at, n in cuts])
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, uuid).when(k == 1, F.concat(F.lit("groups/"), uuid)).when(k == 2, F.col("c_name")).otherwise(F.concat(uuid, F.lit("0")))
    return f.read("customer").select("c_custkey", names.principal(raw).alias("principal"))


GRANT = tags.GrantOptions(("00000000-0000-4000-8000-000000000001", "groups/stewards"))
_GRANTEES = "'servicePrincipals/00000000-0000-4000-8000-000000000001,groups/stewards'"


@query("T-10_grants", f"SELECT DISTINCT tkey AS tag_key, {_GRANTEES} AS principals, 'roles/tagPolicy.assigner' AS role FROM usable_tags", PLANNED)
def grants(f: Frames) -> DataFrame:
    return tags.grants(resolved_once(f), GRANT).withColumn("principals", F.array_join("principals", ","))


_GRANT_STATUS = """CASE WHEN length(tkey) % 11 = 0 THEN 'FAILED' WHEN tkey IN (SELECT tkey FROM governed WHERE length(tkey) % 2 = 0 AND length(tkey) % 3 <> 0) THEN 'ALREADY_GRANTED' ELSE 'GRANTED' END"""


def _grant_outcomes(f: Frames, dry_run: bool = False) -> DataFrame:
    wanted = tags.grants(resolved(f), tags.GrantOptions(("users/x@a.example", "groups/stewards")))
    errors = wanted.where(F.length("tag_key") % 11 == 0).select(
        "tag_key", F.lit("BAD_REQUEST").alias("error_code"), F.lit("no such principal").alias("error_message")
    )
    return tags.grant_outcomes(wanted, f.grant_rules, dry_run, errors)


@query("T-11_grant_outcomes", f"SELECT tkey AS tag_key, {_GRANT_STATUS} AS status, CASE WHEN length(tkey) % 11 = 0 THEN 'BAD_REQUEST' END AS error_code FROM (SELECT DISTINCT tkey FROM usable_tags)", PLANNED)
def grant_outcomes(f: Frames) -> DataFrame:
    return _grant_outcomes(f).select("tag_key", "status", "error_code")


@query("T-11_grant_dry_run", "SELECT DISTINCT tkey AS tag_key, 'WOULD_GRANT' AS status FROM usable_tags", PLANNED)
def grant_dry_run(f: Frames) -> DataFrame:
    return _grant_outcomes(f, dry_run=True).select("tag_key", "status")


@query("T-11_rules_after", f"""
SELECT tag_key, count(*) AS n_rules FROM (SELECT tkey AS tag_key FROM governed UNION ALL SELECT tkey FROM (SELECT DISTINCT tkey FROM usable_tags) WHERE {_GRANT_STATUS} = 'GRANTED') GROUP BY 1""", PLANNED)
def rules_after(f: Frames) -> DataFrame:
    return tags.apply_grants(f.grant_rules, _grant_outcomes(f)).groupBy("tag_key").agg(F.count("*").alias("n_rules"))


@query("T-12_grown_values", """
SELECT tkey AS tag_key, CASE WHEN length(tkey) % 2 = 0 THEN allowed WHEN allowed = '' THEN 'low,new' ELSE allowed || ',new' END AS allowed_values FROM governed""")
def grown(f: Frames) -> DataFrame:
    additions = f.governed_tags.where(F.length("tag_key") % 2 == 1).select(
        "tag_key", F.array(F.lit("low"), F.lit("new")).alias("new_values")
    )
    return tags.grow_allowed_values(f.governed_tags, additions).select(
        "tag_key", F.array_join("allowed_values", ",").alias("allowed_values")
    )


# -- policies -------------------------------------------------------------------


@query("P-01_table_policy_names", """
SELECT cn AS "catalog", sn AS "schema", tn AS "table", slot, CASE object_type WHEN 'ROW_FILTER' THEN 'abac_migrated_row_filter' ELSE 'abac_migrated_mask_' || slot END AS plain_name,
  CASE object_type WHEN 'ROW_FILTER' THEN 'abac_team_x_migrated_row_filter' ELSE 'abac_team_x_migrated_mask_' || slot END AS team_name FROM gov_objects""")
def table_names(f: Frames) -> DataFrame:
    objects = decide.legacy_objects(f.row_filters, f.masks)
    return objects.select(
        *KEY, "slot", decide.policy_name("TABLE").alias("plain_name"), decide.policy_name("TABLE", "team-x").alias("team_name")
    )


@query("P-02_catalog_policy_names", """
SELECT cn AS "catalog", sn AS "schema", tn AS "table", slot, tkey AS plain_name, CASE object_type WHEN 'ROW_FILTER' THEN 'abac_rls_team_x_' || substr(tkey, 10) ELSE 'abac_colmask_team_x_' || substr(tkey, 14) END AS team_name FROM gov_objects""")
def catalog_names(f: Frames) -> DataFrame:
    objects = decide.legacy_objects(f.row_filters, f.masks)
    return objects.select(
        *KEY, "slot", decide.policy_name("CATALOG").alias("plain_name"), decide.policy_name("CATALOG", "team-x").alias("team_name")
    )


@query("P-03_securables", "SELECT 'TABLE `' || cn || '`.`' || sn || '`.`' || tn || '`' AS on_table, 'CATALOG `' || cn || '`' AS on_catalog FROM gov_tables")
def securables(f: Frames) -> DataFrame:
    return f.tables.select(names.table_securable().alias("on_table"), names.catalog_securable().alias("on_catalog"))


def wanted_policies(f: Frames, options: RunOptions = TABLE) -> DataFrame:
    rows = planned(f, options)
    objects = policies.with_match_columns(rows, tags.usable(resolved(f, options, rows)))
    ready = objects.where((F.col("decision") == "PROCEED") & ~F.col("tag_missing"))
    return policies.plan_policies(ready, options.policy_scope, ["account users", "etl"], ["break glass"])


_CLAUSE = "CASE WHEN u.tval IS NULL THEN 'has_tag(''' || u.tkey || ''')' ELSE 'has_tag_value(''' || u.tkey || ''', ''' || u.tval || ''')' END || ' AS mc_' || u.col"


@query("P-04_row_filter_policies", f"""
SELECT {KEY_OUT.replace('cn', 'o.cn').replace('sn', 'o.sn').replace('tn', 'o.tn')}, policy_name, o.fn AS function_fqn, 'mc_' || replace(using_columns, ',', ',mc_') AS using_columns,
  (SELECT string_agg(u.tkey, ',' ORDER BY list_position(string_split(o.using_columns, ','), u.col)) FROM usable_tags u WHERE u.tn = o.tn AND u.req_role = 'row_filter') AS tag_keys
FROM objects o WHERE go AND NOT untagged AND object_type = 'ROW_FILTER'""", PLANNED)
def filter_policies(f: Frames) -> DataFrame:
    rows = wanted_policies(f).where(F.col("object_type") == "ROW_FILTER")
    return rows.select(
        *KEY, "policy_name", F.col("source_function").alias("function_fqn"), F.array_join("using_aliases", ",").alias("using_columns"),
        F.array_join(F.transform("match_columns", lambda m: m["tag_key"]), ",").alias("tag_keys"),
    )


@query("P-05_mask_policies", f"""
SELECT {KEY_OUT.replace('cn', 'o.cn').replace('sn', 'o.sn').replace('tn', 'o.tn')}, policy_name, o.fn AS function_fqn, 'mc_' || slot AS target_alias, 0 AS n_extra, u.tkey AS tag_key, u.tval AS tag_value
FROM objects o JOIN usable_tags u ON u.tn = o.tn AND u.req_role = 'mask' AND u.col = o.slot WHERE go AND object_type = 'COLUMN_MASK'""", PLANNED)
def mask_policies(f: Frames) -> DataFrame:
    rows = wanted_policies(f).where(F.col("object_type") == "COLUMN_MASK").withColumn("m", F.get("match_columns", F.lit(0)))
    return rows.select(
        *KEY, "policy_name", F.col("source_function").alias("function_fqn"), "target_alias",
        F.size("using_aliases").alias("n_extra"), "m.tag_key", "m.tag_value",
    )


@query("P-06_definitions", f"""
SELECT on_securable, policy_name, 'CREATE OR REPLACE POLICY ' || policy_name || chr(10) || 'ON ' || on_securable || chr(10) || 'COMMENT ''' ||
  CASE object_type WHEN 'ROW_FILTER' THEN 'Migrated from a table-level row filter.' ELSE 'Migrated from a column mask on ' || slot || '.' END || '''' || chr(10) ||
  CASE object_type WHEN 'ROW_FILTER' THEN 'ROW FILTER ' ELSE 'COLUMN MASK ' END || o.fn || chr(10) || 'TO `account users`, `etl` EXCEPT `break glass`' || chr(10) || 'FOR TABLES' || chr(10) || 'MATCH COLUMNS ' ||
  (SELECT string_agg({_CLAUSE}, ', ' ORDER BY list_position(string_split(o.using_columns, ','), u.col)) FROM usable_tags u
   WHERE u.tn = o.tn AND ((o.object_type = 'ROW_FILTER' AND u.req_role = 'row_filter') OR (o.object_type = 'COLUMN_MASK' AND u.req_role = 'mask' AND u.col = o.slot))) ||
  CASE object_type WHEN 'ROW_FILTER' THEN chr(10) || 'USING COLUMNS (mc_' || replace(using_columns, ',', ', mc_') || ')' ELSE chr(10) || 'ON COLUMN mc_' || slot END AS definition
FROM objects o WHERE go AND NOT untagged""", PLANNED)
def definitions(f: Frames) -> DataFrame:
    return wanted_policies(f).select("on_securable", "policy_name", policies.definition_text().alias("definition"))


@query("P-07_existing_on_tables", f"SELECT {KEY_OUT}, object_type, CASE object_type WHEN 'COLUMN_MASK' THEN slot END AS masked_column, policy_name, pfn AS function_fqn FROM table_policies")
def existing_on_tables(f: Frames) -> DataFrame:
    return existing_of(f.state(), TABLE)


@query("P-08_existing_on_catalogs", f"""
SELECT {KEY_OUT.replace('cn', 'm.cn').replace('sn', 'm.sn').replace('tn', 'm.tn')}, m.object_type, CASE m.object_type WHEN 'COLUMN_MASK' THEN m.slot END AS masked_column, c.policy_name, c.pfn AS function_fqn
FROM migrated m JOIN catalog_policies c ON c.cn = m.cn AND c.tkey = m.tkey""")
def existing_on_catalogs(f: Frames) -> DataFrame:
    return existing_of(f.state("CATALOG"), CATALOG)


@query("P-09_applicable", f"""
SELECT {KEY_OUT}, object_type, fn IS NOT NULL AS has_old_rule, pfn IS NOT NULL AS has_policy FROM planned""", PLANNED)
def applicable(f: Frames) -> DataFrame:
    rows = decide.applicable_objects(f.live_row_filters, f.live_masks, existing_of(f.state(), TABLE))
    return rows.select(
        *KEY, "object_type", F.col("legacy_function").isNotNull().alias("has_old_rule"), F.col("existing_name").isNotNull().alias("has_policy")
    )


_PLAN_OUT = "decision, reason_code, {} AS abac_already_applied, source_function, policy_name"


def _plan_rows(f: Frames, options: RunOptions, object_type: str) -> DataFrame:
    rows = planned(f, options).where(F.col("object_type") == object_type)
    name = F.when(F.col("decision") == "ALREADY_MIGRATED", F.col("existing_policy_name")).otherwise(F.col("policy_name"))
    return rows.select(*KEY, "masked_column", "decision", "reason_code", "abac_already_applied", "source_function", name.alias("policy_name"))


@query("P-10_filter_decisions", f"SELECT {KEY_OUT}, CAST(NULL AS VARCHAR) AS masked_column, {_PLAN_OUT.format('applied')} FROM planned WHERE object_type = 'ROW_FILTER'", PLANNED)
def filter_decisions(f: Frames) -> DataFrame:
    return _plan_rows(f, TABLE, "ROW_FILTER")


@query("P-10_filter_decisions_catalog", f"SELECT {KEY_OUT}, CAST(NULL AS VARCHAR) AS masked_column, {_PLAN_OUT.format('applied')} FROM cat_planned WHERE object_type = 'ROW_FILTER'", PLANNED)
def filter_decisions_catalog(f: Frames) -> DataFrame:
    return _plan_rows(f, CATALOG, "ROW_FILTER")


@query("P-11_mask_decisions", f"SELECT {KEY_OUT}, slot AS masked_column, {_PLAN_OUT.format('applied')} FROM planned WHERE object_type = 'COLUMN_MASK'", PLANNED)
def mask_decisions(f: Frames) -> DataFrame:
    return _plan_rows(f, TABLE, "COLUMN_MASK")


@query("P-11_mask_decisions_catalog", f"SELECT {KEY_OUT}, slot AS masked_column, {_PLAN_OUT.format('applied')} FROM cat_planned WHERE object_type = 'COLUMN_MASK'", PLANNED)
def mask_decisions_catalog(f: Frames) -> DataFrame:
    return _plan_rows(f, CATALOG, "COLUMN_MASK")


@query("P-12_unresolved_tags", f"SELECT {KEY_OUT}, object_type, slot, {_UNTAGGED} AS error_code FROM objects WHERE go AND untagged", PLANNED)
def unresolved(f: Frames) -> DataFrame:
    rows = steps(f, with_faults=False).where(F.col("error_code").isin("RLS_TAG_COLLISION_UNRESOLVABLE", "TAG_RESOLUTION_MISSING"))
    return rows.select(*KEY, "object_type", "slot", "error_code")


_CREATED = {"full_steps": "kept", "apply_steps": "kept", "finalize_steps": "false"}


def _step_sql(cte: str) -> str:
    return f"""
SELECT {KEY_OUT}, object_type, slot, status, error_code, kept AS can_undo, {_CREATED[cte]} AS policy_created, go AND status = 'SUCCESS' AS legacy_removed,
  CASE WHEN go AND error_code IN ('RLS_TAG_COLLISION_UNRESOLVABLE', 'TAG_RESOLUTION_MISSING', 'ABAC_NOT_APPLIED_YET') THEN NULL WHEN go OR decision IN ('ALREADY_MIGRATED') OR reason_code = 'EXISTING_ABAC_POLICY_CONFLICT' THEN policy_name END AS target_policy_name
FROM {cte}"""


def _step_rows(df: DataFrame) -> DataFrame:
    return df.select(
        *KEY, "object_type", "slot", "status", "error_code", F.col("rollback").isNotNull().alias("can_undo"),
        "policy_created", "legacy_removed", "target_policy_name",
    )


@query("P-13_full", _step_sql("full_steps"), STEPS)
def outcome_full(f: Frames) -> DataFrame:
    return _step_rows(steps(f))


@query("P-13_apply", _step_sql("apply_steps"), STEPS)
def outcome_apply(f: Frames) -> DataFrame:
    return _step_rows(steps(f, "APPLY_ABAC"))


@query("P-13_finalize", _step_sql("finalize_steps"), STEPS)
def outcome_finalize(f: Frames) -> DataFrame:
    return _step_rows(steps(f, "FINALIZE"))


@query("P-13_dry_runs", """
SELECT run_mode, object_type, status, error_code, count(*) AS n_objects FROM (
  SELECT 'MIGRATE' AS run_mode, object_type, CASE WHEN NOT go THEN decision WHEN untagged THEN 'FAILED' ELSE 'WOULD_MIGRATE' END AS status, CASE WHEN NOT go THEN reason_code WHEN untagged THEN {u} END AS error_code FROM objects
  UNION ALL SELECT 'APPLY_ABAC', object_type, CASE WHEN NOT go THEN decision WHEN untagged THEN 'FAILED' ELSE 'WOULD_APPLY_ABAC' END, CASE WHEN NOT go THEN reason_code WHEN untagged THEN {u} END FROM objects
  UNION ALL SELECT 'FINALIZE', object_type, CASE WHEN NOT go THEN decision WHEN NOT applied THEN 'NOT_ELIGIBLE' ELSE 'WOULD_FINALIZE' END, CASE WHEN NOT go THEN reason_code WHEN NOT applied THEN 'ABAC_NOT_APPLIED_YET' END FROM objects)
GROUP BY 1, 2, 3, 4""".format(u=_UNTAGGED), PLANNED)
def dry_runs(f: Frames) -> DataFrame:
    parts = [
        steps(f, mode, dry_run=True, with_faults=False)
        .groupBy(F.lit(mode).alias("run_mode"), "object_type", "status", "error_code")
        .agg(F.count("*").alias("n_objects"))
        for mode in ("MIGRATE", "APPLY_ABAC", "FINALIZE")
    ]
    return reduce(DataFrame.unionAll, parts)


@query("P-14_policies_after", """
SELECT on_securable, policy_name, object_type AS policy_type, fn AS function_fqn FROM full_steps WHERE kept
UNION ALL SELECT on_securable, policy_name, object_type, pfn FROM table_policies p WHERE NOT EXISTS (SELECT 1 FROM full_steps s WHERE s.kept AND s.on_securable = p.on_securable AND s.policy_name = p.policy_name)""", STEPS)
def policies_after(f: Frames) -> DataFrame:
    after = policies.upsert_policies(f.policies(), steps(f).where("policy_created"))
    return after.select("on_securable", "policy_name", "policy_type", "function_fqn")


@query("P-14_old_rules_after", f"""
SELECT {KEY_OUT}, slot, fn AS function_fqn FROM live_objects l WHERE NOT EXISTS (SELECT 1 FROM full_steps s WHERE s.go AND s.status = 'SUCCESS' AND s.tn = l.tn AND s.slot = l.slot)""", STEPS)
def old_rules_after(f: Frames) -> DataFrame:
    done = cut_lineage(steps(f))
    filters = policies.remove_row_filters(f.live_row_filters, done).select(*KEY, F.lit("").alias("slot"), "function_fqn")
    return filters.unionAll(policies.remove_masks(f.live_masks, done).select(*KEY, F.col("column").alias("slot"), "function_fqn"))


SHARED = {
    **PLANNED,
    # a catalog policy matches its own key alone
    "reusable": "SELECT '' AS tn, '' AS col, '' AS rk, '' AS rv WHERE false",
    "cat_steps": """
SELECT p.* FROM cat_planned p WHERE decision = 'PROCEED' AND (SELECT count(*) FROM usable_tags u WHERE u.tn = p.tn AND ((p.object_type = 'ROW_FILTER' AND u.req_role = 'row_filter') OR (p.object_type = 'COLUMN_MASK' AND u.req_role = 'mask' AND u.col = p.slot))) =
  CASE WHEN p.object_type = 'ROW_FILTER' THEN (SELECT len(string_split(using_columns, ',')) FROM gov_filters g WHERE g.tn = p.tn) ELSE 1 END""",
    "requests": """
SELECT p.cn, p.sn, p.tn, unnest(string_split(g.using_columns, ',')) AS col, 'row_filter' AS req_role, p.source_function AS fn, p.policy_name AS tkey FROM cat_planned p JOIN gov_filters g ON g.tn = p.tn WHERE decision = 'PROCEED' AND object_type = 'ROW_FILTER'
UNION ALL SELECT cn, sn, tn, slot, 'mask', source_function, policy_name FROM cat_planned WHERE decision = 'PROCEED' AND object_type = 'COLUMN_MASK'""",
}


@query("P-15_shared_policies", """
SELECT on_securable, policy_name, policy_type, function_fqn FROM (
  SELECT DISTINCT 'CATALOG `' || cn || '`' AS on_securable, policy_name, object_type AS policy_type, source_function AS function_fqn FROM cat_steps
  UNION ALL SELECT on_securable, policy_name, object_type, pfn FROM catalog_policies p WHERE NOT EXISTS (SELECT 1 FROM cat_steps s WHERE s.cn = p.cn AND s.policy_name = p.policy_name))""", SHARED)
def shared_policies(f: Frames) -> DataFrame:
    """Policies after a run at catalog scope: one per function, however many tables use it."""
    options = RunOptions(
        mode="MIGRATE", scope_type="ALL_CATALOGS", dry_run=False, policy_scope="CATALOG", run_id="r1",
        audit_path="unused", inventory_path="unused",
    )
    objects = planned(f, options)
    found = resolved(f, options, objects)
    done = migration_steps(objects, found, options)
    after = next_state(f.state("CATALOG"), done, found, None).policies
    return after.select("on_securable", "policy_name", "policy_type", "function_fqn")
