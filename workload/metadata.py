"""Discovery, scope and inventory over the derived catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.labels import VOCABULARY, category, error_reason, normalize_label
from tablewarden.functions.names import KEY, full_name
from tablewarden.operators import catalog, describe
from tablewarden.operators.inventory import build_inventory, inventory_counts, masks_per_table
from tablewarden.plans.discover import state_from_listings
from tablewarden.plans.options import RunOptions
from tablewarden.plans.run import inventory_of
from tablewarden.sources.schemas import INVENTORY
from tablewarden.sources.store import append_inventory, read_table, shared_folder
from workload.ctes import KEY_OUT
from workload.frames import Frames
from workload.registry import query

REASON = """CASE WHEN describe_error IS NULL THEN NULL WHEN strpos(describe_error, 'PERMISSION_DENIED') > 0 THEN 'PERMISSION_DENIED'
  WHEN strpos(describe_error, 'FAILED_JDBC') > 0 THEN 'FEDERATION_UNREACHABLE' WHEN strpos(describe_error, 'DATA_SOURCE_NOT_FOUND') > 0 THEN 'UNSUPPORTED_DATA_SOURCE'
  ELSE 'UNKNOWN_GATEWAY_ERROR' END"""


@query("S-01_list_schemas", 'SELECT DISTINCT cn AS "catalog", sn AS "schema" FROM gov_tables')
def list_schemas(f: Frames) -> DataFrame:
    return catalog.list_schemas(f.tables)


@query("S-01_list_catalogs", 'SELECT DISTINCT cn AS "catalog" FROM gov_tables')
def list_catalogs(f: Frames) -> DataFrame:
    return catalog.list_catalogs(f.tables)


@query("S-01_list_tables", f"SELECT {KEY_OUT} FROM gov_tables WHERE cn = 'cat-3' AND sn = 's_8'")
def list_tables(f: Frames) -> DataFrame:
    return catalog.list_tables(f.tables, "cat-3", "s_8")


@query("S-02_scope", f"""
SELECT 'ALL_CATALOGS' AS scope, {KEY_OUT} FROM gov_tables
UNION ALL SELECT 'SELECTED_CATALOGS', cn, sn, tn FROM gov_tables WHERE cn IN ('cat-1', 'cat-4')
UNION ALL SELECT 'ALL_SCHEMAS', cn, sn, tn FROM gov_tables WHERE cn = 'cat-2'
UNION ALL SELECT 'ALL_SCHEMAS_ANY', cn, sn, tn FROM gov_tables
UNION ALL SELECT 'SELECTED_SCHEMAS', cn, sn, tn FROM gov_tables WHERE (cn = 'cat-1' AND sn IN ('s_1', 's_6')) OR (cn = 'cat-0' AND sn = 's_10')
UNION ALL SELECT 'SPECIFIC_TABLES', cn, sn, tn FROM gov_tables WHERE tid % 10 <> 0 AND tid % 31 <> 0""")
def scope(f: Frames) -> DataFrame:
    t = f.tables.select(*KEY)
    parts = {
        "ALL_CATALOGS": catalog.resolve_scope(t, "ALL_CATALOGS"),
        "SELECTED_CATALOGS": catalog.resolve_scope(t, "SELECTED_CATALOGS", ["cat-1", "cat-4"]),
        "ALL_SCHEMAS": catalog.resolve_scope(t, "ALL_SCHEMAS", ["cat-2"]),
        "ALL_SCHEMAS_ANY": catalog.resolve_scope(t, "ALL_SCHEMAS"),
        "SELECTED_SCHEMAS": catalog.resolve_scope(t, "SELECTED_SCHEMAS", schemas={"cat-1": ["s_1", "s_6"], "cat-0": ["s_10"]}),
        "SPECIFIC_TABLES": catalog.resolve_scope(t, "SPECIFIC_TABLES", names=_asked_names(f).select("name")),
    }
    out = None
    for label, rows in parts.items():
        part = rows.select(F.lit(label).alias("scope"), *KEY)
        out = part if out is None else out.unionAll(part)
    return out


def _asked_names(f: Frames) -> DataFrame:
    """Names as a user types them: every tenth lacks its catalog, some have a part too many."""
    name = (
        F.when(F.col("tid") % 10 == 0, F.concat_ws(".", "schema", "table"))
        .when(F.col("tid") % 31 == 0, F.concat(full_name(), F.lit(".x")))
        .otherwise(full_name())
    )
    return f.tables.select("tid", name.alias("name"))


@query("S-03_exclude_schemas", f"SELECT {KEY_OUT} FROM gov_tables WHERE cn IN ('cat-0', 'cat-1') AND NOT regexp_matches(sn, '1[0-5]$|_6')")
def exclude(f: Frames) -> DataFrame:
    return catalog.resolve_scope(f.tables, "SELECTED_CATALOGS", ["cat-0", "cat-1"], exclude_schema_regex="1[0-5]$|_6").select(*KEY)


@query("S-04_parse_names", """
SELECT name, CASE WHEN n = 3 THEN split_part(name, '.', 1) END AS "catalog", CASE WHEN n = 3 THEN split_part(name, '.', 2) END AS "schema",
  CASE WHEN n = 3 THEN split_part(name, '.', 3) END AS "table", CASE WHEN n <> 3 THEN 'Expected catalog.schema.table, got: ' || name END AS error_message
FROM (SELECT name, len(string_split(name, '.')) AS n FROM (SELECT CASE WHEN tid % 10 = 0 THEN sn || '.' || tn WHEN tid % 31 = 0 THEN cn || '.' || sn || '.' || tn || '.x'
  ELSE cn || '.' || sn || '.' || tn END AS name FROM gov_tables))""")
def parse_names(f: Frames) -> DataFrame:
    return catalog.parse_table_names(_asked_names(f).select("name"))


@query("S-05_listing_errors", f"""
SELECT scope, action, count(*) AS n_errors FROM (
  SELECT scope, CASE WHEN reason IN ('FEDERATION_UNREACHABLE', 'UNSUPPORTED_DATA_SOURCE') THEN 'skip'
    WHEN reason = 'PERMISSION_DENIED' AND scope LIKE 'ALL%' THEN 'skip' ELSE 'raise' END AS action
  FROM (SELECT {REASON} AS reason FROM gov_tables WHERE describe_error IS NOT NULL), (VALUES ('ALL_CATALOGS'), ('SELECTED_CATALOGS'), ('ALL_SCHEMAS'), ('SELECTED_SCHEMAS')) v(scope)) GROUP BY 1, 2""")
def listing_errors(f: Frames) -> DataFrame:
    errors = f.tables.where(F.col("describe_error").isNotNull())
    actions = {s: catalog.listing_action(s, "describe_error") for s in catalog.SCOPES if s != "SPECIFIC_TABLES"}
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), a.alias("action")) for s, a in actions.items()]))
    return errors.select(pairs.alias("p")).groupBy("p.scope", "p.action").agg(F.count("*").alias("n_errors"))


@query("S-06_table_types", f"SELECT {KEY_OUT}, table_type FROM gov_tables WHERE describe_error IS NULL")
def table_types(f: Frames) -> DataFrame:
    return describe.table_types(f.dump)


@query("S-06_row_filters", f"SELECT {KEY_OUT}, fn AS function_fqn, using_columns FROM gov_filters")
def dumped_filters(f: Frames) -> DataFrame:
    rows = describe.row_filters(f.dump)
    return rows.select(*KEY, "function_fqn", F.array_join("using_columns", ",").alias("using_columns"))


@query("S-06_column_masks", f'SELECT {KEY_OUT}, col AS "column", fn AS function_fqn FROM gov_masks')
def dumped_masks(f: Frames) -> DataFrame:
    return describe.column_masks(f.dump).select(*KEY, "column", "function_fqn")


@query("S-07_old_rules", """
SELECT cn AS "catalog", sn AS "schema", tn AS "table", max(CASE object_type WHEN 'ROW_FILTER' THEN fn END) AS row_filter, count(*) FILTER (object_type = 'COLUMN_MASK') AS n_masks
FROM gov_objects GROUP BY 1, 2, 3""")
def old_rules(f: Frames) -> DataFrame:
    filters = describe.row_filters(f.dump).select(*KEY, F.col("function_fqn").alias("row_filter"))
    counts = describe.column_masks(f.dump).groupBy(*KEY).agg(F.count("*").alias("n_masks"))
    return filters.join(counts, KEY, "full_outer").select(*KEY, "row_filter", F.coalesce("n_masks", F.lit(0)).alias("n_masks"))


@query("S-08_column_tags", f'SELECT {KEY_OUT}, col AS "column", tkey AS tag_key, tval AS tag_value FROM tags')
def column_tags(f: Frames) -> DataFrame:
    return catalog.normalize_column_tags(f.raw_column_tags)


@query("S-09_policies_on_securable", """
SELECT policy_name, object_type AS policy_type, pfn AS function_fqn FROM catalog_policies WHERE on_securable = 'CATALOG `cat-1`'""")
def policies_on(f: Frames) -> DataFrame:
    return catalog.policies_on(f.policies("CATALOG"), "CATALOG `cat-1`").select("policy_name", "policy_type", "function_fqn")


@query("S-09_policy_by_name", "SELECT on_securable, policy_name, pfn AS function_fqn FROM table_policies WHERE policy_name = 'abac_migrated_mask_card' AND on_securable LIKE '%`t_1`'")
def policy_by_name(f: Frames) -> DataFrame:
    rows = catalog.policies_on(f.policies("TABLE"), "TABLE `cat-1`.`s_1`.`t_1`", "abac_migrated_mask_card")
    return rows.select("on_securable", "policy_name", "function_fqn")


@query("S-09_parse_lists", """
SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type || ' , ' || p_brand || ',, x' END, ','), lambda e: trim(e)), lambda e: e <> ''), '|') AS to_principals
FROM part""")
def parse_lists(f: Frames) -> DataFrame:
    text = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat("p_type", F.lit(" , "), "p_brand", F.lit(",, x")))
    rows = catalog.parse_policies(f.read("part").select("p_partkey", text.alias("to_principals")))
    return rows.select("p_partkey", F.array_join("to_principals", "|").alias("to_principals"))


@query("S-10_policies_by_schema", """
SELECT cn AS "catalog", sn AS "schema", object_type AS policy_type, count(*) AS n_policies FROM table_policies GROUP BY 1, 2, 3""")
def policies_by_schema(f: Frames) -> DataFrame:
    return catalog.policies_by_schema(f.policies("TABLE"))


@query("S-11_function_status", """
SELECT o.fn AS function_fqn, count(*) AS n_uses, g.fn IS NOT NULL AS function_exists, coalesce(g.executable, false) AS function_executable
FROM gov_objects o LEFT JOIN gov_functions g ON o.fn = g.fn GROUP BY 1, 3, 4""")
def function_status(f: Frames) -> DataFrame:
    used = f.row_filters.select("function_fqn").unionAll(f.masks.select("function_fqn"))
    counted = used.groupBy("function_fqn").agg(F.count("*").alias("n_uses"))
    return catalog.function_status(counted, f.functions)


@query("S-12_governed_tags", """
SELECT 'tag_' || CAST(p_partkey AS VARCHAR) AS tag_key, CASE p_partkey % 3 WHEN 0 THEN '' ELSE p_type || '|' || p_brand END AS allowed_values FROM part""")
def governed_tags(f: Frames) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, "[]").otherwise(
        F.concat(F.lit("['"), "p_type", F.lit("', \""), "p_brand", F.lit('"]'))
    )
    listed = f.read("part").select(
        F.concat(F.lit("tag_"), "p_partkey").alias("tag_key"), text.alias("allowed_values_text"), F.lit("").alias("description")
    )
    parsed = catalog.parse_governed_tags(listed)
    return parsed.select("tag_key", F.array_join("allowed_values", "|").alias("allowed_values"))


@query("S-13_error_reasons", f"SELECT {KEY_OUT}, {REASON} AS reason FROM gov_tables")
def error_reasons(f: Frames) -> DataFrame:
    return f.tables.select(*KEY, error_reason("describe_error").alias("reason"))


# The rule of categories, written out again: votes of the columns' parts count two, of the function's own parts one.
_PARTS = "[x FOR x IN regexp_split_to_array(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+') IF x <> '']"
_VOTES = f"""
SELECT u.fn, u.cols, v.category, v.place,
  2 * len([c FOR c IN string_split(u.cols, ',') IF len(list_intersect({_PARTS.format('c')}, v.words)) > 0])
    + CASE WHEN len(list_intersect({_PARTS.format("regexp_extract(u.fn, '[^.]*$')")}, v.words)) > 0 THEN 1 ELSE 0 END AS n
FROM uses u, vocabulary v"""
_CATEGORY_SQL = """
SELECT fn AS function_fqn, cols AS column_names, CASE WHEN max(n) = 0 THEN 'other' ELSE arg_min(category, place - 1000 * n) END AS category
FROM votes GROUP BY fn, cols"""
_VOCABULARY = ", ".join(f"('{c}', {i}, [{', '.join(repr(w) for w in words)}])" for i, (c, words) in enumerate(VOCABULARY.items()))
_USES = {
    "uses": "SELECT DISTINCT fn, cols FROM (SELECT fn, using_columns AS cols FROM gov_filters UNION ALL SELECT fn, col FROM gov_masks)",
    "vocabulary": f"SELECT * FROM (VALUES {_VOCABULARY}) v(category, place, words)",
    "votes": _VOTES,
}

# Inventory over the half-migrated state, TABLE scope.
_INVENTORY = {
    "have_filter": "SELECT tn, fn, using_columns FROM gov_filters WHERE tid % 4 <> 0",
    "have_masks": """
SELECT tn, string_agg(col || '=' || fn, ';' ORDER BY i) AS masks,
  '{' || string_agg('"' || col || '":"' || CASE col WHEN 'email' THEN 'email' WHEN 'phone' THEN 'phone' WHEN 'ssn' THEN 'ssn' ELSE 'credit_card' END || '"', ',' ORDER BY col) || '}' AS labels
FROM gov_masks WHERE tid % 4 <> 0 GROUP BY tn""",
    "have_policies": "SELECT tn, string_agg(policy_name, ',' ORDER BY object_type = 'COLUMN_MASK', policy_name) AS names FROM table_policies GROUP BY tn",
    "inventory_rows": f"""
SELECT t.cn, t.sn, t.tn, CASE WHEN describe_error IS NULL THEN table_type ELSE 'UNKNOWN' END AS table_type,
  r.tn IS NOT NULL AS has_row_filter, r.fn AS row_filter_function, coalesce(r.using_columns, '') AS row_filter_columns,
  coalesce(describe_error, r.fn || ' ON (' || r.using_columns || ')', '') AS row_filter_expression_text,
  m.tn IS NOT NULL AS has_column_masks, coalesce(m.masks, '') AS column_masks, m.labels AS mask_labels,
  CASE WHEN r.tn IS NOT NULL THEN 'region' END AS filter_label,  -- two votes a column, one the function's name: its part "region" decides
  p.tn IS NOT NULL AS has_existing_abac_policy, coalesce(p.names, '') AS existing_abac_policy_names,
  CASE WHEN describe_error IS NOT NULL THEN {REASON} WHEN r.tn IS NULL AND m.tn IS NULL AND p.tn IS NULL THEN 'NO_LEGACY_SECURITY_FOUND'
       WHEN table_type = 'VIEW' THEN 'UNSUPPORTED_TABLE_TYPE' END AS eligibility_reason
FROM gov_tables t LEFT JOIN have_filter r ON r.tn = t.tn LEFT JOIN have_masks m ON m.tn = t.tn LEFT JOIN have_policies p ON p.tn = t.tn""",
}


def policy_lines(f: Frames) -> DataFrame:
    """Every table policy as the lines of its description, labelled and indented as a platform lists them."""
    clause = F.transform("match_columns", lambda m: F.concat(F.lit("has_tag('"), m["tag_key"], F.lit("') AS "), m["alias"]))
    ticked = F.concat(F.lit("`"), F.replace(F.col("function_fqn"), F.lit("."), F.lit("`.`")), F.lit("`"))
    kind = F.when(F.col("policy_type") == "ROW_FILTER", "ROW FILTER").otherwise("COLUMN MASK")
    told = {
        "Name": F.col("policy_name"), "Policy Type": kind, "On Securable Type": F.lit("TABLE"), "On Securable": F.concat_ws(".", *KEY),
        "  Function Name": ticked, "To Principals": F.array_join("to_principals", ", "),
        "Except Principals": F.array_join("except_principals", ", "), "Match Columns": F.array_join(clause, ", "),
        "  Using Columns": F.array_join("using_columns", ", "), "  On Column": F.col("target_alias"), "Comment": F.col("comment"), "Owner": F.lit("x"),
    }
    lines = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in told.items()])
    key = F.concat_ws("|", "on_securable", "policy_name")
    parts = F.regexp_extract_all("on_securable", F.lit("`([^`]+)`"), 1)
    named = f.policies("TABLE").withColumns({k: F.get(parts, F.lit(i)) for i, k in enumerate(KEY)})
    return named.select(key.alias("policy_id"), F.inline(lines))


@query("S-09_described_policies", """
SELECT on_securable, policy_name, object_type AS policy_type, pfn AS function_fqn, tkey || '=' || CASE object_type WHEN 'ROW_FILTER' THEN 'mc_region' ELSE 'mc_' || slot END AS matches,
  CASE object_type WHEN 'ROW_FILTER' THEN 'mc_region' ELSE '' END AS using_columns, CASE object_type WHEN 'COLUMN_MASK' THEN 'mc_' || slot END AS target_alias,
  'account users' AS to_principals, CAST(NULL AS VARCHAR) AS problem FROM table_policies""")
def described(f: Frames) -> DataFrame:
    found = catalog.described_policies(policy_lines(f))
    return found.select(
        "on_securable", "policy_name", "policy_type", "function_fqn",
        F.array_join(F.transform("match_columns", lambda m: F.concat_ws("=", m["tag_key"], m["alias"])), ",").alias("matches"),
        F.array_join("using_columns", ",").alias("using_columns"), "target_alias", F.array_join("to_principals", ",").alias("to_principals"), "problem",
    )


def _inventory(f: Frames, label: bool = True) -> DataFrame:
    options = RunOptions(scope_type="ALL_CATALOGS", suggest_pii_tags=label, run_id="r1")
    state = f.state()
    return inventory_of(state.tables, state, options)


@query("I-01_inventory", f"""
SELECT 'r1' AS run_id, {KEY_OUT}, cn || '.' || sn || '.' || tn AS full_name, table_type, has_row_filter, row_filter_function, row_filter_columns, row_filter_expression_text,
  has_column_masks, column_masks, has_existing_abac_policy, existing_abac_policy_names, CASE WHEN eligibility_reason IS NULL THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END AS migration_eligibility,
  eligibility_reason, filter_label AS row_filter_suggested_pii_tag, mask_labels AS column_mask_suggested_pii_tags FROM inventory_rows""", _INVENTORY)
def inventory(f: Frames) -> DataFrame:
    masks = F.array_join(F.transform("column_masks", lambda m: F.concat(m["column"], F.lit("="), m["function"])), ";")
    return (
        _inventory(f)
        .drop("inventoried_at", "current_migration_status")
        .withColumns(
            {
                "row_filter_columns": F.array_join("row_filter_columns", ","),
                "column_masks": masks,
                "existing_abac_policy_names": F.array_join("existing_abac_policy_names", ","),
            }
        )
    )


@query("RUN_inventory_from_dump", f"""
SELECT {KEY_OUT}, table_type, has_row_filter, row_filter_function, has_column_masks, column_masks, existing_abac_policy_names, eligibility_reason FROM inventory_rows""",
    {**_INVENTORY, "have_filter": _INVENTORY["have_filter"].split(" WHERE")[0], "have_masks": _INVENTORY["have_masks"].replace("WHERE tid % 4 <> 0", "")})
def inventory_from_dump(f: Frames) -> DataFrame:
    """The inventory of a state made from listings alone: DESCRIBE lines, tags and policy descriptions."""
    none = f.spark.createDataFrame([], "tag_key string, allowed_values_text string, description string")
    state = state_from_listings(f.tables, f.dump, f.raw_column_tags, none, policy_lines(f), f.functions)
    rows = inventory_of(state.tables, state, RunOptions(scope_type="ALL_CATALOGS", run_id="r1"))
    masks = F.array_join(F.transform("column_masks", lambda m: F.concat(m["column"], F.lit("="), m["function"])), ";")
    return rows.select(
        *KEY, "table_type", "has_row_filter", "row_filter_function", "has_column_masks", masks.alias("column_masks"),
        F.array_join("existing_abac_policy_names", ",").alias("existing_abac_policy_names"), "eligibility_reason",
    )


@query("I-02_eligibility", f"""
SELECT coalesce(CASE WHEN describe_error IS NOT NULL THEN {REASON} WHEN NOT EXISTS (SELECT 1 FROM gov_objects o WHERE o.tid = t.tid) THEN 'NO_LEGACY_SECURITY_FOUND'
  WHEN table_type = 'VIEW' THEN 'UNSUPPORTED_TABLE_TYPE' END, 'ELIGIBLE') AS reason, count(*) AS n_tables FROM gov_tables t GROUP BY 1""")
def eligibility(f: Frames) -> DataFrame:
    """Tables with their rules untouched and no policies yet."""
    none = f.policies("TABLE").where(F.lit(False)).select(
        *[F.lit("").alias(c) for c in (*KEY, "object_type", "masked_column", "policy_name", "function_fqn")]
    )
    rows = build_inventory(f.tables, f.row_filters, f.masks, none, "r1")
    return rows.groupBy(F.coalesce("eligibility_reason", F.lit("ELIGIBLE")).alias("reason")).agg(F.count("*").alias("n_tables"))


@query("I-03_categories", _CATEGORY_SQL, _USES)
def categories(f: Frames) -> DataFrame:
    uses = f.row_filters.select("function_fqn", "using_columns").unionAll(
        f.masks.select("function_fqn", F.array("column").alias("using_columns"))
    )
    return uses.select(
        "function_fqn",
        F.array_join("using_columns", ",").alias("column_names"),
        category("function_fqn", "using_columns").alias("category"),
    ).distinct()


_WORDS = "ssn email phone credit_card date_of_birth address name national_id bank_account health salary business_unit region other none".split()
_NORMAL = f"""CASE WHEN length(text) = 0 OR text IS NULL THEN NULL WHEN w IN ({', '.join(f"'{w}'" for w in _WORDS)}) THEN w
  {' '.join(f"WHEN strpos(t, '{w}') > 0 THEN '{w}'" for w in _WORDS)} ELSE 'other' END"""


@query("I-04_normalized_labels", f"""
SELECT conv_id, turn, {_NORMAL} AS label FROM (SELECT conv_id, turn, text, t, regexp_replace(regexp_extract(t, '^\\s*(\\S+)', 1), '^[,.]+|[,.]+$', '', 'g') AS w
  FROM (SELECT conv_id, turn, text, regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '^\\.+|\\.+$', '', 'g'), '^[''"]+|[''"]+$', '', 'g') AS t
        FROM conversations))""")
def labels(f: Frames) -> DataFrame:
    return f.read("conversations").select("conv_id", "turn", normalize_label("text").alias("label"))


@query("I-05_mask_labels", f"SELECT {KEY_OUT}, labels AS column_mask_suggested_pii_tags FROM gov_tables JOIN have_masks USING (tn)", _INVENTORY)
def mask_labels(f: Frames) -> DataFrame:
    return masks_per_table(f.live_masks, label=True).select(*KEY, "column_mask_suggested_pii_tags")


@query("I-06_inventory_counts", """
SELECT count(*) AS tables_in_scope, count(*) FILTER (eligibility_reason IS NULL) AS tables_eligible, count(*) FILTER (eligibility_reason IS NOT NULL) AS tables_not_eligible FROM inventory_rows""", _INVENTORY)
def counts(f: Frames) -> DataFrame:
    return inventory_counts(_inventory(f, label=False))


@query("A-05_append_inventory", """
SELECT CASE WHEN eligibility_reason IS NULL THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END AS migration_eligibility, 2 * count(*) AS n_rows, 1 AS n_runs, 20 AS n_columns FROM inventory_rows GROUP BY 1""", _INVENTORY)
def appended(f: Frames) -> DataFrame:
    """Appended twice, a dry run in between writes nothing, read back with the full schema."""
    path = shared_folder(f.spark)
    rows = _inventory(f, label=False)
    append_inventory(rows, path)
    append_inventory(rows, path, dry_run=True)
    append_inventory(rows, path)
    back = read_table(f.spark, path, INVENTORY)
    return back.groupBy("migration_eligibility").agg(
        F.count("*").alias("n_rows"), F.count_distinct("run_id").alias("n_runs"), F.lit(len(back.columns)).alias("n_columns")
    )
