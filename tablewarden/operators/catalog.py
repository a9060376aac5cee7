"""Scope and metadata lookups over the governance frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.conditions import is_plain, parse_conditions
from tablewarden.functions.labels import error_reason
from tablewarden.functions.names import COLUMN_MASK, KEY, ROW_FILTER
from tablewarden.sources.schemas import MATCH_COLUMN
from tablewarden.sources.store import cut_lineage

SCOPES = ("ALL_CATALOGS", "SELECTED_CATALOGS", "ALL_SCHEMAS", "SELECTED_SCHEMAS", "SPECIFIC_TABLES")


def list_catalogs(tables: DataFrame) -> DataFrame:
    return tables.select("catalog").distinct()


def list_schemas(tables: DataFrame, catalog: str | None = None) -> DataFrame:
    rows = tables if catalog is None else tables.where(F.col("catalog") == catalog)
    return rows.select("catalog", "schema").distinct()


def list_tables(tables: DataFrame, catalog: str | None = None, schema: str | None = None) -> DataFrame:
    for name, value in (("catalog", catalog), ("schema", schema)):
        if value is not None:
            tables = tables.where(F.col(name) == value)
    return tables.select(*KEY)


def list_session_tables(spark: SparkSession) -> DataFrame:
    """Tables that the session's own catalog lists, in the frame's shape."""
    rows = [
        (t.catalog or "spark_catalog", (t.namespace or [""])[-1], t.name, t.tableType, None)
        for db in spark.catalog.listDatabases()
        for t in spark.catalog.listTables(db.name)
        if not t.isTemporary
    ]
    return spark.createDataFrame(rows, "catalog string, schema string, `table` string, table_type string, describe_error string")


def parse_table_names(names: DataFrame) -> DataFrame:
    """Column ``name`` split into the table key; anything but three parts carries an error."""
    parts = F.split("name", r"\.")
    ok = F.size(parts) == 3
    return names.select(
        "name",
        *[F.when(ok, F.get(parts, F.lit(i))).alias(k) for i, k in enumerate(KEY)],
        F.when(~ok, F.concat(F.lit("Expected catalog.schema.table, got: "), "name")).alias("error_message"),
    )


def resolve_scope(
    tables: DataFrame,
    scope: str,
    catalogs: list[str] | None = None,
    schemas: dict[str, list[str]] | None = None,
    names: DataFrame | None = None,
    exclude_schema_regex: str = "",
) -> DataFrame:
    """Rows of *tables* in scope; for named tables their keys alone.

    The selections are options typed by a user, so they become literals that
    reach the scan.  Named tables are taken as they are, listed or not, and the
    schema exclusion does not touch them.
    """
    if scope == "SPECIFIC_TABLES":
        return parse_table_names(names).where(F.col("error_message").isNull()).select(*KEY).distinct()
    rows = tables
    if scope == "SELECTED_CATALOGS" or (scope == "ALL_SCHEMAS" and catalogs):
        rows = rows.where(F.col("catalog").isin(list(catalogs or [])))
    elif scope == "SELECTED_SCHEMAS":
        wanted = F.lit(False)
        for catalog, names_of in (schemas or {}).items():
            wanted = wanted | ((F.col("catalog") == catalog) & F.col("schema").isin(list(names_of)))
        rows = rows.where(wanted)
    elif scope not in ("ALL_CATALOGS", "ALL_SCHEMAS"):
        raise ValueError(f"unknown scope: {scope}")
    return rows.where(~F.col("schema").rlike(exclude_schema_regex)) if exclude_schema_regex else rows


def listing_action(scope: str, message: Column | str, code: Column | str | None = None) -> Column:
    """``skip`` or ``raise`` for an error met while listing a catalog or schema.

    Sources that can never be governed are skipped in every scope; a missing
    permission only where the catalogs were discovered, not asked for.
    """
    reason = error_reason(message, code)
    skipped = ["FEDERATION_UNREACHABLE", "UNSUPPORTED_DATA_SOURCE"]
    if scope in ("ALL_CATALOGS", "ALL_SCHEMAS"):
        skipped.append("PERMISSION_DENIED")
    return F.when(reason.isin(skipped), "skip").when(reason.isNotNull(), "raise")


def normalize_column_tags(column_tags: DataFrame) -> DataFrame:
    """An empty tag value means a key-only tag, that is NULL."""
    return column_tags.withColumn("tag_value", F.nullif("tag_value", F.lit("")))


def _comma_list(c: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_policies(rows: DataFrame) -> DataFrame:
    """Policy listing with its comma-separated text fields turned into arrays."""
    fields = ("to_principals", "except_principals", "match_columns", "using_columns")
    return rows.withColumns({c: _comma_list(c) for c in fields if c in rows.columns})


# Labels of a policy's description -> field; the nested ones are indented in a listing.
_DESCRIBED = {
    "Name": "policy_name", "Policy Type": "policy_type", "On Securable Type": "securable_type", "On Securable": "securable", "Comment": "comment",
    "To Principals": "to_principals", "Except Principals": "except_principals", "Match Columns": "match_text",
    "Function Name": "function_fqn", "Using Columns": "using_columns", "On Column": "target_alias",
}
# Lines that say nothing about what a policy does.
_NEUTRAL = ("Owner", "Created At", "Created By", "Created Time", "Updated At", "Updated By", "Updated Time", "Id", "For Securable Type")
_PARTS = {"TABLE": 3, "SCHEMA": 2, "CATALOG": 1}


def _securable(kind: Column, name: Column) -> Column:
    """``KIND `a`.`b` `` from a type and a name with or without backticks; NULL for other types and other numbers of parts."""
    parts = F.regexp_extract_all(name, F.lit("`([^`]+)`|([^.`]+)"), F.lit(0))
    ticked = F.transform(parts, lambda p: F.concat(F.lit("`"), F.replace(p, F.lit("`"), F.lit("")), F.lit("`")))
    fits = reduce(Column.__or__, [(kind == k) & (F.size(parts) == n) for k, n in _PARTS.items()])
    return F.when(fits, F.concat_ws(" ", kind, F.array_join(ticked, ".")))


def described_policies(lines: DataFrame) -> DataFrame:
    """Policy rows (``schemas.POLICIES`` and ``schemas.LISTED``) from description lines ``policy_id, name, value``.

    One aggregation over all lines.  Every description gives a row: one that is
    not wholly understood says why in ``problem``, and whatever reads a table
    that it may guard fails.  That is a type or securable that is unknown or
    missing, a missing name, function or list of principals, a line of an unknown label, and a match
    text that is no list of conditions with aliases.  A clause of one tag test
    has its key in ``match_columns``; any other has a NULL key there and its
    condition in ``conditions``.  The rows are written once: every read of a
    table looks at them several times, and the texts are to be read only here.
    """
    value = F.nullif(F.trim("value"), F.lit(""))
    label = F.trim("name")
    unknown = F.when(value.isNotNull() & ~label.isin(*_DESCRIBED, *_NEUTRAL), label)
    fields = lines.groupBy("policy_id").agg(
        *[F.max(F.when(label == text, value)).alias(c) for text, c in _DESCRIBED.items()], F.min(unknown).alias("unknown_label")
    )
    fields = fields.withColumns({"parsed": parse_conditions(F.col("match_text")), "on_securable": _securable(F.upper("securable_type"), F.col("securable"))})
    kind = F.when(F.upper("policy_type").contains("MASK"), COLUMN_MASK).when(F.upper("policy_type").contains("FILTER"), ROW_FILTER)
    plain = lambda c: is_plain(c["condition"])
    match = F.transform(
        "parsed.clauses",
        lambda c: F.struct(
            F.when(plain(c), c["condition"][0]["tag_key"]).alias("tag_key"),
            F.when(plain(c), c["condition"][0]["tag_value"]).alias("tag_value"),
            c["alias"].alias("alias"),
            F.lit(None).cast("string").alias("source_column"),
        ),
    ).cast(f"array<{MATCH_COLUMN}>")
    problem = (
        F.when(F.col("policy_name").isNull(), "no name")
        .when(F.col("on_securable").isNull(), F.concat_ws(" ", F.lit("unknown securable:"), "securable_type", "securable"))
        .when(kind.isNull(), F.concat_ws(" ", F.lit("unknown type:"), "policy_type"))
        .when(F.col("unknown_label").isNotNull(), F.concat(F.lit("unknown label: "), "unknown_label"))
        .when(F.col("parsed.error").isNotNull(), F.concat(F.lit("match columns: "), "parsed.error"))
        .when(F.col("function_fqn").isNull(), "no function")
        .when(F.size(_comma_list("to_principals")) == 0, "no principals")
    )
    found = fields.select(
        "on_securable",
        F.coalesce("policy_name", F.concat(F.lit("policy "), F.col("policy_id").cast("string"))).alias("policy_name"),
        kind.alias("policy_type"),
        F.replace(F.col("function_fqn"), F.lit("`"), F.lit("")).alias("function_fqn"),
        match.alias("match_columns"),
        _comma_list("using_columns").alias("using_columns"),
        "target_alias",
        F.transform(_comma_list("to_principals"), lambda p: F.replace(p, F.lit("`"), F.lit(""))).alias("to_principals"),
        F.transform(_comma_list("except_principals"), lambda p: F.replace(p, F.lit("`"), F.lit(""))).alias("except_principals"),
        "comment",
        F.filter("parsed.clauses", lambda c: ~plain(c)).alias("conditions"),
        problem.alias("problem"),
    )
    return cut_lineage(found)


def policies_on(policies: DataFrame, on_securable: str, policy_name: str | None = None) -> DataFrame:
    """Policies of one securable, or the one of that name."""
    rows = policies.where(F.col("on_securable") == on_securable)
    return rows if policy_name is None else rows.where(F.col("policy_name") == policy_name)


def policies_by_schema(policies: DataFrame) -> DataFrame:
    """Counts of table-level policies per catalog and schema, for bulk audit."""
    parts = F.regexp_extract_all("on_securable", F.lit("`([^`]+)`"), 1)
    return (
        policies.where(F.startswith("on_securable", F.lit("TABLE ")))
        .select(F.get(parts, F.lit(0)).alias("catalog"), F.get(parts, F.lit(1)).alias("schema"), "policy_type")
        .groupBy("catalog", "schema", "policy_type")
        .agg(F.count("*").alias("n_policies"))
    )


def function_status(used: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds ``function_exists`` and ``function_executable`` to rows with a ``function_fqn``."""
    known = functions.select("function_fqn", F.coalesce("executable", F.lit(False)).alias("__executable"))
    return used.join(known, "function_fqn", "left").select(
        *[F.col(c) for c in used.columns],
        F.col("__executable").isNotNull().alias("function_exists"),
        F.coalesce("__executable", F.lit(False)).alias("function_executable"),
    )


def parse_allowed_values(text: Column | str) -> Column:
    """``['a', "b"]`` as an array; empty text or ``[]`` means the tag is key-only."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    items = F.split(F.regexp_replace(c, r"^\[+|\]+$", ""), ",")
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(trimmed, lambda x: F.regexp_replace(x, "^['\"]+|['\"]+$", ""))


def parse_governed_tags(rows: DataFrame) -> DataFrame:
    """Tag listing (``tag_key, allowed_values_text, description``) as the governed-tags frame."""
    return rows.select(
        "tag_key",
        parse_allowed_values("allowed_values_text").alias("allowed_values"),
        F.coalesce("description", F.lit("")).alias("description"),
    )
