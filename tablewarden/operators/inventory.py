"""One inventory row per table in scope, with its eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.labels import category, error_reason
from tablewarden.functions.names import KEY, full_name

# Table kinds that can be migrated.
SUPPORTED_KINDS = ["MANAGED", "EXTERNAL", "STREAMING_TABLE", "MATERIALIZED_VIEW"]


def eligibility_reason(has_filter: Column, has_masks: Column, has_policy: Column, kind: Column) -> Column:
    """Why a table cannot be migrated; NULL if it can."""
    return F.when(~has_filter & ~has_masks & ~has_policy, "NO_LEGACY_SECURITY_FOUND").when(
        ~kind.isin(SUPPORTED_KINDS), "UNSUPPORTED_TABLE_TYPE"
    )


def masks_per_table(masks: DataFrame, label: bool = False) -> DataFrame:
    """The masks of each table as one array, in listing order, as long as the
    table has masked columns; with *label* also their categories as JSON."""
    position = F.col("position") if "position" in masks.columns else F.lit(None).cast("int")
    pii = category("function_fqn", F.array("column")) if label else F.lit(None).cast("string")
    entries = masks.select(
        *KEY, F.struct(position.alias("position"), "column", F.col("function_fqn").alias("function"), pii.alias("pii")).alias("m")
    )
    listed = entries.groupBy(*KEY).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    labelled = F.filter("ms", lambda m: m["pii"].isNotNull())
    by_column = F.map_from_entries(F.sort_array(F.transform(labelled, lambda m: F.struct(m["column"], m["pii"]))))
    return listed.select(
        *KEY,
        F.transform("ms", lambda m: F.struct(m["column"].alias("column"), m["function"].alias("function"))).alias("column_masks"),
        F.when(F.size(labelled) > 0, F.to_json(by_column)).alias("column_mask_suggested_pii_tags"),
    )


def build_inventory(
    tables: DataFrame,
    row_filters: DataFrame,
    masks: DataFrame,
    existing: DataFrame,
    run_id: str,
    label: bool = False,
    latest_status: DataFrame | None = None,
) -> DataFrame:
    """Inventory rows (schema ``sources.schemas.INVENTORY``) for *tables*.

    All joins are on the table key.  A table that could not be described gives
    a NOT_ELIGIBLE row of kind UNKNOWN with the error's text.
    """
    policies = existing.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct((F.col("object_type") != "ROW_FILTER").alias("o"), "policy_name"))).alias("ps")
    )
    filters = row_filters.select(
        *KEY,
        F.col("function_fqn").alias("row_filter_function"),
        F.col("using_columns").alias("row_filter_columns"),
        (F.col("raw_text") if "raw_text" in row_filters.columns else F.lit("")).alias("raw_text"),
    )
    joined = (
        tables.join(filters, KEY, "left").join(masks_per_table(masks, label), KEY, "left").join(policies, KEY, "left")
    )
    joined = (
        joined.withColumn("current_migration_status", F.lit(None).cast("string"))
        if latest_status is None
        else joined.join(latest_status.select(*KEY, F.col("status").alias("current_migration_status")), KEY, "left")
    )
    ok = F.col("describe_error").isNull()
    no_text = F.array().cast("array<string>")
    has_filter = ok & F.col("row_filter_function").isNotNull()
    has_masks = ok & F.col("column_masks").isNotNull()
    has_policy = ok & F.col("ps").isNotNull()
    reason = F.coalesce(
        error_reason("describe_error"), eligibility_reason(has_filter, has_masks, has_policy, F.col("table_type"))
    )
    filter_pii = (
        F.when(has_filter, category("row_filter_function", "row_filter_columns")) if label else F.lit(None).cast("string")
    )
    return joined.select(
        F.lit(run_id).alias("run_id"),
        F.current_timestamp().alias("inventoried_at"),
        *KEY,
        full_name().alias("full_name"),
        F.when(ok, F.col("table_type")).otherwise("UNKNOWN").alias("table_type"),
        has_filter.alias("has_row_filter"),
        F.when(has_filter, F.col("row_filter_function")).alias("row_filter_function"),
        F.when(has_filter, F.col("row_filter_columns")).otherwise(no_text).alias("row_filter_columns"),
        F.coalesce("describe_error", "raw_text", F.lit("")).alias("row_filter_expression_text"),
        has_masks.alias("has_column_masks"),
        F.when(has_masks, F.col("column_masks"))
        .otherwise(F.array().cast("array<struct<column:string,function:string>>"))
        .alias("column_masks"),
        has_policy.alias("has_existing_abac_policy"),
        F.when(has_policy, F.transform("ps", lambda p: p["policy_name"])).otherwise(no_text).alias("existing_abac_policy_names"),
        F.when(reason.isNull(), "ELIGIBLE").otherwise("NOT_ELIGIBLE").alias("migration_eligibility"),
        reason.alias("eligibility_reason"),
        "current_migration_status",
        filter_pii.alias("row_filter_suggested_pii_tag"),
        F.when(has_masks, F.col("column_mask_suggested_pii_tags")).alias("column_mask_suggested_pii_tags"),
    )


def inventory_counts(inventory: DataFrame) -> DataFrame:
    eligible = F.col("migration_eligibility") == "ELIGIBLE"
    return inventory.agg(
        F.count("*").alias("tables_in_scope"),
        F.count_if(eligible).alias("tables_eligible"),
        F.count_if(~eligible).alias("tables_not_eligible"),
    )
