"""Schemas of the governance frames.

``catalog, schema, table`` is the table key.  Keys are unique: a table in
``tables`` and ``row_filters``, table and column in ``masks``, table, column
and tag key in ``column_tags``, the tag key in ``governed_tags``, the function
in ``functions``, securable and name in ``policies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = "catalog string, schema string, `table` string"

TABLES = f"{_KEY}, table_type string, describe_error string"
ROW_FILTERS = f"{_KEY}, function_fqn string, using_columns array<string>, raw_text string"
MASKS = f"{_KEY}, column string, function_fqn string, raw_text string, position int"
COLUMN_TAGS = f"{_KEY}, column string, tag_key string, tag_value string"
GOVERNED_TAGS = "tag_key string, allowed_values array<string>, description string"
FUNCTIONS = "function_fqn string, executable boolean"
MEMBERSHIP = "group_name string, member_email string"
GRANT_RULES = "tag_key string, role string, principals array<string>"
MATCH_COLUMN = "struct<tag_key:string,tag_value:string,alias:string,source_column:string>"
POLICIES = (
    "on_securable string, policy_name string, policy_type string, function_fqn string, "
    f"match_columns array<{MATCH_COLUMN}>, using_columns array<string>, target_alias string, "
    "to_principals array<string>, except_principals array<string>, comment string"
)

# A listing adds these two: the conditions of aliases whose clause in match_columns has no tag key
# (postfix, see functions.conditions), and why a policy cannot be understood, so that reading fails where it binds.
LISTED = "conditions array<struct<alias:string,condition:array<struct<op:string,tag_key:string,tag_value:string>>>>, problem string"

# What a policy protected when a run last looked: one row per object (slot: the masked column, '' for the filter).
COVERAGE = f"{_KEY}, object_type string, slot string, on_securable string, policy_name string, run_id string, since timestamp"

# Columns and types of the persisted tables (20, 22 and 9 columns).
INVENTORY = (
    f"run_id string, inventoried_at timestamp, {_KEY}, full_name string, table_type string, "
    "has_row_filter boolean, row_filter_function string, row_filter_columns array<string>, "
    "row_filter_expression_text string, has_column_masks boolean, "
    "column_masks array<struct<column:string,function:string>>, has_existing_abac_policy boolean, "
    "existing_abac_policy_names array<string>, migration_eligibility string, eligibility_reason string, "
    "current_migration_status string, row_filter_suggested_pii_tag string, column_mask_suggested_pii_tags string"
)
AUDIT = (
    f"run_id string, attempt_id string, {_KEY}, object_type string, masked_column string, "
    "source_security_type string, source_function string, source_definition string, "
    "target_policy_name string, target_policy_type string, target_definition string, status string, "
    "error_code string, error_message string, validation_status string, rollback_metadata string, "
    "migration_phase string, started_at timestamp, completed_at timestamp, dry_run boolean"
)
TAG_GRANTS = (
    "run_id string, tag_key string, principals array<string>, role string, status string, "
    "error_code string, error_message string, dry_run boolean, granted_at timestamp"
)

# What a step keeps for undoing it, stored as JSON text in the audit.
ROLLBACK_METADATA = (
    "struct<original_row_filter:struct<function:string,using_columns:array<string>>,"
    "original_column_masks:array<struct<column:string,function:string>>,"
    "abac_policies_created_by_this_run:array<struct<policy_name:string,on_securable:string,policy_type:string>>>"
)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], schema(ddl))


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """*df* with exactly the columns of *ddl*, in order and type.

    Columns that an older table lacks are NULL; names match without regard to
    case; columns it has beyond the schema are dropped.
    """
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema(ddl)
        ]
    )
