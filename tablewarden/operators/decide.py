"""What to do with each row filter and masked column, and how it ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import (
    COLUMN_MASK,
    KEY,
    ROW_FILTER,
    mask_policy_name,
    row_filter_policy_name,
    securable,
)
from tablewarden.operators.catalog import function_status
from tablewarden.operators.policies import definition_text, table_policies_by_object

PHASES = ("FULL", "APPLY_ABAC", "FINALIZE")

# Objects are keyed by table, type and slot: the masked column, or '' for the filter.
OBJECT = [*KEY, "object_type", "slot"]


def legacy_objects(row_filters: DataFrame, masks: DataFrame) -> DataFrame:
    """Old rules as one frame, one row per object."""
    no_columns = F.array().cast("array<string>")
    position = F.col("position") if "position" in masks.columns else F.lit(None).cast("int")
    return row_filters.select(
        *KEY,
        F.lit(ROW_FILTER).alias("object_type"),
        F.lit("").alias("slot"),
        F.col("function_fqn").alias("legacy_function"),
        "using_columns",
        F.lit(None).cast("int").alias("position"),
    ).unionByName(
        masks.select(
            *KEY,
            F.lit(COLUMN_MASK).alias("object_type"),
            F.col("column").alias("slot"),
            F.col("function_fqn").alias("legacy_function"),
            no_columns.alias("using_columns"),
            position.alias("position"),
        )
    )


def applicable_objects(
    row_filters: DataFrame,
    masks: DataFrame,
    existing: DataFrame,
    tables: DataFrame | None = None,
    named: DataFrame | None = None,
) -> DataFrame:
    """Objects with an old rule, a policy of an earlier run, or both; of *tables* only if given.

    Each side has one row per object, so a union and one aggregation by object
    bring them together.  The semi join shuffles by table, which the
    aggregation can use as it is.  *named* (object and ``described_function``)
    only adds that column.
    """
    found = existing.select(
        *KEY,
        "object_type",
        F.coalesce("masked_column", F.lit("")).alias("slot"),
        F.col("policy_name").alias("existing_name"),
        F.col("function_fqn").alias("existing_function"),
    )
    sides = legacy_objects(row_filters, masks).unionByName(found, allowMissingColumns=True)
    fields = ["legacy_function", "using_columns", "position", "existing_name", "existing_function"]
    if named is not None:
        fields.append("described_function")
        sides = sides.unionByName(named.select(*OBJECT, "described_function"), allowMissingColumns=True)
    if tables is not None:
        sides = sides.join(tables.select(*KEY), KEY, "left_semi")
    objects = sides.groupBy(*OBJECT).agg(*[F.first(c, ignorenulls=True).alias(c) for c in fields])
    return objects.where(F.col("legacy_function").isNotNull() | F.col("existing_function").isNotNull())


def policy_name(scope: str, team_prefix: str = "", function: str = "legacy_function") -> Column:
    """Deterministic policy name of an object."""
    return F.when(
        F.col("object_type") == ROW_FILTER, row_filter_policy_name(function, scope, team_prefix)
    ).otherwise(mask_policy_name("slot", function, scope, team_prefix))


def plan_objects(
    row_filters: DataFrame,
    masks: DataFrame,
    existing: DataFrame,
    policies: DataFrame,
    functions: DataFrame,
    scope: str = "TABLE",
    team_prefix: str = "",
    tables: DataFrame | None = None,
) -> DataFrame:
    """Decision per object: PROCEED, ALREADY_MIGRATED, NOT_ELIGIBLE or FAILED.

    An old rule that is still there is never ALREADY_MIGRATED, so a run that
    stopped half-way is taken up again.  A policy row without a function is one
    that is listed but cannot be described.
    """
    names = {"on_securable": securable(scope), "policy_name": policy_name(scope, team_prefix)}
    if scope == "TABLE":
        # The policy of an object's name sits on the object's own table.
        named = table_policies_by_object(policies, team_prefix).withColumnRenamed("function_fqn", "described_function")
        objects = applicable_objects(row_filters, masks, existing, tables, named).withColumns(names)
    else:
        named = policies.select("on_securable", "policy_name", F.col("function_fqn").alias("described_function"))
        objects = applicable_objects(row_filters, masks, existing, tables).withColumns(names)
        objects = objects.join(named, ["on_securable", "policy_name"], "left")
    checked = function_status(objects.withColumn("function_fqn", F.col("legacy_function")), functions)

    legacy = F.col("legacy_function").isNotNull()
    described = F.col("described_function").isNotNull()
    conflict = described & (F.col("described_function") != F.col("legacy_function"))
    reason = (
        F.when(~legacy, F.lit(None).cast("string"))
        .when(~F.col("function_exists"), "SOURCE_FUNCTION_NOT_FOUND")
        .when(~F.col("function_executable"), "SOURCE_FUNCTION_NOT_ACCESSIBLE")
        .when(conflict, "EXISTING_ABAC_POLICY_CONFLICT")
    )
    decision = (
        F.when(~legacy, "ALREADY_MIGRATED")
        .when(~F.col("function_exists") | ~F.col("function_executable"), "FAILED")
        .when(conflict, "NOT_ELIGIBLE")
        .otherwise("PROCEED")
    )
    return checked.select(
        *OBJECT,
        F.when(F.col("object_type") == COLUMN_MASK, F.col("slot")).alias("masked_column"),
        F.coalesce("legacy_function", "existing_function").alias("source_function"),
        F.coalesce("using_columns", F.array().cast("array<string>")).alias("using_columns"),
        "position",
        "on_securable",
        "policy_name",
        "described_function",
        decision.alias("decision"),
        reason.alias("reason_code"),
        (legacy & described).alias("abac_already_applied"),
        F.when(~legacy, F.col("existing_name"))
        .when((decision == "NOT_ELIGIBLE") & conflict, F.col("policy_name"))
        .alias("existing_policy_name"),
    )


# What an executor of the state change reports per object; none by default.
FAULTS = (
    "create_failed boolean, create_error_code string, create_error_message string, "
    "verify_failed boolean, removal_error string, legacy_remains boolean"
)
_FAULT_COLUMNS = ["create_failed", "create_error_code", "create_error_message",
                  "verify_failed", "removal_error", "legacy_remains"]


def with_faults(objects: DataFrame, faults: DataFrame | None) -> DataFrame:
    if faults is None:
        none = F.lit(None)
        return objects.withColumns(
            {c: none.cast("string" if c.endswith(("code", "message", "_error")) else "boolean") for c in _FAULT_COLUMNS}
        )
    return objects.join(faults.select(*OBJECT, *_FAULT_COLUMNS), OBJECT, "left")


def rollback_metadata(when: Column) -> Column:
    """What undoing the object needs, as a struct; NULL where *when* does not hold."""
    is_filter = F.col("object_type") == ROW_FILTER
    original_filter = F.struct(F.col("source_function").alias("function"), F.col("using_columns"))
    original_mask = F.struct(F.col("masked_column").alias("column"), F.col("source_function").alias("function"))
    created = F.struct(F.col("policy_name"), F.col("on_securable"), F.col("object_type").alias("policy_type"))
    return F.when(
        when,
        F.struct(
            F.when(is_filter, original_filter).alias("original_row_filter"),
            F.when(~is_filter, F.array(original_mask)).alias("original_column_masks"),
            F.array(created).alias("abac_policies_created_by_this_run"),
        ),
    )


def outcomes(objects: DataFrame, phase: str = "FULL", dry_run: bool = False) -> DataFrame:
    """One step per object: its status, error, definition text and rollback data.

    *objects* went through ``with_match_columns`` and ``plan_policies`` (not
    needed for FINALIZE) and ``with_faults``.  ``policy_created`` and
    ``legacy_removed`` tell what changed.
    """
    if phase not in PHASES:
        raise ValueError(f"unknown phase: {phase}")
    go = F.col("decision") == "PROCEED"
    is_filter = F.col("object_type") == ROW_FILTER
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    finalize = phase == "FINALIZE"

    removal = [
        (F.col("removal_error").isNotNull(), "FAILED", F.lit("LEGACY_REMOVAL_FAILED")),
        (yes("legacy_remains"), "FAILED", F.lit("FINAL_STATE_VERIFY_FAILED")),
        (F.lit(True), "SUCCESS", None),
    ]
    create = [
        (yes("create_failed"), "FAILED", F.coalesce("create_error_code", F.lit("POLICY_CREATE_FAILED"))),
        (yes("verify_failed"), "FAILED", F.lit("POLICY_VERIFY_FAILED")),
    ]
    untagged = F.when(is_filter, "RLS_TAG_COLLISION_UNRESOLVABLE").otherwise("TAG_RESOLUTION_MISSING")
    if finalize:
        ladder = [
            (~F.col("abac_already_applied"), "NOT_ELIGIBLE", F.lit("ABAC_NOT_APPLIED_YET")),
            (yes("verify_failed"), "FAILED", F.lit("POLICY_VERIFY_FAILED")),
        ]
        ladder += [(F.lit(True), "WOULD_FINALIZE", None)] if dry_run else removal
    else:
        ladder = [(F.col("tag_missing"), "FAILED", untagged)]
        if dry_run:
            ladder += [(F.lit(True), "WOULD_MIGRATE" if phase == "FULL" else "WOULD_APPLY_ABAC", None)]
        elif phase == "APPLY_ABAC":
            ladder += [*create, (F.lit(True), "ABAC_APPLIED", None)]
        else:
            ladder += [*create, *removal]

    status = F.when(~go, F.col("decision"))
    code = F.when(~go, F.col("reason_code"))
    for condition, new_status, new_code in ladder:
        status = status.when(condition, F.lit(new_status))
        code = code.when(condition, F.lit(None).cast("string") if new_code is None else new_code)

    stepped = objects.withColumns({"status": status, "error_code": code})
    failed = lambda *codes: F.coalesce(F.col("error_code").isin(*codes), F.lit(False))
    if finalize:
        keeps = go & ~failed("ABAC_NOT_APPLIED_YET", "POLICY_VERIFY_FAILED")
        attempted = go & ~failed("ABAC_NOT_APPLIED_YET")
        created = F.lit(False)
        text = F.lit(None).cast("string")
    else:
        attempted = go & ~F.col("tag_missing")
        keeps = attempted if dry_run else attempted & ~yes("create_failed")
        created = F.lit(False) if dry_run else keeps
        text = F.lit(None).cast("string") if dry_run else F.when(attempted, definition_text())
    message = (
        F.when(failed("LEGACY_REMOVAL_FAILED"), F.col("removal_error"))
        .when(failed("ABAC_NOT_APPLIED_YET"), F.lit("No policy found for this object yet: apply it first."))
        .when(attempted & yes("create_failed") & (F.col("status") == "FAILED"), F.col("create_error_message"))
        .when(failed("RLS_TAG_COLLISION_UNRESOLVABLE"),
              F.lit("A row-filter column shares its tag key with another column of the table."))
        .when(failed("TAG_RESOLUTION_MISSING"), F.concat(F.lit("No tag for masked column "), "masked_column"))
    )
    return stepped.withColumns(
        {
            "target_policy_name": F.when(attempted, F.col("policy_name")).otherwise(F.col("existing_policy_name")),
            "target_definition": text,
            "error_message": message,
            "rollback": rollback_metadata(keeps),
            "policy_created": F.coalesce(created, F.lit(False)),
            "legacy_removed": go & (F.col("status") == "SUCCESS"),
        }
    )
