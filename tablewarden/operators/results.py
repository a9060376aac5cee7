"""From steps to table results and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import COLUMN_MASK, KEY, ROW_FILTER

WOULD = ("WOULD_MIGRATE", "WOULD_APPLY_ABAC", "WOULD_FINALIZE")


def weakest_link(status: Column | str = "status") -> Column:
    """Aggregate: a table's status from the statuses of its objects.

    Made of boolean aggregates only, which a hash aggregate holds in place and
    combines before the shuffle.  Statuses without a rule go alphabetically.
    """
    c = F.col(status) if isinstance(status, str) else status

    def some(*names: str) -> Column:
        return F.bool_or(c.isin(*names))

    def only(*names: str) -> Column:
        return F.bool_and(c.isin(*names))

    return (
        F.when(F.count(c) == 0, "NOT_ELIGIBLE")
        .when(some("FAILED"), "FAILED")
        .when(only("NOT_ELIGIBLE"), "NOT_ELIGIBLE")
        .when(some("WOULD_MIGRATE"), "WOULD_MIGRATE")
        .when(some("WOULD_APPLY_ABAC"), "WOULD_APPLY_ABAC")
        .when(some("WOULD_FINALIZE"), "WOULD_FINALIZE")
        .when(only("ALREADY_MIGRATED", "NOT_ELIGIBLE"), "ALREADY_MIGRATED")
        .when(some("ABAC_APPLIED"), "ABAC_APPLIED")
        .when(some("SUCCESS"), "SUCCESS")
        .when(some("ALREADY_MIGRATED"), "ALREADY_MIGRATED")
        .when(some("DRIFT"), "DRIFT")
        .when(some("NOT_ELIGIBLE"), "NOT_ELIGIBLE")
        .when(some("ROLLED_BACK"), "ROLLED_BACK")
        .when(some("SKIPPED"), "SKIPPED")
        .otherwise("WOULD_ROLLBACK")
    )


def phase_of(status: Column | str = "status") -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return (
        F.when(c.isin("SUCCESS", "ALREADY_MIGRATED"), "FINALIZED")
        .when(c == "ABAC_APPLIED", "ABAC_APPLIED")
        .when(c.isin(*WOULD), "DRY_RUN")
        .when(c == "FAILED", "FAILED")
        .otherwise("NOT_APPLICABLE")
    )


def rollback_phase_of(status: Column | str = "status") -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return (
        F.when(c == "ROLLED_BACK", "ROLLED_BACK")
        .when(c == "WOULD_ROLLBACK", "DRY_RUN")
        .when(c == "FAILED", "ROLLBACK_FAILED")
        .otherwise("NOT_APPLICABLE")
    )


def validation_of(status: Column | str = "status") -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return (
        F.when(c == "SUCCESS", "PASSED").when(c == "FAILED", "FAILED").when(c == "ABAC_APPLIED", "PARTIAL").otherwise("NOT_RUN")
    )


def step_order() -> Column:
    """Filter first, then masks in the order in which the table lists them."""
    return F.struct(
        F.when(F.col("object_type") == ROW_FILTER, 0).otherwise(1).alias("kind"),
        F.coalesce("position", F.lit(2**31 - 1)).alias("position"),
        F.coalesce("masked_column", F.lit("")).alias("column"),
    )


def none_steps(bare: DataFrame) -> DataFrame:
    """One NONE step for each of the tables *bare*."""
    return bare.select(*KEY).withColumns(
        {
            "object_type": F.lit("NONE"),
            "slot": F.lit(""),
            "status": F.lit("NOT_ELIGIBLE"),
            "error_code": F.lit("NO_LEGACY_SECURITY_FOUND"),
        }
    )


def with_none_steps(steps: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables without any object get one NONE step."""
    bare = tables.select(*KEY).join(steps.select(*KEY), KEY, "left_anti")
    return steps.unionByName(none_steps(bare), allowMissingColumns=True)


def table_results(steps: DataFrame) -> DataFrame:
    """One row per table.

    The maps and arrays are as long as the table has governed columns.
    """
    is_filter, is_mask = F.col("object_type") == ROW_FILTER, F.col("object_type") == COLUMN_MASK
    failed = F.col("status") == "FAILED"

    def by_column(value: str, when: Column | None = None) -> Column:
        keep = is_mask if when is None else is_mask & when
        pairs = F.collect_list(F.when(keep, F.struct("masked_column", value)))
        return F.map_from_entries(F.sort_array(pairs))

    def in_order(field: str) -> Column:
        entries = F.sort_array(F.collect_list(F.when(F.col(field).isNotNull(), F.struct(step_order().alias("o"), F.col(field).alias("v")))))
        return F.flatten(F.transform(entries, lambda e: e["v"]))

    def none_if_empty(c: Column) -> Column:
        return F.when(F.size(c) > 0, c)

    prepared = steps.withColumns(
        {
            "__masks": F.col("rollback.original_column_masks"),
            "__policies": F.col("rollback.abac_policies_created_by_this_run"),
        }
    )
    rolled = prepared.groupBy(*KEY).agg(
        weakest_link().alias("status"),
        F.max(F.when(is_filter, F.col("status"))).alias("row_filter_status"),
        by_column("status").alias("column_mask_status"),
        F.max(F.when(is_filter, F.col("source_function"))).alias("row_filter_function"),
        by_column("source_function").alias("column_mask_functions"),
        F.max(F.when(is_filter, F.col("target_policy_name"))).alias("row_filter_policy"),
        by_column("target_policy_name", F.col("target_policy_name").isNotNull()).alias("column_mask_policies"),
        F.min_by(F.when(failed, F.struct("error_code", "error_message")), F.when(failed, step_order())).alias("__error"),
        F.first(F.when(is_filter, F.col("rollback.original_row_filter")), ignorenulls=True).alias("__filter"),
        in_order("__masks").alias("__masks"),
        in_order("__policies").alias("__policies"),
        F.count("*").alias("n_steps"),
    )
    undo = F.struct(
        F.col("__filter").alias("original_row_filter"),
        none_if_empty(F.col("__masks")).alias("original_column_masks"),
        none_if_empty(F.col("__policies")).alias("abac_policies_created_by_this_run"),
    )
    return rolled.select(
        *KEY,
        "status",
        "row_filter_status",
        "column_mask_status",
        "row_filter_function",
        "column_mask_functions",
        "row_filter_policy",
        "column_mask_policies",
        F.col("__error.error_code").alias("error_code"),
        F.col("__error.error_message").alias("error_message"),
        F.when(F.size("__policies") > 0, F.to_json(undo)).alias("rollback_metadata"),
        validation_of().alias("validation_status"),
        phase_of().alias("migration_phase"),
        "n_steps",
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One row of counts.  NOT_ELIGIBLE results are in no bucket."""
    s = F.col("status")
    return results.agg(
        F.count_if(s == "SUCCESS").alias("tables_succeeded"),
        F.count_if(s == "ABAC_APPLIED").alias("tables_abac_applied"),
        F.count_if(s.isin(*WOULD)).alias("tables_would_migrate"),
        F.count_if(s == "ALREADY_MIGRATED").alias("tables_already_migrated"),
        F.count_if(s == "FAILED").alias("tables_failed"),
    )


def until_first_failure(results: DataFrame) -> DataFrame:
    """Results up to and including the first FAILED table in key order.

    The cut is one minimum over the failed tables, so no ordered pass over all
    rows is needed.
    """
    key = F.struct(*KEY)
    cut = results.where(F.col("status") == "FAILED").agg(F.min(key)).scalar()
    return results.where(cut.isNull() | (key <= cut))
