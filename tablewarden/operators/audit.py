"""Reading the append-only audit log: latest state and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.names import COLUMN_MASK, KEY, ROW_FILTER
from tablewarden.operators.results import phase_of, validation_of
from tablewarden.sources.deltas import ChangeLog, KeyedTable
from tablewarden.sources.schemas import AUDIT, conform

OBJECT_KEY = [*KEY, "object_type", "masked_column"]


def _newest_first() -> list[Column]:
    return [F.col("completed_at").desc_nulls_last(), F.col("attempt_id").desc()]


def _latest(audit: DataFrame, key: list[str]) -> DataFrame:
    """Newest row per key.  Spark keeps one row per key and partition before
    the shuffle, so an object with a long history is no hot spot."""
    w = Window.partitionBy(*key).orderBy(*_newest_first())
    return audit.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def latest_per_object(audit: DataFrame) -> DataFrame:
    """Current state: the newest row of every object, NULL columns being one key."""
    return _latest(audit, OBJECT_KEY)


def latest_per_table(audit: DataFrame) -> DataFrame:
    """The newest row of every table, whichever object it is about."""
    return _latest(audit, KEY)


def kept_latest(log: ChangeLog, name: str = "latest_per_object", key: tuple[str, ...] = tuple(OBJECT_KEY), buckets: int = 64) -> KeyedTable:
    """The newest audit row of every object (or table: ``KEY``) as a table that ``keep_latest`` keeps up."""
    return KeyedTable(log, name, AUDIT, key, ("completed_at", "attempt_id"), buckets)


def keep_latest(latest: KeyedTable, rows: DataFrame) -> int:
    """Take up *rows* that were appended to the audit log; only the buckets of their keys are read and rewritten.

    The same row wins as over the whole log, in whatever order rows come in, and
    rows taken up twice change nothing.  Returns the version.
    """
    return latest.merge(_latest(conform(rows, AUDIT), list(latest.key)))


def audit_rows(
    steps: DataFrame, results: DataFrame, run_id: str, attempt: str, started_at: Column, completed_at: Column, dry_run: bool
) -> DataFrame:
    """Audit rows, one per step; validation status and phase are the table's.

    ``attempt_id`` is a digest of *attempt* (unique per call) and the object,
    so that a task that runs again writes the same rows.
    """
    of_table = results.select(*KEY, F.col("status").alias("table_status"))
    is_object = F.col("object_type").isin(ROW_FILTER, COLUMN_MASK)
    return steps.join(of_table, KEY, "left").select(
        F.lit(run_id).alias("run_id"),
        F.sha2(F.concat_ws("|", F.lit(attempt), *KEY, "object_type", "slot"), 256).alias("attempt_id"),
        *KEY,
        "object_type",
        "masked_column",
        F.when(is_object, F.col("object_type")).alias("source_security_type"),
        "source_function",
        F.when(
            is_object & F.col("source_function").isNotNull(),
            F.when(F.col("object_type") == ROW_FILTER,
                   F.concat("source_function", F.lit(" ON ("), F.array_join(F.coalesce("using_columns", F.array()), ", "), F.lit(")")))
            .otherwise(F.concat("source_function", F.lit(" ON ("), "masked_column", F.lit(")"))),
        ).alias("source_definition"),
        "target_policy_name",
        F.when(F.col("target_policy_name").isNotNull(), F.col("object_type")).alias("target_policy_type"),
        "target_definition",
        "status",
        "error_code",
        "error_message",
        validation_of("table_status").alias("validation_status"),
        F.to_json("rollback").alias("rollback_metadata"),
        phase_of("table_status").alias("migration_phase"),
        started_at.alias("started_at"),
        completed_at.alias("completed_at"),
        F.lit(dry_run).alias("dry_run"),
    )


def latest_inventory(inventory: DataFrame) -> DataFrame:
    """What the newest inventory run found, newest first."""
    newest = inventory.agg(F.max_by("run_id", "inventoried_at")).scalar()
    return inventory.where(F.col("run_id") == newest).orderBy(F.col("inventoried_at").desc(), *KEY)


def history(audit: DataFrame) -> DataFrame:
    return audit.orderBy(*_newest_first())


def failures(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("status") == "FAILED").orderBy(*_newest_first())


def stuck_tables(audit: DataFrame) -> DataFrame:
    """Tables with a policy applied whose old rule was not removed yet."""
    latest = latest_per_object(audit.select(*OBJECT_KEY, "attempt_id", "completed_at", "migration_phase"))
    return latest.where(F.col("migration_phase") == "ABAC_APPLIED").select(*KEY).distinct()


def grants_of_run(tag_grants: DataFrame, run_id: str) -> DataFrame:
    return tag_grants.where(F.col("run_id") == run_id).orderBy("granted_at", "tag_key")


def failed_grants(tag_grants: DataFrame) -> DataFrame:
    return tag_grants.where(F.col("status") == "FAILED")
