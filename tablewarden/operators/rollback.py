"""Undoing a run from what its audit rows kept.

Old rules are restored first and policies dropped after, so that a table is
never without protection; a failed restore keeps its policy.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.names import COLUMN_MASK, KEY, ROW_FILTER, catalog_securable
from tablewarden.operators.catalog import function_status
from tablewarden.operators.decide import policy_name
from tablewarden.operators.results import rollback_phase_of
from tablewarden.sources.schemas import AUDIT, ROLLBACK_METADATA, conform
from tablewarden.sources.store import cut_lineage, rows_for_run

ATTEMPT = ["attempt_id", *KEY]
OBJECT = [*KEY, "object_type", "slot"]
LATER_RUN = "LATER_RUN_CHANGED_OBJECT"


def parse_metadata(audit: DataFrame, run_id: str) -> DataFrame:
    """Rows of the run that hold rollback data, with it parsed into ``undo``.

    ``bad`` marks text that is no JSON object; such a row fails, alone.
    """
    rows = rows_for_run(audit, run_id).where(F.length("rollback_metadata") > 0)
    bad = F.json_object_keys("rollback_metadata").isNull() & (F.trim("rollback_metadata") != "null")
    target = F.col("target_policy_name") if "target_policy_name" in audit.columns else F.lit(None).cast("string")
    return rows.select(*ATTEMPT, target.alias("target_policy_name"), F.from_json("rollback_metadata", ROLLBACK_METADATA).alias("undo"), bad.alias("bad"))


def rollback_objects(parsed: DataFrame) -> DataFrame:
    """One row per old rule to restore, with the policies that replaced it."""
    good = parsed.where(~F.col("bad"))
    none = F.array().cast("array<struct<policy_name:string,on_securable:string,policy_type:string>>")
    policies = F.coalesce("undo.abac_policies_created_by_this_run", none)
    fields = [*ATTEMPT, "object_type", "slot", "function_fqn", "using_columns", "created", "recorded_name"]
    # a row of one mask names that mask's policy; with several masks the name is rebuilt from the mask
    single = F.when(F.size("undo.original_column_masks") == 1, F.col("target_policy_name"))
    original = "undo.original_row_filter"
    filters = good.where(
        F.col(f"{original}.function").isNotNull() | F.col(f"{original}.using_columns").isNotNull()
    ).select(
        *ATTEMPT,
        F.lit(ROW_FILTER).alias("object_type"),
        F.lit("").alias("slot"),
        F.col(f"{original}.function").alias("function_fqn"),
        F.col(f"{original}.using_columns").alias("using_columns"),
        F.filter(policies, lambda p: p["policy_type"] == ROW_FILTER).alias("created"),
        F.col("target_policy_name").alias("recorded_name"),
    )
    masks = good.select(
        *ATTEMPT,
        F.explode("undo.original_column_masks").alias("m"),
        F.filter(policies, lambda p: p["policy_type"] == COLUMN_MASK).alias("created"),
        single.alias("recorded_name"),
    ).select(
        *ATTEMPT,
        F.lit(COLUMN_MASK).alias("object_type"),
        F.coalesce("m.column", F.lit("")).alias("slot"),
        F.col("m.function").alias("function_fqn"),
        F.array().cast("array<string>").alias("using_columns"),
        "created",
        "recorded_name",
    )
    return filters.select(*fields).unionByName(masks.select(*fields))


def changes(audit: DataFrame) -> DataFrame:
    """Which run changed which object last: ``run_id``, the object, ``changed_at, stands``.

    A change is a row with rollback data that was no dry run; it stands until a
    rollback of the same run undoes it, at that time or later.  One aggregation
    per run and object.  Rows without a time count as the oldest.
    """
    none = F.array().cast("array<struct<object_type:string,slot:string>>")
    rows = conform(audit, AUDIT).where(~F.coalesce("dry_run", F.lit(False)))
    rows = rows.withColumn("completed_at", F.coalesce("completed_at", F.timestamp_seconds(F.lit(0))))
    undo = rows.where(F.length("rollback_metadata") > 0).withColumn("undo", F.from_json("rollback_metadata", ROLLBACK_METADATA))
    original = "undo.original_row_filter"
    has_filter = F.col(f"{original}.function").isNotNull() | F.col(f"{original}.using_columns").isNotNull()
    of_filter = F.when(has_filter, F.array(F.struct(F.lit(ROW_FILTER).alias("object_type"), F.lit("").alias("slot"))))
    of_masks = F.transform(
        "undo.original_column_masks",
        lambda m: F.struct(F.lit(COLUMN_MASK).alias("object_type"), F.coalesce(m["column"], F.lit("")).alias("slot")),
    )
    at = F.col("completed_at")
    done = undo.select("run_id", *KEY, at.alias("changed_at"), F.inline(F.concat(F.coalesce(of_filter, none), F.coalesce(of_masks, none))))
    undone = rows.where(F.col("status") == "ROLLED_BACK").select(
        "run_id", *KEY, "object_type", F.coalesce("masked_column", F.lit("")).alias("slot"), at.alias("undone_at")
    )
    last = done.unionByName(undone, allowMissingColumns=True).groupBy("run_id", *OBJECT)
    last = last.agg(F.max("changed_at").alias("changed_at"), F.max("undone_at").alias("undone_at"))
    stands = F.col("undone_at").isNull() | (F.col("undone_at") < F.col("changed_at"))
    return last.where(F.col("changed_at").isNotNull()).select("run_id", *OBJECT, "changed_at", stands.alias("stands"))


def superseded(audit: DataFrame, run_id: str, undone: Collection[str] = ()) -> DataFrame:
    """Objects of the run that later runs changed and that undoing it would overwrite: the object,
    ``n_later_runs`` and ``latest_run``.

    Changes of one moment count as later: their order is unknown.  Runs in *undone*
    count as rolled back.  Only tables that the run has rows of are looked at.
    """
    ours = rows_for_run(audit, run_id).select(*KEY).distinct()
    own = F.col("run_id") == run_id
    told = changes(audit.join(ours, KEY, "left_semi")).where(own | F.col("stands") & ~F.col("run_id").isin(list(undone)))
    own_at = F.max(F.when(own, F.col("changed_at"))).over(Window.partitionBy(*OBJECT))
    later = told.withColumn("own_at", own_at).where(~own & (F.col("changed_at") >= F.col("own_at")))
    return later.groupBy(*OBJECT).agg(
        F.count("*").alias("n_later_runs"), F.max_by("run_id", F.struct("changed_at", "run_id")).alias("latest_run")
    )


def undo_order(audit: DataFrame, run_id: str) -> DataFrame:
    """The run and every run that builds on it, in the order to undo them: ``run_id, position`` (from 1).

    A run builds on another where it changed one of its objects later, directly
    or through runs between.  Each object names only neighbours in time, so that no
    two runs of a long history are paired; newest changes go first, the run itself last.
    """
    standing = changes(audit).where("stands")
    in_time = Window.partitionBy(*OBJECT).orderBy("changed_at", "run_id")
    before = F.lag("run_id").over(in_time).alias("run_id")
    follows = standing.select(before, F.col("run_id").alias("later")).where("run_id IS NOT NULL").distinct()
    # changes of one moment may have happened either way round
    ties = Window.partitionBy(*OBJECT, "changed_at").orderBy("run_id")
    same = standing.select(F.lag("run_id").over(ties).alias("later"), "run_id").where("later IS NOT NULL").distinct()
    follows = cut_lineage(follows.select("run_id", "later").unionByName(same).distinct())
    found = fresh = cut_lineage(audit.sparkSession.createDataFrame([(run_id,)], "run_id string"))
    while not fresh.isEmpty():
        reached = follows.join(fresh, "run_id").select(F.col("later").alias("run_id")).distinct()
        fresh = cut_lineage(reached.join(found, "run_id", "left_anti"))
        found = found.unionByName(fresh)
    newest = standing.groupBy("run_id").agg(F.max("changed_at").alias("changed_at"))
    last = (F.col("run_id") == run_id).cast("int")
    order = Window.orderBy(last, F.col("changed_at").desc_nulls_last(), F.col("run_id").desc())
    return found.join(newest, "run_id", "left").select("run_id", F.row_number().over(order).alias("position"))


def rollback_steps(
    objects: DataFrame, functions: DataFrame, dry_run: bool = False, blocked: DataFrame | None = None
) -> DataFrame:
    """Adds ``status, error_code, error_message`` to the objects.

    An object in *blocked* (of :func:`superseded`) fails: a later run's state is
    not overwritten.
    """
    is_filter = F.col("object_type") == ROW_FILTER
    later = F.lit(None).cast("string")
    if blocked is not None:
        objects = objects.join(blocked.select(*OBJECT, F.col("latest_run").alias("__later")), OBJECT, "left")
        later = F.col("__later")
    broken = F.col("function_fqn").isNull() | (~is_filter & (F.col("slot") == ""))
    missing = ~F.col("function_exists")
    return (
        function_status(objects, functions)
        .withColumns(
            {
                "masked_column": F.when(~is_filter, F.col("slot")),
                "status": F.when(broken | missing | later.isNotNull(), "FAILED").otherwise("WOULD_ROLLBACK" if dry_run else "ROLLED_BACK"),
                "error_code": F.when(broken, "ROLLBACK_FAILED")
                .when(missing, "SOURCE_FUNCTION_NOT_FOUND")
                .when(later.isNotNull(), LATER_RUN),
                "error_message": F.when(broken, "Rollback data names no function or column.").when(
                    missing, "Cannot restore: the original function no longer exists."
                ).when(later.isNotNull(), F.concat(F.lit("A later run changed this object; undo it first: "), later)),
            }
        )
        .drop("function_exists", "function_executable", "__later")
    )


def rollback_results(parsed: DataFrame, steps: DataFrame) -> DataFrame:
    """Status per audit row: FAILED, then WOULD_ROLLBACK, then ROLLED_BACK; SKIPPED if nothing applied."""
    s = F.col("status")
    rolled = steps.groupBy(*ATTEMPT).agg(
        F.when(F.bool_or(s == "FAILED"), "FAILED")
        .when(F.bool_or(s == "WOULD_ROLLBACK"), "WOULD_ROLLBACK")
        .otherwise("ROLLED_BACK")
        .alias("status"),
        F.min_by("error_message", F.when(s == "FAILED", F.struct(F.col("object_type") == COLUMN_MASK, "slot"))).alias(
            "error_message"
        ),
        F.count("*").alias("n_steps"),
    )
    return (
        parsed.select(*ATTEMPT, "bad")
        .join(rolled, ATTEMPT, "left")
        .select(
            *ATTEMPT,
            F.when(F.col("bad"), "FAILED").otherwise(F.coalesce("status", F.lit("SKIPPED"))).alias("status"),
            F.when(F.col("bad"), "Rollback data of this row is not readable.")
            .when(F.col("status").isNull(), "Nothing in the rollback data applied to this table.")
            .otherwise(F.col("error_message"))
            .alias("error_message"),
            F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
        )
        .withColumn("migration_phase", rollback_phase_of())
    )


def rollback_audit_rows(
    results: DataFrame, steps: DataFrame, run_id: str, attempt: str, started_at: Column, completed_at: Column, dry_run: bool
) -> DataFrame:
    """One audit row per step, or one NONE row for an audit row without steps."""
    fields = [*ATTEMPT, "object_type", "slot", "masked_column", "source_function", "status", "error_code", "error_message"]
    of_steps = steps.withColumn("source_function", F.col("function_fqn")).select(*fields)
    none = F.lit(None).cast("string")
    bare = results.where(F.col("n_steps") == 0).select(
        *ATTEMPT,
        F.lit("NONE").alias("object_type"),
        F.lit("").alias("slot"),
        none.alias("masked_column"),
        none.alias("source_function"),
        "status",
        none.alias("error_code"),
        "error_message",
    )
    rows = of_steps.unionByName(bare).select(
        F.lit(run_id).alias("run_id"),
        F.sha2(F.concat_ws("|", F.lit(attempt), "attempt_id", *KEY, "object_type", "slot"), 256).alias("attempt_id"),
        *KEY,
        "object_type",
        "masked_column",
        "source_function",
        "status",
        "error_code",
        "error_message",
        F.lit("NOT_RUN").alias("validation_status"),
        rollback_phase_of().alias("migration_phase"),
        started_at.alias("started_at"),
        completed_at.alias("completed_at"),
        F.lit(dry_run).alias("dry_run"),
    )
    return conform(rows, AUDIT)


def _restored(steps: DataFrame, object_type: str, key: list[str]) -> DataFrame:
    """Rules restored, one per object even if several audit rows name it."""
    done = steps.where((F.col("status") == "ROLLED_BACK") & (F.col("object_type") == object_type))
    return done.groupBy(*key).agg(F.min_by(F.struct("function_fqn", "using_columns"), "attempt_id").alias("r")).select(*key, "r.*")


def restored_row_filters(steps: DataFrame) -> DataFrame:
    return _restored(steps, ROW_FILTER, KEY)


def restored_masks(steps: DataFrame) -> DataFrame:
    return _restored(steps, COLUMN_MASK, [*KEY, "slot"]).select(*KEY, F.col("slot").alias("column"), "function_fqn")


def restore_row_filters(row_filters: DataFrame, steps: DataFrame) -> DataFrame:
    back = restored_row_filters(steps)
    kept = row_filters.select(*KEY, "function_fqn", "using_columns").join(back, KEY, "left_anti")
    return kept.unionByName(back)


def restore_masks(masks: DataFrame, steps: DataFrame) -> DataFrame:
    back = restored_masks(steps)
    kept = masks.select(*KEY, "column", "function_fqn").join(back, [*KEY, "column"], "left_anti")
    return kept.unionByName(back)


def droppable_policies(
    steps: DataFrame,
    row_filters: DataFrame,
    masks: DataFrame,
    column_tags: DataFrame,
    scope: str = "TABLE",
    team_prefix: str = "",
) -> DataFrame:
    """Policies to drop after the restore (*row_filters* and *masks* are the restored state).

    Only those that the rollback data lists, for a mask only the one that its
    audit row names (or, without, the one of its deterministic name), and no catalog policy that another table still relies
    on: one with the tag on a column and no old rule in its place.
    """
    listed = (
        steps.where(F.col("status") == "ROLLED_BACK")
        .withColumn("expected", F.coalesce("recorded_name", policy_name(scope, team_prefix, "function_fqn")))
        .select("object_type", "expected", F.explode("created").alias("p"))
        .where((F.col("object_type") == ROW_FILTER) | (F.col("p.policy_name") == F.col("expected")))
        .select("object_type", "p.on_securable", "p.policy_name")
        .distinct()
    )
    users = (
        column_tags.select(*KEY, "column", catalog_securable().alias("on_securable"), F.col("tag_key").alias("policy_name"))
        .join(listed.where(F.startswith("on_securable", F.lit("CATALOG "))), ["on_securable", "policy_name"])
    )
    relying = (
        users.where(F.col("object_type") == ROW_FILTER)
        .join(row_filters.select(*KEY), KEY, "left_anti")
        .select("on_securable", "policy_name")
        .unionByName(
            users.where(F.col("object_type") == COLUMN_MASK)
            .join(masks.select(*KEY, "column"), [*KEY, "column"], "left_anti")
            .select("on_securable", "policy_name")
        )
    )
    return listed.select("on_securable", "policy_name").distinct().join(relying, ["on_securable", "policy_name"], "left_anti")
