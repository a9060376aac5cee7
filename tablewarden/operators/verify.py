"""Does the live state match what a migration left behind?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import COLUMN_MASK, KEY, ROW_FILTER, row_filter_policy_name, securable
from tablewarden.operators.audit import latest_per_table
from tablewarden.operators.matching import resolve_match_columns
from tablewarden.operators.policies import table_policies_by_object
from tablewarden.sources.store import cut_lineage

_OBJECT = [*KEY, "object_type", "slot"]
POLICY = ["on_securable", "policy_name"]
_FIELDS = [*KEY, "object_type", "masked_column", "status", "source_function", "target_policy_name", "error_code"]


def verify_row_filters(
    row_filters: DataFrame, existing: DataFrame, policies: DataFrame, scope: str = "TABLE", team_prefix: str = ""
) -> DataFrame:
    """Row filter per table: old rule gone and policy there is SUCCESS, both
    there ABAC_APPLIED, only the old rule FAILED; neither gives no row."""
    described = policies.where(F.col("function_fqn").isNotNull())
    old = row_filters.select(
        *KEY,
        securable(scope).alias("on_securable"),
        row_filter_policy_name("function_fqn", scope, team_prefix).alias("wanted_name"),
        F.lit(True).alias("legacy"),
    )
    if scope == "TABLE":
        ours = table_policies_by_object(described, team_prefix).where(F.col("object_type") == ROW_FILTER)
        old = old.join(ours.select(*KEY, F.col("function_fqn").alias("policy_function")), KEY, "left")
    else:
        named = described.select(
            "on_securable", F.col("policy_name").alias("wanted_name"), F.col("function_fqn").alias("policy_function")
        )
        old = old.join(named, ["on_securable", "wanted_name"], "left")
    found = existing.where(F.col("object_type") == ROW_FILTER).select(
        *KEY, F.col("policy_name").alias("found_name"), F.col("function_fqn").alias("found_function")
    )
    legacy = F.col("legacy").isNotNull()
    missing = legacy & F.col("policy_function").isNull()
    return (
        old.drop("on_securable")
        .join(found, KEY, "full_outer")
        .select(
            *KEY,
            F.lit(ROW_FILTER).alias("object_type"),
            F.lit(None).cast("string").alias("masked_column"),
            F.when(missing, "FAILED").when(legacy, "ABAC_APPLIED").otherwise("SUCCESS").alias("status"),
            F.when(legacy, F.col("policy_function")).otherwise(F.col("found_function")).alias("source_function"),
            F.when(legacy, F.col("wanted_name")).otherwise(F.col("found_name")).alias("target_policy_name"),
            F.when(missing, "POLICY_VERIFY_FAILED").alias("error_code"),
        )
        .select(*_FIELDS)
    )


def verify_masks(masks: DataFrame, existing: DataFrame) -> DataFrame:
    """Per policy found: ABAC_APPLIED while the old mask is there, else SUCCESS.
    A mask that was never migrated gives no row."""
    old = masks.select(*KEY, F.col("column").alias("masked_column"), F.lit(True).alias("legacy")).distinct()
    return (
        existing.where(F.col("object_type") == COLUMN_MASK)
        .join(old, [*KEY, "masked_column"], "left")
        .select(
            *KEY,
            "object_type",
            "masked_column",
            F.when(F.col("legacy").isNotNull(), "ABAC_APPLIED").otherwise("SUCCESS").alias("status"),
            F.col("function_fqn").alias("source_function"),
            F.col("policy_name").alias("target_policy_name"),
            F.lit(None).cast("string").alias("error_code"),
        )
        .select(*_FIELDS)
    )


def covered_objects(policies: DataFrame, column_tags: DataFrame) -> DataFrame:
    """Objects that some policy acts on now: table key, object_type, slot, and the policy.

    A filter is covered where its policy is in force on the table, a mask where
    it is and selects the masked column.  Being there by name is not enough.
    """
    kind = ["policy_type", "function_fqn", "n_aliases"]
    slot = F.when(F.col("policy_type") == COLUMN_MASK, F.col("column")).otherwise("")
    # matches are read once: the aliases and the columns that a policy selects in one table, as many as that table has
    found = resolve_match_columns(policies, column_tags).groupBy(*KEY, *POLICY).agg(
        F.collect_set(F.struct(*kind, "alias")).alias("aliases"),
        F.collect_set(F.struct(F.col("policy_type").alias("object_type"), slot.alias("slot"))).alias("objects"),
    )

    def complete(one: Column) -> Column:
        """Is every alias of this policy matched by some column?"""
        same = F.filter("aliases", lambda a: reduce(Column.__and__, [a[k].eqNullSafe(one[k]) for k in kind]))
        return F.size(same) == one["n_aliases"]

    return found.where(F.exists("aliases", complete)).select(*KEY, *POLICY, F.inline("objects")).select(*_OBJECT, *POLICY)


def keep_uncovered(steps: DataFrame, policies: DataFrame, column_tags: DataFrame) -> DataFrame:
    """*steps* with every object FAILED, and its old rule kept, that its policy does not act on.

    *policies* and *column_tags* are the state after the steps.  This holds in
    every phase: for a policy just made, and for one made earlier whose old rule
    is about to go, or would in a dry run.  The policies asked about, the tags and
    the keys of the open objects are written to the shared folder, so that none is
    worked out twice and the steps themselves stay where they are while few are open.
    """
    relies = F.col("policy_created") | F.col("legacy_removed") | (F.col("status") == "WOULD_FINALIZE")
    key = [*_OBJECT, *POLICY]
    relying = steps.where(relies & F.col("status").isin("SUCCESS", "ABAC_APPLIED", "WOULD_FINALIZE")).select(*key)
    # only policies that the steps speak of, on their own securable, are resolved
    listed = [c for c in ("conditions", "problem") if c in policies.columns]
    named = policies.select(*POLICY, "policy_type", "function_fqn", "match_columns", *listed).join(relying.select(*POLICY).distinct(), POLICY, "left_semi")
    tags = column_tags.select(*KEY, "column", "tag_key", "tag_value")
    covered = covered_objects(cut_lineage(named), cut_lineage(tags)).drop("object_type")
    open_ = cut_lineage(relying.join(covered, [*KEY, *POLICY, "slot"], "left_anti").distinct())
    open_ = open_.select(*[F.col(c).alias(f"__{c}") for c in key], F.lit(True).alias("__open"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    is_open = F.coalesce(F.col("__open") & relies & F.col("status").isin("SUCCESS", "ABAC_APPLIED", "WOULD_FINALIZE"), F.lit(False))
    return (
        steps.join(open_, same, "left")
        .withColumn("__open", is_open)
        .withColumns(
            {
                "status": F.when(F.col("__open"), "FAILED").otherwise(F.col("status")),
                "error_code": F.when(F.col("__open"), "POLICY_VERIFY_FAILED").otherwise(F.col("error_code")),
                "error_message": F.when(F.col("__open"), "The new policy does not act on this object; its old rule stays.").otherwise(
                    F.col("error_message")
                ),
                "legacy_removed": F.col("legacy_removed") & ~F.col("__open"),
            }
        )
        .select(*steps.columns)
    )


def record_coverage(recorded: DataFrame | None, steps: DataFrame, run_id: str, since: Column) -> DataFrame:
    """The coverage frame (``schemas.COVERAGE``) after *steps*: one row per object whose new policy was found acting."""
    new = new_coverage(steps, run_id, since)
    return new if recorded is None else recorded.join(new.select(*_OBJECT), _OBJECT, "left_anti").unionByName(new)


def new_coverage(steps: DataFrame, run_id: str, since: Column) -> DataFrame:
    """Coverage rows of the objects whose new policy *steps* found acting."""
    done = steps.where((F.col("policy_created") | F.col("legacy_removed")) & F.col("status").isin("SUCCESS", "ABAC_APPLIED"))
    return done.select(*KEY, "object_type", "slot", "on_securable", "policy_name", F.lit(run_id).alias("run_id"), since.cast("timestamp").alias("since"))


def acting_only(verified: DataFrame, covered: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """*verified* objects with FAILED for every one whose policy, there by name, does not act on it.

    Objects of the *recorded* coverage frame that nothing acts on now and that
    *verified* does not know, because their policy or its tag is gone, are added.
    """
    slot = F.coalesce("masked_column", F.lit("")).alias("slot")
    acts = covered.select(*_OBJECT, F.col("policy_name").alias("target_policy_name")).distinct().withColumn("__acts", F.lit(True))
    seen = verified.withColumn("slot", slot).join(acts, [*_OBJECT, "target_policy_name"], "left")
    failed = F.col("__acts").isNull()
    out = seen.withColumns(
        {"status": F.when(failed, "FAILED").otherwise(F.col("status")), "error_code": F.when(failed, "POLICY_VERIFY_FAILED").otherwise(F.col("error_code"))}
    ).select(*_FIELDS)
    if recorded is None:
        return out
    known = verified.select(*KEY, "object_type", slot)
    gone = recorded.join(known, _OBJECT, "left_anti").join(covered.select(*_OBJECT), _OBJECT, "left_anti")
    none = F.lit(None).cast("string")
    lost = gone.select(
        *KEY, "object_type", F.nullif("slot", F.lit("")).alias("masked_column"), F.lit("FAILED").alias("status"), none.alias("source_function"),
        F.col("policy_name").alias("target_policy_name"), F.lit("POLICY_VERIFY_FAILED").alias("error_code"),
    )
    return out.unionByName(lost.select(*_FIELDS))


def verify_tables(tables: DataFrame, steps: DataFrame) -> DataFrame:
    """Status per table, NOT_ELIGIBLE where nothing was found to verify."""
    s = F.col("status")
    rolled = steps.groupBy(*KEY).agg(
        F.when(F.bool_or(s == "FAILED"), "FAILED")
        .when(F.bool_or(s == "ABAC_APPLIED"), "ABAC_APPLIED")
        .otherwise("SUCCESS")
        .alias("status"),
        F.max(F.when(s == "FAILED", F.col("error_code"))).alias("error_code"),
    )
    return (
        tables.select(*KEY)
        .join(rolled, KEY, "left")
        .select(*KEY, F.coalesce("status", F.lit("NOT_ELIGIBLE")).alias("status"), "error_code")
    )


def detect_drift(tables: DataFrame, audit: DataFrame, verified: DataFrame) -> DataFrame:
    """Tables whose last recorded state was final but whose live state is not."""
    last = latest_per_table(audit.select(*KEY, "completed_at", "attempt_id", "status")).select(
        *KEY, F.col("status").alias("last_status")
    )
    live = verified.select(*KEY, F.col("status").alias("live_status"), F.col("error_code").alias("live_error"))
    final = F.col("last_status").isin("SUCCESS", "ALREADY_MIGRATED")
    matches = F.coalesce(F.col("live_status") == "SUCCESS", F.lit(False))
    return (
        tables.select(*KEY)
        .join(last, KEY, "left")
        .join(live, KEY, "left")
        .select(
            *KEY,
            F.coalesce(final & ~matches, F.lit(False)).alias("drift_detected"),
            F.when(F.col("last_status").isNull(), "NEVER_MIGRATED_BY_THIS_UTILITY")
            .when(~final, "LAST_RUN_WAS_NOT_SUCCESSFUL")
            .when(matches, "LIVE_STATE_MATCHES_AUDIT")
            .otherwise(F.coalesce("live_error", F.lit("LIVE_STATE_DOES_NOT_MATCH_AUDIT")))
            .alias("reason"),
        )
    )
