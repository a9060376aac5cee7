"""Tags that let a policy find its columns: reuse, minting, collisions, grants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import (
    KEY,
    ROLE_STEM,
    ROW_FILTER,
    match_alias,
    principal_text,
    tag_key,
)
from tablewarden.sources.store import cut_lineage

# Grant role names.
GRANT_ROLES = {"ASSIGN": "roles/tagPolicy.assigner", "MANAGE": "roles/tagPolicy.manager"}

DESCRIPTION = "Governs columns formerly protected by function "


def description_of(function_fqn: Column | str) -> Column:
    """What a minted tag says about itself; tells our tags from others of the same key."""
    return F.concat(F.lit(DESCRIPTION), F.col(function_fqn) if isinstance(function_fqn, str) else function_fqn)


def tag_requests(planned: DataFrame, team_prefix: str = "") -> DataFrame:
    """One request per filter argument and per masked column of objects to be migrated."""
    is_filter = F.col("object_type") == ROW_FILTER
    columns = F.when(is_filter, F.col("using_columns")).otherwise(F.array("masked_column"))
    key = F.when(is_filter, tag_key("source_function", "row_filter", team_prefix)).otherwise(
        tag_key("source_function", "mask", team_prefix)
    )
    return planned.where(F.col("decision") == "PROCEED").select(
        *KEY,
        F.explode(columns).alias("column"),
        F.when(is_filter, "row_filter").otherwise("mask").alias("role"),
        F.col("source_function").alias("function_fqn"),
        key.alias("tag_key"),
    )


def reusable_tags(column_tags: DataFrame, governed_tags: DataFrame, same_role_only: bool = False) -> DataFrame:
    """Per column the tag that a request on it may reuse: governed, with an
    allowed value if the tag lists values, and on no other column of the table.

    A tag is on one column only if its lowest and highest column agree, which
    is an aggregate, not a comparison of columns with each other.  Of several
    tags the first by key and value is taken.  *same_role_only* keeps a filter
    from reusing a tag minted for a mask, and the other way round.
    """
    governed = governed_tags.select("tag_key", "allowed_values")
    single = (
        column_tags.groupBy(*KEY, "tag_key", "tag_value")
        .agg(F.min("column").alias("column"), F.max("column").alias("__last"))
        .where(F.col("column") == F.col("__last"))
        .join(governed, "tag_key")
        .where(
            (F.size(F.coalesce("allowed_values", F.array())) == 0)
            | F.coalesce(F.array_contains("allowed_values", F.col("tag_value")), F.lit(False))
        )
    )
    tag = F.struct("tag_key", "tag_value")

    def first_tag(not_of: str) -> Column:
        foreign = F.startswith("tag_key", F.lit(ROLE_STEM[not_of])) if same_role_only else F.lit(False)
        return F.min(F.when(~foreign, tag))

    return single.groupBy(*KEY, "column").agg(
        first_tag(not_of="mask").alias("for_row_filter"), first_tag(not_of="row_filter").alias("for_mask")
    )


def reuse(requests: DataFrame, reusable: DataFrame) -> DataFrame:
    """Requests with ``reused`` (a struct of key and value, NULL where nothing fits)."""
    fits = F.when(F.col("role") == "row_filter", F.col("for_row_filter")).otherwise(F.col("for_mask"))
    return requests.join(reusable, [*KEY, "column"], "left").select(*requests.columns, fits.alias("reused"))


def key_errors(to_mint: DataFrame, governed_tags: DataFrame) -> DataFrame:
    """Keys that cannot be minted: two functions give one key, or the key
    exists and was not made for this function."""
    owners = to_mint.groupBy("tag_key").agg(
        F.min("function_fqn").alias("function_fqn"), F.max("function_fqn").alias("other_function")
    )
    taken = governed_tags.select("tag_key", "description")
    two_functions = F.col("function_fqn") != F.col("other_function")
    foreign = F.col("description").isNotNull() & (F.col("description") != description_of("function_fqn"))
    return (
        owners.join(taken, "tag_key", "left")
        .withColumn(
            "error_code",
            F.when(two_functions, "TAG_KEY_SHARED_BY_FUNCTIONS").when(foreign, "TAG_KEY_TAKEN"),
        )
        .where(F.col("error_code").isNotNull())
        .select("tag_key", "function_fqn", "other_function", "error_code")
    )


def crowded_keys(to_mint: DataFrame, column_tags: DataFrame) -> DataFrame:
    """Tables where a key is wanted by, or already on, more than one column."""
    uses = to_mint.select(*KEY, "tag_key", "column").unionByName(column_tags.select(*KEY, "tag_key", "column"))
    return (
        uses.groupBy(*KEY, "tag_key")
        .agg(F.min("column").alias("first_column"), F.max("column").alias("last_column"))
        .where(F.col("first_column") != F.col("last_column"))
    )


def split_by_collision(to_mint: DataFrame, column_tags: DataFrame) -> DataFrame:
    """Adds ``skipped``: a row-filter key that would select several columns of
    its table.  A mask may share its key between columns."""
    crowded = crowded_keys(to_mint, column_tags).select(*KEY, "tag_key", F.lit(True).alias("__crowded"))
    return to_mint.join(crowded, [*KEY, "tag_key"], "left").select(
        *to_mint.columns,
        (F.coalesce("__crowded", F.lit(False)) & (F.col("role") == "row_filter")).alias("skipped"),
    )


def resolve_tags(
    requests: DataFrame,
    column_tags: DataFrame,
    governed_tags: DataFrame,
    prefer_existing: bool = True,
    same_role_only: bool = False,
) -> DataFrame:
    """Every request with what became of it.

    ``resolution`` is REUSED, MINTED, SKIPPED or KEY_ERROR; the first two carry
    ``tag_key, tag_value, alias`` of the match column, the others only the key
    that was wanted.  Runs one job: the matched requests go to the shared
    folder, because four later steps read them.
    """
    if prefer_existing:
        asked = reuse(requests, reusable_tags(column_tags, governed_tags, same_role_only))
    else:
        asked = requests.withColumn("reused", F.lit(None).cast("struct<tag_key:string,tag_value:string>"))
    asked = cut_lineage(asked)
    to_mint = asked.where(F.col("reused").isNull()).drop("reused")
    errors = key_errors(to_mint, governed_tags).select("tag_key", "error_code")
    fields = [*KEY, "column", "role", "function_fqn"]
    minted = (
        split_by_collision(to_mint, column_tags)
        .join(errors, "tag_key", "left")
        .select(
            *fields,
            "tag_key",
            F.lit(None).cast("string").alias("tag_value"),
            F.when(F.col("error_code").isNotNull(), "KEY_ERROR")
            .when(F.col("skipped"), "SKIPPED")
            .otherwise("MINTED")
            .alias("resolution"),
            "error_code",
        )
    )
    if not prefer_existing:
        resolved = minted
    else:
        resolved = (
            asked.where(F.col("reused").isNotNull())
            .select(
                *fields,
                "reused.tag_key",
                "reused.tag_value",
                F.lit("REUSED").alias("resolution"),
                F.lit(None).cast("string").alias("error_code"),
            )
            .unionByName(minted)
        )
    return resolved.withColumn("alias", match_alias("column"))


def usable(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("resolution").isin("REUSED", "MINTED"))


def minted_tags(resolved: DataFrame, governed_tags: DataFrame) -> DataFrame:
    """New governed tags to create: key-only, one per distinct key not yet there."""
    return (
        resolved.where(F.col("resolution") == "MINTED")
        .groupBy("tag_key")
        .agg(F.min("function_fqn").alias("function_fqn"))
        .join(governed_tags, "tag_key", "left_anti")
        .select("tag_key", F.array().cast("array<string>").alias("allowed_values"), description_of("function_fqn").alias("description"))
    )


def create_tags(governed_tags: DataFrame, new_tags: DataFrame) -> DataFrame:
    return governed_tags.unionByName(new_tags.join(governed_tags, "tag_key", "left_anti"))


def assigned_tags(resolved: DataFrame) -> DataFrame:
    """Minted tags of columns, as rows of the column tags."""
    return resolved.where(F.col("resolution") == "MINTED").select(*KEY, "column", "tag_key", "tag_value").distinct()


def assign_tags(column_tags: DataFrame, resolved: DataFrame) -> DataFrame:
    """Column tags after the minted ones are set; a key already on the column is replaced."""
    new = assigned_tags(resolved)
    old = column_tags.select(*new.columns).join(new, [*KEY, "column", "tag_key"], "left_anti")
    return old.unionByName(new)


@dataclass(frozen=True)
class GrantOptions:
    principals: tuple[str, ...]
    role: str = "ASSIGN"

    @property
    def names(self) -> list[str]:
        return [principal_text(p) for p in self.principals]

    @property
    def role_name(self) -> str:
        return GRANT_ROLES[self.role.upper()]


def grants(resolved: DataFrame, options: GrantOptions) -> DataFrame:
    """One grant per distinct key that was resolved, new or reused."""
    return usable(resolved).select(
        "tag_key",
    ).distinct().select(
        "tag_key",
        F.array(*[F.lit(p) for p in options.names]).cast("array<string>").alias("principals"),
        F.lit(options.role_name).alias("role"),
    )


def grant_outcomes(
    wanted: DataFrame, rules: DataFrame, dry_run: bool = False, errors: DataFrame | None = None
) -> DataFrame:
    """Status per grant: ALREADY_GRANTED only if one existing rule of the role
    holds all principals; an error (``tag_key, error_code, error_message``)
    fails that grant alone."""
    fields = ["tag_key", "principals", "role"]
    none = F.lit(None).cast("string")
    if dry_run:
        return wanted.select(*fields, F.lit("WOULD_GRANT").alias("status"), none.alias("error_code"), none.alias("error_message"))
    held = rules.select("tag_key", "role", F.col("principals").alias("held"))
    checked = (
        wanted.join(held, ["tag_key", "role"], "left")
        .groupBy(*fields)
        .agg(F.coalesce(F.bool_or(F.size(F.array_except("principals", "held")) == 0), F.lit(False)).alias("covered"))
    )
    if errors is None:
        checked = checked.withColumns({"error_code": none, "error_message": none})
    else:
        checked = checked.join(errors.select("tag_key", "error_code", "error_message"), "tag_key", "left")
    return checked.select(
        *fields,
        F.when(F.col("error_code").isNotNull(), "FAILED")
        .when(F.col("covered"), "ALREADY_GRANTED")
        .otherwise("GRANTED")
        .alias("status"),
        "error_code",
        "error_message",
    )


def apply_grants(rules: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rules after the grants: a new rule is appended, none is replaced."""
    return rules.select("tag_key", "role", "principals").unionByName(new_rules(outcomes))


def new_rules(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") == "GRANTED").select("tag_key", "role", "principals")


def grow_allowed_values(governed_tags: DataFrame, additions: DataFrame) -> DataFrame:
    """Value lists replaced by old values followed by new ones (``tag_key, new_values``)."""
    return governed_tags.join(additions, "tag_key", "left").select(
        "tag_key",
        F.array_union(
            F.coalesce("allowed_values", F.array().cast("array<string>")),
            F.coalesce("new_values", F.array().cast("array<string>")),
        ).alias("allowed_values"),
        "description",
    )
