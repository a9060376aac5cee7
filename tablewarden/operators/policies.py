"""Policies as rows: find existing ones, plan new ones, move the state on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import (
    COLUMN_MASK,
    KEY,
    ROW_FILTER,
    catalog_securable,
    key_prefix,
    mask_policy_prefix,
    row_filter_policy_name,
)

FIELDS = [*KEY, "object_type", "masked_column", "policy_name", "function_fqn"]


def existing_policies(policies: DataFrame, scope: str, column_tags: DataFrame, team_prefix: str = "") -> DataFrame:
    """Policies that earlier runs left for each table, found without its old rules.

    TABLE scope knows them by name; a mask policy's column is the rest of its
    name.  CATALOG scope knows them by the tags of the table's columns, and
    takes the lowest key for the row filter.
    """
    if scope == "TABLE":
        return _existing_on_table(policies, team_prefix)
    return _existing_on_catalog(policies, column_tags, team_prefix)


def table_policies_by_object(policies: DataFrame, team_prefix: str = "") -> DataFrame:
    """TABLE-scoped policies of our names with the object that each name stands for.

    The table is read off the securable, the object off the name, so this is a
    projection: no join with tables.
    """
    prefix = mask_policy_prefix(team_prefix)
    is_filter = F.col("policy_name") == row_filter_policy_name(F.lit(""), "TABLE", team_prefix)
    is_mask = F.startswith("policy_name", F.lit(prefix))
    key = F.regexp_extract_all("on_securable", F.lit("`([^`]+)`"), 1)
    return policies.where(F.startswith("on_securable", F.lit("TABLE ")) & (is_filter | is_mask)).select(
        *[F.get(key, F.lit(i)).alias(k) for i, k in enumerate(KEY)],
        F.when(is_filter, ROW_FILTER).otherwise(COLUMN_MASK).alias("object_type"),
        F.when(is_filter, "").otherwise(F.substr("policy_name", F.lit(len(prefix) + 1))).alias("slot"),
        "policy_type",
        "policy_name",
        "function_fqn",
    )


def _existing_on_table(policies: DataFrame, team_prefix: str) -> DataFrame:
    ours = table_policies_by_object(policies.where(F.col("function_fqn").isNotNull()), team_prefix)
    is_filter = F.col("object_type") == ROW_FILTER
    return ours.where(is_filter | (F.col("policy_type") == COLUMN_MASK)).select(
        *KEY, "object_type", F.when(~is_filter, F.col("slot")).alias("masked_column"), "policy_name", "function_fqn"
    )


def _existing_on_catalog(policies: DataFrame, column_tags: DataFrame, team_prefix: str) -> DataFrame:
    named = policies.where(F.col("function_fqn").isNotNull()).select("on_securable", "policy_name", "function_fqn")

    def tagged(role: str) -> DataFrame:
        own = column_tags.where(F.startswith("tag_key", key_prefix(role, team_prefix)))
        return (
            own.select(*KEY, "column", F.col("tag_key").alias("policy_name"), catalog_securable().alias("on_securable"))
            .join(named, ["on_securable", "policy_name"])
            .select(*KEY, "column", "policy_name", "function_fqn")
        )

    filters = (
        tagged("row_filter")
        .groupBy(*KEY)
        .agg(F.min(F.struct("policy_name", "function_fqn")).alias("p"))
        .select(*KEY, F.lit(ROW_FILTER).alias("object_type"), F.lit(None).cast("string").alias("masked_column"), "p.*")
    )
    masks = tagged("mask").select(
        *KEY, F.lit(COLUMN_MASK).alias("object_type"), F.col("column").alias("masked_column"), "policy_name", "function_fqn"
    )
    return filters.select(*FIELDS).unionByName(masks.select(*FIELDS))


def with_match_columns(planned: DataFrame, resolved: DataFrame) -> DataFrame:
    """Adds ``match_columns`` (in argument order) and ``tag_missing`` to planned objects.

    ``resolved`` is what the tag step could resolve.  A mask meets the tag of
    its own column; a filter is taken apart into its arguments and put together
    again, so no row ever carries the tags of a whole table.
    """
    match = F.struct("tag_key", "tag_value", "alias", F.col("column").alias("source_column"))
    tags = resolved.select(*KEY, "column", "role", match.alias("m"))
    is_filter = F.col("object_type") == ROW_FILTER

    of_masks = tags.where(F.col("role") == "mask").select(*KEY, F.col("column").alias("slot"), "m")
    masks = planned.where(~is_filter).join(of_masks, [*KEY, "slot"], "left")
    masks = masks.select(*planned.columns, F.array("m").alias("match_columns"))

    filters = planned.where(is_filter)
    arguments = filters.select("*", F.posexplode_outer("using_columns").alias("n", "column"))
    of_filters = tags.where(F.col("role") == "row_filter").drop("role")
    filters = (
        arguments.join(of_filters, [*KEY, "column"], "left")
        .groupBy(*planned.columns)
        .agg(F.sort_array(F.collect_list(F.struct("n", "m"))).alias("args"))
        .select(
            *planned.columns,
            F.transform(F.filter("args", lambda a: a["n"].isNotNull()), lambda a: a["m"]).alias("match_columns"),
        )
    )
    return masks.unionByName(filters).withColumn("tag_missing", F.exists("match_columns", lambda m: m.isNull()))


def plan_policies(objects: DataFrame, scope: str, to: list[str], except_: list[str]) -> DataFrame:
    """Adds the policy row each object wants.

    A row filter is called with all its aliases; a mask's target is its only
    alias and it takes no extra arguments.
    """
    is_filter = F.col("object_type") == ROW_FILTER
    comment = (
        F.when(is_filter & F.lit(scope == "TABLE"), F.lit("Migrated from a table-level row filter."))
        .when(is_filter, F.concat(F.lit("Migrated (CATALOG-scoped) from row filter "), "source_function", F.lit(".")))
        .when(F.lit(scope == "TABLE"), F.concat(F.lit("Migrated from a column mask on "), "masked_column", F.lit(".")))
        .otherwise(F.concat(F.lit("Migrated (CATALOG-scoped) from column mask "), "source_function", F.lit(".")))
    )
    none = F.array().cast("array<string>")

    def names(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return objects.withColumns(
        {
            "policy_type": F.col("object_type"),
            "using_aliases": F.when(is_filter, F.transform("match_columns", lambda m: m["alias"])).otherwise(none),
            "target_alias": F.when(~is_filter, F.get("match_columns", F.lit(0))["alias"]),
            "to_principals": names(to),
            "except_principals": names(except_),
            "comment": comment,
        }
    )


def definition_text() -> Column:
    """``CREATE OR REPLACE POLICY`` text of a planned policy, for the audit row."""

    def listed(c: str) -> Column:
        return F.array_join(F.transform(c, lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")

    clauses = F.transform(
        "match_columns",
        lambda m: F.concat(
            F.when(m["tag_value"].isNull(), F.concat(F.lit("has_tag('"), m["tag_key"], F.lit("')"))).otherwise(
                F.concat(F.lit("has_tag_value('"), m["tag_key"], F.lit("', '"), m["tag_value"], F.lit("')"))
            ),
            F.lit(" AS "),
            m["alias"],
        ),
    )
    kind = F.when(F.col("policy_type") == ROW_FILTER, "ROW FILTER ").otherwise("COLUMN MASK ")
    exempt = F.when(F.size("except_principals") > 0, F.concat(F.lit(" EXCEPT "), listed("except_principals")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("CREATE OR REPLACE POLICY "), "policy_name"),
        F.concat(F.lit("ON "), "on_securable"),
        F.when(F.length("comment") > 0, F.concat(F.lit("COMMENT '"), "comment", F.lit("'"))),
        F.concat(kind, "source_function"),
        F.concat(F.lit("TO "), listed("to_principals"), F.coalesce(exempt, F.lit(""))),
        F.lit("FOR TABLES"),
        F.concat(F.lit("MATCH COLUMNS "), F.array_join(clauses, ", ")),
        F.concat(F.lit("ON COLUMN "), "target_alias"),
        F.when(
            F.size("using_aliases") > 0,
            F.concat(F.lit("USING COLUMNS ("), F.array_join("using_aliases", ", "), F.lit(")")),
        ),
    )


_BODY = ["policy_type", "function_fqn", "match_columns", "using_columns", "target_alias",
         "to_principals", "except_principals", "comment"]


def new_policies(created: DataFrame) -> DataFrame:
    """Policies that *created* (one row per migrated object) asks for, one row each.

    Tables that share a catalog policy ask for it many times: the one of the
    lowest table and column stays, found by a map-side reduction, so that a
    function used everywhere is no hot spot.
    """
    wanted = created.select(
        "on_securable",
        "policy_name",
        F.struct(*KEY, "slot").alias("__from"),
        F.struct(
            "policy_type",
            F.col("source_function").alias("function_fqn"),
            "match_columns",
            F.col("using_aliases").alias("using_columns"),
            "target_alias",
            "to_principals",
            "except_principals",
            "comment",
        ).alias("__body"),
    )
    return (
        wanted.groupBy("on_securable", "policy_name")
        .agg(F.min_by("__body", "__from").alias("__body"))
        .select("on_securable", "policy_name", "__body.*")
    )


def upsert_policies(policies: DataFrame, created: DataFrame) -> DataFrame:
    """Policies after create-or-replace of those that *created* asks for."""
    new = new_policies(created)
    listed = [c for c in ("conditions", "problem") if c in policies.columns]
    kept = policies.select("on_securable", "policy_name", *_BODY, *listed).join(new, ["on_securable", "policy_name"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def drop_policies(policies: DataFrame, dropped: DataFrame) -> DataFrame:
    return policies.join(dropped, ["on_securable", "policy_name"], "left_anti")


def removed_row_filters(steps: DataFrame) -> DataFrame:
    """Keys of the tables whose old filter the steps removed."""
    return steps.where(F.col("legacy_removed") & (F.col("object_type") == ROW_FILTER)).select(*KEY)


def removed_masks(steps: DataFrame) -> DataFrame:
    """Keys of the columns whose old mask the steps removed."""
    done = steps.where(F.col("legacy_removed") & (F.col("object_type") == COLUMN_MASK))
    return done.select(*KEY, F.col("masked_column").alias("column"))


def remove_row_filters(row_filters: DataFrame, steps: DataFrame) -> DataFrame:
    return row_filters.join(removed_row_filters(steps), KEY, "left_anti")


def remove_masks(masks: DataFrame, steps: DataFrame) -> DataFrame:
    return masks.join(removed_masks(steps), [*KEY, "column"], "left_anti")
