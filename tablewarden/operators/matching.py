"""Which policies are in force where: tag-matched columns of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.conditions import TAG, holds
from tablewarden.functions.names import KEY, ROW_FILTER, catalog_securable, schema_securable, table_securable

_POLICY = ["on_securable", "policy_name"]


def resolve_match_columns(policies: DataFrame, column_tags: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """One row per policy, table, alias and column that the policy's tags select.

    Policies act on a table, a schema or a catalog.  Tags are the large side.
    They meet policies by equality on securable and tag key, so that a catalog
    policy is never paired with every table of its catalog; a tag without a value
    in the policy matches any value.  A clause without a key goes by its
    condition (``schemas.LISTED``): a column that has one of the condition's keys
    is looked at with all of its tags.  What holds of a column without tags needs
    *columns* (table key and column), all of them; without that frame reading the
    result fails.  A policy with a ``problem`` selects nothing.
    """
    listed = "conditions" in policies.columns
    if "problem" in policies.columns:
        policies = policies.where(F.col("problem").isNull())
    wanted = policies.select(
        *_POLICY,
        "policy_type",
        "function_fqn",
        F.size("match_columns").alias("n_aliases"),
        F.explode("match_columns").alias("m"),
    ).select(
        *_POLICY, "policy_type", "function_fqn", "n_aliases",
        F.col("m.alias").alias("alias"), F.col("m.tag_key").alias("tag_key"), F.col("m.tag_value").alias("wanted_value"),
    )
    tags = column_tags.select(*KEY, "column", "tag_key", "tag_value")
    out = [*KEY, *_POLICY, "policy_type", "function_fqn", "n_aliases", "alias", "column", "tag_key"]
    # securables name their kind, so a policy meets the tags of one kind only
    kinds = {"TABLE ": table_securable(), "SCHEMA ": schema_securable(), "CATALOG ": catalog_securable()}

    def meet(side: DataFrame, kind: str) -> DataFrame:
        return tags.withColumn("on_securable", kinds[kind]).join(side.where(F.startswith("on_securable", F.lit(kind))), ["on_securable", "tag_key"])

    any_value = F.col("wanted_value").isNull() | (F.col("wanted_value") == F.col("tag_value"))
    plain = reduce(DataFrame.unionByName, [meet(wanted, kind).where(any_value) for kind in kinds]).select(*out)
    return plain.unionByName(_by_condition(policies, tags, columns, kinds).select(*out)) if listed else plain


def _by_condition(policies: DataFrame, tags: DataFrame, columns: DataFrame | None, kinds: dict) -> DataFrame:
    """Columns selected by conditions; ``tag_key`` is the first of a condition's keys that the column has."""
    body = [*_POLICY, "policy_type", "function_fqn", "n_aliases", "alias", "condition"]
    clauses = policies.select(*_POLICY, "policy_type", "function_fqn", F.size("match_columns").alias("n_aliases"), F.inline("conditions"))
    no_tags = F.array().cast("array<struct<tag_key:string,tag_value:string>>")
    clauses = clauses.withColumn("of_untagged", holds(F.col("condition"), no_tags))
    keys = F.array_distinct(F.transform(F.filter("condition", lambda i: i["op"] == TAG), lambda i: i["tag_key"]))
    by_key = clauses.select(*body, F.explode(keys).alias("tag_key"))
    tag = F.struct("tag_key", "tag_value")
    found = reduce(
        DataFrame.unionByName,
        [
            tags.withColumn("on_securable", on).join(by_key.where(F.startswith("on_securable", F.lit(kind))), ["on_securable", "tag_key"])
            for kind, on in kinds.items()
        ],
    ).select(*KEY, "column", *body, tag.alias("tag"))
    if columns is None:
        said = F.concat(F.lit("columns without tags match "), "policy_name", F.lit(" on "), "on_securable", F.lit(": name all columns"))
        every = clauses.where(F.when(F.col("of_untagged"), F.raise_error(said).cast("boolean")))
        every = every.select(*[F.lit("").alias(k) for k in (*KEY, "column")], *body, F.lit(None).cast(found.schema["tag"].dataType).alias("tag"))
    else:
        # NOT over a tag selects most columns of its securable: a row for each is the answer's own size
        all_ = columns.select(*KEY, "column")
        every = reduce(
            DataFrame.unionByName,
            [
                all_.withColumn("on_securable", on).join(clauses.where("of_untagged").where(F.startswith("on_securable", F.lit(kind))), "on_securable")
                for kind, on in kinds.items()
            ],
        ).select(*KEY, "column", *body, F.lit(None).cast(found.schema["tag"].dataType).alias("tag"))
    per_column = found.unionByName(every).groupBy(*KEY, "column", *body).agg(F.collect_set("tag").alias("tags"))
    selected = per_column.where(holds(F.col("condition"), F.col("tags")))
    return selected.withColumn("tag_key", F.array_min(F.transform("tags", lambda t: t["tag_key"])))


def ambiguous_matches(matches: DataFrame) -> DataFrame:
    """Row-filter aliases that select more than one column of a table.

    Reading such a table fails with ``UC_ABAC_AMBIGUOUS_COLUMN_MATCH``; a mask
    may select any number of columns.
    """
    return (
        matches.where(F.col("policy_type") == ROW_FILTER)
        .groupBy(*KEY, *_POLICY, "alias")
        .agg(F.min("column").alias("first_column"), F.max("column").alias("last_column"))
        .where(F.col("first_column") != F.col("last_column"))
        .withColumn("error_code", F.lit("UC_ABAC_AMBIGUOUS_COLUMN_MATCH"))
    )


def policies_in_force(matches: DataFrame) -> DataFrame:
    """Policies that act on each table: on the table itself, its schema or its catalog,
    with every alias matched by some column."""
    return (
        matches.groupBy(*KEY, *_POLICY, "policy_type", "function_fqn", "n_aliases", "alias")
        .agg(F.count("*").alias("n_columns"))
        .groupBy(*KEY, *_POLICY, "policy_type", "function_fqn", "n_aliases")
        .agg(F.count("*").alias("n_matched"), F.sum("n_columns").alias("n_columns"))
        .where(F.col("n_matched") == F.col("n_aliases"))
        .drop("n_matched", "n_aliases")
    )
