"""Row filters.  A filter argument that is NULL hides the row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.operators.membership import LITERAL_LIMIT, Who
from tablewarden.sources.store import cut_lineage

# A rule keeps the rows of a frame that a principal may see, reading the named columns.
RowRule = Callable[[DataFrame, list[str], Who], DataFrame]


def allowed_values(value_to_group: DataFrame, who: Who) -> DataFrame:
    """Values whose group the principal is in (columns ``value, group_name``)."""
    if who.groups is not None:
        rows = value_to_group.where(F.col("group_name").isin(list(who.groups)))
    else:
        rows = value_to_group.join(who.group_rows, "group_name", "left_semi")
    return rows.select("value").distinct()


def filter_by_group(
    df: DataFrame, column: str, value_to_group: DataFrame | dict[str, str], who: Who, limit: int = LITERAL_LIMIT
) -> DataFrame:
    """Rows whose *column* maps to a group of the principal; administrators see all.

    Up to *limit* values become literals, which reach the Parquet scan; beyond
    that a semi join runs, whose strategy Spark picks by measured size, with the
    values as they are now.
    """
    if who.is_admin:
        return df
    if isinstance(value_to_group, dict):
        if who.groups is not None and len(value_to_group) <= limit:
            return df.where(F.col(column).isin([v for v, g in value_to_group.items() if g in who.groups]))
        value_to_group = df.sparkSession.createDataFrame(list(value_to_group.items()), "value string, group_name string")
    allowed = allowed_values(value_to_group, who)
    values = [r[0] for r in allowed.limit(limit + 1).collect()]
    if len(values) <= limit:
        return df.where(F.col(column).isin(values))
    allowed = cut_lineage(allowed).withColumnRenamed("value", "__allowed")
    return df.join(allowed, df[column] == allowed["__allowed"], "left_semi")


def filter_public_or_group(df: DataFrame, column: str, public: list[str], group: str, who: Who) -> DataFrame:
    """Members of *group* see all rows, everybody else the listed public values."""
    return df if who.is_member(group) else df.where(F.col(column).isin(public))


def group_rule(value_to_group: DataFrame | dict[str, str]) -> RowRule:
    return lambda df, columns, who: filter_by_group(df, columns[0], value_to_group, who)


def public_or_group_rule(public: list[str], group: str) -> RowRule:
    return lambda df, columns, who: filter_public_or_group(df, columns[0], public, group, who)


def equals_rule(value: object) -> RowRule:
    """Constant filter that asks nobody who they are: ``region = 'east'``."""
    return lambda df, columns, _who: df.where(F.col(columns[0]) == F.lit(value))


def predicate_rule(predicate: Callable[..., Column]) -> RowRule:
    """Filter over several columns: *predicate* gets one Column per named column."""
    return lambda df, columns, _who: df.where(predicate(*[F.col(c) for c in columns]))


@dataclass(frozen=True)
class Scoping:
    """Whom a policy binds.  Being listed in *except_* wins over being listed in *to*."""

    to: list[str]
    except_: list[str]


EVERYONE = "account users"


def binds(scoping: Scoping, who: Who) -> bool:
    """Does a policy with this TO / EXCEPT list apply to the principal?"""
    if scoping.except_ and who.is_any(scoping.except_, EVERYONE):
        return False
    return who.is_any(scoping.to, EVERYONE)


def policies_binding(policies: DataFrame, who: Who) -> DataFrame:
    """Policies that apply to the principal: named in TO, itself, through a
    group or as everyone, and not in EXCEPT.

    A filter over the policies; only a principal in very many groups costs a
    join, on (policy, listed name).
    """
    none = F.array().cast("array<string>")
    to, except_ = F.coalesce("to_principals", none), F.coalesce("except_principals", none)
    if who.groups is not None:
        me = F.array(*[F.lit(n) for n in (EVERYONE, who.name, *sorted(who.groups))])
        return policies.where(F.arrays_overlap(to, me) & ~F.arrays_overlap(except_, me))
    me = who.group_rows.select(F.col("group_name").alias("name")).unionAll(
        who.group_rows.sparkSession.createDataFrame([(EVERYONE,), (who.name,)], "name string")
    )

    def naming(names: Column) -> DataFrame:
        listed = policies.select("on_securable", "policy_name", F.explode(names).alias("name"))
        return listed.join(me, "name", "left_semi").select("on_securable", "policy_name")

    key = ["on_securable", "policy_name"]
    return policies.join(naming(to), key, "left_semi").join(naming(except_), key, "left_anti")
