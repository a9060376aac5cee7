"""Apply row filters and column masks of one table for one principal.

Filters read raw columns, masks come last, and whatever the caller adds sits
above the masks.  The same function serves batch and streaming frames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.masks import Mask, unless_admin
from tablewarden.functions.names import COLUMN_MASK, ROW_FILTER
from tablewarden.operators.matching import resolve_match_columns
from tablewarden.operators.membership import ADMIN_GROUP, Who, resolve_who
from tablewarden.operators.rowfilters import RowRule, policies_binding


class AmbiguousColumnMatch(ValueError):
    """UC_ABAC_AMBIGUOUS_COLUMN_MATCH: a row-filter alias selects several columns."""


class ConflictingMasks(ValueError):
    """Two different masks on one column."""


class UnclearMask(ValueError):
    """A mask policy without a target, or with one that is none of its aliases."""


class UnclearPolicy(UnclearMask):
    """A policy that binds the principal and cannot be understood: its condition, its function or what it is on."""


class MissingColumn(ValueError):
    """A mask guards a column that the frame does not have, perhaps because it was renamed."""


class UnknownFunction(KeyError):
    """A rule names a function that the registry does not hold."""


@dataclass(frozen=True)
class MaskFunction:
    mask: Mask
    admin_bypass: bool = False


Registry = Mapping[str, "RowRule | MaskFunction"]


@dataclass(frozen=True)
class SecurityState:
    """Governance frames (see ``sources.schemas``) plus the functions that rules name."""

    membership: DataFrame
    functions: Registry
    row_filters: DataFrame | None = None
    masks: DataFrame | None = None
    policies: DataFrame | None = None
    column_tags: DataFrame | None = None
    admin_group: str = ADMIN_GROUP


@dataclass(frozen=True)
class Rules:
    """What acts on one table: ``(function, columns)`` filters and ``{column: function}`` masks.

    Columns are in lower case, as Spark takes them.
    """

    filters: tuple[tuple[str, tuple[str, ...]], ...]
    masks: dict[str, str]


def _on(df: DataFrame, table: tuple[str, str, str]) -> DataFrame:
    catalog, schema, name = table
    return df.where((F.col("catalog") == catalog) & (F.col("schema") == schema) & (F.col("table") == name))


def _unclear(policies: DataFrame) -> Column:
    """Why a policy cannot be enforced, NULL if it can."""
    listed = {c: F.col(c) if c in policies.columns else F.lit(None) for c in ("problem", "conditions")}
    known = F.transform(listed["conditions"], lambda c: c["alias"]) if "conditions" in policies.columns else F.array().cast("array<string>")
    known = F.coalesce(known, F.array().cast("array<string>"))
    no_test = F.exists("match_columns", lambda m: m["alias"].isNull() | (m["tag_key"].isNull() & ~F.array_contains(known, F.coalesce(m["alias"], F.lit("")))))
    return (
        F.when(listed["problem"].isNotNull(), listed["problem"].cast("string"))
        .when(F.col("on_securable").isNull() | ~F.col("on_securable").rlike("^(TABLE|SCHEMA|CATALOG) `"), "unknown securable")
        .when(F.col("match_columns").isNull() | (F.size("match_columns") < 1), "no match columns")
        .when(no_test, "an alias without a condition")
        .when(F.col("function_fqn").isNull(), "no function")
        .when(F.col("policy_type").isNull() | ~F.col("policy_type").isin(ROW_FILTER, COLUMN_MASK), "unknown type")
    )


def _rule_rows(table: tuple[str, str, str], state: SecurityState, who: Who, columns: Sequence[str] | None) -> list[DataFrame]:
    """Old rules of the table, and the policies that bind *who* with one row per alias and the columns it selects.

    Policies that cannot be understood come as rows with a ``problem``.
    """
    parts = []
    if state.row_filters is not None:
        parts.append(
            _on(state.row_filters, table).select(
                F.lit(ROW_FILTER).alias("policy_type"), "function_fqn", F.col("using_columns").alias("columns")
            )
        )
    if state.masks is not None:
        parts.append(
            _on(state.masks, table).select(
                F.lit(COLUMN_MASK).alias("policy_type"), "function_fqn", F.array("column").alias("columns")
            )
        )
    if state.policies is not None:
        if state.column_tags is None:
            raise ValueError("policies match columns by their tags: without column_tags nothing would be protected")
        catalog, schema, name = table
        on = F.col("on_securable")
        ours = on.isin(f"TABLE `{catalog}`.`{schema}`.`{name}`", f"SCHEMA `{catalog}`.`{schema}`", f"CATALOG `{catalog}`")
        named = reduce(Column.__or__, [F.startswith(on, F.lit(kind)) for kind in ("TABLE `", "SCHEMA `", "CATALOG `")])
        # a policy on nothing known may be on this table, and one with nobody in TO may bind everyone
        near = state.policies.where(ours | on.isNull() | ~named).withColumn("__why", _unclear(state.policies))
        here = policies_binding(near.where(F.col("__why").isNull()), who).drop("__why")
        nobody = F.size(F.coalesce("to_principals", F.array().cast("array<string>"))) == 0
        odd = near.where(F.col("__why").isNotNull())
        problem = F.concat_ws(": ", "policy_name", "__why").alias("problem")
        parts.append(policies_binding(odd, who).select(problem).unionAll(odd.where(nobody).select(problem)))
        key = ["on_securable", "policy_name"]
        all_columns = None
        if columns is not None and "conditions" in state.policies.columns:
            rows = [(*table, c) for c in columns]
            all_columns = state.policies.sparkSession.createDataFrame(rows, "catalog string, schema string, `table` string, column string")
        matched = (
            resolve_match_columns(here, _on(state.column_tags, table), all_columns)
            .groupBy(*key, "alias")
            .agg(F.sort_array(F.collect_set("column")).alias("columns"))
        )
        body = here.select(
            *key,
            "policy_type",
            "function_fqn",
            F.array_distinct(F.transform("match_columns", lambda m: m["alias"])).alias("aliases"),
            "using_columns",
            "target_alias",
        )
        parts.append(matched.join(body, key))
    return parts


def rules_on(table: tuple[str, str, str], state: SecurityState, who: Who, columns: Sequence[str] | None = None) -> Rules:
    """Rules in force on one table for *who*.

    One small job over rows of this one table; what reaches the driver is
    bounded by the table's own columns, tags and rules.  *columns* are the
    table's, for conditions that hold of columns without tags.  A policy that
    binds *who*, may be on this table and cannot be understood is an error.
    """
    parts = _rule_rows(table, state, who, columns)
    if not parts:
        return Rules((), {})
    found = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).collect()

    filters: dict[tuple[str, tuple[str, ...]], None] = {}
    masks: dict[str, str] = {}

    def add(kind: str, function: str, columns: list[str]) -> None:
        lower = [c.lower() for c in columns]
        if kind == ROW_FILTER:
            filters[(function, tuple(lower))] = None
            return
        for column in lower:
            if masks.setdefault(column, function) != function:
                raise ConflictingMasks(f"{'.'.join(table)}.{column}: {masks[column]} and {function}")

    by_policy: dict[tuple[str, str], list] = {}
    odd = sorted({r.problem for r in found if "problem" in r and r.problem is not None})
    if odd:
        raise UnclearPolicy(f"{'.'.join(table)}: {'; '.join(odd)}")
    for r in found:
        if "policy_name" in r and r.policy_name is not None:
            by_policy.setdefault((r.on_securable, r.policy_name), []).append(r)
        else:
            add(r.policy_type, r.function_fqn, r.columns)
    for rows in by_policy.values():
        p, columns = rows[0], {r.alias: list(r.columns) for r in rows}
        if len(columns) < len(p.aliases):
            continue
        if p.policy_type == COLUMN_MASK:
            if p.target_alias not in columns:
                raise UnclearMask(f"{'.'.join(table)} {p.policy_name}: target {p.target_alias} of {p.aliases}")
            add(COLUMN_MASK, p.function_fqn, columns[p.target_alias])
            continue
        several = {a: c for a, c in columns.items() if len(c) > 1}
        if several:
            raise AmbiguousColumnMatch(f"{'.'.join(table)} {p.policy_name}: {several}")
        add(ROW_FILTER, p.function_fqn, [columns[a][0] for a in p.using_columns])
    return Rules(tuple(filters), masks)


def _lookup(functions: Registry, fqn: str):
    try:
        return functions[fqn]
    except KeyError:
        raise UnknownFunction(fqn) from None


def apply_row_filters(df: DataFrame, filters, functions: Registry, who: Who) -> DataFrame:
    """All filters must let a row through."""
    for fqn, columns in filters:
        df = _lookup(functions, fqn)(df, list(columns), who)
    return df


def apply_masks(df: DataFrame, masks: Mapping[str, str], functions: Registry, who: Who, pruned: bool = False) -> DataFrame:
    """Every masked column replaced in one projection; names, order and types stay.

    Column names match without regard to case, so that none slips through.  A
    guarded column that *df* lacks is an error, for it may be there under
    another name; *pruned* says that columns were only left out.
    """
    by_column = {c.lower(): fn for c, fn in masks.items()}
    absent = set(by_column) - {c.lower() for c in df.columns}
    if absent and not pruned:
        raise MissingColumn(f"masked columns not in the frame: {sorted(absent)}")
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name.lower() in by_column:
            fn = _lookup(functions, by_column[field.name.lower()])
            mask = unless_admin(fn.mask, fn.admin_bypass and who.is_admin)
            c = mask(c, field.dataType).cast(field.dataType).alias(field.name)
        out.append(c)
    return df.select(*out)


def apply_rules(df: DataFrame, rules: Rules, functions: Registry, who: Who, pruned: bool = False) -> DataFrame:
    return apply_masks(apply_row_filters(df, rules.filters, functions, who), rules.masks, functions, who, pruned)


def secure(df: DataFrame, table: tuple[str, str, str], state: SecurityState, principal: str | Who, pruned: bool = False) -> DataFrame:
    """What *principal* sees of *df*, the rows of *table*.

    Old per-table rules and tag-matched policies may both be active: equal
    rules act once, and two different masks on one column are an error.  So is
    whatever would leave a column unprotected unnoticed: policies without tags,
    policies that cannot be understood, a mask without a clear target, and, unless *pruned*, a masked column that *df* lacks.
    """
    who = principal if isinstance(principal, Who) else resolve_who(state.membership, principal, state.admin_group)
    return apply_rules(df, rules_on(table, state, who, df.columns), state.functions, who, pruned)
