"""Small governance states, written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewarden.operators import decide
from tablewarden.plans.options import RunOptions
from tablewarden.plans.run import GovernanceState
from tablewarden.sources import schemas

T = ("cat", "sch", "tbl")


def frame(spark: SparkSession, rows, ddl: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schemas.schema(ddl))


def policy(securable: str, name: str, kind: str, fn: str | None, key: str = "k", column: str = "region", value=None):
    alias = f"mc_{column}"
    is_filter = kind == "ROW_FILTER"
    return (securable, name, kind, fn, [(key, value, alias, column)], [alias] if is_filter else [],
            None if is_filter else alias, ["account users"], [], "")


def state(
    spark: SparkSession,
    tables=((*T, "MANAGED", None),),
    filters=(),
    masks=(),
    policies=(),
    tags=(),
    governed=(),
    functions=None,
    rules=(),
) -> GovernanceState:
    """*filters*: (table, fn, columns); *masks*: (table, column, fn); functions default to all that are named."""
    filter_rows = [(*t, fn, list(cols), "") for t, fn, cols in filters]
    mask_rows = [(*t, c, fn, "", i) for i, (t, c, fn) in enumerate(masks)]
    if functions is None:
        functions = {(r[3], True) for r in filter_rows} | {(r[4], True) for r in mask_rows}
    return GovernanceState(
        tables=frame(spark, tables, schemas.TABLES),
        row_filters=frame(spark, filter_rows, schemas.ROW_FILTERS),
        masks=frame(spark, mask_rows, schemas.MASKS),
        policies=frame(spark, policies, schemas.POLICIES),
        column_tags=frame(spark, [(*t, c, k, v) for t, c, k, v in tags], schemas.COLUMN_TAGS),
        governed_tags=frame(spark, governed, schemas.GOVERNED_TAGS),
        functions=frame(spark, functions, schemas.FUNCTIONS),
        grant_rules=frame(spark, rules, schemas.GRANT_RULES),
    )


def fault(spark: SparkSession, *rows) -> DataFrame:
    """Rows of (table, object_type, slot, {field: value})."""
    names = ["create_failed", "create_error_code", "create_error_message", "verify_failed", "removal_error", "legacy_remains"]
    data = [(*t, kind, slot, *[values.get(n) for n in names]) for t, kind, slot, values in rows]
    return frame(spark, data, f"{schemas._KEY}, object_type string, slot string, {decide.FAULTS}")


def options(folder, mode="MIGRATE", **kw) -> RunOptions:
    base = dict(
        mode=mode, scope_type="ALL_CATALOGS", dry_run=False, run_id="r1", audit_path=f"{folder}/audit",
        inventory_path=f"{folder}/inventory", tag_grants_path=f"{folder}/tag_grants",
    )
    return RunOptions(**{**base, **kw})


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def steps_of(result) -> dict[str, tuple]:
    """slot -> (status, error_code) of one table's steps."""
    return {r.slot: (r.status, r.error_code) for r in result.steps.select("slot", "status", "error_code").collect()}
