"""A run over all tables in scope: the operators chained, one job per written table."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import MISSING, dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import KEY, catalog_securable, schema_securable, table_securable
from tablewarden.operators import audit as audit_ops
from tablewarden.operators import rollback as undo
from tablewarden.operators.catalog import parse_table_names, resolve_scope
from tablewarden.operators.decide import outcomes, plan_objects, with_faults
from tablewarden.operators.inventory import build_inventory
from tablewarden.operators.membership import LITERAL_LIMIT
from tablewarden.operators.policies import (
    drop_policies,
    existing_policies,
    new_policies,
    plan_policies,
    remove_masks,
    remove_row_filters,
    removed_masks,
    removed_row_filters,
    upsert_policies,
    with_match_columns,
)
from tablewarden.operators.results import none_steps, run_summary, table_results, until_first_failure
from tablewarden.operators.tags import (
    GrantOptions,
    apply_grants,
    assign_tags,
    assigned_tags,
    create_tags,
    grant_outcomes,
    grants,
    minted_tags,
    new_rules,
    resolve_tags,
    tag_requests,
    usable,
)
from tablewarden.operators.verify import (
    acting_only,
    covered_objects,
    detect_drift,
    keep_uncovered,
    new_coverage,
    record_coverage,
    verify_masks,
    verify_row_filters,
    verify_tables,
)
from tablewarden.plans.options import RunOptions
from tablewarden.plans.stored import FRAMES, Changes, StateStore
from tablewarden.sources.schemas import AUDIT, conform
from tablewarden.sources.store import (
    append_audit,
    append_inventory,
    append_tag_grants,
    cut_lineage,
    read_table,
)


NOT_LISTED = "The table is not in the listing."


@dataclass(frozen=True)
class GovernanceState:
    """All metadata a run reads (schemas in ``sources.schemas``); runs return a new one.

    With a *store* (``stored_state``) a run commits its changes there instead of
    writing the frames anew.
    """

    tables: DataFrame
    row_filters: DataFrame
    masks: DataFrame
    policies: DataFrame
    column_tags: DataFrame
    governed_tags: DataFrame
    functions: DataFrame
    grant_rules: DataFrame | None = None
    coverage: DataFrame | None = None
    store: StateStore | None = None
    version: int | None = None


def load_state(store: StateStore, version: int | None = None) -> GovernanceState:
    """State as of a version of *store*, by default the newest.

    Runs on it commit there, and fail if another commit came in between.
    """
    version = store.version if version is None else version
    known = store.known(version)
    names = [f.name for f in fields(GovernanceState) if f.name in FRAMES and (f.name in known or f.default is MISSING)]
    return GovernanceState(**{n: store.read(n, version) for n in names}, store=store, version=version)


def _commit(state: GovernanceState, changes: dict[str, Changes]) -> GovernanceState:
    """The state after *changes*, which build on the version that *state* shows."""
    state.store.append(changes, state.version)
    return load_state(state.store)


def stored_state(state: GovernanceState, store: StateStore) -> GovernanceState:
    """*state* written whole to *store*, for runs that then write changes only."""
    frames = {f.name: getattr(state, f.name) for f in fields(state) if f.name in FRAMES}
    store.save({n: df for n, df in frames.items() if df is not None})
    return load_state(store)


@dataclass(frozen=True)
class RunResult:
    options: RunOptions
    state: GovernanceState
    inventory: DataFrame | None = None
    steps: DataFrame | None = None
    results: DataFrame | None = None
    summary: DataFrame | None = None
    tag_grants: DataFrame | None = None
    audit: DataFrame | None = None


def _now() -> Column:
    """The time as a literal: a frame that is read again shows the time that was written."""
    return F.lit(dt.datetime.now(dt.timezone.utc))


def named_tables(state: GovernanceState, options: RunOptions) -> DataFrame:
    """Keys of the tables that the options name, listed or not."""
    names = state.tables.sparkSession.createDataFrame([(n,) for n in options.tables], "name string")
    wrong = [r.error_message for r in parse_table_names(names).where("error_message is not null").collect()]
    if wrong:
        raise ValueError("; ".join(wrong))
    return resolve_scope(state.tables, "SPECIFIC_TABLES", names=names)


def scoped(df: DataFrame, state: GovernanceState, options: RunOptions) -> DataFrame:
    """Rows of a frame with table keys that are in scope.

    All scopes but named tables are predicates on catalog and schema, which
    reach the frame's own scan.
    """
    if options.scope_type == "SPECIFIC_TABLES":
        return df.join(named_tables(state, options), KEY, "left_semi")
    return resolve_scope(
        df, options.scope_type, list(options.catalogs), options.schemas, exclude_schema_regex=options.exclude_schema_regex
    )


def tables_in_scope(state: GovernanceState, options: RunOptions) -> DataFrame:
    """Tables selected by the options; a named table that is not listed is kept, as one that cannot be described."""
    if options.scope_type != "SPECIFIC_TABLES":
        return scoped(state.tables, state, options)
    return named_tables(state, options).join(state.tables, KEY, "left").select(
        *KEY,
        F.coalesce("table_type", F.lit("UNKNOWN")).alias("table_type"),
        F.when(F.col("table_type").isNull() & F.col("describe_error").isNull(), F.lit(NOT_LISTED)).otherwise(F.col("describe_error")).alias("describe_error"),
    )


def policies_in_scope(state: GovernanceState, options: RunOptions) -> DataFrame:
    """Policies of the scope's catalogs, on them or on their tables: prefixes that reach the scan.

    Named tables have the policies on them, their schemas and their catalogs: by
    name at the scan, or beyond the literal limit by a semi join.
    """
    if options.scope_type == "SPECIFIC_TABLES":
        above = F.array(table_securable(), schema_securable(), catalog_securable())
        wanted = named_tables(state, options).select(F.explode(above).alias("on_securable")).distinct()
        if len(options.tables) > LITERAL_LIMIT // 3:
            return state.policies.join(wanted, "on_securable", "left_semi").select(*state.policies.columns)
        return state.policies.where(F.col("on_securable").isin([r.on_securable for r in wanted.collect()]))
    names = options.schemas if options.scope_type == "SELECTED_SCHEMAS" else options.catalogs
    if options.scope_type == "ALL_CATALOGS" or not names:
        return state.policies
    on = F.col("on_securable")
    return state.policies.where(
        reduce(Column.__or__, [(on == f"CATALOG `{c}`") | F.startswith(on, F.lit(f"SCHEMA `{c}`.")) | F.startswith(on, F.lit(f"TABLE `{c}`.")) for c in names])
    )


def existing_of(state: GovernanceState, options: RunOptions) -> DataFrame:
    found = existing_policies(
        policies_in_scope(state, options), options.policy_scope, scoped(state.column_tags, state, options), options.tag_team_prefix
    )
    return scoped(found, state, options) if options.policy_scope == "TABLE" else found


def inventory_of(
    tables: DataFrame, state: GovernanceState, options: RunOptions, audit: DataFrame | None = None
) -> DataFrame:
    """Inventory of *tables*; with an audit log also the last status of each."""
    return build_inventory(
        tables,
        scoped(state.row_filters, state, options),
        scoped(state.masks, state, options),
        existing_of(state, options),
        options.run_id,
        options.suggest_pii_tags,
        None if audit is None else audit_ops.latest_per_table(scoped(audit, state, options)),
    )


def planned_objects(tables: DataFrame, state: GovernanceState, options: RunOptions) -> DataFrame:
    """Decisions for the objects of *tables*."""
    return plan_objects(
        scoped(state.row_filters, state, options),
        scoped(state.masks, state, options),
        existing_of(state, options),
        policies_in_scope(state, options),
        state.functions,
        options.policy_scope,
        options.tag_team_prefix,
        tables,
    )


def resolved_tags(planned: DataFrame, state: GovernanceState, options: RunOptions) -> DataFrame:
    """Tags that the policies of *planned* match.

    A catalog policy serves every table of its function, whatever other tags
    their columns carry: it matches the function's own key, and each of its
    columns gets that key.  Only a table's own policy may go by a tag in place.
    """
    return resolve_tags(
        tag_requests(planned, options.tag_team_prefix),
        scoped(state.column_tags, state, options),
        state.governed_tags,
        options.prefer_existing_tags and options.policy_scope == "TABLE",
        options.reuse_same_role_only,
    )


def migration_steps(
    planned: DataFrame, resolved: DataFrame | None, options: RunOptions, faults: DataFrame | None = None
) -> DataFrame:
    """Outcome per object in the phase that the mode runs."""
    objects = planned
    if resolved is not None:
        objects = plan_policies(
            with_match_columns(planned, usable(resolved)),
            options.policy_scope,
            list(options.policy_to_principals),
            list(options.policy_except_principals),
        )
    return outcomes(with_faults(objects, faults), options.phase, options.dry_run)


def next_state(
    state: GovernanceState, steps: DataFrame, resolved: DataFrame | None, granted: DataFrame | None
) -> GovernanceState:
    """State after the steps."""
    changes: dict[str, DataFrame] = {
        "row_filters": remove_row_filters(state.row_filters, steps),
        "masks": remove_masks(state.masks, steps),
    }
    if resolved is not None:
        changes["policies"] = upsert_policies(state.policies, steps.where("policy_created"))
        changes["column_tags"] = assign_tags(state.column_tags, resolved)
        changes["governed_tags"] = create_tags(state.governed_tags, minted_tags(resolved, state.governed_tags))
    if granted is not None and state.grant_rules is not None:
        changes["grant_rules"] = apply_grants(state.grant_rules, granted)
    return replace(state, **changes)


def run_changes(
    state: GovernanceState, steps: DataFrame, resolved: DataFrame | None, granted: DataFrame | None, run_id: str
) -> dict[str, Changes]:
    """What ``next_state`` and the coverage record change, by frame: rows of this run alone."""
    changes = {
        "row_filters": Changes(deletes=removed_row_filters(steps)),
        "masks": Changes(deletes=removed_masks(steps)),
        "coverage": Changes(new_coverage(steps, run_id, _now())),
    }
    if resolved is not None:
        changes["policies"] = Changes(new_policies(steps.where("policy_created")))
        changes["column_tags"] = Changes(assigned_tags(resolved))
        changes["governed_tags"] = Changes(minted_tags(resolved, state.governed_tags))
    if granted is not None and state.grant_rules is not None:
        changes["grant_rules"] = Changes(new_rules(granted))
    return changes


def verify(tables: DataFrame, state: GovernanceState, options: RunOptions) -> DataFrame:
    """Status per table: a policy counts where it acts on the object, and what an earlier run saw covered must still be."""
    existing = existing_of(state, options)
    steps = verify_row_filters(
        scoped(state.row_filters, state, options), existing, policies_in_scope(state, options), options.policy_scope, options.tag_team_prefix
    ).unionByName(verify_masks(scoped(state.masks, state, options), existing))
    covered = covered_objects(policies_in_scope(state, options), scoped(state.column_tags, state, options))
    recorded = None if state.coverage is None else scoped(state.coverage, state, options)
    return verify_tables(tables, acting_only(steps, covered, recorded))


def _migrate(
    tables: DataFrame, state: GovernanceState, options: RunOptions, faults: DataFrame | None, audit: DataFrame | None
) -> RunResult:
    started = _now()
    inventory = cut_lineage(inventory_of(tables, state, options, audit))
    append_inventory(inventory, options.inventory_path, options.dry_run)
    if options.phase is None:
        return RunResult(options, state, inventory)

    eligible = inventory.where(F.col("migration_eligibility") == "ELIGIBLE").select(*KEY)
    planned = cut_lineage(planned_objects(eligible, state, options))
    resolved = granted = None
    if options.phase != "FINALIZE":
        resolved = cut_lineage(resolved_tags(planned, state, options))
    steps = cut_lineage(migration_steps(planned, resolved, options, faults))
    bare = cut_lineage(eligible.join(steps.select(*KEY), KEY, "left_anti"))
    if resolved is not None and not options.dry_run:
        tags = assign_tags(scoped(state.column_tags, state, options), resolved)
        steps = keep_uncovered(steps, upsert_policies(policies_in_scope(state, options), steps.where("policy_created")), tags)
    elif options.phase == "FINALIZE":
        # the old rule goes only where the policy made earlier still acts
        steps = keep_uncovered(steps, policies_in_scope(state, options), scoped(state.column_tags, state, options))
    # the steps are wide and written once: what changed in them since, and tables without any, are narrow frames of their own
    steps = steps.unionByName(none_steps(bare), allowMissingColumns=True)
    results = table_results(steps)
    recorded = steps
    if not options.continue_on_error:
        # what is not recorded does not happen: no tag, grant, policy or removal beyond the first failure
        results = cut_lineage(until_first_failure(results))
        recorded = steps.join(results.select(*KEY), KEY, "left_semi")
        if resolved is not None:
            resolved = resolved.join(results.select(*KEY), KEY, "left_semi")
    if resolved is not None and options.tag_grantee_principals:
        granted = _grant(resolved, state, options)
    rows = audit_ops.audit_rows(recorded, results, options.run_id, uuid.uuid4().hex, started, _now(), options.dry_run)
    append_audit(rows, options.audit_path, options.dry_run)
    new_state = state
    if not options.dry_run and state.store is not None:
        new_state = _commit(state, run_changes(state, recorded, resolved, granted, options.run_id))
    elif not options.dry_run:
        covered = record_coverage(state.coverage, recorded, options.run_id, _now())
        new_state = written(replace(next_state(state, recorded, resolved, granted), coverage=covered), state)
    return RunResult(options, new_state, inventory, steps, results, run_summary(results), granted, rows)


def written(new: GovernanceState, old: GovernanceState) -> GovernanceState:
    """*new* with every frame that differs from *old* written out, so that a chain of runs does not recompute itself."""
    changed = {f.name: getattr(new, f.name) for f in fields(new) if getattr(new, f.name) is not getattr(old, f.name)}
    return replace(new, **{name: cut_lineage(df) for name, df in changed.items()})


def _grant(resolved: DataFrame, state: GovernanceState, options: RunOptions) -> DataFrame:
    wanted = grants(resolved, GrantOptions(options.tag_grantee_principals, options.tag_grantee_role))
    if state.grant_rules is None and not options.dry_run:
        raise ValueError("granting needs grant_rules in the state")
    granted = grant_outcomes(wanted, state.grant_rules, options.dry_run)
    rows = granted.withColumns(
        {"run_id": F.lit(options.run_id), "dry_run": F.lit(options.dry_run), "granted_at": _now()}
    )
    append_tag_grants(rows, options.tag_grants_path, options.dry_run)
    return granted


def _rollback_in_order(state: GovernanceState, options: RunOptions, audit: DataFrame) -> RunResult:
    """Undo every run that builds on this one, newest first, then the run itself; results hold all of them."""
    order = [r.run_id for r in undo.undo_order(audit, options.run_id).orderBy("position").collect()]
    parts: list[RunResult] = []
    for at, run_id in enumerate(order):
        part = _rollback(state, replace(options, run_id=run_id, later_runs="REFUSE"), audit, order[:at] if options.dry_run else ())
        # a written log shows the rows that the rollback appended; one that was handed in does not
        audit = conform(audit, AUDIT).unionByName(part.audit)
        state = part.state
        parts.append(part)

    def all_of(name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])

    return RunResult(options, state, steps=all_of("steps"), results=all_of("results"), audit=all_of("audit"))


def _rollback(state: GovernanceState, options: RunOptions, audit: DataFrame, undone: Sequence[str] = ()) -> RunResult:
    started = _now()
    parsed = undo.parse_metadata(audit, options.run_id)
    blocked = undo.superseded(audit, options.run_id, undone)
    steps = cut_lineage(undo.rollback_steps(undo.rollback_objects(parsed), state.functions, options.dry_run, blocked))
    results = undo.rollback_results(parsed, steps)
    rows = undo.rollback_audit_rows(results, steps, options.run_id, uuid.uuid4().hex, started, _now(), options.dry_run)
    new_state = state
    if not options.dry_run:
        rows = cut_lineage(rows)
        append_audit(rows, options.audit_path)
        filters = undo.restore_row_filters(state.row_filters, steps)
        masks = undo.restore_masks(state.masks, steps)
        dropped = undo.droppable_policies(
            steps, filters, masks, state.column_tags, options.policy_scope, options.tag_team_prefix
        )
        # a dropped policy protects nothing any more, the restored rules do
        if state.store is not None:
            changes = {
                "row_filters": Changes(undo.restored_row_filters(steps)),
                "masks": Changes(undo.restored_masks(steps)),
                "policies": Changes(deletes=dropped),
            }
            if state.coverage is not None:
                changes["coverage"] = Changes(deletes=state.coverage.join(dropped, ["on_securable", "policy_name"], "left_semi"))
            new_state = _commit(state, changes)
        else:
            restored = replace(state, row_filters=filters, masks=masks, policies=drop_policies(state.policies, dropped))
            if state.coverage is not None:
                restored = replace(restored, coverage=state.coverage.join(dropped, ["on_securable", "policy_name"], "left_anti"))
            new_state = written(restored, state)
    return RunResult(options, new_state, steps=steps, results=results, audit=rows)


def run(
    state: GovernanceState, options: RunOptions, faults: DataFrame | None = None, audit: DataFrame | None = None
) -> RunResult:
    """Run one mode.

    *audit* is the log that RECONCILE and ROLLBACK read, by default the table
    at ``options.audit_path``; given to other modes, it fills the inventory's
    last status.
    INVENTORY and the migrating modes append to their tables unless dry; VERIFY
    and RECONCILE only return results; ROLLBACK undoes ``options.run_id``: objects
    that a later run changed fail, or later runs go first (``options.later_runs``).
    Intermediate frames go to the folder that executors share.
    """
    if audit is None and options.mode in ("RECONCILE", "ROLLBACK"):
        audit = read_table(state.tables.sparkSession, options.audit_path, AUDIT)
    if options.mode == "ROLLBACK" and options.later_runs == "CASCADE":
        return _rollback_in_order(state, options, audit)
    if options.mode == "ROLLBACK":
        return _rollback(state, options, audit)
    tables = tables_in_scope(state, options)
    if options.mode == "VERIFY":
        return RunResult(options, state, results=verify(tables, state, options))
    if options.mode == "RECONCILE":
        return RunResult(options, state, results=detect_drift(tables, audit, verify(tables, state, options)))
    return _migrate(tables, state, options, faults, audit)
