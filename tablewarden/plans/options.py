"""Options of a run, checked when they are made."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from tablewarden.operators.catalog import SCOPES
from tablewarden.operators.rowfilters import EVERYONE
from tablewarden.operators.tags import GRANT_ROLES

# Run modes and the phase that each migrating mode runs.
PHASE_BY_MODE = {"MIGRATE": "FULL", "INVENTORY_AND_MIGRATE": "FULL", "APPLY_ABAC": "APPLY_ABAC", "FINALIZE": "FINALIZE"}
MODES = ("INVENTORY", *PHASE_BY_MODE, "VERIFY", "RECONCILE", "ROLLBACK")
POLICY_SCOPES = ("TABLE", "CATALOG")
LATER_RUNS = ("REFUSE", "CASCADE")


@dataclass(frozen=True)
class RunOptions:
    """*audit_path*, *inventory_path* and *tag_grants_path* name the Parquet
    tables that a run appends to; all frames of state are passed separately.
    *later_runs* says what ROLLBACK does where later runs changed the same
    objects: those objects fail, or the later runs are undone first."""

    mode: str = "INVENTORY"
    scope_type: str = "SELECTED_CATALOGS"
    catalogs: tuple[str, ...] = ()
    schemas: dict[str, list[str]] = field(default_factory=dict)
    tables: tuple[str, ...] = ()
    exclude_schema_regex: str = ""
    dry_run: bool = True
    continue_on_error: bool = True
    audit_path: str = ""
    inventory_path: str = ""
    tag_grants_path: str = ""
    policy_scope: str = "TABLE"
    policy_to_principals: tuple[str, ...] = (EVERYONE,)
    policy_except_principals: tuple[str, ...] = ()
    tag_team_prefix: str = ""
    prefer_existing_tags: bool = True
    reuse_same_role_only: bool = False
    tag_grantee_principals: tuple[str, ...] = ()
    tag_grantee_role: str = "ASSIGN"
    suggest_pii_tags: bool = False
    later_runs: str = "REFUSE"
    run_id: str = ""

    def __post_init__(self) -> None:
        if not self.run_id:
            if self.mode == "ROLLBACK":
                raise ValueError("ROLLBACK needs the run_id to undo")
            object.__setattr__(self, "run_id", str(uuid.uuid4()))
        for name, value, allowed in (
            ("mode", self.mode, MODES),
            ("scope_type", self.scope_type, SCOPES),
            ("policy_scope", self.policy_scope, POLICY_SCOPES),
            ("later_runs", self.later_runs, LATER_RUNS),
            ("tag_grantee_role", self.tag_grantee_role.upper(), tuple(GRANT_ROLES)),
        ):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, got {value!r}")
        for scope, given in (
            ("SELECTED_CATALOGS", self.catalogs),
            ("SELECTED_SCHEMAS", self.schemas),
            ("SPECIFIC_TABLES", self.tables),
        ):
            if self.scope_type == scope and not given and self.mode != "ROLLBACK":
                raise ValueError(f"scope_type={scope} needs a selection")
        re.compile(self.exclude_schema_regex)
        if not self.dry_run and not (self.audit_path and self.inventory_path):
            raise ValueError("audit_path and inventory_path are needed unless dry_run is set")
        if not self.dry_run and self.tag_grantee_principals and not self.tag_grants_path:
            raise ValueError("tag_grants_path is needed when tag_grantee_principals are given")

    @property
    def phase(self) -> str | None:
        return PHASE_BY_MODE.get(self.mode)
