"""Deterministic names of tags, aliases, policies and securables as columns."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ["catalog", "schema", "table"]

ROW_FILTER = "ROW_FILTER"
COLUMN_MASK = "COLUMN_MASK"

# Key stems per role, the length limit of a key's body, the
# policy name stems, and the pattern of a bare service principal id.
ROLE_STEM = {"row_filter": "abac_rls_", "mask": "abac_colmask_"}
MAX_KEY_BODY = 180
ROW_FILTER_POLICY = "migrated_row_filter"
MASK_POLICY_STEM = "migrated_mask_"
_PLAIN = string.ascii_letters + string.digits + "_"
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize(c: Column | str) -> Column:
    """Everything but ASCII letters, digits and ``_`` becomes ``_``.

    The characters that are left without the plain ones are replaced by name: a
    regular expression takes about 5 microseconds a match, this 1 a text.
    """
    odd = F.translate(_col(c), _PLAIN, "")
    return F.call_function("translate", _col(c), odd, F.repeat(F.lit("_"), F.length(odd)))


def sanitize_text(text: str) -> str:
    """:func:`sanitize` for an option known on the driver."""
    return re.sub("[^a-zA-Z0-9_]", "_", text)


def name_part(fqn: Column, which: str) -> Column:
    """Catalog, schema or function of a dotted name, backticks dropped.

    Three or more parts give the first, the second and the last; two give
    catalog and function; one gives the function alone.
    """
    parts = F.split(F.replace(fqn, F.lit("`"), F.lit("")), r"\.")
    n = F.size(parts)
    if which == "catalog":
        return F.when(n >= 2, F.get(parts, F.lit(0)))
    if which == "schema":
        return F.when(n >= 3, F.get(parts, F.lit(1)))
    return F.element_at(parts, -1)


def tag_key(function_fqn: Column | str, role: str, team_prefix: str = "") -> Column:
    """Tag key of a function: ``abac_<role>_[team_]catalog_schema_function``.

    Empty parts leave no gap; the body is cut at 180 characters and carries
    no hash, so two raw names can meet (the mint step reports that).
    """
    fqn = _col(function_fqn)
    parts = [F.nullif(name_part(fqn, p), F.lit("")) for p in ("catalog", "schema", "function")]
    if team_prefix:
        parts.insert(0, F.lit(sanitize_text(team_prefix)))
    body = F.substring(sanitize(F.concat_ws("_", *parts)), 1, MAX_KEY_BODY)
    return F.concat(F.lit(ROLE_STEM[role]), body)


def key_prefix(role: str, team_prefix: str = "") -> Column:
    """What every key of a function in the row's own catalog and schema starts with."""
    parts = [F.nullif(F.col(p), F.lit("")) for p in ("catalog", "schema")]
    if team_prefix:
        parts.insert(0, F.lit(sanitize_text(team_prefix)))
    return F.concat(F.lit(ROLE_STEM[role]), sanitize(F.concat_ws("_", *parts)), F.lit("_"))


def match_alias(column: Column | str) -> Column:
    return F.concat(F.lit("mc_"), _col(column))


def principal(raw: Column | str) -> Column:
    """A bare UUID is a service principal; anything else is kept as written."""
    c = _col(raw)
    return F.when(c.rlike(UUID_PATTERN), F.concat(F.lit("servicePrincipals/"), c)).otherwise(c)


def principal_text(raw: str) -> str:
    """:func:`principal` for an option known on the driver."""
    return f"servicePrincipals/{raw}" if re.match(UUID_PATTERN, raw) else raw


def quoted(c: Column | str) -> Column:
    return F.concat(F.lit("`"), _col(c), F.lit("`"))


def full_name() -> Column:
    return F.concat_ws(".", *KEY)


def table_securable() -> Column:
    return F.concat(F.lit("TABLE "), F.concat_ws(".", *[quoted(k) for k in KEY]))


def catalog_securable() -> Column:
    return F.concat(F.lit("CATALOG "), quoted("catalog"))


def schema_securable() -> Column:
    return F.concat(F.lit("SCHEMA "), F.concat_ws(".", quoted("catalog"), quoted("schema")))


def securable(scope: str) -> Column:
    return table_securable() if scope == "TABLE" else catalog_securable()


def _table_stem(team_prefix: str) -> str:
    return f"abac_{sanitize_text(team_prefix)}_" if team_prefix else "abac_"


def row_filter_policy_name(function_fqn: Column | str, scope: str, team_prefix: str = "") -> Column:
    if scope == "TABLE":
        return F.lit(_table_stem(team_prefix) + ROW_FILTER_POLICY)
    return tag_key(function_fqn, "row_filter", team_prefix)


def mask_policy_prefix(team_prefix: str = "") -> str:
    return _table_stem(team_prefix) + MASK_POLICY_STEM


def mask_policy_name(column: Column | str, function_fqn: Column | str, scope: str, team_prefix: str = "") -> Column:
    """Named after the column as it is (not sanitized) or after the function."""
    if scope == "TABLE":
        return F.concat(F.lit(mask_policy_prefix(team_prefix)), _col(column))
    return tag_key(function_fqn, "mask", team_prefix)
