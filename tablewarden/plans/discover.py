"""From what a platform lists to the state that a run reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import KEY
from tablewarden.operators import describe
from tablewarden.operators.catalog import described_policies, listing_action, normalize_column_tags, parse_governed_tags
from tablewarden.plans.run import GovernanceState

# Most errors named in the message of a failed listing.
SHOWN = 20


class ListingFailed(RuntimeError):
    """A catalog or schema that was asked for could not be listed."""


def check_listing(errors: DataFrame, scope: str) -> None:
    """Raise if *errors* (securable, message, code) holds one that *scope* does not let pass."""
    grave = errors.where(listing_action(scope, "message", "code") == "raise").orderBy("securable").limit(SHOWN + 1).collect()
    if grave:
        more = " and more" if len(grave) > SHOWN else ""
        raise ListingFailed("; ".join(f"{r.securable}: {r.message}" for r in grave[:SHOWN]) + more)


def state_from_listings(
    listing: DataFrame,
    dump: DataFrame,
    column_tags: DataFrame,
    governed_tags: DataFrame,
    policy_lines: DataFrame,
    functions: DataFrame,
    errors: DataFrame | None = None,
    scope: str = "ALL_CATALOGS",
) -> GovernanceState:
    """State of all listed tables, every part by one job over its own listing.

    *listing* has the table key and ``describe_error``, *dump* the DESCRIBE
    lines, *policy_lines* the description lines of every policy, *column_tags*
    and *governed_tags* the tags as listed.  A table that could not be described
    is UNKNOWN.  *errors* met while listing stop the run or are skipped, as
    *scope* says, before anything is read.
    """
    if errors is not None:
        check_listing(errors, scope)
    tables = listing.select(*KEY, "describe_error").join(describe.table_types(dump), KEY, "left")
    kind = F.when(F.col("describe_error").isNotNull(), "UNKNOWN").otherwise(F.coalesce("table_type", F.lit("MANAGED")))
    return GovernanceState(
        tables=tables.select(*KEY, kind.alias("table_type"), "describe_error"),
        row_filters=describe.row_filters(dump),
        masks=describe.column_masks(dump),
        policies=described_policies(policy_lines),
        column_tags=normalize_column_tags(column_tags),
        governed_tags=parse_governed_tags(governed_tags),
        functions=functions,
    )
