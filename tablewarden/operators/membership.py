"""Who is asking: group membership of principals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.sources.store import cut_lineage

# Most literals put into one plan; beyond it a semi join with a table written at that moment takes over.  What a
# principal sees is settled when the plan is built, on either side of the limit.
LITERAL_LIMIT = 1000

ADMIN_GROUP = "admins"


@dataclass(frozen=True)
class Who:
    """A principal, settled before the plan is built.

    ``groups`` is None when the principal is in more than the literal limit;
    rules then join ``group_rows``, which were written when the principal was
    looked up, instead of listing names.
    """

    name: str
    groups: frozenset[str] | None
    is_admin: bool
    group_rows: DataFrame

    def is_member(self, group: str) -> bool:
        if self.groups is not None:
            return group in self.groups
        return not self.group_rows.where(F.col("group_name") == group).isEmpty()

    def is_any(self, names: list[str], everyone: str) -> bool:
        """Is the principal, or one of its groups, or everybody, listed in *names*?"""
        if everyone in names or self.name in names:
            return True
        if self.groups is not None:
            return not self.groups.isdisjoint(names)
        return not self.group_rows.where(F.col("group_name").isin(list(names))).isEmpty()


def groups_of(membership: DataFrame, principal: str) -> DataFrame:
    return membership.where(F.col("member_email") == principal).select("group_name").distinct()


def resolve_who(
    membership: DataFrame, principal: str, admin_group: str = ADMIN_GROUP, limit: int = LITERAL_LIMIT
) -> Who:
    """Look up one principal; one job that brings at most *limit* + 1 names to the driver."""
    rows = groups_of(membership, principal)
    found = [r[0] for r in rows.limit(limit + 1).collect()]
    if len(found) > limit:
        rows = cut_lineage(rows)
        is_admin = not rows.where(F.col("group_name") == admin_group).isEmpty()
        return Who(principal, None, is_admin, rows)
    return Who(principal, frozenset(found), admin_group in found, rows)


def nested_membership(membership: DataFrame, subgroups: DataFrame) -> DataFrame:
    """Membership through groups within groups: ``group_name, member_email``, each pair once.

    *subgroups* (``group_name, member_group``) says which group contains which, to
    any depth; cycles are allowed and make their groups equal.  The closure over
    groups grows from the pairs that the last round found new, one written table
    a round, and members are joined once at its end.  NULL names belong to nothing.
    All joins are by merging: a side that is small enough to be broadcast would
    go through the driver again in every round.
    """
    direct = subgroups.select("group_name", "member_group").where("group_name <> member_group").distinct()
    direct = cut_lineage(direct)
    known = fresh = direct
    while not fresh.isEmpty():
        below = direct.select(F.col("group_name").alias("member_group"), F.col("member_group").alias("__below"))
        longer = fresh.hint("merge").join(below.hint("merge"), "member_group")
        longer = longer.select("group_name", F.col("__below").alias("member_group")).where("group_name <> member_group").distinct()
        fresh = cut_lineage(longer.join(known.hint("merge"), ["group_name", "member_group"], "left_anti"))
        known = known.unionByName(fresh)
    own = membership.select("group_name", "member_email").where("group_name IS NOT NULL AND member_email IS NOT NULL")
    inherited = own.withColumnRenamed("group_name", "member_group").join(known.hint("merge"), "member_group").select("group_name", "member_email")
    return own.unionByName(inherited).distinct()


def is_member(membership: DataFrame, principals: DataFrame, group: str | Column) -> DataFrame:
    """Which of many *principals* are in *group* (one name, or a column of *principals*).

    Adds ``is_member``.  Names compare exactly; no row is lost or doubled.
    """
    wanted = F.lit(group) if isinstance(group, str) else group
    members = membership.select(
        F.col("group_name").alias("__group"), F.col("member_email").alias("__member")
    ).distinct()
    if isinstance(group, str):
        members = members.where(F.col("__group") == group)
    joined = principals.withColumn("__wanted", wanted).join(
        members, (F.col("principal") == F.col("__member")) & (F.col("__wanted") == F.col("__group")), "left"
    )
    return joined.withColumn("is_member", F.col("__member").isNotNull()).drop("__wanted", "__group", "__member")
