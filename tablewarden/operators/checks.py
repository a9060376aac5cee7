"""Checks on protected data: parity, visible counts, samples, isolation, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.operators.membership import ADMIN_GROUP

# Buckets of a parity check: what each map task sends, and all that is broadcast.
PARITY_BUCKETS = 4096
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def parity_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one frame holds more often than the other; empty if they agree.

    ``n_extra`` is positive for rows only in *after*.  One shuffle of signed,
    pre-counted rows covers both directions.
    """
    columns = before.columns
    signed = before.select(*columns, F.lit(-1).alias("__sign")).unionAll(
        after.select(*columns, F.lit(1).alias("__sign"))
    )
    return signed.groupBy(*columns).agg(F.sum("__sign").alias("n_extra")).where(F.col("n_extra") != 0)


def _digest(hashed: Column, sign: Column | None = None) -> list[Column]:
    """Order-free sums of 64-bit hashes, in pieces of 16 bits that stay exact over 2^47 rows."""
    pieces = [F.shiftrightunsigned(hashed, at).bitwiseAND(0xFFFF) for at in (0, 16, 32, 48)]
    return [F.sum(p if sign is None else sign * p).alias(f"__d{i}") for i, p in enumerate(pieces)]


def _row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row.

    Spark's hash passes over NULLs, so that the places of NULLs are hashed too:
    of nested columns within their JSON text.
    """
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if "map<" not in f.dataType.simpleString():
            parts.append(c)
        if isinstance(f.dataType, _NESTED):
            parts.append(F.to_json(F.struct(c), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}))
        else:
            parts.append(c.isNull())
    return F.xxhash64(*parts)


def parity_by_buckets(before: DataFrame, after: DataFrame, buckets: int = PARITY_BUCKETS) -> DataFrame:
    """The result of :func:`parity_difference`, for frames that should be equal or nearly so.

    Rows are dealt into *buckets* by their hash, and each bucket's rows are summed
    up as a count and an order-free digest: equal frames shuffle one row per bucket
    and map task.  Only rows of buckets whose sums differ are shuffled whole.  The
    frames are read twice; at most *buckets* numbers are broadcast.  Two buckets
    of different rows agree in their sums by chance once in 2^64.
    """
    columns = before.columns
    names = [f"`{c}`" for c in columns]

    def dealt(df: DataFrame) -> DataFrame:
        rows = df.select(*names)
        return rows.withColumn("__hash", _row_hash(rows)).withColumn("__bucket", F.pmod("__hash", F.lit(buckets)))

    old, new = dealt(before), dealt(after)
    signed = old.select("__hash", "__bucket", F.lit(-1).alias("__sign")).unionAll(new.select("__hash", "__bucket", F.lit(1).alias("__sign")))
    sums = signed.groupBy("__bucket").agg(F.sum("__sign").alias("__n"), *_digest(F.col("__hash"), F.col("__sign")))
    differ = sums.where(" OR ".join(f"{c} <> 0" for c in ("__n", "__d0", "__d1", "__d2", "__d3"))).select("__bucket")

    def suspect(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(differ), "__bucket", "left_semi").select(*names)

    return parity_difference(suspect(old), suspect(new))


def hand_out(
    units: DataFrame,
    unit: str,
    value_to_group: DataFrame,
    membership: DataFrame,
    admin_group: str = ADMIN_GROUP,
    key: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of *units*, each once per principal that may see its unit (adds ``principal``).

    *units* should be small per unit (counts, first rows): it is what gets
    multiplied.  Administrators see every unit, NULL and unmapped ones included.
    *key* tells the rows of *units* apart, by default the unit does.
    """
    mapped = units.join(value_to_group, units[unit] == value_to_group["value"], "left")
    groups = F.filter(F.array("group_name", F.lit(admin_group)), lambda g: g.isNotNull())
    return (
        mapped.select(*units.columns, F.explode(groups).alias("group_name"))
        .join(membership.select(F.col("member_email").alias("principal"), "group_name"), "group_name")
        .select("principal", *units.columns)
        .dropDuplicates(["principal", *(key or (unit,))])
    )


def visible_counts(
    df: DataFrame, unit: str, value_to_group: DataFrame, membership: DataFrame, admin_group: str = ADMIN_GROUP
) -> DataFrame:
    """Rows of each unit that each principal sees (``principal, unit, n_rows``).

    The data is counted per unit first, with map-side partial sums, so that
    only one row per unit meets the memberships, however large a unit is.
    """
    counts = df.groupBy(F.col(unit).alias("unit")).agg(F.count("*").alias("n_rows"))
    return hand_out(counts, "unit", value_to_group, membership, admin_group)


def _without_admins(membership: DataFrame, admin_group: str) -> tuple[DataFrame, DataFrame]:
    """Administrators, and the memberships of everybody else."""
    admins = membership.where(F.col("group_name") == admin_group).select(F.col("member_email").alias("principal")).distinct()
    return admins, membership.join(admins, membership["member_email"] == admins["principal"], "left_anti")


def visible_totals(
    df: DataFrame, unit: str, value_to_group: DataFrame, membership: DataFrame, admin_group: str = ADMIN_GROUP
) -> DataFrame:
    """Rows and units that each principal sees (``principal, n_rows, n_units``).

    Administrators see everything: one global sum serves all of them, so that
    they are never multiplied by units.
    """
    counts = df.groupBy(F.col(unit).alias("unit")).agg(F.count("*").alias("n_rows"))
    admins, members = _without_admins(membership, admin_group)
    totals = (F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_units"))
    ordinary = hand_out(counts, "unit", value_to_group, members, admin_group).groupBy("principal").agg(*totals)
    everything = counts.agg(F.struct(*totals).alias("t")).scalar()
    return ordinary.unionByName(admins.select("principal", everything.alias("t")).select("principal", "t.*"))


def sample(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """First *n* rows by key of a frame already secured for one principal."""
    return df.orderBy(key).limit(n)


def sample_per_principal(
    df: DataFrame,
    unit: str,
    key: str,
    value_to_group: DataFrame,
    membership: DataFrame,
    admin_group: str = ADMIN_GROUP,
    n: int = 3,
    for_admins: DataFrame | None = None,
) -> DataFrame:
    """First *n* rows by key that each principal sees.

    The first rows of a principal are among the first rows of its units: each
    unit is cut to *n* rows first (Spark limits every partition before the
    shuffle), and only those are handed to principals.  Administrators share one
    global first *n*, of *for_admins* where masks let them see more than *df*.
    """
    per_unit = Window.partitionBy(unit).orderBy(key)
    heads = df.withColumn("__rn", F.row_number().over(per_unit)).where(F.col("__rn") <= n)
    per_principal = Window.partitionBy("principal").orderBy(key)
    admins, members = _without_admins(membership, admin_group)
    ordinary = (
        hand_out(heads, unit, value_to_group, members, admin_group, (unit, "__rn"))
        .withColumn("position", F.row_number().over(per_principal))
        .where(F.col("position") <= n)
        .drop("__rn")
    )
    every = df if for_admins is None else for_admins.select(df.columns)
    first = F.sort_array(F.collect_list(F.struct(F.col(key).alias("__key"), F.struct(*df.columns).alias("row"))))
    first = every.orderBy(key).limit(n).agg(first.alias("rows")).scalar()
    shown = admins.select("principal", F.posexplode(first).alias("at", "shown"))
    return ordinary.unionByName(shown.select("principal", "shown.row.*", (F.col("at") + 1).alias("position")))


def principal_classes(
    units: DataFrame, value_to_group: DataFrame, membership: DataFrame, admin_group: str = ADMIN_GROUP
) -> DataFrame:
    """Principals that see the same of *units* (a column ``unit``), as ``principal, class_id, sees_all``.

    A class is named by its least principal.  Nobody's units are gathered: a
    principal is known by a count and an order-free digest of the units it sees,
    which two different sets share by chance once in 2^64.  Administrators are one
    class, however many units there are; who sees nothing is in none.
    """
    admins, members = _without_admins(membership, admin_group)
    mapped = value_to_group.join(units.select("unit").distinct(), F.col("value") == F.col("unit"), "left_semi")
    hashed = F.xxhash64(F.lit("unit"), "value")
    seen = (
        members.join(mapped, "group_name")
        .select(F.col("member_email").alias("principal"), "value")
        .distinct()
        .groupBy("principal")
        .agg(F.count("*").alias("n_units"), *_digest(hashed))
        .unionByName(admins, allowMissingColumns=True)
    )
    same = ["n_units", "__d0", "__d1", "__d2", "__d3"]
    heads = seen.groupBy(*[F.col(c).alias(f"{c}_of") for c in same]).agg(F.min("principal").alias("class_id"))
    both = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in same]
    return seen.join(heads, both).select("principal", "class_id", F.col("n_units").isNull().alias("sees_all"))


def class_counts(
    df: DataFrame, unit: str, value_to_group: DataFrame, membership: DataFrame, classes: DataFrame, admin_group: str = ADMIN_GROUP
) -> DataFrame:
    """Rows of each unit that each class of principals sees (``class_id, unit, n_rows``).

    With :func:`principal_classes` this holds all of :func:`visible_counts`: like-minded
    principals, administrators too, cost the rows of one.
    """
    heads = classes.where(F.col("principal") == F.col("class_id")).select(F.col("class_id").alias("member_email"))
    ours = membership.join(heads, "member_email", "left_semi")
    return visible_counts(df, unit, value_to_group, ours, admin_group).withColumnRenamed("principal", "class_id")


def class_isolation(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class (``class_id, n_principals, n_units, n_shared_units, isolated``), administrators left out.

    *counts* are those of :func:`class_counts`.  A unit is shared where its
    classes hold more than one principal together, so a class of two shares all it sees.
    """
    sizes = classes.where(~F.col("sees_all")).groupBy("class_id").agg(F.count("*").alias("n_principals"))
    seen = counts.join(sizes, "class_id")
    viewers = seen.groupBy("unit").agg(F.sum("n_principals").alias("n_viewers"))
    return (
        seen.join(viewers, seen["unit"].eqNullSafe(viewers["unit"]))
        .groupBy("class_id", "n_principals")
        .agg(F.count("*").alias("n_units"), F.count_if(F.col("n_viewers") > 1).alias("n_shared_units"))
        .withColumn("isolated", F.col("n_shared_units") == 0)
    )


def overlap(visible_a: DataFrame, visible_b: DataFrame) -> DataFrame:
    """Rows that both principals see; empty when they are isolated from each other."""
    return visible_a.intersect(visible_b)


def isolation_verdict(counts: DataFrame, membership: DataFrame, admin_group: str = ADMIN_GROUP) -> DataFrame:
    """Per principal: units it shares with another one, administrators left out.

    Sharing is a count of viewers per unit, so no two principals are paired.
    """
    admins = membership.where(F.col("group_name") == admin_group).select(F.col("member_email").alias("principal"))
    ordinary = counts.join(admins.distinct(), "principal", "left_anti")
    viewers = ordinary.groupBy("unit").agg(F.count("*").alias("n_viewers"))
    return (
        ordinary.join(viewers, ordinary["unit"].eqNullSafe(viewers["unit"]))
        .groupBy("principal")
        .agg(F.count("*").alias("n_units"), F.count_if(F.col("n_viewers") > 1).alias("n_shared_units"))
        .withColumn("isolated", F.col("n_shared_units") == 0)
    )


def unexpected_visibility(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Where seen and expected counts (``principal, unit, n_rows``) differ; empty if all is well."""
    seen = counts.select("principal", "unit", F.col("n_rows").alias("n_seen"))
    want = expected.select("principal", "unit", F.col("n_rows").alias("n_expected"))
    return seen.join(want, ["principal", "unit"], "full_outer").where(~F.col("n_seen").eqNullSafe(F.col("n_expected")))


def mask_check(df: DataFrame, expected: dict[str, Column | object]) -> DataFrame:
    """One row: does every visible value of each column equal what its mask should show?"""
    want = {c: (v if isinstance(v, Column) else F.lit(v)) for c, v in expected.items()}
    return df.agg(
        F.count("*").alias("n_rows"),
        *[F.coalesce(F.bool_and(F.col(c).eqNullSafe(v)), F.lit(True)).alias(c) for c, v in want.items()],
    )
