import datetime as dt

import pytest
from helpers import frame, policy, rows
from pyspark.sql import functions as F

from tablewarden.functions import masks as m
from tablewarden.operators import catalog, checks, matching
from tablewarden.operators.enforce import (
    AmbiguousColumnMatch,
    ConflictingMasks,
    MaskFunction,
    MissingColumn,
    SecurityState,
    UnclearMask,
    UnclearPolicy,
    UnknownFunction,
    apply_masks,
    secure,
)
from tablewarden.operators.membership import is_member, resolve_who
from tablewarden.operators.rowfilters import (
    EVERYONE,
    Scoping,
    binds,
    equals_rule,
    filter_by_group,
    filter_public_or_group,
    group_rule,
    predicate_rule,
)
from tablewarden.sources import generate, schemas
from tablewarden.streaming.secured import read_files, secure_stream, write_available

TABLE = ("cat", "sch", "people")
ON = "TABLE `cat`.`sch`.`people`"
UNITS = {"Retail": "bu_retail_group", "O2C": "bu_o2c_group"}
PEOPLE = [
    (1, "Retail", "ann@x.example", "+911234567890", 10.0),
    (2, "O2C", "bob@y.example", "+910000008408", 20.0),
    (3, "Retail", "no-at-sign", "12", 30.0),
    (4, None, None, None, None),
    (5, "Other", "a@b@c", "", 50.0),
]
MEMBERS = [("bu_retail_group", "r@x"), ("bu_o2c_group", "o@x"), ("admins", "boss@x"), ("BU_RETAIL_GROUP", "case@x")]


@pytest.fixture(scope="module")
def membership(spark):
    return generate.membership(spark, MEMBERS)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id long, unit string, email string, phone string, pay double").coalesce(1)


def ids(df):
    return sorted(r.id for r in df.collect())


def masked(people, column, mask):
    who = resolve_who(generate.membership(people.sparkSession, MEMBERS), "r@x")
    out = apply_masks(people, {column: "f"}, {"f": MaskFunction(mask)}, who)
    assert out.schema[column].dataType == people.schema[column].dataType
    assert out.columns == people.columns
    return [r[column] for r in out.orderBy("id").collect()]


@pytest.mark.parametrize(
    ("column", "mask", "shown"),
    [
        ("email", m.email_keep_domain(), ["a***@x.example", "b***@y.example", "REDACTED", None, "a***@b"]),
        ("email", m.email_fixed_domain(), ["a***@masked.com", "b***@masked.com", "n***@masked.com", None, "a***@masked.com"]),
        ("phone", m.keep_last(), ["******7890", "******8408", "******12", None, "******"]),
        ("phone", m.keep_last("XXXX-XXXX-"), ["XXXX-XXXX-7890", "XXXX-XXXX-8408", "XXXX-XXXX-12", None, "XXXX-XXXX-"]),
        ("phone", m.with_prefix("**-"), ["**-+911234567890", "**-+910000008408", "**-12", None, "**-"]),
        ("email", m.constant(), ["REDACTED"] * 5),
        ("pay", m.null_out(), [None] * 5),
    ],
)
def test_masks(people, column, mask, shown):
    assert masked(people, column, mask) == shown


def test_group_filter(people, membership):
    for principal, seen in [("r@x", [1, 3]), ("o@x", [2]), ("boss@x", [1, 2, 3, 4, 5]), ("case@x", []), ("nobody", [])]:
        who = resolve_who(membership, principal)
        assert ids(filter_by_group(people, "unit", UNITS, who)) == seen, principal


def test_group_filter_through_a_join_is_the_same(spark, people, membership):
    mapping = spark.createDataFrame(list(UNITS.items()), "value string, group_name string")
    for principal in ("r@x", "o@x", "boss@x", "nobody"):
        listed, joined = resolve_who(membership, principal), resolve_who(membership, principal, limit=0)
        a = ids(filter_by_group(people, "unit", mapping, listed))
        b = ids(filter_by_group(people, "unit", mapping, joined, limit=0))
        assert a == b == ids(filter_by_group(people, "unit", UNITS, joined))


def test_a_column_of_the_same_name_does_not_open_the_filter(spark, membership):
    """A data column called like the membership's must not be compared with itself."""
    data = spark.createDataFrame([(1, "Retail", "zzz"), (2, "O2C", "zzz")], "id long, unit string, group_name string")
    mapping = spark.createDataFrame(list(UNITS.items()), "value string, group_name string")
    who = resolve_who(membership, "r@x", limit=0)
    out = filter_by_group(data, "unit", mapping, who, limit=0)
    assert ids(out) == [1] and out.columns == data.columns


def test_public_or_group_and_constant_and_two_columns(people, membership):
    member, other = resolve_who(membership, "r@x"), resolve_who(membership, "o@x")
    assert ids(filter_public_or_group(people, "unit", ["O2C"], "bu_retail_group", member)) == [1, 2, 3, 4, 5]
    assert ids(filter_public_or_group(people, "unit", ["O2C"], "bu_retail_group", other)) == [2]
    assert ids(equals_rule("Other")(people, ["unit"], None)) == [5]
    either = predicate_rule(lambda unit, pay: (unit == "Retail") | (pay > 40))
    assert ids(either(people, ["unit", "pay"], member)) == [1, 3, 5]


def test_membership_of_many(spark, membership):
    asked = spark.createDataFrame([("r@x",), ("o@x",), ("r@x",)], "principal string")
    assert rows(is_member(membership, asked, "bu_retail_group"), "principal", "is_member") == [
        ("o@x", False), ("r@x", True), ("r@x", True),
    ]


@pytest.mark.parametrize("limit", [1000, 0])
def test_to_and_except(membership, limit):
    who = resolve_who(membership, "r@x", limit=limit)
    assert binds(Scoping([EVERYONE], []), who)
    assert not binds(Scoping([EVERYONE], ["r@x"]), who)
    assert not binds(Scoping([EVERYONE], ["bu_retail_group"]), who)
    assert binds(Scoping(["bu_retail_group"], ["bu_o2c_group"]), who)
    assert not binds(Scoping(["bu_o2c_group"], []), who)


def security(spark, membership, policies=(), tags=(), filters=(), masks=()):
    return SecurityState(
        membership=membership,
        functions={
            "f.unit": group_rule(UNITS),
            "f.east": equals_rule("Retail"),
            "f.email": MaskFunction(m.email_keep_domain(), admin_bypass=True),
            "f.redact": MaskFunction(m.constant()),
        },
        row_filters=frame(spark, [(*TABLE, fn, list(c), "") for fn, c in filters], schemas.ROW_FILTERS),
        masks=frame(spark, [(*TABLE, c, fn, "", 0) for c, fn in masks], schemas.MASKS),
        policies=frame(spark, policies, schemas.POLICIES),
        column_tags=frame(spark, [(*TABLE, c, k, v) for c, k, v in tags], schemas.COLUMN_TAGS),
    )


FILTER = policy(ON, "rf", "ROW_FILTER", "f.unit", "unit_key", "unit")
MASK = policy("CATALOG `cat`", "mk", "COLUMN_MASK", "f.email", "mail_key", "email")
TAGS = [("unit", "unit_key", None), ("email", "mail_key", None)]


def test_old_rules_policies_and_both_give_the_same(spark, people, membership):
    old = security(spark, membership, filters=[("f.unit", ["unit"])], masks=[("email", "f.email")])
    new = security(spark, membership, [FILTER, MASK], TAGS)
    both = security(spark, membership, [FILTER, MASK], TAGS, [("f.unit", ["unit"])], [("email", "f.email")])
    for principal in ("r@x", "o@x", "boss@x", "nobody"):
        seen = [secure(people, TABLE, s, principal) for s in (old, new, both)]
        assert checks.parity_difference(seen[0], seen[1]).isEmpty()
        assert checks.parity_difference(seen[0], seen[2]).isEmpty()
        assert set(ids(seen[0])) <= set(ids(people))
        assert seen[0].schema == people.schema
    assert [r.email for r in secure(people, TABLE, new, "boss@x").orderBy("id").collect()] == [p[2] for p in PEOPLE]


def test_administrator_plan_has_no_mask(spark, people, membership):
    state = security(spark, membership, [FILTER, MASK], TAGS)
    plan = secure(people, TABLE, state, "boss@x")._jdf.queryExecution().optimizedPlan().toString()
    assert "***@" not in plan


def test_policies_elsewhere_do_not_apply(spark, people, membership):
    elsewhere = [
        policy("TABLE `cat`.`sch`.`other`", "rf", "ROW_FILTER", "f.unit", "unit_key", "unit"),
        policy("CATALOG `cat2`", "mk", "COLUMN_MASK", "f.redact", "mail_key", "email"),
        policy(ON, "untagged", "ROW_FILTER", "f.unit", "nowhere", "unit"),
        policy(ON, "valued", "COLUMN_MASK", "f.redact", "mail_key", "email", value="high"),
    ]
    seen = secure(people, TABLE, security(spark, membership, elsewhere, TAGS), "nobody")
    assert checks.parity_difference(people, seen).isEmpty()


def test_exempt_and_targeted_principals(spark, people, membership):
    exempt = (*FILTER[:7], [EVERYONE], ["nobody", "bu_o2c_group"], "")
    targeted = (*FILTER[:7], ["bu_retail_group"], [], "")
    for p, seen in [("nobody", 5), ("o@x", 5), ("r@x", 2)]:
        assert secure(people, TABLE, security(spark, membership, [exempt], TAGS), p).count() == seen
    for p, seen in [("nobody", 5), ("o@x", 5), ("r@x", 2)]:
        assert secure(people, TABLE, security(spark, membership, [targeted], TAGS), p).count() == seen


def test_ambiguous_filter_fails_the_read_but_masks_may_match_many(spark, people, membership):
    tags = [*TAGS, ("phone", "unit_key", None), ("phone", "mail_key", None)]
    with pytest.raises(AmbiguousColumnMatch):
        secure(people, TABLE, security(spark, membership, [FILTER], tags), "r@x")
    seen = secure(people, TABLE, security(spark, membership, [MASK], tags), "nobody").where("id = 1").first()
    assert (seen.email, seen.phone) == ("a***@x.example", "REDACTED")


def test_two_masks_on_a_column_and_unknown_functions(spark, people, membership):
    with pytest.raises(ConflictingMasks):
        secure(people, TABLE, security(spark, membership, [MASK], TAGS, masks=[("email", "f.redact")]), "r@x")
    with pytest.raises(UnknownFunction):
        secure(people, TABLE, security(spark, membership, masks=[("email", "f.none")]), "r@x")


def test_column_names_match_without_regard_to_case(spark, people, membership):
    state = security(spark, membership, filters=[("f.unit", ["UNIT"])], masks=[("EMAIL", "f.redact"), ("email", "f.redact")])
    seen = secure(people.withColumnRenamed("email", "eMail"), TABLE, state, "r@x")
    assert ids(seen) == [1, 3] and {r.eMail for r in seen.collect()} == {"REDACTED"}


def test_filters_read_raw_values(spark, people, membership):
    """The filter column may be masked too: the filter sees the value behind the mask."""
    state = security(spark, membership, filters=[("f.unit", ["unit"])], masks=[("unit", "f.redact")])
    seen = secure(people, TABLE, state, "r@x")
    assert ids(seen) == [1, 3]
    assert {r.unit for r in seen.collect()} == {"REDACTED"}
    assert seen.where("unit = 'Retail'").isEmpty()


def test_visible_counts_with_a_hot_unit(spark):
    """A third and more of all rows in one unit: one row per unit meets the members."""
    data = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 50)).alias("unit"))
    mapping = spark.createDataFrame([("hot", "g_hot"), ("u3", "g_3"), ("u6", "g_3")], "value string, group_name string")
    members = generate.membership(spark, [("g_hot", "a"), ("g_3", "b"), ("g_hot", "c"), ("g_3", "c"), ("admins", "z"), ("g_hot", "z")])
    got = checks.visible_counts(data, "unit", mapping, members)
    assert rows(got.where("principal <> 'z'"), "principal", "unit", "n_rows") == [
        ("a", "hot", 20_000), ("b", "u3", 200), ("b", "u6", 200), ("c", "hot", 20_000), ("c", "u3", 200), ("c", "u6", 200),
    ]
    assert got.where("principal = 'z'").agg(F.sum("n_rows")).first()[0] == 30_000
    verdict = {r.principal: r.isolated for r in checks.isolation_verdict(got, members).collect()}
    assert verdict == {"a": False, "b": False, "c": False}


def test_samples_of_many_equal_the_sample_of_one(spark, people, membership):
    mapping = spark.createDataFrame(list(UNITS.items()), "value string, group_name string")
    many = checks.sample_per_principal(people, "unit", "id", mapping, membership, n=2)
    for principal in ("r@x", "o@x", "boss@x"):
        one = checks.sample(filter_by_group(people, "unit", mapping, resolve_who(membership, principal)), "id", 2)
        assert rows(many.where(F.col("principal") == principal), "id") == rows(one, "id")


def test_isolated_principals(spark, people, membership):
    mapping = spark.createDataFrame(list(UNITS.items()), "value string, group_name string")
    counts = checks.visible_counts(people, "unit", mapping, membership)
    assert {r.principal: r.isolated for r in checks.isolation_verdict(counts, membership).collect()} == {"r@x": True, "o@x": True}
    expected = spark.createDataFrame([("r@x", "Retail", 2), ("o@x", "O2C", 2)], "principal string, unit string, n_rows long")
    wrong = checks.unexpected_visibility(counts.where("principal <> 'boss@x'"), expected)
    assert rows(wrong, "principal", "n_seen", "n_expected") == [("o@x", 1, 2)]
    a, b = (filter_by_group(people, "unit", UNITS, resolve_who(membership, p)) for p in ("r@x", "o@x"))
    assert checks.overlap(a, b).isEmpty()


def test_parity_counts_duplicates(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert rows(checks.parity_difference(a, b), "k", "v", "n_extra") == [(1, None, -1), (3, "y", 1)]


def test_demo_domain(spark):
    """Twenty customers, thirty orders and payments: each unit sees its half, masked."""
    data = generate.DemoData("cat-a")
    customers = data.customers(generate.ids(spark, 20))
    orders = data.orders(generate.ids(spark, 30))
    payments = data.payments(orders)
    members = generate.membership(spark, [(g, f"{u}@x") for u, g in generate.UNITS.items()])
    who = resolve_who(members, "Retail@x")
    fns = {"email": MaskFunction(m.email_keep_domain(), True), "last4": MaskFunction(m.keep_last(), True), "all": MaskFunction(m.constant(), True)}
    seen = [filter_by_group(t, "business_unit", generate.UNITS, who) for t in (customers, orders, payments)]
    assert [t.count() for t in seen] == [10, 15, 15]
    shown = apply_masks(seen[0], {"email": "email", "phone_number": "last4", "pan_number": "all", "aadhaar_number": "all", "address": "all"}, fns, who)
    for r, raw in zip(checks.sample(shown, "customer_id").collect(), checks.sample(seen[0], "customer_id").collect(), strict=True):
        assert r.email == f"{raw.email[0]}***@shop.example" and r.phone_number == "******" + raw.phone_number[-4:]
        assert (r.pan_number, r.aadhaar_number, r.address) == ("REDACTED",) * 3
        assert r.full_name == raw.full_name
    again = generate.DemoData("cat-a").orders(generate.ids(spark, 30))
    assert checks.parity_difference(orders, again).isEmpty()
    assert not checks.parity_difference(orders, generate.DemoData("cat-b").orders(generate.ids(spark, 30))).isEmpty()
    products = data.products(generate.ids(spark, 16))
    assert rows(products.groupBy("business_unit").agg(F.max("product_id").alias("last")), "business_unit", "last") == [("O2C", 16), ("Retail", 8)]
    joined = orders.join(customers, "customer_id").join(products, "product_id").join(data.sales_reps(generate.ids(spark, 10)), "rep_id")
    assert joined.where(orders["business_unit"] != customers["business_unit"]).isEmpty()
    assert joined.where(orders["business_unit"] != products["business_unit"]).isEmpty()
    assert joined.where(orders["order_amount"] != orders["quantity"] * products["unit_price"]).isEmpty()
    assert joined.where(~F.endswith(orders["shipping_address"], customers["state"])).isEmpty()
    assert joined.count() == 30
    assert orders.schema["order_amount"].dataType.simpleString() == "decimal(14,2)"
    assert orders.agg(F.min("order_date")).first()[0] >= dt.date(2025, 1, 1)


def test_stream_equals_batch(spark, people, membership, tmp_path):
    source = f"{tmp_path}/in"
    people.write.parquet(source)
    state = security(spark, membership, [FILTER, MASK], TAGS)
    stream = secure_stream(read_files(spark, source, people.schema), TABLE, state, "r@x")
    args = (f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    write_available(stream, *args).awaitTermination()
    got = spark.read.schema(people.schema).parquet(args[0])
    assert checks.parity_difference(secure(people, TABLE, state, "r@x"), got).isEmpty()
    # New files are taken up, old ones not again.
    people.write.mode("append").parquet(source)
    write_available(stream, *args).awaitTermination()
    assert spark.read.schema(people.schema).parquet(args[0]).count() == 4


def test_stream_through_a_join(spark, people, membership, tmp_path):
    """A principal in more groups than become literals: stream-static semi join."""
    people.write.parquet(f"{tmp_path}/in")
    mapping = spark.createDataFrame(list(UNITS.items()), "value string, group_name string")
    stream = read_files(spark, f"{tmp_path}/in", people.schema)
    seen = filter_by_group(stream, "unit", mapping, resolve_who(membership, "r@x", limit=0), limit=0)
    write_available(seen, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert ids(spark.read.schema(people.schema).parquet(f"{tmp_path}/out")) == [1, 3]


# -- nothing is left unprotected unnoticed ---------------------------------------------------------------------


def test_the_target_alias_is_masked_not_the_first_one(spark, people, membership):
    match = [("unit_key", None, "mc_arg", None), ("mail_key", None, "mc_email", None)]
    row = (ON, "two", "COLUMN_MASK", "f.redact", match, ["mc_arg"], "mc_email", [EVERYONE], [], "")
    seen = secure(people, TABLE, security(spark, membership, [row], TAGS), "r@x").where("id = 1").first()
    assert (seen.unit, seen.email) == ("Retail", "REDACTED")
    for target in (None, "mc_other"):
        with pytest.raises(UnclearMask):
            secure(people, TABLE, security(spark, membership, [(*row[:6], target, *row[7:])], TAGS), "r@x")


def test_policies_without_tags_are_an_error(spark, people, membership):
    state = SecurityState(membership, {"f.redact": MaskFunction(m.constant())}, policies=frame(spark, [MASK], schemas.POLICIES))
    with pytest.raises(ValueError, match="column_tags"):
        secure(people, TABLE, state, "r@x")


def test_a_masked_column_that_is_missing_is_an_error_unless_pruned(spark, people, membership):
    state = security(spark, membership, masks=[("email", "f.redact")])
    with pytest.raises(MissingColumn):
        secure(people.withColumnRenamed("email", "contact"), TABLE, state, "r@x")
    assert secure(people.drop("email"), TABLE, state, "r@x", pruned=True).count() == 5


def test_groups_are_settled_when_the_principal_is_looked_up(spark, people, tmp_path):
    """On either side of the limit, a membership that changes afterwards changes nothing."""
    mapping = spark.createDataFrame(list(UNITS.items()), "value string, group_name string")
    for limit in (1000, 0):
        path = f"{tmp_path}/members{limit}"
        generate.membership(spark, MEMBERS).write.parquet(path)
        who = resolve_who(spark.read.parquet(path), "r@x", limit=limit)
        frames = [filter_by_group(people, "unit", of, who, limit=limit) for of in (mapping, UNITS)]
        generate.membership(spark, [("bu_o2c_group", "r@x")]).write.mode("overwrite").parquet(path)
        spark.catalog.refreshByPath(path)
        assert [ids(f) for f in frames] == [[1, 3], [1, 3]]


def test_administrators_are_not_multiplied_by_units(people, membership):
    mapping = people.sparkSession.createDataFrame(list(UNITS.items()), "value string, group_name string")
    counts = checks.visible_counts(people, "unit", mapping, membership)
    summed = counts.groupBy("principal").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_units"))
    totals = checks.visible_totals(people, "unit", mapping, membership)
    assert rows(totals, "principal", "n_rows", "n_units") == rows(summed, "principal", "n_rows", "n_units")


MASK_MAIL = {"gov.m": MaskFunction(lambda c, t: F.lit("*"))}


def listed_state(spark, membership, match, kind="TABLE", on="cat.sch.people", tags=(("email", "k", None), ("email", "k2", None)), **lines):
    """One mask policy as its description lists it."""
    told = {
        "Name": "p", "Policy Type": "COLUMN_MASK", "On Securable Type": kind, "On Securable": on, "  Function Name": "gov.m", "  On Column": "mc",
        "To Principals": "account users", "Match Columns": match,
    } | lines
    rows_ = [("p", n, v) for n, v in told.items()]
    return SecurityState(
        membership, MASK_MAIL, policies=catalog.described_policies(spark.createDataFrame(rows_, "policy_id string, name string, value string")),
        column_tags=frame(spark, [(*TABLE, *t) for t in tags], schemas.COLUMN_TAGS),
    )


@pytest.mark.parametrize(
    ("match", "masked", "kind", "on"),
    [
        ('has_tag("k") AS mc', {"email"}, "TABLE", "cat.sch.people"),
        ("(has_tag('k')) AS mc", {"email"}, "CATALOG", "cat"),
        ("has_tag('k') mc", {"email"}, "SCHEMA", "`cat`.`sch`"),
        ("has_tag('k') AND has_tag('k2') AS mc", {"email"}, "SCHEMA", "cat.sch"),
        ("has_tag('k') AND has_tag('k3') AS mc", set(), "TABLE", "cat.sch.people"),
        ("NOT has_tag('zz') AS mc", {"unit", "email", "phone"}, "TABLE", "cat.sch.people"),
        ("NOT has_tag('k') AND NOT has_tag('shown') AS mc", {"unit", "phone"}, "CATALOG", "cat"),
        ("has_tag('none') OR has_tag_value('k', 'x') AS mc", set(), "SCHEMA", "cat.sch"),
    ],
)
def test_every_condition_is_evaluated(spark, membership, people, match, masked, kind, on):
    text = people.drop("id", "pay")
    state_ = listed_state(spark, membership, match, kind, on)
    seen = secure(text, TABLE, state_, "r@x").first()
    assert {c for c in text.columns if seen[c] == "*"} == masked


@pytest.mark.parametrize(
    "changes",
    [
        {"match": None}, {"match": "has_tag('k')"}, {"match": "regexp_like(column_name, 'e') AS mc"}, {"match": "has_tag('k') AS mc", "kind": "METASTORE", "on": "m"},
        {"match": "has_tag('k') AS mc", "on": "sch.people"}, {"match": "has_tag('k') AS mc", "  Function Name": None}, {"match": "has_tag('k') AS mc", "When Condition": "x"},
        {"match": "has_tag('k') AS mc", "Policy Type": "ROW_SAMPLE"}, {"match": "has_tag('k') AS mc", "To Principals": None},
    ],
)
def test_a_policy_that_is_not_understood_stops_the_read(spark, membership, people, changes):
    with pytest.raises(UnclearPolicy):
        secure(people, TABLE, listed_state(spark, membership, **changes), "r@x")


def test_unclear_policies_elsewhere_or_for_others_do_not_matter(spark, membership, people):
    other = listed_state(spark, membership, "what", on="cat.sch.others")
    assert secure(people, TABLE, other, "r@x").count() == 5
    others = listed_state(spark, membership, "what", **{"To Principals": "bu_o2c_group"})
    assert secure(people, TABLE, others, "r@x").count() == 5
    with pytest.raises(UnclearPolicy):
        secure(people, TABLE, others, "o@x")


def test_policies_by_hand_fail_closed(spark, membership, people):
    for p in [
        (ON, "p", "COLUMN_MASK", "gov.m", [], [], "mc", ["account users"], [], ""),
        (ON, "p", "COLUMN_MASK", "gov.m", [(None, None, "mc", None)], [], "mc", ["account users"], [], ""),
        ("VOLUME `cat`.`sch`.`people`", "p", "COLUMN_MASK", "gov.m", [("k", None, "mc", None)], [], "mc", ["account users"], [], ""),
        ("TABLE cat.sch.people", "p", "COLUMN_MASK", "gov.m", [("k", None, "mc", None)], [], "mc", ["account users"], [], ""),
    ]:
        st = SecurityState(membership, MASK_MAIL, policies=frame(spark, [p], schemas.POLICIES), column_tags=frame(spark, [(*TABLE, "email", "k", None)], schemas.COLUMN_TAGS))
        with pytest.raises(UnclearPolicy):
            secure(people, TABLE, st, "r@x")


def test_conditions_over_many_tables(spark):
    """Frames of tables: what holds of untagged columns needs all columns by name."""
    lines = [("p", n, v) for n, v in {"Name": "p", "Policy Type": "COLUMN_MASK", "On Securable Type": "SCHEMA", "On Securable": "c.s", "  Function Name": "f",
             "  On Column": "mc", "To Principals": "account users", "Match Columns": "NOT has_tag('open') AS mc"}.items()]
    policies = catalog.described_policies(spark.createDataFrame(lines, "policy_id string, name string, value string"))
    tags = frame(spark, [("c", "s", "t", "a", "open", None), ("c", "s", "t", "b", "k", None), ("c", "z", "t", "b", "k", None)], schemas.COLUMN_TAGS)
    columns = spark.createDataFrame([("c", "s", "t", x) for x in "abd"] + [("c", "z", "t", "b")], "catalog string, schema string, `table` string, column string")
    found = matching.resolve_match_columns(policies, tags, columns)
    assert rows(found, "schema", "table", "column", "tag_key") == [("s", "t", "b", None), ("s", "t", "d", None)]
    assert rows(matching.policies_in_force(found), "schema", "table", "n_columns") == [("s", "t", 2)]
    with pytest.raises(Exception, match="name all columns"):
        matching.resolve_match_columns(policies, tags).collect()
