"""Row filters, masks and policy application over the test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import masks as m
from tablewarden.functions.names import KEY
from tablewarden.operators import checks, matching
from tablewarden.operators.catalog import described_policies
from tablewarden.operators.enforce import MaskFunction, SecurityState, apply_masks, secure
from tablewarden.operators.membership import Who, is_member, nested_membership, resolve_who
from tablewarden.operators.rowfilters import (
    equals_rule,
    filter_by_group,
    filter_public_or_group,
    group_rule,
    policies_binding,
    predicate_rule,
    public_or_group_rule,
)
from tablewarden.plans.options import RunOptions
from tablewarden.plans.run import GovernanceState, run
from tablewarden.plans.stored import Changes, StateStore
from tablewarden.sources import schemas
from tablewarden.sources.deltas import ChangeLog, KeyedTable, add_signed, totals_ddl
from tablewarden.sources.store import refresh_snapshot, shared_folder
from tablewarden.streaming.secured import read_files, secure_stream, write_available
from tablewarden.streaming.versioned import write_by_version
from workload.ctes import KEY_OUT
from workload.frames import Frames
from workload.registry import query

# A member of its segment's group and of BUILDING's; one administrator; one in no unit's group.
MEMBER, ADMIN, OUTSIDER = "Customer#000000020", "Customer#000000007", "Customer#000000001"

ALLOWED_UNITS = f"""(SELECT substr(group_name, 4) FROM membership WHERE member_email = '{MEMBER}' AND group_name LIKE 'bu\\_%' ESCAPE '\\')"""
MASKED_EMAIL = "CASE WHEN email IS NULL THEN NULL WHEN strpos(email, '@') = 0 THEN 'REDACTED' ELSE substr(email, 1, 1) || '***@' || split_part(email, '@', 2) END"
MASKED_PHONE = "'******' || right(phone, 4)"


@query("E-01_membership", """
SELECT c.c_name AS principal, 'bu_' || c.c_mktsegment AS asked_group, m.member_email IS NOT NULL AS is_member
FROM customer c LEFT JOIN membership m ON m.member_email = c.c_name AND m.group_name = 'bu_' || c.c_mktsegment""")
def membership(f: Frames) -> DataFrame:
    principals = f.read("customer").select(
        F.col("c_name").alias("principal"), F.concat(F.lit("bu_"), "c_mktsegment").alias("asked_group")
    )
    return is_member(f.membership, principals, F.col("asked_group"))


@query("E-01_one_group", """
SELECT c.c_name AS principal, m.member_email IS NOT NULL AS is_member
FROM customer c LEFT JOIN membership m ON m.member_email = c.c_name AND m.group_name = 'bu_BUILDING'""")
def one_group(f: Frames) -> DataFrame:
    return is_member(f.membership, f.read("customer").select(F.col("c_name").alias("principal")), "bu_BUILDING")


@query("E-01_nested_groups", """
SELECT group_name, member_email FROM (
  WITH RECURSIVE below(top, node) AS (
    SELECT s_suppkey, s_suppkey FROM supplier
    UNION SELECT b.top, s.s_suppkey FROM below b JOIN supplier s ON s.s_suppkey // 2 = b.node OR (b.node % 7 = 0 AND b.node // 2 = s.s_suppkey))
  SELECT DISTINCT 'team_' || top AS group_name, c_name AS member_email FROM below JOIN (SELECT c_name, c_custkey % (SELECT max(s_suppkey) FROM supplier) AS node FROM customer) USING (node))""")
def nested_groups(f: Frames) -> DataFrame:
    """Teams of a tree over suppliers, some of which contain the team that contains them: cycles."""
    key = F.col("s_suppkey")
    team = lambda k: F.concat(F.lit("team_"), k.cast("long").cast("string"))
    suppliers = f.read("supplier").select(key)
    teams = suppliers.select(team(key).alias("team"))
    pairs = F.array(
        F.struct(team(F.floor(key / 2)).alias("group_name"), team(key).alias("member_group")),
        F.when(key % 7 == 0, F.struct(team(key).alias("group_name"), team(F.floor(key / 2)).alias("member_group"))),
    )
    inside = suppliers.select(F.inline(F.filter(pairs, lambda p: p.isNotNull())))
    for name in ("group_name", "member_group"):
        inside = inside.join(teams.withColumnRenamed("team", name).hint("merge"), name, "left_semi")
    last = suppliers.agg(F.max(key)).scalar()
    members = f.read("customer").select(team(F.col("c_custkey") % last).alias("group_name"), F.col("c_name").alias("member_email"))
    members = members.join(teams.withColumnRenamed("team", "group_name").hint("merge"), "group_name", "left_semi")
    return nested_membership(members, inside)


@query("E-02_group_filter", f"SELECT c_custkey, business_unit FROM sec_customers WHERE business_unit IN {ALLOWED_UNITS}")
def group_filter(f: Frames) -> DataFrame:
    rows = f.customers.select("c_custkey", "business_unit")
    return filter_by_group(rows, "business_unit", f.unit_groups, resolve_who(f.membership, MEMBER))


@query("E-02_group_filter_by_join", f"SELECT c_custkey, business_unit FROM sec_customers WHERE business_unit IN {ALLOWED_UNITS}")
def group_filter_by_join(f: Frames) -> DataFrame:
    rows = f.customers.select("c_custkey", "business_unit")
    return filter_by_group(rows, "business_unit", f.unit_groups, resolve_who(f.membership, MEMBER, limit=0), limit=0)


@query("E-02_admin_sees_all", "SELECT business_unit, count(*) AS n_rows FROM sec_customers GROUP BY 1")
def admin_filter(f: Frames) -> DataFrame:
    rows = filter_by_group(f.customers, "business_unit", f.unit_groups, resolve_who(f.membership, ADMIN))
    return rows.groupBy("business_unit").agg(F.count("*").alias("n_rows"))


@query("E-03_public_or_group", """
SELECT 'member' AS seen_by, o_orderkey, o_orderpriority FROM orders
UNION ALL SELECT 'outsider', o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def public_or_group(f: Frames) -> DataFrame:
    orders = f.read("orders").select("o_orderkey", "o_orderpriority")

    def seen(principal: str, label: str) -> DataFrame:
        who = resolve_who(f.membership, principal)
        rows = filter_public_or_group(orders, "o_orderpriority", ["1-URGENT", "5-LOW"], "bu_BUILDING", who)
        return rows.select(F.lit(label).alias("seen_by"), *orders.columns)

    return seen(MEMBER, "member").unionAll(seen(OUTSIDER, "outsider"))


@query("E-04_constant_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def constant_filter(f: Frames) -> DataFrame:
    rows = equals_rule("R")(f.read("lineitem"), ["l_returnflag"], None)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("E-05_two_column_filter", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority = '1-URGENT'")
def two_column_filter(f: Frames) -> DataFrame:
    rule = predicate_rule(lambda status, priority: (status == "O") | (priority == "1-URGENT"))
    rows = f.read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rule(rows, ["o_orderstatus", "o_orderpriority"], resolve_who(f.membership, MEMBER))


def _scoped_policies(f: Frames) -> DataFrame:
    """Policies of the derived tables with TO and EXCEPT lists that name groups and customers."""
    someone = F.concat(F.lit("Customer#"), F.lpad((F.col("tid") % 50).cast("string"), 9, "0"))
    to = (
        F.when(F.col("tid") % 3 == 0, F.array(F.lit("account users")))
        .when(F.col("tid") % 3 == 1, F.array(F.lit("bu_BUILDING"), F.lit("bu_MACHINERY")))
        .otherwise(F.array(someone))
    )
    except_ = F.when(F.col("tid") % 2 == 0, F.array(F.lit("admins"), someone)).otherwise(F.array().cast("array<string>"))
    return f.tables.select(
        F.concat(F.lit("TABLE "), "table").alias("on_securable"),
        F.lit("abac_migrated_row_filter").alias("policy_name"),
        to.alias("to_principals"),
        except_.alias("except_principals"),
    )


_BINDING = {
    "pol": """
SELECT tid, 'TABLE ' || tn AS on_securable, CASE tid % 3 WHEN 0 THEN ['account users'] WHEN 1 THEN ['bu_BUILDING', 'bu_MACHINERY'] ELSE ['Customer#' || lpad(CAST(tid % 50 AS VARCHAR), 9, '0')] END AS to_list,
  CASE WHEN tid % 2 = 0 THEN ['admins', 'Customer#' || lpad(CAST(tid % 50 AS VARCHAR), 9, '0')] ELSE CAST([] AS VARCHAR[]) END AS except_list FROM gov_tables""",
    "me": f"""
SELECT p, who FROM (SELECT p, unnest(['account users', p]) AS who FROM (VALUES ('{MEMBER}'), ('{ADMIN}'), ('{OUTSIDER}')) v(p)) UNION SELECT member_email, group_name FROM membership WHERE member_email IN ('{MEMBER}', '{ADMIN}', '{OUTSIDER}')""",
    "bound": "SELECT DISTINCT p, tid, on_securable FROM me JOIN (SELECT tid, on_securable, unnest(to_list) AS who FROM pol) USING (who)",
    "exempt": "SELECT DISTINCT p, tid FROM me JOIN (SELECT tid, unnest(except_list) AS who FROM pol) USING (who)",
}


def _binding(f: Frames, limit: int, exempt: bool) -> DataFrame:
    policies = _scoped_policies(f)
    if not exempt:
        policies = policies.withColumn("except_principals", F.array().cast("array<string>"))
    parts = [
        policies_binding(policies, resolve_who(f.membership, p, limit=limit)).select(F.lit(p).alias("principal"), "on_securable")
        for p in (MEMBER, ADMIN, OUTSIDER)
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


_EXEMPT = "SELECT p AS principal, on_securable FROM bound b WHERE NOT EXISTS (SELECT 1 FROM exempt e WHERE e.p = b.p AND e.tid = b.tid)"


@query("E-06_exempt_principals", _EXEMPT, _BINDING)
def exempt_principals(f: Frames) -> DataFrame:
    return _binding(f, limit=1000, exempt=True)


@query("E-06_exempt_by_join", _EXEMPT, _BINDING)
def exempt_by_join(f: Frames) -> DataFrame:
    return _binding(f, limit=0, exempt=True)


@query("E-07_target_principals", "SELECT p AS principal, on_securable FROM bound", _BINDING)
def target_principals(f: Frames) -> DataFrame:
    return _binding(f, limit=1000, exempt=False)


def _masked(f: Frames, column: str, mask: m.Mask, principal: str = MEMBER, admin_bypass: bool = False) -> DataFrame:
    who = resolve_who(f.membership, principal)
    rows = f.customers.select("c_custkey", column)
    return apply_masks(rows, {column: "mask"}, {"mask": MaskFunction(mask, admin_bypass)}, who)


@query("M-01_email_keep_domain", f"SELECT c_custkey, {MASKED_EMAIL} AS email FROM sec_customers")
def email_keep_domain(f: Frames) -> DataFrame:
    return _masked(f, "email", m.email_keep_domain(), admin_bypass=True)


@query("M-02_email_fixed_domain", "SELECT c_custkey, substr(email, 1, 1) || '***@masked.com' AS email FROM sec_customers")
def email_fixed_domain(f: Frames) -> DataFrame:
    return _masked(f, "email", m.email_fixed_domain())


@query("M-03_keep_last_four", f"SELECT c_custkey, {MASKED_PHONE} AS phone FROM sec_customers")
def keep_last(f: Frames) -> DataFrame:
    return _masked(f, "phone", m.keep_last())


@query("M-04_prefix_only", "SELECT c_custkey, '****-****-****-' || email AS email FROM sec_customers")
def prefix_only(f: Frames) -> DataFrame:
    return _masked(f, "email", m.with_prefix())


@query("M-05_constant", "SELECT c_custkey, 'REDACTED' AS email FROM sec_customers")
def constant(f: Frames) -> DataFrame:
    return _masked(f, "email", m.constant())


@query("M-06_null_out", "SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal FROM sec_customers")
def null_out(f: Frames) -> DataFrame:
    return _masked(f, "c_acctbal", m.null_out())


@query("M-07_admin_bypass", f"""
SELECT 'admin' AS seen_by, c_custkey, email FROM sec_customers UNION ALL SELECT 'member', c_custkey, {MASKED_EMAIL} FROM sec_customers""")
def admin_bypass(f: Frames) -> DataFrame:
    both = [("admin", ADMIN), ("member", MEMBER)]
    admin, member = [
        _masked(f, "email", m.email_keep_domain(), p, True).select(F.lit(label).alias("seen_by"), "c_custkey", "email")
        for label, p in both
    ]
    return admin.unionAll(member)


@query("M-08_assignment", f"""
SELECT c_custkey, 'REDACTED' AS c_name, {MASKED_EMAIL} AS email, {MASKED_PHONE} AS phone, CAST(NULL AS DOUBLE) AS c_acctbal, 'REDACTED' AS business_unit FROM sec_customers""")
def assignment(f: Frames) -> DataFrame:
    functions = {
        "email": MaskFunction(m.email_keep_domain()), "phone": MaskFunction(m.keep_last()),
        "redact": MaskFunction(m.constant()), "null": MaskFunction(m.null_out()),
    }
    assigned = {"c_name": "redact", "business_unit": "redact", "email": "email", "phone": "phone", "c_acctbal": "null"}
    return apply_masks(f.customers, assigned, functions, resolve_who(f.membership, MEMBER))


_MATCHES = """
SELECT p.cn, p.sn, p.tn, on_securable, policy_name, object_type AS policy_type, pfn,
  CASE object_type WHEN 'ROW_FILTER' THEN 'mc_region' ELSE 'mc_' || slot END AS alias, t.col
FROM table_policies p JOIN tags t ON t.cn = p.cn AND t.sn = p.sn AND t.tn = p.tn AND t.tkey = p.tkey
UNION ALL
SELECT t.cn, t.sn, t.tn, on_securable, policy_name, object_type, pfn,
  CASE object_type WHEN 'ROW_FILTER' THEN 'mc_region' ELSE 'mc_' || slot END, t.col
FROM catalog_policies p JOIN tags t ON t.cn = p.cn AND t.tkey = p.tkey"""


def _matches(f: Frames) -> DataFrame:
    both = f.policies("TABLE").unionByName(f.policies("CATALOG"))
    return matching.resolve_match_columns(both, f.column_tags)


@query("X-01_match_columns", f"SELECT {KEY_OUT}, on_securable, policy_name, alias, col AS \"column\" FROM matches", {"matches": _MATCHES})
def match_columns(f: Frames) -> DataFrame:
    return _matches(f).select(*KEY, "on_securable", "policy_name", "alias", "column")


@query("X-01_valued_tags", """
SELECT cn AS catalog, tkey AS tag_key, tval AS wanted, count(*) AS n_columns FROM tags WHERE tval IS NOT NULL GROUP BY ALL
UNION ALL SELECT cn, tkey, 'any value', count(*) FROM tags GROUP BY ALL""")
def valued_tags(f: Frames) -> DataFrame:
    """A catalog policy for each tag key with each of its values, and one for the key with any value."""
    keys = f.column_tags.select("catalog", "tag_key", F.explode(F.array_distinct(F.array("tag_value", F.lit(None)))).alias("tag_value")).distinct()
    wanted = F.coalesce("tag_value", F.lit("any value"))
    match = F.struct("tag_key", "tag_value", F.lit("mc").alias("alias"), F.lit(None).cast("string").alias("source_column"))
    policies = keys.select(
        F.concat(F.lit("CATALOG `"), "catalog", F.lit("`")).alias("on_securable"), F.concat_ws("|", "tag_key", wanted).alias("policy_name"),
        F.lit("COLUMN_MASK").alias("policy_type"), F.lit("f").alias("function_fqn"), F.array(match).alias("match_columns"),
    )
    found = matching.resolve_match_columns(policies, f.column_tags)
    return found.groupBy("catalog", "tag_key", F.substring_index("policy_name", "|", -1).alias("wanted")).agg(F.count("*").alias("n_columns"))


@query("X-01_conditions", f"""
SELECT {KEY_OUT}, on_securable, policy_name, col AS "column" FROM (
  SELECT DISTINCT cn, sn, tn, 'SCHEMA `' || cn || '`.`' || sn || '`' AS on_securable, 'low ' || k.tkey AS policy_name, col
  FROM tags t JOIN (SELECT DISTINCT cn, sn, tkey FROM tags) k USING (cn, sn)
  WHERE t.tkey = k.tkey AND NOT EXISTS (SELECT 1 FROM tags h WHERE (h.cn, h.sn, h.tn, h.col, h.tkey) = (t.cn, t.sn, t.tn, t.col, k.tkey) AND h.tval = 'high')
  UNION ALL
  SELECT DISTINCT cn, sn, tn, 'CATALOG `' || cn || '`', 'mail or high', col FROM tags t
  WHERE tkey = 'pii_email' OR (tval = 'high' AND tkey IN ('pii_phone', 'pii_ssn')))""")
def conditions(f: Frames) -> DataFrame:
    """Policies on schemas and catalogs whose conditions join, negate and bracket tag tests, from their descriptions."""
    tags = f.column_tags
    key = F.col("tag_key")
    low = tags.select("catalog", "schema", "tag_key").distinct().select(
        F.concat_ws("|", "catalog", "schema", key).alias("policy_id"), F.lit("SCHEMA").alias("kind"), F.concat_ws(".", "catalog", "schema").alias("on"),
        F.concat(F.lit("low "), key).alias("policy_name"),
        F.concat(F.lit("has_tag('"), key, F.lit("') AND NOT has_tag_value('"), key, F.lit("', 'high') AS mc")).alias("match"),
    )
    either = "has_tag('pii_email') OR (has_tag_value('pii_phone', 'high') OR has_tag_value('pii_ssn', 'high')) AND NOT has_tag('nowhere') AS mc"
    mail = tags.select("catalog").distinct().select(
        F.col("catalog").alias("policy_id"), F.lit("CATALOG").alias("kind"), F.col("catalog").alias("on"), F.lit("mail or high").alias("policy_name"), F.lit(either).alias("match")
    )
    told = {"Name": "policy_name", "On Securable Type": "kind", "On Securable": "on", "Match Columns": "match"}
    fixed = {"Policy Type": "COLUMN_MASK", "  Function Name": "f", "  On Column": "mc", "To Principals": "account users"}
    lines = [F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in told.items()]
    lines += [F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in fixed.items()]
    policies = described_policies(low.unionByName(mail).select("policy_id", F.inline(F.array(*lines))))
    return matching.resolve_match_columns(policies, tags).select(*KEY, "on_securable", "policy_name", "column")


@query("X-02_ambiguous_matches", f"""
SELECT {KEY_OUT}, on_securable, policy_name, alias, min(col) AS first_column, max(col) AS last_column, 'UC_ABAC_AMBIGUOUS_COLUMN_MATCH' AS error_code
FROM matches WHERE policy_type = 'ROW_FILTER' GROUP BY cn, sn, tn, on_securable, policy_name, alias HAVING count(DISTINCT col) > 1""", {"matches": _MATCHES})
def ambiguous(f: Frames) -> DataFrame:
    return matching.ambiguous_matches(_matches(f))


@query("X-03_policies_in_force", f"""
SELECT {KEY_OUT}, on_securable, policy_name, policy_type, pfn AS function_fqn, count(*) AS n_columns
FROM matches GROUP BY cn, sn, tn, on_securable, policy_name, policy_type, pfn""", {"matches": _MATCHES})
def in_force(f: Frames) -> DataFrame:
    return matching.policies_in_force(_matches(f))


CUSTOMERS = ("cat-0", "s_0", "customers")


def customer_state(f: Frames, legacy: bool = False, policies: bool = True) -> SecurityState:
    """Rules on the customers table: units by group, e-mail and phone masked.

    The policies find their columns by tags, one of them from the catalog; the
    old rules name the same functions.
    """
    spark = f.spark
    on_table = "TABLE `cat-0`.`s_0`.`customers`"

    def policy(securable: str, name: str, kind: str, fn: str, tag: str) -> tuple:
        alias = f"mc_{tag}"
        return (securable, name, kind, fn, [(tag, None, alias, None)], [alias] if kind == "ROW_FILTER" else [],
                None if kind == "ROW_FILTER" else alias, ["account users"], ["bu_EXEMPT"], "")

    rows = [
        policy(on_table, "abac_migrated_row_filter", "ROW_FILTER", "gov.rf_unit", "unit"),
        policy(on_table, "abac_migrated_mask_phone", "COLUMN_MASK", "gov.mask_phone", "phone"),
        policy("CATALOG `cat-0`", "abac_colmask_gov_mask_email", "COLUMN_MASK", "gov.mask_email", "email"),
        policy("CATALOG `cat-0`", "abac_colmask_unused", "COLUMN_MASK", "gov.mask_none", "nowhere"),
        policy("CATALOG `cat-1`", "abac_colmask_elsewhere", "COLUMN_MASK", "gov.mask_none", "phone"),
    ]
    tags = [(*CUSTOMERS, c, t, None) for c, t in (("business_unit", "unit"), ("phone", "phone"), ("email", "email"))]
    old_filter = [(*CUSTOMERS, "gov.rf_unit", ["business_unit"], "")]
    old_masks = [(*CUSTOMERS, "email", "gov.mask_email", "", 1), (*CUSTOMERS, "phone", "gov.mask_phone", "", 2)]

    def frame(data: list[tuple], ddl: str) -> DataFrame:
        return spark.createDataFrame(data, schemas.schema(ddl))

    return SecurityState(
        membership=f.membership,
        functions={
            "gov.rf_unit": group_rule(f.unit_groups),
            "gov.mask_email": MaskFunction(m.email_keep_domain(), admin_bypass=True),
            "gov.mask_phone": MaskFunction(m.keep_last(), admin_bypass=True),
        },
        row_filters=frame(old_filter, schemas.ROW_FILTERS) if legacy else None,
        masks=frame(old_masks, schemas.MASKS) if legacy else None,
        policies=frame(rows, schemas.POLICIES) if policies else None,
        column_tags=frame(tags, schemas.COLUMN_TAGS) if policies else None,
    )


_SECURED = f"""SELECT c_custkey, c_name, {MASKED_EMAIL} AS email, {MASKED_PHONE} AS phone, c_acctbal, business_unit
FROM sec_customers WHERE business_unit IN {ALLOWED_UNITS}"""


@query("X-04_secured_customers", _SECURED)
def secured_customers(f: Frames) -> DataFrame:
    return secure(f.customers, CUSTOMERS, customer_state(f), MEMBER)


def described_state(f: Frames) -> SecurityState:
    """The rules of ``customer_state`` from policy descriptions whose conditions join, negate and bracket tag tests."""
    wanted = [
        ("SCHEMA", "cat-0.s_0", "units", "ROW_FILTER", "gov.rf_unit", "(has_tag('unit')) AND NOT has_tag('shown') u"),
        ("CATALOG", "`cat-0`", "phones", "COLUMN_MASK", "gov.mask_phone", "NOT (has_tag('unit') OR has_tag('email') OR has_tag('shown')) AS u"),
        ("TABLE", "cat-0.s_0.customers", "mails", "COLUMN_MASK", "gov.mask_email", "has_tag_value(\"email\", 'work') OR has_tag('mail') AS u"),
        ("CATALOG", "cat-1", "elsewhere", "COLUMN_MASK", "gov.mask_none", "what is this"),
    ]
    lines = [
        (name, label, value)
        for kind, on, name, what, fn, match in wanted
        for label, value in {
            "Name": name, "Policy Type": what, "On Securable Type": kind, "On Securable": on, "  Function Name": fn, "Match Columns": match, "To Principals": "account users",
            "Except Principals": "`bu_EXEMPT`", ("  Using Columns" if what == "ROW_FILTER" else "  On Column"): "u",
        }.items()
    ]
    tags = [("business_unit", "unit", None), ("email", "email", "work"), *((c, "shown", None) for c in ("c_custkey", "c_name", "c_acctbal"))]
    state = customer_state(f)
    return replace(
        state,
        policies=described_policies(f.spark.createDataFrame(lines, "policy_id string, name string, value string")),
        column_tags=f.spark.createDataFrame([(*CUSTOMERS, *t) for t in tags], schemas.schema(schemas.COLUMN_TAGS)),
    )


@query("X-04_conditions", _SECURED)
def secured_by_conditions(f: Frames) -> DataFrame:
    return secure(f.customers, CUSTOMERS, described_state(f), MEMBER)


@query("X-04_secured_join", f"""
SELECT s.business_unit, o.o_orderpriority, s.email, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
FROM ({_SECURED}) s JOIN orders o ON o.o_custkey = s.c_custkey GROUP BY 1, 2, 3""")
def secured_join(f: Frames) -> DataFrame:
    """The caller's own query sits above the rules: it groups by the masked value."""
    seen = secure(f.customers, CUSTOMERS, customer_state(f), MEMBER)
    orders = f.read("orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    return (
        orders.join(seen, orders["o_custkey"] == seen["c_custkey"])
        .groupBy("business_unit", "o_orderpriority", "email")
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query("X-04_two_argument_mask", f"SELECT c_custkey, c_name, {MASKED_EMAIL} AS email, phone, c_acctbal, business_unit FROM sec_customers")
def two_argument_mask(f: Frames) -> DataFrame:
    """A mask whose first alias is only an argument: the target is masked, the argument stays."""
    match = [("unit", None, "mc_unit", None), ("email", None, "mc_email", None)]
    row = ("CATALOG `cat-0`", "two", "COLUMN_MASK", "gov.mask_email", match, ["mc_unit"], "mc_email", ["account users"], [], "")
    policies = f.spark.createDataFrame([row], schemas.schema(schemas.POLICIES))
    return secure(f.customers, CUSTOMERS, replace(customer_state(f), policies=policies), MEMBER)


@query("X-05_old_and_new_rules", _SECURED)
def old_and_new(f: Frames) -> DataFrame:
    return secure(f.customers, CUSTOMERS, customer_state(f, legacy=True), MEMBER)


@query("X-06_phase_parity", f"""
SELECT phase, n_rows, 0 AS n_different FROM (SELECT count(*) AS n_rows FROM ({_SECURED})), (VALUES ('between'), ('after'), ('rolled_back')) v(phase)""")
def phase_parity(f: Frames) -> DataFrame:
    """What a member sees through the real phases: apply, finalize, roll both back, each on the state before it."""
    folder, rules = shared_folder(f.spark), customer_state(f, legacy=True, policies=False)

    def frame(ddl: str, *data: tuple) -> DataFrame:
        return f.spark.createDataFrame(list(data), schemas.schema(ddl))

    def options(mode: str, run_id: str) -> RunOptions:
        return RunOptions(
            mode=mode, scope_type="ALL_CATALOGS", dry_run=False, run_id=run_id, audit_path=f"{folder}/audit", inventory_path=f"{folder}/inventory"
        )

    start = GovernanceState(
        frame(schemas.TABLES, (*CUSTOMERS, "MANAGED", None)), rules.row_filters, rules.masks, frame(schemas.POLICIES), frame(schemas.COLUMN_TAGS),
        frame(schemas.GOVERNED_TAGS), frame(schemas.FUNCTIONS, *[(fn, True) for fn in rules.functions]),
    )
    applied = run(start, options("APPLY_ABAC", "a1")).state
    final = run(applied, options("FINALIZE", "f1")).state
    undone = run(run(final, options("ROLLBACK", "f1")).state, options("ROLLBACK", "a1")).state

    def seen(state: GovernanceState) -> DataFrame:
        live = replace(rules, row_filters=state.row_filters, masks=state.masks, policies=state.policies, column_tags=state.column_tags)
        return secure(f.customers, CUSTOMERS, live, MEMBER)

    if not final.row_filters.isEmpty() or not final.masks.isEmpty():
        raise AssertionError("old rules are still there after FINALIZE")
    before = seen(start)
    parts = []
    for name, state in {"between": applied, "after": final, "rolled_back": undone}.items():
        rows = seen(state)
        differ = checks.parity_difference(before, rows).agg(F.count("*").alias("n"))
        parts.append(rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("phase"), "n_rows", differ.scalar().alias("n_different")))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("X-06_parity_differences", """
SELECT o_orderkey, o_orderstatus, CAST(sum(sign) AS BIGINT) AS n_extra FROM (
  SELECT o_orderkey, o_orderstatus, -1 AS sign FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_orderkey, o_orderstatus, 1 FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1, 2 HAVING sum(sign) <> 0""")
def parity_differences(f: Frames) -> DataFrame:
    orders = f.read("orders").select("o_orderkey", "o_orderstatus")
    return checks.parity_difference(orders.where("o_orderstatus <> 'P'"), orders.where("o_orderstatus <> 'F'"))


@query("X-06_parity_by_buckets", """
SELECT o_orderkey, o_orderdate, o_orderpriority, CAST(sum(sign) AS BIGINT) AS n_extra FROM (
  SELECT o_orderkey, o_orderdate, o_orderpriority, -1 AS sign FROM orders
  UNION ALL SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 1000 = 3 THEN NULL ELSE o_orderpriority END, 1 FROM orders WHERE o_orderkey % 1000 <> 5) GROUP BY ALL HAVING sum(sign) <> 0""")
def parity_by_buckets(f: Frames) -> DataFrame:
    """Two frames that differ in few rows: only the buckets of these are shuffled whole."""
    orders = f.read("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey") % 1000
    after = orders.where(key != 5).withColumn("o_orderpriority", F.when(key != 3, F.col("o_orderpriority")))
    return checks.parity_by_buckets(orders, after)


_COUNTS = {
    "unit_counts": "SELECT business_unit AS unit, count(*) AS n_rows FROM sec_customers GROUP BY 1",
    "counts": """
SELECT DISTINCT member_email AS principal, unit, n_rows FROM membership JOIN unit_counts ON group_name = 'bu_' || unit OR group_name = 'admins'""",
}


def _counts(f: Frames) -> DataFrame:
    return checks.visible_counts(f.customers, "business_unit", f.unit_groups, f.membership)


@query("X-07_visible_counts", "SELECT principal, unit, n_rows FROM counts", _COUNTS)
def visible_counts(f: Frames) -> DataFrame:
    return _counts(f)


@query("X-07_visible_totals", "SELECT principal, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_units FROM counts GROUP BY 1", _COUNTS)
def visible_totals(f: Frames) -> DataFrame:
    return checks.visible_totals(f.customers, "business_unit", f.unit_groups, f.membership)


_CLASSES = {
    **_COUNTS,
    "admins": "SELECT DISTINCT member_email AS principal FROM membership WHERE group_name = 'admins'",
    "sights": "SELECT principal, string_agg(unit, '|' ORDER BY unit) AS units FROM counts WHERE principal NOT IN (SELECT principal FROM admins) GROUP BY 1",
    "classes": """
SELECT principal, min(principal) OVER (PARTITION BY units) AS class_id, false AS sees_all FROM sights
UNION ALL SELECT principal, min(principal) OVER (), true FROM admins""",
}


def _classes(f: Frames) -> DataFrame:
    units = f.customers.select(F.col("business_unit").alias("unit"))
    return checks.principal_classes(units, f.unit_groups, f.membership)


def _class_counts(f: Frames, classes: DataFrame) -> DataFrame:
    return checks.class_counts(f.customers, "business_unit", f.unit_groups, f.membership, classes)


@query("X-07_principal_classes", "SELECT * FROM classes", _CLASSES)
def principal_classes(f: Frames) -> DataFrame:
    return _classes(f)


@query("X-07_class_counts", "SELECT principal AS class_id, unit, n_rows FROM counts WHERE principal IN (SELECT class_id FROM classes)", _CLASSES)
def class_counts(f: Frames) -> DataFrame:
    """One set of rows for all who see the same, administrators among them."""
    return _class_counts(f, _classes(f))


@query("X-07_visible_lines", """
SELECT DISTINCT member_email AS principal, unit, n_rows
FROM membership JOIN (SELECT l_returnflag AS unit, count(*) AS n_rows FROM lineitem GROUP BY 1) ON group_name = 'rf_' || unit OR group_name = 'admins'""")
def visible_lines(f: Frames) -> DataFrame:
    return checks.visible_counts(f.read("lineitem"), "l_returnflag", f.flag_groups, f.membership)


@query("X-08_masked_sample", f"""
SELECT * FROM ({_SECURED}) ORDER BY c_custkey LIMIT 3""")
def masked_sample(f: Frames) -> DataFrame:
    return checks.sample(secure(f.customers, CUSTOMERS, customer_state(f), MEMBER), "c_custkey")


@query("X-08_sample_per_principal", """
SELECT principal, position, c_custkey, business_unit, phone FROM (
  SELECT m.principal, row_number() OVER (PARTITION BY m.principal ORDER BY c_custkey) AS position, c_custkey, business_unit,
    CASE WHEN m.principal IN (SELECT member_email FROM membership WHERE group_name = 'admins') THEN phone ELSE '******' || right(phone, 4) END AS phone
  FROM sec_customers s JOIN (SELECT DISTINCT member_email AS principal, unit FROM membership JOIN (SELECT DISTINCT c_mktsegment AS unit FROM customer)
    ON group_name = 'bu_' || unit OR group_name = 'admins') m ON m.unit = s.business_unit) WHERE position <= 3""")
def sample_per_principal(f: Frames) -> DataFrame:
    """Masked for members, in clear for administrators, whom the mask lets through."""
    raw, mask = f.customers.select("c_custkey", "business_unit", "phone"), {"p": MaskFunction(m.keep_last(), admin_bypass=True)}
    nobody = frozenset()
    masked, clear = (apply_masks(raw, {"phone": "p"}, mask, Who("", nobody, admin, f.membership)) for admin in (False, True))
    return checks.sample_per_principal(masked, "business_unit", "c_custkey", f.unit_groups, f.membership, for_admins=clear)


@query("X-09_isolation_verdict", """
SELECT principal, count(*) AS n_units, count(*) FILTER (n_viewers > 1) AS n_shared_units, count(*) FILTER (n_viewers > 1) = 0 AS isolated
FROM (SELECT principal, count(*) OVER (PARTITION BY unit) AS n_viewers FROM counts
      WHERE principal NOT IN (SELECT member_email FROM membership WHERE group_name = 'admins')) GROUP BY 1""", _COUNTS)
def isolation(f: Frames) -> DataFrame:
    return checks.isolation_verdict(_counts(f), f.membership)


@query("X-09_class_isolation", """
SELECT class_id, count(DISTINCT principal) AS n_principals, count(DISTINCT unit) AS n_units, count(DISTINCT unit) FILTER (n_viewers > 1) AS n_shared_units, count(*) FILTER (n_viewers > 1) = 0 AS isolated
FROM (SELECT class_id, principal, unit, count(*) OVER (PARTITION BY unit) AS n_viewers FROM counts JOIN classes USING (principal) WHERE NOT sees_all) GROUP BY 1""", _CLASSES)
def class_isolation(f: Frames) -> DataFrame:
    classes = _classes(f)
    return checks.class_isolation(_class_counts(f, classes), classes)


@query("X-09_overlap", """
SELECT c_custkey FROM sec_customers
WHERE business_unit IN (SELECT substr(group_name, 4) FROM membership WHERE member_email = (SELECT min(member_email) FROM membership WHERE group_name = 'bu_BUILDING'))
  AND business_unit IN (SELECT substr(group_name, 4) FROM membership WHERE member_email = (SELECT max(member_email) FROM membership WHERE group_name = 'bu_BUILDING'))""")
def overlap(f: Frames) -> DataFrame:
    """What two principals, each behind the table's rules, both see."""
    state = customer_state(f)
    ends = f.membership.agg(
        F.min(F.when(F.col("group_name") == "bu_BUILDING", F.col("member_email"))).alias("a"),
        F.max(F.when(F.col("group_name") == "bu_BUILDING", F.col("member_email"))).alias("b"),
    ).first()
    seen = [secure(f.customers, CUSTOMERS, state, p).select("c_custkey") for p in (ends.a, ends.b)]
    return checks.overlap(*seen)


@query("X-09_unexpected", """
SELECT coalesce(c.principal, e.principal) AS principal, coalesce(c.unit, e.unit) AS unit, c.n_rows AS n_seen, e.n_rows AS n_expected
FROM counts c FULL JOIN (SELECT c_name AS principal, c_mktsegment AS unit, n_rows FROM customer JOIN unit_counts ON unit = c_mktsegment WHERE c_custkey % 10 = 0) e
  ON c.principal = e.principal AND c.unit = e.unit WHERE c.n_rows IS DISTINCT FROM e.n_rows""", _COUNTS)
def unexpected(f: Frames) -> DataFrame:
    counts = _counts(f)
    sizes = f.customers.groupBy(F.col("business_unit").alias("unit")).agg(F.count("*").alias("n_rows"))
    members = f.read("customer").where("c_custkey % 10 = 0")
    expected = members.select(F.col("c_name").alias("principal"), F.col("c_mktsegment").alias("unit")).join(sizes, "unit")
    return checks.unexpected_visibility(counts, expected)


@query("X-10_mask_check", f"SELECT count(*) AS n_rows, true AS phone, true AS email, false AS c_name FROM ({_SECURED})")
def mask_check(f: Frames) -> DataFrame:
    """What the rules promise, tested on what they show: a phone's tail behind stars, no local part of an address."""
    seen = secure(f.customers, CUSTOMERS, customer_state(f), MEMBER).select("c_custkey", "phone", "email", "c_name")
    raw = f.customers.select("c_custkey", F.col("phone").alias("raw_phone"), F.col("email").alias("raw_email"))
    both = seen.join(raw, "c_custkey")
    domain = F.substring_index("raw_email", "@", -1)
    shown = F.when(F.contains("raw_email", F.lit("@")), F.substring_index("email", "@", -1) == domain).otherwise(True)
    hidden = F.coalesce((F.col("email") != F.col("raw_email")) & shown, F.col("raw_email").isNull())
    tail = F.col("phone").rlike(r"^\*+[0-9]{4}$") & (F.right("phone", F.lit(4)) == F.right("raw_phone", F.lit(4)))
    judged = both.select("c_name", F.when(tail, "ok").alias("phone"), F.when(hidden, "ok").alias("email"))
    return checks.mask_check(judged, {"phone": "ok", "email": "ok", "c_name": "REDACTED"})


def event_state(f: Frames) -> SecurityState:
    table = ("cat-0", "s_0", "events")
    return SecurityState(
        membership=f.membership,
        functions={"gov.rf_type": predicate_rule(lambda c: c.isin("click", "purchase")), "gov.mask": MaskFunction(m.constant())},
        row_filters=f.spark.createDataFrame([(*table, "gov.rf_type", ["event_type"], "")], schemas.schema(schemas.ROW_FILTERS)),
        masks=f.spark.createDataFrame([(*table, "props", "gov.mask", "", 1)], schemas.schema(schemas.MASKS)),
    )


_EVENTS = "SELECT event_id, user_id, event_type, value, 'REDACTED' AS props FROM events WHERE event_type IN ('click', 'purchase')"


@query("X-11_secured_stream", _EVENTS)
def secured_stream(f: Frames) -> DataFrame:
    """The events file read as a stream, secured, appended to Parquet, read back."""
    schema = f.read("events").schema
    stream = read_files(f.spark, f.dir, schema, "events.parquet")
    seen = secure_stream(stream, ("cat-0", "s_0", "events"), event_state(f), MEMBER)
    target = shared_folder(f.spark)
    write_available(seen, f"{target}/rows", f"{target}/checkpoint").awaitTermination()
    return f.spark.read.schema(schema).parquet(f"{target}/rows").select("event_id", "user_id", "event_type", "value", "props")


@query("X-11_rules_follow_the_stream", """
SELECT event_id, event_type, CAST(CASE WHEN half = 1 THEN 1 ELSE 2 END AS BIGINT) AS rules_version
FROM (SELECT *, ntile(2) OVER (ORDER BY event_id) AS half FROM events) WHERE half = 1 OR event_type = 'click'""")
def rules_follow_the_stream(f: Frames) -> DataFrame:
    """Events arrive in two halves; between them the principal leaves the group that sees more than clicks."""
    spark, folder = f.spark, shared_folder(f.spark)
    table, group = ("cat-0", "s_0", "events"), "bu_BUILDING"
    rules = spark.createDataFrame([(*table, "gov.rf", ["event_type"], "")], schemas.schema(schemas.ROW_FILTERS))
    store = StateStore(spark, f"{folder}/state", buckets=4)
    store.save({"membership": f.membership, "row_filters": rules})
    events, schema = f.read("events"), f.read("events").schema
    last = events.orderBy("event_id").select("event_id").limit((events.count() + 1) // 2).agg(F.max("event_id")).scalar()
    for half in (F.col("event_id") <= last, F.col("event_id") > last):
        events.where(half).write.mode("append").parquet(f"{folder}/events")
        stream = read_files(spark, f"{folder}/events", schema)
        functions = {"gov.rf": public_or_group_rule(["click"], group)}
        write_by_version(stream, table, store, functions, MEMBER, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
        if store.version == 1:
            left = f.membership.where((F.col("member_email") == MEMBER) & F.col("group_name").isin(group, "admins"))
            store.append({"membership": Changes(deletes=left)})
    return spark.read.parquet(f"{folder}/rows").select("event_id", "event_type", "rules_version")


@query("X-12_incremental_totals", """
SELECT o_custkey AS c_custkey, count(*) AS n_rows, sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS total
FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1""")
def incremental_totals(f: Frames) -> DataFrame:
    """Totals per customer of open and partial orders; then filled ones come in and partial ones go."""
    price = F.col("o_totalprice").cast("decimal(15,2)").alias("total")
    orders = f.read("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", price)
    ddl = totals_ddl("c_custkey long", {"total": "decimal(38,2)"})
    totals = KeyedTable(ChangeLog(f.spark, shared_folder(f.spark)), "order_totals", ddl, ("c_custkey",), buckets=8)
    status = F.col("o_orderstatus")
    add_signed(totals, orders.where(status.isin("O", "P")).withColumn("sign", F.lit(1)), ["total"])
    change = orders.where(status.isin("F", "P")).withColumn("sign", F.when(status == "F", 1).otherwise(-1))
    add_signed(totals, change, ["total"])
    totals.log.vacuum()
    return totals.read().select("c_custkey", "n_rows", "total")


@query("X-12_secured_snapshot", """
SELECT c_custkey, n_orders, total, 'REDACTED' AS business_unit FROM (
  SELECT c_custkey, any_value(business_unit) AS bu, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
  FROM orders JOIN sec_customers ON o_custkey = c_custkey GROUP BY 1) WHERE bu = 'BUILDING'""")
def secured_snapshot(f: Frames) -> DataFrame:
    """A stored aggregate, refreshed in full; the rules act when it is read."""
    totals = (
        f.read("orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        .join(f.customers.select("c_custkey", "business_unit"), "c_custkey")
    )
    snapshot = refresh_snapshot(totals, shared_folder(f.spark))
    table = ("cat-0", "s_0", "order_totals")
    state = SecurityState(
        membership=f.membership,
        functions={"gov.rf": equals_rule("BUILDING"), "gov.mask": MaskFunction(m.constant())},
        row_filters=f.spark.createDataFrame([(*table, "gov.rf", ["business_unit"], "")], schemas.schema(schemas.ROW_FILTERS)),
        masks=f.spark.createDataFrame([(*table, "business_unit", "gov.mask", "", 1)], schemas.schema(schemas.MASKS)),
    )
    return secure(snapshot, table, state, MEMBER)


@query("FLAGSHIP_visible_orders", """
SELECT principal, unit, n_customers, n_orders FROM (
  SELECT DISTINCT member_email AS principal, unit, n_customers, n_orders
  FROM (SELECT business_unit AS unit, count(*) AS n_customers, CAST(sum(n) AS BIGINT) AS n_orders FROM sec_customers
        LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1)
  JOIN membership ON group_name = 'bu_' || unit OR group_name = 'admins')""")
def visible_orders(f: Frames) -> DataFrame:
    """For each principal: customers and orders per unit that it may see.

    Orders are counted per customer before the join, and units before the
    memberships, so neither join carries raw rows of the large side.
    """
    per_customer = f.read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    units = (
        f.customers.select("c_custkey", "business_unit")
        .join(per_customer, "c_custkey", "left")
        .groupBy(F.col("business_unit").alias("unit"))
        .agg(F.count("*").alias("n_customers"), F.sum("n").alias("n_orders"))
    )
    return checks.hand_out(units, "unit", f.unit_groups, f.membership)
