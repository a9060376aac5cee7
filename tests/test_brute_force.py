"""Operators against plain loops over many random small cases, one job per operator.

A third of the rows of each case set belong to one table, key or function.
"""

import random
from collections import Counter, defaultdict

from helpers import frame, state
from pyspark.sql import functions as F

from tablewarden.operators import checks, describe, results, tags
from tablewarden.operators.decide import outcomes, plan_objects, with_faults
from tablewarden.sources import schemas

STATUSES = ["SUCCESS", "FAILED", "SKIPPED", "ALREADY_MIGRATED", "NOT_ELIGIBLE", "WOULD_MIGRATE", "DRIFT", "ROLLED_BACK",
            "WOULD_ROLLBACK", "ABAC_APPLIED", "WOULD_APPLY_ABAC", "WOULD_FINALIZE"]


def weakest(found: set[str]) -> str:
    if "FAILED" in found:
        return "FAILED"
    if found == {"NOT_ELIGIBLE"}:
        return "NOT_ELIGIBLE"
    for s in ("WOULD_MIGRATE", "WOULD_APPLY_ABAC", "WOULD_FINALIZE"):
        if s in found:
            return s
    if not found - {"ALREADY_MIGRATED", "NOT_ELIGIBLE"}:
        return "ALREADY_MIGRATED"
    for s in ("ABAC_APPLIED", "SUCCESS"):
        if s in found:
            return s
    return min(found)


def test_weakest_link_of_every_set_of_statuses(spark):
    sets = {n: {s for i, s in enumerate(STATUSES) if n >> i & 1} for n in range(1, 2 ** len(STATUSES))}
    pairs = spark.range(1, 2 ** len(STATUSES)).select(
        "id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("status")) for i, s in enumerate(STATUSES)])).alias("p")
    )
    member = pairs.where(F.expr("shiftright(id, p.i) % 2 = 1")).select("id", "p.status")
    got = {r.id: r.s for r in member.groupBy("id").agg(results.weakest_link().alias("s")).collect()}
    assert got == {n: weakest(s) for n, s in sets.items()}


def test_describe_sections(spark, monkeypatch):
    monkeypatch.setattr(describe, "CHUNK", 5)
    rng = random.Random(7)
    names = ["# Column Masks", "# Other", "", None, "a", "b", "Total Size (bytes)", " # Column Masks "]
    values = ["`c`.`s`.`f`", "`c`.`s`.`f` USING COLUMNS (x)", "2137", "", None, "  `c`.`s`.`g`"]
    dumps = {
        f"t{t}": [(rng.choice(names), rng.choice(values)) for _ in range(2000 if t == 0 else rng.randint(0, 25))] for t in range(200)
    }

    def loop(lines):
        out, inside = [], False
        for name, value in lines:
            if (name or "").strip() == "# Column Masks":
                inside = True
            elif inside and name and not name.startswith("#") and (value or "").strip().startswith("`"):
                out.append((name.strip(), "c.s." + value.strip()[9]))
            else:
                inside = False
        return sorted(out)

    rows = [("c", "s", t, i, n, v) for t, lines in dumps.items() for i, (n, v) in enumerate(lines)]
    df = frame(spark, rows, f"{schemas._KEY}, pos int, name string, value string")
    got = defaultdict(list)
    for r in describe.column_masks(df).collect():
        got[r.table].append((r.column, r.function_fqn))
    assert {t: sorted(v) for t, v in got.items()} == {t: loop(v) for t, v in dumps.items() if loop(v)}


def test_parity(spark):
    rng = random.Random(3)
    draw = lambda n: [(0 if rng.random() < 0.4 else rng.randint(1, 9), rng.choice([None, "x", "y"])) for _ in range(n)]
    a, b = draw(300), draw(320)
    want = Counter(b)
    want.subtract(Counter(a))
    ddl = "k int, v string"
    got = checks.parity_difference(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl)).collect()
    assert {(r.k, r.v): r.n_extra for r in got} == {k: n for k, n in want.items() if n}


def random_world(rng):
    """Tables with requests, tags and governed tags that meet and clash in many ways."""
    columns = ["c1", "c2", "c3", "c4"]
    governed = {"g_open": ([], "x"), "g_list": (["high", "low"], "x"), "mk_3": ([], "mine"),
                "mk_4": ([], tags.DESCRIPTION + "cat.sch.f4"), "rf_2": ([], tags.DESCRIPTION + "cat.sch.f2")}
    requests, assigned = [], []
    for t in range(150):
        table = ("cat", "sch", f"t{t}")
        free = columns[:]
        rng.shuffle(free)
        n_filter, n_mask = rng.choice([0, 1, 1, 2]), rng.randint(0, 3)
        fn = 0 if rng.random() < 0.4 else rng.randint(1, 6)
        requests += [(table, c, "row_filter", f"cat.sch.f{fn}", f"rf_{fn}") for c in free[:n_filter]]
        for c in rng.sample(columns, n_mask):
            fn = 0 if rng.random() < 0.4 else rng.randint(1, 6)
            requests.append((table, c, "mask", f"cat.sch.f{fn}", f"mk_{fn}"))
        seen = set()
        for _ in range(rng.randint(0, 5)):
            c = rng.choice([*columns, "c9"])
            k = rng.choice(["g_open", "g_list", "loose", "rf_0", "rf_2", "mk_0", "mk_4"])
            if (c, k) not in seen:
                seen.add((c, k))
                assigned.append((table, c, k, rng.choice([None, "high", "odd"])))
    # Two functions behind one key.
    requests.append((("cat", "sch", "t0x"), "c1", "mask", "cat.sch.f_5", "mk_5"))
    requests.append((("cat", "sch", "t1x"), "c1", "mask", "cat.sch.f-5", "mk_5"))
    return requests, assigned, governed


def resolve_by_loop(requests, assigned, governed, prefer):
    by_table = defaultdict(list)
    for t, c, k, v in assigned:
        by_table[t].append((c, k, v))
    out, left = {}, []
    for t, c, role, fn, key in requests:
        fits = [
            (k, v) for col, k, v in by_table[t]
            if prefer and col == c and k in governed and (not governed[k][0] or v in governed[k][0])
            and not [1 for o, k2, v2 in by_table[t] if o != c and (k2, v2) == (k, v)]
        ]
        if fits:
            out[(t, c, role)] = ("REUSED", *min(fits, key=lambda kv: (kv[0], kv[1] or "")))
        else:
            left.append((t, c, role, fn, key))
    owners = defaultdict(set)
    for _, _, _, fn, key in left:
        owners[key].add(fn)
    for t, c, role, fn, key in left:
        wrong = len(owners[key]) > 1 or (key in governed and governed[key][1] != tags.DESCRIPTION + fn)
        other = [1 for t2, c2, _, _, k2 in left if t2 == t and k2 == key and c2 != c] + [
            1 for col, k, _ in by_table[t] if k == key and col != c
        ]
        skipped = role == "row_filter" and other
        out[(t, c, role)] = ("KEY_ERROR" if wrong else "SKIPPED" if skipped else "MINTED", key, None)
    return out


def test_tag_resolution(spark):
    requests, assigned, governed = random_world(random.Random(11))
    ddl = f"{schemas._KEY}, column string, role string, function_fqn string, tag_key string"
    asked = frame(spark, [(*t, *rest) for t, *rest in requests], ddl)
    s = state(spark, tags=assigned, governed=[(k, v, d) for k, (v, d) in governed.items()])
    for prefer in (True, False):
        found = tags.resolve_tags(asked, s.column_tags, s.governed_tags, prefer_existing=prefer).collect()
        got = {((r.catalog, r.schema, r.table), r.column, r.role): (r.resolution, r.tag_key, r.tag_value) for r in found}
        want = resolve_by_loop(requests, assigned, governed, prefer)
        assert len(found) == len(want)
        assert got == want
        if prefer:
            assert {v[0] for v in want.values()} == {"REUSED", "MINTED", "SKIPPED", "KEY_ERROR"}


def test_decisions_and_outcomes(spark):
    """Every combination of old rule, policy, function and failure, in every phase."""
    cases = [
        (old, pol, fun, fail)
        for old in (True, False)
        for pol in ("none", "same", "other", "listed")
        for fun in ("fine", "gone", "forbidden")
        for fail in (None, "tag", "create", "verify", "remove", "remain")
        if old or pol in ("same", "other")
    ]
    key = lambda i: ("cat", "sch", f"t{i}")
    fn = lambda i: f"cat.sch.f{i}"
    filters = [(key(i), fn(i), ["x"]) for i, c in enumerate(cases) if c[0]]
    calls = {"same": fn, "other": lambda i: "cat.sch.z", "listed": lambda i: None}
    policies = [
        (f"TABLE `cat`.`sch`.`t{i}`", "abac_migrated_row_filter", "ROW_FILTER", calls[c[1]](i), [], [], None, [], [], "")
        for i, c in enumerate(cases) if c[1] != "none"
    ]
    functions = [(fn(i), c[2] == "fine") for i, c in enumerate(cases) if c[2] != "gone"]
    s = state(spark, filters=filters, policies=policies, functions=functions)
    existing = frame(
        spark,
        [(*key(i), "ROW_FILTER", None, "abac_migrated_row_filter", calls[c[1]](i)) for i, c in enumerate(cases) if c[1] in ("same", "other")],
        f"{schemas._KEY}, object_type string, masked_column string, policy_name string, function_fqn string",
    )
    planned = plan_objects(s.row_filters, s.masks, existing, s.policies, s.functions)
    bad = frame(
        spark,
        [(*key(i), c[3] == "tag", c[3] == "create", None, None, c[3] == "verify", "boom" if c[3] == "remove" else None, c[3] == "remain")
         for i, c in enumerate(cases)],
        f"{schemas._KEY}, tag_missing boolean, create_failed boolean, create_error_code string, create_error_message string, "
        "verify_failed boolean, removal_error string, legacy_remains boolean",
    )
    none = F.array().cast("array<string>")
    ready = (
        with_faults(planned, None)
        .drop("create_failed", "create_error_code", "create_error_message", "verify_failed", "removal_error", "legacy_remains")
        .join(bad, ["catalog", "schema", "table"])
        .withColumns({"match_columns": F.array().cast(f"array<{schemas.MATCH_COLUMN}>"), "policy_type": F.col("object_type"),
                      "using_aliases": none, "target_alias": F.lit(None).cast("string"), "to_principals": none,
                      "except_principals": none, "comment": F.lit("")})
    )

    def expected(case, phase, dry):
        old, pol, fun, fail = case
        if not old:
            return "ALREADY_MIGRATED", None
        if fun == "gone":
            return "FAILED", "SOURCE_FUNCTION_NOT_FOUND"
        if fun == "forbidden":
            return "FAILED", "SOURCE_FUNCTION_NOT_ACCESSIBLE"
        if pol == "other":
            return "NOT_ELIGIBLE", "EXISTING_ABAC_POLICY_CONFLICT"
        if phase == "FINALIZE":
            if pol != "same":
                return "NOT_ELIGIBLE", "ABAC_NOT_APPLIED_YET"
            if fail == "verify":
                return "FAILED", "POLICY_VERIFY_FAILED"
            if dry:
                return "WOULD_FINALIZE", None
        else:
            if fail == "tag":
                return "FAILED", "RLS_TAG_COLLISION_UNRESOLVABLE"
            if dry:
                return ("WOULD_MIGRATE" if phase == "FULL" else "WOULD_APPLY_ABAC"), None
            if fail == "create":
                return "FAILED", "POLICY_CREATE_FAILED"
            if fail == "verify":
                return "FAILED", "POLICY_VERIFY_FAILED"
            if phase == "APPLY_ABAC":
                return "ABAC_APPLIED", None
        if fail == "remove":
            return "FAILED", "LEGACY_REMOVAL_FAILED"
        if fail == "remain":
            return "FAILED", "FINAL_STATE_VERIFY_FAILED"
        return "SUCCESS", None

    for phase in ("FULL", "APPLY_ABAC", "FINALIZE"):
        for dry in (False, True):
            got = {r.table: (r.status, r.error_code) for r in outcomes(ready, phase, dry).select("table", "status", "error_code").collect()}
            assert got == {f"t{i}": expected(c, phase, dry) for i, c in enumerate(cases)}, (phase, dry)
