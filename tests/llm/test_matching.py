"""Near duplicates, decontamination and components against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import decontaminate, jaccard_join
from tablewarden.llm.common import Scratch, hash_filter, passes
from tablewarden.llm.components import components
from tablewarden.llm.jaccard_join import JoinOptions


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def brute_join(rows, percent=80):
    def shingle(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[shingle(t)].append(i)
    sets = [s for s in ids if s]
    edges = [(a, b) for a, b in combinations(sets, 2) if 100 * len(a & b) >= percent * len(a | b)]
    root = roots(sets, edges)
    least = {}
    for s, r in root.items():
        least[r] = min([least.get(r, 1 << 60), *(i for i in ids[s] if i is not None)])
    return sorted(((i, len(s), least[root[s]] if s else i) for s, own in ids.items() for i in own), key=str)


def joined(df, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df, JoinOptions(**options)).collect()), key=str)


# Small lists, blocks and filters make every skip happen on a small corpus.
@pytest.mark.parametrize("options", [{}, {"list_rows": 4, "block": 2, "short": 2, "heavy_least": 2, "heavy_share": 64, "filter_bits": 4}])
def test_join_equals_brute_force(docs, corpus, options):
    assert joined(docs, **options) == brute_join(corpus)


def test_groups_around_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(rng.randint(30, 60))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
            if rng.random() < 0.3:
                w = w[: -rng.randint(1, 8)]
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + k, " ".join(f"c{j}" for j in range(12)) + f" own{k} a{k} b{k} d{k} e{k} f{k} g{k}") for k in range(40)]  # one passage in many
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert joined(df, list_rows=8, block=4, heavy_least=3, heavy_share=32) == brute_join(rows)


def test_join_of_odd_rows(odd, odd_rows, none):
    assert joined(odd) == brute_join(odd_rows)
    assert jaccard_join.op9(none).count() == 0


def test_bounds_hold_for_all_small_sizes():
    for a in range(1, 40):
        for b in range(1, 40):
            for o in range(0, min(a, b) + 1):
                assert (100 * o >= 80 * (a + b - o)) == (o >= jaccard_join.least_overlap(a, b, 80))


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 90, dtype=np.uint64)
        a, b = (np.unique(pool[: int(rng.integers(1, 90))]), np.unique(pool[int(rng.integers(0, 60)) :]))
        x, y = jaccard_join.parity_bitmap(a), jaccard_join.parity_bitmap(b)
        w = min(len(x), len(y))
        apart = np.bitwise_count(jaccard_join.fold(x[None], w) ^ jaccard_join.fold(y[None], w)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_skipped_blocks_lose_no_pair():
    rng = np.random.default_rng(3)
    o = JoinOptions(block=3)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(2, 40)), dtype=np.uint64)) for _ in range(40)]
    n = np.array([len(s) for s in sets])
    a, b = jaccard_join.list_pairs(n, np.zeros(40, int), np.arange(40), np.zeros(40, int), [jaccard_join.parity_bitmap(s).tobytes() for s in sets], False, o)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i, j in combinations(range(40), 2) if len(np.intersect1d(sets[i], sets[j])) >= jaccard_join.least_overlap(n[i], n[j], 80)}
    assert want <= got


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 180)] + [(5, k) for k in range(6, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges += [(1, 1), (5, 6), (6, 5)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    want = roots(nodes, [e for e in edges if e[0] != e[1]])
    assert set(got) == nodes
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a, b in combinations(sorted(nodes), 2))


def test_hash_filter(spark):
    h = np.random.default_rng(0).integers(0, 2**64, 500, dtype=np.uint64)
    packed = hash_filter(spark.createDataFrame([(int(x),) for x in h[:100].view(np.int64)], "k long"), "k", 16)
    got = passes(packed, h, 16)
    assert got[:100].all() and got[100:].sum() < 10
    assert (got == np.isin(h >> np.uint64(48), h[:100] >> np.uint64(48))).all()


# -- decontamination ---------------------------------------------------------------------------------------------

QUESTION = "If Anna has 12 apples and gives 5 kg of them to Bob, how many apples does Anna still have in the end?"


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame([(1, QUESTION), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, "Intro. " + QUESTION + " Outro."),
            (2, "If Maria has 77 apples and gives 9.5 lbs of them to Ken, how many apples does Maria still have in the end?"),
            (3, "If Maria has 77 apples and gives 9 lbs of them to Ken, how many apples does Zoe still have in the end?"),
            (4, "If Bob has 1 apples and gives 2 kg of them to Bob, how many apples does Bob still have in the end?"),
            (5, QUESTION.upper()),
            (6, "if anna has 12 apples and gives some away"),
        ],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: (r["item_id"], r["exact"], r["n_covered"]) for r in decontaminate.op7(docs, bench).collect()}
    assert got[1] == (1, True, 23) and got[2] == (1, False, 23)
    # Zoe for Anna, or one name for two, is another question: what is consistent is too little
    assert set(got) <= {1, 2, 3} and (3 not in got or got[3][2] < 23)
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert {1, 2} & kept == set() and {4, 6} <= kept


def test_copies_with_few_words_and_names_that_open_sentences(spark):
    items = [
        "What is 12 * 15 + 37 - 18 / 3 + 4?",
        "Sort these numbers: 4, 9, 2, 7, 1, 8, 3, 6, 5, 11, 12, 14, 10.",
        "Find the sum of 3, 5, 8, 13, 21 and 34.",
        "Tom has 5 apples. Tom buys 3 more. Tom gives 2 to Ann. How many does Tom have now?",
        "The Blue train carries 40 people and stops at 6 places. How many people ride The Blue train then?",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(i, f"Some words first. {t} And some after.") for i, t in enumerate(items)]
    docs += [(13, "Kim has 9 apples. Kim buys 4 more. Kim gives 7 to Joe. How many does Kim have now?"), (14, "the house in The Hague. " + items[4].replace("40", "77"))]
    docs += [(20, "What is 12 * 15 + 37 - 18 / 3 + 5?"), (21, "Sort these numbers: 1, 2, 3, 4, 5, 6, 7, 8, 9, 10."), (22, "Kim has 9 apples. Kim buys 4 more. Joe gives 7 to Joe. How many does Ed have now?")]
    got = {(r["doc_id"], r["item_id"]): (r["n_covered"] == r["n_tokens"], r["exact"]) for r in decontaminate.op7(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {**{(i, i): (True, True) for i in range(5)}, (13, 3): (True, False), (14, 4): (True, False)}


def test_a_conflict_costs_only_its_windows(spark):
    copied = "and then the old miller carried every sack of grain over the narrow bridge before the rain began to fall upon the quiet village again that night"
    item = f"Lea has 3 apples and 3 pears in her green basket by the door {copied}, so how much fruit is left?"
    bench = spark.createDataFrame([(1, item), (2, QUESTION)], "item_id long, text string")
    docs = [
        (1, item.replace("3 apples", "5 apples").replace("3 pears", "4 pears")),
        (2, item.replace("3 pears", "4 pears")),
        (3, item.replace("3 apples", "5 apples").replace("3 pears", "4 pears").replace("the quiet", "the other quiet")),
        (4, "If Bob has 1 apples and gives 2 kg of them to Bob, how many apples does Bob still have in the end?"),
    ]
    got = {r["doc_id"]: (r["item_id"], r["n_covered"], r["n_tokens"]) for r in decontaminate.op7(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2, 3} and all(i == 1 and n >= 30 for i, n, _ in got.values())


def brute_leaks(docs, bench, o=decontaminate.LeakOptions()):
    """Coverage by windows, for texts without placeholders."""
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, q in bench:
            q = (q or "").lower().split()
            k = min(len(q), o.window)
            if len(q) < o.least_item:
                continue
            have = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
            covered = {a + j for a in range(len(q) - k + 1) if tuple(q[a : a + k]) in have for j in range(k)}
            if len(covered) >= min(len(q), o.covered):
                out.add((d, i, len(covered)))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ax", "ex", "ix", "ox")]
    bench = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 6, 8, 14, 30])))) for i in range(30)]
    docs = []
    for d in range(120):
        w = [rng.choice(words) for _ in range(60)]
        q = rng.choice(bench)[1].split()
        cut = rng.choice([len(q), len(q), 13, 12, 9])
        w[20:20] = q[:cut]
        docs.append((d, " ".join(w)))
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_covered"]) for r in decontaminate.op7(a, b).collect()}
    assert got == brute_leaks(docs, bench) and len(got) > 40


def test_decontamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "same text as the next row has it"), (1, "other words of the same item are here"), (None, QUESTION), (2, None)], "item_id long, text string")
    got = decontaminate.op7(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(7, 1), (8, 1)}
    assert decontaminate.op7(none, bench).count() == 0
    assert decontaminate.op7(odd, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd, bench).count() == 7


def test_copies_beyond_any_group_size(spark):
    """Many documents with one passage: one row each, nothing paired among themselves."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(QUESTION + " "), F.col("id")).alias("text"))
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert decontaminate.op7(docs, bench).count() == 3000
