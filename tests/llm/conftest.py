import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shared_scratch(spark, tmp_path_factory):
    """The folder that a cluster would name in spark.checkpoint.dir."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): two languages, near and exact copies, shared lines."""
    rng = random.Random(4)
    en = "the of and to in is that for it as was with house river stone walking thing other made light".split()
    de = "der die das und den von zu mit sich des auf ist haus fluss stein gehen ding andere gemacht licht".split()
    rows = []
    for i in range(160):
        lang, words = ("en", en) if i % 2 else ("de", de)
        rows.append([i, prose(rng, rng.randint(12, 90), words) + ".", lang, f"s{i % 5}"])
    for k in range(30):  # near copies of one text, some of them near each other only
        w = rows[1][1].split() + rows[3][1].split()
        for _ in range(k // 6):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
        rows.append([200 + k, " ".join(w), "en", "s0"])
    rows += [[300 + k, rows[7][1], "en", None] for k in range(5)]
    return [(i, t, lang, s, len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls, empty, blank and very long text, ties, and one row twice."""
    long = "the and of to house river " * 20_000
    return [
        (None, None, None, None, None),
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\x0c\r ", None, None, 7),
        (4, "one", "en", "a", 3),
        (5, long, "en", "b", len(long)),
        (6, "😀 é É the of and to house river stone", "en", "b", 40),
        (7, "same text as the next row has it", "en", None, 32),
        (7, "same text as the next row has it", "en", None, 32),
        (8, "same text as the next row has it", "en", "é", 32),
    ]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, DOCS)
    extra = ["score", "kept", "size", "n", "part", "sid", "pattern", "held_out", "predicted", "w", "base", "found", "candidates", "h", "doc", "order"]
    return df.withColumns({c: F.lit("x") for c in extra}).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
