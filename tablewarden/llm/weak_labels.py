"""Quality by weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Labellers vote good, bad or nothing on every document.  Documents with the same
votes are one pattern; the counts of patterns over the whole corpus (at most
3 to the number of labellers) are all that expectation-maximisation needs to
estimate how each labeller votes on good and on bad documents.  The posterior of
a document's pattern is its label, and those labels train a linear scorer over
hashed words and shape features, which sees what the labellers do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import Scratch, bounded_sample, even_choice
from tablewarden.llm.tokens import LETTER, Chunk, chunks, letters, runs, words

BAD, NOTHING, GOOD = 0, 1, 2
VOTES = 3


@dataclass(frozen=True)
class Labeller:
    """Votes bad or good where ``metric`` lies in an interval [from, to); nothing elsewhere."""

    metric: str
    bad: tuple[tuple[float, float], ...]
    good: tuple[tuple[float, float], ...]

    def votes(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), NOTHING)
        for value, ranges in ((GOOD, self.good), (BAD, self.bad)):
            for low, high in ranges:
                out[(x >= low) & (x < high)] = value
        return out


_INF = float("inf")
LABELLERS = (
    Labeller("n_words", ((0, 12),), ((40, _INF),)),
    Labeller("symbol_share", ((0.08, _INF),), ((0, 0.02),)),
    Labeller("bare_share", ((0.15, _INF),), ((0, 0.03),)),  # words without a letter, such as rules of tables
    Labeller("variety", ((0, 1.5),), ((3, _INF),)),  # distinct words over the root of twice the words
    Labeller("repeat_share", ((0.25, _INF),), ((0, 0.05),)),  # five-word windows seen earlier in the text
    Labeller("short_share", ((0, 0.05), (0.9, _INF)), ((0.12, 0.7),)),  # words of one to three letters
    Labeller("word_chars", ((0, 2.5), (10, _INF)), ((3.5, 8),)),
    Labeller("stop_share", ((0, 0.01),), ((0.03, 0.3),)),  # sentence ends per word
    Labeller("marked_share", ((0.3, _INF),), ((0, 0.05),)),  # words that hold a symbol
)
METRICS = tuple(x.metric for x in LABELLERS)
# What a labeller says (bad, nothing, good) of a bad and of a good document, before any is seen: each knows one
# fault of many and so praises half of the bad, but seldom blames a good one.
BELIEF = ((0.30, 0.20, 0.50), (0.01, 0.09, 0.90))


@dataclass(frozen=True)
class WeakOptions:
    """``per_class`` documents of each side of the posterior bound the scorer's sample, ``row_features`` each of them."""

    rounds: int = 50
    prior: float = 0.3
    buckets: int = 1 << 18
    per_class: int = 2500
    row_features: int = 4096
    epochs: int = 4
    rate: float = 0.3
    l2: float = 1e-6


def measure(chunk: Chunk) -> np.ndarray:
    """One row of metrics per text; all are 0 without words."""
    t = words(chunk)
    b = chunk.bytes
    n = np.maximum(t.n, 1)
    owner = np.repeat(np.arange(len(t.n)), t.n)

    def per_text(flag: np.ndarray) -> np.ndarray:
        return np.bincount(owner, flag, len(t.n))

    started = (b < 0x80) | (b >= 0xC0)  # first bytes of characters
    symbol = np.isin(b, np.frombuffer(b"#*$%&|<>{}[]\\^~=_@", np.uint8))
    stop = np.isin(b, np.frombuffer(b".!?", np.uint8))
    lettered = LETTER[b]

    def within(flag: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag))
        return total[t.ends] - total[t.starts]

    chars, alpha = within(started), within(lettered & started)
    out = np.zeros((len(t.n), len(METRICS)))
    shape = runs(t.hash, (0, 1, 2, 3, 4))
    for i, (a, z) in enumerate(zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True)):
        if z > a:
            out[i, 3] = len(np.unique(t.hash[a:z])) / np.sqrt(2 * (z - a))
        if z - a >= 5:
            w = shape[a : z - 4]
            out[i, 4] = 1 - len(np.unique(w)) / len(w)
    out[:, 0] = t.n
    symbols = within(symbol)
    out[:, 1] = per_text(symbols) / np.maximum(per_text(chars), 1)
    out[:, 2] = per_text(alpha == 0) / n
    out[:, 5] = per_text((alpha > 0) & (alpha <= 3)) / n
    out[:, 6] = per_text(chars) / n
    out[:, 7] = per_text(within(stop) > 0) / n
    out[:, 8] = per_text(symbols > 0) / n
    out[t.n == 0] = 0
    return out


def patterns(metrics: np.ndarray) -> np.ndarray:
    """The votes of all labellers as one number in base three."""
    code = np.zeros(len(metrics), np.int64)
    for j, labeller in enumerate(LABELLERS):
        code = code * VOTES + labeller.votes(metrics[:, j])
    return code


def votes_of(codes: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return np.stack([codes // VOTES ** (n - 1 - j) % VOTES for j in range(n)], axis=1)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, options: WeakOptions = WeakOptions()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of good per pattern, vote tables (labeller, class, vote) and class shares.

    Starts from the vote with the fewest doubts: good where nothing says bad.  The
    estimates lean on ``BELIEF`` as if it had been seen on ``prior`` times the
    corpus, which keeps the two classes from changing places, and from splitting
    the corpus along something else that its documents have in common.
    """
    m = votes.shape[1]
    good = np.where((votes == BAD).any(axis=1), 0.2, 0.9)
    tables, share = np.zeros((m, 2, VOTES)), np.array([0.5, 0.5])
    lean = options.prior * counts.sum() * np.array(BELIEF)
    for _ in range(options.rounds if len(votes) else 0):
        weight = np.stack([(1 - good) * counts, good * counts])
        share = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        logs = np.log(share)[None, :].repeat(len(votes), axis=0)
        for j in range(m):
            cells = np.stack([np.bincount(votes[:, j], w, VOTES) for w in weight]) + lean
            tables[j] = cells / cells.sum(axis=1, keepdims=True)
            logs += np.log(tables[j][:, votes[:, j]]).T
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return good, tables, share


@dataclass
class Scorer:
    buckets: int
    weight: np.ndarray
    shape_weight: np.ndarray
    bias: float


def _shape(metrics: np.ndarray) -> np.ndarray:
    """Metrics on scales that a linear model can use."""
    x = np.column_stack([np.log1p(metrics[:, 0]) / 5, np.minimum(metrics[:, 1:], 20)])
    x[:, [3, 6]] /= 5
    return np.column_stack([x, x**2])


def _hashed(chunk: Chunk, buckets: int) -> list[np.ndarray]:
    t = letters(chunk)
    h = (t.hash & np.uint64(buckets - 1)).astype(np.int64)
    return [np.unique(h[a:z]) for a, z in zip(t.first[:-1], t.first[1:], strict=True)]


def train(rows: list[np.ndarray], metrics: np.ndarray, target: np.ndarray, options: WeakOptions = WeakOptions()) -> Scorer:
    """Logistic regression on posterior labels by stochastic gradient descent, in a fixed order; adaptive rates per weight.

    A word counts 1 / sqrt(distinct words of its text).  Without rows all scores are 0.5.
    """
    s = Scorer(options.buckets, np.zeros(options.buckets), np.zeros(2 * len(METRICS)), 0.0)
    if not rows:
        return s
    shape = _shape(metrics)
    g2, gs2, gb2 = np.full(options.buckets, 1e-4), np.full(shape.shape[1], 1e-4), 1e-4
    rng = np.random.default_rng(23)
    for _ in range(options.epochs):
        for i in rng.permutation(len(rows)):
            f = rows[i]
            scale = 1 / np.sqrt(max(1, len(f)))
            z = s.bias + shape[i] @ s.shape_weight + scale * s.weight[f].sum()
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[i]
            g2[f] += (e * scale) ** 2
            s.weight[f] -= options.rate * (e * scale / np.sqrt(g2[f]) * 0.1 + options.l2 * s.weight[f])
            gs2 += (e * shape[i]) ** 2
            s.shape_weight -= options.rate * e * shape[i] / np.sqrt(gs2)
            gb2 += e * e
            s.bias -= options.rate * e / np.sqrt(gb2)
    return s


def score(texts: list[bytes | None], scorer: Scorer) -> np.ndarray:
    """Probability of good; a text without words scores as the metrics of nothing do."""
    out = []
    for c in chunks(texts):
        shape = _shape(measure(c))
        z = shape @ scorer.shape_weight + scorer.bias
        z += [scorer.weight[f].sum() / np.sqrt(max(1, len(f))) for f in _hashed(c, scorer.buckets)]
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def classify(docs: DataFrame, options: WeakOptions = WeakOptions(), scratch: Scratch | None = None) -> DataFrame:
    """doc_id, pattern, posterior, score and kept (score >= 0.5) of every row of *docs* (doc_id, text).

    Null text is empty: every labeller that has an opinion on nothing says bad,
    and ``kept`` is false.  Equal texts get equal rows; other columns are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def to_patterns(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [patterns(measure(c)) for c in chunks(texts)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0, np.int64))

    # a few numbers a row are written, so that votes are taken once
    key = F.xxhash64("doc_id", "text").alias("h")
    voted = (scratch or Scratch(spark)).write(docs.select(key, F.pandas_udf(to_patterns, "long")("text").alias("pattern")), "voted")
    counted = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    codes = counted["pattern"].to_numpy(np.int64)
    posterior, _, _ = expectation_maximisation(votes_of(codes), counted["n"].to_numpy(float), options)
    table = np.full(VOTES ** len(LABELLERS), 0.5)  # by pattern, of a size that the number of labellers fixes
    table[codes] = posterior
    shared_table = spark.sparkContext.broadcast(table)

    def to_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in chunks(pdf["text"]):
                rows = _hashed(c, options.buckets)
                rows = [even_choice(f, int(h), options.row_features) for f, h in zip(rows, pdf["h"].iloc[c.rows], strict=True)]
                m = measure(c)
                yield pd.DataFrame({"h": pdf["h"].iloc[c.rows].to_numpy(), "m": list(m), "y": shared_table.value[patterns(m)], "f": [f.astype(np.int32) for f in rows]})

    good = F.col("pattern").isin([int(c) for c, p in zip(codes, posterior, strict=True) if p >= 0.5])
    # two bounded sides, so the sample may be broadcast: the texts are read in place
    sample = bounded_sample(voted.withColumn("side", good.cast("int")), "side", options.per_class, ["h"]).select("h").distinct()
    rows = (
        docs.select(key, "text")
        .join(F.broadcast(sample), "h")
        .distinct()
        .mapInPandas(to_rows, "h long, m array<double>, y double, f array<int>")
        .toPandas()
        .sort_values("h", kind="stable")
    )
    scorer = train([np.asarray(f, np.int64) for f in rows["f"]], np.stack(rows["m"].tolist()) if len(rows) else np.zeros((0, len(METRICS))), rows["y"].to_numpy(), options)
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [patterns(measure(c)) for c in chunks(texts)]
            code = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pd.DataFrame({"pattern": code, "posterior": shared_table.value[code], "score": score(texts.tolist(), shared.value)})

    scored = docs.select("doc_id", F.pandas_udf(run, "pattern long, posterior double, score double")("text").alias("s")).select("doc_id", "s.*")
    return scored.withColumn("kept", F.col("score") >= 0.5)


def op1(docs: DataFrame, options: WeakOptions = WeakOptions()) -> DataFrame:
    """``classify`` over all documents."""
    return classify(docs, options)
