"""Toxicity of whole texts: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and pairs with one word
between, hashed into ``buckets``.  Follow-the-regularised-leader keeps a rate
for each coordinate and an L1 penalty that leaves most weights at exactly zero,
so that what the tasks get is a short list of (bucket, weight).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import bounded_sample, crc_mod, even_choice
from tablewarden.llm.tokens import Chunk, chunks, letters, runs

# Tokens of a feature, by distance from its first: words, pairs, pairs with one word between.
GRAMS = ((0,), (0, 1), (0, 2))


@dataclass(frozen=True)
class FtrlOptions:
    """``per_class`` labelled rows of each class bound the training sample; ``row_features`` what one row may teach."""

    buckets: int = 1 << 20
    per_class: int = 2500
    row_features: int = 8192
    epochs: int = 5
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0


@dataclass
class SparseModel:
    """A bias and the weights that are not zero, by rising bucket."""

    buckets: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(self.buckets)
        w[self.index] = self.weight
        return w


def _positions(chunk: Chunk, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of every occurrence of a feature."""
    t = letters(chunk)
    owner = np.repeat(np.arange(len(t.n)), t.n)
    for grams in GRAMS:
        h = runs(t.hash, grams)
        reach = grams[-1]
        same = owner[: len(h)] == owner[reach : reach + len(h)]
        at = np.flatnonzero(same)
        yield (h[at] & np.uint64(buckets - 1)).astype(np.int64), owner[at]


def features(texts: list[bytes | None], buckets: int) -> list[np.ndarray]:
    """Each text's distinct feature buckets, rising."""
    out = []
    for c in chunks(texts):
        found = list(_positions(c, buckets))
        bucket = np.concatenate([b for b, _ in found])
        owner = np.concatenate([o for _, o in found])
        pairs = np.unique(owner * buckets + bucket)
        edges = np.searchsorted(pairs, np.arange(len(c.rows) + 1) * buckets)
        out += [pairs[a:z] % buckets for a, z in zip(edges[:-1], edges[1:], strict=True)]
    return out


def score(texts: list[bytes | None], model: SparseModel, dense: np.ndarray) -> np.ndarray:
    """Probability of label 1: the weights of a text's distinct features, added up."""
    out = []
    for c in chunks(texts):
        hits = []
        for bucket, owner in _positions(c, model.buckets):
            there = np.flatnonzero(dense[bucket])
            hits.append(owner[there] * model.buckets + bucket[there])
        pairs = np.unique(np.concatenate(hits))
        z = np.bincount(pairs // model.buckets, dense[pairs % model.buckets], len(c.rows))
        out.append(1 / (1 + np.exp(-np.clip(z + model.bias, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def train(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, options: FtrlOptions = FtrlOptions()) -> SparseModel:
    """FTRL-proximal over *rows* of buckets; *weights* say how many labelled rows each stands for.

    The bias is one more coordinate without penalty.  Rows come in a fixed random
    order, so that the model is the same at every run.  Without rows the model
    has no weights and gives 0.5.
    """
    z, n = np.zeros(options.buckets + 1), np.zeros(options.buckets + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        l1 = np.where(i == options.buckets, 0.0, options.l1)
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((options.beta + np.sqrt(n[i])) / options.alpha + np.where(i == options.buckets, 0.0, options.l2))
        return np.where(np.abs(zi) <= l1, 0.0, w)

    rng = np.random.default_rng(11)
    for _ in range(options.epochs):
        for r in rng.permutation(len(rows)):
            i = np.append(rows[r], options.buckets).astype(np.int64)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = (p - labels[r]) * weights[r]
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / options.alpha * w
    met = np.flatnonzero(n[:-1])
    final = weight(met)
    bias = float(weight(np.array([options.buckets]))[0])
    return SparseModel(options.buckets, bias, met[final != 0], final[final != 0])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, options: FtrlOptions = FtrlOptions()) -> SparseModel:
    """Train on a bounded sample of the rows of *docs* (doc_id, text) that *labels* (doc_id, toxic) covers.

    *may_learn* is a condition on doc_id.  A document that is labelled twice with the same label counts once; rows whose
    two labels differ teach both.  Features are made in the tasks, from whole texts.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).where(may_learn).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # the options bound the sample, so it may be broadcast: the texts are read in place
    drawn = bounded_sample(known, "toxic", options.per_class, ["doc_id"])
    named = docs.where(may_learn).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").distinct()

    def to_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = features(pdf["text"].tolist(), options.buckets)
            # a row with more features teaches an even choice of them, another one in each row
            found = [even_choice(f, int(h), options.row_features).astype(np.int32) for f, h in zip(found, pdf["h"], strict=True)]
            yield pd.DataFrame({"h": pdf["h"], "toxic": pdf["toxic"], "f": found})

    rows = (
        named.select(F.xxhash64("doc_id", "text").alias("h"), "toxic", F.col("text").cast("binary").alias("text"))
        .mapInPandas(to_features, "h long, toxic int, f array<int>")
        .toPandas()
        .sort_values(["h", "toxic"], kind="stable")
    )
    y = rows["toxic"].to_numpy()
    # rare classes are sampled more densely; weights put the proportions back
    share = {c: max(1.0, n / max(1, (y == c).sum())) for c, n in totals.items()}
    least = min(share.values(), default=1.0)
    return train(rows["f"].tolist(), y, np.array([share[c] / least for c in y]), options)


def toxicity(docs: DataFrame, model: SparseModel) -> DataFrame:
    """*docs* with ``score`` and ``predicted``; null and empty texts get the bias alone.

    Columns of *docs* keep their values; those two names must be free.
    """
    clash = {"score", "predicted"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = shared.value.dense()
        for texts in batches:
            yield pd.Series(score(texts.tolist(), shared.value, dense))

    scored = docs.withColumn("score", F.pandas_udf(run, "double")(F.col("text").cast("binary")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3(docs: DataFrame, labels: DataFrame, options: FtrlOptions = FtrlOptions()) -> DataFrame:
    """Toxicity of every document; labels are learnt where crc32(doc_id) mod 5 is not 0.

    Returns doc_id, held_out, score, predicted, one row per row of *docs*.  Null
    ids count as empty text and have no label.  Without labels every score is 0.5.
    """
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = fit(docs, labels, ~held_out, options)
    return toxicity(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
