"""Language of whole texts: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's vector is the mean embedding of its hashed subwords: runs of two to
four bytes within a word, the word's edges marked.  Training is stochastic
gradient descent in numpy on a bounded sample; since the model is linear in the
subwords, scoring looks up one row of logits per subword and takes the mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import bounded_sample, crc_mod
from tablewarden.llm.tokens import LETTER, Chunk, chunks

UNDETERMINED = "und"
HAS_LETTER = r"\p{L}"
# Characters of a word that count as one when words are drawn.
PIECE = 64


@dataclass(frozen=True)
class LangIdOptions:
    """``per_class`` rows of each language and ``words`` words of each row bound the training sample."""

    buckets: int = 1 << 16
    dim: int = 16
    per_class: int = 900
    words: int = 60
    epochs: int = 5
    rate: float = 4.0
    batch: int = 32
    kept_error: float = 0.01
    rejected_share: float = 0.01


@dataclass
class LangIdModel:
    """``table[bucket]`` has a logit per class, and 1 if training met the bucket.

    ``temperature`` calibrates the softmax.  Texts below ``least`` probability, or
    with less than ``least_known`` of their subwords met in training, are rejected.
    """

    classes: list[str]
    table: np.ndarray
    temperature: float
    least: float
    least_known: float = 0.0

    def predict(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, one row per text, even where no subword is known; and the share of known subwords."""
        rows = [_mean_rows(c, self.table) for c in chunks(texts)]
        mean = np.concatenate(rows) if rows else np.zeros((0, self.table.shape[1]))
        return softmax(mean[:, :-1] / self.temperature), mean[:, -1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _subwords(chunk: Chunk, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and place of the subwords of each length, in order of place."""
    inside = LETTER[chunk.bytes]
    b = np.where(inside, chunk.bytes, np.uint8(0x20)).astype(np.uint32)
    b = np.concatenate(([np.uint32(0x20)], b))
    inside = np.concatenate(([False], inside))
    for n in (2, 3, 4):
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ b[k : k + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        whole = inside[:m] | inside[1 : m + 1] if n == 2 else inside[1 : m + 1] & inside[n - 2 : m + n - 2]
        at = np.flatnonzero(whole)
        yield (h[at] & np.uint32(buckets - 1)).astype(np.int64), at


def _mean_rows(chunk: Chunk, table: np.ndarray) -> np.ndarray:
    total = np.zeros((len(chunk.starts), table.shape[1]))
    n = np.zeros(len(chunk.starts))
    for bucket, at in _subwords(chunk, len(table)):
        edges = np.append(np.searchsorted(at, chunk.starts), len(at))
        sums = np.zeros((len(at) + 1, table.shape[1]))
        np.cumsum(table[bucket], axis=0, dtype=np.float64, out=sums[1:])
        total += np.diff(sums[edges], axis=0)
        n += np.diff(edges)
    return total / np.maximum(n, 1)[:, None]


def train(texts: list[bytes], langs: list[str], options: LangIdOptions = LangIdOptions()) -> LangIdModel:
    """Fit on four fifths of the rows, calibrate on the rest.

    Every text is also learnt from its first and last three words alone, so that
    short texts are within what the model has seen.  The temperature is the one
    of least loss on the other fifth; ``least`` is the smallest probability at
    which at most ``kept_error`` of what is kept there is wrong, but rejects at
    most ``rejected_share`` of that fifth (labels may be what is wrong, not the
    guess), and is never below an even choice between two languages.  ``least_known`` is half of what all but
    one in a hundred of them have: a text of another script or language falls short of it.
    """
    classes = sorted(set(langs))
    if not classes:
        return LangIdModel([], np.zeros((options.buckets, 1), np.float32), 1.0, 1.0)
    y = np.array([classes.index(x) for x in langs])
    rng = np.random.default_rng(5)
    order = rng.permutation(len(texts))
    tuning, fitting = order[: len(order) // 5], order[len(order) // 5 :]
    examples, labels = [], []
    for i in fitting:
        w = texts[i].split()
        for part in [w] if len(w) < 6 else [w, w[:3], w[-3:]]:
            found = np.concatenate([x for x, _ in _subwords(Chunk([0], [b" ".join(part)]), options.buckets)] or [np.zeros(0, np.int64)])
            if len(found):
                examples.append(found)
                labels.append(y[i])
    labels = np.array(labels, np.int64)
    k = len(classes)
    embedding = rng.normal(0, 1 / options.dim, (options.buckets, options.dim)).astype(np.float32)
    weights = rng.normal(0, 0.5, (options.dim, k)).astype(np.float32)
    seen = np.zeros(options.buckets, bool)
    steps = max(1, options.epochs * len(examples) // options.batch)
    step = 0
    for _ in range(options.epochs):
        for part in np.array_split(rng.permutation(len(examples)), max(1, len(examples) // options.batch)):
            if not len(part):
                continue
            rate = options.rate * max(0.05, 1 - step / steps)
            step += 1
            flat = np.concatenate([examples[i] for i in part])
            sizes = np.array([len(examples[i]) for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            seen[flat] = True
            mean = np.add.reduceat(embedding[flat], np.append(0, np.cumsum(sizes)[:-1]), axis=0) / sizes[:, None]
            error = softmax(mean @ weights)
            error[np.arange(len(part)), labels[part]] -= 1
            error /= len(part)
            back = (error @ weights.T / sizes[:, None] * rate).astype(np.float32)
            weights -= (rate * mean.T @ error).astype(np.float32)
            # a subword's step is as large as if its text were one subword, hence the factor of the mean size
            np.subtract.at(embedding, flat, back[owner] * np.float32(8))
    embedding[~seen] = 0
    model = LangIdModel(classes, np.column_stack([embedding @ weights, seen.astype(np.float32)]), 1.0, 0.0)
    if len(tuning):
        p, known = model.predict([texts[i] for i in tuning])
        z = np.log(np.maximum(p, 1e-12))
        model.least_known = float(np.quantile(known, 0.01)) / 2
        right = y[tuning]
        losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), right], 1e-12)).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
        model.temperature = min(losses, key=losses.__getitem__)
        p = softmax(z / model.temperature)
        top, wrong = p.max(axis=1), p.argmax(axis=1) != right
        down = np.argsort(-top, kind="stable")
        error = np.cumsum(wrong[down]) / np.arange(1, len(down) + 1)
        good = np.flatnonzero(error <= options.kept_error)
        model.least = float(top[down[good[-1]]]) if len(good) else 1.0
        if len(good) == len(down):  # nothing measured speaks for a higher bar
            model.least = 0.0
        # wrong labels lie at any confidence, so the error alone may put the bar anywhere
        model.least = min(model.least, float(np.quantile(top, options.rejected_share, method="lower")))
    model.least = max(model.least, 0.5 if k > 1 else 0.0)
    return model


def fit(docs: DataFrame, may_learn: Column, options: LangIdOptions = LangIdOptions()) -> LangIdModel:
    """Train on a bounded sample of the rows of *docs* (doc_id, text, lang) where *may_learn* and lang is known.

    A row gives about ``words`` words from all over its text: every k-th, from a place that its hash names.
    """
    named = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike(HAS_LETTER)).select("doc_id", "text", "lang")
    spaced = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # long words, whole paragraphs in some scripts, count as several
    pieces = F.flatten(F.transform(spaced, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / PIECE).cast("int")), lambda i: F.substr(w, i * PIECE + 1, F.lit(PIECE)))))
    every = F.greatest(F.lit(1), (F.size("_w") / options.words).cast("int"))
    rows = (
        bounded_sample(named, "lang", options.per_class, ["doc_id", "text"])
        .select("lang", F.xxhash64("doc_id", "text").alias("_h"), pieces.alias("_w"))
        .select("lang", "_h", F.array_join(F.filter("_w", lambda w, i: i % every == F.pmod("_h", every)), " ").alias("text"))
        .distinct()
        .toPandas()
        .sort_values(["_h", "lang", "text"])
    )
    return train([t.encode() for t in rows["text"]], rows["lang"].tolist(), options)


def identify(docs: DataFrame, model: LangIdModel) -> DataFrame:
    """*docs* with ``lang_pred``, ``score`` (calibrated probability) and ``rejected``.

    Text that is null or holds no letter is ``und`` with score 0 and rejected, as
    is everything where no language was learnt; so is a text whose best language
    has a calibrated probability below ``model.least``, or whose subwords the
    training hardly met; its guess stays.
    Columns of *docs* keep their values; those three names must be free.
    """
    clash = {"lang_pred", "score", "rejected"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.classes, UNDETERMINED], object)
        for texts in batches:
            if m.classes:
                p, known = m.predict(texts.tolist())
                best, score = p.argmax(axis=1), p.max(axis=1)
                rejected = (score < m.least) | (known < m.least_known)
            else:
                best, score, rejected = np.full(len(texts), -1), np.zeros(len(texts)), True
            yield pd.DataFrame({"lang_pred": names[best], "score": score, "rejected": rejected})

    guess = F.pandas_udf(predict, "lang_pred string, score double, rejected boolean")
    lettered = F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False))
    g = docs.select("*", lettered.alias("_lettered"), guess(F.lower("text").cast("binary")).alias("_g"))
    return g.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("_lettered"), F.col("_g.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("_lettered"), F.col("_g.score")).otherwise(0.0).alias("score"),
        (~F.col("_lettered") | F.col("_g.rejected")).alias("rejected"),
    )


def op5(docs: DataFrame, options: LangIdOptions = LangIdOptions()) -> DataFrame:
    """Language of every document; learnt from those whose crc32(doc_id) mod 3 is not 1.

    Returns doc_id, held_out, lang_pred, score, rejected, one row per row of
    *docs*.  Null ids count as empty text.  Without any labelled row all is ``und``.
    """
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out, options)
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
