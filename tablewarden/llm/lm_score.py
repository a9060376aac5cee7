"""Masked pseudo-likelihood of whole texts under a bidirectional window network.

Every token is predicted from the tokens on both sides of it, itself hidden.
Tokens are hashed to ``buckets``, which keep a token's shape (its first letter's
case, what it ends with, its letters' range and its length); the network gives the probability of the
token's class from the classes around it, and counts over the whole corpus give
the token's share of what the network tells apart:

    log p(token | both sides) = log p(class | both sides) + log p(slot | class, both sides) + log(count / count of the slot)

The frequent tokens of a class have a slot each, the others share slots of about
equal counts by frequency.  With one slot a class, the middle term is 0.

The sum over a text is its pseudo-log-likelihood.  Counts are one distributed
aggregation over all tokens.  The network learns in the tasks, every position of
every text once, dealt over the rounds, and the tasks' networks are averaged
after each, so that what is learnt grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import Scratch
from tablewarden.llm.tokens import Chunk, Tokens, chunks, words


@dataclass(frozen=True)
class LmOptions:
    """``reach`` tokens on either side; ``own`` frequent buckets are classes of their own, the others share a class by shape, told apart in it by ``slots``; each of the ``rounds`` learns its share of all positions."""

    buckets: int = 1 << 20
    classes: int = 96
    own: int = 64
    reach: int = 2
    hidden: int = 24
    rounds: int = 2
    batch: int = 1024
    rate: float = 0.08
    smoothing: float = 0.5
    fan_in: int = 64
    slots: int = 1


# What the query goes by: words are known by class and slot on either side, and a second softmax tells the slots of a shared class apart.
WORDS = LmOptions(slots=32, fan_in=8)


@dataclass
class Vocabulary:
    """Class and slot of every bucket, log of its share of the slot, and of each slot's share of its shared class; sized by the options alone."""

    cls: np.ndarray
    share: np.ndarray
    slot: np.ndarray
    odds: np.ndarray

    def around(self, options: LmOptions) -> np.ndarray:
        """What a bucket is to its neighbours: its class, or its slot in a shared one, numbered beyond the classes and the text's ends."""
        cls = self.cls.astype(np.int64)
        if options.slots > 1:
            cls = np.where(cls < options.own, cls, options.classes + 1 + (cls - options.own) * options.slots + self.slot)
        return cls.astype(np.min_scalar_type(options.classes + (options.classes - options.own) * options.slots))


def _slots(cls: np.ndarray, n: np.ndarray, options: LmOptions) -> np.ndarray:
    """Slots of buckets: half of a class's slots hold its most frequent buckets, one each, ties by bucket; the rest get equal shares of the rest."""
    order = np.lexsort((-n, cls))
    c, mass = cls[order], n[order]
    first = np.searchsorted(c, c)
    rank = np.arange(len(c)) - first
    half = options.slots // 2
    rest = np.where(rank >= half, mass, 0.0)
    total = np.bincount(c, rest, options.classes)
    before = np.cumsum(rest) - rest
    before -= before[first]
    bins = before / np.maximum(total[c], 1e-300) * (options.slots - half)
    slot = np.zeros(len(c), np.uint8)
    slot[order] = np.where(rank < half, rank, half + np.clip(bins, 0, options.slots - half - 1).astype(np.int64))
    return slot


def vocabulary(bucket: np.ndarray, count: np.ndarray, options: LmOptions = LmOptions()) -> Vocabulary:
    """The most frequent buckets are a class each, ties by bucket; the others go by their shape."""
    n = np.zeros(options.buckets)
    n[bucket] = count
    cls = (options.own + np.arange(options.buckets) % (options.classes - options.own)).astype(np.uint8)
    top = np.lexsort((bucket, -count))[: options.own]
    cls[bucket[top]] = np.arange(len(top))
    smooth = n + options.smoothing
    slot = _slots(cls, smooth, options) if options.slots > 1 else np.zeros(options.buckets, np.uint8)
    place = cls.astype(np.int64) * options.slots + slot
    mass = np.bincount(place, smooth, options.classes * options.slots)
    share = np.log(smooth / mass[place]).astype(np.float32)
    by_class = mass.reshape(options.classes, options.slots)[options.own :]
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32)
    return Vocabulary(cls, share, slot, odds)


class Network:
    """hidden = tanh(sum of one vector per side place and class); softmax over classes, and over the slots of a shared class.

    Slots start from *odds*, their shares of their class, which are counted, not learnt.

    All parameters are views of one array.  Class ``classes`` stands for a place beyond the text's ends.
    """

    def __init__(self, options: LmOptions, values: np.ndarray | None = None, odds: np.ndarray | None = None):
        self.options = options
        o = options
        self.sides = [d for d in range(-o.reach, o.reach + 1) if d]
        shared = o.classes - o.own if o.slots > 1 else 0
        known = [(len(self.sides), o.classes + 1 + shared * o.slots, o.hidden), (o.hidden, o.classes), (o.hidden,), (o.classes,)]
        self.odds, self.shapes = odds, [*known, (shared, o.hidden, o.slots), (shared, o.slots)]
        if values is None:
            size = sum(int(np.prod(s)) for s in known)
            values = np.random.default_rng(31).normal(0, 0.1, size).astype(np.float32)
            values = np.append(values, np.zeros(sum(int(np.prod(s)) for s in self.shapes) - size, np.float32))
        self.values, self.memory = values, np.full(len(values), 1e-6, np.float32)
        self.inputs, self.outputs, self.bias, self.prior, self.leaves, self.tilt = self._views(values)
        # all sides as one table of rows, so that a step sorts and changes them at once
        places, codes = self.inputs.shape[:2]
        self.rows, self.seen = (x[: self.inputs.size].reshape(places * codes, o.hidden) for x in (self.values, self.memory))
        self.offsets = (np.arange(places) * codes).astype(np.min_scalar_type(places * codes - 1))[:, None]

    def _views(self, flat: np.ndarray, first: int = 0) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes[first:]:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return out

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Rows of shared classes, those of a class together; each one's class; and the stretch of each class among them."""
        order = np.argsort(target.astype(np.min_scalar_type(self.options.classes)), kind="stable")
        cls = target[order].astype(np.int64) - self.options.own
        ends = np.searchsorted(cls, np.arange(len(self.leaves) + 1))
        order, cls, ends = order[ends[0] :], cls[ends[0] :], (ends - ends[0]).tolist()
        return order, cls, [(c, a, z) for c, (a, z) in enumerate(zip(ends, ends[1:], strict=False)) if z > a]

    def _slot_logits(self, h: np.ndarray, cls: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
        """One column for each row of *h*, which lie by class; the sums over slots then run along whole rows of the result."""
        z = np.empty((self.options.slots, len(h)), np.float32)
        for c, a, b in parts:
            np.matmul(self.leaves[c].T, h[a:b].T, out=z[:, a:b])
        z += (self.tilt + self.odds).T.take(cls, axis=1)
        z -= z.max(axis=0)
        return z

    def _rows_of(self, around: np.ndarray) -> np.ndarray:
        """Rows of the table of all sides, one line a side."""
        return np.add(around.T, self.offsets, order="C", dtype=self.offsets.dtype, casting="unsafe")

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values by position, and logits with one column a position, the greatest of each 0."""
        h = self.rows.take(rows[0], axis=0)
        for side in rows[1:]:
            h += self.rows.take(side, axis=0)
        h += self.bias
        np.tanh(h, out=h)
        z = self.outputs.T @ h.T
        z += self.prior[:, None]
        z -= z.max(axis=0)
        return h, z

    def log_probability(self, around: np.ndarray, target: np.ndarray, slot: np.ndarray | None = None) -> np.ndarray:
        """Of the class *target*, and of the *slot* in it where slots are told apart."""
        h, z = self.forward(self._rows_of(around))
        out = z[target, np.arange(len(h))]
        out -= np.log(np.exp(z, out=z).sum(axis=0))
        if self.options.slots > 1:
            rows, cls, parts = self._by_class(target)
            z = self._slot_logits(h[rows], cls, parts)
            out[rows] += z[slot[rows], np.arange(len(rows))] - np.log(np.exp(z).sum(axis=0))
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, slot: np.ndarray | None = None) -> None:
        """One step with a rate for every parameter (Adagrad)."""
        sides = self._rows_of(around)
        h, p = self.forward(sides)
        n = len(h)
        np.exp(p, out=p)
        p /= p.sum(axis=0) * n
        p[target, np.arange(n)] -= 1 / n
        flat = np.zeros_like(self.values[self.inputs.size :])
        g_out, g_bias, g_prior, g_leaves, g_tilt = self._views(flat, 1)
        np.matmul(h.T, p.T, out=g_out)
        p.sum(axis=1, out=g_prior)
        back = p.T @ self.outputs.T
        if self.options.slots > 1:
            rows, cls, parts = self._by_class(target)
            own = h[rows]
            q = self._slot_logits(own, cls, parts)
            np.exp(q, out=q)
            q /= q.sum(axis=0) * n
            q[slot[rows], np.arange(len(rows))] -= 1 / n
            more = np.empty_like(own)
            for c, a, z in parts:
                part = q[:, a:z].T
                np.matmul(own[a:z].T, part, out=g_leaves[c])
                np.matmul(part, self.leaves[c].T, out=more[a:z])
            if parts:
                g_tilt[[c for c, _, _ in parts]] = np.add.reduceat(q, [a for _, a, _ in parts], axis=1).T
            back[rows] += more
        back *= 1 - h * h
        back.sum(axis=0, out=g_bias)
        # rows of one class or slot lie together after a sort by small numbers; each gets their sum, the others stay as they are
        sides = sides.ravel()
        order = np.argsort(sides, kind="stable")
        sides = sides[order]
        new = np.flatnonzero(np.append(True, sides[1:] != sides[:-1]))
        g = np.add.reduceat(back.take(order % n, axis=0), new, axis=0)
        hit = sides[new].astype(np.int64)
        seen = self.seen.take(hit, axis=0)
        seen += g * g
        self.seen[hit] = seen
        g *= self.options.rate
        g /= np.sqrt(seen, out=seen)
        self.rows[hit] -= g
        rest = self.inputs.size
        self.memory[rest:] += flat * flat
        flat *= self.options.rate
        flat /= np.sqrt(self.memory[rest:])
        self.values[rest:] -= flat


_STOP, _MARK, _UPPER = (np.zeros(256, bool) for _ in range(3))
_STOP[list(b".!?")] = _MARK[list(b",;:)]}\"'")] = _UPPER[0x41:0x5B] = True


def shapes(c: Chunk, t: Tokens) -> np.ndarray:
    """Five bits of each token: ends a sentence, capital first, beyond ASCII, ends with another mark, over six bytes."""
    if not len(t):
        return np.zeros(0, np.int64)
    first, last = c.bytes[t.starts], c.bytes[t.ends - 1]
    high = np.zeros(len(c.bytes) + 1, np.int32 if len(c.bytes) < 1 << 31 else np.int64)
    np.cumsum(c.bytes >= 0x80, out=high[1:])
    return _STOP[last] + 2 * _UPPER[first] + 4 * (high[t.ends] > high[t.starts]) + 8 * _MARK[last] + 16 * (t.ends - t.starts > 6)


def _bucket(c: Chunk, t: Tokens, options: LmOptions) -> np.ndarray:
    """The token's bucket; its remainder by the number of shared classes is its shape."""
    shared = options.classes - options.own
    return (t.hash % np.uint64(options.buckets // shared)).astype(np.int64) * shared + shapes(c, t) % shared


def contexts(t: Tokens, cls: np.ndarray, options: LmOptions, at: np.ndarray | None = None) -> np.ndarray:
    """Classes around every token (or those *at* some places), one column per side place; ``classes`` beyond the ends of the text."""
    columns = []
    first, last = np.repeat(t.first[:-1], t.n), np.repeat(t.first[1:], t.n) - 1
    if at is None:
        at = np.arange(len(t))
    else:
        first, last = first[at], last[at]
    for d in range(-options.reach, options.reach + 1):
        if d:
            there = at + d
            columns.append(np.where((there >= first) & (there <= last), cls[np.clip(there, 0, max(0, len(t) - 1))], options.classes))
    return np.stack(columns, axis=1) if len(t) else np.zeros((0, 2 * options.reach), np.int64)


def _count(options: LmOptions):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(options.buckets, np.int64)
        for pdf in batches:
            for c in chunks(pdf["text"]):
                total += np.bincount(_bucket(c, words(c), options), minlength=options.buckets)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen.astype(np.int32), "n": total[seen]})

    return run


SLICE = 1 << 14


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """The counts of one slice of buckets as bytes."""
    counts = np.zeros(SLICE)
    counts[pdf["bucket"].to_numpy() % SLICE] = pdf["n"].to_numpy()
    return pd.DataFrame({"slice": [int(pdf["bucket"].iloc[0]) // SLICE], "counts": [counts.tobytes()]})


def bucket_counts(docs: DataFrame, options: LmOptions = LmOptions()) -> np.ndarray:
    """Occurrences of every bucket in *docs* (text as binary): one distributed sum, packed by slices before the driver gets it."""
    summed = docs.select("text").mapInPandas(_count(options), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    packed = summed.groupBy(F.floor(F.col("bucket") / SLICE)).applyInPandas(_pack, "slice long, counts binary")
    out = np.zeros(max(options.buckets, SLICE))
    for r in packed.collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"])
    return out[: options.buckets]


def _learn(options: LmOptions, vocab, start: np.ndarray | None, turn: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(options, None if start is None else start.copy(), vocab.value.odds)
        cls, slot, code = vocab.value.cls, vocab.value.slot, vocab.value.around(options)
        seen, part = 0, 0
        held_x: list[np.ndarray] = []
        held_y: list[np.ndarray] = []
        held_s: list[np.ndarray] = []

        def step(all_: bool) -> None:
            x, y, s = np.concatenate(held_x), np.concatenate(held_y), np.concatenate(held_s)
            held_x.clear(), held_y.clear(), held_s.clear()
            end = len(x) if all_ else len(x) // options.batch * options.batch
            for a in range(0, end, options.batch):
                net.learn(x[a : a + options.batch], y[a : a + options.batch], s[a : a + options.batch])
            if end < len(x):
                held_x.append(x[end:]), held_y.append(y[end:]), held_s.append(s[end:])

        for pdf in batches:
            part = int(pdf["part"].iloc[0])
            for c in chunks(pdf["text"]):
                t = words(c)
                if not len(t):
                    continue
                bucket = _bucket(c, t, options)
                mine = cls[bucket]
                # which round learns a position depends on the text alone
                place = np.arange(len(t)) - np.repeat(t.first[:-1], t.n)
                at = np.flatnonzero(place % options.rounds == turn)
                held_x.append(contexts(t, code[bucket], options, at))
                held_y.append(mine[at])
                held_s.append(slot[bucket[at]])
                seen += len(at)
                step(False)
        if held_x:
            step(True)
        yield pd.DataFrame({"part": [part], "weight": [float(seen)], "values": [net.values.astype(np.float64) * seen]})

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["part", "weight"], kind="stable")
    return pd.DataFrame({"part": [int(pdf["up"].iloc[0])], "weight": [pdf["weight"].sum()], "values": [np.stack(pdf["values"].tolist()).sum(axis=0)]})


_NETWORKS = "part long, weight double, values array<double>"


def _average(networks: DataFrame, parts: int, scratch: Scratch, name: str, options: LmOptions) -> np.ndarray | None:
    """The mean network, weighted by positions learnt: a tree of ``fan_in``, so that no task or driver gets all of them."""
    now = scratch.write(networks, f"{name}_0")
    level = 0
    while parts > options.fan_in:
        level, parts = level + 1, -(-parts // options.fan_in)
        now = now.withColumn("up", F.floor(F.col("part") / options.fan_in)).groupBy("up").applyInPandas(_merge, _NETWORKS)
        now = scratch.write(now, f"{name}_{level}")
    rows = now.where(F.col("weight") > 0).toPandas().sort_values(["part", "weight"], kind="stable")
    if not len(rows):
        return None
    return (np.stack(rows["values"].tolist()).sum(axis=0) / rows["weight"].sum()).astype(np.float32)


def fit(docs: DataFrame, options: LmOptions = LmOptions(), scratch: Scratch | None = None) -> tuple[Vocabulary, Network]:
    """Count all tokens of *docs* (text as binary), then learn and average ``rounds`` times."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = docs.select("text")
    counts = bucket_counts(texts, options)
    seen = np.flatnonzero(counts)
    vocab = vocabulary(seen, counts[seen], options)
    shared = spark.sparkContext.broadcast(vocab)
    parted = texts.withColumn("part", F.spark_partition_id().cast("long"))
    parts = parted.agg(F.max("part").alias("n")).first()["n"]
    values = None
    for turn in range(options.rounds):
        learnt = parted.mapInPandas(_learn(options, shared, values, turn), _NETWORKS)
        values = _average(learnt, (parts or 0) + 1, scratch, f"round{turn}", options)
        if values is None:
            break
    return vocab, Network(options, values, vocab.odds)


def pseudo_log_likelihood(texts: list[bytes | None], vocab: Vocabulary, net: Network, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed log-probability of each text."""
    code = vocab.around(net.options) if code is None else code
    n, total = [], []
    for c in chunks(texts):
        t = words(c)
        bucket = _bucket(c, t, net.options)
        mine = vocab.cls[bucket]
        logs = vocab.share[bucket].astype(np.float64)
        around = contexts(t, code[bucket], net.options)
        for a in range(0, len(t), 4096):
            logs[a : a + 4096] += net.log_probability(around[a : a + 4096], mine[a : a + 4096], vocab.slot[bucket[a : a + 4096]])
        sums = np.append(0.0, np.cumsum(logs))
        n.append(t.n)
        total.append(np.diff(sums[t.first]))
    return (np.concatenate(n), np.concatenate(total)) if n else (np.zeros(0, np.int64), np.zeros(0))


def log_likelihood(docs: DataFrame, options: LmOptions = LmOptions(), scratch: Scratch | None = None) -> DataFrame:
    """doc_id, score, n_tokens, log_prob, mean_log_prob and perplexity of every row of *docs* (doc_id, text).

    ``score`` is the mean log-probability of a token, 0 for a text without any.
    Null and empty texts have 0 tokens, log_prob 0 and neither mean nor
    perplexity.  Equal texts get equal scores.  An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    vocab, net = fit(docs, options, scratch)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, net.values))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab, values = shared.value
        net, code = Network(options, values, vocab.odds), vocab.around(options)
        for texts in batches:
            n, total = pseudo_log_likelihood(texts.tolist(), vocab, net, code)
            yield pd.DataFrame({"n_tokens": n, "log_prob": total})

    scored = docs.select("doc_id", F.pandas_udf(run, "n_tokens long, log_prob double")("text").alias("s")).select("doc_id", "s.*")
    mean = F.col("log_prob") / F.nullif("n_tokens", F.lit(0))
    return scored.select("doc_id", F.coalesce(mean, F.lit(0.0)).alias("score"), "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))


def op4(docs: DataFrame, options: LmOptions = WORDS) -> DataFrame:
    """``log_likelihood`` over all documents, words of a class told apart by their surroundings."""
    return log_likelihood(docs, options)
