"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a rate: its target words over its words.  A document is taken
as often as the whole part of the rate, and once more with the fractional part
as inclusion probability.  The flight phase moves those probabilities through
the null space of the constraints (documents and words of the source keep their
expected totals) until they are 0 or 1.  It runs on chunks of a source at a
time; each chunk leaves at most two documents open, these are chunked again,
and the last two of a source are the landing problem.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixOptions:
    """``weights`` repeat over the sources in order; ``most`` bounds copies; ``chunk`` documents fly at a time."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    most: float = 3.0
    chunk: int = 4096
    seed: int = 17


def word_count(text: Column) -> Column:
    """Words of *text*, runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], options: MixOptions = MixOptions()) -> dict[str | None, float]:
    """Words wanted of each source: the total shared by weight, what exceeds ``most`` times a source shared anew."""
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    weight = {s: options.weights[i % len(options.weights)] for i, s in enumerate(order)}
    cap = {s: options.most * n for s, n in sizes}
    fixed: dict[str | None, float] = {}
    open_ = set(cap)
    while open_:
        left = sum(n for _, n in sizes) - sum(fixed.values())
        per_weight = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if per_weight * weight[s] > cap[s]}
        if not over:
            return fixed | {s: per_weight * weight[s] for s in open_}
        fixed |= {s: cap[s] for s in over}
        open_ -= over
    return fixed


def _clean(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities with the same sum and the same sum of ``size * p``, at most two of them neither 0 nor 1.

    Three open units at a time move along the null vector of the two
    constraints; units of one size move against each other.
    """
    p = np.array([_clean(x) for x in p.tolist()])
    held: list[int] = []
    coins = iter(rng.random(3 * len(p) + 8).tolist())
    for k in np.flatnonzero((p > 0) & (p < 1)).tolist():
        held.append(k)
        while len(held) >= 2:
            same = {}
            pair = None
            for k2 in held:
                if size[k2] in same:
                    pair = (same[size[k2]], k2)
                same[size[k2]] = k2
            if pair:
                units, u = list(pair), [1.0, -1.0]
            elif len(held) == 3:
                units = held
                a, b, c = (float(size[x]) for x in held)
                u = [c - b, a - c, b - a]
                most = max(map(abs, u))
                u = [x / most for x in u]
            else:
                break
            up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(units, u, strict=True) if v)
            down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(units, u, strict=True) if v)
            move = up if next(coins, 0.5) * (up + down) < down else -down
            for x, v in zip(units, u, strict=True):
                p[x] = _clean(p[x] + move * v)
            left = [x for x in held if 0 < p[x] < 1]
            if len(left) == len(held):  # rounding left all of them open: settle the one nearest to an end
                x = min(held, key=lambda x: min(p[x], 1 - p[x]))
                p[x] = round(p[x])
                left = [x for x in held if 0 < p[x] < 1]
            held = left
    return p


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Settle the open units, two at most, so that words, then documents, stay nearest to their expectation."""
    p = p.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    if len(at):
        ways = [np.array([(w >> j) & 1 for j in range(len(at))], float) for w in range(1 << len(at))]
        p[at] = min(ways, key=lambda x: (abs(((x - p[at]) * size[at]).sum()), abs((x - p[at]).sum())))
    return p


def _fly(level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # large documents first, so that those left for the landing are small
        pdf = pdf.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable")
        source, bucket, last = pdf["source"].iloc[0], int(pdf["bucket"].iloc[0]), bool(pdf["last"].iloc[0])
        name = zlib.crc32(source.encode()) if isinstance(source, str) else 1 << 33
        p = flight(pdf["size"].to_numpy(), pdf["p"].to_numpy(float), np.random.default_rng([seed, level, bucket, name]))
        return pdf.assign(p=land(pdf["size"].to_numpy(), p) if last else p)

    return run


def mix(docs: DataFrame, options: MixOptions = MixOptions(), scratch: Scratch | None = None) -> DataFrame:
    """How often each row of *docs* (doc_id, text, source) is taken.

    Returns doc_id, source, size (words), source_size, target (words wanted of
    the source), copies and taken (size times copies), one row per row of *docs*.
    Null text is empty; null source is a source, the last one.  A source without
    words has target 0 and gives nothing.  The result depends on doc_id, size and
    source alone, not on partitions, so that reruns agree; rows alike in all
    three are interchangeable.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    kind = docs.schema["doc_id"].dataType
    # ids pass through pandas as text: a null would turn whole numbers into floats
    sized = scratch.write(docs.select(F.col("doc_id").cast("string"), "source", word_count(F.col("text")).alias("size")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    wanted = targets([(r["source"], r["words"]) for r in totals], options)
    plan = spark.createDataFrame(
        [(r["source"], r["words"], float(wanted[r["source"]]), wanted[r["source"]] / r["words"] if r["words"] else 0.0, r["n"]) for r in totals],
        "s string, source_size long, target double, rate double, n long",
    )
    base = F.floor("rate").cast("int")
    now = sized.join(plan, sized["source"].eqNullSafe(plan["s"])).select(
        "doc_id", "source", "size", "source_size", "target", base.alias("base"), (F.col("rate") - base).alias("p"), "n",
        F.xxhash64("doc_id", F.lit(options.seed)).alias("order"),
    )
    done = []
    most = max((r["n"] for r in totals), default=0)
    for level in range(99):
        buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / options.chunk)).cast("int")
        last = most <= options.chunk
        flown = now.select(
            "*", F.pmod(F.xxhash64("order", F.lit(level)), buckets).cast("int").alias("bucket"), (buckets == 1).alias("last")
        )
        flown = scratch.write(flown.groupBy("source", "bucket").applyInPandas(_fly(level, options.seed), flown.schema), f"flown{level}")
        settled = F.col("p").isin(0.0, 1.0)
        done.append(flown.where(settled))
        if last:
            break
        # each chunk left two open rows at most
        now = flown.where(~settled).drop("bucket", "last").withColumn("n", 2 * F.ceil(F.col("n") / options.chunk))
        most = 2 * math.ceil(most / options.chunk)
    rows = reduce(DataFrame.unionByName, done)
    copies = (F.col("base") + F.col("p").cast("int")).cast("int")
    return rows.select(F.col("doc_id").cast(kind), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def op2(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """``mix`` over all documents."""
    return mix(docs, options)


def open_units(p: Iterable[float]) -> int:
    """How many probabilities are still neither 0 nor 1."""
    return sum(0 < x < 1 for x in p)
