"""Benchmark passages in documents, also with other numbers, names and units.

Text becomes a template: numbers, units after a number and names (a capital and a
small letter, within a sentence) are placeholders, every other word stands for
itself.  A word that opens a sentence is a name too where its text uses it as one
within a sentence; windows are taken with and without such names.
Windows of template tokens are hash-joined with the benchmark's, and so are
windows of the words and numbers themselves, however few words they hold.  Along one
alignment of a document with an item the placeholders must be filled
consistently: the same value of the item always by the same value of the
document, and the other way round.  Tokens covered by consistent windows decide.
Where fillings conflict, only the windows that hold a conflicting placeholder
go; or those that are not filled as in the item, if that leaves more tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import hash_filter, passes
from tablewarden.llm.tokens import DIGIT, LETTER, Chunk, Tokens, chunks, lower_latin, mix, runs

NUMBER, UNIT, NAME = 1, 2, 3
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec ms min h hr hrs hour hours minute minutes second seconds "
    "day days week weeks month months year years dollar dollars euro euros cent cents percent usd eur gbp "
    "hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa mph kmh b kb mb gb tb"
).split()


@dataclass(frozen=True)
class LeakOptions:
    """A pair counts when ``covered`` tokens of the item, or all of a shorter item, lie in consistent windows."""

    window: int = 8
    least_item: int = 5
    literals: int = 4
    covered: int = 13
    filter_bits: int = 24


def _hash_words(words: list[str]) -> np.ndarray:
    c = Chunk([0], [" ".join(words).encode()])
    b = lower_latin(c.bytes)
    return np.sort(Tokens(c, b, LETTER[b]).hash)


_UNIT_HASHES = _hash_words(UNITS)
_PLACEHOLDER = mix(np.arange(4, dtype=np.uint64) + np.uint64(0xA5A5))
_CAPITALS, _AS_IT_STANDS = np.uint64(0x5C5C), np.uint64(0xC3C3 << 16)


def template(chunk: Chunk) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (runs of letters; numbers with inner points and commas), types (0: literal) without and with names that open sentences, hashes as they stand.

    As it stands a word counts in lower case, but for words all in capitals.
    """
    raw = chunk.bytes
    digit = DIGIT[raw]
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = ((raw[1:-1] == 0x2E) | (raw[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
    label = LETTER[raw].astype(np.int8)
    label[digit | inner] = 2
    t = Tokens(chunk, lower_latin(raw), label)
    kind = np.zeros(len(t), np.int8)
    if not len(t):
        return t, kind, kind, t.hash
    number = label[t.starts] == 2
    kind[number] = NUMBER
    head = np.zeros(len(t), bool)  # first tokens of their text
    head[t.first[:-1][t.n > 0]] = True
    after_number = np.append(False, number[:-1]) & ~head
    listed = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, t.hash), len(_UNIT_HASHES) - 1)] == t.hash
    kind[~number & after_number & listed] = UNIT
    lead, wide = raw[t.starts], t.starts + 1
    beyond = np.append(raw, np.zeros(4, np.uint8))
    capital = ((lead >= 0x41) & (lead <= 0x5A)) | ((lead == 0xC3) & (beyond[wide] >= 0x80) & (beyond[wide] <= 0x9E))
    second = t.starts + 1 + (lead == 0xC3)
    small = ((beyond[second] >= 0x61) & (beyond[second] <= 0x7A)) | ((beyond[second] == 0xC3) & (beyond[second + 1] >= 0x9F))
    stops = np.append(0, np.cumsum(np.isin(raw, np.frombuffer(b".!?:\n|", np.uint8)) & ~inner))
    within = stops[t.starts] == stops[np.append(0, t.ends[:-1])]
    named = (kind == 0) & capital & small
    opening = named & ~(within & ~head)
    kind[named & ~opening] = NAME
    of_text = mix(t.hash + np.repeat(np.arange(len(t.n), dtype=np.uint64), t.n) * np.uint64(0x9E3779B97F4A7C15))
    opened = kind.copy()
    opened[opening & np.isin(of_text, of_text[kind == NAME])] = NAME
    upper = np.append(0, np.cumsum((raw >= 0x41) & (raw <= 0x5A)))
    size = t.ends - t.starts
    shouted = (size > 1) & (upper[t.ends] - upper[t.starts] == size)
    return t, kind, opened, np.where(shouted, mix(t.hash ^ _CAPITALS), t.hash)


def windows(texts: list[bytes | None], lengths: list[int], literals: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Tokens, np.ndarray | None, Chunk]]:
    """Per chunk and length: hash, first token and text of the windows with enough literal tokens, and of all windows as they stand (no types)."""
    for c in chunks(texts):
        t, kind, opened, plain = template(c)
        owner = np.repeat(np.arange(len(t.n)), t.n)
        changed = np.append(0, np.cumsum(kind != opened))
        for k in lengths:
            if len(t) < k:
                continue
            same = owner[: len(t) - k + 1] == owner[k - 1 :]
            for types, also in ((kind, True), (opened, changed[k:] > changed[:-k])):
                literal = np.append(0, np.cumsum(types == 0))
                at = np.flatnonzero(same & also & (literal[k:] - literal[:-k] >= min(literals, k)))
                if len(at):
                    whole = runs(np.where(types > 0, _PLACEHOLDER[types], t.hash), tuple(range(k)))
                    yield mix(whole[at] + np.uint64(k)), at, owner[at], t, types, c
            at = np.flatnonzero(same)
            yield mix(runs(plain, tuple(range(k)))[at] + np.uint64(k) + _AS_IT_STANDS), at, owner[at], t, None, c


def _slots(t: Tokens, kind: np.ndarray | None, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Type and value of the placeholders of each window, in order, as one number each; none as it stands."""
    if kind is None:
        return [np.zeros(0, np.int64)] * len(at)
    value = (t.hash & np.uint64(2**60 - 1)).astype(np.int64) * 4 + kind
    return [value[a : a + k][kind[a : a + k] > 0] for a in at.tolist()]


_WINDOW = "window long, length int, at int, slots array<long>, template boolean"


def _item_windows(options: LeakOptions):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = np.zeros(len(pdf), np.int64)
            for c in chunks(pdf["text"]):
                n[c.rows] = template(c)[0].n
            for size in np.unique(n[n >= options.least_item]):
                # an item shorter than a window is one window of its own length
                rows = pdf[n == size]
                k = int(min(size, options.window))
                for h, at, owner, t, kind, c in windows(rows["text"].tolist(), [k], options.literals):
                    row = c.rows[owner]
                    yield pd.DataFrame({"item_id": rows["item_id"].to_numpy()[row], "n_tokens": int(size), "window": h.view(np.int64), "length": k, "at": at - t.first[owner], "slots": _slots(t, kind, at, k), "template": kind is not None})

    return run


def _doc_windows(shared, lengths: list[int], options: LeakOptions):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in lengths:
                for h, at, owner, t, kind, c in windows(pdf["text"].tolist(), [k], options.literals):
                    hit = passes(shared.value, h, options.filter_bits)
                    h, at, owner = h[hit], at[hit], owner[hit]
                    if len(at):
                        row = c.rows[owner]
                        yield pd.DataFrame({"doc": pdf["doc"].to_numpy()[row], "text_hash": pdf["text_hash"].to_numpy()[row], "window": h.view(np.int64), "length": k, "at": at - t.first[owner], "slots": _slots(t, kind, at, k), "template": kind is not None})

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, options: LeakOptions = LeakOptions()) -> DataFrame:
    """Pairs of a document and a benchmark item found in it: doc_id, item_id, n_covered, n_tokens, exact.

    *docs* has doc_id and text, *benchmark* item_id and text; other columns are
    not read.  ``n_covered`` of the item's ``n_tokens`` template tokens lie in
    windows whose placeholders are filled consistently; ``exact`` when they are
    all filled as in the item in alignments without conflict.  Null and empty texts have no windows, items of
    fewer than ``least_item`` tokens are not looked for, those with too few literal
    ones only as they stand, and either table may be empty.  Rows with one doc_id count as one document;
    an item_id that repeats counts as one item of all its texts.

    Documents are read once.  What they have in common with a filter of
    2 ** ``filter_bits`` bits, whatever the benchmark's size, goes on to the join.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    mine = items.where(F.col("item_id").isNotNull()).mapInPandas(_item_windows(options), f"item_id {kind}, n_tokens int, {_WINDOW}")

    shared = spark.sparkContext.broadcast(hash_filter(mine, "window", options.filter_bits))
    lengths = sorted(r["length"] for r in mine.select("length").distinct().collect())

    doc_kind = docs.schema["doc_id"].dataType
    found = docs.select(
        F.col("doc_id").cast("string").alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")
    ).mapInPandas(_doc_windows(shared, lengths, options), f"doc string, text_hash long, {_WINDOW}")

    i, d = mine.alias("i"), found.alias("d")
    met = d.join(i, (F.col("d.window") == F.col("i.window")) & (F.col("d.length") == F.col("i.length")) & (F.size("d.slots") == F.size("i.slots")))
    aligned = met.groupBy("d.doc", "d.text_hash", "i.item_id", (F.col("d.at") - F.col("i.at")).alias("shift")).agg(
        F.max("i.n_tokens").alias("n_tokens"),
        F.collect_set(
            F.struct(
                F.col("i.at").alias("at"),
                F.col("i.length").alias("length"),
                F.col("i.template").alias("template"),
                F.zip_with("i.slots", "d.slots", lambda a, b: F.struct(a.alias("mine"), b.alias("theirs"))).alias("pairs"),
            )
        ).alias("places"),
    )
    aligned = aligned.withColumn("pairs", F.array_distinct(F.flatten("places.pairs")))
    one_to_one = (F.size(F.array_distinct("pairs.mine")) == F.size("pairs")) & (F.size(F.array_distinct("pairs.theirs")) == F.size("pairs"))
    apart = F.filter("pairs", lambda p: F.exists("pairs", lambda q: (p["mine"] == q["mine"]) != (p["theirs"] == q["theirs"])))

    def same(pairs: Column) -> Column:
        return F.forall(pairs, lambda p: p["mine"] == p["theirs"])

    def tokens(places: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p["at"], p["at"] + p["length"] - 1))))

    def covered(name: str) -> Column:
        return F.size(F.array_distinct(F.flatten(F.collect_set(name))))

    # words left as they were and places filled anew are not added up: one name for two, between copied words, is another question
    verbatim = F.filter("places", lambda w: same(w["pairs"]))
    # a lambda's variable, so that the conflicts are found once and not for every window
    agreeing = F.flatten(F.transform(F.array(apart), lambda out: F.filter("places", lambda w: w["template"] & ~F.arrays_overlap(w["pairs"], out))))
    pairs = (
        aligned.select(
            "doc",
            "item_id",
            "n_tokens",
            tokens(F.when(one_to_one, F.col("places")).otherwise(verbatim)).alias("verbatim"),
            tokens(F.when(one_to_one, F.col("places")).otherwise(agreeing)).alias("agreeing"),
            F.when(one_to_one, same(F.col("pairs"))).alias("exact"),
        )
        .groupBy("doc", "item_id")
        .agg(F.max("n_tokens").alias("n_tokens"), F.greatest(covered("verbatim"), covered("agreeing")).alias("n_covered"), F.coalesce(F.min("exact"), F.lit(False)).alias("exact"))
    )
    return pairs.where(F.col("n_covered") >= F.least(F.col("n_tokens"), F.lit(options.covered))).select(
        F.col("doc").cast(doc_kind).alias("doc_id"), "item_id", "n_covered", "n_tokens", "exact"
    )


def clean(docs: DataFrame, benchmark: DataFrame, options: LeakOptions = LeakOptions()) -> DataFrame:
    """The rows of *docs* in which no benchmark item is found; rows without doc_id stay."""
    return docs.join(leaks(docs, benchmark, options).select("doc_id").distinct(), "doc_id", "left_anti")


def op7(docs: DataFrame, benchmark: DataFrame, options: LeakOptions = LeakOptions()) -> DataFrame:
    """``leaks`` of the whole benchmark in all documents."""
    return leaks(docs, benchmark, options)
