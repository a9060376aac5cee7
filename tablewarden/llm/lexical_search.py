"""Ranked lexical search by an Aho-Corasick scan of the documents.

The terms of all items, each between two guards, are the patterns of one
automaton, which goes to all tasks.  A document is read with a guard in place of
every character that is no part of a term, so that only whole terms match, and
the outputs of the automaton are the counts tf: no index of the documents is
built or kept.  One scan counts what the weights need (documents and terms of the
corpus, documents per term), a second one scores and keeps each item's best
documents of every task, of which the best are chosen.

Items come in blocks whose terms and whose number are bounded, a scan per block:
the automaton, the tables by term and the scores of a batch have a size that does
not grow with the items.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import Scratch

# Bytes of terms: letters and digits of ASCII, A-Z in lower case, and all bytes beyond ASCII; the others are guards.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class SearchOptions:
    """``top`` documents an item; a block has at most ``block_items`` items and, but for one long item, ``block_bytes`` of terms.

    ``batch`` documents are scored at once; ``cell`` bounds batch times items.
    """

    top: int = 50
    block_items: int = 8192
    block_bytes: int = 1 << 20
    batch: int = 512
    cell: int = 1 << 21


def folded(text: bytes | None) -> str:
    """*text* with guards, one character per byte, a guard at either end."""
    return " " + (text or b"").translate(_FOLD).decode("latin-1") + " "


def terms(text: bytes | None) -> list[str]:
    # not split(): it would also split at 0x85 and 0xA0, which are parts of letters here
    return [t for t in folded(text).split(" ") if t]


@dataclass
class Block:
    """Items, their terms, and which items (``items[first[t]:first[t + 1]]``) hold term t."""

    ids: list
    terms: list[str]
    first: np.ndarray
    items: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[list[str]]) -> Block:
        number: dict[str, int] = {}
        pairs = np.array([(number.setdefault(t, len(number)), i) for i, found in enumerate(texts) for t in found], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        return Block(ids, list(number), np.searchsorted(pairs[:, 0], np.arange(len(number) + 1)), pairs[:, 1].astype(np.int32))

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            made.add_word(f" {t} ", k)
        made.make_automaton()
        return made


def blocks(items: DataFrame, options: SearchOptions) -> Iterator[Block]:
    """The items of *items* (item_id, text) with at least one term, a block at a time."""
    ids, texts, size = [], [], 0
    for r in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        found = sorted(set(terms(r["text"])))
        more = sum(map(len, found))
        if ids and (len(ids) == options.block_items or size + more > options.block_bytes):
            yield Block.of(ids, texts)
            ids, texts, size = [], [], 0
        if found:
            ids.append(r["item_id"])
            texts.append(found)
            size += more
    if ids:
        yield Block.of(ids, texts)


_find = itemgetter(1)


def _counts(text: str, automaton: ahocorasick.Automaton) -> Counter:
    """How often each term of *automaton* stands in a folded *text*."""
    return Counter(map(_find, automaton.iter(text)))


def _measure(shared, n_terms: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per task: documents that hold each term; at -1 the documents with a term, at -2 all their terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        held = np.zeros(n_terms, np.int64)
        docs = total = 0
        for pdf in batches:
            for raw in pdf["text"]:
                text = folded(raw)
                n = _length(text)
                if n:
                    docs, total = docs + 1, total + n
                    found = _counts(text, automaton)
                    held[np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(held)
        yield pd.DataFrame({"term": np.append(at, [-1, -2]), "n": np.append(held[at], [docs, total])})

    return run


def _length(text: str) -> int:
    """Terms of a folded *text*: a guard followed by none."""
    b = np.frombuffer(text.encode("latin-1"), np.uint8) != 0x20
    return int(np.count_nonzero(b[1:] & ~b[:-1]))


class _Best:
    """The best documents of each item: by score, then by id, nulls last."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.least = np.ones(n_items, np.int64)  # below it a score is not among the best
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, item: np.ndarray, *columns: np.ndarray) -> None:
        self.parts.append((item, *columns))
        self.rows += len(item)
        if self.rows > 4 * self.top * len(self.least) + 4096:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """Columns of the best rows: item, score, no_id, id, n_terms, n_matched."""
        cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, np.int64)] * 6
        order = np.lexsort((cols[3], cols[2], -cols[1], cols[0]))
        cols = [c[order] for c in cols]
        first = np.searchsorted(cols[0], np.arange(len(self.least) + 1))
        keep = np.arange(len(order)) - first[cols[0]] < self.top
        full = np.diff(first) >= self.top
        self.least[full] = cols[1][first[:-1][full] + self.top - 1]
        self.parts, self.rows = [tuple(c[keep] for c in cols)], int(keep.sum())
        return self.parts[0]


def _score(shared, options: SearchOptions):
    """Per task: the best documents of each item, as (item, doc_id, score, n_terms, n_matched)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, weight, first, items, n_items, docs, total = shared.value
        best = _Best(n_items, options.top)
        step = max(1, min(options.batch, options.cell // n_items))
        for pdf in batches:
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                texts = [folded(raw) for raw in part["text"]]
                n = np.array([_length(t) for t in texts], np.int64)
                found = [_counts(t, automaton) for t in texts]
                size = np.array([len(f) for f in found], np.int64)
                if not size.any():
                    continue
                term = np.fromiter((t for f in found for t in f), np.int64, size.sum())
                tf = np.fromiter((c for f in found for c in f.values()), np.int64, size.sum())
                doc = np.repeat(np.arange(len(part)), size)
                m = 50 + (50 * n * docs) // max(total, 1)
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                # each occurrence goes to the items that hold its term
                wide = first[term + 1] - first[term]
                ends = np.cumsum(wide)
                at = np.arange(ends[-1]) - np.repeat(ends - wide - first[term], wide)
                cell = np.repeat(doc, wide) * n_items + items[at]
                # whole numbers below 2**53, so sums as doubles are exact: a term gives 3 * 10**10 at most
                score = np.bincount(cell, np.repeat(gain, wide).astype(float), len(part) * n_items).astype(np.int64).reshape(len(part), n_items)
                matched = np.bincount(cell, minlength=len(part) * n_items).reshape(len(part), n_items)
                d, i = np.nonzero(score >= best.least)
                none = part["no_id"].to_numpy(bool)[d]
                ids = part["doc_id"].to_numpy(np.int64)[d]
                best.add(i, score[d, i], none.astype(np.int64), ids, n[d], matched[d, i])
        item, score, none, ids, n, matched = best.settle()
        yield pd.DataFrame({"item": item, "doc_id": pd.Series(ids, dtype="Int64").mask(none == 1), "score": score, "n_terms": n, "n_matched": matched})

    return run


def _weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)


def _first(df: DataFrame, top: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: Block, options: SearchOptions, scratch: Scratch, number: int) -> DataFrame:
    spark = docs.sparkSession
    automaton = block.automaton()
    shared = spark.sparkContext.broadcast(automaton)
    counted = docs.select("text").mapInPandas(_measure(shared, len(block.terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counted = dict(counted.collect())  # a row per term of the block
    n_docs, total = counted.get(-1, 0), counted.get(-2, 0)
    held = np.array([counted.get(t, 0) for t in range(len(block.terms))], np.int64)
    tables = spark.sparkContext.broadcast((automaton, _weights(n_docs, held), block.first, block.items, len(block.ids), n_docs, total))
    best = docs.mapInPandas(_score(tables, options), "item int, doc_id long, score long, n_terms long, n_matched int")
    # a task gives each item `top` rows; they meet in 256 groups an item first
    best = best.withColumn("group", F.spark_partition_id() % 256)
    best = scratch.write(_first(_first(best, options.top, "item", "group").drop("rank"), options.top, "item"), f"best{number}")
    ids = spark.createDataFrame([(k, i) for k, i in enumerate(block.ids)], "item int, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score", "n_terms", "n_matched")


def search(docs: DataFrame, items: DataFrame, options: SearchOptions = SearchOptions(), scratch: Scratch | None = None) -> DataFrame:
    """Each item's best documents: item_id, rank (from 1), doc_id, score, n_terms of the document, n_matched of the item's terms.

    *docs* has doc_id (a whole number) and text, *items* item_id and text; other
    columns are not read.  Only scores above 0 count; equal scores rank by doc_id,
    null ids last.  Null and empty texts hold no terms: such items get no rows,
    such documents count nowhere.  A repeated row of *docs* is a document of its
    own, a repeated row of *items* an item of its own.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    none = F.col("doc_id").isNull()
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), none.alias("no_id"), F.col("text").cast("binary").alias("text"))
    found = [_search_block(texts, b, options, scratch, k) for k, b in enumerate(blocks(items, options))]
    nothing = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, n_terms long, n_matched int")
    return reduce(DataFrame.unionByName, found) if found else nothing


def with_texts(found: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """*found* with *columns* of the documents, joined by doc_id; ids are to be unique and not null."""
    return found.join(docs.select("doc_id", *columns), "doc_id", "left")


def op12(docs: DataFrame, items: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """``search`` with all items over all documents."""
    return search(docs, items, options)


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lens),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term
),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
scored AS (
  SELECT item_id, doc_id, n AS n_terms, CAST(count(*) AS INTEGER) AS n_matched,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN lens USING (doc_id), corpus
  GROUP BY item_id, doc_id, n
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score, n_terms, n_matched
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""

