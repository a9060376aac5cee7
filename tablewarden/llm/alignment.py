"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentencepiece model (B).

Both cut the same bytes, a space and the text.  Tokens are intervals of bytes; a
merge_asof of the starts of A on those of B, keyed by document, finds the token
of B that covers each start, one the other way round covers the starts of B, and
the union of both is the overlaps.  Places where tokens of both end cut a
document into groups.  All this happens in chunks of about ``chunk_bytes`` inside
the tasks.

How often a pair of ids overlaps in the corpus takes a second step: pairs are
counted, the heaviest are sent to all tasks (at most ``heavy``, 13 bytes each)
and all other pairs, each of them rare, are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import Scratch

# The characters that a byte-level vocabulary writes for bytes, and the pattern that cuts texts before merging.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BLANKS = re.compile(r"\s{4096}")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class AlignOptions:
    """Paths are read by the driver, the files go to the tasks; ``heavy`` pairs of ids at most are sent to all tasks."""

    byte_bpe: str = "/opt/tokenizers/byte_bpe_50k.json"
    piece_bpe: str = "/opt/tokenizers/piece_bpe_32k.model"
    chunk_bytes: int = 1 << 18
    heavy: int = 1 << 20


class ByteBpe:
    """Ids by a tokenizer file whose vocabulary lists the bytes, then the merges in their order."""

    def __init__(self, blob: bytes):
        import tiktoken

        whole = json.loads(blob)
        model = whole["model"]
        byte = {chr(b): b for b in _PRINTED}
        byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
        special = {t["id"] for t in whole.get("added_tokens", [])}
        self.table = [b""] * (max(model["vocab"].values()) + 1)
        for piece, i in model["vocab"].items():
            if i not in special:
                self.table[i] = bytes(byte[c] for c in piece)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        cut = whole.get("pre_tokenizer") or {}
        plain = whole.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if not plain or any(model["vocab"][m] != 256 + k for k, m in enumerate(merged)):
            raise ValueError("not a byte-level BPE without a normalizer whose ids follow its merges")
        ranks = {t: i for i, t in enumerate(self.table) if t}
        self.codec = tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.blob = blob

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.blanks.encode(t, add_special_tokens=False).ids if _BLANKS.search(t) else self.codec.encode_ordinary(t) for t in texts]

    @cached_property
    def blanks(self):
        """The same tokenizer, slower, for texts whose long blank runs the other one's pattern can't step through."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_buffer(self.blob)
        made.encode_special_tokens = True
        return made


class PieceBpe:
    """Ids by a sentencepiece model, which puts a space before each text."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.codec = sentencepiece.SentencePieceProcessor(model_proto=blob)
        n = self.codec.vocab_size()
        names = [self.codec.id_to_piece(i) for i in range(n)]
        self.table = [bytes([int(p[3:5], 16)]) if self.codec.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        # then a text may be cut before a space without a change of its tokens
        self.separable = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.codec.encode(texts, num_threads=1)


def _segments(text: str, size: int) -> list[str]:
    """*text* cut before spaces that follow another character, in pieces of about *size* characters where it has such spaces."""
    out, a = [], 0
    while len(text) - a > size:
        z = text.find(" ", a + size)
        while z > 0 and text[z - 1].isspace():
            z = text.find(" ", z + 1)
        if z < 0:
            break
        out.append(text[a:z])
        a = z
    return [*out, text[a:]]


def _encode(codecs: tuple[ByteBpe, PieceBpe], raws: list[bytes | None]) -> tuple[list[list[int]], list[list[int]]]:
    """Ids of each text by A and B; none where the text is null, empty, or its bytes do not come back."""
    a, b = codecs
    spaced = [(" " + raw.decode("utf-8", "replace")) if raw else "" for raw in raws]
    cut = [_segments(t, 1 << 16) if b.separable else [t] for t in spaced]
    flat = [s for c in cut for s in c]
    by_a, by_b = iter(a.encode(flat)), iter(b.encode([s[1:] for s in flat]))
    out_a, out_b = [], []
    for raw, c in zip(raws, cut, strict=True):
        x = [i for _ in c for i in next(by_a)]
        y = [i for _ in c for i in next(by_b)]
        want = b" " + raw if raw else b""
        whole = bool(raw) and b"".join(map(a.table.__getitem__, x)) == want == b"".join(map(b.table.__getitem__, y))
        out_a.append(x if whole else [])
        out_b.append(y if whole else [])
    return out_a, out_b


class Side:
    """The tokens of a chunk by one tokenizer: document, id and interval of bytes, all documents behind each other."""

    def __init__(self, ids: list[list[int]], length: np.ndarray):
        self.n = np.array([len(x) for x in ids], np.int64)
        self.first = np.append(0, np.cumsum(self.n))
        self.id = np.fromiter((i for x in ids for i in x), np.int64, self.first[-1])
        self.doc = np.repeat(np.arange(len(ids)), self.n)
        self.end = np.cumsum(length[self.id])
        self.start = self.end - length[self.id]


class Aligned:
    """Groups and overlaps of the tokens of some documents."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        left = pd.DataFrame({"at": a.start, "doc": a.doc, "a": np.arange(len(a.id))})
        right = pd.DataFrame({"at": b.start, "doc": b.doc, "b": np.arange(len(b.id))})
        if len(left) and len(right):
            # the offset runs through all documents of the chunk, so both sides are sorted by it
            over = pd.merge_asof(left, right, on="at", by="doc")[["a", "b"]]
            under = pd.merge_asof(right, left, on="at", by="doc")[["a", "b"]]
            # two tokens that start together were found from both sides
            under = under[a.start[under["a"].to_numpy()] != b.start[under["b"].to_numpy()]]
            both = np.concatenate([over.to_numpy(np.int64), under.to_numpy(np.int64)])
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
        else:
            both = np.zeros((0, 2), np.int64)
        self.link_a, self.link_b = both[:, 0], both[:, 1]
        common = a.end[np.isin(a.end, b.end, assume_unique=True)]
        self.group_a = np.searchsorted(common, a.end)
        self.group_b = np.searchsorted(common, b.end)
        last = np.append(np.flatnonzero(np.diff(a.doc)), len(a.doc) - 1)[: len(a.doc)]
        groups = np.zeros(len(a.n), np.int64)
        groups[a.doc[last]] = self.group_a[last] + 1
        # documents without tokens repeat the count before them
        self.first_group = np.append(0, np.maximum.accumulate(groups)) if len(groups) else np.zeros(1, np.int64)

    def n_groups(self) -> np.ndarray:
        return np.diff(self.first_group)

    def links_of(self) -> np.ndarray:
        """The document of each link."""
        return self.a.doc[self.link_a]

    def group_digests(self, names: _Names) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` of each document; empty without tokens."""
        a, b = self.a, self.b
        # a group's tokens of A, then those of B; what follows a token depends on whether it is the last of its side
        group = np.concatenate([self.group_a, self.group_b])
        side = np.repeat([0, 1], [len(a.id), len(b.id)])
        order = np.lexsort((side, group))
        group, side, ids = group[order], side[order], np.concatenate([a.id, b.id])[order]
        last = np.append((np.diff(group) != 0) | (np.diff(side) != 0), True)[: len(ids)]
        mark = np.where(last, 1 + side, 0)
        parts = names.bytes[mark, ids].tolist()
        out = []
        ends = (a.first + b.first).tolist()
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            out.append(hashlib.sha256(b"".join(parts[x:y])[:-1]).hexdigest() if y > x else "")
        return out


class _Names:
    """Decimal ids, each followed by ``,`` or ``|`` or ``;``."""

    def __init__(self, n: int):
        self.bytes = np.array([[b"%d%s" % (i, mark) for i in range(n)] for mark in (b",", b"|", b";")], object)


_HELD: dict[bytes, tuple] = {}


def _tools(blobs: tuple[bytes, bytes]) -> tuple:
    """Both tokenizers, the lengths of their tokens and their names, made once per process."""
    key = hashlib.md5(blobs[0] + blobs[1]).digest()
    if key not in _HELD:
        codecs = ByteBpe(blobs[0]), PieceBpe(blobs[1])
        length = [np.array([len(t) for t in c.table], np.int64) for c in codecs]
        _HELD[key] = codecs, length, _Names(max(map(len, length)))
    return _HELD[key]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with texts of about *size* bytes, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(ends, before + size, "right")))
            part = batch.slice(a, z - a)
            yield part, part["text"].to_pylist()
            a = z


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def _tokens(shared, options: AlignOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs, length, _ = _tools(shared.value)
        for part, raws in _chunks(batches, options.chunk_bytes):
            ids = _encode(codecs, raws)
            al = Aligned(Side(ids[0], length[0]), Side(ids[1], length[1]))
            a, b = al.a, al.b
            doc = al.links_of()
            first = np.searchsorted(doc, np.arange(len(raws) + 1))
            base = np.append(0, np.cumsum([len(r) + 1 if len(x) else 0 for r, x in zip(raws, ids[0], strict=True)]))
            out = [
                _lists(a.id, a.first, pa.int32()), _lists(a.end - base[a.doc], a.first, pa.int64()), _lists(al.group_a - al.first_group[a.doc], a.first, pa.int32()),
                _lists(b.id, b.first, pa.int32()), _lists(b.end - base[b.doc], b.first, pa.int64()), _lists(al.group_b - al.first_group[b.doc], b.first, pa.int32()),
                _lists(al.link_a - a.first[doc], first, pa.int32()), _lists(al.link_b - b.first[doc], first, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *out], names=["doc_id", *_TOKENS])

    return run


_TOKENS = {
    "a_ids": "array<int>", "a_ends": "array<bigint>", "a_groups": "array<int>", "b_ids": "array<int>", "b_ends": "array<bigint>", "b_groups": "array<int>",
    "link_a": "array<int>", "link_b": "array<int>",
}


def _blobs(docs: DataFrame, options: AlignOptions):
    """Both files, a megabyte or two, for all tasks."""
    blobs = []
    for path in (options.byte_bpe, options.piece_bpe):
        with open(path, "rb") as f:
            blobs.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(blobs))


def align(docs: DataFrame, options: AlignOptions = AlignOptions()) -> DataFrame:
    """The tokens of every text by both tokenizers, their groups and their links.

    Returns doc_id; a_ids, a_ends (bytes after the added space and the text so
    far) and a_groups (group of each token, from 0), likewise for B; link_a and
    link_b (places of overlapping tokens, in order).  A text that is null, empty
    or not given back by either tokenizer has no tokens.  One row per row of
    *docs* (doc_id, text; other columns are not read); an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    columns = ", ".join(f"{c} {t}" for c, t in _TOKENS.items())
    return texts.mapInArrow(_tokens(_blobs(docs, options), options), f"doc_id {kind}, {columns}")


def _digests(shared, options: AlignOptions):
    """Per document the counts, the digest of the groups, and its pairs of ids with how often they overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs, length, names = _tools(shared.value)
        wide = len(length[1])
        for part, raws in _chunks(batches, options.chunk_bytes):
            ids = _encode(codecs, raws)
            al = Aligned(Side(ids[0], length[0]), Side(ids[1], length[1]))
            pair = al.a.id[al.link_a] * wide + al.b.id[al.link_b]
            doc = al.links_of()
            n_links = np.bincount(doc, minlength=len(raws))
            order = np.lexsort((pair, doc))
            pair, doc = pair[order], doc[order]
            new = np.flatnonzero(np.append(True, (np.diff(pair) != 0) | (np.diff(doc) != 0))[: len(pair)])
            times = np.diff(np.append(new, len(pair)))
            first = np.searchsorted(doc[new], np.arange(len(raws) + 1))
            out = [
                part["doc_id"], pa.array(al.a.n), pa.array(al.b.n), pa.array(al.n_groups()), pa.array(n_links, pa.int64()),
                pa.array(al.group_digests(names), pa.string()), _lists(pair[new], first, pa.int64()), _lists(times, first, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def _add_heavy(shared):
    """What heavy pairs add to each document; pairs that are not heavy stay with it, each packed with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, best = shared.value
        for batch in batches:
            pairs, times = batch["pairs"], batch["times"]
            first = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            pair = pairs.flatten().to_numpy()
            n = times.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            at = np.minimum(np.searchsorted(key, pair), max(len(key) - 1, 0))
            known = key[at] == pair if len(key) else np.zeros(len(pair), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], doc[known], (n * best[at])[known] if len(key) else 0)
            np.add.at(sums[1], doc[known], (n * total[at])[known] if len(key) else 0)
            rest = ~known
            left = np.append(0, np.cumsum(np.bincount(doc[rest], minlength=batch.num_rows)))
            out = [*(batch[c] for c in _DIGEST), pa.array(sums[0]), pa.array(sums[1]), _lists(pair[rest], left, pa.int64()), _lists(n[rest], left, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=[*_DIGEST, "n_best", "count_sum", "pairs", "times"])

    return run


_DIGEST = {"row": "bigint", "doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string"}


def _pair_rows(df: DataFrame, *columns: str) -> DataFrame:
    """A row per pair of each document: pair and times."""
    packed = F.explode(F.zip_with("pairs", "times", lambda p, n: F.shiftleft(p, 32).bitwiseOR(n.cast("long")))).alias("packed")
    rows = df.select(*columns, packed)
    return rows.select(*columns, F.shiftright("packed", 32).alias("pair"), F.col("packed").bitwiseAND(F.lit((1 << 32) - 1)).alias("times"))


def digest(docs: DataFrame, options: AlignOptions = AlignOptions(), scratch: Scratch | None = None) -> DataFrame:
    """Counts of each document and how common its links are in the corpus.

    Returns doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair
    of ids overlaps as often as any pair of that id of B), count_sum (over the
    links, how often their pair overlaps in the corpus) and groups_sha256.  A
    text without tokens, see ``align``, has zeros and an empty digest.  One row
    per row of *docs*; a repeated row counts again; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    shared = _blobs(docs, options)
    wide = len(_tools(shared.value)[1][1])
    columns = ", ".join(f"{c} {t}" for c, t in _DIGEST.items() if c != "row")
    found = texts.mapInArrow(_digests(shared, options), f"{columns}, pairs array<bigint>, times array<int>")
    found = scratch.write(found.withColumn("row", F.monotonically_increasing_id()), "found", "zstd")
    totals = _pair_rows(found).groupBy("pair").agg(F.sum("times").alias("total"))
    totals = scratch.write(totals, "totals")
    # a row per id of B
    most = totals.groupBy(F.expr(f"pair % {wide}").alias("b")).agg(F.max("total").alias("most"))
    totals = totals.join(F.broadcast(most), F.expr(f"pair % {wide}") == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"), F.floor(F.log2("total") * 8).cast("int").alias("bin"))
    # bins of an eighth of a power of two: the heaviest whole bins that are `heavy` pairs at most
    least, held = 1 << 30, 0
    for r in sorted(totals.groupBy("bin").agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > options.heavy:
            break
        least = r["bin"]
    head = totals.where(F.col("bin") >= least).select(F.col("pair").cast("long"), "total", "best").toPandas().sort_values("pair")
    tables = spark.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["total"].to_numpy(np.int64), head["best"].to_numpy(np.int64)))
    columns = ", ".join(f"{c} {t}" for c, t in _DIGEST.items())
    summed = found.mapInArrow(_add_heavy(tables), f"{columns}, n_best bigint, count_sum bigint, pairs array<bigint>, times array<int>")
    summed = scratch.write(summed, "summed", "zstd")
    # each of these pairs is rare, so no key of the join is hot
    rare = _pair_rows(summed, "row").join(totals.where(F.col("bin") < least), "pair")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("total")).alias("more_sum"))
    out = summed.drop("pairs", "times").join(rare, "row", "left")
    more = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return out.withColumns(more).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13(docs: DataFrame, options: AlignOptions = AlignOptions()) -> DataFrame:
    """``digest`` of all documents."""
    return digest(docs, options)
