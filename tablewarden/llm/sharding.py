"""Sharding by proportional stratified interleaving.

The rows of every source are put in a seeded random order; a row's rank there,
over the rows of the source, is its fractional rank.  All rows in the order of
their fractional ranks are cut into shards of as many rows, to one, so that each
shard holds every source in the proportion of the whole, to about one row.  A
source starts at an offset of its own below one rank: without it all sources of
one row would meet at one place.

Neither order is sorted in one task.  Both keys, the shuffled key and the
fractional rank, are spread evenly, so their leading part serves as a bucket of
about ``bucket_rows`` rows; places are counted within a bucket, and the rows of
the buckets before it are added from a table of one count per bucket, summed in
two levels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import Scratch


@dataclass(frozen=True)
class ShardOptions:
    """``bucket_rows``: rows in one task's window; ``chunk``: copies of one row that one task writes out."""

    shards: int = 16
    seed: int = 23
    bucket_rows: int = 4096
    chunk: int = 10_000


def _number(*parts: Column | str) -> Column:
    """60 bits of an md5 over *parts*; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def _bits(rows: int, options: ShardOptions) -> int:
    return min(40, max(0, math.ceil(math.log2(max(1, rows) / options.bucket_rows))))


def _keys(docs: DataFrame, options: ShardOptions) -> DataFrame:
    """doc_id, source, size, crc of each row, the source as a text that is never null, and its place in the shuffle."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
    )
    return rows.withColumn("h", _number(F.lit(str(options.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "crc"))


def _before(held: DataFrame, *by: str) -> DataFrame:
    """Buckets with the rows ``before`` each and all rows ``n``, per value of *by*.

    Sums run within runs of 1,024 buckets and over the runs, so that the longest
    window has a row per 1,024 * ``bucket_rows`` rows of the table.
    """
    held = held.withColumn("run", F.shiftright("bucket", 10))
    runs = held.groupBy(*by, "run").agg(F.sum("held").alias("held"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*by, "run", earlier(whole.orderBy("run")).alias("run_before"), F.sum("held").over(whole).alias("n"))
    inner = earlier(Window.partitionBy(*by, "run").orderBy("bucket"))
    return held.join(runs, [*by, "run"]).select(*by, "bucket", (F.col("run_before") + inner).alias("before"), "n")


def _ranked(rows: DataFrame, total: int, options: ShardOptions) -> DataFrame:
    """*rows* (with ``copies``) with the rank of their first copy in the shuffled order of the source, and its rows."""
    spread = rows.withColumn("bucket", F.shiftright("h", 60 - _bits(total, options)))
    held = _before(spread.groupBy("src", "bucket").agg(F.sum("copies").alias("held")), "src")
    within = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    joined = spread.join(held, ["src", "bucket"])
    return joined.withColumn("rank", F.col("before") + F.coalesce(F.sum("copies").over(within), F.lit(0))).drop("bucket", "before", "h")


def _expanded(ranked: DataFrame, options: ShardOptions) -> DataFrame:
    """A row per copy; a row repeated very often is written out by several tasks."""

    def out(df: DataFrame, copies: Column) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy")
        return df.select("doc_id", "src", "size", "crc", "n", "rank", each).select(
            "doc_id", "src", "size", "crc", "n", (F.col("rank") + F.col("copy")).alias("rank")
        )

    few = out(ranked.where(F.col("copies") <= options.chunk), F.col("copies"))
    parts = F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {options.chunk}"))).alias("part")
    many = ranked.where(F.col("copies") > options.chunk).select("*", parts).repartition("src", "rank", "part")
    start = F.col("part") * options.chunk
    many = many.withColumns({"rank": F.col("rank") + start, "copies": F.least(F.lit(options.chunk), F.col("copies") - start)})
    return few.unionByName(out(many, F.col("copies")))


def assign(docs: DataFrame, options: ShardOptions = ShardOptions(), scratch: Scratch | None = None) -> DataFrame:
    """The shard and slot of every row of *docs* (doc_id, text, source; other columns are not read).

    Returns doc_id, source, size (UTF-8 bytes of the text plus one), text_crc32,
    shard (from 0) and slot (from 0 without gaps in each shard), one row per row
    of *docs*.  Shards differ by one row at most; a shard's rows of a source
    differ from its share of that source by about one.  Null text is empty; null
    source is a source of its own; null ids are ids.  Rows alike in doc_id,
    source, size and checksum are interchangeable, each with a slot.  Nothing
    depends on partitions, so reruns agree.  An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = _keys(docs, options).groupBy("doc_id", "src", "size", "crc", "h").agg(F.count("*").alias("copies"))
    rows = scratch.write(rows, "rows")
    total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    ranked = scratch.write(_ranked(rows, total, options), "ranked")
    offset = F.pmod(_number(F.lit(str(options.seed)), "src"), F.lit(65536)) / 65536.0
    placed = _expanded(ranked, options).withColumn("f", (F.col("rank") + offset) / F.col("n"))
    buckets = 1 << _bits(total, options)
    placed = placed.withColumn("bucket", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1)))
    held = _before(placed.groupBy("bucket").agg(F.count("*").alias("held"))).drop("n")
    within = Window.partitionBy("bucket").orderBy("f", "src", "rank")
    at = F.col("before") + F.row_number().over(within) - 1
    placed = placed.join(held, "bucket").withColumn("at", at.cast("long"))
    shard = F.expr(f"(at * {options.shards}) div {max(1, total)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {total}L + {options.shards - 1}) div {options.shards}")
    source = F.when(F.col("src") != "", F.expr("substring(src, 2)")).cast(docs.schema["source"].dataType)
    return placed.select("doc_id", source.alias("source"), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, options: ShardOptions = ShardOptions(), scratch: Scratch | None = None) -> None:
    """Write whole rows of *docs* as Parquet under *path*, a folder ``shard=k`` per shard, rows in the order of their slots.

    All columns but those named shard and slot are kept.  A shard is cut into
    files of neighbouring slots.  Rows alike in doc_id, source, size, checksum
    and a 64-bit hash of the text count as one row repeated, of which the other
    columns come from one.  An empty table writes an empty folder.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    places = scratch.write(assign(docs, options, scratch), "places")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.xxhash64(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull(),
        (F.octet_length(text) + 1).cast("long"), F.crc32(text),
    )
    whole = docs.select(*names, key.alias("_key"), F.md5(text).alias("_text"))
    whole = whole.dropDuplicates(["_key", "_text"])
    key = F.xxhash64(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull(),
        F.col("size"), F.col("text_crc32"),
    )
    joined = whole.join(places.select(key.alias("_key"), "shard", "slot"), "_key").drop("_key", "_text")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11(docs: DataFrame, options: ShardOptions = ShardOptions()) -> DataFrame:
    """``assign`` over all documents, as rows of the law ``rows``: counts of shards at most one apart."""
    return assign(docs, options).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


# The same order by window functions over the whole table; the checksum is a fold over the bytes of a text.
SQL = """
WITH RECURSIVE poly(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM poly WHERE k < 8
),
tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
hexed AS (SELECT row_number() OVER () AS row_id, doc_id, source, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
summed AS (
  SELECT row_id, doc_id, source, CAST(length(x) // 2 + 1 AS BIGINT) AS size, xor(4294967295, list_reduce(
    list_transform(regexp_extract_all(x, '..'), lambda b: CAST('0x' || b AS BIGINT)),
    lambda acc, b: xor(acc // 256, t[xor(acc, b) % 256 + 1]), CAST(4294967295 AS BIGINT))) AS crc
  FROM hexed, tab
),
keyed AS (
  SELECT doc_id, source, size, crc, coalesce('=' || source, '') AS src,
    CAST('0x' || substr(md5('23|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|' || crc), 1, 15) AS BIGINT) AS h
  FROM summed
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id, size, crc) - 1 AS rnk, count(*) OVER (PARTITION BY src) AS n,
    (CAST('0x' || substr(md5('23|' || src), 1, 15) AS BIGINT) % 65536) / CAST(65536 AS DOUBLE) AS off
  FROM keyed
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (rnk + off) / CAST(n AS DOUBLE), src, rnk) - 1 AS pos, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(pos * 16 // total AS INTEGER) AS shard,
  CAST(pos - ((pos * 16 // total) * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
"""
