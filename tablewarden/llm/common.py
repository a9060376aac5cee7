"""Shared scratch tables, bounded training samples and filters of fixed size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.tokens import mix


class Scratch:
    """A folder for one run of an operator, in the place that all executors share.

    The session names that place in ``spark.checkpoint.dir``; only a local session
    may do without, and then a folder under the warehouse serves.  Tables written here survive lost
    executors.  ``drop`` removes what a later step no longer reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if base is None:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        self.base = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """*df* as a table of this folder, read back."""
        df.write.option("compression", compression).parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While this holds, tasks hand rows to Python in batches of *rows*: for rows that carry whole sets or texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of *key* as text, modulo *n*; null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, by: str, per_class: int, columns: list[str]) -> DataFrame:
    """About *per_class* distinct rows of each value of *by*, the same at every run.

    Rows are kept by a hash of *columns*, so that no task gathers a class and the
    choice does not depend on partitions.  The share follows from how many
    distinct rows a class has (by hash, within a twentieth), so copies of one row
    take no other row's place; a class of up to a quarter more than *per_class*
    is kept whole.  Rows alike in *columns* come or stay together: the caller
    makes them distinct.
    """
    distinct = F.approx_count_distinct(F.xxhash64(*columns), 0.02).alias("n")
    counts = {r[by]: r["n"] for r in df.groupBy(by).agg(distinct).collect()}
    if not counts:
        return df.limit(0)
    # one count per class travels as a literal, so that no text is shuffled
    shares = {c: 1.0 if n <= 1.25 * per_class else per_class / n for c, n in counts.items()}
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col(by))
    spread = F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return df.where(spread < share)


def even_choice(features: np.ndarray, row: int, most: int) -> np.ndarray:
    """At most *most* of a row's features, sorted; which ones depends on the row's hash as well, so none is lost from every long row."""
    if len(features) <= most:
        return np.sort(features)
    salt = mix(np.array([row & ((1 << 64) - 1)], np.uint64))
    h = mix(features.astype(np.uint64) ^ salt)
    return np.sort(features[np.argsort(h, kind="stable")[:most]])


def hash_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Packed bits, set where a hash in *column* (long) has these leading *bits*.

    Takes 2 ** (bits - 3) bytes whatever the rows; with more rows than bits it
    lets more through, and what passes is still to be joined.
    """
    placed = df.select(F.shiftrightunsigned(column, 64 - bits).alias("bit"))
    filled = placed.groupBy(F.expr("bit div 8 AS byte")).agg(F.expr("bit_or(shiftright(128, cast(bit % 8 AS int))) AS mask")).toPandas()
    packed = np.zeros(1 << (bits - 3), np.uint8)
    packed[filled["byte"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.uint8)
    return packed


def passes(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Which of the hashes *h* (uint64) a ``hash_filter`` lets through."""
    at = (h >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
