"""A corpus pipeline: language ID, near duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; a stage's rows
are written as Parquet and read again by the next one.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import decontaminate, jaccard_join, langid, mixing, secrets
from tablewarden.llm.common import Scratch, crc_mod

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; it learns where crc32(doc_id) mod 3 is not 1."""
    docs = docs.select(COLUMNS)
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return langid.identify(docs, model).where(~F.col("rejected")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of its rows that repeat, or share that id, one.

    Rows are told apart by id and text: what another text of the same id is
    linked with does not keep this one.  Rows with a null id that are linked with
    nothing stay, one per text; null and empty texts stay, one per id.
    """
    docs = docs.select(COLUMNS)
    key = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("_key")
    text = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("_text")
    # the join goes by a number per id and text, so that rows of one id are documents of their own
    rows = docs.select("doc_id", text, "text").withColumn("_row", F.xxhash64(key(F.col("doc_id")), F.col("doc_id").isNull(), F.col("_text")))
    found = jaccard_join.join(rows.select(F.col("_row").alias("doc_id"), "text"))
    ids = rows.select(F.col("_row").alias("r"), "doc_id", "_text").distinct()
    joined = found.select(F.col("doc_id").alias("f"), "component_id").distinct().join(ids, F.col("f") == F.col("r"))
    # the smallest id of a component leads it, nulls last, then the smallest row
    lead = joined.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r")).alias("m")).select(F.col("m.r").alias("_row"))
    row = F.xxhash64(key(F.col("doc_id")), F.col("doc_id").isNull(), text).alias("_row")
    return docs.select("*", row).join(lead, "_row", "left_semi").dropDuplicates(["_row"]).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret span replaced by a mark; ``n_chars`` follows where it was known."""
    found = secrets.spans(docs, keep=tuple(COLUMNS))
    text = secrets.redact(F.col("text"), F.col("found"))
    redacted = found.withColumn("_clean", text)
    changed = F.col("n_chars").isNotNull() & (F.size("found") > 0)
    return redacted.select(
        "doc_id", F.col("_clean").alias("text"), "lang", "source", F.when(changed, F.length("_clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken."""
    return mixing.mix(docs.select(COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("mixing", mixing_sources),
]

# Language ID is a trained model and the mix a random walk: neither has SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
