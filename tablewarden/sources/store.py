"""Append-only Parquet tables, snapshots, and shared scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.sources.schemas import AUDIT, INVENTORY, TAG_GRANTS, conform, schema

# Rows per output file, so that one large append does not make one huge file.
_MAX_ROWS_PER_FILE = 5_000_000


def shared_folder(spark: SparkSession) -> str:
    """A new sub-folder of the folder that all executors share.

    The session names it in ``spark.checkpoint.dir``.  Only a local session may
    do without, and then uses a folder of its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/tablewarden-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """*df* written to the shared folder and read back, which survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, ddl: str, dry_run: bool = False, partition_by: tuple[str, ...] = ()) -> int:
    """Append *df* to the table at *path*; a dry run writes nothing.

    Returns 1 if a write ran, else 0.
    """
    if dry_run:
        return 0
    writer = conform(df, ddl).write.mode("append").option("maxRecordsPerFile", _MAX_ROWS_PER_FILE)
    writer.partitionBy(*partition_by).parquet(path)
    return 1


def append_inventory(df: DataFrame, path: str, dry_run: bool = False) -> int:
    return append(df, path, INVENTORY, dry_run, ("run_id",))


def append_audit(df: DataFrame, path: str, dry_run: bool = False) -> int:
    """Partitioned by run, so that reading one run back opens only its own files."""
    return append(df, path, AUDIT, dry_run, ("run_id",))


def append_tag_grants(df: DataFrame, path: str, dry_run: bool = False) -> int:
    return append(df, path, TAG_GRANTS, dry_run, ("run_id",))


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table at *path* in today's schema; files written before a column was added give NULL."""
    return conform(spark.read.schema(schema(ddl)).parquet(path), ddl)


def rows_for_run(df: DataFrame, run_id: str) -> DataFrame:
    return df.where(F.col("run_id") == run_id)


_VERSIONS = "version string, at timestamp"


def refresh_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Full refresh of a stored result; rules apply when it is read, not here.

    Every refresh is a folder of its own, and the list of versions gets its row
    last: readers of an older version, *df* among them, go on undisturbed, and a
    refresh that breaks off is never seen.
    """
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/{version}")
    row = df.sparkSession.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp())
    row.write.mode("append").parquet(f"{path}/_versions")
    return read_snapshot(df.sparkSession, path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the snapshot at *path*."""
    versions = spark.read.schema(_VERSIONS).parquet(f"{path}/_versions")
    newest = versions.orderBy(F.desc("at"), "version").first()["version"]
    return spark.read.parquet(f"{path}/{newest}")
