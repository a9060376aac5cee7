"""Secured streams whose rules follow a versioned state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewarden.operators.enforce import Registry, secure
from tablewarden.operators.membership import Who
from tablewarden.plans.stored import StateStore


def write_by_version(
    stream: DataFrame,
    table: tuple[str, str, str],
    store: StateStore,
    functions: Registry,
    principal: str | Who,
    path: str,
    checkpoint: str,
    per_batch: dict[str, str] | None = None,
) -> StreamingQuery:
    """Append what *principal* sees of the rows that have arrived, each micro-batch under the state's newest version.

    Every batch is a folder ``batch=<id>`` whose rows carry that version as
    ``rules_version``.  A batch that runs again overwrites its folder whole, under
    the rules of that moment, so each row is there once and no batch mixes
    two versions.  A batch that cannot be secured fails the query and leaves no
    rows.  *path*, *checkpoint* and the store must be folders that all executors
    share.  *per_batch* are options of the trigger, by default all that is there.
    """

    def write(rows: DataFrame, batch: int) -> None:
        version = store.version
        seen = secure(rows, table, store.security(functions, version), principal)
        seen.withColumn("rules_version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(per_batch or {"availableNow": True}))
        .start()
    )
