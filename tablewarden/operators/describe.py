"""Security state of many tables from their DESCRIBE output, in one job.

Input: one row per output line, ``catalog, schema, table, pos, name, value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.names import KEY

# Labels in DESCRIBE output.
MASK_HEADER = "# Column Masks"
FILTER_LABEL = "Row Filter"
TYPE_LABEL = "Type"

# Lines per window group: a table with a very long dump spreads over many.
CHUNK = 4096

_FQN = "`([^`]+)`\\.`([^`]+)`\\.`([^`]+)`"


def _function_fqn(text):
    named = F.regexp_replace(F.regexp_substr(text, F.lit(_FQN)), "`", "")
    return F.coalesce(named, F.regexp_replace(text, "^`+|`+$", ""))


def table_types(dump: DataFrame) -> DataFrame:
    """Table kind per table, ``MANAGED`` where the dump does not say; the last line wins."""
    is_type = (F.trim("name") == TYPE_LABEL) & (F.length("value") > 0)
    return dump.groupBy(*KEY).agg(
        F.coalesce(F.max_by(F.when(is_type, F.trim("value")), F.when(is_type, F.col("pos"))), F.lit("MANAGED")).alias(
            "table_type"
        )
    )


def row_filters(dump: DataFrame) -> DataFrame:
    """The row filter of each table: function, argument columns and the text itself."""
    text = F.coalesce(F.col("value"), F.lit(""))
    args = F.regexp_extract(text, r"ON\s*\(([^)]*)\)", 1)
    has_args = text.rlike(r"ON\s*\([^)]*\)")
    last = (
        dump.where(F.trim("name") == FILTER_LABEL)
        .groupBy(*KEY)
        .agg(F.max_by(text, F.col("pos")).alias("raw_text"))
        .withColumn("value", F.col("raw_text"))
    )
    return last.select(
        *KEY,
        _function_fqn(F.col("raw_text")).alias("function_fqn"),
        F.when(has_args, F.transform(F.split(args, ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>")).alias("using_columns"),
        "raw_text",
    )


def column_masks(dump: DataFrame) -> DataFrame:
    """Masked columns: lines between a mask header and the first line that is no mask.

    A mask line has a name that is not a ``#`` heading and a backtick-quoted
    value; anything else (such as a size line right below the masks) ends the
    section.  Whether a line is in a section depends on the last line before it
    that is not a mask line: first within a chunk of lines, then across chunks.
    """
    name, value = F.coalesce(F.col("name"), F.lit("")), F.coalesce(F.trim("value"), F.lit(""))
    is_header = F.trim(name) == MASK_HEADER
    is_line = (name != "") & ~F.startswith(name, F.lit("#")) & F.startswith(value, F.lit("`"))
    lines = dump.select(
        *KEY, "pos", "name", "value",
        F.expr(f"pos div {CHUNK}").alias("chunk"),
        F.when(is_header, True).when(~is_line, False).alias("opens"),
    )

    in_chunk = Window.partitionBy(*KEY, "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy(*KEY, "chunk").agg(
        F.max_by("opens", F.when(F.col("opens").isNotNull(), F.col("pos"))).alias("last_opens")
    )
    carried = ends.withColumn("carried", F.last("last_opens", ignorenulls=True).over(earlier)).drop("last_opens")
    return (
        lines.withColumn("local", F.last("opens", ignorenulls=True).over(in_chunk))
        .where(F.col("opens").isNull())
        .join(carried, [*KEY, "chunk"], "left")
        .where(F.coalesce("local", "carried", F.lit(False)))
        .select(
            *KEY,
            F.trim("name").alias("column"),
            _function_fqn(F.col("value")).alias("function_fqn"),
            F.col("value").alias("raw_text"),
            F.col("pos").cast("int").alias("position"),
        )
    )
