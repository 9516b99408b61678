"""Global orders without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.scratch import materialize


def placed(df: DataFrame, *order: Column | str, sums: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``_number``, their place from 1 in the given order, and ``_before_<c>``, the sum of each column ``c`` over the rows before.

    Equal rows are told apart by place only. Rows are range-partitioned, sorted and written once; what comes before a
    row is the partitions before and the rows of its own. Beyond the exchange only one row per partition is looked at.
    """
    written = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    pieces = written.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"), *(F.sum(c).alias(f"_all_{c}") for c in sums))
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("_part", "_first", before("_rows").alias("_earlier"), *(before(f"_all_{c}").alias(f"_earlier_{c}") for c in sums))
    met = written.withColumn("_part", part).join(F.broadcast(pieces), "_part")
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    running = [(F.col(f"_earlier_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"_before_{c}") for c in sums]
    return met.select(*df.columns, (F.col("_earlier") + F.col("_at") - F.col("_first") + 1).cast("long").alias("_number"), *running)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows numbered from 1 in the given order, as ``name``."""
    return placed(df, *order).withColumnRenamed("_number", name)
