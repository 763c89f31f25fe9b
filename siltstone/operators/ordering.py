"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import durable

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low bits
SORTED_ROWS = 1_000_000  # about so many rows are sorted by one task, whatever the size of the table


def with_position(df: DataFrame, *order: str, name: str = "position", first: int = 0) -> DataFrame:
    """Number the rows by ``order``, which must tell all rows apart.

    The rows are range partitioned and sorted once and written to the
    checkpoint folder, so that both uses see the same partitions even after an
    executor is lost.  Only the row count per partition meets in one task.
    Counting the rows and finding the ranges read ``df`` beforehand: pass a
    written table where its rows are costly to make, and no column that is not
    wanted, as all of them are sorted.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = df.count() // SORTED_ROWS
    # Without a number, adaptive execution joins small partitions; with one, large tables get more.
    ranged = df.repartitionByRange(large, *order) if large > partitions else df.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order)
    slotted = durable(ordered.withColumn("_slot", F.monotonically_increasing_id()))
    slotted = slotted.withColumn("_part", F.shiftright("_slot", _ROW_BITS))
    sizes = slotted.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    row = F.col("_slot").bitwiseAND((1 << _ROW_BITS) - 1)
    # One row per partition of the exchange, whatever the size of the table.
    return slotted.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + row + first).cast("bigint").alias(name)
    )
