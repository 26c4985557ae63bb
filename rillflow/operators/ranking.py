"""Ranks within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.lineage import cut

ROW = (1 << 33) - 1


def distributed_rank(rows: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """`rows` with `name`: 1, 2, ... within each `group` in `order`, which must leave no ties that matter.

    The rows are range-partitioned by group and order, so a large group takes
    several neighbouring partitions. A row's rank is its place in its partition, less
    the place at which its group begins there, and the sum of what the partitions
    before hold of the group. Of a partition only (partition, group, first place,
    rows) is gathered. A null group is a group.
    """
    placed = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    number = F.monotonically_increasing_id()
    placed = cut(placed.withColumns({"_part": F.shiftright(number, 33).cast("int"), "_at": number.bitwiseAND(F.lit(ROW))}))
    held = placed.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_g")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("_p", "_g", (before - F.col("_first") + 1).alias("_shift"))
    joined = placed.join(held, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_p", "_g", "_shift")
