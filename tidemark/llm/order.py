"""Places of rows in an order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stable

#: ``monotonically_increasing_id`` keeps the task's number above these bits.
TASK_BITS = 33


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "at") -> DataFrame:
    """``df`` with ``name``, 0, 1, ... in ascending ``order`` (NULLs first) within the group, and the group's size ``n``.

    Rows are cut into ranges of (group, order), sorted there and written once to the shared folder;
    only the sizes of the ranges' parts of a group, one row each, meet in one task.  Rows that are
    equal in all of these are dealt over ranges by their place in the input, so many repeats
    are no large range; which of them comes first is not defined.  Group columns are not NULL.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order, "_n"]
    df = df.withColumn("_n", F.monotonically_increasing_id())
    cut = stable(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_n")
                 .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    cut = cut.withColumn("_task", F.shiftright("_at", TASK_BITS))
    part = cut.groupBy("_task", *group).agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_from"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    part = part.select("_task", *group, (F.sum("_size").over(whole.orderBy("_task")) - F.col("_size") - F.col("_from")).alias("_shift"),
                       F.sum("_size").over(whole).alias("n"))
    if not group:
        part = F.broadcast(part)  # one row for each range
    return cut.join(part, ["_task", *group]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_task", "_shift", "_at")
