"""Point-in-interval join on an equality of (key, level, bucket).

An interval is stored at the smallest bucket width it spans at most twice, so it makes one
or two rows however long it is; a point probes one bucket per width.  A pure range
condition would be a nested loop over all pairs; this is a hash or sort-merge join whose
candidate rows are near misses only, and a popular key is spread over its time buckets.
Intervals without an end are apart: they are joined on their keys and the start alone, for
every point after the start is a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Bucket widths in microseconds: an hour, a day, a month, three years, a century.
WIDTHS = (HOUR, 24 * HOUR, 30 * 24 * HOUR, 1_100 * 24 * HOUR, 40_000 * 24 * HOUR)
OPEN = -1


def interval_join(points: DataFrame, intervals: DataFrame, *, keys: Sequence[str], at: str, start: str, end: str,
                  widths: Sequence[int] = WIDTHS) -> DataFrame:
    """Inner join: same keys and ``start <= at <= end`` (micros, inclusive; NULL end is open)."""
    lo, hi = F.col(start), F.col(end)

    def bucket(c, w):
        return F.floor(c / F.lit(w)).cast("long")

    level = F.lit(len(widths) - 1)
    for i in range(len(widths) - 2, -1, -1):
        level = F.when(bucket(hi, widths[i]) - bucket(lo, widths[i]) <= 1, F.lit(i)).otherwise(level)
    widths_col = F.array(*[F.lit(w) for w in widths])
    closed = (intervals.filter(hi >= lo).withColumn("_level", level)
              .withColumn("_w", F.element_at(widths_col, F.col("_level") + 1)))
    closed = closed.withColumn("_bucket", F.explode(F.sequence(
        F.floor(lo / F.col("_w")).cast("long"), F.floor(hi / F.col("_w")).cast("long")))).drop("_w")
    opened = intervals.filter(hi.isNull() & lo.isNotNull()).withColumns({"_level": F.lit(OPEN), "_bucket": F.lit(0).cast("long")})
    stored = closed.unionByName(opened)
    probe = points.withColumn("_probe", F.explode(F.array(*[
        F.struct(F.lit(i).alias("_level"), bucket(F.col(at), w).alias("_bucket")) for i, w in enumerate(widths)],
        F.struct(F.lit(OPEN).alias("_level"), F.lit(0).cast("long").alias("_bucket")))))
    probe = probe.select(*points.columns, "_probe.*")
    # a merge join: sizes estimated from files miss what aggregates and buckets make of them, and a side that only seems small would pass the driver
    out = probe.join(stored.hint("merge"), [*keys, "_level", "_bucket"])
    return out.filter((F.col(at) >= lo) & (hi.isNull() | (F.col(at) <= hi))).drop("_level", "_bucket")
