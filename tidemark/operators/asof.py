"""As-of joins as one union and one running value (no range join, no per-probe search)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import OrderedScan, Running


def asof_join(left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_at: str, right_at: str,
              right_order: Sequence[str] = (), right_cols: Sequence[str], direction: str = "backward",
              sliced: bool | None = None) -> DataFrame:
    """For every left row the nearest right row of the same key.

    backward: last right row at or before ``left_at``; forward: first at or after it.  On
    equal right times the order columns decide (forward takes the first, backward the last).
    Adds the ``right_cols`` (NULL when there is none).
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be 'backward' or 'forward'")
    forward = direction == "forward"
    tie = [f"_o{i}" for i in range(len(right_order))]
    types = dict(right.select(*right_order).dtypes) if right_order else {}
    # at one instant a probe precedes the rows it may see when looking forward, follows them otherwise
    probes = left.select(
        *keys, F.col(left_at).alias("_at"), F.lit(0 if forward else 1).alias("_kind"),
        *[F.lit(None).cast(types[c]).alias(t) for c, t in zip(right_order, tie)],
        F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*right_cols)).schema[0].dataType).alias("_right"))
    rows = right.select(
        *keys, F.col(right_at).alias("_at"), F.lit(1 if forward else 0).alias("_kind"),
        *[F.col(c).alias(t) for c, t in zip(right_order, tie)],
        F.lit(None).cast(probes.schema["_left"].dataType).alias("_left"),
        F.struct(*right_cols).alias("_right"))
    scan = OrderedScan(probes.unionByName(rows), keys, ["_at", "_kind", *tie], sliced=sliced)
    out = scan.running(Running("_hit", "last", F.col("_right")), reverse=forward).result()
    out = out.filter(F.col("_left").isNotNull())
    return out.select("_left.*", *[F.col(f"_hit.`{c}`").alias(c) for c in right_cols])
