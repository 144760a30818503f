"""Arrival-order windows: the batch twin of the live feature stream.

Records count in arrival order.  The cut-off is the running maximum event time minus the
look-back, so a late record never moves it back.  Record j leaves at the first arrival whose
running maximum passes its time plus the look-back; counting arrivals minus departures with
two running sums needs no pairwise comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.ordered import OrderedScan, Running


def live_totals(df: DataFrame, *, key: str, at: str, arrival: str, values: dict[str, str],
                lookback: int, sliced: bool | None = None) -> DataFrame:
    """Adds ``max_time``, ``live_rows`` and one ``live_<name>`` sum per value column.

    ``at`` (micros) and ``arrival`` are longs; arrivals are unique within the key.
    """
    scan = OrderedScan(df, [key], [arrival], sliced=sliced)
    rows = scan.running(Running("max_time", "max", F.col(at)), Running("_before", "max", F.col(at), False)).result()
    # arrivals that raise the maximum; a row leaves at the first of them later than time + look-back
    rises = rows.filter(F.col("_before").isNull() | (F.col(at) > F.col("_before"))).select(
        key, F.col(at).alias("_rise"), F.col(arrival).alias("_rise_arrival"))
    leaving = rows.withColumn("_limit", F.col(at) + F.lit(lookback + 1))
    gone = asof_join(leaving, rises, keys=[key], left_at="_limit", right_at="_rise", right_order=["_rise_arrival"],
                     right_cols=["_rise_arrival"], direction="forward", sliced=sliced)
    sums = ["_n", *[f"_v_{n}" for n in values]]
    base = gone.withColumn("_n", F.lit(1).cast("double")).withColumns(
        {f"_v_{n}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for n, c in values.items()})
    arrive = base.withColumns({"_seq": F.col(arrival), "_kind": F.lit(1), "_tie": F.col(arrival)})
    leave = (base.filter(F.col("_rise_arrival").isNotNull())
             .withColumns({"_seq": F.greatest(F.col("_rise_arrival"), F.col(arrival)), "_kind": F.lit(0), "_tie": F.col(arrival)})
             .withColumns({s: -F.col(s) for s in sums}))
    # a departure at the row's own arrival must be seen by that row: departures sort first
    moves = OrderedScan(arrive.unionByName(leave), [key], ["_seq", "_kind", "_tie"], sliced=sliced).running(
        *[Running(s.replace("_v_", "live_") if s != "_n" else "live_rows", "sum", F.col(s)) for s in sums]).result()
    names = ["live_rows", *[f"live_{n}" for n in values]]
    return (moves.filter(F.col("_kind") == 1)
            .withColumn("live_rows", F.col("live_rows").cast("long"))
            .select(*df.columns, "max_time", *names))
