"""Ledger summaries as (section, metric, key, value) rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Health statuses counted as warnings or errors (exact case).
ALERTS = ("warn", "warning", "error", "WARN", "WARNING", "ERROR")
COUNTED = ("model_signals", "risk_decisions", "cost_estimates", "order_events", "fill_events", "trade_outcomes", "system_health_events")


def _long(df: DataFrame, section: str, *metrics: str, key: Column | None = None) -> DataFrame:
    """Wide aggregates to long rows."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(section).alias("section"), (key if key is not None else F.lit("")).alias("key"), F.explode(cells).alias("_c")).select(
        "section", "_c.metric", "key", "_c.value")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [_long(df.agg(F.count(F.lit(1)).alias("rows")), "table_counts", "rows", key=F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _total_and_by(df: DataFrame, section: str, by: list[str], total: dict[str, Column], grouped: str) -> DataFrame:
    """Totals, and counts per key, in one pass over the table (grouping sets)."""
    agg = df.groupingSets([by, []], *by).agg(F.grouping(by[0]).alias("_all"), F.count(F.lit(1)).alias(grouped), *[c.alias(n) for n, c in total.items()])

    def cells(*names):
        return F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])

    everything = F.col("_all") == 1
    return agg.select(F.lit(section).alias("section"), F.when(everything, "").otherwise(F.concat_ws("|", *by)).alias("key"),
                      F.explode(F.when(everything, cells(*total)).otherwise(cells(grouped))).alias("_c")).select("section", "_c.metric", "key", "_c.value")


def signals(df: DataFrame) -> DataFrame:
    return _total_and_by(df, "signals", ["ticker"], {"signal_count": F.count(F.lit(1)), "avg_confidence": F.avg("confidence")}, "ticker_count")


def decisions(df: DataFrame) -> DataFrame:
    return _total_and_by(df, "risk_decisions", ["ticker"], {
        "decision_count": F.count(F.lit(1)), "approved_count": F.count_if(F.col("approved")), "rejected_count": F.count_if(~F.col("approved"))}, "ticker_count")


def costs(df: DataFrame) -> DataFrame:
    return _long(df.agg(F.count(F.lit(1)).alias("estimate_count"), F.count_if("profitable_after_costs").alias("profitable_count"),
                        F.avg("net_expected_edge_bps").alias("avg_net_edge_bps")), "costs", "estimate_count", "profitable_count", "avg_net_edge_bps")


def executions(orders: DataFrame, fills: DataFrame) -> DataFrame:
    o = _long(orders.agg(F.count(F.lit(1)).alias("order_count")), "execution", "order_count")
    return o.unionByName(_long(fills.agg(F.count(F.lit(1)).alias("fill_count"), F.avg("slippage_bps").alias("avg_slippage_bps")),
                               "execution", "fill_count", "avg_slippage_bps"))


def outcomes(df: DataFrame) -> DataFrame:
    return _long(df.agg(F.count(F.lit(1)).alias("outcome_count"), F.avg("realized_pnl").alias("avg_realized_pnl"),
                        *[F.avg(f"return_{h}").alias(f"avg_return_{h}") for h in ("1m", "5m", "15m")]),
                 "outcomes", "outcome_count", "avg_realized_pnl", "avg_return_1m", "avg_return_5m", "avg_return_15m")


def health(df: DataFrame) -> DataFrame:
    return _total_and_by(df, "health", ["component", "status"], {"warning_error_count": F.count_if(F.col("status").isin(*ALERTS))}, "event_count")


def ledger(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All sections as one long table; ``tables`` maps the seven counted names to DataFrames."""
    parts = [table_counts({n: tables[n] for n in COUNTED}), signals(tables["model_signals"]), decisions(tables["risk_decisions"]),
             costs(tables["cost_estimates"]), executions(tables["order_events"], tables["fill_events"]), outcomes(tables["trade_outcomes"]),
             health(tables["system_health_events"])]
    return reduce(DataFrame.unionByName, parts)
