"""Price bars: wide-to-long, duplicates, completed-bar indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import finite, stable_id
from tidemark.functions.times import MINUTE, SECOND, micros
from tidemark.operators.ordered import first_per_key
from tidemark.session import stable

BAR_SECONDS = 300
LOOKBACKS = (5, 15, 60)


def wide_to_long(df: DataFrame, symbols: Sequence[str], *, time: str = "bar_start", field: str = "Close") -> DataFrame:
    """Columns named ``<field>_<symbol>`` (or ``<field>`` for one symbol) to (symbol, bar_start, close)."""
    names = {s: f"{field}_{s}" for s in symbols if f"{field}_{s}" in df.columns}
    if not names and len(symbols) == 1 and field in df.columns:
        names = {symbols[0]: field}
    if not names:
        raise ValueError(f"no {field} column for any requested symbol")
    wide = df.select(time, *[F.col(f"`{c}`").cast("double").alias(s) for s, c in names.items()])
    return wide.unpivot([time], list(names), "symbol", "close").select("symbol", F.col(time).alias("bar_start"), "close")


def missing_symbols(bars: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.select("symbol").distinct().join(bars.filter(F.col("close").isNotNull()).select("symbol").distinct(), "symbol", "left_anti")


def prepare(bars: DataFrame, *, order: Sequence[str] = ("row_seq",)) -> tuple[DataFrame, DataFrame]:
    """(bars, issues): one row per symbol and time; a symbol with conflicting closes is rejected whole."""
    close = finite("close")
    df = bars.withColumn("usable", F.coalesce(close > 0, F.lit(False)))
    good = F.when(F.col("usable"), F.col("close"))
    clash = df.groupBy("symbol", "bar_start").agg((F.min(good) < F.max(good)).alias("bad")).filter("bad")
    rejected = clash.groupBy("symbol").agg(F.min("bar_start").alias("bar_start"))
    kept = first_per_key(df, ["symbol", "bar_start"], list(order)).join(rejected.select("symbol"), "symbol", "left_anti")
    return kept, rejected.select("symbol", F.lit("CONFLICTING_DUPLICATE_TIMESTAMP").alias("issue_type"), F.lit(None).cast("string").alias("window"))


def indicators(bars: DataFrame, now: Column, *, bar_seconds: int = BAR_SECONDS, grace_seconds: int = 30,
               max_staleness_seconds: int = 360, lookbacks: Sequence[int] = LOOKBACKS) -> tuple[DataFrame, DataFrame]:
    """(indicators, issues) of prepared bars at one instant: latest close and exact look-back returns."""
    if max_staleness_seconds < bar_seconds + grace_seconds:
        raise ValueError("staleness must allow one bar and its grace")
    bars = stable(bars, "bars")                             # read by the status, look-back and issue branches
    t, start = micros(now), micros("bar_start")
    done = bars.withColumn("_start", start).filter(F.col("_start") <= t - F.lit((bar_seconds + grace_seconds) * SECOND))
    status = bars.groupBy("symbol").agg(F.lit(1).alias("_any")).join(
        done.groupBy("symbol").agg(F.max_by(F.struct("_start", "close"), F.when(F.col("usable"), F.col("_start"))).alias("_last"),
                                   F.bool_or("usable").alias("_usable")), "symbol", "left")
    end = F.col("_last._start") + F.lit(bar_seconds * SECOND)
    freshness = (t - end) / F.lit(1e6)
    reason = (F.when(F.col("_usable").isNull(), "NO_COMPLETED_BARS").when(~F.col("_usable"), "NO_VALID_COMPLETED_CLOSE")
              .when(freshness > max_staleness_seconds, "STALE_SOURCE_DATA"))
    status = status.withColumns({"_reason": reason, "freshness_seconds": freshness})
    issues = status.filter(F.col("_reason").isNotNull()).select("symbol", F.col("_reason").alias("issue_type"),
                                                               F.lit(None).cast("string").alias("window"))
    live = status.filter(F.col("_reason").isNull()).select(
        "symbol", F.col("_last._start").alias("_start"), F.col("_last.close").alias("_close"), "freshness_seconds")
    latest = live.select("symbol", F.lit("latest_close").alias("indicator"), F.lit("5m").alias("window"), F.col("_close").alias("value"),
                         F.lit("price").alias("units"), "_start", "freshness_seconds")
    probes = live.withColumn("_minutes", F.explode(F.array(*[F.lit(m) for m in lookbacks]))).withColumn(
        "_target", F.col("_start") - F.col("_minutes").cast("long") * F.lit(MINUTE))
    past = done.select("symbol", F.col("_start").alias("_target"), F.col("close").alias("_past"), F.col("usable").alias("_past_ok"))
    both = probes.join(past, ["symbol", "_target"], "left").withColumn("window", F.concat(F.col("_minutes").cast("string"), F.lit("m")))
    returns = both.filter("_past_ok").select(
        "symbol", F.concat(F.lit("return_"), "window").alias("indicator"), "window", (F.col("_close") / F.col("_past") - 1).alias("value"),
        F.lit("return").alias("units"), "_start", "freshness_seconds")
    gaps = both.filter(~F.coalesce("_past_ok", F.lit(False))).select(
        "symbol", F.when(F.col("_past_ok").isNull(), "MISSING_EXACT_LOOKBACK").otherwise("INVALID_TARGET_CLOSE").alias("issue_type"), "window")
    rows = latest.unionByName(returns)
    bar_end = F.col("_start") + F.lit(bar_seconds * SECOND)
    rows = rows.withColumns({
        "bar_start": F.timestamp_micros("_start"), "source_event_time": F.timestamp_micros(bar_end),
        "effective_from": F.timestamp_micros(bar_end + F.lit(grace_seconds * SECOND)),
        "valid_until": F.timestamp_micros(bar_end + F.lit(max_staleness_seconds * SECOND)),
        "indicator_id": stable_id("context_indicator", F.lit("yfinance_dev_raw_v1"), F.col("symbol"), F.col("indicator"), F.col("window"), bar_end),
        "name": F.concat_ws(":", F.lit("yfinance_dev_raw_v1"), F.upper("symbol"), "indicator", "window")}).drop("_start")
    return rows, issues.unionByName(gaps)


def with_registry(rows: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with scope and sector, rows of unregistered symbols)."""
    reg = registry.select("symbol", "scope", "sector")
    return rows.join(reg, "symbol"), rows.join(reg, "symbol", "left_anti")
