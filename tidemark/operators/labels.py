"""Forward labels: snapshot x horizon x side, priced by a forward as-of join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import SECOND, in_session, micros, session_close
from tidemark.operators.asof import asof_join
from tidemark.operators.cost import HORIZON_SECONDS, SIDES, CostConfig, estimate_from_mids


@dataclass(frozen=True)
class LabelConfig:
    horizons: tuple[str, ...] = ("1m", "5m", "15m")
    sides: tuple[str, ...] = SIDES
    tolerance_seconds: float = 5.0
    min_age_seconds: float = 0.0
    enforce_session: bool = True
    zone: str = "America/New_York"
    session_open: str = "09:30"
    session_close: str = "16:00"
    order_style: str = "MARKET"
    quantity: float = 1.0
    version: str = "labels_v1"
    horizon_seconds: dict = field(default_factory=lambda: dict(HORIZON_SECONDS))


def forward_prices(snapshots: DataFrame, prices: DataFrame, config: LabelConfig = LabelConfig(), *,
                   price_order=("ingest_seq",), sliced: bool | None = None) -> DataFrame:
    """Snapshot x horizon with the earliest same-ticker price in [target + min age, limit].

    ``prices``: ticker, event_time, midprice and the order columns.  Adds horizon,
    target_time, forward_event_time, forward_midprice and missing_reason.
    """
    unknown = set(config.horizons) - set(config.horizon_seconds)
    if unknown:
        raise ValueError(f"unsupported horizons: {sorted(unknown)}")
    seconds = F.create_map(*[x for h in config.horizons for x in (F.lit(h), F.lit(config.horizon_seconds[h]))])
    probes = snapshots.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in config.horizons])))
    target = micros("snapshot_time") + F.element_at(seconds, F.col("horizon")) * F.lit(SECOND)
    probes = probes.withColumn("target_time", F.timestamp_micros(target))
    limit = micros("target_time") + F.lit(int(config.tolerance_seconds * SECOND))
    if config.enforce_session:
        probes = probes.withColumn("_open", in_session("snapshot_time", config.zone, config.session_open, config.session_close)
                                   & in_session("target_time", config.zone, config.session_open, config.session_close))
        limit = F.least(limit, micros(session_close("target_time", config.zone, config.session_close)))
    else:
        probes = probes.withColumn("_open", F.lit(True))
    probes = probes.withColumns({"_limit": limit, "_from": micros("target_time") + F.lit(int(config.min_age_seconds * SECOND))})
    observed = prices.filter(F.col("midprice") > 0).select(
        "ticker", micros("event_time").alias("_time"), F.col("midprice").alias("_mid"), *price_order)
    hit = asof_join(probes, observed, keys=["ticker"], left_at="_from", right_at="_time", right_order=price_order,
                    right_cols=["_time", "_mid"], direction="forward", sliced=sliced)
    usable = F.col("_open") & (F.col("_time") <= F.col("_limit"))
    return hit.select(
        *snapshots.columns, "horizon", "target_time",
        F.when(usable, F.timestamp_micros("_time")).alias("forward_event_time"),
        F.when(usable, F.col("_mid")).alias("forward_midprice"),
        F.when(~F.col("_open"), "outside_session").when(~F.coalesce(usable, F.lit(False)), "no_forward_price")
        .alias("missing_reason"))


def labels(snapshots: DataFrame, prices: DataFrame, config: LabelConfig = LabelConfig(),
           cost: CostConfig = CostConfig(), *, price_order=("ingest_seq",), sliced: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, rejected): rejected rows carry ``error`` (missing price, bad mid, crossed book, ...).

    ``snapshots``: ticker, snapshot_time, midprice and optionally spread, spread_bps,
    is_crossed_or_locked and identifiers, which are kept.
    """
    priced = forward_prices(snapshots, prices, config, price_order=price_order, sliced=sliced)
    rows = priced.withColumn("side", F.explode(F.array(*[F.lit(s) for s in config.sides]))).withColumns({
        "entry_midprice": F.col("midprice"), "exit_midprice": F.col("forward_midprice"),
        "order_style": F.lit(config.order_style), "quantity": F.lit(float(config.quantity))})
    costed = estimate_from_mids(rows, cost)
    costed = costed.withColumns({"error": F.coalesce(F.col("missing_reason"), F.col("error")),
                                 "label_version": F.lit(config.version)}).drop("missing_reason", "exit_midprice")
    return costed.filter(F.col("error").isNull()).drop("error"), costed.filter(F.col("error").isNotNull())
