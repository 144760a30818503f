"""Cost estimates as pure column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("BUY", "SELL")
HORIZON_SECONDS = {"1m": 60, "5m": 300, "15m": 900}
STYLES = ("MARKET", "LIMIT_AT_MID")


@dataclass(frozen=True)
class CostConfig:
    min_edge_bps: float = 1.0
    slippage_per_share: float = 0.02
    market_spread_multiplier: float = 1.0
    limit_spread_multiplier: float = 0.0
    missed_fill_probability: dict = field(default_factory=lambda: {"1m": 0.30, "5m": 0.20, "15m": 0.10})
    size_penalty_bps_per_1000: float = 0.25
    size_penalty_free_quantity: float = 100.0
    fallback_spread_bps: float = 1.0
    version: str = "cost_model_v1"

    def __post_init__(self):
        numbers = (self.min_edge_bps, self.slippage_per_share, self.market_spread_multiplier, self.limit_spread_multiplier,
                   self.size_penalty_bps_per_1000, self.size_penalty_free_quantity, self.fallback_spread_bps)
        if any(not 0 <= x < float("inf") for x in numbers):
            raise ValueError("cost parameters must be finite and not negative")
        if set(self.missed_fill_probability) != set(HORIZON_SECONDS) or any(
                not 0 <= p <= 1 for p in self.missed_fill_probability.values()):
            raise ValueError("missed-fill probabilities must cover 1m, 5m, 15m and lie in [0, 1]")


def input_error(df: DataFrame) -> Column:
    """First reason why the row cannot be costed, NULL when it can."""
    def col(name, default):
        return F.col(name) if name in df.columns else F.lit(default)

    spread, bps = col("spread", None), col("spread_bps", None)
    return (F.when(~F.coalesce(F.col("side").isin(*SIDES), F.lit(False)), "invalid_side")
            .when(~F.coalesce(F.col("horizon").isin(*HORIZON_SECONDS), F.lit(False)), "invalid_horizon")
            .when(~F.coalesce(F.col("order_style").isin(*STYLES), F.lit(False)), "invalid_order_style")
            .when(F.col("expected_gross_move_bps").isNull() | F.isnan("expected_gross_move_bps"), "invalid_expected_move")
            .when(~F.coalesce(F.col("midprice") > 0, F.lit(False)), "invalid_midprice")
            .when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "invalid_quantity")
            .when(F.coalesce(col("is_crossed_or_locked", False), F.lit(False)), "crossed_or_locked")
            .when(bps < 0, "negative_spread_bps")
            .when(bps.isNull() & (spread < 0), "negative_spread"))


def estimate(df: DataFrame, config: CostConfig = CostConfig()) -> DataFrame:
    """Adds the cost columns; rows with an ``error`` keep NULL costs.

    Needs side, horizon, order_style, expected_gross_move_bps, midprice, quantity and
    optionally spread, spread_bps, is_crossed_or_locked.
    """
    mid = F.col("midprice")
    dollars = F.col("spread") if "spread" in df.columns else F.lit(None).cast("double")
    bps = F.col("spread_bps") if "spread_bps" in df.columns else F.lit(None).cast("double")
    given = F.coalesce(bps, F.when(mid > 0, dollars / mid * 10000), F.lit(0.0))
    market = F.col("order_style") == "MARKET"
    chance = F.create_map(*[x for h, p in config.missed_fill_probability.items() for x in (F.lit(h), F.lit(float(p)))])
    df = df.withColumn("error", input_error(df))
    ok = F.col("error").isNull()
    df = df.withColumns({
        "fallback_spread_applied": F.when(ok, given == 0),
        "cost_spread_bps": F.when(ok, F.when(given == 0, F.lit(config.fallback_spread_bps)).otherwise(given)),
        "estimated_slippage_bps": F.when(ok, F.lit(config.slippage_per_share) / mid * 10000),
        "size_penalty_bps": F.when(ok, F.greatest(F.col("quantity") - config.size_penalty_free_quantity, F.lit(0.0))
                                   / 1000.0 * config.size_penalty_bps_per_1000),
        "missed_fill_probability": F.when(ok, F.when(market, 0.0).otherwise(F.try_element_at(chance, F.col("horizon")))),
    })
    df = df.withColumn("spread_cost_bps", F.col("cost_spread_bps") * F.when(
        market, config.market_spread_multiplier).otherwise(config.limit_spread_multiplier))
    df = df.withColumn("base_cost_bps", F.col("spread_cost_bps") + F.col("estimated_slippage_bps") + F.col("size_penalty_bps"))
    df = df.withColumn("pre_missed_fill_net_edge_bps", F.col("expected_gross_move_bps") - F.col("base_cost_bps"))
    df = df.withColumn("missed_fill_penalty_bps", F.when(
        ok, F.col("missed_fill_probability") * F.greatest(F.col("pre_missed_fill_net_edge_bps"), F.lit(0.0))))
    df = df.withColumn("total_cost_bps", F.col("base_cost_bps") + F.col("missed_fill_penalty_bps"))
    df = df.withColumn("net_expected_edge_bps", F.col("expected_gross_move_bps") - F.col("total_cost_bps"))
    return df.withColumns({
        "min_edge_bps": F.lit(config.min_edge_bps),
        "profitable_after_costs": F.col("net_expected_edge_bps") > config.min_edge_bps,
        "assumptions_version": F.lit(config.version),
        "reason": F.when(F.col("fallback_spread_applied"), F.lit("fallback_minimum_spread_bps_applied")),
    })


def move_bps(side: Column, entry: Column, leave: Column) -> Column:
    """Mid-to-mid move in favour of the side."""
    ok = (entry > 0) & (leave > 0)
    return F.when(ok & (side == "BUY"), (leave / entry - 1) * 10000).when(ok & (side == "SELL"), (entry / leave - 1) * 10000)


def estimate_from_mids(df: DataFrame, config: CostConfig = CostConfig()) -> DataFrame:
    """Cost from entry_midprice and exit_midprice; spread falls back to ask - bid."""
    if "spread" not in df.columns and {"bid_price", "ask_price"} <= set(df.columns):
        df = df.withColumn("spread", F.col("ask_price") - F.col("bid_price"))
    df = df.withColumns({
        "expected_gross_move_bps": move_bps(F.col("side"), F.col("entry_midprice"), F.col("exit_midprice")),
        "midprice": F.col("entry_midprice")})
    return estimate(df, config)
