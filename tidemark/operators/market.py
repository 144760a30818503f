"""Row-level market observations: trade/quote tags, mid and spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Record types counted as trades and as quotes.
TRADE_TYPES = ("trade", "trades", "tbbo_trade")
QUOTE_TYPES = ("quote", "bbo", "mbp-1", "tbbo", "bbo-1s", "bbo-1m")


def spread_bps(spread: Column, mid: Column) -> Column:
    return F.when(mid > 0, spread / mid * 10000)


def observations(df: DataFrame) -> DataFrame:
    """Adds is_trade, is_quote and fills mid_obs, spread_obs from bid and ask when not given."""
    kind = F.lower(F.trim(F.col("record_type")))
    bid, ask = F.col("bid_price"), F.col("ask_price")
    mid = F.col("midprice") if "midprice" in df.columns else F.lit(None).cast("double")
    spread = F.col("spread") if "spread" in df.columns else F.lit(None).cast("double")
    return df.withColumns({
        "is_trade": kind.isin(*TRADE_TYPES) | (F.col("price").isNotNull() & F.col("size").isNotNull()
                                               & bid.isNull() & ask.isNull()),
        "is_quote": kind.isin(*QUOTE_TYPES) | (bid.isNotNull() & ask.isNotNull()),
        "mid_obs": F.coalesce(mid, (bid + ask) / 2),
        "spread_obs": F.coalesce(spread, ask - bid),
    })
