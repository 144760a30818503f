"""Fill payloads, slippage, broker positions and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank_to_null, finite, symbol
from tidemark.functions.times import parse_utc_iso

# Payload fields, in the order in which alternatives are tried.
FIELDS = {
    "fill_id": ("execution_id", "activity_id", "id", "trade_id"),
    "side": ("side",),
    "quantity": ("qty", "quantity"),
    "fill_price": ("price", "fill_price", "avg_price"),
    "fill_time": ("transaction_time", "filled_at", "fill_time", "timestamp"),
    "ticker": ("symbol", "ticker"),
    "broker_status": ("status", "type"),
}
NESTED = ("side", "symbol", "ticker")


def slippage(side: Column, fill_price: Column, expected: Column) -> tuple[Column, Column]:
    """(per share, bps): positive is worse than expected; NULL without a positive expected price."""
    usable = F.when(expected > 0, expected)
    amount = F.when(side == "BUY", fill_price - usable).when(side == "SELL", usable - fill_price)
    return amount, amount / usable * 10000


def with_slippage(df: DataFrame, *, explicit: str | None = None, arrival: str | None = None) -> DataFrame:
    """Adds expected_price, slippage, slippage_bps; an explicit price wins even when it is unusable."""
    chain = [F.col(c) for c in (explicit, arrival) if c]
    chosen = F.coalesce(*chain)
    amount, bps = slippage(F.col("side"), F.col("fill_price"), chosen)
    return df.withColumns({"expected_price": F.when(chosen > 0, chosen), "slippage": amount, "slippage_bps": bps})


def parse_payloads(df: DataFrame, column: str = "payload") -> DataFrame:
    """Fill rows from JSON payloads; ``error`` names the first missing or invalid field.

    ``json_tuple`` is a generator, so each payload is parsed once however many fields, filters
    and error tests read it (``from_json`` would be repeated in every pushed-down filter).
    """
    names = sorted({f for group in FIELDS.values() for f in group})
    top = df.select("*", F.json_tuple(column, *names, "order").alias(*[f"_{n}" for n in names], "_order"))
    p = top.select("*", F.json_tuple("_order", *NESTED).alias(*[f"_order_{n}" for n in NESTED])).drop("_order")

    def first(field, nested=False):
        inner = [F.col(f"_order_{n}") for n in FIELDS[field]] if nested else []
        return F.coalesce(*[F.col(f"_{n}") for n in FIELDS[field]], *inner)

    side = F.upper(F.trim(first("side", nested=True)))
    quantity, price = finite(first("quantity").try_cast("double")), finite(first("fill_price").try_cast("double"))
    own = [symbol("ticker")] if "ticker" in df.columns else []
    out = p.withColumns({
        "fill_id": blank_to_null(first("fill_id")), "side": side, "quantity": quantity, "fill_price": price,
        "fill_time": parse_utc_iso(first("fill_time")), "ticker": F.coalesce(symbol(first("ticker", nested=True)), *own),
        "broker_status": F.coalesce(blank_to_null(first("broker_status")), F.lit("filled"))})
    out = out.withColumn("error", F.when(F.col("fill_id").isNull(), "missing_fill_id")
                         .when(~F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False)), "invalid_side")
                         .when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "invalid_quantity")
                         .when(~F.coalesce(F.col("fill_price") > 0, F.lit(False)), "invalid_fill_price")
                         .when(F.col("fill_time").isNull(), "invalid_fill_time"))
    return out.drop(*[f"_{n}" for n in names], *[f"_order_{n}" for n in NESTED])


def broker_positions(df: DataFrame) -> DataFrame:
    """ticker, signed quantity and ``error`` from broker rows (symbol, qty, side)."""
    side, qty = F.lower(F.trim("side")), F.col("qty").cast("double")
    return df.select(
        symbol("symbol").alias("ticker"),
        F.when(side == "short", -F.abs(qty)).when(side == "long", F.abs(qty)).alias("quantity"),
        F.when(~F.coalesce(side.isin("short", "long"), F.lit(False)), "invalid_side").alias("error"))


def reconcile(broker: DataFrame, local: DataFrame, *, on=("ticker",), tolerance: float = 1e-9) -> DataFrame:
    """Broker rows against local positions; a missing local position counts as zero."""
    mine = local.select(*on, F.col("quantity").alias("local_quantity"))
    df = broker.withColumnRenamed("quantity", "broker_quantity").join(mine, list(on), "left")
    df = df.withColumn("local_quantity", F.coalesce("local_quantity", F.lit(0.0)))
    diff = F.col("local_quantity") - F.col("broker_quantity")
    return df.withColumns({
        "quantity_difference": diff, "matched": F.abs(diff) <= tolerance,
        "match_reason": F.when(F.abs(diff) <= tolerance, "position_quantity_match").otherwise("position_quantity_mismatch")})


def reconciliation_events(result: DataFrame, event_time: Column) -> DataFrame:
    """Health rows: OK when matched, WARNING otherwise, with a fixed message layout."""
    return result.select(
        event_time.alias("event_time"), F.lit("position_reconciliation").alias("component"),
        F.when(F.col("matched"), "OK").otherwise("WARNING").alias("status"),
        F.concat(F.lit("ticker="), F.col("ticker"), F.lit(" local_quantity="), F.col("local_quantity").cast("string"),
                 F.lit(" broker_quantity="), F.col("broker_quantity").cast("string"),
                 F.lit(" quantity_difference="), F.col("quantity_difference").cast("string"),
                 F.lit(" reasons="), F.col("match_reason")).alias("message"))
