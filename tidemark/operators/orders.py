"""Order intents from risk decisions, close resolution and submission capture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank_to_null
from tidemark.functions.times import micros

# Order statuses that no longer count as open (lower case).
INACTIVE = ("filled", "canceled", "cancelled", "rejected", "expired", "closed", "released")


@dataclass(frozen=True)
class OrderConfig:
    default_quantity: float = 1.0
    max_open_orders_per_symbol: int = 1
    require_logged_decision: bool = True
    allow_exit_when_log_failed: bool = True


def open_order_flags(open_orders: DataFrame) -> DataFrame:
    """Per upper-case ticker: has_close, has_buy, has_sell, active_orders."""
    active = open_orders.filter(~F.lower("status").isin(*INACTIVE))
    side = F.upper("side")
    return active.groupBy(F.upper("ticker").alias("_symbol")).agg(
        F.bool_or(side == "CLOSE_POSITION").alias("has_close"), F.bool_or(side == "BUY").alias("has_buy"),
        F.bool_or(side == "SELL").alias("has_sell"), F.count(F.lit(1)).alias("active_orders"))


def gate(decisions: DataFrame, *, open_orders: DataFrame | None = None, used_signals: DataFrame | None = None,
         config: OrderConfig = OrderConfig(), seq: str | None = None) -> DataFrame:
    """Adds allowed, reason, intent_side, effective_quantity to signal + decision rows.

    Needs signal_id, ticker, signal, decision, approved, reduce_size_factor and optionally
    decision_signal_id, decision_ticker, risk_logged, desired_quantity.  With ``seq`` each
    allowed row reserves its ticker for the rows after it in the same batch: after the first
    entry any other entry is a duplicate or a conflict, after the first close nothing passes,
    so two per-ticker minima replace a sequential replay.  Signal ids are unique in a batch.
    """
    def opt(name, default):
        return F.col(name) if name in decisions.columns else F.lit(default)

    df = decisions.withColumns({
        "_symbol": F.upper("ticker"),
        "_qty": F.coalesce(opt("desired_quantity", None).cast("double"), F.lit(float(config.default_quantity)))})
    if open_orders is not None:
        df = df.join(open_order_flags(open_orders), "_symbol", "left")
    else:
        df = df.withColumns({"has_close": F.lit(False), "has_buy": F.lit(False), "has_sell": F.lit(False),
                             "active_orders": F.lit(0)})
    df = df.na.fill(False, ["has_close", "has_buy", "has_sell"]).na.fill(0, ["active_orders"])
    if used_signals is not None:
        used = used_signals.select("signal_id").distinct().withColumn("_used", F.lit(True))
        df = df.join(used, "signal_id", "left")
    else:
        df = df.withColumn("_used", F.lit(False))
    logged = F.coalesce(opt("risk_logged", True), F.lit(False))
    side = F.when(F.col("signal").isin("BUY", "SELL"), F.col("signal"))
    exits = F.col("decision") == "EXIT"
    factor = F.col("reduce_size_factor")
    bad_factor = ~F.coalesce((factor > 0) & (factor <= 1), F.lit(False))
    amount = F.when(F.col("decision") == "REDUCE_SIZE", F.col("_qty") * factor).otherwise(F.col("_qty"))
    infinite = F.isnan("_qty") | (F.abs("_qty") == float("inf"))
    # up to here nothing depends on the other rows of the batch
    before_state = (
        F.when(opt("decision_signal_id", None).isNotNull() & (opt("decision_signal_id", None) != F.col("signal_id")),
               "risk_decision_signal_mismatch")
        .when(F.upper(opt("decision_ticker", None)) != F.col("_symbol"), "risk_decision_ticker_mismatch")
        .when(F.coalesce("_used", F.lit(False)), "duplicate_signal_id")
        .when(F.col("decision") == "BLOCK", "risk_decision_blocked")
        .when(F.col("decision") == "DO_NOTHING", "risk_decision_do_nothing")
        .when(~F.coalesce("approved", F.lit(False)), "risk_decision_not_approved")
        .when(exits & ~logged & F.lit(not config.allow_exit_when_log_failed), "risk_log_failed")
        .when(exits & F.col("has_close"), "close_position_already_in_progress")
        .when(exits, F.lit(None))
        .when(side.isNull(), "signal_no_order")
        .when(F.lit(config.require_logged_decision) & ~logged, "risk_log_failed")
        .when(infinite, "invalid_quantity")
        .when((F.col("decision") == "REDUCE_SIZE") & bad_factor, "invalid_reduce_size_factor")
        .when(~F.col("decision").isin("APPROVE", "REDUCE_SIZE"), "unsupported_risk_decision")
        .when(~(amount > 0), "invalid_quantity"))
    same = F.when(side == "BUY", F.col("has_buy")).otherwise(F.col("has_sell"))
    other = F.when(side == "BUY", F.col("has_sell")).otherwise(F.col("has_buy"))
    by_state = (F.when(exits, F.lit(None))
                .when(F.col("has_close"), "liquidation_in_progress")
                .when(same, "duplicate_open_order").when(other, "conflicting_open_order")
                .when(F.col("active_orders") >= config.max_open_orders_per_symbol, "max_open_orders_per_symbol_hit"))
    df = df.withColumns({"_pre": before_state, "_state": by_state, "_exit": exits, "_side": side, "_amount": amount})
    if seq is not None:
        ready = F.col("_pre").isNull() & F.col("_state").isNull()
        at = F.when(ready & F.col("_exit"), F.col(seq))
        entry_at = F.when(ready & ~F.col("_exit"), F.col(seq))
        first = df.groupBy("_symbol").agg(F.min(at).alias("_close_at"), F.min(entry_at).alias("_entry_at"),
                                          F.min_by("_side", entry_at).alias("_entry_side"))
        df = df.join(first, "_symbol", "left")
        held = F.when(F.col("_entry_at") < F.coalesce(F.col("_close_at"), F.col("_entry_at") + 1), F.col("_entry_at"))
        after_close = F.coalesce(F.col(seq) > F.col("_close_at"), F.lit(False))
        after_entry = F.coalesce(F.col(seq) > held, F.lit(False))
        batch = (F.when(F.col("_exit") & after_close, "close_position_already_in_progress")
                 .when(F.col("_exit"), F.lit(None))
                 .when(after_close, "liquidation_in_progress")
                 .when(after_entry & (F.col("_side") == F.col("_entry_side")), "duplicate_open_order")
                 .when(after_entry, "conflicting_open_order"))
        # order of tests: liquidation, duplicate, conflict, cap
        rank = ["liquidation_in_progress", "duplicate_open_order", "conflicting_open_order"]
        merged = F.coalesce(*[F.when((F.col("_state") == r) | (batch == r), F.lit(r)) for r in rank],
                            F.col("_state"), batch)
    else:
        merged = F.col("_state")
    df = df.withColumn("_block", F.coalesce(F.col("_pre"), merged))
    allowed = F.col("_block").isNull()
    out = df.withColumns({
        "allowed": allowed,
        "reason": F.when(~allowed, F.col("_block")).when(F.col("_exit"), "exit_close_position_allowed")
        .when(F.col("decision") == "REDUCE_SIZE", "risk_decision_reduced_size").otherwise("risk_decision_approved"),
        "intent_side": F.when(allowed, F.when(F.col("_exit"), "CLOSE_POSITION").otherwise(F.col("_side"))),
        "effective_quantity": F.when(allowed & F.col("_exit"), F.lit(None).cast("double"))
        .when(F.col("_pre").isNotNull() | F.col("_exit"), F.lit(0.0)).otherwise(F.col("_amount"))})
    return out.select(*decisions.columns, "allowed", "reason", "intent_side", "effective_quantity")


def resolve_closes(intents: DataFrame, positions: DataFrame, on=("ticker",)) -> DataFrame:
    """CLOSE_POSITION becomes the opposite of the held side; flat gives SELL 0 with its reason.

    ``positions``: key columns and quantity (signed).
    """
    held = positions.filter(F.col("quantity") != 0).select(*on, F.col("quantity").alias("_held"))
    df = intents.join(held, list(on), "left")
    close = F.col("side") == "CLOSE_POSITION"
    flat = close & F.col("_held").isNull()
    return df.withColumns({
        "resolved_side": F.when(flat | (close & (F.col("_held") > 0)), "SELL").when(close, "BUY").otherwise(F.col("side")),
        "resolved_quantity": F.when(flat, 0.0).when(close, F.abs("_held")).otherwise(F.col("quantity")),
        "resolved_reason": F.when(flat, "no_position_to_close").otherwise(F.col("reason"))}).drop("_held")


def order_status(success: Column, status_code: Column) -> Column:
    return (F.when(success, "SUBMITTED").when(status_code.isNull() | status_code.between(500, 599), "UNKNOWN")
            .otherwise("REJECTED"))


def payload_order_id(status: Column, local_id: Column, client_id: Column, signal_id: Column) -> Column:
    chain = [blank_to_null(c) for c in (local_id, client_id, signal_id)]
    return F.coalesce(F.when(status == "UNKNOWN", chain[1]), *chain)


def capture(df: DataFrame) -> DataFrame:
    """Adds status, order_id, latency_ms, order_type, time_in_force and ``error`` to submissions.

    Needs success, status_code, submit_started_at, submit_completed_at, local_order_id,
    client_order_id, signal_id; optionally intent_order_type, response_order_type,
    intent_time_in_force, response_time_in_force.
    """
    def opt(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    latency = (micros("submit_completed_at") - micros("submit_started_at")) / 1000.0
    kind = F.upper(F.coalesce(blank_to_null(opt("intent_order_type")), blank_to_null(opt("response_order_type")), F.lit("MARKET")))
    status = order_status(F.col("success"), F.col("status_code"))
    return df.withColumns({
        "status": status,
        "order_id": payload_order_id(status, F.col("local_order_id"), F.col("client_order_id"), F.col("signal_id")),
        "latency_ms": F.when(latency >= 0, latency), "order_type": kind,
        "time_in_force": F.coalesce(blank_to_null(opt("intent_time_in_force")),
                                    blank_to_null(opt("response_time_in_force")), F.lit("day")),
        "error": F.when(latency < 0, "completed_before_started").when(kind != "MARKET", "unsupported_order_type")})
