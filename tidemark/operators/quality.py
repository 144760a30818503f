"""Constraint tables: rules evaluated in one pass, rows split into good and quarantined."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA256 = r"^[0-9a-f]{64}$"


class ConstraintError(ValueError):
    """Raised by strict mode when rows violate their constraints."""


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the broken rules (a NULL predicate counts as broken)."""
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def check(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def split(df: DataFrame, rules: Mapping[str, Column], *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined); strict raises when anything is quarantined."""
    checked = check(df, rules)
    bad = checked.filter(F.size("violations") > 0)
    if strict:
        row = bad.select("violations").first()
        if row is not None:
            raise ConstraintError(f"rows violate constraints, first: {list(row[0])}")
    return checked.filter(F.size("violations") == 0).drop("violations"), bad


def text(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(F.col(c)) != "")


def number(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def optional_number(c: str) -> Column:
    return F.col(c).isNull() | number(c)


def non_negative(c: str) -> Column:
    return number(c) & (F.col(c) >= 0)


def positive(c: str) -> Column:
    return number(c) & (F.col(c) > 0)


def unit(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).between(0, 1)


def one_of(c: str, *values: str) -> Column:
    return F.col(c).isin(*values)


def digest(c: str) -> Column:
    return F.col(c).rlike(SHA256)


SIDES = ("BUY", "SELL", "HOLD", "EXIT", "DO_NOTHING")
DECISIONS = ("APPROVE", "BLOCK", "REDUCE_SIZE", "DO_NOTHING", "EXIT")
ORDER_STATUSES = ("CREATED", "SUBMITTED", "ACKNOWLEDGED", "PARTIALLY_FILLED", "FILLED", "CANCELED", "REJECTED", "EXPIRED", "UNKNOWN")


def _maybe(c: str, rule: Column) -> Column:
    return F.col(c).isNull() | rule


def contract(kind: str) -> dict[str, Column]:
    """Record-shape rules by record type."""
    at = lambda c: F.col(c).isNotNull()
    rules: dict[str, dict[str, Column]] = {
        "market_record": {
            "event_time": at("event_time"), "ticker": text("ticker"), "source": text("source"),
            "record_type": text("record_type"), "price": optional_number("price"), "size": optional_number("size"),
            "bid_price": optional_number("bid_price"), "ask_price": optional_number("ask_price")},
        "feature_snapshot": {
            "snapshot_time": at("snapshot_time"), "ticker": text("ticker"), "feature_version": text("feature_version"),
            "source_record_count": non_negative("source_record_count")},
        "model_signal": {
            "signal_time": at("signal_time"), "ticker": text("ticker"), "signal": one_of("signal", *SIDES),
            "confidence": number("confidence") & unit("confidence"), "signal_id": text("signal_id")},
        "risk_decision": {
            "decision_time": at("decision_time"), "ticker": text("ticker"), "decision": one_of("decision", *DECISIONS),
            "approved": at("approved"), "reasons": F.size("reasons") > 0,
            "size_factor": F.when(F.col("decision") == "REDUCE_SIZE",
                                  (F.col("reduce_size_factor") > 0) & (F.col("reduce_size_factor") <= 1))
            .otherwise(F.col("reduce_size_factor").isNull())},
        "order_event": {
            "order_time": at("order_time"), "order_id": text("order_id"), "ticker": text("ticker"),
            "side": one_of("side", "BUY", "SELL"), "quantity": positive("quantity"),
            "status": one_of("status", *ORDER_STATUSES)},
        "fill_event": {
            "fill_time": at("fill_time"), "fill_id": text("fill_id"), "ticker": text("ticker"),
            "side": one_of("side", "BUY", "SELL"), "quantity": positive("quantity"),
            "fill_price": non_negative("fill_price")},
        "trade_outcome": {"entry_time": at("entry_time"), "ticker": text("ticker"), "quantity": positive("quantity")},
        "latency_metric": {"measured_time": at("measured_time"), "component": text("component"),
                           "latency_ms": non_negative("latency_ms")},
        "health_event": {"event_time": at("event_time"), "component": text("component"), "status": text("status")},
        "cost_estimate": {
            "ticker": text("ticker"), "side": one_of("side", "BUY", "SELL"), "horizon": one_of("horizon", "1m", "5m", "15m"),
            "order_style": one_of("order_style", "MARKET", "LIMIT_AT_MID"), "midprice": positive("midprice"),
            "quantity": positive("quantity"), "spread_bps": non_negative("spread_bps")},
        "label_example": {
            "snapshot_time": at("snapshot_time"), "ticker": text("ticker"), "horizon": one_of("horizon", "1m", "5m", "15m"),
            "side": one_of("side", "BUY", "SELL"), "entry_midprice": positive("entry_midprice"),
            "forward_midprice": positive("forward_midprice")},
        "context_raw_input": {
            "collected_at": at("collected_at"), "raw_input_id": text("raw_input_id"), "source": text("source"),
            "raw_input_hash": digest("raw_input_hash")},
        "context_document": {
            "normalized_at": at("normalized_at"), "source_document_id": text("source_document_id"),
            "document_hash": digest("document_hash")},
        "classification_request": {
            "requested_at": at("requested_at"), "classification_request_id": text("classification_request_id"),
            "prompt_version": text("prompt_version"), "input_text": text("input_text")},
        "classification_response": {
            "classified_at": at("classified_at"), "classification_attempt_id": text("classification_attempt_id"),
            "status": one_of("status", "VALID", "ABSTAINED", "VALIDATION_REJECTED", "PROVIDER_FAILED"),
            "confidence": unit("confidence"),
            "retry_count": F.when(F.col("provider_request_count") > 0,
                                  F.col("retry_count") == F.col("provider_request_count") - 1)
            .otherwise(F.col("retry_count") == 0)},
        "validation_result": {
            "validated_at": at("validated_at"), "validation_result_id": text("validation_result_id"),
            "outcome": at("outcome"), "reason_codes": F.when(F.col("outcome"), F.size("reason_codes") == 0)
            .otherwise(F.size("reason_codes") > 0)},
        "context_indicator": {"snapshot_time": at("snapshot_time"), "source": text("source"),
                              "indicator_name": text("indicator_name"),
                              "freshness_seconds": _maybe("freshness_seconds", non_negative("freshness_seconds"))},
        "context_flag": {"event_time": at("event_time"), "source": text("source"), "flag_type": text("flag_type"),
                         "severity": text("severity"),
                         "confidence": unit("confidence")},
        "shadow_evaluation": {
            "shadow_evaluation_id": text("shadow_evaluation_id"), "model_signal_id": text("model_signal_id"),
            "policy_config_hash": digest("policy_config_hash"),
            "hypothetical_action": one_of("hypothetical_action", "NO_CHANGE", "BLOCK", "REDUCE_SIZE", "DELAY", "WARN_ONLY")},
        "risk_input": {
            "spread_dollars": _maybe("spread_dollars", non_negative("spread_dollars")),
            "spread_bps": _maybe("spread_bps", non_negative("spread_bps")),
            "latency_ms": _maybe("latency_ms", non_negative("latency_ms")),
            "daily_loss_dollars": non_negative("daily_loss_dollars"),
            "consecutive_losses": non_negative("consecutive_losses"), "open_positions": non_negative("open_positions")},
    }
    return rules[kind]


def issues(df: DataFrame, source: str, key: Column, issue_type: Column, message: Column, details: Column | None = None) -> DataFrame:
    """Typed issue rows (source, issue_type, issue_key, message, details)."""
    return df.select(F.lit(source).alias("source"), issue_type.alias("issue_type"), key.cast("string").alias("issue_key"),
                     message.alias("message"), (details if details is not None else F.lit(None)).cast("string").alias("details"))
