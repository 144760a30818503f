"""Risk decisions: every rule is a column returning a reason, the first one wins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import micros

HIGH_LEVELS = ("HIGH", "CRITICAL")
ELEVATED_LEVELS = ("ELEVATED", "MEDIUM")

#: Optional input columns with the value used when a table has no such column.
DEFAULTS: dict[str, object] = {
    "daily_loss_dollars": 0.0, "consecutive_losses": 0, "open_positions": 0, "symbol_position_exists": False,
    "duplicate_or_conflicting_order": False, "event_window_active": False, "high_risk_context_active": False,
    "elevated_risk_context_active": False, "spread_dollars": None, "spread_bps": None, "latency_ms": None,
    "market_data_time": None, "cost_ticker": None, "profitable_after_costs": None, "net_expected_edge_bps": None,
    "cost_min_edge_bps": None, "cost_estimate_id": None, "context_snapshot_id": None,
}
_TYPES = {"market_data_time": "timestamp", "cost_ticker": "string", "profitable_after_costs": "boolean",
          "cost_estimate_id": "string", "context_snapshot_id": "string"}


@dataclass(frozen=True)
class RiskConfig:
    min_model_confidence: float = 0.0
    max_spread_dollars: float = 0.05
    max_spread_bps: float = 10.0
    max_latency_ms: float = 1000.0
    stale_market_data_seconds: float = 5.0
    reject_if_expected_edge_below_cost: bool = True
    max_open_positions: int = 3
    max_position_per_symbol: int = 1
    max_daily_loss_dollars: float = 50.0
    max_consecutive_losses: int = 3
    block_during_eia_window: bool = True
    block_during_cpi_window: bool = True
    block_during_fomc_window: bool = True
    reduce_size_on_elevated_risk: bool = True
    block_on_high_risk: bool = True
    reduce_size_factor: float = 0.5
    version: str = "risk_filter_v1"

    def __post_init__(self):
        if not 0 < self.reduce_size_factor <= 1:
            raise ValueError("reduce_size_factor must lie in (0, 1]")

    @property
    def event_blocking(self) -> bool:
        return self.block_during_eia_window or self.block_during_cpi_window or self.block_during_fomc_window


def _outcome(decision: str, approved: bool, reason: str, factor: float | None = None, **thresholds: object) -> Column:
    used = [] if "decision_rule" in thresholds else [F.lit("rule"), F.lit(reason)]
    for k, v in sorted(thresholds.items()):
        used += [F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string")]
    return F.struct(F.lit(decision).alias("decision"), F.lit(approved).alias("approved"), F.lit(reason).alias("reason"),
                    F.lit(factor).cast("double").alias("reduce_size_factor"), F.create_map(*used).alias("thresholds"))


def rules(config: RiskConfig = RiskConfig()) -> dict[str, Column]:
    """Rule name -> outcome struct (NULL when the rule passes), in evaluation order."""
    c = F.col

    def block(reason, **used):
        return _outcome("BLOCK", False, reason, **used)

    cost = F.when(c("cost_ticker").isNull(), block("missing_cost_estimate", reject_if_expected_edge_below_cost=True)) \
        .when(c("cost_ticker") != c("ticker"), block(
            "cost_estimate_ticker_mismatch", signal_ticker=c("ticker"), cost_estimate_ticker=c("cost_ticker"))) \
        .when(~F.coalesce(c("profitable_after_costs"), F.lit(False)),
              block("cost_not_profitable_after_costs", profitable_after_costs=False, net_expected_edge_bps=c("net_expected_edge_bps"),
                    min_edge_bps=c("cost_min_edge_bps")))
    if not config.reject_if_expected_edge_below_cost:
        cost = F.lit(None)
    age = (micros("evaluation_time") - micros("market_data_time")) / 1e6
    out = {
        "cost": cost,
        "confidence": F.when(c("confidence") < config.min_model_confidence, block(
            "confidence_too_low", actual_confidence=c("confidence"), min_model_confidence=config.min_model_confidence)),
        "spread": F.when(c("spread_dollars").isNull() & c("spread_bps").isNull(), block("missing_spread"))
        .when(c("spread_dollars") > config.max_spread_dollars, block(
            "spread_dollars_too_wide", actual_spread_dollars=c("spread_dollars"), max_spread_dollars=config.max_spread_dollars))
        .when(c("spread_bps") > config.max_spread_bps, block(
            "spread_bps_too_wide", actual_spread_bps=c("spread_bps"), max_spread_bps=config.max_spread_bps)),
        "latency": F.when(c("latency_ms").isNull(), block("missing_latency_ms"))
        .when(c("latency_ms") > config.max_latency_ms, block(
            "latency_too_high", actual_latency_ms=c("latency_ms"), max_latency_ms=config.max_latency_ms)),
        "staleness": F.when(c("market_data_time").isNull(), block("missing_market_data_time"))
        .when(age > config.stale_market_data_seconds, block(
            "stale_market_data", actual_market_data_age_seconds=age, stale_market_data_seconds=config.stale_market_data_seconds)),
        "daily_limits": F.when(c("daily_loss_dollars") >= config.max_daily_loss_dollars, block(
            "daily_loss_limit_hit", actual_daily_loss_dollars=c("daily_loss_dollars"),
            max_daily_loss_dollars=config.max_daily_loss_dollars))
        .when(c("consecutive_losses") >= config.max_consecutive_losses, block(
            "consecutive_loss_limit_hit", actual_consecutive_losses=c("consecutive_losses"),
            max_consecutive_losses=config.max_consecutive_losses)),
        "portfolio": F.when(c("duplicate_or_conflicting_order"), block("duplicate_or_conflicting_order"))
        .when(c("open_positions") >= config.max_open_positions, block(
            "max_open_positions_hit", actual_open_positions=c("open_positions"), max_open_positions=config.max_open_positions)),
        "context": F.lit(None),
    }
    if config.max_position_per_symbol <= 1:
        out["portfolio"] = out["portfolio"].when(c("symbol_position_exists"), block(
            "max_position_per_symbol_hit", symbol_position_exists=True, max_position_per_symbol=config.max_position_per_symbol))
    context = []
    if config.event_blocking:
        context.append((c("event_window_active"), block("event_window_active", event_blocking_enabled=True)))
    if config.block_on_high_risk:
        context.append((c("high_risk_context_active"), block("high_context_risk", block_on_ai_high_risk=True)))
    if config.reduce_size_on_elevated_risk:
        context.append((c("elevated_risk_context_active"), _outcome(
            "REDUCE_SIZE", True, "elevated_context_risk", config.reduce_size_factor,
            reduce_size_factor=config.reduce_size_factor)))
    for i, (test, outcome) in enumerate(context):
        out["context"] = F.when(test, outcome) if i == 0 else out["context"].when(test, outcome)
    return out


def with_defaults(df: DataFrame) -> DataFrame:
    """Adds the optional risk inputs that the table does not have."""
    missing = {k: F.lit(v).cast(_TYPES.get(k, "double")) if v is None else F.lit(v)
               for k, v in DEFAULTS.items() if k not in df.columns}
    if "context_reasons" not in df.columns:
        missing["context_reasons"] = F.array().cast("array<string>")
    return df.withColumns(missing) if missing else df


def decide(df: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Adds decision, approved, reasons, thresholds_used, reduce_size_factor, risk_version.

    Needs ticker, signal, confidence, evaluation_time; see ``DEFAULTS`` for the rest.
    """
    df = with_defaults(df)
    r = rules(config)
    entry = F.col("signal").isin("BUY", "SELL")
    checks = [F.when(entry, r["cost"]) if config.reject_if_expected_edge_below_cost else None,
              *[r[k] for k in ("confidence", "spread", "latency", "staleness", "daily_limits", "portfolio", "context")]]
    typed = _outcome("APPROVE", True, "approved", decision_rule="approved")
    first_hit = F.coalesce(*[x for x in checks if x is not None], typed)
    outcome = (F.when(F.col("signal").isin("HOLD", "DO_NOTHING"),
                      _outcome("DO_NOTHING", False, "signal_no_action", decision_rule="signal_no_action"))
               .when(F.col("signal") == "EXIT", _outcome("EXIT", True, "signal_exit", decision_rule="signal_exit"))
               .otherwise(first_hit))
    out = df.withColumn("_o", outcome)
    from_context = F.col("_o.reason").isin("event_window_active", "high_context_risk", "elevated_context_risk")
    return out.withColumns({
        "decision": F.col("_o.decision"), "approved": F.col("_o.approved"),
        "reduce_size_factor": F.col("_o.reduce_size_factor"),
        "reasons": F.array_distinct(F.concat(F.array(F.col("_o.reason")), F.when(
            from_context, F.col("context_reasons")).otherwise(F.array().cast("array<string>")))),
        "thresholds_used": F.to_json("_o.thresholds"), "risk_version": F.lit(config.version),
    }).drop("_o")


def join_costs(signals: DataFrame, costs: DataFrame, on: Sequence[str] = ("signal_id",)) -> DataFrame:
    """Left join of the cost estimate; a missing one stays visible to the cost rule."""
    side = costs.select(*on, F.col("ticker").alias("cost_ticker"), "profitable_after_costs", "net_expected_edge_bps",
                        F.col("min_edge_bps").alias("cost_min_edge_bps"),
                        *[c for c in ("cost_estimate_id",) if c in costs.columns])
    return signals.join(side, list(on), "left")


def size_factor() -> Column:
    return (F.when(F.col("decision") == "APPROVE", 1.0)
            .when((F.col("decision") == "REDUCE_SIZE") & (F.col("reduce_size_factor") > 0)
                  & (F.col("reduce_size_factor") <= 1), F.col("reduce_size_factor")).otherwise(0.0))


def entry_allowed() -> Column:
    return F.col("decision").isin("APPROVE", "REDUCE_SIZE") & F.col("approved")


def context_inputs(decisions: DataFrame, flags: DataFrame, *, on: str = "decision_id") -> DataFrame:
    """Booleans and reasons from context flags already joined to decisions.

    ``flags``: ``on``, flag_type, severity, valid_until; ``decisions``: ``on``,
    evaluation_time and optionally snapshot_risk_level, snapshot_event_window.
    """
    severity = F.upper(F.trim("severity"))
    live = F.col("valid_until").isNull() | (F.col("valid_until") >= F.col("evaluation_time"))
    per = (flags.join(decisions.select(on, "evaluation_time"), on).filter(live).groupBy(on).agg(
        F.bool_or(F.lower("flag_type").contains("event_window")).alias("f_event"),
        F.bool_or(severity.isin(*HIGH_LEVELS)).alias("f_high"),
        F.bool_or(severity.isin(*ELEVATED_LEVELS)).alias("f_elevated")))
    out = decisions.join(per, on, "left")

    def yes(c):
        return F.coalesce(c, F.lit(False))

    level = F.upper(F.trim("snapshot_risk_level")) if "snapshot_risk_level" in out.columns else F.lit(None).cast("string")
    window = F.col("snapshot_event_window") if "snapshot_event_window" in out.columns else F.lit(False)
    s_high, s_elev = yes(level.isin(*HIGH_LEVELS)), yes(level.isin(*ELEVATED_LEVELS))
    named = [("context_snapshot_risk_level_high", s_high), ("context_snapshot_risk_level_elevated", s_elev),
             ("context_snapshot_event_window_active", yes(window)), ("context_flag_event_window_active", yes(F.col("f_event"))),
             ("context_flag_severity_high", yes(F.col("f_high"))), ("context_flag_severity_elevated", yes(F.col("f_elevated")))]
    return out.withColumns({
        "event_window_active": yes(window) | yes(F.col("f_event")),
        "high_risk_context_active": s_high | yes(F.col("f_high")),
        "elevated_risk_context_active": s_elev | yes(F.col("f_elevated")),
        "context_reasons": F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in named])),
    }).drop("f_event", "f_high", "f_elevated")


def snapshot_event_window(entries: Column, active_ids: Column, at: Column) -> Column:
    """TRUE when an active, fresh, TRUE-valued entry is an event-window flag.

    ``entries``: array of structs (value, expired, valid_until, context_flag_id, flag_type).
    """
    ids = F.filter(F.transform(active_ids, F.trim), lambda x: x != "")
    return F.exists(entries, lambda e: F.coalesce(
        e["value"] & ~F.coalesce(e["expired"], F.lit(False)) & (e["valid_until"].isNull() | (e["valid_until"] >= at))
        & F.array_contains(ids, F.trim(e["context_flag_id"])) & F.lower(e["flag_type"]).contains("event_window"),
        F.lit(False)))
