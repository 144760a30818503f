"""Ledger tables: column names per table, types by rule, partition by day or month."""

from __future__ import annotations

from pyspark.sql import types as T

# Own columns of every ledger table; the first is its time column.
_OWN = {
    "bot_runs": "started_at ended_at environment mode paper_trading git_commit config_hash status message",
    "bot_sessions": "session_start_time session_end_time machine_name service_name environment mode ntp_status clock_offset_ms status message",
    "feature_snapshots": "snapshot_time feature_snapshot_id ticker feature_version source_record_count lookback_window_seconds features_json",
    "model_signals": "signal_time signal_id ticker signal confidence raw_score model_version calibration_version feature_version feature_snapshot_id",
    "cost_estimates": "estimate_time cost_estimate_id ticker signal_id feature_snapshot_id side horizon order_style quantity midprice spread_bps "
                      "expected_gross_move_bps spread_cost_bps estimated_slippage_bps size_penalty_bps base_cost_bps missed_fill_probability "
                      "pre_missed_fill_net_edge_bps missed_fill_penalty_bps total_cost_bps min_edge_bps net_expected_edge_bps "
                      "exceeds_min_edge_threshold profitable_after_costs assumptions_version reason",
    "context_state_snapshots": "snapshot_time context_snapshot_id ticker sector active_indicator_ids_json active_context_event_ids_json "
                               "active_context_flag_ids_json context_summary_json highest_severity risk_level valid_until",
    "risk_decisions": "decision_time risk_decision_id ticker model_signal_id cost_estimate_id context_snapshot_id decision approved risk_version "
                      "reduce_size_factor reasons_json thresholds_used_json",
    "context_indicator_snapshots": "snapshot_time context_indicator_id source ticker_or_sector indicator_name value_json window units "
                                   "freshness_seconds source_event_time details_json",
    "context_ai_events": "event_time context_event_id source source_id affected_tickers_json affected_sector event_type sentiment urgency risk_level "
                         "confidence valid_from valid_until summary prompt_version model_version {lineage} classified_at available_at validated_at provider",
    "context_flags": "event_time context_flag_id source flag_type severity ticker sector confidence valid_until context_event_id source_id valid_from "
                     "available_at validated_at reason_codes_json summary raw_input_id source_document_id classification_request_id "
                     "classification_attempt_id validation_result_id source_type source_platform source_uri source_locator document_hash raw_input_hash",
    "context_classification_attempts": "requested_at source affected_tickers_json {lineage} classified_at provider model_version prompt_version status "
                                       "event_type risk_level urgency confidence summary validation_outcome validation_reason_codes_json "
                                       "validator_version validated_at provider_latency_ms safe_failure_category safe_failure_summary "
                                       "provider_request_count retry_count deduplicated reused_classification_attempt_id",
    "shadow_context_policy_evaluations": "decision_evaluation_time shadow_evaluation_id model_signal_id risk_decision_id "
                                         "matched_context_event_ids_json matched_context_flag_ids_json shadow_context_fingerprint policy_version "
                                         "policy_config_hash hypothetical_action proposed_size_factor reason_codes_json",
    "order_events": "order_time order_id ticker side order_type quantity status expected_price submitted_price broker broker_order_id "
                    "paper_trading model_signal_id risk_decision_id feature_snapshot_id",
    "fill_events": "fill_time fill_id order_id ticker side quantity fill_price expected_price slippage slippage_bps broker_status broker_fill_id "
                   "model_signal_id risk_decision_id",
    "trade_outcomes": "entry_time outcome_id signal_id order_id fill_id ticker exit_time entry_price exit_price quantity realized_pnl "
                      "return_1m return_5m return_15m max_favorable_excursion max_adverse_excursion result",
    "latency_metrics": "measured_time latency_metric_id component source latency_ms ticker event_type",
    "system_health_events": "event_time health_event_id component status message cpu_percent memory_percent clock_offset_ms feed_delay_ms "
                            "reconnect_count queue_depth ledger_write_errors jsonl_fallback_count",
    "ledger_write_errors": "event_time error_id target_table component severity record_type record_id error_message payload_json "
                           "jsonl_fallback_path fallback_written",
    "jsonl_fallback_events": "event_time fallback_event_id component target_table record_type record_id file_path bytes_written status message",
}
# Columns shared by rows that come from a classified document, and by all rows.
_LINEAGE = ("raw_input_id source_document_id classification_request_id classification_attempt_id validation_result_id source_type source_platform "
            "source_uri source_locator document_hash raw_input_hash source_published_at source_updated_at collected_at normalized_at")
_ENVELOPE = ("run_id", "session_id", "schema_version", "trace_id")
_BOOLEAN = ("paper_trading", "approved", "exceeds_min_edge_threshold", "profitable_after_costs", "validation_outcome", "deduplicated", "fallback_written")
_INT = ("source_record_count", "reconnect_count", "queue_depth", "ledger_write_errors", "jsonl_fallback_count")
_LONG = ("provider_request_count", "retry_count", "bytes_written")
_DOUBLE = ("confidence", "raw_score", "quantity", "midprice", "slippage", "realized_pnl", "reduce_size_factor", "proposed_size_factor",
           "missed_fill_probability", "return_1m", "return_5m", "return_15m", "max_favorable_excursion", "max_adverse_excursion")
MONTHLY = ("bot_runs", "bot_sessions")
TABLES = tuple(_OWN)


def column_type(name: str) -> T.DataType:
    """Type of a ledger column by its name."""
    if name in _BOOLEAN:
        return T.BooleanType()
    if name in _INT:
        return T.IntegerType()
    if name in _LONG:
        return T.LongType()
    if name in _DOUBLE or name.endswith(("_bps", "_price", "_ms", "_percent", "_seconds")):
        return T.DoubleType()
    if name.endswith(("_at", "_time")) or name in ("valid_from", "valid_until"):
        return T.TimestampType()
    return T.StringType()


def time_column(table: str) -> str:
    return _OWN[table].split()[0]


def schema(table: str) -> T.StructType:
    if table not in _OWN:
        raise KeyError(f"unknown ledger table {table}")
    names = _OWN[table].format(lineage=_LINEAGE).split()
    if table not in MONTHLY:
        names.insert(1, "write_time")
    return T.StructType([T.StructField(n, column_type(n)) for n in dict.fromkeys([*names, *_ENVELOPE])])
