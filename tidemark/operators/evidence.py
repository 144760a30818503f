"""Research evidence: adapters, leak-free selection, exclusion counts and rule policies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_json
from tidemark.functions.times import micros
from tidemark.operators.intervals import interval_join
from tidemark.operators.ordered import OrderedScan, Running

CATEGORIES = ("AI_EVENT", "DETERMINISTIC_EVENT", "FLAG")


class EvidenceError(ValueError):
    """The evidence set breaks a rule of the run."""


@dataclass(frozen=True)
class RunDefinition:
    """Parameters of an evidence job."""

    tickers: tuple[str, ...]
    sources: tuple[str, ...]
    start_us: int
    end_us: int
    max_age_us: int = 24 * 3_600_000_000
    categories: tuple[str, ...] = CATEGORIES

    def __post_init__(self):
        if not self.tickers or not self.sources or self.start_us >= self.end_us:
            raise ValueError("a run needs tickers, sources, and a positive window")

    @property
    def coverage(self) -> tuple[int, int]:
        """Decision times (micros) for which the loaded evidence is complete."""
        return self.start_us + self.max_age_us, self.end_us


# --- adapters: common rows ----------------------------------------------------------------

COLUMNS = ("evidence_id", "category", "source", "source_record_id", "policy_match_key", "tickers", "sector", "is_global",
           "available_at", "valid_from", "valid_until", "policy_eligible", "lineage_ids", "payload")
LINEAGE = ("raw_input_id", "source_document_id", "classification_request_id", "classification_attempt_id", "validation_result_id")


def _adapt(df: DataFrame, category: str, kind: Column, **cols: Column) -> DataFrame:
    prefix = {"AI_EVENT": "AI_EVENT_TYPE:", "DETERMINISTIC_EVENT": "DETERMINISTIC_EVENT_TYPE:", "FLAG": "FLAG_TYPE:"}[category]
    base = {"category": F.lit(category), "policy_match_key": F.concat(F.lit(prefix), F.upper(kind)),
            "sector": F.lit(None).cast("string"), "valid_from": F.lit(None).cast("timestamp"),
            "valid_until": F.lit(None).cast("timestamp"), "policy_eligible": F.lit(True),
            "lineage_ids": F.array_distinct(F.array_compact(F.array(*[
                F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
                for c in (*LINEAGE, *(("context_event_id",) if category == "FLAG" else ()))]))),
            "payload": F.to_json(F.struct(*df.columns)), **cols}
    if "is_global" not in base:
        base["is_global"] = (F.size(base["tickers"]) == 0) & base["sector"].isNull()
    return df.select(*[base[c].alias(c) for c in COLUMNS])


def from_ai_events(df: DataFrame) -> DataFrame:
    return _adapt(df, "AI_EVENT", F.col("event_type"), evidence_id=F.col("context_event_id"), source=F.col("source"),
                  source_record_id=F.col("source_id"), tickers=F.col("affected_tickers"), sector=F.col("affected_sector"),
                  available_at=F.col("available_at"), valid_from=F.col("valid_from"), valid_until=F.col("valid_until"))


def from_flags(df: DataFrame) -> DataFrame:
    return _adapt(df, "FLAG", F.col("flag_type"), evidence_id=F.col("context_flag_id"), source=F.col("source"),
                  source_record_id=F.coalesce(*[F.col(c) for c in ("source_id", "context_flag_id") if c in df.columns]), sector=F.col("sector"),
                  tickers=F.array_compact(F.array(F.col("ticker"))), available_at=F.col("available_at"),
                  valid_from=F.col("valid_from"), valid_until=F.col("valid_until"))


def from_insider_events(df: DataFrame) -> DataFrame:
    """Insider purchases and sales; unresolved amendments are not eligible."""
    key = F.concat_ws(":", "accession_number", "transaction_index")
    return _adapt(df, "DETERMINISTIC_EVENT", F.col("event_type"),
                  evidence_id=F.concat(F.lit("insider_"), F.sha2(key, 256)), source=F.lit("sec_edgar"), source_record_id=key,
                  tickers=F.array(F.col("issuer_ticker")), is_global=F.lit(False), available_at=F.col("available_at"),
                  policy_eligible=F.col("aggregate_eligibility") == "ELIGIBLE")


# --- checks before publication ------------------------------------------------------------

def conflicts(evidence: DataFrame, run: RunDefinition | None = None, structured_sources: DataFrame | None = None) -> DataFrame:
    """Rows (problem, key, rows) that make the set ambiguous or inadmissible; empty when clean."""
    def repeats(name: str, *keys: str) -> DataFrame:
        return (evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
                .select(F.lit(name).alias("problem"), F.concat_ws("|", *keys).alias("key"), "rows"))

    def counted(name: str, df: DataFrame, key: Column) -> DataFrame:
        return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("problem"), "key", "rows")

    out = repeats("duplicate_evidence_id", "evidence_id").unionByName(repeats("duplicate_source_record", "source", "source_record_id"))
    if structured_sources is not None:
        owned = evidence.join(structured_sources.select("source").distinct(), "source", "left_semi")
        out = out.unionByName(counted("structured_source", owned, F.col("source")))
    if run is not None:
        out = out.unionByName(counted("source_not_admitted", evidence.filter(~F.col("source").isin(*run.sources)), F.col("source")))
        out = out.unionByName(counted("category_not_admitted", evidence.filter(~F.col("category").isin(*run.categories)), F.col("category")))
        universe = F.array(*[F.lit(t) for t in run.tickers])
        outside = evidence.select(F.explode(F.array_except("tickers", universe)).alias("ticker"))
        out = out.unionByName(counted("outside_universe", outside, F.col("ticker")))
    return out


# --- selection ----------------------------------------------------------------------------

def _keys(evidence: DataFrame) -> DataFrame:
    """Evidence once per scope key it is reachable by; ``_weight`` -1 marks ticker-and-sector overlap."""
    def key(scope, target, weight=1):
        return F.struct(F.lit(scope).alias("scope"), target.alias("target"), F.lit(weight).alias("_weight"))

    tickers = F.coalesce("tickers", F.array().cast("array<string>"))
    scoped = F.concat(
        F.transform(tickers, lambda t: key("TICKER", t)),
        F.when(F.col("sector").isNotNull(), F.array(key("SECTOR", F.col("sector")))).otherwise(F.array().cast(
            "array<struct<scope:string,target:string,_weight:int>>")),
        F.when(F.col("sector").isNotNull(), F.transform(tickers, lambda t: key("BOTH", F.concat_ws("|", t, "sector"), -1)))
        .otherwise(F.array().cast("array<struct<scope:string,target:string,_weight:int>>")))
    keys = F.when(F.col("is_global"), F.array(key("GLOBAL", F.lit("*")))).otherwise(scoped)
    return evidence.withColumn("_k", F.explode(keys)).select("*", "_k.*").drop("_k")


def _window(max_age_us: int) -> dict[str, Column]:
    available = micros("available_at")
    return {"_from": F.greatest(available, F.coalesce(micros("valid_from"), available)),
            "_to": F.coalesce(micros("valid_until"), available + F.lit(max_age_us))}


def _decision_keys(decisions: DataFrame) -> DataFrame:
    keys = [("GLOBAL", F.lit("*")), ("TICKER", F.col("ticker")), ("SECTOR", F.col("sector")),
            ("BOTH", F.when(F.col("sector").isNotNull(), F.concat_ws("|", "ticker", "sector")))]
    arr = F.array(*[F.struct(F.lit(s).alias("scope"), t.alias("target")) for s, t in keys])
    return decisions.withColumn("_k", F.explode(F.filter(arr, lambda k: k["target"].isNotNull()))).select("*", "_k.*").drop("_k")


def select(decisions: DataFrame, evidence: DataFrame, *, at: str = "evaluation_time", max_age_us: int,
           keep: Sequence[str] = (), on: Sequence[str] = ()) -> DataFrame:
    """Decision x selected evidence rows; only rows that are results are produced.

    ``decisions``: ticker, sector, ``at`` and identifiers.  Scope is an equality key and time
    an interval join, so no scope group is paired in full.  ``on`` adds equality keys.
    """
    usable = evidence.filter(F.col("policy_eligible") & F.col("available_at").isNotNull())
    rows = _keys(usable.withColumns(_window(max_age_us))).filter(F.col("scope") != "BOTH")
    rows = rows.select("scope", "target", *on, "_from", "_to", F.col("tickers").alias("_tickers"), "evidence_id", "category", "source",
                       "source_record_id", "policy_match_key", F.col("available_at").alias("evidence_available_at"), *keep)
    probes = _decision_keys(decisions.withColumn("_at", micros(at))).filter(F.col("scope") != "BOTH")
    out = interval_join(probes, rows, keys=["scope", "target", *on], at="_at", start="_from", end="_to")
    seen_by_ticker = (F.col("scope") == "SECTOR") & F.coalesce(F.array_contains("_tickers", F.col("ticker")), F.lit(False))
    return out.filter(~seen_by_ticker).drop("_from", "_to", "_at", "_tickers", "target")


REASONS = ("POLICY_INELIGIBLE", "MISSING_AVAILABILITY", "SCOPE_MISMATCH", "FUTURE", "EXPIRED", "OUTSIDE_LOOKBACK")


def exclusion_counts(decisions: DataFrame, evidence: DataFrame, *, id: str = "decision_id", at: str = "evaluation_time",
                     max_age_us: int, sliced: bool | None = None) -> DataFrame:
    """Per decision the number of selected rows and of rows excluded for each reason.

    Every evidence row has one reason per decision.  Counting them needs no pairs: a row in
    scope starts once and ends once, so running sums of starts and ends up to the decision
    give all time reasons, and the rest follows from totals.
    """
    usable = F.col("policy_eligible") & F.col("available_at").isNotNull()
    totals = evidence.agg(
        F.count_if(~F.col("policy_eligible")).alias("n_policy_ineligible"),
        F.count_if(F.col("policy_eligible") & F.col("available_at").isNull()).alias("n_missing_availability"),
        F.count_if(usable).alias("_usable"))
    keyed = _keys(evidence.filter(usable).withColumns(_window(max_age_us)))
    ended = F.greatest(F.col("_from"), F.col("_to") + 1)
    moves = keyed.select("scope", "target", F.explode(F.array(
        F.struct(F.col("_from").alias("_t"), F.col("_weight").alias("_started"), F.lit(0).alias("_expired"), F.lit(0).alias("_outside")),
        F.struct(ended.alias("_t"), F.lit(0).alias("_started"),
                 F.when(F.col("valid_until").isNotNull(), F.col("_weight")).otherwise(0).alias("_expired"),
                 F.when(F.col("valid_until").isNull(), F.col("_weight")).otherwise(0).alias("_outside")))).alias("_m"))
    moves = moves.select("scope", "target", "_m.*").groupBy("scope", "target", "_t").agg(
        *[F.sum(c).alias(c) for c in ("_started", "_expired", "_outside")])
    probes = _decision_keys(decisions.select(id, "ticker", "sector", micros(at).alias("_t"))).select("scope", "target", "_t", id)
    timeline = moves.withColumns({"_kind": F.lit(0), id: F.lit(None).cast(decisions.schema[id].dataType)}).unionByName(
        probes.withColumns({"_kind": F.lit(1), **{c: F.lit(0).cast("long") for c in ("_started", "_expired", "_outside")}}))
    scan = OrderedScan(timeline, ["scope", "target"], ["_t", "_kind", id], sliced=sliced).running(
        *[Running(f"{c}_n", "sum", F.col(c)) for c in ("_started", "_expired", "_outside")])
    size = keyed.groupBy("scope", "target").agg(F.sum("_weight").alias("_size"))
    seen = scan.result().filter(F.col("_kind") == 1).join(size, ["scope", "target"], "left")
    per = seen.groupBy(id).agg(*[F.sum(c).alias(c) for c in ("_started_n", "_expired_n", "_outside_n")],
                               F.sum(F.coalesce("_size", F.lit(0))).alias("_in_scope"))
    return per.join(F.broadcast(totals)).select(
        id, (F.col("_started_n") - F.col("_expired_n") - F.col("_outside_n")).alias("n_selected"),
        "n_policy_ineligible", "n_missing_availability", (F.col("_usable") - F.col("_in_scope")).alias("n_scope_mismatch"),
        (F.col("_in_scope") - F.col("_started_n")).alias("n_future"), F.col("_expired_n").alias("n_expired"),
        F.col("_outside_n").alias("n_outside_lookback"))


def applicable_exclusions(decisions: DataFrame, exclusions: DataFrame, *, at: str = "evaluation_time", max_age_us: int) -> DataFrame:
    """Load-time exclusions that concern a decision: in its scope, and without availability or recent.

    ``exclusions``: evidence_id, reason, tickers, sector, is_global, available_at.
    """
    missing = F.col("reason") == "MISSING_AVAILABILITY"
    rows = exclusions.filter(missing | F.col("available_at").isNotNull()).withColumns({
        "_from": F.when(missing, F.lit(0)).otherwise(micros("available_at")),
        "_to": F.when(missing, F.lit(None).cast("long")).otherwise(micros("available_at") + F.lit(max_age_us))})
    rows = _keys(rows).filter(F.col("scope") != "BOTH").select(
        "scope", "target", "_from", "_to", F.col("tickers").alias("_tickers"), "evidence_id", "reason")
    probes = _decision_keys(decisions.withColumn("_at", micros(at))).filter(F.col("scope") != "BOTH")
    out = interval_join(probes, rows, keys=["scope", "target"], at="_at", start="_from", end="_to")
    twice = (F.col("scope") == "SECTOR") & F.coalesce(F.array_contains("_tickers", F.col("ticker")), F.lit(False))
    return out.filter(~twice).drop("_from", "_to", "_at", "_tickers", "target")


def hydrate(evidence: DataFrame, run: RunDefinition) -> tuple[DataFrame, DataFrame]:
    """(admitted rows, exclusions) of a run: sources, categories, universe and coverage window.

    A row's first failing rule is its reason: MALFORMED (no id, source or match key), SCOPE_MISMATCH
    (source or category not admitted, or no listed ticker, sector or global relevance),
    MISSING_AVAILABILITY, FUTURE (after the window), OUTSIDE_LOOKBACK (before it).
    """
    at = micros("available_at")
    universe = F.array(*[F.lit(t) for t in run.tickers])
    tickers = F.coalesce("tickers", F.array().cast("array<string>"))
    relevant = F.coalesce("is_global", F.lit(False)) | F.col("sector").isNotNull() | F.arrays_overlap(tickers, universe)
    reason = (F.when(F.col("evidence_id").isNull() | F.col("source").isNull() | F.col("policy_match_key").isNull(), "MALFORMED")
              .when(~F.col("source").isin(*run.sources) | ~F.col("category").isin(*run.categories) | ~relevant, "SCOPE_MISMATCH")
              .when(at.isNull(), "MISSING_AVAILABILITY").when(at > run.end_us, "FUTURE").when(at < run.start_us, "OUTSIDE_LOOKBACK"))
    judged = evidence.withColumn("reason", reason)
    return (judged.filter(F.col("reason").isNull()).drop("reason"),
            judged.filter(F.col("reason").isNotNull()).select("evidence_id", "reason", "tickers", "sector", "is_global", "available_at"))


def exclusion_hits(decisions: DataFrame, exclusions: DataFrame, *, id: str = "decision_id", at: str = "evaluation_time", max_age_us: int,
                   run: RunDefinition | None = None) -> DataFrame:
    """Per decision how many load-time exclusions concern it, how many of them for want of a time, and whether it is covered.

    An exclusion concerns a decision in its scope: without availability always, else from its time
    on for ``max_age_us``.  Counts are running sums of starts and ends, so no pairs are made.
    ``covered``: the run's window holds all evidence that the decision could see.
    """
    missing = F.col("reason") == "MISSING_AVAILABILITY"
    rows = exclusions.filter(missing | F.col("available_at").isNotNull()).select(
        "evidence_id", "reason", "tickers", "sector", F.coalesce("is_global", F.lit(False)).alias("is_global"),
        F.when(missing, F.timestamp_micros(F.lit(0))).otherwise(F.col("available_at")).alias("available_at"),
        F.lit(None).cast("timestamp").alias("valid_from"),
        F.when(missing, F.lit("9999-12-31 00:00:00").cast("timestamp")).otherwise(F.timestamp_micros(micros("available_at") + F.lit(max_age_us))).alias("valid_until"),
        F.lit(True).alias("policy_eligible"))
    sums = live_sums(decisions, rows, id=id, at=at, max_age_us=max_age_us, value=F.when(F.col("reason") == "MISSING_AVAILABILITY", 1).otherwise(0))
    covered = F.lit(True) if run is None else micros(at).between(run.coverage[0], run.coverage[1])
    return decisions.select(id, covered.alias("covered")).join(sums, id, "left").select(
        id, "covered", F.coalesce("n", F.lit(0)).cast("long").alias("n_concerned"), F.coalesce("total", F.lit(0)).cast("long").alias("n_without_time"))


# --- rule policy --------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    rule_id: str
    match_keys: tuple[str, ...]
    action: str
    reason_code: str
    size_factor: float | None = None

    def __post_init__(self):
        import re
        if self.action not in ("BLOCK", "REDUCE_SIZE", "DELAY", "WARN_ONLY"):
            raise ValueError(f"{self.action} cannot be a rule action")
        if not self.match_keys or len(set(self.match_keys)) != len(self.match_keys):
            raise ValueError("match keys must be present and distinct")
        if any(not re.fullmatch(r"(AI_EVENT_TYPE|DETERMINISTIC_EVENT_TYPE|FLAG_TYPE):[A-Z0-9_]+", k) for k in self.match_keys):
            raise ValueError("match keys name an event or flag type")
        if (self.action == "REDUCE_SIZE") != (self.size_factor is not None) or (
                self.size_factor is not None and not 0 < self.size_factor <= 1):
            raise ValueError("a size factor in (0, 1] belongs to REDUCE_SIZE only")


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = ()
    version: str = "shadow_no_change_v1"

    def __post_init__(self):
        if len({r.rule_id for r in self.rules}) != len(self.rules):
            raise ValueError("rule ids must be unique")

    @property
    def config_hash(self) -> str:
        import hashlib
        import json
        rules = [dict(action=r.action, match_keys=list(r.match_keys), proposed_size_factor=r.size_factor,
                      reason_code=r.reason_code, rule_id=r.rule_id) for r in self.rules]
        return hashlib.sha256(json.dumps({"rules": rules}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def frame(self, spark) -> DataFrame:
        """Rules as rows, one per match key (configuration-sized, always broadcast)."""
        rows = [(i, r.rule_id, k, r.action, r.reason_code, r.size_factor) for i, r in enumerate(self.rules) for k in r.match_keys]
        return spark.createDataFrame(rows, "ordinal int, rule_id string, policy_match_key string, action string, reason_code string, size_factor double")


def live_sums(decisions: DataFrame, evidence: DataFrame, *, id: str, at: str, max_age_us: int, value: Column,
              ordinals: int = 1, sliced: bool | None = None) -> DataFrame:
    """(id, ordinal, n, total): how many selected rows a decision has and the sum of their ``value`` (long).

    A row counts from its start to its end, so both are running sums and no pairs are made.
    ``evidence`` may have an ``ordinal`` (0 to ordinals - 1); only decisions with rows appear.
    Values are summed as two halves of 32 bits in longs, which cannot overflow and cost far less than decimals.
    """
    usable = evidence.filter(F.col("policy_eligible") & F.col("available_at").isNotNull())
    if "ordinal" not in usable.columns:
        usable = usable.withColumn("ordinal", F.lit(0))
    keyed = _keys(usable.withColumn("_v", value.cast("long")).withColumns(_window(max_age_us)))
    weight, names = F.col("_weight").cast("long"), ("_n", "_hi", "_lo")
    moves = keyed.select("scope", "target", "ordinal", F.explode(F.array(
        F.struct(F.col("_from").alias("_t"), weight.alias("_w")),
        F.struct(F.greatest(F.col("_from"), F.col("_to") + 1).alias("_t"), (-weight).alias("_w")))).alias("_m"), "_v")
    moves = moves.select("scope", "target", "ordinal", "_m.*", "_v")
    parts = {"_n": F.col("_w"), "_hi": F.col("_w") * F.shiftright("_v", 32), "_lo": F.col("_w") * F.col("_v").bitwiseAND(F.lit(0xFFFFFFFF))}
    # the ordinals stand side by side, so a decision is one row per scope key however many there are
    sums = [f"{c}{i}" for i in range(ordinals) for c in names]
    moves = moves.groupBy("scope", "target", "_t").agg(
        *[F.sum(F.when(F.col("ordinal") == i, parts[c])).alias(f"{c}{i}") for i in range(ordinals) for c in names])
    probes = _decision_keys(decisions.select(id, "ticker", "sector", micros(at).alias("_t"))).select("scope", "target", "_t", id)
    timeline = moves.withColumns({"_kind": F.lit(0), id: F.lit(None).cast(decisions.schema[id].dataType)}).unionByName(
        probes.withColumns({"_kind": F.lit(1), **{c: F.lit(0).cast("long") for c in sums}}))
    live = OrderedScan(timeline, ["scope", "target"], ["_t", "_kind", id], sliced=sliced).running(
        *[Running(f"{c}_live", "sum", F.col(c)) for c in sums]).result()
    per = live.filter(F.col("_kind") == 1).groupBy(id).agg(*[F.sum(f"{c}_live").alias(c) for c in sums])

    def of(i: int) -> Column:  # halves meet as decimals, where the sum of the longs is exact
        total = F.col(f"_hi{i}").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col(f"_lo{i}")
        return F.struct(F.lit(i).alias("ordinal"), F.col(f"_n{i}").alias("n"), total.cast("long").alias("total"))

    return per.select(id, F.explode(F.array(*[of(i) for i in range(ordinals)])).alias("_o")).select(id, "_o.*").filter("n > 0")


def winning_rules(decisions: DataFrame, evidence: DataFrame, policy: Policy, *, id: str = "decision_id", at: str = "evaluation_time",
                  max_age_us: int, value: Column | None = None, sliced: bool | None = None) -> DataFrame:
    """(id, ordinal, n, total) of the first rule with selected evidence, by running counts instead of pairs."""
    rules = policy.frame(decisions.sparkSession).select("ordinal", "policy_match_key")
    per = live_sums(decisions, evidence.join(F.broadcast(rules), "policy_match_key"), id=id, at=at, max_age_us=max_age_us,
                    value=F.lit(0) if value is None else value, ordinals=len(policy.rules), sliced=sliced)
    first = per.groupBy(id).agg(F.min("ordinal").alias("ordinal"))
    return per.join(first, [id, "ordinal"])


def summarize(decisions: DataFrame, evidence: DataFrame, policy: Policy, *, id: str = "decision_id", at: str = "evaluation_time",
              max_age_us: int, value: Column) -> DataFrame:
    """Hypothetical action per decision with the number of matched rows and the sum of their ``value``; no pairs."""
    won = winning_rules(decisions, evidence, policy, id=id, at=at, max_age_us=max_age_us, value=value)
    heads = policy.frame(decisions.sparkSession).select("ordinal", "action", "reason_code", "size_factor").dropDuplicates(["ordinal"])
    out = decisions.join(won.join(F.broadcast(heads), "ordinal"), id, "left")
    return out.select(*decisions.columns, F.coalesce("action", F.lit("NO_CHANGE")).alias("hypothetical_action"),
                      F.col("size_factor").alias("proposed_size_factor"), F.array_compact(F.array("reason_code")).alias("reason_codes"),
                      F.coalesce("n", F.lit(0)).alias("matched_rows"), F.coalesce("total", F.lit(0)).alias("matched_total"))


def evaluate(decisions: DataFrame, evidence: DataFrame, policy: Policy, *, id: str = "decision_id", at: str = "evaluation_time",
             max_age_us: int) -> DataFrame:
    """Hypothetical action per decision: the first rule with a matching selected row wins.

    The winner is found by counting; only the winning rule's evidence is then joined, because
    only its identifiers are part of the result.
    """
    rules = policy.frame(decisions.sparkSession)
    key_rule = rules.select("ordinal", "policy_match_key")
    won = winning_rules(decisions, evidence, policy, id=id, at=at, max_age_us=max_age_us).select(id, "ordinal")
    probes = decisions.select(id, "ticker", "sector", at).join(won, id)
    hits = select(probes, evidence.join(F.broadcast(key_rule), "policy_match_key"), at=at, max_age_us=max_age_us, on=["ordinal"])
    item = F.struct("evidence_available_at", "category", "source", "source_record_id", "evidence_id")
    items = hits.groupBy(id, "ordinal").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    heads = rules.select("ordinal", "rule_id", "action", "reason_code", "size_factor").dropDuplicates(["ordinal"])
    out = decisions.join(items.join(F.broadcast(heads), "ordinal"), id, "left")

    def ids(*categories):
        kept = F.filter(F.coalesce("_items", F.array().cast(items.schema["_items"].dataType)), lambda e: e["category"].isin(*categories))
        return F.transform(kept, lambda e: e["evidence_id"])

    out = out.withColumns({
        "hypothetical_action": F.coalesce("action", F.lit("NO_CHANGE")), "proposed_size_factor": F.col("size_factor"),
        "reason_codes": F.array_compact(F.array("reason_code")),
        "matched_context_event_ids": ids("AI_EVENT", "DETERMINISTIC_EVENT"), "matched_context_flag_ids": ids("FLAG"),
        "policy_version": F.lit(policy.version), "policy_config_hash": F.lit(policy.config_hash)})
    return out.drop("ordinal", "_items", "action", "reason_code", "size_factor")


def selection_digest(decisions: DataFrame, evidence: DataFrame, *, id: str = "decision_id", at: str = "evaluation_time",
                     max_age_us: int, sliced: bool | None = None) -> DataFrame:
    """(id, selected_count, selected_digest): a digest of the selected evidence of every decision.

    Every row adds its hash when it starts and takes it away when it ends, so the digest of
    the live set is a running sum: equal sets give equal digests, and no pairs are made.
    """
    usable = evidence.filter(F.col("policy_eligible") & F.col("available_at").isNotNull())
    payload = F.sha2(canonical_json(**{c: F.col(c) for c in COLUMNS if c in evidence.columns}), 256)
    keyed = _keys(usable.withColumn("_h", payload).withColumns(_window(max_age_us)))
    sums = [f"_d{i}" for i in range(4)]
    parts = {d: F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") * F.col("_weight") for i, d in enumerate(sums)}
    keyed = keyed.withColumns(parts).withColumn("_n", F.col("_weight").cast("decimal(20,0)"))
    columns = ["_n", *sums]
    moves = keyed.select("scope", "target", F.explode(F.array(
        F.struct(F.col("_from").alias("_t"), *[F.col(c).alias(c) for c in columns]),
        F.struct(F.greatest(F.col("_from"), F.col("_to") + 1).alias("_t"), *[(-F.col(c)).alias(c) for c in columns]))).alias("_m"))
    moves = moves.select("scope", "target", "_m._t", *[F.col(f"_m.{c}").cast("decimal(38,0)").alias(c) for c in columns])
    moves = moves.groupBy("scope", "target", "_t").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in columns])
    probes = _decision_keys(decisions.select(id, "ticker", "sector", micros(at).alias("_t"))).select("scope", "target", "_t", id)
    timeline = moves.withColumns({"_kind": F.lit(0), id: F.lit(None).cast(decisions.schema[id].dataType)}).unionByName(
        probes.withColumns({"_kind": F.lit(1), **{c: F.lit(0).cast("decimal(38,0)") for c in columns}}))
    live = OrderedScan(timeline, ["scope", "target"], ["_t", "_kind", id], sliced=sliced).running(
        *[Running(f"{c}_live", "sum", F.col(c)) for c in columns]).result().filter(F.col("_kind") == 1)
    per = live.groupBy(id).agg(*[F.sum(f"{c}_live").alias(c) for c in columns])
    return per.select(id, F.col("_n").cast("long").alias("selected_count"),
                      F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256).alias("selected_digest"))


def identify(evaluations: DataFrame, contexts: DataFrame, digests: DataFrame, *, id: str = "decision_id", run_hash: str,
             signal_id: str, risk_decision_id: str | None = None, at: str = "evaluation_time") -> DataFrame:
    """Adds shadow_context_fingerprint and shadow_evaluation_id.

    ``contexts``: ``id``, context_fingerprint; ``digests``: :func:`selection_digest`.
    """
    out = evaluations.join(contexts.select(id, "context_fingerprint"), id).join(digests, id)
    out = out.withColumn("shadow_context_fingerprint", F.sha2(canonical_json(
        decision_context_fingerprint=F.col("context_fingerprint"), selected_event_evidence=F.col("selected_digest"),
        research_run_selection=F.lit(run_hash)), 256))
    risk = F.col(risk_decision_id) if risk_decision_id else F.lit(None).cast("string")
    return out.withColumn("shadow_evaluation_id", F.concat(F.lit("shadow_evaluation_"), F.sha2(canonical_json(
        model_signal_id=F.col(signal_id), risk_decision_id=risk, decision_evaluation_time=F.col(at),
        shadow_context_fingerprint=F.col("shadow_context_fingerprint"), policy_version=F.col("policy_version"),
        policy_config_hash=F.col("policy_config_hash")), 256))).drop("context_fingerprint", "selected_digest", "selected_count")
