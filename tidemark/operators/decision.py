"""Decision context: what structured state one decision may see, and how it is classed."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_json
from tidemark.functions.times import micros
from tidemark.operators.intervals import interval_join
from tidemark.operators.state import KEY, scope_keys, validity

# Source -> (refresh source, resource family, mode, authority).
SOURCES = {
    "macro_calendar_v1": ("macro_calendar", "MACRO_CALENDAR", "LOCAL_REVIEWED", "RESEARCH_ONLY"),
    "eia_wpsr_v1": ("eia_wpsr", "EIA_WPSR", "OFFICIAL_SOURCE", "RESEARCH_ONLY"),
    "fred_rates_v1": ("fred", "FRED", "OFFICIAL_SOURCE", "RESEARCH_ONLY"),
    "usaspending_awards_v1": ("usaspending", "USASPENDING", "OFFICIAL_SOURCE", "RESEARCH_ONLY"),
    "yfinance_dev_raw_v1": ("yfinance_dev_only", "YFINANCE_DEV", "DEVELOPMENT_ONLY", "DEVELOPMENT_ONLY"),
}
SCHEMA_VERSION = "decision_context_v1"
SCOPE_RANK = {"GLOBAL": 0, "SECTOR": 1, "TICKER": 2}


def classify_source(source: Column) -> Column:
    """Struct (refresh_source_id, resource_family, source_mode, authority_class)."""
    names = ("refresh_source_id", "resource_family", "source_mode", "authority_class")
    table = F.create_map(*[x for s, v in SOURCES.items()
                           for x in (F.lit(s), F.struct(*[F.lit(a).alias(n) for a, n in zip(v, names)]))])
    unknown = F.struct(F.lit(None).cast("string").alias(names[0]), F.lit("UNKNOWN").alias(names[1]),
                       F.lit("UNKNOWN").alias(names[2]), F.lit("RESEARCH_ONLY").alias(names[3]))
    return F.coalesce(F.try_element_at(table, source), unknown)


def authority(cls: Column, approved: Column) -> Column:
    """A policy lifts exact rows of known sources, never development-only ones."""
    liftable = cls["refresh_source_id"].isNotNull() & (cls["source_mode"] != "DEVELOPMENT_ONLY")
    return F.when(liftable & approved, "APPROVED_RISK_CONTEXT").otherwise(cls["authority_class"])


def approvals(rules: list[tuple[str, str, str]]) -> Column:
    """Policy test on (source, scope, name); no rules denies everything."""
    test = F.lit(False)
    for source, scope, name in rules:
        test = test | ((F.col("source") == source) & (F.col("scope") == scope) & (F.col("name") == name))
    return test


def resolve_sector(df: DataFrame, mapping: DataFrame, explicit: str | None = None) -> DataFrame:
    """Adds sector and sector_status: explicit value, then the mapping, else UNRESOLVED."""
    out = df.join(mapping.select("ticker", F.col("sector").alias("_mapped")), "ticker", "left")
    given = F.upper(F.nullif(F.trim(F.col(explicit)), F.lit(""))) if explicit else F.lit(None).cast("string")
    return out.withColumns({
        "sector": F.coalesce(given, F.col("_mapped")),
        "sector_status": F.when(given.isNotNull(), "EXPLICIT").when(F.col("_mapped").isNotNull(), "INJECTED_MAPPING")
        .otherwise("UNRESOLVED")}).drop("_mapped")


# --- provenance ---------------------------------------------------------------------------

# The provenance record.
PROVENANCE_VERSION = "context_provenance_v1"
PROVENANCE_FIELDS = ("provenance_version", "source_event_time", "source_observed_at", "available_at", "collected_at",
                     "effective_from", "valid_until", "availability_basis", "research_asof_eligible", "revision_id",
                     "vintage_id", "source_record_id")


def provenance(**fields: Column) -> Column:
    """Provenance struct with exactly the known fields (missing ones NULL)."""
    unknown = set(fields) - set(PROVENANCE_FIELDS)
    if unknown:
        raise ValueError(f"unknown provenance fields: {sorted(unknown)}")
    kinds = {f: "timestamp" for f in PROVENANCE_FIELDS if f.endswith("_at") or f.endswith("_time")
             or f in ("effective_from", "valid_until")}
    kinds["research_asof_eligible"] = "boolean"
    fields.setdefault("provenance_version", F.lit(PROVENANCE_VERSION))
    return F.struct(*[fields.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in PROVENANCE_FIELDS])


def well_formed(p: Column) -> Column:
    return p.isNotNull() & p["collected_at"].isNotNull() & p["availability_basis"].isNotNull() & p["research_asof_eligible"].isNotNull()


def asof_eligible(p: Column, t: Column) -> Column:
    """Eligible flag set and available at or before ``t``; malformed provenance is not eligible."""
    return F.coalesce(well_formed(p) & p["research_asof_eligible"] & (p["available_at"] <= t), F.lit(False))


def active_window(p: Column, t: Column) -> Column:
    """effective_from <= t <= valid_until; FALSE when either is missing."""
    return F.coalesce(t.between(p["effective_from"], p["valid_until"]), F.lit(False))


def provenance_state(p: Column, t: Column) -> Column:
    return (F.when(~well_formed(p), "MISSING_OR_MALFORMED").when(asof_eligible(p, t), "ASOF_ELIGIBLE")
            .otherwise("ASOF_INELIGIBLE"))


def provenance_misaligned(p: Column, source_event_time: Column, valid_until: Column, available_at: Column | None = None) -> Column:
    """First provenance field that disagrees with its record, NULL when aligned."""
    out = (F.when(~p["source_event_time"].eqNullSafe(source_event_time), "source_event_time")
           .when(~p["valid_until"].eqNullSafe(valid_until), "valid_until"))
    return out if available_at is None else out.when(~p["available_at"].eqNullSafe(available_at), "available_at")


# --- assembly -----------------------------------------------------------------------------

def visible_entries(decisions: DataFrame, log: DataFrame, *, at: str = "evaluation_time", mode: str = "asof",
                    state: DataFrame | None = None, policy: Column | None = None) -> DataFrame:
    """Decision x visible entry rows.

    ``asof``: the newest entry at or before the decision, from the whole change log.
    ``cache``: the given final state only; entries newer than the decision are dropped here
    (count them with :func:`future_exclusions`).
    """
    seen = scope_keys(decisions.withColumn("_at", micros(at)))
    if mode == "asof":
        pairs = interval_join(seen, validity(log), keys=["scope", "target"], at="_at", start="visible_from", end="visible_to")
        pairs = pairs.drop("visible_from", "visible_to")
    elif mode == "cache":
        pairs = seen.join(state, ["scope", "target"]).filter(
            (micros("updated_at") <= F.col("_at")) & F.coalesce(F.col("_at") <= micros("valid_until"), F.lit(True)))
    else:
        raise ValueError("mode must be 'asof' or 'cache'")
    cls = classify_source(F.col("source"))
    out = pairs.withColumn("_cls", cls)
    out = out.withColumns({
        "resource_family": F.col("_cls.resource_family"), "source_mode": F.col("_cls.source_mode"),
        "refresh_source_id": F.col("_cls.refresh_source_id"),
        "authority_class": authority(F.col("_cls"), policy if policy is not None else F.lit(False)),
        "selection_scope": F.when(F.col("scope") == "GLOBAL", "GLOBAL").otherwise(F.concat("scope", F.lit("_MATCH"))),
        "entry_identity": F.concat_ws("|", "source", "scope", F.when(F.col("scope") == "GLOBAL", "").otherwise(F.col("target")), "name")})
    return out.drop("_cls", "_at")


def future_exclusions(decisions: DataFrame, state: DataFrame, *, at: str = "evaluation_time") -> DataFrame:
    """Per decision the number of unexpired state entries newer than it (cache mode)."""
    seen = scope_keys(decisions).join(state, ["scope", "target"])
    return seen.groupBy(*decisions.columns).agg(F.count_if(
        (F.col("updated_at") > F.col(at)) & F.coalesce(F.col(at) <= F.col("valid_until"), F.lit(True))).alias("future_entry_exclusion_count"))


def assemble(decisions: DataFrame, entries: DataFrame, *, id: str = "decision_id", at: str = "evaluation_time",
             policy_version: str = "decision_context_policy_v1_default_deny", readiness: Column | None = None) -> DataFrame:
    """One context per decision: ordered entries, approved subset, fingerprint and snapshot id."""
    rank = F.create_map(*[x for k, v in SCOPE_RANK.items() for x in (F.lit(k), F.lit(v))])
    item = F.struct(F.element_at(rank, F.col("scope")).alias("rank"), "scope", "target", "name", "source", "updated_at",
                    "value", "severity", "valid_until", "authority_class", "entry_identity")
    per = entries.groupBy(id).agg(F.array_sort(F.collect_list(item)).alias("structured_context"))
    out = decisions.join(per, id, "left").withColumn(
        "structured_context", F.coalesce("structured_context", F.array().cast(per.schema["structured_context"].dataType)))
    out = out.withColumn("approved_risk_context", F.filter(
        "structured_context", lambda e: e["authority_class"] == "APPROVED_RISK_CONTEXT"))
    fields = {"context_schema_version": F.lit(SCHEMA_VERSION), "ticker": F.col("ticker"), "ticker_sector": F.col("sector"),
              "sector_resolution_status": F.col("sector_status"), "evaluation_time": F.col(at),
              "all_structured_context": F.col("structured_context"), "policy_version": F.lit(policy_version),
              "source_readiness": readiness if readiness is not None else F.lit(None).cast("string")}
    out = out.withColumn("context_fingerprint", F.concat(F.lit("decision_context_"), F.sha2(canonical_json(**fields), 256)))
    return out.withColumn("context_snapshot_id", F.concat(F.lit("context_snapshot_"), F.sha2(F.concat_ws(
        "|", F.col(id).cast("string"), "ticker", F.col(at).cast("string"), "context_fingerprint", F.lit(SCHEMA_VERSION)), 256)))


def audit_payload(contexts: DataFrame, columns: list[str]) -> DataFrame:
    """Audit document per context as JSON text."""
    return contexts.select("context_snapshot_id", F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("audit_json"))


__all__ = ["KEY", "SOURCES", "approvals", "asof_eligible", "assemble", "audit_payload", "authority",
           "classify_source", "future_exclusions", "provenance", "provenance_misaligned", "provenance_state",
           "resolve_sector", "visible_entries", "active_window"]
