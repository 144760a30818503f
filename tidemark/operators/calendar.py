"""Event calendar: revisions, active windows, upcoming lists, activation and revocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import stable_id
from tidemark.functions.times import MINUTE, micros
from tidemark.operators.intervals import interval_join
from tidemark.operators.ordered import first_per_key

# Statuses under which an event can be active.
ACTIVE_STATUSES = ("CONFIRMED", "TENTATIVE")
INACTIVE_STATUSES = ("SUPERSEDED", "CANCELLED")

# Supported event types and research tiers.
EVENT_TYPES = ("FOMC_DECISION", "CPI", "PPI", "EMPLOYMENT_SITUATION", "JOLTS", "PERSONAL_INCOME_AND_OUTLAYS", "GDP",
               "RETAIL_SALES", "ISM_MANUFACTURING_PMI", "ISM_SERVICES_PMI", "INITIAL_JOBLESS_CLAIMS")
TIERS = ("TIER_1", "TIER_2", "TIER_3")


def latest_revisions(events: DataFrame) -> DataFrame:
    """Newest capture per logical occurrence."""
    return first_per_key(events, ["occurrence_id"], ["captured_at", "revision_id"], last=True)


def revision_problems(events: DataFrame) -> DataFrame:
    """(problem, occurrence_id): repeated revision ids or capture times, mixed type or provider."""
    per = events.groupBy("occurrence_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("revision_id").alias("ids"), F.count_distinct("captured_at").alias("times"),
        (F.min("event_type") != F.max("event_type")).alias("types"), (F.min("provider") != F.max("provider")).alias("providers"))
    names = {"duplicate_revision_id": F.col("ids") < F.col("n"), "duplicate_captured_at": F.col("times") < F.col("n"),
             "event_type_mismatch": F.col("types"), "provider_mismatch": F.col("providers")}
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in names.items()]))
    return per.select("occurrence_id", F.explode(found).alias("problem"))


def with_windows(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds effective_from and effective_to (micros) from the window profile."""
    df = events.join(profiles.select("profile_id", "pre_minutes", "post_minutes"), "profile_id")
    at = micros("scheduled_at")
    return df.withColumns({"effective_from": at - F.col("pre_minutes").cast("long") * F.lit(MINUTE),
                           "effective_to": at + F.col("post_minutes").cast("long") * F.lit(MINUTE)}).drop("pre_minutes", "post_minutes")


def can_be_active() -> Column:
    return F.col("status").isin(*ACTIVE_STATUSES)


def active_at(probes: DataFrame, revisions: DataFrame, *, at: str = "evaluation_time") -> DataFrame:
    """Probe x event rows whose inclusive window contains the probe."""
    ev = revisions.filter(can_be_active()).select(F.lit(1).alias("_k"), "occurrence_id", "event_type", "effective_from", "effective_to")
    return interval_join(probes.withColumns({"_k": F.lit(1), "_at": micros(at)}), ev, keys=["_k"], at="_at",
                         start="effective_from", end="effective_to").drop("_k", "_at")


def between(revisions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events scheduled in [start, end), in calendar order."""
    return revisions.filter((F.col("scheduled_at") >= start) & (F.col("scheduled_at") < end)).orderBy("scheduled_at", "occurrence_id")


def upcoming(revisions: DataFrame, now: Column, *, within_us: int | None = None, limit: int | None = None) -> DataFrame:
    """Next active-status events after ``now`` (a top-k when limited)."""
    out = revisions.filter(can_be_active() & (F.col("scheduled_at") > now))
    if within_us is not None:
        out = out.filter(micros("scheduled_at") <= micros(now) + F.lit(within_us))
    out = out.orderBy("scheduled_at", "occurrence_id")
    return out if limit is None else out.limit(limit)


def state_name() -> Column:
    return F.concat_ws(":", F.lit("macro_calendar"), F.lit("active"), "occurrence_id")


def indicator_name() -> Column:
    return F.concat_ws(":", F.lit("macro_calendar_active"), "event_type", "occurrence_id")


def event_id(calendar_version: str) -> Column:
    return stable_id("calendar_event", F.lit(calendar_version), F.col("occurrence_id"), F.col("revision_id"))


def problems() -> dict[str, Column]:
    """Constraint table of one calendar event."""
    return {
        "event_type": F.col("event_type").isin(*EVENT_TYPES),
        "tier": F.col("tier").isin(*TIERS),
        "forbidden_family": ~F.upper(F.concat_ws(" ", "event_type", "occurrence_id", "source_reference")).rlike("EIA|PETROLEUM"),
        "status": F.col("status").isin(*ACTIVE_STATUSES, *INACTIVE_STATUSES),
        "published_before_captured": F.col("published_at").isNull() | (F.col("published_at") <= F.col("captured_at")),
        "scheduled_at": F.col("scheduled_at").isNotNull(),
        "revision_id": F.col("revision_id").isNotNull() & (F.trim("revision_id") != ""),
        "source_reference": F.trim(F.coalesce("source_reference", F.lit(""))) != "",
    }


def state_rows(revisions: DataFrame, now: Column, existing: DataFrame | None = None) -> DataFrame:
    """State change rows: active events TRUE until their window ends, revoked ones FALSE at capture time.

    ``existing``: name, value, revision_id of the current state; only TRUE entries are revoked,
    and those of an older revision.
    """
    t = micros(now)
    name = state_name()
    rows = revisions.withColumns({"name": name, "indicator_id": stable_id(
        "context_indicator", F.lit("macro_calendar_v1"), F.col("occurrence_id"), F.col("revision_id"), F.col("effective_from"), F.col("effective_to"))})
    active = rows.filter(can_be_active() & t.between(F.col("effective_from"), F.col("effective_to"))).select(
        F.lit("GLOBAL").alias("scope"), F.lit("*").alias("target"), "name", F.lit("true").alias("value"),
        F.col("captured_at").alias("updated_at"), F.timestamp_micros("effective_to").alias("valid_until"), "revision_id", "indicator_id")
    if existing is None:
        return active
    # a cancelled event, or one outside its window whose entry came from an older revision
    off = rows.filter(~can_be_active() | ~t.between(F.col("effective_from"), F.col("effective_to")))
    held = existing.filter(F.col("value") == "true").select("name", F.col("revision_id").alias("_held"))
    off = off.join(held, "name").filter(~can_be_active() | ~F.col("_held").eqNullSafe(F.col("revision_id")))
    revoked = off.select(F.lit("GLOBAL").alias("scope"), F.lit("*").alias("target"), "name", F.lit("false").alias("value"),
                         F.col("captured_at").alias("updated_at"), F.col("captured_at").alias("valid_until"), "revision_id", "indicator_id")
    return active.unionByName(revoked)
