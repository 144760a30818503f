"""Keyed latest state from a change log: update status, latest view, snapshots, refresh state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import micros
from tidemark.operators.asof import asof_join
from tidemark.operators.ordered import OrderedScan, Running, first_per_key

KEY = ("scope", "target", "name")

# Severities from low to high, and the risk level each gives.
SEVERITY_RANK = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
RISK_LEVEL = {"LOW": "LOW", "MEDIUM": "ELEVATED", "HIGH": "HIGH", "CRITICAL": "HIGH"}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def severity_rank(c: Column) -> Column:
    return F.try_element_at(_map(SEVERITY_RANK), c)


def risk_level(c: Column) -> Column:
    return F.try_element_at(_map(RISK_LEVEL), c)


def semantic_details(details: Column, fields: Sequence[str]) -> Column:
    """Details struct without its audit fields (freshness, observation and collection time)."""
    drop = [f for f in ("freshness_seconds", "collector_observed_at") if f in fields]
    out = details.dropFields(*drop) if drop else details
    return out.dropFields("provenance.collected_at") if "provenance" in fields else out


def update_status(log: DataFrame, *, key: Sequence[str] = KEY, arrival: Sequence[str] = ("arrival_seq",),
                  updated: str = "updated_at", content: Sequence[str] = ("value", "severity", "source", "valid_until"),
                  sliced: bool | None = None) -> DataFrame:
    """Adds ``update_status`` in arrival order: WRITTEN, IGNORED_STALE, IGNORED_DUPLICATE, REPLACED.

    The stored content is that of the last row that was not stale: a duplicate has the same.
    """
    at, same = F.col("_at"), F.col("_content").eqNullSafe(F.col("_stored"))
    scan = OrderedScan(log.withColumns({"_at": micros(updated), "_content": F.struct(*content)}), key, arrival, sliced=sliced)
    scan = scan.running(Running("_max", "max", at, inclusive=False))
    fresh = F.col("_max").isNull() | (at >= F.col("_max"))
    scan = scan.running(Running("_stored", "last", F.when(fresh, F.col("_content")), inclusive=False))
    return scan.result().withColumn(
        "update_status", F.when(F.col("_max").isNull(), "WRITTEN").when(at < F.col("_max"), "IGNORED_STALE")
        .when((at == F.col("_max")) & same, "IGNORED_DUPLICATE").otherwise("REPLACED")
    ).drop("_at", "_content", "_max", "_stored")


def accepted(statused: DataFrame) -> DataFrame:
    """Rows that changed the state: the only ones the ledger gets."""
    return statused.filter(F.col("update_status").isin("WRITTEN", "REPLACED"))


def latest(log: DataFrame, *, key: Sequence[str] = KEY, arrival: Sequence[str] = ("arrival_seq",),
           updated: str = "updated_at", content: Sequence[str] = ("value", "severity", "source", "valid_until")) -> DataFrame:
    """Newest accepted entry per key.

    Among rows with the newest time an unchanged repeat keeps the earlier row.  Only rows of
    that time can matter, so the status pass runs on them alone.
    """
    newest = log.groupBy(*key).agg(F.max(updated).alias("_newest"))
    at_newest = log.join(newest, list(key)).filter(F.col(updated) == F.col("_newest")).drop("_newest")
    kept = accepted(update_status(at_newest, key=key, arrival=arrival, updated=updated, content=content)).drop("update_status")
    return first_per_key(kept, list(key), list(arrival), last=True)


def evict(state: DataFrame, *, key: Sequence[str] = KEY, max_entries: int, updated: str = "updated_at") -> DataFrame:
    """Newest ``max_entries`` entries by (updated, key); a distributed top-k, not a full sort."""
    order = [F.col(updated).desc(), *[F.col(k).desc() for k in key]]
    return state.orderBy(*order).limit(max_entries)


def visible(state: DataFrame, now: Column, *, include_expired: bool = False) -> DataFrame:
    """Entries whose validity has not ended (the end is inclusive)."""
    expired = F.coalesce(now > F.col("valid_until"), F.lit(False))
    out = state.withColumn("expired", expired)
    return out if include_expired else out.filter(~F.col("expired"))


def for_scope(state: DataFrame, scope: str, target: str = "*", now: Column | None = None) -> DataFrame:
    """Visible entries of one scope in key order."""
    rows = state.filter((F.col("scope") == scope) & (F.col("target") == target))
    return (visible(rows, now) if now is not None else rows).orderBy(*KEY)


def scope_keys(df: DataFrame, ticker: str = "ticker", sector: str = "sector") -> DataFrame:
    """Each row once per scope it can see: GLOBAL, its TICKER, its SECTOR."""
    keys = F.array(F.struct(F.lit("GLOBAL").alias("scope"), F.lit("*").alias("target")),
                   F.struct(F.lit("TICKER").alias("scope"), F.col(ticker).alias("target")),
                   F.struct(F.lit("SECTOR").alias("scope"), F.col(sector).alias("target")))
    return df.withColumn("_key", F.explode(F.filter(keys, lambda k: k["target"].isNotNull()))).select(
        "*", F.col("_key.scope").alias("scope"), F.col("_key.target").alias("target")).drop("_key")


def snapshots(subjects: DataFrame, state: DataFrame, *, now: str = "now") -> DataFrame:
    """One context snapshot per subject row (ticker, sector, ``now``)."""
    seen = scope_keys(subjects).join(state, ["scope", "target"], "left")
    found = F.col("name").isNotNull()
    expired = found & F.coalesce(F.col(now) > F.col("valid_until"), F.lit(False))
    fresh = found & ~expired
    rank = F.when(fresh, severity_rank(F.col("severity")))
    flag = F.when(fresh & (F.col("value") == "true"), F.nullif(F.trim(F.col("flag_id")), F.lit(""))) \
        if "flag_id" in state.columns else F.lit(None).cast("string")
    out = seen.groupBy(*subjects.columns).agg(
        F.count_if(fresh).alias("fresh_entry_count"), F.count_if(expired).alias("expired_entry_count"),
        F.max_by("severity", rank).alias("_severity"), F.min(F.when(fresh, F.col("valid_until"))).alias("valid_until"),
        F.array_sort(F.collect_set(flag)).alias("active_context_flag_ids"))
    level = risk_level(F.col("_severity"))
    aged = (F.col("expired_entry_count") > 0) & (level.isNull() | (level == "LOW"))
    return out.withColumns({
        "highest_severity": F.when(aged, "EXPIRED").otherwise(F.col("_severity")),
        "risk_level": F.when(aged, "ELEVATED").otherwise(level)}).drop("_severity")


def documents(state: DataFrame, entry: Sequence[str]) -> DataFrame:
    """Per (scope, target): entries as a name -> entry map with their count."""
    return state.groupBy("scope", "target").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.struct(*entry).alias("entry"))))).alias("entries"),
        F.count(F.lit(1)).alias("entry_count"))


def validity(log: DataFrame, *, key: Sequence[str] = KEY, arrival: Sequence[str] = ("arrival_seq",),
             updated: str = "updated_at", valid_until: str = "valid_until", sliced: bool | None = None) -> DataFrame:
    """History as intervals in micros: each entry rules from its time to just before the next one.

    At one time the last arrival wins.  ``visible_to`` is NULL when the end is open.
    """
    one = first_per_key(log, [*key, updated], list(arrival), last=True).withColumn("visible_from", micros(updated))
    nxt = OrderedScan(one, key, ["visible_from"], sliced=sliced).running(
        Running("_next", "last", F.col("visible_from"), inclusive=False), reverse=True).result()
    return nxt.withColumn("visible_to", F.least(F.col("_next") - 1, micros(valid_until))).drop("_next")


def first_seen(facts: DataFrame, *, key: Sequence[str], order: Sequence[str], collected: str, content: Sequence[str],
               sliced: bool | None = None) -> DataFrame:
    """Adds ``first_collected_at``: a run of equal content keeps the time of its first row."""
    scan = OrderedScan(facts.withColumn("_content", F.struct(*content)), key, order, sliced=sliced)
    scan = scan.running(Running("_prev", "last", F.col("_content"), inclusive=False))
    starts = ~F.col("_content").eqNullSafe(F.col("_prev"))
    scan = scan.running(Running("first_collected_at", "last", F.when(starts, F.col(collected))))
    return scan.result().drop("_content", "_prev")


# --- refresh log --------------------------------------------------------------------------

USABLE = ("SUCCESS", "PARTIAL", "STALE", "NO_FRESH_DATA")


def refresh_state(log: DataFrame, *, key: str = "source_id", order: Sequence[str] = ("observed_at",),
                  sliced: bool | None = None) -> DataFrame:
    """Adds the running refresh state to a log with failed, usable and full_success booleans.

    A failed attempt completes nothing.
    """
    at = F.when(~F.col("failed"), F.col("completed_at"))
    scan = OrderedScan(log, [key], order, sliced=sliced).running(
        Running("_fails", "count", F.when(F.col("failed"), 1)),
        Running("_unusable", "count", F.when(~F.col("usable"), 1)),
        Running("last_completed_at", "last", at),
        Running("last_usable_at", "last", F.when(F.col("usable"), at)),
        Running("last_full_success_at", "last", F.when(F.col("full_success"), at)))
    scan = scan.running(
        Running("_fails_base", "last", F.when(~F.col("failed"), F.col("_fails"))),
        Running("_unusable_base", "last", F.when(F.col("usable"), F.col("_unusable"))))
    return scan.result().withColumns({
        "consecutive_failure_count": F.col("_fails") - F.coalesce("_fails_base", F.lit(0)),
        "consecutive_non_usable_count": F.col("_unusable") - F.coalesce("_unusable_base", F.lit(0)),
    }).drop("_fails", "_unusable", "_fails_base", "_unusable_base")


UNKNOWN_READINESS = "UNKNOWN_NOT_REFRESHED"


def readiness(probes: DataFrame, log: DataFrame, *, at: str, key: str = "source_id", sliced: bool | None = None) -> DataFrame:
    """Refresh state observed at or before ``at``; any later timestamp in it makes it unknown.

    ``log``: the output of :func:`refresh_state` with observed_at, attempted_at, status.
    Adds refresh_status and readiness_age_seconds.
    """
    cols = ["status", "attempted_at", "last_completed_at", "last_usable_at", "last_full_success_at",
            "consecutive_failure_count", "consecutive_non_usable_count"]
    rows = log.withColumn("_observed", micros("observed_at"))
    p = probes.withColumn("_probe", micros(at))
    hit = asof_join(p, rows, keys=[key], left_at="_probe", right_at="_observed", right_order=["attempted_at"],
                    right_cols=cols, direction="backward", sliced=sliced)
    newest = F.greatest("attempted_at", "last_completed_at", "last_usable_at", "last_full_success_at")
    known = F.col("status").isNotNull() & (newest.isNull() | (newest <= F.col(at)))
    return hit.withColumns({
        "refresh_status": F.when(known, F.col("status")).otherwise(UNKNOWN_READINESS),
        "readiness_age_seconds": F.when(known, (micros(at) - micros("last_completed_at")) / 1e6),
    }).drop("_probe", "status")
