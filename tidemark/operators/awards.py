"""Contract awards: exact-recipient candidates, enrichment, classification, registry upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_json, decimal_text, json_id
from tidemark.functions.times import local_date, micros

CONTRACT_TYPES = ("A", "B", "C", "D")
SEEN_RETENTION_DAYS = 45

# Fields of one funding record that count as evidence.
FUNDING_FIELDS = ("transaction_obligated_amount", "reporting_fiscal_year", "reporting_fiscal_quarter", "reporting_fiscal_month",
                  "awarding_agency_name", "funding_agency_name", "federal_account", "account_title", "program_activity_code",
                  "program_activity_name", "object_class", "object_class_name")


def recipient_problems(mapping: DataFrame) -> DataFrame:
    """(problem, key) of the recipient dimension: bad or repeated identifiers, unconfirmed rows."""
    bad = mapping.filter(~F.coalesce(F.col("uei").rlike("^[A-Z0-9]{12}$"), F.lit(False))).select(
        F.lit("invalid_uei").alias("problem"), F.col("uei").alias("key"))
    repeat = mapping.groupBy(F.col("uei").alias("key")).count().filter("count > 1").select(F.lit("duplicate_uei").alias("problem"), "key")
    open_ = mapping.filter(~(F.col("confirmed") & (F.col("role") == "prime_recipient"))).select(
        F.lit("not_confirmed_prime").alias("problem"), F.col("uei").alias("key"))
    return bad.unionByName(repeat).unionByName(open_)


def candidates(search: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exact-identifier candidates, rejected counts per searched recipient)."""
    exact = search.join(mapping.select("uei", "ticker", "mapping_version"), "uei")
    rejected = search.join(mapping.select("uei"), "uei", "left_anti").groupBy("uei").agg(F.count(F.lit(1)).alias("rejected"))
    return exact, rejected


def top_candidates(cands: DataFrame, k: int, *, recipient: str = "uei") -> tuple[DataFrame, DataFrame]:
    """(top k per recipient, overflow issues).

    The rank filter runs before the shuffle in every task as well, so a recipient with most
    rows sends k rows per task, and the overflow comes from a combined count.
    """
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).desc() for c in
             ("last_modified_date", "base_obligation_date", "lookup_id", "award_id")]
    ranked = cands.withColumn("candidate_rank", F.row_number().over(Window.partitionBy(recipient).orderBy(*blank)))
    over = cands.groupBy(recipient).agg(F.count(F.lit(1)).alias("candidates")).filter(F.col("candidates") > k).select(
        recipient, "candidates", F.lit("CANDIDATE_CAP_REACHED").alias("issue_type"))
    return ranked.filter(F.col("candidate_rank") <= k), over


def enrich(cands: DataFrame, details: DataFrame, funding: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete rows, issues): detail must exist and name the same recipient; funding must exist."""
    d = details.select("lookup_id", F.col("uei").alias("_detail_uei"), *[c for c in details.columns if c not in ("lookup_id", "uei")])
    f = funding.select("lookup_id", *[c for c in funding.columns if c != "lookup_id"], F.lit(True).alias("_funded"))
    both = cands.join(d, "lookup_id", "left").join(f, "lookup_id", "left")
    issue = (F.when(F.col("_detail_uei").isNull(), "DETAIL_MISSING").when(F.col("_detail_uei") != F.col("uei"), "RECIPIENT_MISMATCH")
             .when(F.col("_funded").isNull(), "FUNDING_MISSING"))
    both = both.withColumn("issue_type", issue)
    return (both.filter(F.col("issue_type").isNull()).drop("issue_type", "_detail_uei", "_funded"),
            both.filter(F.col("issue_type").isNotNull()).select("lookup_id", "uei", "issue_type"))


def is_contract(category: Column, award_type: Column) -> Column:
    return F.coalesce(category.isNull() | (category == "contract"), F.lit(True)) & F.coalesce(award_type.isin(*CONTRACT_TYPES), F.lit(False))


def funding_evidence(records: DataFrame, *, key: str = "lookup_id") -> DataFrame:
    """Per award: record count, page flags and a fingerprint independent of record order.

    The record hashes are added up (four 60-bit parts), which merges map-side like any sum; a
    sorted list would collect an award's records in one place.
    """
    present = [c for c in FUNDING_FIELDS if c in records.columns]
    row = F.sha2(canonical_json(**{c: F.col(c).cast("string") for c in present}), 256)
    hashed = records.withColumn("_h", row)
    parts = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"_s{i}") for i in range(4)]
    flags = [F.bool_or(c).alias(c) for c in ("has_next",) if c in records.columns]
    out = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("funding_records"), *parts, *flags)
    page = F.col("has_next").cast("string") if flags else F.lit("false")
    text = F.concat_ws("|", page, F.col("funding_records").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)])
    return out.withColumn("funding_fingerprint", F.sha2(text, 256)).drop(*[f"_s{i}" for i in range(4)])


def classify(stored: Column, business_date: Column, observed_at: Column, late_days: int) -> Column:
    """Stored class wins; recent business dates are new, anything else is a late discovery."""
    age = F.datediff(local_date(observed_at), business_date)
    return F.coalesce(stored, F.when(business_date.isNotNull() & (age <= late_days), "NEW_AWARD_DISCOVERED")
                      .otherwise("LATE_OR_BACKFILL_DISCOVERY"))


def identity(fields: Sequence[str]) -> Column:
    """Fingerprint over the listed identity columns (numbers in plain notation)."""
    return json_id("usaspending_event", 64, **{c: F.col(c).cast("string") for c in fields})


# Identity fields of an award event, and what its amounts and dates mean.
IDENTITY = ("source", "indicator_name", "ticker", "recipient_uei", "generated_unique_award_id", "event_classification", "mapping_version",
            "award_type", "source_business_date", "total_obligation_usd", "base_exercised_options_usd", "base_and_all_options_usd",
            "award_last_modified_date", "funding_page_complete", "funding_records_returned_count", "funding_evidence_fingerprint")
SOURCE, INDICATOR = "usaspending_awards_v1", "usaspending_contract_award_event_v1"
SEMANTICS = {
    "source_event_time_basis": "source_business_date_utc_midnight_convention",
    "amount_semantics": "award_total_not_incremental",
    "base_and_all_options_semantics": "not_funded_obligation",
    "funding_transaction_semantics": "bounded_records_not_current_transaction_signal",
    "cache_retention_policy": "bounded_process_memory_only",
    "availability_basis": "collector_observed",
}


def event_rows(enriched: DataFrame, observed_at: Column) -> DataFrame:
    """Award events with identity, amounts, agencies, codes and fixed semantics labels.

    Needs ticker, uei, generated_unique_award_id, event_classification, mapping_version,
    award_type, business_date, total_obligation, base_exercised_options, base_and_all_options,
    funding_records, funding_fingerprint, has_next; other columns are kept.
    """
    def opt(*names):
        have = [F.col(n) for n in names if n in enriched.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    df = enriched.withColumns({
        "source": F.lit(SOURCE), "indicator_name": F.lit(INDICATOR), "recipient_uei": F.col("uei"),
        "source_business_date": F.col("business_date").cast("string"), "total_obligation_usd": decimal_text("total_obligation"),
        "base_exercised_options_usd": decimal_text("base_exercised_options"), "base_and_all_options_usd": decimal_text("base_and_all_options"),
        "award_last_modified_date": opt("detail_last_modified", "last_modified_date"), "funding_page_complete": ~F.col("has_next"),
        "funding_records_returned_count": F.col("funding_records"), "funding_evidence_fingerprint": F.col("funding_fingerprint")})
    df = df.withColumns({
        "semantic_event_fingerprint": identity(IDENTITY), "source_event_time": F.col("business_date").cast("timestamp"),
        "collector_observed_at": observed_at, "entry_name": F.concat_ws(":", F.lit("usaspending"), F.lit("contract_award"), F.upper("ticker"), "generated_unique_award_id"),
        **{k: F.lit(v) for k, v in SEMANTICS.items()}})
    return df.withColumn("context_indicator_id", F.concat(F.lit("context_indicator_"), F.substring(F.sha2("semantic_event_fingerprint", 256), 1, 32)))


def state_entries(events: DataFrame, first_observed: str = "collector_observed_at") -> DataFrame:
    """State change rows of award events; they never expire."""
    return events.select(
        F.lit("TICKER").alias("scope"), F.upper("ticker").alias("target"), F.col("entry_name").alias("name"), F.col("event_classification").alias("value"),
        F.col(first_observed).alias("updated_at"), F.lit(None).cast("timestamp").alias("valid_until"), F.lit("INFO").alias("severity"), "source",
        "context_indicator_id", "semantic_event_fingerprint")


def merge_seen(seen: DataFrame, observed: DataFrame, *, key: str = "fingerprint") -> DataFrame:
    """Registry after a run: known rows get a new last_observed, new ones are inserted.

    Both: key, first_observed, last_observed and the same payload columns.  ``observed`` has
    one row per key.  Adds ``merge_action``.
    """
    rest = [c for c in seen.columns if c not in (key, "first_observed", "last_observed")]
    old = seen.select(key, F.struct("first_observed", "last_observed", *rest).alias("o"))
    new = observed.select(key, F.struct("first_observed", "last_observed", *rest).alias("n"))
    out = old.join(new, key, "full_outer")
    return out.select(
        key, F.coalesce("o.first_observed", "n.first_observed").alias("first_observed"),
        F.coalesce("n.last_observed", "o.last_observed").alias("last_observed"),
        *[F.coalesce(F.col(f"o.`{c}`"), F.col(f"n.`{c}`")).alias(c) for c in rest],
        F.when(F.col("o").isNull(), "INSERTED").when(F.col("n").isNull(), "UNCHANGED").otherwise("TOUCHED").alias("merge_action"))


def revisions(events: DataFrame, registry: DataFrame, *, key: str = "award_id") -> DataFrame:
    """Adds event_kind: a known award with another fingerprint is a REVISION."""
    known = registry.select(key, F.col("fingerprint").alias("_known"), F.col("classification").alias("stored_classification"))
    out = events.join(known, key, "left")
    return out.withColumn("event_kind", F.when(F.col("_known").isNull(), "DISCOVERY")
                          .when(F.col("_known") != F.col("fingerprint"), "REVISION").otherwise("SEEN")).drop("_known")


def missing_from_state(seen: DataFrame, state: DataFrame, *, key: str = "fingerprint") -> DataFrame:
    """Seen events to insert into the state again, with their first-observed time."""
    return seen.join(state.select(key), key, "left_anti").withColumn("updated_at", F.col("first_observed"))


def prune(rows: DataFrame, observed_at: Column, days: int, *, first: str = "first_observed") -> DataFrame:
    """Rows kept after a clean run: first observed within ``days``, or never dated."""
    cutoff = micros(observed_at) - F.lit(days * 86_400_000_000)
    return rows.filter(F.col(first).isNull() | (micros(first) >= cutoff))


def recheck_queue(registry: DataFrame, observed_at: Column, *, window_days: int, limit: int) -> DataFrame:
    """Registry rows due for a revision check, least recently checked first (a distributed top-k)."""
    cutoff = micros(observed_at) - F.lit(window_days * 86_400_000_000)
    due = registry.filter(F.col("first_observed").isNotNull() & (micros("first_observed") >= cutoff))
    return due.orderBy(F.col("last_checked").asc_nulls_first(), F.col("first_observed").asc_nulls_first(), F.col("award_id")).limit(limit)


def run_status(failed_all: Column, issue_count: Column, coverage_complete: Column, source_current: Column) -> Column:
    return (F.when(failed_all, "FAILED")
            .when((issue_count > 0) | ~coverage_complete | source_current.isNull(), "PARTIAL")
            .when(~source_current, "STALE").otherwise("SUCCESS"))


def source_age_days(observed_at: Column, source_day: Column) -> Column:
    return F.datediff(local_date(observed_at), source_day)


def source_current(observed_at: Column, source_day: Column, max_age_days: int) -> Column:
    """Age within the limit; a future source date is not current; unknown stays NULL."""
    age = source_age_days(observed_at, source_day)
    return (age >= 0) & (age <= max_age_days)
