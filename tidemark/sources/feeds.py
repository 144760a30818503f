"""Landed JSON feeds to rows: filings index, energy, rates, awards, dead letters, archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import accession, blank_to_null, document_path
from tidemark.functions.times import filing_timestamp, leading_date
from tidemark.operators import quality

# Form types that are kept.
FORMS = ("8-K", "8-K/A", "4", "4/A")

SUBMISSIONS = """cik string, name string, tickers array<string>, filings struct<recent: struct<form: array<string>,
filingDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>, acceptanceDateTime: array<string>>>"""
ENERGY = "response struct<data: array<struct<period: string, series: string, value: string, units: string, duoarea: string, product: string, process: string>>>"
RATES = "observations array<struct<date: string, value: string>>"
AWARD_SEARCH = """results array<struct<`Recipient UEI`: string, generated_internal_id: string, internal_id: string, `Award ID`: string,
`Recipient Name`: string, `Last Modified Date`: string, `Base Obligation Date`: string, `Award Amount`: double,
`Contract Award Type`: string, NAICS: string, PSC: string>>"""
AWARD_DETAIL = """generated_unique_award_id string, type string, category string, total_obligation double, base_exercised_options double,
base_and_all_options double, action_date string, date_signed string, last_modified_date string, last_modified string,
period_of_performance struct<last_modified_date: string, last_modified: string>, recipient struct<recipient_uei: string, recipient_name: string>,
awarding_agency struct<toptier_agency: struct<name: string>>, funding_agency struct<toptier_agency: struct<name: string>>,
latest_transaction_contract_data struct<naics: string, product_or_service_code: string>"""
AWARD_FUNDING = """results array<struct<transaction_obligated_amount: string, reporting_fiscal_year: string, reporting_fiscal_quarter: string,
reporting_fiscal_month: string, awarding_agency_name: string, funding_agency_name: string, federal_account: string, account_title: string,
program_activity_code: string, program_activity_name: string, object_class: string, object_class_name: string>>,
page_metadata struct<hasNext: boolean>"""
DEAD_LETTER = """fallback_schema_version string, fallback_written_at string, record_type string, target_table string, record_id string,
event_time string, source string, ticker_or_sector string, primary_write_failure map<string,string>, payload string"""


def read_json(spark: SparkSession, path: str, schema: str, *, lines: bool = False) -> DataFrame:
    """One document per file (or per line) with a declared schema and the file path."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path).withColumn("source_file", F.col("_metadata.file_path"))


def parallel_arrays(df: DataFrame, arrays: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Struct of parallel arrays to rows; shorter arrays are padded with NULL."""
    fields = df.select(arrays.alias("_a")).schema["_a"].dataType.names
    zipped = F.arrays_zip(*[F.coalesce(arrays[f], F.array().cast("array<string>")).alias(f) for f in fields])
    return df.select(*keep, F.explode(zipped).alias("_r")).select(*keep, *[F.col("_r").getField(f).alias(f) for f in fields])


def filings(submissions: DataFrame, issuers: DataFrame, *, forms: Sequence[str] = FORMS, start: str | None = None, end: str | None = None,
            collected_at: Column, base_url: str = "https://www.sec.gov/Archives/edgar/data", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(filings, rejected) of the wanted forms with a valid date in bounds and a primary document.

    ``issuers``: cik (ten digits), ticker.
    """
    wanted = [f for f in forms if f in FORMS]
    rows = parallel_arrays(submissions, F.col("filings.recent"), keep=["cik"])
    filed = leading_date("filingDate")
    rows = rows.withColumns({"form_type": F.trim("form"), "filing_date": filed, "primary_document": blank_to_null("primaryDocument")})
    rows = rows.filter(F.col("form_type").isin(*wanted) & F.col("filing_date").isNotNull() & F.col("primary_document").isNotNull())
    if start:
        rows = rows.filter(F.col("filing_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.filter(F.col("filing_date") <= F.lit(end).cast("date"))
    rows = rows.withColumn("issuer_cik", F.lpad(F.col("cik"), 10, "0")).join(
        issuers.select(F.col("cik").alias("issuer_cik"), "ticker"), "issuer_cik")
    number = accession("accessionNumber")
    out = rows.select(
        "ticker", "issuer_cik", number.alias("accession_number"), "form_type", "filing_date", "primary_document",
        F.concat_ws("/", F.lit(base_url), F.col("issuer_cik").cast("long").cast("string"), F.regexp_replace(number, "-", ""),
                    document_path("primary_document")).alias("filing_url"),
        collected_at.alias("collected_at"), filing_timestamp("acceptanceDateTime").alias("acceptance_at"), F.lit(None).cast("string").alias("amendment_of"))
    rules = {"accession_number": F.col("accession_number").isNotNull(), "primary_document": document_path("primary_document").isNotNull()}
    return quality.split(out, rules, strict=strict)


def issuer_problems(issuers: DataFrame) -> DataFrame:
    """(problem, key): malformed or repeated issuer identifiers."""
    bad = issuers.filter(~F.col("cik").rlike(r"^\d{10}$")).select(F.lit("invalid_cik").alias("problem"), F.col("cik").alias("key"))
    for c in ("cik", "ticker"):
        bad = bad.unionByName(issuers.groupBy(F.col(c).alias("key")).count().filter("count > 1").select(F.lit(f"duplicate_{c}").alias("problem"), "key"))
    return bad


def energy_observations(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("response.data").alias("r")).select("r.*")


def rate_observations(docs: DataFrame, series: Column) -> DataFrame:
    """Rows with ``row_seq``, the position inside their document."""
    return docs.select(series.alias("series"), F.posexplode("observations").alias("row_seq", "r")).select("series", "row_seq", "r.date", "r.value")


def award_search(docs: DataFrame) -> DataFrame:
    r = docs.select(F.explode("results").alias("r"))
    f = lambda n: F.col("r").getField(n)
    return r.select(
        blank_to_null(f("Recipient UEI")).alias("uei"), F.coalesce(blank_to_null(f("generated_internal_id")), blank_to_null(f("internal_id"))).alias("lookup_id"),
        blank_to_null(f("Award ID")).alias("award_id"), f("Recipient Name").alias("recipient_name"), f("Last Modified Date").alias("last_modified_date"),
        f("Base Obligation Date").alias("base_obligation_date"), f("Award Amount").alias("award_amount"),
        f("Contract Award Type").alias("contract_award_type"), f("NAICS").alias("naics"), f("PSC").alias("psc"))


def award_detail(docs: DataFrame, lookup_id: Column) -> DataFrame:
    return docs.select(
        lookup_id.alias("lookup_id"), "generated_unique_award_id", F.col("type").alias("award_type"), "category", "total_obligation",
        "base_exercised_options", "base_and_all_options", F.coalesce(leading_date("action_date"), leading_date("date_signed")).alias("business_date"),
        F.coalesce("last_modified_date", "last_modified", "period_of_performance.last_modified_date",
                   "period_of_performance.last_modified").alias("detail_last_modified"),
        F.col("recipient.recipient_uei").alias("uei"), F.col("awarding_agency.toptier_agency.name").alias("awarding_agency"),
        F.col("funding_agency.toptier_agency.name").alias("funding_agency"), F.col("latest_transaction_contract_data.naics").alias("naics"),
        F.col("latest_transaction_contract_data.product_or_service_code").alias("psc"))


def award_funding(docs: DataFrame, lookup_id: Column) -> DataFrame:
    return docs.select(lookup_id.alias("lookup_id"), F.coalesce("page_metadata.hasNext", F.lit(False)).alias("has_next"),
                       F.explode("results").alias("r")).select("lookup_id", "has_next", "r.*")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a dead-letter folder, payload kept as JSON text."""
    return spark.read.schema(DEAD_LETTER).json(path)


def classification_archive(docs: DataFrame) -> DataFrame:
    """``filings`` map (accession -> struct with a ``classifications`` map) to one row per classification."""
    per = docs.select(F.explode("filings").alias("accession_number", "f"))
    meta = [n for n in per.schema["f"].dataType.names if n != "classifications"]
    out = per.select("accession_number", *[F.col("f").getField(n).alias(f"filing_{n}") for n in meta],
                     F.explode(F.col("f.classifications")).alias("classification_key", "c"))
    return out.select("accession_number", *[f"filing_{n}" for n in meta], "classification_key", "c.*")


def calendar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, profiles, policies) of a versioned calendar artefact."""
    event = ("calendar_event_id string, logical_occurrence_id string, event_type string, scheduled_at timestamp, schedule_status string, "
             "source_provider string, source_reference string, schedule_revision_id string, schedule_captured_at timestamp, "
             "official_schedule_published_at timestamp, research_tier string, window_profile_id string")
    profile = "array<struct<profile_id: string, pre_event_minutes: int, post_event_minutes: int>>"
    policy = "array<struct<event_type: string, research_tier: string, window_profile_id: string>>"
    nested = "array<struct<" + ", ".join(p.strip().replace(" ", ": ", 1) for p in event.split(",")) + ">>"
    doc = spark.read.schema(f"calendar_version string, window_profiles {profile}, event_type_policies {policy}, events {nested}").option("multiLine", "true").json(path)
    e = doc.select("calendar_version", F.explode("events").alias("e")).select("calendar_version", "e.*").withColumnsRenamed({
        "logical_occurrence_id": "occurrence_id", "schedule_revision_id": "revision_id", "schedule_captured_at": "captured_at",
        "official_schedule_published_at": "published_at", "schedule_status": "status", "source_provider": "provider",
        "research_tier": "tier", "window_profile_id": "profile_id"})
    p = doc.select(F.explode("window_profiles").alias("p")).select("p.profile_id", F.col("p.pre_event_minutes").alias("pre_minutes"),
                                                                 F.col("p.post_event_minutes").alias("post_minutes"))
    return e, p, doc.select(F.explode("event_type_policies").alias("p")).select("p.*")
