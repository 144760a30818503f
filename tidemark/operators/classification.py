"""Classifier results: output validation, text policy, reuse of earlier results, ledger rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_json
from tidemark.operators.ordered import first_per_key

# Vocabulary of classifier answers.
EVENT_TYPES = (
    "UNKNOWN", "OTHER", "GOVERNMENT_CONTRACT", "REGULATORY_POLICY", "GEOPOLITICAL", "SUPPLY_DISRUPTION", "EARNINGS_GUIDANCE",
    "LEGAL", "CYBERSECURITY", "MANAGEMENT_CHANGE", "SOCIAL_POLITICAL_STATEMENT", "SEC_8K_MATERIAL_AGREEMENT",
    "SEC_8K_TERMINATION_OF_MATERIAL_AGREEMENT", "SEC_8K_BANKRUPTCY", "SEC_8K_CYBERSECURITY_INCIDENT", "SEC_8K_ACQUISITION",
    "SEC_8K_RESULTS", "SEC_8K_DIRECT_FINANCIAL_OBLIGATION", "SEC_8K_DEBT_DEFAULT", "SEC_8K_EXIT_OR_DISPOSAL_COSTS",
    "SEC_8K_MATERIAL_IMPAIRMENT", "SEC_8K_DELISTING", "SEC_8K_AUDITOR_CHANGE", "SEC_8K_NON_RELIANCE", "SEC_8K_CHANGE_IN_CONTROL",
    "SEC_8K_EXECUTIVE_OR_DIRECTOR_CHANGE", "SEC_8K_REGULATION_FD", "SEC_8K_OTHER_EVENT")
RISK_LEVELS = ("UNKNOWN", "LOW", "MEDIUM", "HIGH", "CRITICAL")
URGENCIES = ("UNKNOWN", "LOW", "MEDIUM", "HIGH")
KEYS = ("status", "event_type", "risk_level", "urgency", "confidence", "summary")

# Word groups of the trading-instruction patterns.
_START = r"(?:^\s*|[.!?;:]\s+|\r?\n\s*)"
_NOUN = r"(?:stocks?|shares?|securit(?:y|ies)|equity|equities|positions?)"
_ACTOR = r"(?:investors?|traders?|clients?|shareholders?|you)"
_MODAL = r"(?:should|must|ought\s+to|need\s+to)"
_ACTION = r"(?:buy(?:ing)?|sell(?:ing)?|hold(?:ing)?)"
_ORDER = r"(?:buy|sell|market|limit|stop(?:[- ](?:limit|loss))?)"
_ADVICE = r"(?:recommend(?:s|ed|ing|ation)?|advis(?:e|es|ed|ing)|urge(?:s|d|ing)?)"
_SYMBOL = r"[A-Z][A-Z0-9.-]{0,5}\b"
# Trading-instruction patterns that ignore case.
ANY_CASE = (
    _START + r"(?:please\s+)?(?:buy|sell|hold)(?:\s+(?:now|today|immediately|the\s+dip))?\s*(?:[.!?]|$)",
    _START + r"(?:please\s+|do\s+not\s+)?(?:buy|sell|hold)\b(?!-)[^.!?]{0,60}\b" + _NOUN + r"\b",
    r"\b" + _ACTOR + r"\s+" + _MODAL + r"\s+(?:not\s+)?(?:buy|sell|hold)\b(?!-)",
    r"\b" + _MODAL + r"\s+(?:not\s+)?(?:buy|sell|hold)\b(?!-)[^.!?]{0,60}\b" + _NOUN + r"\b",
    r"\b" + _ADVICE + r"\b[^.!?]{0,60}\b" + _ACTION + r"\b(?!-)[^.!?]{0,40}\b" + _NOUN + r"\b",
    r"\b" + _ADVICE + r"\b[^.!?]{0,40}\b" + _ACTOR + r"\b[^.!?]{0,30}\b(?:buy|sell|hold)\b(?!-)",
    r"\b(?:buy|sell|hold)\s+(?:recommendation|rating|signal)\b",
    r"\b(?:go|stay)\s+(?:long|short)(?:\s+or\s+(?:long|short))?\b",
    _START + r"(?:please\s+)?(?:enter|exit|open|close)(?:\s+or\s+(?:enter|exit|open|close))?\s+(?:(?:a|the|your)\s+)?(?:(?:long|short)\s+)?position\b",
    r"\b" + _MODAL + r"\s+(?:enter|exit|open|close)\s+(?:(?:a|the|your)\s+)?(?:(?:long|short)\s+)?position\b",
    _START + r"(?:please\s+|do\s+not\s+)?(?:place|submit|cancel)(?:(?:,\s*(?:or\s+)?|\s+or\s+)(?:place|submit|cancel))*\s+(?:(?:an?|the|your)\s+)?(?:" + _ORDER + r"\s+)?order\b",
    r"\b" + _MODAL + r"\s+(?:not\s+)?(?:place|submit|cancel)\s+(?:(?:an?|the|your)\s+)?(?:" + _ORDER + r"\s+)?order\b",
    _START + r"(?:please\s+)?(?:use|apply|increase|decrease|reduce)\s+(?:the\s+|your\s+)?leverage\b",
    r"\b(?:recommend(?:s|ed|ing)?|advis(?:e|es|ed|ing))\b[^.!?]{0,40}\b(?:using\s+)?leverage\b",
    _START + r"(?:please\s+)?(?:increase|decrease|reduce|raise|use)(?:\s+or\s+(?:increase|decrease|reduce|raise))?\s+(?:(?:a|the|your)\s+)?(?:larger\s+|smaller\s+)?position[- ]siz(?:e|ing)\b",
    r"\b" + _MODAL + r"\s+(?:increase|decrease|reduce|raise|use)\s+(?:(?:a|the|your)\s+)?(?:larger\s+|smaller\s+)?position[- ]siz(?:e|ing)\b",
    _START + r"(?:please\s+)?(?:increase|decrease|reduce|raise)\s+(?:(?:a|the|your)\s+)?position\b(?:\s+(?:size\b|by\b|to\b))?",
    _START + r"(?:please\s+)?(?:increase|decrease|reduce)\s+(?:(?:the|your)\s+)?exposure\b",
    _START + r"(?:please\s+)?(?:set|use|adopt)\s+(?:(?:a|the|your)\s+)?price[- ]target\b",
    r"\b(?:recommend(?:s|ed|ing)?|suggest(?:s|ed|ing)?)\b[^.!?]{0,40}\bprice[- ]target\b|\b(?:recommended|suggested)\s+price[- ]target\b|\bprice[- ]target\s+(?:recommendation|advice)\b",
    _START + r"the\s+price[- ]target\s+(?:is|should\s+be)\b",
    r"\border[- ]side\b",
    r"\b(?:order|trade|position)\s+quantity\b|\bquantity\s+(?:of|for)\s+(?:(?:the|an?)\s+)?(?:order|trade|position)\b|" + _START
    + r"(?:please\s+)?(?:set|specify|use)\s+(?:(?:the|your)\s+)?(?:(?:order|trade)\s+)?quantity\b",
    _START + r"(?:please\s+)?(?:use|select|choose)\s+(?:(?:a|the|your)\s+)?(?:broker|brokerage)\b|" + _START
    + r"(?:please\s+)?(?:use|select|choose)\s+[^.!?]{1,40}\s+as\s+(?:(?:a|the|your)\s+)?(?:broker|brokerage)\b|" + _START
    + r"(?:please\s+)?(?:route|send)\s+[^.!?]{0,30}\b(?:order|trade)\b",
)
# Patterns in which the ticker symbol must be upper case.
SYMBOL_CASE = (
    _START + r"(?i:(?:please\s+|do\s+not\s+)?(?:buy|sell|hold))\s+" + _SYMBOL,
    r"(?i:\b" + _ADVICE + r"\b[^.!?]{0,60}\b" + _ACTION + r"\b(?!-)[^.!?]{0,20})" + _SYMBOL
    + r"(?=\s*(?:(?i:(?:now|today|immediately)\s*)?[.!?](?:\s|$)|$))",
    _START + r"(?i:(?:please\s+)?(?:do\s+not\s+)?(?:enter|exit|open|close)(?:\s+or\s+(?:enter|exit|open|close))?)\s+" + _SYMBOL
    + r"(?:\s+(?i:position|trade))?(?=\s*(?:(?i:now|today|immediately)\s*)?(?:[.!?](?:\s|$)|$))",
    _START + r"(?i:(?:please\s+)?(?:allocate\s+\d+(?:\.\d+)?%\s+to|take\s+(?:an?\s+)?\d+(?:\.\d+)?%\s+position\s+in)\s+)" + _SYMBOL,
)


# Words without which a pattern cannot match: (words, ignore-case patterns, symbol patterns).
_GATES = (
    ("buy|sell|hold", ANY_CASE[0:7], SYMBOL_CASE[0:2]),
    ("long|short", ANY_CASE[7:8], ()),
    ("position", ANY_CASE[8:10] + ANY_CASE[14:17], ()),
    ("order|trade", ANY_CASE[10:12] + ANY_CASE[21:22], ()),
    ("leverage", ANY_CASE[12:14], ()),
    ("exposure", ANY_CASE[17:18], ()),
    ("price", ANY_CASE[18:21], ()),
    ("quantity", ANY_CASE[22:23], ()),
    ("broker|order|trade", ANY_CASE[23:24], ()),
    ("enter|exit|open|close", (), SYMBOL_CASE[2:3]),
    ("allocate|take", (), SYMBOL_CASE[3:4]),
)


def trading_instruction(c: Column | str) -> Column:
    """TRUE when the text tells someone how to trade; NULL text gives FALSE.

    A group of patterns runs only on texts with one of its words: one cheap pass over most
    texts instead of one per pattern.
    """
    col = F.col(c) if isinstance(c, str) else c
    hit = F.lit(False)
    for words, any_case, symbols in _GATES:
        group = F.lit(False)
        for p in any_case:
            group = group | col.rlike("(?diU)" + p)
        for p in symbols:
            group = group | col.rlike("(?dU)" + p)
        hit = hit | (col.rlike("(?iu)" + words) & group)
    return F.coalesce(hit, F.lit(False))


def validate(df: DataFrame, column: str = "output", *, max_summary: int = 500) -> DataFrame:
    """Adds the parsed answer and ``reason`` (NULL when it is acceptable) for a JSON text column."""
    raw = F.from_json(column, "map<string,string>")
    kinds = F.from_json(column, "confidence string, summary string")
    df = df.withColumns({"_m": raw, "_typed": kinds})
    keys = F.array_sort(F.map_keys("_m"))
    get = lambda k: F.try_element_at("_m", F.lit(k))
    confidence = get("confidence").try_cast("double")
    json_kind = F.regexp_extract(F.col(column), r'"confidence"\s*:\s*("|t|f|\[|\{)', 1)
    text_kind = F.regexp_extract(F.col(column), r'"summary"\s*:\s*(")', 1)
    unknown = (get("event_type") == "UNKNOWN", get("risk_level") == "UNKNOWN", get("urgency") == "UNKNOWN")
    any_unknown, all_unknown = unknown[0] | unknown[1] | unknown[2], unknown[0] & unknown[1] & unknown[2]
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.col("_m").isNull() | no(keys == F.array(*[F.lit(k) for k in sorted(KEYS)])), "SCHEMA_INVALID")
        .when(no(get("status").isin("VALID", "ABSTAINED")), "UNKNOWN_STATUS")
        .when(no(get("event_type").isin(*EVENT_TYPES)) | no(get("risk_level").isin(*RISK_LEVELS)) | no(get("urgency").isin(*URGENCIES)), "UNKNOWN_ENUM")
        .when(get("confidence").isNotNull() & ((json_kind != "") | no(confidence.between(0, 1))), "INVALID_CONFIDENCE")
        .when(no(F.trim(get("summary")) != "") | (text_kind == "") | (F.length(get("summary")) > max_summary), "INVALID_SUMMARY")
        .when(trading_instruction(get("summary")), "TRADING_INSTRUCTION_SUMMARY")
        .when((get("status") == "VALID") & (any_unknown | get("confidence").isNull()), "INCOMPLETE_VALID_CLASSIFICATION")
        .when((get("status") == "ABSTAINED") & (~all_unknown | get("confidence").isNotNull()), "INVALID_ABSTAINED_SHAPE"))
    df = df.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return df.withColumns({
        "status": F.when(ok, get("status")).otherwise("VALIDATION_REJECTED"), "event_type": F.when(ok, get("event_type")).otherwise("UNKNOWN"),
        "risk_level": F.when(ok, get("risk_level")).otherwise("UNKNOWN"), "urgency": F.when(ok, get("urgency")).otherwise("UNKNOWN"),
        "confidence": F.when(ok, confidence), "summary": F.when(ok, F.trim(get("summary")))}).drop("_m", "_typed")


def classify(requests: DataFrame, classifier: Callable[[Column], Column], *, known: DataFrame | None = None,
             fingerprint: str = "fingerprint", order: Sequence[str] = ("requested_at",), max_summary: int = 500) -> DataFrame:
    """Run the caller's classifier (a column function, e.g. a pandas UDF) once per new fingerprint.

    Requests whose fingerprint already has a VALID or ABSTAINED result reuse it, marked
    deduplicated with no provider request.
    """
    first = first_per_key(requests, [fingerprint], list(order))
    if known is not None:
        done = known.filter(F.col("status").isin("VALID", "ABSTAINED"))
        first = first.join(done.select(fingerprint), fingerprint, "left_anti")
    answered = validate(first.withColumn("output", classifier(F.col("input_text"))), max_summary=max_summary)
    cols = ["status", "event_type", "risk_level", "urgency", "confidence", "summary", "reason"]
    results = answered.select(fingerprint, F.struct(*order).alias("_first"), *cols)
    if known is not None:
        results = results.unionByName(done.select(fingerprint, *[c for c in cols if c in known.columns]), allowMissingColumns=True)
    out = requests.join(results, fingerprint)
    reused = F.col("_first").isNull() | (F.struct(*order) != F.col("_first"))
    return out.withColumns({"deduplicated": reused, "provider_request_count": F.when(reused, 0).otherwise(1)}).drop("_first")


def deduplicate(attempts: DataFrame, *, fingerprint: str = "fingerprint", attempt: str = "classification_attempt_id",
                order: Sequence[str] = ("classified_at",)) -> DataFrame:
    """Attempts with the first usable result of their fingerprint; later ones are marked as reuse."""
    usable = F.col("status").isin("VALID", "ABSTAINED")
    first = attempts.filter(usable).groupBy(fingerprint).agg(F.min_by(attempt, F.struct(*order, attempt)).alias("_first"),
                                                           F.min(F.struct(*order, attempt)).alias("_at"))
    out = attempts.join(first, fingerprint, "left")
    reuse = F.coalesce(F.struct(*order, attempt) > F.col("_at"), F.lit(False))
    return out.withColumns({"deduplicated": reuse, "reused_classification_attempt_id": F.when(reuse, F.col("_first"))}).drop("_first", "_at")


def acceptable(profile: dict[str, str]) -> Column:
    """Complete, VALID on both levels, passed validation, and made under the given profile."""
    ok = F.col("classification_complete") & (F.col("status") == "VALID") & (F.col("row_status") == "VALID") & F.col("validation_outcome")
    for c, v in profile.items():
        ok = ok & F.col(c).eqNullSafe(F.lit(v))
    return F.coalesce(ok, F.lit(False))


def agreement_error(fields: Sequence[str]) -> Column:
    """First saved field that disagrees with its ledger row (``row_<field>``)."""
    return F.coalesce(*[F.when(~F.col(f).eqNullSafe(F.col(f"row_{f}")), F.lit(f)) for f in fields])


#: Lineage rules in the order in which they are judged.
LINEAGE_RULES = ("UNKNOWN_LEDGER_ROW", "UNKNOWN_FILING", "ACCESSION", "DOCUMENT_HASH", "SECTION_HASH", "REQUEST_ID", "ATTEMPT_ID", "TICKER",
                 "FILING_METADATA", "CLASSIFICATION_PROFILE_MISMATCH", "NOT_COMPLETE", "NOT_VALID", "NOT_VALIDATED", "MISSING_AVAILABILITY")


def lineage(saved: DataFrame, ledger: DataFrame, manifest: DataFrame, profile: dict[str, str], *, metadata: Sequence[str]) -> DataFrame:
    """Saved classifications with the first lineage rule they break (``broken``, NULL if none), their section identity and reason.

    ``saved``: classification_attempt_id, classification_request_id, accession_number, item_number,
    document_hash, full_section_hash, ticker, status, classification_complete, the profile's fields
    and ``metadata`` fields.  ``ledger``: classification_attempt_id, classification_request_id,
    document_hash, status, validation_outcome, available_at.  ``manifest``: accession_number, ticker,
    document_hash, official_document_identity and ``metadata`` fields.

    One join by attempt and one by accession; comparisons are null-safe, except that a metadata field
    missing from the manifest does not disagree.  ``reason`` is CLASSIFICATION_PROFILE_MISMATCH or
    MISSING_AVAILABILITY for those rules, POLICY_INELIGIBLE for results that are not valid, and MALFORMED for the rest.
    """
    row = ledger.select(F.col("classification_attempt_id").alias("_attempt"), *(F.col(c).alias(f"row_{c}") for c in (
        "classification_request_id", "document_hash", "status", "validation_outcome", "available_at")))
    state = manifest.select(F.col("accession_number").alias("_accession"), *(F.col(c).alias(f"state_{c}") for c in (
        "ticker", "document_hash", "official_document_identity", *metadata)))
    both = saved.join(row, F.col("classification_attempt_id") == F.col("_attempt"), "left").join(state, F.col("accession_number") == F.col("_accession"), "left")

    def differs(a: str, b: str) -> Column:
        return ~F.col(a).eqNullSafe(F.col(b))
    hashed = F.coalesce(F.col("full_section_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    other_metadata = F.lit(False)
    for c in metadata:
        other_metadata = other_metadata | F.coalesce(F.col(f"state_{c}") != F.col(c), F.col(f"state_{c}").isNotNull() & F.col(c).isNull())
    profiled = F.lit(True)
    for c, v in profile.items():
        profiled = profiled & F.col(c).eqNullSafe(F.lit(v))
    checks = (F.col("_attempt").isNull(), F.col("_accession").isNull(), ~F.coalesce(F.col("accession_number").rlike("^[0-9]{18}$"), F.lit(False)),
              differs("document_hash", "row_document_hash") | differs("document_hash", "state_document_hash"), ~hashed,
              differs("classification_request_id", "row_classification_request_id"), F.col("classification_attempt_id").isNull(),
              differs("ticker", "state_ticker"), other_metadata, ~profiled, ~F.coalesce("classification_complete", F.lit(False)),
              ~(F.col("status").eqNullSafe(F.lit("VALID")) & F.col("row_status").eqNullSafe(F.lit("VALID"))),
              ~F.coalesce("row_validation_outcome", F.lit(False)), F.col("row_available_at").isNull())
    broken = F.coalesce(*[F.when(check, F.lit(rule)) for rule, check in zip(LINEAGE_RULES, checks)])
    identity = F.sha2(canonical_json(source=F.lit("sec_edgar"), accession_number=F.col("accession_number"),
                                     official_document_identity=F.col("state_official_document_identity"), document_hash=F.col("document_hash"),
                                     item_number=F.col("item_number"), full_section_hash=F.col("full_section_hash")), 256)
    reason = (F.when(F.col("broken").isin("CLASSIFICATION_PROFILE_MISMATCH", "MISSING_AVAILABILITY"), F.col("broken"))
              .when(F.col("broken").isin("NOT_COMPLETE", "NOT_VALID", "NOT_VALIDATED"), "POLICY_INELIGIBLE")
              .when(F.col("broken").isNotNull(), "MALFORMED"))
    return both.withColumn("broken", broken).withColumns({"reason": reason, "section_identity": F.when(F.col("broken").isNull(), identity)}).select(
        *saved.columns, F.col("row_available_at").alias("available_at"), "broken", "reason", "section_identity")


def attempt_rows(requests: DataFrame, responses: DataFrame, validations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, rejected): request, response and validation must name each other.

    Trace ids must agree where present; rejected rows carry ``linkage_error``.
    """
    req = requests.alias("q")
    res = responses.alias("s")
    val = validations.alias("v")
    both = res.join(req, F.col("q.classification_request_id") == F.col("s.classification_request_id"), "left") \
        .join(val, F.col("v.classification_attempt_id") == F.col("s.classification_attempt_id"), "left")
    traces = F.array_distinct(F.array_compact(F.array("q.trace_id", "s.trace_id", "v.trace_id")))
    error = (F.when(F.col("q.classification_request_id").isNull(), "unknown_request")
             .when(F.col("q.prompt_version") != F.col("s.prompt_version"), "prompt_version")
             .when(F.col("v.classification_request_id") != F.col("s.classification_request_id"), "validation_request")
             .when(F.size(traces) > 1, "trace_id"))
    from_request = [c for c in requests.columns if c not in ("trace_id", "prompt_version", "classification_request_id", "input_text")]
    from_response = [c for c in responses.columns if c not in ("trace_id", *from_request)]
    out = both.select(*[F.col(f"q.{c}") for c in from_request], *[F.col(f"s.{c}") for c in from_response],
                      F.col("v.validation_result_id"), F.col("v.outcome").alias("validation_outcome"),
                      F.to_json("v.reason_codes").alias("validation_reason_codes_json"), F.col("v.validated_at"),
                      F.try_element_at(traces, F.lit(1)).alias("trace_id"), error.alias("linkage_error"))
    return out.filter("linkage_error is null").drop("linkage_error"), out.filter("linkage_error is not null")
