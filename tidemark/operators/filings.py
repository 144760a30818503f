"""Filings: document text, item sections, ownership documents, insider events."""

from __future__ import annotations

import html
import xml.etree.ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import accession, canonical_json, finite
from tidemark.functions.times import leading_date

# Item numbers that are classified, with their titles.
ITEMS = {
    "1.01": "Entry into a Material Definitive Agreement",
    "1.02": "Termination of a Material Definitive Agreement",
    "1.03": "Bankruptcy or Receivership",
    "1.05": "Material Cybersecurity Incidents",
    "2.01": "Completion of Acquisition or Disposition of Assets",
    "2.02": "Results of Operations and Financial Condition",
    "2.03": "Creation of a Direct Financial Obligation",
    "2.04": "Triggering Events That Accelerate Financial Obligations",
    "2.05": "Costs Associated with Exit or Disposal Activities",
    "2.06": "Material Impairments",
    "3.01": "Delisting or Failure to Satisfy Listing Rule",
    "4.01": "Changes in Registrant's Certifying Accountant",
    "4.02": "Non-Reliance on Previously Issued Financial Statements",
    "5.01": "Changes in Control of Registrant",
    "5.02": "Departure of Directors or Certain Officers",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
}
# Patterns of the document clean-up, the item heading and the plan footnotes.
BLOCK_TAG = r"(?is)<(?:br|/?p|/?div|/?tr|/?li|/?h[1-6])\b[^>]*>"
ANY_TAG = r"(?is)<[^>]+>"
ITEM_HEADING = r"(?imd)^[ \t]*item[ \t]+([1-8]\.\d{2}|9\.01)[ \t]*[.:-]?[ \t]*(.*)$"
PLAN_TRUE = (r"\b(?:transactions?|sales?|purchases?|shares?)\b.{0,60}\b(?:made|executed|effected|purchased|sold)\b"
             r".{0,50}\b(?:pursuant\s+to|under|according\s+to|in\s+accordance\s+with)\b.{0,160}\b(?:rule\s+)?10b5\s*-\s*1\b")
PLAN_FALSE = (r"\b(?:transactions?|sales?|purchases?|shares?)\b.{0,60}\b(?:was|were|is|are)\s+not\s+"
              r"(?:(?:made|executed|effected|purchased|sold)\s+)?(?:pursuant\s+to|under|according\s+to|in\s+accordance\s+with)\b"
              r".{0,160}\b(?:rule\s+)?10b5\s*-\s*1\b")

_CUT = "\x02"


def _unescape(text: pd.Series) -> pd.Series:
    has = text.str.contains("&", regex=False, na=False)
    out = text.copy()
    out[has] = text[has].map(html.unescape)
    return out


def unescape(c: Column) -> Column:
    """HTML entities (the built-in functions have no entity table); rows without ``&`` pass through."""
    return F.pandas_udf(_unescape, "string").asNondeterministic()(c)


def document_text(c: Column | str) -> Column:
    """Readable text of an HTML string or its UTF-8 bytes (bad bytes are replaced)."""
    col = F.col(c) if isinstance(c, str) else c
    text = F.make_valid_utf8(col.cast("string"))
    plain = F.regexp_replace(F.regexp_replace(text, BLOCK_TAG, "\n"), ANY_TAG, "")
    return F.translate(unescape(plain), "\u00a0", " ")


def squeeze(c: Column) -> Column:
    """Whitespace runs (any Unicode space) to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def sections(docs: DataFrame, *, key: list[str], text: str = "text") -> DataFrame:
    """Relevant item sections: the longest per document and item, the later one on equal length.

    A mark is put before every heading and the text is split there, so a section runs to the
    next heading of any item.  Output: key, item_number, item_title, section_text, position.
    """
    marked = F.regexp_replace(F.translate(F.col(text), _CUT, ""), ITEM_HEADING, _CUT + "$0")
    pieces = docs.select(*key, F.posexplode(F.split(marked, _CUT)).alias("position", "_piece")).filter("position > 0")
    titles = F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv])
    rows = pieces.withColumn("item_number", F.regexp_extract("_piece", ITEM_HEADING, 1)).withColumns({
        "item_title": F.try_element_at(titles, F.col("item_number")), "section_text": squeeze(F.col("_piece"))})
    rows = rows.filter(F.col("item_title").isNotNull() & (F.col("section_text") != ""))
    best = rows.groupBy(*key, "item_number").agg(F.max_by(
        F.struct("item_title", "section_text", "position"), F.struct(F.length("section_text"), F.col("position"))).alias("_s"))
    return best.select(*key, "item_number", "_s.*")


def prepare(rows: DataFrame, max_characters: int) -> DataFrame:
    """Adds the excerpt, both hashes, both lengths and the truncation flag."""
    if max_characters <= 0:
        raise ValueError("max_characters must be positive")
    excerpt = F.substring("section_text", 1, max_characters)
    return rows.withColumns({
        "full_character_count": F.length("section_text").cast("long"), "full_section_hash": F.sha2("section_text", 256),
        "excerpt": excerpt, "excerpt_character_count": F.length(excerpt).cast("long"), "excerpt_hash": F.sha2(excerpt, 256),
        "input_truncated": F.length("section_text") > max_characters})


def _hash(*names: str) -> Column:
    return F.sha2(canonical_json(**{n: F.col(n) for n in names}), 256)


def chunks(prepared: DataFrame, max_characters: int) -> DataFrame:
    """One row per piece of at most ``max_characters`` of a section: chunk_number from 0, chunk and chunk_hash.

    The pieces of a section in order are its whole text; the section's own columns stay.
    """
    if max_characters <= 0:
        raise ValueError("max_characters must be positive")
    pieces = F.regexp_extract_all("section_text", F.lit(f"(?s).{{1,{max_characters}}}"), F.lit(0))
    rows = prepared.select("*", F.posexplode_outer(pieces).alias("chunk_number", "chunk"))
    text = F.coalesce("chunk", "section_text")  # an empty section is one empty piece
    return rows.withColumns({"chunk_number": F.coalesce("chunk_number", F.lit(0)), "chunk": text, "chunk_hash": F.sha2(text, 256)})


def requests(chunked: DataFrame, *, prompt_version: str, expected_prompt_version: str | None = None, max_characters: int | None = None) -> DataFrame:
    """Classification request rows, one per row of ``chunks``; ``rejection`` names a failed pre-check.

    Needs the filing columns accession_number, document_hash, ticker, filing_url, acceptance_at, collected_at.
    """
    reject = F.lit(None).cast("string")
    if expected_prompt_version is not None and expected_prompt_version != prompt_version:
        reject = F.lit("PROMPT_VERSION_MISMATCH")
    elif max_characters is not None:
        reject = F.when(F.length("chunk") > max_characters, "INPUT_TOO_LONG")
    source = ["accession_number", "document_hash", "item_number", "full_section_hash"]
    return chunked.select(
        F.concat_ws(":", "accession_number", "item_number", F.col("chunk_number").cast("string")).alias("source_locator"),
        F.concat(F.lit("raw_input_sec_"), F.substring(_hash(*source, "chunk_number", "chunk_hash"), 1, 32)).alias("raw_input_id"),
        F.concat(F.lit("source_document_sec_"), F.substring(_hash(*source), 1, 32)).alias("source_document_id"),
        F.lit("sec_8k_item").alias("source_type"), F.lit("sec_edgar").alias("source_platform"), F.col("filing_url").alias("source_uri"),
        F.col("chunk_hash").alias("raw_input_hash"), "chunk_number", "document_hash", F.array("ticker").alias("affected_tickers"),
        F.col("chunk").alias("input_text"), "excerpt", F.lit(prompt_version).alias("prompt_version"),
        F.col("acceptance_at").alias("source_published_at"), "collected_at", F.col("collected_at").alias("normalized_at"), reject.alias("rejection"))


def persistent_key(*, prompt_version: str, model_version: str, response_schema_version: str, config_hash: str, extraction_version: str) -> Column:
    """Key under which a classification result is kept; equal inputs reuse it."""
    fixed = dict(prompt_version=prompt_version, model_version=model_version, response_schema_version=response_schema_version,
                 classification_config_hash=config_hash, extraction_version=extraction_version)
    columns = ("accession_number", "official_document_identity", "item_number", "full_section_hash", "chunk_number", "chunk_hash")
    return F.sha2(canonical_json(**{c: F.col(c) for c in columns}, **{k: F.lit(v) for k, v in fixed.items()}), 256)


def request_fingerprint(*, model: str, response_schema_version: str, sector_hints: tuple[str, ...] = (), render_config_hash: str | None = None) -> Column:
    """In-run fingerprint of a request; never contains its text."""
    columns = ("raw_input_hash", "chunk_number", "document_hash", "source_document_id", "source_type", "prompt_version")
    return F.sha2(canonical_json(
        **{c: F.col(c) for c in columns}, affected_tickers=F.array_sort("affected_tickers"), model=F.lit(model),
        response_schema_version=F.lit(response_schema_version), sector_hints=F.array(*[F.lit(s) for s in sorted(sector_hints)]).cast("array<string>"),
        render_config_hash=F.lit(render_config_hash).cast("string")), 256)


def section_identity() -> tuple[Column, Column]:
    """(identity hash, error): the three document hashes must agree first."""
    agree = (F.col("document_hash").eqNullSafe(F.col("state_document_hash"))) & (F.col("document_hash").eqNullSafe(F.col("row_document_hash")))
    value = F.sha2(canonical_json(source=F.lit("sec_edgar"), **{c: F.col(c) for c in (
        "accession_number", "official_document_identity", "document_hash", "item_number", "full_section_hash")}), 256)
    error = F.when(~agree, "document_hash_disagrees").when(
        ~F.coalesce(F.col("full_section_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalid_section_hash")
    return F.when(error.isNull(), value), error


def in_window(start: Column, end: Column) -> Column:
    """Acceptance time inside [start, end]; else the filing date inside its date bounds; unparsable keeps the row."""
    day = leading_date(F.col("filing_date").cast("string"))
    return (F.when(F.col("acceptance_at").isNotNull(), F.col("acceptance_at").between(start, end))
            .when(day.isNotNull(), day.between(F.to_date(start), F.to_date(end))).otherwise(F.lit(True)))


def metadata_conflicts(manifest: DataFrame, metadata: DataFrame, fields: list[str], key: str = "accession_number") -> DataFrame:
    """(key, field) where both sides are present and differ."""
    both = manifest.alias("a").join(metadata.alias("b"), key)
    bad = F.array_compact(F.array(*[F.when(F.col(f"a.{f}") != F.col(f"b.{f}"), F.lit(f)) for f in fields]))
    return both.select(key, F.explode(bad).alias("field"))


def lineage_errors(events: DataFrame, filings: DataFrame) -> DataFrame:
    """Insider events whose accession, ticker, issuer or amendment fields disagree with their filing."""
    f = filings.select(F.col("accession_number"), F.col("ticker").alias("_t"), F.col("issuer_cik").alias("_c"), F.col("form_type").alias("_f"))
    both = events.join(f, "accession_number", "left")
    error = (F.when(F.col("_t").isNull(), "unknown_accession").when(~F.col("issuer_ticker").eqNullSafe(F.col("_t")), "ticker")
             .when(~F.col("issuer_cik").eqNullSafe(F.col("_c")), "issuer_cik").when(F.col("is_amendment") != (F.col("_f") == "4/A"), "is_amendment"))
    return both.withColumn("malformed", error).drop("_t", "_c", "_f").filter(F.col("malformed").isNotNull())


# --- ownership documents ------------------------------------------------------------------

# Elements read from one transaction.
_TEXTS = ("transactionCode", "securityTitle", "transactionDate", "transactionShares", "transactionPricePerShare",
          "transactionAcquiredDisposedCode", "directOrIndirectOwnership", "sharesOwnedFollowingTransaction", "conversionOrExercisePrice",
          "expirationDate", "underlyingSecurityTitle", "underlyingSecurityShares", "tradingPlan10b5")
_OWNER_TEXTS = ("rptOwnerCik", "rptOwnerName", "isDirector", "isOfficer", "isTenPercentOwner", "isOther", "officerTitle", "otherText")


def _fields(names) -> str:
    return ", ".join(f"{n}: string" for n in names)


_PARSED = (f"issuer_ticker string, issuer_cik string, plan string, owners array<struct<{_fields(_OWNER_TEXTS)}>>, "
           f"transactions array<struct<kind: string, notes: array<string>, {_fields(_TEXTS)}>>, notes array<struct<id: string, text: string>>")


def _strings(*names) -> list:
    return [(n, pa.string()) for n in names]


#: The same as an Arrow type: the structures reach Spark without a way through pandas.
_ARROW = pa.struct([*_strings("issuer_ticker", "issuer_cik", "plan"), ("owners", pa.list_(pa.struct(_strings(*_OWNER_TEXTS)))),
                    ("transactions", pa.list_(pa.struct([("kind", pa.string()), ("notes", pa.list_(pa.string())), *_strings(*_TEXTS)]))),
                    ("notes", pa.list_(pa.struct(_strings("id", "text"))))])


class _Locals(dict):
    """Tag -> name without its namespace."""

    def __missing__(self, tag: str) -> str:
        if len(self) > 10_000:
            self.clear()
        name = self[tag] = tag.rsplit("}", 1)[-1]
        return name


_LOCAL = _Locals()


def _every(element) -> list[tuple]:
    """(name, element) of ``element`` and all below it, in document order."""
    return [(_LOCAL[e.tag], e) for e in element.iter()]


def _texts(every: list[tuple], names) -> dict:
    """First non-blank text per wanted name among the elements, own or in a ``value`` child."""
    found: dict = dict.fromkeys(names)
    for name, e in every:
        if name in found and found[name] is None:
            text = (e.text or "").strip()
            if not text and len(e):
                inner = (v.text for v in e.iter() if v is not e and _LOCAL[v.tag] == "value")
                text = next((t.strip() for t in inner if t and t.strip()), None)
            found[name] = text or None
    return found


def _read_ownership(xml: str) -> dict:
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, TypeError):
        return {}
    every = _every(root)
    head = _texts(every, ("issuerTradingSymbol", "issuerCik", "aff10b5One"))
    transactions = []
    for kind, wanted in (("NON_DERIVATIVE", "nonDerivativeTransaction"), ("DERIVATIVE", "derivativeTransaction")):
        for name, e in every:
            if name == wanted:
                below = _every(e)
                transactions.append({"kind": kind, "notes": [(f.get("id") or "").strip() for n, f in below if n == "footnoteId"], **_texts(below, _TEXTS)})
    return {
        "issuer_ticker": head["issuerTradingSymbol"], "issuer_cik": head["issuerCik"], "plan": head["aff10b5One"],
        "owners": [_texts(_every(e), _OWNER_TEXTS) for e in root if _LOCAL[e.tag] == "reportingOwner"], "transactions": transactions,
        "notes": [{"id": (e.get("id") or "").strip(), "text": " ".join(e.itertext())} for name, e in every if name == "footnote"]}


def _read_all(xml: pa.Array) -> pa.Array:
    return pa.array([_read_ownership(x) for x in xml.to_pylist()], _ARROW)


def parse_ownership(c: Column | str) -> Column:
    """Structure of an ownership document (namespaces ignored); malformed XML gives NULLs.

    Only the reading of the XML is Python: a chain of regular expressions or a schema read per
    field costs several times more and cannot follow the either-text-or-value rule.
    """
    # marked non-deterministic so that a filter on its result does not run it a second time
    return F.arrow_udf(_read_all, _PARSED).asNondeterministic()(c)


def _flag(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("1", "true"), F.lit(True)).when(t.isin("0", "false"), F.lit(False))


def footnote_plan(c: Column) -> Column:
    """TRUE/FALSE when a footnote says the trade was (not) under a trading plan, else NULL."""
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "[\u2010-\u2015\u2212]", "-"), r"(?U)\s+", " ")))
    return F.when(t.rlike("(?dU)" + PLAN_FALSE), F.lit(False)).when(t.rlike("(?dU)" + PLAN_TRUE), F.lit(True))


def ownership(docs: DataFrame, *, xml: str = "xml") -> DataFrame:
    """One row per transaction of ownership documents joined to their filing columns.

    Needs accession_number, ticker, issuer_cik, form_type, amendment_of, acceptance_at, collected_at.
    ``drift`` marks documents whose issuer is not the filing's issuer, or that cannot be read.
    """
    x = docs.withColumn("_d", parse_ownership(xml))
    notes = F.transform("_d.notes", lambda n: F.struct(n["id"].alias("id"), footnote_plan(n["text"]).alias("plan")))
    promoted = F.size(F.filter("_d.transactions", lambda t: (t["kind"] == "NON_DERIVATIVE") & t["transactionCode"].isin("P", "S")))
    x = x.withColumns({
        "issuer_ticker": F.coalesce("_d.issuer_ticker", "ticker"), "document_cik": F.lpad(F.coalesce("_d.issuer_cik", "issuer_cik"), 10, "0"),
        "filing_plan": _flag(F.col("_d.plan")), "_promoted": promoted, "_plans": notes, "owners": F.col("_d.owners"),
        "_readable": F.col("_d.transactions").isNotNull()})
    rows = x.select("*", F.posexplode_outer("_d.transactions").alias("transaction_index", "_t"))
    t = F.col("_t")

    def number(name):
        return finite(t[name].try_cast("double"))

    shares, price, code = number("transactionShares"), number("transactionPricePerShare"), t["transactionCode"]
    event = F.when(t["kind"] == "NON_DERIVATIVE", F.when(code == "P", "SEC_FORM4_PURCHASE").when(code == "S", "SEC_FORM4_SALE"))
    # a repeated footnote id keeps its first text
    first_note = lambda r: F.try_element_at(F.filter("_plans", lambda n: (n["id"] == r) & (r != "")), F.lit(1))["plan"]
    noted = F.array_distinct(F.array_compact(F.transform(t["notes"], first_note)))
    fallback = F.when(F.col("filing_plan") == F.lit(False), F.lit(False)).when(
        F.col("filing_plan") & event.isNotNull() & (F.col("_promoted") == 1), F.lit(True))
    rows = rows.withColumn("_noted", noted)
    plan = F.coalesce(_flag(t["tradingPlan10b5"]), F.when(F.size("_noted") == 1, F.try_element_at("_noted", F.lit(1))), fallback)
    amendment = F.col("form_type") == "4/A"
    drift = ~F.col("_readable") | (F.upper("issuer_ticker") != F.col("ticker")) | (F.col("document_cik") != F.col("issuer_cik"))
    return rows.select(
        "accession_number", "ticker", "issuer_cik", "form_type", "issuer_ticker", drift.alias("drift"), "filing_plan", "owners",
        F.size("owners").alias("owner_count"), "transaction_index", t["kind"].alias("security_kind"), code.alias("transaction_code"),
        t["securityTitle"].alias("security_title"), leading_date(t["transactionDate"]).alias("transaction_date"), shares.alias("shares"),
        price.alias("price_per_share"), (shares * price).alias("approximate_value"),
        t["transactionAcquiredDisposedCode"].alias("acquired_disposed_code"), t["directOrIndirectOwnership"].alias("direct_or_indirect"),
        number("sharesOwnedFollowingTransaction").alias("shares_owned_following"), number("conversionOrExercisePrice").alias("exercise_price"),
        leading_date(t["expirationDate"]).alias("expiration_date"), t["underlyingSecurityTitle"].alias("underlying_security_title"),
        number("underlyingSecurityShares").alias("underlying_shares"), plan.alias("plan_10b5_1"), event.alias("event_type"),
        amendment.alias("is_amendment"), F.col("amendment_of").alias("amends_accession"),
        F.when(~amendment, "ELIGIBLE").when(F.col("amendment_of").isNull(), "AMENDMENT_UNRESOLVED").otherwise("AMENDMENT_RESOLVED").alias("aggregate_eligibility"),
        F.coalesce("acceptance_at", "collected_at").alias("available_at"))


def owners(transactions: DataFrame) -> DataFrame:
    """One row per filing and reporting owner with its roles."""
    one = transactions.filter(F.coalesce("transaction_index", F.lit(0)) == 0)
    rows = one.select("accession_number", F.posexplode("owners").alias("owner_index", "o"))
    roles = [("isDirector", "DIRECTOR"), ("isOfficer", "OFFICER"), ("isTenPercentOwner", "TEN_PERCENT_OWNER"), ("isOther", "OTHER")]
    return rows.select("accession_number", "owner_index", F.col("o.rptOwnerCik").alias("owner_cik"), F.col("o.rptOwnerName").alias("owner_name"),
                       F.array_compact(F.array(*[F.when(F.col(f"o.{f}") == "1", F.lit(r)) for f, r in roles])).alias("roles"),
                       F.col("o.officerTitle").alias("officer_title"), F.col("o.otherText").alias("other_relationship_text"))


def insider_events(transactions: DataFrame, *, aggregate: bool = False) -> DataFrame:
    """Promoted purchases and sales; ``aggregate`` keeps only rows that may be summed."""
    out = transactions.filter(F.col("event_type").isNotNull() & ~F.col("drift"))
    return out.filter(F.col("aggregate_eligibility") == "ELIGIBLE") if aggregate else out


def counters(status_rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    return status_rows.agg(*[F.count_if(F.col(column) == v).alias(v.lower()) for v in values])


__all__ = ["ITEMS", "accession", "chunks", "counters", "document_text", "in_window", "insider_events", "lineage_errors", "metadata_conflicts", "owners",
           "ownership", "persistent_key", "prepare", "request_fingerprint", "requests", "section_identity", "sections", "squeeze", "unescape"]
