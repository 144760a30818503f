"""Registered queries: filings, classifier results, identifiers, ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import times as tm
from tidemark.functions.numbers import r6
from tidemark.functions.times import micros
from tidemark.operators import classification, filings, quality, summary
from tidemark.plans.market import _cost_sql
from tidemark.plans.registry import query
from tidemark.plans.trading import _RISK_SQL, risk_decisions as _decisions
from tidemark.plans.views import table, view, with_views
from tidemark.session import shared_dir, spread
from tidemark.sinks import ledger
from tidemark.sources import feeds, files

def at() -> Column:
    return F.lit("2024-01-31").cast("timestamp")


# --- filings --------------------------------------------------------------------------------

@query("S6 S7 F6 F7 F14", """with o as (select *, case o_orderkey % 5 when 0 then '8-K' when 1 then '4' when 2 then '4/A' when 3 then '10-Q' else '8-K/A' end as form,
  case when o_orderkey % 7 = 0 then lpad(cast(o_orderkey as varchar), 18, '0') else '0000' || lpad(cast(o_custkey as varchar), 6, '0') || '-24-' || lpad(cast(o_orderkey % 1000000 as varchar), 6, '0') end as acc from orders),
a as (select *, regexp_replace(replace(acc, '-', ''), '^(\\d{10})(\\d{2})(\\d{6})$', '\\1-\\2-\\3') as n from o where form <> '10-Q' and o_orderkey % 13 <> 0 and o_orderdate >= timestamp '1995-06-01')
select o_custkey as custkey, n as accession_number, form as form_type, cast(cast(o_orderdate as date) as varchar) as filing_date,
  'https://www.sec.gov/Archives/edgar/data/' || cast(o_custkey as varchar) || '/' || replace(n, '-', '') || '/d' || cast(o_orderkey as varchar) || '.htm' as filing_url,
  epoch_us(o_orderdate + interval 14 hours) as acceptance_us from a where not (o_orderkey % 11 = 0)
union all select o_custkey, n, form, cast(cast(o_orderdate as date) as varchar), 'https://www.sec.gov/Archives/edgar/data/' || cast(o_custkey as varchar) || '/' || replace(n, '-', '') || '/d' || cast(o_orderkey as varchar) || '.htm', -1 from a where o_orderkey % 11 = 0""")
def filing_rows(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    rows = o.select(
        "o_custkey", F.struct(
            F.expr("case o_orderkey % 5 when 0 then '8-K' when 1 then ' 4 ' when 2 then '4/A' when 3 then '10-Q' else '8-K/A' end").alias("form"),
            F.when(key % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("n/a").alias("filingDate"),
            F.when(key % 7 == 0, F.lpad(key.cast("string"), 18, "0")).otherwise(
                F.concat(F.lit("0000"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("-24-"), F.lpad((key % 1000000).cast("string"), 6, "0"))).alias("accessionNumber"),
            F.concat(F.lit("d"), key.cast("string"), F.lit(".htm")).alias("primaryDocument"),
            F.when(key % 11 != 0, F.date_format(F.col("o_orderdate") + F.expr("interval 14 hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("acceptanceDateTime")).alias("r"))
    # parallel arrays per issuer and order block, as a feed document holds a bounded page
    names = ("form", "filingDate", "accessionNumber", "primaryDocument", "acceptanceDateTime")
    docs = rows.withColumn("page", F.crc32(F.col("r.primaryDocument")) % 8).groupBy("o_custkey", "page").agg(F.collect_list("r").alias("rs"))
    docs = docs.select(F.col("o_custkey").cast("string").alias("cik"), F.struct(F.struct(*[F.col("rs").getField(n).alias(n) for n in names]).alias("recent")).alias("filings"))
    issuers = o.select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker")).distinct()
    good, _ = feeds.filings(docs, issuers, start="1995-06-01", collected_at=at())
    return good.select(F.col("issuer_cik").cast("long").alias("custkey"), "accession_number", "form_type", F.col("filing_date").cast("string").alias("filing_date"), "filing_url",
                       F.coalesce(micros("acceptance_at"), F.lit(-1)).alias("acceptance_us"))


@query("S16", r"""with t as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(?:br|/?p|/?div|/?tr|/?li|/?h[1-6])\b[^>]*>', chr(10), 'g'), '(?is)<[^>]+>', '', 'g') as x from pages),
u as (select page_id, replace(replace(replace(replace(replace(x, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), chr(160), ' ') as x from t)
select page_id, length(x) as characters, sha256(x) as text_hash from u""")
def page_text(spark, sf):
    t = spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", filings.document_text(F.col("html").cast("binary")).alias("x"))
    return t.select("page_id", F.length("x").cast("long").alias("characters"), F.sha2("x", 256).alias("text_hash"))


def eight_k(spark, sf) -> DataFrame:
    """Filing-shaped HTML around every document text."""
    html = F.concat(F.lit("<html><body><div>Item 2.02. Results</div><p>"), F.col("text"), F.lit("</p><DIV>\tITEM  8.01 - Other &amp; more</DIV><p>"),
                    F.col("source"), F.lit("&nbsp;note</p><div>Item 9.01 Exhibits</div><p>list</p><div>Item 2.02: again</div><p>short</p></body></html>"))
    return spread(table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "source", html.alias("html"))


@query("S16 W6 F8 P48", r"""with d as (select doc_id, source, '2.02' as item, 'Item 2.02. Results' || chr(10) || chr(10) || text as body from documents
union all select doc_id, source, '8.01', 'ITEM 8.01 - Other & more' || chr(10) || source || ' note' from documents),
s as (select doc_id, item, trim(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<(?:br|/?p|/?div|/?tr|/?li|/?h[1-6])\b[^>]*>', chr(10), 'g'), '(?is)<[^>]+>', '', 'g'), '\s+', ' ', 'g')) as b from d)
select doc_id, item as item_number, length(b) as full_character_count, sha256(b) as full_section_hash, sha256(substring(b, 1, 120)) as excerpt_hash, length(b) > 120 as input_truncated from s""")
def section_extract(spark, sf):
    docs = eight_k(spark, sf).select("doc_id", filings.document_text("html").alias("text"))
    out = filings.prepare(filings.sections(docs, key=["doc_id"]), 120)
    return out.select("doc_id", "item_number", "full_character_count", "full_section_hash", "excerpt_hash", "input_truncated")


@query("P48 F3", None)
def classification_requests(spark, sf):
    docs = eight_k(spark, sf)
    sec = filings.prepare(filings.sections(docs.select("doc_id", "source", F.sha2("html", 256).alias("document_hash"), filings.document_text("html").alias("text")),
                                           key=["doc_id", "source", "document_hash"]), 2000)
    sec = sec.withColumns({"accession_number": F.lpad(F.col("doc_id").cast("string"), 18, "0"), "ticker": F.col("source"), "filing_url": F.lit("u"),
                           "acceptance_at": at(), "collected_at": at()})
    out = filings.requests(filings.chunks(sec, 2000), prompt_version="p1", max_characters=2000)
    return out.withColumn("fingerprint", filings.request_fingerprint(model="m1", response_schema_version="s1")).select(
        "source_locator", "raw_input_id", "source_document_id", "fingerprint", "rejection")


_FORM4 = """o as (select o_orderkey as k, case when o_orderkey % 6 = 0 then '4/A' else '4' end as form, case when o_orderkey % 12 = 0 then 'X' end as parent, cast(o_orderdate as date) as d from orders),
t as (select *, 0 as ix, case k % 3 when 0 then 'P' when 1 then 'S' else 'A' end as code, k % 1000 + 1 as shares, case when k % 7 <> 0 then k % 90 + 0.5e0 end as price from o
  union all select *, 1, 'S', k % 50 + 1, 10.0e0 from o where k % 2 = 0),
p as (select *, case k % 3 when 2 then 0 else 1 end + case when k % 2 = 0 then 1 else 0 end = 1 as code_p from t)"""


@query("S15 P37 P38 P39", "with " + _FORM4 + """
select k as filing, ix as transaction_index, case code when 'P' then 'SEC_FORM4_PURCHASE' else 'SEC_FORM4_SALE' end as event_type, cast(shares as double) as shares, price as price_per_share,
  shares * price as approximate_value, cast(d as varchar) as transaction_date, case when form = '4' then 'ELIGIBLE' when parent is null then 'AMENDMENT_UNRESOLVED' else 'AMENDMENT_RESOLVED' end as aggregate_eligibility,
  case when ix = 0 and k % 4 = 0 then 'true' when ix = 0 and k % 4 = 1 then 'false' when k % 5 = 1 then 'false' when k % 5 = 0 and code_p then 'true' end as plan_10b5_1, 1 as owner_count from p where code in ('P', 'S')""")
def insider_events(spark, sf):
    k = F.col("o_orderkey")
    tx_xml = lambda code, shares, price, notes: F.concat(
        F.lit("<x:nonDerivativeTransaction><x:securityTitle><x:value>Common</x:value></x:securityTitle><x:transactionDate><x:value>"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("</x:value></x:transactionDate><x:transactionCoding><x:transactionCode>"), code, F.lit("</x:transactionCode>"), notes,
        F.lit("</x:transactionCoding><x:transactionAmounts><x:transactionShares><x:value>"), shares.cast("string"), F.lit("</x:value></x:transactionShares>"),
        F.coalesce(F.concat(F.lit("<x:transactionPricePerShare><x:value>"), price.cast("string"), F.lit("</x:value></x:transactionPricePerShare>")), F.lit("")),
        F.lit("</x:transactionAmounts></x:nonDerivativeTransaction>"))
    first = tx_xml(F.expr("case o_orderkey % 3 when 0 then 'P' when 1 then 'S' else 'A' end"), k % 1000 + 1, F.when(k % 7 != 0, k % 90 + 0.5),
                   F.when(k % 4 == 0, '<x:footnoteId id="F1"/>').when(k % 4 == 1, '<x:footnoteId id="F2"/>').otherwise(""))
    second = F.when(k % 2 == 0, tx_xml(F.lit("S"), k % 50 + 1, F.lit(10.0), F.lit(""))).otherwise("")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><x:ownershipDocument xmlns:x="http://www.example.com/own"><x:issuer><x:issuerCik>77</x:issuerCik><x:issuerTradingSymbol>abc</x:issuerTradingSymbol></x:issuer>'),
        F.lit("<x:reportingOwner><x:reportingOwnerId><x:rptOwnerCik>9</x:rptOwnerCik><x:rptOwnerName>Pat</x:rptOwnerName></x:reportingOwnerId><x:reportingOwnerRelationship><x:isDirector>1</x:isDirector></x:reportingOwnerRelationship></x:reportingOwner>"),
        F.when(k % 5 == 0, "<x:aff10b5One>1</x:aff10b5One>").when(k % 5 == 1, "<x:aff10b5One>false</x:aff10b5One>").otherwise(""),
        F.lit("<x:nonDerivativeTable>"), first, second, F.lit("</x:nonDerivativeTable><x:footnotes><x:footnote id=\"F1\">The sale was made pursuant to a\n Rule 10b5‑1 plan.</x:footnote>"),
        F.lit('<x:footnote id="F2">These shares were not sold under a Rule 10b5-1 plan.</x:footnote></x:footnotes></x:ownershipDocument>'))
    docs = spread(table(spark, sf, "orders").select("o_orderkey", "o_orderdate")).select(
        k.cast("string").alias("accession_number"), F.lit("ABC").alias("ticker"), F.lit("0000000077").alias("issuer_cik"), F.when(k % 6 == 0, "4/A").otherwise("4").alias("form_type"),
        F.when(k % 12 == 0, "X").alias("amendment_of"), F.lit(None).cast("timestamp").alias("acceptance_at"), at().alias("collected_at"), xml.alias("xml"))
    out = filings.insider_events(filings.ownership(docs))
    return out.select(F.col("accession_number").cast("long").alias("filing"), "transaction_index", "event_type", "shares", "price_per_share", "approximate_value",
                      F.col("transaction_date").cast("string").alias("transaction_date"), "aggregate_eligibility",
                      F.col("plan_10b5_1").cast("string").alias("plan_10b5_1"), "owner_count")


# --- classifier -----------------------------------------------------------------------------

_OUT = """case doc_id % 12 when 0 then 'not json' when 1 then '{{"status":"VALID"}}' else '{{"status":"' || case doc_id % 12 when 2 then 'MAYBE' when 3 then 'ABSTAINED' when 4 then 'ABSTAINED' else 'VALID' end || '","event_type":"' ||
  case doc_id % 12 when 3 then 'UNKNOWN' when 5 then 'NEWS' when 10 then 'UNKNOWN' else 'LEGAL' end || '","risk_level":"' || case doc_id % 12 when 3 then 'UNKNOWN' else 'LOW' end || '","urgency":"' ||
  case doc_id % 12 when 3 then 'UNKNOWN' else 'HIGH' end || '","confidence":' || case doc_id % 12 when 3 then 'null' when 6 then '1.5' when 7 then '"0.5"' else '0.25' end || ',"summary":"' ||
  case doc_id % 12 when 8 then '  ' when 9 then 'Investors should buy now.' else 'Quality ' || cast(quality as {s}) || ' noted' end || '"}}' end"""


@query("P35 P36", "with l as (select doc_id, quality, toxic, " + _OUT.format(s="varchar") + """ as output from labels),
r as (select *, case doc_id % 12 when 0 then 'SCHEMA_INVALID' when 1 then 'SCHEMA_INVALID' when 2 then 'UNKNOWN_STATUS' when 4 then 'INVALID_ABSTAINED_SHAPE' when 5 then 'UNKNOWN_ENUM' when 6 then 'INVALID_CONFIDENCE' when 7 then 'INVALID_CONFIDENCE'
  when 8 then 'INVALID_SUMMARY' when 9 then 'TRADING_INSTRUCTION_SUMMARY' when 10 then 'INCOMPLETE_VALID_CLASSIFICATION' end as reason from l)
select doc_id, reason, case when reason is not null then 'VALIDATION_REJECTED' when doc_id % 12 = 3 then 'ABSTAINED' else 'VALID' end as status,
  case when reason is null and doc_id % 12 <> 3 then 'LEGAL' else 'UNKNOWN' end as event_type, case when reason is null and doc_id % 12 <> 3 then 0.25e0 end as confidence,
  case when reason is null then 'Quality ' || cast(quality as varchar) || ' noted' end as summary from r""")
def classifier_validation(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", "quality", F.expr(_OUT.format(s="string")).alias("output"))
    return classification.validate(l).select("doc_id", "reason", "status", "event_type", "confidence", "summary")


_SAID = ("We recommend that clients buy ACME.", "Traders must not sell-off early.", "Go long or short here.", "The outlook is calm.",
         "exit ACME position now.", "Set the order quantity today.")


@query("P36", None)
def trading_instruction(spark, sf):
    said = F.element_at(F.array(*[F.lit(s) for s in _SAID]), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.concat_ws("\n", "text", said).alias("text"))
    return d.select("doc_id", classification.trading_instruction("text").alias("is_instruction"))


_ATT = """a as (select conv_id, turn, 'A' || cast(conv_id as varchar) || '-' || cast(turn as varchar) as att, sha256(text) as fp, conv_id * 100 + turn as seen_at, case when turn % 3 = 0 then 'PROVIDER_FAILED' else 'VALID' end as status from conversations)"""


@query("X8", "with " + _ATT + """, f as (select fp, min(seen_at) as t0, arg_min(att, seen_at) as first_att from a where status = 'VALID' group by 1)
select att as attempt, coalesce(seen_at > t0, false) as deduplicated, case when seen_at > t0 then first_att end as reused from a left join f using (fp)""")
def classification_reuse(spark, sf):
    a = table(spark, sf, "conversations").select(
        F.concat(F.lit("A"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("classification_attempt_id"), F.sha2("text", 256).alias("fingerprint"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("classified_at"), F.when(F.col("turn") % 3 == 0, "PROVIDER_FAILED").otherwise("VALID").alias("status"))
    return classification.deduplicate(a).select(F.col("classification_attempt_id").alias("attempt"), "deduplicated", F.col("reused_classification_attempt_id").alias("reused"))


@query("K3", """with q as (select event_id as id, 'p' || cast(event_id % 2 as varchar) as pv, case when event_id % 5 = 0 then 't' || cast(event_id as varchar) end as tr from events where event_id % 17 <> 0)
select e.event_id as attempt, case when q.id is null then 'unknown_request' when q.pv <> 'p' || cast(e.event_id % 2 as varchar) then 'prompt_version' when e.event_id % 11 = 0 then 'validation_request'
  when q.tr is not null and e.event_id % 3 = 0 then 'trace_id' end as linkage_error, case when q.id is not null and not (e.event_id % 11 = 0) and not (q.tr is not null and e.event_id % 3 = 0) then coalesce(q.tr, case when e.event_id % 3 = 0 then 'z' end) end as trace_id
from events e left join q on q.id = e.event_id""")
def classification_attempts(spark, sf):
    e, i = table(spark, sf, "events").select("event_id"), F.col("event_id")
    q = e.filter(i % 17 != 0).select(i.alias("classification_request_id"), F.concat(F.lit("p"), (i % 2).cast("string")).alias("prompt_version"),
                                     F.when(i % 5 == 0, F.concat(F.lit("t"), i.cast("string"))).alias("trace_id"))
    s = e.select(i.alias("classification_attempt_id"), i.alias("classification_request_id"), F.concat(F.lit("p"), (i % 2).cast("string")).alias("prompt_version"),
                 F.when(i % 3 == 0, "z").alias("trace_id"))
    v = e.select(i.alias("classification_attempt_id"), F.when(i % 11 == 0, i + 1).otherwise(i).alias("classification_request_id"), F.lit("v").alias("validation_result_id"),
                 F.lit(True).alias("outcome"), F.array().cast("array<string>").alias("reason_codes"), at().alias("validated_at"), F.lit(None).cast("string").alias("trace_id"))
    good, bad = classification.attempt_rows(q, s, v)
    cols = ["classification_attempt_id", "trace_id"]
    both = good.select(*cols, F.lit(None).cast("string").alias("linkage_error")).unionByName(bad.select(*cols[:1], F.lit(None).cast("string").alias("trace_id"), "linkage_error"))
    return both.withColumnRenamed("classification_attempt_id", "attempt")


# --- identifiers and formats ------------------------------------------------------------------

@query("F1 F2 F3 F10 F16", with_views("model_signals") + """ select signal_id, 'sig_' || substring(sha256(signal_id || '|' || ticker || '|' || cast(seq as varchar)), 1, 32) as stable,
  'ctx_' || sha256('{"latency":' || cast(cast(latency_ms as bigint) as varchar) || ',"side":"' || signal || '","spread":' || coalesce(cast(case when spread is not null then seq % 7 end as varchar), 'null') || ',"ticker":"' || ticker || '"}') as fingerprint,
  strftime(signal_time, '%Y-%m-%dT%H:%M:%S.%fZ') as iso, signal_id || '_' || ticker as client_id, 'UNKNOWN' as sector from model_signals""")
def fingerprints(spark, sf):
    s = view(spark, sf, "model_signals")
    return s.select(
        "signal_id", tx.stable_id("sig", F.col("signal_id"), F.col("ticker"), F.col("seq")).alias("stable"),
        tx.json_id("ctx", ticker=F.col("ticker"), side=F.col("signal"), latency=F.col("latency_ms").cast("long"),
                   spread=F.when(F.col("spread").isNotNull(), F.col("seq") % 7)).alias("fingerprint"),
        tm.to_utc_iso(F.col("signal_time").cast("timestamp")).alias("iso"),
        tx.client_order_id(F.concat(F.lit(" "), "signal_id", F.lit(" /#"), "ticker", F.lit("--"))).alias("client_id"), tx.sector(F.lit("  ")).alias("sector"))


@query("F11 F13 F14 F15 F18", """with p as (select p_partkey as k, p_retailprice as r from part)
select k, case when k % 10 <> 0 then regexp_replace(cast(cast(k as double) / 8 as varchar), '\\.0$', '') end as quantity, strftime(date '2024-01-01' + cast(k % 28 as int), '%Y-%m-%d') as day,
  epoch_us(timestamp '2024-01-01 05:00:00' + k * interval 1 minute) as filed_us, (k * 60 + 270) // 300 * 300 + 30 as due_seconds, cast(date '2024-01-10' - 6 as varchar) as window_start from p""")
def format_functions(spark, sf):
    k = F.col("p_partkey")
    base = F.lit(1704067200000000)
    return table(spark, sf, "part").select(
        k.alias("k"), tx.quantity_text(F.when(k % 10 != 0, k.cast("double") / 8)).alias("quantity"),
        F.date_format(tm.source_date(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")), "MM/dd/yyyy")), "yyyy-MM-dd").alias("day"),
        micros(tm.filing_timestamp(F.date_format(F.timestamp_micros(base + k * 60_000_000), "yyyyMMddHHmmss"))).alias("filed_us"),
        ((micros(tm.next_bar_due(F.timestamp_micros(base + k * 60_000_000))) - base) / 1_000_000).cast("long").alias("due_seconds"),
        tm.discovery_window(F.lit("2024-01-10 12:00:00").cast("timestamp"), 7)["start"].cast("string").alias("window_start"))


@query("P43", with_views("model_signals") + """ select signal_id, concat_ws(',', case when confidence > 0.9e0 or false then 'confidence' end, case when k % 7 = 0 then 'signal' end) as violations from model_signals
  where confidence > 0.9e0 or k % 7 = 0""")
def contract_checks(spark, sf):
    s = view(spark, sf, "model_signals").select("signal_id", F.col("signal_time").cast("timestamp").alias("signal_time"), "ticker",
                                                F.when(F.col("k") % 7 == 0, "WAIT").otherwise(F.col("signal")).alias("signal"),
                                                F.when(F.col("confidence") > 0.9, F.col("confidence") + 1).otherwise(F.col("confidence")).alias("confidence"))
    _, bad = quality.split(s, quality.contract("model_signal"))
    return bad.select("signal_id", F.array_join(F.reverse(F.array_sort("violations")), ",").alias("v")).select(
        "signal_id", F.array_join(F.array_sort(F.split("v", ",")), ",").alias("violations"))


# --- files and ledger -------------------------------------------------------------------------

@query("S17 A20", None)
def file_inventory(spark, sf):
    inv = files.inventory(files.listing(spark, sf, suffixes=(".parquet",)))
    out = files.inventory_summary(inv.withColumn("schema_hint", F.coalesce("schema_hint", F.col("stem"))))
    return out.select("files", "folders", "total_bytes", F.array_join("schema_hints", ",").alias("schema_hints"))


_SUM = with_views("model_signals", "health_events", "fills") + """, h as (select *, signal as side, midprice as mid, expected_gross_move_bps as move, '5m' as horizon from model_signals where signal in ('BUY', 'SELL')),
c as (with """ + _cost_sql("h", "'MARKET'", "signal_id") + """), d as (select ticker, k % 3 = 0 as approved from model_signals where k % 5 <> 1 union all select ticker, null from model_signals where k % 5 = 1)
select 'table_counts' as section, 'rows' as metric, t as key, cast(n as double) as value from (select 'model_signals' as t, count(*) as n from model_signals union all select 'risk_decisions', count(*) from model_signals
  union all select 'cost_estimates', count(*) from c union all select 'order_events', count(*) from orders union all select 'fill_events', count(*) from fills union all select 'trade_outcomes', count(*) from orders where o_orderkey % 2 = 0 union all select 'system_health_events', count(*) from health_events) x
union all select 'signals', 'signal_count', '', count(*) from model_signals union all select 'signals', 'avg_confidence', '', round(avg(confidence), 6) from model_signals union all select 'signals', 'ticker_count', ticker, count(*) from model_signals group by 3
union all select 'risk_decisions', 'decision_count', '', count(*) from d union all select 'risk_decisions', 'approved_count', '', count(*) from d where approved union all select 'risk_decisions', 'rejected_count', '', count(*) from d where not approved
union all select 'risk_decisions', 'ticker_count', ticker, count(*) from d group by 3
union all select 'costs', 'estimate_count', '', count(*) from c union all select 'costs', 'profitable_count', '', count(*) from c where profitable_after_costs union all select 'costs', 'avg_net_edge_bps', '', round(avg(net_expected_edge_bps), 4) from c
union all select 'execution', 'order_count', '', count(*) from orders union all select 'execution', 'fill_count', '', count(*) from fills union all select 'execution', 'avg_slippage_bps', '', round(avg(discount * 100), 6) from fills
union all select 'outcomes', 'outcome_count', '', count(*) from orders where o_orderkey % 2 = 0 union all select 'outcomes', 'avg_realized_pnl', '', round(avg(o_orderkey % 100), 6) from orders where o_orderkey % 2 = 0
union all select 'outcomes', m, '', case when m = 'avg_return_1m' then 0.5e0 end from (values ('avg_return_1m'), ('avg_return_5m'), ('avg_return_15m')) v(m)
union all select 'health', 'event_count', component || '|' || status, count(*) from health_events group by 3
union all select 'health', 'warning_error_count', '', count(*) from health_events where status in ('warn', 'warning', 'error', 'WARN', 'WARNING', 'ERROR')"""


@query("A1 A2 A3 A4 A5 A6 A7 A8", _SUM)
def ledger_summary(spark, sf):
    from tidemark.operators import cost
    s, o, f = view(spark, sf, "model_signals"), table(spark, sf, "orders"), view(spark, sf, "fills")
    priced = cost.estimate(s.filter(F.col("signal").isin("BUY", "SELL")).withColumns({"side": F.col("signal"), "horizon": F.lit("5m"), "order_style": F.lit("MARKET")}))
    out = summary.ledger({
        "model_signals": s, "risk_decisions": s.select("ticker", F.when(F.col("k") % 5 != 1, F.col("k") % 3 == 0).alias("approved")),
        "cost_estimates": priced.withColumn("net_expected_edge_bps", r6(F.col("net_expected_edge_bps"))), "order_events": o,
        "fill_events": f.withColumn("slippage_bps", F.col("discount") * 100), "system_health_events": view(spark, sf, "health_events"),
        "trade_outcomes": o.filter("o_orderkey % 2 = 0").select((F.col("o_orderkey") % 100).alias("realized_pnl"), F.lit(0.5).alias("return_1m"),
                                                                *[F.lit(None).cast("double").alias(c) for c in ("return_5m", "return_15m")])})
    return out.withColumn("value", F.when(F.col("metric") == "avg_net_edge_bps", F.round("value", 4)).otherwise(F.round("value", 6)))


@query("K1 K2 K5 S18 S19", with_views("model_signals") + """ select 'ledger' as place, cast(cast(signal_time as date) as varchar) as day, count(*) as rows, cast(sum(round(confidence * 100)) as bigint) as confidence_sum from model_signals
  where k % 19 <> 0 and signal_time >= timestamp '2024-01-05' and signal_time <= timestamp '2024-01-20 12:00:00' group by 2
  union all select 'dead_letter', cast(cast(signal_time as date) as varchar), count(*), -1 from model_signals where k % 19 = 0 group by 2""")
def ledger_append(spark, sf):
    root = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    s = view(spark, sf, "model_signals").withColumns({
        "signal_time": F.col("signal_time").cast("timestamp"), "confidence": F.when(F.col("k") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("confidence"))})
    ledger.append(ledger.to_rows(s, "model_signals", run_id="r1"), "model_signals", root, dead_letter_root=f"{root}/dead")
    kept = ledger.read(spark, "model_signals", root, since="2024-01-05", until="2024-01-20 12:00:00")
    lost = feeds.dead_letters(spark, f"{root}/dead")
    return kept.groupBy(F.to_date("signal_time").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("confidence") * 100)).cast("long").alias("confidence_sum")).select(
        F.lit("ledger").alias("place"), "day", "rows", "confidence_sum").unionByName(
        lost.groupBy(F.substring("event_time", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit("dead_letter").alias("place"), "day", "rows", F.lit(-1).cast("long").alias("confidence_sum")))


@query("K6", """with o as (select o_orderkey, o_totalprice from orders where o_orderkey % 2 = 0), n as (select o_orderkey, case when o_orderkey % 14 = 0 then o_totalprice + 1 else o_totalprice end as p from orders)
select n.o_orderkey, case when o.o_orderkey is null then 'append' else 'conflict' end as outcome from n left join o on o.o_orderkey = n.o_orderkey where o.o_orderkey is null or o.o_totalprice <> n.p""")
def archive_write_once(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"))
    # one archive row per key; repeated orders of the input are the same document
    old = o.filter("o_orderkey % 2 = 0").distinct()
    new = o.withColumn("p", F.when(F.col("o_orderkey") % 14 == 0, F.col("p") + 1).otherwise(F.col("p")))
    add, clash = ledger.write_once(old, new, key=["o_orderkey"], payload=["p"])
    return add.select("o_orderkey", F.lit("append").alias("outcome")).unionByName(clash.select("o_orderkey", F.lit("conflict").alias("outcome")))


@query("K10 K2", _RISK_SQL.split("select signal_id, decision, decision in")[0] + "select decision, count(*) as rows, count(distinct signal_id) as logged from d group by 1")
def decision_log(spark, sf):
    d = _decisions(spark, sf).select(F.col("signal_id").alias("risk_decision_id"), F.lit("T").alias("ticker"), "decision", "approved",
                                     F.split("reasons", ",").alias("reasons"), at().alias("decision_time"))
    root = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    result = ledger.log_decisions(d, root)
    stored = ledger.read(spark, "risk_decisions", root).select("risk_decision_id", "decision")
    return stored.join(result.filter("log_succeeded"), "risk_decision_id").groupBy("decision").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("risk_decision_id").alias("logged"))
