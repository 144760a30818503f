import datetime as dt
import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import times as tm
from tidemark.operators import classification as cl
from tidemark.operators import filings, quality
from tidemark.plans import records
from tidemark.sinks import ledger, schemas
from tidemark.sources import feeds, files, market

from conftest import SF_DIR

UTC = dt.timezone.utc


def _one(spark, column, value, schema):
    return spark.createDataFrame([(value,)], f"v {schema}").select(column(F.col("v")).alias("o")).first().o


# --- functions ------------------------------------------------------------------------------

@pytest.mark.parametrize("fn,value,want", [
    (tx.accession, " 000132165526000123 ", "0001321655-26-000123"), (tx.accession, "0001321655-26-000123", "0001321655-26-000123"), (tx.accession, "123", None),
    (tx.document_path, "/a\\b.xml", "a/b.xml"), (tx.document_path, "../x", None), (tx.document_path, "http://x/y", None), (tx.document_path, " ", None),
    (tx.client_order_id, " sig/1##é ", "sig_1"), (tx.client_order_id, "__", None), (tx.clean_text, "a\x00b\nc", "ab c"), (tx.symbol, " xom ", "XOM"),
    (tx.decimal_text, "4.100", "4.1"), (tx.decimal_text, "0.000", "0"), (tx.decimal_text, "1200", "1200"), (tx.decimal_text, "-0.50", "-0.5")])
def test_text(spark, fn, value, want):
    assert _one(spark, fn, value, "string") == want


@pytest.mark.parametrize("value,want", [(1.0, "1"), (0.1, "0.1"), (1.23456789019, "1.23456789"), (0.0, None), (-1.0, None), (float("nan"), None), (1e-10, None), (1500.0, "1500"),
                                        (1e7, "10000000")])
def test_quantity_text(spark, value, want):
    assert _one(spark, tx.quantity_text, value, "double") == want


def test_long_client_ids_keep_a_hash(spark):
    got = _one(spark, tx.client_order_id, "a" * 200, "string")
    assert len(got) == 128 and re.fullmatch(r"a{115}-[0-9a-f]{12}", got)


def test_times(spark):
    assert _one(spark, tm.nanos_to_timestamp, 1_000_000_000_999, "long").timestamp() == dt.datetime(1970, 1, 1, 0, 16, 40, tzinfo=UTC).timestamp()
    micro = spark.createDataFrame([(-1,), (1999,)], "v long").select(F.unix_micros(tm.nanos_to_timestamp("v")).alias("o")).collect()
    assert [r.o for r in micro] == [-1, 1]
    iso = spark.sql("select timestamp'2026-05-18 13:30:00' a, timestamp'2026-05-18 13:30:00.25' b").select(tm.to_utc_iso("a").alias("a"), tm.to_utc_iso("b").alias("b")).first()
    assert (iso.a, iso.b) == ("2026-05-18T13:30:00Z", "2026-05-18T13:30:00.250000Z")
    parse = lambda v, fn: spark.createDataFrame([(v,)], "v string").select(F.unix_seconds(fn("v")).alias("o")).first().o
    at = int(dt.datetime(2026, 7, 12, 14, 15, 30, tzinfo=UTC).timestamp())
    assert parse("20260712101530", tm.filing_timestamp) == at and parse("2026-07-12T10:15:30-04:00", tm.filing_timestamp) == at
    assert parse("2026-07-12T10:15:30", tm.filing_timestamp) is None and parse("nope", tm.parse_utc_iso) is None
    s = lambda h, m, sec: spark.createDataFrame([(dt.datetime(2026, 5, 18, h, m, sec, tzinfo=UTC),)], "v timestamp").select(tm.in_session("v").alias("o")).first().o
    assert s(13, 30, 0) and s(20, 0, 0) and not s(20, 0, 1) and not s(13, 29, 59)
    assert _one(spark, tm.strict_date, "2026-5-18", "string") is None and _one(spark, tm.leading_date, "2026-05-18T00", "string") == dt.date(2026, 5, 18)


def test_canonical_json_sorts_and_keeps_nulls(spark):
    r = spark.range(1).select(tx.canonical_json(b=F.lit(1), a=F.lit(None).cast("string")).alias("j")).first().j
    assert r == '{"a":null,"b":1}'


# --- market scan ----------------------------------------------------------------------------

def test_scan_maps_normalises_and_quarantines(spark, tmp_path):
    rows = [(1_000_000_000_001_999, " XOM ", "trade", "118.42", float("inf")), (None, "XOM", "trade", "x", 1.0), (2_000, "  ", "quote", None, 1.0)]
    p = str(tmp_path / "m")
    spark.createDataFrame(rows, "ts_event long, sym string, kind string, px string, size double").coalesce(1).write.parquet(p)
    m = market.column_mapping(event_time="ts_event", ticker="sym", record_type="kind", price="px", bid_price=None)
    good, bad = market.scan(spark, p, m, strict=False)
    g = good.withColumn("us", F.unix_micros("event_time")).collect()
    assert len(g) == 1 and (g[0].us, g[0].ticker, g[0].price, g[0].size, g[0].bid_price, g[0].source) == (1_000_000_000_001, "XOM", 118.42, None, None, "historical_parquet")
    assert sorted(v for r in bad.collect() for v in r.violations) == ["event_time", "ticker"]
    with pytest.raises(quality.ConstraintError):
        market.scan(spark, p, m)
    with pytest.raises(market.ScanError, match="negative"):
        market.scan(spark, p, m, limit=-1)
    assert market.scan(spark, p, m, limit=0)[0].count() == 0
    assert market.missing_columns(["sym"], m) == ["ts_event", "kind"]
    with pytest.raises(market.ScanError, match="missing required"):
        market.scan(spark, p)
    naive = spark.sql("select timestamp_ntz'2026-01-01 00:00:00' event_time, 'A' ticker, 't' record_type")
    with pytest.raises(market.ScanError, match="no time zone"):
        market.normalise(naive)
    assert market.normalise(naive, naive_zone="America/New_York").select(F.unix_seconds("event_time").alias("o")).first().o == 1767243600
    with pytest.raises(market.ScanError, match="boolean"):
        market.normalise(spark.sql("select timestamp'2026-01-01' event_time, 'A' ticker, 't' record_type, true price"))


def test_scan_reads_mapped_columns_only(spark, tmp_path):
    p = str(tmp_path / "wide")
    spark.range(3).select(F.lit("2026-01-01T00:00:00Z").alias("event_time"), F.lit("A").alias("ticker"), F.lit("t").alias("record_type"), F.col("id").alias("junk")).write.parquet(p)
    plan = market.scan(spark, p, strict=False)[0]._jdf.queryExecution().executedPlan().toString()
    assert "junk" not in plan.split("ReadSchema")[1]


# --- feeds ----------------------------------------------------------------------------------

def test_filing_discovery(spark, tmp_path):
    doc = {"cik": "0001321655", "name": "P", "tickers": ["PLTR"], "filings": {"recent": {
        "form": ["8-K", "4", "4/A", "10-Q", "4"], "filingDate": ["2026-07-12", "2026-07-11", "2026-07-10", "2026-07-09", "2026-01-01"],
        "accessionNumber": ["0001321655-26-000123", "000132165526000124", "bad", "0001321655-26-000126", "0001321655-26-000127"],
        "primaryDocument": ["form8k.htm", "xsl/own.xml", "a.xml", "q.htm"], "acceptanceDateTime": ["20260712101530"]}}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    issuers = spark.createDataFrame([("0001321655", "PLTR")], "cik string, ticker string")
    good, bad = feeds.filings(feeds.read_json(spark, str(tmp_path / "s.json"), feeds.SUBMISSIONS), issuers, start="2026-07-01",
                              collected_at=F.lit("2026-08-01").cast("timestamp"))
    assert sorted((r.form_type, r.accession_number, r.filing_url.rsplit("/data/")[1], r.acceptance_at is None) for r in good.collect()) == [
        ("4", "0001321655-26-000124", "1321655/000132165526000124/xsl/own.xml", True), ("8-K", "0001321655-26-000123", "1321655/000132165526000123/form8k.htm", False)]
    assert [r.form_type for r in bad.collect()] == ["4/A"]


def test_small_json_feeds(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"response":{"data":[{"period":"2026-05-15","series":"W","value":"426485","units":"MBBL"}]}}')
    assert feeds.energy_observations(feeds.read_json(spark, str(tmp_path / "e.json"), feeds.ENERGY)).first().value == "426485"
    (tmp_path / "r.json").write_text('{"observations":[{"date":"2026-05-15","value":"."},{"date":"2026-05-14","value":"4.1"}]}')
    got = feeds.rate_observations(feeds.read_json(spark, str(tmp_path / "r.json"), feeds.RATES), F.lit("DGS2")).collect()
    assert [(r.row_seq, r.value) for r in got] == [(0, "."), (1, "4.1")]
    (tmp_path / "a.json").write_text('{"results":[{"Recipient UEI":" U ","internal_id":"7","Award ID":"A","Award Amount":5.5}]}')
    r = feeds.award_search(feeds.read_json(spark, str(tmp_path / "a.json"), feeds.AWARD_SEARCH)).first()
    assert (r.uei, r.lookup_id, r.award_amount) == ("U", "7", 5.5)
    (tmp_path / "d.json").write_text('{"generated_unique_award_id":"G","type":"A","date_signed":"2026-05-01","period_of_performance":{"last_modified":"2026-05-02"},"recipient":{"recipient_uei":"U"}}')
    r = feeds.award_detail(feeds.read_json(spark, str(tmp_path / "d.json"), feeds.AWARD_DETAIL), F.lit("7")).first()
    assert (r.uei, str(r.business_date), r.detail_last_modified) == ("U", "2026-05-01", "2026-05-02")
    (tmp_path / "f.json").write_text('{"results":[{"federal_account":"x"}],"page_metadata":{"hasNext":true}}')
    assert feeds.award_funding(feeds.read_json(spark, str(tmp_path / "f.json"), feeds.AWARD_FUNDING), F.lit("7")).first().has_next
    (tmp_path / "c.json").write_text('{"filings":{"acc":{"document_hash":"h","classifications":{"k":{"status":"VALID"}}}}}')
    docs = feeds.read_json(spark, str(tmp_path / "c.json"), "filings map<string,struct<document_hash:string,classifications:map<string,struct<status:string>>>>")
    r = feeds.classification_archive(docs).first()
    assert (r.accession_number, r.filing_document_hash, r.classification_key, r.status) == ("acc", "h", "k", "VALID")
    (tmp_path / "cal.json").write_text(json.dumps({"calendar_version": "v", "window_profiles": [{"profile_id": "p", "pre_event_minutes": 5, "post_event_minutes": 9}],
                                                   "event_type_policies": [], "events": [{"logical_occurrence_id": "o", "event_type": "CPI", "scheduled_at": "2026-05-18T12:30:00Z"}]}))
    e, p, _ = feeds.calendar(spark, str(tmp_path / "cal.json"))
    assert e.first().occurrence_id == "o" and p.first().post_minutes == 9


def test_file_inventory(spark, tmp_path):
    for name in ("a/x.mbp-1.dbn.zst", "a/y.dbn", "b/z.trades.dbn", "b/readme.txt"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"12345")
    (tmp_path / "a" / "meta.json").write_text('{"query":{"schema":"ohlcv"}}')
    inv = files.inventory(files.listing(spark, str(tmp_path)), files.sidecars(spark, str(tmp_path)).withColumn("folder", F.regexp_replace("folder", "^file:/+", "file:/")))
    assert {r.name: r.schema_hint for r in inv.collect()} == {"x.mbp-1.dbn.zst": "ohlcv", "y.dbn": "ohlcv", "z.trades.dbn": "trades"}
    s = files.inventory_summary(inv).first()
    assert (s.files, s.folders, s.total_bytes, s.schema_hints) == (3, 2, 15, ["ohlcv", "trades"])


# --- filings --------------------------------------------------------------------------------

def test_sections_longest_wins_and_later_on_ties(spark):
    html = ("<div>Item 2.02 Results</div><p>short</p><div>ITEM 8.01 - Other</div><p>other &amp; more</p><div>item 2.02: Results</div><p>short</p>"
            "<p>Item 9.01 Exhibits</p>x<br>Item 3.99 nothing")
    docs = spark.createDataFrame([(1, html)], "doc int, html string").select("doc", filings.document_text("html").alias("text"))
    got = {r.item_number: (r.section_text, r.item_title) for r in filings.sections(docs, key=["doc"]).collect()}
    assert got == {"2.02": ("item 2.02: Results short", "Results of Operations and Financial Condition"), "8.01": ("ITEM 8.01 - Other other & more", "Other Events")}


def test_document_text_bytes(spark):
    raw = b"<p>a\xff b</p>x&nbsp;y &lt;z&gt; <b>q</b>"
    got = spark.createDataFrame([(bytearray(raw),)], "b binary").select(filings.document_text("b").alias("t")).first().t
    assert got == "\na� b\nx y <z> q"


OWN = """<?xml version="1.0"?><ownershipDocument><issuer><issuerCik><value>1321655</value></issuerCik><issuerTradingSymbol>pltr</issuerTradingSymbol></issuer>
<reportingOwner><reportingOwnerId><rptOwnerCik>1</rptOwnerCik><rptOwnerName>A &amp; B</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>0</isOfficer></reportingOwnerRelationship></reportingOwner>
<reportingOwner><reportingOwnerId><rptOwnerCik>2</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship><isOfficer>1</isOfficer><officerTitle>CEO</officerTitle></reportingOwnerRelationship></reportingOwner>
{flag}<nonDerivativeTable>{tx}</nonDerivativeTable><derivativeTable><derivativeTransaction><transactionCoding><transactionCode>P</transactionCode></transactionCoding></derivativeTransaction></derivativeTable>
<footnotes><footnote id="F1">This transaction was executed pursuant to a Rule 10b5-1 trading plan.</footnote><footnote id="F2">The sale was not made under a 10b5-1 plan.</footnote><footnote id="F3">Nothing.</footnote></footnotes></ownershipDocument>"""


def _own(spark, tx_list, flag="", **kw):
    tx_xml = "".join(f"<nonDerivativeTransaction><transactionCoding><transactionCode>{c}</transactionCode>{''.join(f'<footnoteId id=%s/>' % repr(n).replace(chr(39), chr(34)) for n in notes)}</transactionCoding>"
                     f"<transactionAmounts><transactionShares><value>{s}</value></transactionShares></transactionAmounts></nonDerivativeTransaction>" for c, s, notes in tx_list)
    row = dict(accession_number="a", ticker="PLTR", issuer_cik="0001321655", form_type="4", amendment_of=None, acceptance_at=None,
               collected_at=dt.datetime(2026, 7, 1, tzinfo=UTC), xml=OWN.format(tx=tx_xml, flag=flag))
    row.update(kw)
    return filings.ownership(spark.createDataFrame([tuple(row.values())], "accession_number string, ticker string, issuer_cik string, form_type string, amendment_of string, acceptance_at timestamp, collected_at timestamp, xml string"))


def test_ownership_plan_rules(spark):
    plan = lambda *a, **k: [r.plan_10b5_1 for r in _own(spark, *a, **k).filter("event_type is not null").orderBy("transaction_index").collect()]
    assert plan([("S", 50, ["F1"]), ("P", 1, ["F2"]), ("S", 1, ["F1", "F2"]), ("S", 1, ["F3"])]) == [True, False, None, None]
    on, off = "<aff10b5One>1</aff10b5One>", "<aff10b5One>false</aff10b5One>"
    assert plan([("S", 50, [])], flag=on) == [True] and plan([("S", 50, []), ("P", 1, [])], flag=on) == [None, None] and plan([("S", 1, []), ("S", 2, ["F1"])], flag=off) == [False, True]


def test_ownership_shape(spark):
    t = _own(spark, [("S", 50, []), ("A", "x", [])])
    rows = t.orderBy("transaction_index").collect()
    assert [(r.security_kind, r.transaction_code, r.shares, r.event_type, r.drift, r.owner_count) for r in rows] == [
        ("NON_DERIVATIVE", "S", 50.0, "SEC_FORM4_SALE", False, 2), ("NON_DERIVATIVE", "A", None, None, False, 2), ("DERIVATIVE", "P", None, None, False, 2)]
    assert [(r.owner_name, r.roles, r.officer_title) for r in filings.owners(t).orderBy("owner_index").collect()] == [("A & B", ["DIRECTOR"], None), (None, ["OFFICER"], "CEO")]
    am = _own(spark, [("S", 1, [])], form_type="4/A")
    assert am.first().aggregate_eligibility == "AMENDMENT_UNRESOLVED" and filings.insider_events(am, aggregate=True).count() == 0
    assert _own(spark, [("S", 1, [])], form_type="4/A", amendment_of="z").first().aggregate_eligibility == "AMENDMENT_RESOLVED"
    assert _own(spark, [("S", 1, [])], ticker="XOM").first().drift and _own(spark, [], xml="<broken").first().drift


# --- classifier -----------------------------------------------------------------------------

SAID = [("Investors should buy the stock.", True), ("Please sell now.", True), ("BUY XOM", True), ("buy xom", False), ("We advise holding ACME today.", True), ("The buy-side firm reported.", False),
        ("Company will hold a meeting.", False), ("Go long.", True), ("Close the position.", True), ("exit ACME trade now.", True), ("submit, or cancel the limit order", True),
        ("You must not place an order", True), ("Reduce leverage.", True), ("Set a price target.", True), ("The price target is 5", True), ("order-side", True), ("Trade quantity", True),
        ("Use Foo as broker", True), ("Allocate 5% to XOM", True), ("allocate 5% to xom", False), ("Take a 2.5% position in CVX.", True), ("Increase exposure.", True),
        ("Revenue rose 5% on strong demand.", False), ("Increase position size", True), ("", False), ("Hold", True), ("a buy rating", True)]


def test_trading_instruction_examples_and_plain_regex(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)], "i int, t string")
    got = {r.i: r.o for r in df.select("i", cl.trading_instruction("t").alias("o")).collect()}
    plain = {i: any(re.search(p, t, re.IGNORECASE) for p in cl.ANY_CASE) or any(re.search(p, t) for p in cl.SYMBOL_CASE) for i, (t, _) in enumerate(SAID)}
    assert got == plain == {i: w for i, (_, w) in enumerate(SAID)}


def test_gates_cover_all_patterns():
    gated = [p for _, a, s in cl._GATES for p in (*a, *s)]
    assert sorted(gated) == sorted([*cl.ANY_CASE, *cl.SYMBOL_CASE])


def test_classify_runs_once_per_fingerprint(spark):
    req = spark.createDataFrame([("f1", 1, "x"), ("f1", 2, "x"), ("f2", 3, "y"), ("f3", 4, "z")], "fingerprint string, requested_at int, input_text string")
    known = spark.createDataFrame([("f3", "VALID", "LEGAL")], "fingerprint string, status string, event_type string")
    answer = lambda c: F.concat(F.lit('{"status":"VALID","event_type":"OTHER","risk_level":"LOW","urgency":"LOW","confidence":0.5,"summary":"seen '), c, F.lit('"}'))
    got = {r.requested_at: (r.status, r.event_type, r.deduplicated, r.provider_request_count) for r in cl.classify(req, answer, known=known).collect()}
    assert got == {1: ("VALID", "OTHER", False, 1), 2: ("VALID", "OTHER", True, 0), 3: ("VALID", "OTHER", False, 1), 4: ("VALID", "LEGAL", True, 0)}


# --- ledger ---------------------------------------------------------------------------------

def test_table_shapes():
    want = dict(bot_runs=13, bot_sessions=14, feature_snapshots=12, model_signals=15, cost_estimates=31, context_state_snapshots=16, risk_decisions=17, context_indicator_snapshots=16,
                context_ai_events=40, context_flags=32, context_classification_attempts=44, shadow_context_policy_evaluations=17, order_events=20, fill_events=19, trade_outcomes=22,
                latency_metrics=12, system_health_events=18, ledger_write_errors=16, jsonl_fallback_events=15)
    assert {t: len(schemas.schema(t)) for t in schemas.TABLES} == want


def test_rows_and_append(spark, tmp_path):
    df = spark.createDataFrame([("d1", "A", ["x", "y"], {"rule": "r"}, dt.datetime(2026, 5, 18, tzinfo=UTC), "own")],
                               "risk_decision_id string, ticker string, reasons array<string>, thresholds_used map<string,string>, decision_time timestamp, cost_estimate_id string")
    rows = ledger.to_rows(df, "risk_decisions", run_id="r", overrides={"cost_estimate_id": F.lit(None).cast("string"), "context_snapshot_id": F.lit("c")})
    r = rows.first()
    assert (r.reasons_json, r.thresholds_used_json, r.run_id, r.cost_estimate_id, r.context_snapshot_id, r.schema_version) == ('["x","y"]', '{"rule":"r"}', "r", "own", "c", "contracts_v1")
    ledger.append(rows, "risk_decisions", str(tmp_path))
    assert ledger.read(spark, "risk_decisions", str(tmp_path), since="2026-05-18", until="2026-05-18 12:00:00").count() == 1
    assert ledger.read(spark, "risk_decisions", str(tmp_path), since="2026-05-19").count() == 0
    with pytest.raises(ledger.LedgerError, match="no columns"):
        ledger.append(rows.withColumn("oops", F.lit(1)), "risk_decisions", str(tmp_path))
    with pytest.raises(ledger.LedgerError, match="refused"):
        ledger.append(rows.withColumn("reduce_size_factor", F.lit(float("nan"))), "risk_decisions", str(tmp_path))
    with pytest.raises(KeyError):
        schemas.schema("nope")
    value = ledger.to_rows(spark.createDataFrame([("i", 4.5)], "indicator_name string, value double"), "context_indicator_snapshots").first()
    assert value.value_json == "4.5"


def test_failed_log_marks_rows(spark, tmp_path):
    df = spark.createDataFrame([("d1",)], "risk_decision_id string")            # no decision time: refused
    r = ledger.log_decisions(df, str(tmp_path)).first()
    assert not r.log_succeeded and "decision_time" in r.log_error
    with pytest.raises(ledger.LedgerError):
        ledger.log_decisions(df, str(tmp_path), strict=True)


def test_contract_rules(spark):
    df = spark.createDataFrame([("A", "REDUCE_SIZE", True, 0.5, ["r"]), ("A", "APPROVE", True, 0.5, ["r"]), ("A", "REDUCE_SIZE", True, None, ["r"]), (" ", "WHAT", None, None, [])],
                               "ticker string, decision string, approved boolean, reduce_size_factor double, reasons array<string>").withColumn("decision_time", F.current_timestamp())
    got = [sorted(r.violations) for r in quality.check(df, quality.contract("risk_decision")).collect()]
    assert got == [[], ["size_factor"], ["size_factor"], ["approved", "decision", "reasons", "ticker"]]


def test_replayed_batches_are_written_once(spark, tmp_path):
    root, dead = str(tmp_path / "ledger"), str(tmp_path / "dead")
    write = ledger.stream_writer("latency_metrics", root, dead)
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 2), "m1", 1.0), (dt.datetime(2024, 1, 3), "m2", float("nan"))], "measured_time timestamp, latency_metric_id string, latency_ms double")
    for epoch in (0, 1, 1):
        write(rows, epoch)
    assert [r.latency_metric_id for r in ledger.read(spark, "latency_metrics", root).collect()] == ["m1", "m1"]
    assert spark.read.json(dead).count() == 2


def test_requests_hold_the_whole_section(spark):
    texts = {"a": "x" * 25, "b": "é😀\n" * 10, "c": "short", "d": "0123456789" * 3}
    rows = spark.createDataFrame([(k, "2.02", "t", v) for k, v in texts.items()], "accession_number string, item_number string, item_title string, section_text string")
    rows = rows.selectExpr("*", "'h' as document_hash", "'T' as ticker", "'u' as filing_url", "timestamp'2026-01-01' as acceptance_at",
                           "timestamp'2026-01-01' as collected_at", "'o' as official_document_identity")
    chunked = filings.chunks(filings.prepare(rows, 10), 10)
    out = filings.requests(chunked, prompt_version="p1", max_characters=10)
    got = out.withColumn("f", filings.request_fingerprint(model="m", response_schema_version="s")).collect()
    for k, v in texts.items():
        mine = sorted((r for r in got if r.source_locator.startswith(k)), key=lambda r: r.chunk_number)
        assert [r.input_text for r in mine] == [v[i:i + 10] for i in range(0, len(v), 10)]
        assert [r.source_locator for r in mine] == [f"{k}:2.02:{i}" for i in range(len(mine))]
        assert len({r.source_document_id for r in mine}) == 1 and {r.excerpt for r in mine} == {v[:10]}
    assert len({r.raw_input_id for r in got}) == len({r.f for r in got}) == len(got) == 10 and all(r.rejection is None for r in got)
    keys = chunked.select(filings.persistent_key(prompt_version="p", model_version="m", response_schema_version="s", config_hash="c", extraction_version="e").alias("k"))
    assert keys.distinct().count() == len(got)
    assert [r.input_text for r in filings.requests(filings.chunks(filings.prepare(rows.limit(1).withColumn("section_text", F.lit("")), 10), 10), prompt_version="p1").collect()] == [""]


def test_classification_requests_cover_every_character(spark):
    sections = records.section_extract(spark, SF_DIR).select("full_character_count").collect()
    assert max(r[0] for r in sections) > 2000
    assert records.classification_requests(spark, SF_DIR).count() == sum(-(-r[0] // 2000) for r in sections)


def test_narrow_rows_are_spread_by_number(spark):
    """Rows of a few bytes with long work each are not merged into one task."""
    from tidemark.session import spread

    seen = spread(spark.range(0, 4000, 1, 1)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(seen) >= spark.sparkContext.defaultParallelism and max(r[1] for r in seen) <= 2 * 4000 / len(seen)


def test_ownership_documents_keep_the_text_or_value_rule():
    xml = ("<o><reportingOwner><rptOwnerCik> <value> </value><value> 3 </value></rptOwnerCik><rptOwnerCik>4</rptOwnerCik></reportingOwner><reportingOwner/>"
           "<derivativeTransaction><transactionCode><b><value>S</value></b></transactionCode><footnoteId id=' z '/></derivativeTransaction>"
           "<nonDerivativeTransaction/><footnote>a<b>c</b>d</footnote><issuerCik> </issuerCik><issuerCik>9</issuerCik></o>")
    odd, broken, none = filings._read_all(pa.array([xml, "<a", None])).to_pylist()
    assert broken == none and not any(broken.values())
    assert odd["issuer_cik"] == "9" and [o["rptOwnerCik"] for o in odd["owners"]] == ["3", None] and odd["notes"] == [{"id": "", "text": "a c d"}]
    assert [(t["kind"], t["transactionCode"], t["notes"]) for t in odd["transactions"]] == [("NON_DERIVATIVE", None, []), ("DERIVATIVE", "S", ["z"])]
