"""Content-defined chunks against a plain version."""

from collections import defaultdict

from conftest import SF_DIR
from tidemark.llm import substring_dedup as sd
from tidemark.llm.kernels import byte_values
from tidemark.llm.queries import op10_substring_dedup

GEAR = [int(v) >> 32 for v in byte_values(5)]


def plain_chunks(text):
    """(start, end, chunk) in characters."""
    data, h, raw = b"\0" * 32 + text.encode(), 0, []
    values = []
    for b in data:
        h = ((h << 1) + GEAR[b]) & 0xFFFFFFFF
        values.append(h)
    raw = [values[i + 32] >> (32 - sd.BITS) == 0 for i in range(len(data) - 32)]
    data = data[32:]
    cuts = [i + 1 for i in range(len(data) - 1)
            if raw[i] and not any(raw[max(0, i - sd.LEAST + 1):i]) and (data[i + 1] & 0xC0) != 0x80]
    edges = [0, *cuts, len(data)] if data else []
    parts = [data[a:b].decode() for a, b in zip(edges, edges[1:])]
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p), p))
        at += len(p)
    return out


def plain_spans(rows, min_chars):
    places = []
    for d, t in set(rows):
        places += [(d is not None, d or 0, t or "", s, e, c) for s, e, c in plain_chunks(t or "")]
    return places


def removed(rows, min_chars=sd.MIN_CHARS):
    """Passages by (doc_id, text): every chunk but the first of its digest, runs joined."""
    first, out = {}, defaultdict(list)
    by_hash = {t or "": int(sd.chunks([t or ""])[4].view("int64")[0]) for _, t in rows}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, by_hash[r[1] or ""])):
        for s, e, c in plain_chunks(t or ""):
            if first.setdefault(c, (d, t, s)) != (d, t, s):
                run = out[(d, t)]
                if run and run[-1][1] == s:
                    run[-1][1] = e
                else:
                    run.append([s, e])
    return {k: kept for k, v in out.items() if (kept := [tuple(x) for x in v if x[1] - x[0] >= min_chars])}


def test_chunks_are_local_and_cover_the_text():
    texts = ["", "é" * 300, "the cat sat on the mat. " * 30, "aaaa" * 200, "漢字 mixed with text " * 20]
    who, start, end, digest, _ = sd.chunks(texts)
    for i, t in enumerate(texts):
        mine = who == i
        assert list(zip(start[mine].tolist(), end[mine].tolist())) == [(s, e) for s, e, _ in plain_chunks(t)]
    moved = sd.chunks(["inserted words " + texts[2]])[3]
    assert len(set(digest[who == 2].tolist()) - set(moved.tolist())) <= 2


def test_query_against_plain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in op10_substring_dedup(spark, SF_DIR).collect()}
    assert got == {d: v for (d, _), v in removed(rows).items()} and got


def test_small_blocks_and_odd_rows(spark, monkeypatch):
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(60))
    rows = [(4, "start of four " + passage + " end"), (2, passage), (2, passage), (None, "null " + passage), (7, None), (8, ""), (9, "short one"),
            (10, passage + " and again " + passage)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kind string").repartition(3)
    got = {(r.doc_id): [(s.start, s.end) for s in r.spans] for r in sd.repeated_documents(docs).collect()}
    assert got == {d: v for (d, _), v in removed(rows).items()}
    assert set(got) == {2, 4, 10}
    kept = {r.doc_id: r.text for r in sd.without_repeats(docs).collect()}
    assert len(kept[4]) < 160 and kept[7] is None and kept[8] == "" and kept[9] == "short one" and kept[None] == "null " + passage
    assert sd.repeated_documents(docs.limit(0)).count() == 0
