"""Occurrences of benchmark items against a plain alignment of every item with every text."""

import random
import time

import numpy as np

from conftest import SF_DIR
from tidemark.llm import decontamination as dc
from tidemark.llm.queries import op8_decontamination


def plain_least(item, text):
    """Least edits of the item anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def budget(item):
    return max(0, min(int(len(item) * dc.RATE), len(item) // dc.Q - 1))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at:at + rng.choice([0, 1])] = rng.choice(["", "z", "é"])
    return "".join(out)


def test_against_plain_alignment(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(rng.choice([4, 12, 30]))) for _ in range(8)] + ["short", None, "x" * 60]
    docs = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.choice([0, 1, 2])):
            i = rng.choice(items[:8])
            parts.append(edited(rng, i, rng.choice([0, 0, 2, int(len(i) * 0.07), int(len(i) * 0.12)])))
            parts.append(" ".join(word() for _ in range(5)))
        docs.append((d, " ".join(parts).replace("a", rng.choice("aA"))))
    docs += [(90, None), (91, ""), (None, "say " + items[2].upper().replace(" ", "\t")), (92, "x" * 300), (93, items[1][3:]), (93, items[1][3:])]
    table = spark.createDataFrame([(*r, "m") for r in docs], "doc_id long, text string, matches string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, start int")
    got = dc.benchmark_matches(table, bench).collect()
    fold = lambda t: "".join(map(chr, dc.folded(t or "")))
    want = {(d, i) for d, t in docs for i, x in enumerate(items) if x and len(x) >= dc.Q and plain_least(fold(x), fold(t)) <= budget(x)}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 20
    texts = dict(docs)
    for r in got:
        span = fold(texts[r.doc_id])[r.start:r.end]
        assert plain_least(fold(items[r.item_id]), span) == r.edits <= budget(items[r.item_id])
        assert abs(len(span) - len(items[r.item_id])) <= r.edits
    dirty = {d for d, _ in want}
    clean = dc.clean_documents(table, bench)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - dirty
    assert dc.benchmark_matches(table, bench.limit(0)).count() == 0 and dc.benchmark_matches(table.limit(0), bench).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEM_CHARS", 50)
    bench = spark.createDataFrame([(1, "the first of all the items here"), (2, "a second item that is different")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x the first of all the items here y"), (2, "no"), (3, "a second item that is different")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.start) for r in dc.benchmark_matches(docs, bench).collect()) == [(1, 1, 2), (3, 2, 0)]
    assert [r.doc_id for r in dc.clean_documents(docs, bench).collect()] == [2]


def test_query_finds_all_verbatim_items(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    got = op8_decontamination(spark, SF_DIR).collect()
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x.strip().lower() in t.lower()}
    assert exact and exact == {(r.doc_id, r.item_id) for r in got if r.edits == 0}
    for r in got:
        if r.edits == 0:
            assert docs[r.doc_id][r.start:r.end].lower() == items[r.item_id].strip().lower()


def test_texts_that_repeat_a_pattern():
    """A long run of one character against an item of the same: found everywhere, soon, in little memory."""
    index = dc.build([1, 2], ["a" * 400, "ab" * 30], dc.Q, dc.RATE)
    begin = time.perf_counter()
    found = dc.matches(index, ["a" * 100_000, "x" + "ab" * 500], dc.Q)
    assert time.perf_counter() - begin < 20
    ones = [m for m in found[0] if m["item_id"] == 1]
    assert len(ones) >= 100_000 // 432 and all(m["edits"] == 0 and m["end"] - m["start"] == 400 for m in ones)
    assert all(a["end"] <= b["start"] for a, b in zip(ones, ones[1:]))
    assert [m for m in found[1] if m["item_id"] == 2]


def test_counting_by_band_finds_the_same(monkeypatch):
    rng = random.Random(3)
    for _ in range(20):
        items = ["".join(rng.choice("ab ") for _ in range(rng.choice([12, 40, 150]))) for _ in range(4)] + ["abc " * 20]
        texts = []
        for _ in range(5):
            text = list("".join(rng.choice("abcdef ") for _ in range(150)) + rng.choice(items) + "ab " * rng.randrange(60) + rng.choice(items))
            for _ in range(6):
                text[rng.randrange(len(text))] = rng.choice("abx")
            texts.append("".join(text))
        index = dc.build(list(range(5)), items, dc.Q, dc.RATE)
        monkeypatch.setattr(dc, "MANY_HITS", 10 ** 9)
        spelled = dc.matches(index, texts, dc.Q)
        monkeypatch.setattr(dc, "MANY_HITS", 0)
        assert dc.matches(index, texts, dc.Q) == spelled
