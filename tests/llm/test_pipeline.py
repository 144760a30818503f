"""Every stage of the pipeline against a plain version of it on the stage's own input."""

import pytest

import corpus_pipeline as cp
from conftest import SF_DIR
from test_line_dedup import expected as plain_lines
from test_ngram_join import expected as plain_components
from test_tokens import check_packing
from tidemark.llm import decontamination, quality
from tidemark.llm.common import read
from tidemark.session import stable


@pytest.fixture(scope="module")
def tables(spark):
    docs = read(spark, SF_DIR, "documents")
    out = [docs]
    for _, stage in cp.STAGES:
        docs = stable(stage(spark, docs, SF_DIR), "test-stage")
        out.append(docs)
    return [[tuple(r) for r in t.collect()] if i < 5 else t.collect() for i, t in enumerate(out)], out


def test_stages_keep_the_columns_of_documents(tables):
    assert [t.dtypes for t in tables[1][:5]] == [tables[1][0].dtypes] * 5
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "ngram_join", "decontamination", "packing"]


def test_quality(spark, tables):
    scores = {r.doc_id: r.score for r in quality.score_documents(tables[1][0], read(spark, SF_DIR, "labels")).collect()}
    assert sorted(tables[0][1]) == sorted(r for r in tables[0][0] if scores[r[0]] >= 0.5)
    assert 0 < len(tables[0][0]) - len(tables[0][1]) < len(tables[0][0]) / 2


def test_lines(tables):
    removed = plain_lines([(r[0], r[1]) for r in tables[0][1]], cp.COPY_FROM)
    want = []
    for doc, text, *rest, n in tables[0][1]:
        gone = set(removed[(doc, text or "")])
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text
        if not gone or kept.strip(" \t\n\r\x0b\x0c"):
            want.append((doc, kept, *rest, len(kept) if gone else n))
    assert sorted(tables[0][2]) == sorted(want) and want != tables[0][1]


def test_copies(tables):
    keep = {d for d, _, c in plain_components([(r[0], r[1]) for r in tables[0][2]]) if d == c}
    assert sorted(tables[0][3]) == sorted(r for r in tables[0][2] if r[0] in keep)


def test_near_copies_of_other_lines(spark):
    """Texts alike by words whose lines break elsewhere reach the n-gram stage whole, and one of them stays."""
    words = [f"w{i}" for i in range(400)]
    rows = [(d, "\n".join(" ".join(words[a:a + step]) for a in range(0, 400, step))) for d, step in ((4, 40), (2, 25), (9, 16))]
    rows += [(5, " ".join(f"other{i}" for i in range(100))), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, stage in cp.STAGES[1:3]:
        docs = stable(stage(spark, docs, SF_DIR), "test-near")
    assert sorted(r.doc_id for r in docs.collect()) == [2, 5, 6]


def test_benchmark(spark, tables):
    dirty = {r.doc_id for r in decontamination.benchmark_matches(tables[1][3], read(spark, SF_DIR, "benchmark")).collect()}
    assert dirty and sorted(tables[0][4]) == sorted(r for r in tables[0][3] if r[0] not in dirty)


def test_packing(tables):
    rows = tables[0][5]
    assert {r.doc_id for r in rows} == {r[0] for r in tables[0][4]}
    assert check_packing(rows, 1024) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_stages_without_rows_and_with_odd_ones(spark):
    odd = spark.createDataFrame([(None, None, "x"), (1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "some words " * 4, "x")], "doc_id long, text string, matches string")
    for table in (odd, odd.limit(0)):
        docs = stable(table, "test-odd")
        for _, stage in cp.STAGES[:-1]:
            docs = stable(stage(spark, docs, SF_DIR), "test-odd")
            assert docs.columns == odd.columns
        stable(cp.STAGES[-1][1](spark, docs, SF_DIR), "test-odd").count()


def test_a_document_of_common_lines_loses_them(spark):
    a, b, c, d = (f"line {w} that stands in more than one document" for w in ("alpha", "bravo", "charlie", "delta"))
    rows = [(1, f"{a}\n{b}\nonly the first document says this"), (2, f"{a}\n{b}\n{c}\nand this is said by the second"), (3, f"{d}\n{c}"), (4, f"{b}\n{d}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in cp.without_repeated_lines(spark, docs, SF_DIR).collect()}
    assert got == {1: rows[0][1], 2: f"{c}\nand this is said by the second", 3: d}  # the fourth has nothing left
