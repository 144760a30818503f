"""Random-indexing vectors against plain loops; accuracy on labels that were held out."""

import numpy as np
import pytest

from conftest import SF_DIR
from tidemark.llm import quality as q
from tidemark.llm.kernels import words
from tidemark.llm.queries import op6_quality


def test_words_are_lower_cased_runs():
    h, owner = words(["The cat", "", " the\tCAT\n", "the cats"])
    assert owner.tolist() == [0, 0, 2, 2, 3, 3]
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[5]
    kinds, owner = words(["ab12,,é"], by_kind=True)
    assert len(kinds) == 4


def test_context_sums_against_loops():
    texts = ["a b c a", "", "b b"]
    got = np.zeros(q.BUCKETS * q.DIM)
    q.context_sums(texts, got)
    bucket, owner = q._buckets(texts)
    place, sign = q.index_vectors()
    want = np.zeros((q.BUCKETS, q.DIM))
    for i in range(len(bucket)):
        for j in range(len(bucket)):
            if i != j and owner[i] == owner[j] and abs(i - j) <= q.REACH:
                for k in range(q.NONZERO):
                    want[bucket[i], place[bucket[j], k]] += sign[bucket[j], k]
    assert np.allclose(got.reshape(q.BUCKETS, q.DIM), want)


def test_pooled_against_loops(monkeypatch):
    monkeypatch.setattr(q, "SLICE", 3)
    table = np.random.default_rng(0).normal(size=(q.BUCKETS, q.DIM)).astype(np.float32)
    texts = ["one two three four five", "", "six"]
    bucket, owner = q._buckets(texts)
    got = q.pooled(texts, table)
    for i in range(3):
        v = table[bucket[owner == i]].astype(float)
        want = np.concatenate([v.mean(axis=0), v.std(axis=0)]) if len(v) else np.zeros(2 * q.DIM)
        assert np.allclose(got[i], want, atol=1e-3)


def test_temperature_makes_scores_probabilities():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2 * q.DIM))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = q.fit(x, y, np.arange(3000) % 5 == 0)
    fresh = rng.normal(size=(3000, 2 * q.DIM))
    truth = 1 / (1 + np.exp(-2 * fresh[:, 0]))
    assert net.temperature > 1 and np.abs(net.score(fresh) - truth).mean() < 0.2


def test_held_out_accuracy(spark):
    got = op6_quality(spark, SF_DIR).toPandas().merge(spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 10 and (held.predicted == held.quality).mean() > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 1), (1, "good words here", 1), (None, None, 0), (2, "", 0), (3, "| | |", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (4, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = q.score_documents(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert len({r.score for r in got if r.doc_id in (None, 2)}) == 1
    assert {r.score for r in q.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert q.score_documents(docs.limit(0), labels).count() == 0
