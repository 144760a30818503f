"""Jaccard links and components against all pairs on small tables."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import ngram_join as nj
from tidemark.llm.components import components


def plain_set(text, n=5):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def closure(nodes, links):
    root = {v: v for v in nodes}
    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def expected(rows):
    sets = [(d, plain_set(t)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i]
             if a is not None and b is not None and x & y and 100 * len(x & y) >= 75 * len(x | y)]
    comp = closure({d for d, _ in sets if d is not None}, links)
    return sorted(((d, len(s), comp.get(d)) for d, s in sets), key=str)


def near_copies(seed, groups=6, size=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, doc = [], 100
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 80, 200]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(words))
                words[at:at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            if rng.random() < 0.2:
                words = words[:int(len(words) * rng.uniform(0.6, 1))]
            out.append((doc, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
            doc += rng.choice([1, 3])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, monkeypatch):
    rows = near_copies(seed)
    rows += [(1, None), (2, ""), (3, " \t"), (4, "two words"), (5, "TWO  words"), (6, "two words"), (7, "words two"), (None, rows[0][1]), (8, "x " * 3000), (9, "x " * 9000)]
    rows += [rows[0], rows[3]]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n long, node string").repartition(5)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = sorted(map(tuple, nj.similar_documents(docs).collect()), key=str)
    assert got == expected(rows)
    assert len({r[2] for r in got}) > 5


def test_no_rows(spark):
    assert nj.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlap_bound_never_too_low():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, rng.choice([20, 500]), rng.integers(1, 100)).astype(np.uint64)) for _ in range(2))
        assert nj.overlap_bound(x, y) >= len(np.intersect1d(x, y))


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3), (100, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == closure({v for e in real for v in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_row_without_id_does_not_take_the_links_of_its_copies(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join(words[:-1] + ["end"]), " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (2, text), (3, text), (1, near), (4, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in nj.similar_documents(docs).collect()}
    assert got == {(None, None), (1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted(map(tuple, nj.one_of_each(docs).collect()), key=str) == sorted([(None, text), (1, near), (4, other)], key=str)


def test_rows_of_one_id_go_only_by_their_texts(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join(words[:-1] + ["end"]), " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (5, near), (5, other), (5, other), (6, "one more text"), (6, "and a third one"), (7, None), (7, ""), (None, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.doc_id, r.text or "") for r in nj.one_of_each(docs).collect()], key=str)
    assert got == sorted([(1, text), (5, other), (6, "one more text"), (6, "and a third one"), (7, ""), (None, near)], key=str)


def test_few_bytes_for_small_numbers():
    for top, width in ((0, 1), (255, 1), (256, 2), (70_000, 4), (1 << 40, 8)):
        values = np.array([0, top, 1])
        raw = nj.narrow(values)
        assert len(raw) == 1 + 3 * width and nj.wide(raw).tolist() == values.tolist()
    assert nj.wide(nj.narrow(np.zeros(0, int))).tolist() == []


def test_shuffled_bytes_of_an_ngram(monkeypatch):
    """A hash goes to its bucket with one byte beside it, and its documents stay with the block in two."""
    monkeypatch.setattr(nj, "TaskContext", type("T", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    texts = [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(20)]
    rows = next(iter(nj._packed(iter([(list(range(20)), texts)]), 5, 4))).to_pylist()
    grams = 20 * 296
    assert sum(len(r["hashes"]) + len(r["counts"]) for r in rows if r["bucket"] >= 0) <= 9 * grams + 10
    assert sum(len(r["owners"]) + len(r["sizes"]) for r in rows if r["bucket"] < 0) <= 2 * grams + 10
