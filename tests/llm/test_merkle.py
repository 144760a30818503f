"""The manifest against plain trees: one list per level."""

import hashlib
import zlib

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = {ord(c): c.lower() for c in merkle.UPPER}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(doc, text, lang, source, n):
    return h(*(enc(v) for v in (doc, source, lang, n, text)))


def climb(nodes):
    """The root, and for each leaf its siblings by level."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 8, len(nodes))) for a in range(0, len(nodes), 8)]
        for run in runs:
            for j in run:
                for i in under[j]:
                    paths[i].append(("".join(nodes[k] for k in run if k < j), "".join(nodes[k] for k in run if k > j)))
        nodes, under = [h(*(nodes[k] for k in run)) for run in runs], [[i for k in run for i in under[k]] for run in runs]
    return nodes[0], paths


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found = {}
    for lang in langs:
        trees[lang].sort(key=lambda t: t[:3])
        found[lang] = climb([t[2] for t in trees[lang]])
    if not langs:
        return []
    root, ups = climb([found[x][0] for x in langs])
    out = []
    for lang, up in zip(langs, ups):
        sub, paths = found[lang]
        for (_, _, leaf, r), path in zip(trees[lang], paths):
            steps = path + up
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = plain_leaf(r[0], r[1] and r[1].translate(UPPER), *r[2:])
            for left, right in steps:
                node = h(left, node, right)
            out.append((r[0], leaf, sub, root, h(*(a + b for a, b in steps)), node, node == root))
    return out


def got(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return sorted(map(tuple, merkle.verified_documents(docs, tampered).collect()), key=str)


def test_trees_of_many_sizes(spark):
    """Trees of 1, 2, 8, 9, 64, 65 and 1,300 leaves (three blocks), ids in no order."""
    rows = [(1000 * k + (i * 7919) % n, f"Text {i} ÄB" if i % 5 else None, lang, f"s{i % 3}", i)
            for k, (lang, n) in enumerate([("a", 1), ("b", 2), ("c", 8), ("d", 9), ("e", 64), ("é", 65), ("Z", 1300), (None, 7), ("", 3)]) for i in range(n)]
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_nulls_repeats_long_and_empty(spark):
    rows = [(None, "A", "x", None, None), (None, "A", "x", None, None), (3, "", "x", "s", 0), (3, "", "x", "s", 0), (3, None, "x", "s", 0),
            (5, "Zeile " * 50_000, None, "s", 1), (7, "abc", "x", "", 3)]
    assert got(spark, rows) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(9, "One", "en", "s", 3)]])
def test_none_and_one(spark, rows):
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_extra_columns_with_the_operators_names(spark):
    schema = SCHEMA + ", leaf string, root string, pos long, d string, _tree string, steps int"
    rows = [(i, f"T{i}", "l", "s", i, "x", "y", 1, "z", "w", 2) for i in range(20)]
    assert got(spark, rows, schema) == sorted(plain([r[:5] for r in rows]), key=str)


def test_every_row_the_same(spark):
    rows = [(1, "Same", "l", "s", 4)] * 700
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_proofs_fold_to_the_root(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = merkle.manifest(merkle.document_leaves(docs, F.lit(False)), "lang", "doc_id")
    off = rows.where(merkle.fold(F.col("leaf"), F.col("steps")) != F.col("root"))
    assert off.count() == 0 and rows.count() == docs.count()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, SF_DIR).collect()), key=str) == sorted(plain(rows), key=str)
