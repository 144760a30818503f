"""Line classes against all pairs of lines, and the banded distance against the plain one."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_DIR
from test_ngram_join import closure
from tidemark.llm import line_dedup as ld
from tidemark.llm.queries import op9_line_dedup

SPACE = " \t\r\x0b\x0c"


def near(a, b, tau=ld.TAU):
    if abs(len(a) - len(b)) > tau or (Counter(a) - Counter(b)).total() > tau or (Counter(b) - Counter(a)).total() > tau:
        return False
    return ld._plain_distance(a, b) <= tau


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_banded_distances(data):
    tau = data.draw(st.integers(0, 3))
    pairs = []
    for _ in range(data.draw(st.integers(1, 5))):
        a = data.draw(st.text(st.sampled_from("ab漢"), max_size=40))
        b = list(a)
        for _ in range(data.draw(st.integers(0, 4))):
            at = data.draw(st.integers(0, len(b)))
            b[at:at + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "a", "c"]))
        pairs.append((a, "".join(b)))
    got = ld.banded_distances([a for a, _ in pairs], [b for _, b in pairs], tau)
    want = [min(tau + 1, ld._plain_distance(a, b)) for a, b in pairs]
    assert got.tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abc"), min_size=24, max_size=60), st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["", "x", "ab"]), st.integers(0, 1)), max_size=2))
def test_near_lines_share_an_entry_and_look_alike(a, edits):
    b = list(a)
    for at, new, cut in edits:
        b[at:at + cut] = new
    b = "".join(b)
    if not near(a, b) or min(len(a), len(b)) < ld.LEAST:
        return
    lines = ld.Lines([a + "\n" + b])
    h = lines.hashes(3)
    key, name, bits, own = ld.entries(lines, np.arange(2), np.arange(2).astype(np.uint64), h, ld.TAU)
    x, y = key[name == 0], key[name == 1]
    assert set(x[own[name == 0]].tolist()) & set(y.tolist()) if len(b) >= len(a) else set(y[own[name == 1]].tolist()) & set(x.tolist())
    assert np.bitwise_count(bits[name == 0][0] ^ bits[name == 1][0]) <= 4 * ld.TAU
    signs = ld.signatures([a, b])
    assert sum(int(np.bitwise_count(s.view(np.uint64)[0] ^ s.view(np.uint64)[1])) for s in signs) <= 4 * ld.TAU


def expected(rows, whole_from=None):
    """(doc_id, text) -> removed line numbers."""
    hashes = {}
    for _, t in rows:
        lines = ld.Lines([t or ""])
        hashes[t or ""] = int(lines.hashes(3).of(lines.first, lines.first + lines.sizes).view(np.int64)[0])
    docs = sorted({(d is not None, d or 0, hashes[t or ""], t or "") for d, t in rows})
    first, places = {}, []
    for known, d, _, t in docs:
        for i, raw in enumerate(t.split("\n")):
            line = raw.strip(" \t\n\r\x0b\x0c")
            if line:
                places.append(((known, d, t), i, line))
                first.setdefault(line, len(first))
    by_length = {}
    for line in first:  # shorter lines are repeats only if they are equal
        if len(line) >= ld.LEAST:
            by_length.setdefault(len(line), []).append(line)
    links = [(first[a], first[b]) for a in first if len(a) >= ld.LEAST for n in range(len(a) - ld.TAU, len(a) + 1) for b in by_length.get(n, []) if a != b and near(a, b)]
    group = closure(range(len(first)), links)
    seen, out, chars, lost = set(), {(k, d, t): [] for k, d, _, t in docs}, {}, {}
    for doc, i, line in places:
        chars[doc] = chars.get(doc, 0) + len(line)
        c = group[first[line]]
        if c in seen:
            out[doc].append(i)
            lost[doc] = lost.get(doc, 0) + len(line)
        seen.add(c)
    if whole_from:
        out = {k: [] if v and lost[k] >= whole_from * chars[k] else v for k, v in out.items()}
    return {(d if k else None, t): v for (k, d, t), v in out.items()}


def line_table(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([18, 25, 40, 41, 90]))) for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            line = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice("xyz é") for _ in range(rng.randrange(0, 60))]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                at = rng.randrange(len(line) + 1)
                line[at:at + rng.choice([0, 1])] = rng.choice(["", "q", "é"])
            lines.append(rng.choice(["", "  "]) + "".join(line) + rng.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(lines)))
    return rows


def test_against_all_pairs(spark):
    rows = line_table(3) + [(None, "a line that repeats in rows without id\nsecond"), (70, "a line that repeats in rows without id"), (71, None), (72, ""), (73, "\n\n")]
    rows += rows[:2]
    docs = spark.createDataFrame([(*r, 0, "l") for r in rows], "doc_id long, text string, line int, h1 string")
    for whole in (None, 0.5):
        want = expected(rows, whole)
        got = ld.repeated_lines(docs, whole_from=whole).collect()
        assert len(got) == len(want)
        texts = {(d, len((t or "").split("\n")), tuple(want[(d, t or "")])) for d, t in rows}
        assert {(r.doc_id, r.n_lines, tuple(r.removed)) for r in got} == texts
        assert sum(map(len, want.values())) > 20
    kept, want = ld.without_repeated_lines(docs).collect(), expected(rows)
    assert len(kept) == len(rows)
    assert {(r.doc_id, r.text) for r in kept} == {(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[(d, t)])) for d, t in rows}
    assert ld.repeated_lines(docs.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = {d: v for (d, _), v in expected(rows).items()}
    assert {r.doc_id: list(r.removed) for r in op9_line_dedup(spark, SF_DIR).collect()} == want


def test_short_lines_are_repeats_if_equal(spark):
    rows = [(1, "Les.\nLea.\n\nx"), (2, " Les.\r\nLet.\n\nx"), (3, "Nt onor. The of it.\nNt onor. The of it."), (4, "Nt onor. The of it!\nthe same line of more than twenty"),
            (5, "the same line of more than twenty\nLes."), (None, "Let.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: list(r.removed) for r in ld.repeated_lines(docs).collect()} == {1: [], 2: [0, 1, 3], 3: [1], 4: [], 5: [0, 1], None: []}
    assert {r.doc_id: r.text for r in ld.without_repeated_lines(docs).collect()} == {
        1: rows[0][1], 2: "", 3: "Nt onor. The of it.", 4: rows[3][1], 5: "", None: "Let."}
    table = line_table(3)
    got = {(r.doc_id, tuple(r.removed)) for r in ld.repeated_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {(d, tuple(v)) for (d, _), v in expected(table).items()}
