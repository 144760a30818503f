"""Piecewise hashes against a plain version, one byte at a time."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_DIR
from tidemark.llm import fingerprints as fp
from tidemark.llm.kernels import BASE, Sums, byte_values
from tidemark.llm.queries import op2_fingerprints

M = (1 << 64) - 1
VALUES = [int(v) for v in byte_values(0)]


def mixed(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
    return h ^ (h >> 31)


def hash_of(part):
    return mixed((sum(VALUES[b] * pow(BASE, i, 1 << 64) for i, b in enumerate(part)) + len(part) * 0xBF58476D1CE4E5B9) & M)


def plain(text):
    data = text.encode()
    padded = b"\0" * 6 + data
    roll = [hash_of(padded[i:i + 7]) for i in range(len(data))]
    def signature(level):
        out, start = "", 0
        for i in range(len(data)):
            if (roll[i] & ((1 << level) - 1)) == 0 and i < len(data) - 1:
                out += chr(fp.ALPHABET[hash_of(data[start:i + 1]) >> 58])
                start = i + 1
        return out + (chr(fp.ALPHABET[hash_of(data[start:]) >> 58]) if data else "")
    level = 0
    while len(signature(level)) > 64:
        level += 1
    return f"{level}:{signature(level)}:{signature(level + 1)}"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n漢"), max_size=200), min_size=1, max_size=4))
def test_fingerprint_of_small_texts(texts):
    padded = ["", *texts]
    assert fp.fingerprints(padded)[1:] == [plain(t) for t in texts]
    assert fp.fingerprints(texts) == [plain(t) for t in texts]


def test_texts_without_or_full_of_cuts():
    for t in ["", "a", "aa", "a" * 5000, "ab" * 3000, "x" * 63, "\0" * 500]:
        got = fp.fingerprints([t, "other", t])
        assert got[0] == got[2] == plain(t)
        assert all(len(s) <= 64 for s in got[0].split(":")[1:])


@given(st.lists(st.tuples(st.text(st.sampled_from("abcd"), max_size=64), st.text(st.sampled_from("abcd"), max_size=64)), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_edit_distances(pairs):
    assert fp.edit_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [levenshtein(a, b) for a, b in pairs]


def test_likeness():
    a, b = fp.fingerprints(["the quick brown fox " * 40 + "one end", "the quick brown fox " * 40 + "another"])
    assert fp.likeness([a, a, "0::"], [a, b, a])[0] == 1.0
    assert fp.likeness(["0::", "3:ABCD:AB"], ["0::", "5:ABCD:AB"]).tolist() == [1.0, 0.0]


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        f, g, h = fp.fingerprints([t, e, n])
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, float(fp.likeness([f], [g])[0]), float(fp.likeness([f], [h])[0])))
    return out


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = op2_fingerprints(spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(expected(rows))
    assert np.mean([r.near_edited > 0.3 for r in got]) > 0.9
    assert np.mean([r.near_next > 0.3 for r in got]) < 0.2


def test_odd_rows(spark):
    rows = [(5, "five " * 50), (None, "null id"), (5, "five " * 50), (2, None), (9, "é" * 99), (7, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, range string")
    for ranges in (1, 4):
        assert sorted(map(str, map(tuple, fp.compare_with_next(docs, ranges).collect()))) == sorted(map(str, expected(rows)))
    assert fp.compare_with_next(docs.limit(0)).count() == 0
    one = fp.compare_with_next(docs.where("doc_id = 9")).collect()[0]
    assert one.near_next == 1.0 and one.n_chars == 99


def test_sums_are_of_the_bytes_alone():
    data = np.frombuffer(b"abcXabc", np.uint8)
    h = Sums(data).of(np.array([0, 4, 0]), np.array([3, 7, 7]))
    assert h[0] == h[1] == hash_of(b"abc") and h[2] == hash_of(b"abcXabc")
