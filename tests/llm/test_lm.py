"""The base against plain counts; the model against loops, numeric gradients and held-out texts."""

import math
import re
import zlib

import numpy as np
import pytest

from conftest import SF_DIR
from tidemark.llm import attention as at
from tidemark.llm import lm, quality
from tidemark.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string"
END = 50256


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def held(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 10 == 0


def plain_base(rows):
    count = {}
    for doc, text in rows:
        if not held(doc):
            for w in [*split(text), None]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    out = []
    for doc, text in rows:
        tokens = [*split(text), None]
        out.append((doc, held(doc), len(tokens), sum(t in count for t in tokens), n,
                    sum(math.log10((count.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)))
    return out


def run(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    return lm.score_texts(docs, quality.id_hash() % 10 == 0, tokenizer_path("byte_bpe_50k.json"), END).collect()


def check_base(got, rows):
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    want = sorted(plain_base(rows), key=str)
    assert [m[:5] for m in mine] == [w[:5] for w in want]
    assert np.allclose([m[5] for m in mine], [w[5] for w in want], rtol=1e-9)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_lm_scoring"](spark, SF_DIR).collect()
    check_base(got, rows)
    out = [r for r in got if r.held_out]
    words = sum(r.n_tokens for r in out)
    # 63,000 training words: far better than every id alike (about -10.9 a word), near the word counts
    assert sum(r.score for r in out) / words > -4.8
    assert all(r.score < 0 for r in got)


def test_odd_texts(spark):
    """NULLs, empty texts, white space of all kinds, repeated rows, a long text, case of other letters."""
    rows = [(1, None), (2, ""), (2, ""), (3, " \t\x0b\x0c\n"), (4, "Ä Word x İ ß"), (5, "a b " * 30_000), (None, "a b"), (None, None),
            (6, "x\x00y A\u0085b"), (7, "a B c"), (7, "a B c"), (10 ** 12, "nobody said this")]
    got = run(spark, rows)
    check_base(got, rows)
    scores = {}
    for r in got:
        scores.setdefault((r.doc_id, r.n_tokens), set()).add(r.score)
    assert all(max(s) - min(s) <= 1e-5 * abs(min(s)) and all(map(math.isfinite, s)) for s in scores.values())


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    got = run(spark, [(1, "a b", "x", 3, 1.0), (2, "a", "y", 4, 2.0)], SCHEMA + ", score string, block int, held_out double")
    check_base(got, [(1, "a b"), (2, "a")])


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(200) if held(i)][:3]
    got = run(spark, [(i, "a b") for i in ids])
    check_base(got, [(i, "a b") for i in ids])
    assert all(math.isclose(r.score, -3 * math.log10(50257), rel_tol=1e-6) for r in got)


def test_held_out_texts_teach_nothing(spark):
    rows = [(i, f"word{i % 7} and more{i % 3} words here") for i in range(300)]
    other = [(i, "something else entirely" if held(i) else t) for i, t in rows]
    a, b = ({r.doc_id: (r.base_score, r.score) for r in run(spark, x) if not r.held_out} for x in (rows, other))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-5) for k in a)


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(2)
    weight = rng.random(40) * 9 + 0.5
    starts = at.balanced(weight)
    p = at.initial(starts, weight)
    for k in p:
        p[k] = (p[k] + rng.normal(0, 0.3, p[k].shape)).astype(np.float32)
    counts = np.array([1, 16, 17, 53, 5, 32, 100])
    symbols = rng.integers(0, 40, counts.sum()).astype(np.uint16)
    return p, starts, symbols, counts


def plain_log(p, starts, before, target):
    """One target by loops: its log probability after the symbols ``before`` (at most two windows of them)."""
    x = p["embed"][before].astype(float)
    q, k, v = x[-1] @ p["query"], x @ p["key"], x @ p["value"]
    half, seen = at.WIDTH // at.HEADS, []
    for h in range(at.HEADS):
        s = slice(h * half, (h + 1) * half)
        logits = np.array([q[s] @ k[j, s] / math.sqrt(half) + p["near"][h, len(x) - 1 - j] for j in range(len(x))])
        e = np.exp(logits - logits.max())
        seen.append(e / e.sum() @ v[:, s])
    mixed = np.concatenate(seen) @ p["mix"]
    r = np.maximum(np.concatenate([x[-1], mixed]) @ p["in"] + p["in_bias"], 0)
    z = r @ p["out"] + x[-1] + mixed

    def log_softmax(y):
        return y - y.max() - np.log(np.exp(y - y.max()).sum())
    g = int(np.searchsorted(starts, target, "right") - 1)
    members = slice(starts[g], starts[g + 1])
    return log_softmax(z @ p["group"] + p["group_bias"])[g] + log_softmax(p["symbol"][members] @ z + p["symbol_bias"][members])[target - starts[g]]


def test_windows_score_every_id_once_and_like_loops(small):
    p, starts, symbols, counts = small
    begin = 3
    want, ends = [], np.cumsum(counts)
    for a, b in zip(ends - counts, ends):
        seq, total = [begin, *symbols[a:b]], 0.0
        for t in range(b - a):
            from_ = max(0, (t // at.SPAN - 1) * at.SPAN)
            total += plain_log(p, starts, np.array(seq[from_:t + 1]), int(seq[t + 1]))
        want.append(total)
    w = at.Windows.cut(symbols, counts, begin)
    assert w.valid.sum() == counts.sum()
    for batch in (1, 3, 512):
        assert np.allclose(at.Scorer(p, starts)(w, batch), want, rtol=2e-4)
    done = at.Pass(p, starts, w, np.arange(len(w.first)))
    assert math.isclose(done.logp.sum(), sum(want), rel_tol=2e-4)


def test_probabilities_sum_to_one(small):
    p, starts, symbols, _ = small
    n = len(p["embed"])
    texts = np.concatenate([np.append(symbols[:20], s) for s in range(n)]).astype(np.uint16)
    logs = at.Scorer(p, starts)(at.Windows.cut(texts, np.full(n, 21), 3))
    without = at.Scorer(p, starts)(at.Windows.cut(symbols[:20], np.array([20]), 3))[0]
    assert math.isclose(np.exp(logs - without).sum(), 1, rel_tol=1e-3)


def test_training_windows(small):
    _, _, symbols, counts = small
    w = at.Windows.cut(symbols, counts, 3)
    two = w.every(2)
    assert set(two) | set(two[~w.first[two]] - 1) == set(range(len(w.first)))  # pairs hold every id
    for step in (1, 2, 4):
        assert set(w.text[w.every(step)]) == set(range(len(counts)))  # every text has a part
        assert len(w.every(step)) <= len(w.first) / step + 2 * len(counts)


def test_gradients(small):
    p, starts, symbols, counts = small
    p = {k: v.astype(np.float32) for k, v in p.items()}
    w = at.Windows.cut(symbols, counts, 3)
    some = np.array([0, 2, 4, 6, 9, 11])
    grads = at.Pass(p, starts, w, some).gradients()
    rng = np.random.default_rng(4)
    for name, value in p.items():
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in value.shape)
            losses = []
            for d in (1e-2, -1e-2):
                old = value[i]
                value[i] = old + d
                losses.append(-at.Pass(p, starts, w, some).logp.astype(float).mean())
                value[i] = old
            assert abs((losses[0] - losses[1]) / 2e-2 - grads[name][i]) < 2e-3, name


def test_known_words_and_new_ones(monkeypatch):
    """Numbers, hashes and ids stay the same when the worker's list starts anew."""
    monkeypatch.setattr(lm, "MAX_WORDS", 3)
    words = lm._Words(tokenizer_path("byte_bpe_50k.json"))
    fresh = lm._Words(tokenizer_path("byte_bpe_50k.json"))
    for text in ("One two three.", "four FIVE six one", "one two ÄÖ", ""):
        n, c = words.number([text, ""])
        m, d = fresh.number([text, ""])
        assert words.ids(n, c, END)[0].tolist() == fresh.ids(m, d, END)[0].tolist()
        assert words.hashes[n].tolist() == fresh.hashes[m].tolist()
        plain = [i for w in split(text) for i in fresh.encoder.tokenizer.encode(" " + w, add_special_tokens=False).ids]
        assert words.ids(n, c, END)[0].tolist() == [*plain, END, END]


def test_crc_of_the_query(spark):
    assert spark.createDataFrame([(7,), (None,)], "doc_id long").select((quality.id_hash() % 10 == 0).alias("h")).collect() == [(held(7),), (True,)]


def test_every_window_of_a_training_text_is_learned_from():
    w = at.Windows.cut(np.arange(4000, dtype=np.uint16) % 50, np.array([3000, 1, 999]), 3)
    assert w.every(lm.EVERY).tolist() == list(range(len(w.first)))


def test_words_that_come_again_are_not_encoded_again(monkeypatch):
    """When the worker's list of words starts anew, the pieces of its words are still known."""
    monkeypatch.setattr(lm, "MAX_WORDS", 3)
    known = lm._Words(tokenizer_path("byte_bpe_50k.json"))
    text = "Seven, eight; nine (ten) eleven's end."
    first = known.ids(*known.number([text]), END)[0]
    calls = []
    monkeypatch.setattr(known.encoder, "_ids", lambda texts, bare=False: calls.extend(texts) or [np.zeros(0, np.uint32) for _ in texts])
    numbers, counts = known.number(["  " + text + "\n", "", " \t", text])
    assert counts.tolist() == [6, 0, 0, 6] and not calls
    assert known.ids(numbers, counts, END)[0].tolist() == [*first, END, END, *first]


def test_pass_of_one_window_and_of_wild_parameters(small):
    """Rows by group, softmaxes divided late: the same as the scorer, also where exponentials need the rows' maxima."""
    p, starts, symbols, counts = small
    w = at.Windows.cut(symbols, counts, 3)
    for scale in (1, 2):
        q = {k: (v * scale if k in ("group", "symbol") else v) for k, v in p.items()}
        one = [float(at.Pass(q, starts, w, np.array([i])).logp.sum()) for i in range(len(w.first))]
        assert np.allclose(np.bincount(w.text, one), at.Scorer(q, starts)(w), rtol=1e-3)
        grads = at.Pass(q, starts, w, np.arange(len(w.first))).gradients()
        assert grads.keys() == q.keys() and all(g.shape == q[k].shape and np.isfinite(g).all() for k, g in grads.items())
