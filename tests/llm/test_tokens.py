"""Token ids, token files and packing against plain encoding."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF_DIR
from tidemark.llm import packing, token_files
from tidemark.llm.queries import op3_token_files, op7_best_fit_packing, tokenizer_path
from tidemark.llm.tokens import BYTE_LEVEL, WORD_END, Encoder

CASES = {"byte_bpe_50k.json": BYTE_LEVEL, "word_bpe_49k.json": WORD_END}
ALPHABET = "ab Zé́ 　\n\t\r'sS_0²Ⅷ.,!<|>\x01\x1f-endoftxĀΣσİ漢字😀"


@pytest.fixture(scope="module", params=CASES)
def pair(request):
    path = tokenizer_path(request.param)
    return Encoder(path, CASES[request.param]), Tokenizer.from_file(path)


def plain(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


def split(ids, counts):
    return [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=25), min_size=1, max_size=6))
def test_pieces_give_the_ids_of_the_text(pair, texts):
    mine, theirs = pair
    assert split(*mine.encode(texts)) == [plain(theirs, t) for t in texts]


@pytest.mark.parametrize("text", ["", " ", "a  b", "it's o'clock '90s", "x <|endoftext|> y", "a\n\n b \n", "éá,b", "²3 a²4", "a'sun !'sun"])
def test_odd_texts(pair, text):
    mine, theirs = pair
    assert split(*mine.encode([text, "z", text])) == [plain(theirs, t) for t in (text, "z", text)]


def test_any_unicode(pair):
    mine, theirs = pair
    rng = np.random.default_rng(3)
    texts = ["".join(chr(c) for c in rng.integers(1, 0x3100, 40) if not 0xD800 <= c < 0xE000) for _ in range(300)]
    assert split(*mine.encode(texts)) == [plain(theirs, t) for t in texts]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_coding_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = token_files.encode_ranks(ranks)
    assert len(control) == -(-len(values) // 4)
    assert token_files.decode_ranks(control, data, len(values)).tolist() == values


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_query(spark):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    want, start = [], 0
    for d, t in docs:
        ids = plain(tok, t or "") + [2]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, op3_token_files(spark, SF_DIR).collect())) == want


def test_token_files_of_odd_rows(spark, tmp_path):
    tok = tokenizer_path("word_bpe_49k.json")
    docs = spark.createDataFrame([(3, "b", 1), (None, "n", 1), (1, None, 1), (1, "", 2), (7, "word " * 5000, 3)], "doc_id long, text string, range int")
    token_files.write(docs, str(tmp_path / "a"), tok, shards=3)
    rows = token_files.read_files(spark, str(tmp_path / "a"), with_ids=True).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, 2), (1, 1), (1, 1), (3, 2), (7, 5001)]
    assert rows[1].ids == [2] and [r.start for r in rows] == [0, 2, 3, 4, 6]
    token_files.write(docs.limit(0), str(tmp_path / "b"), tok)
    assert token_files.read_files(spark, str(tmp_path / "b")).count() == 0


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_query(spark):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = op7_best_fit_packing(spark, SF_DIR).collect()
    used = check_packing(rows, 1024)
    assert used <= -(-sum(r.length for r in rows) // 1024) + 1
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).append(r)
    for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = plain(tok, d.text or "") + [2]
        parts = got.pop(d.doc_id)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.length == 1024 for p in parts[1:]) and (len(ids) > 1024 or len(parts) == 1)
        at = 0
        for p in parts:
            assert (p.start, p.ids_crc32) == (at, crc(ids[at:at + p.length]))
            at += p.length
        assert at == len(ids)
    assert not got


def test_packing_of_odd_rows(spark):
    tok = tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "", 0), (2, "a b c", 5)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, tok, size=4, with_ids=True).collect()
    assert check_packing(rows, 4) == 2 and len(rows) == 4
    assert sorted(len(r.ids) for r in rows) == [1, 1, 1, 4]
    assert packing.pack_documents(docs.limit(0), tok).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_places_everything_once(counts):
    p = packing.plan(counts, 30)
    ends = np.append(p.first[1:], 0)
    last = np.append(p.length[1:] != p.length[:-1], True) if len(p.length) else np.zeros(0, bool)
    uses = np.where(last, [counts.get(int(n), 0) for n in p.length], ends) - p.first
    assert (uses > 0).all() and {int(n) for n in p.length} == set(counts)
    places = sorted((int(s) + k, int(o), int(n)) for s, o, n, u in zip(p.sequence, p.offset, p.length, uses) for k in range(int(u)))
    assert len({s for s, _, _ in places}) == p.sequences
    at, now = 0, None
    for s, o, n in places:
        at = 0 if s != now else at
        assert o == at
        at, now = at + n, s
        assert at <= 30
    total = sum(k * n for k, n in counts.items())
    assert p.sequences >= -(-total // 30)


def test_two_fit_replaces_the_smallest():
    # greedy: 6 + 3 leaves 1; replacing 3 by 2 + 2 fills the bin
    p = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(p.length[p.sequence == 0].tolist()) == [2, 2, 6]


def test_a_word_is_cut_into_pieces_once():
    e, looked = Encoder(tokenizer_path("word_bpe_49k.json"), WORD_END), []
    find, e.find = e.find, lambda text: looked.append(text) or find(text)
    texts = ["One-two, three; one-two, x1 " * 50] * 20
    got = split(*e.encode(texts))
    assert got == [plain(e.tokenizer, t) for t in texts]
    assert sorted(looked) == ["one-two,", "three;", "x1"]
    e.encode(texts)
    assert len(looked) == 3


def test_words_and_pieces_start_anew(monkeypatch):
    e = Encoder(tokenizer_path("word_bpe_49k.json"), WORD_END)
    monkeypatch.setattr("tidemark.llm.tokens.MAX_WORDS", 2)
    for pieces in (400_000, 1):
        monkeypatch.setattr("tidemark.llm.tokens.MAX_PIECES", pieces)
        for text in ("one, two. three", "three two, four", "one <|x|> four", "two, two. one"):
            assert split(*e.encode([text, ""])) == [plain(e.tokenizer, text), []]
