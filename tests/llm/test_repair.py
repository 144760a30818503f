"""Repairs against a search over whole sequences, one message at a time."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np

from conftest import SF_DIR
from tidemark.llm import paths, repair
from tidemark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def best(rows):
    """(cost, audit, lines) by trying every edit of every message."""
    n = len(rows)

    @functools.lru_cache(maxsize=None)
    def go(i, last, inserted):
        found = []
        if i == n and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 2:
            for role in ("user", "assistant"):
                if (role[0] == "u") == (last in ("", "s", "a")):
                    c, a, t = go(i, role[0], inserted + 1)
                    found.append((c + 3, "I" + a, (role + ":",) + t))
        if i < n:
            role, text, fault = rows[i]
            c, a, t = go(i + 1, last, 0)
            found.append((c + 4, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for letter, new, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    first = new[:1]
                    if (first == "s" and last == "") or (first == "u" and last in ("", "s", "a")) or (first == "a" and last == "u"):
                        c, a, t = go(i + 1, first, 0)
                        found.append((c + cost + more, letter + a, (new + ":" + text,) + t))
        return min(found) if found else (10 ** 9, "", ())

    return go(0, "", 0)


def plain(rows):
    """Of rows (conv, turn, role, text) after any damage: a row per conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
        seen, marked = set(), []
        for _, role, text in turns:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = best(tuple(marked))
        out[conv] = (conv, gaps, *(sum(m[2] == k for m in marked) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))
    return out


def as_plain(rows):
    return sorted(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows), key=str)


def check(spark, rows):
    found = repair.repairs(spark.createDataFrame(rows, SCHEMA))
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert as_plain(found.collect()) == sorted(plain(spaced).values(), key=str)


def random_rows(rng, convs, most):
    texts = ["Yes.", "No", "Why?", "", "  \t", None, "Ok!", "a.\x0b ", "b ", "x. y", "Ünï."]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "Assistant", "ugly"]
    return [(rng.choice([None, c]) if c == 0 else c, rng.choice([None, *range(most)]), rng.choice(roles), rng.choice(texts))
            for c in range(convs) for _ in range(rng.randrange(1, most))]


def test_random_conversations(spark):
    check(spark, random_rows(random.Random(3), 300, 9))


def test_cut_lanes():
    """Conversations over many lanes and units give what they give whole (the kernels run here, in one process)."""
    rng = random.Random(5)
    for n, lane in ((1, 1), (7, 2), (40, 3), (40, 64), (200, 7)):
        initial = np.array([rng.choice([0, 1, 2, 3]) for _ in range(n)])
        forced, cut = (np.array([rng.random() < 0.2 for _ in range(n)]) for _ in range(2))
        copies = np.array([rng.choice([1, 1, 1, 3]) for _ in range(n)])
        whole = paths.entries(initial, forced, cut, copies, np.zeros(n, int), 1)
        want = paths.least(whole, paths.AT_END[None], np.array([0]), np.array([0]))
        number = np.arange(n) // lane
        e = paths.entries(initial, forced, cut, copies, number, number[-1] + 1)
        m, goal = paths.matrices(e), np.tile(paths.AT_END, (e.lanes, 1))
        for i in range(e.lanes - 2, -1, -1):
            goal[i] = (m[i + 1] + goal[i + 1]).min(axis=1)
        assert (m[0, 0] + goal[0]).min() == paths.costs(whole, paths.AT_END[None, None])[0, 0, 0]
        state, audit = 0, b""
        for i in range(e.lanes):
            got = paths.least(e, goal, np.array([i]), np.array([state]))
            state, audit = int(got.exits[0]), audit + got.audits[0]
        assert (audit, state) == (want.audits[0], int(want.exits[0]))


def test_long_conversation(spark):
    """3,000 messages: three lanes, compared with one lane; audits hold every message."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"Text {t}" + rng.choice([".", "", "!"])) for t in range(3000)]
    rows += [(2, 0, "user", "Same.")] * 3000
    found = {r.conv_id: r for r in repair.repairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    rank = {"s": 0, "u": 1, "a": 2}
    mine = rows[:3000]
    e = paths.entries(np.array([rank[r[2][0]] for r in mine]), np.zeros(3000, bool), np.array([r[3][-1] not in ".!" for r in mine]),
                      np.ones(3000, int), np.zeros(3000, int), 1)
    want = paths.least(e, paths.AT_END[None], np.array([0]), np.array([0]))
    assert found[1].audit == want.audits[0].decode() + paths.TAILS[want.exits[0]]
    assert found[1].cost == paths.costs(e, paths.AT_END[None, None])[0, 0, 0]
    assert found[2].audit == "K" + "D" * 2999 + "I" and found[2].duplicate == 2999 and found[2].illegal == 2999
    assert found[2].repaired_sha256 == sha("user:Same.\nassistant:")


def test_every_row_null_and_one_key(spark):
    check(spark, [(None, None, None, None)] * 5 + [(4, None, "user", "Hi."), (4, None, "assistant", "Ho."), (4, 3, "user", "Long " * 100_000)])


def test_empty_and_clashing_columns(spark):
    assert repair.repairs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert repair.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "Hi.", 5, "x", "y"), (1, 1, "assistant", "Ho.", 6, "x", "z")]
    df = spark.createDataFrame(rows, SCHEMA + ", at int, audit string, known string")
    assert as_plain(repair.repairs(df).collect()) == list(plain([r[:4] for r in rows]).values())


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(20) for t in [None, *range(10)]]
    assert sorted(map(tuple, repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == sorted(plain_damage(rows), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(plain_damage(rows))
    none = (0, 0, 0, 0, 0, 0, "", sha(""))
    got = as_plain(QUERIES["op13_conversation_repair"](spark, SF_DIR).collect())
    assert got == sorted((want.get(c, (c, *none)) for c in {r[0] for r in rows}), key=str)
