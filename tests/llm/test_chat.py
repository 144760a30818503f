"""Perspectives against plain rendering of whole dialogues."""

from collections import defaultdict

from conftest import SF_DIR
from tidemark.llm.chat import perspectives
from tidemark.llm.common import read


def plain(rows, per_part=64):
    """Rows of parts; offsets run through the whole dialogue."""
    said, people = defaultdict(set), defaultdict(set)
    for conv, turn, role, text in rows:
        role, part = role or "unknown", -1 if turn is None else turn // per_part
        said[conv].add((part, turn is not None, turn or 0, role, text or ""))
        if role != "system":
            people[conv].add(role)
    out = []
    for conv, messages in said.items():
        for who in people[conv]:
            at, parts = 0, {}
            for part, _, _, role, body in sorted(messages):
                start, n, text, spans = parts.get(part, (at, 0, "", []))
                head = "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user name={role}|>\n"
                if role == who:
                    spans = [*spans, (at + len(head), at + len(head) + len(body))]
                line = head + body + "<|end|>\n"
                parts[part] = (start, n + 1, text + line, spans)
                at += len(line)
            out += [(conv, who, part, *rest) for part, rest in parts.items()]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.conv_id, r.perspective, r.part, r.start, r.n_messages, r.text, [tuple(s) for s in r.spans]) for r in df.collect()), key=str)


def whole(rows):
    """Text and spans of every dialogue, its parts joined."""
    out = defaultdict(lambda: ["", []])
    for conv, who, _, start, _, text, spans in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        assert len(out[(conv, who)][0]) == start
        out[(conv, who)][0] += text
        out[(conv, who)][1] += spans
    for text, spans in out.values():
        assert all(text[:a].endswith("<|assistant|>\n") and text[b:].startswith("<|end|>") for a, b in spans)
    return dict(out)


def test_whole_table(spark):
    table = read(spark, SF_DIR, "conversations")
    got = rows_of(perspectives(table))
    assert got == plain([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert len(whole(got)) == len({r[:2] for r in got})


def test_odd_rows(spark):
    rows = [(1, 0, "alice", "hi"), (1, 1, "bob", "é漢😀"), (1, 1, "bob", "é漢😀"), (1, 1, "alice", "tie"), (1, 2, "carol", None), (1, 200, "bob", "late"),
            (1, -1, "bob", "early"), (1, None, "alice", "no turn"), (2, 0, "system", "alone"), (None, 0, None, "who"), (None, 1, "", "who again"), (3, 0, "x", "long " * 5000)]
    rows += [(4, t, f"p{t % 5}", "same") for t in range(300)]
    table = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, part string")
    assert rows_of(perspectives(table)) == plain(rows)
    assert rows_of(perspectives(table, 8)) == plain(rows, 8)
    assert perspectives(table.limit(0)).count() == 0


def test_a_long_dialogue_is_one_text_however_it_is_stored(spark):
    rows = [(7, 0, "system", "rules")] + [(7, t, "ab"[t % 2] * (1 + t % 3), f"turn {t}") for t in range(1, 1001)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = (whole(rows_of(perspectives(table, n))) for n in (64, 5000))
    assert a == b and len(a) == 6
    assert all(text.startswith("<|system|>\nrules<|end|>\n") and sum(text[s:e].startswith("turn") for s, e in spans) == len(spans) for text, spans in a.values())
