"""Chat formatting against a fold in Python, round trips and its SQL."""

from __future__ import annotations

import hashlib
import random

import pytest

from lakemill.llm import op12_chat as C
from tests.llm.helpers import documents

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"
TURNS = "conv_id long, turn long, role string, text string"
ODD = ["", "\\", "\\\\s", "### ", "#### ### x", "</turn>", "\n</turn>\n", "a\n### user\nb\\", "<</turn>>", "\\s\\h## \\l/turn>", "☃ 𝒳 ü"]


def folded(events):
    """The log taken event by event."""
    out = {}
    for conv in {e[0] for e in events}:
        turns = {}
        for _, _, kind, turn, role, text in sorted((e for e in events if e[0] == conv), key=lambda e: e[1]):
            if kind == "message":
                turns[turn] = [role, text]
            elif kind == "delta":
                turns.setdefault(turn, ["", ""])[1] += text
            elif kind == "edit":
                turns.setdefault(turn, ["", ""])[1] = text
            else:
                turns = {t: v for t, v in turns.items() if t <= turn}
                turns.setdefault(turn, ["", ""])[1] = ""
        out |= {(conv, t): tuple(v) for t, v in turns.items()}
    return out


def test_fold_equals_events_taken_one_by_one(spark):
    r = random.Random(3)
    events = []
    for conv in range(60):
        seq = 0
        for _ in range(r.randint(1, 40)):
            seq += r.randint(1, 3)
            kind = r.choices(["message", "delta", "edit", "regenerate"], [3, 6, 1, 1])[0]
            events.append((conv, seq, kind, r.randint(0, 5), r.choice(["user", "assistant"]) if kind == "message" else None, r.choice(["a", "bc", "d\n"]) if kind != "regenerate" else None))
    r.shuffle(events)
    got = {(x["conv_id"], x["turn"]): (x["role"], x["text"]) for x in C.reconstruct(documents(spark, events, EVENTS)).collect()}
    assert got == folded([(a, b, c, d, e or "", f or "") for a, b, c, d, e, f in events])


def test_logs_with_nulls_and_repeated_events(spark):
    log = [(None, 1, "message", 0, "user", None), (None, 2, None, 0, None, "x"), (None, 2, None, 0, None, "x"), (1, 1, "delta", None, "user", "no turn"), (1, None, "delta", 0, "user", "no seq"), (2, 5, "delta", 3, None, "y"), (2, 5, "edit", 3, None, "z")]
    assert {tuple(r) for r in C.reconstruct(documents(spark, log, EVENTS)).collect()} == {(None, 0, "user", "xx"), (2, 3, "", "zy")}
    assert C.reconstruct(documents(spark, [], EVENTS)).count() == 0


def test_texts_and_masks_come_back(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system\n\\n### "]), "".join(r.choice(ODD) for _ in range(r.randint(0, 6)))) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(90, 0, "assistant", "w\\### " * 40_000)]
    out = C.read_back(C.render(C.reconstruct(C.events_of(documents(spark, rows, TURNS), piece=3)))).collect()
    assert {x["conv_id"] for x in out} == {c for c, *_ in rows}
    for x in out:
        own = sorted((t, role, text) for c, t, role, text in rows if c == x["conv_id"])
        assert [tuple(t) for t in x["turns"]] == [(role, text) for _, role, text in own]
        assert x["learned"] == [text for _, role, text in own if role == "assistant"]
        assert x["formatted"].count("\n</turn>\n") == x["formatted"].count("### ") == len(own)


def test_query_equals_sql_and_plain_digests(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 0, "system", None, 7), (1, 1, "user", "hi", 7), (1, 2, "assistant", "### </turn> \\ yes\n", 7), (1, 2, "assistant", "### </turn> \\ yes\n", 7), (2, None, None, "x", 7), (2, 0, "assistant", "ü☃", 7), (None, 0, "user", "", 7), (None, 0, "assistant", "z", 7)]
    documents(spark, rows, TURNS + ", formatted int").write.parquet(str(tmp_path / "conversations.parquet"))
    df = C.op12_chat(spark, str(tmp_path))
    got = {tuple(r) for r in df.collect()}
    q = duckdb.connect().execute(C.SQL.format(conversations=f"'{tmp_path}/conversations.parquet/*.parquet'"))
    assert df.columns == [c[0] for c in q.description] and got == {tuple(r) for r in q.fetchall()}
    mine = next(r for r in got if r[0] == -7)
    text = r"\### Assistant: </turn> ok"
    assert mine[1:5] == (2, hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest())


def test_one_exchange_and_no_python(spark, tmp_path):
    documents(spark, [(1, 0, "user", "a")], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    plan = C.op12_chat(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Arrow" not in plan and "Python" not in plan


def test_empty_table_has_the_odd_conversation_only(spark, tmp_path):
    documents(spark, [], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r["conv_id"] for r in C.op12_chat(spark, str(tmp_path)).collect()] == [-7]
