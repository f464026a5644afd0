"""Removal of repeated strings against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lakemill.llm import op02_suffix as S
from tests.llm.helpers import documents, odd_rows, prose


def brute(rows, length):
    seen: dict[int, int] = {}  # by hash: a long text's strings would fill the memory
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        for i in range(len(b) - length + 1):
            key = hash(b[i : i + length])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["text"])) for r in S.remove_repeats(df, **options).collect()), key=repr)


def corpus() -> list[tuple]:
    r = random.Random(3)
    shared = [prose(r, 90) for _ in range(3)]
    rows = [(i, prose(r, r.randrange(5, 120)) + (r.choice(shared) if i % 2 else "") + prose(r, r.randrange(5, 60))) for i in range(60)]
    rows += [(100, shared[0]), (101, shared[0]), (101, shared[0]), (102, "a" * 700), (103, "ab" * 300), (104, shared[1] + shared[1]), (105, shared[2][7:] + "x" + shared[2][:300])]
    return rows


@pytest.mark.parametrize("crowd", [1000, 2])
def test_equals_brute_force(spark, crowd):
    rows = corpus()
    assert found(documents(spark, rows), length=100, kmer=16, crowd=crowd, bucket_bytes=1 << 14) == brute(rows, 100)


def test_odd_rows(spark):
    rows = [*odd_rows(), (7, "z" * 399), (8, "z" * 399)]
    assert found(documents(spark, rows)) == brute(rows, 400)


def test_empty_table_and_other_columns(spark):
    assert found(documents(spark, [])) == []
    df = documents(spark, [(1, "x" * 500, 7)], "doc_id long, text string, n_bytes long")
    assert found(df)[0][1:3] == (500, 500)


def test_suffix_array_and_index():
    r = np.random.default_rng(1)
    parts = [r.integers(97, 100, n).astype(np.uint8) for n in (1, 50, 120, 7, 200)] + [np.frombuffer(b"abcabcabcabc" * 20, np.uint8)] * 2
    index = S.run_index(parts)
    marks = np.zeros(int(index["size"]) + 1, bool)
    for a, b in zip(*S.long_matches(index, 9), strict=True):
        marks[a:b] = True
    joined = [bytes(p) for p in parts]
    want = np.zeros_like(marks)
    for p, a in zip(joined, index["begin"], strict=True):
        for i in range(len(p) - 8):
            if sum(q[j : j + 9] == p[i : i + 9] for q in joined for j in range(len(q) - 8)) > 1:
                want[a + i : a + i + 9] = True
    assert (marks == want).all()
    assert len(index["symbol"]) < int(index["size"]) == index["times"].sum()


def test_the_compressed_transform_holds_the_text():
    """Walking backwards over the transform gives the segments again."""
    parts = [b"abracadabra" * 3, b"banana", b"abracadabra"]
    index = S.run_index([np.frombuffer(p, np.uint8) for p in parts])
    transform = np.repeat(index["symbol"], index["times"])
    order = np.argsort(np.where(transform < 0, -transform - int(index["size"]) - 1, transform), kind="stable")  # separators sort first, by place
    step = np.empty(len(order), np.int64)
    step[order] = np.arange(len(order))
    texts = []
    for k in range(len(parts)):  # the suffixes that begin with a separator come first, one of each segment's end
        at, out = k, bytearray()
        while transform[at] > 0:
            out.append(int(transform[at]) - 1)
            at = int(step[at])
        texts.append(bytes(out[::-1]))
    assert texts == parts


def test_suffixes_are_in_order():
    data = np.frombuffer(b"banana", np.uint8).astype(np.int64) + 1
    text = np.append(data, 0)
    order = S.suffix_array(text, np.arange(6, -1, -1))
    assert order.tolist() == [6, 5, 3, 1, 0, 4, 2]


def test_what_a_crowd_shares_is_a_row_a_context(spark):
    """Contexts of one anchor that share a passage: joins make a row for each, not one for each range of starts that it shares."""
    r = random.Random(8)
    shared = prose(r, 60)[:240]
    texts = [(prose(r, 30)[:100] + shared + prose(r, 40)[:160]).encode() for _ in range(40)]
    places = [(i, 0, max(0, 320 - 272), min(len(t), 320 + 128 + 272), 5, 320, t[max(0, 320 - 272) : 320 + 400]) for i, t in enumerate(texts)]
    rows = [(i, j, a, a + len(b), h, p, b) for i, j, a, _, h, p, b in places]
    contexts = spark.createDataFrame(rows, "rid long, rid2 long, at long, upto long, h long, pos long, bytes binary").cache()
    marks = S.crowd_marks(contexts, 100, 16).collect()
    assert len(marks) <= 3 * len(texts)
    covered = {i: set() for i in range(len(texts))}
    for m in marks:
        covered[m["rid"]] |= set(range(m["start"], m["end"]))
    last = 100 - 16
    strings = {i: {s: t[s : s + 100] for s in range(320 - last, 321) if s >= places[i][2] and s + 100 <= len(t)} for i, t in enumerate(texts)}
    times: dict = {}
    for own in strings.values():
        for s, b in own.items():
            times[320 - s, b] = times.get((320 - s, b), 0) + 1
    for i, own in strings.items():
        assert {x for s, b in own.items() if times[320 - s, b] > 1 for x in range(s, s + 100)} == {x for x in covered[i] if x < len(texts[i])}
