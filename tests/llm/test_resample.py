"""Resampling against its rule worked out in Python, and the suffix array's parts against plain ones."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.llm import op11_resample as R
from tests.llm.helpers import documents, odd_rows, prose


def features(text):
    low = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target):
    def counts(texts):
        c = np.zeros(10_000, np.int64)
        for t in texts:
            for f in features(t)[1]:
                c[zlib.crc32(f.encode()) % 10_000] += 1
        return c

    s, t = counts(r[1] for r in rows), counts(target)
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(s.sum()) + 10_000) / ((float(s[b]) + 1) * (float(t.sum()) + 10_000)))) for b in range(10_000)]
    out = []
    for doc, text in rows:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((len(words), doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    open_ = sorted((r for r in out if r[0] >= 20), key=lambda r: (-r[4], r[1] is not None, r[1] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(open_[: 5 * len(open_) // 100])}
    return sorted(((*r[1:], rank.get(id(r))) for r in out), key=repr)


def rows_of(seed, n):
    r = random.Random(seed)
    common = prose(r, 60)
    rows = [(i, r.choice([common + " ", ""]) + prose(r, r.randint(0, 60)) + r.choice(["", " A.B-c'D é_9", "x" * 300, "\n\x7f"])) for i in range(n)]
    return rows + [x for x in odd_rows() if x[0] is None or x[0] > 5 or x[0] < 5], [prose(r, 50), common, None, ""]


def test_equals_plain(spark, tmp_path):
    rows, target = rows_of(4, 150)
    documents(spark, [(*r, 1, "x") for r in rows], "doc_id long, text string, score int, open string").write.parquet(str(tmp_path / "documents.parquet"))
    documents(spark, [(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r) for r in R.op11_resample(spark, str(tmp_path)).collect()), key=repr)
    assert got == plain(rows, target) and sum(r[4] is not None for r in got) >= 5


def test_small_arrays_and_long_texts_change_nothing(spark, monkeypatch):
    rows, _ = rows_of(5, 20)
    text = R.pa.array([r[1] for r in rows] + [prose(random.Random(2), 3000)])

    def sums():
        total = {}
        for row, found in R.stretches(text, 3, 10_000):
            for r, column in zip(row.tolist(), found.T.tolist(), strict=True):
                total.setdefault(r, []).append(column)
        return total

    whole = sums()
    monkeypatch.setattr(R, "ARRAY_BYTES", 500)
    monkeypatch.setattr(R, "ARRAY_WORDS", 7)
    assert sums() == whole


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffix_order_and_runs(depth):
    r = np.random.default_rng(depth)
    ids, rest = r.integers(1, 4, 300).astype(np.int32), np.tile(np.arange(10, 0, -1), 30)
    order = R.suffix_order(ids, rest, depth)
    suffix = [tuple(ids[i : i + min(depth, rest[i])]) for i in range(300)]
    assert [suffix[i] for i in order] == sorted(suffix)
    big = R.suffix_order(ids.astype(np.int64) * (1 << 40), rest, depth)  # keys of several words
    assert np.array_equal(big, order)
    for n, begins, whole in R.runs(ids, rest, order, depth):
        grams = [suffix[i][:n] for i in order if rest[i] >= n]
        assert len(begins) == len(set(grams)) and whole.sum() == len(grams)


def test_crc_of_joined_words():
    words = [b"", b"a", b"word", b"\xc3\xa9" * 40, b"z" * 5000]
    for w in words:
        crc = np.array([zlib.crc32(x) for x in words], np.uint32)
        got = R.appended(crc, np.full(len(words), zlib.crc32(b" " + w), np.uint32), np.full(len(words), len(w) + 1))
        assert got.tolist() == [zlib.crc32(x + b" " + w) for x in words]


def test_columns_pass_and_empty_table(spark):
    names = ("row", "id", "at", "part", "n", "before", "drawn", "weight", "rank", "a b")
    df = documents(spark, [(i, "w " * 30, *names) for i in range(40)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = R.resample(df, df, percent=10)
    rows = out.orderBy(F.col("rank").asc_nulls_last()).collect()
    assert len(rows) == 40 and [r["rank"] for r in rows[:5]] == [1, 2, 3, 4, None] and all(r["row"] == "row" and r["a b"] == "a b" and r["text"].startswith("w w") for r in rows)
    empty = documents(spark, [], "doc_id long, text string")
    assert R.resample(empty, empty).count() == 0
    assert R.resample(empty, df).count() == 0 and R.resample(df, empty).count() == 40


def test_query_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows, target = rows_of(6, 60)
    documents(spark, [r for r in rows if len(r[1] or "") < 10_000]).write.parquet(str(tmp_path / "documents.parquet"))
    documents(spark, [(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = R.op11_resample(spark, str(tmp_path))
    q = duckdb.connect().execute(R.SQL.format(documents=f"'{tmp_path}/documents.parquet/*.parquet'", benchmark=f"'{tmp_path}/benchmark.parquet/*.parquet'"))
    assert df.columns == [c[0] for c in q.description]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(q.fetchall(), key=repr)
