"""Phrase mining against its rule worked out in Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from lakemill.llm import op13_phrases as P
from tests.llm.helpers import documents, odd_rows


def plain(rows, fewest=10, percent=50, top=2000):
    freq, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            freq.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {}
    for (lang, g), a in freq.items():
        if len(g) > 1 and a >= fewest:
            cuts = [(1_000_000 * a * a // (freq[lang, g[:k]] * freq[lang, g[k:]]), k) for k in range(1, len(g))]
            s, k = min(cuts)
            found[lang, g] = (a, freq[lang, g[:k]], freq[lang, g[k:]], s)
    drop = {(lang, part) for (lang, g), v in found.items() if len(g) == 3 for part in (g[:2], g[1:]) if 100 * v[0] >= percent * found[lang, part][0]}
    out = []
    for lang in {x for x, _ in found}:
        own = sorted((-v[3], -v[0], " ".join(g).encode(), v) for (x, g), v in found.items() if x == lang and (x, g) not in drop)
        out += [(lang, i, p.decode(), v[0], v[1], v[2], total[lang], v[3]) for i, (_, _, p, v) in enumerate(own[:top], 1)]
    return sorted(out)


def rows_of(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "c\x00", "dé", "E's", "x|y", "z" * 90]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", "  \t", ". ", ",", "\n", "\r\n"]) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [(r.choice(["en", "en", "fr", None, "und"]), t) for t in texts] + [("en", t) for _, t in odd_rows() if t is None or len(t) < 99] + [("de", "one two three " * 12), ("de", "q one two. three. one two three")]


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_equals_plain(spark, monkeypatch, block):
    monkeypatch.setattr(P.candidates, "__defaults__", (P.FEWEST, P.CONTAINED_PERCENT, block))
    rows = rows_of(2, 150)
    df = documents(spark, [(*r, "x", 3) for r in rows], "lang string, text string, block string, n int").repartition(3)
    assert sorted(tuple(r) for r in P.phrases(df).collect()) == plain(rows)
    assert sorted(tuple(r) for r in P.phrases(df, fewest=3, percent=80, top=5).collect()) == plain(rows, 3, 80, 5)


def test_one_long_text_and_repeated_rows(spark):
    r = random.Random(7)
    rows = [("en", " ".join(r.choice("abcdefgh") for _ in range(30_000)))] + [("en", "same row of words")] * 400
    assert sorted(tuple(x) for x in P.phrases(documents(spark, rows, "lang string, text string")).collect()) == plain(rows)


def test_no_words_and_empty_tables(spark):
    for rows in ([], [(None, None), ("en", ""), ("en", " .,\n")], [("en", "a b c")]):
        assert P.phrases(documents(spark, rows, "lang string, text string")).count() == 0


def test_products_beyond_64_bits(spark):
    rows = [(4_000_000_000_000_000, 4_000_000_000_000_001, 5_000_000_000_000_000), (10, 10, 10), (10, 11, 13)]
    df = documents(spark, rows, "a long, l long, r long").select("a", "l", "r", P.score("a", "l", "r").alias("s"))
    assert all(x["s"] == 1_000_000 * x["a"] ** 2 // (x["l"] * x["r"]) for x in df.collect())


def test_query_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    documents(spark, rows_of(9, 120), "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = P.op13_phrases(spark, str(tmp_path))
    q = duckdb.connect().execute(P.SQL.format(documents=f"'{tmp_path}/documents.parquet/*.parquet'"))
    assert df.columns == [c[0] for c in q.description]
    assert sorted(tuple(r) for r in df.collect()) == sorted(q.fetchall())
