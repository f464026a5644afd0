"""Benchmark leaks: planted, changed and absent ones."""

from __future__ import annotations

import random
import re

from lakemill.llm import op06_decontamination as D
from tests.llm.helpers import documents, odd_rows, prose


def planted():
    r = random.Random(9)
    items = [(i, prose(r, 25) + ". " + prose(r, 8) + ".") for i in range(30)]
    rows, leaked = [], set()
    for i in range(200):
        text = prose(r, r.randrange(20, 300))
        if i % 10 == 0:
            words = text.split()
            words[len(words) // 2 : len(words) // 2] = items[i % 30][1].split()
            text, leaked = " ".join(words), leaked | {i}
        elif i % 10 == 5:  # a few words changed, and the case
            item = items[i % 30][1].split()
            for k in range(3, len(item), 9):
                item[k] = "changed"
            text, leaked = text + " " + re.sub("[a-z]", lambda m: m[0].upper(), " ".join(item)), leaked | {i}
        rows.append((i, text))
    return items, rows, leaked


def test_finds_planted_leaks_and_leaves_the_rest(spark):
    items, rows, leaked = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (2000, 7):
        out = D.find_leaks(documents(spark, rows), bench, block_items=block, dimensions=32).collect()
        got = {r["doc_id"] for r in out if r["contaminated"]}
        assert len(out) == len(rows) and got == leaked
        assert all(r["item_id"] == r["doc_id"] % 30 for r in out if r["doc_id"] in leaked)


def test_odd_rows_empty_tables_and_other_columns(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "one two three four five six seven eight. nine ten eleven"), (3, "one two three four five six seven eight. nine ten eleven")], "item_id long, text string")
    df = documents(spark, [(d, t, "mine") for d, t in [*odd_rows(), (9, "x one two three four five six seven eight nine ten eleven")]], "doc_id long, text string, share string")
    out = D.find_leaks(df, bench, names=("i", "s", "c"))
    assert out.columns == ["doc_id", "text", "share", "i", "s", "c"]
    assert [r["doc_id"] for r in out.where("c").collect()] == [9] and out.count() == len(odd_rows()) + 1
    assert D.find_leaks(df, bench.limit(0)).where("contaminated").count() == 0
    assert D.find_leaks(df.limit(0), bench).count() == 0


def test_common_subsequence():
    masks = D.masks_of([1, 2, 3, 4, 2])
    assert D.common_subsequence([9, 1, 3, 2, 7], masks, 5) == 3 and D.common_subsequence([], masks, 5) == 0 and D.common_subsequence([1, 2, 3, 4, 2], masks, 5) == 5


def test_short_items_leak_where_they_stand_whole(spark):
    items = spark.createDataFrame([(1, "Paris, France"), (2, "the"), (3, "one two three four")], "item_id long, text string")
    texts = ["she went to paris france today", "paris in france", "the", "the cat", "zero one two three. four five", "one two three", None, ""]
    rows = D.find_leaks(documents(spark, list(enumerate(texts))), items).orderBy("doc_id").collect()
    assert [r["item_id"] if r["contaminated"] else None for r in rows] == [1, None, 2, None, 3, None, None, None]
