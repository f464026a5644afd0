"""Items that many rows hold, and items longer than a passage."""

from __future__ import annotations

import random

import pytest

from lakemill.llm import op06_decontamination as D
from tests.llm.helpers import documents, prose


def inserted(r: random.Random, words: int, item: list[str]) -> str:
    own = prose(r, words).split()
    at = r.randrange(len(own))
    return " ".join(own[:at] + item + own[at:])


@pytest.mark.parametrize("every", [1, 3])
def test_an_item_that_a_third_or_all_of_the_rows_hold(spark, every):
    r = random.Random(31)
    items = [(i, prose(r, 25) + ". " + prose(r, 8) + ".") for i in range(20)]
    rows = [(i, inserted(r, 120, items[4][1].split()) if i % every == 0 else prose(r, 150)) for i in range(150)]
    rows += [(1000 + i, inserted(r, 120, items[7][1].split())) for i in range(3)]
    out = D.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), dimensions=32)
    got = {x["doc_id"]: x["item_id"] for x in out.where("contaminated").collect()}
    assert got == {i: 4 if i < 1000 else 7 for i, _ in rows if i % every == 0 or i >= 1000}


def test_items_longer_than_a_passage(spark):
    r = random.Random(32)
    items = [(n, prose(r, n)) for n in (33, 59, 160, 200, 300, 700)]
    rows, want = [(i, prose(r, 400)) for i in range(60)], {}
    for k, (n, text) in enumerate(items):
        words = text.split()
        for j, part in enumerate((words, words[: n * 2 // 3 + 1], words[n - n * 2 // 3 - 1 :], words[: n // 2 - 10])):
            rows.append((100 * (k + 1) + j, inserted(r, 300, part)))
            want |= {100 * (k + 1) + j: n} if j < 3 else {}
    out = D.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), dimensions=64)
    assert {x["doc_id"]: x["item_id"] for x in out.where("contaminated").collect()} == want


def test_pieces_cover_an_item():
    for n in (1, 31, 32, 33, 48, 49, 160):
        starts = D.starts_of(n)
        assert {x for a in starts for x in range(a, min(n, a + D.PASSAGE))} == set(range(n))


def subsequence(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_against_every_stretch_of_every_text(spark):
    """The rule itself, by brute force: what is found obeys it, and nearly all that obeys it is found."""
    r = random.Random(33)
    items = [(f"id-{i}", prose(r, 20) + (". " + prose(r, 6) + "." if i % 2 else "")) for i in range(12)]
    rows = []
    for i in range(160):
        words = r.choice(items)[1].replace(".", "").split()
        kept = [w if r.random() < r.choice([0.45, 0.75, 1.0]) else "other" for w in words]
        rows.append((i, inserted(r, 80, kept)))
    want: dict[int, set] = {}
    for d, text in rows:
        own = text.split()
        for n, item in items:
            words, answer = item.replace(".", "").split(), item.split(". ")[1].replace(".", "").split() if ". " in item else []
            for at in range(0, len(own), 4):
                part = own[at : at + 2 * len(words)]
                share = subsequence(words, part) / len(words)
                if share >= D.ALONE or share >= D.WITH_ANSWER and answer and subsequence(answer, part) >= 0.8 * len(answer):
                    want.setdefault(d, set()).add(n)
    out = D.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id string, text string"), block_items=5)
    got = {x["doc_id"]: x["item_id"] for x in out.where("contaminated").collect()}
    assert all(d in want and n in want[d] for d, n in got.items())
    assert len(want) > 60 and len(got) >= 0.9 * len(want)


def test_short_items_need_the_whole_text(spark):
    items = spark.createDataFrame([(1, "paris"), (2, "two words here")], "item_id long, text string")
    rows = [(1, "in paris we met"), (2, "Paris!"), (3, "two words here"), (4, "two words here and more")]
    out = D.find_leaks(documents(spark, rows), items).where("contaminated").collect()
    assert {x["doc_id"]: x["item_id"] for x in out} == {2: 1, 3: 2}
