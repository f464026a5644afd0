"""Licences and personal data: spans against brute force, disguises, odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from lakemill.llm import op08_license as L
from lakemill.llm import op10_pii as P
from tests.llm.helpers import documents, odd_rows, prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def test_base_spans_equal_the_patterns(spark):
    r = random.Random(2)
    bits = ["a@b.c", "a@b", "@", "x.y@z-1.example.com.", "1.2.3.4", "1.2.3.256", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2030", "+1", "+12 345 678 901 234 567", "é@b.c", "😀 a@b.co", "a@b.c@d.e", "٣.1.2.3"]
    rows = [(i, "".join(r.choice([r.choice(bits), r.choice(bits), " ", "x", "7", ".", "+", "\n", prose(r, 2)]) for _ in range(30))) for i in range(300)]
    for r_ in P.find_personal_data(documents(spark, rows)).collect():
        want = base(r_["text"])
        assert r_["base_sha256"] == hashlib.sha256(P.listed(want).encode()).hexdigest()
        assert [r_[f"n_{k}"] for k in P.KINDS] == [sum(kind == k for _, kind, _ in want) for k in range(4)]
        assert set(P.listed(want).split(",")) - {""} <= set(r_["spans"].split(","))


@pytest.mark.parametrize(
    "text, span",
    [
        ("write to jane dot doe at example dot com please", "email:9:40"), ("jane [at] example [dot] org", "email:0:27"), ("jаne@exаmple.com", "email:0:16"), ("ｊａｎｅ@example.com", "email:0:16"), ("１９２.168.0.1", "ip:0:11"),
        ("call plus four four two zero seven nine four six zero nine", "phone:5:58"), ("four one one one 1111 1111 1111", "card:0:31"),
    ],
)
def test_disguises_are_mapped_back(text, span):
    base_, added = P.find_all(text, any(c in "0123456789" for c in text), True, True, True)
    assert span in P.listed(sorted([*base_, *added])).split(",")


@pytest.mark.parametrize("text", ["he was at home. dot com", "one two three", "at dot", "zero", "the dot at the end"])
def test_plain_prose_has_no_spans(text):
    assert P.find_all(text, False, True, True, True) == ([], [])


def test_odd_rows_for_both(spark):
    for f, column in ((P.find_personal_data, "spans"), (L.find_licenses, "labels")):
        df = documents(spark, [(d, t, "mine") for d, t in odd_rows()], "doc_id long, text string, spans string")
        rows = f(df, drop=("text",)).collect()
        assert len(rows) == len(odd_rows()) and all(r[column] == "" for r in rows)
        assert f(df.limit(0)).count() == 0


def test_long_runs_are_linear():
    import time

    start = time.perf_counter()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "a@" * 100_000, "one " * 60_000, " at " * 60_000, "a dot " * 50_000):
        P.find_all(text, True, True, True, True)
        L.fuzzy_spans(text)
    assert time.perf_counter() - start < 60


def test_a_megabyte_takes_seconds():
    import time

    notice = "released under the mit license "
    for f, text in (
        (L.fuzzy_spans, notice * 34_000), (L.fuzzy_spans, "released undr the mit licanse " * 34_000), (rewritten, "ab12" * 250_000 + " @ example.com"), (rewritten, "x @ " + "ab12" * 250_000), (rewritten, "a at b dot " * 90_000),
        (rewritten, " " * 1_000_000 + "at b.c"), (rewritten, "a.b " * 250_000 + "@ c.d"), (rewritten, "1 dot " * 160_000 + "x @ y.z"),
    ):
        start = time.perf_counter()
        f(text)
        assert time.perf_counter() - start < 20


def rewritten(text):
    return P.rewrite(text).text


GAP, BLANKS = r"\s{0,3}", r"\s{1,3}"
SLOW_DOT = rf"(?:\.|{GAP}[\[({{<]{GAP}(?:dot|\.){GAP}[\])}}>]{GAP}|{BLANKS}dot{BLANKS})"
SLOW_AT = rf"(?:@|{GAP}[\[({{<]{GAP}(?:at|@){GAP}[\])}}>]{GAP}|{BLANKS}at{BLANKS}|{GAP}@{BLANKS}|{BLANKS}@{GAP})"
SLOW_ADDRESS = re.compile(rf"(?i)[A-Za-z0-9_%+-]+(?:{SLOW_DOT}[A-Za-z0-9_%+-]+){{0,4}}{SLOW_AT}[A-Za-z0-9-]+(?:{SLOW_DOT}[A-Za-z0-9-]+){{1,4}}")


def test_addresses_equal_a_plain_pattern():
    r, bits = random.Random(9), ["jane", "x1", "example", "com", ".", " dot ", "[dot]", " (.) ", "@", " @ ", " at ", "[at]", " ", ", ", "and", "\n", "jane", "doe", "example", "org"]
    hits = 0
    for _ in range(12000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(3, 14)))
        want = [m.span() for m in SLOW_ADDRESS.finditer(text)]
        if sum(text.count(c) for c in "@") + len(re.findall(r"\bat\b", text)) <= 1 and text.count(".") + text.count("dot") <= 5:  # with more signs, where the pattern begins is its own affair
            assert [b for _, b in P.addresses(text)] == [b for _, b in want], text
            assert all(P._DOT.sub("", text[a:b]) == P._DOT.sub("", text[c:d]) or a >= c for (a, b), (c, d) in zip(P.addresses(text), want, strict=True))
            hits += len(want)
    assert hits > 60


def nearest_end(notice, text):
    """Ends in the text at which the notice stands with the fewest errors, and those errors: the column-wise table of edit distances."""
    row = list(range(len(notice) + 1))
    out = []
    for c in text:
        new = [0]
        for i, n in enumerate(notice, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (c != n)))
        row = new
        out.append(row[-1])
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_notices_equal_tables_of_edit_distances():
    r = random.Random(4)
    notices = list(L.NOTICES)
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            notice = list(r.choice(notices))
            for _ in range(r.randrange(0, 4)):
                at = r.randrange(len(notice))
                notice[at : at + 1] = r.choice([[], ["q"], [notice[at], "e"]])
            parts += ["".join(notice), *(prose(r, 2).lower().split() if r.random() < 0.5 else [])]
        text = " ".join(parts)
        spans = L.fuzzy_spans(text)
        for a, b, label, errors in spans:
            assert any(L.NOTICES[n] == label and errors <= L.errors_of(n) and distance(n, text[a:b]) == errors for n in notices)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        for n in notices:
            for end, errors in enumerate(nearest_end(n, text), 1):
                if errors <= L.errors_of(n):  # every place of a notice is in a span or beside one that is no worse
                    assert any(a < end <= b + L.errors_of(n) + len(n) and b > end - len(n) - errors for a, b, _, e in spans), (n, text, end)


def test_side_by_side_notices_are_both_found():
    spans = L.fuzzy_spans("x y released under the mit licanse released under the mit license z")
    assert [(a, b, e) for a, b, _, e in spans] == [(4, 34, 1), (35, 65, 0)]


def test_redaction(spark):
    df = documents(spark, [(1, "mail a@b.co or 1.2.3.4 now", 26), (2, None, None), (3, "none", 4)], "doc_id long, text string, n_chars int")
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.redact(df).collect()}
    assert rows == {1: ("mail <email> or <ip> now", 24), 2: (None, None), 3: ("none", 4)} and P.redact(df).schema == df.schema


def phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return words, sorted((i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def test_phrases_equal_brute_force(spark):
    r = random.Random(7)
    bits = ["MIT License", "mit-license", "the Apache   LICENSE", "general public license", "GNU General. Public, License", "mit licenses", "mitlicense", "license", "é license", "mit ☃ license", "x"]
    rows = [(i, " ".join(r.choice([r.choice(bits), prose(r, 2)]) for _ in range(12))) for i in range(200)]
    for x in L.find_licenses(documents(spark, rows)).collect():
        words, places = phrases(x["text"])
        assert (x["n_words"], x["n_base"]) == (len(words), len(places))
        assert (x["first_word"], x["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert x["base_labels"] == ",".join(sorted({label for _, label in places})) and set(x["base_labels"].split(",")) - {""} <= set(x["labels"].split(","))
        assert 0 <= x["score"] <= 1


@pytest.mark.parametrize("text, label", [("released undr the mit licence", "mit"), ("licensed under the apche license verson 2 0", "apache"), ("licensed under cc by nc 4 0", "cc-by-nc"), ("gnu lesser generl public license", "lgpl")])
def test_notices_with_errors(text, label):
    assert [f[2] for f in L.fuzzy_spans("so " + text + " it is")] == [label]


def test_pieces_cover_the_notice():
    for notice in L.NOTICES:
        pieces = L.pieces_of(notice, L.errors_of(notice))
        assert "".join(p for _, p in pieces) == notice and len(pieces) == L.errors_of(notice) + 1
