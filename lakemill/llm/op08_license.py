"""Licence notices in texts: exact phrases and, with few errors, short notices.

A notice with at most k errors that is cut into k+1 pieces has a piece without
error, wherever the errors lie. The pieces of all notices stand in one
Aho-Corasick automaton; where a piece is found, the notice may stand around it,
and the regex library's fuzzy matching verifies that stretch with a bounded
number of errors and gives the span.
"""

from __future__ import annotations

from bisect import bisect, insort
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lakemill.llm.common import LOWER, extend, table, utf8

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license version 3": "gpl",
    "gnu general public license version 2": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl",
    "bsd 3 clause license": "bsd",
    "bsd 2 clause license": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution 4 0": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
}
#: One error for so many characters of a notice.
CHARS_PER_ERROR = 12

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TO_SPACE = bytes(int(LOWER[b]) if WORD_BYTE[LOWER[b]] else 0x20 for b in range(256))


def errors_of(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_ERROR)


def pieces_of(notice: str, errors: int) -> list[tuple[int, str]]:
    """The notice cut into errors+1 pieces of about the same length, with their places."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=1)
def machinery():
    """The automaton over the pieces, and each notice's pattern."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for n, notice in enumerate(NOTICES):
        errors = errors_of(notice)
        patterns.append(regex.compile(rf"(?b)(?:{regex.escape(notice, special_only=True)}){{e<={errors}}}"))
        for at, piece in pieces_of(notice, errors):
            seeds.setdefault(piece, []).append((n, at))
    automaton = ahocorasick.Automaton()
    for piece, places in seeds.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, patterns


def squeezed(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "replace")


def fuzzy_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, errors) of notices in a text of lower-case words with single spaces.

    Each seed's own surroundings are searched, once for each notice and place: they
    hold the notice and its errors but no second one, so the best match there is
    the notice that the seed is of, and time grows with the number of seeds. Of
    matches that overlap the one with fewest errors is kept, then the first.
    """
    automaton, patterns = machinery()
    notices = list(NOTICES)
    around: set[tuple[int, int, int]] = set()
    for last, (length, places) in automaton.iter(text):
        start = last + 1 - length
        for n, at in places:
            spare = errors_of(notices[n])
            around.add((n, max(0, start - at - spare), min(len(text), start - at + len(notices[n]) + spare)))
    found: set[tuple[int, int, int, str]] = set()
    for n, low, high in around:
        if m := patterns[n].search(text, low, high):
            found.add((sum(m.fuzzy_counts), m.start(), -m.end(), NOTICES[notices[n]]))
    kept: list[tuple[int, int, str, int]] = []
    for errors, a, b, label in sorted(found):  # of notices that overlap, that with fewest errors
        i = bisect(kept, (a, -b, label, errors))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= -b):
            insort(kept, (a, -b, label, errors))
    return kept


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Every place, in words, where a phrase's words stand consecutively."""
    found = []
    split = [(p.encode().split(), label) for p, label in PHRASES.items()]
    for i, w in enumerate(words):
        if w == b"license":
            for parts, label in split:
                start = i + 1 - len(parts)
                if start >= 0 and words[start : i + 1] == parts:
                    found.append((start, label))
    return sorted(found)


def scan(rows: pa.RecordBatch) -> list:
    column = rows.column(rows.schema.get_field_index("text"))
    data, starts = utf8(column)
    word = WORD_BYTE[LOWER[data]]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = starts[(starts > 0) & (starts < len(data))]
    begin[inner] = word[inner]
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begin, out=counts[1:])
    n_words = counts[starts[1:]] - counts[starts[:-1]]
    n_base, score = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
    first: list = [None] * rows.num_rows
    last: list = [None] * rows.num_rows
    base_labels, labels, spans = [""] * rows.num_rows, [""] * rows.num_rows, [""] * rows.num_rows
    raw = data.tobytes()
    automaton, _ = machinery()
    for i in range(rows.num_rows):
        if not n_words[i]:
            continue
        words = raw[starts[i] : starts[i + 1]].translate(_TO_SPACE).split()
        text = squeezed(words)
        places = phrase_places(words) if "license" in text else []
        fuzzy = fuzzy_spans(text) if next(automaton.iter(text), None) is not None else []
        if places:
            n_base[i], first[i], last[i] = len(places), places[0][0], places[-1][0]
            base_labels[i] = ",".join(sorted({label for _, label in places}))
        if places or fuzzy:
            labels[i] = ",".join(sorted({label for _, label in places} | {f[2] for f in fuzzy}))
            spans[i] = ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e in fuzzy)
            score[i] = 1.0 if places else max(1 - e / max(1, b - a) * 4 for a, b, _, e in fuzzy)
    return [
        pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels, pa.string()),
        pa.array(labels, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(spans, pa.string()),
    ]


ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def find_licenses(documents: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the licences that the documents name.

    n_words counts the words, n_base the places of phrases, first_word and
    last_word are the smallest and largest such place (else null), base_labels
    the phrases' labels, labels those and the notices' found with errors, spans
    the latter as label:start:end:errors in the lower-case words joined by
    single spaces, score 1 for a phrase and less for each error otherwise. A null or
    empty text has no words and no labels. Repeated rows are scanned alike, other
    columns pass through, a column named as an added one is replaced.
    """
    return extend(documents, scan, ADDED, drop)


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences."""
    return find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
