"""Personal data found in texts, also where it is disguised, with spans in the source's code points.

Base detectors look at the text as it is. Then transducers rewrite the text and
keep, for every character they write, the stretch of source characters it stands
for: look-alike letters and digits of other scripts become ASCII, runs of
spelled digits become digits, and spelled at and dot signs between address parts,
or dot signs between groups of digits, become the signs. The same detectors read
the rewritten text; what they find is mapped back to source characters and added
where no base span lies.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakemill.llm.common import extend, table, utf8

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Begins at the start of a run of digits: from inside the run nothing matches that doesn't match from its start.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "АВЕКМНОРСТУХІЈЅԚԜ": "ABEKMHOPCTYXIJSQW",
    "авекмнорстухіјѕԛԝһԁ": "abekmhopctyxijsqwhd",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "αειικνορτυχ": "aeiiknoptux",
    "‐‑‒–—−": "------",
    "․。｡": "...",
}
#: Spelled digits.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Fewest spelled digits in a row that are taken for a number.
FEWEST_SPELLED = 4

_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
_SPELLED = re.compile(rf"(?i)(?<![A-Za-z]){_DIGIT}(?:[\s,.-]{{1,3}}{_DIGIT}(?![A-Za-z])){{{FEWEST_SPELLED - 1},}}(?![A-Za-z])")
_ONE_DIGIT = re.compile(rf"(?i){_DIGIT}")
_PLUS = re.compile(r"(?i)(?<![A-Za-z])plus\s+(?=[0-9])")
#: A spelled sign has at most so many blanks inside and on each side; so no search takes longer than a text's length asks for.
_GAP, _BLANKS = r"\s{0,3}", r"\s{1,3}"
_BRACKETED_AT, _BRACKETED_DOT = (rf"{_GAP}[\[({{<]{_GAP}(?:{sign}){_GAP}[\])}}>]{_GAP}" for sign in ("at|@", r"dot|\."))
_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9])(?:{_BRACKETED_AT}|{_BLANKS}at{_BLANKS}|{_GAP}@{_BLANKS}|{_BLANKS}@{_GAP})(?=[A-Za-z0-9])")
_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9])(?:{_BRACKETED_DOT}|{_BLANKS}dot{_BLANKS})(?=[A-Za-z0-9])")
#: Holds in every text in which an address or digit groups have a spelled sign.
_WORDED = re.compile(rf"(?i)[\[({{<]{_GAP}(?:dot|\.|at|@){_GAP}[\])}}>]|\sdot\s|\s@|@\s|\sat{_BLANKS}[A-Za-z0-9-]++\.[A-Za-z0-9-]")
#: Where an address may have its at sign, plain or spelled.
_ANY_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])(?:@|{_BRACKETED_AT}|{_BLANKS}at{_BLANKS}|{_GAP}@{_BLANKS}|{_BLANKS}@{_GAP})(?=[A-Za-z0-9-])")
_ANY_DOT = rf"(?:\.|{_BRACKETED_DOT}|{_BLANKS}dot{_BLANKS})"
#: What follows the at sign: parts with at least one dot, plain or spelled.
_AFTER_AT = re.compile(rf"(?i)[A-Za-z0-9-]++(?:{_ANY_DOT}[A-Za-z0-9-]++){{1,4}}")
#: Characters of a local part between dots, and the most dots in one.
_PART, _PARTS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-"), 4
#: Groups of digits with spelled or plain dots between them.
_GROUPS = re.compile(rf"(?i)(?<![0-9])[0-9]++(?:{_ANY_DOT}[0-9]++)+")


def _fold_table() -> np.ndarray:
    """Code point to code point; characters without a single ASCII form stand for themselves."""
    fold = np.arange(0x20000, dtype=np.uint32)
    for low, high in ((0x2070, 0x209D), (0x2460, 0x24EA), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x660, 0x66A), (0x6F0, 0x6FA), (0x966, 0x970)):
        for c in range(low, high):
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1:
                digit = unicodedata.decimal(plain, None)
                plain = str(digit) if digit is not None else plain
                fold[c] = ord(plain) if ord(plain) < 128 else c
    for odd, plain in LOOKALIKES.items():
        for a, b in zip(odd, plain, strict=True):
            fold[ord(a)] = ord(b)
    return fold


FOLD = _fold_table()
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in np.flatnonzero(FOLD != np.arange(len(FOLD)))) + "]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain.part. The local part's characters hold no at sign, so a match's start is the start of the run before it."""
    found, at, floor = [], text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def detect(text: str, digits: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds; ``digits`` says whether the text has ASCII digits."""
    found = [(a, 0, b) for a, b in emails(text)]
    if digits:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            number = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(number) <= 19 and luhn(number):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


class Rewritten:
    """A text and, for each of its characters, the source stretch it stands for."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def replace(self, pieces: list[tuple[int, int, str]]) -> None:
        """Puts strings in the place of stretches of the present text, in order and apart."""
        if not pieces:
            return
        parts, begin, end, at = [], [], [], 0
        for a, b, new in pieces:
            parts += [self.text[at:a], new]
            begin += [self.begin[at:a], np.full(len(new), self.begin[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.begin, self.end = np.concatenate([*begin, self.begin[at:]]), np.concatenate([*end, self.end[at:]])


def addresses(text: str) -> list[tuple[int, int]]:
    """Stretches that hold an address with plain or spelled signs, from each at sign outwards; stretches don't overlap."""
    before = {m.end(): m.start() for m in _DOT.finditer(text)}
    found, floor = [], 0
    for m in _ANY_AT.finditer(text):
        after = _AFTER_AT.match(text, m.end())
        if not after or m.start() <= floor:
            continue
        begin = at = m.start()
        for _ in range(_PARTS + 1):
            low = at
            while low > floor and text[low - 1] in _PART:
                low -= 1
            if low == at:  # nothing stands before the sign
                break
            begin = low
            at = low - 1 if low > floor and text[low - 1] == "." else before.get(low, -1)
            if at <= floor:
                break
        found.append((begin, after.end()))
        floor = after.end()
    return found


def rewrite(text: str) -> Rewritten:
    """The transducers, one after the other."""
    out = Rewritten(text)
    if not text.isascii() and _ODD.search(text):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out.text = np.where(codes < len(FOLD), FOLD[np.minimum(codes, len(FOLD) - 1)], codes).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    spelled = []
    for m in _SPELLED.finditer(out.text):
        spelled += [(d.start(), d.end(), DIGIT_WORDS[d[0].lower()]) for d in _ONE_DIGIT.finditer(out.text, m.start(), m.end())]
    out.replace(spelled)
    out.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(out.text)])
    if _WORDED.search(out.text):
        signs = []
        for a, b in addresses(out.text):
            signs += [(s.start(), s.end(), c) for p, c in ((_AT, "@"), (_DOT, ".")) for s in p.finditer(out.text, a, b)]
        for m in _GROUPS.finditer(out.text):
            signs += [(s.start(), s.end(), ".") for s in _DOT.finditer(out.text, m.start(), m.end())]
        kept, at = [], 0
        for s in sorted(signs):
            if s[0] >= at:
                kept.append(s)
                at = s[1]
        out.replace(kept)
    return out


#: Holds in every text with enough spelled digits in a row.
_SPELLED_HINT = re.compile(rf"(?i){_DIGIT}[\s,.-]{{1,3}}{_DIGIT}[\s,.-]")


def find_all(text: str, digits: bool, odd: bool, spelled: bool, worded: bool) -> tuple[list, list]:
    """Base spans and added spans; the flags say which transducers may have something to rewrite."""
    base = detect(text, digits) if digits or "@" in text else []
    added: list = []
    if odd or spelled or worded:
        new = rewrite(text)
        if new.text != text:
            taken = np.zeros(len(text) + 1, bool)
            for a, _, b in base:
                taken[a:b] = True
            for a, kind, b in detect(new.text, True):
                first, last = int(new.begin[a]), int(new.end[b - 1])
                if text[first:last] != new.text[a:b] and not taken[first:last].any():
                    added.append((first, kind, last))
                    taken[first:last] = True
    return base, sorted(added)


_ASCII_DIGIT = np.zeros(256, bool)
_ASCII_DIGIT[48:58] = True
#: First bytes of the characters that FOLD changes.
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[sorted({chr(c).encode()[0] for c in np.flatnonzero(FOLD != np.arange(len(FOLD)))})] = True


def _any(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each row, whether any of its bytes is flagged."""
    places = np.flatnonzero(flags)
    return np.searchsorted(places, starts[1:]) > np.searchsorted(places, starts[:-1])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan(rows: pa.RecordBatch) -> list:
    """Counts of base spans, the base spans' digest, all spans, the number of added ones, and whether there are any."""
    column = rows.column(rows.schema.get_field_index("text"))
    data, starts = utf8(column)
    digit, odd, at = _any(_ASCII_DIGIT[data], starts), _any(_ODD_LEAD[data], starts), _any(data == 0x40, starts)
    none = hashlib.sha256(b"").hexdigest()
    counts = np.zeros((len(KINDS), rows.num_rows), np.int64)
    digests, spans, more = [none] * rows.num_rows, [""] * rows.num_rows, np.zeros(rows.num_rows, np.int64)
    for i, text in enumerate(column.to_pylist()):
        if not text:
            continue
        spelled = _SPELLED_HINT.search(text) is not None
        worded = _WORDED.search(text) is not None or bool(digit[i]) and _PLUS.search(text) is not None
        if not (digit[i] or odd[i] or at[i] or spelled or worded):
            continue
        base, added = find_all(text, bool(digit[i]), bool(odd[i]), spelled, worded)
        if base:
            for _, kind, _ in base:
                counts[kind, i] += 1
            digests[i] = hashlib.sha256(listed(base).encode()).hexdigest()
        if base or added:
            spans[i], more[i] = listed(sorted([*base, *added])), len(added)
    return [*(pa.array(c) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more), pa.array([s != "" for s in spans], pa.bool_())]


ADDED = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, has_personal_data boolean"


def find_personal_data(documents: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the spans of personal data to the documents.

    Counts and digest are of the base spans, in code points with the end
    exclusive; spans lists base and added ones; n_added counts the added ones;
    has_personal_data tells whether there is any span. A null or empty text has no spans. Repeated rows are scanned alike, other
    columns pass through, a column named as an added one is replaced. Whole
    texts are read, in time in proportion to their length.
    """
    return extend(documents, scan, ADDED, drop)


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets, and n_chars, where there is one, set anew."""

    def run(rows: pa.RecordBatch) -> list:
        spans = scan(rows)[5].to_pylist()
        out = []
        for text, listed_ in zip(rows.column(rows.schema.get_field_index("text")).to_pylist(), spans, strict=True):
            if listed_:
                parts, at = [], 0
                for item in listed_.split(","):
                    kind, a, b = item.split(":")
                    if int(b) > at:
                        parts += [text[at : max(at, int(a))], f"<{kind}>"] if int(a) >= at else []
                        at = int(b)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return [pa.array(out, pa.string())]

    from pyspark.sql import functions as F

    out = extend(documents, run, "text string")
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
