"""Scalar rules of the civic data model, as functions from columns to a column.

The five name normalisers differ on purpose: each rule names the one it uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Middle dots that names are written with.
DOTS = "‧·．・･•"
SPACES = r"\s 　\p{Z}﻿"
#: Party names and the label they are given; without_party stands for no name at all on the read side.
PARTY_LABELS = {"臺灣民眾黨": "台灣民眾黨", "臺灣基進": "台灣基進", "台灣綠黨": "綠黨", "臺灣社會民主黨": "社會民主黨", "無黨籍及未經政黨推薦": "無黨籍"}
WITHOUT_PARTY = "未知政黨"
#: Theme keys of parties.
PARTY_THEMES = {"民主進步黨": "dpp", "中國國民黨": "kmt", "台灣民眾黨": "tpp", "時代力量": "npp", "親民黨": "pfp", "台灣基進": "tsp", "無黨籍": "independent"}
#: Surnames of two characters.
COMPOUND_SURNAMES = ("歐陽", "司馬", "諸葛", "上官", "夏侯", "東方", "皇甫", "尉遲", "公孫", "司徒", "司空", "南宮", "宇文", "慕容", "令狐")
#: Strokes of surnames, by number of strokes.
SURNAME_STROKES = {
    2: "丁刁", 4: "王尹毛方文孔", 5: "古史田白石", 6: "朱江任伍", 7: "吳李何呂宋沈", 8: "邱林周金", 9: "侯洪胡柯姚", 10: "徐孫高馬袁", 11: "張許梁郭曹陳",
    12: "黃曾彭游童", 13: "楊葉董萬", 14: "趙", 15: "劉蔡鄭潘", 16: "蕭賴", 17: "謝鍾", 18: "簡顏魏", 19: "羅蘇",
}
#: Words of a position, in the order in which they are tried, and the role.
ETL_ROLES = [
    (("副總統",), "vice_president"), (("總統",), "president"), (("立法委員", "立委"), "legislator"), (("議員",), "councilor"),
    (("副市長", "副縣長", "副縣市長"), "local_deputy"), (("市長", "縣長"), "local_chief"), (("黨主席", "主席", "秘書長"), "party_officer"), (("候選人",), "candidate"),
]
UI_ROLES = [*ETL_ROLES[:6], (("局長", "處長", "主任委員"), "agency_head"), *ETL_ROLES[6:]]
#: Order of roles and statuses in lists.
ROLE_RANK = {"president": 0, "vice_president": 1, "legislator": 2, "local_chief": 3, "local_deputy": 4, "councilor": 5, "party_officer": 6, "agency_head": 6, "candidate": 7, "other": 8}
STATUS_RANK = {"current": 0, "candidate": 1, "former": 2, "other": 3}
#: Parts of a source id, in the order in which they are tried, and the source type.
SOURCE_TYPES = [("cec", "official_election"), ("ly", "official_officeholder"), ("cy", "official_party_finance"), ("political-finance", "official_party_finance"), ("wikidata", "wikidata"), ("moi", "government_open_data")]
#: Numerals.
NUMERALS = "一二三四五六七八九十"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: str | Column) -> Column:
    """The value as text, null as empty."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def first_of(pairs: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def lookup(x: Column, values: dict, otherwise: object) -> Column:
    return first_of([(x == k, v) for k, v in values.items()], otherwise)


def has_any(x: Column, words: tuple[str, ...]) -> Column:
    out = x.contains(words[0])
    for w in words[1:]:
        out = out | x.contains(w)
    return out


def identity_text(x: str | Column) -> Column:
    """Lower case without middle dots and spaces of any kind; 臺 as 台; null as empty."""
    return F.lower(F.regexp_replace(F.translate(text(x), "臺", "台"), f"[{DOTS}{SPACES}]+", ""))


def sql_name(x: str | Column) -> Column:
    """The duplicate queue's form: as identity_text, but dots stay and null stays null."""
    return F.lower(F.regexp_replace(F.replace(col(x), F.lit("臺"), F.lit("台")), r"\s+", ""))


def person_name(x: str | Column) -> Column:
    """identity_text that keeps the case."""
    return F.regexp_replace(F.translate(text(x), "臺", "台"), f"[{DOTS}{SPACES}]+", "")


def list_name(x: str | Column) -> Column:
    """The leading Chinese characters if there are any, else the whole name without spaces."""
    lead = F.regexp_extract(text(x), r"^[㐀-鿿]+", 0)
    return F.regexp_replace(F.when(lead != "", lead).otherwise(text(x)), f"[{SPACES}]+", "")


def report_name(x: str | Column) -> Column:
    """The quality report's form: from the first letter as far as letters, dots and spaces go, without the latter two."""
    lead = F.regexp_replace(text(x), r"^[^㐀-鿿A-Za-z]+", "")
    kept = F.regexp_extract(lead, r"^[㐀-鿿A-Za-z·．・\s]+", 0)
    return F.lower(F.regexp_replace(F.translate(kept, "臺", "台"), f"[{DOTS}{SPACES}]+", ""))


def party_name(x: str | Column) -> Column:
    return lookup(col(x), PARTY_LABELS, col(x))


def party_label(x: str | Column) -> Column:
    """The read side's label; blank is the unknown party."""
    trimmed = F.trim(text(x))
    return F.when(trimmed == "", WITHOUT_PARTY).otherwise(lookup(trimmed, PARTY_LABELS, trimmed))


def party_theme(x: str | Column) -> Column:
    return lookup(party_label(x), PARTY_THEMES, "unknown")


def gregorian_year(x: str | Column) -> Column:
    """A leading whole number; below 1911 it counts from 1911."""
    return year_of(year_digits(x))


def year_digits(x: str | Column) -> Column:
    return F.regexp_extract(text(x), r"^\s*([+-]?\d{1,9})", 1)


def year_of(digits: str | Column) -> Column:
    """The year that digits, or none, tell."""
    number = F.when(col(digits) != "", col(digits).cast("int"))
    return F.when(number < 1911, number + 1911).otherwise(number)


def year_from_path(x: str | Column) -> Column:
    plain = F.regexp_extract(text(x), r"(?:^|/)((?:19|20)\d{2})", 1)
    roc, prefixed = F.regexp_extract(text(x), r"(?:^|/)(\d{2,3})年", 1), F.regexp_extract(text(x), r"(?:^|/)\d{4}-(\d{2,3})年", 1)
    return F.coalesce(F.when(plain != "", plain.cast("int")), F.when(roc != "", gregorian_year(roc)), F.when(prefixed != "", gregorian_year(prefixed)))


def amount(x: str | Column) -> Column:
    """A leading number after commas are dropped, else 0."""
    return amount_of(amount_digits(x))


def amount_digits(x: str | Column) -> Column:
    return F.regexp_extract(F.replace(text(x), F.lit(","), F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)


def amount_of(digits: str | Column) -> Column:
    """The number that digits, or none, tell."""
    return F.when(col(digits) != "", col(digits).cast("double")).otherwise(0.0)


def business_number(x: str | Column) -> Column:
    digits = F.regexp_replace(text(x), r"\D", "")
    return F.when(F.length(digits) == 8, digits)


def gender(x: str | Column) -> Column:
    """The ETL's codes."""
    t = F.trim(text(x))
    return first_of([(t.isin("1", "男") | (F.lower(t) == "male"), "male"), (t.isin("2", "女") | (F.lower(t) == "female"), "female")], "unknown")


def gender_of_claim(x: str | Column) -> Column:
    """The read side's reading of a claim; female first, null when not told."""
    t = F.lower(F.trim(text(x)))
    return first_of(
        [(t == "", None), (t.isin("female", "f") | t.contains("女"), "female"), (t.isin("male", "m") | t.contains("男"), "male"), ((t == "unknown") | t.contains("未知"), "unknown")], None
    )


def hash_id(*parts: str | Column) -> Column:
    """Twelve digits of the SHA-1 of the parts joined by bars; a null part is empty."""
    return F.left(F.sha1(F.concat_ws("|", *(text(p) for p in parts))), F.lit(12))


def source_type(x: str | Column) -> Column:
    return first_of([(col(x).contains(part), kind) for part, kind in SOURCE_TYPES], "other")


def source_confidence(x: str | Column) -> Column:
    kind = source_type(x)
    return first_of([(kind.startswith("official") | (kind == "government_open_data"), "A"), (kind == "wikidata", "C")], "D")


def is_official(kind: str | Column) -> Column:
    return col(kind).startswith("official") | (col(kind) == "government_open_data")


def role_of(x: str | Column) -> Column:
    """The ETL's role of a position."""
    return first_of([(has_any(text(x), words), role) for words, role in ETL_ROLES], "other")


def list_role(positions: Column, races: Column) -> Column:
    """The read side's role: a presidency by positions alone, the others also by races' titles."""
    both = F.concat_ws(" ", positions, races)
    return first_of([(has_any(positions if role.endswith("president") else both, words), role) for words, role in UI_ROLES], "other")


def surname(x: str | Column) -> Column:
    return F.when(F.left(col(x), F.lit(2)).isin(*COMPOUND_SURNAMES), F.left(col(x), F.lit(2))).otherwise(F.left(col(x), F.lit(1)))


def surname_strokes(x: str | Column) -> Column:
    """Strokes of the surname's first character; unknown ones come last."""
    lead = F.left(col(x), F.lit(1))
    return first_of([(lead.isin(*chars), n) for n, chars in SURNAME_STROKES.items()], 2147483647)


def strip_apostrophes(x: str | Column) -> Column:
    return F.regexp_replace(text(x), "^'+", "")


def external_id(x: str | Column) -> Column:
    """Entity ids in upper case after their prefix, all else in lower case."""
    t = F.trim(text(x))
    qid = F.regexp_extract(t, r"(?i)^wikidata:(Q\d+)$", 1)
    return F.when(qid != "", F.concat(F.lit("wikidata:"), F.upper(qid))).otherwise(F.lower(t))


def qid_of(json: str | Column) -> Column:
    """A claim's entity id, if it has a valid one."""
    value = F.get_json_object(col(json), "$.wikidataQid")
    return F.when(value.rlike(r"(?i)^Q\d+$"), F.upper(value))


def decode_html(x: str | Column) -> Column:
    """Entities as characters; the ampersand comes second, so that its result is read again."""
    out = text(x)
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def clean_html(x: str | Column) -> Column:
    """Text of a fragment: breaks and paragraphs as lines, tags dropped, blanks squeezed, empty lines dropped."""
    out = F.regexp_replace(decode_html(x), r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</p>\s*<p[^>]*>", "\n"), r"<[^>]+>", "")
    lines = F.transform(F.split(F.replace(out, F.lit("\r"), F.lit("")), "\n"), lambda line: F.trim(F.regexp_replace(line, f"[{SPACES}]+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def roc_date(x: str | Column) -> Column:
    """YYYMMDD of years from 1911 on, checked for month and day; null if it is none."""
    y, m, d = (F.regexp_extract(F.trim(text(x)), r"^(\d{2,3})(\d{2})(\d{2})$", i) for i in (1, 2, 3))
    ok = (y != "") & m.cast("int").between(1, 12) & d.cast("int").between(1, 31)
    return F.when(ok, F.concat_ws("-", (y.cast("int") + 1911).cast("string"), m, d))


def roc_date_words(x: str | Column) -> Column:
    """民國 y 年 m 月 d 日; null if it is none."""
    y, m, d = (F.regexp_extract(text(x), r"民國\s*(\d{1,3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", (y.cast("int") + 1911).cast("string"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def district_number(x: str | Column) -> Column:
    """Number of an electoral district in a title; those without come last."""
    n = F.regexp_extract(text(x), r"第\s*(\d{1,9})\s*選舉區", 1)
    return F.when(n != "", n.cast("int")).otherwise(2147483647)


def numeral_district(x: str | Column) -> Column:
    """Number of 第一選區 to 第十選區, else null."""
    n = F.regexp_extract(text(x), f"第([{NUMERALS}]+)選區", 1)
    return lookup(n, {c: i + 1 for i, c in enumerate(NUMERALS)}, None)


def profile_lines(x: str | Column) -> Column:
    """Entries of a profile text, split at semicolons and line ends, joined by full-width semicolons."""
    parts = F.transform(F.split(text(x), r"[;；\r\n]+"), lambda p: F.trim(p))
    return F.array_join(F.filter(parts, lambda p: p != ""), "；")


def tokens(x: str | Column) -> Column:
    """Distinct hints of two characters and more."""
    parts = F.split(F.lower(text(x)), r"[\s,;；、，。・()（）/|]+")
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 2))


def legal_parts(x: str | Column) -> Column:
    """Court, year, code, number and date of a judgment id."""
    p = F.split(text(x), ",")
    return F.struct(*(F.get(p, i).alias(n) for i, n in enumerate(("court", "year", "code", "number", "date"))))


def evidence_summary(x: str | Column, longest: int = 120) -> Column:
    t = F.trim(text(x))
    return F.when(F.length(t) <= longest, t).otherwise(F.concat(F.left(t, F.lit(longest)), F.lit("...")))


def address_region(x: str | Column) -> Column:
    return F.nullif(F.left(F.regexp_replace(text(x), r"\*+", ""), F.lit(3)), F.lit(""))


def is_blank(x: str | Column) -> Column:
    return F.trim(text(x)) == ""


def pick(*names: str | Column) -> Column:
    """The first value that isn't blank, trimmed; empty if there is none."""
    return F.coalesce(*(F.nullif(F.trim(text(n)), F.lit("")) for n in names), F.lit(""))


def overlaps(a: Column, b: Column) -> Column:
    """Whether one of two identity texts contains the other; empty ones don't."""
    x, y = identity_text(a), identity_text(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def label_matches(value: Column, *labels: Column) -> Column:
    """Whether a value and one of the labels contain each other; null and empty don't match."""
    out = F.lit(False)
    for label in labels:
        out = out | F.coalesce((value != "") & (label != "") & (value.contains(label) | label.contains(value)), F.lit(False))
    return out


def race_category(kind: str | Column) -> Column:
    return first_of(
        [
            (col(kind).isin("president", "vice_president"), "presidential"),
            (col(kind).isin("municipality_mayor", "county_mayor", "township_mayor"), "chief"),
            (col(kind).isin("legislator", "party_list_legislator", "city_councilor", "county_councilor", "township_representative"), "representative"),
        ],
        "basic",
    )
