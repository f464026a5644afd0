"""Scalar rules on the cases that tell similar rules apart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakemill.functions import text as T


def value(spark, column, **row):
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "rule, given, expected",
    [
        (T.identity_text, " 臺　北·A ", "台北a"), (T.identity_text, None, ""), (T.sql_name, "臺 北·A", "台北·a"), (T.sql_name, None, None), (T.person_name, "臺 A·b", "台Ab"), (T.list_name, "王小明 (Ming)", "王小明"),
        (T.list_name, "Ann Lee", "AnnLee"), (T.report_name, "12 王·小明!x", "王小明"), (T.report_name, "!!", ""), (T.party_name, "臺灣基進", "台灣基進"), (T.party_name, None, None), (T.party_label, " ", "未知政黨"),
        (T.party_label, "無黨籍及未經政黨推薦", "無黨籍"), (T.party_theme, "民主進步黨", "dpp"), (T.gregorian_year, "112", 2023), (T.gregorian_year, "2023", 2023), (T.gregorian_year, "x", None), (T.gregorian_year, "112年", 2023),
        (T.year_from_path, "a/2014-103年x/b.csv", 2014), (T.year_from_path, "a/99年/b", 2010), (T.year_from_path, "b", None), (T.amount, "1,234.5元", 1234.5), (T.amount, "", 0.0), (T.amount, "x", 0.0),
        (T.business_number, "12-345678", "12345678"), (T.business_number, "123", None), (T.gender, "男", "male"), (T.gender, "FEMALE", "female"), (T.gender, "?", "unknown"), (T.gender_of_claim, "男女", "female"),
        (T.gender_of_claim, "", None), (T.source_type, "taipei-x", "other"), (T.source_type, "ly-cec", "official_election"), (T.source_confidence, "wikidata-1", "C"), (T.role_of, "副總統候選人", "vice_president"),
        (T.role_of, "總統候選人", "president"), (T.role_of, "副市長", "local_deputy"), (T.role_of, None, "other"), (T.surname, "歐陽修", "歐陽"), (T.surname, "王明", "王"), (T.surname_strokes, "林明", 8), (T.strip_apostrophes, "''007", "007"),
        (T.external_id, " WIKIDATA:q12 ", "wikidata:Q12"), (T.external_id, "CEC-1", "cec-1"), (T.qid_of, '{"wikidataQid":"q7"}', "Q7"), (T.qid_of, '{"wikidataQid":"x"}', None), (T.decode_html, "&amp;lt;", "<"),
        (T.clean_html, "<p>a&nbsp; b</p> <p>c</p><br/>", "a b\nc"), (T.roc_date, "1120230", "2023-02-30"), (T.roc_date, "1121330", None), (T.roc_date_words, "民國 70 年 1 月 2 日", "1981-01-02"), (T.district_number, "第 3 選舉區", 3),
        (T.district_number, "x", 2147483647), (T.numeral_district, "第三選區", 3), (T.numeral_district, "第十一選區", None), (T.profile_lines, "a; b\n\nc", "a；b；c"), (T.evidence_summary, "x" * 121, "x" * 120 + "..."),
        (T.address_region, "臺北市***路", "臺北市"), (T.race_category, "county_mayor", "chief"),
    ],
)
def test_rule(spark, rule, given, expected):
    assert value(spark, rule("x"), x=given) == expected


def test_a_null_part_of_a_hash_is_empty(spark):
    assert value(spark, T.hash_id("a", "b"), a="x", b=None) == value(spark, F.left(F.sha1(F.lit("x|")), F.lit(12)), a="x")


def test_first_told_field_is_picked(spark):
    assert value(spark, T.pick("a", "b"), a="  ", b=" y ") == "y"
    assert value(spark, T.pick("a", "b"), a=None, b=None) == ""


def test_containment_needs_text_on_both_sides(spark):
    assert value(spark, T.overlaps(F.col("a"), F.col("b")), a="臺北 市", b="台北") is True
    assert value(spark, T.overlaps(F.col("a"), F.col("b")), a="", b="台北") is False
    assert value(spark, T.label_matches(F.col("a"), F.col("b")), a=None, b="x") is False


def test_parts_of_a_judgment(spark):
    assert tuple(value(spark, T.legal_parts("x"), x="TPD,110,訴,5,20210101")) == ("TPD", "110", "訴", "5", "20210101")
