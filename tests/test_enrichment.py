"""Registries, entity matches and jobs on small rows."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from lakemill.operators import enrichment, jobs
from lakemill.sources import files, registries
from lakemill.sources.snapshots import Store


def test_archived_elections(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        folder = "2014-103年/直轄市/T2"
        z.writestr(f"{folder}/elcand.csv", "'10,'002,'03,,,'1,王明,'7,1,,,,,,*,\n'10,'002,'03,,,'2,姓名,'7,1,,,,,,,\n")
        z.writestr(f"{folder}/elpaty.csv", "'7,臺灣民眾黨\n")
        z.writestr("2000年/總統/elcand.csv", "'00,'000,'00,,,'1,李四,'9,2,,,,,,,Y\n")
        z.writestr("2000年/總統/elpaty.csv", "'7,x\n")
        z.writestr("2024總統立委/總統/elcand.csv", "'00,'000,'00,,,'1,new,'9,2,,,,,,,\n")
    rows = {r["raw_name"]: r for r in registries.historic_candidates(files.read_zipped_rows(spark, str(tmp_path / "a.zip"))).collect()}
    assert set(rows) == {"王明", "李四"}
    a, b = rows["王明"], rows["李四"]
    assert (a["party"], a["position"], a["district"], a["election_year"], a["kind"], a["elected"], a["gender"]) == ("台灣民眾黨", "宜蘭縣平地原住民議員", "平地原住民", 2014, "local-councilor-plain-indigenous", True, "male")
    assert (b["position"], b["role"], b["district"], b["party"]) == ("2000年副總統候選人", "vice_president", "全國", "")
    assert a["source_person_key"].startswith("cec-historical:") and len(a["source_person_key"]) == 27


def test_registry_takes_the_first_row_of_wanted_names(spark):
    df = spark.createDataFrame([(1, "甲", "x"), (2, "甲", "y"), (3, "乙", "z"), (4, " ", "w")], "line long, `政黨名稱` string, chair string")
    rows = registries.party_registry(df, ["甲"]).collect()
    assert [(r["name_"], r["chair"], r["status"]) for r in rows] == [("甲", "x", "active")] and rows[0]["external_id"].startswith("moi-party-")


def test_officeholders_who_left_are_left_out(spark):
    cols = "leaveFlag string, term string, name string, ename string, sex string, partyGroup string, areaName string, onboardDate string, picUrl string, degree string, experience string"
    df = spark.createDataFrame([("否", "", "Ann", "", "女", "P", "A", "d", "http://x/0042.jpg", "", "e"), ("是", "11", "Bo", "", "男", "P", "A", "d", "", "", "")], cols)
    row = registries.officeholders(df).collect()
    assert len(row) == 1 and (row[0]["external_id"], row[0]["gender"], row[0]["position"], row[0]["education"]) == ("ly-legislator-11-0042", "female", "第11屆立法委員", None)


def test_change_lists_give_each_judgment_once(spark):
    df = spark.createDataFrame([('[{"date":"d","list":["TPD,110,訴,5,2021","TPD,110,訴,5,2021"]},{"date":"e","list":["A,1,b,2,3"]}]',)], "text string")
    assert {(r["jid"], r["court"], r["number"]) for r in registries.changed_documents(df).collect()} == {("TPD,110,訴,5,2021", "TPD", "5"), ("A,1,b,2,3", "A", "2")}


@pytest.mark.parametrize("gender, description, position, matched, score", [("male", "politician of X", "legislator", True, 85), ("male", "a painter", "legislator", False, 75), ("unknown", "politician", "legislator", False, 50), ("male", "politician", "", False, 75)])
def test_entities_need_office_and_one_more_signal(spark, gender, description, position, matched, score):
    t = spark.createDataFrame([("t", "王·明", gender, position, None, None, None, None)], "target_id string, name string, gender string, position string, education string, experience string, district string, party string")
    e = spark.createDataFrame([("t", "Q1", ["王明"], "male", description, ["school"], ["Legislator of X"], [])], "target_id string, qid string, names array<string>, gender string, description string, education array<string>, positions array<string>, occupations array<string>")
    row = enrichment.entity_matches(t, e).first()
    assert (row["matched"], row["score"]) == (matched, score)


def test_entity_claims(spark):
    schema = "target_id string, qid string, gender string, birth_date string, education array<string>, positions array<string>, occupations array<string>, relatives array<struct<relation: string, label: string>>"
    df = spark.createDataFrame([("t", "Q1", "unknown", None, ["s", "s"], [str(i) for i in range(10)], [str(i) for i in range(8, 15)], [("配偶", "Bo")])], schema)
    rows = {(r["claim_type"], r["claim_value"]) for r in enrichment.entity_claims(df).collect()}
    assert rows == {("external_id", "wikidata:Q1"), ("education", "s"), ("experience", "；".join(str(i) for i in range(12))), ("family_relation", "配偶：Bo")}


def test_snapshot_is_rerun_safe(spark, tmp_path):
    df = spark.createDataFrame([("e1", "A"), ("e2", "B")], "id string, name string")
    for _ in range(2):
        log = jobs.write_snapshot(spark, str(tmp_path), {"elections": df}, "r1")
        assert [(r["table"], r["rows"]) for r in log.collect()] == [("elections", 2)]
    assert Store(spark, str(tmp_path)).read("elections").count() == 2


def test_batch_refuses_newly_public_sensitive_claims(spark):
    claims = spark.createDataFrame([("1", "legal_case", False)], "id string, claim_type string, is_public boolean")
    assert set(jobs.run_batch({"person_claims": claims}, [("none", lambda t: {})])) == {"person_claims"}
    with pytest.raises(RuntimeError):
        jobs.run_batch({"person_claims": claims}, [("open", lambda t: {"person_claims": t["person_claims"].withColumn("is_public", F.lit(True))})])


def test_short_filters(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")], "k string, n int, v string")
    assert [r["k"] for r in jobs.rest_filter(df, {"n": "gte.2", "v": "not.eq.y"}, "n.desc", 5).collect()] == ["b"]
    assert [r["k"] for r in jobs.rest_filter(df, {"k": "in.(a,c)", "v": "is.null"}).collect()] == ["a"]
    assert [r["k"] for r in jobs.rest_filter(df, {"v": "not.is.null"}, "n.desc", 1).collect()] == ["c"]
    assert jobs.lookup(df, k="b", n=2).count() == 1 and jobs.lookup(df, v=None).count() == 1
    with pytest.raises(ValueError):
        jobs.rest_filter(df, {"k": "like.x"})


def test_report_is_written_sorted(spark, tmp_path):
    jobs.write_report(spark.createDataFrame([("b",), ("a",)], "k string"), str(tmp_path / "r"), "k")
    assert sorted(r["k"] for r in spark.read.json(str(tmp_path / "r")).collect()) == ["a", "b"]
