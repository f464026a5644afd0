"""Promotion against candidates taken one by one; automatic review of single rows; regions of any depth."""

from __future__ import annotations

import random

from lakemill.operators import claims as C
from lakemill.operators import privacy
from lakemill.operators.serving import region_closure

AT = "2024-01-01T00:00:00Z"
CANDIDATE = "id string, person_name string, company_name string, unified_business_no string, guessed_relation_type string, confidence_suggestion string, evidence_text string, source_record_id string, source_url string, source_name string, source_type string, review_status string, review_note string"


def one_by_one(rows, people, companies, documents, relations):
    people, companies, documents, relations, out = dict(people), list(companies), dict(documents), dict(relations), []
    for r in sorted(rows):
        id_, name, company, number, kind, _, _, raw = r[:8]
        person = people.setdefault(name, f"new {name}")
        found = [c for c in companies if number and c[1] == number] or [c for c in companies if c[2] == company]
        if not found:
            found = [(f"new {company}", number, company)]
            companies += found
        document = documents.setdefault(raw, f"new {raw}") if raw else f"own {id_}"
        key = (person, found[0][0], kind, document)
        out.append((id_, *key, relations.setdefault(key, f"new of {id_}")))
    return out, people, companies, documents, relations


def frames(spark, rows, people, companies, documents, relations):
    return (
        spark.createDataFrame(rows, CANDIDATE),
        spark.createDataFrame([(i, n) for n, i in people.items()], "id string, name string"),
        spark.createDataFrame([(i, n, m) for i, n, m in companies], "id string, unified_business_no string, name string"),
        spark.createDataFrame([(i, r, True) for r, i in documents.items()] + [("hidden", "r5", False)], "id string, raw_record_id string, is_public boolean"),
        spark.createDataFrame([(i, *k) for k, i in relations.items()], "id string, person_id string, company_id string, relation_type string, evidence_source_id string"),
    )


def test_promotion_equals_one_by_one(spark):
    r = random.Random(11)
    rows = []
    for i in range(60):
        rows.append((f"c{i:03}", f"Person {r.randint(0, 9)}", f"Firm {r.randint(0, 7)}", r.choice([None, "", " ", *(f"0000000{k}" for k in range(8))]), r.choice(["donor", "director"]), "A", "evidence", r.choice([None, "r1", "r2", "r5"]), "https://x.example", None, "", "pending", r.choice([None, "", "noted"])))
    rows.append(("c900", "Person 1", "Firm 1", None, "donor", "D", "evidence", None, "https://x.example", None, "", "pending", None))  # never promoted
    people, companies, documents = {"Person 0": "p0"}, [("f0", "00000003", "Firm 0"), ("f1", None, "Firm 1")], {"r1": "d1"}
    relations = {("p0", "f1", "donor", "d1"): "x1"}
    got = privacy.promotion(*frames(spark, rows, people, companies, documents, relations), at=AT)
    clean = [(*x[:3], (x[3] or "").strip() or None, *x[4:]) for x in rows if x[5] != "D"]
    told, people2, companies2, documents2, relations2 = one_by_one(clean, people, companies, documents, relations)
    assert sorted(x["name"] for x in got["people"].collect()) == sorted(n for n, i in people2.items() if i.startswith("new"))
    assert sorted((x["name"], x["unified_business_no"] or "") for x in got["companies"].collect()) == sorted((c[2], c[1] or "") for c in companies2 if c[0].startswith("new"))
    own = sum(x[7] is None for x in clean)
    assert got["source_documents"].count() == own + sum(i.startswith("new") for i in documents2.values())
    assert got["person_company_relations"].count() == sum(i.startswith("new") for i in relations2.values())
    of = {x["id"]: x["review_note"].rsplit("relation_id=", 1)[1] for x in got["relation_candidates"].collect()}
    assert set(of) == {x[0] for x in clean}
    groups, mine = {}, {}
    for x in told:
        groups.setdefault(x[5], set()).add(x[0])
        mine.setdefault(of[x[0]], set()).add(x[0])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    notes = {x["id"]: x["review_note"] for x in got["relation_candidates"].collect()}
    assert all(notes[x[0]].startswith("noted\npromoted_at=" if x[12] else "promoted_at=") for x in clean)


def test_a_known_number_with_another_spelling_and_a_second_run(spark):
    rows = [("c1", "Ann", "Firm (new spelling)", "12345678", "donor", "B", "evidence", "r9", "https://x.example", "List", "registry", "pending", None)]
    tables = frames(spark, rows, {}, [("f1", "12345678", "Firm")], {}, {})
    got = {k: v.collect() for k, v in privacy.promotion(*tables, at=AT).items()}
    assert not got["companies"] and got["person_company_relations"][0]["company_id"] == "f1"
    assert [len(got[k]) for k in ("people", "source_documents", "person_company_relations", "relation_candidates")] == [1, 1, 1, 1]
    again = [(*rows[0][:11], "verified", got["relation_candidates"][0]["review_note"])]
    tables = frames(spark, again, {"Ann": got["people"][0]["id"]}, [("f1", "12345678", "Firm")], {"r9": got["source_documents"][0]["id"]}, {})
    assert not any(v.count() for v in privacy.promotion(*tables, at=AT).values())
    tables = frames(spark, rows, {"Ann": got["people"][0]["id"]}, [("f1", "12345678", "Firm")], {"r9": got["source_documents"][0]["id"]}, {("x",) * 4: "x"} | {tuple(got["person_company_relations"][0][1:5]): "old"})
    repeated = privacy.promotion(*tables, at=AT)
    assert [repeated[k].count() for k in ("people", "companies", "source_documents", "person_company_relations")] == [0, 0, 0, 0]
    assert repeated["relation_candidates"].first()["review_note"].endswith("relation_id=old")


def test_review_patches_approved_rows_only(spark, tmp_path):
    schema = "id string, review_status string, visibility string, is_public boolean, scoring_version string, scoring_reasons string, note string"
    rows = [("a", "verified", "public", True, "v2", '[{"version":"v2"}]', "n"), ("b", "pending", "review_only", False, "v1", '[{"version":"v1"}]', "n"), ("c", "pending", "review_only", False, None, None, "n"), ("d", "pending", "review_only", False, None, "[ ]", "n")]
    verdicts = spark.createDataFrame([("b", True), ("b", True), ("c", True), ("d", True), ("a", False)], "claim_id string, eligible boolean")
    out = C.approve_eligible(spark.createDataFrame(rows, schema), verdicts, reviewed_at=AT)
    out.write.parquet(str(tmp_path / "claims"))
    got = {r["id"]: r.asDict() for r in spark.read.parquet(str(tmp_path / "claims")).collect()}
    assert len(out.columns) == len(set(out.columns)) and out.count() == 4
    assert got["a"] == dict(zip(schema.replace(" string", "").replace(" boolean", "").split(", "), rows[0], strict=True)) | {"auto_reviewed_at": None}
    assert got["b"]["scoring_version"] == "auto-review" and got["b"]["scoring_reasons"].startswith('[{"version":"v1"},{"version":"auto-review"') and got["b"]["auto_reviewed_at"] == AT
    assert all(got[k]["scoring_reasons"].startswith('[{"version":"auto-review"') and got[k]["is_public"] for k in "cd")


def test_a_null_score_is_below_any_minimum(spark):
    schema = "id string, person_id string, claim_type string, claim_value string, claim_json string, review_score int, review_status string, visibility string, is_public boolean, source_name string"
    claims = spark.createDataFrame([("a", "p", "party", "x", None, None, "pending", "review_only", False, "list"), ("b", "p", "party", "x", None, 20, "pending", "review_only", False, "list")], schema)
    people = spark.createDataFrame([], "person_id string, education string, experience string")
    assert {r["claim_id"]: r["reason"] for r in C.eligibility(claims, people, 20).collect()} == {"a": "below-min-score", "b": "non-wikidata-non-sensitive"}


def test_regions_of_any_depth_and_circles(spark):
    chain = [(f"r{i}", f"r{i - 1}" if i else None) for i in range(20)] + [("x", "y"), ("y", "x")]
    regions = spark.createDataFrame(chain, "region_id string, parent_region_id string")
    assert {r["region_id"]: r["level"] for r in region_closure(regions, "r0").collect()} == {f"r{i}": i for i in range(20)}
    assert {r["region_id"] for r in region_closure(regions, "x").collect()} == {"x", "y"}
    assert region_closure(regions, "none").count() == 0
