"""Hand-made rows for the cases in which a simpler rule would differ."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lakemill.operators import claims, identity, people, privacy, serving, store, views

PEOPLE = "id string, name string, alias string, party string, position string, election_year int, district string, gender string, education string, experience string, external_id string, is_public boolean, updated_at long"
DECISIONS = "duplicate_person_id string, canonical_person_id string, status string, confidence_level string"
MEDIA = "id string, person_id string, url string, license_type string, verification_status string, is_primary boolean, is_public boolean"
CLAIMS = "id string, claim_key string, person_id string, source_person_id string, claim_type string, claim_value string, claim_json string, confidence_level string, review_score int, review_status string, visibility string, is_public boolean, source_name string, updated_at long"


def person(id, name="A", alias=None, party=None, position=None, year=None, district=None, gender=None, education=None, experience=None, external=None, public=True, at=1):
    return (id, name, alias, party, position, year, district, gender, education, experience, external, public, at)


def claim(id, person="p1", kind="gender", value="x", json="{}", level="A", score=50, status="verified", visibility="public", public=True, source="other", key=None, at=1):
    return (id, key or id, person, None, kind, value, json, level, score, status, visibility, public, source, at)


def told(df, *columns):
    """The table with these columns, null where it has none."""
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


@pytest.fixture
def tables(spark):
    def make(people=(), decisions=(), media=(), claims=()):
        return {
            "people": spark.createDataFrame(list(people), PEOPLE), "person_merge_decisions": spark.createDataFrame(list(decisions), DECISIONS),
            "person_media": told(spark.createDataFrame(list(media), MEDIA), *views.PHOTO_COLUMNS), "person_claims": told(spark.createDataFrame(list(claims), CLAIMS), "source_url"),
        }

    return make


def test_newest_told_value_wins_over_newer_null(tables):
    t = tables([person("p1"), person("p2", alias=None, at=9), person("p3", alias="x", at=5, gender="female")], [("p2", "p1", "verified", "A"), ("p3", "p1", "verified", "A")])
    row = views.public_people(t).where("person_id = 'p1'").first()
    assert (row["alias"], row["gender"], row["updated_at"]) == ("x", "female", 9)


def test_unknown_gender_gives_way(tables):
    t = tables([person("p1", gender="unknown"), person("p2", gender="female")], [("p2", "p1", "verified", "A")])
    assert views.public_people(t).first()["gender"] == "female"


def test_canonical_map_has_a_single_hop(tables):
    t = tables([person("a"), person("b"), person("c")], [("a", "b", "verified", "A"), ("b", "c", "verified", "A")])
    assert {tuple(r) for r in views.person_canonical_map(t).collect()} == {("a", "b"), ("b", "c"), ("c", "c")}


def test_private_rows_never_show(tables):
    t = tables([person("p1", public=False), person("p2")], [], [("m", "p1", "u", "cc_by", "verified", True, True)], [claim("c1"), claim("c2", "p2", public=False)])
    assert [r["person_id"] for r in views.public_people(t).collect()] == ["p2"]
    assert views.public_person_primary_photos(t).count() == 0 and views.public_person_claims(t).count() == 0


def test_unknown_views_are_refused(tables):
    with pytest.raises(KeyError):
        views.public_view("person_claims", tables())


def test_private_candidacy_hides_an_older_public_one(spark, tables):
    t = tables([person("p1")])
    t["candidates"] = told(spark.createDataFrame([("k1", "p1", "r1", None, "1", "elected", True, 1), ("k2", "p1", "r1", None, "1", "elected", False, 2)], "id string, person_id string, race_id string, party string, candidate_no string, registration_status string, is_public boolean, updated_at long"), "source_name", "source_url")
    t["races"] = spark.createDataFrame([("r1", "e1", None, "t", True)], "id string, election_id string, region_id string, title string, is_public boolean")
    t["elections"] = spark.createDataFrame([("e1", "E", True)], "id string, name string, is_public boolean")
    t["regions"] = spark.createDataFrame([], "id string, name string, is_public boolean")
    assert views.public_candidates(t).count() == 0
    t["candidates"] = t["candidates"].where("is_public")
    assert views.public_candidates(t).count() == 1


def test_pair_with_id_and_birth_date_is_one_a_row(tables):
    both = [claim(f"b{i}", f"p{i}", "birth_date", "1950-01-01") for i in (1, 2)] + [claim(f"e{i}", f"p{i}", "external_id", "X-1") for i in (1, 2)]
    t = tables([person("p1", "王 明", gender="male"), person("p2", "王明", gender="male")], [], [], both)
    rows = identity.person_duplicate_review_queue(t).collect()
    assert len(rows) == 1 and (rows[0]["confidence_level"], rows[0]["score"], rows[0]["canonical_person_id"]) == ("A", 100, "p1")


def test_settled_pair_is_excluded_in_either_orientation(tables):
    rows = [person("p1", party="x"), person("p2", party="x")]
    assert identity.person_duplicate_review_queue(tables(rows)).count() == 1
    for decision in (("p1", "p2", "rejected", "A"), ("p2", "p1", "archived", "A")):
        assert identity.person_duplicate_review_queue(tables(rows, [decision])).count() == 0


def test_fuller_profile_is_canonical(tables):
    row = identity.person_duplicate_review_queue(tables([person("p1", party="x"), person("p2", party="x", position="y")])).first()
    assert (row["canonical_person_id"], row["duplicate_person_id"]) == ("p2", "p1")


@pytest.mark.parametrize("gender, party, position, expected", [(None, "P", "立法委員", None), ("male", None, None, None), ("male", "P", "立法委員", 90), ("male", "P", None, 80)])
def test_probable_match_needs_gender_and_context(spark, tables, gender, party, position, expected):
    t = tables([person("p1", "王·明", party="P", position="立法委員", gender="male")])
    s = spark.createDataFrame([("s1", "王 明", gender, party, position, None)], "id string, raw_name string, gender string, party string, position string, district string")
    row = identity.probable_identity_matches(s, t["people"], auto_from=90).first()
    assert (row and row["score"]) == expected
    assert not row or row["match_status"] == ("auto_matched" if expected == 90 else "probable_match")


def test_runner_up_within_the_margin_spoils_a_match(spark):
    df = spark.createDataFrame([("r", "a", 90), ("r", "b", 80), ("q", "a", 90), ("q", "b", 75)], "row string, c string, score int")
    assert [r["row"] for r in identity.best_with_margin(df, "row", 75, 15, "c").collect()] == ["q"]


def test_official_birth_date_stays_pending(spark):
    df = spark.createDataFrame([("k", "1950-01-01", "official_election", "A", True)], "k string, b string, source_type string, confidence_level string, matched boolean")
    row = claims.explode_claims(df, "k", {"birth_date": "b"}, F.col("matched")).first()
    assert (row["review_score"], row["review_status"], row["is_public"]) == (85, "pending", False)


def test_sensitive_claims_are_never_eligible(spark, tables):
    t = tables([person("p1")], claims=[claim("c1", kind="legal_case", score=100, status="pending"), claim("c2", kind="family_relation", score=100, status="pending")])
    rows = claims.eligibility(t["person_claims"], views.public_people(t)).collect()
    assert len(rows) == 2 and not any(r["eligible"] for r in rows)


def test_rejected_claim_stays_rejected_when_it_comes_again(tables):
    old = tables(claims=[claim("c1", status="rejected", visibility="private", public=False, key="k")])["person_claims"]
    new = tables(claims=[claim("n1", status="pending", visibility="review_only", public=False, key="k")])["person_claims"]
    assert claims.keep_review_state(new, old).first()["review_status"] == "rejected"


def test_verified_external_id_revives_an_archived_one(tables):
    old = tables(claims=[claim("c1", kind="external_id", status="archived", visibility="private", public=False, key="k")])["person_claims"]
    new = tables(claims=[claim("n1", kind="external_id", key="k")])["person_claims"]
    assert claims.keep_review_state(new, old).first()["review_status"] == "verified"


@pytest.mark.parametrize("text, rules", [("mail a.b@c.tw", ["email"]), ("A123456789", ["national_id"]), ("call 0912345678", ["mobile_phone", "landline_phone"]), ("born 1980-1-2", ["birthday"]), ("電話0912345678號", []), ("未成年子女", ["minor_child_reference"])])
def test_privacy_rules(spark, text, rules):
    got = spark.createDataFrame([(text,)], "x string").select(privacy.risks(F.col("x")).alias("r")).first()["r"]
    assert [r for r in got if r != "landline_phone" or r in rules] == rules


def test_level_d_is_not_promoted(spark):
    df = spark.createDataFrame([("1", "P", "C", "pending", "donor", "D", "text", "s", "u", "r")], "id string, person_name string, company_name string, review_status string, guessed_relation_type string, confidence_suggestion string, evidence_text string, source_name string, source_url string, source_record_id string")
    assert privacy.promotion_errors(df).first()["errors"] == ["confidence_suggestion D cannot be promoted"]


def test_upsert_keeps_columns_that_are_not_delivered(spark):
    old = spark.createDataFrame([("1", "a", "x"), (None, "b", "y")], "id string, name string, kept string")
    new = spark.createDataFrame([("1", "A"), (None, "B"), ("2", "C")], "id string, name string")
    assert {tuple(r) for r in store.upserted(old, new, ["id"]).collect()} == {("1", "A", "x"), (None, "B", "y"), ("2", "C", None)}


def test_table_can_be_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    store.replace_table(spark, spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_a_crash_while_a_table_is_replaced_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    os.rename(path, path + ".replaced")  # the state between the two renames
    assert store.restored(spark, path) and spark.read.parquet(path).count() == 3
    spark.range(2).write.parquet(path + ".replaced")  # the state after the second
    assert store.restored(spark, path) and spark.read.parquet(path).count() == 3 and not os.path.exists(path + ".replaced")
    assert not store.restored(spark, str(tmp_path / "none"))


def test_a_failed_rename_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    real = store._file_system(spark, path)

    class Refusing:
        def rename(self, a, b):
            return real.rename(a, b) if "-" not in a.getName() else False

        def __getattr__(self, name):
            return getattr(real, name)

    monkeypatch.setattr(store, "_file_system", lambda *_: Refusing())
    with pytest.raises(OSError):
        store.replace_table(spark, spark.range(1), path)
    assert spark.read.parquet(path).count() == 3


def test_pages_are_clamped(spark):
    assert serving.page_numbers(10, 1) == [1, 2, 3, 4, 5] and serving.page_numbers(10, 10) == [6, 7, 8, 9, 10] and serving.page_numbers(10, 5) == [3, 4, 5, 6, 7] and serving.page_numbers(2, 9) == [1, 2] and serving.page_numbers(0, 1) == []
    from pyspark.sql import functions as F

    cases = [(n, at, most) for n in (0, 1, 2, 5, 10) for at in (0, 1, 2, 5, 10, 12) for most in (3, 5)]
    for most in (3, 5):
        df = spark.createDataFrame([c[:2] for c in cases if c[2] == most], "n long, at long")
        assert all(r["w"] == serving.page_numbers(r["n"], r["at"], most) for r in df.withColumn("w", serving.page_window(F.col("n"), F.col("at"), most)).collect())


def test_short_queries_find_nothing(spark):
    p = spark.createDataFrame([("1", "ab", None)], "party_id string, name string, short_name string")
    e = spark.createDataFrame([], "election_id string, name string, election_type string, status string")
    r = spark.createDataFrame([], "region_id string, name string, slug string")
    h = spark.createDataFrame([], "person_id string, name string, alias string, party string, position string, district string")
    c = spark.createDataFrame([], "company_id string, name string, unified_business_no string, representative_name string, address_region string")
    assert serving.search("a", p, e, r, h, c).count() == 0 and serving.search(" AB ", p, e, r, h, c).count() == 1


ITEMS = "person_id string, name string, party string, position string, district string, gender string, education string, experience string, role string, status string, external_ids array<string>, candidate_count int"


def one_by_one(rows):
    """The fold over the whole list in order, as it is stated."""
    rank = {"current": 0, "candidate": 1, "former": 2, "other": 3}
    by_key = {}
    for r in rows:
        item = {"id": r[0], "key": f"{r[1]}|{r[2]}", "ids": list(r[10]), "rank": rank[r[9]], "full": sum(bool(x) for x in r[3:8]), "merged": [r[0]], "n": r[11]}

        def keys(x):
            return [x["key"], *x["ids"]]

        found = []
        for k in keys(item):
            if k in by_key and not any(by_key[k] is f for f in found):
                found.append(by_key[k])
        for old in found:
            first, second = (item, old) if (item["rank"], -item["full"] - item["n"]) < (old["rank"], -old["full"] - old["n"]) else (old, item)
            item = {**first, "ids": sorted({*first["ids"], *second["ids"]}), "merged": list(dict.fromkeys(first["merged"] + second["merged"])), "n": first["n"] + second["n"]}
        by_key = {k: v for k, v in by_key.items() if not any(v is f for f in found)}
        for k in keys(item):
            by_key[k] = item
    return {(v["id"], tuple(v["merged"]), v["n"]) for v in by_key.values()}


def test_a_long_chain_of_shared_keys_settles(spark):
    keys = spark.createDataFrame([(f"p{i:04}", f"k{j}") for i in range(300) for j in (i, i + 1)] + [("z", "alone")], "person_id string, key string")
    assert {(r["person_id"], r["root"]) for r in people.groups_by_key(keys, rounds=14).collect()} == {(f"p{i:04}", "p0000") for i in range(300)} | {("z", "z")}


def test_folding_loses_the_key_of_the_other_item(spark):
    rows = [
        ("1", "a", "p", None, None, None, None, None, "other", "other", ["x"], 0), ("2", "b", "p", "y", None, None, None, None, "other", "current", ["x"], 1), ("3", "a", "p", None, None, None, None, None, "other", "other", [], 0),
        ("4", "c", "q", None, None, None, None, None, "other", "other", ["z"], 0), ("5", "d", "q", None, None, None, None, None, "other", "other", ["z", "w"], 0), ("6", "e", "q", None, None, None, None, None, "other", "former", ["w"], 2),
    ]
    got = {(r["person_id"], tuple(r["merged_person_ids"]), r["merged_candidate_count"]) for r in people.fold_duplicates(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == one_by_one(rows)
    assert ("3", ("3",), 0) in got


def test_folding_many_items_equals_the_fold_in_order(spark):
    import random

    r = random.Random(5)
    rows = [(f"{i:03}", r.choice("abcdef"), r.choice("pqr"), r.choice([None, "x"]), None, None, r.choice([None, "e"]), None, "other", r.choice(["current", "former", "other"]), r.sample(["k1", "k2", "k3", "k4", "k5", "k6", "k7"], r.choice([0, 0, 1, 2])), r.choice([0, 1, 2])) for i in range(120)]
    got = {(x["person_id"], tuple(x["merged_person_ids"]), x["merged_candidate_count"]) for x in people.fold_duplicates(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == one_by_one(rows)


def test_folding_200000_items_of_one_name_takes_linear_time(spark):
    import time

    def seconds(n):
        items = spark.range(n).selectExpr(
            "lpad(id, 7, '0') AS person_id", "'a' AS name", "'p' AS party", "CAST(NULL AS STRING) AS position", "CAST(NULL AS STRING) AS district", "CAST(NULL AS STRING) AS education", "CAST(NULL AS STRING) AS experience", "CAST(NULL AS STRING) AS gender",
            "'other' AS role", "'other' AS status", "array(concat('x', id)) AS external_ids", "CAST(id % 3 AS INT) AS candidate_count",
        )
        fold, start = people._Fold(), time.perf_counter()
        for i in range(n):
            fold.take(f"{i:07}", "a|p", [f"x{i}"], 9, 9, 0, i % 3)
        rows = fold.rows()
        took = time.perf_counter() - start
        assert len(rows) == 1 and len(rows["merged_person_ids"][0]) == n and rows["merged_candidate_count"][0] == sum(i % 3 for i in range(n))
        return took, items

    small, _ = seconds(20_000)
    large, items = seconds(200_000)
    assert large < 25 * max(small, 0.05)
    one = people.fold_duplicates(items).collect()
    assert len(one) == 1 and len(one[0]["merged_person_ids"]) == 200_000
