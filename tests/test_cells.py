"""Best matches through cells of values: equal to comparing all pairs, and no pairs where many rows share a name."""

from __future__ import annotations

import random

from lakemill.operators import enrichment as E
from lakemill.operators import identity as I

PARTIES, AREAS, GENDERS, POSTS = (None, "", "Brand#1", "Brand#12", "b rand#2"), (None, "NATION_1", "nation_1", "NATION_12", "N2"), (None, "unknown", "male", "female"), (None, "立法委員", "市長", "副市長", "議員", "市議員")


def inside(a, b):
    a, b = ((x or "").replace(" ", "").lower() for x in (a, b))
    return bool(a and b) and (a in b or b in a)


def gender_points(a, b, same, different):
    return 0 if a in (None, "unknown") else same if a == b else different if b not in (None, "unknown") else 0


def best(pairs, least, margin):
    found = {}
    for row, other, score in pairs:
        found.setdefault(row, []).append((-score, other))
    out = set()
    for row, scored in found.items():
        scored.sort()
        score = -scored[0][0]
        if score >= least and (len(scored) == 1 or score + scored[1][0] >= margin):
            out.add((row, scored[0][1], score))
    return out


def people(r, n):
    return [(f"p{i:03}", r.choice(["Ann", "B o", "c·y", f"only{i % 9}"]), r.choice(GENDERS), r.choice(PARTIES), r.choice(AREAS), r.choice(POSTS)) for i in range(n)]


def test_profiles_equal_all_pairs(spark):
    r = random.Random(5)
    mine = [(*x, x[4], r.choice(["council", "government"])) for x in people(r, 150)]
    theirs = people(r, 24)
    rows = spark.createDataFrame([(f"r{x[0]}", *x[1:]) for x in mine], "row_id string, name string, gender string, party string, district string, position string, area string, kind string")
    known = spark.createDataFrame(theirs, "person_id string, name string, gender string, party string, district string, position string")
    key = lambda x: x.replace(" ", "").replace("·", "").lower()
    same = [(a, b) for a in mine for b in theirs if key(a[1]) == key(b[1])]
    law = [(f"r{a[0]}", b[0], 50 + gender_points(a[2], b[2], 20, -30) + 15 * inside(a[3], b[3]) + 15 * inside(a[4], b[4]) + 10 * ("立法委員" in (b[5] or ""))) for a, b in same]
    assert best(law, 75, 15) and {tuple(x) for x in E.legislator_matches(rows, known).collect()} == best(law, 75, 15)
    city = []
    for a, b in same:
        both = a[7] == "council" and "議員" in (b[5] or "") or a[7] == "government" and "市長" in (a[5] or "") and "市長" in (b[5] or "")
        city.append((f"r{a[0]}", b[0], 50 + gender_points(a[2], b[2], 15, -50) + 10 * inside(a[3], b[3]) + 15 * inside(a[5], b[5]) + 15 * inside(a[4], b[4]) + 10 * both))
    assert best(city, 75, 10) and {tuple(x) for x in E.city_profile_matches(rows, known).collect()} == best(city, 75, 10)


def test_candidates_equal_all_pairs(spark):
    r = random.Random(6)
    some = lambda *x: r.choice([None, "", *x])
    make = lambda k, n: [(f"{k}{i:03}", r.choice(["Ann", "a nn", "Bo"]), some("1", "2"), some("P", "PQ"), some("T1", "T12"), some("E1", "E2", " ")) for i in range(n)]
    mine, theirs = make("r", 120), [(*x, some("Z", "P")) for x in make("k", 12)]
    rows = spark.createDataFrame(mine, "row_id string, name string, cand_no string, party string, race_title string, election_name string")
    known = spark.createDataFrame(theirs, "candidate_id string, person_name string, candidate_no string, party string, race_title string, election_name string, person_party string")
    pairs = []
    for a in mine:
        for b in theirs:
            if a[1].replace(" ", "").lower() == b[1].replace(" ", "").lower():
                election = inside(a[5], b[5])
                score = 50 + 20 * bool(a[2] and a[2] == b[2]) + 15 * inside(a[3], b[6] if b[3] is None else b[3]) + 20 * inside(a[4], b[4]) + (10 if election else -40 if b[5] else 0)
                pairs.append((a[0], b[0], score))
    assert best(pairs, 75, 15) and {tuple(x) for x in I.official_candidate_matches(rows, known).collect()} == best(pairs, 75, 15)


def test_leads_and_source_people_equal_all_pairs(spark):
    r = random.Random(7)
    theirs = people(r, 60)
    known = spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in theirs], "id string, name string, gender string, party string, district string, position string")
    norm = lambda x: (x or "").replace(" ", "").replace("·", "").lower()
    leads = [(f"l{i:03}", r.choice(["ann", "bo", "cy", ""]), r.choice([None, "news", "judicial_api"]), r.choice(["Brand#1", "x"]), r.choice(["NATION_1 市長", None, "立法委員"]), r.choice([None, "p003", "p010", "p011"])) for i in range(120)]
    df = spark.createDataFrame(leads, "id string, normalized_name string, source_type string, title string, summary string, target_person_id string")
    want = set()
    for i, name, kind, title, summary, target in leads:
        e, found = norm(" ".join(x for x in (title, summary) if x is not None)), []
        for p, n, _, party, district, position in theirs:
            if name and name == norm(n):
                s = 25 + 15 * (kind == "judicial_api") + 5 * (target == p)
                s += sum(k for k, x in ((10, norm(district)[:3]), (5, norm(party)), (5, norm(position)[:4])) if x and x in e)
                found.append((-s, p))
        want.add((i, min(found)[1], -min(found)[0]) if found else (i, None, 0))
    assert {(x["lead_id"], x["person_id"], x["match_score"]) for x in I.legal_lead_matches(df, known).collect()} == want
    mine = [(f"s{x[0]}", *x[1:]) for x in people(r, 120)]
    role = lambda x: "立法委員" in x and "legislator" or "議員" in x and "councilor" or "副市長" in x and "local_deputy" or "市長" in x and "local_chief" or "other"
    want = set()
    for i, n, g, party, district, position in mine:
        found = []
        for p, n2, g2, party2, district2, position2 in theirs:
            if norm(n) == norm(n2) and g not in (None, "unknown") and g == g2:
                s = 70 + 10 * (norm(party) != "" and norm(party) == norm(party2)) + 10 * (role(position or "") == role(position2 or "") != "other") + 5 * (norm(district) != "" and norm(district)[:3] in norm(district2))
                found += [(-s, p)] if s >= 75 else []
        want |= {(i, min(found)[1], -min(found)[0])} if found else set()
    df = spark.createDataFrame(mine, "id string, raw_name string, gender string, party string, district string, position string")
    assert want and {(x["source_person_id"], x["person_id"], x["score"]) for x in I.probable_identity_matches(df, known).collect()} == want


def test_one_name_of_many_makes_no_pairs(spark):
    """200,000 rows beside 200,000 people of one name: 40,000,000,000 pairs, which nothing may form."""
    n = 200_000
    rows = spark.range(n).selectExpr("concat('r', id) AS row_id", "'ann' AS name", "CASE id % 3 WHEN 0 THEN 'male' ELSE 'female' END AS gender", "concat('Brand#', id % 20) AS party", "'clerk' AS position", "concat('N', id % 7) AS district", "concat('N', id % 7) AS area", "'council' AS kind", "id % 3 AS cand_no", "'T' AS race_title", "'E' AS election_name")
    known = spark.range(n).selectExpr("concat('p', lpad(id, 7, '0')) AS person_id", "'Ann' AS name", "CASE WHEN id = 0 THEN 'male' ELSE 'female' END AS gender", "concat('Brand#', id % 20) AS party", "concat('N', id % 7) AS district", "CASE WHEN id = 0 THEN '立法委員' END AS position")
    found = E.legislator_matches(rows, known).select("row_id", "person_id", "score").collect()
    # of the man's party and district, and men of his party or district only, who have no other man to be compared with
    alone = {i for i in range(n) if i % 3 == 0}
    assert {int(x["row_id"][1:]) for x in found} == alone and {x["person_id"] for x in found} == {"p0000000"}
