"""Pairs of one name as classes: equal to all pairs, and linear where many are alike."""

from __future__ import annotations

import random
from itertools import combinations

from lakemill.operators import identity as I

SCHEMA = "person_id string, name string, n_name string, gender string, party string, position string, district string, external_ids array<string>, birth_dates array<string>, candidate_regions array<string>"


def scored(a, b):
    same = lambda i: bool(a[i]) and a[i] == b[i]
    meet = lambda i: bool(set(a[i]) & set(b[i]))
    told = a[3] not in (None, "", "unknown") and b[3] not in (None, "", "unknown")
    conflict, born = told and a[3] != b[3], bool(a[8] and b[8]) and not meet(8)
    s = 10 + 90 * meet(7) - 40 * conflict + 25 * (told and a[3] == b[3]) - 50 * born + 45 * meet(8) + 5 * meet(9) + 5 * sum(same(i) for i in (4, 5, 6))
    s = min(100, max(0, s))
    if conflict or born:
        return s, "do_not_merge_likely"
    if meet(7):
        return s, "merge_candidate"
    if meet(8) and told and a[3] == b[3]:
        return s, "manual_review_birthdate_match"
    return s, "manual_review" if s >= 50 else "same_name_only"


def records(seed, n):
    r = random.Random(seed)
    some = lambda *x: r.choice([None, "", *x])
    lists = lambda k: [f"{k}{r.randint(0, 30)}" for _ in range(r.randint(0, 2))]
    return [(f"p{i:04}", "x", r.choice(["ann", "bo", "cy", f"only{i}", ""]), some("male", "female", "unknown"), some("A", "B", f"P{i}"), some("m", f"m{i}"), some("d", "e"), lists("q"), lists("b"), lists("r")) for i in range(n)]


def test_pairs_equal_all_pairs(spark):
    rows = records(3, 160)
    want = {(a[0], b[0], a[2], *scored(a, b)) for a, b in combinations(rows, 2) if a[2] == b[2]}
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in I.same_name_pairs(df).collect()} == want
    classes, members = I.identity_classes(df)
    links = I.class_links(classes).collect()
    assert sum(r["pairs"] for r in links) == len(want) and members.count() == sum(r["n"] for r in classes.collect())


def test_a_name_of_many_records_stays_linear(spark):
    n = 100_000
    rows = spark.range(n).selectExpr(
        "concat('p', lpad(id, 7, '0')) AS person_id", "'Ann' AS name", "'ann' AS n_name", "CASE id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender", "concat('party', id % 4) AS party", "concat('own', id) AS position", "'d' AS district",
        "CASE WHEN id % 2 = 0 THEN array(concat('q', id)) ELSE array() END AS external_ids", "CASE WHEN id % 5 = 0 THEN array(concat('b', id)) ELSE array() END AS birth_dates", "array('r') AS candidate_regions",
    )
    classes, members = I.identity_classes(rows)
    links = I.class_links(classes)
    assert members.count() == n and classes.count() == 24  # 3 genders, 4 parties, with a birth date or without
    assert links.agg({"pairs": "sum"}).first()[0] == n * (n - 1) // 2 and links.count() == 24 * 25 // 2
    group = I.duplicate_groups(rows, links).collect()
    assert [(r["record_count"], r["top_recommendation"]) for r in group] == [(n, "manual_review")] and group[0]["top_score"] == 50


def test_people_of_one_name_in_the_queue_stay_linear(spark):
    n = 50_000
    base = spark.range(n).selectExpr(
        "concat('p', lpad(id, 7, '0')) AS id", "'ann' AS n_name", "CASE id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender", "CASE WHEN id % 4 = 0 THEN '1970-01-01' END AS birth_date", "concat('own', id) AS n_party", "concat('d', id % 5) AS n_district"
    )
    classes, members = I.duplicate_classes(base)
    links = I.duplicate_class_links(classes)
    assert members.count() == n and classes.count() == 30 and links.count() <= 30 * 31 // 2
    counts = {}
    for i in range(n):
        key = (("male", "female", "unknown")[i % 3], i % 4 == 0, i % 5)
        counts[key] = counts.get(key, 0) + 1
    want = 0
    keys = sorted(counts)
    for i, a in enumerate(keys):
        for b in keys[i:]:
            born = a[0] == b[0] != "unknown" and a[1] and b[1]
            clash = "unknown" not in (a[0], b[0]) and a[0] != b[0]
            if born or (a[2] == b[2] and not clash):
                want += counts[a] * (counts[a] - 1) // 2 if a == b else counts[a] * counts[b]
    assert links.agg({"pairs": "sum"}).first()[0] == want


def close_records(seed, n):
    r = random.Random(seed)
    some = lambda *x: r.choice([None, "", *x])
    lists = lambda k, most: r.sample([f"{k}{i}" for i in range(most)], r.choice([0, 0, 1, 2]))
    names = [f"n{i // r.choice([2, 3, 5])}" for i in range(n)]
    return [(f"p{i:04}", "x", r.choice([names[i], names[i], "", None]), some("male", "female", "unknown"), some("A", "B"), some("m", "k"), some("d", "e"), lists("q", 6), lists("b", 3), lists("r", 4)) for i in range(n)]


def test_the_best_of_a_name_is_that_of_all_its_pairs(spark):
    ranks, advice = {}, set()
    for seed in range(4):
        rows = close_records(seed, 400)
        want = {}
        for a, b in combinations(rows, 2):
            if a[2] and a[2] == b[2]:
                score, told = scored(a, b)
                top = want.get(a[2], (0, "do_not_merge_likely"))
                want[a[2]] = max(top[0], score), min(top[1], told, key=I.ADVICE_RANK.get)
        found = I.duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(found) == len(want) and {r["normalized_name"]: (r["top_score"], r["top_recommendation"]) for r in found} == want
        advice |= {x for _, x in want.values()}
        ranks |= want
    assert advice == set(I.ADVICE_RANK)


def test_groups_of_a_name_form_no_pairs(spark):
    n = 100_000  # each a kind of its own: 5 billion pairs of kinds
    rows = spark.range(n).selectExpr(
        "concat('p', lpad(id, 7, '0')) AS person_id", "'Ann' AS name", "'ann' AS n_name", "CASE id % 2 WHEN 0 THEN 'male' ELSE 'female' END AS gender", "concat('party', id div 50) AS party", "concat('m', id % 50) AS position", "'' AS district",
        "array(concat('q', id)) AS external_ids", "CASE WHEN id < 2 THEN array('b') ELSE array() END AS birth_dates", "array('r') AS candidate_regions",
    )
    group = I.duplicate_groups(rows).collect()
    assert [(r["record_count"], r["top_score"], r["top_recommendation"]) for r in group] == [(n, 45, "same_name_only")]


def test_gaps_need_no_links_of_classes(spark):
    from lakemill.plans import registry
    from tests.conftest import SMALL

    for name in ("r17_identity_gaps", "a15_gap_histogram"):
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "blocks_" not in plan and "parquet" not in plan  # the tables are read once, for a checkpoint


def test_the_histogram_reads_its_gaps_once(spark):
    from lakemill.operators import reports as R

    gaps = spark.range(3).selectExpr("CASE WHEN id = 0 THEN 'high' ELSE 'low' END AS priority", "CASE WHEN id = 2 THEN 'birth_date,external_id' ELSE 'external_id' END AS missing_signals")
    out = R.gap_histogram(gaps)
    assert {tuple(r) for r in out.collect()} == {("priority:high", 1), ("priority:low", 2), ("signal:external_id", 3), ("signal:birth_date", 1)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1
