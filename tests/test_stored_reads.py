"""Postings and stored pages against plain scans, and what a look-up reads."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lakemill.operators import stored_reads as R
from lakemill.operators.people import page


def test_search_equals_a_scan_and_reads_its_own_postings(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("ab王小明 x") for _ in range(r.randint(0, 8)))
    rows = [(i, r.choice([None, word()]), word()) for i in range(400)]
    df, folder = spark.createDataFrame(rows, "id long, alias string, name string"), str(tmp_path / "index")
    R.write_index(df, folder, [F.col("alias"), F.lower("name")], buckets=16)
    for q in ("a", "王小", "ab王", "x x", "", "zz", "小明小明小明"):
        want = sorted(i for i, a, n in rows if q and (q in (a or "") or q in n.lower()))
        assert sorted(x["id"] for x in R.find(spark, folder, q, "id long, alias string, name string", buckets=16).collect()) == want
    plan = R.find(spark, folder, "王小明", "id long, alias string, name string", buckets=16)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket_", plan) and re.search(r"PushedFilters: \[[^\]]*piece", plan)


def test_every_page_reads_one_block(spark, tmp_path):
    people = spark.range(1000).selectExpr("concat('p', lpad(id, 4, '0')) AS person_id", "concat('n', id % 77) AS name", "CASE id % 3 WHEN 0 THEN 'candidate' ELSE 'other' END AS role", "CASE id % 2 WHEN 0 THEN 'current' ELSE 'other' END AS status")
    folder, schema = str(tmp_path / "pages"), "person_id string, name string, role string, status string"
    R.write_pages(people, folder, block=100)
    for number in (1, 7, 50, 999, 0):
        got = [(x["place"], x["person_id"]) for x in R.read_page(spark, folder, number, schema, block=100).orderBy("place").collect()]
        want = [(x["place"], x["person_id"]) for x in page(people, number).orderBy("place").collect()]
        assert got == want and len(got) == 20
    plan = R.read_page(spark, folder, 50, schema, block=100)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block_", plan)
    R.write_pages(people.limit(0), str(tmp_path / "none"), block=100)
    assert R.read_page(spark, str(tmp_path / "none"), 3, schema, block=100).count() == 0


def test_folders_of_pages_have_a_bound_and_a_page_looks_at_its_own(spark, tmp_path):
    people = spark.range(1000).selectExpr("concat('p', lpad(id, 4, '0')) AS person_id", "concat('n', id % 77) AS name", "CASE id % 3 WHEN 0 THEN 'candidate' ELSE 'other' END AS role", "CASE id % 2 WHEN 0 THEN 'current' ELSE 'other' END AS status")
    folder, schema = str(tmp_path / "pages"), "person_id string, name string, role string, status string"
    R.write_pages(people, folder, block=1)
    assert len(list((tmp_path / "pages" / "rows").glob("block_=*"))) <= R.MOST_FOLDERS
    for number in (1, 13, 50, 51):
        rows = R.read_page(spark, folder, number, schema, block=1)
        assert sorted((x["place"], x["person_id"]) for x in rows.collect()) == sorted((x["place"], x["person_id"]) for x in page(people, number).collect())
        assert len(rows.inputFiles()) <= 6
