"""Regions found in texts by pieces, against a loop over all regions."""

from __future__ import annotations

import random

from lakemill.operators import people


def test_pieces_find_what_a_loop_finds(spark):
    r = random.Random(9)
    word = lambda k: "".join(r.choice("臺北市 縣𝒳a") for _ in range(k))
    regions = [(i, f"region-{i}", word(r.randint(1, 4)) if i % 7 else None, None if i % 5 == 0 else f"slug{i}") for i in range(60)] + [(60, "region-60", "whole", "whole")]
    texts = list({word(r.randint(0, 9)) for _ in range(120)} | {"region-3", "slug7", "xslug7", "slug", "the whole of it", ""})
    want = {}
    for t in texts:
        hits = [(p, i, n) for p, i, n, s in regions if t in (i, s) or (n is not None and n in t)]
        if hits:
            want[t] = min(hits)[:2]
    df = people.first_regions(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(regions, "place int, region_id string, name string, slug string"))
    assert {x["text"]: (x["stage"]["place"], x["stage"]["region_id"]) for x in df.collect()} == want


def test_no_nested_loop_over_regions(spark):
    regions = spark.range(100_000).selectExpr("CAST(id AS INT) AS place", "concat('region-', id) AS region_id", "concat('name', id, '.') AS name", "concat('slug', id) AS slug")
    texts = spark.range(20_000).selectExpr("concat('in name', id, '. and name', id + 50000, '.') AS text")
    found = people.first_regions(texts, regions)
    assert found.where("stage.place = CAST(regexp_extract(text, 'in name([0-9]+)', 1) AS INT)").count() == 20_000
