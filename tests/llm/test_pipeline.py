"""The pipeline: stages in order, each on what its predecessor kept, against the operators' own answers."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm.helpers import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    path = tmp_path_factory.mktemp("data")
    item = prose(r, 40)
    rows = [(i, prose(r, 80) if i % 4 else prose(r, 80).upper().replace(" ", "!! "), "en", f"s{i % 3}", 0) for i in range(400)]
    rows += [(500, rows[1][1], "en", "s1", 0), (501, rows[2][1] + " x", "en", "s1", 0), (502, prose(r, 40) + " " + item, "en", "s2", 0), (503, prose(r, 40) + " mail a@b.co", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "mixing":
            assert docs.columns == columns
        docs = docs.cache()
        kept[name] = {r["doc_id"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert len([d for d in kept["quality"] if d < 400 and d % 4 == 0]) < 10 and len([d for d in kept["quality"] if d >= 400 or d % 4]) >= 300
    assert kept["quality"] - kept["near_duplicates"] == {500, 501} & kept["quality"]
    assert kept["near_duplicates"] - kept["decontamination"] == {502} & kept["near_duplicates"]
    assert kept["decontamination"] == kept["personal_data"] == kept["mixing"]
    if 503 in kept["mixing"]:
        assert "a@b.co" not in docs.where("doc_id = 503").first()["text"]
    assert {"taken", "position", "target"} <= set(docs.columns)


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    a = sorted((r["doc_id"], r["taken"]) for r in docs.collect())
    assert sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, folder).collect()) == a


def test_every_stage_takes_odd_rows_and_any_names(spark, folder):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, and columns named as what the stages add."""
    from tests.llm.helpers import odd_rows

    names = ("score", "predicted", "label_", "quality_score", "quality_accepted", "leak_item", "leak_share", "leak_found", "item_id", "contaminated", "fp", "tid", "row", "doc", "root", "bucket", "place", "spans", "Rows")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(d, t, None, "s" if d and d % 2 else None, None if d is None else len(t or ""), *names) for d, t in odd_rows()]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, folder)
            got = out.collect()
            if name != "mixing":
                assert out.columns == docs.columns
            assert set(docs.columns) <= set(out.columns) and all(tuple(r[n] for n in names) == names for r in got)
            if name in ("decontamination", "personal_data", "mixing"):
                assert len(got) == (len(rows) if df is docs else 0)
            if name == "near_duplicates" and df is docs:
                assert sorted((r["doc_id"] for r in got), key=str) == sorted([1, 3, 4, 5, 6, None], key=str)
