"""The mix against its rule worked out in Python."""

from __future__ import annotations

import pytest

from lakemill.llm import op05_mixing as M
from tests.llm.helpers import documents


def water(sizes, share=1.5):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    budget, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


ROWS = [(i, "w " * (i % 17), ("hot", "b", "c", "d", None)[0 if i % 3 else i % 5]) for i in range(400)] + [(None, "a b", "b"), (7, None, "z"), (8, "x y", "b"), (8, "x y", "b"), (500, "", "zero")]


def test_targets_and_parts(spark):
    df = documents(spark, [(*r, 5) for r in ROWS], "doc_id long, text string, source string, taken int")
    rows = M.mix_documents(df, bucket_rows=16).collect()
    assert len(rows) == len(ROWS)
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["position"] <= 1
    want = water(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)


def test_names_of_columns_never_clash(spark):
    names = ("row", "place", "bucket", "buckets", "ramp", "t_source", "b_source", "b_bucket", "base", "upto", "share_", "inside", "rows", "s_", "weight")
    df = documents(spark, [(*r, *names) for r in ROWS], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for keep in (False, True):
        rows = M.mix_documents(df, keep_text=keep).collect()
        assert len(rows) == len(ROWS) and all(tuple(r[n] for n in names) == names for r in rows)
    long = documents(spark, [(1, "w " * 500_000, "a"), (2, "w", "b")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in M.mix_documents(long).collect()} == {1: 500_000, 2: 1}


def test_reruns_agree_and_order_is_by_position(spark):
    df = documents(spark, ROWS, "doc_id long, text string, source string")
    a, b = (M.in_training_order(M.mix_documents(df)).select("doc_id", "source", "taken", "position").collect() for _ in range(2))
    assert a == b and [r["position"] for r in a] == sorted(r["position"] for r in a)


def test_empty_table_and_only_empty_texts(spark):
    assert M.mix_documents(documents(spark, [], "doc_id long, text string, source string")).count() == 0
    row = M.mix_documents(documents(spark, [(1, "", None)], "doc_id long, text string, source string")).first()
    assert (row["size"], row["taken"], row["target"]) == (0, 0, 0.0)


@pytest.mark.parametrize("start", [0.5, 1.0, 1.5])
def test_demand_is_inverted(spark, start):
    from pyspark.sql import functions as F

    end = 2 - start
    for part in (0.0, 0.3, 1.0):
        t = spark.range(1).select(M.demand_time(F.lit(part), F.lit(start), F.lit(end)).alias("t")).first()["t"]
        assert abs(start * t + (end - start) * t * t / 2 - part) < 1e-9


def test_sql_agrees(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "documents.parquet")
    documents(spark, ROWS, "doc_id long, text string, source string").write.parquet(path)
    got = {tuple(r) for r in M.op5_mixing(spark, str(tmp_path)).select("doc_id", "size", "source_size", "taken", "position").collect()}
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, size, source_size, taken, position FROM ({M.SQL.format(documents=f"'{path}/*.parquet'")}) x").fetchall()
    assert got == {tuple(r) for r in rows}
