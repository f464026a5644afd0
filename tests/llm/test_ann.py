"""Nearest neighbours against brute force."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.llm import op01_ann as A
from tests.conftest import SMALL

MEDIUM = SMALL.replace("0.001", "0.1")


def brute(ids, vectors, k):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % 20 == 0:
            scores = vectors @ v
            order = np.lexsort((ids, -scores))
            out[i] = [(int(ids[o]), float(scores[o])) for o in order if ids[o] != i][:k]
    return out


def test_finds_what_brute_force_finds(spark):
    r = np.random.default_rng(2)
    vectors = np.round(r.standard_normal((1500, 16)), 3)
    vectors[700:900] = vectors[3]  # equal vectors: ties go to the smaller id
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    rows = A.usable(df, "vec_id", "embedding")
    got: dict[int, list] = {}
    for row in A.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), shard_rows=300, block_rows=40).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    want = brute(ids, vectors, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.95 * 20 * len(want)
    for q in got:  # nearest first, ties to the smaller id
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    exact = {q: [i for i, _ in sorted(((int(i), float((vectors[i] * vectors[q]).sum())) for i in ids if i != q), key=lambda x: (-x[1], x[0]))[:20]] for q in (700, 720)}
    assert all([i for i, _ in got[q]] == exact[q] for q in exact)
    assert all(abs(s - float(vectors[i] @ vectors[q])) < 1e-9 for q in got for i, s in got[q])


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="no test tables here")
def test_recall_on_the_embeddings(spark):
    """Every dealt query against brute force over all embeddings, with shards so small that most are not visited at once."""
    df = A.usable(spark.read.parquet(f"{MEDIUM}/embeddings.parquet"), "vec_id", "embedding")
    rows = df.toPandas().sort_values("vec_id")
    vectors, ids = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy()
    got: dict[int, set] = {}
    for r in A.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=1024).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits, n = 0, 0
    for q in ids[ids % 20 == 0]:
        scores = vectors @ vectors[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-scores)[:20]]))
        n += 20
    assert hits >= 0.95 * n


def test_cells_hold_their_points():
    r = np.random.default_rng(6)
    points = np.concatenate([r.standard_normal((3000, 8)), np.zeros((500, 8))])
    cells = A.Cells.of(points, 100)
    own = cells.cell(points)
    assert (points >= cells.low[own]).all() and (points <= cells.high[own]).all()
    assert len(cells.low) > 20 and np.bincount(own).max() <= 600
    assert (cells.distances(points)[np.arange(len(points)), own] == 0).all()


def test_ties_go_to_smaller_ids_and_own_row_is_none(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 1.0])]
    df = A.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = A.nearest(df, df.where("vec_id % 20 = 0")).where("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20))
    assert [r["vec_id"] for r in A.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == list(range(1, 21))


def test_ties_across_leaves_are_cut_by_id():
    r = np.random.default_rng(12)
    base = r.standard_normal((400, 96))
    ids = r.permutation(2400)
    vectors = base[ids % 400]
    queries, query_ids = vectors[:1000], ids[:1000]
    longest = float(np.sqrt((vectors**2).sum(1).max())) * (1 + 1e-12)
    q, found, score = A.search(vectors, ids, longest, queries, query_ids, 20, 1 - 1e-12)
    order = np.lexsort((found, -score, q))
    q, found, score = q[order], found[order], score[order]
    wrong = 0
    for i, own in zip(query_ids.tolist(), queries, strict=True):
        exact = (vectors * own).sum(1)
        exact[ids == i] = -np.inf
        wrong += found[q == i].tolist() != ids[np.lexsort((ids, -exact))[:20]].tolist()
    assert wrong == 0


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0, 1.0])]
    df = A.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in A.nearest(df, df.where("vec_id % 20 = 0")).collect()] == [(0, 1, 7, 3.0)]


def test_empty_table(spark):
    df = A.usable(spark.createDataFrame([], "vec_id long, embedding array<float>, score double"), "vec_id", "embedding")
    assert A.nearest(df, df).count() == 0


def test_quantile():
    assert abs(A.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3
