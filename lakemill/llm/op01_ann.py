"""Approximate nearest neighbours by low-dimensional stable projections in kd-trees.

Vectors are projected on a few Gaussian directions. A projected squared distance
divided by the true one follows a chi-square distribution with as many degrees
of freedom as directions, whatever the data. So a vector nearer than the k-th best
so far would, with the asked probability, have been projected within a bound.

A kd-tree over the projected points of a bounded sample cuts the space into cells,
and each vector goes to the shard of its cell, once. A query first visits the
cell nearest to it; the k-th best of that then tells by the test which other cells
can hold anything better, and it visits those only. Inside a shard a kd-tree of
its own gives leaves in the order of their projected distance from the query;
their vectors are verified exactly, leaf after leaf, until the test holds.

The largest inner product becomes the smallest distance by one more component
that gives all indexed vectors the same length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.llm.common import if_small, pieces, stored, table

DIRECTIONS, LEAF, SEED = 8, 64, 11
#: Vectors of a shard, about, and queries of a block; projected points that the cells are cut by.
SHARD_ROWS, BLOCK_ROWS, SAMPLE_ROWS = 8192, 16384, 200_000
#: Probability that a better vector would have been met before the search stops.
CERTAINTY = 0.97


def chi_square_quantile(p: float, k: int) -> float:
    """By halving; the distribution function of even k has a closed form."""
    low, high = 0.0, 200.0 + 10 * k
    for _ in range(200):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return (low + high) / 2


def kd_order(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Point numbers in the order of the tree's leaves, and the leaves' bounds; each node is cut at the median of its widest axis."""
    order, bounds, stack = np.arange(len(points)), [0], [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            bounds.append(b)
            continue
        own = points[order[a:b]]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], middle, axis=0)]
        stack += [(a + middle, b), (a, a + middle)]
    return order, np.array(bounds)


@dataclass
class Cells:
    """A kd-tree's inner nodes and the boxes of its leaves, the cells; a child below zero is the cell -1 - child."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # nodes x 2
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(points: np.ndarray, rows: float) -> Cells:
        """Cells of about so many of these points; cut at the median of the widest axis."""
        axis, cut, child, low, high = [], [], [], [], []
        everywhere = np.full(points.shape[1], np.inf)
        pending = [(np.arange(len(points)), -everywhere, everywhere, None)]
        while pending:
            own, a, b, parent = pending.pop()
            d = int((points[own].max(0) - points[own].min(0)).argmax()) if len(own) else 0
            at = float(np.median(points[own, d])) if len(own) else 0.0
            left = points[own, d] < at
            if len(own) <= rows or not left.any():
                number = -1 - len(low)
                low.append(a)
                high.append(b)
            else:
                number = len(axis)
                axis.append(d)
                cut.append(at)
                child.append([0, 0])
                upper, lower = a.copy(), b.copy()
                upper[d], lower[d] = at, at
                pending += [(own[left], a, lower, (number, 0)), (own[~left], upper, b, (number, 1))]
            if parent:
                child[parent[0]][parent[1]] = number
        return Cells(np.array(axis, np.int64), np.array(cut), np.array(child, np.int64).reshape(-1, 2), np.array(low), np.array(high))

    def cell(self, points: np.ndarray) -> np.ndarray:
        """The cell that each point lies in."""
        node = np.zeros(len(points), np.int64) if len(self.axis) else np.full(len(points), -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            node[inner] = self.child[n, (points[inner, self.axis[n]] >= self.cut[n]).astype(int)]
        return -1 - node

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points from all cells."""
        return box_distances(points, self.low, self.high)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        out += np.maximum(0, np.maximum(low[None, :, d] - points[:, None, d], points[:, None, d] - high[None, :, d])) ** 2
    return out


def directions_of(dimension: int) -> np.ndarray:
    """Directions for vectors with one more component."""
    return np.random.default_rng(SEED).standard_normal((dimension + 1, DIRECTIONS))


def projected(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Indexed vectors' projections; the component that is added makes them all as long as the longest."""
    directions, squares = directions_of(vectors.shape[1]), np.einsum("ij,ij->i", vectors, vectors)
    return vectors @ directions[:-1] + np.sqrt(np.maximum(longest**2 - squares, 0))[:, None] * directions[-1]


def bound(kth: np.ndarray, queries: np.ndarray, longest: float, quantile: float) -> np.ndarray:
    """Squared projected distance beyond which nothing better than each query's k-th best is expected."""
    reach = longest**2 + np.einsum("ij,ij->i", queries, queries)  # a squared distance is this less twice the product
    return np.where(np.isfinite(kth), quantile * np.maximum(reach - 2 * np.where(np.isfinite(kth), kth, 0), 0), np.inf)


def search(
    vectors: np.ndarray, ids: np.ndarray, longest: float, queries: np.ndarray, query_ids: np.ndarray, k: int, certainty: float = CERTAINTY, floor: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """(query, id, score) of the k best that a shard's tree gives to each query, of those that aren't below the query's floor."""
    vectors, queries = np.ascontiguousarray(vectors, np.float64), np.ascontiguousarray(queries, np.float64)
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    points = projected(vectors, longest)
    order, bounds = kd_order(points)
    points, vectors, ids = points[order], vectors[order], ids[order]
    leaves = list(zip(bounds[:-1], bounds[1:], strict=True))
    far = box_distances(queries @ directions_of(queries.shape[1])[:-1], np.array([points[a:b].min(0) for a, b in leaves]), np.array([points[a:b].max(0) for a, b in leaves]))
    turn = np.argsort(far, axis=1, kind="stable")
    quantile = chi_square_quantile(certainty, DIRECTIONS)
    best, place = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    least_id = np.append(ids, np.iinfo(np.int64).max)  # of place -1, the last
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        leaf = turn[active, step]
        kth = np.maximum(best[active, -1], floor[active])
        more = far[active, leaf] <= bound(kth, queries[active], longest, quantile)
        active, leaf = active[more], leaf[more]
        if not len(active):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
        for rows in np.split(by_leaf, cuts):
            a, b = leaves[leaf[rows[0]]]
            q = active[rows]
            score = queries[q] @ vectors[a:b].T
            score[query_ids[q][:, None] == ids[None, a:b]] = -np.inf
            least = np.maximum(best[q, -1], floor[q])
            if score.shape[1] > k:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
            near = score >= np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.finfo(float).max)[:, None]  # sums in another order differ by less
            # What may be among the best is scored pair by pair before anything is cut: equal vectors have equal scores wherever they lie.
            ask, at = np.nonzero(near)
            score = np.full(score.shape, -np.inf)
            for i in range(0, len(ask), 65536):
                u, v = ask[i : i + 65536], at[i : i + 65536]
                score[u, v] = (queries[q[u]] * vectors[a + v]).sum(1)
            good = np.flatnonzero((score >= best[q, -1:]).any(1))  # equal scores may have smaller ids
            if len(good):
                q, score = q[good], score[good]
                all_scores = np.concatenate([best[q], score], axis=1)
                all_places = np.concatenate([place[q], np.broadcast_to(np.arange(a, b), score.shape)], axis=1)
                kept = np.lexsort((least_id[all_places], -all_scores), axis=1)[:, :k]
                best[q], place[q] = np.take_along_axis(all_scores, kept, 1), np.take_along_axis(all_places, kept, 1)
    q, at = np.nonzero(np.isfinite(best))
    return query_ids[q], ids[place[q, at]], best[q, at]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): rows whose vector takes part: not null, nor zero, nor empty, all components finite; v is in double precision."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, certainty: float = CERTAINTY, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query.

    Both tables are (vec_id, v) from ``usable``. A query's own row, any with its
    id, is no candidate. Of equal vectors, no more than the k+1 smallest ids are
    kept, as no more can be among the best; so a vector that a third of the rows
    hold costs no more than another. A query id that stands on several rows is
    asked once, with the row whose vector comes first in order. Vectors of
    another dimension than the query's are no candidates. Fewer candidates than
    k are all returned; an empty table gives an empty table.
    """
    alike = Window.partitionBy("v").orderBy("vec_id")
    rows = stored(vectors.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1).select(F.size("v").alias("d"), "vec_id", "v"))
    asked = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")).select(F.size("v").alias("d"), "vec_id", "v"))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).collect()  # a row for each dimension
    longest = {r["d"]: math.sqrt(r["top"]) * (1 + 1e-12) for r in sizes}
    every = max(1, sum(r["n"] for r in sizes) // SAMPLE_ROWS)
    points: dict[int, list[bytes]] = {d: [] for d in longest}
    for r in rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(every)) == 0).mapInArrow(_points(longest), "d int, point binary").toPandas().itertuples():
        points[r.d].append(r.point)
    cells = {r["d"]: Cells.of(np.frombuffer(b"".join(points[r["d"]]), np.float64).reshape(-1, DIRECTIONS), shard_rows / max(1, r["n"]) * max(1, len(points[r["d"]]))) for r in sizes}
    schema = "d int, shard int, vec_id long, v array<double>"
    placed = stored(rows.mapInArrow(_placed(cells, longest), schema))
    quantile = chi_square_quantile(certainty, DIRECTIONS)

    def visited(routed: DataFrame) -> DataFrame:
        """What routed queries (d, shard, vec_id, v, floor) find; a shard with many is searched in blocks."""
        blocks = routed.groupBy("d", "shard").agg(F.ceil(F.count("*") / block_rows).alias("blocks")).select(F.col("d").alias("b_d"), F.col("shard").alias("b_shard"), "blocks")
        blocks = if_small(stored(blocks))  # a row for each shard
        own = placed.join(blocks, (F.col("d") == F.col("b_d")) & (F.col("shard") == F.col("b_shard")))
        own = own.select("d", "shard", "vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        ask = routed.join(blocks, (F.col("d") == F.col("b_d")) & (F.col("shard") == F.col("b_shard"))).select("d", "shard", "vec_id", "v", "floor", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"))
        own, ask = own.select(*(F.col(c).alias(f"own_{c}") for c in own.columns)), ask.select(*(F.col(c).alias(f"ask_{c}") for c in ask.columns))

        def run(own: pa.Table, ask: pa.Table) -> pa.Table:
            empty = own.num_rows == 0 or ask.num_rows == 0
            q, i, s = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) if empty else _searched(own, ask, longest, k, certainty)
            return pa.table({"query_id": q, "vec_id": i, "score": s})

        return own.groupBy("own_d", "own_shard", "own_block").cogroup(ask.groupBy("ask_d", "ask_shard", "ask_block")).applyInArrow(run, "query_id long, vec_id long, score double")

    routed = schema + ", floor double"
    first = stored(visited(asked.withColumn("floor", F.lit(float("-inf"))).mapInArrow(_routed(cells, longest, quantile, True), routed)))
    floors = first.groupBy(F.col("query_id").alias("f_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    again = asked.join(floors, F.col("vec_id") == F.col("f_id"), "left").select("d", "vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    found = first.unionByName(visited(stored(again.mapInArrow(_routed(cells, longest, quantile, False), routed))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_dimension(rows: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    d = rows.column(rows.schema.get_field_index("d")).to_numpy()
    for one in np.unique(d):
        own = rows.filter(pa.array(d == one))
        yield int(one), own, own.column(own.schema.get_field_index("v")).flatten().to_numpy().reshape(-1, int(one))


def _points(longest: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for d, own, v in _by_dimension(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, d, np.int32)), pa.array([p.tobytes() for p in projected(v, longest[d])], pa.binary())], names=["d", "point"])

    return run


def _placed(cells: dict[int, Cells], longest: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for d, own, v in _by_dimension(rows):
                shard = cells[d].cell(projected(v, longest[d])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(shard), own.column(1), own.column(2)], names=["d", "shard", "vec_id", "v"])

    return run


def _routed(cells: dict[int, Cells], longest: dict[int, float], quantile: float, nearest_only: bool):
    """Queries (d, vec_id, v, floor) for the shards that they visit: the nearest, or all others that may hold anything better."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches, 512):
            for d, own, v in _by_dimension(rows):
                if d not in cells:  # no vector has so many components
                    continue
                far = cells[d].distances(v @ directions_of(d)[:-1])
                first = far.argmin(1)
                go = np.zeros(far.shape, bool)
                if not nearest_only:
                    go = far <= bound(own.column(3).to_numpy(), v, longest[d], quantile)[:, None]
                go[np.arange(len(go)), first] = nearest_only
                q, shard = np.nonzero(go)
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([own.column(0).take(at), pa.array(shard.astype(np.int32)), *(own.column(i).take(at) for i in (1, 2, 3))], names=["d", "shard", "vec_id", "v", "floor"])

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy().reshape(len(c), -1) for c in column.chunks if len(c)])


def _searched(own: pa.Table, ask: pa.Table, longest: dict[int, float], k: int, certainty: float) -> tuple[np.ndarray, ...]:
    return search(
        _matrix(own.column("own_v")), own.column("own_vec_id").to_numpy(), longest[own.column("own_d")[0].as_py()], _matrix(ask.column("ask_v")), ask.column("ask_vec_id").to_numpy(), k, certainty,
        ask.column("ask_floor").to_numpy(),
    )


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
