"""Fingerprints, trees and components against brute force; near copies."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from lakemill.llm import near_copies, op09_simhash as S
from lakemill.llm.components import components
from tests.llm.helpers import documents, odd_rows, prose


def fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(values, radius):
    """Smallest index reachable over pairs within the radius."""
    n, label = len(values), list(range(len(values)))
    near = [[j for j in range(n) if (values[i] ^ values[j]).bit_count() <= radius] for i in range(n)]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(n)]
        if new == label:
            return label
        label = new


def texts():
    r = random.Random(5)
    rows = [(i, prose(r, r.randrange(0, 80))) for i in range(120)]
    for i in range(60):
        words = rows[i][1].split()
        if words:
            words[r.randrange(len(words))] = "new"
        rows.append((1000 + i, " ".join(words)))
    return rows + odd_rows() + [(rows[3][0], rows[3][1])]


def test_components_equal_brute_force(spark):
    rows = texts()
    got = S.near_duplicates(documents(spark, [(*x, "y") for x in rows], "doc_id long, text string, fp string")).collect()
    values = [fingerprint(t) for _, t in rows]
    label = joined(values, 4)
    least: dict[int, int] = {}
    for (d, _), x in zip(rows, label, strict=True):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    want = sorted((str(d), f"{v:016x}", least.get(x)) for (d, _), v, x in zip(rows, values, label, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("limit", [8192, 8])
def test_links_connect_all_pairs_within_the_radius(spark, limit):
    r = np.random.default_rng(3)
    seeds = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([seeds, *(s ^ np.array([sum(1 << int(b) for b in r.choice(64, k, False)) for k in (1, 3, 4, 5, 9)], np.uint64) for s in seeds)]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {row["node"]: row["root"] for row in components(S.links(df, 4, limit)).collect()}
    groups: dict[int, set] = {}
    for v in values.view(np.int64).tolist():
        groups.setdefault(roots.get(v, v), set()).add(v)
    want: dict[int, set] = {}
    for v, x in zip(values.view(np.int64).tolist(), joined([int(v) for v in values], 4), strict=True):
        want.setdefault(x, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_trees_find_all_within_the_radius():
    r = np.random.default_rng(4)
    values = np.unique(r.integers(0, 1 << 12, 300, dtype=np.uint64))
    keys = np.sort(r.integers(0, 3, len(values)).astype(np.uint64))
    tree = S.forest(keys, values)
    got = {(int(a), int(b)) for x, y in S.near(tree, values, np.arange(len(values)), 2) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for i in range(len(values)) for j in range(len(values)) if keys[i] == keys[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 2}


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}
    assert components(edges.limit(0)).count() == 0


def test_empty_table(spark):
    assert S.near_duplicates(documents(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    r = random.Random(6)
    groups = [prose(r, 150) for _ in range(20)]
    rows, copies = [(i, g) for i, g in enumerate(groups)], []
    for i, g in enumerate(groups):
        copies.append((100 + i, g))
        words = g.split()
        words[40] = "changed"
        copies.append((200 + i, " ".join(words)))
    alone = [(300 + i, prose(r, 120)) for i in range(30)]
    names = ("sketch", "tid", "row", "doc", "root", "again", "k_doc", "k_tid", "shard", "key", "a b", "node")
    schema = "doc_id long, text string" + "".join(f", `{n}` string" for n in names)
    df = documents(spark, [(*x, *names) for x in [*rows, *copies, *alone, (7, groups[7]), (400, None), (401, ""), (None, groups[1])]], schema)
    out = near_copies.one_of_each(df)
    assert all(tuple(r)[2:] == names for r in out.collect())
    assert out.columns == df.columns
    assert sorted(x["doc_id"] for x in out.collect()) == [*range(20), *range(300, 330), 400]
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_sketch_similarity_is_exact_for_short_texts():
    r = random.Random(1)
    a, b = prose(r, 100), prose(r, 100)
    x, y = a + " " + b, a + " " + prose(r, 100)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x, y)]
    sketches = [np.frombuffer(near_copies.sketched(t.encode())[2], np.uint64) for t in (x, y)]
    assert abs(near_copies.similarity(*sketches) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 1e-9
