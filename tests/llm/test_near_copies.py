"""Near copies around the similarity, in texts longer than a sketch, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lakemill.llm import near_copies as N
from tests.llm.helpers import documents


def pair(number: int, words: int, changed: int) -> tuple[list[str], list[str]]:
    """A text of distinct words and a copy whose last words are others."""
    own = [f"w{number}x{i}" for i in range(words)]
    return own, own[: words - changed] + [f"v{number}x{i}" for i in range(changed)]


def alike(a: list[str], b: list[str]) -> float:
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def left(spark, texts: list[list[str]]) -> set[int]:
    return {r["doc_id"] for r in N.one_of_each(documents(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}


def test_long_texts_are_decided_by_their_whole_sets(spark):
    texts, want = [], set()
    for k in range(60):
        changed = 90 + k % 20  # of 904 words, around a ninth of the shingles
        a, b = pair(k, 904, changed)
        want |= {2 * k} | ({2 * k + 1} if alike(a, b) < 0.8 else set())
        texts += [a, b]
    assert 60 < len(want) < 120 and left(spark, texts) == want


def test_a_failed_link_hides_no_other(spark):
    """Texts in a row: neighbours are alike enough, those further apart are not but their sketches may say so."""
    words = [f"w{i}" for i in range(1400)]
    chain = [words[i : i + 904] for i in (0, 98, 196, 294, 392)]
    assert alike(chain[0], chain[1]) >= 0.8 > alike(chain[0], chain[2])
    apart = [words[i : i + 904] for i in (0, 104)]
    assert alike(*apart) < 0.8
    assert left(spark, chain) == {0} and left(spark, apart) == {0, 1}


@pytest.mark.parametrize("roots", [None, [1, 2, 3, 3]])
def test_shard_with_doubtful_pairs(roots):
    base = np.arange(1, 1001, dtype=np.uint64) << np.uint64(40)
    sets = [base, base[100:], base[:100], base[:101]]
    sizes = np.array([len(x) for x in sets])
    key, a, b, certain = N.shard_links(np.zeros(4, np.int64), np.zeros(4, np.uint64), sizes, np.arange(4), [x[: N.SKETCH] for x in sets], None if roots is None else np.array(roots))
    got = {(x, y): c for x, y, c in zip(a.tolist(), b.tolist(), certain.tolist(), strict=True)}
    assert got == ({(3, 2): True} if roots is None else {}) | {k: c for k, c in got.items() if k == (1, 0) and not c}


def test_few_pairs_at_the_similarity_never_meet():
    r, lost = np.random.default_rng(5), 0
    for k in range(400):
        n = (18, 90, 450)[k % 3]
        a, b = ([f"{x}" for x in part] for part in np.split(r.permutation(10**6)[: 2 * n + 8], 2))
        changed = n // 9
        b = a[: len(a) - changed] + b[:changed]
        (f, x, *_), (g, y, *_) = (N.sketched(" ".join(t).encode()) for t in (a, b))
        lost += alike(a, b) >= 0.8 and (not set(x) & set(y) or (f ^ g).bit_count() > N.RADIUS)
    assert lost == 0


def test_repeated_lines_do_not_part_copies(spark):
    a = [f"w{i}" for i in range(200)]
    assert left(spark, [a, a + "one line of six words here".split() * 400]) == {0}


def test_crowds_are_dealt_and_lose_nothing(spark):
    """One band is shared by all texts of a crowd: near copies of a base, a group of their own, and some alone."""
    base = [f"w{i}" for i in range(300)]
    texts = [base] + [base[:k] + [f"x{k}"] + base[k + 1 :] for k in range(0, 300, 6)]
    other = [f"q{i}" if i % 2 else w for i, w in enumerate(base)]
    texts += [other] + [other[:k] + [f"y{k}"] + other[k + 1 :] for k in range(0, 300, 10)]
    texts += [[f"z{j}x{i}" for i in range(80)] for j in range(5)]
    df = documents(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    want = {0, 51, *range(len(texts) - 5, len(texts))}
    for crowd, leaders in ((4096, 64), (8, 2), (8, 0)):
        assert {r["doc_id"] for r in N.one_of_each(df, crowd, leaders).collect()} == want


def test_recall_of_planted_near_copies(spark):
    """Copies with words changed here and there, of 30 to 400 words: those at the similarity and above go."""
    r, texts, due = np.random.default_rng(8), [], 0
    for k in range(300):
        n = int(r.integers(30, 400))
        own = [f"w{k}x{i}" for i in range(n)]
        copy = list(own)
        for at in r.choice(n, max(1, int(n * r.choice([0.01, 0.02, 0.03]))), False):
            copy[at] = "other"
        due += alike(own, copy) >= 0.8
        texts += [own, copy]
    assert due > 150 and len(texts) - len(left(spark, texts)) >= 0.99 * due


def test_a_long_text_is_compared_whole(spark):
    long = [f"w{i}" for i in range(150_000)]
    assert left(spark, [long, long[:140_000] + ["x"] * 200, long[:100_000], ["a"]]) == {0, 2, 3}
