import math

import numpy as np
import pytest

from surveyloom.llm import negatives
from surveyloom.llm.negatives import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute_force(rows, k=5, low=80, high=100, every=100):
    last = lambda i: math.inf if i is None else i
    sound = [
        (i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, v, label) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), last(j), j, c) for b, (j, w, c) in enumerate(sound) if a != b]
        scored.sort(key=lambda t: t[:2])
        for p, _, j, _ in [t for t in scored if t[3] == label][:k]:
            near = [t for t in scored if t[3] != label and low * -p <= 100 * -t[0] <= high * -p][:k]
            out += [(i, j, n + 1, t[2], -p, -t[0]) for n, t in enumerate(near)]
    return sorted(out, key=str)


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("most", [1, 1000, 10**6, 10**9])
def test_products_are_exact(most):
    rng = np.random.default_rng(most % 97)
    a, b = rng.integers(-most, most + 1, (7, 3000)), rng.integers(-most, most + 1, (5, 3000))
    a[0], b[0] = most, -most
    if 3000 * most * most >= negatives.MOST:
        a, b = a[:, :2], b[:, :2]
    primes = negatives.primes_for(a.shape[1] * most * most)
    got = negatives.products(negatives.Residues(a, primes), negatives.Residues(b, primes))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert got.tolist() == want


def test_too_large_a_score():
    with pytest.raises(OverflowError):
        negatives.primes_for(1 << 400)


@pytest.mark.parametrize("seed, tile", [(1, 3), (2, 1 << 12)])
def test_equals_brute_force_with_ties_and_repeats(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(negatives, "TILE_ROWS", tile)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 2)
    monkeypatch.setattr(negatives, "SHARD_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 3)
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-3, 6, (300, 4)) / 8
    vectors[::3] = vectors[0]  # a third of all rows are one vector
    rows = [(int(i), v.tolist(), int(c)) for i, v, c in zip(rng.permutation(400)[:300], vectors, rng.integers(0, 4, 300))]
    rows += [(i, v, c) for i, v, c in rows[:20]]  # repeated rows
    assert found(hard_negatives(spark.createDataFrame(rows, SCHEMA), "vec_id % 20 = 0")) == brute_force(rows, every=20)


def test_rows_that_take_no_part_short_vectors_and_other_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [0.9, 2.0], 2), (None, [0.9, 1.9], 2), (None, [1.0, 1.5], 1), (3, None, 2),
        (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [1.0, 1.9], None), (100, [], 2), (8, [1.0, 1.0], 2),
        (200, [-1.0, -2.0], 1), (300, [5.0, 5.0], 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rid", "2 as id", "3 as vector", "4 as anchor", "5 as shard")
    assert found(hard_negatives(df)) == brute_force(rows)
    assert any(r[3] is None for r in found(hard_negatives(df)))
    other = hard_negatives(df, low_percent=50, high_percent=120, positives=2, negatives=3)
    want = [r for r in brute_force(rows, k=5, low=50, high=120) if r[2] <= 3]
    assert set(found(other)) <= set(want) and found(other)


def test_empty_tables(spark):
    assert found(hard_negatives(spark.createDataFrame([], SCHEMA))) == []
    assert found(hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA))) == []
    assert found(hard_negatives(spark.createDataFrame([(0, [], 1), (2, [], 1), (3, [], 2)], SCHEMA))) == [(0, 2, 1, 3, 0, 0)]


def test_scores_beyond_a_long(spark):
    with pytest.raises(OverflowError):
        hard_negatives(spark.createDataFrame([(0, [3e30], 1)], SCHEMA))
