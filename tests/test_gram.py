import numpy as np
import pytest

from surveyloom.operators import gram


def cells(df):
    return {(r["row"], r["col"]): r["cov"] for r in df.collect()}


def table(spark, values):
    rows = [[None if np.isnan(x) else float(x) for x in row] for row in values]
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(values.shape[1])))


def test_equals_numpy_far_from_zero(spark):
    values = np.random.default_rng(1).normal(size=(500, 6)).cumsum(1) + 1e8
    got = cells(gram.gram_covariance(table(spark, values).repartition(7), [f"c{i}" for i in range(6)]))
    want = np.cov(values, rowvar=False)
    assert len(got) == 36
    for i in range(6):
        for j in range(6):
            assert got[f"c{i}", f"c{j}"] == pytest.approx(want[i, j], rel=1e-6) == got[f"c{j}", f"c{i}"]


def test_gaps_leave_out_a_pair_only(spark):
    draw = np.random.default_rng(2)
    values = draw.integers(-3, 9, size=(300, 5)).astype(float)
    values[draw.random(values.shape) < 0.3] = np.nan
    values[:, 4] = np.nan
    values[0, 4] = 1.0
    got = cells(gram.gram_covariance(table(spark, values).repartition(5), [f"c{i}" for i in range(5)], list("abcde")))
    for i in range(4):
        for j in range(4):
            both = values[~np.isnan(values[:, i]) & ~np.isnan(values[:, j])]
            assert got["abcde"[i], "abcde"[j]] == pytest.approx(np.cov(both[:, i], both[:, j])[0, 1])
    assert got["e", "e"] is None and got["a", "e"] is None


def test_batches_merge_to_the_whole():
    draw = np.random.default_rng(3)
    values = draw.normal(size=(90, 4)) * [1, 10, 1e3, 1e-3] + [0, 5, -1e6, 2]
    values[draw.random(values.shape) < 0.2] = np.nan
    total = gram.batch_moments(values[:1])
    for lo, hi in [(1, 1), (1, 30), (30, 31), (31, 90)]:
        if hi > lo:
            total = gram.merged(total, gram.batch_moments(values[lo:hi]))
    for left, right in zip(total, gram.batch_moments(values)):
        assert np.allclose(left, right, rtol=1e-9, atol=1e-9)


def test_empty_table_other_columns_and_names(spark):
    df = spark.createDataFrame([], "i double, n double, x string")
    got = cells(gram.gram_covariance(df, ["i", "n"]))
    assert set(got) == {("i", "i"), ("i", "n"), ("n", "i"), ("n", "n")} and set(got.values()) == {None}
    for columns, names in [([], None), (["i", "n"], ["a", "a"]), (["i", "n"], ["a"])]:
        with pytest.raises(ValueError):
            gram.gram_covariance(df, columns, names)


def test_plan_does_not_grow_with_the_columns(spark):
    def operators(k):
        df = spark.range(50).selectExpr(*[f"cast(id % {i + 2} as double) as c{i}" for i in range(k)])
        found = gram.gram_covariance(df, df.columns)
        return found, [line.strip(" +-:()*0123456789").split(" ")[0].split("(")[0]
                       for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]

    wide, plan = operators(500)
    assert plan == operators(3)[1] and sum(line.startswith("Aggregate") for line in plan) == 1
    assert wide.count() == 500 * 500
