import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from surveyloom.operators import information


def brute_force(x, y):
    n, joint, fx, fy = len(x), Counter(zip(x, y)), Counter(x), Counter(y)
    return sum(c / n * math.log(c * n / (fx[a] * fy[b])) for (a, b), c in joint.items())


def random_table(spark, rows=400, seed=3):
    rng = np.random.default_rng(seed)
    f1 = rng.integers(0, 5, rows)
    data = {
        "f1": f1, "f2": rng.integers(0, 30, rows), "t1": (f1 + rng.integers(0, 2, rows)) % 5,
        "t2": rng.integers(-9, 3, rows), "same": f1,
    }
    rows_ = [tuple(float(v[i]) for v in data.values()) for i in range(rows)]
    return data, spark.createDataFrame(rows_, list(data)).repartition(4)


def test_matches_brute_force(spark):
    data, df = random_table(spark)
    got = information.mutual_information(df, ["f1", "f2", "same"], ["t1", "t2"]).collect()
    assert len(got) == 6
    for row in got:
        assert abs(row.mi - brute_force(data[row.feature], data[row.target])) < 1e-10


def test_identical_and_independent(spark):
    df = spark.range(0, 600).select(
        (F.col("id") % 4).cast("double").alias("a"),
        (F.col("id") % 4).cast("double").alias("b"),
        F.floor(F.col("id") / 4 % 3).cast("double").alias("c"),
    )
    mi = {(r.feature, r.target): r.mi for r in information.mutual_information(df, ["a"], ["b", "c"]).collect()}
    assert abs(mi["a", "b"] - math.log(4)) < 1e-12
    assert 0 <= mi["a", "c"] < 1e-12


def test_one_value_holding_a_third_of_the_rows(spark):
    df = spark.range(0, 900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("double").alias("f"),
        (F.col("id") % 2).cast("double").alias("t"),
    )
    rows = df.collect()
    got = information.mutual_information(df, ["f"], ["t"]).collect()[0].mi
    assert abs(got - brute_force([r.f for r in rows], [r.t for r in rows])) < 1e-10


def test_contingency_counts_every_pair(spark):
    data, df = random_table(spark)
    got = information.contingency(df, ["f1"], ["t1"]).collect()
    assert {(r.feature_value, r.target_value): r.n for r in got} == Counter(
        (float(a), float(b)) for a, b in zip(data["f1"], data["t1"])
    )


def test_equal_sums_are_ordered_by_name(spark):
    sums = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "feature string, mi_sum double")
    assert information.feature_names(information.top_k_features(sums, 2)) == ["c", "a"]


def test_many_columns_take_one_scan(spark, tmp_path):
    path = str(tmp_path / "wide")
    names = [f"c{i}" for i in range(150)]
    spark.range(0, 50).select(
        *[(F.col("id") % (2 + i % 5)).cast("double").alias(n) for i, n in enumerate(names)]
    ).write.parquet(path)
    out = information.mutual_information(spark.read.parquet(path), names[:145], names[145:])
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert out.count() == 145 * 5
