import pytest
from pyspark.sql import functions as F

from surveyloom.operators import ranks


def ids(spark, n, parts=3):
    return spark.range(0, n, 1, parts).withColumn("note", F.concat(F.lit("n"), F.col("id")))


@pytest.mark.parametrize("seed", ["1", "2", "x"])
def test_hash_rank_numbers_every_row_whatever_the_partitions(spark, seed):
    def ranked(parts, digits):
        out = ranks.hash_rank(ids(spark, 700, parts), ["id"], seed, digits=digits)
        return {r.id: r["rank"] for r in out.collect()}

    first = ranked(3, 3)
    assert sorted(first.values()) == list(range(700))
    assert first == ranked(17, 1) == ranked(1, 2)


def test_different_salts_give_different_orders(spark):
    a = [r.id for r in ranks.hash_rank(ids(spark, 200), ["id"], "a").orderBy("rank").collect()]
    b = [r.id for r in ranks.hash_rank(ids(spark, 200), ["id"], "b").orderBy("rank").collect()]
    assert sorted(a) == sorted(b) and a != b


def test_band_agrees_with_the_full_rank(spark):
    df = ranks.hash_rank(ids(spark, 500), ["id"], "s")
    cuts = [0, 1, 77, 77, 499, 500, 9000]
    banded = ranks.rank_band(df, ["id"], "s", lambda n: [F.lit(c).cast("bigint") for c in cuts], len(cuts))
    for row in banded.collect():
        assert row.band == sum(c <= row["rank"] for c in cuts)


@pytest.mark.parametrize("rows,num", [(50, 20), (50, 50), (50, 120), (1, 7), (50, 0), (7, 1000)])
def test_quotas(spark, rows, num):
    got = [r.quota for r in ranks.assign_quota(ids(spark, rows), num, ["id"], "q").collect()]
    assert sum(got) == num and len(got) == rows
    assert max(got) - min(got) <= 1


@pytest.mark.parametrize("n", [0, 1, 33, 100, 500])
def test_sample_and_holdout_split_the_rows(spark, n):
    df = ids(spark, 100)
    sample = {r.id for r in ranks.exact_sample(df, n, ["id"], "s").collect()}
    rest = {r.id for r in ranks.holdout(df, n, ["id"], "s").collect()}
    assert len(sample) == min(n, 100)
    assert not sample & rest and sample | rest == set(range(100))
    again = {r.id for r in ranks.exact_sample(df.repartition(9), n, ["id"], "s").collect()}
    assert sample == again


@pytest.mark.parametrize("rows", [5, 23, 100])
def test_folds_are_blocks_of_the_shuffle(spark, rows):
    df = ranks.shuffle_index(ranks.kfold_assign(ids(spark, rows), 5, ["id"], "f"), ["id"], "f")
    for row in df.collect():
        assert row.fold == min(row["index"] // (rows // 5), 4)


def test_too_few_rows_for_the_folds(spark):
    with pytest.raises(Exception, match="fewer rows than the 5 folds"):
        ranks.kfold_assign(ids(spark, 4), 5, ["id"], "f").collect()
    with pytest.raises(ValueError):
        ranks.kfold_assign(ids(spark, 4), 1, ["id"], "f")


def test_copies_stay_in_the_fold_of_their_source(spark):
    copies = ids(spark, 60).withColumn("draw_no", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    per_source = ranks.fold_by_source(copies, 3, "id", "f").groupBy("id").agg(F.count_distinct("fold").alias("n"))
    assert per_source.where("n > 1").isEmpty()


def test_train_is_the_complement_of_test(spark):
    folded = ranks.kfold_assign(ids(spark, 40), 4, ["id"], "f")
    train, test = ranks.fold_split(folded, 2)
    assert train.count() + test.count() == 40
    by_join = ranks.train_complement(folded, test, ["id"])
    assert sorted(r.id for r in by_join.collect()) == sorted(r.id for r in train.collect())


def test_duplicate_keys_are_reported(spark):
    df = ids(spark, 5)
    ranks.require_unique(df, ["id"])
    with pytest.raises(ValueError, match="not unique"):
        ranks.require_unique(df.unionAll(df.where("id = 3")), ["id"])


def test_samples_do_not_move_wide_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    ids(spark, 100).write.parquet(path)
    plan = ranks.exact_sample(spark.read.parquet(path), 10, ["id"], "s")
    text = plan._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "note:string" in line]
    assert scans
    for scan in scans:
        level = depth[scan]
        for i in range(scan, -1, -1):
            if depth[i] < level:  # an ancestor of the scan of the wide rows
                level = depth[i]
                assert "Exchange" not in lines[i] and "Sort" not in lines[i]
