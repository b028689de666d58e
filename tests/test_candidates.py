import pytest
from pyspark.sql import functions as F

from surveyloom.operators import candidates
from surveyloom.operators.labels import domain_violations

LABELS = {
    "pair": {"1": "yes", "2": "no"},
    "five": {"1": "a", "2": "b", "3": "c", "4": "d", "5": "e"},
    "many": {str(i): f"band {i}" for i in range(1, 27)},
}
TARGETS = list(LABELS)


def source(spark, rows=60):
    return spark.range(0, rows, 1, 3).select(
        "id",
        F.concat(F.lit("x"), F.col("id")).alias("kept"),
        (F.col("id") % 2 + 1).cast("string").alias("pair"),
        (F.col("id") % 5 + 1).cast("string").alias("five"),
        (F.col("id") % 26 + 1).cast("string").alias("many"),
    )


def spelled(df):
    for t, codes in LABELS.items():
        entries = F.create_map(*[F.lit(x) for p in codes.items() for x in p])
        df = df.withColumn(t, entries[F.col(t)])
    return df


def rows_of(df):
    return sorted(tuple(r) for r in df.select("id", "draw_no", "kept", *TARGETS).collect())


@pytest.mark.parametrize("mode", ["num", "text"])
@pytest.mark.parametrize("num", [20, 60, 203])
def test_every_target_changes_and_stays_legal(spark, mode, num):
    df = source(spark) if mode == "num" else spelled(source(spark))
    before = {r.id: r for r in df.collect()}
    made = candidates.generate_candidates(df, TARGETS, LABELS, num, mode=mode).collect()
    assert len(made) == num == len({(r.id, r.draw_no) for r in made})
    for r in made:
        old = before[r.id]
        assert r.kept == old.kept
        for t in TARGETS:
            legal = LABELS[t] if mode == "num" else LABELS[t].values()
            assert r[t] != old[t] and r[t] in legal


def test_draws_do_not_depend_on_partitions_or_spreading(spark):
    df = source(spark)
    base = rows_of(candidates.generate_candidates(df, TARGETS, LABELS, 500, mode="num"))
    for other in (
        candidates.generate_candidates(df.repartition(11), TARGETS, LABELS, 500, mode="num"),
        candidates.generate_candidates(df, TARGETS, LABELS, 500, mode="num", spread=5),
    ):
        assert rows_of(other) == base
    other_seed = candidates.generate_candidates(df, TARGETS, LABELS, 500, mode="num", seed="7")
    assert rows_of(other_seed) != base


def test_numeric_and_text_mode_draw_alike(spark):
    num = candidates.generate_candidates(source(spark), TARGETS, LABELS, 90, mode="num")
    text = candidates.generate_candidates(spelled(source(spark)), TARGETS, LABELS, 90, mode="text")
    assert rows_of(spelled(num)) == rows_of(text)


def test_few_rows_become_many_candidates(spark):
    made = candidates.generate_candidates(source(spark, 3), TARGETS, LABELS, 25_000, mode="num", spread=8)
    per_row = {r.id: (r.n, r.top) for r in made.groupBy("id").agg(F.count("*").alias("n"), F.max("draw_no").alias("top")).collect()}
    assert sum(n for n, _ in per_row.values()) == 25_000
    assert all(n in (8333, 8334) and top == n - 1 for n, top in per_row.values())


def test_draws_are_even(spark):
    made = candidates.generate_candidates(source(spark, 1), TARGETS, LABELS, 20_000, mode="num")
    for t in ("five", "many"):
        counts = [r["count"] for r in made.groupBy(t).count().collect()]
        expected = 20_000 / (len(LABELS[t]) - 1)
        assert len(counts) == len(LABELS[t]) - 1
        assert max(abs(c - expected) for c in counts) < 6 * expected**0.5
    pairs = [r["count"] for r in made.groupBy("five", "many").count().collect()]
    assert len(pairs) == 100 and max(abs(c - 200) for c in pairs) < 6 * 200**0.5


def test_whole_number_columns_keep_their_type(spark):
    df = source(spark).select("id", F.col("five").cast("double").alias("five"))
    made = candidates.generate_candidates(df, ["five"], LABELS, 60, mode="num")
    assert dict(made.dtypes)["five"] == "double"
    assert {r.five for r in made.collect()} <= {1.0, 2.0, 3.0, 4.0, 5.0}


@pytest.mark.parametrize("bad", ["99", None])
def test_a_value_outside_the_domain_stops_the_job(spark, bad):
    df = source(spark).withColumn("five", F.when(F.col("id") == 7, F.lit(bad)).otherwise(F.col("five")))
    counts = {r.target: r.rows for r in domain_violations(df, TARGETS, LABELS, "num").collect()}
    assert counts == {"pair": 0, "five": 1, "many": 0}
    with pytest.raises(Exception, match="outside its domain"):
        candidates.generate_candidates(df, TARGETS, LABELS, 120, mode="num").collect()


def test_a_domain_of_one_is_refused(spark):
    with pytest.raises(ValueError, match="no alternative"):
        candidates.generate_candidates(source(spark), ["pair"], {"pair": {"1": "yes"}}, 5, mode="num")


def test_codes_that_share_a_label(spark):
    shared = {"five": {"1": "low", "2": "low", "3": "high"}}
    df = spark.createDataFrame([(1, "low")], "id bigint, five string")
    made = candidates.generate_candidates(df, ["five"], shared, 400)
    # "low" reads as its last code, so the other code behind it may be drawn
    assert {r.five for r in made.collect()} == {"low", "high"}


def test_many_targets_take_several_hashes():
    sizes = {f"t{i}": 26 for i in range(12)}
    groups = candidates.draw_groups(sizes)
    assert [t for g in groups for t in g] == list(sizes)
    assert len(groups) == 2 and all(25 ** len(g) <= candidates.CHOICES_PER_HASH for g in groups)


def test_every_hash_draws_all_choices(spark):
    sizes = {f"t{i}": 26 for i in range(12)}
    hashes, choices = candidates.draw_choices(sizes, ["id"], "s")
    assert len(hashes) == 2
    rows = spark.range(2000).withColumns(hashes).select(*[c.alias(t) for t, c in choices.items()]).collect()
    for target in sizes:
        drawn = [r[target] for r in rows]
        assert set(drawn) == set(range(25)) and max(drawn.count(v) for v in range(25)) < 130
    # targets of one hash, and of different hashes, agree no more often than chance
    for a, b in (("t0", "t1"), ("t0", "t11"), ("t5", "t10")):
        assert sum(r[a] == r[b] for r in rows) < 130
