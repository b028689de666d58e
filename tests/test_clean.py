from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.functions import cells
from surveyloom.operators import clean
from surveyloom.sources import demo

CODES = [fv.INAPPLICABLE_CODE, *fv.MISSING_CODES]


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, goal string, item string")


def edge_rows():
    rows = [(i, code, "1") for i, code in enumerate(CODES)]
    rows += [(100 + i, "2", code) for i, code in enumerate(CODES)]
    rows += [(200, None, "1"), (201, "3", None), (202, "odd", "1"), (203, "4", "odd"), (204, "5", "7.5")]
    return rows


def test_missing_values_by_place(spark):
    got = {r.id: (r.goal, r.item) for r in clean.prepare(table(spark, edge_rows()), ["goal"]).collect()}
    expected = {100 + i: (2.0, -9.0) for i in range(len(CODES))}
    expected |= {201: (3.0, -9.0), 202: (-9.0, 1.0), 203: (4.0, -9.0), 204: (5.0, 7.5)}
    assert got == expected


def test_prepare_equals_its_single_steps(spark, sf):
    for df, targets in [(table(spark, edge_rows()), ["goal"]), (demo.survey_num(spark, sf), demo.TARGETS)]:
        one, steps = clean.prepare(df, targets), clean.prepare_numeric(df, targets)
        assert one.columns == steps.columns
        assert one.exceptAll(steps).isEmpty() and steps.exceptAll(one).isEmpty()
        assert not one.isEmpty()


def test_null_passes_the_inapplicable_filter(spark):
    df = table(spark, [(1, ".i", "1"), (2, None, "1"), (3, "4", "1")])
    assert sorted(r.id for r in clean.filter_applicable(df, ["goal"]).collect()) == [2, 3]
    assert [r.id for r in clean.drop_missing(df, ["goal"]).collect() if r.id == 2] == []


def test_profiles(spark):
    df = table(spark, edge_rows())
    counts = {r.code: r.cells for r in clean.missing_code_counts(df).collect()}
    assert counts == {".i": 2, ".n": 2, ".d": 2}
    nulls = {r.variable: r.nulls for r in clean.null_profile(df).collect()}
    assert nulls == {"id": 0, "goal": 1, "item": 1}
    odd = {r.variable: r.cells for r in clean.unparseable_counts(df).collect()}
    assert odd == {"id": 0, "goal": 1, "item": 1}


def test_absent_columns_are_reported(spark):
    df = table(spark, [(1, "1", "1")])
    for call in (clean.project_columns, clean.drop_columns, clean.drop_missing):
        try:
            call(df, ["nowhere"])
        except ValueError as error:
            assert "nowhere" in str(error)
        else:
            raise AssertionError("absent column passed")


def test_stop_list():
    from surveyloom.config import SurveyConfig

    stop = SurveyConfig().excluded_features()
    assert stop == ["id", "wtssnrps", "wtssps", "wtssnrps_next", "wtssps_next", "income", "coninc", "realinc", "degree"]


def test_remap_and_codes(spark):
    df = spark.createDataFrame([(v,) for v in [2, 1, 0, -1, -2, -9, 5, None]], "v int")
    got = [r.m for r in df.select(cells.remap(F.col("v"), fv.RELEVANCE_MAP).alias("m")).collect()]
    assert got == [1, 1, 1, 1, 1, 0, 5, None]
    df = spark.createDataFrame([("16",), ("-9",), (".i",), ("x",), (None,)], "v string")
    assert [r.c for r in df.select(cells.is_code(F.col("v")).alias("c")).collect()] == [True, True, False, False, False]


def test_filters_and_columns_reach_a_stored_table(spark, sf, tmp_path):
    path = str(tmp_path / "num")
    demo.survey_num(spark, sf).write.parquet(path)
    narrow = clean.prepare(spark.read.parquet(path), demo.TARGETS).select("id", "prio", "nation")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan or "PushedFilters: [Not(In" in plan
    assert "balbin" not in plan.split("ReadSchema")[1]
    assert "Exchange" not in plan


def test_columns_that_hold_numbers_already(spark):
    df = spark.createDataFrame([(1, 3, 2.5), (2, None, 1.0), (3, 4, None)], "id bigint, goal int, item double")
    for make in (clean.prepare, clean.prepare_numeric):
        got = sorted(tuple(r) for r in make(df, ["goal"]).collect())
        assert got == [(1, 3.0, 2.5), (3, 4.0, -9.0)]
