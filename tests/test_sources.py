from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.operators import labels
from surveyloom.sources import demo, readers, scratch, writers


def test_csv_cells_stay_text(spark, tmp_path):
    path = tmp_path / "num.csv"
    path.write_text('id,a,b\n1,16,.i\n2,,"$1,000 to $2,999"\n3,NA,"say ""x"""\n')
    for columns in (None, ["id", "a", "b"]):
        rows = sorted(tuple(r) for r in readers.read_survey_csv(spark, str(path), columns).collect())
        assert rows == [(1, "16", ".i"), (2, None, "$1,000 to $2,999"), (3, None, 'say "x"')]
    raw = readers.read_survey_csv(spark, str(path), empty_cells=["-"])
    assert {r.a for r in raw.collect()} == {"16", None, "NA"}


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("id,b,a\n1,bee,ay\n")
    assert [r.asDict() for r in readers.read_survey_csv(spark, str(path), ["id", "a", "b"]).collect()] == [
        {"id": 1, "a": "ay", "b": "bee"}
    ]
    with pytest.raises(Exception):
        readers.read_survey_csv(spark, str(path), ["id", "c"]).collect()
    path.write_text("id,b,a\n1,bee\n")
    with pytest.raises(Exception):
        readers.read_survey_csv(spark, str(path)).collect()
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "1.csv").write_text("id,a,b\n1,x,y\n")
    (tmp_path / "two" / "2.csv").write_text("id,b,a\n2,x,y\n")
    with pytest.raises(Exception):
        readers.read_survey_csv(spark, str(tmp_path / "two")).collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", cell', None), (2, "don't", ".n")], "id bigint, x string, y string")
    writers.write_csv(df, str(tmp_path / "t"))
    back = readers.read_survey_csv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_runs_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.range(3)
    writers.write_run(df, path, writers.run_name(50, 0), "train")
    writers.write_run(df, path, writers.run_name(50, 1), "train")
    writers.write_run(df.limit(1), path, "f50-0", "train")
    counts = {r.run_id: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()}
    assert counts == {"f50-0": 1, "f50-1": 3}
    assert readers.read_candidates(spark, path, "f50-1").count() == 3
    writers.write_run(df.limit(0), path, "f50-1", "train")
    assert readers.read_candidates(spark, path, "f50-1").count() == 0  # no rows replace rows


def test_splits(spark, tmp_path):
    path = str(tmp_path / "splits")
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train"))
    writers.write_table(df, path, ["split"])
    parts = readers.read_splits(spark, path)
    assert {k: v.count() for k, v in parts.items()} == {"train": 7, "validate": 3, "test": 3}
    plan = parts["train"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_code_map_file(spark, tmp_path):
    path = str(tmp_path / "map")
    frame = labels.label_frame(spark, fv.TARGET_LABELS)
    writers.write_code_map(frame, path)
    back = readers.read_code_map(spark, path)
    assert back.count() == 62 and back.exceptAll(frame).isEmpty()


@pytest.mark.parametrize("parts", [None, 1, 4])
def test_code_map_lines(spark, tmp_path, parts):
    path = str(tmp_path / "lines")
    frame = labels.label_frame(spark, fv.TARGET_LABELS)
    odd = spark.createDataFrame([("q", None, "x"), ("q", "1", None), ('a "b"', "1", "line\nbreak, é")], frame.schema)
    writers.write_code_map_lines(frame.union(odd), path, parts)
    back = readers.read_code_map_lines(spark, path)
    whole = frame.union(odd.where("code is not null and label is not null"))
    assert back.exceptAll(whole).isEmpty() and whole.exceptAll(back).isEmpty()
    features = [line[0] for line in spark.read.text(path).collect()]
    assert len(features) == len(fv.TARGET_LABELS) + 1


def test_code_map_lines_empty(spark, tmp_path):
    writers.write_code_map_lines(labels.label_frame(spark, fv.TARGET_LABELS).limit(0), str(tmp_path / "none"))
    assert readers.read_code_map_lines(spark, str(tmp_path / "none")).isEmpty()


def test_dictionary_and_tasks(spark, tmp_path):
    (tmp_path / "d.csv").write_text("name,other,simplab\nage,1,age of one\n")
    assert [tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "d.csv")).collect()] == [("age", "age of one")]
    (tmp_path / "t.json").write_text('{"age": {\n "task_type": "continuous",\n "num_labels": 1}}')
    assert readers.read_tasks(spark, str(tmp_path / "t.json")).collect()[0].task_type == "continuous"


def test_ledger_grows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i in range(3):
        writers.append_rows(spark.range(1).withColumn("i", F.lit(i)), path)
    assert sorted(r.i for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_scratch_lies_in_the_shared_folder(spark):
    folder = scratch.shared_folder(spark)
    assert folder == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    table = scratch.materialise(spark.range(5), "t")
    assert table.count() == 5 and folder in table.inputFiles()[0]
    assert scratch.scratch_path(spark, "t") != scratch.scratch_path(spark, "t")


def test_scratch_falls_back_to_the_warehouse():
    class Session:
        def __init__(self, settings, checkpoint=None):
            self.conf = SimpleNamespace(get=lambda name, default=None: settings.get(name, default))
            self.sparkContext = SimpleNamespace(getCheckpointDir=lambda: checkpoint)

    warehouse = {"spark.sql.warehouse.dir": "hdfs://n/wh/"}
    assert scratch.shared_folder(Session(warehouse)) == "hdfs://n/wh/checkpoints"
    assert scratch.shared_folder(Session(warehouse, "hdfs://n/own")) == "hdfs://n/own"
    assert scratch.shared_folder(Session({**warehouse, "spark.checkpoint.dir": "hdfs://n/set/"})) == "hdfs://n/set"


def test_survey_dealt_out_is_the_same_survey(spark, sf):
    plain = demo.survey_num(spark, sf)
    spark.conf.set(demo.PARTS_CONF, "5")
    try:
        dealt = demo.survey_num(spark, sf)
    finally:
        spark.conf.unset(demo.PARTS_CONF)
    assert dealt.rdd.getNumPartitions() == 5
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()


def test_the_survey_is_dealt_out_unasked(spark, sf, capsys):
    demo.survey_num(spark, sf).explain()
    assert "hashpartitioning(o_orderkey" in capsys.readouterr().out  # one row group would be one task up to the end
