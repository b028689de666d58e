import json

import pytest
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.operators import labels


def cells(spark):
    rows = [
        (3, "t", "1", "late"), (1, "t", "1", "early"), (2, "t", "2", "other"), (9, "t", "3", "early"),
        (4, "t", ".i", "iap"), (5, "u", "7", "seven"), (6, "u", None, "nothing"),
    ]
    return spark.createDataFrame(rows, "id bigint, feature string, code string, label string")


def test_first_label_wins_and_last_new_code_wins(spark):
    forward = labels.label_map(cells(spark))
    got = {(r.feature, r.code): (r.label, r.first_id) for r in forward.collect()}
    assert got == {("t", "1"): ("early", 1), ("t", "2"): ("other", 2), ("t", "3"): ("early", 9), ("u", "7"): ("seven", 5)}
    reverse = {(r.feature, r.label): r.code for r in labels.reverse_label_map(forward).collect()}
    assert reverse == {("t", "early"): "3", ("t", "other"): "2", ("u", "seven"): "7"}
    as_dict = labels.labels_of(forward)
    assert as_dict == {"t": {"1": "early", "2": "other", "3": "early"}, "u": {"7": "seven"}}
    assert labels.reverse_of(as_dict)["t"] == {"early": "3", "other": "2"}


def test_missing_codes_on_request(spark):
    with_missing = labels.label_map(cells(spark), include_missing=True)
    assert with_missing.where("code = '.i'").count() == 1


def test_two_tables_side_by_side(spark):
    num = spark.createDataFrame([(1, "1", ".d"), (2, "2", "4")], "id bigint, a string, b string")
    text = spark.createDataFrame([(2, "two", "four"), (1, "one", "don't know")], "id bigint, a string, b string")
    got = sorted(tuple(r) for r in labels.code_label_join(num, text, ["a", "b"]).collect())
    assert got == [(1, "a", "1", "one"), (1, "b", ".d", "don't know"), (2, "a", "2", "two"), (2, "b", "4", "four")]


def test_dictionary(spark):
    rows = [("a", "first", 1), ("a", "second", 2), ("b", "only", 3)]
    df = spark.createDataFrame(rows, "name string, simplab string, line int")
    assert labels.dictionary_of(labels.variable_dictionary(df, "line")) == {"a": "second", "b": "only"}
    with pytest.raises(Exception, match="different labels"):
        labels.variable_dictionary(df).collect()
    same = df.withColumn("simplab", F.lit("x"))
    assert labels.dictionary_of(labels.variable_dictionary(same)) == {"a": "x", "b": "x"}


def test_json_round_trip(spark):
    frame = labels.label_frame(spark, fv.TARGET_LABELS)
    line = labels.code_map_text(frame).collect()[0].value
    assert json.loads(line) == fv.TARGET_LABELS
    back = labels.code_map_rows(labels.code_map_text(frame))
    assert back.exceptAll(frame).isEmpty() and back.count() == frame.count()


def test_task_metadata(spark):
    text = json.dumps({"a": {"task_type": "class", "num_labels": 2}, "b": {"task_type": "continuous", "num_labels": 1, "range": 26}})
    df = spark.createDataFrame([(text,)], "value string")
    assert sorted(tuple(r) for r in labels.task_rows(df).collect()) == [("a", "class", 2, None), ("b", "continuous", 1, 26)]


def test_sizes_of_the_fixed_maps():
    assert {t: len(m) for t, m in fv.TARGET_LABELS.items()} == {
        "income16": 26, "educ": 21, "letin1a": 5, "finrela": 5, "marhomo": 5,
    }


def test_encode_and_decode_are_inverse(spark):
    codes = [(i, c) for i, c in enumerate(fv.TARGET_LABELS["income16"])]
    df = spark.createDataFrame(codes, "id bigint, income16 string")
    there = labels.code_to_label(df, ["income16"], fv.TARGET_LABELS)
    back = labels.label_to_code(there, ["income16"], fv.TARGET_LABELS)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    encoded = labels.encode_targets(there, ["income16"], fv.TARGET_LABELS)
    assert sorted(r.income16_num for r in encoded.collect()) == list(range(1, 27))


def test_unknown_labels(spark):
    df = spark.createDataFrame([(1, "nowhere")], "id bigint, educ string")
    assert labels.label_to_code(df, ["educ"], fv.TARGET_LABELS).collect()[0].educ is None
    with pytest.raises(Exception, match="no entry for nowhere"):
        labels.encode_targets(df, ["educ"], fv.TARGET_LABELS).collect()


def test_encode_by_map(spark):
    from surveyloom.operators import labels

    entries = spark.createDataFrame(
        [("a", "yes", "1"), ("a", "no", "2"), ("b", "yes", "9")], "feature string, label string, code string"
    )
    rows = spark.createDataFrame(
        [(1, "yes", "yes", 0), (2, "no", "no", 0), (3, None, "yes", 0), (4, "maybe", None, 0)], "id int, a string, b string, c int"
    )
    for salts in (1, 16):
        found = labels.encode_by_map(rows, ["a", "b"], entries, ["id"], salts=salts)
        assert found.columns == ["id", "a", "b"]
        assert sorted(map(tuple, found.collect())) == [(1, "1", "9"), (2, "2", None), (3, None, "9"), (4, None, None)]
    back = labels.encode_by_map(found, ["a", "b"], entries, ["id"], key="code", value="label")
    assert sorted(map(tuple, back.collect())) == [(1, "yes", "yes"), (2, "no", None), (3, None, "yes"), (4, None, None)]
    assert labels.encode_by_map(rows.limit(0), ["a"], entries, ["id"]).count() == 0
