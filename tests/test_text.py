import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.functions import arrays, text
from surveyloom.operators import tokens


def one(df, column):
    return df.select(column.alias("x")).collect()[0].x


def test_sentences(spark):
    df = spark.createDataFrame(
        [(1, "0.5", "iap", "3", None, "hidden", "iap", "agree")],
        "id bigint, wt string, a string, b string, c string, d string, goal string, view string",
    )
    names = {"id": "key", "a": "first", "b": "second", "c": "third", "goal": "aim", "view": "view"}
    row = tokens.with_text(df, ["goal", "view"], names).collect()[0]
    assert row.text == (
        "One's data in 2022 GSS data: second is 3. third is nan.  So one's aim is iap. view is agree. "
    )
    skipping = text.compile_prompt(df.columns, names, ["id", "goal", "view"], "P: ", skip_absent=True)
    assert one(df, skipping) == "P: second is 3. "


def test_numeric_cells_in_a_sentence(spark):
    df = spark.createDataFrame([(4, 2.5)], "a int, b double")
    sentence = text.compile_prompt(["a", "b"], {"a": "x", "b": "y"}, [], "")
    assert one(df, sentence) == "x is 4. y is 2.5. "


def test_only_described_columns(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    assert one(df, text.compile_prompt(["a", "b"], {}, [], "P")) == "P"
    assert one(df, text.compile_suffix(["b", "a"], {"a": "x"}, "S ")) == "S x is 1. "


@pytest.mark.parametrize("given", ["", None])
def test_template_without_input(spark, given):
    df = spark.createDataFrame([("do {x}", given, None)], "i string, t string, l string")
    filled = text.fill_template("W {instruction}|{input}!", "N {{{instruction}}}!", F.col("i"), F.col("t"), F.col("l"))
    assert one(df, filled) == "N {do {x}}!"


def test_template_with_input_and_label(spark):
    df = spark.createDataFrame([("do", "this", "done")], "i string, t string, l string")
    filled = text.fill_template("W {instruction}|{input}!", "N", F.col("i"), F.col("t"), F.col("l"))
    assert one(df, filled) == "W do|this!done"


@pytest.mark.parametrize(
    "output,expected",
    [("a##  b \n", "b"), ("a##b##c", "b"), ("none here", None), ("##", ""), (None, None),
     ("x##  y z　\x1f", "y z"), ("a##b.*##", "b.*")],
)
def test_response(spark, output, expected):
    df = spark.createDataFrame([(output,)], "o string")
    assert one(df, text.extract_response(F.col("o"), "##")) == expected
    if output is not None and "##" in output:
        assert expected == output.split("##")[1].strip()


@pytest.mark.parametrize(
    "words,expected",
    [([], ["E"]), (["a"], ["a", "E"]), (["a", "E"], ["a", "E"]), (["a", "b", "c"], ["a", "b", "c"]),
     (["a", "b", "c", "d"], ["a", "b", "c"]), (["E", "a"], ["E", "a", "E"])],
)
def test_token_list_boundaries(spark, words, expected):
    df = spark.createDataFrame([(" ".join(words) + "\n\t ", 1.7)], "t string, y double")
    row = tokens.token_arrays(df, "t", "E", "y", cutoff=3).collect()[0]
    assert row.input_ids == expected and row.attention_mask == [1] * len(expected) and row.labels == 1
    assert "labels" not in tokens.token_arrays(df, "t", "E", cutoff=3).columns
    assert tokens.token_arrays(df, "t", "E", "y", "continuous", cutoff=3).collect()[0].labels == 1.7


def test_json_records(spark):
    df = spark.createDataFrame([("[3, -9, 12]", "2")], "t string, y string")
    row = tokens.numeric_arrays(df, "t", "y").collect()[0]
    assert row.input_ids == [3, -9, 12] and row.attention_mask == [1, 1, 1] and row.labels == 2
    df = spark.createDataFrame([(1.5, 2.0)], "a double, b double")
    assert one(df, text.row_to_json(["a", "b"])) == "[1.5,2.0]"


def test_loss_mask(spark):
    df = spark.createDataFrame([("p q r", "a b")], "p string, a string")
    row = tokens.supervised_records(df, "p", "a", "E", cutoff=2).collect()[0]
    assert row.input_ids == ["p", "q", "a", "b", "E"]
    assert row.labels == ["-100", "-100", "a", "b", "E"] and row.attention_mask == [1] * 5
    row = tokens.supervised_records(df, "p", "a", "E", add_end=False, train_on_inputs=True).collect()[0]
    assert row.labels == row.input_ids == ["p", "q", "r", "a", "b"]


def test_batches_are_padded_to_their_longest_member(spark):
    df = spark.range(0, 50, 1, 4).withColumn("ids", F.array_repeat(F.lit(7), (F.col("id") % 9).cast("int")))
    rows = tokens.pad_batches(df, "ids", ["id"], 8, "s", padding=0).collect()
    batches = {}
    for r in rows:
        own = r.id % 9
        assert r.ids == [0] * (len(r.ids) - own) + [7] * own
        assert r.attention_mask == [0] * (len(r.ids) - own) + [1] * own
        batches.setdefault(r.batch_no, []).append((own, len(r.ids)))
    assert sorted(len(b) for b in batches.values()) == [2] + [8] * 6
    assert all(length == max(o for o, _ in b) for b in batches.values() for _, length in b)


@pytest.mark.parametrize("values", [[1, 5, 5, 9, 41, 40, 17], [6, 6, 6], list(range(200)), [0, 1]])
def test_histogram_is_that_of_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    rows = tokens.length_histogram(df, F.col("v")).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=40)
    assert [r.n for r in rows] == list(counts)
    assert np.allclose([r.bin_start for r in rows] + [rows[-1].bin_end], edges)


def test_scores(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],), ([3.0],)], "s array<double>")
    got = df.select(arrays.argmax(F.col("s")).alias("a"), arrays.squeezed(F.col("s")).alias("q")).collect()
    assert [r.a for r in got] == [1, 0] and got[1].q == 3.0


def test_prefixes_are_the_fixed_ones():
    assert fv.PROMPT_PREFIX.endswith(": ") and fv.SUFFIX_PREFIX == " So one's "
