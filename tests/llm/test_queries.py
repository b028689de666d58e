import re

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from oracle_check import compare, connect
from surveyloom.llm import queries


def test_one_query_per_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(queries.ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, connect(sf), sf, name) is None


RESULTS = {
    "op1_": "doc_id held_out lang_pred score",
    "op2_": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_": "doc_id item_id edits",
    "op6_": "doc_id lang score threshold kept",
    "op7_": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_": "doc_id n_shingles component_id kept",
    "op13_": "lang source part item value rank",
    "op12_": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op11_": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("prefix", sorted(RESULTS))
def test_result_columns(spark, sf, prefix):
    name = next(n for n in queries.QUERIES if n.startswith(prefix))
    assert set(RESULTS[prefix].split()) <= set(queries.QUERIES[name](spark, sf).columns)


def test_leaks_are_the_passages_that_texts_contain(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    plain = lambda text: " ".join(re.findall(r"\w+", (text or "").casefold()))
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {(d, i) for d, text in docs.items() for i, item in items.items() if f" {item} " in f" {text} "}
    found = queries.QUERIES["op5_edit_distance_leaks"](spark, folder).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in found}
    assert want == {(r["doc_id"], r["item_id"]) for r in found if r["edits"] == 0}


def test_pipeline_stages_against_plain_python(spark, sf):
    """Every stage over what the one before kept, held against its decision by other means."""
    from test_neardup import brute_force

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality", "near_duplicates", "decontamination", "packing",
    ]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
        assert all(tuple(r) == tuple(rows[r["doc_id"]]) for r in docs.collect())
    assert kept["language_id"] == {d for d, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    clean = {d for d, (good, toxic) in labels.items() if good and not toxic and d in kept["language_id"]}
    assert len(clean - kept["quality"]) <= 0.02 * len(clean)
    left = [(d, rows[d]["text"]) for d in kept["quality"]]
    assert kept["near_duplicates"] == {d for d, (_, lead) in brute_force(left, 5).items() if d == lead}
    assert kept["decontamination"] == {
        d for d in kept["near_duplicates"] if not any(i.casefold() in rows[d]["text"].casefold() for i in items)
    }
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == kept["decontamination"]


def test_pipeline_with_nulls_repeats_and_other_columns(spark, documents, tmp_path):
    text = "the cat sat on the mat while the dog lay on the rug near the old door"
    docs = documents([(1, text), (1, text), (2, None), (3, ""), (None, "some other words in a row here"), (5, "123")])
    docs = docs.selectExpr("*", "1 as row", "'x' as same", "2 as lead", "3 as block")
    for table, schema in {"labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1] and "lead" in docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 2
    none = documents([], "none")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
