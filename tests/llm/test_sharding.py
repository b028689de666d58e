import zlib
from collections import Counter

from surveyloom.llm.sharding import shard_documents


def shards_of(df, **settings):
    rows = shard_documents(df, **settings).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, Counter(r["shard"] for r in rows)


def test_sizes_checksums_and_even_counts(documents):
    texts = ["é", None, "", "abc"] + [f"text {i}" for i in range(97)]
    rows, sizes = shards_of(documents(list(enumerate(texts))), shards=10)
    assert len(rows) == 101 and max(sizes.values()) - min(sizes.values()) <= 1
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data)
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_equal_texts_come_together(documents):
    texts = [f"group {i // 5}" for i in range(200)] + [f"alone {i}" for i in range(200)]
    rows, sizes = shards_of(documents(list(enumerate(texts))), shards=8)
    assert set(sizes.values()) == {50}
    where = {}
    for r in rows:
        if r["doc_id"] < 200:
            where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(s) for s in where.values()) == len(where)  # no group is cut


def test_a_group_above_the_quota_fills_few_shards(documents):
    texts = ["copy"] * 130 + [f"alone {i}" for i in range(270)]
    rows, sizes = shards_of(documents(list(enumerate(texts))), shards=8)
    assert set(sizes.values()) == {50}
    held = Counter(r["shard"] for r in rows if r["doc_id"] < 130)
    assert len(held) <= 4 and sorted(held.values())[-2:] == [50, 50]


def test_a_group_of_a_third_of_all_rows_fills_the_fewest_shards(spark):
    rows = 99_990
    docs = spark.range(rows).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', if(id % 30 in (1, 2), concat('pair ', id div 30), concat('alone ', id))) as text")
    held = shard_documents(docs, shards=40)
    sizes = [r["count"] for r in held.groupBy("shard").count().collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 1 and sum(sizes) == rows
    hot = sorted((r["count"] for r in held.where("doc_id % 3 = 0").groupBy("shard").count().collect()), reverse=True)
    # a third of the rows needs 13.3 whole shards; pairs hold up to 7 percent of the room
    inside = sum(n * (n - 1) for n in hot) / (sum(hot) * (sum(hot) - 1))
    assert len(hot) <= 16 and inside > 0.06, (hot, inside)


def test_only_copies_and_null_texts(documents):
    rows, sizes = shards_of(documents([(1, "same")] * 30 + [(2, None)] * 11), shards=4)
    assert len(rows) == 41 and max(sizes.values()) - min(sizes.values()) <= 1
    assert {r["group_rows"] for r in rows if r["doc_id"] == 2} == {1}


def test_few_rows_and_none(documents):
    rows, sizes = shards_of(documents([(1, "a"), (None, "b")]), shards=40)
    assert len(rows) == 2 and set(sizes.values()) == {1}
    assert shards_of(documents([], "none"), shards=40)[0] == []


def test_only_functions_of_the_engine(documents):
    plan = shard_documents(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
