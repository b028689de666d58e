import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import kneser_ney as kn
from surveyloom.llm import quality
from surveyloom.llm.support import table

GOOD = ["the cat sat on the mat and the dog lay on the rug near the door", "a man and a woman walked along the river to the old mill"]
BAD = "X9#kQ!! ZZ$$ 7@@w %%pq ^^&& LL0"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture
def judged(spark, documents):
    docs = [(i, GOOD[i % 2] + f" number {i}") for i in range(80)] + [(100 + i, BAD * (1 + i % 3)) for i in range(9)]
    docs += [(200, None), (201, ""), (202, "t"), (203, GOOD[0], None), (204, GOOD[1], "fr"), (205, BAD, "fr")]
    labels = [(i, 1, 0) for i in range(60)] + [(100, 0, 0), (59, 0, 0), (999, 1, 0), (1, 1, None)]
    found = quality.judge(documents(docs), labels_of(spark, labels))
    return {r["doc_id"]: r for r in found.collect()}


def test_junk_goes_and_clean_text_stays(judged):
    assert len(judged) == 95
    assert all(judged[i]["kept"] for i in range(80))
    assert not any(judged[100 + i]["kept"] for i in range(9))


def test_short_null_and_foreign_texts(judged):
    assert all(judged[i]["kept"] for i in (200, 201, 202, 203, 204)) and not judged[205]["kept"]
    assert judged[203]["lang"] is None and judged[200]["n_bytes"] == 1


def test_nothing_trusted_keeps_all(spark, documents):
    docs = documents([(1, "a"), (2, BAD), (2, BAD)])
    found = quality.judge(docs, labels_of(spark, [(1, 0, 0), (2, 1, 1), (None, 1, 0)])).collect()
    assert len(found) == 3 and all(r["kept"] and r["threshold"] is None for r in found)
    assert quality.judge(documents([], "none"), labels_of(spark, [])).count() == 0


def test_filter_returns_rows_as_they_are(spark, documents):
    docs = documents([(i, GOOD[i % 2]) for i in range(30)] + [(50, BAD), (50, BAD)]).selectExpr("*", "1 as same", "2 as kept")
    docs.write.mode("overwrite").parquet(docs.inputFiles()[0].rsplit("/", 2)[0] + "/more")
    docs = spark.read.parquet(docs.inputFiles()[0].rsplit("/", 2)[0] + "/more")
    kept = quality.keep_fluent(docs, labels_of(spark, [(i, 1, 0) for i in range(30)]))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30))


def test_chances_add_up_and_follow_the_definition():
    data = b"abracadabra abracadabra"
    padded = b"\xff" * 4 + data + b"\xff"
    grams = np.array([int.from_bytes(padded[i : i + 5], "big") for i in range(len(data) + 1)])
    keys, counts = np.unique(grams, return_counts=True)
    local = kn.local_orders(keys, counts)
    orders = [*kn.top_orders(*local[0].shorter(1)), *local]
    taken = [kn.discounts(order.rarity()) for order in orders]
    for context in {int(g) >> 8 for g in grams} | {0x78787878}:
        chances = kn.log_chances(context << 8 | np.arange(256), orders, taken)
        assert np.exp(chances).sum() == pytest.approx(1)
    # the order without context counts the distinct bytes before each byte
    before = {b: {padded[i - 1] for i in range(4, len(padded)) if padded[i] == b} for b in set(data)}
    one = orders[0]
    assert {int(k): int(c) for k, c in zip(one.keys, one.counts) if k in before} == {b: len(s) for b, s in before.items()}
    # a seen gram by hand, at the longest order
    gram, longest = int.from_bytes(b"abrac", "big"), orders[-1]
    off = taken[-1][min(2, 3) - 1]
    rest = sum(d * kind[longest.contexts == gram >> 8][0] for d, kind in zip(taken[-1], longest.kinds))
    shorter = np.exp(kn.log_chances(np.array([gram]), orders[:-1], taken[:-1]))[0]
    total = longest.total[longest.contexts == gram >> 8][0]
    seen = longest.counts[longest.keys == gram][0]
    assert seen == 2
    assert np.exp(kn.log_chances(np.array([gram]), orders, taken))[0] == pytest.approx((seen - off + rest * shorter) / total)


def test_quantiles_by_language(spark):
    scores = [("a", i / 100) for i in range(1, 101)] + [("b", 5.0)]
    found = {r["lang"]: (r["threshold"], r["docs"]) for r in quality.quantiles(spark.createDataFrame(scores, "lang string, score double"), 0.9).collect()}
    assert found["a"][0] == pytest.approx(0.9, abs=2e-4) and found["b"][0] == pytest.approx(5.0, abs=2e-4)
    assert found["a"][1] == 100 and found[None][1] == 101


def test_trusted_documents_of_the_data_stay(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    labels = table(spark, folder, "labels")
    found = quality.judge(table(spark, folder, "documents"), labels).join(labels, "doc_id").where("toxic = 0")
    shares = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.3


def test_thresholds_lie_among_the_scores_of_trusted_documents(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    labels = table(spark, folder, "labels")
    found = quality.judge(table(spark, folder, "documents"), labels).join(labels.where("quality = 1 and toxic = 0"), "doc_id")
    dropped = found.agg(F.avg((~F.col("kept")).cast("int"))).first()[0]
    assert 0 < dropped < 0.02


def test_documents_that_do_not_come_straight_from_files(spark, documents):
    docs = documents([(i, GOOD[i % 2] + f" number {i}") for i in range(60)] + [(100 + i, BAD) for i in range(5)])
    labels = labels_of(spark, [(i, 1, 0) for i in range(30)])
    want = sorted(r["doc_id"] for r in quality.keep_fluent(docs, labels).collect())
    for other in (docs.repartition(4), docs.where("doc_id < 50").union(docs.where("doc_id >= 50"))):
        assert sorted(r["doc_id"] for r in quality.keep_fluent(other, labels).collect()) == want


def test_all_of_one_half_of_the_trusted_documents_is_learnt_from(spark, monkeypatch):
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    half = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).count()
    found = []

    def noted(marked):
        found.append(marked.where("learnt").count())
        return marked.select("doc_id", "lang", F.lit(b"").alias("same"), "learnt", F.lit(2).alias("n_bytes"), F.lit(1.0).alias("loss"))

    monkeypatch.setattr(quality, "byte_losses", noted)
    assert quality.judge(docs, labels).count() == 50_000
    monkeypatch.setattr(quality, "REJECTED_BYTES", 0)  # too many to be sent: joined
    assert quality.judge(docs, labels).count() == 50_000
    assert found == [half, half] and half > 20_000
