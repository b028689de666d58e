import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import blockjoin, ctw, lmscore
from surveyloom.llm.wordhash import column_bytes


def by_definition(train, grams, depth):
    """ln P(next byte | context) by the recursion itself, with ratios of whole-tree weights."""
    def weight(counts, node, context):
        own = counts.get((context, node))
        if own is None:
            return 0.0
        kt = math.lgamma(own[0] + 0.5) + math.lgamma(own[1] + 0.5) - math.lgamma(sum(own) + 1) - math.log(math.pi)
        if len(context) == depth:
            return kt
        below = sum(weight(counts, node, c) for c, n in counts if n == node and len(c) == len(context) + 1 and c[1:] == context)
        return np.logaddexp(kt, below) - math.log(2)

    def add(counts, context, byte, level):
        node, bit = 1 << level | byte >> (8 - level), byte >> (7 - level) & 1
        for d in range(depth + 1):
            counts.setdefault((context[depth - d :], node), [0, 0])[bit] += 1

    counts = {}
    for context, byte in train:
        for level in range(8):
            add(counts, context, byte, level)
    out = []
    for context, byte in grams:
        total = 0.0
        for level in range(8):
            node = 1 << level | byte >> (8 - level)
            more = {k: list(v) for k, v in counts.items()}
            add(more, context, byte, level)
            total += weight(more, node, b"") - weight(counts, node, b"")
        out.append(total)
    return out


def pairs(text, depth):
    padded = b"\xff" * depth + text + b"\xff"
    return [(padded[i : i + depth], padded[i + depth]) for i in range(len(text) + 1)]


def test_chances_are_those_of_the_tree():
    depth, train, asked = 3, b"abracadabra", b"abrxa"
    known = pairs(train, depth)
    code = lambda c, b: int.from_bytes(c, "big") << 8 | b
    counts = Counter(code(c, b) for c, b in known)
    grams = np.array(sorted(counts))
    levels = ctw.local_levels(grams, np.array([counts[g] for g in grams.tolist()]), depth)
    levels = [*ctw.top_levels(*levels[0].parents(1)), *levels]
    wanted = pairs(asked, depth)
    found = ctw.log_chances(np.array([code(c, b) for c, b in wanted]), levels)
    assert found == pytest.approx(by_definition(known, wanted, depth), abs=1e-9)
    everything = ctw.log_chances(np.array([code(b"bra", b) for b in range(256)]), levels)
    assert np.exp(everything).sum() == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 7.9, 8, 40.5, 1e6])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def test_grams_know_where_a_text_begins():
    texts = [b"", b"ab", b"abcdefg", b"z"]
    grams, count = ctw.text_grams(*column_bytes(pa.array(texts, pa.binary())), 3)
    want = [int.from_bytes(c, "big") << 8 | b for t in texts for c, b in pairs(t, 3)]
    assert grams.tolist() == want and count.tolist() == [len(t) + 1 for t in texts]


TEXTS = ["The cat sat on the mat. " * 5, "the dog\tSAT \n on the log " * 4, "", None, "cat", "é ü", "zzz qqq xxx"] * 6


@pytest.fixture
def scored(documents):
    docs = documents(list(enumerate(TEXTS)))
    return {r["doc_id"]: r for r in lmscore.score_documents(docs).collect()}


def test_base_score_and_counts(scored):
    words = {i: [*(t or "").encode().lower().split(), "end"] for i, t in enumerate(TEXTS)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    assert len(scored) == len(TEXTS)
    for i, r in scored.items():
        assert r["held_out"] == held[i] and r["n_tokens"] == len(words[i]) and r["train_tokens"] == n
        assert r["n_known"] == sum(count[w] > 0 for w in words[i])
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[i]))


def test_scores_are_log_chances_of_whole_texts(scored):
    assert all(r["score"] < 0 for r in scored.values())
    by_text = {}
    for i, r in scored.items():
        by_text.setdefault(TEXTS[i] or "", set()).add(round(r["score"], 9))
    assert all(len(s) == 1 for s in by_text.values())  # equal texts, null and empty ones
    assert min(by_text["zzz qqq xxx"]) > -11 * 8 * math.log10(2) * 2
    r = next(r for i, r in scored.items() if TEXTS[i] == "cat")
    assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / 4)


def test_empty_table_and_nothing_learnt(documents):
    assert lmscore.score_documents(documents([], "none")).count() == 0
    docs = documents([(1, "abc")], "one").selectExpr("doc_id", "text", "false as learnt", "1 as _block", "2 as bytes")
    row = lmscore.score_texts(docs).first()
    assert row["score"] == pytest.approx(4 * 8 * math.log10(0.5)) and row["n_known"] == 0


def test_repeated_rows_and_a_text_of_several_slices(documents):
    long = "lorem ipsum dolor " * 100_000
    rows = lmscore.score_documents(documents([(1, long), (1, long), (None, "lorem")])).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert {r["n_tokens"] for r in rows} == {300_001, 2}


def test_documents_that_do_not_come_straight_from_files(documents, spark):
    docs = documents(list(enumerate(TEXTS)))
    halves = docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 2 = 1"))
    joined = docs.select("doc_id", "text").join(docs.select("doc_id", "lang").hint("merge"), "doc_id")
    local = spark.createDataFrame(docs.collect(), docs.schema)
    named = docs.withColumn("_metadata", F.lit("x"))
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = lambda df: sorted(
        tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in lmscore.score_documents(df).select(columns).collect()
    )
    want = rows(docs)
    for other in (docs.repartition(4), halves, joined, docs.orderBy("text"), docs.distinct(), local, named):
        assert rows(other) == want


def test_parts_grow_with_the_buckets(spark):
    rows = spark.range(100).withColumnRenamed("id", "bucket")
    assert blockjoin.dealt(rows, 4000, "bucket").rdd.getNumPartitions() == 1000


def test_answers_are_found_by_hash():
    from surveyloom.llm.blockjoin import Answers, pack, pack_sorted

    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 48, 20_000))
    halves = [(grams[:12_000], np.arange(12_000.0)), (grams[10_000:], np.arange(10_000.0, len(grams)))]  # some come twice
    found = Answers([(pack_sorted(g), pack(v)) for g, v in halves])
    at = rng.integers(0, len(grams), 50_000)
    assert (found(grams[at]) == at).all() and len(found(grams[:0])) == 0
    assert Answers([(pack_sorted(grams[:1]), pack(np.array([7.0])))])(grams[[0, 0]]).tolist() == [7.0, 7.0]
    assert len(found.begins) >= 2 * len(found.grams)
