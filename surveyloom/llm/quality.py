"""Quality by perplexity: a modified Kneser-Ney byte model of trusted text.

The documents labelled good and not toxic are parted by a hash of their ids: the model
learns from all of one half, the thresholds come from all of the other. Counts are kept in shards, by the
newest two context bytes; every block of documents asks the shards for its distinct
grams (see blockjoin), and adds up what each of its documents needs.

A document's score is its mean negative log-likelihood per byte, as if PRIOR_BYTES
bytes of ordinary text of its language stood beside it, so that a text of a few bytes
is not judged by them alone. The threshold of a language is the `quantile` of the scores
of all its trusted documents that the model has not seen, so about 1 - quantile of them
are lost. It is averaged with that of all languages, which counts like PRIOR_DOCS
documents, so that a language with few trusted documents is not held to the largest of a
handful of scores. Fewer than 1 / (1 - quantile) scores in all have no such quantile:
their largest is raised by up to FEW_SLACK nats per byte, the less the more they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm import kneser_ney as kn
from surveyloom.llm.blockjoin import (
    ANSWER, answer_batches, block_rows, bucket_count, bucket_rows, on_files, request_rows, slices, whole_bucket,
)
from surveyloom.llm.ctw import text_grams
from surveyloom.llm.support import text_bytes
from surveyloom.llm.wordhash import column_bytes
from surveyloom.sources.scratch import materialise

GRAMS = 0
PRIOR_BYTES = 64
PRIOR_DOCS = 500
FEW_SLACK = 0.2
REJECTED_BYTES = 32 << 20
ID_BYTES = 16  # of a document that is learnt from, as it is sent to the tasks
BINS = 10_000  # per nat; scores lie between 0 and a few tens


def _grams(data: np.ndarray, offsets: np.ndarray):
    """(first row, grams, grams per row), about a megabyte at a time"""
    for lo, hi in slices(offsets):
        yield lo, *text_grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], kn.DEPTH)


def _extract(batch):
    data, offsets = column_bytes(batch.column("bytes"))
    learnt = batch.column("learnt").to_numpy(zero_copy_only=False)
    for lo, grams, count in _grams(data, offsets):
        known = np.repeat(learnt[lo : lo + len(count)], count)
        asked = np.unique(grams[~known])
        yield GRAMS, asked, np.zeros(len(asked), np.int64)
        yield GRAMS, *np.unique(grams[known], return_counts=True)


def _route(kind: int, grams: np.ndarray) -> np.ndarray:
    return grams >> 8 & 0xFFFF


def _survey(requests: DataFrame, buckets: int):
    """Orders of no and one context byte, and the discounts of all orders."""

    def work(kind, rows):
        grams, counts, _ = whole_bucket(rows)
        orders = kn.local_orders(grams, counts)
        keys, longer = orders[0].shorter(1)
        rarity = np.concatenate([order.rarity() for order in orders])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([keys, -1 - np.arange(len(rarity))]), pa.int64()),
             pa.array(np.concatenate([longer.astype(float), rarity]))],
            names=["key", "n"],
        )

    found = bucket_rows(requests, buckets, work, "key bigint, n double").groupBy("key").agg(F.sum("n").alias("n"))
    table = found.orderBy("key").toArrow()  # one line per pair of bytes, and 4 per order
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    local = kn.DEPTH - kn.LOCAL + 1
    rarity = np.zeros(4 * local)
    rarity[-1 - key[key < 0]] = n[key < 0]
    top = kn.top_orders(key[key >= 0], n[key >= 0])
    return top, [kn.discounts(r) for r in (*(o.rarity() for o in top), *rarity.reshape(local, 4))]


def text_digest() -> Column:
    """Tells apart what a decision may depend on, language and text."""
    return F.unhex(F.md5(F.concat(F.coalesce("lang", F.lit("")), F.lit("\0"), F.coalesce("text", F.lit("")))))


def byte_losses(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, same, learnt, n_bytes, loss) for every row (doc_id, lang, text, learnt).

    loss is the negative log-likelihood of text and end symbol, n_bytes counts both.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "lang", "_block", "learnt", text_bytes(F.col("text")).alias("bytes"), text_digest().alias("same"))
    buckets = bucket_count(docs, "text")
    requests = materialise(request_rows(rows, _extract, _route, buckets), "requests")
    model = docs.sparkSession.sparkContext.broadcast(_survey(requests, buckets))

    def answer(kind_, bucket):
        grams, counts, at = whole_bucket(bucket)
        top, taken = model.value
        yield from answer_batches(kind_, bucket, kn.log_chances(grams, [*top, *kn.local_orders(grams, counts)], taken), at)

    def score(batch, found):
        data, offsets = column_bytes(batch.column("bytes"))
        loss = np.zeros(batch.num_rows)
        for lo, grams, count in _grams(data, offsets):
            loss[lo : lo + len(count)] = -np.add.reduceat(found[GRAMS](grams), np.cumsum(count) - count)
        kept = [batch.column(c) for c in ("doc_id", "lang", "same", "learnt")]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(np.diff(offsets) + 1), pa.array(loss)],
            names=["doc_id", "lang", "same", "learnt", "n_bytes", "loss"],
        )

    return block_rows(
        rows, bucket_rows(requests, buckets, answer, ANSWER), buckets, score,
        f"doc_id {kind}, lang string, same binary, learnt boolean, n_bytes bigint, loss double",
    )


def quantiles(scores: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold, docs): the upper end of the bin that holds the quantile; null lang for all languages.

    Scores are counted in bins of 1 / BINS, so a language has a bounded number of
    lines and the result does not depend on how rows are dealt.
    """
    bins = scores.groupBy("lang", F.floor(F.col("score") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    each = Window.partitionBy("lang")
    reached = bins.withColumns({"upto": F.sum("n").over(each.orderBy("bin")), "all": F.sum("n").over(each)})
    return reached.where(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(
        ((F.min("bin") + 1) / BINS).alias("threshold"), F.max("all").alias("docs")
    )


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """(doc_id, lang, same, n_bytes, score, threshold, kept) for every row of docs (doc_id, lang, text).

    * Null lang: a language of its own. A language without trusted documents is held
      against the threshold of all languages. Without any trusted document all are kept.
    * Null and empty texts have no bytes but their end, which is no evidence: kept.
    * An id with several labels is trusted if none speaks against it. Repeated rows are
      judged alike. Empty tables give empty results; other columns are ignored.
    """
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    trusted = materialise(
        labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
        .where("good").select("doc_id"),
        "trusted",
    )
    # the other half is left for the thresholds, which must come from texts that the model has not seen
    learners = trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).withColumn("picked", F.lit(True))
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    if ID_BYTES * learners.count() <= REJECTED_BYTES:
        marked = on_files(plain).join(F.broadcast(learners), "doc_id", "left")
    else:  # shuffled, so written once more, for blocks to lie together
        marked = on_files(materialise(plain.join(learners, "doc_id", "left"), "marked"))
    marked = marked.withColumn("learnt", F.coalesce("picked", F.lit(False))).drop("picked")
    losses = materialise(byte_losses(marked), "losses")

    unseen = losses.where("not learnt").join(trusted, "doc_id")
    usual = unseen.groupBy("lang").agg((F.sum("loss") / F.sum("n_bytes")).alias("usual"))
    overall = unseen.agg(F.sum("loss") / F.sum("n_bytes")).first()[0] or 0.0

    def scored(rows):  # joined with a line per language
        prior = F.coalesce("usual", F.lit(overall)) * PRIOR_BYTES
        return rows.join(F.broadcast(usual), "lang", "left").withColumn(
            "score", (F.col("loss") + prior) / (F.col("n_bytes") + PRIOR_BYTES)
        )

    limits = materialise(quantiles(scored(unseen).select("lang", "score"), quantile), "limits")
    anyone, seen = limits.where("lang is null").agg(F.max("threshold"), F.max("docs")).first()
    few = FEW_SLACK * max(0.0, 1 - (seen or 0) * (1 - quantile))
    common = F.lit(None if anyone is None else anyone + few).cast("double")
    own = F.col("threshold")
    share = F.coalesce("docs", F.lit(0)) / (F.coalesce("docs", F.lit(0)) + PRIOR_DOCS)
    judged = scored(losses).join(F.broadcast(limits.where("lang is not null")), "lang", "left")
    threshold = F.coalesce(share * own + (1 - share) * common, common)
    return judged.select(
        "doc_id", F.nullif("lang", F.lit("")).alias("lang"), "same", "n_bytes", "score", threshold.alias("threshold"),
        (threshold.isNull() | (F.col("score") <= threshold)).alias("kept"),
    )


def keep_fluent(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of `docs`, all columns, that `judge` keeps.

    What is rejected goes to the tasks as 16-byte digests of language and text as long
    as these are few; beyond REJECTED_BYTES rows and digests are shuffled.
    """
    rejected = materialise(judge(docs, labels, **settings).where("not kept").select("same").distinct(), "rejected")
    if 16 * rejected.count() <= REJECTED_BYTES:
        rejected = F.broadcast(rejected)
    rows = docs.select(F.struct("*").alias("row"), text_digest().alias("_same"))
    return rows.join(rejected, F.col("_same") == F.col("same"), "left_anti").select("row.*")
