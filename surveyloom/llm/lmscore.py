"""Code length of texts under a context-tree weighting model of the training texts.

Texts are read as their UTF-8 bytes with A-Z lower-cased, closed by an end symbol. The
model's counts come from all training texts; scoring leaves them as they are, so equal
texts get equal scores. Beside it stands a word unigram with add-one smoothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import ctw
from surveyloom.llm.blockjoin import (
    ANSWER, answer_batches, block_rows, bucket_count, bucket_rows, counted, on_files, request_rows, slices, whole_bucket,
)
from surveyloom.llm.support import id_remainder, text_bytes
from surveyloom.llm.wordhash import WordHasher, column_bytes
from surveyloom.sources.scratch import materialise

BYTES, WORDS = 0, 1
END_WORD = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _word_ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(1)).astype(np.int64) | 1  # END_WORD is none of them


def _byte_slices(data: np.ndarray, offsets: np.ndarray, depth: int):
    """(first row, grams, grams per row) of lower-cased texts, about a megabyte at a time."""
    for lo, hi in slices(offsets):
        piece = LOWER[data[offsets[lo] : offsets[hi]]]
        yield lo, *ctw.text_grams(piece, offsets[lo : hi + 1] - offsets[lo], depth)


def _distinct(grams: np.ndarray, learnt: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams with their counts in learnt texts; those of other texts count 0."""
    known, count = np.unique(grams[learnt], return_counts=True)
    asked = np.unique(grams[~learnt])
    return [(known, count.astype(np.int64)), (asked, np.zeros(len(asked), np.int64))]


def _extractor(depth: int):
    def extract(batch):
        data, offsets = column_bytes(batch.column("bytes"))
        learnt = batch.column("learnt").to_numpy(zero_copy_only=False)
        for lo, grams, count in _byte_slices(data, offsets, depth):
            yield BYTES, *counted(_distinct(grams, np.repeat(learnt[lo : lo + len(count)], count)))
        for lo, hashes, count in WordHasher().per_text(data, offsets):
            yield WORDS, *counted(_distinct(_word_ids(hashes), np.repeat(learnt[lo : lo + len(count)], count)))
        yield WORDS, np.array([END_WORD]), np.array([int(learnt.sum())])

    return extract


def _route(kind: int, grams: np.ndarray) -> np.ndarray:
    return grams >> 8 & 0xFFFF if kind == BYTES else grams


def _survey(requests: DataFrame, buckets: int, depth: int):
    """The two topmost levels of the tree, number of training tokens and of distinct ones."""

    def work(kind, rows):
        grams, counts, _ = whole_bucket(rows)
        if kind == BYTES:
            keys, zeros, ones, children = ctw.local_levels(grams, counts, depth)[0].parents(1)
        else:
            keys, zeros, ones, children = [-1], [float(counts.sum())], [float((counts > 0).sum())], [0.0]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, pa.float64()) for c in (zeros, ones, children))],
                                         names=["key", "zeros", "ones", "children"])

    found = bucket_rows(requests, buckets, work, "key bigint, zeros double, ones double, children double")
    summed = found.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "children")))
    table = summed.orderBy("key").toArrow()  # a line per visited node of one context byte: 65,280 at most
    key, zeros, ones, children = (table.column(c).to_numpy() for c in ("key", "zeros", "ones", "children"))
    words = key == -1
    top = ctw.top_levels(key[~words], zeros[~words], ones[~words], children[~words])
    return top, int(zeros[words].sum()), int(ones[words].sum())


def score_texts(docs: DataFrame, depth: int = ctw.DEPTH) -> DataFrame:
    """Scores of all rows (doc_id, text, learnt), learning from those with `learnt`.

    * Null text: empty, one token, the end. Null `learnt`: not learnt from. Where
      nothing is learnt every bit costs one bit.
    * Repeated rows count as often as they occur. An empty table gives no rows.
    * A null doc_id is carried through.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = on_files(docs.select("doc_id", "text", "learnt")).select(
        "doc_id", "_block", F.coalesce("learnt", F.lit(False)).alias("learnt"), text_bytes(F.col("text")).alias("bytes")
    )
    buckets = bucket_count(docs, "text")
    requests = materialise(request_rows(rows, _extractor(depth), _route, buckets), "requests")
    top, tokens, distinct = _survey(requests, buckets, depth)
    shipped = docs.sparkSession.sparkContext.broadcast(top)

    def answer(kind_, bucket):
        grams, counts, at = whole_bucket(bucket)
        if kind_ == BYTES:
            counts = ctw.log_chances(grams, [*shipped.value, *ctw.local_levels(grams, counts, depth)])
        yield from answer_batches(kind_, bucket, counts, at)

    answers = bucket_rows(requests, buckets, answer, ANSWER)
    norm = np.log10(tokens + distinct + 1)
    hasher = []

    def score(batch, found):
        if not hasher:
            hasher.append(WordHasher())
        data, offsets = column_bytes(batch.column("bytes"))
        size = batch.num_rows
        bits, base = np.zeros(size), np.zeros(size)
        total, known = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for lo, grams, count in _byte_slices(data, offsets, depth):
            begins = np.cumsum(count) - count
            bits[lo : lo + len(count)] = np.add.reduceat(found[BYTES](grams), begins)
        end = found[WORDS](np.array([END_WORD]))[0]
        for lo, hashes, count in hasher[0].per_text(data, offsets):
            seen = found[WORDS](_word_ids(hashes)) if len(hashes) else np.zeros(0)
            ends = np.concatenate([[0], np.cumsum(count)])
            logs = np.concatenate([[0.0], np.cumsum(np.log10(seen + 1) - norm)])
            hits = np.concatenate([[0], np.cumsum(seen > 0)])
            rows_ = slice(lo, lo + len(count))
            base[rows_] = logs[ends[1:]] - logs[ends[:-1]] + np.log10(end + 1) - norm
            known[rows_] = hits[ends[1:]] - hits[ends[:-1]] + (end > 0)
            total[rows_] = count + 1
        length = np.diff(offsets) + 1
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total), pa.array(known), pa.array(np.full(size, tokens, np.int64)),
             pa.array(base), pa.array(bits / np.log(10)), pa.array(-bits / np.log(2) / length)],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    return block_rows(
        rows.select("doc_id", "_block", "bytes"), answers, buckets, score,
        f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, "
        "bits_per_byte double",
    )


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 7) == 2


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents; those with crc32(doc_id) mod 7 = 2 are not learnt from."""
    marked = docs.withColumn("learnt", ~held_out(F.col("doc_id")))
    return score_texts(marked).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "bits_per_byte",
    )
