import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from surveyloom.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "a", "  two  spaces ", "tab\tand\nline\n\n end ", "naïve café — 北京 🙂", "x" * 5000, "don't we'll I'd", "1234 5678",
    "<|endoftext|> is one id", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "a b  c", "\x1c\x1d odd \x85 blanks", "word " * 3000, "   ", "end ", " start",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encode():
    return packing.text_encoder(packing.byte_ranks(VOCABULARY), packing.added_tokens(VOCABULARY))


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_library(tokenizer, encode, text):
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sé1 \n\t. -Z", max_size=40))
def test_ids_of_any_text(tokenizer, encode, text):
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 9000), st.booleans())
def test_cuts_cover_a_document(tokens, filler):
    pieces = packing.cuts(tokens, 2048, filler)
    assert sum(pieces) == tokens and all(1 <= p <= 2048 for p in pieces)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_uses_every_piece_once(histogram):
    used = {}
    for lengths, times in packing.plan_windows(dict(histogram), 64):
        assert sum(lengths) <= 64 and times > 0
        for length in lengths:
            used[length] = used.get(length, 0) + times
    assert used == histogram


def test_least_squares_meets_a_histogram_that_can_be_met():
    histogram = np.zeros(65, dtype=np.int64)
    histogram[[20, 44, 10, 30, 24]] = [500, 500, 300, 300, 300]
    columns = packing.combinations(histogram, 64)
    times = packing.least_squares(columns, histogram)
    made = np.zeros(65)
    for column, n in zip(columns, times):
        for length in column[column > 0]:
            made[length] += n
    assert np.abs(made - histogram).max() < 5


def check(rows, texts, tokenizer, window=2048):
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert not ends or (max(ends.values()) <= window and sorted(ends) == list(range(len(ends))))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    return ends


def test_round_trip(documents, tokenizer):
    texts = dict(enumerate([*TEXTS, None, "same", "same"]))
    found = packing.pack_documents(documents(list(texts.items())).withColumnRenamed("source", "rank"), VOCABULARY)
    check(found.collect(), texts, tokenizer)


def test_little_padding(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ends = check(packing.pack_documents(docs, VOCABULARY).collect(), texts, tokenizer)
    assert sum(2048 - n for n in ends.values()) < 0.01 * 2048 * len(ends)


def test_repeated_rows_and_empty_table(documents):
    rows = packing.pack_documents(documents([(1, "one two"), (1, "one two"), (None, None)]), VOCABULARY).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.pack_documents(documents([], "none"), VOCABULARY).collect() == []


def test_most_windows_come_from_least_squares(monkeypatch):
    """But for windows that one whole piece fills; and no window more than the tokens need."""
    rng = np.random.default_rng(4)
    histogram = {2048: 30}
    for tokens in np.exp(rng.normal(5.8, 1.0, 3000)).astype(int) + 1:
        for piece in packing.cuts(int(tokens), 2048, rng.random() < 1 / packing.FILLER_SHARE):
            histogram[piece] = histogram.get(piece, 0) + 1
    greedily = []
    plain = packing.greedy
    monkeypatch.setattr(packing, "greedy", lambda left, window: greedily.extend(plain(left, window)) or list(greedily))
    plan = packing.plan_windows(dict(histogram), 2048)
    used = {}
    for lengths, times in plan:
        for length in lengths:
            used[length] = used.get(length, 0) + times
    assert used == histogram
    windows = sum(times for _, times in plan)
    assert windows <= -(-sum(k * n for k, n in histogram.items()) // 2048) + 1
    assert sum(times for _, times in greedily) < (windows - histogram[2048]) / 2
