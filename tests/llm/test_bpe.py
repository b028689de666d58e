from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from surveyloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(PATH, encoding="utf-8").read())


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), dtype="<i4").tolist()


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n\n  b\t\tc ", "aaaaaaaaaaaaaaaaa", "don't I'll we've 'S 's",
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x<|endoftext", "x y z w ​ q\x1cr \x85 s",
    "Straße naïve Ωmega 漢字仮名 🤖🤖 é ́́", "1234567 12,5 3.14 ²³ Ⅷ", "\x00\x01�", "ab" * 3000, "=" * 5000 + " x" * 500,
]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_ids_are_the_library_s(encoder, library, i):
    ids = library.encode(TEXTS[i], add_special_tokens=False).ids
    assert ids_of(encoder, TEXTS[i]) == ids


@pytest.mark.parametrize("wide", [0, 2, 1000])
def test_random_texts_in_small_stretches(encoder, library, monkeypatch, wide):
    for name, value in {"BATCH_SYMBOLS": 40, "BATCH_TEXT": 900, "STRETCH": 50, "SPLIT_WORDS": 3, "WIDE": wide}.items():
        monkeypatch.setattr(bpe, name, value)
    monkeypatch.setattr(bpe, "KEPT", 30)
    monkeypatch.setattr(bpe, "KEPT_LENGTH", 5)
    rng = np.random.default_rng(5)
    letters = list("aaabbe  \n\t'stl.1ß漢́ ") + ["the", " of", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(letters, size=rng.integers(0, 400))) for _ in range(300)]
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(ids, dtype="<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_split_as_by_the_library(library, encoder):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 166):
        text = "".join(f"a{c}1{c}-{c}" for c in points[lo : lo + 166])
        pieces = [text[begin:end] for _, (begin, end) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert encoder._split(text) == pieces


def test_code_points_in_words(encoder, library):
    points = [chr(c) for c in range(0x3100)] + [chr(c) for c in range(0x1D400, 0x1FB00, 7)]
    for lo in range(0, len(points), 500):
        text = " ".join(f"a{c}b {c} {c}{c} 1{c}" for c in points[lo : lo + 500])
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_decoding_is_the_library_s(library):
    decoder = bpe.Decoder(open(PATH, encoding="utf-8").read())
    rng = np.random.default_rng(2)
    for _ in range(200):
        ids = rng.integers(0, 50257, size=rng.integers(0, 60))
        assert decoder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    assert decoder.decode(np.array([64, 99999, -1, 65])) == library.decode([64, 65])


def test_query_over_documents(spark, sf, library):
    from surveyloom.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op11_pair_index_bpe"](spark, sf).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (
            len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest(),
        )


def test_nulls_repeats_long_texts_and_other_columns(spark, documents, library):
    long = "word " * 300_000 + "x" * 100_000
    rows = [(1, None), (2, ""), (3, "twice"), (3, "twice"), (None, "no id <|endoftext|>"), (4, long)]
    docs = documents(rows).selectExpr("*", "1 as ids", "'x' as `size`")
    found = bpe.encode_documents(docs, PATH)
    assert found.columns == ["doc_id", "ids"]
    want = sorted((d or 0, library.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in found.collect()) == want
    read = bpe.decode_documents(found, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in read) == sorted((d or 0, t or "") for d, t in rows)
    none = bpe.encoding_digests(documents([], "none"), PATH)
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 65])], "doc_id int, ids array<int>")
    assert [r["text"] for r in bpe.decode_documents(odd, PATH).orderBy("doc_id").collect()] == [None, "", "ab"]
