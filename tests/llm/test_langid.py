import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import langid
from surveyloom.llm.support import table

EN = "the quick brown fox jumps over the lazy dog while other foxes watch them with great interest from the hill "
DE = "der schnelle braune fuchs springt ueber den faulen hund und andere schauen ihm dabei sehr gerne zu "


@pytest.fixture
def corpus(documents):
    return documents([(i, (EN if i % 2 else DE) * 3, "en" if i % 2 else "de") for i in range(40)], "corpus")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def predicted(corpus, docs):
    found = langid.identify(docs, langid.fit(langid.training_rows(corpus)))
    return by_id(found.select("row.doc_id", *langid.PREDICTION.names))


def test_shares_of_a_mixed_text(corpus, documents):
    rows = predicted(corpus, documents([(1, EN * 6 + DE * 2), (2, DE), (3, EN.upper())]))
    assert rows[1]["langs"] == ["en", "de"]
    assert rows[1]["shares"][0] == pytest.approx(0.75, abs=0.08) and rows[1]["score"] == pytest.approx(0.75, abs=0.08)
    assert rows[2]["lang_pred"] == "de" and rows[2]["langs"] == ["de"] and rows[2]["score"] > 0.99
    assert rows[3]["lang_pred"] == "en"


def test_nothing_to_go_by(corpus, documents):
    rows = predicted(corpus, documents([(1, None), (2, ""), (3, "123 !!"), (None, "the dog")]))
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert [rows[i]["score"] for i in (1, 2, 3)] == [0, 0, 0] and rows[None]["lang_pred"] == "en"


def test_gibberish_is_noise_but_gets_a_learnt_language(corpus, documents):
    row = predicted(corpus, documents([(1, "xqzj wvkq zzxq jjqx qqzw kxzj " * 5)]))[1]
    assert row["lang_pred"] in ("de", "en") and row["noise"] > 0.9


def test_only_rows_that_are_not_held_out_are_learnt(documents):
    docs = documents([(i, DE, "de") for i in range(30)] + [(100 + i, EN, None) for i in range(9)])
    kept = langid.training_rows(docs)
    assert 0 < kept.count() < 30 and kept.where("lang is null").isEmpty()
    rows = by_id(langid.language_mixtures(docs))
    assert len(rows) == 39 and {r["lang_pred"] for r in rows.values()} == {"de"}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())


def test_empty_tables_and_nothing_learnt(documents):
    none = documents([], "none")
    assert langid.language_mixtures(none).count() == 0
    row = predicted(none, documents([(1, "the dog")]))[1]
    assert row["lang_pred"] == "und" and row["score"] == 0


def test_other_columns_pass_through(corpus, documents):
    docs = documents([(1, EN), (1, EN)]).selectExpr("*", "1 as row", "'x' as lang_pred", "2.0 as score")
    found = langid.identify(docs, langid.fit(langid.training_rows(corpus))).select("row.*")
    assert found.columns == docs.columns and found.collect() == docs.collect()


def test_long_text_in_pieces_counts_as_one():
    grams = langid.Trigrams()
    texts = ["ab c", "", "é" * 10, "word " * 500_000, "x" * 3_000_000, "z"]
    words = {}
    for first, last, bins, starts, count in grams.pieces(texts):
        for k, n in zip(range(first, last), count):
            words[k] = words.get(k, 0) + int(n)
    assert words[0] == 2 and words[1] == 0 and words[2] == 1 and words[3] == 500_000 and words[5] == 1


def test_mixture_of_known_likelihoods():
    # 30 words only the first source can say, 10 only the second
    likelihood = np.log(np.array([[0.9, 1e-6, 1e-9]] * 30 + [[1e-6, 0.9, 1e-9]] * 10, dtype=np.float32))
    share = langid.mixtures(likelihood, np.array([40]))
    assert share[0] == pytest.approx([0.75, 0.25, 0], abs=1e-3)


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    docs = table(spark, folder, "documents")
    found = langid.language_mixtures(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_marks_alone_are_no_words(corpus, documents):
    marks = "\u0301\u0301 \u0483\u20dd"
    docs = documents([(1, marks), (2, marks + " " + EN), (3, EN)])
    model = langid.fit(langid.training_rows(corpus))
    found = {r["row"]["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert found[1]["lang_pred"] == langid.UNKNOWN and found[1]["score"] == 0
    assert found[2]["lang_pred"] == found[3]["lang_pred"] and found[2]["score"] == pytest.approx(found[3]["score"])


def test_words_against_a_pattern():
    import random
    import unicodedata

    draw = random.Random(3)
    for size in [0, 1, 2, 5, 40] * 40:
        text = "".join(draw.choice("ab\u0301\u0483 .") for _ in range(size))
        kinds = "".join({"L": "L", "M": "M"}.get(unicodedata.category(c)[0], " ") for c in text)
        runs = [part if "L" in part else " " * len(part) for part in kinds.split(" ")]
        codes = np.array([{"L": 2, "M": 1, " ": 0}[k] for k in kinds], dtype=np.uint8)
        assert langid.in_words(codes).tolist() == [k != " " for k in " ".join(runs)]


def mixture_by_definition(words):
    """Shares for one text, from each word's log-likelihood under each language and, last, noise."""
    sources = len(words[0])

    def em(share, members, steps):
        for _ in range(steps):
            new = dict.fromkeys(members, 0.0)
            for word in words:
                joint = {m: share[m] * np.exp(word[m] - max(word)) for m in members}
                for m in members:
                    new[m] += joint[m] / sum(joint.values()) / len(words)
            share = new
        return share

    def fitted(share):
        return sum(np.log(sum(s * np.exp(word[m] - max(word)) for m, s in share.items())) for word in words)

    everyone = range(sources)
    full = em(dict.fromkeys(everyone, 1 / sources), everyone, langid.EM_STEPS)
    lead = max(range(sources - 1), key=lambda m: full[m])
    rest = sorted((m for m in everyone if m != lead), key=lambda m: -full[m])
    chosen = {lead: 1.0}
    best = fitted(chosen)
    for size in range(1, sources):
        members = [lead, *rest[:size]]
        start = {m: max(full[m], 1e-6) for m in members}
        share = em({m: s / sum(start.values()) for m, s in start.items()}, members, 3)
        value = fitted(share) - langid.PENALTY * 0.5 * np.log(len(words) + 1) * size  # a parameter a further source
        if value <= best:
            break
        chosen, best = share, value
    return [chosen.get(m, 0.0) for m in everyone]


def test_mixtures_equal_their_definition():
    draw = np.random.default_rng(5)
    texts = []
    for n in [1, 1, 2, 5, 20, 60, 60, 150] * 4:
        truth = draw.dirichlet([0.3] * 4)
        lean = np.zeros((n, 4))
        lean[np.arange(n), draw.choice(4, n, p=truth)] = draw.uniform(0, 6, n)
        texts.append(draw.normal(-20, 1, (n, 4)) + lean)
    got = langid.mixtures(np.concatenate(texts).astype(np.float32), np.array([len(t) for t in texts]))
    want = np.array([mixture_by_definition(t.tolist()) for t in texts])
    assert ((got > 0).sum(1) == (want > 0).sum(1)).all() and len(set((want > 0).sum(1).tolist())) > 1
    assert got == pytest.approx(want, abs=1e-3)


def test_a_very_long_text_is_read_to_its_end(corpus, documents):
    text = EN * 20_000 + DE * 22_000  # over 4 million letters, in several pieces
    rows = predicted(corpus, documents([(1, text), (2, DE), (3, EN)]))
    words = np.array([20_000 * len(EN.split()), 22_000 * len(DE.split())])
    assert dict(zip(rows[1]["langs"], rows[1]["shares"]))["en"] == pytest.approx(words[0] / words.sum(), abs=0.08)
    assert sorted(rows[1]["langs"]) == ["de", "en"] and (rows[2]["lang_pred"], rows[3]["lang_pred"]) == ("de", "en")
