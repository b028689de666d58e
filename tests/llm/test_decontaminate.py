import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surveyloom.llm import decontaminate as dc
from surveyloom.llm.wordhash import WordHasher

RNG = random.Random(11)
VOCABULARY = [f"v{i}" for i in range(400)] + ["the", "of", "and"] * 60
ITEMS = [(i, " ".join(RNG.choices(VOCABULARY, k=n))) for i, n in enumerate([15, 17, 22, 30, 33, 47, 64, 70, 8, 5, 3, 1])]


def least_edits(item, text):
    """Fewest edits of the item against any stretch of the text, by the full table."""
    row = np.zeros(len(text) + 1, int)
    for a in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j, b in enumerate(text, 1):
            new[j] = min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def edited(words, count):
    words = list(words)
    for _ in range(count):
        at = RNG.randrange(len(words))
        kind = RNG.random()
        if kind < 0.4:
            words[at] = "other"
        elif kind < 0.7 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, "more")
    return words


def around(words):
    return " ".join([*RNG.choices(VOCABULARY, k=RNG.randrange(50)), *words, *RNG.choices(VOCABULARY, k=RNG.randrange(50))])


def search(texts, items=ITEMS, rate=0.2):
    return dc.find_leaks(texts, dc.Index(items, rate), WordHasher(dc.LETTERS))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.lists(st.sampled_from("abcde"), max_size=25), st.integers(0, 4))
def test_edit_distance_is_exact(item, text, most):
    index = dc.Index([(1, " ".join(item))], 0.2)
    hasher = WordHasher(dc.LETTERS)
    ids = [int(w) for _, words, _ in dc.text_words([" ".join(text)], hasher) for w in words]
    best, _ = index.edits(0, ids, most)
    assert best == min(least_edits(item, text), most + 1) or (not text and best == most + 1)


def test_unedited_passages_are_always_found():
    texts = [around(text.split()) for _, text in ITEMS for _ in range(5)]
    got = search(texts)
    for n, found in enumerate(got):
        item, text = ITEMS[n // 5]
        mine = [f for f in found if f[0] == item]
        assert mine and mine[0][1] == 0 and mine[0][2] == len(text.split())
        assert texts[n].split()[mine[0][3] : mine[0][3] + mine[0][2]] == text.split()


@pytest.mark.parametrize("share,recall", [(0.1, 0.98), (0.2, 0.9)])
def test_recall_of_edited_passages(share, recall):
    items = [(i, t) for i, t in ITEMS if len(t.split()) >= 15]
    wanted = [(i, around(edited(t.split(), int(share * len(t.split()))))) for i, t in items for _ in range(40)]
    got = search([t for _, t in wanted])
    assert np.mean([any(f[0] == i for f in found) for (i, _), found in zip(wanted, got)]) >= recall


@pytest.mark.parametrize("length", [16, 17, 31, 32, 33, 64, 128, 200, 400, 800])
@pytest.mark.parametrize("share,recall", [(0.1, 0.96), (0.2, 0.88)])
def test_recall_at_every_length(length, share, recall):
    items = [(i, " ".join(RNG.choices(VOCABULARY[:400], k=length))) for i in range(max(30, min(300, 6400 // length)))]
    got = search([around(edited(t.split(), int(share * length))) for _, t in items], items)
    assert np.mean([any(f[0] == i for f in found) for (i, _), found in zip(items, got)]) >= recall


def test_passages_without_their_first_words_at_the_start_of_any_text():
    for n, cut in [(20, 3), (32, 4), (40, 6), (59, 6)]:
        words = RNG.choices(VOCABULARY[:400], k=n)
        text = " ".join([*words[cut:], *RNG.choices(VOCABULARY[:400], k=60)])
        alone = search([text], [(1, " ".join(words))])[0]
        others = " ".join(RNG.choices(VOCABULARY[:400], k=80))
        got = search([others, text, others, text], [(1, " ".join(words))])
        assert alone and got == [[], alone, [], alone]
        assert alone[0][1] <= cut and alone[0][3] == 0


def test_whatever_is_found_is_within_the_limit():
    texts = [around(edited(t.split(), k)) for _, t in ITEMS for k in range(0, 12, 3)]
    for text, found in zip(texts, search(texts)):
        for item, edits, words, _ in found:
            assert edits <= int(0.2 * words) and edits == least_edits(dict(ITEMS)[item].split(), text.split())


def test_case_and_punctuation_do_not_matter():
    text = dict(ITEMS)[3]
    odd = text.upper().replace(" ", ", ", 3).replace(" ", "\n— ", 2) + "!!"
    assert [f[0] for f in search([odd, "Éa ÉB çd ée éf ég éh"], [(3, text), (4, "éa éb Çd Ée éf ég éh")])[0]] == [3]
    assert search(["Éa ÉB çd ée éf ég éh"], [(4, "éa éb Çd Ée éf ég éh")])[0][0][1] == 0


def test_long_text_is_searched_whole():
    filler = " ".join(RNG.choices(VOCABULARY[:400], k=100_000))
    whole = " ".join([filler] * 6 + [ITEMS[4][1]] + [filler] * 3 + [ITEMS[7][1]])
    assert {4, 7} <= {f[0] for f in search([whole, "", "short"])[0]}


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, documents):
    items = [(1, ITEMS[0][1]), (1, ITEMS[0][1]), (2, None), (3, "..."), (None, ITEMS[3][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents([(1, around(ITEMS[0][1].split())), (1, None), (2, ""), (None, ITEMS[3][1]), (4, "clean text")])
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in dc.contaminated(docs, benchmark).collect()}
    assert found == {(1, 1, 0), (None, None, 0)}
    wide = docs.selectExpr("*", "1 as row", "2 as leaks", "3 as item_id")
    rows = dc.with_leaks(wide, benchmark)
    assert rows.select("row.*").columns == wide.columns and rows.count() == 5
    assert dc.contaminated(documents([], "none"), benchmark).count() == 0
    assert dc.contaminated(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_a_benchmark_of_several_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEM_BYTES", 300)
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert len(dc.item_blocks(benchmark)) > 2
    docs = documents([(i, t) for i, t in ITEMS] + [(99, " ".join(t for _, t in ITEMS[:8]))])
    found = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, benchmark).where("edits = 0").collect()}
    assert {(i, i) for i, _ in ITEMS} | {(99, i) for i in range(8)} <= found
