import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from surveyloom.llm import divergence
from surveyloom.llm.divergence import source_divergence


def brute_force(rows, least=30, top=50):
    """rows (text, lang, source) -> the whole result, in plain Python integers."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = {s: c for (l, s), c in counts.items() if l == lang}
        whole = sum(mine.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))

        pairs = [(sum(abs(share(mine[source], t) - share(c, t)) for t in kept), s) for s, c in mine.items() if s != source]
        terms = [(share(mine[source], t) - share(whole, t), t) for t in kept if mine[source][t]]
        for part, items in (("pair", pairs), ("term", [(v, t) for v, t in terms if v > 0])):
            items.sort(key=lambda i: (-i[0], i[1].encode()))
            out += [
                (lang, source, part, item, value, rank + 1)
                for rank, (value, item) in enumerate(items if part == "pair" else items[:top])
            ]
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def some_rows(seed, n=400, sources=9):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{'Wö' if i % 3 else 'x'}{chr(97 + i % 26)}{'z' * (i // 26)}" for i in range(120)]
    weights = 1 / np.arange(1, 121)
    rows = []
    for _ in range(n):
        words = rng.choice(vocabulary, size=rng.integers(0, 40), p=weights / weights.sum())
        source = "hot" if rng.random() < 0.4 else f"s{rng.integers(sources)}"
        rows.append(("-".join(words), ["en", "de", None][rng.integers(3)], source))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"BUCKET_TERMS": 7, "CHUNK_GROUPS": 3, "BLOCK_TERMS": 4, "TILE_LEVELS": 5, "HELD_TERMS": 20, "PIECE": 16}])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rows = some_rows(len(sizes))
    assert found(source_divergence(table(spark, rows), 10, 5)) == brute_force(rows, 10, 5)


def test_nulls_repeats_groups_without_words_and_other_columns(spark):
    rows = [("The cat, THE dog", "en", "a")] * 3 + [("the end", "en", "b"), (None, "en", None), ("", "en", "c"), (None, None, None)]
    rows += [("x y", "fr", "only"), ("x2y", "fr", "d"), ("ÀB àb", "zz", "a"), ("123 _ ^", "zz", "b")]
    df = table(spark, rows).selectExpr("*", "1 as term", "2 as n", "3 as slot", "4 as words")
    for least in (1, 2, 3, 100):
        assert found(source_divergence(df, least)) == brute_force(rows, least)


def test_very_long_text(spark, monkeypatch):
    rows = [("word other " * 200_000 + "x" * 50_000, "en", "a"), ("word", "en", "b"), ("x" * 50_000, "en", "b")]
    monkeypatch.setattr(divergence, "PIECE", 1000)
    assert found(source_divergence(table(spark, rows), 2)) == brute_force(rows, 2)


def test_empty_table(spark):
    assert found(source_divergence(table(spark, []))) == []


def test_shares_of_large_counts(spark):
    counts = [0, 1, 7 * 10**11, 10**14, 8 * 10**14]
    total = 8 * 10**14 + 5 * 10**7
    want = [1 + 10**9 * (c + 5) // total for c in counts]
    assert divergence.shares(np.array(counts), total).tolist() == want
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(c, total) for c in counts], "c bigint, t bigint").coalesce(1)
    assert [r[0] for r in df.select(divergence.share(F.col("c"), F.col("t"))).collect()] == want
