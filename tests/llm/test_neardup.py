import random
from collections import defaultdict

import numpy as np
import pytest

from surveyloom.llm import neardup, wordhash
from surveyloom.llm.components import connected_components


def brute_force(rows, width, percent=80):
    """doc_id -> (set size, smallest id reachable), by all pairs."""
    sets, out = {}, {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
        sets[doc] = grams
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    for d in ids:
        out[d] = (len(sets[d]), find(d))
    return out


def edited(words, count, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), count):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(60)]
    base = [f"b{i}" for i in range(80)]
    # copies on both sides of the threshold, and a chain of small steps
    rows += [(100 + i, edited(base, i % 12, rng)) for i in range(70)]
    step = [f"c{i}" for i in range(100)]
    for i in range(12):
        step[i * 3] = f"x{i}"
        rows.append((300 + i, " ".join(step)))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "One"), (404, "one"), (405, "two words"), (406, "a b c d e"), (407, "A\x0bB  c\td e")]
    rows += [(500 + i, "exact copy of a text with nine words here") for i in range(20)]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_equals_all_pairs(documents, width):
    rows = fixture()
    want = brute_force(rows, width)
    found = neardup.near_duplicates(documents(rows), width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_one_of_each_keeps_rows_and_columns(documents):
    rows = fixture()
    docs = documents(rows).selectExpr("*", "1 as component", "2 as same", "3 as cid", "4 as row")
    kept = neardup.one_of_each(docs, 5)
    assert kept.columns == docs.columns
    want = sorted(d for d, (size, lead) in brute_force(rows, 5).items() if not size or d == lead)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_repeated_rows_and_null_ids(documents):
    text = "one two three four five six seven eight nine ten"
    docs = documents([(7, text), (7, text), (None, text), (9, text + " eleven"), (None, None), (5, "other text")])
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in neardup.near_duplicates(docs, 2).collect())
    assert found == [(0, 0), (0, 7), (5, 5), (7, 7), (7, 7), (9, 7)]
    assert neardup.one_of_each(docs, 2).count() == 3


def test_empty_table(documents):
    none = documents([], "none")
    assert neardup.near_duplicates(none).count() == 0 and neardup.one_of_each(none).count() == 0


def test_only_similarities_the_signatures_cover(documents):
    with pytest.raises(ValueError):
        neardup.near_duplicates(documents([(1, "a")]), 5, 70)


def test_pairs_within_the_distance_share_an_entry():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (300, neardup.SYMBOLS), dtype=np.uint8)
    b = a.copy()
    reach = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    for row in b:
        at = rng.choice(neardup.SYMBOLS, reach, replace=False)
        row[at] ^= rng.integers(1, 256, reach, dtype=np.uint8)
    shared = [len(set(x) & set(y)) for x, y in zip(neardup.entries(a).tolist(), neardup.entries(b).tolist())]
    assert min(shared) >= 1


def test_distance_of_signatures(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, (2, 50, neardup.SYMBOLS), dtype=np.uint8)
    a[0], b[0] = 255, 0
    rows = [(*x, *y) for x, y in zip(a.view("<i8").tolist(), b.view("<i8").tolist())]
    names = [f"{side}{k}" for side in "ab" for k in range(neardup.WORDS)]
    df = spark.createDataFrame(rows, names).select(neardup.distance("a", "b").alias("d"))
    assert [r["d"] for r in df.collect()] == (a != b).sum(1).tolist()


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(30)] + [(300, 200), (5, 5)]
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    groups = defaultdict(set)
    for r in found:
        groups[r["component"]].add(r["node"])
    assert groups == {0: set(range(51)), 100: set(range(100, 130)), 200: {200, 300}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_word_hashes_of_long_and_odd_texts():
    import pyarrow as pa

    texts = [b"", b"  ", b"Aa bB\x0bC", b"word " * 400_000, b"x" * 2_500_000 + b" y", "é É".encode(), b"aa bb c"]
    column = pa.array([b"skipped", *texts], pa.binary()).slice(1)
    got, ends = {}, {}
    for first, words, counts in wordhash.WordHasher().per_text(*wordhash.column_bytes(column)):
        ends = np.cumsum(counts)
        for i, n in enumerate(counts):
            got[first + i] = words[ends[i] - n : ends[i]].tolist()
    names = {}
    for i, text in enumerate(texts):
        words = text.lower().split()
        assert len(words) == len(got[i])
        assert all(names.setdefault(w, h) == h for w, h in zip(words, got[i]))
    assert len(set(names.values())) == len(names)
