"""How far the sources of a language differ in their words, from exact joint tables.

1. Tasks count words per (language, source) and pass on sums; a word of a language is
   kept if enough of its documents hold it. Kept words are numbered within a language.
2. The smoothed share of a word in a group depends on the group and on the word's count
   there, its level, only. For a bucket of words and a few groups, a task builds the
   indicator matrix with a line per word and a column per (group, level) and multiplies
   it by its own transpose, block by block in float32, where counts below 2^24 are
   exact. That is the joint table of levels of every pair of groups; each cell is priced
   by the difference of the two levels' shares, and priced cells are added up.
3. The words in which a group is most above its language come from the counts directly,
   the best of each bucket first.

A cell of the products is (language, bucket of words, two chunks of groups), of bounded
size however many words, groups or rows there are.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.support import numbered, parts_for
from surveyloom.sources.scratch import materialise

SMOOTH = 5  # added to every count
STEPS = 3  # a share is in thousandths of thousandths of thousandths
HELD_TERMS = 200_000  # counts that a task holds before it passes them on
PIECE = 1 << 20  # bytes of a text that are split at once
BUCKET_TERMS, CHUNK_GROUPS = 1 << 12, 64
BLOCK_TERMS, TILE_LEVELS = 256, 2048
NUMBER_ROWS = 200_000
TERM = re.compile(rb"[a-z\x80-\xff]+")
BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")


def words_of(data: bytes):
    """Lists of a text's lower-cased words; a long text comes in several."""
    at = 0
    while at < len(data):
        found = BREAK.search(data, at + PIECE) if len(data) - at > PIECE else None
        stop = found.start() if found else len(data)
        yield TERM.findall(data[at:stop].lower())
        at = stop


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) for rows (lang, source, data): occurrences and documents, summed up."""

    def run(batches):
        held: dict = {}
        size = 0

        def settle():
            columns = ([], [], [], [], [])
            for (lang, source), (count, there) in held.items():
                for column, part in zip(columns, ([lang] * len(count), [source] * len(count), count, count.values(), map(there.__getitem__, count))):
                    column.extend(part)
            held.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"]
            )

        for batch in batches:
            data = batch.column("data")
            for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                if key not in held:
                    held[key] = (Counter(), Counter())
                count, there = held[key]
                size -= len(count)
                seen: set = set()
                for words in words_of(data[i].as_py()):
                    count.update(words)
                    seen.update(words)
                there.update(list(seen))
                size += len(count)
                if size >= HELD_TERMS:
                    yield settle()
                    size = 0
        if held:
            yield settle()

    rows = docs.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + SMOOTH) / total), three digits at a time, within 64 bits."""
    value, rest = F.lit(0).cast("bigint"), count + SMOOTH
    for _ in range(STEPS):
        value = value * 1000 + F.floor(F.call_function("div", rest * 1000, total))
        rest = rest * 1000 % total
    return value + 1


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """The same for an array."""
    value, rest = np.zeros_like(count), count + SMOOTH
    for _ in range(STEPS):
        value = value * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return value + 1


def joint_prices(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """(groups, groups): the sum over words of the difference of the groups' shares.

    `counts` has a line per word and a column per group. Lines are taken in order of
    their sums, so that a block has few levels.
    """
    words, groups = counts.shape
    value = np.zeros((groups, groups), dtype=np.int64)
    counts = counts[np.argsort(counts.sum(1), kind="stable")]
    for lo in range(0, words, BLOCK_TERMS):
        block = counts[lo : lo + BLOCK_TERMS]
        places, prices = [], []
        for g in range(groups):
            level, place = np.unique(block[:, g], return_inverse=True)
            places.append(place)
            prices.append(shares(level, int(totals[g])))
        sizes = np.array([len(p) for p in prices])
        tiles, first = [], 0  # stretches of groups whose levels fit a tile
        while first < groups:
            last = first + 1
            while last < groups and sizes[first : last + 1].sum() <= TILE_LEVELS:
                last += 1
            start = np.cumsum(sizes[first:last]) - sizes[first:last]
            hot = np.zeros((len(block), sizes[first:last].sum()), dtype=np.float32)
            for k, place in enumerate(places[first:last]):
                hot[np.arange(len(block)), start[k] + place] = 1
            tiles.append((first, last, start, hot, np.concatenate(prices[first:last])))
            first = last
        for i, (a, b, start, left, price) in enumerate(tiles):
            for c, d, other, right, cost in tiles[i:]:
                joint = (left.T @ right).astype(np.int64)
                joint *= np.abs(price[:, None] - cost)
                part = np.add.reduceat(np.add.reduceat(joint, start, axis=0), other, axis=1)
                value[a:b, c:d] += part
                if c != a:
                    value[c:d, a:b] += part.T
    return value


def _cell_pairs(table: pa.Table) -> pa.Table:
    """(lang, a, b, value) for the pairs of groups of a cell, each once; a header line per group has no term."""
    column = {c: table[c].to_numpy(zero_copy_only=False) for c in ("slot", "tid", "n", "words", "kept", "u", "v")}
    header = column["tid"] < 0
    slots, order = np.unique(column["slot"][header], return_index=True)
    totals = column["n"][header][order] + SMOOTH * column["kept"][header][order]
    words = int(column["words"][0])
    counts = np.zeros((words, len(slots)), dtype=np.int64)
    body = ~header
    counts[column["tid"][body] % BUCKET_TERMS, np.searchsorted(slots, column["slot"][body])] = column["n"][body]
    value = joint_prices(counts, totals)
    a, b = np.triu_indices(len(slots), 1)
    chunk = slots // CHUNK_GROUPS
    across = (chunk[a] != chunk[b]) | (column["u"][0] == column["v"][0])
    a, b = a[across], b[across]
    return pa.table(
        {"lang": pa.array([table["lang"][0].as_py()] * len(a), pa.string()), "a": slots[a], "b": slots[b], "value": value[a, b]}
    )


def source_divergence(
    docs: DataFrame, least_docs: int = 30, top_terms: int = 50,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Words are runs of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased. A
    language keeps the V words that at least `least_docs` of its documents hold; a word
    with c of a group's N occurrences of kept words has the share
    1 + floor(10^9 * (c + 5) / (N + 5 * V)).

    * Part `pair`: for every other source of the language, the sum over kept words of
      the difference of both shares; 0 where no word is kept.
    * Part `term`: the `top_terms` words that occur in the group and have a larger share
      there than in the whole language, with the difference.

    Ranks go by falling value, then item in the order of its bytes.

    * Null text, language and source count as empty strings. A group without words has
      its pairs. Repeated rows and ids count each time. A long text is split piece by piece.
    * An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).cast("binary").alias("data"))
    counts = materialise(term_counts(rows), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= least_docs
    ).drop("docs")
    kept = materialise(kept, "kept")
    kept = materialise(numbered(kept, ["lang"], ["term"], "tid", parts_for(spark, kept.count(), NUMBER_ROWS)), "numbered")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("all_words"))
    bucket = F.floor(F.col("tid") / BUCKET_TERMS).alias("bucket")
    used = materialise(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "tid", bucket, "n", "all"), "used")

    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.fillna(0, ["words", "kept", "all_words"]), "groups")
    slotted = numbered(groups, ["lang"], ["source"], "slot", parts_for(spark, groups.count(), NUMBER_ROWS))
    chunk = F.floor(F.col("slot") / CHUNK_GROUPS)
    slotted = materialise(slotted.withColumn("chunk", chunk), "slotted")
    chunks = slotted.groupBy("lang").agg((F.max("chunk") + 1).alias("chunks"))
    buckets = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.floor((F.col("kept") - 1) / BUCKET_TERMS)))
    # a group once per bucket, so that the rows of a large one meet it in many tasks
    spread = materialise(slotted.join(chunks, "lang").withColumn("bucket", F.explode(buckets)), "spread")
    known = used.join(
        spread.select("lang", "source", "bucket", "slot", "chunk", "chunks", F.col("words").alias("total"), "kept", "all_words"),
        ["lang", "source", "bucket"],
    )
    known = materialise(known, "known")

    lines = spread.select("lang", "bucket", "slot", F.lit(-1).cast("bigint").alias("tid"), F.col("words").alias("n"), "kept", "chunk", "chunks")
    lines = lines.unionByName(known.select("lang", "bucket", "slot", "tid", "n", "kept", "chunk", "chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    here = F.greatest(F.lit(0), F.least(F.lit(BUCKET_TERMS), F.col("kept") - F.col("bucket") * BUCKET_TERMS))
    cells = lines.withColumn("other", other).select(
        "lang", "bucket", F.least("chunk", "other").alias("u"), F.greatest("chunk", "other").alias("v"), "slot", "tid", "n",
        "kept", here.alias("words"),
    )
    priced = cells.groupBy("lang", "bucket", "u", "v").applyInArrow(_cell_pairs, "lang string, a bigint, b bigint, value bigint")
    priced = materialise(priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "priced")
    both = priced.unionByName(priced.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda slot, into: slotted.select("lang", F.col("slot").alias(slot), F.col("source").alias(into))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])

    order = (F.desc("value"), F.asc("item"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    pairs = ranked(pairs).withColumn("part", F.lit("pair"))
    total = lambda c: F.col(c) + SMOOTH * F.col("kept")
    above = known.select(
        "lang", "source", "bucket", F.col("term").alias("item"),
        (share(F.col("n"), total("total")) - share(F.col("all"), total("all_words"))).alias("value"),
    ).where("value > 0")
    first = Window.partitionBy("lang", "source", "bucket").orderBy(*order)
    above = above.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= top_terms)
    terms = ranked(above).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))
