"""Hard negatives by exact integer products of whole blocks of vectors.

A component x counts as floor(256 * x), so scores are integers. They are computed as
matrix products modulo several small primes in float32: residues lie in [-p/2, p/2],
so that sums over a slice of the components stay below 2^24 and are exact. As many
primes are taken as the largest possible score needs, and the signed score is put
together again from its residues by Chinese remaindering in mixed radix.

Rows are dealt into shards and anchors into blocks of bounded size; every block of
anchors, a stated set of queries, meets every shard. That happens twice: the first time
an anchor keeps its best rows of the same label, the second time, for each of these
positives, its best rows of other labels inside the window of scores the positive opens.
A task keeps only the best of its shard, and what shards keep is merged by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.support import parts_for
from surveyloom.sources.scratch import materialise

SCALE = 256
EXACT = 1 << 24  # whole numbers up to here are exact in float32
MOST = 1 << 62  # a score must be below
SHARD_ROWS, BLOCK_ANCHORS = 1 << 17, 1 << 15
TILE_ROWS, TILE_ANCHORS = 1 << 12, 1 << 10
NO_ID = (1 << 63) - 1  # a null id: after all others among ties, null again in the result
NONE = -(1 << 63)


def primes_for(most: int) -> list[int]:
    """The largest primes below 256 whose product exceeds all signed values up to `most`."""
    known = [p for p in range(3, 256, 2) if all(p % d for d in range(3, int(p**0.5) + 1, 2))]
    chosen, product = [], 1
    while product <= 2 * most + 1:
        if not known:
            raise OverflowError("scores do not fit the available primes")
        chosen.append(known.pop())
        product *= chosen[-1]
    return chosen


def centred(values: np.ndarray, prime: int) -> np.ndarray:
    """The residue nearest to 0, of whole numbers in float32 below EXACT."""
    return values - np.float32(prime) * np.rint(values * np.float32(1 / prime))


class Residues:
    """A matrix of whole numbers as one float32 matrix per prime."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = []
        for p in primes:
            rest = (matrix % p).astype(np.float32)
            self.parts.append(np.where(rest > p // 2, rest - np.float32(p), rest).astype(np.float32))

    def rows(self, lo: int, hi: int) -> Residues:
        some = Residues.__new__(Residues)
        some.primes, some.parts = self.primes, [part[lo:hi] for part in self.parts]
        return some


def products(left: Residues, right: Residues) -> np.ndarray:
    """left @ right.T as exact int64."""
    rests = []
    for p, a, b in zip(left.primes, left.parts, right.parts):
        width = max(1, (EXACT - p) // (p // 2 + 1) ** 2)
        total = np.zeros((len(a), len(b)), dtype=np.float32)
        for lo in range(0, a.shape[1], width):
            total = centred(total + centred(a[:, lo : lo + width] @ b[:, lo : lo + width].T, p), p)
        rests.append(total)
    # mixed radix: value = d0 + p0 * (d1 + p1 * (d2 + ...)), every digit nearest to 0
    digits = []
    for k, p in enumerate(left.primes):
        rest = rests[k]
        for digit, q in zip(digits, left.primes):
            rest = centred(centred(rest - digit, p) * np.float32(pow(q, -1, p)), p)
        digits.append(rest)
    value = digits[-1].astype(np.int64)
    for digit, q in zip(digits[-2::-1], left.primes[-2::-1]):
        value = value * q + digit.astype(np.int64)
    return value


def keep_best(score: np.ndarray, at: np.ndarray, new: np.ndarray, allowed: np.ndarray, first: int):
    """Take into (score, at), the best of each line in falling order, the allowed new scores.

    New columns stand for rows first, first + 1, ...; of equal scores the earlier row is better.
    """
    keep = score.shape[1]
    better = allowed & (new > score[:, -1:])
    if np.count_nonzero(better) > 4 * keep * len(new) and new.shape[1] > keep:
        low = np.where(better, new, NONE)
        better &= new >= np.partition(low, new.shape[1] - keep, axis=1)[:, [new.shape[1] - keep]]
    line, column = np.nonzero(better)
    if not len(line):
        return
    old_line, old_column = np.nonzero(at >= 0)
    lines = np.concatenate([old_line, line])
    scores = np.concatenate([score[old_line, old_column], new[line, column]])
    places = np.concatenate([at[old_line, old_column], column + first])
    order = np.lexsort((places, -scores, lines))
    lines, scores, places = lines[order], scores[order], places[order]
    begin = np.searchsorted(lines, lines)
    nth = np.arange(len(lines)) - begin
    top = nth < keep
    score[lines[top], nth[top]] = scores[top]
    at[lines[top], nth[top]] = places[top]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as lines; what a shorter one lacks is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (length == width).all():
        return values.reshape(len(length), width)
    matrix = np.zeros((len(length), width), dtype=np.int64)
    matrix[np.repeat(np.arange(len(length)), length), np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)] = values
    return matrix


def percent(values: np.ndarray, share: int) -> np.ndarray:
    """share * values / 100, rounded down, without a product that grows beyond the values."""
    return values // 100 * share + values % 100 * share // 100


def usable_rows(vectors: DataFrame, anchors: str, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """Rows (rid, id, label, anchor, vector of whole numbers) that take part."""
    rows = vectors.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), label.cast("bigint").alias("label"),
        F.coalesce(F.expr(anchors), F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("x"),
    ).where("label is not null and x is not null")
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform("x", lambda v: F.floor(SCALE * v).cast("bigint"))
    return rows.where(sound).select(F.monotonically_increasing_id().alias("rid"), "id", "label", "anchor", whole.alias("vector"))


def _meet(rows: DataFrame, anchors: DataFrame, cells: tuple[int, int], search, schema: str) -> DataFrame:
    """`search(anchors, rows)` for every block of anchors and every shard of rows."""
    shards, blocks = cells
    deal = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = [F.col(c).alias(c) for c in anchors.columns]  # anchors are rows themselves: columns of their own
    left = anchors.select(every(shards).alias("shard"), deal(blocks).alias("block"), *own)
    right = rows.select(deal(shards).alias("shard"), every(blocks).alias("block"), "*")

    def cell(asked: pa.Table, some: pa.Table) -> pa.Table:
        return search(asked.sort_by("rid"), some.sort_by([("id", "ascending"), ("rid", "ascending")]))

    left, right = (side.repartition(shards, "shard", "block") for side in (left, right))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(cell, schema)


def hard_negatives(
    vectors: DataFrame, anchors: str = "vec_id % 100 = 0", label: Column | None = None, positives: int = 5, negatives: int = 5,
    low_percent: int = 80, high_percent: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that the condition `anchors` selects. An anchor's positives are
    the `positives` best other rows of its label; for each, the `negatives` best rows of
    other labels follow whose score is between `low_percent` and `high_percent` of the
    positive's. Higher scores are better, of equal ones the smaller id.

    * `label` is an expression in place of `label_col`. Rows with a null label, a null vector, or a component that is null or not finite
      take no part. A vector shorter than the longest one counts as filled up with 0.
    * A null id is never selected by a condition on it; among ties it comes last, and it
      is null again in the result. Rows that repeat an id are rows of their own: each can
      be the other's positive, and as anchors each has its own result.
    * Fewer positives or negatives than asked for: as many as there are, also none. An
      empty table, or one without anchors, gives an empty result. Other columns are ignored.
    * Scores must stay below 2^62, else the job fails.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if label is None else label
    rows = materialise(usable_rows(vectors, anchors, id_col, vector_col, label), "rows")
    size = F.aggregate("vector", F.lit(0.0), lambda t, v: F.greatest(t, F.abs(v.cast("double"))))
    facts = rows.agg(
        F.max(size).alias("most"), F.max(F.size("vector")).alias("width"), F.count("*").alias("rows"),
        F.count_if("anchor").alias("anchors"),
    ).first()
    most = int(facts["most"] or 0) ** 2 * (facts["width"] or 0)
    if most >= MOST:
        raise OverflowError("the largest possible score does not fit a long")
    primes, width = primes_for(most), facts["width"] or 0
    cells = (parts_for(spark, facts["rows"], SHARD_ROWS), max(1, -(-facts["anchors"] // BLOCK_ANCHORS)))

    def tiles(asked: pa.Table, some: pa.Table):
        """(anchors from, to, rows from, scores) of a cell; all anchors meet a stretch of rows before the next one."""
        left, right = Residues(_matrix(asked["vector"], width), primes), _matrix(some["vector"], width)
        for first in range(0, len(some), TILE_ROWS):
            part = Residues(right[first : first + TILE_ROWS], primes)
            for lo in range(0, len(asked), TILE_ANCHORS):
                yield lo, min(lo + TILE_ANCHORS, len(asked)), first, products(left.rows(lo, lo + TILE_ANCHORS), part)

    def same_label(asked: pa.Table, some: pa.Table) -> pa.Table:
        score = np.full((len(asked), positives), NONE, dtype=np.int64)
        at = np.full((len(asked), positives), -1, dtype=np.int64)
        rid, own, label, other = (t[c].to_numpy() for t, c in ((asked, "rid"), (some, "rid"), (asked, "label"), (some, "label")))
        for lo, hi, first, new in tiles(asked, some):
            to = first + new.shape[1]
            allowed = (label[lo:hi, None] == other[first:to]) & (rid[lo:hi, None] != own[first:to])
            keep_best(score[lo:hi], at[lo:hi], new, allowed, first)
        line, nth = np.nonzero(at >= 0)
        found = at[line, nth]
        return pa.table(
            {"rid": rid[line], "positive_rid": own[found], "positive_id": some["id"].to_numpy()[found], "positive_score": score[line, nth]}
        )

    def in_window(asked: pa.Table, some: pa.Table) -> pa.Table:
        label, other = asked["label"].to_numpy(), some["label"].to_numpy()
        opened = asked["opened"].combine_chunks() if isinstance(asked["opened"], pa.ChunkedArray) else asked["opened"]
        count = opened.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        marks = np.zeros((len(asked), positives), dtype=np.int64)
        there = np.arange(positives) < count[:, None]
        marks[there] = opened.flatten().to_numpy(zero_copy_only=False)
        low, high = -percent(-marks, low_percent), percent(marks, high_percent)
        score = np.full((positives, len(asked), negatives), NONE, dtype=np.int64)
        at = np.full((positives, len(asked), negatives), -1, dtype=np.int64)
        for lo, hi, first, new in tiles(asked, some):
            differs = label[lo:hi, None] != other[first : first + new.shape[1]]
            for k in range(positives):
                allowed = differs & there[lo:hi, [k]] & (new >= low[lo:hi, [k]]) & (new <= high[lo:hi, [k]])
                keep_best(score[k, lo:hi], at[k, lo:hi], new, allowed, first)
        which, line, nth = np.nonzero(at >= 0)
        found = at[which, line, nth]
        return pa.table(
            {
                "rid": asked["rid"].to_numpy()[line], "nth": which, "negative_rid": some["rid"].to_numpy()[found],
                "negative_id": some["id"].to_numpy()[found], "negative_score": score[which, line, nth],
            }
        )

    wanted = rows.where("anchor")
    found = _meet(
        rows.drop("anchor"), wanted.select("rid", "label", "vector"), cells, same_label,
        "rid bigint, positive_rid bigint, positive_id bigint, positive_score bigint",
    )
    best = Window.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id", "positive_rid")
    chosen = materialise(
        found.withColumn("nth", F.row_number().over(best) - 1).where(F.col("nth") < positives).drop("positive_rid"), "positives"
    )
    opened = F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda s: s["positive_score"])
    asking = wanted.join(chosen.groupBy("rid").agg(opened.alias("opened")), "rid").select("rid", "label", "vector", "opened")
    found = _meet(
        rows.drop("anchor"), asking, cells, in_window, "rid bigint, nth bigint, negative_rid bigint, negative_id bigint, negative_score bigint"
    )
    best = Window.partitionBy("rid", "nth").orderBy(F.desc("negative_score"), "negative_id", "negative_rid")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return (
        found.join(chosen, ["rid", "nth"]).join(wanted.select("rid", F.col("id").alias("anchor_id")), "rid")
        .select("anchor_id", shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score")
    )
