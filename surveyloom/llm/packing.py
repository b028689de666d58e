"""Packing documents into token windows by non-negative least squares.

1. One pass over the documents encodes each text, appends the end id and cuts it
   into whole windows and a remainder. One document in `FILLER_SHARE` has its
   remainder cut into powers of two: small pieces that later close gaps exactly.
   Only lengths and checksums leave this pass.
2. The histogram of piece lengths (at most one line per possible length) goes to
   the driver. All pairs of lengths that fill a window, and the triples with one of
   the commonest lengths, are the columns of a non-negative least squares problem:
   how often is each combination used so that the histogram is met.
3. The counts are rounded down and what they leave over is solved again, until no
   combination fits; the rest is packed greedily, longest piece first.
4. Every piece gets its number among the pieces of its length, and that number
   says which combination, which repetition of it and which place it has.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.support import numbered, parts_for
from surveyloom.sources.scratch import materialise

END_ID = 1
FILLER_SHARE = 16
BLOCK_ROWS = 200_000
COMMON_LENGTHS = 24
CACHED_CHUNKS = 400_000
# how the vocabulary's library splits a text before merging: a fixed value
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Plan = list[tuple[tuple[int, ...], int]]


def byte_ranks(vocabulary: str) -> dict[bytes, int]:
    """Token bytes -> id, of a byte-level vocabulary file."""
    with open(vocabulary, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(byte_of[c] for c in token): i for token, i in entries.items() if all(c in byte_of for c in token)}


class _Chunks(dict):
    """Ids of ' ' + chunk, kept for chunks seen before."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk):
        ids = array("I", self.encode(" " + chunk)).tobytes()
        if len(chunk) <= 40:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Tokens that the file never splits -> id."""
    with open(vocabulary, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def text_encoder(ranks: dict[bytes, int], added: dict[str, int]):
    """text -> its ids as little-endian 32-bit bytes; tiktoken does the merging."""
    import tiktoken

    special = {token.encode() for token in added}
    own = tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if t not in special}, special_tokens={}
    )
    encode = own.encode_ordinary
    chunk_ids = _Chunks(encode).__getitem__
    # a space between two other characters always starts a new piece of the text
    uneven = re.compile(r"\s\s|^\s|\s$").search

    def plain(text: str) -> bytes:
        if uneven(text):
            return array("I", encode(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", encode(first)).tobytes() + b"".join(map(chunk_ids, rest))

    apart = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def ids(text: str) -> bytes:
        parts = apart.split(text) if apart else [text]
        if len(parts) == 1:
            return plain(text)
        return b"".join(array("I", [added[p]]).tobytes() if i % 2 else plain(p) for i, p in enumerate(parts) if p)

    return ids


def cuts(tokens: int, window: int, filler: bool) -> list[int]:
    """Piece lengths of a document: whole windows, then the remainder."""
    whole, rest = divmod(tokens, window)
    if not rest:
        return [window] * whole
    if not filler:
        return [window] * whole + [rest]
    return [window] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_pieces(docs: DataFrame, vocabulary: str, window: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast((byte_ranks(vocabulary), added_tokens(vocabulary)))

    def run(batches):
        from zlib import crc32

        ids_of = text_encoder(*ranks.value)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, text, filler in zip(*(column.to_pylist() for column in batch.columns)):
                ids = ids_of(text or "") + end
                total, start = len(ids) // 4, 0
                view = memoryview(ids)
                for length in cuts(total, window, filler):
                    piece = (doc, start, length, crc32(view[4 * start : 4 * (start + length)]), total)
                    for column, value in zip(rows, piece):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], batch.schema.field(0).type), *(pa.array(r, pa.int64()) for r in rows[1:])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    filler = F.pmod(F.xxhash64(F.lit("filler"), id_col), F.lit(FILLER_SHARE)) == 0
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), filler.alias("filler")).mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) of lengths in the histogram that add up to a window; a is 0 in pairs."""
    there = histogram > 0
    low = np.arange(1, window // 2 + 1)
    low = low[there[low] & there[window - low]]
    found = [np.stack([np.zeros_like(low), low, window - low], 1)]
    common = np.argsort(-histogram[1:window], kind="stable")[:COMMON_LENGTHS] + 1
    for a in sorted(int(x) for x in common if there[x]):
        b = np.arange(1, (window - a) // 2 + 1)
        c = window - a - b
        keep = there[b] & there[c]
        found.append(np.sort(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1), 1))
    return np.unique(np.concatenate(found), axis=0)


def least_squares(columns: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that brings the columns' use of lengths nearest to the histogram.

    Accelerated projected gradient; a column has at most three entries, so both
    products are look-ups and counts.
    """
    size = len(histogram)
    weights = (columns > 0).astype(float)
    target = histogram.astype(float).copy()
    target[0] = 0
    uses = np.bincount(columns.ravel(), weights.ravel(), size)
    step = 1.0 / max(1.0, 3 * uses.max())
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(steps):
        made = np.bincount(columns.ravel(), (weights * y[:, None]).ravel(), size)
        gradient = ((made - target)[columns] * weights).sum(1)
        new = np.maximum(0.0, y - step * gradient)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def greedy(left: dict[int, int], window: int) -> Plan:
    """Combinations for all that is left: the longest piece, then what fits best."""
    plan: Plan = []
    while left:
        lengths = sorted(left, reverse=True)
        uses, gap = {}, window
        for length in lengths:
            if n := min(gap // length, left[length]):
                uses[length] = n
                gap -= n * length
            if not gap:
                break
        times = min(left[length] // n for length, n in uses.items())
        plan.append((tuple(length for length, n in uses.items() for _ in range(n)), times))
        for length, n in uses.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


def plan_windows(histogram: dict[int, int], window: int) -> Plan:
    """(lengths in a window, number of such windows), using every piece once."""
    left = {length: n for length, n in histogram.items() if n}
    plan: Plan = []
    if full := left.pop(window, 0):
        plan.append(((window,), full))
    while True:
        found = solved(left, window)
        if not found:
            break
        plan += found
        for lengths, n in found:
            for length in lengths:
                left[length] -= n
    return plan + greedy({v: n for v, n in left.items() if n}, window)


def solved(left: dict[int, int], window: int) -> Plan:
    """Combinations for what is left by one solution, rounded; none once no combination is there.

    Counts are rounded down. Where that leaves nothing, the problem has become so small
    that its solution spreads below 1: the largest counts then become 1, as long as all
    their lengths are there, and what remains is solved again.
    """
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in left.items():
        counts[length] = n
    columns = combinations(counts, window)
    if not len(columns):
        return []
    times = least_squares(columns, counts)
    order = np.argsort(-times, kind="stable")
    down = np.floor(times[order]).astype(np.int64)
    wanted = down if down[0] > 0 else np.ones_like(down)
    free = counts.tolist()
    plan: Plan = []
    for k, most in zip(order.tolist(), wanted.tolist()):
        if not most:
            break
        lengths = [v for v in columns[k][::-1].tolist() if v]
        n = min(most, *(free[v] // lengths.count(v) for v in lengths))
        if n:
            plan.append((tuple(lengths), n))
            for v in lengths:
                free[v] -= n
    return plan


def slot_table(plan: Plan) -> dict[str, np.ndarray]:
    """A line per (combination, length): which numbers of that length it takes, and where they go."""
    taken: dict[int, int] = {}
    lines, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for length in dict.fromkeys(lengths):
            uses = lengths.count(length)
            begin = taken.get(length, 0)
            taken[length] = begin + uses * times
            lines.append((length, begin, sequence, uses, offset))
            offset += uses * length
        sequence += times
    lines.sort()
    names = ("length", "begin", "sequence", "uses", "offset")
    return {name: np.array([line[i] for line in lines], dtype=np.int64) for i, name in enumerate(names)}


def pack_documents(
    docs: DataFrame, vocabulary: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: where it comes from and where it lies.

    * Null and empty texts are documents of one id, the end.
    * Repeated rows and ids are documents of their own; equal texts need not share a
      sequence. Very long texts become many whole windows.
    * An empty table gives no pieces. Other columns of `docs` are ignored.
    * Sequences are full but for the last few, which take what small pieces are left.
    """
    spark = docs.sparkSession
    pieces = materialise(
        cut_pieces(docs, vocabulary, window, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "pieces"
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(slot_table(plan_windows(histogram, window)))
    blocks = parts_for(spark, sum(histogram.values()), BLOCK_ROWS)
    ranked = numbered(pieces, ["length"], ["rid"], "rank", blocks)

    def place(batches):
        table = slots.value
        # one ascending key for (length, first number), so that one search finds the line
        span = int(table["begin"].max(initial=0)) + 1
        keys = table["length"] * span + table["begin"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            line = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), side="right") - 1
            nth = rank - table["begin"][line]
            uses = table["uses"][line]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(table["sequence"][line] + nth // uses),
                    pa.array(table["offset"][line] + nth % uses * length),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    wanted = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*wanted, "rank").mapInArrow(
        place,
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
