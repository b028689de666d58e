"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A code is cut into segments of about log2(codes) bits. Round r looks up, in every
segment, all values at distance r from the query's. After round r every code within
segments * (r + 1) - 1 bits has been met, since one of its segments has r errors or
fewer; a query whose k-th best distance is no larger is finished and asks no more.

For each segment, codes lie in buckets by the first bits of their value, and a query is
sent to the buckets whose first bits differ from its own in r places at most. So a code
is written once for each segment, however large the table, and a query meets few of the
buckets. Buckets of very common values are split into pieces, and the queries of much
asked ones into blocks; inside a cell of both, queries pass by in batches.

Equal codes are one entry with their k + 1 smallest ids. A query is never its own
neighbour. Queries that lie apart from all codes go on to larger radii and in the end
meet all buckets, which is exact as well.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.llm.support import shuffle_width
from surveyloom.sources.scratch import materialise

MOST_WIDTH = 30
BUCKET_CODES = 1 << 15
BLOCK_QUERIES = 1 << 14
STEP_ROWS = 1 << 21


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, bits, code): one bit per component, set where it is positive; a null or NaN component is not."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            signs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) > 0
            size = lists.value_lengths().to_numpy()
            begin = np.cumsum(size) - size
            for bits in np.unique(size):
                at = np.flatnonzero(size == bits)
                packed = np.packbits(signs[begin[at][:, None] + np.arange(bits)], axis=1)
                codes = pa.array([row.tobytes() for row in packed], pa.binary())
                sizes = pa.array(np.full(len(at), bits, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), sizes, codes], names=["id", "bits", "code"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where((F.size("vector") > 0) & F.col("id").isNotNull())
    return rows.mapInArrow(run, f"id {kind}, bits int, code binary")


def segment_widths(bits: int, codes: int) -> list[int]:
    """Segments of about log2(codes) bits, equal but for one bit."""
    count = max(1, round(bits / log2(max(2, codes))), -(-bits // MOST_WIDTH))
    count = min(count, bits)
    return [bits // count + (s < bits % count) for s in range(count)]


def with_parts(df: DataFrame, widths: list[int]) -> DataFrame:
    """The rows with `parts`, the values of the segments of `code`."""
    bits, ends = sum(widths), np.cumsum(widths)

    def run(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8)
            signs = np.unpackbits(raw.reshape(batch.num_rows, -1), axis=1, count=bits).astype(np.int32)
            parts = [signs[:, e - w : e] @ (1 << np.arange(w, dtype=np.int32)) for e, w in zip(ends, widths)]
            flat = np.stack(parts, axis=1).astype(np.int32).ravel()
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(widths)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "parts"])

    schema = T.StructType([*df.schema.fields, T.StructField("parts", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def part_matrix(column: pa.Array, segments: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, segments)


@lru_cache(maxsize=64)
def masks_of(width: int, errors: int) -> np.ndarray:
    """All values of `width` bits with `errors` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), errors)], np.int32)


def probes_of(queries: DataFrame, widths: list[int], prefix: int, radius: int) -> DataFrame:
    """(segment, bucket, code, parts): the buckets that may hold values at `radius` from a query's."""

    def run(batches):
        near = np.concatenate([masks_of(prefix, e) for e in range(min(prefix, radius) + 1)])
        for batch in batches:
            parts = part_matrix(batch.column("parts"), len(widths))
            for segment, width in enumerate(widths):
                home = parts[:, segment] >> (width - prefix)
                for lo in range(0, len(near), STEP_ROWS):
                    masks = near[lo : lo + STEP_ROWS]
                    step = max(1, STEP_ROWS // 32 // len(masks))
                    for first in range(0, len(home), step):
                        some = batch.slice(first, step)
                        buckets = (home[first : first + step, None] ^ masks).ravel()
                        rows = some.take(pa.array(np.repeat(np.arange(some.num_rows), len(masks))))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(buckets), segment, np.int32)), pa.array(buckets.astype(np.int32)), *rows.columns],
                            names=["segment", "bucket", "code", "parts"],
                        )

    return queries.select("code", "parts").mapInArrow(run, "segment int, bucket int, code binary, parts array<int>")


class Cell:
    """The codes of a piece of a bucket, in order of the other bits of their segment's value."""

    def __init__(self, parts: np.ndarray, ids: pa.Array, segment: int, bucket: int, low: int):
        self.segment, self.bucket, self.low = segment, bucket, low
        value = parts[:, segment] & ((1 << low) - 1)
        order = np.argsort(value, kind="stable")
        self.parts, self.ids = parts[order], ids.take(pa.array(order))
        self.values, first = np.unique(value[order], return_index=True)
        self.start = np.append(first, len(parts))

    def values_at(self, wanted: np.ndarray, errors: int):
        """(position in `wanted`, position in `values`) of all pairs that differ in `errors` bits."""
        if comb(self.low, errors) <= len(self.values):
            masks = masks_of(self.low, errors)
            targets = (wanted[:, None] ^ masks).ravel()
            at = np.minimum(np.searchsorted(self.values, targets), len(self.values) - 1)
            hit = np.flatnonzero(self.values[at] == targets)
            return hit // len(masks), at[hit]
        return np.nonzero(np.bitwise_count(wanted[:, None] ^ self.values) == errors)

    def met(self, queries: np.ndarray, radius: int):
        """(query, code, distance) triples that are met first here: in this segment, at `radius`."""
        own = queries[:, self.segment]
        rest = radius - np.bitwise_count((own >> self.low) ^ self.bucket).astype(np.int64)
        step = max(1, STEP_ROWS // len(self.parts))
        for errors in np.unique(rest[(rest >= 0) & (rest <= self.low)]):
            rows = np.flatnonzero(rest == errors)
            for lo in range(0, len(rows), step):
                block = rows[lo : lo + step]
                who, value = self.values_at(own[block] & ((1 << self.low) - 1), int(errors))
                count = self.start[value + 1] - self.start[value]
                who = block[np.repeat(who, count)]
                at = np.repeat(self.start[value] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                wrong = np.bitwise_count(queries[who] ^ self.parts[at])
                new = (wrong[:, : self.segment] > radius).all(1) & (wrong[:, self.segment + 1 :] >= radius).all(1)
                yield who[new], at[new], wrong[new].sum(1, dtype=np.int32)

    def nearest(self, queries: pa.RecordBatch, radius: int, k: int):
        """Batches (code, neighbour_id, distance): of the ids met first here, the k nearest of each query."""
        parts = part_matrix(queries.column("parts"), self.parts.shape[1])
        for who, at, distance in self.met(parts, radius):
            lists = self.ids.take(pa.array(at))
            many = lists.value_lengths().to_numpy()
            rows = pa.table({"who": np.repeat(who, many), "distance": np.repeat(distance, many), "id": lists.flatten()})
            rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("who", "distance", "id")]))
            who = rows.column("who").to_numpy()
            first = np.flatnonzero(np.diff(who, prepend=-1))
            place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            rows = rows.filter(pa.array(place < k)).combine_chunks()
            codes = queries.column("code").take(rows.column("who").combine_chunks())
            yield from pa.table({"code": codes, "neighbour_id": rows.column("id"), "distance": rows.column("distance")}).to_batches()


def search_cells(cells: DataFrame, parts: int, widths: list[int], prefix: int, radius: int, k: int, kind: str) -> DataFrame:
    """(code, neighbour_id, distance) of all cells; in each, codes (role 0) come before queries (role 1)."""
    place = ["segment", "bucket", "piece", "block"]

    def run(batches):
        key, codes, cell = None, [], None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in [*place, "role"]], axis=1)
            cuts = np.flatnonzero((np.diff(where, axis=0) != 0).any(1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)]):
                if lo == hi:
                    continue
                part, here = batch.slice(lo, hi - lo), tuple(where[lo, :4].tolist())
                if here != key:
                    key, codes, cell = here, [], None
                if where[lo, 4] == 0:
                    codes.append(part)
                    continue
                if cell is None and codes:
                    matrix = np.concatenate([part_matrix(c.column("parts"), len(widths)) for c in codes])
                    ids = pa.concat_arrays([c.column("ids") for c in codes])
                    cell, codes = Cell(matrix, ids, here[0], here[1], widths[here[0]] - prefix), []
                if cell is not None:
                    yield from cell.nearest(part, radius, k)

    dealt = cells.repartition(parts, *place).sortWithinPartitions(*place, "role")
    return dealt.mapInArrow(run, f"code binary, neighbour_id {kind}, distance int")


def nearest_codes(entries: DataFrame, queries: DataFrame, k: int, bits: int) -> DataFrame:
    """(code, neighbour_id, distance): for distinct query codes their k nearest ids among the entries (code, ids)."""
    spark, listed = entries.sparkSession, entries.schema["ids"].dataType
    kind = listed.elementType.simpleString()
    size = entries.agg(F.count("*").alias("codes"), F.sum(F.size("ids")).alias("ids")).first()
    widths = segment_widths(bits, size["codes"])
    prefix = min(min(widths), max(0, ceil(log2(max(1, size["codes"]) / BUCKET_CODES))))
    low = F.element_at(F.array(*[F.lit(1 << (w - prefix)) for w in widths]), F.col("segment") + 1)
    homes = with_parts(entries, widths).select("code", "ids", "parts", F.posexplode("parts").alias("segment", "value"))
    homes = materialise(homes.withColumn("bucket", F.floor(F.col("value") / low).cast("int")).drop("value"), "homes")
    pieces = F.ceil(F.count("*") / BUCKET_CODES).cast("int").alias("pieces")
    buckets = materialise(homes.groupBy("segment", "bucket").agg(pieces), "buckets")
    asking = materialise(with_parts(queries.select("code"), widths), "asking")
    best = spark.createDataFrame([], f"code binary, neighbour_id {kind}, distance int")
    first = Window.partitionBy("code").orderBy("distance", "neighbour_id")
    deal = lambda n: F.pmod(F.xxhash64("code"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = ["segment", "bucket"]
    for radius in range(max(widths) + 1):
        if not size["codes"] or asking.isEmpty():
            break
        probes = materialise(probes_of(asking, widths, prefix, radius), "probes")
        blocks = F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks")
        met = materialise(buckets.join(probes.groupBy(*place).agg(blocks), place), "met")
        parts = met.agg(F.sum(F.col("pieces") * F.col("blocks"))).first()[0] or 0
        left = homes.join(met, place).select(
            *place, deal("pieces").alias("piece"), every("blocks").alias("block"), F.lit(0).alias("role"),
            F.lit(None).cast("binary").alias("code"), "parts", "ids",
        )
        right = probes.join(met, place).select(
            *place, every("pieces").alias("piece"), deal("blocks").alias("block"), F.lit(1).alias("role"),
            "code", "parts", F.lit(None).cast(listed).alias("ids"),
        )
        found = search_cells(left.unionByName(right), max(shuffle_width(spark), parts), widths, prefix, radius, k, kind)
        best = best.unionByName(found).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n")
        best = materialise(best, "best")
        sure = F.count_if(F.col("distance") < len(widths) * (radius + 1))
        closed = best.groupBy("code").agg(sure.alias("sure"), F.count("*").alias("all"))
        closed = closed.where((F.col("sure") >= k) | (F.col("all") >= size["ids"])).select("code")
        asking = materialise(asking.join(closed, "code", "left_anti"), "asking")
    return best


def nearest_vectors(
    vectors: DataFrame, k: int = 10, queries: str = "vec_id % 20 = 0", id_col: str = "vec_id",
    vector_col: str = "embedding", bits: int | None = None,
) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest other rows of every row that `queries` selects.

    Distance is the number of differing signs; ties go to the smaller id.

    * Null ids and null or empty vectors are neither searched nor found. A null or NaN
      component counts as not positive.
    * Vectors may have any one length. Where a table holds several, `bits` names the one to
      take; without it that is an error, as distances between lengths mean nothing.
    * Rows with equal vectors are neighbours at distance 0. Ids should be unique; a
      repeated id is found as often as it occurs, but not by itself.
    * Fewer than k other rows: as many as there are. Empty table: empty result.
    """
    wanted = vectors.select(F.col(id_col), F.expr(queries).alias("wanted")).where("wanted").select(
        F.col(id_col).alias("id")
    ).distinct()
    codes = materialise(sign_codes(vectors, id_col, vector_col), "codes")
    if bits is None:
        least, bits = codes.agg(F.min("bits"), F.max("bits")).first()
        if least != bits:
            raise ValueError(f"{vector_col} holds vectors of {least} to {bits} components; choose one length by bits=")
    codes = codes.where(F.col("bits") == F.lit(bits)).drop("bits")
    # of equal codes, no list needs more than k ids beside the query's own
    first = Window.partitionBy("code").orderBy("id")
    few = codes.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = materialise(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    asked = materialise(codes.join(wanted, "id").select("id", "code").distinct(), "asked")
    near = nearest_codes(entries, asked.select("code").distinct(), k + 1, bits or 1)
    listed = near.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))).alias("near"))
    others = F.filter("near", lambda x: x["neighbour_id"] != F.col("query_id"))
    return (
        asked.select(F.col("id").alias("query_id"), "code").join(listed, "code")
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "found"))
        .select("query_id", (F.col("place") + 1).alias("rank"), "found.neighbour_id", "found.distance")
    )
