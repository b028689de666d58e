"""Joins of the tokens of whole texts with a sharded table, block by block.

Scoring a text needs a number for each of its n-grams, and the table of numbers is too
large to broadcast. Joining token by token would shuffle many times the input. Here a
block of documents, one split of an input file, asks once for each distinct gram:

1. `request_rows`: every block sends its distinct grams (with counts from its training
   documents) to the buckets of the table, packed, one row per block and bucket;
2. `bucket_rows`: a bucket adds the counts of all blocks up, works out a value for
   each gram, and answers every block in the order of its request;
3. `block_rows`: documents, packed and compressed, meet the answers of their block.

A frequent gram is asked for once per block however often it occurs, and buckets hold
distinct grams only, so neither step has hot keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.support import shuffle_width, text_bytes
from surveyloom.llm.wordhash import mix
from surveyloom.sources.scratch import materialise

SLICE_BYTES = 1 << 20
HELD_GRAMS = 1 << 22
PAYLOAD_BYTES = 1 << 19
BUCKET_TEXT = 8 << 20
LEAST_BUCKETS = 48
BUCKETS_A_PART = 4

Counted = tuple[np.ndarray, np.ndarray]


def pack(values: np.ndarray) -> bytes:
    """Bytes of whole numbers or floats, plane by plane, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def pack_sorted(grams: np.ndarray) -> bytes:
    return pack(np.diff(grams.astype(np.int64), prepend=np.int64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.int64))


def counted(parts: list[Counted]) -> Counted:
    """Sorted distinct grams of all parts, with summed counts."""
    grams = np.concatenate([g for g, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    found, at = np.unique(grams, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def on_files(docs: DataFrame) -> DataFrame:
    """docs as a scan of files, with their block; written first where they are none.

    A block is a split of a file, by the metadata that the file source keeps of every
    row. Rows of generated tables, aggregates, unions and most joins have none. Rows
    that were shuffled may still have theirs, but a block's rows no longer lie
    together; such tables are written first too, whatever their size.
    """

    def placed(rows: DataFrame) -> DataFrame:
        split = rows.metadataColumn("_metadata")
        return rows.withColumn("_block", F.hash(split["file_path"], split["file_block_start"]))

    try:
        found = placed(docs)
        straight = "_block" in found.columns and docs.where(F.input_file_name() == "").isEmpty()
    except AnalysisException:
        straight = False
    return found if straight else placed(materialise(docs, "docs"))


def bucket_count(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(text_bytes(F.col(text_col))))).first()[0] or 0
    return max(LEAST_BUCKETS, 4 * shuffle_width(docs.sparkSession), -(-size // BUCKET_TEXT))


def dealt(rows: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """Rows of a key together; the number of parts grows with the buckets, so tasks do not."""
    parts = -(-buckets // BUCKETS_A_PART)
    if parts <= shuffle_width(rows.sparkSession):
        return rows.repartition(*keys)
    return rows.repartition(parts, *keys)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes; a longer row is alone."""
    at = 0
    while at < len(offsets) - 1:
        last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, last
        at = last


def request_rows(docs: DataFrame, extract: Callable, route: Callable, buckets: int) -> DataFrame:
    """(bucket, block, kind, grams, counts), packed.

    extract(batch) yields (kind, grams, counts), each gram distinct within its array;
    route(kind, grams) gives a hash that keeps together what a bucket must see together.
    """

    def flush(block, parts):
        for kind, arrays in parts.items():
            grams, counts = counted(arrays)
            bucket = (mix(route(kind, grams).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.unique(bucket):
                at = order[ends[b] : ends[b + 1]]
                yield int(b), block, kind, pack_sorted(grams[at]), pack(counts[at])

    def run(batches):
        parts: dict[int, list[Counted]] = {}
        block, held = None, 0

        def out(rows):
            if rows := list(rows):
                columns = list(zip(*rows))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "block", "kind", "grams", "counts"]
                )

        for batch in batches:
            own = batch.column("_block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if block is not None and own[lo] != block:
                    yield from out(flush(block, parts))
                    parts, held = {}, 0
                block = int(own[lo])
                for kind, grams, counts in extract(batch.slice(lo, hi - lo)):
                    parts.setdefault(kind, []).append((grams, counts))
                    held += len(grams)
                    if held > HELD_GRAMS:
                        parts = {k: [counted(v)] for k, v in parts.items()}
                        held = sum(len(v[0][0]) for v in parts.values())
                        if held > HELD_GRAMS // 2:  # rows of a block may be sent in several goes
                            yield from out(flush(block, parts))
                            parts, held = {}, 0
        if block is not None:
            yield from out(flush(block, parts))

    return docs.mapInArrow(run, "bucket int, block int, kind int, grams binary, counts binary")


def bucket_rows(requests: DataFrame, buckets: int, work: Callable, schema: str) -> DataFrame:
    """work(kind, [(block, grams, counts)]) for each bucket; it yields record batches."""

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for kind, bucket, block, grams, counts in zip(
                *(batch.column(c) for c in ("kind", "bucket", "block", "grams", "counts"))
            ):
                own = (kind.as_py(), bucket.as_py())
                if own != key:
                    if rows:
                        yield from work(key[0], rows)
                    key, rows = own, []
                rows.append((block.as_py(), unpack_sorted(grams.as_py()), unpack(counts.as_py(), np.int64)))
        if rows:
            yield from work(key[0], rows)

    together = dealt(requests, buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket", "block")
    return together.mapInArrow(run, schema)


ANSWER = "block int, kind int, grams binary, answers binary"


def answer_batches(kind: int, rows: list, values: np.ndarray, at: np.ndarray):
    """Answers to the requests of a bucket; `at` leads from the requested grams to `values`."""
    start = 0
    for block, grams, _ in rows:
        mine = values[at[start : start + len(grams)]].astype(np.float64)
        start += len(grams)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([kind], pa.int32()),
             pa.array([pack_sorted(grams)], pa.binary()), pa.array([pack(mine)], pa.binary())],
            names=["block", "kind", "grams", "answers"],
        )


def whole_bucket(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams, summed counts, position of every requested gram)"""
    grams = np.concatenate([g for _, g, _ in rows])
    counts = np.concatenate([c for _, _, c in rows])
    found, at = np.unique(grams, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64), at


class Answers:
    """Looks up the value of grams, all of them asked for, in the answers that a block has got.

    Grams are ordered by a hash and found from where their hash's first bits begin: with
    two such places a gram, one or two looks, where a search by halves takes twenty.
    """

    def __init__(self, parts: list[tuple[bytes, bytes]]):
        if parts:
            grams = np.concatenate([unpack_sorted(g) for g, _ in parts])
            values = np.concatenate([unpack(v, np.float64) for _, v in parts])
            bits = max(1, int(2 * len(grams)).bit_length())
            self.shift = np.uint64(64 - bits)
            home = self._home(grams)
            order = np.argsort(home)
            self.grams, self.values = grams[order], values[order]
            count = np.bincount(home, minlength=1 << bits)
            self.begins = (np.cumsum(count) - count).astype(np.int32)

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return (mix(grams.astype(np.uint64)) >> self.shift).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self.begins[self._home(grams)]
        left = np.flatnonzero(self.grams[at] != grams)
        while len(left):
            at[left] += 1
            left = left[self.grams[at[left]] != grams[left]]
        return self.values[at]


def block_rows(docs: DataFrame, answers: DataFrame, buckets: int, score: Callable, schema) -> DataFrame:
    """score(batch, {kind: Answers}) -> record batch, for all documents (with _block)."""

    def packets(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            own = batch.column("_block").to_numpy()
            size = batch.nbytes // max(1, len(own))
            step = max(1, PAYLOAD_BYTES // max(1, size))
            cuts = sorted({0, len(own), *(np.flatnonzero(np.diff(own)) + 1).tolist(), *range(0, len(own), step)})
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                sink = pa.BufferOutputStream()
                part = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([c]) for c in batch.slice(lo, hi - lo).columns], schema=batch.schema
                )
                with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                    stream.write_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(own[lo])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    names=["block", "payload"],
                )

    def run(batches):
        block, parts, found = None, {}, None
        for batch in batches:
            for own, kind, grams, values, payload in zip(
                *(batch.column(c) for c in ("block", "kind", "grams", "answers", "payload"))
            ):
                if own.as_py() != block:
                    block, parts, found = own.as_py(), {}, None
                if payload.is_valid:
                    if found is None:
                        found = {k: Answers(v) for k, v in parts.items()}
                        parts = {}
                    for rows in pa.ipc.open_stream(payload.as_buffer()):
                        yield score(rows, found)
                else:
                    parts.setdefault(kind.as_py(), []).append((grams.as_py(), values.as_py()))

    carried = docs.mapInArrow(packets, "block int, payload binary")
    met = answers.withColumn("payload", F.lit(None).cast("binary")).unionByName(
        carried.withColumns({"kind": F.lit(None).cast("int"), "grams": F.lit(None).cast("binary"),
                             "answers": F.lit(None).cast("binary")})
    )
    # answers of a block first: their payload is null
    together = dealt(met, buckets, "block").sortWithinPartitions("block", F.col("payload").isNotNull())
    return together.mapInArrow(run, schema)
