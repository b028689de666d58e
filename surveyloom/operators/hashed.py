"""Hashed places of `column=value` tokens and their crosses, batch by batch.

A survey column has few values, so a batch turns the distinct values of a column, and
the distinct pairs of two columns, into text and hashes them once; its rows look their
places up. Hash and places are those of MLlib's HashingTF.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
MOST_KEPT = 1 << 20  # tokens a task remembers


def token_cells(columns: list[str]) -> list[Column]:
    """The cells as tokens spell them."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]


def crossings(n_features: int, n_targets: int, crosses: bool = True) -> list[tuple[int, ...]]:
    """Columns of each token: all single ones, then feature x target and target x target pairs."""
    n = n_features + n_targets
    single: list[tuple[int, ...]] = [(i,) for i in range(n)]
    if not crosses:
        return single
    mixed = [(f, t) for f in range(n_features) for t in range(n_features, n)]
    return single + mixed + [(t, u) for t in range(n_features, n) for u in range(t + 1, n)]


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def murmur3(texts: list[bytes], seed: int = SEED) -> np.ndarray:
    """32-bit Murmur3 hashes, as signed numbers."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = -(-int(lengths.max(initial=0)) // 4) * 4
    padded = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), "<u4").reshape(len(texts), width // 4)

    def mixed(k: np.ndarray) -> np.ndarray:
        return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    h = np.full(len(texts), seed, np.uint32)
    for j in range(width // 4):
        k = mixed(padded[:, j])
        whole = _rotated(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        # the padding is zeros, so the last word holds just the bytes that are left
        h = np.where(lengths >= 4 * j + 4, whole, np.where(lengths > 4 * j, h ^ k, h))
    h ^= lengths.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


class Places:
    """Looks up the places of tokens, remembering those of frequent ones."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def of(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        if new:
            if len(known) + len(new) > MOST_KEPT:
                known = self.known = {}
                new = list(dict.fromkeys(tokens))
            found = murmur3([t.encode() for t in new]).astype(np.int64) % self.size
            known.update(zip(new, found.tolist()))
        return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))


def tokens_in(columns: list[pa.Array], names: list[str], crossed: list[tuple[int, ...]]):
    """Per crossing: the distinct tokens of the batch, and each row's position among them."""
    coded = [c.dictionary_encode() for c in columns]
    codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
    texts = [[f"{name}={value}" for value in c.dictionary.to_pylist()] for name, c in zip(names, coded)]
    for crossing in crossed:
        if len(crossing) == 1:
            yield texts[crossing[0]], codes[crossing[0]]
            continue
        a, b = crossing
        many = max(1, len(texts[b]))
        pair = codes[a] * many + codes[b]
        possible = len(texts[a]) * many
        if possible <= 4 * len(pair) + 1024:
            seen = np.flatnonzero(np.bincount(pair, minlength=possible))
            place = np.zeros(possible, np.int64)
            place[seen] = np.arange(len(seen))
            position = place[pair]
        else:
            seen, position = np.unique(pair, return_inverse=True)
        yield [f"{texts[a][p // many]}&{texts[b][p % many]}" for p in seen.tolist()], position


def sparse_vectors(places: np.ndarray, size: int) -> pa.StructArray:
    """Vectors of ones at the places of each row, as MLlib stores them; equal places count once."""
    n, width = places.shape
    places = np.sort(places, axis=1)
    first = np.ones((n, width), bool)
    first[:, 1:] = places[:, 1:] != places[:, :-1]
    ends = np.concatenate([[0], np.cumsum(first.sum(1))]).astype(np.int32)
    indices = places[first].astype(np.int32)
    fields = [
        pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(indices)),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ones(len(indices)))),
    ]
    return pa.StructArray.from_arrays(fields, names=["type", "size", "indices", "values"])


def hashed_vector(features: list[str], targets: list[str], size: int, crosses: bool) -> Column:
    """The vector of a row's tokens."""
    names, crossed = [*features, *targets], crossings(len(features), len(targets), crosses)
    known: list[Places] = []

    def vectors(*columns: pa.Array) -> pa.Array:
        if not known:
            known.append(Places(size))
        places = np.empty((len(columns[0]), len(crossed)), np.int32)
        for j, (tokens, position) in enumerate(tokens_in(list(columns), names, crossed)):
            places[:, j] = known[0].of(tokens)[position]
        return sparse_vectors(places, size)

    return F.arrow_udf(vectors, VectorUDT())(*token_cells(names))


def distinct_tokens(rows: DataFrame, features: list[str], targets: list[str], crosses: bool) -> DataFrame:
    """(token) of all rows, each once."""
    names, crossed = [*features, *targets], crossings(len(features), len(targets), crosses)

    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            fresh: set[str] = set()
            for tokens, _ in tokens_in(batch.columns, names, crossed):
                fresh.update(tokens)
            if fresh := fresh - seen:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(fresh), pa.string())], names=["token"])
                seen = (seen if len(seen) < MOST_KEPT else set()) | fresh

    cells = [cell.alias(f"c{at}") for at, cell in enumerate(token_cells(names))]
    return rows.select(*cells).mapInArrow(run, "token string").distinct()
