"""64-bit hashes of the words of many texts at once.

Words are runs of bytes other than ASCII white space; A-Z count as a-z. A word's hash
is a polynomial over random byte values, taken as a difference of prefix sums, so a
batch of texts costs a few passes of array arithmetic and no loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, and 5 modulo 8: its powers repeat late
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _fold_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    return table


FOLD = _fold_table()
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column, without a copy; null rows must have been filled."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0], (offsets - offsets[:1]).astype(np.int64)


class WordHasher:
    """Hashes words in pieces of about PIECE bytes; a piece ends at white space or a text's end."""

    def __init__(self, fold: np.ndarray = FOLD):
        self.fold = fold  # byte -> byte; 32 stands between words
        self.grow(PIECE + 1)

    def grow(self, size: int):
        powers = np.full(size, _BASE, dtype=np.uint64)
        powers[0] = 1
        self.power = np.cumprod(powers)
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse)

    def _piece(self, x: np.ndarray, starts_text: np.ndarray):
        """(start, hash) of each word in folded bytes; starts_text marks first bytes of texts."""
        if len(x) >= len(self.power):
            self.grow(len(x) + 1)
        inside = x != 32
        fresh = np.ones(len(x), dtype=bool)
        fresh[1:] = ~inside[:-1]
        fresh[starts_text] = True
        begin = np.flatnonzero(inside & fresh)
        closed = np.ones(len(x), dtype=bool)
        closed[:-1] = fresh[1:] | ~inside[1:]
        end = np.flatnonzero(inside & closed) + 1
        sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[x] * self.power[: len(x)], out=sums[1:])
        return begin, mix((sums[end] - sums[begin]) * self.inverse[begin])

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Yield (first text, last text + 1, word hashes, words per text) in order.

        A very long text comes in several pieces, alone in each.
        """
        count = len(offsets) - 1
        at = 0
        while at < count:
            last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
            last = min(last, count)
            lo, hi = int(offsets[at]), int(offsets[last])
            if hi - lo <= PIECE or last > at + 1:
                x = self.fold[data[lo:hi]]
                bounds = offsets[at : last + 1] - lo
                yield at, last, *self._counted(x, bounds)
            else:
                while lo < hi:
                    stop = min(hi, lo + PIECE)
                    x = self.fold[data[lo:stop]]
                    if stop < hi:
                        blanks = np.flatnonzero(x == 32)
                        while not len(blanks) and stop < hi:  # one word beyond a piece
                            stop = min(hi, stop + (stop - lo))
                            x = self.fold[data[lo:stop]]
                            blanks = np.flatnonzero(x == 32)
                        if stop < hi:
                            stop = lo + int(blanks[-1]) + 1
                            x = x[: stop - lo]
                    yield at, last, *self._counted(x, np.array([0, stop - lo]))
                    lo = stop
            at = last

    def _counted(self, x: np.ndarray, bounds: np.ndarray):
        firsts = bounds[:-1][bounds[:-1] < len(x)]
        begin, hashes = self._piece(x, firsts) if len(x) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        return hashes, np.diff(np.searchsorted(begin, bounds))

    def per_text(self, data: np.ndarray, offsets: np.ndarray):
        """Yield (first text, hashes, words per text); a text's words are whole here."""
        held: list[np.ndarray] = []
        open_text = None
        for first, last, hashes, counts in self.pieces(data, offsets):
            if open_text is not None and first != open_text:
                whole = np.concatenate(held)
                yield open_text, whole, np.array([len(whole)])
                held, open_text = [], None
            if last == first + 1 and offsets[last] - offsets[first] > PIECE:
                held.append(hashes)
                open_text = first
            else:
                yield first, hashes, counts
        if open_text is not None:
            whole = np.concatenate(held)
            yield open_text, whole, np.array([len(whole)])


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words within each text, and how many each text has.

    A text of fewer words has its whole sequence as the one shingle, none without words.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    number = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.repeat(starts - (np.cumsum(number) - number), number) + np.arange(number.sum())
    left = np.repeat(ends, number) - first
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    total = np.minimum(left, width).astype(np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        part = padded[first + k] * factors[k]
        total = total + np.where(left > k, part, np.uint64(0))
    return mix(total), number
