"""Context-tree weighting over bytes, by arrays.

A byte is eight binary decisions; decision j (1 to 255, numbered like a heap by the
bits already known) has a tree over the preceding bytes, newest first. Every node of
it counts zeros and ones, estimates by Krichevsky and Trofimov, and is mixed half and
half with its children:

    P_w(s) = (P_kt(s) + prod P_w(children of s)) / 2,     P_w = P_kt at full depth.

From the counts of a training text follows the chance of the next bit: going down the
path of contexts, a node's own estimate gets the share that its P_kt has in 2 P_w, the
rest goes deeper. Below a node never visited the chance is one half.

A gram is a whole number: DEPTH context bytes, oldest first, then the next byte. All
contexts that share their newest two bytes are worked on together; what lies above,
depth 0 and 1, are at most 65,280 nodes for all data.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
LOCAL = 2  # newest bytes that name a shard


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series after eight steps of recursion."""
    product = np.ones_like(x)
    for k in range(8):
        product *= np.where(x < 8, x + k, 1.0)
    y = np.where(x < 8, x + 8, x)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, at = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(at, v, len(found)) for v in values)


def node_key(grams: np.ndarray, depth: int, level: int) -> np.ndarray:
    """The node of decision `level` (0 to 7) in the context of the newest `depth` bytes."""
    context = (grams >> 8) & ((1 << 8 * depth) - 1)
    return context << 8 | 1 << level | (grams & 255) >> (8 - level)


class Level:
    """The visited nodes of one depth: key, counts and the log of own against children's product."""

    def __init__(self, keys, zeros, ones, children=None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = log_kt(zeros, ones)
        if children is None:
            self.share, self.log_weighted = np.ones(len(keys)), own
        else:
            self.share = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))
            self.log_weighted = np.logaddexp(own, children) - np.log(2)

    def parents(self, depth: int):
        """(keys, zeros, ones, children's product) of the level above, which has `depth` bytes."""
        context = (self.keys >> 8) & ((1 << 8 * depth) - 1)
        return _summed(context << 8 | self.keys & 255, self.zeros, self.ones, self.log_weighted)


def local_levels(grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> list[Level]:
    """Levels from LOCAL to `depth` of the training grams, deepest last."""
    seen = counts > 0
    grams, counts = grams[seen], counts[seen].astype(float)
    keys = np.concatenate([node_key(grams, depth, k) for k in range(8)])
    bits = np.concatenate([grams >> (7 - k) & 1 for k in range(8)])
    weight = np.tile(counts, 8)
    levels = [Level(*_summed(keys, weight * (1 - bits), weight * bits))]
    for above in range(depth - 1, LOCAL - 1, -1):
        levels.insert(0, Level(*levels[0].parents(above)))
    return levels


def top_levels(keys, zeros, ones, children) -> list[Level]:
    """Depth 0 and 1, from the summed nodes of depth 1."""
    one = Level(keys, zeros, ones, children)
    return [Level(*one.parents(0)), one]


def log_chances(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """ln P(next byte | context) of every gram; levels run from depth 0 to the deepest."""
    total = np.zeros(len(grams))
    for k in range(8):
        bit = (grams >> (7 - k) & 1).astype(bool)
        chance, rest = np.zeros(len(grams)), np.ones(len(grams))
        for depth, level in enumerate(levels):
            if len(level.keys):
                key = node_key(grams, depth, k)
                at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
                known = level.keys[at] == key
                count = np.where(bit, level.ones[at], level.zeros[at])
                estimate = (count + 0.5) / (level.zeros[at] + level.ones[at] + 1)
                share = level.share[at] * rest
            else:
                known, estimate, share = np.zeros(len(grams), bool), 0.5, 0.0
            # a node never visited gives one half and ends the path
            chance += np.where(known, share * estimate, 0.5 * rest)
            rest = np.where(known, rest - share, 0.0)
        total += np.log(chance)
    return total


def text_grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of each text with its end (byte 255), and their number per text.

    Before a text there are bytes 255, which UTF-8 never contains.
    """
    count = np.diff(offsets) + 1
    x = np.full(count.sum(), 255, dtype=np.uint8)
    starts = np.cumsum(count) - count
    mask = np.ones(len(x), dtype=bool)
    mask[starts + count - 1] = False
    x[mask] = data
    wide = np.concatenate([np.full(depth, 255, np.int64), x.astype(np.int64)])
    grams = np.zeros(len(x), dtype=np.int64)
    for k in range(depth + 1):
        grams |= wide[depth - k : depth - k + len(x)] << (8 * k)
    for k in range(depth):  # the k-th byte of a text has k bytes before it
        at = (starts + k)[count > k]
        grams[at] |= ((1 << 8 * (depth - k)) - 1) << (8 * (k + 1))
    return grams, count
