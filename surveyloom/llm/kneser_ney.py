"""Interpolated modified Kneser-Ney estimates over bytes, by arrays.

A gram is a whole number: DEPTH context bytes, oldest first, then the next byte. The
longest grams have their counts; a shorter one counts the distinct bytes seen before
it. Each order has three discounts, from how many of its grams occur once to four
times. All grams that share their newest two context bytes are worked on together;
the orders below that are tables of at most 65,536 numbers.
"""

from __future__ import annotations

import numpy as np

DEPTH = 4
LOCAL = 2


class Order:
    """Grams with `depth` context bytes: counts, and what their contexts add up to."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.contexts, at = np.unique(keys >> 8, return_inverse=True)
        size = len(self.contexts)
        self.total = np.bincount(at, counts, size)
        self.kinds = [
            np.bincount(at, chosen, size) for chosen in (counts == 1, counts == 2, counts >= 3)
        ]

    def shorter(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Grams of `depth` context bytes, each with the number of its longer ones."""
        context = (self.keys >> 8) & ((1 << 8 * depth) - 1)
        return np.unique(context << 8 | self.keys & 255, return_counts=True)

    def rarity(self) -> np.ndarray:
        """How many grams occur 1, 2, 3 and 4 times."""
        return np.array([(self.counts == n).sum() for n in range(1, 5)], dtype=float)


def local_orders(grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> list[Order]:
    """Orders from LOCAL to `depth` context bytes, longest last."""
    seen = counts > 0
    orders = [Order(grams[seen], counts[seen])]
    for shorter in range(depth - 1, LOCAL - 1, -1):
        orders.insert(0, Order(*orders[0].shorter(shorter)))
    return orders


def top_orders(keys: np.ndarray, counts: np.ndarray) -> list[Order]:
    """The orders with no and one context byte, from the summed counts of the latter."""
    one = Order(keys, counts)
    return [Order(*one.shorter(0)), one]


def discounts(rarity: np.ndarray) -> np.ndarray:
    """What is taken off counts of 1, 2 and more; plain defaults where too little is known."""
    plain = np.array([0.5, 0.75, 0.9])
    if (rarity <= 0).any():
        return plain
    y = rarity[0] / (rarity[0] + 2 * rarity[1])
    steps = np.arange(1, 4)
    return np.clip(steps - (steps + 1) * y * rarity[1:] / rarity[:-1], 0.05, steps - 0.05)


def log_chances(grams: np.ndarray, orders: list[Order], taken: list[np.ndarray]) -> np.ndarray:
    """ln P(next byte | context) of every gram; orders run from no context to the longest."""
    chance = np.full(len(grams), 1 / 256)
    for depth, (order, off) in enumerate(zip(orders, taken)):
        if not len(order.keys):
            continue
        context = (grams >> 8) & ((1 << 8 * depth) - 1)
        key = context << 8 | grams & 255
        at = np.minimum(np.searchsorted(order.keys, key), len(order.keys) - 1)
        count = np.where(order.keys[at] == key, order.counts[at], 0)
        where = np.minimum(np.searchsorted(order.contexts, context), len(order.contexts) - 1)
        known = order.contexts[where] == context
        total = order.total[where]
        rest = sum(d * kind[where] for d, kind in zip(off, order.kinds))
        own = count - np.concatenate([[0.0], off])[np.minimum(count, 3).astype(int)]
        chance = np.where(known, (own + rest * chance) / total, chance)
    return np.log(chance)
