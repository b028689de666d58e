"""Logistic regressions of several folds and penalties, trained in the same scans.

The model, its scaling and its optimiser are those of MLlib's binary
`LogisticRegression`: standardised and centred features, an L2 penalty on scaled weights,
L-BFGS with ten corrections and a search for strong Wolfe conditions. MLlib trains one model at
a time and keeps its rows in memory for it. Here the rows are written once, as blocks of
short numbers; a scan sums the gradients of all models that go on, each over the rows of the
folds it may see. Settings that differ in iterations only are one training, whose state is
noted at each of them.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.sources.scratch import scratch_path

CORRECTIONS = 10
TOLERANCE = 1e-6
NO_FOLD = -(1 << 31)
ROW_GROUP = 16 << 20  # bytes; what a task holds of a table of blocks
CHUNK = 1 << 16  # numbers of a gradient per line
SENT_TO_DRIVER = 32 << 20  # bytes of gradients that are added on the driver
DENSE_PLACES = 1 << 24
MOST_PADDING = 1.5  # places stored for one in use
AT_A_TIME = 1 << 14  # tokens
BLOCKS = "fold int, rows int, width int, places binary, owners binary, labels binary, weights binary"


def filled_places(name: str) -> Column:
    """The places of a vector column's values; of dense vectors, those that are not zero."""
    places, values = sparse_parts(name)
    return F.coalesce(F.unwrap_udt(name).getField("indices"), F.filter(places, lambda i: F.get(values, i) != 0))


def sparse_parts(name: str) -> tuple[Column, Column]:
    """(places, values) of a vector column, whether its vectors are sparse or dense."""
    plain = F.unwrap_udt(name)
    values = plain.getField("values")
    every = F.sequence(F.lit(0), F.size(values) - 1)
    empty = F.array().cast("array<int>")
    dense = F.when(F.size(values) > 0, every).otherwise(empty)
    return F.coalesce(plain.getField("indices"), dense), values


class Positions:
    """Place -> position among ``used``, -1 for others."""

    def __init__(self, used: np.ndarray, size: int):
        self.used, self.table = used, None
        if size <= DENSE_PLACES:
            self.table = np.full(size, -1, np.int32)
            self.table[used] = np.arange(len(used), dtype=np.int32)

    def of(self, places: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[places]
        at = np.minimum(np.searchsorted(self.used, places), len(self.used) - 1)
        return np.where(self.used[at] == places, at, -1)


def _row_block(places: np.ndarray, owners: np.ndarray, values: np.ndarray, lengths: np.ndarray, size: int, short) -> tuple:
    """(width, places, owners, weights) of the rows' tokens.

    Rows of about the same length are filled up with the place ``size``, which has no
    weight, and stored token by token, so that sums run along rows of memory. Others
    (width -1) name the row of each token.
    """
    width, plain = int(lengths.max()), bool((values == 1).all())
    if width * len(lengths) > MOST_PADDING * len(places):
        return -1, places.astype(short).tobytes(), owners.astype(np.int32).tobytes(), None if plain else values.tobytes()
    filled = np.full((len(lengths), width), size, short)
    there = np.arange(width) < lengths[:, None]
    filled[there] = places
    weights = None
    if not plain:
        weights = np.zeros(filled.shape)
        weights[there] = values
        weights = weights.T.tobytes()
    return width, filled.T.tobytes(), None, weights


def write_blocks(vectors: DataFrame, used: list[int], size: int, label: str, fold: Column) -> DataFrame:
    """Rows of one fold each as blocks of places in use; read again from the written table."""
    sent = np.array(used, np.int64)
    short = np.uint16 if len(used) < 1 << 16 else np.int32

    def run(batches):
        positions = Positions(sent, size)
        for batch in batches:
            folds = batch["fold"].fill_null(NO_FOLD).to_numpy(zero_copy_only=False)
            labels = batch["label"].to_numpy(zero_copy_only=False)
            lengths = batch["places"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            places = positions.of(batch["places"].flatten().to_numpy(zero_copy_only=False))
            values = batch["values"].flatten().to_numpy(zero_copy_only=False)
            owners = np.repeat(np.arange(len(folds)), lengths)
            known = (places >= 0) & (values != 0)
            if not known.all():
                places, values, owners = places[known], values[known], owners[known]
                lengths = np.bincount(owners, minlength=len(folds))
            lines = []
            for number in np.unique(folds):
                mine = folds == number
                chosen = mine[owners]
                numbered = np.cumsum(mine) - 1
                block = _row_block(places[chosen], numbered[owners[chosen]], values[chosen], lengths[mine], len(sent), short)
                lines.append((int(number), int(mine.sum()), *block[:3], labels[mine].astype(np.int8).tobytes(), block[3]))
            if lines:
                types = [pa.int32()] * 3 + [pa.binary()] * 4
                names = [f.split()[0] for f in BLOCKS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), types)], names=names)

    places, values = sparse_parts("features")
    rows = vectors.select(
        fold.cast("int").alias("fold"), F.col(label).cast("int").alias("label"), places.alias("places"), values.alias("values")
    )
    path = scratch_path(vectors.sparkSession, "blocks")
    rows.mapInArrow(run, BLOCKS).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return vectors.sparkSession.read.schema(BLOCKS).parquet(path)


@dataclass
class Block:
    fold: int
    rows: int
    width: int
    places: np.ndarray
    owners: np.ndarray | None
    labels: np.ndarray
    weights: np.ndarray | None

    def lines(self) -> Iterator[slice]:
        """The tokens some at a time, so that numbers in use stay near the processor."""
        step = max(1, AT_A_TIME // max(1, self.rows)) * self.rows
        return (slice(at, at + step) for at in range(0, len(self.places), step)) if step else iter(())

    def by_row(self, values: np.ndarray) -> np.ndarray:
        """Sum per row of a number per place; the place after the last stands for none."""
        values = np.append(values, 0.0)
        if self.width < 0:
            found = values[self.places]
            return np.bincount(self.owners, found if self.weights is None else found * self.weights, self.rows)
        total = np.zeros(self.rows)
        for some in self.lines():
            found = values.take(self.places[some], mode="clip")
            if self.weights is not None:
                found *= self.weights[some]
            total += found.reshape(-1, self.rows).sum(0)
        return total

    def by_place(self, values: np.ndarray, size: int, squared: bool = False) -> np.ndarray:
        """Sum per place of a number per row."""
        weights = self.weights if self.weights is None or not squared else self.weights**2
        if self.width < 0:
            spread = values[self.owners]
            return np.bincount(self.places, spread if weights is None else spread * weights, size + 1)[:size]
        total = np.zeros(size + 1)
        for some in self.lines():
            places = self.places[some]
            spread = np.tile(values, len(places) // self.rows)
            total += np.bincount(places, spread if weights is None else spread * weights[some], size + 1)
        return total[:size]


def _blocks_of(batches, size: int) -> Iterator[Block]:
    short = np.uint16 if size < 1 << 16 else np.int32
    for batch in batches:
        for r in batch.to_pylist():
            places = np.frombuffer(r["places"], short).astype(np.intp)
            owners = None if r["owners"] is None else np.frombuffer(r["owners"], np.int32)
            weights = None if r["weights"] is None else np.frombuffer(r["weights"], np.float64)
            labels = np.frombuffer(r["labels"], np.int8).astype(np.float64)
            yield Block(r["fold"], r["rows"], r["width"], places, owners, labels, weights)


def _lines(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for key, total in sums.items():
        for at in range(0, len(total), CHUNK):
            line = [pa.array([key], pa.int32()), pa.array([at], pa.int32()), pa.array([total[at : at + CHUNK].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(line, names=["key", "at", "sums"])


def _collected(blocks: DataFrame, run, keys: int, width: int, parts: int) -> dict[int, np.ndarray]:
    """The tasks' sums by key, added up; on the cluster first, where they are many."""
    lines = blocks.mapInArrow(run, "key int, at int, sums binary")
    if 8 * keys * width * parts > SENT_TO_DRIVER:

        def add(batches):
            totals: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    part, place = np.frombuffer(r["sums"]), (r["key"], r["at"])
                    totals[place] = totals[place] + part if place in totals else part
            for (key, at), total in totals.items():
                line = [pa.array([key], pa.int32()), pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(line, names=["key", "at", "sums"])

        lines = lines.repartition("key", "at").mapInArrow(add, "key int, at int, sums binary")
    totals: dict[int, np.ndarray] = {}
    # in a fixed order, as sums of doubles depend on it
    for r in sorted(lines.collect(), key=lambda r: (r.key, r.at, bytes(r.sums))):
        part = np.frombuffer(r.sums)
        totals.setdefault(r.key, np.zeros(width))[r.at : r.at + len(part)] += part
    return totals


def fold_moments(blocks: DataFrame, size: int, parts: int) -> dict[int, np.ndarray]:
    """Per fold: rows, rows of class 1, then the sum of each place and that of its squares."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for block in _blocks_of(batches, size):
            ones = np.ones(block.rows)
            each = [block.by_place(ones, size, squared) for squared in (False, True)]
            found = np.concatenate([[block.rows, block.labels.sum()], *each])
            sums[block.fold] = sums[block.fold] + found if block.fold in sums else found
        yield from _lines(sums)

    # the number of folds is that of the setting
    return _collected(blocks, run, 8, 2 * size + 2, parts)


def gradient_sums(blocks: DataFrame, models: list[tuple[int | None, np.ndarray, float]], size: int, parts: int) -> list[np.ndarray]:
    """Per (fold not seen, weights, constant): loss, sum of the residuals, then theirs by place, over the rows seen."""
    sent = blocks.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for block in _blocks_of(batches, size):
            for number, (unseen, weights, constant) in enumerate(sent.value):
                if unseen is not None and block.fold in (unseen, NO_FOLD):
                    continue
                margin = block.by_row(weights) + constant
                residual = 0.5 * (1 + np.tanh(0.5 * margin)) - block.labels
                loss = np.logaddexp(0, np.where(block.labels > 0, -margin, margin)).sum()
                total = sums.setdefault(number, np.zeros(size + 2))
                total[0] += loss
                total[1] += residual.sum()
                total[2:] += block.by_place(residual, size)
        yield from _lines(sums)

    try:
        found = _collected(blocks, run, len(models), size + 2, parts)
    finally:
        sent.unpersist()
    return [found[number] for number in range(len(models))]


class SearchFailed(Exception):
    pass


Asked = Generator[np.ndarray, tuple[float, np.ndarray], object]


def _between(left: tuple, right: tuple) -> float:
    """Step of the cubic through two points of the line, kept off the ends."""
    (lt, lvalue, lslope), (rt, rvalue, rslope) = left[:3], right[:3]
    d1 = lslope + rslope - 3 * (lvalue - rvalue) / (lt - rt)
    with np.errstate(invalid="ignore", divide="ignore"):
        d2 = np.sqrt(d1 * d1 - lslope * rslope)
        t = rt - (rt - lt) * (rslope + d2 - d1) / (rslope - lslope + 2 * d2)
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return low if t < low else high if t > high else float(t)


def _line_search(x: np.ndarray, direction: np.ndarray, value: float, grad: np.ndarray, t: float) -> Asked:
    """A point (t, value, slope, gradient) on the line that meets the strong Wolfe conditions."""

    def at(t: float) -> Asked:
        found, gradient = yield x + direction * t
        return t, found, float(gradient @ direction), gradient

    low = (0.0, value, float(grad @ direction), grad)
    slope = low[2]
    if slope > 0:
        raise SearchFailed("no descent")

    def too_high(c: tuple) -> bool:
        return c[1] > value + 1e-4 * c[0] * slope

    def zoom(low: tuple, high: tuple) -> Asked:
        for _ in range(10):
            c = yield from at(_between(high, low) if low[0] > high[0] else _between(low, high))
            if too_high(c) or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed("zoom")

    for i in range(10):
        c = yield from at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if too_high(c) or (c[1] >= low[1] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= 0.9 * abs(slope):
            return c
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low = c
        t *= 1.5
    raise SearchFailed("no end")


def _direction(grad: np.ndarray, steps: list[np.ndarray], gaps: list[np.ndarray]) -> np.ndarray:
    """Descent direction by the latest steps and changes of the gradient, newest first."""
    direction, scale = grad.copy(), 1.0
    if steps:
        along = float(steps[0] @ gaps[0])
        if along < 0 or np.isnan(along):
            raise SearchFailed("curvature")
        scale = along / float(gaps[0] @ gaps[0])
    rhos, shares = [], []
    for step, gap in zip(steps, gaps):
        rhos.append(float(step @ gap))
        shares.append(float(step @ direction) / rhos[-1])
        if np.isnan(shares[-1]):
            raise SearchFailed("curvature")
        direction -= shares[-1] * gap
    direction *= scale
    for step, gap, rho, share in reversed(list(zip(steps, gaps, rhos, shares))):
        direction += (share - float(gap @ direction) / rho) * step
    return -direction


def minimise(x: np.ndarray, stops: list[int]) -> Asked:
    """L-BFGS; asks for (value, gradient) at a point and returns {iterations: point} for all of ``stops``."""
    value, grad = yield x
    first, recent, last = value, [np.inf], max(stops)
    steps: list[np.ndarray] = []
    gaps: list[np.ndarray] = []
    iteration, failed, found = 0, False, {}
    while True:
        if iteration in stops:
            found.setdefault(iteration, x)
        flat = len(recent) >= 2 and abs(value - max(recent)) <= TOLERANCE * abs(first)
        if iteration >= last or flat or np.linalg.norm(grad) <= max(TOLERANCE * value, 1e-8):
            break
        try:
            with np.errstate(invalid="ignore", divide="ignore"):
                direction = _direction(grad, steps, gaps)
            start = 1.0 if iteration else 1.0 / np.linalg.norm(direction)
            t, newer, _, gradient = yield from _line_search(x, direction, value, grad, start)
            if t * np.linalg.norm(grad) < 1e-10:
                raise SearchFailed("step")
        except SearchFailed:
            if failed:
                break
            failed, steps, gaps = True, [], []
            continue
        point = x + direction * t
        steps, gaps = [point - x, *steps][:CORRECTIONS], [gradient - grad, *gaps][:CORRECTIONS]
        x, value, grad = point, newer, gradient
        recent = [*recent, value][-20:]
        iteration, failed = iteration + 1, False
    return {stop: found.get(stop, x) for stop in stops}


class Training:
    """One fold left out (or none) and one penalty."""

    def __init__(self, unseen: int | None, penalty: float, stops: list[int], moments: dict[int, np.ndarray], size: int):
        seen = [m for fold, m in sorted(moments.items()) if unseen is None or fold not in (unseen, NO_FOLD)]
        total = np.sum(seen, axis=0)
        self.unseen, self.penalty, self.rows = unseen, penalty, total[0]
        self.mean = total[2 : 2 + size] / self.rows
        squares = total[2 + size :] - self.rows * self.mean**2
        # what differs from none by rounding only is a constant place
        spread = np.where(squares > 1e-12 * total[2 + size :], squares, 0.0) / max(self.rows - 1, 1)
        self.scale = np.divide(1.0, np.sqrt(spread), out=np.zeros(size), where=spread > 0)
        start = np.zeros(size + 1)
        start[-1] = np.log(total[1] / (self.rows - total[1]))
        self.search = minimise(start, stops)
        self.point, self.found = next(self.search), None

    def model(self, point: np.ndarray) -> tuple[np.ndarray, float]:
        """(weights, constant) on the features as they are."""
        weights = point[:-1] * self.scale
        return weights, float(point[-1] - weights @ self.mean)

    def take(self, sums: np.ndarray) -> None:
        """Go on with the sums at ``point``: to the next point, or to the end."""
        scaled = self.point[:-1]
        value = sums[0] / self.rows + 0.5 * self.penalty * float(scaled @ scaled)
        own = (sums[2:] - sums[1] * self.mean) * self.scale / self.rows + self.penalty * scaled
        try:
            self.point = self.search.send((float(value), np.append(own, sums[1] / self.rows)))
        except StopIteration as end:
            self.found = end.value


def train_all(
    blocks: DataFrame, settings: list[tuple[int | None, float, int]], moments: dict[int, np.ndarray], size: int, parts: int
) -> list[tuple[np.ndarray, float]]:
    """(weights, constant) per (fold not seen, penalty, iterations)."""
    stops: dict[tuple[int | None, float], list[int]] = {}
    for unseen, penalty, iterations in settings:
        stops.setdefault((unseen, penalty), []).append(iterations)
    trainings = {key: Training(*key, ends, moments, size) for key, ends in stops.items()}
    while active := [t for t in trainings.values() if t.found is None]:
        asked = [(t.unseen, *t.model(t.point)) for t in active]
        for training, sums in zip(active, gradient_sums(blocks, asked, size, parts)):
            training.take(sums)
    done = []
    for unseen, penalty, iterations in settings:
        training = trainings[(unseen, penalty)]
        done.append(training.model(training.found[iterations]))
    return done
