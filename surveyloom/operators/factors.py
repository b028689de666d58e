"""Factorisation machines for many settings and folds, trained in one pass over the rows.

A row is a short list of token numbers. Its score is a constant, a weight per token and
the inner products of the tokens' factors, so how values go together is learnt, not
hashed. The link depends on the task: logistic for classes, a straight line for
continuous targets, cumulative logits for ordered answers.

All models, one per setting and fold, see the same scans: the rows are stored in `PARTS`
parts, a step reads one part and sums up every model's gradient over the rows outside
its fold, and models with larger batches take a step after several parts. The number of
scans is that of the longest training, whatever the number of settings and folds.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.functions.hashing import digest
from surveyloom.operators.metrics import metrics_for
from surveyloom.sources.scratch import materialise, scratch_path

register_pickle_by_value(sys.modules[__name__])  # tasks need no installed copy of the model
PARTS = 8  # parts of the rows; the smallest batch is one part
RATE_SCALE = 100  # the study's rates are for fine-tuning; a new model of few weights needs larger steps
ROWS = 1 << 12  # rows at a time, so that the sums of all models stay in the caches
BLOCK = 1 << 16  # weights of a model that are summed by one task
MOST_WEIGHTS = 1 << 26  # weights of all models that a step sends to the tasks
SMALLEST_BATCH = min(fv.SEARCH_CHOICES["per_device_train_batch_size"])
CLASS, CONTINUOUS, ORDERED = "class", "continuous", "sequence"


@dataclass(frozen=True)
class FactorParams:
    """One setting. Batch size counts against the smallest offered, which is one part of the
    rows; warm-up counts parts; the rate rises evenly over it and then stays.
    """

    num_epochs: int = fv.TRAINING_DEFAULTS["num_epochs"]
    learning_rate: float = fv.TRAINING_DEFAULTS["learning_rate"]
    batch_size: int = fv.TRAINING_DEFAULTS["batch_size"]
    warmup_steps: int = 0
    weight_decay: float = fv.DEFAULT_WEIGHT_DECAY
    factors: int = 8
    task_type: str = CLASS
    levels: int = 2  # of an ordered answer, numbered from 0
    positive: int = 1  # the class that is told from all others
    seed: int = 42

    @property
    def parts_per_step(self) -> int:
        return max(1, min(PARTS, self.batch_size // SMALLEST_BATCH))

    @property
    def ticks(self) -> int:
        return self.num_epochs * PARTS

    def rate(self, tick: int) -> float:
        return self.learning_rate * RATE_SCALE * min(1.0, (tick + 1) / max(1, self.warmup_steps))


@dataclass
class FactorModel:
    """A setting, the fold it has not seen, and its weights: cuts or constant, weights, factors."""

    params: FactorParams
    size: int
    fold: int | None = None
    mean: float = 0.0
    spread: float = 1.0
    weights: np.ndarray | None = None

    @property
    def heads(self) -> int:
        return self.params.levels - 1 if self.params.task_type == ORDERED else 1

    def fresh(self) -> np.ndarray:
        rng = np.random.default_rng(self.params.seed)
        start = np.zeros(self.heads)
        if self.params.task_type == ORDERED:
            start[0] = -1.0  # the first cut, then logarithms of the steps to the next ones
        factors = rng.normal(0, 0.1, (self.size + 1, self.params.factors))
        factors[-1] = 0
        return np.concatenate([start, np.zeros(self.size + 1), factors.ravel()])

    def split(self, weights: np.ndarray):
        h, n = self.heads, self.size + 1
        return weights[:h], weights[h : h + n], weights[h + n :].reshape(n, self.params.factors)

    def raw(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score without head, factors of the tokens, their sum); the last number stands for unknown tokens."""
        _, linear, factors = self.split(self.weights)
        v = factors[numbers]
        total = v.sum(1)
        return linear[numbers].sum(1) + 0.5 * ((total**2).sum(1) - (v**2).sum((1, 2))), v, total

    def cuts(self) -> np.ndarray:
        head = self.weights[: self.heads]
        return np.concatenate([[-np.inf], head[0] + np.concatenate([[0.0], np.cumsum(np.exp(head[1:]))]), [np.inf]])

    def by_score(self, z: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The loss's derivative by each row's score without head, and its sum over rows by the head."""
        head = self.weights[: self.heads]
        if self.params.task_type == ORDERED:
            edges = self.cuts()
            k = label.astype(np.int64)
            above, below = (_logistic(edges[k + e] - z) for e in (1, 0))
            inside = np.maximum(above - below, 1e-12)
            by_cut = np.zeros(self.params.levels + 1)
            np.add.at(by_cut, k + 1, -above * (1 - above) / inside)
            np.add.at(by_cut, k, below * (1 - below) / inside)
            by_cut = by_cut[1:-1]
            later = np.cumsum(by_cut[::-1])[::-1]  # a step moves all cuts from there on
            # the derivative of -log(above - below) by the score
            return 1 - above - below, np.concatenate([later[:1], later[1:] * np.exp(head[1:])])
        guess = z + head[0]
        if self.params.task_type == CLASS:
            g = _logistic(guess) - (label == self.params.positive)
        else:
            g = guess - (label - self.mean) / self.spread
        return g, np.array([g.sum()])

    def gradient(self, numbers: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The sum over rows of the loss's derivative by each weight."""
        return gradients([self], numbers, label)[0]

    def answer(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, prediction): for classes the probability of 1 and the class, else the estimate twice."""
        z, _, _ = self.raw(numbers)
        if self.params.task_type == CLASS:
            p = _logistic(z + self.weights[0])
            return p, (p > 0.5).astype(float)
        if self.params.task_type == CONTINUOUS:
            value = (z + self.weights[0]) * self.spread + self.mean
            return value, value
        reached = _logistic(self.cuts()[None, :] - z[:, None])
        return reached[:, 1:-1].sum(1) * -1 + self.params.levels - 1, np.argmax(np.diff(reached, axis=1), 1).astype(float)


def gradients(models: list[FactorModel], numbers: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Each model's gradient; the weights of all lie side by side, so a token is looked up and summed once for all."""
    parts = [m.split(m.weights) for m in models]
    widths = [factors.shape[1] for _, _, factors in parts]
    ends = np.cumsum(widths)
    each = [slice(end - width, end) for end, width in zip(ends, widths)]
    factors = np.concatenate([f for _, _, f in parts], axis=1)
    n, wide = factors.shape
    # half the squares of a token's own factors go with its weight
    own = np.stack([linear - 0.5 * (f**2).sum(1) for _, linear, f in parts], axis=1)
    table = np.concatenate([factors, own], axis=1)
    found = np.zeros((len(numbers), table.shape[1]))
    for column in numbers.T:
        found += table[column]
    heads = []
    for i, (model, place) in enumerate(zip(models, each)):
        z = found[:, wide + i] + 0.5 * (found[:, place] ** 2).sum(1)
        g, head = model.by_score(z, label)
        found[:, place] *= g[:, None]
        found[:, wide + i] = g
        heads.append(head)
    summed = np.zeros_like(table)
    short = np.uint16 if n <= 1 << 16 else np.int64  # short numbers are sorted by counting
    for column in numbers.T if len(numbers) else []:
        order = np.argsort(column.astype(short), kind="stable")
        ordered = column[order]
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        summed[ordered[begins]] += np.add.reduceat(found[order], begins, axis=0)
    summed[-1] = 0  # unknown tokens
    done = []
    for i, (head, place) in enumerate(zip(heads, each)):
        linear = summed[:, wide + i]
        done.append(np.concatenate([head, linear, (summed[:, place] - factors[:, place] * linear[:, None]).ravel()]))
    return done


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    """A line of token numbers per row; all rows have as many tokens. Unknown ones get the number `size`."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    lines = values.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)
    return np.where((lines >= 0) & (lines < size), lines, size)


def stored_parts(rows: DataFrame, keys: list[str], label: str, fold_col: str | None = None) -> str:
    """Write (numbers, label, fold) in PARTS parts by the keys' digest; the path."""
    path = scratch_path(rows.sparkSession, "parts")
    part = F.conv(F.substring(digest("part", *keys), 1, 8), 16, 10).cast("bigint") % PARTS
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(-1)
    rows.select("numbers", F.col(label).cast("double").alias("label"), fold.alias("fold"), part.cast("int").alias("part")).where(
        "label is not null"
    ).write.partitionBy("part").parquet(path)
    return path


def part_gradients(part: DataFrame, models: list[tuple[int, FactorModel]]) -> DataFrame:
    """(model, block, seen, gradient): sums over the rows of `part` outside each model's fold, in one scan."""
    sent = part.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        sums = [[0, 0.0] for _ in sent.value]
        alike: dict = {}  # models that see the same rows
        for place, (_, model) in enumerate(sent.value):
            alike.setdefault((model.fold, model.size), []).append(place)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                label, fold = rows.column("label").to_numpy(), rows.column("fold").to_numpy()
                for (left_out, size), places in alike.items():
                    mine = fold != left_out if left_out is not None else np.ones(len(fold), bool)
                    if not mine.any():
                        continue
                    numbers = _numbers(rows.column("numbers"), size)[mine]
                    found = gradients([sent.value[p][1] for p in places], numbers, label[mine])
                    for p, gradient in zip(places, found):
                        sums[p][0] += len(numbers)
                        sums[p][1] = sums[p][1] + gradient
        for (seen, total), (number, _) in zip(sums, sent.value):
            if seen:
                yield _blocks(number, seen, total)

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for model, block, seen, data in zip(*(c.to_pylist() for c in batch.columns)):
                held = sums.setdefault((model, block), [0, 0.0])
                held[0] += seen
                held[1] = held[1] + np.frombuffer(data)
        for (model, block), (seen, total) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([model], pa.int32()), pa.array([block], pa.int32()), pa.array([seen], pa.int64()), pa.array([total.tobytes()])],
                names=["model", "block", "seen", "gradient"],
            )

    schema = "model int, block int, seen bigint, gradient binary"
    return part.mapInArrow(run, schema).repartition("model", "block").mapInArrow(add, schema)


def _blocks(number: int, seen: int, total: np.ndarray) -> pa.RecordBatch:
    pieces = [total[lo : lo + BLOCK].tobytes() for lo in range(0, len(total), BLOCK)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()),
            pa.array([seen] * len(pieces), pa.int64()), pa.array(pieces),
        ],
        names=["model", "block", "seen", "gradient"],
    )


def train_factors(
    rows: DataFrame, keys: list[str], size: int, models: list[tuple[FactorParams, int | None]],
    label: str = "labels", fold_col: str = "fold",
) -> list[FactorModel]:
    """A model for each (setting, fold left out); `rows` hold `numbers` below `size`, the label and the fold.

    A step is an Adam step on the mean gradient of its batch, with decoupled weight decay.
    A continuous label is standardised by the mean and spread of the rows a model sees.
    """
    spark = rows.sparkSession
    fitted = [FactorModel(params, size, fold) for params, fold in models]
    for model in fitted:
        model.weights = model.fresh()
    if sum(len(m.weights) for m in fitted) > MOST_WEIGHTS:
        raise ValueError("too many weights: leave out rare tokens by min_rows, or train fewer models at a time")
    folded = any(m.fold is not None for m in fitted)
    path = stored_parts(rows, keys, label, fold_col if folded else None)
    if any(m.params.task_type == CONTINUOUS for m in fitted):
        _standardise(spark.read.parquet(path), fitted)
    first = [np.zeros_like(m.weights) for m in fitted]
    second = [np.zeros_like(m.weights) for m in fitted]
    batch = [[0, np.zeros_like(m.weights), 0] for m in fitted]
    steps = [0] * len(fitted)
    schema = "numbers array<int>, label double, fold int, part int"
    stored = spark.read.schema(schema).parquet(path)  # its files are listed once
    for tick in range(max(m.params.ticks for m in fitted)):
        active = [(i, m) for i, m in enumerate(fitted) if tick < m.params.ticks]
        part = stored.where(F.col("part") == tick % PARTS)
        for row in part_gradients(part, active).collect():  # a line per model and block of weights
            held, lo = batch[row["model"]], row["block"] * BLOCK
            gradient = np.frombuffer(row["gradient"])
            held[1][lo : lo + len(gradient)] += gradient
            held[0] += row["seen"] if row["block"] == 0 else 0
        for i, model in active:
            batch[i][2] += 1
            if batch[i][2] < model.params.parts_per_step and tick + 1 < model.params.ticks:
                continue
            seen, total, _ = batch[i]
            batch[i] = [0, np.zeros_like(total), 0]
            if not seen:
                continue
            steps[i] += 1
            mean = total / seen
            first[i] = 0.9 * first[i] + 0.1 * mean
            second[i] = 0.999 * second[i] + 0.001 * mean**2
            moved = first[i] / (1 - 0.9 ** steps[i]) / (np.sqrt(second[i] / (1 - 0.999 ** steps[i])) + 1e-8)
            decay = model.params.weight_decay * model.weights
            decay[: model.heads] = 0
            model.weights = model.weights - model.params.rate(tick) * (moved + decay)
    return fitted


def _standardise(parts: DataFrame, models: list[FactorModel]) -> None:
    """Mean and spread of the labels outside each model's fold, from one line per fold."""
    value = F.col("label")
    lines = parts.groupBy("fold").agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("q")).collect()
    for model in models:
        if model.params.task_type == CONTINUOUS:
            seen = [r for r in lines if r["fold"] != model.fold]
            n, s, q = (sum(r[c] for r in seen) for c in "nsq")
            model.mean = s / n if n else 0.0
            model.spread = float(np.sqrt(max(q / n - model.mean**2, 0.0)) or 1.0) if n else 1.0


def score_factors(rows: DataFrame, model: FactorModel) -> DataFrame:
    """`rows`, without `numbers`, with `plausibility` and `prediction`.

    Classes get a whole number as prediction; other tasks a list of one element, the
    estimate or, for ordered answers, the most probable one.
    """
    return _scored(rows, [model], None)


def score_held_out(rows: DataFrame, models: list[FactorModel], fold_col: str = "fold") -> DataFrame:
    """Every row scored by each model that has not seen its fold, in one scan; `model` tells which."""
    return _scored(rows, models, fold_col)


def _scored(rows: DataFrame, models: list[FactorModel], fold_col: str | None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(models)
    is_class = models[0].params.task_type == CLASS
    others = [c for c in rows.columns if c != "numbers"]

    def run(batches):
        for batch in batches:
            fold = batch.column(fold_col).to_numpy(zero_copy_only=False) if fold_col else None
            for number, model in enumerate(sent.value):
                mine = np.arange(batch.num_rows) if fold is None else np.flatnonzero(fold == model.fold)
                if not len(mine):
                    continue
                part = batch.take(pa.array(mine))
                score, guess = model.answer(_numbers(part.column("numbers"), model.size))
                if is_class:
                    prediction = pa.array(guess.astype(np.int32))
                else:
                    prediction = pa.ListArray.from_arrays(pa.array(np.arange(len(guess) + 1, dtype=np.int32)), pa.array(guess))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array(np.full(len(mine), number, np.int32)), pa.array(score), prediction],
                    names=[*others, "model", "plausibility", "prediction"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "numbers")
    kind = "int" if is_class else "array<double>"
    scored = rows.mapInArrow(run, f"{fields}, model int, plausibility double, prediction {kind}")
    return scored if fold_col else scored.drop("model")


def cross_validate_factors(
    rows: DataFrame, keys: list[str], size: int, settings: list[FactorParams], folds: list[int],
    label: str = "labels", fold_col: str = "fold",
) -> DataFrame:
    """(setting, fold, test_rows, metrics by task): every setting on every listed fold, trained side by side in the same scans."""
    models = train_factors(rows, keys, size, [(s, f) for s in settings for f in folds], label, fold_col)
    scored = score_held_out(rows.select("numbers", label, fold_col).where(F.col(fold_col).isin(folds)), models, fold_col)
    scored = materialise(scored.withColumn("setting", F.floor(F.col("model") / len(folds)).cast("int")), "held_out")
    by = ["setting", fold_col]
    truth = F.col(label)
    larger = F.max("n") / F.sum("n")
    sizes = scored.groupBy(*by, truth.alias("_truth")).agg(F.count("*").alias("n")).groupBy(*by).agg(
        F.sum("n").alias("test_rows"), larger.alias("majority_rate")
    )
    return sizes.join(metrics_for(scored, label, "prediction", settings[0].task_type, by), by)


def search_factors(
    rows: DataFrame, keys: list[str], size: int, settings: list[FactorParams], folds: list[int],
    label: str = "labels", fold_col: str = "fold",
) -> tuple[FactorParams, DataFrame]:
    """The setting with the best mean over the folds (accuracy, or for other tasks the error), and all settings' means."""
    result = materialise(cross_validate_factors(rows, keys, size, settings, folds, label, fold_col), "tried")
    names = [c for c in result.columns if c not in ("setting", fold_col, "test_rows")]
    means = materialise(result.groupBy("setting").agg(*(F.avg(c).alias(c) for c in names)), "settings")
    order = F.desc("accuracy") if settings[0].task_type == CLASS else F.asc("rmse")
    return settings[means.orderBy(order, "setting").first()["setting"]], means


def drawn_settings(drawn: DataFrame, base: FactorParams) -> list[FactorParams]:
    """The settings of a table of drawn parameters, in the order of its trials: all five are used."""
    return [
        replace(
            base, num_epochs=r["num_train_epochs"], weight_decay=r["weight_decay"], learning_rate=r["learning_rate"],
            batch_size=r["per_device_train_batch_size"], warmup_steps=r["warmup_steps"],
        )
        for r in drawn.orderBy("trial").collect()
    ]
