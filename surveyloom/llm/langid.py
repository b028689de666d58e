"""Language identification by multilingual mixtures.

Each language has letter trigram counts, hashed into `BUCKETS` bins, so a model of L
languages is a table of L x BUCKETS numbers whatever it was learnt from. A document's
words are drawn from a mixture of the languages (and of a noise source that knows no
trigram); expectation-maximisation on the words' trigram likelihoods estimates the
proportions. Which languages take part is chosen by penalised likelihood: languages
join in order of their share as long as the log-likelihood grows by more than the
penalty, half the logarithm of the number of words for each language, times
`PENALTY` since trigrams of a word overlap.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.llm.support import id_remainder
from surveyloom.llm.wordhash import mix

BUCKETS = 1 << 16
SMOOTHING = 0.1
PENALTY = 3.0
EM_STEPS = 8
PIECE = 1 << 20
GROUP_WORDS = 1 << 17
MAX_LANGUAGES = 1000  # a model is at most this many tables of BUCKETS 4-byte numbers
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For every code point 2 if it is a letter, 1 if it is a mark, which may stand on one, else 0."""
    rank = {"L": 2, "M": 1}
    return np.array([rank.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], dtype=np.uint8)


def in_words(kinds: np.ndarray) -> np.ndarray:
    """Which characters belong to words: runs of letters and marks with a letter among them."""
    inside = kinds > 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return inside
    lettered = np.maximum.reduceat(kinds, starts) == 2
    if not lettered.all():
        inside[starts[0] :] &= np.repeat(lettered, np.diff(np.append(starts, len(kinds))))
    return inside


class Trigrams:
    """Trigram bins of texts; a trigram is a letter with its neighbours, 0 outside the word."""

    def __init__(self):
        self.letters = letter_table()

    def piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin of every letter, index of the first letter of every word, words per text)"""
        lowered = [text.lower() for text in texts]
        joined = " ".join(["", *lowered, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        inside = in_words(self.letters[codes])
        padded = np.where(inside, codes, 0).astype(np.uint64)
        at = np.flatnonzero(inside)
        key = padded[at - 1] << np.uint64(42) | padded[at] << np.uint64(21) | padded[at + 1]
        starts = np.flatnonzero(padded[at - 1] == 0)
        ends = np.cumsum([len(text) + 1 for text in lowered])
        return (mix(key) >> np.uint64(48)).astype(np.int64), starts, np.diff(np.searchsorted(at[starts], ends), prepend=0)

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, last + 1, bins, word starts, words per text); a long text comes in several pieces."""
        at = 0
        while at < len(texts):
            last, size = at, 0
            while last < len(texts) and (last == at or size + len(texts[last]) <= PIECE):
                size += len(texts[last]) + 1
                last += 1
            text, begin = texts[at], 0
            if size <= 2 * PIECE:
                yield at, last, *self.piece(texts[at:last])
                begin = len(text)
            while begin < len(text):
                end = begin + PIECE
                if end < len(text):  # at a space, if there is one
                    end = text.rfind(" ", begin, end) + 1 or end
                yield at, last, *self.piece([text[begin:end]])
                begin = end
            at = last


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bin, n) over all rows (lang, text)."""

    def run(batches):
        grams = Trigrams()
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for column in _by_language(batch):
                lang, texts = column
                total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for _, _, bins, _, _ in grams.pieces(texts):
                    total += np.bincount(bins, minlength=BUCKETS)
        for lang, total in totals.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(total[found])], names=["lang", "bin", "n"]
            )

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, bin bigint, n bigint")
    return counted.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def _by_language(batch) -> Iterator[tuple[str, list[str]]]:
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        texts.setdefault(lang, []).append(text)
    yield from texts.items()


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each bin: BUCKETS x (languages + noise)).

    Learns from all rows that have a language and a text.
    """
    known = docs.where("lang is not null and text is not null")
    found = known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if found > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = trigram_counts(known).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    index = {name: i for i, name in enumerate(names)}
    counts = np.zeros((BUCKETS, len(names)))
    rows = np.array([index[name] for name in table.column("lang").to_pylist()], dtype=np.int64)
    counts[table.column("bin").to_numpy(), rows] = table.column("n").to_numpy()
    model = np.full((BUCKETS, len(names) + 1), -np.log(BUCKETS))
    model[:, :-1] = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * BUCKETS)
    return names, model.astype(np.float32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def mixtures(likelihood: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Shares (texts x sources) of the chosen sources; every text has at least one word."""
    texts, sources = len(words), likelihood.shape[1]
    starts = np.cumsum(words) - words
    top = likelihood.max(1, keepdims=True)
    relative = np.exp(likelihood - top)

    def steps(share: np.ndarray, rows: np.ndarray, at: np.ndarray, count: np.ndarray, n: int):
        """share after n rounds, and the log-likelihood beyond the common part"""
        for _ in range(n):
            part = rows * np.repeat(share, count, 0)
            part /= part.sum(1, keepdims=True)
            share = _sums(part, at) / count[:, None]
        fitted = (rows * np.repeat(share, count, 0)).sum(1)
        return share, _sums(np.log(np.maximum(fitted, 1e-30)), at)

    full = np.full((texts, sources), 1 / sources, dtype=np.float32)
    full, _ = steps(full, relative, starts, words, EM_STEPS)
    # the noise source may join, but a text's first source is a language
    order = np.argsort(-np.where(np.arange(sources) == sources - 1, full - 1, full), 1, kind="stable")
    order[:, 1:] = np.take_along_axis(
        order[:, 1:], np.argsort(-np.take_along_axis(full, order[:, 1:], 1), 1, kind="stable"), 1
    )
    chosen = np.zeros((texts, sources), dtype=np.float32)
    chosen[np.arange(texts), order[:, 0]] = 1
    single = np.take_along_axis(likelihood, np.repeat(order[:, :1], words, 0), 1) - top
    best = _sums(single[:, 0].astype(np.float64), starts)
    active = np.arange(texts)
    for size in range(2, sources + 1):
        count = words[active]
        inside = np.repeat(np.isin(np.arange(texts), active), words)
        at = np.cumsum(count) - count
        share = np.zeros((len(active), sources), dtype=np.float32)
        members = order[active, :size]
        np.put_along_axis(share, members, np.maximum(np.take_along_axis(full[active], members, 1), 1e-6), 1)
        share /= share.sum(1, keepdims=True)
        share, value = steps(share, relative[inside], at, count, 3)
        better = value - PENALTY * 0.5 * np.log(count + 1) > best[active]
        best[active[better]] = value[better]
        chosen[active[better]] = share[better]
        active = active[better]
        if not len(active):
            break
    return chosen


class Identifier:
    def __init__(self, names: list[str], model: np.ndarray):
        self.names, self.model, self.grams = names, model, Trigrams()

    def __call__(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, list, list]:
        """(language, score, noise share, languages, shares) of each text"""
        found = [UNKNOWN] * len(texts)
        score, noise = np.zeros(len(texts)), np.zeros(len(texts))
        langs, shares = [[] for _ in texts], [[] for _ in texts]
        if not self.names:
            return found, score, noise, langs, shares
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def settle():
            rows = [k for k, parts in held.items() if sum(map(len, parts))]
            if rows:
                likelihood = [np.concatenate(held[k]) for k in rows]
                words = np.array([len(x) for x in likelihood])
                likelihood = np.concatenate(likelihood)
                mix_of = mixtures(likelihood, words)
                total = _sums(likelihood[:, :-1].astype(np.float64), np.cumsum(words) - words)
                chance = np.exp(total - total.max(1, keepdims=True))
                chance /= chance.sum(1, keepdims=True)
                for i, k in enumerate(rows):
                    share = mix_of[i, :-1]
                    lead = int(share.argmax()) if share.any() else int(total[i].argmax())
                    others = max(float(share.sum()), 1e-9)
                    # how much of the text it is, and how sure that is where it stands alone
                    sure = float(chance[i, lead]) if (share > 0).sum() <= 1 else 1.0
                    found[k] = self.names[lead]
                    score[k] = min(1.0, float(share[lead]) / others * sure) if share.any() else 0.0
                    noise[k] = min(1.0, float(mix_of[i, -1]))
                    ranked = [j for j in np.argsort(-share, kind="stable") if share[j] > 0]
                    langs[k] = [self.names[j] for j in ranked]
                    shares[k] = [float(share[j]) for j in ranked]
            held.clear()

        for first, last, bins, starts, words in self.grams.pieces(texts):
            if size >= GROUP_WORDS and first not in held:
                settle()
                size = 0
            likelihood = _sums(self.model[bins], starts) if len(starts) else np.zeros((0, self.model.shape[1]), np.float32)
            ends = np.cumsum(words)
            for k in range(first, last):
                i = k - first
                held.setdefault(k, []).append(likelihood[ends[i] - words[i] : ends[i]])
            size += len(starts)
        settle()
        return found, score, noise, langs, shares


PREDICTION = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("noise", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType())),
    T.StructField("shares", T.ArrayType(T.DoubleType())),
])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """Every row of `docs` as struct `row`, with the prediction for its text beside it.

    * Null text, or one without letters: `und`, score 0. So is every text where
      nothing could be learnt.
    * score is the share of the predicted language among the languages found; where it
      is the only one, times its posterior against the others. noise is the share of
      words that no language explains. Ties go to the language that sorts first.
    * Long texts are read whole, piece by piece; all columns pass through unchanged.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        identifier = Identifier(*shipped.value)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            found, score, noise, langs, shares = identifier(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(found, pa.string()), pa.array(score), pa.array(noise),
                    pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())),
                ],
                names=["row", *PREDICTION.names],
            )

    kept = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, T.StructType([kept.schema["row"], *PREDICTION.fields]))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), 3) != 1)).select("lang", "text")


def language_mixtures(docs: DataFrame) -> DataFrame:
    """Predictions for all rows by a model learnt from the rows that are not held out."""
    kept = docs.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return identify(kept, fit(training_rows(docs))).select("row.doc_id", "row.held_out", *PREDICTION.names)
