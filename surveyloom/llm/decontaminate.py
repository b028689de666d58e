"""Benchmark passages in documents, up to a number of edited words.

Texts are sequences of words: case folded, without punctuation. The CGK random
walk embeds a word sequence so that few edits become few differing positions: step by
step it writes the word it stands on, and a random bit of that word and step decides
whether it moves on. Bits at a few positions of the embedding are a key; sequences that
agree in one of many keys are candidates, and an exact edit distance decides.

Items are grouped by length into classes [L, 2L), the last of them, MOST_LEAST, without
upper end. A document is read in windows of about L words, one every `stride` words; an
item is indexed from as many starts as the stride is long, at its beginning, at its end
and every half L words between, so that an unedited passage meets a window at one of
them wherever it lies, and some window of a long edited passage has few edits, however
long it is. `EMBEDDINGS` walks with `SAMPLES` keys each find a passage of 16 words or more
with a tenth of its words edited with probability above 0.98, with a fifth of them (the
default limit) above 0.9 at every length (measured in the tests).

The items travel to the tasks in blocks of at most `BLOCK_ITEM_BYTES`; a larger
benchmark takes several passes over the documents.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.llm.wordhash import WordHasher, column_bytes, mix

EMBEDDINGS, SAMPLES, POSITIONS = 4, 5, 5
MOST_LEAST = 16
BLOCK_ITEM_BYTES = 8 << 20
SEGMENT = 1 << 18
FILTER_BITS = 21
FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
LEAK = "array<struct<item_id: {kind}, edits: int, item_words: int, first_word: bigint>>"


def _letters() -> np.ndarray:
    """ASCII letters and digits and all bytes of other characters make words; A-Z count as a-z."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        table[b] = ord(chr(b).lower()) if chr(b).isalnum() else 32
    return table


LETTERS = _letters()
OTHER_MARKS = re.compile("[\u00a0-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f\uff00-\uff0f]")


def folded(text: str) -> bytes:
    text = text.casefold()
    if not text.isascii():
        text = OTHER_MARKS.sub(" ", text)
    return text.encode("utf-8", "replace")


def text_words(texts: list[str], hasher: WordHasher):
    """Yield (first text, word ids, words per text); 0 is no word's id."""
    column = pa.array([folded(t) for t in texts], pa.binary())
    for first, hashes, counts in hasher.per_text(*column_bytes(column)):
        yield first, np.maximum(hashes, np.uint64(1)), counts


class LengthClass:
    """Items of `least` to 2 * least - 1 words, or of MOST_LEAST and more, and the windows they are sought in."""

    def __init__(self, least: int):
        self.least = least
        self.stride = max(1, least // 4)
        self.window = least - self.stride + 1
        self.steps = 2 * self.window
        draw = np.random.default_rng(least)
        self.samples = [
            [np.sort(draw.choice(self.steps, min(POSITIONS, self.steps), replace=False)) for _ in range(SAMPLES)]
            for _ in range(EMBEDDINGS)
        ]

    def keys(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(EMBEDDINGS * SAMPLES, windows) keys of the windows at `starts`."""
        found = np.empty((EMBEDDINGS * SAMPLES, len(starts)), dtype=np.uint64)
        padded = np.concatenate([words, np.zeros(1, np.uint64)])
        for e, samples in enumerate(self.samples):
            at = starts.astype(np.int64)
            end = at + self.window
            total = [np.zeros(len(starts), np.uint64) for _ in samples]
            wanted = defaultdict(list)
            for k, positions in enumerate(samples):
                for n, step in enumerate(positions):
                    wanted[int(step)].append((k, n))
            for step in range(max(wanted) + 1):
                if step % 64 == 0:
                    bits = mix(padded ^ np.uint64((self.least << 20) + (e << 10) + step // 64 + 1))
                if step in wanted:
                    here = np.where(at < end, padded[np.minimum(at, end - 1)], np.uint64(0))
                    for k, n in wanted[step]:
                        total[k] += here * FACTORS[n]
                move = np.take(bits, at, mode="clip")
                move >>= np.uint64(step % 64)
                move &= np.uint64(1)
                at += move.view(np.int64)
            for k in range(len(samples)):
                found[e * SAMPLES + k] = mix(total[k] + np.uint64(e * SAMPLES + k + 1))
        return found

    def anchors(self, length: int) -> list[int]:
        last = length - self.window
        firsts = [*range(0, max(1, last - self.stride + 1), max(1, self.least // 2)), max(0, last - self.stride + 1)]
        return sorted({first + n for first in firsts for n in range(self.stride)})


class Index:
    """Keys of all items of a block."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = []
        classes: dict[int, list[int]] = defaultdict(list)
        hasher = WordHasher(LETTERS)
        for item_id, text in items:
            words = np.concatenate([w for _, w, _ in text_words([text or ""], hasher)] or [np.zeros(0, np.uint64)])
            if len(words):
                classes[min(MOST_LEAST, 1 << (len(words).bit_length() - 1))].append(len(self.items))
                places = defaultdict(int)
                for n, w in enumerate(words.tolist()):
                    places[w] |= 1 << n
                self.items.append((item_id, words, dict(places), int(rate * len(words))))
        self.classes = []
        for least, members in sorted(classes.items()):
            kind = LengthClass(least)
            keys, entry = [], []
            for i in members:
                words = self.items[i][1]
                anchors = np.array(kind.anchors(len(words)))
                keys.append(kind.keys(words, anchors).ravel())
                entry.append(np.tile(anchors << 32 | i, EMBEDDINGS * SAMPLES))
            keys, entry = np.concatenate(keys), np.concatenate(entry)
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
            maybe[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.classes.append((kind, keys[order], entry[order], maybe))

    def candidates(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(text, item, place of the item's first word) to be verified, in order, for texts in one array.

        The text is that of the window; the place may lie before it, where a passage lacks its first words.
        """
        found = []
        for kind, keys, entry, maybe in self.classes:
            count = np.maximum(0, (ends - starts - kind.window) // kind.stride + 1)
            first = np.repeat(starts - kind.stride * (np.cumsum(count) - count), count)
            windows = first + kind.stride * np.arange(len(first))
            texts = np.repeat(np.arange(len(count)), count)
            for lo in range(0, len(windows), 1 << 16):
                part, text = windows[lo : lo + (1 << 16)], texts[lo : lo + (1 << 16)]
                for row in kind.keys(words, part):
                    hits = np.flatnonzero(maybe[(row >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    left = np.searchsorted(keys, row[hits], side="left")
                    right = np.searchsorted(keys, row[hits], side="right")
                    n = right - left
                    if n.any():
                        at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        place = np.repeat(part[hits], n) - (entry[at] >> 32)
                        found.append(np.stack([np.repeat(text[hits], n), entry[at] & 0xFFFFFFFF, place], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def edits(self, item: int, text: list[int], most: int) -> tuple[int, int]:
        """(least edits, end) of the item against any stretch of `text`; bit-parallel, most + 1 if more."""
        _, words, places, _ = self.items[item]
        length = len(words)
        full, top = (1 << length) - 1, 1 << (length - 1)
        plus, minus, score = full, 0, length
        best, end = most + 1, 0
        for n, w in enumerate(text):
            match = places.get(w, 0)
            down = (((match & plus) + plus) ^ plus) | match | minus
            gain, loss = minus | (full & ~(down | plus)), plus & down
            score += bool(gain & top) - bool(loss & top)
            gain, loss = (gain << 1) & full, (loss << 1) & full
            vertical = match | minus
            plus, minus = loss | (full & ~(vertical | gain)), gain & vertical
            if score < best:
                best, end = score, n + 1
        return best, end

    def leaks(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(text, item, edits, first word) of every item found in each text."""
        spans: list[list[int]] = []
        for text, item, place in self.candidates(words, starts, ends).tolist():
            # windows of one passage point at places near each other
            if spans and spans[-1][:2] == [text, item] and place - spans[-1][2] <= len(self.items[item][1]):
                spans[-1][3] = place
            else:
                spans.append([text, item, place, place])
        for text, item, place, last in spans:
            length, most = len(self.items[item][1]), self.items[item][3]
            lo = max(int(starts[text]), place - most)
            segment = words[lo : min(int(ends[text]), last + length + most)].tolist()
            own = self.items[item][2]
            if sum(w in own for w in segment) < length - most:
                continue
            count, end = self.edits(item, segment, most)
            if count <= most:
                yield text, item, count, max(0, lo + end - length - int(starts[text]))


def find_leaks(texts: list[str], index: Index, hasher: WordHasher) -> list[list[tuple]]:
    """For each text (item_id, edits, item words, first word) of the items found in it."""
    found: list[dict] = [{} for _ in texts]
    longest = max((len(words) for _, words, _, _ in index.items), default=0)

    def search(first: int, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: int = 0):
        for n, item, count, place in index.leaks(words, starts, ends):
            item_id, wanted = index.items[item][:2]
            best = found[first + n].get(item)
            if best is None or (count, place + before) < (best[1], best[3]):
                found[first + n][item] = (item_id, count, len(wanted), place + before)

    for first, words, counts in text_words(texts, hasher):
        if len(counts) > 1 or len(words) <= SEGMENT:
            ends = np.cumsum(counts)
            search(first, words, ends - counts, ends)
        else:  # in parts that share more than an item's length
            for lo in range(0, len(words), SEGMENT):
                part = words[lo : lo + SEGMENT + 2 * longest]
                search(first, part, np.array([0]), np.array([len(part)]), lo)
    return [[f[k] for k in sorted(f)] for f in found]


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items with words, in blocks of about BLOCK_ITEM_BYTES."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // BLOCK_ITEM_BYTES)
    if count <= 1:
        return [items] if size else []
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)]


def with_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, text_col: str = "text") -> DataFrame:
    """Every row of `docs` as struct `row`, with `leaks`, the items found in its text.

    An item of w words is found where some stretch of the text is within
    floor(rate * w) word insertions, deletions and replacements of it.

    * Null text: no leaks. Items without words, or null, are never found; an item that
      occurs twice in the benchmark with one text counts once.
    * An item is reported once for each document, where it has the fewest edits, and of
      equal ones where it comes first. Long texts are searched whole, in overlapping parts.
    * All columns pass through. Empty tables: no rows, or no leaks.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    found = T._parse_datatype_string(LEAK.format(kind=kind))
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    rows = rows.withColumn("leaks", F.array().cast(found))
    schema = T.StructType([rows.schema["row"], rows.schema["text"], T.StructField("leaks", found)])
    for block in item_blocks(benchmark):
        items = [(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()]  # a block's bytes
        shipped = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches):
            index, hasher = Index(shipped.value, rate), WordHasher(LETTERS)
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                leaks = find_leaks(texts, index, hasher)
                before = batch.column("leaks")
                if before.values is not None and len(before.flatten()):
                    leaks = [[*map(lambda x: tuple(x.values()), old), *new] for old, new in zip(before.to_pylist(), leaks)]
                names = ("item_id", "edits", "item_words", "first_word")
                told = pa.array([[dict(zip(names, x)) for x in row] for row in leaks], before.type)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), told], names=["row", "text", "leaks"])

        rows = rows.mapInArrow(run, schema)
    return rows.drop("text")


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word) of all items in all documents; repeated rows once."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, rate)
    return found.select("row.doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*").distinct()
