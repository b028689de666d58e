"""Byte-level BPE over whole partitions, by an index from pairs to their positions.

A partition's texts are split into words; a word that the partition has met before has
its ids at hand. The words not met before are laid out together as one run of symbols,
with links to the next and previous symbol that end at a word's borders. An index holds,
for every pair of neighbours that has a rank, all positions where it stands. The active
ranks are applied in ascending order: a rank's positions are merged from left to right,
and the pairs that a merge makes are entered under their own, always higher, ranks.
So a rank is applied once to all words that contain it, however many or long they are.

Decoding lays the byte strings of all ids of a batch end to end.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT = 400_000  # words, and as many parts of words, whose ids a task keeps at hand
KEPT_LENGTH = 64  # longer ones are encoded each time they occur
BATCH_SYMBOLS = 1 << 22  # symbols laid out together, unless one word is longer
BATCH_TEXT = 1 << 22  # characters of text whose new words are learnt together
STRETCH = 1 << 20  # characters of a text that are split into words at once
HELD = 1 << 20  # ids, or bytes of them, that are worked on at once
SPLIT_WORDS = 4096  # new words that are split by one call
WIDE = 24  # positions from which on arrays are faster than a loop


class Vocabulary:
    """A byte-level vocabulary file: symbols, merges by rank, tokens that are never split."""

    def __init__(self, content: str):
        file = json.loads(content)
        model = file["model"]
        splitter = file["pre_tokenizer"]
        if splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or file["normalizer"] or not splitter["use_regex"]:
            raise ValueError("a byte-level vocabulary without prefix space and normaliser is needed")
        self.ids = model["vocab"]
        self.size = 1 + max([*self.ids.values(), *(t["id"] for t in file["added_tokens"])])
        self.rank, self.merged, self.pair_of = {}, [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.ids[a] * self.size + self.ids[b]] = rank
            self.merged.append(self.ids[a + b])
            self.pair_of.append((self.ids[a], self.ids[b]))
        self.pair_keys = np.array(sorted(self.rank), dtype=np.int64)
        self.pair_ranks = np.array([self.rank[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.bytes = [b""] * self.size
        for token, i in [*self.ids.items(), *self.added.items()]:
            plain = all(c in byte_of for c in token)
            self.bytes[i] = bytes(byte_of[c] for c in token) if plain else token.encode()
        self.symbol = np.zeros(256, dtype=np.int64)  # of each byte
        for c, b in byte_of.items():
            self.symbol[b] = self.ids[c]


class PairIndex:
    """Words laid end to end as symbols, and the positions of every pair that has a rank."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary):
        count = len(symbols)
        last = np.zeros(count, dtype=bool)
        last[np.append(starts[1:], count) - 1] = True
        self.vocabulary = vocabulary
        self.sym = symbols.astype(np.int64)
        self.after = np.where(last, -1, np.arange(count) + 1)
        self.before = np.arange(count) - 1
        self.before[starts] = -1
        self.places: dict[int, list[int]] = {}
        self.active: list[int] = []  # a heap of the ranks in `places`
        left = np.flatnonzero(~last)
        self.enter(self.sym[left], self.sym[left + 1], left)

    def enter(self, a: np.ndarray, b: np.ndarray, at: np.ndarray):
        """Note that the pairs (a, b) stand at these positions, where they have a rank."""
        keys = a * self.vocabulary.size + b
        found = np.minimum(np.searchsorted(self.vocabulary.pair_keys, keys), len(self.vocabulary.pair_keys) - 1)
        known = self.vocabulary.pair_keys[found] == keys
        ranks, at = self.vocabulary.pair_ranks[found[known]], at[known]
        if len(ranks) > 64:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order].tolist()
            cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                self.add(int(ranks[lo]), at[lo:hi])
        else:
            for rank, place in zip(ranks.tolist(), at.tolist()):
                self.add(rank, [place])

    def add(self, rank: int, places: list[int]):
        if rank in self.places:
            self.places[rank] += places
        else:
            self.places[rank] = places
            heapq.heappush(self.active, rank)

    def apply_wide(self, rank: int, places: list[int]):
        """Merge a rank at many positions at once; its two symbols differ, so these do not overlap."""
        (a, b), new = self.vocabulary.pair_of[rank], self.vocabulary.merged[rank]
        sym, after, before = self.sym, self.after, self.before
        at = np.sort(np.array(places))
        fits = sym[at] == a
        fits[1:] &= at[1:] != at[:-1]
        at = at[fits]
        follow = after[at]
        fits = follow >= 0
        at, follow = at[fits], follow[fits]
        fits = sym[follow] == b
        at, follow = at[fits], follow[fits]
        sym[at], sym[follow] = new, -1
        further = after[follow]
        after[at] = further
        right = further >= 0
        before[further[right]] = at[right]
        previous = before[at]
        left = previous[previous >= 0]
        made = np.concatenate([sym[at[right]], sym[left]])
        self.enter(made, np.concatenate([sym[further[right]], np.full(len(left), new)]), np.concatenate([at[right], left]))

    def apply_all(self):
        """Apply the active ranks in ascending order until none is left."""
        sym, after, before = (memoryview(x) for x in (self.sym, self.after, self.before))
        rank_of, merged, pair_of = self.vocabulary.rank.get, self.vocabulary.merged, self.vocabulary.pair_of
        size, index, active = self.vocabulary.size, self.places, self.active
        while active:
            rank = heapq.heappop(active)
            places = index.pop(rank)
            (a, b), new = pair_of[rank], merged[rank]
            if len(places) > WIDE and a != b:
                self.apply_wide(rank, places)
                continue
            places.sort()  # a symbol paired with itself is merged from the left
            for i in places:
                if sym[i] != a:
                    continue
                j = after[i]
                if j < 0 or sym[j] != b:
                    continue
                sym[i] = new
                sym[j] = -1
                k, p = after[j], before[i]
                after[i] = k
                if k >= 0:
                    before[k] = i
                    made = rank_of(new * size + sym[k])
                    if made is not None:
                        if made in index:
                            index[made].append(i)
                        else:
                            index[made] = [i]
                            heapq.heappush(active, made)
                if p >= 0:
                    made = rank_of(sym[p] * size + new)
                    if made is not None:
                        if made in index:
                            index[made].append(p)
                        else:
                            index[made] = [p]
                            heapq.heappush(active, made)


def merge_all(symbols: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per word) of words laid end to end as byte symbols, each word from its start to the next."""
    index = PairIndex(symbols, starts, vocabulary)
    index.apply_all()
    there = index.sym >= 0
    return index.sym[there], np.add.reduceat(there.astype(np.int64), starts)


# how a byte-level pre-tokenizer splits a text: a fixed value
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# beyond these scripts the libraries' tables of letters are of different age
_FOREIGN = re.compile("[\u0530-\U0010ffff]").search
# between two characters that are no white space, a space always starts a new word
_BORDER = re.compile(r"(?<=\S) (?=\S)")


def _words(text: str) -> list[str]:
    words = text.split()
    return words if " ".join(words) == text else _BORDER.split(text)  # mostly one space between any two words


@contextmanager
def _no_collector():
    """Millions of small tuples without a cycle are made inside; searching them for cycles is half the time."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


class _Known(dict):
    """Ids by word, emptied before it outgrows its bound."""

    def missing(self, words: set[str]) -> list[str]:
        new = words.difference(self)
        if new and len(self) + len(new) > KEPT:
            self.clear()
            new = words
        return list(new)

    def drop_long(self, words: list[str]):
        for word in words:
            if len(word) > KEPT_LENGTH:
                del self[word]


class Encoder:
    """Texts to ids, with the ids of words met before at hand."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(content)
        self.pieces_of = Tokenizer.from_str(content).pre_tokenizer.pre_tokenize_str
        self.opening, self.inner, self.piece = _Known(), _Known(), _Known()  # first words, words after a space, parts
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def _split(self, text: str) -> list[str]:
        """The parts of a text within which pairs are merged."""
        if text.isascii() or not _FOREIGN(text):
            return _PIECE.findall(text)
        return [text[begin:end] for _, (begin, end) in self.pieces_of(text)]

    def _merge(self, pieces: list[str]):
        """Take in the ids of new parts of words."""
        lo = 0
        while lo < len(pieces):
            hi, held = lo, 0
            while hi < len(pieces) and (hi == lo or held + len(pieces[hi]) <= BATCH_SYMBOLS):
                held += len(pieces[hi])
                hi += 1
            data = [piece.encode() for piece in pieces[lo:hi]]
            lengths = np.fromiter(map(len, data), np.int64, hi - lo)
            symbols = self.vocabulary.symbol[np.frombuffer(b"".join(data), dtype=np.uint8)]
            ids, number = merge_all(symbols, np.cumsum(lengths) - lengths, self.vocabulary)
            data, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(number)).tolist()
            self.piece.update(zip(pieces[lo:hi], map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))))
            lo = hi

    def _learn(self, opening: list[str], inner: list[str]):
        """Take in the ids of new words. Inner words are split as they stand in a text, one after the other."""
        split, owner = [], []
        inner = sorted(inner, key=lambda word: not word.isascii() and _FOREIGN(word) is not None)
        for lo in range(0, len(opening), SPLIT_WORDS):
            some = opening[lo : lo + SPLIT_WORDS]
            parts = list(map(self._split, some))
            owner.append(lo + np.repeat(np.arange(len(some)), np.fromiter(map(len, parts), np.int64, len(parts))))
            split += chain.from_iterable(parts)
        for lo in range(0, len(inner), SPLIT_WORDS):
            some = inner[lo : lo + SPLIT_WORDS]
            parts = self._split(" " + " ".join(some))
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            length = np.fromiter(map(len, parts), np.int64, len(parts))
            owner.append(len(opening) + lo + np.searchsorted(ends, np.cumsum(length) - length, side="right"))
            split += parts
        new = self.piece.missing(set(split))
        self._merge(new)
        ids = list(map(self.piece.__getitem__, split))
        self.piece.drop_long(new)
        cuts = np.searchsorted(np.concatenate(owner), np.arange(len(opening) + len(inner) + 1)).tolist()
        found = [ids[lo] if hi == lo + 1 else b"".join(ids[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
        self.opening.update(zip(opening, found))
        self.inner.update(zip(inner, found[len(opening) :]))

    def _stretches(self, text: str):
        """(an added token's ids, first word, words after a space) in the order of the text, what there is of these.

        Long texts come in stretches that end where a word does; only the first of them has a first word.
        """
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                yield self.vocabulary.added[part].to_bytes(4, "little"), None, None
                continue
            at = 0
            while at < len(part):
                end = at + STRETCH
                border = _BORDER.search(part, end) if end < len(part) else None
                stop = border.start() if border else len(part)
                words = _words(part[at:stop])
                yield (None, words[0], words[1:]) if at == 0 else (None, None, words)
                at = stop + 1

    def _settle(self, texts: list[str]) -> list[bytes]:
        """Learn the new words of all these texts together, then look every word up."""
        split = [list(self._stretches(text)) for text in texts]
        opening, inner = set(), set()
        for stretches in split:
            for _, first, rest in stretches:
                if first is not None:
                    opening.add(first)
                inner.update(rest or ())
        opening, inner = self.opening.missing(opening), self.inner.missing(inner)
        if opening or inner:
            self._learn(opening, inner)
        found = []
        for stretches in split:
            parts = []
            for ids, first, rest in stretches:
                if ids is not None:
                    parts.append(ids)
                if first is not None:
                    parts.append(self.opening[first])
                parts += map(self.inner.__getitem__, rest or ())
            found.append(b"".join(parts))
        self.opening.drop_long(opening)
        self.inner.drop_long(inner)
        return found

    def encode_all(self, texts):
        """Yield the ids of each text, as little-endian 32-bit bytes."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= BATCH_TEXT:
                with _no_collector():
                    found = self._settle(waiting)
                yield from found
                waiting, size = [], 0
        with _no_collector():
            found = self._settle(waiting)
        yield from found

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def _content(vocabulary: str) -> str:
    with open(vocabulary, encoding="utf-8") as file:
        return file.read()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, a row for each row of `docs`.

    * Added tokens of the vocabulary in a text become their one id; nothing is put
      before or after a text. A null or empty text has no ids.
    * Repeated rows and ids are rows of their own; a null id stays null. An empty table
      gives an empty result. Other columns are ignored, whatever they are called.
    * A very long text is encoded in stretches of about a million characters; what must
      be in memory at once is one stretch, or one word where that is longer.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(_content(vocabulary))

    def run(batches):
        encoder = Encoder(content.value)
        for batch in batches:
            column = batch.column("text")
            first, parts, held = 0, [], 0
            texts = (column[i].as_py() or "" for i in range(batch.num_rows))
            for i, part in enumerate(encoder.encode_all(texts)):
                parts.append(part)
                held += len(part)
                if held > HELD or i == batch.num_rows - 1:
                    values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
                    offsets = np.cumsum([0, *map(len, parts)]) // 4
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, len(parts)), lists], names=["doc_id", "ids"]
                    )
                    first, parts, held = i + 1, [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>"
    )


class Decoder:
    """Ids to texts by look-ups in one array of all tokens' bytes."""

    def __init__(self, content: str):
        tokens = Vocabulary(content).bytes
        self.table = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.length = np.array([*map(len, tokens), 0], dtype=np.int64)  # the last one: no such id
        self.start = np.cumsum(self.length) - self.length

    def data(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bytes per id)."""
        known = np.where((ids >= 0) & (ids < len(self.length) - 1), ids, len(self.length) - 1)
        length = self.length[known]
        begin = self.start[known] - (np.cumsum(length) - length)
        return self.table[np.repeat(begin, length) + np.arange(length.sum())], length

    def decode(self, ids: np.ndarray) -> str:
        steps = range(0, len(ids), HELD)
        return b"".join(self.data(ids[lo : lo + HELD])[0].tobytes() for lo in steps).decode("utf-8", "replace")


def decode_documents(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, ids) with `text`, what the ids stand for, added tokens included.

    Ids that the vocabulary has not got, and null entries, stand for nothing; bytes that are no
    UTF-8 become U+FFFD. Null ids have a null text, an empty list an empty one.
    """
    spark = encoded.sparkSession
    content = spark.sparkContext.broadcast(_content(vocabulary))

    def run(batches):
        decoder = Decoder(content.value)
        for batch in batches:
            lists, texts, first = batch.column("ids"), [], 0
            held = 0
            for i in range(batch.num_rows):
                if not lists[i].is_valid:
                    texts.append(None)
                else:
                    values = lists[i].values
                    ids = values.fill_null(-1).to_numpy(zero_copy_only=False)
                    texts.append(decoder.decode(ids))
                    held += len(ids)
                if held > HELD or i == batch.num_rows - 1:
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())],
                        names=["doc_id", "ids", "text"],
                    )
                    texts, first, held = [], i + 1, 0

    rows = encoded.select("doc_id", F.col(ids_col).alias("ids"))
    kind, list_kind = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "ids"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids {list_kind}, text string")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoding_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of a round trip of every text."""
    read = decode_documents(encode_documents(docs, vocabulary), vocabulary)
    return read.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        _digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _digest(F.col("text")).alias("decoded_sha256"),
    )
