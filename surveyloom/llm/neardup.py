"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

Documents with equal shingle sets form a class; from there on only classes are
compared. A class has a signature of `CHUNKS` x `CHUNK` symbols of 8 bits, one per
MinHash function. Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1
symbols have, by pigeonhole, a chunk in which they differ in at most ERRORS symbols.
So every chunk is entered once for each choice of ERRORS symbols to leave out, and
classes that share an entry are candidates: all pairs up to that distance are found.
Similar sets exceed it seldom: at a similarity of 0.8, a chunk has more than one of
five symbols wrong with probability 0.26, all eight chunks with 0.00002.

Candidates are confirmed on the full sets. That goes in two steps, as links matter
only for the components they form:

1. in every entry, the class that shares entries with most others is held against each
   of the others. Confirmed links give first components. In entries that then hold
   several, the class whose shingles are the most common, which in a group of copies is
   one near their origin, is held against one class of each other component;
2. in entries that hold more than one component, every class outside the entry's
   largest component is held against all members of other components. A pair is
   formed only if the two do not miss too many of each other's rarest shingles to be
   similar, as texts do that were each changed in too many places.

No list of members is ever gathered: an entry is a key of joins that Spark may split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import wordhash
from surveyloom.llm.components import connected_components
from surveyloom.llm.support import text_bytes
from surveyloom.sources.scratch import materialise

CHUNKS, CHUNK, ERRORS = 8, 5, 1
SYMBOLS = CHUNKS * CHUNK
WORDS = SYMBOLS // 8
#: A pair of the least similarity is further apart with probability 0.00002.
FAR = 20
MARK_BITS, MOST_CLASSES = 40, (1 << 22) - 1
FEWEST = 4  # distinct sets of at most 3 shingles have a similarity below 0.8
SEEDS = wordhash.mix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def signatures(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(sets, SYMBOLS) symbols; each set is a non-empty run of hashes up to its end."""
    begins = np.concatenate([[0], ends[:-1]])
    symbols = np.empty((len(ends), SYMBOLS), dtype=np.uint8)
    for k in range(SYMBOLS):
        values = (hashes ^ SEEDS[2 * k]) * (SEEDS[2 * k + 1] | np.uint64(1))
        least = np.minimum.reduceat(values, begins)
        symbols[:, k] = (wordhash.mix(least) >> np.uint64(56)).astype(np.uint8)
    return symbols


def entries(symbols: np.ndarray) -> np.ndarray:
    """(sets, entries) keys: chunk, symbol left out, and the other symbols of the chunk."""
    wide = symbols.astype(np.int64)
    keys = []
    for chunk in range(CHUNKS):
        for out in range(CHUNK):
            key = np.full(len(wide), chunk * CHUNK + out, dtype=np.int64)
            for k in range(CHUNK):
                if k != out:
                    key = key << 8 | wide[:, chunk * CHUNK + k]
            keys.append(key)
    return np.stack(keys, 1)


def _sets(data, offsets, width):
    """Yield (text, sorted distinct shingles) for each text with words."""
    hasher = wordhash.WordHasher()
    for first, words, counts in hasher.per_text(data, offsets):
        grams, number = wordhash.shingles(words, counts, width)
        ends = np.cumsum(number)
        for i in np.flatnonzero(number):
            yield first + int(i), np.unique(grams[ends[i] - number[i] : ends[i]])


def _group_rows(rows, most: int = 1 << 18):
    """Lists of (row, set) with about `most` shingles in all."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def shingle_classes(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, bytes) with set size, set digest and signature; null digest for no words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from hashlib import blake2b

        for batch in batches:
            data, offsets = wordhash.column_bytes(batch.column("bytes"))
            size = np.zeros(batch.num_rows, dtype=np.int64)
            digest: list = [None] * batch.num_rows
            packed = np.zeros((batch.num_rows, WORDS), dtype=np.int64)
            for group in _group_rows(_sets(data, offsets, width)):
                rows = [row for row, _ in group]
                sizes = np.array([len(s) for _, s in group])
                symbols = signatures(np.concatenate([s for _, s in group]), np.cumsum(sizes))
                size[rows] = sizes
                packed[rows] = symbols.view("<i8")
                for row, s in group:
                    digest[row] = blake2b(s.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("same"), pa.array(size), pa.array(digest, pa.binary()),
                    *(pa.array(packed[:, k].copy()) for k in range(WORDS)),
                ],
                names=["doc_id", "same", "size", "digest", *(f"s{k}" for k in range(WORDS))],
            )

    columns = ", ".join(f"s{k} bigint" for k in range(WORDS))
    return docs.select("doc_id", "bytes", F.md5("bytes").alias("same")).mapInArrow(
        run, f"doc_id {kind}, same string, size bigint, digest binary, {columns}"
    )


def distance(a: str, b: str) -> Column:
    """Symbols in which two signatures differ: non-zero bytes of the exclusive or."""
    total = F.lit(0)
    for k in range(WORDS):
        x = F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        total = total + F.bit_count(x)
    return total


def _entry_rows(classes: DataFrame) -> DataFrame:
    """(key, cid) for every class that can have a neighbour."""
    names = [f"s{k}" for k in range(WORDS)]

    def run(batches):
        for batch in batches:
            packed = np.stack([batch.column(n).to_numpy() for n in names], 1)
            keys = entries(packed.view(np.uint8).reshape(len(packed), SYMBOLS))
            cid = np.repeat(batch.column("cid").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cid)], names=["key", "cid"])

    return classes.where(F.col("size") >= FEWEST).select("cid", *names).mapInArrow(run, "key bigint, cid bigint")


def _sets_of(wanted: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(cid, set) of the classes in `wanted`: the sorted hashes of all shingles, read from the lead's text."""
    source = classes.join(wanted, "cid").select(
        "cid", F.col("lead.doc_id").alias("lead_id"), F.col("lead.same").alias("lead_same")
    )
    texts = docs.select("doc_id", "bytes", F.md5("bytes").alias("same")).join(
        source, F.expr("doc_id <=> lead_id and same = lead_same")
    )

    def run(batches):
        for batch in batches:
            data, offsets = wordhash.column_bytes(batch.column("bytes"))
            cids = batch.column("cid").to_numpy()
            for group in _group_rows(_sets(data, offsets, width)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cids[[r for r, _ in group]]), pa.array([s.tobytes() for _, s in group], pa.binary())],
                    names=["cid", "set"],
                )

    found = texts.select("cid", "bytes").mapInArrow(run, "cid bigint, set binary")
    return materialise(found.dropDuplicates(["cid"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets have at least `percent` similarity."""

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (a, b))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        check, "a bigint, b bigint"
    )


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, rare, common): the shingles of a class that the fewest classes in `sets` have, rarest first.

    As many as a set of at least `percent` similarity cannot all miss. `common` tells in
    how many classes they are in all; it is largest near the origin of a group of copies.

    A shingle is one whole number, the number of its classes before bits of its hash, so
    that lists compare without nested values. Two shingles of one number count as equal,
    which can only let a pair through that is then compared in full.
    """

    def run(batches):
        for batch in batches:
            for cid, packed in zip(batch.column("cid").to_pylist(), batch.column("set")):
                hashes = np.frombuffer(packed.as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array(np.full(len(hashes), cid))], names=["shingle", "cid"]
                )

    rows = sets.mapInArrow(run, "shingle bigint, cid bigint")
    known = materialise(rows.groupBy("shingle").agg(F.count("*").alias("classes")), "shingles")
    mark = F.shiftleft(F.least("classes", F.lit(MOST_CLASSES)), MARK_BITS).bitwiseOR(
        F.col("shingle").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    )
    listed = rows.join(known.select("shingle", mark.alias("mark")), "shingle").groupBy("cid").agg(
        F.sort_array(F.collect_list("mark")).alias("all")
    )
    count = F.size("all") - F.ceil(F.size("all") * percent / 100).cast("int") + 1
    rare = listed.select("cid", F.slice("all", F.lit(1), count).alias("rare"))
    return rare.withColumn(
        "common", F.aggregate("rare", F.lit(0).cast("bigint"), lambda t, n: t + F.shiftright(n, MARK_BITS))
    )


def _star(labelled: DataFrame, rank: str) -> DataFrame:
    """Pairs (a, b): in every entry, the member of highest rank with the highest of each other component."""
    lead = labelled.groupBy("key").agg(F.max(F.struct(rank, "cid", "component")).alias("lead"))
    apart = labelled.join(materialise(lead, "leads"), "key").where(F.col("component") != F.col("lead.component"))
    one = apart.groupBy("key", "component", F.col("lead.cid").alias("lead")).agg(
        F.max(F.struct(rank, "cid")).alias("one")
    )
    other = F.col("one.cid")
    return one.select(F.least("lead", other).alias("a"), F.greatest("lead", other).alias("b")).distinct()


def _sided(classes: DataFrame, side: str, *more: str) -> DataFrame:
    """Size, signature and what else is named of a class, for one side of a pair."""
    return classes.select(
        F.col("cid").alias(side), F.col("size").alias(f"n{side}"), *(F.col(f"s{k}").alias(f"{side}{k}") for k in range(WORDS)),
        *(F.col(name).alias(f"{name}_{side}") for name in more),
    )


def _may_link(percent: int) -> Column:
    """What sizes and signatures of a pair allow."""
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (distance("a", "b") <= FAR)


def _may_share_enough(percent: int) -> Column:
    """Whether the rarest shingles of a pair leave room for what it must have in common.

    That is percent / (100 + percent) of its sizes' sum. Both lists are in one order:
    what comes before the end of the other's list and is not in it, the other has not
    got. Sets that miss too much of each other's lists cannot be similar.
    """
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))

    def first(side: str) -> Column:
        return F.slice(f"rare_{side}", F.lit(1), F.greatest(F.lit(0), F.col(f"n{side}") - needed + 1).cast("int"))

    def left(side: str, other: str) -> Column:
        theirs = F.col(f"rare_{other}")
        within = F.filter(f"rare_{side}", lambda s: s < F.element_at(theirs, -1))
        return F.col(f"n{side}") - F.size(F.array_except(within, theirs))

    return F.arrays_overlap(first("a"), first("b")) & (left("a", "b") >= needed) & (left("b", "a") >= needed)


def _joined_up(members: DataFrame, links: DataFrame) -> DataFrame:
    """`members` with the component that `links` give each class; its own id where it has none."""
    found = connected_components(links, "a", "b").withColumnRenamed("node", "cid")
    return materialise(
        members.join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "labelled"
    )


def _still_mixed(labelled: DataFrame) -> DataFrame:
    """The rows of entries that hold several components, with the entry's largest one."""
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = materialise(
        sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts"))
        .where("parts > 1").select("key", F.col("most.component").alias("major")),
        "mixed",
    )
    return materialise(labelled.join(mixed, "key"), "inside")


def _classified(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, same, size, component, component_id) for every row (doc_id, bytes); null component for no words."""
    if percent < 80:
        raise ValueError("signatures are laid out for similarities of 0.8 or more")
    rows = materialise(shingle_classes(docs, width), "rows")
    names = [f"s{k}" for k in range(WORDS)]
    classes = materialise(
        rows.where("digest is not null").groupBy("digest").agg(
            F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "same")).alias("lead"),
            F.first("size").alias("size"), *(F.first(n).alias(n) for n in names),
        ).withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )

    keyed = _entry_rows(classes)
    shared = materialise(
        keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared"
    )
    members = materialise(keyed.join(shared, "key"), "members")
    company = members.groupBy("cid").agg(F.sum("members").alias("company"))
    members = materialise(members.join(materialise(company, "company"), "cid").drop("members"), "members")
    sets = _sets_of(members.select("cid").distinct(), docs, classes, width)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(_sided(classes, "a"), "a").join(_sided(classes, "b"), "b").where(_may_link(percent))
        return materialise(_confirmed(materialise(pairs.select("a", "b"), "pairs"), sets, percent), "links")

    links = confirmed(_star(members.withColumn("component", F.col("cid")), "company"))
    inside = _still_mixed(_joined_up(members, links))
    left = sets.join(inside.select("cid").distinct(), "cid", "left_semi")
    known = materialise(classes.join(_rare_shingles(left, percent), "cid"), "known")
    links = links.unionByName(confirmed(_star(inside.join(known.select("cid", "common"), "cid"), "common")))
    inside = _still_mixed(_joined_up(inside.select("key", "cid"), links))
    minor = inside.where("component <> major").select("key", F.col("cid").alias("a"), F.col("component").alias("ca"))
    other = inside.select("key", F.col("cid").alias("b"), F.col("component").alias("cb"), "major")
    across = (
        minor.join(_sided(known, "a", "rare"), "a").join(other.join(_sided(known, "b", "rare"), "b"), "key")
        .where("ca <> cb and (cb = major or a < b)").where(_may_link(percent) & _may_share_enough(percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    across = materialise(across, "across")
    links = materialise(links.select("a", "b").unionByName(_confirmed(across, sets, percent)), "links")

    found = connected_components(links, "a", "b")
    named = classes.select("cid", "digest", "first_id").join(
        found.withColumnRenamed("node", "cid"), "cid", "left"
    ).withColumn("component", F.coalesce("component", "cid"))
    # both written, so that their joins deal out a large component or class afresh
    smallest = materialise(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest")
    named = materialise(named.join(smallest, "component").select("digest", "component", "component_id"), "named")
    return rows.select("doc_id", "same", "size", "digest").join(named, "digest", "left").drop("digest")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Documents are linked when 100 * |common shingles| >= percent * |all shingles|;
    `percent` must be at least 80, for which signatures are laid out.

    * A text of fewer than `width` words has its whole word sequence as one shingle. A
      null text, or one without words, has no shingles and no link.
    * Rows that repeat a text share its class. Rows that repeat an id are kept or
      dropped together; a null id is never the smallest of a component unless all are.
    * An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(F.col(text_col)).alias("bytes"))
    found = _classified(rows, width, percent)
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def one_of_each(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs`, all columns, without near duplicates of a row with a smaller id.

    Rows without words all stay. Of rows that repeat an id and a text one stays.
    """
    data = text_bytes(F.col(text_col))
    found = _classified(docs.select(F.col(id_col).alias("doc_id"), data.alias("bytes")), width, percent)
    leads = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "same")).alias("lead"))
    leads = materialise(leads.select(F.col("lead.doc_id").alias("lead_id"), F.col("lead.same").alias("lead_same")), "leads")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.md5(data).alias("_same"))
    same = F.col("_id").eqNullSafe(F.col("lead_id")) & (F.col("_same") == F.col("lead_same"))
    first = rows.join(leads, same).groupBy("_id", "_same").agg(F.first("row").alias("row"))
    wordless = found.where("component is null").select(F.col("same").alias("lead_same")).distinct()
    rest = rows.join(wordless, F.col("_same") == F.col("lead_same"), "left_semi")
    return first.select("row.*").unionByName(rest.select("row.*"))
