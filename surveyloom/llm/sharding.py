"""Shards by balanced label propagation.

Documents with equal texts are linked. Every document starts in the shard its row
hash names; then, round by round, linked documents move to the shard that holds
most of their neighbours, as far as that shard has room, those of a group above the
room to several shards at once, until no document moves. The neighbours of a
document are the members of its group, so a round works on one count per
(group, shard) alone: no pair of documents is ever formed, a group that holds a third
of all rows is counted before it is shuffled, and rows are dealt out once at the end.

Room is a quota of floor(rows / shards) linked documents per shard. Documents
without links, and linked ones above the quota, have no neighbour to lose; they
fill every shard to its exact size at the end. Shard sizes thus differ by one row
at most (law `rows`).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.support import numbered, parts_for, text_bytes
from surveyloom.sources.scratch import materialise

BLOCK_ROWS = 200_000
GROUP_BUCKETS = 1024


def _flows(counts: DataFrame, room: DataFrame) -> DataFrame:
    """(grp, shard, to, wish): members that leave `shard` for `to`, which holds more of their group.

    The shards of a group stand in the order of its members there; equal numbers by a
    hash, so that no shard is favoured. Members leave from the end of that order and
    fill the room of its shards from the start, as many shards as it takes, until both
    meet. No shard gives and takes members of one group.
    """
    order = Window.partitionBy("grp").orderBy(F.desc("n"), F.xxhash64("grp", "shard"), "shard")
    known = counts.join(F.broadcast(room), "shard").withColumns({
        "rank": F.row_number().over(order),
        "room_end": F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "move_end": F.sum("n").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    # a line per shard of the group at most
    parts = known.groupBy("grp").agg(F.collect_list(F.struct("shard", "n", "rank", "room", "room_end", "move_end")).alias("parts"))

    def wish(s, t):
        return F.least(s.move_end, t.room_end) - F.greatest(s.move_end - s.n, t.room_end - t.room)

    def leave(s):
        goals = F.filter("parts", lambda t: (t["rank"] < s["rank"]) & (wish(s, t) > 0))
        return F.transform(goals, lambda t: F.struct(s.shard.alias("shard"), t.shard.alias("to"), wish(s, t).alias("wish")))

    flows = F.explode(F.flatten(F.transform("parts", leave))).alias("flow")
    return parts.where(F.size("parts") > 1).select("grp", flows).select("grp", "flow.*")


def _granted(flows: DataFrame, room: DataFrame, salt: int) -> DataFrame:
    """(grp, shard, to, n): of the flows into a shard, groups together, exactly what its room holds."""
    dealt = flows.withColumn("gb", F.pmod(F.xxhash64("grp", F.lit(salt)), F.lit(GROUP_BUCKETS)))
    before = Window.partitionBy("to").orderBy("gb").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("to", "gb").agg(F.sum("wish").alias("all")).select(
        "to", "gb", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("to", "gb").orderBy("grp", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(starts, ["to", "gb"])
        .withColumn("used", F.col("start") + F.coalesce(F.sum("wish").over(within), F.lit(0)))
        .join(F.broadcast(room.withColumnRenamed("shard", "to")), "to")
        .select("grp", "shard", "to", F.least("wish", F.col("room") - F.col("used")).alias("n"))
        .where("n > 0")
    )


def propagate(counts: DataFrame, shards: int, quota: int) -> DataFrame:
    """(grp, shard, n) after label propagation under the quota per shard, when no member wishes to move.

    Every move goes to more of its group, so the pairs within shards grow in each
    round and the rounds come to an end.
    """
    every = counts.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    for step in count():
        filled = counts.groupBy("shard").agg(F.sum("n").alias("filled"))
        room = every.join(filled, "shard", "left").select(
            "shard", F.greatest(F.lit(0), quota - F.coalesce("filled", F.lit(0))).alias("room")
        )
        flows = materialise(_flows(counts, room), "flows")
        if flows.isEmpty():
            return counts
        moved = materialise(_granted(flows, room, step), "moved")
        change = moved.select("grp", "shard", (-F.col("n")).alias("n")).unionByName(
            moved.select("grp", F.col("to").alias("shard"), "n")
        )
        counts = counts.unionByName(change).groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        counts = materialise(counts, "counts")


def _placed(linked: DataFrame, counts: DataFrame, blocks: int, span: int) -> DataFrame:
    """(rid, shard): the rows of each group dealt out to its shards, `span` rows of a group at a time."""
    upto = Window.partitionBy("grp").orderBy("shard")
    ends = counts.withColumn("end", F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
    cut = lambda place: F.floor(place / span)
    ends = ends.withColumn("cut", F.explode(F.sequence(cut(F.col("start")), cut(F.col("end") - 1))))
    rows = numbered(linked, ["grp"], ["rid"], "place", blocks).withColumn("cut", cut(F.col("place")))
    joined = rows.select("rid", "grp", "place", "cut").join(ends.drop("n"), ["grp", "cut"])
    return joined.where("place >= start and place < end").select("rid", ends["shard"])


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All documents with shard, slot, size, checksum and the size of their group.

    * Null text: size 16, checksum of no bytes, no link to any row (an empty text
      is a text and links with other empty ones).
    * Repeated rows and repeated ids are rows of their own. An empty table gives an
      empty result. Other columns of `docs` are ignored.
    * With fewer rows than shards, some shards stay empty.
    * A group above the quota is spread over as few shards as have room.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text_bytes(text)) + 16).cast("bigint").alias("size"),
            F.crc32(text_bytes(text)).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("grp"),
        ),
        "rows",
    )
    total = rows.count()
    blocks = parts_for(spark, total, BLOCK_ROWS)
    # written, so that joins with it deal a large group's rows out afresh instead of keeping them together
    groups = rows.where("grp is not null").groupBy("grp").agg(F.count("*").alias("group_rows")).where("group_rows > 1")
    groups = materialise(groups, "groups")
    shard0 = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")
    linked = rows.select("rid", "grp").join(groups.select("grp"), "grp").select("rid", "grp", shard0.alias("shard"))
    linked = materialise(linked, "linked")
    counts = materialise(linked.groupBy("grp", "shard").agg(F.count("*").alias("n")), "counts")

    quota = total // shards
    span = max(1, -(-total // blocks))
    placed = materialise(_placed(linked.drop("shard"), propagate(counts, shards, quota), blocks, span), "placed")
    ranked = numbered(placed, ["shard"], ["rid"], "place", blocks)
    kept = materialise(ranked.where(F.col("place") < quota).select("rid", "shard"), "kept")
    have = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count("*").alias("n")).collect()}

    # ends of the shards' shares of the remaining rows, one number per shard
    ends, end = [], 0
    for shard in range(shards):
        end += quota + (shard < total % shards) - have.get(shard, 0)
        ends.append(end)
    rest = numbered(rows.join(kept, "rid", "left_anti").select("rid"), [], ["rid"], "place", blocks)
    spread = F.size(F.filter(F.lit(ends), lambda e: e <= F.col("place")))
    shard_of = kept.unionByName(rest.select("rid", spread.cast("int").alias("shard")))
    return (
        numbered(rows.join(shard_of, "rid"), ["shard"], ["rid"], "slot", blocks)
        .join(groups, "grp", "left")
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
            F.lit(None).cast("int").alias("grown_shard"),
            F.coalesce("group_rows", F.lit(1)).alias("group_rows"),
        )
    )
