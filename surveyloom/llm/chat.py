"""Conversations as training windows under a token budget.

Prefix sums of turn tokens choose the windows: a turn belongs to the window in whose
stretch of the running sum it begins. A stretch is half of what system turn and
history leave of the budget, and no turn longer than a stretch shares its window, so
a window keeps to the budget unless a single turn alone exceeds it. Every window
begins with the system turn, repeats the last turns of the window before it as far
as the history allowance reaches, and goes on with its own turns. Only assistant
turns that appear for the first time are under the loss mask.

A turn is written `<turn>role\\ntext</turn>\\n`. Within role and text a backslash
becomes `\\b` and `<` becomes `\\l` (in a role also a line break `\\n`), so that no text
can contain a mark; undoing these in reverse order gives the text back.

A conversation is worked on in blocks of `BLOCK_TURNS` turn numbers, so that one very
long conversation is spread over many tasks; a window does not cross a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256
TURN_TOKENS = 4
OPEN, CLOSE = "<turn>", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, and the marks of a turn."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint") + TURN_TOKENS


def _with_system_copies(turns: DataFrame) -> DataFrame:
    """The system turn of a conversation of several blocks, once more for each later block."""
    blocks = turns.groupBy("conv_id").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    spread = blocks.where("first < last").select(F.col("conv_id").alias("c"), "first", "last")
    later = turns.select(F.col("conv_id").alias("d"), F.col("block").alias("later")).distinct()
    opening = turns.where("role = 'system'").join(spread, F.expr("conv_id <=> c and block = first"))
    lead = opening.groupBy("c").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("lead"))
    earliest = turns.join(spread, F.expr("conv_id <=> c and block = first")).groupBy("c").agg(
        F.min("turn").alias("begin")
    )
    lead = lead.join(earliest.withColumnRenamed("c", "e"), F.expr("c <=> e and lead.turn = begin"))
    copies = (
        lead.join(spread.select(F.col("c").alias("s"), "first"), F.expr("c <=> s"))
        .join(later, F.expr("d <=> c and later > first"))
        .select(
            F.col("c").alias("conv_id"), "lead.turn", "lead.role", "lead.text", F.col("later").alias("block"),
            "lead.tokens", F.lit(True).alias("copy"),
        )
    )
    return turns.withColumn("copy", F.lit(False)).unionByName(copies)


def chat_windows(
    turns: DataFrame, budget: int = 1024, history: int = 128, tokens: Column | None = None
) -> DataFrame:
    """One row per window: conv_id, block, window, formatted, loss_spans, repeated, tokens.

    `turns` has conv_id, turn, role, text; other columns are ignored. `tokens` is the
    length of a turn, an estimate by default. `loss_spans` are [start, end) in code
    points of `formatted`; `repeated` is the number of leading turns that an earlier
    window has already shown.

    * Null text or role: empty. Null turn: before all others; null conv_id: one
      conversation. Turns with equal numbers follow by role, then text; repeated rows
      are turns of their own.
    * Only a system turn that opens its conversation is retained; a later one is an
      ordinary turn without loss.
    * An empty table gives no windows.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-1 << 62)).cast("bigint").alias("block"),
        (estimated_tokens(F.coalesce("text", F.lit(""))) if tokens is None else tokens.cast("bigint")).alias("tokens"),
    )
    rows = _with_system_copies(rows)
    opens = rows.groupBy("conv_id").agg(F.min(F.when(~F.col("copy"), F.col("block"))).alias("opening"))
    rows = rows.join(opens.withColumnRenamed("conv_id", "o"), F.expr("conv_id <=> o")).drop("o")

    block = Window.partitionBy("conv_id", "block")
    order = block.orderBy(F.desc("copy"), "turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("ord", F.row_number().over(order))
    rows = rows.withColumn(
        "system",
        F.col("copy") | ((F.col("ord") == 1) & (F.col("block") == F.col("opening")) & (F.col("role") == "system")),
    )
    rows = rows.withColumns({
        "body": F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens")),
        "head": F.max(F.when(F.col("system"), F.col("tokens")).otherwise(F.lit(0))).over(upto),
    })
    rows = rows.withColumns({
        "begin": F.coalesce(F.sum("body").over(before), F.lit(0)),
        "step": F.greatest(F.lit(1), F.floor((budget - F.col("head") - history) / 2)).cast("bigint"),
    })
    rows = rows.withColumn("long", (F.col("body") > F.col("step")).cast("int"))
    rows = rows.withColumn("segment", F.sum("long").over(upto) + F.coalesce(F.sum("long").over(before), F.lit(0)))
    segment = Window.partitionBy("conv_id", "block", "segment").orderBy("ord")
    rows = rows.withColumn(
        "stretch", F.floor((F.col("begin") - F.min("begin").over(segment.rowsBetween(Window.unboundedPreceding, 0))) / F.col("step"))
    )
    window = Window.partitionBy("conv_id", "block", "segment", "stretch")
    # a long system turn or a changed step never moves a turn: the system turn takes no part in the sums
    rows = rows.withColumns({
        "next": F.max(F.col("begin") + F.col("body")).over(window),
        "window": F.dense_rank().over(block.orderBy("segment", "stretch")) - 1,
    }).withColumn("last", F.max("window").over(block))

    own = F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("repeat")))
    again = F.array(F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("repeat")))
    everywhere = F.transform(
        F.sequence(F.lit(0), F.col("last")), lambda w: F.struct(w.alias("window"), ((w > 0) | F.col("copy")).alias("repeat"))
    )
    recent = (F.col("window") < F.col("last")) & (F.col("next") - F.col("begin") <= history)
    places = F.when(F.col("system"), everywhere).when(recent, F.concat(own, again)).otherwise(own)
    shown = rows.select("conv_id", "block", "ord", "role", "text", "tokens", F.explode(places).alias("at")).select(
        "conv_id", "block", "at.window", "at.repeat", "ord", "role", "tokens",
        F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n")).alias("lead"),
        escaped(F.col("text")).alias("said"),
    )
    inside = Window.partitionBy("conv_id", "block", "window").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    shown = shown.withColumn("piece", F.concat("lead", "said", F.lit(CLOSE)))
    shown = shown.withColumn(
        "start", F.coalesce(F.sum(F.char_length("piece")).over(inside), F.lit(0)) + F.char_length("lead")
    )
    target = (F.col("role") == "assistant") & ~F.col("repeat")
    span = F.when(target, F.struct(F.col("start"), (F.col("start") + F.char_length("said")).alias("end")))
    listed = shown.groupBy("conv_id", "block", "window").agg(
        F.array_sort(F.collect_list(F.struct("ord", "piece", span.alias("span")))).alias("all"),
        F.sum(F.col("repeat").cast("bigint")).alias("repeated"),
        F.sum("tokens").alias("tokens"),
    )
    return listed.select(
        "conv_id", "block", "window",
        F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.filter("all.span", lambda s: s.isNotNull()).alias("loss_spans"),
        "repeated", "tokens",
    )


def window_turns(windows: DataFrame) -> DataFrame:
    """The windows with their own turns (role, text) parsed back, and the text under the loss mask."""
    pieces = F.slice(F.split("formatted", OPEN, -1), F.lit(2) + F.col("repeated").cast("int"), F.lit(1 << 30))

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        rest = F.char_length(piece) - F.char_length(role) - 1 - len(CLOSE)
        return F.struct(
            unescaped_role(role).alias("role"), unescaped(F.substr(piece, F.char_length(role) + 2, rest)).alias("text")
        )

    masked = F.transform(
        "loss_spans",
        lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return windows.withColumns({"turns": F.transform(pieces, turn), "masked": masked})


def conversation_digests(windows: DataFrame) -> DataFrame:
    """What the windows say, one row per conversation.

    The digests are defined over whole conversations, so here, and only here, the
    text of a conversation comes together in one row.
    """
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    per_window = window_turns(windows).select(
        "conv_id", "block", "window", F.size("turns").cast("bigint").alias("n"), said.alias("said"),
        F.array_join("masked", "").alias("masked"), F.char_length("formatted").cast("bigint").alias("chars"),
    )
    whole = per_window.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("block", "window", "said", "masked"))).alias("all"),
        F.sum("chars").alias("formatted_chars"),
    )
    masked = F.array_join(F.col("all.masked"), "")
    return whole.select(
        "conv_id", "n_turns",
        F.sha2(F.array_join(F.col("all.said"), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(masked).cast("bigint").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
