"""Cumulative-snapshot collapse of logged conversations, native DataFrame operations only.

A chat log often stores each conversation again after every turn.  Rolling
hashes over the turn prefixes find conversations that are a prefix of a longer
one; an anti-join keeps the maximal ones, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.session import materialise

BLOCK = 256  # turns that one window group or one rendered row holds


def positions(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``pos`` (0, 1, ... within a conversation) and ``blk = pos div block``.

    Turns are ordered by ``turn, role, text``.  Ranks are taken in two steps -
    inside a slice of ``block`` turn numbers, then over the slices' counts - so
    no task sorts a whole conversation.
    """
    sliced = turns.withColumn("slice", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2 ** 62))))
    sizes = sliced.groupBy("conv_id", "slice").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("conv_id", "slice").orderBy("turn", "role", "text")
    ranked = sliced.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    pos = F.col("start") + F.col("rank")
    return (ranked.join(starts, ["conv_id", "slice"])
            .select("conv_id", "role", "text", pos.alias("pos"), F.floor(pos / block).alias("blk")))


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """Per turn the hash of its whole prefix, ``(conv_id, pos, h1, h2)``.

    The prefix hash is the xor of two 64-bit hashes of (position, role, text);
    xor is associative, so blocks are hashed alone and then offset by the
    blocks before them.
    """
    said = [F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    turn = placed.select("conv_id", "pos", "blk", F.xxhash64(*said).alias("x1"), F.xxhash64(F.lit(7919), *reversed(said)).alias("x2"))
    blocks = turn.groupBy("conv_id", "blk").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("conv_id", "blk", *[F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(o) for b, o in (("b1", "o1"), ("b2", "o2"))])
    inside = Window.partitionBy("conv_id", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = turn.select("conv_id", "blk", "pos", F.bit_xor("x1").over(inside).alias("r1"), F.bit_xor("x2").over(inside).alias("r2"))
    return (rolled.join(offsets, ["conv_id", "blk"])
            .select("conv_id", "pos", F.col("r1").bitwiseXOR(F.col("o1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("o2")).alias("h2")))


def maximal(hashes: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)`` of the conversations that no other one extends.

    Of equal conversations the lowest id stays and ``n_copies`` counts them.
    Both join sides hold each (length, hash) once, however many logs share it.
    """
    ends = hashes.groupBy("conv_id").agg(F.max_by(F.struct("pos", "h1", "h2"), "pos").alias("end")).select("conv_id", "end.*")
    whole = ends.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = (hashes.join(ends.select("conv_id", F.col("pos").alias("end")), "conv_id")
              .where("pos < end").select("pos", "h1", "h2").distinct())
    return (whole.join(proper, ["pos", "h1", "h2"], "left_anti")
            .select("conv_id", (F.col("pos") + 1).alias("n_turns"), "n_copies"))


def collapse_snapshots(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rendered maximal conversations: ``conv_id, part, n_turns, n_copies, rendered``.

    ``conversations`` has ``conv_id, turn, role, text``; more columns are
    ignored.  Turns are ordered by (turn, role, text), nulls first; repeated
    rows are turns of their own.  A null role renders as ``unknown`` and a null
    text as empty, yet both differ from such strings when hashed.  Rows without
    a conv_id belong to no conversation and are left out.  A conversation of
    over ``block`` turns is rendered in several parts (0, 1, ...), whose
    concatenation is the conversation.  Empty input: no rows.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    placed = materialise(positions(turns, block), "turns")
    keep = maximal(materialise(prefix_hashes(placed), "prefixes"))
    piece = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    return (placed.join(keep, "conv_id")
            .groupBy("conv_id", F.col("blk").alias("part"), "n_turns", "n_copies")
            .agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("pieces"))
            .select("conv_id", "part", "n_turns", "n_copies", F.concat_ws("", "pieces.piece").alias("rendered")))
