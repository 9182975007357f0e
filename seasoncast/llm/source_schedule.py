"""Mixing sources to target weights by a low-discrepancy schedule, native DataFrame operations only.

Golden-ratio points, mapped through the sources' cumulative shares of the
slots, say which source fills slot 0, 1, 2, ...; the r-th slot of a source takes
the r-th of its blocks, again from the first one after the last.  A source's
documents are shuffled by a digest and laid side by side; its blocks cut that
stream into equal numbers of words.  The points put every source within a few
slots of its share at any moment; slots beyond what a source needs are dropped,
missing ones follow at the end, so that in the whole mix each source has its
target to the word.

Running sums never take a hot source in one group: they are taken in leaves of
some thousand rows, parents of leaves, and so on (``operators.prefix``).
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, getcontext

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.operators.prefix import DIGIT, LEAF, leaf_bits, leaf_of, prefix_sums
from seasoncast.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
_BITS = 42  # golden-ratio points are multiples of 2**-42
getcontext().prec = 50
_GOLDEN = int((Decimal(5).sqrt() - 1) / 2 * 2 ** _BITS) | 1


@dataclass(frozen=True)
class MixRules:
    weights: tuple = (5, 2, 1)  # of the sources by code point, null last, repeating
    repeats: int = 3            # how often a source may be taken at most
    block: int = 1024           # words a slot holds at most


def _spread(rows: DataFrame, low, high, name: str) -> DataFrame:
    """A row for each number from ``low`` to ``high``, in two steps, so that no array grows long."""
    far = rows.withColumn("low_", low).withColumn("high_", high).where("low_ <= high_")
    far = far.withColumn("far_", F.explode(F.sequence(F.shiftright("low_", DIGIT), F.shiftright("high_", DIGIT))))
    near = F.sequence(F.greatest("low_", F.col("far_") * LEAF), F.least("high_", F.col("far_") * LEAF + (LEAF - 1)))
    return far.withColumn(name, F.explode(near)).drop("low_", "high_", "far_")


def stacked(docs: DataFrame) -> DataFrame:
    """``source, doc_id, key, size, copies``: equal rows once; ``key`` shuffles the documents of a source."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text))
    sized = docs.select("source", "doc_id", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    return sized.groupBy("source", "doc_id", "key").agg(F.max("size").alias("size"), F.count("*").alias("copies"))


def plan_sources(stacks: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """A row a source: ``sid, source, source_size, rows, target, take, n_blocks, base, extra, need``.

    The share of all words goes by weight; targets stop at ``repeats`` times the
    source, the excess is shared again.  That is one water level ``left /
    weights_left``: with the sources in the order of their limit over weight, it
    is set by the first one that stays below its limit.  ``take`` is the target
    in whole words, ``need`` the blocks that hold it.
    """
    # One row a source from here on: a window without partitions sorts the list of sources.
    sums = stacks.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows"))
    numbered = sums.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in rules.weights]), (F.col("sid") % len(rules.weights) + 1).cast("int"))
    limits = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * rules.repeats)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    water = (limits
             .withColumn("left", F.sum("source_size").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                         - F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("weights", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
             .withColumn("below", F.col("cap").cast("double") * F.col("weights") >= F.col("weight").cast("double") * F.col("left")))
    everything = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (water.withColumn("left_", F.max(F.when(F.col("below"), F.col("left"))).over(everything))
             .withColumn("weights_", F.max(F.when(F.col("below"), F.col("weights"))).over(everything)))
    target = F.when(F.col("below"), (F.col("weight") * F.col("left_")).cast("double") / F.col("weights_").cast("double")).otherwise(F.col("cap").cast("double"))
    taken = level.withColumn("target", target).withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))
    cut = (taken.withColumn("n_blocks", F.greatest(F.expr(f"(source_size + {rules.block - 1}) div {rules.block}"), F.lit(1).cast("long")))
           .withColumn("base", F.expr("source_size div n_blocks")).withColumn("extra", F.expr("source_size % n_blocks"))
           .withColumn("rest", F.expr("take % greatest(source_size, 1)")))
    part = F.expr("case when rest <= extra * (base + 1) then (rest + base) div (base + 1) "
                  "else extra + (rest - extra * (base + 1) + base - 1) div greatest(base, 1) end")
    return (cut.withColumn("need", F.expr("(take div greatest(source_size, 1)) * n_blocks") + part)
            .select("sid", "source", "source_size", "rows", "target", "take", "n_blocks", "base", "extra", "need"))


def _point(slot):
    """``slot x golden ratio`` modulo 1, as a whole number of 2**-42; exact for slots below 2**40."""
    whole, high = 1 << _BITS, (_GOLDEN << 20) % (1 << _BITS)
    return (F.shiftright(slot, 20) * high % whole + slot.bitwiseAND((1 << 20) - 1) * F.lit(_GOLDEN) % whole) % whole


def schedule(sources: DataFrame) -> DataFrame:
    """The slots in order: ``slot, sid, rank, epoch, block, low, words``.

    A slot takes ``words`` words of its source's stream from word ``low`` on:
    block ``block``, for the ``epoch``-th time.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("need")).first()[0] or 0
    ordered = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    shares = sources.where("need > 0").withColumn("from", F.coalesce(F.sum("need").over(ordered), F.lit(0)))
    cells = _spread(shares.select("sid", "from", "need"), F.shiftright("from", 8), F.shiftright(F.col("from") + F.col("need") - 1, 8), "cell")
    at = F.least(F.floor(_point(F.col("slot")).cast("double") * (total / 2.0 ** _BITS)).cast("long"), F.lit(total - 1))
    points = spark.range(total).select(F.col("id").alias("slot")).withColumn("place", at).withColumn("cell", F.shiftright("place", 8))
    dealt = (points.join(cells, "cell").where("place >= from and place < from + need")
             .select("sid", "slot", F.shiftright("slot", DIGIT).alias("at"), F.lit(1).cast("long").alias("one")))
    dealt = materialise(dealt, "slots")
    ranked = prefix_sums(dealt, ["sid"], "at", ["slot"], ["one"], leaf_bits(total)).select("sid", "slot", F.col("before_one").alias("rank"))
    have = dealt.groupBy("sid").agg(F.count("*").alias("have"))
    short = (sources.where("need > 0").join(have, "sid", "left").select("sid", F.coalesce("have", F.lit(0)).alias("have"), "need").where("have < need")
             .withColumn("from", F.coalesce(F.sum(F.col("need") - F.col("have")).over(ordered), F.lit(0))))
    rest = _spread(short, F.col("have"), F.col("need") - 1, "rank").select("sid", (F.lit(total) + F.col("from") + F.col("rank") - F.col("have")).alias("slot"), "rank")
    bound = "({0} * base + least({0}, extra))"
    return (ranked.unionByName(rest).join(sources, "sid").where("rank < need")
            .withColumn("epoch", F.expr("rank div n_blocks")).withColumn("block", F.expr("rank % n_blocks"))
            .withColumn("low", F.expr(bound.format("block")))
            .withColumn("words", F.expr(f"least({bound.format('(block + 1)')} - low, take - epoch * source_size - low)"))
            .select("slot", "sid", "rank", "epoch", "block", "low", "words"))


def place(stacks: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """A row a document: where its words lie in its source's stream, ``sid, source, doc_id, key, copy, size, first`` and the source's figures."""
    bits = leaf_bits(n_rows)
    numbered = (stacks.alias("s").join(sources.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
                .select("sid", "s.source", "doc_id", "key", "size", "copies", (F.col("size") * F.col("copies")).alias("all_size"), leaf_of("key", bits).alias("at"),
                        "source_size", "target", "base", "extra"))
    laid = prefix_sums(numbered, ["sid"], "at", ["key", "doc_id"], ["all_size"], bits)
    return (_spread(laid, F.lit(0).cast("long"), F.col("copies") - 1, "copy")
            .withColumn("first", F.col("before_all_size") + F.col("copy") * F.col("size"))
            .select("sid", "source", "doc_id", "key", "copy", "size", "first", "source_size", "target", "base", "extra"))


def _fragments(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """Documents with the slots that take words of them, ``from_word`` and ``n`` words; those that no slot takes stay once, n = 0."""
    held = ("case when size = 0 then -1 when {0} < extra * (base + 1) then {0} div (base + 1) "
            "else extra + ({0} - extra * (base + 1)) div greatest(base, 1) end")
    cut = _spread(placed, F.expr(held.format("first")), F.expr(held.format("(first + size - 1)")), "block")
    met = cut.join(slots.select("sid", "block", "slot", "epoch", "low", "words"), ["sid", "block"], "left")
    return (met.withColumn("from_word", F.expr("greatest(low - first, 0)"))
            .withColumn("n", F.expr("if(slot is null, 0, greatest(least(low + words, first + size) - greatest(low, first), 0))")))


def _plan(docs: DataFrame, rules: MixRules):
    stacks = materialise(stacked(docs), "stacks")
    sources = materialise(plan_sources(stacks, rules), "sources")
    n_rows = sources.agg(F.sum("rows")).first()[0] or 0
    return place(stacks, sources, n_rows), schedule(sources)


def mix(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """The mix in order of ``slot, first``: ``slot, epoch, source, doc_id, key, first, from_word, n_words``.

    Each row is a run of ``n_words`` words of a document from its word ``from_word`` on.
    """
    placed, slots = _plan(docs, rules)
    return (_fragments(placed, slots).where("n > 0")
            .select("slot", "epoch", "source", "doc_id", "key", "first", "from_word", F.col("n").alias("n_words")))


def mixed_texts(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """:func:`mix` with ``text``: the words of each run, joined by spaces."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text))
    words = docs.select(key.alias("key"), F.col("source").alias("of"), "text").groupBy("key", "of").agg(F.any_value("text").alias("text"))
    run = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int"))
    chosen = mix(docs, rules)
    return (chosen.join(words, (chosen["key"] == words["key"]) & chosen["source"].eqNullSafe(words["of"])).drop(words["key"])
            .select(*chosen.columns, F.array_join(run, " ").alias("text")))


def words_taken(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """A row a document: ``doc_id, source, size, source_size, target, taken``.

    ``docs`` has ``doc_id``, ``text`` and ``source``; more columns are ignored.
    A null text has no words; a null source is a source of its own, the last; a
    null doc_id is an id.  Equal rows are documents of their own, side by side in
    the stream.  Documents without words, and sources without any, take nothing.
    An empty table gives no rows.  Equal input gives the equal mix, however it is partitioned.
    """
    placed, slots = _plan(docs, rules)
    return (_fragments(placed, slots)
            .groupBy("sid", "source", "doc_id", "key", "copy", "size", "source_size", "target").agg(F.sum("n").alias("taken"))
            .select("doc_id", "source", "size", "source_size", "target", "taken"))
