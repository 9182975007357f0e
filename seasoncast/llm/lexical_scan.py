"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index over them.

The distinct terms of all items make one automaton; every pattern is a term
between two guards (spaces), and texts are folded so that each separator is a
space, so only maximal terms match.  One scan counts the corpus statistics
(documents, terms, document frequencies of the item terms), a second one scores
each document straight from its text: term frequencies out of the automaton,
mapped to the items that hold the term.

A task keeps the best documents of every item it has seen, so what leaves it is
bounded by items x ``top``, whatever the size of its input.  Items are taken in
blocks of at most ``block_bytes`` of terms; only a block's terms, weights and
item lists are broadcast.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.llm.textvec import pieces
from seasoncast.session import materialise

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ScanRules:
    top: int = 50                # documents an item returns
    block_bytes: int = 1 << 20   # bytes of item terms in one automaton
    lanes: int = 256             # groups of documents in which the tasks' lists are merged first
    cells: int = 1 << 21         # (document, item) scores held at once in a task


# Every ASCII character that is no letter or digit separates; A-Z fold to a-z; other bytes stay.
_GUARDED = np.arange(256, dtype=np.uint8)
_GUARDED[65:91] += 32
_GUARDED[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
_HIT = np.dtype([("end", np.int64), ("term", np.int64)])
_N, _L = -1, -2  # rows of the statistics that count documents and terms


@functools.lru_cache(maxsize=2)
def _automaton(terms: tuple[bytes, ...]):
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(terms):
        found.add_word(f" {term.decode('latin-1')} ", i)
    found.make_automaton()
    return found


def _scan(column, automaton, n_terms: int):
    """Per piece of texts: its first row, terms of each text, and the (text, term, tf) that the automaton finds."""
    for piece in pieces(column):
        guarded = np.insert(_GUARDED[piece.data], piece.bounds, 0x20)  # a guard before each text and behind the last
        guards = piece.bounds + np.arange(piece.n + 1)
        ink = guarded != 0x20
        starts = np.flatnonzero(ink[1:] & ~ink[:-1]) + 1
        n = np.diff(np.searchsorted(starts, guards))
        hits = np.fromiter(automaton.iter(guarded.tobytes().decode("latin-1")), _HIT) if n_terms else np.zeros(0, _HIT)
        doc = np.searchsorted(guards, hits["end"] - 1, side="right") - 1
        key, tf = np.unique(doc * max(n_terms, 1) + hits["term"], return_counts=True)
        yield piece.first, n, key // max(n_terms, 1), key % max(n_terms, 1), tf


def _statistics(terms):
    def run(batches):
        words = terms.value
        automaton = _automaton(words)
        df, docs, total = np.zeros(len(words), np.int64), 0, 0
        for batch in batches:
            for _, n, _, term, _ in _scan(batch.column(0), automaton, len(words)):
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
                df += np.bincount(term, minlength=len(words))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(seen, [_N, _L]), "count": np.append(df[seen], [docs, total])})
    return run


class _Best:
    """The ``top`` best (score, document) of every item, of all that was offered."""

    def __init__(self, items: int, top: int):
        self.items, self.top, self.least = items, top, np.ones(items)
        self.held, self.size = [], 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray):
        doc, item = np.nonzero(scores >= self.least)
        self.held.append((item, scores[doc, item], nameless[doc], ids[doc]))
        self.size += len(doc)
        if self.size > 2 * self.items * self.top:
            self.prune()

    def prune(self):
        item, score, nameless, ids = (np.concatenate(c) for c in zip(*self.held)) if self.held else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((ids, nameless, -score, item))
        item, score, nameless, ids = item[order], score[order], nameless[order], ids[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.top - 1
        self.least[item[last]] = score[last]
        keep = rank < self.top
        self.held, self.size = [(item[keep], score[keep], nameless[keep], ids[keep])], int(keep.sum())
        return self.held[0]


def _search(plan, rules: ScanRules):
    def run(batches):
        words, weights, first, held_by, items, n_docs, n_terms = plan.value
        automaton = _automaton(words)
        best = _Best(items, rules.top)
        for batch in batches:
            ids, nameless = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for at, n, doc, term, tf in _scan(batch.column(0), automaton, len(words)):
                m = np.array([50 + 50 * int(x) * n_docs // n_terms if x else 50 for x in n], np.int64)
                gain = (weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))).astype(np.float64)
                for low, block in _item_scores(doc, gain, first[term], first[term + 1], held_by, items, len(n), rules.cells):
                    here = slice(at + low, at + low + len(block))
                    best.offer(block, ids[here], nameless[here])
        item, score, nameless, ids = best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score.astype(np.int64)), pa.array(ids, pa.int64(), mask=nameless.astype(bool))],
                                         ["item", "score", "doc_id"])
    return run


def _item_scores(doc, gain, lo, hi, held_by, items: int, n: int, cells: int):
    """Blocks of documents with their scores by item: ``(first document, documents x items)``.

    Sums of integers below 2**53, so doubles add them exactly.
    """
    step = max(1, cells // items)
    for low in range(0, n, step):
        rows = min(step, n - low)
        scores = np.zeros(rows * items)
        a, b = np.searchsorted(doc, [low, low + rows])
        reach = np.concatenate([[0], np.cumsum(hi[a:b] - lo[a:b])])
        while a < b:  # hits in order, so many at a time that their item lists fit
            more = max(1, int(np.searchsorted(reach, reach[0] + cells, side="right")) - 1)
            c, spread = a + more, reach[1:more + 1] - reach[:more]
            at = np.repeat(lo[a:c] - (reach[:more] - reach[0]), spread) + np.arange(spread.sum())
            cell = np.repeat((doc[a:c] - low) * items, spread) + held_by[at]
            scores += np.bincount(cell, np.repeat(gain[a:c], spread), minlength=rows * items)
            a, reach = c, reach[more:]
        yield low, scores.reshape(rows, items)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the distinct folded terms of every item; rows of one id are one item."""
    folded = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return items.select("item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def _best_of(found: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _block(docs: DataFrame, block: DataFrame, rules: ScanRules) -> DataFrame:
    spark = docs.sparkSession
    pairs = block.toArrow().to_pydict()  # at most block_bytes of terms
    words = sorted({t.encode() for t in pairs["term"]})
    number = {w: i for i, w in enumerate(words)}
    ids = sorted(set(pairs["item_id"]), key=lambda i: (i is None, i))
    place = {x: i for i, x in enumerate(ids)}
    terms = np.array([number[t.encode()] for t in pairs["term"]], np.int64)
    held = np.array([place[i] for i in pairs["item_id"]], np.int64)
    held_by = held[np.argsort(terms, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(words)))])
    words = tuple(words)

    text = docs.select("text")
    counted = text.mapInArrow(_statistics(spark.sparkContext.broadcast(words)), "term long, count long")
    counts = {r["term"]: r["count"] for r in counted.groupBy("term").agg(F.sum("count").alias("count")).collect()}
    n_docs, n_terms = counts.get(_N, 0), counts.get(_L, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(words))], np.int64)
    plan = spark.sparkContext.broadcast((words, weights, first, held_by, len(ids), n_docs, n_terms))
    found = docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_search(plan, rules), "item long, score long, doc_id long")
    found = found.withColumn("lane", F.pmod(F.xxhash64("doc_id"), F.lit(rules.lanes)))
    named = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"item long, item_id {block.schema['item_id'].dataType.simpleString()}")
    return (_best_of(_best_of(found, ["item", "lane"], rules.top), ["item"], rules.top)
            .join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, rules: ScanRules = ScanRules()) -> DataFrame:
    """The ``top`` documents of every item with a score above 0: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id`` (integer) and ``text``, ``items`` ``item_id`` and
    ``text``; more columns of any name are ignored.  Terms are maximal runs of
    ASCII letters, digits and any non-ASCII characters, A-Z folded.  With N
    documents that hold a term, L terms in all, n of a document, df documents
    with a term and tf of it in the document, a document gains for every
    distinct term of the item ``w * (10^9 tf div (1000 tf + 20 m))``, where
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, ``m = 50 + 50 n N div L``.
    Equal scores rank by doc_id, null ids last.  A null text has no terms;
    repeated document rows are documents of their own; rows of one item_id (null
    counts as an id) are one item.  Items without terms and items that no
    document meets return no rows; nor do empty tables.  Texts are read whole.
    """
    terms = materialise(item_terms(items), "terms")
    size = terms.agg(F.sum(F.octet_length("term") + F.lit(2))).first()[0] or 0
    blocks = max(1, math.ceil(size / rules.block_bytes))
    if blocks == 1:
        return _block(docs, terms, rules)
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return functools.reduce(DataFrame.unionAll, [_block(docs, terms.where(part == b), rules) for b in range(blocks)])
