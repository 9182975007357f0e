"""Benchmark decontamination by edit distance.

Benchmark items and the item-sized windows of each document are strings of
folded words.  The CGK random walk maps such a string to one of three times
its length, so that a small edit distance becomes a small Hamming distance;
sampled positions of the walk are LSH keys, and samplings are repeated until
items with as many random edits as allowed are found again at the target
recall.  Windows that share a key with an item are verified by the exact edit
distance: with ``any_length`` to the nearest run of words that begins with the
window and ends anywhere, up to the allowed edits beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.llm.textvec import mix, pieces

PAD, OTHER = 0, 1  # past the end of a window; a word that no item has


@dataclass(frozen=True)
class EditRules:
    """``max_edits`` is a share of an item's words (edit similarity 0.8 or more); ``WHOLE`` are the production settings."""

    max_edits: float = 0.2
    min_words: int = 5        # shorter items say too little to convict a document
    recall: float = 0.995     # to be reached on items with the most edits allowed
    walks: int = 6
    sample: int = 2           # positions of the walk in a key
    max_keys: int = 40        # keys a walk at most
    seed: int = 20
    any_length: bool = False  # compare with runs of words of any length, not with windows of the item's length only


WHOLE = EditRules(any_length=True)


def _embed(symbols: np.ndarray, bits: np.ndarray, upto: int) -> np.ndarray:
    """CGK walk of each row: read the symbol at the pointer, which a random bit of (step, symbol) moves on."""
    rows, width = symbols.shape
    padded = np.concatenate([symbols, np.full((rows, 1), PAD, symbols.dtype)], axis=1)
    at, row = np.zeros(rows, np.int64), np.arange(rows)
    out = np.empty((upto, rows), symbols.dtype)
    for step in range(upto):
        out[step] = padded[row, at]
        at = np.minimum(at + bits[step, out[step]], width)
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the rows of ``a`` to every beginning of those of ``b``."""
    n, steps = a.shape[1], np.arange(b.shape[1] + 1)
    row = np.broadcast_to(steps, (len(a), len(steps))).copy()
    for i in range(n):
        change = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i:i + 1] != b))
        row = np.concatenate([np.full((len(a), 1), i + 1), change], axis=1) - steps
        row = np.minimum.accumulate(row, axis=1) + steps
    return row


def edit_distance(a: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Levenshtein distance of row pairs; rows of ``b`` end at ``b_len``."""
    return _distances(a, b)[np.arange(len(a)), b_len]


def nearest_end(a: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Least Levenshtein distance of the rows of ``a`` to a beginning of those of ``b``, up to ``b_len``."""
    row = _distances(a, b)
    return np.where(np.arange(row.shape[1]) <= b_len[:, None], row, a.shape[1] + b.shape[1]).min(axis=1)


class ItemIndex:
    """Sampled walk positions of the items, by their number of words."""

    def __init__(self, items: list, rules: EditRules):
        self.rules = rules
        texts = pa.array([t for _, t in items], pa.large_string())
        words = []
        for piece in pieces(texts, fold=True):
            start, end, doc = piece.words()
            hashes = piece.hasher(start, end)
            words += [hashes[doc == i] for i in range(piece.n)]
        kept = [(i, w) for (i, _), w in zip(items, words) if len(w) >= rules.min_words]
        self.vocabulary = np.unique(np.concatenate([w for _, w in kept])) if kept else np.zeros(0, np.uint64)
        self.grams = [np.unique(np.concatenate([g[at] for _, w in kept for g, at in [self._grams(self.symbols(w), np.zeros(len(w)), k)]] or [np.zeros(0, np.int64)]))
                      for k in (1, 2, 3)]
        rng = np.random.default_rng(rules.seed)
        longest = max([len(w) for _, w in kept], default=0)
        self.bits = rng.integers(0, 2, (rules.walks, 3 * longest // 2, len(self.vocabulary) + 2), dtype=np.uint8)
        self.by_size = {}
        for size in sorted({len(w) for _, w in kept}):
            ids = np.array([i for i, w in kept if len(w) == size], np.int64)
            symbols = np.stack([np.searchsorted(self.vocabulary, w) + 2 for _, w in kept if len(w) == size]).astype(np.int32)
            # a walk moves on half a word a step: beyond 1.5 * size many have read all and agree by that alone
            spots = [np.sort(rng.integers(0, 3 * size // 2, (rules.max_keys, rules.sample)), axis=1) for _ in range(rules.walks)]
            self.by_size[size] = [ids, symbols, spots, rules.max_keys]
        for size in self.by_size:
            self.by_size[size][3] = self._enough(size, rng)

    def allowed(self, size: int) -> int:
        return int(self.rules.max_edits * size + 1e-9)

    def width(self, size: int) -> int:
        """Words after the start of a window that an item of ``size`` words may match."""
        return size + (self.allowed(size) if self.rules.any_length else 0)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), OTHER, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, OTHER).astype(np.int32)

    def _keys(self, size: int, symbols: np.ndarray, n_keys: int):
        """Yield for each repetition the keys of the rows."""
        _, _, spots, _ = self.by_size[size]
        for walk in range(self.rules.walks):
            chosen = spots[walk][:n_keys]
            out = _embed(symbols, self.bits[walk], int(chosen.max()) + 1)
            for k, places in enumerate(chosen):
                key = np.full(symbols.shape[0], walk * 4096 + k, np.uint64)
                for p in places:
                    key = mix(key ^ (out[p].astype(np.uint64) + np.uint64(p << 40)))
                yield key

    def _enough(self, size: int, rng) -> int:
        """Keys a walk that find items with the most edits allowed again at the target recall."""
        _, symbols, _, most = self.by_size[size]
        edits = self.allowed(size)
        if not edits:
            return 1
        trials = np.repeat(symbols, max(1, 256 // len(symbols)), axis=0)
        changed = np.full_like(trials, PAD)
        for r, row in enumerate(trials.tolist()):
            for kind, at in zip(rng.integers(0, 3, edits), rng.random(edits)):
                at = int(at * len(row))
                row[at:at + (kind < 2)] = [OTHER] if kind else []  # 0: leave out, 1: replace, 2: put in
            row = (row + [OTHER] * size)[:size]
            changed[r] = row
        seen = np.zeros((self.rules.walks, most, len(trials)), bool)
        for n, (a, b) in enumerate(zip(self._keys(size, trials, most), self._keys(size, changed, most))):
            seen[n // most, n % most] = a == b
        for n_keys in (1, 2, 4, 8, 16, 24, 32):
            if n_keys < most and seen[:, :n_keys].any(axis=(0, 1)).mean() >= self.rules.recall:
                return n_keys
        return most

    def _grams(self, symbols: np.ndarray, doc: np.ndarray, k: int):
        """Codes of the runs of ``k`` words, and where such a run of item words lies within one document."""
        n, code, good = len(symbols) - k + 1, 0, True
        if n <= 0:
            return np.zeros(len(symbols), np.int64), np.zeros(0, np.int64)
        for j in range(k):
            code = code * (len(self.vocabulary) + 2) + symbols[j:n + j].astype(np.int64)
            good = good & (symbols[j:n + j] > OTHER)
        return code, np.flatnonzero(good & (doc[:n] == doc[k - 1:]))

    def _within_reach(self, symbols: np.ndarray, doc: np.ndarray, last: np.ndarray):
        """For each item size the starts of windows that may be within the allowed edits.

        An edit spoils k runs of k words at most, so a run of words within reach
        of an item holds all but k * edits of its runs, for every k; the
        three-word runs are counted by their different ones.  Counted are all
        in the ``width`` words that may match.
        """
        counts = []
        for k, known in enumerate(self.grams, 1):
            code, at = self._grams(symbols, doc, k)
            hit = np.zeros(len(symbols) + 1, np.int64)
            spot = np.minimum(np.searchsorted(known, code[at]), len(known) - 1)
            own = known[spot] == code[at]
            if k == 3:  # a run equal to the one before it counts once: "ha ha ha ha" is no item
                own &= (at == 0) | (code[at] != code[at - 1])
            hit[1:][at[own]] = 1
            counts.append(np.cumsum(hit))
        need = {size: [size - allowed, size - 1 - 2 * allowed, int(self._triples(items).min()) - 1 - 3 * allowed]
                for size, (_, items, *_) in self.by_size.items() for allowed in [self.allowed(size)]}
        widest, least = max(self.width(size) for size in need), [min(n[k] for n in need.values()) for k in range(3)]
        everywhere = np.arange(len(symbols))

        def held(at, size, k):
            stop = np.minimum(at + size, last[at]) - k
            return counts[k][np.maximum(stop, at)] - counts[k][at]

        base = everywhere[held(everywhere, widest, 2) >= least[2]]
        for size, floors in need.items():
            at = base
            for k in (2, 1, 0):
                at = at[held(at, self.width(size), k) >= floors[k]]
            yield size, at

    def windows(self, symbols: np.ndarray, doc: np.ndarray):
        """``(size, windows, lengths, documents)`` within reach of some item, ``width`` words each; short windows are padded."""
        if not len(symbols) or not self.by_size:
            return
        last = np.searchsorted(doc, doc, side="right")  # end of each word's document
        for size, starts in self._within_reach(symbols, doc, last):
            if len(starts):
                width = self.width(size)
                stop = np.minimum(starts + width, last[starts])
                at = starts[:, None] + np.arange(width)
                yield size, np.where(at < stop[:, None], symbols[np.minimum(at, len(symbols) - 1)], PAD), stop - starts, doc[starts]

    def search(self, windows: list) -> list:
        """``(doc, item, distance, size)`` of the best window for each document and item found in it."""
        found = {}
        for size in self.by_size:
            own = [w for w in windows if w[0] == size]
            if own:
                self._match(size, *(np.concatenate([w[k] for w in own]) for k in (1, 2, 3)), found)
        return sorted((d, i, dist, size) for (d, i), (dist, size) in found.items())

    def _triples(self, rows: np.ndarray) -> np.ndarray:
        """How many different runs of three item words each row holds."""
        if rows.shape[1] < 3:
            return np.zeros(len(rows), np.int64)
        m, wide = len(self.vocabulary) + 2, rows.astype(np.int64)
        code = (wide[:, :-2] * m + wide[:, 1:-1]) * m + wide[:, 2:]
        known = self.grams[2]
        code = np.sort(np.where(known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code, code, -1), axis=1)
        return (code[:, 0] >= 0) + ((code[:, 1:] > code[:, :-1]) & (code[:, 1:] >= 0)).sum(axis=1)

    def _rich(self, windows: np.ndarray, size: int, items: np.ndarray) -> np.ndarray:
        """Windows with enough different runs of three words for some item; repetitive ones fail."""
        least = int(self._triples(items).min()) - 3 * self.allowed(size)
        return self._triples(windows) >= least

    def _match(self, size, windows, length, doc, found):
        ids, items, _, n_keys = self.by_size[size]
        allowed = self.allowed(size)
        code = np.zeros(len(windows), np.uint64)
        for column in windows.T:
            code = code * np.uint64(0x9E3779B97F4A7C15) + mix(column)
        # equal windows, as in repetitive texts, are looked up once
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        rich = self._rich(windows[first], size, items)
        first, which = first[rich], np.where(rich, np.cumsum(rich) - 1, -1)[which]
        windows, length = windows[first], length[first]
        pairs = []
        for own, keys in zip(self._keys(size, items, n_keys), self._keys(size, np.ascontiguousarray(windows[:, :size]), n_keys)):
            order = np.argsort(own, kind="stable")
            low, high = (np.searchsorted(own[order], keys, side=s) for s in ("left", "right"))
            hit = np.flatnonzero(high > low)
            for k in range(int((high - low).max(initial=0))):
                row = hit[high[hit] - low[hit] > k]
                pairs.append(row * len(ids) + order[low[row] + k])
        if not pairs:
            return
        matched = []
        for part in np.array_split(pair := np.unique(np.concatenate(pairs)), len(pair) // 8192 + 1):
            w, i = part // len(ids), part % len(ids)
            distance = (nearest_end if self.rules.any_length else edit_distance)(items[i], windows[w], length[w])
            near = np.flatnonzero(distance <= allowed)
            matched += zip(w[near].tolist(), ids[i[near]].tolist(), distance[near].tolist())
        if matched:
            order = np.argsort(which, kind="stable")
            ends = np.searchsorted(which[order], np.arange(len(first) + 1))
            for w, item, distance in matched:
                for d in np.unique(doc[order[ends[w]:ends[w + 1]]]).tolist():
                    found[d, item] = min(found.get((d, item), (size + 1, size)), (distance, size))


def item_indexes(benchmark: DataFrame, rules: EditRules = EditRules(), block_mb: int = 8) -> list:
    """One broadcast index for each block of items; a block holds about ``block_mb`` MB of item text at most.

    Items are dealt to blocks by a hash of the id, so a benchmark of any size
    is searched block by block against all documents.
    """
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(size // (block_mb << 20)) + 1
    out = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        out.append(spark.sparkContext.broadcast(ItemIndex(sorted((r[0], r[1]) for r in rows), rules)))
    return out


def _found(column, index: ItemIndex, most: int = 200_000) -> list:
    """Hits of a whole column; windows of its pieces are looked up together, at most about ``most`` at once."""
    held, hits = [], []
    for piece in pieces(column, fold=True):
        start, end, doc = piece.words()
        held += index.windows(index.symbols(piece.hasher(start, end)), doc + piece.first)
        if sum(len(w[1]) for w in held) > most:
            hits, held = hits + index.search(held), []
    return hits + index.search(held)


def leaks(docs: DataFrame, benchmark: DataFrame, rules: EditRules = EditRules()) -> DataFrame:
    """``doc_id, item_id, distance, item_words`` for each item found in a document, best window.

    Words are compared folded (Latin-1 case and ASCII punctuation do not count).  A
    match is a window as long as the item - shorter only at a text's end -
    within ``max_edits`` word edits; with ``any_length`` (``WHOLE``) a run of
    words of any length within them, as when words are only put in or left out.  Null and empty texts or items match
    nothing, items of under ``min_words`` words are left out; repeated rows of
    ``docs`` are reported each; extra columns are ignored.
    """
    out = None
    for index in item_indexes(benchmark, rules):
        def run(batches, index=index):
            for batch in batches:
                hits = _found(batch.column(1), index.value)
                if hits:
                    d, i, e, n = zip(*hits)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), *(pa.array(x, pa.int64()) for x in (i, e, n))],
                                                     ["doc_id", "item_id", "distance", "item_words"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance long, item_words long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: EditRules = EditRules()) -> DataFrame:
    """The documents, with all their columns, in which no benchmark item is found."""
    at = docs.columns.index("text")
    for index in item_indexes(benchmark, rules):
        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in _found(batch.column(at), index.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
