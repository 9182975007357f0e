"""Exact removal of long repeated substrings with suffix arrays built by linear grouping.

Every 200-byte window has an anchor: its leftmost least k-gram hash.  Equal
windows have equal anchors at equal offsets, so they meet in the group of the
anchor's k-gram, wherever they stand.  The windows that one anchor owns form a
context.  Contexts that occur twice repeat as a whole; contexts that share a
k-gram but differ are put into one string, cut into blocks aligned at the
anchor, and a suffix array of that string tells which windows agree.

The suffix array is built by grouping: suffixes are grouped by Lyndon prefix,
from the highest group down; a processed group moves the previous smaller
positions of its members, by how often they are met, into new groups right
above their old ones.  Then the order inside every group follows from the next
smaller suffix of each member, in one sweep and without renaming.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.llm.textvec import Hasher, Piece, mix, pieces
from seasoncast.session import materialise


@dataclass(frozen=True)
class RepeatRules:
    """Production settings."""

    length: int = 200        # bytes of a repeated string
    gram: int = 16           # bytes of an anchor
    block: int = 20          # bytes of a symbol of the suffix array; has to divide length
    crowd: int = 20_000      # contexts of one k-gram that one task sorts (8 MB at most); more are counted window by window
    piece: int = 1 << 19     # bytes of text looked at together
    bitmap: int = 26         # log2 of the bits of the filter for the second scan
    batch: int = 60_000      # symbols of one suffix array


def suffix_array(s: list) -> list:
    """Suffix array of a sequence of non-negative numbers; a suffix is less than its extensions."""
    n = len(s)
    group, members, above, below = [0] * n, [], [], []
    by_symbol = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        above.append(g + 1)
        below.append(g - 1)
        for i in by_symbol[c]:
            group[i] = g
    if not n:
        return []
    top = len(members) - 1
    above[top] = -1
    # skip[i]: nearest position at or before i whose group is still to come, found with path halving; 0 is before all
    skip, length, end, start = list(range(n + 1)), [1] * n, n, {}
    g = top
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        end -= len(own)
        start[g] = end
        for i in own:
            skip[i + 1] = i
        met = {}
        for i in own:
            j = i
            while skip[j] != j:
                skip[j] = skip[skip[j]]
                j = skip[j]
            if j:
                met[j - 1] = met.get(j - 1, 0) + 1
                length[j - 1] += length[i]
        if met:
            moved = {}
            for p, times in met.items():
                moved.setdefault((group[p], times), []).append(p)
            for old, times in sorted(moved, key=lambda m: -m[1]):  # the most often met end up highest
                new = len(members)
                members.append(moved[old, times])
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for p in moved[old, times]:
                    group[p] = new
        g = below[g]
    waits = [[] for _ in range(n + 1)]
    for i in range(n):
        waits[i + length[i]].append(i)  # its next smaller suffix
    out = [0] * n
    for k in range(-1, n):
        for i in waits[out[k] if k >= 0 else n]:
            out[start[group[i]]] = i
            start[group[i]] += 1
    return out


def contexts(piece: Piece, rules: RepeatRules):
    """Anchors of all windows of a piece: ``(document, anchor, first and last window, k-gram hash, context digest)``."""
    n, span, hashes = len(piece.data), rules.length - rules.gram + 1, piece.hasher
    none = (np.zeros(0, np.int64),) * 6
    if n < rules.length:
        return none
    at = np.arange(n - rules.gram + 1)
    gram = hashes(at, at + rules.gram)
    mask = np.uint64((1 << int(n).bit_length()) - 1)
    value = np.concatenate([(gram & ~mask) | at.astype(np.uint64), np.full(-len(at) % span, ~np.uint64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(value, axis=1).ravel()
    behind = np.minimum.accumulate(value[:, ::-1], axis=1)[:, ::-1].ravel()
    window = np.arange(n - rules.length + 1)
    anchor = (np.minimum(behind[window], ahead[window + span - 1]) & mask).astype(np.int64)
    doc = piece.doc_of(window)
    inside = piece.bounds[doc + 1] >= window + rules.length
    window, anchor, doc = window[inside], anchor[inside], doc[inside]
    if not len(window):
        return none
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    lo, hi = window[first], window[np.r_[first[1:], len(window)] - 1]
    anchor, doc = anchor[first], doc[first]
    digest = mix(hashes(lo, hi + rules.length) ^ mix((anchor - lo).astype(np.uint64)))
    return doc, anchor, lo, hi, gram[anchor].view(np.int64), digest.view(np.int64)


def context_counts(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """``(gram, ctx, n, k)`` of the contexts that occur ``n > 1`` times or share their k-gram with others (``k > 1``)."""
    def run(batches):
        for batch in batches:
            rows = [np.stack(contexts(p, rules)[4:], axis=1) for p in pieces(batch.column(0), rules.piece)]
            rows = np.concatenate(rows) if rows else np.zeros((0, 2), np.int64)
            order = np.lexsort((rows[:, 1], rows[:, 0]))
            rows = rows[order]
            new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[new, 0])), pa.array(np.ascontiguousarray(rows[new, 1])),
                                              pa.array(np.diff(np.r_[new, len(rows)]))], ["gram", "ctx", "n"])

    counted = docs.select("text").mapInArrow(run, "gram long, ctx long, n long").groupBy("gram", "ctx").agg(F.sum("n").alias("n"))
    return counted.withColumn("k", F.count("*").over(Window.partitionBy("gram"))).where("n > 1 or k > 1")


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Bits of the low parts of the ids, as 64-bit words: a filter of fixed size, or-ed together by Spark."""
    low = F.col("ctx").bitwiseAND(F.lit((1 << bits) - 1))
    words = (ids.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(ctx & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().view(np.uint64)
    return out


def _marked(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = ids.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0


OCCURRENCES = "key long, gram long, ctx long, lo long, hi long, off long, raw binary"


def occurrences(keyed: DataFrame, counts: DataFrame, rules: RepeatRules) -> DataFrame:
    """Contexts that may repeat, once a text and partition; ``raw`` has the bytes of those with rivals, once a partition.

    The filters let some others pass, which find no partner later.
    """
    spark = keyed.sparkSession
    any_, rivals = (spark.sparkContext.broadcast(_bitmap(x.select("ctx"), rules.bitmap)) for x in (counts, counts.where("k > 1")))

    def run(batches):
        texts, shown = set(), set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for piece in pieces(batch.column(1), rules.piece):
                doc, anchor, lo, hi, gram, ctx = contexts(piece, rules)
                if not len(doc):
                    continue
                own = keys[piece.first:piece.first + piece.n]
                fresh = np.array([not (k in texts or texts.add(k)) for k in own.tolist()])
                pick = np.flatnonzero(fresh[doc] & _marked(any_.value, ctx))
                bare = _marked(rivals.value, ctx[pick])
                data = piece.data.tobytes()
                raw = [data[a:b + rules.length] if s and not (c in shown or shown.add(c)) else None
                       for a, b, s, c in zip(lo[pick].tolist(), hi[pick].tolist(), bare.tolist(), ctx[pick].tolist())]
                base = piece.bounds[doc[pick]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[doc[pick]]), pa.array(gram[pick]), pa.array(ctx[pick]), pa.array(lo[pick] - base), pa.array(hi[pick] - base),
                     pa.array(anchor[pick] - lo[pick]), pa.array(raw, pa.binary())], [x.split()[0] for x in OCCURRENCES.split(", ")])

    return keyed.mapInArrow(run, OCCURRENCES)


def _rivals(rows: list, rules: RepeatRules) -> np.ndarray:
    """Which contexts ``(off, raw)`` may share a window with another one.

    A window holds its anchor, so its core of whole blocks has the block before
    the anchor and the one at it, or the two before it, or the two from it on;
    a context none of whose three pairs of blocks is another's has no partner.
    """
    data = np.frombuffer(b"".join(r for _, r in rows), np.uint8)
    length = np.array([len(r) for _, r in rows])
    base = np.cumsum(length) - length
    off, hashes = np.array([o for o, _ in rows]), Hasher(data)
    found = np.zeros(len(rows), bool)
    for back in (0, 1, 2):  # blocks of the pair that lie before the anchor
        start = off - back * rules.block
        fits = np.flatnonzero((start >= 0) & (start + 2 * rules.block <= length))
        at = base[fits] + start[fits]
        _, which, times = np.unique(hashes(at, at + 2 * rules.block), return_inverse=True, return_counts=True)
        found[fits[times[which] > 1]] = True
    return found


def _repeating(rows: list, rules: RepeatRules):
    """Windows of some contexts ``(off, raw)`` that are met in more than one: ``(context, first, last window)`` runs."""
    kept = np.flatnonzero(_rivals(rows, rules)).tolist()
    return [(kept[c], a, b) for c, a, b in _sorted_repeats([rows[i] for i in kept], rules)] if len(kept) > 1 else []


def _sorted_repeats(rows: list, rules: RepeatRules):
    """:func:`_repeating` of contexts that may be partners, by the suffix array of all of them."""
    size, block, core = rules.length, rules.block, rules.length // rules.block - 1
    data = np.frombuffer(b"".join(r for _, r in rows), np.uint8)
    length = np.array([len(r) for _, r in rows])
    base = np.cumsum(length) - length
    off = np.array([o for o, _ in rows])
    shift = off % block
    n_blocks = (length - shift) // block
    hashes = Hasher(data)
    # symbols: the blocks of all contexts, each context closed by a symbol of its own that is less than every block
    owner = np.repeat(np.arange(len(rows)), n_blocks)
    first = np.cumsum(n_blocks) - n_blocks
    at = base[owner] + shift[owner] + (np.arange(len(owner)) - first[owner]) * block
    _, symbol = np.unique(hashes(at, at + block), return_inverse=True)
    place = np.arange(len(owner)) + owner
    text = np.empty(len(owner) + len(rows), np.int64)
    text[place] = symbol + len(rows)
    text[first + n_blocks + np.arange(len(rows))] = np.arange(len(rows))
    order = np.array(suffix_array(text.tolist()), np.int64)
    reach = np.arange(core)
    rows_of = np.minimum(order[:, None] + reach, len(text) - 1)
    seen = text[rows_of]
    same = (seen[1:] == seen[:-1]).all(axis=1)  # a closing symbol is nobody else's
    rank = np.empty(len(text), np.int64)
    rank[order] = np.cumsum(np.r_[0, ~same])
    # a window is its core of whole blocks, its offset from the anchor, and the bytes before and after the core
    n_windows = length - size + 1
    ctx = np.repeat(np.arange(len(rows)), n_windows)
    r = np.arange(len(ctx)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    j = np.maximum(-(-(r - shift[ctx]) // block), 0)
    left = base[ctx] + shift[ctx] + j * block
    key = mix(rank[first[ctx] + ctx + j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix((off[ctx] - r + size).astype(np.uint64)))
    key = mix(key ^ hashes(base[ctx] + r, left))
    key = mix(key + hashes(left + core * block, base[ctx] + r + size))
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[which] > 1)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.r_[True, (ctx[hit][1:] != ctx[hit][:-1]) | (r[hit][1:] != r[hit][:-1] + 1)])
    last = hit[np.r_[cut[1:], len(hit)] - 1]
    return list(zip(ctx[hit[cut]].tolist(), r[hit[cut]].tolist(), r[last].tolist()))


def repeats_in_groups(bare: DataFrame, rules: RepeatRules) -> DataFrame:
    """``(gram, ctx, from, to)``: runs of windows, counted from the context's first, that another context of the k-gram holds too.

    A task takes the k-grams dealt to it and sorts several of them in one
    suffix array, at most about ``rules.batch`` symbols.
    """
    def flush(held):
        for c, a, b in _repeating([(o, r) for _, _, o, r in held], rules):
            yield held[c][0], held[c][1], a, b

    def run(batches):
        held, group, last, symbols, out = [], {}, None, 0, []

        def close():
            nonlocal symbols
            if len(group) > 1:
                held.extend((last, c, o, r) for c, (o, r) in group.items())
                symbols += sum(len(r) for _, r in group.values()) // rules.block
            if symbols > rules.batch:
                out.extend(flush(held))
                held.clear()
                symbols = 0

        def send():
            cols = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["gram", "ctx", "from", "to"])

        for batch in batches:
            for gram, ctx, off, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if gram != last:
                    close()
                    group, last = {}, gram
                group.setdefault(ctx, (off, raw))
            yield send()
        close()
        if held:
            out.extend(flush(held))
        yield send()

    return (bare.select("gram", "ctx", "off", "raw").repartition(F.col("gram")).sortWithinPartitions("gram")
            .mapInArrow(run, "gram long, ctx long, from long, to long"))


def repeats_by_window(bare: DataFrame, rules: RepeatRules) -> DataFrame:
    """The same for k-grams with more contexts than a task should sort: windows are counted one by one, map side first."""
    def run(batches):
        for batch in batches:
            for piece in pieces(_as_text(batch.column(3)), rules.piece):
                own = slice(piece.first, piece.first + piece.n)
                n = np.maximum(np.diff(piece.bounds) - rules.length + 1, 0)
                doc = np.repeat(np.arange(piece.n), n)
                r = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                at = piece.bounds[doc] + r
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece.hasher(at, at + rules.length).view(np.int64)), *(pa.array(batch.column(i).to_numpy()[own][doc]) for i in (0, 1)), pa.array(r)],
                    ["window", "gram", "ctx", "from"])

    seen = bare.dropDuplicates(["gram", "ctx"]).select("gram", "ctx", "off", "raw").mapInArrow(run, "window long, gram long, ctx long, from long")
    often = seen.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return seen.join(often, "window").select("gram", "ctx", "from", F.col("from").alias("to"))


def _as_text(column):
    """Binary values as a string column without copying; only their bytes are looked at."""
    wide = column.cast(pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(wide), wide.buffers(), wide.null_count, wide.offset)


def repeated_spans(keyed: DataFrame, rules: RepeatRules) -> DataFrame:
    """``(key, spans)``: runs of repeating windows, ``(first, last)`` byte starts, of every text that has some."""
    counts = materialise(context_counts(keyed, rules), "context-counts")
    found = materialise(occurrences(keyed, counts, rules), "occurrences")
    bare = found.where("raw is not null")
    crowds = counts.where(F.col("k") > rules.crowd).select("gram").distinct()
    parts = repeats_in_groups(bare.join(crowds, "gram", "left_anti"), rules).union(repeats_by_window(bare.join(crowds, "gram", "left_semi"), rules))
    places = found.select("key", "gram", "ctx", "lo", "hi")
    whole = places.join(counts.where("n > 1").select("gram", "ctx"), ["gram", "ctx"]).select("key", "lo", "hi")
    partly = (places.join(materialise(parts.distinct(), "parts"), ["gram", "ctx"])
              .select("key", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi")))
    return whole.union(partly).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Every byte covered by a string of ``rules.length`` bytes that also starts
    elsewhere - in another row or the same one, overlapping or not - goes;
    ``kept`` has the remaining bytes.  A null text is empty; repeated rows are
    copies of each other; null ids are returned like others; extra columns are
    ignored; an empty table gives no rows.
    """
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    spans = materialise(repeated_spans(keyed, rules), "spans")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).join(spans, "key", "left")

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, runs = text.encode("utf-8", "surrogatepass"), []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi + rules.length)
                    else:
                        runs.append([lo, hi + rules.length])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else data
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
