"""N-best SentencePiece segmentation, encoding and decoding.

The lattice of a text has an arc for each vocabulary piece that matches.
Forward Viterbi scores of all positions are exact heuristics for an A* search
from the end of the lattice back to its start, which therefore yields the
segmentations best first.  No piece spans a word start or a line end, so the
lattice falls apart into units (a word with the spaces before it, a run of
spaces, a line end): equal units are searched once a worker, and the N best of
the text are combined from the units' own by the same kind of search.
Segmentations 2 to N differ from the best one in at most N - 1 units; they are
given as edits of it, the ids that take the place of some of its own.
Scores are integers (millionths), so ties are exact and results the same
everywhere.  Of equal scores the best one is the one that the forward search
meets first, the others follow in the order of the search; both depend on the
text alone.  Texts of any length are segmented whole.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seasoncast.llm.textvec import small

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SCALE = 1_000_000
_HEAD = struct.Struct("<qq")
_UNIT = re.compile(r" *[^ \n]+| +|\n")


_BASE, _NONE = np.uint64(0x9E3779B97F4A7C15), -(1 << 60)


def _codes(units: list, size: int) -> np.ndarray:
    """Code points of equally long strings, a row each, counted from 1."""
    raw = "".join(units).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4").reshape(len(units), size).astype(np.uint64) + np.uint64(1)


class PieceModel:
    """Pieces and integer log-scores of a model file; characters without a piece fall back to their bytes.

    The file's scores are merge ranks, not probabilities; a piece of rank r
    (1 is best) is given Zipf's probability, proportional to 1 / (r + 1).
    """

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        normal.sort(key=lambda i: (-sp.get_score(i), i))
        total = sum(1.0 / (r + 2) for r in range(len(normal)))
        log = [round(-math.log((r + 2) * total) * SCALE) for r in range(len(normal))]
        self.arc = {sp.id_to_piece(i).replace(SPACE, " "): (i, s) for i, s in zip(normal, log)}
        # every beginning of a piece: (id, score) if it is a piece itself, else ()
        self.begin = {p[:k]: () for p in self.arc for k in range(1, len(p) + 1)} | self.arc
        self.pairs = {a + b for p in self.arc for a, b in zip(p, p[1:])}
        self.tables = {}  # by length: sorted piece hashes, ids and scores
        for width in sorted({len(p) for p in self.arc}):
            own = [p for p in self.arc if len(p) == width]
            value = np.zeros(len(own), np.uint64)
            for column in _codes(own, width).T:
                value = value * _BASE + column
            order = np.argsort(value)
            self.tables[width] = (value[order], *(np.array([self.arc[p][k] for p in own], np.int64)[order] for k in (0, 1)))
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_score = (log[-1] if log else 0) - 10 * SCALE
        self.bytes = [b""] * size
        self.chars = [1] * size
        for piece, (i, _) in self.arc.items():
            self.bytes[i], self.chars[i] = piece.encode(), len(piece)
        for value, i in self.byte.items():
            self.bytes[i] = bytes([value])
        if any(a != " " and b == " " or "\n" in (a, b) for p in self.arc for a, b in zip(p, p[1:])):
            raise ValueError("the vocabulary has pieces that cross a word start or a line end")

    def lattice(self, unit: str) -> list:
        """Arcs by start: ``(end, ids, score)``; a lone character without a piece has its byte fallback."""
        arcs, begin, size = [], self.begin, len(unit)
        for i in range(size):
            own, j = [], i + 1
            while j <= size and (hit := begin.get(unit[i:j])) is not None:
                if hit:
                    own.append((j, (hit[0],), hit[1]))
                j += 1
            if not own or own[0][0] != i + 1:
                raw = unit[i].encode("utf-8", "surrogatepass")
                own.append((i + 1, tuple(self.byte[b] for b in raw), self.byte_score * len(raw)))
            arcs.append(own)
        return arcs

    def parts(self, unit: str) -> list:
        """The unit cut between characters that no piece has side by side, where no arc can cross."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(unit)) if unit[i - 1:i + 1] not in pairs]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])] if cuts else [unit]


def viterbi(arcs: list) -> list:
    """Best score from the start to every position."""
    best = [None] * (len(arcs) + 1)
    best[0] = 0
    for i, own in enumerate(arcs):
        here = best[i]
        for j, _, s in own:
            if best[j] is None or here + s > best[j]:
                best[j] = here + s
    return best


def n_best(arcs: list, n: int) -> list:
    """The ``n`` best segmentations, ``(score, ids)``, best first: A* from the end with Viterbi scores ahead.

    Of equal estimates the hypothesis nearest to the start goes first, so a
    text with countless equal segmentations ends as soon as ``n`` are complete.
    """
    ahead, into = viterbi(arcs), [[] for _ in range(len(arcs) + 1)]
    for i, own in enumerate(arcs):
        for j, ids, s in own:
            into[j].append((i, ids, s))
    heap, order, out = [(-ahead[-1], len(arcs), 0, 0, None)], 0, []
    while heap and len(out) < n:
        _, at, _, score, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path:
                ids.extend(path[0])
                path = path[1]
            out.append((score, ids))
            continue
        for i, ids, s in into[at]:
            order += 1
            heapq.heappush(heap, (-(ahead[i] + score + s), i, order, score + s, (ids, path)))
    return out


def best_two(model: PieceModel, unit: str):
    """``(ids, score, gap)`` of the best segmentation; gap to the second-best one, -1 if there is none.

    Forward Viterbi over the arcs of :meth:`PieceModel.lattice`, found as it
    goes, with the two best scores of every position.
    """
    size, begin = len(unit), model.begin
    first, second, via = [None] * (size + 1), [None] * (size + 1), [None] * (size + 1)
    first[0] = 0
    for i in range(size):
        best, next_, j, alone = first[i], second[i], i + 1, True
        hit = begin.get(unit[i])
        while hit is not None:
            if hit:
                if j == i + 1:
                    alone = False
                got, old = best + hit[1], first[j]
                if old is None or got > old:
                    first[j], second[j], via[j] = got, old, hit[0]
                elif second[j] is None or got > second[j]:
                    second[j] = got
                if next_ is not None and (second[j] is None or next_ + hit[1] > second[j]):
                    second[j] = next_ + hit[1]
            j += 1
            hit = begin.get(unit[i:j]) if j <= size else None
        if alone:  # no piece for this character alone: its bytes
            got, old = best + model.byte_score * len(unit[i].encode("utf-8", "surrogatepass")), first[i + 1]
            if old is None or got > old:
                first[i + 1], second[i + 1], via[i + 1] = got, old, -1
            elif second[i + 1] is None or got > second[i + 1]:
                second[i + 1] = got
            if next_ is not None and (second[i + 1] is None or next_ + got - best > second[i + 1]):
                second[i + 1] = next_ + got - best
    at, path = size, []
    while at:
        if via[at] < 0:
            at -= 1
            path.extend(model.byte[b] for b in reversed(unit[at].encode("utf-8", "surrogatepass")))
        else:
            path.append(via[at])
            at -= model.chars[via[at]]
    path.reverse()
    return path, first[size], -1 if second[size] is None else first[size] - second[size]


def best_two_of_many(model: PieceModel, units: list) -> list:
    """:func:`best_two` for strings of one length at once; None where a character has no piece of its own."""
    size, n = len(units[0]), len(units)
    code = _codes(units, size)
    first, second = np.full((2, size + 1, n), _NONE, np.int64)
    first[0] = 0
    piece, since, whole = np.zeros((size + 1, n), np.int32), np.zeros((size + 1, n), np.int16), np.ones(n, bool)
    for i in range(size):
        value = np.zeros(n, np.uint64)
        for j in range(i + 1, min(size, i + max(model.tables)) + 1):
            value = value * _BASE + code[:, j - 1]
            if j - i not in model.tables:
                continue
            hashes, ids, scores = model.tables[j - i]
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == value)
            if j == i + 1:
                alone = np.zeros(n, bool)
                alone[hit] = True
                whole &= alone
            if not len(hit):
                continue
            at = at[hit]
            got, old = first[i, hit] + scores[at], first[j, hit]
            second[j, hit] = np.maximum(np.maximum(second[j, hit], np.minimum(old, got)), second[i, hit] + scores[at])
            up = got > old
            first[j, hit[up]], piece[j, hit[up]], since[j, hit[up]] = got[up], ids[at[up]], i
    path, spot, row = [], np.full(n, size), np.flatnonzero(whole)
    while len(row):
        here = spot[row]
        got = np.full(n, -1, np.int32)
        got[row] = piece[here, row]
        path.append(got)
        spot[row] = since[here, row]
        row = row[spot[row] > 0]
    gap = np.where(second[size] > _NONE // 2, first[size] - second[size], -1)
    head = np.stack([first[size], gap], axis=1).astype("<i8").view("<i4")
    table = np.concatenate([head, np.stack(path[::-1], axis=1)], axis=1) if path else head
    held = np.ones(table.shape, bool)
    held[:, head.shape[1]:] = table[:, head.shape[1]:] >= 0
    raw, end = table[held].astype("<i4").tobytes(), np.cumsum(held.sum(axis=1)) * 4
    return [raw[a:b] if w else None for a, b, w in zip([0, *end.tolist()], end.tolist(), whole.tolist())]


class Segmenter:
    """Segments whole texts; it keeps what it learned of the units met last, ``2 * most`` at the most.

    A unit is kept as bytes: score and gap (64 bits each), then 32-bit ids.
    """

    def __init__(self, model: PieceModel, n: int = 4, most: int = 100_000):
        self.model, self.n, self.most = model, n, most
        size = np.array([len(b) for b in model.bytes])
        self.flat, self.size = np.frombuffer(b"".join(model.bytes), np.uint8), size
        self.start = np.cumsum(size) - size
        self.known, self.old, self.long, self.lists = {}, {}, {}, {}

    def learn(self, texts: list) -> list:
        """The units of some texts, all of them known afterwards: new ones are searched together, by length."""
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        units = [_UNIT.findall(" " + t) for t in texts]
        fresh, by_size = set().union(*units).difference(self.known), {}
        self.long = {}
        for unit in fresh:
            if unit in self.old:
                self.known[unit] = self.old[unit]
            elif len(unit) > 32:
                self.long[unit] = self._search(unit)
            else:
                by_size.setdefault(len(unit), []).append(unit)
        for own in by_size.values():
            for cut in range(0, len(own), 20_000):
                part = own[cut:cut + 20_000]
                for unit, got in zip(part, best_two_of_many(self.model, part)):
                    self.known[unit] = got or self._search(unit)
        return units

    def _search(self, unit: str) -> bytes:
        """Best segmentation, score and smallest gap of a unit, from its independent parts."""
        ids, score, gap = [], 0, -1
        for part in self.model.parts(unit):
            own, value, near = best_two(self.model, part)
            ids.extend(own)
            score += value
            if near >= 0 and (gap < 0 or near < gap):
                gap = near
        return _HEAD.pack(score, gap) + np.array(ids, "<i4").tobytes()

    def _alternatives(self, unit: str, best: list) -> list:
        """The n best of a unit, ``(score, ids)``; ``best``, which may be one of several as good, first."""
        if unit not in self.lists:
            if len(self.lists) > self.most // 4:
                self.lists = {}
            found = n_best(self.model.lattice(unit), self.n)
            if found[0][1] != best:
                found = [(found[0][0], best), *(f for f in found if f[1] != best)][:self.n]
            if len(unit) > 64:
                return found
            self.lists[unit] = found
        return self.lists[unit]

    def segment(self, text: str):
        """``(ids, scores, others)``: the best segmentation, the scores of the n best, and the edits that give the others."""
        return self.segment_units(self.learn([text])[0])

    def segment_units(self, units: list):
        """The same from units that the last call of :meth:`learn` has returned."""
        known, long = self.known, self.long
        found = [known[u] for u in units] if not long else [long.get(u) or known[u] for u in units]
        words = np.frombuffer(b"".join(found), "<i4")
        start = np.cumsum([0, *map(len, found)])[:-1] // 4
        head = start[:, None] + np.arange(_HEAD.size // 4)
        scores, gap = np.ascontiguousarray(words[head]).view("<i8").T
        plain = np.ones(len(words), bool)
        plain[head] = False
        ids = words[plain]
        open_ = np.flatnonzero(gap >= 0)
        if len(open_) > self.n - 1:  # other units are changed in none of the n best
            limit = np.partition(gap[open_], self.n - 2)[self.n - 2] if self.n > 1 else -1
            open_ = open_[gap[open_] <= limit]
            open_ = open_[np.argsort(gap[open_], kind="stable")[:self.n - 1]]
        if not len(open_):
            return ids, [int(scores.sum())], []
        length = np.diff(np.append(start, len(words))) - _HEAD.size // 4
        place = np.cumsum(length) - length
        ways = [self._alternatives(units[k], ids[place[k]:place[k] + length[k]].tolist()) for k in open_]
        found = self._combine(int(scores.sum()), [[s for s, _ in w] for w in ways])
        others = [sorted((int(place[k]), int(length[k]), w[p][1]) for k, w, p in zip(open_, ways, pick) if p) for _, pick in found[1:]]
        return ids, [s for s, _ in found], others

    def segment_all(self, texts: list, size: int = 2_000_000):
        """Yield ``(ids, scores, others)`` for each text, about ``size`` characters at a time; None for a null text."""
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars < size):
                chars += len(texts[stop] or "")
                stop += 1
            for text, units in zip(texts[at:stop], self.learn([t or "" for t in texts[at:stop]])):
                yield None if text is None else self.segment_units(units)
            at = stop

    def _combine(self, best: int, choices: list) -> list:
        """The n best sums of one score from each unit, with the places taken; each step worsens one unit, never an earlier one."""
        heap, out = [(-best, (0,) * len(choices), 0)], []
        while heap and len(out) < self.n:
            low, pick, frm = heapq.heappop(heap)
            out.append((-low, pick))
            for k in range(frm, len(choices)):
                if pick[k] + 1 < len(choices[k]):
                    worse = choices[k][pick[k]] - choices[k][pick[k] + 1]
                    heapq.heappush(heap, (low + worse, pick[:k] + (pick[k] + 1,) + pick[k + 1:], k))
        return out

    def raw(self, ids) -> bytes:
        """Bytes of some pieces."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        spot = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.flat[spot].tobytes()

    def decode(self, ids) -> str:
        """Text of a segmentation, without the space put before it."""
        return self.raw(ids)[1:].decode("utf-8", "surrogatepass")


def edited(ids: np.ndarray, edits: list) -> np.ndarray:
    """Another of the n best: ``ids`` with some of them replaced, ``(at, size, new ids)`` in order."""
    parts, last = [], 0
    for at, size, new in edits:
        parts += [ids[last:at], np.asarray(new, ids.dtype)]
        last = at + size
    return np.concatenate([*parts, ids[last:]])


_segmenters: dict = {}


def _segmenter(broadcast, n: int) -> Segmenter:
    """One segmenter a worker process and model, so units learned in one task serve the next."""
    key = (broadcast.value.key, n)
    if key not in _segmenters:
        _segmenters.clear()
        _segmenters[key] = Segmenter(broadcast.value, n)
    return _segmenters[key]


def _model(docs: DataFrame, path: str):
    """The vocabulary, of a fixed size given by the file, read by the driver and broadcast."""
    model = PieceModel(path)
    model.key = hashlib.sha256(repr(sorted(model.arc.items())).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(model)


def encode_documents(docs: DataFrame, path: str = MODEL, n: int = 4) -> DataFrame:
    """``docs`` with ``ids`` (best segmentation), ``scores`` (log-scores of the ``n`` best) and ``others``.

    ``others`` gives segmentations 2 to n as edits of the best: each a list of
    ``(at, size, ids)``, ids in place of ``size`` ids from ``at`` on.  A null
    text has nulls, an empty one the lone space piece; extra columns stay.
    Existing columns of the three names are replaced.
    """
    model, names = _model(docs, path), [c for c in docs.columns if c not in ("ids", "scores", "others")]
    edit = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])))
    at = names.index("text")

    def run(batches):
        for batch in small(batches):
            own = _segmenter(model, n)
            ids, scores, others = [], [], []  # ids of one Arrow batch at a time
            for found in own.segment_all(batch.column(at).to_pylist()):
                best, values, edits = found or (None, None, None)
                ids.append(best)
                scores.append(values and [v / SCALE for v in values])
                others.append(edits and [[{"at": a, "size": n, "ids": new} for a, n, new in way] for way in edits])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.float64())), pa.array(others, edit)],
                                             [*names, "ids", "scores", "others"])

    kept = docs.select(*[f"`{c}`" for c in names])
    whole = T.ArrayType(T.IntegerType())
    way = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("ids", whole)]))
    more = [T.StructField("ids", whole), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("others", T.ArrayType(way))]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *more]))


def decode_ids(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """``rows`` with ``decoded``, the text of their ``ids``; null ids give a null text."""
    model, names = _model(rows, path), [c for c in rows.columns if c != "decoded"]
    at = names.index("ids")

    def run(batches):
        for batch in small(batches):
            own = _segmenter(model, 1)
            texts = [None if ids is None else own.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    kept = rows.select(*names)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def segmentation_report(docs: DataFrame, path: str = MODEL, n: int = 4) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, score, scores, ids_sha256, n_best_sha256, roundtrip``.

    ``ids_sha256`` is over the little-endian 32-bit ids of the best
    segmentation, ``n_best_sha256`` has the digests of all n; ``roundtrip`` says
    that decoding each of them gives the text again.
    Null texts count as empty; extra columns are ignored; an empty table gives no rows.
    """
    model = _model(docs, path)
    names = ["doc_id", "n_tokens", "score", "scores", "ids_sha256", "n_best_sha256", "roundtrip"]
    digest = lambda ids: hashlib.sha256(ids.tobytes()).hexdigest()

    def run(batches):
        for batch in small(batches):
            own = _segmenter(model, n)
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for text, (ids, scores, others) in zip(texts, own.segment_all(texts)):
                digests = [digest(ids), *(digest(edited(ids, way)) for way in others)]
                same = own.decode(ids) == text and all(own.raw(new) == own.raw(ids[a:a + n]) for way in others for a, n, new in way)
                rows.append((len(ids), scores[0] / SCALE, [s / SCALE for s in scores], digests[0], digests, same))
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, types)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double, scores array<double>, ids_sha256 string, n_best_sha256 array<string>, roundtrip boolean")
