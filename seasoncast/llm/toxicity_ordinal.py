"""Severity of toxic language by cumulative-link ordinal regression.

One weight vector over sparse word features is shared by the ordered
thresholds: P(grade <= j) = sigmoid(threshold_j - w.x).  The model is fitted on
a bounded sample of labelled documents, scored on every document, and the
expected severity is the sum of the upper-tail probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.llm.textvec import Piece, mix, pieces

GRADES = 3  # 0 harmless, 1 toxic, 2 severely toxic: more telling words than the median toxic document


@dataclass(frozen=True)
class OrdinalRules:
    """Production settings; ``sample`` bounds the labelled documents that the model is fitted on."""

    sample: int = 8_000
    min_documents: int = 4     # a word counts as a feature if so many sampled documents hold it
    ridge: float = 1e-4        # per document, on the weights
    min_ratio: float = 20.0    # and tells the grades apart by this likelihood ratio
    rounds: int = 300
    rate: float = 0.1
    toxic_at: float = 0.45     # probability of a grade over 0


def toxic_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic)`` 0/1, one row per labelled document; the worst of repeated labels counts.

    Rows without doc_id or toxic label are left out.
    """
    return (labels.where("doc_id is not null and toxic is not null")
            .groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))


PREFIXES = (5, 6, 7, 8)  # bytes; the beginnings of longer words tell inflected and compounded forms


TWICE = 0x5851F42D4C957F2D  # marks the feature "more than once"


def _features(piece: Piece):
    """Yield ``(document, feature hash)`` arrays: the folded words, then their beginnings of each length."""
    start, end, doc = piece.words()
    yield doc, piece.hasher(start, end)
    for size in PREFIXES:
        long = end - start > size
        yield doc[long], mix(piece.hasher(start[long], start[long] + size) + np.uint64(size))


def sample_features(docs: DataFrame, labelled: DataFrame, rules: OrdinalRules) -> DataFrame:
    """``(doc_id, toxic, words)`` of the sampled documents, at most ``rules.sample`` (the lowest hashes of the id)."""
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by rules.sample

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column(1), fold=True):
                doc, word = (np.concatenate(x) for x in zip(*_features(piece)))
                pairs, n = np.unique(np.stack([doc.astype(np.uint64), word], axis=1), axis=0, return_counts=True)
                again = pairs[n > 1] ^ np.array([0, TWICE], np.uint64)
                pairs = np.concatenate([pairs, again])
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                doc, word = pairs[:, 0].astype(np.int64), np.ascontiguousarray(pairs[:, 1])
                offsets = np.searchsorted(doc, np.arange(piece.n + 1)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(word.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), batch.column(2).slice(piece.first, piece.n), words], ["doc_id", "toxic", "words"])

    return rows.mapInArrow(run, "doc_id long, toxic int, words array<bigint>")


class OrdinalModel:
    """Feature weights and ordered thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.words, self.weights, self.thresholds = words, weights, thresholds
        again = words ^ np.uint64(TWICE)
        at = np.minimum(np.searchsorted(words, again), max(len(words) - 1, 0))
        self.more = np.where(words[at] == again, weights[at], 0.0) if len(words) else weights

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for every threshold j, by row."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def scores(self, piece: Piece) -> np.ndarray:
        if not len(self.words):
            return np.zeros(piece.n)
        held = []
        for doc, word in _features(piece):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = self.words[at] == word
            held.append(doc[hit] * len(self.words) + at[hit])
        held, n = np.unique(np.concatenate(held), return_counts=True)
        at = held % len(self.words)
        return np.bincount(held // len(self.words), self.weights[at] + np.where(n > 1, self.more[at], 0.0), minlength=piece.n)


def _telling(flat: np.ndarray, toxic: np.ndarray, counts: np.ndarray, rules: OrdinalRules) -> np.ndarray:
    """Features that toxic documents hold more often than others, by the likelihood-ratio statistic."""
    words, at = np.unique(flat, return_inverse=True)
    held = np.stack([np.bincount(at[toxic == t], minlength=len(words)) for t in (0, 1)], axis=1) if len(words) else np.zeros((0, 2))
    df = held.sum(axis=1, keepdims=True)
    expected = df * (counts / counts.sum())
    rest, rest_expected = np.maximum(counts - held, 1e-9), np.maximum(counts - expected, 1e-9)
    ratio = 2 * (held * np.log(np.maximum(held, 1e-9) / np.maximum(expected, 1e-9)) + rest * np.log(rest / rest_expected)).sum(axis=1)
    return words[(df[:, 0] >= rules.min_documents) & (ratio >= rules.min_ratio) & (held[:, 1] > expected[:, 1])]


def fit_ordinal(rows: list, rules: OrdinalRules = OrdinalRules()) -> OrdinalModel:
    """Fit on ``(toxic, feature hashes)`` rows by full-batch Adam on the ridge-penalised likelihood.

    Grades come from the label and the number of telling features.  Thresholds
    start at the smoothed grade frequencies and stay ordered, as the gaps
    between them are kept positive.  Weights stay at or above 0, so that
    harmless words never outweigh offending ones in a long text.  Without rows
    the prior says grade 0.
    """
    toxic = np.array([t for t, _ in rows], np.int64)
    sizes = [len(w) for _, w in rows]
    flat = np.concatenate([np.asarray(w, np.int64) for _, w in rows]).view(np.uint64) if rows else np.zeros(0, np.uint64)
    words = _telling(flat, np.repeat(toxic, sizes), np.bincount(toxic, minlength=2) + np.array([1.0, 0.1]), rules)
    told = np.bincount(np.repeat(np.arange(len(rows)), sizes)[np.isin(flat, words)], minlength=len(rows))
    severe = told > np.median(told[toxic == 1]) if toxic.any() else False
    grade = toxic * (1 + severe)
    counts = np.bincount(grade, minlength=GRADES) + np.array([4.0] + [0.5] * (GRADES - 1))
    below = np.cumsum(counts)[:-1] / counts.sum()
    thresholds = np.log(below / (1 - below))
    if not len(words):
        return OrdinalModel(words, np.zeros(0), thresholds)
    row = np.repeat(np.arange(len(rows)), [len(w) for _, w in rows])
    at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
    held = words[at] == flat
    row, at = row[held], at[held]
    gaps = np.concatenate([thresholds[:1], np.log(np.diff(thresholds))])
    state = [np.zeros(len(words) + len(gaps)) for _ in range(3)]  # parameters and Adam's two moments
    state[0][len(words):] = gaps
    upper = np.where(grade < GRADES - 1, grade, 0)
    lower = np.where(grade > 0, grade - 1, 0)
    for step in range(1, rules.rounds + 1):
        w, g = state[0][:len(words)], state[0][len(words):]
        theta = np.cumsum(np.concatenate([g[:1], np.exp(g[1:])]))
        x = np.bincount(row, w[at], minlength=len(rows))
        p = 1.0 / (1.0 + np.exp(np.clip(x[:, None] - theta[None, :], -60, 60)))  # P(grade <= j)
        hi = np.where(grade < GRADES - 1, p[np.arange(len(rows)), upper], 1.0)
        lo = np.where(grade > 0, p[np.arange(len(rows)), lower], 0.0)
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        d_theta = np.zeros(GRADES - 1)
        np.add.at(d_theta, upper[grade < GRADES - 1], d_hi[grade < GRADES - 1])
        np.add.at(d_theta, lower[grade > 0], -d_lo[grade > 0])
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(at, (d_hi - d_lo)[row], minlength=len(words)) / len(rows) + rules.ridge * w,
                               -np.concatenate([tail[:1], tail[1:] * np.exp(g[1:])]) / len(rows)])
        state[1] = 0.9 * state[1] + 0.1 * grad
        state[2] = 0.99 * state[2] + 0.01 * grad * grad
        state[0] = state[0] - rules.rate * (state[1] / (1 - 0.9 ** step)) / (np.sqrt(state[2] / (1 - 0.99 ** step)) + 1e-8)
        np.maximum(state[0][:len(words)], 0, out=state[0][:len(words)])
    w, g = state[0][:len(words)], state[0][len(words):]
    return OrdinalModel(words, w, np.cumsum(np.concatenate([g[:1], np.exp(g[1:])])))


def train(docs: DataFrame, labels: DataFrame, rules: OrdinalRules = OrdinalRules()) -> OrdinalModel:
    """Fit on the bounded sample; its features are the only rows that reach the driver."""
    got = sample_features(docs, toxic_labels(labels), rules).toArrow().combine_chunks().sort_by("doc_id")
    words = got["words"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int64()))
    flat, cuts = words.flatten().to_numpy(), np.cumsum([0, *pa.compute.list_value_length(words).to_pylist()])
    return fit_ordinal([(t, flat[a:b]) for t, a, b in zip(got["toxic"].to_pylist(), cuts, cuts[1:])], rules)


def severity(docs: DataFrame, model: OrdinalModel, rules: OrdinalRules = OrdinalRules()) -> DataFrame:
    """One row per input row: ``doc_id, expected_severity, grade, p_toxic, toxic``.

    ``grade`` is the likeliest one, the lower of equal ones.  Null and empty
    texts have no feature and get the thresholds' own severity; null ids and
    repeated rows are scored like others; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column(1), fold=True):
                tails = held.value.tails(held.value.scores(piece))
                mass = -np.diff(np.concatenate([np.ones((piece.n, 1)), tails, np.zeros((piece.n, 1))], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, piece.n), pa.array(np.round(tails.sum(axis=1), 6)), pa.array(mass.argmax(axis=1).astype(np.int32)),
                     pa.array(np.round(tails[:, 0], 6)), pa.array(tails[:, 0] >= rules.toxic_at)],
                    ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")
