"""Hidden Markov language model.

Token counts come from all training documents.  The most frequent tokens are
symbols of the model, all others share one rare symbol inside which a token has
its smoothed share of the rare counts.  Baum-Welch rounds add up expected
counts in every task, sum them over the partitions and re-estimate until the
likelihood has converged: first on a share of the training documents, which
gives the start, then on all of them.  The scaled forward recursion then gives
the exact likelihood of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.llm.textvec import pieces
from seasoncast.session import materialise

END = -1  # key of the end token; words have 64-bit hashes
BACK = 0.1  # added to every count


@dataclass(frozen=True)
class HmmRules:
    """Production settings; ``head`` and ``symbols`` bound what is broadcast."""

    states: int = 8
    gain: float = 1e-4        # rounds end when one gains less than this share of the log-likelihood
    rounds: int | None = None  # a fixed number of rounds on all documents instead, for trials
    start_tokens: int = 4_000_000  # training tokens, about, on which the start of the rounds is found
    symbols: int = 8191       # most frequent tokens with emissions of their own
    head: int = 1 << 18       # most frequent tokens whose counts every task holds; the rest is joined
    batch_tokens: int = 600_000
    held_tokens: int = 3_000_000  # tokens of a task sorted by length at once
    seed: int = 8


def marked(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, held_out)``; a null doc_id counts as an empty id."""
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "text", (digest % 10 == 0).alias("held_out"))


def _tokens(column):
    """Yield ``(piece, token keys, document of each)``, every text closed by END."""
    for piece in pieces(column, fold="lower"):
        start, end, doc = piece.words()
        keys = np.concatenate([piece.hasher(start, end).view(np.int64), np.full(piece.n, END, np.int64)])
        doc = np.concatenate([doc, np.arange(piece.n)])
        order = np.argsort(doc, kind="stable")
        yield piece, keys[order], doc[order]


def token_counts(docs: DataFrame) -> DataFrame:
    """``(token, c)`` over the texts of ``docs``; each Arrow batch is counted before the shuffle."""
    def run(batches):
        for batch in batches:
            keys = [k for _, k, _ in _tokens(batch.column(0))]
            token, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], ["token", "c"])

    return docs.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Head of the counts: sorted keys, their counts and symbols, and the totals of all tokens."""

    def __init__(self, token: np.ndarray, c: np.ndarray, total: int, distinct: int, symbols: int):
        order = np.lexsort((token, -c, token != END))  # END first, then by count
        token, c = token[order], c[order]
        self.n_symbols = min(symbols, len(token))
        self.total, self.distinct = total, distinct
        self.frequency = c[:self.n_symbols].astype(float)
        self.rare_total = total - int(self.frequency.sum())
        self.rare_distinct = distinct - self.n_symbols
        symbol = np.minimum(np.arange(len(token)), self.n_symbols)
        at = np.argsort(token)
        self.token, self.c, self.symbol = token[at], c[at], symbol[at].astype(np.uint16)

    def look_up(self, keys: np.ndarray):
        """``(counts, symbols, in the head)``; outside the head the count is 0 and the symbol the rare one."""
        if not len(self.token):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint16), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.token, keys), len(self.token) - 1)
        held = self.token[at] == keys
        return np.where(held, self.c[at], 0), np.where(held, self.symbol[at], self.n_symbols).astype(np.uint16), held


def _head(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent tokens, END first, ties by token, and few others: what a sort has to look at.

    The least count that gets in is read off the counts' histogram: by powers of
    two, then inside the power where the head ends (some ``most`` counts at the
    utmost).  Of the tokens with just that count, which may be most of all, the
    ones needed are taken by a cut in their hash, with room to spare.
    """
    power = F.length(F.bin("c"))
    room, cut = most, None
    for r in counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():  # 64 rows at most
        if r["count"] >= room:
            cut = r["power"]
            break
        room -= r["count"]
    if cut is None:
        return counts
    least = None
    for r in counts.where(power == cut).groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        least, ties = r["c"], r["count"]
        if ties >= room:
            break
        room -= ties
    low, span = -(1 << 63), 1 << 64
    share = min(1.0, (room + 6 * room ** 0.5 + 64) / ties)  # hashes are spread evenly
    edge = min(low + int(share * span), (1 << 63) - 1)
    return counts.where((F.col("c") > least) | (F.col("token") == END) | ((F.col("c") == least) & (F.col("token") <= edge)))


def vocabulary(counts: DataFrame, rules: HmmRules) -> Vocabulary:
    """Only the head, ``rules.head`` rows at most, and the totals reach the driver."""
    total = counts.agg(F.sum("c"), F.count("*")).first()
    top = (_head(counts, rules.head).orderBy((F.col("token") != END), F.col("c").desc(), "token").limit(rules.head).toArrow())
    return Vocabulary(top["token"].to_numpy(), top["c"].to_numpy(), total[0] or 0, total[1], rules.symbols)


ENCODED = ("key long, doc_id long, held_out boolean, symbols binary, n_tokens long, n_known long, head_log double, rare_log double, "
           "n_rare long, tail array<struct<token:bigint,n:bigint>>")


def encode(docs: DataFrame, vocab) -> DataFrame:
    """One row per document: its symbols, the sums over head tokens, and its tokens outside the head.

    ``key`` numbers the rows (partition and place in it); the table is written
    once, so it stays what it is when tasks are run again.
    """
    def run(batches):
        v, place = vocab.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece, keys, doc in _tokens(batch.column(1)):
                c, symbol, held = v.look_up(keys)
                log, rare = np.log10(c + BACK), held & (symbol == v.n_symbols)
                total = lambda x: np.bincount(doc, x, minlength=piece.n)
                whole = lambda x: pa.array(total(x).astype(np.int64))
                cuts = np.searchsorted(doc, np.arange(piece.n + 1))
                raw = symbol.tobytes()
                far = np.flatnonzero(~held)
                pairs, n = np.unique(np.stack([doc[far], keys[far]], axis=1), axis=0, return_counts=True) if len(far) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
                tail = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(n.astype(np.int64))], ["token", "n"])
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(piece.n + 1)).astype(np.int32)), tail)
                own = slice(piece.first, piece.n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place + np.arange(piece.n)), batch.column(0).slice(own.start, own.stop), batch.column(2).slice(own.start, own.stop),
                     pa.array([raw[2 * a:2 * b] for a, b in zip(cuts, cuts[1:])], pa.binary()), whole(np.ones(len(keys))), whole(c > 0),
                     pa.array(total(np.where(held, log, 0.0))), pa.array(total(np.where(rare, log, 0.0))), whole(symbol == v.n_symbols), tail],
                    [x.split()[0] for x in ENCODED.split(", ")])
                place += piece.n

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, ENCODED)


def tail_sums(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """``(key, tail_log, tail_known)``: the tokens outside the head, joined with their counts."""
    tail = encoded.select("key", F.explode("tail").alias("t")).select("key", "t.token", "t.n")
    c = F.coalesce(F.col("c"), F.lit(0))
    return (tail.join(counts, "token", "left").groupBy("key")
            .agg(F.sum(F.col("n") * F.log10(c + F.lit(BACK))).alias("tail_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known")))


class Hmm:
    """Start, transition and emission probabilities; ``emit`` has a row for each symbol."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, vocab: Vocabulary, rules: HmmRules) -> Hmm:
        rng = np.random.default_rng(rules.seed)
        share = np.append(vocab.frequency, vocab.rare_total) + BACK
        emit = share[:, None] * np.exp(rng.normal(0, 1, (len(share), rules.states)))
        move = rng.uniform(0.5, 1.5, (rules.states, rules.states))
        return cls(np.full(rules.states, 1 / rules.states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def estimated(cls, counts: np.ndarray) -> Hmm:
        """From expected counts: a row for the start, ``states`` rows of moves, then a row for each symbol."""
        n = counts.shape[1]
        start, move, emit = counts[0] + BACK, counts[1:n + 1] + BACK, counts[n + 1:] + BACK / 10
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, rows: np.ndarray, alive: np.ndarray, keep: bool = False):
        """Scaled forward recursion over rows sorted by falling length; ``alive[t]`` rows reach step t.

        Returns the natural log-likelihoods, and with ``keep`` the scaled
        forward probabilities (step, state, row) and the scales.  Numbers have
        the type of ``emit``; logarithms are doubles.
        """
        n, steps, kind = *rows.shape, self.emit.dtype
        seen, emit, move = np.ascontiguousarray(rows.T), np.ascontiguousarray(self.emit.T), np.ascontiguousarray(self.move.T)
        alphas = np.empty((steps, len(emit), n), kind) if keep else None
        scales, a = np.ones((steps, n), kind), None
        for t in range(steps):
            k = alive[t]
            a = np.repeat(self.start[:, None], k, axis=1) if a is None else move @ a[:, :k]
            a *= emit.take(seen[t, :k], axis=1)
            a /= np.add.reduce(a, axis=0, out=scales[t, :k])
            if keep:
                alphas[t, :, :k] = a
        return np.log(scales, dtype=np.float64).sum(axis=0), alphas, scales

    def expect(self, rows: np.ndarray, alive: np.ndarray, counts: np.ndarray) -> float:
        """Add the expected counts of some sequences to ``counts`` (doubles); returns their log-likelihood."""
        log, alphas, scales = self.forward(rows, alive, keep=True)
        n, steps, kind = len(self.start), rows.shape[1], self.emit.dtype
        seen, emit = np.ascontiguousarray(rows.T), np.ascontiguousarray(self.emit.T)
        used = np.concatenate([seen[t, :alive[t]] for t in range(steps)])
        cuts = np.append(0, np.cumsum(alive))
        gamma, moves, back = np.empty((n, len(used)), kind), np.zeros((n, n)), None
        for t in range(steps - 1, -1, -1):
            k, m = alive[t], alive[t + 1] if t + 1 < steps else 0
            now = np.ones((n, k), kind)
            if m:
                ahead = emit.take(seen[t + 1, :m], axis=1)
                ahead *= back
                ahead /= scales[t + 1, :m]
                moves += alphas[t, :, :m] @ ahead.T
                np.matmul(self.move, ahead, out=now[:, :m])
            np.multiply(alphas[t, :, :k], now, out=gamma[:, cuts[t]:cuts[t + 1]])
            back = now
        counts[0] += gamma[:, :alive[0]].sum(axis=1, dtype=np.float64)
        counts[1:n + 1] += self.move * moves
        for s in range(n):
            counts[n + 1:, s] += np.bincount(used, gamma[s], minlength=len(counts) - n - 1)
        return float(log.sum())

    def narrow(self) -> Hmm:
        """The same model in single precision: half the memory traffic of the rounds."""
        return Hmm(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))


def sequences(column, most: int):
    """Group the symbol sequences of a column by length: ``(positions, rows, alive)`` of about ``most`` tokens each."""
    raw = column.to_pylist()
    size = np.array([len(x) // 2 for x in raw])
    order, at = np.argsort(-size, kind="stable"), 0
    while at < len(order) and size[order[at]] > 0:
        longest = size[order[at]]
        pick = order[at:at + max(1, most // longest)]
        pick = pick[size[pick] > 0]
        rows = np.zeros((len(pick), longest), np.int64)
        for i, k in enumerate(pick):
            rows[i, :size[k]] = np.frombuffer(raw[k], np.uint16)
        yield pick, rows, np.searchsorted(-size[pick], -np.arange(longest), side="left")
        at += len(pick)


def _together(batches, column: int, most: int):
    """Batches joined until they hold about ``most`` tokens: ``(batch, its symbols)``; few long texts then share their steps with others."""
    held, tokens = [], 0
    for batch in batches:
        held.append(batch)
        tokens += batch.column(column).nbytes // 2
        if tokens >= most:
            yield (whole := pa.concat_batches(held)), whole.column(column)
            held, tokens = [], 0
    if held:
        yield (whole := pa.concat_batches(held)), whole.column(column)


def expected_counts(training: DataFrame, model: Hmm, size: int, rules: HmmRules) -> tuple[np.ndarray, float]:
    """Expected counts of the rows of ``training`` under ``model``, and their log-likelihood.

    A task emits one row for each symbol and state of the model, whatever it
    has read; sums over the partitions are Spark's.
    """
    held, names = training.sparkSession.sparkContext.broadcast(model.narrow()), [f"s{s}" for s in range(rules.states)]

    def run(batches):
        counts, log, read = np.zeros((size, rules.states)), 0.0, 0
        for batch, symbols in _together(batches, 0, rules.held_tokens):
            read += batch.num_rows
            for _, rows, alive in sequences(symbols, rules.batch_tokens):
                log += held.value.expect(rows, alive, counts)
        if read:
            full = np.concatenate([counts, np.array([[log] + [0.0] * (rules.states - 1)])])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), *map(pa.array, np.ascontiguousarray(full.T))], ["row", *names])

    sums = (training.mapInArrow(run, "row long, " + ", ".join(n + " double" for n in names))
            .groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow())
    held.unpersist()
    counts = np.zeros((size + 1, rules.states))
    counts[sums["row"].to_numpy()] = np.stack([sums[n].to_numpy() for n in names], axis=1)
    return counts[:size], float(counts[size, 0])


def converged(likelihoods: list, gain: float) -> bool:
    """Whether the last round gained at most the share ``gain``, and no more than the one before.

    From a random start the likelihood leaps, then rises slowly and ever faster
    as the states come apart; a leap before or a growing gain is thus no end.
    """
    if len(likelihoods) < 3:
        return False
    (before, last), least = np.diff(likelihoods[-3:]), gain * abs(likelihoods[-1])
    return last <= least and last <= max(before, 0) and before <= 10 * least


def baum_welch(encoded: DataFrame, vocab: Vocabulary, rules: HmmRules) -> tuple[Hmm, list]:
    """Fit on all rows that are not held out; returns the model and the log-likelihood before each round over all of them.

    Rounds go on until they have converged.  Unless the table is small, they
    start from the model that has converged on a share of the documents (by
    the hash of the row), so that few rounds over all of them are left.
    """
    model, size = Hmm.initial(vocab, rules), vocab.n_symbols + 2 + rules.states
    training = encoded.where("not held_out")
    parts = max(1, vocab.total // rules.start_tokens)
    tables = [training.select("symbols")]
    if rules.rounds is None and parts > 1:
        tables.insert(0, materialise(training.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == 0).select("symbols"), "start"))
    for table in tables:
        likelihoods = []
        while not converged(likelihoods, rules.gain) if rules.rounds is None else len(likelihoods) < rules.rounds:
            counts, log = expected_counts(table, model, size, rules)
            likelihoods.append(log)
            if log:  # a share without rows leaves the random start
                model = Hmm.estimated(counts)
    return model, likelihoods


def score_documents(docs: DataFrame, rules: HmmRules = HmmRules()) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows that are not held out.  Null and empty texts are one
    end token; null ids and repeated rows count and are scored like others;
    extra columns are ignored; without training rows every token is unknown;
    an empty table gives no rows.
    """
    docs = marked(docs)
    spark = docs.sparkSession
    counts = materialise(token_counts(docs.where("not held_out")), "token-counts")
    vocab = vocabulary(counts, rules)
    held = spark.sparkContext.broadcast(vocab)
    encoded = materialise(encode(docs, held), "encoded")
    model, _ = baum_welch(encoded, vocab, rules)
    fitted = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch, symbols in _together(batches, 1, rules.held_tokens):
            log = np.zeros(batch.num_rows)
            for pick, rows, alive in sequences(symbols, rules.batch_tokens):
                log[pick] = fitted.value.forward(rows, alive)[0] / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log)], ["key", "hmm"])

    likelihood = encoded.select("key", "symbols").mapInArrow(run, "key long, hmm double")
    rows = (encoded.drop("symbols", "tail").join(likelihood, "key")
            .join(tail_sums(encoded, counts), "key", "left"))
    tail, known = F.coalesce(F.col("tail_log"), F.lit(0.0)), F.coalesce(F.col("tail_known"), F.lit(0))
    whole = float(np.log10(vocab.total + BACK * (vocab.distinct + 1)))
    rare = float(np.log10(vocab.rare_total + BACK * (vocab.rare_distinct + 1)))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
                       (F.col("head_log") + tail - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
                       (F.col("hmm") + F.col("rare_log") + tail - F.col("n_rare") * F.lit(rare)).alias("score"))
