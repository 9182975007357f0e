"""Hidden Markov model: base score and likelihood against plain versions, growth of the likelihood, edges."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from seasoncast.llm import lm_hmm
from seasoncast.llm.lm_hmm import Hmm, HmmRules, score_documents

SF = "/root/testdata/sf0.001"
SMALL = HmmRules(states=3, rounds=4, symbols=50, head=400)


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def test_scores_against_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(None, "no id"), (900_001, None), (900_002, ""), (900_003, "new words only here"), (900_003, "new words only here"), (7, "Z " * 30000)], "doc_id long, text string")
    docs = docs.union(own)
    rows = docs.collect()
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, x in rows:
        ts = tokens(x)
        want[i, held(i), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + .1) / (n + .1 * (v + 1))) for t in ts), 5)] += 1
    got = score_documents(docs, SMALL).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    out = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # the model beats the single-token base on held-out text


def test_forward_and_counts_match_enumeration():
    rng = np.random.default_rng(2)
    model = Hmm(np.array([.6, .4]), np.array([[.7, .3], [.2, .8]]), (e := rng.random((5, 2))) / e.sum(axis=0))
    rows, sizes = rng.integers(0, 5, (3, 4)), [4, 4, 2]
    alive = np.array([3, 3, 2, 2])
    want, expected = [], np.zeros((1 + 2 + 5, 2))
    for row, size in zip(rows, sizes):
        paths = [[(p >> k) & 1 for k in range(size)] for p in range(2 ** size)]
        mass = [model.start[p[0]] * model.emit[row[0], p[0]] * math.prod(model.move[a, b] * model.emit[s, b] for a, b, s in zip(p, p[1:], row[1:])) for p in paths]
        want.append(math.log(sum(mass)))
        for p, m in zip(paths, np.array(mass) / sum(mass)):
            expected[0, p[0]] += m
            for a, b in zip(p, p[1:]):
                expected[1 + a, b] += m
            for s, x in zip(row, p):
                expected[3 + s, x] += m
    counts = np.zeros_like(expected)
    assert math.isclose(model.expect(rows, alive, counts), sum(want))
    assert np.allclose(counts, expected) and np.allclose(model.forward(rows, alive)[0], want)


def test_likelihood_grows_and_empty_tables(spark):
    docs = lm_hmm.marked(spark.read.parquet(f"{SF}/documents.parquet"))
    vocab = lm_hmm.vocabulary(lm_hmm.token_counts(docs.where("not held_out")), SMALL)
    enc = lm_hmm.encode(docs, spark.sparkContext.broadcast(vocab))
    _, log = lm_hmm.baum_welch(enc, vocab, SMALL)
    assert log == sorted(log)
    none = spark.createDataFrame([], "doc_id long, text string, key string")
    assert score_documents(none, SMALL).count() == 0
    out = score_documents(spark.createDataFrame([(None, "all held out")], "doc_id long, text string"), SMALL).collect()
    assert out[0].n_known == 0 and out[0].train_tokens == 0 and abs(out[0].base_score) < 1e-9


def test_rounds_end_only_when_converged(spark):
    docs = lm_hmm.marked(spark.read.parquet(f"{SF}/documents.parquet"))
    rules = HmmRules(states=2, symbols=50, head=400, gain=5e-4)
    vocab = lm_hmm.vocabulary(lm_hmm.token_counts(docs.where("not held_out")), rules)
    enc = lm_hmm.materialise(lm_hmm.encode(docs, spark.sparkContext.broadcast(vocab)), "test-encoded")
    _, log = lm_hmm.baum_welch(enc, vocab, rules)
    assert len(log) > 3 and log[-1] - log[-2] <= 5e-4 * -log[-1] and log[-1] > log[2]
    quick = HmmRules(states=2, symbols=50, head=400, gain=5e-4, start_tokens=vocab.total // 3)
    _, warm = lm_hmm.baum_welch(enc, vocab, quick)  # a start from a third; the last rounds are still over all rows
    assert warm[-1] - warm[-2] <= 5e-4 * -warm[-1] and warm[-1] > log[2] and warm[0] > log[1]
    assert HmmRules().rounds is None
    steps = [.095, .0013, .0014, .0016, .002, .03, .02, .004, .0005]
    log = list(-5.6 + np.cumsum([0, *steps]))
    assert [n for n in range(len(log) + 1) if lm_hmm.converged(log[:n], 5e-4)] == [len(log)]


def test_head_is_the_sorted_head(spark):
    import random

    from pyspark.sql import functions as F

    from seasoncast.llm.lm_hmm import END, _head, vocabulary, HmmRules
    rng = random.Random(4)
    for kind in ("zipf", "flat", "few"):
        n = 3000 if kind != "few" else 20
        rows = [(rng.randrange(-2 ** 63, 2 ** 63), 1 if kind == "flat" else 1 + int(3000 / (i + 1))) for i in range(n)] + [(END, 2)]
        counts = spark.createDataFrame(rows, "token long, c long").repartition(5)
        want = sorted(rows, key=lambda r: (r[0] != END, -r[1], r[0]))[:200]
        near = _head(counts, 200)
        assert near.count() <= 200 + 6 * 200 ** 0.5 + 200
        got = near.orderBy((F.col("token") != END), F.col("c").desc(), "token").limit(200).collect()
        assert [tuple(r) for r in got] == want
        v = vocabulary(counts, HmmRules(head=200, symbols=50))
        assert sorted(v.token.tolist()) == sorted(t for t, _ in want) and v.total == sum(c for _, c in rows) and v.distinct == len(rows)


def test_narrow_rounds_count_alike():
    import numpy as np

    from seasoncast.llm.lm_hmm import Hmm
    rng = np.random.default_rng(3)
    emit, move = rng.random((30, 4)), rng.random((4, 4))
    model = Hmm(np.full(4, 0.25), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    rows, alive = rng.integers(0, 30, (50, 700)), np.full(700, 50)
    wide, narrow = np.zeros((35, 4)), np.zeros((35, 4))
    a, b = model.expect(rows, alive, wide), model.narrow().expect(rows, alive, narrow)
    assert abs(a / b - 1) < 1e-6 and np.allclose(wide, narrow, rtol=1e-4)
