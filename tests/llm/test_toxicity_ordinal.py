"""Ordinal severity: held-out accuracy, likelihood against a plain evaluation, edges."""

import re

import numpy as np

from seasoncast.llm.toxicity_ordinal import OrdinalRules, fit_ordinal, severity, toxic_labels, train

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs.where("doc_id % 3 <> 0"), labels)
    seen = severity(docs.where("doc_id % 3 = 0"), model).join(toxic_labels(labels).withColumnRenamed("toxic", "truth"), "doc_id").collect()
    # about a quarter of the toxic labels stand on texts without any offending word
    insults = "trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron"
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = [r for r in seen if r.truth > 0]
    clear = [r for r in toxic if len(re.findall(insults, text[r.doc_id])) > 1]
    assert sum(r.toxic for r in clear) > 0.95 * len(clear) > 50
    assert sum(r.toxic for r in toxic) / len(toxic) > 0.75
    assert sum(r.toxic for r in seen if r.truth == 0) / len(seen) < 0.012
    assert np.mean([r.expected_severity for r in seen if r.truth == 0]) < 0.1
    assert np.mean([r.expected_severity for r in toxic]) > 0.8 and {r.grade for r in toxic} == {0, 1, 2}


def test_fit_is_ordered_and_better_than_the_frequencies():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        rows.append((int(g > 0), np.unique(np.concatenate([rng.integers(100, 140, 6), 10 + np.arange(g * 3)]))))
    model = fit_ordinal(rows, OrdinalRules())
    assert model.thresholds[0] < model.thresholds[1] and (model.weights >= 0).all()
    x = np.array([sum(model.weights[np.searchsorted(model.words, w)] for w in ws.view(np.uint64) if w in model.words) for _, ws in rows])
    assert np.mean((model.tails(x)[:, 0] >= 0.5) == [t for t, _ in rows]) > 0.99
    more = [np.mean(model.tails(x)[[len(set(range(10, 16)) & set(ws.tolist())) == n for _, ws in rows], 1]) for n in (0, 3, 6)]
    assert more == sorted(more) and more[2] > 0.8


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "idiot idiot", "z"), (3, "word " * 50000, "q"), (3, "word", "q")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, None, 1), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, toxic_labels(labels).collect())) == [(2, 1), (3, 0)]
    out = severity(docs, train(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.expected_severity <= 2 for r in out)
    none = labels.where("1 = 0")
    assert [r.toxic for r in severity(docs, train(docs, none)).collect()] == [False] * 5
    assert severity(docs.where("1 = 0"), train(docs.where("1 = 0"), labels)).count() == 0


def told(text):
    """Features of a text by their names: words, and beginnings of longer words; a feature met again counts as another one."""
    seen = {}
    for w in re.findall("[a-z0-9é]+", (text or "").lower()):
        raw = w.encode()
        for f in [("word", raw), *((n, raw[:n]) for n in (5, 6, 7, 8) if len(raw) > n)]:
            seen[f] = seen.get(f, 0) + 1
    return set(seen) | {("again", f) for f, n in seen.items() if n > 1}


def hashed(feature):
    import pyarrow as pa

    from seasoncast.llm.textvec import mix, pieces
    from seasoncast.llm.toxicity_ordinal import TWICE
    if feature[0] == "again":
        return hashed(feature[1]) ^ np.uint64(TWICE)
    kind, raw = feature
    (piece,) = pieces(pa.array([raw.decode("latin-1")]) if kind != "word" else pa.array([raw.decode()]), fold=True)
    h = piece.hasher(np.array([0]), np.array([len(raw)]))
    return (h if kind == "word" else mix(h + np.uint64(kind)))[0]


def test_severity_equals_a_plain_evaluation(spark):
    import random

    from seasoncast.llm.toxicity_ordinal import OrdinalModel
    rng = random.Random(8)
    vocabulary = ["idiot", "idiots", "idiotic", "trash", "trashy", "trashiest", "word", "other", "longerword", "longerwords", "scum"]
    names = [("word", b"idiot"), (5, b"idiot"), (5, b"trash"), ("word", b"scum"), (8, b"longerwo"), ("again", ("word", b"idiot")), ("again", (5, b"trash")), ("word", b"word")]
    weights = {f: rng.random() * 2 for f in names}
    keys = np.array([hashed(f) for f in names], np.uint64)
    order = np.argsort(keys)
    model = OrdinalModel(keys[order], np.array([weights[f] for f in names])[order], np.array([1.0, 3.5]))
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!", "..."]) for _ in range(rng.randrange(30))) for _ in range(300)] + [None, "", "IDIOT Idiot idiot", "scum " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in severity(docs, model).collect():
        score = sum(weights.get(f, 0.0) for f in told(texts[r.doc_id]))
        tails = [1 / (1 + np.exp(t - score)) for t in (1.0, 3.5)]
        mass = [1 - tails[0], tails[0] - tails[1], tails[1]]
        assert abs(r.expected_severity - sum(tails)) < 2e-6 and abs(r.p_toxic - tails[0]) < 2e-6
        assert r.grade == int(np.argmax(mass)) and r.toxic == (tails[0] >= 0.45)


def test_fit_is_a_least_point_of_the_plain_likelihood():
    from seasoncast.llm.toxicity_ordinal import _telling
    rng, rules = np.random.default_rng(5), OrdinalRules(rounds=3000, rate=0.02, ridge=1e-2)
    rows = []
    for _ in range(400):
        bad = rng.random() < 0.4
        rows.append((int(bad and rng.random() < 0.9), np.unique(np.concatenate([rng.integers(100, 130, 5), 10 + rng.integers(0, 8, rng.integers(1, 5) if bad else int(rng.random() < 0.1))]))))
    model = fit_ordinal(rows, rules)
    words = model.words.view(np.int64).tolist()
    flat = np.concatenate([w for _, w in rows]).view(np.uint64)
    toxic = np.array([t for t, _ in rows])
    assert words == _telling(flat, np.repeat(toxic, [len(w) for _, w in rows]), np.bincount(toxic) + np.array([1.0, 0.1]), rules).view(np.int64).tolist()
    n_told = np.array([len(set(w.tolist()) & set(words)) for _, w in rows])
    grade = toxic * (1 + (n_told > np.median(n_told[toxic == 1])))

    def cost(weights, thresholds):
        by, total = dict(zip(words, weights)), 0.0
        for (_, w), g in zip(rows, grade):
            score = sum(by.get(k, 0.0) for k in w.tolist())
            below = [0.0, *(1 / (1 + np.exp(score - t)) for t in thresholds), 1.0]
            total -= np.log(below[g + 1] - below[g])
        return total / len(rows) + 0.5 * rules.ridge * sum(x * x for x in weights)

    least = cost(model.weights, model.thresholds)
    for i in range(len(words)):
        for step in (0.05, -0.05):
            w = model.weights.copy()
            w[i] = max(0.0, w[i] + step)
            assert cost(w, model.thresholds) >= least - 1e-5
    for j in range(2):
        for step in (0.05, -0.05):
            t = model.thresholds.copy()
            t[j] += step
            assert cost(model.weights, t) >= least - 1e-5
