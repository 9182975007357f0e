"""LSH forest join against all pairs on small tables."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from seasoncast.llm.components import components
from seasoncast.llm.lsh_forest_join import ForestRules, candidate_edges, jaccard_classes, one_of_each, remaining_edges, shortest_prefix

SF = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    sets = [grams(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label, out = [None] * len(rows), []
    for i in range(len(rows)):
        todo = [i] if label[i] is None else []
        while todo:
            k = todo.pop()
            if label[k] is None:
                label[k] = i
                todo += near[k]
    for i, (d, _) in enumerate(rows):
        same = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        copies = sum(sets[k] == sets[i] for k in range(len(rows))) if sets[i] else 1
        texts = len({sets[k] for k in near[i]} - {sets[i]})
        out.append((d, (min(same) if same else None) if sets[i] else d, len(near[i]), texts, copies))
    return out


def crowd(n, words, rng, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 9)}"
        yield " ".join(w)


def check(spark, rows, rules=ForestRules()):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_classes(docs, rules).collect()), key=str)
    assert got == sorted(plain(rows), key=str)
    return docs


def test_prefix_is_shortened_to_the_recall():
    depth = shortest_prefix(ForestRules())
    assert 1 - (1 - .8 ** depth) ** 25 >= .9999 > 1 - (1 - .8 ** (depth + 1)) ** 25


def test_table_edges_and_crowds(spark):
    rng = random.Random(4)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    texts = [t for k in range(25) for t in crowd(3, 12 + 9 * k, rng, 4)] + list(crowd(70, 150, rng, 8))
    texts += [None, "", "  \n", "one", "one", "a b c d", "a b c d", "a b c d e", "a b c d e", "z " * 20_000, "z " * 10]
    rows += [(10_000 + i, t) for i, t in enumerate(texts)] + [(None, "a b c d e"), (3, rows[3][1]), (None, "only without id here at all")]
    docs = check(spark, rows)
    classes = {r[:2] for r in plain(rows)}
    kept = one_of_each(docs.withColumn("id", docs.text)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({d for d, c in classes if d is not None and d == c})
    assert sum(r.doc_id is None for r in kept) == 2 and len(kept[0]) == 3


def test_crowded_buckets_and_blocks(spark):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate([*crowd(160, 120, rng, 9), *crowd(40, 80, rng, 4), "lone text of six words here"])]
    check(spark, rows, ForestRules(bucket=20, block=30))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_classes(none).count() == 0 and one_of_each(none).count() == 0


def test_rows_go_not_ids(spark):
    rng = random.Random(2)
    a, b = ([f"w{rng.randrange(9999)}" for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join(w[:-1])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (7, "some other text that nobody else has at all"), (8, near(b)), (9, " ".join(a)), (9, " ".join(a)),
            (5, " ".join(a)), (None, near(a)), (11, ""), (11, " "), (11, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(docs).collect()), key=str)
    assert kept == sorted([(5, " ".join(a)), (5, " ".join(b)), (7, "some other text that nobody else has at all"), (None, near(a)), (11, ""), (11, " ")], key=str)


def test_recall_in_a_crowded_family(spark):
    """2,000 texts of one template, 0.3 to 0.5 alike, 200 planted pairs of 0.8 and a little more: buckets are cut, pairs are found."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for k in range(2000):
        w = list(base)
        for s in range(0, 120, 20):  # a run of own words in each part
            for j in range(s, s + 6):
                w[j] = f"t{k}x{j}"
        texts.append(w)
    for k in range(200):
        w = list(texts[k])
        for j in (15, 75):
            w[j] = f"p{k}x{j}"
        texts.append(w)
    sets = [grams(" ".join(w)) for w in texts]
    alike = [len(sets[k] & sets[2000 + k]) / len(sets[k] | sets[2000 + k]) for k in range(200)]
    assert all(0.8 <= x < 0.9 for x in alike) and 0.2 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.6
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    for rules in (ForestRules(), ForestRules(bucket=100, block=300)):
        got = {r.doc_id: r for r in jaccard_classes(docs, rules).collect()}
        assert sum(got[2000 + k].class_id == k and got[k].n_text_links == 1 for k in range(200)) >= 180
        assert sum(r.n_text_links for r in got.values()) <= 400


def test_cut_buckets_lose_no_pair(spark):
    """One prefix that all texts share, deep prefixes that none do: similar signatures meet although the bucket takes six."""
    rng = np.random.default_rng(21)
    sig = rng.integers(0, 1 << 32, (80, 125), dtype=np.uint32)
    sig[:, 0] = 7
    sig[40:, 31:] = sig[:40, 31:]  # 95 of 125 values of the text 40 rows before
    texts = spark.createDataFrame([(i + 1, bytearray(r.tobytes())) for i, r in enumerate(sig)], "id long, sig binary").repartition(3)
    for rules in (ForestRules(tries=1, bucket=6, block=13), ForestRules(tries=1, bucket=1000)):
        got = {r.id: r.component for r in components(candidate_edges(texts, rules)).collect()}
        assert got == {i + 1: i % 40 + 1 for i in range(80)}
    assert remaining_edges(texts, texts.select(F.lit(1).cast("long").alias("short"), "id"), candidate_edges(texts, ForestRules(tries=1)), ForestRules()).count() == 0
