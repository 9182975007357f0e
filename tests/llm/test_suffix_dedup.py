"""Suffix arrays against sorting, removal against counting every window."""

import hashlib
import random
from collections import Counter

from seasoncast.llm.suffix_dedup import RepeatRules, remove_repeats, suffix_array

SF = "/root/testdata/sf0.001"


def test_suffix_array_is_right():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 5, 8, 13, 30, 80]:
        for _ in range(120):
            s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
            assert suffix_array(s) == sorted(range(n), key=lambda i: s[i:]), s
    assert suffix_array([1] * 3000) == list(range(2999, -1, -1))


def plain(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + size] for d in raw for i in range(len(d) - size + 1))
    out = []
    for (doc, _), d in zip(rows, raw):
        cover = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i:i + size]] > 1:
                cover[i:i + size] = b"\x01" * size
        kept = bytes(b for b, c in zip(d, cover) if not c)
        runs = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out.append((doc, len(d), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def check(spark, rows, rules=RepeatRules()):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, rules).collect())
    want = plain(rows, rules.length)
    assert got == want, (list((got - want).items())[:4], list((want - got).items())[:4])


def word(rng):
    return "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))


def test_tables(spark):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_planted_passages_and_edges(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choice("pqrstuv wxyz") for _ in range(n)) for n in (199, 200, 201, 240, 260, 330, 700, 1500)]
    rows = []
    for i in range(150):
        text = " ".join(word(rng) for _ in range(rng.randrange(60)))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 40) if rng.random() < .5 else 0
            text += p[a:len(p) - (rng.randrange(40) if rng.random() < .5 else 0)] + " ".join(word(rng) for _ in range(rng.randrange(40)))
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, "z" * 5000), (503, "ab" * 150), (504, "short"), (504, "short"), (None, rows[0][1]), (505, "é" * 100), (506, "xé" * 500 + "y" * 199)]
    check(spark, rows)
    check(spark, rows, RepeatRules(crowd=3, bitmap=10, batch=200))
    check(spark, rows, RepeatRules(length=40, gram=8, block=10, crowd=4))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string, key string")).count() == 0
