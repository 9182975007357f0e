"""Automaton search against a plain scorer, with ties, nulls, blocks of items and separators of every kind."""

import math
import random
import re
from collections import Counter

from seasoncast.llm.lexical_scan import TERM, ScanRules, search


def terms_of(text):
    return re.findall(TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    held = {}
    for item, text in items:
        held.setdefault(item, set()).update(terms_of(text))
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, wanted in held.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // total if total else 50
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, rules=ScanRules(), parts=3):
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(parts)
    b = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, rank double")
    return sorted([tuple(r) for r in search(d, b, rules).collect()], key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "日本語", "Don't", "x-ray", "A1", "a1", "é"]
    seps = [" ", "\n", ", ", ".", "\t", " ", "'", "\x00", "_", "  "]
    text = lambda n: "".join(rng.choice(words[:rng.choice([8, 68])]) + rng.choice(seps) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(150)]
    docs += [(i + 200, docs[7][1]) for i in range(30)] + [docs[7]] * 3 + [(400, None), (401, ""), (402, " .,-"), (None, docs[7][1]), (None, "zebra w1"), (7, "zebra w1"), (403, "w2 " * 30000)]
    items = [(i, text(rng.choice([1, 3, 12]))) for i in range(40)] + [(50, "w1 w1 W1"), (51, None), (52, "?!"), (53, "nowhere"), (54, "Zebra"), (None, "w2 w3"), (50, "w1 w1 W1"), (50, "w5")]
    return docs, items


def test_equals_plain(spark):
    docs, items = corpus()
    want = plain(docs, items)
    assert any(d is None for _, _, d, _ in want) and len(want) > 1000
    assert found(spark, docs, items) == want


def test_blocks_short_lists_and_small_cells(spark):
    docs, items = corpus(9)
    assert found(spark, docs, items, ScanRules(block_bytes=400)) == plain(docs, items)
    assert found(spark, docs, items, ScanRules(top=3, lanes=2, cells=64), parts=7) == plain(docs, items, 3)


def test_guards_hold_between_texts(spark):
    docs = [(1, "ab"), (2, "c"), (3, "ab c"), (4, "abc"), (5, "ab  ab")]
    items = [(1, "abc"), (2, "ab"), (3, "c ab")]
    assert found(spark, docs, items, parts=1) == plain(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
