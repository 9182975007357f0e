"""Edit-distance decontamination against a plain dynamic programme."""

import random
import re

import numpy as np

from seasoncast.llm.edit_decontam import WHOLE, EditRules, decontaminate, edit_distance, leaks, nearest_end

SF = "/root/testdata/sf0.001"


def fold(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub(r"[A-Z\xc0-\xd6\xd8-\xde]", lambda m: m.group().lower(), text or ""))


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def plain_best(doc, item):
    n, allowed = len(item), int(0.2 * len(item) + 1e-9)
    if n < 5 or len(set(item) & set(doc)) < len(set(item)) - allowed:
        return None
    best = min((plain_distance(item, doc[i:i + n]) for i in range(len(doc)) if len(doc[i:i + n]) >= n - allowed), default=n)
    return best if best <= allowed else None


def test_vector_distance_is_exact():
    rng = np.random.default_rng(1)
    a, b, n = rng.integers(2, 6, (300, 9)), rng.integers(2, 6, (300, 9)), rng.integers(4, 10, 300)
    got = edit_distance(a, b, n)
    assert got.tolist() == [plain_distance(x.tolist(), y[:k].tolist()) for x, y, k in zip(a, b, n)]


def test_planted_passages_and_edges(spark):
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [t for t, in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    rows = [(i, t) for i, t in enumerate(clean)]
    for n, (_, text) in enumerate(items):
        words = text.split()
        for _ in range(int(0.2 * len(fold(text))) * (n % 3) // 2):
            at = rng.randrange(len(words))
            words[at:at + 1] = [["Xq" + str(rng.random())[2:]], [], [words[at], "zz"]][rng.randrange(3)]
        at = rng.randrange(200)
        rows.append((100 + n, clean[n % 60][:at] + " " + " ".join(words).upper() * (n % 2) + " ".join(words) * (1 - n % 2) + " " + clean[n % 60][at:]))
    rows += [(None, items[0][1]), (900, None), (901, ""), (902, "for for for " * 4000), (903, items[1][1]), (903, items[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(None, "a b c d e f"), (800, None), (801, "too short")] + items[:3], "item_id long, text string")
    want = []
    for d, t in rows:
        f = fold(t)
        for i, x in items:
            best = plain_best(f, fold(x))
            if best is not None:
                want.append((d, i, best))
    got = [(r.doc_id, r.item_id, r.distance) for r in leaks(docs, bench).collect()]
    missed = {(d, i) for d, i, _ in want} - {(d, i) for d, i, _ in got}
    assert not {(d, i) for d, i, _ in got} - {(d, i) for d, i, _ in want}
    assert len(missed) <= 0.01 * len(want), missed
    assert sum(w not in got for w in want) <= 0.05 * len(want)
    kept = {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _, _ in got} and None not in kept


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g", "x")], "doc_id long, text string, item_id string")
    assert leaks(none, bench).count() == leaks(some, bench).count() == 0
    assert decontaminate(some, bench).collect() == some.collect()


def plain_whole(doc, item):
    """Least distance of the item to any run of words of the document: Sellers' programme, free at both ends."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        old, row[0] = row[:], i
        for j, y in enumerate(doc, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return min(row)


def test_nearest_end_is_exact():
    rng = np.random.default_rng(2)
    a, b, n = rng.integers(2, 6, (300, 9)), rng.integers(2, 6, (300, 12)), rng.integers(4, 13, 300)
    want = [min(plain_distance(x.tolist(), y[:j].tolist()) for j in range(k + 1)) for x, y, k in zip(a, b, n)]
    assert nearest_end(a, b, n).tolist() == want


def test_items_with_words_put_in_or_left_out(spark):
    rng = random.Random(11)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(40))) for i in range(25)]
    rows, planted = [], {}
    for share in (0.1, 0.15, 0.2):
        for kinds in ((0,), (1,), (0, 1, 2)):
            for i, text in items:
                words = text.split()
                for n in range(int(share * 40)):
                    at = rng.randrange(len(words))
                    kind = rng.choice(kinds)
                    words[at:at + (kind != 0)] = [[f"new{n}"], [], [f"new{n}"]][kind]
                fill = [f"f{rng.randrange(5000)}" for _ in range(60)]
                rows.append((len(rows), " ".join(fill[:30] + words + fill[30:])))
                planted[rows[-1][0]] = (share, kinds, i)
    want = {(d, i): best for d, t in rows for i, x in items if (best := plain_whole(t.split(), x.split())) <= 8}
    assert all((d, i) in want for d, (_, _, i) in planted.items())
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in leaks(docs, bench, WHOLE).collect()}
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.995 * len(want)
    assert {r.doc_id for r in decontaminate(docs, bench, WHOLE).collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert len(leaks(docs, bench, EditRules()).collect()) < 0.8 * len(want)  # windows of the item's length miss them
