"""The mix against a plain version: targets, words taken, the schedule's evenness, texts and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from seasoncast.llm.source_schedule import WORD, MixRules, mix, mixed_texts, plan_sources, schedule, stacked, words_taken

SCHEMA = "doc_id long, text string, source string, size string, slot int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA).repartition(parts)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice("ab") for _ in range(k))
    rows = [(i, text(rng.choice([0, 1, 3, 30, 90])), rng.choice(["big"] * 6 + ["a", "b", "é", "z", None])) for i in range(n)]
    rows += [(n, "one two three", "tiny"), (n + 1, "w " * 5000, "long"), (n + 2, None, "none"), (n + 3, "", "none"), (None, "x y\nz", "a"), (None, "x y\nz", "a")]
    return rows + [(n + 9, "same words here", "b")] * 40


def targets(sizes, weights=(5, 2, 1), repeats=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        got = {s: left * weight[s] / w for s in free}
        over = [s for s in free if got[s] > repeats * sizes[s]]
        if not over:
            return {**got, **fixed}
        fixed.update({s: repeats * sizes[s] for s in over})


def count(text):
    return len(re.findall(WORD, text or ""))


def sizes_of(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += count(text)
    return dict(sizes)


@pytest.mark.parametrize("block", [1024, 7])
def test_words_taken(spark, block):
    rows = corpus()
    sizes, want = sizes_of(rows), targets(sizes_of(rows))
    got = words_taken(frame(spark, rows), MixRules(block=block)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, count(t)) for d, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    assert Counter(got) == Counter(words_taken(frame(spark, rows, 7), MixRules(block=block)).collect())


def test_mix_is_even_and_its_texts_are_the_documents(spark):
    rows, rules = corpus(2, 300), MixRules(block=20)
    got = sorted(mixed_texts(frame(spark, rows), rules).collect(), key=lambda r: (r.slot, r.first))
    want, total = targets(sizes_of(rows)), sum(sizes_of(rows).values())
    assert all(count(r.text) == r.n_words for r in got)
    whole = {(d, s): re.findall(WORD, t or "") for d, t, s in rows}
    assert all(r.text.split(" ") == whole[r.doc_id, r.source][r.from_word:r.from_word + r.n_words] for r in got)
    seen, so_far, last = defaultdict(int), 0, max(r.slot for r in got)
    for r in got:
        seen[r.source] += r.n_words
        so_far += r.n_words
        if r.slot < last * 0.9:  # within a few blocks of the share, all along
            assert all(abs(seen[s] - so_far * want[s] / total) <= 8 * 20 for s in want)
    per_slot = Counter()
    for r in got:
        per_slot[r.slot] += r.n_words
    assert max(per_slot.values()) <= 20
    taken = Counter()
    for r in got:
        taken[r.source, r.doc_id, r.key] += r.n_words
    digest = Counter()
    for r in words_taken(frame(spark, rows), rules).collect():
        digest[r.source, r.doc_id] += r.taken
    assert {k: v for k, v in digest.items() if v} == {k: sum(v for (s, d, _), v in taken.items() if (s, d) == k) for k in digest if digest[k]}


def test_schedule_has_every_slot_once(spark):
    sources = plan_sources(stacked(frame(spark, corpus(3))), MixRules(block=5)).cache()
    slots = schedule(sources).collect()
    assert len({s.slot for s in slots}) == len(slots) == sum(r.need for r in sources.collect())
    for r in sources.collect():
        mine = sorted((s for s in slots if s.sid == r.sid), key=lambda s: s.slot)
        assert [s.rank for s in mine] == list(range(r.need)) and sum(s.words for s in mine) == r["take"]


def test_many_rows_use_leaves(spark):
    rows = [(i, "w " * (i % 5), "hot" if i % 3 else f"s{i % 7}") for i in range(12_000)]
    sizes, got = sizes_of(rows), words_taken(frame(spark, rows)).collect()
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert len(got) == 12_000 and all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_edges_and_native(spark):
    assert words_taken(frame(spark, [])).collect() == [] and mix(frame(spark, [])).collect() == []
    none = words_taken(frame(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert sorted((r.doc_id, r.taken, r.target) for r in none) == [(1, 0, 0.0), (2, 0, 0.0)]
    one = words_taken(frame(spark, [(1, "a b", None)]))
    assert [tuple(r) for r in one.collect()] == [(1, None, 2, 2, 2.0, 2)]
    assert "Python" not in one._jdf.queryExecution().executedPlan().toString() and "Arrow" not in one._jdf.queryExecution().executedPlan().toString()
