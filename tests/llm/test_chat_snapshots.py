"""Snapshot collapse against a plain version, with ties, nulls, long conversations and native plans."""

import random

from seasoncast.llm.chat_snapshots import collapse_snapshots


def key(t):
    return tuple((x is not None, x if x is not None else "") for x in t)


def plain(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn, role, text))
    said = {c: tuple((r, x) for _, r, x in sorted(t, key=key)) for c, t in talks.items()}
    first, copies = {}, {}
    for c in sorted(said):
        first.setdefault(said[c], c)
        copies[said[c]] = copies.get(said[c], 0) + 1
    proper = {s[:n] for s in first for n in range(1, len(s))}
    return {c: (len(s), copies[s], "".join(f"<|{r if r is not None else 'unknown'}|>\n{x or ''}\n<|end|>\n" for r, x in s)) for s, c in first.items() if s not in proper}


def collapsed(spark, rows, block):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, pos string")
    parts = {}
    for r in collapse_snapshots(df, block).collect():
        parts.setdefault(r.conv_id, []).append((r.part, r.n_turns, r.n_copies, r.rendered))
    return {c: (p[0][1], p[0][2], "".join(x[3] for x in sorted(p))) for c, p in parts.items()}


def test_prefixes_copies_and_edges(spark):
    rng = random.Random(3)
    rows = []
    for c in range(120):
        base = rng.randrange(12)
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t * rng.choice([1, 3]) if c % 7 == 0 else t, "user" if t % 2 == 0 else "assistant", f"say {base} {t}" if t < 5 else f"own {c % 20} {t}"))
    rows += [(200, None, None, None), (200, 0, "user", ""), (201, 0, "user", "tie"), (201, 0, "user", "tie"), (201, 0, "assistant", "tie"), (202, 0, "user", "tie"),
             (None, 0, "user", "lost"), (203, 0, None, "x"), (204, 0, "unknown", "x"), (205, 0, "user", None), (206, 0, "user", "")]
    rows += [(300, t, "user", f"long {t}") for t in range(700)] + [(301, t, "user", f"long {t}") for t in range(640)] + [(302, 10 ** 12 + 5 * t, "user", f"long {t}") for t in range(700)]
    want = plain(rows)
    assert 301 not in want and 302 not in want and 300 in want
    for block in (256, 4):
        assert collapsed(spark, rows, block) == want


def test_empty_and_native(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert collapse_snapshots(none).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert "Python" not in collapse_snapshots(one)._jdf.queryExecution().executedPlan().toString()
