"""Line quality against a plain per-text version."""

import re
from collections import Counter

import pytest

from seasoncast.llm.line_quality import LineRules, clean_documents, quality_report

SF = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), base)


def plain_line_fails(line, r=LineRules()):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    if not words:
        return False
    ink = len("".join(words).encode())
    closed = words[-1][-1] in ".!?:;\"')]}" or ord(words[-1][-1]) >= 128
    bars = line.count("|") + line.count(">")
    return ((not closed and len(words) < r.short_line) or line.count("!") > r.max_shouts * len(words)
            or (bars >= r.min_bars and bars > r.max_bars * len(words))
            or len(re.findall(r"[#*$%&|<>]", line)) > r.max_symbols * ink
            or any(p in line.lower() for p in r.boilerplate))


EDGES = [None, "", " \n\t ", "one", "a b c a b c a b c", "x\x0by\x0cz w é ü", "same line.\nsame line.\nsame line.",
         "word " * 30000, "Home | News | About\n" + "Good words stand here in a line. " * 20, "Z" * 100000, "# * $ % & | < >"]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(EDGES)] + [(None, "no id"), (10_000, None)], "doc_id long, text string")
    return real.union(own)


def test_base_figures_and_verdict(docs):
    texts = sorted(map(tuple, docs.collect()), key=str)
    want = []
    for i, t in texts:
        lines = (t or "").split("\n")
        ink = [len(re.sub(r"[\x20\x09-\x0D]", "", x).encode()) for x in lines]
        bad = [plain_line_fails(x) for x in lines]
        lost = sum(w for w, b in zip(ink, bad) if b) / max(1, sum(ink))
        b = plain(t)
        want.append((i, *b, not b[5] and lost <= LineRules().max_loss, sum(bad)))
    got = quality_report(docs).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)


def test_cleaned_text_and_columns(spark):
    good = " ".join(f"Good{i} words{i} stand{i} here{i} in{i} a{i} line{i}." for i in range(20))
    assert not plain(good)[5]
    rows = [(1, good, "a", "x"), (2, "Home | News | About\n" + good + "\nmenu", "b", None), (3, None, "c", "y"), (4, "Home | News | About\n" * 40, "d", "z")]
    out = clean_documents(spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words string"))
    assert sorted(map(tuple, out.collect())) == [(1, good, "a", "x"), (2, good, "b", None)]
    assert out.columns == ["doc_id", "text", "kept", "n_words"]
    assert clean_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_good_labels_stay_and_bad_go(spark):
    sf = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    r = quality_report(spark.read.parquet(f"{sf}/documents.parquet")).join(lab, "doc_id").groupBy("quality").agg({"kept": "count"}).collect()
    kept = {x[0]: x[1] for x in quality_report(spark.read.parquet(f"{sf}/documents.parquet")).where("kept or n_words < 50").join(lab, "doc_id").groupBy("quality").count().collect()}
    total = {x[0]: x[1] for x in r}
    assert kept[1] / total[1] > 0.97
    assert kept.get(0, 0) / total[0] < 0.2
