"""Personal data: base spans against the stated patterns, disclosing terms against a plain count."""

import hashlib
import math
import random
import re

from seasoncast.llm.pii_disclosure import DisclosureRules, base_spans, pii_report, sanitise_documents

SF = "/root/testdata/sf0.001"


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def plain(text):
    text, out = text or "", []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                 ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if (k == "email" or k == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or k == "card" and 12 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], ("email", "ip", "card", "phone").index(s[2])))


def test_base_spans_follow_the_patterns():
    rng = random.Random(3)
    cases = ["a@b.co_x@c.de", "x@@y.z", "@a.b", "a@b.c.d.@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.02.3.4", "+1 (017) 555-7713", "4111 1111-1111 1111",
             "é+49 30 1234567 é 79927398713 799273987130", "a.b@c-d.e-f", "5", "+1", "é" * 50 + "q@w.e"]
    cases += ["".join(rng.choice("ab@.1+ -()é29") for _ in range(rng.randrange(80))) for _ in range(4000)]
    for t in cases:
        assert base_spans(t) == plain(t), t
    assert base_spans("9" * 300_000) == [] and base_spans("a" * 300_000) == []


def test_disclosing_terms_and_edges(spark):
    filler = [f"common words in plain row number {i} of text" for i in range(200)]
    secret = [f"intro {i} Zaphod works at mailbox zaph@hitch.org beside gate tower common words" for i in range(5)]
    rows = [(i, t) for i, t in enumerate(filler + secret)] + [(None, secret[0]), (900, None), (901, ""), (900, None), (902, "zaphod alone tower")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.spans): r for r in pii_report(docs).collect()}
    assert len(pii_report(docs).collect()) == len(rows)
    total, n_e = len(rows), 6
    for (i, spans), r in got.items():
        text = dict(rows).get(i) if i is not None else secret[0]
        base = ",".join(f"{k}:{s}:{e}" for s, e, k in plain(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        want = plain(text)
        if plain(text):
            s0, e0, _ = plain(text)[0]
            before = list(re.finditer(r"[A-Za-z0-9]+", text[:s0]))[-10:]
            after = list(re.finditer(r"[A-Za-z0-9]+", text[e0:]))[:10]
            for m, off in [(m, 0) for m in before] + [(m, e0) for m in after]:
                w = m.group().lower()
                if len(w) < 3 or w == str(i):
                    continue
                df = sum(w in re.findall("[a-z0-9]+", (t or "").lower()) for _, t in rows)
                both = sum(w in re.findall("[a-z0-9]+", t.lower()) for _, t in rows if t and "@" in t)
                share = math.log2(both * total / (n_e * df)) / math.log2(total / n_e)
                if both >= 3 and share >= 0.6:
                    want.append((off + m.start(), off + m.end(), "term_removed" if share >= 0.85 else "term_generalised"))
        assert spans == ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(want))
    clean = {r.doc_id: r.text for r in sanitise_documents(docs).collect()}
    assert "Zaphod" not in clean[200] and "[EMAIL]" in clean[200] and "common words" in clean[200]
    assert clean[902] == "zaphod alone tower" and clean[900] is None and clean[3] == filler[3]


def test_tables_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in pii_report(docs).join(docs, "doc_id").collect():
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in plain(r.text)).encode()).hexdigest()
    none = spark.createDataFrame([], "doc_id long, text string, hints string")
    assert pii_report(none).count() == 0 and sanitise_documents(none.drop("hints")).count() == 0
    odd = spark.createDataFrame([(1, "mail x@y.zz now", 4, "k", "h", "i")], "doc_id long, text string, n_chars int, entity string, hints string, _id string")
    assert [tuple(r) for r in sanitise_documents(odd).collect()] == [(1, "mail [EMAIL] now", 16, "k", "h", "i")]
    assert DisclosureRules().window == 10


def test_terms_of_the_whole_text_are_hidden(spark):
    filler = [f"common words in plain row number {i} of text" for i in range(200)]
    gap = " common words in plain row of text" * 4
    far = [f"Zaphod opens profile {i}{gap} write to zaph@hitch.org{gap} and zaphod signs" for i in range(5)]
    rows = [*enumerate(filler + far), (300, far[0]), (None, far[1]), (400, "Zaphod stands alone"), (401, f"Zaphod{gap} other@mail.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in sanitise_documents(docs).collect()}
    for i in (200, 204, 300, None):
        assert "zaphod" not in clean[i].lower() and "[EMAIL]" in clean[i] and "common words" in clean[i], clean[i]
    assert clean[400] == "Zaphod stands alone" and clean[401] == f"Zaphod{gap} [EMAIL]"  # not a text of the entity
    near = {r.doc_id: r.text for r in sanitise_documents(docs, DisclosureRules(whole_texts=False)).collect()}
    assert near[200].startswith("Zaphod") and near[200].endswith("zaphod signs")
    spans = {r.doc_id: r.spans for r in pii_report(docs).collect()}
    for i, text in rows[200:206]:
        want = [(m.start(), m.end()) for m in re.finditer("(?i)zaphod", text)]
        got = [tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s.startswith("term")]
        assert set(want) <= set(got)


def test_rows_without_ids_keep_their_own_hints_and_directories_their_pairs(spark):
    filler = [f"common words in plain row number {i} of text" for i in range(400)]
    people = {n: [f"{n} opens profile {i} and writes to {n}@hitch.org common words" for i in range(4)] for n in ("zaphod", "trillian", "marvin")}
    page = " ".join(f"person{i} lives at street{i} mail person{i}@book.net" for i in range(150))
    pages = [page + f" edition{k} common words" for k in range(3)]
    rows = [(None, t) for own in people.values() for t in own] + list(enumerate(filler)) + [(7, t) for t in pages]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clean = [r.text for r in sanitise_documents(docs).collect()]
    assert len(clean) == len(rows)
    for name in people:
        assert sum(f"[EMAIL] common words" in t for t in clean) >= 12 and not any(name in t for t in clean)
    whole = [t for t in clean if "edition" in t]
    assert len(whole) == 3 and all("person" not in t and "street" not in t and t.count("[EMAIL]") == 150 for t in whole)


def test_document_frequencies_count_every_text(spark):
    from collections import Counter

    from seasoncast.llm.pii_disclosure import term_frequencies
    from seasoncast.llm.textvec import pieces
    import pyarrow as pa
    rng = random.Random(6)
    texts = [" ".join(f"word{min(int(rng.paretovariate(0.6)), 900)}" for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "ab c", "word1 WORD1 word1."]
    want = Counter(w for t in texts for w in set(re.findall("[a-z0-9]{3,}", (t or "").lower())))
    (piece,) = pieces(pa.array([" ".join(want)]), fold=True)
    start, end, _ = piece.words()
    name = dict(zip(piece.hasher(start, end).view("int64").tolist(), want))
    for hold in (1 << 20, 50):
        got = term_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), hold).collect()
        assert {name[r.term]: r.df for r in got} == dict(want)
