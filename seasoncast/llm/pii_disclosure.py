r"""Personal data and the terms that give it away.

Pattern matches (email, ip, card, phone) are the protected entities.  Corpus
co-occurrence estimates how much a term in a text with an entity discloses it:
with document frequencies over all documents, PMI(term; entity) / IC(entity) is
the share of the entity's information that the term reveals.  In every text
that holds the entity, wherever they stand in it, terms above
``remove_at`` are removed, those above ``generalise_at`` are replaced by their
kind of word; texts without the entity keep them.  Entities that a large share of documents name are public and
have no terms to hide.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.llm.bitmaps import key_filter, passes
from seasoncast.llm.textvec import pieces, small
from seasoncast.session import materialise

KINDS = ("email", "ip", "card", "phone")
METHOD_KINDS = ("term_removed", "term_generalised")
_ORDER = {k: i for i, k in enumerate(KINDS + METHOD_KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


@dataclass(frozen=True)
class DisclosureRules:
    """Production settings."""

    whole_texts: bool = True     # terms of the whole text that holds an entity; otherwise those in its window
    window: int = 10             # words either side of an entity
    min_documents: int = 3       # documents that must show a term with an entity
    min_information: float = 4.0  # bits; entities in more than 1/16 of the documents are public
    generalise_at: float = 0.6
    remove_at: float = 0.85


def _emails(text: str):
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list:
    """``(start, end, kind)`` in code points: leftmost, non-overlapping per kind; failing matches are dropped."""
    spans = [(s, e, "email") for s, e in _emails(text)]
    if re.search(r"[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                spans.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = _DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def _entity(text: str, start: int, end: int, kind: str) -> int:
    value = text[start:end].lower() if kind == "email" else _DIGITS.sub("" if kind != "ip" else ".", text[start:end])
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _entities(text: str, spans: list) -> dict:
    """The spans of each entity of a text."""
    out = {}
    for s, e, kind in spans:
        out.setdefault(_entity(text, s, e, kind), []).append((s, e))
    return out


def _nearby(text: str, spans: list, entities: dict, rules: DisclosureRules):
    """``(terms, starts, ends, {entity: places})``: folded words outside all spans that may tell of each entity; code points."""
    (piece,) = pieces(pa.array([text], pa.large_string()), fold=True)
    start, end, _ = piece.words()
    hashes = piece.hasher(start, end).view(np.int64)
    if len(text) != len(piece.data):
        points = np.append(np.cumsum((piece.data & 0xC0) != 0x80) - 1, len(text))
        start, end = points[start], points[end]
    free = end - start >= 3
    for s, e, _ in spans:
        free[np.searchsorted(end, s, side="right"):np.searchsorted(start, e, side="left")] = False
    if rules.whole_texts:
        near = dict.fromkeys(entities, np.flatnonzero(free))
    else:
        near = {}
        for entity, own in entities.items():
            close = np.zeros(len(start), bool)
            for s, e in own:
                left, right = np.searchsorted(end, s, side="right"), np.searchsorted(start, e, side="left")
                close[max(0, left - rules.window):left] = close[right:right + rules.window] = True
            near[entity] = np.flatnonzero(close & free)
    return hashes, start, end, near


def entity_rows(docs: DataFrame) -> DataFrame:
    """``(entity, n)`` over the document rows that hold each entity, added up for each Arrow batch."""
    def run(batches):
        for batch in batches:
            count = Counter()
            for text in batch.column(0).to_pylist():
                if text and (spans := base_spans(text)):
                    count.update(_entities(text, spans).keys())
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.int64()), pa.array(count.values(), pa.int64())], ["entity", "n"])

    return docs.select("text").mapInArrow(lambda b: run(small(b)), "entity long, n long")


def contexts(docs: DataFrame, rules: DisclosureRules, wanted: np.ndarray, chosen: np.ndarray | None = None) -> DataFrame:
    """``(row, entity, term, n)`` over the wanted entities and the terms told with them, once a document row.

    Without ``chosen`` row is null and ``n`` counts many documents; with it, the
    chosen pairs of each document are returned by the row's digest.
    """
    held = docs.sparkSession.sparkContext.broadcast((wanted, chosen))
    names = ["row", "entity", "term", "n"]

    def pairs(batches):
        wanted, chosen = held.value
        for batch in small(batches):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or not (spans := base_spans(text)):
                    continue
                entities = _entities(text, spans)
                codes = np.array(list(entities), np.int64)
                entities = {e: entities[e] for e in codes[passes(wanted, codes)].tolist()}
                if entities:
                    hashes, _, _, near = _nearby(text, spans, entities, rules)
                    for entity, places in near.items():
                        terms = np.unique(hashes[places])
                        if chosen is not None:
                            terms = terms[passes(chosen, terms ^ np.int64(entity))]
                        if len(terms):
                            yield row, entity, terms

    def run(batches):
        def out(rows):
            size = [len(t) for *_, t in rows]
            row = pa.array([d for d, *_ in rows], pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), size)))
            entity, term = np.repeat([e for _, e, _ in rows], size), np.concatenate([t for *_, t in rows])
            if held.value[1] is not None:
                return pa.RecordBatch.from_arrays([row, pa.array(entity), pa.array(term), pa.array(np.ones(len(term), np.int64))], names)
            sums = pa.table({"entity": entity, "term": term}).group_by(["entity", "term"]).aggregate([([], "count_all")]).combine_chunks()
            columns = [sums[c].combine_chunks() for c in ("entity", "term", "count_all")]
            return pa.RecordBatch.from_arrays([pa.nulls(len(sums), pa.int64()), *columns], names)

        rows, n = [], 0
        for row in pairs(batches):
            rows.append(row)
            n += len(row[2])
            if n > 200_000:
                yield out(rows)
                rows, n = [], 0
        if rows:
            yield out(rows)

    return docs.select(_row_digest().alias("row"), "text").mapInArrow(run, "row long, entity long, term long, n long")


def _row_digest():
    """Key of a document row: null and repeated ids with texts of their own stay apart."""
    return F.xxhash64("doc_id", "text")


def _summed(counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``(keys, n)`` parts by key."""
    keys, n = (np.concatenate(c) for c in zip(*counts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def term_frequencies(docs: DataFrame, hold: int = 1 << 20) -> DataFrame:
    """``(term, df)``: the documents that hold each word of three or more bytes, over all documents.

    A task sums its texts' words and sends a sum when it holds ``hold`` terms, or ends.
    """
    def run(batches):
        held, size = [], 0

        def send():
            keys, n = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["term", "df"])

        for batch in batches:
            for piece in pieces(batch.column(0), fold=True):
                start, end, doc = piece.words()
                long = end - start >= 3
                if not long.any():
                    continue
                hashes, doc = piece.hasher(start[long], end[long]), doc[long]
                order = np.argsort(hashes, kind="stable")  # documents stay in order inside a term
                hashes, doc = hashes[order], doc[order]
                once = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]
                held.append(_summed([(hashes[once], np.ones(int(once.sum()), np.int64))]))
                size += len(held[-1][0])
                if size > hold:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > hold // 2:
                        yield send()
                        size = 0
        if held:
            held = [_summed(held)]
            yield send()

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing_terms(docs: DataFrame, rules: DisclosureRules) -> tuple | None:
    """``(entity, term, share)`` of the terms at or over ``generalise_at``, and the filter of the entities counted; None if there is none.

    Counts are summed in the tasks and grouped by Spark, those of the pairs only
    for entities within the bounds, and joined exactly.  Only filters, sized by
    what they hold, reach the driver.
    """
    total = docs.count()
    if not total:
        return None
    entities = materialise(entity_rows(docs).groupBy("entity").agg(F.sum("n").alias("n_entity"))
                           .where((F.col("n_entity") >= rules.min_documents) & (F.log2(F.lit(total) / F.col("n_entity")) >= rules.min_information)), "entities")
    wanted = key_filter(entities, F.col("entity"))
    if wanted is None:
        return None
    pairs = materialise(contexts(docs, rules, wanted).groupBy("entity", "term").agg(F.sum("n").alias("n_both"))
                        .where(F.col("n_both") >= rules.min_documents).join(entities, "entity"), "pairs")
    if pairs.isEmpty():
        return None
    scored = pairs.join(term_frequencies(docs).where(F.col("df") >= rules.min_documents), "term")
    n = F.lit(float(total))
    pmi = F.log2(F.col("n_both") * n / (F.col("n_entity") * F.col("df")))
    share = pmi / F.log2(n / F.col("n_entity"))
    return scored.select("entity", "term", share.alias("share")).where(F.col("share") >= rules.generalise_at), wanted


def _with_hints(docs: DataFrame, rules: DisclosureRules) -> DataFrame:
    """``docs`` and a last column: the entities of each document that have disclosing terms in it, with the terms to remove and to generalise."""
    kind = "array<struct<entity:bigint,removed:array<bigint>,generalised:array<bigint>>>"
    found = disclosing_terms(docs, rules)
    terms = materialise(found[0], "terms") if found else None
    chosen = key_filter(terms, F.col("entity").bitwiseXOR(F.col("term"))) if found else None
    if chosen is None:
        return docs.select("*", F.lit(None).cast(kind).alias("__hints"))
    remove = F.col("share") >= rules.remove_at
    hints = materialise(contexts(docs, rules, found[1], chosen).join(terms, ["entity", "term"]).groupBy("row", "entity")
                        .agg(F.collect_set(F.when(remove, F.col("term"))).alias("removed"), F.collect_set(F.when(~remove, F.col("term"))).alias("generalised"))
                        .groupBy(F.col("row").alias("_of")).agg(F.collect_list(F.struct("entity", "removed", "generalised")).alias("hints")), "hints")
    whole = docs.select(F.struct("*").alias("row"), _row_digest().alias("_id"))  # keeps columns of any name apart from those joined
    # the hints grow with the documents: no broadcast at any size
    return whole.join(hints.hint("merge"), F.col("_id") == F.col("_of"), "left").select("row.*", F.col("hints").alias("__hints"))


def method_spans(text: str, base: list, hints: list, rules: DisclosureRules) -> list:
    """Spans of all occurrences of the terms that disclose an entity of the text."""
    entities = _entities(text, base)
    known = {h["entity"]: h for h in hints if h["entity"] in entities}
    if not known:
        return []
    hashes, start, end, near = _nearby(text, base, {e: entities[e] for e in known}, rules)
    removed, told = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    for entity, places in near.items():
        for marks, name in ((removed, "removed"), (told, "generalised")):
            marks[places[np.isin(hashes[places], np.array(known[entity][name], np.int64))]] = True
    return [(int(start[k]), int(end[k]), METHOD_KINDS[0] if removed[k] else METHOD_KINDS[1]) for k in np.flatnonzero(removed | told)]


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def pii_report(docs: DataFrame, rules: DisclosureRules = DisclosureRules()) -> DataFrame:
    """One row per input row: counts of the four kinds, ``base_sha256``, ``spans`` and ``n_terms``.

    ``docs`` needs ``doc_id, text``; other columns are ignored.  A null or empty
    text has no span (the digest of the empty string); null ids and repeated
    rows are returned like others and count as documents; empty table: no rows.
    """
    def run(batches):
        for batch in small(batches):
            rows = {"n_" + k: [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_terms": []}
            for text, hints in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                base = base_spans(text) if text else []
                terms = method_spans(text, base, hints, rules) if hints else []
                for k in KINDS:
                    rows["n_" + k].append(sum(s[2] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["spans"].append(_joined(sorted(base + terms, key=lambda s: (s[0], _ORDER[s[2]]))))
                rows["n_terms"].append(len(terms))
            types = [pa.string() if k in ("base_sha256", "spans") else pa.int64() for k in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.values(), types)], ["doc_id", *rows])

    kinds = "".join(f", n_{k} long" for k in KINDS)
    return _with_hints(docs.select("doc_id", "text"), rules).mapInArrow(run, f"doc_id long{kinds}, base_sha256 string, spans string, n_terms long")


def _generalised(word: str) -> str:
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"


def sanitise_text(text: str, base: list, terms: list) -> str:
    """Entities become their kind in brackets, disclosing terms go or become their kind of word."""
    out, at = [], 0
    for start, end, kind in sorted(base + terms, key=lambda s: (s[0], -s[1])):
        if end <= at:
            continue
        out.append(text[at:max(at, start)])
        out.append("" if kind == METHOD_KINDS[0] else _generalised(text[start:end]) if kind == METHOD_KINDS[1] else f"[{kind.upper()}]")
        at = end
    return "".join(out) + text[at:]


def sanitise_documents(docs: DataFrame, rules: DisclosureRules = DisclosureRules()) -> DataFrame:
    """``docs`` with sanitised ``text`` (and ``n_chars``, if present, counted anew where it changed)."""
    names = docs.columns
    at, hint = names.index("text"), len(names)

    def run(batches):
        for batch in small(batches):
            texts, counts = [], batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i, (text, hints) in enumerate(zip(batch.column(at).to_pylist(), batch.column(hint).to_pylist())):
                if text and (base := base_spans(text)):
                    text = sanitise_text(text, base, method_spans(text, base, hints, rules) if hints else [])
                    if counts is not None:
                        counts[i] = len(text)
                texts.append(text)
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if counts is not None:
                k = names.index("n_chars")
                cols[k] = pa.array(counts, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return _with_hints(docs, rules).mapInArrow(run, docs.schema)
