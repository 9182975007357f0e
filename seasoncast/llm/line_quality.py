"""Line-first quality cleaning.

Every line is judged alone - punctuation, navigation, symbols and boilerplate
rules - and failing lines are removed; a document then goes if it has lost too
much of its text, or fails the document rules (too few words, too many words
in repeated three-word windows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seasoncast.llm.textvec import Piece, pieces, rolling, small

# Phrases that mark a line as boilerplate, lower case.
BOILERPLATE = ("lorem ipsum", "javascript", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "all rights reserved", "work is licensed under", "sign in to", "subscribe to our")

_SYMBOL, _BAR, _CLOSE = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>")] = True
_BAR[list(b"|>")] = True
_CLOSE[list(b".!?:;\"')]}")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class LineRules:
    """Production settings.  Shares are of a line's words or of its bytes that are not white space."""

    short_line: int = 8          # an unclosed line with fewer words than this fails the punctuation rule
    max_shouts: float = 0.3      # exclamation marks a word
    max_bars: float = 0.2        # separator marks a word (navigation)
    min_bars: int = 2
    max_symbols: float = 0.1     # symbols a byte
    max_loss: float = 0.4        # lost share of a document's ink
    min_words: int = 50
    max_repeat: float = 0.5
    boilerplate: tuple = BOILERPLATE


def _phrase_lines(piece: Piece, phrases, line_start, line_end) -> np.ndarray:
    low, found = _LOWER[piece.data].tobytes(), np.zeros(len(line_start), bool)
    for phrase in phrases:
        needle = phrase.encode()
        at = low.find(needle)
        while at >= 0:
            k = int(np.searchsorted(line_start, at, side="right")) - 1
            found[k] |= at + len(needle) <= line_end[k]
            at = low.find(needle, at + 1)
    return found


def judge_piece(piece: Piece, rules: LineRules) -> tuple[dict, tuple]:
    """Per-document figures, and ``(line start, line end, line's document, line fails)``."""
    ink = ~piece.space
    start, end, doc = piece.words()
    n_words = np.bincount(doc, minlength=piece.n)
    symbols = _SYMBOL[piece.data]
    out = {"n_words": n_words, "word_chars": piece.total(ink & ((piece.data & 0xC0) != 0x80)), "n_symbols": piece.total(symbols)}

    ls, le, ld = piece.lines()
    weight = piece.total(ink, ls, le)
    worded = weight > 0
    keys = np.stack([ld[worded].astype(np.uint64), piece.hasher(ls[worded], le[worded])], axis=1) if worded.any() else np.zeros((0, 2), np.uint64)
    distinct = np.unique(keys, axis=0)
    out["n_dup_lines"] = np.bincount(ld[worded], minlength=piece.n) - np.bincount(distinct[:, 0].astype(np.int64), minlength=piece.n)

    at, gram = rolling(piece.hasher(start, end), doc, 3)
    order = np.lexsort((gram, doc[at]))
    g, d = gram[order], doc[at][order]
    same = np.zeros(len(g) + 1, bool)
    same[1:-1] = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    hit = at[order[same[1:] | same[:-1]]]
    covered = np.zeros(len(start) + 2, bool)
    for k in range(3):
        covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(doc, covered[:len(start)], minlength=piece.n).astype(np.int64)

    words_in = np.diff(np.searchsorted(start, np.append(ls, len(piece.data) + 1), side="left"))
    spots = np.flatnonzero(ink)
    last = spots[np.clip(np.searchsorted(spots, le) - 1, 0, None)] if len(spots) else np.zeros(len(le), np.int64)
    closed = np.zeros(len(ls), bool)
    closed[worded] = _CLOSE[piece.data[last[worded]]]
    closed[worded] |= piece.data[last[worded]] >= 0x80  # closing quotes, ellipses and other scripts' stops
    shouts, bars = piece.total(piece.data == 33, ls, le), piece.total(_BAR[piece.data], ls, le)
    fails = worded & (
        (~closed & (words_in < rules.short_line))
        | (shouts > rules.max_shouts * words_in)
        | ((bars >= rules.min_bars) & (bars > rules.max_bars * words_in))
        | (piece.total(symbols, ls, le) > rules.max_symbols * weight)
        | _phrase_lines(piece, rules.boilerplate, ls, le))
    lost = np.bincount(ld, weight * fails, minlength=piece.n)
    total = np.bincount(ld, weight, minlength=piece.n)
    out["n_lines_removed"] = np.bincount(ld, fails, minlength=piece.n).astype(np.int64)
    out["lost"] = np.divide(lost, total, out=np.zeros(piece.n), where=total > 0)
    out["base_failed"] = (n_words < rules.min_words) | (out["n_repeat_words"] > rules.max_repeat * n_words)
    out["kept"] = ~out["base_failed"] & (out["lost"] <= rules.max_loss)
    return out, (ls, le, ld, fails)


def cleaned_texts(piece: Piece, lines: tuple) -> list[str]:
    """The texts without their failing lines."""
    ls, le, ld, fails = lines
    out = [None] * piece.n
    touched = np.bincount(ld, fails, minlength=piece.n) > 0
    edges = np.searchsorted(ld, np.arange(piece.n + 1))
    raw = piece.data.tobytes()
    for i in range(piece.n):
        if not touched[i]:
            out[i] = raw[piece.bounds[i]:piece.bounds[i + 1]].decode("utf-8")
        else:
            out[i] = b"\n".join(raw[ls[k]:le[k]] for k in range(edges[i], edges[i + 1]) if not fails[k]).decode("utf-8")
    return out


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, lost double"


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: ``doc_id`` and the figures and verdicts of its whole text.

    ``docs`` needs ``doc_id, text``; other columns are ignored.  A null or
    empty text has no word and fails; a null doc_id and repeated rows are
    returned like any other; an empty table gives no rows.
    """
    names = [x.split()[0] for x in FIGURES.split(", ")]

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column(1)):
                got, _ = judge_piece(piece, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n)] + [pa.array(got[n]) for n in names], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {FIGURES}")


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that stay, all columns of ``docs``, with failing lines taken out of ``text``.

    ``n_chars``, if present, is counted anew for the texts that changed.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in small(batches):
            for piece in pieces(batch.column(at)):
                got, lines = judge_piece(piece, rules)
                keep = pa.array(got["kept"])
                texts = pa.array(cleaned_texts(piece, lines), batch.schema.field(at).type)
                cols = [batch.column(i).slice(piece.first, piece.n) for i in range(len(names))]
                cols[at] = texts
                if "n_chars" in names:
                    k = names.index("n_chars")
                    old = cols[k].to_pylist()
                    new = [len(t.as_py()) if r else o for t, r, o in zip(texts, got["n_lines_removed"], old)]
                    cols[k] = pa.array(new, batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(cols, names).filter(keep)

    return docs.mapInArrow(run, docs.schema)
