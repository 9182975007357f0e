"""N-best segmentation against full enumeration, and exact round trips."""

import hashlib
import random

import numpy as np

from seasoncast.llm.piece_nbest import PieceModel, Segmenter, decode_ids, edited, encode_documents, n_best, segmentation_report

SF = "/root/testdata/sf0.001"
MODEL = PieceModel()


def every(arcs, at=0):
    if at == len(arcs):
        return [(0, [])]
    return [(s + rest, [*ids, *more]) for j, ids, s in arcs[at] for rest, more in every(arcs, j)]


def test_units_and_texts_match_enumeration():
    rng = random.Random(5)
    own = Segmenter(MODEL, n=5)
    for _ in range(300):
        text = "".join(rng.choice("theandinger  \n,é界") for _ in range(rng.randrange(1, 9)))
        whole = sorted(every(MODEL.lattice(" " + text)), key=lambda x: -x[0])
        assert [s for s, _ in n_best(MODEL.lattice(" " + text), 5)] == [s for s, _ in whole[:5]]
        ids, scores, others = own.segment(text)
        assert scores == [s for s, _ in whole[:5]], text
        ways = [ids.tolist(), *(edited(ids, o).tolist() for o in others)]
        assert len({tuple(w) for w in ways}) == len(ways) == len(scores)  # n different segmentations, each with its score
        assert all((s, w) in whole and own.decode(w) == text for s, w in zip(scores, ways))


def test_many_at_once_agree_with_one_by_one():
    rng = random.Random(8)
    texts = ["".join(rng.choice("theandinger  \n,é界\u2581") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "x" * 40]
    together, alone = Segmenter(MODEL), Segmenter(MODEL)
    for text, (ids, scores, _) in zip(texts, together.segment_all(texts, size=500)):
        units = [alone._search(u) for u in alone.learn([text])[0]]
        assert together.decode(ids) == text
        assert scores[0] == sum(np.frombuffer(u[:8], "<i8")[0] for u in units)
        assert [u[:16] for u in units] == [(alone.long.get(u) or alone.known[u])[:16] for u in alone.learn([text])[0]]


def test_long_equal_and_odd_texts():
    own = Segmenter(MODEL, n=4, most=50)
    for text in ["", " ", "Z" * 20_000, "  a  b\t\n\n c▁d ", "\x00\x7f\U0001F600", "word " * 5000]:
        ids, scores, others = own.segment(text)
        assert all(own.decode(edited(ids, o)) == text for o in others) and len(others) == len(scores) - 1
        assert own.decode(ids) == text and scores == sorted(scores, reverse=True)


def test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = segmentation_report(docs).collect()
    assert len(rows) == docs.count() and all(r.roundtrip and len(r.scores) == 4 for r in rows)
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "the cat", "z"), (2, "the cat", "z")], "doc_id long, text string, ids string")
    out = decode_ids(encode_documents(odd)).collect()
    assert sorted(((r.doc_id, r.text, r.decoded) for r in out), key=str) == sorted([(1, None, None), (None, "", ""), (2, "the cat", "the cat"), (2, "the cat", "the cat")], key=str)
    rep = {(r.doc_id, r.n_tokens): r for r in segmentation_report(odd).collect()}
    best = [r.ids for r in out if r.doc_id == 2][0]
    first = next(r for r in out if r.doc_id == 2)
    ways = [np.array(best, "<i4"), *(edited(np.array(best, "<i4"), [(e["at"], e["size"], e["ids"]) for e in o]) for o in first.others)]
    assert rep[2, len(best)].n_best_sha256 == [hashlib.sha256(w.tobytes()).hexdigest() for w in ways] and len(set(map(bytes, ways))) == 4
    assert rep[2, len(best)].ids_sha256 == hashlib.sha256(np.array(best, "<i4").tobytes()).hexdigest()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert segmentation_report(none).count() == encode_documents(none).count() == 0
