"""The pipeline against the plain versions of its stages, one after the other."""

import corpus_pipeline
from seasoncast.llm.line_quality import LineRules
from tests.llm.test_edit_decontam import fold, plain_whole
from tests.llm.test_line_quality import plain as plain_quality
from tests.llm.test_line_quality import plain_line_fails
from tests.llm.test_lsh_forest_join import plain as plain_classes
from tests.llm.test_pii_disclosure import plain as plain_spans

SF = "/root/testdata/sf0.001"


def holds(doc, item):
    """Whether a run of words of any length is within a fifth of the item's words of it; a run that is holds most of them."""
    allowed = int(0.2 * len(item) + 1e-9)
    return len(item) >= 5 and len(set(item) & set(doc)) >= len(set(item)) - allowed and plain_whole(doc, item) <= allowed


def test_pipeline_matches_plain_stages(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = {}
    for i, r in rows.items():
        if plain_quality(r.text)[5]:
            continue
        lines = r.text.split("\n")
        ink = ["".join(x.split()).encode() for x in lines]
        bad = [plain_line_fails(x) for x in lines]
        if sum(len(x) for x, b in zip(ink, bad) if b) <= LineRules().max_loss * sum(map(len, ink)):
            texts[i] = "\n".join(x for x, b in zip(lines, bad) if not b) if any(bad) else r.text
    keep = {d for d, c, *_ in plain_classes(sorted(texts.items())) if d == c}
    items = [fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keep = {d for d in keep if not any(holds(fold(texts[d]), i) for i in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == keep
    for d, r in got.items():
        want, at = "", 0
        for s, e, kind in plain_spans(texts[d]):  # spans of this table do not overlap
            want, at = want + texts[d][at:s] + f"[{kind.upper()}]", e
        assert r.text == want + texts[d][at:]
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (rows[d].lang, rows[d].source) and r.ids


def test_stages_keep_columns_and_survive_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (None, "no id here", "en", None, 10), (2, "", None, "s", 0), (2, "", None, "s", 0),
                                  (3, "Some words of a clean text stand here now, and go on. " * 30, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (docs, docs.where("1 = 0")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
