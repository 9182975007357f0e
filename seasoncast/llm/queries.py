"""One registered query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from seasoncast.llm import (chat_snapshots, edit_decontam, embedding_whitening, lexical_scan, line_quality, lm_hmm, lsh_forest_join,
                            pii_disclosure, piece_nbest, source_schedule, suffix_dedup, toxicity_ordinal, url_reputation)
from seasoncast.llm.oracle import ORACLE  # noqa: F401
from seasoncast.sources.tables import table

REGISTRY: dict = {}

URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
             ("com/fr/", "allow"), ("com/de/", "block"))


def query(name):
    def wrap(fn):
        REGISTRY[name] = fn
        return fn
    return wrap


@query("op1_url_reputation")
def op1(spark, sf_dir):
    return url_reputation.judge_pages(table(spark, sf_dir, "pages"),
                                      url_reputation.page_outcomes(table(spark, sf_dir, "labels")), URL_RULES)


@query("op9_chat_snapshots")
def op9(spark, sf_dir):
    return chat_snapshots.collapse_snapshots(table(spark, sf_dir, "conversations"))


@query("op6_line_quality")
def op6(spark, sf_dir):
    return line_quality.quality_report(table(spark, sf_dir, "documents"))


@query("op10_edit_decontam")
def op10(spark, sf_dir):
    return edit_decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), edit_decontam.WHOLE)


@query("op7_pii_disclosure")
def op7(spark, sf_dir):
    return pii_disclosure.pii_report(table(spark, sf_dir, "documents"))


@query("op3_piece_nbest")
def op3(spark, sf_dir):
    return piece_nbest.segmentation_report(table(spark, sf_dir, "documents"))


@query("op4_toxicity_ordinal")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity_ordinal.severity(docs, toxicity_ordinal.train(docs, table(spark, sf_dir, "labels")))


@query("op8_lm_hmm")
def op8(spark, sf_dir):
    return lm_hmm.score_documents(table(spark, sf_dir, "documents"))


@query("op2_lsh_forest_join")
def op2(spark, sf_dir):
    return lsh_forest_join.jaccard_classes(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op12_lexical_scan")
def op12(spark, sf_dir):
    return lexical_scan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_source_schedule")
def op11(spark, sf_dir):
    return source_schedule.words_taken(table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))
