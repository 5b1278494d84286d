"""Rows that share a doc_id but not a text."""

import corpus_pipeline
from ranklane.llm import exact_dedup


def kept(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_keep_one_by_id_and_text(frame):
    df = frame([(1, "a"), (2, "A"), (1, "b"), (1, "b"), (3, "c"), (3, "d"), (4, "d"), (None, "a")])
    out = exact_dedup.keep_one(df.where("doc_id IS NOT NULL"))
    assert out.columns == df.columns and kept(out) == [(1, "b"), (2, "A"), (3, "c"), (4, "d")]
    assert exact_dedup.keep_one(df).where("doc_id IS NULL").count() == 1


def test_near_and_repeats_by_row(spark, frame):
    words = [f"word{k}" for k in range(60)]
    one, other = " ".join(words), " ".join(f"another{k}" for k in range(60))
    df = frame([(1, one), (2, one + " more"), (2, other), (None, one)])
    assert kept(corpus_pipeline.near(spark, df.where("doc_id IS NOT NULL"), "")) == [(1, one), (2, other)]
    assert corpus_pipeline.near(spark, df, "").where("doc_id IS NULL").count() == 1
    passage = "This is a passage that many documents share. It has several sentences, and they run on for a while! Does it end here? It does now."
    start = "A start of its own that nothing else has, in several words. And one more sentence stands here."
    df = frame([(1, passage), (2, passage + " Tail."), (2, start + " Nothing else here repeats at all.")])
    assert kept(corpus_pipeline.repeats(spark, df, "")) == [(1, passage), (2, start + " Nothing else here repeats at all."), (2, "Tail.")]
