import corpus_pipeline


def test_length_alone_rejects_nothing(spark, frame):
    book = " ".join(f"word{k}" for k in range(100_001))
    out = corpus_pipeline.quality(spark, frame([(1, book), (2, "too short")]), "")
    assert [r["doc_id"] for r in out.select("doc_id").collect()] == [1]
