from ranklane.operators import ranking
from ranklane.plans import registry


def test_depths_against_bm25(spark, monkeypatch):
    cols = "split string, query_id string, ndcg_at_10 double, judged_at_10 double, condensed_ndcg_at_10 double"
    deep = [("dev", q, k, n, 0.5, n) for k in ranking.DEPTHS for q, n in (("a", 0.9), ("b", 0.1), ("c", 0.4))]
    frame = spark.createDataFrame([(s, q, n, j, c, k) for s, q, k, n, j, c in deep], cols + ", depth int")
    monkeypatch.setattr(registry, "depth_vectors", lambda *_: frame)
    monkeypatch.setattr(registry, "vectors", lambda *_: spark.createDataFrame([("dev", q, 0.4, 0.5, 0.4) for q in "abc"], cols))
    rows = registry.QUERIES["depth_comparison"](spark, "").collect()
    assert {r["depth"] for r in rows} == set(ranking.DEPTHS)
    assert all((r["improved"], r["degraded"], r["ties"], r["judged_at_10"]) == (1, 1, 1, 0.5) for r in rows)
