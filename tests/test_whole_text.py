"""Topics are scored by their whole texts: a small collection whose last document matches only a late term."""

import math

import pytest

from ranklane.operators import retrieval
from ranklane.plans import registry

WORDS = [f"w{k:02}" for k in range(20)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(1, WORDS[0]), (2, WORDS[1] + " other"), (3, WORDS[19]), (4, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'' AS source").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(WORDS)), (4, WORDS[0])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_terms_of_the_whole_text(spark):
    topics = spark.createDataFrame([("dev", "q", " ".join(WORDS))], "split string, query_id string, query_text string")
    assert sorted(r["term"] for r in retrieval.query_terms(topics).collect()) == WORDS


def test_late_terms_find_candidates(spark, sf):
    found = {(r["query_id"], r["docid"]) for r in registry.QUERIES["bm25_top100"](spark, sf).collect()}
    assert found == {("1", "1"), ("1", "2"), ("1", "3"), ("4", "1")}


def test_scores_against_the_formula(spark):
    docs = {"a": "x y y z", "b": "Y", "c": "", "d": "q q q q x"}
    passages = spark.createDataFrame([(k, "", t) for k, t in docs.items()], "docid string, title string, text string")
    topics = spark.createDataFrame([("dev", "1", "y x nowhere"), ("dev", "2", "q")], "split string, query_id string, query_text string")
    got = {(r["query_id"], r["docid"]): (r["s"], r["matched"], r["n_terms"]) for r in retrieval.bm25_scores(passages, retrieval.query_terms(topics), {"s": (0.9, 0.4)}).collect()}
    split = {k: t.lower().split() for k, t in docs.items()}
    mean = sum(map(len, split.values())) / 4
    want = {}
    for q, terms in (("1", ["y", "x", "nowhere"]), ("2", ["q"])):
        for d, words in split.items():
            hit = [t for t in terms if t in words]
            if hit:
                score = 0.0
                for t in hit:
                    df, tf = sum(t in w for w in split.values()), words.count(t)
                    score += round(math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * len(words) / mean)), 9)
                want[q, d] = (pytest.approx(score, abs=1e-8), len(hit), len(terms))
    assert got == want
