"""Unequal inputs are errors, never silently different numbers."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from ranklane.operators import compare, encoding, judgments, ranking
from ranklane.sources import tables
from ranklane.streaming import shards

QRELS = "query_id string, docid string, relevance_grade long"
SYSTEM = "split string, query_id string, ndcg_at_10 double"


@pytest.mark.parametrize(("qrels", "said"), [([("q", "a", 1), ("q", "a", 0)], "conflicting"), ([("q", "a", 1), ("q", "a", 1)], "judged twice"), ([("q", "a", -1)], "negative")])
def test_a_pair_is_judged_once(spark, qrels, said):
    run = spark.createDataFrame([("dev", "q", "a", 1)], "split string, query_id string, docid string, bm25_rank long")
    with pytest.raises(Exception, match=said):
        judgments.attach(run, spark.createDataFrame(qrels, QRELS)).collect()


@pytest.mark.parametrize(
    ("scores", "said"),
    [([("q", "a", 1.0)], "candidate without score"), ([("q", "a", 1.0), ("q", "b", 1.0), ("q", "x", 1.0)], "scored but no candidate"), ([("q", "a", 1.0), ("q", "a", 2.0), ("q", "b", 1.0)], "scored twice"), ([("q", "a", float("nan")), ("q", "b", 1.0)], "finite")],
)
def test_candidates_and_scores_have_the_same_keys(spark, scores, said):
    candidates = spark.createDataFrame([("dev", "q", "a"), ("dev", "q", "b")], "split string, query_id string, docid string")
    with pytest.raises(Exception, match=said):
        ranking.candidates_by_score(candidates, spark.createDataFrame(scores, "query_id string, docid string, score float")).collect()


def test_both_systems_have_the_same_queries(spark):
    a, b = spark.createDataFrame([("dev", "1", 0.5), ("dev", "2", 0.5)], SYSTEM), spark.createDataFrame([("dev", "1", 0.25)], SYSTEM)
    assert compare.paired(a.where("query_id = '1'"), b).first()["delta"] == 0.25
    for x, y in ((a, b), (b, a)):
        with pytest.raises(Exception, match="query 2 is missing"):
            compare.summary(compare.paired(x, y)).collect()


def test_the_mean_lies_in_its_interval(spark):
    one = spark.range(1).select(compare.outcome(F.lit(0.5), F.lit(0.6), F.lit(0.7)).alias("x"))
    with pytest.raises(Exception, match="outside its interval"):
        one.collect()


@pytest.mark.parametrize("lines", ["q Q0 a 1 2.0 t\nq Q0 b 3 1.0 t", "q Q0 a 1 2.0 t\nq Q0 b 1 1.0 t", "q Q0 a 1 2.0 t\nq Q0 a 2 1.0 t"])
def test_ranks_of_a_run_have_no_gaps(spark, tmp_path, lines):
    path = tmp_path / "run.txt"
    path.write_text(lines)
    with pytest.raises(ValueError, match="gaps"):
        tables.read_trec_run(spark, str(path), "dev")
    path.write_text("q Q0 b 1 2.0 t\nq Q0 a 2 1.0 t\np Q0 a 1 1.0 t")
    assert tables.read_trec_run(spark, str(path), "dev").count() == 3


def test_judgments_as_lines_and_back(spark, tmp_path):
    rows = [("1", "a", 1), ("1", "b", 0), ("2", "a", 0)]
    tables.write_lines(tables.qrels_lines(spark.createDataFrame(rows, QRELS)), str(tmp_path / "q"), "query_id", "docid")
    back = tables.read_qrels(spark, str(tmp_path / "q"))
    assert sorted((r["query_id"], r["docid"], r["relevance_grade"]) for r in back.collect()) == rows and {r["iteration"] for r in back.collect()} == {"0"}


def test_published_tables_replace_the_former(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert tables.publish(spark.range(3), path) == 3 and tables.publish(spark.range(5), path) == 5
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["t.parquet"]


def test_a_stream_keeps_bad_lines(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    with gzip.open(source / "docs-3.jsonl.gz", "wt") as f:
        f.write("\n".join([json.dumps({"docid": "a", "title": "t", "text": "x"}), json.dumps({"docid": 7, "text": "x"}), "no json", json.dumps({"text": "x"})]))
    shards.ingest(shards.stream_shards(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["problem"] or "" for r in rows) == ["", "docid is not a string", "docid is not a string", "not JSON"] and {r["shard"] for r in rows} == {3}


@pytest.mark.parametrize(("down", "up", "label"), [(0.0, 0.1, "docno_desc"), (0.1, 0.0, "docno_asc"), (0.0, 0.0, "inconclusive_metric_equivalent"), (0.1, 0.1, "no_policy_matches")])
def test_tie_policies(spark, down, up, label):
    assert spark.range(1).select(compare.tie_policy(F.lit(down), F.lit(up)).alias("x")).first()["x"] == label


@pytest.mark.parametrize(("scorer", "said"), [(lambda batches: (b.assign(score=float("inf"))[["query_id", "docid", "score"]] for b in batches), "finite"), (lambda batches: (b.assign(score=1.0)[["query_id", "docid", "score"]].iloc[1:] for b in batches), "of 3 pairs")])
def test_a_scorer_scores_every_pair(spark, scorer, said):
    pairs = spark.createDataFrame([("q", f"d{k}", "a b", "b c") for k in range(3)], "query_id string, docid string, query_text string, document string")
    assert {r["score"] for r in encoding.score_pairs(pairs).collect()} == {0.5}
    with pytest.raises(Exception, match=said):
        encoding.score_pairs(pairs, scorer).collect()


def test_equal_epochs_and_runs_go_to_the_first(spark):
    rows = [("a", 1, 1, 0.5), ("a", 1, 2, 0.6), ("b", 0, 1, 0.6), ("b", 0, 2, 0.6), ("c", 2, 1, 0.1)]
    got = compare.best_epochs(spark.createDataFrame(rows, "run string, priority int, epoch int, ndcg double")).collect()
    assert sorted((r["run"], r["epoch"], r["selected"]) for r in got) == [("a", 2, False), ("b", 1, True), ("c", 1, False)]
