"""Orders, validation, sampling, pairs, encoding, sources and streaming."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from ranklane.operators import encoding, lineage, quality, ranking, retrieval, training_pairs
from ranklane.sources import corpus, tables
from ranklane.streaming import shards


def test_string_tie_break_and_cut(spark):
    df = spark.createDataFrame([("s", "q", d, 1.0) for d in ("10", "2", "1")], "split string, query_id string, docid string, bm25_score double")
    top = retrieval.stable_top_k(df, 10)
    assert [r["docid"] for r in top.orderBy("bm25_rank").collect()] == ["1", "10", "2"]
    again = retrieval.stable_top_k(top.drop("bm25_rank"), 2)
    assert [r["docid"] for r in again.orderBy("bm25_rank").collect()] == ["1", "10"]


def test_depth_keeps_the_tail(spark):
    df = spark.createDataFrame([("s", "q", f"d{k}", k, float(k)) for k in range(1, 7)], "split string, query_id string, docid string, bm25_rank long, score float")
    assert [r["docid"] for r in ranking.at_depth(df, 3).orderBy("rank").collect()] == ["d3", "d2", "d1", "d4", "d5", "d6"]


def test_depth_audit(spark):
    topics = spark.createDataFrame([("s", q) for q in ("q1", "q2", "q3")], "split string, query_id string")
    run = spark.createDataFrame([("s", q, f"d{k}") for q, n in (("q1", 3), ("q2", 2), ("q3", 3)) for k in range(n)], "split string, query_id string, docid string")
    a = retrieval.depth_summary(retrieval.depth_per_query(topics, run, 3), 3).first()
    assert (a["short"], a["total_shortfall"], a["zero_hit"], a["full"]) == (1, 1, 0, 2)


def test_violations_are_found(spark):
    rows = [("s", "q", "d", 1, 1.0, 1, "relevant", 1, True), ("s", "q", " ", 0, float("nan"), None, "unjudged", 0, False), ("s", "q", "d", 1, 1.0, 0, "relevant", 0, True)]
    df = spark.createDataFrame(rows, "split string, query_id string, docid string, bm25_rank long, bm25_score double, relevance_grade long, judgment string, relevance long, is_judged boolean")
    report = quality.violations(df, quality.candidate_checks(), {"pair": ["query_id", "docid"]})
    found = {r["check"]: r["violations"] for r in report.collect()}
    assert {k for k, n in found.items() if n} == {"blank_docid", "bad_rank", "bad_score", "unjudged_state", "relevant_state", "pair"}
    with pytest.raises(ValueError, match="bad_rank"):
        quality.assert_clean(report)


def test_merge_small_strata():
    merged = training_pairs.merge_small({"0|F": 30, "1|F": 5, "1|T": 40, "2|T": 3})
    assert merged["0|F"] == "0|F" and merged["1|F"] == merged["1|T"] == merged["2|T"]
    assert training_pairs.merge_small({"0|F": 2}) == {"0|F": "0|F"}


def candidates(spark, relevant=0, negative=0, unjudged=()):
    rows = [("train", "q", f"r{k:02}", k + 1, "relevant") for k in range(relevant)]
    rows += [("train", "q", f"n{k:02}", 20 + k, "judged_non_relevant") for k in range(negative)]
    rows += [("train", "q", f"u{k:03}", k, "unjudged") for k in unjudged]
    return spark.createDataFrame(rows, "split string, query_id string, docid string, bm25_rank long, judgment string")


@pytest.mark.parametrize("exact", [False, True])
def test_weak_negatives(spark, exact):
    c = candidates(spark, unjudged=range(33, 101))
    a = {r["docid"] for r in training_pairs.weak_negatives(c, exact=exact).collect()}
    b = {r["docid"] for r in training_pairs.weak_negatives(c.orderBy(F.desc("docid")).repartition(3), exact=exact).collect()}
    assert len(a) == 8 and a == b
    few = training_pairs.weak_negatives(candidates(spark, unjudged=(26, 51, 52, 76, 77)), exact=exact)
    assert few.count() == 5


def test_round_robin_pairs(spark):
    c = candidates(spark, 12, 20, range(40, 101))
    p = training_pairs.pairs(c, training_pairs.weak_negatives(c)).collect()
    assert len(p) == 16 and len({r["positive_docid"] for r in p}) == 12
    assert sorted(r["negative_source"] for r in p) == ["judged"] * 8 + ["weak"] * 8
    assert len({(r["positive_docid"], r["negative_docid"]) for r in p}) == 16


def test_char_encoding(spark):
    df = spark.createDataFrame([("ab", "x" * 400), ("q", "")], "q string, d string")
    a, b = encoding.encode_pair(df, "q", "d").collect()
    assert a["input_ids"][:5] == [0, 10 + 97, 10 + 98, 2, 2] and len(a["input_ids"]) == 320 == a["tokens_after"] and a["tokens_before"] == 406 and a["truncated"]
    assert b["input_ids"] == [0, 10 + 113, 2, 2, 2] and not b["truncated"]


def test_loss_is_stable(spark):
    row = spark.range(1).select(encoding.pair_loss(F.lit(0.0), F.lit(0.0)).alias("a"), encoding.pair_loss(F.lit(0.0), F.lit(1000.0)).alias("b")).first()
    assert row["a"] == pytest.approx(0.6931471805599453) and row["b"] == 1000


def write_shard(folder, n, records):
    with gzip.open(folder / f"docs-{n}.jsonl.gz", "wt", encoding="utf-8") as f:
        for r in records:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n\n")


def test_shards(spark, tmp_path):
    write_shard(tmp_path, 10, [{"docid": "a#0", "title": None, "text": "x"}])
    write_shard(tmp_path, 2, [{"docid": "b#0", "title": "T", "text": "y"}, {"docid": 7, "title": "", "text": "z"}, "{broken", {"docid": " ", "title": "", "text": "z"}, {"docid": "c", "title": 1, "text": "z"}])
    parsed = corpus.read_shards(spark, str(tmp_path))
    good = parsed.where("problem IS NULL").orderBy("shard").collect()
    assert [(r["shard"], r["docid"], r["title"]) for r in good] == [(2, "b#0", "T"), (10, "a#0", "")]
    assert {r["problem"] for r in parsed.collect()} == {None, "docid is not a string", "not JSON", "docid is blank", "title is not a string"}
    with pytest.raises(ValueError, match="not a string"):
        corpus.valid_passages(parsed)
    p = parsed.where("problem IS NULL").select("docid", "title", "text")
    ids = spark.createDataFrame([("a#0",)], "docid string")
    assert [r["text"] for r in corpus.passages_by_id(p, ids).collect()] == ["x"]
    with pytest.raises(ValueError, match="missing passages: zz"):
        corpus.passages_by_id(p, spark.createDataFrame([("zz",)], "docid string"))
    with pytest.raises(ValueError, match="conflicting"):
        corpus.consistent_passages(p.unionByName(spark.createDataFrame([("a#0", "", "other")], "docid string, title string, text string")))


def test_tables_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("dev", "q", "d2", 1, 2.5), ("dev", "q", "d1", 2, 1.25)], "split string, query_id string, docid string, bm25_rank long, bm25_score double")
    tables.write_lines(ranking.trec_lines(run, "t"), str(tmp_path / "run"), "query_id", "bm25_rank")
    assert sorted(map(tuple, tables.read_trec_run(spark, str(tmp_path / "run"), "dev").collect())) == sorted(map(tuple, run.collect()))
    (tmp_path / "topics.tsv").write_text("1\tNA\n2\t\"quoted\n")
    assert sorted(r["query_text"] for r in tables.read_topics(spark, str(tmp_path / "topics.tsv"), "dev", 2).collect()) == ['"quoted', "NA"]
    (tmp_path / "bad").write_text("q 0 d 2\n")
    with pytest.raises(ValueError, match="bad judgments"):
        tables.read_qrels(spark, str(tmp_path / "bad"))
    assert tables.publish(run, str(tmp_path / "out.parquet")) == 2
    assert tables.read_candidates(spark, str(tmp_path / "out.parquet")).count() == 2
    tables.write_json({"a": 1}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1}


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_shard(source, 0, [{"docid": f"d{k}", "title": "", "text": "x"} for k in range(5)])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for n in (1, 2):
        shards.ingest(shards.stream_shards(spark, str(source)), out, mark).awaitTermination(120)
        assert spark.read.parquet(out).count() == 5 * n
        write_shard(source, n, [{"docid": f"e{n}{k}", "title": "", "text": "y"} for k in range(5)])


def test_key_digest_ignores_order(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("a"), (F.col("id") * 7).cast("string").alias("b"))
    one = lineage.key_set_digest(df, "a", "b").first()
    assert one == lineage.key_set_digest(df.orderBy(F.desc("id")).repartition(7), "a", "b").first() and one["keys"] == 200
    with pytest.raises(ValueError, match="missing"):
        lineage.fingerprint({"a": 1}, {"a", "b"})
