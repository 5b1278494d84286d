"""All registered core queries, each beside its DuckDB SQL (None: rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.functions.text import document, is_blank
from ranklane.operators import compare, diagnostics, encoding, judgments, lineage, metrics, quality, ranking, retrieval, training_pairs
from ranklane.plans import testbed as tb
from ranklane.plans.oracles import MEANS, ROUNDED, at_depth, over_base, summary_of

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, base: bool = True):
    """Registers a function (spark, sf_dir) as a query, and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = over_base(sql) if base else sql
        return f

    return keep


def judged(spark, sf: str, system: str):
    """A system's ranking with its judgments."""
    ranks = tb.ranking(spark, sf, system) if system != "oracle" else oracle_ranking(spark, sf)
    return judgments.attach(ranks, tb.qrels(spark, sf))


def oracle_ranking(spark, sf: str):
    return ranking.oracle(tb.candidates(spark, sf)).select("split", "query_id", "docid", F.col("oracle_rank").alias("rank"))


def vectors(spark, sf: str, system: str):
    return metrics.per_query(judged(spark, sf, system), tb.qrels(spark, sf), tb.topics(spark, sf), "rank")


# Retrieval


@query("bm25_top100", "SELECT split, query_id, docid, bm25_rank, round(bm25_score, 6) AS bm25_score FROM run")
def bm25_top100(spark, sf):
    return tb.run(spark, sf).withColumn("bm25_score", F.round("bm25_score", 6))


@query("smoke_top3", "SELECT query_id, docid, bm25_rank FROM run WHERE query_id = '0' AND bm25_rank <= 3")
def smoke_top3(spark, sf):
    return tb.run(spark, sf).where("query_id = '0' AND bm25_rank <= 3").select("query_id", "docid", "bm25_rank")


_SWAPPED = "CASE WHEN CAST(query_id AS INT) % 5 = 0 THEN 101 - bm25_rank ELSE bm25_rank END"


@query("bm25_run_stable_rank", f"SELECT split, count(*) AS n, count(*) FILTER (WHERE again <> stated) AS misplaced FROM (SELECT split, {_SWAPPED} AS stated, row_number() OVER (PARTITION BY split, query_id ORDER BY bm25_score DESC, docid) AS again FROM run) GROUP BY 1")
def bm25_run_stable_rank(spark, sf):
    """Stated ranks against the stable order; every fifth query's ranks are turned round, so that there is something to find."""
    stated = tb.run(spark, sf).withColumn("stated", F.expr(_SWAPPED)).drop("bm25_rank")
    again = retrieval.stable_top_k(stated, tb.TOP_K, rank="again")
    return again.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("again") != F.col("stated")).alias("misplaced"))


@query("trec_run_lines", "SELECT split, query_id, bm25_rank, query_id || ' Q0 ' || docid || ' ' || bm25_rank || ' ' || CAST(CAST(bm25_score AS DECIMAL(28,9)) AS DECIMAL(28,8)) || ' bm25' AS line FROM run")
def trec_run_lines(spark, sf):
    return ranking.trec_lines(tb.run(spark, sf), "bm25")


@query("stable_truncation_top10", "SELECT split, query_id, docid, row_number() OVER (PARTITION BY split, query_id ORDER BY round(bm25_score, 8) DESC, docid) AS bm25_rank FROM run QUALIFY bm25_rank <= 10".replace("QUALIFY bm25_rank", "QUALIFY row_number() OVER (PARTITION BY split, query_id ORDER BY round(bm25_score, 8) DESC, docid)"))
def stable_truncation_top10(spark, sf):
    return retrieval.stable_top_k(tb.run(spark, sf).withColumn("bm25_score", F.round("bm25_score", 8)), 10).select("split", "query_id", "docid", "bm25_rank")


@query(
    "truncation_difference",
    """SELECT count(*) FILTER (WHERE b.docid IS NULL) AS only_truncated, count(*) FILTER (WHERE a.docid IS NULL) AS only_direct, count(*) AS n_rows FROM (SELECT query_id, docid FROM run WHERE bm25_rank <= 10) a FULL OUTER JOIN
    (SELECT query_id, docid FROM (SELECT query_id, docid, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 1) DESC, docid) AS r FROM run) WHERE r <= 10) b ON b.query_id = a.query_id AND b.docid = a.docid""",
)
def truncation_difference(spark, sf):
    """Two-way difference between the first ten of the run and a top ten by coarser scores."""
    a = tb.run(spark, sf).where("bm25_rank <= 10").select("query_id", "docid", F.lit(True).alias("a"))
    b = retrieval.stable_top_k(tb.run(spark, sf).withColumn("bm25_score", F.round("bm25_score", 1)), 10, rank="again").select("query_id", "docid", F.lit(True).alias("b"))
    return a.join(b, ["query_id", "docid"], "full_outer").agg(F.count_if(F.col("b").isNull()).alias("only_truncated"), F.count_if(F.col("a").isNull()).alias("only_direct"), F.count("*").alias("n_rows"))


@query("retrieval_depth_per_query", "SELECT t.split, t.query_id, count(docid) AS candidate_count, greatest(100 - count(docid), 0) AS shortfall FROM topics t LEFT JOIN run r ON r.query_id = t.query_id GROUP BY 1, 2")
def retrieval_depth_per_query(spark, sf):
    return retrieval.depth_per_query(tb.topics(spark, sf), tb.run(spark, sf), 100)


@query(
    "retrieval_depth_summary",
    """SELECT split, count(*) AS topics, count(*) FILTER (WHERE c >= 100) AS "full", count(*) FILTER (WHERE c > 0 AND c < 100) AS short, count(*) FILTER (WHERE c = 0) AS zero_hit, min(c) AS min_count, max(c) AS max_count,
    CAST(sum(greatest(100 - c, 0)) AS BIGINT) AS total_shortfall FROM (SELECT t.split, t.query_id, count(docid) AS c FROM topics t LEFT JOIN run r ON r.query_id = t.query_id GROUP BY 1, 2) GROUP BY 1""",
)
def retrieval_depth_summary(spark, sf):
    return retrieval.depth_summary(retrieval_depth_per_query(spark, sf), 100)


# Judgments and validation


@query("candidates_three_state", "SELECT split, query_id, docid, bm25_rank, relevance_grade, judgment, relevance, is_judged FROM cand")
def candidates_three_state(spark, sf):
    return tb.candidates(spark, sf).drop("bm25_score")


@query("candidate_state_counts", "SELECT split, judgment, count(*) AS n, count(DISTINCT query_id) AS n_queries FROM cand GROUP BY 1, 2")
def candidate_state_counts(spark, sf):
    return judgments.state_counts(tb.candidates(spark, sf))


@query(
    "candidate_schema_violations",
    """SELECT unnest(['blank_query_id', 'blank_docid', 'bad_rank', 'bad_score', 'bad_state', 'bad_grade', 'relevant_state', 'non_relevant_state', 'unjudged_state', 'duplicate_pair', 'duplicate_rank']) AS "check",
    unnest([count(*) FILTER (WHERE trim(query_id) = ''), count(*) FILTER (WHERE trim(docid) = ''), count(*) FILTER (WHERE bm25_rank < 1), count(*) FILTER (WHERE NOT isfinite(bm25_score)), count(*) FILTER (WHERE judgment NOT IN ('relevant', 'judged_non_relevant', 'unjudged')),
    count(*) FILTER (WHERE relevance_grade < 0), count(*) FILTER (WHERE judgment = 'relevant' AND NOT (relevance_grade > 0 AND relevance = 1 AND is_judged)), count(*) FILTER (WHERE judgment = 'judged_non_relevant' AND NOT (relevance_grade = 0 AND relevance = 0 AND is_judged)),
    count(*) FILTER (WHERE judgment = 'unjudged' AND (relevance IS NOT NULL OR is_judged)), count(*) - count(DISTINCT query_id || '|' || docid), count(*) - count(DISTINCT query_id || '|' || bm25_rank)]) AS violations FROM cand""",
)
def candidate_schema_violations(spark, sf):
    return quality.violations(tb.candidates(spark, sf), quality.candidate_checks(), {"duplicate_pair": ["split", "query_id", "docid"], "duplicate_rank": ["split", "query_id", "bm25_rank"]})


@query("query_coverage_gaps", "SELECT split, query_id, 'topic_without_hits' AS side FROM topics WHERE CAST(query_id AS INT) % 5 <> 1 AND query_id NOT IN (SELECT query_id FROM run WHERE CAST(query_id AS INT) % 6 <> 0) UNION ALL SELECT DISTINCT split, query_id, 'hits_without_topic' FROM run WHERE CAST(query_id AS INT) % 6 <> 0 AND query_id NOT IN (SELECT query_id FROM topics WHERE CAST(query_id AS INT) % 5 <> 1)")
def query_coverage_gaps(spark, sf):
    """Some topics are taken out, and the hits of some others, so that both sides have gaps."""
    return quality.coverage_gaps(tb.topics(spark, sf).where("CAST(query_id AS INT) % 5 <> 1"), tb.run(spark, sf).where("CAST(query_id AS INT) % 6 <> 0"))


@query("topk_rank_violations", "SELECT split, query_id, count(*) AS n, min(bm25_rank) AS low, max(bm25_rank) AS high, count(DISTINCT bm25_rank) AS distinct_ranks, min(bm25_rank) = 1 AND max(bm25_rank) = count(*) AND count(DISTINCT bm25_rank) = count(*) AND count(*) <= 100 AS valid FROM run GROUP BY 1, 2")
def topk_rank_violations(spark, sf):
    return quality.rank_gaps(tb.run(spark, sf), 100)


@query("duplicate_documents", "SELECT text, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark, sf):
    return quality.duplicates(tb.passages(spark, sf), ["text"])


@query(
    "queries_passages_violations",
    """SELECT 'passages' AS "table", unnest(['blank_id', 'blank_text', 'duplicate_id']) AS "check", unnest([count(*) FILTER (WHERE trim(docid) = ''), count(*) FILTER (WHERE regexp_full_match(text, '[\\s\\p{Z}\\x1c-\\x1f\\x{85}]*')), count(*) - count(DISTINCT docid)]) AS violations FROM docs
    UNION ALL SELECT 'topics', unnest(['blank_id', 'blank_text', 'duplicate_id']), unnest([count(*) FILTER (WHERE trim(query_id) = ''), count(*) FILTER (WHERE regexp_full_match(query_text, '[\\s\\p{Z}\\x1c-\\x1f\\x{85}]*')), count(*) - count(DISTINCT query_id)]) FROM topics""".replace("\\\\", "\\"),
)
def queries_passages_violations(spark, sf):
    def of(df, name, key, text):
        found = quality.violations(df, {"blank_id": is_blank(F.col(key)), "blank_text": is_blank(F.col(text))}, {"duplicate_id": [key]})
        return found.select(F.lit(name).alias("table"), "check", "violations")

    return of(tb.passages(spark, sf), "passages", "docid", "text").unionByName(of(tb.topics(spark, sf), "topics", "query_id", "query_text"))


@query("passage_reference_integrity", "SELECT count(DISTINCT docid) AS referenced, count(DISTINCT CASE WHEN docid NOT IN (SELECT docid FROM docs WHERE CAST(docid AS BIGINT) % 7 <> 0) THEN docid END) AS missing FROM cand")
def passage_reference_integrity(spark, sf):
    """Candidates whose passage isn't stored; every seventh passage is taken out."""
    stored = tb.passages(spark, sf).where("CAST(docid AS BIGINT) % 7 <> 0").select("docid", F.lit(True).alias("stored"))
    wanted = tb.candidates(spark, sf).select("docid").distinct().join(stored, "docid", "left")
    return wanted.agg(F.count("*").alias("referenced"), F.count_if(F.col("stored").isNull()).alias("missing"))


@query("passages_semi_join", "SELECT docid, title, length(text) AS chars FROM docs WHERE docid IN (SELECT docid FROM cand)")
def passages_semi_join(spark, sf):
    ids = tb.candidates(spark, sf).select("docid").distinct()
    return tb.passages(spark, sf).join(ids, "docid", "left_semi").select("docid", "title", F.length("text").cast("long").alias("chars"))


@query("missing_passages_anti_join", "SELECT DISTINCT CAST(page_id AS VARCHAR) AS docid FROM pages WHERE CAST(page_id AS VARCHAR) NOT IN (SELECT docid FROM cand)")
def missing_passages_anti_join(spark, sf):
    wanted = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").cast("string").alias("docid")).distinct()
    return wanted.join(tb.candidates(spark, sf).select("docid").distinct(), "docid", "left_anti")


@query("missing_passage_context", "SELECT docid, query_id, n FROM (SELECT docid, query_id, row_number() OVER (PARTITION BY docid ORDER BY split, query_id) AS n FROM cand WHERE docid NOT IN (SELECT CAST(page_id AS VARCHAR) FROM pages)) WHERE n <= 3")
def missing_passage_context(spark, sf):
    from ranklane.sources.corpus import locations

    stored = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").cast("string").alias("docid"))
    return locations(tb.candidates(spark, sf), stored, 3)


# Rankings


@query("rank_by_score", "SELECT split, query_id, docid, rank FROM rank_lexical")
def rank_by_score(spark, sf):
    return ranking.candidates_by_score(tb.run(spark, sf).select("split", "query_id", "docid"), tb.scores(spark, sf).select("query_id", "docid", "score")).select("split", "query_id", "docid", "rank")


def _depth(depth: int) -> None:
    @query(f"rerank_depth_{depth}", at_depth(depth))
    def rerank(spark, sf):
        ranked = ranking.at_depth(tb.scores(spark, sf).join(tb.run(spark, sf).drop("bm25_score"), ["split", "query_id", "docid"]), depth)
        return ranked.select("split", "query_id", "docid", "rank")


for _k in ranking.DEPTHS:
    _depth(_k)


@query("rank_preserving_trec", "SELECT split, query_id, rank, printf('%s Q0 %s %d %.4f %s', query_id, docid, rank, CAST(1000000 - rank AS DOUBLE), 'lexical') AS line FROM rank_lexical")
def rank_preserving_trec(spark, sf):
    return ranking.rank_preserving(tb.ranking(spark, sf, "lexical"), "lexical")


_BENT = "1000000 - rank + CASE WHEN rank % 10 = 3 THEN 2 ELSE 0 END"


@query(
    "rank_preserving_violations",
    f"SELECT split, count(*) FILTER (WHERE before <= s) AS not_falling, count(*) FILTER (WHERE s <> 1000000 - rank) AS not_rank FROM (SELECT split, rank, s, lag(s) OVER (PARTITION BY split, query_id ORDER BY rank) AS before FROM (SELECT *, {_BENT} AS s FROM rank_lexical)) GROUP BY 1",
)
def rank_preserving_violations(spark, sf):
    """Every third of ten scores is bent upwards, so that there is something to find."""
    return ranking.rank_preserving_violations(tb.ranking(spark, sf, "lexical").withColumn("trec_score", F.expr(_BENT)))


@query(
    "candidate_set_invariant",
    """SELECT count(l) AS left_count, count(r) AS right_count, count(*) FILTER (WHERE r IS NULL) AS only_left, count(*) FILTER (WHERE l IS NULL) AS only_right, count(DISTINCT query_id) AS query_count, count(*) FILTER (WHERE r IS NULL OR l IS NULL) = 0 AS equal FROM
    (SELECT query_id, docid, 1 AS l FROM rank_lexical WHERE rank % 19 <> 0) FULL OUTER JOIN (SELECT query_id, docid, 1 AS r FROM rank_c WHERE rank % 17 <> 0) USING (query_id, docid)""",
)
def candidate_set_invariant(spark, sf):
    """Two systems' candidates, each without some ranks."""
    return quality.set_difference(tb.ranking(spark, sf, "lexical").where("rank % 19 <> 0"), tb.ranking(spark, sf, "c").where("rank % 17 <> 0"), ["query_id", "docid"])


@query(
    "tie_policy_asc_desc",
    "SELECT a.split, a.query_id, count(*) FILTER (WHERE a.r <> a.d) AS moved FROM (SELECT split, query_id, row_number() OVER (PARTITION BY split, query_id ORDER BY score DESC, docid) AS r, row_number() OVER (PARTITION BY split, query_id ORDER BY score DESC, docid DESC) AS d FROM lex) a GROUP BY 1, 2",
)
def tie_policy_asc_desc(spark, sf):
    s = tb.scores(spark, sf)
    a, d = ranking.by_score(s).withColumnRenamed("rank", "r"), ranking.by_score(s, docid_ascending=False).withColumnRenamed("rank", "d").drop("score")
    return a.join(d, ["split", "query_id", "docid"]).groupBy("split", "query_id").agg(F.count_if(F.col("r") != F.col("d")).alias("moved"))


@query("oracle_ranking", "SELECT split, query_id, docid, rank FROM rank_oracle")
def oracle_ranking_query(spark, sf):
    return oracle_ranking(spark, sf)


# Metrics


@query("per_query_metrics", f"SELECT split, query_id, {ROUNDED}, retrieved, relevant_total FROM m_bm25")
def per_query_metrics(spark, sf):
    return metrics.rounded(vectors(spark, sf, "bm25"))


@query("macro_metrics", f"SELECT split, count(*) AS queries, {MEANS} FROM m_bm25 GROUP BY 1")
def macro_metrics(spark, sf):
    return metrics.rounded(metrics.macro(vectors(spark, sf, "bm25"), "split"))


@query("mrr_at_10", "SELECT split, round(avg(rr_at_10), 9) AS mrr_at_10 FROM m_lexical GROUP BY 1")
def mrr_at_10(spark, sf):
    return metrics.rounded(vectors(spark, sf, "lexical").groupBy("split").agg(F.avg("rr_at_10").alias("mrr_at_10")))


@query("condensed_ndcg", "SELECT query_id, round(condensed_ndcg_at_10, 9) AS condensed_ndcg_at_10, condensed_ndcg_at_10 >= ndcg_at_10 - 1e-12 AS not_below FROM m_c")
def condensed_ndcg(spark, sf):
    v = vectors(spark, sf, "c")
    return metrics.rounded(v.select("query_id", "condensed_ndcg_at_10", (F.col("condensed_ndcg_at_10") >= F.col("ndcg_at_10") - 1e-12).alias("not_below")))


@query("judged_rate", "SELECT split, round(avg(judged_at_10), 9) AS judged_at_10 FROM m_lexical GROUP BY 1")
def judged_rate(spark, sf):
    return metrics.rounded(vectors(spark, sf, "lexical").groupBy("split").agg(F.avg("judged_at_10").alias("judged_at_10")))


@query(
    "judged_only_quality",
    """SELECT split, query_id, round(sum(CASE WHEN kpos <= 10 AND relevance_grade > 0 THEN (pow(2.0, relevance_grade) - 1) / log2(kpos + 1) ELSE 0.0 END), 9) AS dcg FROM s_lexical WHERE is_judged GROUP BY 1, 2""",
)
def judged_only_quality(spark, sf):
    kept = ranking.rank_by(judged(spark, sf, "lexical").where("is_judged"), F.asc("rank"), F.asc("docid"), name="dense")
    part = F.when((F.col("dense") <= 10) & (F.col("relevance_grade") > 0), metrics.gain(F.col("relevance_grade"), F.col("dense"))).otherwise(0.0)
    return metrics.rounded(kept.groupBy("split", "query_id").agg(F.sum(part).alias("dcg")))


@query(
    "qrels_audit_per_query",
    """SELECT t.split, t.query_id, coalesce(q.positives, 0) AS positives, coalesce(q.negatives, 0) AS negatives, coalesce(c.retrieved, 0) AS retrieved, coalesce(c.judged, 0) AS judged, coalesce(c.top_judged, 0) AS top_judged, coalesce(c.top, 0) AS top
    FROM topics t LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE relevance_grade > 0) AS positives, count(*) FILTER (WHERE relevance_grade = 0) AS negatives FROM qrels GROUP BY 1) q ON q.query_id = t.query_id
    LEFT JOIN (SELECT query_id, count(*) AS retrieved, count(*) FILTER (WHERE is_judged) AS judged, count(*) FILTER (WHERE is_judged AND bm25_rank <= 10) AS top_judged, count(*) FILTER (WHERE bm25_rank <= 10) AS top FROM cand GROUP BY 1) c ON c.query_id = t.query_id""",
)
def qrels_audit_per_query(spark, sf):
    rows = judgments.audit(tb.topics(spark, sf), tb.qrels(spark, sf), tb.candidates(spark, sf))
    return rows.select("split", "query_id", "positives", "negatives", "retrieved", "judged", "top_judged", "top")


@query(
    "qrels_audit_summary",
    """SELECT split, count(*) AS queries, CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(negatives) AS BIGINT) AS negatives, count(*) FILTER (WHERE positives = 0) AS without_positive, count(*) FILTER (WHERE retrieved = 0) AS failures,
    count(*) FILTER (WHERE judged = 0) AS zero_judged, round(avg(CASE WHEN "top" > 0 THEN CAST(top_judged AS DOUBLE) / "top" END), 9) AS mean_judged_share FROM (SELECT t.split, t.query_id, coalesce(q.positives, 0) AS positives, coalesce(q.negatives, 0) AS negatives, coalesce(c.retrieved, 0) AS retrieved, coalesce(c.judged, 0) AS judged, coalesce(c.top_judged, 0) AS top_judged, coalesce(c.tp, 0) AS "top"
    FROM topics t LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE relevance_grade > 0) AS positives, count(*) FILTER (WHERE relevance_grade = 0) AS negatives FROM qrels GROUP BY 1) q ON q.query_id = t.query_id
    LEFT JOIN (SELECT query_id, count(*) AS retrieved, count(*) FILTER (WHERE is_judged) AS judged, count(*) FILTER (WHERE is_judged AND bm25_rank <= 10) AS top_judged, count(*) FILTER (WHERE bm25_rank <= 10) AS tp FROM cand GROUP BY 1) c ON c.query_id = t.query_id) GROUP BY 1""",
)
def qrels_audit_summary(spark, sf):
    p = qrels_audit_per_query(spark, sf)
    share = F.when(F.col("top") > 0, F.col("top_judged") / F.col("top"))
    return metrics.rounded(
        p.groupBy("split").agg(
            F.count("*").alias("queries"), F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"), F.count_if(F.col("positives") == 0).alias("without_positive"),
            F.count_if(F.col("retrieved") == 0).alias("failures"), F.count_if(F.col("judged") == 0).alias("zero_judged"), F.avg(share).alias("mean_judged_share"),
        )
    )


_SPREAD = lambda c: [(f"{c}_min", f"CAST(min({c}) AS DOUBLE)"), (f"{c}_median", f"quantile_cont({c}, 0.5)"), (f"{c}_p90", f"quantile_cont({c}, 0.9)"), (f"{c}_max", f"CAST(max({c}) AS DOUBLE)")]
_AUDIT = [
    ("queries", "count(*)"), ("queries_with_qrels", "count(*) FILTER (WHERE qrels > 0)"), ("qrels", "sum(qrels)"), ("relevant_judgments", "sum(positives)"), ("non_relevant_judgments", "sum(negatives)"),
    ("queries_without_positive", "count(*) FILTER (WHERE positives = 0)"), ("share_without_negative", "avg(CASE WHEN negatives = 0 THEN 1.0::DOUBLE ELSE 0.0 END)"), ("candidates", "sum(retrieved)"),
    ("candidates_relevant", "sum(rel)"), ("candidates_judged_non_relevant", "sum(non)"), ("candidates_unjudged", "sum(un)"), ("overlap_pairs", "sum(judged)"), ("positives_retrieved", "sum(rel)"),
    ("judgment_coverage", "avg(CASE WHEN retrieved > 0 THEN judged / retrieved::DOUBLE ELSE 0.0 END)"), ("mean_judged_at_10", "avg(CASE WHEN tp > 0 THEN top_judged / tp::DOUBLE ELSE 0.0 END)"),
    ("queries_without_judged", "count(*) FILTER (WHERE judged = 0)"), ("retrieval_failures", "count(*) FILTER (WHERE retrieved = 0)"),
    *_SPREAD("positives"), *_SPREAD("negatives"), *_SPREAD("retrieved"), *_SPREAD("judged"),
]


@query(
    "qrels_audit",
    f"""SELECT split, unnest([{', '.join(f"'{k}'" for k, _ in _AUDIT)}]) AS statistic, unnest([{', '.join(f'round(CAST({x} AS DOUBLE), 9)' for _, x in _AUDIT)}]) AS value FROM
    (SELECT t.split, t.query_id, coalesce(n, 0) AS qrels, coalesce(p, 0) AS positives, coalesce(g, 0) AS negatives, coalesce(retrieved, 0) AS retrieved, coalesce(judged, 0) AS judged, coalesce(top_judged, 0) AS top_judged, coalesce(tp, 0) AS tp, coalesce(rel, 0) AS rel, coalesce(non, 0) AS non, coalesce(un, 0) AS un
    FROM topics t LEFT JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE relevance_grade > 0) AS p, count(*) FILTER (WHERE relevance_grade = 0) AS g FROM qrels GROUP BY 1) q ON q.query_id = t.query_id
    LEFT JOIN (SELECT query_id, count(*) AS retrieved, count(*) FILTER (WHERE is_judged) AS judged, count(*) FILTER (WHERE is_judged AND bm25_rank <= 10) AS top_judged, count(*) FILTER (WHERE bm25_rank <= 10) AS tp, count(*) FILTER (WHERE judgment = 'relevant') AS rel,
      count(*) FILTER (WHERE judgment = 'judged_non_relevant') AS non, count(*) FILTER (WHERE judgment = 'unjudged') AS un FROM cand GROUP BY 1) c ON c.query_id = t.query_id) GROUP BY split""",
)
def qrels_audit(spark, sf):
    """All statistics of the judgment audit, by split."""
    return metrics.rounded(judgments.audit_summary(judgments.audit(tb.topics(spark, sf), tb.qrels(spark, sf), tb.candidates(spark, sf))))


@query("relevance_values", "SELECT relevance_grade, count(*) AS n FROM qrels GROUP BY 1")
def relevance_values(spark, sf):
    """The domain of grades."""
    return tb.qrels(spark, sf).groupBy("relevance_grade").agg(F.count("*").alias("n"))


@query("zero_judged_queries", "SELECT split, query_id, query_text FROM topics WHERE query_id NOT IN (SELECT query_id FROM cand WHERE is_judged)")
def zero_judged_queries(spark, sf):
    """Topics none of whose candidates is judged."""
    known = tb.candidates(spark, sf).where("is_judged").select("query_id").distinct()
    return tb.topics(spark, sf).join(known, "query_id", "left_anti").select("split", "query_id", "query_text")


@query(
    "annotation_violations",
    """SELECT unnest(['blank_topic', 'duplicate_topic', 'grade', 'duplicate_judgment', 'unknown_topic', 'topics_count', 'judgments_count']) AS "check", unnest([0, 0, g, 0, u, abs(t - 30), abs(n - 1000)]) AS violations FROM
    (SELECT count(*) FILTER (WHERE x NOT IN (0, 1)) AS g, count(*) FILTER (WHERE CAST(query_id AS INT) % 5 = 2) AS u, count(*) AS n FROM (SELECT query_id, CASE WHEN CAST(docid AS BIGINT) % 50 = 0 THEN 2 ELSE relevance_grade END AS x FROM qrels)), (SELECT count(*) AS t FROM topics WHERE CAST(query_id AS INT) % 5 <> 2)""",
)
def annotation_violations(spark, sf):
    """Given annotations against expected numbers; some topics are taken out and some grades bent, so that there is something to find."""
    bent = F.when(F.col("docid").cast("long") % 50 == 0, 2).otherwise(F.col("relevance_grade"))
    topics = tb.topics(spark, sf).where("CAST(query_id AS INT) % 5 <> 2")
    return quality.annotation_violations(topics, tb.qrels(spark, sf).withColumn("relevance_grade", bent), {"topics": 30, "judgments": 1000})


@query(
    "positives_distribution",
    "SELECT CAST(min(n) AS DOUBLE) AS minimum, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.9) AS p90, CAST(max(n) AS DOUBLE) AS maximum FROM (SELECT query_id, count(*) FILTER (WHERE relevance_grade > 0) AS n FROM qrels GROUP BY 1)",
)
def positives_distribution(spark, sf):
    n = tb.qrels(spark, sf).groupBy("query_id").agg(F.count_if(F.col("relevance_grade") > 0).alias("n"))
    return metrics.distribution(n, "n")


# Diagnostics


@query(
    "raw_score_ties",
    """SELECT split, count(*) AS tie_groups, CAST(sum(n) AS BIGINT) AS tied_rows, count(DISTINCT query_id) AS queries_with_ties, count(DISTINCT CASE WHEN t >= 2 THEN query_id END) AS queries_tied_in_top10,
    count(*) FILTER (WHERE a <= 10 AND b > 10) AS crossing_rank_10, max(n) AS largest, CAST(sum(n - 1) AS BIGINT) AS surplus_rows FROM (SELECT split, query_id, score, count(*) AS n, min(rank) AS a, max(rank) AS b, count(*) FILTER (WHERE rank <= 10) AS t
    FROM (SELECT l.*, r.rank FROM lex l JOIN rank_lexical r ON r.query_id = l.query_id AND r.docid = l.docid) GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1""",
)
def raw_score_ties(spark, sf):
    return diagnostics.tie_statistics(tb.scores(spark, sf))


_SPARSE = """SELECT t.split, t.query_id, coalesce(unjudged, 10) AS unjudged_in_top10, CAST(coalesce(inversions, 0) AS BIGINT) AS inversions, coalesce(j, FALSE) AS has_judged, coalesce(r, FALSE) AS has_relevant FROM topics t LEFT JOIN
    (SELECT query_id, count(*) FILTER (WHERE bm25_rank <= 10 AND judgment = 'unjudged') AS unjudged, sum(CASE WHEN bm25_rank <= 10 AND judgment = 'unjudged' THEN below ELSE 0 END) AS inversions, bool_or(is_judged) AS j, bool_or(judgment = 'relevant') AS r FROM
    (SELECT c.*, (SELECT count(*) FROM cand x WHERE x.query_id = c.query_id AND x.judgment = 'relevant' AND x.bm25_rank > c.bm25_rank) AS below FROM cand c) GROUP BY 1) s ON s.query_id = t.query_id"""


@query("inversions_per_query", _SPARSE)
def inversions_per_query(spark, sf):
    return diagnostics.sparse_per_query(tb.candidates(spark, sf), tb.topics(spark, sf))


@query(
    "sparse_diagnostics",
    f"""SELECT split, count(*) AS queries, round(avg(unjudged_in_top10), 9) AS mean_unjudged, CAST(sum(inversions) AS BIGINT) AS inversion_pairs, count(*) FILTER (WHERE inversions > 0) AS queries_with_inversions, count(*) FILTER (WHERE NOT has_judged) AS queries_without_judged,
    count(*) FILTER (WHERE NOT has_relevant) AS queries_without_relevant, round(avg(CASE WHEN has_judged THEN unjudged_in_top10 END), 9) AS mean_unjudged_where_judged FROM ({_SPARSE}) GROUP BY 1""",
)
def sparse_diagnostics(spark, sf):
    return metrics.rounded(diagnostics.sparse_summary(inversions_per_query(spark, sf)))


def placed(spark, sf):
    flags = inversions_per_query(spark, sf)
    return diagnostics.strata(vectors(spark, sf, "bm25"), vectors(spark, sf, "oracle"), flags)


@query("oracle_strata", "SELECT split, query_id, stratum, round(baseline, 9) AS baseline, round(oracle, 9) AS oracle FROM strata")
def oracle_strata(spark, sf):
    return metrics.rounded(placed(spark, sf))


@query(
    "stratified_delta",
    """SELECT s.stratum, count(query_id) AS queries, round(coalesce(avg(d), 0), 9) AS mean_delta FROM (SELECT unnest(['improvable', 'already_at_oracle', 'no_relevant_in_candidates']) AS stratum) s
    LEFT JOIN (SELECT stratum, x.query_id, m.ndcg_at_10 - x.baseline AS d FROM strata x JOIN m_lexical m ON m.query_id = x.query_id) y ON y.stratum = s.stratum GROUP BY 1""",
)
def stratified_delta(spark, sf):
    return metrics.rounded(diagnostics.stratified_delta(placed(spark, sf), vectors(spark, sf, "lexical")))


@query("oracle_gap", "SELECT m.split, round(avg(o.ndcg_at_10) - avg(m.ndcg_at_10), 9) AS gap FROM m_lexical m JOIN m_oracle o ON o.query_id = m.query_id GROUP BY 1")
def oracle_gap(spark, sf):
    a = vectors(spark, sf, "lexical").groupBy("split").agg(F.avg("ndcg_at_10").alias("s"))
    b = vectors(spark, sf, "oracle").groupBy("split").agg(F.avg("ndcg_at_10").alias("o"))
    return metrics.rounded(a.join(b, "split").select("split", (F.col("o") - F.col("s")).alias("gap")))


def depth_vectors(spark, sf):
    """Metrics of all depths in one plan: the depth is part of the partition key."""
    base = tb.scores(spark, sf).join(tb.run(spark, sf).drop("bm25_score"), ["split", "query_id", "docid"])
    deep = judgments.attach(ranking.at_depths(base).select("split", "query_id", "docid", "depth", "rank"), tb.qrels(spark, sf))
    universe = tb.topics(spark, sf).select("split", "query_id", F.explode(F.array(*map(F.lit, ranking.DEPTHS))).alias("depth"))
    return metrics.per_query(deep, tb.qrels(spark, sf), universe, "rank", "depth")


_DEPTHS = " UNION ALL ".join(
    f"""SELECT {k} AS depth, avg(n) AS ndcg FROM (SELECT t.query_id, CASE WHEN idcg > 0 THEN coalesce(sum(CASE WHEN r.rank <= 10 AND c.relevance_grade > 0 THEN (pow(2.0, c.relevance_grade) - 1) / log2(r.rank + 1) ELSE 0.0 END), 0) / idcg ELSE 0.0 END AS n
    FROM topics t LEFT JOIN ({at_depth(k)}) r ON r.query_id = t.query_id LEFT JOIN cand c ON c.query_id = r.query_id AND c.docid = r.docid LEFT JOIN ideal i ON i.query_id = t.query_id GROUP BY t.query_id, idcg)"""
    for k in ranking.DEPTHS
)


@query("depth_profile", f"SELECT depth, round(ndcg, 9) AS ndcg FROM ({_DEPTHS})")
def depth_profile(spark, sf):
    return metrics.rounded(depth_vectors(spark, sf).groupBy("depth").agg(F.avg("ndcg_at_10").alias("ndcg")))


_DEEP = " UNION ALL ".join(
    f"""SELECT {k} AS depth, avg(n) AS ndcg_at_10, avg(j) AS judged_at_10, avg(c) AS condensed_ndcg_at_10, count(*) FILTER (WHERE n - b >= 1e-12) AS improved, count(*) FILTER (WHERE n - b <= -1e-12) AS degraded, count(*) FILTER (WHERE abs(n - b) < 1e-12) AS ties FROM
    (SELECT m.query_id, m.ndcg_at_10 AS b, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0.0 END AS n, CASE WHEN idcg > 0 THEN coalesce(cdcg, 0) / idcg ELSE 0.0 END AS c, coalesce(judged, 0) / 10.0::DOUBLE AS j FROM m_bm25 m LEFT JOIN
      (SELECT query_id, sum(CASE WHEN rank <= 10 AND relevance_grade > 0 THEN (pow(2.0, relevance_grade) - 1) / log2(rank + 1) ELSE 0.0 END) AS dcg, count(*) FILTER (WHERE is_judged AND rank <= 10) AS judged,
        sum(CASE WHEN is_judged AND kpos <= 10 AND relevance_grade > 0 THEN (pow(2.0, relevance_grade) - 1) / log2(kpos + 1) ELSE 0.0 END) AS cdcg FROM
        (SELECT c.*, r.rank, row_number() OVER (PARTITION BY c.query_id, is_judged ORDER BY r.rank) AS kpos FROM ({at_depth(k)}) r JOIN cand c ON c.query_id = r.query_id AND c.docid = r.docid) GROUP BY 1) q ON q.query_id = m.query_id LEFT JOIN ideal i ON i.query_id = m.query_id)"""
    for k in ranking.DEPTHS
)


@query("depth_comparison", f"SELECT depth, round(ndcg_at_10, 9) AS ndcg_at_10, round(judged_at_10, 9) AS judged_at_10, round(condensed_ndcg_at_10, 9) AS condensed_ndcg_at_10, improved, degraded, ties FROM ({_DEEP})")
def depth_comparison(spark, sf):
    """Of each depth: mean nDCG, judged and condensed nDCG, and its queries improved, degraded and tied against BM25."""
    base = vectors(spark, sf, "bm25").select("split", "query_id", F.col("ndcg_at_10").alias("baseline"))
    d = F.col("ndcg_at_10") - F.col("baseline")
    means = [F.avg(m).alias(m) for m in ("ndcg_at_10", "judged_at_10", "condensed_ndcg_at_10")]
    counts = [F.count_if(d >= compare.TIE).alias("improved"), F.count_if(d <= -compare.TIE).alias("degraded"), F.count_if(F.abs(d) < compare.TIE).alias("ties")]
    return metrics.rounded(depth_vectors(spark, sf).join(base, ["split", "query_id"]).groupBy("depth").agg(*means, *counts))


@query(
    "bias_flags",
    """SELECT d > 0 AND j < -0.05 AS pooling_bias, j > 0 AND c < 0 AS pool_overfit FROM (SELECT avg(m.ndcg_at_10) - avg(b.ndcg_at_10) AS d, avg(m.judged_at_10) - avg(b.judged_at_10) AS j, avg(m.condensed_ndcg_at_10) - avg(b.condensed_ndcg_at_10) AS c FROM m_lexical m JOIN m_bm25 b ON b.query_id = m.query_id)""",
)
def bias_flags(spark, sf):
    mean = lambda v, p: v.agg(*[F.avg(m).alias(p + m) for m in ("ndcg_at_10", "judged_at_10", "condensed_ndcg_at_10")], F.lit(1).alias("k"))
    both = mean(vectors(spark, sf, "lexical"), "s_").join(mean(vectors(spark, sf, "bm25"), "b_"), "k")
    d = {m: F.col("s_" + m) - F.col("b_" + m) for m in ("ndcg_at_10", "judged_at_10", "condensed_ndcg_at_10")}
    return both.select(((d["ndcg_at_10"] > 0) & (d["judged_at_10"] < -0.05)).alias("pooling_bias"), ((d["judged_at_10"] > 0) & (d["condensed_ndcg_at_10"] < 0)).alias("pool_overfit"))


# Comparison


def deltas(spark, sf, system="lexical"):
    return compare.paired(vectors(spark, sf, system), vectors(spark, sf, "bm25"))


@query("paired_deltas", "SELECT s.split, s.query_id, round(b.ndcg_at_10, 9) AS baseline, round(s.ndcg_at_10, 9) AS system, round(s.ndcg_at_10 - b.ndcg_at_10, 9) AS delta FROM m_lexical s JOIN m_bm25 b ON b.query_id = s.query_id")
def paired_deltas(spark, sf):
    return metrics.rounded(deltas(spark, sf))


@query("paired_summary", summary_of("lexical"))
def paired_summary(spark, sf):
    return metrics.rounded(compare.summary(deltas(spark, sf)))


_BOOT = """b AS (SELECT unnest(range(0, 10000)) AS b), n AS (SELECT count(*) AS n FROM m_bm25), num AS (SELECT row_number() OVER (ORDER BY s.split, s.query_id) - 1 AS i, s.ndcg_at_10 - b.ndcg_at_10 AS delta FROM m_{0} s JOIN m_bm25 b ON b.query_id = s.query_id),
    boot AS (SELECT b, CAST(sum(CAST(delta AS DECIMAL(28,15))) AS DOUBLE) / (SELECT n FROM n) AS m FROM (SELECT b, k, CAST('0x' || substr(md5('20260802|' || b || '|' || k), 1, 8) AS BIGINT) % (SELECT n FROM n) AS i FROM b, (SELECT unnest(range(0, (SELECT n FROM n))) AS k)) d JOIN num USING (i) GROUP BY 1)"""


def _boot(system: str, sql: str) -> str:
    return "SELECT * FROM (WITH " + _BOOT.format(system) + " " + sql + ")"


@query("bootstrap_hash_ci", _boot("lexical", "SELECT count(*) AS resamples, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high FROM boot"))
def bootstrap_hash_ci(spark, sf):
    return metrics.rounded(compare.bootstrap_by_hash(deltas(spark, sf)))


@query("bootstrap_numpy_exact")
def bootstrap_numpy_exact(spark, sf):
    return compare.bootstrap_exact(deltas(spark, sf))


def _outcome(spark, sf, system):
    d = deltas(spark, sf, system)
    ci = compare.bootstrap_by_hash(d).withColumn("k", F.lit(1))
    mean = d.agg(F.avg("delta").alias("mean_delta"), F.lit(1).alias("k"))
    return mean.join(ci, "k").select(F.lit(system).alias("system"), "mean_delta", "ci_low", "ci_high", compare.outcome(F.col("mean_delta"), F.col("ci_low"), F.col("ci_high")).alias("outcome"))


def _outcome_sql(system: str) -> str:
    return _boot(
        system,
        f"""SELECT '{system}' AS system, round(mean_delta, 9) AS mean_delta, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, CASE WHEN lo > 0 AND mean_delta >= 0.010 THEN 'improvement_confirmed' WHEN lo > 0 THEN 'positive_below_practical_threshold' WHEN hi < 0 THEN 'degradation_confirmed'
        WHEN abs(mean_delta) < 1e-12 THEN 'no_detectable_change' WHEN mean_delta > 0 THEN 'inconclusive_positive' WHEN mean_delta < 0 THEN 'inconclusive_negative' ELSE 'no_detectable_change' END AS outcome
        FROM (SELECT (SELECT avg(delta) FROM num) AS mean_delta, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM boot)""",
    )


@query("ml_outcome", _outcome_sql("lexical"))
def ml_outcome(spark, sf):
    return metrics.rounded(_outcome(spark, sf, "lexical"))


@query("three_way", _outcome_sql("lexical") + " UNION ALL " + _outcome_sql("c"))
def three_way(spark, sf):
    return metrics.rounded(_outcome(spark, sf, "lexical").unionByName(_outcome(spark, sf, "c")))


@query(
    "three_way_primary",
    "SELECT count(*) AS queries, count(*) FILTER (WHERE d >= 1e-12) AS improved, count(*) FILTER (WHERE d <= -1e-12) AS degraded, count(*) FILTER (WHERE abs(d) < 1e-12) AS ties, round(avg(d), 9) AS mean_delta, round(quantile_cont(d, 0.5), 9) AS median_delta, round(min(d), 9) AS min_delta, round(max(d), 9) AS max_delta FROM (SELECT s.ndcg_at_10 - b.ndcg_at_10 AS d FROM m_lexical s JOIN m_c b ON b.query_id = s.query_id)",
)
def three_way_primary(spark, sf):
    """The primary comparison of three systems: the last against the one in the middle."""
    return metrics.rounded(compare.summary(compare.paired(vectors(spark, sf, "lexical"), vectors(spark, sf, "c"))))


_ROLE = "SELECT split, query_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY sha256('20260803|' || query_id), query_id) <= ceil(0.15::DOUBLE * count(*) OVER (PARTITION BY stratum)) THEN 'validation' ELSE 'fit' END AS split_role FROM qstrata WHERE split = 'train'"
_LABEL = "CASE WHEN up <= 1e-9 AND down > 1e-9 THEN 'docno_asc' WHEN down <= 1e-9 AND up > 1e-9 THEN 'docno_desc' WHEN up <= 1e-9 THEN 'inconclusive_metric_equivalent' ELSE 'no_policy_matches' END"
_POLICY = """SELECT a.query_id, a.n AS up, d.n AS down FROM
    (SELECT query_id, sum(CASE WHEN rank <= 10 AND relevance_grade > 0 THEN 1 / log2(rank + 1) ELSE 0.0 END) AS n FROM (SELECT l.query_id, relevance_grade, row_number() OVER (PARTITION BY l.query_id ORDER BY score DESC, l.docid) AS rank FROM lex l JOIN cand c ON c.query_id = l.query_id AND c.docid = l.docid) GROUP BY 1) a JOIN
    (SELECT query_id, sum(CASE WHEN rank <= 10 AND relevance_grade > 0 THEN 1 / log2(rank + 1) ELSE 0.0 END) AS n FROM (SELECT l.query_id, relevance_grade, row_number() OVER (PARTITION BY l.query_id ORDER BY score DESC, l.docid DESC) AS rank FROM lex l JOIN cand c ON c.query_id = l.query_id AND c.docid = l.docid) GROUP BY 1) d USING (query_id)"""


@query(
    "tie_policy_label",
    f"""SELECT external, round(up, 9) AS asc_difference, round(down, 9) AS desc_difference, {_LABEL} AS conclusion FROM (SELECT 'ascending' AS external, 0.0::DOUBLE AS up, max(abs(up - down)) AS down FROM ({_POLICY}) UNION ALL SELECT 'descending', max(abs(up - down)), 0.0::DOUBLE FROM ({_POLICY}) UNION ALL SELECT 'shifted', 1.0::DOUBLE, max(abs(up + 1.0 - down)) FROM ({_POLICY}))""",
)
def tie_policy_label(spark, sf):
    """Which tie policy an external metric vector agrees with, for three external vectors: by docid ascending, descending, and one that is off by 1."""
    def gains(ascending, name):
        ranked = ranking.by_score(tb.scores(spark, sf), docid_ascending=ascending)
        known = tb.candidates(spark, sf).select("query_id", "docid", "relevance_grade")
        part = F.when((F.col("rank") <= 10) & (F.col("relevance_grade") > 0), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
        return ranked.join(known, ["query_id", "docid"]).groupBy("query_id").agg(F.sum(part).alias(name))

    both = gains(True, "up").join(gains(False, "down"), "query_id")
    external = F.explode(F.array(*[F.struct(F.lit(n).alias("external"), x.alias("value")) for n, x in (("ascending", F.col("up")), ("descending", F.col("down")), ("shifted", F.col("up") + 1))]))
    rows = both.select("up", "down", external.alias("e")).groupBy("e.external").agg(F.max(F.abs(F.col("e.value") - F.col("up"))).alias("asc_difference"), F.max(F.abs(F.col("e.value") - F.col("down"))).alias("desc_difference"))
    return metrics.rounded(rows.withColumn("conclusion", compare.tie_policy(F.col("desc_difference"), F.col("asc_difference"))))


@query(
    "validation_comparison",
    """SELECT a.queries, round(a.mean_delta, 9) AS mean_delta, a.improved, a.degraded, j.n AS judged_usable, w.n AS weak_usable FROM (SELECT count(*) AS queries, avg(d) AS mean_delta, count(*) FILTER (WHERE d >= 1e-12) AS improved, count(*) FILTER (WHERE d <= -1e-12) AS degraded FROM
    (SELECT x.ndcg_at_10 - y.ndcg_at_10 AS d FROM m_lexical x JOIN m_c y ON y.query_id = x.query_id WHERE x.query_id IN (SELECT query_id FROM ("""
    + _ROLE
    + """) WHERE split_role = 'validation'))) a, (SELECT count(DISTINCT query_id) AS n FROM pairs_judged WHERE split = 'train') j, (SELECT count(DISTINCT query_id) AS n FROM pairs_weak WHERE split = 'train') w""",
)
def validation_comparison(spark, sf):
    """Two systems over the validation queries, and the queries that each regime of pairs can use."""
    ids = split_hash_mode(spark, sf).where("split_role = 'validation'").select("query_id")
    own = lambda system: vectors(spark, sf, system).join(ids, "query_id", "left_semi")
    a = compare.summary(compare.paired(own("lexical"), own("c"))).select("queries", "mean_delta", "improved", "degraded", F.lit(1).alias("k"))
    usable = lambda p, name: p.where("split = 'train'").agg(F.countDistinct("query_id").alias(name), F.lit(1).alias("k"))
    return metrics.rounded(a.join(usable(pairs_judged_only(spark, sf), "judged_usable"), "k").join(usable(pairs_weak_hash_mode(spark, sf), "weak_usable"), "k").drop("k"))


@query(
    "control_verdict",
    _boot("c", "SELECT CASE WHEN lo > 0 THEN 'BLOCKED_FOR_REVIEW' WHEN mean_delta > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT (SELECT avg(delta) FROM num) AS mean_delta, quantile_cont(m, 0.025) AS lo FROM boot)"),
)
def control_verdict(spark, sf):
    return _outcome(spark, sf, "c").select(compare.control_verdict(F.col("mean_delta"), F.col("ci_low"), F.lit(True)).alias("verdict"))


# The same with NumPy's draws


def _outcome_exact(spark, sf, system):
    d = compare.bootstrap_exact(deltas(spark, sf, system))
    return d.select(F.lit(system).alias("system"), "mean_delta", "ci_low", "ci_high", compare.outcome(F.col("mean_delta"), F.col("ci_low"), F.col("ci_high")).alias("outcome"))


@query("ml_outcome_numpy_exact")
def ml_outcome_numpy_exact(spark, sf):
    return _outcome_exact(spark, sf, "lexical")


@query("three_way_numpy_exact")
def three_way_numpy_exact(spark, sf):
    return _outcome_exact(spark, sf, "lexical").unionByName(_outcome_exact(spark, sf, "c"))


@query("control_verdict_numpy_exact")
def control_verdict_numpy_exact(spark, sf):
    return _outcome_exact(spark, sf, "c").select(compare.control_verdict(F.col("mean_delta"), F.col("ci_low"), F.lit(True)).alias("verdict"))


#: The published gate of the BM25 run.
PUBLISHED = (("ndcg_at_10", 0.334, 0.002), ("recall_at_100", 0.661, 0.005))


@query(
    "reproduction_gate",
    """SELECT g.metric, round(v, 9) AS local_value, g.published_value, g.tolerance, CASE WHEN abs(v - g.published_value) <= g.tolerance THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT 'ndcg_at_10' AS metric, avg(ndcg_at_10) AS v FROM m_bm25 UNION ALL SELECT 'recall_at_100', avg(recall_at_100) FROM m_bm25) l
    JOIN (SELECT 'ndcg_at_10' AS metric, 0.334::DOUBLE AS published_value, 0.002::DOUBLE AS tolerance UNION ALL SELECT 'recall_at_100', 0.661, 0.005) g ON g.metric = l.metric""",
)
def reproduction_gate(spark, sf):
    local = metrics.macro(vectors(spark, sf, "bm25")).select(F.explode(F.map_from_arrays(F.array(F.lit("ndcg_at_10"), F.lit("recall_at_100")), F.array("ndcg_at_10", "recall_at_100"))).alias("metric", "local_value"))
    return metrics.rounded(compare.gate(local, spark.createDataFrame(list(PUBLISHED), "metric string, published_value double, tolerance double")))


@query("tie_policy_metric_audit", "SELECT round(max(abs(a - d)), 9) AS max_difference FROM (SELECT t.query_id, CASE WHEN idcg > 0 THEN coalesce(sum(CASE WHEN x.ra <= 10 AND c.relevance_grade > 0 THEN 1 / log2(x.ra + 1) ELSE 0.0 END), 0) / idcg ELSE 0.0 END AS a, CASE WHEN idcg > 0 THEN coalesce(sum(CASE WHEN x.rd <= 10 AND c.relevance_grade > 0 THEN 1 / log2(x.rd + 1) ELSE 0.0 END), 0) / idcg ELSE 0.0 END AS d FROM topics t LEFT JOIN (SELECT query_id, docid, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, docid) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, docid DESC) AS rd FROM lex) x ON x.query_id = t.query_id LEFT JOIN cand c ON c.query_id = x.query_id AND c.docid = x.docid LEFT JOIN ideal i ON i.query_id = t.query_id GROUP BY t.query_id, idcg)")
def tie_policy_metric_audit(spark, sf):
    s, q, t = tb.scores(spark, sf), tb.qrels(spark, sf), tb.topics(spark, sf)
    a, d = (metrics.per_query(judgments.attach(ranking.by_score(s, docid_ascending=up).drop("score"), q), q, t, "rank") for up in (True, False))
    return metrics.rounded(compare.paired(a, d).agg(F.max(F.abs("delta")).alias("max_difference")))


# Training data


@query("query_strata", "SELECT split, query_id, n_relevant, n_judged_negatives, relevant_bucket, has_judged_negative, stratum FROM qstrata")
def query_strata(spark, sf):
    return training_pairs.query_strata(tb.candidates(spark, sf))


@query("stratum_sizes", "SELECT split, stratum, count(*) AS n FROM qstrata GROUP BY GROUPING SETS ((split, stratum), (stratum))")
def stratum_sizes(spark, sf):
    s = query_strata(spark, sf)
    s.createOrReplaceTempView("ranklane_strata")
    return spark.sql("SELECT split, stratum, count(*) AS n FROM ranklane_strata GROUP BY GROUPING SETS ((split, stratum), (stratum))")


@query("merged_strata")
def merged_strata(spark, sf):
    return training_pairs.with_merged(query_strata(spark, sf)).select("query_id", "stratum", "merged_stratum")


@query("split_hash_mode", _ROLE)
def split_hash_mode(spark, sf):
    s = training_pairs.split_by_hash(query_strata(spark, sf).where("split = 'train'"))
    return s.select("split", "query_id", "stratum", "split_role")


@query("split_numpy_exact")
def split_numpy_exact(spark, sf):
    return training_pairs.split_exact(training_pairs.with_merged(query_strata(spark, sf).where("split = 'train'")))


@query("validation_groups", f"SELECT c.query_id, count(*) AS n FROM cand c WHERE c.query_id IN (SELECT query_id FROM ({_ROLE}) WHERE split_role = 'validation') GROUP BY 1")
def validation_groups(spark, sf):
    ids = split_hash_mode(spark, sf).where("split_role = 'validation'").select("query_id")
    return tb.candidates(spark, sf).join(ids, "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))


@query("train_isolation", "SELECT count(*) FILTER (WHERE split = 'dev') AS dev_rows, count(*) FILTER (WHERE split = 'train') AS train_rows FROM cand")
def train_isolation(spark, sf):
    return tb.candidates(spark, sf).agg(F.count_if(F.col("split") == "dev").alias("dev_rows"), F.count_if(F.col("split") == "train").alias("train_rows"))


@query("weak_negatives_hash_mode", "SELECT split, query_id, docid, bm25_rank, CAST(choice AS INT) AS choice FROM weak")
def weak_negatives_hash_mode(spark, sf):
    return training_pairs.weak_negatives(tb.candidates(spark, sf))


@query("weak_negatives_numpy_exact")
def weak_negatives_numpy_exact(spark, sf):
    return training_pairs.weak_negatives(tb.candidates(spark, sf), exact=True)


@query("source_capacities", "SELECT split, query_id, ja AS judged_available, wa AS weak_available, jt AS judged_take, wt AS weak_take FROM cap_weak")
def source_capacities(spark, sf):
    c, w = tb.candidates(spark, sf), weak_negatives_hash_mode(spark, sf)
    keys = ["split", "query_id"]
    n = c.groupBy(*keys).agg(F.count_if(F.col("judgment") == "relevant").alias("p"), F.count_if(F.col("judgment") == "judged_non_relevant").alias("j")).join(w.groupBy(*keys).agg(F.count("*").alias("w")), keys, "left").na.fill(0)
    sized = n.where("p > 0 AND j + w > 0").select(*keys, (F.col("p") * F.col("j")).alias("judged_available"), (F.col("p") * F.col("w")).alias("weak_available"))
    return training_pairs.capacities(sized)


@query("pairs_judged_only", "SELECT * FROM pairs_judged")
def pairs_judged_only(spark, sf):
    return training_pairs.pairs(tb.candidates(spark, sf), None)


@query("pairs_weak_hash_mode", "SELECT * FROM pairs_weak")
def pairs_weak_hash_mode(spark, sf):
    return training_pairs.pairs(tb.candidates(spark, sf), weak_negatives_hash_mode(spark, sf))


@query("pair_product_before_cap", "SELECT CAST(sum(p * n) AS BIGINT) AS pairs_before_cap FROM (SELECT query_id, count(*) FILTER (WHERE judgment = 'relevant') AS p, count(*) FILTER (WHERE judgment = 'judged_non_relevant') AS n FROM cand GROUP BY 1)")
def pair_product_before_cap(spark, sf):
    one = query_strata(spark, sf)
    return one.agg(F.sum(F.col("n_relevant").cast("long") * F.col("n_judged_negatives")).alias("pairs_before_cap"))


@query("pair_stats", "SELECT split, negative_source, count(*) AS n, count(DISTINCT query_id) AS queries, count(DISTINCT query_id || '|' || positive_docid) AS positives, sum(CAST(pair_weight AS DOUBLE)) AS weight FROM pairs_weak GROUP BY 1, 2")
def pair_stats(spark, sf):
    p = pairs_weak_hash_mode(spark, sf)
    return p.groupBy("split", "negative_source").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"), F.countDistinct("query_id", "positive_docid").alias("positives"), F.sum(F.col("pair_weight").cast("double")).alias("weight"))


@query(
    "pair_exclusions",
    """SELECT split, reason, count(*) AS queries FROM (SELECT t.split, t.query_id, CASE WHEN c.n IS NULL THEN 'no_candidates' WHEN p = 0 THEN 'no_positive' WHEN j = 0 AND coalesce(w.n, 0) = 0 THEN 'no_negative' WHEN j = 0 THEN 'weak_only' ELSE 'used' END AS reason FROM topics t
    LEFT JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE judgment = 'relevant') AS p, count(*) FILTER (WHERE judgment = 'judged_non_relevant') AS j FROM cand GROUP BY 1) c ON c.query_id = t.query_id LEFT JOIN (SELECT query_id, count(*) AS n FROM weak GROUP BY 1) w ON w.query_id = t.query_id) GROUP BY 1, 2""",
)
def pair_exclusions(spark, sf):
    """Why queries give pairs or don't: each topic has one reason."""
    state = F.col("judgment")
    c = tb.candidates(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(state == "relevant").alias("p"), F.count_if(state == "judged_non_relevant").alias("j"))
    w = weak_negatives_hash_mode(spark, sf).groupBy("query_id").agg(F.count("*").alias("w"))
    reason = F.when(F.col("n").isNull(), "no_candidates").when(F.col("p") == 0, "no_positive").when((F.col("j") == 0) & (F.coalesce("w", F.lit(0)) == 0), "no_negative").when(F.col("j") == 0, "weak_only").otherwise("used")
    rows = tb.topics(spark, sf).join(c, "query_id", "left").join(w, "query_id", "left")
    return rows.groupBy("split", reason.alias("reason")).agg(F.count("*").alias("queries"))


@query("score_group_sequences", "SELECT split, query_id, count(DISTINCT docid) AS sequences FROM (SELECT split, query_id, positive_docid AS docid FROM pairs_weak UNION ALL SELECT split, query_id, negative_docid FROM pairs_weak) GROUP BY 1, 2")
def score_group_sequences(spark, sf):
    """How many sequences of each query are scored, each once."""
    return encoding.sequences_once(pairs_weak_hash_mode(spark, sf)).groupBy("split", "query_id").agg(F.count("docid").alias("sequences"))


@query("factor_distribution", "SELECT relevant_bucket, has_judged_negative, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS fraction FROM qstrata GROUP BY 1, 2")
def factor_distribution(spark, sf):
    """Queries of every pair of factors, and their share."""
    rows = query_strata(spark, sf).groupBy("relevant_bucket", "has_judged_negative").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"), F.lit(1).alias("k"))
    return metrics.rounded(rows.withColumn("k", F.lit(1)).join(total, "k").select("relevant_bucket", "has_judged_negative", "n", (F.col("n") / F.col("total")).alias("fraction")))


@query("weak_share_summary", "SELECT round(min(w), 9) AS low, round(quantile_cont(w, 0.5), 9) AS median, round(max(w), 9) AS high, count(*) FILTER (WHERE w = 0) AS without_weak, count(*) FILTER (WHERE w = 1) AS only_weak FROM (SELECT sum(CASE WHEN negative_source = 'weak' THEN CAST(pair_weight AS DOUBLE) ELSE 0 END) / sum(CAST(pair_weight AS DOUBLE)) AS w FROM pairs_weak GROUP BY split, query_id)")
def weak_share_summary(spark, sf):
    """Distribution of the weak share over queries."""
    w = F.col("weak_share")
    return metrics.rounded(weak_share(spark, sf).agg(F.min(w).alias("low"), F.expr("percentile(weak_share, 0.5)").alias("median"), F.max(w).alias("high"), F.count_if(w == 0).alias("without_weak"), F.count_if(w == 1).alias("only_weak")))


@query("rank_histogram", "SELECT b.bucket, count(p.bm25) AS n FROM (SELECT unnest(['1-25', '26-50', '51-75', '76-100']) AS bucket) b LEFT JOIN (SELECT negative_bm25_rank AS bm25, CASE WHEN negative_bm25_rank <= 25 THEN '1-25' WHEN negative_bm25_rank <= 50 THEN '26-50' WHEN negative_bm25_rank <= 75 THEN '51-75' ELSE '76-100' END AS bucket FROM pairs_weak) p ON p.bucket = b.bucket GROUP BY 1")
def rank_histogram(spark, sf):
    r = F.col("negative_bm25_rank")
    label = F.when(r <= 25, "1-25").when(r <= 50, "26-50").when(r <= 75, "51-75").otherwise("76-100")
    n = pairs_weak_hash_mode(spark, sf).groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, ("1-25", "26-50", "51-75", "76-100")))).alias("bucket"))
    return every.join(n, "bucket", "left").na.fill(0)


@query("weak_share", "SELECT split, query_id, round(sum(CASE WHEN negative_source = 'weak' THEN CAST(pair_weight AS DOUBLE) ELSE 0 END) / sum(CAST(pair_weight AS DOUBLE)), 9) AS weak_share FROM pairs_weak GROUP BY 1, 2")
def weak_share(spark, sf):
    w = F.col("pair_weight").cast("double")
    return metrics.rounded(pairs_weak_hash_mode(spark, sf).groupBy("split", "query_id").agg((F.sum(F.when(F.col("negative_source") == "weak", w).otherwise(0.0)) / F.sum(w)).alias("weak_share")))


@query("weak_doc_promotion", "SELECT CAST(count(DISTINCT w.docid) AS BIGINT) AS weak_docs, CAST(count(DISTINCT CASE WHEN t.docid IS NOT NULL THEN w.docid END) AS BIGINT) AS promoted FROM weak w LEFT JOIN (SELECT DISTINCT docid FROM rank_lexical WHERE rank <= 10) t ON t.docid = w.docid")
def weak_doc_promotion(spark, sf):
    w = weak_negatives_hash_mode(spark, sf).select("docid").distinct()
    top = tb.ranking(spark, sf, "lexical").where("rank <= 10").select("docid").distinct().withColumn("top", F.lit(True))
    return w.join(top, "docid", "left").agg(F.count("*").alias("weak_docs"), F.count_if("top").alias("promoted"))


@query("control_pairs")
def control_pairs(spark, sf):
    strata = training_pairs.with_merged(query_strata(spark, sf).where("split = 'train'"))
    split = training_pairs.split_exact(strata)
    fit = split.where("split_role = 'fit'").select("query_id")
    judged = pairs_judged_only(spark, sf).where("split = 'train'").join(fit, "query_id", "left_semi")
    return training_pairs.control_pairs(judged, split)


# Encoding and scoring


def texts(spark, sf):
    """Candidates with query and document text; the text enters in the last join."""
    c = tb.candidates(spark, sf).select("split", "query_id", "docid")
    p = tb.passages(spark, sf).select("docid", document(F.col("title"), F.col("text")).alias("document"))
    return c.join(tb.topics(spark, sf).select("query_id", "query_text"), "query_id").join(p, "docid")


@query("document_builder", "SELECT docid, CASE WHEN regexp_full_match(title, '[\\s\\p{Z}]*') THEN text ELSE title || chr(10) || text END AS document FROM docs")
def document_builder(spark, sf):
    return tb.passages(spark, sf).select("docid", document(F.col("title"), F.col("text")).alias("document"))


def encoded(spark, sf):
    return encoding.encode_pair(texts(spark, sf), "query_text", "document")


@query(
    "char_pair_encoding",
    """SELECT e.query_id, e.docid, sha256(array_to_string(list_concat([0], list_transform(string_split(query_text, ''), lambda c: 10 + unicode(c) % 211), [2, 2], list_transform(string_split(document, '')[1:greatest(320 - length(query_text) - 4, 0)], lambda c: 10 + unicode(c) % 211), [2]), ',')) AS ids_sha256, CAST(tokens_before AS INT) AS tokens_before, CAST(tokens_after AS INT) AS tokens_after, tokens_after < tokens_before AS truncated
    FROM enc e JOIN encoded x ON x.query_id = e.query_id AND x.docid = e.docid""",
)
def char_pair_encoding(spark, sf):
    ids = F.sha2(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ","), 256)
    return encoded(spark, sf).select("query_id", "docid", ids.alias("ids_sha256"), "tokens_before", "tokens_after", "truncated")


@query(
    "token_accounting",
    """SELECT count(*) AS n_rows, round(avg(CASE WHEN tokens_after < tokens_before THEN 1.0::DOUBLE ELSE 0 END), 9) AS truncated_fraction, CAST(sum(tokens_before) AS BIGINT) AS total_before, CAST(sum(tokens_after) AS BIGINT) AS total_after, count(*) * 320 AS upper_bound,
    round(quantile_cont(tokens_before, 0.5), 9) AS p50, round(quantile_cont(tokens_before, 0.9), 9) AS p90, round(quantile_cont(tokens_before, 0.95), 9) AS p95, round(quantile_cont(tokens_before, 0.99), 9) AS p99, max(tokens_before) AS longest FROM encoded""",
)
def token_accounting(spark, sf):
    return metrics.rounded(encoding.accounting(encoded(spark, sf)))


@query("score_table_violations", "SELECT unnest(['null_score', 'not_finite', 'blank_docid', 'bad_tokens', 'bad_truncated', 'duplicate_pair']) AS \"check\", unnest([count(*) FILTER (WHERE score IS NULL), count(*) FILTER (WHERE NOT isfinite(score)), count(*) FILTER (WHERE trim(l.docid) = ''), count(*) FILTER (WHERE tokens_after > 320), 0, count(*) - count(DISTINCT l.query_id || '|' || l.docid)]) AS violations FROM lex l JOIN encoded e ON e.query_id = l.query_id AND e.docid = l.docid")
def score_table_violations(spark, sf):
    s = tb.scores(spark, sf).join(encoded(spark, sf).select("query_id", "docid", "tokens_before", "tokens_after", "truncated"), ["query_id", "docid"])
    return quality.violations(s, quality.score_checks(encoding.MAX_LENGTH), {"duplicate_pair": ["query_id", "docid"]})


_SHARDS = "SELECT query_id, (row_number() OVER (ORDER BY query_id) - 1) // 64 AS shard FROM (SELECT DISTINCT query_id FROM topics)"


@query("query_shards", _SHARDS)
def query_shards(spark, sf):
    return encoding.query_shards(tb.topics(spark, sf))


@query(
    "length_batches",
    f"""SELECT shard, batch, count(*) AS n, CAST(max(tokens_after) AS INT) AS longest, CAST(sum(tokens_after) AS BIGINT) AS tokens, count(*) * max(tokens_after) AS processed FROM (SELECT shard, tokens_after, (row_number() OVER (PARTITION BY shard ORDER BY tokens_after, e.query_id, docid) - 1) // 64 AS batch FROM encoded e JOIN ({_SHARDS}) s ON s.query_id = e.query_id) GROUP BY 1, 2""",
)
def length_batches(spark, sf):
    rows = encoded(spark, sf).select("query_id", "docid", "tokens_after").join(query_shards(spark, sf), "query_id")
    return encoding.length_batches(rows)


@query(
    "pairwise_loss",
    """SELECT split, query_id, round(sum(w * (greatest(x, 0) + ln(1 + exp(-abs(x))))) / sum(w), 9) AS loss, count(*) AS n_pairs FROM (SELECT p.split, p.query_id, CAST(pair_weight AS DOUBLE) AS w, CAST(n.score AS DOUBLE) - CAST(s.score AS DOUBLE) AS x FROM pairs_weak p JOIN lex s ON s.query_id = p.query_id AND s.docid = p.positive_docid JOIN lex n ON n.query_id = p.query_id AND n.docid = p.negative_docid) GROUP BY 1, 2""",
)
def pairwise_loss(spark, sf):
    s = tb.scores(spark, sf)
    p = pairs_weak_hash_mode(spark, sf)
    scored = p.join(s.select("query_id", F.col("docid").alias("positive_docid"), F.col("score").alias("s_pos")), ["query_id", "positive_docid"]).join(s.select("query_id", F.col("docid").alias("negative_docid"), F.col("score").alias("s_neg")), ["query_id", "negative_docid"])
    return metrics.rounded(encoding.query_losses(scored))


@query("accumulation_windows", "SELECT query_id, place, (place - 1) // 16 AS \"window\" FROM (SELECT query_id, row_number() OVER (ORDER BY sha256('20260804|' || query_id), query_id) AS place FROM (SELECT DISTINCT query_id FROM topics WHERE split = 'train'))")
def accumulation_windows(spark, sf):
    return encoding.windows(tb.topics(spark, sf).where("split = 'train'"), 20260803, 1)


@query(
    "window_losses",
    """SELECT w."window", count(*) AS queries, round(avg(loss), 9) AS loss FROM (SELECT query_id, (row_number() OVER (ORDER BY sha256('20260804|' || query_id), query_id) - 1) // 16 AS "window" FROM (SELECT DISTINCT query_id FROM pairs_weak WHERE split = 'train')) w JOIN
    (SELECT p.query_id, sum(wt * (greatest(x, 0) + ln(1 + exp(-abs(x))))) / sum(wt) AS loss FROM (SELECT p.query_id, CAST(pair_weight AS DOUBLE) AS wt, CAST(n.score AS DOUBLE) - CAST(s.score AS DOUBLE) AS x FROM pairs_weak p JOIN lex s ON s.query_id = p.query_id AND s.docid = p.positive_docid JOIN lex n ON n.query_id = p.query_id AND n.docid = p.negative_docid WHERE p.split = 'train') p GROUP BY 1) l ON l.query_id = w.query_id GROUP BY 1""",
)
def window_losses(spark, sf):
    """Mean loss of each accumulation window over the queries that it has; the last one may have fewer."""
    losses = pairwise_loss(spark, sf).where("split = 'train'")
    w = encoding.windows(losses.select("query_id"), 20260803, 1)
    return metrics.rounded(w.join(losses, "query_id").groupBy("window").agg(F.count("*").alias("queries"), F.avg("loss").alias("loss")))


@query("scorer_udf_scores")
def scorer_udf_scores(spark, sf):
    return encoding.score_pairs(texts(spark, sf))


@query("token_cache_sequences", "SELECT query_id, docid FROM (SELECT query_id, positive_docid AS docid FROM pairs_weak UNION SELECT query_id, negative_docid FROM pairs_weak)")
def token_cache_sequences(spark, sf):
    p = pairs_weak_hash_mode(spark, sf)
    return p.select("query_id", F.col("positive_docid").alias("docid")).union(p.select("query_id", "negative_docid")).distinct()


@query(
    "token_cache",
    "SELECT count(*) AS sequences, CAST(sum(tokens_after) AS BIGINT) AS tokens, CAST(max(tokens_after) AS INT) AS longest, CAST(4 * sum(tokens_after) AS BIGINT) AS bytes FROM encoded e JOIN (SELECT query_id, positive_docid AS docid FROM pairs_weak UNION SELECT query_id, negative_docid FROM pairs_weak) p ON p.query_id = e.query_id AND p.docid = e.docid",
)
def token_cache(spark, sf):
    """Sequences, tokens and bytes (32-bit ids) of the cache of all training pairs; each sequence is encoded once."""
    wanted = token_cache_sequences(spark, sf)
    one = encoding.encode_pair(texts(spark, sf).join(wanted, ["query_id", "docid"], "left_semi"), "query_text", "document").select(F.size("input_ids").alias("n"))
    return one.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), (4 * F.sum("n")).alias("bytes"))


# Selection, ledgers, gates


@query(
    "checkpoint_selection",
    "SELECT system, round(ndcg, 9) AS ndcg FROM (SELECT system, ndcg, row_number() OVER (ORDER BY round(ndcg, 9) DESC, priority) AS n FROM (SELECT 'bm25' AS system, 0 AS priority, avg(ndcg_at_10) AS ndcg FROM m_bm25 UNION ALL SELECT 'lexical', 1, avg(ndcg_at_10) FROM m_lexical UNION ALL SELECT 'c', 2, avg(ndcg_at_10) FROM m_c)) WHERE n = 1",
)
def checkpoint_selection(spark, sf):
    rows = None
    for k, system in enumerate(("bm25", "lexical", "c")):
        one = vectors(spark, sf, system).agg(F.round(F.avg("ndcg_at_10"), 9).alias("ndcg")).select(F.lit(system).alias("system"), F.lit(k).alias("priority"), "ndcg")
        rows = one if rows is None else rows.unionByName(one)
    best = rows.agg(F.max(F.struct("ndcg", (-F.col("priority")).alias("order"), "system")).alias("b"))
    return best.select("b.system", "b.ndcg")


_EPOCHS = " UNION ALL ".join(f"SELECT '{x}' AS run, {k} AS priority, CASE split WHEN 'train' THEN 1 ELSE 2 END AS epoch, round(avg(ndcg_at_10), 9) AS ndcg FROM m_{x} GROUP BY split" for k, x in enumerate(("bm25", "lexical", "c")))


@query(
    "checkpoint_epochs",
    f"""SELECT run, epoch, ndcg, row_number() OVER (ORDER BY ndcg DESC, priority) = 1 AS selected FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ndcg DESC, epoch) AS place FROM ({_EPOCHS})) WHERE place = 1""",
)
def checkpoint_epochs(spark, sf):
    """The best epoch of each run and the selected run; the splits stand in for epochs."""
    rows = None
    for k, system in enumerate(("bm25", "lexical", "c")):
        one = vectors(spark, sf, system).groupBy("split").agg(F.round(F.avg("ndcg_at_10"), 9).alias("ndcg"))
        one = one.select(F.lit(system).alias("run"), F.lit(k).alias("priority"), F.when(F.col("split") == "train", 1).otherwise(2).alias("epoch"), "ndcg")
        rows = one if rows is None else rows.unionByName(one)
    return compare.best_epochs(rows)


@query(
    "steady_state_estimate",
    "SELECT round(sum(pairs) / sum(seconds), 9) AS pairs_per_second, CAST(floor(100000 / (sum(pairs) / sum(seconds)) * 0.8) AS BIGINT) AS low_seconds, CAST(ceil(100000 / (sum(pairs) / sum(seconds)) * 1.4) AS BIGINT) AS high_seconds FROM (SELECT user_id, count(*) AS n, CAST(count(*) AS DOUBLE) AS pairs, sum(abs(value)) + 1 AS seconds FROM events GROUP BY 1) WHERE n >= 5",
    base=False,
)
def steady_state_estimate(spark, sf):
    steps = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"), (F.sum(F.abs("value")) + 1).alias("seconds")).where("n >= 5")
    rate = F.sum(F.col("n").cast("double")) / F.sum("seconds")
    one = steps.agg(rate.alias("pairs_per_second"))
    eta = F.lit(100000) / F.col("pairs_per_second")
    return metrics.rounded(one.select("pairs_per_second", F.floor(eta * 0.8).cast("long").alias("low_seconds"), F.ceil(eta * 1.4).cast("long").alias("high_seconds")))


def ledger(spark, sf):
    """The events of each user as a hash chain with deliberate gaps."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("event_id")
    digest = F.sha2(F.concat_ws("|", F.col("event_id"), F.col("event_type")), 256)
    rows = e.withColumns({"digest": digest, "sequence": F.row_number().over(w)}).withColumn("previous", F.when(F.col("event_id") % 97 != 0, F.lag("digest").over(w)))
    return rows.select(F.col("user_id").alias("chain"), "sequence", "ts", "previous", "digest")


@query(
    "ledger_chain_check",
    """SELECT chain, count(*) AS events, count(*) FILTER (WHERE sequence <> coalesce(s0 + 1, 1)) AS bad_sequence, count(*) FILTER (WHERE coalesce(previous, '') <> coalesce(d0, '')) AS bad_previous, count(*) FILTER (WHERE ts < t0) AS bad_time FROM
    (SELECT *, lag(sequence) OVER w AS s0, lag(digest) OVER w AS d0, lag(ts) OVER w AS t0 FROM (SELECT user_id AS chain, row_number() OVER u AS sequence, ts, sha256(event_id || '|' || event_type) AS digest, CASE WHEN event_id % 97 <> 0 THEN lag(sha256(event_id || '|' || event_type)) OVER u END AS previous FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)) WINDOW w AS (PARTITION BY chain ORDER BY sequence)) GROUP BY 1""",
    base=False,
)
def ledger_chain_check(spark, sf):
    return lineage.chain_violations(ledger(spark, sf))


@query(
    "manifest_drift",
    """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS status FROM (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 5 <> 0) a
    FULL OUTER JOIN (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS digest FROM documents WHERE doc_id % 3 <> 0) b ON b.path = a.path WHERE a.digest IS DISTINCT FROM b.digest""",
    base=False,
)
def manifest_drift(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("t"))
    before = d.where("doc_id % 5 <> 0").select("path", F.sha2("t", 256).alias("digest"))
    after = d.where("doc_id % 3 <> 0").select("path", F.sha2(F.concat("t", F.when(F.col("doc_id") % 7 == 0, "!").otherwise("")), 256).alias("digest"))
    return lineage.drift(before, after)


@query(
    "key_set_hash",
    """SELECT sha256(string_agg(d, '' ORDER BY g)) AS digest, CAST(sum(n) AS BIGINT) AS keys FROM (SELECT substr(h, 1, 3) AS g, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM (SELECT DISTINCT sha256(query_id || chr(9) || docid) AS h FROM run) GROUP BY 1)""",
)
def key_set_hash(spark, sf):
    return lineage.key_set_digest(tb.run(spark, sf), "query_id", "docid")


@query("artifact_profile", "SELECT count(*) AS n_rows, count(DISTINCT docid) AS docids, count(*) FILTER (WHERE title = '') AS empty_titles, min(length(text)) AS shortest, max(length(text)) AS longest FROM docs")
def artifact_profile(spark, sf):
    p = tb.passages(spark, sf)
    n = F.length("text").cast("long")
    return p.agg(F.count("*").alias("n_rows"), F.countDistinct("docid").alias("docids"), F.count_if(F.col("title") == "").alias("empty_titles"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


@query(
    "run_score_binding",
    """SELECT count(*) AS n, count(*) FILTER (WHERE h.rank IS DISTINCT FROM w.rank) AS mismatches FROM rank_lexical w FULL OUTER JOIN
    (SELECT query_id, docid, rank FROM rank_lexical WHERE CAST(query_id AS INT) % 4 <> 1 UNION ALL SELECT query_id, docid, rank FROM rank_c WHERE CAST(query_id AS INT) % 4 = 1) h ON h.query_id = w.query_id AND h.docid = w.docid""",
)
def run_score_binding(spark, sf):
    """A run's lines against the ranking by stored scores; the run of every fourth query is another system's. Ranks are read back from the lines."""
    want = ranking.by_score(tb.scores(spark, sf)).select("query_id", "docid", F.col("rank").alias("want"))
    other = F.col("query_id").cast("int") % 4 == 1
    run = tb.ranking(spark, sf, "lexical").where(~other).unionByName(tb.ranking(spark, sf, "c").where(other))
    lines = ranking.rank_preserving(run, "mixed").select(F.split("line", " ").alias("f"))
    have = lines.select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("docid"), (1000000 - F.col("f")[4].cast("double")).cast("long").alias("have"))
    both = want.join(have, ["query_id", "docid"], "full_outer")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("want").eqNullSafe(F.col("have"))).alias("mismatches"))


@query(
    "report_consistency",
    """SELECT abs(s - b - d) <= 1e-9 AS means_agree, placed = n AND ids = n AS strata_partition, placed, round(d, 9) AS mean_delta FROM (SELECT avg(x.ndcg_at_10) AS s, avg(y.ndcg_at_10) AS b, avg(x.ndcg_at_10 - y.ndcg_at_10) AS d, count(*) AS n FROM m_lexical x JOIN m_bm25 y ON y.query_id = x.query_id),
    (SELECT count(*) AS placed, count(DISTINCT query_id) AS ids FROM strata)""",
)
def report_consistency(spark, sf):
    d = deltas(spark, sf).agg(F.avg("delta").alias("d"), F.avg("system").alias("s"), F.avg("baseline").alias("b"), F.count("*").alias("n"), F.lit(1).alias("k"))
    p = placed(spark, sf).agg(F.count("*").alias("placed"), F.countDistinct("query_id").alias("ids"), F.lit(1).alias("k"))
    agree = (F.abs(F.col("s") - F.col("b") - F.col("d")) <= 1e-9).alias("means_agree")
    return metrics.rounded(d.join(p, "k").select(agree, ((F.col("placed") == F.col("n")) & (F.col("ids") == F.col("n"))).alias("strata_partition"), "placed", F.col("d").alias("mean_delta")))


_ENTRY = "CASE WHEN CAST(query_id AS INT) % 7 = 3 THEN CAST('NaN' AS DOUBLE) WHEN CAST(query_id AS INT) % 3 = 0 THEN ndcg_at_10 - 0.25 ELSE ndcg_at_10 END"


@query(
    "validation_entry_violations",
    f"""SELECT unnest(['not_finite', 'out_of_range', 'universe']) AS "check", unnest([count(*) FILTER (WHERE isnan(m)), count(*) FILTER (WHERE m < 0 OR (m > 1 + 1e-12 AND NOT isnan(m))), count(*) FILTER (WHERE o IS NULL OR q IS NULL)]) AS violations
    FROM (SELECT query_id AS q, {_ENTRY} AS m FROM m_lexical) a FULL OUTER JOIN (SELECT query_id AS o FROM m_c WHERE CAST(query_id AS INT) % 5 <> 0) b ON o = q""",
)
def validation_entry_violations(spark, sf):
    """Some values are bent out of range or made NaN, and some queries are missing on one side."""
    v = vectors(spark, sf, "lexical").select("query_id", F.expr(_ENTRY).alias("m"))
    other = vectors(spark, sf, "c").where("CAST(query_id AS INT) % 5 <> 0").select("query_id", F.lit(True).alias("other"))
    return quality.violations(
        v.withColumn("own", F.lit(True)).join(other, "query_id", "full_outer"),
        {"not_finite": F.isnan("m"), "out_of_range": ~F.isnan("m") & ((F.col("m") < 0) | (F.col("m") > 1 + 1e-12)), "universe": F.col("own").isNull() | F.col("other").isNull()},
    )


@query("dev_access_violations", "SELECT count(*) FILTER (WHERE event_type = 'purchase' AND (first_view IS NULL OR event_id < first_view)) AS before_selection FROM (SELECT *, min(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id) AS first_view FROM events)", base=False)
def dev_access_violations(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    first = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("first_view"))
    early = (F.col("event_type") == "purchase") & (F.col("first_view").isNull() | (F.col("event_id") < F.col("first_view")))
    return e.join(first, "user_id", "left").agg(F.count_if(early).alias("before_selection"))


@query("corpus_union", "SELECT source, count(*) AS n, count(DISTINCT docid) AS ids FROM (SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS docid FROM documents UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR) FROM pages UNION ALL SELECT 'conversations', conv_id || '#' || turn FROM conversations) GROUP BY 1", base=False)
def corpus_union(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    parts = {
        "documents": read("documents").select(F.col("doc_id").cast("string").alias("docid")),
        "pages": read("pages").select(F.col("page_id").cast("string").alias("docid")),
        "conversations": read("conversations").select(F.concat_ws("#", "conv_id", "turn").alias("docid")),
    }
    out = None
    for name, df in parts.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("docid").alias("ids"))
