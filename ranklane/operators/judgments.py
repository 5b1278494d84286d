"""The three-state join of runs and judgments: a missing judgment is null, never 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("relevant", "judged_non_relevant", "unjudged")


def unique_judgments(qrels: DataFrame) -> DataFrame:
    """query_id, docid, relevance_grade; a pair that is judged twice, or a negative grade, is an error when rows are computed."""
    one = qrels.groupBy("query_id", "docid").agg(F.count("*").alias("_n"), F.min("relevance_grade").alias("_g"), F.max("relevance_grade").alias("_h"))
    said = lambda x: F.raise_error(F.concat(F.lit(x + " "), F.col("query_id"), F.lit(" "), F.col("docid"))).cast("long")
    grade = F.when(F.col("_g") != F.col("_h"), said("conflicting grades of")).when(F.col("_n") > 1, said("judged twice:")).when(F.col("_g") < 0, said("negative grade of")).otherwise(F.col("_g"))
    return one.select("query_id", "docid", grade.alias("relevance_grade"))


def attach(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``run`` with grade, judgment, relevance and is_judged; as many rows as before: each pair may be judged once."""
    grade = F.col("relevance_grade")
    judged = grade.isNotNull()
    return run.join(unique_judgments(qrels), ["query_id", "docid"], "left").select(
        *[run[c] if c not in ("query_id", "docid") else F.col(c) for c in run.columns],
        grade,
        F.when(~judged, "unjudged").when(grade > 0, "relevant").otherwise("judged_non_relevant").alias("judgment"),
        F.when(judged, (grade > 0).cast("long")).alias("relevance"),
        judged.alias("is_judged"),
    )


def audit(topics: DataFrame, qrels: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each query: judgments, candidates, and how many of these (and of the first ten) are judged; shares are 0 without rows."""
    q = qrels.groupBy("query_id").agg(F.count("*").alias("qrels"), F.count_if(F.col("relevance_grade") > 0).alias("positives"), F.count_if(F.col("relevance_grade") == 0).alias("negatives"))
    top = F.col("bm25_rank") <= 10
    c = candidates.groupBy("query_id").agg(
        F.count("*").alias("retrieved"), F.count_if("is_judged").alias("judged"), F.count_if(top).alias("top"), F.count_if(F.col("is_judged") & top).alias("top_judged"),
        *[F.count_if(F.col("judgment") == s).alias(s) for s in STATES],
    )
    rows = topics.select("split", "query_id").join(q, "query_id", "left").join(c, "query_id", "left").na.fill(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.withColumns({"judged_share": share("judged", "retrieved"), "top_judged_share": share("top_judged", "top")})


def audit_summary(per_query: DataFrame) -> DataFrame:
    """The audit of each split as statistic and value, from ``audit``; four values of every distribution."""
    n = lambda c: F.sum(c).cast("double")
    spread = lambda c: {f"{c}_{k}": x for k, x in (("min", F.min(c).cast("double")), ("median", F.expr(f"percentile({c}, 0.5)")), ("p90", F.expr(f"percentile({c}, 0.9)")), ("max", F.max(c).cast("double")))}
    some = lambda cond: F.count_if(cond).cast("double")
    stats = {
        "queries": F.count("*").cast("double"), "queries_with_qrels": some(F.col("qrels") > 0), "qrels": n("qrels"), "relevant_judgments": n("positives"), "non_relevant_judgments": n("negatives"),
        "queries_without_positive": some(F.col("positives") == 0), "share_without_negative": F.avg((F.col("negatives") == 0).cast("double")),
        "candidates": n("retrieved"), **{f"candidates_{s}": n(s) for s in STATES}, "overlap_pairs": n("judged"), "positives_retrieved": n("relevant"),
        "judgment_coverage": F.avg("judged_share"), "mean_judged_at_10": F.avg("top_judged_share"), "queries_without_judged": some(F.col("judged") == 0), "retrieval_failures": some(F.col("retrieved") == 0),
        **spread("positives"), **spread("negatives"), **spread("retrieved"), **spread("judged"),
    }
    one = per_query.groupBy("split").agg(*[x.alias(k) for k, x in stats.items()])
    return one.select("split", F.explode(F.map_from_arrays(F.array(*map(F.lit, stats)), F.array(*stats))).alias("statistic", "value"))


def state_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("split", "judgment").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("n_queries"))
