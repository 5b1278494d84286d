"""Data-quality checks: every predicate of a table in one aggregate, duplicates in one more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklane.functions.text import is_blank


def violations(df: DataFrame, checks: dict[str, Column], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """check, violations: rows for which a check's predicate holds, and surplus rows of each key."""
    names = list(checks)
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    out = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("check", "violations")) if names else None
    for name, cols in (keys or {}).items():
        extra = df.groupBy(*cols).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = extra if out is None else out.unionByName(extra)
    return out


def assert_clean(report: DataFrame) -> None:
    """Raises on any violation; a report has one row for each check."""
    bad = report.where("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))


def candidate_checks() -> dict[str, Column]:
    """The state machine of judged candidates, and the domains of ids, ranks and scores."""
    grade, rel, judged, state = (F.col(c) for c in ("relevance_grade", "relevance", "is_judged", "judgment"))
    score = F.col("bm25_score")
    return {
        "blank_query_id": is_blank(F.col("query_id")),
        "blank_docid": is_blank(F.col("docid")),
        "bad_rank": F.col("bm25_rank").isNull() | (F.col("bm25_rank") < 1),
        "bad_score": score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")),
        "bad_state": ~state.isin("relevant", "judged_non_relevant", "unjudged"),
        "bad_grade": grade < 0,
        "relevant_state": (state == "relevant") & ~F.coalesce((grade > 0) & (rel == 1) & judged, F.lit(False)),
        "non_relevant_state": (state == "judged_non_relevant") & ~F.coalesce((grade == 0) & (rel == 0) & judged, F.lit(False)),
        "unjudged_state": (state == "unjudged") & (grade.isNotNull() | rel.isNotNull() | judged),
    }


def score_checks(max_length: int) -> dict[str, Column]:
    score = F.col("score")
    return {
        "null_score": score.isNull(),
        "not_finite": F.isnan(score) | (F.abs(score) == float("inf")),
        "blank_docid": is_blank(F.col("docid")),
        "bad_tokens": (F.col("tokens_after") < 1) | (F.col("tokens_after") > max_length) | (F.col("tokens_after") > F.col("tokens_before")),
        "bad_truncated": F.col("truncated") != (F.col("tokens_after") < F.col("tokens_before")),
    }


def rank_gaps(run: DataFrame, k: int, exact: bool = False, rank: str = "bm25_rank") -> DataFrame:
    """Per query: whether ranks are 1..n without gaps, and n is at most (or exactly) k."""
    n, low, high, distinct = F.count("*"), F.min(rank), F.max(rank), F.countDistinct(rank)
    ok = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("distinct_ranks") == F.col("n"))
    ok = ok & ((F.col("n") == k) if exact else (F.col("n") <= k))
    return run.groupBy("split", "query_id").agg(n.alias("n"), low.alias("low"), high.alias("high"), distinct.alias("distinct_ranks")).withColumn("valid", ok)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage_gaps(topics: DataFrame, run: DataFrame) -> DataFrame:
    """Topics without hits, and hits without topic."""
    a, b = topics.select("split", "query_id").distinct(), run.select("split", "query_id").distinct()
    keys = ["split", "query_id"]
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("topic_without_hits")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("hits_without_topic")))


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: sizes, what only one side has, queries, and whether both are equal."""
    a, b = left.select(*keys).distinct().withColumn("in_left", F.lit(1)), right.select(*keys).distinct().withColumn("in_right", F.lit(1))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.count("in_left").alias("left_count"),
        F.count("in_right").alias("right_count"),
        F.count_if(F.col("in_right").isNull()).alias("only_left"),
        F.count_if(F.col("in_left").isNull()).alias("only_right"),
        F.countDistinct("query_id").alias("query_count"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def annotation_violations(topics: DataFrame, qrels: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Checks of given annotations: the numbers of topics and judgments, duplicates, the domain of grades, judgments of no topic."""
    t = violations(topics, {"blank_topic": is_blank(F.col("query_text"))}, {"duplicate_topic": ["query_id"]})
    q = violations(qrels, {"grade": F.col("relevance_grade").isNull() | ~F.col("relevance_grade").isin(0, 1)}, {"duplicate_judgment": ["query_id", "docid"]})
    lost = qrels.join(topics.select("query_id"), "query_id", "left_anti").agg(F.count("*").alias("violations")).select(F.lit("unknown_topic").alias("check"), "violations")
    n = lambda df, name: df.agg(F.abs(F.count("*") - expected[name]).alias("violations")).select(F.lit(f"{name}_count").alias("check"), "violations")
    return t.unionByName(q).unionByName(lost).unionByName(n(topics, "topics")).unionByName(n(qrels, "judgments"))
