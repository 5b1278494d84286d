"""Rankings of a fixed candidate set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTHS = (10, 20, 50, 100)


def rank_by(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("split", "query_id").orderBy(*order)).cast("long"))


def by_score(df: DataFrame, score: str = "score", docid_ascending: bool = True) -> DataFrame:
    """Score descending, then docid ascending (or descending) as a string."""
    return rank_by(df, F.desc(score), F.asc("docid") if docid_ascending else F.desc("docid"))


def candidates_by_score(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """``candidates`` (split, query_id, docid, ...) with score, ranked by it. A pair that only one side has, or that is scored
    twice, or a score that isn't finite, is an error when rows are computed."""
    keys = ["query_id", "docid"]
    one = scores.groupBy(*keys).agg(F.count("*").alias("_n"), F.first("score").alias("score"))
    both = candidates.withColumn("_c", F.lit(True)).join(one, keys, "full_outer")
    bad = (
        F.when(F.col("_c").isNull(), "scored but no candidate: ").when(F.col("_n").isNull(), "candidate without score: ").when(F.col("_n") > 1, "scored twice: ")
        .when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), "score isn't finite: ")
    )
    said = F.raise_error(F.concat(bad, F.col("query_id"), F.lit(" "), F.col("docid"))).cast("float")
    return by_score(both.withColumn("score", F.when(bad.isNotNull(), said).otherwise(F.col("score"))).drop("_c", "_n"))


def at_depth(df: DataFrame, depth: int) -> DataFrame:
    """Only the first ``depth`` by bm25_rank are re-sorted by score; the tail keeps its order."""
    head = F.col("bm25_rank") <= depth
    return rank_by(df, (~head).cast("int"), F.when(head, F.col("score")).desc_nulls_last(), F.when(~head, F.col("bm25_rank")), F.asc("docid"))


def at_depths(df: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """The rankings of all ``depths`` (column depth) in one plan: the depth is part of the partition key."""
    deep = df.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    head = F.col("bm25_rank") <= F.col("depth")
    w = Window.partitionBy("split", "query_id", "depth").orderBy((~head).cast("int"), F.when(head, F.col("score")).desc_nulls_last(), F.when(~head, F.col("bm25_rank")), F.asc("docid"))
    return deep.withColumn("rank", F.row_number().over(w).cast("long"))


def oracle(candidates: DataFrame, rank: str = "bm25_rank") -> DataFrame:
    """Relevant ones first, then the source's order."""
    return rank_by(candidates, F.desc(F.col("judgment") == "relevant"), F.asc(rank), F.asc("docid"), name="oracle_rank")


def trec_lines(run: DataFrame, tag: str, rank: str = "bm25_rank", score: str = "bm25_score") -> DataFrame:
    """``query Q0 docid rank score tag`` with eight decimals, halves rounded up."""
    return run.select("split", "query_id", rank, F.format_string("%s Q0 %s %d %s %s", "query_id", "docid", rank, F.col(score).cast("decimal(28,9)").cast("decimal(28,8)").cast("string"), F.lit(tag)).alias("line"))


def rank_preserving(run: DataFrame, tag: str, rank: str = "rank") -> DataFrame:
    """Lines whose score is 1000000 - rank, so that any reader sorts them alike."""
    return run.select("split", "query_id", rank, F.format_string("%s Q0 %s %d %.4f %s", "query_id", "docid", rank, (F.lit(1000000) - F.col(rank)).cast("double"), F.lit(tag)).alias("line"))


def rank_preserving_violations(run: DataFrame, rank: str = "rank", score: str = "trec_score") -> DataFrame:
    """Per split: scores that don't fall from rank to rank, or aren't 1000000 - rank."""
    w = Window.partitionBy("split", "query_id").orderBy(rank)
    checked = run.withColumn("before", F.lag(score).over(w))
    return checked.groupBy("split").agg(F.count_if(F.col("before") <= F.col(score)).alias("not_falling"), F.count_if(F.col(score) != 1000000 - F.col(rank)).alias("not_rank"))
