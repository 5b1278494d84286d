"""Diagnostics of rankings: ties, sparse judgments, oracle strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions.text import close

STRATA = ("improvable", "already_at_oracle", "no_relevant_in_candidates")


def tie_groups(scored: DataFrame, score: str = "score") -> DataFrame:
    """Groups of equal scores within a query, with their first and last rank."""
    w = Window.partitionBy("split", "query_id").orderBy(F.desc(score), "docid")
    ranked = scored.withColumns({"pos": F.row_number().over(w), "value": F.col(score) + F.lit(0).cast("float")})
    groups = ranked.groupBy("split", "query_id", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_if(F.col("pos") <= 10).alias("in_top10"))
    return groups.where("n > 1")


def tie_statistics(scored: DataFrame, score: str = "score") -> DataFrame:
    g = tie_groups(scored, score)
    return g.groupBy("split").agg(
        F.count("*").alias("tie_groups"),
        F.sum("n").alias("tied_rows"),
        F.countDistinct("query_id").alias("queries_with_ties"),
        F.countDistinct(F.when(F.col("in_top10") >= 2, F.col("query_id"))).alias("queries_tied_in_top10"),
        F.count_if((F.col("first") <= 10) & (F.col("last") > 10)).alias("crossing_rank_10"),
        F.max("n").alias("largest"),
        F.sum(F.col("n") - 1).alias("surplus_rows"),
    )


def sparse_per_query(candidates: DataFrame, universe: DataFrame, rank: str = "bm25_rank") -> DataFrame:
    """Unjudged in the top 10 (10 for a query without ranking), and inversions: pairs of an unjudged one there and a relevant one below."""
    w = Window.partitionBy("split", "query_id").orderBy(rank, "docid")
    relevant = (F.col("judgment") == "relevant").cast("long")
    below = F.coalesce(F.sum(relevant).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    seen = candidates.withColumns({"pos": F.row_number().over(w), "below": below})
    top = (F.col("pos") <= 10) & (F.col("judgment") == "unjudged")
    one = seen.groupBy("split", "query_id").agg(
        F.count_if(top).alias("unjudged"),
        F.sum(F.when(top, F.col("below")).otherwise(0)).alias("inversions"),
        F.max(F.col("is_judged").cast("int")).alias("judged"),
        F.max(relevant).alias("relevant"),
    )
    zero = F.lit(0).cast("long")
    return universe.select("split", "query_id").join(one, ["split", "query_id"], "left").select(
        "split",
        "query_id",
        F.coalesce("unjudged", F.lit(10).cast("long")).alias("unjudged_in_top10"),
        F.coalesce("inversions", zero).alias("inversions"),
        (F.coalesce("judged", F.lit(0)) > 0).alias("has_judged"),
        (F.coalesce("relevant", zero) > 0).alias("has_relevant"),
    )


def sparse_summary(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("split").agg(
        F.count("*").alias("queries"),
        F.avg("unjudged_in_top10").alias("mean_unjudged"),
        F.sum("inversions").alias("inversion_pairs"),
        F.count_if(F.col("inversions") > 0).alias("queries_with_inversions"),
        F.count_if(~F.col("has_judged")).alias("queries_without_judged"),
        F.count_if(~F.col("has_relevant")).alias("queries_without_relevant"),
        F.avg(F.when(F.col("has_judged"), F.col("unjudged_in_top10"))).alias("mean_unjudged_where_judged"),
    )


def strata(baseline: DataFrame, best: DataFrame, has_relevant: DataFrame) -> DataFrame:
    """Each query's stratum by how its nDCG compares with the best order of its candidates, at full precision.

    ``baseline`` and ``best`` have split, query_id and ndcg_at_10; ``has_relevant`` split, query_id, has_relevant.
    """
    a = baseline.select("split", "query_id", F.col("ndcg_at_10").alias("baseline"))
    b = best.select("split", "query_id", F.col("ndcg_at_10").alias("oracle"))
    joined = a.join(b, ["split", "query_id"]).join(has_relevant.select("split", "query_id", "has_relevant"), ["split", "query_id"])
    label = F.when(~F.col("has_relevant"), STRATA[2]).when(close(F.col("baseline"), F.col("oracle")), STRATA[1]).otherwise(STRATA[0])
    return joined.select("split", "query_id", "baseline", "oracle", label.alias("stratum"))


def stratified_delta(placed: DataFrame, system: DataFrame) -> DataFrame:
    """Queries and mean difference to the baseline in every stratum, 0 in an empty one."""
    spark = placed.sparkSession
    delta = placed.join(system.select("split", "query_id", F.col("ndcg_at_10").alias("system")), ["split", "query_id"])
    found = delta.groupBy("stratum").agg(F.count("*").alias("queries"), F.avg(F.col("system") - F.col("baseline")).alias("mean_delta"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, STRATA))).alias("stratum"))
    return every.join(found, "stratum", "left").select("stratum", F.coalesce("queries", F.lit(0).cast("long")).alias("queries"), F.coalesce("mean_delta", F.lit(0.0)).alias("mean_delta"))
