"""Ranking metrics over a fixed universe of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10


def gain(grade: Column, position: Column) -> Column:
    """(2 ** grade - 1) / log2(position + 1)"""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(position + 1)


def ideal_dcg(qrels: DataFrame, k: int = K) -> DataFrame:
    """Best DCG of each query over all of its judgments, retrieved or not, and its number of positives."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance_grade"), "docid")
    best = qrels.withColumn("pos", F.row_number().over(w))
    part = F.when((F.col("pos") <= k) & (F.col("relevance_grade") > 0), gain(F.col("relevance_grade"), F.col("pos"))).otherwise(0.0)
    return best.groupBy("query_id").agg(F.sum(part).alias("idcg"), F.count_if(F.col("relevance_grade") > 0).alias("positives"))


def per_query(judged: DataFrame, qrels: DataFrame, universe: DataFrame, rank: str = "bm25_rank", *by: str) -> DataFrame:
    """Metrics of every query of ``universe``; one without hits has zeros. With ``by`` (columns of ``judged`` and
    ``universe``, such as a depth) several rankings are measured in one plan.

    ``judged`` has split, query_id, docid, ``rank``, relevance_grade and is_judged. Positions are counted after
    sorting by rank; only the reciprocal rank uses the stored rank.
    """
    keys = ["split", "query_id", *by]
    order = Window.partitionBy(*keys).orderBy(rank, "docid")
    known = Window.partitionBy(*keys, "is_judged").orderBy(rank, "docid")
    seen = judged.withColumns({"pos": F.row_number().over(order), "known_pos": F.row_number().over(known)})
    grade = F.coalesce("relevance_grade", F.lit(0))
    hit = grade > 0
    one = seen.groupBy(*keys).agg(
        F.sum(F.when((F.col("pos") <= K) & hit, gain(grade, F.col("pos"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("is_judged") & (F.col("known_pos") <= K) & hit, gain(grade, F.col("known_pos"))).otherwise(0.0)).alias("condensed_dcg"),
        F.count_if(hit & (F.col("pos") <= 100)).alias("found"),
        F.count_if(F.col("is_judged") & (F.col("pos") <= K)).alias("judged"),
        F.min(F.when(hit & (F.col(rank) <= K), F.col(rank))).alias("first_rank"),
        F.count("*").alias("retrieved"),
    )
    all_ = universe.select(*keys).join(one, keys, "left").join(ideal_dcg(qrels), "query_id", "left")
    zero = F.lit(0.0)
    over = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), zero)
    return all_.select(
        *keys,
        over("dcg", "idcg").alias("ndcg_at_10"),
        over("condensed_dcg", "idcg").alias("condensed_ndcg_at_10"),
        over("found", "positives").alias("recall_at_100"),
        F.coalesce((F.col("found") > 0).cast("double"), zero).alias("hit_at_100"),
        F.coalesce(F.col("judged") / F.lit(10.0), zero).alias("judged_at_10"),
        F.coalesce(1.0 / F.col("first_rank"), zero).alias("rr_at_10"),
        F.coalesce("retrieved", F.lit(0).cast("long")).alias("retrieved"),
        F.coalesce("positives", F.lit(0).cast("long")).alias("relevant_total"),
    )


METRICS = ("ndcg_at_10", "condensed_ndcg_at_10", "recall_at_100", "hit_at_100", "judged_at_10", "rr_at_10")


def macro(per_query_metrics: DataFrame, *by: str) -> DataFrame:
    """Arithmetic means over the universe."""
    return per_query_metrics.groupBy(*by).agg(F.count("*").alias("queries"), *[F.avg(m).alias(m) for m in METRICS])


def distribution(df: DataFrame, value: str, *by: str) -> DataFrame:
    """min, median, p90 (linear interpolation) and max; nulls without rows."""
    return df.groupBy(*by).agg(
        F.min(value).cast("double").alias("minimum"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.9)").alias("p90"), F.max(value).cast("double").alias("maximum")
    )


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """All double columns rounded, for comparison across engines."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
