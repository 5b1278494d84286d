"""The synthetic tables seen as a retrieval collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklane.operators import judgments, retrieval

TOP_K = 100
#: Items that are broadcast at most.
BROADCAST_ITEMS = 200_000
SETTINGS = {"bm25_score": (0.9, 0.4), "score_c": (1.2, 0.75)}
_hits: dict[tuple[str, str], DataFrame] = {}


def passages(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("docid"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("item_id") % 4 == 0, "dev").otherwise("train")
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(split.alias("split"), F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text"))


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic judgments: of each label the items of one residue. Items are broadcast up to BROADCAST_ITEMS, else joined by a shuffle."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.pmod(-F.col("item_id"), F.lit(3)).alias("r"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", F.pmod("doc_id", F.lit(3)).alias("r"))
    grade = F.when((F.col("quality") == 1) & ((F.col("doc_id") * 7 + F.col("item_id")) % 5 == 0), 1).otherwise(0).cast("long")
    few = items.count() <= BROADCAST_ITEMS
    return labels.join(F.broadcast(items) if few else items, "r").select(F.col("item_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("docid"), grade.alias("relevance_grade"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """The top 100 with both systems' scores; kept in memory, as nearly all queries start from it, until ``release``."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _hits:
        docs = passages(spark, sf)
        slots = spark.sparkContext.defaultParallelism
        if len(docs.inputFiles()) < slots:  # one row group is one task otherwise
            docs = docs.repartition(slots)
        scored = retrieval.bm25_scores(docs, retrieval.query_terms(topics(spark, sf)), SETTINGS)
        _hits[key] = retrieval.stable_top_k(scored, TOP_K).persist()
        _hits[key].count()
        scored.postings.unpersist()  # a lost executor costs reading them again
    return _hits[key]


def release() -> None:
    """Frees the runs that are kept."""
    for df in _hits.values():
        df.unpersist()
    _hits.clear()


def run(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf).select("split", "query_id", "docid", "bm25_rank", "bm25_score")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return judgments.attach(run(spark, sf), qrels(spark, sf))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical scorer: matched share of the query's terms, as float32 with many exact ties."""
    return hits(spark, sf).select("split", "query_id", "docid", (F.col("matched") / F.col("n_terms")).cast("float").alias("score"))


def ranking(spark: SparkSession, sf: str, system: str) -> DataFrame:
    """query_id, docid, rank under system ``bm25``, ``lexical`` or ``c``, over the same candidates."""
    h = hits(spark, sf)
    if system == "bm25":
        return h.select("split", "query_id", "docid", F.col("bm25_rank").alias("rank"))
    score = (F.col("matched") / F.col("n_terms")).cast("float") if system == "lexical" else F.col("score_c")
    order = Window.partitionBy("split", "query_id").orderBy(score.desc(), "docid")
    return h.select("split", "query_id", "docid", F.row_number().over(order).cast("long").alias("rank"))
