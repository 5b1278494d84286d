"""First-stage retrieval: BM25 over exploded postings, and deterministic top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions.text import tokens

#: Rows that are broadcast at most (a term, or a query's term); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def query_terms(topics: DataFrame) -> DataFrame:
    """split, query_id, term: the distinct tokens of a topic's whole text."""
    return topics.select("split", "query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))


def postings(passages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """docid, dl, term, tf: the terms of ``vocabulary`` in every passage, and one row with null term for each passage.

    The collection is tokenised once. The passages are dealt by docid before, so that neither these counts nor later sums
    by docid are shuffled. A token that isn't in the vocabulary goes before anything is counted.
    """
    words = passages.repartition("docid").select("docid", tokens(F.col("text")).alias("tokens"))
    marked = words.select("docid", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
    few = vocabulary.count() <= BROADCAST_ROWS
    known = vocabulary.withColumn("known", F.lit(True))
    found = marked.join(F.broadcast(known) if few else known, "term", "left").where("known OR term IS NULL")
    return found.groupBy("docid", "dl", "term").agg(F.count("*").alias("tf"))


def bm25_scores(passages: DataFrame, terms: DataFrame, settings: dict[str, tuple[float, float]]) -> DataFrame:
    """Scores of all passages with a query's term, under each named (k1, b).

    All statistics come from the postings, which are kept (in memory or on disk) until the caller frees them. Each term's part
    is a DECIMAL, so that the sum doesn't depend on the order. Also counts a query's terms that match.
    """
    found = postings(passages, terms.select("term").distinct()).persist()
    whole = found.where("term IS NULL").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    n_docs, avgdl = whole["n_docs"], whole["avgdl"] or 1.0
    tf = found.where("term IS NOT NULL")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # one row for each term, with the queries that have it
    asked = terms.groupBy("term").agg(F.collect_list(F.struct("split", "query_id")).alias("queries"))
    weighted = asked.join(df, "term").select("term", "queries", idf.alias("idf"))
    few = terms.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda x: x)
    parts = {}
    for name, (k1, b) in settings.items():
        part = F.col("idf") * F.col("tf") / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl)))
        parts[name] = part.cast("decimal(18,9)").alias(name)  # once for each posting, not for each query
    scored = tf.join(small(weighted), "term").select("docid", *parts.values(), F.explode("queries").alias("q"))
    hits = scored.groupBy(F.col("q.split").alias("split"), F.col("q.query_id").alias("query_id"), "docid")
    total = terms.groupBy("split", "query_id").agg(F.count("*").alias("n_terms"))
    out = hits.agg(*[F.sum(k).cast("double").alias(k) for k in settings], F.count("*").alias("matched")).join(small(total), ["split", "query_id"])
    out.postings = found  # for the caller to free, once it has what it needs
    return out


def stable_top_k(scored: DataFrame, k: int, score: str = "bm25_score", rank: str = "bm25_rank") -> DataFrame:
    """The k best of each query by score descending, then docid ascending as a string, with ranks 1, 2, ..."""
    order = Window.partitionBy("split", "query_id").orderBy(F.desc(score), "docid")
    return scored.withColumn(rank, F.row_number().over(order).cast("long")).where(F.col(rank) <= k)


def depth_per_query(topics: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """Candidates and shortfall of every topic, those without hits included."""
    counts = run.groupBy("split", "query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return topics.select("split", "query_id").join(counts, ["split", "query_id"], "left").select("split", "query_id", n.alias("candidate_count"), F.greatest(F.lit(k).cast("long") - n, F.lit(0).cast("long")).alias("shortfall"))


def depth_summary(per_query: DataFrame, k: int) -> DataFrame:
    c = F.col("candidate_count")
    return per_query.groupBy("split").agg(
        F.count("*").alias("topics"),
        F.count_if(c >= k).alias("full"),
        F.count_if((c > 0) & (c < k)).alias("short"),
        F.count_if(c == 0).alias("zero_hit"),
        F.min(c).alias("min_count"),
        F.max(c).alias("max_count"),
        F.sum("shortfall").alias("total_shortfall"),
    )
