"""Pair encoding, scoring, batches and losses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LENGTH = 320


def char_ids(text: Column) -> Column:
    """10 + code point mod 211 of every character."""
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: (F.lit(10) + F.ascii(c) % 211).cast("int")))


def encode_pair(df: DataFrame, query: str, document: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """Adds input_ids ([0] query [2, 2] document [2]), tokens_before, tokens_after, truncated; only the document is cut."""
    n_query, n_document = F.length(query), F.length(document)
    room = F.greatest(F.lit(max_length) - n_query - 4, F.lit(0))
    # the document is cut as text, so that only what stays is split into characters
    kept = char_ids(F.substring(F.col(document), F.lit(1), room))
    ids = F.concat(F.array(F.lit(0)), char_ids(F.col(query)), F.array(F.lit(2), F.lit(2)), kept, F.array(F.lit(2)))
    before, after = n_query + n_document + 4, n_query + F.least(n_document, room) + 4
    return df.withColumns({"input_ids": ids, "tokens_before": before, "tokens_after": after, "truncated": after < before})


Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def lexical_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The default scorer: share of the query's distinct words that the document has."""
    for pdf in batches:
        score = [len((q := set(a.lower().split())) & set(b.lower().split())) / max(1, len(q)) for a, b in zip(pdf["query_text"], pdf["document"], strict=True)]
        yield pdf.assign(score=pd.Series(score, dtype="float32"))[["query_id", "docid", "score"]]


def checked(scorer: Scorer) -> Scorer:
    """``scorer``, failing its task if it gives back another number of rows than it took, or a score that isn't finite."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = given = 0

        def counted():
            nonlocal taken
            for pdf in batches:
                taken += len(pdf)
                yield pdf

        for out in scorer(counted()):
            score = out["score"].to_numpy("float32")
            if not np.isfinite(score).all():
                raise ValueError("a score isn't finite")
            given += len(out)
            yield out.assign(score=score)
        if given != taken:
            raise ValueError(f"{given} scores of {taken} pairs")

    return run


def score_pairs(pairs: DataFrame, scorer: Scorer = lexical_scorer) -> DataFrame:
    """query_id, docid, score by an injected scorer over Arrow batches, partitioned by query and sorted by length; finite, one of each pair."""
    shaped = pairs.select("query_id", "docid", "query_text", "document")
    ordered = shaped.repartition("query_id").sortWithinPartitions(F.length("document"), "docid")
    return ordered.mapInPandas(checked(scorer), "query_id string, docid string, score float")


def sequences_once(pairs: DataFrame, most: int = 40) -> DataFrame:
    """Each distinct document of a query's pairs once, as split, query_id, docid; more than ``most`` of a query are an error when
    rows are computed."""
    both = pairs.select("split", "query_id", F.explode(F.array("positive_docid", "negative_docid")).alias("docid")).distinct()
    n = F.count("*").over(Window.partitionBy("split", "query_id"))
    said = F.raise_error(F.concat(F.lit("too many sequences of query "), F.col("query_id"))).cast("string")
    return both.withColumn("n", n).select("split", "query_id", F.when(F.col("n") > most, said).otherwise(F.col("docid")).alias("docid"))


def length_batches(df: DataFrame, size: int = 64) -> DataFrame:
    """Batches of ``size`` by (tokens_after, docid) within a query shard, and the tokens they cost with padding."""
    w = Window.partitionBy("shard").orderBy("tokens_after", "query_id", "docid")
    batch = F.floor((F.row_number().over(w) - 1) / size).cast("long")
    per = df.withColumn("batch", batch).groupBy("shard", "batch").agg(F.count("*").alias("n"), F.max("tokens_after").alias("longest"), F.sum("tokens_after").alias("tokens"))
    return per.withColumn("processed", F.col("n") * F.col("longest"))


def query_shards(queries: DataFrame, size: int = 64) -> DataFrame:
    """Sorted distinct ids in chunks of ``size``; one window over the distinct ids only."""
    return queries.select("query_id").distinct().withColumn("shard", F.floor((F.row_number().over(Window.orderBy("query_id")) - 1) / size).cast("long"))


def accounting(df: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    p = lambda q: F.expr(f"percentile(tokens_before, {q})")
    return df.agg(
        F.count("*").alias("n_rows"), F.avg(F.col("truncated").cast("double")).alias("truncated_fraction"), F.sum("tokens_before").alias("total_before"), F.sum("tokens_after").alias("total_after"),
        (F.count("*") * max_length).alias("upper_bound"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("tokens_before").cast("long").alias("longest"),
    )


def pair_loss(positive: Column, negative: Column) -> Column:
    """softplus(negative - positive), stable for large differences."""
    x = negative - positive
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def query_losses(pairs: DataFrame) -> DataFrame:
    """Weighted mean loss of each query's pairs (s_pos, s_neg, pair_weight)."""
    loss, weight = pair_loss(F.col("s_pos").cast("double"), F.col("s_neg").cast("double")), F.col("pair_weight").cast("double")
    return pairs.groupBy("split", "query_id").agg((F.sum(loss * weight) / F.sum(weight)).alias("loss"), F.count("*").alias("n_pairs"))


def windows(queries: DataFrame, seed: int, epoch: int, size: int = 16) -> DataFrame:
    """Seeded order of an epoch's queries in accumulation windows; the last may be short."""
    key = F.sha2(F.concat_ws("|", F.lit(str(seed + epoch)), "query_id"), 256)
    place = F.row_number().over(Window.orderBy(key, "query_id"))
    return queries.select("query_id").distinct().withColumn("place", place.cast("long")).withColumn("window", F.floor((F.col("place") - 1) / size).cast("long"))
