"""Corpus preparation: documents to packed training sequences.

Each stage applies one operator to all that its predecessor kept; between stages the rows are written as Parquet.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklane.llm import exact_dedup, ngram_join, packing, quality_rules, substring_dedup
from ranklane.llm.common import discard, materialize, without_ids

#: The near-duplicate stage: words of a shingle, and percent of similarity.
WORDS, PERCENT = 5, 80
#: Column of a row's own id while its number stands in for it.
OWN_ID = "__own_doc_id"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects; none for its length alone."""
    return quality_rules.keep_good(docs, quality_rules.PIPELINE_RULES)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the largest doc_id, of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def by_row(docs: DataFrame) -> DataFrame:
    """``docs``; where a doc_id repeats, with a number of each row, in the order of doc_id, in its place and the id beside it."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if not repeated.limit(1).count():
        return docs
    row = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    return materialize(docs.orderBy("doc_id", "text").withColumns({OWN_ID: F.col("doc_id"), "doc_id": row}), "rows")


def by_id(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with their own doc_id again."""
    own = rows.drop("doc_id").withColumnRenamed(OWN_ID, "doc_id") if OWN_ID in rows.columns else rows
    return own.select(*columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each component of near duplicates."""
    rows = by_row(docs)
    groups = ngram_join.similar_groups(rows, WORDS, PERCENT)
    return by_id(without_ids(rows, groups.where("component_id <> doc_id").select("doc_id")), docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts; a document of which nothing is left goes.

    A null or blank text has no passages and stays. ``n_chars`` of a changed text is counted anew; every other column, whatever its
    name, is kept as it is. Of equal passages the first, by doc_id and place, stays.
    """
    rows = by_row(docs)
    out = substring_dedup.cleaned(rows).where("removed = 0 OR length(body) > 0")
    own = {c: F.col("own")[c] for c in rows.columns if c != "text"} | {"text": F.col("body")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("removed") > 0, F.length("body").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return by_id(out.select(*[own[c].alias(c) for c in rows.columns]), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("substring_dedup", repeats),
    ("best_fit_packing", pack),
]

#: SQL can express neither the sentence spans nor the tokenizer of the last stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
