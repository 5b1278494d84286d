"""Topics, judgments, runs and candidate tables from files, and sinks."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklane.functions.text import is_blank
from ranklane.plans import schemas


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~is_blank(F.col("value")))


def read_topics(spark: SparkSession, path: str, split: str, expected: int | None = None) -> DataFrame:
    """split, query_id, query_text of a two-column TSV without header or quoting; ``NA`` stays text."""
    parts = F.split("value", "\t", 2)
    out = _lines(spark, path).select(F.lit(split).alias("split"), F.get(parts, F.lit(0)).alias("query_id"), F.get(parts, F.lit(1)).alias("query_text"))
    found = out.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("ids"), F.count_if(is_blank(F.col("query_id")) | is_blank(F.col("query_text"))).alias("blank")).first()
    if found["blank"] or found["n"] != found["ids"] or expected not in (None, found["n"]):
        raise ValueError(f"{path}: {found['n']} topics, {found['ids']} ids, {found['blank']} blank; expected {expected}")
    return out


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, iteration, docid, relevance_grade of a four-column file; grades are 0 or 1."""
    parts = F.split(F.trim("value"), r"\s+")
    out = _lines(spark, path).select(
        F.get(parts, F.lit(0)).alias("query_id"), F.get(parts, F.lit(1)).alias("iteration"), F.get(parts, F.lit(2)).alias("docid"), F.get(parts, F.lit(3)).try_cast("long").alias("relevance_grade"), F.size(parts).alias("fields")
    )
    bad = out.where("fields <> 4 OR relevance_grade IS NULL OR relevance_grade NOT IN (0, 1)").count()
    if bad:
        raise ValueError(f"{path}: {bad} bad judgments")
    return out.drop("fields")


def read_trec_run(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A run of six white-space separated fields; the ranks of a query are 1, 2, ... without gaps, scores finite, pairs unique."""
    parts = F.split(F.trim("value"), r"\s+")
    at = lambda k: F.get(parts, F.lit(k))
    out = _lines(spark, path).select(F.lit(split).alias("split"), at(0).alias("query_id"), at(2).alias("docid"), at(3).try_cast("long").alias("bm25_rank"), at(4).try_cast("double").alias("bm25_score"), F.size(parts).alias("fields"))
    s = F.col("bm25_score")
    bad = out.where((F.col("fields") != 6) | F.col("bm25_rank").isNull() | (F.col("bm25_rank") < 1) | s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).count()
    if bad:
        raise ValueError(f"{path}: {bad} bad lines")
    per = out.groupBy("query_id").agg(F.count("*").alias("n"), F.max("bm25_rank").alias("high"), F.countDistinct("bm25_rank").alias("ranks"), F.countDistinct("docid").alias("ids"))
    gaps = [r["query_id"] for r in per.where("high <> n OR ranks <> n OR ids <> n").orderBy("query_id").limit(10).collect()]
    if gaps:
        raise ValueError(f"{path}: ranks with gaps or repeats, or repeated documents, of {', '.join(gaps)}")
    return out.drop("fields")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """metric, query_id, value of a three-column metric report; exactly one finite ``all`` of each metric."""
    parts = F.split(F.trim("value"), r"\s+")
    out = _lines(spark, path).select(F.get(parts, F.lit(0)).alias("metric"), F.get(parts, F.lit(1)).alias("query_id"), F.get(parts, F.lit(2)).try_cast("double").alias("value"))
    bad = out.groupBy("metric").agg(F.count_if((F.col("query_id") == "all") & F.col("value").isNotNull() & ~F.isnan("value")).alias("n")).where("n <> 1").count()
    if bad:
        raise ValueError(f"{path}: {bad} metrics without exactly one finite total")
    return out


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Parquet (.parquet, .pq), CSV, or tab-separated (.tsv, .txt) by the suffix."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if kind in (".csv", ".tsv", ".txt"):
        return spark.read.schema(schemas.CANDIDATES).csv(path, sep="," if kind == ".csv" else "\t", header=True)
    raise ValueError(f"unknown table format: {path}")


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """A text file per partition, in global order."""
    lines.orderBy(*order).select("line").write.mode("errorifexists").text(path)


def qrels_lines(qrels: DataFrame) -> DataFrame:
    """Judgments as ``query 0 docid grade``, one line each, for ``write_lines``."""
    return qrels.select("query_id", "docid", F.format_string("%s 0 %s %d", "query_id", "docid", "relevance_grade").alias("line"))


def publish(df: DataFrame, path: str) -> int:
    """Parquet with zstd beside ``path``, read back, and moved into place only if schema and rows agree; what stood there
    is put aside first and comes back if the move fails."""
    spark = df.sparkSession
    temp = f"{path}.part"
    df.write.mode("overwrite").option("compression", "zstd").parquet(temp)
    back = spark.read.parquet(temp)
    if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError("schema changed on the way")
    n = back.count()
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs.delete(aside, True)
    had = fs.exists(place) and fs.rename(place, aside)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(temp), place):
        if had:
            fs.rename(aside, place)
        raise OSError(f"can't move {temp} to {path}")
    fs.delete(aside, True)
    return n


def write_json(value, path: str) -> None:
    """A small report on the driver: written beside, parsed back, moved into place."""
    folder = os.path.dirname(path) or "."
    handle, temp = tempfile.mkstemp(dir=folder, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True, indent=1)
        f.flush()
        os.fsync(f.fileno())
    with open(temp, encoding="utf-8") as f:
        json.load(f)
    os.replace(temp, path)
