"""Corpus shards: gzip JSON lines with string ids, and passages by id."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklane.functions.text import is_blank

SHARD = r"docs-(\d+)\.jsonl(?:\.gz)?$"


def shard_index(path):
    """The number in a shard's name; shards sort by it, not by name."""
    return F.regexp_extract(path, SHARD, 1).cast("int")


def local_shards(spark: SparkSession, folder: str, expected: dict[str, int] | None = None) -> list[str]:
    """Paths of the shards of a folder (any file system that Spark reads) in the order of their numbers.

    With ``expected`` (name -> bytes) a missing shard, another one, or another size is an error. Another source of shards
    is a function with the same result.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {x.getPath().getName(): (x.getPath().toString(), x.getLen()) for x in fs.listStatus(place) if re.search(SHARD, x.getPath().getName())}
    if expected is not None:
        bad = sorted(set(expected) - set(found)) + sorted(set(found) - set(expected)) + [f"{k} of {found[k][1]} bytes" for k in sorted(set(found) & set(expected)) if found[k][1] != expected[k]]
        if bad:
            raise ValueError("missing, unknown or changed shards: " + ", ".join(bad))
    return [found[k][0] for k in sorted(found, key=lambda k: int(re.search(SHARD, k)[1]))]


def parsed(lines: DataFrame) -> DataFrame:
    """shard, docid, title, text and ``problem`` (null: valid) of lines (shard, value).

    Ids that aren't JSON strings are found by the raw value's type, as plain parsing would turn numbers to strings.
    """
    typed = lines.withColumn("v", F.expr("try_parse_json(value)"))
    kind = lambda f: F.expr(f"schema_of_variant(try_variant_get(v, '$.{f}', 'variant'))")
    field = lambda f: F.expr(f"try_variant_get(v, '$.{f}', 'string')")
    fields = ("docid", "title", "text")
    out = typed.select("shard", F.col("v").isNull().alias("broken"), *[field(f).alias(f) for f in fields], *[kind(f).alias("k_" + f) for f in fields])
    problem = (
        F.when(F.col("broken"), "not JSON")
        .when(F.coalesce(F.col("k_docid"), F.lit("")) != "STRING", "docid is not a string")
        .when(is_blank(F.col("docid")), "docid is blank")
        .when(~F.coalesce(F.col("k_title"), F.lit("VOID")).isin("STRING", "VOID"), "title is not a string")
        .when(F.coalesce(F.col("k_text"), F.lit("")) != "STRING", "text is not a string")
    )
    return out.select("shard", "docid", F.coalesce("title", F.lit("")).alias("title"), "text", problem.alias("problem"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All lines that aren't blank, as ``parsed`` has them. A gzip file is one task; what follows is dealt anew by the
    caller where it matters."""
    return parsed(spark.read.text(path).select("value", shard_index(F.col("_metadata.file_path")).alias("shard")).where(~is_blank(F.col("value"))))


def valid_passages(parsed: DataFrame, examples: int = 10) -> DataFrame:
    """The passages, after an error that names the first problems if there are any."""
    bad = parsed.where("problem IS NOT NULL").select("shard", "docid", "problem").limit(examples).collect()
    if bad:
        raise ValueError("; ".join(f"shard {r['shard']}, {r['docid']!r}: {r['problem']}" for r in bad))
    return parsed.select("docid", "title", "text")


def passages_by_id(passages: DataFrame, wanted: DataFrame, candidates: DataFrame | None = None, examples: int = 10) -> DataFrame:
    """The passages with a wanted docid. Missing or repeated ids and blank texts are errors."""
    own = passages.join(wanted.select("docid").distinct(), "docid", "left_semi")
    missing = wanted.select("docid").distinct().join(passages.select("docid"), "docid", "left_anti").orderBy("docid").limit(examples)
    lost = [r["docid"] for r in missing.collect()]
    if lost:
        where = ""
        if candidates is not None:
            where = "; " + ", ".join(f"{r['docid']} of query {r['query_id']}" for r in locations(candidates.where(F.col("docid").isin(lost)), passages, 3).limit(examples).collect())
        raise ValueError(f"missing passages: {', '.join(lost)}{where}")
    found = own.agg(F.count("*").alias("n"), F.countDistinct("docid").alias("ids"), F.count_if(is_blank(F.col("text"))).alias("blank")).first()
    if found["n"] != found["ids"]:
        raise ValueError(f"{found['n'] - found['ids']} repeated docids")
    if found["blank"]:
        raise ValueError(f"{found['blank']} blank texts")
    return own


def consistent_passages(rows: DataFrame) -> DataFrame:
    """Distinct passages; the same docid with other content is an error."""
    bad = rows.groupBy("docid").agg(F.countDistinct(F.struct("title", "text")).alias("n")).where("n > 1").limit(10).collect()
    if bad:
        raise ValueError("conflicting content: " + ", ".join(r["docid"] for r in bad))
    return rows.dropDuplicates(["docid"])


def locations(candidates: DataFrame, passages: DataFrame, most: int = 3) -> DataFrame:
    """docid, query_id, n: where candidates without a passage stand, up to ``most`` places each."""
    lost = candidates.join(passages.select("docid").distinct(), "docid", "left_anti")
    n = F.row_number().over(Window.partitionBy("docid").orderBy("split", "query_id"))
    return lost.select("docid", "query_id", n.cast("long").alias("n")).where(F.col("n") <= most)
