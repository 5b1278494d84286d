"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing ASCII letters only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Bounds the Arrow batches sent to Python by rows and, where Spark can, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    except Exception:  # noqa: BLE001  an older Spark has no such setting
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset, as in tests, is a
    temporary folder made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ranklane-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Bytes of input for each partition of a shuffle that carries texts or records of them.
PARTITION_BYTES = 16 << 20


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system, at the end of a task: the worker lives on for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def stated_bytes(df: DataFrame) -> int | None:
    """Bytes of the input of ``df`` as its plan states them (files, compressed); None where it doesn't know."""
    stated = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return stated if stated < 1 << 60 else None


def partitions_for(df: DataFrame, size: int = PARTITION_BYTES) -> int:
    """Partitions of a shuffle of ``df``: the session's number, or more where its input asks for them."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (stated_bytes(df) or 0) // size)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again.

    That cuts the lineage: a lost executor costs a re-read, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ranklane-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path is not None:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text only, so that the scan reads two columns whatever else ``docs`` has."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``ids`` (the same column); rows without key stay.

    The ids are written once and counted: up to BROADCAST_IDS they are broadcast (about 40 MB at most), more go through a
    shuffled join.
    """
    own = materialize(ids.where(F.col(key).isNotNull()).distinct(), "ids")
    few = own.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(own) if few else own, key, "left_anti").select(*docs.columns)
