"""Exact deduplication by Grace hashing.

Records (content, id, count) of one task go into an open-addressing table that compares complete
contents; equal ones are merged there. When the distinct contents exceed the table's budget, all records
are dealt by further hash bits to spill files, and each file is treated the same way, until every
bucket fits. The files lie in the task's own scratch folder and go with it.

The table runs twice: over each scan partition, so that a text with a third of all rows leaves at
most one record per partition, and, after a shuffle by digest, over those records.

Texts are equal when identical after lower-casing A-Z only; null text is empty text. Of equal rows the
largest id stays; a null id is below every other. Rows that agree in text and id are kept or dropped together,
and count as often as they occur. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import LOWER, UPPER, bounded_batches, keyed_text, materialize, without_ids

#: Bytes of distinct content that a table may hold before its records are spilled.
TABLE_BYTES = 192 << 20
#: Spill files of one level, and the levels after which hash bits are used up.
FAN_OUT, LEVELS = 16, 15


class OpenTable:
    """Open addressing with linear probing; entries are equal only if their complete contents are."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, h: int, content: bytes, doc_id: int | None, count: int) -> None:
        mask, slots = len(self.slots) - 1, self.slots
        i = (h ^ h >> 29) & mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                self.counts[e] += count
                if doc_id is not None and (self.ids[e] is None or doc_id > self.ids[e]):
                    self.ids[e] = doc_id
                return
            i = (i + 1) & mask
        slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.ids.append(doc_id)
        self.counts.append(count)
        self.size += len(content) + 200
        if 2 * len(self.hashes) > len(slots):
            self._grow()

    def _grow(self) -> None:
        n = 4 * len(self.slots)
        slots = [-1] * n
        for e, h in enumerate(self.hashes):
            i = (h ^ h >> 29) & (n - 1)
            while slots[i] >= 0:
                i = (i + 1) & (n - 1)
            slots[i] = e
        self.slots = slots

    def rows(self):
        return zip(self.hashes, self.contents, self.ids, self.counts, strict=True)


def grace(records, budget: int = TABLE_BYTES, level: int = 0):
    """Merges (hash, content, id, count) records of equal content; yields them in no given order."""
    table, spilled, folder = OpenTable(), None, None
    try:
        for r in records:
            if spilled is None:
                table.add(*r)
                if table.size > budget and level < LEVELS:
                    folder = tempfile.TemporaryDirectory(prefix="grace-")
                    spilled = [open(os.path.join(folder.name, str(k)), "w+b") for k in range(FAN_OUT)]  # noqa: SIM115
                    for row in table.rows():
                        pickle.dump(row, spilled[row[0] >> 4 * level & FAN_OUT - 1])
                    table = OpenTable()
            else:
                pickle.dump(tuple(r), spilled[r[0] >> 4 * level & FAN_OUT - 1])
        if spilled is None:
            yield from table.rows()
            return
        for f in spilled:
            f.seek(0)
            yield from grace(_read(f), budget, level + 1)
            f.close()
            os.unlink(f.name)
    finally:
        if folder is not None:
            for f in spilled or ():
                f.close()
            folder.cleanup()


def _read(f):
    while True:
        try:
            yield pickle.load(f)  # noqa: S301  written by this very task
        except EOFError:
            return


def _normal(column) -> list[bytes]:
    """Complete contents with A-Z lower-cased (bytes.lower touches ASCII only); null as empty."""
    return [(x or b"").lower() for x in column.cast(pa.binary()).to_pylist()]


def _emit(merged, with_content: bool, size: int = 8 << 20):
    names = ["sha", "keep_id", "n"] + ["content"] * with_content
    kinds = [pa.binary(), pa.int64(), pa.int64()] + [pa.binary()] * with_content
    rows, held = [], 0
    for _, content, doc_id, n in merged:
        rows.append((hashlib.sha256(content).digest(), doc_id, n) + (content,) * with_content)
        held += len(content) * with_content + 64
        if held > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def text_groups(docs: DataFrame, budget: int = TABLE_BYTES, parts: int | None = None) -> DataFrame:
    """One row per distinct normalised text: sha (binary), keep_id, n.

    ``docs`` has ``doc_id`` (an integer) and ``text``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def local(batches):
        def records():
            for b in batches:
                for doc_id, c in zip(b.column(0).to_pylist(), _normal(b.column(1)), strict=True):
                    yield xxhash.xxh3_64_intdigest(c), c, doc_id, 1

        yield from _emit(grace(records(), budget), True)

    def merged(batches):
        def records():
            for b in batches:
                for keep, n, c in zip(b.column("keep_id").to_pylist(), b.column("n").to_pylist(), b.column("content").to_pylist(), strict=True):
                    yield xxhash.xxh3_64_intdigest(c), c, keep, n

        yield from _emit(grace(records(), budget), False)

    first = keyed_text(docs).mapInArrow(local, "sha binary, keep_id long, n long, content binary")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return first.repartition(n, "sha").mapInArrow(merged, "sha binary, keep_id long, n long")


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of the normalised text, one row per row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def digests(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(c).digest() for c in _normal(b.column(1))], pa.binary())], ["doc_id", "sha"])

    return keyed_text(docs).mapInArrow(digests, "doc_id long, sha binary")


def exact_duplicates(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row.

    The join on the digest is a plain equi-join: adaptive execution splits a digest with very many rows.
    """
    groups = text_groups(docs, budget)
    out = text_digests(docs).join(groups, "sha", "left")
    return out.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one for each normalised text.

    Rows that agree in text and id stay once. A row without id stays, as nothing tells it from others. An id that repeats with
    other texts loses only those rows whose text another row keeps.
    """
    marked = materialize(exact_duplicates(docs).where("doc_id IS NOT NULL").select("doc_id", "kept", "text_sha256"), "marked")
    lost = marked.where("NOT kept").select("doc_id")
    # rows of an id that repeats are told apart by their text too
    again = materialize(marked.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return without_ids(docs, lost)
    single = without_ids(without_ids(docs, again), lost.join(again, "doc_id", "left_anti"))
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    repeated = docs.join(again, "doc_id", "left_semi").withColumns({"__text": text, "__sha": F.sha2(text, 256)})
    gone = marked.where("NOT kept").select("doc_id", F.col("text_sha256").alias("__sha")).distinct()
    repeated = repeated.join(gone, ["doc_id", "__sha"], "left_anti")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "__text"]).select(*docs.columns))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Group, keeper and digest of all documents."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, text_sha256
FROM t
"""
