"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: at white space after a full stop, question or exclamation mark, after their full-width
forms, and at line breaks. Where no sentence ends within LONG_WORDS words (text without punctuation), the stretch counts as
several: it is cut after words chosen by their hash, so that equal words are cut alike. Every run of several consecutive sentences is hashed that is shortest: from each sentence
forwards, and to each sentence backwards, at least two sentences with MIN_WORDS words or more (128 bits, after
lower-casing A-Z and with single spaces). Longer runs consist of such runs, so that a repeated passage of whole sentences is
covered to its ends. Of the equal runs of the whole table the one with the smallest (doc_id, position) is first; all
sentences that any other one covers are removed.

A task first settles equal runs among its own rows, so a run with very many places leaves one record for
each task; only those records are dealt by digest, over as many partitions as the input's size asks for, sorted there
(Spark spills) and settled as a stream.

Null or blank text has no runs. Rows without doc_id are left as they are and count for nothing; rows that
share a doc_id count as one document and are treated alike. Very long texts are one row's work; a text of one sentence has no
runs; an empty table gives an empty table. Other columns are kept; in ``without_repeats`` a column named like a result is
replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklane.llm.common import bounded_batches, keyed_text, partitions_for, release_memory

#: Words and sentences of a run at least.
MIN_WORDS, MIN_SENTENCES = 16, 2
#: Words without a sentence's end from which text is cut, and the window whose word of smallest hash ends a piece.
LONG_WORDS, WINDOW = 50, 12
#: Runs that a task holds before it settles and emits them.
HELD = 1_000_000
_END = re.compile(r"[.!?…][^\S\n]+|[。！？]\s*|\n\s*")
_WORD = re.compile(r"\s*\S+\s*")


def sentences(text: str) -> list[str]:
    """The sentences of a text, each with the white space after it; joined, they are the text."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    out = []
    for a, b in zip([0, *ends], ends):
        if b - a > 2 * LONG_WORDS and len(text[a:b].split()) > LONG_WORDS:
            out += _pieces(text[a:b])
        elif a < b:
            out.append(text[a:b])
    return out


def _pieces(part: str) -> list[str]:
    """``part`` after the last word of smallest hash in each window of WINDOW words, so that equal words are cut alike."""
    words = _WORD.findall(part)
    h = [zlib.crc32(w.strip().encode().lower()) for w in words]
    ends, best = set(), -1
    for i in range(WINDOW - 1, len(h)):
        low = i - WINDOW + 1
        if best < low:
            best = min(range(low, i + 1), key=lambda k: (h[k], -k))
        elif h[i] <= h[best]:
            best = i
        ends.add(best)
    bounds = [0, *sorted(k + 1 for k in ends), len(words)]
    return [p for a, b in zip(bounds, bounds[1:]) if (p := "".join(words[a:b]))]


def runs(parts: list[str]) -> tuple[list[int], list[int], list[bytes]]:
    """First and last sentence, and the digest, of every run."""
    plain = [" ".join(p.split()) for p in parts]
    at = [k for k, p in enumerate(plain) if p]
    words = [plain[k].count(" ") + 1 for k in at]
    digests = [xxhash.xxh3_128_digest(plain[k].encode().lower()) for k in at]
    found: set[tuple[int, int]] = set()
    n = len(at)
    j, total = 0, 0
    for i in range(n):  # forwards: the shortest run from i; its end never moves back
        while j < n and (j - i < MIN_SENTENCES or total < MIN_WORDS):
            total += words[j]
            j += 1
        if j - i >= MIN_SENTENCES and total >= MIN_WORDS:
            found.add((i, j - 1))
        total -= words[i]
    j, total = n - 1, 0
    for i in range(n - 1, -1, -1):  # backwards: the shortest run that ends at i
        while j >= 0 and (i - j < MIN_SENTENCES or total < MIN_WORDS):
            total += words[j]
            j -= 1
        if i - j >= MIN_SENTENCES and total >= MIN_WORDS:
            found.add((j + 1, i))
        total -= words[i]
    pairs = sorted(found)
    keys = [xxhash.xxh3_128_digest(b"".join(digests[i : j + 1])) for i, j in pairs]
    return [at[i] for i, _ in pairs], [at[j] for _, j in pairs], keys


_KIND = np.dtype([("h", "<i8"), ("g", "<i8"), ("doc", "<i8"), ("a", "<i4"), ("b", "<i4")])


def _again(rows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs sorted by digest and place: which are their digest's first, and which aren't at its first place.

    ``before`` has the first place of the digest that the rows may go on with, or nothing. The same place twice (rows
    that share a doc_id) isn't another place.
    """
    both = np.concatenate([before, rows])
    first = np.ones(len(both), bool)
    first[1:] = (both["h"][1:] != both["h"][:-1]) | (both["g"][1:] != both["g"][:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(both)), 0))
    again = ~first & ((both["doc"] != both["doc"][start]) | (both["a"] != both["a"][start]))
    return both[start[-1:]], again[len(before) :]


def repeated_places(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id and its places (first and last sentence, alternating) of runs that aren't their run's first.

    A document can have several rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def collect(batches):
        held, size = [], 0

        def emit():
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["a"], rows["doc"], rows["g"], rows["h"]))]
            _, again = _again(rows, rows[:0])
            # what is settled needs no digest any more: it goes wherever there is room
            spread = rows["doc"] * np.int64(0x1F123BB5) + rows["a"]
            columns = [np.where(again, spread, rows["h"]), *(np.ascontiguousarray(rows[c]) for c in ("g", "doc", "a", "b")), again]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "g", "doc", "a", "b", "settled"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if doc_id is None or not text:
                    continue
                a, z, keys = runs(sentences(text))
                if keys:
                    new = np.empty(len(keys), _KIND)
                    packed = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                    new["h"], new["g"], new["doc"], new["a"], new["b"] = packed[:, 0], packed[:, 1], doc_id, a, z
                    held.append(new)
                    size += len(new)
                if size >= HELD:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()
        held = []
        release_memory()

    def settle(batches):
        last = np.zeros(0, _KIND)
        for b in batches:
            rows = np.empty(b.num_rows, _KIND)
            for c in _KIND.names:
                rows[c] = b.column(c).to_numpy(zero_copy_only=False)
            settled = b.column("settled").to_numpy(zero_copy_only=False)
            open_ = rows[~settled]
            found = rows[settled]
            if len(open_):
                last, again = _again(open_, last)
                found = np.concatenate([found, open_[again]])
            if len(found):
                yield places(found)

    def places(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[np.argsort(rows["doc"], kind="stable")]
        docs_, at = np.unique(rows["doc"], return_index=True)
        flat = np.stack([rows["a"], rows["b"]], 1).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(2 * np.append(at, len(rows)), pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(docs_), lists], ["doc_id", "places"])

    found = keyed_text(docs).mapInArrow(collect, "h long, g long, doc long, a int, b int, settled boolean")
    dealt = found.repartition(parts or partitions_for(docs), "h", "g").sortWithinPartitions("h", "g", "doc", "a")
    return dealt.mapInArrow(settle, "doc_id long, places array<int>")


def cleaned(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: own (a struct of its columns), body (the cleaned text), before and removed (sentences)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = partitions_for(docs)
    places = repeated_places(docs, parts).repartition(parts, "doc_id").groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("places"))
    # the columns of docs travel as one struct, so that their names can't clash
    kept = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.struct(*[c for c in docs.columns if c != "text"]).alias("own"))
    joined = kept.where("id IS NOT NULL").repartition(parts, "id").join(places.withColumnRenamed("doc_id", "id"), "id", "left")
    # rows without id stay where they are: they would all meet in one partition
    joined = joined.select("own", "body", "places").unionByName(kept.where("id IS NULL").select("own", "body", F.lit(None).cast("array<int>").alias("places")))
    schema = T.StructType([*joined.schema.fields, T.StructField("before", T.LongType()), T.StructField("removed", T.LongType())])

    def clean(batches):
        for b in batches:
            texts, before, removed = [], [], []
            for text, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = sentences(text or "")
                before.append(len(own))
                if places:
                    bad = np.zeros(len(own) + 1, np.int64)
                    at = np.array(places).reshape(-1, 2)
                    np.add.at(bad, at[:, 0], 1)
                    np.add.at(bad, at[:, 1] + 1, -1)
                    bad = np.cumsum(bad)[:-1] > 0
                    text = "".join(p for p, x in zip(own, bad.tolist(), strict=True) if not x).strip()
                texts.append(text)
                removed.append(int(bad.sum()) if places else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2), pa.array(before, pa.int64()), pa.array(removed, pa.int64())], ["own", "body", "places", "before", "removed"])

    return joined.mapInArrow(clean, schema).drop("places")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cleaned, and n_sentences and n_removed (sentences before, and removed)."""
    rest = [F.col("own")[c].alias(c) for c in docs.columns if c not in ("text", "n_sentences", "n_removed")]
    return cleaned(docs).select(*rest, F.col("body").alias("text"), F.col("before").alias("n_sentences"), F.col("removed").alias("n_removed"))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Cleaned text of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs)
