"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter serves all languages: slot s holds a bitmask (of 64-bit words, as many as the languages need), bit l set
if language l has put an n-gram there. Looking up an n-gram ANDs the masks of its K slots; the result is the set of languages whose
n-grams contain it (true ones and false positives). Over a text, the popcount of each bit is the
language's number of hits; with f_l the filter's false-positive rate for l, (hits - f_l * n) / (1 - f_l)
corrects it. The largest corrected share decides, the more frequent language breaking ties.

An n-gram enters a language's set when it is at least SHARE as frequent there as in the language where
it is most frequent. N-grams are 4 bytes of the text with A-Z lower-cased and other ASCII non-letters
as spaces. Text that is null or has no letter gives ``und`` and score 0. With no learned language
everything is ``und``. Texts are read whole, whatever their length; an empty table gives an empty table; equal
texts get equal answers; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import bounded_batches

#: Labelled rows that the filters are learned from at most (the smallest hashes of the key are taken), and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
#: Slots of the filter (a power of two), and the multipliers of its hash functions.
SLOT_BITS = 20
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
#: Share of the largest relative frequency from which an n-gram belongs to a language too.
SHARE = 0.5
#: Languages of one array of masks; further ones take further arrays.
WORD_BITS = 64

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-byte codes of the texts one after the other, and where each text's codes start (one more at the end).

    Codes with white space inside (not at an end) are left out.
    """
    joined = b"    ".join([b"", *texts, b""])
    raw = np.frombuffer(joined.translate(_TABLE), np.uint8)
    n = len(raw) - 3
    code = raw[:n].astype(np.uint32) | raw[1 : n + 1].astype(np.uint32) << 8 | raw[2 : n + 2].astype(np.uint32) << 16 | raw[3 : n + 3].astype(np.uint32) << 24
    good = (raw[1 : n + 1] != 32) & (raw[2 : n + 2] != 32)
    ends = np.cumsum([len(t) + 4 for t in texts]) if texts else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], ends]).astype(np.int64)  # a text's separator comes before it
    kept = np.concatenate([[0], np.cumsum(good)])
    return code[good], kept[np.minimum(bounds, n)]


def slots(code: np.ndarray) -> list[np.ndarray]:
    mixed = code ^ code >> np.uint32(15)
    return [(mixed * np.uint32(m)) >> np.uint32(32 - SLOT_BITS) for m in MULTIPLIERS]


class LanguageFilter:
    """The learned masks, the languages of their bits and the false-positive rates."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        """rows: (language, text)."""
        by: dict[str, list[bytes]] = {}
        for lang, text in rows:
            by.setdefault(lang, []).append((text or "").encode())
        self.languages = sorted(by, key=lambda x: (-len(by[x]), x))
        kind = np.uint8 if len(self.languages) <= 8 else np.uint64
        self.masks = [np.zeros(1 << SLOT_BITS, kind) for _ in range(0, max(1, len(self.languages)), WORD_BITS)]
        grams, freq = [], []
        for lang in self.languages:
            code, count = np.unique(gram_codes(by[lang])[0], return_counts=True)
            grams.append(code)
            freq.append(count / max(1, count.sum()))
        every = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint32)
        rates = np.zeros((len(grams), len(every)))
        for k, (code, f) in enumerate(zip(grams, freq, strict=True)):
            rates[k, np.searchsorted(every, code)] = f
        top = rates.max(axis=0) if len(grams) else np.zeros(0)
        for k in range(len(grams)):
            masks = self.masks[k // WORD_BITS]
            for s in slots(every[rates[k] >= np.maximum(SHARE * top, 1e-12)]):
                masks[s] |= kind(1 << k % WORD_BITS)  # equal slots get equal bits, so repeats are harmless
        fill = [np.count_nonzero(self.masks[k // WORD_BITS] >> kind(k % WORD_BITS) & kind(1)) / (1 << SLOT_BITS) for k in range(len(grams))]
        self.false = np.array([f ** len(MULTIPLIERS) for f in fill])

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits by text and language, and the n-grams of each text."""
        code, at = gram_codes(texts)
        found = []
        where = slots(code)
        for masks in self.masks:
            both = masks[where[0]]
            for s in where[1:]:
                both = both & masks[s]
            found.append(both)
        n = np.diff(at)
        kind = self.masks[0].dtype.type
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            total = np.concatenate([[0], np.cumsum((found[k // WORD_BITS] >> kind(k % WORD_BITS) & kind(1)).astype(np.int64))])
            out[:, k] = total[at[1:]] - total[at[:-1]]
        return np.maximum(0, (out - n[:, None] * self.false) / (1 - self.false)) if len(self.languages) else out, n

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        hits, _ = self.hits([t or b"" for t in texts])
        best, total = hits.argmax(axis=1), hits.sum(axis=1)
        langs, scores = [], []
        for k, t in enumerate(texts):
            if not t or not has_letter(t):
                langs.append("und")
                scores.append(0.0)
            else:
                langs.append(self.languages[best[k]])
                scores.append(float(hits[k, best[k]] / total[k]) if total[k] else 0.0)
        return langs, scores


_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def has_letter(text: bytes) -> bool:
    rest = text.translate(None, _ASCII_LETTERS)
    if len(rest) < len(text):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageFilter:
    """Filters from at most ``sample_rows`` of the rows (doc_id, text, lang) with language and text of at most SAMPLE_CHARS.

    Of rows that share an id one counts.
    """
    usable = docs.where(f"lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND length(text) <= {SAMPLE_CHARS}")
    ids = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = usable.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    return LanguageFilter(sorted((r.lang, r.text) for r in chosen.select("row.lang", "row.text").collect()))


def identify(docs: DataFrame, filters: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred and score of every row; only doc_id and text are read."""
    bounded_batches(docs.sparkSession, size=8 << 20)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 1 MB for up to 8 languages, else 8 MB for each 64 of them

    def tell(batches):
        for b in batches:
            langs, scores = shared.value.predict(b.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tell, "doc_id long, lang_pred string, score double")


HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 4) = 2"


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    filters = learn(docs.where(f"NOT coalesce({HELD_OUT}, false)"))
    return identify(docs, filters).select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "lang_pred", "score")
