"""Texts as sequences of parts that a byte-level pattern never joins, for encoding each distinct part once.

No word of the public byte-level pattern spans the place before a single space between other characters: a text is cut
there. Beside other white space it is left whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import bounded_batches, materialize, stated_bytes

#: Strings that are shared by all tasks and their bytes, at most; bytes of the sample's files that they come from.
COMMON, COMMON_BYTES, SAMPLE_BYTES = 400_000, 48, 40 << 20

#: A space beside other white space, and white space beyond ASCII: such texts aren't cut at every space.
_UNSAFE = "[ \t\n\v\f\r] | [\t\n\v\f\r]|[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPLIT = re.compile(r"(?<=\S)(?= \S)")


def text_units(texts: pa.Array, cut: bool = True, special: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts of texts, the parts of each text one after the other (as positions), and where each text's begin.

    Null is empty. Without ``cut``, and for texts with the string ``special``, a text is one part.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    safe = np.zeros(len(texts), bool)
    if cut:
        unsafe = _UNSAFE + (f"|{re.escape(special)}" if special else "")
        safe = ~pc.match_substring_regex(texts, unsafe).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(texts.filter(pa.array(safe)), " ")
    starts = np.asarray(split.offsets)
    starts = starts - starts[0]
    coded = split.flatten().dictionary_encode()
    code = 2 * np.asarray(coded.indices).astype(np.int64)
    code[starts[:-1]] += 1  # the first part of a text has no space before it
    place = np.zeros(2 * len(coded.dictionary) + 2, np.int64)
    place[code] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used))
    named = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
    units = [named[c >> 1] if c & 1 else " " + named[c >> 1] for c in used.tolist()]
    code = place[code]
    counts = np.zeros(len(texts), np.int64)
    counts[safe] = np.diff(starts)
    if not safe.all():  # cut where a single space stands between other characters, or not at all
        index: dict[str, int] = {}
        out, turn = [], 0
        for k, whole in enumerate(safe.tolist()):
            if whole:
                out.append(code[starts[turn] : starts[turn + 1]])
                turn += 1
            else:
                text = texts[k].as_py()
                own = _SPLIT.split(text) if cut and not (special and special in text) else [text]
                out.append(np.array([index.setdefault(x, len(units) + len(index)) for x in own], np.int64))
                counts[k] = len(own)
        units += index
        code = np.concatenate(out)
    return units, code, np.concatenate([[0], np.cumsum(counts)])


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The concatenation of flat[starts[r] : starts[r] + sizes[r]] over ``rows``."""
    n = sizes[rows]
    return flat[np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def common_strings(docs: DataFrame, listed, most: int = COMMON) -> tuple[DataFrame, int]:
    """Strings (column word) that occur twice or more in a sample of about SAMPLE_BYTES of ``docs``, as many as fit under
    ``most`` from the commonest down and of COMMON_BYTES at most, and their number.

    ``listed`` gives the strings of an array of texts and how often each occurs. Which strings these are is a matter of cost.
    """
    bounded_batches(docs.sparkSession, 2000, 4 << 20)
    stated = stated_bytes(docs)
    share = 1.0 if stated is None else min(1.0, SAMPLE_BYTES / max(stated, 1))

    def count(batches):
        for b in batches:
            words, n = listed(b.column(0))
            if words:
                words = pa.array(words, pa.string())
                short = pc.less_equal(pc.binary_length(words), COMMON_BYTES)
                yield pa.RecordBatch.from_arrays([words.filter(short), pa.array(n, pa.int64()).filter(short)], ["word", "n"])

    sample = docs.select("text").sample(share, seed=11)
    counts = materialize(sample.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "counts")
    least, held = None, 0
    for r in counts.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.desc("n")).collect():  # 999 rows at most
        if held + r["count"] > most:
            break
        least, held = r["n"], held + r["count"]
    kept = counts.where(F.col("n") >= least) if least is not None else counts.where("false")
    return kept.select("word"), held
