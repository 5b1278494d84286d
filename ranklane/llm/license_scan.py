"""License scans: exact phrases, and a fuzzy search for short notices.

A notice of n characters may be found with k edits (insertions, deletions, substitutions), k growing with n.
Cut into k + 1 pieces, at least one piece must then occur unchanged (pigeonhole): an
Aho-Corasick automaton over the pieces of all notices finds those seeds in one pass over the text. Each seed
gives a window that any match through it must lie in; the ``regex`` library's bounded-error matching
verifies the window and gives span and edits.

Words are runs of characters that are not ASCII, or are ASCII letters or digits; A-Z are lower-cased.
Null text is empty text: no words, places or labels, score 0. A text of any length is searched
whole. Equal rows give equal results; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import bounded_batches, keyed_text

#: Fixed by the contract of the query: phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: Short notices as their licences word them, lower-cased, words joined by one space.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under a creative commons attribution": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 14

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
    "spans array<struct<label: string, start: long, end: long, edits: int>>"
)


@lru_cache(maxsize=4)
def _searcher(notices: tuple[tuple[str, str], ...]):
    """The automaton over all seeds, and the patterns that verify."""
    found = ahocorasick.Automaton()
    at: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for k, (notice, _) in enumerate(notices):
        edits = len(notice) // CHARS_PER_EDIT
        cuts = [round(j * len(notice) / (edits + 1)) for j in range(edits + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            at.setdefault(notice[a:b], []).append((k, a))
        patterns.append((edits, regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")))
    for seed, places in at.items():
        found.add_word(seed, (len(seed), places))
    found.make_automaton()
    return found, patterns


def fuzzy_spans(text: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of the notices in a normalised text, in order."""
    automaton, patterns = _searcher(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (n, places) in automaton.iter(text):
        for k, offset in places:
            edits, start = patterns[k][0], end + 1 - n - offset
            lo, hi = max(0, start - edits), start + len(notices[k][0]) + edits
            own = windows.setdefault(k, [])
            if own and lo <= own[-1][1]:
                own[-1] = [min(own[-1][0], lo), max(own[-1][1], hi)]
            else:
                own.append([lo, hi])
    out = []
    for k, own in windows.items():
        for lo, hi in own:
            for m in patterns[k][1].finditer(text, lo, min(hi, len(text))):
                out.append((notices[k][1], m.start(), m.end(), sum(m.fuzzy_counts)))
    return sorted(out, key=lambda x: x[1:])


def scan_text(raw: bytes | None, notices=tuple(NOTICES.items()), phrases=PHRASES) -> tuple:
    """The columns of SCHEMA after doc_id, for one text in UTF-8."""
    words = (raw or b"").translate(_TABLE).split()
    text = b" ".join(words)
    starts, base = [], set()
    for p, label in phrases.items():
        spelled = [w.encode() for w in p]
        if b" ".join(spelled) in text:  # in all but few texts no word is looked at
            i = -1
            while True:
                try:
                    i = words.index(spelled[0], i + 1)
                except ValueError:
                    break
                if words[i : i + len(p)] == spelled:
                    starts.append(i)
                    base.add(label)
    spans = fuzzy_spans(text.decode("utf-8", "replace"), notices)
    best = max([1.0] * bool(starts) + [1 - e / (b - a) for _, a, b, e in spans if b > a], default=0.0)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | {s[0] for s in spans}), best,
        [{"label": s[0], "start": s[1], "end": s[2], "edits": s[3]} for s in spans],
    )


def scan_licenses(docs: DataFrame, notices=tuple(NOTICES.items())) -> DataFrame:
    """Counts, labels, score and spans (characters of the normalised text) of every row."""
    bounded_batches(docs.sparkSession)
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(span)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def scan(batches):
        for b in batches:
            if b.num_rows:
                columns = zip(*(scan_text(x, notices) for x in b.column(1).cast(pa.binary()).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return keyed_text(docs).mapInArrow(scan, SCHEMA)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of all documents."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


def license_base_counts(spark, sf_dir: str) -> DataFrame:
    """The part of ``op8_license_scan`` that SQL can express, of all documents."""
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, list_filter(range(1, len(words) + 1), lambda i: words[i] = 'mit' AND words[i + 1] = 'license') AS m,
        list_filter(range(1, len(words) + 1), lambda i: words[i] = 'apache' AND words[i + 1] = 'license') AS a,
        list_filter(range(1, len(words) + 1), lambda i: words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license') AS g FROM w)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(m) + len(a) + len(g) AS BIGINT) AS n_base, list_aggregate(list_concat(m, a, g), 'min') - 1 AS first_word, list_aggregate(list_concat(m, a, g), 'max') - 1 AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels
FROM p
"""
