"""Document quality rules, run as a short-circuit cascade of DataFrame expressions.

Each rule is a predicate over features of one text. A bounded sample gives every rule a cost (seconds
to evaluate it on the sample beyond what an empty rule takes) and a selectivity (share of the sample that it rejects); the rules
then run in descending order of rejections per second inside one ``CASE``, so a document leaves the
cascade at its first failing rule. The order changes the cost and ``rejected_by``, never the verdict.

Null text counts as no words, and is rejected. Whatever other columns a table has are kept.
Everything runs in the JVM: no Python, Arrow or RDD code.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and symbols as fixed by the contract of the query.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Expected rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
#: Prefix of the working columns; a table's own columns can't clash with it in practice.
W = "__quality_"


@dataclass(frozen=True)
class Rule:
    """A name, and the SQL predicate under which a document is rejected."""

    name: str
    rejects: str


def _c(name: str) -> Column:
    return F.col(W + name)


#: The production rules. The first two are the base of the query's contract; the others are the method's.
RULES = (
    Rule("few_words", f"{W}n_words < 50"),
    Rule("repeated_words", f"100 * {W}n_repeat_words > 50 * {W}n_words"),
    Rule("too_many_words", f"{W}n_words > 100000"),
    Rule("word_length", f"{W}word_chars < 2 * {W}n_words OR {W}word_chars > 14 * {W}n_words"),
    Rule("symbols", f"10 * {W}n_symbols > 3 * {W}n_words"),
    Rule("duplicate_lines", f"10 * {W}n_dup_lines > 3 * {W}n_lines"),
)
BASE = ("few_words", "repeated_words")
#: Without the upper bound of words, which the contract of the query has: length alone rejects no text of the pipeline.
PIPELINE_RULES = tuple(r for r in RULES if r.name != "too_many_words")


def _arrays(text: str) -> str:
    """SQL of a struct with the words, the lines with a word, and the counts over characters.

    Whatever uses it binds it to a lambda variable, so that it is evaluated once for each use, also where the optimizer
    moves the expression into a filter.
    """
    value = f"coalesce(cast(`{text}` AS string), '')"
    return f"""named_struct(
        'words', filter(split({value}, '{SPACE}+', -1), x -> x != ''),
        'lines', filter(split({value}, '\\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]'),
        'word_chars', cast(length(regexp_replace({value}, '{SPACE}', '')) AS bigint),
        'n_symbols', cast(length({value}) - length(translate({value}, '{SYMBOLS}', '')) AS bigint))""".replace("\\x", "\\\\x")


def _with_arrays(text: str, body: str) -> str:
    """SQL of ``body``, in which ``t`` is the struct of arrays."""
    return f"element_at(transform(array({_arrays(text)}), t -> {body}), 1)"


def repeat_words(words: str) -> str:
    """SQL: words within some 3-word window that occurs twice or more in the text, counted once each.

    Without a repeated window the sizes of the windows and of the distinct windows agree, and nothing
    else runs. Otherwise the windows are sorted with their starts; a window is repeated when a neighbour
    in that order is equal; each repeated start covers 3 words, less what the next one covers.
    """
    grams = f"transform(sequence(0, size({words}) - 3), i -> concat_ws(' ', {words}[i], {words}[i + 1], {words}[i + 2]))"
    covered = """aggregate(
        array(sort_array(transform(g, (x, i) -> struct(x AS w, i AS i)))), 0L, (a0, s) -> a0 + aggregate(
          array(array_sort(transform(filter(transform(s, (x, j) -> struct(x.i AS i, coalesce(x.w = get(s, j - 1).w, false) OR coalesce(x.w = get(s, j + 1).w, false) AS twice)), y -> y.twice), y -> y.i))),
          0L, (a1, p) -> a1 + aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1), x + 3) - x)), 0L, (a, x) -> a + x)))"""
    return f"""CASE WHEN size({words}) < 4 THEN 0L ELSE aggregate(array({grams}), 0L, (acc, g) ->
        acc + CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {covered} END) END"""


#: Counts over the arrays ``t``.
COUNTS = {
    "n_words": "cast(size(t.words) AS bigint)",
    "n_lines": "cast(size(t.lines) AS bigint)",
    "n_dup_lines": "cast(size(t.lines) - size(array_distinct(t.lines)) AS bigint)",
    "n_repeat_words": repeat_words("t.words"),
    "word_chars": "t.word_chars",
    "n_symbols": "t.n_symbols",
}


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds all counts under ``W``."""
    all_ = ", ".join(f"'{k}', {v}" for k, v in COUNTS.items())
    out = docs.withColumn(W + "all", F.expr(_with_arrays(text, f"named_struct({all_})")))
    return out.withColumns({W + k: F.col(W + "all")[k] for k in COUNTS}).drop(W + "all")


def _inline(rule: Rule) -> str:
    """The predicate with its counts written out over the arrays, so that CASE evaluates them lazily."""
    out = rule.rejects
    for name, sql in COUNTS.items():
        out = out.replace(W + name, f"({sql})")
    return out


def ordered_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second of evaluation, measured on a sample of about ``sample_rows`` rows (no shuffle)."""
    share = min(1.0, sample_rows / max(docs.count(), 1))  # of a table: from the footers
    sample = docs.select(F.col(text)).sample(share, seed=7).persist()
    try:
        total = max(sample.count(), 1)

        def timed(predicate: str) -> tuple[float, int]:
            """The shorter of two evaluations, and the rows that fail."""
            taken, failed = [], 0
            for _ in range(2):
                began = time.perf_counter()
                failed = sample.where(_with_arrays(text, predicate)).count()
                taken.append(time.perf_counter() - began)
            return min(taken), failed

        base, _ = timed("size(t.words) < 0")  # what every rule costs: the job, and the arrays
        ranked = []
        for k, rule in enumerate(rules):
            cost, rejected = timed(_inline(rule))
            ranked.append((-(rejected / total) / max(cost - base, 1e-3), k, rule))
    finally:
        sample.unpersist()
    return [rule for _, _, rule in sorted(ranked, key=lambda x: x[:2])]


def cascade(rules, text: str = "text") -> Column:
    """The name of the first rule, in the given order, that rejects; null where none does."""
    if not rules:
        return F.lit(None).cast("string")
    whens = " ".join(f"WHEN {_inline(r)} THEN '{r.name}'" for r in rules)
    return F.expr(_with_arrays(text, f"CASE {whens} END"))


def quality_verdicts(docs: DataFrame, rules=RULES, text: str = "text", counts: bool = False, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by`` (null: kept), and with all counts under ``W`` where asked for.

    An empty table gives an empty table. Equal rows get equal verdicts. Columns of ``docs`` named like
    a result are replaced.
    """
    ordered = ordered_rules(docs, rules, text, sample_rows)
    base = docs.drop("rejected_by")
    if counts:  # all counts are asked for anyway: each is computed once and the cascade reads it
        out = features(base, text)
        hit = None
        for rule in ordered:
            hit = (F if hit is None else hit).when(F.expr(rule.rejects), F.lit(rule.name))
        return out.withColumn("rejected_by", hit)
    return base.withColumn("rejected_by", cascade(ordered, text))


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the columns of ``docs``."""
    columns = docs.columns
    marked = quality_verdicts(docs.withColumn(W + "own", F.struct(*columns)) if "rejected_by" in columns else docs, rules, text)
    kept = marked.where(F.col("rejected_by").isNull())
    return kept.select(W + "own.*") if "rejected_by" in columns else kept.select(*columns)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_verdicts(docs, counts=True)
    base = " OR ".join(f"({r.rejects})" for r in RULES if r.name in BASE)
    return out.select(
        "doc_id",
        _c("n_words").alias("n_words"),
        _c("word_chars").alias("word_chars"),
        _c("n_symbols").alias("n_symbols"),
        _c("n_dup_lines").alias("n_dup_lines"),
        _c("n_repeat_words").alias("n_repeat_words"),
        F.expr(base).alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
    )


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
      CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_words > 100000
       OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > 3 * n_words
       OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM f
"""
