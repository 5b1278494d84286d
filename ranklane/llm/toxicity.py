"""Toxicity by classifier chains.

The categories are predicted one after the other, each by a linear (logistic) model over the
presence of words and stems; the probabilities of earlier categories are further features of the later ones. For training,
those probabilities are out-of-fold: each row's come from models that haven't seen the row, so the
later models meet inputs like those at prediction time. The last category is ``toxic`` itself.

Training takes at most SAMPLE_ROWS labelled rows, none with more than SAMPLE_CHARS characters of text; scoring covers every whole
text. Only the label ``toxic`` is given, so the categories before it are found in the labelled rows: the toxic ones are split by
the main directions in which their telling words vary, and each side of a direction is a kind of toxicity. No word is given
beforehand. Words are runs of letters, A-Z lower-cased. Null or empty text has no words and
gets the models' intercepts. Without any labelled row all probabilities are 0. Rows that repeat score alike; a document with
several labels is toxic if one says so; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import bounded_batches
from ranklane.llm.linear import apply, fit

#: Labelled rows to learn from at most; the smallest hashes of the key are taken.
SAMPLE_ROWS = 6000
#: Words that a model weighs at most, and the texts that a word must occur in.
VOCABULARY, MIN_TEXTS = 256, 5
#: Bytes of the stems that are features beside the words.
STEM = 4
FOLDS = 3
#: Characters of a text that is learned from, at most.
SAMPLE_CHARS = 100_000
#: Kinds of toxicity before ``toxic``, and the toxic rows that a kind must have to differ from ``toxic``.
KINDS, MIN_KIND = 2, 10
CHAIN = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
THRESHOLD = 0.5

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def word_set(text: bytes | None) -> set[bytes]:
    """The words of a text, and the stems of its longer words (first STEM bytes, marked by a star)."""
    words = set((text or b"").translate(_TABLE).split())
    return words | {w[:STEM] + b"*" for w in words if len(w) > STEM}


class Coded:
    """Word sets of training rows as numbers: row and word of every entry."""

    def __init__(self, sets: list[set[bytes]]) -> None:
        known: dict[bytes, int] = {}
        flat = [[known.setdefault(w, len(known)) for w in sorted(s)] for s in sets]
        self.names = list(known)
        self.row = np.repeat(np.arange(len(sets)), [len(x) for x in flat])
        self.word = np.concatenate([np.array(x, np.int64) for x in flat]) if flat else np.zeros(0, np.int64)

    def vocabulary(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The words whose presence in ``rows`` (a mask) tells most about ``y``: largest two-proportion scores."""
        own = rows[self.row]
        hit = y[self.row] > 0
        p = np.bincount(self.word[own & hit], minlength=len(self.names)).astype(float)
        q = np.bincount(self.word[own & ~hit], minlength=len(self.names)).astype(float)
        a, b = max(1, int((y[rows] > 0).sum())), max(1, int((y[rows] <= 0).sum()))
        r = (p + q) / (a + b)
        score = np.abs(p / a - q / b) / np.maximum(1e-9, np.sqrt(r * (1 - r) * (1 / a + 1 / b)))
        score[p + q < MIN_TEXTS] = -1
        best = np.lexsort((np.arange(len(score)), -score))[:VOCABULARY]
        return best[score[best] >= 0]

    def presence(self, words: np.ndarray, n: int) -> np.ndarray:
        at = np.full(len(self.names) + 1, -1)
        at[words] = np.arange(len(words))
        col = at[self.word]
        out = np.zeros((n, len(words)))
        out[self.row[col >= 0], col[col >= 0]] = 1
        return out


def presence(sets: list[set[bytes]], words: list[bytes]) -> np.ndarray:
    at = {w: k for k, w in enumerate(words)}
    keys = at.keys()
    out = np.zeros((len(sets), len(words)), np.float32)
    for k, s in enumerate(sets):
        for w in s & keys:
            out[k, at[w]] = 1
    return out


def kinds(coded: Coded, toxic: np.ndarray) -> list[np.ndarray]:
    """0/1 labels of KINDS kinds of toxic rows: the positive side of each main direction of their telling words.

    A kind of under MIN_KIND rows is all toxic rows.
    """
    n, rows = len(toxic), toxic > 0
    words = coded.vocabulary(np.ones(n, bool), toxic)
    x = coded.presence(words, n)[rows]
    out = [toxic.copy() for _ in range(KINDS)]
    if min(x.shape) > KINDS:
        x = x - x.mean(axis=0)
        _, axes = np.linalg.eigh(x.T @ x)
        for k in range(KINDS):
            axis = axes[:, -1 - k]
            axis = axis * np.sign(axis[np.argmax(np.abs(axis))])  # the sign is the word's that weighs most
            side = x @ axis > 0
            if min(side.sum(), (~side).sum()) >= MIN_KIND:
                out[k][rows] = side
    return out


@dataclass
class Link:
    """One category's model: its words, and weights for words, earlier probabilities and intercept."""

    words: list[bytes]
    weights: np.ndarray

    def predict(self, sets: list[set[bytes]], earlier: np.ndarray) -> np.ndarray:
        return apply(self.weights, np.hstack([presence(sets, self.words), earlier]))


class Chain:
    """Links for CHAIN, learned from word sets, ``toxic`` labels and fold numbers."""

    def __init__(self, sets: list[set[bytes]], toxic: np.ndarray, folds: np.ndarray) -> None:
        self.links: list[Link] = []
        n, coded = len(sets), Coded(sets)
        earlier = np.zeros((n, 0))
        targets = [*kinds(coded, toxic.astype(float)), toxic.astype(float)] if n else []
        for y in targets:
            outside = np.zeros(n)
            for f in [*range(FOLDS), None]:  # the words are chosen within the fold too; at last all rows
                rows = folds != f if f is not None else np.ones(n, bool)
                if rows.any():
                    words = coded.vocabulary(rows, y)
                    x = np.hstack([coded.presence(words, n), earlier])
                    weights = fit(x[rows], y[rows])
                    if f is None:
                        self.links.append(Link([coded.names[k] for k in words], weights))
                    elif not rows.all():
                        outside[~rows] = apply(weights, x[~rows])
            earlier = np.hstack([earlier, outside[:, None]])

    def predict(self, texts: list[bytes | None]) -> np.ndarray:
        """Probabilities by text and category."""
        if not self.links:
            return np.zeros((len(texts), len(CHAIN)))
        keep = set().union(*(link.words for link in self.links))
        sets = [word_set(t) & keep for t in texts]
        earlier = np.zeros((len(sets), 0))
        for link in self.links:
            earlier = np.hstack([earlier, link.predict(sets, earlier)[:, None]])
        return earlier


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """A chain from at most ``sample_rows`` rows of ``labels`` (doc_id, toxic) and their texts."""
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    toxic = {r.doc_id: int(r.toxic > 0) for r in chosen.collect()}
    rows = []
    if toxic:
        bounded_batches(docs.sparkSession)
        ids = sorted(toxic)

        def pick(batches):
            for b in batches:
                own = np.flatnonzero(np.isin(np.asarray(b.column(0).fill_null(-1)), ids) & ~np.asarray(b.column(0).is_null()))
                if len(own):
                    part = b.take(pa.array(own))
                    sets = [b" ".join(sorted(word_set(x))) for x in part.column(1).cast(pa.binary()).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "words"])

        short = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
        rows = sorted((r.doc_id, bytes(r.words)) for r in short.mapInArrow(pick, "doc_id long, words binary").dropDuplicates(["doc_id"]).collect())
    sets = [set(w.split()) for _, w in rows]
    y = np.array([toxic[k] for k, _ in rows])
    return Chain(sets, y, np.array([xxhash.xxh32_intdigest(str(k)) % FOLDS for k, _ in rows]))


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability for each category of CHAIN, and ``is_toxic``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most VOCABULARY words for each category
    names = [f"p_{c}" for c in CHAIN]

    def scored(batches):
        for b in batches:
            p = shared.value.predict(b.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k], pa.float64()) for k in range(len(CHAIN)))], ["doc_id", *names])

    out = docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, " + ", ".join(f"{n} double" for n in names))
    return out.withColumn("is_toxic", F.col("p_toxic") >= threshold)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Category probabilities and the verdict for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs, train(docs, labels))
