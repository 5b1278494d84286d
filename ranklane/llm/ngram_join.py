"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Two sets link when 100 * |intersection| >= percent * |union|. All sets are ordered by one global order of
shingles, rarest first as far as a fixed-size sketch of the counts of all documents tells (any order gives the same links), so
that common passages come last. With
t = ceil(percent * n / 100), a set of n shingles shares at least t with any partner, hence at
least c shingles lie among the first n - t + c of both.

* Light sets (n up to a boundary) enumerate the fixed-size subsets (c = 2) of that prefix as keys.
* Heavy sets put the single shingles (c = 1) of that prefix into inverted lists and scan those lists. Light
  sets that are large enough to link with a heavy one stand in the lists too.
* The boundary minimises the cost of both over the histogram of set sizes.

A shingle that is in no other set's prefix gives no key. A sketch with room for all documents tells that by itself (its counts
are upper bounds). Where slots hold many shingles each, levels are told by how far a slot stands out, and the prefixes' shingles are
counted exactly, by a shuffle that grows with the documents.
Equal sets form one class, represented by their smallest id; only representatives are joined. Keys with few
sets compare them all; keys with many compare each set with a leader first, then only sets of different
components with each other, so that a group of copies never costs all of its pairs and no link between
components is lost. A pair must pass the bound that its prefixes prove before its complete sets are compared
exactly (as 64-bit hashes of shingles).

Words are runs of other than ASCII white space, with A-Z lower-cased. A text with fewer words than a shingle
has its whole sequence as its only shingle; one without words (or null) has none and links with nothing. Rows that
repeat are in the same class. Of several texts of one id the one of smallest digest is compared. Leaders of equal rarity: the
smallest id. Very long texts are one row's work. Rows without id link with nothing and have no component. An empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.llm.common import bounded_batches, keyed_text, materialize, release_memory
from ranklane.llm.components import components

#: The sketch: counters for each document, and bounds for their number (as powers of two). Levels of counts are
#: kept in four bits each, at most 32 MB. All documents are counted; beyond the upper bound slots are shared by more shingles.
COUNTERS, BITS_MIN, BITS_MAX = 256, 16, 26
#: The smallest count of each level (while there is room), and a slice of counters that is summed in one place.
LEVELS, SLICE = (0, 1, 2, 3, 4, 5, 7, 9, 13, 19, 29, 45, 71, 111, 171, 255), 1 << 16
#: Sets of one key that are compared all with all.
FEW = 12
#: Further leaders that the sets of a key are compared with before all are compared with all.
LEADERS = 1
#: Sizes that the histogram tells apart.
SIZES = 4096
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_U = np.uint64
_PIECE = 2 << 20  # bytes of text that are hashed at once


def _table(seed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(seed + bytes([k % 256, k // 256])).digest()[:8] for k in range(n)), np.uint64)


_BYTE, _BASE = _table(b"byte", 256), _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            both = []
            for b in (_BASE, _INVERSE):
                p = np.empty(size, np.uint64)
                p[0] = 1
                k = 1
                step = b
                while k < size:
                    p[k : 2 * k] = p[:k] * step
                    step, k = step * step, 2 * k
                both.append(p)
        _powers[size] = (both[0], both[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's begin (one more at the end)."""
    with np.errstate(over="ignore"):
        joined = b" ".join([b"", *texts, b""]).lower()
        raw = np.frombuffer(joined, np.uint8)
        blank = _BLANK[raw]
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        power, inverse = powers(len(raw) + 1)
        total = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)])
        words = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) if texts else np.zeros(1, np.int64)
        return words, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    batch, held = [], 0
    for t in [*texts, None]:
        if t is not None:
            batch.append(t)
            held += len(t)
        if batch and (t is None or held >= _PIECE):
            out += _sets(batch, words)
            batch, held = [], 0
    return out


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        h, at = word_hashes(texts)
        rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            rolled = mix(rolled + _U(k + 1) + h[k : k + len(rolled)])
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                one = np.zeros(1, np.uint64)
                for k in range(a, b):
                    one = mix(one + _U(1000 + k - a) + h[k])
                out.append(one)
            else:
                out.append(rolled[:0])
        return out


def least_shared(n, percent: int):
    """Shingles that a set of n shares with any partner at least."""
    return -(-percent * n // 100)


class Order:
    """The global order of shingles, and the keys of a set."""

    def __init__(self, levels: np.ndarray, percent: int, boundary: int) -> None:
        self.levels, self.percent, self.boundary = levels, percent, boundary  # levels: two to a byte
        self.shift = _U(64 - (2 * len(levels)).bit_length() + 1)

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The order keys, sorted, of the first n - t + 2 shingles. The top bits are the level of the count."""
        n = len(s)
        at = slot(scrambled(s), self.shift)
        level = (self.levels[at >> _U(1)] >> ((at & _U(1)) << _U(2)).astype(np.uint8) & np.uint8(15)).astype(np.uint64)
        keys = level << _U(57) | s >> _U(7)
        take = min(n, n - least_shared(n, self.percent) + 2)
        keys = np.partition(keys, take - 1)[:take] if take < n else keys
        return np.sort(keys)

    def keys(self, prefix: np.ndarray, n: int, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the single shingles, and of the subsets of two, that the set needs; ``alone`` marks those of no other set."""
        none = prefix[:0]
        single = pairs = none
        first = n - least_shared(n, self.percent) + 1
        if n > self.boundary or 100 * n >= self.percent * (self.boundary + 1):
            single = prefix[:first][~alone[:first]]
        if n <= self.boundary:
            kept = prefix[~alone]
            a, b = np.triu_indices(len(kept), 1)
            with np.errstate(over="ignore"):
                pairs = mix(kept[a] * _U(0xD6E8FEB86659FD93) + kept[b]) >> _U(1) if len(a) else none
        return single, pairs


def rarity(prefix: np.ndarray) -> int:
    """How rare the shingles of a prefix are: low for a text whose variants are many, which makes a good leader."""
    return int(-1000 * (prefix >> _U(57)).astype(float).mean()) if len(prefix) else 0


def scrambled(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(s + _U(0x632BE59BD9B4E019))


def slot(counted: np.ndarray, shift: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (counted * _U(0x9FB21C651E98DF25)) >> shift


def _sizes(counts: np.ndarray) -> np.ndarray:
    """Classes of counts: sixteen to a doubling."""
    return (16 * np.log2(counts + 1.0)).astype(np.int64)


def _tail_levels(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest class of each level, and by how much its counts exceed the mean; ``found``: the slots of each class.

    None and one are levels of their own; of the other slots, each next level holds the largest third of those before.
    """
    size = 2.0 ** (np.arange(len(found)) / 16) - 1
    above = np.cumsum(found[::-1])[::-1]  # slots of this class or a larger one
    two = int(_sizes(np.array(2)))
    most = above[two] if len(found) > two else 0
    edges = [0, int(_sizes(np.array(1)))] + [max(two, int(np.sum(above > most / 3**k))) for k in range(14)]
    mean = float((found * size).sum() / max(1, found.sum()))
    return np.array(edges), np.concatenate([[0], np.clip(2.0 ** (np.array(edges[1:]) / 16) - 1 - mean, 1, LEVELS[-1])])


def statistics(docs: DataFrame, words: int, bits: int, full: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all rows: the level of every slot's count (two to a byte), the slots of each level, the histogram of set sizes,
    and the count that each level stands for. ``full``: slots hold many shingles each, so levels go by the counts found."""
    spark = docs.sparkSession
    bounded_batches(spark, 1000, 8 << 20)
    size = 1 << bits
    slices = size // SLICE

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["k", "at", "n"])

    def count(batches):
        total, hist = np.zeros(size, np.uint8), np.zeros(SIZES + 1, np.int64)
        shift = _U(64 - bits)
        for b in batches:
            sets = shingle_sets([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()], words)
            hist += np.bincount(np.minimum([len(s) for s in sets], SIZES), minlength=SIZES + 1) if sets else 0
            at, n = np.unique(slot(scrambled(np.concatenate(sets)), shift) if sets else np.zeros(0, np.uint64), return_counts=True)
            n = total[at] + n.astype(np.int64)
            large = np.flatnonzero(n > 255)
            if len(large):  # a count that outgrows its byte goes on its own
                own, of = at[large].astype(np.int64), n[large]
                yield table([(k, (own[own // SLICE == k] % SLICE).astype(np.uint16).tobytes(), of[own // SLICE == k].tobytes()) for k in np.unique(own // SLICE).tolist()])
                n[large] = 0
            total[at] = n
        rows = [(slices, None, hist.tobytes())]
        for k in range(slices):
            part = total[k * SLICE : (k + 1) * SLICE]
            at = np.flatnonzero(part)
            if 3 * len(at) < SLICE:
                rows.append((k, at.astype(np.uint16).tobytes(), part[at].tobytes()))
            else:
                rows.append((k, None, part.tobytes()))
            if len(rows) >= 64 or k == slices - 1:
                yield table(rows)
                rows = []

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at, n in zip(*(b.column(c).to_pylist() for c in ("k", "at", "n")), strict=True):
                if k == slices:
                    found[k] = found.get(k, 0) + np.frombuffer(n, np.int64)
                    continue
                own = found.setdefault(k, np.zeros(SLICE, np.int64))
                where = slice(None) if at is None else np.frombuffer(at, np.uint16)
                own[where] += np.frombuffer(n, np.int64 if at is not None and len(n) == 4 * len(at) else np.uint8)
        for k, x in found.items():
            if not full and k < slices:
                x = packed(np.searchsorted(LEVELS, x, side="right") - 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["k", "n"])

    def packed(level):
        return level[::2].astype(np.uint8) | level[1::2].astype(np.uint8) << np.uint8(4)

    def classes(batches):
        found = np.zeros(1, np.int64)
        for b in batches:
            for k, n in zip(b.column("k").to_pylist(), b.column("n").to_pylist(), strict=True):
                if k < slices:
                    own = np.bincount(_sizes(np.frombuffer(n, np.int64)), minlength=len(found))
                    own[: len(found)] += found
                    found = own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)), pa.int64()), pa.array(found)], ["size", "n"])

    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = keyed_text(docs).mapInArrow(count, "k int, at binary, n binary").repartition(parts, "k").mapInArrow(merge, "k int, n binary")
    stands = np.array(LEVELS, float)
    if full:
        counts = materialize(merged, "counted")
        held = {r["size"]: r["n"] for r in counts.mapInArrow(classes, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).collect()}  # 1024 classes at most
        edges, stands = _tail_levels(np.array([held.get(k, 0) for k in range(max(held) + 1)], np.int64))

        def graded(batches):
            for b in batches:
                pairs = zip(b.column("k").to_pylist(), b.column("n").to_pylist(), strict=True)
                out = [n if k == slices else packed(np.searchsorted(edges, _sizes(np.frombuffer(n, np.int64)), side="right") - 1).tobytes() for k, n in pairs]
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.binary())], ["k", "n"])

        merged = counts.mapInArrow(graded, "k int, n binary")
    levels, hist, used = np.zeros(size // 2, np.uint8), np.zeros(SIZES + 1, np.int64), np.zeros(16, np.int64)
    for r in merged.collect():  # the sketch: a fixed number of bytes
        if r.k == slices:
            hist += np.frombuffer(bytes(r.n), np.int64)
        else:
            own = np.frombuffer(bytes(r.n), np.uint8)
            levels[r.k * SLICE // 2 : (r.k + 1) * SLICE // 2] = own
            used += np.bincount(own & 15, minlength=16) + np.bincount(own >> 4, minlength=16)
    return levels, used, hist, stands


def boundary(hist: np.ndarray, used: np.ndarray, percent: int, stands: np.ndarray) -> int:
    """The largest light size: the cheapest split of the histogram into subsets and inverted lists."""
    n = np.arange(SIZES + 1)
    prefix = n - least_shared(n, percent)
    length = float((stands * stands * used).sum() / max(1.0, (stands * used).sum()))  # of the list that an entry stands in, on average
    light = np.cumsum(hist * (prefix + 2) * (prefix + 1) / 2)
    heavy = hist * (prefix + 1) * (1 + length)
    cost = light + heavy.sum() - np.cumsum(heavy)
    return int(np.argmin(cost[:SIZES]))


def _signatures(docs: DataFrame, words: int, order: Order, full: bool) -> DataFrame:
    """doc_id, n, class (a digest of the set), rarity and prefix of every row, and both kinds of keys unless the sketch is full."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    names = ["doc_id", "n", "class", "rare", "prefix", "single", "pairs"]
    longs = pa.list_(pa.int64())

    def sign(batches):
        order = shared.value
        for b in batches:
            sets = shingle_sets([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()], words)
            prefixes = [order.prefix(s) if len(s) else s for s in sets]
            keys = [order.keys(p, len(s), p >> _U(57) <= _U(1)) if len(s) and not full else (p[:0], p[:0]) for p, s in zip(prefixes, sets, strict=True)]
            columns = [
                b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([rarity(p) for p in prefixes], pa.int64()),
                pa.array([p.astype(np.int64) for p in prefixes], longs), pa.array([k[0].astype(np.int64) for k in keys], longs), pa.array([k[1].astype(np.int64) for k in keys], longs),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
        release_memory()

    return keyed_text(docs).mapInArrow(sign, "doc_id long, n long, class binary, rare long, prefix array<long>, single array<long>, pairs array<long>")


def _with_keys(reps: DataFrame, order: Order) -> DataFrame:
    """``reps`` with their keys, of the prefix shingles that two sets or more have, by exact counts."""
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(order)
    each = reps.select("doc_id", F.explode("prefix").alias("p"))
    several = each.groupBy("p").count().where("count > 1").select("p")
    kept = each.join(several, "p", "left_semi").groupBy("doc_id").agg(F.collect_list("p").alias("kept"))
    names = ["doc_id", "n", "class", "rare", "prefix", "single", "pairs"]
    longs = pa.list_(pa.int64())

    def key(batches):
        order = shared.value
        for b in batches:
            single, pairs = [], []
            for n, prefix, own in zip(b.column("n").to_pylist(), b.column("prefix"), b.column("kept"), strict=True):
                p = np.asarray(prefix.values).astype(np.uint64)
                x, y = order.keys(p, n, ~np.isin(p, np.asarray(own.values).astype(np.uint64))) if own.is_valid else (p[:0], p[:0])
                single.append(x.astype(np.int64))
                pairs.append(y.astype(np.int64))
            columns = [b.column(c) for c in names[:5]] + [pa.array(single, longs), pa.array(pairs, longs)]
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = reps.drop("single", "pairs").join(kept, "doc_id", "left")
    return joined.mapInArrow(key, reps.select(*names).schema)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and packed shingle hashes of the rows whose id is in ``ids`` (column id)."""
    few = ids.count() <= BROADCAST_IDS
    own = keyed_text(docs).join((F.broadcast(ids) if few else ids).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")

    def pack(batches):
        for b in batches:
            sets = shingle_sets([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()], words)
            columns = [b.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "class", "hashes"])

    return own.mapInArrow(pack, "id long, class binary, hashes binary").where("length(hashes) > 0").groupBy("id").agg(F.min_by("hashes", "class").alias("hashes"))


def _enough(pa_: str, na: str, pb: str, nb: str, percent: int):
    """Whether sizes and prefixes of two sets allow a link.

    Up to the smaller of the last prefix shingles all shingles of both sets are known; beyond it they share at
    most what the one with fewer left has.
    """
    cut = F.least(F.element_at(pa_, -1), F.element_at(pb, -1))
    known = lambda p: F.size(F.filter(p, lambda x: x <= cut))
    shared = F.size(F.array_intersect(pa_, pb)) + F.least(F.col(na) - known(pa_), F.col(nb) - known(pb))
    return (100 + percent) * shared >= percent * (F.col(na) + F.col(nb))


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and prefixes don't rule a link out."""
    own = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    other = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
    return pairs.join(own, "a").join(other, "b").where(_enough("pa", "na", "pb", "nb", percent)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link, compared by their complete sets."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = materialize(_sets_of(docs, ids, words), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum()) if len(x) else 0
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ha", "hb").mapInArrow(compare, "a long, b long")


def similar_links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their class and its representative, and links between representatives.

    The links are all that a group needs: enough to join every component, none that isn't a link.
    """
    total = docs.count()
    bits = min(BITS_MAX, max(BITS_MIN, math.ceil(math.log2(max(1, COUNTERS * total)))))
    full = COUNTERS * total > 1 << bits
    levels, used, hist, stands = statistics(docs, words, bits, full)
    order = Order(levels, percent, boundary(hist, used, percent, stands))
    signed = materialize(_signatures(docs, words, order, full), "signed")
    classes = materialize(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
    first = signed.where("n > 0").join(classes.select(F.col("rep").alias("doc_id"), "class"), ["doc_id", "class"], "left_semi").groupBy("doc_id").agg(*[F.min_by(c, "class").alias(c) for c in ("n", "class", "rare", "prefix", "single", "pairs")])
    reps = materialize(first, "reps")
    if full:
        reps = materialize(_with_keys(reps, order), "reps")
    columns = ["doc_id", "n", "rare"]
    entries = reps.select(*columns, F.lit(1).alias("kind"), F.explode("single").alias("key")).unionByName(reps.select(*columns, F.lit(2).alias("kind"), F.explode("pairs").alias("key")))
    lead = F.min(F.struct("rare", "doc_id"))["doc_id"]
    lists = entries.groupBy("kind", "key").agg(F.count("*").alias("m"), lead.alias("leader")).where("m > 1")
    entries = materialize(entries.join(lists, ["kind", "key"]), "entries")

    def matched(left: DataFrame, right: DataFrame, *more) -> DataFrame:
        """Pairs of one key whose sizes allow a link."""
        x, y = left.alias("x"), right.alias("y")
        near = (F.col("x.doc_id") < F.col("y.doc_id")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        on = (F.col("x.kind") == F.col("y.kind")) & (F.col("x.key") == F.col("y.key")) & near
        for m in more:
            on = on & m
        return x.join(y, on).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()

    def led(rows: DataFrame) -> DataFrame:
        """Each set with the leader of its key."""
        own = rows.where("doc_id <> leader").select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b"))
        return own.distinct()

    few, many = entries.where(f"m <= {FEW}"), entries.where(f"m > {FEW}")
    pairs = materialize(_possible(matched(few, few).unionByName(led(many)).distinct(), reps, percent), "pairs")
    links = materialize(_verified(pairs, docs, words, percent), "links")
    key = ["kind", "key"]
    if many.limit(1).count():
        for turn in range(LEADERS + 1):  # what isn't yet in one component: with another leader, at last all with all
            found = components(links).select(F.col("node").alias("doc_id"), "root")
            by_set = many.groupBy("doc_id").agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.collect_list(F.struct(*key)).alias("keys"))
            rooted = by_set.join(found, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))  # a set's component is looked up once
            placed = rooted.select("doc_id", "n", "rare", "root", F.explode("keys").alias("k")).select("doc_id", "n", "rare", "root", "k.*")
            # of every key one set for each component, and the best two of these
            best = placed.groupBy(*key, "root").agg(F.min(F.struct("rare", "doc_id")).alias("lead"))
            place = F.row_number().over(Window.partitionBy(*key).orderBy("lead"))
            second = materialize(best.withColumn("place", place).where("place <= 2").where("place = 2").select(*key, F.col("lead.doc_id").alias("leader"), F.col("root").alias("led")), "seconds")
            many = materialize(placed.join(second, key), "placed")  # only keys of several components
            if turn < LEADERS:
                more = led(many.where("root <> led"))
            else:
                deep = many.join(reps.select("doc_id", "prefix"), "doc_id")
                more = matched(deep, deep, F.col("x.root") != F.col("y.root"), _enough("x.prefix", "x.n", "y.prefix", "y.n", percent))
            more = materialize(_possible(more, reps, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
            links = links.unionByName(materialize(_verified(more, docs, words, percent), "links"))
            pairs = pairs.unionByName(more)
    return signed.select("doc_id", "n", "class").join(classes, "class", "left"), links


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    bounded_batches(docs.sparkSession, 1000, 8 << 20)
    rows, links = similar_links(docs, words, percent)
    roots = components(links).select(F.col("node").alias("rep"), "root")
    out = rows.join(roots, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents: 3-word shingles, 90 percent."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)
