"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

Each document's tokens end with a separator. A document longer than a sequence is cut into full pieces, the
first piece taking the remainder; full pieces are sequences of their own, so only one piece per document
is packed. Pieces are dealt to partitions of a bounded number of pieces; each is packed by best-fit decreasing. A
dual-feasible function f maps sizes so that what fits into one bin sums to at most 1: the sum over a
partition, rounded up, bounds its bins from below. Where bins and bound agree the partition is certified
optimal and final. From the others ("gaps"), the documents in their least filled bins are pooled,
dealt anew to fewer partitions and packed again, for a bounded number of rounds, as long as that saves bins; the rest stays.

Null text is empty text: one piece of length 1, the separator. Rows that repeat are packed as often
as they occur. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import bounded_batches, keyed_text, materialize, release_memory
from ranklane.llm.parts import COMMON, common_strings, gather, text_units

#: Tokens of a sequence, the id that ends a document, and pieces packed together.
CAPACITY, END, GROUP = 1024, 2, 32768
#: Rounds of exchange between partitions with gaps.
ROUNDS = 2
#: Bytes of text that are encoded together.
CHUNK_BYTES = 4 << 20
SPECIAL = "<|endoftext|>"
#: ASCII letters, visible ASCII characters, and marks: those that are neither letters nor digits.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_VISIBLE = np.array([33 <= b <= 126 for b in range(256)])
_MARK = _VISIBLE & np.array([not chr(b).isalnum() for b in range(256)])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def finer(units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of ``units``, the pieces of each one after the other (as positions), and how many each has.

    They are cut at places that no word of the tokenizer spans: from a letter to a mark, and around a line break between two
    characters that aren't white space, as far as ASCII and the letters of Latin-1 go. So a word that stands before different
    marks or lines is one piece in all of them. A unit with the special string is left whole.
    """
    texts = pa.array(units, pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[: len(units) + 1]
    if not len(units) or not bounds[-1]:
        return [], np.zeros(0, np.int64), np.zeros(len(units), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[: bounds[-1]]
    letter = _LETTER[raw]  # the last byte of one
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    last = letter | _VISIBLE[raw]
    first = _VISIBLE[raw]
    first[:-1] |= (raw[:-1] == 0xC3) & letter[1:]
    line = np.flatnonzero((raw[1:-1] == 10) & last[:-2] & first[2:]) + 1
    places = np.concatenate([np.flatnonzero(letter[:-1] & _MARK[raw[1:]]) + 1, line, line + 1])
    special = pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
    if special.any():
        places = places[~special[np.searchsorted(bounds, places, side="right") - 1]]
    starts = np.unique(np.concatenate([bounds[:-1][np.diff(bounds) > 0], places]))
    ends = np.append(starts, bounds[-1])
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), texts.buffers()[2]).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype(np.int64), np.diff(np.searchsorted(starts, bounds))


class Tokens:
    """Ids of texts, as the tokenizer gives them.

    The ids of a text's parts follow one another. The distinct parts of many texts are encoded together, a line break
    between two: it is a word of its own there, and its id tells where a part ends. Only the ids of given common parts
    (their strings, ids and how many each has) are known from one call to the next.
    """

    def __init__(self, path: str, common: tuple[list[str], np.ndarray, np.ndarray] = ([], np.zeros(0, np.uint32), np.zeros(0, np.int64))) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known = {p: k for k, p in enumerate(common[0])}
        self.ids, self.sizes = common[1:]

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts one after the other, and how many each has."""
        plain = [k for k, p in enumerate(parts) if "\n" not in p and SPECIAL not in p] if len(self.line) == 1 else []
        groups = [plain[k : k + 2000] for k in range(0, len(plain), 2000)]
        ids, which, counts = [], [], []
        done = np.zeros(len(parts), bool)
        for own in groups:  # one by one: an encoding is many times as large as its ids
            e = self.tokenizer.encode_batch_fast(["\n".join([parts[k] for k in own])], add_special_tokens=False)[0]
            all_ = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(all_ == self.line[0])
            if len(ends) == len(own) - 1:
                ids.append(np.delete(all_, ends))
                counts.append(np.diff(np.concatenate([[-1], ends, [len(all_)]])) - 1)
                which.append(own)
                done[own] = True
        rest = np.flatnonzero(~done).tolist()
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([parts[k] for k in rest], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.array([len(e.ids)]))
            which.append([k])
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        order = np.concatenate(which).astype(np.int64)
        n = np.concatenate(counts).astype(np.int64)
        sizes = np.zeros(len(parts), np.int64)
        sizes[order] = n
        starts = np.zeros(len(parts), np.int64)
        starts[order] = np.cumsum(n) - n
        return gather(np.concatenate(ids), starts, sizes, np.arange(len(parts))), sizes

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and where each text's begin (one more at the end)."""
        units, codes, bounds = text_units(texts, special=SPECIAL)
        parts, of, counts = finer(units)
        at = np.array([self.known.get(p, -1) for p in parts], np.int64)
        new = np.flatnonzero(at < 0)
        flat, sizes = self.encode_parts([parts[k] for k in new.tolist()])
        # of the common parts followed by the new ones
        at[new] = len(self.sizes) + np.arange(len(new))
        flat, sizes, of = np.concatenate([self.ids, flat]), np.concatenate([self.sizes, sizes]), at[of]
        # of the units, each made of its parts
        flat, until = gather(flat, np.cumsum(sizes) - sizes, sizes, of), np.concatenate([[0], np.cumsum(sizes[of])])
        sizes = np.diff(until[np.concatenate([[0], np.cumsum(counts)])])
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        return gather(flat, np.cumsum(sizes) - sizes, sizes, codes), ends[bounds]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with ``n`` ids: full ones, but for the first."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def common_parts(docs: DataFrame, path: str, most: int = COMMON) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The common parts of a sample, their ids one after the other, and how many each has."""

    def listed(texts):
        units, codes, _ = text_units(texts, special=SPECIAL)
        parts, of, counts = finer(units)
        return parts, np.bincount(of, np.repeat(np.bincount(codes, minlength=len(units)), counts), len(parts)).astype(np.int64)

    def spell(batches):
        own = Tokens(path)
        for b in batches:
            flat, sizes = own.encode_parts(b.column(0).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["word", "ids"])

    words, held = common_strings(keyed_text(docs), listed, most)
    parts = max(1, min(held // 2000, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    found = words.repartition(parts).mapInArrow(spell, "word string, ids array<int>").toArrow()
    ids = found["ids"].combine_chunks()
    return found["word"].to_pylist(), np.asarray(ids.flatten()).astype(np.uint32), np.diff(np.asarray(ids.offsets)).astype(np.int64)


def document_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """The pieces of every document with the checksum of their ids, and the ids where asked for."""
    bounded_batches(docs.sparkSession, 2000, 4 << 20)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
    tail = np.array([end], "<u4").tobytes()
    shared = docs.sparkSession.sparkContext.broadcast(common_parts(docs, path))  # at most COMMON parts

    def pieces(batches):
        own = Tokens(path, shared.value)
        held, size = [], 0

        def rows():
            found: list[tuple] = []
            table = pa.Table.from_batches(held).combine_chunks()
            flat, at = own.encode_all(table.column(1).combine_chunks())
            for k, doc_id in enumerate(table.column(0).to_pylist()):
                packed = flat[at[k] : at[k + 1]].astype("<u4").tobytes() + tail
                for n, (start, length) in enumerate(cut(len(packed) // 4, capacity)):
                    part = packed[4 * start : 4 * (start + length)]
                    found.append((doc_id, n, start, length, zlib.crc32(part)) + ((np.frombuffer(part, "<i4"),) if ids else ()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column(1).nbytes
            if size >= CHUNK_BYTES:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()
        del own
        release_memory()

    return keyed_text(docs).mapInArrow(pieces, PIECES + ", ids array<int>" * ids)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most bins that a family of dual-feasible functions proves necessary.

    The family: for each threshold k up to half the capacity, sizes over capacity - k count as whole bins, sizes
    under k as nothing, others as themselves (k = 0: the plain volume); and the staircase functions that
    round a size x to floor((m + 1) x / capacity) / m, exact multiples staying x / capacity.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    volume = np.concatenate([[0], np.cumsum(count * size)])
    number = np.concatenate([[0], np.cumsum(count)])
    best = 0
    for k in range(capacity // 2 + 1):
        whole = number[-1] - number[capacity - k + 1]
        middle = volume[capacity - k + 1] - volume[k]
        best = max(best, int(whole + -(-middle // capacity)))
    for m in range(1, 33):
        steps = (m + 1) * size
        even = steps % capacity == 0
        # in units of 1 / (m * capacity)
        value = np.where(even, size * m, steps // capacity * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (m * capacity))))
    return best


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size by best-fit decreasing, and the room that is left in each bin."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[int] = []
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []  # the distinct rooms, in order
    for k in order:
        x = int(sizes[k])
        at = bisect_left(rooms, x)
        if at < len(rooms):
            r = rooms[at]
            b = open_bins[r].pop()
            if not open_bins[r]:
                del open_bins[r]
                rooms.pop(at)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[k], offsets[k] = b, capacity - r
        room[b] = r - x
        if r > x:
            if r - x not in open_bins:
                open_bins[r - x] = []
                insort(rooms, r - x)
            open_bins[r - x].append(b)
    return bins, offsets, np.array(room, np.int64)


def _pack_group(final: bool, capacity: int):
    """Packs one partition; the rows of a gap partition's least filled bins are marked as loose."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "ids_crc32"], ascending=[False, True, True], na_position="last").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins, offsets, room = best_fit(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        loose = np.zeros(len(pdf), bool)
        gap = len(room) - bound
        if gap > 0 and not final:
            # beside the bins above the bound, twice as many give their documents up, so that sizes can mix
            loose = np.isin(bins, np.argsort(-room, kind="stable")[: 3 * gap])
        return pdf.assign(bin=bins, offset=offsets, bound=bound, bins=len(room), loose=loose)

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (PIECES, each once) with sequence_id and offset, and bins and bound of the partition that packed it
    (null for a full piece): where they agree, the partition is certified optimal.

    Sequence ids are unique over rounds and partitions: bits for round and partition come before the bin's. Loose rows that
    would need as many bins again, or more, keep their places.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    none = F.lit(None).cast("long")
    full = pieces.where(F.col("length") == capacity)
    out = [full.select(*names, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), none.alias("bins"), none.alias("bound"))]
    rest = pieces.where(F.col("length") < capacity)
    schema = PIECES + ", part long, bin long, offset long, bound long, bins long, loose boolean"
    before, held = None, 0
    for k in range(rounds + 1):
        total = rest.count()
        if not total:
            break
        parts = max(1, -(-total // group))
        dealt = rest.select(*names, F.pmod(F.xxhash64("doc_id", "piece", F.lit(k)), F.lit(parts)).alias("part"))
        last = k == rounds or (k > 0 and parts == 1)
        packed = materialize(dealt.groupBy("part").applyInPandas(_pack_group(last, capacity), schema), f"pack{k}")
        if before is not None and packed.groupBy("part").agg(F.max("bins").alias("bins")).agg(F.sum("bins")).first()[0] >= held:
            out.append(before)
            break
        number = F.lit(k) * F.lit(1 << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin")
        placed = packed.select(*names, number.alias("sequence_id"), "offset", "bins", "bound", "part", "bin", "loose")
        columns = placed.columns[:-3]
        out.append(placed.where("NOT loose").select(*columns))
        rest = placed.where("loose")
        before, held = rest.select(*columns), rest.select("part", "bin").distinct().count()
        if last:
            break
    joined = out[0]
    for x in out[1:]:
        joined = joined.unionByName(x)
    return joined


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    return pack_pieces(materialize(document_pieces(docs, path), "pieces"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
