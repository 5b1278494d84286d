"""Encoding, packing, joins, spans and the pipeline, against brute force on small fixtures."""

import hashlib
import math
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest

from ranklane.llm import bpe, components, ngram_join, packing, substring_dedup

ODD = [None, "", "   ", "a  b   c \n d", "x\n y", "\n\n a", "a \n", "<|endoftext|> hi<|endoftext|>", "I'll've don't 12 3", " \t x", "日本 語 x", "a\x00b", "ab " * 2000, "trailing  ", "a\x85 b \x85c", "Ünï—código ñ"]
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_bpe_round_trip(frame):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = list(enumerate(ODD))
    got = {r["doc_id"]: r for r in bpe.encode(frame(rows), path, public_tokenizers.PATTERN, chunk_bytes=200).collect()}
    for k, t in rows:
        ids = coder.encode_ordinary(t or "")
        assert got[k]["ids"] == ids and bytes(got[k]["decoded"]) == (t or "").encode() and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_words_beside_marks_and_lines_are_encoded_once():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = packing.Tokens(path), Tokenizer.from_file(path)
    rng = random.Random(12)
    signs = ["a", "Straße", "don't", "'s", "'", ".", ",", "\n", "\n", " ", " ", "12", "²", "é", "e\u0301", "_", "(", "<|endoftext|>", "\r", "\t", "\x1c", "\x85", "日", "×"]
    texts = ODD + ["".join(rng.choices(signs, k=rng.randrange(1, 30))) for _ in range(3000)]
    flat, at = own.encode_all(pa.array(texts))
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t
    asked, encode = [], own.encode_parts
    own.encode_parts = lambda parts: asked.extend(parts) or encode(parts)
    own.encode_all(pa.array(["so some words. And some\nso more words! some words, (and) some words\nso"]))
    assert sorted(asked) == sorted(["so", " some", " words", ".", " And", "\n", " more", "!", ",", " (and", ")"])


def test_packing(frame):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rows = list(enumerate(ODD)) + [(100 + k, "word " * (37 * k % 700)) for k in range(60)]
    got = packing.pack_documents(frame(rows), path).collect()
    by, bins, total = {}, {}, 0
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, t in rows:
        ids, at = [*own.encode(t or "", add_special_tokens=False).ids, 2], 0
        total += len(ids)
        for n, r in enumerate(sorted(by[k], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part))) and (not n or r["length"] == 1024)
            at += r["length"]
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(total / 1024) + 2


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(1, 1024, rng.integers(1, 60))
        bins, offsets, room = packing.best_fit(sizes)
        assert packing.lower_bound(sizes) <= len(room)
        assert all(sizes[bins == b].sum() == 1024 - room[b] for b in range(len(room)))
    assert packing.lower_bound(np.array([600] * 5)) == 5 and packing.lower_bound(np.array([342] * 6)) == 3


def test_exchange_keeps_every_piece(spark):
    rng = random.Random(6)
    rows = [(k, 0, 0, rng.randint(300, 900), k) for k in range(900)]
    df = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack_pieces(df, group=64, rounds=2).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == [(r[0], r[3]) for r in rows]
    used = {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 1024


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {n: r for n, r in roots(edges, {x for e in edges for x in e if e[0] != e[1]}).items()}
    assert {r["node"]: r["root"] for r in components.components(df).collect()} == want
    assert components.components(df.where("false")).count() == 0


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("words", "percent", "few", "bits"), [(3, 90, 12, 26), (5, 80, 2, 26), (3, 90, 12, 12), (5, 80, 2, 10)])
def test_jaccard_join(frame, monkeypatch, words, percent, few, bits):
    """Also with a sketch that can count only a sample of the documents."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "SLICE", 1 << min(bits, 16))
    monkeypatch.setattr(ngram_join, "BITS_MIN", min(bits, 16))
    monkeypatch.setattr(ngram_join, "BITS_MAX", bits)
    rng = random.Random(words)
    base = [f"w{k}" for k in range(70)]
    texts = [None, "", " ", "a", "A", "a b", "a b c", "a  b\x0bc"]
    texts += [" ".join(x if rng.random() > 0.02 else "edit" + str(rng.randrange(99)) for x in base) for _ in range(25)]  # near copies
    texts += [" ".join(f"q{j + 2 * k}" for j in range(60)) for k in range(15)]  # a chain
    texts += [" ".join([f"own{k}n{j}" for j in range(30)] + base[:30]) for k in range(20)]  # one shared passage
    texts += [" ".join(f"s{j}" for j in range(n)) for n in range(9, 24)]  # small sets
    rows = list(enumerate(texts))
    sets = {k: shingles(t, words) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(links, sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(frame([*rows, (None, texts[10])]), words, percent).collect()}
    assert got.pop(None)[1] is None
    assert got == {k: (len(sets[k]), want[k]) for k in sets}


@pytest.mark.parametrize("bits", [16, 10])
def test_sketch_counts_all_documents(frame, monkeypatch, bits):
    """Also one whose slots hold many shingles each, and counts beyond a byte."""
    monkeypatch.setattr(ngram_join, "SLICE", 1 << min(bits, 12))
    monkeypatch.setattr(ngram_join, "BITS_MIN", bits)
    monkeypatch.setattr(ngram_join, "BITS_MAX", bits)
    seen, statistics = [], ngram_join.statistics
    monkeypatch.setattr(ngram_join, "statistics", lambda *a: seen.append(statistics(*a)) or seen[-1])
    texts = [f"own{k} one{k} " + ("a common passage of all" if k % 2 else f"other{k % 9} a b c") for k in range(1600)]
    ngram_join.similar_links(frame(list(enumerate(texts)), 2), 3, 90)
    levels, used, hist = seen[0][:3]
    counts = np.zeros(1 << bits, np.int64)
    sets = ngram_join.shingle_sets([t.encode() for t in texts], 3)
    for s in sets:
        np.add.at(counts, ngram_join.slot(ngram_join.scrambled(s), np.uint64(64 - bits)).astype(np.int64), 1)
    assert hist.sum() == len(texts) and used.sum() == 1 << bits and counts.max() > 255
    level = np.stack([levels & 15, levels >> 4], 1).ravel()
    assert (level <= 1).tolist() == (counts <= 1).tolist()  # only what no two documents have counts as alone
    by_count = level[np.argsort(counts, kind="stable")].astype(int)
    assert (np.diff(by_count) >= 0).all() and by_count[-1] > by_count[len(by_count) // 2]


def test_substring_dedup(frame):
    passage = "This is a passage that many documents share. It has several sentences, and they run on for a while! Does it end here? It does now."
    rows = [(k, f"Own start number {k} of this text.\n{passage}\nOwn end {k * k} of it.") for k in range(6)] + [(50, None), (51, ""), (52, "Short. Short."), (53, passage + " " + passage), (None, passage)]
    df = frame(rows, 3)
    out = {r["doc_id"]: r for r in substring_dedup.without_repeats(df).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["n_removed"] == 0
    for k in range(1, 6):
        assert "passage" not in out[k]["text"] and "It does now" not in out[k]["text"] and f"number {k}" in out[k]["text"] and f"end {k * k}" in out[k]["text"]
    assert out[53]["text"] == "" and out[None]["text"] == passage and out[50]["text"] is None and out[52]["text"] == "Short. Short."
    assert "kept" in substring_dedup.without_repeats(df).columns and substring_dedup.without_repeats(frame([])).count() == 0


def test_sentences_join_to_the_text():
    for t in [x for x in ODD if x] + ["A. B! C?\n\nD; e", ". . .", "no end"]:
        assert "".join(substring_dedup.sentences(t)) == t


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= seen, name
        seen = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
