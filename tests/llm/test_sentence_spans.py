"""Substring dedup against a brute force over all spans, and its recall of planted passages."""

import random
import re

from ranklane.llm import substring_dedup as sd


def own_words(rng, n, name):
    return [f"{name}{rng.random():.6f}"[:9] for _ in range(n)]


def prose(rng, n, name):
    """n sentences of 4 to 20 words, with commas."""
    out = []
    for _ in range(n):
        words = own_words(rng, rng.randint(4, 20), name)
        out.append(" ".join(w + rng.choice(["", "", "", ","]) for w in words[:-1]) + f" {words[-1]}{rng.choice('.?!')}")
    return out


def brute(docs):
    """The sentences that go, by a search over every span of at least two sentences and MIN_WORDS words."""
    first, cut = {}, {}
    for doc, text in sorted(docs):
        parts = [p for p in re.split(r"(?<=[.?!])\s+", text) if p]
        cut[doc] = parts
        for i in range(len(parts)):
            for j in range(i + 1, len(parts)):
                if sum(len(p.split()) for p in parts[i : j + 1]) >= sd.MIN_WORDS:
                    first.setdefault(tuple(p.lower() for p in parts[i : j + 1]), (doc, i))
    out = {}
    for doc, parts in cut.items():
        gone = set()
        for i in range(len(parts)):
            for j in range(i + 1, len(parts)):
                # only the shortest spans decide; longer ones consist of them
                n = [len(p.split()) for p in parts[i : j + 1]]
                least = sum(n) >= sd.MIN_WORDS and (j - i == 1 or sum(n[:-1]) < sd.MIN_WORDS or sum(n[1:]) < sd.MIN_WORDS)
                if least and first[tuple(p.lower() for p in parts[i : j + 1])] != (doc, i):
                    gone |= set(range(i, j + 1))
        out[doc] = " ".join(p for k, p in enumerate(parts) if k not in gone)
    return out


def test_equals_brute_force(frame):
    rng = random.Random(7)
    shared = [prose(rng, rng.randint(1, 6), f"s{k}") for k in range(8)]
    docs = []
    for k in range(40):
        parts = prose(rng, rng.randint(0, 4), f"d{k}")
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            at = rng.randint(0, len(parts))
            parts[at:at] = passage[rng.randint(0, 1) :]
        docs.append((k, " ".join(parts)))
    want = brute(docs)
    got = {r["doc_id"]: r["text"] for r in sd.without_repeats(frame(docs, 3)).collect()}
    assert got == want


def test_recall_of_passages_between_other_words(frame):
    """Passages of over 50 words that begin and end within sentences, in prose of its own."""
    rng = random.Random(11)
    rows, planted = [], 0
    for k in range(0, 120, 2):
        words = " ".join(prose(rng, 8, f"p{k}")).split()
        passage = " ".join(words[rng.randint(0, 9) :][: rng.randint(51, 70)])
        for d in (k, k + 1):
            rows.append((d, " ".join(prose(rng, 3, f"a{d}")) + " and " + passage + " then " + " ".join(prose(rng, 3, f"z{d}"))))
        planted += 1
    rows += [(1000 + k, " ".join(prose(rng, 9, f"clean{k}"))) for k in range(40)]
    got = {r["doc_id"]: r for r in sd.without_repeats(frame(rows)).collect()}
    assert sum(got[k + 1]["n_removed"] > 0 for k in range(0, 120, 2)) >= 0.9 * planted
    assert not any(got[k]["n_removed"] for k in range(0, 120, 2)) and not any(got[1000 + k]["n_removed"] for k in range(40))


def test_only_ends_of_sentences_cut():
    assert sd.sentences("Short one, with comma; and more: yes. End") == ["Short one, with comma; and more: yes. ", "End"]
    assert len(sd.sentences("word " * 45 + "end. Next one.")) == 2


def test_text_without_sentences(frame):
    passage = " ".join(f"shared{k}" for k in range(60))
    side = lambda x: " ".join(f"{x}{k}" for k in range(25))
    df = frame([(1, f"{side('a')} {passage} {side('b')}"), (2, f"{side('c')} {passage} {side('d')}")])
    out = {r["doc_id"]: r for r in sd.without_repeats(df).collect()}
    assert out[1]["n_removed"] == 0 and out[2]["n_removed"] > 0
    assert all(w in out[2]["text"] for w in (side("c") + " " + side("d")).split())


def test_long_text_repeated_rows_and_clashing_names(spark):
    rng = random.Random(3)
    long = " ".join(prose(rng, 6000, "long"))
    rows = [(1, long, "a", "b"), (1, long, "a", "b"), (2, long + " Tail.", None, "c"), (None, long, "x", "y"), (3, None, "n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, places string")
    out = sd.cleaned(df).collect()
    by = {(r["own"]["doc_id"], r["own"]["n_removed"]): r for r in out}
    assert by[1, "a"]["removed"] == 0 and by[2, None]["body"] == "Tail." and by[None, "x"]["body"] == long and by[3, "n"]["body"] is None
    assert len(out) == 5
