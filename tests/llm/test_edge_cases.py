"""Empty tables, repeated rows, ties, very long texts and clashing names, for every operator and stage; brute-force checks."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import regex

import corpus_pipeline
from ranklane.llm import bpe, html_text, language_id, license_scan, ngram_join, packing, quality_rules, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_long_words_repeats_and_names(spark, coder):
    rng = random.Random(3)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(3000))
    texts = ["a" * 20000, letters, "".join(rng.choice("ACGT") for _ in range(20000)), "日本語のテキスト" * 50, "ab " * 30000, "same", "same", "  x  y\tz \n w"]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect():
        assert r["ids"] == coder.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    assert bpe.encode(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_common_words_change_nothing(frame, coder):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(["the", "theatre", "zzqx", "Ünder", "12", "a.b"], k=30))) for k in range(20)]
    want = {k: coder.encode_ordinary(t) for k, t in rows}
    for common in (0, 3, 1000):
        assert {r["doc_id"]: r["ids"] for r in bpe.encode(frame(rows), RANKS, public_tokenizers.PATTERN, common=common).collect()} == want


def test_packing_empty_and_repeated(frame):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack_documents(frame([]), path).count() == 0
    got = packing.pack_documents(frame([(1, "word " * 10)] * 3 + [(None, "word")]), path).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 1, 1] and len({(r["sequence_id"], r["offset"]) for r in got}) == 4
    assert all(r["bins"] >= r["bound"] for r in got)


def test_repacking_never_needs_more_bins(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(k, 0, 0, rng.choice([340, 345, 350, 515, 700]), k) for k in range(700)], packing.PIECES)
    used = [packing.pack_pieces(df, group=50, rounds=n).select("sequence_id").distinct().count() for n in (0, 1, 2)]
    assert used[2] <= used[1] <= used[0]


def test_join_empty_repeated_and_long(frame):
    assert ngram_join.similar_groups(frame([]), 3, 90).count() == 0
    long = " ".join(f"w{k}" for k in range(60000))
    rows = [(1, long), (2, long + " tail"), (2, long + " tail"), (3, "other words here now"), (4, "Other words here now")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(frame(rows), 3, 90).collect()]
    assert sorted(got) == [(1, 59998, 1), (2, 59999, 1), (2, 59999, 1), (3, 2, 3), (4, 2, 3)]


def test_join_of_a_large_near_group(frame):
    """One key with many sets of several components: copies with edits of two base texts that share half of their words."""
    rng = random.Random(2)
    half = [f"h{k}" for k in range(40)]
    rows = []
    for k in range(90):
        base = half + [f"{'ab'[k % 2]}{j}" for j in range(60)]
        base[rng.randrange(100)] = f"edit{k}"
        rows.append((k, " ".join(base)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(frame(rows, 4), 3, 90).collect()}
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(98)} for k, t in rows}
    root = {}
    for k in sets:  # chains of links by a plain search
        root[k] = k
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert got == root


def planted(rng, n, toxic_words):
    """Texts of invented words; every fourth has words of one of two kinds."""
    plain = [f"w{k}x" for k in range(300)]
    rows = []
    for k in range(n):
        words = rng.choices(plain, k=rng.randint(20, 60))
        if k % 4 == 0:
            for w in rng.sample(toxic_words[k // 4 % 2], 2):
                words[rng.randrange(len(words))] = w
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    return rows


def test_toxicity_recall_without_given_words(spark):
    rng = random.Random(12)
    rows = planted(rng, 1200, [[f"rude{k}q" for k in range(6)], [f"vile{k}z" for k in range(6)]])
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, bad) for k, _, bad in rows if k < 800], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    held = [(got[k]["is_toxic"], bad) for k, _, bad in rows if k >= 800]
    assert sum(x for x, bad in held if bad) >= 0.9 * sum(bad for _, bad in held) and sum(x for x, bad in held if not bad) <= 0.02 * len(held)
    # the kinds found tell the two families of words apart
    side = [np.mean([got[k]["p_kind_1"] for k, _, bad in rows if bad and k // 4 % 2 == f]) for f in (0, 1)]
    assert abs(side[0] - side[1]) > 0.5


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "bad " * 50000, "p"), (1, "bad " * 50000, "p"), (2, None, "q")], "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    rows = toxicity.score_toxicity(docs, chain).collect()
    assert len(rows) == 3 and rows[0]["p_toxic"] == rows[1]["p_toxic"] and toxicity.score_toxicity(docs.where("false"), chain).count() == 0


def test_fuzzy_search_equals_an_unseeded_one():
    rng = random.Random(21)
    notices = tuple(license_scan.NOTICES.items())
    plain = [(label, regex.compile(rf"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={len(n) // license_scan.CHARS_PER_EDIT}}}")) for n, label in notices]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            notice = list(rng.choice(notices)[0])
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(notice))
                notice[k : k + rng.randint(0, 1)] = rng.choice(["", "q", " "])
            parts += ["filler words here", "".join(notice)]
        text = " ".join(" ".join(parts).split())
        assert {s[0] for s in license_scan.fuzzy_spans(text, notices)} == {label for label, p in plain if p.search(text)}


def test_license_base_counts_by_brute_force(frame):
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice(["mit", "MIT", "license", "License", "apache", "general", "public", "é", "x1"]) + rng.choice([" ", "-", "\n", ""]) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    rows += [(1000, "general public license " * 20000), (1001, None), (1002, rows[3][1]), (1002, rows[3][1])]
    for r in license_scan.scan_licenses(frame(rows)).collect():
        text = dict(rows)[r["doc_id"]] or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        at = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), sorted({x for _, x in at}))


def test_a_page_that_the_cut_decides():
    """Short lines between long paragraphs of one container are kept by their neighbours, and go among links."""
    weights = tuple(1.0 if f == "words" else -6.0 if f == "links" else 0.0 for f in html_text.FEATURES) + (-1.6,)
    long = "A long sentence that has quite a number of words in it and goes on."
    kept = f"<div><p>{long}</p><p>Two words</p><p>{long}</p></div>"
    gone = "<div><p><a href=x>One link</a></p><p>Two words</p><p><a href=y>Another link</a></p></div>"
    for html, verdict in ((kept, True), (gone, False)):
        found, labels, odds = html_text.labelled(html, weights)
        middle = next(k for k, b in enumerate(found) if b.text == "Two words")
        assert odds[middle] < 0 and labels[middle] is verdict


def test_pages_learn_repeat_and_run_long(spark):
    page = "<nav><a href=/>Home page</a></nav><article>" + "<p>This is a paragraph with many words, and it ends here.</p><p>Few words</p>" * 3000 + "</article><footer>Legal words 2020.</footer>"
    df = spark.createDataFrame([(1, "u", page, "t"), (1, "u", page, "t"), (2, "v", page[:9000], "t"), (3, None, "<p>plain", "t")], "page_id long, url string, html string, text string")
    rows = html_text.extract_text(df).collect()
    assert len(rows) == 4 and rows[0]["text"] == rows[1]["text"] and rows[0]["text"].count("Few words") == 3000 and "Legal" not in rows[0]["text"] and "Home" not in rows[0]["text"]
    assert html_text.extract_text(df.where("false")).count() == 0 and html_text.learn(df.where("false")) == html_text.PRIOR
    weights = html_text.learn(df.where("page_id = 2"))
    assert weights != html_text.PRIOR and weights[html_text.FEATURES.index("article")] > 0


def test_max_flow_of_a_long_undecided_page():
    n = 20000
    labels = html_text.minimum_cut([0.1 * (-1) ** k for k in range(n)], {(k, k + 1): 0.8 for k in range(n - 1)})
    assert len(set(labels)) == 1


def brute_grams(text):
    raw = b"    " + "".join(c.lower() if c.isascii() and c.isupper() else c if c.islower() and c.isascii() or not c.isascii() else " " for c in text).encode() + b"    "
    grams = [raw[i : i + 4] for i in range(len(raw) - 3)]
    return [g for g in grams if g[1] != 32 and g[2] != 32]


def test_filters_against_exact_sets():
    rng = random.Random(4)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(60)] for x, letters in (("a", "abcdeist"), ("b", "nopqretu"), ("c", "äöüenist"))}
    text = lambda x: " ".join(rng.choices(words[x], k=20))
    rows = [(x, text(x)) for x in "abc" for _ in range(30)]
    f = language_id.LanguageFilter(rows)
    counts = {x: Counter(g for lang, t in rows if lang == x for g in brute_grams(t)) for x in "abc"}
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    own = {x: {g for g, s in share[x].items() if s >= language_id.SHARE * max(share[y].get(g, 0) for y in "abc")} for x in "abc"}
    tests = [text(x) for x in "abcabcabc"] + ["", "..."]
    hits, n = f.hits([t.encode() for t in tests])
    for k, t in enumerate(tests):
        grams = brute_grams(t)
        assert n[k] == len(grams)
        assert hits[k] == pytest.approx([sum(g in own[x] for g in grams) for x in f.languages], abs=0.02 * len(grams) + 0.5)


def test_language_ties_repeats_and_empty(spark):
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate([("same words here", "a"), ("same words here", "b"), ("same words here", "a")])], "doc_id long, text string, lang string")
    f = language_id.learn(docs)
    assert {r["lang_pred"] for r in language_id.identify(docs.unionAll(docs), f).collect()} == {"a"}  # the more frequent language
    assert language_id.identify(docs.where("false"), f).count() == 0


def test_quality_long_texts_and_names(spark):
    long = " ".join(f"word{k}" for k in range(30000))
    df = spark.createDataFrame([(1, long, "mine"), (2, "x", "mine")], "doc_id long, text string, rejected_by string")
    out = quality_rules.keep_good(df, quality_rules.PIPELINE_RULES)
    assert out.columns == df.columns and [(r["doc_id"], r["rejected_by"]) for r in out.collect()] == [(1, "mine")]


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_repeats_and_clashing_names(spark, name):
    good = " ".join(f"word{k}" for k in range(60)) + ". And one more sentence of a few words follows here."
    other = " ".join(f"thing{k}" for k in range(60)) + "."
    schema = "doc_id long, text string, n_removed string, component_id string, own string, n_chars int"
    rows = [(1, good, "a", "b", "c", len(good)), (1, good, "a", "b", "c", len(good)), (2, other, None, None, None, len(other)), (3, None, "n", "n", "n", None), (None, other + " x", "z", "z", "z", 5), (4, "", "", "", "", 0)]
    df = spark.createDataFrame(rows, schema)
    out = STAGES[name](spark, df, "")
    if name == "best_fit_packing":
        assert out.count() == len(rows) and STAGES[name](spark, df.where("false"), "").count() == 0
        return
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    got = out.collect()
    assert {r["doc_id"] for r in got} >= {1, 2} and all(tuple(r) in rows for r in got)
    empty = STAGES[name](spark, df.where("false"), "")
    assert empty.columns == df.columns and empty.count() == 0


def test_run_equals_stage_by_stage_brute_force(spark, tmp_path):
    """The whole pipeline over a small table whose outcome is known."""
    rng = random.Random(1)
    sentence = lambda name: " ".join(f"{name}{rng.randrange(10**6)}" for _ in range(14)) + "."
    body = {k: " ".join(sentence(f"d{k}w") for _ in range(6)) for k in range(8)}
    shared = " ".join(sentence("shared") for _ in range(4))
    rows = [(k, t) for k, t in body.items()]
    rows += [(20, body[0].upper()), (21, body[1] + " tail"), (22, "too short"), (23, None), (30, body[6] + " " + shared), (31, body[7].replace("d7w", "other") + " " + shared)]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # rules drop 22 and 23; of 0 and 20 the larger id stays; of 1 and 21 the smaller; 30 loses the sentences of 6, and 31 the shared ones
    assert {r["doc_id"] for r in got} == {20, 1, 2, 3, 4, 5, 6, 7, 30, 31}
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = dict(rows) | {30: shared, 31: body[7].replace("d7w", "other")}
    for r in got:
        assert r["length"] == len(own.encode(want[r["doc_id"]], add_special_tokens=False).ids) + 1, r["doc_id"]
