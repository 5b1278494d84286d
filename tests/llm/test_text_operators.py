"""Rules, dedup, licences, languages, toxicity and pages, against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest

from ranklane.llm import exact_dedup, html_text, language_id, license_scan, quality_rules, toxicity

EDGES = [(1, None), (2, ""), (3, "  \t "), (4, "One word"), (5, "one word"), (5, "one word"), (None, "no id"), (6, "Ünï 漢字\n\n\nx")]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, frame):
    rng = random.Random(3)
    rows = EDGES[:5] + EDGES[-1:] + [(10 + k, "\n".join(" ".join(rng.choices(["a", "b#", "c|d", "é"], k=rng.randint(0, 9))) for _ in range(rng.randint(1, 9)))) for k in range(40)]
    out = quality_rules.quality_verdicts(frame(rows), counts=True).collect()
    w = quality_rules.W
    got = {r["doc_id"]: tuple(r[w + c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in out}
    assert got == {k: brute_quality(t) for k, t in rows}
    lazy = {r["doc_id"]: r["rejected_by"] is None for r in quality_rules.quality_verdicts(frame(rows)).collect()}
    assert lazy == {r["doc_id"]: r["rejected_by"] is None for r in out}


def test_quality_keeps_clean_and_columns(frame):
    good = " ".join(f"word{k}" for k in range(80))
    df = frame([(1, good), (2, None), (3, "same words here " * 40)])
    out = quality_rules.keep_good(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [1]
    assert quality_rules.keep_good(frame([])).count() == 0


@pytest.mark.parametrize("budget", [1, 192 << 20])
def test_exact_dedup(frame, budget):
    rng = random.Random(5)
    rows = EDGES + [(100 + k, rng.choice(["Hot", "hot", "HOT"]) if k % 3 else f"t{rng.randint(0, 40)}") for k in range(300)]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for k, t in rows:
        groups.setdefault(lower(t), []).append(k)
    want = sorted(
        str((k, best := max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]), k == best, hashlib.sha256(lower(t).encode()).hexdigest())) for k, t in rows
    )
    got = exact_dedup.exact_duplicates(frame(rows, 3), budget).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert exact_dedup.exact_duplicates(frame([])).count() == 0


def test_keep_one(frame):
    df = frame([(1, "a"), (2, "A"), (2, "A"), (3, "b"), (3, "b"), (4, None), (5, "")])
    out = exact_dedup.keep_one(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3, 5]


def test_spill_recursion_leaves_no_files(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    rows = [(hash((k % 50, "x")) & (1 << 64) - 1, str(k % 50).encode(), k, 1) for k in range(500)]
    merged = {c: (keep, n) for _, c, keep, n in exact_dedup.grace(iter(rows), budget=300)}
    assert merged == {str(k).encode(): (450 + k, 10) for k in range(50)} and not list(tmp_path.iterdir())


def test_licenses(frame):
    rows = EDGES + [(20, "The MIT License. apache-license; General  Public\nLicense"), (21, "Released undr the MIT licence, and more"), (22, "license mit"), (23, "x " * 5000 + "mit license")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame(rows)).collect()}
    assert (got[20]["n_words"], got[20]["n_base"], got[20]["first_word"], got[20]["last_word"], got[20]["base_labels"]) == (8, 3, 1, 5, ["apache", "gpl", "mit"])
    assert got[21]["n_base"] == 0 and got[21]["labels"] == ["mit"] and 0 < got[21]["score"] < 1 and got[21]["spans"][0]["edits"] == 2
    assert got[22]["n_base"] == 0 and got[22]["labels"] == [] and got[22]["first_word"] is None
    assert got[23]["first_word"] == 5000 and got[1]["n_words"] == 0
    assert license_scan.scan_licenses(frame([])).count() == 0


def test_fuzzy_search_finds_all_within_bound():
    rng = random.Random(7)
    notices = tuple(license_scan.NOTICES.items())
    for notice, label in notices:
        for _ in range(10):
            text = list(notice)
            for _ in range(len(notice) // license_scan.CHARS_PER_EDIT):
                k = rng.randrange(len(text))
                kind = rng.randrange(3)
                text[k : k + (kind != 0)] = [] if kind == 1 else ["q"]
            found = license_scan.fuzzy_spans("aa bb " + "".join(text) + " cc", notices)
            assert label in {x[0] for x in found}


def test_language(spark):
    words = {"a": ["tion", "ther", "ing"], "b": ["über", "schön", "icht"], "c": ["ñoso", "mente", "ción"]}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(words[x], k=12)), x) for k in range(90) for x in ["abc"[k % 3]]] + [(900, None, "a"), (901, "12 34", "a"), (902, "", None), (903, "tion ther " * 4000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.learn(docs.where(f"NOT ({language_id.HELD_OUT})"))
    got = {r["doc_id"]: r for r in language_id.identify(docs, filters).collect()}
    assert all(got[k]["lang_pred"] == x for k, _, x in rows[:90]) and got[903]["lang_pred"] == "a"
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language_id.learn(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.held_out(5) == spark.sql(f"SELECT {language_id.HELD_OUT} AS x FROM (SELECT 5 AS doc_id)").first()["x"]


def test_masks_hold_all_learned_grams():
    f = language_id.LanguageFilter([("a", "hello world"), ("b", "bonjour monde")])
    hits, n = f.hits([b"hello world", b"bonjour monde"])
    assert hits.argmax(axis=1).tolist() == [f.languages.index("a"), f.languages.index("b")] and (hits[[0, 1], hits.argmax(axis=1)] >= n - 1e-9).all()


def test_toxicity(spark):
    rng = random.Random(2)
    plain = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(400):
        words = rng.choices(plain, k=20)
        bad = k % 4 == 0
        if bad:
            words[rng.randrange(20)] = rng.choice(["idiot", "trash", "zzzqa", "zzzqb"])
        rows.append((k, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 300] + [(None, 1), (5, None)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, chain).collect()}
    assert [got[k]["is_toxic"] for k, _, bad in rows if k >= 300] == [bool(bad) for k, _, bad in rows if k >= 300]
    assert len(got) == 402 and not got[1000]["is_toxic"]
    empty = toxicity.train(docs, labels.where("false"))
    assert {r["p_toxic"] for r in toxicity.score_toxicity(docs, empty).collect()} == {0.0}


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="home"><nav><ul><li><a href=/x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies on this site for all.</div><main><article><h1>Head &amp; line</h1><p>First   long paragraph of the article, with <b>bold</b>text and words.
<p>Second paragraph&nbsp;here &#233;.<ul><li>one</li><li>two</li></ul><div class="ad-box">Buy now cheap things today.</div><form>Name <input></form></article></main>
<section id="comments"><p>Great article, I liked reading it very much.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, None, ""), (4, "w", "<p>Only a text of some words here."), (5, "x", "<div" * 2000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert got[1]["text"] == "Head & line First long paragraph of the article, with boldtext and words. Second paragraph here é. one two"
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "Only a text of some words here."


def test_minimum_cut_is_minimal():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        smooth = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        own = lambda x, keep: np.logaddexp(0, -x) if keep else np.logaddexp(0, x)
        cost = lambda lab: sum(own(x, k) for x, k in zip(odds, lab, strict=True)) + sum(w for (i, j), w in smooth.items() if lab[i] != lab[j])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.minimum_cut(odds, smooth)) == pytest.approx(best)
