"""Reuse, gates, settings, ledgers, manifests and shards."""

import pytest

from ranklane.operators import encoding, gates, lineage
from ranklane.sources import corpus


def test_reuse_needs_every_key():
    stored = dict.fromkeys(gates.REUSE_KEYS, "x")
    assert gates.reuse_problems(stored, dict(stored)) == []
    for k in gates.REUSE_KEYS:
        assert gates.reuse_problems(stored | {k: "y"}, stored) == [k]
        assert gates.reuse_problems({a: b for a, b in stored.items() if a != k}, stored) == [k]


def test_gates_between_stages():
    ok = {"control": {"status": "WARN", "pairs_digest": "p"}, "reproduction": {"status": "PASS", "run_digest": "r"}, "smoke": {"status": "PASS"}}
    for stage in gates.STAGES:
        gates.require(stage, ok, {"run_digest": "r", "pairs_digest": "p"})
        with pytest.raises(ValueError, match="no report"):
            gates.require(stage, {}, {})
    with pytest.raises(ValueError, match="another run_digest"):
        gates.require("candidates", ok, {"run_digest": "other"})
    with pytest.raises(ValueError, match="BLOCKED"):
        gates.require("training", ok | {"control": {"status": "BLOCKED", "pairs_digest": "p"}}, {"pairs_digest": "p"})


def test_settings_are_exact():
    good = vars(gates.Settings())
    assert gates.Settings.of(dict(good)) == gates.Settings()
    for change in ({"more": 1}, {"top_k": "100"}, {"b": 1.5}, {"depth": 101}, {"top_k": True}):
        with pytest.raises(ValueError):
            gates.Settings.of(good | change)
    with pytest.raises(ValueError, match="missing"):
        gates.Settings.of({k: v for k, v in good.items() if k != "seed"})


def test_ledger_grows_only_on_a_whole_chain():
    ledger = []
    for k in range(3):
        ledger = lineage.append_event(ledger, {"type": "selection", "n": k}, f"2020-01-0{k + 1}")
    assert [e["sequence"] for e in ledger] == [1, 2, 3] and ledger[2]["previous"] == ledger[1]["digest"]
    with pytest.raises(ValueError, match="event 2"):
        lineage.append_event([ledger[0], ledger[1] | {"n": 9}, ledger[2]], {}, "2021-01-01")
    with pytest.raises(ValueError, match="event 1"):
        lineage.append_event(ledger[1:], {}, "2021-01-01")
    with pytest.raises(ValueError, match="older"):
        lineage.append_event(ledger, {}, "2019-01-01")


def test_declared_digests_of_nested_reports():
    report = {"a": [{"path": "x", "sha256": "1"}, {"b": {"path": "y", "sha256": "2", "more": [{"path": "x", "sha256": "1"}]}}], "path": "no digest"}
    assert lineage.declared_digests(report) == {"x": "1", "y": "2"}
    with pytest.raises(ValueError, match="two digests of x"):
        lineage.declared_digests([report, {"path": "x", "sha256": "3"}])


def test_sequences_of_a_query_are_bounded(spark):
    pairs = spark.createDataFrame([("train", "q", "p", f"n{k}") for k in range(5)] * 2, "split string, query_id string, positive_docid string, negative_docid string")
    assert encoding.sequences_once(pairs, 6).count() == 6
    with pytest.raises(Exception, match="too many sequences of query q"):
        encoding.sequences_once(pairs, 5).collect()


def test_local_shards_in_order(spark, tmp_path):
    for k in (10, 2, 1):
        (tmp_path / f"docs-{k}.jsonl.gz").write_bytes(b"x" * k)
    (tmp_path / "notes.txt").write_text("no shard")
    names = lambda x: [p.rsplit("/", 1)[1] for p in x]
    sizes = {f"docs-{k}.jsonl.gz": k for k in (1, 2, 10)}
    assert names(corpus.local_shards(spark, str(tmp_path), sizes)) == ["docs-1.jsonl.gz", "docs-2.jsonl.gz", "docs-10.jsonl.gz"]
    for wrong in (sizes | {"docs-3.jsonl.gz": 1}, {"docs-1.jsonl.gz": 1}, sizes | {"docs-2.jsonl.gz": 3}):
        with pytest.raises(ValueError, match="docs-"):
            corpus.local_shards(spark, str(tmp_path), wrong)
