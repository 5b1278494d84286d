"""Control pairs: whole groups of fit queries by merged stratum, about 2000 pairs."""

import hashlib

import numpy as np
import pytest

from ranklane.operators import training_pairs
from ranklane.plans import registry


def frames(spark, sizes, role="fit"):
    """sizes: merged stratum -> (queries, pairs of each)."""
    ids = [(f"{s}#{k:03}", s, n) for s, (queries, n) in sizes.items() for k in range(queries)]
    pairs = [("train", q, f"p{k}", f"n{k}") for q, _, n in ids for k in range(n)]
    split = [(q, s, role) for q, s, _ in ids]
    return (
        spark.createDataFrame(pairs, "split string, query_id string, positive_docid string, negative_docid string"),
        spark.createDataFrame(split, "query_id string, merged_stratum string, split_role string"),
    )


def test_whole_groups_until_2000_in_seeded_order(spark):
    rows = training_pairs.control_pairs(*frames(spark, {"1|F+1|T": (300, 16)})).collect()
    assert len(rows) == 2000
    first = int.from_bytes(hashlib.sha256(b"20260805|(1,F)+(1,T)").digest()[:8], "big")
    order = np.random.default_rng(first).permutation(300)[:125]
    assert {r["query_id"] for r in rows} == {f"1|F+1|T#{k:03}" for k in order}
    rows.sort(key=lambda r: (r["merged_stratum"], r["query_id"], min(r["positive_docid"], r["negative_docid"], key=lambda x: x[0] != "p")))
    want = np.random.default_rng(20260804).random(2000) < 0.5
    assert [r["swapped"] for r in rows] == want.tolist()
    assert all((r["positive_docid"][0] == "n") == r["swapped"] for r in rows)


def test_strata_by_their_share(spark):
    rows = training_pairs.control_pairs(*frames(spark, {"0|F+0|T": (30, 10), "3+|T": (90, 10)}), target=400).collect()
    n = {s: len({r["query_id"] for r in rows if r["merged_stratum"] == s}) for s in ("0|F+0|T", "3+|T")}
    assert n == {"0|F+0|T": 10, "3+|T": 30}


def test_other_roles_are_refused(spark):
    with pytest.raises(ValueError, match="aren't fit"):
        training_pairs.control_pairs(*frames(spark, {"1|T": (3, 2)}, role="validation"))


def test_registered_over_judged_pairs_of_fit_queries(spark, monkeypatch):
    seen = {}

    def control_pairs(judged, split, target=2000):
        seen.update(sources={r["negative_source"] for r in judged.collect()}, ids={r["query_id"] for r in judged.collect()}, target=target)
        seen["fit"] = {r["query_id"] for r in split.where("split_role = 'fit'").collect()}
        return judged

    c = [("train" if k % 4 else "dev", str(k), f"d{k}{j}", j + 1, ("relevant", "judged_non_relevant", "unjudged")[j % 3]) for k in range(80) for j in range(60)]
    frame = spark.createDataFrame(c, "split string, query_id string, docid string, bm25_rank long, judgment string")
    monkeypatch.setattr(registry.tb, "candidates", lambda *_: frame)
    monkeypatch.setattr(training_pairs, "control_pairs", control_pairs)
    registry.control_pairs(spark, "")
    assert seen["target"] == 2000 and seen["sources"] == {"judged"}
    assert seen["ids"] and seen["ids"] <= seen["fit"] and not any(int(q) % 4 == 0 for q in seen["ids"])
