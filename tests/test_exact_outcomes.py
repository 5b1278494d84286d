"""Outcomes and verdicts decided by 10,000 resamples."""

import numpy as np
import pytest

from ranklane.operators import compare
from ranklane.plans import registry

DELTAS = {"lexical": np.linspace(-0.2, 0.5, 25), "c": np.linspace(-0.3, 0.31, 25)}


@pytest.fixture
def given(spark, monkeypatch):
    def deltas(spark, sf, system="lexical"):
        return spark.createDataFrame([("dev", f"{k:02}", float(x)) for k, x in enumerate(DELTAS[system])], "split string, query_id string, delta double").repartition(3)

    monkeypatch.setattr(registry, "deltas", deltas)


def interval(d):
    rng = np.random.default_rng(compare.SEED)
    return np.quantile([d[rng.integers(0, len(d), size=len(d))].mean() for _ in range(10_000)], [0.025, 0.975])


def test_intervals_of_10000_resamples(spark, given):
    found = {r["system"]: r for r in registry.QUERIES["three_way_numpy_exact"](spark, "").collect()}
    for system, d in DELTAS.items():
        assert (found[system]["ci_low"], found[system]["ci_high"]) == pytest.approx(tuple(interval(d)), abs=1e-12)
    assert {s: r["outcome"] for s, r in found.items()} == {"lexical": "improvement_confirmed", "c": "inconclusive_positive"}
    assert registry.QUERIES["ml_outcome_numpy_exact"](spark, "").first() == found["lexical"]
    assert registry.QUERIES["control_verdict_numpy_exact"](spark, "").first()["verdict"] == "WARN"
