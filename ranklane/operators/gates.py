"""Preconditions of a stage, checked on the driver over small reports: reuse of stored results, and gates between stages."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: What a stored shard must share with the current run before it may be used again.
REUSE_KEYS = ("fingerprint", "versions", "file_digest", "schema", "rows", "key_set_digest", "tokens")


def reuse_problems(stored: dict, current: dict, keys: tuple[str, ...] = REUSE_KEYS) -> list[str]:
    """The keys in which a stored shard's sidecar differs from the current run, or that either lacks; empty: reusable."""
    return [k for k in keys if k not in stored or k not in current or stored[k] != current[k]]


@dataclass(frozen=True)
class Gate:
    """A report that must exist with a status, over the same inputs, before a stage may run."""

    report: str
    status: frozenset[str]
    bound_to: tuple[str, ...] = ()

    def problems(self, reports: dict[str, dict], inputs: dict[str, str]) -> list[str]:
        found = reports.get(self.report)
        if found is None:
            return [f"no report {self.report}"]
        out = [] if found.get("status") in self.status else [f"{self.report} is {found.get('status')!r}, not {' or '.join(sorted(self.status))}"]
        return out + [f"{self.report} has another {k}" for k in self.bound_to if found.get(k) != inputs.get(k)]


#: Which reports each stage needs.
STAGES = {
    "candidates": (Gate("reproduction", frozenset({"PASS"}), ("run_digest",)),),
    "scoring": (Gate("smoke", frozenset({"PASS"})),),
    "training": (Gate("control", frozenset({"PASS", "WARN"}), ("pairs_digest",)),),
}


def require(stage: str, reports: dict[str, dict], inputs: dict[str, str]) -> None:
    """Raises with every problem that keeps ``stage`` from running."""
    bad = [p for gate in STAGES[stage] for p in gate.problems(reports, inputs)]
    if bad:
        raise ValueError(f"{stage} may not run: " + "; ".join(bad))


@dataclass(frozen=True)
class Settings:
    """The parameters that results are bound to; ``of`` accepts exactly these, with their types and within their bounds."""

    top_k: int = 100
    k1: float = 0.9
    b: float = 0.4
    max_length: int = 320
    depth: int = 50
    resamples: int = 10_000
    seed: int = 20260802
    practical: float = 0.010
    validation_share: float = 0.15

    @classmethod
    def of(cls, given: dict) -> Settings:
        names = {f.name for f in fields(cls)}
        if set(given) != names:
            raise ValueError(f"missing {sorted(names - set(given))}, unexpected {sorted(set(given) - names)}")
        wrong = [f.name for f in fields(cls) if type(given[f.name]) is not type(f.default)]
        if wrong:
            raise ValueError(f"of another type: {', '.join(wrong)}")
        out = cls(**given)
        bad = [n for n, ok in {"top_k": out.top_k > 0, "b": 0 <= out.b <= 1, "k1": out.k1 >= 0, "depth": 0 < out.depth <= out.top_k, "resamples": out.resamples > 0, "validation_share": 0 < out.validation_share < 1}.items() if not ok]
        if bad:
            raise ValueError(f"out of bounds: {', '.join(bad)}")
        return out
