"""Digests, ledgers and manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_set_digest(df: DataFrame, a: str, b: str) -> DataFrame:
    """Order-independent digest of a set of key pairs: SHA-256 over the sorted lines' digests in a fixed fan-in.

    Lines are hashed where they lie; 4096 groups are digested in order, then the digests of the groups. No
    group of a large set holds more than its 4096th part.
    """
    line = df.select(F.sha2(F.concat_ws("\t", a, b), 256).alias("h")).distinct()
    groups = line.groupBy(F.substring("h", 1, 3).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count("*").alias("n"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ""), 256).alias("digest"), F.sum("n").alias("keys"))


def chain_violations(ledger: DataFrame) -> DataFrame:
    """Events of a hash chain whose sequence, previous digest or time doesn't follow their predecessor's.

    ``ledger``: chain, sequence, ts, previous, digest.
    """
    w = Window.partitionBy("chain").orderBy("sequence")
    before = ledger.withColumns({"seq0": F.lag("sequence").over(w), "digest0": F.lag("digest").over(w), "ts0": F.lag("ts").over(w)})
    return before.groupBy("chain").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("sequence") != F.coalesce(F.col("seq0") + 1, F.lit(1))).alias("bad_sequence"),
        F.count_if(F.coalesce("previous", F.lit("")) != F.coalesce("digest0", F.lit(""))).alias("bad_previous"),
        F.count_if(F.col("ts") < F.col("ts0")).alias("bad_time"),
    )


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and status (added, removed, changed) of what differs between two manifests (path, digest)."""
    a, b = before.withColumnRenamed("digest", "old"), after.withColumnRenamed("digest", "new")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full_outer").withColumn("status", status).where("status IS NOT NULL").select("path", "status")


def canonical_digest(value) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def fingerprint(components: dict, required: set[str]) -> str:
    """Cache key of a stage; exactly the required components must be given."""
    if set(components) != required:
        raise ValueError(f"missing {sorted(required - set(components))}, unexpected {sorted(set(components) - required)}")
    return canonical_digest(components)


def declared_digests(value, path: str = "") -> dict[str, str]:
    """path -> digest of everything that a nested report declares (objects with ``path`` and ``sha256``); two digests of one path are an error."""
    out: dict[str, str] = {}
    todo = [value]
    while todo:
        at = todo.pop()
        if isinstance(at, dict):
            if isinstance(at.get("path"), str) and isinstance(at.get("sha256"), str) and out.setdefault(at["path"], at["sha256"]) != at["sha256"]:
                raise ValueError(f"two digests of {at['path']}")
            todo += at.values()
        elif isinstance(at, list):
            todo += at
    return out


def event_digest(event: dict) -> str:
    return canonical_digest({k: v for k, v in event.items() if k != "digest"})


def append_event(ledger: list[dict], event: dict, ts: str) -> list[dict]:
    """``ledger`` with one more event, after its whole chain was verified: sequence, previous digest, own digest, and times that don't fall."""
    previous, last = None, ""
    for k, e in enumerate(ledger, 1):
        if e["sequence"] != k or e["previous"] != previous or e["digest"] != event_digest(e) or e["ts"] < last:
            raise ValueError(f"the chain is broken at event {k}")
        previous, last = e["digest"], e["ts"]
    if ts < last:
        raise ValueError("the new event is older than the last")
    new = event | {"sequence": len(ledger) + 1, "previous": previous, "ts": ts}
    return [*ledger, new | {"digest": event_digest(new)}]
