"""Training data: strata, splits, weak negatives, balanced pairs."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions.text import hash_fraction

#: Fixed values of the sampling design.
SPLIT_SEED, FRACTION, SMALLEST = 20260803, 0.15, 20
BUCKETS = ((26, 50, 3), (51, 75, 3), (76, 100, 2))
CAP, TARGET = 8, 16
CONTROL_SEED, SHUFFLE_SEED = 20260805, 20260804
BUCKET_LABELS = ("0", "1", "2", "3+")


def query_strata(candidates: DataFrame) -> DataFrame:
    """n_relevant and n_judged_negatives of each query, its bucket, flag and stratum label."""
    rel, neg = F.count_if(F.col("judgment") == "relevant"), F.count_if(F.col("judgment") == "judged_non_relevant")
    one = candidates.groupBy("split", "query_id").agg(rel.cast("int").alias("n_relevant"), neg.cast("int").alias("n_judged_negatives"))
    bucket = F.when(F.col("n_relevant") >= 3, "3+").otherwise(F.col("n_relevant").cast("string"))
    flag = F.col("n_judged_negatives") > 0
    return one.withColumns({"relevant_bucket": bucket, "has_judged_negative": flag}).withColumn("stratum", F.concat("relevant_bucket", F.lit("|"), F.when(flag, "T").otherwise("F")))


def merge_small(sizes: dict[str, int], smallest: int = SMALLEST) -> dict[str, str]:
    """Merged stratum of each label; eight labels at most.

    In canonical order a group under ``smallest`` joins its bucket's other flag, else the group before it (or after the
    first), until none is left that can be merged.
    """
    groups = [[label] for b in BUCKET_LABELS for label in (f"{b}|F", f"{b}|T") if sizes.get(label)]
    count = lambda g: sum(sizes[x] for x in g)
    while len(groups) > 1 and any(count(g) < smallest for g in groups):
        k = next(i for i, g in enumerate(groups) if count(g) < smallest)
        buckets = {x.split("|")[0] for x in groups[k]}
        twin = next((i for i, g in enumerate(groups) if i != k and {x.split("|")[0] for x in g} & buckets), None)
        to = twin if twin is not None else k - 1 if k else 1
        low, high = sorted((k, to))
        groups[low] += groups.pop(high)
    return {label: "+".join(g) for g in groups for label in g}


def with_merged(strata: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """Adds merged_stratum; only the sizes of the at most eight strata reach the driver."""
    sizes = {r["stratum"]: r["count"] for r in strata.groupBy("stratum").count().collect()}
    names = merge_small(sizes, smallest)
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return strata.withColumn("merged_stratum", F.create_map(*pairs)[F.col("stratum")] if pairs else F.col("stratum"))


def split_by_hash(strata: DataFrame, by: str = "stratum", seed: int = SPLIT_SEED, fraction: float = FRACTION) -> DataFrame:
    """The first ceil(fraction * n) of each stratum in the order of a seeded hash are validation."""
    w = Window.partitionBy(by)
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), "query_id"), 256)
    place = F.row_number().over(w.orderBy(key, "query_id"))
    role = F.when(place <= F.ceil(F.lit(fraction) * F.count("*").over(w)), "validation").otherwise("fit")
    return strata.withColumn("split_role", role)


def split_exact(strata: DataFrame, by: str = "merged_stratum", seed: int = SPLIT_SEED, fraction: float = FRACTION) -> DataFrame:
    """The same with NumPy's seeded permutation of each stratum's ids in lexical order."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id", key=lambda s: s.map(lambda x: x.encode())).reset_index(drop=True)
        order = np.random.Generator(np.random.PCG64(seed)).permutation(len(pdf))
        role = np.full(len(pdf), "fit", object)
        role[order[: int(np.ceil(fraction * len(pdf)))]] = "validation"
        return pdf.assign(split_role=role)

    ids = strata.select("query_id", by)
    return ids.groupBy(by).applyInPandas(assign, f"query_id string, {by} string, split_role string")


def _bucketed(candidates: DataFrame) -> DataFrame:
    b = None
    for k, (low, high, _) in enumerate(BUCKETS):
        hit = F.col("bm25_rank").between(low, high)
        b = (F if b is None else b).when(hit, k)
    return candidates.where((F.col("judgment") == "unjudged") & F.col("bm25_rank").between(BUCKETS[0][0], BUCKETS[-1][1])).withColumn("bucket", b)


def weak_negatives(candidates: DataFrame, seed: int = SPLIT_SEED, exact: bool = False) -> DataFrame:
    """Up to eight unjudged candidates of each query from three rank buckets (3, 3 and 2), and a
    round-robin over what is left where a bucket falls short.

    In a bucket the order is a seeded hash or, ``exact``, NumPy's permutation seeded by query and bucket.
    """
    own = _bucketed(candidates).select("split", "query_id", "docid", "bm25_rank", "bucket")
    if exact:

        def order(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["bm25_rank", "docid"]).reset_index(drop=True)
            text = f"{seed}|{pdf['query_id'][0]}|{pdf['bucket'][0]}"
            first = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
            at = np.random.Generator(np.random.PCG64(first)).permutation(len(pdf))
            return pdf.iloc[at].assign(place=np.arange(1, len(pdf) + 1))

        placed = own.groupBy("split", "query_id", "bucket").applyInPandas(order, "split string, query_id string, docid string, bm25_rank long, bucket int, place int")
    else:
        w = Window.partitionBy("split", "query_id", "bucket").orderBy(hash_fraction(F.lit(seed), "query_id", "bucket", "docid"), "docid")
        placed = own.withColumn("place", F.row_number().over(w))
    take = F.element_at(F.array(*[F.lit(n) for _, _, n in BUCKETS]), F.col("bucket") + 1)
    # own share first (round 0); what is left in rounds: first leftover of each bucket, second of each, ...
    turn = F.greatest(F.col("place") - take, F.lit(0))
    w = Window.partitionBy("split", "query_id").orderBy(turn, "bucket", "place")
    return placed.withColumn("choice", F.row_number().over(w)).where(F.col("choice") <= CAP).select("split", "query_id", "docid", "bm25_rank", "choice")


def capacities(per_query: DataFrame, judged: str = "judged_available", weak: str = "weak_available") -> DataFrame:
    """Judged and weak negatives to use of each query: eight each, the spare of sixteen to judged first."""
    j, w = F.least(F.col(judged), F.lit(CAP)), F.least(F.col(weak), F.lit(CAP))
    extra_j = F.least(F.col(judged) - F.col("j"), F.lit(TARGET) - F.col("j") - F.col("w"))
    extra_w = F.least(F.col(weak) - F.col("w"), F.lit(TARGET) - F.col("judged_take") - F.col("w"))
    return (
        per_query.withColumns({"j": j, "w": w})
        .withColumn("judged_take", F.col("j") + F.greatest(extra_j, F.lit(0)))
        .withColumn("weak_take", F.col("w") + F.greatest(extra_w, F.lit(0)))
        .drop("j", "w")
    )


def pairs(candidates: DataFrame, weak: DataFrame | None) -> DataFrame:
    """Positive and negative of each pair, by the closed form of a round-robin over positives.

    With P positives, J judged and W weak negatives to use (both per positive turn), pair t has positive (t - 1) mod P;
    while t is at most J the negative is judged number (t - 1) div P, after that weak number (t - 1 - J) div P.
    """
    at = lambda *order: F.row_number().over(Window.partitionBy("split", "query_id").orderBy(*order)) - 1
    pos = candidates.where("judgment = 'relevant'").select("split", "query_id", F.col("docid").alias("positive_docid"), at("docid").alias("p"))
    neg = candidates.where("judgment = 'judged_non_relevant'").select("split", "query_id", F.col("docid").alias("negative_docid"), F.col("bm25_rank").alias("negative_bm25_rank"), at("bm25_rank", "docid").alias("k")).withColumn("negative_source", F.lit("judged"))
    if weak is not None:
        w = weak.select("split", "query_id", F.col("docid").alias("negative_docid"), F.col("bm25_rank").alias("negative_bm25_rank"), at("bm25_rank", "docid").alias("k")).withColumn("negative_source", F.lit("weak"))
        neg = neg.unionByName(w)
    keys = ["split", "query_id"]
    sizes = pos.groupBy(*keys).agg(F.count("*").alias("P")).join(
        neg.groupBy(*keys).agg(F.count_if(F.col("negative_source") == "judged").alias("nj"), F.count_if(F.col("negative_source") == "weak").alias("nw")), keys
    )
    sized = capacities(sizes.withColumns({"judged_available": F.col("P") * F.col("nj"), "weak_available": F.col("P") * F.col("nw")}))
    turns = sized.select(*keys, "P", "judged_take", "weak_take", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("judged_take") + F.col("weak_take"), F.lit(1)))).alias("t")).where("t <= judged_take + weak_take")
    is_judged = F.col("t") <= F.col("judged_take")
    placed = turns.select(
        *keys,
        ((F.col("t") - 1) % F.col("P")).alias("p"),
        F.when(is_judged, "judged").otherwise("weak").alias("negative_source"),
        F.floor(F.when(is_judged, F.col("t") - 1).otherwise(F.col("t") - 1 - F.col("judged_take")) / F.col("P")).cast("long").alias("k"),
    )
    weight = F.when(F.col("negative_source") == "judged", 1.0).otherwise(0.5).cast("float")
    return placed.join(pos, [*keys, "p"]).join(neg, [*keys, "negative_source", "k"]).select(*keys, "positive_docid", "negative_docid", "negative_source", "negative_bm25_rank", weight.alias("pair_weight"))


def control_pairs(judged: DataFrame, split: DataFrame, target: int = 2000, seed: int = CONTROL_SEED, shuffle_seed: int = SHUFFLE_SEED, swap: float = 0.5) -> DataFrame:
    """Whole query groups of judged pairs, chosen by the largest deficit of their merged stratum until ``target`` pairs, labels swapped by seed.

    ``split`` has query_id, merged_stratum and split_role; pairs of queries that aren't ``fit`` are refused. A stratum's queries
    come in NumPy's permutation seeded by its name. Only one small row for each query reaches the driver; the chosen pairs, about
    ``target`` of them, are swapped in one task.
    """
    if target <= 0:
        raise ValueError("target must be positive")
    sizes = judged.groupBy("query_id").agg(F.count("*").alias("n")).join(split.select("query_id", "merged_stratum", "split_role"), "query_id", "left").collect()
    outside = sorted(r["query_id"] for r in sizes if r["split_role"] != "fit")
    if outside:
        raise ValueError(f"control pairs of queries that aren't fit: {', '.join(outside[:10])}")
    available: dict[str, list] = {}
    for r in sorted(sizes, key=lambda r: r["query_id"]):
        available.setdefault(r["merged_stratum"], []).append(r)
    labels = [f"{b}|{f}" for b in BUCKET_LABELS for f in "FT"]
    members = lambda s: re.findall(r"(?:3\+|[012])\|[FT]", s)
    names = sorted(available, key=lambda s: labels.index(members(s)[0]))
    queues = {}
    for s in names:
        shown = "+".join("({0},{1})".format(*x.split("|")) for x in members(s))  # the reference's name of the stratum
        first = int.from_bytes(hashlib.sha256(f"{seed}|{shown}".encode()).digest()[:8], "big")
        queues[s] = [available[s][k] for k in np.random.Generator(np.random.PCG64(first)).permutation(len(available[s]))]
    share = {s: len(queues[s]) / len(sizes) for s in names}
    chosen, picked, held = [], dict.fromkeys(names, 0), 0
    while held < target and any(picked[s] < len(queues[s]) for s in names):
        open_ = [s for s in names if picked[s] < len(queues[s])]
        s = max(open_, key=lambda x: ((len(chosen) + 1) * share[x] - picked[x], -names.index(x)))
        r = queues[s][picked[s]]
        picked[s] += 1
        held += r["n"]
        chosen.append((r["query_id"], s))
    ids = judged.sparkSession.createDataFrame(chosen, "query_id string, merged_stratum string")
    rows = judged.join(F.broadcast(ids), "query_id").select("split", "query_id", "merged_stratum", "positive_docid", "negative_docid")

    def swapped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="all").sort_values(["merged_stratum", "query_id", "positive_docid", "negative_docid"], key=lambda c: c.map(lambda x: x.encode())).reset_index(drop=True)
        hit = np.random.Generator(np.random.PCG64(shuffle_seed)).random(len(pdf)) < swap
        a, b = pdf["positive_docid"].to_numpy(), pdf["negative_docid"].to_numpy()
        return pdf.assign(positive_docid=np.where(hit, b, a), negative_docid=np.where(hit, a, b), swapped=hit)

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(swapped, "split string, query_id string, merged_stratum string, positive_docid string, negative_docid string, swapped boolean")
