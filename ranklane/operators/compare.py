"""Paired comparison of systems: differences, bootstrap intervals, outcomes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions.text import hash_fraction

#: The practical threshold of the outcome, the tolerance of a tie, and the default seed.
PRACTICAL, TIE, SEED = 0.010, 1e-12, 20260802


def paired(system: DataFrame, baseline: DataFrame, metric: str = "ndcg_at_10") -> DataFrame:
    """split, query_id, baseline, system and delta of every query. A query that only one side has is an error when rows are computed."""
    a = baseline.select("split", "query_id", F.col(metric).alias("baseline"), F.lit(True).alias("_a"))
    b = system.select("split", "query_id", F.col(metric).alias("system"), F.lit(True).alias("_b"))
    alone = F.when(F.col("_a").isNull(), "baseline").when(F.col("_b").isNull(), "system")
    lost = F.raise_error(F.concat(F.lit("query "), F.col("query_id"), F.lit(" is missing in the "), alone)).cast("double")
    both = a.join(b, ["split", "query_id"], "full_outer")
    checked = {c: F.when(alone.isNotNull(), lost).otherwise(F.col(c)) for c in ("baseline", "system")}
    return both.select("split", "query_id", *[x.alias(c) for c, x in checked.items()]).withColumn("delta", F.col("system") - F.col("baseline"))


def summary(deltas: DataFrame, *by: str) -> DataFrame:
    d = F.col("delta")
    return deltas.groupBy(*by).agg(
        F.count("*").alias("queries"),
        F.count_if(d >= TIE).alias("improved"),
        F.count_if(d <= -TIE).alias("degraded"),
        F.count_if(F.abs(d) < TIE).alias("ties"),
        F.avg(d).alias("mean_delta"),
        F.expr("percentile(delta, 0.5)").alias("median_delta"),
        F.min(d).alias("min_delta"),
        F.max(d).alias("max_delta"),
    )


def bootstrap_by_hash(deltas: DataFrame, resamples: int = 10_000, seed: int = SEED) -> DataFrame:
    """Percentile interval of the mean over resamples whose draws are hashes of (seed, resample, draw).

    Relational throughout: numbered queries meet resamples x draws on the drawn number.
    """
    numbered = deltas.select("delta", (F.row_number().over(Window.orderBy("split", F.col("query_id"))) - 1).cast("long").alias("i"))
    n = deltas.count()
    spark = deltas.sparkSession
    draws = spark.range(resamples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("k"))
    drawn = draws.select("b", (hash_fraction(F.lit(seed), "b", "k") % max(n, 1)).alias("i"))
    means = drawn.join(F.broadcast(numbered) if n <= 1_000_000 else numbered, "i").groupBy("b").agg(F.sum(F.col("delta").cast("decimal(28,15)")).cast("double").alias("total"))
    mean = means.select((F.col("total") / F.lit(float(max(n, 1)))).alias("m"))
    return mean.agg(F.count("*").alias("resamples"), F.expr("percentile(m, 0.025)").alias("ci_low"), F.expr("percentile(m, 0.975)").alias("ci_high"))


def bootstrap_exact(deltas: DataFrame, resamples: int = 10_000, seed: int = SEED, level: float = 0.95) -> DataFrame:
    """The interval from NumPy's PCG64 draws over the query-ordered differences, one per query of one split."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(["split", "query_id"])["delta"].to_numpy()
        rng = np.random.Generator(np.random.PCG64(seed))
        means = np.concatenate([d[rng.integers(0, len(d), size=(min(500, resamples - at), len(d)))].mean(axis=1) for at in range(0, resamples, 500)])
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([{"queries": len(d), "mean_delta": d.mean(), "ci_low": low, "ci_high": high}])

    return deltas.select("split", "query_id", "delta").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "queries long, mean_delta double, ci_low double, ci_high double")


def outcome(mean: Column, low: Column, high: Column, practical: float = PRACTICAL) -> Column:
    """One of six labels: direction first by the interval, then by the mean. A mean outside its interval is an error."""
    return (
        F.when(~((low <= mean) & (mean <= high)), F.raise_error(F.concat(F.lit("the mean is outside its interval: "), F.concat_ws(" ", low, mean, high))).cast("string"))
        .when((low > 0) & (mean >= practical), "improvement_confirmed")
        .when(low > 0, "positive_below_practical_threshold")
        .when(high < 0, "degradation_confirmed")
        .when(F.abs(mean) < TIE, "no_detectable_change")
        .when(mean > 0, "inconclusive_positive")
        .when(mean < 0, "inconclusive_negative")
        .otherwise("no_detectable_change")
    )


def control_verdict(mean: Column, low: Column, valid: Column) -> Column:
    return F.when(~valid, "FAIL").when(low > 0, "BLOCKED_FOR_REVIEW").when(mean > 0, "WARN").otherwise("PASS")


def gate(local: DataFrame, published: DataFrame) -> DataFrame:
    """metric, local, published, tolerance and PASS or FAIL."""
    ok = F.abs(F.col("local_value") - F.col("published_value")) <= F.col("tolerance")
    return local.join(published, "metric").withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


def tie_policy(descending: Column, ascending: Column, tolerance: float = 1e-9) -> Column:
    """Which tie policy's metric vector agrees with an external one, by the largest absolute differences of both."""
    down, up = descending <= tolerance, ascending <= tolerance
    return F.when(up & ~down, "docno_asc").when(down & ~up, "docno_desc").when(up & down, "inconclusive_metric_equivalent").otherwise("no_policy_matches")


def best_epochs(rows: DataFrame) -> DataFrame:
    """The best epoch of each run (the earliest of equal ones), and which run is selected (the first in order of equal ones).

    ``rows``: run, priority, epoch, ndcg; a few rows for each run.
    """
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("ndcg"), "epoch"))
    best = rows.withColumn("place", place).where("place = 1").drop("place")
    first = best.agg(F.max(F.struct("ndcg", (-F.col("priority")).alias("order"), "run")).alias("b")).select(F.col("b.run").alias("chosen"))
    return best.join(F.broadcast(first), F.col("run") == F.col("chosen"), "left").select("run", "epoch", "ndcg", F.col("chosen").isNotNull().alias("selected"))
