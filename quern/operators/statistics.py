"""Paired comparison and exact tests: heavy sums are aggregates, closed forms run on one row of the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired_counts(before: DataFrame, after: DataFrame, key: str, ok: str) -> DataFrame:
    """One row: shared keys, keys of one run only, losses and gains."""
    a, b = before.select(F.col(key).alias("ka"), F.col(ok).alias("a")), after.select(F.col(key).alias("kb"), F.col(ok).alias("b"))
    j = a.join(b, a.ka == b.kb, "full_outer")
    return j.agg(
        F.count_if(F.col("ka").isNotNull() & F.col("kb").isNotNull()).alias("shared"),
        F.count_if(F.col("kb").isNull()).alias("before_only"),
        F.count_if(F.col("ka").isNull()).alias("after_only"),
        F.count_if(F.col("a") & ~F.col("b")).alias("losses"),
        F.count_if(~F.col("a") & F.col("b")).alias("gains"),
    )


def mcnemar_chi2(losses: int, gains: int) -> tuple[float, float]:
    """Chi-squared on one degree with continuity correction, and its p-value; (0, 1) without discordant pairs.

    Equal counts give 1 / n, as the correction is not cut off at zero.
    """
    n = losses + gains
    if not n:
        return 0.0, 1.0
    statistic = (abs(losses - gains) - 1) ** 2 / n
    return statistic, math.erfc(math.sqrt(statistic / 2))


def _masses(log_ratios: np.ndarray) -> np.ndarray:
    """Probabilities of a finite distribution from the logarithms of each one's ratio to the one before."""
    logs = np.concatenate([[0.0], np.cumsum(log_ratios)])
    weights = np.exp(logs - logs.max())
    return weights / weights.sum()


def _binomial_masses(n: int, p: float) -> np.ndarray:
    k = np.arange(n)
    return _masses(np.log((n - k) / (k + 1)) + math.log(p) - math.log1p(-p))


def sign_test(fewer: int, more: int) -> float:
    """Two-sided exact p-value of two counts of a fair coin: both tails as far out as the counts are."""
    n = fewer + more
    away = np.abs(2 * np.arange(n + 1) - n) >= abs(fewer - more)
    return float(min(1.0, _binomial_masses(n, 0.5)[away].sum())) if n else 1.0


def mcnemar_exact(losses: int, gains: int) -> float:
    """Exact p-value of a paired comparison: the sign test of its discordant pairs."""
    return sign_test(losses, gains)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact confidence limits of a proportion: the p at which k or more, and k or fewer, have probability alpha / 2.

    Newton steps on the logarithm of the tail, whose slope has a closed form; a step never leaves the open interval
    that is still possible.
    """

    def limit(least: int, mass: float) -> float:
        """The p with P(X >= least) = mass, for 0 < least <= n."""
        low, high, p = 0.0, 1.0, min(max(least / (n + 1), 1e-9), 1 - 1e-9)
        for _ in range(200):
            masses = _binomial_masses(n, p)
            tail = masses[least:].sum()
            low, high = (p, high) if tail < mass else (low, p)
            # d/dp P(X >= m) = m / p * P(X = m)
            step = p - (math.log(tail) - math.log(mass)) * tail / (least / p * masses[least]) if tail > 0 and masses[least] > 0 else low
            after = step if low < step < high else (low + high) / 2
            if abs(after - p) <= 1e-15 * max(p, 1e-3):
                return after
            p = after
        return p

    if not n:
        return 0.0, 1.0
    return (float(limit(k, alpha / 2)) if k else 0.0), (float(limit(k + 1, 1 - alpha / 2)) if k < n else 1.0)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a 2 x 2 table: the share of tables with its margins that are as unlikely or less."""
    first = max(0, a - d)
    x = np.arange(first, min(a + b, a + c))
    masses = _masses(np.log((a + b - x) * (a + c - x) / ((x + 1.0) * (d - a + x + 1.0))))
    return float(min(1.0, masses[masses <= masses[a - first] * (1 + 1e-9)].sum()))


def minimum_detectable_effect(discordant: float, n: int, z: float = 2.8) -> float:
    """Smallest difference in points that a paired test of n items can show."""
    return 100 * z * math.sqrt(discordant / n) if n else math.inf


def paired_summary(before: DataFrame, after: DataFrame, key: str, ok: str) -> dict:
    """Accuracies, difference, gains, losses, exact p and limits of both accuracies, on the shared keys."""
    a, b = before.select(key, F.col(ok).alias("a")), after.select(key, F.col(ok).alias("b"))
    r = a.join(b, key).agg(
        F.count("*").alias("n"), F.count_if("a").alias("x"), F.count_if("b").alias("y"), F.count_if(F.col("a") & ~F.col("b")).alias("losses"), F.count_if(~F.col("a") & F.col("b")).alias("gains")
    ).first()
    n = r["n"]
    return {
        "n": n, "before": r["x"] / n if n else None, "after": r["y"] / n if n else None, "delta": (r["y"] - r["x"]) / n if n else None,
        "gains": r["gains"], "losses": r["losses"], "p": mcnemar_exact(r["gains"], r["losses"]), "before_ci": clopper_pearson(r["x"], n), "after_ci": clopper_pearson(r["y"], n),
    }


def paired_report(items: DataFrame, unmeasurable: DataFrame, key: str) -> DataFrame:
    """stratum, n, before, after, losses, gains of paired outcomes.

    items has key, before, after, errored, unclosed and strata (an array: an item counts in each). Items that the gold
    answer fails (unmeasurable) and errored ones are left out of both runs; an unclosed reply fails.
    """
    kept = items.filter(~F.col("errored")).join(unmeasurable.select(key), key, "left_anti")
    before, after = F.col("before") & ~F.col("unclosed"), F.col("after") & ~F.col("unclosed")
    rows = kept.select(before.alias("before"), after.alias("after"), F.explode("strata").alias("stratum"))
    b, a = F.col("before"), F.col("after")
    return rows.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(b).alias("before"), F.count_if(a).alias("after"), F.count_if(b & ~a).alias("losses"), F.count_if(a & ~b).alias("gains"))


def bootstrap_interval(df: DataFrame, key: str, value: str, replicates: int = 2000, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """One row, mean, low, high: percentile interval of a mean over Poisson-weighted replicates.

    A row's weights come from its key's hash and the replicate's number by a counter-based mixer, for a block of rows
    at once, so a rerun gives the same replicates in any partitioning. Each row adds to `replicates` running sums in
    its task; only sums are shuffled (replicates rows a task).
    """
    import pandas as pd

    # Cumulative Poisson(1) probabilities: a uniform number's weight is how many of them it reaches.
    reached = np.cumsum(np.exp(-1.0) / np.array([math.factorial(k) for k in range(16)]))
    numbers = np.arange(replicates, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)

    def partial(batches):
        sums, counts = np.zeros(replicates), np.zeros(replicates)
        for pdf in batches:
            keys, values = pdf["h"].to_numpy().view(np.uint64), pdf["v"].to_numpy(float)
            for at in range(0, len(keys), 1024):
                x = keys[at : at + 1024, None] ^ numbers[None]
                for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xFF51AFD7ED558CCD)):
                    x ^= x >> np.uint64(shift)
                    x *= np.uint64(factor)
                w = np.searchsorted(reached, (x >> np.uint64(11)) * 2.0**-53, "right").astype(float)
                sums += values[at : at + 1024] @ w
                counts += w.sum(axis=0)
        yield pd.DataFrame({"rep": np.arange(replicates), "s": sums, "n": counts})

    rows = df.filter(F.col(value).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(value).cast("double").alias("v"))
    means = rows.mapInPandas(partial, "rep int, s double, n double").groupBy("rep").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    low, high = round(alpha / 2 * (replicates - 1)), round((1 - alpha / 2) * (replicates - 1))
    sorted_ = F.sort_array(F.collect_list("m"))
    return means.agg(F.get(sorted_, F.lit(low)).alias("low"), F.get(sorted_, F.lit(high)).alias("high")).join(rows.agg(F.avg("v").alias("mean"))).select("mean", "low", "high")
