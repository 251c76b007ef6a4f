"""Field scoring, classification and ranking metrics, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.windows import running_totals


def outcome(truth: Column, predicted: Column) -> Column:
    """Five-way outcome of one field; NULL is an answer of its own (abstention)."""
    return (
        F.when(truth.isNull() & predicted.isNull(), "TRUE_ABSTAIN")
        .when(truth.isNull(), "HALLUCINATE")
        .when(predicted.isNull(), "ABSTAIN")
        .when(truth == predicted, "HIT")
        .otherwise("WRONG")
    )


def field_metrics(long: DataFrame, keys: Sequence[str], result: str = "outcome") -> DataFrame:
    """Precision, recall, F1 and hallucination rate from five-way outcomes, one row per field outcome.

    A rate with a zero denominator is NULL; F1 is NULL where precision or recall is NULL or 0.
    """
    n = lambda name: F.count_if(F.col(result) == name)
    counts = long.groupBy(*keys).agg(*[n(x).alias(x.lower()) for x in ("HIT", "WRONG", "ABSTAIN", "HALLUCINATE", "TRUE_ABSTAIN")])
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    h, w, a, x, t = (F.col(c) for c in ("hit", "wrong", "abstain", "hallucinate", "true_abstain"))
    p, r = ratio(h, h + w + x), ratio(h, h + w + a)
    out = counts.withColumns({"precision": p, "recall": r, "hallucination": ratio(x, x + t)})
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1)


def exact_match(long: DataFrame, key: str, result: str = "outcome") -> DataFrame:
    """key, exact: every valued field hit and nothing hallucinated."""
    return long.groupBy(key).agg(F.bool_and(F.col(result).isin("HIT", "TRUE_ABSTAIN")).alias("exact"))


def class_report(df: DataFrame, truth: str, predicted: str, labels: DataFrame | None = None) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1, support; undefined rates are 0.

    A NULL prediction is a miss of its class and no false positive. labels fixes the classes (one column, label).
    """
    by_truth = df.groupBy(F.col(truth).alias("label")).agg(
        F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(predicted)).alias("tp")
    )
    by_pred = df.filter(F.col(predicted).isNotNull()).groupBy(F.col(predicted).alias("label")).agg(F.count_if(F.col(truth) != F.col(predicted)).alias("fp"))
    j = by_truth.join(by_pred, "label", "full_outer")
    if labels is not None:
        j = labels.join(j, "label", "left")
    j = j.na.fill(0, ["support", "tp", "fp"]).withColumn("fn", F.col("support") - F.col("tp"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    j = j.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn)})
    pr = F.col("precision") + F.col("recall")
    return j.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), pr)).select("label", "tp", "fp", "fn", "precision", "recall", "f1", "support")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row, auc: Mann-Whitney with average ranks for ties, from counts by score (one row per distinct score)."""
    by = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    ranked = running_totals(by, [score], {"upto": "n"}).withColumn("before", F.col("upto") - F.col("n"))
    s = ranked.agg(F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row, ap: sum over distinct scores, falling, of the gain in recall times the precision."""
    by = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    cum = running_totals(by.withColumn("__falling", -F.col(score)), ["__falling"], {"tp": "p", "seen": "n"})
    return cum.agg((F.sum(F.col("p") * F.col("tp") / F.col("seen")) / F.sum("p")).alias("ap"))


def plurality_vote(votes: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """keys, consensus, agreement, n_opinions, undecided: the most frequent opinion; NULL opinions do not vote.

    A tie for the top has no consensus. Agreement is the top's share of opinions.
    """
    counted = votes.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    best = counted.withColumns({"total": F.sum("n").over(w), "top": F.max("n").over(w)}).filter("n = top")
    out = best.groupBy(*keys).agg(F.count("*").alias("ways"), F.min(value).alias("__v"), F.first("top").alias("top"), F.first("total").alias("n_opinions"))
    every = votes.select(*keys).distinct().join(out, list(keys), "left")
    return every.select(
        *keys,
        F.when(F.col("ways") == 1, F.col("__v")).alias("consensus"),
        (F.col("top") / F.col("n_opinions")).alias("agreement"),
        F.coalesce("n_opinions", F.lit(0)).cast("long").alias("n_opinions"),
        F.coalesce(F.col("ways") != 1, F.lit(True)).alias("undecided"),
    )


def krippendorff_alpha(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """One row, alpha: nominal agreement with missing ratings; units with one rating do not count.

    1 where all pairable ratings are the same value; NULL under two pairable ratings.
    """
    c = ratings.filter(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count("*").alias("n"))
    c = c.withColumn("m", F.sum("n").over(W.partitionBy(unit))).filter("m > 1")
    per_unit = c.groupBy(unit).agg(F.first("m").alias("m"), F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("d"))
    total = per_unit.agg(F.sum("m").alias("n"), F.sum("d").alias("d"))
    squares = c.groupBy(value).agg(F.sum("n").alias("nc")).agg(F.sum(F.col("nc") * F.col("nc")).alias("sq"))
    n, d, sq = F.col("n"), F.col("d"), F.col("sq")
    alpha = F.when(n < 2, F.lit(None)).when(n * n == sq, F.lit(1.0)).otherwise(1 - (n - 1) * d / (n * n - sq))
    return total.crossJoin(squares).select(alpha.cast("double").alias("alpha"))
