"""Quantiles by index, exact, without collecting a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def index_quantile(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, tuple[float, str]]) -> DataFrame:
    """keys and the entries at floor(q * n) (kind n, at most n - 1) or floor(q * (n - 1)) (kind n-1) of each sorted group.

    Counts by distinct value come first, so a window runs over distinct values and not over rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    run = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumns({"end": F.sum("c").over(run), "n": F.sum("c").over(W.partitionBy(*keys))})
    out = []
    for name, (q, kind) in wanted.items():
        at = F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))) if kind == "n" else F.floor(F.lit(q) * (F.col("n") - 1))
        out.append(F.min(F.when((F.col("end") > at) & (F.col("end") - F.col("c") <= at), F.col(value))).alias(name))
    return placed.groupBy(*keys).agg(*out)
