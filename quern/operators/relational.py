"""Joins, ranks, merges and comparisons as functions on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark's window group limit drops the rest before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return top_n(df, keys, order, 1, "__rank").drop("__rank")


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, values: Sequence[str], right_ts: str | None = None, tie: str | None = None) -> DataFrame:
    """Backward, inclusive as-of join: each left row gets the values of the latest right row of its key at or before it.

    Both sides are stacked and one window carries the last right row forward, so the plan is one shuffle on the key
    and one sort whatever the sizes; rows without a match are dropped. tie breaks right rows of equal time: the
    largest wins. A right row comes before a left row of the same time.
    """
    right_ts = right_ts or ts
    payload = F.struct(*[F.col(v) for v in values])
    a = left.select(F.col(key).alias("__k"), F.col(ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), F.struct(*left.columns).alias("__left"))
    b = right.select(F.col(key).alias("__k"), F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("__tie"), payload.alias("__right"))
    w = W.partitionBy("__k").orderBy("__t", "__side", "__tie").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__right", True).over(w))
    return both.filter("__side = 1 and __last is not null").select("__left.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Base and updates merged: the newest version of each key, of equal versions the update; new keys are added."""
    both = base.withColumn("__from", F.lit(0)).unionByName(updates.withColumn("__from", F.lit(1)))
    return latest_per_key(both, [key], [F.desc(version), F.desc("__from")]).drop("__from")


def full_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """One row: keys missing on either side and values that differ by more than the tolerance."""
    left = a.select(*keys, F.col(value).alias("va"), F.lit(True).alias("in_a"))
    right = b.select(*keys, F.col(value).alias("vb"), F.lit(True).alias("in_b"))
    j = left.join(right, list(keys), "full_outer")
    return j.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
        F.count_if(F.col("in_a") & F.col("in_b") & ~((F.abs(F.col("va") - F.col("vb")) <= tolerance) | (F.col("va").isNull() & F.col("vb").isNull()))).alias("mismatched"),
    )


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows, duplicates and order ignored."""
    return _empty(a.subtract(b)).join(_empty(b.subtract(a)).withColumnRenamed("empty", "other")).select((F.col("empty") & F.col("other")).alias("equal"))


def bag_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows as often, order ignored."""
    return _empty(a.exceptAll(b)).join(_empty(b.exceptAll(a)).withColumnRenamed("empty", "other")).select((F.col("empty") & F.col("other")).alias("equal"))


def _empty(df: DataFrame) -> DataFrame:
    return df.limit(1).agg((F.count("*") == 0).alias("empty"))


def close(a: Column, b: Column, rtol: float = 1e-3, atol: float = 1e-6) -> Column:
    """Numbers within tolerance; NULL and NaN equal themselves."""
    nan = F.isnan(a) & F.isnan(b)
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False)) | nan | (a.isNull() & b.isNull())


def rows_without_value(keys: DataFrame, scored: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how many keys have no value in scored."""
    return keys.select(key).join(scored.select(key, value), key, "left").agg(F.count_if(F.col(value).isNull()).alias("unscored"))


def topological_order(edges: list[tuple[str, str]], names: list[str]) -> list[str]:
    """Names with parents before children, (child, parent) edges; a cycle is cut at its first name. Driver side: tables."""
    parents: dict[str, list[str]] = {n: [] for n in names}
    for child, parent in edges:
        if child != parent and parent in parents:
            parents[child].append(parent)
    out: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name):
            return
        state[name] = 1
        for parent in sorted(parents[name]):
            visit(parent)
        out.append(name)

    for name in sorted(names):
        visit(name)
    return out


def has_cjk(value: Column) -> Column:
    """Whether a text or any text nested in a struct, array or map has a character of U+4E00 to U+9FFF."""
    return F.to_json(F.struct(value.alias("v"))).rlike("[\u4e00-\u9fff]")
