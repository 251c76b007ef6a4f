"""Window operators that need more than one window, and distributed row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ranged(df: DataFrame, order: Sequence[str], partitions: int | None) -> DataFrame:
    """Rows range-partitioned by the order, with their partition's number.

    Kept on disk, because it is read twice: a second evaluation could sample other bounds.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)


def running_totals(df: DataFrame, order: Sequence[str], values: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Adds, for each name and column of values, the column's sum over all rows up to and with this one in the order.

    Totals of whole partitions meet in one place (a row each); rows are summed within their range. No window runs
    over the whole table. The order must be total.
    """
    ranged = _ranged(df, order, partitions)
    w = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__s{k}") for k, c in enumerate(values.values())])
    sums = sums.select("__part", *[F.coalesce(F.sum(f"__s{k}").over(earlier), F.lit(0)).alias(f"__b{k}") for k in range(len(values))])
    local = ranged.withColumns({f"__l{k}": F.sum(c).over(w) for k, c in enumerate(values.values())}).join(sums, "__part")
    return local.select(*df.columns, *[(F.col(f"__l{k}") + F.col(f"__b{k}")).alias(n) for k, n in enumerate(values)])


def surrogate_ids(df: DataFrame, order: Sequence[str], name: str = "id", partitions: int | None = None) -> DataFrame:
    """row_number() over a global order without one task for all rows: running totals of ones."""
    one = running_totals(df.withColumn("__one", F.lit(1).cast("long")), order, {name: "__one"}, partitions)
    return one.drop("__one")


def run_segments(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """run per row: a new run starts where the value does not rise; a run (not the first) that starts above twice the
    median start of its key is merged into the run before it."""
    w = W.partitionBy(key).orderBy(*order)
    fresh = F.lag(value).over(w).isNull() | (F.col(value) <= F.lag(value).over(w))
    raw = df.withColumn("__fresh", fresh).withColumn("__run", F.sum(F.col("__fresh").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    starts = raw.filter("__fresh").groupBy(F.col(key).alias("__k")).agg(F.median(value).alias("__med"))
    joined = raw.join(starts, raw[key] == starts["__k"]).drop("__k")
    keep = F.col("__fresh") & ~((F.col(value) > 2 * F.col("__med")) & (F.col("__run") > 1))
    return joined.withColumn("run", F.sum(keep.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__fresh", "__run", "__med")
