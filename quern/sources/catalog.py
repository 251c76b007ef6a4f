"""Catalog helpers: filtered views, schema documents, inferred foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filtered_view(spark: SparkSession, df: DataFrame, name: str, hidden: str) -> None:
    """A temporary view without the rows for which `hidden` holds. A filter, not a security boundary."""
    df.filter(f"not coalesce({hidden}, false)").createOrReplaceTempView(name)


def introspect(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, type, position of every column."""
    rows = [(t, c, k, i) for t, df in tables.items() for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table string, column string, type string, position int")


def schema_document(tables: dict[str, DataFrame], rows: int = 3, clip: int = 60) -> str:
    """DDL-like text of each table with its first rows, cells clipped."""
    out = []
    for name, df in tables.items():
        out.append(f"CREATE TABLE {name} ({', '.join(f'{c} {k}' for c, k in df.dtypes)})")
        for r in df.select(*[F.substring(F.col(c).cast("string"), 1, clip).alias(c) for c in df.columns]).limit(rows).collect():
            out.append("  " + " | ".join("NULL" if v is None else v for v in r))
    return "\n".join(out)


def inferred_keys(spark: SparkSession, tables: dict[str, DataFrame], strip_prefix: bool = False) -> DataFrame:
    """child, column, parent: a column named as the first column (the key) of exactly one other table."""
    bare = lambda c: c.lower().split("_", 1)[-1] if strip_prefix else c.lower()
    columns = spark.createDataFrame([(t, c, bare(c)) for t, df in tables.items() for c in df.columns], "child string, column string, bare string")
    keys = spark.createDataFrame([(t, bare(df.columns[0])) for t, df in tables.items()], "parent string, bare string")
    only = keys.groupBy("bare").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).filter("n = 1").drop("n")
    return columns.join(only, "bare").filter("child <> parent").select("child", "column", "parent")
