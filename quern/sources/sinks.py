"""Writers: Parquet, canonical JSON lines, idempotent tables, partitioned zones, ledgers, reports."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_line(df: DataFrame) -> Column:
    """A row as JSON with its keys in alphabetical order."""
    return F.to_json(F.struct(*sorted(df.columns)))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_jsonl(df: DataFrame, path: str, order: str, one_file: bool = True) -> None:
    """Rows sorted by a key, keys sorted, one line each. one_file is for frozen sets (bounded); else range-partitioned parts."""
    lines = df.select(F.col(order).alias("__o"), canonical_line(df).alias("value"))
    lines = lines.coalesce(1).sortWithinPartitions("__o") if one_file else lines.orderBy("__o")
    lines.select("value").write.mode("overwrite").text(path)


def content_hash(df: DataFrame, order: str) -> str:
    """SHA-256 of the canonical lines in order, each with a newline; rows are streamed, not held."""
    digest = hashlib.sha256()
    for r in df.select(F.col(order).alias("__o"), canonical_line(df).alias("line")).orderBy("__o").toLocalIterator():
        digest.update(r["line"].encode() + b"\n")
    return digest.hexdigest()


def set_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of the rows in any order, as a sum of row hashes (no sort, no collection)."""
    return df.agg(F.sum((F.xxhash64(canonical_line(df)) % (1 << 31)).cast("decimal(38,0)")).cast("string").alias("set_hash"), F.count("*").alias("n"))


def create_table_as(df: DataFrame, name: str, cluster_by: Sequence[str] = ()) -> None:
    """A managed table of the rows, sorted within files by the cluster columns; an older one is replaced."""
    out = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    out.write.mode("overwrite").format("parquet").saveAsTable(name)


def insert_select(df: DataFrame, name: str) -> None:
    df.write.mode("append").insertInto(name)


def append_checkpoint(df: DataFrame, path: str, **meta: str) -> None:
    """Rows appended with their run's settings; read_checkpoint ignores rows of other settings."""
    df.withColumns({f"meta_{k}": F.lit(v) for k, v in meta.items()}).write.mode("append").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, **meta: str) -> DataFrame:
    df = spark.read.parquet(path)
    for k, v in meta.items():
        df = df.filter(F.col(f"meta_{k}") == v)
    return df.drop(*[f"meta_{k}" for k in meta])


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def fill_zone(df: DataFrame, path: str, partition_by: Sequence[str], key: str) -> None:
    """Appends the rows whose key the zone does not hold yet, one folder per value of the partition columns."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df = pending(df, spark.read.parquet(path), key)
    write_parquet(df, path, partition_by, "append")


def append_ledger(spark: SparkSession, path: str, url: str, sha256: str, size: int, rows: int) -> None:
    spark.createDataFrame([(url, sha256, size, rows)], "url string, sha256 string, bytes long, rows long").coalesce(1).write.mode("append").json(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])
