"""Readers of files and of text columns: CSV, JSON lines, XML, logs, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Delimited files (gzip too) with a header, every column as text; the given schema saves an inference pass."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(paths)


def read_csv_by_name(spark: SparkSession, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Files whose columns drift: each group (one header) is read alone and united by name, missing columns NULL."""
    out = None
    for paths in groups:
        one = spark.read.option("header", True).csv(list(paths))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_jsonl(spark: SparkSession, path, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, torn): parsed lines, and lines that are not JSON; blank lines are neither. torn is counted by the caller."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.from_json("value", f"struct<{schema}>", {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.filter("ok").select("r.*"), parsed.filter("not ok").select(F.col("value").alias("line"))


def read_json_auto(spark: SparkSession, path) -> DataFrame:
    return spark.read.json(path)


def read_xml_rows(spark: SparkSession, path, row_tag: str, fields: Sequence[str], required: str) -> DataFrame:
    """One row per element (gzip too), child elements as text; rows without the required one are dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in fields])
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).filter(F.length(F.trim(required)) > 0)


def forecast_periods(df: DataFrame, key: str, xml: str) -> DataFrame:
    """key, pos and the elements of every <forecast> in an XML column."""
    schema = (
        "struct<forecast:array<struct<fcst_time_from:string,change_indicator:string,wind_dir_degrees:int,"
        "sky_condition:array<struct<_sky_cover:string,_cloud_base_ft_agl:int>>>>>"
    )
    x = df.select(key, F.from_xml(F.col(xml), schema).alias("x"))
    return x.select(key, F.posexplode("x.forecast").alias("pos", "f")).select(
        key, "pos", F.col("f.fcst_time_from").alias("start"), F.col("f.change_indicator").alias("change_type"), F.col("f.wind_dir_degrees").alias("wind_dir"),
        F.transform("f.sky_condition", lambda c: F.concat(c["_sky_cover"], F.lit("@"), c["_cloud_base_ft_agl"].cast("string"))).alias("clouds"),
    )


def read_csv_after_preamble(spark: SparkSession, path, marker: str, required: str) -> DataFrame:
    """A CSV that starts after some preamble at the line with `marker`; of repeated headers the last wins.

    The header is read on the driver; rows are text lines parsed by Spark. Rows without the required value go.
    """
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith(marker)).first()["value"]
    names = header.split(",")
    last = {n: k for k, n in enumerate(names)}
    kept = [n if last[n] == k else f"__{k}" for k, n in enumerate(names)]
    rows = lines.filter(F.col("value").contains(",") & (F.col("value") != header))
    parsed = rows.select(F.from_csv("value", ", ".join(f"`{n}` string" for n in kept)).alias("r")).select("r.*")
    return parsed.select(*last).filter(F.length(F.trim(required)) > 0)


def typed_subset(df: DataFrame, dates: Sequence[str] = (), numbers: Sequence[str] = (), flags: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """Columns by kind: bad dates and numbers NULL, missing flags 0, missing texts empty."""
    return df.select(
        *[F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date").alias(c) for c in dates],
        *[F.col(c).try_cast("double").alias(c) for c in numbers],
        *[F.coalesce(F.col(c).try_cast("double").cast("int"), F.lit(0)).alias(c) for c in flags],
        *[F.coalesce(c, F.lit("")).alias(c) for c in texts],
    )


def last_field_split(value: Column, sep: str = ";") -> tuple[Column, Column]:
    """(text, label): all but the last field, which may hold the separator, and the last field."""
    return F.regexp_extract(value, rf"^(.*){sep}([^{sep}]*)$", 1), F.regexp_extract(value, rf"^(.*){sep}([^{sep}]*)$", 2)


def nested_rows(value: Column) -> Column:
    """Rows of a JSON text in any of three shapes: {"rows": [...]}, a list, or one flat object."""
    row = "map<string,string>"
    wrapped = F.from_json(value, f"struct<rows:array<{row}>>")["rows"]
    listed = F.when(F.trim(value).startswith("["), F.from_json(value, f"array<{row}>"))
    flat = F.when(F.trim(value).startswith("{"), F.array(F.from_json(value, row)))
    return F.coalesce(wrapped, listed, flat)


def ordered_union(spark: SparkSession, *lists: Sequence[str]) -> DataFrame:
    """Names of several lists, first occurrence kept, in order (pos)."""
    rows = [(n, i, k) for i, names in enumerate(lists) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "name string, list int, at int")
    return df.groupBy("name").agg(F.min(F.struct("list", "at")).alias("first")).orderBy("first").select("name", "first.list")


def latest_snapshot(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows of the newest path only; the newest is found by an aggregate and joined back."""
    newest = df.agg(F.max(path).alias("__p"))
    return df.join(F.broadcast(newest), F.col(path) == F.col("__p")).drop("__p")


def run_metrics(runs: DataFrame, value: str) -> DataFrame:
    """run and its metric block, from JSON of two shapes: {"metrics": {...}} or the metrics at the top."""
    parsed = F.coalesce(F.from_json(value, "struct<metrics:map<string,double>>")["metrics"], F.from_json(value, "map<string,double>"))
    return runs.withColumn("metrics", parsed)


def log_requests(lines: DataFrame, pattern: str, start: str, line: str = "value", seq: str = "seq") -> DataFrame:
    """Fields of matching lines of the last section of a log: after the last line that matches start."""
    last = lines.filter(F.col(line).rlike(start)).agg(F.coalesce(F.max(seq), F.lit(-1)).alias("__s"))
    found = lines.join(F.broadcast(last), F.col(seq) > F.col("__s")).filter(F.col(line).rlike(pattern))
    return found.select(seq, F.regexp_extract(line, pattern, 1).cast("long").alias("prompt"), F.regexp_extract(line, pattern, 2).cast("long").alias("cached"))


def reduced_events(events: DataFrame, run: str, seq: str, line: str) -> DataFrame:
    """Per run: counts by type, whether it settled, the last message list; lines that are not JSON are skipped."""
    e = events.select(run, seq, F.from_json(line, "struct<type:string,messages:array<struct<role:string,content:string>>>").alias("e"), F.try_parse_json(line).isNotNull().alias("ok")).filter("ok")
    kinds = e.groupBy(run, "e.type").agg(F.count("*").alias("n")).groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts"))
    ends = e.groupBy(run).agg(F.bool_or(F.col("e.type") == "agent_end").alias("settled"), F.max_by("e.messages", F.when(F.col("e.type") == "agent_end", F.col(seq))).alias("messages"))
    last = F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))
    return kinds.join(ends, run).withColumn("last_text", last["content"])


def notices(df: DataFrame, text: str) -> DataFrame:
    """Clean notices: null, blank and CJK texts go, one row per text, id from its digest."""
    kept = df.filter(F.length(F.trim(text)) > 0).filter(~F.col(text).rlike("[\\u4e00-\\u9fff]"))
    return kept.select(F.substring(F.sha1(text), 1, 12).alias("id"), text).dropDuplicates(["id"])


def sampled_records(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """n records in hash order: uniform over records, where a random byte offset would favour long ones."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def capped_source(df: DataFrame, order: Sequence[str], tokens: Column, cap: int, most_rows: int) -> DataFrame:
    """Rows in order until cap tokens are emitted or most_rows are scanned."""
    from pyspark.sql import Window as W

    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    first = df.orderBy(*order).limit(most_rows)
    return first.withColumn("__cum", F.sum(tokens).over(w)).filter(F.col("__cum") - tokens < cap).drop("__cum")
