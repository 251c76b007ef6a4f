"""Database variants, equality of queries over them, typed tables of synthetic domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.learning import uniform
from quern.operators.relational import set_equal


def grown(df: DataFrame, rows: int, key: str, parents: Mapping[str, Sequence] | None = None, salt: str = "v") -> DataFrame:
    """A table of `rows` rows like df: keys unique by construction, other values half reused, a tenth NULL.

    Numbers move within their span, dates by up to a year; foreign keys are skewed to the first parents. The values
    that are reused are those of the 1000 rows (a sample, the feature) first by the hash of their key, in that order, so
    a rerun gives the same table.
    """
    parents = parents or {}
    h = F.xxhash64(F.lit(salt), F.col(key))
    sample = df.withColumn("__h", h).orderBy("__h", key).limit(1000)
    listed = F.array_sort(F.collect_list(F.struct("__h", *df.columns)))
    values = sample.agg(listed.alias("__all")).select(*[F.col(f"__all.{c}").alias(c) for c in df.columns if c != key])
    ids = df.sparkSession.range(rows).select("id")
    out = ids.join(F.broadcast(values)) if len(df.columns) > 1 else ids
    cols = []
    for f in df.schema.fields:
        u, v, n = uniform(F.col("id"), salt + f.name), uniform(F.col("id"), salt + f.name + "r"), uniform(F.col("id"), salt + f.name + "n")
        if f.name == key:
            cols.append(F.col("id").cast(f.dataType).alias(f.name))
            continue
        if f.name in parents:
            choice = F.array(*[F.lit(p) for p in parents[f.name]])
            at = F.floor(F.lit(len(parents[f.name])) * u * u * u).cast("int")
            cols.append(F.get(choice, at).cast(f.dataType).alias(f.name))
            continue
        old = F.get(F.col(f.name), F.floor(u * F.size(f.name)).cast("int"))
        if isinstance(f.dataType, T.NumericType):
            new = (old + (v - 0.5) * (F.array_max(f.name) - F.array_min(f.name))).cast(f.dataType)
        elif isinstance(f.dataType, T.DateType):
            new = F.date_add(old, F.floor((v - 0.5) * 730).cast("int"))
        else:
            new = old
        cols.append(F.when(n >= 0.1, F.when(v < 0.5, old).otherwise(new)).alias(f.name))
    return out.select(*cols)


def same_on_variants(spark: SparkSession, predicted: str, gold: str, variants: Sequence[Mapping[str, DataFrame]]) -> bool:
    """Whether two queries give the same rows (as sets, columns by position) on every variant; gold must return something."""
    for tables in variants:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        g = spark.sql(gold)
        if not g.limit(1).count():
            return False
        p = spark.sql(predicted)
        if len(p.columns) != len(g.columns) or not set_equal(p.toDF(*[f"c{k}" for k in range(len(p.columns))]), g.toDF(*[f"c{k}" for k in range(len(g.columns))])).first()["equal"]:
            return False
    return True


def verified(spark: SparkSession, replies: Sequence[dict], rebuild) -> list[dict]:
    """Replies with a status: rebuild_mismatch where gold does not reproduce the truth on rebuilt tables, else verified,
    wrong or error. Replies are grouped by their table's key (domain, seed, n), each built once."""
    out, built = [], None
    for r in sorted(replies, key=lambda r: r["table_key"]):
        if built != r["table_key"]:
            for name, df in rebuild(r["table_key"]).items():
                df.createOrReplaceTempView(name)
            built = r["table_key"]
        try:
            truth = spark.sql(r["gold"]).first()[0]
            status = "rebuild_mismatch" if truth != r["truth"] else None
            if status is None:
                status = "verified" if spark.sql(r["sql"]).first()[0] == truth else "wrong"
        except Exception as e:  # any failure of an answer is its own status
            status = f"error: {type(e).__name__}"
        out.append({**r, "status": status})
    return out


def rechecked(spark: SparkSession, replies: Sequence[dict], tables, seed: int, fresh: Sequence[int]) -> list[dict]:
    """Replies with a status on the tables of a seed, and held: verified there and equal to gold on all fresh seeds."""

    def states(one: int) -> list[str]:
        for name, df in tables(one).items():
            df.createOrReplaceTempView(name)
        truths = {g: spark.sql(g).first()[0] for g in {r["gold"] for r in replies}}
        rows = verified(spark, [{**r, "table_key": str(one), "truth": truths[r["gold"]], "at": k} for k, r in enumerate(replies)], lambda key: tables(int(key)))
        return [r["status"] for r in sorted(rows, key=lambda r: r["at"])]

    here, later = states(seed), [states(one) for one in fresh]
    return [{**r, "status": x, "held": x == "verified" and all(y[k] == "verified" for y in later)} for k, (r, x) in enumerate(zip(replies, here))]


DOMAINS = {
    "trips": ("fare", ["city", "driver"]), "orders": ("amount", ["status", "channel"]), "visits": ("minutes", ["ward", "kind"]), "loans": ("principal", ["grade", "purpose"]),
    "tickets": ("hours", ["queue", "priority"]), "shipments": ("weight", ["carrier", "mode"]), "calls": ("seconds", ["agent", "topic"]), "rides": ("distance", ["bike", "member"]),
    "meals": ("price", ["menu", "table_kind"]), "claims": ("payout", ["branch", "cause"]), "parcels": ("cost", ["zone", "service"]), "lessons": ("score", ["subject", "level"]),
}


def domain_table(spark: SparkSession, domain: str, seed: int, rows: int) -> DataFrame:
    """id, ts, city, a number and category columns of a synthetic domain; the same for a seed in any partitioning."""
    number, categories = DOMAINS[domain]
    i, salt = F.col("id"), f"{domain}{seed}"
    cities = F.array(*[F.lit(c) for c in ("Lisbon", "Oslo", "Lima", "Osaka")])
    pick = lambda array, s, n: F.get(array, F.floor(uniform(i, salt + s) * n).cast("int"))
    kinds = F.array(*[F.lit(x) for x in ("red", "green", "blue")])
    ts = F.timestamp_seconds(F.lit(1_767_225_600) + F.floor(uniform(i, salt + "t") * 31_536_000))
    return spark.range(rows).select(
        i.alias(f"{domain}_id"), ts.alias(f"{domain}_ts"), pick(cities, "c", 4).alias(f"{domain}_city"), F.round(uniform(i, salt + "v") * 100, 2).alias(number), *[pick(kinds, c, 3).alias(c) for c in categories]
    )


def audit(lines: DataFrame, text: str, rules: Mapping[str, str]) -> DataFrame:
    """Rows with the names of the rules (regular expressions) that their text breaks."""
    flags = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in rules.items()]), lambda x: x.isNotNull())
    return lines.withColumn("flags", flags)
