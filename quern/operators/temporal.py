"""Time-ordered operators: sessions, rolling means, streaks, calendars, funnels and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessionize(df: DataFrame, key: str, ts: str, gap: str, tie: str | None = None) -> DataFrame:
    """session_id per row: a new session at a key's first row and after a pause longer than gap, numbered from 1."""
    w = W.partitionBy(key).orderBy(ts, *([tie] if tie else []))
    fresh = F.lag(ts).over(w).isNull() | (F.col(ts) - F.lag(ts).over(w) > F.expr(f"interval {gap}"))
    return df.withColumn("__new", fresh.cast("int")).withColumn("session_id", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def trailing_mean(value: Column, keys: Sequence[str], order: Sequence[str], rows: int, include_current: bool) -> Column:
    """Mean of the last `rows` rows, with or without the current one; NULL until there are that many."""
    first, last = (-(rows - 1), 0) if include_current else (-rows, -1)
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(first, last)
    return F.when(F.count(value).over(w) == rows, F.avg(value).over(w))


def longest_streak(df: DataFrame, key: str, day: str, flag: Column) -> DataFrame:
    """key, streak: longest run of consecutive days on which flag holds; a missing day ends a run. One row per key, day."""
    hot = df.filter(flag).select(key, day)
    island = F.date_sub(F.col(day), F.row_number().over(W.partitionBy(key).orderBy(day)))
    runs = hot.withColumn("__island", island).groupBy(key, "__island").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("streak"))


def weekly_totals(df: DataFrame, day: str, value: Column) -> DataFrame:
    """week_end, total: sums by weeks that end on Sunday, from the first to the last, weeks without rows as 0."""
    weeks = df.groupBy(F.next_day(F.date_sub(F.col(day), 1), "SU").alias("week_end")).agg(F.sum(value).alias("total"))
    span = weeks.agg(F.min("week_end").alias("a"), F.max("week_end").alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week_end"))
    return calendar.join(weeks, "week_end", "left").select("week_end", F.coalesce("total", F.lit(0.0)).alias("total"))


def ordered_funnel(df: DataFrame, key: str, ts: str, step: str, steps: Sequence[str]) -> DataFrame:
    """key, t0, t1, ...: each step's first time strictly after the step before it; NULL where the funnel ends."""
    out = df.filter(F.col(step) == steps[0]).groupBy(key).agg(F.min(ts).alias("t0"))
    for k, name in enumerate(steps[1:], 1):
        later = df.filter(F.col(step) == name).select(F.col(key).alias("__k"), F.col(ts).alias("__t"))
        times = later.join(out.select(key, f"t{k - 1}"), (F.col("__k") == F.col(key)) & (F.col("__t") > F.col(f"t{k - 1}"))).groupBy("__k").agg(F.min("__t").alias(f"t{k}"))
        out = out.join(times, out[key] == times["__k"], "left").drop("__k")
    return out


def retention(users: DataFrame, activity: DataFrame, user: str, signup_month: str, active_month: str) -> DataFrame:
    """cohort, users, retained: users of each month of signup, and of them those active in the month after."""
    nxt = activity.select(F.col(user).alias("__u"), F.col(active_month).alias("__m")).distinct()
    j = users.join(nxt, (users[user] == nxt["__u"]) & (F.add_months(users[signup_month], 1) == nxt["__m"]), "left")
    return j.groupBy(F.col(signup_month).alias("cohort")).agg(F.count("*").alias("users"), F.count("__u").alias("retained"))
