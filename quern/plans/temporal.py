"""Sessions, rolling windows, streaks, calendars, funnels, cohorts over the events and orders tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import temporal as T
from quern.plans.registry import Query
from quern.session import table as t

QUERIES: list[Query] = []


def q(name, sql=None):
    def add(f):
        QUERIES.append(Query(name, f, sql))
        return f

    return add


@q("w3_sessionise", """WITH x AS (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
   SELECT event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_id FROM x""")
def _(s, d):
    return T.sessionize(t(s, d, "events"), "user_id", "ts", "30 minutes", "event_id").select("event_id", "session_id")


def _daily(s, d):
    return t(s, d, "events").groupBy((F.col("user_id") % 10).alias("g"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))


_DAILY = "dl AS (SELECT user_id % 10 AS g, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1,2)"


@q("w4_trailing_deviation", f"""WITH {_DAILY}, r AS (SELECT g, day, v, CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END AS m FROM dl WINDOW w AS (PARTITION BY g ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
   SELECT g, CAST(day AS VARCHAR) AS day, round(v-m,6) AS deviation FROM r WHERE m IS NOT NULL ORDER BY round(v-m,6) DESC, g, day LIMIT 1""")
def _(s, d):
    m = T.trailing_mean(F.col("v"), ["g"], ["day"], 7, include_current=False)
    return (
        _daily(s, d).withColumn("m", m).filter("m is not null").select("g", F.col("day").cast("string").alias("day"), F.round(F.col("v") - F.col("m"), 6).alias("deviation")).orderBy(F.desc("deviation"), "g", "day").limit(1)
    )


@q("w5_rolling_mean", f"""WITH {_DAILY}, r AS (SELECT g, day, avg(v) OVER w AS m, count(*) OVER w AS n FROM dl WINDOW w AS (PARTITION BY g ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
   SELECT g, CAST(day AS VARCHAR) AS day, round(m,6) AS mean FROM r WHERE n = 4""")
def _(s, d):
    m = T.trailing_mean(F.col("v"), ["g"], ["day"], 4, include_current=True)
    return _daily(s, d).withColumn("m", m).filter("m is not null").select("g", F.col("day").cast("string").alias("day"), F.round("m", 6).alias("mean"))


@q("w6_streak", f"""WITH {_DAILY}, h AS (SELECT g, day - CAST(row_number() OVER (PARTITION BY g ORDER BY day) AS INTEGER) AS island FROM dl WHERE v > 19),
   r AS (SELECT g, island, count(*) AS n FROM h GROUP BY 1,2) SELECT g, max(n) AS streak FROM r GROUP BY 1""")
def _(s, d):
    return T.longest_streak(_daily(s, d), "g", "day", F.col("v") > 19)


@q("a37_weekly_resample", """WITH w AS (SELECT CAST(o_orderdate AS DATE) + CAST((7 - isodow(o_orderdate)) % 7 AS INTEGER) AS week_end, sum(o_totalprice) AS total FROM orders GROUP BY 1),
   c AS (SELECT CAST(unnest(generate_series((SELECT min(week_end) FROM w)::TIMESTAMP, (SELECT max(week_end) FROM w)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week_end)
   SELECT CAST(c.week_end AS VARCHAR) AS week_end, round(coalesce(total,0),2) AS total FROM c LEFT JOIN w USING (week_end)""")
def _(s, d):
    o = t(s, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return T.weekly_totals(o, "day", F.col("o_totalprice")).select(F.col("week_end").cast("string").alias("week_end"), F.round("total", 2).alias("total"))


@q("l10_ordered_funnel", """WITH a AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type='view' GROUP BY 1),
   b AS (SELECT a.user_id, min(e.ts) AS t1 FROM a JOIN events e ON e.user_id=a.user_id AND e.event_type='click' AND e.ts > t0 GROUP BY 1),
   c AS (SELECT b.user_id, min(e.ts) AS t2 FROM b JOIN events e ON e.user_id=b.user_id AND e.event_type='purchase' AND e.ts > t1 GROUP BY 1)
   SELECT (SELECT count(*) FROM a) AS viewed, (SELECT count(*) FROM b) AS clicked, (SELECT count(*) FROM c) AS bought""")
def _(s, d):
    f = T.ordered_funnel(t(s, d, "events"), "user_id", "ts", "event_type", ["view", "click", "purchase"])
    return f.agg(F.count("t0").alias("viewed"), F.count("t1").alias("clicked"), F.count("t2").alias("bought"))


@q("l11_cohort_retention", """WITH u AS (SELECT o_custkey, min(date_trunc('month',o_orderdate)) AS cohort FROM orders GROUP BY 1), m AS (SELECT DISTINCT o_custkey, date_trunc('month',o_orderdate) AS mo FROM orders)
   SELECT strftime(cohort,'%Y-%m-%d') AS cohort, count(*) AS users, count(m.o_custkey) AS retained FROM u LEFT JOIN m ON u.o_custkey=m.o_custkey AND m.mo = u.cohort + INTERVAL 1 MONTH GROUP BY 1""")
def _(s, d):
    o = t(s, d, "orders").select("o_custkey", F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("mo"))
    r = T.retention(o.groupBy("o_custkey").agg(F.min("mo").alias("cohort_month")), o, "o_custkey", "cohort_month", "mo")
    return r.withColumn("cohort", F.col("cohort").cast("string"))


@q("f37_weekday_self_check", "SELECT true AS all_agree")
def _(s, d):
    """Seven known dates under the four numberings."""
    from quern.functions.scalar import weekday_numbers

    known = s.createDataFrame([(f"2026-06-0{k}", k) for k in range(1, 8)], "day string, iso int")
    n = weekday_numbers(F.col("day").cast("date"))
    want = {"iso": F.col("iso"), "sun0": F.col("iso") % 7, "sun1": F.col("iso") % 7 + 1, "mon0": F.col("iso") - 1}
    return known.agg(*[F.bool_and(n[k] == want[k]).alias(k) for k in want]).select((F.col("iso") & F.col("sun0") & F.col("sun1") & F.col("mon0")).alias("all_agree"))


@q("x_tumbling_window", "SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY 1,2")
def _(s, d):
    ev = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("string").alias("start"), "event_type", "n")


@q("x_session_window", """WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, sum(fresh)::BIGINT AS sessions FROM x GROUP BY 1""")
def _(s, d):
    ev = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))


@q("l9_probe_counts", """SELECT count(*) FILTER (WHERE isodow(ts)=6) AS saturdays, (SELECT (extract(hour FROM ts)+5)::BIGINT % 24 FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_utc,
   round(count(*) FILTER (WHERE event_type='purchase') / count(*) FILTER (WHERE event_type IN ('purchase','view')),6) AS share FROM events""")
def _(s, d):
    ev = t(s, d, "events")
    peak = ev.groupBy(((F.hour("ts") + 5) % 24).cast("long").alias("peak_utc")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "peak_utc").limit(1).select("peak_utc")
    buys = F.count_if(F.col("event_type") == "purchase")
    return ev.agg(F.count_if(F.weekday("ts") == 5).alias("saturdays"), F.round(buys / F.count_if(F.col("event_type").isin("purchase", "view")), 6).alias("share")).join(peak).select("saturdays", "peak_utc", "share")
