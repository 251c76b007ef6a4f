"""Relational core over the test tables: filters, joins, aggregates, windows, sorts, set operations.

Stand-ins: lineitem is the fact table (delay = l_quantity, cancelled = l_linestatus 'F', whose delay is NULL), the
supplier's nation is the place, l_returnflag the carrier.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.scalar import clock_minutes, local_hour, weekday_numbers
from quern.operators import relational as R
from quern.plans.registry import Query
from quern.session import table as t

FLIGHTS = """f AS (SELECT l_orderkey, l_linenumber, s_nationkey AS place, l_returnflag AS carrier, CAST(l_shipdate AS DATE) AS day,
  l_shipdate, l_linestatus='F' AS cancelled, CASE WHEN l_linestatus<>'F' THEN l_quantity END AS delay, l_extendedprice, l_discount, l_tax, l_quantity
  FROM lineitem JOIN supplier ON l_suppkey=s_suppkey)"""


def flights(s, d):
    line = t(s, d, "lineitem")
    sup = t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("place"))
    return line.join(sup, line.l_suppkey == sup.s_suppkey).select(
        "l_orderkey", "l_linenumber", "place", F.col("l_returnflag").alias("carrier"), F.to_date("l_shipdate").alias("day"), "l_shipdate",
        (F.col("l_linestatus") == "F").alias("cancelled"), F.when(F.col("l_linestatus") != "F", F.col("l_quantity")).alias("delay"),
        "l_extendedprice", "l_discount", "l_tax", "l_quantity",
    )


QUERIES: list[Query] = []


def q(name, sql=None):
    """Registers a (spark, sf_dir) function under a name with its SQL."""

    def add(f):
        QUERIES.append(Query(name, f, sql))
        return f

    return add


# ---- projections, filters, predicates --------------------------------------------------------------------------


@q("c1_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def _(s, d):
    return t(s, d, "orders").filter("o_totalprice > 400000").select("o_orderkey", "o_totalprice")


@q("p1_compound_filter_count", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def _(s, d):
    return t(s, d, "orders").filter((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).agg(F.count("*").alias("n"))


@q("p2_in_list", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_nationkey IN (1,5,9,13,21) AND o_orderstatus NOT IN ('P') GROUP BY 1")
def _(s, d):
    c = t(s, d, "customer").filter(F.col("c_nationkey").isin(1, 5, 9, 13, 21)).select("c_custkey")
    o = t(s, d, "orders").filter(~F.col("o_orderstatus").isin("P"))
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@q("p3_not_null_sentinel", "SELECT event_type, count(*) AS n FROM events WHERE props IS NOT NULL AND props <> '' AND event_type <> 'error' GROUP BY 1")
def _(s, d):
    return t(s, d, "events").filter(F.col("props").isNotNull() & (F.col("props") != "") & (F.col("event_type") != "error")).groupBy("event_type").agg(F.count("*").alias("n"))


@q("p4_iso_date_range", "SELECT count(*) AS n FROM events WHERE CAST(ts AS VARCHAR) >= '2024-01-20'")
def _(s, d):
    # A typed comparison: the same rows for ISO dates, and it reaches the Parquet statistics.
    return t(s, d, "events").filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).agg(F.count("*").alias("n"))


@q("p5_substring", "SELECT p_partkey FROM part WHERE position('ring' IN p_name) > 0")
def _(s, d):
    return t(s, d, "part").filter(F.contains("p_name", F.lit("ring"))).select("p_partkey")


@q("p6_midnight_wrap", "SELECT count(*) AS n FROM lineitem WHERE (l_partkey % 24) * 100 + l_linenumber < (l_suppkey % 24) * 100 + 3")
def _(s, d):
    dep = F.lpad((F.col("l_suppkey") % 24 * 100 + 3).cast("string"), 4, "0")
    arr = F.lpad((F.col("l_partkey") % 24 * 100 + F.col("l_linenumber")).cast("string"), 4, "0")
    return t(s, d, "lineitem").filter(clock_minutes(arr) < clock_minutes(dep)).agg(F.count("*").alias("n"))


@q("p7_case_offset_hour", """SELECT ((extract(hour FROM ts) + CASE user_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 7 ELSE 8 END) % 24)::BIGINT AS utc_hour, count(*) AS n
   FROM events GROUP BY 1""")
def _(s, d):
    h = local_hour(F.hour("ts"), F.col("user_id") % 4, {0: 5, 1: 6, 2: 7}, 8)
    return t(s, d, "events").groupBy(h.alias("utc_hour")).agg(F.count("*").alias("n"))


@q("p8_modulo_between", "SELECT count(*) AS n FROM events WHERE (extract(hour FROM ts) + 9) % 24 BETWEEN 8 AND 17")
def _(s, d):
    return t(s, d, "events").filter(((F.hour("ts") + 9) % 24).between(8, 17)).agg(F.count("*").alias("n"))


@q("p9_rename_units", """SELECT event_id, user_id AS station, CAST(ts AS VARCHAR) AS issued, round(value * 1.94384, 3) AS knots,
   CASE WHEN event_type='view' THEN 1 ELSE 0 END::INTEGER AS flag, nullif(event_type,'error') AS kind FROM events""")
def _(s, d):
    return t(s, d, "events").select(
        "event_id", F.col("user_id").alias("station"), F.col("ts").cast("string").alias("issued"), F.round(F.col("value") * 1.94384, 3).alias("knots"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("flag"), F.nullif("event_type", F.lit("error")).alias("kind"),
    )


@q("p10_identifier_allowed", "SELECT p_partkey, regexp_full_match(p_name, '[a-z_][a-z0-9_]*') AS allowed FROM part")
def _(s, d):
    return t(s, d, "part").select("p_partkey", F.col("p_name").rlike("^[a-z_][a-z0-9_]*$").alias("allowed"))


@q("p11_region_predicate", "SELECT count(*) AS n FROM documents WHERE substring(text,1,1) NOT IN ('K','P','T')")
def _(s, d):
    return t(s, d, "documents").filter(~F.substring("text", 1, 1).isin("K", "P", "T")).agg(F.count("*").alias("n"))


@q("p12_drop_reasons", """SELECT CASE WHEN role='system' THEN 'system' WHEN length(text) < 20 THEN 'too_short' WHEN length(text) > 1500 THEN 'too_long'
   WHEN contains(text,'!!') THEN 'shouting' ELSE 'kept' END AS reason, count(*) AS n FROM conversations GROUP BY 1""")
def _(s, d):
    reason = (
        F.when(F.col("role") == "system", "system").when(F.length("text") < 20, "too_short").when(F.length("text") > 1500, "too_long").when(F.contains("text", F.lit("!!")), "shouting").otherwise("kept")
    )
    return t(s, d, "conversations").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@q("p13_allow_list", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src0','src3','src7') GROUP BY 1")
def _(s, d):
    allow = s.createDataFrame([("src0", "mit"), ("src3", "apache"), ("src7", "cc0")], "source string, licence string")
    return t(s, d, "documents").join(F.broadcast(allow), "source", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@q("p14_deny_substring", "SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), 'licensed under|thandinghe|moron')")
def _(s, d):
    return t(s, d, "documents").filter(~F.lower("text").rlike("licensed under|thandinghe|moron")).select("doc_id")


@q("p15_eligibility_cap", """WITH e AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer
   WHERE c_acctbal > 1000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)) SELECT c_custkey, c_nationkey FROM e WHERE r <= 3""")
def _(s, d):
    taken = t(s, d, "orders").filter("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))
    ok = t(s, d, "customer").filter("c_acctbal > 1000").join(taken, "c_custkey", "left_anti")
    return R.top_n(ok, ["c_nationkey"], [F.col("c_custkey")], 3).select("c_custkey", "c_nationkey")


@q("p16_script_guard", """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '\u8dd1\u9053 ' || source WHEN doc_id % 5 = 1 THEN '\u00e9\u3042 ' || source ELSE source END AS s FROM documents)
   SELECT doc_id % 5 AS k, count(*) FILTER (WHERE regexp_matches(s, '[\u4e00-\u9fff]')) AS guarded, count(*) AS n FROM x GROUP BY 1""")
def _(s, d):
    """A character of U+4E00 to U+9FFF anywhere in a nested value, here the value of a map inside a list of rows."""
    k = F.col("doc_id") % 5
    mark = F.when(k == 0, F.concat(F.lit("\u8dd1\u9053 "), F.col("source"))).when(k == 1, F.concat(F.lit("\u00e9\u3042 "), F.col("source"))).otherwise(F.col("source"))
    nested = F.array(F.struct(F.lit("x").alias("kind"), F.create_map(F.lit("where"), mark).alias("fields")))
    return t(s, d, "documents").select(k.alias("k"), R.has_cjk(nested).alias("cjk")).groupBy("k").agg(F.count_if("cjk").alias("guarded"), F.count("*").alias("n"))


@q("p17_row_policy", "SELECT count(*) AS visible FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1999-01-01')")
def _(s, d):
    from quern.sources.catalog import filtered_view

    filtered_view(s, t(s, d, "orders"), "orders_visible", "o_orderdate >= timestamp_ntz '1999-01-01'")
    return s.sql("SELECT count(*) AS visible FROM orders_visible")


@q("p18_unscored_rows", "SELECT count(*) AS unscored FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def _(s, d):
    return R.rows_without_value(t(s, d, "documents"), t(s, d, "labels"), "doc_id", "quality")


# ---- joins ----------------------------------------------------------------------------------------------------


@q("j1_join_group_sum", "SELECT n_name, round(sum(o_totalprice),2) AS revenue FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def _(s, d):
    o = t(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    c, n = t(s, d, "customer").select("c_custkey", "c_nationkey"), t(s, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


@q("j2_left_join_aggregates", f"""WITH {FLIGHTS}, a AS (SELECT place, day, count(*) AS flights, avg(delay) AS ad FROM f WHERE place IN (0,1,2,3,4) GROUP BY 1,2),
   b AS (SELECT user_id % 5 AS place, CAST(ts AS DATE) + INTERVAL 0 DAY AS day, count(*) AS obs FROM events GROUP BY 1,2)
   SELECT a.place, CAST(a.day AS VARCHAR) AS day, flights, round(ad,3) AS avg_delay, coalesce(obs,0) AS obs FROM a LEFT JOIN b ON a.place=b.place AND a.day=CAST(b.day AS DATE)""")
def _(s, d):
    a = flights(s, d).filter(F.col("place").isin(0, 1, 2, 3, 4)).groupBy("place", "day").agg(F.count("*").alias("flights"), F.avg("delay").alias("ad"))
    b = t(s, d, "events").groupBy((F.col("user_id") % 5).cast("int").alias("place"), F.to_date("ts").alias("day")).agg(F.count("*").alias("obs"))
    return a.join(b, ["place", "day"], "left").select("place", F.col("day").cast("string").alias("day"), "flights", F.round("ad", 3).alias("avg_delay"), F.coalesce("obs", F.lit(0)).alias("obs"))


@q("j3_dimension_join", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
def _(s, d):
    n = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@q("j4_three_way_join", """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1,2)
   SELECT l.user_id, c_name, n FROM l JOIN c ON l.user_id=c.user_id AND CAST(l.last AS DATE)=c.day JOIN customer ON c_custkey=l.user_id""")
def _(s, d):
    ev = t(s, d, "events")
    last = ev.groupBy("user_id").agg(F.to_date(F.max("ts")).alias("day"))
    counts = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return last.join(counts, ["user_id", "day"]).join(t(s, d, "customer"), F.col("c_custkey") == F.col("user_id")).select("user_id", "c_name", "n")


@q("j5_asof_join", """SELECT p.event_id, p.user_id, v.value AS price FROM (SELECT * FROM events WHERE event_type='purchase') p
   ASOF JOIN (SELECT user_id, ts, value FROM events WHERE event_type='view') v ON p.user_id=v.user_id AND p.ts >= v.ts""")
def _(s, d):
    ev = t(s, d, "events")
    buys = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = ev.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("price"), F.col("event_id").alias("view_id"))
    return R.asof_join(buys, seen, "user_id", "ts", ["price"], "seen", "view_id").select("event_id", "user_id", "price")


@q("j6_semi_membership", """WITH bad AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type='error' AND value > 120)
   SELECT round(avg(CASE WHEN bad.day IS NOT NULL THEN value END),4) AS on_bad, round(avg(CASE WHEN bad.day IS NULL THEN value END),4) AS off_bad
   FROM events LEFT JOIN bad ON CAST(ts AS DATE)=bad.day""")
def _(s, d):
    ev = t(s, d, "events").withColumn("day", F.to_date("ts"))
    bad = ev.filter("event_type = 'error' and value > 120").select("day").distinct().withColumn("bad", F.lit(True))
    return ev.join(bad, "day", "left").agg(F.round(F.avg(F.when(F.col("bad"), F.col("value"))), 4).alias("on_bad"), F.round(F.avg(F.when(F.col("bad").isNull(), F.col("value"))), 4).alias("off_bad"))


@q("j7_existence_join", """WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS mo FROM orders)
   SELECT count(*) AS active, count(b.o_custkey) AS next_month FROM m a LEFT JOIN m b ON a.o_custkey=b.o_custkey AND b.mo = a.mo + INTERVAL 1 MONTH""")
def _(s, d):
    m = t(s, d, "orders").select("o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("mo")).distinct()
    nxt = m.select(F.col("o_custkey").alias("k"), F.add_months("mo", -1).alias("pm"))
    return m.join(nxt, (m.o_custkey == nxt.k) & (m.mo == nxt.pm), "left").agg(F.count("*").alias("active"), F.count("k").alias("next_month"))


@q("j8_anti_join_text", "SELECT count(*) AS n FROM documents WHERE trim(text) NOT IN (SELECT trim(text) FROM documents WHERE doc_id % 7 = 0) AND doc_id % 7 <> 0")
def _(s, d):
    docs = t(s, d, "documents").select("doc_id", F.trim("text").alias("raw"))
    held = docs.filter("doc_id % 7 = 0").select("raw").distinct()
    return docs.filter("doc_id % 7 <> 0").join(held, "raw", "left_anti").agg(F.count("*").alias("n"))


@q("j9_leak_check", """SELECT lang, count(DISTINCT text) AS leaked FROM documents WHERE doc_id % 7 <> 0 AND text IN (SELECT text FROM documents WHERE doc_id % 7 = 0) GROUP BY 1""")
def _(s, d):
    docs = t(s, d, "documents")
    held = docs.filter("doc_id % 7 = 0").select("text").distinct()
    return docs.filter("doc_id % 7 <> 0").join(held, "text", "left_semi").groupBy("lang").agg(F.count_distinct("text").alias("leaked"))


_J10 = """WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
   b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1)
   SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_a, count(*) FILTER (WHERE a.k IS NULL) AS only_b,
   count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND abs(a.v-b.v) > 0.01) AS mismatched FROM a FULL OUTER JOIN b ON a.k=b.k"""


@q("j10_full_outer_diff", _J10)
def _(s, d):
    o = t(s, d, "orders").withColumnRenamed("o_custkey", "k")
    side = lambda m: o.filter(f"o_orderkey % {m} <> 0").groupBy("k").agg(F.sum("o_totalprice").alias("v"))
    return R.full_diff(side(3), side(5), ["k"], "v", 0.01)


@q("j11_paired_runs", """WITH a AS (SELECT doc_id, n_chars > 1000 AS ok FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, n_chars > 1500 AS ok FROM documents WHERE doc_id % 10 <> 2)
   SELECT count(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS shared, count(*) FILTER (WHERE b.doc_id IS NULL) AS before_only,
   count(*) FILTER (WHERE a.doc_id IS NULL) AS after_only, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS losses, count(*) FILTER (WHERE NOT a.ok AND b.ok) AS gains
   FROM a FULL OUTER JOIN b USING (doc_id)""")
def _(s, d):
    from quern.operators.statistics import paired_counts

    docs = t(s, d, "documents")
    a = docs.filter("doc_id % 10 <> 1").select("doc_id", (F.col("n_chars") > 1000).alias("ok"))
    b = docs.filter("doc_id % 10 <> 2").select("doc_id", (F.col("n_chars") > 1500).alias("ok"))
    return paired_counts(a, b, "doc_id", "ok")


@q("j12_left_features", """SELECT c_custkey, coalesce(n,0) AS n, round(coalesce(total,0),2) AS total, round(coalesce(least_,400),2) AS least FROM customer LEFT JOIN
   (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, min(o_totalprice) AS least_ FROM orders GROUP BY 1) ON c_custkey=o_custkey""")
def _(s, d):
    f = t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_totalprice").alias("least"))
    j = t(s, d, "customer").select("c_custkey").join(f, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), F.round(F.coalesce("least", F.lit(400.0)), 2).alias("least"))


@q("j13_multi_key_leak", """WITH test AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem WHERE l_orderkey % 10 = 0)
   SELECT count(*) AS leaked, count(*) > 0.01 * (SELECT count(*) FROM test) AS fails FROM test WHERE EXISTS (SELECT 1 FROM lineitem x WHERE
   x.l_orderkey=test.l_orderkey AND x.l_partkey=test.l_partkey AND x.l_suppkey=test.l_suppkey AND x.l_quantity=test.l_quantity AND x.l_shipdate=test.l_shipdate)""")
def _(s, d):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    line = t(s, d, "lineitem").select(*keys)
    test = line.filter("l_orderkey % 10 = 0").distinct()
    found = line.distinct().withColumn("hit", F.lit(1))
    return test.join(found, keys, "left").agg(F.count("hit").alias("leaked"), (F.count("hit") > 0.01 * F.count("*")).alias("fails"))


@q("j15_orphan_check", "SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS joined, count(*) FILTER (WHERE l.doc_id IS NULL) AS orphans FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(s, d):
    j = t(s, d, "documents").select("doc_id").join(t(s, d, "labels").select(F.col("doc_id").alias("lid")), F.col("doc_id") == F.col("lid"), "left")
    return j.agg(F.count("lid").alias("joined"), F.count_if(F.col("lid").isNull()).alias("orphans"))


@q("j16_lookup_default", "SELECT coalesce(n_name,'unknown') AS name, count(*) AS n FROM events LEFT JOIN nation ON user_id % 30 = n_nationkey GROUP BY 1")
def _(s, d):
    n = t(s, d, "nation").select("n_nationkey", "n_name")
    return t(s, d, "events").join(n, F.col("user_id") % 30 == F.col("n_nationkey"), "left").groupBy(F.coalesce("n_name", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))


@q("j18_positional_zip", """WITH a AS (SELECT o_custkey AS id, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderstatus='F'),
   b AS (SELECT o_custkey AS id, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderstatus='O')
   SELECT coalesce(a.id,b.id) AS id, coalesce(a.pos,b.pos)::BIGINT AS pos, a.v AS left_v, b.v AS right_v FROM a FULL OUTER JOIN b ON a.id=b.id AND a.pos=b.pos""")
def _(s, d):
    from quern.operators.records import zip_positions

    lists = lambda st: t(s, d, "orders").filter(F.col("o_orderstatus") == st).groupBy(F.col("o_custkey").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("xs")
    )
    return zip_positions(lists("F"), lists("O"), "id", "xs").select("id", "pos", "left_v", "right_v")


@q("j19_foreign_keys", """SELECT * FROM (VALUES ('customer','c_nationkey','nation'),('lineitem','l_partkey','part'),('lineitem','l_suppkey','supplier'),
   ('nation','n_regionkey','region'),('orders','o_custkey','customer'),('supplier','s_nationkey','nation')) v(child,"column",parent)""")
def _(s, d):
    from quern.sources.catalog import inferred_keys

    tables = {n: t(s, d, n) for n in ("region", "nation", "customer", "orders", "lineitem", "supplier", "part")}
    return inferred_keys(s, tables, strip_prefix=True)


# ---- aggregates ------------------------------------------------------------------------------------------------


@q("a1_group_mean", "SELECT c_mktsegment, round(avg(c_acctbal),4) AS mean FROM customer GROUP BY 1")
def _(s, d):
    return t(s, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"))


@q("a2_group_sum_order", "SELECT p_type, round(sum(l_extendedprice),2) AS revenue FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1 ORDER BY revenue DESC")
def _(s, d):
    p = t(s, d, "part").select("p_partkey", "p_type")
    return t(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue")).orderBy(F.desc("revenue"))


@q("a3_rate", "SELECT lang, round(avg(quality),6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(s, d):
    return t(s, d, "documents").select("doc_id", "lang").join(t(s, d, "labels"), "doc_id").groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("rate"))


@q("a4_rate_argmax", "SELECT (dayofweek(l_shipdate))::INTEGER AS dow, round(avg(CASE WHEN l_linestatus='F' THEN 1.0 ELSE 0.0 END),6) AS rate FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(s, d):
    return (
        t(s, d, "lineitem").groupBy((F.dayofweek("l_shipdate") - 1).alias("dow")).agg(F.round(F.avg((F.col("l_linestatus") == "F").cast("int")), 6).alias("rate")).orderBy(F.desc("rate"), "dow").limit(1)
    )


@q("a5_full_denominator", f"WITH {FLIGHTS} SELECT round(sum(delay)/count(*),6) AS avg_all, round(avg(delay),6) AS avg_flown FROM f")
def _(s, d):
    return flights(s, d).agg(F.round(F.sum("delay") / F.count("*"), 6).alias("avg_all"), F.round(F.avg("delay"), 6).alias("avg_flown"))


@q("a6_conditional_share", f"WITH {FLIGHTS} SELECT place, round(count(*) FILTER (WHERE carrier='R') / count(*),6) AS share FROM f WHERE cancelled GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(s, d):
    return flights(s, d).filter("cancelled").groupBy("place").agg(F.round(F.count_if(F.col("carrier") == "R") / F.count("*"), 6).alias("share")).orderBy(F.desc("share"), "place").limit(1)


@q("a7_multi_column_share", "SELECT l_returnflag, round(100*sum(l_discount)/(sum(l_discount)+sum(l_tax)+sum(l_quantity)/100),6) AS pct FROM lineitem GROUP BY 1")
def _(s, d):
    a, b, c = (F.coalesce(F.sum(x), F.lit(0.0)) for x in ("l_discount", "l_tax", "l_quantity"))
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(100 * a / (a + b + c / 100), 6).alias("pct"))


@q("a8_conditional_averages", "SELECT round(avg(CASE WHEN event_type='error' THEN value END),4) AS with_, round(avg(CASE WHEN event_type<>'error' THEN value END),4) AS without_ FROM events")
def _(s, d):
    e = F.col("event_type") == "error"
    return t(s, d, "events").agg(F.round(F.avg(F.when(e, F.col("value"))), 4).alias("with_"), F.round(F.avg(F.when(~e, F.col("value"))), 4).alias("without_"))


@q("a9_pooled_vs_mean_of_rates", f"WITH {FLIGHTS}, r AS (SELECT place, avg(CASE WHEN delay<=15 THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n, count(*) FILTER (WHERE delay<=15) AS k FROM f WHERE delay IS NOT NULL GROUP BY 1) SELECT round(sum(k)/sum(n),6) AS pooled, round(avg(r),6) AS mean_of_rates FROM r")
def _(s, d):
    r = flights(s, d).filter("delay is not null").groupBy("place").agg(F.count_if(F.col("delay") <= 15).alias("k"), F.count("*").alias("n"))
    return r.agg(F.round(F.sum("k") / F.sum("n"), 6).alias("pooled"), F.round(F.avg(F.col("k") / F.col("n")), 6).alias("mean_of_rates"))


@q("a10_having_argmax", "SELECT extract(hour FROM ts)::INTEGER AS hour, round(avg(value),4) AS mean FROM events GROUP BY 1 HAVING count(*) >= 300 ORDER BY 2 DESC, 1 LIMIT 1")
def _(s, d):
    return t(s, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n")).filter("n >= 300").drop("n").orderBy(F.desc("mean"), "hour").limit(1)


@q("a11_exact_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@q("a12_arg_max", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1")
def _(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@q("a13_set_aggregate", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, bool_or(event_type='error') AS has_error FROM events GROUP BY 1")
def _(s, d):
    g = t(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    return g.withColumn("has_error", F.array_contains("kinds", "error"))


@q("a14_weekend_split", "SELECT round(avg(value) FILTER (WHERE isodow(ts)>=6),4) AS weekend, round(avg(value) FILTER (WHERE isodow(ts)<6),4) AS weekday FROM events")
def _(s, d):
    we = F.weekday("ts") >= 5
    return t(s, d, "events").agg(F.round(F.avg(F.when(we, F.col("value"))), 4).alias("weekend"), F.round(F.avg(F.when(~we, F.col("value"))), 4).alias("weekday"))


@q("a15_mode", "SELECT extract(hour FROM ts)::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(s, d):
    return t(s, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(1)


@q("a16_subtotal_denominators", f"""WITH {FLIGHTS} SELECT place, round(sum(l_quantity) FILTER (WHERE carrier='A')/sum(l_quantity),6) AS of_place,
   round(sum(l_quantity) FILTER (WHERE carrier='A')/sum(l_quantity) FILTER (WHERE carrier<>'N'),6) AS without_n,
   round(sum(delay) FILTER (WHERE carrier='A')/sum(l_quantity) FILTER (WHERE delay IS NOT NULL),6) AS of_known FROM f GROUP BY 1""")
def _(s, d):
    n = F.col("l_quantity")
    part = F.sum(F.when(F.col("carrier") == "A", n))
    return flights(s, d).groupBy("place").agg(
        F.round(part / F.sum(n), 6).alias("of_place"),
        F.round(part / F.sum(F.when(F.col("carrier") != "N", n)), 6).alias("without_n"),
        F.round(F.sum(F.when(F.col("carrier") == "A", F.col("delay"))) / F.sum(F.when(F.col("delay").isNotNull(), n)), 6).alias("of_known"),
    )


@q("a18_matrix", "SELECT lang, source, count(*) FILTER (WHERE n_chars > 1000) AS passed, count(*) AS total FROM documents GROUP BY 1,2")
def _(s, d):
    return t(s, d, "documents").groupBy("lang", "source").agg(F.count_if(F.col("n_chars") > 1000).alias("passed"), F.count("*").alias("total"))


@q("a33_coverage", "SELECT substring(text,1,1) AS letter, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM documents),4) AS pct FROM documents GROUP BY 1")
def _(s, d):
    g = t(s, d, "documents").groupBy(F.substring("text", 1, 1).alias("letter")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4))


@q("a34_status_histogram", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
def _(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderstatus")


@q("a35_mixture_report", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(100.0*sum(n_chars)/(SELECT sum(n_chars) FROM documents),4) AS share FROM documents GROUP BY 1")
def _(s, d):
    g = t(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return g.withColumn("share", F.round(100.0 * F.col("chars") / F.sum("chars").over(W.partitionBy()), 4))


@q("a36_flip_rate", "SELECT count(*) FILTER (WHERE (n_chars % 7 < 3) <> (n_chars % 5 < 2)) AS flips, count(*) AS n FROM documents")
def _(s, d):
    docs = t(s, d, "documents")
    a, b = docs.select("doc_id", (F.col("n_chars") % 7 < 3).alias("a")), docs.select("doc_id", (F.col("n_chars") % 5 < 2).alias("b"))
    return a.join(b, "doc_id").agg(F.count_if(F.col("a") != F.col("b")).alias("flips"), F.count("*").alias("n"))


@q("a38_distinct_ids", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def _(s, d):
    return t(s, d, "orders").agg(F.count_distinct("o_custkey").alias("n"))


# ---- windows ---------------------------------------------------------------------------------------------------


@q("w1_topn_per_group", """WITH r AS (SELECT p_type, p_name, round(sum(l_extendedprice),2) AS revenue FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2)
   SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY revenue DESC, p_name) AS rank FROM r) WHERE rank <= 2""")
def _(s, d):
    p = t(s, d, "part").select("p_partkey", "p_type", "p_name")
    r = t(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_name").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return R.top_n(r, ["p_type"], [F.desc("revenue"), F.col("p_name")], 2)


@q("w2_rank_leaderboard", f"""WITH {FLIGHTS}, r AS (SELECT place, carrier, count(*) AS n, round(avg(CASE WHEN cancelled THEN 1 ELSE 0 END),4) AS rate FROM f GROUP BY 1,2 HAVING count(*)>=100)
   SELECT *, row_number() OVER (PARTITION BY place ORDER BY rate DESC, carrier) AS rank FROM r""")
def _(s, d):
    r = flights(s, d).groupBy("place", "carrier").agg(F.count("*").alias("n"), F.round(F.avg(F.col("cancelled").cast("int")), 4).alias("rate")).filter("n >= 100")
    return r.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy(F.desc("rate"), "carrier")).cast("long"))


@q("w7_surrogate_id", "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey) AS id FROM customer")
def _(s, d):
    from quern.operators.windows import surrogate_ids

    return surrogate_ids(t(s, d, "customer"), ["c_nationkey", "c_mktsegment", "c_custkey"]).select("c_custkey", "id")


@q("w9_lag", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


@q("w10_cumulative_flags", "SELECT event_id, sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS errors FROM events")
def _(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return t(s, d, "events").select("event_id", F.sum((F.col("event_type") == "error").cast("long")).over(w).alias("errors"))


@q("w11_share_of_total", "SELECT n_name, round(100*sum(c_acctbal)/(SELECT sum(c_acctbal) FROM customer),4) AS pct FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def _(s, d):
    n = t(s, d, "nation").select("n_nationkey", "n_name")
    g = t(s, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("v")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return g.select("n_name", F.round(100 * F.col("v") / F.sum("v").over(W.partitionBy()), 4).alias("pct"))


@q("w12_monotonic", "WITH x AS (SELECT user_id, value >= lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up FROM events) SELECT user_id, bool_and(coalesce(up,true)) AS ascending FROM x GROUP BY 1")
def _(s, d):
    up = F.col("value") >= F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(s, d, "events").withColumn("up", F.coalesce(up, F.lit(True))).groupBy("user_id").agg(F.bool_and("up").alias("ascending"))


@q("w13_run_segments", """WITH x AS (SELECT user_id, ts, event_id, value, CASE WHEN value <= lag(value) OVER w OR lag(value) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
   r AS (SELECT user_id, event_id, ts, value, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM x),
   s AS (SELECT user_id, run, arg_min(value, event_id) AS start_value, min(ts) AS t0 FROM (SELECT user_id, run, value, ts, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS event_id FROM r) GROUP BY 1,2),
   m AS (SELECT user_id, median(start_value) AS med FROM s GROUP BY 1),
   k AS (SELECT s.user_id, s.run, CASE WHEN start_value > 2*med AND run > 1 THEN 0 ELSE 1 END AS keep FROM s JOIN m USING (user_id))
   SELECT user_id, sum(keep)::BIGINT AS runs FROM k GROUP BY 1""")
def _(s, d):
    from quern.operators.windows import run_segments

    return run_segments(t(s, d, "events"), "user_id", ["ts", "event_id"], "value").groupBy("user_id").agg(F.max("run").alias("runs"))


@q("w14_last_n_mean", "SELECT round(avg(value),6) AS mean FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 24)")
def _(s, d):
    return t(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(24).agg(F.round(F.avg("value"), 6).alias("mean"))


# ---- sorts, limits, set operations -----------------------------------------------------------------------------


@q("o1_argmax", "SELECT c_nationkey, round(avg(c_acctbal),4) AS mean FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(s, d):
    return t(s, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("mean")).orderBy(F.desc("mean"), "c_nationkey").limit(1)


@q("o2_md5_order", "SELECT doc_id FROM documents ORDER BY md5(text), doc_id LIMIT 50")
def _(s, d):
    return t(s, d, "documents").select("doc_id", F.md5("text").alias("h")).orderBy("h", "doc_id").limit(50).select("doc_id")


@q("o3_mixed_sort", "SELECT p_type, p_size, p_partkey FROM part ORDER BY p_type, p_size DESC, p_partkey LIMIT 100")
def _(s, d):
    return t(s, d, "part").select("p_type", "p_size", "p_partkey").orderBy("p_type", F.desc("p_size"), "p_partkey").limit(100)


@q("o4_keep_last", "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1")
def _(s, d):
    return R.latest_per_key(t(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type")


@q("o5_capped_rows", "SELECT o_orderkey, (SELECT count(*) FROM orders) > 200 AS more FROM orders ORDER BY o_orderkey LIMIT 200")
def _(s, d):
    from quern.sources.sql_tool import capped

    return capped(t(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 200)


@q("s1_concat", "SELECT 'train' AS part, count(*) AS n FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1 UNION ALL SELECT 'test', count(*) FROM documents WHERE doc_id % 4 = 0")
def _(s, d):
    docs = t(s, d, "documents")
    a, b = docs.filter("doc_id % 4 <> 0").withColumn("part", F.lit("train")), docs.filter("doc_id % 4 = 0").withColumn("part", F.lit("test"))
    return a.unionByName(b).groupBy("part").agg(F.count("*").alias("n"))


@q("s2_upsert", """WITH u AS (SELECT o_orderkey AS id, o_totalprice AS v, 1 AS version, 0 AS src FROM orders WHERE o_orderkey % 2 = 0 UNION ALL
   SELECT o_orderkey, o_totalprice + 1, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END, 1 FROM orders WHERE o_orderkey % 5 = 0)
   SELECT id, v, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, src DESC) AS r FROM u) WHERE r=1""")
def _(s, d):
    o = t(s, d, "orders")
    base = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.lit(1).alias("version"))
    new = o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + 1).alias("v"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1).alias("version"))
    return R.upsert(base, new, "id", "version")


@q("s3_key_sets", "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS shared, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS left_only")
def _(s, d):
    c, o = t(s, d, "customer").select(F.col("c_custkey").alias("k")), t(s, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o).agg(F.count("*").alias("shared")).join(c.subtract(o).agg(F.count("*").alias("left_only")))


@q("s4_set_equality", "SELECT NOT EXISTS (SELECT l_returnflag FROM lineitem EXCEPT SELECT l_returnflag FROM lineitem WHERE l_orderkey % 2 = 0) AS equal")
def _(s, d):
    line = t(s, d, "lineitem")
    return R.set_equal(line.select("l_returnflag"), line.filter("l_orderkey % 2 = 0").select("l_returnflag"))


@q("s5_bag_equality", "SELECT NOT EXISTS (SELECT round(l_quantity,0) FROM lineitem EXCEPT ALL SELECT l_quantity FROM lineitem) AS equal")
def _(s, d):
    line = t(s, d, "lineitem")
    return R.bag_equal(line.select(F.round("l_quantity", 0).alias("v")), line.select(F.col("l_quantity").alias("v")))


@q("s6_schema_equality", "SELECT count(*) FILTER (WHERE abs(a.v-b.v) > 1e-6 + 1e-3*abs(b.v)) = 0 AS equal FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders) a JOIN (SELECT o_orderkey AS k, o_totalprice*1.0001 AS v FROM orders) b USING (k)")
def _(s, d):
    o = t(s, d, "orders")
    a, b = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), o.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 1.0001).alias("w"))
    return a.join(b, "k").agg((F.count_if(~R.close(F.col("v"), F.col("w"))) == 0).alias("equal"))


@q("s7_closeness", "SELECT part.p_partkey, abs(p_retailprice - round(p_retailprice,0)) <= 1e-6 + 1e-3*abs(round(p_retailprice,0)) AS close FROM part")
def _(s, d):
    return t(s, d, "part").select("p_partkey", R.close(F.col("p_retailprice"), F.round("p_retailprice", 0)).alias("close"))


# ---- scalar functions ------------------------------------------------------------------------------------------


@q("f1_weekday_schemes", "SELECT event_id, isodow(ts)::INTEGER AS iso, dayofweek(ts)::INTEGER AS sun0, (dayofweek(ts)+1)::INTEGER AS sun1, (isodow(ts)-1)::INTEGER AS mon0 FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", *[c.alias(n) for n, c in weekday_numbers(F.col("ts")).items()])


@q("f2_hour_month", "SELECT extract(month FROM o_orderdate)::INTEGER AS month, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return t(s, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@q("f3_calendar_counts", """SELECT count(*) FILTER (WHERE isodow(ts)>=6) AS weekend, count(*) FILTER (WHERE isodow(ts)<6) AS workweek, count(*) FILTER (WHERE isodow(ts)=1) AS mondays,
   count(*) FILTER (WHERE isodow(ts)>=6 AND event_type='error') AS weekend_errors FROM events""")
def _(s, d):
    iso = weekday_numbers(F.col("ts"))["iso"]
    return t(s, d, "events").agg(F.count_if(iso >= 6).alias("weekend"), F.count_if(iso < 6).alias("workweek"), F.count_if(iso == 1).alias("mondays"), F.count_if((iso >= 6) & (F.col("event_type") == "error")).alias("weekend_errors"))


@q("f4_local_to_utc", "SELECT event_id, ((extract(hour FROM ts) - CASE user_id % 3 WHEN 0 THEN -5 WHEN 1 THEN 1 ELSE 9 END + 48) % 24)::BIGINT AS utc_hour FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", local_hour(F.hour("ts"), F.col("user_id") % 3, {0: 5, 1: -1}, -9).alias("utc_hour"))


@q("f5_day_bucket", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return t(s, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


@q("f8_trim_lower", "SELECT doc_id, lower(trim(source)) AS source FROM documents")
def _(s, d):
    return t(s, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"))


@q("f9_zero_pad", "SELECT c_custkey, substr(lpad(CAST(c_custkey % 2400 AS VARCHAR),4,'0'),1,2) AS hh FROM customer")
def _(s, d):
    return t(s, d, "customer").select("c_custkey", F.substr(F.lpad((F.col("c_custkey") % 2400).cast("string"), 4, "0"), F.lit(1), F.lit(2)).alias("hh"))


@q("f10_hashes", "SELECT doc_id, md5(text) AS md5, substr(sha1(text),1,12) AS sha1_12, sha256(text) AS sha256, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)),1,8))::BIGINT % 100 AS bucket FROM documents")
def _(s, d):
    from quern.operators.sampling import hash_bucket

    return t(s, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.substring(F.sha1("text"), 1, 12).alias("sha1_12"), F.sha2("text", 256).alias("sha256"), hash_bucket(F.col("doc_id")).alias("bucket"))


@q("f11_hash_split", """SELECT doc_id, CASE WHEN b < 8 THEN 'test' WHEN b < 40 THEN 'train' ELSE 'unused' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)),1,8))::BIGINT % 100 AS b FROM documents)""")
def _(s, d):
    from quern.operators.sampling import hash_bucket

    b = hash_bucket(F.col("doc_id"))
    return t(s, d, "documents").select("doc_id", F.when(b < 8, "test").when(b < 40, "train").otherwise("unused").alias("split"))


@q("f12_rounding", "SELECT n_nationkey, round(n_nationkey * 0.5::DOUBLE, 0) AS half_up, round_even(n_nationkey * 0.5::DOUBLE, 0) AS half_even FROM nation")
def _(s, d):
    x = F.col("n_nationkey") * F.lit(0.5)
    return t(s, d, "nation").select("n_nationkey", F.round(x, 0).alias("half_up"), F.bround(x, 0).alias("half_even"))


@q("f13_units", "SELECT event_id, value*1.94384 AS kt, value*1609.344 AS metres, value*33.8639 AS hpa FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", (F.col("value") * 1.94384).alias("kt"), (F.col("value") * 1609.344).alias("metres"), (F.col("value") * 33.8639).alias("hpa"))


@q("f14_bucketing", "SELECT event_id, round_even(value/100,0)*100 AS bucket FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", (F.bround(F.col("value") / 100, 0) * 100).alias("bucket"))


# ---- extras that Spark has built in ----------------------------------------------------------------------------


@q("x_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(s, d):
    return t(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@q("x_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(s, d):
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
