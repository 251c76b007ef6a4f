"""Sources, sinks, streams, learners and tools, run end to end over the test tables or small files of their own."""

from __future__ import annotations

import gzip
import uuid

from pyspark.sql import functions as F

from quern.operators import learning as L
from quern.operators import variants as V
from quern.plans.registry import Query
from quern.session import table as t
from quern.sources import catalog, readers, sinks, sql_tool

QUERIES: list[Query] = []


def q(name, sql=None):
    def add(f):
        QUERIES.append(Query(name, f, sql))
        return f

    return add


def folder(s, label: str) -> str:
    """A new folder that executors share: under spark.checkpoint.dir, or a local one where that is unset (tests)."""
    base = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/quern-{label}-{uuid.uuid4().hex}"


def put(s, uri: str, text: str, packed: bool = False) -> str:
    """A small file, written through the store's own file system."""
    path = s._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(s._jsc.hadoopConfiguration()).create(path)
    out.write(gzip.compress(text.encode()) if packed else text.encode())
    out.close()
    return uri


@q("c2_gz_csv", "SELECT 3::BIGINT AS n, 30.5::DOUBLE AS total")
def _(s, d):
    f = folder(s, "c2")
    put(s, f"{f}/a.csv.gz", "station,raw,v\nA,x,10\nB,M,1\n", True)
    put(s, f"{f}/b.csv.gz", "station,raw,v\nC,y,20.5\nD,z,\n", True)
    df = readers.read_text_csv(s, f, ["station", "raw", "v"]).filter("raw <> 'M'")
    return df.agg(F.count("*").alias("n"), F.sum(F.col("v").try_cast("double")).alias("total"))


@q("c3_csv_by_name", "SELECT * FROM (VALUES ('1','x',NULL),('2',NULL,'y')) v(a,b,c)")
def _(s, d):
    f = folder(s, "c3")
    return readers.read_csv_by_name(s, [[put(s, f"{f}/1.csv", "a,b\n1,x\n")], [put(s, f"{f}/2.csv", "a,c\n2,y\n")]])


@q("c4_json_auto", "SELECT 2::BIGINT AS n, 3::BIGINT AS total")
def _(s, d):
    return readers.read_json_auto(s, put(s, f"{folder(s, 'c4')}/a.json", '{"a":1}\n{"a":2,"b":"x"}\n')).agg(F.count("*").alias("n"), F.sum("a").alias("total"))


@q("c5_jsonl", "SELECT 2::BIGINT AS rows, 1::BIGINT AS torn")
def _(s, d):
    rows, torn = readers.read_jsonl(s, put(s, f"{folder(s, 'c5')}/a.jsonl", '{"id":1,"t":"a"}\n\n{"id":2,"t":"b"}\n{"id":3,"t\n'), "id:int,t:string")
    return rows.agg(F.count("*").alias("rows")).join(torn.agg(F.count("*").alias("torn")))


@q("c6_torn_lines", "SELECT 1::BIGINT AS torn, 1::BIGINT AS whole")
def _(s, d):
    rows, torn = readers.read_jsonl(s, put(s, f"{folder(s, 'c6')}/a.jsonl", '{"id":1}\n{"id":'), "id:int")
    return torn.agg(F.count("*").alias("torn")).join(rows.agg(F.count("*").alias("whole")))


@q("c7_gz_xml", "SELECT * FROM (VALUES ('TAF A','AAAA')) v(raw_text,station_id)")
def _(s, d):
    f = put(s, f"{folder(s, 'c7')}/t.xml.gz", "<data><TAF><raw_text>TAF A</raw_text><station_id>AAAA</station_id></TAF><TAF><station_id>BBBB</station_id></TAF></data>", True)
    return readers.read_xml_rows(s, f, "TAF", ["raw_text", "station_id"], "raw_text")


@q("c8_csv_preamble", "SELECT * FROM (VALUES ('M1','2')) v(raw_text,x)")
def _(s, d):
    f = put(s, f"{folder(s, 'c8')}/m.csv", "No errors\n2 results\nraw_text,x,x\nM1,1,2\n,3,4\n")
    return readers.read_csv_after_preamble(s, f, "raw_text,", "raw_text")


@q("c9_typed_subset", "SELECT * FROM (VALUES ('2026-06-01',1.5::DOUBLE,1,'a'),(NULL,NULL,0,'')) v(day,delay,flag,code)")
def _(s, d):
    x = s.createDataFrame([("2026-06-01", "1.5", "1.00", "a", "z"), ("bad", "x", None, None, "z")], "day string, delay string, flag string, code string, extra string")
    return readers.typed_subset(x, ["day"], ["delay"], ["flag"], ["code"]).withColumn("day", F.col("day").cast("string"))


@q("c10_last_field", "SELECT * FROM (VALUES ('a;b','L1'),('c','L2')) v(text,label)")
def _(s, d):
    text, label = readers.last_field_split(F.col("v"))
    return s.createDataFrame([("a;b;L1",), ("c;L2",)], "v string").select(text.alias("text"), label.alias("label"))


@q("c11_nested_json", "SELECT * FROM (VALUES (1,2),(2,1),(3,1)) v(id,n)")
def _(s, d):
    x = s.createDataFrame([(1, '{"rows":[{"a":"1"},{"a":"2"}]}'), (2, '{"a":"1"}'), (3, '[{"a":"1"}]')], "id int, v string")
    return x.select("id", F.size(readers.nested_rows(F.col("v"))).alias("n"))


@q("c12_ordered_union", "SELECT * FROM (VALUES ('a',0),('b',0),('c',1)) v(name,list)")
def _(s, d):
    return readers.ordered_union(s, ["a", "b"], ["b", "c"])


@q("c13_warehouse_read", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(s, d):
    sql_tool.register({"nation_w": t(s, d, "nation")})
    return s.table("nation_w").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@q("c14_introspection", "SELECT 'nation' AS \"table\", column_name AS \"column\" FROM (DESCRIBE nation) UNION ALL SELECT 'region', column_name FROM (DESCRIBE region)")
def _(s, d):
    return catalog.introspect(s, {n: t(s, d, n) for n in ("nation", "region")}).select("table", "column")


@q("c15_schema_document", None)
def _(s, d):
    return s.createDataFrame([(catalog.schema_document({n: t(s, d, n) for n in ("nation", "region")}),)], "document string")


@q("c16_capped_source", "SELECT doc_id FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS c FROM documents) WHERE c - n_chars < 100000")
def _(s, d):
    return readers.capped_source(t(s, d, "documents"), ["doc_id"], F.col("n_chars"), 100_000, 10_000).select("doc_id")


@q("c17_sampled_records", "SELECT doc_id FROM documents ORDER BY md5('5' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40")
def _(s, d):
    return readers.sampled_records(t(s, d, "documents").select("doc_id"), "doc_id", 40, "5")


@q("c18_latest_snapshot", "SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part) AND p_name NOT LIKE 's%'")
def _(s, d):
    return readers.latest_snapshot(t(s, d, "part"), "p_size").filter("p_name not like 's%'").select("p_partkey")


@q("c19_run_metrics", "SELECT * FROM (VALUES ('r1',0.5::DOUBLE),('r2',0.25)) v(run,acc)")
def _(s, d):
    x = s.createDataFrame([("r1", '{"metrics":{"acc":0.5}}'), ("r2", '{"acc":0.25}')], "run string, v string")
    return readers.run_metrics(x, "v").select("run", F.col("metrics")["acc"].alias("acc"))


@q("c20_server_log", "SELECT * FROM (VALUES (4::BIGINT,30::BIGINT,10::BIGINT)) v(seq,prompt,cached)")
def _(s, d):
    x = s.createDataFrame([(1, "start"), (2, "prompt=10 cached=0"), (3, "start"), (4, "prompt=30 cached=10"), (5, "noise")], "seq long, value string")
    return readers.log_requests(x, r"prompt=(\d+) cached=(\d+)", "^start")


@q("c21_event_reduction", "SELECT * FROM (VALUES (1,true,'bye')) v(run,settled,last_text)")
def _(s, d):
    rows = [(1, 1, '{"type":"step"}'), (1, 2, "torn {"), (1, 3, '{"type":"agent_end","messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"bye"}]}')]
    return readers.reduced_events(s.createDataFrame(rows, "run int, seq int, line string"), "run", "seq", "line").select("run", "settled", "last_text")


@q("k1_parquet_round_trip", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    p = folder(s, "k1") + "/t"
    sinks.write_parquet(t(s, d, "orders").select("o_orderkey", "o_orderstatus"), p, ["o_orderstatus"])
    return s.read.parquet(p).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@q("k2_canonical_jsonl", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def _(s, d):
    p = folder(s, "k2") + "/t"
    sinks.write_jsonl(t(s, d, "nation"), p, "n_nationkey")
    return s.read.text(p)


@q("k3_content_hash", """SELECT sha256(string_agg('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' || chr(10), '' ORDER BY r_regionkey)) AS digest FROM region""")
def _(s, d):
    return s.createDataFrame([(sinks.content_hash(t(s, d, "region"), "r_regionkey"),)], "digest string")


@q("k4_create_table_as", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    name = f"quern_k4_{uuid.uuid4().hex}"
    sinks.create_table_as(t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), name, ["l_returnflag"])
    return s.table(name)


@q("k5_idempotent_overwrite", "SELECT count(*) AS n FROM region")
def _(s, d):
    p = folder(s, "k5") + "/t"
    for _ in range(2):
        sinks.write_parquet(t(s, d, "region"), p)
    return s.read.parquet(p).agg(F.count("*").alias("n"))


@q("k6_append_checkpoint", "SELECT 2::BIGINT AS n")
def _(s, d):
    p = folder(s, "k6") + "/t"
    for model, ids in (("a", [1]), ("a", [2]), ("b", [3])):
        sinks.append_checkpoint(s.createDataFrame([(i,) for i in ids], "id int"), p, model=model)
    return sinks.read_checkpoint(s, p, model="a").agg(F.count("*").alias("n"))


@q("k7_resume_pending", "SELECT source, lang, count(*) AS n, 0::BIGINT AS twice FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    """A zone partitioned by source and language, filled in two runs: the second writes only what the first left out."""
    p = folder(s, "k7") + "/zone"
    docs = t(s, d, "documents").select("doc_id", "source", "lang").filter("source is not null and lang is not null")
    sinks.fill_zone(docs.filter("doc_id % 3 = 0"), p, ["source", "lang"], "doc_id")
    sinks.fill_zone(docs, p, ["source", "lang"], "doc_id")
    zone = s.read.option("basePath", p).parquet(p)
    return zone.groupBy("source", "lang").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("doc_id")).alias("twice"))


@q("k8_ledger", "SELECT * FROM (VALUES ('u1',5::BIGINT),('u2',7)) v(url,rows)")
def _(s, d):
    p = folder(s, "k8") + "/l"
    sinks.append_ledger(s, p, "u1", "00", 10, 5)
    sinks.append_ledger(s, p, "u2", "11", 20, 7)
    return s.read.json(p).select("url", "rows")


@q("k9_markdown_report", None)
def _(s, d):
    return s.createDataFrame([(sinks.markdown_table(t(s, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).orderBy("n_regionkey")),)], "report string")


# ---- streaming -------------------------------------------------------------------------------------------------


def _stream_of(s, df, label, files_per_trigger=100):
    p = folder(s, label) + "/in"
    df.write.parquet(p)
    from quern.streaming.jobs import parquet_stream

    return parquet_stream(s, p, files_per_trigger)


@q("r1_delta_reassembly", None)
def _(s, d):
    from quern.operators.chat import reassembled

    rows = [(1, 2, "lo", None, None, None, None, ""), (1, 1, "Hel", "th", None, None, None, None), (1, 3, None, "ink", 0, "add", '{"a"', None), (1, 4, None, None, 0, None, ":1}", "stop")]
    return reassembled(s.createDataFrame(rows, "request int, seq int, content string, reasoning string, call_index int, call_name string, call_arguments string, finish string"))


@q("r2_complete_passes", "SELECT * FROM (VALUES (0::BIGINT,true),(1,false)) v(run,complete)")
def _(s, d):
    from quern.streaming.jobs import complete_passes

    docs = t(s, d, "documents").select("doc_id")
    gen = docs.withColumn("run", F.lit(0).cast("long")).unionByName(docs.filter("doc_id % 2 = 0").withColumn("run", F.lit(1).cast("long")))
    return complete_passes(docs, gen, "doc_id", "run")


@q("r3_exactly_once", "SELECT count(DISTINCT conv_id) AS n FROM conversations")
def _(s, d):
    from quern.streaming.jobs import score_new

    base = folder(s, "r3")
    stream = _stream_of(s, t(s, d, "conversations").select("conv_id", "text"), "r3in")
    for k in range(2):  # the second run starts from nothing and still adds no row
        score_new(stream, "conv_id", lambda b: b.withColumn("score", F.length("text")), base + "/out", f"{base}/cp{k}").awaitTermination()
    return s.read.parquet(base + "/out").agg(F.count("*").alias("n"))


@q("r4_scheduler", "SELECT 'b' AS family")
def _(s, d):
    from quern.streaming.jobs import next_family

    return s.createDataFrame([(next_family({"a": 10, "b": 10}, {"a": 9, "b": 1}, {"a": 10, "b": 10}),)], "family string")


@q("r5_snapshot_dedup", "SELECT count(*) AS n FROM events")
def _(s, d):
    """All snapshots that are there are one trigger: their files follow no order of time, so none may be late for another."""
    from quern.streaming.jobs import STATE_ON_DISK, deduplicated, run_to_files

    ev = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = _stream_of(s, ev.unionByName(ev), "r5", None)
    once = deduplicated(twice, "ts", ["event_id"], "60 days")  # gives rows at once, so an empty last batch would add none
    return run_to_files(once, folder(s, "r5out"), {**STATE_ON_DISK, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}).agg(F.count("*").alias("n"))


@q("x_stream_windows", "SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY 1,2")
def _(s, d):
    from quern.streaming.jobs import run_to_memory, windowed_counts

    ev = _stream_of(s, t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "xs")
    out = run_to_memory(windowed_counts(ev, "ts", ["event_type"], "1 day"), "quern_xs", "complete")
    return out.select(F.col("window.start").cast("string").alias("start"), "event_type", "n")


# ---- learners --------------------------------------------------------------------------------------------------


def _line(s, d):
    return t(s, d, "lineitem").withColumns({"id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), "y": (F.col("l_extendedprice") > 50000).cast("double"), "hour": (F.col("l_partkey") % 24).cast("double")})


@q("l1_boosted_classifier", None)
def _(s, d):
    from quern.operators.scoring import roc_auc

    train, test = L.hash_split(_line(s, d), "id", 20)
    p = L.boosted_classifier(train, ["l_returnflag"], ["l_quantity", "l_tax", "hour"], "y", 5).transform(test)
    from pyspark.ml.functions import vector_to_array

    return roc_auc(p.withColumn("score", vector_to_array("probability")[1]), "y", "score").select((F.col("auc") >= 0.65).alias("auc_ok"))


@q("l2_boosted_regression", None)
def _(s, d):
    train, test = L.hash_split(_line(s, d), "id", 20)
    m = L.mean_absolute_error(L.boosted_regressor(train, ["l_returnflag"], ["l_quantity", "l_tax"], "l_extendedprice", 5).transform(test), "l_extendedprice").first()[0]
    b = L.mean_absolute_error(L.median_baseline(train, test, "l_extendedprice"), "l_extendedprice").first()[0]
    return s.createDataFrame([(m < 0.94 * b,)], "beats_median boolean")


@q("l3_text_classifier", None)
def _(s, d):
    docs = t(s, d, "documents").select("doc_id", "text", "lang")
    train, test = L.hash_split(docs, "doc_id", 25)
    return L.accuracy(L.text_classifier(train, "text", "lang", 3.0, 4096).transform(test), "label").select((F.col("accuracy") >= 0.55).alias("accurate"))


@q("l4_logistic_folds", None)
def _(s, d):
    x = L.synthetic_task(s, "churn", 2000)
    return L.logistic_folds(x, ["x1", "x2"], "y", "id").agg((F.avg("accuracy") > 0.8).alias("accurate"))


@q("l5_train_test", None)
def _(s, d):
    train, test = L.hash_split(L.synthetic_task(s, "widget", 2000), "id", 25)
    a = L.accuracy(L.boosted_classifier(train, ["category"], ["x1", "x2"], "y", 5).transform(test), "y").first()[0]
    return s.createDataFrame([(a > 0.8,)], "accurate boolean")


@q("l6_knn", None)
def _(s, d):
    train, test = L.hash_split(L.synthetic_task(s, "energy", 2000), "id", 10)
    p = L.knn(train, test, "id", ["x1", "x2"], "y").join(test.select("id", "y"), "id")
    return L.accuracy(p, "y", "predicted").select((F.col("accuracy") > 0.75).alias("accurate"))


@q("l7_synthetic_tasks", None)
def _(s, d):
    out = None
    for name in ("widget", "delivery", "churn", "energy", "ticket", "credit", "upsell"):
        one = L.synthetic_task(s, name, 500).agg(F.lit(name).alias("task"), F.count("*").alias("rows"), F.round(F.avg("y"), 3).alias("positive"))
        out = one if out is None else out.unionByName(one)
    return out


@q("l8_negative_controls", None)
def _(s, d):
    train, test = L.hash_split(L.synthetic_task(s, "ticket", 2000), "id", 25)
    good = L.accuracy(L.boosted_classifier(train, ["category"], ["x1", "x2"], "y", 5).transform(test), "y").first()[0]
    base = L.accuracy(L.majority_baseline(train, test, "y"), "y").first()[0]
    return s.createDataFrame([(good > base + 0.05,)], "control_fails boolean")


@q("l12_probe_tasks", None)
def _(s, d):
    from pyspark.ml.functions import vector_to_array

    from quern.operators.scoring import roc_auc

    train, test = L.hash_split(L.synthetic_task(s, "credit", 2000), "id", 25)
    p = L.boosted_classifier(train, ["category"], ["x1", "x2"], "y", 5).transform(test).withColumn("score", vector_to_array("probability")[1])
    return roc_auc(p, "y", "score").select((F.col("auc") >= 0.65).alias("auc_ok"))


# ---- tools -----------------------------------------------------------------------------------------------------


@q("u1_user_function", "SELECT c_custkey, c_acctbal * 2 AS doubled FROM customer")
def _(s, d):
    def solve(batches):
        for pdf in batches:
            yield pdf.assign(doubled=pdf["c_acctbal"] * 2)[["c_custkey", "doubled"]]

    return t(s, d, "customer").mapInPandas(solve, "c_custkey long, doubled double")


@q("u2_sql_over_frames", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
def _(s, d):
    sql_tool.register({"u2_nation": t(s, d, "nation"), "u2_region": t(s, d, "region")})
    return s.sql("SELECT r_name, count(*) AS n FROM u2_nation JOIN u2_region ON n_regionkey = r_regionkey GROUP BY r_name")


@q("u3_run_sql", "SELECT 'n' || chr(10) || count(*) AS result FROM region")
def _(s, d):
    sql_tool.register({"u3_region": t(s, d, "region")})
    return s.createDataFrame([(sql_tool.run_sql(s, "SELECT count(*) AS n FROM u3_region;"),)], "result string")


@q("u4_engine", "SELECT round(sum(c_acctbal),6)::DOUBLE AS value FROM customer")
def _(s, d):
    e = sql_tool.Engine(s)
    e.setup()
    e.load("u4_customer", t(s, d, "customer"))
    value = e.scalar("SELECT sum(c_acctbal) FROM u4_customer")
    e.teardown()
    return s.createDataFrame([(value,)], "value double")


@q("u5_read_only", """SELECT * FROM (VALUES ('select', true, (SELECT count(*) FROM region)), ('quoted', true, 1), ('with', true, (SELECT count(*) FROM region WHERE r_regionkey > 1)), ('drop', false, NULL), ('create', false, NULL),
   ('insert', false, NULL), ('set', false, NULL), ('two', false, NULL), ('attach', false, NULL), ('torn', false, NULL)) v(name, ok, value)""")
def _(s, d):
    t(s, d, "region").createOrReplaceTempView("u5_region")
    cases = {
        "select": "SELECT count(*) AS n FROM u5_region;", "quoted": "SELECT length(';') -- one; statement", "with": "WITH x AS (SELECT * FROM u5_region) SELECT count(*) FROM x WHERE r_regionkey > 1",
        "drop": "DROP VIEW u5_region", "create": "CREATE TABLE u5_t AS SELECT 1 AS a", "insert": "INSERT INTO u5_region SELECT * FROM u5_region", "set": "SET spark.sql.ansi.enabled = false",
        "two": "SELECT 1; SELECT 2", "attach": "ATTACH 'x'", "torn": "SELECT FROM WHERE",
    }
    found = {k: sql_tool.read_only_rows(s, sql) for k, sql in cases.items()}
    return s.createDataFrame([(k, x["ok"], int(x["rows"][0][0]) if x["ok"] else None) for k, x in found.items()], "name string, ok boolean, value long")


@q("u6_variant", None)
def _(s, d):
    return V.grown(t(s, d, "customer"), 300, "c_custkey", {"c_nationkey": list(range(25))}).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@q("u7_suite_accuracy", "SELECT true AS same, false AS different")
def _(s, d):
    variants = [{"u7": V.grown(t(s, d, "customer"), 100, "c_custkey", salt=f"v{k}")} for k in range(2)]
    same = V.same_on_variants(s, "SELECT c_custkey FROM u7 WHERE c_acctbal > 0", "SELECT c_custkey FROM u7 WHERE 0 < c_acctbal", variants)
    other = V.same_on_variants(s, "SELECT c_custkey FROM u7 WHERE c_acctbal > 5000", "SELECT c_custkey FROM u7 WHERE c_acctbal > 0", variants)
    return s.createDataFrame([(same, other)], "same boolean, different boolean")


@q("u8_recheck_seeds", "SELECT * FROM (VALUES ('equal', 'verified', true), ('by_luck', 'verified', false), ('wrong', 'wrong', false)) v(id, status, held)")
def _(s, d):
    """An answer that is right on the first tables only (a written-out number) does not hold on fresh ones."""
    tables = lambda seed: {"trips": V.domain_table(s, "trips", seed, 200)}
    gold = "SELECT count(*) FROM trips WHERE fare > 50"
    tables(1)["trips"].createOrReplaceTempView("trips")
    lucky = s.sql(gold).first()[0]
    replies = [{"id": "equal", "sql": "SELECT count(*) FROM trips WHERE 50 < fare"}, {"id": "by_luck", "sql": f"SELECT {lucky}"}, {"id": "wrong", "sql": "SELECT -1"}]
    out = V.rechecked(s, [{**r, "gold": gold} for r in replies], tables, 1, (2, 3))
    return s.createDataFrame([(r["id"], r["status"], r["held"]) for r in out], "id string, status string, held boolean")


@q("u9_registry", "SELECT 'u9_registry' AS name, true AS found, true AS repeat_refused, true AS sorted")
def _(s, d):
    from quern.plans import registry

    mine = registry.selected("u9_")
    try:
        registry.collected([mine, mine])
        refused = False
    except ValueError:
        refused = True
    names = [x.name for x in registry.selected("")]
    return s.createDataFrame([(mine[0].name, len(mine) == 1, refused, names == sorted(names))], "name string, found boolean, repeat_refused boolean, sorted boolean")


@q("u10_oracle_gate", "SELECT * FROM (VALUES ('a11_exact_distinct', true), ('k4_create_table_as', true), ('broken', false)) v(problem, passes)")
def _(s, d):
    """Plans against their own SQL, run here by Spark over the same tables; an answer without one of its rows must fail."""
    from quern.operators.relational import bag_equal
    from quern.plans import registry

    for name in ("events", "lineitem"):
        t(s, d, name).createOrReplaceTempView(name)

    def gate(answer, sql):
        checked = s.sql(sql)
        columns = sorted(checked.columns)
        return sorted(answer.columns) == columns and bool(bag_equal(answer.select(*columns), checked.select(*columns)).first()["equal"])

    chosen = {x.name: x for x in registry.all_queries() if x.name in ("a11_exact_distinct", "k4_create_table_as")}
    out = [(n, gate(x.run(s, d), x.sql)) for n, x in sorted(chosen.items())]
    whole = chosen["k4_create_table_as"]
    out.append(("broken", gate(whole.run(s, d).orderBy("l_returnflag").limit(1), whole.sql)))
    return s.createDataFrame(out, "problem string, passes boolean")


@q("u11_call_checker", "SELECT * FROM (VALUES (1,true),(2,false)) v(id,right_call)")
def _(s, d):
    from quern.functions.extract import typed_equal

    x = s.createDataFrame([(1, "number", "5", "5.0"), (2, "string", "a", "b")], "id int, kind string, gold string, got string")
    return x.select("id", typed_equal(F.col("kind"), F.col("gold"), F.col("got")).alias("right_call"))


@q("u12_access_audit", "SELECT conv_id, turn FROM conversations WHERE contains(text,'the') AND contains(text,'ing')")
def _(s, d):
    return V.audit(t(s, d, "conversations"), "text", {"one": "the", "two": "ing"}).filter("size(flags) = 2").select("conv_id", "turn")


@q("u13_grouped_verification", "SELECT * FROM (VALUES (1,'verified'),(2,'wrong'),(3,'rebuild_mismatch')) v(id,status)")
def _(s, d):
    rows = [
        {"id": 1, "table_key": "trips:1", "gold": "SELECT count(*) FROM trips", "truth": 50, "sql": "SELECT count(1) FROM trips"},
        {"id": 2, "table_key": "trips:1", "gold": "SELECT count(*) FROM trips", "truth": 50, "sql": "SELECT 1"},
        {"id": 3, "table_key": "trips:1", "gold": "SELECT count(*) FROM trips", "truth": 51, "sql": "SELECT 1"},
    ]
    out = V.verified(s, rows, lambda key: {key.split(":")[0]: V.domain_table(s, key.split(":")[0], int(key.split(":")[1]), 50)})
    return s.createDataFrame([(r["id"], r["status"]) for r in out], "id int, status string")


@q("g10_loss_mask", None)
def _(s, d):
    from quern.operators.chat import loss_mask

    return loss_mask(t(s, d, "conversations")).select("conv_id", F.size("labels").alias("n"), F.size(F.filter("labels", lambda x: x != -100)).alias("trained"))


@q("m19_domain_tables", None)
def _(s, d):
    out = None
    for name in V.DOMAINS:
        one = V.domain_table(s, name, 7, 100).agg(F.lit(name).alias("domain"), F.count("*").alias("n"), F.count_distinct(f"{name}_city").alias("cities"))
        out = one if out is None else out.unionByName(one)
    return out


@q("o6_text_table", "SELECT 'r_regionkey | r_name' AS first_line")
def _(s, d):
    return s.createDataFrame([(sql_tool.text_table(t(s, d, "region")).splitlines()[0],)], "first_line string")


@q("o7_topological_order", "SELECT * FROM (VALUES (0,'region'),(1,'nation'),(2,'customer')) v(pos,name)")
def _(s, d):
    from quern.operators.relational import topological_order

    order = topological_order([("nation", "region"), ("customer", "nation")], ["customer", "nation", "region"])
    return s.createDataFrame(list(enumerate(order)), "pos int, name string")
