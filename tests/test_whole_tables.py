"""Queries that must hold every row of their tables."""

from pyspark.sql import functions as F

from quern.operators.records import packed_blocks
from quern.plans.registry import all_queries

D = "/root/testdata/sf0.01"
QUERIES = {q.name: q for q in all_queries()}


def test_stream_blocks_of_all_turns(spark):
    rows = QUERIES["g11_stream_blocks"].run(spark, D)
    assert rows.count() == spark.read.parquet(f"{D}/conversations.parquet").count()


def test_packed_blocks_drop_masked_and_tail(spark):
    rows = spark.createDataFrame([(1, 9, False), (2, 4, True), (3, 8, False), (4, 1, True)], "id long, n long, live boolean")
    assert {tuple(r) for r in packed_blocks(rows, ["id"], "n", "live", 10).collect()} == {(1, 5)}


def test_weekly_totals_hold_every_order(spark):
    total = QUERIES["a37_weekly_resample"].run(spark, D).agg(F.sum("total")).first()[0]
    assert abs(total - spark.read.parquet(f"{D}/orders.parquet").agg(F.sum("o_totalprice")).first()[0]) < 10


def test_sign_leak_and_engine(spark):
    line = spark.read.parquet(f"{D}/lineitem.parquet")
    r = QUERIES["t8_sign_test"].run(spark, D).first()
    assert r["shorter"] + r["longer"] == line.filter("l_tax <> l_discount").count() and 0 <= r["p"] <= 1
    leak = QUERIES["j13_multi_key_leak"].run(spark, D).first()
    assert leak["leaked"] == line.filter("l_orderkey % 10 = 0").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").distinct().count()
    assert abs(QUERIES["u4_engine"].run(spark, D).first()[0] - spark.read.parquet(f"{D}/customer.parquet").agg(F.sum("c_acctbal")).first()[0]) < 1e-3


def test_snapshots_keep_late_rows_and_pass_no_driver(spark, tmp_path):
    """440 files of rows years apart in no order of time: every event stays once, and none is held by the driver."""
    spark.catalog.dropTempView("quern_r5")
    ts = F.expr("timestamp'2020-01-01' + make_interval(id % 2 * 4)")
    spark.range(880).select(F.col("id").alias("event_id"), ts.alias("ts"), F.lit("v").alias("event_type")).repartition(220).write.parquet(f"{tmp_path}/events.parquet")
    small = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in small}
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        n = QUERIES["r5_snapshot_dedup"].run(spark, str(tmp_path)).first()["n"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n == 880
    assert not spark.catalog.tableExists("quern_r5")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_snapshots_of_no_event(spark, tmp_path):
    spark.read.parquet(f"{D}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["r5_snapshot_dedup"].run(spark, str(tmp_path)).first()["n"] == 0
