"""Small inputs with known results."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import metar as M
from quern.operators import records as REC
from quern.operators import relational as R
from quern.operators import sampling as S
from quern.operators import scoring as SC
from quern.operators import statistics as ST
from quern.operators import temporal as T
from quern.operators import text as X
from quern.operators import windows as WN
from quern.sources import sinks, sql_tool


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_asof_join_is_backward_and_inclusive(spark):
    sales = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "a", 15), (4, "b", 9)], "sale int, product string, ts int")
    prices = spark.createDataFrame([("a", 10, 1.0), ("a", 12, 2.0), ("b", 20, 9.0)], "product string, since int, price double")
    assert collected(R.asof_join(sales, prices, "product", "ts", ["price"], "since").select("sale", "price")) == [(2, 1.0), (3, 2.0)]


def test_upsert_keeps_the_newest_and_prefers_updates(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 9)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "A", 5), (2, "B", 1), (3, "C", 1)], "id int, v string, at int")
    assert collected(R.upsert(base, new, "id", "at")) == [(1, "A", 5), (2, "b", 9), (3, "C", 1)]


def test_set_and_bag_equality(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (1,)], "x int")
    assert R.set_equal(a, b).first()[0] and not R.bag_equal(a, b).first()[0] and R.bag_equal(a, a).first()[0]


def test_closeness_of_nulls_and_nans(spark):
    df = spark.createDataFrame([(1.0, 1.0005), (None, None), (float("nan"), float("nan")), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(R.close(F.col("a"), F.col("b"))).collect()] == [True, True, True, False]


def test_sessions_break_after_more_than_the_gap(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 01:00:01")], "u int, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r["session_id"] for r in T.sessionize(df, "u", "t", "30 minutes").orderBy("t").collect()] == [1, 1, 2]


def test_streak_stops_at_a_missing_day(spark):
    df = spark.createDataFrame([("a", f"2024-01-0{k}", 30) for k in (1, 2, 4, 5, 6)], "g string, d string, v int").withColumn("d", F.to_date("d"))
    assert T.longest_streak(df, "g", "d", F.col("v") > 20).first()["streak"] == 3


def test_weekly_totals_fill_gaps(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-07", 2.0), ("2024-01-16", 4.0)], "d string, v double").withColumn("d", F.to_date("d"))
    assert [r["total"] for r in T.weekly_totals(df, "d", F.col("v")).orderBy("week_end").collect()] == [3.0, 0.0, 4.0]


def test_funnel_needs_strict_order(spark):
    df = spark.createDataFrame([("a", 1, "view"), ("a", 1, "cart"), ("a", 3, "cart"), ("a", 2, "buy"), ("b", 5, "cart"), ("b", 6, "view")], "u string, t int, s string")
    assert collected(T.ordered_funnel(df, "u", "t", "s", ["view", "cart", "buy"])) == sorted([("a", 1, 3, None), ("b", 6, None, None)])


def test_votes(spark):
    v = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, None)], "id int, value string")
    got = {r["id"]: (r["consensus"], r["n_opinions"], r["undecided"]) for r in SC.plurality_vote(v, ["id"]).collect()}
    assert got == {1: ("x", 3, False), 2: (None, 2, True), 3: (None, 0, True)}


def test_alpha(spark):
    perfect = spark.createDataFrame([(u, "a" if u < 3 else "b") for u in range(5) for _ in range(2)], "u int, v string")
    assert SC.krippendorff_alpha(perfect, "u", "v").first()[0] == 1.0
    lonely = spark.createDataFrame([(1, "a"), (2, "b")], "u int, v string")
    assert SC.krippendorff_alpha(lonely, "u", "v").first()[0] is None
    # Units (a,a), (a,b): n = 4, n_a = 3, n_b = 1, D_o = 2, D_e part = 16 - 10 = 6: 1 - 3 * 2 / 6 = 0.
    mixed = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "u int, v string")
    assert abs(SC.krippendorff_alpha(mixed, "u", "v").first()[0]) < 1e-12


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, s double")
    assert SC.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.875)
    assert SC.average_precision(df, "y", "s").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_abstention_lowers_recall_only(spark):
    df = spark.createDataFrame([("HIT",), ("HIT",), ("ABSTAIN",)], "outcome string")
    r = SC.field_metrics(df, []).first()
    assert r["precision"] == 1.0 and r["recall"] == pytest.approx(2 / 3) and r["hallucination"] is None


def test_allocations(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n int")
    assert collected(S.largest_remainder(df, "k", "n", 7)) == [("a", 4), ("b", 2), ("c", 1)]
    df = spark.createDataFrame([("a", 1), ("b", 10), ("c", 10)], "k string, n long")
    quota = lambda total: [r["quota"] for r in S.even_allocation(df, "k", "n", total).orderBy("k").collect()]
    assert quota(12) == [1, 5, 6] and quota(0) == [0, 0, 0] and quota(2) == [0, 1, 1] and quota(21) == quota(99) == [1, 10, 10] and quota(20) == [1, 9, 10]


def test_budget_keeps_the_row_that_crosses(spark):
    df = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "id int, n int").withColumn("g", F.lit(0))
    assert [r["id"] for r in S.budget(df, ["g"], [F.col("id")], F.col("n"), 5).orderBy("id").collect()] == [1, 2]


def test_resume_prefers_rows_without_error(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", "x", 1), ("b", "y", 2)], "k string, error string, seq int")
    assert collected(S.resume_rows(df, "k", "error", "seq").select("k", "seq")) == [("a", 1), ("b", 2)]


def test_first_fit_decreasing(spark):
    df = spark.createDataFrame([(0, k, n) for k, n in enumerate((6, 5, 4, 3, 2, 11))], "shard int, id int, n int")
    assert collected(REC.first_fit_decreasing(df, "shard", "id", "n", 10).select("id", "bin")) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 1), (5, -1)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=25))
def test_packing_never_overfills(spark, sizes):
    df = spark.createDataFrame([(0, k, n) for k, n in enumerate(sizes)], "shard int, id int, n int")
    rows = REC.first_fit_decreasing(df, "shard", "id", "n", 10).collect()
    bins = {}
    for r in rows:
        if r["bin"] >= 0:
            bins[r["bin"]] = bins.get(r["bin"], 0) + r["n"]
    assert len(rows) == len(sizes) and all(v <= 10 for v in bins.values())


def test_boundaries_and_positions(spark):
    r = spark.createDataFrame([([2, 0, 3],)], "l array<long>").select(REC.boundaries(F.col("l")).alias("b"), REC.position_ids(F.col("l")).alias("p")).first()
    assert r["b"] == [0, 2, 2, 5] and r["p"] == [0, 1, 0, 1, 2]


def test_row_order_does_not_matter(spark):
    x = spark.createDataFrame([(1, [{"a": "1"}, {"a": "2"}], [{"a": "2"}, {"a": "1"}])], "id int, t array<map<string,string>>, p array<map<string,string>>")
    pairs = REC.greedy_alignment(x, "id", "t", "p").first()["pairs"]
    assert all(p["truth"] == p["predicted"] for p in pairs)


def test_rows_are_aligned_in_the_order_of_the_truth(spark):
    """Against a plain loop: first best predicted row that is left, null fields of the truth not counted."""
    import random

    rng = random.Random(1)
    some = lambda: [{k: rng.choice(["1", "2", None]) for k in rng.sample("abc", rng.randint(0, 3))} for _ in range(rng.randint(0, 4))]
    rows = [(0, [{"x": "1", "y": "1"}, {"x": "1", "y": "1", "z": "2"}], [{"x": "1", "y": "1", "z": "2"}, {"q": "9"}])] + [(i, some(), some()) for i in range(1, 60)]
    x = spark.createDataFrame([*rows, (99, None, None)], "id int, t array<map<string,string>>, p array<map<string,string>>")
    got = {r["id"]: [(p["truth"], p["predicted"]) for p in r["pairs"]] for r in REC.greedy_alignment(x, "id", "t", "p").collect()}
    for i, truth, predicted in rows:
        left, want = list(range(len(predicted))), []
        for t in truth:
            best = max(left, key=lambda j: (sum(v is not None and predicted[j].get(k) == v for k, v in t.items()), -j), default=None)
            want.append((t, {} if best is None else predicted[best]))
            left = [j for j in left if j != best]
        assert got[i] == want + [({}, predicted[j]) for j in left]
    assert got[99] == [] and got[0][0][1] == {"x": "1", "y": "1", "z": "2"}


def test_exact_tests():
    assert ST.mcnemar_exact(0, 0) == 1.0 and ST.mcnemar_exact(1, 9) == pytest.approx(22 / 1024) and ST.mcnemar_exact(6, 6) == 1.0
    s, p = ST.mcnemar_chi2(5, 5)
    assert s == pytest.approx(0.1) and p == pytest.approx(0.7518, abs=1e-4) and ST.mcnemar_chi2(0, 0) == (0.0, 1.0)
    low, high = ST.clopper_pearson(0, 10)
    assert low == 0.0 and high == pytest.approx(1 - 0.025 ** (1 / 10), abs=1e-9)
    for k, n in ((3, 11), (47, 100), (1, 5000), (4999, 5000)):
        low, high = ST.clopper_pearson(k, n)
        at = lambda p, ks: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in ks)
        assert at(low, range(k, n + 1)) == pytest.approx(0.025, rel=1e-6) and at(high, range(k + 1)) == pytest.approx(0.025, rel=1e-6)
    assert ST.fisher_exact(3, 1, 1, 3) == pytest.approx(34 / 70) and ST.fisher_exact(0, 0, 0, 0) == 1.0
    assert 0 <= ST.mcnemar_exact(200_000, 201_000) < 0.2


def test_read_only_runner_refuses_what_changes(spark):
    from quern.sources import sql_tool

    spark.range(3).createOrReplaceTempView("vv")
    assert sql_tool.read_only_rows(spark, "SELECT ';' AS a, count(*) FROM vv; -- done; really")["rows"] == [(";", 3)]
    for bad in ("DROP VIEW vv", "SET x = 1", "INSERT INTO vv SELECT 1", "CREATE TEMP VIEW w AS SELECT 1", "WITH q AS (SELECT 1) INSERT INTO vv SELECT * FROM q", "SELECT 1; DROP VIEW vv", "CACHE TABLE vv", "USE x", "ADD JAR 'x'", ""):
        assert not sql_tool.read_only_rows(spark, bad)["ok"], bad
    assert sql_tool.read_only_rows(spark, "SELECT * FROM vv", most_rows=2)["more"]


def test_bootstrap_brackets_and_repeats(spark):
    df = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("int").alias("ok"))
    a = ST.bootstrap_interval(df, "id", "ok", 300).first()
    b = ST.bootstrap_interval(df.repartition(7), "id", "ok", 300).first()
    assert a["low"] < 0.25 < a["high"] and a["high"] - a["low"] < 0.12 and a["low"] == pytest.approx(b["low"])


def test_surrogate_ids_match_any_partitioning(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("k"))
    one, many = (collected(WN.surrogate_ids(df, ["k"], partitions=n)) for n in (1, 9))
    assert one == many == [(k, i + 1) for i, k in enumerate(sorted(r["k"] for r in df.collect()))]


def test_run_segments(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate((1.0, 2.0, 1.0, 9.0, 8.0, 9.0))], "k int, t int, v double")
    # Starts 1, 1, 8 (median 1): the run from 8 starts above twice the median and is merged.
    assert [r["run"] for r in WN.run_segments(df, "k", ["t"], "v").orderBy("t").collect()] == [1, 1, 2, 2, 2, 2]


def test_short_items(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "a b"), (3, " ".join("w" * 14))], "id int, text string")
    assert collected(X.short_items(df, "id", "text", 6, 13)) == [(1, " one two three four five six ")]


def test_sql_tool(spark):
    assert sql_tool.run_sql(spark, "SELECT 1 AS a; SELECT 2").startswith("ERROR")
    assert sql_tool.run_sql(spark, "SELECT nope").startswith("ERROR")
    assert sql_tool.run_sql(spark, "SELECT 1 AS a") == "a\n1"
    with pytest.raises(ValueError):
        sql_tool.register({"Bad Name": spark.range(1)})


def test_content_hash_ignores_partitioning(spark):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("b"))
    assert sinks.content_hash(df, "id") == sinks.content_hash(df.repartition(5), "id")


@settings(max_examples=20, deadline=None)
@given(
    st.integers(0, 360), st.integers(0, 99), st.one_of(st.none(), st.integers(0, 99)), st.integers(0, 99), st.integers(-40, 45), st.integers(-40, 45), st.integers(900, 1080),
    st.lists(st.sampled_from(["FEW010", "SCT025", "BKN040CB", "OVC100"]), max_size=2),
)
def test_metar_round_trip(spark, direction, speed, gust, vis, temp, dew, hpa, clouds):
    given_ = (direction, speed, gust, vis * 100, temp, dew, hpa, False, clouds, [], "METAR")
    types = "wind_dir int, wind_speed int, wind_gust int, visibility_m int, temperature int, dewpoint int, altimeter int, cavok boolean, clouds array<string>, weather array<string>, report_type string"
    df = spark.createDataFrame([(*given_, "LFPG", 12, 12, 30)], types + ", station string, day int, hour int, minute int")
    text = df.select(M.encode({f: F.col(f) for f in M.FIELDS}, {f: F.col(f) for f in ("station", "day", "hour", "minute")}).alias("raw"))
    raw = text.first()["raw"]
    walked = M._walk(raw)
    assert tuple(walked[f] for f in M.FIELDS) == given_


def test_voices_agree_on_fixtures(spark):
    from quern.plans import weather

    bad = weather.votes(spark).filter("voice <> 'q_only'").groupBy("id", "field").agg(F.count_distinct("value").alias("n")).filter("n > 1")
    assert bad.count() == 0


def test_mutants_are_noticed_where_expected(spark):
    from quern.plans import weather

    rows = {q.name: q for q in weather.QUERIES}["d19_mutants"].run(spark, "").collect()
    assert rows and all(r["expected"] == r["noticed"] for r in rows)


@pytest.mark.parametrize("name", ["l4_logistic_folds", "l5_train_test", "l6_knn", "l8_negative_controls", "l12_probe_tasks"])
def test_learners_pass_their_bars(spark, name):
    from quern.plans import connectors

    assert {q.name: q for q in connectors.QUERIES}[name].run(spark, "").first()[0]


def test_gram_rows_of_long_and_odd_texts(spark, monkeypatch):
    """Grams of texts over a part, with clashing rows, nulls and short texts, against a plain loop."""
    import random
    import re

    from quern.operators import grams as G

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeXY09") for _ in range(rng.randint(1, 6)))
    rows = [(1, " ".join(word() for _ in range(4000))), (2, None), (3, ""), (4, "a b c"), (5, "a-b c_d, é e f g" * 30), (6, "x" * 9000)]
    n = 4
    wanted = {(k, " ".join(w[i : i + n])) for k, text in rows for w in [re.findall("[a-z0-9]+", (text or "").lower())] for i in range(len(w) - n + 1)}
    df = spark.createDataFrame(rows, "id int, text string").repartition(1)
    assert {(r["id"], r["gram"]) for r in G.gram_rows(df, "id", "text", n).collect()} == wanted
    column = [memoryview(text.lower().encode()) for _, text in rows[:1]]
    monkeypatch.setattr(G, "PART", 500)
    found = set()
    for data in G._parts(column[0], n):
        w = re.findall("[a-z0-9]+", data.tobytes().decode())
        found |= {" ".join(w[i : i + n]) for i in range(1, len(w) - n)}
    whole = re.findall("[a-z0-9]+", rows[0][1].lower())
    assert found >= {" ".join(whole[i : i + n]) for i in range(1, len(whole) - n)}
