"""Record parsing, consensus and quality over our own weather fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import metar as M
from quern.operators import scoring as SC
from quern.plans.fixtures import METARS, TAFS
from quern.plans.registry import Query
from quern.plans.textual import values

QUERIES: list[Query] = []
VALUES = values(METARS, "id, raw")
BODY = "regexp_replace(regexp_replace(regexp_replace(trim(raw),'=$',''),' RMK\\b.*$',''),' (?:BECMG|TEMPO|NOSIG)\\b.*$','')"
HEAD = "^(?:(METAR|SPECI) )?(?:COR )?([A-Z][A-Z0-9]{3}) ([0-3][0-9])([0-2][0-9])([0-5][0-9])Z\\b"


def q(name, sql=None):
    def add(f):
        QUERIES.append(Query(name, f, sql))
        return f

    return add


def golden(rows, names):
    """Results read off the fixtures by hand."""
    return f"SELECT * FROM {values(rows, names)}"


def reports(s):
    return s.createDataFrame(METARS, "id int, raw string")


def decoded(s):
    """Fixtures with the structs of three voices: patterns, token walk, and patterns that read only Q altimeters."""
    as_struct = lambda r: F.struct(*[r[f].alias(f) for f in M.FIELDS])
    r = F.col("raw")
    return reports(s).select("id", "raw", as_struct(M.decode(r)).alias("v1"), M.walked(r).alias("v2"), as_struct(M.decode(r, "Q")).alias("v3"))


VOICES = {"patterns": F.col, "walk": F.col, "q_only": F.col}


def votes(s):
    return M.long_votes(decoded(s), "id", {"patterns": F.col("v1"), "walk": F.col("v2"), "q_only": F.col("v3")})


@q("d1_metar_header", f"SELECT id, CASE WHEN regexp_matches(raw,'{HEAD}') THEN coalesce(nullif(regexp_extract(raw,'{HEAD}',1),''),'METAR') END AS report_type, nullif(regexp_extract(raw,'{HEAD}',2),'') AS station, try_cast(nullif(regexp_extract(raw,'{HEAD}',3),'') AS INTEGER) AS day, regexp_matches(raw,'{HEAD}') AS ok FROM {VALUES}")
def _(s, d):
    h = M.header(F.col("raw"))
    return reports(s).select("id", *[h[k].alias(k) for k in ("report_type", "station", "day", "ok")])


@q("d2_metar_modifiers", f"SELECT id, regexp_matches(b,'\\bAUTO\\b') AS auto, regexp_matches(b,'\\bCOR\\b') AS cor, regexp_matches(b,'\\bCAVOK\\b') AS cavok, nullif(regexp_extract(b,' (Q|A)[0-9]{{4}}\\b',1),'') AS altimeter_source FROM (SELECT id, {BODY} AS b FROM {VALUES})")
def _(s, d):
    return reports(s).select("id", *[c.alias(k) for k, c in M.modifiers(F.col("raw")).items()])


@q("d3_metar_voices", None)
def _(s, d):
    return decoded(s).select("id", "v1.*")


@q("d4_visibility", f"""SELECT id, CASE WHEN NOT regexp_matches(b,'\\bCAVOK\\b') THEN coalesce(try_cast(nullif(regexp_extract(b,' ([0-9]{{4}})(?:NDV)?(?: |$)',1),'') AS DOUBLE),
   round_even(1609.344*coalesce(coalesce(try_cast(nullif(regexp_extract(b,' (?:([0-9]{{1,2}}) )?[PM]?([0-9]{{1,2}})/([0-9]{{1,2}})SM\\b',1),'') AS DOUBLE),0) + try_cast(nullif(regexp_extract(b,' (?:([0-9]{{1,2}}) )?[PM]?([0-9]{{1,2}})/([0-9]{{1,2}})SM\\b',2),'') AS DOUBLE)/try_cast(nullif(regexp_extract(b,' (?:([0-9]{{1,2}}) )?[PM]?([0-9]{{1,2}})/([0-9]{{1,2}})SM\\b',3),'') AS DOUBLE),
   try_cast(nullif(regexp_extract(b,' [PM]?([0-9]{{1,2}})SM\\b',1),'') AS DOUBLE)),0)) END AS metres FROM (SELECT id, {BODY} AS b FROM {VALUES})""")
def _(s, d):
    return reports(s).select("id", M.visibility(M.body(F.col("raw"))).alias("metres"))


@q("d5_taf_header", f"SELECT id, nullif(regexp_extract(raw,'^(?:TAF )?(?:(AMD|COR) )?([A-Z][A-Z0-9]{{3}}) ',2),'') AS station, coalesce(nullif(regexp_extract(raw,'\\b(NIL|CNL)\\b',1),''), nullif(regexp_extract(raw,'^(?:TAF )?(?:(AMD|COR) )?',1),'')) AS status FROM {values(TAFS, 'id, raw')}")
def _(s, d):
    h = M.taf_header(F.col("raw"))
    return s.createDataFrame(TAFS, "id int, raw string").select("id", h["station"].alias("station"), h["status"].alias("status"))


@q("d6_change_groups", None)
def _(s, d):
    x = s.createDataFrame(TAFS, "id int, raw string").filter(M.taf_header(F.col("raw"))["ok"])
    return x.select("id", F.posexplode(M.taf_periods(F.col("raw"))).alias("pos", "p")).select("id", "pos", "p.change_type", "p.probability", "p.start")


@q("d7_forecast_xml", None)
def _(s, d):
    from quern.sources.readers import forecast_periods

    xml = '<forecast><fcst_time_from>2026-06-01T00:00:00Z</fcst_time_from><change_indicator>FM</change_indicator><wind_dir_degrees>240</wind_dir_degrees><sky_condition sky_cover="BKN" cloud_base_ft_agl="1200"/></forecast>'
    return forecast_periods(s.createDataFrame([(1, f"<TAF>{xml}{xml}</TAF>"), (2, "<TAF></TAF>")], "id int, xml string"), "id", "xml")


@q("d8_failure_capture", f"SELECT id, regexp_matches(raw,'{HEAD}') AS ok, CASE WHEN NOT regexp_matches(raw,'{HEAD}') THEN 'header' END AS error FROM {VALUES}")
def _(s, d):
    ok = M.header(F.col("raw"))["ok"]
    return reports(s).select("id", ok.alias("ok"), F.when(~ok, "header").alias("error"))


@q("d9_flatten", None)
def _(s, d):
    return votes(s)


@q("d11_period_vote", None)
def _(s, d):
    x = s.createDataFrame(TAFS, "id int, raw string").filter(M.taf_header(F.col("raw"))["ok"]).select("id", M.taf_periods(F.col("raw")).alias("a"))
    x = x.withColumn("b", F.transform("a", lambda p: p.withField("wind_gust", F.lit(None).cast("int"))))
    x = x.filter("size(a) > 0")
    v = M.aligned_period_votes(x, "id", {"one": "a", "two": "b"}, ["change_type", "wind_dir", "wind_gust"])
    return SC.plurality_vote(v, ["id", "pos", "field"])


@q("d12_invariants", golden([(k, {6: "dewpoint above temperature", 7: "gust not above wind, clouds not ascending", 9: "altimeter range"}.get(k, "")) for k in range(1, 13)], "id, broken"))
def _(s, d):
    return decoded(s).select("id", F.array_join(M.invariants({f: F.col("v1")[f] for f in M.FIELDS}), ", ").alias("broken"))


@q("d13_round_trip", golden([(k, "false" if k == 3 else "true") for k in (1, 2, 3, 4, 5, 6, 7, 9, 10, 12)], "id, same"))
def _(s, d):
    r, h = M.decode(F.col("raw")), M.header(F.col("raw"))
    once = reports(s).filter(h["ok"]).select("id", F.struct(*[r[f].alias(f) for f in M.FIELDS]).alias("a"), M.encode(r, h).alias("text"))
    again = M.decode(F.col("text"))
    return once.select("id", (F.to_json(F.struct(*[again[f].alias(f) for f in M.FIELDS])) == F.to_json("a")).cast("string").alias("same"))


def labelled(s):
    x = decoded(s)
    c = M.consensus(M.long_votes(x, "id", {"patterns": F.col("v1"), "walk": F.col("v2"), "q_only": F.col("v3")}), "id")
    per = c.groupBy("id").agg(F.bool_or(F.col("undecided") & (F.col("n_opinions") > 0)).alias("undecided"), F.bool_or(F.coalesce(F.col("agreement") < 1, F.lit(False))).alias("dissent"))
    broken = F.size(M.invariants({f: F.col("v1")[f] for f in M.FIELDS})) > 0
    return x.join(per, "id").select("id", "raw", M.hard_label(F.col("v1.report_type").isNull(), broken, F.col("undecided"), F.col("dissent")).alias("label"))


@q("d14_hard_case_label", golden([(k, "invariant" if k in (6, 7, 9) else "parse_fail" if k in (8, 11) else "clean") for k in range(1, 13)], "id, label"))
def _(s, d):
    return labelled(s).select("id", "label")


@q("d15_taf_label", golden([(1, "clean"), (2, "clean"), (3, "parse_fail"), (4, "clean"), (5, "parse_fail")], "id, label"))
def _(s, d):
    x = s.createDataFrame(TAFS, "id int, raw string")
    n = F.when(M.taf_header(F.col("raw"))["ok"], F.size(M.taf_periods(F.col("raw")))).otherwise(0)
    return x.select("id", M.taf_label(F.when(n > 0, 2).otherwise(0), F.lit(False), F.lit(False)).alias("label"))


@q("d17_gold_calibration", "SELECT f AS field, n::BIGINT AS compared, n::BIGINT AS matched, 1.0::DOUBLE AS accuracy FROM " + values(
    [("altimeter", 10), ("cavok", 10), ("clouds", 8), ("dewpoint", 10), ("report_type", 10), ("temperature", 10), ("visibility_m", 9), ("weather", 6), ("wind_dir", 9), ("wind_gust", 2), ("wind_speed", 10)], "f, n"))
def _(s, d):
    v = votes(s)
    gold = v.filter("voice = 'walk'").select("id", "field", F.col("value").alias("gold"))
    j = v.filter("voice = 'patterns'").join(gold, ["id", "field"]).filter("value is not null and gold is not null")
    return j.groupBy("field").agg(F.count("*").alias("compared"), F.count_if(F.col("value") == F.col("gold")).alias("matched"), F.round(F.avg((F.col("value") == F.col("gold")).cast("int")), 6).alias("accuracy"))


@q("d18_gold_fields", f"SELECT v, round_even(try_cast(v AS DOUBLE)*33.8639,0) AS hpa, round_even(try_cast(v AS DOUBLE)*1609.344,0) AS metres FROM {values([('29.92',), ('10',), ('x',)], 'v')}")
def _(s, d):
    x = s.createDataFrame([("29.92",), ("10",), ("x",)], "v string")
    n = F.col("v").try_cast("double")
    return x.select("v", F.bround(n * M.INHG_TO_HPA, 0).alias("hpa"), F.bround(n * M.MILE_TO_M, 0).alias("metres"))


@q("d19_mutants", "SELECT id, mutant, e AS expected, e AS noticed FROM " + values(
    [(k, m, c) for k in (1, 5, 10) for m, c in (("station_cut", "parse"), ("dewpoint_high", "invariant"), ("gust_low", "invariant"), ("pressure_high", "invariant"), ("time_cut", "parse"), ("plausible_shift", "none"))
     if (k, m) not in ((5, "gust_low"), (1, "plausible_shift"))], "id, mutant, e"))
def _(s, d):
    m = M.mutate(reports(s).filter("id in (1, 5, 10)"), "raw")
    r = M.decode(F.col("mutated"))
    noticed = F.when(~M.header(F.col("mutated"))["ok"], "parse").when(F.size(M.invariants(r)) > 0, "invariant").otherwise("none")
    return m.select("id", "mutant", "expected", noticed.alias("noticed"))


@q("d22_taf_scoring", "SELECT id, 'p' || p || '.change_type' AS key, CASE WHEN p = 0 THEN 'HIT' ELSE 'ABSTAIN' END AS outcome FROM " + values(
    [(k, p) for k, n in ((1, 3), (2, 3), (4, 2)) for p in range(n)], "id, p"))
def _(s, d):
    from quern.operators.records import zip_positions

    x = s.createDataFrame(TAFS, "id int, raw string").filter(M.taf_header(F.col("raw"))["ok"]).select("id", F.transform(M.taf_periods(F.col("raw")), lambda p: p["change_type"]).alias("xs"))
    z = zip_positions(x, x.withColumn("xs", F.slice("xs", 1, 1)), "id", "xs")
    return z.select("id", F.concat(F.lit("p"), (F.col("pos") - 1).cast("string"), F.lit(".change_type")).alias("key"), SC.outcome(F.col("left_v"), F.col("right_v")).alias("outcome"))


@q("d23_row_scoring", None)
def _(s, d):
    from quern.operators.records import greedy_alignment

    rows = [(1, [{"rwy": "09", "st": "CLSD"}, {"rwy": "27", "st": "OPN"}], [{"rwy": "27", "st": "OPN"}, {"rwy": "09", "st": "WIP"}]), (2, [{"rwy": "01"}], []), (3, [], [{"rwy": "02"}])]
    x = s.createDataFrame(rows, "id int, t array<map<string,string>>, p array<map<string,string>>")
    pairs = greedy_alignment(x, "id", "t", "p").select("id", F.posexplode("pairs").alias("k", "pr"))
    keys = F.array_distinct(F.concat(F.map_keys("pr.truth"), F.map_keys("pr.predicted")))
    long = pairs.select("id", "k", "pr", F.explode(keys).alias("field"))
    return long.select("id", F.concat(F.lit("r"), F.col("k").cast("string"), F.lit("."), F.col("field")).alias("key"), SC.outcome(F.try_element_at("pr.truth", F.col("field")), F.try_element_at("pr.predicted", F.col("field"))).alias("outcome"))


@q("j17_greedy_alignment", None)
def _(s, d):
    from quern.operators.records import greedy_alignment

    rows = [(1, [{"a": "1"}, {"a": "2"}], [{"a": "2"}, {"a": "3"}])]
    return greedy_alignment(s.createDataFrame(rows, "id int, t array<map<string,string>>, p array<map<string,string>>"), "id", "t", "p")


@q("d24_notice_pipeline", f"SELECT substr(sha1(v),1,12) AS id, v FROM {values([('RWY 09 CLSD',), ('TWY A WIP',)], 'v')}")
def _(s, d):
    from quern.sources.readers import notices

    raw = s.createDataFrame([("RWY 09 CLSD",), ("TWY A WIP",), ("RWY 09 CLSD",), ("跑道 closed",), ("  ",), (None,)], "v string")
    return notices(raw, "v")


@q("d25_taf_body", None)
def _(s, d):
    x = s.createDataFrame(TAFS, "id int, raw string").filter(M.taf_header(F.col("raw"))["ok"])
    return x.select("id", F.posexplode(M.taf_periods(F.col("raw"))).alias("pos", "p")).select("id", "pos", "p.*")


@q("d26_scope_probe", "SELECT id = 1 AS auto, n::BIGINT AS n, f::BIGINT AS failed_patterns, f::BIGINT AS failed_walk, f::BIGINT AS any_, f::BIGINT AS all_ FROM " + values([(0, 11, 2), (1, 1, 0)], "id, n, f"))
def _(s, d):
    x = decoded(s).select("id", F.col("v1.report_type").isNull().alias("f1"), F.col("v2.report_type").isNull().alias("f2"), M.modifiers(F.col("raw"))["auto"].alias("auto"))
    return x.groupBy("auto").agg(F.count("*").alias("n"), F.count_if("f1").alias("failed_patterns"), F.count_if("f2").alias("failed_walk"), F.count_if(F.col("f1") | F.col("f2")).alias("any_"), F.count_if(F.col("f1") & F.col("f2")).alias("all_"))


@q("d27_voice_rules", golden(
    [(1, 1015, 1015, 10000, "false"), (2, 998, 998, 800, "false"), (3, 1013, None, 16100, "false"), (4, 1023, 1023, None, "true"), (5, 1009, 1009, 3000, "false"), (6, 1016, None, 2400, "false"),
     (7, 1012, 1012, 10000, "false"), (8, None, None, None, None), (9, 1101, 1101, 10000, "false"), (10, 1002, 1002, 6000, "false"), (11, None, None, None, None), (12, 1014, None, 800, "false")],
    "id, both_sources, q_only, visibility_m, cavok"))
def _(s, d):
    return decoded(s).select("id", F.col("v1.altimeter").alias("both_sources"), F.col("v3.altimeter").alias("q_only"), F.col("v1.visibility_m").alias("visibility_m"), F.col("v1.cavok").cast("string").alias("cavok"))
