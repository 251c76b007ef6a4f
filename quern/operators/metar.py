"""Weather reports as columns: header, body, votes of independent decoders, invariants, encoding, labels, mutants."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.scoring import plurality_vote

#: Conversion factors.
MPS_TO_KT, MILE_TO_M, INHG_TO_HPA = 1.94384, 1609.344, 33.8639
FIELDS = ["wind_dir", "wind_speed", "wind_gust", "visibility_m", "temperature", "dewpoint", "altimeter", "cavok", "clouds", "weather", "report_type"]
HEADER = r"^(?:(METAR|SPECI) )?(?:COR )?([A-Z][A-Z0-9]{3}) ([0-3][0-9])([0-2][0-9])([0-5][0-9])Z\b"
TREND = r" (?:BECMG|TEMPO|NOSIG)\b.*$"
WIND = r"(?:^| )(\d{3}|VRB)(\d{2,3})(?:G(\d{2,3}))?(KT|MPS)\b"
CLOUD = r"\b((?:FEW|SCT|BKN|OVC)\d{3}(?:CB|TCU)?|VV\d{3})\b"
WEATHER = r"(?:^| )([+-]?(?:VC)?(?:TS|SH|FZ|MI|BC|BL|DR)?(?:RA|SN|DZ|GR|GS|PL|BR|FG|HZ|FU|DU|SA|SQ)+|[+-]?TS)(?= |$)"


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def body(raw: Column) -> Column:
    """The report without remarks and trend."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(raw), "=$", ""), r" RMK\b.*$", ""), TREND, "")


def header(raw: Column) -> dict[str, Column]:
    """Type (METAR where none is given), station, day, hour, minute and whether the header could be read."""
    num = lambda k: _group(raw, HEADER, k).try_cast("int")
    ok = raw.rlike(HEADER)
    return {
        "report_type": F.when(ok, F.coalesce(_group(raw, HEADER, 1), F.lit("METAR"))), "station": _group(raw, HEADER, 2),
        "day": num(3), "hour": num(4), "minute": num(5), "ok": F.coalesce(ok, F.lit(False)),
    }


def modifiers(raw: Column) -> dict[str, Column]:
    """AUTO, COR, CAVOK (in the body only) and the source of the altimeter (Q or A)."""
    b = body(raw)
    return {"auto": b.rlike(r"\bAUTO\b"), "cor": b.rlike(r"\bCOR\b"), "cavok": b.rlike(r"\bCAVOK\b"), "altimeter_source": _group(b, r" (Q|A)\d{4}\b", 1)}


def visibility(b: Column) -> Column:
    """Metres: four digits, or statute miles with fractions; CAVOK leaves it NULL."""
    metres = _group(b, r" (\d{4})(?:NDV)?(?= |$)", 1).try_cast("double")
    whole, num, den = (_group(b, r" (?:(\d{1,2}) )?[PM]?(\d{1,2})/(\d{1,2})SM\b", k).try_cast("double") for k in (1, 2, 3))
    plain = _group(b, r" [PM]?(\d{1,2})SM\b", 1).try_cast("double")
    miles = F.coalesce(F.coalesce(whole, F.lit(0.0)) + num / F.nullif(den, F.lit(0.0)), plain)
    return F.when(~b.rlike(r"\bCAVOK\b"), F.coalesce(metres, F.bround(miles * MILE_TO_M)))


def temperature(b: Column, k: int) -> Column:
    text = _group(b, r" (M?\d{2})/(M?\d{2})(?= |$)", k)
    return F.replace(text, F.lit("M"), F.lit("-")).try_cast("int")


def decode(raw: Column, altimeter_from: str = "QA") -> dict[str, Column]:
    """Voice 1: every field by a pattern of its own; altimeter_from limits the altimeter groups that it reads."""
    b, h = body(raw), header(raw)
    factor = F.when(_group(b, WIND, 4) == "MPS", MPS_TO_KT).otherwise(1.0)
    speed = lambda k: F.bround(_group(b, WIND, k).try_cast("double") * factor).cast("int")
    q, a = _group(b, r" Q(\d{4})\b", 1).try_cast("double"), _group(b, r" A(\d{4})\b", 1).try_cast("double")
    hpa = F.coalesce(q if "Q" in altimeter_from else F.lit(None).cast("double"), a / 100 * INHG_TO_HPA if "A" in altimeter_from else F.lit(None).cast("double"))
    out = {
        "wind_dir": _group(b, WIND, 1).try_cast("int"), "wind_speed": speed(2), "wind_gust": speed(3),
        "visibility_m": (F.bround(visibility(b) / 100) * 100).cast("int"), "temperature": temperature(b, 1), "dewpoint": temperature(b, 2),
        "altimeter": F.bround(hpa).cast("int"), "cavok": b.rlike(r"\bCAVOK\b"), "clouds": F.regexp_extract_all(b, F.lit(CLOUD), 1),
        "weather": F.regexp_extract_all(b, F.lit(WEATHER), 1), "report_type": h["report_type"],
    }
    return {k: F.when(h["ok"], v) for k, v in out.items()}


_TEXTS = ("clouds", "weather")
_STRUCT = T.StructType(
    [
        T.StructField(f, T.ArrayType(T.StringType()) if f in _TEXTS else T.BooleanType() if f == "cavok" else T.StringType() if f == "report_type" else T.IntegerType())
        for f in FIELDS
    ]
)


def _walk(raw: str | None) -> dict | None:
    """One report by a walk over its tokens; None where the header cannot be read."""
    parts = (raw or "").strip().rstrip("=").split(" ")
    out: dict = dict.fromkeys(FIELDS)
    out |= {"cavok": False, "clouds": [], "weather": [], "report_type": "METAR"}
    if parts[0] in ("METAR", "SPECI"):
        out["report_type"] = parts.pop(0)
    if parts and parts[0] == "COR":
        parts.pop(0)
    if len(parts) < 2 or not (len(parts[0]) == 4 and parts[0][0].isalpha() and parts[0].isalnum() and parts[0].isupper()):
        return None
    if not re.fullmatch(r"[0-3]\d[0-2]\d[0-5]\dZ", parts[1]):
        return None
    miles = None
    for k, token in enumerate(parts[2:], 2):
        if token in ("RMK", "BECMG", "TEMPO", "NOSIG"):
            break
        if token == "CAVOK":
            out["cavok"] = True
        elif token.endswith(("KT", "MPS")) and token[:3] != "WND":
            unit = 1.0 if token.endswith("KT") else MPS_TO_KT
            core = token[: -2 if token.endswith("KT") else -3]
            main, _, gust = core[3:].partition("G")
            if (core[:3] == "VRB" or core[:3].isdigit()) and main.isdigit():
                out["wind_dir"] = int(core[:3]) if core[:3].isdigit() else None
                out["wind_speed"] = round(int(main) * unit)
                out["wind_gust"] = round(int(gust) * unit) if gust.isdigit() else None
        elif token.endswith("SM"):
            text = token[:-2].lstrip("PM")
            top, _, bottom = text.partition("/")
            if top.isdigit() and (not bottom or bottom.isdigit() and int(bottom)):
                miles = int(top) / int(bottom) if bottom else float(top)
                if bottom and parts[k - 1].isdigit() and len(parts[k - 1]) <= 2:
                    miles += int(parts[k - 1])
                out["visibility_m"] = round(round(miles * MILE_TO_M) / 100) * 100
        elif len(token) == 4 and token.isdigit() or len(token) == 7 and token.endswith("NDV"):
            out["visibility_m"] = round(int(token[:4]) / 100) * 100
        elif "/" in token and len(token) in (5, 6, 7) and token.replace("M", "").replace("/", "").isdigit():
            a, b = token.split("/")
            if len(a.lstrip("M")) == 2 and len(b.lstrip("M")) == 2:
                out["temperature"], out["dewpoint"] = (int(x.replace("M", "-")) for x in (a, b))
        elif token[0:1] in ("Q", "A") and len(token) == 5 and token[1:].isdigit():
            out["altimeter"] = int(token[1:]) if token[0] == "Q" else round(int(token[1:]) / 100 * INHG_TO_HPA)
        elif re.fullmatch(r"(FEW|SCT|BKN|OVC)\d{3}(CB|TCU)?|VV\d{3}", token):
            out["clouds"].append(token)
        elif re.fullmatch(WEATHER[8:-8], token):
            out["weather"].append(token)
    if out["cavok"]:
        out["visibility_m"] = None
    return out


@F.pandas_udf(_STRUCT)
def walked(raw: pd.Series) -> pd.DataFrame:
    """Voice 2: the token walk, over Arrow batches; NULL fields where the header cannot be read."""
    rows = [_walk(x) or dict.fromkeys(FIELDS) for x in raw]
    return pd.DataFrame({f: pd.Series([r[f] for r in rows], dtype="object") for f in FIELDS})


def long_votes(df: DataFrame, key: str, voices: Mapping[str, Column]) -> DataFrame:
    """key, voice, field, value: every field of every voice's struct as JSON text, NULL where it abstains."""
    made = []
    for voice, record in voices.items():
        for f in FIELDS:
            v = record[f]
            text = F.to_json(v) if f in ("clouds", "weather") else v.cast("string")
            made.append(F.struct(F.lit(voice).alias("voice"), F.lit(f).alias("field"), F.nullif(text, F.lit("[]")).alias("value")))
    return df.select(key, F.explode(F.array(*made)).alias("v")).select(key, "v.*")


def consensus(votes: DataFrame, key: str) -> DataFrame:
    return plurality_vote(votes, [key, "field"])


def invariants(r: Mapping[str, Column]) -> Column:
    """Messages of the physical rules that a record breaks."""
    bases = F.transform(F.filter(r["clouds"], lambda c: ~c.rlike("CB|TCU|^VV")), lambda c: F.regexp_extract(c, r"(\d{3})", 1).cast("int"))
    rules = [
        (r["dewpoint"] > r["temperature"], "dewpoint above temperature"),
        (r["wind_gust"] <= r["wind_speed"], "gust not above wind"),
        ((r["wind_dir"] < 0) | (r["wind_dir"] > 360), "wind direction"),
        (F.sort_array(bases) != bases, "clouds not ascending"),
        (~r["temperature"].between(-80, 60), "temperature range"),
        (~r["altimeter"].between(850, 1090), "altimeter range"),
        (r["cavok"] & (F.size(r["clouds"]) > 0), "cavok with clouds"),
        (r["cavok"] & r["visibility_m"].isNotNull(), "cavok with visibility"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in rules]), lambda x: x.isNotNull())


def _signed(x: Column) -> Column:
    return F.concat(F.when(x < 0, "M").otherwise(""), F.lpad(F.abs(x).cast("string"), 2, "0"))


def encode(r: Mapping[str, Column], h: Mapping[str, Column]) -> Column:
    """A report from its fields; decode() gives the fields back (visibility of 10 km or more is written 9999)."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    wind = F.concat(
        F.coalesce(F.lpad(r["wind_dir"].cast("string"), 3, "0"), F.lit("VRB")), two(r["wind_speed"]),
        F.coalesce(F.concat(F.lit("G"), two(r["wind_gust"])), F.lit("")), F.lit("KT"),
    )
    return F.concat_ws(
        " ", r["report_type"], h["station"], F.concat(two(h["day"]), two(h["hour"]), two(h["minute"]), F.lit("Z")), wind,
        F.when(r["cavok"], "CAVOK"), F.when(r["visibility_m"].isNotNull(), F.lpad(F.least(r["visibility_m"], F.lit(9999)).cast("string"), 4, "0")), F.nullif(F.array_join(r["weather"], " "), F.lit("")),
        F.nullif(F.array_join(r["clouds"], " "), F.lit("")), F.concat(_signed(r["temperature"]), F.lit("/"), _signed(r["dewpoint"])),
        F.concat(F.lit("Q"), F.lpad(r["altimeter"].cast("string"), 4, "0")),
    )


def hard_label(failed: Column, broken: Column, undecided: Column, dissent: Column) -> Column:
    """parse_fail before invariant before no_majority before dissent before clean."""
    return F.when(failed, "parse_fail").when(broken, "invariant").when(undecided, "no_majority").when(dissent, "dissent").otherwise("clean")


#: Mutants: name, pattern, replacement, the channel that should notice.
MUTANTS = [
    ("station_cut", r"^((?:METAR |SPECI )?)([A-Z]{3})[A-Z0-9] ", "$1$2 ", "parse"),
    ("dewpoint_high", r" (M?\d{2})/(M?\d{2})( |$)", " $1/59$3", "invariant"),
    ("gust_low", r"(\d{3})(\d{2})(?:G\d{2})?KT", "$199G05KT", "invariant"),
    ("pressure_high", r" Q\d{4}", " Q1099", "invariant"),
    ("time_cut", r"(\d{5})\dZ", "$1Z", "parse"),
    ("plausible_shift", r" Q10(\d)\d", " Q10$15", "none"),
]


def mutate(df: DataFrame, raw: str) -> DataFrame:
    """One row per mutant that changes the text: mutant, expected channel, mutated text."""
    made = F.array(*[F.struct(F.lit(n).alias("mutant"), F.lit(c).alias("expected"), F.regexp_replace(F.col(raw), p, r).alias("mutated")) for n, p, r, c in MUTANTS])
    return df.withColumn("m", F.explode(made)).select(*df.columns, "m.*").filter(F.col("mutated") != F.col(raw))


# ---- forecasts -------------------------------------------------------------------------------------------------

TAF_HEADER = r"^(?:TAF )?(?:(AMD|COR) )?([A-Z][A-Z0-9]{3}) (?:(\d{2})(\d{2})(\d{2})Z )?(?:(\d{2})(\d{2})/(\d{2})(\d{2})|(NIL|CNL))?"
SPLIT = r" (?=FM\d{6}\b|BECMG\b|PROB[34]0\b)| (?<!PROB[34]0 )(?=TEMPO\b)"


def taf_header(raw: Column) -> dict[str, Column]:
    """Station, status (NIL, CNL, AMD, COR or NULL), validity and whether the header could be read."""
    ok = raw.rlike(TAF_HEADER)
    status = F.coalesce(_group(raw, TAF_HEADER, 10), F.when(raw.rlike(r"\bCNL\b"), "CNL"), _group(raw, TAF_HEADER, 1))
    num = lambda k: _group(raw, TAF_HEADER, k).try_cast("int")
    return {"station": _group(raw, TAF_HEADER, 2), "status": status, "from_day": num(6), "from_hour": num(7), "to_day": num(8), "to_hour": num(9), "ok": ok}


def taf_periods(raw: Column) -> Column:
    """Array of periods: change type and probability, start, and the decoded elements; the base group is INITIAL."""
    clean = F.regexp_replace(F.trim(raw), "=$", "")
    base = F.regexp_replace(clean, TAF_HEADER, "INITIAL")
    groups = F.split(base, SPLIT)

    def period(g):
        kind = (
            F.when(g.rlike(r"^PROB[34]0 TEMPO"), "PROB_TEMPO").when(g.rlike("^PROB"), "PROB").when(g.rlike("^FM"), "FM").when(g.rlike("^BECMG"), "BECMG").when(g.rlike("^TEMPO"), "TEMPO").otherwise("INITIAL")
        )
        padded = F.concat(F.lit(" "), g)
        miles = _group(padded, r" P?(\d{1,2})SM\b", 1).try_cast("double")
        metres = _group(padded, r" (\d{4})(?= |$)", 1).try_cast("double")
        return F.struct(
            kind.alias("change_type"), _group(g, r"^PROB([34]0)", 1).try_cast("int").alias("probability"),
            F.coalesce(_group(g, r"^FM(\d{4})", 1), _group(padded, r" (\d{4})/\d{4}", 1)).alias("start"),
            _group(padded, WIND, 1).try_cast("int").alias("wind_dir"), _group(padded, WIND, 2).try_cast("int").alias("wind_speed"), _group(padded, WIND, 3).try_cast("int").alias("wind_gust"),
            F.coalesce(metres, F.bround(miles * MILE_TO_M)).cast("int").alias("visibility_m"), (padded.rlike(r" P\d{1,2}SM\b") | F.coalesce(metres >= 9999, F.lit(False))).alias("visibility_plus"),
            F.transform(F.regexp_extract_all(padded, F.lit(CLOUD), 1), lambda c: F.struct(F.regexp_extract(c, "^([A-Z]+)", 1).alias("cover"), (F.regexp_extract(c, r"(\d{3})", 1).cast("int") * 100).alias("base_ft"))).alias("clouds"),
            padded.rlike(r"\bCAVOK\b").alias("cavok"),
        )

    return F.transform(F.filter(groups, lambda g: ~g.rlike(r"^INITIAL\s*(NIL|CNL)?$")), period)


def aligned_period_votes(df: DataFrame, key: str, voices: Mapping[str, str], fields: list[str]) -> DataFrame:
    """key, pos, field, voice, value over the positions that all voices have; and structural dissent is by taf_structure."""
    common = F.least(*[F.size(c) for c in voices.values()]) if len(voices) > 1 else F.size(next(iter(voices.values())))
    spread = df.withColumn("pos", F.explode(F.sequence(F.lit(0), common - 1))).filter("pos >= 0") if len(voices) else df
    made = [F.struct(F.lit(v).alias("voice"), F.lit(f).alias("field"), F.get(F.col(c), F.col("pos"))[f].cast("string").alias("value")) for v, c in voices.items() for f in fields]
    return spread.select(key, "pos", F.explode(F.array(*made)).alias("x")).select(key, "pos", "x.*")


def structural_dissent(counts: Column, change_types: Column) -> Column:
    """Voices differ in how many periods they see, or in the change types by position."""
    return (F.size(F.array_distinct(counts)) > 1) | (F.size(F.array_distinct(change_types)) > 1)


def taf_label(voices: Column, dissent: Column, tie: Column) -> Column:
    return F.when(voices < 2, "parse_fail").when(dissent | tie, "dissent").otherwise("clean")
