"""Secret scans with native functions only: pattern spans, and random strings by a battery of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise

#: The patterns of the base kinds, in order of precedence at equal starts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A candidate for the battery: a run of symbols of base-64 texts, as long as the shortest length tested.
SHORTEST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}" % SHORTEST
#: What is tested in its place where no encoding fits the whole run: its parts between separators.
PART = r"[A-Za-z0-9]{%d,}" % SHORTEST
#: Hexadecimal digits in groups, as in UUIDs: tested without the hyphens.
GROUPED = r"^[0-9a-f]+(-[0-9a-f]+)+$"

#: Alphabets of the encodings, in the order in which they are inferred; name, alphabet, what must and must not occur.
ENCODINGS = [
    ("hex", "0123456789abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    ("HEX", "0123456789ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/]+$"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z_-]+$"),
]
#: Bins of p are tenths of a decade; the first RANDOM_BINS (p over 0.501) tell how many candidates are random.
P_BINS, RANDOM_BINS = 400, 3


def _blocks(array: Column) -> Column:
    """The array in about sqrt(n) blocks of about sqrt(n) entries; an empty array is one empty block."""
    width = F.ceil(F.sqrt(F.greatest(F.size(array), F.lit(1)))).cast("int")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), width), lambda at: F.slice(array, at, width))


def _bounded(spans: Column) -> Column:
    """Blocks of spans in order of their starts, each with its least start and largest end, for _meets."""
    bounds = lambda b: F.struct(b.alias("spans"), F.get(b, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(b, lambda s: s["end"])).alias("hi"))
    return F.transform(_let(spans, _blocks), bounds)


def _meets(bounded: Column, start: Column, end: Column) -> Column:
    """Whether one of the spans overlaps [start, end): n ** 0.5 steps where few blocks reach it."""
    inner = lambda s: (s["start"] < end) & (start < s["end"])
    return F.exists(bounded, lambda b: F.coalesce((b["lo"] < end) & (start < b["hi"]), F.lit(False)) & F.exists(b["spans"], inner))


def _starts(pieces: Column, matches: Column) -> Column:
    """Code-point start of every match, from the texts between matches; one more entry than matches.

    Running sums append to arrays, so n matches are dealt to about sqrt(n) blocks: n ** 1.5 steps, not n ** 2.
    """

    def running(steps: Column, first: Column) -> Column:
        return F.aggregate(
            steps,
            F.struct(first.alias("pos"), F.array().cast("array<int>").alias("out")),
            lambda a, s: F.struct((a["pos"] + s["p"] + s["m"]).alias("pos"), F.concat(a["out"], F.array(a["pos"] + s["p"])).alias("out")),
            lambda a: a["out"],
        )

    def total(steps: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s["p"] + s["m"])

    def joined_blocks(parts: Column) -> Column:
        # A block's base is the total of those before: the running starts of steps as long as the blocks.
        sums = F.transform(parts, lambda s: F.struct(F.lit(0).alias("p"), total(s).alias("m")))
        return F.flatten(F.zip_with(parts, running(sums, F.lit(0)), running))

    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    return _let(_let(steps, _blocks), joined_blocks)


def _find(df: DataFrame, name: str, pattern: str, guard: Column | None = None) -> DataFrame:
    """Adds name_m (matches) and name_s (starts), null where the text has no match or guard does not hold."""
    text, pat = F.col("__text"), F.lit(pattern)
    return (
        df.withColumn(f"{name}_m", F.when(text.rlike(pattern) if guard is None else guard, F.regexp_extract_all(text, pat, 0)))
        .withColumn(f"{name}_p", F.when(F.size(f"{name}_m") > 0, F.split(text, pattern, -1)))
        .withColumn(f"{name}_s", F.when(F.size(f"{name}_m") > 0, _starts(F.col(f"{name}_p"), F.col(f"{name}_m"))))
        .drop(f"{name}_p")
    )


def _spans(name: str, kind: str, order: int) -> Column:
    made = F.zip_with(
        f"{name}_s", f"{name}_m", lambda s, m: F.struct(s.alias("start"), F.lit(order).alias("order"), (s + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("m"))
    )
    return F.coalesce(made, F.array().cast("array<struct<start:int,order:int,end:int,kind:string,m:string>>"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: a transform over a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _normal_sf(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17), for z of either sign."""

    def tail(x, t):
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) / 2.5066282746310002 * poly

    def signed(x):
        return _let(_let(1 / (1 + 0.2316419 * F.abs(x)), lambda t: tail(F.abs(x), t)), lambda p: F.when(x >= 0, p).otherwise(1 - p))

    return _let(z, signed)


def _encoding(token: Column) -> Column:
    out = F.lit(None).cast("int")
    for k in reversed(range(len(ENCODINGS))):
        out = F.when(token.rlike(ENCODINGS[k][2]), F.lit(k)).otherwise(out)
    return out


def _scored(token: Column) -> Column:
    """struct(encoding, n, p) of one candidate; null where no encoding is inferred.

    p is the combined p-value under the hypothesis that the symbols are drawn alike and independently: chi-squared
    uniformity over the alphabet (Wilson-Hilferty), runs above and below the alphabet's middle, and lag-1 serial
    correlation of the symbols' ranks, joined by Fisher's method (chi-squared on 6 degrees). Every step is linear
    in the token's length.
    """
    let = _let
    alphabets = F.array(*[F.lit(a) for _, a, _ in ENCODINGS])

    def with_encoding(e):
        def with_alphabet(alphabet):
            def with_values(v):
                k, n = F.length(alphabet).cast("double"), F.size(v).cast("double")
                squares = F.aggregate(
                    F.sequence(F.lit(1), F.length(alphabet)),
                    F.lit(0.0),
                    lambda a, i: a + F.pow(F.length(token) - F.length(F.replace(token, F.substr(alphabet, i, F.lit(1)))), F.lit(2.0)),
                )
                moments = F.aggregate(
                    v,
                    F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("high"), F.lit(1.0).alias("runs")),
                    lambda a, x: F.struct(
                        x.alias("last"),
                        (a["s"] + x).alias("s"),
                        (a["ss"] + x * x).alias("ss"),
                        (a["sx"] + F.when(a["last"] >= 0, a["last"] * x).otherwise(0.0)).alias("sx"),
                        (a["high"] + F.when(x >= k / 2, 1.0).otherwise(0.0)).alias("high"),
                        (a["runs"] + F.when((a["last"] >= 0) & ((a["last"] >= k / 2) != (x >= k / 2)), 1.0).otherwise(0.0)).alias("runs"),
                    ),
                )

                def with_moments(both):
                    m, sq = both["m"], both["sq"]
                    df = k - 1
                    # The variance of the statistic over n draws is that of chi-squared times (n - 1) / n.
                    chi = F.greatest(df + (sq * k / n - n - df) / F.sqrt((n - 1) / n), F.lit(1e-9))
                    z1 = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
                    p1 = _normal_sf(z1)
                    n1, n0 = m["high"], n - m["high"]

                    def by_runs(mean_runs):
                        var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9))
                        return 2 * _normal_sf(F.abs(m["runs"] - mean_runs) / F.sqrt(var_runs))

                    p2 = F.when((n1 == 0) | (n0 == 0), F.lit(1e-12)).otherwise(let(2 * n1 * n0 / n + 1, by_runs))

                    def by_correlation(mean):
                        var = F.greatest(m["ss"] - n * mean * mean, F.lit(1e-9))
                        cross = m["sx"] - mean * (2 * m["s"] - F.element_at(v, 1) - m["last"]) + (n - 1) * mean * mean
                        # Under random order the correlation has mean -1 / n and about this deviation.
                        return 2 * _normal_sf(F.abs(cross / var + 1 / n) * n * F.sqrt(n - 1) / (n - 2))

                    p3 = let(m["s"] / n, by_correlation)
                    floor = lambda p: F.ln(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0)))
                    p = let(-(floor(p1) + floor(p2) + floor(p3)), lambda half: F.exp(-half) * (1 + half + half * half / 2))
                    return F.struct(e.alias("encoding"), n.cast("int").alias("n"), F.greatest(p, F.lit(1e-30)).alias("p"))

                return let(F.struct(moments.alias("m"), squares.alias("sq")), with_moments)

            return let(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double")), with_values)

        return let(F.element_at(alphabets, e + 1), with_alphabet)

    return let(_encoding(token), lambda e: F.when(e.isNotNull(), with_encoding(e)))


def _stratum(c: Column) -> Column:
    """Length-aware stratum: encoding and the binary logarithm of the length."""
    return c["encoding"] * 64 + F.floor(F.log2(c["n"].cast("double"))).cast("int")


def _bin(c: Column) -> Column:
    return F.least(F.lit(P_BINS), F.floor(-10 * F.log10(c["p"])).cast("int"))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base spans and scored candidates of every whole text; one pass, no shuffle."""
    df = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    df = _find(df, "a", ASSIGN)
    df = df.withColumn("a_v", F.when(F.size("a_m") > 0, F.regexp_extract_all("__text", F.lit(ASSIGN), 1)))
    df = _find(df, "k", ACCESS)
    df = _find(df, "h", HEX)
    df = _find(df, "c", CANDIDATE)
    valid = F.filter(
        F.zip_with(_spans("a", "assign", 0), F.coalesce("a_v", F.array().cast("array<string>")), lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: F.length(x["v"]) >= 6
    )
    base = F.array_sort(F.concat(F.transform(valid, lambda x: x["s"]), _spans("k", "access", 1), _spans("h", "hex", 2)))
    tested = lambda m: F.when(m.rlike(GROUPED), F.replace(m, F.lit("-"), F.lit(""))).otherwise(m)
    score = lambda s: F.struct(s.alias("s"), _let(tested(s["m"]), lambda m: F.when(F.length(m) >= SHORTEST, _scored(m))).alias("t"))
    df = df.select("doc_id", "__text", base.alias("base"), F.transform(_spans("c", "random", 3), score).alias("runs"))
    # Runs that no encoding fits are tested by their parts.
    df = _find(df, "d", PART, F.exists("runs", lambda x: x["t"].isNull() & x["s"]["m"].rlike("[-_+/]")))
    # Parts and runs are disjoint or one holds the other, so a part that meets a tested run is within it.
    whole = _bounded(F.transform(F.filter("runs", lambda x: x["t"].isNotNull()), lambda x: x["s"]))
    df = df.withColumn("whole", F.when(F.size("d_m") > 0, whole))
    parts = F.transform(F.filter(_spans("d", "random", 3), lambda s: ~_meets(F.col("whole"), s["start"], s["end"])), score)
    scored = F.filter(F.when(F.size("d_m") > 0, F.concat("runs", parts)).otherwise(F.col("runs")), lambda x: x["t"].isNotNull())
    return df.select("doc_id", "base", scored.alias("scored"))


def limits(found: DataFrame, alpha: float) -> DataFrame:
    """One row per stratum: the last bin of p that is reported; from counts by bin of p, at most encodings x 64 rows
    whatever the input.

    Two controls at alpha, the stricter one holds. Benjamini-Hochberg drops what is not random: of those dropped, a share
    alpha at most is random. And of those reported, an estimated share alpha at most is not random: a random string's p
    is uniform and that of others is small, so the candidates with p in the first RANDOM_BINS (p > t) are random, and
    there are R = (their number) / (1 - t) random ones in all, but not more than candidates (Storey's estimate; their number is
    taken one and a standard deviation higher, so that chance does not empty a stratum of few); of those down to a limit t, R * (1 - t) are random and the rest false. Strings that are not random but as even
    as random ones are beyond what the tests, and so this estimate, can see.
    """
    from pyspark.sql import Window as W

    bins = (
        found.select(F.explode("scored").alias("x")).select(_stratum(F.col("x.t")).alias("stratum"), _bin(F.col("x.t")).alias("bin")).groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    )
    up, down, whole = W.partitionBy("stratum").orderBy("bin"), W.partitionBy("stratum").orderBy(F.desc("bin")), W.partitionBy("stratum")
    # Bin k holds p in (10 ** (-(k + 1) / 10), 10 ** (-k / 10)]; no candidate has a p between a bin and the next that occurs.
    edge = lambda k: F.pow(F.lit(10.0), -k / 10.0)
    random = F.least(F.col("m"), (F.col("sure") + 1 + F.sqrt(F.col("sure") + 1)) / (1 - edge(F.lit(RANDOM_BINS))))
    false = F.col("reported") - random * (1 - F.coalesce(edge(F.col("next")), F.lit(0.0)))
    dropped = edge(F.col("bin")) <= alpha * F.col("rank") / F.col("m")
    return (
        bins.withColumn("reported", F.sum("n").over(up))
        .withColumn("rank", F.sum("n").over(down))
        .withColumn("next", F.lead("bin").over(up))
        .withColumn("m", F.sum("n").over(whole))
        .withColumn("sure", F.sum(F.when(F.col("bin") < RANDOM_BINS, F.col("n")).otherwise(0)).over(whole))
        .groupBy("stratum")
        .agg(F.max(F.when(false <= alpha * F.col("reported"), F.col("bin"))).alias("few"), F.min(F.when(dropped, F.col("bin") - 1)).alias("kept"))
        .select("stratum", F.when(F.col("few").isNotNull(), F.least("few", "kept")).alias("bin"))
        .filter("bin is not null")
    )


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 0.05) -> DataFrame:
    """Base spans and spans of random strings of every whole text.

    Base kinds match leftmost and without overlap; assignments with a value under 6 characters are dropped.
    A candidate run, or a part of one that no encoding fits as a whole, is added as kind random if its battery's p is
    among those reported in its encoding and length band, of which an estimated share alpha at most is false, and no base
    span overlaps it; base spans always stay. Null and empty texts have no spans; an empty table gives an empty result.
    Positions are code points, end exclusive. Texts of any length are scanned whole. Rows are independent but for the
    limits, so repeated rows give repeated results; other columns are ignored.
    """
    # Base spans and scores are narrow, and read twice: texts are scanned once.
    found = materialise(scanned(docs, key, text), "op7-found")
    limit = limits(found, alpha)
    # One row: a map of at most encodings x 64 entries, so its size is bounded.
    packed = limit.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "bin"))).alias("__limit"))

    def kept(x):
        reported = F.coalesce(_bin(x["t"]) <= F.element_at(F.col("__limit"), _stratum(x["t"])), F.lit(False))
        return reported & ~_meets(F.col("__base"), x["s"]["start"], x["s"]["end"])

    added = F.transform(F.filter("scored", kept), lambda x: x["s"])
    return (
        found.crossJoin(F.broadcast(packed))
        .withColumn("__base", F.when(F.size("scored") > 0, _bounded(F.col("base"))))
        .withColumn("__spans", F.when(F.size("scored") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")))
        .select("doc_id", "base", F.col("__spans").alias("spans"))
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, **parameters) -> DataFrame:
    """Counts by base kind, the digest of base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return secret_spans(docs, **parameters).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
