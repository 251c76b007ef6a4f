"""Secret scans: the battery and its limits against plain versions, planted strings, texts with many matches."""

import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from quern.llm.secrets import ENCODINGS, P_BINS, _scored, limits, secret_digest, secret_spans

B62 = string.ascii_letters + string.digits
PLAIN = "get user account name order item price count load save file path config server client request response handler service data".split()


def drawn(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def plain_p(token):
    e = next((k for k, x in enumerate(ENCODINGS) if re.match(x[2], token)), None)
    if e is None:
        return None
    alphabet = ENCODINGS[e][1]
    v, k, n = [alphabet.index(c) for c in token], len(alphabet), len(token)
    upper = lambda z: math.erfc(z / math.sqrt(2)) / 2
    statistic = sum((v.count(i) - n / k) ** 2 / (n / k) for i in range(k))
    chi = k - 1 + (statistic - (k - 1)) / math.sqrt((n - 1) / n)
    p1 = upper(((max(chi, 1e-9) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    high = [x >= k / 2 for x in v]
    n1, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * n1 * (n - n1) / n + 1
    p2 = 1e-12 if n1 in (0, n) else 2 * upper(abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    m = sum(v) / n
    r = sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / max(sum((a - m) ** 2 for a in v), 1e-9)
    p3 = 2 * upper(abs(r + 1 / n) * n * math.sqrt(n - 1) / (n - 2))
    half = -sum(math.log(min(max(p, 1e-12), 1)) for p in (p1, p2, p3))
    return e, n, math.exp(-half) * (1 + half + half * half / 2)


def test_battery_is_its_definition(spark):
    rng = random.Random(2)
    tokens = [drawn(rng, x[1], rng.randint(20, 90)) for x in ENCODINGS for _ in range(12)] + ["a1" * 15, "Ab1" + "x" * 40, "onlyletters" * 3, "getUserAccountById2Name"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", _scored(F.col("t")).alias("x")).collect()
    for r in rows:
        want = plain_p(r["t"])
        if want is None:
            assert r["x"] is None
        else:
            assert (r["x"]["encoding"], r["x"]["n"]) == want[:2] and r["x"]["p"] == pytest.approx(want[2], rel=1e-3, abs=1e-7)


@pytest.mark.parametrize("seed", range(3))
def test_limits_are_their_definition(spark, seed):
    rng = random.Random(seed)
    ps = [rng.random() for _ in range(rng.choice([0, 1, 40]))] + [rng.random() ** 6 for _ in range(rng.choice([1, 9, 30]))]
    found = spark.createDataFrame([([{"t": {"encoding": 5, "n": 40, "p": p}}],) for p in ps], "scored array<struct<t:struct<encoding:int,n:int,p:double>>>")
    bins = sorted(min(P_BINS, math.floor(-10 * math.log10(p))) for p in ps)
    m, edge = len(ps), lambda k: 10 ** (-k / 10)
    sure = sum(b < 3 for b in bins) + 1
    total = min(m, (sure + math.sqrt(sure)) / (1 - edge(3)))
    few, kept = [], []
    for b in set(bins):
        reported, after = sum(x <= b for x in bins), [x for x in bins if x > b]
        if reported - total * (1 - (edge(min(after)) if after else 0)) <= 0.05 * reported:
            few.append(b)
        if edge(b) <= 0.05 * sum(x >= b for x in bins) / m:
            kept.append(b - 1)
    want = [min([max(few), *kept])] if few else []
    assert [r["bin"] for r in limits(found, 0.05).collect()] == want


def test_planted_strings(spark):
    rng = random.Random(3)
    keys = [drawn(rng, rng.choice([B62, B62 + "+/", string.ascii_lowercase + string.digits]), rng.choice([24, 32, 48, 64])) for _ in range(400)]
    keys += ["host/api-v2/" + drawn(rng, B62, 40) for _ in range(50)] + ["-".join(drawn(rng, "0123456789abcdef", m) for m in (8, 4, 4, 4, 12)) for _ in range(50)]
    names = ["".join(rng.choice(PLAIN).title() for _ in range(rng.randint(4, 8))) + str(rng.randint(1, 99)) for _ in range(250)]
    names += [rng.choice("-_/").join(rng.choice(PLAIN) for _ in range(6)) + "/V2" for _ in range(250)]
    docs = spark.createDataFrame([(k, f"see {t} there") for k, t in enumerate(keys + names)], "doc_id long, text string")
    found = {r["doc_id"] for r in secret_spans(docs).filter(F.exists("spans", lambda s: s["kind"] == "random")).collect()}
    right = sum(k < len(keys) for k in found)
    assert right >= 0.9 * len(keys) and right >= 0.9 * len(found)


def test_many_matches_and_lone_keys(spark):
    text = "é " + " ".join(f"k{j} {'0a' * 12}{'b' * (j % 5)}" for j in range(3000))
    lone = "path/to-x/q9Xk2LmQ7RtVw3Zb8NcD4FgHq1"
    got = {r["doc_id"]: r for r in secret_digest(spark.createDataFrame([(1, text), (2, lone), (3, None)], "doc_id long, text string")).collect()}
    spans = ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{24,}", text))
    assert got[1]["n_hex"] == 3000 and got[1]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and got[1]["spans"] == spans
    assert got[2]["spans"] == f"random:10:{len(lone)}" and got[3]["spans"] == ""
