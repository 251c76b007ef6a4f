"""Near copies at 0.8 of five-word shingles that four bits of SimHash miss."""

import random
import re

from quern.llm.near_copies import near_copies
from quern.llm.simhash import near_duplicates


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(texts, parts):
    """Components by every pair, on top of those of four bits."""
    root, sets = dict(parts), {i: shingles(t) for i, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root


def changed(rng, words, at):
    return " ".join(f"new{rng.randrange(10**6)}" if k in at else w for k, w in enumerate(words))


def test_near_copies_by_brute_force(spark, edge, texts):
    rng = random.Random(8)
    rows = [(i, t) for i, t in texts.items()]
    for g in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(50, 160))]
        rows += [(1000 + 10 * g + k, changed(rng, words, set(rng.sample(range(len(words)), k * len(words) // 50)))) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bits = {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    want = brute(dict(rows), bits)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(df).collect()}
    assert got == want and len(set(got.values())) < len(set(bits.values()))


def test_stage_drops_what_four_bits_miss(spark):
    import corpus_pipeline as P

    rng = random.Random(3)
    rows = []
    for g in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, changed(rng, words, {49, 50}))]
    df = spark.createDataFrame([(*r, "en", "a") for r in rows], "doc_id long, text string, lang string, source string")
    assert near_duplicates(df).filter("doc_id = component_id").count() > 20
    assert sorted(r["doc_id"] for r in P.near_dedup(spark, df, "").collect()) == list(range(0, 40, 2))
