"""Substring and suffix dedup against brute force, over edge cases."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from quern.llm.common import WORD, sliding_argmin
from quern.llm.repeats import ByteUnits, Sketch, WordUnits
from quern.llm.substring_dedup import substring_dedup
from quern.llm.suffix_dedup import common_prefix, intervals, maximal_repeat_groups, maximal_repeats, suffix_dedup

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def words_kept(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        w = re.findall(WORD, texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def bytes_kept(texts, length=200):
    raw = {i: t.encode() for i, t in texts.items()}
    count = Counter(t[p : p + length] for t in raw.values() for p in range(len(t) - length + 1))
    out = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, gone) if not y)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bits", [27, 12])
def test_substring_dedup(edge, texts, bits):
    """With a saturated sketch (12 bits) every window is grouped, and the result is the same."""
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(edge, sketch_bits=bits).collect()}
    assert got == words_kept(texts)


def test_substring_dedup_gives_the_kept_text(edge):
    for r in substring_dedup(edge).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def suffix_rows(df, **parameters):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(df, **parameters).collect()}


@pytest.mark.parametrize("largest", [256, 1])
def test_suffix_dedup(edge, texts, largest):
    """With arrays of one leaf at most every array of several leaves is cut, down to single strings where need be."""
    assert suffix_rows(edge, largest=largest) == bytes_kept(texts)


def test_arrays_of_many_leaves(spark):
    """A passage that 90 texts share, whole or cut anywhere: its edges give anchors with many different leaves."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(500))
    texts = {}
    for k in range(90):
        a, b = rng.choice([(0, 500), (0, 500), (rng.randint(0, 200), rng.randint(300, 500))])
        texts[k] = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 260))) + passage[a:b] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 260)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = bytes_kept(texts)
    assert suffix_rows(df, largest=8) == suffix_rows(df) == want


def test_groups_hold_all_occurrences(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef") for _ in range(300))
    texts = {k: "".join(rng.choice("uvwxyz") for _ in range(50 + k)) + passage for k in range(5)}
    groups = {}
    for r in maximal_repeat_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        groups.setdefault((r["array"], r["group"], r["length"]), set()).add((r["doc_id"], texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]))
    assert groups and all(len({x for _, x in members}) == 1 and len(members) > 1 for members in groups.values())
    assert max(len(m) for m in groups.values()) == 5
    covered = {d: set() for d in texts}
    for r in maximal_repeat_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        covered[r["doc_id"]] |= set(range(r["start"], r["start"] + r["length"]))
    assert all(len(covered[d]) >= 300 for d in texts)


def test_rows_that_share_an_id_keep_their_texts(spark):
    p, q, other = [" ".join(f"{x}{k}" for k in range(n)) for x, n in (("p", 40), ("q", 60), ("r", 100))]
    rows = [(1, p), (2, p + " " + q), (2, other), (3, "same " * 3 + other), (4, q), (4, "z " + q), (5, p + " one"), (5, p + " two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup(df).collect())
    # q starts at word 40 of the first row 2, at 0 and 1 of the rows 4.
    assert got == [(1, 40, 0), (2, 100, 0), (2, 100, 40), (3, 103, 100), (4, 60, 60), (4, 61, 60), (5, 41, 40), (5, 41, 40)]
    twice = spark.createDataFrame([(7, p + " one"), (7, p + " two")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup(twice).collect()] == [0, 0]
    a, b = "".join(chr(97 + k * k % 23) + str(k) for k in range(200)), "".join(chr(98 + k * 7 % 19) + str(k * 3) for k in range(300))
    df = spark.createDataFrame([(1, a), (2, a + "tail"), (2, b), (2, b[:150])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup(df).collect()) == sorted(
        [(1, len(a), len(a)), (2, len(a) + 4, len(a)), (2, len(b), 0), (2, 150, 0)]
    )


def test_texts_longer_than_a_slice(spark):
    """Whole passages of a text of over two slices stand elsewhere, at other places in their text."""
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(map(str, rng.integers(10**6, 10**7, n)))
    long = word(330_000)
    rows = [(1, long), (2, word(77) + " " + long[8 * 1000 : 8 * 200_000] + word(50)), (3, "x" * (3 << 20)), (4, "y" + long[8 * 131_000 : 8 * 131_060])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(df, texts=False).collect()}
    # The first word of row 4 differs, and the last word of the passage in row 2 goes on.
    assert got == {1: (330_000, 0), 2: (77 + 199_000 + 50, 199_000), 3: (1, 0), 4: (60, 59)}
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup(df, texts=False).collect()}
    assert got[3] == (3 << 20, 1) and got[4] == (60 * 8, 1)
    assert abs(got[2][0] - 199_000 * 8) <= 2 and got[2][1] == 1


def test_memory_of_a_text_of_20_mb():
    """One row of 20 MB, with a word of 6 MB in it: segments of words and bytes stay under 500 MB above the start."""
    code = """
import resource, numpy as np, pyarrow as pa
from quern.llm.repeats import ByteUnits, WordUnits, segments, unit_slices
rng = np.random.default_rng(1)
text = " ".join(map(str, rng.integers(10**5, 10**7, 1_750_000))) + " " + "w" * (6 << 20)
batch = pa.record_batch({"text": pa.array([text])})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for units in (WordUnits, ByteUnits):
    for _, _, u, _ in unit_slices(batch, units):
        segments(u)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout)
    assert used < 500


@pytest.mark.parametrize("units", [WordUnits, ByteUnits])
def test_parts_hold_every_window_once(units):
    rng = np.random.default_rng(9)
    text = (" ".join(map(str, rng.integers(1, 10**6, 400_000))) + " " + "v" * (2 << 20) + " tail words").encode()
    data = np.frombuffer(text, np.uint8)
    whole, found = units(data, np.array([0, len(data)])), []
    for u, base in units.parts(data):
        n = int(u.offsets[-1]) - u.length + 1
        assert base == len(found)
        found += u.spans(np.arange(n), np.arange(n) + u.length).tolist()
    n = int(whole.offsets[-1]) - whole.length + 1
    assert found == whole.spans(np.arange(n), np.arange(n) + whole.length).tolist()


def test_odd_tables(spark, clashing, empty, repeated, texts):
    assert substring_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup(clashing).collect()} == {i: v[1] for i, v in words_kept(texts).items()}
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup(clashing).collect()} == {i: v[1] for i, v in bytes_kept(texts).items()}
    # Rows that repeat in all are one place to the word operator and two to the byte operator.
    assert substring_dedup(repeated).count() == 2 * len(texts) == suffix_dedup(repeated).count()
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup(repeated).collect()} == {i: v[1] for i, v in words_kept(texts).items()}
    assert all(r["n_removed"] == r["n_bytes"] for r in suffix_dedup(repeated).collect() if r["n_bytes"] >= 200)
    nameless = spark.createDataFrame([(None, "a b c " * 30), (None, None)], "doc_id long, text string")
    assert substring_dedup(nameless).count() == suffix_dedup(nameless).count() == 2


def test_sliding_argmin():
    rng = np.random.default_rng(0)
    values = (rng.integers(0, 6, 700) << 40).astype(np.uint64)
    for width in (1, 2, 7, 64, 700):
        want = [max(range(k, k + width), key=lambda i: (-int(values[i]), i)) for k in range(len(values) - width + 1)]
        assert sliding_argmin(values, width).tolist() == want


def test_sketch_never_loses_a_repeat():
    values = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    rows = []
    for row in range(2):
        bits = np.bincount(Sketch.cells(np.concatenate([values, values[:700]]), row, 12), minlength=1 << 12) > 1
        rows.append(np.packbits(bits))
    assert Sketch(12, rows).repeated(values[:700]).all()


def test_common_prefix_and_intervals():
    assert common_prefix(b"abc", b"abd") == 2 and common_prefix(b"", b"x") == 0 and common_prefix(b"ab", b"ab") == 2 and common_prefix(b"\0\0a", b"\0\0b") == 2
    assert sorted(intervals([1, 3, 3, 0, 2])) == sorted([(3, 1, 3), (1, 0, 3), (0, 0, 5), (2, 4, 5)])


def test_maximal_repeats_cover_what_pairs_share():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(2, 7)
        lefts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(n)]
        rights = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(n)]
        least, want, got = 5, set(), set()
        for i in range(n):
            for j in range(n):
                a, b = common_prefix(lefts[i], lefts[j]), common_prefix(rights[i], rights[j])
                if i != j and b and a + b >= least:
                    want |= {(i, p) for p in range(-a, b - least + 1)}
        for left, right, members in maximal_repeats(lefts, rights, least=least):
            assert len(members) > 1
            got |= {(k, p) for k in members for p in range(-left, right - least + 1)}
        assert got == want
