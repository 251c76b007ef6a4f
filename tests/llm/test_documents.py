"""Quality rules, secrets, mixing, decontamination and token output, over edge cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import queries as Q
from quern.llm.decontaminate import contaminated
from quern.llm.mixing import Mix, mix_sources, slot_sources, target_sizes
from quern.llm.quality_rules import cleaned_texts, document_metrics, frequent_lines, quality_rules
from quern.llm.secrets import secret_digest
from quern.llm.token_output import END, TOKENIZER, Feistel, Tokenizer, read_sequences, write_training_order

WORD = "[^\x20\x09-\x0d]+"


def metrics(t):
    w = re.findall(WORD, t)
    tri, hit = [tuple(w[k : k + 3]) for k in range(len(w) - 2)], set()
    for k, x in enumerate(tri):
        if tri.count(x) > 1 if len(tri) < 2000 else x in metrics.often:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_document_metrics(edge, texts):
    from collections import Counter

    got = {r["doc_id"]: tuple(r)[1:] for r in document_metrics(edge).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    for i, t in texts.items():
        w = re.findall(WORD, t)
        metrics.often = {x for x, n in Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)).items() if n > 1}
        assert got[i] == metrics(t), i


def test_frequent_lines_go(spark):
    rows = [(k, f"unique body number {'abcdefghij'[k % 10]} {'klmnopqrst'[k // 10]} with many words " * 9 + f"\nBuy now 00{k}!\nlast words {'abcdefghij'[k % 10]}{'klm'[k // 10]}", "h1") for k in range(30)]
    rows += [(100 + k, "Buy  NOW 7!\nbuy now 8!", "h1") for k in range(3)] + [(200, "Buy now 1!" + " own words" * 40, "h2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    freq = frequent_lines(docs, min_docs=20, min_share=0.0)
    assert freq.count() == 1 and freq.first()["host"] == "h1" and freq.first()["n_docs"] == 33
    out = {r["doc_id"]: r for r in quality_rules(docs, min_words=3, max_repeat_share=1.0).collect()}
    assert not out[100]["kept"] and out[0]["kept"] and out[200]["kept"] and out[0]["n_removed_words"] == 3
    clean = {r["doc_id"]: r["text"] for r in cleaned_texts(docs, freq).collect()}
    assert "Buy" not in clean[0] and clean[100] == "" and clean[200] == rows[-1][1]


def test_quality_rules_odd_tables(edge, clashing, empty, repeated):
    one = {r["doc_id"]: r["kept"] for r in quality_rules(edge).collect()}
    assert one == {r["doc_id"]: r["kept"] for r in quality_rules(clashing).collect()}
    assert quality_rules(empty).count() == 0 and quality_rules(repeated).count() == 2 * len(one)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SECRETS = [
    (1, None), (2, ""), (3, 'é😀 secret: abcdef token="ab" API_KEY=x.y=zzzzzz token:token:abcdef AKIA' + "A" * 16 + " x"), (4, "AKIA1234 " + "0a" * 12 + " " + "0a" * 11), (5, "passwd : 'hunter2hunter2' PASSWORD=abcdef" * 3),
    (6, "key a9Xk2LmQ7RtVw3Zb8NcD4FgHq1 here"), (7, "plain words only thandinghetherandtheofthatforwith"), (8, "x" * 3000 + " secret=" + "Q" * 50),
]


def base_spans(t):
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))


def test_secret_spans(spark, edge, texts, clashing, empty, repeated):
    docs = spark.createDataFrame(SECRETS, "doc_id long, text string")
    for r in secret_digest(docs).collect():
        t = dict(SECRETS)[r["doc_id"]] or ""
        assert r["base_sha256"] == hashlib.sha256(base_spans(t).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(base_spans(t).count(k + ":") for k in ("assign", "access", "hex"))
        assert ("random:" in r["spans"]) == (r["doc_id"] == 6)
    assert secret_digest(empty).count() == 0 and secret_digest(repeated).count() == 2 * len(texts)
    assert {r["doc_id"]: r["spans"] for r in secret_digest(clashing).collect()} == {r["doc_id"]: r["spans"] for r in secret_digest(edge).collect()}


def test_targets_share_and_stop():
    t = target_sizes([100, 1000, 10, 0], [5, 2, 1, 5], 3)
    assert t[0] == 300 and t[3] == 0 and t[2] == 30 and t[1] == pytest.approx(780)
    assert target_sizes([1, 1], [1, 0], 3) == [2.0, 0.0]


def test_schedule_discrepancy():
    bounds = np.cumsum([0.5, 0.3, 0.2])
    s = slot_sources(np.arange(5000), bounds)
    run = np.cumsum(s[:, None] == np.arange(3), axis=0) - np.arange(1, 5001)[:, None] * np.diff(bounds, prepend=0)
    assert np.abs(run).max() < 4


def test_mixing(edge, texts, clashing, empty, repeated):
    rows = mix_sources(edge).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(re.findall(WORD, t)) for i, t in texts.items()}
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= max(3, 0.02 * target)
    key = lambda x: sorted(tuple(r) for r in x.collect())
    assert key(mix_sources(edge)) == key(mix_sources(edge.repartition(5))) == key(mix_sources(clashing))
    assert mix_sources(empty).count() == 0 and mix_sources(repeated).count() == 2 * len(texts)
    m = Mix(edge)
    assert m.schedule.groupBy("source_no", "block", "epoch").count().filter("count > 1").count() == 0


def test_contaminated_templates(spark):
    items = [(1, "A train from Paris carries 120 passengers and travels 300 km in 4 hours, how fast does it go?"), (2, "one two three four five six"), (3, None), (4, "too short")]
    docs = [
        (1, "xx yy. A train from Berlin carries 80 passengers and travels 200 miles in 5 hours, how fast does it go? zz"), (2, "We saw a train. It went fast."), (3, None), (4, "so one two three four five six"),
        (5, ""), (6, "A TRAIN FROM PARIS CARRIES 120 PASSENGERS AND TRAVELS 300 KM IN 4 HOURS, HOW FAST DOES IT GO?"), (7, "A train from Paris carries 120 passengers and travels 120 km in 4 hours, how fast does it go?"),
    ]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in contaminated(d, b).collect()}
    assert got[(1, 1)] is False and got[(4, 2)] is True and (2, 1) not in got and not {i for i, _ in got} & {2, 3, 5}
    assert contaminated(d.limit(0), b).count() == 0 == contaminated(d, b.limit(0)).count()
    assert {tuple(r)[:2] for r in contaminated(d.unionByName(d), b).collect()} == set(got)


def test_inconsistent_slots_do_not_match(spark):
    b = spark.createDataFrame([(1, "add 5 apples to 5 pears and then count all of the fruit again")], "item_id long, text string")
    d = spark.createDataFrame([(1, "add 7 apples to 7 pears and then count all of the fruit again"), (2, "add 7 apples to 8 pears and then count all of the fruit again")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_windows"] for r in contaminated(d, b).collect()}
    assert got[1] == 7 and 2 not in got


def test_decontamination_against_plain_grams(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams, sizes, want = {}, {}, set()
    for b in bench.collect():
        w = tokens(b["text"])
        sizes[b["item_id"]] = len(w) - 7
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add((b["item_id"], k))
    for r in docs.collect():
        w, found = tokens(r["text"]), {}
        for k in range(len(w) - 7):
            for i, p in grams.get(tuple(w[k : k + 8]), ()):
                found.setdefault(i, set()).add(p)
        want |= {(r["doc_id"], i) for i, p in found.items() if len(p) >= 0.3 * sizes[i]}
    assert got == want and got


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(Feistel(n, 5).slots(np.arange(n)).tolist()) == list(range(n))
    assert Feistel(1000, 5).slots(np.arange(1000)).tolist() != Feistel(1000, 6).slots(np.arange(1000)).tolist()


def test_token_round_trip(spark, edge, texts, tmp_path):
    edge.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    layout, index = write_training_order(docs, length=64, shard_bytes=1 << 14)
    rows = sorted(index.collect())
    assert [r["slot"] for r in rows] == list(range(layout.sequences)) and len({r["shard"] for r in rows}) > 3
    slots = Feistel(layout.sequences, layout.key).slots(np.arange(layout.sequences))
    stored = list(read_sequences(layout, 0, layout.sequences))
    assert [x.tolist() for x in read_sequences(layout, 7, 2)] == [x.tolist() for x in stored[7:9]]
    ids = {d for r in rows for d in r["doc_ids"]}
    assert ids == {i for i, t in texts.items() if i != 1}
    stream, lengths = [], [rows[s]["n_tokens"] for s in slots]
    for s, n in zip(slots, lengths):
        stream += stored[s][:n].tolist()
    encoding = Tokenizer(open(TOKENIZER, "rb").read()).encoding()
    got, now = [], []
    for token in stream:
        if token == END:
            got.append(encoding.decode(now))
            now = []
        else:
            now.append(token)
    assert sorted(got) == sorted(t for i, t in texts.items() if i != 1) and not now


def test_token_ids_are_the_tokenizers(edge_rows):
    import pyarrow as pa

    from quern.llm.common import text_slices

    tokenizer = Tokenizer(open(TOKENIZER, "rb").read())
    odd = [r[1] or "" for r in edge_rows if len(r[1] or "") < 4000] + ["  a  b", "\n\n x\n", "tab\t z", "　全角 文字", "don't we'll 12 34,5", "\x85 q", "a  b"]
    for first, last, data, offsets in text_slices(pa.record_batch({"text": pa.array(odd)}), "text"):
        ids, edges = tokenizer.encode_rows(data, offsets)
        assert tokenizer.encode_rows(data, offsets, ids=False) == len(ids)
        for t, a, b in zip(odd[first:last], edges, edges[1:]):
            assert ids[a:b].tolist() == tokenizer.encoding().encode_ordinary(t)


def test_empty_token_output(empty):
    layout, index = write_training_order(empty)
    assert layout.sequences == 0 and index.count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    ours, theirs = Q.queries()[name](spark, d).toPandas(), c.execute(Q.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(tuple, ours[columns].values.tolist())) == sorted(map(tuple, theirs[columns].values.tolist()))


def test_held_out_rule(spark):
    import zlib

    from quern.llm.common import is_held_out

    for r in spark.range(200).select("id", is_held_out(F.col("id")).alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2)


def test_ids_of_long_runs_are_the_tokenizer_s_own():
    from quern.llm.token_output import SLICE, TOKENIZER, Tokenizer

    with open(TOKENIZER, "rb") as f:
        t = Tokenizer(f.read())
    rng = random.Random(1)
    draw = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    texts = [
        draw("abcdefghijklmnopqrstuvwxyz", 5000), "a" * 20_001, "ab" * 9000, draw("ABCxyz0189+/", 100_000), "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(6000)),
        draw("一二的。", 9000), "=" * 7000, draw(["the", "ation", "'s", "-"], 6000), "x" * 3000 + " \n\n  " + "y" * 3000 + "\x1c" + "z" * 3000 + " " * 5 + "é" * 3000, " " * 6000 + "q" * 6000 + " \n",
    ]
    for text in texts:
        assert t.encode(text).tolist() == t.encoding().encode(text, disallowed_special=()), text[:20]
    words = " ".join(draw("abcdefgh", 7) for _ in range(SLICE // 7))
    batch = pa.record_batch({"text": pa.array(["one two", words, "three"])})
    found = [ids.tolist() for _, _, ids, _ in t.encode_slices(batch)]
    assert found[1] == t.encoding().encode(words) and [n for _, _, n, _ in t.encode_slices(batch, ids=False)][1] == len(found[1])


def test_the_index_can_be_read_twice(spark, repeated, tmp_path):
    layout, index = write_training_order(repeated.withColumn("slot", F.lit(1)), length=64, path=f"file://{tmp_path}/s")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s").iterdir()}
    assert index.count() == layout.sequences == index.select("slot").distinct().count()
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s").iterdir()}
    nameless = spark.createDataFrame([(None, "a b"), (3, None), (4, "")], "doc_id long, text string").repartition(1)
    layout, index = write_training_order(nameless, length=8, path=f"file://{tmp_path}/n")
    assert [(r["n_tokens"], r["doc_ids"]) for r in index.collect()] in ([(4, [None, 4])], [(4, [4, None])])


def test_lines_are_counted_by_documents(spark):
    line = "this line stands in very many places of the corpus"
    own = "word " * 60
    rows = [(1, f"{line}\n{own}", "a")] * 30 + [(k, f"{line}\n{k} {own}", "b") for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r["host"], r["n_docs"]) for r in frequent_lines(df, min_share=0.0).collect()} == {("b", 30)}


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    often = [f"frequent line number one of {'abcdefghijklmnopqrstuvwxyz'[k]} kind" for k in range(12)]
    fresh = lambda k: " ".join(f"w{k}x{i}q" for i in range(60))
    rows = [(k, "\n".join(often) + f"\nown{chr(97 + k)}", "h") for k in range(26)] + [(500, "\n".join(often), "h"), (500, fresh(1), "h"), (500, "\n".join(often), "h"), (None, "\n".join(often), "h")]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_share=0.0).collect()
    mine = sorted((r["n_words"], r["n_removed_words"], r["kept"]) for r in got if r["doc_id"] == 500)
    assert mine == [(60, 0, True), (84, 84, False), (84, 84, False)] and len(got) == len(rows)
    assert [r["n_removed_words"] for r in got if r["doc_id"] is None] == [0]
