"""Samples, splits, dedup, budgets, decontamination and packing over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import records as REC
from quern.operators import relational as R
from quern.operators import sampling as S
from quern.operators import text as X
from quern.plans.registry import Query
from quern.session import table as t

QUERIES: list[Query] = []
BUCKET = "('0x' || substr(md5(CAST({} AS VARCHAR)),1,8))::BIGINT % 100"
TOK = "regexp_extract_all(lower(text),'[a-z0-9]+')"


def q(name, sql=None):
    def add(f):
        QUERIES.append(Query(name, f, sql))
        return f

    return add


@q("w8_hash_stratified_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(event_type || CAST(ts AS VARCHAR)), event_id) AS r FROM events) WHERE r <= 3")
def _(s, d):
    ev = t(s, d, "events").withColumn("h", S.hash_order(F.col("event_type"), F.col("ts")))
    return R.top_n(ev, ["user_id"], [F.col("h"), F.col("event_id")], 3).select("event_id")


@q("x1_group_time_split", "SELECT event_id, CASE WHEN user_id IN (3,5,8,13,21) THEN 'unseen_group' WHEN ts >= TIMESTAMP '2024-01-25' THEN 'unseen_time' ELSE 'train' END AS split FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", S.split_three(F.col("user_id"), [3, 5, 8, 13, 21], F.col("ts"), F.lit("2024-01-25").cast("timestamp_ntz")).alias("split"))


@q("x2_group_holdout", f"SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 50 AND {BUCKET.format('user_id')} < 15")
def _(s, d):
    return S.held_out_groups(t(s, d, "events"), "user_id", 50, 15)


@q("x3_group_quota", """WITH n AS (SELECT greatest(1, 300 // count(DISTINCT user_id)) AS k FROM events) SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r FROM events), n WHERE r <= k""")
def _(s, d):
    ev = t(s, d, "events")
    k = ev.agg(F.greatest(F.lit(1), F.floor(300 / F.count_distinct("user_id"))).alias("k"))
    w = W.partitionBy("user_id").orderBy(F.md5(F.col("event_id").cast("string")), "event_id")
    return ev.withColumn("r", F.row_number().over(w)).join(F.broadcast(k)).filter("r <= k").select("event_id")


@q("x4_label_targets", """WITH u AS (SELECT text, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1,2) SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM u) WHERE r <= 20""")
def _(s, d):
    u = t(s, d, "documents").groupBy(F.sha2("text", 256).alias("h"), "lang").agg(F.min("doc_id").alias("doc_id"))
    return R.top_n(u, ["lang"], [F.col("doc_id")], 20).select("doc_id", "lang")


@q("x5_frozen_manifest", """WITH p AS (SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(text), doc_id) AS r FROM documents) WHERE r <= 25)
   SELECT lang, count(*) AS n, 25 - count(*) AS shortfall, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM p GROUP BY 1""")
def _(s, d):
    p = R.top_n(t(s, d, "documents").withColumn("h", F.md5("text")), ["lang"], [F.col("h"), F.col("doc_id")], 25)
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return p.groupBy("lang").agg(F.count("*").alias("n"), (F.lit(25) - F.count("*")).alias("shortfall"), F.sha2(lines, 256).alias("digest"))


@q("x6_bucket_split", f"SELECT CASE WHEN {BUCKET.format('o_orderkey')} < 8 THEN 'test' WHEN {BUCKET.format('o_orderkey')} < 40 THEN 'train' END AS split, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    b = S.hash_bucket(F.col("o_orderkey"))
    return t(s, d, "orders").groupBy(F.when(b < 8, "test").when(b < 40, "train").alias("split")).agg(F.count("*").alias("n"))


@q("x7_permutation_split", "SELECT doc_id, row_number() OVER (ORDER BY md5('7' || CAST(doc_id AS VARCHAR)), doc_id) <= 0.2*(SELECT count(*) FROM documents) AS is_test FROM documents")
def _(s, d):
    from quern.operators.windows import surrogate_ids

    docs = t(s, d, "documents").select("doc_id", F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))).alias("h"))
    n = docs.agg((F.count("*") * 0.2).alias("cut"))
    return surrogate_ids(docs, ["h", "doc_id"], "r").join(F.broadcast(n)).select("doc_id", (F.col("r") <= F.col("cut")).alias("is_test"))


@q("x8_temporal_split", "SELECT event_id, CASE WHEN (row_number() OVER (ORDER BY ts, event_id) - 1) / (SELECT count(*) FROM events) >= 0.8 THEN 'test' ELSE 'train' END AS split FROM events")
def _(s, d):
    return S.temporal_split(t(s, d, "events").select("event_id", "ts"), ["ts", "event_id"], 0.8).select("event_id", "split")


@q("x9_group_folds", f"SELECT user_id, ({BUCKET.format('user_id')}) % 5 AS fold FROM (SELECT DISTINCT user_id FROM events)")
def _(s, d):
    return t(s, d, "events").select("user_id").distinct().select("user_id", (S.hash_bucket(F.col("user_id")) % 5).alias("fold"))


@q("x10_stratified_cap", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r <= 2")
def _(s, d):
    return S.stratified_sample(t(s, d, "documents"), ["lang", "source"], F.col("doc_id"), 2).select("doc_id")


@q("x11_largest_remainder", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT lang, n * 97.0 / sum(n) OVER () AS e FROM c),
   f AS (SELECT lang, e, floor(e) AS f, row_number() OVER (ORDER BY e - floor(e) DESC, lang) AS r, 97 - sum(floor(e)) OVER () AS rest FROM e) SELECT lang, (f + CASE WHEN r <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""")
def _(s, d):
    return S.largest_remainder(t(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 97)


@q("x12_even_allocation", """WITH RECURSIVE r AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*), lang) AS k, count(*) OVER () AS m FROM documents GROUP BY lang),
   a(k, rest) AS (SELECT 0::BIGINT, 300::BIGINT UNION ALL SELECT a.k+1, rest - least(n, rest // (m - a.k)) FROM a JOIN r ON r.k = a.k+1)
   SELECT lang, least(n, rest // (m - r.k + 1))::BIGINT AS quota FROM r JOIN a ON a.k = r.k - 1""")
def _(s, d):
    return S.even_allocation(t(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 300)


@q("x13_share_quota", "SELECT lang, ceil(500.0::DOUBLE * n / sum(n) OVER () / 0.8)::BIGINT AS quota FROM (SELECT lang, count(*)::DOUBLE AS n FROM documents GROUP BY 1)")
def _(s, d):
    shares = t(s, d, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("n")).withColumn("keep", F.lit(0.8))
    return S.share_quota(shares, "lang", "n", 500, "keep")


@q("x14_latest_per_key", "SELECT user_id, max(ts)::VARCHAR AS last FROM events GROUP BY 1")
def _(s, d):
    return R.latest_per_key(t(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("ts").cast("string").alias("last"))


@q("x15_exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang, source")
def _(s, d):
    keyed = t(s, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("h"))
    return S.first_seen(keyed, ["h", "lang", "source"], [F.col("doc_id")]).select("doc_id")


@q("x16_pooled_dedup", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id % 3, doc_id) AS r FROM documents) WHERE r = 1")
def _(s, d):
    return S.pooled_dedup(t(s, d, "documents").withColumn("pool", F.col("doc_id") % 3), F.col("text"), "pool", "doc_id").select("doc_id")


@q("x17_resume", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type='error', ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def _(s, d):
    ev = t(s, d, "events").withColumns({"error": F.when(F.col("event_type") == "error", F.lit("x")), "seq": F.struct("ts", "event_id")})
    return S.resume_rows(ev, "user_id", "error", "seq").select("user_id", "event_id")


@q("x18_content_holdout", """WITH k AS (SELECT conv_id, sha1(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1)
   SELECT conv_id FROM k WHERE conv_id % 4 = 0 AND h NOT IN (SELECT h FROM k WHERE conv_id % 4 <> 0)""")
def _(s, d):
    turn = F.concat(F.col("role"), F.lit(":"), F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("x")))), lambda x: x["x"]), "\n")
    k = t(s, d, "conversations").groupBy("conv_id").agg(F.sha1(body).alias("h"))
    return k.filter("conv_id % 4 = 0").join(k.filter("conv_id % 4 <> 0").select("h").distinct(), "h", "left_anti").select("conv_id")


@q("x19_recall", "SELECT count(DISTINCT a.text) FILTER (WHERE b.text IS NOT NULL)::DOUBLE / count(DISTINCT a.text) AS recall FROM (SELECT text FROM documents WHERE doc_id % 5 = 0) a LEFT JOIN (SELECT DISTINCT text FROM documents WHERE doc_id % 5 <> 0) b USING (text)")
def _(s, d):
    docs = t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    want, have = docs.filter("doc_id % 5 = 0").select("h").distinct(), docs.filter("doc_id % 5 <> 0").select("h").distinct().withColumn("hit", F.lit(1))
    return want.join(have, "h", "left").agg((F.count("hit") / F.count("*")).alias("recall"))


@q("x20_seeded_order", "SELECT doc_id FROM documents ORDER BY md5('17' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def _(s, d):
    return t(s, d, "documents").select("doc_id").orderBy(S.hash_order(F.lit("17"), F.col("doc_id")), "doc_id").limit(100)


@q("x21_licensed_only", """SELECT count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE kept AND leaks) AS leaked, count(*) FILTER (WHERE NOT kept AND leaks) AS caught
   FROM (SELECT source <> (SELECT min(source) FROM documents) AS kept, contains(text,'Licensed under') AS leaks FROM documents)""")
def _(s, d):
    """The allow-list is by source; the assertion looks at the texts it lets through, so it can fail."""
    docs = t(s, d, "documents").select("source", F.contains("text", F.lit("Licensed under")).alias("leaks"))
    refused = docs.agg(F.min("source").alias("refused"))
    allowed = docs.join(F.broadcast(refused)).withColumn("kept", F.col("source") != F.col("refused"))
    return allowed.agg(F.count_if("kept").alias("kept"), F.count_if(F.col("kept") & F.col("leaks")).alias("leaked"), F.count_if(~F.col("kept") & F.col("leaks")).alias("caught"))


@q("x22_first_seen_chunks", "SELECT doc_id % 100 AS k, min(doc_id // 100) AS chunk FROM documents GROUP BY 1")
def _(s, d):
    docs = t(s, d, "documents").select((F.col("doc_id") % 100).alias("k"), F.floor(F.col("doc_id") / 100).alias("chunk"))
    return S.first_seen(docs, ["k"], [F.col("chunk")])


@q("x23_compatible_runs", """WITH r AS (SELECT DISTINCT conv_id % 3 AS run, conv_id // 3 AS problem, CASE WHEN conv_id % 3 = 2 AND conv_id % 2 = 0 THEN 'b' ELSE 'a' END AS model FROM conversations),
   f AS (SELECT problem, model FROM r WHERE run = (SELECT min(run) FROM r)), e AS (SELECT run, count(DISTINCT problem) FILTER (WHERE problem NOT IN (SELECT problem FROM f)) AS extra,
     (SELECT count(DISTINCT problem) FROM f) - count(DISTINCT problem) FILTER (WHERE problem IN (SELECT problem FROM f)) AS missing, list_sort(list(DISTINCT model)) <> (SELECT list_sort(list(DISTINCT model)) FROM f) AS settings_differ FROM r GROUP BY run)
   SELECT run, settings_differ, extra, missing, NOT settings_differ AND extra = 0 AND missing = 0 AS compatible FROM e""")
def _(s, d):
    c = t(s, d, "conversations").select("conv_id").distinct()
    model = F.when((F.col("conv_id") % 3 == 2) & (F.col("conv_id") % 2 == 0), "b").otherwise("a")
    runs = c.select((F.col("conv_id") % 3).alias("run"), F.expr("conv_id div 3").alias("problem"), model.alias("model"))
    return REC.compatible_runs(runs, "run", "problem", ["model"])


@q("x24_sft_examples", """WITH tr AS (SELECT * FROM documents WHERE doc_id % 7 <> 0), ev AS (SELECT DISTINCT text FROM documents WHERE doc_id % 7 = 0),
   u AS (SELECT text, min(doc_id) AS doc_id, any_value(n_chars) AS n_chars FROM tr WHERE n_chars BETWEEN 200 AND 3000 AND text NOT IN (SELECT text FROM ev) GROUP BY text)
   SELECT least(n_chars // 500, 5) AS bucket, count(*) AS n FROM (SELECT * FROM u ORDER BY md5(text), doc_id LIMIT 300) GROUP BY 1""")
def _(s, d):
    docs = t(s, d, "documents").filter("n_chars between 200 and 3000 or doc_id % 7 = 0").withColumn("h", F.md5("text"))
    held = docs.filter("doc_id % 7 = 0").select("h").distinct()
    u = docs.filter("doc_id % 7 <> 0 and n_chars between 200 and 3000").join(held, "h", "left_anti").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"))
    return u.orderBy("h", "doc_id").limit(300).groupBy(F.least(F.floor(F.col("n_chars") / 500), F.lit(5)).alias("bucket")).agg(F.count("*").alias("n"))


@q("a17_budget", """SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS cum FROM documents) WHERE cum - n_chars < 20000 GROUP BY 1""")
def _(s, d):
    b = S.budget(t(s, d, "documents"), ["source"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], F.col("n_chars"), 20000)
    return b.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


GRAMS = f"""tk AS (SELECT doc_id, {TOK} AS w FROM documents), dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+12],' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w)-11)) AS i FROM tk WHERE len(w) >= 13)),
   bk AS (SELECT item_id, {TOK} AS w FROM benchmark), bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12],' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w)-11)) AS i FROM bk WHERE len(w) >= 13)),
   sz AS (SELECT item_id, count(*) AS item_grams FROM bg GROUP BY 1), ov AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (gram) GROUP BY 1,2)"""


@q("j14_inverted_index", f"WITH {GRAMS} SELECT doc_id, item_id, shared, item_grams FROM ov JOIN sz USING (item_id)")
def _(s, d):
    return X.overlap(t(s, d, "documents"), t(s, d, "benchmark"), "doc_id", "item_id")


@q("g1_identifier_rule", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'thandinghe|erhaou|licensed')")
def _(s, d):
    return t(s, d, "documents").filter(F.lower("text").rlike("thandinghe|erhaou|licensed")).select("doc_id")


@q("g2_numeric_answer", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^0-9])19(2|3)([^0-9]|$)')")
def _(s, d):
    return t(s, d, "documents").filter(F.col("text").rlike("(?<![0-9])(192|193)(?![0-9])")).select("doc_id")


@q("g3_any_shared_gram", f"WITH {GRAMS} SELECT DISTINCT doc_id FROM ov")
def _(s, d):
    right = X.item_grams(t(s, d, "benchmark"), "item_id")
    return X.matching_grams(t(s, d, "documents"), right, "doc_id").join(right, "gram", "left_semi").select("doc_id").distinct()


@q("g4_strong_overlap", f"WITH {GRAMS} SELECT doc_id, max(CASE WHEN 5*shared >= item_grams THEN 1 ELSE 0 END) = 1 AS rejected FROM ov JOIN sz USING (item_id) GROUP BY 1")
def _(s, d):
    o = X.overlap(t(s, d, "documents"), t(s, d, "benchmark"), "doc_id", "item_id")
    return o.groupBy("doc_id").agg(F.bool_or(5 * F.col("shared") >= F.col("item_grams")).alias("rejected"))


@q("g5_index_short_items", f"""WITH b AS (SELECT item_id, {TOK} AS w FROM benchmark) SELECT count(*) FILTER (WHERE len(w) >= 40) AS grams, count(*) FILTER (WHERE len(w) BETWEEN 20 AND 39) AS short, count(*) FILTER (WHERE len(w) < 20) AS unchecked FROM b""")
def _(s, d):
    n = F.size(X.tokens(F.col("text")))
    return t(s, d, "benchmark").agg(F.count_if(n >= 40).alias("grams"), F.count_if((n >= 20) & (n < 40)).alias("short"), F.count_if(n < 20).alias("unchecked"))


@q("g6_item_scan", f"WITH {GRAMS}, h AS (SELECT bg.item_id, count(DISTINCT gram) AS hit FROM bg JOIN dg USING (gram) GROUP BY 1) SELECT count(*) AS items, count(hit) AS any_, count(*) FILTER (WHERE 5*hit >= item_grams) AS strong FROM sz LEFT JOIN h USING (item_id)")
def _(s, d):
    grams = X.item_grams(t(s, d, "benchmark"), "item_id")
    seen = X.matching_grams(t(s, d, "documents"), grams, "doc_id").select("gram").distinct().withColumn("hit", F.lit(1))
    per = grams.join(seen, "gram", "left").groupBy("item_id").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))
    return per.agg(F.count("*").alias("items"), F.count_if(F.col("hit") > 0).alias("any_"), F.count_if((5 * F.col("hit") >= F.col("n")) & (F.col("hit") > 0)).alias("strong"))


@q("g7_scan_report", f"""WITH {GRAMS}, r AS (SELECT d.doc_id, CASE WHEN contains(lower(text),'licensed') THEN 'identifier' WHEN bool_or(coalesce(5*shared >= item_grams, false)) THEN 'overlap' WHEN bool_or(shared IS NOT NULL) THEN 'below_line' ELSE 'clean' END AS verdict
   FROM documents d LEFT JOIN ov ON ov.doc_id=d.doc_id LEFT JOIN sz USING (item_id) GROUP BY d.doc_id, text) SELECT verdict, count(*) AS n FROM r GROUP BY 1""")
def _(s, d):
    docs = t(s, d, "documents")
    o = X.overlap(docs, t(s, d, "benchmark"), "doc_id", "item_id").groupBy("doc_id").agg(F.bool_or(5 * F.col("shared") >= F.col("item_grams")).alias("strong"))
    j = docs.select("doc_id", F.contains(F.lower("text"), F.lit("licensed")).alias("named")).join(o, "doc_id", "left")
    v = F.when(F.col("named"), "identifier").when(F.col("strong"), "overlap").when(F.col("strong").isNotNull(), "below_line").otherwise("clean")
    return j.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@q("g8_scannable_text", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def _(s, d):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return t(s, d, "conversations").groupBy("conv_id").agg(F.md5(body).alias("digest"))


@q("g9_identifying_text", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN split_part(text, '.', 1) ELSE regexp_extract(text, '^([^,]*)', 1) END AS key_text FROM benchmark")
def _(s, d):
    return t(s, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.substring_index("text", ".", 1)).otherwise(F.regexp_extract("text", "^([^,]*)", 1)).alias("key_text"))


@q("g11_stream_blocks", """WITH x AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text),'[a-z0-9]+')) AS n FROM conversations), y AS (SELECT conv_id, turn, n, sum(n+1) OVER (ORDER BY conv_id, turn) - n - 1 AS start FROM x)
   SELECT conv_id, turn, start::BIGINT AS start, (start // 128)::BIGINT AS first_block, ((start + n) // 128)::BIGINT AS last_block FROM y""")
def _(s, d):
    from quern.operators.windows import running_totals

    x = t(s, d, "conversations").select("conv_id", "turn", (F.size(X.tokens(F.col("text"))) + 1).cast("long").alias("n"))
    y = running_totals(x, ["conv_id", "turn"], {"end": "n"}).withColumn("start", F.col("end") - F.col("n"))
    return y.select("conv_id", "turn", "start", F.expr("start div 128").alias("first_block"), F.expr("(end - 1) div 128").alias("last_block"))


@q("g11_packed_blocks", """WITH x AS (SELECT conv_id, turn, role='assistant' AS live, len(regexp_extract_all(lower(text),'[a-z0-9]+')) AS n FROM conversations), y AS (SELECT live, n, sum(n+1) OVER (ORDER BY conv_id, turn) - n - 1 AS start FROM x),
   z AS (SELECT live AND n > 0 AS live, unnest(range(start::BIGINT, (start+n+1)::BIGINT)) // 128 AS block FROM y)
   SELECT block::BIGINT AS block, count(*) FILTER (WHERE live) AS n_live FROM z GROUP BY 1 HAVING count(*) = 128 AND count(*) FILTER (WHERE live) > 0""")
def _(s, d):
    x = t(s, d, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("live"), F.size(X.tokens(F.col("text"))).cast("long").alias("n"))
    return REC.packed_blocks(x, ["conv_id", "turn"], "n", "live", 128)


#: Rows of a packing shard, about.
PACKED_ROWS = 2500


@q("g12_ffd_packing", None)
def _(s, d):
    x = REC.shards(t(s, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n")), "shard", "doc_id", PACKED_ROWS)
    return REC.first_fit_decreasing(x, "shard", "doc_id", "n", 2048)


@q("g13_block_stats", None)
def _(s, d):
    x = REC.shards(t(s, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n")), "shard", "doc_id", PACKED_ROWS)
    p = REC.first_fit_decreasing(x, "shard", "doc_id", "n", 2048).filter("bin >= 0")
    blocks = p.groupBy("shard", "bin").agg(F.sum("n").alias("tokens"), F.sort_array(F.collect_list("n")).alias("seq_lens"))
    return blocks.groupBy("shard").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"), F.round(100 * F.sum("tokens") / (2048 * F.count("*")), 4).alias("fill_pct"))


@q("g14_rejection_reasons", "SELECT CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars > 20000 THEN 'too_long' WHEN lang NOT IN ('en','de') THEN 'language' WHEN contains(text,'|') THEN 'table' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    r = F.when(F.col("n_chars") == 0, "empty").when(F.col("n_chars") > 20000, "too_long").when(~F.col("lang").isin("en", "de"), "language").when(F.contains("text", F.lit("|")), "table").otherwise("ok")
    return t(s, d, "documents").groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@q("g15_boundaries", """SELECT conv_id, list_concat([0::BIGINT], list(c ORDER BY turn)) AS bounds FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS c FROM conversations) GROUP BY 1""")
def _(s, d):
    lens = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))), lambda x: x["n"])
    return t(s, d, "conversations").groupBy("conv_id").agg(lens.alias("lens")).select("conv_id", REC.boundaries(F.col("lens")).alias("bounds"))


@q("g16_estimate_vs_exact", """WITH x AS (SELECT round_even(length(text)/3.5, 0)::BIGINT AS est, len(regexp_extract_all(text,'[^ ]+'))*2 AS exact FROM documents)
   SELECT count(*) FILTER (WHERE est=exact) AS equal, count(*) FILTER (WHERE est<exact) AS fewer, count(*) FILTER (WHERE est>exact) AS more, sum(est)::BIGINT AS est_sum, sum(exact)::BIGINT AS exact_sum FROM x""")
def _(s, d):
    x = t(s, d, "documents").select(X.approx_tokens(F.length("text")).alias("est"), (F.regexp_count("text", F.lit("[^ ]+")) * 2).cast("long").alias("exact"))
    return x.agg(F.count_if(F.col("est") == F.col("exact")).alias("equal"), F.count_if(F.col("est") < F.col("exact")).alias("fewer"), F.count_if(F.col("est") > F.col("exact")).alias("more"), F.sum("est").alias("est_sum"), F.sum("exact").alias("exact_sum"))


@q("g17_failed_turns", """SELECT conv_id, turn FROM (SELECT conv_id, turn, role, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role='assistant' AND nr='user' AND (starts_with(nt,'E') OR contains(nt,'Traceback'))""")
def _(s, d):
    from quern.operators.chat import failed_turns

    return failed_turns(t(s, d, "conversations"), "user", "^E|Traceback").select("conv_id", "turn")


@q("g18_selection_verdict", """SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role='assistant') = 0 THEN 'failed' WHEN count(*) > 8 THEN 'out_of_steps' WHEN sum(length(text)) > 4000 THEN 'over_block' ELSE 'kept' END AS verdict FROM conversations GROUP BY 1""")
def _(s, d):
    g = t(s, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("a"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return g.select("conv_id", F.when(F.col("a") == 0, "failed").when(F.col("n") > 8, "out_of_steps").when(F.col("chars") > 4000, "over_block").otherwise("kept").alias("verdict"))


@q("g19_prompt_overlap", """WITH p AS (SELECT conv_id, text FROM conversations WHERE role='user') SELECT count(DISTINCT a.text) AS shared FROM p a WHERE conv_id % 5 = 0 AND EXISTS (SELECT 1 FROM p b WHERE b.conv_id % 5 <> 0 AND b.text = a.text)""")
def _(s, d):
    p = t(s, d, "conversations").filter("role = 'user'")
    train = p.filter("conv_id % 5 <> 0").select("text").distinct()
    return p.filter("conv_id % 5 = 0").join(train, "text", "left_semi").agg(F.count_distinct("text").alias("shared"))
