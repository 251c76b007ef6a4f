"""Queries of the training-data operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from quern.llm.common import documents
from quern.llm.decontaminate import contaminated
from quern.llm.language_id import fit_language_model, predict_languages
from quern.llm.mixing import mix_sources
from quern.llm.quality_model import fit_quality_model, quality_scores
from quern.llm.quality_rules import quality_rules
from quern.llm.secrets import secret_digest
from quern.llm.simhash import near_duplicates
from quern.llm.substring_dedup import substring_dedup
from quern.llm.suffix_dedup import suffix_dedup
from quern.llm.token_output import training_order


def op1_mix_sources(spark, sf_dir):
    """Words that the mix takes of every document: weights 5, 2, 1 by source, at most three times each."""
    return mix_sources(documents(spark, sf_dir))


def op2_substring_dedup(spark, sf_dir):
    """Windows of 20 words that start earlier elsewhere, removed from every whole document."""
    return substring_dedup(documents(spark, sf_dir), texts=False)


def op3_language_id(spark, sf_dir):
    """Language of every whole document, learned from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    return predict_languages(docs, fit_language_model(docs))


def op4_quality_classifier(spark, sf_dir):
    """Quality of every whole document, learned from the labels that are not held out."""
    docs = documents(spark, sf_dir)
    return quality_scores(docs, fit_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_simhash_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate component of every whole document."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op6_decontaminate(spark, sf_dir):
    """Whole documents that hold a benchmark item, by template windows."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_secret_scans(spark, sf_dir):
    """Secret spans of every whole document."""
    return secret_digest(documents(spark, sf_dir))


def op8_token_output(spark, sf_dir):
    """Index of the sequences of all documents, written to shards in training order."""
    return training_order(documents(spark, sf_dir))


def op9_quality_rules(spark, sf_dir):
    """Counts and verdict of every document: whole texts, hosts are the documents' sources."""
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, text FROM d),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, words FROM w),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM documents GROUP BY source),
freq AS (SELECT lw.source, norm, count(DISTINCT doc_id) AS n_docs FROM lw GROUP BY lw.source, norm),
big AS (SELECT freq.source, norm FROM freq JOIN hosts ON freq.source IS NOT DISTINCT FROM hosts.source
        WHERE n_docs > 20 AND n_docs > host_docs * 0.0005),
gone AS (SELECT doc_id, sum(words) AS removed FROM lw JOIN big ON lw.norm = big.norm AND lw.source IS NOT DISTINCT FROM big.source GROUP BY doc_id),
tri AS (SELECT doc_id, i, words[i] AS a, words[i+1] AS b, words[i+2] AS c
        FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM m WHERE n_words >= 3)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
j AS (SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, coalesce(dup.n_dup_lines, 0) AS n_dup_lines,
        coalesce(cov.n_repeat_words, 0) AS n_repeat_words, coalesce(gone.removed, 0) AS removed
      FROM m LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND removed <= 0.5 * n_words AS kept FROM f
"""


def op10_suffix_dedup(spark, sf_dir):
    """200-byte strings that stand elsewhere too, removed from every whole document."""
    return suffix_dedup(documents(spark, sf_dir), texts=False)


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
g AS (SELECT doc_id, i, array_to_string(words[i:i+19], ' ') AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, 20)) AS k)),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) FILTER (WHERE c.i IS NULL) AS kept, count(c.i) AS n_removed
      FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return {"op2_substring_dedup": OP2_SQL, "op9_quality_rules": OP9_SQL}
