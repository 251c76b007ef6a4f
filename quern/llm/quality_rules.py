"""Quality rules: per-document counts and cross-document line frequency (native DataFrame operators only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WORD, text_mark

SYMBOLS = r"[#*$%&|<>]"


def line_key(line) -> F.Column:
    """Hash of a normalised line: lower case, runs of white space as one space, runs of digits as one 0, trimmed."""
    spaced = F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")
    return F.xxhash64(F.trim(F.regexp_replace(spaced, "[0-9]+", "0")))


def document_metrics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Word, symbol, line and repetition counts of every whole text.

    Repeated 3-word windows are found per row by sorting (hash, position) pairs, so no row leaves its task.
    Null and empty texts count as no words; texts under three words have no repeated words. mark tells apart the texts
    of rows that share an id.
    """
    n = F.size("__words")
    base = (
        docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
        .withColumn("mark", text_mark(F.col("__text")))
        .withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), 0))
        .withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(WORD)))
        .select(
            "doc_id",
            "mark",
            "__words",
            n.cast("long").alias("n_words"),
            F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            F.when(
                n >= 3,
                F.transform(
                    F.sequence(F.lit(0), n - 3),
                    lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)),
                ),
            ).alias("__tri"),
        )
        .drop("__words")
    )
    pairs = base.withColumn(
        "__sorted",
        F.when(F.size(F.array_distinct("__tri")) < F.size("__tri"), F.sort_array(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("__tri")
    at = lambda k: F.get("__sorted", k)
    hits = pairs.withColumn(
        "__hits",
        F.when(
            F.col("__sorted").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size("__sorted") - 1),
                        lambda k: F.coalesce(at(k - 1)["h"] == at(k)["h"], F.lit(False)) | F.coalesce(at(k + 1)["h"] == at(k)["h"], F.lit(False)),
                    ),
                    lambda k: at(k)["i"],
                )
            ),
        ),
    ).drop("__sorted")
    repeated = F.aggregate(
        F.sequence(F.lit(0), F.size("__hits") - 1),
        F.lit(0).cast("long"),
        lambda a, k: a + F.least(F.lit(3), F.coalesce(F.get("__hits", k + 1) - F.get("__hits", k), F.lit(3))),
    )
    return hits.withColumn("n_repeat_words", F.when(F.col("__hits").isNull(), F.lit(0).cast("long")).otherwise(repeated)).drop("__hits")


def document_lines(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """doc_id, mark, host, pos, line, words: one row per line with a word, its normalised hash and its words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(
        F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD)),
        lambda x: F.struct(line_key(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words")),
    )
    rows = docs.select(F.col(key).alias("doc_id"), text_mark(whole).alias("mark"), F.col(host).alias("host"), F.posexplode(lines).alias("pos", "l"))
    return rows.select("doc_id", "mark", "host", "pos", "l.line", "l.words")


def frequent_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = 20, min_share: float = 0.0005) -> DataFrame:
    """(host, line, n_docs): lines that stand in more than min_docs documents and more than min_share of a host's documents.

    Documents are counted by different ids, so rows that share one count once, and rows without one not at all. The
    lines of a row are made distinct inside it, (host, line, id) in its task and then in its shuffle, and counts are
    formed in part before the second one, so a hot host or line sends one row per task there.
    """
    hashes = F.array_distinct(F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(WORD)), line_key))
    per_line = (
        docs.select(F.col(host).alias("host"), F.col(key).alias("id"), F.explode(hashes).alias("line"))
        .groupBy("host", "line").agg(F.count_distinct("id").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    )
    per_host = docs.groupBy(F.col(host).alias("host")).agg(F.count_distinct(F.col(key)).alias("host_docs"))
    joined = per_line.join(per_host, per_line.host.eqNullSafe(per_host.host)).select(per_line.host, "line", "n_docs", "host_docs")
    return joined.filter(F.col("n_docs") > F.col("host_docs") * min_share).drop("host_docs")


def quality_rules(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_words: int = 50,
    max_repeat_share: float = 0.5,
    max_removed_share: float = 0.5,
    min_docs: int = 20,
    min_share: float = 0.0005,
) -> DataFrame:
    """Metrics, base verdict and the line-frequency verdict of every document.

    A document is rejected when it fails the base rules (too few words, or too many words in repeated 3-word
    windows) or when more than max_removed_share of its words stand in lines that are frequent on its host.
    Null host is a host of its own. Null and empty texts have no words and fail the base rules. Rows that share an id
    count as one document for a line's frequency, and each is judged by its own text. Rows without an id count for no
    line and lose none. Very long texts are read whole, in time linear in their length but for one sort. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    metrics = document_metrics(docs, key, text)
    lines = document_lines(docs, key, text, host)
    frequent = frequent_lines(docs, key, text, host, min_docs, min_share)
    removed = (
        lines.join(frequent, (lines.line == frequent.line) & lines.host.eqNullSafe(frequent.host))
        .select(lines.doc_id.alias("removed_id"), lines["mark"].alias("removed_mark"), "pos", "words")
        .distinct()  # rows that repeat in all
        .groupBy("removed_id", "removed_mark")
        .agg(F.sum("words").cast("long").alias("n_removed_words"), F.count("*").alias("n_removed_lines"))
    )
    base_failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))
    return (
        metrics.join(removed, (metrics.doc_id == removed.removed_id) & (metrics["mark"] == removed.removed_mark), "left")
        .drop("removed_id", "removed_mark", "mark")
        .withColumns({"n_removed_words": F.coalesce("n_removed_words", F.lit(0).cast("long")), "n_removed_lines": F.coalesce("n_removed_lines", F.lit(0).cast("long"))})
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= max_removed_share * F.col("n_words")))
    )


def cleaned_texts(docs: DataFrame, frequent: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, text) without the lines that are frequent on the document's host; other lines keep their order."""
    lines = document_lines(docs, key, text, host)
    drop = (
        lines.join(frequent, (lines.line == frequent.line) & lines.host.eqNullSafe(frequent.host))
        .groupBy(lines.doc_id.alias("removed_id"), lines["mark"].alias("removed_mark"))
        .agg(F.collect_set(lines.line).alias("__drop"))
    )
    mark = text_mark(F.coalesce(docs[text], F.lit("")))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x: ~F.coalesce(F.array_contains("__drop", line_key(x)), F.lit(False)) | ~x.rlike(WORD)), "\n")
    return docs.join(drop, (docs[key] == drop.removed_id) & (mark == drop.removed_mark), "left").select(docs[key].alias("doc_id"), F.when(F.col("__drop").isNull(), F.col(text)).otherwise(kept).alias("text"))
