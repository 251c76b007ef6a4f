"""Tokens, n-grams, overlap with a benchmark, extraction from answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.grams import gram_filter, gram_rows


def tokens(text: Column) -> Column:
    """Lower-cased ASCII alphanumeric tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams of an array of words, joined by single spaces; empty under n words."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def item_grams(items: DataFrame, item: str, text: str = "text", n: int = 13) -> DataFrame:
    """item, gram, h: one row per distinct n-gram of an item."""
    return gram_rows(items, item, text, n).dropDuplicates([item, "gram"])


def matching_grams(texts: DataFrame, grams: DataFrame, key: str, text: str = "text", n: int = 13) -> DataFrame:
    """key, gram: the distinct n-grams of the texts that may be among the items' grams.

    A filter of fixed size keeps the other grams inside their task; a join on the gram's text stands behind it.
    """
    return gram_rows(texts, key, text, n, gram_filter(grams)).select(key, "gram").distinct()


def overlap(texts: DataFrame, items: DataFrame, key: str, item: str, text: str = "text", n: int = 13) -> DataFrame:
    """key, item, shared, item_grams: n-grams that a text and an item share, by an inverted-index join on the gram.

    The join is on the grams' text, so there are no hash collisions; Spark broadcasts the items' grams only where
    their measured size is under its threshold. One row leaves per text and item that share a gram.
    """
    right = item_grams(items, item, text, n)
    sizes = right.groupBy(item).agg(F.count("*").alias("item_grams"))
    shared = matching_grams(texts, right, key, text, n).join(right.select(item, "gram"), "gram").groupBy(key, item).agg(F.count("*").alias("shared"))
    return shared.join(sizes, item).select(key, item, "shared", "item_grams")


def short_items(items: DataFrame, item: str, text: str, least: int, n: int) -> DataFrame:
    """Items of least to n - 1 tokens as one space-joined string, padded for a whole-token search."""
    w = items.withColumn("__w", tokens(F.col(text)))
    return w.filter((F.size("__w") >= least) & (F.size("__w") < n)).select(item, F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" ")).alias("needle"))


def approx_tokens(chars: Column) -> Column:
    """Characters over 3.5, rounded half to even."""
    return F.bround(chars / 3.5).cast("long")


def last_number(text: Column) -> Column:
    """The last boxed number, else the last number, commas dropped; NULL where there is none."""
    boxed = F.regexp_extract_all(text, F.lit(r"\\boxed\{(-?[0-9][0-9,]*\.?[0-9]*)\}"), 1)
    plain = F.regexp_extract_all(text, F.lit(r"(-?[0-9][0-9,]*\.?[0-9]*)"), 1)
    pick = F.coalesce(F.try_element_at(boxed, F.lit(-1)), F.try_element_at(plain, F.lit(-1)))
    return F.regexp_replace(pick, ",", "").try_cast("double")


def answer_letter(text: Column) -> Column:
    """The letter of a multiple-choice answer: a stated answer first, else the last lone capital A to J."""
    stated = F.nullif(F.regexp_extract(text, r"(?i:answer is) \(?([A-J])\)?", 1), F.lit(""))
    marked = F.nullif(F.regexp_extract(text, r"(?s).*(?i:answer:)\s*([A-J])", 1), F.lit(""))
    lone = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b([A-J])\b"), 1), F.lit(-1))
    return F.coalesce(stated, marked, lone)


def code_blocks(text: Column, language: str | None = None) -> Column:
    """Bodies of fenced blocks, of one language or of all, thinking sections removed."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    tag = language if language else r"[A-Za-z0-9_+-]*"
    return F.regexp_extract_all(bare, F.lit(rf"(?s)```{tag}[ \t]*\n(.*?)```"), 1)


def standardised(text: Column) -> Column:
    """For comparison of string arguments: punctuation and spaces dropped, lower case, double quotes as single."""
    return F.translate(F.lower(F.regexp_replace(text, r"[ ,./_*^-]", "")), '"', "'")


def money(text: Column) -> Column:
    """Amount of a text such as $1,000.50; NA and junk are NULL."""
    return F.nullif(F.regexp_replace(F.trim(text), r"[$,]", ""), F.lit("NA")).try_cast("double")


def mixed_date(text: Column) -> Column:
    """Date of YYYY-MM-DD or MM/DD/YYYY, else NULL."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("MM/dd/yyyy"))).cast("date")
