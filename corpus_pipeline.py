"""The training-corpus pipeline: language, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Ids are the key of documents: rows that share an id
stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, materialise, released, small_batches
from quern.llm.decontaminate import contaminated
from quern.llm.language_id import fit_language_model, language_filter
from quern.llm.mixing import Mix
from quern.llm.near_copies import near_copies
from quern.llm.token_output import training_order


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letter, or a calibrated probability under the model's limit."""
    return language_filter(docs, fit_language_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (op5's links, or five-word shingles at 0.8 and over) the document with the
    smallest id stays."""
    gone = near_copies(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go. Their ids are a written table, whose size is
    known when the join is planned."""
    with small_batches(spark):
        found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        gone = materialise(found.select(F.col("doc_id").alias("__gone")).distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes the block in which they begin; copies stand far apart in a partition. Rows
    without an id or a word are left out."""
    copies = Mix(docs).copies().select(F.col("doc_id").alias("__taken"), F.col("copies").alias("__copies"))
    taken = docs.join(copies, docs["doc_id"] == copies["__taken"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.sortWithinPartitions("__copy", F.xxhash64("doc_id", "__copy")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids in training order, in shards; the rows are their index."""
    return training_order(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_output", tokens)]

#: The stages train a model and link fingerprints, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written to the shared folder and read again, and goes
    when the next one is written."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
            released(before)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
