"""Chat records: failed turns, loss masks, role logic, tool calls, reassembly of streamed deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def failed_turns(turns: DataFrame, reply_role: str, error: str, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Assistant turns that the next message answers with an error."""
    w = W.partitionBy(conv).orderBy(turn)
    x = turns.withColumns({"__nr": F.lead("role").over(w), "__nt": F.lead("text").over(w)})
    return x.filter((F.col("role") == "assistant") & (F.col("__nr") == reply_role) & F.col("__nt").rlike(error)).drop("__nr", "__nt")


def last_query_index(messages: Column) -> Column:
    """Position (from 0) of the last user message that is no wrapped tool response; -1 where there is none."""
    indexed = F.transform(messages, lambda m, i: F.when((m["role"] == "user") & ~m["text"].startswith("<tool_response>"), i).otherwise(F.lit(-1)))
    return F.coalesce(F.array_max(indexed), F.lit(-1))


def loss_mask(turns: DataFrame, train_role: str = "assistant", conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv, labels: a label per word of a conversation, -100 outside the trained role's turns, else the word's hash id."""
    word = F.regexp_extract_all(F.col(text), F.lit(r"\S+"), 0)
    labels = F.transform(word, lambda w: F.when(F.col("role") == train_role, F.pmod(F.xxhash64(w), F.lit(50000)).cast("int")).otherwise(F.lit(-100)))
    x = turns.select(conv, turn, labels.alias("l"))
    return x.groupBy(conv).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(turn, "l"))), lambda t: t["l"])).alias("labels"))


def normalised_calls(calls: DataFrame, conv: str = "conv_id", seq: str = "seq") -> DataFrame:
    """Tool calls with arguments as JSON text and ids by position; responses take the id of the call at their position.

    calls: conv, seq, kind (call or response), name, arguments (map). The n-th response answers the n-th call.
    """
    w = W.partitionBy(conv, "kind").orderBy(seq)
    x = calls.withColumn("id", F.concat(F.lit("call_"), F.row_number().over(w).cast("string")))
    return x.withColumn("arguments", F.when(F.col("arguments").isNotNull(), F.to_json("arguments")))


def reassembled(deltas: DataFrame, request: str = "request", seq: str = "seq") -> DataFrame:
    """One row per request from streamed deltas: content and reasoning joined in order, tool-call fragments by index,
    the last non-empty finish reason.

    deltas: request, seq, content, reasoning, call_index, call_name, call_arguments, finish.
    """
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(seq, c)))), lambda x: x[c]), "")
    main = deltas.groupBy(request).agg(ordered("content").alias("content"), ordered("reasoning").alias("reasoning"), F.max_by("finish", F.when(F.nullif("finish", F.lit("")).isNotNull(), F.col(seq))).alias("finish"))
    calls = (
        deltas.filter("call_index is not null").groupBy(request, "call_index").agg(ordered("call_name").alias("name"), ordered("call_arguments").alias("arguments"))
        .groupBy(request).agg(F.array_sort(F.collect_list(F.struct("call_index", "name", "arguments"))).alias("calls"))
    )
    return main.join(calls, request, "left")
