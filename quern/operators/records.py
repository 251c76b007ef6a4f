"""Records with lists: positional and greedy alignment, segments, packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zip_positions(left: DataFrame, right: DataFrame, key: str, items: str) -> DataFrame:
    """key, pos (from 1), left_v, right_v: entries paired by position, the shorter list padded with NULL."""
    both = left.select(key, F.col(items).alias("__l")).join(right.select(key, F.col(items).alias("__r")), key, "full_outer")
    empty = both.select(key, F.posexplode(F.arrays_zip(F.coalesce("__l", F.array()), F.coalesce("__r", F.array()))).alias("pos", "z"))
    return empty.select(key, (F.col("pos") + 1).cast("long").alias("pos"), F.col("z.0").alias("left_v"), F.col("z.1").alias("right_v"))


def boundaries(lengths: Column) -> Column:
    """Prefix sums of an array of segment lengths, from 0."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def position_ids(lengths: Column) -> Column:
    """Position ids of packed segments: each starts again at 0."""
    return F.flatten(F.transform(F.filter(lengths, lambda x: x > 0), lambda x: F.sequence(F.lit(0), (x - 1).cast("int"))))


def stream_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, block: int) -> DataFrame:
    """Rows with start and first_block, last_block of a stream of tokens cut into blocks; an end token follows each row."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col(size) + 1).over(w)
    out = df.withColumn("start", (end - F.col(size) - 1).cast("long"))
    return out.withColumns({"first_block": F.floor(F.col("start") / block).cast("long"), "last_block": F.floor((F.col("start") + F.col(size)) / block).cast("long")})


def packed_blocks(df: DataFrame, order: Sequence[str], size: str, live: str, block: int) -> DataFrame:
    """block, n_live: the blocks of one stream of all rows, an end token after each; a block without a live token and the
    tail, which fills no block, are dropped. The end token of a live row with a token is live. The order must be total."""
    from quern.operators.windows import running_totals

    rows = running_totals(df.withColumn("__n", (F.col(size) + 1).cast("long")), order, {"__end": "__n"}).withColumn("__start", F.col("__end") - F.col("__n"))
    parts = rows.withColumn("block", F.explode(F.sequence(F.expr(f"__start div {block}"), F.expr(f"(__end - 1) div {block}"))))
    inside = F.least("__end", (F.col("block") + 1) * block) - F.greatest("__start", F.col("block") * block)
    sums = parts.groupBy("block").agg(F.sum(inside).alias("__all"), F.sum(F.when(F.col(live) & (F.col(size) > 0), inside).otherwise(0)).alias("n_live"))
    return sums.filter((F.col("__all") == block) & (F.col("n_live") > 0)).select("block", "n_live")


def first_fit_decreasing(df: DataFrame, shard: str, key: str, size: str, capacity: int) -> DataFrame:
    """shard, key, size, bin: whole rows in bins of a capacity, largest first, ties by key; bin -1 where too long.

    Greedy, so it is done per shard: a shard is a bounded share of the rows (a hash bucket, a length band). One shard
    gives the exact sequential packing. A tournament tree finds the first bin that fits in logarithmic time.
    """
    schema = f"{shard} {dict(df.dtypes)[shard]}, {key} {dict(df.dtypes)[key]}, {size} {dict(df.dtypes)[size]}, bin long"

    def pack(pdf):
        pdf = pdf.sort_values([size, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        n, leaves = len(pdf), 1
        while leaves < max(1, n):
            leaves *= 2
        room = [capacity] * (2 * leaves)
        bins = []
        for need in pdf[size]:
            if need > capacity:
                bins.append(-1)
                continue
            k = 1
            while k < leaves:
                k = 2 * k if room[2 * k] >= need else 2 * k + 1
            room[k] -= need
            bins.append(k - leaves)
            while k > 1:
                k //= 2
                room[k] = max(room[2 * k], room[2 * k + 1])
        pdf["bin"] = bins
        return pdf[[shard, key, size, "bin"]]

    return df.select(shard, key, size).groupBy(shard).applyInPandas(pack, schema)


def shards(df: DataFrame, shard: str, key: str, rows: int) -> DataFrame:
    """Rows with a shard number by the hash of their key: as many shards as the table has multiples of `rows`."""
    total = df.agg(F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).alias("__shards"))
    return df.join(F.broadcast(total)).withColumn(shard, F.pmod(F.xxhash64(key), F.col("__shards")).cast("long")).drop("__shards")


def compatible_runs(runs: DataFrame, run: str, problem: str, settings: Sequence[str]) -> DataFrame:
    """run, settings_differ, extra, missing, compatible: every run against the first, with which it may be merged.

    Runs may be merged or compared where all settings are equal and both have the same problems; extra and missing
    count the problems of one side only.
    """
    setting = F.to_json(F.struct(*settings))
    held = runs.select(F.col(run).alias("run"), F.col(problem).alias("problem"), setting.alias("s")).distinct()
    first = held.agg(F.min("run").alias("first"))
    mine = held.join(F.broadcast(first)).filter("run = first")
    totals = mine.agg(F.count_distinct("problem").alias("n"), F.array_sort(F.collect_set("s")).alias("wanted"))
    known = mine.select(F.col("problem").alias("p")).distinct()
    each = held.select("run", "problem").distinct().join(known, F.col("problem") == F.col("p"), "left").groupBy("run").agg(F.count("p").alias("shared"), F.count_if(F.col("p").isNull()).alias("extra"))
    said = held.groupBy(F.col("run").alias("r")).agg(F.array_sort(F.collect_set("s")).alias("said"))
    both = each.join(said, F.col("run") == F.col("r")).join(F.broadcast(totals))
    out = both.select("run", (F.col("said") != F.col("wanted")).alias("settings_differ"), "extra", (F.col("n") - F.col("shared")).alias("missing"))
    return out.withColumn("compatible", ~F.col("settings_differ") & (F.col("extra") == 0) & (F.col("missing") == 0))


def greedy_alignment(df: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """key, pairs: truth rows in their order, each with the predicted row that is left and agrees in most of its fields.

    Fields that are null in the truth do not count; of equally good predicted rows the first is taken, even where no
    field agrees. A truth row for which none is left has an empty map, and so have predicted rows left over. Native
    array functions walk a record's rows, so no row leaves its task.
    """
    kind = "map<string,string>"
    none = F.create_map().cast(kind)
    t = F.coalesce(F.col(truth), F.array().cast(f"array<{kind}>"))
    p = F.coalesce(F.col(predicted), F.array().cast(f"array<{kind}>"))
    agree = lambda x, y: F.size(F.filter(F.map_entries(x), lambda e: F.coalesce(e["value"] == F.try_element_at(y, e["key"]), F.lit(False))))
    numbered = F.transform(p, lambda y, i: F.struct(i.alias("i"), y.alias("row")))

    def step(state, x):
        scored = F.transform(state["rest"], lambda y: F.struct(agree(x, y["row"]).alias("n"), (-y["i"]).alias("i")))
        at = -F.array_max(scored)["i"]
        chosen = F.element_at(F.filter(state["rest"], lambda y: y["i"] == at), 1)["row"]
        return F.when(
            F.size(state["rest"]) > 0,
            F.struct(F.filter(state["rest"], lambda y: y["i"] != at).alias("rest"), F.concat(state["pairs"], F.array(F.struct(x.alias("truth"), chosen.alias("predicted")))).alias("pairs")),
        ).otherwise(F.struct(state["rest"].alias("rest"), F.concat(state["pairs"], F.array(F.struct(x.alias("truth"), none.alias("predicted")))).alias("pairs")))

    start = F.struct(numbered.alias("rest"), F.array().cast(f"array<struct<truth:{kind},predicted:{kind}>>").alias("pairs"))
    extra = lambda a: F.transform(a["rest"], lambda y: F.struct(none.alias("truth"), y["row"].alias("predicted")))
    return df.select(key, F.aggregate(t, start, step, lambda a: F.concat(a["pairs"], extra(a))).alias("pairs"))
