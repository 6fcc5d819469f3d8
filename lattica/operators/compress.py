"""Per-key results when a few keys hold most records (value-frequency compression).

Rows are first grouped by (key, value): a hot key of a billion rows becomes as many rows as it has
distinct values, spread over all tasks because the value is part of the shuffle key. Exact distinct
counts, modes, sums and percentiles are then derived from the weighted values. Keys whose distinct
values are still many are cut into sub-blocks of the value range, whose (value, running weight)
offsets are combined afterwards, so no task ever holds a whole key.

Null keys are no key and drop out. Null values count in n_rows and sums but are no distinct value,
no mode and no percentile. Repeated rows count as often as they occur. An empty table gives no rows.
Columns of the input other than the named ones are ignored, so clashing names cannot matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Distinct values of a key up to which one task ranks them.
BLOCK_VALUES = 10_000


def compress(df: DataFrame, key: Column, value: Column, measures: dict[str, Column] | None = None) -> DataFrame:
    """(key, value, n, <measure>...): one row per key and value with its frequency and measure sums."""
    measures = measures or {}
    flat = df.select(key.alias("key"), value.alias("value"), *[c.alias(f"m_{m}") for m, c in measures.items()]).filter("key is not null")
    return flat.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"m_{m}").alias(m) for m in measures])


def profile(compressed: DataFrame, measures: Sequence[str] = ()) -> DataFrame:
    """(key, n_rows, n_values, mode_value, mode_n, <measure sums>). The mode's tie goes to the smallest value.

    All aggregates are algebraic, so Spark combines them map-side: a key sends one row per map task.
    """
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("w"), F.col("value").alias("v"))))
    return (
        compressed.groupBy("key")
        .agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_values"), best.alias("best"), *[F.sum(m).alias(m) for m in measures])
        .select("key", "n_rows", "n_values", F.col("best.v").alias("mode_value"), (-F.col("best.w")).alias("mode_n"), *measures)
    )


def weighted_percentiles(compressed: DataFrame, fractions: Sequence[float], blocks: int = 64) -> DataFrame:
    """(key, fraction, percentile): the smallest value whose cumulative weight reaches fraction * total.

    A key of more than BLOCK_VALUES distinct values has them cut into `blocks` sub-blocks at quantiles of the values themselves, so a heavy
    tail does not gather in one; only the block weights are put in order per key, and only the block that holds the wanted rank is ranked value by value.
    """
    kept = compressed.filter("value is not null").select("key", F.col("value").cast("double").alias("value"), "n").filter("not isnan(value)")
    span = kept.groupBy("key").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"))
    wide = span.filter(F.col("distinct") > BLOCK_VALUES).select(F.col("key").alias("_k"))
    at = [i / blocks for i in range(1, blocks)]
    edges = kept.join(wide, F.col("key") == F.col("_k"), "left_semi").groupBy(F.col("key").alias("_k")).agg(F.percentile_approx("value", at, 1000).alias("edges"))
    placed = kept.join(span, "key").join(edges, F.col("key") == F.col("_k"), "left").withColumn("block", F.when(F.col("edges").isNull(), 0).otherwise(F.size(F.filter("edges", lambda e: e < F.col("value"))))).drop("_k", "edges")
    sums = placed.groupBy("key", "block", "total").agg(F.sum("n").alias("w"))
    upto = sums.withColumn("before", F.sum("w").over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    wanted = upto.withColumn("before", F.coalesce("before", F.lit(0))).withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    wanted = wanted.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("total"))))
    wanted = wanted.filter("rank > before and rank <= before + w").select("key", "block", "fraction", "rank", "before")
    inside = W.partitionBy("key", "block").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    # only blocks that hold a wanted rank are ranked value by value
    hit = placed.join(wanted.select("key", "block").distinct(), ["key", "block"], "left_semi").withColumn("cum", F.sum("n").over(inside))
    found = hit.join(wanted, ["key", "block"]).filter(F.col("cum") + F.col("before") >= F.col("rank"))
    return found.groupBy("key", "fraction").agg(F.min("value").alias("percentile"))


def pair_sides(df: DataFrame, a: Column, b: Column, measures: dict[str, Column] | None = None) -> DataFrame:
    """(key, value, <measure>...): each row under both of its ends; a row with the same end twice counts once.

    The other end is the value: null where it names nothing, the key itself for a self loop.
    """
    measures = measures or {}
    ends = df.select(a.alias("a"), b.alias("b"), *[c.alias(m) for m, c in measures.items()])
    one, two = F.struct(F.col("a").alias("key"), F.col("b").alias("value")), F.struct(F.col("b").alias("key"), F.col("a").alias("value"))
    sides = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(one)).otherwise(F.array(one, two))
    return ends.select(F.explode(sides).alias("side"), *measures).select("side.key", "side.value", *measures).filter("key is not null")


def hot_keys(per_key: DataFrame, total_rows: int, share: float) -> DataFrame:
    """Keys of a profile that are named on at least `share` of all rows."""
    return per_key.filter(F.col("n_rows") >= F.lit(share) * F.lit(float(total_rows)))
