"""Ranks and prefix sums inside groups of any size, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.session import cut


def grouped_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | None = None, blocks: int = 64, name: str = "before", block: Column | None = None) -> DataFrame:
    """df with `name`: the sum of `value` (default 1: the 0-based rank) over the rows before it in its group.

    The order inside a group is by (block, order). By default rows are hashed into `blocks` sub-blocks by the order
    columns; `block` names other ones, such as ranges, to keep an order of one's own. Rows are summed per block and only
    the block sums are put in order by one window. `order` must be unique inside a group for a deterministic result.
    """
    value = F.lit(1).cast("bigint") if value is None else value
    block = F.pmod(F.xxhash64(*order), F.lit(blocks)) if block is None else block
    placed = df.withColumn("_v", value).withColumn("_block", block)
    sums = placed.groupBy(*keys, "_block").agg(F.sum("_v").alias("_w"))
    start = F.sum("_w").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.coalesce(start, F.lit(0)).alias("_start"))
    inside = F.sum("_v").over(W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ranked = placed.withColumn("_in", F.coalesce(inside, F.lit(0))).join(starts, same, "inner")
    return ranked.withColumn(name, F.col("_start") + F.col("_in")).drop("_v", "_block", "_b", "_start", "_in", *[f"_k_{k}" for k in keys])


def ordered_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | None = None, name: str = "before") -> DataFrame:
    """df with `name`: the sum of `value` (default 1) over the rows before it in its group, in the order of the order columns themselves.

    Rows are partitioned by ranges of (keys, order), so a group of any size, or the whole table when there are no keys, is
    spread over the tasks; each range is summed alone and only one row per group and range is put in order by a window. Rows that agree in keys
    and order lie in one range: group them first where one value may hold a large share of the rows.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    by = [*keys, *order]
    placed = df.withColumn("_v", F.lit(1).cast("bigint") if value is None else value)
    placed = cut(placed.repartitionByRange(parts, *by).withColumn("_block", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_block").agg(F.sum("_v").alias("_w"))
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # at most one row per range
    start = F.sum("_w").over(over.orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.coalesce(start, F.lit(0)).alias("_start"))
    inside = F.sum("_v").over(W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ranked = placed.withColumn("_in", F.coalesce(inside, F.lit(0))).join(starts, same, "inner")
    return ranked.withColumn(name, F.col("_start") + F.col("_in")).drop("_v", "_block", "_b", "_start", "_in", *[f"_k_{k}" for k in keys])


def ordered_extreme(df: DataFrame, order: Column, value: str, name: str, largest: bool) -> DataFrame:
    """df with `name`: the largest (or smallest) `value` over the rows up to and with each row in the given order, in two levels by ranges.

    `order` must tell the rows apart (group equal ones first).
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    f = F.max if largest else F.min
    placed = cut(df.withColumn("_o", order).repartitionByRange(parts, "_o").withColumn("_block", F.spark_partition_id()))
    per = placed.groupBy("_block").agg(f(value).alias("_w"))  # at most one row per range
    before = f("_w").over(W.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = per.select(F.col("_block").alias("_b"), before.alias("_start"))
    inside = f(value).over(W.partitionBy("_block").orderBy("_o").rowsBetween(W.unboundedPreceding, 0))
    met = placed.withColumn("_in", inside).join(starts, F.col("_block") == F.col("_b"))
    best = F.greatest("_in", "_start") if largest else F.least("_in", "_start")
    return met.withColumn(name, best).drop("_o", "_block", "_b", "_start", "_in")
