"""The N best items of every group under one fixed tie rule, by two-stage salted ranking.

Groups that hold many rows are hashed by item into subgroups; the best N of each subgroup are ranked first, the survivors
then once more by score and identifier. How many subgroups a group gets follows its exact row count, which is combined map-side
and of which only groups beyond one subgroup are kept (at most rows / subgroup_rows of them, however many groups there are). So the many
small groups are finished by the first stage and a group of any size never meets one task. All rows of an item fall into the
same subgroup, where the item keeps its best row. Rows whose score is null or NaN, or whose group has a null key, are left
out; ties beyond score and second score go to the smaller item. Repeated rows of an item count once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.session import cut, maybe_broadcast

#: Rows of one subgroup. Only the split depends on it, not the result.
SUBGROUP_ROWS = 50_000


def large_groups(rows: DataFrame, keys: Sequence[str], subgroup_rows: int) -> DataFrame:
    """(b_<key>..., salts) of the groups that need more than one subgroup."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > subgroup_rows)
    return counts.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.ceil(F.col("n") / subgroup_rows).alias("salts"))


def top_n(df: DataFrame, group: Sequence[str], item: str, score: str, second: str | None = None, n: int = 3, subgroup_rows: int = SUBGROUP_ROWS) -> DataFrame:
    """(group..., item, score, second, rank): score ascending, second descending with null last, item ascending."""
    kept = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(item).isNotNull())
    for g in group:
        kept = kept.filter(F.col(g).isNotNull())
    down = F.lit(None).cast("double") if second is None else F.col(second).cast("double")
    down = F.when(~F.isnan(down), -down)
    rows = kept.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col(item).alias("item"), F.col(score).alias("score"), down.alias("down"))
    keys = [f"g{i}" for i in range(len(group))]
    big = maybe_broadcast(cut(large_groups(rows, keys, subgroup_rows)))
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"b_{k}") for k in keys])
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("item"), F.col("salts"))).otherwise(0)
    salted = rows.join(big, same, "left").withColumn("salt", salt).drop("salts", *[f"b_{k}" for k in keys])
    # one shuffle by subgroup serves the best row per item and the ranking
    placed = salted.repartition(*keys, "salt")
    best = placed.groupBy(*keys, "salt", "item").agg(F.min(F.struct("score", F.col("down").isNull().alias("none"), "down")).alias("b"))
    flat = best.select(*keys, "salt", "item", F.col("b.score").alias("score"), F.col("b.none").alias("none"), F.col("b.down").alias("down"))
    order = [F.col("score").asc(), F.col("none").asc(), F.col("down").asc(), F.col("item").asc()]
    first = flat.withColumn("r", F.row_number().over(W.partitionBy(*keys, "salt").orderBy(*order))).filter(F.col("r") <= n)
    final = first.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
    named = [F.col(k).alias(g) for k, g in zip(keys, group, strict=True)]
    more = [] if second is None else [(-F.col("down")).alias(second)]
    return final.select(*named, F.col("item").alias(item), F.col("score").alias(score), *more, "rank")
