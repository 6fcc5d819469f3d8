"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The total is the largest at which the sources that cannot fill their share, with every record repeated up to its cap, miss
at most `max_shortfall` of it together (0, the default, keeps every share exact and lets the scarcest source bound the total); actual shares are
reported. Sources without records, and target weights of zero, are left out and the other weights scaled up. Slots of
`block_tokens` tokens are numbered; slot i goes to the source in whose part of the cumulative weights the van der Corput point
of i falls, so every stretch of slots has nearly the target shares. A slot's rank among its source's slots names a block of
that source's records, shuffled by hash anew for every repetition and cut by running token sums. A record belongs to the block in
which it begins and is never cut; a source's last record is taken when more than half of it lies within the share.

Ranks and running sums are two-level, so a source of any size is spread over the tasks. Only one row per source of the
target list goes to the driver. Records with null or unknown source, and records without tokens, are not selected. Sources are
the same after trimming and lower-casing; a target listed twice has its weights added.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.operators.ranks import grouped_prefix
from lattica.session import cut

BLOCK_TOKENS = 512
MAX_SHORTFALL = 0.0
SLOTS_PER_CHUNK = 1 << 16


def _key(c: str):
    return F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))


def schedule(df: DataFrame, weights: list[float], slots: int) -> DataFrame:
    """(slot, source_no, block): the source of each slot and the slot's rank among that source's slots."""
    bits = max(1, math.ceil(math.log2(max(2, slots))))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("double") / float(1 << bits)
    upto, run = [], 0.0
    for w in weights:
        run += w
        upto.append(run)
    number = F.lit(len(weights) - 1)
    for i in range(len(weights) - 2, -1, -1):
        number = F.when(point < upto[i], i).otherwise(number)
    drawn = df.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("source_no", number)
    chunk = F.floor(F.col("slot") / SLOTS_PER_CHUNK)
    return grouped_prefix(drawn, ["source_no"], ["slot"], name="block", block=chunk)


def largest_total(parts: list[tuple[float, float]], max_shortfall: float) -> float:
    """Largest T with sum(max(0, w * T - cap)) <= max_shortfall * T over (w, cap); the weights sum to 1."""
    parts = sorted(parts, key=lambda p: p[1] / p[0])
    short_w = short_cap = 0.0
    for i, (w, cap) in enumerate(parts):
        short_w, short_cap = short_w + w, short_cap + cap
        if short_w > max_shortfall:
            total = short_cap / (short_w - max_shortfall)
            if i + 1 == len(parts) or total <= parts[i + 1][1] / parts[i + 1][0]:
                return max(total, cap / w)
    return short_cap


def mix(records: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 0, max_shortfall: float = MAX_SHORTFALL) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of records (doc_id, source, n_tokens) and targets (source, target_weight, max_repeat).

    selection: (slot, source, doc_id, repetition, n_tokens); shares: (source, target_weight, max_repeat, n_records,
    available_tokens, selected_records, selected_tokens, actual_share, max_used).
    """
    spark = records.sparkSession
    goal = targets.filter("source is not null").groupBy(_key("source").alias("source")).agg(F.sum("target_weight").alias("target_weight"), F.min("max_repeat").alias("max_repeat"))
    known = records.select("doc_id", _key("source").alias("source"), "n_tokens").filter("n_tokens > 0")
    kept = cut(known.join(F.broadcast(goal.select("source")), "source"))  # the target list does not grow
    supply = goal.join(kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("available_tokens")), "source", "left").na.fill(0, ["n_records", "available_tokens"])
    rows = sorted(supply.collect(), key=lambda r: r.source)  # one row per listed source
    usable = [r for r in rows if r.available_tokens and (r.target_weight or 0) > 0 and (r.max_repeat or 0) > 0]
    scale = sum(r.target_weight for r in usable)
    total = largest_total([(r.target_weight / scale, float(r.max_repeat * r.available_tokens)) for r in usable], max_shortfall) if usable else 0
    slots = int(total // block_tokens)
    if not slots:
        empty = spark.createDataFrame([], "slot bigint, source string, doc_id bigint, repetition int, n_tokens int")
        return empty, _shares(supply, empty)
    plan = cut(schedule(kept, [r.target_weight / scale for r in usable], slots))
    quota = {r.source_no: r.n for r in plan.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    facts = [(r.source, i, int(r.available_tokens), quota.get(i, 0) * block_tokens, min(int(r.max_repeat), -(-quota.get(i, 0) * block_tokens // int(r.available_tokens)))) for i, r in enumerate(usable)]
    facts_df = F.broadcast(spark.createDataFrame(facts, "source string, source_no int, supply bigint, quota bigint, passes int"))
    passes = kept.join(facts_df, "source").filter("passes > 0").withColumn("repetition", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    shuffled = passes.withColumn("h", F.xxhash64("doc_id", "repetition", F.lit(seed)))
    laid = grouped_prefix(shuffled, ["source_no", "repetition"], ["h", "doc_id"], F.col("n_tokens").cast("bigint"), blocks=256)
    begun = laid.withColumn("begin", F.col("repetition") * F.col("supply") + F.col("before")).filter("begin + n_tokens / 2 < quota")
    blocks = begun.withColumn("block", F.floor(F.col("begin") / block_tokens))
    selection = blocks.join(plan, ["source_no", "block"]).select("slot", "source", "doc_id", "repetition", "n_tokens")
    return selection, _shares(supply, selection)


def _shares(supply: DataFrame, selection: DataFrame) -> DataFrame:
    got = selection.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("u"), F.sum("n_tokens").alias("t"))
    per = got.groupBy("source").agg(F.sum("u").alias("selected_records"), F.sum("t").alias("selected_tokens"), F.max("u").alias("max_used"))
    told = supply.join(per, "source", "left").na.fill(0, ["selected_records", "selected_tokens", "max_used"])
    whole = F.sum("selected_tokens").over(W.partitionBy(F.lit(0)))  # over one row per listed source
    return told.withColumn("actual_share", F.try_divide(F.col("selected_tokens").cast("double"), whole))
