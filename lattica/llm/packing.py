"""Filling containers of fixed capacity: optimal length buckets and token-budget batches.

The global histogram of sizes, at most `capacity` counts however many items there are, goes to the driver. Dynamic
programming over it chooses the bucket boundaries that minimise padding. Batches form inside each bucket by token
budget, as many items as fit at the bucket's upper size; the room that a batch leaves is offered to the next
smaller buckets, so that a container is a fixed pattern of buckets that is used as often as its scarcest bucket allows.
The plan is a short list of such runs. Items only get their rank in their bucket (two-level, so no bucket meets one
task) and look their container up. Items larger than the capacity are cut into full containers and a rest.

Items of size 0 or null need no room and get no container (null). Repeated ids are separate items only if the
id columns differ. An empty table gives no containers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.ranks import grouped_prefix
from lattica.session import cut

BUCKETS = 96


def best_boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper sizes of at most `buckets` buckets that minimise the padding; counts[s] is the number of items of size s."""
    sizes = np.flatnonzero(counts)
    if len(sizes) <= buckets:
        return sizes.tolist()
    n, total = np.cumsum(counts[sizes]), np.cumsum(counts[sizes] * sizes)
    n0, t0 = np.concatenate(([0], n)).astype(float), np.concatenate(([0], total)).astype(float)
    m = len(sizes)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    back = np.zeros((buckets, m + 1), dtype=np.int32)
    for b in range(buckets):
        new = np.full(m + 1, np.inf)
        for j in range(1, m + 1):
            c = cost[:j] + sizes[j - 1] * (n0[j] - n0[:j]) - (t0[j] - t0[:j])
            i = int(np.argmin(c))
            new[j], back[b, j] = c[i], i
        cost = new
    ends, j = [], m
    for b in range(buckets - 1, -1, -1):
        if j == 0:
            break
        ends.append(int(sizes[j - 1]))
        j = int(back[b, j])
    return ends[::-1]


def plan_runs(uppers: Sequence[int], items: Sequence[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (bucket, first rank, end rank, first container, items per container); the buckets by index into uppers."""
    left, used, base, runs = list(items), [0] * len(items), 0, []
    while any(left):
        room, pattern = capacity, []
        for b in range(len(uppers) - 1, -1, -1):
            take = min(left[b], room // uppers[b])
            if take:
                pattern.append((b, take))
                room -= take * uppers[b]
        times = min(left[b] // take for b, take in pattern)
        for b, take in pattern:
            runs.append((b, used[b], used[b] + take * times, base, take))
            used[b] += take * times
            left[b] -= take * times
        base += times
    return runs


def pack(items: DataFrame, ids: Sequence[str], size: str, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """(ids..., piece, first_token, n_tokens, container) for each item, one row per piece."""
    cut_up = F.when(F.col(size) > capacity, F.sequence(F.lit(0), F.floor((F.col(size) - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))
    pieces = items.select(*ids, F.coalesce(size, F.lit(0)).alias("_s"), F.explode(cut_up).alias("piece"))
    pieces = cut(pieces.select(*ids, "piece", (F.col("piece") * capacity).cast("bigint").alias("first_token"), F.least(F.lit(capacity), F.col("_s") - F.col("piece") * capacity).cast("int").alias("n_tokens")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.filter("n_tokens > 0").groupBy("n_tokens").count().collect():  # at most `capacity` rows
        counts[r[0]] = r[1]
    none = pieces.filter("n_tokens <= 0").withColumn("container", F.lit(None).cast("bigint"))
    uppers = best_boundaries(counts, buckets)
    if not uppers:
        return none
    edges = np.searchsorted(uppers, np.arange(capacity + 1))
    per = np.bincount(edges, weights=counts, minlength=len(uppers)).astype(np.int64)[: len(uppers)]
    runs = items.sparkSession.createDataFrame(plan_runs(uppers, per.tolist(), capacity), "r_bucket int, lo bigint, hi bigint, base bigint, per int")
    bucket = F.get(F.lit([int(e) for e in edges]), F.col("n_tokens"))
    ranked = grouped_prefix(pieces.filter("n_tokens > 0").withColumn("bucket", bucket), ["bucket"], [*ids, "piece"], blocks=256, name="rank")
    met = ranked.join(F.broadcast(runs), (F.col("bucket") == F.col("r_bucket")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = met.select(*ids, "piece", "first_token", "n_tokens", (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).alias("container"))
    return placed.unionByName(none)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, n_tokens, unused_share, overfull): how well the containers are filled."""
    each = packed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("t"))
    total = F.sum("t")
    return each.agg(F.count(F.lit(1)).alias("n_containers"), total.alias("n_tokens"), (1 - total / (F.count(F.lit(1)) * capacity)).alias("unused_share"), F.count_if(F.col("t") > capacity).alias("overfull"))
