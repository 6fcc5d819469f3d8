"""Average linkage, whole over a bounded set (arrays of a study) or down to a cut over any number of terms, and what is read off it.

A whole tree needs all distances of its set at once, so `cluster_terms` checks the set's size against MAX_LEAVES and refuses a larger one. `group_terms` needs
only the pairs that are listed and takes every term.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.operators.enrichment import similar_terms, term_kappa
from lattica.operators.network import components
from lattica.operators.ranks import ordered_prefix
from lattica.session import cut, maybe_broadcast

MAX_LEAVES = 2000


def average_linkage(dist: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(left, right, height, size) merges in order; leaves are 0..n-1, merge i is node n + i. Ties join the smaller nodes."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, merges = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        row = np.argmin(d.min(1))
        col = int(np.argmin(d[row]))
        i, j = sorted((int(row), col))
        merges.append((*sorted((ids[i], ids[j])), float(d[i, j]), int(size[i] + size[j])))
        new = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        new[~alive] = np.inf
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        ids[i] = n + step
    return merges


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, height: float) -> list[int]:
    """A group number per leaf: groups of merges at or below height, numbered by their first leaf."""
    up = list(range(n + len(merges)))
    for i, (a, b, h, _) in enumerate(merges):
        if h <= height + 1e-12:
            up[a] = up[b] = n + i

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    number: dict[int, int] = {}
    return [number.setdefault(top(x), len(number) + 1) for x in range(n)]


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Leaves from left to right with the heavier subtree first."""
    size = [1] * n + [m[3] for m in merges]
    out, stack = [], [n + len(merges) - 1] if n > 1 else list(range(n))
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            a, b = merges[x - n][:2]
            heavy, light = (a, b) if size[a] >= size[b] else (b, a)
            stack += [light, heavy]
    return out


def cluster_terms(terms: DataFrame, pairs: DataFrame, similarity: float = 0.3) -> DataFrame:
    """(term, cluster, leaf_order): average linkage of 1 - similarity, cut at 1 - `similarity`; pairs not listed have similarity 0."""
    names = terms.select("term").distinct()
    n = names.limit(MAX_LEAVES + 1).count()
    if n > MAX_LEAVES:
        raise ValueError(f"choose at most {MAX_LEAVES} terms before clustering")
    rows = names.select(F.lit(0).alias("k"), F.col("term").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("s"))
    rows = rows.unionByName(pairs.select(F.lit(0).alias("k"), F.col("term_a").alias("a"), F.col("term_b").alias("b"), F.col("kappa").alias("s")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = sorted(pdf.loc[pdf["b"].isna(), "a"])
        at = {t: i for i, t in enumerate(leaves)}
        dist = np.ones((len(leaves), len(leaves)))
        for a, b, s in pdf.dropna(subset=["b"])[["a", "b", "s"]].itertuples(index=False):
            if a in at and b in at:
                dist[at[a], at[b]] = dist[at[b], at[a]] = 1 - s
        merges = average_linkage(dist)
        place = {leaf: i for i, leaf in enumerate(leaf_order(merges, len(leaves)))}
        return pd.DataFrame({"term": leaves, "cluster": cut_tree(merges, len(leaves), 1 - similarity), "leaf_order": [place[i] for i in range(len(leaves))]})

    return rows.groupBy("k").applyInPandas(run, "term string, cluster int, leaf_order int")


def linked_groups(pairs: list[tuple[str, str, float]], similarity: float) -> dict[str, str]:
    """The first name of its group for each name: average linkage of listed pairs (others have similarity 0), merged while the mean is at least `similarity`.

    Only sums of listed similarities are held, so the work follows the pairs. Ties join the smaller names, as in average_linkage.
    """
    near: dict[str, dict[str, float]] = {}
    for a, b, s in pairs:
        near.setdefault(a, {})[b] = s
        near.setdefault(b, {})[a] = s
    size, first = dict.fromkeys(near, 1), {x: x for x in near}
    heap = [(-s, *sorted((a, b))) for a, b, s in pairs if s >= similarity - 1e-12]
    heapq.heapify(heap)
    while heap:
        s, a, b = heapq.heappop(heap)
        if a not in near or b not in near[a] or -s != near[a][b] / (size[a] * size[b]):
            continue  # one of the two has grown or gone since
        for x, t in near.pop(b).items():
            del near[x][b]
            if x != a:
                near[a][x] = near[x][a] = near[a].get(x, 0.0) + t
        size[a] += size.pop(b)
        first[b] = a
        for x, t in near[a].items():
            if (mean := t / (size[a] * size[x])) >= similarity - 1e-12:
                heapq.heappush(heap, (-mean, *sorted((a, x))))
    for x in sorted(first):  # a group's first name is smaller than the others, so it is settled before them
        first[x] = first[first[x]]
    return first


def similar_groups(annotation: DataFrame, terms: DataFrame, similarity: float = 0.3) -> DataFrame:
    """group_terms over the kappa of all pairs of the terms, of which only those inside a component are made."""
    ann = cut(annotation.join(terms.select("term").distinct(), "term", "left_semi"))
    near = similar_terms(ann, terms, similarity - 1e-12)
    comp = cut(components(cut(near.select(F.col("term_a").alias("a"), F.col("term_b").alias("b"), F.col("kappa").alias("score")))))
    return group_terms(terms, term_kappa(ann, terms, comp.withColumnRenamed("node", "term")), similarity, comp)


def group_terms(terms: DataFrame, pairs: DataFrame, similarity: float = 0.3, comp: DataFrame | None = None) -> DataFrame:
    """(term, cluster): the groups of cluster_terms for any number of terms; cluster is the group's first term.

    Two groups merge only if their mean similarity reaches the cut, so some pair between them does: each connected component of such pairs is
    linked for itself, over all its listed pairs, and a task holds the pairs of one component. similarity must be above 0. comp: the components
    (node, component), where they are known.
    """
    pairs = pairs.select(F.col("term_a").alias("a"), F.col("term_b").alias("b"), F.col("kappa").alias("score"))
    comp = cut(components(pairs.filter(F.col("score") >= similarity - 1e-12))) if comp is None else comp
    ends = [comp.select(F.col("node").alias(x), F.col("component").alias(c)) for x, c in (("a", "component"), ("b", "other"))]
    inside = pairs.join(ends[0], "a").join(ends[1], "b").filter("component = other").select("component", "a", "b", "score")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = linked_groups(list(pdf[["a", "b", "score"]].itertuples(index=False, name=None)), similarity)
        return pd.DataFrame({"term": list(first), "cluster": list(first.values())}, columns=["term", "cluster"])

    linked = inside.groupBy("component").applyInPandas(run, "term string, cluster string")
    return terms.select("term").distinct().join(linked, "term", "left").select("term", F.coalesce("cluster", "term").alias("cluster"))


def cluster_heads(results: DataFrame, clusters: DataFrame) -> DataFrame:
    """results with cluster renumbered by best logp, and flags for the first row by logp and the best values per cluster."""
    met = results.join(clusters.select("term", "cluster"), "term")
    order = [F.col("logp").asc(), F.col("enrichment").desc(), F.col("term").asc()]
    best = met.groupBy("cluster").agg(F.min(F.struct("logp", (-F.col("enrichment")).alias("e"), "term")).alias("m"), F.max("enrichment").alias("best_enrichment"))
    ranked = ordered_prefix(best, [], ["m"]).select(F.col("cluster").alias("_c"), "best_enrichment", (F.col("before") + 1).cast("int").alias("group_id"))
    first = F.row_number().over(W.partitionBy("cluster").orderBy(*order))
    return met.join(maybe_broadcast(ranked), F.col("cluster") == F.col("_c")).withColumn("first_in_group", (first == 1).cast("int")).drop("_c", "cluster")


def representatives(results: DataFrame, per_cluster: int, max_clusters: int) -> DataFrame:
    """The best rows of the best clusters."""
    w = W.partitionBy("group_id").orderBy("logp", F.desc("enrichment"), "term")
    return results.filter(F.col("group_id") <= max_clusters).withColumn("in_group", F.row_number().over(w)).filter(F.col("in_group") <= per_cluster)
