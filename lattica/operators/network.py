"""Weighted undirected networks as edge tables (a, b, kind, score) with a <= b.

Edges with a null end are dropped; an edge reported several times keeps its highest score, 'Direct' before 'Indirect'. A node without
edges exists only through a self loop. Iterations are cut in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions.numeric import enrichment_z, hypergeometric_tail, log10_p
from lattica.operators.enrichment import adjust
from lattica.operators.ranks import ordered_prefix
from lattica.session import cut, maybe_broadcast

MIN_CLUSTER = 3
#: A side with a row per node is broadcast only while it has at most this many rows.
SIDE_ROWS = 100_000


def _side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a side of a join: broadcast where its counted rows are few, else joined by sorting.

    Left to itself, Spark goes by the bytes of the files that `cut` wrote, and the driver then builds tables many times as large.
    """
    return df.hint("merge") if rows is None or rows > SIDE_ROWS else F.broadcast(df)


def canonical(df: DataFrame, a: Column, b: Column, score: Column, kind: Column | None = None) -> DataFrame:
    """Edges in canonical order, one per pair. The highest score wins inside the better kind."""
    kind = F.lit("Direct") if kind is None else kind
    flat = df.select(a.alias("x"), b.alias("y"), kind.alias("kind"), score.alias("score")).filter("x is not null and y is not null")
    best = F.max(F.struct((F.col("kind") == "Direct").alias("direct"), F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("score"), "kind"))
    return flat.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(best.alias("e")).select("a", "b", "e.kind", "e.score")


def combine(*networks: DataFrame) -> DataFrame:
    """Union of networks, one edge per pair."""
    both = networks[0]
    for n in networks[1:]:
        both = both.unionByName(n)
    return canonical(both, F.col("a"), F.col("b"), F.col("score"), F.col("kind"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, score) in both directions without self loops."""
    sides = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.filter("a <> b").select(F.explode(sides).alias("s"), "score").select("s.u", "s.v", "score")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def density(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, density): self loops are no edges; density is edges / nodes^2."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().count()
    return edges.agg(F.lit(nodes).cast("bigint").alias("n_nodes"), F.count_if(F.col("a") != F.col("b")).alias("n_edges")).withColumn("density", F.try_divide(F.col("n_edges").cast("double"), F.col("n_nodes").cast("double") * F.col("n_nodes")))


def subnetwork(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node); two semi joins, broadcast while the node list is small."""
    ids = maybe_broadcast(nodes.select("node").dropna().distinct())
    return edges.join(ids.withColumnRenamed("node", "a"), "a", "left_semi").join(ids.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b", "kind", "score")


def hops(edges: DataFrame, start: DataFrame, max_hops: int) -> DataFrame:
    """(node, distance) within max_hops of the start nodes: a frontier join per hop."""
    links = cut(both_ways(edges).select("u", "v"))
    seen = cut(start.select("node").dropna().distinct().withColumn("distance", F.lit(0)))
    front = seen
    for d in range(1, max_hops + 1):
        step = links.join(maybe_broadcast(front.select(F.col("node").alias("u"))), "u", "left_semi").select(F.col("v").alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    return seen


def connecting(edges: DataFrame, start: DataFrame, end: DataFrame, max_hops: int) -> DataFrame:
    """(node): nodes on a walk of at most max_hops from start to end."""
    near, far = hops(edges, start, max_hops), hops(edges, end, max_hops)
    return near.join(far.withColumnRenamed("distance", "rest"), "node").filter(F.col("distance") + F.col("rest") <= max_hops).select("node")


def indirect_edges(edges: DataFrame, start: DataFrame, end: DataFrame, cells: int = 3_000_000) -> DataFrame:
    """Two-hop links between start and end that have no direct edge, with the weaker score of the best middle node.

    A hub joins all pairs of its neighbours, so pairs are not shuffled: start nodes are dealt over blocks, and a task holds the best scores of one block
    against all ends, at most about `cells` of them, over which the middle nodes are put one after the other.
    """
    links, kind = cut(both_ways(edges)), dict(edges.dtypes)["a"]
    s, e = cut(start.select(F.col("node").cast(kind).alias("u")).dropna().distinct()), cut(end.select(F.col("node").cast(kind).alias("u")).dropna().distinct())
    blocks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-s.count() * e.count() // cells))
    both = maybe_broadcast(s.withColumn("s", F.lit(True)).join(e.withColumn("e", F.lit(True)), "u", "full_outer").na.fill(False))
    met = links.join(both, "u")
    left = cut(met.filter("s").select(F.pmod(F.xxhash64("u"), F.lit(blocks)).alias("block"), "u", "v", "score", F.col("e").alias("both")))
    right = met.filter("e").select(F.col("u").alias("v2"), "v", "score", F.col("s").alias("both"))
    right = cut(left.select("block", "v").distinct().join(right, "v").select("block", "v2", "v", "score", "both"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (at, us), (to, vs) = pd.factorize(left["u"]), pd.factorize(right["v2"])
        top = np.full((len(us), len(vs)), -np.inf)
        mids = {v: i for v, i in right.groupby("v", sort=False).indices.items()}
        ls, rs = left["score"].to_numpy(), right["score"].to_numpy()
        for v, i in left.groupby("v", sort=False).indices.items():
            if (j := mids.get(v)) is not None:
                cell = np.ix_(at[i], to[j])
                top[cell] = np.maximum(top[cell], np.minimum.outer(ls[i], rs[j]))
        col = pd.Index(vs)
        for nodes, row in ((left["v"], at), (us, np.arange(len(us)))):  # direct neighbours and the node itself
            c = col.get_indexer(pd.Index(nodes))
            top[row[c >= 0], c[c >= 0]] = -np.inf
        r, c = np.nonzero(top > -np.inf)
        x, y = np.asarray(us)[r], np.asarray(vs)[c]
        # a pair of nodes that are both in both sets is found from either side
        twice = left.groupby("u", sort=False)["both"].first().reindex(us).to_numpy(bool)[r] & right.groupby("v2", sort=False)["both"].first().reindex(vs).to_numpy(bool)[c] & (x > y)
        x, y, score = x[~twice], y[~twice], top[r, c][~twice]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "score": score})

    two = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(best, f"a {kind}, b {kind}, score double")
    return two.select("a", "b", F.lit("Indirect").alias("kind"), "score")


def shortest_paths(edges: DataFrame, source: str | int, target: str | int, max_hops: int) -> DataFrame:
    """(path): all shortest paths of at most max_hops, each an array of nodes; an empty frame if there is none."""
    links, spark = both_ways(edges).select("u", "v"), edges.sparkSession
    kind = dict(edges.dtypes)["a"]
    seed = lambda x: spark.range(1).select(F.lit(x).cast(kind).alias("node"))
    to = hops(edges, seed(target), max_hops).select(F.col("node").alias("v"), F.col("distance").alias("left"))
    paths = seed(source).select(F.array("node").alias("path"), F.col("node").alias("u")).join(to.withColumnRenamed("v", "u"), "u")
    n = paths.select("left").first()
    paths = paths.select("path", "u", "left")
    for _ in range(n[0] if n else 0):
        paths = cut(paths.join(links, "u").join(to.withColumnRenamed("left", "next"), "v").filter("next = left - 1").select(F.concat("path", F.array("v")).alias("path"), F.col("v").alias("u"), F.col("next").alias("left")))
    return paths.select("path")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component; labels travel along edges and jump through their own label."""
    links = cut(both_ways(edges).select("u", "v"))
    label = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    n = label.count()
    while True:
        sent = links.join(_side(label.withColumnRenamed("node", "u"), n), "u").groupBy(F.col("v").alias("node")).agg(F.min("component").alias("sent"))
        near = cut(label.join(_side(sent), "node", "left").select("node", F.least("component", "sent").alias("new"), F.col("component").alias("old")))
        up = near.select(F.col("node").alias("new"), F.col("new").alias("upper"))
        jumped = cut(near.join(_side(up, n), "new", "left").select("node", F.least("new", "upper").alias("component"), "old"))
        moved = jumped.filter("component <> old").limit(1).count()
        label = jumped.select("node", "component")
        if not moved:
            return label


def core(edges: DataFrame, k: int) -> DataFrame:
    """Edges of the k-core: nodes with fewer than k neighbours are peeled until none is left."""
    kept = cut(edges.filter("a <> b"))
    n = kept.count()
    while n:
        ok = degrees(kept).filter(F.col("degree") >= k).select("node")
        kept = cut(kept.join(ok.withColumnRenamed("node", "a"), "a", "left_semi").join(ok.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b", "kind", "score"))
        now = kept.count()
        if now == n:
            break
        n = now
    return kept


def over_connected(edges: DataFrame, chosen: DataFrame, min_links: int = 3, p_cutoff: float = 0.01, min_enrichment: float = 2.0) -> DataFrame:
    """(node, links, degree, enrichment, z_score, logp, q_log10): nodes with more links into the chosen set than chance gives."""
    links = both_ways(edges).select("u", "v")
    ids = maybe_broadcast(chosen.select(F.col("node").alias("v")).dropna().distinct())
    per = links.groupBy("u").agg(F.count("v").alias("degree"))
    into = links.join(ids, "v", "left_semi").groupBy("u").agg(F.count("v").alias("links"))
    present = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    n_all, n_set = present.count(), present.join(ids, "v", "left_semi").count()
    met = into.filter(F.col("links") >= min_links).join(per, "u")
    x, d, n, m = F.col("links"), F.col("degree"), F.lit(n_all).cast("bigint"), F.lit(n_set).cast("bigint")
    told = met.withColumns({"enrichment": (x / m) / (d / n), "z_score": enrichment_z(x, n, d, m), "logp": log10_p(hypergeometric_tail(x, n, d, m))})
    kept = told.filter((F.col("enrichment") > min_enrichment) & (F.col("logp") <= F.log10(F.lit(p_cutoff))))
    candidates = into.filter(F.col("links") >= min_links).count()
    return adjust(kept.withColumn("n_tests", F.lit(candidates).cast("bigint")), "logp", "n_tests").select(F.col("u").alias("node"), "links", "degree", "enrichment", "z_score", "logp", F.col("bh_log10").alias("q_log10"))


def propagate(edges: DataFrame, prior: DataFrame, alpha: float = 0.5, tolerance: float = 1e-6, max_rounds: int | None = None) -> DataFrame:
    """(node, score): F = alpha W F + (1 - alpha) Y with W = w / sqrt(d_i d_j), until the total change is below tolerance."""
    links = both_ways(edges).filter("score > 0")
    deg = links.groupBy("u").agg(F.sum("score").alias("d"))
    w = links.join(deg, "u").join(deg.select(F.col("u").alias("v"), F.col("d").alias("d2")), "v").select("u", "v", (F.col("score") / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))
    w = cut(w)
    start = prior.groupBy("node").agg(F.sum("score").alias("y"))
    state = cut(deg.select(F.col("u").alias("node")).join(start, "node", "left").select("node", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("y", F.lit(0.0)).alias("f")))
    for _ in count() if max_rounds is None else range(max_rounds):  # alpha below 1 shrinks the change from round to round
        flow = w.join(state.select(F.col("node").alias("u"), "f"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("w") * F.col("f")).alias("in"))
        new = cut(state.join(flow, "node", "left").select("node", "y", (alpha * F.coalesce("in", F.lit(0.0)) + (1 - alpha) * F.col("y")).alias("g"), "f"))
        change = new.agg(F.sum(F.abs(F.col("g") - F.col("f")))).first()[0] or 0.0
        state = new.select("node", "y", F.col("g").alias("f"))
        if change < tolerance:
            break
    return state.select("node", F.col("f").alias("score"))


def list_edges(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """(list, a, b, score): the edges among the items of each list (list, item), all lists in one join."""
    held = lists.select("list", "item").dropna().distinct()
    one = edges.select("a", "b", "score").join(held.withColumnRenamed("item", "a"), "a")
    return one.join(held.withColumnRenamed("item", "b"), ["list", "b"]).select("list", "a", "b", "score")


def list_neighbours(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """(list, node, links): neighbours of each list's items that are not in the list, with the number of its items they link to."""
    held = lists.select("list", F.col("item").alias("u")).dropna().distinct()
    near = both_ways(edges).select("u", "v").join(held, "u").groupBy("list", F.col("v").alias("node")).agg(F.count_distinct("u").alias("links"))
    return near.join(held.withColumnRenamed("u", "node"), ["list", "node"], "left_anti")


def with_singletons(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): the edges among the nodes, and a self loop for each node without one."""
    ids = nodes.select("node").dropna().distinct()
    inside = subnetwork(edges, nodes).select("a", "b").distinct()
    linked = inside.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return inside.unionByName(ids.join(linked, "node", "left_anti").select(F.col("node").alias("a"), F.col("node").alias("b")))


def without_nodes(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges without the nodes, (node) of neighbours that are left without any edge)."""
    gone = nodes.select("node").dropna().distinct()
    left = edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
    before = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(gone, "node", "left_anti")
    return left, before.join(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_anti")


def of_kinds(edges: DataFrame, without: tuple[str, ...] = ("Indirect", "ppp")) -> DataFrame:
    """Edges whose kind is none of `without`; a null kind stays."""
    return edges.filter(F.col("kind").isNull() | ~F.col("kind").isin(list(without)))


def edge_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(a, b, evidence): the smaller evidence (node, value) of both ends; an end without any counts as 0."""
    e = evidence.filter("node is not null").groupBy("node").agg(F.max("value").alias("value"))
    one, two = (e.select(F.col("node").alias(x), F.col("value").alias(f"_{x}")) for x in "ab")
    met = edges.select("a", "b").distinct().join(one, "a", "left").join(two, "b", "left")
    return met.select("a", "b", F.least(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))).alias("evidence"))


def component_sizes(edges: DataFrame) -> DataFrame:
    """(component, n_nodes, n_edges, place): components by nodes, then edges, largest first, then the smaller name."""
    comp = components(edges)
    nodes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    links = edges.filter("a <> b").select("a", "b").distinct().join(comp.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    told = cut(nodes.join(links, "component", "left").na.fill(0, ["n_edges"]).select("component", "n_nodes", "n_edges", (-F.col("n_nodes")).alias("_n"), (-F.col("n_edges")).alias("_e")))
    return ordered_prefix(told, [], ["_n", "_e", "component"], name="place").withColumn("place", F.col("place") + 1).drop("_n", "_e")


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, degree, id) and (u, v): nodes as text with numbers in the order of (degree, node), and the links between those numbers, u < v."""
    plain = cut(edges.filter("a <> b").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    deg = plain.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    nodes = cut(ordered_prefix(cut(deg), [], ["degree", "node"], name="id").select("node", "degree", F.col("id").cast("int").alias("id")))
    n = nodes.count()
    ia, ib = (_side(nodes.select(F.col("node").alias(x), F.col("id").alias(f"i{x}")), n) for x in ("a", "b"))
    return nodes, cut(plain.join(ia, "a").join(ib, "b").select(F.least("ia", "ib").alias("u"), F.greatest("ia", "ib").alias("v")))


def node_scores(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, node, score, density, degree) from `numbered`: each node from the edges of its closed neighbourhood, found as triangles.

    Links go from the lower degree to the higher, so a hub has a short list of its own, and lists are met per link; pairs of a list are never rows. A task gets
    the links that face its nodes as numbers, in the order of the nodes, and holds those of a few nodes, or of one hub, at a time.
    """
    to = cut(links.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("vs")))
    steps = to.select("u", F.posexplode("vs").alias("i", "v"), "vs").select("u", "v", F.expr("slice(vs, i + 2, size(vs))").alias("rest")).filter(F.size("rest") > 0)
    closed = steps.join(_side(to.select(F.col("u").alias("v"), "vs")), "v").select("u", "v", F.explode(F.array_intersect("rest", "vs")).alias("z"))
    corners = F.array(*[F.struct(F.col(n).alias("id"), F.col(p).alias("p"), F.col(q).alias("q")) for n, p, q in (("u", "v", "z"), ("v", "u", "z"), ("z", "u", "v"))])
    facing = closed.select(F.explode(corners).alias("c")).select("c.*").repartition("id").sortWithinPartitions("id")

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, p, q in _whole_groups(batches):
            owner = np.concatenate(([0], np.cumsum(at[1:] != at[:-1], dtype="i4")), dtype="i4")
            level, size, inside = _highest_cores(owner, p, q)
            columns = (at[np.searchsorted(owner, np.arange(len(level)))], np.bincount(owner), level, size, inside)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, ("i4", *["i8"] * 4), strict=True)], ["id", "facing", "level", "size", "inside"])

    core = facing.mapInArrow(cores, "id int, facing long, level long, size long, inside long")
    told = nodes.join(_side(core), "id", "left").withColumns({"facing": F.coalesce("facing", F.lit(0)), "level": F.coalesce("level", F.lit(0))})
    # the node itself is linked to all of them, and a node without triangles is the middle of a star
    size, inside = F.coalesce("size", "degree"), F.coalesce("inside", F.lit(0))
    score = F.when(F.col("degree") <= 2, 0.0).otherwise(((F.col("level") + 1) * (inside + size)).cast("double") / ((size + 1) * (size + 1)))
    density = (F.col("degree") + F.col("facing")).cast("double") / ((F.col("degree") + 1) * (F.col("degree") + 1))
    return cut(told.select("id", "node", score.alias("score"), density.alias("density"), "degree"))


def dense_clusters(edges: DataFrame, min_nodes: int = MIN_CLUSTER, max_nodes: int | None = None, score_cut: float = 0.2) -> DataFrame:
    """(component, cluster, node, seed, cluster_score, node_score) by seeded growth in components of at least min_nodes, and of at most max_nodes if given.

    Nodes are scored over all cores. The nodes of a cluster have scores above 0 that differ by at most the share `score_cut`, so no other links are met, and each
    connected part of those links is grown for itself, as numbers. Seeds go by (score desc, density desc, neighbours desc, node asc), which makes the result unique.
    """
    comp = components(edges)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_nodes)
    sizes = sizes if max_nodes is None else sizes.filter(F.col("n") <= max_nodes)
    sizes = cut(sizes.select("component"))
    kept = comp.join(_side(sizes, sizes.count()), "component", "left_semi").select("component", F.col("node").cast("string").alias("node"))
    nodes, links = numbered(edges)
    facts = cut(node_scores(nodes, links).filter("score > 0").join(_side(kept), "node"))
    n = facts.count()
    su, sv = (_side(facts.select(F.col("id").alias(x), F.col("score").alias(f"s{x}")), n) for x in "uv")
    live = cut(links.join(su, "u").join(sv, "v").filter(F.least("su", "sv") >= F.greatest("su", "sv") * F.lit(1 - score_cut)).select("u", "v"))
    part = components(live.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("score")))
    block = F.pmod(F.xxhash64("component"), F.lit(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    place = cut(part.select(F.col("node").alias("id"), block.alias("block")))
    left = facts.join(_side(place), "id")
    right = live.join(_side(place.select(F.col("id").alias("u"), F.col("block").alias("at")), n), "u").select("at", "u", "v")

    def grow(known: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values(["score", "density", "degree", "node"], ascending=[False, False, False, True], ignore_index=True)
        at = pd.Series(np.arange(len(known)), known["id"])
        found = list(_grow_numbers(at.reindex(links["u"]).to_numpy(), at.reindex(links["v"]).to_numpy(), known["score"].to_numpy(), score_cut))
        rows = np.concatenate([np.zeros(0, int), *[members for _, _, members in found]])
        count = [len(members) for _, _, members in found]
        seeds, scores = np.array([s for s, _, _ in found], int), np.array([c for _, c, _ in found], float)
        out = known.iloc[rows][["component", "node"]].reset_index(drop=True)
        return out.assign(seed=known["node"].to_numpy()[np.repeat(seeds, count)], cluster_score=np.repeat(scores, count), node_score=known["score"].to_numpy()[rows])

    kind = dict(comp.dtypes)["component"]
    found = left.groupBy("block").cogroup(right.groupBy("at")).applyInPandas(grow, f"component {kind}, node string, seed string, cluster_score double, node_score double")
    number = F.dense_rank().over(W.partitionBy("component").orderBy(F.desc("cluster_score"), "seed"))
    return found.select("component", number.alias("cluster"), "node", "seed", "cluster_score", "node_score")


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 300_000) -> Iterator[tuple[np.ndarray, ...]]:
    """The three columns of sorted batches in pieces of at least so many rows that end where the first column changes."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(cols[0]):
            continue
        if n >= least and (i := np.searchsorted(cols[0], held[-1][0][-1], "right")) < len(cols[0]):
            yield tuple(map(np.concatenate, zip(*held, tuple(c[:i] for c in cols), strict=True)))
            held, n, cols = [], 0, tuple(c[i:].copy() for c in cols)
        held.append(cols)
        n += len(cols[0])
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _neighbours(p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, to): the neighbours of node i are to[start[i]:start[i + 1]]."""
    start = np.concatenate(([0], np.cumsum(np.bincount(p, minlength=n) + np.bincount(q, minlength=n))))
    ends = np.empty(2 * len(p), "i8")  # (node, neighbour) as one number, put in order where they are
    for half, x, y in ((ends[: len(p)], p, q), (ends[len(p) :], q, p)):
        half[:] = x
        half <<= 32
        half |= y
    ends.sort()
    ends &= 0xFFFFFFFF
    return start, ends.astype("i4")


def _near(start: np.ndarray, to: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The neighbours of all nodes, one after the other."""
    count = start[nodes + 1] - start[nodes]
    at = np.repeat(start[nodes] - (np.cumsum(count) - count), count)
    at += np.arange(len(at))
    return to[at]


def _highest_cores(owner: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, nodes, edges) of the highest core of each graph; edge i joins p[i] and q[i] in graph owner[i]. All graphs are peeled together."""
    n_graphs, ids = int(owner[-1]) + 1, np.zeros(int(max(p.max(), q.max())) + 1, bool)
    ids[p] = ids[q] = True
    small = np.cumsum(ids, dtype="i4") - 1
    p, q, width = small[p], small[q], int(small[-1]) + 1
    if n_graphs == 1:
        of = np.zeros(width, "i4")
    else:
        known, at = np.unique(np.concatenate((owner.astype("i8") * width + p, owner.astype("i8") * width + q)), return_inverse=True)
        of, p, q = known // width, at[: len(p)], at[len(p) :]
    start, to = _neighbours(p, q, len(of))
    degree, alive, left = np.diff(start), np.ones(len(of), bool), np.arange(len(of))
    level, size, edges = (np.zeros(n_graphs, int) for _ in range(3))
    k = 0
    while len(left):
        n, e = np.bincount(of[left], minlength=n_graphs), np.bincount(of[left], degree[left], n_graphs)
        level[n > 0], size[n > 0], edges[n > 0] = k, n[n > 0], e[n > 0] / 2
        k += 1
        low = left[degree[left] < k]
        if len(low) == len(left):
            break
        while len(low):
            alive[low] = False
            near = _near(start, to, low)
            near = near[alive[near]]
            np.subtract.at(degree, near, 1)
            low = np.unique(near[degree[near] < k])
        left = left[alive[left]]
    return level, size, edges


def _grow_numbers(p: np.ndarray, q: np.ndarray, score: np.ndarray, score_cut: float) -> Iterator[tuple[int, float, np.ndarray]]:
    """(seed, cluster score, members) as `_grow`; nodes are numbered in the order in which they may be seeds."""
    start, to = _neighbours(p, q, len(score))
    cluster = np.full(len(score), -1)  # the seed whose growth met the node
    for seed in range(len(score)):
        if cluster[seed] >= 0:
            continue
        cluster[seed] = seed
        need, met = score[seed] * (1 - score_cut), [front := np.array([seed])]
        while len(front):
            near = _near(start, to, front)
            front = np.unique(near[(cluster[near] < 0) & (score[near] >= need)])
            cluster[front] = seed
            met.append(front)
        members = np.concatenate(met)
        while len(members):
            count = start[members + 1] - start[members]
            inside = np.bincount(np.repeat(np.arange(len(members)), count), cluster[_near(start, to, members)] == seed, len(members))
            if inside.min() >= 2:
                yield seed, inside.sum() / 2 / len(members), members
                break
            cluster[members[inside < 2]] = len(score)  # peeled, but seen
            members = members[inside >= 2]


def _peel(nodes: set[str], near: dict[str, set[str]], k: int) -> set[str]:
    left = set(nodes)
    while low := {n for n in left if len(near[n] & left) < k}:
        left -= low
    return left


def _node_score(node: str, near: dict[str, set[str]]) -> tuple[float, float]:
    """(score, density): level of the highest core of the closed neighbourhood times that core's density; 0 with at most two neighbours."""
    around = near[node] | {node}
    count = lambda s: sum(len(near[n] & s) for n in s) / 2
    dens = count(around) / len(around) ** 2
    if len(near[node]) <= 2:
        return 0.0, dens
    best, k = around, 0
    while True:
        nxt = _peel(best, near, k + 1)
        if not nxt:
            break
        best, k = nxt, k + 1
    return k * count(best) / len(best) ** 2, dens


def _grow(pairs: Iterator[tuple[str, str]], score_cut: float) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """The rule of dense_clusters over one network in one process, which the operator is held against."""
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = {n: (*_node_score(n, near), len(near[n])) for n in near}
    seen: set[str] = set()
    found = []
    for seed in sorted(near, key=lambda n: (-score[n][0], -score[n][1], -score[n][2], n)):
        if seed in seen or score[seed][0] <= 0:
            continue
        need, members, stack = score[seed][0] * (1 - score_cut), {seed}, [seed]
        while stack:
            for n in sorted(near[stack.pop()] - members - seen):
                if score[n][0] >= need:
                    members.add(n)
                    stack.append(n)
        seen |= members
        trimmed = _peel(members, near, 2)
        if trimmed:
            edges = sum(len(near[n] & trimmed) for n in trimmed) / 2
            found.append((seed, edges / len(trimmed), [(n, score[n][0]) for n in sorted(trimmed)]))
    return sorted(found, key=lambda c: (-c[1], c[0]))
