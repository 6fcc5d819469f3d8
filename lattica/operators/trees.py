"""Binary trees of merges as tables: build, descend, cut at one or two heights, representatives, common ancestors, files.

A tree is (node, left, right, similarity), one row per merge, leaves being nodes without a row. One tree is one study's terms, so a tree's own walk is
done per tree in one task (`applyInPandas` by tree); many trees spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.clustering import average_linkage

TREE = "tree string, node string, left string, right string, similarity double"


class Tree:
    """Walks over the merges of one tree."""

    def __init__(self, rows: list[tuple[str, str, str, float]]) -> None:
        self.kids = {n: (a, b) for n, a, b, _ in rows}
        self.similarity = {n: float(s) for n, _, _, s in rows}
        below = {x for kids in self.kids.values() for x in kids}
        self.tops = [n for n in self.kids if n not in below]
        self.size: dict[str, int] = {}
        for n in self.upward():
            self.size[n] = sum(self.size.get(x, 1) for x in self.kids[n])

    def upward(self) -> list[str]:
        """Merges, children before parents."""
        out, todo = [], list(self.tops)
        while todo:
            n = todo.pop()
            out.append(n)
            todo += [x for x in self.kids[n] if x in self.kids]
        return out[::-1]

    def leaves(self, node: str) -> list[str]:
        out, todo = [], [node]
        while todo:
            n = todo.pop()
            if n in self.kids:
                todo += self.kids[n][::-1]
            else:
                out.append(n)
        return out

    def cut(self, least: float, node: str | None = None) -> list[str]:
        """The highest nodes whose similarity is at least `least`; leaves stand for themselves."""
        out, todo = [], list(self.tops) if node is None else [node]
        while todo:
            n = todo.pop(0)
            if n in self.kids and self.similarity[n] < least:
                todo = [*self.kids[n], *todo]
            else:
                out.append(n)
        return out

    def representative(self, node: str) -> str:
        """The leaf that is reached by going to the larger child; ties go left."""
        while node in self.kids:
            a, b = self.kids[node]
            node = a if self.size.get(a, 1) >= self.size.get(b, 1) else b
        return node

    def representatives(self, n: int) -> list[tuple[str, str, int]]:
        """(leaf, node, leaves below) of n parts, by opening the part of least similarity again and again."""
        parts = list(self.tops)
        while len(parts) < n:
            inner = [p for p in parts if p in self.kids]
            if not inner:
                break
            worst = min(inner, key=lambda p: (self.similarity[p], p))
            at = parts.index(worst)
            parts[at : at + 1] = list(self.kids[worst])
        return [(self.representative(p), p, self.size.get(p, 1)) for p in parts]


def _per_tree(trees: DataFrame, schema: str, rows: Callable[[str, Tree], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        merges = list(pdf[["node", "left", "right", "similarity"]].itertuples(index=False, name=None))
        return pd.DataFrame(rows(pdf["tree"].iloc[0], Tree(merges)), columns=names)

    return trees.groupBy("tree").applyInPandas(run, schema)


def from_distances(distances: DataFrame) -> DataFrame:
    """Trees by average linkage of (tree, a, b, distance), pairs not listed being at the largest distance of their tree.

    similarity is 1 - height / max(largest height, 1), at least 0. A tree's leaves must fit one task.
    """
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = sorted({*pdf["a"], *pdf["b"]})
        at = {x: i for i, x in enumerate(leaves)}
        dist = np.full((len(leaves), len(leaves)), float(pdf["distance"].max()))
        for a, b, d in pdf[["a", "b", "distance"]].itertuples(index=False):
            dist[at[a], at[b]] = dist[at[b], at[a]] = d
        merges = average_linkage(dist)
        top = max([m[2] for m in merges] + [1.0])
        name = lambda x: leaves[x] if x < len(leaves) else f"NODE{x - len(leaves) + 1}X"
        rows = [(pdf["tree"].iloc[0], f"NODE{i + 1}X", name(a), name(b), max(0.0, 1 - h / top)) for i, (a, b, h, _) in enumerate(merges)]
        return pd.DataFrame(rows, columns=["tree", "node", "left", "right", "similarity"])

    return distances.groupBy("tree").applyInPandas(run, TREE)


def nodes_below(trees: DataFrame) -> DataFrame:
    """(tree, node, leaf): every merge with every leaf below it."""
    return _per_tree(trees, "tree string, node string, leaf string", lambda t, x: [(t, n, leaf) for n in x.kids for leaf in x.leaves(n)])


def leaf_counts(trees: DataFrame) -> DataFrame:
    """(tree, node, n_leaves, similarity)."""
    return _per_tree(trees, "tree string, node string, n_leaves bigint, similarity double", lambda t, x: [(t, n, x.size[n], x.similarity[n]) for n in x.kids])


def cut_groups(trees: DataFrame, least: float) -> DataFrame:
    """(tree, leaf, part): leaves with the number of their part in a cut at similarity `least`."""
    return _per_tree(trees, "tree string, leaf string, part int", lambda t, x: [(t, leaf, i) for i, n in enumerate(x.cut(least), 1) for leaf in x.leaves(n)])


def double_cut(trees: DataFrame, loose: float, tight: float) -> DataFrame:
    """(tree, leaf, loose_part, tight_part): parts of a cut at `loose`, and within each the parts of a cut at `tight`, numbered on."""
    def rows(t: str, x: Tree) -> list[tuple]:
        out, k = [], 0
        for i, n in enumerate(x.cut(loose), 1):
            for m in x.cut(tight, n):
                k += 1
                out += [(t, leaf, i, k) for leaf in x.leaves(m)]
        return out

    return _per_tree(trees, "tree string, leaf string, loose_part int, tight_part int", rows)


def representatives(trees: DataFrame, n: int) -> DataFrame:
    """(tree, leaf, node, n_leaves): at most n representative leaves of each tree with the part they stand for."""
    return _per_tree(trees, "tree string, leaf string, node string, n_leaves bigint", lambda t, x: [(t, *r) for r in x.representatives(n)])


def common_ancestor(trees: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree, node): the lowest merge above all of a tree's leaves in leaves (tree, leaf); a tree with unknown leaves only has none."""
    below = nodes_below(trees)
    asked = leaves.select("tree", "leaf").dropna().distinct().join(below.select("tree", "leaf").distinct(), ["tree", "leaf"], "left_semi")
    wanted = asked.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    held = below.join(asked, ["tree", "leaf"]).groupBy("tree", "node").agg(F.count(F.lit(1)).alias("k"))
    size = below.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size"))
    full = held.join(wanted, "tree").filter("k = n").join(size, ["tree", "node"])
    return full.groupBy("tree").agg(F.min(F.struct("size", "node")).alias("b")).select("tree", F.col("b.node").alias("node"))


def as_links(trees: DataFrame) -> DataFrame:
    """(tree, child, parent, similarity): the tree as links, for the hierarchy and network operators."""
    return trees.select("tree", F.explode(F.array("left", "right")).alias("child"), F.col("node").alias("parent"), "similarity")


def read_tree(spark: SparkSession, path: str, tree: str = "tree") -> DataFrame:
    """A tree file: node, left, right and similarity by tabs, without a header."""
    return spark.read.csv(path, sep="\t", schema="node string, left string, right string, similarity double").select(F.lit(tree).alias("tree"), "*")


def write_tree(trees: DataFrame, path: str) -> None:
    trees.select("node", "left", "right", "similarity").write.mode("overwrite").csv(path, sep="\t")
