"""Questions about a term catalogue and its test results: sizes, choices, patterns of lists, re-tests, evidence, specificity, networks of terms.

annotation: (term, item), lists: (list, item), results: (list, term, logp, enrichment, ...). Nulls name nothing and repeated pairs count once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.operators.enrichment import catalogue, clean_pairs, test_columns
from lattica.operators.statistics import weighted_gini
from lattica.session import cut, maybe_broadcast

#: Ones among the bits of a byte.
ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def terms_per_item(annotation: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(item, n_terms), over the given terms only if there are any given."""
    ann = clean_pairs(annotation, "term", "item")
    ann = ann if terms is None else ann.join(terms.select("term").dropna().distinct(), "term", "left_semi")
    return ann.groupBy("item").agg(F.count("term").alias("n_terms"))


def items_per_term(annotation: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(term, n_items), over the given items only if there are any given."""
    ann = clean_pairs(annotation, "term", "item")
    ann = ann if items is None else ann.join(items.select("item").dropna().distinct(), "item", "left_semi")
    return ann.groupBy("term").agg(F.count("item").alias("n_items"))


def items_of(annotation: DataFrame, terms: DataFrame) -> DataFrame:
    """(item): what is in any of the terms."""
    return clean_pairs(annotation, "term", "item").join(terms.select("term").dropna().distinct(), "term", "left_semi").select("item").distinct()


def items_in(lists: DataFrame, annotation: DataFrame, terms: DataFrame) -> DataFrame:
    """(list, item): the items of each list that are in any of the terms."""
    return clean_pairs(lists, "list", "item").join(items_of(annotation, terms), "item", "left_semi").select("list", "item")


def categories(terms: DataFrame, category: str, prefix: str = "") -> DataFrame:
    """(category, n_terms): categories of a term table that begin with prefix and hold a term."""
    kept = terms.select(F.col(category).alias("category"), "term").dropna().distinct()
    return kept.filter(F.col("category").startswith(prefix)).groupBy("category").agg(F.count("term").alias("n_terms"))


def category_split(df: DataFrame, category: str, special: Sequence) -> DataFrame:
    """df with part: 'special' for rows of these categories, 'standard' for all others, null categories among them."""
    return df.withColumn("part", F.when(F.coalesce(F.col(category).isin(list(special)), F.lit(False)), "special").otherwise("standard"))


def named_like(terms: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """Terms whose text holds every word, in any case."""
    kept = terms
    for w in words:
        kept = kept.filter(F.lower(text).contains(w.lower()))
    return kept


def random_terms(terms: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n distinct terms, those with the smallest hash: the same choice whatever the partitions."""
    return terms.select("term").dropna().distinct().orderBy(F.xxhash64("term", F.lit(seed)), "term").limit(n)


def background(lists: DataFrame, extra: DataFrame) -> DataFrame:
    """(item): a background that also holds every hit."""
    return extra.select("item").unionByName(lists.select("item")).dropna().distinct()


def list_pattern(results: DataFrame) -> DataFrame:
    """(term, pattern, n_lists, logp, enrichment, z_score): the lists that found a term, in name order, and its best values."""
    return results.groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("list")), "|").alias("pattern"), F.count_distinct("list").alias("n_lists"), F.min("logp").alias("logp"), F.max("enrichment").alias("enrichment"), F.max("z_score").alias("z_score"))


def merge_retested(lists: DataFrame, annotation: DataFrame, results: DataFrame, p_cutoff: float = 0.5, max_size: int = 800) -> DataFrame:
    """(term, pattern, n_lists, logp, enrichment, z_score, merged): terms of several lists are tested again on the union of these lists.

    The merged row is kept (merged true) if it passes p_cutoff and is at least as good as the best list; else the best values of the lists
    stand. Lists that share a pattern are united once, however many terms have it.
    """
    cat = cut(catalogue(annotation, max_size))
    held = clean_pairs(lists, "list", "item").join(cat.select("item").distinct(), "item", "left_semi")
    total = cat.select("item").distinct().count()
    told = cut(list_pattern(results))
    many = told.filter("n_lists > 1").select("term", "pattern")
    found_in = held.groupBy("item").agg(F.collect_set("list").alias("lists"))
    met = many.join(cat, "term").join(found_in, "item").filter(F.arrays_overlap(F.split("pattern", r"\|"), "lists"))
    hits = met.groupBy("term", "pattern", "n_term").agg(F.count("item").alias("n_overlap"))
    sizes = cut(united_sizes(held, many.select("pattern").distinct()))
    again = test_columns(hits.join(maybe_broadcast(sizes), "pattern").withColumn("n_total", F.lit(total).cast("bigint"))).filter(F.col("logp") <= F.log10(F.lit(p_cutoff)))
    again = again.select(F.col("term").alias("_t"), F.col("logp").alias("_l"), F.col("enrichment").alias("_e"), F.col("z_score").alias("_z"))
    met = told.join(again, F.col("term") == F.col("_t"), "left").withColumn("merged", F.coalesce(F.col("_l") <= F.col("logp"), F.lit(False)))
    best = lambda new, old: F.when(F.col("merged"), F.col(new)).otherwise(F.col(old)).alias(old)
    return met.select("term", "pattern", "n_lists", best("_l", "logp"), best("_e", "enrichment"), best("_z", "z_score"), "merged")


def united_sizes(held: DataFrame, patterns: DataFrame, blocks: int = 16) -> DataFrame:
    """(pattern, n_list): the number of items in any of the lists of each pattern ('a|b'), patterns without an item absent.

    Items are dealt over blocks. A task holds one block as one bit per list and item and unites the bits of a pattern, so no row per pattern and item is made.
    """
    bits = held.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "list", "item")
    asked = patterns.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def count(lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        (row, names), (col, items) = pd.factorize(lists["list"].astype(str)), pd.factorize(lists["item"])
        held = np.zeros((len(names), len(items) // 8 + 1), np.uint8)
        np.bitwise_or.at(held, (row, col >> 3), np.uint8(1) << (col & 7).astype(np.uint8))
        at = {x: i for i, x in enumerate(names)}
        sizes = [int(ONES[np.bitwise_or.reduce(held[[at[x] for x in p.split("|") if x in at]], axis=0)].sum()) for p in asked["pattern"]]
        return pd.DataFrame({"pattern": asked["pattern"], "n": sizes}, columns=["pattern", "n"])

    part = bits.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(count, "pattern string, n bigint")
    return part.groupBy("pattern").agg(F.sum("n").alias("n_list")).filter("n_list > 0")


def with_evidence(lists: DataFrame, annotation: DataFrame, results: DataFrame, min_size: int = 3, max_size: int = 100, max_logp: float = -2.0) -> DataFrame:
    """(list, item): items of a list that are in a term of the gated size which the list found at max_logp or better."""
    good = results.filter(F.col("n_term").between(min_size, max_size) & (F.col("logp") <= max_logp)).select("list", "term").distinct()
    found = good.join(clean_pairs(annotation, "term", "item"), "term").select("list", "item").distinct()
    return clean_pairs(lists, "list", "item").join(found, ["list", "item"], "left_semi").select("list", "item")


def specificity(results: DataFrame) -> DataFrame:
    """(term, gini): Gini index of |log10 p|, at least 1, over all lists that have results; a list without the term counts as 1."""
    n = results.select("list").distinct().count()
    held = results.groupBy("term", "list").agg(F.min("logp").alias("logp")).select("term", F.greatest(F.abs("logp"), F.lit(1.0)).alias("x"))
    absent = held.groupBy("term").agg((F.lit(n) - F.count(F.lit(1))).alias("c")).filter("c > 0").select("term", F.lit(1.0).alias("x"), "c")
    # absent lists are one row with their number: there are as many of them as terms times lists
    freq = held.filter("not isnan(x)").withColumn("c", F.lit(1).cast("bigint")).unionByName(absent).filter("term is not null").groupBy(F.col("term").alias("g"), "x").agg(F.sum("c").alias("c"))
    return weighted_gini(freq).withColumnRenamed("g", "term")


def term_network(pairs: DataFrame, terms: DataFrame, similarity: float = 0.3) -> DataFrame:
    """(a, b, kappa): pairs of the terms at `similarity` or more; a term without one is there as a link to itself."""
    ids = terms.select("term").dropna().distinct()
    kept = pairs.filter(F.col("kappa") >= similarity).select(F.col("term_a").alias("a"), F.col("term_b").alias("b"), "kappa")
    kept = kept.join(ids.withColumnRenamed("term", "a"), "a", "left_semi").join(ids.withColumnRenamed("term", "b"), "b", "left_semi").select("a", "b", "kappa")
    linked = kept.select(F.explode(F.array("a", "b")).alias("term")).distinct()
    alone = ids.join(linked, "term", "left_anti").select(F.col("term").alias("a"), F.col("term").alias("b"), F.lit(1.0).alias("kappa"))
    return kept.unionByName(alone)


def compare_origins(old: DataFrame, new: DataFrame, annotation: DataFrame) -> DataFrame:
    """(term, n_old_only, n_new_only, n_both): a term's hits split by which of two (item) sets they come from; terms without a hit are absent."""
    marks = old.select("item").dropna().distinct().withColumn("o", F.lit(1)).join(new.select("item").dropna().distinct().withColumn("n", F.lit(1)), "item", "full_outer")
    met = clean_pairs(annotation, "term", "item").join(marks, "item")
    return met.groupBy("term").agg(F.count_if(F.col("n").isNull()).alias("n_old_only"), F.count_if(F.col("o").isNull()).alias("n_new_only"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("n_both"))


def items_by_list(lists: DataFrame, annotation: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, list, n_hits): how many items of each list are in each of the terms, pairs without one absent."""
    ann = clean_pairs(annotation, "term", "item").join(terms.select("term").dropna().distinct(), "term", "left_semi")
    return ann.join(clean_pairs(lists, "list", "item"), "item").groupBy("term", "list").agg(F.count("item").alias("n_hits"))


def cluster_scores(annotation: DataFrame, clusters: DataFrame) -> DataFrame:
    """(item, cluster, score): the share of a cluster's terms that an item is in."""
    kept = clusters.select("term", "cluster").dropna().distinct()
    sizes = kept.groupBy("cluster").agg(F.count("term").alias("k"))
    met = clean_pairs(annotation, "term", "item").join(kept, "term").groupBy("item", "cluster").agg(F.count("term").alias("n"))
    return met.join(maybe_broadcast(sizes), "cluster").select("item", "cluster", (F.col("n") / F.col("k")).alias("score"))


def smallest_parents(closure: DataFrame, tops: DataFrame, sizes: DataFrame) -> DataFrame:
    """(term, parent, n): of a term's ancestors in tops (itself included if it is one), the one with the fewest items, then the smaller id.

    closure: (term, ancestor), tops: (term), sizes: (term, n). Terms below none of the tops are absent.
    """
    up = closure.select("term", "ancestor").unionByName(tops.select("term", F.col("term").alias("ancestor"))).dropna().distinct()
    chosen = tops.select(F.col("term").alias("ancestor")).distinct().join(sizes.select(F.col("term").alias("ancestor"), "n"), "ancestor", "left").na.fill(0, ["n"])
    best = F.min(F.struct("n", "ancestor"))
    return up.join(maybe_broadcast(chosen), "ancestor").groupBy("term").agg(best.alias("b")).select("term", F.col("b.ancestor").alias("parent"), F.col("b.n").alias("n"))


def round_robin(df: DataFrame, group: str, order: Sequence[Column], n_groups_name: str = "place") -> DataFrame:
    """df with `place`: rows are dealt one per group and round, groups in order of their name; place = round * groups + group number."""
    groups = df.select(F.col(group).alias("_g")).distinct()
    width = groups.count()
    numbered = groups.withColumn("_i", F.dense_rank().over(W.orderBy("_g")) - 1)  # one row per group
    dealt = df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1)
    return dealt.join(maybe_broadcast(numbered), F.col(group).eqNullSafe(F.col("_g"))).withColumn(n_groups_name, F.col("_r") * width + F.col("_i")).drop("_g", "_i", "_r")


def sampled_members(results: DataFrame, max_nodes: int, max_members: int, max_clusters: int) -> DataFrame:
    """Rows of results (group_id, term, logp, enrichment) with `tier`: the k-th best term of each cluster is tier k; whole tiers are taken until
    max_nodes rows, the first in any case."""
    w = W.partitionBy("group_id").orderBy("logp", F.desc("enrichment"), "term")
    tiers = results.filter(F.col("group_id") <= max_clusters).withColumn("tier", F.row_number().over(w)).filter(F.col("tier") <= max_members)
    sizes = tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))  # at most max_members rows
    upto = sizes.withColumn("s", F.sum("n").over(W.orderBy("tier").rowsBetween(W.unboundedPreceding, 0))).filter((F.col("s") <= max_nodes) | (F.col("tier") == 1))
    return tiers.join(F.broadcast(upto.select("tier")), "tier", "left_semi")
