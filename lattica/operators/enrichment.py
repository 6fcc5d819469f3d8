"""Testing lists of items against annotated terms, in one plan for all lists and terms.

lists: (list, item), annotation: (term, item). Pairs with a null are dropped and repeated ones count once. A list is cut to the
background; lists or terms without items give no rows. No window runs over the whole table in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions.numeric import P_FLOOR, enrichment_z, hypergeometric_tail, log10_p, tail_bounds
from lattica.operators.ranks import ordered_extreme, ordered_prefix
from lattica.session import cut, maybe_broadcast

MAX_TERM = 800


def clean_pairs(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).dropna().distinct()


def catalogue(annotation: DataFrame, max_size: int = MAX_TERM) -> DataFrame:
    """(term, item, n_term) of the terms with 1 to max_size items."""
    ann = clean_pairs(annotation, "term", "item")
    sizes = ann.groupBy("term").agg(F.count("item").alias("n_term")).filter(F.col("n_term") <= max_size)
    return ann.join(maybe_broadcast(sizes), "term")


def enrich(lists: DataFrame, annotation: DataFrame, background: DataFrame | None = None, min_overlap: int = 3, p_cutoff: float = 0.01, min_enrichment: float = 0.0, max_size: int = MAX_TERM) -> DataFrame:
    """(list, term, n_overlap, n_term, n_list, n_total, pct_in_term, pct_sd, enrichment, z_score, logp, q_log10).

    The background is the given (item) or every annotated item. Terms of max_size items are in the catalogue but not tested.
    logp is log10 of the inclusive upper tail; q_log10 is Benjamini-Hochberg over all pairs of the call with the number of terms as N.
    """
    ranked = adjust(tested_pairs(lists, annotation, background, min_overlap, p_cutoff, min_enrichment, max_size), "logp", "n_terms")
    return ranked.select("list", "term", "n_overlap", "n_term", "n_list", "n_total", "pct_in_term", "pct_sd", "enrichment", "z_score", "logp", F.col("bh_log10").alias("q_log10"))


def tested_pairs(lists: DataFrame, annotation: DataFrame, background: DataFrame | None = None, min_overlap: int = 3, p_cutoff: float = 0.01, min_enrichment: float = 0.0, max_size: int = MAX_TERM) -> DataFrame:
    """The rows of `enrich` without q_log10, with n_terms; for questions that need no adjusted p."""
    cat = cut(catalogue(annotation, max_size))
    if background is not None:
        cat = cat.join(background.select("item").distinct(), "item", "left_semi").drop("n_term")
        cat = cat.join(maybe_broadcast(cat.groupBy("term").agg(F.count("item").alias("n_term"))), "term")
    universe = cat.select("item").distinct() if background is None else background.select("item").dropna().distinct()
    held = clean_pairs(lists, "list", "item").join(universe, "item", "left_semi")
    sizes = held.groupBy("list").agg(F.count("item").alias("n_list"))
    n_total, n_terms = universe.count(), cat.select("term").distinct().count()  # two numbers
    both = held.join(cat.filter(F.col("n_term") < max_size), "item").groupBy("list", "term", "n_term").agg(F.count("item").alias("n_overlap"))
    gated = both.filter(F.col("n_overlap") >= min_overlap).join(maybe_broadcast(sizes), "list").withColumns({"n_total": F.lit(n_total).cast("bigint"), "n_terms": F.lit(n_terms).cast("bigint")})
    tested = test_columns(gated)
    # read several times while p values are put in order
    return cut(tested.filter((F.col("logp") <= F.log10(F.lit(p_cutoff))) & (F.col("enrichment") >= min_enrichment)))


def test_columns(df: DataFrame) -> DataFrame:
    """df (n_overlap, n_term, n_list, n_total) with pct_in_term, pct_sd, enrichment, z_score and logp."""
    x, n1, n2, n = (F.col(c) for c in ("n_overlap", "n_term", "n_list", "n_total"))
    share = x / n2
    clamped = F.least(F.greatest(share, 1 / n2), 1 - 1 / n2)
    return df.withColumns({
        "pct_in_term": share * 100, "pct_sd": F.sqrt(clamped * (1 - clamped) / n2) * 100, "enrichment": (x / n2) / (n1 / n),
        "z_score": enrichment_z(x, n, n1, n2), "logp": log10_p(hypergeometric_tail(x, n, n1, n2)),
    })


def adjust(df: DataFrame, logp: str, n_tests: str) -> DataFrame:
    """df with bonferroni_log10, holm_log10 and bh_log10: adjusted log10 p with n_tests tests, of which df holds the reported ones.

    Distinct p values are put in order by ranges over all tasks, with running extremes in two levels; rows look their value up.
    """
    per = cut(df.filter(F.col(logp).isNotNull()).groupBy(F.col(logp).alias("_p"), F.col(n_tests).alias("_t")).agg(F.count(F.lit(1)).alias("_c")))
    ranked = ordered_prefix(per, [], ["_p", "_t"], F.col("_c"), "_before")
    lg = lambda c: F.log10(c.cast("double"))
    told = ranked.withColumn("_bh", F.col("_p") + lg(F.col("_t")) - lg(F.col("_before") + F.col("_c"))).withColumn("_holm", F.col("_p") + lg(F.greatest(F.lit(1), F.col("_t") - F.col("_before"))))
    holm = ordered_extreme(told, F.struct("_p", "_t"), "_holm", "_holm_run", largest=True)
    both = cut(ordered_extreme(holm, F.struct(-F.col("_p"), -F.col("_t")), "_bh", "_bh_run", largest=False).select("_p", "_t", "_holm_run", "_bh_run"))
    cap = lambda c: F.least(F.lit(0.0), c)
    met = df.join(both, F.col(logp).eqNullSafe(F.col("_p")) & (F.col(n_tests) == F.col("_t")), "left")
    return met.withColumns({"bonferroni_log10": cap(F.col(logp) + lg(F.col(n_tests))), "holm_log10": cap(F.col("_holm_run")), "bh_log10": cap(F.col("_bh_run"))}).drop("_p", "_t", "_holm_run", "_bh_run")


def best_per_parent(results: DataFrame, parents: DataFrame) -> DataFrame:
    """(list, parent, term, logp): the best child of each parent in each list; ties go to the smaller term."""
    met = results.join(parents, "term")
    first = W.partitionBy("list", "parent").orderBy("logp", F.desc("enrichment"), "term")
    return met.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("list", "parent", "term", "logp")


def merge_lists(results: DataFrame) -> DataFrame:
    """(term, n_lists, logp, enrichment, z_score): a term's best values over all lists that found it."""
    return results.groupBy("term").agg(F.count_distinct("list").alias("n_lists"), F.min("logp").alias("logp"), F.max("enrichment").alias("enrichment"), F.max("z_score").alias("z_score"))


def membership(lists: DataFrame) -> DataFrame:
    """(item, pattern, n_lists, weighted_rank): 'M' and a bit per list in name order; the weight of a list is 1 / size.

    The lists' order is a literal of one name per list (a catalogue-sized value); items are only grouped.
    """
    pairs = clean_pairs(lists, "list", "item")
    sizes = pairs.groupBy("list").agg(F.count("item").alias("n"))
    order = sizes.withColumn("pos", F.row_number().over(W.orderBy("list")) - 1)
    width = sizes.count()
    placed = pairs.join(maybe_broadcast(order), "list")
    per = placed.groupBy("item").agg(F.collect_set("pos").alias("at"), F.count("list").alias("n_lists"), F.sum(1 / F.col("n")).alias("weighted_rank"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.array_contains("at", i.cast("int")), "1").otherwise("0"))
    return per.select("item", F.concat(F.lit("M"), F.array_join(bits, "")).alias("pattern"), "n_lists", "weighted_rank")


def list_overlaps(lists: DataFrame, universe: int) -> DataFrame:
    """(list_a, list_b, n_a, n_b, n_both, logp) for a < b with a shared item."""
    pairs = clean_pairs(lists, "list", "item")
    sizes = maybe_broadcast(pairs.groupBy("list").agg(F.count("item").alias("n")))
    # an item in many lists meets every pair of its lists; lists are few, so the output bounds the join
    both = pairs.select("item", F.col("list").alias("list_a")).join(pairs.select("item", F.col("list").alias("list_b")), "item").filter("list_a < list_b").groupBy("list_a", "list_b").agg(F.count("item").alias("n_both"))
    told = both.join(sizes.select(F.col("list").alias("list_a"), F.col("n").alias("n_a")), "list_a").join(sizes.select(F.col("list").alias("list_b"), F.col("n").alias("n_b")), "list_b")
    return told.withColumn("logp", log10_p(hypergeometric_tail(F.col("n_both"), F.lit(universe).cast("bigint"), F.col("n_a"), F.col("n_b"))))


def term_kappa(annotation: DataFrame, terms: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(term_a, term_b, shared, kappa, max_share) of chosen terms that share an item; n is the number of their items.

    `terms` may be all terms or a choice; the pairs are as many as share an item. With `within` (term, component) only pairs of one component are made,
    with the values they have among all chosen terms.

    Pairs are not shuffled: terms are numbers dealt over blocks, each block gets the lists of terms of its items, and a task counts the partners of a few
    terms at a time.
    """
    ann = cut(clean_pairs(annotation, "term", "item").join(terms.select("term").distinct(), "term", "left_semi"))
    known = cut(ordered_prefix(ann.groupBy("term").agg(F.count("item").alias("n")), [], ["term"], name="at").select("term", "n", F.col("at").cast("int").alias("at")))
    total = ann.select("item").distinct().count()
    keys = ["item"] if within is None else ["item", "component"]
    side = ann if within is None else ann.join(within.select("term", "component"), "term")
    lists = cut(side.join(known.select("term", "at"), "term").groupBy(*keys).agg(F.sort_array(F.collect_list("at")).alias("held")).filter(F.size("held") > 1).select("held"))
    blocks = int(annotation.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.array_distinct(F.transform(F.expr("slice(held, 1, size(held) - 1)"), lambda x: F.pmod(x, F.lit(blocks))))  # the last has no partner behind it
    dealt = lists.select(F.explode(own).alias("block"), "held").repartitionById(blocks, F.col("block"))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ends, held = None, [np.zeros(1, int)], []
        for batch in batches:
            if batch.num_rows:
                block = batch.column(0)[0].as_py()
                ends.append(ends[-1][-1] + np.cumsum(batch.column(1).value_lengths().to_numpy()))
                held.append(batch.column(1).flatten().to_numpy())
        if held:
            for a, b, shared in _partners(np.concatenate(held), np.concatenate(ends), block, blocks):
                for i in range(0, len(a), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (a, b, shared)], ["a", "b", "shared"])

    pairs = dealt.mapInArrow(partners, "a int, b int, shared long")
    for x in "ab":
        pairs = pairs.join(maybe_broadcast(known.select(F.col("at").alias(x), F.col("term").alias(f"term_{x}"), F.col("n").alias(f"n{x}"))), x)
    return _kappa(pairs, total)


def _partners(held: np.ndarray, ends: np.ndarray, block: int, blocks: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, lists that hold both), a < b, of the numbers a that are `block` modulo `blocks`; list i, in order, is held[ends[i]:ends[i + 1]].

    Partners are counted for as many numbers as have about `most` of them, repeats counted, but at least for one.
    """
    at = np.flatnonzero(held % blocks == block)
    count = ends[np.searchsorted(ends, at, "right")] - at - 1
    order = np.argsort(held[at], kind="stable")
    at, count = at[order], count[order]
    first = np.flatnonzero(np.diff(held[at], prepend=-1))  # of each number
    upto = np.append(np.cumsum(count)[first] - count[first], count.sum())
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
        x, c = at[first[i] : first[j] if j < len(first) else None], count[first[i] : first[j] if j < len(first) else None]
        places = np.repeat(x + 1 - (np.cumsum(c) - c), c) + np.arange(c.sum())
        both = np.sort(np.repeat(held[x].astype("i8") << 32, c) | held[places])
        new = np.flatnonzero(np.diff(both, prepend=-1))
        yield (both[new] >> 32).astype("i4"), (both[new] & 0xFFFFFFFF).astype("i4"), np.diff(new, append=len(both))
        i = j


def _kappa(pairs: DataFrame, total: int) -> DataFrame:
    """(term_a, term_b, shared, kappa, max_share) of pairs (term_a, term_b, shared, na, nb) over `total` items."""
    n, na, nb, co = F.lit(float(total)), *(F.col(c).cast("double") for c in ("na", "nb", "shared"))
    agree = n - na - nb + 2 * co
    chance = (na * nb + (n - na) * (n - nb)) / n
    return pairs.select("term_a", "term_b", "shared", ((agree - chance + 1e-10) / (n - chance + 1e-10)).alias("kappa"), F.greatest(co / na, co / nb).alias("max_share"))


def similar_terms(annotation: DataFrame, terms: DataFrame, similarity: float) -> DataFrame:
    """The rows of term_kappa with a kappa of at least `similarity`, which must be above 0, without making the pairs that cannot reach it.

    A kappa of t takes t / 2 * (na + nb) shared items. Items go from rare to frequent, so at the first item that two terms share, what either has from there on
    bounds what they share: frequent items, which end the terms, bring few pairs together. A pair may meet at later items too, where fewer are counted.
    """
    ann = cut(clean_pairs(annotation, "term", "item").join(terms.select("term").distinct(), "term", "left_semi"))
    ordered = ordered_prefix(ann.groupBy("item").agg(F.count(F.lit(1)).alias("f")), [], ["f", "item"], name="at").select("item", F.col("at").cast("int").alias("at"))
    sets = cut(ann.join(ordered, "item").groupBy("term").agg(F.sort_array(F.collect_list("at")).alias("items")))
    total = ordered.count()
    placed = sets.select("term", "items", F.size("items").alias("n"), F.posexplode("items").alias("i", "at"))
    # the smallest partner that a term can reach t with is as large as what they share
    placed = placed.filter(F.col("n") - F.col("i") >= F.col("n") * (similarity / (2 - similarity)) - 1e-6)
    placed = placed.select("at", "term", "n", (F.col("n") - F.col("i")).alias("left"), F.expr("slice(items, i + 2, n)").alias("rest"))
    need = F.expr(f"{similarity / 2!r}D * (x.n + y.n) - 1e-6D")
    shared = F.when(F.least("x.left", "y.left") >= need, 1 + F.size(F.array_intersect("x.rest", "y.rest"))).otherwise(0)
    met = placed.alias("x").join(placed.alias("y"), F.expr("x.at = y.at and x.term < y.term")).filter(shared >= need)
    pairs = met.select(F.col("x.term").alias("term_a"), F.col("y.term").alias("term_b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), shared.cast("bigint").alias("shared"))
    told = pairs.groupBy("term_a", "term_b", "na", "nb").agg(F.max("shared").alias("shared"))
    return _kappa(told, total).filter(F.col("kappa") >= similarity)


def rank_scores(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, n, best_rank, n_best, logp): for each key the best hypergeometric tail over its rank cuts.

    Rows are ranked by score with ties at their last place; the ranks come from weighted distinct scores, so no row-level window runs over
    the whole table: only distinct scores are put in order. The sum of a tail may take thousands of steps, so it is only worked out at the cuts whose bounds
    leave open whether they are the best of their key.
    """
    rows = df.select(F.col(key).alias("key"), F.col(score).alias("score")).dropna().filter("not isnan(score)")
    scores = rows.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    upto = cut(ordered_prefix(scores, [], ["score"], F.col("c"), "before").withColumn("rank", F.col("before") + F.col("c")))
    total = rows.count()
    per = rows.groupBy("key", "score").agg(F.count(F.lit(1)).alias("c")).join(maybe_broadcast(upto.select("score", "rank")), "score")
    sizes = per.groupBy(F.col("key").alias("_k")).agg(F.sum("c").alias("n"))
    cum = ordered_prefix(per, ["key"], ["score"], F.col("c")).withColumn("i", F.col("before") + F.col("c")).join(sizes, F.col("key") == F.col("_k"))
    case = (F.col("i"), F.lit(total).cast("bigint"), F.col("n"), F.col("rank"))
    bounds = cum.select("key", "n", "rank", "i", tail_bounds(*case).alias("b"))
    cum = cut(bounds.select("key", "n", "rank", "i", log10_p(F.col("b.least")).alias("least"), log10_p(F.col("b.most")).alias("most")))
    floor, slack = math.log10(P_FLOOR), 1e-3  # far above the rounding of log factorials
    # at the floor all cuts are equal and the first rank is taken, so those behind a cut that is at the floor for sure can't be the best
    told = cum.groupBy(F.col("key").alias("_k")).agg(F.min("most").alias("_most"), F.min(F.when(F.col("most") <= floor, F.col("rank"))).alias("_sure"))
    cum = cum.join(told, F.col("key") == F.col("_k")).filter((F.col("least") <= F.col("_most") + slack) & (F.col("rank") <= F.coalesce("_sure", "rank")))
    cum = cum.select("key", "n", "rank", "i").repartition(F.xxhash64("key", "rank")).withColumn("logp", log10_p(hypergeometric_tail(*case)))
    best = F.min(F.struct("logp", "rank", "i"))
    return cum.groupBy("key", "n").agg(best.alias("b")).select("key", "n", F.col("b.rank").alias("best_rank"), F.col("b.i").alias("n_best"), F.col("b.logp").alias("logp"))
