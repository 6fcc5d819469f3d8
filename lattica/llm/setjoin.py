"""All pairs of similar sets, exactly, by metric pivot partitioning under Jaccard distance.

A pair counts when the shared items are at least `share` of the items that either set holds (the union), which is a Jaccard distance
of at most r = 1 - share. Equal sets are one class and enter once. Pivots are chosen among the leaders of minhash groups:
a leader that lies near no smaller leader is a pivot, every class has its home cell at the nearest pivot within `reach`, and a class that no
pivot lies near is the pivot of its own cell. The radius of each cell is measured. By the triangle inequality a class y can be similar to
a member of cell p only if d(y, p) <= r + radius(p), so y is replicated to exactly these cells, with its distance, and pairs are joined exactly
inside the cells: with the pivot itself the distance is the replica's, with the other members a pair must also pass
|d(x, p) - d(y, p)| <= r before its exact test. The pivots decide the work only, never the result.

Which pivots lie that near is found with the prefix filter on items in rarest-first order: for a distance below 1 the sets
share one of their first items. Frequent items come last, so they carry no join key unless a set has nothing rarer.

Null items are dropped, repeated ones count once, empty sets are in no pair. Copies are expanded only by `expand`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import cut

REACH = 0.3
BANDS, ROWS = 6, 2


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of sets (id, items): classes (cid, items, n) with cid the least id, members (id, cid)."""
    flat = sets.select("id", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items")).filter("id is not null and size(items) > 0")
    keyed = flat.withColumn("h", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), 256))
    classes = keyed.groupBy("h").agg(F.min("id").alias("cid"), F.first("items").alias("items"))
    members = keyed.select("id", "h").join(classes.select("h", "cid"), "h").select("id", "cid")
    return classes.select("cid", "items", F.size("items").alias("n")), members


def rare_first(classes: DataFrame) -> DataFrame:
    """(cid, items, n): items ordered by how many classes hold them, then by value."""
    flat = classes.select("cid", "n", F.explode("items").alias("item"))
    counts = flat.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    return flat.join(counts, "item").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("o")).select("cid", F.col("o.item").alias("items"), "n")


def _ceil(x: Column) -> Column:
    return F.ceil(x - 1e-9)


def _tokens(df: DataFrame, least: Column, *keep: str) -> DataFrame:
    """One row per prefix item: with `least` shared items needed, the first n - least + 1 must hold a shared one."""
    prefix = F.slice("items", F.lit(1), F.greatest(F.lit(1), (F.col("n") - least + 1).cast("int")))
    return df.select("n", *keep, F.posexplode(prefix).alias("pos", "item"))


def _distance(a: str, b: str, na: str, nb: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return 1.0 - shared / (F.col(na) + F.col(nb) - shared)


def _enough(share: Column, na: str, nb: str) -> Column:
    """Least number of shared items of two sets at a Jaccard similarity of `share`."""
    return _ceil(share / (1 + share) * (F.col(na) + F.col(nb)))


def _minhash(seed: int) -> Column:
    return F.array_min(F.transform("items", lambda x: F.xxhash64(x, F.lit(seed))))


def home_cells(ordered: DataFrame, reach: float) -> DataFrame:
    """(cid, home, d_home): the nearest pivot within reach; a class that none lies near is its own."""
    bands = F.array(*[F.struct(F.lit(b).alias("b"), F.xxhash64(*[_minhash(b * ROWS + j) for j in range(ROWS)]).alias("h")) for b in range(BANDS)])
    sigs = ordered.select("cid", F.explode(bands).alias("s")).select("cid", "s.b", "s.h")
    lead = sigs.groupBy("b", "h").agg(F.min("cid").alias("leader"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("b", "h", "leader")
    offers = sigs.join(lead, ["b", "h"]).filter("cid <> leader").select("cid", "leader").distinct()
    a = ordered.select("cid", F.col("items").alias("i1"), F.col("n").alias("n1"))
    b = ordered.select(F.col("cid").alias("leader"), F.col("items").alias("i2"), F.col("n").alias("n2"))
    near = cut(offers.join(a, "cid").join(b, "leader").select("cid", "leader", _distance("i1", "i2", "n1", "n2").alias("d")).filter(F.col("d") <= reach))
    # who has a smaller leader near is no pivot; the others near it look for another one
    taken = near.select(F.col("cid").alias("leader")).distinct()
    best = near.join(taken, "leader", "left_anti").groupBy("cid").agg(F.min(F.struct("d", "leader")).alias("b"))
    return ordered.select("cid").join(best, "cid", "left").select("cid", F.coalesce("b.leader", F.col("cid")).alias("home"), F.coalesce("b.d", F.lit(0.0)).alias("d_home"))


def similar_classes(classes: DataFrame, share: float = 0.7, reach: float = REACH) -> DataFrame:
    """(a, b, d): pairs of classes, a < b, whose Jaccard distance is at most 1 - share."""
    if not 0.0 < reach < share <= 1.0:
        raise ValueError("reach must be positive and below share")
    r = 1.0 - share
    ordered = cut(rare_first(classes))
    homes = cut(home_cells(ordered, reach))
    pivots = ordered.join(homes.groupBy("home").agg(F.max("d_home").alias("radius")), F.col("cid") == F.col("home")).select(F.col("cid").alias("p"), "items", "n", "radius")
    # replication: y goes to every cell p with d(y, p) <= r + radius(p)
    least = F.lit(share) - F.col("radius")
    near_p = _tokens(pivots, _ceil(least * F.col("n")), "p", "radius").withColumnsRenamed({"n": "np", "pos": "pp"})
    near_y = _tokens(ordered, _ceil(F.lit(share - reach) * F.col("n")), "cid").withColumnsRenamed({"n": "ny", "pos": "py"})
    need = _enough(F.lit(share) - F.col("radius"), "np", "ny")
    room = F.least(F.col("np") - F.col("pp"), F.col("ny") - F.col("py"), "np", "ny")
    met = near_y.join(near_p, "item").filter(room >= need).select("cid", "p", "radius").distinct()
    body = pivots.select("p", F.col("items").alias("pi"), F.col("n").alias("np"))
    told = met.join(ordered, "cid").join(body, "p").withColumn("d", _distance("items", "pi", "n", "np")).filter(F.col("d") <= F.col("radius") + r + 1e-9)
    replicas = cut(told.select("p", "cid", "items", "n", "d", "radius"))
    # inside the cells: the pivot against its replicas, then the other members
    with_pivot = replicas.filter((F.col("cid") != F.col("p")) & (F.col("d") <= r + 1e-9)).select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b"), "d")
    inside = replicas.filter("radius > 0").join(homes.filter("d_home > 0").select(F.col("home").alias("p"), "cid"), ["p", "cid"], "left_semi")
    own = _ceil(F.lit(share) * F.col("n"))
    t_in = _tokens(inside, own, "p", "cid", "d").withColumnsRenamed({"n": "nx", "pos": "px", "cid": "x", "d": "dx"})
    t_re = _tokens(replicas.filter("radius > 0 and cid <> p"), own, "p", "cid", "d").withColumnsRenamed({"n": "ny", "pos": "py", "cid": "y", "d": "dy"})
    both = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"), "nx", "ny") >= _enough(F.lit(share), "nx", "ny")
    pairs = t_in.join(t_re, ["p", "item"]).filter((F.col("x") != F.col("y")) & (F.abs(F.col("dx") - F.col("dy")) <= r + 1e-9) & both)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    one, two = (ordered.select(F.col("cid").alias(k), F.col("items").alias(f"{k}i"), F.col("n").alias(f"{k}n")) for k in "ab")
    members = pairs.join(one, "a").join(two, "b").withColumn("d", _distance("ai", "bi", "an", "bn")).filter(F.col("d") <= r + 1e-9).select("a", "b", "d")
    return with_pivot.unionByName(members).distinct()


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of ids, equal sets included. As many rows as the answer has."""
    m1, m2 = members.select(F.col("id").alias("i"), F.col("cid").alias("c1")), members.select(F.col("id").alias("j"), F.col("cid").alias("c2"))
    between = pairs.join(m1, F.col("a") == F.col("c1")).join(m2, F.col("b") == F.col("c2")).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    within = m1.join(m2, (F.col("c1") == F.col("c2")) & (F.col("i") < F.col("j"))).select(F.col("i").alias("id_a"), F.col("j").alias("id_b"))
    return between.unionByName(within)


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cid, n_links): one row per set with its class and the number of other sets it is similar to, copies included."""
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("copies"))
    sides = pairs.select(F.col("a").alias("cid"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    near = sides.join(sizes.withColumnRenamed("cid", "other"), "other").groupBy("cid").agg(F.sum("copies").alias("n"))
    return members.join(sizes, "cid").join(near, "cid", "left").select("id", "cid", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
