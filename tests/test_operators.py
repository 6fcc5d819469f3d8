"""Terms, identifiers, statistics, trees, evidence, network and study operators against brute force and literal cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import numeric
from lattica.operators import clustering, enrichment, evidence, identifiers, network, ranks, reshape, statistics, terms, trees
from lattica.plans.study import Settings, Study
from lattica.sources import formats


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def pairs(spark, data, names):
    return spark.createDataFrame(data, names)


def test_fisher_literals(spark):
    """Known one-sided p of two tables."""
    df = spark.createDataFrame([(900, 1000, 500, 1000), (10, 1000, 500, 1000)], "n11 long, n10 long, n01 long, n00 long")
    got = [math.exp(r.fisher_ln_p) for r in statistics.fisher_and_chi2(df).collect()]
    assert got == [pytest.approx(7.6486698436085204e-17, rel=1e-6), pytest.approx(0.99999999999819367, rel=1e-9)]
    a, b = set("abcdfg"), set("acefg")
    letters = spark.createDataFrame([(chr(97 + i),) for i in range(16)], "x string")
    t = statistics.contingency(letters, F.col("x").isin(list(a)), F.col("x").isin(list(b))).first()
    assert (t.n11, t.n10, t.n01, t.n00) == (4, 2, 1, 9)


def test_ordered_prefix_and_extremes(spark):
    rng = random.Random(1)
    data = [(g, v, rng.randint(1, 5)) for g in ("a", "b", None) for v in rng.sample(range(1000), 70)]
    df = spark.createDataFrame(data, "g string, v int, c int")
    for r in ranks.ordered_prefix(df, ["g"], ["v"], F.col("c")).collect():
        assert r.before == sum(c for g, v, c in data if g == r.g and v < r.v)
    one = spark.createDataFrame([(v, rng.randint(0, 99)) for v in rng.sample(range(1000), 90)], "v int, x int")
    seen = dict(map(tuple, one.collect()))
    for r in ranks.ordered_extreme(one, F.col("v"), "x", "m", largest=True).collect():
        assert r.m == max(x for v, x in seen.items() if v <= r.v)
    assert ranks.ordered_prefix(df.limit(0), ["g"], ["v"]).count() == 0


def test_rank_statistics(spark):
    rng = random.Random(2)
    data = [(g, float(rng.randint(0, 6)), float(rng.randint(0, 6))) for g in "ab" for _ in range(25)] + [("a", None, 1.0), ("b", float("nan"), 1.0)]
    df = spark.createDataFrame(data, "g string, a double, b double")
    for r in statistics.signed_rank(df, "g", "a", "b").collect():
        d = [a - b for g, a, b in data if g == r.g and a is not None and a == a and a != b]
        rank = lambda x: sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2  # noqa: B023, E731
        assert r.n == len(d) and r.w == pytest.approx(sum(rank(x) for x in d if x > 0)) and 0 <= r.p <= 1
    for r in statistics.medians(statistics.usable(df, "g", "a")).collect():
        assert r.median == float(np.median([a for g, a, _ in data if g == r.g and a is not None and a == a]))
    z = {(r.g, r.x): r.z for r in statistics.normal_scores(df, "g", "a").collect()}
    assert all(z["a", x] < z["a", x + 1] for x in range(6) if ("a", x + 1) in z and ("a", x) in z)
    m = {r.g: r for r in statistics.mean_test(df, "g", "a", 100.0, one_tail=True).collect()}
    assert m["a"].p == 1.0 and m["a"].t < 0
    assert {r.g: r.r for r in statistics.pearson_by_group(df.withColumn("b", F.col("a")), "g", "a", "b").collect()} == {"a": pytest.approx(1.0), "b": pytest.approx(1.0)}
    assert statistics.signed_rank(df.limit(0), "g", "a", "b").count() == 0


def test_two_way_and_block_ranks(spark):
    rng = random.Random(3)
    cells = {(r, c): [rng.random() + r + 2 * c for _ in range(4)] for r in range(3) for c in range(2)}
    df = spark.createDataFrame([(r, c, x) for (r, c), xs in cells.items() for x in xs], "r int, c int, x double")
    got = {r.source: r for r in statistics.two_way(df, "r", "c", "x").collect()}
    every = np.array([x for xs in cells.values() for x in xs])
    ss = lambda by: sum(len(v) * (np.mean(v) - every.mean()) ** 2 for v in by.values())
    by_r, by_c = defaultdict(list), defaultdict(list)
    for (r, c), xs in cells.items():
        by_r[r] += xs
        by_c[c] += xs
    assert got["row"].ss == pytest.approx(ss(by_r)) and got["column"].ss == pytest.approx(ss(by_c)) and got["interaction"].ss == pytest.approx(ss(cells) - ss(by_r) - ss(by_c))
    assert got["column"].p < 0.01 and got["row"].df == 2
    m = statistics.block_ranks_test(df, "r", "c", "x").first()
    assert m.df == 1 and 0 < m.p < 0.05


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0, None, 4.0], [2.0, 4.0, 5.0, 8.0]), ([1.0], [None]), ([3.0, 3.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [tuple(r) for r in df.select(*[statistics.distance(m).alias(m) for m in ("manhattan", "euclid", "pearson")]).collect()]
    assert got[0] == (pytest.approx(7 / 3), pytest.approx(math.sqrt(7)), pytest.approx(0.0)) and got[1] == (0.5, 0.5, 0.5) and got[2][2] == 0.5
    z = statistics.row_z(spark.createDataFrame([(1.0, 2.0, 3.0), (5.0, 5.0, None)], "a double, b double, c double"), ["a", "b", "c"]).collect()
    assert tuple(z[0]) == (-1.0, 0.0, 1.0) and tuple(z[1]) == (0.0, 0.0, None)


def test_terms(spark):
    ann = pairs(spark, [("t1", 1), ("t1", 2), ("t2", 2), ("t2", 2), ("t3", None), (None, 1)], "term string, item long")
    lists = pairs(spark, [("a", 1), ("a", 9), ("b", 2), (None, 1)], "list string, item long")
    assert rows(terms.terms_per_item(ann)) == [(1, 1), (2, 2)] and rows(terms.terms_per_item(ann, pairs(spark, [("t2",)], "term string"))) == [(2, 1)]
    assert rows(terms.items_per_term(ann)) == [("t1", 2), ("t2", 1)]
    assert rows(terms.items_in(lists, ann, pairs(spark, [("t1",)], "term string"))) == [("a", 1), ("b", 2)]
    assert rows(terms.compare_origins(pairs(spark, [(1,)], "item long"), pairs(spark, [(1,), (2,)], "item long"), ann)) == [("t1", 0, 1, 1), ("t2", 0, 1, 0)]
    assert rows(terms.cluster_scores(ann, pairs(spark, [("t1", 1), ("t2", 1)], "term string, cluster int"))) == [(1, 1, 0.5), (2, 1, 1.0)]
    net = terms.term_network(pairs(spark, [("t1", "t2", 0.4), ("t1", "t3", 0.1)], "term_a string, term_b string, kappa double"), pairs(spark, [("t1",), ("t2",), ("t3",)], "term string"))
    assert rows(net) == [("t1", "t2", 0.4), ("t3", "t3", 1.0)]
    assert terms.random_terms(ann, 2).count() == 2 and rows(terms.random_terms(ann, 2)) == rows(terms.random_terms(ann.repartition(3), 2))
    best = pairs(spark, [(g, f"t{i}", -float(i), 1.0) for g in (1, 2, 3) for i in range(g + 1)], "group_id int, term string, logp double, enrichment double")
    assert [r.tier for r in terms.sampled_members(best, 6, 3, 3).orderBy("tier").collect()] == [1, 1, 1, 2, 2, 2]
    dealt = rows(terms.round_robin(best, "group_id", [F.col("logp")]).select("place"))
    assert len(set(dealt)) == best.count()


def test_identifiers(spark):
    kinds = [r[0] for r in spark.createDataFrame([("NM_001",), ("np_3.2",), ("ENSG0001",), ("123",), ("TP53",), ("",), (None,)], "t string").select(identifiers.id_class(F.col("t"))).collect()]
    assert kinds == ["transcript", "protein", "ensembl", "number", "symbol", None, None]
    groups = pairs(spark, [("g", 1, 9606), ("g", 2, 10090), ("h", 3, 10090)], "group string, gene long, tax_id int")
    assert rows(identifiers.orthologs(pairs(spark, [(1,), (2,), (3,), (4,)], "gene long"), groups, 9606)) == [(1, 1), (2, 1)]
    one, two = pairs(spark, [("NM_1", 5), ("NM_1", 4)], "form string, gene long"), pairs(spark, [("nm_1", 9), ("x", 7)], "form string, gene long")
    assert rows(identifiers.resolve(pairs(spark, [("nm_1.3",), ("X ",), ("?",), (None,)], "t string"), "t", [("a", one), ("b", two)])) == [("X ", 7, "b"), ("nm_1.3", 4, "a")]
    retired = identifiers.current_id(pairs(spark, [(1,), (2,)], "id long"), "id", pairs(spark, [(1, 10)], "old_id long, new_id long"))
    assert rows(retired) == [(1, 10), (2, 2)]


def test_reshaping(spark):
    df = pairs(spark, [(1, "b"), (2, "a"), (3, "b"), (4, None), (5, None)], "i int, x string")
    assert rows(reshape.first_places(df, "x", ["i"])) == [("a", 2), ("b", 1), (None, 4)]
    assert reshape.move_column(df, "x", 0).columns == ["x", "i"] and reshape.rename(df, {"x": "y", "no": "z"}).columns == ["i", "y"]
    a, b = pairs(spark, [(1,), (2,), (2,), (None,)], "x int"), pairs(spark, [(2,), (3,)], "x int")
    assert [rows(reshape.set_operation(a, b, h)) for h in ("intersect", "union", "minus", "either")] == [[(2,)], [(1,), (2,), (3,)], [(1,)], [(1,), (3,)]]
    assert [r[0] for r in pairs(spark, [(0.0,), (-2.0,), (-2.5,), (-99.0,), (None,)], "p double").select(reshape.binned(F.col("p"), (-2, -3, -4), (0.1, 0.2, 0.3, 0.4))).collect()] == [0.1, 0.1, 0.2, 0.4, None]
    assert sorted(r.part for r in reshape.split_rows(df, ["i"], 2).collect()) == [0, 0, 0, 1, 1]
    assert reshape.equal_rows(df, "x", None).count() == 2 and rows(reshape.with_attribute(df, "x", pairs(spark, [("a", "A")], "k string, v string"), "w", "-").select("i", "w"))[:2] == [(1, "-"), (2, "A")]
    text = pairs(spark, [("list_10",), ("list_9",), ("x",)], "t string").select(*reshape.natural_key(F.col("t"))).collect()
    assert [tuple(r) for r in text] == [("list_", 10), ("list_", 9), ("x", -1)]
    label = pairs(spark, [("19_GO:0000001 mitosis",)], "t string").select(*reshape.parted_label(F.col("t"), 10)).first()
    assert tuple(label) == ("GO:0000001", "mitosis") and reshape.sample_table(spark, 4, 2).count() == 4


def test_trees(spark):
    rng = random.Random(4)
    at = {x: rng.random() * 10 for x in "abcdefgh"}
    dist = [("t", x, y, abs(at[x] - at[y])) for x in at for y in at if x < y]
    tree = trees.from_distances(spark.createDataFrame(dist, "tree string, a string, b string, distance double"))
    made = tree.collect()
    assert len(made) == 7
    counts = {r.node: r.n_leaves for r in trees.leaf_counts(tree).collect()}
    below = defaultdict(set)
    for r in trees.nodes_below(tree).collect():
        below[r.node].add(r.leaf)
    assert {n: len(x) for n, x in below.items()} == counts and max(counts.values()) == 8
    for least in (0.0, 0.5, 0.9, 1.1):
        part = defaultdict(set)
        for r in trees.cut_groups(tree, least).collect():
            part[r.part].add(r.leaf)
        sim = {frozenset(below[r.node]): r.similarity for r in made}
        assert set().union(*part.values()) == set(at) and all(len(p) == 1 or sim[frozenset(p)] >= least for p in part.values())
    double = trees.double_cut(tree, 0.5, 0.9).collect()
    inner = defaultdict(set)
    for r in double:
        inner[r.tight_part].add(r.loose_part)
    assert len(double) == 8 and all(len(x) == 1 for x in inner.values())
    reps = trees.representatives(tree, 3).collect()
    assert len(reps) == 3 and sum(r.n_leaves for r in reps) == 8 and all(r.leaf in (below.get(r.node) or {r.node}) for r in reps)
    low = trees.common_ancestor(tree, spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "zz")], "tree string, leaf string")).first().node
    assert {"a", "b"} <= below[low] and not any({"a", "b"} <= x < below[low] for x in below.values())
    assert trees.as_links(tree).count() == 14


def test_evidence_models(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([0, 1]), rng.choice([1.0, 2.0, 3.0, None])) for i in range(80)]
    df = spark.createDataFrame(data, "i int, y int, x double")
    p, n = [x for _, y, x in data if y == 1 and x], [x for _, y, x in data if y == 0 and x]
    assert evidence.auc(df, "y", "x").first().auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in p for b in n) / len(p) / len(n))
    sizes = defaultdict(int)
    for r in evidence.folds(df, "i", "y", 4).collect():
        sizes[r.y, r.fold] += 1
    assert all(max(v for (y, _), v in sizes.items() if y == k) - min(v for (y, _), v in sizes.items() if y == k) <= 1 for k in (0, 1))
    easy = spark.createDataFrame([(i, i % 2, float(i % 2) + rng.random() * 0.1) for i in range(40)], "i int, y int, a double")
    best, mean = evidence.choose_penalty(easy, "i", ["a"], "y", [1], [0.01, 1000.0], k=2)
    assert mean[best] == max(mean.values()) > 0.9
    assert rows(evidence.cutoffs(spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "item string, score double"), 2, 4)) == [(2.0, 3)]


def test_network_parts(spark):
    e = spark.createDataFrame([("a", "b", "Direct", 1.0), ("b", "c", "Indirect", 0.5), ("x", "y", None, 0.1)], "a string, b string, kind string, score double")
    nodes = spark.createDataFrame([("a",), ("b",), ("q",)], "node string")
    assert rows(network.with_singletons(e, nodes)) == [("a", "b"), ("q", "q")]
    left, alone = network.without_nodes(e, spark.createDataFrame([("b",)], "node string"))
    assert left.count() == 1 and rows(alone) == [("a",), ("c",)]
    assert network.of_kinds(e).count() == 2
    assert rows(network.edge_evidence(e, spark.createDataFrame([("a", 2.0), ("b", 1.0)], "node string, value double"))) == [("a", "b", 1.0), ("b", "c", 0.0), ("x", "y", 0.0)]
    assert rows(network.component_sizes(e).select("place", "n_nodes", "n_edges")) == [(1, 3, 2), (2, 2, 1)]


def test_sources(spark, tmp_path):
    assert formats.is_header(["gene", "score"]) and not formats.is_header(["gene", "1.5"]) and not formats.is_header(["a", "a"]) and not formats.is_header(["a", ""])
    assert formats.is_header(["gene", "1"], allow_whole=True) and not formats.is_header(["gene", "1"])
    df = spark.createDataFrame([("a", 1), ("b", None)], "node string, x int")
    formats.write_lines(df, str(tmp_path / "l"), "node")
    assert sorted(r.value for r in formats.read_lines(spark, str(tmp_path / "l")).collect()) == ["a", "b"]
    assert sorted(r.value for r in formats.to_csv_text(df).collect()) == ["a,1", "b,"]
    formats.write_attributes(df, str(tmp_path / "noa"))
    assert [r.value for r in formats.read_lines(spark, str(tmp_path / "noa" / "x")).collect()] == ["a = 1"]
    formats.write_table(df, str(tmp_path / "t"))
    assert dict(formats.read_inferred(spark, str(tmp_path / "t")).dtypes)["x"] == "int"
    (tmp_path / "w.txt").write_text("one\ntwo")
    assert formats.read_whole(spark, str(tmp_path / "w.txt")).first().value == "one\ntwo"


def test_study(spark, tmp_path):
    rng = random.Random(6)
    ann = [(f"t{t}", i) for t in range(12) for i in rng.sample(range(120), 14)] + [(f"u{t}", i) for t in range(3) for i in range(15 * t, 15 * t + 14)]
    held = [("a", i) for i in range(0, 13)] + [("b", i) for i in range(3, 16)] + [("c", i) for i in rng.sample(range(120), 12)]
    links = [(a, b, "Direct", 1.0) for a in range(8) for b in range(a + 1, 8)] + [(a, a + 1, "Direct", 0.5) for a in range(8, 40)]
    study = Study(spark, str(tmp_path / "s"), spark.createDataFrame(held, "list string, item long"), spark.createDataFrame(ann, "term string, item long"), spark.createDataFrame(links, "a long, b long, kind string, score double"), settings=Settings(min_overlap=2, p_cutoff=0.05))
    made = study.run()
    assert set(made) == set(Study.STAGES) and made["enriched"].filter("term = 'u0'").count() == 2 and made["merged"].filter("term = 'u0'").first().n_lists == 2
    assert made["modules"].count() > 0 and made["summary"].filter("group_id = 1").count() > 0
    again = Study(spark, str(tmp_path / "s"), *[spark.createDataFrame([], x) for x in ("list string, item long", "term string, item long", "a long, b long, kind string, score double")])
    assert again.get("enriched").count() == made["enriched"].count()  # found, not made again
    again.reset("clusters")
    assert again.done("merged") and not again.done("clusters") and not again.done("summary")
    with pytest.raises(ValueError):
        Settings(p_cutoff=2)


def test_kappa_of_all_pairs_without_a_shuffle_of_pairs(spark):
    rng = random.Random(12)
    sets = {f"t{i}": {0, *rng.sample(range(1, 60), rng.randint(1, 9))} for i in range(90)} | {"u": {100, 101}, "v": {100}, "w": {102}}
    ann, terms = spark.createDataFrame([(t, i) for t, s in sets.items() for i in s], "term string, item long"), spark.createDataFrame([(t,) for t in sets], "term string")
    part = {t: len(t) % 2 for t in sets}
    n = len(set().union(*sets.values()))
    for within in (None, spark.createDataFrame(list(part.items()), "term string, component int")):
        made = enrichment.term_kappa(ann, terms, within)
        assert "hashpartitioning(term_a" not in made._jdf.queryExecution().toString()
        got = {(r.term_a, r.term_b): (r.shared, r.kappa, r.max_share) for r in made.collect()}
        assert set(got) == {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and (within is None or part[a] == part[b])}
        for (a, b), (shared, kappa, share) in got.items():
            na, nb, both = len(sets[a]), len(sets[b]), len(sets[a] & sets[b])
            chance = (na * nb + (n - na) * (n - nb)) / n
            assert shared == both and share == max(both / na, both / nb) and kappa == pytest.approx((n - na - nb + 2 * both - chance) / (n - chance), abs=1e-9)
    held, ends = np.array([0, 1, 2, 5, 1, 5, 0, 2, 5], "i4"), np.array([0, 4, 6, 9])
    for most in (1, 1_000_000):  # in pieces of one number, and all at once
        told = [x for block in range(2) for piece in enrichment._partners(held, ends, block, 2, most) for x in zip(*(c.tolist() for c in piece), strict=True)]
        assert sorted(told) == [(0, 1, 1), (0, 2, 2), (0, 5, 2), (1, 2, 1), (1, 5, 2), (2, 5, 2)]


def test_similar_terms_need_no_pair_of_a_frequent_item(spark):
    rng = random.Random(5)
    sets = {f"t{i:04d}": {0, *rng.sample(range(1, 400), rng.randint(1, 12))} for i in range(150)}
    sets |= {f"u{i:04d}": {*list(sets[f"t{i:04d}"])[1:], 1000 + i} for i in range(40)} | {f"v{i}": {i} for i in range(3)}
    ann, terms = spark.createDataFrame([(t, i) for t, s in sets.items() for i in s], "term string, item long"), spark.createDataFrame([(t,) for t in sets], "term string")
    for least in (0.3, 0.7):
        want = {(r.term_a, r.term_b): tuple(r)[2:] for r in enrichment.term_kappa(ann, terms).filter(F.col("kappa") >= least).collect()}
        got = enrichment.similar_terms(ann, terms, least)
        assert {(r.term_a, r.term_b): tuple(r)[2:] for r in got.collect()} == want
    best = terms.withColumn("logp", F.lit(-1.0))
    whole = {tuple(r) for r in clustering.group_terms(best, enrichment.term_kappa(ann, terms)).collect()}
    assert {tuple(r) for r in clustering.similar_groups(ann, best).collect()} == whole
    # 12,000 terms that share one item are 72 million pairs, none of which can be similar
    wide = spark.range(12_000).select(F.concat(F.lit("w"), "id").alias("term"), F.explode(F.array(F.lit(-1), *[F.col("id") * 7 + k for k in range(7)])).alias("item"))
    assert enrichment.similar_terms(wide, wide, 0.3).count() == 0


def test_rank_cut_of_large_groups(spark):
    # a tail of 150,000 terms at each of 3,000 cuts was not worked out in minutes
    rows = spark.range(300_000).select(F.when(F.expr("id % 2 = 0 or id between 10000 and 10400"), "a").otherwise("b").alias("k"), F.floor(F.col("id") / 100).cast("double").alias("s"))
    got = {r.key: r for r in enrichment.rank_scores(rows, "k", "s").collect()}
    assert (got["a"].best_rank, got["a"].n_best, got["a"].n) == (10400, 5400, 150_200) and got["b"].n == 149_800
    assert math.isclose(got["a"].logp, -3.99, abs_tol=3) and got["a"].logp < got["b"].logp < 0


def test_tail_bounds(spark):
    cases = [(n, t, m, d) for t, m, d in ((50, 10, 12), (1000, 40, 50), (4000, 2000, 2000), (9, 9, 4), (600, 590, 300)) for n in range(0, min(m, d) + 1, max(1, min(m, d) // 40))]
    cols = [F.col(c) for c in "ntmd"]
    rows = spark.createDataFrame(cases, "n long, t long, m long, d long").select("*", numeric.hypergeometric_tail(*cols).alias("p"), numeric.tail_bounds(*cols).alias("b")).collect()
    for r in rows:
        p = sum(math.comb(r.m, k) * math.comb(r.t - r.m, r.d - k) for k in range(r.n, min(r.m, r.d) + 1))
        ln = math.log(p) - math.log(math.comb(r.t, r.d))
        assert abs(r.p - ln) < 1e-8 and r.b.least - 1e-8 <= ln <= r.b.most + 1e-8


def test_specificity_of_many_lists(spark):
    # 40,000 lists and as many terms are 1,600 million values, all but two of each term 1
    rows = spark.range(40_000).select(F.concat(F.lit("l"), "id").alias("list"), F.concat(F.lit("t"), "id").alias("term"), F.lit(-3.0).alias("logp"))
    got = terms.specificity(rows.unionByName(rows.select(F.lit("l0").alias("list"), "term", F.lit(-1.0).alias("logp")))).select("gini").distinct().collect()
    n = 40_000
    want = (n + 1 - 2 * ((n * (n + 1) / 2 - 1) + 3) / (n + 2)) / n
    assert len({round(r.gini, 9) for r in got}) == 1 and math.isclose(got[0].gini, want, rel_tol=1e-6)


def test_indirect_edges_of_a_hub(spark):
    rng = random.Random(9)
    links = {tuple(sorted(rng.sample(range(60), 2))): rng.randint(1, 9) / 10 for _ in range(160)}
    links |= {(i, 60): 0.2 for i in range(60)}
    e = spark.createDataFrame([(a, b, "Direct", s) for (a, b), s in links.items()], "a long, b long, kind string, score double")
    near = defaultdict(dict)
    for (a, b), s in links.items():
        near[a][b] = near[b][a] = s
    for start, end in ((range(0, 61), range(0, 61)), (range(0, 30), range(20, 61))):
        want = {}
        for u in start:
            for v in end:
                if u != v and v not in near[u] and (mid := near[u].keys() & near[v].keys()):
                    want[min(u, v), max(u, v)] = max(min(near[u][m], near[v][m]) for m in mid)
        s, t = (spark.createDataFrame([(x,) for x in r], "node long") for r in (start, end))
        got = network.indirect_edges(e, s, t, cells=500).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.score for r in got} == want
    # a hub of 3,000 among 3,000 chosen is 4.5 million pairs, found once and not once per side and middle node
    hubs = spark.range(3000).select(F.col("id").alias("a"), F.explode(F.array(*[F.lit(x).cast("bigint") for x in (5000, 5001, 5002)])).alias("b"), F.lit("Direct").alias("kind"), F.lit(0.5).alias("score"))
    some = spark.range(3000).withColumnRenamed("id", "node")
    assert network.indirect_edges(hubs, some, some).count() == 3000 * 2999 // 2


def test_indirect_edges_of_names(spark):
    e = spark.createDataFrame([("a", "m", "Direct", 0.9), ("b", "m", "Direct", 0.4), ("b", "n", "Direct", 0.5), ("a", "n", "Direct", 0.6), ("c", "n", "Direct", 0.7), ("a", "c", "Direct", 0.1), ("x", "y", "Direct", 1.0), ("z", "z", "Direct", 1.0)], "a string, b string, kind string, score double")
    chosen = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    both = network.indirect_edges(e, chosen("a", "b", "c", "x", "z", None), chosen("a", "b", "c", "x", "z", "none"))
    assert rows(both) == [("a", "b", "Indirect", 0.5), ("b", "c", "Indirect", 0.5)]
    assert rows(network.indirect_edges(e, chosen("b", "x"), chosen("c"))) == [("b", "c", "Indirect", 0.5)]
    assert rows(network.indirect_edges(e, chosen("x", "y"), chosen("c"))) == rows(network.indirect_edges(e, chosen(), chosen("c"))) == []


def test_united_sizes(spark):
    rng = random.Random(4)
    lists = {f"l{i}": set(rng.sample(range(5000), rng.randint(1, 2000))) for i in range(12)}
    held = spark.createDataFrame([(k, x) for k, v in lists.items() for x in v], "list string, item long")
    asked = {"|".join(sorted(rng.sample(sorted(lists), rng.randint(1, 8)))) for _ in range(300)}
    got = {r.pattern: r.n_list for r in terms.united_sizes(held, spark.createDataFrame([(p,) for p in asked], "pattern string")).collect()}
    assert got == {p: len(set().union(*(lists[x] for x in p.split("|")))) for p in asked}
