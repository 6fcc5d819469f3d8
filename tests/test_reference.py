"""Enrichment, network, clustering, statistics and sources against brute force, and every SQL query against its SQL on the small tables."""

import importlib
import math
import os
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.functions import numeric as N
from lattica.operators import clustering, enrichment, evidence, identifiers, network, reshape, statistics
from lattica.sources import formats


def test_hypergeometric_tail(spark):
    cases = [(3, 50, 10, 12), (0, 20, 5, 5), (5, 20, 5, 5), (8, 1000, 40, 50), (2, 10, 9, 9), (40, 40000, 60, 90)]
    df = spark.createDataFrame(cases, "n long, t long, m long, d long")
    got = [r[0] for r in df.select(N.hypergeometric_tail(F.col("n"), F.col("t"), F.col("m"), F.col("d"))).collect()]
    for (n, t, m, d), g in zip(cases, got, strict=True):
        p = sum(math.comb(m, k) * math.comb(t - m, d - k) for k in range(n, min(m, d) + 1)) / math.comb(t, d)
        assert math.isclose(g, math.log(p), rel_tol=1e-9, abs_tol=1e-9)


def test_tails():
    assert math.isclose(N.t_sf2(2.0, 10), 0.0733880, rel_tol=1e-5)
    assert math.isclose(N.gamma_sf(3.841458821 / 2, 0.5), 0.05, rel_tol=1e-6)
    assert math.isclose(N.f_sf(4.0, 2, 10), (1 + 2 * 4.0 / 10) ** -5, rel_tol=1e-9)  # closed form for two and ten degrees


def test_adjust(spark):
    ps = [0.01, 0.02, 0.02, 0.3, 0.04]
    df = spark.createDataFrame([(i, math.log10(p), 8) for i, p in enumerate(ps)], "i int, lp double, n long")
    got = {r.i: r for r in enrichment.adjust(df, "lp", "n").collect()}
    for i, p in enumerate(ps):
        bh = min(min(1, q * 8 / sum(x <= q for x in ps)) for q in ps if q >= p)
        assert math.isclose(10 ** got[i].bh_log10, bh, rel_tol=1e-9)
        assert math.isclose(10 ** got[i].bonferroni_log10, min(1, p * 8), rel_tol=1e-9)


def edges_of(spark, pairs):
    return network.canonical(spark.createDataFrame(pairs, "x string, y string, s double"), F.col("x"), F.col("y"), F.col("s"))


def test_network(spark):
    e = edges_of(spark, [("b", "a", 0.5), ("a", "b", 0.9), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "d", 1.0), ("e", None, 1.0), ("x", "y", float("nan"))])
    assert {(r.a, r.b): r.score for r in e.collect()} == {("a", "b"): 0.9, ("b", "c"): 1.0, ("a", "c"): 1.0, ("d", "d"): 1.0, ("x", "y"): 0.0}
    assert {tuple(r) for r in network.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("x", "x"), ("y", "x")}
    assert {(r.a, r.b) for r in network.core(e, 2).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    start = spark.createDataFrame([("a",), (None,)], "node string")
    assert {tuple(r) for r in network.hops(e, start, 3).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert network.subnetwork(e, start).count() == 0
    chain = edges_of(spark, [("1", "2", 1.0), ("2", "4", 1.0), ("1", "3", 1.0), ("3", "4", 1.0), ("4", "5", 1.0)])
    assert {tuple(r.path) for r in network.shortest_paths(chain, "1", "5", 4).collect()} == {("1", "2", "4", "5"), ("1", "3", "4", "5")}
    assert network.shortest_paths(chain, "1", "5", 2).count() == 0
    score = {r.node: r.score for r in network.propagate(chain, spark.createDataFrame([("1", 1.0)], "node string, score double")).collect()}
    assert score["2"] == pytest.approx(score["3"])
    assert score["1"] > score["2"] > score["5"] > 0


def test_dense_clusters(spark):
    clique = [(f"k{i}", f"k{j}", 1.0) for i in range(5) for j in range(i)]
    got = network.dense_clusters(edges_of(spark, [*clique, ("k0", "t", 1.0), ("t", "u", 1.0)])).collect()
    assert {r.node for r in got} == {f"k{i}" for i in range(5)} and {r.cluster_score for r in got} == {2.0}


def test_dense_clusters_of_a_large_component(spark):
    rng = random.Random(8)
    pairs = {(f"n{rng.randrange(i):03}", f"n{i:03}") for i in range(1, 620)}
    for _ in range(25):  # dense spots in one component of more than 500 nodes
        spot = sorted(rng.sample([f"n{i:03}" for i in range(620)], 6))
        pairs |= {(x, y) for i, x in enumerate(spot) for y in spot[i + 1:] if rng.random() < 0.8}
    got = network.dense_clusters(edges_of(spark, [(x, y, 1.0) for x, y in pairs])).collect()
    want = network._grow(iter(sorted(pairs)), 0.2)
    told = {}
    for r in got:
        told.setdefault((r.cluster, r.seed, round(r.cluster_score, 9)), {})[r.node] = round(r.node_score, 9)
    assert want and told == {(i, s, round(c, 9)): {n: round(v, 9) for n, v in nodes} for i, (s, c, nodes) in enumerate(want, 1)}


def test_hub_of_a_dense_network(spark):
    rng = random.Random(9)
    pairs = {("hub", f"n{i:04}") for i in range(900)} | {(f"n{i:04}", f"n{(i + k) % 900:04}") for i in range(900) for k in (1, 2)}
    pairs |= {(x, y) for s in range(12) for spot in [sorted(rng.sample([f"n{i:04}" for i in range(900)], 9))] for i, x in enumerate(spot) for y in spot[i + 1:]}
    pairs = {(min(x, y), max(x, y)) for x, y in pairs}
    nodes, links = network.numbered(edges_of(spark, [(x, y, 1.0) for x, y in pairs]))
    near = {}
    for x, y in pairs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    got = {r.node: (r.score, r.density, r.degree) for r in network.node_scores(nodes, links).collect()}
    assert got == {n: (*network._node_score(n, near), len(near[n])) for n in near}
    told = {}
    for r in network.dense_clusters(edges_of(spark, [(x, y, 1.0) for x, y in pairs])).collect():
        told.setdefault((r.seed, r.cluster_score), set()).add((r.node, r.node_score))
    assert told == {(s, c): set(nodes) for s, c, nodes in network._grow(iter(pairs), 0.2)}


def test_no_table_of_nodes_is_built_by_the_driver(spark, monkeypatch):
    """Files of `cut` are compressed, so their bytes don't tell what a broadcast would hold; rows are counted instead."""
    monkeypatch.setattr(network, "SIDE_ROWS", 50)
    rng = random.Random(10)
    pairs = {tuple(sorted(rng.sample([f"n{i:03}" for i in range(300)], 2))) for _ in range(1500)}
    pairs |= {(f"n{i:03}", f"n{j:03}") for i in range(12) for j in range(i + 1, 12)} | {("x", "y"), ("x", "z"), ("y", "z")}
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = network.dense_clusters(edges_of(spark, [(x, y, 1.0) for x, y in pairs])).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)

    def each(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    ids = [e.executionId() for e in each(store.executionsList())][before - store.executionsCount() :]
    rows = []
    for i in ids:
        value = {t._1(): t._2() for t in each(store.executionMetrics(i))}
        rows += [int(value.get(m.accumulatorId(), "0").replace(",", "")) for n in each(store.planGraph(i).allNodes()) if n.name() == "BroadcastExchange" for m in each(n.metrics()) if m.name() == "number of output rows"]
    assert len(ids) > 10 and max(rows, default=0) <= 50
    told = {}
    for r in got:
        told.setdefault((r.seed, round(r.cluster_score, 9)), set()).add((r.node, round(r.node_score, 9)))
    assert told == {(s, round(c, 9)): {(n, round(v, 9)) for n, v in nodes} for s, c, nodes in network._grow(iter(sorted(pairs)), 0.2)}


def test_links_that_face_a_hub_are_held_as_numbers():
    n = 200_000  # a ring in which each node is linked to the two nodes on either side
    at = np.arange(n)
    cols = [np.repeat(np.int32([0, 1, 2]), [2 * n, 3, 1]), np.int32([*at, *at, 0, 1, 2, 0]), np.int32([*(at + 1) % n, *(at + 2) % n, 1, 2, 0, 1])]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i:i + 10_000]) for c in cols], ["id", "p", "q"]) for i in range(0, len(cols[0]), 10_000)]
    pieces = list(network._whole_groups(iter(batches), 20_000))
    assert [np.unique(p[0]).tolist() for p in pieces] == [[0], [1, 2]] or [np.unique(p[0]).tolist() for p in pieces] == [[0, 1, 2]]
    tracemalloc.start()
    level, size, edges = network._highest_cores(np.zeros(2 * n, int), cols[1][: 2 * n], cols[2][: 2 * n])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (level[0], size[0], edges[0]) == (4, n, 2 * n)
    assert most < 150 * 2 * n  # bytes; sets of texts took several times as much
    assert [tuple(x) for x in zip(*network._highest_cores(np.array([0, 0, 0, 1]), *(np.int32(c[2 * n:]) for c in cols[1:])), strict=True)] == [(2, 3, 3), (1, 2, 1)]


def test_propagation_query_ends_by_tolerance(spark, monkeypatch):
    import lattica.reference_queries as q

    chain = edges_of(spark, [(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(16)])
    monkeypatch.setattr(q, "edges", lambda *_: chain)
    monkeypatch.setattr(q, "_chosen", lambda *_: spark.createDataFrame([(f"n{i:02}",) for i in range(4)], "node string"))
    seen = []
    whole = network.propagate
    monkeypatch.setattr(network, "propagate", lambda *a, **k: seen.append(whole(*a, **k)) or seen[0])
    q.propagated_scores(spark, "")
    assert all(r.score > 0 for r in seen[0].collect())  # node 16 is 13 steps from the list


def test_linkage_matches_definition():
    rng = np.random.default_rng(1)
    x = rng.random((12, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    merges = clustering.average_linkage(d)
    groups = {i: [i] for i in range(12)}
    for s, (a, b, h, size) in enumerate(merges):
        best = min(np.mean([d[i, j] for i in groups[p] for j in groups[q]]) for p in groups for q in groups if p < q)
        assert math.isclose(h, best, rel_tol=1e-9) and size == len(groups[a]) + len(groups[b])
        groups[12 + s] = groups.pop(a) + groups.pop(b)
    assert sorted(clustering.leaf_order(merges, 12)) == list(range(12))
    assert len(set(clustering.cut_tree(merges, 12, -1))) == 12 and set(clustering.cut_tree(merges, 12, 9)) == {1}


def test_groups_of_any_number_of_terms(spark):
    rng = random.Random(7)
    names = [f"t{i:02}" for i in range(40)]
    sims = {(a, b): rng.uniform(-0.2, 1.0) for i, a in enumerate(names) for b in names[i + 1:] if rng.random() < 0.15}
    df = lambda x, kinds: spark.createDataFrame(x, kinds)
    pairs = df([(a, b, s) for (a, b), s in sims.items()], "term_a string, term_b string, kappa double")
    groups = lambda got: {frozenset(r.term for r in got if r.cluster == c) for c in {r.cluster for r in got}}
    terms = df([(n,) for n in names], "term string")
    assert groups(clustering.group_terms(terms, pairs).collect()) == groups(clustering.cluster_terms(terms, pairs).collect())
    # more terms than one whole tree may have, all of them grouped
    n = clustering.MAX_LEAVES + 400
    many = df([(f"m{i:04}",) for i in range(n)], "term string")
    twos = df([(f"m{i:04}", f"m{i + 1:04}", 0.9) for i in range(0, n, 2)], "term_a string, term_b string, kappa double")
    got = clustering.group_terms(many, twos).collect()
    assert len(got) == n and len({r.cluster for r in got}) == n // 2


def test_statistics(spark):
    rng = random.Random(4)
    data = [(g, float(rng.choice([1, 2, 2, 5, 9]))) for g in "ab" for _ in range(30)] + [("a", None), ("b", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double")
    xs = {g: sorted(v for k, v in data if k == g and v is not None and v == v) for g in "ab"}
    for r in statistics.gini(df, "g", "v").collect():
        x = xs[r.g]
        n = len(x)
        assert math.isclose(r.gini, (n + 1 - 2 * sum((n - i) * v for i, v in enumerate(x)) / sum(x)) / n, rel_tol=1e-9)
    for r in statistics.mad(df, "g", "v").collect():
        assert math.isclose(r.mad, float(np.median(np.abs(np.array(xs[r.g]) - np.median(xs[r.g])))) * 1.4826)
    t = statistics.t_test(df, "g", "v", "a", "b").first()
    assert 0 <= t.p <= 1 and t.df == 58
    assert statistics.one_way(df, "g", "v").first().f_p == pytest.approx(t.p, rel=1e-6)
    u = statistics.mann_whitney(df, "g", "v", "a", "b").first()
    assert u.u == sum((x > y) + 0.5 * (x == y) for x in xs["a"] for y in xs["b"])
    assert statistics.describe(df.limit(0), "g", "v").count() == 0


def test_reshape_and_identifiers(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "id int, a double, b double")
    assert sorted(map(tuple, reshape.melt(df, ["id"], ["a", "b"]).collect()), key=repr) == [(1, "a", 1.0), (2, None, None)]
    prof = {r.column: r for r in reshape.profile(df).collect()}
    assert (prof["a"].n_null, prof["a"].mean, prof["b"].most_popular, prof["id"].n_unique) == (1, 1.0, None, 2)
    assert reshape.formatted(df).first().a == "1.0" and reshape.formatted(df).first().b == ""
    ids = spark.createDataFrame([(1,), (None,)], "x int")
    assert reshape.isin_split(df, "id", ids).count() == 1 and reshape.isin_split(df, "id", ids, True).count() == 1
    assert reshape.even_rows(spark.range(100).withColumnRenamed("id", "k"), ["k"], 10, 100).count() == 10
    forms = spark.createDataFrame([("ab.1-x",)], "t string").select(identifiers.id_forms(F.col("t"))).first()[0]
    assert forms == ["AB.1-X", "AB.1", "AB"]
    mapping = spark.createDataFrame([(5, "AB", 2, 1), (7, "ab.1", 13, 1), (3, "ab", 1, 1), (None, "ab", 1, 1)], "gid long, source_id string, id_type_id int, tax_id int")
    got = identifiers.convert(spark.createDataFrame([("ab.1-x",), ("ab",), (None,)], "t string"), "t", mapping)
    assert {r.input: r.gene for r in got.collect()} == {"ab.1-x": 7, "ab": 3}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the small tables")
def test_category_means_hold_every_row(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    used = spark.read.parquet(f"{d}/go_result.parquet").filter("logp is not null and not isnan(logp) and categoryid is not null")
    got = e.queries()["category_means"](spark, d).collect()
    assert {r.categoryid for r in got} == {r[0] for r in used.select("categoryid").distinct().collect()} > {3, 5, 11, 19}
    assert sum(r.n for r in got) == used.count()
    pivot = {r.list_name: r for r in e.queries()["category_pivot"](spark, d).collect()}
    assert all(r.mean == pytest.approx(pivot[r.list_name][f"c{r.categoryid}"], abs=1e-6) for r in got if r.categoryid in (3, 5, 11, 19))


def test_evidence(spark):
    rng = random.Random(5)
    rows = [(float(a), float(b), int(rng.random() < (0.8 if a else 0.2))) for a in (0, 1) for b in (0, 1) for _ in range(50)]
    w, _ = evidence.fit_weights(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y", [1, 1], penalty=0.1)
    assert w[0] > 1 and w[1] >= 0
    s = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 2.0), ("w", 1.0)], "item string, score double")
    assert evidence.prefix_near(s, 2).count() == 3
    m = evidence.metrics(spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "y int, p int"), "y", "p").first()
    assert m.accuracy == 0.75 and m.f1 == pytest.approx(2 / 3)


def test_formats(spark, tmp_path):
    e = edges_of(spark, [("a", "b", 0.5), ("b", "c", 1.0)])
    formats.write_sif(e, str(tmp_path / "n.sif"))
    assert {(r.a, r.b) for r in formats.read_sif(spark, str(tmp_path / "n.sif")).collect()} == {("a", "b"), ("b", "c")}
    formats.write_xgmml_edges(e, str(tmp_path / "n.xml"))
    assert {(r.a, r.b) for r in formats.read_xgmml(spark, str(tmp_path / "n.xml"))[1].collect()} == {("a", "b"), ("b", "c")}
    formats.write_table(e, str(tmp_path / "t"), gzip=True)
    assert formats.read_table(spark, str(tmp_path / "t"), "a string, b string, kind string, score double", where="score > 0.7").count() == 1
    (tmp_path / "n.json").write_text('{"elements":{"nodes":[{"data":{"id":"1","name":"A"}}],"edges":[{"data":{"source":"2","target":"1","score":0.5}}]}}')
    nodes, edges = formats.read_network_json(spark, str(tmp_path / "n.json"))
    assert nodes.count() == 1 and edges.first().a == "1"
    assert formats.query(spark, "select :x + 1 as y", x=4).first().y == 5


SMALL = Path(os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.skipif(not SMALL.exists(), reason="needs the small tables")
def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in SMALL.iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")

    def norm(df):
        cell = lambda v: None if v is None or str(v) in ("<NA>", "nan", "NaT") else (round(float(v), 5) + 0.0 if not isinstance(v, str) else v)
        return sorted(repr(tuple(map(cell, r))) for r in df[sorted(df.columns)].itertuples(index=False))

    # the general queries; with ALL_SQL=1 those of every module, which takes minutes
    modules = e._modules() if os.environ.get("ALL_SQL") else [importlib.import_module(f"lattica.{m}") for m in ("core_queries", "reference_queries")]
    queries = {n: q for m in modules for n, q in m.QUERIES.items()}
    slow = () if os.environ.get("ALL_SQL") else ("p5_hierarchy", "p5_descendants")
    for name, sql in ((n, q) for m in modules for n, q in m.SQL.items() if n not in slow):
        assert norm(queries[name](spark, str(SMALL)).toPandas()) == norm(con.execute(sql).df()), name
