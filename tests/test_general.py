"""Hot keys, hierarchies and orphan references against brute force, with the awkward inputs each operator promises to bear."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lattica.functions.ids import term_key, whole_number, whole_numbers
from lattica.operators import compress as C
from lattica.operators import hierarchy as H
from lattica.operators import orphans as O
from lattica.operators.ranks import grouped_prefix


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_numbers(spark):
    df = spark.createDataFrame([("007",), ("12.0",), (" GeneID:5 ",), ("gid 9",), ("-",), ("",), (None,), ("9" * 25,)], "t string")
    assert [r[0] for r in df.select(whole_number(F.col("t"))).collect()] == [7, 12, 5, 9, None, None, None, None]
    many = spark.createDataFrame([("1,2; 2.0|03",), (None,), ("",)], "t string").select(whole_numbers(F.col("t")))
    assert [r[0] for r in many.collect()] == [[1, 2, 3], [], []]
    assert spark.createDataFrame([(" go:1\t",), ("  ",)], "t string").select(term_key(F.col("t"))).collect()[1][0] is None


@pytest.mark.parametrize("n", [0, 500])
def test_compressed_profile(spark, n):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([5, 5, 6, 7, None]), rng.choice([0.5, None, 2.0]), "x") for _ in range(n)]
    df = spark.createDataFrame(data, "k int, v int, m double, key string")
    got = {r[0]: tuple(r)[1:] for r in C.profile(C.compress(df, F.col("k"), F.col("v"), {"m_sum": F.col("m")}), ["m_sum"]).collect()}
    want = {}
    for k in {d[0] for d in data} - {None}:
        mine = [d for d in data if d[0] == k]
        c = Counter(d[1] for d in mine if d[1] is not None)
        v, top = min(c.items(), key=lambda x: (-x[1], x[0]))
        want[k] = (len(mine), len(c), v, top, sum(d[2] for d in mine if d[2] is not None))
    assert got == want


def test_weighted_percentiles(spark):
    rng = random.Random(2)
    data = [(k, float(rng.choice([1, 2, 2, 2, 3, 50]))) for k in (1, 2) for _ in range(301)] + [(3, 7.0), (4, None), (4, float("nan"))]
    got = {(r.key, r.fraction): r.percentile for r in C.weighted_percentiles(C.compress(spark.createDataFrame(data, "k int, v double"), F.col("k"), F.col("v")), [0.0, 0.5, 0.9, 1.0], blocks=8).collect()}
    for k in (1, 2, 3):
        xs = sorted(v for kk, v in data if kk == k)
        for f in (0.0, 0.5, 0.9, 1.0):
            assert got[k, f] == xs[max(1, -(-int(f * 1000) * len(xs) // 1000)) - 1]
    assert not any(k == 4 for k, _ in got)


def test_weighted_percentiles_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_VALUES", 20)
    rng = random.Random(7)
    xs = [10.0 ** rng.randint(0, 12) + rng.random() for _ in range(500)]
    df = spark.createDataFrame([(1, x) for x in xs] + [(2, 1.0)], "k int, v double")
    got = {(r.key, r.fraction): r.percentile for r in C.weighted_percentiles(C.compress(df, F.col("k"), F.col("v")), [0.1, 0.5, 0.99], blocks=8).collect()}
    assert got == {(1, 0.1): sorted(xs)[49], (1, 0.5): sorted(xs)[249], (1, 0.99): sorted(xs)[494]} | {(2, f): 1.0 for f in (0.1, 0.5, 0.99)}


def test_pair_sides_counts_a_self_loop_once(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 2), (None, None)], "a int, b int")
    assert rows(C.pair_sides(df, F.col("a"), F.col("b"))) == [(1, 1), (1, 2), (2, 1), (2, None)]


def test_grouped_prefix(spark):
    df = spark.createDataFrame([(g, i, i + 1) for g in ("a", "b") for i in range(40)] + [(None, 1, 5)], "g string, i int, n int")
    for g in ("a", "b", None):
        mine = [r for r in grouped_prefix(df, ["g"], ["i"], F.col("n"), blocks=4).collect() if r.g == g]
        run = 0
        for r in sorted(mine, key=lambda r: r.before):
            assert r.before == run
            run += r.n


def brute_chains(links):
    g = defaultdict(set)
    for c, p in links:
        g[c].add(p)
    out = set()
    for s in list(g):
        seen, todo = set(), list(g[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += g[x]
        if s in seen:
            out.add(s)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closed_chains(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 60)] + [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(12)]
    links += [("s", "s"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("below", "c1"), ("under", "below")]
    df = spark.createDataFrame([*links, *links[:5], (None, "n1"), ("lonely", None)], "child string, parent string")
    cleaned = H.clean_links(df, F.col("child"), F.col("parent"))
    # in one task, and in rounds beyond the bound of one
    for bound in (H.LOCAL_LINKS, 0) if seed == 0 else (H.LOCAL_LINKS,):
        assert {r[0] for r in H.closed_chains(*cleaned, local_links=bound).collect()} == brute_chains(links)


def test_hierarchy(spark):
    rng = random.Random(3)
    parent = {f"n{i:03}": f"n{rng.randrange(i):03}" for i in range(1, 50)} | {"x1": "x0", "loop": "loop", "tail": "loop"}
    extra = [("n040", "n000")]
    df = spark.createDataFrame([*parent.items(), *extra, (None, "alone")], "child string, parent string")
    got = {r.id: r for r in H.hierarchy(*H.clean_links(df, F.col("child"), F.col("parent"))).collect()}
    first = dict(parent) | {"n040": min("n000", parent["n040"])}
    path = lambda x: [*path(first[x]), x] if x in first else [x]
    tree = {x for x in got if got[x].status == "tree"}
    assert {x for x in got if got[x].status == "on_chain"} == {"loop"} and got["tail"].status == "below_chain"
    for x in tree:
        assert got[x].path.split(" > ") == path(x) and got[x].depth == len(path(x)) - 1 and got[x].root == path(x)[0]
        inside = {y for y in tree if got[x].pre < got[y].pre < got[x].pre + got[x].size}
        assert inside == {y for y in tree if x in path(y)[:-1]}
    assert sorted(got[x].pre for x in tree) == list(range(len(tree)))
    facts = spark.createDataFrame([tuple(r) for r in got.values()], H.hierarchy(*H.clean_links(df, F.col("child"), F.col("parent"))).schema)
    below = rows(H.descendants(facts, spark.createDataFrame([("n000",), ("x0",)], "id string"), bucket=8))
    assert below == sorted((a, y) for a in ("n000", "x0") for y in tree if a in path(y)[:-1])


@pytest.mark.parametrize("seed", range(2))
def test_reachable_over_all_links(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{i:02}", f"n{rng.randrange(i):02}") for i in range(1, 50)] + [(f"n{i:02}", f"n{rng.randrange(i):02}") for i in rng.sample(range(1, 50), 12)]
    links += [("c1", "c2"), ("c2", "c1"), ("c2", "n05"), ("n40", "c1"), ("self", "self"), ("h1", "c1"), ("h2", "h1"), ("h2", "n03"), ("h3", "h2"), ("h4", "h1")]
    up = defaultdict(set)
    for c, p in links:
        up[c].add(p)

    def over(x, skip=()):
        seen, todo = set(), [x]
        while todo:
            for y in up[todo.pop()] - seen - set(skip):
                seen.add(y)
                todo.append(y)
        return seen

    ids = {x for link in links for x in link}
    on, roots = brute_chains(links), {x for x in ids if not up[x]}
    edges, nodes = H.clean_links(spark.createDataFrame(links, "child string, parent string"), F.col("child"), F.col("parent"))
    placed = H.forest(edges, nodes)
    assert rows(H.reachable(edges, placed)) == sorted((a, x) for x in ids for a in over(x) if a != x)
    got = {r.id: r for r in H.hierarchy(edges, nodes, placed=placed).collect()}
    assert {x for x in ids if got[x].status == "tree"} == {x for x in ids - on if (over(x) | {x}) & roots}
    # a path meets a chain only if no way to a root is free of chains, though the smallest parent hangs below one
    for x in ids:
        if got[x].status == "tree":
            path = got[x].path.split(" > ")
            assert path[0] in roots and path[-1] == x and all(p in up[c] for p, c in zip(path, path[1:], strict=False))
            assert bool(set(path) & on) != bool((over(x, on) | {x}) & roots)
    assert got["h2"].path.endswith("n03 > h2") and got["n40"].status != "below_chain"


def test_empty_hierarchy(spark):
    empty = spark.createDataFrame([], "child string, parent string")
    assert H.hierarchy(*H.clean_links(empty, F.col("child"), F.col("parent"))).count() == 0


def test_orphans(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    cat = spark.createDataFrame([(1, day(0), day(10)), (1, day(5), day(15)), (1, day(0), day(10)), (1, day(20), None), (2, None, None), (None, day(0), None), (3, day(3), day(3))], "k int, f timestamp, t timestamp")
    spans = O.epochs(O.add_changes(None, O.existence_deltas(cat, F.col("k"), F.col("f"), F.col("t"))))
    refs = [(1, day(d)) for d in (-1, 0, 9, 10, 14, 15, 19, 20, 99)] + [(2, day(1)), (3, day(3)), (4, day(1)), (None, day(1)), (1, None)]
    df = spark.createDataFrame([(i, k, at, "t", "f") for i, (k, at) in enumerate(refs)], "i int, key int, at timestamp, ref_table string, ref_field string")
    found = O.orphan_rows(df.withColumn("epoch", F.lit("x")).withColumn("existing", F.lit("y")), spans)
    assert sorted(r.i for r in found.collect()) == [0, 5, 6, 9, 10, 11, 13]
    counts = {r.period: (r.n_orphans, r.n_keys) for r in O.orphan_counts(found).collect()}
    assert sum(n for n, _ in counts.values()) == 7 and counts[None] == (1, 1)
    one = O.apply_deltas(None, spark.createDataFrame([(1, 2, 0), (2, 1, 1), (None, 5, 0)], "key int, refs int, existing int"))
    two = O.apply_deltas(one, spark.createDataFrame([(1, -1, 0), (2, 0, -1)], "key int, refs int, existing int"))
    assert rows(O.orphan_report(two)) == [(1, 1), (2, 1)]
    assert O.orphan_rows(df.limit(0), spans).count() == 0
    # beyond the bound of a broadcast the same rows come by a shuffle join
    joined = O.orphan_rows(df, spans, max_rows=0)
    assert sorted(r.i for r in joined.collect()) == [0, 5, 6, 9, 10, 11, 13] and "Broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_signed_counts_in_batches(spark):
    """Late, repeated, withdrawn and relisted changes in any batches end in the counts of all at once."""
    rng = random.Random(5)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    changes = []
    for k in range(30):
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(100)
            changes += [(k, day(a), 1), (k, day(a + rng.randint(1, 30)), -1)]
    refs = [(i, rng.randrange(35), day(rng.randrange(130)), 1) for i in range(300)]
    refs += [(i, k, at, -1) for i, k, at, _ in refs[:60]]  # retracted again
    rng.shuffle(changes)
    frame = lambda part: spark.createDataFrame(part, "key int, at timestamp, existence int")
    ledger = None
    for lo in range(0, len(changes), 25):
        ledger = O.add_changes(ledger, frame(changes[lo : lo + 25]))
    got = Counter()
    df = spark.createDataFrame(refs, "i int, key int, at timestamp, sign int")
    for r in O.epoch_report(O.placed_references(df, O.epochs(ledger)), F.col("sign")).collect():
        got[r.key] += r.refs
    want = Counter()
    for i, k, at, s in refs:
        if sum(e for kk, t, e in changes if kk == k and t <= at) <= 0:
            want[k] += s
    assert got == Counter({k: n for k, n in want.items() if n > 0})
