"""Parent-child links of unknown depth: closed chains, paths, roots, nested-set ranges, descendants.

Trees are climbed by pointer doubling, so the number of rounds is the logarithm of the depth and
each round is one equi-join, cut in the shared checkpoint folder. Subtree sizes are summed upward with the same
jumps (a node at distance 2^k below another hands up what lies less than 2^k below itself), sibling ranges come from
prefix sums, and preorder numbers are the offsets summed downward along the path. Nodes that the climb never
finishes are the unprocessed ones: they lie on, or hang below, a closed chain. What is reached through second parents is added
by closing the small graph of the nodes that have them.

Links with a null or empty side are no links, but the other side is still a node. Repeated links are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.ranks import ordered_prefix
from lattica.session import cut, drop_cut


def clean_links(df: DataFrame, child: Column, parent: Column) -> tuple[DataFrame, DataFrame]:
    """(links, nodes): distinct (child, parent) and distinct (id)."""
    pairs = df.select(child.alias("child"), parent.alias("parent"))
    nodes = pairs.select(F.explode(F.array("child", "parent")).alias("id")).filter("id is not null").distinct()
    return pairs.filter("child is not null and parent is not null").distinct(), nodes


def climb(nodes: DataFrame, combine: dict[str, Callable[[Column, Column], Column]]) -> tuple[DataFrame, DataFrame]:
    """Follow ptr to where it ends; (done, unprocessed).

    nodes: (id, ptr, <value>...), ptr null where a chain stops. done: (id, end, jumps, <value>...), jumps[k]
    the node 2^k further up and the values combined (mine, further up) over the chain from id to end, both included.
    unprocessed: (id, jumps, ptr) for nodes whose chain never ends.
    """
    values = list(combine)
    jumps = F.when(F.col("ptr").isNotNull(), F.array("ptr")).otherwise(F.array().cast("array<string>"))
    state = cut(nodes.select("id", "ptr", F.when(F.col("ptr").isNull(), F.col("id")).alias("end"), jumps.alias("jumps"), *values))
    left = state.filter("end is null").count()
    while left:
        active = state.filter("end is null")
        far = state.select(F.col("id").alias("f_id"), F.col("ptr").alias("f_ptr"), F.col("end").alias("f_end"), *[F.col(v).alias(f"f_{v}") for v in values])
        met = active.join(far, F.col("ptr") == F.col("f_id"), "inner")
        jumps = F.when(F.col("f_ptr").isNotNull(), F.concat("jumps", F.array("f_ptr"))).otherwise(F.col("jumps"))
        step = met.select("id", F.col("f_ptr").alias("ptr"), F.col("f_end").alias("end"), jumps.alias("jumps"), *[combine[v](F.col(v), F.col(f"f_{v}")).alias(v) for v in values])
        # what has ended goes round the join, so ended rows do not meet in one task on a null key
        older, state = state, cut(state.filter("end is not null").unionByName(step))
        drop_cut(older)
        now = state.filter("end is null").count()
        if now == left:
            break  # no chain of this length ended, so none longer does
        left = now
    return state.filter("end is not null").select("id", "end", "jumps", *values), state.filter("end is null").select("id", "jumps", "ptr")


#: Links of a contracted graph that one task searches; a larger graph is searched in rounds by all tasks.
LOCAL_LINKS = 200_000


def _unprocessed(below: list[list[int]], above: list[list[int]]) -> list[bool]:
    """Nodes that no order of processing reaches when a node waits for all of `below`."""
    waits = [len(b) for b in below]
    ready = [i for i, n in enumerate(waits) if not n]
    left = [True] * len(waits)
    while ready:
        i = ready.pop()
        left[i] = False
        for j in above[i]:
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return left


def _strong_parts(ups: list[list[int]], left: list[bool]) -> list[int]:
    """A number per node of its strongly connected part among the nodes that are left (iterative, by lowest links)."""
    part, index, low, stack, on, count, parts = [-1] * len(ups), [-1] * len(ups), [0] * len(ups), [], set(), 0, 0
    for root in range(len(ups)):
        if not left[root] or index[root] >= 0:
            continue
        work = [(root, iter(ups[root]))]
        while work:
            v, todo = work[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on.add(v)
            for w in todo:
                if not left[w]:
                    continue
                if index[w] < 0:
                    work.append((w, iter(ups[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part[w] = parts
                        if w == v:
                            break
                    parts += 1
    return part


def _strong_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v, via) on closed chains: those that neither the pass upward nor the one downward processes, then checked exactly."""
    frame = pd.concat([pd.DataFrame({"u": [], "v": [], "via": []}, dtype=object), *batches])
    number = {x: i for i, x in enumerate(dict.fromkeys([*frame.u, *frame.v]))}
    links = [(number[a], number[b]) for a, b in zip(frame.u, frame.v, strict=True)]
    ups, downs = [[] for _ in number], [[] for _ in number]
    for a, b in links:
        ups[a].append(b)
        downs[b].append(a)
    left = [x and y for x, y in zip(_unprocessed(downs, ups), _unprocessed(ups, downs), strict=True)]
    part = _strong_parts(ups, left)
    yield frame[[left[a] and left[b] and part[a] == part[b] for a, b in links]] if links else frame


def _functional_cycles(unprocessed: DataFrame) -> DataFrame:
    """(id): what repeated jumping of the unprocessed nodes maps onto; nodes that hang below a chain drop out."""
    image = cut(unprocessed.select("id", "ptr"))
    count = image.select("ptr").distinct().count()
    while count:
        far = image.select(F.col("id").alias("f_id"), F.col("ptr").alias("f_ptr"))
        image = cut(image.join(far, F.col("ptr") == F.col("f_id")).select("id", F.col("f_ptr").alias("ptr")))
        now = image.select("ptr").distinct().count()
        if now == count:
            break
        count = now
    return image.select(F.col("ptr").alias("id")).distinct()


def _trim(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (u, v, ...) both of whose ends have an edge in and an edge out, peeled until nothing changes."""
    left = edges.count()
    while left:
        outs, ins = edges.select(F.col("u").alias("k")).distinct(), edges.select(F.col("v").alias("k")).distinct()
        both = outs.join(ins, "k", "left_semi")
        edges = cut(edges.join(both.withColumnRenamed("k", "u"), "u", "left_semi").join(both.withColumnRenamed("k", "v"), "v", "left_semi"))
        now = edges.count()
        if now == left:
            break
        left = now
    return edges, left


def _strong_edges(edges: DataFrame) -> DataFrame:
    """Edges (u, v, via) inside a strongly connected component, by colouring from the largest id and searching back."""
    found = []
    edges, left = _trim(cut(edges))
    while left:
        color = cut(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("color", F.col("id")))
        while True:  # the largest id that reaches a node
            sent = edges.join(color, edges.u == color.id).groupBy("v").agg(F.max("color").alias("sent"))
            new = cut(color.join(sent, color.id == sent.v, "left").select("id", F.greatest("color", "sent").alias("color"), (F.col("sent") > F.col("color")).alias("moved")))
            moved = new.filter("moved").limit(1).count()
            color = new.select("id", "color")
            if not moved:
                break
        cu, cv = color.select(F.col("id").alias("u"), F.col("color").alias("cu")), color.select(F.col("id").alias("v"), F.col("color").alias("cv"))
        own = cut(edges.join(cu, "u").join(cv, "v").filter("cu = cv").drop("cv").withColumnRenamed("cu", "color"))
        back = cut(color.filter("id = color").select("id"))
        front = back
        while True:  # who reaches the largest id of its color
            step = own.join(front.withColumnRenamed("id", "v"), "v", "left_semi").select(F.col("u").alias("id")).distinct()
            front = cut(step.join(back, "id", "left_anti"))
            if not front.limit(1).count():
                break
            back = cut(back.unionByName(front))
        ku, kv = back.withColumnRenamed("id", "u"), back.withColumnRenamed("id", "v")
        inside = own.join(ku, "u", "left_semi").join(kv, "v", "left_semi").select("u", "v", "via")
        found.append(cut(inside))
        edges, left = _trim(cut(edges.join(ku, "u", "left_anti").join(kv, "v", "left_anti")))
    return reduce(DataFrame.unionByName, found) if found else edges.select("u", "v", "via").limit(0)


def closed_chains(links: DataFrame, nodes: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id): every node that lies on a closed chain of links, a node that is its own parent included.

    Nodes with one parent are climbed by doubling up to a root or to a node with several parents; what
    the climb leaves unprocessed is on or below a closed chain of such nodes. The nodes with several parents and their
    links, each carried to the end of its chain, form a much smaller graph. Nodes of it that the pass upward (a node waits for all below it)
    and the pass downward (it waits for all above it) both leave unprocessed reveal its closed chains; an exact
    check by strongly connected parts drops those that only lie between two chains. The contracted graph is searched by one task while
    it has at most `local_links` links, by its measured size, and else in rounds by all tasks.
    """
    ptr = cut(links.groupBy("child").agg(F.count(F.lit(1)).alias("n_parents"), F.min("parent").alias("parent")))
    base = nodes.join(ptr, F.col("id") == F.col("child"), "left").select("id", F.when(F.col("n_parents") == 1, F.col("parent")).alias("ptr"))
    done, unprocessed = climb(base, {})
    many = ptr.filter("n_parents > 1").select(F.col("child").alias("m"))
    out = links.join(many, F.col("child") == F.col("m"), "left_semi").select(F.col("child").alias("u"), F.col("parent").alias("via"))
    ends = done.select(F.col("id").alias("via"), F.col("end").alias("v"))
    edges = cut(out.join(ends, "via").join(many.withColumnRenamed("m", "v"), "v", "left_semi").select("u", "v", "via"))
    pure = cut(unprocessed.join(ptr, F.col("id") == F.col("child")).select(F.col("id").alias("u"), F.col("parent").alias("v"), F.col("parent").alias("via")))
    if edges.count() + pure.count() <= local_links:
        strong = cut(edges.unionByName(pure).coalesce(1).mapInPandas(_strong_in_task, "u string, v string, via string"))
        found = strong
    else:
        strong = cut(_strong_edges(edges))
        found = strong.select("u", "via").unionByName(_functional_cycles(unprocessed).select(F.col("id").alias("u"), F.col("id").alias("via")))
    marked = cut(found.select(F.explode(F.array("u", "via")).alias("id")).distinct())
    hops = done.select("id", "jumps")
    far = strong.join(hops, F.col("via") == F.col("id")).agg(F.max(F.size("jumps"))).first()[0] or 0
    for k in range(far - 1, -1, -1):
        up = hops.join(marked, "id", "left_semi").select(F.get("jumps", F.lit(k)).alias("id")).filter("id is not null")
        marked = cut(marked.unionByName(up).distinct())
    return marked


def _next_to(links: DataFrame, waiting: DataFrame, free: DataFrame) -> DataFrame:
    """(id, parent): the ids of waiting from which a free id is reached, with the smallest parent one link nearer to it; one round per link."""
    up = cut(links.join(waiting.withColumnRenamed("id", "child"), "child", "left_semi"))
    free, parts = free.select(F.col("id").alias("parent")), []
    while True:
        step = cut(up.join(free, "parent", "left_semi").groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent")))
        parts.append(step)
        if not step.limit(1).count():
            return reduce(DataFrame.unionByName, parts)
        older, up = up, cut(up.join(step.select(F.col("id").alias("child")), "child", "left_anti"))
        drop_cut(older)
        free = step.select(F.col("id").alias("parent"))


def forest(links: DataFrame, nodes: DataFrame, on_chain: DataFrame | None = None) -> DataFrame:
    """(id, parent, ptr, n_links_up, on_chain, meets, hangs, end, jumps, depth, up): every node in the tree of its first parent.

    A node is clear if it has a way to a root that meets no closed chain; its first parent is its smallest clear one. Other nodes with a way to
    a root take the smallest parent that is one link nearer to a clear node. The rest hang (hangs), below their smallest parent off every chain
    or else their smallest parent; a node of a chain that hangs has no ptr unless a parent is off every chain. up is the way from end to id, both included;
    meets tells that a closed chain is on it.
    """
    chain = (closed_chains(links, nodes) if on_chain is None else on_chain).select(F.col("id").alias("c_id"))
    flagged = links.join(chain, F.col("parent") == F.col("c_id"), "left").select("child", "parent", F.col("c_id").isNotNull().alias("bad"))
    first = flagged.groupBy("child").agg(F.min(F.struct("bad", "parent")).alias("p"), F.count(F.lit(1)).alias("n_links_up"))
    told = nodes.join(first, F.col("id") == F.col("child"), "left").join(chain, F.col("id") == F.col("c_id"), "left").withColumn("on_chain", F.col("c_id").isNotNull())
    # a node of a chain points off its chain or nowhere, so no way goes round
    base = cut(told.select("id", F.col("p.parent").alias("parent"), F.when(~(F.col("on_chain") & F.col("p.bad")), F.col("p.parent")).alias("ptr"), F.coalesce("n_links_up", F.lit(0)).alias("n_links_up"), "on_chain"))
    ends = base.filter("on_chain").select(F.col("id").alias("e_id"))

    def place(base: DataFrame) -> DataFrame:
        start = base.select("id", "ptr", F.lit(0).cast("bigint").alias("depth"), F.array("id").alias("up"), F.col("on_chain").alias("meets"))
        done, _ = climb(start, {"depth": lambda me, up: up + me + 1, "up": lambda me, up: F.concat(up, me), "meets": lambda me, up: me | up})
        return cut(base.join(done, "id").join(ends, F.col("end") == F.col("e_id"), "left").withColumn("hangs", F.col("e_id").isNotNull()).drop("e_id"))

    placed = place(base)
    if not placed.filter("meets").limit(1).count():
        return placed
    # only nodes whose first way meets a chain may have to change; they look for a clear way, then for any way
    meets = placed.filter("meets").select("id", "on_chain")
    free = placed.filter("not meets").select("id")
    clear = cut(_next_to(links, meets.filter("not on_chain").select("id"), free).select("id"))
    all_clear = free.unionByName(clear)
    best = links.join(clear.withColumnRenamed("id", "child"), "child", "left_semi").join(all_clear.withColumnRenamed("id", "parent"), "parent", "left_semi").groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent"))
    others = _next_to(links, meets.select("id").join(clear, "id", "left_anti"), all_clear)
    new = best.unionByName(others).select(F.col("id").alias("s_id"), F.col("parent").alias("s_parent"))
    moved = base.join(new, F.col("id") == F.col("s_id"), "left")
    return place(cut(moved.select("id", F.coalesce("s_parent", "parent").alias("parent"), F.coalesce("s_parent", "ptr").alias("ptr"), "n_links_up", "on_chain")))


def hierarchy(links: DataFrame, nodes: DataFrame, separator: str = " > ", on_chain: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """(id, parent, status, depth, root, path, pre, size, n_links_up): nested sets over each node's first parent.

    Siblings, and trees, are in the order of their ids. A node with several parents hangs in the tree of its first one (see `forest`, whose result may be given as placed); its other links are counted in
    n_links_up, and what is reached through them is in `reachable`, not in the ranges. d is in the tree below a
    exactly if a.pre < d.pre < a.pre + a.size. status is 'tree', 'on_chain' or 'below_chain' (no way to
    a root at all); the last two have no depth, root, path or range. A path holds nodes of a closed chain only where no way without them exists. Roots have depth 0.
    """
    placed = forest(links, nodes, on_chain) if placed is None else placed
    done = cut(placed.filter("not hangs"))
    rounds = done.agg(F.max(F.size("jumps"))).first()[0] or 0
    sizes = cut(done.select("id", "jumps", F.lit(1).cast("bigint").alias("size")))
    for k in range(rounds):
        below = sizes.filter(F.size("jumps") > k).groupBy(F.get("jumps", F.lit(k)).alias("b_id")).agg(F.sum("size").alias("more"))
        sizes = cut(sizes.join(below, F.col("id") == F.col("b_id"), "left").select("id", "jumps", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    tree = cut(done.select("id", "ptr").join(sizes.select("id", "size"), "id"))
    # what lies before a node among its siblings, or before its tree among the trees
    ordered = ordered_prefix(tree, ["ptr"], ["id"], F.col("size"))
    offsets = ordered.select("id", "ptr", (F.col("before") + F.when(F.col("ptr").isNull(), 0).otherwise(1)).alias("offset"))
    pre, _ = climb(offsets, {"offset": lambda me, up: me + up})
    facts = done.select("id", "depth", F.col("end").alias("root"), F.array_join("up", separator).alias("path")).join(pre.select("id", F.col("offset").alias("pre")), "id").join(sizes.select("id", "size"), "id")
    status = F.when(F.col("on_chain"), "on_chain").when(F.col("hangs"), "below_chain").otherwise("tree")
    tree_only = lambda c: F.when(F.col("status") == "tree", F.col(c)).alias(c)
    return placed.select("id", "parent", status.alias("status"), "n_links_up").join(facts, "id", "left").select("id", "parent", "status", *map(tree_only, ("depth", "root", "path", "pre", "size")), "n_links_up")


def reachable(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(ancestor, descendant), distinct: every other node that is reached over one or more links, second parents and closed chains included.

    placed is `forest`. A way up follows the tree, or leaves it by a link that is not a first one. The nodes that have such links (doors) are few: each
    door is joined to the next door on its own way up and on the ways up of its other parents, that small graph is closed by doubling, and
    a node reaches what its way up holds and what the nearest door on it reaches.
    """
    ways = cut(placed.select("id", F.posexplode("up").alias("pos", "over")))
    other = cut(links.join(placed.select(F.col("id").alias("child"), F.col("ptr").alias("parent")).filter("parent is not null"), ["child", "parent"], "left_anti"))
    doors = cut(other.select(F.col("child").alias("door")).distinct())
    met = cut(ways.join(doors, F.col("over") == F.col("door"), "left_semi"))
    near = cut(met.groupBy("id").agg(F.max_by("over", "pos").alias("door")))
    # the next door strictly above a door, and the nearest on or above each of its other parents
    own = met.join(doors, F.col("id") == F.col("door"), "left_semi").filter("over <> id").groupBy("id").agg(F.max_by("over", "pos").alias("to")).select(F.col("id").alias("door"), "to")
    beyond = other.join(near.select(F.col("id").alias("parent"), F.col("door").alias("to")), "parent").select(F.col("child").alias("door"), "to")
    closed = cut(doors.select("door", F.col("door").alias("to")).unionByName(own).unionByName(beyond).distinct())
    n = closed.count()
    while n:
        closed = cut(closed.join(closed.select(F.col("door").alias("to"), F.col("to").alias("far")), "to").select("door", F.col("far").alias("to")).distinct())
        now = closed.count()
        if now == n:
            break
        n = now
    parents = closed.join(other.select(F.col("child").alias("to"), "parent"), "to").select("door", F.col("parent").alias("id")).distinct()
    held = cut(parents.join(ways.select("id", "over"), "id").select("door", F.col("over").alias("ancestor")).distinct())
    through = near.join(held, "door").select("ancestor", F.col("id").alias("descendant"))
    return ways.select(F.col("over").alias("ancestor"), F.col("id").alias("descendant")).unionByName(through).filter("ancestor <> descendant").distinct()


def descendants(facts: DataFrame, of: DataFrame, bucket: int = 256) -> DataFrame:
    """(ancestor, descendant) in the trees of first parents for the ids of `of`, by range join on preorder buckets; `reachable` has all links.

    The output is one row per pair, as long as the answer itself. An ancestor meets only the preorder buckets of its own range.
    """
    tops = facts.join(of.select("id").distinct(), "id", "left_semi").filter("pre is not null")
    ranges = tops.select(F.col("id").alias("ancestor"), F.col("pre").alias("lo"), (F.col("pre") + F.col("size")).alias("hi"))
    spread = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("hi") - 1) / bucket))))
    below = facts.filter("pre is not null").select(F.col("id").alias("descendant"), "pre", F.floor(F.col("pre") / bucket).alias("cell"))
    return spread.join(below, "cell").filter("pre > lo and pre < hi").select("ancestor", "descendant")
