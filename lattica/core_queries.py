"""Queries of the general problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.ids import term_key, whole_number
from lattica.operators import compress as C
from lattica.operators import hierarchy as H
from lattica.operators import orphans as O
from lattica.session import cut, drop_cut, table

HOT_SHARE = 0.01


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    ia = table(spark, d, "interaction")
    score = F.when(~F.isnan("score_combined"), F.col("score_combined"))
    return C.pair_sides(ia, whole_number(F.col("gene_a")), whole_number(F.col("gene_b")), {"score": score})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "interaction").count()
    per_gene = C.profile(C.compress(_pairs(spark, d), F.col("key"), F.col("value")))
    return C.hot_keys(per_gene, total, HOT_SHARE).select(F.col("key").alias("geneid"))


def p2_genes(spark: SparkSession, d: str) -> DataFrame:
    """Rows, partners, most frequent partner and score sum of every gene."""
    per_gene = C.profile(C.compress(_pairs(spark, d), F.col("key"), F.col("value"), {"score_sum": F.col("score")}), ["score_sum"])
    return per_gene.select(F.col("key").alias("geneid"), "n_rows", F.col("n_values").alias("n_partners"), F.col("mode_value").alias("top_partner"), F.col("mode_n").alias("top_partner_rows"), F.round("score_sum", 3).alias("score_sum"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and 90th percentile of the combined score of every gene, over its compressed values."""
    scores = C.compress(_pairs(spark, d), F.col("key"), F.col("score"))
    return C.weighted_percentiles(scores, [0.5, 0.9]).select(F.col("key").alias("geneid"), "fraction", F.col("percentile").alias("score"))


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Direct links of both tables in one frame; an id carries its table in front."""
    one = table(spark, d, "term2term").filter("distance = 1").select(F.lit("term2term").alias("t"), term_key(F.col("term_id")).alias("c"), term_key(F.col("parent_term_id")).alias("p"))
    two = table(spark, d, "e_go2go").filter("distance = 1").select(F.lit("e_go2go").alias("t"), term_key(F.col("child_go_id")).alias("c"), term_key(F.col("parent_go_id")).alias("p"))
    both = one.unionByName(two)
    return H.clean_links(both, F.concat("t", F.lit("|"), "c"), F.concat("t", F.lit("|"), "p"))


def _split(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.substring_index("id", "|", 1).alias("link_table"), F.expr("substring(id, instr(id, '|') + 1)").alias("term_id"), *more)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _split(H.closed_chains(*_links(spark, d)))


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and nested-set range of every term; terms on or below a closed chain are told by status.

    n_in_tree is the length of the range; n_descendants counts every term from which the term is reached over direct links, and n_ancestors the reverse.
    """
    strip = lambda c: F.expr(f"substring({c}, instr({c}, '|') + 1)").alias(c)
    links, nodes = map(cut, _links(spark, d))
    placed = H.forest(links, nodes)
    pairs = cut(H.reachable(links, placed))
    for side in ("ancestor", "descendant"):
        counts = pairs.groupBy(F.col("descendant" if side == "ancestor" else "ancestor").alias("id")).agg(F.count(F.lit(1)).alias(f"n_{side}s"))
        nodes = nodes.join(counts, "id", "left")
    facts = H.hierarchy(links, nodes.select("id"), placed=placed).join(nodes.na.fill(0, ["n_ancestors", "n_descendants"]), "id")
    facts = facts.withColumn("path", F.regexp_replace("path", r"(term2term|e_go2go)\|", ""))
    return _split(facts, strip("parent"), "status", "depth", strip("root"), "path", "pre", (F.col("size") - 1).alias("n_in_tree"), "n_descendants", "n_ancestors", "n_links_up")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every term with every other term that reaches it over direct links of its table, through any parent."""
    links, nodes = map(cut, _links(spark, d))
    pairs = H.reachable(links, H.forest(links, nodes))
    return _split(pairs.withColumnRenamed("ancestor", "id"), F.expr("substring(descendant, instr(descendant, '|') + 1)").alias("descendant_id"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    ia = table(spark, d, "interaction")
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("text")) for c in ("gene_a", "gene_b")]))
    a = ia.select("ia_id", "loaded_at", sides.alias("s")).select(F.lit("interaction").alias("ref_table"), "s.ref_field", F.col("ia_id").alias("ref_row"), whole_number(F.col("s.text")).alias("key"), F.col("loaded_at").alias("at"))
    b = table(spark, d, "gid2source_id").select(F.lit("gid2source_id").alias("ref_table"), F.lit("gid").alias("ref_field"), F.col("map_id").alias("ref_row"), F.col("gid").alias("key"), F.col("loaded_at").alias("at"))
    return a.unionByName(b)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    deltas = O.existence_deltas(table(spark, d, "gene_catalogue"), F.col("geneid"), F.col("listed_at"), F.col("withdrawn_at"))
    return O.orphan_rows(_references(spark, d), O.epochs(O.add_changes(None, deltas)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_field", "ref_row")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and the genes they name, per table, field and month of loading."""
    return O.orphan_counts(_orphans(spark, d))


def p6_state(spark: SparkSession, d: str) -> DataFrame:
    """Genes that are referred to and not listed after all changes, applied in six batches as they arrived.

    References arrive when they are loaded. Of the catalogue the withdrawals arrive one batch after their time, so some come late.
    """
    at = F.col("at").cast("timestamp")
    refs = _references(spark, d).select("key", at.alias("at"), F.lit(1).alias("refs"), F.lit(0).alias("existing"))
    deltas = O.existence_deltas(table(spark, d, "gene_catalogue"), F.col("geneid"), F.col("listed_at"), F.col("withdrawn_at"))
    listed = deltas.select("key", at.alias("at"), F.lit(0).alias("refs"), F.col("existence").alias("existing"))
    half_year = F.floor(F.months_between(F.coalesce("at", F.lit("1970-01-01").cast("timestamp")), F.lit("2023-01-01").cast("timestamp")) / 6)
    batch = F.least(F.lit(5), F.greatest(F.lit(0), half_year + F.when(F.col("existing") < 0, 1).otherwise(0)))
    changes = refs.unionByName(listed).withColumn("batch", batch)
    # signed counts are sums, so each batch is reduced to its keys in one pass before they are applied in turn
    per_batch = cut(changes.filter("key is not null").groupBy("batch", "key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing")))
    state = None
    for b in range(6):
        older, state = state, cut(O.apply_deltas(state, per_batch.filter(F.col("batch") == b)))
        drop_cut(older)
    return O.orphan_report(state).select(F.col("key").alias("geneid"), F.col("refs").alias("n_references"))


QUERIES = {f.__name__: f for f in (p2_found, p2_genes, p2_percentiles, p5_found, p5_hierarchy, p5_descendants, p6_found, p6_counts, p6_state)}

_NUM = "try_cast(nullif(regexp_extract({0}, '(\\d+)(?:\\.0*)?', 1), '') as bigint)"
_ENDS = f"ends as (select {_NUM.format('gene_a')} as a, {_NUM.format('gene_b')} as b, case when cast(score_combined as varchar) <> 'nan' then score_combined end as s, loaded_at, ia_id from interaction)"
_SIDES = f"{_ENDS}, sides as (select a as k, b as v, s from ends where a is not null union all select b, a, s from ends where b is not null and a is distinct from b)"
_LINKS = """links as (select distinct t, c, p from (select 'term2term' as t, nullif(upper(trim(term_id)), '') as c, nullif(upper(trim(parent_term_id)), '') as p, distance from term2term
 union all select 'e_go2go', nullif(upper(trim(child_go_id)), ''), nullif(upper(trim(parent_go_id)), ''), distance from e_go2go) where distance = 1 and c is not null and p is not null)"""
_REACH = f"{_LINKS}, reach as (select t, c as s, p as n from links union select reach.t, s, p from reach join links on links.t = reach.t and links.c = reach.n)"
_NODES = """select distinct t, id from (select 'term2term' as t, nullif(upper(trim(term_id)), '') as id from term2term where distance = 1 union all select 'term2term', nullif(upper(trim(parent_term_id)), '') from term2term where distance = 1
 union all select 'e_go2go', nullif(upper(trim(child_go_id)), '') from e_go2go where distance = 1 union all select 'e_go2go', nullif(upper(trim(parent_go_id)), '') from e_go2go where distance = 1) where id is not null"""
_REFS = f"""{_ENDS}, refs as (select 'interaction' as ref_table, 'gene_a' as ref_field, ia_id as ref_row, a as k, loaded_at from ends union all select 'interaction', 'gene_b', ia_id, b, loaded_at from ends
 union all select 'gid2source_id', 'gid', map_id, gid, loaded_at from gid2source_id),
orphans as (select * from refs where k is not null and not exists (select 1 from gene_catalogue g where g.geneid = k and g.listed_at <= refs.loaded_at and (g.withdrawn_at is null or refs.loaded_at < g.withdrawn_at)))"""

SQL = {
    "p2_found": f"with {_SIDES} select k as geneid from sides group by 1 having count(*) >= 0.01 * (select count(*) from interaction)",
    "p2_genes": f"""with {_SIDES}, f as (select k, v, count(*) as n from sides group by 1, 2), m as (select k, v, n from f where v is not null qualify row_number() over (partition by k order by n desc, v) = 1)
 select x.k as geneid, x.n as n_rows, x.d as n_partners, m.v as top_partner, m.n as top_partner_rows, round(x.s, 3) as score_sum from (select k, count(*) as n, count(distinct v) as d, sum(s) as s from sides group by 1) x left join m on m.k = x.k""",
    "p2_percentiles": f"""with {_SIDES}, o as (select k, s, row_number() over (partition by k order by s) as i, count(*) over (partition by k) as n from sides where s is not null)
 select k as geneid, f.fraction, min(s) as score from o, (select unnest([0.5::double, 0.9::double]) as fraction) f where i >= greatest(1, ceil(f.fraction * n)) group by 1, 2""",
    "p5_found": f"with recursive {_REACH} select distinct t as link_table, s as term_id from reach where s = n",
    "p5_descendants": f"with recursive {_REACH} select distinct t as link_table, n as term_id, s as descendant_id from reach where s <> n",
    "p5_hierarchy": f"""with recursive {_REACH}, chain as (select distinct t, s as id from reach where s = n), nodes as ({_NODES}),
 roots as (select t, id from nodes where not exists (select 1 from links l where l.t = nodes.t and l.c = nodes.id)),
 clear as (select t, id from roots union select l.t, l.c from clear k join links l on l.t = k.t and l.p = k.id where not exists (select 1 from chain x where x.t = l.t and x.id = l.c)),
 steps as (select t, id, 0 as d from clear union select l.t, l.c, d + 1 from steps k join links l on l.t = k.t and l.p = k.id where d < 60 and not exists (select 1 from clear x where x.t = l.t and x.id = l.c)),
 far as (select t, id, min(d) as d from steps group by 1, 2),
 up as (select l.t, l.c, l.p, row_number() over (partition by l.t, l.c order by case when fc.d = 0 then case when fp.d = 0 then 0 else 1 end when fc.d is not null then case when fp.d = fc.d - 1 then 0 else 1 end else case when xp.id is null then 0 else 1 end end, l.p) as r,
  count(*) over (partition by l.t, l.c) as n from links l left join far fc on fc.t = l.t and fc.id = l.c left join far fp on fp.t = l.t and fp.id = l.p left join chain xp on xp.t = l.t and xp.id = l.p),
 tree as (select t, id, id as root, 0 as depth, [t || '|' || id] as path from roots union all select u.t, u.c, root, depth + 1, list_append(path, u.t || '|' || u.c) from tree join up u on u.t = tree.t and u.p = tree.id and u.r = 1 join far on far.t = u.t and far.id = u.c),
 sized as (select x as id, count(*) as size from (select unnest(path) as x from tree) group by 1), placed as (select *, row_number() over (order by path) - 1 as pre from tree),
 below as (select t, n as id, count(distinct s) as k from reach where s <> n group by 1, 2), above as (select t, s as id, count(distinct n) as k from reach where s <> n group by 1, 2)
 select nodes.t as link_table, nodes.id as term_id, up.p as parent, case when chain.id is not null then 'on_chain' when far.id is null then 'below_chain' else 'tree' end as status,
  case when chain.id is null then depth end as depth, case when chain.id is null then root end as root, case when chain.id is null then regexp_replace(array_to_string(path, ' > '), '(term2term|e_go2go)\\|', '', 'g') end as path,
  case when chain.id is null then pre end as pre, case when chain.id is null then size - 1 end as n_in_tree, coalesce(below.k, 0) as n_descendants, coalesce(above.k, 0) as n_ancestors, coalesce(up.n, 0) as n_links_up
 from nodes left join up on up.t = nodes.t and up.c = nodes.id and up.r = 1 left join chain on chain.t = nodes.t and chain.id = nodes.id left join far on far.t = nodes.t and far.id = nodes.id
 left join placed on placed.t = nodes.t and placed.id = nodes.id left join sized on sized.id = nodes.t || '|' || nodes.id left join below on below.t = nodes.t and below.id = nodes.id left join above on above.t = nodes.t and above.id = nodes.id""",
    "p6_found": f"with {_REFS} select ref_table, ref_field, ref_row from orphans",
    "p6_counts": f"with {_REFS} select ref_table, ref_field, strftime(date_trunc('month', loaded_at), '%Y-%m') as period, count(*) as n_orphans, count(distinct k) as n_keys from orphans group by 1, 2, 3",
    "p6_state": f"""with {_REFS}, e as (select geneid, sum(1 - case when withdrawn_at is not null then 1 else 0 end) as x from gene_catalogue where geneid is not null and listed_at is not null and (withdrawn_at is null or withdrawn_at > listed_at) group by 1)
 select k as geneid, count(*) as n_references from refs left join e on e.geneid = k where k is not null group by 1 having coalesce(max(x), 0) <= 0""",
}
