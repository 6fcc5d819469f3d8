"""Queries for the enrichment, membership, network, identifier and statistics operators over the given tables, with their SQL.

A list is a source of documents and its items are the genes the documents are about; terms come from term_annotation, the network
from interaction. Every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.ids import term_key, whole_number, whole_numbers
from lattica.operators import clustering, enrichment, evidence, identifiers, network, reshape, statistics
from lattica.session import cut, table
from lattica.streaming.counts import windowed_counts


def lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.lower(F.trim("source")).alias("list"), F.col("gid").alias("item")).dropna().distinct()


def annotation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "term_annotation").select(F.col("go").alias("term"), F.explode(whole_numbers(F.col("genes"))).alias("item")).dropna().distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    ia = table(spark, d, "interaction").filter("interaction_type_id = 11")
    return network.canonical(ia, whole_number(F.col("gene_a")), whole_number(F.col("gene_b")), F.nanvl("score_combined", F.lit(0.0)))


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    """Genes of the list with the smallest name, the starting set of the network queries."""
    held = lists(spark, d)
    first = held.agg(F.min("list")).first()[0]
    return held.filter(F.col("list") == first).select(F.col("item").alias("node"))


_LISTS = "lists as (select distinct lower(trim(source)) as list, gid as item from documents where source is not null and gid is not null)"
_ANN = "ann as (select distinct go as term, item from (select go, cast(unnest(regexp_extract_all(coalesce(genes,''), '(\\d+)(?:\\.0*)?', 1)) as bigint) as item from term_annotation) where go is not null)"
_NUM = "try_cast(nullif(regexp_extract({c}, '(\\d+)(?:\\.0*)?', 1), '') as bigint)"
_EDGES = f"""raw as (select {_NUM.format(c="gene_a")} as x, {_NUM.format(c="gene_b")} as y, case when cast(score_combined as varchar) <> 'nan' then score_combined else 0 end as s from interaction where interaction_type_id = 11),
edges as (select least(x, y) as a, greatest(x, y) as b, max(s) as score from raw where x is not null and y is not null group by 1, 2)"""
_SYM = "sym as (select a as u, b as v, score from edges where a <> b union all select b, a, score from edges where a <> b)"
_CHOSEN = f"{_LISTS}, chosen as (select item as node from lists where list = (select min(list) from lists))"
_TAIL = """ln(list_sum(list_transform(range(greatest({x}, {n1} + {n2} - {n}), least({n1}, {n2}) + 1), lambda k: exp(lgamma({n1} + 1) - lgamma(k + 1) - lgamma({n1} - k + 1) + lgamma({n} - {n1} + 1) - lgamma({n2} - k + 1)
 - lgamma({n} - {n1} - {n2} + k + 1) - lgamma({n} + 1) + lgamma({n2} + 1) + lgamma({n} - {n2} + 1)))))"""
_TESTED = f"""with {_LISTS}, {_ANN}, sizes as (select term, count(*) as n_term from ann group by 1 having count(*) <= 800),
cat as (select ann.term, ann.item, n_term from ann join sizes using (term)), held as (select l.list, l.item from lists l where l.item in (select item from cat)), ls as (select list, count(*) as n_list from held group by 1),
tot as (select count(distinct item) as n_total, count(distinct term) as n_terms from cat),
hit as (select list, term, n_term, count(*) as n_overlap from held join cat using (item) where n_term < 800 group by 1, 2, 3 having count(*) >= 2),
tested as (select list, term, n_overlap, n_term, n_list, n_total, n_terms, n_overlap / n_list / (n_term / n_total) as enrichment,
 (n_overlap * n_total::double - n_term * n_list::double) / sqrt(n_term::double * n_list * (n_total - n_term) * (n_total - n_list) / (n_total - 1)) as z_score,
 greatest({_TAIL.format(x="n_overlap", n="n_total", n1="n_term", n2="n_list")} / ln(10), -100) as logp from hit join ls using (list), tot)"""


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.enrich(lists(spark, d), annotation(spark, d), min_overlap=2, p_cutoff=0.05)


def _tested(spark: SparkSession, d: str) -> DataFrame:
    """The rows of _enriched without adjusted p."""
    return enrichment.tested_pairs(lists(spark, d), annotation(spark, d), min_overlap=2, p_cutoff=0.05)


def enrich_lists(spark: SparkSession, d: str) -> DataFrame:
    r = _enriched(spark, d)
    return r.select("list", "term", "n_overlap", "n_term", "n_list", "n_total", *[F.round(c, 4).alias(c) for c in ("enrichment", "z_score", "logp")])


def adjusted_p(spark: SparkSession, d: str) -> DataFrame:
    tested = _enriched(spark, d).withColumn("n_tests", F.lit(annotation(spark, d).select("term").distinct().count()).cast("bigint"))
    # adjusting goes by the order of p, so equal values must be equal to the last digit
    r = enrichment.adjust(tested.withColumn("logp", F.round("logp", 8)), "logp", "n_tests")
    return r.select("list", "term", *[F.round(c, 4).alias(c) for c in ("bonferroni_log10", "holm_log10", "bh_log10")])


def list_membership(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.membership(lists(spark, d)).select("item", "pattern", "n_lists", F.round("weighted_rank", 6).alias("weighted_rank"))


def list_overlap(spark: SparkSession, d: str) -> DataFrame:
    held = cut(lists(spark, d))
    universe = held.select("item").distinct().count()
    return enrichment.list_overlaps(held, universe).select("list_a", "list_b", "n_a", "n_b", "n_both", (F.round("logp", 4) + 0.0).alias("logp"))


def _clustered_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every enriched term with its best p over all lists."""
    return enrichment.merge_lists(_tested(spark, d))


def term_kappa(spark: SparkSession, d: str) -> DataFrame:
    r = enrichment.term_kappa(annotation(spark, d), _clustered_terms(spark, d))
    return r.select("term_a", "term_b", "shared", F.round("kappa", 5).alias("kappa"), F.round("max_share", 5).alias("max_share"))


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    best = cut(_clustered_terms(spark, d))
    return clustering.cluster_heads(best, cut(clustering.similar_groups(annotation(spark, d), best)))


def term_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clustered(spark, d).select("term", "group_id", "first_in_group", "logp", "enrichment", "best_enrichment")


def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    return clustering.representatives(_clustered(spark, d), 3, 20).select("term", "group_id", "in_group", "logp")


def merged_terms(spark: SparkSession, d: str) -> DataFrame:
    r = enrichment.merge_lists(_enriched(spark, d))
    return r.select("term", "n_lists", F.round("logp", 4).alias("logp"), F.round("enrichment", 4).alias("enrichment"))


def rank_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """The best rank cut of every category of go_result by log p."""
    r = enrichment.rank_scores(table(spark, d, "go_result"), "categoryid", "logp")
    return r.select("key", "n", "best_rank", "n_best", F.round("logp", 4).alias("logp"))


def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return network.degrees(edges(spark, d))


def network_density(spark: SparkSession, d: str) -> DataFrame:
    return network.density(cut(edges(spark, d))).withColumn("density", F.round("density", 9))


def sub_network(spark: SparkSession, d: str) -> DataFrame:
    return network.subnetwork(edges(spark, d), _chosen(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


def hop_distance(spark: SparkSession, d: str) -> DataFrame:
    return network.hops(edges(spark, d), _chosen(spark, d), 2)


def over_connected(spark: SparkSession, d: str) -> DataFrame:
    r = network.over_connected(cut(edges(spark, d)), _chosen(spark, d), min_links=2, p_cutoff=0.05, min_enrichment=1.5)
    return r.select("node", "links", "degree", *[F.round(c, 4).alias(c) for c in ("enrichment", "z_score", "logp")])


def indirect_links(spark: SparkSession, d: str) -> DataFrame:
    c = _chosen(spark, d)
    return network.indirect_edges(edges(spark, d), c, c).select("a", "b", F.round("score", 6).alias("score"))


def k_core(spark: SparkSession, d: str) -> DataFrame:
    return network.core(edges(spark, d), 3).select("a", "b")


def network_components(spark: SparkSession, d: str) -> DataFrame:
    return network.components(edges(spark, d))


def strong_modules(spark: SparkSession, d: str) -> DataFrame:
    """Dense clusters of the whole network."""
    return network.dense_clusters(cut(edges(spark, d)))


def propagated_scores(spark: SparkSession, d: str) -> DataFrame:
    prior = _chosen(spark, d).withColumn("score", F.lit(1.0))
    return network.propagate(cut(edges(spark, d)), prior).withColumn("score", F.round("score", 4))


def id_conversion(spark: SparkSession, d: str) -> DataFrame:
    return identifiers.convert(table(spark, d, "gene_catalogue"), "symbol", table(spark, d, "gid2source_id"))


def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "term2term").select(term_key(F.col("term_id")).alias("term"), term_key(F.col("parent_term_id")).alias("ancestor"), "distance")
    return identifiers.least_distance(t)


def gene_text(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "term_annotation").filter("description is not null").groupBy(F.col("go").alias("term")).agg(F.min("description").alias("description"))
    ann = annotation(spark, d)
    return identifiers.term_text(ann.select("item"), ann, terms)


def gene_profile(spark: SparkSession, d: str) -> DataFrame:
    p = reshape.profile(table(spark, d, "interaction").select("interaction_type_id", "score_combined", "ds", "tax_id"))
    return p.select("column", "n_null", "n_unique", "most_popular", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def melted_scores(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "interaction")
    clean = df.select("ia_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("score_physical", "score_combined")])
    return reshape.melt(clean, ["ia_id"], ["score_physical", "score_combined"])


def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "go_result").filter("logp is not null and not isnan(logp) and categoryid is not null")
    cats = sorted(r[0] for r in df.select("categoryid").distinct().collect())  # a handful of kinds of terms
    r = reshape.pivot_mean(df, "list_name", "categoryid", "logp", [str(c) for c in cats])
    return r.select("list_name", *[F.round(str(c), 6).alias(f"c{c}") for c in cats])


def category_means(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the pivot over every category of the table, in long form."""
    df = table(spark, d, "go_result").filter("logp is not null and not isnan(logp) and categoryid is not null")
    return reshape.mean_cells(df, "list_name", "categoryid", "logp").withColumn("mean", F.round("mean", 6))


def unlisted_genes(spark: SparkSession, d: str) -> DataFrame:
    ia = table(spark, d, "interaction")
    a = ia.select(F.explode(F.array(whole_number(F.col("gene_a")), whole_number(F.col("gene_b")))).alias("gene")).dropna().distinct()
    return reshape.minus(a, table(spark, d, "gene_catalogue").select(F.col("geneid").alias("gene")), "gene")


def list_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return reshape.fingerprint(lists(spark, d), "list", "item")


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    r = statistics.describe(table(spark, d, "interaction"), "ds", "score_combined")
    return r.select(F.col("g").alias("ds"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "rms")])


def score_mad(spark: SparkSession, d: str) -> DataFrame:
    return statistics.mad(table(spark, d, "interaction"), "ds", "score_combined").select(F.col("g").alias("ds"), F.round("mad", 6).alias("mad"))


def enrichment_gini(spark: SparkSession, d: str) -> DataFrame:
    return statistics.gini(table(spark, d, "go_result"), "categoryid", "enrichment").select(F.col("g").alias("categoryid"), F.round("gini", 6).alias("gini"))


def score_otsu(spark: SparkSession, d: str) -> DataFrame:
    return statistics.otsu(table(spark, d, "interaction"), "ds", "score_combined").select(F.col("g").alias("ds"), F.round("threshold", 6).alias("threshold"))


def score_ranks(spark: SparkSession, d: str) -> DataFrame:
    return statistics.average_ranks(table(spark, d, "go_result"), "categoryid", "z_score").select(F.col("g").alias("categoryid"), F.col("x").alias("z_score"), "c", "rank")


def score_tests(spark: SparkSession, d: str) -> DataFrame:
    r = statistics.one_way(table(spark, d, "interaction"), "ds", "score_combined")
    return r.select(*[F.round(c, 3).alias(c) for c in ("f", "h")])


def score_test_p(spark: SparkSession, d: str) -> DataFrame:
    """p of the same tests; no SQL has these tails."""
    return statistics.one_way(table(spark, d, "interaction"), "ds", "score_combined").select("f_p", "h_p")


def score_z_factor(spark: SparkSession, d: str) -> DataFrame:
    return statistics.z_factor(table(spark, d, "interaction"), "ds", "score_combined", "legacy", "gridlink").withColumn("z_factor", F.round("z_factor", 4))


def evidence_table(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of each gene: on a list, in an enriched term, in the sub-network of the chosen list."""
    hit = lists(spark, d).select("item", F.lit("hit").alias("source"), F.lit(1.0).alias("value")).distinct()
    terms = _enriched(spark, d).select("term").distinct()
    go = annotation(spark, d).join(terms, "term", "left_semi").select("item", F.lit("go").alias("source"), F.lit(1.0).alias("value")).distinct()
    net = network.subnetwork(edges(spark, d), _chosen(spark, d)).select(F.explode(F.array("a", "b")).alias("item"), F.lit("ppi").alias("source"), F.lit(1.0).alias("value")).distinct()
    return evidence.wide(evidence.assemble(hit, go, net), ["hit", "go", "ppi"])


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    r = windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day")
    return r.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "kind", "n")


QUERIES = {f.__name__: f for f in (
    enrich_lists, adjusted_p, list_membership, list_overlap, term_kappa, term_clusters, cluster_representatives, merged_terms, rank_enrichment, node_degree, network_density, sub_network,
    hop_distance, over_connected, indirect_links, k_core, network_components, strong_modules, propagated_scores, id_conversion, nearest_ancestor, gene_text, gene_profile, melted_scores,
    category_pivot, category_means, unlisted_genes, list_fingerprint, score_summary, score_mad, enrichment_gini, score_otsu, score_ranks, score_tests, score_test_p, score_z_factor, evidence_table, event_windows,
)}

_KEPT = f"{_TESTED}, kept as (select * from tested where logp <= log10(0.05))"
_X = "(select ds as g, score_combined as x from interaction where ds is not null and score_combined is not null and cast(score_combined as varchar) <> 'nan')"

def _rounds_core(k: int, rounds: int) -> str:
    """The k-core by peeling in a fixed number of rounds, more than these tables need."""
    steps = ["e0 as materialized (select a, b from edges where a <> b)"]
    for i in range(rounds):
        ok = f"(select node from (select a as node from e{i} union all select b from e{i}) group by 1 having count(*) >= {k})"
        steps.append(f"e{i + 1} as materialized (select a, b from e{i} where a in {ok} and b in {ok})")
    return f"with {_EDGES}, {', '.join(steps)} select a, b from e{rounds}"


def _rounds_components(rounds: int) -> str:
    steps = ["c0 as materialized (select node, node as c from (select a as node from edges union select b from edges))"]
    for i in range(rounds):
        steps.append(f"c{i + 1} as materialized (select x.node, least(x.c, coalesce(min(y.c), x.c)) as c from c{i} x left join sym on sym.v = x.node left join c{i} y on y.node = sym.u group by x.node, x.c)")
    return f"with {_EDGES}, {_SYM}, {', '.join(steps)} select node, c as component from c{rounds}"


def _rounds_propagation(rounds: int, alpha: float = 0.5) -> str:
    steps = ["f0 as materialized (select node, y, y as f from y)"]
    for i in range(rounds):
        steps.append(f"f{i + 1} as materialized (select n.node, n.y, {alpha} * coalesce(sum(w.w * m.f), 0) + {1 - alpha} * n.y as f from f{i} n left join w on w.v = n.node left join f{i} m on m.node = w.u group by n.node, n.y)")
    return f"""with {_EDGES}, {_CHOSEN}, links as (select a as u, b as v, score from edges where a <> b and score > 0 union all select b, a, score from edges where a <> b and score > 0), d as (select u, sum(score) as d from links group by 1),
 w as materialized (select l.u, l.v, l.score / sqrt(x.d * y.d) as w from links l join d x on x.u = l.u join d y on y.u = l.v), y as (select d.u as node, case when d.u in (select node from chosen) then 1.0::double else 0.0::double end as y from d),
 {', '.join(steps)} select node, round(f, 4) as score from f{rounds}"""


SQL = {
    "k_core": _rounds_core(3, 14),
    "network_components": _rounds_components(14),
    "propagated_scores": _rounds_propagation(26),
    "category_means": "select list_name, categoryid, count(logp) as n, round(avg(logp), 6) as mean from go_result where logp is not null and cast(logp as varchar) <> 'nan' and categoryid is not null group by 1, 2",
    "enrich_lists": f"{_KEPT} select list, term, n_overlap, n_term, n_list, n_total, round(enrichment, 4) as enrichment, round(z_score, 4) as z_score, round(logp, 4) as logp from kept",
    "adjusted_p": f"""{_KEPT}, p as (select list, term, round(logp, 8) as lp, (select count(distinct term) from ann) as n from kept),
 r as (select *, rank() over (order by lp) as rk, count(*) over (order by lp range between unbounded preceding and current row) as last from p),
 a as (select *, lp + log10(n) - log10(last) as b, lp + log10(greatest(1, n - rk + 1)) as h from r)
 select list, term, round(least(0, lp + log10(n)), 4) as bonferroni_log10, round(least(0, max(h) over (order by lp range between unbounded preceding and current row)), 4) as holm_log10,
 round(least(0, min(b) over (order by lp desc range between unbounded preceding and current row)), 4) as bh_log10 from a""",
    "merged_terms": f"{_KEPT} select term, count(distinct list) as n_lists, round(min(logp), 4) as logp, round(max(enrichment), 4) as enrichment from kept group by 1",
    "list_membership": f"""with {_LISTS}, names as (select list, row_number() over (order by list) as pos, count(*) as n from lists group by 1), items as (select distinct item from lists)
 select i.item, 'M' || string_agg(case when l.list is null then '0' else '1' end, '' order by n.pos) as pattern, count(l.list) as n_lists, round(sum(case when l.list is not null then 1 / n.n else 0 end), 6) as weighted_rank
 from items i cross join names n left join lists l on l.item = i.item and l.list = n.list group by 1""",
    "list_overlap": f"""with {_LISTS}, s as (select list, count(*) as n from lists group by 1), u as (select count(distinct item) as m from lists),
 p as (select a.list as list_a, b.list as list_b, count(*) as n_both from lists a join lists b on a.item = b.item and a.list < b.list group by 1, 2)
 select list_a, list_b, x.n as n_a, y.n as n_b, n_both, round(greatest(case when n_both <= greatest(0, x.n + y.n - m) then 0 else least(0, {_TAIL.format(x="n_both", n="m", n1="x.n", n2="y.n")}) end / ln(10), -100), 4) + 0.0::double as logp
 from p join s x on x.list = list_a join s y on y.list = list_b, u""",
    "term_kappa": f"""{_KEPT}, best as (select distinct term from kept), t as (select term, item from ann where term in (select term from best)),
 s as (select term, count(*) as n from t group by 1), u as (select count(distinct item)::double as m from t), p as (select a.term as term_a, b.term as term_b, count(*) as shared from t a join t b on a.item = b.item and a.term < b.term group by 1, 2),
 k as (select *, x.n::double as na, y.n::double as nb, m - x.n - y.n + 2 * shared as o, (x.n::double * y.n + (m - x.n) * (m - y.n)) / m as c from p join s x on x.term = term_a join s y on y.term = term_b, u)
 select term_a, term_b, shared, round((o - c + 1e-10) / (m - c + 1e-10), 5) as kappa, round(greatest(shared / na, shared / nb), 5) as max_share from k""",
    "rank_enrichment": f"""with r as (select categoryid as key, logp as s from go_result where categoryid is not null and logp is not null and cast(logp as varchar) <> 'nan'), t as (select count(*) as m from r),
 u as (select s, sum(c) over (order by s) as rk from (select s, count(*) as c from r group by 1)), p as (select key, s, count(*) as c from r group by 1, 2),
 q as (select key, rk::bigint as rk, (sum(c) over (partition by key order by s))::bigint as i, (sum(c) over (partition by key))::bigint as n, m from p join u using (s), t),
 z as (select *, greatest(case when i <= greatest(0, n + rk - m) then 0 else least(0, {_TAIL.format(x="i", n="m", n1="n", n2="rk")}) end / ln(10), -100) as lp from q)
 select key, n, rk as best_rank, i as n_best, round(lp, 4) as logp from z qualify row_number() over (partition by key order by lp, rk) = 1""",
    "id_conversion": """with i as (select distinct symbol as input, upper(trim(symbol)) as up from gene_catalogue where symbol is not null),
 pos as (select input, up, unnest(range(2, length(up) + 1)) as k from i), cuts as (select input, up, k from pos where not regexp_matches(substr(up, k, 1), '[A-Za-z0-9_]') and regexp_matches(substr(up, k - 1, 1), '[A-Za-z0-9_]')),
 forms as (select input, up as form, 0 as generation from i where length(up) > 0 union all select input, substr(up, 1, k - 1), row_number() over (partition by input order by k desc) from cuts),
 known as (select upper(trim(source_id)) as form, gid as gene, id_type_id as type, case id_type_id when 1 then 0 when 5 then 1 when 13 then 2 when 2 then 3 when 6 then 4 else 9 end as priority from gid2source_id where gid is not null and source_id is not null)
 select input, form, gene, type from forms join known using (form) qualify row_number() over (partition by input order by generation, priority, gene, type, form) = 1""",
    "gene_profile": " union all ".join(f"""select '{c}' as "column", (select count(*) from interaction where {x} is null) as n_null, (select count(distinct {x}) from interaction) as n_unique,
 (select cast(v as varchar) from (select {x} as v, count(*) as n from interaction where {x} is not null group by 1) order by n desc, cast(v as varchar) limit 1) as most_popular,
 {f"(select round(avg({x}), 4) from interaction)" if num else "null::double"} as mean, {f"(select round(stddev_samp({x}), 4) from interaction)" if num else "null::double"} as sd"""
     for c, x, num in (("interaction_type_id", "interaction_type_id", True), ("score_combined", "(case when cast(score_combined as varchar) <> 'nan' then score_combined end)", True), ("ds", "ds", False), ("tax_id", "tax_id", True))),
    "score_tests": """with x as (select ds as g, score_combined as v from interaction where ds is not null and score_combined is not null and cast(score_combined as varchar) <> 'nan'), n as (select count(*)::double as n, count(distinct g) as k, sum(v) as s, sum(v * v) as q from x),
 b as (select sum(s * s / m) as b from (select sum(v) as s, count(*) as m from x group by g)), r as (select g, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as rk, count(*) over (partition by v) as t from x),
 h as (select sum(r * r / m) as rr from (select sum(rk::double) as r, count(*) as m from r group by g)), t as (select sum(t::double * t - 1) as t from r)
 select round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 3) as f, round((12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 3) as h from n, b, h, t""",
    "node_degree": f"with {_EDGES}, {_SYM} select u as node, count(*) as degree from sym group by 1",
    "network_density": f"with {_EDGES} select n_nodes, n_edges, round(n_edges / (n_nodes::double * n_nodes), 9) as density from (select count(distinct node) as n_nodes from (select a as node from edges union select b from edges)), (select count(*) as n_edges from edges where a <> b)",
    "sub_network": f"with {_EDGES}, {_CHOSEN} select a, b, round(score, 6) as score from edges where a in (select node from chosen) and b in (select node from chosen)",
    "hop_distance": f"""with {_EDGES}, {_SYM}, {_CHOSEN}, one as (select distinct v as node from sym join chosen on u = node where v not in (select node from chosen)),
 two as (select distinct v as node from sym join one on u = node where v not in (select node from chosen) and v not in (select node from one))
 select node, 0 as distance from chosen union all select node, 1 from one union all select node, 2 from two""",
    "over_connected": f"""with {_EDGES}, {_SYM}, {_CHOSEN}, nodes as (select a as node from edges union select b from edges), t as (select count(*) as n, count(*) filter (node in (select node from chosen)) as m from nodes),
 p as (select u as node, count(*) as degree, count(*) filter (v in (select node from chosen)) as links from sym group by 1 having count(*) filter (v in (select node from chosen)) >= 2),
 q as (select node, links, degree, links / m / (degree / n) as enrichment, (links * n::double - degree * m::double) / sqrt(degree::double * m * (n - degree) * (n - m) / (n - 1)) as z_score, greatest({_TAIL.format(x="links", n="n", n1="degree", n2="m")} / ln(10), -100) as logp from p, t)
 select node, links, degree, round(enrichment, 4) as enrichment, round(z_score, 4) as z_score, round(logp, 4) as logp from q where enrichment > 1.5 and logp <= log10(0.05)""",
    "indirect_links": f"""with {_EDGES}, {_SYM}, {_CHOSEN}, s as (select * from sym where u in (select node from chosen)), two as (select least(x.u, y.u) as a, greatest(x.u, y.u) as b, max(least(x.score, y.score)) as score from s x join s y on x.v = y.v and x.u <> y.u group by 1, 2)
 select a, b, round(score, 6) as score from two where not exists (select 1 from edges e where e.a = two.a and e.b = two.b)""",
    "nearest_ancestor": "select upper(trim(term_id)) as term, upper(trim(parent_term_id)) as ancestor, min(distance) as distance from term2term where trim(term_id) <> '' and trim(parent_term_id) <> '' group by 1, 2",
    "gene_text": f"""with {_ANN}, s as (select term, count(*) as n from ann group by 1), t as (select go as term, min(description) as description from term_annotation where description is not null group by 1),
 r as (select item, description, row_number() over (partition by item order by n, term) as r from ann join s using (term) join t using (term)) select item, string_agg(description, '; ' order by r) as text from r where r <= 3 group by 1""",
    "melted_scores": """with c as (select ia_id, case when cast(score_physical as varchar) <> 'nan' then score_physical end as p, case when cast(score_combined as varchar) <> 'nan' then score_combined end as q from interaction)
 select ia_id, 'score_physical' as variable, p as value from c where p is not null union all select ia_id, 'score_combined', q from c where q is not null union all select ia_id, null, null from c where p is null and q is null""",
    "category_pivot": "select list_name, " + ", ".join(f"round(coalesce(avg(logp) filter (categoryid = {c}), 0), 6) as c{c}" for c in (3, 5, 11, 19, 20, 21, 24, 27)) + " from go_result where logp is not null and cast(logp as varchar) <> 'nan' and categoryid is not null group by 1",
    "unlisted_genes": f"select distinct gene from (select {_NUM.format(c='gene_a')} as gene from interaction union all select {_NUM.format(c='gene_b')} from interaction) where gene is not null and gene not in (select geneid from gene_catalogue where geneid is not null)",
    "list_fingerprint": f"with {_LISTS} select list, count(distinct item) as n, md5(string_agg(cast(item as varchar), ' ' order by cast(item as varchar))) as md5 from lists group by 1",
    "score_summary": f"select g as ds, count(x) as n, round(avg(x), 6) as mean, round(median(x), 6) as median, round(stddev_samp(x), 6) as sd, round(sqrt(avg(x * x)), 6) as rms from {_X} group by 1",
    "score_mad": f"with r as {_X}, m as (select g, median(x) as md from r group by 1) select g as ds, round(median(abs(x - md)) * 1.4826, 6) as mad from r join m using (g) group by 1",
    "enrichment_gini": """with r as (select categoryid, enrichment as x, row_number() over (partition by categoryid order by enrichment) as i, count(*) over (partition by categoryid) as n from go_result where categoryid is not null and enrichment is not null and cast(enrichment as varchar) <> 'nan')
 select categoryid, round((max(n) + 1 - 2 * sum((n + 1 - i) * x) / sum(x)) / max(n), 6) as gini from r group by 1""",
    "score_otsu": f"""with r as {_X}, s as (select g, min(x) as lo, max(x) as hi from r group by 1), h as (select g, lo, hi, cast(least(63, floor((x - lo) / ((hi - lo) / 64))) as int) as b, count(*) as c from r join s using (g) group by 1, 2, 3, 4),
 k as (select *, sum(c) over (partition by g order by b) as n0, sum(c * b) over (partition by g order by b) as s0, sum(c) over (partition by g) as n, sum(c * b) over (partition by g) as s from h),
 v as (select *, case when n0 < n then n0::double * (n - n0) * power(s0 / n0 - (s - s0) / (n - n0), 2) else 0 end as w from k) select g as ds, round(lo + (1 + b) * (hi - lo) / 64, 6) as threshold from v qualify row_number() over (partition by g order by w desc, b) = 1""",
    "score_ranks": """with f as (select categoryid, z_score + 0.0::double as z_score, count(*) as c from go_result where categoryid is not null and cast(z_score as varchar) <> 'nan' group by 1, 2)
 select categoryid, z_score, c, cast(coalesce(sum(c) over (partition by categoryid order by z_score rows between unbounded preceding and 1 preceding), 0) as double) + (c + 1) / 2 as rank from f""",
    "score_z_factor": f"select round(1 - 3 * (stddev_pop(x) filter (g = 'legacy') + stddev_pop(x) filter (g = 'gridlink')) / abs(avg(x) filter (g = 'legacy') - avg(x) filter (g = 'gridlink')), 4) as z_factor from {_X}",
    "evidence_table": f"""{_KEPT}, {_EDGES}, chosen as (select item as node from lists where list = (select min(list) from lists)), net as (select * from edges where a in (select node from chosen) and b in (select node from chosen)),
 e as (select distinct item, 'hit' as s from lists union select distinct item, 'go' from ann where term in (select term from kept) union select a, 'ppi' from net union select b, 'ppi' from net)
 select item, max(case when s = 'hit' then 1.0::double else 0 end) as hit, max(case when s = 'go' then 1.0::double else 0 end) as go, max(case when s = 'ppi' then 1.0::double else 0 end) as ppi from e group by 1""",
    "event_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type as kind, count(*) as n from events group by 1, 2",
}
