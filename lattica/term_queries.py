"""Queries over the term catalogue, test results and lists, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import reference_queries as R
from lattica.core_queries import _LINKS, _links, _split
from lattica.operators import hierarchy as H
from lattica.operators import terms as T
from lattica.session import cut, table

MIN_SIZE, MAX_SIZE, MAX_LOGP = 3, 100, -2.0


def _results(spark: SparkSession, d: str) -> DataFrame:
    """go_result with usable values: (list, term, logp, enrichment, z_score)."""
    df = table(spark, d, "go_result").filter("logp is not null and not isnan(logp) and list_name is not null and go is not null")
    return df.select(F.col("list_name").alias("list"), F.col("go").alias("term"), "logp", F.when(~F.isnan("enrichment"), F.col("enrichment")).alias("enrichment"), F.when(~F.isnan("z_score"), F.col("z_score")).alias("z_score"))


def merged_retested(spark: SparkSession, d: str) -> DataFrame:
    """Terms of several lists tested again on the union of these lists."""
    r = T.merge_retested(R.lists(spark, d), R.annotation(spark, d), R._tested(spark, d))
    return r.select("term", "pattern", "n_lists", *[F.round(c, 4).alias(c) for c in ("logp", "enrichment", "z_score")], "merged")


def evidence_items(spark: SparkSession, d: str) -> DataFrame:
    return T.with_evidence(R.lists(spark, d), R.annotation(spark, d), R._enriched(spark, d), MIN_SIZE, MAX_SIZE, MAX_LOGP)


def term_specificity(spark: SparkSession, d: str) -> DataFrame:
    return T.specificity(cut(_results(spark, d))).withColumn("gini", F.round("gini", 6))


def term_links(spark: SparkSession, d: str) -> DataFrame:
    """The network of enriched terms with a kappa of 0.3 or more, single terms as links to themselves."""
    terms = cut(R._clustered_terms(spark, d).select("term"))
    from lattica.operators import enrichment

    # a kappa counts as it is given, rounded
    pairs = enrichment.similar_terms(R.annotation(spark, d), terms, 0.3 - 1e-5).withColumn("kappa", F.round("kappa", 5))
    return T.term_network(cut(pairs), terms)


def term_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Every term of go_result with the lists that report it and its best values."""
    return T.list_pattern(_results(spark, d)).select("term", "pattern", "n_lists", "logp", "enrichment")


def hits_by_list(spark: SparkSession, d: str) -> DataFrame:
    """Items of every list in every term of the catalogue."""
    ann = R.annotation(spark, d)
    return T.items_by_list(R.lists(spark, d), ann, ann.select("term"))


def hit_origins(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each term split by species of the listed genes: 9606 against all others."""
    genes = table(spark, d, "gene_catalogue").select(F.col("geneid").alias("item"), "tax_id")
    return T.compare_origins(genes.filter("tax_id = 9606"), genes.filter("tax_id <> 9606"), R.annotation(spark, d))


def category_terms(spark: SparkSession, d: str) -> DataFrame:
    return T.categories(table(spark, d, "term_annotation").withColumnRenamed("go", "term"), "category_name")


def category_parts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and terms of go_result by list, in the categories kept for quality control and in the others."""
    parts = T.category_split(table(spark, d, "go_result"), "categoryid", (19, 20, 21))
    return parts.groupBy("list_name", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("go").alias("n_terms"))


def item_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many reported terms each gene is in."""
    return T.terms_per_item(R.annotation(spark, d), table(spark, d, "go_result").select(F.col("go").alias("term")))


def term_item_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many listed genes each term has."""
    return T.items_per_term(R.annotation(spark, d), table(spark, d, "gene_catalogue").select(F.col("geneid").alias("item")))


def reported_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of each list that are in a term reported at log p <= -10."""
    best = _results(spark, d).filter("logp <= -10").select("term")
    return T.items_in(R.lists(spark, d), R.annotation(spark, d), best)


def terms_named(spark: SparkSession, d: str) -> DataFrame:
    return T.named_like(table(spark, d, "term_annotation"), "description", ["regulation", "kinase"]).select("go", "description").distinct()


def list_background(spark: SparkSession, d: str) -> DataFrame:
    return T.background(R.lists(spark, d), R.annotation(spark, d))


def top_parents(spark: SparkSession, d: str) -> DataFrame:
    """For every term the smallest of the children of roots above it, by its number of terms below."""
    links, nodes = map(cut, _links(spark, d))
    pairs = cut(H.reachable(links, H.forest(links, nodes)))
    roots = nodes.join(links.select(F.col("child").alias("id")).distinct(), "id", "left_anti")
    tops = links.join(roots.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("term")).distinct()
    sizes = pairs.groupBy(F.col("ancestor").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    best = T.smallest_parents(pairs.select(F.col("descendant").alias("term"), "ancestor"), cut(tops), sizes)
    return _split(best.withColumnRenamed("term", "id"), F.expr("substring(parent, instr(parent, '|') + 1)").alias("parent"), "n")


def dealt_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each category dealt in turn over the categories, best first."""
    best = _results_by_category(spark, d)
    return T.round_robin(best, "categoryid", [F.col("logp"), F.col("go")]).select("categoryid", "go", "logp", "place")


def _results_by_category(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "go_result").filter("logp is not null and not isnan(logp) and categoryid is not null and go is not null")
    return df.groupBy("categoryid", "go").agg(F.min("logp").alias("logp"))


QUERIES = {f.__name__: f for f in (merged_retested, evidence_items, term_specificity, term_links, term_patterns, hits_by_list, hit_origins, category_terms, category_parts, item_term_counts, term_item_counts, reported_items, terms_named, list_background, top_parents, dealt_terms)}

_RES = """res as (select list_name as list, go as term, logp, case when cast(enrichment as varchar) <> 'nan' then enrichment end as enrichment from go_result where logp is not null and cast(logp as varchar) <> 'nan' and list_name is not null and go is not null)"""
_AGAIN = R._TAIL.format(x="x", n="n_total", n1="n_term", n2="n_list")

SQL = {
    "merged_retested": f"""{R._KEPT}, pat as (select term, string_agg(list, '|' order by list) as pattern, count(*) as n_lists, min(logp) as logp, max(enrichment) as enrichment, max(z_score) as z_score from kept group by 1),
 un as (select distinct m.pattern, h.item from (select distinct pattern, list from kept join pat using (term) where n_lists > 1) m join held h using (list)), us as (select pattern, count(*) as n_list from un group by 1),
 re as (select pat.term, n_term, n_list, n_total, count(*) as x from pat join cat on cat.term = pat.term join un on un.pattern = pat.pattern and un.item = cat.item join us on us.pattern = pat.pattern, tot where n_lists > 1 group by 1, 2, 3, 4),
 a as (select *, greatest({_AGAIN} / ln(10), -100) as l, x / n_list / (n_term / n_total) as e, (x * n_total::double - n_term * n_list::double) / sqrt(n_term::double * n_list * (n_total - n_term) * (n_total - n_list) / (n_total - 1)) as z from re),
 f as (select pat.*, l, e, z, coalesce(l <= log10(0.5) and l <= pat.logp, false) as merged from pat left join a using (term))
 select term, pattern, n_lists, round(case when merged then l else logp end, 4) as logp, round(case when merged then e else enrichment end, 4) as enrichment, round(case when merged then z else z_score end, 4) as z_score, merged from f""",
    "evidence_items": f"{R._KEPT} select distinct l.list, l.item from lists l join kept using (list) join ann on ann.term = kept.term and ann.item = l.item where n_term between 3 and 100 and logp <= -2",
    "term_specificity": f"""with {_RES}, n as (select count(distinct list) as m from res), b as (select term, list, greatest(abs(min(logp)), 1) as x from res group by 1, 2),
 all_ as (select term, x from b union all select term, unnest(list_transform(range(m - k), lambda i: 1.0::double)) from (select term, count(*) as k from b group by 1), n), o as (select term, x, row_number() over (partition by term order by x) as i, count(*) over (partition by term) as c from all_)
 select term, round((max(c) + 1 - 2 * sum((c + 1 - i) * x) / sum(x)) / max(c), 6) as gini from o group by 1""",
    "term_links": f"""with kap as ({R.SQL["term_kappa"]}), t as (select distinct term from ({R.SQL["merged_terms"]})), e as (select term_a as a, term_b as b, kappa from kap where kappa >= 0.3)
 select * from e union all select term, term, 1.0 from t where term not in (select a from e union all select b from e)""",
    "term_patterns": f"with {_RES} select term, string_agg(distinct list, '|' order by list) as pattern, count(distinct list) as n_lists, min(logp) as logp, max(enrichment) as enrichment from res group by 1",
    "hits_by_list": f"with {R._LISTS}, {R._ANN} select term, list, count(*) as n_hits from ann join lists using (item) group by 1, 2",
    "hit_origins": f"""with {R._ANN}, o as (select distinct geneid as item from gene_catalogue where tax_id = 9606 and geneid is not null), n as (select distinct geneid as item from gene_catalogue where tax_id <> 9606 and geneid is not null)
 select term, count(*) filter (n.item is null) as n_old_only, count(*) filter (o.item is null) as n_new_only, count(*) filter (o.item is not null and n.item is not null) as n_both
 from ann left join o on o.item = ann.item left join n on n.item = ann.item where o.item is not null or n.item is not null group by 1""",
    "category_terms": "select category_name as category, count(distinct go) as n_terms from term_annotation where category_name is not null and go is not null group by 1",
    "category_parts": "select list_name, case when categoryid in (19, 20, 21) then 'special' else 'standard' end as part, count(*) as n_rows, count(distinct go) as n_terms from go_result group by 1, 2",
    "item_term_counts": f"with {R._ANN} select item, count(*) as n_terms from ann where term in (select go from go_result where go is not null) group by 1",
    "term_item_counts": f"with {R._ANN} select term, count(*) as n_items from ann where item in (select geneid from gene_catalogue where geneid is not null) group by 1",
    "reported_items": f"with {R._LISTS}, {R._ANN}, {_RES} select distinct list, item from lists where item in (select item from ann where term in (select term from res where logp <= -10))",
    "terms_named": "select distinct go, description from term_annotation where lower(description) like '%regulation%' and lower(description) like '%kinase%'",
    "list_background": f"with {R._LISTS}, {R._ANN} select item from lists union select item from ann",
    "top_parents": f"""with recursive {_LINKS}, reach as (select t, c as s, p as n from links union select reach.t, s, p from reach join links on links.t = reach.t and links.c = reach.n),
 tops as (select distinct t, c as id from links l where not exists (select 1 from links m where m.t = l.t and m.c = l.p)), sizes as (select t, n as id, count(distinct s) as k from reach where s <> n group by 1, 2),
 up as (select t, s, n from reach where s <> n union select t, id, id from tops), m as (select up.t, up.s, up.n, coalesce(k, 0) as k from up join tops on tops.t = up.t and tops.id = up.n left join sizes z on z.t = up.t and z.id = up.n)
 select t as link_table, s as term_id, n as parent, k as n from m qualify row_number() over (partition by t, s order by k, n) = 1""",
    "dealt_terms": """with b as (select categoryid, go, min(logp) as logp from go_result where logp is not null and cast(logp as varchar) <> 'nan' and categoryid is not null and go is not null group by 1, 2)
 select categoryid, go, logp, (row_number() over (partition by categoryid order by logp, go) - 1) * (select count(distinct categoryid) from b) + dense_rank() over (order by categoryid) - 1 as place from b""",
}
