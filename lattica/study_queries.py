"""Queries of the identifier, reshaping and statistics operators, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import reference_queries as R
from lattica.functions.ids import whole_number
from lattica.operators import evidence, identifiers, network, reshape, statistics
from lattica.session import cut, table


def id_classes(spark: SparkSession, d: str) -> DataFrame:
    """How many outside identifiers of each writing there are per id type."""
    m = table(spark, d, "gid2source_id").filter("source_id is not null")
    return m.groupBy("id_type_id", identifiers.id_class(F.col("source_id")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def gene_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Every gene named in the network with its symbol, or its own id for one."""
    genes = R.edges(spark, d).select(F.explode(F.array("a", "b")).alias("gene")).distinct()
    return identifiers.described(genes, "gene", table(spark, d, "gene_catalogue"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Genes that share an outside symbol, in any case and species, as groups."""
    m = table(spark, d, "gid2source_id").filter("id_type_id = 1")
    return m.select(F.upper(F.trim("source_id")).alias("group"), F.col("gid").alias("gene"), "tax_id")


def gene_orthologs(spark: SparkSession, d: str) -> DataFrame:
    genes = R.annotation(spark, d).select(F.col("item").alias("gene"))
    return identifiers.orthologs(genes, _groups(spark, d), 9606)


def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    """Outside identifiers resolved through transcripts, then genomic records, then symbols, then synonyms."""
    m = table(spark, d, "gid2source_id")
    step = lambda t: m.filter(F.col("id_type_id") == t).select(F.col("source_id").alias("form"), F.col("gid").alias("gene"))
    return identifiers.resolve(m, "source_id", [("transcript", step(5)), ("genomic", step(6)), ("symbol", step(1)), ("synonym", step(2))])


def converted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every catalogue row with the gene its symbol converts to."""
    rows = table(spark, d, "gene_catalogue").select("geneid", "symbol", "listed_at")
    return identifiers.convert_column(rows, "symbol", table(spark, d, "gid2source_id")).select("geneid", "symbol", "gene")


def species_names(spark: SparkSession, d: str) -> DataFrame:
    return identifiers.names_of_species(table(spark, d, "gene_catalogue"), table(spark, d, "gid2source_id"), 10090)


def species_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gene_catalogue").filter("geneid is not null")
    return g.groupBy("tax_id").agg(F.count_distinct("geneid").alias("n_genes"), F.count(F.lit(1)).alias("n_rows"))


def _network_and_listed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = R.edges(spark, d).select(F.explode(F.array("a", "b")).alias("item"))
    return a, table(spark, d, "gene_catalogue").select(F.col("geneid").alias("item"))


def genes_in_both(spark: SparkSession, d: str) -> DataFrame:
    return reshape.set_operation(*_network_and_listed(spark, d), "intersect")


def genes_in_one(spark: SparkSession, d: str) -> DataFrame:
    return reshape.set_operation(*_network_and_listed(spark, d), "either")


def first_reports(spark: SparkSession, d: str) -> DataFrame:
    """Where each interaction type and source comes first."""
    ia = table(spark, d, "interaction").withColumn("kind", F.concat_ws(":", "interaction_type_id", "ds"))
    return reshape.first_places(ia, "kind", ["ia_id"])


def score_bins(spark: SparkSession, d: str) -> DataFrame:
    """Test results counted by bins of log p."""
    b = reshape.binned(F.col("logp"), (-2, -3, -4, -6, -10, -20), (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7))
    return table(spark, d, "go_result").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def natural_names(spark: SparkSession, d: str) -> DataFrame:
    """List names in natural order: by text, then by their last number."""
    name, number = reshape.natural_key(F.col("list_name"))
    return table(spark, d, "go_result").select("list_name").dropna().distinct().select("list_name", name.alias("stem"), number.alias("number"))


def node_names(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the network with their gene type, unlisted ones as 'unknown'."""
    nodes = R.edges(spark, d).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return reshape.with_attribute(nodes, "node", table(spark, d, "gene_catalogue").select("geneid", "gene_type"), "gene_type", "unknown")


def term_thirds(spark: SparkSession, d: str) -> DataFrame:
    """The terms of go_result in three equal parts by id."""
    terms = table(spark, d, "go_result").select("go").dropna().distinct()
    return reshape.split_rows(terms, ["go"], 3)


def normal_scores(spark: SparkSession, d: str) -> DataFrame:
    r = statistics.normal_scores(table(spark, d, "go_result"), "categoryid", "z_score")
    return r.select(F.col("g").alias("categoryid"), F.col("x").alias("z_score"), "rank", F.round("z", 6).alias("z"))


def mean_tests(spark: SparkSession, d: str) -> DataFrame:
    """One-sample t of the combined score against 0.5 by source."""
    r = statistics.mean_test(table(spark, d, "interaction"), "ds", "score_combined", 0.5)
    return r.select(F.col("g").alias("ds"), "n", F.round("t", 6).alias("t"))


def paired_tests(spark: SparkSession, d: str) -> DataFrame:
    r = statistics.paired_test(table(spark, d, "interaction"), "ds", "score_combined", "score_physical")
    return r.select(F.col("g").alias("ds"), "n", F.round("t", 5).alias("t"))


def signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    r = statistics.signed_rank(table(spark, d, "interaction"), "ds", "score_combined", "score_physical")
    return r.select(F.col("g").alias("ds"), "n", F.round("w", 3).alias("w"), F.round("z", 5).alias("z"))


def score_correlation(spark: SparkSession, d: str) -> DataFrame:
    r = statistics.pearson_by_group(table(spark, d, "interaction"), "ds", "score_combined", "score_physical")
    return r.select(F.col("g").alias("ds"), "n", F.round("r", 6).alias("r"))


def robust_factor(spark: SparkSession, d: str) -> DataFrame:
    return statistics.robust_z_factor(table(spark, d, "interaction"), "ds", "score_combined", "legacy", "gridlink").withColumn("z_factor", F.round("z_factor", 4))


def two_way_tests(spark: SparkSession, d: str) -> DataFrame:
    """Sums of squares of the combined score by source and species."""
    r = statistics.two_way(table(spark, d, "interaction"), "ds", "tax_id", "score_combined")
    return r.select("source", F.round("ss", 4).alias("ss"), "df")


def list_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the mean log p of every two categories over the lists that both have; categories are few by nature."""
    df = table(spark, d, "go_result").filter("logp is not null and not isnan(logp) and categoryid is not null and list_name is not null")
    cells = cut(reshape.mean_cells(df, "categoryid", "list_name", "logp"))
    one, two = (cells.select(F.col("categoryid").alias(f"cat_{k}"), "list_name", F.col("mean").alias(k)) for k in "ab")
    met = one.join(two, "list_name").filter("cat_a < cat_b").groupBy("cat_a", "cat_b").agg(F.collect_list(F.struct("a", "b")).alias("p"))
    met = met.withColumn("a", F.col("p.a")).withColumn("b", F.col("p.b"))
    return met.select("cat_a", "cat_b", *[F.round(statistics.distance(m), 6).alias(m) for m in ("manhattan", "euclid", "pearson")])


def quantile_scores(spark: SparkSession, d: str) -> DataFrame:
    r = statistics.quantile_normalise(table(spark, d, "go_result"), "categoryid", "enrichment")
    return r.select(F.col("g").alias("categoryid"), F.col("x").alias("enrichment"), "rank", F.round("normalised", 6).alias("normalised"))


def symbol_contingency(spark: SparkSession, d: str) -> DataFrame:
    """Physical against strong reports: the four counts, chi-square with continuity correction."""
    ia = table(spark, d, "interaction")
    t = statistics.contingency(ia, ~F.isnan("score_physical") & (F.col("score_physical") > 0.5), ~F.isnan("score_combined") & (F.col("score_combined") > 0.5))
    return statistics.fisher_and_chi2(t).select("n11", "n10", "n01", "n00", F.round("chi2", 4).alias("chi2"))


def child_summary(spark: SparkSession, d: str) -> DataFrame:
    """The best reported child below each direct parent in each list."""
    from lattica.functions.ids import term_key
    from lattica.operators.enrichment import best_per_parent
    from lattica.term_queries import _results

    links = table(spark, d, "term2term").filter("distance = 1").select(term_key(F.col("term_id")).alias("term"), term_key(F.col("parent_term_id")).alias("parent")).dropna().distinct()
    return best_per_parent(_results(spark, d), links)


def gene_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Weighted evidence of each gene: two for each report as a hub's partner side, one for each annotation."""
    a = table(spark, d, "interaction").select(whole_number(F.col("gene_a")).alias("item")).dropna().groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("source", F.lit("network"))
    b = R.annotation(spark, d).groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("source", F.lit("terms"))
    both = a.unionByName(b).withColumn("list", F.lit("all"))
    return evidence.weighted_sum(both, {"network": 2.0, "terms": 1.0})


def combined_networks(spark: SparkSession, d: str) -> DataFrame:
    """The networks of two interaction types put together, the better score of an edge kept."""
    ia = table(spark, d, "interaction")
    types = [t for (t,) in ia.select("interaction_type_id").dropna().distinct().orderBy("interaction_type_id").limit(2).collect()]  # two numbers
    part = lambda t: network.canonical(ia.filter(F.col("interaction_type_id") == t), whole_number(F.col("gene_a")), whole_number(F.col("gene_b")), F.nanvl("score_combined", F.lit(0.0)))
    return network.combine(*map(part, types)).select("a", "b", F.round("score", 6).alias("score"))


def list_network(spark: SparkSession, d: str) -> DataFrame:
    """Edges among the genes of any list, single genes as links to themselves."""
    return network.with_singletons(R.edges(spark, d), R.lists(spark, d).select(F.col("item").alias("node")))


def list_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges inside every list."""
    return network.list_edges(R.edges(spark, d), R.lists(spark, d)).withColumn("score", F.round("score", 6))


def list_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every list outside it."""
    return network.list_neighbours(R.edges(spark, d), R.lists(spark, d)).select("list", "node", "links")


def pruned_network(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours left alone when the genes of all lists are taken out of the network."""
    return network.without_nodes(R.edges(spark, d), R.lists(spark, d).select(F.col("item").alias("node")))[1]


def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The smaller number of terms of both ends of every edge."""
    n = R.annotation(spark, d).groupBy(F.col("item").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return network.edge_evidence(R.edges(spark, d), n)


def network_parts(spark: SparkSession, d: str) -> DataFrame:
    """Components by size; their place is by nodes, edges, then name."""
    return network.component_sizes(cut(R.edges(spark, d)))


def score_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well the combined score tells physical reports from others."""
    ia = table(spark, d, "interaction").withColumn("y", F.when(F.col("score_physical").isNull() | F.isnan("score_physical"), 0).otherwise(1))
    return evidence.auc(ia, "y", "score_combined").withColumn("auc", F.round("auc", 6))


def evidence_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct numbers of terms per gene with the number of genes at or above each."""
    n = R.annotation(spark, d).groupBy("item").agg(F.count(F.lit(1)).alias("score"))
    return evidence.cutoffs(n, 3, 3000)


QUERIES = {f.__name__: f for f in (id_classes, gene_descriptions, gene_orthologs, resolved_ids, converted_rows, species_names, species_counts, genes_in_both, genes_in_one, first_reports, score_bins, natural_names, node_names, term_thirds, normal_scores, mean_tests, paired_tests, signed_ranks, score_correlation, robust_factor, two_way_tests, list_distances, quantile_scores, symbol_contingency, child_summary, gene_evidence, combined_networks, list_network, list_edges, list_neighbours, pruned_network, edge_evidence, network_parts, score_auc, evidence_cutoffs)}

_NODES = f"{R._EDGES}, nodes as (select a as gene from edges union select b from edges)"
_CLEAN = "x as (select ds as g, ia_id, tax_id, case when cast(score_combined as varchar) <> 'nan' then score_combined end as c, case when cast(score_physical as varchar) <> 'nan' then score_physical end as p from interaction)"
_STRIP = "regexp_replace(trim({c}), '([0-9])\\.[0-9]+$', '\\1')"
_KIND = """case when source_id is null or length(trim(source_id)) = 0 then null when regexp_matches(upper(trim(source_id)), '^[NX][MR]_[0-9]+') then 'transcript' when regexp_matches(upper(trim(source_id)), '^[NX]P_[0-9]+') then 'protein'
 when regexp_matches(upper(trim(source_id)), '^N[CGTW]_[0-9]+') then 'genomic' when regexp_matches(upper(trim(source_id)), '^X[A-Z]_[0-9]+') then 'predicted' when regexp_matches(upper(trim(source_id)), '^[A-Z]*ENS[A-Z]*[GTP][0-9]+') then 'ensembl'
 when regexp_matches(upper(trim(source_id)), '^[0-9]+$') then 'number' else 'symbol' end"""

SQL = {
    "gene_evidence": f"with {R._ANN}, a as (select {R._NUM.format(c='gene_a')} as item, 2.0 as w from interaction), b as (select * from a where item is not null union all select item, 1.0 from ann) select item, sum(w)::double as score from b group by 1",
    "list_network": f"with {R._EDGES}, {R._LISTS}, n as (select distinct item as node from lists), e as (select a, b from edges where a in (select node from n) and b in (select node from n)) select a, b from e union all select node, node from n where node not in (select a from e union all select b from e)",
    "list_edges": f"with {R._EDGES}, {R._LISTS} select x.list, a, b, round(score, 6) as score from edges join lists x on x.item = a join lists y on y.item = b and y.list = x.list",
    "list_neighbours": f"with {R._EDGES}, {R._SYM}, {R._LISTS} select l.list, v as node, count(distinct u) as links from sym join lists l on l.item = u where not exists (select 1 from lists m where m.list = l.list and m.item = v) group by 1, 2",
    "pruned_network": f"with {_NODES}, {R._LISTS}, n as (select distinct item as node from lists), e as (select a, b from edges where a not in (select node from n) and b not in (select node from n)) select gene as node from nodes where gene not in (select node from n) and gene not in (select a from e union all select b from e)",
    "edge_evidence": f"with {R._EDGES}, {R._ANN}, n as (select item, count(*)::double as v from ann group by 1) select a, b, least(coalesce(x.v, 0), coalesce(y.v, 0)) as evidence from edges left join n x on x.item = a left join n y on y.item = b",
    "network_parts": f"with comp as ({R.SQL['network_components']}), {R._EDGES}, s as (select component, count(*) as n_nodes from comp group by 1), l as (select component, count(*) as n_edges from edges join comp on comp.node = a where a <> b group by 1) select component, n_nodes, coalesce(n_edges, 0) as n_edges, row_number() over (order by n_nodes desc, coalesce(n_edges, 0) desc, component) as place from s left join l using (component)",
    "score_auc": """with x as (select score_combined as v, case when score_physical is null or cast(score_physical as varchar) = 'nan' then 0 else 1 end as y from interaction where score_combined is not null and cast(score_combined as varchar) <> 'nan'),
 p as (select v, count(*) filter (y = 1) as p, count(*) filter (y = 0) as n from x group by 1), c as (select *, coalesce(sum(n) over (order by v rows between unbounded preceding and 1 preceding), 0) as b from p) select round(sum(p * (b + n / 2.0)) / (sum(p)::double * sum(n)), 6) as auc from c""",
    "evidence_cutoffs": f"with {R._ANN}, s as (select count(*) as score from ann group by item), c as (select score, sum(count(*)) over (order by score desc) as n from s group by 1) select score, n::bigint as n from c where n >= 3 and n < 3000",
    "id_classes": f"select id_type_id, {_KIND} as kind, count(*) as n from gid2source_id where source_id is not null group by 1, 2",
    "gene_descriptions": f"with {_NODES}, c as (select geneid, min(symbol) as symbol, min(gene_type) as gene_type, min(tax_id) as tax_id from gene_catalogue where geneid is not null group by 1) select gene, coalesce(symbol, cast(gene as varchar)) as symbol, gene_type, tax_id from nodes left join c on geneid = gene",
    "gene_orthologs": f"""with {R._ANN}, ids as (select distinct item as gene from ann), g as (select distinct upper(trim(source_id)) as grp, gid as gene, tax_id from gid2source_id where id_type_id = 1 and source_id is not null and gid is not null and tax_id is not null)
 select distinct ids.gene, o.gene as ortholog from ids join g on g.gene = ids.gene join g o on o.grp = g.grp and o.tax_id = 9606 union select ids.gene, ids.gene from ids join g on g.gene = ids.gene and g.tax_id = 9606""",
    "resolved_ids": f"""with k as (select upper({_STRIP.format(c="source_id")}) as form, min(gid) as gene, id_type_id as t from gid2source_id where source_id is not null and gid is not null and id_type_id in (5, 6, 1, 2) group by 1, 3),
 o as (select form, gene, case t when 5 then 0 when 6 then 1 when 1 then 2 else 3 end as o, case t when 5 then 'transcript' when 6 then 'genomic' when 1 then 'symbol' else 'synonym' end as step from k), i as (select distinct source_id as input from gid2source_id where source_id is not null)
 select input, gene, step from i join o on o.form = upper({_STRIP.format(c="input")}) where o.form <> '' qualify row_number() over (partition by input order by o) = 1""",
    "converted_rows": f"with c as ({R.SQL['id_conversion']}) select g.geneid, g.symbol, c.gene from gene_catalogue g left join c on c.input = g.symbol",
    "species_names": """with g as (select geneid, symbol from gene_catalogue where tax_id = 10090 and geneid is not null) select geneid as gene, symbol as name from g where symbol is not null and symbol <> ''
 union select gid, trim(source_id) from gid2source_id where gid in (select geneid from g) and source_id is not null and trim(source_id) <> ''""",
    "species_counts": "select tax_id, count(distinct geneid) as n_genes, count(*) as n_rows from gene_catalogue where geneid is not null group by 1",
    "genes_in_both": f"with {_NODES} select gene as item from nodes intersect select geneid from gene_catalogue where geneid is not null",
    "genes_in_one": f"with {_NODES}, l as (select distinct geneid as gene from gene_catalogue where geneid is not null) select coalesce(nodes.gene, l.gene) as item from nodes full join l on l.gene = nodes.gene where nodes.gene is null or l.gene is null",
    "first_reports": "select concat_ws(':', cast(interaction_type_id as varchar), ds) as kind, min(ia_id) as ia_id from interaction group by 1",
    "score_bins": "select case when logp is null or cast(logp as varchar) = 'nan' then null when logp < -20 then 0.7 when logp < -10 then 0.6 when logp < -6 then 0.5 when logp < -4 then 0.4 when logp < -3 then 0.3 when logp < -2 then 0.2 else 0.1 end::double as bin, count(*) as n from go_result group by 1",
    "natural_names": "select distinct list_name, regexp_replace(list_name, '[0-9]+$', '') as stem, coalesce(try_cast(nullif(regexp_extract(list_name, '([0-9]+)$', 1), '') as bigint), -1) as number from go_result where list_name is not null",
    "node_names": f"with {_NODES}, c as (select geneid, min(gene_type) as gene_type from gene_catalogue where geneid is not null group by 1) select gene as node, coalesce(gene_type, 'unknown') as gene_type from nodes left join c on geneid = gene",
    "term_thirds": "with t as (select distinct go from go_result where go is not null) select go, ((row_number() over (order by go) - 1) * 3 // (select count(*) from t))::int as part from t",
    "mean_tests": f"with {_CLEAN} select g as ds, count(c) as n, round((avg(c) - 0.5) / (stddev_samp(c) / sqrt(count(c))), 6) as t from x where g is not null and c is not null group by 1 having count(c) > 1",
    "paired_tests": f"with {_CLEAN} select g as ds, count(*) as n, round(avg(c - p) / (stddev_samp(c - p) / sqrt(count(*))), 5) as t from x where g is not null and c is not null and p is not null group by 1 having count(*) > 1 and stddev_samp(c - p) > 0",
    "signed_ranks": f"""with {_CLEAN}, d as (select g, c - p as d, abs(c - p) as a from x where g is not null and c is not null and p is not null and c - p <> 0),
 r as (select *, rank() over (partition by g order by a) + (count(*) over (partition by g, a) - 1) / 2.0 as rk, count(*) over (partition by g, a) as t from d),
 s as (select g, count(*) as n, sum(case when d > 0 then rk else 0 end) as w, sum(t::double * t - 1) as tt from r group by 1)
 select g as ds, n, round(w, 3) as w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - tt / 48), 5) as z from s""",
    "score_correlation": f"with {_CLEAN} select g as ds, count(*) as n, round(coalesce(corr(c, p), 0), 6) as r from x where g is not null and c is not null and p is not null group by 1",
    "robust_factor": f"""with {_CLEAN}, m as (select g, median(c) as m from x where g in ('legacy', 'gridlink') and c is not null group by 1), a as (select x.g, 1.4826 * median(abs(c - m)) as a from x join m using (g) where c is not null group by 1)
 select round(1 - 3 * sum(a) / abs(max(case when g = 'legacy' then m end) - max(case when g = 'gridlink' then m end)), 4) as z_factor from m join a using (g)""",
    "two_way_tests": f"""with {_CLEAN}, f as (select g as r, tax_id as k, c as v from x where g is not null and tax_id is not null and c is not null), t as (select sum(v) * sum(v) / count(*) as base from f),
 r as (select sum(q) as ss, count(*) as k from (select sum(v) * sum(v) / count(*) as q from f group by r)), c as (select sum(q) as ss, count(*) as k from (select sum(v) * sum(v) / count(*) as q from f group by k)), b as (select sum(q) as ss from (select sum(v) * sum(v) / count(*) as q from f group by r, k))
 select 'row' as source, round(r.ss - base, 4) as ss, (r.k - 1)::double as df from r, t union all select 'column', round(c.ss - base, 4), (c.k - 1)::double from c, t union all select 'interaction', round(b.ss - r.ss - c.ss + base, 4), ((r.k - 1) * (c.k - 1))::double from r, c, b, t""",
    "list_distances": """with m as (select categoryid as cat, list_name, avg(logp) as v from go_result where logp is not null and cast(logp as varchar) <> 'nan' and categoryid is not null and list_name is not null group by 1, 2)
 select a.cat as cat_a, b.cat as cat_b, round(avg(abs(a.v - b.v)), 6) as manhattan, round(sqrt(avg((a.v - b.v) * (a.v - b.v))), 6) as euclid, round(coalesce((1 - corr(a.v, b.v)) / 2, 0.5), 6) as pearson from m a join m b using (list_name) where a.cat < b.cat group by 1, 2""",
    "quantile_scores": """with x as (select categoryid as g, enrichment as v from go_result where categoryid is not null and enrichment is not null and cast(enrichment as varchar) <> 'nan'), o as (select g, v, row_number() over (partition by g order by v) as i, rank() over (partition by g order by v) as r from x),
 m as (select i, avg(v) as n from o group by 1) select distinct g as categoryid, v as enrichment, r as rank, round(n, 6) as normalised from o join m on m.i = o.r""",
    "symbol_contingency": """with f as (select coalesce(cast(score_physical as varchar) <> 'nan' and score_physical > 0.5, false) as r, coalesce(cast(score_combined as varchar) <> 'nan' and score_combined > 0.5, false) as c from interaction),
 t as (select count(*) filter (r and c) as n11, count(*) filter (r and not c) as n10, count(*) filter (not r and c) as n01, count(*) filter (not r and not c) as n00 from f)
 select *, round((n11 + n10 + n01 + n00)::double * power(greatest(abs(n11::double * n00 - n10::double * n01) - (n11 + n10 + n01 + n00) / 2.0, 0), 2) / ((n11 + n10)::double * (n01 + n00) * (n11 + n01) * (n10 + n00)), 4) as chi2 from t""",
    "child_summary": """with l as (select distinct upper(trim(term_id)) as term, upper(trim(parent_term_id)) as parent from term2term where distance = 1 and trim(term_id) <> '' and trim(parent_term_id) <> ''),
 r as (select list_name as list, go as term, logp, case when cast(enrichment as varchar) <> 'nan' then enrichment end as e from go_result where logp is not null and cast(logp as varchar) <> 'nan' and list_name is not null and go is not null)
 select list, parent, term, logp from r join l using (term) qualify row_number() over (partition by list, parent order by logp, e desc nulls last, term) = 1""",
    "combined_networks": f"""with t as (select distinct interaction_type_id as t from interaction where interaction_type_id is not null order by 1 limit 2), raw as (select {R._NUM.format(c="gene_a")} as x, {R._NUM.format(c="gene_b")} as y, case when cast(score_combined as varchar) <> 'nan' then score_combined else 0 end as s from interaction where interaction_type_id in (select t from t))
 select least(x, y) as a, greatest(x, y) as b, round(max(s), 6) as score from raw where x is not null and y is not null group by 1, 2""",
}
