"""Queries of the training-data problems over the given tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.ids import whole_numbers
from lattica.llm import idmap, mixing, packing, pii, setjoin, tokens, topn
from lattica.session import cut, maybe_broadcast, spread, table


#: Words of this field that are written before an identifier or added to it and tell nothing about which one it is.
LABELS = ("gene", "symbol", "sym", "acc", "id", "ref")
ADDED = ("protein[ _-]coding", "putative", "gene", "human", "mouse", "rat")


def _mapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    inputs = table(spark, d, "id_conversion").select("conv_id", "inputid")
    refs = table(spark, d, "ref_identifier").select(F.col("source_id").alias("ref_source_id"), F.col("gene_id").alias("ref_gene_id"))
    return idmap.map_values(inputs, "inputid", refs, "ref_source_id", labels=LABELS, added=ADDED)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d)[0].select("conv_id", F.col("ref").alias("source_id"))


def p1_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every input row with its entry, its gene and the edits between them, or as unmatched."""
    matched, unmatched = _mapped(spark, d)
    genes = table(spark, d, "ref_identifier").groupBy("source_id").agg(F.min("gene_id").alias("gene_id"))
    known = matched.join(maybe_broadcast(genes), F.col("ref") == F.col("source_id"), "left").select("conv_id", "inputid", F.col("ref").alias("source_id"), "gene_id", "edits", F.lit("matched").alias("status"))
    return known.unionByName(unmatched.select("conv_id", "inputid", F.when(F.col("why") == "tie", "unmatched (tie)").otherwise("unmatched").alias("status")), allowMissingColumns=True)


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Inputs that stand for no entry, with how often they were entered."""
    return _mapped(spark, d)[1].groupBy("inputid").agg(F.count(F.lit(1)).alias("n_rows"))


def _term_sets(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "term_annotation").filter("go is not null").select("go", F.explode(whole_numbers(F.col("genes"))).alias("gene"))
    return flat.groupBy("go").agg(F.collect_set("gene").alias("items")).select(F.col("go").alias("id"), "items")


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    classes, members = setjoin.set_classes(cut(_term_sets(spark, d)))
    return setjoin.similar_classes(classes), members


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.expand(*_similar(spark, d)).select(F.col("id_a").alias("go_a"), F.col("id_b").alias("go_b"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Every term with genes, the class of terms with the same genes, and its number of similar terms."""
    pairs, members = _similar(spark, d)
    return setjoin.link_counts(cut(pairs), members).select(F.col("id").alias("go"), F.col("cid").alias("class_go"), "n_links")


def _best(spark: SparkSession, d: str, n: int) -> DataFrame:
    return topn.top_n(table(spark, d, "go_result"), ["list_name", "categoryid"], "go", "logp", "enrichment", n)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, 3).select("list_name", "categoryid", "go")


def p4_top5(spark: SparkSession, d: str) -> DataFrame:
    """The best five terms of every list and category with their rank."""
    return _best(spark, d, 5)


CAPACITY = 2048


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", tokens.token_count(F.col("text")).alias("n_tokens"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text, one row per piece."""
    return packing.pack(_counted(spark, d), ["doc_id"], "n_tokens", CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are and how much of them is unused."""
    return packing.fill_report(p7_containers(spark, d), CAPACITY)


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """The selected documents in mixing order."""
    return mixing.mix(cut(_counted(spark, d)), table(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return mixing.mix(cut(_counted(spark, d)), table(spark, d, "mix_target"))[1]


def _read_people(spark: SparkSession, d: str) -> tuple[DataFrame, pii.Field]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs, pii.train(docs, "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs, field = _read_people(spark, d)
    return pii.find(docs, field).select("doc_id", "pii_kind", "pii_text").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    return pii.redact(*_read_people(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_mapped, p1_unmatched, p3_found, p3_links, p4_found, p4_top5, p7_containers, p7_fill, p8_selection, p8_shares, p9_found, p9_redacted)}
# read apart from the operator: cut at the separators, each part read as a number
_SETS = """sets as (select distinct go, item from (select go, cast(try_cast(nullif(unnest(string_split_regex(coalesce(genes, ''), '[,;|\\s]+')), '') as double) as bigint) as item from term_annotation) where go is not null and item is not null),
 sizes as (select go, count(*) as n from sets group by 1), pairs as (select a.go as go_a, b.go as go_b, count(*) as s from sets a join sets b on a.item = b.item and a.go < b.go group by 1, 2),
 near as (select go_a, go_b from pairs join sizes x on x.go = go_a join sizes y on y.go = go_b where 10 * s >= 7 * (x.n + y.n - s))"""
_RANKED = """b as (select *, row_number() over (partition by list_name, categoryid, go order by logp, e desc nulls last) as r from (select *, case when cast(enrichment as varchar) <> 'nan' then enrichment end as e from go_result)
 where logp is not null and cast(logp as varchar) <> 'nan' and list_name is not null and categoryid is not null and go is not null),
 k as (select *, row_number() over (partition by list_name, categoryid order by logp, e desc nulls last, go) as rank from b where r = 1)"""

SQL: dict[str, str] = {
    "p3_found": f"with {_SETS} select go_a, go_b from near",
    "p3_links": f"""with {_SETS}, same as (select go, min(go) over (partition by t) as class_go from (select go, string_agg(cast(item as varchar), ',' order by item) as t from sets group by 1)),
 ends as (select go_a as go from near union all select go_b from near), c as (select go, count(*) as n from ends group by 1) select same.go, class_go, coalesce(n, 0) as n_links from same left join c using (go)""",
    "p4_found": f"with {_RANKED} select list_name, categoryid, go from k where rank <= 3",
    "p4_top5": f"with {_RANKED} select list_name, categoryid, go, logp, e as enrichment, rank from k where rank <= 5",
}
