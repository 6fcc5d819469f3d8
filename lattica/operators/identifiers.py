"""Resolving outside identifiers to genes, and questions about a term catalogue with a closure table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.session import maybe_broadcast

#: Priority of identifier types when several genes answer to a text (fixed values; less is better).
TYPE_ORDER = {1: 0, 5: 1, 13: 2, 2: 3, 6: 4}


def id_forms(text: Column) -> Column:
    """Upper-cased id and its prefixes before each run of non-word characters, longest first, with their generation."""
    up = F.upper(F.trim(text))
    cuts = F.filter(F.sequence(F.lit(1), F.length(up)), lambda i: (F.substring(up, i, F.lit(1)).rlike(r"\W")) & (i > 1) & (F.substring(up, i - 1, F.lit(1)).rlike(r"\w")))
    prefixes = F.reverse(F.transform(cuts, lambda i: F.substring(up, F.lit(1), i - 1)))
    return F.filter(F.array_distinct(F.concat(F.array(up), prefixes)), lambda x: F.length(x) > 0)


def convert(inputs: DataFrame, text: str, mapping: DataFrame, tax_id: int | None = None) -> DataFrame:
    """(input, form, gene, type): for each distinct input its best gene.

    mapping: (gid, source_id, id_type_id, tax_id). Order: fewest cuts, type order, then the smaller gene. Inputs without a gene are absent.
    """
    forms = inputs.select(F.col(text).alias("input")).filter("input is not null").distinct().select("input", F.posexplode(id_forms(F.col("input"))).alias("generation", "form"))
    known = mapping.filter("gid is not null and source_id is not null")
    known = known if tax_id is None else known.filter(F.col("tax_id") == tax_id)
    rank = F.coalesce(*[F.when(F.col("id_type_id") == k, v) for k, v in TYPE_ORDER.items()], F.lit(9))
    known = known.select(F.upper(F.trim("source_id")).alias("form"), F.col("gid").alias("gene"), F.col("id_type_id").alias("type"), rank.alias("priority"))
    best = F.min(F.struct("generation", "priority", "gene", "type", "form"))
    return forms.join(known, "form").groupBy("input").agg(best.alias("b")).select("input", "b.form", "b.gene", "b.type")


def current_id(rows: DataFrame, key: str, history: DataFrame) -> DataFrame:
    """rows with `current`: retired ids (old_id -> new_id) replaced, others kept."""
    known = maybe_broadcast(history.groupBy(F.col("old_id").alias("_old")).agg(F.min("new_id").alias("_new")))
    return rows.join(known, F.col(key) == F.col("_old"), "left").withColumn("current", F.coalesce("_new", F.col(key))).drop("_old", "_new")


def least_distance(closure: DataFrame) -> DataFrame:
    """(term, ancestor, distance): the least distance of each pair."""
    return closure.filter("term is not null and ancestor is not null").groupBy("term", "ancestor").agg(F.min("distance").alias("distance"))


def term_text(items: DataFrame, annotation: DataFrame, terms: DataFrame, top: int = 3) -> DataFrame:
    """(item, text): descriptions of the item's `top` smallest terms joined by '; '; ties go to the smaller term."""
    ann = annotation.select("term", "item").dropna().distinct()
    sizes = ann.groupBy("term").agg(F.count("item").alias("n"))
    told = sizes.join(terms, "term")
    met = ann.join(items.select("item").distinct(), "item", "left_semi").join(maybe_broadcast(told), "term")
    w = W.partitionBy("item").orderBy("n", "term")
    best = met.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    return best.groupBy("item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "description"))), lambda x: x["description"]), "; ").alias("text"))


def id_class(text: Column) -> Column:
    """The kind of an outside identifier by its writing: transcript, protein, genomic or predicted record, ensembl, number, or symbol."""
    t = F.upper(F.trim(text))
    kinds = ((r"^[NX][MR]_\d+", "transcript"), (r"^[NX]P_\d+", "protein"), (r"^N[CGTW]_\d+", "genomic"), (r"^X[A-Z]_\d+", "predicted"), (r"^[A-Z]*ENS[A-Z]*[GTP]\d+", "ensembl"), (r"^\d+$", "number"))
    out = F.when(t.isNull() | (F.length(t) == 0), F.lit(None).cast("string"))
    for pattern, kind in kinds:
        out = out.when(t.rlike(pattern), kind)
    return out.otherwise("symbol")


def without_version(text: Column) -> Column:
    """An accession without its version number."""
    return F.regexp_replace(F.trim(text), r"(?<=\d)\.\d+$", "")


def described(genes: DataFrame, key: str, catalogue: DataFrame) -> DataFrame:
    """genes with symbol, gene_type and tax_id of the catalogue (geneid, ...); an unknown gene has its own id as symbol.

    A gene with several rows in the catalogue takes the smallest values that are not null.
    """
    one = catalogue.filter("geneid is not null").groupBy(F.col("geneid").alias("_id")).agg(*[F.min(c).alias(c) for c in ("symbol", "gene_type", "tax_id")])
    met = genes.join(maybe_broadcast(one), F.col(key) == F.col("_id"), "left").drop("_id")
    return met.withColumn("symbol", F.coalesce("symbol", F.col(key).cast("string")))


def orthologs(genes: DataFrame, groups: DataFrame, tax_id: int) -> DataFrame:
    """(gene, ortholog): genes of the species in the same group; a gene of the species itself is its own ortholog too.

    genes: (gene), groups: (group, gene, tax_id).
    """
    ids = genes.select("gene").dropna().distinct()
    g = groups.select("group", "gene", "tax_id").dropna().distinct()
    other = g.filter(F.col("tax_id") == tax_id).select("group", F.col("gene").alias("ortholog")).distinct()
    through = ids.join(g.select("group", "gene").distinct(), "gene").join(other, "group").select("gene", "ortholog")
    own = ids.join(g.filter(F.col("tax_id") == tax_id).select("gene").distinct(), "gene", "left_semi").select("gene", F.col("gene").alias("ortholog"))
    return through.unionByName(own).distinct()


def resolve(inputs: DataFrame, text: str, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(input, gene, step): the first of the steps (name, (form, gene)) that knows an input, written in capitals without blanks and version.

    A form of several genes gives the smallest. Inputs that no step knows are absent.
    """
    asked = inputs.select(F.col(text).alias("input")).filter("input is not null").distinct().withColumn("form", F.upper(without_version(F.col("input")))).filter("form <> ''")
    known = None
    for i, (name, table) in enumerate(steps):
        part = table.select(F.upper(without_version(F.col("form"))).alias("form"), "gene").dropna().groupBy("form").agg(F.min("gene").alias("gene")).withColumns({"order": F.lit(i), "step": F.lit(name)})
        known = part if known is None else known.unionByName(part)
    best = F.min(F.struct("order", "gene", "step"))
    return asked.join(known, "form").groupBy("input").agg(best.alias("b")).select("input", "b.gene", "b.step")


def convert_column(rows: DataFrame, text: str, mapping: DataFrame, name: str = "gene") -> DataFrame:
    """rows with the gene that each text converts to (see `convert`), null where there is none; every row is kept."""
    found = convert(rows, text, mapping).select(F.col("input").alias("_input"), F.col("gene").alias(name))
    return rows.join(found, F.col(text) == F.col("_input"), "left").drop("_input")


def names_of_species(catalogue: DataFrame, mapping: DataFrame, tax_id: int) -> DataFrame:
    """(gene, name): symbols and outside identifiers of every gene of a species."""
    genes = catalogue.filter((F.col("tax_id") == tax_id) & F.col("geneid").isNotNull())
    own = genes.select(F.col("geneid").alias("gene"), F.col("symbol").alias("name"))
    other = mapping.select(F.col("gid").alias("gene"), F.trim("source_id").alias("name")).join(genes.select(F.col("geneid").alias("gene")).distinct(), "gene", "left_semi")
    return own.unionByName(other).filter("name is not null and name <> ''").distinct()
