"""Readers and writers for the tables and network files, over Spark's own data sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "\t", where: str | None = None, top: int | None = None) -> DataFrame:
    """A delimited table with a header; the filter and the row bound go into the scan. gz files are read as they are."""
    df = spark.read.csv(path, sep=sep, header=True, schema=schema)
    df = df if where is None else df.filter(where)
    return df if top is None else df.limit(top)


def header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    return spark.read.csv(path, sep=sep, header=True).columns


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def write_table(df: DataFrame, path: str, sep: str = "\t", partition_by: list[str] | None = None, gzip: bool = False) -> None:
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    w.csv(path, sep=sep, header=True, compression="gzip" if gzip else "none")


def query(spark: SparkSession, sql: str, **named: object) -> DataFrame:
    """A select with named parameter markers."""
    return spark.sql(sql, args=named or None)


def read_xgmml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an XGMML file: (id, label) and (a, b, label)."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _label string").load(path).select(F.col("_id").alias("id"), F.col("_label").alias("label"))
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, _label string").load(path)
    return nodes, edges.select(F.least("_source", "_target").alias("a"), F.greatest("_source", "_target").alias("b"), F.col("_label").alias("label"))


def write_xgmml_edges(edges: DataFrame, path: str) -> None:
    rows = edges.select(F.col("a").cast("string").alias("_source"), F.col("b").cast("string").alias("_target"), F.concat_ws(" ", "a", F.format_string("(%s)", "kind"), "b").alias("_label"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "graph").option("rowTag", "edge").save(path)


def read_sif(spark: SparkSession, path: str) -> DataFrame:
    """Edges (a, b, kind) of a SIF file; a line may name several targets, a single name is a self loop."""
    parts = F.split("value", r"\t")
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(parts.alias("p"))
    flat = rows.select(F.get("p", F.lit(0)).alias("x"), F.coalesce(F.get("p", F.lit(1)), F.lit("Direct")).alias("kind"), F.explode(F.when(F.size("p") > 2, F.slice("p", F.lit(3), F.size("p"))).otherwise(F.array(F.get("p", F.lit(0))))).alias("y"))
    return flat.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind")


def write_sif(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws("\t", F.col("a").cast("string"), "kind", F.col("b").cast("string")).alias("value")).write.mode("overwrite").text(path)


_JSON = "elements struct<nodes:array<struct<data:struct<id:string,name:string>>>,edges:array<struct<data:struct<source:string,target:string,interaction:string,score:double>>>>"


def read_network_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a network JSON file."""
    doc = spark.read.schema(_JSON).option("multiLine", True).json(path)
    nodes = doc.select(F.explode("elements.nodes.data").alias("d")).select("d.id", "d.name")
    edges = doc.select(F.explode("elements.edges.data").alias("d")).select(F.least("d.source", "d.target").alias("a"), F.greatest("d.source", "d.target").alias("b"), F.col("d.interaction").alias("kind"), "d.score")
    return nodes, edges


def edges_as_json(edges: DataFrame) -> DataFrame:
    """(value): one JSON element per edge."""
    return edges.select(F.to_json(F.struct(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), F.col("kind").alias("interaction"), "score").alias("data"))).alias("value"))


def catalog(spark: SparkSession) -> dict[str, object]:
    """Names known to the session's catalog."""
    c = spark.catalog
    return {"database": c.currentDatabase(), "databases": [d.name for d in c.listDatabases()], "tables": [t.name for t in c.listTables()]}


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(value): each file as one string."""
    return spark.read.text(path, wholetext=True)


def read_inferred(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited table with a header whose types are inferred by one more pass."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def is_header(row: list[str | None], allow_whole: bool = False) -> bool:
    """Whether a first row looks like a header: no cell empty, none repeated, none a real number, whole numbers only if allowed."""
    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    cells = [(c or "").strip() for c in row]
    if not cells or any(not c for c in cells) or len(set(cells)) < len(cells):
        return False
    return all(not number(c) or (allow_whole and c.lstrip("+-").isdigit()) for c in cells)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def write_named(df: DataFrame, name: str, append: bool = False) -> None:
    """A table of the session's catalog from df, or rows added to it."""
    df.write.mode("append" if append else "overwrite").saveAsTable(name)


def read_database(spark: SparkSession, url: str, select: str, **options: str) -> DataFrame:
    """A select over a database that speaks JDBC; its driver must be on the class path. Spark pushes filters on the result into it."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({select}) q", **options).load()


def to_csv_text(df: DataFrame, sep: str = ",") -> DataFrame:
    """(value): each row as one delimited line."""
    return df.select(F.to_csv(F.struct(*df.columns), {"sep": sep}).alias("value"))


def write_attributes(nodes: DataFrame, path: str, node: str = "node") -> None:
    """Node attributes as `node = value` lines under their names, one folder per attribute."""
    for c in nodes.columns:
        if c != node:
            rows = nodes.filter(F.col(c).isNotNull()).select(F.concat_ws(" = ", F.col(node).cast("string"), F.col(c).cast("string")).alias("value"))
            rows.write.mode("overwrite").text(f"{path}/{c}")
