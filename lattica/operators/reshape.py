"""Reshaping, set operations on tables, profiles and number formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in order; missing ones are null."""
    return df.select([F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long form without null cells; a row whose cells are all null stays once with null variable and value."""
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(*ids, F.explode_outer(F.filter(cells, lambda c: c["value"].isNotNull())).alias("cell")).select(*ids, "cell.variable", "cell.value")


def pivot_mean(df: DataFrame, row: str, col: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Row by column means, absent cells 0; the columns are given, so no pass looks for them."""
    return df.groupBy(row).pivot(col, list(columns)).agg(F.avg(value)).na.fill(0.0)


def mean_cells(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(row, col, n, mean): the present cells of the pivot over all values of col, however many there are."""
    return df.groupBy(row, col).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key is not in b, order and repeats kept; a null key is in nothing."""
    return a.join(b.select(key).dropna().distinct(), key, "left_anti")


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n_null, min, max, n_unique, most_popular, mean, sd): one pass per column type, one row per column."""
    parts = []
    for c, kind in df.dtypes:
        x = F.col(c)
        number = kind in ("int", "bigint", "double", "float", "smallint", "tinyint")
        x = F.when(~F.isnan(x), x) if kind in ("double", "float") else x
        # value frequencies first: hot values shrink before the shuffle, and the mode's ties go to the smallest text
        freq = df.select(x.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
        text = F.col("x").cast("string")
        mode = F.min(F.when(F.col("x").isNotNull(), F.struct((-F.col("c")).alias("c"), text.alias("x"))))["x"]
        wide = F.col("x").cast("double") if number else F.lit(None).cast("double")
        s, q = F.sum(F.col("c") * wide), F.sum(F.col("c") * wide * wide)
        count = F.sum(F.when(F.col("x").isNotNull(), F.col("c")))
        mean = s / count if number else F.lit(None).cast("double")
        sd = F.sqrt(F.greatest(F.lit(0.0), (q - s * s / count) / (count - 1))) if number else F.lit(None).cast("double")
        parts.append(freq.agg(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("c"))), F.lit(0)).alias("n_null"), F.min("x").cast("string").alias("min"), F.max("x").cast("string").alias("max"), F.count("x").alias("n_unique"), mode.alias("most_popular"), mean.alias("mean"), F.when(count > 1, sd).alias("sd")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def formatted(df: DataFrame, decimals: str = "%.2g", null: str = "") -> DataFrame:
    """Every column as text: whole numbers kept, reals by `decimals`, null as given."""
    def text(f: T.StructField) -> Column:
        c = F.col(f.name)
        s = F.format_string(decimals, c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.cast("string")
        return F.when(c.isNull(), null).otherwise(s).alias(f.name)

    return df.select(*map(text, df.schema.fields))


def to_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def rounded_text(c: Column) -> Column:
    """Real text to whole-number text, half to even; null where it is no number."""
    return F.bround(c.try_cast("double")).cast("bigint").cast("string")


def fingerprint(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, n, md5) of the sorted distinct items of each group."""
    return df.select(group, item).dropna().groupBy(group).agg(F.count_distinct(item).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), " ")).alias("md5"))


def isin_split(df: DataFrame, key: str, ids: DataFrame, negate: bool = False) -> DataFrame:
    """IN / NOT IN of any length as a semi or anti join; null keys and null ids match nothing, an empty list keeps no (all) rows."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).dropna().distinct(), key, "left_anti" if negate else "left_semi")


def even_rows(df: DataFrame, order: Sequence[str], n: int, total: int) -> DataFrame:
    """n evenly spaced rows of total, ranked in two levels."""
    from lattica.operators.ranks import grouped_prefix

    ranked = grouped_prefix(df.withColumn("_one", F.lit(1)), ["_one"], list(order), name="_rank")
    step = F.floor(F.col("_rank") * n / total)
    return ranked.filter((F.col("_rank") == 0) | (step != F.floor((F.col("_rank") - 1) * n / total))).drop("_one", "_rank")


def move_column(df: DataFrame, column: str, place: int) -> DataFrame:
    """df with the column at the 0-based place among the others."""
    others = [c for c in df.columns if c != column]
    at = max(0, min(place, len(others))) if place >= 0 else max(0, len(others) + 1 + place)
    return df.select(*others[:at], column, *others[at:])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed by the dictionary; names the table does not have are ignored."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def equal_rows(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows whose key equals the value; a null value asks for null keys."""
    return df.filter(F.col(key).isNull() if value is None else F.col(key) == F.lit(value))


def with_attribute(df: DataFrame, key: str, values: DataFrame, name: str, default: object = None) -> DataFrame:
    """df with `name` looked up in values (key, value), the first by value where a key has several, default where it has none."""
    one = values.select(F.col(values.columns[0]).alias("_k"), F.col(values.columns[1]).alias("_v")).filter("_k is not null").groupBy("_k").agg(F.min("_v").alias("_v"))
    found = df.join(one, F.col(key) == F.col("_k"), "left")
    return found.withColumn(name, F.coalesce("_v", F.lit(default)) if default is not None else F.col("_v")).drop("_k", "_v")


def set_operation(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Distinct rows of the first column of both: intersect, union, minus or either (in exactly one); null names nothing."""
    x, y = a.select(F.col(a.columns[0]).alias("item")).dropna().distinct(), b.select(F.col(b.columns[0]).alias("item")).dropna().distinct()
    if how == "union":
        return x.unionByName(y).distinct()
    if how == "either":
        return x.join(y, "item", "left_anti").unionByName(y.join(x, "item", "left_anti"))
    return x.join(y, "item", {"intersect": "left_semi", "minus": "left_anti"}[how])


def first_places(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Distinct values with the row at which each comes first in the given order, null once: (value, place columns...)."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("_o")).select(value, *[F.col(f"_o.{c}").alias(c) for c in order])


def natural_key(text: Column) -> tuple[Column, Column]:
    """Sort keys of name_<n>: the text without its last number, and the number (-1 without one)."""
    return F.regexp_replace(text, r"\d+$", ""), F.coalesce(F.regexp_extract(text, r"(\d+)$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def binned(value: Column, bounds: Sequence[float], labels: Sequence[float]) -> Column:
    """labels[i] for the first bound below which the value lies (strictly), bounds descending; the last label beyond all, null for null."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("double"))
    for bound, label in zip(reversed(list(bounds)), reversed(list(labels[1:])), strict=True):
        out = out.when(value < bound, float(label))
    return out.otherwise(float(labels[0]))


def parted_label(label: Column, width: int) -> tuple[Column, Column]:
    """The id and the text of a label such as `19_GO:0000001 Some text`: the id has `width` characters after the first underscore."""
    rest = F.regexp_replace(label, r"^[^_]*_", "")
    return F.substring(rest, 1, width), F.trim(F.substring(rest, width + 1, 10_000))


def split_rows(df: DataFrame, order: Sequence[str], parts: int, name: str = "part") -> DataFrame:
    """df with a part number 0..parts-1 of nearly equal sizes in the given order, ranked in two levels."""
    from lattica.operators.ranks import ordered_prefix

    ranked = ordered_prefix(df, [], list(order), name="_rank")
    total = df.count()
    return ranked.withColumn(name, F.floor(F.col("_rank") * parts / max(total, 1)).cast("int")).drop("_rank")


def sample_table(spark: SparkSession, rows: int, columns: int, seed: int = 0) -> DataFrame:
    """Random normal numbers r0, r1, ... by row id."""
    return spark.range(rows).select("id", *[F.randn(seed + i).alias(f"r{i}") for i in range(columns)])
