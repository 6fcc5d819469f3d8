"""References to records that do not exist, from signed reference and existence counts per key.

Every change is a delta: +1 existence when a record is listed, -1 when it is withdrawn, +1 reference when a referring row is loaded,
-1 when it is retracted. Deltas are only ever added up, so they may come in any batches and in any order, late ones included.

The existence deltas of a key cut time into epochs, in each of which its running existence count is constant; `epochs` holds the count
of each. References are counted, with their sign, in the epoch of their own time, and an epoch with positive references and zero
existence is in the orphan report (`epoch_report`); `orphan_rows` gives the referring rows of the report. `apply_deltas` keeps the
current totals per key from batch to batch and `orphan_report` reads them, for the state as of now.

Null keys name nothing and are no case. A null listing time never lists; a null withdrawal is still listed;
a reference without a time can be under no listing and is an orphan. Repeated and overlapping listings add up
and are no problem, as only a count of zero makes an orphan. A withdrawal at or before its listing lists nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.session import maybe_broadcast

STATE = ("key", "refs", "existing")
CHANGES = ("key", "at", "existence")


def existence_deltas(catalogue: DataFrame, key: Column, since: Column, until: Column) -> DataFrame:
    """(key, at, existence): signed changes of a catalogue of spans [since, until)."""
    spans = catalogue.select(key.alias("key"), since.alias("since"), until.alias("until")).filter("key is not null and since is not null and (until is null or until > since)")
    return spans.select("key", F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("existence")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("existence")))).alias("d")).select("key", "d.at", "d.existence").filter("at is not null")


def add_changes(ledger: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The ledger (key, at, existence) with a batch of signed changes added; changes that cancel out are gone."""
    both = deltas.select(*CHANGES) if ledger is None else ledger.select(*CHANGES).unionByName(deltas.select(*CHANGES))
    return both.groupBy("key", "at").agg(F.sum("existence").alias("existence")).filter("existence <> 0")


def epochs(ledger: DataFrame) -> DataFrame:
    """(key, changes): per key the times of its changes in order, each with the existence count from then on.

    One row per key; its length is that of the key's own catalogue rows after netting.
    """
    run = ledger.withColumn("existing", F.sum("existence").over(W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "existing"))).alias("changes"))


def placed_references(references: DataFrame, epoch_table: DataFrame, max_rows: int | None = None) -> DataFrame:
    """references (key, at, ...) with `epoch` (changes of the key up to then; null without a time) and `existing`, the count in it; columns of these names are replaced.

    One row per key on the right, so the join never multiplies. The right side grows with the catalogue only; it is broadcast while its
    measured size allows it, so that a key that a third of all rows name moves nowhere. Beyond that Spark joins by key and AQE splits the hot one.
    """
    right = epoch_table.withColumnRenamed("key", "_key")
    right = maybe_broadcast(right) if max_rows is None else maybe_broadcast(right, max_rows=max_rows)
    met = references.drop("epoch", "existing", "changes").filter("key is not null").join(right, F.col("key") == F.col("_key"), "left")
    met = met.withColumn("_upto", F.when(F.col("at").isNotNull(), F.filter("changes", lambda c: c["at"] <= F.col("at"))))
    epoch = F.when(F.col("at").isNotNull(), F.when(F.col("_upto").isNull(), 0).otherwise(F.size("_upto")))
    existing = F.coalesce(F.try_element_at("_upto", F.lit(-1))["existing"], F.lit(0).cast("bigint"))
    return met.withColumn("epoch", epoch).withColumn("existing", existing).drop("_key", "changes", "_upto")


def epoch_report(placed: DataFrame, sign: Column | None = None) -> DataFrame:
    """(key, epoch, refs): epochs with positive references and zero existence; sign is +1 or -1 per row, by default +1."""
    counts = placed.filter("existing <= 0").groupBy("key", "epoch").agg(F.sum(F.lit(1) if sign is None else sign).alias("refs"))
    return counts.filter("refs > 0")


def orphan_rows(references: DataFrame, epoch_table: DataFrame, sign: Column | None = None, max_rows: int | None = None) -> DataFrame:
    """Rows of references (key, at, ...) whose key and epoch are in the orphan report."""
    none = placed_references(references, epoch_table, max_rows).filter("existing <= 0")  # epochs in which nothing exists
    report = epoch_report(none, sign).select(F.col("key").alias("_k"), F.col("epoch").alias("_e"))
    return none.join(report, (F.col("key") == F.col("_k")) & F.col("epoch").eqNullSafe(F.col("_e")), "left_semi").drop("epoch", "existing")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(ref_table, ref_field, period, n_orphans, n_keys) per month of `at`; map-side combined."""
    period = F.date_format(F.date_trunc("month", "at"), "yyyy-MM")
    per_key = orphans.groupBy("ref_table", "ref_field", period.alias("period"), "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("ref_table", "ref_field", "period").agg(F.sum("n").alias("n_orphans"), F.count("key").alias("n_keys"))


def apply_deltas(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """New state (key, refs, existing) from the old one and a batch (key, refs, existing) of signed changes."""
    both = deltas.select(*STATE) if state is None else state.select(*STATE).unionByName(deltas.select(*STATE))
    summed = both.filter("key is not null").groupBy("key").agg(F.sum(F.coalesce("refs", F.lit(0))).alias("refs"), F.sum(F.coalesce("existing", F.lit(0))).alias("existing"))
    return summed.filter("refs <> 0 or existing <> 0")


def orphan_report(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence."""
    return state.filter("refs > 0 and existing <= 0").select("key", "refs")
