"""A study of several lists of items: overlap, enrichment, quality terms, networks, clusters and a summary, each stage a table.

A stage is declared from the inputs and earlier stages and written once into the study's folder; a later session finds it there, so a study goes on
where it stopped. `reset` forgets stages. Nothing is held in memory between stages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import clustering, enrichment, network, terms
from lattica.session import _delete


@dataclass(frozen=True)
class Settings:
    """What a study is run with; checked when it is made."""

    min_overlap: int = 3
    p_cutoff: float = 0.01
    min_enrichment: float = 1.5
    max_term: int = 800
    similarity: float = 0.3
    per_cluster: int = 3
    max_clusters: int = 20
    min_module: int = 3
    max_module: int = 500
    special: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not (self.min_overlap >= 1 and 0 < self.p_cutoff <= 1 and 0 < self.similarity <= 1 and self.min_module <= self.max_module):
            raise ValueError("a setting is out of range")


@dataclass
class Study:
    """lists (list, item), annotation (term, item), edges (a, b, kind, score), categories (term, category) if there are any."""

    spark: SparkSession
    folder: str
    lists: DataFrame
    annotation: DataFrame
    edges: DataFrame
    categories: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    STAGES = ("membership", "overlap", "enriched", "quality", "merged", "clusters", "representatives", "evidence", "subnetworks", "modules", "module_terms", "summary")

    def _path(self, stage: str) -> str:
        return f"{self.folder.rstrip('/')}/{stage}"

    def done(self, stage: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(stage) + "/_SUCCESS")
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def reset(self, *stages: str) -> None:
        """Forget stages and all that come after the first of them."""
        first = min((self.STAGES.index(s) for s in stages), default=0)
        for s in self.STAGES[first:]:
            _delete(self.spark, self._path(s))

    def get(self, stage: str) -> DataFrame:
        """The table of a stage, from the folder or made now."""
        if stage not in self.STAGES:
            raise ValueError(f"no stage {stage}")
        if not self.done(stage):
            getattr(self, f"_{stage}")().write.mode("overwrite").parquet(self._path(stage))
        return self.spark.read.parquet(self._path(stage))

    def run(self) -> dict[str, DataFrame]:
        return {s: self.get(s) for s in self.STAGES}

    def _split(self, special: bool) -> DataFrame:
        """Annotation of the standard terms, or of the ones kept for quality control."""
        if self.categories is None:
            return self.annotation.limit(0) if special else self.annotation
        marked = terms.category_split(self.categories.select("term", "category").dropna().distinct(), "category", self.settings.special)
        chosen = marked.filter(F.col("part") == ("special" if special else "standard")).select("term").distinct()
        return self.annotation.join(chosen, "term", "left_semi")

    def _membership(self) -> DataFrame:
        return enrichment.membership(self.lists)

    def _overlap(self) -> DataFrame:
        universe = self.annotation.select("item").unionByName(self.lists.select("item")).dropna().distinct().count()
        return enrichment.list_overlaps(self.lists, universe)

    def _test(self, annotation: DataFrame) -> DataFrame:
        s = self.settings
        return enrichment.enrich(self.lists, annotation, None, s.min_overlap, s.p_cutoff, s.min_enrichment, s.max_term)

    def _enriched(self) -> DataFrame:
        return self._test(self._split(False))

    def _quality(self) -> DataFrame:
        return self._test(self._split(True))

    def _merged(self) -> DataFrame:
        told = terms.merge_retested(self.lists, self._split(False), self.get("enriched"), max_size=self.settings.max_term)
        return told.join(terms.specificity(self.get("enriched")), "term", "left")

    def _clusters(self) -> DataFrame:
        best = self.get("merged").select("term", "logp", "enrichment")
        pairs = enrichment.term_kappa(self._split(False), best)
        return clustering.cluster_heads(best, clustering.group_terms(best, pairs, self.settings.similarity))

    def _representatives(self) -> DataFrame:
        return clustering.representatives(self.get("clusters"), self.settings.per_cluster, self.settings.max_clusters)

    def _evidence(self) -> DataFrame:
        return terms.with_evidence(self.lists, self._split(False), self.get("enriched"))

    def _subnetworks(self) -> DataFrame:
        """(list, a, b, kind, score): the edges among the items of each list, all lists in one join."""
        held = self.lists.select("list", "item").dropna().distinct()
        one = self.edges.join(held.withColumnRenamed("item", "a"), "a")
        return one.join(held.withColumnRenamed("item", "b"), ["list", "b"]).select("list", "a", "b", "kind", "score")

    def _modules(self) -> DataFrame:
        """Dense clusters of the edges that any list holds."""
        s = self.settings
        union = self.get("subnetworks").groupBy("a", "b").agg(F.min("kind").alias("kind"), F.max("score").alias("score"))
        return network.dense_clusters(union, s.min_module, s.max_module or None)

    def _module_terms(self) -> DataFrame:
        """Terms of each module, its items being the tested list."""
        kind = dict(self.lists.dtypes)["item"]
        held = self.get("modules").select(F.concat_ws(":", "component", "cluster").alias("list"), F.col("node").cast(kind).alias("item"))
        return enrichment.enrich(held, self._split(False), None, 2, self.settings.p_cutoff, 1.0, self.settings.max_term)

    def _summary(self) -> DataFrame:
        """(term, group_id, list, logp): the first term of each of the best clusters with its value in every list that has it."""
        heads = self.get("clusters").filter((F.col("first_in_group") == 1) & (F.col("group_id") <= self.settings.max_clusters)).select("term", "group_id")
        return heads.join(self.get("enriched").select("term", "list", "logp"), "term")
