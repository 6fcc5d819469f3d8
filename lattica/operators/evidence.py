"""Evidence per item from several sources, and its weights by sign-constrained logistic regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.ranks import grouped_prefix, ordered_prefix
from lattica.session import cut


def assemble(*sources: DataFrame) -> DataFrame:
    """(item, source, value): long evidence rows of all sources, the largest value of each; no chain of outer joins."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    return rows.filter("item is not null").groupBy("item", "source").agg(F.max("value").alias("value"))


def weighted_sum(evidence: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(item, score) with a weight per source (absent sources weigh 1)."""
    w = F.lit(1.0)
    for k, v in weights.items():
        w = F.when(F.col("source") == k, v).otherwise(w)
    return evidence.groupBy("item").agg(F.sum(F.col("value") * w).alias("score"))


def wide(evidence: DataFrame, sources: list[str]) -> DataFrame:
    return evidence.groupBy("item").pivot("source", sources).agg(F.max("value")).na.fill(0.0)


def prefix_near(scores: DataFrame, target: int) -> DataFrame:
    """Items of the prefix by score whose size is nearest the target; ties take the longer. Only distinct scores are put in order."""
    sizes = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    placed = ordered_prefix(sizes.withColumn("_down", -F.col("score").cast("double")), [], ["_down", "score"], F.col("n"))
    cum = placed.withColumn("upto", F.col("before") + F.col("n"))
    best = cum.agg(F.min(F.struct(F.abs(F.col("upto") - target).alias("d"), (-F.col("upto")).alias("u"), "score")).alias("m")).first()["m"]
    return scores.filter(F.col("score") >= best["score"]) if best is not None else scores.limit(0)


def fit_weights(table: DataFrame, features: list[str], label: str, signs: list[int], penalty: float = 1.0) -> tuple[list[float], float]:
    """(weights, intercept) of a class-balanced L2 logistic regression whose weights keep the given signs (1, -1 or 0 for free)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import DenseMatrix

    counts = {r[0]: r[1] for r in table.groupBy(label).count().collect()}  # two rows
    total = sum(counts.values())
    balance = F.when(F.col(label) == 1, total / (2 * max(1, counts.get(1, 0)))).otherwise(total / (2 * max(1, counts.get(0, 0))))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(table.withColumn("_w", balance).withColumn("_y", F.col(label).cast("double")))
    inf = float("inf")
    low, high = [0.0 if s > 0 else -inf for s in signs], [0.0 if s < 0 else inf for s in signs]
    model = LogisticRegression(labelCol="_y", weightCol="_w", regParam=2 * penalty / total, standardization=False, lowerBoundsOnCoefficients=DenseMatrix(1, len(features), low), upperBoundsOnCoefficients=DenseMatrix(1, len(features), high)).fit(rows)
    return list(map(float, model.coefficientMatrix.toArray()[0])), float(model.interceptVector[0])


def metrics(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """(accuracy, balanced, f1, mcc) of a 0/1 prediction."""
    c = lambda y, p: F.count_if((F.col(label) == y) & (F.col(predicted) == p)).cast("double")
    t = scored.agg(c(1, 1).alias("tp"), c(0, 0).alias("tn"), c(0, 1).alias("fp"), c(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return t.select(
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"), ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(auc): the share of pairs of a 1 and a 0 that the score puts in order, ties counting half; null without both labels."""
    rows = scored.select(F.col(label).alias("y"), F.col(score).cast("double").alias("x")).filter("y is not null and x is not null and not isnan(x)")
    per = rows.groupBy("x").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    placed = ordered_prefix(per, [], ["x"], F.col("n"))
    return placed.agg(F.try_divide(F.sum(F.col("p") * (F.col("before") + F.col("n") / 2)), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def cutoffs(scores: DataFrame, least: int = 3, most: int = 3000) -> DataFrame:
    """(score, n): distinct scores from the best down with the number of rows at or above each, where it is least..most - 1."""
    sizes = scores.groupBy("score").agg(F.count(F.lit(1)).alias("c")).withColumn("_down", -F.col("score").cast("double"))
    placed = ordered_prefix(sizes, [], ["_down", "score"], F.col("c"))
    return placed.select("score", (F.col("before") + F.col("c")).alias("n")).filter((F.col("n") >= least) & (F.col("n") < most))


def folds(table: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """table with fold 0..k-1, the rows of each label dealt in turn by the hash of their key, so folds have the same shares of labels."""
    placed = grouped_prefix(table.withColumn("_h", F.xxhash64(key, F.lit(seed))), [label], ["_h", key], name="_i")
    return placed.withColumn("fold", F.pmod("_i", F.lit(k)).cast("int")).drop("_h", "_i")


def choose_penalty(table: DataFrame, key: str, features: list[str], label: str, signs: list[int], penalties: list[float], k: int = 5) -> tuple[float, dict[float, float]]:
    """(penalty, mean cross-validated mcc by penalty): the penalty with the best mean, the larger one on ties."""
    parts = cut(folds(table.filter(F.col(label).isin(0, 1)), key, label, k))
    mean: dict[float, float] = {}
    for penalty in penalties:
        total = 0.0
        for i in range(k):
            w, b = fit_weights(parts.filter(F.col("fold") != i), features, label, signs, penalty)
            z = F.lit(float(b))
            for f, x in zip(features, w, strict=True):
                z = z + F.col(f) * float(x)
            m = metrics(parts.filter(F.col("fold") == i).withColumn("_p", (z > 0).cast("int")), label, "_p").first()
            total += m.mcc or 0.0
        mean[penalty] = total / k
    return max(penalties, key=lambda p: (round(mean[p], 9), p)), mean


def probability(score: Column, positives: Column, negatives: Column) -> Column:
    """Probability of a log-odds score of a class-balanced model at the shares of labels given."""
    return 1 / (1 + F.exp(-score) * negatives / positives)
