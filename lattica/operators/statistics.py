"""Group statistics as aggregates and windows. Null and NaN values are dropped before any statistic; groups left empty give no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions.numeric import chi2_p, f_p, hypergeometric_tail, normal_p, normal_quantile, t_p
from lattica.operators.ranks import ordered_prefix
from lattica.session import cut


def usable(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, x) without nulls and NaN."""
    return df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).filter("g is not null and x is not null and not isnan(x)")


def medians(rows: DataFrame) -> DataFrame:
    """(g, median) of (g, x), exact: values are weighted by frequency and put in order by ranges, so no task holds a group."""
    freq = rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    placed = ordered_prefix(freq, ["g"], ["x"], F.col("c"))
    total = rows.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("g", "_g")
    met = placed.join(total, F.col("g") == F.col("_g"))
    # the values at the two middle ranks, which are the same one when the count is odd
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    at = lambda r: F.min(F.when((F.col("before") < r) & (r <= F.col("before") + F.col("c")), F.col("x")))
    return met.groupBy("g").agg(((at(low) + at(high)) / 2).alias("median"))


def describe(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, n, mean, median, sd, rms): median is exact; sd is the sample one, null for a single value."""
    rows = usable(df, group, value)
    told = rows.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return told.join(medians(rows), "g").select("g", "n", "mean", "median", "sd", "rms")


def mad(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, mad): 1.4826 times the median absolute deviation."""
    rows = usable(df, group, value)
    far = rows.join(medians(rows), "g").select("g", F.abs(F.col("x") - F.col("median")).alias("x"))
    return medians(far).select("g", (F.col("median") * 1.4826).alias("mad"))


def gini(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, gini) of non-negative values. Weighted by value frequency, so a hot group is as small as its distinct values."""
    return weighted_gini(usable(df, group, value).groupBy("g", "x").agg(F.count(F.lit(1)).alias("c")))


def weighted_gini(freq: DataFrame) -> DataFrame:
    """(g, gini) of (g, x, c): c values of x in group g, one row for each x."""
    placed = ordered_prefix(freq, ["g"], ["x"], F.col("c"))
    # a run of c equal values at ranks before+1 .. before+c weighs them by n + 1 - rank
    run = F.col("x") * F.col("c") * (F.col("before") + (F.col("c") + 1) / 2)
    sums = placed.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("x") * F.col("c")).alias("s"), F.sum(run).alias("r"))
    return sums.select("g", F.when(F.col("s") == 0, 0.0).otherwise((F.col("n") + 1 - 2 * ((F.col("n") + 1) * F.col("s") - F.col("r")) / F.col("s")) / F.col("n")).alias("gini"))


def z_factor(df: DataFrame, group: str, value: str, positive: str, negative: str) -> DataFrame:
    """(z_factor): 1 - 3 (sd_p + sd_n) / |mean_p - mean_n| with population deviations."""
    rows = usable(df, group, value)
    at = lambda f, g: f(F.when(F.col("g") == g, F.col("x")))
    return rows.agg((1 - F.try_divide(3 * (at(F.stddev_pop, positive) + at(F.stddev_pop, negative)), F.abs(at(F.avg, positive) - at(F.avg, negative)))).alias("z_factor"))


def otsu(df: DataFrame, group: str, value: str, bins: int = 64) -> DataFrame:
    """(g, threshold): upper edge of the bin that maximises the variance between classes; ties take the lowest."""
    rows = usable(df, group, value)
    span = rows.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = rows.join(span, "g").withColumn("b", F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / width).cast("int"))).otherwise(0))
    hist = binned.groupBy("g", "b", "lo", "hi").agg(F.count(F.lit(1)).alias("c"))
    w, all_ = W.partitionBy("g").orderBy("b").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("g")
    cum = hist.withColumns({"n0": F.sum("c").over(w), "s0": F.sum(F.col("c") * F.col("b")).over(w), "n": F.sum("c").over(all_), "s": F.sum(F.col("c") * F.col("b")).over(all_)})
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0"))
    cum = cum.withColumn("between", F.when(F.col("n0") < F.col("n"), F.col("n0").cast("double") * (F.col("n") - F.col("n0")) * gap * gap).otherwise(0.0))
    best = cum.groupBy("g").agg(F.max(F.struct("between", (-F.col("b")).alias("nb"), "lo", "hi")).alias("m"))
    return best.select("g", (F.col("m.lo") + (1 - F.col("m.nb")) * (F.col("m.hi") - F.col("m.lo")) / bins).alias("threshold"))


def average_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, x, c, rank): distinct values with their frequency and average rank inside the group."""
    freq = usable(df, group, value).groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    return ordered_prefix(freq, ["g"], ["x"], F.col("c")).select("g", "x", "c", (F.col("before") + (F.col("c") + 1) / 2).alias("rank"))


def quantile_normalise(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, x, rank, normalised): each value becomes the mean over groups of the values at its rank (ties: least rank)."""
    freq = usable(df, group, value).groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    placed = cut(ordered_prefix(freq, ["g"], ["x"], F.col("c")))
    # a value stands at its ranks before+1 .. before+c
    means = placed.select("x", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("c"))).alias("i")).groupBy("i").agg(F.avg("x").alias("normalised"))
    ranked = placed.select("g", "x", (F.col("before") + 1).alias("rank"))
    return ranked.join(means, F.col("rank") == F.col("i")).select("g", "x", "rank", "normalised")


def sliding_z(df: DataFrame, group: str, order: list[str], value: str, window: int) -> DataFrame:
    """df with z: (x - mean) / population sd over window // 2 rows to either side, truncated at the ends."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(-(window // 2), window // 2)
    return df.withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def contingency(df: DataFrame, row: Column, col: Column) -> DataFrame:
    """(n11, n10, n01, n00) of two flags; null is false."""
    r, c = F.coalesce(row, F.lit(False)), F.coalesce(col, F.lit(False))
    return df.agg(F.count_if(r & c).alias("n11"), F.count_if(r & ~c).alias("n10"), F.count_if(~r & c).alias("n01"), F.count_if(~r & ~c).alias("n00"))


def fisher_and_chi2(table: DataFrame) -> DataFrame:
    """table (n11, n10, n01, n00) with fisher_ln_p (greater), chi2 (Yates), chi2_p (two-sided once)."""
    a, b, c, d = (F.col(x).cast("double") for x in ("n11", "n10", "n01", "n00"))
    n = a + b + c + d
    under = (a + b) * (c + d) * (a + c) * (b + d)
    stat = F.when(under > 0, n * F.pow(F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0)), 2) / under)
    total = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    return table.withColumn("fisher_ln_p", hypergeometric_tail(F.col("n11"), total, F.col("n11") + F.col("n10"), F.col("n11") + F.col("n01"))).withColumn("chi2", stat).withColumn("chi2_p", chi2_p(F.col("chi2"), F.lit(1.0)))


def t_test(df: DataFrame, group: str, value: str, one: str, two: str) -> DataFrame:
    """(t, df, p): pooled two-sample test, two-sided."""
    rows = usable(df, group, value)
    at = lambda f, g: f(F.when(F.col("g") == g, F.col("x")))
    s = rows.agg(at(F.count, one).alias("n1"), at(F.count, two).alias("n2"), at(F.avg, one).alias("m1"), at(F.avg, two).alias("m2"), at(F.var_samp, one).alias("v1"), at(F.var_samp, two).alias("v2"))
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    told = s.select(((F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"), dof.cast("double").alias("df"))
    return told.withColumn("p", t_p(F.col("t"), F.col("df")))


def one_way(df: DataFrame, group: str, value: str) -> DataFrame:
    """(f, f_p, h, h_p): one-way ANOVA and the Kruskal-Wallis test over all groups."""
    per = usable(df, group, value).groupBy("g").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    tot = per.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    anova = tot.select(F.lit(1).alias("one"), ((between / (F.col("k") - 1)) / ((F.col("q") - F.col("b")) / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).cast("double").alias("d1"), (F.col("n") - F.col("k")).cast("double").alias("d2"))
    flat = df.withColumn("_all", F.lit(1))
    ranks = average_ranks(flat, "_all", value).select("x", "rank", F.col("c").alias("ties"))
    joined = usable(df, group, value).groupBy("g", "x").agg(F.count(F.lit(1)).alias("c")).join(ranks, "x")
    rs = joined.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    ties = ranks.agg(F.lit(1).alias("one"), F.sum(F.pow(F.col("ties"), 3) - F.col("ties")).alias("t"), F.sum("ties").alias("nn"))
    h = rs.agg(F.lit(1).alias("one"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("rr"), F.sum("n").alias("m"))
    kw = h.join(ties, "one").select("one", ((12 / (F.col("m") * (F.col("m") + 1)) * F.col("rr") - 3 * (F.col("m") + 1)) / (1 - F.col("t") / (F.pow(F.col("nn"), 3) - F.col("nn")))).alias("h"))
    both = anova.join(kw, "one")
    return both.select("f", f_p(F.col("f"), F.col("d1"), F.col("d2")).alias("f_p"), "h", chi2_p(F.col("h"), F.col("d1")).alias("h_p"))


def mann_whitney(df: DataFrame, group: str, value: str, one: str, two: str) -> DataFrame:
    """(u, z, p): rank sum test with tie correction, two-sided normal approximation."""
    rows = df.filter(F.col(group).isin(one, two)).withColumn("_all", F.lit(1))
    ranks = average_ranks(rows, "_all", value).select("x", "rank", F.col("c").alias("ties"))
    joined = usable(rows, group, value).groupBy("g", "x").agg(F.count(F.lit(1)).alias("c")).join(ranks, "x")
    s = joined.agg(F.sum(F.when(F.col("g") == one, F.col("c")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("g") == two, F.col("c")).otherwise(0)).alias("n2"), F.sum(F.when(F.col("g") == one, F.col("c") * F.col("rank")).otherwise(0)).alias("r1"), F.sum(F.col("c") * (F.col("ties") * F.col("ties") - 1)).alias("t"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    n = n1 + n2
    told = s.select(u.alias("u"), ((u - n1 * n2 / 2) / F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))).alias("z"))
    return told.withColumn("p", normal_p(F.col("z")))


def pearson_pairs(long: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(row_a, row_b, n, r) of rows over the columns they share; for a bounded number of rows such as the lists of a study."""
    flat = long.select(F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).cast("double").alias("x")).dropna()
    a, b = flat.select(F.col("r").alias("row_a"), "c", F.col("x").alias("xa")), flat.select(F.col("r").alias("row_b"), "c", F.col("x").alias("xb"))
    return a.join(b, "c").filter("row_a < row_b").groupBy("row_a", "row_b").agg(F.count(F.lit(1)).alias("n"), F.corr("xa", "xb").alias("r"))


def normal_scores(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, x, rank, z): the normal quantile at (rank - 0.5) / n of each distinct value, ranks averaged over ties."""
    ranks = average_ranks(df, group, value)
    sizes = usable(df, group, value).groupBy(F.col("g").alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    return ranks.join(sizes, F.col("g") == F.col("_g")).select("g", "x", "rank", normal_quantile((F.col("rank") - 0.5) / F.col("n")).alias("z"))


def mean_test(df: DataFrame, group: str, value: str, mean: float, one_tail: bool = False) -> DataFrame:
    """(g, n, t, p): one-sample t test against `mean`; one-tailed p is half the two-sided one above the mean, else 1."""
    per = usable(df, group, value).groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")).filter("n > 1 and sd > 0")
    told = per.withColumn("t", (F.col("m") - mean) / (F.col("sd") / F.sqrt(F.col("n")))).withColumn("p", t_p(F.col("t"), (F.col("n") - 1).cast("double")))
    return told.select("g", "n", "t", (F.when(F.col("m") > mean, F.col("p") / 2).otherwise(1.0) if one_tail else F.col("p")).alias("p"))


def _pairs(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(g, a, b) where both values are numbers."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return df.select(F.col(group).alias("g"), x.alias("a"), y.alias("b")).filter("g is not null and a is not null and b is not null and not isnan(a) and not isnan(b)")


def paired_test(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(g, n, t, p): paired two-sided t test over rows where both values are numbers."""
    return mean_test(_pairs(df, group, a, b).withColumn("d", F.col("a") - F.col("b")), "g", "d", 0.0)


def signed_rank(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(g, n, w, z, p): Wilcoxon signed rank of a - b, zero differences left out, normal approximation with tie correction."""
    rows = _pairs(df, group, a, b).select("g", (F.col("a") - F.col("b")).alias("d")).filter("d <> 0").withColumn("x", F.abs("d"))
    ranks = average_ranks(rows, "g", "x").select(F.col("g").alias("_g"), F.col("x").alias("_x"), "rank", F.col("c").alias("ties"))
    per = rows.groupBy("g", "x").agg(F.count_if(F.col("d") > 0).alias("plus"), F.count(F.lit(1)).alias("c")).join(ranks, (F.col("g") == F.col("_g")) & (F.col("x") == F.col("_x")))
    s = per.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w"), F.sum(F.pow(F.col("ties"), 3) - F.col("ties")).alias("t"))
    n = F.col("n").cast("double")
    told = s.withColumn("z", (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48))
    return told.select("g", "n", "w", "z", normal_p(F.col("z")).alias("p"))


def pearson_by_group(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(g, n, r) over rows where both values are numbers; r lies in -1..1 and is 0 where a side does not vary."""
    per = _pairs(df, group, a, b).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"))
    return per.select("g", "n", F.when(F.col("r").isNull() | F.isnan("r"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("r")))).alias("r"))


def robust_z_factor(df: DataFrame, group: str, value: str, positive: str, negative: str) -> DataFrame:
    """(z_factor): 1 - 3 (mad_p + mad_n) / |median_p - median_n|."""
    rows = df.filter(F.col(group).isin(positive, negative))
    both = medians(usable(rows, group, value)).join(mad(rows, group, value), "g")
    at = lambda c, g: F.max(F.when(F.col("g") == g, F.col(c)))
    return both.agg((1 - F.try_divide(3 * (at("mad", positive) + at("mad", negative)), F.abs(at("median", positive) - at("median", negative)))).alias("z_factor"))


def two_way(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(source, ss, df, f, p): balanced two-way analysis of variance of rows, columns and their interaction, from one row per cell.

    Cells must hold equally many values, at least two, for the sums of squares to be those of the balanced design.
    """
    flat = df.select(F.col(row).alias("r"), F.col(col).alias("k"), F.col(value).cast("double").alias("x")).filter("r is not null and k is not null and x is not null and not isnan(x)")
    cells = cut(flat.groupBy("r", "k").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")))
    part = lambda keys: cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"), F.count(F.lit(1)).cast("double").alias("k"))
    t = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    r, c, b = part(["r"]).toDF("rss", "rk"), part(["k"]).toDF("css", "ck"), part(["r", "k"]).toDF("bss", "bk")
    one = lambda d: d.withColumn("_one", F.lit(1))  # noqa: E731  (one row each)
    all_ = one(t).join(one(r), "_one").join(one(c), "_one").join(one(b), "_one")
    base = F.col("s") * F.col("s") / F.col("n")
    within, wdf = F.col("q") - F.col("bss"), F.col("n") - F.col("bk")
    lines = [("row", F.col("rss") - base, F.col("rk") - 1), ("column", F.col("css") - base, F.col("ck") - 1), ("interaction", F.col("bss") - F.col("rss") - F.col("css") + base, (F.col("rk") - 1) * (F.col("ck") - 1))]
    told = all_.select(F.explode(F.array(*[F.struct(F.lit(k).alias("source"), ss.alias("ss"), d.alias("df"), F.try_divide(ss / d, within / wdf).alias("f"), wdf.alias("d2")) for k, ss, d in lines])).alias("x")).select("x.*")
    return told.select("source", "ss", "df", "f", f_p(F.col("f"), F.col("df"), F.col("d2")).alias("p"))


def block_ranks_test(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """(statistic, df, p): Mack-Skillings test of treatments over blocks with equally many replicates in every cell."""
    flat = df.select(F.col(block).alias("g"), F.col(treatment).alias("k"), F.col(value).cast("double").alias("x")).filter("g is not null and k is not null and x is not null and not isnan(x)")
    ranks = average_ranks(flat, "g", "x").select(F.col("g").alias("_g"), F.col("x").alias("_x"), "rank")
    met = flat.groupBy("g", "k", "x").agg(F.count(F.lit(1)).alias("c")).join(ranks, (F.col("g") == F.col("_g")) & (F.col("x") == F.col("_x")))
    size = flat.agg(F.count(F.lit(1)).alias("all"), F.count_distinct("g").alias("b"), F.count_distinct("k").alias("k")).first()  # three numbers
    n = size["all"] / max(1, size.b)  # values in a block
    per = met.groupBy("k").agg((F.sum(F.col("c") * F.col("rank")) / (n / max(1, size.k))).alias("s"))
    stat = F.lit(12.0 / (size.k * (size["all"] + size.b)) if size["all"] else 0.0)
    told = per.agg((stat * F.sum(F.pow(F.col("s") - (size["all"] + size.b) / 2.0, 2))).alias("statistic"), (F.count(F.lit(1)) - 1).cast("double").alias("df"))
    return told.withColumn("p", chi2_p(F.col("statistic"), F.col("df")))


def distance(metric: str, weights: Column | None = None) -> Column:
    """Distance of the array columns a and b over the places where both have a number: manhattan or euclid (means by weight), or pearson,
    (1 - r) / 2; 0.5 where it is not defined. One weight per place, 1 by default."""
    w = F.transform("a", lambda _x: F.lit(1.0)) if weights is None else weights
    z = F.filter(F.arrays_zip(F.col("a"), F.col("b"), w.alias("w")), lambda p: p["a"].isNotNull() & p["b"].isNotNull() & ~F.isnan(p["a"]) & ~F.isnan(p["b"]) & (p["w"] > 0))
    total = lambda f: F.aggregate(z, F.lit(0.0), lambda s, p: s + f(p) * p["w"])
    n = total(lambda p: F.lit(1.0))
    if metric == "manhattan":
        out = F.try_divide(total(lambda p: F.abs(p["a"] - p["b"])), n)
    elif metric == "euclid":
        out = F.sqrt(F.try_divide(total(lambda p: (p["a"] - p["b"]) * (p["a"] - p["b"])), n))
    elif metric == "pearson":
        sa, sb = total(lambda p: p["a"]), total(lambda p: p["b"])
        cov = n * total(lambda p: p["a"] * p["b"]) - sa * sb
        va, vb = n * total(lambda p: p["a"] * p["a"]) - sa * sa, n * total(lambda p: p["b"] * p["b"]) - sb * sb
        out = (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))))))) / 2
        out = F.when((va > 1e-12) & (vb > 1e-12), out)
    else:
        raise ValueError(f"unknown metric {metric}")
    return F.coalesce(out, F.lit(0.5))


def row_z(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns centred and scaled to sample deviation 1 within each row, over the numbers of the row; 0 where they do not vary."""
    cells = F.filter(F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]), lambda x: x.isNotNull())
    n = F.size(cells)
    total = lambda f: F.aggregate(cells, F.lit(0.0), lambda s, x: s + f(x))
    mean = F.try_divide(total(lambda x: x), n)
    told = df.withColumn("_m", mean).withColumn("_v", F.try_divide(total(lambda x: (x - F.col("_m")) * (x - F.col("_m"))), n - 1))
    scaled = {c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(None).cast("double")).when(F.coalesce("_v", F.lit(0.0)) <= 0, 0.0).otherwise((F.col(c) - F.col("_m")) / F.sqrt("_v")) for c in columns}
    return told.withColumns(scaled).drop("_m", "_v")
