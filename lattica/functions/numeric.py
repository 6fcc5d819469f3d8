"""Numeric kernels as JVM expressions: log factorials, the hypergeometric tail, and Arrow kernels for distribution tails."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest p-value that is told apart; log10 p is floored at -100.
P_FLOOR = 1e-100


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9 brought back down, to about 1e-14 relative; no table, so no bound on n."""
    x = n.cast("double") + 1.0
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    down = F.lit(1.0)
    for i in range(8):
        down = down * (x + float(i))
    return series - F.log(down)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def log_hypergeometric(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """ln P(X = k) for `drawn` out of `total` with `marked` among them."""
    return log_choose(marked, k) + log_choose(total - marked, drawn - k) - log_choose(total, drawn)


def hypergeometric_tail(n: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """ln P(X >= n) for `drawn` out of `total` with `marked` among them; 0 at or below the least possible n.

    The largest term is factored out and the rest follow by ratios, so tails far below the double range keep their logarithm. Terms that no double can tell are
    left out: P(X >= mean + d) <= exp(-2 d^2 / m) with m the smaller of marked and drawn, and terms fall faster the further they are from the mean, so beyond
    `reach` from the mean or from n, whichever is higher, all terms together are below e^-45 of the first; below the mean by as much the tail is 1.
    """
    top = F.least(marked, drawn)
    low = F.greatest(F.lit(0), marked + drawn - total)
    start = F.greatest(n, low)
    mean = F.coalesce(F.try_divide(marked.cast("double") * drawn, total), F.lit(0.0))
    reach = F.ceil(F.sqrt(top * (22.5 + F.log(top + 1.0)))) + 1
    last = F.when(start < mean - reach, start).otherwise(F.greatest(start, F.least(top, F.greatest(start, F.ceil(mean)) + reach)))
    first = log_hypergeometric(start, total, marked, drawn)
    step = lambda acc, k: F.struct(
        (acc["s"] + acc["t"]).alias("s"),
        (acc["t"] * ((marked - k) * (drawn - k)).cast("double") / ((k + 1) * (total - marked - drawn + k + 1)).cast("double")).alias("t"),
    )
    terms = F.aggregate(F.sequence(start, last), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), step)["s"]
    return F.when((n <= low) | (start < mean - reach), 0.0).when(n > top, F.lit(float("-inf"))).otherwise(F.least(F.lit(0.0), first + F.log(terms)))


def tail_bounds(n: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """struct (least, most): bounds on hypergeometric_tail in a fixed number of steps.

    Above the mean the terms fall, each by at least the first ratio r: the tail is at most P(n) / (1 - r), and at least j P(n + j - 1) for every j. Up to the
    mean it is at least the tail at the first number above it, and at most 1.
    """
    let = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  (worked out once, however often f uses it)
    ends = lambda least, most: F.struct(least.alias("least"), most.alias("most"))
    n, t, m, d = (c.cast("double") for c in (n, total, marked, drawn))
    case = F.struct(n.alias("n"), t.alias("t"), m.alias("m"), d.alias("d"), F.least(m, d).alias("top"), F.greatest(F.lit(0.0), m + d - t).alias("low"), (F.floor(m * d / t).cast("double") + 1).alias("above"))
    placed = lambda c: let(F.struct(c.alias("c"), F.least(c["top"], F.greatest(c["n"], c["above"])).alias("k")), first)

    def first(x: Column) -> Column:
        c, k = x["c"], x["k"]
        ratio = (c["m"] - k) * (c["d"] - k) / ((k + 1) * (c["t"] - c["m"] - c["d"] + k + 1))
        return let(F.struct(x.alias("x"), ratio.alias("r"), log_hypergeometric(k, c["t"], c["m"], c["d"]).alias("at")), second)

    def second(y: Column) -> Column:
        c, k = y["x"]["c"], y["x"]["k"]
        j = F.least(c["top"] - k + 1, F.floor(1 / F.greatest(1 - y["r"], 1 / (F.sqrt(c["top"]) + 1))).cast("double"))
        return let(F.struct(y.alias("y"), F.greatest(F.lit(1.0), j).alias("j")), third)

    def third(z: Column) -> Column:
        y, c, k = z["y"], z["y"]["x"]["c"], z["y"]["x"]["k"]
        least = F.greatest(y["at"], F.log(z["j"]) + let(k + z["j"] - 1, lambda e: log_hypergeometric(e, c["t"], c["m"], c["d"])))
        most = F.when((c["n"] >= c["above"]) & (y["r"] < 1), F.least(F.lit(0.0), y["at"] - F.log1p(-y["r"]))).otherwise(0.0)
        one, none = F.lit(0.0), F.lit(float("-inf"))
        return F.when(c["n"] <= c["low"], ends(one, one)).when(c["n"] > c["top"], ends(none, none)).otherwise(ends(least, most))

    return let(case, placed)


def log10_p(ln_p: Column) -> Column:
    return F.greatest(ln_p / math.log(10), F.lit(math.log10(P_FLOOR)))


def enrichment_z(n: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """Z-score of the overlap; 0 where its variance vanishes."""
    n, total, marked, drawn = (c.cast("double") for c in (n, total, marked, drawn))
    under = marked * drawn * (total - marked) * (total - drawn) / F.greatest(total - 1, F.lit(1.0))
    return F.when(under < 1e-100, 0.0).otherwise((n * total - marked * drawn) / F.sqrt(under))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_sf(x: float, a: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def normal_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _kernel(f: Callable[..., float]) -> Callable[..., Column]:
    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([f(*map(float, v)) if not any(map(pd.isna, v)) else np.nan for v in zip(*cols, strict=True)])

    return run


def t_p(t: Column, df: Column) -> Column:
    return _kernel(t_sf2)(t, df)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _kernel(f_sf)(f, d1, d2)


def chi2_p(x: Column, df: Column) -> Column:
    return _kernel(lambda a, k: gamma_sf(a / 2, k / 2))(x, df)


def normal_p(z: Column) -> Column:
    return _kernel(normal_sf2)(z)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, null outside, in Arrow batches."""
    from statistics import NormalDist

    inverse = NormalDist().inv_cdf

    @F.pandas_udf("double")
    def quantile(values: pd.Series) -> pd.Series:
        return values.map(lambda x: inverse(x) if 0 < x < 1 else None).astype("float64")

    return quantile(p)
