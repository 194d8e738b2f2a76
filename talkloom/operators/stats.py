"""Agreement, classification quality and tests, from counts made in one pass each."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n over the rows where both are known."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed agreement, Cohen's kappa, Matthews' coefficient (for any number of classes); null where undefined."""
    c = confusion(df, a, b)
    rows, cols = c.groupBy("a").agg(F.sum("n").alias("ra")), c.groupBy("b").agg(F.sum("n").alias("cb"))
    marg = rows.join(cols, F.col("a") == F.col("b"), "full").agg(
        F.sum(F.coalesce("ra", F.lit(0)).cast("double") * F.coalesce("cb", F.lit(0))).alias("rc"),
        F.sum(F.coalesce("ra", F.lit(0)).cast("double") * F.coalesce("ra", F.lit(0))).alias("rr"), F.sum(F.coalesce("cb", F.lit(0)).cast("double") * F.coalesce("cb", F.lit(0))).alias("cc"))
    one = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("same")).crossJoin(marg)  # one row each
    po, pe = F.try_divide(F.col("same"), F.col("n")), F.try_divide(F.col("rc"), F.col("n") * F.col("n"))
    s = F.col("n").cast("double")
    mcc = F.try_divide(F.col("same") * s - F.col("rc"), F.nullif(F.sqrt(s * s - F.col("cc")) * F.sqrt(s * s - F.col("rr")), F.lit(0.0)))
    return one.select("n", po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"), mcc.alias("mcc"))


def precision_recall(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, precision, recall, f1 of the true class; 0 where a denominator is 0."""
    t, p = F.col(truth).cast("boolean"), F.col(predicted).cast("boolean")
    d = df.where(t.isNotNull() & p.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("tp"), F.count_if(p).alias("pp"), F.count_if(t).alias("ap"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return d.select("n", share("tp", "pp").alias("precision"), share("tp", "ap").alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("pp") + F.col("ap")), F.lit(0.0)).alias("f1"))


def krippendorff_alpha(df: DataFrame, unit: str, value: str, level: str = "nominal") -> DataFrame:
    """One row: n_values (in units with two or more), alpha. df has a row per unit and rater; null values are missing.

    level: 'nominal', or 'interval' for numbers. Pairs inside a unit are not listed: for
    nominal values the coincidences follow from each unit's value counts, for numbers
    from each unit's sums.
    """
    d = df.where(F.col(value).isNotNull())
    if level == "nominal":
        per = d.groupBy(unit, F.col(value).cast("string").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("c"))
        m = per.groupBy(unit).agg(F.sum("c").alias("m")).where("m > 1")
        per = per.join(m, unit)
        same = per.agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("o"), F.sum("c").alias("n"))
        pairs = per.groupBy("v").agg(F.sum("c").alias("nv")).agg(F.sum(F.col("nv") * (F.col("nv") - 1)).alias("e"))
        observed, expected = 1 - F.col("o") / F.col("n"), 1 - F.col("e") / (F.col("n") * (F.col("n") - 1))
        return same.crossJoin(pairs).select(F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_values"), (1 - F.try_divide(observed, expected)).alias("alpha"))  # one row each
    x = F.col(value).cast("double")
    per = d.groupBy(unit).agg(F.count(x).cast("double").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where("m > 1")
    t = per.agg(F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("o"))
    observed, expected = F.col("o") / F.col("n"), 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return t.select(F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_values"), (1 - F.try_divide(observed, expected)).alias("alpha"))


def z_test(n: int, mean: float, std: float) -> tuple[float, float]:
    """(z, p): whether a mean exceeds 0; std is the sample's."""
    z = mean / (std / math.sqrt(n)) if n and std else math.nan
    return z, 0.5 * math.erfc(z / math.sqrt(2)) if z == z else math.nan


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_test(n: int, mean: float, std: float) -> tuple[float, float]:
    """(t, p): whether a mean exceeds 0 by Student's distribution; std is the sample's."""
    if n < 2 or not std:
        return math.nan, math.nan
    t, v = mean / (std / math.sqrt(n)), n - 1
    tail = 0.5 * incomplete_beta(v / 2, 0.5, v / (v + t * t))
    return t, tail if t > 0 else 1 - tail


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """How likely a standard normal value exceeds z; null for null. For small results."""
    return z.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(x / math.sqrt(2)))


def student_tail(t: str | Column, freedom: Column) -> Column:
    """How likely a value of Student's distribution exceeds t; null for null or without degrees of freedom. For small results."""
    @F.pandas_udf("double")
    def tail(ts: pd.Series, vs: pd.Series) -> pd.Series:
        out = []
        for x, v in zip(ts, vs):
            half = 0.5 * incomplete_beta(v / 2, 0.5, v / (v + x * x)) if x == x and v > 0 else None
            out.append(half if half is None or x > 0 else 1 - half)
        return pd.Series(out, dtype="float64")

    return tail(t, freedom.cast("double"))


def mean_test(df: DataFrame, column: str, kind: str = "z") -> DataFrame:
    """One row: n, mean, statistic, p of the one-sided test that the column's mean exceeds 0."""
    n, mean, std = df.agg(F.count(column), F.avg(column), F.stddev_samp(column)).first()
    stat, p = (z_test if kind == "z" else t_test)(n, mean or 0.0, std or 0.0)
    return df.sparkSession.createDataFrame([(n, mean, stat, p)], "n long, mean double, statistic double, p double")
