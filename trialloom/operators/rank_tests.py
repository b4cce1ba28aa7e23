"""Rank tests from counts of equal values; no group is sorted in one task."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from trialloom.functions.columns import null_if_not_finite
from trialloom.functions.distribution import average_ranks, with_cumulative
from trialloom.functions.smallmath import chi2_sf, normal_sf, t_two_sided


def _cell_ranks(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, rank, total) of pooled values from rows carrying counts ``c``."""
    pooled = cells.groupBy(*keys, value).agg(F.sum("__c").alias("__n"))
    cum = with_cumulative(pooled, keys, value, "__n", cum="__cum", total="__total")
    return cum.select(*keys, value, "__n", (F.col("__cum") - (F.col("__n") - 1) / 2).alias("__rank"), "__total")


def _counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    ok = F.col(value).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return df.where(ok).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_sf(float(a), float(b)) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else t_two_sided(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")


def kruskal_wallis(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """H with tie correction, groups and p per key; null with fewer than two groups."""
    cells = _counts(df, [*keys, group], value)
    ranks = _cell_ranks(cells, keys, value)
    j = cells.join(ranks, [*keys, value])
    per = j.groupBy(*keys, group).agg(F.sum(F.col("__c") * F.col("__rank")).alias("__r"), F.sum("__c").alias("__m"))
    sums = per.groupBy(*keys).agg(F.sum(F.col("__r") ** 2 / F.col("__m")).alias("__s"), F.sum("__m").cast("double").alias("__n"), F.count(F.lit(1)).alias("n_groups"))
    ties = ranks.groupBy(*keys).agg(F.sum(F.pow("__n", F.lit(3)) - F.col("__n")).alias("__t"))
    both = sums.join(ties, keys) if keys else sums.crossJoin(F.broadcast(ties))
    n = F.col("__n")
    fix = 1 - F.col("__t") / (F.pow(n, F.lit(3)) - n)
    h = F.when((F.col("n_groups") >= 2) & (fix > 0), (12 / (n * (n + 1)) * F.col("__s") - 3 * (n + 1)) / F.when(fix > 0, fix))
    return both.select(*keys, h.alias("h"), "n_groups").withColumn("p_value", chi2_tail("h", F.col("n_groups") - 1))


@lru_cache(maxsize=64)
def _u_counts(n: int, m: int) -> np.ndarray:
    """Number of rank arrangements per U for sample sizes n <= m: a Gaussian binomial coefficient.

    Factor by factor (1 - q^(m+i)) / (1 - q^i), so the work is n passes over n * m + 1 entries. The lower half
    is exact as far as floats hold integers; the upper half, where rounding would pile up, is its mirror image.
    """
    ways = np.zeros(n * m + 1)
    ways[0] = 1
    for i in range(1, n + 1):
        ways[m + i:] = ways[m + i:] - ways[: max(0, len(ways) - m - i)]
        for start in range(i):
            ways[start::i] = np.cumsum(ways[start::i])
    half = len(ways) // 2
    ways[len(ways) - half:] = ways[:half][::-1]
    return ways


@F.pandas_udf(T.DoubleType())
def mannwhitney_p(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p: exact if a sample has at most 8 values and there are no ties, else normal with tie and continuity correction."""
    out = []
    for a, x, y, t in zip(u, n, m, ties):
        x, y = int(x), int(y)
        big = max(a, x * y - a)
        if t == 0 and min(x, y) <= 8:
            w = _u_counts(min(x, y), max(x, y))
            # as many arrangements lie below x * y - U as above U; the lower end is free of cancellation
            out.append(min(1.0, 2 * float(w[: x * y - int(round(big)) + 1].sum() / math.comb(x + y, x))))
        else:
            total = x + y
            var = x * y / 12 * (total + 1 - t / (total * (total - 1)))
            out.append(min(1.0, 2 * float(normal_sf((big - x * y / 2 - 0.5) / np.sqrt(var)))) if var > 0 else 1.0)
    return pd.Series(out)


def pairwise_mannwhitney(df: DataFrame, group: str, value: str, bonferroni: bool = True) -> DataFrame:
    """Two-sided test of every pair of groups, p times the number of pairs capped at 1.

    The pairs are those of the few group labels; only value counts take part.
    """
    cells = _counts(df, [group], value)
    labels = cells.select(F.col(group).alias("__label")).distinct()
    pairs = labels.select(F.col("__label").alias("group_a")).join(labels.select(F.col("__label").alias("group_b")), F.col("group_a") < F.col("group_b"))
    as_side = lambda side: cells.join(pairs, F.col(group) == F.col(side)).select(*cells.columns, "group_a", "group_b")
    sided = as_side("group_a").unionByName(as_side("group_b"))
    k = ["group_a", "group_b"]
    ranks = _cell_ranks(sided, k, value)
    first = F.col(group) == F.col("group_a")
    j = sided.join(ranks.select(*k, value, "__rank"), [*k, value])
    s = j.groupBy(*k).agg(F.sum(F.when(first, F.col("__c") * F.col("__rank"))).alias("__ra"), F.sum(F.when(first, F.col("__c"))).alias("__na"), F.sum(F.when(~first, F.col("__c"))).alias("__nb"))
    ties = ranks.groupBy(*k).agg(F.sum(F.pow("__n", F.lit(3)) - F.col("__n")).alias("__t"))
    out = s.join(ties, k).withColumn("U", F.col("__ra") - F.col("__na") * (F.col("__na") + 1) / 2)
    out = out.withColumn("p", mannwhitney_p("U", "__na", "__nb", "__t"))
    m = pairs.agg(F.count(F.lit(1)).alias("__m"))
    scaled = F.least(F.lit(1.0), F.col("p") * F.col("__m")) if bonferroni else F.col("p")
    return out.crossJoin(F.broadcast(m)).select(*k, "U", scaled.alias("p_corrected"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation over rows finite in both columns, with the t approximation of p."""
    ok = df.select(*keys, null_if_not_finite(F.col(x).cast("double")).alias("__x"), null_if_not_finite(F.col(y).cast("double")).alias("__y")).dropna(subset=["__x", "__y"])
    rx = average_ranks(ok, keys, "__x", "__rx").select(*keys, "__x", "__rx")
    ry = average_ranks(ok, keys, "__y", "__ry").select(*keys, "__y", "__ry")
    pairs = ok.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("__w"))
    j = pairs.join(rx, [*keys, "__x"]).join(ry, [*keys, "__y"])  # both sides are large; AQE splits a hot value
    w, a, b = F.col("__w"), F.col("__rx"), F.col("__ry")
    s = j.groupBy(*keys).agg(F.sum(w).alias("__n"), F.sum(w * a).alias("__sa"), F.sum(w * b).alias("__sb"), F.sum(w * a * a).alias("__saa"), F.sum(w * b * b).alias("__sbb"), F.sum(w * a * b).alias("__sab"))
    n = F.col("__n")
    va, vb = F.col("__saa") - F.col("__sa") ** 2 / n, F.col("__sbb") - F.col("__sb") ** 2 / n
    rho = F.when((va > 0) & (vb > 0), (F.col("__sab") - F.col("__sa") * F.col("__sb") / n) / F.sqrt(F.when((va > 0) & (vb > 0), va * vb)))
    r = s.select(*keys, rho.alias("rho"), n.alias("n"))
    n = F.col("n")
    t = F.when((F.abs("rho") < 1) & (n > 2), F.col("rho") * F.sqrt((n - 2) / (1 - F.when(F.abs("rho") < 1, F.col("rho")) ** 2)))
    return r.withColumn("p_value", t_tail(t, n - 2))


def spearman_matrix(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Spearman of every pair of metric columns (few columns), one row per pair."""
    parts = [spearman(df, [], a, b).withColumns({"x": F.lit(a), "y": F.lit(b)}) for i, a in enumerate(metrics) for b in metrics[i + 1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
