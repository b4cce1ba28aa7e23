"""Exact order statistics without a whole group in one task.

Equal values are counted first (partial aggregation). The distinct (key, value) rows are
range-partitioned, so Spark's own sampling balances the parts whatever the distribution, and
ranks are running sums inside a part plus the totals of the key's parts before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from trialloom.session import cut_lineage


def value_counts(df: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))


def with_cumulative(
    counts: DataFrame, keys: list[str], value: str, n: str = "n", *, cum: str = "cum", total: str = "total", keep=None,
) -> DataFrame:
    """Add the inclusive cumulative count of ``n`` along ``value`` per key.

    ``counts`` has one row per (keys, value). ``keep`` may prune parts before the windows: a
    function of (low, high, total) rank bounds returning a condition. The range partitioning is
    written out once, because the part numbers are read twice and must not change in between.
    """
    parts = cut_lineage(counts.repartitionByRange(*keys, value).withColumn("__b", F.spark_partition_id()))
    per_part = parts.groupBy(*keys, "__b").agg(F.sum(n).alias("__bn"))
    wk = W.partitionBy(*keys)
    offsets = per_part.select(
        *keys, "__b",
        F.coalesce(F.sum("__bn").over(wk.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.col("__bn"),
        F.sum("__bn").over(wk).alias(total),
    )
    if keep is not None:
        offsets = offsets.where(keep(F.col("__off"), F.col("__off") + F.col("__bn"), F.col(total)))
    inside = W.partitionBy(*keys, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return parts.join(offsets.drop("__bn"), [*keys, "__b"]).select(
        *counts.columns, (F.col("__off") + F.sum(n).over(inside)).alias(cum), F.col(total)
    )


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key.

    Rows with a null value do not count; keys without any value get no row.
    """
    def wanted(lo, hi, total):
        cond = F.lit(False)
        for p in probs.values():
            pos = F.lit(float(p)) * (total - 1)
            cond = cond | ((F.floor(pos) < hi) & (F.ceil(pos) >= lo))
        return cond

    cum = with_cumulative(value_counts(df, keys, value), keys, value, keep=wanted)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        holds = lambda r: (F.col("cum") - F.col("n") <= r) & (r < F.col("cum"))
        aggs += [
            F.max(F.when(holds(F.floor(pos)), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when(holds(F.ceil(pos)), F.col(value))).alias(f"__hi_{name}"),
        ]
    grouped = cum.groupBy(*keys).agg(F.max("total").alias("__total"), *aggs)
    outs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        outs.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return grouped.select(*keys, *outs)


def average_ranks(df: DataFrame, keys: list[str], value: str, rank: str = "avg_rank") -> DataFrame:
    """(keys, value, n, avg_rank, total): the tie-averaged rank of every distinct value."""
    cum = with_cumulative(value_counts(df, keys, value), keys, value)
    return cum.select(
        *keys, value, "n", (F.col("cum") - (F.col("n") - 1) / 2).alias(rank), "total"
    )
