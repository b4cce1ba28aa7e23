"""Join helpers for hot keys and for time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``big`` joined with ``small`` (one row per key) with each key spread over ``salts`` tasks.

    ``how`` is inner or left. ``small`` is repeated ``salts`` times, ``big`` travels once. A key
    with a third of the rows is so cut into ``salts`` reduce partitions, and AQE splits those again
    by size where they exceed the advisory partition size. The salt is the number of the input
    partition a row comes from, so no column is read only to be hashed. The copies come from a cross join:
    Spark's estimate of ``small`` counts them, and it is broadcast only if all of them fit (an explode
    is taken to leave the size as it is, and the driver would collect ``salts`` times what it expects).
    """
    numbers = small.sparkSession.range(salts).select(F.col("id").cast("int").alias("__salt"))
    spread = small.crossJoin(F.broadcast(numbers))
    salted = big.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str,
                  width: float) -> DataFrame:
    """Points with start <= t <= end, found through shared time buckets of ``width``.

    An interval is listed in every bucket it touches; a point sits in exactly one, so
    no pair appears twice and a key's work is spread over its buckets.
    """
    bucket = lambda x: F.floor(F.col(x) / F.lit(width))
    p = points.withColumn("__b", bucket(t))
    i = intervals.where(F.col(start) <= F.col(end)).withColumn("__b", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(i, [*keys, "__b"]).where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))).drop("__b")
