"""Connected components of links that stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialloom.llm.base import stored

FEW_EDGES = 100_000  # links (1.6 MB) that one task may finish, however large the table they came from


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label) of the components of at most FEW_EDGES links (u, v)."""
    parent: dict[int, int] = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], names=["id", "label"])


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable, for every id of ``links`` (a, b), both long.

    Every round hooks each vertex and its neighbours to their smallest neighbour (large star, then
    small star) until only stars are left: a number of rounds logarithmic in the ids. A vertex of very
    high degree is reduced by map-side minima; its edges are a join that AQE can split. The links are
    counted before each round: FEW_EDGES or fewer are finished by one task instead of further rounds.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def stars(e):
        """Whether every vertex hangs on one centre, and no centre hangs on another."""
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(e.select("v", F.lit(0), F.lit(1)))
        seen = ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        return seen.where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()

    while True:
        if edges.count() <= FEW_EDGES:
            return stored(edges.coalesce(1).mapInArrow(_finish, "id long, label long"), "few-labels")
        if stars(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("a"), F.col("m"), F.col("u"))
        small = small.select(F.col("a").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "small-star")
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("label", F.col("id"))
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label")).union(roots)
