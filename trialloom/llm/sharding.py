"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows input partition p sends to shard s is drawn first: the matrix of these counts follows
the law it has under a uniform permutation of all rows, with row sums the partitions' sizes and
column sums the shards' sizes. Each partition then permutes locally (a random order of exactly those
shard labels), rows are exchanged, and each shard permutes again (rank by a random key, in blocks, so
no shard is sorted by one task). The driver sees one count per partition, never a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, LongType

from trialloom.llm.base import query, table
from trialloom.session import cut_lineage

SHARDS = 24
BLOCK_ROWS = 20_000  # rows of a shard ranked together, on average


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of good + bad, by inversion outwards from the mean.

    The probabilities in a window of 40 standard deviations come from the ratios of neighbours, so
    sizes are not limited as in the library's generator.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mean = draws * good / total
    sd = (mean * (bad / total) * max(0.0, (total - draws) / max(1, total - 1))) ** 0.5
    a, b = max(low, int(mean - 40 * sd) - 40), min(high, int(mean + 40 * sd) + 40)
    k = np.arange(a, b, dtype=np.float64)
    ratios = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    cum = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(cum, rng.random() * cum[-1], side="right"))


def split_counts(rng: np.random.Generator, colours: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric draw from ``colours`` (counts per shard)."""
    out, rest = np.zeros(len(colours), dtype=np.int64), int(colours.sum())
    for s, have in enumerate(colours.tolist()):
        rest -= have
        out[s] = hypergeometric(rng, have, rest, draws) if draws else 0
        draws -= int(out[s])
    return out


def communication_matrix(sizes: dict[int, int], shards: int, seed: int) -> dict[int, np.ndarray]:
    """Counts per (partition, shard); shard sizes differ by one at most."""
    rng, rows = np.random.default_rng([seed, 0]), sum(sizes.values())
    left = np.full(shards, rows // shards, dtype=np.int64)
    left[rng.permutation(shards)[: rows % shards]] += 1
    matrix = {}
    for p in sorted(sizes):
        matrix[p] = split_counts(rng, left, sizes[p])
        left = left - matrix[p]
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """``df`` plus shard (int) and slot (long, gapless from 0 in each shard), in uniform random order.

    Row counts of shards differ by one at most, whatever the rows hold: nulls, repeated rows and
    ties are rows like any other. An empty table stays empty. Columns named shard or slot are
    replaced. ``df`` is written to the checkpoint folder first, so that partitions and their order
    are the same for counting and dealing and after the loss of an executor; draws depend on the
    seed and the partition only.
    """
    rest = [c for c in df.columns if c not in ("shard", "slot", "__key")]
    held = cut_lineage(df.select(*rest))
    sizes = {r[0]: r[1] for r in held.groupBy(F.spark_partition_id()).count().collect()}
    matrix = held.sparkSession.sparkContext.broadcast(communication_matrix(sizes, shards, seed))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = TaskContext.get().partitionId(), 0
        counts = matrix.value.get(p)
        if counts is None:
            return
        rng = np.random.default_rng([seed, 1, p])
        labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), counts))
        for batch in batches:
            n = batch.num_rows
            keys = rng.integers(0, 2**63, n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[at:at + n]), pa.array(keys)], names=[*rest, "shard", "__key"])
            at += n

    schema = held.schema
    dealt = held.mapInArrow(deal, type(schema)(schema.fields[:]).add("shard", IntegerType()).add("__key", LongType()))
    blocks = max(64, sum(sizes.values()) // (shards * BLOCK_ROWS))
    dealt = dealt.withColumn("__block", F.floor(F.col("__key") / F.lit(float(2**63)) * blocks).cast("int"))
    before = W.partitionBy("shard").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "__block").count().select(
        "shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(W.partitionBy("shard", "__block").orderBy("__key"))
    return dealt.withColumn("__rank", rank).join(offsets, ["shard", "__block"]).select(
        *rest, "shard", (F.col("__offset") + F.col("__rank") - 1).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write shuffled rows as one folder per shard, rows in slot order."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op4_sharding")
def op4_sharding(spark, sf_dir):
    """Shard and slot of every document; shard row counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
