"""Sliding quality metrics over arriving samples, and incremental ingest of sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trialloom.operators.signals import QUALITY_METRICS
from trialloom.sources.tables import GroupStore, scratch_path

METRICS = T.StructType([T.StructField(m, T.DoubleType()) for m in QUALITY_METRICS])


@F.pandas_udf(METRICS)
def window_metrics(samples: pd.Series) -> pd.DataFrame:
    """The batch metrics of one window from its (t, v) samples, a bounded number."""
    return pd.DataFrame([_metrics(s) for s in samples], columns=QUALITY_METRICS)


def _metrics(samples) -> tuple:
    rows = sorted((r["t"], r["v"]) for r in samples)
    t, v = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    r = v - v.mean()
    if len(v) > 1 and np.ptp(t) > 0:
        x = t - t.mean()
        r = r - x * (x @ v) / (x @ x)
    q1, q2, q3 = np.percentile(r, [25, 50, 75])
    level = np.median(v)
    ar = None
    if len(r) > 2 and np.var(r[:-1]) > 0:
        a = r[:-1] - r[:-1].mean()
        ar = a @ r[1:] / (a @ a)
    return (len(np.unique(v)) / len(v), np.median(np.abs(r - q2)), (q3 - q1) / level if level != 0 else None,
            (q3 - q2) / (q2 - q1) if q2 != q1 else None, ar)


def sliding_quality(samples: DataFrame, keys: list[str], ts: str, value: str, *, width: str = "120 seconds", step: str = "60 seconds",
                    delay: str = "10 minutes") -> DataFrame:
    """Quality metrics and number of samples per (keys, window); the same plan runs on a static or a streaming table.

    State per open window is its samples (rate x width of them); samples later than ``delay`` behind
    the newest time stamp are dropped by the stream.
    """
    marked = samples.withWatermark(ts, delay) if samples.isStreaming else samples
    s = F.struct((F.unix_micros(ts) / F.lit(1e6)).alias("t"), F.col(value).cast("double").alias("v"))
    w = marked.where(F.col(value).isNotNull()).groupBy(*keys, F.window(ts, width, step)).agg(F.collect_list(s).alias("__s"))
    m = w.withColumn("__m", window_metrics("__s"))
    return m.select(*keys, F.col("window.start").alias("window_start"), *[F.col(f"__m.{x}").alias(x) for x in QUALITY_METRICS], F.size("__s").cast("long").alias("n_samples"))


def run_to_table(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Drain a stream into a table and return its latest row per key.

    Every micro-batch overwrites a folder of its own number, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    out, ck = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("updated", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out).drop("batch")
    rest = [c for c in rows.columns if c not in keys and c != "updated"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("updated")).alias("r")).select(*keys, "r.*")


def read_arriving(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def ingest_sessions(stream: DataFrame, store: GroupStore, group: str, newest: str, name: str) -> None:
    """Upsert arriving sessions into a store: the newest row per session of a batch replaces the stored one."""
    rest = [c for c in stream.columns if c != store.key]

    def write(batch: DataFrame, number: int) -> None:
        one = batch.groupBy(store.key).agg(F.max_by(F.struct(*rest), F.col(newest)).alias("r")).select(store.key, "r.*")
        if not one.isEmpty():
            store.save(group, one)

    ck = scratch_path(store.spark, f"{name}-checkpoint")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
