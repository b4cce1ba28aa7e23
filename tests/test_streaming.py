"""Streaming forms against the same plan on a static table."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialloom.operators import signals as sig
from trialloom.sources.tables import GroupStore, scratch_path
from trialloom.streaming import quality


def _samples(spark):
    rng = np.random.default_rng(0)
    t = pd.date_range("2024-01-01", periods=600, freq="s")
    pdf = pd.DataFrame({"eid": np.where(np.arange(600) % 2, "a", "b"), "ts": t, "v": rng.normal(10, 1, 600).round(1)})
    return spark.createDataFrame(pdf)


def test_stream_equals_batch(spark):
    df = _samples(spark)
    folder = scratch_path(spark, "arriving")
    df.where("ts < '2024-01-01T00:05:00'").coalesce(1).write.mode("append").parquet(folder)
    df.where("ts >= '2024-01-01T00:05:00'").coalesce(1).write.mode("append").parquet(folder)
    stream = quality.read_arriving(spark, folder, "*.parquet")
    got = quality.run_to_table(quality.sliding_quality(stream, ["eid"], "ts", "v"), ["eid", "window_start"], "q").toPandas()
    want = quality.sliding_quality(df, ["eid"], "ts", "v").toPandas()
    cols = ["eid", "window_start", *sig.QUALITY_METRICS]
    a, b = (x[cols].sort_values(cols[:2]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)


def test_array_metrics_equal_column_metrics(spark):
    df = _samples(spark).withColumn("t", (F.unix_micros("ts") / 1e6) % 86400)
    a = quality.sliding_quality(df, ["eid"], "ts", "v").withColumn("window", (F.unix_seconds("window_start") % 86400 / 60).cast("long")).toPandas()
    b = sig.window_quality(sig.sliding_windows(df, ["eid"], "t"), ["eid", "window"], "t", "v").toPandas()
    j = a.merge(b, on=["eid", "window"])
    assert len(j) >= 18
    for m in sig.QUALITY_METRICS:
        np.testing.assert_allclose(j[f"{m}_x"], j[f"{m}_y"], rtol=1e-6, err_msg=m)


def test_ingest_keeps_newest_and_replaces(spark):
    folder = scratch_path(spark, "incoming")
    spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "eid long, at long, s string").coalesce(1).write.parquet(folder)
    store = GroupStore(spark, scratch_path(spark, "store"), buckets=4)
    store.save("sessions", spark.createDataFrame([(2, 0, "stale"), (3, 0, "kept")], "eid long, at long, s string"))
    quality.ingest_sessions(quality.read_arriving(spark, folder, "*.parquet"), store, "sessions", "at", "ingest")
    got = {r["eid"]: r["s"] for r in store.load(["sessions"])["sessions"].collect()}
    assert got == {1: "new", 2: "only", 3: "kept"}
