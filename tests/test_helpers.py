"""Scans, order statistics and joins against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialloom.functions import columns as col
from trialloom.functions.distribution import average_ranks, grouped_quantiles
from trialloom.functions.joins import interval_join, skew_join
from trialloom.functions.scan import ordered_scan, time_chunk


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    # one key holds most rows, another has a single one
    k = rng.choice(["hot", "warm"], 500, p=[0.9, 0.1]).tolist() + ["one"]
    t = rng.permutation(501) / 7.0
    v = np.where(rng.random(501) < 0.3, np.nan, rng.integers(0, 20, 501)).astype(float)
    pdf = pd.DataFrame({"k": k, "t": t, "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", col.null_if_nan("v"))
    return pdf, df


@pytest.mark.parametrize("width", [0.5, 5.0, 1000.0])
def test_ordered_scan_equals_unchunked(frame, width):
    pdf, df = frame
    got = ordered_scan(
        df, ["k"], ["t"], time_chunk("t", width), index="i", lag={"lg": "v"}, lead={"ld": "v"},
        running={"run": F.col("t")}, prev_valid={"pv": F.col("v")}, next_valid={"nv": F.col("v")}, total="n",
    ).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    g = want.groupby("k")
    assert (got["i"] == g.cumcount()).all()
    assert (got["n"] == g["t"].transform("size")).all()
    np.testing.assert_allclose(got["run"], g["t"].cumsum())
    for name, expected in {"lg": g["v"].shift(1), "ld": g["v"].shift(-1), "pv": g["v"].ffill(), "nv": g["v"].bfill()}.items():
        np.testing.assert_array_equal(got[name].to_numpy(float), expected.to_numpy(float), err_msg=name)


def test_quantiles_and_ranks(frame):
    pdf, df = frame
    q = grouped_quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 1.0}).toPandas().set_index("k")
    for k, part in pdf.dropna().groupby("k"):
        np.testing.assert_allclose(q.loc[k, ["a", "m", "z"]].astype(float), part["v"].quantile([0.1, 0.5, 1.0]))
    r = average_ranks(df, ["k"], "v").toPandas().set_index(["k", "v"])["avg_rank"]
    want = pdf.dropna().assign(r=pdf.dropna().groupby("k")["v"].rank()).groupby(["k", "v"])["r"].first()
    np.testing.assert_allclose(r.sort_index(), want.sort_index())


def test_skew_and_interval_join(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    assert skew_join(big, small, ["k"]).count() == big.join(small, "k").count()
    assert skew_join(big, small, ["k"], "left").count() == 1000
    pts = spark.createDataFrame([(1, x / 2) for x in range(40)], "k long, t double")
    iv = spark.createDataFrame([(1, 1.0, 9.0, "a"), (1, 8.5, 8.5, "b"), (1, 5.0, 4.0, "never"), (2, 0.0, 99.0, "c")], "k long, s double, e double, n string")
    got = interval_join(pts, iv, ["k"], "t", "s", "e", 2.0).groupBy("n").count().toPandas().set_index("n")["count"].to_dict()
    assert got == {"a": 17, "b": 1}


def test_special_functions(spark):
    import math

    rows = spark.createDataFrame([(x / 10,) for x in range(-30, 31)], "x double").select("x", col.erf("x").alias("e")).collect()
    assert max(abs(r["e"] - math.erf(r["x"])) for r in rows) < 2e-7
    p = spark.createDataFrame([(0.0,), (0.025,), (0.5,), (0.9,), (1.0,)], "p double").select(col.probit("p").alias("z")).toPandas()["z"]
    np.testing.assert_allclose(p, [-5.19934, -1.959964, 0, 1.281552, 5.19934], atol=1e-4)
    assert spark.range(1).select(col.safe_div(F.lit(1.0), F.lit(0.0)).alias("x")).first()["x"] is None
