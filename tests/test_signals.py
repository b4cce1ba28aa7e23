"""Windows and signal operators against direct computation on small recordings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialloom.operators import signals as sig, windows as win
from trialloom.functions.scan import ordered_scan, time_chunk


@pytest.fixture(scope="module")
def recording(spark):
    n, fs = 300, 30.0
    pdf = pd.DataFrame({"eid": "a", "idx": np.arange(n), "t": np.arange(n) / fs})
    pdf["v"] = 2 * pdf["t"]
    return spark.createDataFrame(pdf)


def test_event_windows(spark, recording):
    ev = spark.createDataFrame([("a", 0, 2.0, 2.1), ("a", 1, 9.9, None), ("a", 2, None, None), ("a", 3, 4.01, None)], "eid string, trial long, ev double, stop double")
    rates = win.sampling_rates(recording, ["eid"], "t", 2.0)
    assert rates.first()["fs"] == 30
    args = dict(keys=["eid"], t="t", idx="idx", value="v", event_time="ev", t0=-0.5, t1=1.0, rates=rates, chunk_width=2.0)
    got = win.event_windows(recording, ev, **args).toPandas()
    assert got.groupby("trial").size().to_dict() == {0: 45, 1: 45, 2: 45, 3: 45}
    first = got[got.trial == 0].sort_values("offset")
    np.testing.assert_allclose(first["response"], 2 * (2.0 + first["offset"] / 30))
    assert got[got.trial.isin([1, 2])]["response"].isna().all()  # reaches past the end; no event time
    # the anchor is the first sample at or after the event: 4.01 s -> sample 121
    third = got[(got.trial == 3) & (got.offset == 0)]["response"].iloc[0]
    assert third == pytest.approx(2 * 121 / 30)
    masked = win.event_windows(recording, ev.where("trial = 0"), **{**args, "end_time": "stop"}).toPandas()
    assert masked["response"].notna().sum() == (masked["time"] <= 0.1 + 1e-12).sum()


def test_window_edges_and_baseline(spark):
    rows = spark.createDataFrame([(0, x / 10, float(x)) for x in range(-2, 4)], "trial long, time double, response double")
    assert win.response_magnitude(rows, ["trial"], (0.1, 0.3)).first()["response"] == 1.5  # end is exclusive
    base = win.subtract_baseline(rows, ["trial"], (-0.2, 0.0)).toPandas().sort_values("time")
    np.testing.assert_allclose(base["response"], np.arange(-2, 4) + 1.5)
    holed = rows.withColumn("response", F.when(F.col("time") != -0.1, F.col("response")))
    assert win.normalize_responses(holed, ["trial"], (-0.2, 0.0)).where("response IS NOT NULL").count() == 0
    assert win.window_delta(rows, ["trial"], (0.0, 0.4), (-0.2, 0.0), 3).first()["delta"] is None


def _irregular(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(0.2, 1.5, n))
    pdf = pd.DataFrame({"eid": "a", "t": t, "v": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf)


def _pchip_at(x, y, q):
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = np.clip(np.searchsorted(x, q, side="right") - 1, 0, len(x) - 2)
    u = (q - x[i]) / h[i]
    return ((1 + 2 * u) * (1 - u) ** 2 * y[i] + u * (1 - u) ** 2 * h[i] * m[i] + u ** 2 * (3 - 2 * u) * y[i + 1] + u ** 2 * (u - 1) * h[i] * m[i + 1])


@pytest.mark.parametrize("width", [3.0, 500.0])
def test_resampling(spark, width):
    pdf, df = _irregular(spark)
    x, y = pdf["t"].to_numpy(), pdf["v"].to_numpy()
    lin = sig.resample_linear(df, ["eid"], "t", "v", 4.0, width).toPandas().sort_values("grid")
    np.testing.assert_allclose(lin["v"], np.interp(lin["t"], x, y), atol=1e-9)
    assert len(lin) == int(np.ceil((x[-1] - x[0]) * 4))
    cub = sig.pchip_resample(df, ["eid"], "t", "v", 4.0, width).toPandas().sort_values("grid")
    np.testing.assert_allclose(cub["v"], _pchip_at(x, y, cub["t"].to_numpy()), atol=1e-9)


def test_quadratic_spline_pieces_equal_whole(spark):
    pdf, df = _irregular(spark, 300)
    idx = ordered_scan(df, ["eid"], ["t"], time_chunk("t", 50.0), index="idx")
    whole = sig.quadratic_spline(idx, ["eid"], "idx", "t", "v", 3.0, piece=4096).toPandas().sort_values("grid")
    parts = sig.quadratic_spline(idx, ["eid"], "idx", "t", "v", 3.0, piece=40, halo=30).toPandas().sort_values("grid")
    assert whole["grid"].tolist() == parts["grid"].tolist()
    np.testing.assert_allclose(parts["v"], whole["v"], atol=1e-8)
    # the spline passes through its data and reproduces a parabola
    x = pdf["t"].to_numpy()
    np.testing.assert_allclose(sig._quadratic_through(x, pdf["v"].to_numpy(), x), pdf["v"], atol=1e-8)
    np.testing.assert_allclose(sig._quadratic_through(x, x ** 2, (x[1:] + x[:-1]) / 2), ((x[1:] + x[:-1]) / 2) ** 2, rtol=1e-6)


def test_lowpass_pieces_equal_whole(spark):
    rng = np.random.default_rng(0)
    v = np.cumsum(rng.normal(size=900))
    df = spark.createDataFrame(pd.DataFrame({"eid": "a", "idx": np.arange(900), "v": v}))
    args = dict(cutoff=0.2, half=128)
    whole = sig.lowpass(df, ["eid"], "idx", "v", piece=100000, **args).toPandas().sort_values("idx")
    parts = sig.lowpass(df, ["eid"], "idx", "v", piece=200, **args).toPandas().sort_values("idx")
    assert parts["idx"].tolist() == list(range(900))
    np.testing.assert_allclose(parts["lowpass"], whole["lowpass"], atol=1e-8)
    const = sig.lowpass(df.withColumn("v", F.lit(5.0)), ["eid"], "idx", "v", piece=200, **args).toPandas()
    np.testing.assert_allclose(const["lowpass"], 5.0, atol=1e-9)


def test_crosscorr_blocks(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=400)
    b = np.roll(a, 3) + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"eid": "a", "i": np.arange(400), "a": a, "b": b}))
    cc = sig.lagged_crosscorr(df, ["eid"], "i", "a", "b", 7, block=50).toPandas().set_index("lag")["cc"]
    za, zb = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
    for lag in range(-7, 8):
        i = np.arange(max(0, -lag), min(400, 400 - lag))
        assert cc[lag] == pytest.approx((za[i] * zb[i + lag]).sum() / 400, abs=1e-9)
    peak = sig.crosscorr_peaks(sig.lagged_crosscorr(df, ["eid"], "i", "a", "b", 7), ["eid"], 1.0).first()
    assert peak["peak_lag"] == 3.0  # a leads b


def test_bleaching_tau_recovers(spark):
    t = np.arange(0, 600, 0.5)
    df = spark.createDataFrame(pd.DataFrame({"eid": "a", "t": t, "v": 3 + 2 * np.exp(-t / 300)}))
    tau = sig.bleaching_tau(df, ["eid"], "t", "v", 10.0, 5000.0, passes=3).first()["bleaching_tau"]
    assert tau == pytest.approx(300, rel=0.01)


def test_preprocess_removes_reference(spark):
    rng = np.random.default_rng(2)
    n = 600
    shared, own = rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"eid": "a", "idx": np.arange(n), "t": np.arange(n) / 10, "s": 100 + 3 * shared + own, "r": 100 + shared}))
    out = sig.preprocess(df, ["eid"], "idx", "t", "s", "r", fs=10.0, chunk_width=20.0, cutoff=0.05, half=128).toPandas().sort_values("grid")
    m = min(len(out), n)
    assert abs(np.corrcoef(out["value"][:m], shared[:m])[0, 1]) < 0.1
    assert np.corrcoef(out["value"][:m], own[:m])[0, 1] > 0.95
