"""Fits of many folds at once against one at a time, and scans that sort their rows once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trialloom.functions import smallmath
from trialloom.functions.scan import ordered_scan


def moments(x, y):
    m = np.column_stack([np.ones(len(x)), x, y])
    return m.T @ m


def test_fits_without_equals_single_fits():
    rng = np.random.default_rng(3)
    grams = []
    for k in range(30):
        x = rng.normal(size=(5 + k % 4, 2))
        grams.append(moments(x, x @ [1.0, -0.5] + rng.normal() + rng.normal(size=len(x))))
    grams, rows = np.array(grams), np.array(grams)[:, 0]
    sizes = np.unique(rows[:, 0])
    of = [rows[:, 0] == n for n in sizes]
    sums = smallmath.SubjectSums(grams.sum(axis=0), sizes, np.array([h.sum() for h in of], float), np.array([rows[h].T @ rows[h] for h in of]), np.array([rows[h].sum(axis=0) for h in of]))
    for columns in ([0, 1, 2], [0, 2], [0]):
        for reml in (False, True):
            for g, got in zip(grams, sums.fits_without(grams, columns, reml)):
                want = sums.without(g).fit(columns, reml)
                assert np.allclose(got.beta, want.beta, rtol=1e-6) and np.allclose(got.cov, want.cov, rtol=1e-4)
                assert np.allclose(got.variance_explained(), want.variance_explained(), rtol=1e-5)
                assert np.isclose(got.held_out_r2(g), want.held_out_r2(g), rtol=1e-5)


def test_ridge_path_solves_all_folds_and_alphas_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4))
    y = x @ [1.0, 0.5, 0.0, -1.0] + rng.normal(size=50)
    folds = [moments(x[a:a + 10], y[a:a + 10]) for a in range(0, 50, 10)]
    calls, solve = [], np.linalg.solve
    monkeypatch.setattr(smallmath.np.linalg, "solve", lambda *a: calls.append(1) or solve(*a))
    fit = smallmath.ridge_path(sum(folds), folds, [0.1, 1.0, 10.0])
    assert len(calls) == 2
    z = (x - x.mean(axis=0)) / x.std(axis=0)

    def left_out(alpha):
        out = 0.0
        for a in range(0, 50, 10):
            rest = np.r_[0:a, a + 10:50]
            c = z[rest] - z[rest].mean(axis=0)
            b = solve(c.T @ c + alpha * np.eye(4), c.T @ (y[rest] - y[rest].mean()))
            out += ((y[a:a + 10] - y[rest].mean() - (z[a:a + 10] - z[rest].mean(axis=0)) @ b) ** 2).sum()
        return 1 - out / ((y - y.mean()) ** 2).sum()

    scores = [left_out(a) for a in (0.1, 1.0, 10.0)]
    assert np.isclose(fit["cv_r2"], max(scores)) and fit["alpha"] == (0.1, 1.0, 10.0)[int(np.argmax(scores))]


def test_scan_sorts_its_rows_once(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = spark.createDataFrame([(k % 3, k, float(-k)) for k in range(60)], "eid long, t long, v double")
        s = ordered_scan(rows, ["eid"], ["t"], F.floor(F.col("t") / 7), index="i", lag={"p": "v"}, running={"r": F.col("v")})
        plan = s._jdf.queryExecution().executedPlan().toString()
        own = [x for x in plan.splitlines() if "Sort [" in x and "t#" in x.split("Sort [")[1]]
        whole = [x for x in plan.splitlines() if "Sort [" in x]
        assert len(own) == 1 and len(whole) == 5, plan  # one for the rows, the rest for sums and borders
        got = sorted((r.eid, r.i, r.p, r.r) for r in s.collect())
        assert got == sorted((e, i, None if not i else -float(e + 3 * i - 3), -float(sum(range(e, e + 3 * i + 1, 3)))) for e in range(3) for i in range(20))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
