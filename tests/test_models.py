"""Models from moment sums against direct fits on the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialloom.functions import smallmath as sm
from trialloom.operators import derive, encoding as enc, decoding as dec, features as fea, linear, mixed, multivariate as mv, rank_tests as rt

TERMS = derive.crossed("a", "b")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 600
    pdf = pd.DataFrame({"g": "x", "s": rng.integers(0, 8, n), "a": rng.normal(size=n), "b": rng.choice([-0.5, 0.5], n)})
    effect = rng.normal(0, 1.0, 8)
    pdf["y"] = 1 + 0.5 * pdf.a + 0.2 * pdf.b + effect[pdf.s] + rng.normal(size=n)
    return pdf, spark.createDataFrame(pdf)


def design(pdf, terms=TERMS):
    return np.column_stack([np.ones(len(pdf))] + [np.prod([pdf[v] for v in t], axis=0) for t in terms])


def r2(x, y):
    res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return 1 - res @ res / ((y - y.mean()) @ (y - y.mean()))


def test_ols_and_drop_one(data):
    pdf, df = data
    g = linear.model_gram(df, ["g"], TERMS, "y")
    c = linear.ols_coefficients(g, ["g"], TERMS).toPandas().set_index("term")
    x, y = design(pdf), pdf.y.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    np.testing.assert_allclose(c.loc[["Intercept", "a", "b", "a:b"], "coef"], beta, atol=1e-8)
    res = y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (res @ res) / (len(y) - 4))
    np.testing.assert_allclose(c.loc[["Intercept", "a", "b", "a:b"], "coef_se"], se, atol=1e-8)
    d = linear.drop_one(g, ["g"], TERMS, ["a", "b"]).toPandas().set_index("predictor")
    for v, left in (("a", [("b",)]), ("b", [("a",)])):
        assert d.loc[v, "delta_r2"] == pytest.approx(r2(x, y) - r2(design(pdf, left), y), abs=1e-9)


def test_rank_deficient_design_is_null(spark):
    df = spark.createDataFrame([("x", float(i), 2.0 * i, float(i % 3)) for i in range(20)], "g string, a double, b double, y double")
    g = linear.model_gram(df, ["g"], [("a",), ("b",)], "y")
    assert linear.ols_coefficients(g, ["g"], [("a",), ("b",)]).where("coef IS NOT NULL").count() == 0
    assert linear.drop_one(g, ["g"], [("a",), ("b",)], ["a"]).count() == 0


def dense_mixed(x, y, s, reml):
    """Random intercept by direct likelihood on the full covariance."""
    z = (s[:, None] == np.unique(s)[None]).astype(float)

    def crit(ratio):
        v = np.eye(len(y)) + ratio * z @ z.T
        vi = np.linalg.inv(v)
        xtvx = x.T @ vi @ x
        b = np.linalg.solve(xtvx, x.T @ vi @ y)
        e = y - x @ b
        rss = e @ vi @ e
        val = np.linalg.slogdet(v)[1] + ((len(y) - x.shape[1]) * np.log(rss) + np.linalg.slogdet(xtvx)[1] if reml else len(y) * np.log(rss))
        return val, b, vi, xtvx, rss

    grid = np.exp(np.linspace(-6, 3, 40))
    best = grid[np.argmin([crit(r)[0] for r in grid])]
    for _ in range(4):
        local = np.linspace(best * 0.8, best * 1.25, 21)
        best = local[np.argmin([crit(r)[0] for r in local])]
    return best, crit(best), z


@pytest.mark.parametrize("reml", [True, False])
def test_mixed_model_equals_dense(data, reml):
    pdf, df = data
    g = mixed.subject_grams(df, ["g"], "s", TERMS, "y")
    sums = mixed.group_sums(g, ["g"], len(TERMS) + 2)
    got = mixed.mixed_coefficients(sums, ["g"], TERMS, reml).toPandas().set_index("term").loc[["Intercept", "a", "b", "a:b"]]
    x, y, s = design(pdf), pdf.y.to_numpy(), pdf.s.to_numpy()
    ratio, (_, b, vi, xtvx, rss), z = dense_mixed(x, y, s, reml)
    np.testing.assert_allclose(got["coef"], b, atol=1e-3)
    sigma2 = rss / (len(y) - 4 if reml else len(y))
    np.testing.assert_allclose(got["se"], np.sqrt(np.diag(np.linalg.inv(xtvx)) * sigma2), rtol=2e-2)
    fit = mixed.mixed_fits(sums, ["g"], TERMS, {"full": TERMS}, reml).first()
    blup = ratio * z @ (z.T @ (vi @ (y - x @ b)))
    assert fit["marginal_r2"] == pytest.approx(np.var(x @ b) / np.var(y), abs=2e-3)
    assert fit["conditional_r2"] == pytest.approx((np.var(x @ b) + np.var(blup)) / np.var(y), abs=2e-3)
    u = mixed.random_intercepts(g, sums, ["g"], "s", TERMS, reml).toPandas().set_index("s")["intercept"]
    np.testing.assert_allclose([u[k] for k in s], blup, atol=5e-3)


def test_leave_one_out_equals_refit(spark, data):
    pdf, df = data
    g = mixed.subject_grams(df, ["g"], "s", TERMS, "y")
    sums = mixed.group_sums(g, ["g"], len(TERMS) + 2)
    cv = mixed.crossval(g, sums, ["g"], "s", TERMS, ["a", "b"]).toPandas()
    jk = mixed.jackknife(g, sums, ["g"], "s", TERMS, ["a"]).toPandas().set_index("fold")
    rest = df.where("s <> 3")
    gr = mixed.subject_grams(rest, ["g"], "s", TERMS, "y")
    direct = mixed.mixed_fits(mixed.group_sums(gr, ["g"], len(TERMS) + 2), ["g"], TERMS, derive.drop_one_family(TERMS, ["a"]), reml=False).toPandas().set_index("name")["marginal_r2"]
    assert jk.loc["3", "r2"] == pytest.approx(direct["full"], abs=1e-6)
    assert jk.loc["3", "delta_r2"] == pytest.approx(direct["full"] - direct["a"], abs=1e-6)
    tr, te = pdf[pdf.s != 3], pdf[pdf.s == 3]
    _, (_, b, *_), _ = dense_mixed(design(tr), tr.y.to_numpy(), tr.s.to_numpy(), False)
    p, y = design(te) @ b, te.y.to_numpy()
    e, c = (y - y.mean()) - (p - p.mean()), y - y.mean()
    row = cv[(cv.fold == "3") & (cv.predictor == "a")].iloc[0]
    assert row["r2"] == pytest.approx(1 - e @ e / (c @ c), abs=1e-3)
    total = cv[(cv.fold == "aggregate") & (cv.predictor == "a")].iloc[0]
    assert total["n_trials"] == 600 and total["r2"] == pytest.approx(cv[(cv.fold != "aggregate") & (cv.predictor == "a")]["r2"].mean())


def test_swap_null_equals_refits(spark):
    rng = np.random.default_rng(11)
    parts = []
    for u, n in (("p", 40), ("q", 33), ("r", 55)):
        parts.append(pd.DataFrame({"g": "x", "u": u, "rk": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "y": rng.normal(size=n)}))
    pdf = pd.concat(parts)
    for block, chunk in ((32, 512), (1, 8)):
        got = linear.paired_moments(spark.createDataFrame(pdf), ["g"], "u", "rk", {"one": F.lit(1.0), "y": F.col("y")}, {"x": F.col("a"), "one": F.lit(1.0)},
                                    {"n": ("one", "one"), "yx": ("y", "x")}, block=block, chunk=chunk).toPandas().set_index(["u", "donor"])
        assert len(got) == 6 and got.loc[("p", "q"), "n"] == 33
        p, q = parts[0], parts[1]
        assert got.loc[("p", "q"), "yx"] == pytest.approx(p.y[:33] @ q.a[:33])
    null = linear.swap_null(spark.createDataFrame(pdf), ["g"], "u", "rk", TERMS, "a", "y").toPandas().set_index(["u", "donor"])["delta_r2"]
    for f in parts:
        for d in parts:
            if f is d:
                continue
            n = min(len(f), len(d))
            sw = f.iloc[:n].assign(a=d.a.to_numpy()[:n])
            want = r2(design(sw), sw.y.to_numpy()) - r2(design(sw, [("b",)]), sw.y.to_numpy())
            assert null[(f.u.iloc[0], d.u.iloc[0])] == pytest.approx(want, abs=1e-9)


def test_permutation_p(spark):
    null = spark.createDataFrame([("k", x) for x in (0.01, 0.09, 0.02)], "k string, v double")
    obs = spark.createDataFrame([("k", 0.095)], "k string, v double")
    assert linear.permutation_pvalues(null, obs, ["k"], "v").first()["p_value"] == pytest.approx(1 / 4)
    ragged = spark.createDataFrame([("k", "s1", 1, 0.1), ("k", "s1", 2, 0.2), ("k", "s2", 1, 0.1)], "k string, s string, i int, v double")
    two = spark.createDataFrame([("k", "s1", 0.3), ("k", "s2", 0.1)], "k string, s string, v double")
    with pytest.raises(Exception, match="unequal"):
        linear.synchronized_pvalues(ragged, two, ["k"], "s", "i", "v").collect()


def swap_units(n, alone=True, slope=0.0, seed=0):
    rng = np.random.default_rng(seed)
    parts = []
    for i in range(n):
        x = rng.normal(size=30)
        parts.append(pd.DataFrame({"g": "x", "u": i, "rk": np.arange(30), "y": slope * x + rng.normal(size=30), "x": x}))
    if alone:
        parts.append(pd.DataFrame({"g": "alone", "u": 99, "rk": np.arange(30), "y": rng.normal(size=30), "x": rng.normal(size=30)}))
    return pd.concat(parts)


@pytest.mark.parametrize("units, n_iter", [(4, 500), (40, 8)])
def test_session_permutation_draws(spark, units, n_iter):
    rows = swap_units(units)
    df = spark.createDataFrame(rows)
    p = linear.session_permutation_test(df, ["g"], "u", "rk", "y", "x", "r2", n_iter, seed=3).toPandas().set_index("u")
    assert (p.loc[list(range(units)), "null_r2"].map(len) == n_iter).all() and np.isclose(p.loc[0, "observed_r2"], np.corrcoef(rows[rows.u == 0].x, rows[rows.u == 0].y)[0, 1] ** 2)
    assert p.loc[99, "error"] == "no donor sessions" and np.isnan(p.loc[99, "p_value"])
    pairs = linear.pair_regressions(df, ["g"], "u", "rk", "y", "x").toPandas()
    all_r2 = pairs[pairs.u == 0]["r2"].to_numpy()
    assert all(np.isclose(all_r2, v).any() for v in p.loc[0, "null_r2"])


def test_session_permutation_tails(spark):
    df = spark.createDataFrame(swap_units(12, alone=False, slope=3.0))
    p = {a: linear.session_permutation_test(df, [], "u", "rk", "y", "x", "slope", 199, seed=1, alternative=a).toPandas() for a in ("greater", "less", "two-sided")}
    assert (p["greater"]["p_value"] == 0.005).all() and (p["less"]["p_value"] == 1.0).all() and (p["two-sided"]["p_value"] == 0.01).all()
    with pytest.raises(ValueError):
        linear.session_permutation_test(df, [], "u", "rk", "y", "x", "slope", 9, alternative="both")


def test_session_permutation_logistic(spark):
    rows = swap_units(6, alone=False, slope=2.0)
    rows["k"] = (rows["y"] > 0).astype(float)
    p = linear.session_permutation_test(spark.createDataFrame(rows), ["g"], "u", "rk", "k", "x", "pseudo_r2", 50, alternative="greater", model="logistic").toPandas()
    assert (p["p_value"] < 0.2).all() and (p["observed_slope"] > 0).all() and p["error"].isna().all()


def test_tails():
    assert sm.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert sm.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-7)
    assert sm.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert float(sm.normal_sf(1.959963984540054)) == pytest.approx(0.025, abs=1e-12)


def test_mannwhitney_exact_and_pairs(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in (5, 6, 7, 8)] + [("c", 4.5)], "g string, v double")
    r = rt.pairwise_mannwhitney(df, "g", "v", bonferroni=False).toPandas().set_index(["group_a", "group_b"])
    assert r.loc[("a", "b"), "U"] == 0 and r.loc[("a", "b"), "p_corrected"] == pytest.approx(2 / 70)
    one = rt.kruskal_wallis(df.where("g = 'a'").withColumn("k", F.lit(1)), ["k"], "g", "v").first()
    assert one["h"] is None


def test_cca_matches_direct(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(80, 3)), rng.normal(size=(80, 2))
    y[:, 0] += x[:, 1]
    df = spark.createDataFrame([("c", [*map(float, a), *map(float, b)]) for a, b in zip(x, y)], "c string, v array<double>")
    g = mv.array_gram(df.repartition(5), ["c"], "v")
    got = mv.cca_summary(g, ["c"], 3).toPandas()["correlation"].to_numpy()
    qx, qy = np.linalg.qr(x - x.mean(0))[0], np.linalg.qr(y - y.mean(0))[0]
    np.testing.assert_allclose(got, np.linalg.svd(qx.T @ qy)[1], atol=1e-9)
    flat = mv.elastic_cca(g, ["c"], 3, [1e-8], [0.0]).first()
    assert flat["correlation"] == pytest.approx(got[0], abs=1e-4)


def test_cca_permutation_moves_sessions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 2))
    y = x[:, :1] + 0.1 * rng.normal(size=(40, 1))
    df = spark.createDataFrame([("c", int(i // 2), int(i), list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(zip(x, y))], "c string, s long, i long, x array<double>, y array<double>")
    p = mv.permuted_cca(df, ["c"], "s", "i", "x", "y", 99).first()
    assert p["p_value"] == pytest.approx(0.01) and p["correlation"] > 0.95


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_cca_permutation_equals_rows_in_drawn_order(spark, block_rows):
    """Sessions of unequal length, also shorter than a block and longer: p against permuting the rows themselves."""
    rng = np.random.default_rng(9)
    sizes = [1, 12, 3, 5, 9, 2, 20, 4]
    n, session = sum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    x, y = rng.normal(size=(n, 2)), rng.normal(size=(n, 2))
    y[:, 0] += 0.35 * x[:, 0]
    df = spark.createDataFrame([("c", int(s), i, x[i].tolist(), y[i].tolist()) for i, s in enumerate(session)], "c string, s int, i long, x array<double>, y array<double>")
    got = {r.component: (r.correlation, r.p_value) for r in mv.permuted_cca(df, ["c"], "s", "i", "x", "y", 40, block_rows=block_rows).collect()}
    draws = {}
    for r in spark.range(41).crossJoin(df.select("s").distinct()).select(F.col("id").cast("int").alias("it"), "s", F.when(F.col("id") == 0, F.xxhash64("s")).otherwise(F.xxhash64("s", F.col("id").cast("int"), F.lit(0))).alias("h")).collect():
        draws.setdefault(r["it"], []).append((r["h"], r["s"]))
    order = {it: np.concatenate([np.flatnonzero(session == s) for _, s in sorted(v)]) for it, v in draws.items()}
    first = np.linalg.qr(x[order[0]] - x.mean(0))[0]
    corr = np.array([np.linalg.svd(first.T @ np.linalg.qr(y[order[it]] - y.mean(0))[0])[1] for it in range(41)])
    for i in range(2):
        assert got[f"CC{i + 1}"] == pytest.approx((corr[0, i], ((corr[1:, i] >= corr[0, i]).sum() + 1) / 41))


def test_mannwhitney_extreme_tails_of_large_samples(spark):
    """The least and the largest U of 8 and 3,000 values: counted arrangements over all."""
    import math

    assert list(rt._u_counts(8, 3000)[:5]) == [1, 1, 2, 3, 5] and list(rt._u_counts(8, 3000)[-5:]) == [5, 3, 2, 1, 1]
    rows = spark.createDataFrame([(u, 8, 3000, 0) for u in (0.0, 2.0, 24000.0, 23998.0)], "u double, n int, m int, t int")
    got = [r[0] for r in rows.select(rt.mannwhitney_p("u", "n", "m", "t")).collect()]
    for p, ways in zip(got, (1, 4, 1, 4)):
        assert p == pytest.approx(2 * ways / math.comb(3008, 8), rel=1e-9)


def test_variance_components_recover_and_select(spark):
    rng = np.random.default_rng(1)
    rows = []
    for m in range(30):
        b = rng.normal(0, 1.0)
        rows += [("c", m, float(b + rng.normal(0, 0.5) + rng.normal(0, 0.2)), 0.2) for _ in range(8)]
    rows += [("few", m, 1.0 + m, 0.1) for m in range(2) for _ in range(9)]
    df = spark.createDataFrame(rows, "cell string, mouse long, coef double, se double")
    marg = mv.variance_components(df, ["cell"], "mouse", "coef", "se")
    s = mv.posterior_summary(marg, ["cell"]).toPandas().set_index("component")
    assert set(s["cell"]) == {"c"} and s["n_mice"].eq(30).all() and s["n_sessions"].eq(240).all()
    scale = np.std([r[2] for r in rows if r[0] == "c"]) ** 2
    assert s.loc["V_mouse", "hdi_low"] < 1.0 / scale < s.loc["V_mouse", "hdi_high"]
    assert s.loc["V_session", "hdi_low"] < 0.25 / scale < s.loc["V_session", "hdi_high"]
    d = mv.posterior_density(marg, ["cell"]).where("component = 'V_session'").toPandas().sort_values("x")
    assert len(d) == 200 and np.trapezoid(d["density"], d["x"]) == pytest.approx(1, abs=0.05)


def test_encoding_equals_dense_ridge(spark):
    rng = np.random.default_rng(6)
    n = 200
    times = np.sort(rng.choice(np.arange(5, 190), 25, replace=False)) * 0.1
    ev = spark.createDataFrame([("a", float(t)) for t in times], "eid string, t double")
    bounds = spark.createDataFrame([("a", 0.0, n)], "eid string, t_start double, n_bins long")
    basis = [(i, i - 2, 1.0) for i in range(5)]
    design_rows = enc.event_block(ev, bounds, ["eid"], "t", "ev", basis)
    x = np.zeros((n, 5))
    for t in times:
        for c, o, w in basis:
            b = int(round(t / 0.1)) + o
            if 0 <= b < n:
                x[b, c] += w
    y = x @ np.array([0.5, 1, -1, 2, 0]) + rng.normal(size=n)
    target = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "eid string, bin long, y double")
    m = enc.design_gram(design_rows, target, ["eid"], "bin", "y")
    got = enc.fit_encoding(m, ["eid"], [1.0]).toPandas().sort_values("column")
    sd = x.std(0)
    z = (x - x.mean(0)) / sd
    beta = np.linalg.solve(z.T @ z + np.eye(5), z.T @ (y - y.mean()))
    np.testing.assert_allclose(got["coef"], beta / sd, atol=1e-8)
    pred = np.zeros(n)
    for f in range(5):
        te = np.arange(n) * 5 // n == f
        mu, yb = z[~te].mean(0), y[~te].mean()
        zc = z[~te] - mu
        b = np.linalg.solve(zc.T @ zc + np.eye(5), zc.T @ (y[~te] - yb))
        pred[te] = (z[te] - mu) @ b + yb
    assert got["cv_r2"].iloc[0] == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_psychometric_recovers(spark):
    rng = np.random.default_rng(2)
    c = np.array([-100, -25, -12.5, -6.25, 0, 6.25, 12.5, 25, 100.0])
    p = 0.05 + 0.87 * (enc._erf((c - 4) / 18) + 1) / 2
    rows = [(1, float(a), 4000, int(rng.binomial(4000, q))) for a, q in zip(c, p)] + [(2, 0.0, 5, 2)]
    fit = enc.fit_psychometric(spark.createDataFrame(rows, "eid long, signed_contrast double, n long, k long"), ["eid"]).toPandas().set_index("eid")
    assert fit.loc[1, "bias"] == pytest.approx(4, abs=1.5) and fit.loc[1, "threshold"] == pytest.approx(18, abs=3)
    assert fit.loc[1, "lapse_left"] == pytest.approx(0.05, abs=0.02) and fit.loc[1, "r_squared"] > 0.99
    assert np.isnan(fit.loc[2, "bias"]) and fit.loc[2, "n_trials"] == 5


def test_anova_unbalanced_says_so(spark):
    rng = np.random.default_rng(3)
    rows = [(s, a, b, float(a == "x") + rng.normal()) for s in range(6) for a in "xy" for b in "pq"]
    full = spark.createDataFrame(rows, "s long, a string, b string, y double")
    assert {r["method"] for r in mixed.anova_rm(full, "s", ["a", "b"], "y").collect()} == {"rm"}
    holed = full.where("NOT (s = 0 AND a = 'x' AND b = 'p')")
    assert {r["method"] for r in mixed.anova_rm(holed, "s", ["a", "b"], "y").collect()} == {"ols"}


def test_decoder_separates_classes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, i % 3, [float(i % 2) * 4 + rng.normal(), rng.normal()]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, subject long, v array<double>")
    pred, c = dec.decode_label(df, "id", "label", "subject", "v", [1.0])
    assert pred.count() == 60 and c == 1.0
    assert dec.decoding_scores(pred, "label").first()["balanced_accuracy"] > 0.9
    u = dec.unique_contribution(df, "label", "v", None, 1.0, "id").toPandas().set_index("feature")
    assert u.loc[0, "delta"] > u.loc[1, "delta"]


def dense_fit(x, y, classes, c, drop=None, steps=20_000):
    """Plain proximal gradient on scaled rows: mean balanced log loss + |w| / (c n)."""
    n, d = x.shape
    z = np.column_stack([x, np.ones(n)])
    balance = n / (classes * np.bincount(y, minlength=classes))[y]
    hot, w = np.eye(classes)[y], np.zeros((classes, d + 1))
    step = 1 / (0.5 * balance.max() * np.linalg.eigvalsh(z.T @ z / n)[-1])
    for _ in range(steps):
        p = np.exp(z @ w.T - (z @ w.T).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = w - step * ((p - hot) * balance[:, None]).T @ z / n
        new[:, :d] = np.sign(new[:, :d]) * np.maximum(np.abs(new[:, :d]) - step / (c * n), 0)
        if drop is not None:
            new[:, drop] = 0
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def choice(p):
    return (p >= p.max(axis=1, keepdims=True) - 1e-3).argmax(axis=1)


def decoding_case():
    rng = np.random.default_rng(4)
    y = rng.choice(3, 90, p=[0.5, 0.3, 0.2])
    x = rng.normal(size=(90, 4)) * [1, 5, 0.2, 1] + np.column_stack([y * 0.9, -2.0 * (y == 1), 0 * y, 0 * y]) + 3
    return y, np.arange(90) % 4, x


def scale(x, train):
    return (x - x[train].mean(axis=0)) / x[train].std(axis=0)


def test_decoder_equals_dense_fits_and_tuning(spark):
    """Every fold, strength and prediction against fits one by one in numpy."""
    y, subject, x = decoding_case()
    names = np.array(["ca", "cb", "cc"])
    df = spark.createDataFrame([(i, names[y[i]], f"s{subject[i]}", x[i].tolist()) for i in range(90)], "id long, label string, subject string, v array<double>")
    grid = [0.003, 0.1, 1.0]
    pred, median = dec.decode_label(df.repartition(3), "id", "label", "subject", "v", grid, max_steps=2000, tol=1e-6)
    got = {r.id: (r.predicted, r.strength) for r in pred.collect()}
    place = np.zeros(90, int)
    for k in range(3):
        place[y == k] = np.arange((y == k).sum())
    chosen = []
    for s in range(4):
        train = subject != s
        z = scale(x, train)
        n = max(2, min(3, np.bincount(y[train]).min()))
        score = []
        for c in grid:
            rates = []
            for f in range(n):
                a, b = train & (place % n != f), train & (place % n == f)
                w = dense_fit(z[a], y[a], 3, c)
                rates.append((choice(np.column_stack([z[b], np.ones(b.sum())]) @ w.T) == y[b]).mean())
            score.append(np.mean(rates))
        best = grid[int(np.argmax(score))]
        chosen.append(best)
        w = dense_fit(z[train], y[train], 3, best)
        out = choice(np.column_stack([z, np.ones(90)]) @ w.T)
        assert [got[i] for i in np.flatnonzero(~train)] == [(names[out[i]], best) for i in np.flatnonzero(~train)]
    assert median == np.median(chosen)
    assert sum(r.n for r in dec.confusion(pred, "label").collect()) == 90


def test_decoding_coefficients_and_contributions_equal_dense_fits(spark):
    y, _, x = decoding_case()
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(90)], "id long, label int, v array<double>")
    z = scale(x, np.ones(90, bool))
    for r in dec.decoding_coefficients(df, "label", "v", "id", 0.5, max_steps=3000).collect():
        assert r.coef == pytest.approx(dense_fit(z, y, 3, 0.5)[r["class"], r.feature], abs=0.02) and r.converged
    one = np.column_stack([z, np.ones(90)])
    accuracy = lambda w: np.mean([(choice(one[y == k] @ w.T) == k).mean() for k in range(3)])
    full = accuracy(dense_fit(z, y, 3, 0.5))
    got = {r.feature: r for r in dec.unique_contribution(df, "label", "v", None, 0.5, "id", max_steps=3000).collect()}
    for f in range(4):
        assert got[f].full_accuracy == pytest.approx(full, abs=0.02) and got[f].delta == pytest.approx(full - accuracy(dense_fit(z, y, 3, 0.5, f)), abs=0.03)


def test_decoder_without_classes_or_with_a_lost_one(spark):
    schema = "id long, label string, subject long, v array<double>"
    rows = [(i, "ab"[i % 2], 0 if i % 2 else i % 3, [float(i % 2), 1.0]) for i in range(30)] + [(90, "a", 1, [None, 1.0]), (91, "a", 1, [float("nan"), 1.0]), (92, "b", 1, None)]
    pred, _ = dec.decode_label(spark.createDataFrame(rows, schema), "id", "label", "subject", "v", [1.0])
    got = {r.id: r.predicted for r in pred.collect()}
    assert set(got) == set(range(30))
    assert all((p is None) == (i % 2 == 1 or i % 3 == 0) for i, p in got.items())   # all rows of b belong to subject 0
    none, c = dec.decode_label(spark.createDataFrame([], schema), "id", "label", "subject", "v")
    assert none.count() == 0 and c == 1.0
    one, _ = dec.decode_label(spark.createDataFrame(rows[:30:2], schema), "id", "label", "subject", "v", [1.0])
    assert {r.predicted for r in one.collect()} == {None}
