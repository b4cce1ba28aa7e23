"""Random slopes against the dense likelihood, ANOVA of all groups against single ones."""

import numpy as np
import pandas as pd
import pytest

from trialloom.operators import mixed, slopes

TERMS = [("a",), ("b",)]


def made(seed, n=400, subjects=12, slope_sd=0.7):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"s": rng.integers(0, subjects, n), "a": rng.normal(size=n), "b": rng.choice([-0.5, 0.5], n)})
    u, v = rng.normal(0, 1.0, subjects), rng.normal(0, slope_sd, subjects)
    pdf["y"] = 1 + 0.5 * pdf.a + 0.2 * pdf.b + u[pdf.s] + v[pdf.s] * pdf.a + rng.normal(size=n)
    return pdf


def dense(pdf, x_terms, z_terms, low, reml):
    """Criterion, fixed effects and predicted effects from the full covariance of all rows."""
    col = lambda names: np.column_stack([np.ones(len(pdf))] + [pdf[c] for c in names])
    x, zs, y = col(x_terms), col(z_terms), pdf.y.to_numpy()
    ids = np.unique(pdf.s)
    z = np.hstack([zs * (pdf.s.to_numpy() == i)[:, None] for i in ids])
    d = np.kron(np.eye(len(ids)), low @ low.T)
    v = np.eye(len(y)) + z @ d @ z.T
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    e = y - x @ beta
    rss, dof = e @ vi @ e, len(y) - x.shape[1] if reml else len(y)
    value = np.linalg.slogdet(v)[1] + dof * np.log(rss) + (np.linalg.slogdet(a)[1] if reml else 0)
    blup = d @ z.T @ vi @ e
    return value, beta, blup.reshape(len(ids), -1), rss / dof, x @ beta, z @ blup, np.linalg.inv(a) * rss / dof


@pytest.mark.parametrize("reml", [True, False])
def test_slopes_equal_dense(spark, reml):
    parts = {"one": made(1), "two": made(2, 300, 9)}
    df = spark.createDataFrame(pd.concat([p.assign(g=k) for k, p in parts.items()]))
    family, random = {"full": TERMS, "small": [("a",)]}, {"full": [("a",)]}
    grams = mixed.subject_grams(df, ["g"], "s", TERMS, "y")
    fits = slopes.slope_fits(grams, ["g"], "s", TERMS, family, random, reml)
    got = fits.toPandas().set_index(["g", "name"])
    assert len(got) == 4 and got.converged.all() and not got.singular.any()
    effects = slopes.slope_effects(grams, fits, ["g"], "s", TERMS, family, random).toPandas()
    r2 = slopes.slope_variance(grams, fits, ["g"], "s", TERMS, family, random).toPandas().set_index(["g", "name"])
    coefs = slopes.slope_coefficients(fits, ["g"], TERMS, family).toPandas().set_index(["g", "name", "term"])
    for g, pdf in parts.items():
        for name, (xt, zt) in {"full": (["a", "b"], ["a"]), "small": (["a"], [])}.items():
            row = got.loc[(g, name)]
            q = len(zt) + 1
            low = slopes._factor(row.factor, q)
            value, beta, blup, sigma2, fixed, own, cov = dense(pdf, xt, zt, low, reml)
            np.testing.assert_allclose([row.criterion, row.sigma2], [value, sigma2], rtol=1e-9)
            np.testing.assert_allclose(row.beta, beta, atol=1e-8)
            # no nearby factor is better
            rng = np.random.default_rng(0)
            for scale in (1e-3, 1e-2, 1e-1, 0.5):
                for _ in range(4):
                    step = np.tril(rng.normal(0, scale, (q, q)))
                    assert dense(pdf, xt, zt, low + step, reml)[0] > value - 1e-4
            mine = effects[(effects.g == g) & (effects.name == name)].pivot(index="s", columns="term", values="effect")
            np.testing.assert_allclose(mine[["Intercept", *zt]].to_numpy(), blup, atol=1e-7)
            assert r2.loc[(g, name), "marginal_r2"] == pytest.approx(np.var(fixed) / np.var(pdf.y), abs=1e-8)
            assert r2.loc[(g, name), "conditional_r2"] == pytest.approx((np.var(fixed) + np.var(own)) / np.var(pdf.y), abs=1e-8)
            np.testing.assert_allclose([coefs.loc[(g, name, t), "se"] for t in ["Intercept", *xt]], np.sqrt(np.diag(cov)), rtol=1e-7)


def test_intercept_only_equals_the_other_way(spark):
    df = spark.createDataFrame(made(5).assign(g="x"))
    grams = mixed.subject_grams(df, ["g"], "s", TERMS, "y")
    here = slopes.slope_coefficients(slopes.slope_fits(grams, ["g"], "s", TERMS, {"full": TERMS}, []), ["g"], TERMS, {"full": TERMS})
    there = mixed.mixed_coefficients(mixed.group_sums(grams, ["g"], 4), ["g"], TERMS)
    both = here.toPandas().set_index("term").join(there.toPandas().set_index("term"), rsuffix="_there")
    np.testing.assert_allclose(both.coef, both.coef_there, atol=1e-5)
    np.testing.assert_allclose(both.se, both.se_there, rtol=1e-4)


def test_no_slope_few_subjects_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(slopes, "BLOCK_SUBJECTS", 5)
    none = made(3, 600, 14, 0.0)
    rng = np.random.default_rng(0)
    none["y"] = 1 + 0.5 * none.a + rng.normal(size=len(none))  # neither intercepts nor slopes vary
    alone = made(4, 30, 1)
    flat = made(6, 60, 4).assign(b=0.0)  # a column of zeros: no full rank
    df = spark.createDataFrame(pd.concat([none.assign(g="none"), alone.assign(g="alone"), flat.assign(g="flat")]))
    grams = mixed.subject_grams(df, ["g"], "s", TERMS, "y")
    fits = slopes.slope_fits(grams, ["g"], "s", TERMS, {"full": TERMS}, [("a",)])
    got = fits.toPandas().set_index("g")
    assert set(got.index) == {"none", "flat"}
    assert got.loc["flat", "beta"] is None and not got.loc["flat", "converged"]
    assert got.loc["none", "converged"]
    r2 = slopes.slope_variance(grams, fits, ["g"], "s", TERMS, {"full": TERMS}, [("a",)]).toPandas().set_index("g")
    assert np.isnan(r2.loc["flat", "marginal_r2"])
    assert got.loc["none", "singular"] == np.isnan(r2.loc["none", "marginal_r2"])


def test_anova_of_groups_equals_single(spark):
    rng = np.random.default_rng(3)
    rows = [(g, s, a, b, float(a == "x") * (g + 1) + rng.normal()) for g in range(3) for s in range(6) for a in "xyz" for b in "pq"]
    cells = spark.createDataFrame(rows, "g long, s long, a string, b string, y double")
    cells = cells.where("NOT (g = 2 AND s = 0 AND a = 'x' AND b = 'p')")
    got = mixed.anova_groups(cells, ["g"], "s", ["a", "b"], "y").toPandas().set_index(["g", "source"])
    assert set(got.loc[2].method) == {"ols"} and set(got.loc[0].method) == {"rm"}
    for g in range(3):
        one = mixed.anova_rm(cells.where(f"g = {g}"), "s", ["a", "b"], "y").toPandas().set_index("source")
        for c in ("f", "num_df", "den_df", "p"):
            np.testing.assert_allclose(got.loc[g].loc[one.index, c].astype(float), one[c].astype(float), rtol=1e-8)
    few = mixed.anova_groups(cells.where("g = 0 OR s = 1"), ["g"], "s", ["a", "b"], "y", min_subjects=2)
    assert {r["g"] for r in few.collect()} == {0}
