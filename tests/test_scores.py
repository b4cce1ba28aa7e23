"""Canonical scores against numpy, and the round trip of result tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.operators import multivariate as mv, scores

N = 300


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    shared = rng.normal(size=N)
    x = np.column_stack([shared + rng.normal(size=N), rng.normal(size=N) * 5, rng.normal(size=N) + 3])
    y = np.column_stack([rng.normal(size=N), shared + rng.normal(size=N), np.full(N, 2.0), rng.normal(size=N)])
    made = [(i % 2, i, list(map(float, x[i])), list(map(float, y[i]))) for i in range(N)]
    made += [(0, N, None, [0.0] * 4), (0, N + 1, [0.0, None, 1.0], [0.0] * 4), (5, N + 2, [1.0] * 3, [1.0] * 4)]
    return x, y, spark.createDataFrame(made, "g long, id long, x array<double>, y array<double>")


def fitted(df):
    whole = df.where("x IS NOT NULL AND NOT exists(x, v -> v IS NULL)")
    return mv.array_gram(whole.withColumn("v", F.concat("x", "y")), ["g"], "v").where("gram[0] >= 3")


def test_scores_reach_the_canonical_correlations(rows):
    x, y, df = rows
    grams = fitted(df)
    got = scores.cca_scores(df, grams, ["g"], ["id"], "x", "y", 3).toPandas()
    want = mv.cca_summary(grams, ["g"], 3).toPandas().set_index(["g", "component"])["correlation"]
    weights = mv.cca_weights(grams, ["g"], 3, ["a", "b", "c", "p", "q", "const", "r"]).toPandas()
    assert set(got.g) == {0, 1} and not set(got.id) & {N, N + 1, N + 2} and set(got.component) == {"CC1", "CC2", "CC3"}
    for g in (0, 1):
        wide = got[got.g == g].pivot(index="id", columns=["view", "component"], values="score").sort_index()
        assert len(wide) == N // 2
        z = (x[g::2] - x[g::2].mean(0)) / x[g::2].std(0)
        for i in range(3):
            cc = f"CC{i + 1}"
            assert np.corrcoef(wide["x"][cc], wide["y"][cc])[0, 1] == pytest.approx(want[(g, cc)], abs=1e-9)
            w = weights[(weights.g == g) & (weights["view"] == "x") & (weights.component == cc)].set_index("feature").weight[["a", "b", "c"]]
            np.testing.assert_allclose(wide["x"][cc], z @ w.to_numpy(), atol=1e-9)
        between = np.corrcoef(wide["x"].to_numpy().T)
        np.testing.assert_allclose(between, np.eye(3), atol=1e-8)  # variates of one side do not correlate


def test_result_tables_read_back(spark, tmp_path):
    frames = {"summary": spark.createDataFrame([("a", 0.1 + 0.2, None), ("", 1e-300, 3), (None, None, 4)], "cohort string, r double, n long"),
              "scores": spark.createDataFrame([('x"y, z', -1.5), ("line\nbreak", 2.0)], "id string, score double"), "none": spark.createDataFrame([], "id string, score double")}
    scores.save_results(frames, str(tmp_path / "cca"))
    back = scores.load_results(spark, str(tmp_path / "cca"), {"summary": "cohort string, r double, n long", "scores": "id string, score double", "none": "id string, score double"})
    key = lambda r: tuple(str(v) for v in r)
    for name, df in frames.items():
        assert sorted(map(tuple, back[name].collect()), key=key) == sorted(map(tuple, df.collect()), key=key)


def test_permuted_p_with_ridge(spark):
    rng = np.random.default_rng(1)
    shared = rng.normal(size=60)
    rows = [(0, i // 6, i, [float(shared[i] + 0.1 * rng.normal()), float(rng.normal())], [float(shared[i]), float(rng.normal())]) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, session long, id long, x array<double>, y array<double>")
    got = mv.permuted_cca(df, ["g"], "session", "id", "x", "y", 200, ridge=0.1).toPandas().set_index("component")
    want = mv.cca_summary(mv.array_gram(df.withColumn("v", F.concat("x", "y")), ["g"], "v"), ["g"], 2, ridge=0.1).toPandas().set_index("component")
    np.testing.assert_allclose(got.correlation[["CC1", "CC2"]], want.correlation[["CC1", "CC2"]], atol=1e-9)
    assert got.p_value["CC1"] < 0.02 < got.p_value["CC2"]
