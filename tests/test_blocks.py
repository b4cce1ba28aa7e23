import io
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialloom.operators import features, linear, signals


def plan_of(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def units_frame(lengths, group="g", seed=3):
    rng = np.random.default_rng(seed)
    return pd.concat([pd.DataFrame({"g": group, "u": u, "rk": np.arange(n), "y": rng.normal(size=n), "b": rng.normal(size=n), "x": rng.normal(size=n)})
                      for u, n in enumerate(lengths)])


def test_pairs_of_units_are_summed_without_a_shuffle(spark):
    pdf = pd.concat([units_frame([5, 21, 30, 8, 17]), units_frame([9, 12], "h")])
    pdf.loc[(pdf.g == "g") & (pdf.u == 2) & (pdf.rk == 20), "x"] = None  # met by unit 1 only
    got = linear.paired_moments(spark.createDataFrame(pdf), ["g"], "u", "rk", {"one": F.lit(1.0), "y": F.col("y")}, {"one": F.lit(1.0), "x": F.col("x")},
                                {"n": ("one", "one"), "yx": ("y", "x")}, block=2, chunk=8)
    assert "Exchange" not in plan_of(got)
    rows = got.toPandas()
    assert len(rows) == 5 * 4 + 2 and not rows.duplicated(["g", "u", "donor"]).any()
    for r in rows.itertuples():
        a, b = (pdf[(pdf.g == r.g) & (pdf.u == u)] for u in (r.u, r.donor))
        n = min(len(a), len(b))
        assert r.n == n
        assert np.isclose(r.yx, np.sum(a.y.to_numpy()[:n] * b.x.to_numpy(dtype=float)[:n]), equal_nan=True)
    empty = linear.pair_regressions(spark.createDataFrame(pdf).where("false"), ["g"], "u", "rk", "y", "x")
    assert empty.count() == 0


def test_donor_numbers_follow_from_places(spark):
    rows = [("g", u, d, "q", float(10 * u + d)) for u in range(5) for d in (0, 1, 2, 3, 7) if u != d]
    table = lambda r: spark.createDataFrame(r, "g string, u long, donor long, predictor string, delta_r2 double")
    whole, seen = linear.numbered_donors(table(rows), ["g", "predictor"], "u", "i")
    assert "Window" not in plan_of(whole) and "SortMergeJoin" not in plan_of(whole) and seen.count() == 5
    holed = [r for r in rows if r[1:3] not in ((1, 0), (4, 2))]
    for made in (rows, holed):
        got = {(r.u, r.donor): r.i for r in linear.numbered_donors(table(made), ["g", "predictor"], "u", "i")[0].collect()}
        assert got == {(r[1], r[2]): sum(x[1] == r[1] and x[2] < r[2] for x in made) for r in made}


def test_similarity_blocks_are_not_copied_and_labels_travel(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(23, 4))
    df = spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(23)], "id long, label long, v array<double>")
    sim = features.cosine_similarity(df, "id", "v", block_rows=5)
    both = features.within_between(sim, df, "id", "label")
    assert "hashpartitioning" not in plan_of(sim) and "hashpartitioning" not in plan_of(both)
    rows = sim.toPandas().set_index(["id_a", "id_b"])["similarity"]
    assert len(rows) == 23 * 24 // 2 and rows.index.is_unique
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(a <= b and np.isclose(s, u[a] @ u[b]) for (a, b), s in rows.items())
    pairs = both.toPandas()
    assert len(pairs) == 23 * 22 // 2 and ((pairs.comparison == "within") == (pairs.id_a % 3 == pairs.id_b % 3)).all()
    assert features.cosine_similarity(df.where("false"), "id", "v").count() == 0


def test_copies_of_a_small_side_are_not_broadcast_unseen(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "id * 2.0 AS s", "id * 3.0 AS e").write.parquet(str(tmp_path / "bounds"))
    bounds = spark.read.parquet(str(tmp_path / "bounds"))
    samples = spark.range(2_000_000).where("id % 9000 = 0").selectExpr("IF(id < 1900000, id, NULL) AS id", "id * 2.2D AS t")
    trimmed = signals.trim_to_session(samples, bounds, ["id"], "t", "s", "e")
    assert "BroadcastHashJoin" not in plan_of(trimmed)  # one copy would fit, the 16 that there are do not
    assert sorted(r.id for r in trimmed.collect()) == [i for i in range(0, 200_000, 9000) if 2 * i - 5 <= i * 2.2 <= 3 * i + 5]


def test_vectors_are_written_compressed_and_products_with_ones_are_looked_up(spark, monkeypatch):
    pdf = units_frame([40, 33, 55, 21], seed=4)
    pdf["x"] = np.round(pdf["x"])  # few values, as a count or a flag has
    made = {}

    def kept(rows, keys, written=linear.written):
        made["packed"] = written(rows, keys)
        return made["packed"]

    monkeypatch.setattr(linear, "written", kept)
    pairs = linear.pair_regressions(spark.createDataFrame(pdf), ["g"], "u", "rk", "y", "x").toPandas()
    packed = made["packed"].toPandas()
    held = sum(len(b) for name in packed.columns if name[:2] in ("f_", "d_") for row in packed[name] for b in row)
    assert held < len(pdf) * 3 * 8  # y, x and a column of ones; sums of squares are formed in the tasks
    assert len(pairs) == 12
    for r in pairs.itertuples():
        y, x = pdf[pdf.u == r.u].y.to_numpy(), pdf[pdf.u == r.donor].x.to_numpy()
        n = min(len(y), len(x))
        c = np.corrcoef(y[:n], x[:n])[0, 1]
        assert r.n == n and np.isclose(r.r2, c * c) and np.isclose(r.slope, c * y[:n].std() / x[:n].std())


def test_draws_meet_donors_without_pairs_as_rows(spark, monkeypatch):
    lengths = [30, 22, 41, 30, 25, 37, 28, 33] * 5
    pdf = pd.concat([units_frame(lengths), units_frame([9], "alone")])
    pdf.loc[(pdf.g == "alone"), "u"] = 99
    pdf.loc[(pdf.u == 3) & (pdf.rk % 4 == 0), "x"] = np.nan
    pdf.loc[pdf.u == 5, "x"] = 2.5  # a donor without spread
    rows = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x") + 1e6)).withColumn("y", F.col("y") - 1e6)
    monkeypatch.setattr(linear, "_pair_rows", None)  # the join of pairs with their vectors
    p = linear.session_permutation_test(rows, ["g"], "u", "rk", "y", "x", "r2", 9, seed=3).toPandas().set_index("u")
    assert p.loc[99, "error"] == "no donor sessions" and len(p) == 41
    units = list(range(40))
    for u in units:
        got = p.loc[u, "null_r2"]
        assert len(got) == 9
        for it, r2 in enumerate(got, 1):
            import hashlib

            h = int(hashlib.md5(f"{u}|{it}|3".encode()).hexdigest()[:15], 16) % 39
            d = h + (h >= u)
            y, x = pdf[(pdf.g == "g") & (pdf.u == u)].y.to_numpy(), pdf[(pdf.g == "g") & (pdf.u == d)].x.to_numpy()
            n = min(len(y), len(x))
            y, x = y[:n][~np.isnan(x[:n])], x[:n][~np.isnan(x[:n])]
            assert r2 is None or np.isnan(r2) if d == 5 else np.isclose(r2, np.corrcoef(y, x)[0, 1] ** 2, rtol=1e-5)


def test_lost_r2_by_elimination_equals_solved_fits():
    from trialloom.functions.smallmath import ols_r2, r2_lost

    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 30, 4))  # 50 designs of a, b, c and y
    x[:5, :, 2] = 2 * x[:5, :, 1] - 1  # c follows from b
    x = np.concatenate([np.ones((50, 30, 1)), x], axis=2)
    m = np.einsum("kni,knj->kij", x, x)
    got = r2_lost([[m[:, i, j] for j in range(5)] for i in range(5)], [0, 1], [2, 3])
    want = ols_r2(m, [0, 1, 2, 3]) - ols_r2(m, [0, 1])
    assert np.isnan(got[:5]).all() and np.isnan(want[:5]).all() and np.allclose(got[5:], want[5:], atol=1e-12)
