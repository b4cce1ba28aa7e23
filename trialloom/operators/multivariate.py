"""Canonical correlation, principal components and variance components from moment sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from trialloom.constants import VARCOMP_GRID, VARCOMP_HDI, VARCOMP_MIN_MICE, VARCOMP_MIN_SESSIONS
from trialloom.functions.columns import probit
from trialloom.functions.distribution import average_ranks
from trialloom.functions.joins import skew_join
from trialloom.functions.scan import ordered_scan
from trialloom.functions.smallmath import cca, unpack
from trialloom.operators.linear import _key_types, _per_group
from trialloom.session import cut_lineage


def array_gram(df: DataFrame, keys: list[str], vector: str, out: str = "gram") -> DataFrame:
    """Moment matrix of [1, vector] per key for wide vectors.

    Every partition adds up one matrix per key with BLAS; only those matrices are shuffled. Rows
    with a null element are left out.
    """
    types = _key_types(df, keys)
    prefix = f"{types}, " if keys else ""

    def partial(batches):
        acc = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                x = np.stack([np.asarray(v, float) for v in part[vector]])
                x = np.hstack([np.ones((len(x), 1)), x[~np.isnan(x).any(axis=1)]]) if not np.isnan(x).any() else _with_one(x)
                key = key if isinstance(key, tuple) else (key,)
                acc[key] = acc.get(key, 0) + x.T @ x
        for key, g in acc.items():
            flat = g[np.triu_indices(len(g))]
            yield pd.DataFrame({**{k: np.repeat([v], len(flat)) for k, v in zip(keys, key)}, "pos": np.arange(len(flat)), "v": flat})

    cells = df.select(*keys, vector).where(F.col(vector).isNotNull()).mapInPandas(partial, f"{prefix}pos int, v double")
    summed = cells.groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    return summed.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(out))


def _with_one(x: np.ndarray) -> np.ndarray:
    x = x[~np.isnan(x).any(axis=1)]
    return np.hstack([np.ones((len(x), 1)), x])


def _size(flat) -> int:
    return int((np.sqrt(8 * len(flat) + 1) - 1) / 2)


def cca_summary(grams: DataFrame, keys: list[str], kx: int, n_components: int | None = None, scale: bool = True, ridge: float = 0.0) -> DataFrame:
    """Correlation and variance extracted per variate and group."""
    def rows(rec):
        g = unpack(rec["gram"], _size(rec["gram"]))
        if g[0, 0] < 3:
            raise ValueError("canonical correlation needs at least 3 rows")
        r = cca(g, kx, n_components, scale, ridge)
        return [dict(component=f"CC{i + 1}", correlation=float(c), n_recordings=int(g[0, 0]), x_variance_explained=float(r["x_adequacy"][i]),
                     y_variance_explained=float(r["y_adequacy"][i])) for i, c in enumerate(r["correlations"])]

    return _per_group(grams, keys, "component string, correlation double, n_recordings long, x_variance_explained double, y_variance_explained double", rows)


def cca_weights(grams: DataFrame, keys: list[str], kx: int, names: list[str], n_components: int | None = None, scale: bool = True, ridge: float = 0.0) -> DataFrame:
    """Long weights (keys, view, feature, component, weight)."""
    def rows(rec):
        r = cca(unpack(rec["gram"], _size(rec["gram"])), kx, n_components, scale, ridge)
        out = []
        ynames = [n for n, k in zip(names[kx:], r["y_kept"]) if k]
        for view, w, labels in (("x", r["x_weights"], names[:kx]), ("y", r["y_weights"], ynames)):
            out += [dict(view=view, feature=f, component=f"CC{c + 1}", weight=float(w[i, c])) for i, f in enumerate(labels) for c in range(w.shape[1])]
        return out

    return _per_group(grams, keys, "view string, feature string, component string, weight double", rows)


BLOCK_ROWS = 20_000  # rows of each side that a task of permuted_cca holds


def permuted_cca(df: DataFrame, keys: list[str], session: str, row: str, x: str, y: str, n_permutations: int = 1000, seed: int = 0, block_rows: int = BLOCK_ROWS, ridge: float = 0.0) -> DataFrame:
    """Permutation p per variate, whole sessions of y moving together.

    Iteration i orders sessions by hash(session, i, seed); the j-th row of that order meets the j-th
    row of x. Only the cross moments change, so each iteration adds one kx x ky matrix. No row is
    copied per draw: an iteration is a list of stretches, (place in x, place in y, length), made from the sessions'
    lengths alone. Rows lie in blocks by their place; every pair of blocks meets once, together with the
    stretches of all iterations that fall into it.
    """
    hashed = df.select(*keys, session, row, x, y).withColumn("__h", F.xxhash64(session))
    placed = ordered_scan(hashed, keys, ["__h", session, row], F.shiftright("__h", 58), index="__pos")
    placed = cut_lineage(placed.select(*keys, session, "__pos", x, y))
    kx, ky = (len(placed.select(c).first()[0]) for c in (x, y))
    own = placed.groupBy(*keys, session).agg(F.min("__pos").alias("__o"), F.count(F.lit(1)).alias("__n"))
    draws = own.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(n_permutations))))
    # offsets of the drawn order: one small row per session and draw
    draw = W.partitionBy(*keys, "it").orderBy(F.when(F.col("it") == 0, F.col("__o")).otherwise(F.xxhash64(session, "it", F.lit(seed))), session)
    draws = draws.withColumn("__q", F.sum("__n").over(draw) - F.col("__n"))
    # where an x session or a y session begins, a stretch begins; y rows lie at their own place plus a shift
    begins = draws.select(*keys, "it", F.col("__o").alias("__p"), F.lit(None).cast("long").alias("__shift")).unionByName(
        draws.select(*keys, "it", F.col("__q").alias("__p"), (F.col("__o") - F.col("__q")).alias("__shift")))
    begins = begins.groupBy(*keys, "it", "__p").agg(F.max("__shift").alias("__shift"))
    along = W.partitionBy(*keys, "it").orderBy("__p")
    total = own.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    parts = begins.join(total, keys).select(*keys, "it", "__p", F.coalesce(F.lead("__p").over(along), F.col("__all")).alias("__end"), F.last("__shift", True).over(along).alias("__shift"))
    block = lambda at: F.floor(at / F.lit(block_rows))
    parts = parts.withColumn("__g", F.explode(F.sequence(block(F.col("__p")), block(F.col("__end") - 1))))
    parts = parts.withColumn("__k", F.explode(F.sequence(block(F.greatest(F.col("__p"), F.col("__g") * block_rows) + F.col("__shift")),
                                                         block(F.least(F.col("__end"), (F.col("__g") + 1) * block_rows) - 1 + F.col("__shift")))))
    parts = cut_lineage(parts)
    pairs = parts.select(*keys, "__g", "__k").distinct()
    rows_of = lambda side, at, v: placed.select(*keys, block(F.col("__pos")).alias(at), F.lit(side).alias("__side"), "__pos", F.col(v).alias("__v")).join(pairs, [*keys, at]).select(*keys, "__g", "__k", "__side", "__pos", "__v")
    data = rows_of(0, "__g", x).unionByName(rows_of(1, "__k", y))

    def cross(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side, width in ((0, kx), (1, ky)):
            part = left[left["__side"] == side].sort_values("__pos")
            sides.append((part["__pos"].to_numpy(), np.array([np.asarray(v, float) for v in part["__v"]]).reshape(-1, width)))
        (px, vx), (py, vy) = sides
        its = np.unique(right["it"].to_numpy())
        acc = np.zeros((len(its), kx, ky))
        for it, p, end, shift in zip(np.searchsorted(its, right["it"].to_numpy()), right["__p"], right["__end"], right["__shift"]):
            lo, hi = max(p, px[0], py[0] - shift), min(end, px[-1] + 1, py[-1] + 1 - shift)
            if lo < hi:
                acc[it] += vx[lo - px[0]:hi - px[0]].T @ vy[lo + shift - py[0]:hi + shift - py[0]]
        return pd.DataFrame({**{k: np.repeat(right[k].iloc[:1].to_numpy(), acc.size) for k in keys}, "it": np.repeat(its, kx * ky), "pos": np.tile(np.arange(kx * ky), len(its)), "v": acc.ravel()})

    types = _key_types(df, keys)
    by = [*keys, "__g", "__k"]
    cells = data.groupBy(*by).cogroup(parts.select(*[F.col(c).alias(c) for c in by], "it", "__p", "__end", "__shift").groupBy(*by)).applyInPandas(cross, f"{types}, it int, pos int, v double")
    cells = cells.groupBy(*keys, "it", "pos").agg(F.sum("v").alias("v")).groupBy(*keys, "it").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("cross"))
    grams = array_gram(df.withColumn("__xy", F.concat(x, y)), keys, "__xy")

    def rows(rec):
        g = unpack(rec["gram"], _size(rec["gram"]))
        g[1:kx + 1, kx + 1:] = np.asarray(rec["cross"]).reshape(kx, -1)
        g[kx + 1:, 1:kx + 1] = g[1:kx + 1, kx + 1:].T
        return [dict(component=f"CC{i + 1}", it=int(rec["it"]), corr=float(c)) for i, c in enumerate(cca(g, kx, ridge=ridge)["correlations"])]

    corr = cut_lineage(_per_group(cells.join(grams, keys), keys, "component string, it int, corr double", rows))
    obs = corr.where("it = 0").select(*keys, "component", F.col("corr").alias("correlation"))
    null = corr.where("it > 0").join(obs, [*keys, "component"])
    return null.groupBy(*keys, "component").agg(F.max("correlation").alias("correlation"), ((F.count_if(F.col("corr") >= F.col("correlation")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def elastic_cca(grams: DataFrame, keys: list[str], kx: int, alphas: list[float], l1_ratios: list[float], iterations: int = 1000) -> DataFrame:
    """Regularised first variate per grid point, alternating penalised regressions on the moments; the
    grid point with the highest correlation is marked, and ``converged`` where the correlation came to rest (or to nothing)."""
    def shrink(c, target, alpha, l1, w):
        lam1, lam2 = alpha * l1, alpha * (1 - l1)
        if lam1 == 0:
            return np.linalg.solve(c + lam2 * np.eye(len(c)), target)
        w = w.copy()
        for _ in range(50):
            for j in range(len(w)):
                r = target[j] - c[j] @ w + c[j, j] * w[j]
                w[j] = np.sign(r) * max(abs(r) - lam1, 0) / (c[j, j] + lam2)
        return w

    def rows(rec):
        g = unpack(rec["gram"], _size(rec["gram"]))
        mean = g[0, 1:] / g[0, 0]
        c = g[1:, 1:] / g[0, 0] - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(c), 1e-300))
        c = c / np.outer(sd, sd)
        xx, yy, xy = c[:kx, :kx], c[kx:, kx:], c[:kx, kx:]
        out = []
        for a in alphas:
            for l1 in l1_ratios:
                wx, wy = np.zeros(kx), np.linalg.svd(xy)[2][0]
                corr, done = 0.0, True
                for _ in range(iterations):
                    wx = shrink(xx, xy @ wy, a, l1, wx)
                    sx = np.sqrt(max(wx @ xx @ wx, 0))
                    if sx < 1e-12:
                        break
                    wx = wx / sx
                    wy = shrink(yy, xy.T @ wx, a, l1, wy)
                    sy = np.sqrt(max(wy @ yy @ wy, 0))
                    if sy < 1e-12:
                        break
                    wy = wy / sy
                    new = wx @ xy @ wy
                    if abs(new - corr) < 1e-10:
                        break
                    corr = new
                else:
                    done = False
                out.append(dict(alpha=a, l1_ratio=l1, correlation=float(corr), converged=done, x_weights=list(wx / max(np.linalg.norm(wx), 1e-300)), y_weights=list(wy / max(np.linalg.norm(wy), 1e-300))))
        top = max(range(len(out)), key=lambda i: out[i]["correlation"])
        return [{**r, "best": i == top} for i, r in enumerate(out)]

    return _per_group(grams, keys, "alpha double, l1_ratio double, correlation double, converged boolean, x_weights array<double>, y_weights array<double>, best boolean", rows)


def _first_weights(grams, key, kx, min_rows, ridge):
    def rows(rec):
        g = unpack(rec["gram"], _size(rec["gram"]))
        if g[0, 0] < min_rows:
            return []
        r = cca(g, kx, 1, True, ridge)
        wy = np.zeros(len(r["y_kept"]))
        wy[r["y_kept"]] = r["y_weights"][:, 0]
        return [dict(correlation=float(r["correlations"][0]), n_recordings=int(g[0, 0]), wx=list(r["x_weights"][:, 0]), wy=list(wy), gram=list(rec["gram"]))]

    return _per_group(grams, [key], "correlation double, n_recordings long, wx array<double>, wy array<double>, gram array<double>", rows)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cohort_cca(grams: DataFrame, key: str, kx: int, min_rows: int = 10, ridge: float = 0.0, reference=None) -> DataFrame:
    """First variate per cohort with enough rows, signs aligned to the reference (first) cohort.

    One row per cohort: from here on all tables have as many rows as there are cohorts.
    """
    fits = cut_lineage(_first_weights(grams, key, kx, min_rows, ridge))
    ref = (fits.where(F.col(key) == F.lit(reference)) if reference is not None else fits.orderBy(key)).limit(1).select(F.col("wx").alias("__rx"))
    j = fits.crossJoin(F.broadcast(ref)).withColumn("__s", F.when(_dot(F.col("wx"), F.col("__rx")) < 0, -1.0).otherwise(1.0))
    flip = lambda c: F.transform(c, lambda v: v * F.col("__s"))
    return j.withColumns({"wx": flip("wx"), "wy": flip("wy")}).drop("__rx", "__s")


def cross_project(fits: DataFrame, key: str, kx: int) -> DataFrame:
    """Correlation of every cohort's variates under every cohort's weights, from the cohort's moments."""
    weights = fits.select(F.col(key).alias("weight_cohort"), F.col("wx").alias("__wx"), F.col("wy").alias("__wy"))
    pairs = fits.select(F.col(key).alias("data_cohort"), "gram").join(F.broadcast(weights), F.lit(True))

    def rows(rec):
        g = unpack(rec["gram"], _size(rec["gram"]))
        mean = g[0, 1:] / g[0, 0]
        c = g[1:, 1:] / g[0, 0] - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(c), 1e-300))
        c, wx, wy = c / np.outer(sd, sd), np.asarray(rec["__wx"]), np.asarray(rec["__wy"])
        den = np.sqrt((wx @ c[:kx, :kx] @ wx) * (wy @ c[kx:, kx:] @ wy))
        return [dict(correlation=float(wx @ c[:kx, kx:] @ wy / den))]

    return _per_group(pairs, ["data_cohort", "weight_cohort"], "correlation double", rows)


def compare_weights(fits: DataFrame, key: str) -> DataFrame:
    """Cosine of the neural and of the behavioural weights of every two cohorts."""
    a = fits.select(F.col(key).alias("cohort_a"), F.col("wx").alias("xa"), F.col("wy").alias("ya"))
    b = fits.select(F.col(key).alias("cohort_b"), F.col("wx").alias("xb"), F.col("wy").alias("yb"))
    cos = lambda p, q: _dot(F.col(p), F.col(q)) / F.sqrt(_dot(F.col(p), F.col(p)) * _dot(F.col(q), F.col(q)))
    return a.join(F.broadcast(b), F.col("cohort_a") < F.col("cohort_b")).select("cohort_a", "cohort_b", cos("xa", "xb").alias("neural_cosine"), cos("ya", "yb").alias("behavioral_cosine"))


def rank_normal(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Every metric mapped to a standard normal through its tie-averaged rank."""
    out = df.select(*ids, *metrics)
    for m in metrics:
        r = average_ranks(df, [], m, "__rank").select(m, probit((F.col("__rank") - 1) / F.greatest(F.col("total") - 1, F.lit(1))).alias(f"__z_{m}"))
        out = out.join(r, m, "left")
    return out.select(*ids, *[F.col(f"__z_{m}").alias(m) for m in metrics])


def pca_scores(df: DataFrame, ids: list[str], metrics: list[str], k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Scores on the first components, and the share of variance each explains."""
    vec = df.dropna(subset=metrics).withColumn("__v", F.array(*[F.col(m).cast("double") for m in metrics]))
    g = unpack(array_gram(vec, [], "__v").first()["gram"], len(metrics) + 1)  # a (p+1) x (p+1) matrix
    mean = g[0, 1:] / g[0, 0]
    w, v = np.linalg.eigh((g[1:, 1:] - g[0, 0] * np.outer(mean, mean)) / max(g[0, 0] - 1, 1))
    w, v = w[::-1], v[:, ::-1]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    score = lambda c: sum(((F.col(m) - float(mean[i])) * float(v[i, c]) for i, m in enumerate(metrics)), F.lit(0.0))
    share = df.sparkSession.createDataFrame([(f"PC{i + 1}", float(w[i] / w.sum())) for i in range(k)], "component string, explained double")
    return vec.select(*ids, *[score(c).alias(f"PC{c + 1}") for c in range(k)]), share


def variance_components(coefs: DataFrame, cell: list[str], subject: str, coef: str, se: str, *, prior: tuple[str, float] = ("halfnormal", 1.0), tau_max: float = 3.0,
                        grid: int = 60, min_mice: int = VARCOMP_MIN_MICE, min_sessions: int = VARCOMP_MIN_SESSIONS) -> DataFrame:
    """Exact posterior of the between-mouse and between-session sd on a grid, per cell.

    Estimates are standardised in their cell; the mean and the mouse effects are integrated in closed
    form, so each grid point needs four sums per mouse.
    """
    big = coefs.groupBy(*cell, subject).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") >= min_sessions)
    ok = big.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_mice"), F.sum("__k").alias("n_sessions")).where(F.col("n_mice") >= min_mice)
    kept = coefs.join(big.join(ok, cell), [*cell, subject])
    m = kept.groupBy(*cell).agg(F.avg(coef).alias("__m"), F.stddev_pop(coef).alias("__sd")).where("__sd > 0")
    z = skew_join(kept, m, cell).select(*cell, subject, "n_mice", "n_sessions", ((F.col(coef) - F.col("__m")) / F.col("__sd")).alias("z"), (F.col(se) / F.col("__sd")).alias("s"))
    step = tau_max / grid
    axis = F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: (i + 0.5) * F.lit(step)))
    w = 1 / (F.col("s") ** 2 + F.col("tau_session") ** 2)
    mouse = z.withColumn("tau_session", axis).groupBy(*cell, subject, "tau_session", "n_mice", "n_sessions").agg(
        F.sum(w).alias("W"), F.sum(w * F.col("z")).alias("M"), F.sum(w * F.col("z") ** 2).alias("Q"), F.sum(F.ln(w)).alias("L"))
    d = 1 + F.col("tau_mouse") ** 2 * F.col("W")
    point = mouse.withColumn("tau_mouse", axis).groupBy(*cell, "n_mice", "n_sessions", "tau_session", "tau_mouse").agg(
        F.sum(F.col("W") / d).alias("A"), F.sum(F.col("M") / d).alias("B"), F.sum(F.col("Q") - F.col("tau_mouse") ** 2 / d * F.col("M") ** 2).alias("C"), F.sum(F.col("L") - F.ln(d)).alias("D"))
    family, scale = prior
    lp = {"halfnormal": lambda t: -0.5 * (t / scale) ** 2, "halfcauchy": lambda t: -F.log1p((t / scale) ** 2), "uniform": lambda t: F.when(t <= scale, 0.0).otherwise(float("-inf"))}[family]
    logp = 0.5 * (F.col("D") - F.ln(F.col("A") + 1) + F.col("B") ** 2 / (F.col("A") + 1) - F.col("C")) + lp(F.col("tau_mouse")) + lp(F.col("tau_session"))
    post = cut_lineage(point.select(*cell, "n_mice", "n_sessions", "tau_session", "tau_mouse", logp.alias("lp")))
    top = post.groupBy(*cell).agg(F.max("lp").alias("__top"))
    p = post.join(top, cell).withColumn("p", F.exp(F.col("lp") - F.col("__top")))
    parts = [p.groupBy(*cell, "n_mice", "n_sessions", F.col(t).alias("tau")).agg(F.sum("p").alias("p")).withColumn("component", F.lit(n))
             for t, n in (("tau_mouse", "V_mouse"), ("tau_session", "V_session"))]
    return parts[0].unionByName(parts[1])


def _packed_posterior(marginal: DataFrame, cell: list[str]) -> DataFrame:
    return marginal.groupBy(*cell, "component", "n_mice", "n_sessions").agg(F.sort_array(F.collect_list(F.struct("tau", "p"))).alias("g"))


def posterior_summary(marginal: DataFrame, cell: list[str], hdi: float = VARCOMP_HDI) -> DataFrame:
    """Mean and highest-density interval of each variance (grid rows of a cell: a fixed number)."""
    def rows(rec):
        tau, p = np.array([x["tau"] for x in rec["g"]]), np.array([x["p"] for x in rec["g"]])
        p, v = p / p.sum(), tau ** 2
        step = tau[1] - tau[0]
        edges = np.concatenate([[0.0], tau + step / 2]) ** 2
        cdf = np.concatenate([[0.0], np.cumsum(p)])
        lo = np.linspace(0, 1 - hdi, 2001)
        a, b = np.interp(lo, cdf, edges), np.interp(lo + hdi, cdf, edges)
        i = int(np.argmin(b - a))
        return [dict(mean=float(p @ v), hdi_low=float(a[i]), hdi_high=float(b[i]))]

    return _per_group(_packed_posterior(marginal, cell), [*cell, "component", "n_mice", "n_sessions"], "mean double, hdi_low double, hdi_high double", rows)


def posterior_density(marginal: DataFrame, cell: list[str], points: int = VARCOMP_GRID) -> DataFrame:
    """Density of each variance on an even grid from 0 to its largest supported value."""
    def rows(rec):
        tau, p = np.array([x["tau"] for x in rec["g"]]), np.array([x["p"] for x in rec["g"]])
        p, step = p / p.sum(), tau[1] - tau[0]
        seen = np.flatnonzero(np.cumsum(p) < 1 - 1e-6)
        x = np.linspace(0, ((tau[seen[-1]] if len(seen) else tau[0]) + step) ** 2, points)
        dens = np.interp(np.sqrt(x), tau, p / step) / (2 * np.sqrt(np.maximum(x, (step / 2) ** 2)))
        return [dict(x=float(a), density=float(b)) for a, b in zip(x, dens)]

    return _per_group(_packed_posterior(marginal, cell), [*cell, "component", "n_mice", "n_sessions"], "x double, density double", rows)
