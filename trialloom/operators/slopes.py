"""Mixed models with random slopes, fitted from per-subject moments of all groups and models at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trialloom.functions.smallmath import _full_rank, normal_sf, unpack
from trialloom.operators.derive import term_name
from trialloom.operators.linear import _key_types, _per_group
from trialloom.session import cut_lineage

BLOCK_SUBJECTS = 4096            # moment matrices in one row of a pass
DAMPINGS = (1e-3, 1.0, 1e3)      # multiples of the current damping that a pass tries together
RESTED = 1e-7                    # foreseen gain in -2 log likelihood at which a fit has come to rest
CREEPING = 1e-5                  # it has as well where foreseen and last gain are below this: a flat valley at the border
SINGULAR = 1e-7                  # share of the response's residual variance below which a direction has none


def columns_of(terms, family: dict[str, list], random) -> dict[str, tuple[list[int], list[int]]]:
    """Columns of [1, terms...] per model: fixed ones, and random ones (the intercept and the slopes).

    ``random`` lists the slope terms, for all models or per model name. A slope need not be a fixed term.
    """
    at = {t: i + 1 for i, t in enumerate(terms)}
    slopes = lambda name: random.get(name, []) if isinstance(random, dict) else random
    return {name: ([0] + [at[t] for t in fixed], [0] + [at[t] for t in slopes(name)]) for name, fixed in family.items()}


def _factor(theta, q: int) -> np.ndarray:
    low = np.zeros((q, q))
    low[np.tril_indices(q)] = theta
    return low


def _stack(grams, size: int) -> np.ndarray:
    out = np.zeros((len(grams), size, size))
    a, b = np.triu_indices(size)
    out[:, a, b] = out[:, b, a] = np.stack([np.asarray(g, float) for g in grams])
    return out


def _shares(g: np.ndarray, x: list[int], z: list[int], low: np.ndarray) -> np.ndarray:
    """Sums over subjects that the criterion and its derivatives need, as one flat array.

    With V = I + Z L L' Z' per subject: n, log |V|, [X y]'V^-1[X y], Z'V^-1Z, its Kronecker square, and
    the outer square of Z'V^-1[X y]; V is never formed, (I + L'Z'ZL) is q x q.
    """
    xy = [*x, g.shape[1] - 1]
    zz, zx = g[:, z][:, :, z], g[:, z][:, :, xy]
    inner = np.eye(len(z)) + low.T @ zz @ low
    w = low @ np.linalg.solve(inner, np.broadcast_to(low.T, inner.shape))
    a = g[:, xy][:, :, xy] - np.swapaxes(zx, 1, 2) @ w @ zx
    s, v = zz - zz @ w @ zz, zx - zz @ w @ zx
    return np.concatenate([[g[:, 0, 0].sum(), np.linalg.slogdet(inner)[1].sum()], a.sum(axis=0).ravel(), s.sum(axis=0).ravel(),
                           np.einsum("mij,mkl->ikjl", s, s).ravel(), np.einsum("mia,mjb->iajb", v, v).ravel()])


class _Point:
    """Criterion (-2 log likelihood up to a constant), fixed effects and next steps at one factor."""

    def __init__(self, flat, p: int, q: int, low: np.ndarray, reml: bool):
        flat, at = np.asarray(flat, float), 2
        parts = []
        for shape in ((p + 1, p + 1), (q, q), (q * q, q * q), (q, p + 1, q, p + 1)):
            size = int(np.prod(shape))
            parts.append(flat[at:at + size].reshape(shape))
            at += size
        a, s, ss, t = parts
        n, logdet = flat[:2]
        self.value, self.inverse = np.inf, None
        if not np.isfinite(flat).all() or n <= p or not _full_rank(a[:p, :p]):
            return
        self.inverse = np.linalg.inv(a[:p, :p])
        self.beta = self.inverse @ a[:p, p]
        rss, dof = a[p, p] - self.beta @ a[:p, p], n - p if reml else n
        if rss <= 0:
            return
        self.sigma2 = rss / dof
        self.value = logdet + dof * np.log(rss) + (np.linalg.slogdet(a[:p, :p])[1] if reml else 0.0)
        u = np.concatenate([-self.beta, [1.0]])
        slope = s - np.einsum("iajb,a,b->ij", t, u, u) / self.sigma2
        if reml:
            slope = slope - np.einsum("iajb,ab->ij", t[:, :p, :, :p], self.inverse)
        curve = ss - np.outer(s.ravel(), s.ravel()) / dof
        rows, cols = np.tril_indices(q)
        jac = np.zeros((q * q, len(rows)))
        for k, (i, j) in enumerate(zip(rows, cols)):
            d = np.zeros((q, q))
            d[i] = low[:, j]
            jac[:, k] = (d + d.T).ravel()
        w, vec = np.linalg.eigh((slope + slope.T) / 2)
        bent = 2 * np.kron((vec * np.maximum(w, 0)) @ vec.T, np.eye(q))  # second order of L L' where the criterion rises
        pick = rows * q + cols
        self.grad = jac.T @ slope.ravel()
        self.hess = jac.T @ curve @ jac + bent[np.ix_(pick, pick)]

    def step(self, damping: float) -> np.ndarray:
        scale = np.maximum(np.diag(self.hess), 1e-12 * max(np.diag(self.hess).max(), 1e-300))
        return -np.linalg.lstsq(self.hess + damping * np.diag(scale), self.grad, rcond=None)[0]


def _passes(packed: DataFrame, totals: DataFrame, keys: list[str], size: int, models: dict, reml: bool, rounds: int) -> DataFrame:
    """State per (keys, name) after damped Fisher scoring; every pass serves all groups, models and dampings."""
    schema = f"{_key_types(totals, keys)}, name string, theta array<double>, value double, sums array<double>, damping double, trial array<array<double>>, done boolean, converged boolean"
    names = [*keys, "name", "theta", "value", "sums", "damping", "trial", "done", "converged"]

    def start(rec):
        total = unpack(rec["total"], size)
        out = []
        for name, (x, z) in models.items():
            spread = np.sqrt(np.diag(total)[z] / total[0, 0])
            low = np.diag(0.3 / np.where(spread > 0, spread, 1.0))
            out.append(dict(name=name, theta=None, value=None, sums=None, damping=1e-3, trial=[list(low[np.tril_indices(len(z))])], done=False, converged=False))
        return out

    def evaluate(rec):
        x, z = models[rec["name"]]
        g = _stack(rec["grams"], size)
        return [dict(name=rec["name"], cand=c, sums=list(_shares(g, x, z, _factor(theta, len(z))))) for c, theta in enumerate(rec["trial"])]

    def update(rec):
        x, z = models[rec["name"]]
        p, q = len(x), len(z)
        point = lambda sums, theta: _Point(sums, p, q, _factor(theta, q), reml)
        old = None if rec["theta"] is None else point(rec["sums"], rec["theta"])
        tried = [(point(c["values"], rec["trial"][c["cand"]]), c["values"], rec["trial"][c["cand"]], c["cand"]) for c in rec["tried"]]
        new, sums, theta, cand = min(tried, key=lambda c: c[0].value)
        if not np.isfinite(new.value) and old is None:  # no fit at all: rank or residual
            return [dict(name=rec["name"], theta=None, value=None, sums=None, damping=0.0, trial=[], done=True, converged=False)]
        damping = rec["damping"]
        if old is not None and not new.value < old.value:
            gain = -old.grad @ old.step(DAMPINGS[0]) / 2
            new, sums, theta, damping = old, rec["sums"], rec["theta"], damping * 1e4
            if gain < RESTED or damping > 1e12:
                return [dict(name=rec["name"], theta=list(theta), value=new.value, sums=list(sums), damping=damping, trial=[], done=True, converged=bool(gain < CREEPING))]
        elif old is not None:
            damping = min(max(damping * DAMPINGS[cand], 1e-9), 1e9)
        gain = -new.grad @ new.step(DAMPINGS[0]) / 2  # damped steps would foresee less and less
        done = bool(gain < RESTED or gain < CREEPING and old is not None and old is not new and old.value - new.value < CREEPING)
        trial = [list(np.asarray(theta) + new.step(damping * d)) for d in DAMPINGS]
        return [dict(name=rec["name"], theta=list(theta), value=float(new.value), sums=list(sums), damping=float(damping), trial=trial, done=done, converged=done)]

    body = schema.split(", name string, ", 1)[1]
    state = cut_lineage(_per_group(totals, keys, f"name string, {body}", start))
    tasks = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        active = state.where("NOT done")
        if active.isEmpty():
            break
        met = packed.join(active.select(*keys, "name", "trial"), keys)
        cells = _per_group(met, keys, "name string, cand int, sums array<double>", evaluate)
        cells = cells.select(*keys, "name", "cand", F.posexplode("sums").alias("pos", "v")).groupBy(*keys, "name", "cand", "pos").agg(F.sum("v").alias("v"))
        tried = cells.groupBy(*keys, "name", "cand").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("values"))
        tried = tried.groupBy(*keys, "name").agg(F.collect_list(F.struct("cand", "values")).alias("tried"))
        moved = _per_group(active.join(tried, [*keys, "name"]), keys, f"name string, {body}", update)
        state = cut_lineage(moved.unionByName(state.where("done")).coalesce(tasks))
    return state.select(*names)


def slope_fits(grams: DataFrame, keys: list[str], subject: str, terms, family: dict[str, list], random, reml: bool = True, min_subjects: int = 2, rounds: int = 60) -> DataFrame:
    """One row per (keys, name): fixed effects and covariance, random-effect covariance, residual variance.

    ``grams`` are ``mixed.subject_grams``. The relative covariance of a subject's effects is L L'; L follows
    damped Fisher scoring on the profiled criterion. A pass adds up a flat array of fixed length over blocks of
    subjects, so neither rows nor subjects are gathered; a few dozen passes at most, ``converged`` tells. Groups
    with fewer subjects give no row; a model without full rank gives nulls; ``singular`` marks a covariance that
    has collapsed in some direction.
    """
    size, models = len(terms) + 2, columns_of(terms, family, random)
    m = size * (size + 1) // 2
    totals = cut_lineage(grams.groupBy(*keys).agg(F.array(*[F.sum(F.col("gram")[i]) for i in range(m)]).alias("total"), F.count(F.lit(1)).alias("n_subjects"))
                         .where(F.col("n_subjects") >= min_subjects))
    blocks = F.ceil(F.col("n_subjects") / BLOCK_SUBJECTS)
    placed = grams.join(totals.select(*keys, "n_subjects"), keys).withColumn("__b", F.pmod(F.xxhash64(subject), blocks).cast("int"))
    packed = cut_lineage(placed.groupBy(*keys, "__b").agg(F.collect_list("gram").alias("grams")))
    state = _passes(packed, totals, keys, size, models, reml, rounds)

    def rows(rec):
        x, z = models[rec["name"]]
        if rec["theta"] is None:
            return [dict(name=rec["name"], beta=None, cov=None, factor=None, random_cov=None, sigma2=None, criterion=None, converged=False, singular=None, n_subjects=rec["n_subjects"])]
        low = _factor(rec["theta"], len(z))
        at = _Point(rec["sums"], len(x), len(z), low, reml)
        total = unpack(rec["total"], size)
        spread = np.sqrt(np.diag(total)[z] / total[0, 0])
        share = np.linalg.eigvalsh(low @ low.T * np.outer(spread, spread))[0]
        return [dict(name=rec["name"], beta=list(at.beta), cov=list((at.inverse * at.sigma2).ravel()), factor=list(map(float, rec["theta"])),
                     random_cov=list((low @ low.T * at.sigma2).ravel()), sigma2=float(at.sigma2), criterion=float(at.value), converged=bool(rec["converged"]),
                     singular=bool(share < SINGULAR), n_subjects=rec["n_subjects"])]

    schema = ("name string, beta array<double>, cov array<double>, factor array<double>, random_cov array<double>, sigma2 double, criterion double, "
              "converged boolean, singular boolean, n_subjects long")
    return cut_lineage(_per_group(state.join(totals, keys), keys, schema, rows))


def slope_coefficients(fits: DataFrame, keys: list[str], terms, family: dict[str, list]) -> DataFrame:
    """Fixed effects with SE, z, p and Wald interval per (keys, name, term)."""
    def rows(rec):
        if rec["beta"] is None:
            return []
        labels = [term_name(())] + [term_name(t) for t in family[rec["name"]]]
        beta = np.asarray(rec["beta"], float)
        se = np.sqrt(np.diag(np.asarray(rec["cov"], float).reshape(len(beta), -1)))
        p = 2 * normal_sf(np.abs(beta / se))
        return [dict(name=rec["name"], term=t, coef=beta[i], se=se[i], z=beta[i] / se[i], p=float(p[i]), ci_lower=beta[i] - 1.96 * se[i], ci_upper=beta[i] + 1.96 * se[i])
                for i, t in enumerate(labels)]

    return _per_group(fits, keys, "name string, term string, coef double, se double, z double, p double, ci_lower double, ci_upper double", rows)


def slope_effects(grams: DataFrame, fits: DataFrame, keys: list[str], subject: str, terms, family: dict[str, list], random) -> DataFrame:
    """Predicted intercept and slopes per subject: (keys, name, subject, term, effect)."""
    return _effects(grams, fits, keys, subject, terms, family, random).select(*keys, "name", subject, F.explode("effects").alias("e")).select(
        *keys, "name", subject, F.col("e.term").alias("term"), F.col("e.effect").alias("effect"))


def _effects(grams, fits, keys, subject, terms, family, random) -> DataFrame:
    size, models = len(terms) + 2, columns_of(terms, family, random)
    labels = [term_name(())] + [term_name(t) for t in terms]

    def rows(rec):
        x, z = models[rec["name"]]
        g, low, u = unpack(rec["gram"], size), _factor(rec["factor"], len(z)), np.concatenate([-np.asarray(rec["beta"], float), [1.0]])
        zz, rest = g[np.ix_(z, z)], g[np.ix_(z, [*x, size - 1])] @ u
        b = low @ np.linalg.solve(np.eye(len(z)) + low.T @ zz @ low, low.T @ rest)
        return [dict(name=rec["name"], effects=[dict(term=labels[i], effect=float(v)) for i, v in zip(z, b)], square=float(b @ zz @ b), shift=float(g[0, z] @ b))]

    met = grams.join(fits.where("beta IS NOT NULL").select(*keys, "name", "beta", "factor"), keys)
    return _per_group(met, [*keys, subject], "name string, effects array<struct<term:string,effect:double>>, square double, shift double", rows)


def slope_variance(grams: DataFrame, fits: DataFrame, keys: list[str], subject: str, terms, family: dict[str, list], random) -> DataFrame:
    """(keys, name, marginal_r2, conditional_r2): variance of the fixed part, and plus that of the predicted effects, over var(y).

    Null where the fit failed or its covariance is singular.
    """
    size, models = len(terms) + 2, columns_of(terms, family, random)
    m = size * (size + 1) // 2
    totals = grams.groupBy(*keys).agg(F.array(*[F.sum(F.col("gram")[i]) for i in range(m)]).alias("total"))
    own = _effects(grams, fits, keys, subject, terms, family, random).groupBy(*keys, "name").agg(F.sum("square").alias("square"), F.sum("shift").alias("shift"))
    met = fits.select(*keys, "name", "beta", "singular").join(totals, keys).join(own, [*keys, "name"], "left")

    def rows(rec):
        x, y = models[rec["name"]][0], size - 1
        g = unpack(rec["total"], size)
        n, var_y = g[0, 0], g[y, y] / g[0, 0] - (g[0, y] / g[0, 0]) ** 2
        if rec["beta"] is None or rec["singular"] or var_y <= 0:
            return [dict(name=rec["name"], marginal_r2=None, conditional_r2=None)]
        beta = np.asarray(rec["beta"], float)
        fixed = beta @ g[np.ix_(x, x)] @ beta / n - (g[0, x] @ beta / n) ** 2
        return [dict(name=rec["name"], marginal_r2=float(fixed / var_y), conditional_r2=float((fixed + rec["square"] / n - (rec["shift"] / n) ** 2) / var_y))]

    return _per_group(met, keys, "name string, marginal_r2 double, conditional_r2 double", rows)
