"""Tail probabilities and solves on p x p moment matrices (numpy, a few dozen columns at most).

Spark does the heavy part, the sums over rows; these run once per group on its sums.
"""

from __future__ import annotations

import math

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if not np.isfinite(x):
        return 0.0 if x > 0 else float("nan")
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2.0, x / 2.0)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1 + even * d)
        c = 1 + even / c
        h *= c * d
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1 + odd * d)
        c = 1 + odd / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or not np.isfinite(f):
        return 0.0 if f is not None and f > 0 else float("nan")
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0) if f > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def unpack(flat, size: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle by rows."""
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = np.asarray(flat, float)
    return m + np.triu(m, 1).T


def _full_rank(xtx: np.ndarray) -> bool:
    d = np.sqrt(np.diag(xtx))
    if (d == 0).any():
        return False
    return bool(np.linalg.matrix_rank(xtx / np.outer(d, d), tol=1e-10, hermitian=True) == len(d))


def ols(gram: np.ndarray, columns: list[int]):
    """Least squares of the last column on ``columns`` (column 0 is the intercept).

    Returns coefficients, their covariance, centred R2 and n; None without full rank.
    """
    n, y = gram[0, 0], gram.shape[0] - 1
    xtx, xty = gram[np.ix_(columns, columns)], gram[columns, y]
    if n <= 0 or not _full_rank(xtx):
        return None
    beta = np.linalg.solve(xtx, xty)
    rss = max(gram[y, y] - beta @ xty, 0.0)
    tss = gram[y, y] - gram[0, y] ** 2 / n
    dof = n - len(columns)
    cov = np.linalg.inv(xtx) * (rss / dof if dof > 0 else np.nan)
    return beta, cov, (1 - rss / tss if tss > 0 else np.nan), n


def ols_r2(grams: np.ndarray, columns: list[int]) -> np.ndarray:
    """Centred R2 for a stack of moment matrices; NaN where the design is rank deficient."""
    n, y = grams[:, 0, 0], grams.shape[1] - 1
    xtx, xty = grams[:, columns][:, :, columns], grams[:, columns, y]
    d = np.sqrt(np.einsum("kii->ki", xtx))
    scale = np.where(d > 0, d, 1.0)
    corr = xtx / (scale[:, :, None] * scale[:, None, :])
    ok = (d > 0).all(axis=1) & (np.linalg.eigvalsh(corr)[:, 0] > 1e-10)
    safe = np.where(ok[:, None, None], xtx, np.eye(len(columns)))
    beta = np.linalg.solve(safe, xty[:, :, None])[:, :, 0]
    tss = grams[:, y, y] - grams[:, 0, y] ** 2 / n
    rss = np.maximum(grams[:, y, y] - (beta * xty).sum(axis=1), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(ok & (tss > 0), 1 - rss / tss, np.nan)


def r2_lost(grams: list[list[np.ndarray]], kept: list[int], dropped: list[int]) -> np.ndarray:
    """R2 of the model with all columns less that of the ``kept`` ones, by elimination in this order; ``grams[i][j]`` are
    stacks of moments, the response last, column 0 of ones.

    NaN where the determinant of the scaled design is under 1e-6: whether such a design has full rank is for ols_r2 to say.
    """
    y, columns = len(grams) - 1, [*kept, *dropped]
    with np.errstate(divide="ignore", invalid="ignore"):
        tss = grams[y][y] - grams[0][y] ** 2 / grams[0][0]
        size = {i: np.sqrt(grams[i][i]) for i in columns} | {y: np.float64(1.0)}
        m = {(i, j): grams[i][j] / (size[i] * size[j]) for i in [*columns, y] for j in [*columns, y] if [*columns, y].index(i) <= [*columns, y].index(j)}
        det, left = np.ones(len(tss)), [*columns, y]
        rss = {}
        for k in columns:
            left.remove(k)
            det = det * m[k, k]
            for a, i in enumerate(left):
                f = m[k, i] / m[k, k]
                for j in left[a:]:
                    m[i, j] = m[i, j] - f * m[k, j]
            rss[k] = np.maximum(m[y, y], 0.0)
        lost = (rss[kept[-1]] - rss[columns[-1]]) / tss
        return np.where((det > 1e-6) & (tss > 0), lost, np.nan)


class SubjectSums:
    """What a random-intercept fit needs: the total moments and, per subject size, the sums of outer products."""

    def __init__(self, total: np.ndarray, sizes: np.ndarray, counts: np.ndarray, outer: np.ndarray, first: np.ndarray):
        self.total, self.sizes, self.counts, self.outer, self.first = total, sizes, counts, outer, first

    def without(self, gram: np.ndarray) -> SubjectSums:
        """The same sums with one subject taken out."""
        s, n = gram[0], gram[0, 0]
        hit = self.sizes == n
        return SubjectSums(self.total - gram, self.sizes, self.counts - hit,
                           self.outer - hit[:, None, None] * np.outer(s, s), self.first - hit[:, None] * s)

    @property
    def subjects(self) -> int:
        return int(self.counts.sum())

    def fits_without(self, grams: np.ndarray, columns: list[int], reml: bool) -> list[MixedFit | None]:
        """``without(g).fit(columns, reml)`` for every subject of a stack; each step of the search looks at all of them."""
        y = self.total.shape[0] - 1
        keep, p = [*columns, y], len(columns)
        n, own_n = self.total[0, 0] - grams[:, 0, 0], grams[:, 0, 0]
        t, q = (self.total - grams)[:, keep][:, :, keep], len(keep)
        able = [i for i in range(len(grams)) if n[i] > p and _full_rank(t[i, :p, :p])]
        if not able:
            return [None] * len(grams)
        n, own_n, t = n[able], own_n[able], t[able]
        row = grams[able][:, 0][:, keep]
        own = row[:, :, None] * row[:, None, :]
        held = (self.sizes == own_n[:, None]).any(axis=1)[:, None].astype(float)
        o = self.outer[:, keep][:, :, keep].reshape(len(self.sizes), q * q)

        def at(ratios: np.ndarray):
            """As in fit(), for (subjects, ratios) or for (1, ratios) that all subjects share."""
            w = ratios[:, :, None] / (1 + ratios[:, :, None] * self.sizes)
            mine = held * ratios / (1 + ratios * own_n[:, None])
            a = t[:, None] - (w.reshape(-1, len(self.sizes)) @ o).reshape(*ratios.shape, q, q) + mine[:, :, None, None] * own[:, None]
            axx, axy = a[..., :p, :p], a[..., :p, p]
            beta = np.linalg.solve(axx, axy[..., None])[..., 0]
            rss = np.maximum(a[..., p, p] - (beta * axy).sum(axis=-1), 1e-300)
            score = np.log1p(ratios[:, :, None] * self.sizes) @ self.counts - held * np.log1p(ratios * own_n[:, None])
            if reml:
                score = score + (n - p)[:, None] * np.log(rss) + np.linalg.slogdet(axx)[1]
            else:
                score = score + n[:, None] * np.log(rss)
            return score, axx, beta, rss, w

        grid = np.concatenate([[0.0], np.exp(np.linspace(np.log(1e-6), np.log(1e4), 48))])[None]
        each = np.arange(len(able))
        for _ in range(7):
            best = np.argmin(at(grid)[0], axis=1)
            of = each if len(grid) > 1 else np.zeros_like(each)
            grid = np.linspace(grid[of, np.maximum(best - 1, 0)], grid[of, np.minimum(best + 1, grid.shape[1] - 1)], 17, axis=1)
        score, axx, beta, rss, w = at(grid)
        i = np.argmin(score, axis=1)
        axx, beta, w, ratio = axx[each, i], beta[each, i], w[each, i], grid[each, i]
        sigma2 = rss[each, i] / (n - p if reml else n)
        cov = np.linalg.inv(axx) * sigma2[:, None, None]
        out: list[MixedFit | None] = [None] * len(grams)
        for k, j in enumerate(able):
            out[j] = MixedFit(self.without(grams[j]), columns, beta[k], cov[k], ratio[k], sigma2[k], w[k])
        return out

    def fit(self, columns: list[int], reml: bool):
        """Random-intercept fit by a one-dimensional search over the variance ratio."""
        y = self.total.shape[0] - 1
        keep = [*columns, y]
        t, o = self.total[np.ix_(keep, keep)], self.outer[:, keep][:, :, keep]
        n, p = self.total[0, 0], len(columns)
        if n <= p or not _full_rank(t[:p, :p]):
            return None

        def at(ratios: np.ndarray):
            """Criterion and pieces of the fit for several variance ratios at once."""
            w = ratios[:, None] / (1 + ratios[:, None] * self.sizes)
            a = t - np.tensordot(w, o, axes=1)
            axx, axy = a[:, :p, :p], a[:, :p, p]
            beta = np.linalg.solve(axx, axy[:, :, None])[:, :, 0]
            rss = np.maximum(a[:, p, p] - (beta * axy).sum(axis=1), 1e-300)
            score = np.log1p(ratios[:, None] * self.sizes) @ self.counts
            if reml:
                score = score + (n - p) * np.log(rss) + np.linalg.slogdet(axx)[1]
            else:
                score = score + n * np.log(rss)
            return score, axx, beta, rss, w

        grid = np.concatenate([[0.0], np.exp(np.linspace(np.log(1e-6), np.log(1e4), 48))])
        for _ in range(7):
            best = int(np.argmin(at(grid)[0]))
            grid = np.linspace(grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], 17)
        score, axx, beta, rss, w = at(grid)
        i = int(np.argmin(score))
        sigma2 = rss[i] / (n - p if reml else n)
        return MixedFit(self, columns, beta[i], np.linalg.inv(axx[i]) * sigma2, grid[i], sigma2, w[i])


class MixedFit:
    def __init__(self, sums, columns, beta, cov, ratio, sigma2, weights):
        self.sums, self.columns, self.beta, self.cov = sums, columns, beta, cov
        self.ratio, self.sigma2, self.weights = ratio, sigma2, weights

    def variance_explained(self) -> tuple[float, float]:
        """(marginal, conditional): variance of the fixed part, and plus that of the intercepts, over var(y)."""
        g, c, y = self.sums.total, self.columns, self.sums.total.shape[0] - 1
        n = g[0, 0]
        var_y = g[y, y] / n - (g[0, y] / n) ** 2
        if var_y <= 0:
            return 0.0, 0.0
        fixed = self.beta @ g[np.ix_(c, c)] @ self.beta / n - (g[0, c] @ self.beta / n) ** 2
        v = np.zeros(g.shape[0])
        v[c], v[y] = -self.beta, 1.0
        sq = self.sums.sizes * self.weights ** 2 @ np.einsum("kij,i,j->k", self.sums.outer, v, v) / n
        mean = self.sums.sizes * self.weights @ (self.sums.first @ v) / n
        return fixed / var_y, (fixed + sq - mean ** 2) / var_y

    def held_out_r2(self, gram: np.ndarray) -> float | None:
        """R2 of the fixed part on one subject's sums, both sides centred."""
        c, y, n = self.columns, gram.shape[0] - 1, gram[0, 0]
        v = np.zeros(gram.shape[0])
        v[c], v[y] = -self.beta, 1.0
        tot = gram[y, y] - gram[0, y] ** 2 / n
        if tot <= 0:
            return None
        return 1 - (v @ gram @ v - (gram[0] @ v) ** 2 / n) / tot


def ridge_path(gram: np.ndarray, folds: list[np.ndarray], alphas):
    """Ridge on z-scored columns with the alpha of the best pooled out-of-fold R2.

    ``gram`` holds the whole recording's moments of [1, x..., y], ``folds`` those of each
    contiguous fold. Held-out errors come from fold moments, never from rows.
    """
    n, y = gram[0, 0], gram.shape[0] - 1
    mean = gram[0, 1:y] / n
    sd = np.sqrt(np.maximum(np.diag(gram)[1:y] / n - mean ** 2, 0))
    sd = np.where(sd > 0, sd, 1.0)
    scale = np.eye(gram.shape[0])
    scale[0, 1:y] = -mean / sd
    scale[np.arange(1, y), np.arange(1, y)] = 1 / sd
    z = scale.T @ gram @ scale
    zf = [scale.T @ f @ scale for f in folds]

    def solve(g, alpha):
        """Slopes and intercept for stacks (..., matrix) of moments and as many alphas as fit to them."""
        m, mu = g[..., 0, 0], g[..., 0, 1:] / g[..., 0, :1]
        c = g[..., 1:, 1:] - m[..., None, None] * (mu[..., :, None] * mu[..., None, :])
        ridge = np.asarray(alpha)[..., None, None] * np.eye(c.shape[-1] - 1)
        b = np.linalg.solve(c[..., :-1, :-1] + ridge, c[..., :-1, -1:])[..., 0]
        return b, mu[..., -1] - (mu[..., :-1] * b).sum(axis=-1)

    def error(g, b, a):
        v = np.concatenate([-a[..., None], -b, np.ones_like(a)[..., None]], axis=-1)
        return ((v[..., :, None] * g).sum(axis=-2) * v).sum(axis=-1)

    tss = z[-1, -1] - z[0, -1] ** 2 / n
    zf = np.array(zf)
    held_out = error(zf[:, None], *solve((z - zf)[:, None], alphas))  # (folds, alphas)
    scores = 1 - held_out.sum(axis=0) / tss
    best = int(np.argmax(scores))
    b, a = solve(z, alphas[best])
    return dict(alpha=alphas[best], cv_r2=scores[best], r2=1 - error(z, b, a) / tss, coef=b / sd, scaled=b, z=z, folds=zf, tss=tss,
                solve=solve, error=error)


def cca(gram: np.ndarray, kx: int, n_components: int | None = None, scale: bool = True, ridge: float = 0.0):
    """Canonical correlations from the moments of [1, x..., y...].

    Constant y columns are left out. Returns correlations, weights of the standardised
    columns (unit length), and the mean squared loading per variate on both sides.
    """
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    c = gram[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    varying = np.array([True] * kx + list(sd[kx:] > 1e-12))
    if not varying[kx:].any():
        raise ValueError("y has no varying column")
    c, sd = c[np.ix_(varying, varying)], np.where(sd > 1e-12, sd, 1.0)[varying]
    r = c / np.outer(sd, sd) if scale else c
    xx, yy, xy = r[:kx, :kx], r[kx:, kx:], r[:kx, kx:]

    def root(m):
        w, v = np.linalg.eigh(m + ridge * np.eye(len(m)))
        inv = np.where(w > 1e-10 * w.max(), 1 / np.sqrt(np.maximum(w, 1e-300)), 0.0)
        return (v * inv) @ v.T

    rx, ry = root(xx), root(yy)
    u, s, vt = np.linalg.svd(rx @ xy @ ry)
    k = min(kx, r.shape[0] - kx, int(n))
    k = k if n_components is None else min(k, n_components)
    wx, wy = rx @ u[:, :k], ry @ vt[:k].T
    sx, sy = np.sqrt(np.einsum("ik,ij,jk->k", wx, xx, wx)), np.sqrt(np.einsum("ik,ij,jk->k", wy, yy, wy))
    corr = np.einsum("ik,ij,jk->k", wx, xy, wy) / np.maximum(sx * sy, 1e-300)
    adequacy_x = ((xx @ wx / np.maximum(sx, 1e-300)) ** 2 / np.diag(xx)[:, None]).mean(axis=0)
    adequacy_y = ((yy @ wy / np.maximum(sy, 1e-300)) ** 2 / np.diag(yy)[:, None]).mean(axis=0)
    wx, wy = wx / np.linalg.norm(wx, axis=0), wy / np.linalg.norm(wy, axis=0)
    flip = np.sign(wx[np.abs(wx).argmax(axis=0), np.arange(k)])
    return dict(correlations=corr, x_weights=wx * flip, y_weights=wy * flip, x_adequacy=adequacy_x, y_adequacy=adequacy_y, y_kept=varying[kx:])
