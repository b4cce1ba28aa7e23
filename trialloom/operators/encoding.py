"""Encoding models (sparse event designs, ridge) and psychometric fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trialloom.constants import BASIS_COUNT, BASIS_OFFSET, BASIS_SECONDS, ENCODING_DT, ENCODING_FOLDS, ENCODING_LAGS
from trialloom.functions.columns import ERF_A, ERF_P, psychometric_curve
from trialloom.functions.joins import skew_join
from trialloom.functions.smallmath import ridge_path
from trialloom.operators.linear import _key_types, _per_group
from trialloom.session import spread


# --- design ---------------------------------------------------------------------------

def nearest_bin(t, start, dt: float = ENCODING_DT) -> Column:
    """Grid bin nearest to a time, halves to even."""
    return F.bround((t - start) / F.lit(float(dt))).cast("long")


def placed_events(events: DataFrame, bounds: DataFrame, keys: list[str], t: str, heights: dict[str, Column], dt: float = ENCODING_DT) -> DataFrame:
    """(keys, bin, n_bins, one column per height): an event per grid bin, the last event of a bin wins."""
    j = skew_join(events.where(F.col(t).isNotNull()), bounds, keys)
    j = j.withColumn("bin", nearest_bin(F.col(t), F.col("t_start"), dt)).where((F.col("bin") >= 0) & (F.col("bin") < F.col("n_bins")))
    last = F.struct(*[h.cast("double").alias(n) for n, h in heights.items()])
    return j.groupBy(*keys, "bin", "n_bins").agg(F.max_by(last, F.col(t)).alias("__h")).select(*keys, "bin", "n_bins", "__h.*")


def event_impulses(events: DataFrame, bounds: DataFrame, keys: list[str], t: str, height: Column | None = None, dt: float = ENCODING_DT) -> DataFrame:
    """(keys, bin, height): one impulse per event bin of the grid."""
    return placed_events(events, bounds, keys, t, {"height": height if height is not None else F.lit(1.0)}, dt)


def lag_basis(n_lags: int = ENCODING_LAGS) -> list[tuple[int, int, float]]:
    """(column, offset, weight) of a shift basis centred on the event."""
    return [(i, i - n_lags // 2, 1.0) for i in range(n_lags)]


def raised_cosine_basis(n_basis: int = BASIS_COUNT, duration: float = BASIS_SECONDS, offset: float = BASIS_OFFSET, dt: float = ENCODING_DT) -> list[tuple[int, int, float]]:
    """Causal bumps, dense just after the event and sparse later, as (column, offset, weight).

    Centres are evenly spaced in log(bin + offset bins); a bump is a squared cosine that
    reaches zero two spacings from its centre.
    """
    if offset <= 0:
        raise ValueError("the offset must be positive")
    n, shift = int(np.ceil(duration / dt)), int(np.ceil(offset / dt))
    warped = np.log(np.arange(n) + shift)
    centers = np.linspace(np.log(shift), np.log(n + shift), n_basis)
    reach = np.clip((warped - centers[:, None]) / (2 * (centers[1] - centers[0])), -1, 1)
    bumps = np.cos(np.pi * reach / 2) ** 2
    return [(i, j, float(bumps[i, j])) for i in range(n_basis) for j in range(n) if bumps[i, j] > 1e-12]


def expand_events(impulses: DataFrame, keys: list[str], block, basis: list[tuple[int, int, float]]) -> DataFrame:
    """Sparse design rows (keys, bin, feature, value): impulses spread over a basis table of fixed size.

    ``block`` is a name or a column that holds the block's name.
    """
    name = F.lit(block) if isinstance(block, str) else block
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(o).alias("o"), F.lit(w).alias("w")) for c, o, w in basis])
    rows = impulses.select(*keys, "bin", "n_bins", "height", name.alias("__block"), F.inline(table))
    rows = rows.withColumn("bin", F.col("bin") + F.col("o")).where((F.col("bin") >= 0) & (F.col("bin") < F.col("n_bins")) & (F.col("height") != 0))
    return rows.groupBy(*keys, "bin", F.concat("__block", F.lit(":"), F.lpad(F.col("c").cast("string"), 3, "0")).alias("feature")).agg(
        F.sum(F.col("height") * F.col("w")).alias("value"))


def event_block(events: DataFrame, bounds: DataFrame, keys: list[str], t: str, block: str, basis, modulators: dict[str, Column] | None = None,
                interactions: list[tuple[str, str]] = (), split: str | None = None, dt: float = ENCODING_DT) -> DataFrame:
    """Main-effect columns of an event plus one block per modulator and interaction.

    With ``split`` every block has columns of its own per level of that column.
    """
    mods = modulators or {}
    parts = {block: F.lit(1.0), **{f"{block}*{n}": c for n, c in mods.items()}, **{f"{block}*{a}*{b}": mods[a] * mods[b] for a, b in interactions}}
    by = [*keys, split] if split else keys
    spans = bounds.join(events.select(*by).distinct(), keys) if split else bounds
    named = {f"h{i}": h for i, h in enumerate(parts.values())}
    placed = placed_events(events, spans, by, t, named, dt)
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("__name"), F.col(h).alias("height")) for n, h in zip(parts, named)]))
    rows = expand_events(placed.select(*by, "bin", "n_bins", each), by, F.col("__name"), basis)
    if not split:
        return rows
    return rows.select(*keys, "bin", F.concat_ws("@", "feature", F.col(split).cast("string")).alias("feature"), "value")


def tonic_block(trials: DataFrame, bounds: DataFrame, keys: list[str], start: str, end: str, value: Column, block: str, dt: float = ENCODING_DT) -> DataFrame:
    """A step per trial: the trial's value on every bin between its start and end."""
    j = skew_join(trials, bounds, keys)
    a, b = nearest_bin(F.col(start), F.col("t_start"), dt), nearest_bin(F.col(end), F.col("t_start"), dt)
    rows = j.withColumns({"__a": F.greatest(a, F.lit(0).cast("long")), "__b": F.least(b - 1, F.col("n_bins") - 1), "value": value.cast("double")}).where("__b >= __a")
    return rows.select(*keys, F.explode(F.sequence("__a", "__b")).alias("bin"), F.lit(f"{block}:000").alias("feature"), "value").groupBy(*keys, "bin", "feature").agg(F.max("value").alias("value"))


def continuous_block(samples: DataFrame, keys: list[str], bin_: str, value: str, block: str, lags: list[int]) -> DataFrame:
    """A sampled regressor and its shifted copies."""
    lag = F.explode(F.array(*[F.lit(x) for x in lags]))
    return samples.select(*keys, (F.col(bin_)).alias("__b"), F.col(value).cast("double").alias("value"), lag.alias("__l")).select(
        *keys, (F.col("__b") + F.col("__l")).cast("long").alias("bin"), F.concat(F.lit(f"{block}:"), F.lpad((F.col("__l") - min(lags)).cast("string"), 3, "0")).alias("feature"), "value")


# --- ridge ------------------------------------------------------------------------------

def design_gram(design: DataFrame, target: DataFrame, keys: list[str], bins: str, value: str, folds: int = ENCODING_FOLDS) -> DataFrame:
    """Moments of [1, features, target] per (keys, fold) as (keys, fold, a, b, s) rows.

    Folds are contiguous runs of bins. Features that are zero in a bin do not occur, so the self-join on
    (keys, bin) makes only products of features active together; the constant 1 and the target are
    features of every bin.
    """
    span = target.groupBy(*keys).agg((F.max(bins) + 1).alias("__n"))
    y = skew_join(target.where(F.col(value).isNotNull()), span, keys)
    fold = F.least(F.floor(F.col(bins) * folds / F.col("__n")), F.lit(folds - 1).cast("long"))
    always = y.select(*keys, F.col(bins).alias("bin"), fold.alias("fold"), F.inline(F.array(
        F.struct(F.lit("!one").alias("feature"), F.lit(1.0).alias("value")), F.struct(F.lit("~y").alias("feature"), F.col(value).cast("double").alias("value")))))
    active = design.join(always.where("feature = '!one'").select(*keys, "bin", "fold"), [*keys, "bin"]).select(*keys, "bin", "fold", "feature", "value")
    rows = always.unionByName(active)
    packed = rows.groupBy(*keys, "bin", "fold").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("f"))
    one = packed.select(*keys, "fold", "f", F.explode("f").alias("p"))
    two = one.select(*keys, "fold", "p", F.explode("f").alias("q")).where(F.col("p.feature") <= F.col("q.feature"))
    return two.groupBy(*keys, "fold", F.col("p.feature").alias("a"), F.col("q.feature").alias("b")).agg(F.sum(F.col("p.value") * F.col("q.value")).alias("s"))


def _fold_matrices(pdf: pd.DataFrame):
    a, b = pdf["a"].tolist(), pdf["b"].tolist()
    names = sorted({*a, *b})
    at = {n: i for i, n in enumerate(names)}
    i, j = [at[n] for n in a], [at[n] for n in b]
    folds, fold = np.unique(pdf["fold"].to_numpy(), return_inverse=True)
    mats = np.zeros((len(folds), len(names), len(names)))
    mats[fold, i, j] = mats[fold, j, i] = pdf["s"].to_numpy()
    return names, mats.sum(axis=0), list(mats)


def fit_encoding(moments: DataFrame, keys: list[str], alphas: list[float]) -> DataFrame:
    """Ridge kernels in raw units per recording: (keys, block, lag column, coef, alpha, r2, cv_r2).

    A group holds folds x features^2 numbers whatever the length of the recording.
    """
    schema = f"{_key_types(moments, keys)}, block string, column int, level string, coef double, alpha double, r2 double, cv_r2 double"

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names, g, mats = _fold_matrices(pdf)
        fit = ridge_path(g, mats, alphas)
        out = []
        for n, c in zip(names[1:-1], fit["coef"]):
            block, rest = n.rsplit(":", 1)
            col, _, level = rest.partition("@")
            out.append((*key, block, int(col), level or None, float(c), fit["alpha"], float(fit["r2"]), float(fit["cv_r2"])))
        return pd.DataFrame(out, columns=[p.split()[0] for p in schema.split(", ")])

    return spread(moments, *keys).groupBy(*keys).applyInPandas(solve, schema)


def encoding_block_loss(moments: DataFrame, keys: list[str], alphas: list[float], cross_validated: bool = False) -> DataFrame:
    """R2 lost when a named block is removed, refitting at the full model's alpha."""
    schema = f"{_key_types(moments, keys)}, block string, delta_r2 double"

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names, g, mats = _fold_matrices(pdf)
        fit = ridge_path(g, mats, alphas)
        blocks = [n.rsplit(":", 1)[0] for n in names[1:-1]]

        def r2(keep):
            idx = [0] + [i + 1 for i in keep] + [len(names) - 1]
            z, zf = fit["z"][np.ix_(idx, idx)], fit["folds"][:, idx][:, :, idx]
            if not keep:
                return 0.0
            if cross_validated:
                return 1 - fit["error"](zf, *fit["solve"](z - zf, fit["alpha"])).sum() / fit["tss"]
            return 1 - fit["error"](z, *fit["solve"](z, fit["alpha"])) / fit["tss"]

        full = r2(list(range(len(blocks))))
        rows = [(*key, b, float(full - r2([i for i, x in enumerate(blocks) if x != b]))) for b in dict.fromkeys(blocks)]
        return pd.DataFrame(rows, columns=[p.split()[0] for p in schema.split(", ")])

    return spread(moments, *keys).groupBy(*keys).applyInPandas(solve, schema)


# --- psychometric ------------------------------------------------------------------------

def choice_counts(trials: DataFrame, keys: list[str], contrast: str = "signed_contrast", choice: str = "choice") -> DataFrame:
    """Trials and rightward choices (choice -1) per contrast level."""
    return trials.where(F.col(contrast).isNotNull()).groupBy(*keys, contrast).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(choice) == -1).alias("k"))


def _erf(x):
    t = 1 / (1 + ERF_P * np.abs(x))
    poly = t * (ERF_A[0] + t * (ERF_A[1] + t * (ERF_A[2] + t * (ERF_A[3] + t * ERF_A[4]))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def _psychometric_search(x, n, k, bias_limit, lapse_limit, rounds=12):
    """Greatest likelihood over (bias, threshold, two lapses): a coarse grid, then ever finer ones around its best point."""
    lo = np.array([-bias_limit, 2.0, 0.0, 0.0])
    hi = np.array([bias_limit, 100.0, lapse_limit, lapse_limit])
    points = (21, 12, 4, 4)
    box_lo, box_hi = lo.copy(), hi.copy()
    best = None
    for _ in range(rounds):
        axes = [np.linspace(a, b, m) for a, b, m in zip(box_lo, box_hi, points)]
        g = np.stack([a.ravel() for a in np.meshgrid(*axes, indexing="ij")])
        p = g[2][:, None] + (1 - g[2] - g[3])[:, None] * (_erf((x[None] - g[0][:, None]) / g[1][:, None]) + 1) / 2
        p = np.clip(p, 1e-6, 1 - 1e-6)
        ll = (k * np.log(p) + (n - k) * np.log(1 - p)).sum(axis=1)
        i = int(np.argmax(ll))
        best = g[:, i]
        half = (box_hi - box_lo) / 2 * np.array([0.3, 0.4, 0.6, 0.6])
        box_lo, box_hi = np.maximum(best - half, lo), np.minimum(best + half, hi)
        points = (7, 7, 5, 5)
    return best


def fit_psychometric(counts: DataFrame, keys: list[str], contrast: str = "signed_contrast", min_trials: int = 10, lapse_limit: float = 0.2) -> DataFrame:
    """Bias, threshold, lapses, R2 and trial number per key; nulls under ``min_trials`` trials or three levels.

    A key brings its contrast levels only (about ten numbers); R2 compares observed with fitted shares.
    """
    packed = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(contrast, "n", "k"))).alias("g"))

    def rows(rec):
        x, n, k = (np.array([g[i] for g in rec["g"]], float) for i in (contrast, "n", "k"))
        if n.sum() < min_trials or len(x) < 3:
            return [dict(bias=None, threshold=None, lapse_left=None, lapse_right=None, r_squared=None, n_trials=int(n.sum()))]
        b = _psychometric_search(x, n, k, np.abs(x).max(), lapse_limit)
        pred = b[2] + (1 - b[2] - b[3]) * (_erf((x - b[0]) / b[1]) + 1) / 2
        obs = k / n
        tot, res = ((obs - obs.mean()) ** 2).sum(), ((obs - pred) ** 2).sum()
        r2 = max(0.0, 1 - res / tot) if tot > 0 else float(res == 0)
        return [dict(bias=b[0], threshold=b[1], lapse_left=b[2], lapse_right=b[3], r_squared=r2, n_trials=int(n.sum()))]

    return _per_group(spread(packed, *keys), keys, "bias double, threshold double, lapse_left double, lapse_right double, r_squared double, n_trials long", rows)


def psychometric_by_block(trials: DataFrame, keys: list[str], probability: str = "probabilityLeft", min_trials: int = 10) -> DataFrame:
    """Fits of the 50, 20 and 80 blocks as psych_<block>_<parameter> columns, and the bias shift 80 - 20."""
    block = F.bround(F.col(probability) * 100).cast("int")
    counts = choice_counts(trials.withColumn("block", block).where(F.col("block").isin(50, 20, 80)), [*keys, "block"])
    fits = fit_psychometric(counts, [*keys, "block"], min_trials=min_trials)
    params = ["bias", "threshold", "lapse_left", "lapse_right", "r_squared", "n_trials"]
    wide = fits.groupBy(*keys).agg(*[F.max(F.when(F.col("block") == b, F.col(p))).alias(f"psych_{b}_{p}") for b in (50, 20, 80) for p in params])
    return wide.withColumn("bias_shift", F.col("psych_80_bias") - F.col("psych_20_bias"))


def psychometric_r2(counts: DataFrame, fits: DataFrame, keys: list[str], contrast: str = "signed_contrast") -> DataFrame:
    """R2 of given fits on observed shares, in column expressions."""
    j = counts.join(fits, keys).withColumns({"obs": F.col("k") / F.col("n"), "pred": psychometric_curve(contrast, "bias", "threshold", "lapse_left", "lapse_right")})
    a = j.groupBy(*keys).agg(F.sum((F.col("obs") - F.col("pred")) ** 2).alias("res"), (F.var_pop("obs") * F.count("obs")).alias("tot"))
    return a.select(*keys, F.when(F.col("tot") > 0, F.greatest(F.lit(0.0), 1 - F.col("res") / F.when(F.col("tot") > 0, F.col("tot")))).otherwise((F.col("res") == 0).cast("double")).alias("r_squared"))
