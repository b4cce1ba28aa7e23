"""Random-intercept models from per-subject sums: fits, held-out scores, jackknife, effects, ANOVA."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trialloom.functions.columns import all_of
from trialloom.functions.smallmath import SubjectSums, f_sf, normal_sf, ols, unpack
from trialloom.operators.derive import drop_one_family, term_name
from trialloom.session import cut_lineage, spread
from trialloom.operators.linear import _key_types, _per_group, family_columns_of, model_gram

FOLD_NUMBERS = 50_000  # folds times subject sizes that are searched together
FOLD_SCHEMA = "fold string, predictor string, n_trials long, r2 double, delta_r2 double"


def subject_grams(df: DataFrame, keys: list[str], subject: str, terms, response: str) -> DataFrame:
    """Moments of [1, terms..., response] per (keys, subject)."""
    return model_gram(df, [*keys, subject], terms, response)


def group_sums(grams: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One row per group: total moments and, per subject size n, the count and summed outer products.

    The weight of a subject in the fit depends only on its n, so subjects of equal n add up exactly.
    A group of N rows has fewer than sqrt(2N) different n; its row stays small however many subjects there are.
    """
    m = size * (size + 1) // 2
    g = lambda i: F.col("gram")[i]
    row = [g(i) for i in range(size)]  # first matrix row: n, sums of the columns, sum of the response
    total = grams.groupBy(*keys).agg(F.array(*[F.sum(g(i)) for i in range(m)]).alias("total"), F.count(F.lit(1)).alias("n_subjects"))
    outer = [F.sum(row[i] * row[j]) for i in range(size) for j in range(i, size)]
    by_n = grams.groupBy(*keys, g(0).alias("__n")).agg(F.count(F.lit(1)).alias("__k"), F.array(*outer).alias("__outer"), F.array(*[F.sum(r) for r in row]).alias("__first"))
    packed = by_n.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__n", "__k", "__outer", "__first"))).alias("sizes"))
    return total.join(packed, keys)


def _sums(rec, size: int) -> SubjectSums:
    s = rec["sizes"]
    field = lambda k: [x[k] for x in s]
    return SubjectSums(unpack(rec["total"], size), np.array(field("__n"), float), np.array(field("__k"), float),
                       np.stack([unpack(o, size) for o in field("__outer")]), np.stack([np.asarray(f, float) for f in field("__first")]))


def mixed_fits(sums: DataFrame, keys: list[str], terms, family: dict[str, list], reml: bool = True, min_subjects: int = 2) -> DataFrame:
    """Marginal and conditional variance explained per model; null when a fit fails."""
    size, cols = len(terms) + 2, family_columns_of(terms, family)

    def rows(rec):
        s = _sums(rec, size)
        if s.subjects < min_subjects:
            return []
        out = []
        for name, c in cols.items():
            fit = s.fit(c, reml)
            m, cnd = fit.variance_explained() if fit else (None, None)
            out.append(dict(name=name, marginal_r2=m, conditional_r2=cnd))
        return out

    return _per_group(sums, keys, "name string, marginal_r2 double, conditional_r2 double", rows)


def mixed_coefficients(sums: DataFrame, keys: list[str], terms, reml: bool = True) -> DataFrame:
    """Fixed effects with SE, z, p and Wald interval, and the two variance components."""
    size, names = len(terms) + 2, [term_name(())] + [term_name(t) for t in terms]

    def rows(rec):
        fit = _sums(rec, size).fit(list(range(size - 1)), reml)
        if fit is None:
            return []
        se = np.sqrt(np.diag(fit.cov))
        z = fit.beta / se
        p = 2 * normal_sf(np.abs(z))
        return [dict(term=n, coef=fit.beta[i], se=se[i], z=z[i], p=p[i], ci_lower=fit.beta[i] - 1.96 * se[i], ci_upper=fit.beta[i] + 1.96 * se[i],
                     residual_var=fit.sigma2, group_var=fit.ratio * fit.sigma2) for i, n in enumerate(names)]

    return _per_group(sums, keys, "term string, coef double, se double, z double, p double, ci_lower double, ci_upper double, residual_var double, group_var double", rows)


def random_intercepts(grams: DataFrame, sums: DataFrame, keys: list[str], subject: str, terms, reml: bool = True) -> DataFrame:
    """Predicted intercept per subject (a subject's sums against its group's fit)."""
    size = len(terms) + 2
    fitted = _per_group(sums, keys, "beta array<double>, ratio double", lambda rec: [
        dict(beta=list(f.beta), ratio=f.ratio) for f in [_sums(rec, size).fit(list(range(size - 1)), reml)] if f is not None])
    n = F.col("gram")[0]
    fixed = F.lit(0.0)
    for i in range(size - 1):
        fixed = fixed + F.col("gram")[i] * F.col("beta")[i]
    return grams.join(fitted, keys).select(*keys, subject, (F.col("ratio") / (1 + F.col("ratio") * n) * (F.col("gram")[size - 1] - fixed)).alias("intercept"))


def _leave_one_out(grams, sums, keys, subject, terms, predictors, min_subjects, score) -> DataFrame:
    size = len(terms) + 2
    cols = family_columns_of(terms, drop_one_family(terms, predictors))
    # Folds meet their group's sums in blocks: the sums are unpacked once per block, and the blocks
    # of one group run as separate tasks.
    blocks = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, "__block"]
    left = grams.withColumn("__block", F.pmod(F.xxhash64(subject), F.lit(blocks)).cast("int"))
    right = sums.where(F.col("n_subjects") >= min_subjects).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    names = [p.split()[0] for p in FOLD_SCHEMA.split(", ")]

    def solve(key, folds: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(group) and len(folds):
            total = _sums(group.iloc[0], size)
            step = max(1, FOLD_NUMBERS // len(total.sizes))
            for at in range(0, len(folds), step):
                part = folds.iloc[at:at + step]
                held = np.array([unpack(flat, size) for flat in part["gram"]])
                for name, g, r2 in zip(part[subject], held, score(total, held, cols)):
                    if r2 is not None:
                        out += [(*key[:-1], str(name), p, int(g[0, 0]), float(r2["full"]), float(r2["full"] - r2[p])) for p in predictors]
        return pd.DataFrame(out, columns=[*keys, *names])

    folds = spread(left, *by).groupBy(*by).cogroup(spread(right, *by).groupBy(*by)).applyInPandas(solve, f"{_key_types(grams, keys)}, {FOLD_SCHEMA}")
    folds = cut_lineage(folds)  # the folds and their means read it, and so may what follows
    overall = folds.groupBy(*keys, "predictor").agg(F.sum("n_trials").alias("n_trials"), F.avg("r2").alias("r2"), F.avg("delta_r2").alias("delta_r2"))
    return folds.unionByName(overall.withColumn("fold", F.lit("aggregate")))


def crossval(grams: DataFrame, sums: DataFrame, keys: list[str], subject: str, terms, predictors: list[str], min_subjects: int = 3, min_test: int = 5) -> DataFrame:
    """Leave-one-subject-out R2 and drop-one loss; training sums are the total minus the subject's."""
    def score(total, grams, cols):
        out = [None] * len(grams)
        able = np.flatnonzero(grams[:, 0, 0] >= min_test) if total.subjects - 1 >= 2 else []
        if not len(able):
            return out
        fits = {k: total.fits_without(grams[able], c, reml=False) for k, c in cols.items()}
        for i, at in enumerate(able):
            if all(f[i] is not None for f in fits.values()):
                r2 = {k: f[i].held_out_r2(grams[at]) for k, f in fits.items()}
                out[at] = None if any(v is None for v in r2.values()) else r2
        return out

    return _leave_one_out(grams, sums, keys, subject, terms, predictors, min_subjects, score)


def jackknife(grams: DataFrame, sums: DataFrame, keys: list[str], subject: str, terms, predictors: list[str], min_subjects: int = 3) -> DataFrame:
    """In-sample marginal R2 and drop-one loss with one subject left out."""
    def score(total, grams, cols):
        fits = {k: total.fits_without(grams, c, reml=False) for k, c in cols.items()}
        return [None if any(f is None for f in of) else {k: f.variance_explained()[0] for k, f in zip(fits, of)} for of in zip(*fits.values())]

    return _leave_one_out(grams, sums, keys, subject, terms, predictors, min_subjects, score)


def marginal_means(sums: DataFrame, keys: list[str], terms, levels: dict[str, list[float]], reml: bool = True) -> DataFrame:
    """Predicted response over factor levels with the other columns at their means, and its 95% interval."""
    size, names = len(terms) + 2, list(levels)
    at = {t: i + 1 for i, t in enumerate(terms)}

    def rows(rec):
        s = _sums(rec, size)
        fit = s.fit(list(range(size - 1)), reml)
        if fit is None:
            return []
        mean = s.total[0] / s.total[0, 0]
        single = {t[0]: mean[i] for t, i in at.items() if len(t) == 1}
        out = []
        for combo in np.array(np.meshgrid(*levels.values(), indexing="ij")).reshape(len(names), -1).T:
            value = {**single, **dict(zip(names, combo))}
            x = np.array([1.0] + [np.prod([value[v] for v in t]) for t in terms])
            pred, sd = x @ fit.beta, float(np.sqrt(x @ fit.cov @ x))
            out.append({**dict(zip(names, map(float, combo))), "predicted": pred, "ci_lower": pred - 1.96 * sd, "ci_upper": pred + 1.96 * sd})
        return out

    schema = ", ".join(f"{n} double" for n in names) + ", predicted double, ci_lower double, ci_upper double"
    return _per_group(sums, keys, schema, rows)


def cell_means(df: DataFrame, keys: list[str], subject: str, within: list[str], response: str, min_trials: int = 1) -> DataFrame:
    """Mean response per subject and cell, for cells with enough trials."""
    return (df.where(F.col(response).isNotNull()).groupBy(*keys, subject, *within).agg(F.avg(response).alias(response), F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") >= min_trials).drop("__n"))


def anova_rm(cells: DataFrame, subject: str, within: list[str], response: str) -> DataFrame:
    """Repeated-measures F tests on subject cell means (one group).

    Balanced data: sums of squares by inclusion and exclusion over the marginals of one ``cube``.
    Otherwise a type III model with subjects ignored, and ``method`` says so.
    """
    names = [*within, subject]
    cube = cells.cube(*names).agg(F.sum(response).alias("__s"), F.count(response).alias("__n"), F.grouping_id().alias("__gid"))
    table = cube.groupBy("__gid").agg(F.sum(F.col("__s") ** 2 / F.col("__n")).alias("u"), F.count(F.lit(1)).alias("levels"), F.max("__n").alias("hi"))
    k = len(names)
    by_set = {r["__gid"]: r for r in table.collect()}  # 2^k rows, one per margin
    gid = lambda s: sum(1 << (k - 1 - i) for i, n in enumerate(names) if n not in s)
    full = by_set[gid(names)]
    levels = {n: by_set[gid([n])]["levels"] for n in names}
    balanced = full["levels"] == np.prod([levels[n] for n in names]) and full["hi"] == 1
    rows = []
    if balanced:
        def ss(s):
            return sum((-1) ** (len(s) - r) * sum(by_set[gid(list(t))]["u"] for t in combinations(s, r)) for r in range(len(s) + 1))

        for r in range(1, len(within) + 1):
            for effect in combinations(within, r):
                df1 = int(np.prod([levels[e] - 1 for e in effect]))
                df2 = df1 * (levels[subject] - 1)
                err = ss([*effect, subject]) / df2 if df2 else np.nan
                f = ss(list(effect)) / df1 / err if err > 1e-300 else np.nan
                rows.append((":".join(effect), float(f), float(df1), float(df2), float(f_sf(f, df1, df2)), "rm"))
    else:
        rows = _type_three(cells, within, response)
    return cells.sparkSession.createDataFrame(rows, "source string, f double, num_df double, den_df double, p double, method string")


def _type_three(cells: DataFrame, within: list[str], response: str) -> list[tuple]:
    """Sum-to-zero coded model without subjects; each effect against the model that lacks its columns."""
    levels = {w: sorted(r[0] for r in cells.select(w).distinct().collect()) for w in within}  # task factors: few levels

    def coded(w) -> list[Column]:
        ref = levels[w][-1]
        return [F.when(F.col(w) == F.lit(v), 1.0).when(F.col(w) == F.lit(ref), -1.0).otherwise(0.0) for v in levels[w][:-1]]

    cols, owner = [], []
    for r in range(1, len(within) + 1):
        for effect in combinations(within, r):
            block = coded(effect[0])
            for e in effect[1:]:
                block = [a * b for a in block for b in coded(e)]
            cols += block
            owner += [effect] * len(block)
    from trialloom.operators.linear import gram

    g = unpack(gram(cells.where(all_of([F.col(w).isNotNull() for w in within])), [], [*cols, F.col(response)]).first()["gram"], len(cols) + 2)
    everything = list(range(len(cols) + 1))
    fit = ols(g, everything)
    rows = []
    n, y = g[0, 0], g.shape[0] - 1
    rss = lambda c, b: g[y, y] - b @ g[c, y]
    for effect in dict.fromkeys(owner):
        keep = [0] + [i + 1 for i, o in enumerate(owner) if o != effect]
        red = ols(g, keep)
        if fit is None or red is None:
            continue
        df1, df2 = len(everything) - len(keep), n - len(everything)
        f = (rss(keep, red[0]) - rss(everything, fit[0])) / df1 / (rss(everything, fit[0]) / df2)
        rows.append((":".join(effect), float(f), float(df1), float(df2), float(f_sf(f, df1, df2)), "ols"))
    return rows


def anova_groups(cells: DataFrame, keys: list[str], subject: str, within: list[str], response: str, min_subjects: int = 2) -> DataFrame:
    """F tests of every group in one plan: (keys, source, f, num_df, den_df, p, method).

    ``cells`` has one row per (keys, subject, cell). Margins of all groups come from one set of grouping sets with
    the keys in each, so a group is left with one row per margin; the type III model of an unbalanced group
    needs only count, sum and square sum of its cells, a number that the factors bound. Groups with
    fewer subjects give no row; rows with a null factor are left out; an effect that cannot be estimated has null F.
    """
    names = [*within, subject]
    rows = cells.where(all_of([F.col(c).isNotNull() for c in [*names, response]]))
    sets = [[*keys, *s] for r in range(len(names) + 1) for s in combinations(names, r)]
    flags = F.array(*[F.grouping(n).cast("int") for n in names])
    margins = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, *names]]).agg(
        F.sum(response).alias("__s"), F.count(response).alias("__n"), flags.alias("__out"))
    margins = margins.groupBy(*keys, "__out").agg(F.sum(F.col("__s") ** 2 / F.col("__n")).alias("u"), F.count(F.lit(1)).alias("levels"), F.max("__n").alias("hi"))
    margins = margins.groupBy(*keys).agg(F.collect_list(F.struct("__out", "u", "levels", "hi")).alias("margins"))
    y = F.col(response)
    packed = rows.groupBy(*keys, *within).agg(F.count(y).alias("__n"), F.sum(y).alias("__s"), F.sum(y * y).alias("__q"))
    packed = packed.groupBy(*keys).agg(F.collect_list(F.struct(F.array(*[F.col(w).cast("string") for w in within]).alias("at"), "__n", "__s", "__q")).alias("cells"))

    def tests(rec):
        by_set = {tuple(n for n, o in zip(names, m["__out"]) if not o): m for m in rec["margins"]}
        levels = {n: by_set[(n,)]["levels"] for n in names}
        if levels[subject] < min_subjects:
            return []
        full = by_set[tuple(names)]
        if levels[subject] < 2 or full["hi"] != 1 or full["levels"] != np.prod(list(levels.values())):
            return _type_three_cells(rec["cells"], within)
        ss = lambda s: sum((-1) ** (len(s) - r) * by_set[t]["u"] for r in range(len(s) + 1) for t in combinations(s, r))
        out = []
        for r in range(1, len(within) + 1):
            for effect in combinations(within, r):
                df1 = int(np.prod([levels[e] - 1 for e in effect]))
                df2 = df1 * (levels[subject] - 1)
                err = ss((*effect, subject)) / df2 if df2 else np.nan
                f = ss(effect) / df1 / err if err > 1e-300 else np.nan
                out.append(dict(source=":".join(effect), f=float(f), num_df=float(df1), den_df=float(df2), p=float(f_sf(f, df1, df2)), method="rm"))
        return out

    return _per_group(margins.join(packed, keys), keys, "source string, f double, num_df double, den_df double, p double, method string", tests)


def _type_three_cells(cells, within: list[str]) -> list[dict]:
    """Sum-to-zero model on cell counts, sums and square sums; each effect against the model without its columns."""
    at = [list(c["at"]) for c in cells]
    weight, sums = np.array([c["__n"] for c in cells], float), np.array([c["__s"] for c in cells], float)
    coded = []
    for i in range(len(within)):
        values = sorted({a[i] for a in at})
        coded.append(np.array([[(a[i] == v) - float(a[i] == values[-1]) for v in values[:-1]] for a in at]).reshape(len(at), len(values) - 1))
    columns, owner = [np.ones(len(at))], [()]
    for r in range(1, len(within) + 1):
        for effect in combinations(range(len(within)), r):
            block = coded[effect[0]]
            for e in effect[1:]:
                block = (block[:, :, None] * coded[e][:, None, :]).reshape(len(at), -1)
            columns += list(block.T)
            owner += [effect] * block.shape[1]
    x, n, square = np.column_stack(columns), weight.sum(), sum(c["__q"] for c in cells)

    def rss(keep):
        a, b = x[:, keep].T @ (weight[:, None] * x[:, keep]), x[:, keep].T @ sums
        return square - b @ np.linalg.solve(a, b) if np.linalg.matrix_rank(a) == len(keep) else None

    whole = rss(list(range(len(owner))))
    out = []
    for effect in dict.fromkeys(owner[1:]):
        keep = [i for i, o in enumerate(owner) if o != effect]
        left = None if whole is None else rss(keep)
        df1, df2 = len(owner) - len(keep), n - len(owner)
        f = None if left is None or df2 <= 0 or whole <= 0 else float((left - whole) / df1 / (whole / df2))
        out.append(dict(source=":".join(within[i] for i in effect), f=f, num_df=float(df1), den_df=float(df2), p=None if f is None else float(f_sf(f, df1, df2)), method="ols"))
    return out
