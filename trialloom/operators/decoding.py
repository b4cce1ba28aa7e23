"""Decoding a class label from feature vectors: L1 multinomial regression, all folds and strengths at once.

Rows carry no fold. A model is a set of left-out rows (a subject, a subject and an inner fold, or nothing) and a
strength; one pass over the rows returns the gradients of all models, each row counting for the
models that do not leave it out, and a proximal step with momentum follows for all of them. So the number of
passes does not depend on the number of fits, and no row is copied. Scaling and class weights come
from sums per subject, fold and class, from which what is left out is subtracted.

Models travel to the tasks in blocks of at most BLOCK_PARAMETERS numbers; a task holds one block and as
many rows at a time as ROW_NUMBERS allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from trialloom.functions.distribution import value_counts, with_cumulative
from trialloom.session import cut_lineage

BLOCK_PARAMETERS = 4_000_000
ROW_NUMBERS = 4_000_000
#: The default grid of strengths: ten values from 1e-3 to 1e3.
STRENGTHS = [10.0 ** (-3 + 6 * i / 9) for i in range(10)]


@dataclass
class Models:
    """Left-out rows and strengths of many models. -1: no subject, no fold, no feature is left out."""

    subject: np.ndarray
    folds: np.ndarray       # number of inner folds, 0 without
    fold: np.ndarray
    strength: np.ndarray
    feature: np.ndarray
    weights: np.ndarray = None      # (models, classes, features + 1), the intercept last, for scaled features
    mean: np.ndarray = None
    scale: np.ndarray = None
    balance: np.ndarray = None      # (models, classes) weight of a row; nan where a class has no row left
    rows: np.ndarray = None
    converged: np.ndarray = None

    def __len__(self):
        return len(self.subject)

    def part(self, at: np.ndarray) -> Models:
        return Models(*(None if (v := getattr(self, f)) is None else v[at] for f in self.__dataclass_fields__))

    def plain(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights (models, classes, features) and intercepts for features as they are."""
        w = weights[:, :, :-1] / self.scale[:, None, :]
        return w, weights[:, :, -1] - np.einsum("mkd,md->mk", w, self.mean)


@dataclass
class Labelled:
    """Prepared rows (key, y, s, f2, f3, x) with the names behind y and s."""

    rows: DataFrame
    key: str
    classes: list
    subjects: list
    sums: list = field(default_factory=list)  # (s, f2, f3, y, n, sum x, sum x^2)


def prepare(df: DataFrame, key: str, label: str, subject: str | None, vector: str) -> Labelled:
    """Rows without null or NaN features, numbered classes and subjects, and places in two and three inner folds.

    Inner folds are stratified: the rows of a class are dealt in the order of their keys.
    """
    clean = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v)))
    clean = clean.select(F.col(key).alias("key"), F.col(label).alias("label"), (F.col(subject) if subject else F.lit(0)).alias("subject"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    places = with_cumulative(value_counts(clean, ["label"], "key"), ["label"], "key").select("label", "key", (F.col("cum") - F.col("n")).alias("place"))
    classes = sorted(r[0] for r in clean.select("label").distinct().collect())
    subjects = sorted(r[0] for r in clean.select("subject").distinct().collect())
    spark = df.sparkSession
    named = lambda values, col, out: spark.createDataFrame([(v, i) for i, v in enumerate(values)], StructType([clean.schema[col]]).add(out, "integer"))
    rows = clean.join(places, ["label", "key"])
    if classes:
        rows = rows.join(F.broadcast(named(classes, "label", "y")), "label").join(named(subjects, "subject", "s"), "subject")
    else:
        rows = rows.withColumn("y", F.lit(0)).withColumn("s", F.lit(0))
    rows = rows.select("key", "y", "s", (F.col("place") % 2).cast("int").alias("f2"), (F.col("place") % 3).cast("int").alias("f3"), "x")
    rows = cut_lineage(rows.repartition(spark.sparkContext.defaultParallelism, "key"))  # heavy work per row: not merged by size
    n = rows.select(F.max(F.size("x"))).first()[0] or 0
    sums = rows.groupBy("s", "f2", "f3", "y").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col("x")[i]) for i in range(n))).alias("a"), F.array(*(F.sum(F.col("x")[i] * F.col("x")[i]) for i in range(n))).alias("b"))
    return Labelled(rows, key, classes, subjects, sums.collect())  # one row per subject, class and pair of folds


def _left(models: Models, s, f2, f3) -> np.ndarray:
    """(rows, models): whether a row takes part in a model's fit."""
    out = s[:, None] != models.subject[None, :]
    for n, f in ((2, f2), (3, f3)):
        out &= ~((models.folds == n)[None, :] & (f[:, None] == models.fold[None, :]))
    return out


def _held(models: Models, s, f2, f3) -> np.ndarray:
    """(rows, models): whether a row is what a model is tested on."""
    own = s[:, None] == models.subject[None, :]
    fold = np.where((models.folds == 2)[None, :], f2[:, None], f3[:, None]) == models.fold[None, :]
    return np.where((models.folds > 0)[None, :], fold & ~own, own)


def _scaled(models: Models, data: Labelled, normalize: bool) -> None:
    """Means, scales and class weights of every model from the sums; inner folds use the scale of their outer fold."""
    s, f2, f3, y, n = (np.array([r[i] for r in data.sums], dtype=np.int64) for i in range(5))
    a, b = (np.array([r[i] for r in data.sums], dtype=np.float64).reshape(len(s), len(data.sums[0][5]) if data.sums else 0) for i in (5, 6))
    use = _left(models, s, f2, f3) * n[:, None]
    counts = np.array([use[y == k].sum(axis=0) for k in range(len(data.classes))], dtype=np.float64).reshape(len(data.classes), len(models)).T
    models.rows = counts.sum(axis=1)
    models.balance = models.rows[:, None] / (len(data.classes) * np.where(counts > 0, counts, np.nan))
    outer = (s[:, None] != models.subject[None, :]).astype(np.float64)
    total = np.maximum(outer.T @ n, 1)[:, None]
    models.mean, models.scale = outer.T @ a / total, np.ones((len(models), a.shape[1]))
    if normalize:
        spread_ = np.sqrt(np.maximum(outer.T @ b / total - models.mean**2, 0))
        models.scale = np.where(spread_ > 1e-12, spread_, 1.0)
    else:
        models.mean = np.zeros_like(models.mean)


def _choice(p: np.ndarray) -> np.ndarray:
    """The class of the largest value, the first of those equal to a thousandth (as in a model without any weight)."""
    return (p >= p.max(axis=-1, keepdims=True) - 1e-3).argmax(axis=-1)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float32)
    return x, *(batch.column(c).to_numpy() for c in ("y", "s", "f2", "f3"))


def _pieces(batches: Iterator[pa.RecordBatch], numbers_per_row: int) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    step = max(1, ROW_NUMBERS // max(1, numbers_per_row))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, _matrix(part)


def _gradients(data: Labelled, models: Models, weights: np.ndarray) -> np.ndarray:
    """(models, classes, features + 1): mean gradients, for scaled features, of all models in one pass."""
    w, b = models.plain(weights)
    m, k, d = w.shape
    parts = min(m, 32)
    held = data.rows.sparkSession.sparkContext.broadcast((models.part(np.arange(m)), w.reshape(m * k, d).astype(np.float32), b.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, w, b = held.value
        total, some = np.zeros((m * k, d + 1)), False
        for _, (x, y, s, f2, f3) in _pieces(batches, m * k):
            p = (x @ w.T).reshape(len(x), m, k) + b
            p -= p.max(axis=2, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=2, keepdims=True)
            p[np.arange(len(x)), :, y] -= 1
            p *= (_left(mine, s, f2, f3) * mine.balance[:, y].T).astype(np.float32)[:, :, None]
            p = p.reshape(len(x), m * k)
            total[:, :d] += p.T @ x
            total[:, d] += p.sum(axis=0)
            some = True
        if some:
            cuts = np.array_split(total.reshape(m, -1), parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), pa.array([c.ravel() for c in cuts], pa.list_(pa.float64()))], names=["part", "g"])

    def added(rows: pa.Table) -> pa.Table:
        g = rows.column("g").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(axis=0)
        return pa.Table.from_arrays([rows.column("part").slice(0, 1), pa.array([g], pa.list_(pa.float64()))], names=["part", "g"])

    found = data.rows.mapInArrow(run, "part long, g array<double>").groupBy("part").applyInArrow(added, "part long, g array<double>").collect()  # one block of models in all
    held.unpersist()
    out = np.zeros((m, k, d + 1))
    if found:
        out[:] = np.concatenate([np.array(r.g) for r in sorted(found, key=lambda r: r.part)]).reshape(m, k, d + 1)
    out[:, :, :d] = (out[:, :, :d] - models.mean[:, None, :] * out[:, :, d:]) / models.scale[:, None, :]
    return out / models.rows[:, None, None]


def _largest_share(data: Labelled, models: Models) -> float:
    """Largest eigenvalue of the mean square of the scaled rows with an intercept; bounds the curvature of all models."""
    mean, scale = models.mean.mean(axis=0), models.scale.mean(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean) + 1, len(mean) + 1))
        for batch in batches:
            z = np.column_stack([(_matrix(batch)[0] - mean) / scale, np.ones(batch.num_rows)])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    rows = data.rows.mapInArrow(run, "i long, v array<double>").groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(len(mean) + 1))).collect()
    total = np.array([list(r)[1:] for r in sorted(rows, key=lambda r: r.i)])
    return float(np.linalg.eigvalsh(total)[-1] / max(total[-1, -1], 1))


def fit_models(data: Labelled, models: Models, normalize: bool = True, max_steps: int = 150, tol: float = 1e-3) -> Models:
    """Fit all models: minimise mean balanced log loss + |weights| / (strength * rows), the intercept free.

    Steps of FISTA with restarts; a model is done when no weight moves by more than ``tol`` (relative to
    its largest). ``converged`` is false where ``max_steps`` came first; models that lack a class are not fitted.
    """
    _scaled(models, data, normalize)
    m, k, d = len(models), len(data.classes), models.mean.shape[1]
    models.weights, models.converged = np.zeros((m, k, d + 1)), np.zeros(m, dtype=bool)
    able = np.flatnonzero(np.isfinite(models.balance).all(axis=1)) if m else np.zeros(0, np.int64)
    if not len(able) or k < 2:
        return models
    share = _largest_share(data, models)
    size = max(1, BLOCK_PARAMETERS // (k * (d + 1)))
    for at in range(0, len(able), size):
        _descend(data, models, able[at:at + size], share, max_steps, tol)
    return models


def _descend(data: Labelled, models: Models, block: np.ndarray, share: float, max_steps: int, tol: float) -> None:
    at, part = block, models.part(block)
    w = part.weights
    v, t = w.copy(), np.ones(len(at))
    for _ in range(max_steps):
        # half the mean square bounds the curvature of the loss; subsets and weights may exceed the whole
        step = 1 / (0.5 * 1.3 * share * np.nanmax(part.balance, axis=1))
        free = np.ones(v.shape, dtype=bool)
        free[:, :, -1] = False
        dropped = np.flatnonzero(part.feature >= 0)
        moved = v - step[:, None, None] * _gradients(data, part, v)
        least = (step / (part.strength * part.rows))[:, None, None]
        new = np.where(free, np.sign(moved) * np.maximum(np.abs(moved) - least, 0), moved)
        new[dropped, :, part.feature[dropped]] = 0.0
        restart = ((v - new) * (new - w)).sum(axis=(1, 2)) > 0
        t = np.where(restart, 1.0, t)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = np.where(restart, 0.0, (t - 1) / t_new)
        change = np.abs(new - w).max(axis=(1, 2)) / np.maximum(1, np.abs(new).max(axis=(1, 2)))
        v = new + pull[:, None, None] * (new - w)
        w, t = new, t_new
        done = change < tol
        models.weights[at], models.converged[at] = w, done
        if done.all():
            return
        if done.any():
            at, part, w, v, t = at[~done], part.part(~done), w[~done], v[~done], t[~done]


def _grid(subjects: int, folds: list[int], strengths: list[float]) -> Models:
    """Per subject: an outer model for every strength and one for every inner fold and strength; folds 0 has no inner ones."""
    spec = [(s, 0, -1, c) for s in range(subjects) for c in strengths]
    if len(strengths) > 1:
        spec += [(s, folds[s], f, c) for s in range(subjects) for f in range(folds[s]) for c in strengths]
    cols = list(zip(*spec)) or [()] * 4
    return Models(*(np.array(c, dtype=np.int64) for c in cols[:3]), np.array(cols[3], dtype=np.float64), np.full(len(spec), -1))


def _hits(data: Labelled, models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Correct and all rows among those that each model is tested on."""
    w, b = models.plain(models.weights)
    m, k, d = w.shape
    right, seen = np.zeros(m), np.zeros(m)
    size = max(1, BLOCK_PARAMETERS // max(1, k * (d + 1)))
    for lo in range(0, m, size):
        part = models.part(np.arange(lo, min(m, lo + size)))
        held = data.rows.sparkSession.sparkContext.broadcast((part, w[lo:lo + size].reshape(-1, d).astype(np.float32), b[lo:lo + size].astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            mine, w, b = held.value
            right, seen = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
            for _, (x, y, s, f2, f3) in _pieces(batches, len(w)):
                p = _choice((x @ w.T).reshape(len(x), len(mine), -1) + b)
                use = _held(mine, s, f2, f3)
                right += (use & (p == y[:, None])).sum(axis=0)
                seen += use.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mine))), pa.array(right), pa.array(seen)], names=["m", "a", "n"])

        for r in data.rows.mapInArrow(run, "m long, a long, n long").groupBy("m").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).collect():
            right[lo + r.m], seen[lo + r.m] = r.a, r.n
    return right, seen


def decode_label(df: DataFrame, key: str, label: str, subject: str, vector: str, c_values: list[float] | None = None, normalize: bool = True,
                 max_steps: int = 150, tol: float = 1e-3) -> tuple[DataFrame, float]:
    """(key, label, subject, predicted, strength, converged) of every row by models of the other subjects, and the median strength.

    One outer fold per subject. With several strengths the one of the best mean accuracy over the inner folds is
    taken, the smallest of equals; there are max(2, min(3, smallest class)) stratified inner folds. A
    fold whose other rows lack a class gives no prediction (null). Rows with null or NaN features are left out.
    Without two classes no row gets a prediction.
    """
    data = prepare(df, key, label, subject, vector)
    strengths = sorted(c_values or STRENGTHS)
    n_classes, n_subjects = len(data.classes), len(data.subjects)
    counts = np.zeros((n_subjects, n_classes), dtype=np.int64)
    for r in data.sums:
        counts[r[0], r[3]] += r[4]
    least = (counts.sum(axis=0) - counts).min(axis=1) if n_classes else np.zeros(0, np.int64)
    models = fit_models(data, _grid(n_subjects, [max(2, min(3, int(n))) for n in least], strengths), normalize, max_steps, tol)
    chosen = np.full(n_subjects, np.nan)
    whole = np.isfinite(models.balance).all(axis=1) if len(models) else np.zeros(0, bool)
    if len(strengths) > 1 and len(models):
        right, seen = _hits(data, models)
        rate = np.where(whole & (seen > 0), right / np.maximum(seen, 1), np.nan)
        for s in range(n_subjects):
            mine = (models.subject == s) & (models.folds > 0)
            score = [np.nanmean(r) if np.isfinite(r := rate[mine & (models.strength == c)]).any() else -1.0 for c in strengths]
            chosen[s] = strengths[int(np.argmax(score))]
    else:
        chosen[:] = strengths[0]
    final = np.array([np.flatnonzero((models.subject == s) & (models.folds == 0) & (models.strength == chosen[s]))[0] for s in range(n_subjects)], dtype=np.int64)
    able = whole[final] if n_subjects else np.zeros(0, bool)
    best = models.part(final)
    w, b = best.plain(best.weights) if n_subjects else (np.zeros((0, 0, 0)), np.zeros((0, 0)))
    held = df.sparkSession.sparkContext.broadcast((w, b, able & (n_classes > 1), chosen, best.converged))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, able, chosen, converged = held.value
        for batch in batches:
            x, y, s, _, _ = _matrix(batch)
            p = np.array([_choice(w[i] @ row + b[i]) for i, row in zip(s, x)], dtype=np.int64) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), batch.column("s"), pa.array(p, pa.int32(), mask=~able[s]), pa.array(chosen[s], mask=~able[s]), pa.array(converged[s], mask=~able[s])],
                                             names=["key", "y", "s", "p", "strength", "converged"])

    schema = StructType([data.rows.schema["key"]]).add("y", "integer").add("s", "integer").add("p", "integer").add("strength", "double").add("converged", "boolean")
    made = data.rows.mapInArrow(run, schema)
    spark, kind = df.sparkSession, lambda c: df.schema[c].dataType
    names = lambda values, col, n, out: F.broadcast(spark.createDataFrame([(i, v) for i, v in enumerate(values)], StructType().add(n, "integer").add(out, kind(col))))
    made = made.join(names(data.classes, label, "y", "__label"), "y").join(names(data.subjects, subject, "s", "__subject"), "s").join(names(data.classes, label, "p", "predicted"), "p", "left")
    out = made.select(F.col("key").alias(key), F.col("__label").alias(label), F.col("__subject").alias(subject), "predicted", "strength", "converged")
    return out, float(np.median(chosen[able])) if able.any() else 1.0


def decoding_scores(predictions: DataFrame, label: str) -> DataFrame:
    """Recall per class, with accuracy and balanced accuracy on every row; rows without a prediction do not count."""
    hit = (F.col("predicted") == F.col(label)).cast("double")
    per = predictions.where("predicted IS NOT NULL").groupBy(label).agg(F.avg(hit).alias("recall"), F.count(F.lit(1)).alias("n"))
    total = per.agg((F.sum(F.col("recall") * F.col("n")) / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"))
    return per.crossJoin(F.broadcast(total))


def confusion(predictions: DataFrame, label: str) -> DataFrame:
    return predictions.where("predicted IS NOT NULL").groupBy(label, "predicted").agg(F.count(F.lit(1)).alias("n"))


def decoding_coefficients(df: DataFrame, label: str, vector: str, key: str, c_value: float, normalize: bool = True, max_steps: int = 150) -> DataFrame:
    """(class, feature, coef, converged) of the fit on all rows, for scaled features."""
    data = prepare(df, key, label, None, vector)
    model = fit_models(data, Models(*(np.array([x], dtype=np.int64) for x in (-1, 0, -1)), np.array([c_value]), np.array([-1])), normalize, max_steps)
    rows = [(c, j, float(model.weights[0, i, j]), bool(model.converged[0])) for i, c in enumerate(data.classes) for j in range(model.weights.shape[2] - 1)]
    return df.sparkSession.createDataFrame(rows, StructType().add("class", df.schema[label].dataType).add("feature", "integer").add("coef", "double").add("converged", "boolean"))


def unique_contribution(df: DataFrame, label: str, vector: str, features: list[int] | None, c_value: float, key: str, normalize: bool = True, max_steps: int = 150) -> DataFrame:
    """Balanced accuracy of the fit on all rows minus that without each feature; all features unless named."""
    data = prepare(df, key, label, None, vector)
    n = len(data.sums[0][5]) if data.sums else 0
    features = list(range(n)) if features is None else features
    m = 1 + len(features)
    models = fit_models(data, Models(*(np.full(m, x) for x in (-1, 0, -1)), np.full(m, float(c_value)), np.array([-1, *features])), normalize, max_steps)
    w, b = models.plain(models.weights)
    held = df.sparkSession.sparkContext.broadcast((w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = held.value
        right, seen = np.zeros((w.shape[1], len(w)), np.int64), np.zeros(w.shape[1], np.int64)
        flat = w.reshape(-1, w.shape[2]).astype(np.float32)
        for _, (x, y, *_) in _pieces(batches, len(flat)):
            p = _choice((x @ flat.T).reshape(len(x), *b.shape) + b)
            np.add.at(right, y, p == y[:, None])
            np.add.at(seen, y, 1)
        for k in np.flatnonzero(seen):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), k)), pa.array(np.arange(len(w))), pa.array(right[k]), pa.array(np.full(len(w), seen[k]))], names=["y", "m", "a", "n"])

    per = data.rows.mapInArrow(run, "y long, m long, a long, n long").groupBy("y", "m").agg((F.sum("a") / F.sum("n")).alias("recall")).groupBy("m").agg(F.avg("recall").alias("r"))
    score = {r.m: r.r for r in per.collect()}
    rows = [(f, score[0], score[i], score[0] - score[i], bool(models.converged[0] and models.converged[i])) for i, f in enumerate(features, 1)] if score else []
    return df.sparkSession.createDataFrame(rows, "feature int, full_accuracy double, reduced_accuracy double, delta double, converged boolean")
