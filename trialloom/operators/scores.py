"""Canonical scores of every row, and result tables as CSV folders that read back as they were written."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialloom.functions.joins import skew_join
from trialloom.functions.smallmath import cca, unpack
from trialloom.operators.linear import _per_group
from trialloom.operators.multivariate import _dot, _size


def cca_scores(df: DataFrame, grams: DataFrame, keys: list[str], ids: list[str], x: str, y: str, kx: int, n_components: int | None = None,
               scale: bool = True, ridge: float = 0.0) -> DataFrame:
    """(keys, ids, view, component, score): each row's standardised x and y under the weights of ``multivariate.cca_weights``.

    A group's weights are one small row (an affine map per variate), joined to its rows with salted keys; the products stay
    in the JVM. Rows with a null vector or a null entry have no scores, as they have no part in the fit; groups of fewer
    than 3 rows give none. Constant y columns add nothing.
    """
    def rows(rec):
        g = unpack(rec["gram"], _size(rec["gram"]))
        if g[0, 0] < 3:
            return []
        r = cca(g, kx, n_components, scale, ridge)
        mean = g[0, 1:] / g[0, 0]
        sd = np.sqrt(np.maximum(np.diag(g)[1:] / g[0, 0] - mean ** 2, 0))
        sd = np.where(sd > 1e-12, sd, 1.0) if scale else np.ones(len(sd))
        wy = np.zeros((len(sd) - kx, r["y_weights"].shape[1]))
        wy[r["y_kept"]] = r["y_weights"]
        out = dict()
        for view, w, part in (("x", r["x_weights"], slice(0, kx)), ("y", wy, slice(kx, None))):
            a = w / sd[part, None]
            out[f"__{view}"], out[f"__{view}0"] = [list(c) for c in a.T], list(-mean[part] @ a)
        return [out]

    maps = _per_group(grams, keys, "__x array<array<double>>, __x0 array<double>, __y array<array<double>>, __y0 array<double>", rows)
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(F.col(c), lambda v: v.isNull() | F.isnan(v))
    met = skew_join(df.where(whole(x) & whole(y)).select(*keys, *ids, F.col(x).alias("__vx"), F.col(y).alias("__vy")), maps, keys)
    view = lambda v: F.zip_with(F.transform(F.col(f"__{v}"), lambda w: _dot(F.col(f"__v{v}"), w)), F.col(f"__{v}0"), lambda s, b: s + b)
    both = met.select(*keys, *ids, F.explode(F.array(*[F.struct(F.lit(v).alias("view"), view(v).alias("s")) for v in "xy"])).alias("e"))
    long = both.select(*keys, *ids, F.col("e.view").alias("view"), F.posexplode("e.s").alias("c", "score"))
    return long.select(*keys, *ids, "view", F.concat(F.lit("CC"), F.col("c") + 1).alias("component"), "score")


CSV = {"header": True, "nullValue": "\\N", "escape": '"', "multiLine": True}


def save_results(frames: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per named result table, written by the tasks that hold its rows."""
    for name, df in frames.items():
        df.write.mode("overwrite").options(**CSV).csv(f"{folder}/{name}")


def load_results(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of ``save_results``: the same rows, nulls and empty strings apart, doubles to the last bit."""
    return {name: spark.read.options(**CSV).schema(schema).csv(f"{folder}/{name}") for name, schema in schemas.items()}
