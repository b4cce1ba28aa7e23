"""Queries by name, each beside the SQL that states its result for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle SQL."""

    def wrap(fn):
        from trialloom.plans.inputs import Tables
        from trialloom.session import ship_package

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = expand_rounding(sql)
        return fn

    return wrap


def rnd(col, digits: int = 6):
    """Rounding shared with the oracle; the offset keeps exact halves off the border."""
    from pyspark.sql import functions as F

    col = F.col(col) if isinstance(col, str) else col
    return F.round(col + F.lit(10.0 ** -(digits + 3)), digits)


def expand_rounding(sql: str) -> str:
    """Write ``rnd(expr[, digits])`` in oracle text as plain SQL."""
    while (at := sql.find("rnd(")) >= 0:
        depth, pos, cut = 1, at + 4, None
        while depth:
            ch = sql[pos]
            depth += ch in "([" 
            depth -= ch in ")]"
            if ch == "," and depth == 1:
                cut = pos
            pos += 1
        body = sql[at + 4: pos - 1]
        digits = 6
        if cut is not None:
            body, digits = sql[at + 4: cut], int(sql[cut + 1: pos - 1])
        sql = f"{sql[:at]}(round(({body}) + 1e-{digits + 3}, {digits}) + 0.0){sql[pos:]}"
    return sql


def load_all() -> None:
    import importlib
    import pkgutil

    import trialloom.plans as plans

    for mod in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"trialloom.plans.{mod.name}")
