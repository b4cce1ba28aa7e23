"""User functions over a session's catalog row and all its tables, streamed in pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from trialloom.constants import ERROR_COLUMNS
from trialloom.operators.rules import log_entry
from trialloom.session import cut_lineage


def process_session_tables(
    sessions: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], fn: Callable[[dict, Iterator[tuple[str, pd.DataFrame]]], dict],
    schema: str, key: str = "eid", strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Apply ``fn(session row, parts) -> result row`` to every session with its trials, signals or results.

    ``tables`` maps a name to (rows with ``key``, columns that order them). ``parts`` yields (name, frame):
    the tables in the given order, each as consecutive pieces of one Arrow batch or less, so a session of any
    length passes through a task without being held there; a piece never holds rows of two tables. The function may
    stop reading early. One row per different ``key`` of ``sessions`` (of repeated ones the first met); an exception becomes an
    error row and a null result, or stops the job when ``strict``. A session without rows in a table gets no piece of
    it; rows without a catalog row, and null keys, are left out. Returns (results, error log).
    """
    fields = [p.split()[0] for p in schema.split(", ")]
    labels = list(tables)
    frames = [(sessions, [])] + list(tables.values())
    types = [f"struct<{', '.join(f'`{n}`:{d}' for n, d in df.dtypes)}>" for df, _ in frames]

    def tagged(i: int) -> DataFrame:
        df = frames[i][0].where(F.col(key).isNotNull())
        own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.select(F.col(key).alias("__key"), F.lit(i).alias("__tag"), *[(own if j == i else F.lit(None)).cast(t).alias(f"__{j}") for j, t in enumerate(types)])

    rows = tagged(0)
    for i in range(1, len(frames)):
        rows = rows.unionByName(tagged(i))
    order = [f"__{i}.`{c}`" for i, (_, by) in enumerate(frames) for c in by]
    placed = rows.repartition("__key").sortWithinPartitions("__key", "__tag", *order)
    kind = dict(sessions.dtypes)[key]
    full = f"{key} {kind}, {schema}, " + ", ".join(f"{c} string" for c in ERROR_COLUMNS[1:])
    arrow = to_arrow_schema(sessions.sparkSession.createDataFrame([], full).schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).dictionary_encode()
            at, tag = ids.indices.to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (tag[1:] != tag[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield ids.dictionary[int(at[a])].as_py(), int(tag[a]), batch.column(2 + int(tag[a])).slice(a, b - a)

    def frame(column: pa.StructArray) -> pd.DataFrame:
        return pa.RecordBatch.from_arrays(column.flatten(), names=[f.name for f in column.type]).to_pandas()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for value, own in groupby(pieces(batches), key=lambda p: p[0]):
            _, tag, first = next(own)
            if tag:
                continue
            session = first[0].as_py()
            try:
                result = {**dict.fromkeys(ERROR_COLUMNS), **fn(session, ((labels[t - 1], frame(c)) for _, t, c in own if t))}
            except Exception as e:
                if strict:
                    raise
                result = log_entry(None, e)
            out.append({**{f: result.get(f) for f in [*fields, *ERROR_COLUMNS[1:]]}, key: value})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    both = cut_lineage(placed.mapInArrow(run, full))
    return both.select(key, *fields), both.where(F.col("error_type").isNotNull()).select(key, *ERROR_COLUMNS[1:])
