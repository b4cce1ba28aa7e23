"""Ordered scans that never put a whole key into one task.

A plain ``Window.partitionBy(recording).orderBy(t)`` sends a recording to a
single task. Here every recording is cut into chunks of its order axis; windows
run inside (recording, chunk), and what has to cross a chunk border (row offset,
running totals, the last or next value) comes from a table with one row per
chunk. The results are exactly those of the unchunked window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK = "__chunk"


def time_chunk(t, width: float) -> Column:
    """Chunk number of a numeric time axis."""
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(width))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    *,
    index: str | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    running: dict[str, Column] | None = None,
    prev_valid: dict[str, Column] | None = None,
    next_valid: dict[str, Column] | None = None,
    total: str | None = None,
    keep_chunk: bool = False,
) -> DataFrame:
    """Row number, lag, lead, running sums and fills along ``order`` per key.

    ``chunk`` must not decrease along the order. ``index`` counts from 0;
    ``prev_valid`` / ``next_valid`` give the nearest non-null value at or before /
    at or after the row; ``total`` is the row count of the key.
    """
    lag, lead, running = lag or {}, lead or {}, running or {}
    prev_valid, next_valid = prev_valid or {}, next_valid or {}
    base = df.withColumn(CHUNK, chunk)
    ordering = F.struct(*order)

    aggs = [F.count(F.lit(1)).alias("__scan_n")]
    aggs += [F.max_by(F.col(v), ordering).alias(f"__lag_{k}") for k, v in lag.items()]
    aggs += [F.min_by(F.col(v), ordering).alias(f"__lead_{k}") for k, v in lead.items()]
    aggs += [F.sum(v).alias(f"__run_{k}") for k, v in running.items()]
    aggs += [F.max_by(v, F.when(v.isNotNull(), ordering)).alias(f"__pv_{k}") for k, v in prev_valid.items()]
    aggs += [F.min_by(v, F.when(v.isNotNull(), ordering)).alias(f"__nv_{k}") for k, v in next_valid.items()]
    per_chunk = base.groupBy(*keys, CHUNK).agg(*aggs)

    by_chunk = W.partitionBy(*keys).orderBy(CHUNK)
    before = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    after = by_chunk.rowsBetween(1, W.unboundedFollowing)
    carry = [F.col("__scan_n"), F.coalesce(F.sum("__scan_n").over(before), F.lit(0)).alias("__scan_off")]
    if total:
        carry.append(F.sum("__scan_n").over(W.partitionBy(*keys)).alias(total))
    carry += [F.lag(f"__lag_{k}").over(by_chunk).alias(f"__lag_{k}") for k in lag]
    carry += [F.lead(f"__lead_{k}").over(by_chunk).alias(f"__lead_{k}") for k in lead]
    carry += [F.coalesce(F.sum(f"__run_{k}").over(before), F.lit(0)).alias(f"__run_{k}") for k in running]
    carry += [F.last(f"__pv_{k}", True).over(before).alias(f"__pv_{k}") for k in prev_valid]
    carry += [F.first(f"__nv_{k}", True).over(after).alias(f"__nv_{k}") for k in next_valid]
    borders = per_chunk.select(*keys, CHUNK, *carry)

    inside = W.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    onward = inside.rowsBetween(0, W.unboundedFollowing)
    rn = F.col("__scan_rn")
    within, out = [F.row_number().over(inside).alias("__scan_rn")], []
    if index:
        out.append((F.col("__scan_off") + rn - 1).alias(index))
    if total:
        out.append(F.col(total))
    for k, v in lag.items():
        within.append(F.lag(v).over(inside).alias(f"__in_lag_{k}"))
        out.append(F.when(rn == 1, F.col(f"__lag_{k}")).otherwise(F.col(f"__in_lag_{k}")).alias(k))
    for k, v in lead.items():
        within.append(F.lead(v).over(inside).alias(f"__in_lead_{k}"))
        out.append(F.when(rn == F.col("__scan_n"), F.col(f"__lead_{k}")).otherwise(F.col(f"__in_lead_{k}")).alias(k))
    for k, v in running.items():
        within.append(F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"__in_run_{k}"))
        out.append((F.col(f"__in_run_{k}") + F.col(f"__run_{k}")).alias(k))
    for k, v in prev_valid.items():
        within.append(F.last(v, True).over(upto).alias(f"__in_pv_{k}"))
        out.append(F.coalesce(f"__in_pv_{k}", f"__pv_{k}").alias(k))
    for k, v in next_valid.items():
        within.append(F.first(v, True).over(onward).alias(f"__in_nv_{k}"))
        out.append(F.coalesce(f"__in_nv_{k}", f"__nv_{k}").alias(k))
    kept = [x for x in df.columns] + ([CHUNK] if keep_chunk else [])
    # the windows first: their order is also that of the join, so rows are sorted once
    return base.select("*", *within).join(borders, [*keys, CHUNK]).select(*kept, *out)
