"""Event-locked windows on long signals and what is computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from trialloom.constants import BASELINE_WINDOW, EARLY_WINDOW
from trialloom.functions.distribution import grouped_quantiles
from trialloom.functions.scan import ordered_scan, time_chunk

BLOCK = 64


def sampling_rates(signal: DataFrame, keys: list[str], t: str, chunk_width: float, step: str | None = None) -> DataFrame:
    """fs = round(1 / median interval) per key, exact and without gathering a key.

    ``step`` names a column that already holds the interval to the next sample.
    """
    if step is None:
        steps = ordered_scan(signal.select(*keys, t), keys, [t], time_chunk(t, chunk_width), lead={"__next": t})
        steps = steps.select(*keys, (F.col("__next") - F.col(t)).alias("__dt"))
    else:
        steps = signal.select(*keys, F.col(step).alias("__dt"))
    med = grouped_quantiles(steps, keys, "__dt", {"dt": 0.5})
    return med.select(*keys, F.bround(1 / F.col("dt")).cast("long").alias("fs"))


def windows_at_index(
    samples: DataFrame, anchors: DataFrame, keys: list[str], idx: str, values: list[str],
    anchor: str, lo: str, hi: str,
) -> DataFrame:
    """Rows ``offset`` = lo..hi around each anchor index, with the sample values.

    Samples travel as blocks of 64 (an array per block), so an anchor needs a couple
    of joined rows instead of one per offset. Indices past the ends take the end
    sample. A null anchor keeps its rows, with null values.
    """
    blocks = (
        samples.groupBy(*keys, F.floor(F.col(idx) / BLOCK).alias("__b"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), *values))).alias("__s"))
    )
    last = samples.groupBy(*keys).agg(F.max(idx).alias("__last"))
    a, lo_c, hi_c = F.col(anchor), F.col(lo), F.col(hi)
    clip = lambda x: F.least(F.greatest(x, F.lit(0).cast("long")), F.col("__last"))
    spread = (
        anchors.join(last, keys, "left")
        .withColumn("__b0", F.floor(clip(a + lo_c) / BLOCK))
        .withColumn("__b1", F.floor(clip(a + hi_c) / BLOCK))
        .withColumn("__b", F.explode(F.when(a.isNull() | F.col("__last").isNull(), F.array(F.lit(-1).cast("long")))
                                     .otherwise(F.sequence("__b0", "__b1"))))
        .withColumn("__o0", F.when((F.col("__b") < 0) | (F.col("__b") == F.col("__b0")), lo_c)
                    .otherwise(F.col("__b") * BLOCK - a))
        .withColumn("__o1", F.when((F.col("__b") < 0) | (F.col("__b") == F.col("__b1")), hi_c)
                    .otherwise(F.col("__b") * BLOCK + (BLOCK - 1) - a))
    )
    # idx is dense, so the position inside the block is idx % 64.
    joined = spread.join(blocks, [*keys, "__b"], "left").withColumn(
        "offset", F.explode(F.sequence("__o0", "__o1"))
    )
    hit = F.get("__s", (clip(a + F.col("offset")) % BLOCK).cast("int"))
    return joined.select(
        *anchors.columns, "offset", *[hit[v].alias(v) for v in values]
    )


def find_anchors(samples: DataFrame, events: DataFrame, keys: list[str], t: str, idx: str, event_time: str,
                 chunk_width: float, anchor: str = "anchor") -> DataFrame:
    """First sample at or after each event (forward as-of join by one ordered scan)."""
    ev = events.withColumn("__row", F.struct(*events.columns)).select(
        *keys, F.col(event_time).alias("__t"), F.lit(0).alias("__is"), F.lit(None).cast("long").alias("__i"), "__row")
    sm = samples.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__is"), F.col(idx).cast("long").alias("__i"))
    both = ev.where(F.col("__t").isNotNull()).unionByName(sm, allowMissingColumns=True)
    scanned = ordered_scan(both, keys, ["__t", "__is", "__i"], time_chunk("__t", chunk_width),
                           next_valid={anchor: F.col("__i")})
    found = scanned.where(F.col("__is") == 0).select("__row.*", anchor)
    missing = events.where(F.col(event_time).isNull()).withColumn(anchor, F.lit(None).cast("long"))
    return found.unionByName(missing)


def event_windows(
    samples: DataFrame, events: DataFrame, *, keys: list[str], t: str, idx: str, value: str, event_time: str,
    t0: float, t1: float, rates: DataFrame, chunk_width: float, end_time: str | None = None,
) -> DataFrame:
    """Samples in [event + t0, event + t1) on the recording's own grid, one row per offset.

    An event is valid when the whole window lies inside the recording; otherwise (or
    when its time is null) its rows exist with null values. With ``end_time`` the
    window length of a recording is its longest event and samples past an event's
    own end are null; a null end keeps the full window.
    """
    bounds = samples.groupBy(*keys).agg(F.min(t).alias("__tmin"), F.max(t).alias("__tmax"))
    found = find_anchors(samples, events, keys, t, idx, event_time, chunk_width)
    et = F.col(event_time)
    if end_time is None:
        upper = F.lit(float(t1))
    else:
        longest = events.groupBy(*keys).agg(F.max(F.col(end_time) - et).alias("__len"))
        found = found.join(longest, keys, "left").withColumn("__len", F.coalesce("__len", F.lit(abs(float(t0)))))
        upper = F.col("__len")
    placed = found.join(rates, keys, "left").join(bounds, keys, "left").withColumn(
        "anchor",
        F.when((et + F.lit(float(t0)) >= F.col("__tmin")) & (et + upper <= F.col("__tmax")), F.col("anchor")),
    ).withColumn("__lo", F.bround(F.lit(float(t0)) * F.col("fs")).cast("long")).withColumn(
        "__hi", F.bround(upper * F.col("fs")).cast("long") - 1
    ).where(F.col("fs").isNotNull() & (F.col("__hi") >= F.col("__lo")))
    rows = windows_at_index(
        samples.select(*keys, F.col(idx).alias("__idx"), F.col(value).alias("__v")),
        placed, keys, "__idx", ["__v"], "anchor", "__lo", "__hi",
    )
    time = F.col("offset") / F.col("fs")
    v = F.col("__v")
    if end_time is not None:
        v = F.when(F.col(end_time).isNull() | (time <= F.col(end_time) - et), v)
    return rows.select(*events.columns, "offset", time.alias("time"), v.alias("response"))


def unpivot_events(trials: DataFrame, ids: list[str], events: list[str]) -> DataFrame:
    """One row per (trial, event) from one column per event."""
    return trials.unpivot(ids, events, "event", "event_time")


def response_magnitude(rows: DataFrame, keys: list[str], window=EARLY_WINDOW, *, time: str = "time",
                       value: str = "response", out: str = "response") -> DataFrame:
    """Mean of the non-null samples with start <= time < end; null when all are null."""
    inside = (F.col(time) >= window[0]) & (F.col(time) < window[1])
    return rows.groupBy(*keys).agg(F.avg(F.when(inside, F.col(value))).alias(out))


def subtract_baseline(rows: DataFrame, keys: list[str], window=BASELINE_WINDOW, *, time: str = "time",
                      value: str = "response") -> DataFrame:
    """Subtract the mean over the baseline window of each (recording, event, trial)."""
    base = F.avg(F.when((F.col(time) >= window[0]) & (F.col(time) < window[1]), F.col(value))).over(W.partitionBy(*keys))
    return rows.withColumn(value, F.col(value) - base)


def normalize_responses(rows: DataFrame, keys: list[str], window=BASELINE_WINDOW, divide: bool = True, *,
                        time: str = "time", value: str = "response") -> DataFrame:
    """Subtract (and divide by) the baseline mean; one null baseline sample nulls the trial."""
    inside = (F.col(time) >= window[0]) & (F.col(time) < window[1])
    w = W.partitionBy(*keys)
    complete = F.count(F.when(inside, F.col(value))).over(w) == F.count(F.when(inside, F.lit(1))).over(w)
    base = F.when(complete, F.avg(F.when(inside, F.col(value))).over(w))
    res = F.col(value) - base
    return rows.withColumn(value, res / F.nullif(base, F.lit(0.0)) if divide else res)


def mask_subsequent_events(rows: DataFrame, event_order: list[str], *, event: str = "event", time: str = "time",
                           value: str = "response") -> DataFrame:
    """Null the samples later than the next event; ``rows`` carries the event time columns.

    Only consecutive pairs of ``event_order`` count; a null gap masks nothing.
    """
    masked = F.col(value)
    for now, after in zip(event_order, event_order[1:]):
        gap = F.col(after) - F.col(now)
        masked = F.when((F.col(event) == now) & gap.isNotNull() & (F.col(time) > gap), F.lit(None)).otherwise(masked)
    return rows.withColumn(value, masked)


def response_traces(rows: DataFrame, keys: list[str], event_order: list[str], baseline=BASELINE_WINDOW) -> DataFrame:
    """Mask by the next event, then subtract the baseline: the traces models start from."""
    return subtract_baseline(mask_subsequent_events(rows, event_order), keys, baseline)


def window_delta(
    rows: DataFrame, keys: list[str], response_window, baseline_window, min_valid: int, *, time: str = "time",
    value: str = "response", baseline_value: str | None = None, out: str = "delta",
) -> DataFrame:
    """Mean after minus mean before, null when a window holds fewer than ``min_valid`` samples."""
    def guarded(win, col):
        v = F.when((F.col(time) >= win[0]) & (F.col(time) < win[1]), F.col(col))
        return F.when(F.count(v) >= min_valid, F.avg(v))

    return rows.groupBy(*keys).agg(
        (guarded(response_window, value) - guarded(baseline_window, baseline_value or value)).alias(out)
    )


def peak_velocity(rows: DataFrame, keys: list[str], value: str, out: str = "peak_velocity") -> DataFrame:
    """Largest absolute velocity per trial over the non-null samples."""
    return rows.groupBy(*keys).agg(F.max(F.abs(F.col(value))).alias(out))


def mean_traces(rows: DataFrame, keys: list[str], trial_keys: list[str], *, offset: str = "offset", time: str = "time",
                value: str = "response") -> DataFrame:
    """Mean trace per cell; ``n_trials`` counts trials whose first sample is non-null.

    One aggregate over the rows: a trial (``trial_keys``) has one row per offset, so its samples count once.
    """
    cells = rows.groupBy(*keys, time).agg(F.avg(value).alias(value), F.min(offset).alias("__o"), F.count(value).alias("__n"))
    of_cell = W.partitionBy(*keys)  # as many rows as a window has offsets
    cells = cells.withColumn("__first", F.min("__o").over(of_cell))
    counted = F.sum(F.when(F.col("__o") == F.col("__first"), F.col("__n")).otherwise(0)).over(of_cell)
    return cells.withColumn("n_trials", counted).drop("__o", "__n", "__first")


def session_panels(rows: DataFrame, keys: list[str], allowed: DataFrame, session: str = "eid", *, time: str = "time",
                   value: str = "response") -> DataFrame:
    """Trial-mean trace per channel for the sessions that hold traces."""
    return rows.join(allowed.select(session).distinct(), session, "left_semi").groupBy(*keys, time).agg(
        F.avg(value).alias(value))
