"""Runs, ranks, scaling, duplicates and best rows: operators that depend on order or peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialloom.constants import MIN_BLOCK_LENGTH
from trialloom.functions.columns import safe_div
from trialloom.functions.distribution import grouped_quantiles, value_counts, with_cumulative
from trialloom.functions.joins import interval_join, skew_join
from trialloom.functions.scan import ordered_scan


def block_lengths(trials: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str) -> DataFrame:
    """Runs of equal consecutive values: (keys, value, start, length).

    Only the rows that open a run go on to the second, much smaller scan.
    """
    s = ordered_scan(trials, keys, order, chunk, index="start", lag={"__prev": value}, total="__n")
    opens = s.where((F.col("start") == 0) | ~F.col(value).eqNullSafe(F.col("__prev")))
    opens = opens.select(*keys, F.col(value), "start", "__n")
    nxt = ordered_scan(opens, keys, ["start"], F.floor(F.col("start") / 65536), lead={"__next": "start"})
    return nxt.select(*keys, value, "start", (F.coalesce("__next", "__n") - F.col("start")).alias("length"))


def block_structure(blocks: DataFrame, keys: list[str], min_length: int = MIN_BLOCK_LENGTH) -> DataFrame:
    """Shortest block, block count, and whether a block other than the last is too short."""
    a = blocks.groupBy(*keys).agg(
        F.min("length").alias("min_block_length"), F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(F.col("length") < min_length).alias("__short"), F.max_by("length", "start").alias("__last"))
    spared = F.when((F.col("n_blocks") > 1) & (F.col("__last") < min_length), 1).otherwise(0)
    return a.select(*keys, "min_block_length", "n_blocks", (F.col("__short") - spared > 0).alias("flagged"))


def training_blocks_valid(trials: DataFrame, keys: list[str], value: str = "probabilityLeft") -> DataFrame:
    """Training sessions must have one probability, 0.5, on every trial."""
    return trials.groupBy(*keys).agg(F.bool_and(F.abs(F.col(value) - 0.5) < 1e-9).alias("valid"))


def rebuild_probability(trials: DataFrame, plans: DataFrame, keys: list[str], trial: str, position: str,
                        lengths: str, candidates: list[float], width: float = 4096.0) -> DataFrame:
    """Block probability per trial from planned lengths and stimulus positions.

    The share of left (smallest) positions in a planned block snaps to the nearest
    candidate, the first one among ties.
    """
    n = F.size(lengths)
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    spans = plans.where(n > 0).select(*keys, F.posexplode(F.arrays_zip(F.col(lengths).alias("len"), ends.alias("end"))).alias("block", "z"))
    spans = spans.select(*keys, "block", (F.col("z.end") - F.col("z.len")).alias("__s"), (F.col("z.end") - 1).alias("__e"))
    inside = interval_join(trials, spans, keys, trial, "__s", "__e", width)
    left = trials.groupBy(*keys).agg(F.min(position).alias("__left"))
    share = skew_join(inside, left, keys).groupBy(*keys, "block").agg(F.avg((F.col(position) == F.col("__left")).cast("double")).alias("__share"))
    options = F.array(*[F.struct(F.abs(F.lit(c) - F.col("__share")).alias("d"), F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(candidates)])
    prob = share.select(*keys, "block", F.array_min(options)["c"].alias("rebuilt"))
    return skew_join(inside.drop("__s", "__e"), prob, [*keys, "block"])


def block_match(rebuilt: DataFrame, keys: list[str], recorded: str = "probabilityLeft") -> DataFrame:
    return rebuilt.groupBy(*keys).agg(F.bool_and(F.abs(F.col(recorded) - F.col("rebuilt")) < 1e-9).alias("matches"))


def resolve_duplicates(sessions: DataFrame, keys: list[str], bad: Column, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """One session per group: the first without a disqualifying error, else the first.

    Returns the kept rows and, per group with several good ones, one TrueDuplicateSession log row under the
    group's first session.
    Rows with a null key leave, as they do in a pandas grouping. No window: the best row is an aggregate.
    """
    rows = sessions.where(~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).withColumn("__bad", F.coalesce(bad, F.lit(False)))
    best = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*sessions.columns), F.struct("__bad", *order)).alias("s"), F.min_by("eid", F.struct(*order)).alias("first"), F.count_if(~F.col("__bad")).alias("__good"))
    log = best.where("__good > 1").select(F.col("first").alias("eid"), F.lit("TrueDuplicateSession").alias("error_type"),
                                          F.concat(F.col("__good").cast("string"), F.lit(" sessions without errors")).alias("error_message"))
    return best.select("s.*"), log


def trial_type_order(trials: DataFrame, keys: list[str], trial: str, correct: str, contrast: str, out: str = "position") -> DataFrame:
    """Heat-map order: incorrect before correct, then falling contrast, then trial number."""
    t = trials.withColumn("__neg", -F.col(contrast))
    chunk = F.struct(F.col(correct), F.col("__neg"), F.floor(F.col(trial) / 65536))
    return ordered_scan(t, keys, [correct, "__neg", trial], chunk, index=out).drop("__neg")


def snippet_window(trials: DataFrame, keys: list[str], stim: str, feedback: str, duration: float = 60.0,
                   step: float = 10.0, min_trials: int = 8, slack: float = 30.0) -> DataFrame:
    """Window of fixed length with most completed trials, scanning in steps from the first stimulus.

    Every trial votes for the few windows that hold it; sessions without a good window start at
    their first stimulus.
    """
    span = trials.groupBy(*keys).agg(F.min(stim).alias("__t0"), F.max(stim).alias("__t1"))
    t = skew_join(trials.where(F.col(stim).isNotNull()), span, keys)
    rel = F.col(stim) - F.col("__t0")
    last = F.floor((F.col("__t1") + slack - duration - F.col("__t0")) / step)
    first = F.greatest(F.ceil((rel - duration) / step), F.lit(0).cast("long"))
    upto = F.least(F.floor(rel / step), last)
    votes = t.withColumns({"__a": first, "__b": upto}).where("__b >= __a").withColumn("__k", F.explode(F.sequence("__a", "__b")))
    counted = votes.groupBy(*keys, "__k").agg(F.count(feedback).alias("__n")).where(F.col("__n") >= min_trials)
    best = counted.groupBy(*keys).agg(F.max_by("__k", F.struct("__n", -F.col("__k"))).alias("__k"), F.max("__n").alias("n_trials"))
    j = span.join(best, keys, "left")
    start = F.col("__t0") + F.coalesce(F.col("__k") * step, F.lit(0.0))
    return j.select(*keys, start.alias("t_start"), (start + duration).alias("t_end"), F.coalesce("n_trials", F.lit(0)).alias("n_trials"))


def min_max_scale(df: DataFrame, keys: list[str], value: str, constant: float | None = None, out: str | None = None) -> DataFrame:
    """(v - min) / (max - min) inside a group; a constant group becomes ``constant``."""
    r = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    j = skew_join(df, r, keys)
    scaled = F.when(F.col("__hi") == F.col("__lo"), F.lit(constant).cast("double")).otherwise(
        safe_div(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")))
    return j.withColumn(out or value, F.when(F.col(value).isNotNull(), scaled)).drop("__lo", "__hi")


def z_score(df: DataFrame, keys: list[str], value: str, out: str, sample: bool) -> DataFrame:
    """z-score inside a group with the sample (ddof 1) or population sd."""
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    m = df.groupBy(*keys).agg(F.avg(value).alias("__m"), sd.alias("__sd"))
    return skew_join(df, m, keys).withColumn(out, safe_div(F.col(value) - F.col("__m"), "__sd")).drop("__m", "__sd")


def baseline_coding(trials: DataFrame, session: str, contrast: str, rt: str, baseline: str) -> DataFrame:
    """Log reaction time z-scored within (session, contrast); baseline z-scored within the session."""
    t = trials.withColumn("log_rt", F.when(F.col(rt) > 0, F.ln(F.when(F.col(rt) > 0, F.col(rt)))))
    return z_score(z_score(t, [session, contrast], "log_rt", "rt_z", True), [session], baseline, "baseline_z", False)


def iqr_outliers(df: DataFrame, keys: list[str], value: str, factor: float = 1.5, min_n: int = 10, log: bool = False) -> DataFrame:
    """Flag values beyond the quartiles by ``factor`` ranges, in groups of at least ``min_n`` values."""
    d = df.withColumn(value, F.when(F.col(value) > 0, F.ln(F.when(F.col(value) > 0, F.col(value))))) if log else df
    d = d.where(F.col(value).isNotNull())
    q = grouped_quantiles(d, keys, value, {"__q1": 0.25, "__q3": 0.75})
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    j = skew_join(d, q.join(n, keys), keys)
    reach = factor * (F.col("__q3") - F.col("__q1"))
    out = (F.col("__n") >= min_n) & ((F.col(value) < F.col("__q1") - reach) | (F.col(value) > F.col("__q3") + reach))
    return j.withColumn("is_outlier", out).drop("__q1", "__q3", "__n")


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Empirical distribution: share of rows at or below each distinct value."""
    cum = with_cumulative(value_counts(df, keys, value), keys, value)
    return cum.select(*keys, value, "n", (F.col("cum") / F.col("total")).alias("cdf"))


def best_session(recordings: DataFrame, performance: str, passes: Column) -> DataFrame:
    """The recording with the best performance among those that pass (a top-1)."""
    out = recordings.where(passes).orderBy(F.desc_nulls_last(performance), "eid").limit(1)
    if out.isEmpty():
        raise ValueError("no session passes")
    return out


def running_index(df: DataFrame, keys: list[str], order: list[str], out: str, width: int = 1024) -> DataFrame:
    """1..n along the order inside each key."""
    s = ordered_scan(df, keys, order, F.floor(F.col(order[0]) / width), index="__i")
    return s.withColumn(out, F.col("__i") + 1).drop("__i")
