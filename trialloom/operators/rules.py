"""Filters, validators and the error log."""

from __future__ import annotations

import traceback as tb
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialloom.constants import (
    ERROR_COLUMNS, FALSE_START_SECONDS, LENGTH_MISMATCH_SECONDS, MIN_EVENT_COMPLETENESS, MIN_TRIALS, UNIQUE_SAMPLE_THRESHOLD,
)
from trialloom.functions.columns import all_of, str_array
from trialloom.functions.distribution import grouped_quantiles
from trialloom.functions.joins import skew_join


# --- session filters -----------------------------------------------------------------

def session_predicates(
    df: DataFrame, *, session_types=None, exclude_subjects=None, exclude_eids=None, blockers=None, target_nms=None,
    min_performance=None, required_contrasts=None, lab=None, start_min=None,
) -> dict[str, Column]:
    """One condition per asked filter whose column exists; null never passes a value test."""
    have, p = set(df.columns), {}
    if session_types and "session_type" in have:
        p["session_types"] = F.col("session_type").isin(list(session_types))
    if exclude_subjects and "subject" in have:
        p["exclude_subjects"] = ~F.col("subject").isin(list(exclude_subjects))
    if exclude_eids and "eid" in have:
        p["exclude_eids"] = ~F.col("eid").isin(list(exclude_eids))
    if lab and "lab" in have:
        p["lab"] = F.col("lab") == lab
    if start_min and "subject_start" in have:
        p["start_time_min"] = F.col("subject_start") >= start_min
    if blockers and "logged_errors" in have:
        p["qc_blockers"] = ~F.arrays_overlap("logged_errors", str_array(blockers))
    if target_nms and "target_NM" in have:
        p["target_nms"] = F.exists("target_NM", lambda t: t.isin(list(target_nms)))
    if min_performance and "fraction_correct" in have:
        if isinstance(min_performance, dict):
            cond = F.lit(True)
            for kind, least in min_performance.items():
                cond = cond & ((F.col("session_type") != kind) | (F.col("fraction_correct") >= least))
            p["min_performance"] = cond
        else:
            p["min_performance"] = F.col("fraction_correct") >= float(min_performance)
    if required_contrasts and "contrasts" in have:
        need = F.array(*[F.lit(float(x)) for x in sorted(required_contrasts)])
        p["required_contrasts"] = F.sort_array(F.array_distinct("contrasts")) == need
    return {k: F.coalesce(v, F.lit(False)) for k, v in p.items()}


def with_subject_start(df: DataFrame, subject: str = "subject", start: str = "start_time") -> DataFrame:
    """First start of each subject on all its rows (partial aggregate, joined back)."""
    first = df.groupBy(subject).agg(F.min(start).alias("subject_start"))
    return skew_join(df, first, [subject], "left")


def filter_sessions(df: DataFrame, *, start_min=None, subject: str = "subject", start: str = "start_time", **filters) -> DataFrame:
    """Sessions passing every asked filter.

    The row filters come first and reach the scan; a subject's first start is taken over all its
    sessions and applied as a semi-join.
    """
    kept = df.where(all_of(session_predicates(df, **filters).values()))
    if not start_min or not {subject, start} <= set(df.columns):
        return kept
    first = df.groupBy(subject).agg(F.min(start).alias("__first")).where(F.col("__first") >= start_min).select(subject)
    return kept.join(first, subject, "left_semi")


def removal_counts(df: DataFrame, **filters) -> DataFrame:
    """Rows each predicate would remove by itself, all counted in one pass."""
    preds = session_predicates(df, **filters)
    one = df.agg(*[F.count_if(~c).alias(k) for k, c in preds.items()], F.count(F.lit(1)).alias("__all"))
    return one.unpivot(["__all"], list(preds), "predicate", "n_removed").drop("__all")


def clean_sessions(df: DataFrame, exclude_subjects, exclude_types) -> DataFrame:
    keep = lambda col, vals: F.col(col).isNull() | ~F.col(col).isin(list(vals))
    return df.where(keep("subject", exclude_subjects) & keep("session_type", exclude_types))


def cleaning_report(df: DataFrame, exclude_subjects, exclude_types) -> DataFrame:
    """Rows dropped per excluded value: subjects first, then types among the rest."""
    by_subject = F.coalesce(F.col("subject").isin(list(exclude_subjects)), F.lit(False))
    by_type = F.coalesce(F.col("session_type").isin(list(exclude_types)), F.lit(False))
    return (df.where(by_subject | by_type)
            .select(F.when(by_subject, "subject").otherwise("session_type").alias("reason"),
                    F.when(by_subject, F.col("subject").cast("string")).otherwise(F.col("session_type")).alias("value"))
            .groupBy("reason", "value").agg(F.count(F.lit(1)).alias("n_removed")))


def _length(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return F.coalesce(F.size(column), F.lit(0)) if kind.startswith("array") else F.lit(1)


def validate_parallel_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose parallel list columns have one length; a scalar counts as length 1."""
    sizes = [_length(df, c) for c in columns]
    return df.where(all_of([s == sizes[0] for s in sizes[1:]]))


# --- rules that write typed error rows ---------------------------------------------------

Rule = tuple[str, Column, Column]  # error type, failure condition, message


def error_rows(df: DataFrame, rules: list[Rule], key: str = "eid") -> DataFrame:
    """One log row per (row, failed rule), in a single pass over the table."""
    checks = F.array(*[
        F.when(cond, F.struct(F.lit(kind).alias("error_type"), msg.cast("string").alias("error_message"))) for kind, cond, msg in rules])
    failed = F.filter(checks, lambda e: e.isNotNull())
    return df.select(F.col(key), F.inline(failed)).withColumn("traceback", F.lit(None).cast("string"))


def not_in(column: str, values) -> Column:
    return F.coalesce(~F.col(column).isin(list(values)), F.lit(True))


def catalog_rules(excluded, strains, lines, nms, targets, required_categories) -> list[Rule]:
    """Subject, strain, line, neuromodulator, region and dataset rules of a catalog row."""
    bare = F.transform("brain_region", lambda r: F.regexp_replace(r, "-[lr]$", ""))
    unknown = F.array_except(bare, str_array(targets))
    missing = F.filter(F.array(*[F.when(~F.col(f"has_{n}"), F.lit(n)) for n in required_categories]), lambda x: x.isNotNull())
    return [
        ("InvalidSubject", F.col("subject").isin(list(excluded)), F.col("subject")),
        ("InvalidStrain", not_in("strain", strains), F.coalesce("strain", F.lit("none"))),
        ("InvalidLine", not_in("line", lines), F.coalesce("line", F.lit("none"))),
        ("InvalidNeuromodulator", not_in("NM", nms), F.coalesce("NM", F.lit("none"))),
        ("MissingBrainRegion", F.coalesce(F.size("brain_region"), F.lit(0)) == 0, F.lit("no region")),
        ("InvalidBrainRegion", F.size(unknown) > 0, F.array_join(unknown, ",")),
        ("DataNotListed", F.size(missing) > 0, F.array_join(missing, ",")),
    ]


def hemisphere_errors(sessions: DataFrame, lookup: DataFrame) -> DataFrame:
    """First hemisphere problem of a session: empty list; then, region by region, mismatch with the fiber
    table, no insertion of a known side, or no suffix.

    ``lookup`` has (subject, region, fiber_hemisphere), null where the fibers disagree.
    """
    shorter = F.least(F.size("brain_region"), F.size("hemisphere"))
    pairs = F.when(F.size("hemisphere") > 0, F.slice(F.arrays_zip("brain_region", "hemisphere"), F.lit(1), F.coalesce(shorter, F.lit(0))))
    empty = F.coalesce(F.size("hemisphere"), F.lit(0)) <= 0
    listed = sessions.select("eid", "subject", empty.alias("empty"), F.posexplode_outer(pairs).alias("pos", "z"))
    rows = listed.select("eid", "subject", "empty", "pos", F.col("z.brain_region").alias("region_side"), F.col("z.hemisphere").alias("hemi"))
    rows = rows.withColumn("region", F.regexp_replace("region_side", "-[lr]$", ""))
    j = rows.join(lookup, ["subject", "region"], "left")
    named = F.coalesce("hemi", F.lit("")) != ""
    kind = (F.when(F.col("empty"), "MissingHemisphere").when(F.col("pos").isNull(), F.lit(None))
            .when(named & (F.col("fiber_hemisphere") != F.col("hemi")), "HemisphereMismatch")
            .when(F.col("fiber_hemisphere").isNull(), "MissingInsertion")
            .when(~named, "MissingHemiSuffix"))
    bad = j.withColumn("error_type", kind).where(F.col("error_type").isNotNull())
    return bad.groupBy("eid").agg(F.min_by(F.struct("error_type", F.coalesce("region_side", F.lit("")).alias("error_message")),
                                           F.coalesce("pos", F.lit(-1))).alias("e")).select(
        "eid", "e.error_type", "e.error_message", F.lit(None).cast("string").alias("traceback"))


def session_summary(trials: DataFrame, key: str, events: list[str], time: str) -> DataFrame:
    """What the session rules look at, from one aggregate over the trials."""
    return trials.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_trials"), F.min(time).alias("first_trial"), F.max(time).alias("last_trial"),
        *[F.avg(F.col(e).isNotNull().cast("double")).alias(f"share_{e}") for e in events])


def session_rules(events: list[str], min_trials: int = MIN_TRIALS, completeness: float = MIN_EVENT_COMPLETENESS) -> list[Rule]:
    incomplete = F.filter(F.array(*[F.when(F.col(f"share_{e}") < completeness, F.lit(e)) for e in events]), lambda x: x.isNotNull())
    return [
        ("InsufficientTrials", F.col("n_trials") < min_trials, F.col("n_trials")),
        ("IncompleteEventTimes", F.size(incomplete) > 0, F.array_join(incomplete, ",")),
        ("TrialsNotInPhotometryTime", (F.col("first_trial") < F.col("signal_start")) | (F.col("last_trial") > F.col("signal_end")), F.lit("trials outside the signal")),
        ("QCValidationError", (F.col("n_band_inversions") > 0) | (F.col("n_early_samples") > 0), F.concat_ws(",", "n_band_inversions", "n_early_samples")),
        ("FewUniqueSamples", F.col("n_unique_samples") < UNIQUE_SAMPLE_THRESHOLD, F.lit("few unique samples")),
    ]


def video_rules(length: str, timestamps: str, dropped: str, pin: str) -> list[Rule]:
    """Signed length difference (null passes) and three verdicts that must be PASS."""
    must_pass = lambda col: ~F.col(col).eqNullSafe(F.lit("PASS"))
    return [
        ("VideoLengthError", F.coalesce(F.col(length) >= LENGTH_MISMATCH_SECONDS, F.lit(False)), F.col(length)),
        ("VideoTimestampsQCError", must_pass(timestamps), F.coalesce(timestamps, F.lit("none"))),
        ("VideoDroppedFramesQCError", must_pass(dropped), F.coalesce(dropped, F.lit("none"))),
        ("VideoPinStateQCError", must_pass(pin), F.coalesce(pin, F.lit("none"))),
    ]


# --- modelling trials ----------------------------------------------------------------------

def modeling_trials(df: DataFrame, response: str = "response", probability_left: float | None = None) -> DataFrame:
    """Trials with a response and a choice that are no false start; adds log10 reaction time."""
    keep = F.col(response).isNotNull() & (F.col("choice") != 0) & (F.col("response_time") > FALSE_START_SECONDS)
    if probability_left is not None:
        keep = keep & (F.abs(F.col("probabilityLeft") - probability_left) < 1e-9)
    rt = F.col("reaction_time")
    return df.where(keep).withColumn("log_reaction_time", F.when(rt > 0, F.log10(F.when(rt > 0, rt))))


def complete_cases(df: DataFrame, columns: list[str], keys: list[str], min_trials: int = 0) -> DataFrame:
    """Rows complete over all the family's columns, in units with enough of them."""
    full = df.dropna(subset=columns)
    if not min_trials:
        return full
    enough = full.groupBy(*keys).count().where(F.col("count") >= min_trials).select(*keys)
    return skew_join(full, enough, keys)


def population_mask(session_types=None, qc: dict[str, list[str]] | None = None, ranges: dict[str, tuple] | None = None) -> Column:
    """Type, verdict and inclusive range filters; verdicts OR inside a field, AND across; an empty set is ignored."""
    conds = [F.col("session_type").isin(list(session_types))] if session_types else []
    conds += [F.col(f).isin(list(v)) for f, v in (qc or {}).items() if v]
    conds += [F.col(f).between(*r) for f, r in (ranges or {}).items() if r]
    return F.coalesce(all_of(conds), F.lit(False))


def sample_between_percentiles(df: DataFrame, metric: str, low: float, high: float, key: str, seed: int = 0) -> DataFrame:
    """One random row whose metric lies between two exact percentiles (hash draw, repeatable)."""
    q = grouped_quantiles(df.select(metric), [], metric, {"__lo": low, "__hi": high})
    inside = df.crossJoin(F.broadcast(q)).where(F.col(metric).between(F.col("__lo"), F.col("__hi")))
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col(key)).cast("binary"))
    return inside.orderBy(draw, key).limit(1).drop("__lo", "__hi")


def nth_recording(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n-th row (from 0) of the iteration order, as a bounded top-k."""
    return df.orderBy(*order).offset(n).limit(1)


# --- error log ----------------------------------------------------------------------------

def log_entry(eid, error: BaseException | None = None, error_type: str | None = None, message: str | None = None) -> dict:
    """One log row from an exception or from an explicit type."""
    if error is not None:
        text = "".join(tb.format_exception(type(error), error, error.__traceback__))
        return dict(zip(ERROR_COLUMNS, (eid, error_type or type(error).__name__, message or str(error), text)))
    return dict(zip(ERROR_COLUMNS, (eid, error_type, message, None)))


def guarded(fn: Callable, keys: list[str], columns: list[str], strict: bool = False):
    """Wrap a grouped function: a failure gives one row of nulls plus the error fields."""
    def run(key, *frames: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fn(*frames).assign(error_type=None, error_message=None, traceback=None)
        except Exception as e:
            if strict:
                raise
            row = dict.fromkeys(columns) | log_entry(None, e)
            row.pop("eid", None)
            out = pd.DataFrame([row])
        for k, v in zip(keys, key):
            out[k] = v
        return out[keys + [c for c in columns if c not in keys] + ERROR_COLUMNS[1:]]

    return run


def split_results(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a guarded run as (results, error log)."""
    return (df.where(F.col("error_type").isNull()).select(key, *columns),
            df.where(F.col("error_type").isNotNull()).select(key, *ERROR_COLUMNS[1:]))


def concat_logs(logs: list[DataFrame]) -> DataFrame:
    """Logs as one table with the four columns, each (session, type, message) once."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    for name in ERROR_COLUMNS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out.select(*ERROR_COLUMNS).groupBy("eid", "error_type", "error_message").agg(F.min("traceback").alias("traceback"))


def add_error_type(df: DataFrame, condition: Column, name: str, column: str = "logged_errors") -> DataFrame:
    return df.withColumn(column, F.when(condition, F.array_append(column, F.lit(name))).otherwise(F.col(column)))


def source_presence(sessions: DataFrame, extracted: DataFrame, raw: DataFrame, key: str = "eid") -> DataFrame:
    """Derived data missing while raw data exist, or both missing, as typed error rows."""
    flags = (sessions.select(key).distinct()
             .join(extracted.select(key).distinct().withColumn("__x", F.lit(True)), key, "left")
             .join(raw.select(key).distinct().withColumn("__r", F.lit(True)), key, "left"))
    kind = F.when(F.col("__x").isNotNull(), None).when(F.col("__r").isNotNull(), "MissingExtractedData").otherwise("MissingRawData")
    return flags.select(key, kind.alias("error_type")).where(F.col("error_type").isNotNull())


# Error names and whether one ends a session's processing.
ERROR_SEVERITY = {
    "InvalidSubject": "logged", "InvalidStrain": "logged", "InvalidLine": "logged", "InvalidNeuromodulator": "logged",
    "InvalidBrainRegion": "logged", "MissingBrainRegion": "logged", "MissingHemisphere": "logged", "HemisphereMismatch": "logged",
    "MissingInsertion": "logged", "MissingHemiSuffix": "logged", "DataNotListed": "logged", "InvalidSessionType": "logged",
    "InvalidTargetNM": "logged", "InvalidSessionLength": "logged", "TrueDuplicateSession": "logged", "MissingExtractedData": "fatal",
    "MissingResponses": "logged", "MissingRawData": "fatal", "MissingLP": "logged", "InsufficientTrials": "fatal",
    "BlockStructureBug": "logged", "MissingBlockInfo": "fatal", "IncompleteEventTimes": "fatal", "TrialsNotInPhotometryTime": "fatal",
    "BandInversion": "logged", "EarlySamples": "logged", "FewUniqueSamples": "logged", "QCValidationError": "fatal",
    "AmbiguousRegionMapping": "fatal", "MissingVideoTimestamps": "logged", "VideoLengthError": "logged", "VideoTimestampsQCError": "logged",
    "VideoDroppedFramesQCError": "logged", "VideoPinStateQCError": "logged", "MissingMotionEnergy": "logged",
}


def with_severity(log: DataFrame) -> DataFrame:
    """The vocabulary is a fixed table of some thirty rows, so it is broadcast."""
    dim = log.sparkSession.createDataFrame(list(ERROR_SEVERITY.items()), "error_type string, severity string")
    return log.join(F.broadcast(dim), "error_type", "left")
