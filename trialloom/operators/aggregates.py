"""Session, subject and cohort summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialloom.constants import DISPERSION_MIN_SESSIONS, UNIQUE_SAMPLE_THRESHOLD
from trialloom.functions.columns import safe_div
from trialloom.functions.joins import skew_join


def performance(trials: DataFrame, keys: list[str], exclude_nogo: bool = True, easy_from: float = 0.5) -> DataFrame:
    """Performance columns of a session in one aggregate; contrasts in percent."""
    right = (F.col("feedbackType") == 1).cast("double")
    counted = F.col("choice") != 0 if exclude_nogo else F.lit(True)
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"), F.sort_array(F.collect_set("contrast")).alias("contrasts"),
        F.avg(F.when(counted, right)).alias("fraction_correct"),
        F.avg(F.when(counted & (F.col("contrast") >= easy_from), right)).alias("fraction_correct_easy"),
        F.avg((F.col("choice") == 0).cast("double")).alias("nogo_fraction"))


def performance_by_contrast(trials: DataFrame, keys: list[str], exclude_nogo: bool = True) -> DataFrame:
    rows = trials.where(F.col("choice") != 0) if exclude_nogo else trials
    return rows.groupBy(*keys, "contrast").agg(F.avg((F.col("feedbackType") == 1).cast("double")).alias("fraction_correct"))


def qc_pass(qc: DataFrame, keys: list[str], require_all: bool, unique="n_unique_samples", inversions="n_band_inversions") -> DataFrame:
    """All signals (or any signal) of a session pass the unique-sample and inversion limits."""
    u = F.min(unique) if require_all else F.max(unique)
    i = F.max(inversions) if require_all else F.min(inversions)
    return qc.groupBy(*keys).agg(F.coalesce((u > UNIQUE_SAMPLE_THRESHOLD) & (i == 0), F.lit(False)).alias("qc_pass"))


def stage_counts(sessions: DataFrame, subject: str = "subject", kind: str = "session_type", number: str = "session_n") -> DataFrame:
    """Sessions per stage, and how many training / biased ones came before the next stage; null if never reached."""
    first = sessions.groupBy(subject).agg(
        F.min(F.when(F.col(kind) == "biased", F.col(number))).alias("__b"), F.min(F.when(F.col(kind) == "ephys", F.col(number))).alias("__e"))
    j = skew_join(sessions, first, [subject])
    n = lambda c: F.count_if(c)
    is_ = lambda k: F.col(kind) == k
    return j.groupBy(subject).agg(
        *[n(is_(k)).alias(f"n_{k}") for k in ("training", "biased", "ephys")],
        F.when(F.max("__b").isNotNull(), n(is_("training") & (F.col(number) < F.col("__b")))).alias("training_to_biased"),
        F.when(F.max("__e").isNotNull(), n(is_("biased") & (F.col(number) < F.col("__e")))).alias("biased_to_ephys"))


def subjects_by_stage(sessions: DataFrame) -> DataFrame:
    """Distinct (stage, subject) rows."""
    return sessions.select(F.col("session_type").alias("stage"), "subject").distinct()


def monthly_qc(rows: DataFrame, date: str, checks: dict[str, Column], tau: str) -> DataFrame:
    """Failure rate of each check per month, and mean, sd and count of the time constant."""
    return rows.groupBy(F.date_format(F.date_trunc("month", date), "yyyy-MM").alias("month")).agg(
        *[F.avg((~c).cast("double")).alias(f"fail_{k}") for k, c in checks.items()],
        F.avg(tau).alias("tau_mean"), F.stddev_samp(tau).alias("tau_std"), F.count(tau).alias("tau_n"))


def pose_rollup(pose: DataFrame, missing: DataFrame, performance_: DataFrame, type_order: list[str]) -> DataFrame:
    """Pose rows plus stub rows (score -1) for sessions without video, performance joined, in report order."""
    stubs = missing.join(pose.select("eid"), "eid", "left_anti").select("eid", "session_type", F.lit(-1.0).alias("video_score"), F.lit(False).alias("lp_exists"))
    rows = pose.unionByName(stubs, allowMissingColumns=True).join(performance_, "eid", "left")
    rank = F.array_position(F.array(*[F.lit(t) for t in type_order]), F.col("session_type"))
    return rows.withColumn("type_rank", rank).orderBy(F.desc("lp_exists"), F.desc("type_rank"), F.desc_nulls_last("video_score"), "eid")


def response_summary(responses: DataFrame, group: str, subject: str, session: str, trial: list[str], approximate: bool = False) -> DataFrame:
    """Distinct subjects, sessions and trials per group; sketches when an estimate is enough."""
    d = F.approx_count_distinct if approximate else F.count_distinct
    return responses.groupBy(group).agg(d(subject).alias("n_subjects"), d(session).alias("n_sessions"),
                                        d(F.struct(*trial)).alias("n_trials"))


def density_histogram(df: DataFrame, group: str, measure: str, groups: list[str], bins: int) -> DataFrame:
    """Density per group on bin edges of the whole cohort; the right edge belongs to the last bin."""
    edges = df.agg(F.min(measure).alias("__lo"), F.max(measure).alias("__hi"))
    b = F.least(F.floor((F.col(measure) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1).cast("long"))
    counted = df.where(F.col(measure).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy(group).agg(F.sum("n").alias("__total"))
    grid = (df.sparkSession.createDataFrame([(g,) for g in groups], f"{group} string")
            .withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).crossJoin(F.broadcast(edges)))
    width = (F.col("__hi") - F.col("__lo")) / bins
    j = grid.join(counted, [group, "bin"], "left").join(total, group, "left")
    return j.select(group, "bin", (F.col("__lo") + F.col("bin") * width).alias("edge"),
                    F.coalesce(F.col("n") / F.col("__total") / width, F.lit(0.0)).alias("density"))


def weekdays(start, end) -> Column:
    """Weekdays from start (inclusive) to end (exclusive), by arithmetic on whole weeks."""
    days = F.greatest(F.datediff(end, start), F.lit(0))
    rest = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: (i < days % 7) & ((F.weekday(start) + i) % 7 < 5))
    return F.floor(days / 7) * 5 + F.size(rest)


def capacity_projection(counts: DataFrame, ready: str, total: str, target_n: int, per_day: float, today: Column, deadline: Column) -> DataFrame:
    """Yield, shortfall, sessions and days still needed per target; no yield means never."""
    rate = F.col(ready) / F.nullif(F.col(total), F.lit(0))
    short = F.greatest(F.lit(target_n) - F.col(ready), F.lit(0))
    inf = F.lit(float("inf"))
    need = F.when(short == 0, F.lit(0.0)).when(rate == 0, inf).otherwise(F.ceil(short / F.when(rate != 0, rate)).cast("double"))
    days = F.when(need == inf, inf).otherwise(F.ceil(F.when(need != inf, need) / per_day).cast("double"))
    return counts.select(*counts.columns, rate.alias("yield_rate"), short.cast("long").alias("shortfall"), need.alias("effective_sessions_needed"),
                         days.alias("recording_days_needed"), weekdays(today, deadline).cast("long").alias("days_available"))


def feature_dispersion(df: DataFrame, unit: list[str], session: str, feature: str, value: str, standardize_by: str | None = None) -> DataFrame:
    """Root of the mean over features of the variance, across a unit's sessions, of z-scored values."""
    keys = ([standardize_by] if standardize_by else []) + [feature]
    m = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__sd"))
    z = skew_join(df, m, keys).withColumn("__z", F.when(F.col("__sd") == 0, F.lit(0.0)).otherwise(safe_div(F.col(value) - F.col("__m"), "__sd")))
    disp = z.groupBy(*unit, feature).agg(F.var_pop("__z").alias("__v")).groupBy(*unit).agg(F.sqrt(F.avg("__v")).alias("dispersion"))
    n = df.groupBy(*unit).agg(F.count_distinct(session).alias("n_sessions"))
    return disp.join(n, unit)


def paired_dispersion(neural: DataFrame, behavioral: DataFrame, unit: list[str], min_sessions: int = DISPERSION_MIN_SESSIONS) -> DataFrame:
    """Units with enough sessions on both sides, neural beside behavioural dispersion."""
    n = neural.where(F.col("n_sessions") >= min_sessions).select(*unit, F.col("dispersion").alias("neural"), F.col("n_sessions").alias("n_neural"))
    b = behavioral.where(F.col("n_sessions") >= min_sessions).select(*unit, F.col("dispersion").alias("behavioral"), F.col("n_sessions").alias("n_behavioral"))
    return n.join(b, unit)


def qc_rows(sliding: DataFrame, raw: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Window metrics averaged per (keys, metric), as columns, with the session's raw metrics on every row."""
    wide = sliding.groupBy(*keys).pivot("metric", metrics).agg(F.avg("score"))
    return wide.join(raw, "eid", "left")


def append_qc(stored: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """Update-or-append: new metric values win, other stored metrics stay."""
    metrics = list(dict.fromkeys([c for c in stored.columns + update.columns if c not in keys]))
    a = stored.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in stored.columns if c not in keys])
    b = update.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in update.columns if c not in keys])
    j = a.join(b, keys, "full")
    pick = lambda c: F.coalesce(*[F.col(f"__{p}_{c}") for p, d in (("b", update), ("a", stored)) if c in d.columns])
    return j.select(*keys, *[pick(c).alias(c) for c in metrics])


def mid_session_metric(windows: DataFrame, keys: list[str], t: str, value: str, half: float = 300.0) -> DataFrame:
    """Mean of a sliding metric within ``half`` seconds of the middle of the session."""
    span = windows.groupBy(*keys).agg(((F.min(t) + F.max(t)) / 2).alias("__mid"))
    j = skew_join(windows, span, keys)
    return j.where(F.abs(F.col(t) - F.col("__mid")) <= half).groupBy(*keys).agg(F.avg(value).alias(value))


def session_event_times(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Cue, movement, reward and omission times as rows (keys, kind, time)."""
    kinds = F.array(
        F.struct(F.lit("cue").alias("kind"), F.col("stimOn_times").alias("time")),
        F.struct(F.lit("movement").alias("kind"), F.col("firstMovement_times").alias("time")),
        F.struct(F.when(F.col("feedbackType") == 1, "reward").otherwise("omission").alias("kind"), F.col("feedback_times").alias("time")))
    return trials.select(*keys, F.inline(kinds)).where(F.col("time").isNotNull())
