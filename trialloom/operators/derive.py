"""Scalar and list columns derived from catalog, trial and model rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialloom.constants import (
    DATASET_CATEGORIES, MIN_TRAINING_PERFORMANCE, PROTOCOL_RED_FLAGS, QC_SCORES, REGION_NAME_FIXES, REQUIRED_CONTRASTS,
    SESSION_TYPES, TARGET_TO_NM, VALID_TARGET_NMS, VIDEO_QUALITY_COLUMNS,
)
from trialloom.functions.columns import c, lookup, psychometric_curve, safe_div, str_array


def dataset_flags(df: DataFrame, datasets: str = "datasets", categories: dict = DATASET_CATEGORIES) -> DataFrame:
    """``has_<category>``: any of the category's names is in the list; no list means false."""
    return df.withColumns({
        f"has_{name}": F.coalesce(F.arrays_overlap(F.col(datasets), str_array(names)), F.lit(False))
        for name, names in categories.items()})


def session_type(df: DataFrame, protocol: str = "task_protocol", out: str = "session_type", error: str = "type_error") -> DataFrame:
    """Type named in the protocol text; none, several or a red flag is a typed error."""
    names = [t for t in SESSION_TYPES if t != "histology"]
    words = {f"{t}ChoiceWorld": t for t in names} | {"Histology": "histology"}
    hits = F.filter(F.array(*[F.when(F.col(protocol).contains(w), F.lit(t)) for w, t in words.items()]), lambda x: x.isNotNull())
    flagged = F.lit(False)
    for f in PROTOCOL_RED_FLAGS:
        flagged = flagged | F.col(protocol).contains(f)
    ok = (F.size(hits) == 1) & ~flagged
    previous = F.col(out) if out in df.columns else F.lit(None).cast("string")
    return df.withColumns({out: F.when(ok, F.get(hits, F.lit(0))).otherwise(previous),
                           error: F.when(F.coalesce(ok, F.lit(False)), None).otherwise("InvalidSessionType")})


def strip_side(region: Column) -> Column:
    return F.regexp_replace(region, "-[lr]$", "")


def target_nm(df: DataFrame, regions: str = "brain_region", nm: str = "NM", out: str = "target_NM", error: str = "target_error") -> DataFrame:
    """region without its side, joined with NM; names outside the valid list are an error."""
    names = F.transform(regions, lambda r: F.concat(strip_side(r), F.lit("-"), F.col(nm)))
    bad = F.size(F.array_except(F.array_compact(names), str_array(VALID_TARGET_NMS))) > 0
    return df.withColumns({out: names, error: F.when(bad, "InvalidTargetNM")})


def target_nm_from_region(df: DataFrame, regions: str = "brain_region") -> DataFrame:
    """target_NM and NM through the region -> NM map, for a list or a scalar column."""
    def one(r: Column) -> Column:
        bare = strip_side(r)
        return F.concat(bare, F.lit("-"), lookup(TARGET_TO_NM, bare))

    is_list = dict(df.dtypes)[regions].startswith("array")
    target = F.transform(regions, one) if is_list else one(F.col(regions))
    first = F.get(target, F.lit(0)) if is_list else target
    return df.withColumns({"target_NM": target, "NM": F.element_at(F.split(first, "-"), -1)})


def session_length(df: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Seconds between the ISO texts; a missing end or another calendar day is an error."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    seconds = (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)
    bad = a.isNull() | b.isNull() | (F.to_date(a) != F.to_date(b))
    return df.withColumns({"session_length": F.when(~bad, seconds), "length_error": F.when(bad, "InvalidSessionLength")})


def fix_regions(df: DataFrame, regions: str = "brain_region", fixes: dict = REGION_NAME_FIXES) -> DataFrame:
    """Renamed regions, the side suffix stays."""
    def one(r: Column) -> Column:
        bare = strip_side(r)
        return F.concat(F.coalesce(lookup(fixes, bare), bare), F.regexp_extract(r, "(-[lr])?$", 0))

    return df.withColumn(regions, F.transform(regions, one))


def trial_contrasts(df: DataFrame, left: str = "contrastLeft", right: str = "contrastRight") -> DataFrame:
    """Side, percent contrast and signed contrast (left negative) of a trial."""
    value = F.coalesce(F.col(right), F.col(left), F.lit(0.0)) * 100
    is_right = F.col(left).isNull()
    return df.withColumns({"stim_side": F.when(is_right, "right").otherwise("left"), "contrast": value,
                           "signed_contrast": F.when(is_right, value).otherwise(-value)})


def relative_contrast(df: DataFrame, hemisphere: str = "hemisphere") -> DataFrame:
    """Contra / ipsi coding relative to the fiber; an unknown side counts as left."""
    on_right = F.coalesce(F.col(hemisphere) == "r", F.lit(False))
    contra = F.when(on_right, "left").otherwise("right")
    chosen = F.when(F.col("choice") == -1, "right").otherwise("left")
    label = lambda x: F.when(x == contra, "contra").otherwise("ipsi")
    return df.withColumns({"side": label(F.col("stim_side")), "choice_side": label(chosen),
                           "relative_contrast": F.col("signed_contrast") * F.when(on_right, -1).otherwise(1)})


def contrast_log(x) -> Column:
    return F.log1p(c(x))


def contrast_log_inverse(x) -> Column:
    return F.expm1(c(x))


def contrast_log2(x) -> Column:
    """0 stays 0; a non-zero value under 1 is not in percent and raises."""
    x = c(x).cast("double")
    return (F.when(x == 0, F.lit(0.0)).when(x >= 1, F.log2(F.when(x >= 1, x)))
            .when(x.isNotNull(), F.raise_error(F.lit("log2 coding needs contrasts in percent")).cast("double")))


def contrast_log2_inverse(x) -> Column:
    return F.when(c(x) == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), c(x)))


def contrast_rank(df: DataFrame, contrast: str, keys: list[str] = (), out: str = "contrast_rank") -> DataFrame:
    """Index among the sorted distinct levels (few by nature: the levels of the task)."""
    keys = list(keys)
    levels = df.select(*keys, contrast).where(F.col(contrast).isNotNull()).distinct()
    ranked = levels.withColumn(out, (F.dense_rank().over(W.partitionBy(*keys).orderBy(contrast)) - 1).cast("long"))
    return df.join(ranked, [*keys, contrast], "left")


def code_contrast(x, coding: str) -> Column:
    return {"log": contrast_log, "log2": contrast_log2, "linear": lambda v: c(v)}[coding](x)


def deviation_code(column, positive) -> Column:
    return F.when(c(column) == F.lit(positive), F.lit(0.5)).otherwise(F.lit(-0.5))


def code_predictors(df: DataFrame, keys: list[str], coding: str = "log2") -> DataFrame:
    """Contrast coded and centred inside the fitted group; side, choice and reward as +-0.5.

    The mean comes from a partial aggregate joined back, so no group sits in one task.
    """
    from trialloom.functions.joins import skew_join

    coded = df.withColumn("contrast", code_contrast("contrast", coding)).withColumns({
        "side": deviation_code("side", "contra"), "choice_side": deviation_code("choice_side", "contra"),
        "reward": deviation_code("feedbackType", 1)})
    mean = coded.groupBy(*keys).agg(F.avg("contrast").alias("__m"))
    return skew_join(coded, mean, keys).withColumn("contrast", F.col("contrast") - F.col("__m")).drop("__m")


def trial_regressors(trials: DataFrame, keys: list[str], peak: DataFrame | None = None) -> DataFrame:
    """Timing columns of a trial, null where an input column is absent, and the peak velocity."""
    def diff(a, b):
        return F.col(a) - F.col(b) if {a, b} <= set(trials.columns) else F.lit(None).cast("double")

    kept = ["signed_contrast", "contrast", "stim_side", "choice", "feedbackType", "probabilityLeft"]
    out = trials.select(*keys, *kept, diff("firstMovement_times", "stimOn_times").alias("reaction_time"),
                        diff("feedback_times", "firstMovement_times").alias("movement_time"),
                        diff("feedback_times", "stimOn_times").alias("response_time"))
    return out.withColumn("peak_velocity", F.lit(None).cast("double")) if peak is None else out.join(peak, keys, "left")


def fiber_tip(df: DataFrame) -> DataFrame:
    """Tip of a fiber from its entry point, depth and two angles in degrees."""
    th, ph, d = F.radians("theta"), F.radians("phi"), F.col("depth")
    return df.withColumns({"tip_x": F.col("x") - d * F.sin(th) * F.cos(ph), "tip_y": F.col("y") - d * F.sin(th) * F.sin(ph),
                           "tip_z": F.col("z") - d * F.cos(th)})


def session_order(df: DataFrame, subject: str = "subject", day: str = "day") -> DataFrame:
    """Days since the subject's first day, and the session number by day.

    Ranks run over distinct days of a subject, a table far smaller than the sessions.
    """
    days = df.select(subject, day).distinct()
    w = W.partitionBy(subject).orderBy(day)
    n = days.select(subject, day, F.datediff(day, F.min(day).over(W.partitionBy(subject))).cast("long").alias("day_n"),
                    F.row_number().over(w).cast("long").alias("session_n"))
    return df.join(n, [subject, day], "left")


def proficient(session: str = "session_type", contrasts: str = "contrasts", performance: str = "fraction_correct") -> Column:
    """Training sessions need the full contrast set and the performance; other types always pass."""
    full = F.sort_array(F.array_distinct(F.col(contrasts))) == F.array(*[F.lit(x) for x in REQUIRED_CONTRASTS])
    return F.when(F.col(session) != "training", True).otherwise(
        F.coalesce(full, F.lit(False)) & (F.coalesce(F.col(performance), F.lit(0.0)) >= MIN_TRAINING_PERFORMANCE))


def qc_score(verdict) -> Column:
    """Verdict text as a number, missing counts 0."""
    return F.coalesce(lookup(QC_SCORES, verdict), F.lit(0.0))


def video_score(errors: str, disqualifying: list[str], columns: list[str] = VIDEO_QUALITY_COLUMNS) -> Column:
    """Mean score of the quality labels; -1 on a disqualifying error, null without any label."""
    scores = F.filter(F.array(*[lookup(QC_SCORES, c_) for c_ in columns]), lambda x: x.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
    return F.when(F.coalesce(F.arrays_overlap(F.col(errors), str_array(disqualifying)), F.lit(False)), F.lit(-1.0)).otherwise(mean)


def pose_timing(df: DataFrame, min_peak: float = 0.5) -> DataFrame:
    """Log reaction time, largest lag and peak over the thirds, absolute drift, and the timing gate."""
    a = lambda p: [F.col(f"{p}_{k}") for k in ("early", "mid", "late")]
    peak = F.greatest(*a("peak"))
    return df.withColumns({
        "log_mean_rt": F.when(F.col("mean_rt") > 0, F.ln("mean_rt")), "max_abs_lag": F.greatest(*[F.abs(x) for x in a("lag")]),
        "max_peak_value": peak, "abs_drift": F.abs(F.col("lag_late") - F.col("lag_early")), "timing_ok": peak > min_peak})


def epoch_seconds(iso) -> Column:
    return F.unix_micros(F.try_to_timestamp(c(iso))) / F.lit(1e6)


def trial_display(df: DataFrame, frame_time: str, likelihood: str) -> DataFrame:
    """What a viewer shows of a trial: side, contrast, outcome, signed distance of a frame to its events, opacity."""
    return trial_contrasts(df).withColumns({
        "correct": F.col("feedbackType") == 1, "prob_left": F.col("probabilityLeft"),
        **{f"to_{e}": F.col(frame_time) - F.col(e) for e in ("stimOn_times", "firstMovement_times", "feedback_times")},
        "alpha": F.least(F.greatest(F.col(likelihood), F.lit(0.0)), F.lit(1.0))})


def curve_table(fits: DataFrame, keys: list[str], lo: int = -100, hi: int = 100, points: int = 101) -> DataFrame:
    """Psychometric curve of every fit on a grid, averaged per group."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo + i * F.lit((hi - lo) / (points - 1))))
    rows = fits.withColumn("x", grid).withColumn("p", psychometric_curve("x", "bias", "threshold", "lapse_left", "lapse_right"))
    return rows.groupBy(*keys, "x").agg(F.avg("p").alias("p"), F.count("p").alias("n_fits"))


def lateralize(df: DataFrame) -> DataFrame:
    """Bias signed by hemisphere; lapses as contra / ipsi. A side other than l: sign +1 unless r, lapses as r."""
    side = F.col("hemisphere")
    left = F.coalesce(side == "l", F.lit(False))
    sign = F.when(side == "r", -1).otherwise(1)
    return df.withColumns({"bias": F.col("bias") * sign, "bias_shift": F.col("bias_shift") * sign,
                           "lapse_contra": F.when(left, F.col("lapse_right")).otherwise(F.col("lapse_left")),
                           "lapse_ipsi": F.when(left, F.col("lapse_left")).otherwise(F.col("lapse_right"))})


def psychometric_features(recordings: DataFrame, performance: DataFrame) -> DataFrame:
    """Lateralised behaviour per recording; a recording without a fit keeps a null row."""
    return lateralize(recordings.join(performance, "eid", "left"))


def feature_parts(df: DataFrame, label: str = "feature") -> DataFrame:
    """event, contrast, side and feedback of a feature label such as stimOn_c25_contra_correct."""
    part = lambda p, i=1: F.regexp_extract(label, p, i)
    return df.withColumns({"event": part("^(.*?)_c"), "contrast": F.expr(f"try_cast(regexp_extract({label}, '_c([0-9.]+)', 1) AS double)"),
                           "side": part("_(contra|ipsi)"), "feedback": part("_(incorrect|correct)$")})


def contrast_shade(df: DataFrame, contrast: str, keys: list[str] = (), out: str = "shade") -> DataFrame:
    """1 - rank / (levels - 1) of the absolute contrast; one level gives 0."""
    a = df.withColumn("__abs", F.abs(contrast))
    r = contrast_rank(a, "__abs", keys, "__r")
    n = r.groupBy(*keys).agg(F.max("__r").alias("__n"))
    r = r.join(n, list(keys), "left") if keys else r.crossJoin(F.broadcast(n))
    return r.withColumn(out, F.coalesce(1 - safe_div(F.col("__r"), "__n"), F.lit(0.0))).drop("__abs", "__r", "__n")


# --- model terms: a term is a tuple of column names, () is the intercept -----------------

def term_name(term: tuple[str, ...]) -> str:
    return ":".join(term) if term else "Intercept"


def crossed(*names: str) -> list[tuple[str, ...]]:
    """Main effects and all interactions of the named columns."""
    terms = [()]
    for n in names:
        terms += [t + (n,) for t in terms]
    return sorted((t for t in terms if t), key=lambda t: (len(t), [names.index(x) for x in t]))


def term_columns(terms) -> list[str]:
    """Columns a term list needs, in order of first use."""
    return list(dict.fromkeys(x for t in terms for x in t))


def family_columns(family: dict[str, list[tuple[str, ...]]]) -> list[str]:
    return list(dict.fromkeys(x for terms in family.values() for x in term_columns(terms)))


def drop_variable(terms, variable: str):
    return [t for t in terms if variable not in t]


def drop_one_family(terms, variables) -> dict[str, list[tuple[str, ...]]]:
    """The full model and one reduced model per variable, without every term that holds it."""
    return {"full": list(terms), **{v: drop_variable(terms, v) for v in variables}}


def block_terms(names: list[str], mains: list[str]) -> list[str]:
    """Term names all of whose factors belong to the block."""
    return [n for n in names if set(n.split(":")) <= set(mains)]


def term_value(term: tuple[str, ...]) -> Column:
    out = F.lit(1.0)
    for x in term:
        out = F.col(x).cast("double") if out is None or len(term) == 1 else out * F.col(x).cast("double")
    return out
