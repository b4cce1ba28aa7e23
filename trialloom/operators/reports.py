"""The tables behind the figures: counts, trajectories, boxes, cell means, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialloom.functions.columns import safe_div
from trialloom.functions.distribution import grouped_quantiles
from trialloom.functions.joins import skew_join
from trialloom.operators.ordered import min_max_scale
from trialloom.session import cut_lineage


def session_matrix(sessions: DataFrame, keep: Column, category: str, subject: str = "subject", number: str = "session_n", start: str = "start_time") -> DataFrame:
    """Long subject x session matrix of a category, with the filtered overlay and the subject's row position.

    More than one session in a cell is an error.
    """
    cells = sessions.groupBy(subject, number).agg(F.min(category).alias("__c"), F.max(keep).alias("kept"), F.count(F.lit(1)).alias("__n"))
    checked = cells.withColumn("category", F.when(F.col("__n") == 1, F.col("__c")).otherwise(F.raise_error(F.lit("more than one session in a cell"))))
    first = sessions.groupBy(subject).agg(F.min(start).alias("first_start"))
    rows = checked.select(subject, number, "category", F.when(F.coalesce("kept", F.lit(False)), F.col("category")).alias("filtered"))
    return skew_join(rows, first, [subject])


def target_overview(recordings: DataFrame, target: str, category: str, categories: list[str], subject: str = "subject") -> DataFrame:
    """Recordings per target and category as columns, and distinct mice per target."""
    counts = recordings.groupBy(target).agg(*[F.count_if(F.col(category) == c).alias(f"n_{c}") for c in categories])
    mice = recordings.groupBy(target).agg(F.count_distinct(subject).alias("n_mice"))
    return counts.join(mice, target)


def mouse_overview(recordings: DataFrame, target: str, category: str, minimums: dict[str, tuple[list[str], int]], subject: str = "subject", side: str = "hemisphere") -> DataFrame:
    """Mice per target with at least k sessions of the listed categories, and recordings per side."""
    per = recordings.groupBy(target, subject).agg(
        *[F.count_distinct(F.when(F.col(category).isin(cats), F.col("eid"))).alias(f"__{n}") for n, (cats, _) in minimums.items()],
        F.count_if(F.col(side) == "l").alias("l"), F.count_if(F.col(side) == "r").alias("r"))
    return per.groupBy(target).agg(*[F.count_if(F.col(f"__{n}") >= k).alias(f"mice_{n}") for n, (_, k) in minimums.items()],
                                   F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def stage_overview(counts: DataFrame) -> DataFrame:
    """Subjects with any training, at least 5 biased + ephys, and at least 3 ephys sessions."""
    return counts.agg(F.count_if(F.col("n_training") > 0).alias("training"), F.count_if(F.col("n_biased") + F.col("n_ephys") >= 5).alias("biased_ephys"),
                      F.count_if(F.col("n_ephys") >= 3).alias("ephys"))


def significant_share(results: DataFrame, target: str, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    sig = F.col(p) <= alpha
    return results.groupBy(target).agg(F.avg(sig.cast("double")).alias("share"), F.count(p).alias("n_units"))


def r2_by_significance(results: DataFrame, target: str, r2: str, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    return results.groupBy(target, (F.col(p) <= alpha).alias("significant")).agg(F.avg(r2).alias("mean_r2"), F.count(r2).alias("n"))


def ordered_by_median(results: DataFrame, target: str, subject: str, value: str) -> DataFrame:
    """Median per mouse, and the mouse's position inside its target by that median (one row per mouse)."""
    med = grouped_quantiles(results, [target, subject], value, {"median": 0.5})
    return med.withColumn("position", F.row_number().over(W.partitionBy(target).orderBy("median", subject)))


def trajectory(fits: DataFrame, number: str, value: str, subject: str, photometry: str) -> tuple[DataFrame, DataFrame]:
    """Mean of a parameter per session number, and whether a mouse has any photometry."""
    return (fits.groupBy(number).agg(F.avg(value).alias(value), F.count(value).alias("n")), fits.groupBy(subject).agg(F.bool_or(photometry).alias("any_photometry")))


def box_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, mean, sd, standard error and 95% interval per group."""
    q = grouped_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    m = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    sem = F.col("sd") / F.sqrt("n")
    return q.join(m, keys).withColumns({"sem": sem, "ci_lower": F.col("mean") - 1.96 * sem, "ci_upper": F.col("mean") + 1.96 * sem})


def subject_means(df: DataFrame, keys: list[str], subject: str, value: str) -> DataFrame:
    """Mean over subject means, with sd over subjects."""
    s = df.groupBy(*keys, subject).agg(F.avg(value).alias(value))
    return s.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n_subjects"))


def contrast_responses(df: DataFrame, group: list[str], response: str, min_trials: int = 10, pooled: bool = True, subject: str = "subject") -> DataFrame:
    """Response by contrast, side and feedback after removing subject means; cells need more than ``min_trials`` trials."""
    # Count, sum and sum of squares per cell hold all that the shifted means and errors need, so the
    # trials are read once and the subject and grand means come from the (small) cell table.
    cell = [*group, subject, "side", "feedbackType", "contrast"]
    r = F.col(response)
    sums = cut_lineage(df.groupBy(*cell).agg(F.count(r).alias("n"), F.sum(r).alias("s0"), F.sum(r * r).alias("ss0")))
    subj = sums.groupBy(*group, subject).agg((F.sum("s0") / F.sum("n")).alias("__sm"))
    grand = sums.groupBy(*group).agg((F.sum("s0") / F.sum("n")).alias("__gm"))
    shift = F.col("__gm") - F.col("__sm")
    per = sums.where(F.col("n") > min_trials).join(subj, [*group, subject]).join(grand, group).withColumns({
        "s": F.col("s0") + F.col("n") * shift, "ss": F.col("ss0") + 2 * shift * F.col("s0") + F.col("n") * shift * shift})
    keys = [*group, "side", "feedbackType", "contrast"]
    if pooled:
        n = F.sum("n")
        var = (F.sum("ss") - F.sum("s") ** 2 / n) / (n - 1)
        return per.groupBy(*keys).agg((F.sum("s") / n).alias("mean"), F.sqrt(var / n).alias("sem"), n.alias("n"))
    m = F.col("s") / F.col("n")
    return per.groupBy(*keys).agg(F.avg(m).alias("mean"), (F.stddev_samp(m) / F.sqrt(F.count(m))).alias("sem"), F.count(m).alias("n"))


def mean_response_traces(traces: DataFrame, group: list[str], recording: list[str], subject: str = "subject", time: str = "time", value: str = "response",
                         min_trials: int = 5, baseline=(-0.15, 0.0)) -> DataFrame:
    """Mean and standard error trace per group: enough trials, baseline removed, subject means removed per time."""
    few = traces.groupBy(*group, subject).agg(F.min_by("n_trials", F.struct(*recording, time)).alias("__n")).where(F.col("__n") >= min_trials).select(*group, subject)
    t = cut_lineage(skew_join(traces, few, [*group, subject]))
    inside = (F.col(time) >= baseline[0]) & (F.col(time) < baseline[1])
    base = t.groupBy(*group, *recording).agg(F.avg(F.when(inside, F.col(value))).alias("__b"))
    t = skew_join(t, base, [*group, *recording]).withColumn("__v", F.col(value) - F.coalesce("__b", F.lit(0.0)))
    t = cut_lineage(t.select(*group, subject, time, "__v"))
    per_subject = t.groupBy(*group, time, subject).agg(F.avg("__v").alias("__sm"))
    grand = t.groupBy(*group, time).agg(F.avg("__v").alias("__gm"))
    a = skew_join(skew_join(t, per_subject, [*group, time, subject]), grand, [*group, time]).withColumn("__a", F.col("__v") - F.col("__sm") + F.col("__gm"))
    n = F.count(F.lit(1))
    return a.groupBy(*group, time).agg(F.avg("__a").alias("mean"), F.when(n > 1, F.stddev_samp("__a") / F.sqrt(n)).otherwise(0.0).alias("sem"), n.alias("n_recordings"))


def reaction_time_trials(responses: DataFrame, regressors: DataFrame, keys: list[str], target: str, targets: list[str]) -> DataFrame:
    """Distinct (session, trial, target) rows with log10 of the positive reaction times."""
    rows = responses.where(F.col(target).isin(targets)).select(*keys, target).distinct()
    j = rows.join(regressors, keys).where(F.col("choice") != 0)
    rt = F.col("reaction_time")
    return j.withColumn("log_rt", F.when(rt > 0, F.log10(F.when(rt > 0, rt))))


def shared_range(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("low"), F.max(value).alias("high"))


def mean_vectors(features: DataFrame, target: str, feature: list[str], value: str) -> DataFrame:
    """Mean response vector per target, raw and scaled to 0..1 (null when constant)."""
    m = features.groupBy(target, *feature).agg(F.avg(value).alias("mean"))
    return min_max_scale(m, [target], "mean", None, "scaled")


def similarity_order(recordings: DataFrame, label: str, subject: str, key: str) -> DataFrame:
    """Axis position of each recording, ordered by label, then subject."""
    from trialloom.functions.scan import ordered_scan

    return ordered_scan(recordings.select(key, label, subject), [], [label, subject, key], F.struct(F.col(label), F.col(subject)), index="position")


def fold_table(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Every fold beside the aggregate row of its group."""
    agg = folds.where("fold = 'aggregate'").select(*keys, F.col("r2").alias("aggregate_r2"), F.col("delta_r2").alias("aggregate_delta_r2"))
    return folds.where("fold <> 'aggregate'").join(agg, keys)


def persession_grid(sessions: DataFrame, pvalues: DataFrame, keys: list[str], subject: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Mice of a grid ordered by mean value, with their significance."""
    m = sessions.groupBy(*keys, subject).agg(F.avg(value).alias("mean"), F.count(value).alias("n_sessions"))
    j = m.join(pvalues.select(*keys, subject, "p_value"), [*keys, subject], "left")
    pos = F.row_number().over(W.partitionBy(*keys).orderBy("mean", subject))
    return j.withColumns({"significant": F.coalesce(F.col("p_value") < alpha, F.lit(False)), "position": pos})


def stars(p: str) -> Column:
    return F.when(F.col(p) < 0.001, "***").when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise("")


def coefficient_matrix(coefs: DataFrame, term: str, target: str, targets: list[str]) -> DataFrame:
    """term x target coefficients with their stars as text."""
    text = F.concat(F.format_string("%.2f", F.col("coef")), stars("p"))
    return coefs.groupBy(term).pivot(target, targets).agg(F.first(text))


def projection_matrix(pairs: DataFrame, row: str, column: str, value: str, names: list) -> DataFrame:
    return pairs.groupBy(row).pivot(column, names).agg(F.first(value))
