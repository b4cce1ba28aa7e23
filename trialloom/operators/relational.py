"""Exploding, joining and filling catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialloom.functions.joins import interval_join, skew_join


def recordings(sessions: DataFrame, lists: list[str], targets: list[str] | None = None, target: str = "target_NM") -> DataFrame:
    """One row per position of the parallel lists; fiber_idx counts before the target filter."""
    rest = [c for c in sessions.columns if c not in lists]
    rows = sessions.select(*rest, F.posexplode(F.arrays_zip(*lists)).alias("fiber_idx", "__z"))
    rows = rows.select(*rest, *[F.col(f"__z.{c}").alias(c) for c in lists], "fiber_idx")
    return rows.where(F.col(target).isin(targets)) if targets else rows


def left_join_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with the right side made unique per key first."""
    return left.join(right.dropDuplicates(keys), keys, "left")


def qc_with_recordings(qc: DataFrame, recs: DataFrame, band: str, keys=("eid", "brain_region")) -> DataFrame:
    """QC rows of one band joined to their recordings, with the date and infinite metrics as null."""
    j = qc.where(F.col("band") == band).join(recs, list(keys), "inner")
    inf = F.lit(float("inf"))
    clean = {n: F.when(F.abs(n) != inf, F.col(n)) for n, k in j.dtypes if k == "double"}
    return j.withColumns(clean).withColumn("date", F.to_date("start_time"))


def match_channels(channels: DataFrame, regions: DataFrame, key: str = "eid") -> DataFrame:
    """Signal columns resolved to metadata regions: an exact name stays, a bare name must fit exactly one suffixed region."""
    reg = regions.select(key, F.col("region").alias("__r"), F.regexp_replace("region", "-[lr]$", "").alias("__bare"))
    exact = reg.select(key, F.col("__r").alias("channel"), F.col("__r").alias("__exact")).distinct()
    by_bare = reg.groupBy(key, F.col("__bare").alias("channel")).agg(F.count(F.lit(1)).alias("__n"), F.min("__r").alias("__one"))
    j = channels.join(exact, [key, "channel"], "left").join(by_bare, [key, "channel"], "left")
    found = F.coalesce("__exact", F.when(F.col("__n") == 1, F.col("__one")))
    return j.select(*channels.columns, found.alias("region"), F.when(found.isNull(), "AmbiguousRegionMapping").alias("error_type"))


def _agreed(df: DataFrame, value: Column, group: str, out: str) -> DataFrame:
    """The group's single distinct non-null value: equal smallest and largest."""
    return (df.select(group, value.alias("__v")).where(F.col("__v").isNotNull() & F.col(group).isNotNull())
            .groupBy(group).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
            .where(F.col("__lo") == F.col("__hi")).select(group, F.col("__lo").alias(out)))


def fill_empty_list(df: DataFrame, column: str, group: str) -> DataFrame:
    """Empty lists take the group's agreed non-empty list; null cells and disagreement stay."""
    src = _agreed(df, F.when(F.size(column) > 0, F.col(column)), group, "__src")
    j = skew_join(df, src, [group], "left")
    return j.withColumn(column, F.when((F.size(column) == 0) & F.col("__src").isNotNull(), F.col("__src")).otherwise(F.col(column))).drop("__src")


def fill_parallel_lists(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Same for parallel columns, from the one valid row version: all non-empty and equally long."""
    n = F.size(columns[0])
    valid = n > 0
    for c in columns[1:]:
        valid = valid & (F.size(c) == n)
    src = _agreed(df, F.when(valid, F.struct(*columns)), group, "__src")
    j = skew_join(df, src, [group], "left")
    empty = F.lit(False)
    for c in columns:
        empty = empty | (F.coalesce(F.size(c), F.lit(-1)) == 0)
    return j.withColumns({c: F.when(empty & F.col("__src").isNotNull(), F.col(f"__src.{c}")).otherwise(F.col(c)) for c in columns}).drop("__src")


def hemisphere_of_fiber(ml: str) -> Column:
    """Side of a fiber from the sign of its medio-lateral coordinate: positive is left; null on the midline."""
    return F.when(F.col(ml) > 0, "l").when(F.col(ml) < 0, "r")


def fiber_hemispheres(fibers: DataFrame, ml: str = "x_ml") -> DataFrame:
    """(subject, region) -> side of its first fiber, if its fibers off the midline lie on one side; else null."""
    side = hemisphere_of_fiber(ml)
    return fibers.groupBy("subject", "region").agg(F.when(F.min(side) == F.max(side), F.min_by(side, F.col("fiber"))).alias("fiber_hemisphere"))


def fill_regions_from_fibers(sessions: DataFrame, fibers: DataFrame, ml: str = "x_ml") -> DataFrame:
    """Empty region lists take all fibers of the subject in order; missing sides come from (subject, region).

    Sides stay empty when the subject has several fibers in one region only, and a missing side stays
    empty unless the region's fibers agree on one. Null lists stay as they are. A subject has a handful
    of fibers, and a list column holds them by definition.
    """
    side = F.coalesce(hemisphere_of_fiber(ml), F.lit("")).alias("side")
    lists = fibers.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("fiber", "region", side))).alias("__f"))
    j = skew_join(sessions, lists, ["subject"], "left")
    empty = F.coalesce(F.size("brain_region") == 0, F.lit(False)) & F.col("__f").isNotNull()
    same = (F.size("__f") > 1) & (F.size(F.array_distinct("__f.region")) == 1)
    sides = F.transform("__f", lambda x: F.when(same, "").otherwise(x["side"]))
    j = j.withColumns({"brain_region": F.when(empty, F.col("__f.region")).otherwise(F.col("brain_region")),
                       "hemisphere": F.when(empty, sides).otherwise(F.col("hemisphere"))})
    bare = lambda r: F.regexp_replace(r, "-[lr]$", "")
    known = lambda r: F.array_distinct(F.transform(F.filter("__f", lambda x: x["region"] == bare(r)), lambda x: x["side"]))
    agreed = lambda r: F.coalesce(F.when(F.size(known(r)) == 1, known(r)[0]), F.lit(""))
    filled = F.transform("hemisphere", lambda h, i: F.when(F.coalesce(h, F.lit("")) != "", h).otherwise(
        F.coalesce(agreed(F.get("brain_region", i)), F.lit(""))))
    return j.withColumn("hemisphere", filled).drop("__f")


def fiber_coordinates(insertions: DataFrame, trajectories: DataFrame, tips) -> DataFrame:
    """Tip per insertion that has exactly one trajectory."""
    one = trajectories.groupBy("insertion").agg(F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(c) for c in ("x", "y", "z", "depth", "theta", "phi")])
    return tips(insertions.join(one.where("__n = 1").drop("__n"), "insertion"))


def subject_region(sessions: DataFrame) -> DataFrame:
    """Region list of a subject, only if all its sessions agree."""
    return _agreed(sessions, F.when(F.size("brain_region") > 0, F.col("brain_region")), "subject", "brain_region")


def frames_in_trials(frames: DataFrame, trials: DataFrame, keys: list[str], t: str, start: str, end: str, width: float) -> DataFrame:
    """Frames with start <= t <= end of a trial of the same session."""
    return interval_join(frames, trials, keys, t, start, end, width)


def trial_frame_window(trials: DataFrame, before: float = 0.1, after: float = 0.5) -> DataFrame:
    return trials.withColumns({"window_start": F.col("stimOn_times") - before, "window_end": F.col("feedback_times") + after})
