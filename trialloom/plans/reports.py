"""Queries: report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators import aggregates as agg, derive, mixed, reports as rep
from trialloom.plans.catalog import REL_SQL, contrasted, recordings_view, timed_trials
from trialloom.plans.features import EMB, embeddings, vectors, VEC_SQL, CELL
from trialloom.plans.inputs import RECORDINGS_SQL, SESSIONS_SQL, TRIALS_SQL, with_sql
from trialloom.plans.models import KEY, TWO, SUB, lmm
from trialloom.plans.registry import query, rnd
from trialloom.plans.summaries import STAGE_SQL, stages
from trialloom.plans.windows import TIMED_SQL, timed_windows


@query("session_matrix", """WITH s AS (SELECT c_nationkey AS subject, c_custkey AS n, c_mktsegment AS seg, c_acctbal > 0 AS keep, c_name AS st FROM customer)
 SELECT subject, n AS session_n, seg AS category, CASE WHEN keep THEN seg END AS filtered, min(st) OVER (PARTITION BY subject) AS first_start FROM s""")
def session_matrix(t):
    s = t["customer"].selectExpr("c_nationkey AS subject", "c_custkey AS session_n", "c_mktsegment AS seg", "c_acctbal > 0 AS keep", "c_name AS start_time")
    return rep.session_matrix(s, F.col("keep"), "seg")


@query("target_overview", with_sql(RECORDINGS_SQL, """SELECT regexp_replace(brain_region, '-[lr]$', '') AS target, count(CASE WHEN session_type = 'training' THEN 1 END) AS n_training, count(CASE WHEN session_type = 'biased' THEN 1 END) AS n_biased,
 count(CASE WHEN session_type = 'ephys' THEN 1 END) AS n_ephys, count(DISTINCT subject) AS n_mice FROM recordings GROUP BY 1"""))
def target_overview(t):
    return rep.target_overview(targets(t), "target", "session_type", ["training", "biased", "ephys"])


def targets(t):
    return recordings_view(t).withColumn("target", F.regexp_replace("brain_region", "-[lr]$", ""))


@query("mouse_overview", with_sql(RECORDINGS_SQL, """, m AS (SELECT regexp_replace(brain_region, '-[lr]$', '') AS target, subject, count(DISTINCT CASE WHEN session_type IN ('biased', 'ephys') THEN eid END) AS be, count(DISTINCT CASE WHEN session_type = 'ephys' THEN eid END) AS e,
 count(CASE WHEN hemisphere = 'l' THEN 1 END) AS l, count(CASE WHEN hemisphere = 'r' THEN 1 END) AS r FROM recordings GROUP BY 1, 2)
 SELECT target, count(CASE WHEN be >= 2 THEN 1 END) AS mice_biased_ephys, count(CASE WHEN e >= 1 THEN 1 END) AS mice_ephys, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right FROM m GROUP BY target"""))
def mouse_overview(t):
    return rep.mouse_overview(targets(t), "target", "session_type", {"biased_ephys": (["biased", "ephys"], 2), "ephys": (["ephys"], 1)})


@query("stage_overview", with_sql(STAGE_SQL, "SELECT count(CASE WHEN n_training > 0 THEN 1 END) AS training, count(CASE WHEN n_biased + n_ephys >= 5 THEN 1 END) AS biased_ephys, count(CASE WHEN n_ephys >= 3 THEN 1 END) AS ephys FROM stages"))
def stage_overview(t):
    return rep.stage_overview(stages(t))


def results(t):
    return t["lineitem"].select("l_returnflag", "l_suppkey", (F.col("l_discount")).alias("p_value"), (F.col("l_extendedprice") / 1000).alias("r2"))


@query("significant_share", "SELECT l_returnflag, rnd(avg(CASE WHEN l_discount <= 0.05 THEN 1.0 ELSE 0.0 END)) AS share, count(*) AS n_units FROM lineitem GROUP BY 1")
def significant_share(t):
    return rep.significant_share(results(t), "l_returnflag").withColumn("share", rnd("share"))


@query("r2_by_significance", "SELECT l_returnflag, l_discount <= 0.05 AS significant, rnd(avg(l_extendedprice / 1000)) AS mean_r2, count(*) AS n FROM lineitem GROUP BY 1, 2")
def r2_by_significance(t):
    return rep.r2_by_significance(results(t), "l_returnflag", "r2").withColumn("mean_r2", rnd("mean_r2"))


@query("ordered_by_median", "WITH m AS (SELECT l_returnflag, l_suppkey, quantile_cont(l_extendedprice / 1000, 0.5) AS m FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_suppkey, rnd(m) AS median, row_number() OVER (PARTITION BY l_returnflag ORDER BY m, l_suppkey) AS position FROM m")
def ordered_by_median(t):
    out = rep.ordered_by_median(results(t), "l_returnflag", "l_suppkey", "r2")
    return out.select("l_returnflag", "l_suppkey", rnd("median").alias("median"), F.col("position").cast("long").alias("position"))


TRAJ_SQL = SESSIONS_SQL + ", tr AS (SELECT *, dense_rank() OVER (PARTITION BY subject ORDER BY day) AS session_n FROM sessions)"


@query("parameter_trajectory", with_sql(TRAJ_SQL, "SELECT session_n, rnd(avg(fraction_correct)) AS fraction_correct, count(fraction_correct) AS n FROM tr GROUP BY 1"))
def parameter_trajectory(t):
    s = derive.session_order(t.sessions).withColumn("has", F.size("brain_region") > 0)
    return rep.trajectory(s, "session_n", "fraction_correct", "subject", "has")[0].withColumn("fraction_correct", rnd("fraction_correct"))


@query("any_photometry", with_sql(SESSIONS_SQL, "SELECT subject, bool_or(len(brain_region) > 2) AS any_photometry FROM sessions GROUP BY 1"))
def any_photometry(t):
    s = t.sessions.withColumn("has", F.size("brain_region") > 2).withColumn("session_n", F.lit(1))
    return rep.trajectory(s, "session_n", "fraction_correct", "subject", "has")[1]


@query("box_table", """SELECT o_orderpriority, rnd(quantile_cont(o_totalprice, 0.25), 3) AS q1, rnd(quantile_cont(o_totalprice, 0.5), 3) AS median, rnd(quantile_cont(o_totalprice, 0.75), 3) AS q3, rnd(avg(o_totalprice), 3) AS mean, rnd(stddev_samp(o_totalprice), 3) AS sd, count(*) AS n,
 rnd(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 3) AS ci_lower FROM orders GROUP BY 1""")
def box_table(t):
    b = rep.box_table(t["orders"], ["o_orderpriority"], "o_totalprice")
    return b.select("o_orderpriority", *[rnd(c, 3).alias(c) for c in ("q1", "median", "q3", "mean", "sd", "ci_lower")], "n")


@query("subject_means", "WITH s AS (SELECT o_orderpriority, o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) SELECT o_orderpriority, rnd(avg(m), 3) AS mean, rnd(stddev_samp(m), 3) AS sd, count(*) AS n_subjects FROM s GROUP BY 1")
def subject_means(t):
    m = rep.subject_means(t["orders"], ["o_orderpriority"], "o_custkey", "o_totalprice")
    return m.select("o_orderpriority", rnd("mean", 3).alias("mean"), rnd("sd", 3).alias("sd"), "n_subjects")


CR_SQL = REL_SQL + """, a AS (SELECT *, response - avg(response) OVER (PARTITION BY target_NM, event, subject) + avg(response) OVER (PARTITION BY target_NM, event) AS r FROM rel),
 ok AS (SELECT *, count(r) OVER (PARTITION BY target_NM, event, subject, side, feedbackType, contrast) AS n FROM a)"""


def rel_trials(t):
    return derive.relative_contrast(contrasted(t))


@query("contrast_responses", with_sql(CR_SQL, "SELECT target_NM, event, side, feedbackType, contrast, rnd(avg(r), 5) AS mean, rnd(stddev_samp(r) / sqrt(count(r)), 5) AS sem, count(r) AS n FROM ok WHERE n > 10 GROUP BY ALL"))
def contrast_responses(t):
    c = rep.contrast_responses(rel_trials(t), ["target_NM", "event"], "response")
    return c.select("target_NM", "event", "side", "feedbackType", "contrast", rnd("mean", 5).alias("mean"), rnd("sem", 5).alias("sem"), "n")


@query("contrast_responses_by_subject", with_sql(CR_SQL, ", s AS (SELECT target_NM, event, subject, side, feedbackType, contrast, avg(r) AS r FROM ok WHERE n > 10 GROUP BY ALL) SELECT target_NM, event, side, feedbackType, contrast, rnd(avg(r), 5) AS mean, rnd(stddev_samp(r) / sqrt(count(r)), 5) AS sem, count(r) AS n FROM s GROUP BY ALL"))
def contrast_responses_by_subject(t):
    c = rep.contrast_responses(rel_trials(t), ["target_NM", "event"], "response", pooled=False)
    return c.select("target_NM", "event", "side", "feedbackType", "contrast", rnd("mean", 5).alias("mean"), rnd("sem", 5).alias("sem"), "n")


TR_SQL = TIMED_SQL + """, mt AS (SELECT eid, event, time, avg(response) AS response, count(DISTINCT trial) AS n_trials FROM win WHERE response IS NOT NULL GROUP BY ALL), su AS (SELECT *, eid % 10 AS subject FROM mt),
 fe AS (SELECT event, subject, arg_min(n_trials, struct_pack(e := eid, t := time)) AS n FROM su GROUP BY ALL HAVING n >= 5), tt AS (SELECT su.* FROM su JOIN fe USING (event, subject)),
 ba AS (SELECT *, response - coalesce(avg(CASE WHEN time >= -1 AND time < 0 THEN response END) OVER (PARTITION BY event, eid), 0) AS v FROM tt),
 ad AS (SELECT *, v - avg(v) OVER (PARTITION BY event, time, subject) + avg(v) OVER (PARTITION BY event, time) AS a FROM ba)"""


@query("mean_response_traces", with_sql(TR_SQL, "SELECT event, rnd(time) AS time, rnd(avg(a)) AS mean, rnd(CASE WHEN count(*) > 1 THEN stddev_samp(a) / sqrt(count(*)) ELSE 0 END) AS sem, count(*) AS n_recordings FROM ad GROUP BY event, time"))
def mean_response_traces(t):
    w = timed_windows(t).where("response IS NOT NULL").groupBy("eid", "event", "time").agg(F.avg("response").alias("response"), F.count_distinct("trial").alias("n_trials"))
    m = rep.mean_response_traces(w.withColumn("subject", F.col("eid") % 10), ["event"], ["eid"], baseline=(-1, 0))
    return m.select("event", rnd("time").alias("time"), rnd("mean").alias("mean"), rnd("sem").alias("sem"), "n_recordings")


KEYS = ["eid", "day", "l_orderkey", "l_linenumber", "l_partkey"]
RT_SQL = TRIALS_SQL + """, r AS (SELECT DISTINCT eid, day, l_orderkey, l_linenumber, l_partkey, target_NM, choice, firstMovement_times - stimOn_times AS rt FROM trials WHERE target_NM IN ('VTA-DA', 'DR-5HT') AND choice <> 0)"""


def rt_trials(t):
    tr = timed_trials(t)
    return rep.reaction_time_trials(tr.unionByName(tr).select(*KEYS, "target_NM"), tr.select(*KEYS, "choice", "reaction_time"), KEYS, "target_NM", ["VTA-DA", "DR-5HT"])


@query("reaction_time_trials", with_sql(RT_SQL, "SELECT eid, day, l_orderkey, l_linenumber, l_partkey, target_NM, CASE WHEN rt > 0 THEN rnd(log10(rt)) END AS log_rt FROM r"))
def reaction_time_trials(t):
    return rt_trials(t).select("eid", F.col("day").cast("long").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "target_NM", rnd("log_rt").alias("log_rt"))


@query("shared_range", with_sql(RT_SQL, "SELECT rnd(min(log10(rt))) AS low, rnd(max(log10(rt))) AS high FROM r WHERE rt > 0"))
def shared_range(t):
    return rep.shared_range(rt_trials(t), "log_rt").select(rnd("low").alias("low"), rnd("high").alias("high"))


@query("mean_vectors", with_sql(VEC_SQL, """, m AS (SELECT eid % 5 AS target, event, contrast, side, feedbackType, avg(value) AS m FROM vec GROUP BY ALL)
 SELECT target, event, contrast, side, feedbackType, rnd(m) AS mean, rnd((m - min(m) OVER w) / nullif(max(m) OVER w - min(m) OVER w, 0)) AS scaled FROM m WINDOW w AS (PARTITION BY target)"""))
def mean_vectors(t):
    v = vectors(t).withColumn("target", F.col("eid") % 5)
    return rep.mean_vectors(v, "target", CELL, "value").select("target", *CELL, rnd("mean").alias("mean"), rnd("scaled").alias("scaled"))


@query("similarity_order", with_sql(EMB, "SELECT vec_id, row_number() OVER (ORDER BY label, subject, vec_id) - 1 AS position FROM emb"))
def similarity_order(t):
    return rep.similarity_order(embeddings(t), "label", "subject", "vec_id").select("vec_id", "position")


@query("fold_table")
def fold_table(t):
    g, s = lmm(t, TWO)
    f = rep.fold_table(mixed.crossval(g, s, KEY, SUB, TWO, ["l_quantity", "l_tax"]), [*KEY, "predictor"])
    return f.select("l_returnflag", "predictor", "fold", *[rnd(c, 5).alias(c) for c in ("r2", "aggregate_r2")])


@query("persession_grid", """WITH m AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT s_suppkey, abs(s_acctbal) / 100000 AS p FROM supplier WHERE s_suppkey % 3 <> 0)
 SELECT l_returnflag, l_suppkey, rnd(m) AS mean, n AS n_sessions, coalesce(p < 0.05, false) AS significant, row_number() OVER (PARTITION BY l_returnflag ORDER BY m, l_suppkey) AS position FROM m LEFT JOIN p ON l_suppkey = s_suppkey""")
def persession_grid(t):
    li = t["lineitem"]
    p = t["supplier"].where("s_suppkey % 3 <> 0").select(F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("l_returnflag"), F.col("s_suppkey").alias("l_suppkey"), (F.abs("s_acctbal") / 100000).alias("p_value"))
    g = rep.persession_grid(li, p, ["l_returnflag"], "l_suppkey", "l_quantity")
    return g.select("l_returnflag", "l_suppkey", rnd("mean").alias("mean"), "n_sessions", "significant", F.col("position").cast("long").alias("position"))


@query("coefficient_matrix", """SELECT l_linestatus AS term, max(CASE WHEN l_returnflag = 'A' THEN c END) AS A, max(CASE WHEN l_returnflag = 'R' THEN c END) AS R FROM
 (SELECT l_linestatus, l_returnflag, printf('%.2f', count(*) / 4.0) || CASE WHEN min(l_tax) < 0.001 THEN '***' ELSE '' END AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def coefficient_matrix(t):
    c = t["lineitem"].groupBy(F.col("l_linestatus").alias("term"), "l_returnflag").agg((F.count(F.lit(1)) / 4).alias("coef"), F.min("l_tax").alias("p"))
    return rep.coefficient_matrix(c, "term", "l_returnflag", ["A", "R"])


@query("projection_matrix", "SELECT l_linestatus, rnd(avg(CASE WHEN l_returnflag = 'A' THEN l_tax END)) AS A, rnd(avg(CASE WHEN l_returnflag = 'N' THEN l_tax END)) AS N FROM lineitem GROUP BY 1")
def projection_matrix(t):
    p = t["lineitem"].groupBy("l_linestatus", "l_returnflag").agg(rnd(F.avg("l_tax")).alias("v"))
    return rep.projection_matrix(p, "l_linestatus", "l_returnflag", "v", ["A", "N"])
