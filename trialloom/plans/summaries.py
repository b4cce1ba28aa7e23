"""Queries: runs, ranks, duplicates, scaling, and session or cohort summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom import constants as K
from trialloom.operators import aggregates as agg, derive, ordered
from trialloom.operators import signals as sig
from trialloom.plans.catalog import CON_SQL, TCOLS, TID, contrasted, qc_table, timed_trials
from trialloom.plans.inputs import INDEXED_SQL, NUMBERED_SQL, SESSIONS_SQL, SIGNAL_SQL, TRIAL_ORDER, TRIALS_SQL, with_sql
from trialloom.plans.registry import query, rnd
from trialloom.functions.scan import time_chunk

RUNS_SQL = NUMBERED_SQL + """, ch AS (SELECT *, CASE WHEN trial = 0 OR probabilityLeft <> lag(probabilityLeft) OVER (PARTITION BY eid ORDER BY trial) THEN 1 ELSE 0 END AS c FROM numbered),
 isl AS (SELECT *, sum(c) OVER (PARTITION BY eid ORDER BY trial) AS b FROM ch),
 runs AS (SELECT eid, b, min(probabilityLeft) AS probabilityLeft, min(trial) AS start, count(*) AS length FROM isl GROUP BY eid, b)"""


def blocks(t):
    return ordered.block_lengths(t.trials, ["eid"], TRIAL_ORDER, time_chunk("day", 180.0), "probabilityLeft")


@query("block_lengths", with_sql(RUNS_SQL, 'SELECT eid, probabilityLeft, "start", length FROM runs'))
def block_lengths(t):
    return blocks(t)


# Event types of a user's events as short blocks, so the length limit is met both ways.
TYPE_RUNS_SQL = INDEXED_SQL + """, ch AS (SELECT *, CASE WHEN idx = 0 OR (event_type = 'view') <> (lag(event_type) OVER (PARTITION BY eid ORDER BY idx) = 'view') THEN 1 ELSE 0 END AS c FROM idx_signal),
 isl AS (SELECT *, sum(c) OVER (PARTITION BY eid ORDER BY idx) AS b FROM ch), runs AS (SELECT eid, b, min(idx) AS st, count(*) AS length FROM isl GROUP BY eid, b),
 lst AS (SELECT *, st = max(st) OVER (PARTITION BY eid) AS is_last, count(*) OVER (PARTITION BY eid) AS nb FROM runs)"""


@query("block_structure", with_sql(TYPE_RUNS_SQL, "SELECT eid, min(length) AS min_block_length, count(*) AS n_blocks, bool_or(length < 3 AND (NOT is_last OR nb = 1)) AS flagged FROM lst GROUP BY eid"))
def block_structure(t):
    s = t.signal.withColumn("is_view", F.col("event_type") == "view")
    b = ordered.block_lengths(s.select("eid", "t", "event_id", "is_view"), ["eid"], ["t", "event_id"], time_chunk("t", 86400.0), "is_view")
    return ordered.block_structure(b, ["eid"], 3)


@query("training_blocks_valid", with_sql(TRIALS_SQL, "SELECT eid, event, bool_and(probabilityLeft = 0.5) AS valid FROM trials GROUP BY eid, event"))
def training_blocks_valid(t):
    return ordered.training_blocks_valid(t.trials, ["eid", "event"])


PLAN_SQL = INDEXED_SQL + """, pl AS (SELECT eid, unnest([7, 11, 5 + eid % 9, 20, 40]) AS len, unnest([0, 7, 18, 23 + eid % 9, 43 + eid % 9]) AS s, unnest(range(5)) AS block FROM (SELECT DISTINCT eid FROM signal)),
 ins AS (SELECT i.eid, i.idx, pl.block, i.k % 5 AS pos FROM idx_signal i JOIN pl ON pl.eid = i.eid AND i.idx >= s AND i.idx < s + len),
 lf AS (SELECT eid, min(k % 5) AS l FROM signal GROUP BY eid), sh AS (SELECT eid, block, avg(CASE WHEN pos = l THEN 1.0 ELSE 0.0 END) AS f FROM ins JOIN lf USING (eid) GROUP BY eid, block),
 rb AS (SELECT eid, block, CASE WHEN abs(0.5 - f) <= abs(0.2 - f) AND abs(0.5 - f) <= abs(0.8 - f) THEN 0.5::DOUBLE WHEN abs(0.2 - f) <= abs(0.8 - f) THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END AS p FROM sh)"""


def rebuilt(t):
    plans = t.signal.select("eid").distinct().select("eid", F.array(F.lit(7).cast("long"), F.lit(11).cast("long"), 5 + F.col("eid") % 9, F.lit(20).cast("long"), F.lit(40).cast("long")).alias("len_blocks"))
    tr = t.indexed_signal.select("eid", "idx", (F.col("k") % 5).alias("pos"), "k")
    return ordered.rebuild_probability(tr, plans, ["eid"], "idx", "pos", "len_blocks", [0.5, 0.2, 0.8], 16.0)


@query("rebuilt_probability", with_sql(PLAN_SQL, "SELECT ins.eid, ins.idx, ins.block, rb.p AS rebuilt FROM ins JOIN rb USING (eid, block)"))
def rebuilt_probability(t):
    return rebuilt(t).select("eid", "idx", F.col("block").cast("long").alias("block"), "rebuilt")


@query("block_match", with_sql(PLAN_SQL, "SELECT ins.eid, bool_and(rb.p = CASE WHEN block = 0 THEN 0.2 ELSE rb.p END) AS matches FROM ins JOIN rb USING (eid, block) GROUP BY ins.eid"))
def block_match(t):
    r = rebuilt(t).withColumn("probabilityLeft", F.when(F.col("block") == 0, 0.2).otherwise(F.col("rebuilt")))
    return ordered.block_match(r, ["eid"])


DUP_SQL = """d AS (SELECT o_orderkey AS eid, o_custkey % 50 AS subject, CAST(o_orderdate AS DATE) AS day, coalesce(o_orderkey % 3 = 0, false) AS bad, o_orderkey FROM orders WHERE o_custkey % 50 <> 7),
 r AS (SELECT *, row_number() OVER (PARTITION BY subject, day ORDER BY bad, o_orderkey) AS rn, first_value(o_orderkey) OVER (PARTITION BY subject, day ORDER BY o_orderkey) AS first, count(CASE WHEN NOT bad THEN 1 END) OVER (PARTITION BY subject, day) AS good FROM d)"""


def duplicates(t):
    s = t["orders"].select(F.col("o_orderkey").alias("eid"), F.when(F.col("o_custkey") % 50 != 7, F.col("o_custkey") % 50).alias("subject"), F.to_date("o_orderdate").alias("day"))
    return ordered.resolve_duplicates(s, ["subject", "day"], F.col("eid") % 3 == 0, ["eid"])


@query("resolve_duplicates", with_sql(DUP_SQL, "SELECT eid, subject, day FROM r WHERE rn = 1"))
def resolve_duplicates(t):
    return duplicates(t)[0]


@query("duplicate_log", with_sql(DUP_SQL, "SELECT first AS eid, 'TrueDuplicateSession' AS error_type, good || ' sessions without errors' AS error_message FROM r WHERE rn = 1 AND good > 1"))
def duplicate_log(t):
    return duplicates(t)[1]


@query("trial_type_order", with_sql(NUMBERED_SQL, """, s AS (SELECT eid, trial, feedbackType, coalesce(contrastRight, contrastLeft) AS c FROM numbered)
 SELECT eid, trial, row_number() OVER (PARTITION BY eid ORDER BY feedbackType, c DESC, trial) - 1 AS position FROM s"""))
def trial_type_order(t):
    s = t.numbered_trials.select("eid", "trial", "feedbackType", F.coalesce("contrastRight", "contrastLeft").alias("c"))
    return ordered.trial_type_order(s, ["eid"], "trial", "feedbackType", "c").select("eid", "trial", "position")


@query("snippet_window", with_sql(SIGNAL_SQL, """, u AS (SELECT eid, t / 3600 AS stim, CASE WHEN k % 7 <> 0 THEN t / 3600 + 1 END AS fb FROM signal), sp AS (SELECT eid, min(stim) AS t0, max(stim) AS t1 FROM u GROUP BY eid),
 w AS (SELECT eid, t0, unnest(generate_series(0, CAST(floor((t1 + 30 - 60 - t0) / 10) AS BIGINT))) AS k FROM sp),
 n AS (SELECT w.eid, w.t0, w.k, count(u.fb) AS n FROM w JOIN u ON u.eid = w.eid AND u.stim >= w.t0 + 10 * w.k AND u.stim <= w.t0 + 10 * w.k + 60 GROUP BY ALL HAVING count(u.fb) >= 8),
 b AS (SELECT eid, arg_max(k, struct_pack(n := n, k := -k)) AS k, max(n) AS n FROM n GROUP BY eid)
 SELECT sp.eid, rnd(t0 + coalesce(10 * k, 0)) AS t_start, rnd(t0 + coalesce(10 * k, 0) + 60) AS t_end, coalesce(n, 0) AS n_trials FROM sp LEFT JOIN b USING (eid)"""))
def snippet_window(t):
    s = t.signal.select("eid", (F.col("t") / 3600).alias("stim"), F.when(F.col("k") % 7 != 0, F.col("t") / 3600 + 1).alias("fb"))
    out = ordered.snippet_window(s, ["eid"], "stim", "fb")
    return out.select("eid", rnd("t_start").alias("t_start"), rnd("t_end").alias("t_end"), "n_trials")


@query("min_max_scale", "SELECT event_id, rnd((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0)) AS value FROM events WINDOW w AS (PARTITION BY user_id)")
def min_max_scale(t):
    return ordered.min_max_scale(t["events"].select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", rnd("value").alias("value"))


@query("baseline_coding", with_sql(TRIALS_SQL, f""", b AS (SELECT *, coalesce(contrastRight, contrastLeft) AS c, CASE WHEN wheel > 0 THEN ln(wheel) END AS lr FROM trials)
 SELECT {TID}, rnd((lr - avg(lr) OVER a) / nullif(stddev_samp(lr) OVER a, 0)) AS rt_z, rnd((l_tax - avg(l_tax) OVER s) / nullif(stddev_pop(l_tax) OVER s, 0)) AS baseline_z FROM b WINDOW a AS (PARTITION BY eid, c), s AS (PARTITION BY eid)"""))
def baseline_coding(t):
    tr = t.trials.withColumn("c", F.coalesce("contrastRight", "contrastLeft"))
    out = ordered.baseline_coding(tr.select(*TCOLS, "eid", "c", "wheel", "l_tax"), "eid", "c", "wheel", "l_tax")
    return out.select(*TCOLS, rnd("rt_z").alias("rt_z"), rnd("baseline_z").alias("baseline_z"))


@query("iqr_outliers", """WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM events GROUP BY user_id)
 SELECT event_id, (n >= 10 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) AS is_outlier FROM events JOIN q USING (user_id)""")
def iqr_outliers(t):
    return ordered.iqr_outliers(t["events"].select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", "is_outlier")


@query("ecdf", "SELECT event_type, value, n, rnd(cum / tot) AS cdf FROM (SELECT event_type, value, n, sum(n) OVER (PARTITION BY event_type ORDER BY value)::DOUBLE AS cum, sum(n) OVER (PARTITION BY event_type) AS tot FROM (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL))")
def ecdf(t):
    return ordered.ecdf(t["events"], ["event_type"], "value").select("event_type", "value", "n", rnd("cdf").alias("cdf"))


@query("best_session", with_sql(SESSIONS_SQL, "SELECT eid, price FROM sessions WHERE eid % 5 > 1 AND len(brain_region) > 0 ORDER BY price DESC, eid LIMIT 1"))
def best_session(t):
    return ordered.best_session(t.sessions, "price", (F.col("eid") % 5 > 1) & (F.size("brain_region") > 0)).select("eid", "price")


@query("biased_index", with_sql(SESSIONS_SQL, "SELECT eid, subject, row_number() OVER (PARTITION BY subject ORDER BY date_diff('day', DATE '1992-01-01', day), eid) AS biased_n FROM sessions WHERE session_type = 'biased'"))
def biased_index(t):
    b = t.sessions.where("session_type = 'biased'").withColumn("d", F.datediff("day", F.lit("1992-01-01").cast("date")))
    return ordered.running_index(b.select("eid", "subject", "d"), ["subject"], ["d", "eid"], "biased_n", 365).select("eid", "subject", "biased_n")


# --- aggregates -------------------------------------------------------------------------

@query("performance", with_sql(CON_SQL, """SELECT eid, count(*) AS n_trials, string_agg(DISTINCT CAST(contrast AS VARCHAR), ',' ORDER BY CAST(contrast AS VARCHAR)) AS contrasts,
 rnd(avg(CASE WHEN choice <> 0 THEN CASE WHEN feedbackType = 1 THEN 1.0 ELSE 0.0 END END)) AS fraction_correct, rnd(avg(CASE WHEN choice <> 0 AND contrast >= 0.5 THEN CASE WHEN feedbackType = 1 THEN 1.0 ELSE 0.0 END END)) AS fraction_correct_easy,
 rnd(avg(CASE WHEN choice = 0 THEN 1.0 ELSE 0.0 END)) AS nogo_fraction FROM con GROUP BY eid"""))
def performance(t):
    p = agg.performance(contrasted(t), ["eid"])
    return p.select("eid", "n_trials", F.array_join(F.sort_array(F.transform("contrasts", lambda x: x.cast("string"))), ",").alias("contrasts"),
                    *[rnd(c).alias(c) for c in ("fraction_correct", "fraction_correct_easy", "nogo_fraction")])


@query("performance_by_contrast", with_sql(CON_SQL, "SELECT eid, contrast, rnd(avg(CASE WHEN feedbackType = 1 THEN 1.0 ELSE 0.0 END)) AS fraction_correct FROM con WHERE choice <> 0 GROUP BY eid, contrast"))
def performance_by_contrast(t):
    return agg.performance_by_contrast(contrasted(t), ["eid"]).select("eid", "contrast", rnd("fraction_correct").alias("fraction_correct"))


QCS = "(SELECT l_suppkey AS eid, l_returnflag, avg(l_tax) * 3 AS u, sum(CASE WHEN l_tax = 0 AND l_discount = 0 THEN 1 ELSE 0 END) AS i FROM lineitem GROUP BY ALL)"


@query("qc_pass", f"SELECT eid, (min(u) > 0.1 AND max(i) = 0) AS all_pass, (max(u) > 0.1 AND min(i) = 0) AS any_pass FROM {QCS} GROUP BY eid")
def qc_pass(t):
    q = t["lineitem"].groupBy(F.col("l_suppkey").alias("eid"), "l_returnflag").agg(
        (F.avg("l_tax") * 3).alias("n_unique_samples"), F.count_if((F.col("l_tax") == 0) & (F.col("l_discount") == 0)).alias("n_band_inversions"))
    return agg.qc_pass(q, ["eid"], True).withColumnRenamed("qc_pass", "all_pass").join(agg.qc_pass(q, ["eid"], False).withColumnRenamed("qc_pass", "any_pass"), "eid")


STAGE_SQL = SESSIONS_SQL + """, sn AS (SELECT subject, session_type, dense_rank() OVER (PARTITION BY subject ORDER BY day) AS n FROM sessions),
 f AS (SELECT *, min(CASE WHEN session_type = 'biased' THEN n END) OVER (PARTITION BY subject) AS b, min(CASE WHEN session_type = 'ephys' THEN n END) OVER (PARTITION BY subject) AS e FROM sn),
 stages AS (SELECT subject, count(CASE WHEN session_type = 'training' THEN 1 END) AS n_training, count(CASE WHEN session_type = 'biased' THEN 1 END) AS n_biased, count(CASE WHEN session_type = 'ephys' THEN 1 END) AS n_ephys,
 CASE WHEN max(b) IS NOT NULL THEN count(CASE WHEN session_type = 'training' AND n < b THEN 1 END) END AS training_to_biased, CASE WHEN max(e) IS NOT NULL THEN count(CASE WHEN session_type = 'biased' AND n < e THEN 1 END) END AS biased_to_ephys FROM f GROUP BY subject)"""


def stages(t):
    return agg.stage_counts(derive.session_order(t.sessions))


@query("stage_counts", with_sql(STAGE_SQL, "SELECT * FROM stages"))
def stage_counts(t):
    return stages(t)


@query("subjects_by_stage", with_sql(SESSIONS_SQL, "SELECT DISTINCT session_type AS stage, subject FROM sessions"))
def subjects_by_stage(t):
    return agg.subjects_by_stage(t.sessions)


@query("monthly_qc", "SELECT strftime(o_orderdate, '%Y-%m') AS month, rnd(avg(CASE WHEN o_totalprice > 50000 THEN 0.0 ELSE 1.0 END)) AS fail_price, rnd(avg(o_totalprice), 3) AS tau_mean, rnd(stddev_samp(o_totalprice), 3) AS tau_std, count(o_totalprice) AS tau_n FROM orders GROUP BY 1")
def monthly_qc(t):
    m = agg.monthly_qc(t["orders"], "o_orderdate", {"price": F.col("o_totalprice") > 50000}, "o_totalprice")
    return m.select("month", rnd("fail_price").alias("fail_price"), rnd("tau_mean", 3).alias("tau_mean"), rnd("tau_std", 3).alias("tau_std"), "tau_n")


@query("pose_rollup", with_sql(SESSIONS_SQL, """, p AS (SELECT eid, session_type, fraction_correct AS fc, price / 500000 AS video_score, eid % 3 = 0 AS lp FROM sessions WHERE eid % 10 <> 0),
 a AS (SELECT eid, session_type, video_score, lp FROM p UNION ALL SELECT eid, session_type, -1.0, false FROM sessions WHERE eid % 10 = 0)
 SELECT a.eid, a.session_type, rnd(a.video_score) AS video_score, lp AS lp_exists, rnd(s.fraction_correct) AS fraction_correct FROM a JOIN sessions s USING (eid)"""))
def pose_rollup(t):
    s = t.sessions
    pose = s.where("eid % 10 <> 0").select("eid", "session_type", (F.col("price") / 500000).alias("video_score"), (F.col("eid") % 3 == 0).alias("lp_exists"))
    out = agg.pose_rollup(pose, s.where("eid % 5 = 0").join(pose.select("eid"), "eid", "left_anti"), s.select("eid", "fraction_correct"), K.ANALYSED_SESSION_TYPES)
    return out.select("eid", "session_type", rnd("video_score").alias("video_score"), "lp_exists", rnd("fraction_correct").alias("fraction_correct"))


@query("response_summary", with_sql(TRIALS_SQL, "SELECT target_NM, count(DISTINCT subject) AS n_subjects, count(DISTINCT eid) AS n_sessions, count(DISTINCT (eid, day, l_orderkey, l_linenumber, l_partkey)) AS n_trials FROM trials GROUP BY target_NM"))
def response_summary(t):
    return agg.response_summary(t.trials, "target_NM", "subject", "eid", ["eid", *TRIAL_ORDER])


@query("density_histogram", """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT o_orderstatus, least(CAST(floor((o_totalprice - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM orders, e GROUP BY ALL),
 g AS (SELECT s AS o_orderstatus, b AS bin FROM (SELECT unnest(['F', 'O', 'P', 'Z']) AS s), (SELECT unnest(range(20)) AS b))
 SELECT g.o_orderstatus, g.bin, rnd(lo + g.bin * (hi - lo) / 20, 3) AS edge, rnd(1e6 * coalesce(c.n / sum(c.n) OVER (PARTITION BY g.o_orderstatus) / ((hi - lo) / 20), 0)) AS density FROM g LEFT JOIN c USING (o_orderstatus, bin), e""")
def density_histogram(t):
    h = agg.density_histogram(t["orders"], "o_orderstatus", "o_totalprice", ["F", "O", "P", "Z"], 20)
    return h.select("o_orderstatus", "bin", rnd("edge", 3).alias("edge"), rnd(F.col("density") * 1e6).alias("density"))


@query("capacity_projection", """WITH c AS (SELECT o_orderpriority AS target_NM, count(CASE WHEN o_totalprice > 400000 THEN 1 END) AS n_analysis_ready, count(*) AS n_total FROM orders GROUP BY 1),
 p AS (SELECT *, n_analysis_ready::DOUBLE / n_total AS y, greatest(5000 - n_analysis_ready, 0) AS s FROM c)
 SELECT target_NM, n_analysis_ready, n_total, rnd(y) AS yield_rate, s AS shortfall, ceil(s / y) AS effective_sessions_needed, ceil(ceil(s / y) / 4) AS recording_days_needed,
 (SELECT count(*) FROM (SELECT unnest(generate_series(DATE '2024-01-03', DATE '2024-05-19', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6) AS days_available FROM p""")
def capacity_projection(t):
    c = t["orders"].groupBy(F.col("o_orderpriority").alias("target_NM")).agg(F.count_if(F.col("o_totalprice") > 400000).alias("n_analysis_ready"), F.count(F.lit(1)).alias("n_total"))
    out = agg.capacity_projection(c, "n_analysis_ready", "n_total", 5000, 4.0, F.lit("2024-01-03").cast("date"), F.lit("2024-05-20").cast("date"))
    return out.withColumn("yield_rate", rnd("yield_rate"))


DISP_SQL = """lng AS (SELECT l_suppkey AS eid, l_suppkey % 20 AS subject, 'f' || l_linenumber AS term, avg(l_quantity) AS coef, avg(l_tax) AS behav, l_suppkey % 3 AS cohort FROM lineitem GROUP BY l_suppkey, l_linenumber),
 zn AS (SELECT *, coalesce((coef - avg(coef) OVER w) / nullif(stddev_pop(coef) OVER w, 0), 0) AS z, coalesce((behav - avg(behav) OVER v) / nullif(stddev_pop(behav) OVER v, 0), 0) AS zb FROM lng WINDOW w AS (PARTITION BY cohort, term), v AS (PARTITION BY term)),
 va AS (SELECT subject, cohort, term, var_pop(z) AS v FROM zn GROUP BY ALL), dn AS (SELECT subject, cohort, sqrt(avg(v)) AS d FROM va GROUP BY ALL),
 nn AS (SELECT subject, cohort, count(DISTINCT eid) AS n FROM lng GROUP BY ALL)"""


def long_coefs(t):
    return t["lineitem"].groupBy(F.col("l_suppkey").alias("eid"), "l_linenumber").agg(F.avg("l_quantity").alias("coef"), F.avg("l_tax").alias("behav")).select(
        "eid", (F.col("eid") % 20).alias("subject"), (F.col("eid") % 3).alias("cohort"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("term"), "coef", "behav")


@query("feature_dispersion", with_sql(DISP_SQL, "SELECT subject, cohort, rnd(d) AS dispersion, n AS n_sessions FROM dn JOIN nn USING (subject, cohort)"))
def feature_dispersion(t):
    d = agg.feature_dispersion(long_coefs(t), ["subject", "cohort"], "eid", "term", "coef", "cohort")
    return d.select("subject", "cohort", rnd("dispersion").alias("dispersion"), "n_sessions")


@query("paired_dispersion", with_sql(DISP_SQL, """, vb AS (SELECT subject, cohort, term, var_pop(zb) AS v FROM zn GROUP BY ALL), db AS (SELECT subject, cohort, sqrt(avg(v)) AS d FROM vb GROUP BY ALL)
 SELECT subject, cohort, rnd(dn.d) AS neural, rnd(db.d) AS behavioral, n AS n_sessions FROM dn JOIN db USING (subject, cohort) JOIN nn USING (subject, cohort) WHERE n >= 2"""))
def paired_dispersion(t):
    lng = long_coefs(t)
    a = agg.feature_dispersion(lng, ["subject", "cohort"], "eid", "term", "coef", "cohort")
    b = agg.feature_dispersion(lng, ["subject", "cohort"], "eid", "term", "behav")
    p = agg.paired_dispersion(a, b, ["subject", "cohort"], 2)
    return p.select("subject", "cohort", rnd("neural").alias("neural"), rnd("behavioral").alias("behavioral"), F.col("n_neural").alias("n_sessions"))


@query("qc_rows", """WITH s AS (SELECT user_id AS eid, event_type AS metric, avg(value) AS score FROM events GROUP BY ALL)
 SELECT eid, rnd(max(CASE WHEN metric = 'click' THEN score END)) AS click, rnd(max(CASE WHEN metric = 'view' THEN score END)) AS "view", n FROM s JOIN (SELECT user_id AS eid, count(*) AS n FROM events GROUP BY 1) USING (eid) GROUP BY eid, n""")
def qc_rows(t):
    e = t["events"].select(F.col("user_id").alias("eid"), F.col("event_type").alias("metric"), F.col("value").alias("score"))
    out = agg.qc_rows(e, e.groupBy("eid").agg(F.count(F.lit(1)).alias("n")), ["eid"], ["click", "view"])
    return out.select("eid", rnd("click").alias("click"), rnd("view").alias("view"), "n")


@query("append_qc", """SELECT coalesce(a.eid, b.eid) AS eid, coalesce(CASE WHEN b.x > 0 THEN b.x END, a.x) AS x, a.y, b.z FROM
 (SELECT s_suppkey AS eid, s_acctbal AS x, s_nationkey AS y FROM supplier) a FULL JOIN (SELECT c_custkey AS eid, c_acctbal AS x, c_mktsegment AS z FROM customer WHERE c_custkey % 3 = 0) b USING (eid)""")
def append_qc(t):
    a = t["supplier"].selectExpr("s_suppkey AS eid", "s_acctbal AS x", "s_nationkey AS y")
    b = t["customer"].where("c_custkey % 3 = 0").selectExpr("c_custkey AS eid", "CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x", "c_mktsegment AS z")
    return agg.append_qc(a, b, ["eid"])


@query("mid_session_metric", with_sql(SIGNAL_SQL, """, m AS (SELECT *, (min(t) OVER (PARTITION BY eid) + max(t) OVER (PARTITION BY eid)) / 2 AS mid FROM signal)
 SELECT eid, rnd(avg(value)) AS value FROM m WHERE abs(t - mid) <= 300000 GROUP BY eid"""))
def mid_session_metric(t):
    return agg.mid_session_metric(t.signal, ["eid"], "t", "value", 300000.0).select("eid", rnd("value").alias("value"))


@query("session_event_times", with_sql(TRIALS_SQL, """, k AS (SELECT eid, 'cue' AS kind, stimOn_times AS tm FROM trials UNION ALL SELECT eid, 'movement', firstMovement_times FROM trials UNION ALL SELECT eid, CASE WHEN feedbackType = 1 THEN 'reward' ELSE 'omission' END, feedback_times FROM trials)
 SELECT eid, kind, count(*) AS n, rnd(sum(tm), 3) AS total FROM k WHERE tm IS NOT NULL GROUP BY eid, kind"""))
def session_event_times(t):
    return agg.session_event_times(t.trials, ["eid"]).groupBy("eid", "kind").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("time"), 3).alias("total"))
