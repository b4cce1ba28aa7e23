"""Queries: event-locked windows (events table as a signal)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators import windows as op
from trialloom.plans.inputs import INDEXED_SQL, Tables, with_sql
from trialloom.plans.registry import query, rnd

DAY = 86400.0
KEYS = ["eid", "event", "trial"]
# The events table has one sample every few hours: 10 hours are the time unit here.
UNIT = 36000.0


def index_windows(t: Tables):
    """Samples -5..+9 around every error event, by sample index."""
    s = t.indexed("event_type", "value")
    anchors = s.where("event_type = 'error'").select(
        "eid", F.col("event_id").alias("trial"), "idx", F.lit(-5).cast("long").alias("lo"), F.lit(9).cast("long").alias("hi"))
    bounds = s.groupBy("eid").agg(F.max("idx").alias("last"))
    anchors = anchors.join(bounds, "eid").withColumn(
        "anchor", F.when((F.col("idx") - 5 >= 0) & (F.col("idx") + 9 <= F.col("last")), F.col("idx"))).drop("last", "idx")
    rows = op.windows_at_index(s.select("eid", "idx", "value"), anchors, ["eid"], "idx", ["value"], "anchor", "lo", "hi")
    return rows.select("eid", "trial", F.col("offset").cast("double").alias("time"), "offset", F.col("value").alias("response"))


INDEX_WINDOWS_SQL = INDEXED_SQL + """, last AS (SELECT eid, max(idx) AS last FROM idx_signal GROUP BY eid),
 anchors AS (SELECT e.eid, e.event_id AS trial, e.idx, (e.idx - 5 >= 0 AND e.idx + 9 <= l.last) AS good
  FROM idx_signal e JOIN last l USING (eid) WHERE event_type = 'error'),
 win AS (SELECT a.eid, a.trial, o.off AS "offset", CAST(o.off AS DOUBLE) AS time, CASE WHEN good THEN s.value END AS response
  FROM anchors a CROSS JOIN (SELECT unnest(generate_series(-5, 9)) AS off) o
  LEFT JOIN idx_signal s ON s.eid = a.eid AND s.idx = a.idx + o.off)"""


@query("event_response_means", with_sql(INDEX_WINDOWS_SQL + """, base AS (
 SELECT *, response - avg(CASE WHEN time >= -5 AND time < 0 THEN response END) OVER (PARTITION BY eid, trial) AS r FROM win),
 mag AS (SELECT eid, trial, avg(CASE WHEN time >= 0 AND time < 5 THEN r END) AS m FROM base GROUP BY eid, trial)""",
    "SELECT eid, count(m) AS n_trials, rnd(avg(m), 6) AS mean_response FROM mag GROUP BY eid"))
def event_response_means(t):
    rows = op.subtract_baseline(index_windows(t), ["eid", "trial"], (-5, 0))
    mag = op.response_magnitude(rows, ["eid", "trial"], (0, 5))
    return mag.groupBy("eid").agg(F.count("response").alias("n_trials"), rnd(F.avg("response")).alias("mean_response"))


def trial_events(t: Tables):
    """click rows as trials: stimulus = the row's time, feedback k * 20 minutes later."""
    return t.signal.where("event_type = 'click'").select(
        "eid", F.col("event_id").alias("trial"), (F.col("t") / UNIT).alias("stimOn_times"),
        F.when(F.col("k") != 50, F.col("t") / UNIT + F.col("k") / 30).alias("feedback_times"),
    )


def unit_signal(t: Tables):
    return t.indexed("value").select("eid", "idx", (F.col("t") / UNIT).alias("u"), "value", ((F.col("t_next") - F.col("t")) / UNIT).alias("step"))


def timed_windows(t: Tables, end=False):
    s = unit_signal(t)
    rates = op.sampling_rates(s, ["eid"], "u", 4.0, "step").withColumn("fs", F.greatest("fs", F.lit(1).cast("long")))
    if end:
        ev = trial_events(t)
        return op.event_windows(s, ev, keys=["eid"], t="u", idx="idx", value="value", event_time="stimOn_times",
                                t0=-2.0, t1=0.0, rates=rates, chunk_width=4.0, end_time="feedback_times")
    ev = op.unpivot_events(trial_events(t), ["eid", "trial"], ["stimOn_times", "feedback_times"])
    return op.event_windows(s, ev, keys=["eid"], t="u", idx="idx", value="value", event_time="event_time",
                            t0=-2.0, t1=4.0, rates=rates, chunk_width=4.0)


TRIAL_EVENTS_SQL = INDEXED_SQL + """, us AS (SELECT eid, idx, t / 36000.0::DOUBLE AS u, value FROM idx_signal),
 rates AS (SELECT eid, greatest(1, CAST(round_even(1 / quantile_cont(dt, 0.5), 0) AS BIGINT)) AS fs FROM
  (SELECT eid, lead(u) OVER (PARTITION BY eid ORDER BY u) - u AS dt FROM us) GROUP BY eid HAVING count(dt) > 0),
 bounds AS (SELECT eid, min(u) AS tmin, max(u) AS tmax, max(idx) AS last FROM us GROUP BY eid),
 tr AS (SELECT eid, event_id AS trial, t / 36000.0::DOUBLE AS stimOn_times,
  CASE WHEN k <> 50 THEN t / 36000.0::DOUBLE + k / 30.0::DOUBLE END AS feedback_times FROM signal WHERE event_type = 'click')"""
TIMED_SQL = TRIAL_EVENTS_SQL + """, ev AS (SELECT eid, trial, 'stimOn_times' AS event, stimOn_times AS event_time FROM tr
  UNION ALL SELECT eid, trial, 'feedback_times', feedback_times FROM tr),
 anc AS (SELECT ev.eid, ev.trial, ev.event, ev.event_time, a.idx AS anchor FROM ev ASOF LEFT JOIN us a ON ev.eid = a.eid AND a.u >= ev.event_time),
 pl AS (SELECT anc.*, r.fs, b.last, coalesce(event_time - 2.0 >= tmin AND event_time + 4.0 <= tmax, false) AS good
  FROM anc JOIN rates r USING (eid) JOIN bounds b USING (eid)),
 offs AS (SELECT *, unnest(generate_series(-2 * fs, 4 * fs - 1)) AS off FROM pl),
 win AS (SELECT o.eid, o.trial, o.event, o.event_time, o.off AS "offset", o.off / o.fs::DOUBLE AS time, CASE WHEN good THEN s.value END AS response
  FROM offs o LEFT JOIN us s ON s.eid = o.eid AND s.idx = least(greatest(o.anchor + o.off, 0), o.last))"""


@query("event_windows", with_sql(TIMED_SQL, 'SELECT eid, trial, event, "offset", rnd(time, 6) AS time, response FROM win'))
def event_windows(t):
    return timed_windows(t).select("eid", "trial", "event", "offset", rnd("time").alias("time"), "response")


@query("event_windows_with_end", with_sql(TRIAL_EVENTS_SQL + """, ln AS (SELECT eid, coalesce(max(feedback_times - stimOn_times), 2.0) AS len FROM tr GROUP BY eid),
 anc AS (SELECT tr.eid, tr.trial, tr.stimOn_times, tr.feedback_times, a.idx AS anchor FROM tr ASOF LEFT JOIN us a ON tr.eid = a.eid AND a.u >= tr.stimOn_times),
 pl AS (SELECT anc.*, r.fs, b.last, CAST(round_even(-2.0 * fs, 0) AS BIGINT) AS lo, CAST(round_even(len * fs, 0) AS BIGINT) - 1 AS hi,
  coalesce(stimOn_times - 2.0 >= tmin AND stimOn_times + len <= tmax, false) AS good
  FROM anc JOIN rates r USING (eid) JOIN bounds b USING (eid) JOIN ln USING (eid)),
 offs AS (SELECT *, unnest(generate_series(lo, hi)) AS off FROM pl)""",
    """SELECT o.eid, o.trial, o.off AS "offset", rnd(o.off / o.fs::DOUBLE, 6) AS time,
 CASE WHEN good AND (feedback_times IS NULL OR o.off / o.fs::DOUBLE <= feedback_times - stimOn_times) THEN s.value END AS response
 FROM offs o LEFT JOIN us s ON s.eid = o.eid AND s.idx = least(greatest(o.anchor + o.off, 0), o.last)"""))
def event_windows_with_end(t):
    return timed_windows(t, end=True).select("eid", "trial", "offset", rnd("time").alias("time"), "response")


@query("response_magnitudes", with_sql(TIMED_SQL,
    "SELECT eid, event, trial, rnd(avg(CASE WHEN time >= 1 AND time < 3 THEN response END), 6) AS response FROM win GROUP BY eid, event, trial"))
def response_magnitudes(t):
    return op.response_magnitude(timed_windows(t), KEYS, (1, 3)).withColumn("response", rnd("response"))


@query("baseline_subtraction", with_sql(TIMED_SQL,
    """SELECT eid, event, trial, "offset", rnd(response - avg(CASE WHEN time >= -2 AND time < 0 THEN response END) OVER (PARTITION BY eid, event, trial), 6) AS response FROM win"""))
def baseline_subtraction(t):
    return op.subtract_baseline(timed_windows(t), KEYS, (-2, 0)).select(*KEYS, "offset", rnd("response").alias("response"))


def masked(t):
    rows = timed_windows(t).join(trial_events(t), ["eid", "trial"])
    return op.mask_subsequent_events(rows, ["stimOn_times", "feedback_times"])


MASKED_SQL = TIMED_SQL + """, masked AS (SELECT w.eid, w.event, w.trial, w."offset", w.time,
 CASE WHEN event = 'stimOn_times' AND feedback_times - stimOn_times IS NOT NULL AND time > feedback_times - stimOn_times THEN NULL ELSE response END AS response
 FROM win w JOIN tr USING (eid, trial))"""


@query("mask_next_event", with_sql(MASKED_SQL, 'SELECT eid, event, trial, "offset", response FROM masked'))
def mask_next_event(t):
    return masked(t).select(*KEYS, "offset", "response")


@query("normalized_responses", with_sql(TIMED_SQL, """SELECT eid, event, trial, "offset", rnd((response - b) / nullif(b, 0), 6) AS response FROM (
 SELECT *, CASE WHEN count(CASE WHEN time >= -2 AND time < 0 THEN response END) OVER w = count(CASE WHEN time >= -2 AND time < 0 THEN 1 END) OVER w
  THEN avg(CASE WHEN time >= -2 AND time < 0 THEN response END) OVER w END AS b FROM win WINDOW w AS (PARTITION BY eid, event, trial))"""))
def normalized_responses(t):
    return op.normalize_responses(timed_windows(t), KEYS, (-2, 0), divide=True).select(*KEYS, "offset", rnd("response").alias("response"))


@query("response_traces", with_sql(MASKED_SQL, """SELECT eid, event, trial, "offset", rnd(response - avg(CASE WHEN time >= -1 AND time < 0 THEN response END)
 OVER (PARTITION BY eid, event, trial), 6) AS response FROM masked"""))
def response_traces(t):
    rows = timed_windows(t).join(trial_events(t), ["eid", "trial"])
    return op.response_traces(rows, KEYS, ["stimOn_times", "feedback_times"], (-1, 0)).select(*KEYS, "offset", rnd("response").alias("response"))


@query("window_delta", with_sql(TIMED_SQL, """SELECT eid, event, rnd(
 CASE WHEN count(CASE WHEN time >= 0 AND time < 3 THEN response END) >= 5 THEN avg(CASE WHEN time >= 0 AND time < 3 THEN response END) END -
 CASE WHEN count(CASE WHEN time >= -2 AND time < 0 THEN response END) >= 5 THEN avg(CASE WHEN time >= -2 AND time < 0 THEN response END) END, 6) AS delta
 FROM win GROUP BY eid, event"""))
def window_delta(t):
    return op.window_delta(timed_windows(t), ["eid", "event"], (0, 3), (-2, 0), 5).withColumn("delta", rnd("delta"))


@query("peak_velocity", with_sql(TIMED_SQL, "SELECT eid, event, trial, max(abs(response - 100)) AS peak_velocity FROM win GROUP BY eid, event, trial"))
def peak_velocity(t):
    return op.peak_velocity(timed_windows(t).withColumn("response", F.col("response") - 100), KEYS, "response")


@query("mean_traces", with_sql(TIMED_SQL, """, means AS (SELECT eid, event, time, avg(response) AS r FROM win GROUP BY eid, event, time),
 f AS (SELECT eid, event, min("offset") AS first FROM win GROUP BY eid, event),
 n AS (SELECT w.eid, w.event, count(DISTINCT trial) AS n FROM win w JOIN f ON f.eid = w.eid AND f.event = w.event AND w."offset" = f.first WHERE response IS NOT NULL GROUP BY w.eid, w.event)
 SELECT eid, event, rnd(time, 6) AS time, rnd(r, 6) AS response, coalesce(n, 0) AS n_trials FROM means LEFT JOIN n USING (eid, event)"""))
def mean_traces(t):
    out = op.mean_traces(timed_windows(t), ["eid", "event"], ["trial"])
    return out.select("eid", "event", rnd("time").alias("time"), rnd("response").alias("response"), "n_trials")


@query("session_panels", with_sql(TIMED_SQL, """SELECT eid, event, rnd(time, 6) AS time, rnd(avg(response), 6) AS response FROM win
 WHERE eid IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY eid, event, time"""))
def session_panels(t):
    allowed = t["events"].where("event_type = 'purchase'").select(F.col("user_id").alias("eid"))
    out = op.session_panels(timed_windows(t), ["eid", "event"], allowed)
    return out.select("eid", "event", rnd("time").alias("time"), rnd("response").alias("response"))
