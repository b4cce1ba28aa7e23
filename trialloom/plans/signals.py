"""Queries: resampling, cross-correlation, quality and cleaning (events table as a signal)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators import signals as op
from trialloom.plans.inputs import INDEXED_SQL, SIGNAL_SQL, with_sql
from trialloom.plans.registry import query, rnd

DAY = 86400.0
FS = 1 / 7200.0
QUALITY_UNIT = 7200.0
QUALITY_START = 5  # the first samples lie before the first window


@query("resample_linear", with_sql(SIGNAL_SQL, """, kn AS (SELECT eid, t, value, lead(t) OVER w AS t1, lead(value) OVER w AS v1, min(t) OVER (PARTITION BY eid) AS s
  FROM signal WINDOW w AS (PARTITION BY eid ORDER BY t)),
 g AS (SELECT *, unnest(generate_series(CAST(ceil(round((t - s) / 7200, 9)) AS BIGINT), CAST(ceil(round((t1 - s) / 7200, 9)) AS BIGINT) - 1)) AS grid FROM kn WHERE t1 IS NOT NULL)
 SELECT eid, grid, rnd(value + (s + grid * 7200 - t) / (t1 - t) * (v1 - value)) AS value FROM g"""))
def resample_linear(t):
    return op.resample_linear(t.signal, ["eid"], "t", "value", FS, DAY).select("eid", "grid", rnd("value").alias("value"))


PCHIP_SQL = """, kn AS (SELECT eid, t, value, lead(t) OVER w - t AS hf, t - lag(t) OVER w AS hb,
   (lead(value) OVER w - value) / (lead(t) OVER w - t) AS df, (value - lag(value) OVER w) / (t - lag(t) OVER w) AS db,
   min(t) OVER (PARTITION BY eid) AS s FROM signal WINDOW w AS (PARTITION BY eid ORDER BY t)),
 k2 AS (SELECT *, coalesce(hb, hf) AS h0, coalesce(db, df) AS d0,
   CASE WHEN hb IS NULL THEN lead(hf) OVER w ELSE lag(hb) OVER w END AS h1, CASE WHEN db IS NULL THEN lead(df) OVER w ELSE lag(db) OVER w END AS d1
   FROM kn WINDOW w AS (PARTITION BY eid ORDER BY t)),
 k3 AS (SELECT *, ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1) AS e FROM k2),
 k4 AS (SELECT *, CASE WHEN hb IS NOT NULL AND hf IS NOT NULL THEN
   CASE WHEN sign(db) * sign(df) <= 0 THEN 0 ELSE (3 * hf + 3 * hb) / ((2 * hf + hb) / db + (hf + 2 * hb) / df) END
   ELSE CASE WHEN d1 IS NULL THEN d0 WHEN sign(e) <> sign(d0) THEN 0 WHEN sign(d0) <> sign(d1) AND abs(e) > 3 * abs(d0) THEN 3 * d0 ELSE e END END AS m FROM k3),
 k5 AS (SELECT *, lead(m) OVER w AS mn, lead(value) OVER w AS vn, lead(t) OVER w AS tn FROM k4 WINDOW w AS (PARTITION BY eid ORDER BY t)),
 g AS (SELECT *, unnest(generate_series(CAST(ceil(round((t - s) / 7200, 9)) AS BIGINT), CAST(ceil(round((tn - s) / 7200, 9)) AS BIGINT) - 1)) AS grid FROM k5 WHERE tn IS NOT NULL),
 x AS (SELECT *, (s + grid * 7200 - t) / hf AS x FROM g)"""


@query("pchip_resample", with_sql(SIGNAL_SQL, PCHIP_SQL + """
 SELECT eid, grid, rnd((1 + 2 * x) * (1 - x) * (1 - x) * value + x * (1 - x) * (1 - x) * hf * m + x * x * (3 - 2 * x) * vn + x * x * (x - 1) * hf * mn) AS value FROM x"""))
def pchip_resample(t):
    return op.pchip_resample(t.signal, ["eid"], "t", "value", FS, DAY).select("eid", "grid", rnd("value").alias("value"))


@query("quadratic_interpolation")
def quadratic_interpolation(t):
    return op.quadratic_spline(t.indexed("value"), ["eid"], "idx", "t", "value", FS).select("eid", "grid", rnd("value").alias("value"))


def _pose(t):
    return t.signal.select("eid", "t", F.col("value").alias("x"), F.col("k").cast("double").alias("y"),
                           F.when(F.col("event_type") == "view", 0.5).otherwise(0.95).alias("lik"), "event_id")


@query("keypoint_speed", with_sql(SIGNAL_SQL, """SELECT event_id, eid, CASE WHEN event_type <> 'view' THEN
 rnd(sqrt(pow(value - lag(value) OVER w, 2) + pow(k - lag(k) OVER w, 2))) END AS speed FROM signal WINDOW w AS (PARTITION BY eid ORDER BY t)"""))
def keypoint_speed(t):
    return op.keypoint_speed(_pose(t), ["eid"], "t", "x", "y", "lik", DAY).select("event_id", "eid", rnd("speed").alias("speed"))


@query("movement_trace", with_sql(SIGNAL_SQL, """, sp AS (SELECT eid, t, CASE WHEN event_type <> 'view' THEN
 sqrt(pow(value - lag(value) OVER w, 2) + pow(k - lag(k) OVER w, 2)) END AS speed FROM signal WINDOW w AS (PARTITION BY eid ORDER BY t))
 SELECT eid, CAST(floor(t / 86400) AS BIGINT) AS day, rnd(sum(speed), 5) AS trace FROM sp GROUP BY eid, floor(t / 86400)"""))
def movement_trace(t):
    s = op.keypoint_speed(_pose(t), ["eid"], "t", "x", "y", "lik", DAY).withColumn("day", F.floor(F.col("t") / DAY))
    return op.movement_trace(s, ["eid", "day"], "speed").select("eid", "day", rnd("trace", 5).alias("trace"))


XC_SQL = INDEXED_SQL + """, n AS (SELECT eid, max(idx) + 1 AS n FROM idx_signal GROUP BY eid),
 th AS (SELECT i.eid, least((i.idx * 3) // n.n, 2) AS third, i.idx, i.value AS a, i.k AS b, n.n FROM idx_signal i JOIN n USING (eid)),
 st AS (SELECT *, avg(a) OVER w AS ma, stddev_pop(a) OVER w AS sa, avg(b) OVER w AS mb, stddev_pop(b) OVER w AS sb, count(*) OVER w AS cnt FROM th WINDOW w AS (PARTITION BY eid, third)),
 z AS (SELECT eid, third, idx, cnt, (a - ma) / nullif(sa, 0) AS za, (b - mb) / nullif(sb, 0) AS zb FROM st),
 cc AS (SELECT x.eid, x.third, l.lag, sum(CASE WHEN y.idx IS NOT NULL THEN x.za * y.zb ELSE 0 END) / max(x.cnt) AS cc FROM z x CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS lag) l
  LEFT JOIN z y ON y.eid = x.eid AND y.third = x.third AND y.idx = x.idx + l.lag GROUP BY x.eid, x.third, l.lag)"""


def _thirds_cc(t):
    s = op.session_thirds(t.indexed("value", "k").select("eid", "idx", "value", F.col("k").cast("double").alias("k")), ["eid"], "idx")
    return op.lagged_crosscorr(s, ["eid", "third"], "idx_in_third", "value", "k", 5)


@query("crosscorr_by_third", with_sql(XC_SQL, 'SELECT eid, third, "lag", rnd(cc) AS cc FROM cc'))
def crosscorr_by_third(t):
    return _thirds_cc(t).select("eid", "third", "lag", rnd("cc").alias("cc"))


@query("crosscorr_drift", with_sql(XC_SQL, """, pk AS (SELECT eid, third, arg_max("lag", struct_pack(c := round(cc, 9), l := -"lag")) AS l FROM cc GROUP BY eid, third)
 SELECT eid, CAST(max(CASE WHEN third = 0 THEN l END) AS DOUBLE) AS lag_early, CAST(max(CASE WHEN third = 1 THEN l END) AS DOUBLE) AS lag_mid, CAST(max(CASE WHEN third = 2 THEN l END) AS DOUBLE) AS lag_late,
 CAST(max(CASE WHEN third = 2 THEN l END) - max(CASE WHEN third = 0 THEN l END) AS DOUBLE) AS drift FROM pk GROUP BY eid"""))
def crosscorr_drift(t):
    cc = _thirds_cc(t).withColumn("cc", F.round("cc", 9))
    return op.crosscorr_drift(op.crosscorr_peaks(cc, ["eid", "third"], 1.0), ["eid"])


@query("wheel_velocity", with_sql(SIGNAL_SQL, """, kn AS (SELECT eid, t, value, lead(t) OVER w AS t1, lead(value) OVER w AS v1, min(t) OVER (PARTITION BY eid) AS s
  FROM signal WINDOW w AS (PARTITION BY eid ORDER BY t)),
 g AS (SELECT *, unnest(generate_series(CAST(ceil(round((t - s) / 7200, 9)) AS BIGINT), CAST(ceil(round((t1 - s) / 7200, 9)) AS BIGINT) - 1)) AS grid FROM kn WHERE t1 IS NOT NULL),
 p AS (SELECT eid, grid, value + (s + grid * 7200 - t) / (t1 - t) * (v1 - value) AS v FROM g)
 SELECT eid, grid, rnd(1e4 / 7200 * CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w
  ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END) AS velocity FROM p WINDOW w AS (PARTITION BY eid ORDER BY grid)"""))
def wheel_velocity(t):
    return op.wheel_velocity(t.signal, ["eid"], "t", "value", FS, DAY).select("eid", "grid", rnd(F.col("velocity") * 1e4).alias("velocity"))


@query("raw_qc", with_sql(SIGNAL_SQL, "SELECT eid, CAST(sum(CASE WHEN value < k THEN 1 ELSE 0 END) AS BIGINT) AS n_band_inversions, CAST(sum(CASE WHEN t < 86400 THEN 1 ELSE 0 END) AS BIGINT) AS n_early_samples FROM signal GROUP BY eid"))
def raw_qc(t):
    return op.raw_qc(t.signal, ["eid"], "t", "value", "k", F.lit(DAY))


QUALITY_SQL = SIGNAL_SQL + """, u AS (SELECT eid, t / 7200.0::DOUBLE - 5 AS u, value FROM signal),
 w AS (SELECT *, unnest(generate_series(greatest(CAST(floor((u - 120) / 60) AS BIGINT) + 1, 0), CAST(floor(u / 60) AS BIGINT))) AS win FROM u WHERE u >= 0),
 d AS (SELECT *, value - coalesce(regr_slope(value, u) OVER p * u + regr_intercept(value, u) OVER p, avg(value) OVER p) AS r FROM w WINDOW p AS (PARTITION BY eid, win)),
 m AS (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY eid, win) AS med, lag(r) OVER (PARTITION BY eid, win ORDER BY u) AS prev FROM d),
 q AS (SELECT eid, win, count(DISTINCT value)::DOUBLE / count(*) AS nu, quantile_cont(abs(r - med), 0.5) AS mad, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.75) AS p75,
  quantile_cont(value, 0.5) AS lev, regr_slope(r, prev) AS ar, count(*) AS n FROM m GROUP BY eid, win)"""


def _quality_samples(t):
    return t.signal.select("eid", (F.col("t") / QUALITY_UNIT - QUALITY_START).alias("u"), "value")


@query("window_quality", with_sql(QUALITY_SQL, """SELECT eid, win AS "window", rnd(nu) AS n_unique_samples, rnd(mad) AS median_absolute_deviance, rnd((p75 - p25) / nullif(lev, 0)) AS percentile_distance,
 rnd((p75 - p50) / nullif(p50 - p25, 0)) AS percentile_asymmetry FROM q"""))
def window_quality(t):
    q = op.window_quality(op.sliding_windows(_quality_samples(t), ["eid"], "u"), ["eid", "window"], "u", "value")
    return q.select("eid", "window", *[rnd(m).alias(m) for m in op.QUALITY_METRICS[:4]])


@query("sliding_qc", with_sql(QUALITY_SQL, "SELECT eid, rnd(avg(nu)) AS n_unique_samples, rnd(avg(mad)) AS median_absolute_deviance, rnd(avg((p75 - p25) / nullif(lev, 0))) AS percentile_distance, rnd(avg((p75 - p50) / nullif(p50 - p25, 0))) AS percentile_asymmetry FROM q GROUP BY eid"))
def sliding_qc(t):
    return op.sliding_qc(_quality_samples(t), ["eid"], "u", "value").select("eid", *[rnd(m).alias(m) for m in op.QUALITY_METRICS[:4]])


@query("sliding_ar_score", with_sql(QUALITY_SQL, "SELECT eid, rnd(avg(CASE WHEN n >= 4 THEN ar END)) AS ar_score FROM q GROUP BY eid"))
def sliding_ar_score(t):
    w = op.sliding_windows(_quality_samples(t), ["eid"], "u")
    q = op.window_quality(w, ["eid", "window"], "u", "value").join(w.groupBy("eid", "window").count(), ["eid", "window"])
    return q.groupBy("eid").agg(rnd(F.avg(F.when(F.col("count") >= 4, F.col("ar_score")))).alias("ar_score"))


@query("lowpass_signal")
def lowpass_signal(t):
    return op.lowpass(t.indexed("value"), ["eid"], "idx", "value", cutoff=0.2, half=256).select("eid", "idx", rnd("lowpass").alias("lowpass"))


@query("preprocess_signal")
def preprocess_signal(t):
    s = t.indexed("value", "k").select("eid", "idx", "t", F.col("value") + 50, F.col("k").cast("double") + 50).toDF("eid", "idx", "t", "value", "k")
    out = op.preprocess(s, ["eid"], "idx", "t", "value", "k", fs=FS, chunk_width=DAY, cutoff=0.2, half=256)
    return out.select("eid", "grid", rnd("value").alias("value"))


@query("iso_correlation", with_sql(SIGNAL_SQL, "SELECT eid, rnd(regr_r2(value, k)) AS iso_r2 FROM signal GROUP BY eid"))
def iso_correlation(t):
    return op.iso_correlation(t.signal, ["eid"], "value", "k").select("eid", rnd("iso_r2").alias("iso_r2"))


def _tau_pass(rng: str, name: str) -> str:
    return f"""{name}t AS (SELECT s.eid, g, lo, hi, lo * pow(hi / lo, g / 23.0::DOUBLE) AS tau, value, exp(-t / (lo * pow(hi / lo, g / 23.0::DOUBLE))) AS x FROM signal s JOIN {rng} r USING (eid), (SELECT unnest(range(24)) AS g)),
 {name}f AS (SELECT eid, g, lo, hi, tau, round(1 - regr_r2(value, x), 9) AS sse FROM {name}t GROUP BY ALL),
 {name} AS (SELECT eid, b.tau AS tau, b.tau / pow(b.hi / b.lo, 1 / 23.0::DOUBLE) AS lo, b.tau * pow(b.hi / b.lo, 1 / 23.0::DOUBLE) AS hi FROM
  (SELECT eid, arg_min(struct_pack(tau := tau, lo := lo, hi := hi), struct_pack(s := sse, g := g)) AS b FROM {name}f WHERE sse IS NOT NULL GROUP BY eid))"""


@query("bleaching_tau", with_sql(SIGNAL_SQL, ", r0 AS (SELECT DISTINCT eid, 3600.0::DOUBLE AS lo, 2592000.0::DOUBLE AS hi FROM signal), "
       + _tau_pass("r0", "p1") + ", " + _tau_pass("p1", "p2") + ", " + _tau_pass("p2", "p3") + " SELECT eid, rnd(tau, 2) AS bleaching_tau FROM p3"))
def bleaching_tau(t):
    out = op.bleaching_tau(t.signal, ["eid"], "t", "value", 3600.0, 2592000.0)
    return out.select("eid", rnd("bleaching_tau", 2).alias("bleaching_tau"))


@query("video_measures", with_sql(SIGNAL_SQL, """, st AS (SELECT eid, t, lead(t) OVER (PARTITION BY eid ORDER BY t) - t AS dt FROM signal)
 SELECT eid, rnd(max(t) - min(t) - (2000000 + eid), 4) AS length_discrepancy, rnd(quantile_cont(dt, 0.5), 4) AS frame_interval FROM st GROUP BY eid"""))
def video_measures(t):
    lengths = t.signal.groupBy("eid").agg((F.max("eid") + 2000000).alias("length"))
    out = op.video_measures(t.signal, ["eid"], "t", lengths, "length", DAY)
    return out.select("eid", rnd("length_discrepancy", 4).alias("length_discrepancy"), rnd("frame_interval", 4).alias("frame_interval"))


@query("trim_to_session", with_sql(SIGNAL_SQL, """, b AS (SELECT c_custkey AS eid, 100000 + c_acctbal * 10 AS s, 2000000 + c_acctbal * 50 AS e FROM customer)
 SELECT event_id, eid, value FROM signal JOIN b USING (eid) WHERE t >= s - 5 AND t <= e + 5"""))
def trim_to_session(t):
    bounds = t["customer"].selectExpr("c_custkey AS eid", "100000 + c_acctbal * 10 AS s", "2000000 + c_acctbal * 50 AS e")
    return op.trim_to_session(t.signal, bounds, ["eid"], "t", "s", "e").select("event_id", "eid", "value")


@query("movement_channels", with_sql(SIGNAL_SQL, """, sp AS (SELECT eid, event_type AS part, t, CASE WHEN k >= 10 THEN sqrt(pow(value - lag(value) OVER w, 2) + pow(k - lag(k) OVER w, 2)) END AS s FROM signal WINDOW w AS (PARTITION BY eid, event_type ORDER BY t)),
 ch AS (SELECT eid, CASE WHEN part IN ('click', 'error') THEN 'paw' WHEN part = 'view' THEN 'nose' END AS channel, t, sum(s) AS value FROM sp WHERE part IN ('click', 'error', 'view') GROUP BY ALL
  UNION ALL SELECT eid, 'motion_energy', t, value FROM signal WHERE eid % 2 = 0) SELECT eid, channel, count(*) AS n, rnd(sum(value), 4) AS total FROM ch GROUP BY ALL"""))
def movement_channels(t):
    s = t.signal
    pose = s.select("eid", "t", F.col("event_type").alias("part"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"), F.when(F.col("k") >= 10, 0.95).otherwise(0.5).alias("lik"))
    ch = op.movement_channels(pose, s.where("eid % 2 = 0").select("eid", "t", "value"), ["eid"], "t", "part", "x", "y", "lik", DAY, {"paw": ["click", "error"], "nose": ["view"]})
    return ch.groupBy("eid", "channel").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 4).alias("total"))
