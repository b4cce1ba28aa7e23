"""Queries: feature vectors, similarity, decoding, encoding models and psychometric fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators import decoding as dec, derive, encoding as enc, features as fea
from trialloom.plans.catalog import REL_SQL, contrasted
from trialloom.plans.inputs import SIGNAL_SQL, with_sql
from trialloom.plans.registry import query, rnd

CELL = ["event", "contrast", "side", "feedbackType"]
VEC_SQL = REL_SQL + """, ce AS (SELECT eid, event, contrast, side, feedbackType, count(*) AS n, avg(response) AS v FROM rel GROUP BY ALL), e AS (SELECT DISTINCT eid, event FROM rel), c AS (SELECT DISTINCT eid, contrast FROM rel), s AS (SELECT DISTINCT eid, side FROM rel), f AS (SELECT DISTINCT eid, feedbackType FROM rel),
 vec AS (SELECT eid, event, contrast, side, feedbackType, coalesce(n, 0) AS n_trials, CASE WHEN n >= 8 THEN v END AS value FROM e JOIN c USING (eid) JOIN s USING (eid) JOIN f USING (eid) LEFT JOIN ce USING (eid, event, contrast, side, feedbackType))"""


def vectors(t, normalize=False):
    return fea.response_vectors(derive.relative_contrast(contrasted(t)), ["eid"], CELL, "response", 8, normalize)


@query("response_vectors", with_sql(VEC_SQL, "SELECT eid, event, contrast, side, feedbackType, n_trials, rnd((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0)) AS value FROM vec WINDOW w AS (PARTITION BY eid)"))
def response_vectors(t):
    return vectors(t, True).select("eid", *CELL, "n_trials", rnd("value").alias("value"))


@query("complete_recordings", with_sql(VEC_SQL, "SELECT eid, event, contrast, side, feedbackType, rnd(value) AS value FROM vec WHERE eid NOT IN (SELECT eid FROM vec WHERE value IS NULL)"))
def complete_recordings(t):
    return fea.drop_incomplete(vectors(t), ["eid"], CELL, "value").select("eid", *CELL, rnd("value").alias("value"))


@query("complete_features", with_sql(VEC_SQL, ", ok AS (SELECT event, contrast, side, feedbackType FROM vec GROUP BY ALL HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.1) SELECT eid, event, contrast, side, feedbackType, rnd(value) AS value FROM vec JOIN ok USING (event, contrast, side, feedbackType)"))
def complete_features(t):
    return fea.drop_incomplete(vectors(t), ["eid"], CELL, "value", "drop_features", 0.1).select("eid", *CELL, rnd("value").alias("value"))


@query("feature_matrix", with_sql(VEC_SQL, "SELECT eid, rnd(max(CASE WHEN contrast = 0 AND side = 'contra' AND feedbackType = 1 AND event = 'stimOn_times' THEN value END)) AS stim_c0, rnd(max(CASE WHEN contrast = 100 AND side = 'ipsi' AND feedbackType = 1 AND event = 'stimOn_times' THEN value END)) AS stim_c100 FROM vec GROUP BY eid"))
def feature_matrix(t):
    name = F.when((F.col("event") == "stimOn_times") & (F.col("feedbackType") == 1), F.when((F.col("contrast") == 0) & (F.col("side") == "contra"), "stim_c0").when((F.col("contrast") == 100) & (F.col("side") == "ipsi"), "stim_c100"))
    wide = fea.feature_matrix(vectors(t).withColumn("name", name), ["eid"], "name", "value", ["stim_c0", "stim_c100"])
    return wide.select("eid", rnd("stim_c0").alias("stim_c0"), rnd("stim_c100").alias("stim_c100"))


def embeddings(t):
    return t["embeddings"].select("vec_id", "label", (F.col("vec_id") % 40).alias("subject"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))


EMB = "emb AS (SELECT vec_id, label, vec_id % 40 AS subject, embedding::DOUBLE[] AS v FROM embeddings)"


@query("cosine_similarity", with_sql(EMB, "SELECT a.vec_id AS id_a, b.vec_id AS id_b, rnd(list_cosine_similarity(a.v, b.v)) AS similarity FROM emb a JOIN emb b ON a.vec_id <= b.vec_id"))
def cosine_similarity(t):
    return fea.cosine_similarity(embeddings(t), "vec_id", "v").withColumn("similarity", rnd("similarity"))


@query("within_between", with_sql(EMB, "SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.label AS group1, b.label AS group2, rnd(list_cosine_similarity(a.v, b.v)) AS similarity, CASE WHEN a.label = b.label THEN 'within' ELSE 'between' END AS comparison FROM emb a JOIN emb b ON a.vec_id < b.vec_id"))
def within_between(t):
    e = embeddings(t)
    return fea.within_between(fea.cosine_similarity(e, "vec_id", "v"), e, "vec_id", "label").withColumn("similarity", rnd("similarity"))


SIM = "SELECT a.label AS label_a, b.label AS label_b, rnd(avg(list_cosine_similarity(a.v, b.v))) AS similarity, count(*) AS n_pairs FROM emb a JOIN emb b ON a.vec_id <> b.vec_id {} GROUP BY ALL"


@query("mean_similarity", with_sql(EMB, SIM.format("")))
def mean_similarity(t):
    return fea.mean_similarity(embeddings(t), "label", "subject", "v").withColumn("similarity", rnd("similarity"))


@query("mean_similarity_across_subjects", with_sql(EMB, SIM.format("AND a.subject <> b.subject")))
def mean_similarity_across_subjects(t):
    return fea.mean_similarity(embeddings(t), "label", "subject", "v", True).withColumn("similarity", rnd("similarity"))


@query("decode_label")
def decode_label(t):
    pred, _ = dec.decode_label(embeddings(t), "vec_id", "label", "subject", "v")
    return dec.decoding_scores(pred, "label").select("label", "n", rnd("recall").alias("recall"), rnd("accuracy").alias("accuracy"), rnd("balanced_accuracy").alias("balanced_accuracy"))


@query("decode_confusion")
def decode_confusion(t):
    pred, _ = dec.decode_label(embeddings(t), "vec_id", "label", "subject", "v")
    return dec.confusion(pred, "label")


@query("decode_coefficients")
def decode_coefficients(t):
    return dec.decoding_coefficients(embeddings(t), "label", "v", "vec_id", 1.0).withColumn("coef", rnd("coef", 3))


@query("unique_contribution")
def unique_contribution(t):
    return dec.unique_contribution(embeddings(t), "label", "v", None, 1.0, "vec_id").select("feature", *[rnd(c).alias(c) for c in ("full_accuracy", "reduced_accuracy", "delta")], "converged")


# --- encoding models: events as impulses on a 6-hour grid, mean value of a bin as the target -------

DT = 21600.0
BIN_SQL = SIGNAL_SQL + """, tg AS (SELECT eid, CAST(floor(t / 21600) AS BIGINT) AS bin, avg(value) AS y FROM signal GROUP BY ALL), nb AS (SELECT eid, CAST(floor(max(t) / 21600) AS BIGINT) + 1 AS nb FROM signal GROUP BY eid),
 im AS (SELECT eid, CAST(round_even(t / 21600, 0) AS BIGINT) AS bin, arg_max(k::DOUBLE, t) AS h FROM signal JOIN nb USING (eid) WHERE event_type = 'error' AND round_even(t / 21600, 0) < nb GROUP BY ALL)"""


def bounds(t):
    """Grid of every session: from 0 to its own last sample."""
    return t.signal.groupBy("eid").agg(F.lit(0.0).alias("t_start"), (F.floor(F.max("t") / DT) + 1).alias("n_bins"))


def errors(t):
    return t.signal.where("event_type = 'error'").select("eid", "t", "k", "event_type")


@query("event_impulses", with_sql(BIN_SQL, "SELECT eid, bin, h AS height FROM im"))
def event_impulses(t):
    return enc.event_impulses(errors(t), bounds(t), ["eid"], "t", F.col("k"), DT).select("eid", "bin", "height")


@query("lag_design", with_sql(BIN_SQL, "SELECT eid, bin + o AS bin, 'err:' || lpad(CAST(o + 2 AS VARCHAR), 3, '0') AS feature, h AS value FROM im JOIN nb USING (eid), (SELECT unnest(generate_series(-2, 2)) AS o) WHERE bin + o >= 0 AND bin + o < nb AND h <> 0"))
def lag_design(t):
    imp = enc.event_impulses(errors(t), bounds(t), ["eid"], "t", F.col("k"), DT)
    return enc.expand_events(imp, ["eid"], "err", [(i, i - 2, 1.0) for i in range(5)])


@query("raised_cosine_design", with_sql(BIN_SQL, """, im1 AS (SELECT eid, CAST(round_even(t / 21600, 0) AS BIGINT) AS bin, nb FROM signal JOIN nb USING (eid) WHERE event_type = 'error' AND round_even(t / 21600, 0) < nb GROUP BY ALL),
 bs AS (SELECT c, j, power(cos(pi() / 2 * greatest(-1, least(1, (ln(j + 1) - c * ln(11) / 3) / (2 * ln(11) / 3)))), 2) AS w FROM (SELECT unnest(range(4)) AS c), (SELECT unnest(range(10)) AS j))
 SELECT eid, bin + j AS bin, 'err:' || lpad(CAST(c AS VARCHAR), 3, '0') AS feature, rnd(sum(w)) AS value FROM im1, bs WHERE w > 1e-12 AND bin + j < nb GROUP BY ALL"""))
def raised_cosine_design(t):
    imp = enc.event_impulses(errors(t), bounds(t), ["eid"], "t", None, DT)
    return enc.expand_events(imp, ["eid"], "err", enc.raised_cosine_basis(4, 2.5, 0.2, 0.25)).withColumn("value", rnd("value"))


@query("tonic_design", with_sql(BIN_SQL, """, tr AS (SELECT eid, greatest(CAST(round_even(t / 21600, 0) AS BIGINT), 0) AS a, least(CAST(round_even((t + 86400) / 21600, 0) AS BIGINT) - 1, nb - 1) AS b, k::DOUBLE AS v FROM signal JOIN nb USING (eid) WHERE event_type = 'error'),
 x AS (SELECT eid, unnest(generate_series(a, b)) AS bin, v FROM tr WHERE b >= a) SELECT eid, bin, 'block:000' AS feature, max(v) AS value FROM x GROUP BY eid, bin"""))
def tonic_design(t):
    tr = errors(t).withColumn("t_end", F.col("t") + 86400)
    return enc.tonic_block(tr, bounds(t), ["eid"], "t", "t_end", F.col("k"), "block", DT)


@query("continuous_design", with_sql(BIN_SQL, "SELECT eid, bin + o AS bin, 'wheel:' || lpad(CAST(o + 1 AS VARCHAR), 3, '0') AS feature, rnd(y) AS value FROM tg, (SELECT unnest([-1, 0, 1]) AS o)"))
def continuous_design(t):
    return enc.continuous_block(target(t), ["eid"], "bin", "y", "wheel", [-1, 0, 1]).withColumn("value", rnd("value"))


def target(t):
    return t.signal.groupBy("eid", F.floor(F.col("t") / DT).alias("bin")).agg(F.avg("value").alias("y"))


def moments(t):
    basis = [(i, i - 2, 1.0) for i in range(5)]
    d = enc.event_block(errors(t), bounds(t), ["eid"], "t", "err", basis, {"k": F.col("k") / 100}, dt=DT)
    d = d.unionByName(enc.event_block(t.signal.where("event_type = 'view'").select("eid", "t", "k", "event_type"), bounds(t), ["eid"], "t", "view", basis, split="event_type", dt=DT))
    return enc.design_gram(d, target(t), ["eid"], "bin", "y")


@query("design_moments", with_sql(BIN_SQL, """, sp AS (SELECT eid, max(bin) + 1 AS n FROM tg GROUP BY eid), y AS (SELECT tg.*, least(bin * 5 // n, 4) AS fold FROM tg JOIN sp USING (eid)),
 d AS (SELECT eid, bin + o AS bin, 'err:' || lpad(CAST(o + 2 AS VARCHAR), 3, '0') AS f, h AS v FROM im JOIN nb USING (eid), (SELECT unnest(generate_series(-2, 2)) AS o) WHERE bin + o >= 0 AND bin + o < nb AND h <> 0),
 a AS (SELECT y.eid, y.fold, d.bin, d.f, d.v FROM d JOIN y USING (eid, bin) UNION ALL SELECT eid, fold, bin, '!one', 1.0 FROM y UNION ALL SELECT eid, fold, bin, '~y', y FROM y)
 SELECT p.eid, p.fold, p.f AS a, q.f AS b, rnd(sum(p.v * q.v), 4) AS s FROM a p JOIN a q ON p.eid = q.eid AND p.bin = q.bin AND p.f <= q.f GROUP BY ALL"""))
def design_moments(t):
    d = enc.expand_events(enc.event_impulses(errors(t), bounds(t), ["eid"], "t", F.col("k"), DT), ["eid"], "err", [(i, i - 2, 1.0) for i in range(5)])
    return enc.design_gram(d, target(t), ["eid"], "bin", "y").withColumn("s", rnd("s", 4))


ALPHAS = [10 ** (-3 + 6 * i / 9) for i in range(10)]  # fixed grid, 1e-3 to 1e3


@query("encoding_kernels")
def encoding_kernels(t):
    return enc.fit_encoding(moments(t), ["eid"], ALPHAS).select("eid", "block", "column", "level", *[rnd(c, 4).alias(c) for c in ("coef", "r2", "cv_r2")], "alpha")


@query("encoding_block_loss")
def encoding_block_loss(t):
    return enc.encoding_block_loss(moments(t), ["eid"], ALPHAS, True).withColumn("delta_r2", rnd("delta_r2", 4))


# --- psychometric -----------------------------------------------------------------------------

@query("choice_counts", with_sql(REL_SQL, "SELECT eid, signed_contrast, count(*) AS n, count(CASE WHEN choice = -1 THEN 1 END) AS k FROM rel GROUP BY ALL"))
def choice_counts(t):
    return enc.choice_counts(contrasted(t).withColumn("signed_contrast", F.col("signed_contrast") + 0.0), ["eid"])


@query("psychometric_fit")
def psychometric_fit(t):
    f = enc.fit_psychometric(enc.choice_counts(contrasted(t), ["eid"]), ["eid"])
    return f.select("eid", *[rnd(c, 3).alias(c) for c in ("bias", "threshold", "lapse_left", "lapse_right", "r_squared")], "n_trials")


@query("psychometric_by_block")
def psychometric_by_block(t):
    f = enc.psychometric_by_block(contrasted(t), ["eid"])
    return f.select("eid", *[rnd(c, 3).alias(c) for c in f.columns if c != "eid"])
