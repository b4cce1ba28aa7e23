"""Queries: least squares, mixed models, swap tests, ANOVA, rank tests, multivariate models."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window as W, functions as F

from trialloom.functions.scan import ordered_scan, time_chunk
from trialloom.operators import derive, linear, mixed, multivariate as mv, rank_tests as rt, rules, scores, slopes
from trialloom.plans.inputs import CELLS_SQL, NUMBERED_SQL, TRIAL_ORDER, TRIALS_SQL, with_sql
from trialloom.plans.registry import query, rnd
from trialloom.sources.tables import scratch_path

ONE = [("l_quantity",)]
TWO = [("l_quantity",), ("l_tax",)]


def items(t):
    return t["lineitem"].select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_tax", "l_discount", (F.col("l_extendedprice") / 1000).alias("y"))


ITEMS = "items AS (SELECT l_suppkey, l_returnflag, l_linestatus, l_quantity, l_tax, l_discount, l_extendedprice / 1000 AS y FROM lineitem)"


@query("ols_fit", with_sql(ITEMS, """, s AS (SELECT l_suppkey, regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a, regr_r2(y, l_quantity) AS r2, regr_sxx(y, l_quantity) AS sxx, regr_syy(y, l_quantity) AS syy, avg(l_quantity) AS mx, count(*) AS n FROM items GROUP BY 1),
 e AS (SELECT *, sqrt(syy * (1 - r2) / (n - 2)) AS s FROM s)
 SELECT l_suppkey, 'l_quantity' AS term, rnd(b) AS coef, rnd(s / sqrt(sxx)) AS coef_se, rnd(b / (s / sqrt(sxx)), 4) AS t, rnd(r2) AS r2, n AS n_trials FROM e
 UNION ALL SELECT l_suppkey, 'Intercept', rnd(a), rnd(s * sqrt(1.0 / n + mx * mx / sxx)), rnd(a / (s * sqrt(1.0 / n + mx * mx / sxx)), 4), rnd(r2), n FROM e"""))
def ols_fit(t):
    c = linear.ols_coefficients(linear.model_gram(items(t), ["l_suppkey"], ONE, "y"), ["l_suppkey"], ONE)
    return c.select("l_suppkey", "term", rnd("coef").alias("coef"), rnd("coef_se").alias("coef_se"), rnd("t", 4).alias("t"), rnd("r2").alias("r2"), "n_trials")


R2_TWO = "(power(corr(y, l_quantity), 2) + power(corr(y, l_tax), 2) - 2 * corr(y, l_quantity) * corr(y, l_tax) * corr(l_quantity, l_tax)) / (1 - power(corr(l_quantity, l_tax), 2))"


@query("drop_one", with_sql(ITEMS, f""", f AS (SELECT l_suppkey, {R2_TWO} AS r2, power(corr(y, l_quantity), 2) AS rq, power(corr(y, l_tax), 2) AS rt, count(*) AS n FROM items GROUP BY 1)
 SELECT l_suppkey, 'l_quantity' AS predictor, rnd(r2) AS r2, rnd(r2 - rt) AS delta_r2, n AS n_trials FROM f WHERE n >= 50 UNION ALL SELECT l_suppkey, 'l_tax', rnd(r2), rnd(r2 - rq), n FROM f WHERE n >= 50"""))
def drop_one(t):
    d = linear.drop_one(linear.model_gram(items(t), ["l_suppkey"], TWO, "y"), ["l_suppkey"], TWO, ["l_quantity", "l_tax"], 50)
    return d.select("l_suppkey", "predictor", rnd("r2").alias("r2"), rnd("delta_r2").alias("delta_r2"), "n_trials")


@query("ols_main_effects", with_sql(ITEMS, """, s AS (SELECT l_returnflag, covar_pop(y, l_quantity) AS yq, covar_pop(y, l_tax) AS yt, var_pop(l_quantity) AS vq, var_pop(l_tax) AS vt, covar_pop(l_quantity, l_tax) AS qt, count(*) AS n FROM items GROUP BY 1)
 SELECT l_returnflag, 'l_quantity' AS regressor, rnd((yq * vt - yt * qt) / (vq * vt - qt * qt)) AS coef, n AS n_trials FROM s UNION ALL SELECT l_returnflag, 'l_tax', rnd((yt * vq - yq * qt) / (vq * vt - qt * qt), 4), n FROM s"""))
def ols_main_effects(t):
    c = linear.main_effects(linear.ols_coefficients(linear.model_gram(items(t), ["l_returnflag"], TWO, "y"), ["l_returnflag"], TWO))
    return c.select("l_returnflag", "regressor", F.when(F.col("regressor") == "l_tax", rnd("coef", 4)).otherwise(rnd("coef")).alias("coef"), "n_trials")


@query("ols_features", with_sql(ITEMS, "SELECT l_suppkey, 'l_quantity' AS feature, rnd(regr_slope(y, l_quantity)) AS value FROM items GROUP BY 1 UNION ALL SELECT l_suppkey, 'Intercept', rnd(regr_intercept(y, l_quantity)) FROM items GROUP BY 1"))
def ols_features(t):
    c = linear.ols_coefficients(linear.model_gram(items(t), ["l_suppkey"], ONE, "y"), ["l_suppkey"], ONE)
    return linear.coefficient_features(c, ["l_suppkey"]).withColumn("value", rnd("value"))


# --- swaps between sessions -----------------------------------------------------------------

SWAP_SQL = NUMBERED_SQL + """, sw AS (SELECT eid, subject, target_NM, trial, CAST(response AS DOUBLE) AS y, CASE WHEN contrastLeft IS NULL THEN 0.5 ELSE -0.5 END AS side, wheel AS q FROM numbered),
 ok AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY trial) - 1 AS rk FROM sw WHERE y IS NOT NULL),
 pr AS (SELECT a.target_NM, a.eid, b.eid AS donor, a.y, a.side, a.q, b.q AS dq FROM ok a JOIN ok b ON a.target_NM = b.target_NM AND a.rk = b.rk AND a.eid <> b.eid)"""


def swap_rows(t):
    """Trials with a response and their rank among those, numbered in one scan."""
    r = t.trials.select("eid", "subject", "target_NM", *TRIAL_ORDER, F.col("response").alias("y"), F.when(F.col("contrastLeft").isNull(), 0.5).otherwise(-0.5).alias("side"), F.col("wheel").alias("q"))
    r = ordered_scan(r, ["eid"], TRIAL_ORDER, time_chunk("day", 180.0), running={"__k": F.when(F.col("y").isNotNull(), 1).otherwise(0)})
    return r.where("y IS NOT NULL").select("eid", "subject", "target_NM", "y", "side", "q", (F.col("__k") - 1).alias("rk"))


@query("pair_regressions", with_sql(SWAP_SQL, "SELECT target_NM, eid, donor, count(*) AS n, rnd(regr_slope(y, dq)) AS slope, rnd(regr_r2(y, dq)) AS r2 FROM pr GROUP BY ALL"))
def pair_regressions(t):
    p = linear.pair_regressions(swap_rows(t), ["target_NM"], "eid", "rk", "y", "q")
    return p.select("target_NM", "eid", "donor", "n", rnd("slope").alias("slope"), rnd("r2").alias("r2"))


TERMS = [("side",), ("q",)]
NULL_SQL = SWAP_SQL + """, nl AS (SELECT target_NM, eid, donor, (power(corr(y, side), 2) + power(corr(y, dq), 2) - 2 * corr(y, side) * corr(y, dq) * corr(side, dq)) / (1 - power(corr(side, dq), 2)) - power(corr(y, side), 2) AS d FROM pr GROUP BY ALL)"""


@query("swap_null", with_sql(NULL_SQL, "SELECT target_NM, eid, donor, 'q' AS predictor, rnd(d) AS delta_r2 FROM nl"))
def swap_null(t):
    return linear.swap_null(swap_rows(t), ["target_NM"], "eid", "rk", TERMS, "q", "y").withColumn("delta_r2", rnd("delta_r2"))


@query("swap_pvalues", with_sql(NULL_SQL, """, ob AS (SELECT target_NM, eid, subject, (power(corr(y, side), 2) + power(corr(y, q), 2) - 2 * corr(y, side) * corr(y, q) * corr(side, q)) / (1 - power(corr(side, q), 2)) - power(corr(y, side), 2) AS d FROM ok GROUP BY ALL),
 nx AS (SELECT nl.*, ob.subject, row_number() OVER (PARTITION BY nl.eid ORDER BY donor) AS i FROM nl JOIN ob USING (eid)), mn AS (SELECT target_NM, subject, i, avg(d) AS d FROM nx GROUP BY ALL), mo AS (SELECT target_NM, subject, avg(d) AS o, count(*) AS n FROM ob GROUP BY ALL)
 SELECT mo.target_NM, 'q' AS predictor, mo.subject, rnd(max(o)) AS mean_delta_r2, rnd((count(CASE WHEN d >= o THEN 1 END) + 1) / (count(*) + 1.0)) AS p_value, max(n) AS n_sessions, count(*) AS n_donors FROM mn JOIN mo USING (target_NM, subject) GROUP BY ALL"""))
def swap_pvalues(t):
    from trialloom.session import cut_lineage

    rows = cut_lineage(swap_rows(t))
    null = linear.swap_null(rows, ["target_NM"], "eid", "rk", TERMS, "q", "y")
    g = linear.model_gram(rows, ["target_NM", "eid", "subject"], TERMS, "y")
    obs = linear.drop_one(g, ["target_NM", "eid", "subject"], TERMS, ["q"])
    p = linear.swap_pvalue_table(null, obs, ["target_NM"], "eid", "subject")
    return p.select("target_NM", "predictor", "subject", rnd("mean_delta_r2").alias("mean_delta_r2"), rnd("p_value").alias("p_value"), "n_sessions", "n_donors")


@query("permutation_pvalues", """WITH o AS (SELECT o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY 1), j AS (SELECT o_orderpriority, o_totalprice >= v AS up, o_totalprice <= v AS dn FROM orders JOIN o USING (o_orderpriority))
 SELECT o_orderpriority, rnd(least(1, 2 * least((count(CASE WHEN up THEN 1 END) + 1.0) / (count(*) + 1), (count(CASE WHEN dn THEN 1 END) + 1.0) / (count(*) + 1)))) AS p_value, count(*) AS n_null FROM j GROUP BY 1""")
def permutation_pvalues(t):
    null = t["orders"].select("o_orderpriority", F.col("o_totalprice").alias("v"))
    p = linear.permutation_pvalues(null, null.groupBy("o_orderpriority").agg(F.avg("v").alias("v")), ["o_orderpriority"], "v", "two-sided")
    return p.select("o_orderpriority", rnd("p_value").alias("p_value"), "n_null")


@query("synchronized_pvalues", """WITH nl AS (SELECT l_linestatus, l_returnflag, l_linenumber, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), ob AS (SELECT l_linestatus, l_returnflag, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
 mn AS (SELECT l_linestatus, l_linenumber, avg(v) AS v FROM nl GROUP BY ALL), mo AS (SELECT l_linestatus, avg(v) AS o, count(*) AS n FROM ob GROUP BY 1)
 SELECT l_linestatus, rnd(max(o)) AS observed, rnd((count(CASE WHEN v >= o THEN 1 END) + 1.0) / (count(*) + 1)) AS p_value, max(n) AS n_strata FROM mn JOIN mo USING (l_linestatus) GROUP BY 1""")
def synchronized_pvalues(t):
    li = t["lineitem"]
    null = li.groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("v"))
    obs = li.groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    p = linear.synchronized_pvalues(null, obs, ["l_linestatus"], "l_returnflag", "l_linenumber", "v")
    return p.select("l_linestatus", rnd("observed").alias("observed"), rnd("p_value").alias("p_value"), "n_strata")


TAILS = ["greater", "less", "two-sided"]


@query("session_permutation_test", with_sql(SWAP_SQL, """, un AS (SELECT target_NM, eid, row_number() OVER (PARTITION BY target_NM ORDER BY eid) - 1 AS i, count(*) OVER (PARTITION BY target_NM) AS n FROM (SELECT DISTINCT target_NM, eid FROM sw)),
 dr AS (SELECT target_NM, eid, i, it, ('0x' || substr(md5(eid || '|' || it || '|1'), 1, 15))::BIGINT % (n - 1) AS h FROM un, (SELECT unnest(range(1, 1001)) AS it) WHERE n > 1),
 dn AS (SELECT dr.target_NM, dr.eid, dr.it, un.eid AS donor FROM dr JOIN un ON un.target_NM = dr.target_NM AND un.i = dr.h + (dr.h >= dr.i)::INT),
 ft AS (SELECT target_NM, eid, donor, regr_r2(y, dq) AS r2 FROM pr GROUP BY ALL), ob AS (SELECT target_NM, eid, regr_r2(y, q) AS o FROM sw GROUP BY ALL),
 ct AS (SELECT dn.target_NM, dn.eid, any_value(o) AS o, count(*) AS n_draws, (count(*) FILTER (ft.r2 >= o) + 1) / (count(*) + 1)::DOUBLE AS up, (count(*) FILTER (ft.r2 <= o) + 1) / (count(*) + 1)::DOUBLE AS down
  FROM dn JOIN ob USING (target_NM, eid) LEFT JOIN ft ON ft.target_NM = dn.target_NM AND ft.eid = dn.eid AND ft.donor = dn.donor GROUP BY ALL)
 SELECT un.target_NM, un.eid, rnd(ob.o) AS observed_r2, n_draws, rnd(up) AS p_greater, rnd(down) AS p_less, rnd(least(1, 2 * least(up, down))) AS p_two_sided, CASE WHEN n = 1 THEN 'no donor sessions' END AS error
 FROM un JOIN ob USING (target_NM, eid) LEFT JOIN ct ON ct.target_NM = un.target_NM AND ct.eid = un.eid"""))
def session_permutation_test(t):
    p = linear.session_permutation_test(swap_rows(t), ["target_NM"], "eid", "rk", "y", "q", "r2", 1000, seed=1)
    tails = [rnd(linear.tail_pvalue("null_r2", "observed_r2", a)).alias("p_" + a.replace("-", "_")) for a in TAILS]
    return p.select("target_NM", "eid", rnd("observed_r2").alias("observed_r2"), F.when(F.col("null_r2").isNotNull(), F.size("null_r2")).cast("long").alias("n_draws"), *tails, "error")


@query("logistic_fit", """WITH c AS (SELECT l_suppkey, sum(CASE WHEN l_linestatus = 'O' AND l_tax < 0.045 THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN l_linestatus = 'O' AND l_tax >= 0.045 THEN 1 ELSE 0 END)::DOUBLE AS b,
  sum(CASE WHEN l_linestatus = 'F' AND l_tax < 0.045 THEN 1 ELSE 0 END)::DOUBLE AS c, sum(CASE WHEN l_linestatus = 'F' AND l_tax >= 0.045 THEN 1 ELSE 0 END)::DOUBLE AS d FROM lineitem GROUP BY 1)
 SELECT l_suppkey, rnd(ln(c / d)) AS intercept, rnd(ln(a * d / (b * c))) AS slope,
 rnd(1 - (a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d))) / ((a + c) * ln((a + c) / (a + b + c + d)) + (b + d) * ln((b + d) / (a + b + c + d)))) AS pseudo_r2 FROM c""")
def logistic_fit(t):
    r = t["lineitem"].select("l_suppkey", (F.col("l_linestatus") == "O").cast("double").alias("x"), (F.col("l_tax") < 0.045).cast("double").alias("k"))
    f = linear.logistic_fit(r, ["l_suppkey"], "x", "k")
    return f.select("l_suppkey", rnd("intercept").alias("intercept"), rnd("slope").alias("slope"), rnd("pseudo_r2").alias("pseudo_r2"))


# --- mixed models ---------------------------------------------------------------------------

CROSS = derive.crossed("l_quantity", "l_tax")
KEY, SUB = ["l_returnflag"], "l_suppkey"


def lmm(t, terms=CROSS):
    g = mixed.subject_grams(items(t), KEY, SUB, terms, "y")
    return g, mixed.group_sums(g, KEY, len(terms) + 2)


@query("mixed_fits")
def mixed_fits(t):
    fam = derive.drop_one_family(CROSS, ["l_quantity", "l_tax"])
    out = mixed.mixed_fits(lmm(t)[1], KEY, CROSS, fam)
    return out.select("l_returnflag", "name", rnd("marginal_r2").alias("marginal_r2"), rnd("conditional_r2").alias("conditional_r2"))


@query("mixed_coefficients")
def mixed_coefficients(t):
    c = mixed.mixed_coefficients(lmm(t)[1], KEY, CROSS)
    return c.select("l_returnflag", "term", *[rnd(x, 4).alias(x) for x in ("coef", "se", "z", "p", "ci_lower", "ci_upper", "residual_var")])


@query("random_intercepts")
def random_intercepts(t):
    g, s = lmm(t)
    return mixed.random_intercepts(g, s, KEY, SUB, CROSS).select("l_returnflag", "l_suppkey", rnd("intercept", 4).alias("intercept"))


@query("mixed_crossval")
def mixed_crossval(t):
    g, s = lmm(t, TWO)
    return mixed.crossval(g, s, KEY, SUB, TWO, ["l_quantity", "l_tax"]).select("l_returnflag", "fold", "predictor", "n_trials", rnd("r2", 5).alias("r2"), rnd("delta_r2", 5).alias("delta_r2"))


@query("mixed_jackknife")
def mixed_jackknife(t):
    g, s = lmm(t, TWO)
    return mixed.jackknife(g, s, KEY, SUB, TWO, ["l_quantity", "l_tax"]).select("l_returnflag", "fold", "predictor", "n_trials", rnd("r2", 5).alias("r2"), rnd("delta_r2", 5).alias("delta_r2"))


@query("marginal_means")
def marginal_means(t):
    m = mixed.marginal_means(lmm(t)[1], KEY, CROSS, {"l_tax": [0.0, 0.04, 0.08], "l_quantity": [1.0, 50.0]})
    return m.select("l_returnflag", "l_tax", "l_quantity", *[rnd(x, 4).alias(x) for x in ("predicted", "ci_lower", "ci_upper")])


def _u(cols):
    g = f"GROUP BY {', '.join(cols)}" if cols else ""
    return f"(SELECT sum(s * s / n) FROM (SELECT sum(m) AS s, count(*) AS n FROM c {g}))"


@query("anova_rm", with_sql(ITEMS, ", c AS (SELECT l_suppkey AS s, l_returnflag AS a, l_linestatus AS b, avg(y) AS m FROM items GROUP BY ALL), k AS (SELECT count(DISTINCT s) AS n FROM c), u AS (SELECT "
       + ", ".join(f"{_u(c)} AS u_{''.join(c) or 'none'}" for c in ([], ["a"], ["b"], ["s"], ["a", "b"], ["a", "s"], ["b", "s"], ["a", "b", "s"])) + """),
 q AS (SELECT u_a - u_none AS ssa, u_b - u_none AS ssb, u_ab - u_a - u_b + u_none AS ssab, u_as - u_a - u_s + u_none AS ea, u_bs - u_b - u_s + u_none AS eb, u_abs - u_ab - u_as - u_bs + u_a + u_b + u_s - u_none AS eab FROM u)
 SELECT 'l_returnflag' AS source, rnd(ssa / 2 / (ea / (2 * (n - 1))), 4) AS f, 2.0::DOUBLE AS num_df, 2.0::DOUBLE * (n - 1) AS den_df FROM q, k UNION ALL SELECT 'l_linestatus', rnd(ssb / (eb / (n - 1)), 4), 1.0, n - 1 FROM q, k
 UNION ALL SELECT 'l_returnflag:l_linestatus', rnd(ssab / 2 / (eab / (2 * (n - 1))), 4), 2.0, 2.0 * (n - 1) FROM q, k"""))
def anova_rm(t):
    c = mixed.cell_means(items(t), [], "l_suppkey", ["l_returnflag", "l_linestatus"], "y")
    return mixed.anova_rm(c, "l_suppkey", ["l_returnflag", "l_linestatus"], "y").select("source", rnd("f", 4).alias("f"), "num_df", "den_df")


@query("anova_unbalanced")
def anova_unbalanced(t):
    c = mixed.cell_means(items(t).where("NOT (l_suppkey % 7 = 0 AND l_returnflag = 'A')"), [], "l_suppkey", ["l_returnflag", "l_linestatus"], "y", 5)
    return mixed.anova_rm(c, "l_suppkey", ["l_returnflag", "l_linestatus"], "y").select("source", rnd("f", 4).alias("f"), "num_df", "den_df", rnd("p").alias("p"), "method")


def _anova_sql(keys: list[str], within: list[str], subject: str) -> str:
    """Repeated-measures F of all groups of the cells ``c``, by inclusion and exclusion over margins."""
    k, names = ", ".join(keys), [*within, subject]
    sets = [s for r in range(len(names) + 1) for s in combinations(names, r)]
    tag = lambda s: "u_" + "_".join(s)
    parts = [f"{tag(s)} AS (SELECT {k}, sum(s * s / n) AS {tag(s)}, count(*) AS n{tag(s)} FROM (SELECT {k}, sum(m) AS s, count(*) AS n FROM c GROUP BY {', '.join([*keys, *s])}) GROUP BY {k})" for s in sets]
    ss = lambda e: " + ".join(f"{(-1) ** (len(e) - r)} * {tag(t)}" for r in range(len(e) + 1) for t in combinations(e, r))
    balanced = f"n{tag((subject,))} >= 2 AND n{tag(tuple(names))} = " + " * ".join(f"n{tag((w,))}" for w in names)
    rows = []
    for r in range(1, len(within) + 1):
        for e in combinations(within, r):
            df1 = " * ".join(f"(n{tag((w,))} - 1)" for w in e)
            df2 = f"{df1} * (n{tag((subject,))} - 1)"
            rows.append(f"SELECT {k}, '{':'.join(e)}' AS source, rnd((({ss(e)}) / ({df1})) / (({ss((*e, subject))}) / ({df2})), 2) AS f, rnd(({ss(e)}) / (({ss(e)}) + ({ss((*e, subject))}))) AS eta_squared, ({df1})::DOUBLE AS num_df, ({df2})::DOUBLE AS den_df FROM u WHERE {balanced}")
    joined = " ".join([f"SELECT * FROM {tag(sets[0])}"] + [f"JOIN {tag(s)} USING ({k})" for s in sets[1:]])
    return ", " + ", ".join(parts) + f", u AS ({joined}) " + " UNION ALL ".join(rows)


GROUP, FACTORS = ["target_NM", "event"], ["contrast", "side", "reward"]


@query("anova_groups", with_sql(CELLS_SQL, ", c AS (SELECT target_NM, event, subject, contrast, side, reward, avg(response) AS m FROM cells WHERE response IS NOT NULL GROUP BY ALL)" + _anova_sql(GROUP, FACTORS, "subject")))
def anova_groups(t):
    """The groups with every cell of every subject; ``anova_groups_holed`` returns the type III models as well."""
    c = mixed.cell_means(t.cells, GROUP, "subject", FACTORS, "response")
    return mixed.anova_groups(c, GROUP, "subject", FACTORS, "response").where("method = 'rm'").select(
        *GROUP, "source", rnd("f", 2).alias("f"), rnd(F.col("f") * F.col("num_df") / (F.col("f") * F.col("num_df") + F.col("den_df"))).alias("eta_squared"), "num_df", "den_df")


@query("anova_groups_holed")
def anova_groups_holed(t):
    """Cells of ten trials or more, so that some groups are unbalanced."""
    c = mixed.cell_means(t.cells, GROUP, "subject", FACTORS, "response", 10)
    return mixed.anova_groups(c, GROUP, "subject", FACTORS, "response").select(*GROUP, "source", rnd("f", 4).alias("f"), "num_df", "den_df", rnd("p").alias("p"), "method")


SLOPE_FAMILY = {"full": TWO, "l_quantity": [("l_tax",)], "l_tax": [("l_quantity",)]}
SLOPES = {"full": ONE, "l_tax": ONE}  # the model without a predictor has no slope of it


@query("mixed_slopes")
def mixed_slopes(t):
    g = mixed.subject_grams(items(t), KEY, SUB, TWO, "y")
    fits = slopes.slope_fits(g, KEY, SUB, TWO, SLOPE_FAMILY, SLOPES)
    r2 = slopes.slope_variance(g, fits, KEY, SUB, TWO, SLOPE_FAMILY, SLOPES)
    return r2.join(fits.select(*KEY, "name", "n_subjects", "converged", "singular"), [*KEY, "name"]).select(
        *KEY, "name", rnd("marginal_r2").alias("marginal_r2"), rnd("conditional_r2").alias("conditional_r2"), "n_subjects", "converged", "singular")


@query("random_slopes")
def random_slopes(t):
    g = mixed.subject_grams(items(t), KEY, SUB, TWO, "y")
    full = {"full": TWO}
    fits = slopes.slope_fits(g, KEY, SUB, TWO, full, ONE)
    return slopes.slope_effects(g, fits, KEY, SUB, TWO, full, ONE).select(*KEY, SUB, "term", rnd("effect", 4).alias("effect"))


# --- rank tests -----------------------------------------------------------------------------

@query("kruskal_wallis", """WITH r AS (SELECT o_orderpriority, o_orderstatus, rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS r FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)),
 g AS (SELECT o_orderpriority, o_orderstatus, sum(r) AS s, count(*)::DOUBLE AS n FROM r GROUP BY ALL), tie AS (SELECT o_orderpriority, sum(k * k * k - k) AS t FROM (SELECT o_orderpriority, o_totalprice, count(*)::DOUBLE AS k FROM orders GROUP BY ALL) GROUP BY 1),
 h AS (SELECT o_orderpriority, (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - max(t) / (sum(n) * sum(n) * sum(n) - sum(n))) AS h, count(*) AS k FROM g JOIN tie USING (o_orderpriority) GROUP BY 1)
 SELECT o_orderpriority, rnd(h, 5) AS h, k AS n_groups, rnd(exp(-h / 2)) AS p_value FROM h""")
def kruskal_wallis(t):
    k = rt.kruskal_wallis(t["orders"], ["o_orderpriority"], "o_orderstatus", "o_totalprice")
    return k.select("o_orderpriority", rnd("h", 5).alias("h"), "n_groups", rnd("p_value").alias("p_value"))


@query("mannwhitney_u", """WITH p AS (SELECT a.p AS group_a, b.p AS group_b FROM (SELECT DISTINCT l_returnflag AS p FROM lineitem) a, (SELECT DISTINCT l_returnflag AS p FROM lineitem) b WHERE a.p < b.p),
 v AS (SELECT group_a, group_b, l_returnflag AS g, l_quantity AS q FROM p JOIN lineitem ON l_returnflag IN (group_a, group_b)), r AS (SELECT *, rank() OVER (PARTITION BY group_a, group_b ORDER BY q) + (count(*) OVER (PARTITION BY group_a, group_b, q) - 1) / 2.0 AS r FROM v)
 SELECT group_a, group_b, CAST(sum(CASE WHEN g = group_a THEN r END) - count(CASE WHEN g = group_a THEN 1 END) * (count(CASE WHEN g = group_a THEN 1 END) + 1) / 2.0 AS DOUBLE) AS U FROM r GROUP BY ALL""")
def mannwhitney_u(t):
    return rt.pairwise_mannwhitney(t["lineitem"], "l_returnflag", "l_quantity").select("group_a", "group_b", "U")


@query("mannwhitney_p")
def mannwhitney_p(t):
    return rt.pairwise_mannwhitney(t["part"], "p_type", "p_retailprice").withColumn("p_corrected", rnd("p_corrected"))


@query("spearman", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT l_returnflag, rnd(corr(a, b)) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman(t):
    return rt.spearman(t["lineitem"], ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", rnd("rho").alias("rho"), "n")


@query("spearman_matrix", " UNION ALL ".join(f"""SELECT rnd(corr(a, b)) AS rho, '{x}' AS x, '{y}' AS y FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS a, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS b FROM lineitem)"""
                                              for x, y in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))))
def spearman_matrix(t):
    return rt.spearman_matrix(t["lineitem"], ["l_quantity", "l_discount", "l_tax"]).select(rnd("rho").alias("rho"), "x", "y")


# --- multivariate -----------------------------------------------------------------------------

RIDGE = 0.1  # cohorts of fewer rows than entries need one


def embedded(t):
    """The two halves of every vector."""
    e = t["embeddings"]
    return e.select("vec_id", "label", (F.col("vec_id") % 50).alias("session"), F.slice("embedding", 1, 32).cast("array<double>").alias("x"), F.slice("embedding", 33, 32).cast("array<double>").alias("y"),
                    (F.col("label") % 2).alias("cohort"))


@query("cca_two_variables", with_sql(ITEMS, f"SELECT l_returnflag, rnd(sqrt({R2_TWO})) AS correlation, count(*) AS n_recordings FROM items GROUP BY 1"))
def cca_two_variables(t):
    v = items(t).select("l_returnflag", F.array("y", "l_quantity", "l_tax").alias("v"))
    return mv.cca_summary(mv.array_gram(v, ["l_returnflag"], "v"), ["l_returnflag"], 1).select("l_returnflag", rnd("correlation").alias("correlation"), "n_recordings")


@query("cca_summary")
def cca_summary(t):
    g = mv.array_gram(embedded(t).withColumn("v", F.concat("x", "y")), ["cohort"], "v")
    return mv.cca_summary(g, ["cohort"], 32).select("cohort", "component", "n_recordings", *[rnd(c).alias(c) for c in ("correlation", "x_variance_explained", "y_variance_explained")])


@query("cca_weights")
def cca_weights(t):
    g = mv.array_gram(embedded(t).withColumn("v", F.concat("x", "y")), ["cohort"], "v")
    return mv.cca_weights(g, ["cohort"], 32, [f"x{i}" for i in range(32)] + [f"y{i}" for i in range(32)], 1).withColumn("weight", rnd("weight"))


@query("cca_scores")
def cca_scores(t):
    """Written as CSV and read back, with the summary beside it."""
    e = embedded(t)
    g = mv.array_gram(e.withColumn("v", F.concat("x", "y")), ["cohort"], "v")
    types = dict(e.dtypes)
    ids = f"cohort {types['cohort']}, vec_id {types['vec_id']}"
    folder = scratch_path(t.spark, "cca")
    scores.save_results({"scores": scores.cca_scores(e, g, ["cohort"], ["vec_id"], "x", "y", 32, 3)}, folder)
    back = scores.load_results(t.spark, folder, {"scores": f"{ids}, view string, component string, score double"})["scores"]
    return back.withColumn("score", rnd("score", 4))


@query("cca_permutation")
def cca_permutation(t):
    return mv.permuted_cca(embedded(t), ["cohort"], "session", "vec_id", "x", "y", 1000).select("cohort", "component", rnd("correlation").alias("correlation"), rnd("p_value").alias("p_value"))


@query("elastic_cca")
def elastic_cca(t):
    g = mv.array_gram(embedded(t).withColumn("v", F.concat("x", "y")), ["cohort"], "v")
    return mv.elastic_cca(g, ["cohort"], 32, [1e-3, 1e-2, 1e-1], [0.0, 0.5]).select("cohort", "alpha", "l1_ratio", rnd("correlation", 4).alias("correlation"), "best", "converged")


def cohorts(t):
    g = mv.array_gram(embedded(t).withColumn("v", F.concat("x", "y")), ["label"], "v")
    return mv.cohort_cca(g, "label", 32, 10, RIDGE)


@query("cohort_cca")
def cohort_cca(t):
    return cohorts(t).select("label", rnd("correlation").alias("correlation"), "n_recordings")


@query("cohort_pvalues")
def cohort_pvalues(t):
    """All variates of every cohort of the embeddings, whole sessions permuted within it."""
    p = mv.permuted_cca(embedded(t), ["label"], "session", "vec_id", "x", "y", 1000, ridge=RIDGE)
    return p.select("label", "component", rnd("correlation").alias("correlation"), rnd("p_value").alias("p_value"))


@query("cross_project")
def cross_project(t):
    return mv.cross_project(cohorts(t), "label", 32).withColumn("correlation", rnd("correlation"))


@query("compare_weights")
def compare_weights(t):
    return mv.compare_weights(cohorts(t), "label").select("cohort_a", "cohort_b", rnd("neural_cosine").alias("neural_cosine"), rnd("behavioral_cosine").alias("behavioral_cosine"))


@query("rank_normal_pca")
def rank_normal_pca(t):
    z = mv.rank_normal(t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_extendedprice", "l_tax"])
    scores, share = mv.pca_scores(z, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_extendedprice", "l_tax"])
    return share.withColumn("explained", rnd("explained")).join(
        scores.agg(rnd(F.var_pop("PC1"), 4).alias("PC1"), rnd(F.var_pop("PC2"), 4).alias("PC2")).unpivot([], ["PC1", "PC2"], "component", "variance"), "component")


def session_coefs(t):
    terms = ONE
    li = t["lineitem"].select((F.col("l_suppkey") % 10).alias("subject"), "l_suppkey", F.col("l_linestatus").alias("event"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    k = ["event", "subject", "l_suppkey"]
    return linear.main_effects(linear.ols_coefficients(linear.model_gram(li, k, terms, "y"), k, terms))


VAR_SQL = """se AS (SELECT l_linestatus AS event, l_suppkey % 10 AS subject, l_suppkey, regr_slope(l_extendedprice / 1000, l_quantity) AS b, sqrt(regr_syy(l_extendedprice / 1000, l_quantity) * (1 - regr_r2(l_extendedprice / 1000, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice / 1000, l_quantity)) AS s FROM lineitem GROUP BY ALL),
 big AS (SELECT event, subject FROM se GROUP BY ALL HAVING count(*) >= 5), ok AS (SELECT event FROM big GROUP BY event HAVING count(*) >= 4),
 z AS (SELECT event, subject, (b - avg(b) OVER w) / stddev_pop(b) OVER w AS z, s / stddev_pop(b) OVER w AS s FROM se JOIN big USING (event, subject) JOIN ok USING (event) WINDOW w AS (PARTITION BY event)), g AS (SELECT (i + 0.5) * 0.05 AS tau FROM (SELECT unnest(range(60)) AS i)),
 m AS (SELECT event, subject, ts.tau AS ts, sum(1 / (s * s + ts.tau * ts.tau)) AS w, sum(z / (s * s + ts.tau * ts.tau)) AS wz, sum(z * z / (s * s + ts.tau * ts.tau)) AS wzz, sum(-ln(s * s + ts.tau * ts.tau)) AS l FROM z, g ts GROUP BY ALL),
 p AS (SELECT event, ts, tm.tau AS tm, sum(w / (1 + tm.tau * tm.tau * w)) AS a, sum(wz / (1 + tm.tau * tm.tau * w)) AS b, sum(wzz - tm.tau * tm.tau / (1 + tm.tau * tm.tau * w) * wz * wz) AS c, sum(l - ln(1 + tm.tau * tm.tau * w)) AS d FROM m, g tm GROUP BY ALL),
 lp AS (SELECT event, ts, tm, 0.5 * (d - ln(a + 1) + b * b / (a + 1) - c - ts * ts - tm * tm) AS lp FROM p), pp AS (SELECT event, ts, tm, exp(lp - max(lp) OVER (PARTITION BY event)) AS p FROM lp)"""


@query("variance_component_means", with_sql(VAR_SQL, "SELECT event, 'V_mouse' AS component, rnd(sum(p * tm * tm) / sum(p)) AS mean FROM pp GROUP BY event UNION ALL SELECT event, 'V_session', rnd(sum(p * ts * ts) / sum(p)) FROM pp GROUP BY event"))
def variance_component_means(t):
    m = mv.variance_components(session_coefs(t), ["event", "regressor"], "subject", "coef", "coef_se")
    return mv.posterior_summary(m, ["event", "regressor"]).select("event", "component", rnd("mean").alias("mean"))


@query("variance_components")
def variance_components(t):
    m = mv.variance_components(session_coefs(t), ["event", "regressor"], "subject", "coef", "coef_se")
    return mv.posterior_summary(m, ["event", "regressor"]).select("event", "regressor", "component", "n_mice", "n_sessions", *[rnd(c, 5).alias(c) for c in ("mean", "hdi_low", "hdi_high")])


@query("variance_density")
def variance_density(t):
    m = mv.variance_components(session_coefs(t), ["event", "regressor"], "subject", "coef", "coef_se")
    return mv.posterior_density(m, ["event", "regressor"]).select("event", "component", rnd("x", 5).alias("x"), rnd("density", 4).alias("density"))
