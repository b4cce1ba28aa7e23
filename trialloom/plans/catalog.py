"""Queries: catalog sources, derivations, rules and joins (orders as the session catalog)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom import constants as K
from trialloom.operators import derive, relational as rel, rules
from trialloom.plans.inputs import CELLS_SQL, NUMBERED_SQL, RECORDINGS_SQL, SESSIONS_SQL, SIGNAL_SQL, TRIALS_SQL, with_sql
from trialloom.plans.registry import query, rnd
from trialloom.sources import tables as src


def joined(col):
    return F.array_join(col, ",", "NULL")


# --- sources ---------------------------------------------------------------------------

@query("enforce_schema", with_sql(SESSIONS_SQL, """SELECT eid, CASE WHEN eid % 9 = 0 THEN '' ELSE array_to_string(brain_region, ',') END AS brain_region, 0::BIGINT AS n_projects, lab, CAST(NULL AS VARCHAR) AS genotype FROM sessions"""))
def enforce_schema(t):
    s = t.sessions.withColumn("brain_region", F.when(F.col("eid") % 9 != 0, F.col("brain_region")))
    out = src.enforce_schema(s)
    return out.select("eid", joined("brain_region").alias("brain_region"), F.size("projects").cast("long").alias("n_projects"), "lab", "genotype")


@query("collect_catalog", with_sql(SESSIONS_SQL, "SELECT eid, subject, CASE WHEN eid % 8 = 0 THEN NULL ELSE lab END AS lab, session_type, len(brain_region) AS n_regions FROM sessions"))
def collect_catalog(t):
    raw = t.sessions.withColumn("lab", F.when(F.col("eid") % 8 == 0, src.NONE_SENTINEL).otherwise(F.col("lab")))
    path = src.scratch_path(t.spark, "sessions")
    raw.write.parquet(path)
    out = src.collect_catalog(t.spark.read.parquet(path))
    return out.select("eid", "subject", "lab", "session_type", F.size("brain_region").cast("long").alias("n_regions"))


def error_log(t):
    """Error rows of the catalog, in the log's text schema."""
    s = t.sessions.where("error_type IS NOT NULL")
    return s.select(F.col("eid").cast("string").alias("eid"), "error_type", F.concat(F.lit("lab "), "lab").alias("error_message"),
                    F.lit(None).cast("string").alias("traceback"))


@query("collect_errors", with_sql(SESSIONS_SQL, "SELECT CAST(eid AS VARCHAR) AS eid, error_type, 'lab ' || lab AS error_message, CAST(NULL AS VARCHAR) AS traceback FROM sessions WHERE error_type IS NOT NULL"))
def collect_errors(t):
    path = src.scratch_path(t.spark, "errors")
    error_log(t).write.parquet(path)
    return src.collect_errors(t.spark, path)


QC_PARTS_SQL = """qc AS (SELECT l_suppkey AS eid, l_returnflag AS brain_region, 'GCaMP' AS band, avg(l_tax) AS n_unique_samples, CAST(NULL AS DOUBLE) AS bleaching_tau FROM lineitem GROUP BY ALL
 UNION ALL SELECT l_suppkey, l_returnflag, 'Isosbestic', NULL, max(l_quantity) FROM lineitem GROUP BY ALL)"""


def qc_table(t):
    li = t["lineitem"].groupBy(F.col("l_suppkey").alias("eid"), F.col("l_returnflag").alias("brain_region"))
    a = li.agg(F.avg("l_tax").alias("n_unique_samples")).withColumn("band", F.lit("GCaMP"))
    b = li.agg(F.max("l_quantity").alias("bleaching_tau")).withColumn("band", F.lit("Isosbestic"))
    return src.collect_qc([a, b])


@query("collect_qc", with_sql(QC_PARTS_SQL, "SELECT eid, brain_region, band, rnd(n_unique_samples) AS n_unique_samples, bleaching_tau FROM qc"))
def collect_qc(t):
    return qc_table(t).select("eid", "brain_region", "band", rnd("n_unique_samples").alias("n_unique_samples"), "bleaching_tau")


@query("save_mixed_table", "SELECT c_custkey AS eid, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS mixed, c_acctbal FROM customer")
def save_mixed_table(t):
    df = t["customer"].select(F.col("c_custkey").alias("eid"), "c_acctbal",
                              F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.col("c_mktsegment")).alias("mixed"))
    path = src.save_table(df, src.scratch_path(t.spark, "mixed"), text_columns=["mixed"], timestamp="20240101T000000")
    return t.spark.read.parquet(path)


@query("load_scoped", "SELECT l_orderkey, l_suppkey AS eid, l_quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000)")
def load_scoped(t):
    path = src.scratch_path(t.spark, "responses")
    t["lineitem"].select("l_orderkey", F.col("l_suppkey").alias("eid"), "l_quantity").write.parquet(path)
    scope = t["supplier"].where("s_acctbal > 3000").select(F.col("s_suppkey").alias("eid"))
    return src.load_scoped(t.spark, path, scope)


ERR_ROLL = """SELECT CAST(s.eid AS VARCHAR) AS eid, coalesce(error_type, '') AS logged_errors FROM sessions s"""


@query("error_cache", with_sql(SESSIONS_SQL, ERR_ROLL))
def error_cache(t):
    eids = t.sessions.select(F.col("eid").cast("string").alias("eid"))
    path = src.scratch_path(t.spark, "errcache")
    src.load_or_collect_errors(error_log(t), eids, path)
    # The second call must read the cache even though the log it is given is empty.
    out = src.load_or_collect_errors(error_log(t).where("false"), eids, path)
    return out.withColumn("logged_errors", joined("logged_errors"))


@query("unprocessed_sessions", "SELECT o_orderkey AS eid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unprocessed_sessions(t):
    return src.unprocessed(t.sessions.select("eid"), t["lineitem"].select(F.col("l_orderkey").alias("eid")))


@query("upsert", "SELECT c_custkey AS eid, c_acctbal AS score, CAST(NULL AS VARCHAR) AS tag FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, c_acctbal * 2, c_mktsegment FROM customer WHERE c_custkey % 4 = 0")
def upsert(t):
    prev = t["customer"].select(F.col("c_custkey").alias("eid"), F.col("c_acctbal").alias("score"))
    batch = t["customer"].where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("eid"), (F.col("c_acctbal") * 2).alias("score"), F.col("c_mktsegment").alias("tag"))
    return src.upsert(prev, batch)


@query("csv_round_trip", "SELECT s_suppkey AS subject, s_name AS region, s_acctbal AS x_ml FROM supplier")
def csv_round_trip(t):
    path = src.scratch_path(t.spark, "fibers")
    src.write_csv(t["supplier"].select(F.col("s_suppkey").alias("subject"), F.col("s_name").alias("region"), F.col("s_acctbal").alias("x_ml")), path)
    return src.read_csv(t.spark, path, "subject long, region string, x_ml double")


@query("group_store", """SELECT 'signal' AS grp, user_id AS eid, count(*) AS n, rnd(sum(CASE WHEN user_id % 10 = 3 THEN -value ELSE value END), 4) AS total FROM events GROUP BY user_id
 UNION ALL SELECT 'trials', l_suppkey, count(*), rnd(sum(l_quantity), 4) FROM lineitem GROUP BY l_suppkey""")
def group_store(t):
    store = src.GroupStore(t.spark, src.scratch_path(t.spark, "store"), buckets=8)
    signal = t["events"].select(F.col("user_id").alias("eid"), "value")
    store.save("signal", signal)
    store.save("trials", t["lineitem"].select(F.col("l_suppkey").alias("eid"), F.col("l_quantity").alias("value")))
    store.save("signal", signal.where("eid % 10 = 3").withColumn("value", -F.col("value")))
    parts = [df.groupBy(F.lit(g).alias("grp"), "eid").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 4).alias("total"))
             for g, df in store.load(["signal", "trials"]).items()]
    return parts[0].unionByName(parts[1])


@query("collect_trials", with_sql(SESSIONS_SQL, "SELECT l_orderkey AS eid, l_linenumber, l_partkey, subject, session_type FROM lineitem JOIN sessions ON l_orderkey = eid"))
def collect_trials(t):
    trials = t["lineitem"].select(F.col("l_orderkey").alias("eid"), "l_linenumber", "l_partkey")
    return src.collect_trials(trials, t.sessions, ["subject", "session_type"])


@query("sessions_without_trials", "SELECT o_orderkey AS eid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def sessions_without_trials(t):
    return src.sessions_without(t.sessions, t["lineitem"].select(F.col("l_orderkey").alias("eid")))


def qc_json(t):
    """Outcome maps built from the k of events.props: a code, a boolean, a list and a number."""
    return t.signal.select("event_id", F.to_json(F.create_map(
        F.lit("_focus_qc"), F.element_at(F.array(F.lit("0"), F.lit("10"), F.lit("20"), F.lit("30"), F.lit("40"), F.lit("77")), (F.col("k") % 6 + 1).cast("int")),
        F.lit("pin_state"), F.when(F.col("k") % 2 == 0, "true").otherwise("false"),
        F.lit("timestamps_qc"), F.concat(F.lit("["), F.when(F.col("k") % 3 == 0, "10").otherwise("30"), F.lit(","), F.col("k"), F.lit(", 2]")))).alias("j"))


@query("extended_qc", with_sql(SIGNAL_SQL, """SELECT event_id, 'qc_focus' AS field, ['NOT_SET','PASS','WARNING','FAIL','CRITICAL','77'][CAST(k % 6 AS INT) + 1] AS verdict, 0::BIGINT AS n_detail FROM signal
 UNION ALL SELECT event_id, 'qc_pin_state', CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END, 0 FROM signal
 UNION ALL SELECT event_id, 'qc_timestamps', CASE WHEN k % 3 = 0 THEN 'PASS' ELSE 'FAIL' END, 2 FROM signal"""))
def extended_qc(t):
    long = src.extended_qc(qc_json(t), "event_id", "j")
    return long.select("event_id", "field", "verdict", F.coalesce(F.size("detail"), F.lit(0)).cast("long").alias("n_detail"))


@query("extended_qc_wide", with_sql(SIGNAL_SQL, """SELECT event_id, ['NOT_SET','PASS','WARNING','FAIL','CRITICAL','77'][CAST(k % 6 AS INT) + 1] AS qc_focus,
 CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS qc_pin_state, CASE WHEN k % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS qc_timestamps FROM signal"""))
def extended_qc_wide(t):
    return src.extended_qc_wide(src.extended_qc(qc_json(t), "event_id", "j"), "event_id", ["qc_focus", "qc_pin_state", "qc_timestamps"])


@query("resolve_regions", with_sql(SESSIONS_SQL, """, r AS (SELECT eid, CASE WHEN len(brain_region) > 0 AND eid % 2 = 0 THEN brain_region WHEN eid % 3 = 0 THEN ['LC-l', 'DR'] END AS rg FROM sessions)
 SELECT eid, array_to_string(rg, ',') AS brain_region, array_to_string(list_transform(rg, lambda x: CASE WHEN x LIKE '%-l' THEN 'l' WHEN x LIKE '%-r' THEN 'r' ELSE '' END), ',') AS hemisphere,
 CASE WHEN rg IS NULL THEN 'MissingBrainRegion' END AS region_error FROM r"""))
def resolve_regions(t):
    s = t.sessions
    desc = s.where("size(brain_region) > 0 AND eid % 2 = 0").select("eid", F.col("brain_region").alias("regions"))
    loc = s.where("eid % 3 = 0").select("eid", F.array(F.lit("LC-l"), F.lit("DR")).alias("regions"))
    out = src.resolve_regions(s.select("eid"), desc, loc)
    return out.select("eid", joined("brain_region").alias("brain_region"), joined("hemisphere").alias("hemisphere"), "region_error")


@query("subject_info", with_sql(SESSIONS_SQL, """, sub AS (SELECT c_custkey AS subject, CASE WHEN c_nationkey % 3 = 0 THEN 'Ai148xDATCre' ELSE 'B6.Cg' END AS strain, CASE WHEN c_nationkey % 2 = 0 THEN 'Ai148xChat' END AS line, 'wt/' || c_nationkey AS genotype FROM customer
  UNION ALL SELECT c_custkey, 'B6.Cg', NULL, NULL FROM customer WHERE c_custkey % 50 = 0),
 one AS (SELECT subject, count(*) AS n, min(strain) AS strain, min(line) AS line, min(genotype) AS genotype FROM sub GROUP BY subject)
 SELECT eid, CASE WHEN n = 1 THEN strain END AS strain, CASE WHEN n = 1 THEN genotype END AS genotype, CASE WHEN n = 1 THEN CASE WHEN strain = 'Ai148xDATCre' THEN 'DA' WHEN line = 'Ai148xChat' THEN 'ACh' END END AS nm,
 CASE WHEN coalesce(n, 0) <> 1 THEN 'SubjectNotUnique' END AS subject_error FROM sessions LEFT JOIN one USING (subject)"""))
def subject_info(t):
    c = t["customer"]
    sub = c.selectExpr("c_custkey AS subject", "CASE WHEN c_nationkey % 3 = 0 THEN 'Ai148xDATCre' ELSE 'B6.Cg' END AS strain", "CASE WHEN c_nationkey % 2 = 0 THEN 'Ai148xChat' END AS line", "concat('wt/', c_nationkey) AS genotype")
    sub = sub.unionByName(c.where("c_custkey % 50 = 0").selectExpr("c_custkey AS subject", "'B6.Cg' AS strain", "CAST(NULL AS string) AS line", "CAST(NULL AS string) AS genotype"))
    out = src.subject_info(t.sessions.select("eid", "subject"), sub, K.STRAIN_TO_NM, K.LINE_TO_NM)
    return out.select("eid", "strain", "genotype", F.col("NM").alias("nm"), "subject_error")


@query("enrich_sessions", with_sql(SESSIONS_SQL, """, one AS (SELECT c_custkey AS subject, CASE WHEN c_nationkey % 3 = 0 THEN 'DA' ELSE 'ACh' END AS nm FROM customer WHERE c_custkey % 50 <> 0),
 r AS (SELECT s.eid, one.subject IS NULL AS no_subject, one.nm AS nm, CASE WHEN len(brain_region) > 0 AND eid % 2 = 0 THEN brain_region WHEN eid % 3 = 0 THEN ['LC-l', 'DR'] END AS rg, s.session_type FROM sessions s LEFT JOIN one USING (subject)),
 tg AS (SELECT *, list_transform(rg, lambda x: regexp_replace(x, '-[lr]$', '') || '-' || nm) AS tg FROM r)
 SELECT eid, CASE WHEN eid % 11 = 0 OR eid % 13 = 0 THEN NULL ELSE session_type END AS session_type, array_to_string(rg, ',') AS brain_region,
 concat_ws(',', CASE WHEN no_subject THEN 'SubjectNotUnique' END, CASE WHEN rg IS NULL THEN 'MissingBrainRegion' END, CASE WHEN eid % 11 = 0 OR eid % 13 = 0 THEN 'InvalidSessionType' END,
  CASE WHEN len(list_filter(tg, lambda x: x IS NOT NULL AND NOT list_contains(['VTA-DA','SNc-DA','DR-5HT','MR-5HT','LC-NE','NBM-ACh','SI-ACh','PPT-ACh'], x))) > 0 THEN 'InvalidTargetNM' END,
  CASE WHEN eid % 19 = 0 OR eid % 24 = 23 THEN 'InvalidSessionLength' END) AS logged_errors FROM tg"""))
def enrich_sessions(t):
    s = t.sessions
    sub = t["customer"].where("c_custkey % 50 <> 0").selectExpr("c_custkey AS subject", "CASE WHEN c_nationkey % 3 = 0 THEN 'Ai148xDATCre' ELSE 'Ai148xChATCre' END AS strain", "CAST(NULL AS string) AS line")
    desc = s.where("size(brain_region) > 0 AND eid % 2 = 0").select("eid", F.col("brain_region").alias("regions"))
    loc = s.where("eid % 3 = 0").select("eid", F.array(F.lit("LC-l"), F.lit("DR")).alias("regions"))
    out = src.enrich_sessions(s.select("eid", "subject", "task_protocol", "start_time", "end_time"), sub, desc, loc, K.STRAIN_TO_NM, K.LINE_TO_NM)
    return out.select("eid", "session_type", joined("brain_region").alias("brain_region"), joined("logged_errors").alias("logged_errors"))


@query("id_allow_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def id_allow_list(t):
    path = src.scratch_path(t.spark, "ids")
    big = t["lineitem"].where("l_quantity > 48").select(F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("value"))
    big.unionByName(t.spark.createDataFrame([("",)], "value string")).write.text(path)
    ids = src.read_ids(t.spark, path).select(F.col("eid").cast("long").alias("o_orderkey"))
    return src.keep_listed(t["orders"].select("o_orderkey", "o_totalprice"), ids, "o_orderkey")


@query("merge_labels", "SELECT doc_id AS eid, CASE WHEN doc_id % 3 = 0 THEN 'FAIL' WHEN doc_id = 5 THEN 'WARNING' WHEN quality = 1 THEN 'PASS' ELSE 'NOT_SET' END AS focus FROM labels")
def merge_labels(t):
    auto = t["labels"].select(F.col("doc_id").alias("eid"), F.when(F.col("quality") == 1, "PASS").alias("focus"))
    manual = t["labels"].select(F.col("doc_id").alias("eid"), F.when(F.col("doc_id") % 3 == 0, "FAIL").otherwise("NOT_SET").alias("focus"))
    manual = src.apply_label(manual, 5, "focus", "WARNING", ["focus"], K.QC_ORDER)
    return src.merge_labels(auto, manual, ["focus"])


# --- derivations --------------------------------------------------------------------------

def datasets_of(t):
    """Pages as sessions whose dataset lists follow from the page number."""
    names = [n for group in K.DATASET_CATEGORIES.values() for n in group]
    every = F.array(*[F.when(F.col("page_id") % (i + 2) == 0, F.lit(n)) for i, n in enumerate(names)])
    return t["pages"].select(F.col("page_id").alias("eid"), F.when(F.col("page_id") % 7 != 0, F.filter(every, lambda x: x.isNotNull())).alias("datasets"))


def _flags_sql():
    out, i = [], 2
    for name, group in K.DATASET_CATEGORIES.items():
        cond = " OR ".join(f"page_id % {i + j} = 0" for j in range(len(group)))
        out.append(f"(page_id % 7 <> 0 AND ({cond})) AS has_{name}")
        i += len(group)
    return ", ".join(out)


@query("dataset_flags", f"SELECT page_id AS eid, {_flags_sql()} FROM pages")
def dataset_flags(t):
    return derive.dataset_flags(datasets_of(t)).drop("datasets")


@query("session_type", with_sql(SESSIONS_SQL, """SELECT eid, CASE WHEN eid % 11 = 0 OR eid % 13 = 0 THEN NULL ELSE session_type END AS session_type,
 CASE WHEN eid % 11 = 0 OR eid % 13 = 0 THEN 'InvalidSessionType' END AS type_error FROM sessions"""))
def session_type(t):
    return derive.session_type(t.sessions.select("eid", "task_protocol")).select("eid", "session_type", "type_error")


@query("target_nm", with_sql(SESSIONS_SQL, """, tn AS (SELECT eid, list_transform(brain_region, lambda r: regexp_replace(r, '-[lr]$', '') || '-' || NM) AS tg FROM sessions)
 SELECT eid, array_to_string(tg, ',') AS target_NM, CASE WHEN len(list_filter(tg, lambda x: NOT list_contains(['VTA-DA','SNc-DA','DR-5HT','MR-5HT','LC-NE','NBM-ACh','SI-ACh','PPT-ACh'], x))) > 0 THEN 'InvalidTargetNM' END AS target_error FROM tn"""))
def target_nm(t):
    return derive.target_nm(t.sessions.select("eid", "brain_region", "NM")).select("eid", joined("target_NM").alias("target_NM"), "target_error")


@query("target_nm_from_region", with_sql(SESSIONS_SQL, """, tn AS (SELECT eid, list_transform(brain_region, lambda r: regexp_replace(r, '-[lr]$', '') || '-' ||
 MAP {'VTA':'DA','SNc':'DA','DR':'5HT','MR':'5HT','LC':'NE','NBM':'ACh','SI':'ACh','PPT':'ACh'}[regexp_replace(r, '-[lr]$', '')]) AS tg FROM sessions)
 SELECT eid, array_to_string(tg, ',') AS target_NM, split_part(tg[1], '-', 2) AS NM FROM tn"""))
def target_nm_from_region(t):
    return derive.target_nm_from_region(t.sessions.select("eid", "brain_region")).select("eid", joined("target_NM").alias("target_NM"), "NM")


@query("session_length", with_sql(SESSIONS_SQL, "SELECT eid, CASE WHEN eid % 19 <> 0 AND eid % 24 <> 23 THEN 2430.0::DOUBLE END AS session_length, CASE WHEN eid % 19 = 0 OR eid % 24 = 23 THEN 'InvalidSessionLength' END AS length_error FROM sessions"))
def session_length(t):
    return derive.session_length(t.sessions.select("eid", "start_time", "end_time")).select("eid", "session_length", "length_error")


@query("fix_regions", with_sql(SESSIONS_SQL, "SELECT eid, array_to_string(brain_region, ',') AS brain_region FROM sessions"))
def fix_regions(t):
    old = F.transform("brain_region", lambda r: F.regexp_replace(F.regexp_replace(r, "^DR", "DRN"), "^SNc", "SNC"))
    return derive.fix_regions(t.sessions.select("eid", old.alias("brain_region"))).select("eid", joined("brain_region").alias("brain_region"))


TID = "l_orderkey, l_linenumber, l_partkey"
TCOLS = ["l_orderkey", "l_linenumber", "l_partkey"]
CON_SQL = TRIALS_SQL + """, con AS (SELECT *, CASE WHEN contrastLeft IS NULL THEN 'right' ELSE 'left' END AS stim_side, coalesce(contrastRight, contrastLeft, 0) * 100 AS contrast,
 CASE WHEN contrastLeft IS NULL THEN coalesce(contrastRight, 0) * 100 ELSE -contrastLeft * 100 END + 0.0 AS signed_contrast FROM trials)"""
REL_SQL = CON_SQL + """, rel AS (SELECT *, CASE WHEN (stim_side = 'left') = (hemisphere = 'r') THEN 'contra' ELSE 'ipsi' END AS side,
 CASE WHEN (choice <> -1) = (hemisphere = 'r') THEN 'contra' ELSE 'ipsi' END AS choice_side, signed_contrast * CASE WHEN hemisphere = 'r' THEN -1 ELSE 1 END + 0.0 AS relative_contrast FROM con)"""


def contrasted(t):
    return derive.trial_contrasts(t.trials)


@query("trial_contrasts", with_sql(CON_SQL, f"SELECT {TID}, stim_side, contrast, signed_contrast FROM con"))
def trial_contrasts(t):
    return contrasted(t).select(*TCOLS, "stim_side", "contrast", (F.col("signed_contrast") + 0.0).alias("signed_contrast"))


@query("relative_contrast", with_sql(REL_SQL, f"SELECT {TID}, side, choice_side, relative_contrast FROM rel"))
def relative_contrast(t):
    return derive.relative_contrast(contrasted(t)).select(*TCOLS, "side", "choice_side", (F.col("relative_contrast") + 0.0).alias("relative_contrast"))


@query("contrast_codings", with_sql(CON_SQL, f"""SELECT {TID}, rnd(ln(contrast + 1)) AS c_log, rnd(exp(ln(contrast + 1)) - 1) AS c_back, CASE WHEN contrast = 0 THEN 0.0::DOUBLE ELSE rnd(log2(contrast)) END AS c_log2,
 dense_rank() OVER (ORDER BY contrast) - 1 AS contrast_rank FROM con"""))
def contrast_codings(t):
    df = derive.contrast_rank(contrasted(t), "contrast")
    return df.select(*TCOLS, rnd(derive.contrast_log("contrast")).alias("c_log"), rnd(derive.contrast_log_inverse(derive.contrast_log("contrast"))).alias("c_back"),
                     F.when(F.col("contrast") == 0, 0.0).otherwise(rnd(derive.contrast_log2("contrast"))).alias("c_log2"), "contrast_rank")


@query("code_predictors", with_sql(REL_SQL, f""", lc AS (SELECT *, CASE WHEN contrast = 0 THEN 0 ELSE log2(contrast) END AS lcx FROM rel)
 SELECT {TID}, rnd(lcx - avg(lcx) OVER (PARTITION BY eid)) AS contrast, CASE WHEN side = 'contra' THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS side,
 CASE WHEN choice_side = 'contra' THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS choice_side, CASE WHEN feedbackType = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS reward FROM lc"""))
def code_predictors(t):
    out = derive.code_predictors(derive.relative_contrast(contrasted(t)), ["eid"])
    return out.select(*TCOLS, rnd("contrast").alias("contrast"), "side", "choice_side", "reward")


@query("trial_regressors", with_sql(CON_SQL, f"""SELECT {TID}, eid, day, contrast, stim_side, choice, rnd(firstMovement_times - stimOn_times) AS reaction_time, rnd(feedback_times - firstMovement_times) AS movement_time,
 rnd(feedback_times - stimOn_times) AS response_time, wheel AS peak_velocity FROM con"""))
def trial_regressors(t):
    keys = [*TCOLS, "eid", "day"]
    peak = t.trials.select(*keys, F.col("wheel").alias("peak_velocity"))
    out = derive.trial_regressors(contrasted(t), keys, peak)
    return out.select(*TCOLS, "eid", F.col("day").cast("long").alias("day"), "contrast", "stim_side", "choice", *[rnd(x).alias(x) for x in ("reaction_time", "movement_time", "response_time")], "peak_velocity")


@query("fiber_tips", """SELECT p_partkey, rnd(p_size - p_retailprice * sin(radians(p_size)) * cos(radians(p_partkey % 360))) AS tip_x, rnd(p_size * 2 - p_retailprice * sin(radians(p_size)) * sin(radians(p_partkey % 360))) AS tip_y,
 rnd(p_size * 3 - p_retailprice * cos(radians(p_size))) AS tip_z FROM part""")
def fiber_tips(t):
    df = t["part"].selectExpr("p_partkey", "p_size AS x", "p_size * 2 AS y", "p_size * 3 AS z", "p_retailprice AS depth", "p_size AS theta", "p_partkey % 360 AS phi")
    return derive.fiber_tip(df).select("p_partkey", *[rnd(x).alias(x) for x in ("tip_x", "tip_y", "tip_z")])


@query("session_order", with_sql(SESSIONS_SQL, "SELECT eid, subject, date_diff('day', min(day) OVER (PARTITION BY subject), day) AS day_n, dense_rank() OVER (PARTITION BY subject ORDER BY day) AS session_n FROM sessions"))
def session_order(t):
    return derive.session_order(t.sessions).select("eid", "subject", "day_n", "session_n")


@query("proficiency_label", with_sql(SESSIONS_SQL, "SELECT eid, (session_type <> 'training' OR (eid % 6 <> 0 AND coalesce(fraction_correct, 0) >= 0.7)) AS proficient FROM sessions"))
def proficiency_label(t):
    return t.sessions.select("eid", derive.proficient().alias("proficient"))


@query("qc_scores", """SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN -1.0::DOUBLE ELSE rnd((CASE WHEN quality = 1 THEN 1.0 ELSE 0.1 END + CASE WHEN toxic = 1 THEN 0.33 ELSE 0.66 END + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END) / CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 3 END) END AS score,
 CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS focus_score FROM labels""")
def qc_scores(t):
    df = t["labels"].select("doc_id", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("a"), F.when(F.col("toxic") == 1, "CRITICAL").otherwise("WARNING").alias("b"),
                            F.when(F.col("doc_id") % 4 != 0, "PASS").alias("c"), F.array(F.when(F.col("doc_id") % 6 == 5, "MissingVideoTimestamps").otherwise("other")).alias("errs"))
    score = derive.video_score("errs", ["MissingVideoTimestamps"], ["a", "b", "c"])
    return df.select("doc_id", F.when(score < 0, score).otherwise(rnd(score)).alias("score"), derive.qc_score("a").alias("focus_score"))


@query("pose_timing", """SELECT event_id, rnd(CASE WHEN value > 0 THEN ln(value) END) AS log_mean_rt, greatest(abs(value - 100), abs(value - 50), abs(value - 20)) AS max_abs_lag, abs((value - 20) - (value - 100)) AS abs_drift,
 value / 200 > 0.5 AS timing_ok FROM events""")
def pose_timing(t):
    df = t["events"].selectExpr("event_id", "value AS mean_rt", "value - 100 AS lag_early", "value - 50 AS lag_mid", "value - 20 AS lag_late", "value / 400 AS peak_early", "value / 300 AS peak_mid", "value / 200 AS peak_late")
    return derive.pose_timing(df).select("event_id", rnd("log_mean_rt").alias("log_mean_rt"), "max_abs_lag", "abs_drift", "timing_ok")


@query("start_epoch", with_sql(SESSIONS_SQL, "SELECT eid, CASE WHEN eid % 31 <> 0 THEN CAST(epoch(CAST(start_time AS TIMESTAMP)) AS DOUBLE) END AS start_epoch FROM sessions"))
def start_epoch(t):
    bad = F.when(F.col("eid") % 31 == 0, "not a date").otherwise(F.col("start_time"))
    return t.sessions.select("eid", derive.epoch_seconds(bad).alias("start_epoch"))


@query("trial_display", with_sql(CON_SQL, f"SELECT {TID}, stim_side, feedbackType = 1 AS correct, rnd(5 - stimOn_times) AS to_stim, rnd(5 - firstMovement_times) AS to_move, least(greatest(l_tax * 20, 0), 1) AS alpha FROM con"))
def trial_display(t):
    df = derive.trial_display(t.trials.withColumns({"frame": F.lit(5.0), "lik": F.col("l_tax") * 20}), "frame", "lik")
    return df.select(*TCOLS, "stim_side", "correct", rnd("to_stimOn_times").alias("to_stim"), rnd("to_firstMovement_times").alias("to_move"), "alpha")


def _erf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x})))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


@query("psychometric_curves", "SELECT s_nationkey, rnd(-100 + 2 * i) AS x, rnd(avg(0.1 + 0.85 * (" + _erf_sql("((-100 + 2 * i - s_acctbal / 500) / (10 + s_suppkey % 20))")
       + " + 1) / 2)) AS p, count(*) AS n_fits FROM supplier, (SELECT unnest(range(101)) AS i) GROUP BY s_nationkey, i")
def psychometric_curves(t):
    fits = t["supplier"].selectExpr("s_nationkey", "s_acctbal / 500 AS bias", "10 + s_suppkey % 20 AS threshold", "0.1D AS lapse_left", "0.05D AS lapse_right")
    out = derive.curve_table(fits, ["s_nationkey"])
    return out.select("s_nationkey", rnd("x").alias("x"), rnd("p").alias("p"), "n_fits")


@query("lateralized_parameters", with_sql(RECORDINGS_SQL, """, perf AS (SELECT o_orderkey AS eid, o_totalprice / 1000 AS bias, 0.5 AS bias_shift, (o_orderkey % 10) / 10.0::DOUBLE AS ll, (o_orderkey % 7) / 7.0::DOUBLE AS lr FROM orders WHERE o_orderkey % 12 <> 0)
 SELECT eid, fiber_idx, rnd(bias * CASE WHEN hemisphere = 'r' THEN -1 ELSE 1 END) AS bias, CASE WHEN hemisphere = 'l' THEN rnd(lr) ELSE rnd(ll) END AS lapse_contra, CASE WHEN hemisphere = 'l' THEN rnd(ll) ELSE rnd(lr) END AS lapse_ipsi
 FROM recordings LEFT JOIN perf USING (eid)"""))
def lateralized_parameters(t):
    perf = t["orders"].where("o_orderkey % 12 <> 0").selectExpr("o_orderkey AS eid", "o_totalprice / 1000 AS bias", "0.5D AS bias_shift", "(o_orderkey % 10) / 10D AS lapse_left", "(o_orderkey % 7) / 7D AS lapse_right")
    out = derive.psychometric_features(recordings_view(t), perf)
    return out.select("eid", F.col("fiber_idx").cast("long").alias("fiber_idx"), rnd("bias").alias("bias"), rnd("lapse_contra").alias("lapse_contra"), rnd("lapse_ipsi").alias("lapse_ipsi"))


@query("feature_parts", with_sql(REL_SQL, """SELECT DISTINCT split_part(event, '_times', 1) || '_times' AS event, contrast, side, CASE WHEN feedbackType = 1 THEN 'correct' ELSE 'incorrect' END AS feedback FROM rel"""))
def feature_parts(t):
    r = derive.relative_contrast(contrasted(t))
    label = F.concat_ws("_", "event", F.concat(F.lit("c"), F.col("contrast").cast("string")), "side", F.when(F.col("feedbackType") == 1, "correct").otherwise("incorrect"))
    return derive.feature_parts(r.select(label.alias("feature")).distinct()).select("event", "contrast", "side", "feedback")


@query("contrast_shades", with_sql(CON_SQL, f"SELECT {TID}, rnd(1 - (dense_rank() OVER (ORDER BY contrast) - 1) / 4.0::DOUBLE) AS shade FROM con"))
def contrast_shades(t):
    return derive.contrast_shade(contrasted(t), "signed_contrast").select(*TCOLS, rnd("shade").alias("shade"))


@query("model_terms", "SELECT term, n_columns, l_returnflag AS unit, rnd(s, 2) AS total FROM (SELECT l_returnflag, sum(l_quantity) AS a, sum(l_quantity * l_tax) AS b, sum(l_tax) AS c FROM lineitem GROUP BY 1), LATERAL (VALUES ('l_quantity', 1::BIGINT, a), ('l_tax', 1, c), ('l_quantity:l_tax', 2, b)) v(term, n_columns, s)")
def model_terms(t):
    terms = derive.crossed("l_quantity", "l_tax")
    agg = t["lineitem"].groupBy(F.col("l_returnflag").alias("unit")).agg(*[F.sum(derive.term_value(x)).alias(derive.term_name(x)) for x in terms])
    long = agg.unpivot(["unit"], [f"`{derive.term_name(x)}`" for x in terms], "term", "total")
    return long.select(F.regexp_replace("term", "`", "").alias("term"), (F.size(F.split("term", ":"))).cast("long").alias("n_columns"), "unit", rnd("total", 2).alias("total"))


# --- filters and rules ----------------------------------------------------------------------

FILTERS = dict(session_types=K.ANALYSED_SESSION_TYPES[:2], exclude_subjects=[1, 2, 3], exclude_eids=[10, 20], blockers=K.ANALYSIS_BLOCKERS,
               target_nms=["VTA-DA", "SNc-DA", "DR-5HT"], min_performance={"training": 0.3}, required_contrasts=K.REQUIRED_CONTRASTS, lab=None, start_min="1995-02-01")


def filterable(t):
    s = derive.target_nm_from_region(t.sessions)
    return s.withColumn("logged_errors", F.array_compact(F.array("error_type")))


FILTER_SQL = SESSIONS_SQL + """, f AS (SELECT eid, session_type IN ('training','biased') AS session_types, subject NOT IN (1,2,3) AS exclude_subjects, eid NOT IN (10, 20) AS exclude_eids,
 min(start_time) OVER (PARTITION BY subject) >= '1995-02-01' AS start_time_min, coalesce(error_type, '') <> 'InsufficientTrials' AS qc_blockers,
 len(list_filter(brain_region, lambda r: regexp_replace(r, '-[lr]$', '') IN ('VTA','SNc','DR'))) > 0 AS target_nms,
 (session_type <> 'training' OR coalesce(fraction_correct >= 0.3, false)) AS min_performance, eid % 6 <> 0 AS required_contrasts FROM sessions)"""
PREDICATES = ["session_types", "exclude_subjects", "exclude_eids", "start_time_min", "qc_blockers", "target_nms", "min_performance", "required_contrasts"]


@query("filter_sessions", with_sql(FILTER_SQL, "SELECT eid FROM f WHERE " + " AND ".join(PREDICATES)))
def filter_sessions(t):
    return rules.filter_sessions(filterable(t), **FILTERS).select("eid")


@query("filter_removals", with_sql(FILTER_SQL, " UNION ALL ".join(f"SELECT '{p}' AS predicate, count(*) AS n_removed FROM f WHERE NOT {p}" for p in PREDICATES)))
def filter_removals(t):
    return rules.removal_counts(rules.with_subject_start(filterable(t)), **FILTERS)


@query("clean_sessions", with_sql(SESSIONS_SQL, "SELECT eid, subject, session_type FROM sessions WHERE subject NOT IN (4, 5, 6) AND session_type NOT IN ('ephys')"))
def clean_sessions(t):
    return rules.clean_sessions(t.sessions, [4, 5, 6], ["ephys"]).select("eid", "subject", "session_type")


@query("cleaning_report", with_sql(SESSIONS_SQL, """SELECT 'subject' AS reason, CAST(subject AS VARCHAR) AS value, count(*) AS n_removed FROM sessions WHERE subject IN (4, 5, 6) GROUP BY subject
 UNION ALL SELECT 'session_type', session_type, count(*) FROM sessions WHERE subject NOT IN (4, 5, 6) AND session_type = 'ephys' GROUP BY session_type"""))
def cleaning_report(t):
    return rules.cleaning_report(t.sessions, [4, 5, 6], ["ephys"])


@query("validate_parallel_lists", with_sql(SESSIONS_SQL, "SELECT eid FROM sessions WHERE len(brain_region) = len(hemisphere)"))
def validate_parallel_lists(t):
    return rules.validate_parallel_lists(t.sessions, ["brain_region", "hemisphere"]).select("eid")


def rule_input(t):
    regions = F.when(F.col("eid") % 14 == 0, F.concat("brain_region", F.array(F.lit("XYZ-l")))).otherwise(F.col("brain_region")).alias("brain_region")
    s = t.sessions.select("eid", regions, "NM", F.when(F.col("subject") % 97 == 0, "test_mouse").otherwise(F.col("subject").cast("string")).alias("subject"),
                          F.when(F.col("eid") % 15 == 0, "wild").otherwise("C57BL/6J").alias("strain"), F.when(F.col("eid") % 21 == 0, None).otherwise("Ai148xDat").alias("line"),
                          F.when(F.col("eid") % 10 == 0, F.array(F.lit("alf/_ibl_trials.table.pqt"))).otherwise(
                              F.array(F.lit("alf/task_00/_ibl_trials.table.pqt"), F.lit("alf/_ibl_wheel.position.npy"))).alias("datasets"))
    return derive.dataset_flags(s)


@query("catalog_errors", with_sql(SESSIONS_SQL, """SELECT eid, 'InvalidSubject' AS error_type, 'test_mouse' AS error_message FROM sessions WHERE subject % 97 = 0
 UNION ALL SELECT eid, 'InvalidStrain', 'wild' FROM sessions WHERE eid % 15 = 0 UNION ALL SELECT eid, 'InvalidLine', 'none' FROM sessions WHERE eid % 21 = 0
 UNION ALL SELECT eid, 'InvalidNeuromodulator', NM FROM sessions WHERE NM = 'XX' UNION ALL SELECT eid, 'MissingBrainRegion', 'no region' FROM sessions WHERE len(brain_region) = 0 AND eid % 14 <> 0
 UNION ALL SELECT eid, 'InvalidBrainRegion', 'XYZ' FROM sessions WHERE eid % 14 = 0
 UNION ALL SELECT eid, 'DataNotListed', 'extracted_wheel' FROM sessions WHERE eid % 10 = 0"""))
def catalog_errors(t):
    r = rules.catalog_rules(K.EXCLUDED_SUBJECTS, K.VALID_STRAINS, K.VALID_LINES, K.VALID_NEUROMODULATORS, K.VALID_TARGETS, ["extracted_task", "extracted_wheel"])
    return rules.error_rows(rule_input(t), r).drop("traceback")


def fibers(t):
    """Fiber table: every customer has three insertions, some in one region, some on the midline."""
    targets = F.array(*[F.lit(x) for x in K.VALID_TARGETS])
    rows = t["customer"].select(F.col("c_custkey").alias("subject"), "c_acctbal", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fiber"))
    return rows.select("subject", "fiber", F.element_at(targets, ((F.col("subject") + F.col("fiber") * (F.col("subject") % 3)) % 8 + 1).cast("int")).alias("region"),
                       F.expr("CASE WHEN (subject + fiber) % 5 = 0 THEN 0D WHEN (subject + fiber * (subject % 4)) % 2 = 0 THEN -abs(c_acctbal) ELSE abs(c_acctbal) END").alias("x_ml"))


FIBERS_SQL = """fibers AS (SELECT c_custkey AS subject, fiber, ['VTA','SNc','DR','MR','LC','NBM','SI','PPT'][CAST((c_custkey + fiber * (c_custkey % 3)) % 8 AS INT) + 1] AS region,
 CASE WHEN (c_custkey + fiber) % 5 = 0 THEN 0 WHEN (c_custkey + fiber * (c_custkey % 4)) % 2 = 0 THEN -abs(c_acctbal) ELSE abs(c_acctbal) END AS x_ml FROM customer, (SELECT unnest([0, 1, 2]) AS fiber)),
 sided AS (SELECT *, CASE WHEN x_ml > 0 THEN 'l' WHEN x_ml < 0 THEN 'r' END AS side FROM fibers)"""
HEMI_SQL = FIBERS_SQL + """, fh AS (SELECT subject, region, CASE WHEN count(DISTINCT side) = 1 THEN list(side ORDER BY fiber)[1] END AS fiber_hemisphere FROM sided GROUP BY subject, region)"""


@query("fiber_hemispheres", with_sql(HEMI_SQL, "SELECT subject, region, fiber_hemisphere FROM fh"))
def fiber_hemispheres(t):
    return rel.fiber_hemispheres(fibers(t))


@query("hemisphere_errors", with_sql(SESSIONS_SQL + ", " + HEMI_SQL, """, p AS (SELECT eid, subject, brain_region[i] AS rs, hemisphere[i] AS hemi, i AS pos FROM (SELECT eid, subject, brain_region, hemisphere,
  unnest(range(1, least(len(brain_region), len(hemisphere)) + 1)) AS i FROM sessions)),
 j AS (SELECT p.*, fiber_hemisphere AS f FROM p LEFT JOIN fh ON p.subject = fh.subject AND fh.region = regexp_replace(rs, '-[lr]$', '')),
 e AS (SELECT eid, pos, rs, CASE WHEN hemi <> '' AND f <> hemi THEN 'HemisphereMismatch' WHEN f IS NULL THEN 'MissingInsertion' WHEN coalesce(hemi, '') = '' THEN 'MissingHemiSuffix' END AS k FROM j),
 first AS (SELECT eid, arg_min(k, pos) AS error_type, arg_min(coalesce(rs, ''), pos) AS error_message FROM e WHERE k IS NOT NULL GROUP BY eid)
 SELECT * FROM first UNION ALL SELECT eid, 'MissingHemisphere', '' FROM sessions WHERE coalesce(len(hemisphere), 0) = 0"""))
def hemisphere_errors(t):
    return rules.hemisphere_errors(t.sessions, rel.fiber_hemispheres(fibers(t))).drop("traceback")


@query("session_rule_errors", with_sql(SIGNAL_SQL, """, s AS (SELECT eid, count(*) AS n, min(t) AS a, max(t) AS b, avg(CASE WHEN k > 20 THEN 1.0 ELSE 0.0 END) AS share, sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS inv, count(DISTINCT floor(value / 50)) / count(*)::DOUBLE AS u FROM signal GROUP BY eid)
 SELECT eid, 'InsufficientTrials' AS error_type FROM s WHERE n < 65 UNION ALL SELECT eid, 'IncompleteEventTimes' FROM s WHERE share < 0.8 UNION ALL SELECT eid, 'TrialsNotInPhotometryTime' FROM s WHERE a < 20000 OR b > 2580000
 UNION ALL SELECT eid, 'QCValidationError' FROM s WHERE inv > 0 UNION ALL SELECT eid, 'FewUniqueSamples' FROM s WHERE u < 0.1"""))
def session_rule_errors(t):
    s = t.signal.withColumn("goCue_times", F.when(F.col("k") > 20, F.col("t")))
    summary = rules.session_summary(s, "eid", ["goCue_times"], "t")
    qc = s.groupBy("eid").agg(F.count_if(F.col("value") < 1).alias("n_band_inversions"), F.lit(0).alias("n_early_samples"),
                              (F.count_distinct(F.floor(F.col("value") / 50)) / F.count(F.lit(1))).alias("n_unique_samples"))
    j = summary.join(qc, "eid").withColumns({"signal_start": F.lit(20000.0), "signal_end": F.lit(2580000.0)})
    return rules.error_rows(j, rules.session_rules(["goCue_times"], 65, 0.8)).select("eid", "error_type")


@query("video_rule_errors", """SELECT doc_id AS eid, 'VideoLengthError' AS error_type FROM documents WHERE n_chars > 2120 UNION ALL SELECT doc_id, 'VideoTimestampsQCError' FROM documents WHERE lang <> 'en'
 UNION ALL SELECT doc_id, 'VideoDroppedFramesQCError' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'VideoPinStateQCError' FROM documents WHERE source <> 'src1'""")
def video_rule_errors(t):
    d = t["documents"].select(F.col("doc_id").alias("eid"), (F.col("n_chars") - 2000.5).alias("len"), F.when(F.col("lang") == "en", "PASS").otherwise("FAIL").alias("ts"),
                              F.when(F.col("doc_id") % 5 != 0, "PASS").alias("dr"), F.when(F.col("source") == "src1", "PASS").otherwise("WARNING").alias("pin"))
    return rules.error_rows(d, rules.video_rules("len", "ts", "dr", "pin")).select("eid", "error_type")


def timed_trials(t):
    return t.trials.withColumns({"reaction_time": F.col("firstMovement_times") - F.col("stimOn_times"), "response_time": F.col("feedback_times") - F.col("stimOn_times")})


MODEL_TRIALS_SQL = TRIALS_SQL + """, mt AS (SELECT *, firstMovement_times - stimOn_times AS rt FROM trials WHERE response IS NOT NULL AND choice <> 0 AND feedback_times - stimOn_times > 0.05)"""


@query("modeling_trials", with_sql(MODEL_TRIALS_SQL, f"SELECT {TID}, response, CASE WHEN rt > 0 THEN rnd(log10(rt)) END AS log_reaction_time FROM mt"))
def modeling_trials(t):
    return rules.modeling_trials(timed_trials(t)).select(*TCOLS, "response", rnd("log_reaction_time").alias("log_reaction_time"))


@query("modeling_trials_block", with_sql(MODEL_TRIALS_SQL, f"SELECT {TID}, response FROM mt WHERE probabilityLeft = 0.5"))
def modeling_trials_block(t):
    return rules.modeling_trials(timed_trials(t), probability_left=0.5).select(*TCOLS, "response")


@query("complete_cases", with_sql(TRIALS_SQL, f", cc AS (SELECT *, count(*) OVER (PARTITION BY eid, event) AS n FROM trials WHERE response IS NOT NULL AND firstMovement_times IS NOT NULL AND contrastLeft IS NOT NULL) SELECT {TID} FROM cc WHERE n >= 140"))
def complete_cases(t):
    return rules.complete_cases(t.trials, ["response", "firstMovement_times", "contrastLeft"], ["eid", "event"], 140).select(*TCOLS)


@query("population_filter", with_sql(SESSIONS_SQL, "SELECT eid FROM sessions WHERE session_type IN ('training', 'ephys') AND lab IN ('1-URGENT', '2-HIGH') AND fraction_correct BETWEEN 0.2 AND 0.8"))
def population_filter(t):
    return t.sessions.where(rules.population_mask(["training", "ephys"], {"lab": ["1-URGENT", "2-HIGH"], "priority": []}, {"fraction_correct": (0.2, 0.8)})).select("eid")


@query("sample_recording", with_sql(SESSIONS_SQL, """SELECT eid, price FROM sessions, (SELECT quantile_cont(price, 0.4) AS lo, quantile_cont(price, 0.6) AS hi FROM sessions)
 WHERE price BETWEEN lo AND hi ORDER BY md5('7|' || eid), eid LIMIT 1"""))
def sample_recording(t):
    return rules.sample_between_percentiles(t.sessions.select("eid", "price"), "price", 0.4, 0.6, "eid", 7)


@query("nth_recording", with_sql(RECORDINGS_SQL, "SELECT eid, fiber_idx, brain_region FROM recordings ORDER BY start_time DESC, eid, fiber_idx LIMIT 1 OFFSET 25"))
def nth_recording(t):
    r = recordings_view(t).withColumn("fiber_idx", F.col("fiber_idx").cast("long"))
    return rules.nth_recording(r, [F.desc("start_time"), "eid", "fiber_idx"], 25).select("eid", "fiber_idx", "brain_region")


@query("merged_logs", with_sql(SESSIONS_SQL, """SELECT CAST(eid AS VARCHAR) AS eid, error_type, 'lab ' || lab AS error_message FROM sessions WHERE error_type IS NOT NULL
 UNION SELECT CAST(doc_id AS VARCHAR), 'MissingRawData', lang FROM documents WHERE n_chars > 3000"""))
def merged_logs(t):
    extra = t["documents"].where("n_chars > 3000").select(F.col("doc_id").cast("string").alias("eid"), F.lit("MissingRawData").alias("error_type"), F.col("lang").alias("error_message"))
    return rules.concat_logs([error_log(t), extra, error_log(t)]).drop("traceback")


@query("errors_by_session", with_sql(SESSIONS_SQL, "SELECT CAST(eid AS VARCHAR) AS eid, concat_ws(',', error_type, CASE WHEN eid % 3 = 0 THEN 'VideoQCFail' END) AS logged_errors FROM sessions"))
def errors_by_session(t):
    out = src.errors_by_session(error_log(t), t.sessions.select(F.col("eid").cast("string").alias("eid")))
    out = rules.add_error_type(out, F.col("eid").cast("long") % 3 == 0, "VideoQCFail")
    return out.withColumn("logged_errors", joined("logged_errors"))


@query("source_presence", """SELECT o_orderkey AS eid, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'MissingExtractedData' ELSE 'MissingRawData' END AS error_type FROM orders
 WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def source_presence(t):
    raw = t["orders"].join(t["customer"].where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("eid"))
    return rules.source_presence(t.sessions, t["lineitem"].select(F.col("l_orderkey").alias("eid")), raw)


@query("error_severity", with_sql(SESSIONS_SQL, "SELECT CASE error_type WHEN 'InsufficientTrials' THEN 'fatal' ELSE 'logged' END AS severity, count(*) AS n FROM sessions WHERE error_type IS NOT NULL GROUP BY 1"))
def error_severity(t):
    return rules.with_severity(error_log(t)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


# --- joins and fills ------------------------------------------------------------------------

def recordings_view(t):
    s = rules.validate_parallel_lists(t.sessions, ["brain_region", "hemisphere"])
    return rel.recordings(s, ["brain_region", "hemisphere"])


@query("recordings", with_sql(RECORDINGS_SQL, "SELECT eid, subject, brain_region, hemisphere, fiber_idx FROM recordings WHERE brain_region IN ('VTA-l', 'DR-r', 'LC')"))
def recordings(t):
    s = rules.validate_parallel_lists(t.sessions, ["brain_region", "hemisphere"])
    out = rel.recordings(s, ["brain_region", "hemisphere"], ["VTA-l", "DR-r", "LC"], "brain_region")
    return out.select("eid", "subject", "brain_region", "hemisphere", F.col("fiber_idx").cast("long").alias("fiber_idx"))


@query("join_performance", with_sql(SESSIONS_SQL, "SELECT l_orderkey, l_linenumber, l_partkey, subject, fraction_correct FROM lineitem LEFT JOIN sessions ON l_orderkey = eid"))
def join_performance(t):
    right = t.sessions.select("eid", "subject", "fraction_correct")
    out = rel.left_join_unique(t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("eid")), right.unionByName(right), ["eid"])
    return out.drop("eid")


@query("qc_with_recordings", with_sql(QC_PARTS_SQL, """SELECT eid, brain_region, CASE WHEN s_acctbal > 0 THEN rnd(n_unique_samples) END AS metric, DATE '2024-01-02' AS date FROM qc JOIN supplier ON eid = s_suppkey WHERE band = 'GCaMP'"""))
def qc_with_recordings(t):
    recs = t["supplier"].select(F.col("s_suppkey").alias("eid"), F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("brain_region"), "s_acctbal", F.lit("2024-01-02T10:00:00").alias("start_time"))
    qc = qc_table(t).join(recs.select("eid", "s_acctbal").distinct(), "eid").withColumn("metric", F.when(F.col("s_acctbal") > 0, F.col("n_unique_samples")).otherwise(F.lit(float("inf")))).drop("s_acctbal")
    return rel.qc_with_recordings(qc, recs, "GCaMP").select("eid", "brain_region", rnd("metric").alias("metric"), "date")


@query("group_from_catalog", with_sql(SESSIONS_SQL, "SELECT eid, coalesce(error_type, '') AS logged_errors, 0::BIGINT AS n_users FROM sessions WHERE len(brain_region) = len(hemisphere)"))
def group_from_catalog(t):
    s = rules.validate_parallel_lists(src.enforce_schema(t.sessions), ["brain_region", "hemisphere"]).withColumn("eid", F.col("eid").cast("string"))
    out = src.errors_by_session(error_log(t), s)
    return out.select(F.col("eid").cast("long").alias("eid"), joined("logged_errors").alias("logged_errors"), F.size("users").cast("long").alias("n_users"))


@query("match_channels", with_sql(RECORDINGS_SQL, """, ch AS (SELECT DISTINCT eid, CASE WHEN eid % 2 = 0 THEN regexp_replace(brain_region, '-[lr]$', '') ELSE brain_region END AS channel FROM recordings),
 bare AS (SELECT eid, regexp_replace(brain_region, '-[lr]$', '') AS channel, count(*) AS n, min(brain_region) AS one FROM recordings GROUP BY 1, 2), ex AS (SELECT DISTINCT eid, brain_region FROM recordings)
 SELECT ch.eid, ch.channel, coalesce(ex.brain_region, CASE WHEN n = 1 THEN one END) AS region, CASE WHEN coalesce(ex.brain_region, CASE WHEN n = 1 THEN one END) IS NULL THEN 'AmbiguousRegionMapping' END AS error_type
 FROM ch LEFT JOIN ex ON ex.eid = ch.eid AND ex.brain_region = ch.channel LEFT JOIN bare ON bare.eid = ch.eid AND bare.channel = ch.channel"""))
def match_channels(t):
    r = recordings_view(t)
    ch = r.select("eid", F.when(F.col("eid") % 2 == 0, F.regexp_replace("brain_region", "-[lr]$", "")).otherwise(F.col("brain_region")).alias("channel")).distinct()
    return rel.match_channels(ch, r.select("eid", F.col("brain_region").alias("region")))


# Lists that agree within most customers: they follow from the customer, but some rows are empty or null.
LISTED = ["o_orderkey AS eid", "o_custkey AS subject",
          "CASE WHEN o_orderkey % 3 = 0 THEN CAST(array() AS array<string>) WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN array('odd') ELSE array(concat('r', o_custkey % 8), 'x') END AS regions",
          "CASE WHEN o_orderkey % 4 = 0 THEN CAST(array() AS array<string>) WHEN o_orderkey % 37 = 0 THEN array('l', 'r', 'l') ELSE array('l', 'r') END AS sides"]
LISTED_SQL = """li AS (SELECT o_orderkey AS eid, o_custkey AS subject, CASE WHEN o_orderkey % 3 = 0 THEN [] WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN ['odd'] ELSE ['r' || (o_custkey % 8), 'x'] END AS regions,
 CASE WHEN o_orderkey % 4 = 0 THEN [] WHEN o_orderkey % 37 = 0 THEN ['l', 'r', 'l'] ELSE ['l', 'r'] END AS sides FROM orders)"""


@query("fill_empty_list", with_sql(LISTED_SQL, """, s AS (SELECT subject, min(regions) AS v FROM li WHERE len(regions) > 0 GROUP BY subject HAVING count(DISTINCT regions) = 1)
 SELECT eid, array_to_string(CASE WHEN len(regions) = 0 AND v IS NOT NULL THEN v ELSE regions END, ',') AS regions FROM li LEFT JOIN s USING (subject)"""))
def fill_empty_list(t):
    return rel.fill_empty_list(t["orders"].selectExpr(*LISTED), "regions", "subject").select("eid", joined("regions").alias("regions"))


@query("fill_parallel_lists", with_sql(LISTED_SQL, """, s AS (SELECT subject, min(regions) AS v, min(sides) AS w FROM li WHERE len(regions) > 0 AND len(sides) = len(regions) GROUP BY subject HAVING count(DISTINCT struct_pack(a := regions, b := sides)) = 1)
 SELECT eid, array_to_string(CASE WHEN (len(regions) = 0 OR len(sides) = 0) AND v IS NOT NULL THEN v ELSE regions END, ',') AS regions,
 array_to_string(CASE WHEN (len(regions) = 0 OR len(sides) = 0) AND v IS NOT NULL THEN w ELSE sides END, ',') AS sides FROM li LEFT JOIN s USING (subject)"""))
def fill_parallel_lists(t):
    out = rel.fill_parallel_lists(t["orders"].selectExpr(*LISTED), ["regions", "sides"], "subject")
    return out.select("eid", joined("regions").alias("regions"), joined("sides").alias("sides"))


@query("fill_regions_from_fibers", with_sql(SESSIONS_SQL + ", " + FIBERS_SQL, """, fl AS (SELECT subject, list(region ORDER BY fiber) AS rg, list(coalesce(side, '') ORDER BY fiber) AS sd,
  CASE WHEN count(DISTINCT region) = 1 AND count(*) > 1 THEN list_transform(list(region), lambda r: '') ELSE list(coalesce(side, '') ORDER BY fiber) END AS shown FROM sided GROUP BY subject),
 x AS (SELECT eid, rg, sd, CASE WHEN len(brain_region) = 0 AND rg IS NOT NULL THEN rg ELSE brain_region END AS brain_region,
  CASE WHEN len(brain_region) = 0 AND rg IS NOT NULL THEN shown ELSE hemisphere END AS hemisphere FROM sessions LEFT JOIN fl USING (subject))
 SELECT eid, array_to_string(brain_region, ',') AS brain_region, array_to_string(list_transform(hemisphere, lambda h, i: CASE WHEN coalesce(h, '') <> '' THEN h
  WHEN len(list_distinct(list_filter(sd, lambda v, k: rg[k] = regexp_replace(brain_region[i], '-[lr]$', '')))) = 1
  THEN list_filter(sd, lambda v, k: rg[k] = regexp_replace(brain_region[i], '-[lr]$', ''))[1] ELSE '' END), ',') AS hemisphere FROM x"""))
def fill_regions_from_fibers(t):
    out = rel.fill_regions_from_fibers(t.sessions, fibers(t))
    return out.select("eid", joined("brain_region").alias("brain_region"), joined("hemisphere").alias("hemisphere"))


@query("fiber_coordinates", with_sql(FIBERS_SQL, """SELECT s_suppkey AS subject, rnd(s_acctbal - 100 * sin(radians(30)) * cos(radians(s_suppkey))) AS tip_x, rnd(50 - 100 * cos(radians(30))) AS tip_z FROM supplier
 WHERE (SELECT count(*) FROM nation WHERE n_regionkey = s_suppkey % 7) = 5"""))
def fiber_coordinates(t):
    ins = t["supplier"].select(F.col("s_suppkey").alias("subject"), F.col("s_suppkey").alias("insertion"))
    fits = t["nation"].groupBy(F.col("n_regionkey").alias("r")).count().where("count = 5")
    tr = t["supplier"].join(F.broadcast(fits), F.col("s_suppkey") % 7 == F.col("r"), "left_semi").selectExpr(
        "s_suppkey AS insertion", "s_acctbal AS x", "0D AS y", "50D AS z", "100D AS depth", "30D AS theta", "CAST(s_suppkey AS double) AS phi")
    out = rel.fiber_coordinates(ins, tr, derive.fiber_tip)
    return out.select("subject", rnd("tip_x").alias("tip_x"), rnd("tip_z").alias("tip_z"))


@query("subject_region", with_sql(LISTED_SQL, "SELECT subject, array_to_string(min(regions), ',') AS brain_region FROM li WHERE len(regions) > 0 GROUP BY subject HAVING count(DISTINCT regions) = 1"))
def subject_region(t):
    s = t["orders"].selectExpr(*LISTED).withColumnRenamed("regions", "brain_region")
    return rel.subject_region(s).select("subject", joined("brain_region").alias("brain_region"))


@query("frames_in_trials", with_sql(SIGNAL_SQL, """, tr AS (SELECT eid, event_id AS trial, t - 0.1 AS a, t + k * 600 + 0.5 AS b FROM signal WHERE event_type = 'signup')
 SELECT s.event_id, s.eid, tr.trial FROM signal s JOIN tr ON s.eid = tr.eid AND s.t >= tr.a AND s.t <= tr.b"""))
def frames_in_trials(t):
    tr = t.signal.where("event_type = 'signup'").select("eid", F.col("event_id").alias("trial"), F.col("t").alias("stimOn_times"), (F.col("t") + F.col("k") * 600).alias("feedback_times"))
    tr = rel.trial_frame_window(tr)
    return rel.frames_in_trials(t.signal.select("event_id", "eid", "t"), tr, ["eid"], "t", "window_start", "window_end", 43200.0).select("event_id", "eid", "trial")
