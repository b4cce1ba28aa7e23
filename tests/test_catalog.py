"""Catalog rules, fills, stores and duplicates on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from trialloom import constants as K
from trialloom.operators import aggregates as agg, batch, derive, ordered, relational as rel, rules
from trialloom.session import checkpoint_dir
from trialloom.sources import tables as src


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_schema_defaults(spark):
    df = spark.createDataFrame([("a", None, 1.5), ("b", ["x"], None)], "eid string, brain_region array<string>, extra double")
    out = src.enforce_schema(df)
    assert set(src.SESSION_SCHEMA) <= set(out.columns) and "extra" in out.columns
    assert [r["brain_region"] for r in out.orderBy("eid").collect()] == [[], ["x"]]
    assert out.first()["lab"] is None


def test_group_store_replaces_only_its_sessions(spark):
    store = src.GroupStore(spark, src.scratch_path(spark, "t"), buckets=4)
    store.save("trials", spark.createDataFrame([(i, i * 1.0) for i in range(20)], "eid long, v double"))
    store.save("trials", spark.createDataFrame([(3, 99.0), (77, 7.0)], "eid long, v double"))
    got = dict(rows(store.load(["trials"])["trials"], "eid", "v"))
    assert len(got) == 21 and got[3] == 99.0 and got[4] == 4.0 and got[77] == 7.0
    assert store.groups() == ["trials"] and store.load(["wheel"])["wheel"] is None
    some = store.load(["trials"], spark.createDataFrame([(4,)], "eid long"))["trials"]
    assert rows(some, "eid", "v") == [(4, 4.0)]


def test_missing_store_gives_empty_log(spark):
    log = src.collect_errors(spark, checkpoint_dir(spark) + "/never")
    assert log.columns == K.ERROR_COLUMNS and log.count() == 0
    assert src.load_scoped(spark, checkpoint_dir(spark) + "/never") is None


def test_extended_qc_kinds(spark):
    j = '{"_focus_qc": 10, "pin_state": true, "odd": {"a": 1}, "list_qc": [30, 1, 2], "num": 77, "none": null}'
    got = {r["field"]: r for r in src.extended_qc(spark.createDataFrame([(1, j)], "eid long, j string"), "eid", "j").collect()}
    assert got["qc_focus"]["verdict"] == "PASS" and got["qc_pin_state"]["verdict"] == "PASS"
    assert got["qc_list"]["verdict"] == "FAIL" and got["qc_list"]["detail"] == ["1", "2"]
    assert got["qc_num"]["verdict"] == "77" and got["qc_none"]["verdict"] is None
    assert got["qc_odd"]["is_error"] and got["qc_odd"]["verdict"] is None


def test_labels(spark):
    lab = spark.createDataFrame([(1, "PASS"), (2, None)], "eid long, focus string")
    with pytest.raises(ValueError):
        src.apply_label(lab, 1, "colour", "PASS", ["focus"], K.QC_ORDER)
    with pytest.raises(ValueError):
        src.apply_label(lab, 1, "focus", "GREAT", ["focus"], K.QC_ORDER)
    manual = src.apply_label(lab.withColumn("focus", F.lit("NOT_SET")), 2, "focus", "FAIL", ["focus"], K.QC_ORDER)
    assert rows(src.merge_labels(lab, manual, ["focus"]), "eid", "focus") == [(1, "PASS"), (2, "FAIL")]


def test_session_type_and_targets(spark):
    df = spark.createDataFrame([("trainingChoiceWorld",), ("biasedChoiceWorld_RPE",), ("Histology",), ("ephysChoiceWorld_passiveChoiceWorld",), (None,)], "task_protocol string")
    got = [r["session_type"] for r in derive.session_type(df).collect()]
    assert got == ["training", None, "histology", None, None]
    one = spark.createDataFrame([(["VTA-l", "SNc", None], "DA"), (["LC-r"], "DA")], "brain_region array<string>, NM string")
    out = derive.target_nm(one).collect()
    assert out[0]["target_NM"] == ["VTA-DA", "SNc-DA", None] and out[0]["target_error"] is None
    assert out[1]["target_error"] == "InvalidTargetNM"


def test_log2_needs_percent(spark):
    ok = spark.createDataFrame([(0.0,), (6.25,)], "c double").select(derive.contrast_log2("c").alias("x")).collect()
    assert ok[0]["x"] == 0.0
    with pytest.raises(Exception, match="percent"):
        spark.createDataFrame([(0.0625,)], "c double").select(derive.contrast_log2("c")).collect()


def test_terms():
    assert derive.crossed("a", "b", "c")[:4] == [("a",), ("b",), ("c",), ("a", "b")] and len(derive.crossed("a", "b", "c")) == 7
    fam = derive.drop_one_family(derive.crossed("a", "b"), ["a"])
    assert fam["a"] == [("b",)] and derive.family_columns(fam) == ["a", "b"]
    assert derive.block_terms(["a", "a:b", "b:c"], ["a", "b"]) == ["a", "a:b"]


def test_filters_count_each_predicate_alone(spark):
    df = spark.createDataFrame([(1, "training", None, ["InsufficientTrials"]), (2, "training", 0.9, []), (3, "ephys", None, []), (4, "passive", 0.1, [])],
                               "eid long, session_type string, fraction_correct double, logged_errors array<string>")
    f = dict(session_types=["training", "ephys"], blockers=K.ANALYSIS_BLOCKERS, min_performance={"training": 0.7}, lab="absent column")
    assert rows(rules.filter_sessions(df, **f), "eid") == [(2,), (3,)]
    assert dict(rows(rules.removal_counts(df, **f), "predicate", "n_removed")) == {"session_types": 1, "qc_blockers": 1, "min_performance": 1}


def test_fills(spark):
    df = spark.createDataFrame([(1, "a", []), (2, "a", ["x"]), (3, "a", None), (4, "b", []), (5, "b", ["x"]), (6, "b", ["y"])], "eid long, s string, r array<string>")
    got = dict(rows(rel.fill_empty_list(df, "r", "s"), "eid", "r"))
    assert got == {1: ["x"], 2: ["x"], 3: None, 4: [], 5: ["x"], 6: ["y"]}
    two = spark.createDataFrame([(1, "a", [], ["l"]), (2, "a", ["x", "y"], ["l", "r"]), (3, "a", ["x"], ["l", "r"])], "eid long, s string, r array<string>, h array<string>")
    got = {r["eid"]: (r["r"], r["h"]) for r in rel.fill_parallel_lists(two, ["r", "h"], "s").collect()}
    assert got[1] == (["x", "y"], ["l", "r"]) and got[3] == (["x"], ["l", "r"])


def test_fibers(spark):
    fib = spark.createDataFrame(
        [("a", "NBM", 0, -1500.0), ("a", "SI", 1, 1200.0), ("b", "NBM", 0, -1500.0), ("b", "NBM", 1, 1500.0), ("c", "DR", 0, 0.0), ("d", "VTA", 0, 10.0), ("d", "VTA", 1, 0.0), ("e", "LC", 0, 0.0), ("e", "LC", 1, 9.0)],
        "subject string, region string, fiber long, x_ml double")
    assert rows(rel.fiber_hemispheres(fib).fillna("none"), "subject", "region", "fiber_hemisphere") == [
        ("a", "NBM", "r"), ("a", "SI", "l"), ("b", "NBM", "none"), ("c", "DR", "none"), ("d", "VTA", "l"), ("e", "LC", "none")]
    s = spark.createDataFrame(
        [(1, "a", [], []), (2, "a", ["SI"], [""]), (3, "b", [], []), (4, "c", [], []), (5, "z", [], []), (6, "a", ["LC", "NBM-r"], [None, None]), (7, "a", None, None), (8, "b", ["NBM"], [None]), (9, "z", ["DR"], [None])],
        "eid long, subject string, brain_region array<string>, hemisphere array<string>")
    got = {r["eid"]: (r["brain_region"], r["hemisphere"]) for r in rel.fill_regions_from_fibers(s, fib).collect()}
    assert got[1] == (["NBM", "SI"], ["r", "l"]) and got[2] == (["SI"], ["l"]) and got[3] == (["NBM", "NBM"], ["", ""]) and got[4] == (["DR"], [""])
    assert got[5] == ([], []) and got[6] == (["LC", "NBM-r"], ["", "r"]) and got[7] == (None, None) and got[8] == (["NBM"], [""]) and got[9] == (["DR"], [""])


def test_hemisphere_rule_order(spark):
    lookup = spark.createDataFrame([("a", "NBM", "r"), ("a", "DR", None)], "subject string, region string, fiber_hemisphere string")
    s = spark.createDataFrame(
        [(1, "a", ["NBM-l"], ["l"]), (2, "a", ["NBM"], [""]), (3, "a", ["DR"], [""]), (4, "a", ["DR-l"], ["l"]), (5, "a", ["VTA-l"], ["l"]), (6, "a", [], []), (7, "a", ["NBM-r"], ["r"]),
         (8, "a", ["NBM-r", "NBM", "NBM-l"], ["r", None, "l"]), (9, "a", ["NBM"], None)],
        "eid long, subject string, brain_region array<string>, hemisphere array<string>")
    got = {r["eid"]: r["error_type"] for r in rules.hemisphere_errors(s, lookup).collect()}
    assert got == {1: "HemisphereMismatch", 2: "MissingHemiSuffix", 3: "MissingInsertion", 4: "MissingInsertion", 5: "MissingInsertion", 6: "MissingHemisphere", 8: "MissingHemiSuffix", 9: "MissingHemisphere"}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1, True), (2, "a", 1, False), (3, "a", 2, True), (4, "a", 2, True), (5, "b", 1, False), (6, "b", 1, False), (7, None, 1, False), (8, "c", 1, True), (9, "c", 1, False), (10, "c", 1, False)], "eid long, subject string, day long, bad boolean")
    kept, log = ordered.resolve_duplicates(df, ["subject", "day"], F.col("bad"), ["eid"])
    assert rows(kept, "eid") == [(2,), (3,), (5,), (9,)] and rows(log, "eid", "error_type") == [(5, "TrueDuplicateSession"), (8, "TrueDuplicateSession")]


@pytest.mark.parametrize("blocks, flagged", [([50, 50, 3], False), ([50, 3, 50], True), ([5], True), ([20], False)])
def test_block_structure(spark, blocks, flagged):
    p = [x for i, n in enumerate(blocks) for x in [[0.5, 0.2, 0.8][i % 3]] * n]
    df = spark.createDataFrame([("e", i, x) for i, x in enumerate(p)], "eid string, trial long, p double")
    b = ordered.block_lengths(df, ["eid"], ["trial"], F.floor(F.col("trial") / 7), "p")
    assert [r["length"] for r in b.orderBy("start").collect()] == blocks
    r = ordered.block_structure(b, ["eid"]).first()
    assert r["flagged"] == flagged and r["n_blocks"] == len(blocks) and r["min_block_length"] == min(blocks)


def test_stage_counts(spark):
    s = spark.createDataFrame([("m", "training", 1), ("m", "training", 2), ("m", "biased", 3), ("m", "training", 4), ("n", "training", 1)], "subject string, session_type string, session_n long")
    got = {r["subject"]: r for r in agg.stage_counts(s).collect()}
    assert got["m"]["training_to_biased"] == 2 and got["m"]["biased_to_ephys"] is None and got["n"]["training_to_biased"] is None


def test_capacity_without_yield_is_infinite(spark):
    c = spark.createDataFrame([("t", 0, 5), ("u", 9, 9)], "target_NM string, r long, n long")
    got = {x["target_NM"]: x for x in agg.capacity_projection(c, "r", "n", 8, 2.0, F.lit("2024-01-06").cast("date"), F.lit("2024-01-09").cast("date")).collect()}
    assert got["t"]["effective_sessions_needed"] == float("inf") and got["u"]["shortfall"] == 0 and got["u"]["days_available"] == 1


def test_process_captures_or_raises(spark):
    s = spark.createDataFrame([(1, 2.0), (2, 0.0)], "eid long, x double")
    res, log = batch.process_sessions(s, lambda r: {"y": 1 // r["x"]}, "y double")
    assert rows(res.fillna(-1.0), "eid", "y") == [(1, 0.0), (2, -1.0)]
    e = log.first()
    assert e["eid"] == 2 and e["error_type"] == "ZeroDivisionError" and "Traceback" in e["traceback"]
    with pytest.raises(Exception):
        batch.process_sessions(s, lambda r: {"y": 1 // r["x"]}, "y double", strict=True)


def test_stages_stop_or_go_on(spark):
    def bad():
        raise ValueError("no")

    jobs = {"a": lambda: None, "b": bad, "c": lambda: None}
    assert rows(batch.run_stages(spark, jobs), "stage", "ok") == [("a", True), ("b", False)]
    assert rows(batch.run_stages(spark, jobs, stop_on_error=False, start="b"), "stage", "ok") == [("b", False), ("c", True)]


def test_guarded_group_function(spark):
    def fit(pdf):
        if pdf["x"].sum() > 5:
            raise RuntimeError("too large")
        return pdf[["x"]].sum().to_frame().T

    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 9.0)], "eid long, x double")
    run = rules.guarded(fit, ["eid"], ["eid", "x"])

    def call(key, pdf):
        return run(key, pdf)

    out = df.groupBy("eid").applyInPandas(call, "eid long, x double, error_type string, error_message string, traceback string")
    ok, log = rules.split_results(out, "eid", ["x"])
    assert rows(ok, "eid", "x") == [(1, 3.0)] and rows(log, "eid", "error_type", "error_message") == [(2, "RuntimeError", "too large")]
