"""User functions that need a session's trials and signal."""

import pandas as pd
import pytest

from trialloom.operators.sessions import process_session_tables


def tables(spark):
    sessions = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (4, "bad"), (None, "d")], "eid long, lab string")
    trials = spark.createDataFrame([(1, i, float(i % 2), "x") for i in range(50)] + [(2, 1, None, None), (9, 0, 1.0, "y"), (4, 0, 1.0, "z")], "eid long, trial long, r double, lab string")
    signal = spark.range(0, 30_000).selectExpr("CAST(IF(id % 3 = 0, 2, 1) AS long) AS eid", "29999 - id AS t", "CAST(id % 7 AS double) AS v")
    return sessions, {"trials": (trials, ["trial"]), "signal": (signal, ["t"])}


def summary():
    """The function is nested, so that it travels to the workers by value."""
    def run(session, parts):
        if session["lab"] == "bad":
            raise ValueError("bad lab")
        n, last, flips, names, longest = {}, None, 0, [], 0
        for name, frame in parts:
            names.append(name)
            n[name] = n.get(name, 0) + len(frame)
            longest = max(longest, len(frame))
            if name == "signal":
                assert list(frame.columns) == ["eid", "t", "v"] and set(frame.eid) == {session["eid"]}
                assert frame.t.is_monotonic_increasing and (last is None or last < frame.t.iloc[0])
                last = frame.t.iloc[-1]
            else:
                flips += int((frame.r.diff().abs() == 1).sum())
        assert names == sorted(names, reverse=True)  # trials, then signal
        return {"lab": session["lab"], "trials": n.get("trials", 0), "samples": n.get("signal", 0), "flips": flips, "longest": longest}

    return run


def test_function_sees_all_tables_in_order_and_pieces(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got, errors = process_session_tables(*tables(spark), summary(), "lab string, trials long, samples long, flips long, longest long")
        rows = {r["eid"]: r for r in got.collect()}
        assert set(rows) == {1, 2, 3, 4} and got.count() == 4
        assert rows[1][1:5] == ("a", 50, 20_000, 49) and rows[2][1:5] == ("b", 1, 10_000, 0) and rows[3][1:5] == ("c", 0, 0, 0)
        assert rows[1]["longest"] <= 1000
        assert rows[4]["lab"] is None
        assert [(r["eid"], r["error_type"], r["error_message"]) for r in errors.collect()] == [(4, "ValueError", "bad lab")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_early_stop_strict_and_empty(spark):
    sessions, others = tables(spark)
    first = lambda s, parts: {"name": next(parts, (None, None))[0]}
    got = {r["eid"]: r["name"] for r in process_session_tables(sessions, others, first, "name string")[0].collect()}
    assert got == {1: "trials", 2: "trials", 3: None, 4: "trials"}
    none = process_session_tables(sessions.limit(0), others, first, "name string")
    assert none[0].count() == 0 and none[1].count() == 0
    with pytest.raises(Exception, match="bad lab"):
        process_session_tables(sessions, others, summary(), "lab string", strict=True)
