"""The driver's tables seen as sessions, trials, signals and recordings.

Every view is a row-wise projection of a whole table (``SQL`` holds the same
projection for the oracle), so a query's work grows with the table it reads.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialloom.functions.scan import ordered_scan, time_chunk
from trialloom.session import cut_lineage

EPOCH_US = 1704067200000000  # 2024-01-01, start of the events table


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def signal(self) -> DataFrame:
        """events as a signal: user = recording, time in seconds, event labels."""
        return self["events"].selectExpr(
            "event_id", "user_id AS eid",
            f"(unix_micros(CAST(ts AS timestamp)) - {EPOCH_US}) / 1e6D AS t",
            "event_type", "value", "CAST(get_json_object(props, '$.k') AS bigint) AS k",
        )

    @cached_property
    def indexed_signal(self) -> DataFrame:
        """signal plus the 0-based sample index of each recording, written out once per query."""
        return self.indexed("event_type", "value", "k")

    def indexed(self, *columns: str) -> DataFrame:
        """The index with only the columns a query needs: what is written out cannot be pruned later."""
        s = self.signal.select("event_id", "eid", "t", *columns)
        return cut_lineage(ordered_scan(s, ["eid"], ["t", "event_id"], time_chunk("t", 86400.0), index="idx", lead={"t_next": "t"}))

    @cached_property
    def sessions(self) -> DataFrame:
        return self["orders"].selectExpr(*SESSION_COLUMNS)

    @cached_property
    def trials(self) -> DataFrame:
        return self["lineitem"].selectExpr(*TRIAL_COLUMNS)

    @cached_property
    def numbered_trials(self) -> DataFrame:
        """trials with their 0-based number inside the session."""
        return ordered_scan(
            self.trials, ["eid"], TRIAL_ORDER, time_chunk("day", 180.0), index="trial"
        )

    @cached_property
    def cells(self) -> DataFrame:
        """Trials restricted to nothing, with coded predictors for the models."""
        return self.trials.selectExpr("*", *CODED_COLUMNS)


TARGETS = "array('VTA','SNc','DR','MR','LC','NBM','SI','PPT')"
SESSION_COLUMNS = [
    "o_orderkey AS eid", "o_custkey AS subject",
    "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T', lpad(CAST(o_orderkey % 24 AS string), 2, '0'), ':15:00') AS start_time",
    "CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 24 = 23 THEN "
    "concat(date_format(o_orderdate + INTERVAL 1 DAY, 'yyyy-MM-dd'), 'T00:05:30') ELSE "
    "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T', lpad(CAST(o_orderkey % 24 AS string), 2, '0'), ':55:30') END AS end_time",
    "CAST(o_orderdate AS date) AS day",
    "CASE o_orderstatus WHEN 'F' THEN 'training' WHEN 'O' THEN 'biased' ELSE 'ephys' END AS session_type",
    "concat(CASE o_orderstatus WHEN 'F' THEN 'training' WHEN 'O' THEN 'biased' ELSE 'ephys' END, 'ChoiceWorld', "
    "CASE WHEN o_orderkey % 11 = 0 THEN '_RPE' WHEN o_orderkey % 13 = 0 THEN '_passiveChoiceWorld' ELSE '' END) AS task_protocol",
    "o_orderpriority AS lab",
    "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 500000D END AS fraction_correct",
    f"transform(slice(sequence(1, 3), 1, CAST(o_orderkey % 4 AS int)), i -> concat(element_at({TARGETS}, CAST((o_custkey + i) % 8 AS int) + 1), "
    "element_at(array('-l','-r',''), CAST((o_orderkey + i) % 3 AS int) + 1))) AS brain_region",
    "transform(slice(sequence(1, 3), 1, CAST(CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE o_orderkey % 4 END AS int)), i -> "
    "element_at(array('l','r',''), CAST((o_orderkey + i) % 3 AS int) + 1)) AS hemisphere",
    "CASE WHEN o_orderkey % 23 = 0 THEN 'XX' ELSE element_at(array('DA','5HT','NE','ACh'), CAST(o_custkey % 4 AS int) + 1) END AS NM",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'InsufficientTrials' WHEN o_orderkey % 7 = 0 THEN 'VideoLengthError' END AS error_type",
    "CASE WHEN o_orderkey % 6 = 0 THEN array(0.0D, 6.25D, 12.5D, 25.0D, 50.0D, 100.0D) ELSE array(100.0D, 25.0D, 12.5D, 6.25D, 0.0D) END AS contrasts",
    "o_totalprice AS price", "o_orderpriority AS priority",
]
TRIAL_ORDER = ["day", "l_orderkey", "l_linenumber", "l_partkey"]
TRIAL_COLUMNS = [
    "l_suppkey AS eid", "l_suppkey % 40 AS subject",
    "element_at(array('VTA-DA','SNc-DA','DR-5HT','LC-NE','NBM-ACh'), CAST(l_suppkey % 5 AS int) + 1) AS target_NM",
    "element_at(array('l','r',''), CAST(l_suppkey % 3 AS int) + 1) AS hemisphere",
    "CASE WHEN l_linenumber % 2 = 0 THEN 'stimOn_times' ELSE 'feedback_times' END AS event",
    "l_orderkey", "l_linenumber", "l_partkey",
    "datediff(CAST(l_shipdate AS date), DATE'1992-01-01') AS day",
    "CASE WHEN l_linestatus = 'O' THEN element_at(array(0D, 0.0625D, 0.125D, 0.25D, 1D), CAST(round(l_discount * 100) AS int) % 5 + 1) END AS contrastLeft",
    "CASE WHEN l_linestatus = 'F' THEN element_at(array(0D, 0.0625D, 0.125D, 0.25D, 1D), CAST(round(l_discount * 100) AS int) % 5 + 1) END AS contrastRight",
    "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS choice",
    "CASE WHEN l_tax < 0.045 THEN 1 ELSE -1 END AS feedbackType",
    "element_at(array(0.5D, 0.2D, 0.8D), CAST(year(l_shipdate) % 3 AS int) + 1) AS probabilityLeft",
    "l_linenumber + 0.25D AS stimOn_times",
    "CASE WHEN l_quantity < 50 THEN l_linenumber + 0.25D + (l_quantity - 3) / 100 END AS firstMovement_times",
    "l_linenumber + 0.25D + l_quantity / 50 AS feedback_times",
    "CASE WHEN l_quantity <> 13 THEN l_extendedprice / 1000 END AS response",
    "l_quantity AS wheel", "l_tax", "l_discount",
]
CODED_COLUMNS = [
    "coalesce(contrastRight, contrastLeft) * 100 AS contrast",
    "CASE WHEN contrastLeft IS NULL THEN 0.5D ELSE -0.5D END AS side",
    "CASE WHEN feedbackType = 1 THEN 0.5D ELSE -0.5D END AS reward",
]


# Oracle-side text of the same views (DuckDB dialect), used as CTE prefixes.
SIGNAL_SQL = """signal AS (SELECT event_id, user_id AS eid, (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE AS t,
 event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
INDEXED_SQL = SIGNAL_SQL + """, idx_signal AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY t, event_id) - 1 AS idx FROM signal)"""
_T = "['VTA','SNc','DR','MR','LC','NBM','SI','PPT']"
SESSIONS_SQL = f"""sessions AS (SELECT o_orderkey AS eid, o_custkey AS subject,
 strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':15:00' AS start_time,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 24 = 23 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') || 'T00:05:30'
  ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':55:30' END AS end_time,
 CAST(o_orderdate AS DATE) AS day,
 CASE o_orderstatus WHEN 'F' THEN 'training' WHEN 'O' THEN 'biased' ELSE 'ephys' END AS session_type,
 (CASE o_orderstatus WHEN 'F' THEN 'training' WHEN 'O' THEN 'biased' ELSE 'ephys' END) || 'ChoiceWorld' ||
  CASE WHEN o_orderkey % 11 = 0 THEN '_RPE' WHEN o_orderkey % 13 = 0 THEN '_passiveChoiceWorld' ELSE '' END AS task_protocol,
 o_orderpriority AS lab,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 500000 END AS fraction_correct,
 list_transform(range(1, CAST(o_orderkey % 4 + 1 AS BIGINT)), lambda i: {_T}[CAST((o_custkey + i) % 8 AS INT) + 1] || ['-l','-r',''][CAST((o_orderkey + i) % 3 AS INT) + 1]) AS brain_region,
 list_transform(range(1, CAST(CASE WHEN o_orderkey % 29 = 0 THEN 2 ELSE o_orderkey % 4 + 1 END AS BIGINT)), lambda i: ['l','r',''][CAST((o_orderkey + i) % 3 AS INT) + 1]) AS hemisphere,
 CASE WHEN o_orderkey % 23 = 0 THEN 'XX' ELSE ['DA','5HT','NE','ACh'][CAST(o_custkey % 4 AS INT) + 1] END AS NM,
 CASE WHEN o_orderkey % 5 = 0 THEN 'InsufficientTrials' WHEN o_orderkey % 7 = 0 THEN 'VideoLengthError' END AS error_type,
 CASE WHEN o_orderkey % 6 = 0 THEN [0.0, 6.25, 12.5, 25.0, 50.0, 100.0]::DOUBLE[] ELSE [100.0, 25.0, 12.5, 6.25, 0.0]::DOUBLE[] END AS contrasts,
 o_totalprice AS price, o_orderpriority AS priority FROM orders)"""
_C = "([0, 0.0625, 0.125, 0.25, 1]::DOUBLE[])"
TRIALS_SQL = f"""trials AS (SELECT l_suppkey AS eid, l_suppkey % 40 AS subject,
 ['VTA-DA','SNc-DA','DR-5HT','LC-NE','NBM-ACh'][CAST(l_suppkey % 5 AS INT) + 1] AS target_NM,
 ['l','r',''][CAST(l_suppkey % 3 AS INT) + 1] AS hemisphere,
 CASE WHEN l_linenumber % 2 = 0 THEN 'stimOn_times' ELSE 'feedback_times' END AS event,
 l_orderkey, l_linenumber, l_partkey,
 date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS day,
 CASE WHEN l_linestatus = 'O' THEN {_C}[CAST(round(l_discount * 100) AS INT) % 5 + 1] END AS contrastLeft,
 CASE WHEN l_linestatus = 'F' THEN {_C}[CAST(round(l_discount * 100) AS INT) % 5 + 1] END AS contrastRight,
 CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS choice,
 CASE WHEN l_tax < 0.045 THEN 1 ELSE -1 END AS feedbackType,
 ([0.5, 0.2, 0.8]::DOUBLE[])[CAST(year(l_shipdate) % 3 AS INT) + 1] AS probabilityLeft,
 l_linenumber + 0.25::DOUBLE AS stimOn_times,
 CASE WHEN l_quantity < 50 THEN l_linenumber + 0.25::DOUBLE + (l_quantity - 3) / 100 END AS firstMovement_times,
 l_linenumber + 0.25::DOUBLE + l_quantity / 50 AS feedback_times,
 CASE WHEN l_quantity <> 13 THEN l_extendedprice / 1000 END AS response,
 l_quantity AS wheel, l_tax, l_discount FROM lineitem)"""
NUMBERED_SQL = TRIALS_SQL + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY day, l_orderkey, l_linenumber, l_partkey) - 1 AS trial FROM trials)"""
CELLS_SQL = TRIALS_SQL + """, cells AS (SELECT *, coalesce(contrastRight, contrastLeft) * 100 AS contrast,
 CASE WHEN contrastLeft IS NULL THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS side,
 CASE WHEN feedbackType = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS reward FROM trials)"""
RECORDINGS_SQL = SESSIONS_SQL + """, recordings AS (SELECT eid, subject, session_type, day, start_time, fraction_correct, NM, error_type,
 unnest(brain_region) AS brain_region, unnest(hemisphere) AS hemisphere, unnest(range(len(brain_region))) AS fiber_idx
 FROM sessions WHERE len(brain_region) = len(hemisphere) AND len(brain_region) > 0)"""


def with_sql(prefix: str, *body: str) -> str:
    return " ".join(["WITH", prefix, *body])
