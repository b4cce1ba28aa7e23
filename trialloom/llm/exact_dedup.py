"""Exact deduplication: digest runs merged up a tree, identifiers kept at every level.

Every input partition is a run. One level merges ``fan_in`` neighbouring runs: rows are grouped by
(run // fan_in, digest), so Spark exchanges only what its map-side aggregate left of each run, and
the digests of a merged run are spread over all tasks. After log_fan_in(partitions) rounds a single
run is left, still spread by digest. A group of copies travels as at most one row per run, however
large it is. Texts never move: rows hold digests.

Equality is verified, not trusted to one digest: the group key also holds the length in bytes and an
independent 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialloom.llm.base import ascii_lower, hex_digest, query, stored, table

KEY = ["sha", "check_hash", "n_bytes"]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sha, check_hash, n_bytes, run): one row per row of ``docs``, written out once."""
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(text).alias("norm"))
    keys = norm.select(
        "id", F.unhex(hex_digest(F.col("norm"))).alias("sha"), F.xxhash64("norm").alias("check_hash"),
        F.octet_length("norm").alias("n_bytes"), F.spark_partition_id().alias("run"),
    )
    return stored(keys, "digest-runs")


def merge_runs(runs: DataFrame, fan_in: int = 16) -> DataFrame:
    """(sha, check_hash, n_bytes, n_rows, keep_id) of the whole input by tree-merging its runs."""
    last = runs.agg(F.max("run")).first()[0]
    n_runs = 1 if last is None else last + 1
    level = runs.select("run", *KEY, F.lit(1).cast("long").alias("n_rows"), F.col("id").alias("keep_id"))
    while True:
        level = level.withColumn("run", F.floor(F.col("run") / F.lit(fan_in)))
        level = level.groupBy("run", *KEY).agg(F.sum("n_rows").alias("n_rows"), F.max("keep_id").alias("keep_id"))
        n_runs = -(-n_runs // fan_in)
        if n_runs <= 1:
            return level.drop("run")


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fan_in: int = 16) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a
    group stays. Rows that repeat the kept id (the same row twice) are all marked as kept, as are the
    rows of a group without any id (keep_id null). An empty table gives no rows; further columns of
    ``docs`` are not read.
    """
    runs = digest_runs(docs, id_col, text)
    merged = merge_runs(runs, fan_in)
    return runs.join(merged, KEY).select(
        F.col("id").alias(id_col), "keep_id", F.col("n_rows").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group of equal texts.

    Of rows that repeat both id and text one stays, whichever. Only the (id, digest) pairs to remove
    are joined with the rows, so a hot group of copies is spread by its ids.
    """
    runs = digest_runs(docs, id_col, text)
    merged = merge_runs(runs)
    gone = runs.join(merged, KEY).where(~F.col("id").eqNullSafe(F.col("keep_id"))).select(
        F.col("id").alias("__gone_id"), F.col("sha").alias("__gone_sha")).distinct()
    again = stored(runs.groupBy(F.col("id").alias("__again_id"), F.col("sha").alias("__again_sha")).count()
                   .where("count > 1").drop("count"), "repeated-rows")
    rows = docs.withColumn("__sha", F.unhex(hex_digest(ascii_lower(text))))
    same = lambda who: F.col(id_col).eqNullSafe(F.col(f"__{who}_id")) & (F.col("__sha") == F.col(f"__{who}_sha"))
    if not again.isEmpty():
        once = rows.join(again.hint("shuffle_hash"), same("again"), "left_anti")
        rows = once.unionByName(rows.join(again.hint("shuffle_hash"), same("again"), "left_semi").dropDuplicates([id_col, "__sha"]))
    return rows.join(gone.hint("shuffle_hash"), same("gone"), "left_anti").drop("__sha")


ORACLE = """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)"""


@query("op7_exact_dedup", ORACLE)
def op7_exact_dedup(spark, sf_dir):
    """Every document with the id that stays of its group of equal texts."""
    return duplicate_report(table(spark, sf_dir, "documents"))
