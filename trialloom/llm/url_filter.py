"""URL filtering by dated lists: a temporal join of captures with the entries active at fetch time.

A list is a log of dated entries (add or remove a key). Consecutive entries of one (list, key) make
validity intervals [valid_from, valid_to). A capture asks for its host, every parent domain and its
host plus first path segment; the as-of join keeps intervals that hold its fetch day. The most
specific key decides; on equal keys blocking wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from trialloom.llm.base import query, table

OPEN_END = 2_147_483_647  # valid_to of an entry that nothing follows


def url_keys(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` plus host (lower case, without www.) and keys: what a list may name to cover this URL."""
    authority = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    segment = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]*)", 1)
    df = df.withColumn("host", F.regexp_replace(F.lower(authority), r"^www\.", "")).withColumn("__labels", F.split("host", r"\."))
    parents = F.expr("transform(sequence(1, greatest(size(__labels) - 1, 1)), i -> array_join(slice(__labels, i, size(__labels)), '.'))")
    keys = F.when(F.col("host") == "", F.array().cast("array<string>")).when(
        F.length(segment) > 1, F.concat(parents, F.array(F.concat("host", segment)))).otherwise(parents)
    return df.withColumn("keys", keys).drop("__labels")


def validity(entries: DataFrame) -> DataFrame:
    """(list, key, action, valid_from, valid_to) of (list, key, day, seq, op, action).

    Of several entries on one day the last (by seq) holds. Rows with a null key, list or day are void.
    """
    real = entries.where("key IS NOT NULL AND list IS NOT NULL AND day IS NOT NULL")
    log = W.partitionBy("list", "key").orderBy("day", "seq")
    spans = real.withColumn("valid_to", F.coalesce(F.lead("day").over(log), F.lit(OPEN_END)))
    return spans.where("op = 'add' AND day < valid_to").select("list", "key", "action", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, intervals: DataFrame, id_col: str = "page_id", url: str = "url", day: str = "day") -> DataFrame:
    """(id, day, decision, list, key, valid_from, valid_to), one row per distinct (id, url, day).

    decision is block, allow or none. A null or malformed URL and a null day match nothing. Repeated
    rows count once; further columns are not read.
    """
    asked = url_keys(captures.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(day).alias("day")), "url")
    asked = asked.select("id", "url", "day", F.explode_outer("keys").alias("key"))
    # both sides of the join are plain exchanges: AQE can split the keys of a hot host
    spans = intervals.select(F.col("key").alias("k"), "list", "action", "valid_from", "valid_to")
    found = asked.join(spans, (F.col("key") == F.col("k")) & (F.col("day") >= F.col("valid_from")) & (F.col("day") < F.col("valid_to")), "left")
    rank = F.struct(F.length("k").alias("n"), (F.col("action") == "block").alias("b"), F.col("list").alias("l"), F.col("valid_from").alias("f"))
    best = found.groupBy("id", "url", "day").agg(F.max(F.when(F.col("k").isNotNull(), F.struct(rank.alias("rank"), "action", "list", "k", "valid_from", "valid_to"))).alias("m"))
    return best.select(
        F.col("id").alias(id_col), F.col("day"), F.coalesce("m.action", F.lit("none")).alias("decision"), F.col("m.list").alias("list"),
        F.col("m.k").alias("key"), F.col("m.valid_from").alias("valid_from"), F.col("m.valid_to").alias("valid_to"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day derived from their id."""
    return pages.select("page_id", "url", (F.col("page_id") * 37 % 365).cast("int").alias("day"))


def lists_of(pages: DataFrame) -> DataFrame:
    """A dated log over all keys that the pages' URLs hold: adds, removals and returns, by a hash of the key."""
    keys = url_keys(pages.select("url")).select(F.explode("keys").alias("key")).distinct()
    rows = keys.select("key", F.explode(F.array(F.lit("spam"), F.lit("adult"), F.lit("trusted"))).alias("list"))
    rows = rows.withColumn("v", F.conv(F.substring(F.md5(F.concat_ws("|", "list", "key").cast("binary")), 1, 4), 16, 10).cast("int")).where("v % 3 = 0")
    steps = F.expr("filter(array(named_struct('seq', 1, 'op', 'add', 'day', v % 200), named_struct('seq', 2, 'op', 'remove', 'day', v % 200 + 20 + v % 90), "
                   "named_struct('seq', 3, 'op', 'add', 'day', v % 200 + 160)), s -> s.seq = 1 OR (s.seq = 2 AND v % 2 = 0) OR (s.seq = 3 AND v % 4 = 0))")
    action = F.when(F.col("list") == "trusted", "allow").otherwise("block").alias("action")
    return rows.select("list", "key", action, F.explode(steps).alias("s")).select("list", "key", "action", "s.seq", "s.op", "s.day")


ORACLE = f"""WITH u AS (SELECT page_id, url, (page_id * 37 % 365)::INT AS day,
 regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS host,
 regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]*)', 1) AS segment FROM pages),
k AS (SELECT page_id, url, day, CASE WHEN host = '' THEN []::VARCHAR[] ELSE
 list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) ||
 CASE WHEN len(segment) > 1 THEN [host || segment] ELSE []::VARCHAR[] END END AS keys FROM u),
a AS (SELECT page_id, url, day, unnest(keys) AS key FROM k),
v AS (SELECT key, list, ('0x' || substr(md5(list || '|' || key), 1, 4))::INT AS v FROM (SELECT DISTINCT key FROM a), (VALUES ('spam'), ('adult'), ('trusted')) l(list)),
e AS (SELECT key, list, 1 AS seq, 'add' AS op, v % 200 AS day FROM v WHERE v % 3 = 0
 UNION ALL SELECT key, list, 2, 'remove', v % 200 + 20 + v % 90 FROM v WHERE v % 3 = 0 AND v % 2 = 0
 UNION ALL SELECT key, list, 3, 'add', v % 200 + 160 FROM v WHERE v % 3 = 0 AND v % 4 = 0),
i AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY list, key ORDER BY day, seq), {OPEN_END}) AS valid_to FROM e),
m AS (SELECT a.page_id, a.url, a.day, i.list, i.key, i.day AS valid_from, i.valid_to, row_number() OVER (PARTITION BY a.page_id, a.url, a.day
 ORDER BY len(i.key) DESC, (i.list <> 'trusted') DESC, i.list DESC, i.day DESC) AS r
 FROM a JOIN i ON a.key = i.key AND i.op = 'add' AND i.day < i.valid_to AND a.day >= i.day AND a.day < i.valid_to)
SELECT u.page_id, u.day, CASE WHEN m.key IS NULL THEN 'none' WHEN m.list = 'trusted' THEN 'allow' ELSE 'block' END AS decision,
 m.list, m.key, m.valid_from, m.valid_to FROM (SELECT DISTINCT page_id, url, day FROM u) u
 LEFT JOIN m ON m.page_id = u.page_id AND m.url IS NOT DISTINCT FROM u.url AND m.day = u.day AND m.r = 1"""


@query("op1_url_filter", ORACLE)
def op1_url_filter(spark, sf_dir):
    """Decision of dated lists for every page at its fetch day."""
    pages = table(spark, sf_dir, "pages")
    return judge(captures_of(pages), validity(lists_of(pages)))
