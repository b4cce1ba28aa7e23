"""Reading, collecting, storing and updating the result tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trialloom.constants import ERROR_COLUMNS
from trialloom.session import checkpoint_dir, cut_lineage

# The catalog contract, column -> (type, default).
SESSION_SCHEMA = {
    "eid": ("string", None), "subject": ("string", None), "start_time": ("string", None),
    "task_protocol": ("string", None), "number": ("int", None), "projects": ("array<string>", []),
    "strain": ("string", None), "line": ("string", None), "genotype": ("string", None), "NM": ("string", None),
    "brain_region": ("array<string>", []), "hemisphere": ("array<string>", []), "users": ("array<string>", []),
    "lab": ("string", None), "end_time": ("string", None), "_datasets_from_session_dict": ("array<string>", []),
    "datasets": ("array<string>", []), "session_type": ("string", None), "target_NM": ("array<string>", []),
}
LOG_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ERROR_COLUMNS])
NONE_SENTINEL = "__none__"
STORE_BUCKETS = 64


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the session's checkpoints (shared on a cluster)."""
    return f"{checkpoint_dir(spark)}/trialloom/{name}-{uuid.uuid4().hex[:12]}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def enforce_schema(df: DataFrame, schema: dict = SESSION_SCHEMA) -> DataFrame:
    """Add missing columns with their default, null list cells become the default list.

    Extra columns stay; scalar columns are not cast.
    """
    def default(kind, value):
        return (F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)).cast(kind)

    types = dict(df.dtypes)
    new = {}
    for name, (kind, value) in schema.items():
        if name not in types:
            new[name] = default(kind, value)
        elif kind.startswith("array"):
            new[name] = F.coalesce(F.col(name), default(kind, value)) if types[name].startswith("array") else default(kind, value)
    return df.withColumns(new) if new else df


def drop_sentinel(df: DataFrame, sentinel: str = NONE_SENTINEL) -> DataFrame:
    """The stored text sentinel for a missing value becomes null."""
    return df.select(*[F.when(F.col(n) != sentinel, F.col(n)).alias(n) if k == "string" else F.col(n) for n, k in df.dtypes])


def collect_catalog(metadata: DataFrame, schema: dict = SESSION_SCHEMA) -> DataFrame:
    """Session catalog from the per-session metadata rows."""
    return enforce_schema(drop_sentinel(metadata), schema)


def collect_errors(spark: SparkSession, path: str) -> DataFrame:
    """All stored error rows as one log; a missing store gives an empty log."""
    if not _exists(spark, path):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.parquet(path).select(*ERROR_COLUMNS)


def collect_qc(parts: list[DataFrame]) -> DataFrame:
    """QC rows of sources with different metric columns as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def mixed_to_string(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns holding mixed kinds are kept as text, nulls stay null."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def save_table(df: DataFrame, path: str, *, text_columns: list[str] = (), timestamp: str | None = None) -> str:
    """Save a table, optionally with a time stamp in its name; returns the path used."""
    target = f"{path}.{timestamp}" if timestamp else path
    mixed_to_string(df, list(text_columns)).write.mode("overwrite").parquet(target)
    return target


def load_scoped(spark: SparkSession, path: str, recordings: DataFrame | None = None, key: str = "eid") -> DataFrame | None:
    """A result table restricted to the sessions in scope; None when it was never written.

    Tables without the key (cell-keyed results) are read whole.
    """
    if not _exists(spark, path):
        return None
    df = spark.read.parquet(path)
    if recordings is None or key not in df.columns:
        return df
    return df.join(recordings.select(key).distinct(), key, "left_semi")


def errors_by_session(log: DataFrame, eids: DataFrame, out: str = "logged_errors") -> DataFrame:
    """Distinct error types per asked session, an empty list when none."""
    types = log.select("eid", "error_type").distinct().groupBy("eid").agg(F.sort_array(F.collect_list("error_type")).alias(out))
    return eids.join(types, "eid", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def load_or_collect_errors(log: DataFrame, eids: DataFrame, cache_path: str) -> DataFrame:
    """Write-once cache of the error roll-up, left-joined to the asked sessions."""
    spark = eids.sparkSession
    if not _exists(spark, cache_path):
        errors_by_session(log, eids).write.mode("ignore").parquet(cache_path)
    cached = spark.read.parquet(cache_path).select("eid", "logged_errors")
    return eids.join(cached, "eid", "left").withColumn(
        "logged_errors", F.coalesce("logged_errors", F.array().cast("array<string>")))


def unprocessed(sessions: DataFrame, stored: DataFrame, key: str = "eid", reprocess: bool = False) -> DataFrame:
    """Sessions not in the store yet; all of them when reprocessing."""
    return sessions if reprocess else sessions.join(stored.select(key).distinct(), key, "left_anti")


def upsert(previous: DataFrame, batch: DataFrame, key: str = "eid") -> DataFrame:
    """Previous rows whose session is not in the batch, plus the batch."""
    return previous.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; small report frames, one file per part."""
    df.write.mode("overwrite").option("header", True).csv(path)


class GroupStore:
    """One table per group (trials, signal, responses, ...), replaced session by session.

    Rows sit in hash buckets of the session id, so a store of millions of sessions has a
    bounded number of folders; saving rewrites only the buckets its sessions fall in.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "eid", buckets: int = STORE_BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets

    def _path(self, group: str) -> str:
        return f"{self.root}/{group}"

    def groups(self) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def save(self, group: str, rows: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = rows.withColumn("bucket", bucket)
        if _exists(self.spark, self._path(group)):
            rows = cut_lineage(rows)
            touched = rows.select("bucket").distinct()
            kept = (self.spark.read.parquet(self._path(group)).join(F.broadcast(touched), "bucket", "left_semi")
                    .join(rows.select(self.key).distinct(), self.key, "left_anti"))
            rows = cut_lineage(kept.unionByName(rows, allowMissingColumns=True))
        # rebalance: AQE cuts large buckets into several even files and merges small ones
        (rows.hint("rebalance", "bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._path(group)))

    def load(self, groups: list[str], sessions: DataFrame | None = None) -> dict[str, DataFrame | None]:
        """Only the asked groups are read; a group never saved is None."""
        out = {}
        for g in groups:
            try:
                df = self.spark.read.parquet(self._path(g)).drop("bucket")
            except AnalysisException:
                df = None
            out[g] = df if df is None or sessions is None else df.join(sessions.select(self.key).distinct(), self.key, "left_semi")
        return out


def collect_trials(trials: DataFrame, sessions: DataFrame, tags: list[str], key: str = "eid") -> DataFrame:
    """Trials of in-scope sessions tagged with session columns."""
    return trials.join(sessions.dropDuplicates([key]).select(key, *tags), key)


def sessions_without(sessions: DataFrame, rows: DataFrame, key: str = "eid") -> DataFrame:
    return sessions.select(key).distinct().join(rows.select(key).distinct(), key, "left_anti")


# Integer codes of the quality verdicts.
QC_CODES = {0: "NOT_SET", 10: "PASS", 20: "WARNING", 30: "FAIL", 40: "CRITICAL"}


def extended_qc(df: DataFrame, key: str, json: str) -> DataFrame:
    """JSON map of quality outcomes as (key, field, verdict, detail) rows.

    A list holds the verdict first and its values after; booleans become PASS / FAIL,
    integer codes their names, other numbers and texts stay; an object is an error.
    """
    m = df.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("field", "raw"))
    is_list = F.col("raw").startswith("[")
    items = F.from_json(F.when(is_list, F.col("raw")), "array<string>")
    v = F.when(is_list, F.get(items, F.lit(0))).otherwise(F.col("raw"))
    codes = F.create_map(*[F.lit(x) for k, n in QC_CODES.items() for x in (str(k), n)])
    verdict = (F.when(v == "true", "PASS").when(v == "false", "FAIL").when(v.startswith("{"), None)
               .otherwise(F.coalesce(F.try_element_at(codes, v), v)))
    name = F.concat(F.lit("qc_"), F.regexp_replace(F.regexp_replace("field", "^_", ""), "_qc$", ""))
    return m.select(key, name.alias("field"), verdict.alias("verdict"),
                    F.when(is_list, F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))).alias("detail"),
                    v.startswith("{").alias("is_error"))


def extended_qc_wide(long: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return long.groupBy(key).pivot("field", fields).agg(F.first("verdict", True))


def resolve_regions(sessions: DataFrame, descriptions: DataFrame, locations: DataFrame, key: str = "eid") -> DataFrame:
    """Regions from the experiment description, else from the locations table; neither is an error."""
    j = (sessions.join(descriptions.select(key, F.col("regions").alias("__a")), key, "left")
         .join(locations.select(key, F.col("regions").alias("__b")), key, "left"))
    regions = F.coalesce("__a", "__b")
    return j.withColumn("brain_region", regions).withColumn("hemisphere", hemisphere_of(regions)).withColumn(
        "region_error", F.when(regions.isNull(), "MissingBrainRegion")).drop("__a", "__b")


def hemisphere_of(regions):
    return F.transform(regions, lambda r: F.when(r.rlike("-[lr]$"), F.right(r, F.lit(1))).otherwise(F.lit("")))


def subject_info(sessions: DataFrame, subjects: DataFrame, strain_to_nm: dict, line_to_nm: dict, key: str = "subject") -> DataFrame:
    """Subject attributes by nickname, which must be unique; NM from the strain, else the line."""
    from trialloom.functions.columns import lookup

    known = [c for c in ("strain", "line", "genotype") if c in subjects.columns]
    unique = subjects.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(c) for c in known])
    j = sessions.join(unique, key, "left")
    ok = F.col("__n") == 1
    return j.withColumns({
        **{c: F.when(ok, F.col(c)) for c in known},
        "NM": F.when(ok, F.coalesce(lookup(strain_to_nm, "strain"), lookup(line_to_nm, "line"))),
        "subject_error": F.when(F.coalesce(F.col("__n"), F.lit(0)) != 1, "SubjectNotUnique"),
    }).drop("__n")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Id allow-list from a text file, blank lines ignored."""
    return spark.read.text(path).select(F.trim("value").alias("eid")).where("eid <> ''").distinct()


def keep_listed(df: DataFrame, ids: DataFrame, key: str = "eid") -> DataFrame:
    """Rows of the listed ids; none left is an error."""
    out = df.join(ids, key, "left_semi")
    if out.isEmpty():
        raise ValueError("no listed id found")
    return out


def apply_label(labels: DataFrame, eid, field: str, value: str, fields: list[str], vocabulary: list[str]) -> DataFrame:
    """Set one manual verdict; field and value must be known, other cells stay."""
    if field not in fields:
        raise ValueError(f"unknown field {field}")
    if value not in vocabulary:
        raise ValueError(f"unknown verdict {value}")
    return labels.withColumn(field, F.when(F.col("eid") == F.lit(eid), F.lit(value)).otherwise(F.col(field)))


def merge_labels(automatic: DataFrame, manual: DataFrame, fields: list[str], key: str = "eid", unset: str = "NOT_SET") -> DataFrame:
    """Re-save of automatic verdicts that never overwrites a manual one."""
    m = manual.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    j = automatic.join(m, key, "left")
    keep = lambda f: F.when(F.col(f"__{f}") != unset, F.col(f"__{f}"))
    return j.select(*[c for c in automatic.columns if c not in fields],
                    *[F.coalesce(keep(f), F.col(f), F.lit(unset)).alias(f) for f in fields])


def enrich_sessions(sessions: DataFrame, subjects: DataFrame, descriptions: DataFrame, locations: DataFrame, strain_to_nm: dict, line_to_nm: dict) -> DataFrame:
    """Catalog rows with subject, regions, type, targets and length; problems are collected, never raised.

    ``logged_errors`` lists the typed errors of all steps.
    """
    from trialloom.operators import derive

    out = subject_info(sessions, subjects, strain_to_nm, line_to_nm)
    out = resolve_regions(out, descriptions, locations)
    out = derive.session_length(derive.target_nm(derive.session_type(out)))
    steps = ["subject_error", "region_error", "type_error", "target_error", "length_error"]
    return out.withColumn("logged_errors", F.array_compact(F.array(*steps))).drop(*steps)
