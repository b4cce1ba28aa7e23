"""Token counts through a digest cache: only texts whose digest is not stored yet are encoded.

The cache is a Parquet table (tokenizer, sha, n_tokens); ``tokenizer`` is the digest of the vocabulary
file and of the library's version, so a new tokenizer never meets old counts. Digests of all rows are
joined with it; one row of each missing digest is sent on with its text, encoded, and its count
appended. Texts move once, spread by their row's id, so many copies of one text make no hot task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialloom.llm.base import query, scratch_path, stored, table

CACHED_PIECES = 200_000
#: Pre-tokenizer pattern of byte-level vocabularies, and its special token: fixed values of the file format.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Counts of texts by a byte-level tokenizer of the ``tokenizers`` library.

    A byte-level vocabulary splits a text at its special strings and then into pieces, and encodes
    every piece by itself, so a count is a sum over pieces. Pieces not met before in this worker go
    to the library as one batch. Any other kind of vocabulary encodes whole texts.
    """

    def __init__(self, vocabulary: bytes):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        text = vocabulary.decode("utf-8")
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(text)
        pre = spec.get("pre_tokenizer") or {}
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and spec.get("normalizer") is None and plain)
        marks = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.split = regex.compile("(?:" + "|".join(map(regex.escape, marks)) + ")").split if marks else lambda t: [t]
        self.find = regex.compile(PIECE).findall
        self.cache: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return [n for i in range(0, len(texts), 64) for n in self._encode(texts[i:i + 64])]
        out = []
        for t in texts:
            parts = self.split(t)
            pieces = [p for part in parts for p in self.find(part)]
            out.append(len(parts) - 1 + self._sum(pieces))
        return out

    def _sum(self, pieces: list[str]) -> int:
        cache = self.cache
        try:
            return sum(map(cache.__getitem__, pieces))
        except KeyError:
            pass
        if len(cache) > CACHED_PIECES:
            cache.clear()
        missing = list({p for p in pieces if p not in cache})
        cache.update(zip(missing, self._encode(missing)))
        return sum(map(cache.__getitem__, pieces))


class PieceModel:
    """Counts by a sentencepiece model; it encodes whole texts."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def worker_counter(vocabulary: bytes, kind: str):
    return PieceModel(vocabulary) if kind == ".model" else Counter(vocabulary)


def tokenizer_digest(path: str) -> str:
    import sentencepiece
    import tokenizers

    library = sentencepiece if path.endswith(".model") else tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__} {library.__version__}".encode()).hexdigest()


def encoded_counts(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` plus n_tokens (long), by encoding every row's text; null counts as empty."""
    with open(vocabulary, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    kind = os.path.splitext(vocabulary)[1]

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_counter(held.value, kind)
        for texts in batches:
            yield pd.Series(counter([t or "" for t in texts]), dtype="int64")

    return df.withColumn("n_tokens", F.pandas_udf(count, "long")(F.coalesce(F.col(text), F.lit(""))))


def _read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "sha binary, n_tokens long")
    # two writers may both have stored a digest: the counts are equal
    return found.where(F.col("tokenizer") == tokenizer).groupBy("sha").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str, cache_path: str, id_col: str = "doc_id", text: str = "text",
                 limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per row of ``docs``; new counts are appended to the cache.

    Null counts as empty (0 bytes, 0 tokens). Ids may repeat or be null; an empty table gives no
    rows and leaves the cache as it is. Further columns of ``docs`` are not read.
    """
    spark, version = docs.sparkSession, tokenizer_digest(vocabulary)
    body = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    sha = F.unhex(F.sha2(F.encode("body", "UTF-8"), 256)).alias("sha")
    keys = stored(body.select("id", sha, F.octet_length("body").cast("long").alias("n_bytes")), "token-keys")
    known = _read_cache(spark, cache_path, version)
    # one row per missing digest; the id only says where its text is found
    missing = (keys.groupBy("sha").agg(F.min("id").alias("id")).join(known.select("sha"), "sha", "left_anti")
               .select(F.col("id").alias("__id"), F.col("sha").alias("__sha")))
    rows = body.withColumn("sha", sha).join(
        missing.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")), "left_semi")
    fresh = encoded_counts(rows, vocabulary, "body").select(F.lit(version).alias("tokenizer"), "sha", "n_tokens")
    fresh.write.mode("append").parquet(cache_path)
    # written out, so that the join's exchanges are its own and AQE can split a digest that many rows hold
    counts = stored(_read_cache(spark, cache_path, version), "token-counts")
    return keys.join(counts, "sha").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    """Token counts of every document; the cache starts empty, so every distinct text is encoded."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-cache"))
