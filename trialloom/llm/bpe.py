"""Byte-level BPE as a monoid: halves are encoded on their own and joined by re-encoding a window.

Two trees, both over halves and both joined by a growing window around the seam:

* pieces. A text's pieces (the matches of the split pattern) are found from left to right, and the
  match at a position depends only on the text from there on, looking at most one character past
  its end. So pieces of the left half that end two characters before the seam stand, and as soon as
  the re-split window meets a boundary of the right half, every later piece of it stands too.
* tokens of a long piece. A token row is the encoding of its bytes exactly if every two neighbours
  encode to themselves. Both halves hold this inside; the window is re-encoded with 4, 8, 16 ...
  tokens from each side until it also holds at the window's two ends.

Decoding joins the bytes of halves up the same tree. Spark deals the rows; nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from trialloom.llm.base import hex_digest, query, table

LEAF_CHARS = 1024      # a text up to this length is split at once
LEAF_BYTES = 48        # a piece up to this length is merged at once
CACHED_PIECES = 200_000
BATCH_CHARS = 2_000_000  # texts sent on together


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


class Codec:
    """Encoder and decoder for one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.cache: dict[str, bytes] = {}

    # -- tokens of one piece

    def merge(self, data: bytes) -> list[int]:
        """Join the neighbours of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [ranks.get(parts[i] + parts[i + 1], _NONE) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i > 0:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        return [ranks[p] for p in parts]

    def stands(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        width = 4
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.stands(left[i - 1], window[0])) and (j == len(right) or self.stands(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2

    def piece_tokens(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        mid = len(data) // 2
        return self.join_tokens(self.piece_tokens(data[:mid]), self.piece_tokens(data[mid:]))

    # -- pieces of a text

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        keep, cut = len(left), 0  # cut: characters of left behind the pieces that stand
        while keep and cut < 2:
            keep -= 1
            cut += len(left[keep])
        tail, width = "".join(left[keep:]), 4
        while True:
            n = min(width, len(right))
            window = tail + "".join(right[:n])
            # a piece of the window stands if it ends two characters before the window's end
            limit = len(window) if n == len(right) else len(window) - 2
            seams = {}
            at = len(tail)
            for k in range(n + 1):
                seams[at] = k
                at += len(right[k]) if k < n else 0
            fresh, at = [], 0
            for piece in self.find(window):
                at += len(piece)
                if at > limit:
                    break
                fresh.append(piece)
                if at in seams:
                    return left[:keep] + fresh + right[seams[at]:]
            width *= 2

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.find(text)
        mid = len(text) // 2
        return self.join_pieces(self.pieces(text[:mid]), self.pieces(text[mid:]))

    # -- texts

    def encode(self, text: str) -> bytes:
        """Token ids as packed 32-bit integers."""
        cache, out = self.cache, []
        pieces = self.pieces(text)
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            pass
        if len(cache) > CACHED_PIECES:
            cache.clear()
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = np.array(self.piece_tokens(p.encode("utf-8")), dtype="<i4").tobytes()
                if len(p) <= LEAF_CHARS:
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_NONE = 1 << 60


@lru_cache(maxsize=2)
def worker_codec(lines: bytes, pattern: str) -> Codec:
    return Codec(parse_ranks(lines), pattern)


def _runs(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters each, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _file(spark, path: str):
    """The vocabulary's bytes as a broadcast: of fixed size, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` plus ``out``: array<int>, the tokens of each whole text by the rank file ``vocabulary``.

    Null counts as empty and gives no tokens. All other columns pass through; one named like ``out``
    is replaced. Special tokens are ordinary text here.
    """
    held = _file(docs.sparkSession, vocabulary)

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = worker_codec(held.value, pattern)
        for texts in batches:
            yield pd.Series([np.frombuffer(codec.encode(t or ""), dtype="<i4") for t in texts], dtype=object)

    udf = F.pandas_udf(ids, "array<int>")
    return docs.withColumn(out, udf(F.coalesce(F.col(text), F.lit(""))))


def decode_column(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus ``out``: binary, the bytes of each row's tokens. A null row gives null."""
    held = _file(df.sparkSession, vocabulary)

    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = worker_codec(held.value, pattern)
        for rows in batches:
            yield rows.map(lambda r: None if r is None else codec.decode(r.tolist()))

    return df.withColumn(out, F.pandas_udf(text, "binary")(F.col(ids)))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all unless named) plus ids array<int> and decoded binary.

    Null counts as empty: no tokens, no bytes. Columns named ids or decoded are replaced.

    One pass of Arrow batches: both directions of a row are made in the same task, in groups of
    about BATCH_CHARS characters, so that a batch of very long texts does not pile up.
    """
    held = _file(docs.sparkSession, vocabulary)
    rest = [c for c in (docs.columns if carry is None else carry) if c not in ("ids", "decoded")]
    schema = docs.select(*rest).schema.add("ids", ArrayType(IntegerType())).add("decoded", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(held.value, pattern)
        for batch in batches:
            kept = batch.columns[1:]
            for a, b in _runs(pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_pylist(), BATCH_CHARS):
                packed = [codec.encode(t or "") for t in batch.column(0).slice(a, b - a).to_pylist()]
                offsets = np.cumsum([0] + [len(x) // 4 for x in packed], dtype=np.int32)
                flat = np.frombuffer(b"".join(packed), dtype="<i4")
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                back = pa.array([codec.decode(np.frombuffer(x, dtype="<i4").tolist()) for x in packed], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in kept), ids, back], names=[*rest, "ids", "decoded"])

    return docs.select(F.col(text).alias("__text"), *rest).mapInArrow(run, schema)


@query("op5_bpe")
def op5_bpe(spark, sf_dir):
    """Token count and the digests of ids and decoded bytes of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id"])
    return df.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        hex_digest(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
