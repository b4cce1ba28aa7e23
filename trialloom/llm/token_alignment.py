"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked ids.

Both token sequences of a text get their cumulative byte ends, kept as a dictionary end -> index. The
ends that both dictionaries hold, in order, cut the two id lists into groups; inside a group every pair
of tokens whose byte ranges overlap is a link. A group of p and q tokens has p + q - 1 links, so links
grow with the tokens, never with their product.

Both vocabularies always break between a visible character and a following blank or line feed, and between a
Latin letter and a following stop (checked against the vocabularies, otherwise texts are encoded whole), so texts are
cut there. A worker remembers the aligned chunks; new ones are encoded as one text and aligned in one go.

How it scales:

* Documents travel in blocks of BLOCK_BYTES. A block lists its distinct id pairs once, a document only
  refers to them by place. Pair counts are a plain aggregate with map-side sums over blocks.
* Counts come back by block: each block receives the counts of its own pairs, whatever the number of
  pairs in the corpus. Nothing is broadcast but the two vocabulary files, and no task holds more than a
  block or a single document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trialloom.llm.base import query, stored, table

BLOCK_BYTES = 4_000_000     # text of the documents that share one list of id pairs
SPAN_BYTES = 500_000        # text encoded together
CACHED_CHUNKS = 200_000     # chunks in each of the two generations that a worker remembers
KEPT_CHUNK = 200            # longest chunk worth remembering
SHIFT = 32                  # a pair of ids in one long: a << 32 | b

#: From a blank or line feed after a visible character up to the next one.
CHUNKS = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
#: The same, and a cut between a Latin letter and a stop.
LATIN = "[A-Za-zÀ-ÖØ-öø-ɏ]"
FINE_CHUNKS = re.compile(rf"[ \n]{LATIN}+(?=[.,;:!?])|(?<={LATIN})[.,;:!?]\S*(?:[^\S \n]\s*\S*)*|" + CHUNKS.pattern)
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: a visible Latin-1 character is itself, the rest count up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(c): b for b, c in [*((b, b) for b in shown), *((b, 256 + i) for i, b in enumerate(rest))]}


def common_slices(a_ends: Iterable[int], b_ends: Iterable[int]) -> list[tuple[int, int, int]]:
    """(end, a to, b to) for every byte end that both token sequences have, in order: the slices of both id lists."""
    a_at, b_at = {e: i for i, e in enumerate(a_ends, 1)}, {e: i for i, e in enumerate(b_ends, 1)}
    return [(e, a_at[e], b_at[e]) for e in sorted(a_at.keys() & b_at.keys())]


def slice_links(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> list[int]:
    """Linked ids, a << SHIFT | b, of one slice: tokens in order that overlap; both sides cover the same bytes."""
    links, i, j, x, y = [], 0, 0, a_sizes[0], b_sizes[0]
    while True:
        links.append(a[i] << SHIFT | b[j])
        step_a, step_b = x <= y, y <= x
        if step_a:
            i += 1
            if i == len(a):
                return links
            x += a_sizes[i]
        if step_b:
            j += 1
            y += b_sizes[j]


class Aligner:
    """Encodes texts with a byte-level vocabulary (A) and a piece model (B) and aligns the ids."""

    def __init__(self, vocabulary: bytes, model: bytes):
        import os

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        text = vocabulary.decode("utf-8")
        self.a = Tokenizer.from_str(text)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=model)
        alphabet = byte_alphabet()
        entries = self.a.get_vocab(with_added_tokens=True)
        plain = lambda entry: bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode("utf-8")
        self.a_bytes = [b""] * (max(entries.values(), default=-1) + 1)
        for e, i in entries.items():
            self.a_bytes[i] = plain(e)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode("utf-8") for p in pieces]
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        spec = json.loads(text)
        pre = spec.get("pre_tokenizer") or {}
        a_breaks = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        # "\n" in no piece: it stands alone; no blank after a visible character: pieces break there
        b_breaks = not any("\n" in p or re.search("[^▁]▁", p) for p in pieces) and self._keeps_blanks()
        self.find = None if not (a_breaks and b_breaks) else CHUNKS if any(re.search(f"{LATIN}[.,;:!?]", p) for p in pieces) else FINE_CHUNKS
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}  # entries move to young when they are met again

    def _keeps_blanks(self) -> bool:
        """Whether B adds one blank in front and changes no other character."""
        probe = "  x  Åﬁ　y "
        return "".join(self.b.id_to_piece(i) if not self.b.is_byte(i) else "" for i in self.b.encode(probe)).replace("▁", " ").startswith("   x  ") and b"".join(
            self.b_bytes[i] for i in self.b.encode(probe)) == (" " + probe).encode("utf-8")

    def _encode(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """Ids of parts, one after the other. A part that starts with a blank or line feed and ends in a visible
        character breaks from its neighbours by itself; the others are encoded alone."""
        a, b = [], []
        for alone, run in groupby(parts, lambda p: p[0] not in " \n" or p[-1].isspace()):
            if not alone:
                text = "".join(run)
                a += self.a.encode(text, add_special_tokens=False).ids
                # B puts a blank in front, which counts as that of the text; before a line feed it is one too many
                b += self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
            else:
                for part in run:
                    a += self.a.encode(part, add_special_tokens=False).ids
                    # no piece holds a line feed: what B makes of one in front is its own blank and the line feed
                    b += self.b.encode(part[1:]) if part[0] == " " else self.b.encode("\n" + part)[2:]
        return a, b

    def _entries(self, parts: list[str]) -> list[tuple | None]:
        """(n_a, n_groups, linked pairs as bytes, groups as text) of every part; None if the bytes are not its own."""
        a, b = self._encode(parts)
        raw = [p.encode("utf-8") for p in parts]
        a_sizes, b_sizes = list(map(self.a_sizes.__getitem__, a)), list(map(self.b_sizes.__getitem__, b))
        whole = b"".join(raw)
        slices = common_slices(accumulate(a_sizes), accumulate(b_sizes))
        ends = list(accumulate(map(len, raw)))
        place = {e: k for k, (e, _, _) in enumerate(slices, 1)}
        if (b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole
                or any(e not in place for e in ends)):
            # some part is not given back byte by byte: look for it
            return [None] if len(parts) == 1 else [x for half in (parts[:len(parts) // 2], parts[len(parts) // 2:]) for x in self._entries(half)]
        # links and text of every slice; most hold one token of each
        words, links, i, j = [], [], 0, 0
        for _, p, q in slices:
            if p - i == 1 == q - j:
                links.append(a[i] << SHIFT | b[j])
                words.append(f"{a[i]}|{b[j]}")
            else:
                links += slice_links(a[i:p], b[j:q], a_sizes[i:p], b_sizes[j:q])
                words.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        packed = np.array(links, np.int64).tobytes()
        out, k, i, j, at = [], 0, 0, 0, 0
        for end in ends:
            last = place[end]
            _, p, q = slices[last - 1]
            to = at + 8 * (p - i + q - j - (last - k))   # a slice of x and y tokens has x + y - 1 links
            out.append((p - i, last - k, packed[at:to], ";".join(words[k:last])))
            k, i, j, at = last, p, q, to
        return out

    def _fill(self, parts: set[str]) -> dict[str, tuple | None]:
        """Entries of parts that are too long to remember; the others go to the cache."""
        large, todo = {}, sorted(parts, key=lambda p: p[0] not in " \n" or p[-1].isspace())
        for at in range(0, len(todo), 512):
            piece = todo[at:at + 512]
            for part, entry in zip(piece, self._entries(piece)):
                (self.young if len(part) <= KEPT_CHUNK else large)[part] = entry
        return large

    def __call__(self, texts: list[str | None]) -> Iterator[tuple]:
        """Per text (n_a, n_b, n_groups, linked pairs as bytes, groups as text); zeros without tokens."""
        none = (0, 0, 0, b"", "")
        if len(self.young) > CACHED_CHUNKS:
            self.old, self.young = self.young, {}
        parts = [(self.find.findall(" " + t) if self.find else [" " + t]) if t else [] for t in texts]
        missing = set(chain.from_iterable(parts)) - self.young.keys()
        known = missing & self.old.keys()
        self.young.update(zip(known, map(self.old.__getitem__, known)))
        large = self._fill(missing - known)
        look = {**self.young, **large}.__getitem__ if large else self.young.__getitem__
        for text, mine in zip(texts, parts):
            entries = list(map(look, mine))
            if None in entries:
                # parts may only be wrong by themselves; the whole text decides
                entries = self._entries([" " + text])
            if not entries or entries[0] is None:
                yield none
                continue
            n_a, n_groups, links, words = zip(*entries)
            n_a, n_groups, links = sum(n_a), sum(n_groups), b"".join(links)
            yield n_a, len(links) // 8 + n_groups - n_a, n_groups, links, ";".join(words)


@lru_cache(maxsize=1)
def worker_aligner(vocabulary: bytes, model: bytes) -> Aligner:
    return Aligner(vocabulary, model)


def _files(docs: DataFrame, *paths: str):
    held = []
    for p in paths:
        with open(p, "rb") as f:
            held.append(docs.sparkSession.sparkContext.broadcast(f.read()))
    return held


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """(ids, texts) of at most SPAN_BYTES characters, one row at least."""
    for batch in batches:
        texts, ids, at, size = batch.column(1).to_pylist(), batch.column(0), 0, 0
        for i, t in enumerate(texts):
            n = len(t or "")
            if i > at and size + n > SPAN_BYTES:
                yield ids.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += n
        if texts:
            yield ids.slice(at), texts[at:]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def aligned_blocks(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their numbers and places of linked pairs (pairs null), and per block its pairs with their numbers (slots null)."""
    a_file, b_file = _files(docs, vocabulary, model)
    body = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = StructField("id", body.schema["id"].dataType)
    rest = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, slots array<int>, times array<bigint>, pairs array<bigint>"
    schema = StructType([StructField("block", StringType()), kind, *StructType.fromDDL(rest).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(a_file.value, b_file.value)
        part, seq, size, rows, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            name, n = f"{part}-{seq}", len(rows)
            sizes = [len(r[4]) for r in rows]
            pairs, slots = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
            times = np.concatenate([r[5] for r in rows])
            cut = np.cumsum(sizes)[:-1]
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, slots, times)
            cols = [pa.array([name] * n), pa.concat_arrays(ids), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([int(r[5].sum()) for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.string()), _lists(np.split(slots, cut), pa.int32()), _lists(np.split(times, cut), pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            if len(pairs):
                last = [pa.array([name]), pa.nulls(1, cols[1].type), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())),
                        _lists([total], pa.int64()), _lists([pairs], pa.int64())]
                yield pa.RecordBatch.from_arrays(last, names=schema.names)

        for span_ids, texts in _spans(batches):
            ids.append(span_ids)
            for t, (n_a, n_b, n_groups, links, words) in zip(texts, aligner(texts)):
                pairs, times = np.unique(np.frombuffer(links, np.int64), return_counts=True)
                rows.append((n_a, n_b, n_groups, hashlib.sha256(words.encode()).hexdigest() if n_a else "", pairs, times.astype(np.int64)))
                size += len(t or "")
            if size >= BLOCK_BYTES:
                yield from flush()
                seq, size, rows, ids = seq + 1, 0, [], []
        if rows:
            yield from flush()

    return stored(body.mapInArrow(run, schema), "aligned-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): links per pair of ids over all documents; best where no pair of the same B id has more."""
    counts = stored(_block_pairs(blocks).groupBy("pair").agg(F.sum("times").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    rows = blocks.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("slot", "p"))
    return rows.select("block", "slot", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))


def linked_ids(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(a_id, b_id, count, best): the corpus-wide table of linked ids."""
    counts = pair_counts(aligned_blocks(docs, vocabulary, model, id_col, text))
    return counts.select(F.shiftright("pair", SHIFT).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int").alias("b_id"), "count", "best")


def alignments(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, groups): per document the groups of ids as text, `a1,a2|b1;a3|b2,b3`; empty without tokens."""
    a_file, b_file = _files(docs, vocabulary, model)
    body = docs.select(F.col(id_col), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(a_file.value, b_file.value)
        for ids, texts in _spans(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[4] for r in aligner(texts)], pa.string())], names=[id_col, "groups"])

    return body.mapInArrow(run, StructType([body.schema[id_col]]).add("groups", "string"))


def alignment_report(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    Texts that are null or empty, or whose token bytes in A or B differ from ' ' + text, have no tokens:
    zeros, and an empty groups_sha256. Ids may repeat, be null and of any type; every row counts. An empty
    table gives no rows; further columns of ``docs`` are not read, whatever their names.
    """
    blocks = aligned_blocks(docs, vocabulary, model, id_col, text)
    found = _block_pairs(blocks).select("block", "slot", "pair").join(pair_counts(blocks), "pair").select(F.col("block").alias("of"), "slot", "count", "best")
    rows = blocks.where("pairs IS NULL").drop("pairs")
    out = StructType([f for f in rows.schema.fields if f.name in ("id", "n_a", "n_b", "n_groups", "n_links")]).add("n_best", "long").add("count_sum", "long").add("groups_sha256", "string")

    def sums(mine: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        slot = pairs.column("slot").to_numpy()
        count[slot], best[slot] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        slots, times = mine.column("slots").combine_chunks(), mine.column("times").combine_chunks()
        at, n = slots.flatten().to_numpy(), times.flatten().to_numpy()
        ends = np.cumsum(np.concatenate([[0], slots.value_lengths().to_numpy()]))
        total = lambda of: np.diff(np.concatenate([[0], np.cumsum(n * of[at])])[ends])
        return pa.Table.from_arrays([*(mine.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")), pa.array(total(best), pa.int64()), pa.array(total(count), pa.int64()), mine.column("groups_sha256")], names=out.names)

    return rows.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(sums, out).withColumnRenamed("id", id_col)


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    """Every document aligned between the byte-level vocabulary and the piece model."""
    import public_tokenizers as P

    return alignment_report(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
