"""Passages that repeat across documents, inside texts that otherwise differ.

Two kinds of units, both of whole texts:

* Paragraphs (lines of PARAGRAPH_WORDS words or more) by MinHash banding. Bands are tuned for recall at
  the threshold; paragraphs that collide in a band are compared on their full shingle sets inside bounded
  groups (no pairs as rows), and what is similar becomes one class by connected components.
* Passages of PASSAGE_WORDS words, chosen by winnowing: the smallest passage hash of every GAP
  neighbouring positions. Any run of PASSAGE_WORDS + GAP - 1 = 51 words that two documents share, wherever
  it stands in their lines, has a chosen passage in common. These are compared by 128-bit digest.

A digest or band with very many members is reduced by map-side aggregates and met again by a join that
AQE can split; members are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from trialloom.llm import near_dedup as N
from trialloom.llm import shingles as S
from trialloom.llm.base import query, stored, table
from trialloom.llm.components import components

FURTHER = 6             # minima that divide a group too large to compare
PASSAGE_WORDS, GAP = 28, 24
PARAGRAPH_WORDS = 28
SHINGLE, PERCENT = 5, 80
RECALL = 0.99
SPAN_BYTES = 400_000


def tune_bands(similarity: float, recall: float, rows: int = 2) -> int:
    """Bands of ``rows`` minima each that find a pair of that similarity with the wanted probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


BAND_ROWS = 2
BANDS = tune_bands(PERCENT / 100, RECALL, BAND_ROWS)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def winnow(x: np.ndarray, gap: int) -> np.ndarray:
    """Positions that hold the minimum of some ``gap`` neighbouring values."""
    if len(x) <= gap:
        return np.flatnonzero(x == x.min())
    low = sliding(x, gap, np.minimum)  # low[s]: minimum of x[s:s + gap]
    edge = np.zeros(gap - 1, dtype=x.dtype)
    best = sliding(np.concatenate([edge, low, edge]), gap, np.maximum)  # over all windows that hold a position
    return np.flatnonzero(best == x)


def _rolled(hashes: np.ndarray, width: int, salt: int) -> np.ndarray:
    c = S.constants(salt, width)
    out = hashes[: len(hashes) - width + 1] * c[0]
    for j in range(1, width):
        out = out + hashes[j: len(hashes) - width + 1 + j] * c[j]
    return S.mix(out)


def passages(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, start, d1, d2): the winnowed passages of every text, at every place where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.column_bytes(batch.column(1))
            for a, b in S.spans(offsets, SPAN_BYTES):
                hashes, counts = S.word_hashes(data, offsets[a:b], offsets[a + 1:b + 1])
                if len(hashes) < PASSAGE_WORDS:
                    continue
                one, two = _rolled(hashes, PASSAGE_WORDS, 3 << 20), _rolled(hashes, PASSAGE_WORDS, 5 << 20)
                rows, starts, d1, d2, at = [], [], [], [], 0
                for i, m in enumerate(counts.tolist()):
                    if m >= PASSAGE_WORDS:
                        x = one[at: at + m - PASSAGE_WORDS + 1]
                        chosen = winnow(x, GAP)
                        rows.append(np.full(len(chosen), a + i))
                        starts.append(chosen)
                        d1.append(x[chosen])
                        d2.append(two[at + chosen])
                    at += m
                if rows:
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(starts).astype(np.int32)),
                        pa.array(np.concatenate(d1).view(np.int64)), pa.array(np.concatenate(d2).view(np.int64)),
                    ], names=["id", "start", "d1", "d2"])

    return _texts(docs, id_col, text).mapInArrow(run, "id long, start int, d1 long, d2 long")


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))


def _lines(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, line, start word, words, hashes) of the lines of consecutive rows; lines break at \\n."""
    data, offsets = S.column_bytes(column)
    for a, b in S.spans(offsets, SPAN_BYTES):
        lo, hi = offsets[a], offsets[b]
        breaks = np.flatnonzero(data[lo:hi] == 10) + lo + 1
        starts = np.unique(np.concatenate([offsets[a:b][offsets[a:b] < offsets[a + 1:b + 1]], breaks[breaks < hi]]))
        if not len(starts):
            continue
        ends = np.append(starts[1:], hi)
        hashes, counts = S.word_hashes(data, starts, ends)
        row = np.searchsorted(offsets[a:b + 1], starts, side="right") - 1
        first = np.searchsorted(row, row)  # first line of the same row
        before = np.cumsum(counts) - counts
        yield a + row, np.arange(len(row)) - first, before - before[first], counts, hashes


def paragraphs(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line, start, n_words, d1, d2, bands, further) of every paragraph; written out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, line, start, counts, hashes in _lines(batch.column(1)):
                long = np.flatnonzero(counts >= PARAGRAPH_WORDS)
                if not len(long):
                    continue
                sets = S.shingle_sets(hashes, counts, SHINGLE)
                low = S.minhashes([sets[i] for i in long], BANDS * BAND_ROWS + FURTHER)
                further = low[:, BANDS * BAND_ROWS:].view(np.int64)
                low = low[:, :BANDS * BAND_ROWS]
                bands = low[:, 0::2] + low[:, 1::2] * S.constants(7 << 20, 1)[0]
                bands = S.mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                ends = np.cumsum(counts)
                digest = np.array([[(hashes[ends[i] - counts[i]: ends[i]] * S.constants(s, int(counts[i]))).sum() for s in (0, 9 << 20)] for i in long], dtype=np.uint64)
                digest = S.mix(digest + counts[long][:, None].astype(np.uint64)).view(np.int64)
                flat, more = (pa.ListArray.from_arrays(pa.array(np.arange(len(long) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in (bands, further))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row[long])), pa.array(line[long].astype(np.int32)), pa.array(start[long].astype(np.int32)),
                    pa.array(counts[long].astype(np.int32)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), flat, more,
                ], names=["id", "line", "start", "n_words", "d1", "d2", "bands", "further"])

    made = _texts(docs, id_col, text).mapInArrow(run, "id long, line int, start int, n_words int, d1 long, d2 long, bands array<long>, further array<long>")
    return stored(made, "paragraphs")


def paragraph_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(rep, shingles) of the paragraphs ``wanted`` (rep, id, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, line, _, counts, hashes in _lines(batch.column(1)):
                sets = S.shingle_sets(hashes, counts, SHINGLE)
                long = np.flatnonzero(counts >= PARAGRAPH_WORDS)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row[long])), pa.array(line[long].astype(np.int32)),
                    pa.array([sets[i].astype("<u8").tobytes() for i in long], pa.binary()),
                ], names=["id", "line", "shingles"])

    ids = wanted.select(F.col("id").alias("__id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= N.BROADCAST_IDS else ids.hint("shuffle_hash")
    rows = _texts(docs, id_col, text).join(ids, F.col("id") == F.col("__id"), "left_semi")
    made = rows.mapInArrow(run, "id long, line int, shingles binary").join(wanted, ["id", "line"]).select("rep", "shingles")
    return stored(made.dropDuplicates(["rep"]), "paragraph-sets")


def band_groups(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Colliding paragraphs in groups that are small enough to compare, and what is left: (node, rep).

    A group that is too large is divided by each of FURTHER minima that no band has used: a pair of similarity 0.8
    stays together in one of the parts but for a chance of 0.2^FURTHER, unrelated paragraphs part. Parts that are
    still too large hold close paragraphs; they are merged where they share members, and what is left is one group.
    """
    level = reps.select("rep", "n_shingles", F.posexplode("bands").alias("k", "h")).select("rep", "n_shingles", F.xxhash64("k", "h").alias("node"))
    size = lambda df: df.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight")).where("size > 1")
    fits = ((F.col("size") <= N.NODE_DOCS) & (F.col("weight") <= N.NODE_SHINGLES)).alias("fits")
    rows = stored(level.join(size(level).select("node", fits), "node"), "band-groups")
    small, large = rows.where("fits").select("node", "rep"), rows.where("NOT fits")
    if large.isEmpty():
        return small, large.select("node", "rep")
    parts = large.join(reps.select("rep", "further"), "rep").select("rep", "n_shingles", F.posexplode("further").alias("k", "h"), "node").select(
        "rep", "n_shingles", F.xxhash64("node", "k", "h").alias("node"))
    parts = stored(parts.join(size(parts).select("node", fits), "node"), "band-parts")
    stuck = parts.where("NOT fits").select("node", "rep")
    return small.unionByName(parts.where("fits").select("node", "rep")), stuck if stuck.isEmpty() else N.merged_nodes(stored(stuck, "close-parts"))


def similar_paragraphs(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, start, n_words, first_id): paragraphs whose class reaches over more than one document."""
    rows = paragraphs(docs, id_col, text)
    uid = F.xxhash64("d1", "d2")
    reps = stored(rows.groupBy("d1", "d2").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min(F.struct("id", "line")).alias("at"),
        F.first("bands").alias("bands"), F.first("further").alias("further"), F.max("n_words").alias("n_shingles")).withColumn("rep", uid), "paragraph-reps")
    small, large = band_groups(reps)
    large = stored(large, "large-groups")
    wanted = small.select("rep").union(large.select("rep")).distinct().join(reps.select("rep", F.col("at.id").alias("id"), F.col("at.line").alias("line")), "rep")
    sets = paragraph_sets(docs, wanted, id_col, text)
    links = [stored(N.compare(small, None, sets, PERCENT), "paragraph-links")]
    if not large.isEmpty():
        links.append(stored(N.hub_links(large, sets, PERCENT), "paragraph-hub-links"))
        labels = stored(components(N._union(links)), "paragraph-labels")
        links.append(stored(N.compare(N.block_nodes(large, labels, reps), labels, sets, PERCENT), "paragraph-block-links"))
    labels = components(N._union(links))
    named = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = stored(named.select("d1", "d2", "label", "first_id", "last_id"), "paragraph-classes")
    reach = named.groupBy("label").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")).where("first_id < last_id")
    repeated = stored(named.select("d1", "d2", "label").join(reach.select("label", "first_id"), "label"), "repeated-paragraphs")
    return rows.select("id", "start", "n_words", "d1", "d2").join(repeated.drop("label"), ["d1", "d2"]).select("id", "start", "n_words", "first_id")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end, first_id, kept): runs of words that other documents repeat, overlaps merged.

    Positions count words ([^ \\t-\\r]+) from 0, end exclusive. A word goes if a unit over it stands in a
    document of a smaller id as well, and is kept if all units over it stand here first. Runs hold words
    of one decision; ``first_id`` is the smallest id that holds a unit of a removed run, and the document
    itself for a kept one. Repeats inside one document do not count. Null or empty texts and rows without an
    id have no runs; rows that repeat an id are the same document; empty tables give no rows.
    """
    units = passages(docs, id_col, text)
    again = stored(units.groupBy("d1", "d2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
                   .where("first_id < last_id").drop("last_id"), "repeated-passages")
    exact = units.join(again, ["d1", "d2"]).select("id", "start", (F.col("start") + PASSAGE_WORDS).alias("end"), "first_id")
    near = similar_paragraphs(docs, id_col, text).select("id", "start", (F.col("start") + F.col("n_words")).alias("end"), "first_id")
    spans = exact.unionByName(near)
    gone = F.col("first_id") < F.col("id")
    # +1 where a unit starts and -1 where it ends; running sums tell what covers the words up to the next such place
    edges = spans.select("id", gone.alias("gone"), "first_id", F.explode(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("step")))).alias("e"))
    edges = edges.groupBy("id", F.col("e.pos").alias("start")).agg(
        F.sum(F.when(F.col("gone"), F.col("e.step")).otherwise(0)).alias("__gone"), F.sum(F.when(F.col("gone"), 0).otherwise(F.col("e.step"))).alias("__own"),
        F.min(F.when(F.col("gone") & (F.col("e.step") > 0), F.col("first_id"))).alias("first_id"))
    by_start = W.partitionBy("id").orderBy("start")
    so_far = by_start.rowsBetween(W.unboundedPreceding, 0)
    cuts = edges.select("id", "start", F.lead("start").over(by_start).alias("end"), "first_id",
                        F.when(F.sum("__gone").over(so_far) > 0, "gone").when(F.sum("__own").over(so_far) > 0, "own").otherwise("none").alias("__what"))
    cuts = cuts.withColumn("__new", F.when(F.col("__what") == F.lag("__what").over(by_start), 0).otherwise(1))
    runs = cuts.withColumn("__run", F.sum("__new").over(so_far)).where("__what <> 'none'")
    runs = runs.groupBy("id", "__run", (F.col("__what") == "own").alias("kept")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_id").alias("first_id"))
    return runs.select(F.col("id").alias(id_col), "start", "end", F.when(F.col("kept"), F.col("id")).otherwise(F.col("first_id")).alias("first_id"), "kept")


@query("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir):
    """Documents that share passages with others: their runs, and where each was first."""
    runs = repeated_spans(table(spark, sf_dir, "documents"))
    words = F.col("end") - F.col("start")
    return runs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum(words).cast("long").alias("n_words"),
        F.sum(F.when(~F.col("kept"), words).otherwise(0)).cast("long").alias("n_removed_words"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
        F.sort_array(F.collect_set("first_id")).alias("first_docs"))
