"""Benchmark passages in documents: latent semantic retrieval, then a check of the words themselves.

1. Texts are cut into words once and written out as codes, which the later steps read. Document frequencies of the
   benchmark's words over all documents give their idf weights.
2. A randomised SVD of TF-IDF passages gives every word a latent vector. Passages are the benchmark
   items and the windows of all documents, cut and weighed once and written out as sparse rows; each power step
   is one distributed sum of (passage' * (passage * test matrix)) over them, whose size depends on the hashed
   vocabulary only.
3. Candidates are windows by their latent cosine with an item. Windows are as long as the item's match may be, a
   fourth of that apart, and a window's vector is the difference of two running sums. The bound is
   each item's own: SLACK times the cosine of a window that holds as many of the item's words as a paraphrase
   needs, of their average weight, among other words of average weight. A window's cosine is only computed if
   the best that its words could give, each with the item it suits best, reaches the bound.
4. An index of the items' rarest words adds the candidates that the cosine misses: a window that holds PARAPHRASE of
   an item's words also holds some of its rarest ones. So no match is lost; by_cosine tells which way a match
   was found, and the tests measure the recall of the cosine alone.
5. In the windows of each candidate (one and a half item lengths, a fourth apart) the longest common
   subsequence with the item's words is measured. A match is near-literal, or a paraphrase in which the
   item's closing words (its answer) are found too.

The benchmark is a stated query set: it is taken in blocks of BLOCK_ITEMS, each against all rows. Vocabulary,
frequencies and basis belong to the whole benchmark, so results do not depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

from trialloom.llm import shingles as S
from trialloom.llm.base import query, stored, table
from trialloom.session import checkpoint_dir

RANK = 64                # latent dimensions
OVERSAMPLE = 16
BUCKETS = 4096           # hashed words that the SVD sees
DOC_WINDOWS = 20         # the windows of all documents weigh as much in the SVD as so many a document against the items
WINDOW = 24              # words of a document's passages in the fit of the SVD
RARE_SHARE = 8           # candidates: an item's n rarest words count, n / RARE_SHARE more than a match can lack
LITERAL = 0.8            # share of the item's words in the common subsequence: a match as it is
PARAPHRASE, ANSWER = 0.6, 0.6  # ... a match if this share of the answer is found as well
ANSWER_WORDS = 8
BLOCK_ITEMS = 20_000
COMMON, COMMON_DOCS = 0.1, 20  # words in more than this share of the documents (and so many) have no weight ...
KEPT_WORDS = 8           # ... but the rarest words of an item always do
SLACK = 0.7              # of the cosine bound: room for matches whose words weigh less than the item's average
WIDTH_RATIO = 1.25       # items whose windows differ by less share the windows of the longest
SPAN_BYTES, SPAN_WORDS = 400_000, 65_536  # of texts, and of their codes, looked at together
ROUNDING = 0.999         # of a bound that single precision may miss
ROW_PASSAGES = 8         # in a row of the sparse matrix: readers take thousands of rows at once, whatever their size
SUM_ENTRIES = 1500       # of sparse rows that are multiplied together
SUM_BUCKETS = 64         # whose sums travel as one row
CODES = "__words"        # column of the texts' words

_u = np.uint64


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words per row) of consecutive row ranges."""
    data, offsets = S.column_bytes(column)
    for a, b in S.spans(offsets, SPAN_BYTES):
        yield a, *S.word_hashes(data, offsets[a:b], offsets[a + 1:b + 1], S.PUNCTUATION)


@dataclass
class Vocabulary:
    """The benchmark's words: sorted hashes, looked up through a table of the low bits."""

    hashes: np.ndarray

    def __post_init__(self):
        self.bits = max(12, int(len(self.hashes)).bit_length() + 3)
        low = (self.hashes & _u((1 << self.bits) - 1)).astype(np.int64)
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        self.clash = {}
        for i, b in enumerate(low.tolist()):
            if self.table[b] < 0:
                self.table[b] = i
            else:
                self.clash.setdefault(b, []).append(i)
        self.crowded = np.zeros(len(self.table), dtype=bool)
        self.crowded[list(self.clash)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each word, -1 for words of no item."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        low = (h & _u((1 << self.bits) - 1)).astype(np.int64)
        at = self.table[low]
        out = np.where((at >= 0) & (self.hashes[at] == h), at, -1)
        if self.clash:
            open_ = np.flatnonzero((out < 0) & self.crowded[low])
            if len(open_):
                pos = np.searchsorted(self.hashes, h[open_])
                pos[pos == len(self.hashes)] = 0
                out[open_] = np.where(self.hashes[pos] == h[open_], pos, -1)
        return out


@dataclass
class Items:
    """A block of the benchmark in memory."""

    ids: list
    words: list[np.ndarray]  # word hashes
    vocabulary: Vocabulary


def read_items(rows: list, id_col: str, text: str, vocabulary: Vocabulary | None = None) -> Items:
    """Items with words; ``vocabulary`` is that of the whole benchmark, or else their own."""
    rows = [r for r in rows if r[text]]
    column = pa.array([r[text] for r in rows], pa.string())
    words: list[np.ndarray] = []
    for _, hashes, counts in _words(column):
        words += np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []
    kept = [(r[id_col], w) for r, w in zip(rows, words) if len(w)]
    if vocabulary is None:
        vocabulary = Vocabulary(np.unique(np.concatenate([w for _, w in kept])) if kept else np.zeros(0, np.uint64))
    return Items([i for i, _ in kept], [w for _, w in kept], vocabulary)


def benchmark_vocabulary(benchmark: DataFrame, text: str) -> Vocabulary:
    """All words of the benchmark, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, _ in _words(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes).view(np.int64))], names=["word"])

    found = benchmark.select(F.col(text).alias("text")).mapInArrow(run, "word long").distinct().collect()
    return Vocabulary(np.sort(np.array([r.word for r in found], dtype=np.int64).view(np.uint64)))


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The rows data[cuts[i]:cuts[i + 1]] as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _byte_offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)


def code_type(vocabulary: Vocabulary) -> type:
    """Of a word's code: its index in the vocabulary, or for words of no item the vocabulary's size plus their bucket."""
    return np.uint16 if len(vocabulary.hashes) + BUCKETS <= 1 << 16 else np.int32


def word_codes(rows: DataFrame, text: str, vocabulary: Vocabulary, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and CODES, the codes of all words of each text in bytes; a row per row."""
    held, kind = rows.sparkSession.sparkContext.broadcast(vocabulary), code_type(vocabulary)
    schema = StructType([*(rows.schema[c] for c in carry), StructField(CODES, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            for first, hashes, counts in _words(batch.column(0)):
                at = known.find(hashes)
                data = np.where(at >= 0, at, len(known.hashes) + bucket_of(hashes)).astype(kind)
                words = _binary(data, np.cumsum(np.append(0, counts)))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(counts)) for c in batch.columns[1:]), words], names=schema.names)

    return rows.select(F.col(text).alias("__text"), *carry).mapInArrow(run, schema)


def _codes(column: pa.Array, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, codes, words per row) of consecutive row ranges of word_codes()."""
    offsets = _byte_offsets(column)
    data, size = column.buffers()[2], np.dtype(kind).itemsize
    for a, b in S.spans(offsets, SPAN_WORDS * size):
        n = offsets[b] - offsets[a]
        codes = np.frombuffer(data, dtype=np.uint8)[offsets[a]:offsets[b]].view(kind) if n else np.zeros(0, kind)
        yield a, codes.astype(np.int64), np.diff(offsets[a:b + 1]) // size


def document_frequencies(coded: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of documents, and how many of them hold each word of the vocabulary; ``coded`` as word_codes() gives them."""
    n, kind = len(vocabulary.hashes), code_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs_seen = np.zeros(n, np.int64), 0
        for batch in batches:
            docs_seen += batch.num_rows
            for _, codes, per_row in _codes(batch.column(0), kind):
                row, known = np.repeat(np.arange(len(per_row)), per_row), codes < n
                pairs = np.sort(row[known] * np.int64(n) + codes[known])
                pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
                counts += np.bincount(pairs % max(1, n), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(n), -1)), pa.array(np.append(counts, docs_seen))], names=["word", "n"])

    rows = coded.select(CODES).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(n, np.int64), 0
    for r in rows:  # one row per word of the benchmark
        if r["word"] < 0:
            total = r["n"]
        else:
            df[r["word"]] = r["n"]
    return total, df


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _u(40)).astype(np.int64) % BUCKETS


def _passages(batch: pa.RecordBatch, kind: type, bucket: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """TF-IDF rows of the passages of (CODES, weight, whole) rows: items whole, documents in windows.

    Buckets and values of all passages on end, where each passage starts, and the passages' weights. ``bucket``
    and ``weight`` belong to the codes; the words of a bucket in a passage count as much as the first of them.
    """
    weights, whole = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
    for first, codes, counts in _codes(batch.column(0), kind):
        if not len(codes):
            continue
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
        opens = (place == 0) | ((place % WINDOW == 0) & ~whole[first + row])
        begins, passage = np.flatnonzero(opens), np.cumsum(opens) - 1
        inside = np.arange(len(codes)) - begins[passage]
        bits = int(inside.max()).bit_length()
        keys = np.sort(((passage * BUCKETS + bucket[codes]) << bits) | inside)
        held = keys >> bits
        at = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        n, passage, buckets = np.diff(np.append(at, len(keys))), held[at] // BUCKETS, held[at] % BUCKETS
        values = weight[codes[begins[passage] + (keys[at] & ((1 << bits) - 1))]] * n
        norm = np.sqrt(np.bincount(passage, values * values))
        values = values / np.where(norm > 0, norm, 1.0)[passage]
        yield buckets, values, np.searchsorted(passage, np.arange(len(norm))), weights[first + row[begins]]


def sparse_rows(coded: DataFrame, vocabulary: Vocabulary, idf: np.ndarray) -> DataFrame:
    """The TF-IDF rows of (CODES, weight, whole) as arrays in bytes, ROW_PASSAGES of them in a row; words without weight are left out."""
    other = float(idf.max()) if len(idf) else 1.0  # words of no item are rare for this purpose
    buckets_of, kind = np.concatenate([bucket_of(vocabulary.hashes), np.arange(BUCKETS)]), code_type(vocabulary)
    shared = coded.sparkSession.sparkContext.broadcast((buckets_of, np.concatenate([idf, np.full(BUCKETS, other)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buckets, values, starts, weight in _passages(batch, kind, *shared.value):
                kept = values != 0
                held = np.add.reduceat(kept, starts, dtype=np.int64)
                some = held > 0
                sizes = held[some].astype(np.int32)
                cuts = np.append(np.arange(0, len(sizes), ROW_PASSAGES), len(sizes))
                entries = np.append(0, np.cumsum(sizes, dtype=np.int64))[cuts]
                arrays = (buckets[kept].astype(np.uint16), entries), (values[kept], entries), (sizes, cuts), (weight[some], cuts)
                yield pa.RecordBatch.from_arrays([_binary(*x) for x in arrays], names=["buckets", "held", "sizes", "weights"])

    return coded.select(CODES, "weight", "whole").mapInArrow(run, "buckets binary, held binary, sizes binary, weights binary")


def segment_sums(values: np.ndarray, rows: np.ndarray, sizes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For consecutive segments of ``sizes`` entries, the sum of values * matrix[rows].

    Segments of equal size are multiplied together, about SUM_ENTRIES entries at a time, whose rows of
    ``matrix`` are copied to the same place each time.
    """
    order = np.argsort(sizes, kind="stable")
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    out = np.zeros((len(sizes), matrix.shape[1]))
    copied = np.empty((max(SUM_ENTRIES, *sizes[-1:]) if len(sizes) else 0, matrix.shape[1]))
    for n, first, many in zip(*(x.tolist() for x in np.unique(sizes, return_index=True, return_counts=True))):
        step = max(1, SUM_ENTRIES // max(1, n))
        for a in range(first, first + many, step):
            b = min(first + many, a + step)
            at = (starts[a:b, None] + np.arange(n)).ravel()
            some = np.take(matrix, rows[at], axis=0, out=copied[:len(at)], mode="clip")  # clip: without a buffer of its own
            out[order[a:b]] = np.matmul(values[at].reshape(b - a, 1, n), some.reshape(b - a, n, matrix.shape[1]))[:, 0]
    return out


def latent_basis(passages: DataFrame, vocabulary: Vocabulary, idf: np.ndarray, seed: int = 11, power: int = 2) -> np.ndarray:
    """(BUCKETS, RANK) right singular vectors of the TF-IDF matrix of ``passages``, largest first.

    ``passages`` are rows of (text, weight, whole), or of (CODES, weight, whole) as word_codes() gives them.
    Randomised: an orthonormal basis is drawn and multiplied ``power`` times by the Gram matrix of the
    passages, then projected on it for the small eigenproblem. Every product is summed by Spark.
    """
    sc = passages.sparkSession.sparkContext
    if CODES not in passages.columns:
        passages = word_codes(passages, "text", vocabulary, ["weight", "whole"])
    matrix = stored(sparse_rows(passages, vocabulary, idf), "passages")

    def product(q: np.ndarray, small: bool = False) -> np.ndarray:
        """G q, or if ``small`` q' G q, for which the passages' own products are enough; G is the Gram matrix."""
        width, held = q.shape[1], sc.broadcast(q)
        height = width if small else BUCKETS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            kinds = np.uint16, np.float64, np.int32, np.float64
            for batch in batches:
                ends = [_byte_offsets(c) for c in batch.columns]
                for a, b in S.spans(ends[1], SPAN_WORDS * 8):  # rows on end, looked at together
                    if ends[1][a] == ends[1][b]:
                        continue
                    buckets, values, sizes, weight = (
                        np.frombuffer(c.buffers()[2], np.uint8)[e[a]:e[b]].view(kind) for c, e, kind in zip(batch.columns, ends, kinds))
                    own = segment_sums(values, buckets, sizes, held.value)
                    seen = own * weight[:, None]
                    if small:
                        total += own.T @ seen
                        continue
                    order = np.argsort(buckets, kind="stable")
                    passage = np.repeat(np.arange(len(sizes)), sizes)[order]
                    times = np.bincount(buckets, minlength=BUCKETS)
                    used = np.flatnonzero(times)
                    total[used] += segment_sums(values[order], passage, times[used], seen)
            yield from blocks((b, total[b:b + SUM_BUCKETS]) for b in range(0, height, SUM_BUCKETS) if total[b:b + SUM_BUCKETS].any())

        def blocks(sums) -> Iterator[pa.RecordBatch]:
            for b, block in sums:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([block.tobytes()], pa.binary())], names=["bucket", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, block in zip(*(c.to_pylist() for c in batch.columns)):
                    sums[b] = sums.get(b, 0.0) + np.frombuffer(block)
            yield from blocks(sums.items())

        schema = "bucket long, sums binary"
        summed = matrix.mapInArrow(run, schema).repartition("bucket").mapInArrow(add, schema)
        out = np.zeros((height, width))
        for r in summed.collect():  # at most BUCKETS / SUM_BUCKETS rows
            out[r[0]:r[0] + SUM_BUCKETS] = np.frombuffer(r[1]).reshape(-1, width)
        held.unpersist()
        return out

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, RANK + OVERSAMPLE)))[0]
    for _ in range(power):
        q = np.linalg.qr(product(q))[0]
    values, vectors = np.linalg.eigh((lambda m: (m + m.T) / 2)(product(q, small=True)))
    return (q @ vectors[:, np.argsort(-values)])[:, :RANK]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Matcher:
    """Everything a task needs to search its rows for one block of items."""

    def __init__(self, items: Items, df: np.ndarray, idf: np.ndarray, basis: np.ndarray):
        self.items = items
        self.sizes = np.array([len(w) for w in items.words], dtype=np.int64)
        self.widths = self.sizes + self.sizes // 2 + 2  # a match is not spread over more words than this
        self.steps = np.maximum(1, self.sizes // 4)
        # a match holds at least need of an item's n words, so at least k of the n - need + k rarest, for any k
        self.need = np.array([next(m for m in range(n + 1) if m / n >= PARAPHRASE) for n in self.sizes.tolist()], dtype=np.int64)
        self.least = np.maximum(1, self.sizes // RARE_SHARE)
        index = self.index = [items.vocabulary.find(w) for w in items.words]
        self.lists = [i.tolist() for i in index]
        rare = [i[np.argsort(df[i], kind="stable")[: n - m + k]] for i, n, m, k in zip(index, self.sizes.tolist(), self.need.tolist(), self.least.tolist())]
        flat = np.concatenate([np.zeros(0, np.int64), *rare]).astype(np.int64)
        pairs, self.times = np.unique(flat * max(1, len(rare)) + np.repeat(np.arange(len(rare)), [len(i) for i in rare]), return_counts=True)
        self.holders = pairs % max(1, len(rare))
        used, self.starts, self.held_by = np.unique(pairs // max(1, len(rare)), return_index=True, return_counts=True)
        self.rare_of = np.full(len(items.vocabulary.hashes) + 1, -1)  # the last one stands for words of no item
        self.rare_of[used] = np.arange(len(used))
        self.mark = np.zeros(len(items.vocabulary.hashes) + 1, dtype=bool)
        self.latent = np.asfortranarray(basis[bucket_of(items.vocabulary.hashes)] * idf[:, None], dtype=np.float32)  # running sums read it by dimension
        self.square = idf**2
        self.other = float(self.square[idf > 0].mean()) if (idf > 0).any() else 1.0  # words of no item
        self.telling = np.flatnonzero(idf > 0)
        self._cosine_bounds(index)

    def _cosine_bounds(self, index: list[np.ndarray]) -> None:
        """Latent vectors of items, the least cosine of a match, and the width classes of the search."""
        n = len(index)
        self.vectors = np.zeros((n, self.latent.shape[1]), dtype=np.float32)
        self.bound, self.hits = np.full(n, 2.0), np.ones(n, dtype=np.int64)
        for j, i in enumerate(index):
            v = self.total(i)
            size = float(np.sqrt(v @ v))
            if not size:
                continue                       # only the index can find an item without weight
            self.vectors[j] = v / size
            need, width = int(self.need[j]), int(self.widths[j] + self.steps[j])
            share = need / len(i)
            self.bound[j] = SLACK * share * size / np.sqrt(share * float(self.square[i].sum()) + (width - need) * self.other)
            # of the words that a match holds so many have a weight
            self.hits[j] = max(1, need - int((self.square[i] == 0).sum()))
        self.classes = []
        order = np.argsort(self.widths, kind="stable")
        at = 0
        while at < n:
            end = at
            while end < n and self.widths[order[end]] <= self.widths[order[at]] * WIDTH_RATIO:
                end += 1
            group = order[at:end]
            step, length = int(self.steps[group].min()), int((self.widths[group] + self.steps[group]).max())
            # a window longer than the item's own counts by its own share of the weight; what is left of the bound is the window's
            bound = self.bound[group] * np.sqrt(np.minimum(1.0, (self.widths[group] + self.steps[group]) / length))
            scaled = (self.vectors[group] / bound[:, None]).astype(np.float32).T
            # no item gets more from a word than the one it suits best
            most, many = np.zeros(len(self.latent), dtype=np.float32), max(1, 4_000_000 // max(1, len(self.latent)))
            for a in range(0, len(group), many):
                most = np.maximum(most, (self.latent @ scaled[:, a:a + many]).max(axis=1))
            self.classes.append((group, step, length, int(self.hits[group].min()), scaled, most))
            at = end

    def total(self, ids: np.ndarray) -> np.ndarray:
        """The sum of the latent vectors of words."""
        return np.ascontiguousarray(self.latent[ids]).sum(axis=0)

    def retrieve(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, items, first words) of the windows whose latent cosine reaches an item's bound; ``ids`` as the vocabulary finds them."""
        weight = np.where(ids >= 0, self.square[ids], self.other) if len(self.square) else np.full(len(ids), self.other)
        mass = np.concatenate([[0.0], np.cumsum(weight)])
        telling = (ids >= 0) & (weight > 0)
        before = np.concatenate([[0], np.cumsum(telling)])
        known = ids[telling]
        sums = np.zeros((self.latent.shape[1], len(known) + 1), dtype=np.float32)
        np.cumsum(np.take(self.latent.T, known, axis=1), axis=1, out=sums[:, 1:])
        sizes = ends - begins
        for group, step, length, hits, scaled, most in self.classes:
            per = -(-sizes // step)
            row = np.repeat(np.arange(len(sizes)), per)
            first = begins[row] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * step
            last = np.minimum(first + length, ends[row])
            a, b = before[first], before[last]
            size = np.sqrt(mass[last] - mass[first])
            best = np.concatenate([[0.0], np.cumsum(most[known], dtype=np.float64)])
            some = np.flatnonzero((b - a >= hits) & (best[b] - best[a] >= ROUNDING * size))
            for part in np.array_split(some, max(1, len(some) * len(group) // 2_000_000 + 1)):
                dot = (np.take(sums, b[part], axis=1) - np.take(sums, a[part], axis=1)).T @ scaled
                near = np.flatnonzero(dot >= size[part].astype(np.float32)[:, None])
                w, k = near // len(group), near % len(group)
                yield row[part[w]], group[k], first[part[w]] - begins[row[part[w]]]

    def rare(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, items, cells) that hold enough of an item's rarest words; a cell is as long as a window."""
        none = np.zeros(0, np.int64)
        ids = self.rare_of[ids]
        held = np.flatnonzero(ids >= 0)
        if not len(held):
            return none, none, none
        n = self.held_by[ids[held]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[ids[held]], n)
        j, place = self.holders[at], np.repeat(held, n)
        row = np.searchsorted(ends, place, side="right")
        # words of an item counted in cells of a window's width: a window lies in two neighbouring cells
        cell = (place - begins[row]) // self.widths[j]
        cells = int(cell.max()) + 2
        key, inverse = np.unique((row * len(self.sizes) + j) * cells + cell, return_inverse=True)
        total = np.bincount(inverse, weights=self.times[at])
        both = total.copy()
        both[:-1] += np.where(key[1:] == key[:-1] + 1, total[1:], 0)
        pair, cell = key // cells, key % cells
        able = np.flatnonzero(both >= self.least[pair % len(self.sizes)])
        return pair[able] // len(self.sizes), pair[able] % len(self.sizes), cell[able]

    def search(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        """(row, item index, cosine, lcs share, answer share, first word, found by cosine) of every match.

        ``ids`` are the words of rows on end, as the vocabulary finds them.
        """
        if not len(ids) or not len(self.sizes):
            return
        ends = np.cumsum(counts)
        begins = ends - counts
        places: dict[tuple[int, int, int], bool] = {}
        for rows, items, first in self.retrieve(ids, begins, ends):
            # a match starts within a step of the window's first word; check() looks at two cells
            for start in (first, first + self.steps[items]):
                places.update(dict.fromkeys(zip(rows.tolist(), items.tolist(), (start // self.widths[items]).tolist()), True))
        for place in zip(*(x.tolist() for x in self.rare(ids, begins, ends))):
            places.setdefault(place, False)
        for (r, j, c), latent in places.items():
            found = self.check(j, ids[begins[r]:ends[r]], c)
            if found:
                share, told, first = found
                yield r, j, self.cosine(j, ids[begins[r] + first: min(ends[r], begins[r] + first + self.widths[j])]), share, told, first, latent

    def cosine(self, j: int, at: np.ndarray) -> float:
        """Latent cosine of a window and an item, as a share of the cosine that the item has with itself."""
        item = self.index[j]
        mine, its = self.total(at[at >= 0]), self.total(item)
        length = np.sqrt(np.where(at >= 0, self.square[at], self.other).sum())
        return float(mine @ its / max(its @ its, 1e-12) * np.sqrt(self.square[item].sum()) / max(length, 1e-12))

    def check(self, j: int, ids: np.ndarray, cell: int) -> tuple[float, float, int] | None:
        """(share of the item, share of its answer, first word) of the best matching window that starts in a cell or the one before.

        Windows start at every fourth of the item's length, counted from the start of the text, so what
        matches doesn't depend on where the search looks.
        """
        item, width, step = self.lists[j], int(self.widths[j]), int(self.steps[j])
        lo = -(-max(0, (cell - 1) * width) // step) * step
        last = max(0, len(ids) - width + step)
        near = ids[lo:(cell + 2) * width]
        self.mark[near] = True
        held = np.count_nonzero(self.mark[self.index[j]])  # bounds the subsequence
        self.mark[near] = False
        if held < self.need[j]:
            return None
        words = near.tolist()
        best = None
        for at in range(lo, min((cell + 1) * width, last + 1), step):
            window = words[at - lo:at - lo + width]
            if sum(map(set(window).__contains__, item)) < self.need[j]:
                continue
            share = common_subsequence(item, window) / len(item)
            if share < PARAPHRASE or best and share < best[0]:
                continue
            answer = item[-ANSWER_WORDS:]
            told = common_subsequence(answer, window) / len(answer)
            if (share >= LITERAL or told >= ANSWER) and (not best or (share, told) > best[:2]):
                best = share, told, at
        return best


@dataclass
class Latent:
    """What belongs to the whole benchmark and corpus: vocabulary, document frequencies, weights, basis, the documents' words."""

    vocabulary: Vocabulary
    df: np.ndarray
    idf: np.ndarray
    basis: np.ndarray
    coded: DataFrame


def fit(docs: DataFrame, benchmark: DataFrame, id_col: str | None, text: str, item_text: str) -> Latent:
    """Weights and basis; ``benchmark`` has null texts removed. With ``id_col`` the codes carry the documents' ids."""
    vocabulary = benchmark_vocabulary(benchmark, item_text)
    coded = stored(word_codes(docs, text, vocabulary, [id_col] if id_col else []), "words")
    total, df = document_frequencies(coded, vocabulary)
    idf = np.log((1 + total) / (1 + df)) + 0.1
    common = df > max(COMMON * total, COMMON_DOCS)
    if common.any():
        held = docs.sparkSession.sparkContext.broadcast((vocabulary, df))

        def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, n = held.value
            for batch in batches:
                kept = [np.zeros(0, np.int64)]
                for _, hashes, counts in _words(batch.column(0)):
                    for w in np.split(hashes, np.cumsum(counts)[:-1]):
                        i = np.unique(words.find(w))
                        kept.append(i[np.argsort(n[i], kind="stable")[:KEPT_WORDS]])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(kept)))], names=["word"])

        # at most the words of the benchmark
        spared = benchmark.select(F.col(item_text).alias("text")).mapInArrow(rarest, "word long").distinct().collect()
        common[[r.word for r in spared]] = False
    idf[common] = 0.0
    weight = min(0.5, benchmark.count() / (max(1, total) * DOC_WINDOWS))
    every = coded.select(CODES, F.lit(weight).alias("weight"), F.lit(False).alias("whole"))
    items = word_codes(benchmark, item_text, vocabulary, []).select(CODES, F.lit(1.0).alias("weight"), F.lit(True).alias("whole"))
    passages = items.unionByName(every)
    return Latent(vocabulary, df, idf, latent_basis(passages, vocabulary, idf), coded)


def _matchers(docs: DataFrame, benchmark: DataFrame, id_col: str | None, text: str, item_id: str, item_text: str) -> Iterator:
    """A broadcast matcher for every block of about BLOCK_ITEMS items of the query set, and the codes of ``docs``."""
    sc = docs.sparkSession.sparkContext
    bench = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    latent = fit(docs, bench, id_col, text, "text")
    n = max(1, -(-bench.count() // BLOCK_ITEMS))
    for k in range(n):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        items = read_items(sorted(part, key=lambda r: (str(r.item_id), r.text)), "item_id", "text", latent.vocabulary)
        yield sc.broadcast(Matcher(items, latent.df, latent.idf, latent.basis)), latent.coded


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, cosine, lcs, answer, first_word, by_cosine): every benchmark item found in a document.

    ``lcs`` and ``answer`` are shares of the item's words and of its last words; first_word is where the
    best window starts; by_cosine is false where only the index of rare words led to it. Ids of both tables are of
    any type and may be null. Clean documents give no row. Null or empty texts, items without words and empty
    tables give none; a row of ``docs`` that comes twice gives its matches twice; further columns are
    not read.
    """
    out, item_kind = None, benchmark.schema[item_id].dataType
    item_arrow = to_arrow_type(item_kind)
    schema = StructType([docs.schema[id_col], StructField("item_id", item_kind), *StructType.fromDDL(
        "cosine double, lcs double, answer double, first_word long, by_cosine boolean").fields])
    for matcher, coded in _matchers(docs, benchmark, id_col, text, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            m = matcher.value
            known = len(m.items.vocabulary.hashes)
            kind = code_type(m.items.vocabulary)
            for batch in batches:
                best: dict[tuple[int, int], tuple] = {}
                for at, codes, counts in _codes(batch.column(1), kind):
                    for r, j, *found in m.search(np.where(codes < known, codes, -1), counts):
                        old, rest = best.get((at + r, j)), tuple(found)
                        if old is None or (rest[1:3], -rest[3]) > (old[1:3], -old[3]):
                            best[at + r, j] = (*rest[:4], rest[4] or bool(old and old[4]))
                        elif rest[4] and not old[4]:
                            best[at + r, j] = (*old[:4], True)
                if best:
                    rows = pa.array([r for r, _ in best])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), pa.array([m.items.ids[j] for _, j in best], item_arrow),
                         *(pa.array(c, t) for c, t in zip(zip(*best.values()), [pa.float64()] * 3 + [pa.int64(), pa.bool_()]))],
                        names=schema.names)

        found = coded.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all columns; texts do not move.

    Rows are judged one by one, by the rule of matches(): repeated rows stay or go together, null and empty texts stay,
    texts of any length are searched as a whole, an empty benchmark leaves everything, an empty table stays empty.
    """
    rest, rows = docs.columns, docs
    for matcher, _ in _matchers(docs, benchmark, None, text, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, hashes, counts in _words(batch.column(rest.index(text))):
                    keep = np.ones(len(counts), dtype=bool)
                    for r, *_ in matcher.value.search(matcher.value.items.vocabulary.find(hashes), counts):
                        keep[r] = False
                    yield batch.slice(at, len(counts)).filter(pa.array(keep))

        rows = rows.mapInArrow(run, docs.schema)
    return rows


@query("op10_decontaminate")
def op10_decontaminate(spark, sf_dir):
    """Benchmark items found in documents, with their scores."""
    checkpoint_dir(spark)
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
