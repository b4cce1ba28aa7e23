"""Document quality by a generalised additive model with pairwise interactions.

Boosting goes round the features: each step fits a tree of at most four leaves on one binned feature (or
one pair of features) to the current residuals and adds a small share of it to that feature's lookup
table. What is learnt are tables of bin values, so a score is a sum of table entries, added up for all
rows of a batch at once. Features come from the bytes of whole texts and are the same for any language,
source or id.

The fit sees a bounded sample of labelled rows (SAMPLE_ROWS, smallest hashes first); everything else
covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from trialloom.llm import shingles as S
from trialloom.llm.base import query, table

SAMPLE_ROWS = 20_000   # labelled rows that the fit may see; bounds what reaches the driver
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 120, 40, 0.15, 6
MIN_LEAF = 10          # rows in a leaf
ACCEPT = 0.7
SPAN_BYTES = 400_000

FEATURES = [
    "log_words", "word_length", "longest_word", "short_words", "upper", "digits", "symbols", "stops", "commas", "lines",
    "other_bytes", "distinct_words", "top_word", "repeats", "echo", "capital_words",
]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_SYMBOL = _class(b"#$%&*+/<=>@[\\]^_`{|}~!")
_STOP, _COMMA, _LINE = _class(b".?!"), _class(b",;:"), _class(b"\n")
_HIGH = np.r_[np.zeros(128, np.int64), np.ones(128, np.int64)]


def text_features(column: pa.Array) -> np.ndarray:
    """(rows, len(FEATURES)) of whole texts; an empty or null text has zeros throughout."""
    data, offsets = S.column_bytes(column)
    out = np.zeros((len(column), len(FEATURES)))
    for a, b in S.spans(offsets, SPAN_BYTES):
        lo, hi = offsets[a:b], offsets[a + 1:b + 1]
        hashes, counts = S.word_hashes(data, lo, hi)
        piece = data[lo[0]:hi[-1]]
        sums = {}
        for name, of in (("upper", _UPPER), ("digits", _DIGIT), ("symbols", _SYMBOL), ("stops", _STOP), ("commas", _COMMA), ("lines", _LINE), ("other", _HIGH), ("space", S._SPACE.astype(np.int64))):
            cum = np.concatenate([[0], np.cumsum(of[piece])])
            sums[name] = (cum[hi - lo[0]] - cum[lo - lo[0]]).astype(np.float64)
        size, words = np.maximum(1.0, hi - lo), np.maximum(1.0, counts)
        solid = np.maximum(1.0, size - sums["space"])
        lengths = _word_lengths(piece, lo - lo[0])
        at = np.concatenate([[0], np.cumsum(counts)])
        f = out[a:b]
        f[:, 0] = np.log1p(counts)
        f[:, 1] = solid / words * (counts > 0)
        same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        two = np.concatenate([[False, False], hashes[2:] == hashes[:-2]]) if len(hashes) > 1 else same
        starts = _word_starts(piece, lo - lo[0])
        capital = _UPPER[piece[starts]].astype(bool)
        for i in range(b - a):
            w = slice(at[i], at[i + 1])
            n = at[i + 1] - at[i]
            if not n:
                continue
            _, many = np.unique(hashes[w], return_counts=True)
            f[i, 2] = np.log1p(lengths[w].max())
            f[i, 3] = (lengths[w] <= 3).mean()
            f[i, 11] = len(many) / n ** 0.8
            f[i, 12] = many.max() / n
            f[i, 13] = same[w][1:].sum() / n
            f[i, 14] = two[w][2:].sum() / n
            f[i, 15] = capital[w].mean()
        for j, name in ((4, "upper"), (5, "digits"), (6, "symbols"), (10, "other")):
            f[:, j] = sums[name] / solid
        for j, name in ((7, "stops"), (8, "commas"), (9, "lines")):
            f[:, j] = sums[name] / words
    return out


def _word_starts(piece: np.ndarray, begins: np.ndarray) -> np.ndarray:
    solid = ~S._SPACE[piece]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = begins[begins < len(piece)]
    first[at] = solid[at]
    return np.flatnonzero(first)


def _word_lengths(piece: np.ndarray, begins: np.ndarray) -> np.ndarray:
    solid = ~S._SPACE[piece]
    starts = _word_starts(piece, begins)
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.add.reduceat(solid.astype(np.int64), starts)


@dataclass
class Model:
    """Bin edges per feature and lookup tables of features and pairs of features."""

    base: float
    edges: list[np.ndarray]
    tables: np.ndarray                      # (features, BINS)
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: np.ndarray                 # (pairs, PAIR_BINS, PAIR_BINS)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, e in enumerate(self.edges):
            total += self.tables[j][np.searchsorted(e, x[:, j], side="right")]
        for p, (i, j) in enumerate(self.pairs):
            total += self.pair_tables[p][np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best gain of one cut of a run of bins, and where."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
    gain[(nl < MIN_LEAF) | (nt - nl < MIN_LEAF)] = 0.0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with up to four leaves on one binned feature."""
    parts = [(0, len(g))]
    for _ in range(2):
        nxt = []
        for a, b in parts:
            gain, k = _cut(g[a:b], h[a:b], n[a:b])
            nxt += [(a, a + k), (a + k, b)] if gain > 0 else [(a, b)]
        parts = nxt
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one axis and then each side along the other."""
    best, values = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b, c = (m if axis == 0 else m.T for m in (g, h, n))
        for k in range(1, a.shape[0]):
            out, gain = np.zeros_like(a), -a.sum() ** 2 / (b.sum() + 1)
            for rows in (slice(0, k), slice(k, None)):
                ga, ha, na = a[rows].sum(axis=0), b[rows].sum(axis=0), c[rows].sum(axis=0)
                _, at = _cut(ga, ha, na)
                for cols in ((slice(0, at), slice(at, None)) if at else (slice(None),)):
                    gs, hs = ga[cols].sum(), ha[cols].sum()
                    gain += gs**2 / (hs + 1)
                    out[rows, cols] = gs / (hs + 1)
            if gain > best:
                best, values = gain, out if axis == 0 else out.T
    return best, values


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of feature tables, then of the pairs with the largest gain.

    Without rows of both labels the model is a constant: the share of label 1, or a half.
    """
    k = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    edges, pair_edges = [_edges(x[:, j], BINS) for j in range(k)], [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    model = Model(float(np.log(share / (1 - share))), edges, np.zeros((k, BINS + 1)), [], pair_edges, np.zeros((0, PAIR_BINS, PAIR_BINS)))
    if not 0 < y.sum() < len(y):
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    total = np.full(len(y), model.base)

    def residuals():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = residuals()
            m = len(edges[j]) + 1
            step = RATE * _tree(*(np.bincount(bins[j], w, m) for w in (g, h, np.ones(len(y)))))
            model.tables[j, :m] += step
            total += step[bins[j]]
    square = lambda i, j, w: np.bincount(coarse[i] * PAIR_BINS + coarse[j], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = residuals()
    gains = sorted(((_quadrants(*(square(i, j, w) for w in (g, h, np.ones(len(y)))))[0], i, j) for i in range(k) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for p, (i, j) in enumerate(model.pairs):
            g, h = residuals()
            step = RATE * _quadrants(*(square(i, j, w) for w in (g, h, np.ones(len(y)))))[1]
            model.pair_tables[p] += step
            total += step[coarse[i], coarse[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", usable=None) -> Model:
    """Learn from labelled documents; ``usable`` is a condition on the id column that training rows meet.

    Ids with several labels, or null ones, teach nothing wrong: null labels are left out and
    each row counts. Labels are 0 or 1.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    if usable is not None:
        rows = rows.where(usable)
    # TakeOrdered: the sample is at most SAMPLE_ROWS pairs of integers, which bounds the broadcast
    sample = rows.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("__id"), "y").limit(SAMPLE_ROWS)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("__id")).select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = text_features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(f), pa.list_(pa.float64()))], names=["y", "x"])

    rows = picked.mapInArrow(run, "y int, x array<double>").collect()  # at most SAMPLE_ROWS unless ids repeat
    rows.sort(key=lambda r: (r["x"], r["y"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    return train(x, np.array([r["y"] for r in rows], dtype=np.float64))


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all unless named) plus ``out``: 0 to 1, higher for better texts.

    Null and empty texts get the score of a text without words. A column named like ``out`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in (docs.columns if carry is None else carry) if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = held.value.score(text_features(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], names=[*rest, out])

    schema = docs.select(*rest).schema
    return docs.select(F.col(text).alias("__text"), *rest).mapInArrow(run, type(schema)(schema.fields[:]).add(out, DoubleType()))


def fold(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4


@query("op3_quality")
def op3_quality(spark, sf_dir):
    """Quality score of every document by a model of the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, usable=fold() != 2)
    return scored(docs, model, carry=["doc_id"]).select(
        "doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
