"""Language identification in two steps: the family first, then the language within its family.

Texts are counts of hashed byte n-grams (one to four bytes, letters only, lower case), square-rooted and scaled
to length one. Both steps are linear support vector machines between two classes, one for every pair: of
families, and of languages of one family. A pair votes with its margin, squashed to a probability; a class
gets the mean of its pairs, so the score of a language is that of its family times its own within it.

The machines are fitted on a bounded sample (SAMPLE_ROWS texts per language, distinct texts, smallest hashes
first); each pair is a task of its own that sees two languages' or two families' share of the sample. Everything
else covers all rows and whole texts. Prediction is map-only; what is broadcast are the weights,
4 * DIMENSIONS bytes for each pair within a family and each pair of families.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trialloom.llm import shingles as S
from trialloom.llm.base import query, stored, table
from trialloom.llm.quality import fold
from trialloom.session import spread

SAMPLE_ROWS = 1_500      # texts per language that the fit sees
DIMENSIONS = 4_096
ORDERS = (1, 2, 3, 4)
SPAN_BYTES, SPAN_ROWS = 250_000, 512   # text looked at together
PASSES, PENALTY = 30, 1e-4

#: Families of languages by their ISO 639 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "iranian": "fa ku ps tg",
    "indic": "hi ur bn pa mr gu ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
    "austronesian": "id ms tl jv",
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def family(lang: str) -> str:
    """The family of a language code, also of one with a region (``pt-BR``)."""
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


def features(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(texts, DIMENSIONS) unit rows of square roots of n-gram counts of whole texts; zeros without letters.

    A run of bytes that are no letters counts as one blank, before and after words alike.
    """
    out = np.zeros((len(lo), DIMENSIONS), dtype=np.float32)
    piece = S._LOWER[data[lo[0]:hi[-1]]] if len(lo) else data[:0]
    if not len(piece):
        return out
    row = np.repeat(np.arange(len(lo), dtype=np.int64), hi - lo)
    letter = _LETTER[piece]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                   # the first of a run of others stays, as a blank
    keep[(lo - lo[0])[lo < hi]] = True
    codes = np.where(letter, piece, 32)[keep].astype(np.uint64)
    row, letter = row[keep], letter[keep]
    rolled, alive = np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * np.uint64(257) + codes[n - 1:]
        alive = row[:m] == row[n - 1:]
        if n == 1:
            alive = alive & letter            # a blank alone says nothing
        if n in ORDERS:
            slot = (S.mix(rolled + np.uint64(n << 40)) % np.uint64(DIMENSIONS)).astype(np.int64)
            at = row[:m][alive] * DIMENSIONS + slot[alive]
            out += np.bincount(at, minlength=out.size).reshape(out.shape).astype(np.float32)
    np.sqrt(out, out=out)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=out, where=size > 0)


def _ranges(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in S.spans(offsets, SPAN_BYTES):
        for at in range(a, b, SPAN_ROWS):
            yield at, min(b, at + SPAN_ROWS)


def train_pair(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge, dual coordinate steps); y is -1 or 1.

    Both classes weigh the same, whatever their sizes. Without rows of both classes: zeros.
    """
    both = (y > 0).sum(), (y < 0).sum()
    w, bias = np.zeros(x.shape[1]), 0.0
    if not all(both):
        return w, bias
    cost = np.where(y > 0, 0.5 / both[0], 0.5 / both[1]) / PENALTY
    lift, alpha = 0.5 / cost, np.zeros(len(y))
    square = (x.astype(np.float64) ** 2).sum(axis=1) + 1.0 + lift
    rng = np.random.default_rng(0)
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(y)):
            step = max(0.0, alpha[i] - (y[i] * (x[i] @ w + bias) - 1 + lift[i] * alpha[i]) / square[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += (step * y[i]) * x[i]
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


@dataclass
class Model:
    """Machines between two families and between two languages of a family, by name."""

    languages: dict[str, list[str]] = field(default_factory=dict)                    # family -> its languages
    pairs: dict[str, list[tuple[str, str]]] = field(default_factory=dict)            # "" (families) or a family -> pairs
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    bias: dict[str, np.ndarray] = field(default_factory=dict)

    def _shares(self, scope: str, names: list[str], x: np.ndarray) -> np.ndarray:
        """(rows, names) probabilities: means over a name's pairs."""
        if len(names) == 1:
            return np.ones((len(x), 1))
        total, place = np.zeros((len(x), len(names))), {n: i for i, n in enumerate(names)}
        margin = x @ self.weights[scope].T + self.bias[scope]
        p = 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))
        for j, (a, b) in enumerate(self.pairs[scope]):
            total[:, place[a]] += p[:, j]
            total[:, place[b]] += 1 - p[:, j]
        return total / total.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = sorted(self.languages)
        if not names:
            return ["und"] * len(x), np.zeros(len(x))
        shares = self._shares("", names, x)
        best = shares.argmax(axis=1)
        langs, score = [""] * len(x), np.zeros(len(x))
        for f, name in enumerate(names):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            mine = self.languages[name]
            inner = self._shares(name, mine, x[rows])
            pick = inner.argmax(axis=1)
            score[rows] = shares[rows, f] * inner[np.arange(len(rows)), pick]
            for r, k in zip(rows.tolist(), pick.tolist()):
                langs[r] = mine[k]
        return langs, np.clip(score, 0, 1)


def sample(docs: DataFrame, text: str, lang: str, usable, per_language: int) -> DataFrame:
    """(text, lang, at): at most ``per_language`` distinct texts of each language, smallest hashes first; ``at`` counts them."""
    rows = docs if usable is None else docs.where(usable)
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    keys = stored(hashed.groupBy("lang", "h").agg(F.lit(1).alias("one")).drop("one"), "language-keys")
    # thin out by hash before ranking: twice the wanted number is left of a large language
    counts = keys.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.col("n"))
    # one row per language; joined on the spot, else all keys of a language would meet in one task
    few = keys.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30))
    few = few.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("h", F.lit(1)), "h"))).where(F.col("at") <= per_language)
    return hashed.join(few.select("lang", "h", "at"), ["lang", "h"]).groupBy("lang", "at").agg(F.min("text").alias("text")).select("text", "lang", "at")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", usable=None, per_language: int = SAMPLE_ROWS) -> Model:
    """Learn from the texts and non-null languages of rows that meet ``usable``; texts without a letter teach nothing."""
    spark = docs.sparkSession

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.column_bytes(batch.column(0))
            for a, b in _ranges(offsets):
                x = features(data, offsets[a:b], offsets[a + 1:b + 1])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "at", "x"])

    rows = stored(sample(docs, text, lang, usable, per_language).mapInArrow(vectors, "lang string, at int, x binary"), "language-sample")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())   # one row per language
    model = Model()
    for name in langs:
        model.languages.setdefault(family(name), []).append(name)
    families = sorted(model.languages)
    model.pairs = {"": list(combinations(families, 2))} | {f: list(combinations(model.languages[f], 2)) for f in families}
    # a family of many languages sends fewer texts of each: a machine sees at most 2 * per_language texts a side
    tasks = [(scope, k, side, one, -(-2 * per_language // len(model.languages[name])) if scope == "" else per_language) for scope, pairs in model.pairs.items() for k, pair in enumerate(pairs) for side, name in zip((1, -1), pair)
             for one in (model.languages[name] if scope == "" else [name])]
    if not tasks:
        return model
    todo = spark.createDataFrame(pd.DataFrame(tasks, columns=["scope", "k", "side", "lang", "most"]), "scope string, k int, side int, lang string, most int")

    def machine(part: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(part["x"]), np.float32).reshape(-1, DIMENSIONS)
        order = np.lexsort((np.array([hash_row(r) for r in x]), part["side"].to_numpy()))
        w, bias = train_pair(x[order], part["side"].to_numpy()[order])
        return pd.DataFrame({"scope": [part["scope"].iloc[0]], "k": [part["k"].iloc[0]], "w": [w.astype(np.float32).tobytes()], "bias": [bias]})

    found = spread(rows.join(todo, "lang").where("at <= most").drop("most", "at"), "scope", "k").groupBy("scope", "k").applyInPandas(machine, "scope string, k int, w binary, bias double")
    got = {(r.scope, r.k): r for r in found.collect()}   # one row per pair
    for scope, pairs in model.pairs.items():
        model.weights[scope] = np.array([np.frombuffer(got[scope, k].w, np.float32) for k in range(len(pairs))]).reshape(-1, DIMENSIONS)
        model.bias[scope] = np.array([got[scope, k].bias for k in range(len(pairs))])
    return model


def hash_row(x: np.ndarray) -> float:
    """A number by which equal rows sort together, so that the fit does not depend on the order of rows."""
    return float(x @ np.cos(np.arange(len(x), dtype=np.float32)))


def identified(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all unless named) plus lang_pred and score (0 to 1).

    `und` with score 0 where the text is null or has no letter, or where nothing was learnt. Columns named
    lang_pred or score are replaced. Rows are judged one by one: repeated rows and ties get equal results
    (of equal shares the first code in alphabetical order of families wins); an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    body = F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).otherwise(F.lit(""))
    kinds = docs.select(*rest).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.column_bytes(batch.column(0))
            for a, b in _ranges(offsets):
                langs, score = held.value.predict(features(data, offsets[a:b], offsets[a + 1:b + 1]))
                blank = offsets[a + 1:b + 1] == offsets[a:b]
                langs = ["und" if e else x for e, x in zip(blank.tolist(), langs)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(langs, pa.string()), pa.array(np.where(blank, 0.0, score))], names=[*rest, "lang_pred", "score"])

    schema = StructType([*kinds, StructField("lang_pred", StringType())]).add("score", "double")
    return docs.select(body.alias("__body"), *rest).mapInArrow(run, schema)


@query("op13_language_id")
def op13_language_id(spark, sf_dir):
    """Language of every document by machines of the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, usable=fold() != 2)
    return identified(docs, model, carry=["doc_id"]).select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")
