"""Language identification: features against a plain count, held-out accuracy, families, awkward tables."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trialloom.llm import language_id as L
from trialloom.llm import shingles as S

DATA = "/root/testdata/sf0.01"


def plain_features(text):
    """Square roots of counts of the n-grams, by n-gram; unit length."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    squeezed = re.sub(rb"[^a-z\x80-\xff]+", b" ", low)
    count = collections.Counter(squeezed[i:i + n] for n in L.ORDERS for i in range(len(squeezed) - n + 1))
    del count[b" "]
    return count


def slot(gram):
    rolled = 0
    for c in gram:
        rolled = (rolled * 257 + c) % (1 << 64)
    return int(S.mix(np.array([(rolled + (len(gram) << 40)) % (1 << 64)], dtype=np.uint64))[0] % L.DIMENSIONS)


def test_features_equal_plain_counts():
    texts = ["The cat, the CAT!", None, "", "12 34", "é", "a", "ab  12  cd", "naïve Straße 漢字 " * 200, "x"]
    data, offsets = S.column_bytes(pa.array(texts, pa.string()))
    got = L.features(data, offsets[:-1], offsets[1:])
    for text, x in zip(texts, got):
        want = collections.Counter()
        for gram, n in plain_features(text).items():
            want[slot(gram)] += n
        size = math.sqrt(sum(want.values()))
        assert {i: pytest.approx(math.sqrt(n) / size, abs=1e-5) for i, n in want.items()} == {int(i): float(x[i]) for i in np.flatnonzero(x)}


def test_machine_separates_and_is_balanced():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(1, 0.5, (300, 5)), rng.normal(-1, 0.5, (20, 5))]).astype(np.float32)
    y = np.array([1] * 300 + [-1] * 20)
    w, bias = L.train_pair(x, y)
    margin = x @ w + bias
    assert (np.sign(margin) == y).mean() > 0.99
    assert L.train_pair(x, np.ones(320))[1] == 0.0


def test_held_out_accuracy_and_fold(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = L.op13_language_id(spark, DATA).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(held) > 200 and np.mean(held) >= 0.98


WORDS = {"nl": "het een van niet zijn", "en": "the and of not with", "de": "der und nicht das mit", "es": "el los que una con", "pt": "não uma com são os", "xx": "qaz wsx edc rfv tgb"}


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang) for i, lang in enumerate(list(WORDS) * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_families_first(small):
    model = L.fit(small, per_language=30)
    assert model.languages == {"germanic": ["de", "en", "nl"], "romance": ["es", "pt"], "only xx": ["xx"]}
    assert len(model.pairs[""]) == 3 and len(model.pairs["germanic"]) == 3 and model.pairs["only xx"] == []
    got = L.identified(small, model).collect()
    assert all(r.lang == r.lang_pred for r in got)
    again = L.fit(small.repartition(7), per_language=30)
    assert [(r.lang_pred, r.score) for r in L.identified(small, again).orderBy("doc_id").collect()] == [(r.lang_pred, r.score) for r in L.identified(small, model).orderBy("doc_id").collect()]


def test_sample_is_bounded_and_of_distinct_texts(spark, small):
    copies = spark.range(500).selectExpr("id AS doc_id", "'the same text' AS text", "'en' AS lang")
    got = L.sample(small.union(copies), "text", "lang", None, 10).collect()
    count = collections.Counter(r.lang for r in got)
    assert set(count) == set(WORDS) and max(count.values()) <= 10 and len({r.text for r in got}) == len(got)


def test_awkward_empty_and_nothing_learnt(spark, small, awkward, nothing):
    model = L.fit(small, per_language=30)
    clash = awkward.selectExpr("*", "'clash' AS lang_pred", "'clash' AS h", "'clash' AS x", "'clash' AS at")
    got = L.identified(clash, model).collect()
    assert len(got) == clash.count() and set(got[0].asDict()) == set(clash.columns)
    for r in got:
        letters = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und" and r.score == 0) if not letters else (r.lang_pred in WORDS and 0 < r.score <= 1)
    assert L.identified(nothing, model).count() == 0
    L.fit(clash)
    none = L.fit(nothing)
    assert {(r.lang_pred, r.score) for r in L.identified(small, none).collect()} == {("und", 0.0)}
    one = L.fit(small.where("lang = 'de'"), per_language=30)
    assert {(r.lang_pred, r.score) for r in L.identified(small, one).collect()} == {("de", 1.0)}
