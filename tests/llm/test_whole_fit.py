import numpy as np
from pyspark.sql import functions as F

from trialloom.llm import decontaminate as D


def test_basis_is_fitted_on_every_document(spark, monkeypatch):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text number "), F.col("id").cast("string")).alias("text"))
    bench = spark.createDataFrame([(1, "the text of one item"), (2, "and another item of words")], "item_id long, text string")
    seen = {}

    def counted(passages, vocabulary, idf):
        seen["rows"] = passages.count()
        return np.zeros((D.BUCKETS, D.RANK))

    monkeypatch.setattr(D, "latent_basis", counted)
    D.fit(docs, bench, "doc_id", "text", "text")
    assert seen["rows"] == 5000 + 2


def test_basis_equals_the_dense_decomposition(spark):
    words = [f"w{i}" for i in range(90)]
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(words, n)) for n in (3, 24, 25, 60, 130, 0)]
    rows = spark.createDataFrame([(t, 0.25, False) for t in texts] + [(texts[4], 1.0, True)], "text string, weight double, whole boolean")
    vocabulary = D.benchmark_vocabulary(rows.where("whole"), "text")
    idf = np.linspace(0.5, 2.0, len(vocabulary.hashes))
    gram = np.zeros((D.BUCKETS, D.BUCKETS))
    for r in rows.collect():
        parts = r.text.split()
        for p in [parts] if r.whole else [parts[i:i + D.WINDOW] for i in range(0, len(parts), D.WINDOW)]:
            x, by = np.zeros(D.BUCKETS), {}
            for h in (h for w in p for _, hs, _ in D._words(D.pa.array([w])) for h in hs):
                at = vocabulary.find(np.array([h]))[0]
                b = int(D.bucket_of(np.array([h]))[0])
                by.setdefault(b, idf[at] if at >= 0 else idf.max())
                x[b] += by[b]
            gram += r.weight * np.outer(x, x) / (x @ x)
    values, vectors = np.linalg.eigh(gram)
    basis = D.latent_basis(rows, vocabulary, idf)
    rank = int((values > 1e-9).sum())
    assert rank < D.RANK
    top = vectors[:, -rank:]
    assert np.allclose(basis[:, :rank] @ basis[:, :rank].T, top @ top.T, atol=1e-6)


def test_texts_are_read_once_for_the_basis(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(50).select(F.concat(F.lit("some text number "), F.col("id").cast("string")).alias("text"), F.lit(1.0).alias("weight"), F.lit(False).alias("whole"))
    D.latent_basis(rows.mapInArrow(counted, rows.schema), D.Vocabulary(np.zeros(0, np.uint64)), np.zeros(0))
    assert read.value == 50


def test_sums_of_sparse_rows(monkeypatch):
    monkeypatch.setattr(D, "SUM_ENTRIES", 4)
    rng = np.random.default_rng(5)
    sizes = np.array([1, 9, 3, 4, 2, 1, 1, 17, 3, 5, 1])
    values, rows, matrix = rng.standard_normal(sizes.sum()), rng.integers(0, 6, sizes.sum()), rng.standard_normal((6, 5))
    ends = np.cumsum(sizes)
    dense = np.array([values[e - n:e] @ matrix[rows[e - n:e]] for n, e in zip(sizes, ends)])
    assert np.allclose(D.segment_sums(values, rows.astype(np.uint16), sizes.astype(np.int32), matrix), dense)
    assert D.segment_sums(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), matrix).shape == (0, 5)


def test_texts_are_cut_into_words_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    item = "seven green boats left harbour before stormy weather arrived"
    rows = spark.createDataFrame([(i, f"other text number {i} {item if i % 10 == 0 else ''} and more") for i in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    found = D.matches(rows.mapInArrow(counted, rows.schema), bench).collect()
    assert sorted(r.doc_id for r in found) == [0, 10, 20, 30]
    assert read.value == 40


def test_codes_of_a_large_vocabulary(spark):
    words = [f"w{i}" for i in range(70_000)]
    hashes = np.concatenate([h for _, h, _ in D._words(D.pa.array([" ".join(words)]))])
    rows = spark.createDataFrame([(3, "w1 w2 w69999, w1"), (None, None), (4, "... strange"), (3, "w1 w2 w69999, w1")], "doc_id long, text string").coalesce(1)
    for n in (70_000, 10):
        vocabulary = D.Vocabulary(np.sort(hashes[:n]))
        coded = D.word_codes(rows, "text", vocabulary, ["doc_id"])
        assert D.code_type(vocabulary) == (np.int32 if n == 70_000 else np.uint16)
        assert [r.doc_id for r in coded.collect()] == [3, None, 4, 3]
        total, df = D.document_frequencies(coded, vocabulary)
        at = vocabulary.find(hashes[[1, 2, 69_999]])
        assert total == 4 and df[at[at >= 0]].tolist() == [2] * int((at >= 0).sum()) and df.sum() == 2 * (3 if n == 70_000 else 2)


def test_windows_left_out_early_are_below_every_bound():
    rng = np.random.default_rng(8)
    hashes = np.sort(rng.integers(0, 1 << 62, 120).astype(np.uint64))
    items = D.Items(list(range(9)), [rng.choice(hashes, n) for n in (4, 6, 9, 14, 14, 20, 30, 45, 60)], D.Vocabulary(hashes))
    basis = np.linalg.qr(rng.standard_normal((D.BUCKETS, D.RANK)))[0]
    idf = np.where(rng.random(120) < 0.2, 0.0, rng.uniform(0.5, 3.0, 120))
    m = D.Matcher(items, rng.integers(1, 50, 120), idf, basis)
    counts = np.array([300, 0, 1, 200])
    ids = np.where(rng.random(501) < 0.5, -1, rng.integers(0, 120, 501))
    ids[50:80] = items.vocabulary.find(items.words[6])
    ends = np.cumsum(counts)
    begins = ends - counts
    got = {(r, j, at) for rows, js, first in m.retrieve(ids, begins, ends) for r, j, at in zip(rows.tolist(), js.tolist(), first.tolist())}
    want = set()
    for group, step, length, hits, scaled, _ in m.classes:
        for r, (a, e) in enumerate(zip(begins.tolist(), ends.tolist())):
            for at in range(a, e, step):
                w = ids[at:min(at + length, e)]
                told = w[(w >= 0) & np.append(idf, 0)[w].astype(bool)]
                dot, size = m.latent[told].astype(float).sum(axis=0) @ scaled, np.sqrt(np.where(w >= 0, m.square[w], m.other).sum())
                assert len(told) < hits or (abs(dot - size) > 1e-4).all()  # none is a matter of rounding
                want |= {(r, int(group[k]), at - a) for k in np.flatnonzero(dot >= size)} if len(told) >= hits else set()
    assert got == want and any((r, j) == (0, 6) for r, j, _ in want)


def test_rows_of_the_sparse_matrix_are_small(spark, monkeypatch):
    """Readers take thousands of rows at once, so a row must not grow with the texts looked at together."""
    made, stored = {}, D.stored

    def kept(df, name):
        made[name] = stored(df, name)
        return made[name]

    monkeypatch.setattr(D, "stored", kept)
    texts = spark.range(400).select(F.expr("concat_ws(' ', transform(sequence(1, 300), i -> concat('w', (id * 7 + i * i) % 900)))").alias("text"), F.lit(1.0).alias("weight"), F.lit(False).alias("whole"))
    vocabulary = D.benchmark_vocabulary(texts.limit(3), "text")
    D.latent_basis(texts.coalesce(1), vocabulary, np.ones(len(vocabulary.hashes)))
    rows = made["passages"].collect()
    assert max(len(r.held) for r in rows) <= D.ROW_PASSAGES * D.WINDOW * 8
    assert sum(len(r.sizes) for r in rows) == 4 * 400 * 13  # every window of every text, 13 a text
