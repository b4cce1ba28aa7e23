import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} {i}" for i in range(30_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "Plain text of a few words that says nothing much at all.", "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0),
        (4, " \n\t \n", "en", "b", 5), (5, LONG, "en", "b", 1), (6, LONG, "en", "b", 1), (7, "ONE two", "en", "a", 3), (8, "one TWO", "en", "a", 3),
        (8, "one TWO", "en", "a", 3), (None, "one two", None, None, None), (None, None, None, None, None), (9, "É é 😀   x y", "fr", "c", 7),
    ]
    df = spark.createDataFrame(rows, ROWS)
    for name in ("id", "sha", "run", "ids", "decoded", "shard", "slot", "spans", "score", "rep", "node", "label", "key", "y", "start", "n_tokens", "kept"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
