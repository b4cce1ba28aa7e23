"""Phrases against a plain count, with small groups and parts so that prefixes are split."""

import collections
import random
import re

import numpy as np
import pytest

from trialloom.llm import collocations as C

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least=10, top=2000):
    count, size = collections.Counter(), collections.Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang or "und"] += len(words)
            for n in (1, 2, 3):
                count.update((lang or "und", *words[i:i + n]) for i in range(len(words) - n + 1))
    frequent = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in frequent.items():
        if len(words) == 2 and any(b[0] == lang and tuple(words) in (b[1:3], b[2:4]) and 100 * m >= 50 * a for b, m in frequent.items() if len(b) == 4):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = count[(lang, *words[:k])], count[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    rank, got = collections.Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, size[lang], -score))
    return got


def found(df, **options):
    return sorted(tuple(r[c] for c in NAMES) for r in C.collocations(df, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    words = ["the", "of", "and", "The", "a", "é", "漢字", "x-y", "𝔘", " ", "zz"] + [f"w{i}" for i in range(30)]
    weights = [40, 30, 25, 10, 10, 6, 6, 5, 4, 3, 2] + [1] * 30
    rows = []
    for i in range(400):
        text = ""
        for w in rnd.choices(words, weights, k=rnd.randint(1, 60)):
            text += w + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ; ", "!"])
        rows.append((text, ["en", "de", None, "und"][i % 7 % 4]))
    rows += [("New York City is big. ", "en")] * 25 + [("", "en"), (None, None), (" \t\n", "de"), (None, "en")] + [("to be or " * 3000, "de")]
    return rows


@pytest.mark.parametrize("options", [{}, {"group_suffixes": 300, "part_suffixes": 500}, {"group_suffixes": 20, "part_suffixes": 64}])
def test_equal_to_plain_count(spark, rows, options):
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS key", "'clash' AS word", "2 AS n", "3 AS phrase").repartition(5)
    want = sorted(plain(rows))
    assert len(want) > 100 and found(df, **options) == want


def test_top_and_threshold(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(df, least=5, top=7) == sorted(plain(rows, 5, 7))


def test_awkward_and_empty(spark, awkward, nothing):
    want = sorted(plain([(r.text, r.lang) for r in awkward.select("text", "lang").collect()]))
    assert found(awkward) == want
    assert found(nothing) == []


def test_heavy_prefixes_are_complete(spark, rows):
    """Every two-word prefix above the budget is split, none below half of it."""
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("coalesce(text, '') AS text", "coalesce(lang, 'und') AS lang").repartition(4)
    words = C.word_table(df, "text", "lang", 0)
    routes = C.vertical_partition(df, words, 0, 100, 300)
    assert (routes.packed < 0).any() and len(routes.heavy)
    nodes = C.phrase_counts(df, routes, 0, 1, 300).where("k3 = 0").collect()
    keys = lambda c: np.array([r[c] for r in nodes], dtype=np.int64).view(np.uint64)
    split = routes.split(routes.codes(keys("k1")), routes.codes(keys("k2")))
    long = np.isin(keys("k1"), routes.keys[routes.packed < 0])
    f = np.array([r.f for r in nodes])
    assert f[split].min() >= 50 and not split[~long].any()
    following = {}
    for r in C.phrase_counts(df, routes, 0, 1, 300).where("k3 = 0").collect():
        following[(r.k1, r.k2)] = r.f
    assert all(s for s, n, w in zip(split, f, long) if w and n > 100)


def test_tree_blocks_round_trip():
    rnd = np.random.default_rng(0)
    pick = lambda: np.array([0, 1, 2, 65534, 65535, 65536, 1 << 63, (1 << 63) + 5], dtype=np.uint64)[rnd.integers(0, 8, 500)]
    leaves = C._counted(pick(), pick(), pick())
    for x, y in zip(leaves, C._tree_leaves(C._tree_block(*leaves))):
        assert (x == y).all()
