"""The corpus operators against brute force, and on awkward tables."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers as P
from trialloom.llm import bpe, components, decontaminate, exact_dedup, near_dedup, pii, quality, sharding, shingles, substring_dedup, token_counts, url_filter
from trialloom.llm.base import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# -- 1: URL filters

def test_url_intervals_and_specific_keys(spark):
    log = spark.createDataFrame([
        ("spam", "a.example.com", "block", 1, "add", 10), ("spam", "a.example.com", "block", 2, "remove", 20), ("spam", "a.example.com", "block", 3, "add", 30),
        ("ok", "www2.a.example.com", "allow", 1, "add", 0), ("spam", "b.org/x", "block", 1, "add", 5), ("spam", "b.org/x", "block", 2, "remove", 5),
        (None, "b.org", "block", 1, "add", 0), ("spam", None, "block", 1, "add", 0), ("spam", "c.org", "block", 1, "add", None),
    ], "list string, key string, action string, seq int, op string, day int")
    seen = spark.createDataFrame([
        (1, "https://A.example.com/p", 9), (2, "https://a.example.com:80/p", 10), (3, "http://www.a.example.com", 20), (4, "http://z.a.example.com/", 31),
        (5, "http://u@www2.a.example.com/", 12), (6, "http://b.org/x/y", 6), (7, None, 12), (8, "not a url", 12), (9, "http://a.example.com", None), (9, "http://a.example.com", None),
    ], "page_id long, url string, day int")
    got = {r.page_id: r.decision for r in url_filter.judge(seen, url_filter.validity(log)).collect()}
    assert got == {1: "none", 2: "block", 3: "none", 4: "block", 5: "allow", 6: "none", 7: "none", 8: "none", 9: "none"}
    assert url_filter.judge(seen.limit(0), url_filter.validity(log)).count() == 0
    assert url_filter.judge(seen, url_filter.validity(log.limit(0))).where("decision = 'none'").count() == 9


# -- 2: personal data

def naive_spans(text):
    out = []
    for kind, rx, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(rx, text or "") if ok(m[0])]
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_equals_naive_scan(spark, awkward):
    rng = random.Random(3)
    bits = ["a@b.c", "x.y@z", "@", "..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+49", "😀", " ", "\n", "_d@e.f", "0000.0.0.1",
            "ab%cd@e-f.g.h", "9" * 19, "-", "+", "7", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(400)] + [(900, "1 " * 30_000), (901, "a" * 100_000 + "@" + "b.c" * 9), (902, "a@b.c " * 5_000), (903, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find_spans(df).collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base] == naive_spans(r.text)
    found = pii.find_spans(awkward)
    assert found.count() == awkward.count() and set(found.columns) == set(awkward.columns)
    assert pii.find_spans(awkward.limit(0)).count() == 0


def test_pii_added_kinds_and_context(spark):
    rows = [(1, "pay to DE89370400440532013000 now"), (2, "pay to DE89370400440532013001 now"), (3, "her SSN is 078-05-1120."), (4, "part 078-05-1120."), (5, "12078-05-1120 ssn")]
    got = {r.doc_id: [(s.kind, s.score) for s in r.spans if not s.base] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("iban", 0.6)], 2: [], 3: [("ssn", 0.6)], 4: [], 5: []}


# -- 3: quality

def test_quality_learns_and_holds_out(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice("the of and then went house garden river walk green tall slowly with from".split()) for _ in range(60)) + "."
    bad = lambda: " | ".join(rng.choice("aa bb $$$ %% ###".split()) for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(1500)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, usable=quality.fold() != 2)
    got = quality.scored(docs, model).collect()
    assert np.mean([(r.score >= 0.7) == bool(r.doc_id % 3) for r in got]) > 0.99
    again = quality.fit(docs.repartition(7), labels, usable=quality.fold() != 2)
    assert np.array_equal(again.tables, model.tables) and np.array_equal(again.pair_tables, model.pair_tables)


def test_quality_pairs_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (1, 0) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_quality_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    model = quality.fit(awkward, labels)
    got = quality.scored(awkward, model)
    assert sorted(got.columns) == sorted(awkward.columns) and got.where("score BETWEEN 0 AND 1").count() == awkward.count()
    empty = quality.fit(nothing, labels.limit(0))
    assert empty.score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert quality.scored(nothing, empty).count() == 0


# -- 4: sharding

def test_hypergeometric_law():
    rng = np.random.default_rng(2)
    draws = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    assert abs(draws.mean() - 6) < 0.05 and abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.1
    big = sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6)
    assert abs(big - 300_000) < 3_000
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    m = sharding.communication_matrix({0: 100, 3: 0, 7: 50}, 4, 1)
    assert {p: int(c.sum()) for p, c in m.items()} == {0: 100, 3: 0, 7: 50}
    assert sorted(sum(m.values()).tolist()) == [37, 37, 38, 38]


def test_shards_are_exact_and_gapless(spark, awkward, nothing):
    got = sharding.shuffle_into_shards(spark.range(5000).repartition(7), 24).collect()
    assert sorted(r.id for r in got) == list(range(5000))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [r.id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(5000))[0, 1]) < 0.06
    odd = sharding.shuffle_into_shards(awkward, 5)
    assert odd.count() == awkward.count() and set(odd.columns) == set(awkward.columns)
    assert sharding.shuffle_into_shards(nothing, 5).count() == 0


# -- 5: byte-level BPE

@pytest.fixture(scope="module")
def ranks():
    return bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())


def test_bpe_equals_the_library_on_random_texts(ranks):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(ranks, P.PATTERN), random.Random(4)
    bits = ["'s", "'", "'re", " ", "  ", "\n", "\t\n ", "the", "The", "é", "ß", "😀", "١٢", "12", "!!", "<|endoftext|>", "a" * 70, " " * 90, " ", " ", "x"]
    for n in (0, 1, 5, 40, 700, 3000):
        for _ in range(20):
            t = "".join(rng.choice(bits) for _ in range(n))
            assert np.frombuffer(codec.encode(t), "<i4").tolist() == enc.encode_ordinary(t)
            assert codec.decode(enc.encode_ordinary(t)) == t.encode()
    for t in ("a" * 5000, "ab" * 3000, " " * 5000, "é" * 3000, "-" * 4097, "".join(rng.choice("abcdefgh") for _ in range(6000))):
        assert np.frombuffer(codec.encode(t), "<i4").tolist() == enc.encode_ordinary(t)


def test_bpe_seams_anywhere(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 3)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 2)
    codec, rng = bpe.Codec(ranks, P.PATTERN), random.Random(6)
    flat = bpe.Codec(ranks, P.PATTERN)
    flat.pieces = flat.find
    flat.piece_tokens = flat.merge
    for _ in range(1500):
        t = "".join(rng.choice("ab'sre  \n!1é") for _ in range(rng.randint(0, 40)))
        assert codec.pieces(t) == flat.find(t)
        assert codec.encode(t) == flat.encode(t)


def test_bpe_round_trip_columns(awkward, nothing):
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    got = bpe.round_trip(awkward, *args)
    assert set(got.columns) == set(awkward.columns)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in got.collect())
    split = bpe.decode_column(bpe.encode_column(awkward, *args), *args)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in split.collect())
    assert bpe.round_trip(nothing, *args).count() == 0


# -- 6: repeated passages

def test_winnowing_never_misses():
    rng = np.random.default_rng(3)
    for n in (1, 5, 24, 25, 300):
        x = rng.integers(0, 50, n).astype(np.uint64)
        chosen = substring_dedup.winnow(x, 24)
        want = {s + k for s in range(max(1, n - 23)) for k, v in enumerate(x[s:s + 24]) if v == x[s:s + 24].min()}
        assert set(chosen.tolist()) == want


def test_repeated_passages_inside_lines(spark, awkward, nothing):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    passage, short = " ".join(word() for _ in range(52)), " ".join(word() for _ in range(20))
    fill = lambda n: " ".join(word() for _ in range(n))
    para = [word() for _ in range(100)]
    edited = para[:50] + ["edit"] + para[51:]
    rows = [(1, f"{fill(30)} {passage} {fill(9)}"), (2, f"{fill(7)} {passage.upper()}"), (3, f"{short} {fill(40)}"), (4, f"{fill(60)} {short}"),
            (5, fill(80) + "\n" + " ".join(para)), (6, " ".join(edited) + "\n" + fill(3)), (7, fill(500)), (8, (fill(30) + " ") * 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(df).collect()}
    assert set(got) == {1, 2, 5, 6} and {i: r.kept for i, r in got.items()} == {1: True, 2: False, 5: True, 6: False}
    assert got[1].start >= 30 and got[1].end <= 82 and (got[6].start, got[6].end) == (0, 100)
    assert {r.doc_id for r in substring_dedup.repeated_spans(awkward).collect()} == {5, 6}
    assert substring_dedup.repeated_spans(nothing).count() == 0


# -- 7: exact duplicates

def test_exact_tree_equals_groups(spark, awkward, nothing):
    want = collections.defaultdict(list)
    for i, t in texts(awkward):
        want[lower(t)].append(i)
    for fan_in in (2, 16):
        for r in exact_dedup.duplicate_report(awkward.repartition(9), fan_in=fan_in).collect():
            group = next(v for t, v in want.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            keep = max((x for x in group if x is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), r.doc_id == keep)
    kept = exact_dedup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(x for x in v if x is not None) for v in want.values())
    assert exact_dedup.duplicate_report(nothing).count() == 0 and exact_dedup.deduplicate(nothing).count() == 0


# -- 8: token counts

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(spark, awkward, nothing, name):
    path = P.path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    extra = spark.createDataFrame([(20, "a <|endoftext|> b<|endoftext|><|endoftext|>"), (21, "it's  'S   ١٢\n\n x")], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(extra)
    cache = scratch_path(spark, "cache")
    got = token_counts.count_tokens(docs, path, cache).collect()
    want = collections.Counter((i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t in texts(docs))
    assert collections.Counter(map(tuple, got)) == want
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == len({t or "" for _, t in texts(docs)}) or n == len({(t or "") for _, t in texts(docs)}) + 1  # a row that comes twice is stored twice
    assert collections.Counter(map(tuple, token_counts.count_tokens(docs, path, cache).collect())) == want
    assert spark.read.parquet(cache).count() == n  # nothing was missing
    assert token_counts.count_tokens(nothing, path, scratch_path(spark, "cache")).count() == 0


# -- 9: near duplicates

def brute_components(rows, k=4, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    label = [i for i, _ in rows]
    changed = True
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(s), x) for (i, _), s, x in zip(rows, sets, label)}


def near_rows(n, copies, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    rows, i = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 20, 60, 120]))]
        for _ in range(rng.choice([1, 1, 2, copies])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("bounds", [(1024, 1_000_000), (6, 400)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, bounds):
    monkeypatch.setattr(near_dedup, "NODE_DOCS", bounds[0])  # the small bounds send groups down all branches
    monkeypatch.setattr(near_dedup, "NODE_SHINGLES", bounds[1])
    rows = near_rows(25, 18, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.classes(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_awkward(spark, awkward, nothing):
    got = near_dedup.classes(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[6].component_id == 5 and by[8].component_id == 7 and by[3].component_id == 3 and by[2].n_shingles == 0
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = near_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 7, 9]
    assert near_dedup.classes(nothing).count() == 0 and near_dedup.keep_one(nothing).count() == 0


def test_shingles_equal_word_tuples():
    rows = ["A b  c\td e", None, "", "x", "same same same same same same", "é É z\x0b1 2 3 4"]
    (_, sets), = shingles.text_sets(pa.array(rows), 4)
    for t, s in zip(rows, sets):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        assert len(s) == (len({tuple(w[i:i + 4]) for i in range(len(w) - 3)}) if len(w) > 3 else bool(w))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (500, 499), (499, 500)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {499: 499, 500: 499}


# -- 10: benchmark items

def test_subsequence_by_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == best[-1][-1]


def test_benchmark_items_are_found(spark, awkward, nothing):
    rng = random.Random(9)
    common = "the of and to in is that it for on".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijkl") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 60)))) for i in range(40)] + [(98, None), (99, "...")]
    rows = []
    for d in range(300):
        w = [word() for _ in range(rng.randint(20, 300))]
        if d < 80:
            item = items[d % 40][1].split()
            if d >= 40:  # paraphrase: a fifth of the words replaced, but not the ending
                item = [word() if rng.random() < 0.2 and j < len(item) - 8 else x for j, x in enumerate(item)]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in item]
        rows.append((d, " ".join(w)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    want = {(d, d % 40) for d in range(80)}
    assert len(want & got) >= 0.95 * len(want) and {d for d, _ in got} <= set(range(80))
    assert {(d, d) for d in range(40)} <= got
    left = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert left == set(range(300)) - {d for d, _ in got}
    assert decontaminate.matches(awkward, bench).count() == 0
    assert decontaminate.clean(awkward, bench).count() == awkward.count() and decontaminate.clean(awkward, bench).columns == awkward.columns
    assert decontaminate.matches(nothing, bench).count() == 0 and decontaminate.clean(awkward, bench.limit(0)).count() == awkward.count()
