"""Operators on planted corpora against plain-Python versions of their rules."""

import random

import pytest

from trialloom.llm import decontaminate as D, substring_dedup


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for i, y in enumerate(b, 1):
            last, row[i] = row[i], last + 1 if x == y else max(row[i], row[i - 1])
    return row[-1]


def brute_matches(docs, items):
    """{(doc, item): (lcs, answer)} over all windows of one and a half item lengths, a fourth apart."""
    out = {}
    for d, text in docs:
        words = text.lower().replace(",", " ").split()
        for i, item in items:
            item = item.split()
            n = len(item)
            width, step = n + n // 2 + 2, max(1, n // 4)
            for at in range(0, max(1, len(words) - width + 1 + n // 4), step):
                window = words[at:at + width]
                if sum(x in window for x in item) < 0.6 * n:
                    continue
                share, told = lcs(item, window) / n, lcs(item[-8:], window) / len(item[-8:])
                if share >= 0.8 or share >= 0.6 and told >= 0.6:
                    out[d, i] = max(out.get((d, i), (0, 0)), (share, told))
    return out


def planted(seed=21):
    """Items of 4 to 400 words in documents of rare words: verbatim, and with a share of words replaced before the last eight."""
    rng = random.Random(seed)
    common = "the of and to in is that it for on".split()
    word = lambda: rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijkl") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([4, 6, 9, 12, 15, 20, 24, 30, 40, 60, 90, 160, 250, 400])]
    docs = []
    for i, item in items:
        for k, lost in enumerate([0.0, 0.1, 0.2, 0.3, 0.36, 0.45]):
            w, new = [word() for _ in range(rng.randint(60, 200))], item.split()
            for x in rng.sample(range(max(0, len(new) - 8)), min(max(0, len(new) - 8), int(lost * len(new)))):
                new[x] = word()
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in new]
            docs.append((i * 10 + k, " ".join(w)))
    return docs + [(900 + k, " ".join(word() for _ in range(300))) for k in range(60)], items


@pytest.mark.parametrize("block", [20_000, 5])
def test_benchmark_matches_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_ITEMS", block)
    rows, listed = planted()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(listed, "item_id long, text string")
    found = D.matches(docs, bench).collect()
    got = {(r.doc_id, r.item_id): (r.lcs, r.answer) for r in found}
    assert sum(r.by_cosine for r in found) >= 0.9 * len(found)  # recall of the latent retrieval alone
    want = brute_matches(rows, listed)
    assert {(i * 10 + k, i) for i, _ in listed for k in range(4)} <= set(want)
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    assert {r.doc_id for r in D.clean(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    named = bench.selectExpr("concat('item ', item_id) AS item_id", "text")
    assert {(r.doc_id, r.item_id) for r in D.matches(docs, named).collect()} == {(d, f"item {i}") for d, i in want}


# -- 6: repeated passages

def words_of(seed):
    rng = random.Random(seed)
    return lambda n: [" ".join("".join(rng.choice("abcdefghijk") for _ in range(7)) for _ in range(n))][0]


def spans(spark, rows):
    out = {}
    for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out.setdefault(r.doc_id, []).append((r.start, r.end, r.first_id, r.kept))
    return {i: sorted(x) for i, x in out.items()}


def test_every_place_of_a_shared_passage(spark):
    fill = words_of(31)
    passage = fill(60)
    got = spans(spark, [(1, f"{fill(40)} {passage} {fill(40)}"), (2, f"{passage} {fill(50)} {passage} {fill(50)} {passage}"), (3, f"{fill(200)}")])
    assert [len(got[i]) for i in (1, 2)] == [1, 3] and set(got) == {1, 2}
    for (start, end, first, kept), place in zip(got[2], (0, 110, 220)):
        assert place <= start and end <= place + 60 and end - start >= 28 and (first, kept) == (1, False)


def test_first_copy_after_a_shared_header_is_kept(spark):
    fill = words_of(32)
    a, b = fill(80), fill(90)
    got = spans(spark, [(1, f"{a} {fill(60)}"), (5, f"{a} {b} {fill(50)}"), (9, f"{fill(20)} {a} {b}")])
    assert [(first, kept) for _, _, first, kept in got[1]] == [(1, True)]
    (s1, e1, f1, k1), (s2, e2, f2, k2) = got[5]
    assert (f1, k1, f2, k2) == (1, False, 5, True) and s1 <= 23 and 57 <= e1 <= s2 <= 80 and 147 <= e2 <= 170
    assert all((first, kept) == (1, False) for _, _, first, kept in got[9]) and sum(e - s for s, e, _, _ in got[9]) >= 120


def test_runs_of_units_word_by_word(spark, monkeypatch):
    """The sweep over hand-made units against marking every word."""
    rng = random.Random(33)
    units = [(d, s, s + rng.randint(28, 60), rng.choice([x for x in (1, 2, 3, 4) if x <= d])) for d in (1, 2, 3, 4) for s in (rng.randrange(600) for _ in range(14))]
    monkeypatch.setattr(substring_dedup, "similar_paragraphs", lambda *_: spark.createDataFrame([(d, s, e - s, f) for d, s, e, f in units], "id long, start int, n_words int, first_id long"))
    got = {(d, w): kept for d, runs in spans(spark, [(7, "nothing here")]).items() for s, e, _, kept in runs for w in range(s, e)}
    want = {}
    for d, s, e, f in units:
        for w in range(s, e):
            want[d, w] = want.get((d, w), True) and f == d
    assert got == want


# -- 9: large groups of close documents

def test_blocks_grow_with_the_members_when_one_row_is_outside(spark, monkeypatch):
    from trialloom.llm import near_dedup as N

    monkeypatch.setattr(N, "NODE_DOCS", 20)
    made = {}
    for n in (200, 400):
        nodes = spark.range(n).selectExpr("1L AS node", "id AS rep")
        labels = spark.range(n).selectExpr("id", f"if(id = {n - 1}, {n - 1}L, 0L) AS label")
        reps = spark.range(n).selectExpr("id AS rep", "10 AS n_shingles")
        rows = N.block_nodes(nodes, labels, reps).collect()
        made[n] = len(rows)
        with_last = {r.node for r in rows if r.rep == n - 1}
        assert {r.rep for r in rows if r.node in with_last} == set(range(n))
    assert made[400] < 2.5 * made[200]


def shared_passage(n, share, copies, seed=5):
    """Documents that share a passage without being similar, and some near copies among them."""
    fill, rng, rows = words_of(seed), random.Random(seed), []
    common = fill(int(120 * share))
    for i in range(n):
        own = fill(120 - int(120 * share)).split()
        rows.append((len(rows), f"{common} {' '.join(own)}"))
        if i < copies:
            own[rng.randrange(len(own))] = "changed"
            rows.append((len(rows), f"{common} {' '.join(own)}"))
    rng.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("share", [0.7, 0.86])
def test_documents_of_a_shared_passage_branch_on(spark, monkeypatch, share):
    """Rows of the branching grow with the documents, and no link is lost, also where the passage reaches into the rarest shingles."""
    from trialloom.llm import near_dedup as N

    monkeypatch.setattr(N, "NODE_DOCS", 20)
    rows, made, real = shared_passage(90, share, 12), [], N.rare_nodes
    monkeypatch.setattr(N, "rare_nodes", lambda r, labels: made.append(r.count()) or real(r, labels))
    got = {r.doc_id: r.component_id for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    sets = [shingle_set(t.split(), 5) for _, t in rows]
    linked = {(i, j) for j in range(len(rows)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}
    label = reach(len(rows), linked)
    assert got == dict(enumerate(label)) and len(linked) >= 12
    assert made and made[0] < 30 * len(rows)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingle_set(words, k):
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def reach(n, linked):
    """Smallest reachable number of every number below n."""
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in range(n) if (min(i, j), max(i, j)) in linked)]) for i in range(n)]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("limit", [12, 1000])
def test_paragraph_classes_of_large_groups(spark, monkeypatch, limit):
    """Paragraph classes against all pairs: close copies, a chain, and many paragraphs that share half their words."""
    from trialloom.llm import near_dedup as N

    monkeypatch.setattr(N, "NODE_DOCS", limit)
    rng, fill = random.Random(41), words_of(41)
    base, half, lines = fill(80).split(), fill(40), []
    for k in range(40):                       # close: one word of 80 replaced
        w = list(base)
        w[k] = f"changed{k}"
        lines.append(" ".join(w))
    lines += [f"{half} {fill(40)}" for _ in range(40)]
    chain = fill(100).split()
    for k in range(6):                        # neighbours are similar, ends are not
        chain = chain[:95] + fill(5).split() if k % 2 else fill(5).split() + chain[5:]
        lines.append(" ".join(chain))
    lines += [fill(50) for _ in range(30)]
    rng.shuffle(lines)
    sets = [shingle_set(t.split(), 5) for t in lines]
    value = {(i, j): jaccard(sets[i], sets[j]) for j in range(len(lines)) for i in range(j)}
    label = reach(len(lines), {p for p, v in value.items() if v >= 0.8})
    docs = spark.createDataFrame([(i, f"{fill(30)}\n{t}\nshort line") for i, t in enumerate(lines)], "doc_id long, text string")
    found = substring_dedup.similar_paragraphs(docs, "doc_id", "text").where("start = 30").collect()
    got = {r.id: r.first_id for r in found}
    want = {i: x for i, x in enumerate(label) if label.count(x) > 1}
    assert len(want) >= 46 and got == want
    if limit == 12:
        rows = substring_dedup.paragraphs(docs, "doc_id", "text")
        reps = rows.selectExpr("id * 10 + line AS rep", "bands", "further", "n_words AS n_shingles")
        small, large = substring_dedup.band_groups(reps)
        assert 40 <= large.count() <= 60      # the close group once, not once per band
