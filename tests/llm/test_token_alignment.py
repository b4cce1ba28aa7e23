"""Token alignment against the libraries and a plain count of overlapping ranges."""

import collections
import hashlib
import itertools
import random

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trialloom.llm import token_alignment as T

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(rows):
    """Per row the fields of the report: whole texts, one overlap test per pair of neighbours."""
    first, second, alphabet = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), T.byte_alphabet()
    first.encode_special_tokens = True
    entry = {i: e for e, i in first.get_vocab().items()}
    per, count = [], collections.Counter()
    for _, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        xs = [bytes(alphabet[c] for c in entry[i]) for i in a]
        ys = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(xs) != raw or b"".join(ys) != raw:
            per.append(None)
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, xs))), list(itertools.accumulate(map(len, ys)))
        links, j0 = [], 0
        for i, (x, end) in enumerate(zip(a, ends_a)):
            start = end - len(xs[i])
            while ends_b[j0] <= start:
                j0 += 1
            for j in range(j0, len(b)):
                if ends_b[j] - len(ys[j]) >= end:
                    break
                links.append((x, b[j]))
        cuts = [0, *sorted(set(ends_a) & set(ends_b))]
        of = lambda ids, ends, lo, hi: ",".join(str(i) for i, e in zip(ids, ends) if lo < e <= hi)
        groups = [of(a, ends_a, lo, hi) + "|" + of(b, ends_b, lo, hi) for lo, hi in zip(cuts, cuts[1:])]
        per.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(links)
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (*p[:3], len(p[3]), sum(count[x] == best[x[1]] for x in p[3]), sum(count[x] for x in p[3]), p[4]) for p in per], count


def report(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, *(r[f] for f in FIELDS)) for r in T.alignment_report(df, A, B).collect()))


def expected(rows):
    return sorted((i is None, i or 0, *v) for (i, _), v in zip(rows, plain(rows)[0]))


def test_awkward_rows_equal_plain(spark, awkward, nothing):
    rows = [(r.doc_id, r.text and r.text[:20_000]) for r in awkward.select("doc_id", "text").collect()]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, block string").repartition(3)
    assert report(df) == expected(rows)
    assert T.alignment_report(nothing, A, B).count() == 0 and T.alignment_report(awkward, A, B).count() == awkward.count()


def test_blanks_breaks_specials_and_foreign_letters(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 300)
    rnd = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "\r", "\r\n", " ", "　", "\x1c", "\x85", "a", "B", "'s", "'", "1", "é", "中", "😀", "<s>", "<0x41>", "<|endoftext|>", ".", ");\r", "\x00", "the ", "ﬁ", "́"]
    rows = [(i, "".join(rnd.choice(bits + ["▁"] * (i % 5 == 0)) for _ in range(rnd.randint(1, 40)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = report(df)
    assert got == expected(rows)
    assert sum(r[2] > 0 for r in got) > 500
    counts = {(r.a_id, r.b_id): r["count"] for r in T.linked_ids(df, A, B).collect()}
    assert counts == plain(rows)[1]


def test_groups_as_text_and_text_ids(spark):
    df = spark.createDataFrame([("x", "Unbelievable tokens"), ("y", None)], "name string, body string")
    got = {r.name: r.groups for r in T.alignments(df, A, B, "name", "body").collect()}
    assert got["y"] == "" and all(g.count("|") == 1 for g in got["x"].split(";"))
    assert {r.name: r.n_groups for r in T.alignment_report(df, A, B, "name", "body").collect()} == {"x": got["x"].count(";") + 1, "y": 0}


@pytest.mark.parametrize("a,b,want", [([1, 3, 6], [2, 3, 6], [(3, 2, 2), (6, 3, 3)]), ([4], [1, 2, 4], [(4, 1, 3)])])
def test_common_slices(a, b, want):
    assert T.common_slices(a, b) == want
