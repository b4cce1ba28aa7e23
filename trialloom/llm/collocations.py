"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree of words.

Every word of a piece starts a suffix, cut after DEPTH words. The suffixes are dealt to groups by their
prefixes, so that a group fits a memory budget, and every group builds its own subtree; the counts
of phrases are sums over the leaves below a node.

* Vertical partitioning. A prefix is one word as long as no more suffixes than the budget start
  with it, else two words, else all three. Word frequencies are exact, from a scan that also numbers
  the words; heavy two-word prefixes come from a second scan: each part of the corpus reports the prefixes
  that have at least half the budget's share of its suffixes, so one above the budget cannot stay unreported.
* Groups. Prefixes of frequent words are packed, largest first, onto the group with the least load;
  the rest, and the extended prefixes, are dealt by hash. Groups grow in number, not in size, up to
  MAX_GROUPS; only beyond that many budgets of suffixes does the budget itself grow.
* Subtrees. A part of the corpus sends each group one block: its suffixes as a counted tree (children per
  node, a leaf per distinct suffix), frequent words as 16-bit ranks. A group merges its blocks by one sort
  and sums leaves up to the nodes. A node above a split prefix gets partial sums, added up at the end.

Words are 64-bit keys of language and word. The word table shows whether two words share a key; then
the scans are repeated with other keys, so counts are exact. What is broadcast: the 65,534 most frequent
words' keys and the heavy prefixes, at most 3 * MAX_GROUPS.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from trialloom.llm import shingles as S
from trialloom.llm.base import query, stored, table

DEPTH = 3
GROUP_SUFFIXES = 1_000_000   # suffixes of a group: the memory budget
MAX_GROUPS = 60_000
PART_SUFFIXES = 650_000      # suffixes counted together on the map side; three keys each have to fit 21 bits
RANKED = 65_534              # words with a 16-bit rank

_u = np.uint64
_BITS = _u(21)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True


# -- words of a part of the corpus

def _lang_salt(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")


@dataclass
class Words:
    """Words of consecutive texts: keys, place and length in bytes, language number, and whether the next word is in the same piece."""

    keys: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    lang: np.ndarray
    joined: np.ndarray
    check: np.ndarray  # a second digest, to tell apart words that share a key


def _words(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, langs: list[str], seed: int, names: dict[str, int]) -> Words:
    hashes, counts = S.word_hashes(data, lo, hi, _BETWEEN)
    row = np.repeat(np.arange(len(lo)), counts)
    piece = data[lo[0]:hi[-1]]
    solid = ~_BETWEEN[piece]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = (lo - lo[0])[lo < hi]
    first[edges] = solid[edges]
    before = edges[edges > 0] - 1
    last[before] = solid[before]
    begin = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - begin
    breaks = np.cumsum(_BREAK[piece])
    joined = np.zeros(len(begin), dtype=bool)
    if len(begin) > 1:
        joined[:-1] = (row[1:] == row[:-1]) & (breaks[begin[1:]] == breaks[begin[:-1]])
    salts = np.array([_lang_salt(x, seed) for x in langs], dtype=np.uint64)
    lang = np.array([names.setdefault(x, len(names)) for x in langs], dtype=np.int32)
    keys = S.mix(hashes * S.constants(1 << 23, seed + 1)[seed] + salts[row]) | _u(1 << 63)
    bytes_of = S.constants(1 << 25, 256)[S._LOWER[piece]]
    bytes_of[~solid] = 0
    check = np.add.reduceat(bytes_of, begin) if len(begin) else np.zeros(0, np.uint64)
    return Words(keys, begin + lo[0], length, lang[row], joined, check)


def _parts(batches: Iterator[pa.RecordBatch], seed: int, names: dict[str, int]) -> Iterator[tuple[np.ndarray, Words]]:
    for batch in batches:
        data, offsets = S.column_bytes(batch.column(0))
        langs = batch.column(1).to_pylist()
        for a, b in S.spans(offsets):
            if offsets[b] > offsets[a]:
                yield data, _words(data, offsets[a:b], offsets[a + 1:b + 1], langs[a:b], seed, names)


def _strings(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    at = np.arange(offsets[-1], dtype=np.int64) + np.repeat(begin - offsets[:-1], length)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(S._LOWER[data[at]])))


def word_table(docs: DataFrame, text: str, lang: str, seed: int) -> DataFrame:
    """(key, lang, word, n): all words with their frequency, written out; lower-cased A-Z."""
    body = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple] = []

        def merged() -> Iterator[pa.RecordBatch]:
            keys, at, back = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate([h[1] for h in held])).astype(np.int64)
            words, langs = pa.concat_arrays([h[2] for h in held]), np.concatenate([h[3] for h in held])
            other = np.flatnonzero(np.asarray(pc.not_equal(words, words.take(pa.array(at[back])))))
            if len(other):
                yield clash(keys[back[other]], langs[other], words.take(pa.array(other)))
            yield batch(keys, langs[at], words.take(pa.array(at)), n)

        def batch(keys, langs, words, n) -> pa.RecordBatch:
            of = pa.array(list(names), pa.string()).take(pa.array(langs))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), of, words, pa.array(n)], names=["key", "lang", "word", "n"])

        def clash(keys, langs, words) -> pa.RecordBatch:
            """Rows that show further words of a key; their occurrences are counted elsewhere."""
            return batch(keys, langs, words, np.zeros(len(keys), np.int64))

        size = 0
        for data, w in _parts(batches, seed, names):
            keys, at, back, n = np.unique(w.keys, return_index=True, return_inverse=True, return_counts=True)
            held.append((keys, n, _strings(data, w.begin[at], w.length[at]), w.lang[at]))
            if (other := np.flatnonzero(w.check != w.check[at][back])).size:
                yield clash(w.keys[other], w.lang[other], _strings(data, w.begin[other], w.length[other]))
            size += len(keys)
            if size > PART_SUFFIXES:
                yield from merged()
                held, size = [], 0
        if held:
            yield from merged()

    found = body.mapInArrow(run, "key bigint, lang string, word string, n bigint")
    return stored(found.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")), "words")


# -- vertical partitioning

@dataclass
class Routes:
    """Which group a suffix belongs to."""

    groups: int
    keys: np.ndarray        # keys of ranked words, by rank
    order: np.ndarray       # ranks in the order of their keys
    packed: np.ndarray      # group of a ranked word, -1 if its prefix is longer
    heavy: np.ndarray       # digests of two-word prefixes that are extended to three words

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """1 + rank of ranked words, the key of the others, 0 for no word."""
        if not len(self.keys):
            return keys
        by_key = self.keys[self.order]
        at = np.minimum(np.searchsorted(by_key, keys), len(by_key) - 1)
        return np.where(by_key[at] == keys, self.order[at].astype(np.uint64) + _u(1), keys)

    def key(self, codes: np.ndarray) -> np.ndarray:
        ranked = (codes > 0) & (codes <= _u(len(self.keys)))
        out = codes.copy()
        out[ranked] = self.keys[(codes[ranked] - _u(1)).astype(np.int64)]
        return out

    def split(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """Whether the node (c1, c2) has its leaves in several groups."""
        return np.isin(_digest(c1, c2), self.heavy) if len(self.heavy) else np.zeros(len(c1), dtype=bool)

    def group(self, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray) -> np.ndarray:
        ranked = c1 <= _u(len(self.packed))
        group = np.full(len(c1), -1, dtype=np.int64)
        if len(self.packed):
            group[ranked] = self.packed[(c1[ranked] - _u(1)).astype(np.int64)]
        group[~ranked] = (S.mix(c1[~ranked]) % _u(self.groups)).astype(np.int64)
        long = np.flatnonzero(group < 0)
        if len(long):
            two = _digest(c1[long], c2[long])
            three = np.isin(two, self.heavy)
            group[long] = (np.where(three, S.mix(two + c3[long]), two) % _u(self.groups)).astype(np.int64)
        return group


def _digest(c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    a, b = S.constants(1 << 24, 2)
    return S.mix(c1 * a + c2 * b)


def _suffixes(batches: Iterator[pa.RecordBatch], seed: int, most: int = PART_SUFFIXES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of the first, second and third words of at most ``most`` suffixes; 0 after a piece's end.

    A suffix of one word counts for nothing but its word, whose frequency is known, and is left out.
    """
    held, size = [], 0
    for _, w in _parts(batches, seed, {}):
        k, j = w.keys, w.joined
        two = np.flatnonzero(j)
        if not len(two):
            continue
        more = j[two + 1]  # the last word of all is never joined, so two + 1 exists
        third = np.zeros(len(two), np.uint64)
        third[more] = k[two[more] + 2]
        held.append((k[two], k[two + 1], third))
        size += len(two)
        if size >= most:
            whole = [np.concatenate(x) for x in zip(*held)]
            for at in range(0, size - most + 1, most):
                yield tuple(x[at:at + most] for x in whole)
            rest = size - size % most
            held, size = [tuple(x[rest:] for x in whole)], size - rest
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _counted(k1: np.ndarray, k2: np.ndarray, k3: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct (k1, k2, k3) in order with their counts: the leaves of a tree."""
    keys, local = np.unique(np.concatenate([k1, k2, k3, np.zeros(1, np.uint64)]), return_inverse=True)
    m = len(k1)
    if len(keys) <= 1 << 21:
        local = local.astype(np.uint64)
        packed = (local[:m] << (_BITS + _BITS)) | (local[m:2 * m] << _BITS) | local[2 * m:3 * m]
        if n is None:
            leaves, counts = np.unique(packed, return_counts=True)
        else:
            order = np.argsort(packed)
            packed = packed[order]
            starts = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if m else np.zeros(0, np.int64)
            leaves, counts = packed[starts], np.add.reduceat(n[order], starts) if m else n
        low = _u((1 << 21) - 1)
        return keys[leaves >> (_BITS + _BITS)], keys[(leaves >> _BITS) & low], keys[leaves & low], counts.astype(np.int64)
    order = np.lexsort((k3, k2, k1))
    k1, k2, k3 = k1[order], k2[order], k3[order]
    starts = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (k3[1:] != k3[:-1])]))
    counts = np.diff(np.append(starts, m)) if n is None else np.add.reduceat(n[order], starts)
    return k1[starts], k2[starts], k3[starts], counts.astype(np.int64)


def _turns(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def heavy_prefixes(body: DataFrame, routes: Routes, budget: int, total: int, seed: int, part: int) -> np.ndarray:
    """Digests of two-word prefixes, below words that are split, that may have more than ``budget`` suffixes.

    All with more are among them, and none with less than half; at most 2 * total / budget.
    """
    held = body.sparkSession.sparkContext.broadcast(routes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = held.value
        long = np.sort(routes.keys[routes.packed < 0])
        for k1, k2, _ in _suffixes(batches, seed, part):
            least = len(k1) * budget / (2 * total)
            mine = long[np.minimum(np.searchsorted(long, k1), len(long) - 1)] == k1
            two, n = np.unique(_digest(routes.codes(k1[mine]), routes.codes(k2[mine])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(two[n >= least].view(np.int64)), pa.array(n[n >= least].astype(np.int64))], names=["two", "n"])

    found = body.mapInArrow(run, "two bigint, n bigint").groupBy("two").agg(F.sum("n").alias("n")).where(F.col("n") > budget / 2)
    return np.sort(np.array([r.two for r in found.select("two").collect()], dtype=np.int64).view(np.uint64))


def frequent_words(words: DataFrame, budget: int) -> DataFrame:
    """(key, n): at most RANKED of the most frequent words, all above the budget among them.

    A histogram over sixteenths of powers of two says from which frequency on they are few enough, so no
    task and not the driver sorts the words.
    """
    level = F.floor(16 * F.log2("n"))
    size, least = 0, 1 << 62
    for r in sorted(words.where("n > 0").groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r.level):
        size += r.words
        if size > RANKED:
            break
        least = r.least
    # fewer than total / budget <= MAX_GROUPS words are above the budget
    return words.where(F.col("n") >= min(least, budget + 1)).select("key", "n")


def vertical_partition(body: DataFrame, words: DataFrame, seed: int, group_suffixes: int, part: int) -> Routes:
    """Pack prefixes into groups of about the budget."""
    spark = body.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(group_suffixes, -(-total // MAX_GROUPS))
    top = sorted(((r.n, r.key) for r in frequent_words(words, budget).collect()), key=lambda r: (-r[0], r[1]))  # at most RANKED rows
    groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * total // (2 * budget)))
    keys = np.array([key for _, key in top], dtype=np.int64).view(np.uint64)
    packed = np.full(len(top), -1, dtype=np.int64)
    load = [(0, g) for g in range(groups)]
    for rank, (n, _) in enumerate(top):
        if n <= budget:
            have, g = heapq.heappop(load)
            packed[rank] = g
            heapq.heappush(load, (have + n, g))
    routes = Routes(groups, keys, np.argsort(keys), packed, np.zeros(0, np.uint64))
    if (packed < 0).any():
        routes.heavy = heavy_prefixes(body, routes, budget, total, seed, part)
    return routes


# -- subtrees

def _pack(x: np.ndarray) -> bytes:
    """Values below 65,535 in two bytes, larger ones in eight more."""
    large = x >= _u(0xFFFF)
    return np.uint32(len(x)).tobytes() + np.where(large, _u(0xFFFF), x).astype(np.uint16).tobytes() + x[large].tobytes()


def _unpack(block: memoryview, at: int) -> tuple[np.ndarray, int]:
    n = int(np.frombuffer(block, np.uint32, 1, at)[0])
    x = np.frombuffer(block, np.uint16, n, at + 4).astype(np.uint64)
    large = x == _u(0xFFFF)
    at, m = at + 4 + 2 * n, int(large.sum())
    x[large] = np.frombuffer(block[at:at + 8 * m].tobytes(), np.uint64)
    return x, at + 8 * m


def _tree_block(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, n: np.ndarray) -> bytes:
    """A counted tree: first words, their numbers of children, second words, theirs, third words, leaf counts."""
    one, two = _turns(c1), _turns(c1, c2)
    per_one = np.diff(np.append(np.searchsorted(two, one), len(two))).astype(np.uint64)
    per_two = np.diff(np.append(two, len(c1))).astype(np.uint64)
    return b"".join(map(_pack, (c1[one], per_one, c2[two], per_two, c3, n.astype(np.uint64))))


def _tree_leaves(block: bytes) -> list[np.ndarray]:
    view, at, parts = memoryview(block), 0, []
    for _ in range(6):
        x, at = _unpack(view, at)
        parts.append(x)
    one, per_one, two, per_two, three, n = parts
    per_one, per_two = per_one.astype(np.int64), per_two.astype(np.int64)
    return [np.repeat(np.repeat(one, per_one), per_two), np.repeat(two, per_two), three, n.astype(np.int64)]


def phrase_counts(body: DataFrame, routes: Routes, seed: int, least: int, part: int) -> DataFrame:
    """(k1, k2, k3, f): phrases of two (k3 = 0) and three words that occur ``least`` times, written out."""
    held = body.sparkSession.sparkContext.broadcast(routes)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = held.value
        for suffixes in _suffixes(batches, seed, part):
            c1, c2, c3, n = _counted(*map(routes.codes, suffixes))
            group = routes.group(c1, c2, c3)
            order = np.argsort(group, kind="stable")
            c1, c2, c3, n, group = c1[order], c2[order], c3[order], n[order], group[order]
            starts = _turns(group)
            cuts = zip(starts, np.append(starts[1:], len(group)))
            trees = [_tree_block(c1[a:b], c2[a:b], c3[a:b], n[a:b]) for a, b in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(group[starts]), pa.array(trees, pa.binary())], names=["group", "tree"])

    def subtree(rows: pa.Table) -> pa.Table:
        routes = held.value
        c1, c2, c3, n = _counted_trees([_tree_leaves(t) for t in rows.column("tree").to_pylist()])
        two = _turns(c1, c2)
        inner = np.add.reduceat(n, two) if len(n) else n
        whole = (inner >= least) | routes.split(c1[two], c2[two])
        leaf = (n >= least) & (c3 > 0)
        columns = [np.concatenate([routes.key(c1[two][whole]), routes.key(c1[leaf])]), np.concatenate([routes.key(c2[two][whole]), routes.key(c2[leaf])]),
                   np.concatenate([np.zeros(int(whole.sum()), np.uint64), routes.key(c3[leaf])])]
        return pa.Table.from_arrays([*(pa.array(x.view(np.int64)) for x in columns), pa.array(np.concatenate([inner[whole], n[leaf]]))], names=["k1", "k2", "k3", "f"])

    trees = body.mapInArrow(blocks, "group bigint, tree binary")
    nodes = trees.groupBy("group").applyInArrow(subtree, "k1 bigint, k2 bigint, k3 bigint, f bigint")
    return stored(nodes.groupBy("k1", "k2", "k3").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")


def _counted_trees(leaves: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    c1, c2, c3, n = (np.concatenate(x) for x in zip(*leaves))
    return _counted(c1, c2, c3, n)


# -- scores

def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000, inside: int = 50,
                 group_suffixes: int = GROUP_SUFFIXES, part_suffixes: int = PART_SUFFIXES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the strongest phrases of two and three words per language.

    A phrase counts if it occurs ``least`` times inside pieces; it is dropped where a longer such phrase that
    holds it has at least ``inside`` per cent of its occurrences. Null texts are empty, a null language
    is `und`. Repeated rows count as often as they stand there; an empty table gives no rows; other columns are
    not read. Ties in the rank go to the more frequent, then to the smaller phrase in byte order.
    """
    seed = 0
    while True:
        words = word_table(docs, text, lang, seed)
        if words.groupBy("key").count().where("count > 1").isEmpty():
            break
        seed += 1
    body = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    routes = vertical_partition(body, words, seed, group_suffixes, part_suffixes)
    nodes = phrase_counts(body, routes, seed, least, part_suffixes)
    # a phrase of a given frequency has no rarer word
    known = words.where(F.col("n") >= least)
    word = lambda i: known.select(F.col("key").alias(f"k{i}"), F.col("word").alias(f"w{i}"), F.col("n").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))
    pairs = lambda x, y, f: nodes.where("k3 = 0").select(F.col("k1").alias(x), F.col("k2").alias(y), F.col("f").alias(f))
    longer = nodes.where("k3 <> 0").select(F.explode(F.array(F.struct("k1", "k2", "f"), F.struct(F.col("k2").alias("k1"), F.col("k3").alias("k2"), "f"))).alias("p"))
    longer = longer.groupBy(F.col("p.k1").alias("k1"), F.col("p.k2").alias("k2")).agg(F.max("p.f").alias("longest"))
    both = nodes.where("k3 = 0").join(longer, ["k1", "k2"], "left").where(F.expr(f"longest IS NULL OR 100 * longest < {inside} * f")).drop("longest")
    both = both.join(word(1), "k1").join(word(2), "k2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"),
                                                               F.col("f1").alias("l1"), F.col("f2").alias("r1"), F.lit(None).cast("long").alias("l2"), F.lit(None).cast("long").alias("r2"))
    three = nodes.where("k3 <> 0").join(pairs("k1", "k2", "f12"), ["k1", "k2"]).join(pairs("k2", "k3", "f23"), ["k2", "k3"])
    three = three.join(word(1), "k1").join(word(2), "k2").join(word(3), "k3").select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l1"), F.col("f23").alias("r1"), F.col("f12").alias("l2"), F.col("f3").alias("r2"))
    # decimals of 38 digits: 10^6 a^2 fits for frequencies up to 10^15
    score = lambda i: F.expr(f"(1000000BD * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) div (CAST(l{i} AS DECIMAL(19,0)) * CAST(r{i} AS DECIMAL(19,0)))")
    rows = both.unionByName(three).withColumn("s1", score(1)).withColumn("s2", score(2))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda x: F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1"))
    rows = rows.select("lang", "phrase", "a", pick("l").alias("l"), pick("r").alias("r"), pick("s").alias("score"))
    # first within 64 shares of a language, so that no task sees all phrases of one
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    rows = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("at") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM t),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM s),
u AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM u GROUP BY ALL),
b AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
x AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM c UNION ALL SELECT lang, w2, w3, f FROM c) GROUP BY ALL),
two AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, u1.f AS l, u2.f AS r, 1000000::HUGEINT * b.f * b.f // (u1.f::HUGEINT * u2.f) AS score
  FROM b JOIN u u1 ON b.lang = u1.lang AND b.w1 = u1.w1 JOIN u u2 ON b.lang = u2.lang AND b.w2 = u2.w1
  LEFT JOIN x ON b.lang = x.lang AND b.w1 = x.w1 AND b.w2 = x.w2 WHERE x.f IS NULL OR 100 * x.f < 50 * b.f),
cut AS (SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.f AS a, u1.f AS l1, b2.f AS r1, b1.f AS l2, u3.f AS r2,
  1000000::HUGEINT * c.f * c.f // (u1.f::HUGEINT * b2.f) AS s1, 1000000::HUGEINT * c.f * c.f // (b1.f::HUGEINT * u3.f) AS s2
  FROM c JOIN u u1 ON c.lang = u1.lang AND c.w1 = u1.w1 JOIN u u3 ON c.lang = u3.lang AND c.w3 = u3.w1
  JOIN b b1 ON c.lang = b1.lang AND c.w1 = b1.w1 AND c.w2 = b1.w2 JOIN b b2 ON c.lang = b2.lang AND c.w2 = b2.w1 AND c.w3 = b2.w2),
y AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM cut),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
SELECT lang, rank, phrase, a, l, r, n.n::BIGINT AS n, score::BIGINT AS score FROM z JOIN n USING (lang) WHERE rank <= 2000"""


@query("op12_collocations", ORACLE)
def op12_collocations(spark, sf_dir):
    """The 2,000 strongest phrases of every language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))
