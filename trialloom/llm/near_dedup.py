"""Near-duplicate documents by a chosen-path set similarity join.

Documents branch down independent random trees: a node's documents go to the child named by the value
of one chosen minwise token. Two sets with Jaccard similarity s stay together in a step with probability
s, unrelated ones almost never, so nodes shrink quickly; small ones are compared exhaustively on
the full sets. TREES independent trees find a pair of similarity 0.8 with probability 1 - 0.2^TREES.

What keeps this whole and bounded:

* Equal sets are one representative (the smallest id), however many copies there are.
* A node has no pairs as rows. It is at most NODE_DOCS documents and NODE_SHINGLES shingles; a task goes
  through its nodes one by one, counts exact intersections in memory and returns links of a spanning
  forest, at most one row per document.
* Large nodes that do not shrink (close documents throughout) are merged where they share documents, so
  that a close group is compared once and not in every tree. The group is linked to its smallest member.
  What few rows are still outside its main component are compared with it in blocks. If many are, the
  documents share a passage without being similar: they branch on, by their rarest shingles, of which
  two similar sets always have one in common.
* Sketches (64 values of 16 bits) only decide where full sets are needed: a pair is left out below an
  agreement that similar pairs miss with probability under 1e-6. Links are confirmed on full sets.
* Components found by the first trees prune the later ones: a node inside one component is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialloom.llm import shingles as S
from trialloom.llm.base import query, stored, table
from trialloom.llm.components import components

SKETCH = 64           # minwise tokens of 16 bits for branching and screening
TREES = 10            # independent trees; their roots use 64-bit tokens
FIRST_TREES = 2       # trees compared before components prune the others
NODE_DOCS = 1024
NODE_SHINGLES = 1_000_000
STUCK = 0.6           # a large node of which a child has this share is compared as it is
BLOCK_ROWS = 16       # a group of which blocks would copy each member more often than this branches on
ROUND_ROWS = 4        # rows a member that are compared in one round; beyond it a first round prunes the second
RARE_BITS = 22        # counts of shingles by these bits of their hash (16 MB) order them by rarity
BROADCAST_IDS = 2_000_000  # ids (16 MB) that may be sent to every task; beyond that they are joined by shuffle
SCREEN_Z = 5.0        # standard deviations of the sketch below the threshold that a pair may show


def sketch_table(docs: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    """(id, n_shingles, digest, sketch, roots) of each row, from its whole text; written out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in S.text_sets(batch.column(1), k):
                low = S.minhashes(sets, SKETCH)
                sketch, roots = (low >> np.uint64(48)).astype("<u2"), low[:, :TREES].astype("<u8")
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full)], pa.binary()),
                    pa.array([x.tobytes() if f else None for x, f in zip(sketch, full)], pa.binary()),
                    pa.array([x.tobytes() if f else None for x, f in zip(roots, full)], pa.binary()),
                ], names=["id", "n_shingles", "digest", "sketch", "roots"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(run, "id long, n_shingles long, digest binary, sketch binary, roots binary"), "sketches")


def set_table(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    """(rep, shingles): the sorted shingle hashes of the representatives ``wanted`` (rep, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in S.text_sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(sets)),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                ], names=["rep", "digest", "shingles"])

    wanted = stored(wanted, "wanted")
    ids = wanted.select(F.col("rep").alias("__rep"))
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text).alias("text"))
    rows = rows.join(ids, F.col("rep") == F.col("__rep"), "left_semi")
    made = stored(rows.mapInArrow(run, "rep long, digest binary, shingles binary"), "sets")
    # an id that comes twice with different texts has two sets; the digest tells the representative's
    named = wanted.select(F.col("rep").alias("__rep"), F.col("digest").alias("__digest"))
    return made.join(named, (F.col("rep") == F.col("__rep")) & (F.col("digest") == F.col("__digest")), "left_semi").dropDuplicates(["rep"]).select("rep", "shingles")


def grow_trees(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are small enough to compare, and large ones that do not shrink: (tree, node, rep).

    A large node branches at two of its sketch's places. If one child would still hold most of it,
    its documents are close throughout and the node is kept as it is, without children.
    """
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    level = reps.select("rep", "n_shingles", "roots", tree).select(
        "rep", "n_shingles", "tree", F.xxhash64("tree", F.expr("substring(roots, 8 * tree + 1, 8)")).alias("node"),
        F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("above"))
    light = reps.select("rep", "n_shingles", "sketch")
    small, stuck, step, large = [], [], 0, None
    while True:
        sizes = stored(level.groupBy("tree", "node").agg(
            F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight"), F.max("parent").alias("parent"),
            F.max("above").alias("above")).where("size > 1"), f"tree-sizes-{step}")
        if large is not None:
            close = sizes.where(F.col("size") > STUCK * F.col("above")).select("tree", "parent")
            stuck.append(large.join(close.withColumnRenamed("parent", "node"), ["tree", "node"], "left_semi").select("tree", "node", "rep"))
            sizes = sizes.join(close, ["tree", "parent"], "left_anti")
        fits = (F.col("size") <= NODE_DOCS) & (F.col("weight") <= NODE_SHINGLES)
        rows = stored(level.join(sizes.select("tree", "node", "size", fits.alias("fits")), ["tree", "node"]), f"tree-level-{step}")
        small.append(rows.where("fits").select("tree", "node", "rep"))
        large = rows.where("NOT fits")
        if large.isEmpty():
            return _union(small), _union(stuck) if stuck else small[0].limit(0)
        step += 1
        branch = F.explode(F.array(F.lit(0), F.lit(1))).alias("branch")
        apart = F.col("branch") * (F.pmod(F.xxhash64("node"), F.lit(SKETCH - 1)) + 1)  # the two places differ
        at = F.pmod(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SKETCH)) + apart, F.lit(SKETCH)).cast("int")
        level = large.select("tree", "node", "rep", "size", branch).join(light, "rep").withColumn("at", at).select(
            "rep", "n_shingles", "tree", F.xxhash64("node", "at", F.substring("sketch", 2 * F.col("at") + 1, 2)).alias("node"),
            F.col("node").alias("parent"), F.col("size").alias("above"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Column lists of consecutive rows of one node; nodes are bounded, so is what is held."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        nodes = held.column("node").to_numpy()
        cuts = np.flatnonzero(nodes[1:] != nodes[:-1]) + 1
        for a, b in zip([0, *cuts[:-1]], cuts):
            if b - a > 1:
                yield held.slice(a, b - a).to_pydict()
        if len(cuts):
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows > 1:
        yield held.to_pydict()


def screen(nodes: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Rows of ``nodes`` that have a possible partner in their node by sketch and set size."""
    s = percent / 100
    least = SKETCH * s - SCREEN_Z * (SKETCH * s * (1 - s)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _groups(batches):
            sk = np.frombuffer(b"".join(g["sketch"]), dtype="<u2").reshape(-1, SKETCH)
            size = np.array(g["n_shingles"], dtype=np.float64)
            n, alive = len(sk), np.zeros(len(sk), dtype=bool)
            for a in range(0, n, 64):
                same = np.zeros((min(64, n - a), n), dtype=np.int16)
                for t in range(SKETCH):
                    same += sk[a:a + 64, t, None] == sk[None, :, t]
                near = (same >= least) & (np.minimum(size[a:a + 64, None], size) >= s * np.maximum(size[a:a + 64, None], size))
                near[np.arange(near.shape[0]), np.arange(a, a + near.shape[0])] = False
                alive[a:a + 64] = near.any(axis=1)
            out += [(g["tree"][i], g["node"][i], g["rep"][i]) for i in np.flatnonzero(alive)]
            if len(out) > 10_000:
                yield _rows(out, ["tree", "node", "rep"], [pa.int32(), pa.int64(), pa.int64()])
                out = []
        if out:
            yield _rows(out, ["tree", "node", "rep"], [pa.int32(), pa.int64(), pa.int64()])

    light = reps.select("rep", "n_shingles", "sketch")
    return _by_node(nodes.join(light, "rep")).mapInArrow(run, "tree int, node long, rep long")


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def node_links(sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """(label, smaller label) pairs that name what similar sets bring together; rows of one label already are.

    Exact: of every two rows with different labels the intersection is counted on the full sets. Each
    label that is joined to others gets one pair, with the smallest label of its component.
    """
    n = len(sets)
    names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    parent = list(range(len(names)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    own = [names[x] for x in labels]
    if len(names) < 2:
        return []
    if n == 2:
        a, b = sets
        common = len(np.intersect1d(a, b, assume_unique=True))
        return [(max(labels), min(labels))] if 100 * common >= percent * (len(a) + len(b) - common) else []
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, ids = np.unique(flat, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    doc_of = np.repeat(np.arange(n), sizes)[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    main = np.bincount(own).argmax()  # two rows of the main label need no look
    for i in range(n):
        if own[i] == main:
            continue
        mine = ids[bounds[i]:bounds[i + 1]]
        lengths = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(doc_of[at], minlength=n)
        near = np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common))
        for j in near.tolist():
            a, b = root(own[i]), root(own[j])
            if a != b:
                parent[a] = b
    least: dict[int, int] = {}
    for label, i in names.items():
        least[root(i)] = min(label, least.get(root(i), label))
    return [(label, least[root(i)]) for label, i in names.items() if label != least[root(i)]]


def compare(nodes: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between labels, from the rows of the given nodes (node, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _groups(batches):
            full = [np.frombuffer(x, dtype="<u8") for x in g["shingles"]]
            out += node_links(full, g["label"], percent)
            if len(out) > 10_000:
                yield _rows(out, ["a", "b"], [pa.int64(), pa.int64()])
                out = []
        if out:
            yield _rows(out, ["a", "b"], [pa.int64(), pa.int64()])

    peers = W.partitionBy("node")  # bounded, as nodes are
    rows = _labelled(nodes, labels).withColumns({"__lo": F.min("label").over(peers), "__hi": F.max("label").over(peers)})
    rows = rows.where("__lo < __hi").drop("__lo", "__hi").join(sets, "rep")
    return _by_node(rows).mapInArrow(run, "a long, b long")


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.select("node", "rep", F.col("rep").alias("label"))
    known = labels.select(F.col("id").alias("rep"), "label")
    return nodes.select("node", "rep").join(known, "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def hub_links(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each row to the smallest member of its node, confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles").to_pylist(), batch.column("hub_shingles").to_pylist()):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    hub = nodes.groupBy("node").agg(F.min("rep").alias("b"))
    pairs = nodes.select("node", F.col("rep").alias("a")).join(hub, "node").where("a <> b").select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("rep").alias("a"), "shingles"), "a")
    pairs = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("hub_shingles")), "b")
    return pairs.select("a", "b", "shingles", "hub_shingles").mapInArrow(run, "a long, b long")


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that share documents as one (node, rep): a close group meets in many trees, but is compared once."""
    doc = F.xxhash64(F.lit("document"), "rep")
    labels = components(nodes.select(F.col("node").alias("a"), doc.alias("b")))
    return nodes.join(labels.withColumnRenamed("id", "node"), "node").select(F.col("label").alias("node"), "rep").distinct()


def _blocks(n: str, w: str) -> Column:
    """Blocks for n rows of w shingles: two fit into the bounds of a node."""
    return F.ceil(F.greatest(F.col(n) / (NODE_DOCS / 2.5), F.col(w) / (NODE_SHINGLES / 2.5))).cast("int")


def outside_main(nodes: DataFrame, labels: DataFrame | None, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled rows of the nodes with several labels (node, rep, label, n_shingles, main, blocks, opened), and one row a node.

    ``main`` is the label of most rows, ``blocks`` what all rows fill, ``opened`` what the rows of other labels fill.
    """
    rows = _labelled(nodes, labels).join(reps.select("rep", "n_shingles"), "rep")
    by_label = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    info = by_label.groupBy("node").agg(
        F.max_by(F.struct("label", "n", "w"), "n").alias("main"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("k > 1")
    info = info.select("node", F.col("main.label").alias("main"), "n", "w", (F.col("n") - F.col("main.n")).alias("m"), (F.col("w") - F.col("main.w")).alias("v"))
    info = info.select("node", "main", "n", "m", _blocks("n", "w").alias("blocks"), _blocks("m", "v").alias("opened"))
    return rows.join(info, "node"), info


def block_nodes(nodes: DataFrame, labels: DataFrame | None, reps: DataFrame) -> DataFrame:
    """Stuck nodes as bounded groups (node, rep): blocks of the rows outside the main label against blocks of all.

    Rows grow with the members times the number of blocks that the rows outside fill, not with the square of the members.
    """
    return _blocked(outside_main(nodes, labels, reps)[0])


def _blocked(rows: DataFrame) -> DataFrame:
    """``block_nodes`` of the rows that ``outside_main`` gives."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", "node"), F.col("blocks")).cast("int"))
    # rows outside the main label fill blocks of their own, however they are scattered
    pair = F.xxhash64("node", "open", "to").alias("node")
    few = rows.where("label <> main").withColumn("open", F.pmod(F.xxhash64("node", "rep"), F.col("opened")).cast("int"))
    few = few.withColumn("to", F.explode(F.expr("sequence(0, blocks - 1)"))).select(pair, "rep")
    all_of = rows.select("node", "rep", F.explode(F.expr("sequence(0, opened - 1)")).alias("open"), F.col("block").alias("to")).select(pair, "rep")
    return few.unionByName(all_of).distinct()


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets of ``sets`` (rep, shingles) hold a shingle of each hash, by RARE_BITS bits: an array of fixed size.

    It orders shingles by rarity and is at least the true count, so that a count of 1 is exact. Parts are added up by slab.
    """
    slab = 1 << (RARE_BITS - 8)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((256, slab), dtype="<i4")
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(counts.reshape(-1), np.frombuffer(x, "<u8") & np.uint64((1 << RARE_BITS) - 1), 1)
        yield _slabs({i: c for i, c in enumerate(counts) if c.any()})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[i] = counts.get(i, 0) + np.frombuffer(x, "<i4")
        yield _slabs(counts)

    parts = sets.select("shingles").mapInArrow(part, "slab int, counts binary")
    out = np.zeros((256, slab), dtype="<i4")
    for r in parts.repartition("slab").mapInArrow(total, "slab int, counts binary").toLocalIterator():
        out[r.slab] = np.frombuffer(r.counts, "<i4")
    return out.reshape(-1)


def _slabs(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([c.astype("<i4").tobytes() for c in counts.values()], pa.binary())], names=["slab", "counts"])


def rare_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(node, rep, n_shingles): each set under its rarest shingles, as many as it may lack from a similar one and one more.

    Similar sets share at least ``percent`` of the larger one, so in any common order of all shingles the first
    |set| - ceil(percent * |set|) + 1 of both hold a common one. Shingles that no other set holds are left out.
    """
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [np.zeros(0, dtype=np.int64)], []
            for x in batch.column(1).to_pylist():
                x = np.frombuffer(x, "<u8")
                seen = counts.value[x & np.uint64((1 << RARE_BITS) - 1)]
                first = np.lexsort((x, seen))[:len(x) + (-percent * len(x)) // 100 + 1]
                found.append(x[first[seen[first] > 1]].astype(np.int64))
                sizes.append(len(x))
            each = [len(f) for f in found[1:]]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(found)), pa.array(np.repeat(batch.column(0).to_numpy(), each)), pa.array(np.repeat(np.array(sizes, dtype=np.int64), each)),
            ], names=["node", "rep", "n_shingles"])

    return sets.select("rep", "shingles").mapInArrow(run, "node long, rep long, n_shingles long")


def rare_nodes(rows: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``rare_rows`` that hold several labels, once for nodes of equal members: small ones and the rest (tree, node, rep)."""
    named = _labelled(rows, labels)
    sizes = named.join(rows.select("rep", "n_shingles").distinct(), "rep").groupBy("node").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.min("rep").alias("first"), F.max("rep").alias("last"), F.bit_xor(F.xxhash64("rep")).alias("members")).where("lo < hi")
    once = sizes.groupBy("size", "weight", "first", "last", "members").agg(F.min("node").alias("node"))
    fits = ((F.col("size") <= NODE_DOCS) & (F.col("weight") <= NODE_SHINGLES)).alias("fits")
    out = stored(rows.join(once.select("node", fits), "node").select(F.lit(0).alias("tree"), "node", "rep", "fits"), "rare-nodes")
    return out.where("fits").drop("fits"), out.where("NOT fits").drop("fits")


def stuck_links(stuck: DataFrame, links: list[DataFrame], labels: DataFrame, sets: DataFrame, reps: DataFrame, percent: int) -> list[DataFrame]:
    """What is still to link in large groups (node, rep) of which ``links`` gave ``labels``; all similar rows are compared."""
    rows, _ = outside_main(stuck, labels, reps)
    cost = F.col("n") * F.col("opened") + F.col("m") * F.col("blocks")
    rows = stored(rows.withColumn("few", cost <= BLOCK_ROWS * F.col("n")), "stuck-kinds")
    kinds = {r["few"]: r["n"] for r in rows.groupBy("few").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    if True in kinds:
        out.append(stored(compare(_blocked(rows.where("few")), labels, sets, percent), "block-links"))
    if False not in kinds:
        return out
    members = sets.join(rows.where("NOT few").select("rep"), "rep", "left_semi")
    rows = stored(rare_rows(stored(members, "rare-sets"), percent), "rare-rows")
    small, large = rare_nodes(rows, labels)
    alive = stored(screen(small, reps, percent), "rare-screened")
    if alive.count() > ROUND_ROWS * kinds[False]:
        # close rows meet under many shingles, and an eighth of those links most of them
        first = F.pmod(F.xxhash64("node"), F.lit(8)) == 0
        out.append(stored(compare(alive.where(first), labels, sets, percent), "rare-first-links"))
        labels, alive = stored(components(_union([*links, *out])), "rare-labels"), alive.where(~first)
    out.append(stored(compare(alive, labels, sets, percent), "rare-links"))
    if not large.isEmpty():
        rest = stored(merged_nodes(large.select("node", "rep")), "rare-large")
        out.append(stored(compare(block_nodes(rest, labels, reps), labels, sets, percent), "rare-block-links"))
    return out


def classes(docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``docs``.

    A document's set is its distinct k-word shingles (words [^ \\t-\\r]+ after lower-casing A-Z); with
    fewer words, the whole sequence. Documents are linked where 100 * |intersection| >= percent * |union|,
    and component_id is the smallest id reachable. Null and empty texts have no set and no links. Rows
    without an id get a null component and link nothing; rows that repeat an id each count with
    their text. Empty tables give no rows; further columns are not read.
    """
    rows = sketch_table(docs, k, id_col, text)
    with_set = rows.where("digest IS NOT NULL AND id IS NOT NULL")
    reps = stored(with_set.groupBy("digest").agg(
        F.min("id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots")), "representatives")
    small, stuck = grow_trees(reps)
    alive = stored(screen(small, reps, percent), "screened")
    stuck = stored(stuck.select("node", "rep"), "stuck-rows")
    none = stuck.count() == 0
    stuck = stuck if none else stored(merged_nodes(stuck), "stuck")
    wanted = reps.select("rep", "digest").join(alive.select("rep").union(stuck.select("rep")), "rep", "left_semi")
    sets = stored(set_table(docs, wanted, k, id_col, text), "full-sets")
    links = []
    if not none:
        links.append(stored(hub_links(stuck, sets, percent), "hub-links"))
    links.append(stored(compare(alive.where(F.col("tree") < FIRST_TREES), None, sets, percent), "first-links"))
    labels = stored(components(_union(links)), "first-labels")
    more = [stored(compare(alive.where(F.col("tree") >= FIRST_TREES), labels, sets, percent), "more-links")]
    if not none:
        more += stuck_links(stuck, links, labels, sets, reps, percent)
    # rows of one id with different sets are the same document
    twice = stored(with_set.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("id"), "same-ids")
    if twice.count():
        twice = with_set.join(twice, "id", "left_semi").join(reps.select("digest", "rep"), "digest").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
        twice = stored(twice.where("a < b").select("a", "b"), "same-id-links")
        named = twice.select(F.explode(F.array("a", "b")).alias("rep"), F.xxhash64("a", "b").alias("node"))
        more.append(_labelled(named, labels).groupBy("node").agg(F.max("label").alias("a"), F.min("label").alias("b")).select("a", "b"))
    found = reps.select("rep", "digest").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("label"))
    # later links are between labels, so only they are joined to larger ones
    late = stored(_union(more), "later-links")
    if late.count():
        last = components(late).select(F.col("id").alias("label"), F.col("label").alias("last"))
        found = found.join(last, "label", "left").select("digest", F.coalesce("last", "label").alias("label"))
    out = rows.select("id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component the smallest id.

    Rows without an id or without words all stay; rows that repeat a kept id all stay.
    """
    gone = classes(docs, k, percent, id_col, text).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col(id_col) == F.col("__gone"), "left_anti")


@query("op9_near_dedup")
def op9_near_dedup(spark, sf_dir):
    """Every document with the smallest id of its component of near copies."""
    return classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
