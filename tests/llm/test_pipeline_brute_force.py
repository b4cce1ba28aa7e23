"""The pipeline's rows against a plain version of its stages; the quality scores are taken as they are."""

import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from test_brute_force import brute_matches, jaccard, reach, shingle_set
from trialloom.llm import quality


def corpus():
    rng = random.Random(51)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: ". ".join(" ".join(rng.choice(vocabulary) for _ in range(9)).capitalize() for _ in range(n)) + "."
    junk = lambda: " ".join(rng.choice(["BUY!!!", "$$$", "###", "http", "CLICK", "%%%"]) for _ in range(80))
    docs = [(i, prose(rng.randint(6, 14))) for i in range(60)]
    docs += [(60 + i, junk()) for i in range(60)]
    docs += [(200 + i, docs[i][1].upper() if i % 2 else docs[i][1]) for i in range(8)]                   # equal but for case
    for i in range(8, 14):                                                                                # one word appended
        docs.append((200 + i, docs[i][1] + " Appended."))
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(20))) for k in range(5)]
    docs += [(300 + k, f"{prose(4)} {item.capitalize()}. {prose(4)}") for k, item in items[:4]]
    docs += [(400, docs[20][1]), (400, docs[20][1])]                                                      # a row that comes twice
    rng.shuffle(docs)
    labels = [(i, int(i < 60 or i >= 200), 0) for i, _ in docs if i != 400 or rng.random() < 2]
    return docs, items, sorted(set(labels))


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_rows_equal_plain_stages(spark, tmp_path):
    docs, items, labels = corpus()
    table = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), known, usable=quality.fold() != 2)
    score = {(r.doc_id, r.text): r.score for r in quality.scored(table, model).collect()}
    rows = [d for d in docs if score[d] >= quality.ACCEPT]
    assert not any(60 <= i < 120 for i, _ in rows) and sum(i < 60 for i, _ in rows) >= 55
    best = {}
    for i, t in rows:
        best[low(t)] = max(i, best.get(low(t), i))
    rows = sorted({(i, t) for i, t in rows if best[low(t)] == i})
    sets = [shingle_set(low(t).split(), 5) for _, t in rows]
    label = reach(len(rows), {(i, j) for j in range(len(rows)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8})
    near = [d for k, d in enumerate(rows) if label[k] == k]
    assert len(near) < len(rows) < len(docs)
    held = {d for d, _ in brute_matches([(i, t.replace(".", " ")) for i, t in near], items)}
    assert held >= {300, 301, 302, 303}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = sorted((i, len(encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in near if i not in held)
    assert got == want
