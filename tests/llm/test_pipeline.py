"""The stages on a small corpus with planted cases, and the contract of the registered queries."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from trialloom.llm import base

FOLDER = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(base.ORACLES) == {"op1_url_filter", "op2_pii", "op7_exact_dedup", "op12_collocations"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]


def test_stages_take_awkward_and_empty_tables(spark, awkward, nothing):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (awkward.select(plain), nothing.select(plain)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert name == "bpe" or out.columns == plain
            assert out.count() <= docs.count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_pipeline_runs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.run(spark, FOLDER).collect()
    ids = [r.doc_id for r in kept]
    assert len(set(ids)) == len(ids) and set(ids) < {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.n_tokens == len(r.ids) > 0 for r in kept)
