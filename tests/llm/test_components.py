"""Components of few links take one pass; rounds and that pass agree."""

from __future__ import annotations

import pytest

from trialloom.llm import components as C

CHAIN = [(i + 1, i) for i in range(1, 60)] + [(100, 99), (99, 100), (7, 7), (500, 400), (400, 300)]


@pytest.mark.parametrize("few", [C.FEW_EDGES, 0])
def test_few_links_are_finished_without_rounds(spark, monkeypatch, few):
    steps, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: steps.append(name) or stored(df, name))
    monkeypatch.setattr(C, "FEW_EDGES", few)
    got = {r.id: r.label for r in C.components(spark.createDataFrame(CHAIN, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {99: 99, 100: 99, 300: 300, 400: 300, 500: 300}
    assert steps == ["edges", "few-labels"] if few else len(steps) > 3


def test_no_links(spark):
    assert C.components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []
