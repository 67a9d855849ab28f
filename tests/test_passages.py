"""Passages found by walks that tasks hold, against walks that go round by round."""

import random

import pytest

from tidemark.operators import memory_graph as G


def inputs(spark, chunks):
    rng = random.Random(chunks)
    words = ["ann", "tovik", "red box", "long table", "stairs", "bag", "", "kite", "noon"]
    rows = {(f"c{c}", rng.choice(words), rng.choice(["takes", "leaves"]), rng.choice(words[: 3 + c % 7])) for c in range(chunks) for _ in range(1 + c % 3)}
    # passages without a phrase, passages alike, two that nothing else is joined to
    rows |= {("bare", "", "takes", "")} | {(f"same{k}", "ann", "takes", "noon") for k in range(30)} | {("far1", "xa", "xb", "xc"), ("far2", "xa", "xb", "xc")}
    facts = spark.createDataFrame(sorted(rows), "chunk string, s string, p string, o string").repartition(5)
    passages = facts.groupBy("chunk").agg({"s": "max", "o": "max"}).toDF("chunk", "a", "b").selectExpr("chunk", "concat_ws(' ', a, b) AS text")
    asked = [(1, "Who takes the red box"), (2, "Who takes the red box"), (3, "ann noon"), (4, ""), (5, "xa xb xc"), (6, "stairs"), (6, "kite bag")]
    return facts, passages, G.phrase_lines(facts), spark.createDataFrame(asked, "query bigint, text string")


@pytest.mark.parametrize("chunks", [0, 60])
def test_held_walks_rest_where_rounds_do(spark, monkeypatch, chunks):
    given = inputs(spark, chunks)
    rows = lambda: {(r["query"], r["rank"]): (r["chunk"], round(r["score"], 9)) for r in G.passage_search(*given).collect()}
    held = rows()
    assert {q for q, _ in held} == {1, 2, 3, 4, 5, 6}
    monkeypatch.setattr(G, "HELD", -1)
    assert held == rows()


def test_pairs_of_questions_and_passages_do_not_move(spark, monkeypatch):
    from conftest import SMALL

    from tidemark.plans import hybrid

    monkeypatch.setattr(G, "settled_pagerank", None)
    assert hybrid.passage_search(spark, SMALL).count() == 10
