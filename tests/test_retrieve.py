"""The best documents by BM25 where they are read, against the scores of all pairs."""

from tidemark.operators import retrieve


def test_bm25_top_is_the_head_of_all_scores(spark):
    import random

    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)] + ["the", "The"]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words[: 3 + k % 39]) for _ in range(k % 17)) + "\tthe " * (k % 3 > 0)) for k in range(700)] + [(k, "w1 w7 w9") for k in range(700, 730)], "id bigint, text string").repartition(7)
    asks = spark.createDataFrame([(1, "the w1  w1 w7"), (2, "W1 the w1 w7"), (3, "unknown"), (4, "w30 w31 w32"), (5, "the"), (6, "")], "query int, text string")
    want = {(r["query"], r["rank"]): (r["id"], round(r["score"], 8)) for r in retrieve.top(retrieve.bm25(docs, asks).selectExpr("query", "id", "round(score, 9) AS score"), ["query"], 10).collect()}
    assert {q for q, _ in want} >= {1, 2, 4}
    assert {(r["query"], r["rank"]): (r["id"], round(r["score"], 8)) for r in retrieve.bm25_top(docs, asks, 10).collect()} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_questions_and_documents_do_not_move(spark):
    from conftest import SMALL

    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["bm25_topk"](spark, SMALL))
    assert "MapInArrow" in plan and "Join" not in plan


def test_rounds_search_only_the_best(spark, monkeypatch):
    from conftest import SMALL

    from tidemark.plans import adapters

    seen, cut = [], adapters.cut
    monkeypatch.setattr(adapters, "cut", lambda df: seen.append(out := cut(df)) or out)
    adapters.retrieval_rounds(spark, SMALL)
    # fifteen of each question are written, not all that match
    assert seen[0].groupBy("query").count().agg({"count": "max"}).first()[0] == 15


def test_rounds_ask_every_question(spark):
    from conftest import SMALL

    import __spark_entry__ as entry

    number = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS bigint)"
    asked = spark.read.parquet(f"{SMALL}/qa_mcq.parquet").where("question IS NOT NULL").selectExpr(f"{number} AS query").distinct().count()
    assert entry.queries()["retrieval_rounds"](spark, SMALL).select("query").distinct().count() == asked > 1


def test_bags_that_wait_are_pruned_by_value_only():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    parts = rng.integers(0, 3, (6, 900)) / 2  # many ties
    sizes, code = np.array([2, 3, 1]), np.array([0, 1, 2, 3, 4, 5])
    w = np.array([1.0, 0.5, 2.0, 0.25, 1.0, -1.0])
    best = retrieve.BestBags(6, sizes, code, w, 5, 2.5, 9, wait=50)
    for lo in range(0, 900, 300):
        row, word = np.nonzero(parts[:, lo : lo + 300].T)
        best.add(300, row, word, parts[word, row + lo])
    ids = [(k * 7) % 900 for k in range(900)]
    bag, doc, near, _ = best.leading(pa.array(ids))
    got = [(int(b), ids[d], n) for b, d, n in zip(bag, doc, near)]
    scores = [w[:2] @ parts[:2], w[2:5] @ parts[2:5], w[5:] @ parts[5:]]
    want = [(b, i, s) for b, x in enumerate(scores) for s, i in sorted(((s, ids[d]) for d, s in enumerate(x) if s > 0), key=lambda y: (-y[0], y[1]))[:5]]
    assert got == want
