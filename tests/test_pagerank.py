"""Settled walks against a linear solver."""

import random

import numpy as np

from tidemark.operators import graph


def test_settled_pagerank_is_exact_and_whole(spark):
    rng = random.Random(3)
    pairs = {}
    for _ in range(900):
        a, b = rng.randrange(400), rng.randrange(400)
        if a != b:
            pairs[min(a, b), max(a, b)] = pairs.get((min(a, b), max(a, b)), 0) + 1.0
    pairs |= {(400 + k, 401 + k): 1.0 for k in range(12)} | {(0, 400): 1.0, (500, 501): 1.0}  # a tail; a part that no walk reaches
    p = {0: 0.25, 3: 0.25, 600: 0.5}  # 600 has no edges
    n = 601
    w = np.zeros((n, n))
    for (a, b), x in pairs.items():
        w[a, b] = w[b, a] = x
    total = w.sum(1)
    walk = np.divide(w, total[:, None], out=np.zeros_like(w), where=total[:, None] > 0)
    r = np.zeros(n)
    r[list(p)] = list(p.values())
    walk[total == 0] = r
    want = np.linalg.solve(np.eye(n) - 0.85 * walk.T, 0.15 * r)
    edges = spark.createDataFrame([(str(i), str(j), x) for (a, b), x in pairs.items() for i, j in ((a, b), (b, a))], "src string, dst string, weight double")
    found = {int(x["id"]): x["score"] for x in graph.settled_pagerank(edges, spark.createDataFrame([(str(k), v) for k, v in p.items()], "id string, p double")).collect()}
    assert set(found) == {k for k in range(n) if want[k] > 0}
    assert max(abs(found[k] - want[k]) for k in found) < 1e-11


def test_query_keeps_every_reached_node(spark):
    from conftest import SMALL

    import __spark_entry__ as entry
    from tidemark.plans.graph import triples

    pairs = [(r["s"], r["o"]) for r in triples(spark, SMALL).where("s <> o").collect()]
    ids = sorted({x for pair in pairs for x in pair})
    at = {x: k for k, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for a, b in pairs:
        w[at[a], at[b]] += 1
        w[at[b], at[a]] += 1
    r = np.array([x[0] in "SM" if x else False for x in ids], float)
    want = np.linalg.solve(np.eye(len(ids)) - 0.85 * (w / w.sum(1)[:, None]).T, 0.15 * r / r.sum())
    found = {x["id"]: x["score"] for x in entry.queries()["personalized_pagerank"](spark, SMALL).collect()}
    assert set(found) == {x for x in ids if want[at[x]] > 1e-15}
    assert max(abs(v - want[at[k]]) for k, v in found.items()) < 6e-10


def test_walks_of_a_group_need_no_rounds_of_shuffles(spark, monkeypatch):
    from tidemark.operators import memory_graph as G

    rng = random.Random(5)
    facts = [(f"S{s}", f"f{s}-{k}", f"e{rng.randrange(40)}", "holds", f"e{rng.randrange(40)}") for s in range(3) for k in range(60)]
    df = spark.createDataFrame(facts, "subject string, fact string, s string, p string, o string")
    asks = spark.createDataFrame([(k, f"S{k % 3}", f"e{k} holds e{k + 9}") for k in range(12)], "query bigint, subject string, text string")
    rows = lambda: sorted((r["query"], r["rank"], r["fact"], r["score"]) for r in G.triple_walk(df, asks).collect())
    monkeypatch.setattr(graph, "ROOM", 0)
    want = rows()  # every walk in the rounds of settled_pagerank
    monkeypatch.undo()

    def never(*a, **b):
        raise AssertionError("a walk that fits a task was shuffled")

    monkeypatch.setattr(G, "settled_pagerank", never)
    got = rows()
    assert len(want) == 120 and [x[:3] for x in got] == [x[:3] for x in want]
    assert max(abs(x[3] - y[3]) for x, y in zip(got, want)) < 2e-9


def test_hybrid_retrieval_needs_no_rounds_of_shuffles(spark, monkeypatch):
    from conftest import SMALL

    import __spark_entry__ as entry
    from tidemark.operators import memory_graph as G

    def never(*a, **b):
        raise AssertionError("a walk that fits a task was shuffled")

    monkeypatch.setattr(G, "settled_pagerank", never)
    assert entry.queries()["hybrid_retrieval"](spark, SMALL).count() > 0


def test_triple_walk_asks_every_question(spark):
    from conftest import SMALL

    import __spark_entry__ as entry
    from tidemark.plans.graph import triples

    number = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS bigint)"
    told = triples(spark, SMALL).select("subject").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()
    asked = spark.read.parquet(f"{SMALL}/qa_mcq.parquet").where("question IS NOT NULL").join(told, "subject").selectExpr(f"{number} AS query").distinct().count()
    assert entry.queries()["triple_walk"](spark, SMALL).select("query").distinct().count() == asked > 1


def test_facts_move_once(spark, monkeypatch):
    from tidemark.operators import memory_graph as G

    rng = random.Random(6)
    df = spark.createDataFrame([(f"S{s}", f"f{s}-{k}", f"e{rng.randrange(40)}", "holds", f"e{rng.randrange(40)}") for s in range(3) for k in range(60)], "subject string, fact string, s string, p string, o string")
    asks = spark.createDataFrame([(k, f"S{k % 3}", f"e{k % 5} holds") for k in range(12)], "query bigint, subject string, text string")
    written, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda x: written.append(x.columns) or cut(x))
    assert G.triple_walk(df, asks).count() == 120
    assert not any("fact" in columns for columns in written)


def test_group_walks_rest_where_the_system_says():
    rng = np.random.default_rng(8)
    # hubs with leaves, a middle of random lines, a pair apart and a node without lines
    a = np.concatenate([rng.integers(0, 12, 900), rng.integers(0, 300, 700), [1200]])
    b = np.concatenate([rng.integers(300, 1200, 900), rng.integers(0, 300, 700), [1201]])
    a, b = a[a != b], b[a != b]
    n, w = 1203, np.ones(len(a))
    first = np.zeros((n, 5))
    first[[3, 700, 1200, 1202, 250], [0, 1, 2, 3, 4]] = 1
    first[4, 0] = first[1202, 1] = 1
    first /= first.sum(0)
    m = np.zeros((n, n))
    np.add.at(m, (a, b), 1)
    m += m.T
    total = m.sum(0)
    x = np.linalg.solve(np.eye(n) - 0.85 * np.divide(m, total, out=np.zeros_like(m), where=total > 0), first)
    walks = graph.GroupWalks(n, a, b, w, 0.85)
    assert walks.levels is not None and len(walks.levels[1]) < 400
    assert np.abs(walks.rest(first) - x / x.sum(0)).max() < 1e-13
    walks.levels, walks.along = None, graph.Sums(np.concatenate([b, a]), np.concatenate([a, b]), n, np.ones(2 * len(a)))
    assert np.abs(walks.rest(first) - x / x.sum(0)).max() < 1e-11
    # two nodes joined twice in one line and once more are three times joined; what a walk can reach has a score
    assert ((x > 1e-12) == walks.reached(first)).all()


def test_hybrid_retrieval_asks_every_question(spark):
    from conftest import SMALL

    import __spark_entry__ as entry
    from tidemark.plans.temporal import captions

    number = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS bigint)"
    told = captions(spark, SMALL).where("end_ts <= 150000").select("subject").distinct()
    asked = spark.read.parquet(f"{SMALL}/qa_mcq.parquet").where("question IS NOT NULL").join(told, "subject").selectExpr(f"{number} AS query").distinct().count()
    assert entry.queries()["hybrid_retrieval"](spark, SMALL).select("query").distinct().count() == asked > 1


def test_vectors_of_another_length_have_no_direction():
    import pyarrow as pa

    small = pa.chunked_array([pa.array([[3, 4], None, None, [0, 0]], pa.list_(pa.int8()))])
    v = pa.chunked_array([pa.array([None, [0.5, 0.0], [1.0, 2.0, 3.0], None], pa.list_(pa.float64()))])
    x, good = graph.unit_rows(2, small, v)
    assert x.tolist() == [[0.6, 0.8], [1.0, 0.0], [0.0, 0.0], [0.0, 0.0]] and good.tolist() == [True, True, False, False]
