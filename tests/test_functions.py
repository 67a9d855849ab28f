from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.clock import clock_seconds, day_label, day_number, day_stamp_seconds
from tidemark.operators import graph, metrics, sampling, temporal
from tidemark.sources import store


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_clock(spark):
    assert one(spark, day_stamp_seconds(F.lit(111094300))) == 40183.0
    assert one(spark, day_stamp_seconds(F.lit(211094300))) == 126583.0
    assert one(spark, day_label(F.lit(40183))) == "DAY1 11:09:43"
    assert [one(spark, clock_seconds(F.lit(x).cast("string"))) for x in ("11094300", "9", "24000000", "", "1a", None)] == [40183, 0, None, None, None, None]
    assert [one(spark, day_number(F.lit(x).cast("string"))) for x in ("DAY1", "day012", "Day", "DAY 1", "DAY1\n", None)] == [1, 12, None, None, None, None]


def test_text(spark):
    say = lambda e: spark.sql(f"SELECT {e}").first()[0]
    assert say(X.entity_key("'I'", "'B2/ANNA-X'")) == "b2_anna_x" and say(X.entity_key('"Mei Lan\'s"', "'p'")) == "mei_lans"
    assert say(X.answer_form("'The  Cat, a dog and AN owl!'")) == "cat dog and owl"
    assert [say(X.choice_letter(f"'{t}'")) for t in ("(B) because", "The answer is: c", "none of it")] == ["B", "C", None]
    assert [say(X.judge_score(f"'{t}'")) for t in ("Final Score: 4", "2 or 3")] == ["4", "3"]
    assert [say(X.smooth_score(str(k))) for k in (2, 3, 4)] == [0.0, 0.5, 1.0]


def test_metrics(spark):
    df = spark.createDataFrame([(1, ["a", "x", "b"], ["a", "b"]), (2, ["x", "a"], ["a"]), (3, ["x"], [])], "q int, ranked array<string>, relevant array<string>")
    found = {r["q"]: r for r in metrics.ranking_metrics(metrics.relevance(df, ["q"]), ["q"], (5,)).collect()}
    assert round(found[1]["ap"], 5) == 0.83333 and round(found[2]["ndcg"], 5) == 0.63093 and found[3]["recall"] == 1.0
    rec = metrics.retrieval_recall(metrics.relevance(df, ["q"]), (5,)).first()
    assert rec["recall"] == 0.6667


def test_temporal_next_weights(spark):
    rows = [("s", "30sec", 1, 0, 10), ("s", "30sec", 2, 10, 20), ("s", "30sec", 3, 49, 50), ("s", "30sec", 4, 50 + 21601, 50 + 21602)]
    edges = {(r["src"], r["dst"]): r["weight"] for r in temporal.temporal_next_edges(spark.createDataFrame(rows, "subject string, granularity string, id long, start_ts long, end_ts long")).collect()}
    assert edges[(1, 2)] == edges[(2, 1)] == 1.0 and round(edges[(2, 3)], 5) == 0.03333 and (3, 4) not in edges


def test_anchor_windows(spark):
    df = spark.createDataFrame([("d", 0, 1), ("d", 599, 600), ("d", 600, 601), ("e", 100, 110), ("e", 280, 290)], "k string, s long, e long")
    assert {(r["k"], r["first_start"], r["n_rows"]) for r in temporal.anchor_windows(df, ["k"], "s", "e", 600).collect()} == {("d", 0, 2), ("d", 600, 1), ("e", 100, 2)}


def test_quota(spark):
    df = spark.createDataFrame([(1, "30sec", k, 100.0 - k) for k in range(9)] + [(1, "1h", 90 + k, 999.0) for k in range(2)], "q int, kind string, id int, score double")
    assert {r["kind"] for r in temporal.quota_rank(df, ["q"], "kind", temporal.QUOTAS, 16).collect()} == {"30sec"} and temporal.quota_rank(df, ["q"], "kind", temporal.QUOTAS, 16).count() == 8


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")).collect()}
    assert found == {x: find(x) for x in found}


def test_pagerank_keeps_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 3.0), ("c", "b", 3.0)], "src string, dst string, weight double")
    found = graph.settled_pagerank(edges, spark.createDataFrame([("a", 0.5), ("lonely", 0.5)], "id string, p double")).agg(F.sum("score")).first()[0]
    assert abs(found - 1) < 1e-9


def test_store(spark):
    df = lambda xs: store.keyed(spark.createDataFrame([(x,) for x in xs], "content string"), "content", "chunk-")
    assert one(spark, F.md5(F.lit("abc"))) == "900150983cd24fb0d6963f7d28e17f72"
    both = store.upsert(df(["a", "b"]), df(["b", "c", "c"]))
    assert sorted(r["content"] for r in both.collect()) == ["a", "b", "c"]
    assert sorted(r["content"] for r in store.delete(both, df(["b"])).collect()) == ["a", "c"]
    links = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y")], "doc int, ent string")
    assert [r["ent"] for r in store.orphans(links, "doc", "ent", spark.createDataFrame([(1,)], "doc int")).collect()] == ["y"]


def test_hard_negatives(spark):
    df = spark.createDataFrame([("p", 0.9, ["a", "b", "p"], [0.85, 0.5, 0.1])], "pos string, pos_score double, neg array<string>, neg_score array<double>")
    assert sampling.hard_negatives(df, 0.1, 0.95).first()["kept"] == ["b"]
