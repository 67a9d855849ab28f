"""Windows cut into slices against Spark's own windows."""

import random

from pyspark.sql import functions as F

from tidemark.operators import slices


def frame(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, rng.randint(0, 5000)]) if k % 9 == 0 else rng.randint(0, 5000), k, rng.choice([None, rng.randint(0, 9)])) for k in range(700)]
    return spark.createDataFrame(rows, "k string, t int, id int, v int")


def same(got, want, cols):
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_against_whole_windows(spark):
    df = frame(spark)
    w = "OVER (PARTITION BY k ORDER BY t, id)"
    at = "floor(t / 100)"
    same(slices.numbered(df, ["k"], ["t", "id"], at, count="n"), df.selectExpr("*", f"CAST(row_number() {w} AS bigint) AS rn", "count(*) OVER (PARTITION BY k) AS n"), ["id", "rn", "n"])
    same(slices.running_sum(df, ["k"], ["t", "id"], at, "v", "s"), df.selectExpr("*", f"coalesce(sum(v) {w}, 0L) AS s"), ["id", "s"])
    same(slices.following(df, ["k"], ["t", "id"], at, {"b": "id", "u": "t"}), df.selectExpr("*", f"lead(id) {w} AS b", f"lead(t) {w} AS u"), ["id", "b", "u"])
    r = "OVER (PARTITION BY k ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    same(slices.seen_so_far(df, ["k"], "t", at, "v"), df.selectExpr("*", f"count(v) {r} AS n", f"max(v) {r} AS top"), ["id", "n", "top"])


def test_empty(spark):
    df = frame(spark).limit(0)
    assert slices.numbered(df, ["k"], ["t"], "t").count() == slices.following(df, ["k"], ["t"], "t", {"b": "id"}).count() == 0


def test_clashing_columns_stay(spark):
    df = frame(spark).withColumn("n", F.lit("x"))
    assert set(slices.numbered(df, ["k"], ["t", "id"], "floor(t / 100)").columns) == {*df.columns, "rn"}
