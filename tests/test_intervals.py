import random

from tidemark.operators.intervals import merge_intervals


def brute(rows):
    out = set()
    keys = {(s, d) for s, d, *_ in rows}
    for key in keys:
        spans = sorted((a, b) for s, d, a, b in rows if (s, d) == key and a is not None and b is not None and a < b)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(*key, "period", a, b) for a, b in merged}
        out |= {(*key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "subject string, day int, a int, b int")
    if extra:
        df = df.selectExpr("*", "'x' AS kind", "1 AS start", "2 AS end", "3 AS __salt")
    return {tuple(r) for r in merge_intervals(df.repartition(7), ["subject", "day"], "a", "b").collect()}


def test_random_intervals_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy") if rng.random() > 0.1 else None, rng.randint(1, 3), a := rng.randint(0, 400), a + rng.randint(-5, 40)) for _ in range(400)]
    assert run(spark, rows) == brute(rows)


def test_hot_key_over_many_partitions(spark):
    rows = [("hot", 1, 10 * i, 10 * i + (10 if i % 7 else 9)) for i in range(3000)]
    assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [("s", 1, 0, 10), ("s", 1, 10, 20), ("s", 1, 2, 5), ("s", 1, 30, 40), ("s", 1, 30, 40), ("s", 1, None, 3), ("s", 1, 50, None), ("s", 1, 9, 9), ("s", 1, 60, 50), (None, None, 1, 2)]
    found = run(spark, rows, extra=True)
    assert found == {("s", 1, "period", 0, 20), ("s", 1, "gap", 20, 30), ("s", 1, "period", 30, 40), (None, None, "period", 1, 2)}
    assert run(spark, []) == set()


def test_small_chunks_and_many_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", f"s{rng.randint(0, 200)}", None]), rng.choice([None, 1, 2**60, 2**60 + 1]), a := rng.randint(0, 5000), a + rng.randint(1, 6)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "subject string, day long, a int, b int").repartition(9)
    assert {tuple(r) for r in merge_intervals(df, ["subject", "day"], "a", "b", chunk=4, flush=100).collect()} == brute(rows)


def test_parts_of_lists_stay_small(spark):
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from tidemark.operators import intervals

    n = 100_000
    made = (pd.DataFrame({"k": ["a", "b"]}), np.repeat([0, 1], n), np.tile(np.arange(n) * 3, 2), np.tile(np.arange(n) * 3 + 1, 2))
    batches = list(intervals._lists(made, [pa.field("k", pa.string())], None, 512))
    assert max(len(x) for b in batches for x in b.column(intervals.STARTS).to_pylist()) == 512
    runs = [r for r in intervals._runs(iter(batches), ["k"])]
    assert [list(r[0]["k"]) for r in runs] == [["a"], ["b"]] and all(len(r[2]) == n for r in runs)
