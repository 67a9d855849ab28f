"""Ranking, answer and breakdown metrics over arrays, without gathering anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10)


def relevance(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, rel, n) of ``ranked`` and ``relevant`` (arrays without repeats): 1 or 0 by rank, and the number of relevant ones."""
    return rows.selectExpr(*by, "transform(ranked, d -> CASE WHEN array_contains(relevant, d) THEN 1 ELSE 0 END) AS rel", "CAST(size(relevant) AS bigint) AS n")


def ranking_metrics(rows: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """(by, k, precision, recall, hit, f1, ap, rr, ndcg) of ``rel`` (1 or 0 by rank) and ``n`` (relevant ones in all).

    Recall of nothing relevant is 1; average precision divides by the smaller of k and the number of relevant ones.
    """
    each = rows.select(*by, "rel", "n", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    each = each.selectExpr(*by, "k", "n", "slice(rel, 1, k) AS rel")
    each = each.selectExpr(*by, "k", "n", "rel", "aggregate(rel, 0, (s, x) -> s + x) AS hits")
    gains = "aggregate(transform(rel, (x, i) -> x / log2(CAST(i + 2 AS double))), 0D, (s, x) -> s + x)"
    ideal = "aggregate(transform(sequence(1, CAST(greatest(1, least(k, n)) AS int)), i -> 1D / log2(CAST(i + 1 AS double))), 0D, (s, x) -> s + x)"
    ap = "aggregate(transform(rel, (x, i) -> x * aggregate(slice(rel, 1, i + 1), 0, (s, y) -> s + y) / CAST(i + 1 AS double)), 0D, (s, x) -> s + x)"
    return each.selectExpr(
        *by, "k", "CAST(hits AS double) / k AS precision", "CASE WHEN n = 0 THEN 1D ELSE hits / CAST(n AS double) END AS recall", "CASE WHEN hits > 0 THEN 1D ELSE 0D END AS hit",
        "CASE WHEN hits = 0 OR n = 0 THEN 0D ELSE 2D * hits / (k + n) END AS f1", f"CASE WHEN n = 0 THEN 0D ELSE {ap} / least(n, k) END AS ap",
        "CASE WHEN array_position(rel, 1) > 0 THEN 1D / array_position(rel, 1) ELSE 0D END AS rr", f"CASE WHEN n = 0 THEN 0D ELSE {gains} / {ideal} END AS ndcg",
    )


def retrieval_recall(rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(k, recall): mean recall at k; here recall of nothing relevant is 0. Rounded to four digits."""
    each = rows.select("rel", "n", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return each.groupBy("k").agg(F.round(F.avg(F.expr("CASE WHEN n = 0 THEN 0D ELSE aggregate(slice(rel, 1, k), 0, (s, x) -> s + x) / CAST(n AS double) END")), 4).alias("recall"))


def token_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, em, f1) of normalised ``predicted`` and ``gold`` texts: exact match and F1 of the multisets of words."""
    words = rows.selectExpr(*by, "predicted", "gold", "filter(split(predicted, ' '), w -> w <> '') AS p", "filter(split(gold, ' '), w -> w <> '') AS g")
    common = "aggregate(transform(array_distinct(p), w -> least(size(filter(p, x -> x = w)), size(filter(g, x -> x = w)))), 0, (s, x) -> s + x)"
    made = words.selectExpr(*by, "CASE WHEN predicted = gold THEN 1D ELSE 0D END AS em", f"CAST({common} AS double) AS c", "size(p) AS np", "size(g) AS ng")
    return made.selectExpr(*by, "em", "CASE WHEN c = 0 THEN 0D ELSE 2D * c / (np + ng) END AS f1")


def breakdown(outcomes: DataFrame) -> DataFrame:
    """(bucket, n, base, chain, delta): outcomes (topic, event, base, chain) by what was retrieved, with All and Any."""
    bucket = "CASE WHEN topic AND event THEN 'Both' WHEN topic THEN 'Topic only' WHEN event THEN 'Event only' ELSE 'None' END"
    rows = outcomes.selectExpr(f"{bucket} AS b", "base", "chain").selectExpr("explode(CASE WHEN b = 'None' THEN array(b, 'All') ELSE array(b, 'All', 'Any') END) AS bucket", "base", "chain")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("base").alias("base"), F.sum("chain").alias("chain")).withColumn("delta", F.round((F.col("chain") - F.col("base")) * 100 / F.col("n"), 4))


# Marks that facts of chains carry where they stand among retrieved contents.
TOPIC_MARK, EVENT_MARK = "[Topic: ", "[Event: "


def marks(rows: DataFrame, contents: str) -> DataFrame:
    """Adds ``topic`` and ``event``: whether an array of retrieved contents holds a fact of either kind of chain."""
    has = lambda mark: f"coalesce(exists({contents}, c -> contains(c, '{mark}')), false)"
    return rows.withColumns({"topic": F.expr(has(TOPIC_MARK)), "event": F.expr(has(EVENT_MARK))})


def paired(rows: DataFrame, key: str, base: str, chain: str, score: str) -> DataFrame:
    """(bucket, n, seeds, base, chain, delta) of keys that both runs have: the first averaged over its seeds, in buckets by the second's marks.

    ``base`` and ``chain`` are conditions that tell the runs' rows apart. A missing score of the second run counts as 0.
    """
    first = rows.where(base).where(F.col(score).isNotNull()).groupBy(key).agg(F.avg(score).alias("base"), F.count("*").alias("seeds"))
    second = rows.where(chain).groupBy(key).agg(F.avg(F.coalesce(F.col(score), F.lit(0.0))).alias("chain"), F.bool_or("topic").alias("topic"), F.bool_or("event").alias("event"))
    bucket = "CASE WHEN topic AND event THEN 'Both' WHEN topic THEN 'Topic only' WHEN event THEN 'Event only' ELSE 'None' END"
    each = first.join(second, key).selectExpr(f"{bucket} AS b", "base", "chain", "seeds").selectExpr("explode(CASE WHEN b = 'None' THEN array(b, 'All') ELSE array(b, 'All', 'Any') END) AS bucket", "base", "chain", "seeds")
    made = each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("seeds").alias("seeds"), F.sum("base").alias("base"), F.sum("chain").alias("chain"))
    return made.selectExpr("bucket", "n", "seeds", "round(base, 6) AS base", "round(chain, 6) AS chain", "round((chain - base) * 100 / n, 4) AS delta")


def merge_tasks(scores: DataFrame, summed: tuple[str, ...] = ()) -> DataFrame:
    """(split, metric, score, found): scores (split, task, metric, score) averaged over all tasks there are, whether a split has them or not."""
    tasks = scores.agg(F.countDistinct("task").alias("tasks"))  # one row
    made = scores.groupBy("split", "metric").agg(F.sum("score").alias("total"), F.count("*").alias("found")).join(F.broadcast(tasks))
    return made.select("split", "metric", F.when(F.col("metric").isin(*summed), F.col("total")).otherwise(F.col("total") / F.col("tasks")).alias("score"), "found")


def report(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(modality, score, found, missing): the mean over found datasets of each modality, and the names of those without a score."""
    rows = expected.join(found, ["modality", "dataset"], "left")
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("score").isNull(), F.col("dataset")))), ",")
    return rows.groupBy("modality").agg(F.avg("score").alias("score"), F.count("score").alias("found"), names.alias("missing"))


def evaluable(needs: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """(key, sources): keys that need a source at all, all of whose sources are available; ``needs`` is (key, source), each pair once."""
    known = needs.join(available.select("source", F.lit(True).alias("there")).distinct(), "source", "left")
    return known.groupBy(key).agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("all"), F.count("*").alias("sources")).where("all").select(key, "sources")


def graded_ndcg(rows: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """(by, k, linear, exponential): discounted gain over the ideal one, from graded ``rel`` by rank; 0 where nothing is relevant."""
    each = rows.select(*by, "rel", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    each = each.selectExpr(*by, "k", "slice(rel, 1, k) AS got", "slice(sort_array(rel, false), 1, k) AS best")
    gain = lambda xs, f: f"aggregate(transform({xs}, (x, i) -> {f} / log2(CAST(i + 2 AS double))), 0D, (s, x) -> s + x)"
    share = lambda f: f"coalesce({gain('got', f)} / nullif({gain('best', f)}, 0D), 0D)"
    return each.selectExpr(*by, "k", f"{share('CAST(x AS double)')} AS linear", f"{share('(pow(2D, x) - 1)')} AS exponential")
