"""Choosing rows: interleaving sources, strata, negatives. Draws order rows by a seeded hash, so that they can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import slices


def interleave_cycle(rows: DataFrame, source: str, order: str, stop: str = "first", slice_rows: int = 4096) -> DataFrame:
    """Rows of all sources in turn, as ``pos``: round by round, sources by name. ``order`` is a whole number.

    ``first`` stops when a source has no more rows, with the last full round; ``all`` goes on without the exhausted ones.
    """
    numbered = slices.numbered(rows, [source], [order], f"floor({order} / {slice_rows})", "round")
    if stop == "first":
        least = rows.groupBy(source).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
        numbered = numbered.join(F.broadcast(least), F.col("round") <= F.col("least")).drop("least")  # one row
    sizes = numbered.groupBy("round").agg(F.count("*").alias("here"))
    before = slices.running_sum(sizes.withColumn("all", F.lit(0)), ["all"], ["round"], f"floor(round / {slice_rows})", "here", "before", upto=False).select("round", "before")
    return numbered.join(before, "round").selectExpr("*", f"before + row_number() OVER (PARTITION BY round ORDER BY {source}) AS pos").drop("before")


def stratified(rows: DataFrame, stratum: str, key: str, total: int, seed: int) -> DataFrame:
    """ceil(total / strata) rows of each stratum, strata by ascending size and small ones whole, and others by hash to make up the total."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("__n"))
    per = f"CAST(ceil({total} / __strata) AS bigint)"
    bounds = sizes.join(F.broadcast(sizes.agg(F.count("*").alias("__strata"))))  # one row
    plan = bounds.selectExpr(stratum, f"{per} AS __per", f"coalesce(sum(least(__n, {per})) OVER (ORDER BY __n, {stratum} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS __before")
    code = f"CAST(conv(substr(md5(concat({key}, ':{seed}')), 1, 12), 16, 10) AS bigint)"
    drawn = rows.join(plan, stratum).withColumn("__h", F.expr(code)).selectExpr("*", f"row_number() OVER (PARTITION BY {stratum} ORDER BY __h, {key}) AS __r")
    # a stratum's own share first, as long as the total has room for it; what is missing comes from all other rows
    ranked = drawn.withColumn("__extra", F.expr(f"CASE WHEN __r <= __per AND __before + __r <= {total} THEN 0 ELSE 1 END"))
    return ranked.orderBy("__extra", "__h", key).limit(total).select(*rows.columns)


def hard_negatives(rows: DataFrame, margin: float | None = None, ratio: float | None = None, threshold: float | None = None, excluded: str | None = None, ranks: tuple[int, int] | None = None) -> DataFrame:
    """Adds ``kept``: of the negatives (arrays ``neg``, ``neg_score``, best first) those that pass all that is asked.

    Below a threshold; below ``pos_score`` by a margin, by a ratio; not among the ``excluded`` (SQL, an array); not the positive ``pos``, if there is
    that column; of these the range of ranks, from 1, both ends included.
    """
    tests = [f"x.neg_score < {t}" for t in (threshold,) if t is not None] + [f"x.neg_score < pos_score - {m}" for m in (margin,) if m is not None] + [f"x.neg_score < pos_score * {r}" for r in (ratio,) if r is not None]
    tests += [f"NOT array_contains({excluded}, x.neg)"] if excluded else []
    tests += ["x.neg <> pos"] if "pos" in rows.columns else []
    kept = f"transform(filter(arrays_zip(neg, neg_score), x -> {' AND '.join(tests) or 'true'}), x -> x.neg)"
    return rows.withColumn("kept", F.expr(f"slice({kept}, {ranks[0]}, {ranks[1] - ranks[0] + 1})" if ranks else kept))


def contrastive_loss(pairs: DataFrame, by: list[str], temperature: float) -> DataFrame:
    """(by, loss): cross entropy of the positive (``is_pos``) among all scored candidates of a query."""
    x = F.col("score") / temperature
    top = F.max(x).alias("top")
    w = pairs.groupBy(*by).agg(top)
    # subtracting the largest keeps the exponentials finite
    return pairs.join(w, by).groupBy(*by).agg((F.log(F.sum(F.exp(x - F.col("top")))) + F.first("top") - F.max(F.when(F.col("is_pos"), x))).alias("loss"))


def interleave_weighted(rows: DataFrame, source: str, order: str, weights: dict[str, float], draws: int, seed: int = 1, batch: int = 1, slice_rows: int = 4096) -> DataFrame:
    """``draws`` rows by ``pos``: each draw takes a source with its weight's share and the source's next row; an exhausted source starts again.

    With ``batch`` so many draws in a row take one source. Draws are hashes of their number, so that they can be repeated. Sources without
    rows must have no weight; ``order`` is a whole number. The weights are a small stated table.
    """
    whole, low, cases = sum(weights.values()), 0.0, ""
    for name, w in sorted(weights.items()):
        low += w / whole
        cases += f" WHEN u < {low!r}D THEN '{name}'"
    u = f"CAST(conv(substr(md5(concat(CAST(pos DIV {batch} AS string), ':{seed}')), 1, 8), 16, 10) AS bigint) / 4294967296D"
    drawn = rows.sparkSession.range(draws).selectExpr("id AS pos").selectExpr("pos", f"{u} AS u").selectExpr("pos", f"CASE{cases} ELSE '{max(weights)}' END AS {source}")
    turns = slices.numbered(drawn, [source], ["pos"], f"floor(pos / {slice_rows})", "turn")
    numbered = slices.numbered(rows, [source], [order], f"floor({order} / {slice_rows})", "__r", count="__size")
    sizes = numbered.groupBy(source).agg(F.max("__size").alias("__size"))
    picked = turns.join(sizes, source).selectExpr("pos", source, "(turn - 1) % __size + 1 AS __r", "(turn - 1) DIV __size AS epoch")
    return picked.join(numbered.drop("__size"), [source, "__r"]).drop("__r")
