"""Windows over keys of any size: a key's rows are cut into slices of its order, and only one row a slice is gathered.

``slice_by`` is an expression that never falls along the order, such as the day of a time or a range of ids. Rows are
sorted within (keys, slice); totals of slices are summed over the key's slices and joined back. So a key that
holds a third of all rows costs no task more than its largest slice and the list of its slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _joined(rows: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """Slices' values beside their rows; null keys are values."""
    named = slices.select(*[F.col(k).alias(f"__s_{k}") for k in [*keys, "__slice"]], *[c for c in slices.columns if c not in (*keys, "__slice")])
    on = [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in [*keys, "__slice"]]
    return rows.join(named, on, "left").drop(*[f"__s_{k}" for k in [*keys, "__slice"]])


def numbered(rows: DataFrame, keys: list[str], order: list[str], slice_by: str, name: str = "rn", count: str | None = None) -> DataFrame:
    """Adds the number of each row in its key's order, from 1, and the number of the key's rows as ``count``."""
    over = ", ".join(keys)
    at = rows.withColumn("__slice", F.expr(slice_by))
    sizes = at.groupBy(*keys, "__slice").agg(F.count("*").alias("__here"))
    before = sizes.selectExpr(*keys, "__slice", f"coalesce(sum(__here) OVER (PARTITION BY {over} ORDER BY __slice {_EARLIER}), 0L) AS __before", f"sum(__here) OVER (PARTITION BY {over}) AS __all")
    here = at.selectExpr("*", f"row_number() OVER (PARTITION BY {over}, __slice ORDER BY {', '.join(order)}) AS __n")
    made = _joined(here, before, keys).withColumn(name, F.expr("__before + __n"))
    return (made.withColumn(count, F.col("__all")) if count else made).drop("__slice", "__n", "__before", "__all")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], slice_by: str, value: str, name: str, upto: bool = True) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row, with its own if ``upto``."""
    over = ", ".join(keys)
    at = rows.withColumn("__slice", F.expr(slice_by)).withColumn("__v", F.expr(value))
    sums = at.groupBy(*keys, "__slice").agg(F.sum("__v").alias("__here"))
    before = sums.selectExpr(*keys, "__slice", f"coalesce(sum(__here) OVER (PARTITION BY {over} ORDER BY __slice {_EARLIER}), 0) AS __before")
    frame = "ROWS UNBOUNDED PRECEDING" if upto else _EARLIER
    here = at.selectExpr("*", f"coalesce(sum(__v) OVER (PARTITION BY {over}, __slice ORDER BY {', '.join(order)} {frame}), 0) AS __n")
    return _joined(here, before, keys).withColumn(name, F.expr("__before + __n")).drop("__slice", "__v", "__n", "__before")


def following(rows: DataFrame, keys: list[str], order: list[str], slice_by: str, take: dict[str, str]) -> DataFrame:
    """Adds columns of the next row in the key's order: name -> column; null after the last."""
    over = ", ".join(keys)
    at = rows.withColumn("__slice", F.expr(slice_by)).withColumn("__own", F.struct(*[F.col(c).alias(n) for n, c in take.items()]))
    firsts = at.groupBy(*keys, "__slice").agg(F.min_by("__own", F.struct(*order)).alias("__first"))
    nexts = firsts.selectExpr(*keys, "__slice", f"lead(__first) OVER (PARTITION BY {over} ORDER BY __slice) AS __then")
    here = at.selectExpr("*", f"lead(__own) OVER (PARTITION BY {over}, __slice ORDER BY {', '.join(order)}) AS __next")
    made = _joined(here, nexts, keys).withColumn("__next", F.coalesce("__next", "__then"))
    return made.selectExpr(*rows.columns, *(f"__next.{n} AS {n}" for n in take))


def seen_so_far(rows: DataFrame, keys: list[str], time: str, slice_by: str, value: str) -> DataFrame:
    """Adds ``n`` and ``top``: how many values that are not null lie at each row's time or before it, and the largest of them."""
    over = ", ".join(keys)
    at = rows.withColumn("__slice", F.expr(slice_by))
    sums = at.groupBy(*keys, "__slice").agg(F.count(value).alias("__c"), F.max(value).alias("__m"))
    before = sums.selectExpr(*keys, "__slice", f"coalesce(sum(__c) OVER (PARTITION BY {over} ORDER BY __slice {_EARLIER}), 0L) AS __cb", f"max(__m) OVER (PARTITION BY {over} ORDER BY __slice {_EARLIER}) AS __mb")
    window = f"OVER (PARTITION BY {over}, __slice ORDER BY {time} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    here = at.selectExpr("*", f"count({value}) {window} AS __n", f"max({value}) {window} AS __t")
    return _joined(here, before, keys).withColumns({"n": F.expr("__cb + __n"), "top": F.greatest("__mb", "__t")}).drop("__slice", "__cb", "__mb", "__n", "__t")
