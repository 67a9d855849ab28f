"""Pairing records with the record of the same entity that lies nearest in time, within a tolerance.

Rows are cut into slices of time per entity, slices are hashed into Arrow groups of bounded size, and in each
group DuckDB runs a backward and a forward ASOF join; the nearer of both candidates wins. A moment closer
to the edge of its slice than the tolerance also goes to the neighbouring slice. Both sides are first
reduced to one row per entity and moment, so that neither an entity that holds a third of the rows nor a
moment that many rows share makes a group large.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NEAREST = """
WITH b AS (SELECT l.e, l.t, l.t - r.t AS d, r.id FROM l ASOF JOIN r ON l.e = r.e AND l.t >= r.t WHERE l.t - r.t <= {tol}),
     f AS (SELECT l.e, l.t, r.t - l.t AS d, r.id FROM l ASOF JOIN r ON l.e = r.e AND l.t <= r.t WHERE r.t - l.t <= {tol})
SELECT e, t, min(d) AS d, arg_min(id, struct_pack(d := d, id := id)) AS id FROM (SELECT * FROM b UNION ALL SELECT * FROM f) GROUP BY e, t
"""


def nearest_in_time(left: DataFrame, right: DataFrame, *, entity: tuple[str, str], time: tuple[Column, Column], right_id: str, tolerance: int, slice_s: int = 3600, rows_per_group: int = 50_000) -> DataFrame:
    """``left`` rows (all columns, distinct) that have a match, with ``__match`` and ``__distance``.

    ``entity`` and ``time`` name the entity column and give the whole seconds of the left and the right side.
    Among equally near right rows the smallest ``right_id`` wins.

    Defined cases: a row with a null entity, time or id on either side matches nothing; repeated rows count
    once; a tie between an earlier and a later row goes to the smaller id; an empty side gives an empty
    result; columns of the right side never reach the result, so names cannot clash.
    """
    if tolerance < 0 or slice_s < tolerance:
        raise ValueError("the slice must be at least as long as the tolerance")
    asked = left.distinct().withColumns({"__e": F.col(f"`{entity[0]}`").cast("string"), "__t": time[0].cast("long")})
    have = right.select(F.col(f"`{entity[1]}`").cast("string").alias("e"), time[1].cast("long").alias("t"), F.col(f"`{right_id}`").cast("long").alias("id"))
    have = have.where("e IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL").groupBy("e", "t").agg(F.min("id").alias("id"))
    moments = asked.select(F.col("__e").alias("e"), F.col("__t").alias("t")).where("e IS NOT NULL AND t IS NOT NULL").distinct()
    groups = max(1, math.ceil((right.count() + left.count()) / rows_per_group))
    cell = lambda s: F.expr(f"pmod(xxhash64(e, {s}), {groups})")
    have = have.withColumn("cell", cell(f"floor(t / {slice_s})"))
    slices = F.expr(f"array_distinct(array(floor((t - {tolerance}) / {slice_s}), floor((t + {tolerance}) / {slice_s})))")
    moments = moments.select("e", "t", F.explode(slices).alias("s")).select("e", "t", cell("s").alias("cell")).distinct()
    sql = _NEAREST.format(tol=int(tolerance))

    def nearest(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        import duckdb

        if not l.num_rows or not r.num_rows:
            return pa.table({"e": pa.array([], pa.string()), "t": pa.array([], pa.int64()), "d": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "preserve_insertion_order": False}) as con:
            con.register("l", l)
            con.register("r", r)
            found = con.sql(sql).to_arrow_table()
        return found.cast(pa.schema([("e", pa.string()), ("t", pa.int64()), ("d", pa.int64()), ("id", pa.int64())]))

    found = moments.groupBy("cell").cogroup(have.groupBy("cell")).applyInArrow(nearest, "e string, t bigint, d bigint, id bigint")
    # a moment that went to two slices has up to two answers
    best = found.groupBy(F.col("e").alias("__e"), F.col("t").alias("__t")).agg(F.min(F.struct("d", "id")).alias("__best"))
    joined = asked.join(best, ["__e", "__t"])
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], F.col("__best.id").alias("__match"), F.col("__best.d").alias("__distance"))
