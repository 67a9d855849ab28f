"""Exact similarity search of a stated set of queries against all items, by matrix products of Arrow batches.

Queries go to the tasks in blocks of bounded size; each task keeps the best items of its rows for every query, and
one ranking joins them. Items are read once a block and never shuffled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of lists of ``dim`` finite numbers that are not all zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = np.flatnonzero((np.diff(lists.offsets.to_numpy()) == dim) & lists.is_valid().to_numpy(zero_copy_only=False))
    x = lists.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) if len(ok) else np.zeros((0, dim))
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(x).all(1) & (norm > 0)
    return ok[good], x[good] / norm[good, None]


def similar(queries: DataFrame, items: DataFrame, k: int, *, dim: int, floor: float = -1.0, per_kind: bool = False, group: bool = False, until: bool = False, digits: int = 9) -> DataFrame:
    """(query, id, kind, score): the ``k`` items of highest cosine for each query, ties by id; scores to ``digits``.

    ``queries`` (query, v) and ``items`` (id, v, kind). With ``per_kind`` the k best of each kind come out; with ``group``
    both sides have a column ``group`` that must be equal; with ``until`` queries have ``until`` and items ``t``, and an
    item counts if ``t <= until``. Vectors that are null, of another length, zero or not finite match nothing.
    """
    spark = items.sparkSession
    key = queries.schema["query"].dataType.simpleString()
    ident = items.schema["id"].dataType.simpleString()
    extra = [*(["group"] if group else []), *(["until"] if until else [])]
    asked = queries.select("query", F.col("v").cast("array<double>").alias("v"), *extra)
    rows = items.select("id", F.col("v").cast("array<double>").alias("v"), F.col("kind").cast("string").alias("kind"), *(["group"] if group else []), *(["t"] if until else []))
    total = asked.count()
    schema = f"query {key}, id {ident}, kind string, score double"
    blocks = max(1, -(-total // BLOCK))
    numbered = asked.withColumn("__b", F.expr(f"pmod(xxhash64(query), {blocks})"))
    out = None
    for b in range(blocks):
        block = numbered.where(F.col("__b") == b).drop("__b").toArrow()  # about BLOCK rows
        at, q = _unit(block.column("v"), dim)
        block = block.take(pa.array(at))
        shared = spark.sparkContext.broadcast((block.column("query").to_pylist(), q, block.column("group").to_pylist() if group else None, np.array(block.column("until").to_pylist(), float) if until else None))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, groups, limits = shared.value
            code = {g: n for n, g in enumerate(dict.fromkeys(groups))} if groups is not None else {}
            own = np.array([code[g] for g in groups]) if groups is not None else None
            for batch in batches:
                at, x = _unit(batch.column("v"), dim)
                if not len(at) or not len(names):
                    continue
                ids, kinds = batch.column("id").take(pa.array(at)).to_pylist(), batch.column("kind").take(pa.array(at)).to_pylist()
                score = np.round(q @ x.T, digits)
                ok = score >= floor
                if groups is not None:
                    theirs = np.array([code.get(g, -1) for g in batch.column("group").take(pa.array(at)).to_pylist()])
                    ok &= own[:, None] == theirs[None, :]
                if limits is not None:
                    ok &= np.array(batch.column("t").take(pa.array(at)).to_pylist(), float)[None, :] <= limits[:, None]
                by_id = np.array(sorted(range(len(ids)), key=lambda i: ids[i]))
                kind_code = {x: n for n, x in enumerate(dict.fromkeys(kinds))}
                kind_of = np.array([kind_code[x] for x in kinds])
                for lo in range(0, len(names), 256):
                    picked: list[tuple[int, int]] = []
                    for n in range(lo, min(lo + 256, len(names))):
                        order = by_id[ok[n, by_id]]
                        order = order[np.argsort(-score[n, order], kind="stable")]
                        if per_kind:
                            seen = np.zeros(len(kind_code), int)
                            for i in order:
                                if seen[kind_of[i]] < k:
                                    seen[kind_of[i]] += 1
                                    picked.append((n, i))
                        else:
                            picked += [(n, i) for i in order[:k]]
                    if picked:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([names[n] for n, _ in picked]), pa.array([ids[i] for _, i in picked]), pa.array([kinds[i] for _, i in picked], pa.string()), pa.array([float(score[n, i]) for n, i in picked])], names=["query", "id", "kind", "score"]
                        )

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    over = "query, kind" if per_kind else "query"
    return out.selectExpr("*", f"row_number() OVER (PARTITION BY {over} ORDER BY score DESC, id) AS rank").where(f"rank <= {k}")


def extremes(queries: DataFrame, items: DataFrame, k: int, *, dim: int, digits: int = 9) -> DataFrame:
    """(query, id, score, rank, low, high): the ``k`` items of highest cosine for each query, ties by id, and its lowest and highest cosine of all items.

    ``queries`` (query, v), ``items`` (id, v). Vectors that are null, of another length, zero or not finite have a cosine of 0 with all others.
    """
    spark = items.sparkSession
    key, ident = queries.schema["query"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    asked = queries.select("query", F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for b in range(blocks):
        block = asked.where(F.expr(f"pmod(xxhash64(query), {blocks}) = {b}")).toArrow()  # about BLOCK rows
        shared = spark.sparkContext.broadcast((block.column("query").combine_chunks(), whole_unit(block.column("v"), dim)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            n, kind = len(names), None
            low, high = np.full(n, np.inf), np.full(n, -np.inf)
            best, who = np.full((n, k), -np.inf), [[]] * n
            for batch in batches:
                x, ids, kind = whole_unit(batch.column("v"), dim), batch.column("id").to_pylist(), batch.schema.field("id").type
                place = np.empty(len(ids), np.int64)
                place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
                for lo in range(0, n if len(ids) else 0, 256):
                    score = np.round(q[lo : lo + 256] @ x.T, digits)
                    low[lo : lo + 256], top = np.minimum(low[lo : lo + 256], score.min(1)), score.max(1)
                    high[lo : lo + 256] = np.maximum(high[lo : lo + 256], top)
                    for i in np.flatnonzero(top >= best[lo : lo + 256, -1]):
                        own, least = score[i], best[lo + i, -1]
                        if len(own) > k:
                            least = max(least, np.partition(own, -k)[-k])
                        some = np.flatnonzero(own >= least)
                        some = some[np.lexsort((place[some], -own[some]))][:k]
                        both = sorted([*zip(-best[lo + i], who[lo + i]), *((-own[j], ids[j]) for j in some)])[:k]
                        who[lo + i] = [name for _, name in both]
                        best[lo + i, : len(both)] = [-s for s, _ in both]
            if kind is not None and n:
                sizes = [len(w) for w in who]
                at = np.repeat(np.arange(n), sizes)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(at)), pa.array([name for w in who for name in w], kind), pa.array(np.concatenate([best[i, :m] for i, m in enumerate(sizes)])), pa.array(low[at]), pa.array(high[at])], names=["query", "id", "score", "low", "high"]
                )

        part = items.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(search, f"query {key}, id {ident}, score double, low double, high double")
        out = part if out is None else out.unionByName(part)
    ranked = out.selectExpr("query", "id", "score", "row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank", "min(low) OVER (PARTITION BY query) AS low", "max(high) OVER (PARTITION BY query) AS high")
    return ranked.where(f"rank <= {k}")


def whole_unit(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of all rows; zeros where ``_unit`` has none."""
    at, x = _unit(column, dim)
    out = np.zeros((len(column), dim))
    out[at] = x
    return out


def softmax_mass(queries: DataFrame, items: DataFrame, temperature: float, *, dim: int, digits: int = 9) -> DataFrame:
    """(query, log_mass): the logarithm of the sum over all other items of exp(cosine / temperature).

    ``queries`` (query, v), ``items`` (id, v); an item of the query's own id does not count. Tasks send one row for each query and batch.
    """
    spark = items.sparkSession
    key = queries.schema["query"].dataType.simpleString()
    asked = queries.select("query", F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for b in range(blocks):
        block = asked.where(F.expr(f"pmod(xxhash64(query), {blocks}) = {b}")).toArrow()  # about BLOCK rows
        at, q = _unit(block.column("v"), dim)
        shared = spark.sparkContext.broadcast((np.array(block.column("query").take(pa.array(at)).to_pylist()), q))

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for batch in batches:
                at, x = _unit(batch.column("v"), dim)
                if len(at) and len(names):
                    s = np.round(q @ x.T, digits) / temperature
                    s[names[:, None] == np.array(batch.column("id").take(pa.array(at)).to_pylist())[None, :]] = -np.inf
                    top = s.max(1)
                    some = np.isfinite(top)
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(top[some]), pa.array(np.exp(s[some] - top[some, None]).sum(1))], names=["query", "top", "mass"])

        part = items.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(add, f"query {key}, top double, mass double")
        out = part if out is None else out.unionByName(part)
    peaks = out.groupBy("query").agg(F.max("top").alias("peak"))
    return out.join(peaks, "query").groupBy("query", "peak").agg(F.sum(F.expr("mass * exp(top - peak)")).alias("mass")).selectExpr("query", "peak + ln(mass) AS log_mass")
