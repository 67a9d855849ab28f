"""The k most similar vectors for every vector, by score-aware quantisation.

A partition of the sphere sends every vector to one cell as a candidate and to its few nearest cells as a
query. Cells grow in number with the vectors: beyond what a sample can fit, each coarse cell is split by one
codebook of offsets that all share, so that a cell holds about the same number of vectors whatever their number.
In a cell the candidates' residuals from the centroid are quantised to four bits for every four
dimensions; the codes minimise a loss in which the part of the error parallel to the vector, the part
that changes large inner products, weighs more. Queries score all candidates of the cell by table look-ups
over the codes, and the best are ranked again by their exact cosine.

The model (centroids, offsets and code words) is fitted on a bounded sample and small; every row is indexed and queried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 16_384  # vectors that the model is fitted on, about
BOOK_SAMPLE = 8_192  # of them, so many for the code words
WORDS = 16  # code words of a subspace: four bits
SUBSPACE = 4
COPIES = 6  # of identical vectors, so many take part in the search; k below must be smaller


@dataclass
class Model:
    centroids: np.ndarray  # coarse cells x dim
    offsets: np.ndarray  # by how much the cells of a coarse cell lie beside its centroid; one offset of zero if there is but one
    books: np.ndarray  # subspaces x WORDS x SUBSPACE
    eta: float
    blocks: np.ndarray  # into how many blocks each cell is cut

    def centre(self, cell: int) -> np.ndarray:
        return self.centroids[cell // len(self.offsets)] + self.offsets[cell % len(self.offsets)]

    def cells(self, x: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """(own, near): the cell of each unit vector and the ``many`` nearest ones, its own first."""
        n, k = len(self.centroids), len(self.offsets)
        sims = x @ self.centroids.T
        if k == 1:
            near = np.argpartition(-sims, many - 1, axis=1)[:, :many] if many < n else np.argsort(-sims, axis=1)
            own = sims.argmax(1)
            # its own cell first, the others as they come
            near = np.where(near == near[:, :1], own[:, None], np.where(near == own[:, None], near[:, :1], near)) if many > 1 else own[:, None]
            return own, near
        coarse = min(n, max(2, many))
        if len(x) > (rows := max(1, (1 << 22) // (coarse * k))):
            parts = [self.cells(x[lo : lo + rows], many) for lo in range(0, len(x), rows)]
            return tuple(np.concatenate(p) for p in zip(*parts))
        wide = np.argpartition(-sims, coarse - 1, axis=1)[:, :coarse] if coarse < n else np.argsort(-sims, axis=1)
        top = sims.argmax(1)
        # |x - c - o|^2 without what is the same for all cells
        far = (self.centroids**2).sum(1)[wide][:, :, None] - 2 * np.take_along_axis(sims, wide, 1)[:, :, None]
        far = far + (self.offsets**2).sum(1) - 2 * (x @ self.offsets.T)[:, None, :] + 2 * (self.centroids @ self.offsets.T)[wide]
        cell = wide[:, :, None] * k + np.arange(k)
        at_home = np.where((wide == top[:, None])[:, :, None], far, np.inf).reshape(len(x), -1)
        flat, names = far.reshape(len(x), -1), cell.reshape(len(x), -1)
        home = at_home.argmin(1)
        own = names[np.arange(len(x)), home]
        flat[np.arange(len(x)), home] = -np.inf
        near = np.take_along_axis(names, np.argsort(flat, axis=1)[:, :many], 1)
        return own, near


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = (x @ centers.T).argmax(1)
        order = np.argsort(at, kind="stable")
        held, first = np.unique(at[order], return_index=True)
        sums = np.zeros_like(centers)
        sums[held] = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        # a centre that lost all its vectors starts again elsewhere
        lost = norm[:, 0] < 1e-9
        sums[lost] = x[rng.choice(len(x), int(lost.sum()))]
        norm[lost] = np.linalg.norm(sums[lost], axis=1, keepdims=True)
        centers = sums / np.maximum(norm, 1e-9)
    return centers.astype("float32")


def encode(r: np.ndarray, x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes of residuals ``r`` of unit vectors ``x`` by coordinate descent on the anisotropic loss

    |e|^2 + (eta - 1) (e . x)^2, where e is the error that the codes leave.
    """
    n, m = len(r), len(books)
    rs, xs = r.reshape(n, m, SUBSPACE), x.reshape(n, m, SUBSPACE)
    codes = np.empty((n, m), np.uint8)
    parallel = np.empty((n, m), np.float32)
    plain, along = [], []
    for j in range(m):
        near = ((rs[:, j] ** 2).sum(1, keepdims=True) - 2 * rs[:, j] @ books[j].T) + (books[j] ** 2).sum(1)
        side = (rs[:, j] * xs[:, j]).sum(1, keepdims=True) - xs[:, j] @ books[j].T
        plain.append(near)
        along.append(side)
        codes[:, j] = near.argmin(1)
        parallel[:, j] = side[np.arange(n), codes[:, j]]
    rows = np.arange(n)
    total = parallel.sum(1)
    for _ in range(rounds):
        for j in range(m):
            rest = total - parallel[:, j]
            codes[:, j] = (plain[j] + (eta - 1) * (rest[:, None] + along[j]) ** 2).argmin(1)
            parallel[:, j] = along[j][rows, codes[:, j]]
            total = rest + parallel[:, j]
    return codes


def fit_books(r: np.ndarray, x: np.ndarray, eta: float, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Code words of every subspace: encoding and weighted least squares in turn."""
    rng = np.random.default_rng(seed)
    n, m = len(r), r.shape[1] // SUBSPACE
    rs, xs = r.reshape(n, m, SUBSPACE), x.reshape(n, m, SUBSPACE)
    books = np.stack([rs[rng.choice(n, WORDS, replace=n < WORDS), j] for j in range(m)]).astype("float32")
    for _ in range(rounds):
        codes = encode(r, x, books, eta)
        left = rs - books[np.arange(m)[None, :], codes]
        parallel = (left * xs).sum(2)
        total = parallel.sum(1)
        for j in range(m):
            rest = total - parallel[:, j]
            for w in range(WORDS):
                own = codes[:, j] == w
                if own.sum() < SUBSPACE:
                    continue
                xo, ro = xs[own, j].astype(float), rs[own, j].astype(float)
                a = own.sum() * np.eye(SUBSPACE) + (eta - 1) * xo.T @ xo
                b = ro.sum(0) + (eta - 1) * (xo * (rest[own] + (xo * ro).sum(1))[:, None]).sum(0)
                books[j, w] = np.linalg.solve(a, b)
    return books


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 13) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
        order = np.argsort(at, kind="stable")
        held, first, size = np.unique(at[order], return_index=True, return_counts=True)
        centers[held] = np.add.reduceat(x[order], first, axis=0) / size[:, None]
    return centers.astype("float32")


def fit(sample: np.ndarray, total: float, cell_rows: int, block_rows: int, threshold: float, most_coarse: int = 0) -> Model:
    """``total`` is the number of rows that the sample stands for; ``most_coarse`` bounds the coarse cells, by default to one for 16 sampled vectors."""
    dim = sample.shape[1]
    wanted = max(1, round(total / cell_rows))
    k = int(min(wanted, most_coarse or max(1, len(sample) // 16)))
    centroids = spherical_kmeans(sample, k)
    offsets = np.zeros((1, dim), np.float32)
    split = math.ceil(wanted / k)
    if split > 1:
        at = (sample @ centroids.T).argmax(1)
        offsets = kmeans(sample - centroids[at], min(split, max(1, len(sample) // 16)))
    model = Model(centroids, offsets, np.zeros((0, WORDS, SUBSPACE)), 1.0, np.ones(len(centroids) * len(offsets), int))
    at = model.cells(sample, 1)[0]
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    few = slice(None, BOOK_SAMPLE)  # the sample is shuffled, so its head is a sample of it
    left = sample - centroids[at // len(offsets)] - offsets[at % len(offsets)]
    books = fit_books(left[few], sample[few], eta)
    sizes = np.bincount(at, minlength=len(centroids) * len(offsets)) * (total / len(sample))
    return Model(centroids, offsets, books, eta, np.maximum(1, np.ceil(sizes / block_rows)).astype(int))


def scan(q: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate inner products of queries with coded residuals, from look-up tables.

    Two four-bit codes share a byte, so that one look-up in a table of 256 sums covers eight dimensions.
    """
    m = len(books)
    tables = np.einsum("nmd,mwd->nmw", q.reshape(len(q), m, SUBSPACE), books, optimize=True).astype("float32")
    scores = None
    for j in range(0, m, 2):
        if j + 1 < m:
            table = (tables[:, j, :, None] + tables[:, j + 1, None, :]).reshape(len(q), WORDS * WORDS)
            code = codes[:, j].astype(np.intp) * WORDS + codes[:, j + 1]
        else:
            table, code = tables[:, j], codes[:, j].astype(np.intp)
        part = np.take(table, code, axis=1)
        scores = part if scores is None else np.add(scores, part, out=scores)
    return scores


def usable_units(ids, lists, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows whose list holds ``dim`` finite numbers that are not all zero."""
    sizes = np.diff(lists.offsets.to_numpy())
    ok = (sizes == dim) & ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(flat, axis=1, keepdims=True)
        good = np.isfinite(flat).all(1) & (norm[:, 0] > 0)
        unit = (flat / norm)[good].astype(np.float32)
    return ids.take(pa.array(at[good])).to_numpy(zero_copy_only=False).astype(np.int64), unit


def _floats(unit: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, unit.size + 1, unit.shape[1], dtype="int32"), pa.array(unit.ravel()))


def _matrix(column, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest_vectors(vectors: DataFrame, *, vec_id: str, embedding: str, dim: int, k: int = 5, floor: float = -1.0, probes: int = 3, rerank: int = 24, cell_rows: int = 800, block_rows: int = 8_000, threshold: float = 0.2, most_coarse: int = 0) -> DataFrame:
    """(src, dst, cosine, rank): up to k most similar other vectors of every usable vector.

    ``floor`` leaves out neighbours whose cosine is lower. ``probes`` cells are searched for each vector and
    ``rerank`` candidates of each cell get their exact cosine; neighbours found from the other side count too. Where
    coarse cells are split (``most_coarse``), twice as many of the smaller cells are searched.
    Cosines are compared to eight digits, equal ones rank by id. Directions that agree to five digits in each number have a
    cosine of 1 to eight digits; of more than six such vectors those of the six smallest ids take part in the
    search, and each other one has the ``k`` smallest of them as its neighbours, which is what that ranking gives.

    Defined cases: null, short, long, zero and not finite vectors and null ids are left out; rows delivered twice
    count once; an empty table, or one usable vector, gives an empty result; lengths do not matter; other
    columns do not matter.
    """
    if not 0 < k < COPIES:
        raise ValueError(f"k must be between 1 and {COPIES - 1}")
    spark = vectors.sparkSession
    raw = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<float>").alias("v"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit = usable_units(batch.column("id"), batch.column("v"), dim)
            if len(ids):
                key = np.ascontiguousarray(np.round(unit, 5) + np.float32(0)).view(np.uint8).reshape(len(ids), -1)
                import xxhash

                keys = np.array([xxhash.xxh3_64_intdigest(row.tobytes()) for row in key], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), _floats(unit)], names=["id", "key", "v"])

    unit = raw.mapInArrow(units, "id bigint, key bigint, v array<float>")
    # copies: ids only, in groups that partial aggregation keeps at six numbers
    copies = raw.mapInArrow(units, "id bigint, key bigint, v array<float>").select("id", "key").distinct()
    ranked = copies.selectExpr("id", "key", "row_number() OVER (PARTITION BY key ORDER BY id) AS r")
    firsts = ranked.where(f"r <= {COPIES}").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("first")).where(F.size("first") == COPIES)
    followers = copies.join(firsts, "key").where("NOT array_contains(first, id)").select("id", "first")

    total = vectors.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample = raw.where(F.expr(f"pmod(xxhash64(id), {1 << 40}) < {round(share * (1 << 40))}")).limit(2 * SAMPLE).toArrow()
    ids, drawn = usable_units(sample.column("id").combine_chunks(), sample.column("v").combine_chunks(), dim)
    if not len(ids):
        return spark.createDataFrame([], "src bigint, dst bigint, cosine double, rank int")
    # by id, then shuffled with a fixed seed: the same sample whatever the order of the files
    drawn = drawn[np.unique(ids, return_index=True)[1]]
    drawn = drawn[np.random.default_rng(3).permutation(len(drawn))]
    shared = spark.sparkContext.broadcast(fit(drawn, len(drawn) / share, cell_rows, block_rows, threshold, most_coarse))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        many = min(probes * (1 if len(model.offsets) == 1 else 2), len(model.blocks))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, dim)
            own, near = model.cells(x, many)
            row = np.repeat(np.arange(len(ids)), many)
            cell = near.ravel()
            home = cell == own[row]
            # a cell of several blocks: queries of block q meet candidates of block d in the group (cell, q, d)
            n = model.blocks[cell]
            if (n > 1).any():
                again = np.where(n > 1, np.where(home, 2 * n - 1, n), 1)
                row, cell, home, n = (np.repeat(a, again) for a in (row, cell, home, n))
                at = np.arange(len(row)) - np.repeat(np.cumsum(again) - again, again)
            else:
                at = np.zeros(len(row), int)
            block = (ids[row] % n + n) % n
            as_query = at < n
            q = np.where(as_query, block, at - n)
            q = np.where(~as_query & (q >= block), q + 1, q)
            d = np.where(as_query, at, block)
            # in its own (block, block) group a vector at home is both query and candidate
            role = np.where(as_query, np.where(home & (at == block), 3, 1), 2).astype("int8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype("int64")), pa.array(q.astype("int32")), pa.array(d.astype("int32")), pa.array(role), pa.array(ids[row]), _floats(x[row])], names=["cell", "q", "d", "role", "id", "v"]
            )

    def search(group: pa.Table) -> pa.Table:
        model = shared.value
        centre = model.centre(group.column("cell")[0].as_py())
        role, ids, x = group.column("role").to_numpy(), group.column("id").to_numpy(), _matrix(group.column("v"), dim)
        keep = np.unique(ids, return_index=True)[1]
        role, ids, x = role[keep], ids[keep], x[keep]
        have, ask = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
        src, dst, cos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(have) and len(ask):
            db, db_ids = x[have], ids[have]
            codes = encode(db - centre, db, model.books, model.eta)
            many = min(rerank, len(have))
            for lo in range(0, len(ask), 512):
                rows = ask[lo : lo + 512]
                scores = scan(x[rows], codes, model.books)
                top = np.argpartition(-scores, many - 1, axis=1)[:, :many] if many < len(have) else np.tile(np.arange(len(have)), (len(rows), 1))
                exact = np.einsum("nd,nrd->nr", x[rows].astype(float), db[top].astype(float))
                good = (exact >= floor) & (db_ids[top] != ids[rows][:, None])
                at = np.nonzero(good)
                src.append(ids[rows][at[0]])
                dst.append(db_ids[top[at]])
                cos.append(exact[at])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "cosine": np.round(np.concatenate(cos), 8)})

    searched = unit.join(followers.select("id"), "id", "left_anti")
    found = searched.select("id", "v").mapInArrow(assign, "cell bigint, q int, d int, role tinyint, id bigint, v array<float>").groupBy("cell", "q", "d").applyInArrow(search, "src bigint, dst bigint, cosine double")
    both = found.select(F.explode(F.array(F.struct("src", "dst", "cosine"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "cosine"))).alias("x")).select("x.*")
    copied = followers.select(F.col("id").alias("src"), F.posexplode(F.slice("first", 1, k)).alias("rank", "dst"))
    ranked = both.repartition("src").groupBy("src", "dst").agg(F.max("cosine").alias("cosine")).selectExpr("src", "dst", "cosine", "row_number() OVER (PARTITION BY src ORDER BY cosine DESC, dst) AS rank").where(f"rank <= {k}")
    return ranked.unionByName(copied.selectExpr("src", "dst", "1D AS cosine", "rank + 1 AS rank").where(F.lit(1.0 >= floor)))
