"""Near-duplicate texts: word shingles, an exact prefix filter, exact check, components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.runtime import cut

NGRAM, SLOTS, CHUNKS, PARTS, FINE = 5, 1 << 22, 64, 16, 512
BITS, TEXTS = 52, (1 << 12) - 1  # of a hash; texts whose hashes are sorted at once
FLUSH, BUCKET = 1 << 20, 1 << 19  # shingles counted or signatures held by a task at once, signatures of a bucket
_WORD = re.compile(r"\w+")


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``BITS`` bits of the runs of five words of each text, in order, and where each text's begin; a shorter text is one shingle, a text without words none."""
    import xxhash

    if len(texts) > TEXTS:
        made = [shingle_sets(texts[i : i + TEXTS]) for i in range(0, len(texts), TEXTS)]
        return np.concatenate([h for h, _ in made]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in made]))])
    found = [_WORD.findall(t.lower()) for t in texts]
    n = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array(chain.from_iterable(found), pa.string(), size=int(n.sum())).dictionary_encode()
    one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = np.concatenate([one[coded.indices.to_numpy()] if len(one) else one, np.zeros(NGRAM, np.uint64)])
    run = np.minimum(n, NGRAM)
    made = np.where(n > 0, n - run + 1, 0)
    doc = np.repeat(np.arange(len(n)), made)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + np.repeat(np.cumsum(n) - n, made)
    size = run[doc]
    h = size.astype(np.uint64)
    for j in range(NGRAM):
        h = np.where(size > j, (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[at + j], h)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    # sorted as single numbers, with the text in front
    both = np.sort((doc.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return both & np.uint64((1 << BITS) - 1), np.searchsorted(both, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(BITS))


def shingle_hashes(text: str) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text])[0]


def set_codes(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number for each set of shingles."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(h[i:j].tobytes()) for i, j in zip(ends, ends[1:])), np.uint64, len(ends) - 1).view(np.int64)


def prefixes(h: np.ndarray, ends: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place, signature): the rarest shingles of each set, one of which it shares with every set whose Jaccard similarity reaches the threshold.

    A signature is a shingle's count and 32 bits of its hash; shingles that agree in both count as often as they come, which adds candidates and takes none.
    """
    n, out = np.diff(ends), []
    # 1e-9 against products such as 0.8 * 5 that come out above the true number
    most = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    for k in range(0, len(n), TEXTS):
        last = min(len(n), k + TEXTS)
        some, start = h[ends[k] : ends[last]], ends[k:last] - ends[k]
        doc = np.repeat(np.arange(len(start)), n[k:last])
        rare = np.minimum(counts[(some % np.uint64(len(counts))).astype(np.int64)], (1 << BITS - 32) - 1).astype(np.uint64)
        both = np.sort((doc.astype(np.uint64) << np.uint64(BITS)) | (rare << np.uint64(32)) | (some & np.uint64(0xFFFFFFFF)))
        place = np.arange(len(some)) - start[doc]
        kept = place < most[k + doc]
        out.append((k + doc[kept], place[kept], both[kept] & np.uint64((1 << BITS) - 1)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def in_parts(h: np.ndarray, ends: np.ndarray, parts: int) -> np.ndarray:
    """How many shingles of each set lie in each part of the hashes; to cut numbers off brings sets nearer, never farther apart."""
    n, shift = np.diff(ends), BITS - parts.bit_length() + 1
    at = np.repeat(np.arange(len(n)), n) * parts + (h >> np.uint64(shift)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=len(n) * parts), 255).astype(np.uint8).reshape(-1, parts)


def packed(*columns: np.ndarray) -> bytes:
    return b"".join(len(z).to_bytes(4, "little") + z for z in (pa.compress(np.ascontiguousarray(c).tobytes(), "zstd", asbytes=True) for c in columns))


def unpacked(blob: bytes, n: int, kinds: list[tuple]) -> list[np.ndarray]:
    out, at = [], 0
    for kind, width in kinds:
        size = int.from_bytes(blob[at : at + 4], "little")
        raw = pa.decompress(blob[at + 4 : at + 4 + size], n * width * np.dtype(kind).itemsize, "zstd", asbytes=True)
        out.append(np.frombuffer(raw, kind).reshape((n, width) if width > 1 else n))
        at += 4 + size
    return out


_SIGNATURE = [(np.uint32, 1), (np.int64, 1), (np.int32, 1), (np.uint16, 1), (np.uint8, PARTS)]


def alike_candidates(h: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, parts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that share a signature and that no bound keeps apart: sizes, places of the shingle, and numbers of shingles in ``PARTS`` parts."""
    order = np.lexsort((node, size, h))
    h, node, size, place, parts = h[order], node[order], size[order].astype(np.int64), place[order].astype(np.int64), parts[order].astype(np.int16)
    # equal texts and equal sets are one node
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
    h, node, size, place, parts = h[once], node[once], size[once], place[once], parts[once]
    low, high, i, d = [], [], np.arange(len(h)), 1
    while len(i := i[i + d < len(h)]):
        # rows of a shingle stand by size: whoever is too small for this row is so for all later ones
        i = i[(h[i] == h[i + d]) & (size[i] >= threshold * size[i + d] - 1e-9)]
        for some in np.array_split(i, len(i) // FLUSH + 1):
            j = some + d
            need = threshold / (1 + threshold) * (size[some] + size[j]) - 1e-6
            fit = 1 + np.minimum(size[some] - place[some] - 1, size[j] - place[j] - 1) >= need
            some, j, need = some[fit], j[fit], need[fit]
            apart = np.abs(parts[some] - parts[j]).sum(1, dtype=np.int64)
            fit = (size[some] + size[j] - apart) / 2 >= need
            low.append(np.minimum(node[some], node[j])[fit])
            high.append(np.maximum(node[some], node[j])[fit])
        d += 1
    if not low:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(low), np.concatenate(high)]), axis=1)
    return both[0], both[1]


def near_duplicates(docs: DataFrame, doc_id: str, text: str, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, links): every document with the smallest id of its class and its number of links to other texts.

    Exact copies are one node, and so are texts of equal shingles. Two sets of shingles that reach the threshold share a shingle
    among the first of each, in any one order of all shingles: so no pair is missed. The order puts rare shingles first, as
    counted in ``SLOTS`` slots of their hashes; it decides only how many candidates there are. Texts stay where they are read:
    signatures move, packed by the batch, to buckets of their hashes, with what bounds the similarity of two sets from above; only texts of
    candidates move, to be checked by exact Jaccard similarity of their shingles. Texts without words are classes of their own unless equal.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id IS NOT NULL")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["id", "key", "node", "size", "chunk", "seen"]
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            h, ends = shingle_sets(texts)
            total += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
            keys = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
            none = pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array(set_codes(h, ends)), pa.array(np.diff(ends), pa.int32()), *none], names=names)
        # the order may take all above as equal
        parts = np.minimum(total, 65_535).astype(np.uint16).reshape(CHUNKS, -1)
        at = [c for c in range(CHUNKS) if parts[c].any()]
        void = pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32())
        yield pa.RecordBatch.from_arrays([*void, pa.array(at, pa.int32()), pa.array([packed(parts[c]) for c in at], pa.binary())], names=names)

    made = cut(rows.mapInArrow(read, "id bigint, key binary, node bigint, size int, chunk int, seen binary"))
    signed = made.where("chunk IS NULL").drop("chunk", "seen")

    def added(group: pa.Table) -> pa.Table:
        total = sum(unpacked(x, SLOTS // CHUNKS, [(np.uint16, 1)])[0].astype(np.uint32) for x in group.column("seen").to_pylist())
        return pa.table({"chunk": group.column("chunk")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint32)
    # 16 MB at most
    whole = made.where("chunk IS NOT NULL").select("chunk", "seen").groupBy("chunk").applyInArrow(added, "chunk int, n binary").toArrow()
    for c, n in zip(*(x.to_pylist() for x in whole.columns)):
        counts[c] = np.frombuffer(n, np.uint32)
    shared = spark.sparkContext.broadcast(counts.reshape(-1))
    told = signed.where("size > 0").agg(F.sum(F.expr(f"size - ceil({threshold}D * size - 1e-9D) + 1"))).first()[0] or 0
    buckets = int(max(16, told // BUCKET + 1))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            h, *rest = (np.concatenate(x) for x in zip(*held))
            held.clear()
            bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(at))
            columns = [x[order] for x in ((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), *rest)]
            blobs = [packed(*(x[at[b] : at[b + 1]] for x in columns)) for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.diff(at)[some], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "n", "blob"])

        for batch in batches:
            h, ends = shingle_sets(batch.column(0).to_pylist())
            doc, place, first = prefixes(h, ends, shared.value, threshold)
            held.append((first, set_codes(h, ends)[doc], np.diff(ends)[doc].astype(np.int32), np.minimum(place, 65_535).astype(np.uint16), in_parts(h, ends, PARTS)[doc]))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        read = [unpacked(x, n, _SIGNATURE) for x, n in zip(group.column("blob").to_pylist(), group.column("n").to_pylist())]
        a, b = alike_candidates(*(np.concatenate(x) for x in zip(*read)), threshold)
        return pa.table({"a": a, "b": b})

    pairs = cut(rows.select("text").mapInArrow(sign, "bucket int, n int, blob binary").groupBy("bucket").applyInArrow(meet, "a bigint, b bigint").distinct())
    alike = cut(signed.where("size > 0").groupBy("node", "key").agg(F.min("id").alias("low")).groupBy("node").agg(F.min("low").alias("low"), F.count("*").alias("copies")))

    def chosen(pairs: DataFrame, make, columns: str) -> DataFrame:
        """Of each text of ``pairs``, found by one bit for each slot of ids, what ``make`` makes of the sets and texts of a batch."""
        ends = pairs.selectExpr("explode(array(a, b)) AS node").distinct().join(alike, "node")
        bits = np.zeros(SLOTS, bool)
        bits[ends.selectExpr(f"pmod(low, {SLOTS}) AS slot").distinct().toArrow().column(0).to_numpy()] = True
        wanted = spark.sparkContext.broadcast(np.packbits(bits))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(wanted.value).astype(bool)
            for batch in batches:
                batch = batch.filter(pa.array(bits[batch.column(0).to_numpy() % SLOTS]))
                h, at = shingle_sets(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(set_codes(h, at)), make(h, at, batch.column(1))], names=["node", "it"])

        return rows.mapInArrow(pick, f"node bigint, it {columns}").join(ends.select("node"), "node", "left_semi").dropDuplicates(["node"])

    def beside(pairs: DataFrame, found: DataFrame) -> DataFrame:
        return pairs.join(found.selectExpr("node AS a", "it AS x"), "a").join(found.selectExpr("node AS b", "it AS y"), "b").select("a", "b", "x", "y")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE + 4) for c in (2, 3))
            n = sum(np.ascontiguousarray(v[:, FINE:]).view(np.int32)[:, 0].astype(np.int64) for v in (x, y))
            apart = np.abs(x[:, :FINE].astype(np.int16) - y[:, :FINE]).sum(1, dtype=np.int64)
            yield batch.filter(pa.array((n - apart) / 2 >= threshold / (1 + threshold) * n - 1e-6)).select([0, 1])

    def fine(h: np.ndarray, at: np.ndarray, texts: pa.Array) -> pa.Array:
        return pa.array([p.tobytes() + int(n).to_bytes(4, "little") for p, n in zip(in_parts(h, at, FINE), np.diff(at))], pa.binary())

    # what counts in more parts can't keep apart is compared
    pairs = cut(beside(pairs, cut(chosen(pairs, fine, "binary"))).mapInArrow(near, "a bigint, b bigint"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, i), (y, j) = (shingle_sets(batch.column(c).to_pylist()) for c in (2, 3))
            common = np.array([len(np.intersect1d(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]], assume_unique=True)) for k in range(batch.num_rows)], np.int64)
            ok = common >= threshold * (np.diff(i) + np.diff(j) - common)
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    kept = beside(pairs, chosen(pairs, lambda h, at, texts: texts, "string")).mapInArrow(similar, "a bigint, b bigint")
    edges = cut(kept.join(alike.selectExpr("node AS a", "low AS la"), "a").join(alike.selectExpr("node AS b", "low AS lb"), "b").selectExpr("a AS na", "b AS nb", "la AS a", "lb AS b"))
    classes = components(edges.select("a", "b")).selectExpr("id AS low", "component")
    # a link to a set is one to each of its texts
    far = edges.select(F.expr("inline(array(struct(na AS node, nb AS far), struct(nb AS node, na AS far)))")).join(alike.selectExpr("node AS far", "copies AS c"), "far").groupBy("node").agg(F.sum("c").alias("links"))
    sums = alike.join(far, "node", "left").join(classes, "low", "left").selectExpr("node", "coalesce(component, low) AS class_id", "copies - 1 + coalesce(links, 0L) AS links")
    placed = signed.where("size > 0").join(sums, "node").selectExpr("id AS doc_id", "class_id", "links")
    bare = signed.where("size = 0").select("id", "key")
    alone = bare.join(bare.groupBy("key").agg(F.min("id").alias("class_id")), "key").selectExpr("id AS doc_id", "class_id", "0L AS links")
    return placed.unionByName(alone)
