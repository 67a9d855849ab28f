"""Packing items into containers of fixed capacity by bounded-space best fit.

Each partition keeps a fixed number of open containers. An item goes to the open container that it fills best;
when none has room and all are open, the fullest is emitted. What stays open at the end of the partitions is
merged, as items of the size used so far, in groups of a bounded number of partitions.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

OPEN = 256
MERGED_PARTITIONS = 64
_ITEMS = pa.list_(pa.struct([("item", pa.int64()), ("piece", pa.int32()), ("size", pa.int64())]))
_ROWS = "container string, capacity bigint, used bigint, items array<struct<item: bigint, piece: int, size: bigint>>, part int"


class BestFit:
    """Open containers ordered by free room; holds at most ``limit`` of them, or any number if that is 0."""

    def __init__(self, capacity: int, limit: int = OPEN) -> None:
        self.capacity, self.limit = capacity, limit
        self.free: list[tuple[int, int]] = []
        self.content: dict[int, list] = {}
        self.made = 0

    def add(self, size: int, items: list) -> list | None:
        """Places a bundle of items; gives the contents of a container that had to be emitted, with its room."""
        out = None
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, k = self.free.pop(at)
            self.content[k].extend(items)
        else:
            if self.limit and len(self.free) >= self.limit:
                room, full = self.free.pop(0)
                out = [full, self.capacity - room, self.content.pop(full)]
            room, k = self.capacity, self.made
            self.made += 1
            self.content[k] = list(items)
        if room > size:
            insort(self.free, (room - size, k))
            return out
        # exactly full: nothing is gained by keeping it open
        full = [k, self.capacity, self.content.pop(k)]
        if out is None:
            return full
        self.spare = full
        return out

    def rest(self) -> list:
        return [[k, self.capacity - room, self.content[k]] for room, k in self.free]


def _batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    """Containers; ``part`` is the partition that left them open, or -1 if they are closed."""
    names, capacities, used, items = zip(*rows)
    lists = [[{"item": i, "piece": p, "size": s} for i, p, s in x] for x in items]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(capacities, pa.int64()), pa.array(used, pa.int64()), pa.array(lists, _ITEMS), pa.array([part] * len(rows), pa.int32())], names=["container", "capacity", "used", "items", "part"])


def pack(items: DataFrame, capacities: list[int], item: str, size: str) -> DataFrame:
    """(capacity, container, item, piece, size): every item in one container of each capacity.

    Only an item larger than the capacity is split: into pieces that fill containers of their own, numbered from 0,
    and a last piece that is packed like an item. The numbers of ``item`` must be whole.

    Defined cases: a null item is left out and a null or negative size is 0; items of size 0 take no room and lie in
    one container of size 0 per partition and capacity; repeated rows are items of their own; an empty table
    gives an empty result; no capacity may be below 1; other columns do not matter.
    """
    if any(c < 1 for c in capacities):
        raise ValueError("capacities must be positive")
    rows = items.select(F.col(f"`{item}`").cast("long").alias("item"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("size")).where("item IS NOT NULL")
    capacities = sorted(set(capacities))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bins = {c: BestFit(c) for c in capacities}
        whole = dict.fromkeys(capacities, 0)
        out: list[tuple] = []
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for c in capacities:
                    if s == 0:
                        out.append((f"{part}-z", c, 0, [(i, 0, 0)]))
                        continue
                    pieces = (s - 1) // c
                    for p in range(pieces):
                        out.append((f"{part}-w{whole[c]}", c, c, [(i, p, c)]))
                        whole[c] += 1
                    left = s - pieces * c
                    closed = bins[c].add(left, [(i, pieces, left)])
                    if closed:
                        out.append((f"{part}-{closed[0]}", c, closed[1], closed[2]))
                    spare = bins[c].__dict__.pop("spare", None)
                    if spare:
                        out.append((f"{part}-{spare[0]}", c, spare[1], spare[2]))
            if len(out) > 4096:
                yield _batch(out, -1)
                out = []
        for lo in range(0, len(out), 4096):
            yield _batch(out[lo : lo + 4096], -1)
        out = [(f"{part}-{k}", c, used, held) for c in capacities for k, used, held in bins[c].rest()]
        for lo in range(0, len(out), 4096):
            yield _batch(out[lo : lo + 4096], part)

    def merge(table: pa.Table) -> pa.Table:
        c = table.column("capacity")[0].as_py()
        group = table.column("group")[0].as_py()
        held = sorted(zip(table.column("used").to_pylist(), table.column("container").to_pylist(), table.column("items").to_pylist()), key=lambda x: (-x[0], x[1]))
        bins, out = BestFit(c, 0), []
        for used, _, inside in held:
            closed = bins.add(used, [(x["item"], x["piece"], x["size"]) for x in inside])
            if closed:
                out.append(closed)
        made = [(f"m{group}-{k}", c, used, inside) for k, used, inside in [*out, *bins.rest()]]
        return pa.Table.from_batches([_batch(made, -1)])

    # one pass; what it leaves open carries its partition's number, and is merged by groups of partitions
    placed = cut(rows.mapInArrow(place, _ROWS))
    left = placed.where("part >= 0").withColumn("group", F.expr(f"part DIV {MERGED_PARTITIONS}"))
    merged = left.groupBy("capacity", "group").applyInArrow(merge, _ROWS)
    return placed.where("part < 0").unionByName(merged).select("capacity", "container", F.inline("items")).select("capacity", "container", "item", "piece", "size")
