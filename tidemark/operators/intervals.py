"""Merging intervals per entity into continuous periods, and listing the gaps between them.

The state of an entity is a sorted list of disjoint intervals. Three levels build it: every Arrow batch
makes partial lists where the rows lie; partial lists with the same salt are merged; the salted lists of an
entity are merged and turned into periods and gaps. A key that holds a third of all rows thus costs its
tasks only the lists, whose length the clock bounds (a day has at most 43,200 disjoint, not touching
intervals of whole seconds), never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16  # salts of the middle level of the tree
STARTS, ENDS, SALT = "__starts", "__ends", "__salt"


def linear_merge(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals of every code, ordered by code and start; touching ones become one.

    The stable sort is linear on input that consists of sorted runs, as partial lists do.
    """
    if not len(code):
        return code, start, end
    order = np.argsort(start, kind="stable")
    order = order[np.argsort(code[order], kind="stable")]
    code, start, end = code[order], start[order], end[order]
    low = int(min(start.min(), end.min()))
    span = int(max(start.max(), end.max())) - low + 2
    if span * (int(code[-1]) + 1) < 2**62:
        reach = np.maximum.accumulate(code * span + (end - low)) - code * span + low
    else:
        reach = np.concatenate([np.maximum.accumulate(part) for part in np.split(end, np.flatnonzero(np.diff(code)) + 1)])
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(first)
    return code[at], start[at], reach[np.append(at[1:], len(code)) - 1]


class _Lists:
    """Partial lists of many keys, merged pairwise like the carries of a binary counter."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys
        self.levels: list[tuple[int, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, names: pd.DataFrame, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        made = self._merge(names, row, start, end)
        level = 0
        while self.levels and self.levels[-1][0] == level:
            made = self._join(self.levels.pop()[1:], made)
            level += 1
        self.levels.append((level, *made))

    def _merge(self, names, row, start, end):
        code = names.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()
        firsts = np.unique(code, return_index=True)[1]
        c, s, e = linear_merge(code[row], start, end)
        return names.iloc[firsts].reset_index(drop=True), c, s, e

    def _join(self, a, b):
        names = pd.concat([a[0], b[0]], ignore_index=True)
        return self._merge(names, np.concatenate([a[1], b[1] + len(a[0])]), np.concatenate([a[2], b[2]]), np.concatenate([a[3], b[3]]))

    def result(self):
        made = None
        while self.levels:
            top = self.levels.pop()[1:]
            made = top if made is None else self._join(top, made)
        return made


    def size(self) -> int:
        return sum(len(x[3]) for x in self.levels)


def _names(batch: pa.RecordBatch, keys: list[str]) -> pd.DataFrame:
    return batch.select(keys).to_pandas(integer_object_nulls=True)


def _state(batch: pa.RecordBatch):
    starts, ends = batch.column(STARTS), batch.column(ENDS)
    row = np.repeat(np.arange(batch.num_rows), np.diff(starts.offsets.to_numpy()))
    return row, starts.flatten().to_numpy().astype("int64"), ends.flatten().to_numpy().astype("int64")


def _lists(made, fields: list[pa.Field], salt: int | None, chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of at most ``chunk`` intervals of one key each."""
    names, code, start, end = made
    first = np.searchsorted(code, np.arange(len(names)))
    begin = np.flatnonzero((np.arange(len(code)) - first[code]) % chunk == 0)
    for lo in range(0, len(begin), 2048):
        rows = begin[lo : lo + 2048]
        upto = int(begin[lo + 2048]) if lo + 2048 < len(begin) else len(code)
        offsets = np.append(rows, upto).astype("int64") - rows[0]
        picked = names.iloc[code[rows]]
        columns = [pa.array(picked[f.name], type=f.type, from_pandas=True) for f in fields]
        columns += [pa.ListArray.from_arrays(offsets.astype("int32"), pa.array(x[rows[0] : upto])) for x in (start, end)]
        out = [f.name for f in fields] + [STARTS, ENDS]
        if salt is not None:
            columns.append(pa.array(np.full(len(rows), salt, "int32")))
            out.append(SALT)
        yield pa.RecordBatch.from_arrays(columns, names=out)


def _changes(names: pd.DataFrame) -> np.ndarray:
    """Which rows have other keys than the row before; nulls are equal."""
    out = np.zeros(len(names), bool)
    out[:1] = True
    for k in names.columns:
        v, w = names[k].iloc[1:].reset_index(drop=True), names[k].iloc[:-1].reset_index(drop=True)
        out[1:] |= ((v != w) & ~(v.isna() & w.isna())).to_numpy(dtype=bool)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """(names, code, start, end, fields) of merged lists, from partial lists sorted by key: some keys at a time, each once and whole."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fields = [batch.schema.field(k) for k in keys]
        names = _names(batch, keys)
        row, start, end = _state(batch)
        change = _changes(names)
        code = (np.cumsum(change) - 1)[row]
        names = names[change].reset_index(drop=True)
        if held is not None:
            both = pd.concat([held[0], names.iloc[:1]], ignore_index=True)
            if _changes(both)[1]:
                names, code = pd.concat([held[0], names], ignore_index=True), code + 1
            code, start, end = np.concatenate([np.zeros(len(held[1]), code.dtype), code]), np.concatenate([held[1], start]), np.concatenate([held[2], end])
        code, start, end = linear_merge(code, start, end)
        # the last key may go on in the next batch
        upto = np.searchsorted(code, len(names) - 1)
        if upto:
            yield names.iloc[:-1], code[:upto], start[:upto], end[:upto], fields
        held = names.iloc[-1:], start[upto:], end[upto:]
    if held is not None:
        yield held[0], np.zeros(len(held[1]), int), held[1], held[2], fields


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gaps: bool = True, chunk: int = 512, flush: int = 1 << 20) -> DataFrame:
    """Periods covered without interruption, and gaps between consecutive ones, for each combination of ``keys``.

    Result: ``keys``, ``kind`` (``period`` or ``gap``), ``start``, ``end`` (bigint). A task holds at most about ``flush`` intervals
    where rows lie, and the list of one key and one batch of rows of ``chunk`` intervals where lists are merged.

    Defined cases: rows with a null start or end, or whose end is not later than their start, are no
    intervals and are ignored; a null in a key is a value of its own; intervals that touch are one period;
    repeated rows change nothing; an empty table gives an empty result; other columns, whatever their
    names, do not matter.
    """
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    rows = df.select(*[F.col(f"`{k}`") for k in keys], s.alias(STARTS), e.alias(ENDS)).where(F.col(STARTS) < F.col(ENDS))
    key_schema = rows.select(*[F.col(f"`{k}`") for k in keys]).schema
    state_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in key_schema), f"{STARTS} array<bigint>", f"{ENDS} array<bigint>"])
    salted_schema = f"{state_schema}, {SALT} int"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % FAN_IN
        lists, kind = _Lists(keys), None
        for batch in batches:
            if batch.num_rows:
                kind = [batch.schema.field(k) for k in keys]
                lists.add(_names(batch, keys), np.arange(batch.num_rows), batch.column(STARTS).to_numpy(), batch.column(ENDS).to_numpy())
                if lists.size() > flush:
                    yield from _lists(lists.result(), kind, salt, chunk)
        if lists.levels:
            yield from _lists(lists.result(), kind, salt, chunk)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *made, kind in _runs(batches, keys):
            yield from _lists(made, kind, None, chunk)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, code, first, last, kind in _runs(batches, keys):
            same = code[1:] == code[:-1]
            parts = [("period", code, first, last)]
            if gaps:
                parts.append(("gap", code[1:][same], last[:-1][same], first[1:][same]))
            for what, c, a, b in parts:
                for lo in range(0, len(c), 65536):
                    cut = slice(lo, lo + 65536)
                    picked = names.iloc[c[cut]]
                    columns = [pa.array(picked[f.name], type=f.type, from_pandas=True) for f in kind]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([what] * len(picked)), pa.array(a[cut]), pa.array(b[cut])], names=[*keys, "kind", "start", "end"])

    # sorted partitions spill, and give each key's lists one after the other
    by = [F.col(f"`{k}`") for k in keys]
    lists = rows.mapInArrow(partial, salted_schema)
    lists = lists.repartition(*by, F.col(SALT)).sortWithinPartitions(*by).drop(SALT).mapInArrow(combine, state_schema)
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in key_schema), "kind string, start bigint, end bigint"])
    return lists.repartition(*by).sortWithinPartitions(*by).mapInArrow(finish, out_schema)
