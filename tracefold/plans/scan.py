"""Ordered scans over range-sorted rows: running values that cross partitions.

A window function over one key runs in one task, so a key with a third of all
rows would too. Here rows are range-partitioned by key *and* order, so a hot key
spreads over many partitions. One pass leaves a summary per partition (a few
bytes each), the driver combines the summaries in partition order, and a second
pass over the same sorted partitions starts from the carried state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.plans.shared import cut

PID = "_scan_pid"


def changes(batch: pa.RecordBatch, keys: list[str], before: tuple | None):
    """Per row: does its key differ from the row before (``before`` for the first)?"""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    if n == 0:
        return new
    for k in keys:
        col = batch.column(k)
        a, b = col[1:], col[:-1]
        same = pc.fill_null(pc.equal(a, b), False)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        new[1:] |= ~np.asarray(pc.or_(same, both))
    new[0] = before != key_at(batch, keys, 0)
    return new


def key_at(batch: pa.RecordBatch, keys: list[str], i: int) -> tuple:
    return tuple(batch.column(k)[i].as_py() for k in keys)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    summarise: Callable[[Iterator[pa.RecordBatch]], Any],
    combine: Callable[[Any, Any], Any],
    rescan: Callable[[Iterator[pa.RecordBatch], Any], Iterator[pa.RecordBatch]],
    schema: T.StructType,
    arrange: Callable[[list[Any]], list[Any]] | None = None,
) -> DataFrame:
    """Range-sort ``df`` by keys and order, then scan it with carried state.

    ``summarise`` turns a partition into one picklable state, ``combine`` folds
    the carry with the next state, ``rescan`` yields output batches from a
    partition and the carry of all partitions before it. ``arrange`` may replace
    the fold when the carry also needs what comes after. What reaches the driver
    is one state per partition.
    """
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(PID, F.spark_partition_id()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid: list[int] = []

        def seen():
            for b in batches:
                if b.num_rows:
                    if not pid:
                        pid.append(b.column(PID)[0].as_py())
                    yield b

        state = summarise(seen())
        if pid:
            yield pa.RecordBatch.from_pydict({"pid": pa.array(pid, pa.int32()), "state": pa.array([pickle.dumps(state)], pa.binary())})

    states = sorted((r.pid, pickle.loads(r.state)) for r in rows.mapInArrow(first, "pid int, state binary").collect())
    if arrange is None:
        carries, carry = [], None
        for _, s in states:
            carries.append(carry)
            carry = combine(carry, s)
    else:
        carries = arrange([s for _, s in states])
    start = {pid: c for (pid, _), c in zip(states, carries)}

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task may read several sorted partitions one after another.
        pending: list[pa.RecordBatch] = []
        it = iter(batches)

        def part(pid: int):
            while pending:
                b = pending.pop()
                ids = b.column(PID).to_numpy()
                if ids[0] != pid:
                    pending.append(b)
                    return
                k = int((ids == pid).sum())
                if k < b.num_rows:
                    pending.append(b.slice(k))
                    yield b.slice(0, k)
                    return
                yield b
                nxt = next((x for x in it if x.num_rows), None)
                if nxt is not None:
                    pending.append(nxt)

        nxt = next((x for x in it if x.num_rows), None)
        if nxt is not None:
            pending.append(nxt)
        while pending:
            pid = pending[-1].column(PID)[0].as_py()
            yield from rescan(part(pid), start[pid])

    return rows.mapInArrow(second, schema)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over earlier rows of the same keys.

    NULL counts as 0. Ties in ``order`` are taken in an arbitrary but fixed turn,
    so give a total order where that matters. An empty table stays empty.
    """
    import numpy as np

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])
    names = df.columns

    def summarise(batches):
        first = last = None
        total, single = 0, True
        for b in batches:
            new = changes(b, keys, last)
            v = b.column(value).fill_null(0).to_numpy(zero_copy_only=False)
            if first is None:
                first = key_at(b, keys, 0)
                new[0] = False
            at = np.flatnonzero(new)
            if len(at):
                single, total = False, 0
                v = v[at[-1] :]
            total += int(v.sum())
            last = key_at(b, keys, b.num_rows - 1)
        return first, last, single, total

    def combine(carry, s):
        first, last, single, total = s
        return (last, total + carry[1]) if single and carry and carry[0] == first else (last, total)

    def rescan(batches, carry):
        key, total = carry or (None, 0)
        for b in batches:
            new = changes(b, keys, key)
            v = b.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if new[0]:
                total = 0
            before = np.cumsum(v) - v
            starts = np.flatnonzero(new)
            base = np.full(len(v), -total, dtype=np.int64)
            for_each = np.searchsorted(starts, np.arange(len(v)), side="right") - 1
            has = for_each >= 0
            base[has] = before[starts[for_each[has]]] if len(starts) else 0
            run = before - base
            key, total = key_at(b, keys, b.num_rows - 1), int(run[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(run)], names=[*names, out])

    return ordered_scan(df, keys, order, summarise, combine, rescan, schema)


def carried_last(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` without ``value`` and with ``out``: the last ``value`` that is not NULL, up to and including the row.

    The value carries on across partitions as long as the keys stay the same; it
    is NULL before the first. An empty table stays empty.
    """
    import numpy as np
    import pyarrow.compute as pc

    names = [c for c in df.columns if c != value]
    schema = T.StructType([*(f for f in df.schema.fields if f.name != value), T.StructField(out, df.schema[value].dataType)])

    def filled(b: pa.RecordBatch, key, last):
        """The column with gaps filled from above, but never across a change of keys."""
        new = changes(b, keys, key)
        edges = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), b.num_rows]
        parts = []
        for i, (x, y) in enumerate(zip(edges, edges[1:])):
            part = pc.fill_null_forward(b.column(value).slice(x, y - x))
            if i == 0 and not new[0] and last is not None:
                part = pc.fill_null(part, last)
            parts.append(part)
        return pa.concat_arrays(parts), parts[-1][-1].as_py()

    def summarise(batches):
        first = key = last = None
        single = True
        for b in batches:
            if first is None:
                first = key = key_at(b, keys, 0)
            end = key_at(b, keys, b.num_rows - 1)
            single = single and end == first
            _, last = filled(b, key, last)
            key = end
        return first, key, single, last

    def combine(carry, s):
        first, key, single, last = s
        return (key, carry[1]) if single and last is None and carry and carry[0] == first else (key, last)

    def rescan(batches, carry):
        key, last = carry or (None, None)
        for b in batches:
            col, last = filled(b, key, last)
            key = key_at(b, keys, b.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), col], names=[*names, out])

    return ordered_scan(df, keys, order, summarise, combine, rescan, schema)


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row directly before among those of the same keys, NULL for the first.

    Like a lag over a window, but a key with very many rows spreads over partitions.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, df.schema[value].dataType)])
    names = df.columns

    def summarise(batches):
        end = None
        for b in batches:
            end = key_at(b, keys, b.num_rows - 1), b.column(value)[b.num_rows - 1].as_py()
        return end

    def rescan(batches, carry):
        key, last = carry or (None, None)
        for b in batches:
            new = changes(b, keys, key)
            col = b.column(value)
            before = pa.concat_arrays([pa.array([last], col.type), col.slice(0, b.num_rows - 1)])
            import pyarrow.compute as pc

            key, last = key_at(b, keys, b.num_rows - 1), col[b.num_rows - 1].as_py()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pc.if_else(pa.array(new), pa.scalar(None, col.type), before)], names=[*names, out])

    return ordered_scan(df, keys, order, summarise, lambda carry, s: s, rescan, schema)
