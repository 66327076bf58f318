"""Filling fixed-capacity containers with texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.tokens import TOKENIZERS, encoder
from tracefold.plans.shared import Spool
from tracefold.sources import table

#: Items that one task packs. Best fit over so many leaves a negligible part of the room unused.
SHARD_ITEMS = 50_000
CAPACITIES = (512, 1024, 2048)


def token_counts(docs: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``n_tokens`` of every row; a NULL or empty text has 0."""

    def run(batches):
        enc, _ = encoder(tokenizers)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if (t := x.as_py()) else 0 for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long")


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bin number per item (sizes in decreasing order) and final capacity per bin.

    An item goes to the open bin it leaves least room in. If none takes it, a
    bin of the least cost opens: per token of capacity, the room that is likely
    to stay empty (all of it, if not even the smallest item fits in; else what
    the items still to come, less the room already open, can't fill) and a token
    for the bin itself. At the end each bin shrinks to the smallest capacity that
    holds its contents. The rooms are a bit set, so finding the bin is one shift.
    """
    top = capacities[-1]
    rooms: list[list[int]] = [[] for _ in range(top + 1)]
    mask = 0
    used: list[int] = []
    at = np.empty(len(sizes), dtype=np.int64)
    coming, open_room = int(sizes.sum()), 0
    least = int(sizes[-1]) if len(sizes) else 0
    for i, s in enumerate(sizes.tolist()):
        coming -= s
        if higher := mask >> s:
            room = s + (higher & -higher).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            open_room -= s
        else:
            k = len(used)
            used.append(0)
            free = max(0, coming - open_room)
            room = min((c for c in capacities if c >= s), key=lambda c: (((c - s if c - s < least else max(0, c - s - free)) + 1) / c, c))
            open_room += room - s
        used[k] += s
        at[i] = k
        if room > s:
            rooms[room - s].append(k)
            mask |= 1 << (room - s)
    final = np.array(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0, dtype=np.int64)
    return at, final


def pack(items: DataFrame, key: str, size: str, capacities: tuple[int, ...] = CAPACITIES, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every item, or part of an item, with its container.

    Output: ``key``, ``part``, ``token_from``, ``token_to`` (the part's tokens),
    ``container_id``, ``capacity``, ``position`` (where the part starts in its
    container). Only items larger than the largest capacity are split, into full
    containers and a rest. Items without tokens need no room: their container is
    NULL. Items are dealt out row by row over shards of bounded size, whatever
    they hold, so repeated rows or keys make no shard larger than another.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    spool = Spool(items.sparkSession)
    kind = items.schema[key].dataType.simpleString()
    sized = spool.put("sized", items.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")))
    parts = sized.select("k", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.call_function("div", F.col("n") - 1, F.lit(top))))).alias("part", "no"))
    parts = parts.select("k", "part", (F.col("no") * top).alias("a"), F.least("n", (F.col("no") + 1) * top).alias("b"))
    count = parts.count()
    shards = max(1, round(count / shard_items))

    def run(batches):
        t = pa.Table.from_batches(list(batches), schema=arrow)
        if not t.num_rows:
            return
        shard = TaskContext.get().partitionId()
        a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
        rows = np.flatnonzero(b > a)
        if len(rows):
            rows = rows[np.lexsort((rows, a[rows] - b[rows]))]
            sizes = b[rows] - a[rows]
            at, final = best_fit(sizes, capacities)
            by_bin = np.argsort(at, kind="stable")
            rows, at, sizes = rows[by_bin], at[by_bin], sizes[by_bin]
            before = np.cumsum(sizes) - sizes
            yield from _batches(t.take(pa.array(rows)), pa.array((shard << 40) + at), pa.array(final[at].astype(np.int64)), pa.array(before - before[np.searchsorted(at, at)]))
        empty = np.flatnonzero(b <= a)
        if len(empty):
            none = pa.nulls(len(empty), pa.int64())
            yield from _batches(t.take(pa.array(empty)), none, none, none)

    def _batches(own, container, capacity, position):
        cols = [own.column(c) for c in ("k", "part", "a", "b")] + [container, capacity, position]
        yield from pa.Table.from_arrays(cols, names=[key, "part", "token_from", "token_to", "container_id", "capacity", "position"]).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(parts.schema)
    out = f"`{key}` {kind}, part int, token_from long, token_to long, container_id long, capacity long, position long"
    return parts.repartition(shards).mapInArrow(run, out)


def p8_containers(spark: SparkSession, store: str) -> DataFrame:
    """Every document's tokens placed in containers."""
    return pack(token_counts(table(spark, store, "documents"), "doc_id", "text"), "doc_id", "n_tokens")
