"""Overlapping and gapped time intervals per entity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.functions.instants import with_instant
from tracefold.operators.timestamps import import_zones
from tracefold.plans.scan import changes, key_at, ordered_scan
from tracefold.plans.shared import Spool
from tracefold.sources import table

#: Instants and ends are held within this many microseconds of 1970, so sums can't overflow.
FAR_US = 4 * 10**18


def islands(df: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """``df`` with, per row, the end of cover so far, whether it opens a new period, and where its period began.

    ``covered_to``: the largest ``end`` among earlier rows of the same keys in
    the order of (start, tie), NULL for the first. ``opens``: true if the row
    starts a period, that is, it is the first or starts after ``covered_to``.
    ``period_from``: the start of the row that opened its period, a label that no
    other period of the keys has. Rows with NULL start or end must be left out
    before. Rows are range-sorted by keys and start, each partition leaves its
    last key with the largest end and the last opening, and the second pass
    starts from the combined states; a key with very many rows therefore spreads
    over partitions.
    """
    import pandas as pd

    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("covered_to", T.LongType()), T.StructField("opens", T.BooleanType()), T.StructField("period_from", T.LongType())])

    def cover(b, key, top):
        """Per row: is its key new, the cover before it (and whether there is any), the cover after it."""
        new = changes(b, keys, key)
        ends = b.column(end).to_numpy()
        group = np.cumsum(new)
        most = pd.Series(ends).groupby(group).cummax().to_numpy().copy()
        if top is not None:
            most[group == 0] = np.maximum(most[group == 0], top)
        before = np.empty(len(ends), dtype=np.int64)
        before[1:] = most[:-1]
        before[0] = top if top is not None and not new[0] else 0
        none = new.copy()
        if key is None:
            none[0] = True
        return new, before, none, most

    def summarise(batches):
        first = key = top = opened = None
        single = True
        for b in batches:
            new, before, none, most = cover(b, key, top)
            if first is None:
                first, new[0] = key_at(b, keys, 0), False
            starts = b.column(start).to_numpy()
            at = np.flatnonzero(none | (starts > before))
            single = single and not new.any()
            if len(at):
                opened = int(starts[at[-1]])
            key, top = key_at(b, keys, b.num_rows - 1), int(most[-1])
        return first, key, single, top, opened

    def combine(carry, s):
        first, key, single, top, opened = s
        if not (single and carry and carry[0] == first):
            return key, top, opened
        # an opening found without knowing the cover carried in holds only if it lies beyond that
        return key, max(top, carry[1]), opened if opened > carry[1] else carry[2]

    def rescan(batches, carry):
        key, top, opened = carry or (None, None, None)
        for b in batches:
            new, before, none, most = cover(b, key, top)
            starts = b.column(start).to_numpy()
            opens = none | (starts > before)
            at = np.maximum.accumulate(np.where(opens, np.arange(len(starts)), -1))
            label = np.where(at >= 0, starts[np.maximum(at, 0)], 0 if opened is None else opened)
            key, top, opened = key_at(b, keys, b.num_rows - 1), int(most[-1]), int(label[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(before, mask=none), pa.array(opens), pa.array(label)], names=[*names, "covered_to", "opens", "period_from"])

    return ordered_scan(df, keys, [start, tie], summarise, combine, rescan, schema)


def busy_intervals(spark: SparkSession, store: str) -> DataFrame:
    """One row per entry and entity (connection or page of an import) that it keeps busy.

    Entries without a readable start, with NULL, NaN or negative ``time_ms``, or
    without the id are left out. An endless ``time_ms`` ends in the far future.
    """
    e = table(spark, store, "entries").select("id", "import_id", "started_at", "time_ms", "connection_id", "page_id")
    e = e.where(F.col("started_at").isNotNull() & ~F.isnan("time_ms") & (F.col("time_ms") >= 0) & (F.col("connection_id").isNotNull() | F.col("page_id").isNotNull()))
    e = with_instant(e.join(import_zones(spark, store), "import_id", "left"), F.col("started_at"), F.col("zone"), "start_us")
    length = F.round(F.least(F.col("time_ms") * 1000.0, F.lit(float(FAR_US // 2)))).cast("long")
    e = e.where(F.col("start_us").between(-FAR_US // 2, FAR_US // 2)).withColumn("end_us", F.col("start_us") + length)
    # written once, so that finding the ranges and sorting into them don't parse again
    e = Spool(spark).put("intervals", e.select("import_id", "id", "start_us", "end_us", "connection_id", "page_id"))
    kind = F.explode(F.array(
        F.struct(F.lit("connection").alias("entity_kind"), F.col("connection_id").alias("entity_id")),
        F.struct(F.lit("page").alias("entity_kind"), F.col("page_id").alias("entity_id")),
    ))
    return e.select("import_id", "id", "start_us", "end_us", kind.alias("k")).select("k.entity_kind", "import_id", "k.entity_id", "start_us", "end_us", "id").where(F.col("entity_id").isNotNull())


KEYS = ["entity_kind", "import_id", "entity_id"]


def gaps(rows: DataFrame) -> DataFrame:
    """The idle gaps between continuous periods."""
    i = islands(rows, KEYS, "start_us", "end_us", "id").where(F.col("opens") & F.col("covered_to").isNotNull())
    return i.select(*KEYS, F.col("covered_to").alias("gap_start_us"), F.col("start_us").alias("gap_end_us"), F.col("id").alias("next_entry_id"))


def periods(rows: DataFrame) -> DataFrame:
    """The continuous busy periods: first start, last end, entries in each. Their label comes from the same scan."""
    i = islands(rows, KEYS, "start_us", "end_us", "id")
    return i.groupBy(*KEYS, F.col("period_from").alias("busy_from_us")).agg(F.max("end_us").alias("busy_to_us"), F.count(F.lit(1)).alias("n_entries"))


def p3_found(spark: SparkSession, store: str) -> DataFrame:
    return gaps(busy_intervals(spark, store)).select(*KEYS, "next_entry_id")


def p3_periods(spark: SparkSession, store: str) -> DataFrame:
    return periods(busy_intervals(spark, store))
