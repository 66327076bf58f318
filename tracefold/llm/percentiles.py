"""Percentiles of very large numeric columns through cumulative frequencies."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators.hosts import heavy_hosts, host_key, measured
from tracefold.plans.scan import changes, key_at, ordered_scan
from tracefold.sources import table

METRICS = ("time_ms", "wait_ms")
#: Relative error of the percentiles that are combined over imports.
GRID_ERROR = 0.01


def value_counts(df: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS, error: float | None = None) -> DataFrame:
    """The mergeable form: how often each value occurs, per ``by`` and metric.

    Counts of two days or imports are combined by ``merge_counts``. NULL, NaN
    and negative values are no measurements; infinity is the largest one. With
    ``error`` positive values are rounded to a grid of that relative error (the
    middle of geometric steps), which bounds the rows per group; zero stays
    exact. Without it the percentiles are exact.
    """
    pair = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), measured(F.col(m)).alias("value")) for m in metrics)))
    v = F.col("m.value")
    if error:
        step = float(np.log1p(2 * error / (1 - error)))
        v = F.when(v == 0, v).when(v == float("inf"), v).otherwise(F.exp(F.floor(F.log(v) / step) * step) * (1 + error / (1 - error)))
    rows = df.select(*by, pair.alias("m")).select(*by, "m.metric", (v + 0.0).alias("value")).where(F.col("value").isNotNull())
    return rows.groupBy(*by, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Counts of separate imports or days as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by, "metric", "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, by: list[str], at: dict[str, Fraction]) -> DataFrame:
    """Per group the first value whose cumulative count reaches ceil(q * n), for each q in ``at``.

    ``counts`` is range-sorted by group and value. Each partition leaves the
    totals of its first and last group; combined, they give every partition the
    count carried into its first group and the full size of the groups it shares
    with others. Groups inside a partition need nothing from elsewhere, so there
    is no join and no group is gathered anywhere. Output: ``by``, ``metric``,
    ``n`` and one column per name in ``at``. No rows: no groups.
    """
    keys = [*by, "metric"]
    fields = {f.name: f for f in counts.schema.fields}
    schema = T.StructType([*(fields[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("which", T.StringType()), T.StructField("value", T.DoubleType())])

    def summarise(batches):
        first = last = None
        head = tail = 0
        single = True
        for b in batches:
            new = changes(b, keys, last)
            if first is None:
                first, new[0] = key_at(b, keys, 0), False
            c = b.column("n").to_numpy()
            marks = np.flatnonzero(new)
            if single:
                head += int(c[: marks[0]].sum() if len(marks) else c.sum())
            if len(marks):
                single, tail = False, int(c[marks[-1] :].sum())
            else:
                tail += int(c.sum())
            last = key_at(b, keys, b.num_rows - 1)
        return first, head, last, tail, single

    def arrange(states):
        total: dict[tuple, int] = {}
        for first, head, last, tail, single in states:
            total[first] = total.get(first, 0) + head
            if not single:
                total[last] = total.get(last, 0) + tail
        out, key, run = [], None, 0
        for first, head, last, tail, single in states:
            before = run if key == first else 0
            out.append((before, {first: total[first], last: total[last]}))
            key, run = last, before + head if single else tail
        return out

    def rescan(batches, carry):
        # groups that reach into other partitions have a known size and are passed batch by batch;
        # one that lies in this partition alone is held until it ends
        before, full = carry
        key, n, run, held = None, None, before, []

        def pick(out, v, c, n, run):
            cum = np.cumsum(c) + run
            for name, q in at.items():
                rank = max(1, -(-q.numerator * n // q.denominator))
                i = int(np.searchsorted(cum, rank))
                if i < len(cum) and cum[i] - c[i] < rank:
                    for kk, x in zip(keys, key):
                        out[kk].append(x)
                    out["n"].append(n)
                    out["which"].append(name)
                    out["value"].append(float(v[i]))

        def close(out):
            if held:
                v, c = (np.concatenate(x) for x in zip(*held))
                pick(out, v, c, int(c.sum()), 0)
                held.clear()

        def empty():
            return {k: [] for k in [*keys, "n", "which", "value"]}

        def batch(out):
            return pa.RecordBatch.from_pydict({k: pa.array(x, _arrow(schema[k].dataType)) for k, x in out.items()})

        for b in batches:
            out = empty()
            new = changes(b, keys, key)
            starts = np.flatnonzero(new).tolist()
            edges = [*([0] if not starts or starts[0] else []), *starts, b.num_rows]
            c, v = b.column("n").to_numpy(), b.column("value").to_numpy()
            for s, e in zip(edges, edges[1:]):
                if new[s]:
                    close(out)
                    run = before if key is None else 0
                    key = key_at(b, keys, s)
                    n = full.get(key)
                if n is None:
                    held.append((v[s:e], c[s:e]))
                else:
                    pick(out, v[s:e], c[s:e], n, run)
                    run += int(c[s:e].sum())
            yield batch(out)
        out = empty()
        close(out)
        yield batch(out)

    picks = ordered_scan(counts.select(*keys, "value", "n"), keys, ["value"], summarise, lambda a, b: b, rescan, schema, arrange)
    return picks.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("which") == k, F.col("value"))).alias(k) for k in at))


def _arrow(t: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "date": pa.date32()}[t.simpleString()]


QUANTILES = {"p50": Fraction(1, 2), "p90": Fraction(9, 10), "p95": Fraction(95, 100), "p99": Fraction(99, 100)}


def _timings(spark: SparkSession, store: str) -> DataFrame:
    return table(spark, store, "entries").select(host_key(F.col("host")).alias("host"), *METRICS)


def p5_found(spark: SparkSession, store: str) -> DataFrame:
    """Metrics of heavy hosts whose 90th percentile is over five times the median."""
    hosts = heavy_hosts(spark, store).select("host")  # at most 40 rows by its definition
    counts = value_counts(_timings(spark, store).join(F.broadcast(hosts), "host"), ["host"])
    p = percentiles(counts, ["host"], {k: QUANTILES[k] for k in ("p50", "p90")})
    return p.where(F.col("p90") > 5 * F.col("p50")).select("host", "metric")


def p5_percentiles(spark: SparkSession, store: str) -> DataFrame:
    """Exact percentiles of both timings for every host."""
    rows = _timings(spark, store).where(F.col("host").isNotNull())
    return percentiles(value_counts(rows, ["host"]), ["host"], QUANTILES)


def p5_merged(spark: SparkSession, store: str) -> DataFrame:
    """Percentiles within GRID_ERROR of the exact ones, from counts made for each import and then combined.

    The counts of an import never change, so only a new import's have to be made;
    the grid bounds the rows per host and import, whatever their number of entries.
    """
    rows = table(spark, store, "entries").select("import_id", host_key(F.col("host")).alias("host"), *METRICS).where(F.col("host").isNotNull())
    per_import = value_counts(rows, ["import_id", "host"], error=GRID_ERROR)
    return percentiles(merge_counts([per_import.drop("import_id")], ["host"]), ["host"], QUANTILES).select("host", "metric", "n", *(F.round(q, 6).alias(q) for q in QUANTILES))
