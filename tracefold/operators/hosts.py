"""Results per key when a handful of keys hold most rows: aggregate before joining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.sources import table


def host_key(host: Column) -> Column:
    """A host in lower case without a trailing dot; NULL and empty stay no host."""
    return F.nullif(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def eager_rollup(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: list[str],
    left_sums: dict[str, Column],
    right_sums: dict[str, Column],
    how: str = "left",
) -> DataFrame:
    """Per ``by`` (columns of left): sums over ``left JOIN right``, without joining rows.

    Left is reduced to one state per (``on``, ``by``) and right to one per
    ``on``; both reductions combine before the shuffle, so a hot key moves one
    row per task. The compact states are joined and the algebra done on them:
    left sums are multiplied by the number of right rows, right sums by the
    number of left rows. Output: ``by``, ``n_rows`` (rows of the join) and the
    named sums. NULL join keys match nothing and, with ``how="left"``, count as
    rows without a partner; a NULL sum counts as 0.
    """
    n_left, n_right = "__n_left", "__n_right"
    ls = left.groupBy(on, *by).agg(F.count(F.lit(1)).alias(n_left), *(F.sum(c).alias(f"__l_{k}") for k, c in left_sums.items()))
    rs = right.groupBy(on).agg(F.count(F.lit(1)).alias(n_right), *(F.sum(c).alias(f"__r_{k}") for k, c in right_sums.items()))
    rs = rs.select(F.col(on).alias("__on"), n_right, *(f"__r_{k}" for k in right_sums))
    j = ls.join(rs, ls[on] == rs["__on"], how)
    times = F.coalesce(F.col(n_right), F.lit(1))
    sums = [F.sum(F.coalesce(F.col(f"__l_{k}"), F.lit(0)) * times).alias(k) for k in left_sums]
    sums += [F.sum(F.coalesce(F.col(f"__r_{k}"), F.lit(0)) * F.col(n_left)).alias(k) for k in right_sums]
    return j.groupBy(*by).agg(F.sum(F.col(n_left) * times).alias("n_rows"), *sums)


def measured(c: Column) -> Column:
    """A timing that is a measurement: not NULL, NaN or negative."""
    return F.when(~F.isnan(c) & (c >= 0), c)


def host_totals(spark: SparkSession, store: str) -> DataFrame:
    """Per host: entries, response bytes, and entries whose import is known to be complete."""
    e = table(spark, store, "entries").select(host_key(F.col("host")).alias("host"), "import_id", "response_body_size")
    i = table(spark, store, "imports").select(F.col("id").alias("import_id"), (F.col("status") == "complete").cast("long").alias("done"))
    return eager_rollup(
        e, i, "import_id", ["host"],
        {"body_bytes": F.when(F.col("response_body_size") >= 0, F.col("response_body_size"))},
        {"entries_of_complete_imports": F.col("done")},
    ).select("host", F.col("n_rows").alias("n_entries"), "body_bytes", "entries_of_complete_imports")


def heavy_hosts(spark: SparkSession, store: str, share: int = 40) -> DataFrame:
    """Hosts with at least one in ``share`` of all entries (so at most ``share`` rows)."""
    totals = host_totals(spark, store).select("host", "n_entries")
    every = totals.agg(F.sum("n_entries").alias("__all"))  # one row
    return totals.join(F.broadcast(every), F.col("n_entries") * share >= F.col("__all")).where(F.col("host").isNotNull()).select("host", "n_entries")


def p4_found(spark: SparkSession, store: str) -> DataFrame:
    return heavy_hosts(spark, store).select("host")


def p4_hosts(spark: SparkSession, store: str) -> DataFrame:
    return host_totals(spark, store)
