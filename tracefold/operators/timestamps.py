"""Mixed time notations and zones, normalised through a dictionary of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.instants import CANONICAL, with_instant, zone_of
from tracefold.plans.shared import Spool, delete_at_exit, exists
from tracefold.sources import table

#: A pair that holds at least one in so many rows is hot; there are at most so many.
HOT = 200


class InstantDictionary:
    """Distinct (raw text, zone) pairs with their instants, kept as a table and grown by new values.

    With a path, values already there are not parsed again: new pairs are found
    by an anti join and appended. Without one the dictionary lives in the plan.
    Unreadable values stay in the table with a NULL instant, so they are known
    too. NULL raw values are in no dictionary and get a NULL instant.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path

    def _known(self) -> DataFrame | None:
        if not self.path or not exists(self.spark, self.path):
            return None
        return self.spark.read.schema("raw string, zone string, utc_us long").parquet(self.path)

    def extend(self, values: DataFrame) -> DataFrame:
        """The dictionary after the (raw, zone) pairs of ``values`` have been added."""
        pairs = values.select("raw", "zone").where(F.col("raw").isNotNull()).distinct()
        known = self._known()
        if known is not None:
            same = (F.col("v.raw") == F.col("k.raw")) & F.col("v.zone").eqNullSafe(F.col("k.zone"))
            pairs = pairs.alias("v").join(known.alias("k"), same, "left_anti")
        parsed = with_instant(pairs, F.col("raw"), F.col("zone"), "utc_us")
        if not self.path:
            return parsed
        parsed.write.mode("append").parquet(self.path)
        return self._known()

    def normalise(self, rows: DataFrame, raw: str, zone: str, out: str = "utc_us", readable_only: bool = False) -> DataFrame:
        """``rows`` with ``out``, the instant of the text in ``raw`` under the zone in ``zone``.

        Rows are joined back to the dictionary on both columns. Pairs that hold a
        large share of all rows (at most HOT of them) are looked up in a broadcast
        table and take no part in that join, nor do NULL texts. ``readable_only``
        keeps readable rows only.
        """
        keyed = rows.withColumns({"__raw": F.col(raw), "__zone": F.coalesce(F.col(zone), F.lit(""))})
        counts = keyed.where("__raw is not null").groupBy("__raw", "__zone").agg(F.count(F.lit(1)).alias("__n"))
        counts = Spool(self.spark).put("pairs", counts)
        total = counts.agg(F.sum("__n")).first()[0] or 0
        words = self.extend(counts.select(F.col("__raw").alias("raw"), F.nullif(F.col("__zone"), F.lit("")).alias("zone")))
        words = words.select(F.col("raw").alias("__raw"), F.coalesce("zone", F.lit("")).alias("__zone"), F.col("utc_us").alias(out))
        on = ["__raw", "__zone"]
        hot = counts.where(F.col("__n") * HOT >= total).select(*on)
        known = [(r["__raw"], r["__zone"], r[out]) for r in words.join(F.broadcast(hot), on).collect()]  # HOT rows at most
        # inner to every row: the few hot pairs as a literal map, so that no row is read twice
        us, is_hot = F.lit(None).cast("long"), F.lit(False)
        if known:
            key = F.struct(*on)
            at = F.create_map(*[c for r, z, v in known for c in (F.struct(F.lit(r).alias("__raw"), F.lit(z).alias("__zone")), F.lit(v).cast("long"))])
            us, is_hot = F.try_element_at(at, key), F.coalesce(F.map_contains_key(at, key), F.lit(False))
        own = [F.col(f"`{c}`") for c in rows.columns]
        still = is_hot | F.col("__raw").isNull()
        direct = keyed.where(still if not readable_only else is_hot).select(*own, us.alias(out))
        rest = keyed.where(~still).join(words if not readable_only else words.where(F.col(out).isNotNull()), on, "inner" if readable_only else "left").select(*own, out)
        if readable_only:
            direct = direct.where(F.col(out).isNotNull())
        return direct.unionByName(rest)


def import_zones(spark: SparkSession, store: str) -> DataFrame:
    """The recording zone of each import."""
    return table(spark, store, "imports").select(F.col("id").alias("import_id"), zone_of(F.col("log_extensions")).alias("zone"))


def readable_starts(entries: DataFrame, zones: DataFrame) -> DataFrame:
    """``entries`` whose start is readable in any notation, with its instant ``start_us``.

    ``zones`` has ``import_id`` and ``zone``, as import_zones gives them.
    """
    e = entries.where(F.col("started_at").isNotNull()).join(zones, "import_id", "left")
    return with_instant(e, F.col("started_at"), F.col("zone"), "start_us").drop("zone").where(F.col("start_us").isNotNull())


def recorded_starts(spark: SparkSession, store: str) -> DataFrame:
    """``started_at`` of entries and pages with the zone of their import."""
    entries = table(spark, store, "entries").select(F.lit("entries").alias("table_name"), "import_id", F.col("id").cast("string").alias("row_key"), F.col("started_at").alias("raw"))
    pages = table(spark, store, "pages").select(F.lit("pages").alias("table_name"), "import_id", F.col("id").alias("row_key"), F.col("started_at").alias("raw"))
    return entries.unionByName(pages).join(import_zones(spark, store), "import_id", "left")


def dictionary(spark: SparkSession, store: str, path: str | None = None) -> InstantDictionary:
    """The dictionary at ``path``, or a new one in the shared folder, with what the store's pages hold already in it."""
    d = InstantDictionary(spark, path or f"{Spool(spark).root}/instants")
    if not path:
        delete_at_exit(spark, d.path)
    pages = table(spark, store, "pages").select("import_id", F.col("started_at").alias("raw")).join(import_zones(spark, store), "import_id", "left")
    d.extend(pages)
    return d


def p7_found(spark: SparkSession, store: str) -> DataFrame:
    """Rows whose readable start is not already canonical, with the instant."""
    rows = recorded_starts(spark, store).where(F.col("raw").isNotNull() & ~F.col("raw").rlike(CANONICAL))
    return dictionary(spark, store).normalise(rows, "raw", "zone", readable_only=True).select("table_name", "import_id", "row_key", "utc_us")


def p7_normalised(spark: SparkSession, store: str) -> DataFrame:
    """Every recorded start with its instant, NULL where it is unreadable or missing."""
    return dictionary(spark, store).normalise(recorded_starts(spark, store), "raw", "zone").select("table_name", "import_id", "row_key", "raw", "utc_us")
