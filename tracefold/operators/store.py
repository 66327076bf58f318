"""The store as a whole: its schema, writing, loading again, merging, pruning."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.plans.shared import delete, exists

_DOUBLES = ["time_ms", "blocked_ms", "dns_ms", "connect_ms", "send_ms", "wait_ms", "receive_ms", "ssl_ms"]
# The store's columns in their order.
SCHEMAS = {
    "imports": "id long, source_file string, imported_at string, entry_count long, log_extensions string, status string, entries_total long, entries_skipped long",
    "pages": "id string, import_id long, started_at string, title string, on_content_load_ms double, on_load_ms double, page_extensions string, page_timings_extensions string",
    "entries": "id long, import_id long, page_id string, started_at string, " + ", ".join(f"{c} double" for c in _DOUBLES) + ", method string, url string, host string, path string, query_string string, http_version string, request_headers string, request_cookies string, "
    "request_body_hash string, request_body_size long, status int, status_text string, response_headers string, response_cookies string, response_body_hash string, response_body_size long, response_body_hash_raw string, response_body_size_raw long, "
    "response_mime_type string, is_redirect int, server_ip string, connection_id string, request_id string, parent_request_id string, initiator_type string, initiator_url string, initiator_line long, initiator_column long, redirect_url string, tls_version string, "
    "tls_cipher_suite string, tls_cert_subject string, tls_cert_issuer string, tls_cert_expiry string, entry_hash string, entry_extensions string, request_extensions string, response_extensions string, content_extensions string, timings_extensions string, "
    "post_data_extensions string, graphql_operation_type string, graphql_operation_name string, graphql_top_level_fields string",
    "blobs": "hash string, content binary, size long, mime_type string, external_path string",
    "graphql_fields": "entry_id long, field string",
}
#: Fields that later copies of an entry may fill in.
ENRICHED = ["tls_version", "tls_cipher_suite", "tls_cert_subject", "tls_cert_issuer", "tls_cert_expiry", "request_id", "parent_request_id", "initiator_type", "initiator_url", "initiator_line", "initiator_column", "redirect_url", "graphql_operation_type", "graphql_operation_name", "graphql_top_level_fields"]


def columns(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


#: What makes two entries of a merge the same: all fields but keys, hash, TLS and GraphQL.
MERGE_KEY = [c for c in columns("entries") if c not in ("id", "import_id", "entry_hash") and not c.startswith(("tls_", "graphql_"))]
#: What an entry's hash is made of.
HASHED = ["page_id", "started_at", *_DOUBLES, "method", "url", "http_version", "request_headers", "request_cookies", "request_body_hash", "request_body_size", "status", "status_text", "response_headers", "response_cookies", "response_body_hash", "response_body_size", "response_mime_type", "server_ip", "connection_id"]


def conform(df: DataFrame, name: str) -> DataFrame:
    """A table of an older store with today's columns: missing ones NULL, present ones cast, others dropped."""
    schema = T.StructType.fromDDL(SCHEMAS[name])
    return df.select(*((F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def entry_hash() -> Column:
    """The digest of an entry's request, response and times, v1.

    Each field is written with its length before it, NULL as a sign of its own,
    numbers of milliseconds in thousandths; so no two different entries are
    written alike.
    """
    def part(c: str) -> Column:
        v = F.col(c)
        if c in _DOUBLES:
            v = F.when(F.isnan(v), "nan").otherwise(F.round(v * 1000).cast("decimal(38,0)").cast("string"))
        v = v.cast("string")
        return F.when(v.isNull(), "~").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))

    return F.sha2(F.concat(F.lit("v1"), *map(part, HASHED)), 256)


def backfill_hashes(entries: DataFrame) -> DataFrame:
    """Entries without a hash given one."""
    return entries.withColumn("entry_hash", F.coalesce("entry_hash", entry_hash()))


def pages_of_imports(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages of the imports in ``ids`` (column ``id``); no ids, no pages."""
    return pages.join(ids.select(F.col("id").alias("import_id")), "import_id", "left_semi")


def blobs_by_hash(blobs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Blobs whose hash is in ``hashes`` (column ``hash``), once each."""
    return blobs.join(hashes.select("hash").distinct(), "hash", "left_semi")


def insert_pages(there: DataFrame, new: DataFrame) -> DataFrame:
    """New pages whose key (id, import) the store doesn't have yet, the first by start and title of equal ones."""
    cols = [c for c in new.columns if c not in ("id", "import_id")]
    first = new.groupBy("id", "import_id").agg(F.min_by(F.struct(*cols), F.struct(F.coalesce("started_at", F.lit("")), F.coalesce("title", F.lit("")))).alias("p")).select("id", "import_id", "p.*")
    return first.join(there.select("id", "import_id"), ["id", "import_id"], "left_anti").select(*new.columns)


def store_blobs(there: DataFrame, new: DataFrame) -> DataFrame:
    """The blob table after ``new`` has come in: a hash is stored once, what is there stays, a missing ``external_path`` is filled in."""
    rows = there.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)), allowMissingColumns=True)
    at = F.struct("__turn", F.coalesce("external_path", F.lit("")))
    kept = [F.min_by(c, at).alias(c) for c in ("content", "size", "mime_type")]
    return rows.where("hash is not null").groupBy("hash").agg(*kept, F.min_by("external_path", F.when(F.col("external_path").isNotNull(), at)).alias("external_path"))


def resume_points(imports: DataFrame, entries: DataFrame) -> DataFrame:
    """Per source the newest import that isn't complete, and how many of its entries are stored."""
    newest = imports.where((F.col("status") != "complete") | F.col("status").isNull()).groupBy("source_file").agg(F.max("id").alias("import_id"))
    n = entries.groupBy("import_id").agg(F.count(F.lit(1)).alias("stored"))
    return newest.join(n, "import_id", "left").select("source_file", "import_id", F.coalesce("stored", F.lit(0)).alias("stored"))


def recount(imports: DataFrame, entries: DataFrame) -> DataFrame:
    """Imports with ``entry_count`` as it is."""
    n = entries.groupBy(F.col("import_id").alias("id")).agg(F.count(F.lit(1)).alias("__n"))
    return imports.join(n, "id", "left").withColumn("entry_count", F.coalesce("__n", F.lit(0))).select(*imports.columns)


def prune(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The store without the imports in ``ids`` (column ``id``), their pages, entries and GraphQL fields, and blobs that only they used.

    Blobs that nothing used before stay, as they aren't the imports' own.
    """
    gone = ids.select(F.col("id").alias("import_id"))
    entries = tables["entries"].join(gone, "import_id", "left_anti").select(*tables["entries"].columns)
    lost = tables["entries"].join(gone, "import_id", "left_semi")
    used = lambda e: e.select(F.explode(F.array("request_body_hash", "response_body_hash", "response_body_hash_raw")).alias("hash")).where("hash is not null").distinct()
    dead = used(lost).join(used(entries), "hash", "left_anti")
    return {
        "imports": tables["imports"].join(ids.select("id"), "id", "left_anti").select(*tables["imports"].columns), "pages": tables["pages"].join(gone, "import_id", "left_anti").select(*tables["pages"].columns), "entries": entries,
        "blobs": tables["blobs"].join(dead, "hash", "left_anti").select(*tables["blobs"].columns), "graphql_fields": tables["graphql_fields"].join(lost.select(F.col("id").alias("entry_id")), "entry_id", "left_anti").select(*tables["graphql_fields"].columns),
    }


def merge(stores: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Several stores as one; what comes first wins, what it lacks is filled in from later ones.

    Imports are the same if file and time of loading are; their ids are given
    anew, in the order of store and id. Pages are the same by (id, import),
    entries by MERGE_KEY within their import, blobs by hash, GraphQL fields by
    entry and name. The fields in ENRICHED come from the first copy that has
    them, ``log_extensions`` and ``external_path`` likewise. Numbers of rows
    don't matter: entries are brought together by a digest of their key.
    """
    def all_of(name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [conform(s[name], name).withColumn("__store", F.lit(i)) for i, s in enumerate(stores)])

    at = F.struct("__store", "id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    keep = lambda cols, by: [F.min_by(c, by).alias(c) for c in cols]
    imports = all_of("imports")
    one = imports.groupBy("source_file", "imported_at").agg(F.min(at).alias("__first"), *keep(["entry_count", "status", "entries_total", "entries_skipped"], at), first("log_extensions"))
    # few rows (one per loaded capture): their order is a plain window over them
    from pyspark.sql import Window

    one = one.withColumn("new_id", F.row_number().over(Window.orderBy("__first")).cast("long"))
    same = F.col("i.source_file").eqNullSafe(F.col("o.source_file")) & F.col("i.imported_at").eqNullSafe(F.col("o.imported_at"))
    ids = imports.alias("i").join(one.alias("o"), same).select(F.col("i.__store").alias("__store"), F.col("i.id").alias("import_id"), "o.new_id")
    move = lambda df: df.join(ids, ["__store", "import_id"]).withColumn("import_id", F.col("new_id")).drop("new_id")
    pages = move(all_of("pages"))
    pages = pages.groupBy("id", "import_id").agg(*keep([c for c in columns("pages") if c not in ("id", "import_id")], F.struct("__store", F.coalesce("started_at", F.lit("")))))
    entries = move(all_of("entries"))
    entries = entries.withColumn("__key", F.sha2(F.to_json(F.struct("import_id", *MERGE_KEY), {"ignoreNullFields": "false"}), 256))
    kept = entries.groupBy("__key").agg(F.min(at).alias("__first"), *keep([c for c in columns("entries") if c not in ENRICHED and c != "id"], at), *(first(c) for c in ENRICHED))
    kept = kept.withColumn("id", F.col("__first.id") * len(stores) + F.col("__first.__store"))
    new = entries.select("__store", F.col("id").alias("entry_id"), "__key").join(kept.select("__key", "id"), "__key").select("__store", "entry_id", "id")
    fields = all_of("graphql_fields").join(new, ["__store", "entry_id"]).select(F.col("id").alias("entry_id"), "field").distinct()
    blobs = all_of("blobs").drop("__store")
    if len(stores) > 1:
        blobs = store_blobs(*(reduce(DataFrame.unionByName, [conform(s["blobs"], "blobs") for s in part]) for part in (stores[:1], stores[1:])))
    merged = {
        "imports": one.select(F.col("new_id").alias("id"), *(c for c in columns("imports") if c != "id")), "pages": pages.select(*columns("pages")), "entries": kept.select(*columns("entries")),
        "blobs": blobs.select(*columns("blobs")), "graphql_fields": fields,
    }
    return merged | {"imports": recount(merged["imports"], merged["entries"])}


def merge_stats(stores: list[dict[str, DataFrame]], merged: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows given, rows kept, rows that were repeats."""
    out = None
    for name in SCHEMAS:
        given = reduce(DataFrame.unionByName, [s[name].agg(F.count(F.lit(1)).alias("n")) for s in stores]).agg(F.sum("n").alias("given"))
        row = given.join(F.broadcast(merged[name].agg(F.count(F.lit(1)).alias("kept")))).select(F.lit(name).alias("table_name"), "given", "kept", (F.col("given") - F.col("kept")).alias("repeats"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def kind_of(path: str) -> str:
    """What an input is: 'store' (a folder with tables) or 'capture' (a HAR file, also compressed)."""
    if path.endswith((".har", ".har.gz", ".har.br", ".gz", ".br")):
        return "capture"
    if os.path.isdir(path):
        return "store"
    raise ValueError(f"neither a store nor a capture: {path}")


def catalog(spark: SparkSession, store: str) -> DataFrame:
    """Tables and columns of a store: ``table_name``, ``position``, ``column_name``, ``type``."""
    rows = []
    for name in SCHEMAS:
        if exists(spark, f"{store}/{name}.parquet"):
            rows += [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(spark.read.parquet(f"{store}/{name}.parquet").schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def ddl(name: str) -> str:
    """The statement that makes a table of the store."""
    return f"CREATE TABLE {name} (\n  " + ",\n  ".join(SCHEMAS[name].split(", ")) + "\n)"


class Store:
    """A store's folder: tables are read from it, appended to it and replaced in one step.

    Tables are Parquet folders ``name.parquet``. Appending adds files; replacing
    writes beside the old table and swaps, so that readers never see half of it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        if not exists(self.spark, self._at(name)):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return conform(self.spark.read.option("mergeSchema", "true").parquet(self._at(name)), name)

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in SCHEMAS}

    def append(self, name: str, rows: DataFrame) -> None:
        conform(rows, name).write.mode("append").parquet(self._at(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        new = f"{self.path}/.{name}-{uuid.uuid4().hex}"
        conform(rows, name).write.parquet(new)
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = p(new).getFileSystem(self.spark._jsc.hadoopConfiguration())
        delete(self.spark, self._at(name))
        fs.rename(p(new), p(self._at(name)))

    def add(self, imports: DataFrame, pages: DataFrame, entries: DataFrame, blobs: DataFrame, fields: DataFrame) -> None:
        """Appends what a load has brought: pages and blobs only where they are new, the rest as it is."""
        self.append("pages", insert_pages(self.table("pages"), conform(pages, "pages")))
        if exists(self.spark, self._at("blobs")):
            self.replace("blobs", store_blobs(self.table("blobs"), conform(blobs, "blobs")))
        else:
            self.append("blobs", store_blobs(self.table("blobs"), conform(blobs, "blobs")))
        self.append("entries", entries)
        self.append("graphql_fields", fields)
        self.append("imports", imports)

    def prune(self, ids: list[int], root: str | None = None) -> list[str]:
        """Removes imports; returns the external files that nothing names any more and deletes those below ``root``."""
        t = self.tables()
        kept = prune(t, self.spark.createDataFrame([(i,) for i in ids], "id long"))
        gone = t["blobs"].join(kept["blobs"], "hash", "left_anti").where("external_path is not null").select("external_path")
        files = [r.external_path for r in gone.toLocalIterator()]
        for name in ("graphql_fields", "pages", "blobs", "entries", "imports"):
            self.replace(name, kept[name])
        base = os.path.realpath(root) if root else None
        for f in files:
            real = os.path.realpath(f if os.path.isabs(f) or not base else os.path.join(base, f))
            if base and real.startswith(base + os.sep) and os.path.exists(real):
                os.remove(real)
        return files
