"""Requests matched to recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators.masking import form_pairs
from tracefold.operators.timestamps import readable_starts
from tracefold.operators.views import url_parts


def strict_match(requests: DataFrame, recordings: DataFrame) -> DataFrame:
    """For each request the latest recording of its method and URL, NULL without one.

    Recordings are reduced to one per method and URL before the join. Among
    equal starts the larger id is later; a NULL start is the earliest.
    """
    key = F.upper("method").alias("method"), F.col("url")
    last = recordings.where("method is not null and url is not null").select(*key, "started_at", "id", "status").groupBy("method", "url")
    last = last.agg(F.max(F.struct(F.coalesce("started_at", F.lit("")).alias("at"), "id", "status")).alias("r"))
    return requests.select("id", *key).join(last, ["method", "url"], "left").select("id", F.col("r.id").alias("recording_id"), F.col("r.status").alias("recorded_status"))


def fuzzy_match(requests: DataFrame, recordings: DataFrame) -> DataFrame:
    """For each request the best recording of its method, host, port and path (a final slash aside).

    Best is the one that shares most query pairs, then the latest, then the
    first by id. Ports not written are the scheme's own; without a known one on
    either side ports don't matter. Recordings that are alike in method, place
    and query are one before the join, and each query pair of a request meets
    only recordings that have it, so a hot path is never multiplied by itself:
    who shares no pair gets the latest of the place. Equal pairs of a request
    count as often as it has them.
    """
    own = lambda u: F.coalesce(u["port"].cast("int"), F.when(u["scheme"].isin("http", "ws"), 80).when(u["scheme"].isin("https", "wss"), 443))

    def placed(df: DataFrame) -> DataFrame:
        u = url_parts(F.col("url"))
        path = F.coalesce(F.nullif(F.regexp_replace(u["path"], "/+$", ""), F.lit("")), F.lit("/"))
        return df.where("method is not null and url is not null").select("id", F.upper("method").alias("m"), u["host"].alias("h"), own(u).alias("port"), path.alias("p"), form_pairs(u["query"]).alias("pairs"), "started_at", "status").where("h is not null")

    place = ["m", "h", "port", "p"]
    at = F.struct(F.coalesce("started_at", F.lit("")).alias("at"), (-F.col("id")).alias("turn"), "id", "status")
    reduced = placed(recordings).withColumn("pairs", F.array_sort(F.array_distinct("pairs"))).groupBy(*place, "pairs").agg(F.max(at).alias("r"))
    asked = placed(requests).select("id", *place, "pairs")
    # requests alike in place and query are answered once
    kinds = asked.groupBy(*place, "pairs").agg(F.min("id").alias("kind"))
    wanted = kinds.select("kind", *place, F.explode("pairs").alias("pair")).groupBy("kind", *place, "pair").agg(F.count(F.lit(1)).alias("times"))
    offered = reduced.select(*place, "r", F.explode("pairs").alias("pair"))
    score = wanted.alias("w").join(offered.alias("o"), [*place, "pair"]).groupBy("kind", "r").agg(F.sum("times").alias("score"))
    best = score.groupBy("kind").agg(F.max(F.struct("score", "r")).alias("b"))
    last = reduced.groupBy(*place).agg(F.max("r").alias("last"))
    found = kinds.join(best, "kind", "left").join(last, place, "left").select(*place, "pairs", F.coalesce("b.r", "last").alias("r"), F.coalesce("b.score", F.when(F.col("last").isNotNull(), 0)).alias("score"))
    same = F.lit(True)
    for c in (*place, "pairs"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}"))
    hit = asked.alias("a").join(found.alias("f"), same).select("a.id", "f.r", "f.score")
    return requests.select("id").join(hit, "id", "left").select("id", F.col("r.id").alias("recording_id"), F.col("r.status").alias("recorded_status"), F.col("score").cast("long").alias("score"))


def certificate_list(entries: DataFrame, now: str, k: int | None = None) -> DataFrame:
    """Distinct certificates by host, the soonest to expire first, with a mark on those expired by ``now``."""
    cols = ["host", "tls_cert_subject", "tls_cert_issuer", "tls_cert_expiry", "tls_version", "tls_cipher_suite"]
    d = entries.where(F.col("tls_cert_expiry").isNotNull()).select(*cols).distinct().withColumn("expired", F.col("tls_cert_expiry") <= now)
    return d if k is None else d.orderBy("tls_cert_expiry", *cols).limit(k)


def request_chains(entries: DataFrame) -> DataFrame:
    """How many entries have a request id, a parent, an initiator and a redirect target."""
    names = {"with_request_id": "request_id", "with_parent": "parent_request_id", "with_initiator": "initiator_type", "with_redirect": "redirect_url"}
    return entries.agg(F.count(F.lit(1)).alias("entries"), *(F.count(c).alias(n) for n, c in names.items()))


def time_range(entries: DataFrame, zones: DataFrame) -> DataFrame:
    """First and last readable start, and the end of the entry that ends last, in microseconds.

    ``zones`` gives the recording zone of an import, for starts without one.
    """
    rows = readable_starts(entries.select("import_id", "started_at", "time_ms"), zones)
    ms = F.when(~F.isnan("time_ms") & (F.col("time_ms") >= 0) & (F.col("time_ms") < 1e12), F.col("time_ms")).otherwise(0.0)
    rows = rows.select(F.col("start_us").alias("us"), ms.alias("ms"))
    return rows.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max(F.col("us") + F.round(F.col("ms") * 1000).cast("long")).alias("end_us"))
