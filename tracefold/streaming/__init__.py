"""Long-running work: watching a folder and folding network events into entries."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def stable(paths: list[str], wait: float, look: Callable[[str], tuple[int, float]] | None = None, most: float = 60.0) -> list[str]:
    """Of some files those whose size and time stay the same for ``wait`` seconds; what still grows after ``most`` seconds is left out.

    ``look`` tells size and time of a path; local files are looked at by default,
    others are taken to be complete, as object stores show whole files only.
    """
    def local(p: str) -> tuple[int, float]:
        inner = p.removeprefix("file://").removeprefix("file:")
        if "://" in inner:
            return 0, 0.0
        try:
            s = os.stat(inner)
        except OSError:
            return -1, 0.0
        return s.st_size, s.st_mtime

    look = look or local
    seen, out, waiting, ends = {p: look(p) for p in paths}, [], list(paths), time.time() + most
    since = dict.fromkeys(paths, time.time())
    while waiting and time.time() < ends:
        time.sleep(min(wait, 0.2))
        for p in list(waiting):
            now = look(p)
            if now != seen[p]:
                seen[p], since[p] = now, time.time()
            elif time.time() - since[p] >= wait:
                waiting.remove(p)
                if now[0] >= 0:
                    out.append(p)
    return out


def watch(spark: SparkSession, folder: str, checkpoint: str, load: Callable[[list[str], int], None], once: bool = False, debounce_ms: int = 750, stable_ms: int = 1000, recursive: bool = True, after: Callable[[list[str]], None] | None = None):
    """Calls ``load`` with the new capture files of every round; the checkpoint remembers those seen.

    Rounds are ``debounce_ms`` apart (50 at least). A file is loaded once it has
    stayed the same for ``stable_ms``; a load that fails is reported and the
    files are tried one by one, so that a bad one doesn't hold up the others.
    ``after`` is called with what was loaded.
    """
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).option("pathGlobFilter", "*.har*").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")

    def each(df: DataFrame, batch: int) -> None:
        paths = [r.path for r in df.toLocalIterator()]  # names of one round's new files
        paths = stable(paths, max(stable_ms, 50) / 1000) if stable_ms else paths
        if not paths:
            return
        done = []
        for group in [paths] if len(paths) == 1 else [paths, *([p] for p in paths)]:
            if group is not paths and set(done) >= set(group):
                continue
            try:
                load(group, batch)
                done += group
            except Exception as e:  # noqa: BLE001
                log.warning("loading %s failed: %s", group, e)
            if group is paths and done:
                break
        if after and done:
            after(done)

    w = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{max(debounce_ms, 50)} milliseconds")).start()


def devtools_events(lines: DataFrame) -> DataFrame:
    """Recorded messages of a browser's network domain (``seq``, ``message`` as JSON) as events for ``fold_events``.

    A request that is sent with a redirect's answer carries that answer's status.
    Other messages, and unreadable ones, are left out.
    """
    get = lambda p: F.get_json_object("message", "$." + p)
    kind = F.when(get("method") == "Network.requestWillBeSent", "sent").when(get("method") == "Network.responseReceived", "received").when(get("method") == "Network.loadingFinished", "finished").when(get("method") == "Network.loadingFailed", "failed")
    return lines.select(
        "seq", get("params.requestId").alias("request_id"), kind.alias("kind"), (get("params.timestamp").try_cast("double") * 1000).alias("at_ms"), get("params.request.url").alias("url"), get("params.request.method").alias("method"),
        F.coalesce(get("params.redirectResponse.status"), get("params.response.status")).try_cast("int").alias("status"),
    ).where("kind is not null and request_id is not null")


def fold_events(events: DataFrame, ended_only: bool = False) -> DataFrame:
    """Recorded network events as entries.

    ``events``: ``seq``, ``request_id``, ``kind`` (sent, received, finished,
    failed), ``at_ms``, ``url``, ``method``, ``status``. A request that is sent
    again is a redirect: every sending starts a new entry of that id, and a status
    it brings is the answer to the one before, which ends then. Requests without
    an end keep a NULL duration, or are left out with ``ended_only``. Events are
    counted along range-sorted rows, so a request with very many is spread.
    """
    from tracefold.plans.scan import running_sum
    from tracefold.plans.shared import Spool

    sent = F.col("kind") == "sent"
    rows = Spool(events.sparkSession).put("events", events.select("seq", "request_id", "kind", "at_ms", "url", "method", "status", sent.cast("long").alias("one")))
    e = running_sum(rows, ["request_id"], ["seq"], "one", "before").withColumn("hop", F.col("before") + F.col("one")).where("hop > 0")
    # what a redirect tells about the hop before it
    told = e.where(sent & (F.col("hop") > 1)).select("request_id", (F.col("hop") - 1).alias("hop"), F.lit("redirected").alias("kind"), "seq", "at_ms", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("method"), "status")
    own = e.select("request_id", "hop", "kind", "seq", "at_ms", "url", "method", F.when(~sent, F.col("status")).alias("status"))
    at = lambda *k: F.max(F.when(F.col("kind").isin(*k), F.col("at_ms")))
    first = lambda c: F.min_by(c, F.when(sent, F.col("seq")))
    began = F.min(F.when(sent, F.col("at_ms")))
    out = own.unionByName(told).groupBy("request_id", "hop").agg(
        first("url").alias("url"), first("method").alias("method"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"), began.alias("started_ms"),
        (at("finished", "failed", "redirected") - began).alias("time_ms"), F.coalesce(F.bool_or(F.col("kind") == "failed"), F.lit(False)).alias("failed"),
    )
    return out.where("time_ms is not null") if ended_only else out


def windowed_traffic(entries: DataFrame, at: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Requests and failures per host and window of a stream, late rows dropped after ``late``."""
    return entries.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 400).alias("failed")).select("w.start", "host", "n", "failed")
