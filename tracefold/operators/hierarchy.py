"""Parent-child rows to whole hierarchies: sizes upward, preorder ranges downward.

Walking a tree level by level takes as many rounds as the tree is deep. Both
passes here double their reach instead: after round k a node knows everything
about its 2**k nearest ancestors, or descendants within that distance, so a
chain of a million nodes takes twenty rounds. A node that has reached its root
is done and moves no more; a round shuffles only those still going. The passes
work on numbers given to the nodes, names join in at the ends.
"""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.plans.scan import carried_last, running_sum
from tracefold.plans.shared import Spool
from tracefold.sources import table


def hierarchy(nodes: DataFrame, space: str, node: str, parent: str, paths: bool = True) -> DataFrame:
    """Place every node of a forest given by parent links.

    ``nodes`` has one row per (``space``, ``node``); links stay inside a space.
    A parent that is NULL or not a node of the space means a root. Output per
    node: ``space``, ``node``, ``parent`` (NULL for roots), ``root``, ``depth``,
    ``subtree_size``, ``first_no`` and ``last_no`` (its nested-set range within
    the space: its descendants are the nodes numbered first_no+1..last_no),
    ``path`` (array from the root down) and ``on_loop``: 'tree', 'loop' or
    'below'. The root is read off the ranges: it is the root whose range holds
    the node's number. On or below a loop, where no range is ever completed,
    root is the smallest node of the loop and the other measures are NULL,
    except depth, which counts steps to the loop.

    Nodes with a NULL space or node are left out. Repeated rows must be removed
    before. Siblings are numbered in the order of their ids. An empty table
    gives no rows.
    """
    spool = Spool(nodes.sparkSession)
    n = nodes.select(F.col(space).alias("s"), F.col(node).alias("v"), F.col(parent).alias("p")).where(F.col("s").isNotNull() & F.col("v").isNotNull())
    n = spool.put("nodes", n.withColumn("id", F.monotonically_increasing_id()))
    there = n.select(F.col("s").alias("ps"), F.col("v").alias("pv"), F.col("id").alias("pid"))
    found = n.where("p is not null").join(there, (F.col("s") == F.col("ps")) & (F.col("p") == F.col("pv")), "left").select("s", "v", "id", F.when(F.col("pid").isNotNull(), F.col("p")).alias("p"), "pid")
    links = found.unionByName(n.where("p is null").select("s", "v", "id", "p", F.lit(None).cast("long").alias("pid")))
    links = spool.put("links", links)
    spool.drop("nodes")
    done, gains, lost = _upward(spool, links)
    size = gains.groupBy("id").agg(F.sum("gain").alias("gain"))
    placed = links.join(done, "id").join(size, "id", "left").withColumn("subtree_size", F.coalesce("gain", F.lit(0)) + 1).drop("gain")
    # roots of a space are siblings of one another; the scan splits large families over partitions
    placed = spool.put("placed", running_sum(placed, ["s", "pid"], ["v"], "subtree_size", "before"))
    numbers = _downward(spool, placed, paths)
    kept = placed.select("id", "s", "v", "p", "depth", "subtree_size").join(numbers, "id").drop("id")
    out = carried_last(kept.withColumn("__top", F.when(F.col("p").isNull(), F.col("v"))), ["s"], ["first_no"], "__top", "root")
    last = F.col("first_no") + F.col("subtree_size") - 1
    cols = ["s", "v", "p", "root", "depth", "subtree_size", "first_no", last.alias("last_no"), "path", F.lit("tree").alias("on_loop")]
    out = out.select(*cols)
    if lost is not None:
        none = F.lit(None).cast("long")
        rest = _loops(spool, links.join(lost, "id").select("s", "v", "p"))
        out = out.unionByName(rest.select("s", "v", "p", "root", "depth", none.alias("subtree_size"), none.alias("first_no"), none.alias("last_no"), F.lit(None).cast(out.schema["path"].dataType).alias("path"), "on_loop"))
    out = spool.finish(out)
    return out.select(F.col("s").alias(space), F.col("v").alias(node), F.col("p").alias(parent), *(c for c in out.columns if c not in "svp"))


def _round(spool: Spool, name: str, turn: int, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes the outcome of a round; gives the rows still going and those that are done, each as files of its own."""
    path = f"{spool.root}/{name}-rounds/{turn}"
    df.write.partitionBy("go").parquet(path)
    read = spool.spark.read.schema(df.drop("go").schema)
    return tuple(read.parquet(f"{path}/go={k}") if spool.holds(f"{path}/go={k}") else spool.spark.createDataFrame([], df.drop("go").schema) for k in ("true", "false"))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _upward(spool: Spool, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Depths and subtree sizes: ``id``, ``depth`` of tree nodes; ``id``, ``gain`` to be summed; ids on or below loops.

    A going node's ``up`` is its ancestor 2**k steps away and ``size`` counts its
    descendants (itself included) nearer than that. If a round lets nobody reach
    a root, nobody ever will: those left are on or below loops.
    """
    done = [links.where("pid is null").select("id", F.lit(0).cast("long").alias("depth"))]
    going = links.where("pid is not null").select("id", F.col("pid").alias("up"), F.lit(1).cast("long").alias("size"))
    gains, reach, turn = [], 1, 0
    left = going.count()
    while left:
        gain = spool.put(f"gain{turn}", going.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("gain")))
        gains.append(gain)
        ends = [d.select(F.col("id").alias("up"), F.lit(None).cast("long").alias("next"), "depth") for d in done]
        state = _together([going.select(F.col("id").alias("up"), F.col("up").alias("next"), F.lit(0).cast("long").alias("depth")), *ends])
        moved = going.join(state, "up").join(gain, "id", "left")
        moved = moved.select("id", F.col("next").alias("up"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"), (F.col("depth") + reach).alias("depth"), F.col("next").isNotNull().alias("go"))
        going, ended = _round(spool, "up", turn, moved)
        going = going.select("id", "up", "size")
        done.append(ended.select("id", "depth"))
        now = going.count()
        if now == left:
            return _together(done), _together(gains), going.select("id")
        reach, turn, left = 2 * reach, turn + 1, now
    return _together(done), _together(gains) if gains else links.limit(0).select("id", F.lit(0).cast("long").alias("gain")), None


def _downward(spool: Spool, placed: DataFrame, paths: bool) -> DataFrame:
    """Preorder numbers ``id``, ``first_no``, ``path``: a node's place is the sum of sibling offsets along its path.

    ``far`` is the ancestor whose own sum is still to be added.
    """
    path = F.array(F.col("v")) if paths else F.lit(None).cast("array<string>")
    t = placed.select("id", F.col("pid").alias("far"), (F.col("before") + F.col("pid").isNotNull().cast("long")).alias("first_no"), path.alias("path"))
    going, done, turn = t.where("far is not null"), [t.where("far is null").drop("far")], 0
    while not going.isEmpty():
        b = _together([going.select("id", "far", "first_no", "path"), *(d.select("id", F.lit(None).cast("long").alias("far"), "first_no", "path") for d in done)])
        b = b.select(F.col("id").alias("far"), F.col("far").alias("next"), F.col("first_no").alias("more"), F.col("path").alias("head"))
        moved = going.join(b, "far").select("id", F.col("next").alias("far"), (F.col("first_no") + F.col("more")).alias("first_no"), F.concat("head", "path").alias("path"), F.col("next").isNotNull().alias("go"))
        going, ended = _round(spool, "down", turn, moved)
        done.append(ended.drop("far"))
        turn += 1
    return _together(done)


def _loops(spool: Spool, rest: DataFrame) -> DataFrame:
    """Roots of nodes on or below loops: the smallest node of the loop.

    Every node of ``rest`` has its parent there. low is the smallest node among
    the first 2**k on its way, itself first. Once the set of nodes reached stops
    shrinking, it is exactly the loops; once low stops changing, it is the
    minimum of the loop for nodes on one. depth counts the steps to the loop.
    """
    t = spool.put("loop", rest.select("s", "v", "p", F.col("p").alias("far"), F.col("v").alias("low")))
    seen = None
    while True:
        b = t.select(F.col("s").alias("bs"), F.col("v").alias("bv"), F.col("far").alias("bfar"), F.col("low").alias("blow"))
        j = t.join(b, (t.s == b.bs) & (t.far == b.bv)).select("s", "v", "p", F.col("bfar").alias("far"), F.least("low", "blow").alias("low"), (F.col("blow") < F.col("low")).cast("long").alias("fell"))
        t = spool.put("loop", j)
        now = t.agg(F.count_distinct("s", "far"), F.sum("fell")).first()
        if seen == now[0] and not now[1]:
            break
        seen = now[0]
    on = t.select("s", F.col("far").alias("v")).distinct()
    lows = t.select(F.col("s").alias("ls"), F.col("v").alias("lv"), F.col("low").alias("root"))
    r = t.join(lows, (t.s == lows.ls) & (t.far == lows.lv)).select("s", "v", "p", "root")
    r = r.join(on.withColumn("on", F.lit(True)), ["s", "v"], "left")
    r = spool.put("ringed", r.select("s", "v", "p", "root", F.when(F.col("on"), "loop").otherwise("below").alias("on_loop")))
    spool.drop("loop")
    return r.join(_steps(spool, r), ["s", "v"])


def _steps(spool: Spool, placed: DataFrame) -> DataFrame:
    """How many steps each node is from its loop, by doubling; nodes on one are 0 away and are the ends of all ways."""
    here = F.col("on_loop") == "loop"
    t = spool.put("steps", placed.select("s", "v", F.when(~here, F.col("p")).alias("far"), (~here).cast("long").alias("depth")))
    while not t.where(F.col("far").isNotNull()).isEmpty():
        b = t.select("s", F.col("v").alias("far"), F.col("far").alias("bfar"), F.col("depth").alias("bdepth"))
        j = t.where(F.col("far").isNotNull()).join(b, ["s", "far"])
        t = spool.put("steps", t.where(F.col("far").isNull()).unionByName(j.select("s", "v", F.col("bfar").alias("far"), (F.col("depth") + F.col("bdepth")).alias("depth"))))
    return t.select("s", "v", "depth")


def descendants(placed: DataFrame, of: DataFrame, space: str, node: str) -> DataFrame:
    """All descendants of the nodes in ``of`` (columns space, node), through the nested-set ranges.

    Nodes are cut into blocks of numbers; a range asks only for the blocks it
    meets, so the join is by equality on (space, block) with a range check.
    """
    block = 256
    ask = of.select(space, node).distinct().join(placed.select(space, node, "first_no", "last_no"), [space, node])
    ask = ask.where("last_no > first_no").select(
        F.col(space).alias("s"), F.col(node).alias("ancestor"), "first_no", "last_no",
        F.explode(F.sequence(F.floor((F.col("first_no") + 1) / block), F.floor(F.col("last_no") / block))).alias("block"),
    )
    all_ = placed.where("first_no is not null").select(F.col(space).alias("s"), F.col(node).alias("descendant"), F.col("first_no").alias("no"), F.floor(F.col("first_no") / block).alias("block"))
    j = ask.join(all_, ["s", "block"]).where((F.col("no") > F.col("first_no")) & (F.col("no") <= F.col("last_no")))
    return j.select(F.col("s").alias(space), "ancestor", "descendant")


def resolve_redirect(target: str | None, base: str | None) -> str | None:
    """A redirect's target against its own URL: scheme and host in lower case, default port dropped."""
    if target is None:
        return None
    target = target.strip()
    if not target:
        return None
    try:
        u = urlsplit(urljoin(base or "", target))
        host, port = (u.hostname or ""), u.port
        scheme = u.scheme.lower()
        if ":" in host:
            host = f"[{host}]"
        user = u.netloc.rpartition("@")[0]
        net = (user + "@" if user else "") + host.lower()
        if port is not None and port != {"http": 80, "https": 443, "ws": 80, "wss": 443}.get(scheme):
            net += f":{port}"
        return urlunsplit((scheme, net, u.path, u.query, u.fragment))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _resolved(target: pd.Series, base: pd.Series) -> pd.Series:
    known = {k: resolve_redirect(*k) for k in set(zip(target, base))}
    return pd.Series([known[k] for k in zip(target, base)], dtype=object)


def request_links(spark: SparkSession, store: str) -> DataFrame:
    """One row per request of an import with its parent, by id or through a redirect.

    Where a request was captured more than once its first row (smallest id)
    speaks for it. If several redirects lead to a URL the one captured first is
    the parent.
    """
    e = table(spark, store, "entries").select("id", "import_id", "request_id", "parent_request_id", "status", "url", "redirect_url").where(F.col("request_id").isNotNull())
    first = e.groupBy("import_id", "request_id").agg(F.min_by(F.struct("parent_request_id", "url"), "id").alias("e"))
    first = first.select("import_id", "request_id", "e.parent_request_id", "e.url")
    r = e.where(F.col("status").between(300, 399) & F.col("redirect_url").isNotNull())
    r = r.select("import_id", "id", "request_id", _resolved("redirect_url", "url").alias("url")).where(F.col("url").isNotNull())
    r = r.groupBy("import_id", "url").agg(F.min_by("request_id", "id").alias("via"))
    orphans = first.where(F.col("parent_request_id").isNull()).join(r, ["import_id", "url"], "left").select("import_id", "request_id", F.col("via").alias("parent_request_id"))
    return first.where(F.col("parent_request_id").isNotNull()).select("import_id", "request_id", "parent_request_id").unionByName(orphans)


def p1_hierarchy(spark: SparkSession, store: str) -> DataFrame:
    """Every request placed in its tree: path, depth, root and the range of its descendants."""
    h = hierarchy(request_links(spark, store), "import_id", "request_id", "parent_request_id")
    return h.withColumn("path", F.array_join("path", "/"))


def p1_descendants(spark: SparkSession, store: str) -> DataFrame:
    """Every request of a tree with each of its descendants, through the nested-set ranges."""
    h = hierarchy(request_links(spark, store), "import_id", "request_id", "parent_request_id", paths=False)
    return descendants(h, h, "import_id", "request_id")


def p1_found(spark: SparkSession, store: str) -> DataFrame:
    """Requests that have a parent, with the root whose range holds them (on or below a loop: its smallest request)."""
    h = hierarchy(request_links(spark, store), "import_id", "request_id", "parent_request_id", paths=False)
    return h.where(F.col("parent_request_id").isNotNull()).select("import_id", "request_id", F.col("root").alias("root_request_id"))
